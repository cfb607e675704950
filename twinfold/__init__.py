"""Near-duplicate grouping and corpus preparation on PySpark."""
