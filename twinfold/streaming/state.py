"""Keyed state in parts, each written once, in hash buckets of its keys.

Rows of several kinds lie in one part, so a batch writes its state in one job; below the part there is a folder for each kind and bucket.
A reader names keys and reads only the buckets in which these may lie. Small parts have few buckets, large ones many. When FAN parts of one tier
have come together, they are merged to one of the next, so a row is written again only as often as the number of tiers, and a
reader meets a few parts of each tier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.plans.storage import list_files, remove

#: Parts of a tier that are merged to one of the next tier.
FAN = 8
#: Rows for each bucket of a part, and the most buckets of one; what the driver learns of a batch's keys is so many numbers.
BUCKET_ROWS, MAX_BUCKETS = 100_000, 4096

COLUMNS = "kind string, text string, domain string, num bigint, hash bigint, head bigint, version bigint"
#: What a kind's rows are found by.
KEYS = {"url": "text", "print": "text", "former": "num", "size": "num", "item": "num"}
#: Kinds of which the row of the latest version holds.
_LATEST = ("former", "size")


def row(kind: str, **columns) -> list:
    """The columns of state rows of a kind; those that aren't named are null."""
    types = dict(c.split() for c in COLUMNS.split(", "))
    named = columns | {"kind": F.lit(kind)}
    return [named.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()]


class BucketedState:
    """Parts of state below a folder. parts: what is read, as plain dicts that can be stored; files: the bucket folders that were read last, by kind."""

    def __init__(self, spark: SparkSession, root: str, parts: list[dict] | None = None):
        self.spark, self.root, self.parts, self.files = spark, root, list(parts or []), {}

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], COLUMNS)

    def read(self, kind: str, named: DataFrame | None = None) -> DataFrame:
        """Rows of a kind; named: one column of keys, of whose buckets alone the rows come (others may come along). None reads all."""
        parts = [p for p in self.parts if kind in p["buckets"]]
        wanted = None
        most = max((p["modulus"] for p in parts), default=1)
        if named is not None and most > 1:
            number = F.pmod(F.xxhash64(F.col(named.columns[0])), F.lit(most))
            wanted = {r[0] for r in named.select(number.alias("b")).distinct().collect()}  # MAX_BUCKETS numbers at most
        paths = []
        for p in parts:
            own = None if wanted is None else {b % p["modulus"] for b in wanted}
            paths += [f"{p['path']}/kind={kind}/bucket={b}" for b in p["buckets"][kind] if own is None or b in own]
        self.files[kind] = len(paths)
        if not paths:
            return self._empty()
        found = self.spark.read.schema(COLUMNS.removeprefix("kind string, ")).parquet(*paths).select(F.lit(kind).alias("kind"), "*")
        return self._latest(found) if kind in _LATEST else found

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("num").agg(F.max(F.struct("version", "head")).alias("m"))
        return last.select(F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("domain"), "num", F.lit(None).cast("bigint").alias("hash"), "m.head", "m.version")

    def write(self, rows: DataFrame, n: int, path: str, tier: int = 0) -> dict:
        """Write rows as one part; n: about how many they are."""
        modulus = 1 << min(MAX_BUCKETS, max(1, -(-n // BUCKET_ROWS))).bit_length() - 1
        key = F.coalesce(*(F.when(F.col("kind") == kind, F.xxhash64(column)) for kind, column in KEYS.items()))
        dealt = rows.withColumn("bucket", F.pmod(key, F.lit(modulus)).cast("int")).hint("rebalance", "kind", "bucket")
        dealt.write.mode("overwrite").partitionBy("kind", "bucket").parquet(path)
        buckets: dict[str, list[int]] = {}
        for folder in list_files(self.spark, path):
            if folder.startswith("kind="):
                buckets[folder.removeprefix("kind=")] = sorted(int(b.removeprefix("bucket=")) for b in list_files(self.spark, f"{path}/{folder}"))
        return {"path": path, "modulus": modulus, "tier": tier, "rows": n, "buckets": buckets}

    def added(self, part: dict, version: int) -> tuple[list[dict], list[dict]]:
        """(parts with a new one, parts that are no longer read): tiers that are full are merged."""
        parts, gone = [*self.parts, part], []
        while full := next(([p for p in parts if p["tier"] == t] for t in sorted({p["tier"] for p in parts}) if sum(p["tier"] == t for p in parts) >= FAN), None):
            tier, n = full[0]["tier"] + 1, sum(p["rows"] for p in full)
            whole = BucketedState(self.spark, self.root, full)
            rows = None
            for kind in KEYS:
                found = whole.read(kind).select(*row(kind, **{c: F.col(c) for c in ("text", "domain", "num", "hash", "head", "version")}))
                rows = found if rows is None else rows.unionByName(found)
            merged = self.write(rows, n, f"{self.root}/parts/{version}-{tier}", tier)
            parts = [p for p in parts if p not in full] + [merged]
            gone += full
        return parts, gone

    def delete(self, parts: list[dict]) -> None:
        for part in parts:
            remove(self.spark, part["path"])
