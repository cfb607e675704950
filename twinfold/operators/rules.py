"""Per-domain rules: the rule of the longest domain suffix holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions.domains import label_key, sort_key, suffixes
from twinfold.plans.storage import join_facts

#: Rules are typed in by hand; beyond this number they are not broadcast.
_BROADCAST_RULES = 10_000
#: Distinct domains up to this number have their values broadcast, so that the items aren't shuffled, whatever they carry.
_BROADCAST_DOMAINS = 10_000


def rule_table(rules: DataFrame) -> DataFrame:
    """Rows (suffix, value) of rules (pos, domain, value): of equal domains the last one; null values are skipped."""
    named = rules.where(F.col("value").isNotNull()).select(F.array_join(label_key(F.col("domain")), ".").alias("suffix"), "pos", "value")
    return named.groupBy("suffix").agg(F.max_by("value", "pos").alias("value"))


def ordered_rules(rules: DataFrame) -> DataFrame:
    """Rules as listed to the user, rows (domain, value, sort_key): of those with one sort key the last, by labels from the top down."""
    keyed = rules.withColumn("sort_key", sort_key(F.col("domain")))
    return keyed.groupBy("sort_key").agg(F.max_by("domain", "pos").alias("domain"), F.max_by("value", "pos").alias("value")).select("domain", "value", "sort_key").orderBy("sort_key")


def with_rules(rules: DataFrame, later: DataFrame) -> DataFrame:
    """Rules with others (pos, domain, value) entered after them."""
    last = rules.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("_last"))
    return rules.unionByName(later.join(F.broadcast(last)).select((F.col("pos") + F.col("_last") + 1).cast("int").alias("pos"), "domain", "value"))  # last is one row


def rule_count(rules: DataFrame) -> DataFrame:
    """One row: how many rules are listed."""
    return rules.agg(F.count_distinct(sort_key(F.col("domain"))).alias("n_rules"))


def lookup(items: DataFrame, rules: DataFrame, default: bool, domain: str = "domain", out: str = "process") -> DataFrame:
    """Add the value of the longest matching suffix, or the default. Looked up once for each distinct domain; case counts. A column of the items named as `out` is replaced."""
    if default is None:
        raise ValueError("a default is needed")
    table = rule_table(rules)
    items = items.drop(out)
    n_rules = rules.limit(_BROADCAST_RULES + 1).count()
    if not n_rules:
        return items.withColumn(out, F.lit(default))
    known = items.select(F.coalesce(domain, F.lit("")).alias("_rule_domain")).distinct()
    parts = known.select("_rule_domain", F.posexplode(suffixes(F.col("_rule_domain"))).alias("_depth", "suffix"))
    found = parts.join(F.broadcast(table) if n_rules <= _BROADCAST_RULES else table, "suffix").groupBy("_rule_domain").agg(F.max_by("value", "_depth").alias("_rule_value"))
    wide = items.withColumn("_rule_domain", F.coalesce(domain, F.lit("")))
    if known.limit(_BROADCAST_DOMAINS + 1).count() <= _BROADCAST_DOMAINS:
        valued = wide.join(F.broadcast(found), "_rule_domain", "left")
    else:
        valued = join_facts(wide, found, ["_rule_domain"], "left")
    return valued.withColumn(out, F.coalesce("_rule_value", F.lit(default))).drop("_rule_domain", "_rule_value")
