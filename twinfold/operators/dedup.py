"""The whole grouping: items to groups with primaries, order, counts and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions.bits import hash_hex
from twinfold.functions.hashes import diff_hash32, image_hash
from twinfold.operators import collapse, edges, rules
from twinfold.operators.components import connected_components
from twinfold.plans.config import DedupConfig
from twinfold.plans.storage import Scratch


class DuplicateFinder:
    """Groups items (idx, item_id, url, domain, visible, and hash or grid) under a configuration."""

    def __init__(self, config: DedupConfig, scratch: Scratch):
        self.config, self.scratch = config, scratch

    def rule_rows(self) -> DataFrame:
        rows = [(k, d, v) for k, (d, v) in enumerate(self.config.domainSettings)]
        return self.scratch.spark.createDataFrame(rows, "pos int, domain string, value boolean")

    def prepared(self, items: DataFrame) -> DataFrame:
        """Visible items with their fingerprint; it is null without a whole grid, or where a rule says so. Other columns come along. Grids made by nested lambdas must be written out before, as for the Arrow fingerprints of image_hash()."""
        seen = rules.lookup(items.where("visible"), self.rule_rows(), self.config.deduplicateThumbs, out="_process")
        if "hash" not in items.columns:
            wanted = F.when(F.col("_process"), F.col("grid"))
            # whole grids have one fingerprint by both forms of the difference hash; that on whole batches takes a fifth of the time
            by_batch = self.config.hashFunction == "diffHash"
            seen = seen.withColumn("hash", diff_hash32(wanted) if by_batch else image_hash(wanted, self.config.hashFunction)).drop("grid")
        else:
            seen = seen.withColumn("hash", F.when(F.col("_process"), F.col("hash")))
        return self.scratch.save(seen.drop("_process"), "items")

    def links(self, items: DataFrame) -> DataFrame:
        by_hash = edges.hash_edges(items, self.config.maxHammingDistance, self.config.partitionByDomain, self.scratch)
        return edges.url_edges(items).unionByName(by_hash)

    def grouped(self, items: DataFrame, show: bool = False, toggled: DataFrame | None = None) -> DataFrame:
        """The groups of all visible items, as collapse.groups() tells them. Fingerprints are shown, with their place in the listing, if the settings say so."""
        seen = self.prepared(items)
        out = collapse.groups(seen, connected_components(self.links(seen), self.scratch), self.scratch, show, toggled)
        if self.config.showHashValues:
            out = out.withColumn("hash_hex", F.when(F.col("hash").isNotNull(), F.concat(F.lit(" ["), hash_hex(F.col("hash")), F.lit("]"))))
        return out
