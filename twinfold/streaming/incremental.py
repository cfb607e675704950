"""Grouping over micro-batches.

State lies in a folder, in hash buckets of its keys (see state.py): which primary a url and a fingerprint had when they were first seen, to
which one a former primary has lost its place, how large the group of each primary is, and the items of each batch with their primary of that time.
A batch reads the buckets of its own urls, of the domains of its fingerprints (all of them if domains don't matter), and of the primaries it
meets, and no others. Items of one url and fingerprint are first counted as one row, and components are found among heads only: the first items of these
sets and the primaries they touch. Ids are unique. All that a batch
adds is written in one job, and nothing is changed in place. Primaries are smallest ids, so the order in which batches arrive doesn't
matter. A batch counts once its record is stored, which is the last thing it does; after a restart on the same folder,
batches done are known, and half-done ones are done again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from twinfold.functions.bits import is_blank
from twinfold.operators import edges
from twinfold.operators.components import connected_components
from twinfold.operators.dedup import DuplicateFinder
from twinfold.plans.config import DedupConfig
from twinfold.plans.storage import Scratch, join_facts, list_files, read_text, released, remove, write_text
from twinfold.sources.items import LISTING, SEARCH
from twinfold.streaming.state import BucketedState, row

#: Statistics of so many batches are kept; records of done batches before the last ones are deleted.
STATS_KEPT, RECORDS_KEPT = 200, 2

#: What tells the sets of a batch's items apart.
_SET = ("set_key", "set_url", "set_part", "set_print", "set_item")

_COUNTS = ("batch_num_with_dups", "batch_total_dups", "num_with_dups", "total_dups")


class IncrementalFinder:
    """Feed process() with batches of items, or use on_batch() in foreachBatch.

    path: where the state lies; without one it is scratch and ends with the driver. page_type: what routing told; batches of a page that is not searched are
    ignored: one with another page type than the two that are, which tells the reason then, or one that lacks its container (ignored=True).
    errors lists failed batches; stats has a row for each of the last done ones. on_error: "note" a failed batch and go on, or "raise", so that the stream tries it again.
    """

    def __init__(self, spark: SparkSession, config: DedupConfig, path: str | None = None, page_type: str | None = LISTING, on_error: str = "note", ignored: bool = False):
        if on_error not in ("note", "raise"):
            raise ValueError(f"on_error: {on_error}")
        self.spark, self.config, self.page_type, self.on_error = spark, config, page_type, on_error
        self.ignored = ignored or page_type not in (LISTING, SEARCH)
        self.scratch = Scratch(spark)
        self.root = path.rstrip("/") if path else self.scratch.folder("state")
        self.errors: dict[int, str] = {}
        self.pending, self.initialized = 0, False
        self.stats: dict[int, dict] = {}
        #: Batches done, as sorted pairs of first and last id; links of batches that have arrived and failed.
        self.done: list[list[int]] = []
        self.failed_links: dict[int, int] = {}
        self.totals = {"num_links": 0, "num_with_dups": 0, "total_dups": 0, "n_prints": 0}
        self.version, self._unused = 0, []
        self.state = BucketedState(spark, self.root)
        self._restore()
        self.initialized = True

    def _restore(self) -> None:
        records = sorted(x for x in list_files(self.spark, f"{self.root}/done") if x.endswith(".json"))
        if not records:
            return
        last = json.loads(read_text(self.spark, f"{self.root}/done/{records[-1]}"))
        self.version, self.totals, self.done, self._unused = last["version"], last["totals"], last["done"], last["unused"]
        self.stats = {s["batch_id"]: s for s in last["stats"]}
        self.failed_links = {int(k): n for k, n in last["failed_links"].items()}
        self.state = BucketedState(self.spark, self.root, last["parts"])

    def status(self) -> dict:
        """What a monitor may ask for. num_links counts the links of each batch that has arrived, failed ones too."""
        return {
            "page_type": self.page_type, "ignored": self.ignored, "initialized": self.initialized, "pending": self.pending, "num_links": self.totals["num_links"] + sum(self.failed_links.values()),
            "num_with_dups": self.totals["num_with_dups"], "total_dups": self.totals["total_dups"], "last_batch_error": list(self.errors.values())[-1] if self.errors else None,
        }

    @property
    def items(self) -> DataFrame:
        """All known items with their primary of now; can be read until two batches later."""
        former = self.state.read("former")
        known = self.state.read("item").select(F.col("num").alias("idx"), F.col("text").alias("url"), "domain", "hash", F.col("head").alias("was"))
        leads = self.scratch.save(former.select(F.col("num").alias("was"), F.col("head").alias("now")), "leads")
        while True:  # each round doubles the steps that are known
            onward = leads.select(F.col("was").alias("now"), F.col("now").alias("next"))
            new = self.scratch.save(join_facts(leads, onward, ["now"], "left").select("was", F.coalesce("next", "now").alias("now"), F.col("next").isNotNull().alias("moved")), "leads")
            self.scratch.drop(leads)
            leads = new
            if new.where("moved").isEmpty():
                break
        return join_facts(known, leads.select("was", "now"), ["was"], "left").select("idx", "url", "domain", "hash", F.coalesce("now", "was").alias("primary_idx"))

    def is_done(self, batch_id: int) -> bool:
        return any(a <= batch_id <= b for a, b in self.done)

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: a batch done before is not done again."""
        if self.ignored or self.is_done(batch_id):
            return
        self.pending += 1
        try:
            self.process(batch, batch_id)
            self.errors.pop(batch_id, None)
        except Exception as failed:
            self.errors.pop(batch_id, None)
            self.errors[batch_id] = str(failed)
            if self.on_error == "raise":
                raise
        finally:
            self.pending -= 1

    def process(self, batch: DataFrame, batch_id: int) -> dict:
        """Group a batch; gives its statistics. num_links counts invisible items too, and those of a batch that fails; an empty batch changes nothing."""
        arrived = batch.agg(F.count("*").alias("n"), (F.min("idx") if "idx" in batch.columns else F.lit(None)).alias("start")).first()
        self.failed_links[batch_id] = arrived["n"]  # until it is done
        with released():
            try:
                return self._process(batch, batch_id, arrived["n"], arrived["start"])
            except Exception:
                remove(self.spark, self._part_path(self.version + 1))
                raise

    def _part_path(self, version: int) -> str:
        return f"{self.root}/parts/{version}"

    def _process(self, batch: DataFrame, batch_id: int, n: int, start: int | None) -> dict:
        scratch, version = Scratch(self.spark), self.version + 1
        new = DuplicateFinder(self.config, scratch).prepared(batch).select("idx", "url", "domain", "hash") if n else None
        if new is None or not new.count():  # a written table tells its rows in its footers
            same = {k: 0 for k in ("n_items", "batch_num_with_dups", "batch_total_dups")} | {k: self.totals[k] for k in ("num_with_dups", "total_dups")}
            self._store(None, n, batch_id, version, {"batch_id": batch_id, "version": version, "num_links": n, **same})
            return self.stats[batch_id]
        sets = self._sets(new, start, n, scratch)
        urls = scratch.save(sets.where("url <> ''").groupBy("url").agg(F.min("idx").alias("b")), "urls")
        prints = scratch.save(edges.hash_keys(sets, self.config.partitionByDomain).groupBy("part", "hash").agg(F.min("idx").alias("a")), "prints")
        known_urls = scratch.save(self.state.read("url", urls.select("url")).select(F.col("text").alias("url"), "head").join(urls, "url"), "known")
        known_prints = self.state.read("print", prints.select("part").distinct()).select(F.col("text").alias("part"), "hash", F.col("head").alias("b"))
        met = self._primaries(scratch.save(known_urls.select("head", "b").unionByName(self._near(prints, known_prints)).distinct(), "met"), scratch)

        links = met.select(F.col("primary").alias("a"), "b")
        if prints.count():  # else no two sets share a url
            links = links.unionByName(DuplicateFinder(self.config, scratch).links(sets).select("a", "b"))
        parts = scratch.save(connected_components(links, scratch), "parts").withColumnsRenamed({"id": "idx", "component": "head"})
        touched = met.select(F.col("primary").alias("num")).distinct()
        sizes = self.state.read("size", touched).select("num", F.col("head").alias("known_size"))
        heads = touched.join(sizes, "num", "left").select(F.col("num").alias("idx"), F.coalesce("known_size", F.lit(1)).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("inside"), F.lit(False).alias("fresh"))
        heads = sets.select("idx", "size", "inside", F.lit(True).alias("fresh")).unionByName(heads)
        heads = scratch.save(heads.join(parts, "idx", "left").withColumn("head", F.coalesce("head", "idx")), "heads")
        told, ranked = self._told(heads, start, n, scratch)

        led = heads.where("fresh").select("idx", "head")
        keyed = scratch.save(sets.join(led, "idx").select(*_SET, "head"), "keyed")  # written, so that the join with the items is dealt for itself
        rows = [
            self._with_sets(new).join(keyed, list(_SET)).select(*row("item", num=F.col("idx"), text=F.col("url"), domain=F.col("domain"), hash=F.col("hash"), head=F.col("head"))),
            urls.join(known_urls.select("url"), "url", "left_anti").join(led, F.col("b") == F.col("idx")).select(*row("url", text=F.col("url"), head=F.col("head"))),
            prints.join(known_prints.select("part", "hash").distinct(), ["part", "hash"], "left_anti").join(led, F.col("a") == F.col("idx")).select(*row("print", text=F.col("part"), hash=F.col("hash"), head=F.col("head"))),
            heads.where("not fresh and idx <> head").select(*row("former", num=F.col("idx"), head=F.col("head"), version=F.lit(version))),
            # a way that took several steps is stored as one
            met.where("steps > 1").select("was", "primary").distinct().join(heads.select(F.col("idx").alias("primary"), "head"), "primary").select(*row("former", num=F.col("was"), head=F.col("head"), version=F.lit(version))),
            ranked.where("idx = head and whole > 1 and (fresh or whole > size)").select(*row("size", num=F.col("idx"), head=F.col("whole"), version=F.lit(version))),
        ]
        whole = rows[0]
        for other in rows[1:]:
            whole = whole.unionByName(other)
        self._store(whole, n, batch_id, version, {"batch_id": batch_id, "version": version, "num_links": n, **told})
        return self.stats[batch_id]

    def _with_sets(self, items: DataFrame) -> DataFrame:
        """Items with the key of those that surely belong together: equal url, domain part and fingerprint. One without url and fingerprint is alone."""
        part = F.coalesce("domain", F.lit("")) if self.config.partitionByDomain else F.lit("")
        counts = F.coalesce(~is_blank(F.col("hash")), F.lit(False))
        url, known = F.coalesce("url", F.lit("")), {"set_print": F.when(counts, F.col("hash")).otherwise(0), "set_part": F.when(counts, part).otherwise("")}
        named = items.withColumns(known | {"set_url": url, "set_item": F.when((url == "") & ~counts, F.col("idx")).otherwise(0)})
        return named.withColumn("set_key", F.xxhash64("set_url", "set_part", "set_print", "set_item"))

    def _sets(self, new: DataFrame, start: int | None, length: int, scratch: Scratch) -> DataFrame:
        """The batch's items of one key as one row, as the first of them with their number, and how many are in the batch's range; all that follows but the writing of the items works on these."""
        inside = F.lit(False) if start is None else F.col("idx").between(start, start + length)
        sets = self._with_sets(new).groupBy(*_SET).agg(F.min("idx").alias("idx"), F.count("*").alias("size"), F.count_if(inside).alias("inside"))
        # the blank fingerprint 0 links nothing
        return scratch.save(sets, "sets").withColumns({"url": F.col("set_url"), "domain": F.col("set_part"), "hash": F.col("set_print")})

    def _near(self, prints: DataFrame, known: DataFrame) -> DataFrame:
        """Rows (head, b): what known fingerprints within the radius led to, and the batch's item."""
        radius = self.config.maxHammingDistance
        if not radius:
            return prints.join(known, ["part", "hash"]).select(F.col("b").alias("head"), F.col("a").alias("b"))
        old = known.groupBy("part", "hash").agg(F.min("b").alias("b")).withColumnRenamed("hash", "hb")
        near = edges.near_join(prints.withColumnRenamed("hash", "ha"), old, radius, edges.choose_blocks(radius, prints.count(), self.totals["n_prints"]))
        return near.select(F.col("b").alias("head"), F.col("a").alias("b"))

    def _primaries(self, met: DataFrame, scratch: Scratch) -> DataFrame:
        """Rows (head, b) with the primary of now, what came before it, and how many steps it took; each round reads the buckets of the heads it has reached."""
        now = met.select("b", F.col("head").alias("was"), F.col("head").alias("primary"), F.lit(0).alias("steps"))
        while True:
            former = self.state.read("former", now.select("primary").distinct()).select(F.col("num").alias("primary"), F.col("head").alias("next"))
            if not self.state.files["former"]:
                return now
            moved = scratch.save(join_facts(now, former, ["primary"], "left").select("b", "was", F.coalesce("next", "primary").alias("primary"), F.col("next").isNotNull().alias("moved"), (F.col("steps") + F.col("next").isNotNull().cast("int")).alias("steps")), "met")
            now = moved.drop("moved")
            if moved.where("moved").isEmpty():
                return now

    def _told(self, heads: DataFrame, start: int | None, length: int, scratch: Scratch) -> tuple[dict, DataFrame]:
        """(what the batch changes, heads with the sizes of their groups as `whole`), gathered in the job that writes the latter.

        A batch's range is start .. start + length, both ends included; a head counts that got its first duplicates, or that lost its place.
        """
        old = ~F.col("fresh")
        sizes = heads.groupBy("head").agg(F.sum("size").alias("whole"), F.count_if(old & (F.col("size") > 1)).alias("had"), F.sum(F.when(old, F.col("size") - 1).otherwise(0)).alias("dups"))
        inside = F.lit(False) if start is None else F.col("idx").between(start, start + length)
        still = F.col("idx") == F.col("head")
        told = Observation("batch")
        # of a set all in the range fall but its first item, if that is the head
        fallen = F.when(old, (inside & ~still).cast("bigint")).otherwise(F.col("inside") - (inside & still).cast("bigint"))
        ranked = join_facts(heads, sizes, ["head"]).observe(
            told,
            F.count_if(inside & still & (F.col("fresh") | (F.col("size") == 1)) & (F.col("whole") > 1)).alias("batch_num_with_dups"),
            F.coalesce(F.sum(fallen), F.lit(0)).alias("batch_total_dups"),
            F.coalesce(F.sum(F.when(still, (F.col("whole") > 1).cast("bigint") - F.col("had"))), F.lit(0)).alias("more_with_dups"),
            F.coalesce(F.sum(F.when(still, F.col("whole") - 1 - F.col("dups"))), F.lit(0)).alias("more_dups"),
            F.coalesce(F.sum(F.when(F.col("fresh"), F.col("size"))), F.lit(0)).alias("n_items"),
        )
        ranked = scratch.save(ranked, "ranked")
        got = told.get
        return {"n_items": got["n_items"], "batch_num_with_dups": got["batch_num_with_dups"], "batch_total_dups": got["batch_total_dups"], "num_with_dups": self.totals["num_with_dups"] + got["more_with_dups"], "total_dups": self.totals["total_dups"] + got["more_dups"]}, ranked

    def _store(self, rows: DataFrame | None, n: int, batch_id: int, version: int, stats: dict) -> None:
        """Write the batch's part and its record, and delete what only the version before the last has used."""
        parts, gone, new_prints = self.state.parts, [], 0
        if rows is not None:
            count = Observation("prints")
            part = self.state.write(rows.observe(count, F.count_if(F.col("kind") == "print").alias("n")), n, self._part_path(version))
            (parts, gone), new_prints = self.state.added(part, version), count.get["n"]
        failed = {k: v for k, v in self.failed_links.items() if k != batch_id}
        totals = {"num_links": self.totals["num_links"] + n, "num_with_dups": stats["num_with_dups"], "total_dups": stats["total_dups"], "n_prints": self.totals["n_prints"] + new_prints}
        done = _with(self.done, batch_id)
        kept = dict(list((self.stats | {batch_id: stats}).items())[-STATS_KEPT:])
        record = {"version": version, "parts": parts, "totals": totals, "done": done, "failed_links": failed, "unused": gone, "stats": list(kept.values())}
        write_text(self.spark, f"{self.root}/done/{version:012d}.json", json.dumps(record))
        self.version, self.totals, self.done, self.failed_links, self.stats = version, totals, done, failed, kept
        self.state.parts = parts
        self.state.delete(self._unused)
        self._unused = gone
        for old in sorted(x for x in list_files(self.spark, f"{self.root}/done") if x.endswith(".json"))[:-RECORDS_KEPT]:
            remove(self.spark, f"{self.root}/done/{old}")


def _with(done: list[list[int]], batch_id: int) -> list[list[int]]:
    """Intervals of ids with one more."""
    out: list[list[int]] = []
    for a, b in sorted([*done, [batch_id, batch_id]]):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out
