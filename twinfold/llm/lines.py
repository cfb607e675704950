"""Line dedup with two Bloom filters.

The filters of once-seen and twice-seen line hashes are made in one pass without a shuffle. In the
second pass only documents with a line that may repeat leave their partition, and only such lines are
counted, by their whole key. A line that very many documents hold is combined on the map side.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.bloom import Filter, bits_for, repeated_filter
from twinfold.llm.common import WHITE, map_rows
from twinfold.plans.storage import Scratch, row_keyed


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The stripped, ASCII-lower-cased line, if it has enough code points."""
    key = line.strip(WHITE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def kept_text(text: bytes, drop: set[bytes], min_chars: int) -> tuple[bytes, int, int]:
    """(remaining text, lines, dropped lines)."""
    lines = text.split(b"\n")
    if not drop:
        return text, len(lines), 0
    kept = [x for x in lines if line_key(x, min_chars) not in drop]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, min_chars: int = 40, keep: str = "largest", bloom_bits: int | None = None, with_text: bool = False) -> DataFrame:
    """Rows (id, n_lines, n_dropped, kept_sha256[, kept_text]), one per input row.

    Keys of min_chars code points or more in at least min_docs documents lose all their lines but those
    of the document with the largest (or smallest) id; there all stay. A null or empty text is one empty line.
    Null ids rank lowest; rows with a repeated id are documents of their own, equal rows too. Other columns are ignored, whatever their names; an empty table
    gives no rows. A very long text is one row of one task. bloom_bits: the filters' size; by default it follows the table's.
    """
    if min_docs < 2 or keep not in ("largest", "smallest"):
        raise ValueError("min_docs: 2 or more; keep: largest or smallest")
    own = row_keyed(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")), "id", scratch)
    kind = dict(own.dtypes)["id"]

    def keys(text: bytes) -> set[bytes]:
        return {k for k in (line_key(x, min_chars) for x in text.split(b"\n")) if k is not None}

    def hashes(text: bytes) -> set[int]:
        return {xxhash.xxh3_64_intdigest(k) for k in keys(text)}

    seen = docs.sparkSession.sparkContext.broadcast(repeated_filter(own.select("text"), hashes, bloom_bits or bits_for(own.select("text"), 32)).twice)
    extra = ", kept_text string" if with_text else ""
    result = f"n_lines bigint, n_dropped bigint, kept_sha256 string{extra}"

    def told(text: bytes, drop: set[bytes]):
        left, n, gone = kept_text(text, drop, min_chars)
        return (n, gone, hashlib.sha256(left).hexdigest(), *([left.decode("utf-8", "replace")] if with_text else []))

    def suspects(text: bytes) -> list[bytes]:
        found = list(keys(text))
        if not found:
            return []
        hit = Filter(seen.value).many(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))
        return [k for k, h in zip(found, hit.tolist(), strict=True) if h]

    def look(key, doc, text: bytes):
        maybe = suspects(text)
        if maybe:
            yield (key, doc, text, maybe, *(None,) * len(result.split(",")))
        else:
            yield (key, doc, None, None, *told(text, set()))

    looked = scratch.save(map_rows(own.select("row_key", "id", "text"), look, f"row_key bigint, id {kind}, text binary, keys array<binary>, {result}", flush=1000), "looked")
    names = [x.split()[0] for x in result.split(", ")]
    lines = looked.where("keys is not null").select("row_key", F.explode("keys").alias("key"))
    holder = F.max if keep == "largest" else F.min
    common = scratch.save(lines.groupBy("key").agg(F.count("*").alias("n"), holder("row_key").alias("keeper")).where(F.col("n") >= min_docs), "common")
    drops = lines.join(common, "key").where("row_key <> keeper").groupBy("row_key").agg(F.collect_list("key").alias("drop"))

    def apply(doc, text: bytes, drop):
        yield (doc, *told(text, set(drop or ())))

    left = looked.where("keys is not null").select("row_key", "id", "text").join(drops, "row_key", "left")
    changed = map_rows(left.select("id", "text", "drop"), apply, f"id {kind}, {result}", flush=1000)
    return looked.where("keys is null").select("id", *names).unionByName(changed).withColumnRenamed("id", id_col)
