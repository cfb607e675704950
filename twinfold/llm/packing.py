"""Best-fit packing of token pieces into fixed-size sequences.

An item asks for tokens, one document slot and an attention cost (its length squared). Items are
taken by falling length; each goes to the open sequence that can take it under every capacity and
scores best, by weighted dot product of demand and residual or by the residual's weighted norm.
Lengths are far fewer than items: for each length the open sequences are scored at once, then a heap
serves that length's items one by one, which gives the same choices as scoring anew for every item.

Items are dealt evenly into groups, whatever their ids, so no key, source or long document makes a hot
task, nor do null or repeated ids; a group packs alone and leaves at most a few sequences partly filled. A piece as long as a sequence
gets its own at once and is never held, so a group holds a document's one shorter piece and no more.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import byte_tokenizer, map_rows

#: Documents in a packing group; more make the groups larger and the loss at their ends smaller.
GROUP_DOCS = 200_000


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds. The last two bind no packing by tokens alone: no more documents than tokens, and squares sum to no more than the square."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    score: str = "norm"


def best_fit(lengths: np.ndarray, cap: Capacities) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each item. Items of equal length are taken in the order given."""
    if cap.score not in ("norm", "dot"):
        raise ValueError(f"score: {cap.score}")
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and (lengths.max() > cap.tokens or lengths.min() < 0 or cap.documents < 1 or int(lengths.max()) ** 2 > cap.attention):
        raise ValueError("an item exceeds a sequence's capacities")
    size = np.array([cap.tokens, cap.documents, cap.attention], float)
    weights = np.array(cap.weights, float)
    left = np.empty((max(16, len(lengths)), 3), np.int64)
    used, sequence, offset = 0, np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    open_bins = np.empty(0, np.int64)
    for run in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
        need = np.array([lengths[run[0]], 1, lengths[run[0]] ** 2], np.int64)

        def score(rest: np.ndarray, need: np.ndarray = need) -> np.ndarray:  # lower is better
            if cap.score == "dot":
                return -((rest / size) * (need / size) * weights).sum(axis=-1)
            return (weights * ((rest - need) / size) ** 2).sum(axis=-1)

        fits = open_bins[(left[open_bins] >= need).all(axis=1)]
        heap = sorted(zip(score(left[fits]).tolist(), fits.tolist(), strict=True))
        for item in run.tolist():
            if heap:
                b = heapq.heappop(heap)[1]
            else:
                b, used = used, used + 1
                left[b] = size
            sequence[item], offset[item] = b, cap.tokens - left[b, 0]
            left[b] -= need
            if (left[b] >= need).all():
                heapq.heappush(heap, (float(score(left[b])), b))
        least = max(1, int(lengths[order[-1]]))
        open_bins = np.flatnonzero((left[:used] >= (least, 1, least * least)).all(axis=1))
    return sequence, offset


def token_pieces(docs: DataFrame, tokenizer_path: str, eos: int | None = 2, max_len: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids]). Only documents over max_len are cut; all pieces but the first have max_len tokens.

    A null text counts as empty; without eos an empty one gives no piece, an empty table none either. Null and repeated ids are kept as they are, rows
    of one id are documents of their own. A very long text is encoded whole, in one task, white space of any length included. Other columns are ignored, whatever their names.
    """
    kind = dict(docs.dtypes)[id_col]

    def work(doc, text: bytes):
        ids = byte_tokenizer(tokenizer_path)[0](text.decode("utf-8", "replace"))
        if eos is not None:
            ids = np.append(ids, np.uint32(eos))
        data = ids.astype("<u4").tobytes()
        at, end, piece = 0, len(ids) % max_len or min(max_len, len(ids)), 0
        while at < len(ids):
            yield (doc, piece, at, end - at, zlib.crc32(data[4 * at : 4 * end]), *([ids[at:end].tolist()] if with_ids else []))
            at, end, piece = end, end + max_len, piece + 1

    schema = f"{id_col} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return map_rows(docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).cast("binary")), work, schema, flush=2000 if with_ids else 20000)


def pack(pieces: DataFrame, n_docs: int, cap: Capacities | None = None, id_col: str = "doc_id", group_docs: int = GROUP_DOCS) -> DataFrame:
    """Add sequence_id and offset to pieces, which need the columns id, piece, start and length; others come along as they are, but those two names.

    n_docs sizes the packing groups only. Null and repeated ids are kept; pieces of equal length are taken by id (null last), piece and start, and
    rows that are equal in all of these by the other columns' place. No pieces give no rows. A piece longer than a sequence is an error.
    """
    cap = cap or Capacities()
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(*(F.col(f"`{c}`") for c in names))
    schema = pieces.limit(0).select("*", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).schema

    def placed(rows: pa.Table, sequence: np.ndarray, offset: np.ndarray) -> Iterator[pa.RecordBatch]:
        done = rows.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        yield from done.to_batches(max_chunksize=20000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, alone, short = TaskContext.get().partitionId() << 40, 1 << 39, []
        for batch in batches:
            full = pc.equal(batch.column("length"), cap.tokens)
            short.append(batch.filter(pc.invert(full)))
            whole = pa.Table.from_batches([batch.filter(full)])
            if whole.num_rows:
                if cap.tokens**2 > cap.attention or cap.documents < 1:
                    raise ValueError("an item exceeds a sequence's capacities")
                yield from placed(whole, np.arange(whole.num_rows, dtype=np.int64) + (first + alone), np.zeros(whole.num_rows, np.int64))
                alone += whole.num_rows
        if sum(b.num_rows for b in short):
            rows = pa.Table.from_batches(short).combine_chunks()
            rows = rows.take(pc.sort_indices(rows.select(["length", id_col, "piece", "start"]), [("length", "descending"), (id_col, "ascending"), ("piece", "ascending"), ("start", "ascending")]))
            sequence, offset = best_fit(rows.column("length").to_numpy(), cap)
            yield from placed(rows, sequence + first, offset)

    groups = max(1, math.ceil(n_docs / group_docs))
    return pieces.repartition(groups).mapInArrow(run, schema)  # dealt in turn, in the order of the rows' hashes, so a task that is run again deals alike
