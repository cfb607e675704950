"""What the corpus operators share: Arrow plumbing and the tokenizer."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows turned into Python objects at once.
_SLICE = 32

#: ASCII white space: the separators of words.
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name: str = "text") -> Column:
    """A text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def _cells(column: pa.Array) -> list:
    """A column's values; lists of whole numbers as numpy arrays."""
    if pa.types.is_list(column.type) and pa.types.is_integer(column.type.value_type) and not column.values.null_count:
        ends, values = column.offsets.to_numpy().tolist(), column.values.to_numpy()
        return [values[a:b] if ok else None for a, b, ok in zip(ends, ends[1:], column.is_valid().to_pylist(), strict=False)]
    return column.to_pylist()


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """A batch's rows; only a few are Python objects at a time."""
    for at in range(0, batch.num_rows, _SLICE):
        yield from zip(*map(_cells, batch.slice(at, _SLICE).columns), strict=True)


def map_rows(frame: DataFrame, work: Callable[..., Iterable[tuple]], schema: str, flush: int = 20000) -> DataFrame:
    """Apply work(*row) to each row, in which lists of whole numbers are numpy arrays; it yields the rows of the result. Holds `flush` results and one row's at most."""
    spark = frame.sparkSession
    target = spark.createDataFrame([], schema).schema
    types = [_arrow_type(f.dataType.simpleString()) for f in target.fields]
    fields = pa.schema([pa.field(f.name, t) for f, t in zip(target.fields, types, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for row in _rows(batch):
                out.extend(work(*row))
                if len(out) >= flush:
                    yield _batch(out, fields)
                    out = []
        if out:
            yield _batch(out, fields)

    return frame.mapInArrow(run, target)


def map_columns(frame: DataFrame, work: Callable[..., tuple | None], schema: str, flush: int = 200_000) -> DataFrame:
    """As map_rows, for many small results: work(*row) gives numpy arrays, one for each column, or None. Holds `flush` results and one row's at most."""
    spark = frame.sparkSession
    target = spark.createDataFrame([], schema).schema
    fields = pa.schema([pa.field(f.name, _arrow_type(f.dataType.simpleString())) for f in target.fields])

    def joined(parts: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t.type) for c, t in zip(zip(*parts, strict=True), fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for row in _rows(batch):
                got = work(*row)
                if got is None or not len(got[0]):
                    continue
                parts.append(got)
                held += len(got[0])
                if held >= flush:
                    yield joined(parts)
                    parts, held = [], 0
        if parts:
            yield joined(parts)

    return frame.mapInArrow(run, target)


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)


def _arrow_type(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow_type(kind[6:-1]))
    return {"bigint": pa.int64(), "int": pa.int32(), "tinyint": pa.int8(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[kind]


def signed(x: int) -> int:
    """An unsigned 64-bit number as Spark's bigint."""
    return x - (1 << 64) if x >> 63 else x


@functools.cache
def byte_tokenizer(path: str):
    """(encode, decode) of a byte-level BPE file of the tokenizers library, for texts to uint32 arrays and back.

    The merges are run by tiktoken, which gives the same ids several times faster, if the file is plain
    byte-level BPE whose ids follow its merges; else by the tokenizers library itself. The latter also encodes texts that tiktoken's
    pattern can't cut: white space of a million characters and more exceeds its stack.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    vocab = model.get("vocab", {})
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("ignore_merges") and not model.get("dropout")
    if plain and all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(text, allowed_special="all" if any(s in text for s in special) else set(), disallowed_special=())
            except ValueError:  # the stack of its pattern
                return _library_tokenizer(path)[0](text)

        return encode, lambda ids: fast.decode_bytes(ids).decode("utf-8", "replace")
    return _library_tokenizer(path)


@functools.cache
def _library_tokenizer(path: str):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    return (lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)), (lambda ids: slow.decode(list(ids), skip_special_tokens=False))
