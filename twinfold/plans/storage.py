"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing a table and reading it again, so a lost
executor costs a task retry and never a recomputation of earlier rounds.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: What the innermost released() of this thread or context deletes at its end; None outside of any.
_inside: contextvars.ContextVar[list[Scratch] | None] = contextvars.ContextVar("inside", default=None)

#: Rows and bytes that a written stage hands to Python at once; rows may hold long texts, so fewer than Spark's own 10,000.
_WRITING = {_CLEANUP: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

#: Bytes that a join of a written stage may broadcast without being told to. Spark goes by the size of compressed files before what is exploded from them, and holds
#: tables of several joins in the driver at once, so its own 10 MB may be hundreds of MB there.
_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": 256 << 10, "spark.sql.adaptive.autoBroadcastJoinThreshold": 256 << 10}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a local one only if the setting is absent and Spark runs in one process."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="twinfold-")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def _place(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of a name in any store that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    store, target = _place(spark, path)
    store.delete(target, True)


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    store, target = _place(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(target)) if store.exists(target) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, seen whole or not at all: written under another name first. An older file of the name is replaced."""
    store, target = _place(spark, path)
    _, draft = _place(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = store.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if store.exists(target):
        store.delete(target, False)
    if not store.rename(draft, target):
        raise OSError(f"{path} could not be written")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    store, target = _place(spark, path)
    data = store.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(data)).decode()
    finally:
        data.close()


@contextlib.contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings that hold for what is run inside; the caller's own come back at the end."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(spark: SparkSession):
    """As a context: stages run inside hand few rows to Python at once, broadcast little, and shuffle files that only their making needed go with their end. A lower limit of the session on what is broadcast holds."""
    told = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    own = -1 if told.startswith("-") else spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(told)
    return session_settings(spark, _WRITING | {k: str(min(own, v)) for k, v in _BROADCAST.items()})


def small_files(spark: SparkSession):
    """As a context: what is read inside are very many small files, of which a task takes thousands. By Spark's own 4 MB for opening one, a task would take 32."""
    return session_settings(spark, {"spark.sql.files.openCostInBytes": str(16 << 10)})


class Scratch:
    """Tables of one operator run, below the shared folder. As a context manager it deletes them at its end; else they last until the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/twinfold-{uuid.uuid4().hex}"
        if (inside := _inside.get()) is not None:
            inside.append(self)
        atexit.register(self.clear)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        """Write a table and read it again. Shuffle files that only its making needed go with the end of the write."""
        path = self.folder(name)
        with written(self.spark):
            frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables of save() that nothing reads any more."""
        for frame in frames:
            self.delete(frame._scratch_path)

    def delete(self, path: str) -> None:
        remove(self.spark, path)

    def clear(self) -> None:
        """Delete all tables."""
        atexit.unregister(self.clear)
        try:
            if self.spark.sparkContext._jsc is not None:
                self.delete(self.root)
        except Exception as failed:  # the session may be gone by then
            del failed


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Delete the tables of every Scratch that this thread makes inside, at the end: what they were made for must be written by then.

    Tables that other threads write meanwhile, such as those of a stream, are theirs and stay.
    """
    made: list[Scratch] = []
    token = _inside.set(made)
    try:
        yield
    finally:
        _inside.reset(token)
        for scratch in made:
            scratch.clear()


def row_keyed(frame: DataFrame, id_col: str, scratch: Scratch, key: str = "row_key", nulls_last: bool = False) -> DataFrame:
    """Add a bigint key that no two rows share and whose order is that of the ids.

    Unique integer ids serve as they are. Null, repeated or other ids get numbers in a table written
    once, so that every later read sees the same ones. Rows of one id are ordered by a hash of the row and their
    place in the input, so that however many have the same id (or none), they are dealt to many tasks.
    """
    if dict(frame.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint"):
        odd = frame.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull())
        if odd.isEmpty():
            return frame.withColumn(key, F.col(id_col).cast("bigint"))
    order = F.col(id_col).asc_nulls_last() if nulls_last else F.col(id_col).asc_nulls_first()
    ties = [F.col("_row_hash"), F.col("_row_place")]
    told = frame.withColumns({"_row_hash": F.xxhash64(*(F.col(f"`{c}`") for c in frame.columns)), "_row_place": F.monotonically_increasing_id()})
    return scratch.save(told.repartitionByRange(order, *ties).sortWithinPartitions(order, *ties).drop("_row_hash", "_row_place").withColumn(key, F.monotonically_increasing_id()), "keyed")


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with the facts of their keys, where facts were aggregated by these keys; no key is null.

    Joined plainly, the aggregate's own partitioning would serve the join too, and the rows of a hot key could not
    be split. Here both sides are dealt by another form of the keys for this join alone, so adaptive execution can split a
    hot key's rows.
    """
    kind = dict(rows.dtypes)[keys[0]]
    if len(keys) == 1 and kind == "bigint":
        key = F.bitwise_not(keys[0])
    elif len(keys) == 1 and kind in ("string", "binary"):
        key = F.concat(F.lit("=" if kind == "string" else b"="), F.col(keys[0]))
    else:
        key = F.struct(*keys)
    wide = facts.select(key.alias("_facts_key"), *[c for c in facts.columns if c not in keys])
    return rows.withColumn("_facts_key", key).join(wide, "_facts_key", how).drop("_facts_key")
