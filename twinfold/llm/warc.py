"""WARC archives: a writer with revisit records, and a splittable reader.

Archives are files of gzip members, one per record. The reader's tasks take byte ranges: each looks
for the gzip magic from its start, takes a candidate for a member if its first bytes inflate to a
WARC header, and owns every record that starts inside its range; a record may end beyond it.
Damaged members, and responses whose payload doesn't have the digest that their header tells, are passed over by the same search.

Files are opened with pyarrow's file systems by URI, so any store that they reach will do.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.plans.storage import Scratch, join_facts, row_keyed

MAGIC = b"\x1f\x8b\x08"

#: Bytes of an archive that a reading task owns, of a file that is so long.
SPLIT_BYTES = 8 << 20

#: Bytes of ranges that a task reads one after another, when there are more.
TASK_BYTES = 64 << 20

_MANIFEST = "path string, bytes bigint, records bigint"
_FIELDS = "record_id string, record_type string, target_uri string, refers_to_id string, payload_bytes bigint, payload_digest string, payload binary, at bigint"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record(record_id: str, kind: str, uri: str, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """A response, or a revisit that leaves the payload out; its HTTP header still tells the length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join(uri.split())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def parsed(data: bytes) -> dict | None:
    """A record's fields; None if it is no whole record, or a response with another payload than its digest tells. Length and digest of a response are those of the payload read;
    a revisit has no payload, and tells them of the response it refers to."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    if not fields.get("content-length", "").isdigit() or len(rest) < int(fields["content-length"]):
        return None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, told = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    size, digest = len(payload), told
    if kind == "revisit":
        sizes = [v.strip() for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.strip().lower() == b"content-length"]
        size = int(sizes[0]) if sizes and sizes[0].isdigit() else len(payload)
    else:
        digest = sha1_base32(payload)
        if told and told != digest:
            return None
    return {
        "record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "refers_to_id": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload_bytes": size, "payload_digest": digest, "payload": None if kind == "revisit" else payload,
    }


class _Bytes:
    """A file's bytes by position, read in blocks; keeps no more than it has been asked for."""

    def __init__(self, file, size: int, block: int = 1 << 18):
        self.file, self.size, self.block, self.base, self.data = file, size, block, 0, b""

    def take(self, at: int, n: int) -> bytes:
        if at < self.base or at + n > self.base + len(self.data):
            self.file.seek(at)
            self.base, self.data = at, self.file.read(max(n, self.block))
        return self.data[at - self.base : at - self.base + n]


def _inflated(source: _Bytes, at: int, limit: int | None = None) -> tuple[bytes, int] | None:
    """(content, end) of the member at a place, or with a limit its first bytes; None if it isn't one."""
    inflate, out, place = zlib.decompressobj(31), [], at
    had = 0
    while not inflate.eof:
        data = source.take(place, min(1 << 16 if limit is None else 512, source.size - place))
        if not data:
            return (b"".join(out), place) if limit is not None and had else None
        try:
            got = inflate.decompress(data, limit or 0)
        except zlib.error:
            return None
        place += len(data)
        out.append(got)
        had += len(got)
        if limit is not None and (had >= min(limit, 7) or inflate.eof):
            return b"".join(out), place
    return b"".join(out), place - len(inflate.unused_data)


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """(place, fields) of the records that start in [start, end)."""
    source, at = _Bytes(file, size), start
    while at < end:
        if source.take(at, 3) != MAGIC:
            step = source.take(at, min(1 << 16, size - at))
            hit = step.find(MAGIC, 1)
            at += hit if hit > 0 else max(1, len(step) - 2)
            continue
        first = _inflated(source, at, 16)
        whole = _inflated(source, at) if first and first[0].startswith(b"WARC/1.") else None
        fields = parsed(whole[0]) if whole else None
        if fields is None:
            at += 1
            continue
        yield at, fields
        at = whole[1]


def write_archives(records: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Write rows (record_id, record_type, target_uri, payload, payload_digest, refers_to_id) to folder, a file for each partition that has rows; gives (path, bytes, records).

    Each attempt of a task writes a file of its own, and the table lists those of the attempts that count, so nothing is renamed or written over.
    A null uri or payload counts as empty; columns are taken by name, others are ignored; an empty table gives no files. A record is held whole, one at a time.
    """
    records = records.select("record_id", "record_type", "target_uri", "payload", "payload_digest", "refers_to_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, size, out = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0, None
        store, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for rid, kind, uri, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = member(record(rid, kind, uri or "", payload or b"", digest, refers))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([n])], names=["path", "bytes", "records"])

    return scratch.save(records.mapInArrow(write, _MANIFEST), "manifest")


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the files (path, bytes): one row each, with the place where its member starts. Files of any size are split into ranges; no files give no rows.

    Payloads are bytes as they are; a record without an id, uri or type has an empty or null one. A record is held whole, whatever its length.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FIELDS.split(", ")]
        types = [pa.int64() if " bigint" in x else pa.binary() if " binary" in x else pa.string() for x in _FIELDS.split(", ")]

        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, inner = pafs.FileSystem.from_uri(path)
                rows: list[dict] = []
                held = 0
                with store.open_input_file(inner) as file:
                    for at, fields in records_in(file, size, start, min(size, start + split_bytes)):
                        rows.append(fields | {"at": at})
                        held += len(fields["payload"] or b"")
                        if len(rows) >= 256 or held > 16 << 20:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    ranges = files.select("path", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split_bytes}L)")).alias("start"))
    total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    tasks = max(1, math.ceil(total["b"] / max(split_bytes, TASK_BYTES)), min(math.ceil(total["b"] / split_bytes) + total["n"], 256))
    return ranges.repartition(tasks).mapInArrow(read, _FIELDS)


def with_revisits(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Records to write for pages: of equal payloads (by 256 bits of SHA-2) of at least min_bytes, the smallest id's is the response and the others revisit it.

    A null payload counts as empty, a null uri too. Null ids rank last; rows with repeated ids are records of their own, equal rows too. Other columns are ignored,
    whatever their names; an empty table gives no records.
    A record's id is urn:x-page:<id>, URL-encoded if it is no integer, with :row:<number> after it if row numbers stand in for the table's ids; a null id's is urn:x-row:<number>.
    """
    own = row_keyed(pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("target_uri"), F.coalesce(F.col(text_col), F.lit("")).alias("html")), "id", scratch, nulls_last=True)
    facts = own.select("row_key", "id", F.octet_length("html").alias("n"), F.unhex(F.sha2(F.col("html").cast("binary"), 256)).alias("same"))
    first = facts.groupBy("same").agg(F.min("row_key").alias("first"), F.min_by("id", "row_key").alias("first_id"))
    revisit = (F.col("first") != F.col("row_key")) & (F.col("n") >= min_bytes)
    # only keys and digests meet by payload; the payloads then join by their own rows' keys, of which none is hot
    told = join_facts(facts, first, ["same"]).select("row_key", revisit.alias("revisit"), "first", "first_id")
    linked = own.join(told, "row_key").withColumn("sha1", F.unhex(F.sha1(F.col("html").cast("binary"))))
    revisit = F.col("revisit")
    whole = dict(own.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint")

    def urn(page: Column, row: Column) -> Column:
        shown = page.cast("string") if whole else F.url_encode(page.cast("string"))
        same = page == row if whole else F.lit(False)
        return F.when(page.isNull(), F.concat(F.lit("urn:x-row:"), row)).when(same, F.concat(F.lit("urn:x-page:"), shown)).otherwise(F.concat(F.lit("urn:x-page:"), shown, F.lit(":row:"), row))

    return linked.select(
        urn(F.col("id"), F.col("row_key")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.col("html").cast("binary").alias("payload"), _base32(F.col("sha1")).alias("payload_digest"), F.when(revisit, urn(F.col("first_id"), F.col("first"))).alias("refers_to_id"),
    )


def _base32(digest):
    """Base 32 of 20 bytes, eight 5-bit digits from each 5 bytes."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    words = [F.conv(F.substring(F.hex(digest), 10 * k + 1, 10), 16, 10).cast("bigint") for k in range(4)]
    return F.concat(*(F.substring(letters, F.shiftright(w, 35 - 5 * j).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for w in words for j in range(8)))
