"""BPE encoding with reuse of content-defined chunks.

A rolling hash over the text puts chunk ends where the last bytes say so, hence the same passage is
cut alike in every document. Chunks that several documents share are encoded once, by one task, and
their ids joined back; all others are encoded where they are read. Which chunks may be shared is known from a
bounded Bloom filter of chunk hashes seen in at least two documents; a false hit only costs a join row.

Joining chunks exactly: a white-space character after a character that is none always starts a
pre-token, whatever stands around it, so encoding may be split there. Each chunk keeps its text
before the first and after the last such place, and the ids between; where two chunks meet, the
texts between the nearest such places are encoded again as one. A chunk with no such place joins the
pending text, and the repair reaches on until it finds one. What comes out is what encoding the whole
text gives.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.bloom import Filter, bits_for, repeated_filter
from twinfold.llm.common import byte_tokenizer, map_rows
from twinfold.plans.storage import Scratch, row_keyed

#: A chunk's mean length in bytes is 2 ** CHUNK_BITS; none is longer than MAX_CHUNK.
CHUNK_BITS, MAX_CHUNK, MIN_CHUNK = 11, 1 << 16, 256

#: White space by Python's rule is more than by the tokenizer's, so the second part names plain ones.
_SAFE = re.compile(r"(?<=\S)[ \t\n\r]")


def chunk_ends(data: bytes) -> list[int]:
    """Ends of content-defined chunks of UTF-8 bytes, on character borders. Ends depend on the 32 bytes before them, and on MIN_CHUNK and MAX_CHUNK."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = np.frombuffer(data, np.uint8).astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    h ^= h >> np.uint32(15)
    for width in (1, 2, 4, 8, 16):  # a rolling hash of 32 bytes by doubling
        h = h[:-width] * np.uint32(pow(0x85EBCA6B, width, 1 << 32)) + h[width:]
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    ends, last = [], 0
    for end in (np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + 32).tolist() + [n]:
        while end - last > MAX_CHUNK:
            cut = last + MAX_CHUNK
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
            ends.append(cut)
            last = cut
        if end - last >= MIN_CHUNK or end == n:
            while end < n and data[end] & 0xC0 == 0x80:
                end += 1
            if end > last:
                ends.append(end)
                last = end
    return ends


def _split(text: str) -> tuple[str, str | None, str]:
    """(head, body, tail) around the first and the last safe place; body is None without one."""
    first = _SAFE.search(text)
    if not first:
        return text, None, ""
    a = first.start()
    b = a
    for m in _SAFE.finditer(text, max(a, len(text) - 256)):
        b = m.start()
    if b == a and len(text) - a > 256:
        for m in _SAFE.finditer(text, a):
            b = m.start()
    return text[:a], text[a:b], text[b:]


def _stored(ids: np.ndarray) -> bytes:
    """Two bytes an id where they do; the first byte says."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"2" if small else b"4") + ids.astype("<u2" if small else "<u4").tobytes()


def _restored(body: bytes) -> np.ndarray:
    return np.frombuffer(body, "<u2" if body[:1] == b"2" else "<u4", offset=1).astype(np.uint32)


def encoded_chunk(text: str, encode) -> tuple[str, bytes | None, str]:
    head, body, tail = _split(text)
    return head, None if body is None else _stored(encode(body)), tail


def joined(parts, encode) -> np.ndarray:
    """The ids of the text whose encoded chunks these are, in order."""
    out, pending = [], ""
    for head, body, tail in parts:
        pending += head
        if body is None:
            continue
        out += [encode(pending), _restored(body)]
        pending = tail
    return np.concatenate([*out, encode(pending)]) if out else encode(pending)


def digests(ids: np.ndarray, decode) -> tuple[int, str, str]:
    told = ",".join(map(str, ids.tolist()))
    return len(ids), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(decode(ids).encode("utf-8", "surrogatepass")).hexdigest()


def _chunks(data: bytes):
    at = 0
    for end in chunk_ends(data):
        yield data[at:end]
        at = end


def encode_documents(docs: DataFrame, tokenizer_path: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", finish=digests, result: str = "n_tokens bigint, ids_sha256 string, decoded_sha256 string", bloom_bits: int | None = None) -> DataFrame:
    """Rows (id, *finish(ids, decode)), one per input row; by default the ids' number, their digest and that of the decoded text.

    A null or empty text has no ids. Null and repeated ids give a row each; other columns are ignored, whatever their names; an empty table gives no rows.
    A very long text is encoded chunk by chunk, and its ids are joined in one task, white space of any length included. bloom_bits: the filter's size; by default it follows the table's.
    """
    own = row_keyed(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")), "id", scratch)
    kind = dict(own.dtypes)["id"]
    keyed = own.select("row_key", "id", "text")

    def hashes(text: bytes):
        return {xxhash.xxh3_64_intdigest(c) for c in _chunks(text)}

    shared = repeated_filter(keyed.select("text"), hashes, bloom_bits or bits_for(keyed.select("text"), 256))
    several = docs.sparkSession.sparkContext.broadcast(shared.twice)
    fields = "row_key bigint, id " + kind

    def look(key, doc, text: bytes):
        """A finished row if nothing may be shared, else a row per run of own chunks and per shared chunk."""
        encode, decode = byte_tokenizer(tokenizer_path)
        twice = Filter(several.value)
        found = [(c, xxhash.xxh3_128_digest(c), xxhash.xxh3_64_intdigest(c) in twice) for c in _chunks(text)]
        if not any(f for _, _, f in found):
            yield (key, doc, 0, None, None, None, None, None, *finish(encode(text.decode("utf-8", "replace")), decode))
            return
        run: list[bytes] = []
        none = (None,) * n_result
        for k, (chunk, h, hit) in enumerate([*found, (b"", None, True)]):
            if not hit:
                run.append(chunk)
                continue
            if run:
                head, body, tail = encoded_chunk(b"".join(run).decode("utf-8", "replace"), encode)
                yield (key, doc, k * 2, None, head, body, tail, None, *none)
                run = []
            if h:
                yield (key, doc, k * 2 + 1, h, None, None, None, chunk, *none)

    n_result = len(result.split(","))
    looked = map_rows(keyed, look, f"{fields}, at int, h binary, head string, body binary, tail string, chunk binary, {result}", flush=2000)
    looked = scratch.save(looked, "looked")
    names = [x.split()[0] for x in result.split(",")]
    done = looked.where(F.col(names[0]).isNotNull()).select("id", *names)

    # each shared chunk once, whatever the number of its copies
    texts = looked.where("h is not null").groupBy("h").agg(F.first("chunk").alias("chunk"))

    def once(h, chunk: bytes):
        yield (h, *encoded_chunk(chunk.decode("utf-8", "replace"), byte_tokenizer(tokenizer_path)[0]))

    once_each = map_rows(texts, once, "h binary, head string, body binary, tail string", flush=2000)
    parts = looked.where("h is not null").select("row_key", "id", "at", "h").join(once_each, "h").drop("h")
    parts = parts.unionByName(looked.where(f"h is null and {names[0]} is null").select("row_key", "id", "at", "head", "body", "tail"))
    whole = parts.groupBy("row_key").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("at", "head", "body", "tail"))).alias("parts"))

    def join(doc, heads, bodies, tails):
        encode, decode = byte_tokenizer(tokenizer_path)
        yield (doc, *finish(joined(zip(heads, bodies, tails, strict=True), encode), decode))

    repaired = map_rows(whole.select("id", "parts.head", "parts.body", "parts.tail"), join, f"id {kind}, {result}", flush=2000)
    return done.unionByName(repaired).withColumnRenamed("id", id_col)
