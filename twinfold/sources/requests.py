"""A data source that answers requests for images from a store that mirrors their hosts.

spark.read.format("image_requests") with the options `requests`, a folder of Parquet files with a column fetch_url, and `root`, the folder in which
https://host/path lies as mirrored() tells. The driver plans a partition for each row group of the requests and reads none of them; tasks fetch
and decode. Rows (fetch_url, height, width, nChannels, data, error): colours as in Spark's image source, or what went wrong with this request.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SCHEMA = "fetch_url string, height int, width int, nChannels int, data binary, error string"
#: Images in a batch of rows.
_BATCH = 64
#: Characters of a file's or folder's name.
_NAME = 200


def mirrored(root: str, url: str) -> str:
    """Where the image of a url lies: in a folder of its host, under all that follows the host, in which all but letters, digits and _.- are written as ~ and two hex digits a byte. No two urls of a scheme share a file.

    One slash before the path is left out, where more follows that tells it from a url without it. Long names go on in a folder, after a +.
    """
    _, host, rest = re.fullmatch(r"([^/?#]*:)?//([^/?#]*)(.*)", url, re.DOTALL).groups()
    plain = lambda s: quote(s, safe="").replace("~", "%7E").replace("%", "~")
    name = plain(rest[1:] if rest[:1] == "/" and rest[1:2] not in ("", "/", "?", "#") else rest) or "~"
    name = name.replace(".", "~2E") if name in (".", "..") else name
    return "/".join([root.rstrip("/"), plain(host), "+/".join(name[k : k + _NAME] for k in range(0, len(name), _NAME))])


def decoded_png(data: bytes) -> tuple[int, int, int, bytes]:
    """(height, width, channels, bytes as blue, green, red and alpha) of a PNG of 8 bits a channel, not interlaced. Other or broken ones raise ValueError."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR" or len(data) < 33:
        raise ValueError("not a PNG image")
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    channels = {0: 1, 2: 3, 6: 4}.get(kind)
    if depth != 8 or not channels or interlaced or not width or not height:
        raise ValueError("unsupported kind of PNG image")
    at, packed = 8, b""
    while at + 12 <= len(data) and data[at + 4 : at + 8] != b"IEND":
        size = struct.unpack(">I", data[at : at + 4])[0]
        packed += data[at + 8 : at + 8 + size] if data[at + 4 : at + 8] == b"IDAT" else b""
        at += size + 12
    try:
        lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    except zlib.error as broken:
        raise ValueError(f"broken PNG image: {broken}") from None
    pixels = np.zeros((height + 1, width + 1, channels), np.int64)  # with a row above and a column to the left of zeros
    for y in range(height):
        row, above, now = lines[y, 1:].reshape(width, channels).astype(np.int64), pixels[y], pixels[y + 1]
        if lines[y, 0] == 0:
            now[1:] = row
        elif lines[y, 0] == 1:
            now[1:] = np.cumsum(row, axis=0) & 255
        elif lines[y, 0] == 2:
            now[1:] = row + above[1:] & 255
        else:
            for x in range(1, width + 1):
                left, up, corner = now[x - 1], above[x], above[x - 1]
                if lines[y, 0] == 3:
                    guess = left + up >> 1
                else:
                    far = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
                    guess = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
                now[x] = row[x - 1] + guess & 255
    colours = pixels[1:, 1:].astype(np.uint8)
    return height, width, channels, (colours if channels == 1 else colours[..., [2, 1, 0, 3][:channels]]).tobytes()


@dataclass
class _Requests(InputPartition):
    path: str
    group: int


class ImageRequests(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_requests"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.requests, self.root = options["requests"], options["root"]

    def partitions(self) -> list[InputPartition]:
        store, base = pafs.FileSystem.from_uri(self.requests)
        files = [f.path for f in store.get_file_info(pafs.FileSelector(base, recursive=True)) if f.path.endswith(".parquet")]
        return [_Requests(f, k) for f in files for k in range(pq.ParquetFile(store.open_input_file(f)).num_row_groups)] or [_Requests("", 0)]

    def read(self, partition: _Requests) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = pafs.FileSystem.from_uri(self.requests)
        urls = pq.ParquetFile(store.open_input_file(partition.path)).read_row_group(partition.group, columns=["fetch_url"]).column(0)
        images, _ = pafs.FileSystem.from_uri(self.root)
        fields = pa.schema([("fetch_url", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("data", pa.binary()), ("error", pa.string())])
        for at in range(0, len(urls), _BATCH):
            rows = [self._answer(images, u) for u in urls.slice(at, _BATCH).to_pylist() if u is not None]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), fields, strict=True)] if rows else [pa.array([], t.type) for t in fields], schema=fields)

    def _answer(self, store: pafs.FileSystem, url: str) -> tuple:
        try:
            _, path = pafs.FileSystem.from_uri(mirrored(self.root, url))
            with store.open_input_stream(path) as file:
                return (url, *decoded_png(file.read()), None)
        except (OSError, ValueError) as failed:
            return (url, None, None, None, None, f"{type(failed).__name__}: {failed}")


def requested_images(spark: SparkSession, requests: str, root: str) -> DataFrame:
    """The images that a folder of requests names, a row for each request that isn't null."""
    spark.dataSource.register(ImageRequests)
    return spark.read.format("image_requests").option("requests", requests).option("root", root).load()
