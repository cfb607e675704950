import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.functions import bits, domains, grids, hashes, inverse
from twinfold.operators.edges import candidate_share, choose_blocks, probe_cuts, probes
from twinfold.sources import requests


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_hex_and_distance(spark):
    assert one(spark, bits.hash_hex(F.lit(-(2**63)))) == "8000000000000000"
    assert one(spark, bits.hash_hex(F.lit(5).cast("bigint"))) == "0000000000000005"
    assert one(spark, bits.hamming(F.lit(0).cast("bigint"), F.lit(-1).cast("bigint"))) == 64
    for h in (0, -1, 2**63 - 1, -(2**63), 1234567890123456789):
        assert one(spark, bits.from_hex(bits.hash_hex(F.lit(h).cast("bigint")))) == h
        assert one(spark, bits.from_base64(bits.hash_base64(F.lit(h).cast("bigint")))) == h
        assert one(spark, bits.pack_bits(F.transform(bits.hash_bits(F.lit(h).cast("bigint")), lambda b: b == 1))) == h


DOMAINS = {
    "  Example.COM ": "example.com", "https://www.Example.com/a?b": "example.com", "www.example.com.": "example.com", "www.www.a.b": "www.a.b", "a_b.com": None,
    "\t a.com\n": "a.com", "\u00a0\ufeffB.org \r": "b.org", "not a url/": None, "example.com/path": None, "example.com:80": None, "a" * 64 + ".com": None, ".".join(["a" * 50] * 5) + "aa": None,
}


def test_domains(spark):
    rows = spark.createDataFrame([(k,) for k in DOMAINS], "d string").select("d", domains.normalize_domain(F.col("d")).alias("n")).collect()
    assert {r.d: r.n for r in rows} == DOMAINS
    assert [one(spark, domains.sort_key(F.lit(d))) for d in ("a.b.c", "a.com.", "com", "", None)] == ["c.b.a", "com.a", "com", "", None]


def test_curve_is_closed_and_whole():
    assert sorted(grids.CURVE) == list(range(64))
    assert grids.CURVE[:8] == [59, 51, 50, 58, 57, 56, 48, 49]
    steps = [(a % 8 - b % 8, a // 8 - b // 8) for a, b in zip(grids.CURVE, grids.CURVE[1:] + grids.CURVE[:1], strict=True)]
    assert all(abs(x) + abs(y) == 1 for x, y in steps)


Y, X = np.mgrid[0:32, 0:32]
GOLDEN = [
    (0 * X, "ffffffffffffffff", "0000000000000000", "7fffffffffffffff"), (0 * X + 128, "ffffffffffffffff", "0000000000000000", "ffffffffffffffff"),
    (8 * X, "7bfdffeffff7ffff", "011a011aac402c40", "7fffffffffffffff"), (8 * Y, "bf7fefffdfeffbfe", "1004100442a1c2a1", "7fffffffffffffff"),
    (4 * (X + Y), "3379efcfdff7fbff", "111e111eeee1eee1", "7fbfefcffcf9f3f7"), (255 * ((X // 4 + Y // 4) % 2), "efd7fabff55fffb7", "5555555555555555", "7ffffffff0f0f0f0"),
    (255 * (X < 16), "fbffffefffffffff", "8000000000000000", "3fffffffffffffff"),
]


def test_golden_hashes(spark):
    pictures = np.array([g[0] for g in GOLDEN], float)
    unsigned = lambda a: [f"{int(x) & (2**64 - 1):016x}" for x in a]
    assert unsigned(hashes.dct_hashes(pictures)) == [g[1] for g in GOLDEN]
    assert unsigned(hashes.wavelet_hashes(pictures)) == [g[3] for g in GOLDEN]
    rows = spark.createDataFrame([(k, p.ravel().tolist()) for k, p in enumerate(pictures)], "k int, grid array<double>")
    for name, col in (("dctHash", 1), ("diffHash", 2), ("waveletHash", 3)):
        got = {r.k: r.h for r in rows.select("k", bits.hash_hex(hashes.image_hash(F.col("grid"), name)).alias("h")).collect()}
        assert [got[k] for k in range(len(GOLDEN))] == [g[col] for g in GOLDEN]
    hashes.register(spark)
    rows.createOrReplaceTempView("pictures")
    for name, col in (("phash_dct", 1), ("phash_diff", 2), ("phash_wavelet", 3)):
        assert [r.h for r in spark.sql(f"SELECT hash_hex({name}(grid)) AS h FROM pictures ORDER BY k").collect()] == [g[col] for g in GOLDEN]
    assert spark.sql("SELECT hamming(0, -1) AS d").first().d == 64
    with pytest.raises(ValueError):
        hashes.image_hash(F.col("grid"), "md5")


def test_a_cosine_that_cancels_counts_as_positive():
    """Whole numbers whose coefficient is zero, which the transform's rounding makes slightly negative for some."""
    cells = np.random.default_rng(1).integers(-500, 500, (2000, 8, 8))
    cells[:, 0, 0] -= (cells * [1, -1, -1, 1, 1, -1, -1, 1]).sum(axis=(1, 2))  # the signs of frequency 4 across, 0 down
    got = hashes.dct_hashes(np.repeat(np.repeat(cells, 4, axis=1), 4, axis=2).astype(float), settled=True)
    at = hashes.DCT_ORDER.index((0, 4)), hashes.DCT_ORDER.index((4, 0))
    assert any((got.view(np.uint64) >> np.uint64(63 - k) & np.uint64(1)).all() for k in at)


def test_transforms_invert():
    x = np.random.default_rng(0).normal(size=(5, 32, 32))
    m = inverse.dct_matrix(32)
    assert np.allclose(hashes.fast_dct(x), x @ m.T)
    assert np.allclose(hashes.inverse_haar(hashes.haar(x)), x)
    assert np.allclose(inverse.inverse_dct(m @ x[0] @ m.T), x[0])
    assert inverse.grayscale(np.ones((2, 2))).tolist() == [[0, 0], [0, 0]]


def test_pictures_show_what_the_bits_tell():
    rnd = np.random.default_rng(1)
    bits = rnd.integers(0, 2, (4, 64))
    signed = np.packbits(bits, axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64)
    waves, cosines = inverse.wavelet_pictures(signed), inverse.dct_pictures(signed)
    assert waves.shape == (4, 8, 8) and cosines.shape == (4, 32, 32)
    for n in range(4):
        half = [0.0 if k == 0 else 1.0 for k in range(8)]
        plain = np.zeros((8, 8))
        for r in range(8):
            for c in range(8):
                w = [1, 0.5, 0.25, 0.25, 0.125, 0.125, 0.125, 0.125][max(r, c)] * (1 if bits[n, 8 * r + c] else -1)
                s = 1 << (max(r, c).bit_length() - 1) if max(r, c) else 1
                side = 8 // s
                y0, x0 = (r % s) * side, (c % s) * side
                for y in range(side):
                    for x in range(side):
                        sign = (-1 if r >= s and max(r, c) and y < side // 2 else 1) * (-1 if c >= s and max(r, c) and x < side // 2 else 1)
                        plain[y0 + y, x0 + x] += w * sign / side
        assert len(half) == 8 and waves[n].tolist() == np.floor((plain - plain.min()) * 255 / (plain.max() - plain.min()) + 0.5).tolist()
        y, k = np.zeros((32, 32)), 0
        for i in range(1, 11):
            for j in range(i + 1):
                if (i, j) != (10, 5):
                    y[j, i - j], k = (1 if bits[n, k] else -1) * np.exp(-i / 3), k + 1
        back = sum(y[v, u] * np.outer(*(np.cos((2 * np.arange(32) + 1) * f * np.pi / 64) * (1 if f else np.sqrt(0.5)) for f in (v, u))) for v in range(11) for u in range(11))
        assert np.abs(cosines[n] - (back - back.min()) * 255 / (back.max() - back.min())).max() <= 0.5 + 1e-6


def test_odd_grids_have_no_fingerprint(spark):
    good, odd = [1.0] * 1024, [1.0] * 1023
    rows = spark.createDataFrame([(0, good), (1, [*odd, float("nan")]), (2, [*odd, float("inf")]), (3, None), (4, odd), (5, [*odd, None])], "k int, grid array<double>")
    for name in hashes.HASH_FUNCTIONS:
        got = {r.k: r.h for r in rows.select("k", hashes.image_hash(F.col("grid"), name).alias("h")).collect()}
        assert got[0] is not None and [got[k] for k in range(1, 6)] == [None] * 5


def test_lookups_find_all_within_the_radius():
    rnd = np.random.default_rng(2)
    for r in range(17):
        for m in {1, 2, 3, 4, 5, 7, 9, r + 1}:
            cuts = probe_cuts(r, m)
            assert len(cuts) == min(m, r + 1)
            for _ in range(200):
                flips = rnd.choice(64, rnd.integers(0, r + 1), replace=False)
                assert any(sum(low <= b < low + width for b in flips) <= reach for low, width, reach in cuts)
    for n, share in ((10**5, 0.02), (10**7, 0.003), (10**9, 0.0005)):
        cuts = probe_cuts(8, choose_blocks(8, n))
        assert probes(cuts) <= 5000 and candidate_share(cuts) < share


def test_shown_size(spark):
    rows = spark.createDataFrame([(300, 100), (100, 300), (128, 5), (0, 0), (129, 127)], "w int, h int")
    assert [tuple(r) for r in rows.select(*grids.shown_size(F.col("w"), F.col("h"))).collect()] == [(128, 42), (42, 128), (128, 5), (0, 0), (128, 126)]


LINKS = {
    "https://a.b/c": "https://a.b/c", "//o.p/q": "https://o.p/q", "/q?x": "https://h.i/q?x", "?y": "https://h.i/d/e?y", "#z": "https://h.i/d/e?f#z", "k/l": "https://h.i/d/k/l", "": "https://h.i/d/e?f", "mailto:x": "mailto:x",
}


def test_links_are_completed(spark):
    rows = spark.createDataFrame([(k,) for k in LINKS], "u string").select("u", domains.resolved(F.col("u"), F.lit("https://h.i/d/e?f#g")).alias("r")).collect()
    assert {r.u: r.r for r in rows} == LINKS
    assert one(spark, domains.resolved(F.lit("x"), F.lit("http://h.i"))) == "http://h.i/x"


DOTTED = {
    "../x": "https://h.i/x", "./x": "https://h.i/d/x", "../../../x": "https://h.i/x", "a/../..": "https://h.i/", ".": "https://h.i/d/", "..": "https://h.i/", "a/./b/../c?q=../r#../s": "https://h.i/d/a/c?q=../r#../s",
    "/a//../b": "https://h.i/a/b", "/a//b": "https://h.i/a//b", "https://a.b": "https://a.b/", "HTTP://a.b/c/%2E%2e/d": "HTTP://a.b/d", "/%2e%2E/%2E": "https://h.i/", "...": "https://h.i/d/...", "https://a.b?x": "https://a.b/?x", "ftp://a/b/../c": "ftp://a/b/../c",
}


def test_dot_segments(spark):
    rows = spark.createDataFrame([(k,) for k in DOTTED], "u string").select("u", domains.resolved(F.col("u"), F.lit("https://h.i/d/e?f#g")).alias("r")).collect()
    assert {r.u: r.r for r in rows} == DOTTED
    assert one(spark, domains.resolved(F.lit(None).cast("string"), F.lit("https://h.i/"))) is None


@pytest.mark.parametrize("work", [hashes.diff_hash, hashes.wavelet_hash])
def test_grids_that_are_not_whole_have_no_fingerprint(spark, work):
    good = [float(k * 37 % 64) for k in range(64)]
    rows = [(0, good), (1, [float("nan")] * 64), (2, [*good[:5], float("nan"), *good[6:]]), (3, [*good[:-1], float("inf")]), (4, [*good[:-1], None]), (5, good[:63]), (6, None), (7, [])]
    got = {r.k: r.h for r in spark.createDataFrame(rows, "k int, g array<double>").select("k", work(F.col("g")).alias("h")).collect()}
    assert got.pop(0) is not None and set(got.values()) == {None}
    whole = spark.createDataFrame([([k * 37 % 64 for k in range(64)],)], "g array<int>").select(work(F.col("g")).alias("h")).first().h
    assert whole == spark.createDataFrame([(good,)], "g array<double>").select(work(F.col("g")).alias("h")).first().h


def png_of(pixels, filters):
    """A PNG file whose rows use the given filters in turn."""
    height, width, channels = pixels.shape
    raw, above = b"", np.zeros(width * channels, int)
    for y in range(height):
        row, kind = pixels[y].reshape(-1).astype(int), filters[y % len(filters)]
        left = np.concatenate([np.zeros(channels, int), row[:-channels]])
        corner = np.concatenate([np.zeros(channels, int), above[:-channels]])
        far = [abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)]
        paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
        raw += bytes([kind]) + ((row - [0 * row, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    packed = zlib.compress(raw)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)) + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_requests_for_images(spark, tmp_path, channels):
    """Files of every row filter decode as Spark's image source decodes them; what fails is told for its row alone."""
    pixels = np.random.default_rng(channels).integers(0, 256, (9, 7, channels))
    data = png_of(pixels, [0, 1, 2, 3, 4])
    root = f"file://{tmp_path}/store"
    urls = {"https://a.b/c/d.png?x=1": data, "https://a.b/cut.png": data[:60], "https://a.b/text": b"hello", "https://a.b/missing": None, "https://a.b/empty": b""}
    for url, content in urls.items():
        if content is not None:
            place = Path(requests.mirrored(root, url).removeprefix("file://"))
            place.parent.mkdir(parents=True, exist_ok=True)
            place.write_bytes(content)
    spark.createDataFrame([(u,) for u in urls] + [(None,)], "fetch_url string").repartition(3).write.parquet(f"file://{tmp_path}/asked")
    got = {r.fetch_url: r for r in requests.requested_images(spark, f"file://{tmp_path}/asked", root).collect()}
    assert set(got) == set(urls) and [u for u in urls if got[u].error is None] == [next(iter(urls))]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "d.png").write_bytes(data)
    same = spark.read.format("image").load(f"file://{tmp_path}/plain").select("image.*").first()
    mine = got["https://a.b/c/d.png?x=1"]
    assert (mine.height, mine.width, mine.nChannels, bytes(mine.data)) == (same.height, same.width, same.nChannels, bytes(same.data))
    spark.createDataFrame([], "fetch_url string").write.parquet(f"file://{tmp_path}/none")
    assert requests.requested_images(spark, f"file://{tmp_path}/none", root).collect() == []


def test_images(spark, tmp_path):
    def png(pixel):
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        raw = b"".join(b"\x00" + bytes(pixel(x, y) for x in range(64)) for y in range(64))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 64, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    from twinfold.sources.items import image_files, image_grids

    (tmp_path / "a.png").write_bytes(png(lambda x, y: 4 * x))
    (tmp_path / "bad.png").write_bytes(b"no picture")
    (tmp_path / "c.txt").write_text("x")
    rows = {r.origin.rsplit("/", 1)[1]: r.grid for r in image_grids(spark, str(tmp_path)).collect() if r.origin.endswith("png")}
    assert len(rows["a.png"]) == 1024 and rows["bad.png"] is None
    assert image_files(spark, str(tmp_path)).count() == 2
