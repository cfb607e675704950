"""The three perceptual fingerprints.

The difference hash and the wavelet hash of an 8 x 8 grid are column expressions; the cosine hash, and
the wavelet hash of a 32 x 32 grid, run as Arrow UDFs on whole batches of grids.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions.bits import pack_bits
from twinfold.functions.grids import CURVE, block_means

HASH_FUNCTIONS = ("dctHash", "diffHash", "waveletHash")


def _once(grid: Column, work) -> Column:
    """work(grid), with the grid's expression evaluated once a row however often work names it."""
    return F.get(F.transform(F.array(grid), work), F.lit(0))


def is_whole(grid: Column, cells: int) -> Column:
    """Whether a grid has all its cells, and in each a number: neither null nor NaN nor infinite."""
    odd = F.exists(grid, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return grid.isNotNull() & (F.size(grid) == cells) & ~odd


def diff_hash(grid8: Column) -> Column:
    """Bit k: whether the value rises from the cell before to cell k, along the closed curve. Null for a grid that isn't whole."""
    steps = list(zip([CURVE[-1], *CURVE[:-1]], CURVE, strict=True))
    return _once(grid8, lambda g: F.when(is_whole(g, 64), pack_bits(F.array(*(F.get(g, F.lit(a)) < F.get(g, F.lit(b)) for a, b in steps)))))


def haar_parts(values: list) -> list:
    """Coefficients, without their positive scales, of the full transform of an 8 x 8 grid of anything that adds: rows, then columns, of the corner left by the level before."""
    grid = [values[8 * y : 8 * y + 8] for y in range(8)]
    size = 8
    while size > 1:
        half = size // 2
        for y in range(size):
            row = grid[y]
            low = [row[2 * k] + row[2 * k + 1] for k in range(half)]
            grid[y] = low + [row[2 * k + 1] - row[2 * k] for k in range(half)] + row[size:]
        for x in range(size):
            col = [grid[y][x] for y in range(size)]
            for k in range(half):
                grid[k][x], grid[half + k][x] = col[2 * k] + col[2 * k + 1], col[2 * k + 1] - col[2 * k]
        size = half
    return [v for row in grid for v in row]


def wavelet_hash(grid8: Column) -> Column:
    """Signs of the Haar coefficients of an 8 x 8 grid, row-major; zero counts as positive. Exact for grids of whole numbers; null for a grid that isn't whole."""
    return _once(grid8, lambda g: F.when(is_whole(g, 64), pack_bits(F.array(*(c >= 0 for c in haar_parts([F.get(g, F.lit(k)) for k in range(64)]))))))


def fast_dct(x: np.ndarray) -> np.ndarray:
    """Orthonormal cosine transform (type II) along the last axis of 2^k values, by even and odd halves.

    The order of operations keeps what cancels exactly zero, which a product with the cosine matrix would not.
    """
    n = x.shape[-1]

    def halves(v: np.ndarray) -> np.ndarray:
        size = v.shape[-1]
        if size == 1:
            return v
        half = size // 2
        a, b = v[..., :half], v[..., ::-1][..., :half]
        turn = np.array([0.5 / math.cos((2 * k + 1) * math.pi / (2 * size)) for k in range(half)])
        even, odd = halves(a + b), halves((a - b) * turn)
        out = np.empty_like(v)
        out[..., 0::2] = even
        out[..., 1:-1:2] = odd[..., :-1] + odd[..., 1:]
        out[..., -1] = odd[..., -1]
        return out

    out = halves(np.asarray(x, np.float64))
    out[..., 0] *= math.sqrt(1 / n)
    out[..., 1:] *= math.sqrt(2 / n)
    return out


#: (horizontal, vertical) frequencies of the 64 bits: diagonals 1 to 10, without one cell of the last.
DCT_ORDER = [(i - j, j) for i in range(1, 11) for j in range(i + 1) if (i, j) != (10, 5)]

#: The least coefficient of each bit that is zero but for rounding: a millionth before the transform's scale.
_DCT_LEAST = [-1e-6 * math.sqrt(1 / 32 if u == 0 else 2 / 32) * math.sqrt(1 / 32 if v == 0 else 2 / 32) for u, v in DCT_ORDER]


def _signed(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u8")[:, 0].astype(np.uint64).view(np.int64)


def dct_hashes(grids: np.ndarray, settled: bool = False) -> np.ndarray:
    """Fingerprints of (n, 32, 32) grids. A coefficient that cancels may come out as a rounding error, whose sign is that of the reference's order of operations; settled: it counts as positive, as zero does."""
    rows = fast_dct(grids - 128.0)[..., :11]
    both = fast_dct(np.swapaxes(rows, 1, 2))[..., :11]
    return _signed(np.stack([both[:, u, v] >= (least if settled else 0) for (u, v), least in zip(DCT_ORDER, _DCT_LEAST, strict=True)], axis=1))


def haar(grid: np.ndarray) -> np.ndarray:
    """Orthonormal Haar transform of (..., n, n) values; the detail is right minus left."""
    out, scale = np.array(grid, np.float64), math.sqrt(0.5)
    size = out.shape[-1]
    while size > 1:
        for axis in (-1, -2):
            part = np.moveaxis(out[..., :size, :size], axis, -1)
            left, right = part[..., 0::2].copy(), part[..., 1::2].copy()
            part[..., : size // 2], part[..., size // 2 :] = (left + right) * scale, (right - left) * scale
        size //= 2
    return out


def inverse_haar(grid: np.ndarray) -> np.ndarray:
    out, scale = np.array(grid, np.float64), math.sqrt(0.5)
    size = 2
    while size <= out.shape[-1]:
        for axis in (-2, -1):
            part = np.moveaxis(out[..., :size, :size], axis, -1)
            low, detail = part[..., : size // 2].copy(), part[..., size // 2 :].copy()
            part[..., 0::2], part[..., 1::2] = (low - detail) * scale, (low + detail) * scale
        size *= 2
    return out


def wavelet_hashes(grids: np.ndarray) -> np.ndarray:
    """Fingerprints of (n, 32, 32) grids of means, from sums of three colours less 384."""
    return _signed((haar(grids * 3 - 384.0)[:, :8, :8] >= 0).reshape(len(grids), 64))


def _batched(column: pd.Series, work) -> pd.Series:
    """work() on the grids that are whole; null ones, and those with a value that is no number, have no fingerprint."""
    good = np.array([g is not None and len(g) == 1024 and bool(np.isfinite(np.asarray(g, np.float64)).all()) for g in column], bool)
    out = pd.Series([None] * len(column), dtype="Int64")
    if good.any():
        out[good] = work(np.stack(column[good].to_numpy()).astype(np.float64).reshape(-1, 32, 32))
    return out


@F.pandas_udf(T.LongType())
def dct_hash(grid: pd.Series) -> pd.Series:
    return _batched(grid, dct_hashes)


@F.pandas_udf(T.LongType())
def dct_hash_settled(grid: pd.Series) -> pd.Series:
    """As dct_hash, but what is zero but for rounding counts as positive."""
    return _batched(grid, lambda g: dct_hashes(g, settled=True))


@F.pandas_udf(T.LongType())
def wavelet_hash32(grid: pd.Series) -> pd.Series:
    return _batched(grid, wavelet_hashes)


def image_hash(grid: Column, function: str) -> Column:
    """The named fingerprint of a 32 x 32 grid; null for a null grid or one with a value that is no number.

    A grid made by nested lambdas must be written out before the two Arrow fingerprints: over those, Spark does not always extract a Python UDF.
    """
    if function == "dctHash":
        return dct_hash(grid)
    if function == "waveletHash":
        return wavelet_hash32(grid)
    if function == "diffHash":
        return F.when(is_whole(grid, 1024), diff_hash(block_means(grid)))
    raise ValueError(f"unknown hash function: {function}")


def register(spark: SparkSession) -> None:
    """Make the fingerprints SQL functions: hamming and hash_hex are plain SQL, which the optimizer sees through; phash_dct, phash_dct_settled, phash_diff and phash_wavelet take 32 x 32 grids."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hamming(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count(a ^ b)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hash_hex(h BIGINT) RETURNS STRING RETURN lower(lpad(hex(h), 16, '0'))")
    spark.udf.register("phash_dct", dct_hash)
    spark.udf.register("phash_dct_settled", dct_hash_settled)
    spark.udf.register("phash_wavelet", wavelet_hash32)
    spark.udf.register("phash_diff", diff_hash32)


def diff_hashes(grids: np.ndarray) -> np.ndarray:
    """Difference fingerprints of (n, 32, 32) grids. Cells are added in the order of block_means(), so that rounding gives the same bits."""
    v = grids.reshape(-1, 8, 4, 8, 4)
    runs = v[..., 0] + v[..., 1] + v[..., 2] + v[..., 3]
    cells = (runs[:, :, 0] + runs[:, :, 1] + runs[:, :, 2] + runs[:, :, 3]).reshape(-1, 64)[:, CURVE] / 16
    return _signed(np.roll(cells, 1, axis=1) < cells)


@F.pandas_udf(T.LongType())
def diff_hash32(grid: pd.Series) -> pd.Series:
    return _batched(grid, diff_hashes)
