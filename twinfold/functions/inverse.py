"""From fingerprints back to pictures: what the cosine and the wavelet hash have kept."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions.hashes import DCT_ORDER, fast_dct, haar, inverse_haar


def dct_matrix(n: int) -> np.ndarray:
    """Orthonormal: row k is the cosine of frequency k."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos((2 * x + 1) * k * np.pi / (2 * n)) * np.sqrt(2 / n)
    m[0] = np.sqrt(1 / n)
    return m


def inverse_dct(coefficients: np.ndarray) -> np.ndarray:
    """Of (..., n, n) coefficients."""
    m = dct_matrix(coefficients.shape[-1])
    return m.T @ coefficients @ m


def _bits(hashes: np.ndarray) -> np.ndarray:
    """(n, 64) bits, the first one highest."""
    return np.unpackbits(np.asarray(hashes, ">i8").view(np.uint8).reshape(-1, 8), axis=1)


def grayscale(values: np.ndarray) -> np.ndarray:
    """Each grid of (..., n, n) rounded half up to 0 .. 255; equal values give 0."""
    low, high = values.min(axis=(-2, -1), keepdims=True), values.max(axis=(-2, -1), keepdims=True)
    flat = high == low
    return np.where(flat, 0, np.floor((values - low) * 255 / np.where(flat, 1, high - low) + 0.5)).astype(int)


def dct_pictures(hashes: np.ndarray, size: int = 32) -> np.ndarray:
    """(n, size, size) pictures of cosine fingerprints: coefficients of falling size with the signs that the bits tell."""
    y = np.zeros((len(hashes), size, size))
    across, down = np.array(DCT_ORDER).T
    y[:, down, across] = np.where(_bits(hashes) == 1, 1, -1) * np.exp(-(across + down) / 3)
    return grayscale(inverse_dct(y))


def wavelet_pictures(hashes: np.ndarray, size: int = 8) -> np.ndarray:
    """(n, size, size) pictures of wavelet fingerprints; the corner of 8 x 8 coefficients holds all that the bits tell, so that is the usual size."""
    weight = np.array([1, 0.5, 0.25, 0.25, 0.125, 0.125, 0.125, 0.125])
    y, x = np.mgrid[0:8, 0:8]
    m = np.zeros((len(hashes), size, size))
    m[:, :8, :8] = np.where(_bits(hashes).reshape(-1, 8, 8) == 1, 1, -1) * weight[np.maximum(x, y)]
    return grayscale(np.round(inverse_haar(m) * size, 6))


def _pictured(column: pd.Series, work) -> pd.Series:
    good = column.notna().to_numpy()
    pictures = iter(work(column[good].to_numpy(np.int64)).reshape(int(good.sum()), -1).astype(np.int32) if good.any() else ())
    return pd.Series([next(pictures) if g else None for g in good], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def dct_visual(h: pd.Series) -> pd.Series:
    return _pictured(h, dct_pictures)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def wavelet_visual(h: pd.Series) -> pd.Series:
    return _pictured(h, wavelet_pictures)


def _restored(column: pd.Series, work) -> pd.Series:
    grids = np.stack(column.to_numpy()).astype(np.float64).reshape(len(column), 32, 32)
    return pd.Series(list(np.floor(work(grids) + 0.5).astype(np.int32).reshape(len(column), -1)), dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def haar_restored(grid: pd.Series) -> pd.Series:
    """32 x 32 grids transformed and back, to whole numbers."""
    return _restored(grid, lambda g: inverse_haar(haar(g)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def haar_corner(grid: pd.Series) -> pd.Series:
    """The 8 x 8 corner of the Haar coefficients of 32 x 32 grids, each over its scale: four times as fine as the sums and differences of 8 x 8 block means."""
    return pd.Series(list(np.floor(haar(np.stack(grid.to_numpy()).astype(np.float64).reshape(-1, 32, 32))[:, :8, :8] * 8 + 0.5).astype(np.int32).reshape(len(grid), -1)), dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def haar_smoothed(grid: pd.Series) -> pd.Series:
    """32 x 32 grids transformed, the 4 x 4 corner of the coefficients kept and the others left out, and back: four times the means of 8 x 8 blocks."""
    return _restored(grid, lambda g: 4 * inverse_haar(np.where(np.add.outer(np.arange(32) >= 4, np.arange(32) >= 4), 0.0, haar(g))))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def dct_restored(grid: pd.Series) -> pd.Series:
    return _restored(grid, lambda g: inverse_dct(np.swapaxes(fast_dct(np.swapaxes(fast_dct(g), 1, 2)), 1, 2)))
