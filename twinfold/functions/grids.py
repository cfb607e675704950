"""Luminance grids: nearest-neighbour sampling, block means, normalization, and the closed curve through 8 x 8 cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nearest(n: int, size: int) -> np.ndarray:
    """Source index of each of `size` samples over n: floor((2 i + 1) n / (2 size))."""
    return (2 * np.arange(size) + 1) * n // (2 * size)


def luminance(image: dict | None, size: int = 32) -> np.ndarray | None:
    """(size, size) plain means of the colours of a row of Spark's image source; fully transparent pixels are black; null for a broken image."""
    if image is None or image["data"] is None or image["width"] < 1 or image["height"] < 1 or image["nChannels"] not in (1, 3, 4):
        return None
    h, w, c = (int(image[x]) for x in ("height", "width", "nChannels"))
    pixels = np.frombuffer(bytes(image["data"]), np.uint8).reshape(h, w, c)[nearest(h, size)][:, nearest(w, size)].astype(np.float64)
    mean = pixels[..., : min(c, 3)].mean(axis=2)
    return np.where(pixels[..., 3] == 0, 0.0, mean) if c == 4 else mean


def hilbert_curve(order: int) -> np.ndarray:
    """Cells of the Hilbert curve in 2^order x 2^order, from (0, 0) along the axis to (2^order - 1, 0)."""
    path = np.zeros((1, 2), np.int64)
    for k in range(order):
        side = 1 << k
        turned = path[:, ::-1]
        path = np.concatenate([turned, path + (0, side), path + side, (2 * side - 1, side - 1) - turned])
    return path


def moore_curve(order: int) -> np.ndarray:
    """Cells (x, y), y downwards, of the closed curve of four Hilbert curves: up the left half in two of them, and down the right half, which is the left one turned by 180 degrees."""
    side = 1 << order - 1
    along, away = hilbert_curve(order - 1).T
    quarter = np.stack([side - 1 - away, side - 1 - along], axis=1)
    left = np.concatenate([quarter + (0, side), quarter])
    return np.concatenate([left, 2 * side - 1 - left])


#: The 64 cells of order 3 as x + 8 y.
CURVE = [x + 8 * y for x, y in moore_curve(3).tolist()]


def text_grid(text: str | None, size: int = 32) -> np.ndarray:
    """(size, size) whole means of a text's UTF-8 bytes: every byte is in one of size^2 equal stretches, or of a shorter text each byte in several; null or empty gives zeros."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    if not len(data):
        return np.zeros((size, size))
    ends = np.arange(size * size + 1) * len(data) // (size * size)
    start, end = ends[:-1], np.maximum(ends[1:], ends[:-1] + 1)
    sums = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
    return ((sums[end] - sums[start]) // (end - start)).astype(np.float64).reshape(size, size)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def text_picture(text: pd.Series) -> pd.Series:
    """Whole texts as 32 x 32 grids."""
    return pd.Series([text_grid(t).ravel() for t in text], dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def enlarged(grid8: pd.Series) -> pd.Series:
    """8 x 8 values, in whole thousandths, as 32 x 32 grids of 4 x 4 equal cells."""
    good = grid8.notna().to_numpy()
    if not good.any():
        return pd.Series([None] * len(grid8), dtype=object)
    cells = np.floor(np.stack(grid8[good].to_numpy()).astype(np.float64) * 1000 + 0.5).reshape(-1, 8, 8)
    large = iter(np.repeat(np.repeat(cells, 4, axis=1), 4, axis=2).reshape(len(cells), -1))
    return pd.Series([next(large) if g else None for g in good], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def gray_image(image: pd.DataFrame) -> pd.Series:
    """Images of Spark's image source as 32 x 32 gray levels, rounded half up; null for a broken one."""
    grids = [luminance(row) for row in image.to_dict("records")]
    return pd.Series([None if g is None else np.floor(g + 0.5).astype(np.int32).ravel() for g in grids], dtype=object)


def block_means(grid: Column, size: int = 32, blocks: int = 8) -> Column:
    """Means of the square blocks of a row-major grid, row-major. The grid's expression is evaluated once a row."""
    side = size // blocks
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, v: a + v)

    def means(g: Column) -> Column:
        # sums of runs of `side` cells, then of the runs below one another
        runs = F.transform(F.sequence(F.lit(0), F.lit(size * blocks - 1)), lambda r: total(F.slice(g, r * side + 1, F.lit(side))))
        return F.transform(F.array(runs), lambda t: F.transform(F.sequence(F.lit(0), F.lit(blocks * blocks - 1)), lambda b: block(t, b)))[0]

    def block(runs: Column, b: Column) -> Column:
        first = F.floor(b / blocks).cast("int") * (side * blocks) + F.pmod(b, F.lit(blocks))
        parts = [F.get(runs, first + k * blocks) for k in range(side)]
        return sum(parts[1:], parts[0]) / (side * side)

    return F.get(F.transform(F.array(grid), means), F.lit(0))


def gray_levels(values: Column) -> Column:
    """Values scaled so that they span 0 to 255, rounded half up; equal values give 0."""
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda v: F.coalesce(F.floor(F.try_divide((v - low) * 255, high - low) + 0.5).cast("int"), F.lit(0)))


def shown_size(width: Column, height: Column, bound: int = 128) -> tuple[Column, Column]:
    """Width and height, scaled down to the bound with the shape kept; one that fits stays as it is."""
    scale = F.try_divide(F.lit(float(bound)), F.greatest(width, height))
    fits = F.greatest(width, height) <= bound
    return tuple(F.when(fits, side).otherwise(F.floor(side * scale)).cast("int") for side in (width, height))
