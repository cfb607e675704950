"""Content-defined anchors of a sequence of bytes or words, and which windows each anchor stands for.

Every position has a hash of the k symbols from it. The anchor of a place p is the position with the
smallest hash among p .. p + span - 1, the leftmost of equals. It depends on the symbols from p to
p + span + k - 2 only, so wherever the same symbols stand, the same anchor is chosen (winnowing). The
windows with one anchor are neighbours: an anchor stands for an interval of window starts.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash

_BLOCK, _HASHED = 1 << 20, 1 << 18
_MUL = 0x9E3779B97F4A7C15
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) >> np.uint64(29))


@dataclass(frozen=True)
class Plan:
    """Windows of `window` symbols ("bytes" or "words"); anchors are `gram` symbols, chosen in every `span` positions. sizes: how finely windows are told apart, from the span down to 1."""

    unit: str
    window: int
    gram: int
    span: int
    sizes: tuple[int, ...]

    def __post_init__(self):
        if self.unit not in ("bytes", "words") or self.span + self.gram - 1 > self.window or self.span >= 1 << 15 or self.sizes[0] != self.span or self.sizes[-1] != 1 or any(a % b for a, b in zip(self.sizes, self.sizes[1:], strict=False)):
            raise ValueError(f"{self}")


def grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of k symbols from each position; k is a power of two. Doubling: two neighbours of k / 2 make one of k."""
    h, width = symbols, 1
    while width < k:
        h = h[:-width] * np.uint64(pow(_MUL, width, 1 << 64)) + h[width:]
        width *= 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)


def _smallest(packed: np.ndarray, span: int) -> np.ndarray:
    width = 1
    while width * 2 <= span:
        packed = np.minimum(packed[:-width], packed[width:])
        width *= 2
    rest = span - width
    return np.minimum(packed[: len(packed) - rest], packed[rest:]) if rest else packed


def packed_place(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An anchor's position and its first and last window start as one number: all columns of a shuffled row take eight bytes."""
    return (s << 32) | ((s - a) << 16) | (b - a)


def place_of(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(s, a, b) again."""
    s = packed >> 32
    a = s - ((packed >> 16) & 0xFFFF)
    return s, a, a + (packed & 0xFFFF)


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    up = np.full(size, _MUL, np.uint64)
    down = np.full(size, pow(_MUL, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Sequence:
    """One text as symbols."""

    def __init__(self, text: bytes, plan: Plan):
        self.plan = plan
        if plan.unit == "words":
            words = text.split()
            self.data = b" ".join(words)
            self.n = len(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, self.n) + 1)
            self.ends = (ends - 1).tolist()
            self.starts = [0, *ends.tolist()]
            self._words = words
        else:
            self.data, self.n = text, len(text)
        self.view = memoryview(self.data)

    @functools.cached_property
    def symbols(self) -> np.ndarray:
        """A number for each symbol."""
        return np.frombuffer(self.data, np.uint8) if self.plan.unit == "bytes" else np.fromiter(map(xxhash.xxh3_64_intdigest, self._words), np.uint64, self.n)

    @property
    def bounds(self) -> Callable[[int, int], tuple[int, int]]:
        """Of symbols a .. b - 1, their first and last byte in view; equal symbols have equal bytes."""
        if self.plan.unit == "bytes":
            return lambda a, b: (a, b)
        starts, ends = self.starts, self.ends
        return lambda a, b: (starts[a], ends[b - 1])

    def part(self, a: int, b: int) -> memoryview:
        x, y = self.bounds(a, b)
        return self.view[x:y]

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the symbols a .. b - 1 for each a and b, both ascending: equal strings have equal ones, wherever they are; others seldom. Block by block, so a long text needs no more memory."""
        out = np.empty(len(a), np.uint64)
        for k in range(0, int(a[-1]) + 1 if len(a) else 0, _HASHED):
            some = slice(*np.searchsorted(a, (k, k + _HASHED)))
            if some.start == some.stop:
                continue
            x, y = a[some] - k, b[some] - k
            part = self.symbols[k : k + int(y.max())]
            h = _BYTE[part] if self.plan.unit == "bytes" else part
            up, down = _powers(1 << max(12, len(h).bit_length()))
            sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum((h ^ (h >> np.uint64(29))) * down[: len(h)], out=sums[1:])
            h = (sums[y] - sums[x]) * up[x] + (y - x).astype(np.uint64)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out[some] = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        return out

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, first place, last place), over all places with a whole span."""
        span, k = self.plan.span, self.plan.gram
        places = self.n - span - k + 2
        found, first = [], []
        for lo in range(0, max(0, places), _BLOCK):
            hi = min(lo + _BLOCK, places)
            part = self.symbols[lo : hi + span + k - 2]
            h = grams(_BYTE[part] if self.plan.unit == "bytes" else part, k)
            packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(lo, lo + len(h), dtype=np.uint64)
            at = (_smallest(packed, span) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            new = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
            if found and found[-1][-1] == at[0]:
                new = new[1:]
            found.append(at[new])
            first.append(new + lo)
        if not found:
            empty = np.empty(0, np.int64)
            return empty, empty, empty
        s, a = np.concatenate(found), np.concatenate(first)
        return s, a, np.concatenate([a[1:] - 1, [places - 1]])

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors that stand for whole windows: (positions, first and last window start)."""
        s, a, b = self.anchors()
        last = self.n - self.plan.window
        keep = a <= last
        return s[keep], a[keep], np.minimum(b[keep], last)

    def places(self) -> np.ndarray:
        """windows() as one number each, see packed_place()."""
        return packed_place(*self.windows())
