"""64-bit fingerprints as bigint columns; the first bit is bit 63."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fingerprints of blank images, never matched: fixed values.
BLANK = (0, -(2**63), 2**63 - 1, -1)


def hash_hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def from_hex(text: Column) -> Column:
    """The fingerprint that 16 hex digits tell."""
    high, low = (F.conv(F.substring(text, k, 8), 16, 10).cast("bigint") for k in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def hash_base64(h: Column) -> Column:
    return F.base64(F.unhex(F.lpad(F.hex(h), 16, "0")))


def from_base64(text: Column) -> Column:
    return from_hex(F.hex(F.unbase64(text)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pack_bits(bits: Column) -> Column:
    """64 booleans, first one highest."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(F.when(b, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))


def hash_bits(h: Column) -> Column:
    return F.transform(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), lambda i: F.getbit(h, i).cast("int"))


def is_blank(h: Column) -> Column:
    return h.isin(*BLANK)


def hex_diff(a: Column, b: Column) -> Column:
    """Positions, from 1, at which two hex texts differ."""
    return F.filter(F.sequence(F.lit(1), F.lit(16)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))


def hash_bitmap(h: Column, other: Column | None = None) -> Column:
    """64 RGB pixels: set bits black, others white; where the other fingerprint differs, dark red and red."""
    if other is None:
        return F.transform(hash_bits(h), lambda b: F.when(b == 1, F.array(F.lit(0), F.lit(0), F.lit(0))).otherwise(F.array(F.lit(255), F.lit(255), F.lit(255))))
    pair = F.arrays_zip(hash_bits(h).alias("p"), hash_bits(other).alias("q"))
    rgb = lambda r, g, b: F.array(F.lit(r), F.lit(g), F.lit(b))
    return F.transform(pair, lambda x: F.when(x["p"] == x["q"], F.when(x["p"] == 1, rgb(0, 0, 0)).otherwise(rgb(255, 255, 255))).otherwise(F.when(x["p"] == 1, rgb(127, 0, 0)).otherwise(rgb(255, 0, 0))))
