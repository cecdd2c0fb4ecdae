"""Column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The prime of the stream hashes, and of the integer hash used for deterministic draws.
STREAM_PRIME = 1_000_000_007
DRAW_PRIME = 2_147_483_647


def text_mod(text: Column, modulus: int) -> Column:
    """The UTF-8 bytes of text read as one big-endian integer, modulo modulus (below 2**55)."""
    digits = F.hex(F.encode(text, "UTF-8"))
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    value = lambda i: F.instr(F.lit("0123456789ABCDEF"), F.substring(digits, i, F.lit(1))).cast("bigint") - 1
    return F.when(F.length(digits) == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(places, F.lit(0).cast("bigint"), lambda acc, i: (acc * 16 + value(i)) % modulus))


def trailing_zeros(x: Column) -> Column:
    """Zero bits at the end of a binary number; 0 counts as one."""
    return F.when(x == 0, F.lit(1)).otherwise(F.bit_count(x.bitwiseAND(-x) - 1))


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def draw(x: Column, seed: int) -> Column:
    """A repeatable pseudorandom integer below DRAW_PRIME for an integer key."""
    return ((x.cast("bigint") % DRAW_PRIME + DRAW_PRIME) * 48271 + seed) % DRAW_PRIME * 69621 % DRAW_PRIME


def distance(a: Column, b: Column, scale: Column | None = None) -> Column:
    """Euclidean distance of two arrays; scale divides each difference, and a zero in it counts as one."""
    gaps = F.zip_with(a, b, lambda x, y: x - y)
    if scale is not None:
        gaps = F.zip_with(gaps, scale, lambda d, s: d / F.when(s == 0, F.lit(1.0)).otherwise(s))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, d: acc + d * d))
