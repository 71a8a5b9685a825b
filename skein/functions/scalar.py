"""Scalar expressions: integer helpers, hashing steps, great circles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The earth's radius in km, the page size, the congruential generator.
EARTH_KM, PAGE, LCG_A, LCG_C = 6371.0, 4096, 1103515245, 12345


def abs_diff(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def sign_diff(a: Column, b: Column) -> Column:
    return (a > b).cast("int")


def saturating_subtract(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0).cast("long"))


def bytes_of_bits(n: Column) -> Column:
    return F.floor((n + 7) / 8)


def bit_length(n: Column) -> Column:
    """Bits of a positive integer."""
    return F.length(F.bin(n)).cast("long")


def page_of_bit(offset: Column) -> Column:
    return F.shiftright(offset, 15)


def lcg_next(n: Column, mask: int) -> Column:
    return (n * LCG_A + LCG_C).bitwiseAND(F.lit(mask))


def lcg_at(k: Column, mask: int) -> Column:
    """The generator's ``k``-th value from 0 on, for ``k`` up to ``mask``: one step for every bit of ``k``, so a sequence needs no walk."""
    x, a, c = F.lit(0).cast("long"), LCG_A & mask, LCG_C & mask
    for bit in range(mask.bit_length()):
        on = F.shiftright(k, bit).bitwiseAND(F.lit(1)) == 1
        x = (x * F.when(on, a).otherwise(1) + F.when(on, c).otherwise(0)).bitwiseAND(F.lit(mask))
        a, c = a * a & mask, (a * c + c) & mask
    return x


def bit_reverse(x: Column) -> Column:
    """The 64 bits of a long in reverse order."""
    text = F.reverse(F.lpad(F.bin(x), 64, "0"))
    part = lambda at: F.conv(F.substring(text, at, 32), 2, 10).cast("long")
    return F.shiftleft(part(1), 32).bitwiseOR(part(33))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance; angles in radians."""
    a = F.pow(F.sin((lat2 - lat1) / 2), F.lit(2)) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), F.lit(2))
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))
