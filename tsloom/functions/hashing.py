"""Reproducible draws: uniforms and orders from MD5, the same in any engine and for any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts: Column | str | int) -> Column:
    """parts as text, joined by colons."""
    return F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def order(*parts: Column | str | int) -> Column:
    """A text whose order is a seeded permutation of the keys."""
    return F.md5(key(*parts))


def uniform(*parts: Column | str | int) -> Column:
    """52 bits of the hash as a double in [0, 1)."""
    return F.conv(F.substring(order(*parts), 1, 13), 16, 10).cast("double") / F.pow(F.lit(2.0), F.lit(52.0))


def normal(*parts: Column | str | int) -> Column:
    """A standard normal by Box and Muller."""
    return F.sqrt(-2.0 * F.log(1.0 - uniform(*parts, "r"))) * F.cos(2.0 * math.pi * uniform(*parts, "a"))


def digits(c: Column, n: int = 6) -> Column:
    """Rounded as SQL engines round doubles, and never minus zero: to whole numbers after scaling; as it is where that overflows."""
    c, scale = c.cast("double"), F.lit(10.0**n)
    r = F.round(c * scale, 0) / scale
    return F.when(F.abs(r) < math.inf, r).otherwise(c) + F.lit(0.0)
