"""Keyed random numbers: each draw is a hash of (seed, key, draw, ...), so it is the same on any partitioning and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column) -> Column:
    """In [0, 1), from the first 52 bits of the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def gaussian(*key: Column) -> Column:
    """Standard normal by Box and Muller."""
    u, v = uniform(F.lit("u"), *key), uniform(F.lit("v"), *key)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(F.lit(2 * math.pi) * v)


def exponential(*key: Column) -> Column:
    return -F.log(1.0 - uniform(F.lit("u"), *key))


def seed_of(*key: Column) -> Column:
    """A long for generators inside batch kernels."""
    return F.xxhash64(*key)
