"""Deterministic pseudo-random numbers from md5, equal on every engine and every partitioning."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIGITS = 13
HASH_RANGE = 16**HASH_DIGITS  # 2**52: every value is exact in a double


def hash_number(*parts: Column | str | int) -> Column:
    """A whole number in [0, 2**52) that depends only on the given values."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("bigint")


def hash_value(*parts: str | int) -> int:
    """`hash_number` of plain values, worked out where it is called."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:HASH_DIGITS], 16)


def hash_uniform(low: float, high: float, *parts: Column | str | int) -> Column:
    """A number in [low, high) that depends only on the given values."""
    return F.lit(float(low)) + F.lit(float(high - low)) * (hash_number(*parts) / F.lit(float(HASH_RANGE)))
