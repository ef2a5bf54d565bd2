"""Fixed-point text of doubles with one rounding rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int) -> Column:
    """`floor(v * 10**digits + 0.5) / 10**digits`, all in doubles."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5).cast("double") / scale


def fixed_point(value: Column, digits: int) -> Column:
    """Text of `value` with `digits` decimals, rounded before it is formatted."""
    return F.format_string(f"%.{digits}f", round_half_up(value, digits))
