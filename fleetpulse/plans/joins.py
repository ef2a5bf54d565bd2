"""Joining rows to a table keyed by host without gathering a hot host in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(
    rows: DataFrame, lookup: DataFrame, on: list[str], spread: str = "sample_id", salts: int = SALTS
) -> DataFrame:
    """Left-join `rows` to `lookup` (one row per key) on `on` plus a salt.

    A small lookup is still turned into a broadcast by adaptive execution, which measures it at run
    time. A large one is copied `salts` times, so a hot key is spread over that many tasks.
    """
    copies = lookup.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return salted.join(copies, [*on, "salt"], "left").drop("salt")
