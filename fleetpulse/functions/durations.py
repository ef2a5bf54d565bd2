"""Duration strings, epoch seconds and relative time ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds per duration suffix.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}

_LITERAL = re.compile(r"([+-]?\d+)\s*([smhdw]?)")
_COLUMN_PATTERN = r"^([+-]?\d+)\s*([smhdw]?)$"


def duration_seconds(text: str) -> int:
    """Seconds in a duration literal such as `7d`; a bare integer counts seconds."""
    match = _LITERAL.fullmatch(text.strip().lower())
    if match is None:
        raise ValueError(f"Invalid duration format: {text!r}")
    return int(match.group(1)) * UNIT_SECONDS[match.group(2) or "s"]


def parse_duration(text: Column) -> Column:
    """Column form of `duration_seconds`; text that is no duration gives NULL."""
    clean = F.lower(F.trim(text))
    number = F.regexp_extract(clean, _COLUMN_PATTERN, 1)
    unit = F.regexp_extract(clean, _COLUMN_PATTERN, 2)
    factor = F.when(unit == "", F.lit(1))
    for suffix, seconds in UNIT_SECONDS.items():
        factor = factor.when(unit == suffix, F.lit(seconds))
    return number.try_cast("bigint") * factor


def format_duration(seconds: Column) -> Column:
    """Readable duration: `45s`, `12m`, `3h 20m`, `2d 5h`; a zero second part is left out."""
    whole = seconds.cast("bigint")

    def part(unit: int, modulus: int | None, suffix: str) -> Column:
        base = whole if modulus is None else whole % modulus
        return F.concat(F.floor(base / unit).cast("string"), F.lit(suffix))

    def with_rest(main: Column, modulus: int, unit: int, rest: Column) -> Column:
        return F.when(whole % modulus < unit, main).otherwise(F.concat_ws(" ", main, rest))

    return (
        F.when(whole < 60, F.concat(whole.cast("string"), F.lit("s")))
        .when(whole < 3600, part(60, None, "m"))
        .when(whole < 86400, with_rest(part(3600, None, "h"), 3600, 60, part(60, 3600, "m")))
        .when(whole >= 86400, with_rest(part(86400, None, "d"), 86400, 3600, part(3600, 86400, "h")))
    )


def utc_day(ts: Column) -> Column:
    """UTC calendar day of an epoch second."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / 86400).cast("int"))


def epoch_to_utc(ts: Column) -> Column:
    """Wall-clock time in UTC of an epoch second (a time without zone)."""
    return F.timestamp_seconds(ts).cast("timestamp_ntz")


def epoch_to_local(ts: Column, zone: str) -> Column:
    """Wall-clock time in `zone` of an epoch second (a time without zone)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), epoch_to_utc(ts))


def utc_to_epoch(timestamp: Column) -> Column:
    """Epoch second of a timestamp."""
    return F.unix_seconds(timestamp.cast("timestamp"))


def time_range(samples: DataFrame, duration: str, end_ts: int | None = None) -> tuple[int, int] | None:
    """`[end - duration, end]`, anchored on the newest sample unless `end_ts` is given.

    The anchor is data, not the clock, so a re-run gives the same range. None if there is no sample.
    """
    if end_ts is None:
        end_ts = samples.agg(F.max("ts")).first()[0]
        if end_ts is None:
            return None
    return end_ts - duration_seconds(duration), end_ts
