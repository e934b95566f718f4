"""Wall-clock timestamps; no result depends on the session time zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def wall_clock(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def parse_ts(c: Column, formats: Sequence[str] = ()) -> Column:
    """ISO text, then each given format; null when nothing fits."""
    tries = [c.try_cast("timestamp_ntz")]
    tries += [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)


def day(c: Column) -> Column:
    return F.to_date(c)


def days_between(end: Column, start: Column) -> Column:
    """Whole 24-hour days from start to end, rounded down."""
    end, start = wall_clock(end), wall_clock(start)
    clock = lambda t: t - F.to_date(t).cast("timestamp_ntz")
    return F.datediff(end, start) - F.when(clock(end) < clock(start), 1).otherwise(0)


def literal_ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")
