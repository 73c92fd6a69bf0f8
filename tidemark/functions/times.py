"""Dates in texts and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy/MM/dd", "yyyy.MM.dd", "yyyy-MM-dd", "yy/MM/dd", "yyyyMMdd")


def parse_date(c: Column) -> Column:
    """The first format that fits, else epoch seconds or milliseconds in range; null for all else."""
    text = F.trim(c.cast("string"))
    n = F.when(text.rlike("^[0-9]{10,13}$"), text.try_cast("bigint"))
    seconds = F.when(n > 100_000_000_000, (n / 1000)).otherwise(n.cast("double"))
    number = F.timestamp_seconds(F.when((seconds >= 946_684_800) & (seconds < 4_102_444_800), seconds))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS], number)


def epoch_iso(c: Column) -> Column:
    """Local ISO text of epoch seconds; null for null and 0 or less."""
    return F.when(c > 0, F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss"))


def within_days(ts: Column, asof: Column, days: int) -> Column:
    """Whole elapsed days at most `days`: less than days + 1 days ago."""
    return ts > asof - F.make_dt_interval(F.lit(days + 1))


def within_hours(ts: Column, asof: Column, hours: float) -> Column:
    return ts >= asof - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0).cast("decimal(18,6)"))


def due(next_at: Column, asof: Column) -> Column:
    """Never scheduled, or the time has come."""
    return next_at.isNull() | (next_at <= asof)
