"""Volume tiers and schedules. Times are relative to columns or an `asof` given by the caller, never the wall clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, HOUR = 86_400, 3_600


def volume_tier(v: Column, hot_min: int = 5) -> Column:
    """Null and negative are unknown; 0 is confirmed."""
    return F.when(v.isNull() | (v < 0), "unknown").when(v == 0, "cold").when(v >= hot_min, "hot").otherwise("warm")


def scan_priority(v: Column, hot: int = 5, warm: int = 3) -> Column:
    """Reclassification uses 5 and 3, back-filling 10 and 3."""
    n = F.coalesce(v, F.lit(0))
    return F.when(n >= hot, "hot").when(n >= warm, "warm").otherwise("cold")


def refresh_tier(v: Column, hot_min: int = 5) -> Column:
    return F.when(F.coalesce(v, F.lit(0)) >= hot_min, "hot").otherwise("cold")


def check_interval(v: Column, matched: Column, hot_min: int = 5) -> Column:
    """Seconds to the next regular check: at once, 30 or 90 days for zero (matched or not), 7 days, 3 days when hot."""
    days = F.when(v.isNull() | (v < 0), 0).when(v == 0, F.when(matched, 30).otherwise(90)).when(v >= hot_min, 3).otherwise(7)
    return days * DAY


def hash_offset(seed: Column, base_seconds: Column, ratio: float = 0.10) -> Column:
    """base * ratio * [-1, 1] by the seed's SHA-256: the same for the same seed."""
    unit = F.conv(F.substring(F.sha2(seed, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    base = base_seconds.cast("double")
    return F.when(base <= 0, 0.0).otherwise(base * ((unit * 2.0 - 1.0) * F.lit(ratio)))


def next_check_seconds(product_id: Column, v: Column, matched: Column) -> Column:
    base = check_interval(v, matched)
    return base + hash_offset(product_id.cast("string"), base)


def quarantine_seconds(product_id: Column, error_class: Column, base_days: int = 90) -> Column:
    base = F.lit(base_days * DAY)
    return base + hash_offset(F.concat(F.lit("quarantine:v1:"), product_id.cast("string"), F.lit(":"), error_class), base)


def retry_backoff(attempts: Column) -> Column:
    """Seconds: 6 hours, 24 hours, then 7 days."""
    return F.when(attempts <= 1, 6 * HOUR).when(attempts == 2, 24 * HOUR).otherwise(7 * DAY)


def pull_forward(current: Column, candidate: Column) -> Column:
    """The earlier; a null one gives way."""
    return F.least(current, candidate)


def scan_ttl(priority: Column, profitable: Column, hours: tuple[int, int, int] = (2, 6, 24)) -> Column:
    """Hours to the next scan by priority, halved (1 at least) for profitable products."""
    h = F.when(priority == "hot", hours[0]).when(priority == "warm", hours[1]).otherwise(hours[2])
    return F.when(profitable, F.greatest(F.lit(1), F.floor(h / 2).cast("int"))).otherwise(h)


def research_days(attempts: Column) -> Column:
    """Days to the next search after an attempt: 7, 30, null (dormant) from the third."""
    n = attempts + 1
    return F.when(n >= 3, F.lit(None).cast("int")).when(n == 2, 30).otherwise(7)


def cache_ttl(outcome: Column) -> Column:
    """Hours a scan result is kept: no match 24, match 6, profit 2."""
    return F.when(outcome == "profit", 2).when(outcome == "match", 6).otherwise(24)


def volume_spike(prev: Column, cur: Column, ratio: float = 2.0, from_zero: int = 3) -> Column:
    """Ratio with two decimals where it is a spike, infinite from zero, null else."""
    r = F.bround(cur.cast("double") / F.nullif(prev, F.lit(0)).cast("double"), 2)
    return F.when((prev == 0) & (cur >= from_zero), F.lit(float("inf"))).when((prev > 0) & (cur.cast("double") / F.nullif(prev, F.lit(0)).cast("double") >= ratio), r)


def watcher_spike(prev_price: Column, price: Column, prev_volume: Column, volume: Column, delta: float = 0.05, ratio: float = 2.0) -> Column:
    """price, volume, both or null; a previous value of zero is never a spike here."""
    p = F.coalesce((prev_price > 0) & (F.abs(price - prev_price).cast("double") / F.nullif(prev_price, F.lit(0)).cast("double") >= delta), F.lit(False))
    v = F.coalesce((prev_volume > 0) & (volume.cast("double") / F.nullif(prev_volume, F.lit(0)).cast("double") >= ratio), F.lit(False))
    return F.when(p & v, "both").when(p, "price").when(v, "volume")


def stock_gate(state: Column, sizes: Column, expires_at: Column, asof: Column) -> Column:
    """pass, hold (unknown or stale) or drop (out, or in without sizes)."""
    stale = F.coalesce((expires_at > 0) & (expires_at <= asof), F.lit(False))
    return (
        F.when((F.coalesce(state, F.lit("UNKNOWN")) == "UNKNOWN") | stale, "hold").when(state == "OUT", "drop")
        .when(F.coalesce(F.size(sizes), F.lit(0)) > 0, "pass").otherwise("drop")
    )


def http_state(status: Column, has_volume: Column) -> Column:
    """known, gone (quarantine), retry or bad."""
    return F.when((status == 200) & has_volume, "known").when(status == 200, "bad").when(status.isin(404, 410), "gone").otherwise("retry")
