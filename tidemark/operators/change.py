"""Changes between states of prices and volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, tiers
from ..sources.keyed import KeyedTable


def with_previous(df: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", *[F.lag(v).over(w).alias(f"prev_{v}") for v in values])


def significant(old: Column, new: Column, least: int = 1000, share: float = 0.01) -> Column:
    """False for small changes: below `least` and (from nothing or below `share`)."""
    d = F.abs(new - old)
    return ~((d < least) & ((old == 0) | (F.try_divide(d.cast("double"), old.cast("double")) < share)))


def price_changes(df: DataFrame, keys: list[str], order: list[Column], price: str) -> DataFrame:
    """Rows whose price differs significantly from the one before."""
    w = with_previous(df, keys, order, [price])
    old, new = F.col(f"prev_{price}"), F.col(price)
    return w.where(old.isNotNull() & (old != new) & significant(old, new)).withColumn("delta", new - old)


def alert_worthy(profit_diff: Column, old_signal: Column, new_signal: Column, least: int = 3000) -> Column:
    return (F.abs(profit_diff) >= least) | (old_signal != new_signal)


def snapshot_diff(before: DataFrame, now: DataFrame, key: str, values: list[str]) -> DataFrame:
    """new, changed, same or stale for each key of two snapshots, by a hash of the values."""
    a = before.select(key, money.state_hash(*[F.col(v) for v in values]).alias("h0"))
    b = now.select(key, money.state_hash(*[F.col(v) for v in values]).alias("h1"))
    kind = F.when(F.col("h0").isNull(), "new").when(F.col("h1").isNull(), "stale").when(F.col("h0") == F.col("h1"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("change"))


def differing(before: KeyedTable, now: KeyedTable, then: int | None = None, at: int | None = None) -> set[int]:
    """Buckets whose rows differ between versions (the last by default) of two tables of the same keys and buckets. Buckets
    that two versions of one table share are files of both and aren't even hashed."""
    if (before.keys, before.buckets) != (now.keys, now.buckets):
        raise ValueError("tables must have the same keys and number of buckets")
    if before.path == now.path:
        a, b = before.manifest(then), now.manifest(at)
        moved = {k for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
        if not moved:
            return set()
    else:
        moved = set(range(now.buckets))
    a, b = before.digests(then), now.digests(at)
    return {k for k in moved if a.get(k) != b.get(k)}


def bucket_diff(before: KeyedTable, now: KeyedTable, values: list[str], then: int | None = None, at: int | None = None) -> DataFrame:
    """snapshot_diff of two keyed snapshots with one key. Only buckets whose digests differ are joined; of the others the keys
    alone are read, all `same`."""
    key = now.keys[0]
    other = differing(before, now, then, at)
    joined = snapshot_diff(before.only(other, then), now.only(other, at), key, values)
    return joined.unionByName(now.only(set(range(now.buckets)) - other, at).select(key, F.lit("same").alias("change")))


def cap_changes(changes: DataFrame, key: str, cap: int) -> tuple[DataFrame, DataFrame]:
    """(to process now, carried over): a bounded batch in key order; only processed keys are marked by the caller."""
    now = changes.orderBy(key).limit(cap)
    return now, changes.join(now.select(key), key, "left_anti")


def volume_spikes(df: DataFrame, keys: list[str], order: list[Column], volume: str) -> DataFrame:
    w = with_previous(df, keys, order, [volume])
    ratio = tiers.volume_spike(F.col(f"prev_{volume}"), F.col(volume))
    return w.withColumn("ratio", ratio).where("ratio is not null")


def refires(df: DataFrame, keys: list[str], ts: str, tie: str, seconds: int) -> DataFrame:
    """Rows that follow another of their key within `seconds`."""
    w = with_previous(df, keys, [F.col(ts), F.col(tie)], [ts])
    return w.where(F.col(ts).cast("timestamp").cast("double") - F.col(f"prev_{ts}").cast("timestamp").cast("double") <= seconds)


def per_product_change(df: DataFrame, key: str, delta: str, signal: str, order: list[Column]) -> DataFrame:
    """Greatest absolute change and the first signal of each product."""
    return df.groupBy(key).agg(F.max(F.abs(delta)).alias("max_change"), F.min_by(signal, F.struct(*order)).alias("signal"))
