"""Writes to keyed tables as pure functions: old rows and new rows in, the table's next rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by `order`; new rows go after old ones that are equal in it."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_new"]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("_new"))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")


def accumulate(rows: DataFrame, keys: list[str], ts: str, tie: str, keep_last: list[str]) -> DataFrame:
    """Fold of all sightings: count, first and last moment, and for each kept column its last value that is not blank."""
    last = [F.max_by(F.nullif(F.col(c), F.lit("")), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(ts, tie))).alias(c) for c in keep_last]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen_count"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), *last)


def sightings(rows: DataFrame, keys: list[str], ts: str, tie: str, keep_last: list[str]) -> DataFrame:
    """accumulate() in a form that more sightings can be added to: each kept column is (ts, tie, value) of its last value
    that is not blank."""
    last = [F.max(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(c).alias("value")))).alias(c) for c in keep_last]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen_count"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), *last)


def add_sightings(old: DataFrame, new: DataFrame, keys: list[str], keep_last: list[str]) -> DataFrame:
    """Sum of two tables of sightings()."""
    last = [F.max(c).alias(c) for c in keep_last]
    return old.unionByName(new).groupBy(*keys).agg(F.sum("seen_count").alias("seen_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *last)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Old rows stay; of new ones with an unseen key the first by `order` is added."""
    fresh = new.join(old.select(*keys), keys, "left_anti")
    w = Window.partitionBy(*keys).orderBy(*order)
    return old.unionByName(fresh.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"), allowMissingColumns=True)


def probe_upsert(old: DataFrame, new: DataFrame, key: str, updated: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Existing keys take the `updated` columns from new rows; new keys are added with the defaults."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in updated], F.lit(True).alias("_hit"))
    j = old.join(n, key, "left")
    kept = j.select(*[(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) if c in updated else F.col(c)).alias(c) for c in old.columns])
    added = new.join(old.select(key), key, "left_anti")
    for c, v in defaults.items():
        added = added.withColumn(c, v)
    return kept.unionByName(added, allowMissingColumns=True)


def merge_truthy(old: DataFrame, new: DataFrame, key: str, columns: list[str], drop_zero: str) -> DataFrame:
    """Existing keys are overwritten only by values that are not 0 or null; then rows whose `drop_zero` is 0 go, unknown
    ones stay."""
    n = new.select(key, *[F.nullif(F.col(c), F.lit(0)).alias(f"_{c}") for c in columns])
    j = old.join(n, key, "full_outer")
    out = j.select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns], *[c for c in old.columns if c not in (key, *columns)])
    return out.where(F.col(drop_zero).isNull() | (F.col(drop_zero) != 0))


def retain(df: DataFrame, drop: Column) -> DataFrame:
    """Rows for which the deletion's condition is not true."""
    return df.where(~F.coalesce(drop, F.lit(False)))


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def lease_free(until: Column, owner: Column, asof: Column, me: str) -> Column:
    return until.isNull() | (until < asof) | (owner == me)


def settle(tokens: DataFrame, calls: DataFrame, token_id: str, call_token: str) -> DataFrame:
    """Reserved tokens with a call are settled, the others stay as they are."""
    used = calls.select(F.col(call_token).alias(token_id), F.lit(True).alias("_u")).distinct()
    return tokens.join(used, token_id, "left").withColumn("status", F.when((F.col("status") == "reserved") & F.col("_u"), "settled").otherwise(F.col("status"))).drop("_u")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cap_per_group(df: DataFrame, unique: list[str], group: list[str], order: list[Column], n: int | Column) -> DataFrame:
    """First of each unique key, then the first n per group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return keep_first(df, unique, order).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def exclude_oldest(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """All rows but the n oldest by a total order of columns. The n-th key is found by a bounded top-n and is one row, so
    it is broadcast and nothing is shuffled; all rows go if there are no more than n."""
    if n <= 0:
        return df
    last = df.select(F.struct(*order).alias("_o")).orderBy("_o").limit(n).agg(F.max("_o").alias("_last"))
    return df.join(F.broadcast(last), F.struct(*order) > F.col("_last")).select(*df.columns)
