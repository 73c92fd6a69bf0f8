"""Counts, shares and summaries for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import percent
from ..session import scratch


def top_counts(df: DataFrame, key: Column, name: str, n: int | None = None, least: int = 1) -> DataFrame:
    g = df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return g if n is None else g.orderBy(F.desc("n"), name).limit(n)


def numbered(df: DataFrame, key: str, name: str, width: int = 65_536) -> DataFrame:
    """Rows numbered from 1 by an integer key without repeats: within stretches of `width` keys, after the counts of the
    stretches before. Only those counts meet in one task."""
    place = df.withColumn("_b", F.floor(F.col(key) / width))
    counts = place.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_o"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    return place.withColumn("_i", own).join(before, "_b").withColumn(name, F.col("_i") + F.col("_o")).drop("_b", "_i", "_o")


def placed(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 1 within groups of any size, by a total order. All rows are sorted once over ranges and written, which
    fixes the ranges; a row's place is that in its range after the group's counts in the ranges before. Only these counts, one a
    group and range, meet in one task. Null is a group like others."""
    path = scratch(df.sparkSession, "placed")
    ranges = df.orderBy(*groups, *order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    ranges.write.parquet(path)
    rows = df.sparkSession.read.schema(ranges.schema).parquet(path)
    keys = [f"_g{i}" for i in range(len(groups))]
    runs = rows.groupBy(*[F.col(g).alias(k) for g, k in zip(groups, keys)], F.col("_p").alias("_q")).agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_c"))
    runs = runs.withColumn("_before", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_q")) - F.col("_c")).drop("_c")
    same = F.col("_p") == F.col("_q")
    for g, k in zip(groups, keys):
        same &= F.col(g).eqNullSafe(F.col(k))
    place = F.col("_i") - F.col("_first") + F.col("_before") + 1
    return rows.join(runs, same).withColumn(name, place).drop("_p", "_i", "_q", "_first", "_before", *keys)


def folded(c: Column, dash: str = "-") -> Column:
    """Null and '' as one group."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(dash))


def coverage(df: DataFrame, group: str, item: str, total: DataFrame) -> DataFrame:
    """Distinct items per group and their share of a total count (one row, broadcast)."""
    g = df.groupBy(group).agg(F.countDistinct(item).alias("items"))
    return g.join(F.broadcast(total.agg(F.count(F.lit(1)).alias("total")))).withColumn("pct", percent(F.col("items"), F.col("total")))


def top_per_class(df: DataFrame, classes: list[str], item: str, n: int) -> DataFrame:
    """Most frequent items of each class with their place and the class's total."""
    g = df.groupBy(*classes, item).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*classes)
    return g.withColumn("total", F.sum("n").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), item))).where(F.col("place") <= n)


def order_stats(df: DataFrame, keys: list[str], value: str, least_p95: int = 20) -> DataFrame:
    """Count, least, greatest, the value at n/2 and, from least_p95 rows on, at int(0.95 n) of the sorted values. Exact
    positions come from running counts of the different values, which are counted before the shuffle."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys)
    r = c.withColumn("upto", F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    return r.groupBy(*keys).agg(
        F.max("n").alias("n"), F.min("v").alias("least"), at(F.floor(F.col("n") / 2)).alias("p50"),
        F.when(F.max("n") >= least_p95, at(F.floor(F.col("n") * F.lit(95) / 100))).alias("p95"), F.max("v").alias("greatest"))


def silent_sources(expected: DataFrame, beats: DataFrame, key: str, ts: str, asof: Column, hours: int) -> DataFrame:
    """Expected sources with no beat within `hours`, or none at all."""
    last = beats.groupBy(key).agg(F.max(ts).alias("last_at"))
    return expected.join(last, key, "left").where(F.col("last_at").isNull() | (F.col("last_at") <= asof - F.make_dt_interval(F.lit(0), F.lit(hours))))


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows with a value that is not blank, one row per column."""
    filled = [F.avg(F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)).cast("int").cast("double")).alias(c) for c in columns]
    return df.agg(*filled).unpivot([], columns, "field", "fill_rate")


def hit_rate(df: DataFrame, checked: Column, sold: Column, fired: Column, actual: Column) -> DataFrame:
    """Total, checked, sold, share of checked that sold (null without any), mean gap of the real to the fired price."""
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(checked).alias("checked"), F.count_if(checked & sold).alias("sold"),
        F.round(F.try_divide(F.count_if(checked & sold).cast("double"), F.count_if(checked).cast("double")), 4).alias("hit_rate"),
        F.round(F.try_divide(F.sum(F.when(checked & sold, actual - fired)).cast("double"), F.count_if(checked & sold).cast("double")), 2).alias("mean_gap"))


def allowance(soft: Column, hard: Column, reserve: Column, used: Column, used_background: Column) -> Column:
    return F.greatest(F.lit(0), F.least(soft - used_background, hard - used - reserve))


def buckets(df: DataFrame, bucket: Column, names: list[str]) -> DataFrame:
    """Rows per bucket, empty buckets as 0."""
    spark = df.sparkSession
    every = spark.createDataFrame([(n,) for n in names], "bucket STRING")
    return F.broadcast(every).join(df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
