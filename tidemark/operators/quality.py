"""Checks of sources and pages, follow-ups and queue states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import tiers
from ..functions.money import percent


def exists_flag(df: DataFrame, keys: DataFrame, on: str, flag: str) -> DataFrame:
    """A flag column: the key is among `keys` (made unique first, so no row is doubled)."""
    k = keys.select(on).distinct().withColumn(flag, F.lit(True))
    return df.join(k, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def repeated_pages(df: DataFrame, source: str, page: str, item: str) -> DataFrame:
    """Pages that hold exactly the items of the page before: paging that doesn't advance."""
    sets = df.groupBy(source, page).agg(F.array_sort(F.collect_set(item)).alias("items"))
    before = F.lag("items").over(Window.partitionBy(source).orderBy(page))
    return sets.select(source, page, F.coalesce(F.col("items") == before, F.lit(False)).alias("repeated"))


def missing_canaries(expected: DataFrame, seen: DataFrame, on: list[str], few: int = 1_000_000) -> DataFrame:
    """Expected rows that are not among those seen. Values are hashed, and the hashes of the expected, if a count shows
    that they are few, are broadcast; of the seen rows only those with such a hash go on to be compared in full."""
    e = expected.withColumn("_h", F.xxhash64(*on))
    wanted = e.select("_h").distinct()
    near = F.broadcast if wanted.limit(few + 1).count() <= few else (lambda df: df)
    hits = seen.select(*on, F.xxhash64(*on).alias("_h")).join(near(wanted), "_h", "left_semi")
    return e.join(hits, ["_h", *on], "left_anti").drop("_h")


def pattern_cover(df: DataFrame, text: Column, patterns: dict[str, list[str]], hit: Column) -> DataFrame:
    """Per named group of LIKE patterns: rows, rows with a hit, share. One pass, whatever the number of groups."""
    groups = F.array(*[F.when(reduce(lambda a, b: a | b, [text.like(p) for p in ps]), F.lit(name)) for name, ps in patterns.items()])
    g = df.select(F.explode(F.filter(groups, lambda x: x.isNotNull())).alias("name"), hit.alias("hit")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
    return g.withColumn("pct", percent(F.col("hits"), F.col("n")))


def funnel(df: DataFrame, by: str, stages: dict[str, Column]) -> DataFrame:
    """Rows that pass each stage and all before it."""
    passed, cols = F.lit(True), []
    for name, c in stages.items():
        passed = passed & F.coalesce(c, F.lit(False))
        cols.append(F.count_if(passed).alias(name))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("seen"), *cols)


def sold_after(followups: DataFrame, sales: DataFrame, key: str, size: str, fired_at: str, fired_price: str, sold_at: str, price: str) -> DataFrame:
    """Whether a sale after the alert reached its price: of the same size, or of any size where the alert has none. Alerts
    and sales are laid in order of time within each day, and the best later price is a running maximum after that of the days
    to come; no pairs are made, and a product of any number of sales is spread over its days. Times may be numbers of seconds."""
    group = lambda c: F.struct(c.isNull().alias("any"), c.alias("size"))
    f = followups.distinct().select(F.col(key).alias("_k"), group(F.col(size)).alias("_g"), F.col(fired_at).alias("_t"), F.lit(0).alias("_sale"), F.lit(None).alias("_p"), F.struct("*").alias("_f"))
    known = sales.where(F.col(key).isNotNull() & F.col(sold_at).isNotNull())
    both = F.when(F.col(size).isNull(), F.array(F.lit(None).cast(sales.schema[size].dataType))).otherwise(F.array(F.col(size), F.lit(None)))
    s = known.select(F.col(key).alias("_k"), F.explode(both).alias("_s"), F.col(sold_at).alias("_t"), F.col(price).alias("_p")).select("_k", group(F.col("_s")).alias("_g"), "_t", F.lit(1).alias("_sale"), "_p")
    # Newest first; at one time the alert comes before the sale, which is not after it.
    seconds = isinstance(sales.schema[sold_at].dataType, NumericType)
    both = f.unionByName(s, allowMissingColumns=True).withColumn("_d", F.floor(F.col("_t") / 86_400) if seconds else F.date_trunc("day", "_t"))
    coming = Window.partitionBy("_k", "_g").orderBy(F.desc("_d")).rowsBetween(Window.unboundedPreceding, -1)
    days = both.groupBy("_k", "_g", "_d").agg(F.max("_p").alias("_m")).select("_k", "_g", "_d", F.max("_m").over(coming).alias("_ahead"))
    later = Window.partitionBy("_k", "_g", "_d").orderBy(F.desc("_t"), "_sale").rowsBetween(Window.unboundedPreceding, 0)
    g = both.withColumn("_own", F.max("_p").over(later)).where("_sale = 0")
    met = [g[c].eqNullSafe(days[c]) for c in ("_k", "_g", "_d")]
    g = g.join(days, met[0] & met[1] & met[2], "left").select("_f.*", F.greatest("_own", "_ahead").alias("best"))
    g = g.withColumn("best", F.when(F.col(fired_at).isNotNull(), F.col("best")))
    return g.withColumn("sold", F.coalesce(F.col("best") >= F.col(fired_price), F.lit(False)))


def apply_state(df: DataFrame, state: Column, volume: Column, matched: Column, attempts: Column) -> DataFrame:
    """Tier, seconds to the next look and attempts after an answer: known, gone, retry or bad."""
    n = F.coalesce(attempts, F.lit(0)) + 1
    return df.withColumn("tier", F.when(state == "known", tiers.volume_tier(volume))).withColumn(
        "wait_s", F.when(state == "known", tiers.check_interval(volume, matched)).when(state == "gone", 90 * tiers.DAY).otherwise(tiers.retry_backoff(n))).withColumn(
        "attempts_after", F.when(state == "known", 0).otherwise(n))


def spread_schedule(df: DataFrame, order: list[Column], first: int, key: Column, seconds: Column) -> DataFrame:
    """The first rows are due at once, the others within their class's time, spread by a hash of the key."""
    unit = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % 1000
    now = df.orderBy(*order).limit(first).select(F.lit(True).alias("_now"), key.alias("_k"))
    return df.join(F.broadcast(now), key == F.col("_k"), "left").withColumn("wait_s", F.when(F.col("_now"), 0).otherwise(F.floor(unit * seconds / 1000)).cast("bigint")).drop("_now", "_k")


def page_state(html: Column, offline: list[str], upcoming: str) -> Column:
    """offline, upcoming or open, by phrases and a pattern."""
    return F.when(reduce(lambda a, b: a | b, [html.contains(w) for w in offline]), "offline").when(html.rlike(upcoming), "upcoming").otherwise("open")


def expect_range(n: Column, best: float, expected: float, worst: float) -> list[Column]:
    return [F.floor(n * F.lit(x)).cast("bigint").alias(name) for name, x in (("best", best), ("expected", expected), ("worst", worst))]


def reasons(checks: list[tuple[str, Column]]) -> Column:
    """Names of all checks that hold."""
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]), lambda x: x.isNotNull())


def verdict(reasons_: Column, fatal: tuple[str, ...]) -> Column:
    """ok without a reason, fail with a fatal one, else warn."""
    return F.when(F.size(reasons_) == 0, "ok").when(F.arrays_overlap(reasons_, F.array(*[F.lit(f) for f in fatal])), "fail").otherwise("warn")
