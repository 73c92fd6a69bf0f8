"""Trade statistics and the weighted score of a product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import liquidity

#: The weights of the scores.
WEIGHTS = {"liquidity": 0.35, "volatility": 0.20, "velocity": 0.25, "price_position": 0.20}


def trade_stats(trades: DataFrame, key: str, ts: str, price: str, order: list[Column], asof: Column, days: tuple[int, int] = (7, 30)) -> DataFrame:
    """Trades of the last days, the last moment, and the trend: mean of the newest five prices against the five before,
    up or down beyond 3 %, '' with fewer than ten trades."""
    w = Window.partitionBy(key).orderBy(*order)
    r = trades.withColumn("_n", F.row_number().over(w))
    within = lambda n: F.col(ts) > asof - F.make_dt_interval(F.lit(n + 1))
    g = r.groupBy(key).agg(
        F.count_if(within(days[0])).alias("trades_short"), F.count_if(within(days[1])).alias("trades_long"), F.max(ts).alias("last_trade"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("_n") <= 5, F.col(price))).alias("_a"), F.sum(F.when((F.col("_n") > 5) & (F.col("_n") <= 10), F.col(price))).alias("_b"))
    up = F.col("_a").cast("double") > F.col("_b").cast("double") * 1.03
    down = F.col("_a").cast("double") < F.col("_b").cast("double") * 0.97
    return g.withColumn("trend", F.when(F.col("n") < 10, "").when(up, "up").when(down, "down").otherwise("flat")).drop("_a", "_b")


def volatility(prices: Column, n: Column, mean: Column, sd: Column) -> Column:
    return F.when(n < 2, 0.5).when(mean <= 0, 0.0).otherwise(1.0 / (1.0 + sd / mean * 5.0))


def velocity(median_gap_s: Column) -> Column:
    return F.when(median_gap_s.isNull(), 0.0).otherwise(1.0 / (1.0 + F.greatest(median_gap_s / 3600.0, F.lit(0.0)) / 6.0))


def price_position(sell: Column, n: Column, p25: Column, p75: Column) -> Column:
    a, b, s = p25.cast("double"), p75.cast("double"), sell.cast("double")
    return F.when((n < 4) | (sell <= 0) | (p75 <= p25), 0.5).when(sell <= p25, 1.0).when(sell >= p75, 0.0).otherwise(1.0 - (s - a) / (b - a))


def signal_scores(trades: DataFrame, state: DataFrame, key: str, ts: str, price: str, asks: str = "asks", sell: str = "sell", weights: dict[str, float] | None = None) -> DataFrame:
    """The four scores, their weighted total, the reasons and whether it passes. trades: key, ts, price; state: key,
    asks, sell. Positive prices count; all statistics of a product come from one shuffle of its trades, quartiles by their place."""
    w = WEIGHTS if weights is None else weights
    good = F.when(F.col(price) > 0, F.col(price))
    own = Window.partitionBy(key)
    gap = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(own.orderBy(ts)))
    place = F.row_number().over(own.orderBy(F.asc_nulls_last("p"))) - 1
    t = trades.withColumn("p", good).select(key, "p", F.when(gap > 0, gap).alias("gap"), place.alias("at"), F.count("p").over(own).alias("of"))
    q = lambda num: F.max(F.when(F.col("at") == F.floor(F.col("of") * num / 4), F.col("p"))).alias(f"q{num}")
    g = t.groupBy(key).agg(
        F.count(F.lit(1)).alias("sales"), F.count("p").alias("n"), F.avg("p").alias("mean"), F.stddev_samp("p").alias("sd"), F.median("gap").alias("gap"), q(1), q(3))
    j = g.join(state, key)
    n = F.col("n")
    j = j.select(
        key, F.col("sales"), F.col(asks).alias("asks"), liquidity(F.col("sales"), F.col(asks)).alias("liquidity"), volatility(F.col("ps"), n, F.col("mean"), F.col("sd")).alias("volatility"),
        velocity(F.col("gap")).alias("velocity"), price_position(F.col(sell), n, F.col("q1"), F.col("q3")).alias("price_position"))
    total = sum((F.col(k) * F.lit(w.get(k, 0.0)) for k in WEIGHTS), F.lit(0.0))
    reasons = F.filter(F.array(
        F.when(F.col("liquidity") >= 0.7, "liquid"), F.when(F.col("volatility") >= 0.7, "stable").when(F.col("volatility") <= 0.3, "volatile"), F.when(F.col("velocity") >= 0.7, "fast"),
        F.when(F.col("price_position") >= 0.7, "low entry").when(F.col("price_position") <= 0.3, "high entry")), lambda r: r.isNotNull())
    rounded = [F.round(k, 4).alias(k) for k in WEIGHTS]
    return j.withColumn("total", total).withColumn("reasons", reasons).select(key, *rounded, F.round("total", 4).alias("total"), "reasons", (F.col("total") >= 0.45).alias("passes"))
