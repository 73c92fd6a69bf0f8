"""Latest prices, cheapest offers and opportunities per size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money


def latest_batch(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """All rows of each key's last moment, ties kept. The maximum is combined before the shuffle, and the join back is by
    key and time, so a long history moves once."""
    last = df.groupBy(*keys).agg(F.max(ts).alias(ts))
    return df.join(last, [*keys, ts], "left_semi")


def latest_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the greatest by `order`, a total order. One aggregation, no sort of the history."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")


def cheapest(df: DataFrame, keys: list[str], price: str, ties: list[str], where: Column | None = None) -> DataFrame:
    """One row per key: the least price, ties by the columns given."""
    df = df if where is None else df.where(where)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(price, *ties)).alias("_r")).select(*keys, "_r.*")


def label_prices(df: DataFrame, keys: list[str], label: str, price: str) -> DataFrame:
    """Map of label to its least price for each key."""
    least = df.groupBy(*keys, label).agg(F.min(price).alias("_p"))
    return least.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "_p")))).alias("prices"))


def opportunities(market: DataFrame, retail: DataFrame, volume: DataFrame, fees: money.Fees = money.FEES) -> DataFrame:
    """Per product and size: market price of the last batch, cheapest stocked offer, net profit, ROI, signal.

    market: product_id, size, sell, ts. retail: product_id, size, price, in_stock. volume: product_id, volume.
    """
    ask = latest_batch(market, ["product_id"], "ts").groupBy("product_id", "size").agg(F.max("sell").alias("sell"))
    offer = retail.where("in_stock").groupBy("product_id", "size").agg(F.min("price").alias("cost"))
    both = ask.join(offer, ["product_id", "size"]).join(volume, "product_id", "left")
    v = F.coalesce("volume", F.lit(0)).cast("bigint")
    out = both.withColumn("volume", v).withColumn("net_profit", money.net_profit(F.col("sell"), F.col("cost"), fees))
    return out.withColumn("roi", money.roi(F.col("net_profit"), F.col("cost"))).withColumn("signal", money.signal(F.col("net_profit"), F.col("volume")))


def best_per_product(opps: DataFrame) -> DataFrame:
    """The size with the greatest profit (the least size on ties), best products first by (profit, id)."""
    pick = opps.groupBy("product_id").agg(F.max_by(F.struct("size", "sell", "cost", "net_profit", "roi", "signal"), F.struct("net_profit", (-F.col("size")).alias("s"))).alias("r"))
    return pick.select("product_id", "r.*")


def order_book(df: DataFrame, keys: list[str], price: str, quantity: str, side: Column, pos: str) -> DataFrame:
    """Least ask, greatest bid, bid quantity and the first sale by position."""
    ask, bid, sale = side == "ask", side == "bid", side == "sale"
    return df.groupBy(*keys).agg(
        F.min(F.when(ask, F.col(price))).alias("best_ask"), F.max(F.when(bid, F.col(price))).alias("best_bid"),
        F.sum(F.when(bid, F.col(quantity)).otherwise(0)).cast("bigint").alias("bid_quantity"), F.min_by(F.when(sale, F.col(price)), F.when(sale, F.col(pos))).alias("first_sale"))


def mean_spread(df: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """Whole mean distance of two prices over rows that have both; 0 if none has."""
    d = F.when((a > 0) & (b > 0), F.abs(a - b))
    return df.groupBy(*keys).agg(F.coalesce(F.floor(F.sum(d).cast("double") / F.count(d)), F.lit(0)).cast("bigint").alias("spread"))


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, name: str = "rn") -> DataFrame:
    """The first n rows per key with their place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def merge_size_prices(primary: DataFrame, secondary: DataFrame, keys: list[str], carry: str) -> DataFrame:
    """Primary rows win; the secondary only adds sizes, with `carry` and null prices, and fills a missing `carry`."""
    extra = secondary.select(*keys, F.col(carry).alias("_c"))
    out = primary.join(extra, keys, "full_outer")
    return out.withColumn(carry, F.coalesce(carry, "_c")).drop("_c")
