"""Prices, profit, changes and scores over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, sizes, tiers
from ..operators import change, gates, price, score, upsert
from ..views import events, market_prices, market_products, read, retail_prices, volumes, with_sql
from .registry import ORACLE, query

OPPS = """ask AS (SELECT product_id, size, max(sell) AS sell FROM (SELECT *, max(ts) OVER (PARTITION BY product_id) AS last FROM market_prices) WHERE ts = last GROUP BY ALL),
offer AS (SELECT product_id, size, min(price) AS cost FROM retail_prices WHERE in_stock GROUP BY ALL),
opps AS (SELECT *, CASE WHEN net_profit >= 30000 AND volume >= 1 THEN 'strong_buy' WHEN net_profit >= 15000 AND volume >= 1 THEN 'buy' WHEN net_profit >= 5000 AND volume >= 1 THEN 'watch' ELSE 'none' END AS signal
  FROM (SELECT *, CASE WHEN cost > 0 THEN round_even(net_profit::DOUBLE / cost::DOUBLE * 100.0::DOUBLE, 1) + 0.0::DOUBLE ELSE 0.0::DOUBLE END AS roi
    FROM (SELECT product_id, size, sell, cost, coalesce(volume, 0)::BIGINT AS volume,
      sell - cost - (round_even((2500.0::DOUBLE + sell::DOUBLE * 0.06::DOUBLE) * (1 + 0.1)::DOUBLE, 0)::BIGINT + 5500) AS net_profit
      FROM ask JOIN offer USING (product_id, size) LEFT JOIN volumes USING (product_id))))"""


def opps(spark: SparkSession, d: str) -> DataFrame:
    return price.opportunities(market_prices(spark, d), retail_prices(spark, d), volumes(spark, d))


@query(with_sql("market_prices", "retail_prices", "volumes", rest=OPPS + " SELECT product_id, size, sell, cost, volume, net_profit, roi, signal FROM opps"))
def profit_opportunities(spark: SparkSession, d: str) -> DataFrame:
    return opps(spark, d).select("product_id", "size", "sell", "cost", "volume", "net_profit", "roi", "signal")


@query(with_sql("market_prices", "retail_prices", "volumes", rest=OPPS + """ SELECT product_id, size, sell, cost, net_profit, roi, signal FROM opps
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY net_profit DESC, size) = 1"""))
def best_opportunity_per_product(spark: SparkSession, d: str) -> DataFrame:
    return price.best_per_product(opps(spark, d))


@query(with_sql("market_prices", "retail_prices", "volumes", rest=OPPS + """ SELECT product_id, size, CASE WHEN net_profit < 10000 THEN 'profit_floor' WHEN roi < 5.0 THEN 'roi_floor' WHEN volume < 1 THEN 'volume_floor'
  WHEN cost > 0 AND sell > cost * 5.0::DOUBLE THEN 'price_sanity' ELSE 'pass' END AS reason, CASE WHEN cost > 0 AND sell > cost * 2.0::DOUBLE THEN true ELSE false END AS anomaly, cost - sell > -20000 AS in_gap FROM opps"""))
def gate_reason_funnel(spark: SparkSession, d: str) -> DataFrame:
    o = opps(spark, d)
    bad = gates.below_floors(F.col("net_profit"), F.col("roi"), F.col("volume")) + [("price_sanity", money.price_insane(F.col("sell"), F.col("cost")))]
    return o.select("product_id", "size", gates.first_reason(bad).alias("reason"), gates.spread_anomaly(F.col("sell"), F.col("cost")).alias("anomaly"), gates.gap_screen(F.col("cost"), F.col("sell")).alias("in_gap"))


@query(with_sql("market_prices", "retail_prices", rest="""latest AS (SELECT product_id, min(sell) AS last_sell FROM (SELECT *, max(ts) OVER (PARTITION BY product_id) AS last FROM market_prices) WHERE ts = last GROUP BY 1),
 vol AS (SELECT l_partkey AS product_id, count(*) FILTER (WHERE l_returnflag = 'R') AS v FROM lineitem WHERE l_shipdate < DATE '1993-06-01' GROUP BY 1)
 SELECT product_id, source, size, price, coalesce(last_sell - price + floor(last_sell::DOUBLE * 0.2::DOUBLE)::BIGINT < 10000, false) AS price_blocks, coalesce(v IS NOT NULL AND v < 1, false) AS volume_blocks, count(*) AS n
 FROM retail_prices LEFT JOIN latest USING (product_id) LEFT JOIN vol USING (product_id) GROUP BY ALL"""))
def prefilters(spark: SparkSession, d: str) -> DataFrame:
    m = market_prices(spark, d)
    last = price.latest_batch(m, ["product_id"], "ts").groupBy("product_id").agg(F.min("sell").alias("last_sell"))
    vol = read(spark, d, "lineitem").where("l_shipdate < date '1993-06-01'").groupBy(F.col("l_partkey").alias("product_id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("v"))
    j = retail_prices(spark, d).join(last, "product_id", "left").join(vol, "product_id", "left")
    j = j.withColumn("price_blocks", gates.prefilter_price(F.col("last_sell") - F.col("price"), F.col("last_sell"))).withColumn("volume_blocks", gates.prefilter_volume(F.col("v").isNotNull(), F.col("v")))
    return j.groupBy("product_id", "source", "size", "price", "price_blocks", "volume_blocks").agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("retail_prices", rest="SELECT product_id, size, price, source, ts FROM retail_prices WHERE in_stock QUALIFY row_number() OVER (PARTITION BY product_id, size ORDER BY price, source, ts) = 1"))
def cheapest_source_per_size(spark: SparkSession, d: str) -> DataFrame:
    return price.cheapest(retail_prices(spark, d), ["product_id", "size"], "price", ["source", "ts"], F.col("in_stock")).select("product_id", "size", "price", "source", "ts")


@query(with_sql("retail_prices", rest="SELECT product_id, string_agg(source || ':' || p, '|' ORDER BY source) AS prices FROM (SELECT product_id, source, min(price) AS p FROM retail_prices WHERE in_stock GROUP BY ALL) GROUP BY 1"))
def source_price_map(spark: SparkSession, d: str) -> DataFrame:
    m = price.label_prices(retail_prices(spark, d).where("in_stock"), ["product_id"], "source", "price")
    pairs = F.transform(F.map_entries("prices"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return m.select("product_id", F.array_join(pairs, "|").alias("prices"))


@query(with_sql("market_prices", rest="SELECT product_id, size, sell, ts, count(*) AS n FROM (SELECT *, max(ts) OVER (PARTITION BY product_id) AS last FROM market_prices) WHERE ts = last GROUP BY product_id, size, sell, ts"))
def latest_price_batch(spark: SparkSession, d: str) -> DataFrame:
    return price.latest_batch(market_prices(spark, d), ["product_id"], "ts").groupBy("product_id", "size", "sell", "ts").agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("market_prices", rest="SELECT product_id, size, sell, ts FROM market_prices QUALIFY row_number() OVER (PARTITION BY product_id, size ORDER BY ts DESC, sell) = 1"))
def latest_price_single(spark: SparkSession, d: str) -> DataFrame:
    out = price.latest_row(market_prices(spark, d), ["product_id", "size"], [F.col("ts"), -F.col("sell")])
    return out.select("product_id", "size", "sell", "ts")


@query(with_sql("market_products", "market_prices", "volumes", rest="""hot AS (SELECT product_id, name, volume FROM market_products JOIN volumes USING (product_id) WHERE volume >= 5 ORDER BY volume DESC, product_id LIMIT 50),
 p AS (SELECT DISTINCT product_id, size, sell FROM (SELECT *, max(ts) OVER (PARTITION BY product_id) AS last FROM market_prices) WHERE ts = last)
 SELECT product_id, name, volume, coalesce(string_agg(size || ':' || sell, '|' ORDER BY size, sell), '') AS prices FROM hot LEFT JOIN p USING (product_id) GROUP BY ALL"""))
def hot_products_topk(spark: SparkSession, d: str) -> DataFrame:
    hot = market_products(spark, d).select("product_id", "name").join(volumes(spark, d), "product_id").where("volume >= 5").orderBy(F.desc("volume"), "product_id").limit(50)
    p = price.latest_batch(market_prices(spark, d), ["product_id"], "ts").select("product_id", "size", "sell").distinct()
    all_prices = F.array_sort(F.collect_list(F.when(F.col("size").isNotNull(), F.struct("size", "sell"))))
    g = hot.join(p, "product_id", "left").groupBy("product_id", "name", "volume").agg(all_prices.alias("a"))
    return g.select("product_id", "name", "volume", F.array_join(F.transform("a", lambda s: F.concat_ws(":", s["size"].cast("string"), s["sell"].cast("string"))), "|").alias("prices"))


@query(with_sql("market_products", "volumes", rest="""SELECT product_id, priority, last_at, row_number() OVER (ORDER BY CASE priority WHEN 'hot' THEN 0 WHEN 'warm' THEN 1 ELSE 2 END, last_at NULLS FIRST, product_id)::INT AS place
 FROM (SELECT product_id, CASE WHEN coalesce(volume, 0) >= 20 THEN 'hot' WHEN coalesce(volume, 0) >= 8 THEN 'warm' ELSE 'cold' END AS priority, last_at FROM market_products LEFT JOIN volumes USING (product_id)
   LEFT JOIN (SELECT l_partkey AS product_id, max(l_shipdate) AS last_at FROM lineitem WHERE l_discount > 0.08 GROUP BY 1) USING (product_id)
   WHERE last_at IS NULL OR last_at <= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY) QUALIFY place <= 100"""))
def scan_queue_order(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    last = li.where("l_discount > 0.08").groupBy(F.col("l_partkey").alias("product_id")).agg(F.max("l_shipdate").alias("last_at"))
    asof = li.agg((F.max("l_shipdate") - F.expr("INTERVAL 30 DAYS")).alias("asof"))
    q = market_products(spark, d).select("product_id").join(volumes(spark, d), "product_id", "left").join(last, "product_id", "left").join(F.broadcast(asof))
    q = q.where("last_at is null or last_at <= asof").withColumn("priority", tiers.scan_priority(F.col("volume"), 20, 8))
    order = [F.when(F.col("priority") == "hot", 0).when(F.col("priority") == "warm", 1).otherwise(2), F.asc_nulls_first("last_at"), F.asc("product_id")]
    top = q.orderBy(*order).limit(100)  # a bounded top-n before the places are numbered
    return price.first_by(top.withColumn("one", F.lit(1)), ["one"], order, 100, "place").select("product_id", "priority", "last_at", "place")


@query(with_sql("market_prices", rest="""SELECT product_id, size, ts, prev_sell, sell, sell - prev_sell AS delta FROM (SELECT product_id, size, ts, sell, lag(sell) OVER (PARTITION BY product_id, size ORDER BY ts, sell) AS prev_sell FROM market_prices)
 WHERE prev_sell IS NOT NULL AND sell <> prev_sell AND NOT (abs(sell - prev_sell) < 1000 AND (prev_sell = 0 OR abs(sell - prev_sell)::DOUBLE / prev_sell < 0.01))"""))
def price_changes_significant(spark: SparkSession, d: str) -> DataFrame:
    out = change.price_changes(market_prices(spark, d), ["product_id", "size"], [F.col("ts"), F.col("sell")], "sell")
    return out.select("product_id", "size", "ts", "prev_sell", "sell", "delta")


@query(with_sql("market_prices", rest="""ch AS (SELECT product_id, size, ts, sell, sell - prev AS delta FROM (SELECT product_id, size, ts, sell, lag(sell) OVER (PARTITION BY product_id, size ORDER BY ts, sell) AS prev FROM market_prices) WHERE prev IS NOT NULL AND sell <> prev
   AND NOT (abs(sell - prev) < 1000 AND (prev = 0 OR abs(sell - prev)::DOUBLE / prev < 0.01)))
 SELECT product_id, max(abs(delta)) AS max_change, arg_min(CASE WHEN delta >= 30000 THEN 'strong_buy' WHEN delta >= 15000 THEN 'buy' WHEN delta >= 5000 THEN 'watch' ELSE 'none' END, {'ts': ts, 's': size, 'd': delta}) AS signal FROM ch WHERE abs(delta) >= 3000 GROUP BY 1"""))
def change_alerts(spark: SparkSession, d: str) -> DataFrame:
    c = change.price_changes(market_prices(spark, d), ["product_id", "size"], [F.col("ts"), F.col("sell")], "sell")
    c = c.where(change.alert_worthy(F.col("delta"), F.lit("x"), F.lit("x"))).withColumn("signal", money.profit_signal(F.col("delta")))
    return change.per_product_change(c, "product_id", "delta", "signal", [F.col("ts"), F.col("size"), F.col("delta")])


@query(with_sql("events", rest="""day AS (SELECT user_id, ts::DATE AS day, count(*) AS volume FROM ev GROUP BY ALL),
 p AS (SELECT *, lag(volume) OVER (PARTITION BY user_id ORDER BY day) AS prev_volume FROM day)
 SELECT user_id, day, prev_volume, volume, CASE WHEN prev_volume = 0 THEN 'infinity'::DOUBLE ELSE round_even(volume::DOUBLE / prev_volume, 2) END AS ratio FROM p
 WHERE (prev_volume = 0 AND volume >= 3) OR (prev_volume > 0 AND volume::DOUBLE / prev_volume >= 2.0)"""))
def volume_spikes(spark: SparkSession, d: str) -> DataFrame:
    day = events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("volume"))
    return change.volume_spikes(day, ["user_id"], [F.col("day")], "volume").select("user_id", "day", "prev_volume", "volume", "ratio")


@query(with_sql("market_prices", rest="""cut AS (SELECT max(ts) - INTERVAL 60 DAY AS c, max(ts) - INTERVAL 730 DAY AS o FROM market_prices),
 a AS (SELECT product_id, max(sell) AS s, count(*) AS n FROM market_prices, cut WHERE ts <= c AND ts > o GROUP BY 1), b AS (SELECT product_id, max(sell) AS s, count(*) AS n FROM market_prices, cut WHERE ts > o + INTERVAL 365 DAY GROUP BY 1)
 SELECT product_id, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'stale' WHEN a.s = b.s AND a.n = b.n THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b USING (product_id)"""))
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    m = market_prices(spark, d)
    m = m.join(F.broadcast(m.agg(F.max("ts").alias("last"))))
    back = lambda n: F.col("last") - F.make_dt_interval(F.lit(n))
    of = lambda x: x.groupBy("product_id").agg(F.max("sell").alias("s"), F.count(F.lit(1)).alias("n"))
    return change.snapshot_diff(of(m.where((F.col("ts") <= back(60)) & (F.col("ts") > back(730)))), of(m.where(F.col("ts") > back(365))), "product_id", ["s", "n"])


@query(with_sql("market_prices", rest="""r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ts DESC, sell, size) AS n FROM market_prices), cut AS (SELECT max(ts) AS m FROM market_prices)
 SELECT product_id, count(*) FILTER (WHERE ts > m - INTERVAL 91 DAY) AS trades_short, count(*) FILTER (WHERE ts > m - INTERVAL 366 DAY) AS trades_long, max(ts) AS last_trade, count(*) AS n,
  CASE WHEN count(*) < 10 THEN '' WHEN sum(sell) FILTER (WHERE n <= 5)::DOUBLE > sum(sell) FILTER (WHERE n BETWEEN 6 AND 10)::DOUBLE * 1.03::DOUBLE THEN 'up'
   WHEN sum(sell) FILTER (WHERE n <= 5)::DOUBLE < sum(sell) FILTER (WHERE n BETWEEN 6 AND 10)::DOUBLE * 0.97::DOUBLE THEN 'down' ELSE 'flat' END AS trend FROM r, cut GROUP BY product_id"""))
def trade_stats_trend(spark: SparkSession, d: str) -> DataFrame:
    m = market_prices(spark, d)
    m = m.join(F.broadcast(m.agg(F.max("ts").alias("asof"))))
    return score.trade_stats(m, "product_id", "ts", "sell", [F.desc("ts"), F.asc("sell"), F.asc("size")], F.col("asof"), (90, 365))


@query(with_sql("market_prices", "retail_prices", rest="""st AS (SELECT product_id, count(*) AS asks FROM retail_prices WHERE in_stock GROUP BY 1), lst AS (SELECT product_id, max(sell) AS sell FROM (SELECT *, max(ts) OVER (PARTITION BY product_id) AS last FROM market_prices) WHERE ts = last GROUP BY 1),
 g AS (SELECT *, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY product_id ORDER BY ts) AS gap FROM market_prices),
 s AS (SELECT product_id, count(*) AS sales, avg(sell) AS mean, stddev_samp(sell) AS sd, median(gap) FILTER (WHERE gap > 0) AS gap, list_sort(list(sell)) AS ps FROM g GROUP BY 1),
 x AS (SELECT product_id, sales::DOUBLE / asks AS r, CASE WHEN sales < 2 THEN 0.5 ELSE 1.0::DOUBLE / (1.0::DOUBLE + sd / mean * 5.0::DOUBLE) END AS volatility, CASE WHEN gap IS NULL THEN 0.0 ELSE 1.0::DOUBLE / (1.0::DOUBLE + gap / 3600.0::DOUBLE / 6.0::DOUBLE) END AS velocity,
  lst.sell AS sell, sales, ps[sales // 4 + 1]::DOUBLE AS p25, ps[sales * 3 // 4 + 1]::DOUBLE AS p75 FROM s JOIN st USING (product_id) JOIN lst USING (product_id)),
 y AS (SELECT product_id, r / (r + 1.0::DOUBLE) AS liquidity, volatility, velocity, CASE WHEN sales < 4 OR p75 <= p25 THEN 0.5 WHEN sell <= p25 THEN 1.0 WHEN sell >= p75 THEN 0.0 ELSE 1.0::DOUBLE - (sell - p25) / (p75 - p25) END AS price_position FROM x),
 z AS (SELECT *, liquidity * 0.35::DOUBLE + volatility * 0.20::DOUBLE + velocity * 0.25::DOUBLE + price_position * 0.20::DOUBLE AS total FROM y)
 SELECT product_id, round(liquidity, 4) AS liquidity, round(volatility, 4) AS volatility, round(velocity, 4) AS velocity, round(price_position, 4) AS price_position, round(total, 4) AS total, total >= 0.45::DOUBLE AS passes,
  array_to_string(list_filter([CASE WHEN liquidity >= 0.7 THEN 'liquid' END, CASE WHEN volatility >= 0.7 THEN 'stable' WHEN volatility <= 0.3 THEN 'volatile' END, CASE WHEN velocity >= 0.7 THEN 'fast' END, CASE WHEN price_position >= 0.7 THEN 'low entry' WHEN price_position <= 0.3 THEN 'high entry' END], lambda x: x IS NOT NULL), '|') AS reasons FROM z"""))
def signal_scores(spark: SparkSession, d: str) -> DataFrame:
    m = market_prices(spark, d)
    asks = retail_prices(spark, d).where("in_stock").groupBy("product_id").agg(F.count(F.lit(1)).alias("asks"))
    last = price.latest_batch(m, ["product_id"], "ts").groupBy("product_id").agg(F.max("sell").alias("sell"))
    s = score.signal_scores(m, asks.join(last, "product_id"), "product_id", "ts", "sell")
    return s.select("product_id", *score.WEIGHTS, "total", "passes", F.array_join("reasons", "|").alias("reasons"))


#: Other weights than the usual ones: a buyer who looks at the price first.
PRICE_FIRST = {"liquidity": 0.25, "volatility": 0.0, "velocity": 0.25, "price_position": 0.5}


def _reweighted(sql: str) -> str:
    usual = "liquidity * 0.35::DOUBLE + volatility * 0.20::DOUBLE + velocity * 0.25::DOUBLE + price_position * 0.20::DOUBLE"
    return f"SELECT product_id, total, passes FROM ({sql.replace(usual, 'liquidity * 0.25::DOUBLE + volatility * 0.0::DOUBLE + velocity * 0.25::DOUBLE + price_position * 0.5::DOUBLE')})"


@query(_reweighted(ORACLE["signal_scores"]))
def signal_weights(spark: SparkSession, d: str) -> DataFrame:
    """Totals and verdicts of the same scores under other weights."""
    m = market_prices(spark, d)
    asks = retail_prices(spark, d).where("in_stock").groupBy("product_id").agg(F.count(F.lit(1)).alias("asks"))
    last = price.latest_batch(m, ["product_id"], "ts").groupBy("product_id").agg(F.max("sell").alias("sell"))
    return score.signal_scores(m, asks.join(last, "product_id"), "product_id", "ts", "sell", weights=PRICE_FIRST).select("product_id", "total", "passes")


@query("""SELECT l_partkey AS product_id, l_linenumber AS size, min(p) FILTER (WHERE side = 'ask') AS best_ask, max(p) FILTER (WHERE side = 'bid') AS best_bid, coalesce(sum(q) FILTER (WHERE side = 'bid'), 0)::BIGINT AS bid_quantity,
 arg_min(p, {'k': l_orderkey, 'p': p}) FILTER (WHERE side = 'sale') AS first_sale FROM (SELECT *, floor(l_extendedprice)::BIGINT AS p, l_quantity::BIGINT AS q, CASE l_returnflag WHEN 'R' THEN 'ask' WHEN 'A' THEN 'bid' ELSE 'sale' END AS side FROM lineitem) GROUP BY ALL""")
def order_book_fold(spark: SparkSession, d: str) -> DataFrame:
    p = F.floor("l_extendedprice").cast("bigint")
    li = read(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_linenumber").alias("size"), p.alias("p"), F.col("l_quantity").cast("bigint").alias("q"),
        F.when(F.col("l_returnflag") == "R", "ask").when(F.col("l_returnflag") == "A", "bid").otherwise("sale").alias("side"), F.struct(F.col("l_orderkey"), p).alias("pos"))
    return price.order_book(li, ["product_id", "size"], "p", "q", F.col("side"), "pos")


@query(with_sql("market_prices", "retail_prices", rest="""a AS (SELECT product_id, size, max(sell) AS sell FROM market_prices GROUP BY ALL), b AS (SELECT product_id, size, min(price) AS price FROM retail_prices GROUP BY ALL)
 SELECT product_id, coalesce(floor(sum(abs(sell - price)) FILTER (WHERE sell > 0 AND price > 0)::DOUBLE / count(*) FILTER (WHERE sell > 0 AND price > 0)), 0)::BIGINT AS spread FROM a LEFT JOIN b USING (product_id, size) GROUP BY 1"""))
def mean_spread(spark: SparkSession, d: str) -> DataFrame:
    a = market_prices(spark, d).groupBy("product_id", "size").agg(F.max("sell").alias("sell"))
    b = retail_prices(spark, d).groupBy("product_id", "size").agg(F.min("price").alias("price"))
    return price.mean_spread(a.join(b, ["product_id", "size"], "left"), ["product_id"], F.col("sell"), F.col("price"))


@query(with_sql("market_products", rest="""s AS (SELECT product_id, CASE product_id % 5 WHEN 0 THEN size WHEN 1 THEN size || 'mm' WHEN 2 THEN ' ' || size || 'CM' WHEN 3 THEN 'One Size' ELSE (product_id % 300)::VARCHAR || '(US9)' END AS raw FROM market_products),
 t AS (SELECT *, trim(regexp_replace(upper(trim(raw)), 'MM|CM', '', 'g')) AS s FROM s),
 c AS (SELECT product_id, raw, CASE WHEN regexp_matches(s, '^[0-9]+([.][0-9]*)?$|^[.][0-9]+$') THEN CASE WHEN s::DOUBLE <= 35 THEN floor(s::DOUBLE * 10)::BIGINT::VARCHAR ELSE floor(s::DOUBLE)::BIGINT::VARCHAR END ELSE s END AS norm,
  CASE WHEN upper(trim(raw)) IN ('FREE', 'F', 'ONE SIZE', 'ONESIZE', 'OS') THEN 'ONE SIZE' ELSE upper(trim(raw)) END AS canon FROM t)
 SELECT product_id, raw, norm, canon, trim(split_part(canon, '(', 1)) AS base, CASE WHEN regexp_matches(norm, '^[0-9]+$') THEN norm::INT ELSE 0 END AS ord FROM c"""))
def size_normalization(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("product_id") % 5
    raw = F.when(k == 0, F.col("size")).when(k == 1, F.concat("size", F.lit("mm"))).when(k == 2, F.concat(F.lit(" "), "size", F.lit("CM"))).when(k == 3, "One Size").otherwise(F.concat((F.col("product_id") % 300).cast("string"), F.lit("(US9)")))
    p = market_products(spark, d).select("product_id", raw.alias("raw")).withColumn("norm", sizes.normalize_size(F.col("raw")))
    return p.select("product_id", "raw", "norm", sizes.canonical_size(F.col("raw")).alias("canon"), sizes.base_size(F.col("raw")).alias("base"), sizes.size_order(F.col("norm")).alias("ord"))


@query(with_sql("market_products", "volumes", rest="""b AS (SELECT product_id, volume, CASE WHEN product_id % 7 = 0 THEN NULL ELSE coalesce(volume, 0) END AS v, product_id % 2 = 0 AS matched FROM market_products LEFT JOIN volumes USING (product_id)),
 t AS (SELECT *, (CASE WHEN v IS NULL THEN 0 WHEN v = 0 THEN CASE WHEN matched THEN 30 ELSE 90 END WHEN v >= 5 THEN 3 ELSE 7 END * 86400)::INT AS base FROM b)
 SELECT product_id, CASE WHEN v IS NULL THEN 'unknown' WHEN v = 0 THEN 'cold' WHEN v >= 5 THEN 'hot' ELSE 'warm' END AS tier, CASE WHEN coalesce(v, 0) >= 10 THEN 'hot' WHEN coalesce(v, 0) >= 3 THEN 'warm' ELSE 'cold' END AS priority,
  base AS interval_s, round(CASE WHEN base <= 0 THEN 0.0 ELSE base + base::DOUBLE * (((('0x' || substr(sha256(product_id::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967295.0::DOUBLE) * 2.0::DOUBLE - 1.0::DOUBLE) * 0.1::DOUBLE) END, 3) AS next_s,
  round(7776000 + 7776000.0::DOUBLE * (((('0x' || substr(sha256('quarantine:v1:' || product_id || ':http_404'), 1, 8))::BIGINT::DOUBLE / 4294967295.0::DOUBLE) * 2.0::DOUBLE - 1.0::DOUBLE) * 0.1::DOUBLE), 3) AS quarantine_s,
  CASE WHEN product_id % 4 <= 1 THEN 21600 WHEN product_id % 4 = 2 THEN 86400 ELSE 604800 END AS backoff_s, CASE WHEN product_id % 4 >= 2 THEN NULL WHEN product_id % 4 = 1 THEN 30 ELSE 7 END AS research_days FROM t"""))
def schedule_jitter(spark: SparkSession, d: str) -> DataFrame:
    p = market_products(spark, d).select("product_id").join(volumes(spark, d), "product_id", "left")
    v = F.when(F.col("product_id") % 7 != 0, F.coalesce("volume", F.lit(0)))
    p = p.withColumn("v", v).withColumn("matched", F.col("product_id") % 2 == 0)
    n = (F.col("product_id") % 4).cast("int")
    return p.select(
        "product_id", tiers.volume_tier(F.col("v")).alias("tier"), tiers.scan_priority(F.col("v"), 10, 3).alias("priority"), tiers.check_interval(F.col("v"), F.col("matched")).alias("interval_s"),
        F.round(tiers.next_check_seconds(F.col("product_id"), F.col("v"), F.col("matched")), 3).alias("next_s"), F.round(tiers.quarantine_seconds(F.col("product_id"), F.lit("http_404")), 3).alias("quarantine_s"),
        tiers.retry_backoff(n).alias("backoff_s"), tiers.research_days(n).alias("research_days"))


@query(with_sql("retail_prices", rest="""f AS (SELECT * FROM retail_prices QUALIFY row_number() OVER (PARTITION BY source, product_id ORDER BY ts, size, price, in_stock) = 1)
 SELECT source, product_id, size, price, ts FROM f"""))
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return upsert.keep_first(retail_prices(spark, d), ["source", "product_id"], [F.col("ts"), F.col("size"), F.col("price"), F.col("in_stock")]).select("source", "product_id", "size", "price", "ts")


@query(with_sql("retail_prices", rest="""f AS (SELECT * FROM retail_prices QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY ts, size, price, source) = 1)
 SELECT source, product_id, price FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts, size, price, product_id) <= 10"""))
def cap_per_group(spark: SparkSession, d: str) -> DataFrame:
    first = upsert.keep_first(retail_prices(spark, d), ["product_id"], [F.col("ts"), F.col("size"), F.col("price"), F.col("source")])
    return upsert.cap_per_group(first, ["product_id"], ["source"], [F.col("ts"), F.col("size"), F.col("price"), F.col("product_id")], 10).select("source", "product_id", "price")


@query("SELECT o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (ORDER BY o_orderdate, o_orderkey) > 25")
def exclude_oldest(spark: SparkSession, d: str) -> DataFrame:
    return upsert.exclude_oldest(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 25)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n, rate FROM (SELECT *, CASE WHEN floor(l_extendedprice)::BIGINT > sale AND sale > 0 THEN round_even(1.0::DOUBLE - sale::DOUBLE / floor(l_extendedprice)::BIGINT::DOUBLE, 3) ELSE 0.0::DOUBLE END AS rate
 FROM (SELECT *, floor(l_extendedprice * (1.0::DOUBLE - l_discount))::BIGINT AS sale FROM lineitem)) GROUP BY l_orderkey, l_linenumber, l_partkey, rate, sale, l_extendedprice""")
def discount_rates(spark: SparkSession, d: str) -> DataFrame:
    sale, full = F.floor(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).cast("bigint"), F.floor("l_extendedprice").cast("bigint")
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", money.discount_rate(sale, full).alias("rate"), sale.alias("sale"), "l_extendedprice")
    return li.groupBy("l_orderkey", "l_linenumber", "l_partkey", "rate", "sale", "l_extendedprice").agg(F.count(F.lit(1)).alias("n")).select("l_orderkey", "l_linenumber", "l_partkey", "n", "rate")

