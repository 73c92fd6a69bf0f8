"""Source checks, follow-ups, queue states and set operations over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tiers, times
from ..operators import change, price, quality, upsert
from ..operators.match import exploded_keys
from ..views import events, market_prices, market_products, read, retail_prices, volumes, with_sql
from .registry import query


@query("""SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD') OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09) AS wanted FROM orders""")
def exists_flags(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").where("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("o_custkey"))
    li = read(spark, d, "lineitem").where("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    o = quality.exists_flag(read(spark, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey", "a")
    return quality.exists_flag(o, li, "o_orderkey", "b").select("o_orderkey", (F.col("a") | F.col("b")).alias("wanted"))


@query(with_sql("events", rest="""s AS (SELECT event_type, user_id % 40 AS page, list_sort(list_distinct(list(k % 3))) AS items FROM ev GROUP BY ALL)
 SELECT event_type, page, coalesce(items = lag(items) OVER (PARTITION BY event_type ORDER BY page), false) AS repeated FROM s"""))
def repeated_pages(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_type", (F.col("user_id") % 40).alias("page"), (F.col("k") % 3).alias("item"))
    return quality.repeated_pages(e, "event_type", "page", "item")


@query("""SELECT b.item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text)""")
def missing_canaries(spark: SparkSession, d: str) -> DataFrame:
    b, docs = read(spark, d, "benchmark"), read(spark, d, "documents").select("text")
    return quality.missing_canaries(b, docs, ["text"]).select("item_id")


@query("""WITH g AS (SELECT unnest(list_filter([CASE WHEN p_name LIKE 'red%' OR p_name LIKE '%bolt' THEN 'a' END, CASE WHEN p_type LIKE '%' AND p_name LIKE '%ring%' THEN 'b' END], lambda x: x IS NOT NULL)) AS name, p_partkey % 3 = 0 AS hit FROM part)
 SELECT name, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, round_even(count(*) FILTER (WHERE hit)::DOUBLE * 100.0::DOUBLE / count(*)::DOUBLE, 2) AS pct FROM g GROUP BY 1""")
def brand_pattern_cover(spark: SparkSession, d: str) -> DataFrame:
    return quality.pattern_cover(read(spark, d, "part"), F.col("p_name"), {"a": ["red%", "%bolt"], "b": ["%ring%"]}, F.col("p_partkey") % 3 == 0)


@query("""SELECT p_brand AS brand, count(*) AS seen, count(*) FILTER (WHERE p_size > 5) AS sized, count(*) FILTER (WHERE p_size > 5 AND p_type <> 'ECONOMY') AS typed, count(*) FILTER (WHERE p_size > 5 AND p_type <> 'ECONOMY' AND p_partkey % 2 = 0) AS matched FROM part GROUP BY 1""")
def brand_funnel(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").withColumnRenamed("p_brand", "brand")
    return quality.funnel(p, "brand", {"sized": F.col("p_size") > 5, "typed": F.col("p_type") != "ECONOMY", "matched": F.col("p_partkey") % 2 == 0})


@query("""WITH f AS (SELECT o_orderkey AS id, o_custkey AS pid, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 7 + 1)::INT END AS size, o_orderdate AS fired_at, floor(o_totalprice / 6)::BIGINT AS fired_price FROM orders),
 s AS (SELECT l_partkey AS pid, l_linenumber AS ss, l_shipdate AS sold_at, floor(l_extendedprice)::BIGINT AS price FROM lineitem),
 j AS (SELECT id, f.pid, size, fired_price, max(price) FILTER (WHERE sold_at > fired_at AND (size IS NULL OR size = ss)) AS best FROM f LEFT JOIN s ON f.pid = s.pid GROUP BY ALL)
 SELECT id, pid, size, best, coalesce(best >= fired_price, false) AS sold FROM j""")
def followup_sold(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    f = read(spark, d, "orders").select(o.alias("id"), F.col("o_custkey").alias("pid"), F.when(o % 3 != 0, (o % 7 + 1).cast("int")).alias("size"), F.col("o_orderdate").alias("fired_at"), F.floor(F.col("o_totalprice") / 6).cast("bigint").alias("fired_price"))
    s = read(spark, d, "lineitem").select(F.col("l_partkey").alias("pid"), F.col("l_linenumber").alias("size"), F.col("l_shipdate").alias("sold_at"), F.floor("l_extendedprice").cast("bigint").alias("price"))
    return quality.sold_after(f, s, "pid", "size", "fired_at", "fired_price", "sold_at", "price").select("id", "pid", "size", "best", "sold")


@query("SELECT o_orderkey AS id, o_orderdate AS fired_at FROM orders WHERE o_orderstatus = 'P' AND o_orderdate <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 1 DAY ORDER BY o_orderdate, o_orderkey LIMIT 200")
def pending_followups(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    o = o.join(F.broadcast(o.agg(F.max("o_orderdate").alias("asof")))).where((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") <= F.col("asof") - F.expr("INTERVAL 1 DAY")))
    return o.orderBy("o_orderdate", "o_orderkey").limit(200).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("fired_at"))


@query(with_sql("market_products", "volumes", rest="""b AS (SELECT product_id, volume, CASE product_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END AS status, (product_id % 4)::INT AS attempts FROM market_products LEFT JOIN volumes USING (product_id)),
 s AS (SELECT *, CASE WHEN status = 200 AND volume IS NOT NULL THEN 'known' WHEN status = 200 THEN 'bad' WHEN status = 404 THEN 'gone' ELSE 'retry' END AS state FROM b)
 SELECT product_id, state, CASE WHEN state = 'known' THEN CASE WHEN volume >= 5 THEN 'hot' WHEN volume = 0 THEN 'cold' ELSE 'warm' END END AS tier,
 CASE WHEN state = 'known' THEN CASE WHEN volume >= 5 THEN 259200 ELSE 604800 END WHEN state = 'gone' THEN 7776000 WHEN attempts + 1 <= 1 THEN 21600 WHEN attempts + 1 = 2 THEN 86400 ELSE 604800 END AS wait_s, CASE WHEN state = 'known' THEN 0 ELSE attempts + 1 END AS attempts_after FROM s"""))
def volume_states(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("product_id") % 5
    b = market_products(spark, d).select("product_id").join(volumes(spark, d), "product_id", "left").withColumn("status", F.when(k == 0, 404).when(k == 1, 500).otherwise(200)).withColumn("attempts", (F.col("product_id") % 4).cast("int"))
    b = b.withColumn("state", tiers.http_state(F.col("status"), F.col("volume").isNotNull()))
    return quality.apply_state(b, F.col("state"), F.col("volume"), F.lit(True), F.col("attempts")).select("product_id", "state", "tier", "wait_s", "attempts_after")


@query(with_sql("market_products", "volumes", rest="""c AS (SELECT product_id, CASE WHEN coalesce(volume, 0) >= 30 THEN 7200 WHEN coalesce(volume, 0) >= 20 THEN 21600 ELSE 86400 END AS s, row_number() OVER (ORDER BY coalesce(volume, 0) DESC, product_id) AS n FROM market_products LEFT JOIN volumes USING (product_id))
 SELECT product_id, s, n <= 30 AS first, CASE WHEN n <= 30 THEN 0 ELSE ('0x' || substr(md5(product_id::VARCHAR), 1, 8))::BIGINT % 1000 * s // 1000 END AS wait_s FROM c"""))
def backfill_schedule(spark: SparkSession, d: str) -> DataFrame:
    v = F.coalesce("volume", F.lit(0))
    p = market_products(spark, d).select("product_id").join(volumes(spark, d), "product_id", "left").select("product_id", v.alias("v"), F.when(v >= 30, 7200).when(v >= 20, 21600).otherwise(86400).alias("s"))
    out = quality.spread_schedule(p, [F.desc("v"), F.asc("product_id")], 30, F.col("product_id"), F.col("s"))
    first = p.orderBy(F.desc("v"), "product_id").limit(30).select("product_id", F.lit(True).alias("first"))
    return out.join(F.broadcast(first), "product_id", "left").select("product_id", "s", F.coalesce("first", F.lit(False)).alias("first"), "wait_s")


@query("""SELECT page_id, CASE WHEN contains(html, 'lang="de"') OR contains(html, '?page=2') THEN 'offline' WHEN regexp_matches(html, 'track\\([0-9]*7\\)') THEN 'upcoming' ELSE 'open' END AS state FROM pages""")
def page_states(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", quality.page_state(F.col("html"), ['lang="de"', "?page=2"], r"track\([0-9]*7\)").alias("state"))


@query(with_sql("events", rest="SELECT event_type, count(*) AS n, floor(count(*) * 0.5::DOUBLE)::BIGINT AS best, floor(count(*) * 0.25::DOUBLE)::BIGINT AS expected, floor(count(*) * 0.125::DOUBLE)::BIGINT AS worst FROM ev GROUP BY 1"))
def estimate_ranges(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select("event_type", "n", *quality.expect_range(F.col("n"), 0.5, 0.25, 0.125))


@query(with_sql("events", rest="SELECT event_type, user_id, event_id, value FROM (SELECT * FROM ev WHERE k >= 20 QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1) ORDER BY value DESC, event_id LIMIT 60"))
def alert_feed_last(spark: SparkSession, d: str) -> DataFrame:
    last = price.latest_row(events(spark, d).where("k >= 20"), ["event_type", "user_id"], [F.col("ts"), F.col("event_id")])
    return last.orderBy(F.desc("value"), "event_id").limit(60).select("event_type", "user_id", "event_id", "value")


@query("SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    pick = lambda f: li.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("id"))
    return pick("R").exceptAll(pick("A"))


@query("SELECT l_partkey AS id, l_suppkey AS source FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    pick = lambda f: li.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("source"))
    return pick("R").intersect(pick("A"))


@query(with_sql("events", rest="SELECT event_id, k, user_id FROM ev WHERE k < 30 OR k IN (40, 41) ORDER BY event_id LIMIT 500"))
def pending_events(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where((F.col("k") < 30) | F.col("k").isin(40, 41))
    return e.orderBy("event_id").limit(500).select("event_id", "k", "user_id")


@query(with_sql("events", rest="SELECT event_type, n = 0 AS stalled FROM (SELECT event_type, count(*) FILTER (WHERE ts >= m - INTERVAL 1 HOUR) AS n FROM ev, (SELECT max(ts) AS m FROM ev) GROUP BY 1)"))
def stalled_stages(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("asof"))))
    g = e.groupBy("event_type").agg(F.count_if(times.within_hours(F.col("ts"), F.col("asof"), 1)).alias("n"))
    return g.select("event_type", (F.col("n") == 0).alias("stalled"))


@query(with_sql("market_products", "volumes", rest="SELECT try_cast(CASE WHEN product_id % 11 = 0 THEN 'x' ELSE product_id::VARCHAR END AS BIGINT) AS id, volume FROM market_products JOIN volumes USING (product_id) WHERE volume >= 5 AND product_id % 11 <> 0 ORDER BY volume DESC, product_id LIMIT 130"))
def watch_targets(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("product_id") % 11 == 0, "x").otherwise(F.col("product_id").cast("string"))
    p = market_products(spark, d).join(volumes(spark, d), "product_id").where("volume >= 5").select(raw.try_cast("bigint").alias("id"), "volume")
    return p.where("id is not null").orderBy(F.desc("volume"), "id").limit(130)


@query(with_sql("market_prices", "retail_prices", rest="""m AS (SELECT product_id, min(sell) FILTER (WHERE sell > 0 AND sell < 8000000) AS best FROM market_prices GROUP BY 1), r AS (SELECT product_id, min(price) FILTER (WHERE price > 0) AS cost FROM retail_prices WHERE in_stock GROUP BY 1)
 SELECT product_id, best, cost, best - cost AS gap FROM m JOIN r USING (product_id) ORDER BY gap DESC NULLS LAST, product_id LIMIT 10"""))
def watchlist_gap(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.money import real_price

    m = market_prices(spark, d).groupBy("product_id").agg(F.min(real_price(F.col("sell"))).alias("best"))
    r = retail_prices(spark, d).where("in_stock").groupBy("product_id").agg(F.min(F.when(F.col("price") > 0, F.col("price"))).alias("cost"))
    return m.join(r, "product_id").withColumn("gap", F.col("best") - F.col("cost")).orderBy(F.desc_nulls_last("gap"), "product_id").limit(10)


@query(with_sql("market_prices", rest="""h AS (SELECT product_id, max(sell) AS s FROM market_prices GROUP BY 1), o AS (SELECT product_id, s FROM h WHERE product_id % 3 = 0), c AS (SELECT product_id FROM h ANTI JOIN o USING (product_id) ORDER BY product_id LIMIT 30)
 SELECT product_id, product_id IN (SELECT product_id FROM c) AS now FROM h WHERE product_id % 3 <> 0"""))
def capped_changes(spark: SparkSession, d: str) -> DataFrame:
    h = market_prices(spark, d).groupBy("product_id").agg(F.max("sell").alias("s"))
    fresh = upsert.delete_keys(h, h.where("product_id % 3 = 0"), ["product_id"]).select("product_id")
    now, later = change.cap_changes(fresh, "product_id", 30)
    return now.withColumn("now", F.lit(True)).unionByName(later.withColumn("now", F.lit(False)))


@query(with_sql("market_products", rest="""s AS (SELECT product_id, CASE WHEN product_id % 2 = 0 THEN model_number || '/Q' || product_id ELSE model_number END AS m FROM market_products)
 SELECT product_id, regexp_replace(p, '-', '', 'g') AS key, lvl AS level FROM (SELECT product_id, m AS p, 0 AS lvl FROM s UNION ALL SELECT product_id, unnest(string_split(m, '/')), 1 FROM s WHERE m LIKE '%/%')"""))
def model_key_index(spark: SparkSession, d: str) -> DataFrame:
    m = F.when(F.col("product_id") % 2 == 0, F.concat("model_number", F.lit("/Q"), F.col("product_id").cast("string"))).otherwise(F.col("model_number"))
    return exploded_keys(market_products(spark, d).select("product_id", m.alias("m")), "m").select("product_id", "key", "level")


@query(with_sql("events", rest="SELECT event_id, k, sum(k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)::BIGINT AS last5, dense_rank() OVER (PARTITION BY user_id ORDER BY k) AS rank FROM ev"))
def extension_windows(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    return events(spark, d).select("event_id", "k", F.sum("k").over(w.orderBy("ts", "event_id").rowsBetween(-4, 0)).alias("last5"), F.dense_rank().over(w.orderBy("k")).cast("bigint").alias("rank"))


@query("""SELECT o.o_orderkey, e.ts AS at, e.event_id FROM (SELECT o_orderkey, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (o_orderkey % 43200) AS t FROM orders) o ASOF JOIN (SELECT ts, max(event_id) AS event_id FROM events GROUP BY ts) e ON o.t >= e.ts""")
def extension_asof(spark: SparkSession, d: str) -> DataFrame:
    """As-of join without pairs: both sides in one table by hour; the last event of each hour is carried by a window over
    the hours, the last within the hour by a window inside it."""
    t = F.lit("2024-01-01").cast("timestamp_ntz")
    o = read(spark, d, "orders").select("o_orderkey", (t + F.make_dt_interval(F.lit(0), F.lit(0), F.col("o_orderkey").cast("int") % 43200)).alias("t"), F.lit(None).cast("bigint").alias("event_id"), F.lit(1).alias("kind"))
    e = read(spark, d, "events").groupBy(F.col("ts").alias("t")).agg(F.max("event_id").alias("event_id")).select(F.lit(None).cast("bigint").alias("o_orderkey"), "t", "event_id", F.lit(0).alias("kind"))
    both = o.unionByName(e).withColumn("h", F.date_trunc("hour", "t").cast("timestamp_ntz"))
    mark = F.when(F.col("kind") == 0, F.struct("t", "event_id"))
    inner = F.last(mark, ignorenulls=True).over(Window.partitionBy("h").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    hours = both.groupBy("h").agg(F.max(mark).alias("_l"))
    carried = F.last("_l", ignorenulls=True).over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1))  # a row per hour only
    out = both.withColumn("_in", inner).where("kind = 1").join(hours.select("h", carried.alias("_before")), "h")
    return out.withColumn("x", F.coalesce("_in", "_before")).where("x is not null").select("o_orderkey", F.col("x.t").alias("at"), F.col("x.event_id").alias("event_id"))
