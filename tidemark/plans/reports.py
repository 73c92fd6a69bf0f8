"""Counts, shares, funnels and summaries over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tiers, times
from ..operators import gates, report
from ..views import events, market_products, read, retail_prices, retail_products, with_sql
from .registry import query


@query(with_sql("market_products", "retail_prices", rest="SELECT product_id, name FROM market_products WHERE product_id IN (SELECT product_id FROM retail_prices WHERE in_stock) ORDER BY name DESC, product_id LIMIT 40"))
def matched_products_semi(spark: SparkSession, d: str) -> DataFrame:
    r = retail_prices(spark, d).where("in_stock")
    return market_products(spark, d).select("product_id", "name").join(r, "product_id", "left_semi").orderBy(F.desc("name"), "product_id").limit(40)


@query(with_sql("market_products", "retail_prices", rest="SELECT count(DISTINCT product_id) AS matched FROM market_products JOIN retail_prices USING (product_id) WHERE in_stock"))
def matched_count(spark: SparkSession, d: str) -> DataFrame:
    return market_products(spark, d).join(retail_prices(spark, d).where("in_stock"), "product_id", "left_semi").agg(F.count(F.lit(1)).alias("matched"))


@query(with_sql("retail_prices", rest="""s AS (SELECT source, product_id, count(*) AS seen, max(ts) AS last_at FROM retail_prices GROUP BY ALL), k AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS product_id FROM lineitem WHERE l_returnflag = 'R')
 SELECT source, product_id, seen, last_at FROM s ANTI JOIN k USING (source, product_id) ORDER BY seen DESC, last_at DESC, source, product_id LIMIT 50"""))
def unmatched_topk(spark: SparkSession, d: str) -> DataFrame:
    seen = retail_prices(spark, d).groupBy("source", "product_id").agg(F.count(F.lit(1)).alias("seen"), F.max("ts").alias("last_at"))
    known = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("product_id"))
    return seen.join(known, ["source", "product_id"], "left_anti").orderBy(F.desc("seen"), F.desc("last_at"), "source", "product_id").limit(50)


@query(with_sql("market_products", "retail_prices", rest="""SELECT product_id, brand, category, lower(brand) IN ('brand#11', 'brand#24') AS skipped, EXISTS (SELECT 1 FROM retail_prices r WHERE r.product_id = m.product_id AND in_stock) AS matched FROM market_products m WHERE category LIKE 'PROMO%'
 AND NOT (lower(brand) NOT IN ('brand#11', 'brand#24') AND NOT EXISTS (SELECT 1 FROM retail_prices r WHERE r.product_id = m.product_id AND in_stock))"""))
def closed_products(spark: SparkSession, d: str) -> DataFrame:
    """Products of a kind that need no look, and why: of a skipped brand, matched already, or both. One pass over the
    products tells both; the stock is reduced to a row per product first."""
    skipped = F.lower("brand").isin("brand#11", "brand#24")
    known = retail_prices(spark, d).where("in_stock").groupBy("product_id").agg(F.lit(True).alias("hit"))
    rows = market_products(spark, d).where("category like 'PROMO%'").join(known, "product_id", "left").withColumn("skipped", skipped).withColumn("matched", F.coalesce("hit", F.lit(False)))
    return rows.where("skipped or matched").select("product_id", "brand", "category", "skipped", "matched")


@query(with_sql("market_products", "retail_prices", "retail_products", rest="""SELECT source, count(*) AS dumped, count(*) FILTER (WHERE product_id IN (SELECT product_id FROM market_products WHERE category NOT LIKE 'PROMO%')) AS matched,
 round_even(count(*) FILTER (WHERE product_id IN (SELECT product_id FROM market_products WHERE category NOT LIKE 'PROMO%'))::DOUBLE * 100.0::DOUBLE / count(*)::DOUBLE, 2) AS pct FROM retail_products GROUP BY 1"""))
def match_rate_by_source(spark: SparkSession, d: str) -> DataFrame:
    known = market_products(spark, d).where("category not like 'PROMO%'").select("product_id", F.lit(True).alias("hit"))
    g = retail_products(spark, d).join(known, "product_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("dumped"), F.count_if("hit").alias("matched"))
    return g.withColumn("pct", report.percent(F.col("matched"), F.col("dumped")))


@query(with_sql("retail_prices", rest="SELECT source, count(DISTINCT product_id) AS items, (SELECT count(*) FROM part) AS total, round_even(count(DISTINCT product_id)::DOUBLE * 100.0::DOUBLE / (SELECT count(*) FROM part)::DOUBLE, 2) AS pct FROM retail_prices GROUP BY 1"))
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    return report.coverage(retail_prices(spark, d), "source", "product_id", read(spark, d, "part"))


@query("SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, brand LIMIT 10")
def brand_topk(spark: SparkSession, d: str) -> DataFrame:
    return report.top_counts(read(spark, d, "part"), F.col("p_brand"), "brand", 10)


@query("SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 80")
def brand_having(spark: SparkSession, d: str) -> DataFrame:
    return report.top_counts(read(spark, d, "part"), F.col("p_brand"), "brand", least=80)


@query("SELECT DISTINCT regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS slug FROM part")
def brand_slugs(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import brand_slug

    return read(spark, d, "part").select(brand_slug(F.col("p_brand")).alias("slug")).distinct()


@query("""SELECT count(*) AS total, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS returned, count(*) FILTER (WHERE l_linestatus = 'O' AND l_discount > 0.05) AS open_discounted,
 sum(CASE WHEN l_returnflag = 'A' THEN floor(l_extendedprice)::BIGINT ELSE 0 END)::BIGINT AS accepted_value, max(l_shipdate) AS last_at FROM lineitem""")
def queue_stats_conditional(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"), F.count_if((F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.05)).alias("open_discounted"),
        F.sum(F.when(F.col("l_returnflag") == "A", F.floor("l_extendedprice").cast("bigint")).otherwise(0)).alias("accepted_value"), F.max("l_shipdate").alias("last_at"))


@query("SELECT ts::DATE AS day, count(*) AS n, round(avg(floor(value * 100)::BIGINT), 4) AS mean_cents, max(floor(value * 100)::BIGINT) AS most_cents FROM events GROUP BY 1")
def daily_profit_series(spark: SparkSession, d: str) -> DataFrame:
    cents = F.floor(F.col("value") * 100).cast("bigint")
    return events(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(cents), 4).alias("mean_cents"), F.max(cents).alias("most_cents"))


@query(with_sql("events", rest="SELECT coalesce(nullif(CASE WHEN k < 10 THEN NULL WHEN k < 20 THEN '' ELSE event_type END, ''), '-') AS signal, count(*) AS n FROM ev GROUP BY 1"))
def signal_distribution(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("k") < 10, F.lit(None)).when(F.col("k") < 20, "").otherwise(F.col("event_type"))
    return report.top_counts(events(spark, d), report.folded(raw), "signal")


@query("""SELECT e.event_id, e.ts, e.event_type, c.c_name AS name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_mktsegment <> 'HOUSEHOLD'
 WHERE e.ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR ORDER BY e.ts DESC, e.event_id LIMIT 100""")
def alert_feed_left_join(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "ts", "event_type", "user_id")
    recent = e.join(F.broadcast(e.agg(F.max("ts").alias("asof"))), times.within_hours(F.col("ts"), F.col("asof"), 24))
    c = read(spark, d, "customer").where("c_mktsegment <> 'HOUSEHOLD'").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return recent.join(c, "user_id", "left").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "ts", "event_type", "name")


@query(with_sql("events", rest="""SELECT event_type, count(*) FILTER (WHERE k < 30) AS pending, count(*) FILTER (WHERE k >= 30 AND k < 90) AS consumed, count(*) FILTER (WHERE k >= 90) AS failed FROM ev GROUP BY 1"""))
def pipeline_counters(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("k") < 30, "pending").when(F.col("k") < 90, "consumed").otherwise("failed")
    g = events(spark, d).withColumn("status", status).groupBy("event_type").pivot("status", ["pending", "consumed", "failed"]).agg(F.count(F.lit(1)))
    return g.fillna(0)


@query(with_sql("events", rest="""g AS (SELECT event_type AS stage, CASE WHEN k < 50 THEN 'pass' ELSE 'block' END AS decision, 'r' || (k % 7) AS reason, count(*) AS n FROM ev GROUP BY ALL)
 SELECT stage, decision, reason, n, sum(n) OVER (PARTITION BY stage, decision)::BIGINT AS total, row_number() OVER (PARTITION BY stage, decision ORDER BY n DESC, reason)::INT AS place FROM g QUALIFY place <= 3"""))
def decision_summary_topn(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("event_type").alias("stage"), F.when(F.col("k") < 50, "pass").otherwise("block").alias("decision"), F.concat(F.lit("r"), (F.col("k") % 7).cast("string")).alias("reason"))
    return report.top_per_class(e, ["stage", "decision"], "reason", 3)


@query(with_sql("events", rest="SELECT event_type AS stage, CASE WHEN k < 50 THEN 'pass' ELSE 'block' END AS decision, count(*) AS n FROM ev GROUP BY ROLLUP (stage, decision)"))
def decision_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("event_type").alias("stage"), F.when(F.col("k") < 50, "pass").otherwise("block").alias("decision"))
    return e.rollup("stage", "decision").agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("events", rest="""SELECT user_id % 20 AS source, count(*) FILTER (WHERE k < 70) AS consumed, count(*) FILTER (WHERE k >= 70 AND k < 90) AS deferred, count(*) FILTER (WHERE k >= 90) AS failed, sum(k)::BIGINT AS products, max(ts) AS last_at,
 round_even(count(*) FILTER (WHERE k < 70)::DOUBLE * 100.0::DOUBLE / count(*)::DOUBLE, 2) AS success_pct FROM ev WHERE event_type = 'view' GROUP BY 1"""))
def adapter_health_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    g = events(spark, d).where("event_type = 'view'").groupBy((F.col("user_id") % 20).alias("source")).agg(
        F.count_if(k < 70).alias("consumed"), F.count_if((k >= 70) & (k < 90)).alias("deferred"), F.count_if(k >= 90).alias("failed"), F.sum("k").alias("products"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("success_pct", report.percent(F.col("consumed"), F.col("n"))).drop("n")


@query(with_sql("events", rest="SELECT user_id % 20 AS source, count(*) FILTER (WHERE event_type = 'click') AS candidates, count(*) FILTER (WHERE event_type = 'purchase') AS profits, coalesce(sum(k) FILTER (WHERE event_type = 'purchase'), 0)::BIGINT AS profit FROM ev WHERE event_type IN ('click', 'purchase') GROUP BY 1"))
def source_breakdown_json(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where(F.col("event_type").isin("click", "purchase"))
    return e.groupBy((F.col("user_id") % 20).alias("source")).agg(
        F.count_if(F.col("event_type") == "click").alias("candidates"), F.count_if(F.col("event_type") == "purchase").alias("profits"), F.sum(F.when(F.col("event_type") == "purchase", F.col("k")).otherwise(0)).alias("profit"))


@query("""WITH li AS (SELECT l_orderkey AS k, max(floor(l_extendedprice)::BIGINT) AS actual FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, o_orderstatus <> 'P' AS checked, o_orderstatus = 'F' AS sold, floor(o_totalprice / 8)::BIGINT AS fired FROM orders)
 SELECT count(*) AS total, count(*) FILTER (WHERE checked) AS checked, count(*) FILTER (WHERE checked AND sold) AS sold, round(count(*) FILTER (WHERE checked AND sold)::DOUBLE / nullif(count(*) FILTER (WHERE checked), 0), 4) AS hit_rate,
 round(sum(actual - fired) FILTER (WHERE checked AND sold)::DOUBLE / nullif(count(*) FILTER (WHERE checked AND sold), 0), 2) AS mean_gap FROM o LEFT JOIN li USING (k)""")
def hit_rate_summary(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max(F.floor("l_extendedprice").cast("bigint")).alias("actual"))
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") != "P").alias("checked"), (F.col("o_orderstatus") == "F").alias("sold"), F.floor(F.col("o_totalprice") / 8).cast("bigint").alias("fired"))
    return report.hit_rate(o.join(li, "k", "left"), F.col("checked"), F.col("sold"), F.col("fired"), F.col("actual"))


@query(with_sql("events", rest="""s AS (SELECT user_id, list_sort(list(k)) AS v, count(*) AS n FROM ev GROUP BY 1)
 SELECT user_id, n, v[1] AS least, v[n // 2 + 1] AS p50, CASE WHEN n >= 20 THEN v[floor(n * 95 / 100)::INT + 1] END AS p95, v[-1] AS greatest FROM s"""))
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return report.order_stats(events(spark, d), ["user_id"], "k")


@query(with_sql("events", rest="""u AS (SELECT count(*) FILTER (WHERE NOT (k IS NOT DISTINCT FROM 59)) AS used, count(*) FILTER (WHERE event_type IN ('view', 'click') AND NOT (k IS NOT DISTINCT FROM 59)) AS bg FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 24 HOUR)
 SELECT used, bg, greatest(0, least(500 - bg, 1000 - used - 50)) AS allowance FROM u"""))
def budget_allowance(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("asof"))), times.within_hours(F.col("ts"), F.col("asof"), 24))
    sent = gates.sent_status(F.col("k"), 59)
    u = e.agg(F.count_if(sent).alias("used"), F.count_if(sent & gates.purpose_in(F.col("event_type"), ["view", "click"])).alias("bg"))
    return u.withColumn("allowance", report.allowance(F.lit(500), F.lit(1000), F.lit(50), F.col("used"), F.col("bg")))


@query("""WITH b AS (SELECT l_suppkey AS s, max(l_shipdate) AS last_at FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
 SELECT s_suppkey AS source, last_at FROM supplier LEFT JOIN b ON s = s_suppkey WHERE last_at IS NULL OR last_at <= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 72 HOUR""")
def silent_sources(spark: SparkSession, d: str) -> DataFrame:
    beats = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_shipdate").alias("at"), "l_linestatus")
    asof = beats.agg(F.max("at").alias("asof"))
    expected = read(spark, d, "supplier").select(F.col("s_suppkey").alias("source")).join(F.broadcast(asof))
    return report.silent_sources(expected, beats.where("l_linestatus = 'O'"), "source", "at", F.col("asof"), 72).select("source", "last_at")


@query("""WITH f AS (SELECT avg((coalesce(trim(text) <> '', false))::INT::DOUBLE) AS text, avg((coalesce(trim(CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE lang END) <> '', false))::INT::DOUBLE) AS lang, avg((coalesce(trim(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END) <> '', false))::INT::DOUBLE) AS source FROM documents)
 SELECT field, round(fill_rate, 9) AS fill_rate FROM (UNPIVOT f ON text, lang, source INTO NAME field VALUE fill_rate)""")
def fill_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("text", F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"))
    return report.fill_rates(docs, ["text", "lang", "source"]).select("field", F.round("fill_rate", 9).alias("fill_rate"))


@query("""WITH c AS (SELECT event_type AS source, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, lag(n) OVER (PARTITION BY source ORDER BY day) AS prev FROM c)
 SELECT source, day, prev, n, n < prev * 0.8::DOUBLE AS dropped FROM p WHERE prev IS NOT NULL""")
def volume_drop_check(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    p = c.withColumn("prev", F.lag("n").over(Window.partitionBy("source").orderBy("day"))).where("prev is not null")
    return p.select("source", "day", "prev", "n", (F.col("n") < F.col("prev") * F.lit(0.8)).alias("dropped"))


@query(with_sql("market_products", "retail_prices", "volumes", rest="""c AS (SELECT CASE WHEN product_id IN (SELECT product_id FROM retail_prices WHERE in_stock) THEN 'A' WHEN substr(model_number, 1, 7) IN (SELECT DISTINCT substr(model_number, 1, 7) FROM market_products WHERE product_id % 50 = 0) THEN 'B' WHEN coalesce(volume, 0) = 0 THEN 'C' WHEN volume >= 10 THEN 'D' END AS b FROM market_products LEFT JOIN volumes USING (product_id))
 SELECT bucket, count(b) AS n FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(bucket) LEFT JOIN c ON b = bucket GROUP BY 1"""))
def coverage_buckets(spark: SparkSession, d: str) -> DataFrame:
    from ..views import volumes

    m = market_products(spark, d)
    a = retail_prices(spark, d).where("in_stock").select("product_id").distinct().withColumn("a", F.lit(True))
    b = m.where("product_id % 50 = 0").select(F.substring("model_number", 1, 7).alias("p")).distinct().withColumn("b", F.lit(True))
    j = m.withColumn("p", F.substring("model_number", 1, 7)).join(a, "product_id", "left").join(b, "p", "left").join(volumes(spark, d), "product_id", "left")
    v = F.coalesce("volume", F.lit(0))
    return report.buckets(j, F.when(F.col("a"), "A").when(F.col("b"), "B").when(v == 0, "C").when(v >= 10, "D"), ["A", "B", "C", "D", "E"])


@query(with_sql("events", rest="SELECT event_type AS source, count(*) AS errors, arg_max(props, {'t': ts, 'i': event_id}) AS last_error FROM ev WHERE k > 60 AND ts >= (SELECT max(ts) FROM ev) - INTERVAL 240 HOUR GROUP BY 1"))
def error_summary(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("asof"))), times.within_hours(F.col("ts"), F.col("asof"), 240)).where("k > 60")
    return e.groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("errors"), F.max_by("props", F.struct("ts", "event_id")).alias("last_error"))


@query("""SELECT 'orders' AS t, count(*) AS n, max(o_orderdate) AS last_at FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' UNION ALL SELECT 'lineitem', count(*), max(l_shipdate) FROM lineitem WHERE l_shipdate > TIMESTAMP '1997-01-01'
 UNION ALL SELECT 'events', count(*), max(ts) FROM events WHERE ts > TIMESTAMP '1997-01-01'""")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    since = F.lit("1997-01-01").cast("timestamp_ntz")
    out = None
    for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")):
        one = read(spark, d, t).where(F.col(c) > since).agg(F.count(F.lit(1)).alias("n"), F.max(c).alias("last_at")).select(F.lit(t).alias("t"), "n", "last_at")
        out = one if out is None else out.unionByName(one)
    return out


@query(with_sql("events", rest="""SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n FROM ev GROUP BY ALL"""))
def hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start")).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("events", rest="SELECT *, sum(n) OVER (PARTITION BY user_id)::BIGINT AS total_user, sum(n) OVER (PARTITION BY event_type)::BIGINT AS total_type FROM (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY ALL)"))
def extension_window_totals(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("total_user", F.sum("n").over(Window.partitionBy("user_id"))).withColumn("total_type", F.sum("n").over(Window.partitionBy("event_type")))


@query(with_sql("market_products", "volumes", rest="SELECT product_id, CASE WHEN coalesce(volume, 0) >= 5 THEN 'hot' WHEN coalesce(volume, 0) >= 3 THEN 'warm' ELSE 'cold' END AS priority, CASE WHEN coalesce(volume, 0) >= 5 THEN 'hot' ELSE 'cold' END AS refresh_tier FROM market_products LEFT JOIN volumes USING (product_id)"))
def tier_reclassify(spark: SparkSession, d: str) -> DataFrame:
    from ..views import volumes

    j = market_products(spark, d).select("product_id").join(volumes(spark, d), "product_id", "left")
    return j.select("product_id", tiers.scan_priority(F.col("volume")).alias("priority"), tiers.refresh_tier(F.col("volume")).alias("refresh_tier"))
