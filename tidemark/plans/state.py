"""Upserts, retention and stateful folds over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import upsert
from ..streaming import folds
from ..views import events, read, with_sql
from .registry import query

HOURS6 = 6 * 3600


@query(with_sql("events", rest="SELECT user_id, event_type, value, ts FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"))
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", "user_id", "event_type", "value", "ts")
    out = upsert.upsert_latest(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    return out.select("user_id", "event_type", "value", "ts")


@query(with_sql("events", rest="""SELECT user_id, event_type, count(*) AS seen_count, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(nullif(CASE WHEN k % 3 = 0 THEN '' ELSE props END, ''), {'t': ts, 'i': event_id}) FILTER (WHERE k % 3 <> 0) AS name FROM ev GROUP BY ALL"""))
def upsert_accumulate(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("name", F.when(F.col("k") % 3 == 0, "").otherwise(F.col("props")))
    return upsert.accumulate(e, ["user_id", "event_type"], "ts", "event_id", ["name"])


@query(with_sql("events", rest="""o AS (SELECT user_id, k, min(event_id) AS event_id FROM ev WHERE event_id % 4 = 0 GROUP BY ALL), n AS (SELECT user_id, k, min(event_id) AS event_id FROM ev WHERE event_id % 4 <> 0 GROUP BY ALL)
 SELECT * FROM o UNION ALL SELECT * FROM n ANTI JOIN o USING (user_id, k)"""))
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    old = e.where("event_id % 4 = 0").groupBy("user_id", "k").agg(F.min("event_id").alias("event_id"))
    return upsert.insert_ignore(old, e.where("event_id % 4 <> 0").select("user_id", "k", "event_id"), ["user_id", "k"], [F.col("event_id")])


@query("""WITH o AS (SELECT p_partkey AS id, p_size AS size, p_retailprice AS price, 'old' AS tier FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey AS id, p_size + 1 AS size, p_retailprice * 2 AS price FROM part WHERE p_partkey % 2 = 0)
 SELECT o.id, coalesce(n.size, o.size) AS size, o.price, o.tier FROM o LEFT JOIN n USING (id) UNION ALL SELECT n.id, n.size, n.price, 'new' FROM n ANTI JOIN o USING (id)""")
def upsert_probe(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    old = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.lit("old").alias("tier"))
    new = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 1).alias("size"), (F.col("p_retailprice") * 2).alias("price"))
    return upsert.probe_upsert(old, new, "id", ["size"], {"tier": F.lit("new")})


@query("""WITH o AS (SELECT p_partkey AS id, p_size AS size, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey % 4 END AS volume FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size + 1 END AS size, CASE WHEN p_partkey % 5 = 0 THEN 7 END AS volume FROM part WHERE p_partkey % 2 = 0)
 SELECT id, coalesce(nullif(n.size, 0), o.size) AS size, coalesce(nullif(n.volume, 0), o.volume)::BIGINT AS volume FROM o FULL JOIN n USING (id) WHERE coalesce(nullif(n.volume, 0), o.volume) IS DISTINCT FROM 0""")
def catalog_merge(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    old = p.where("id % 3 <> 0").withColumn("volume", F.when(F.col("id") % 10 != 0, F.col("id") % 4))
    new = p.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("size") + 1).alias("size"), F.when(F.col("id") % 5 == 0, F.lit(7).cast("bigint")).alias("volume"))
    return upsert.merge_truthy(old, new, "id", ["size", "volume"], "volume")


@query(with_sql("events", rest="SELECT event_id, k FROM ev WHERE NOT coalesce((k < 30 AND ts < (SELECT max(ts) FROM ev) - INTERVAL 7 DAY) OR event_type = 'error', false) AND user_id NOT IN (SELECT user_id FROM ev WHERE k = 99 AND event_type = 'signup')"))
def retention_filters(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("asof"))))
    kept = upsert.retain(e, ((F.col("k") < 30) & (F.col("ts") < F.col("asof") - F.expr("INTERVAL 7 DAYS"))) | (F.col("event_type") == "error"))
    return upsert.delete_keys(kept, e.where("k = 99 and event_type = 'signup'"), ["user_id"]).select("event_id", "k")


@query(with_sql("events", rest="""t AS (SELECT event_id AS token, CASE WHEN k % 2 = 0 THEN 'reserved' ELSE 'settled' END AS status FROM ev WHERE event_type = 'view'), c AS (SELECT DISTINCT event_id - 1 AS token FROM ev WHERE event_type = 'click')
 SELECT token, CASE WHEN status = 'reserved' AND token IN (SELECT token FROM c) THEN 'settled' ELSE status END AS status FROM t"""))
def reconcile_tokens(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    tokens = e.where("event_type = 'view'").select(F.col("event_id").alias("token"), F.when(F.col("k") % 2 == 0, "reserved").otherwise("settled").alias("status"))
    return upsert.settle(tokens, e.where("event_type = 'click'").select((F.col("event_id") - 1).alias("call")), "token", "call")


COOL = """r AS (SELECT *, k % 4 AS rank, k * 100 AS profit, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev),
f AS (SELECT user_id, n, event_id, true AS emitted, s AS ls, rank AS lr, profit AS lp FROM r WHERE n = 1 UNION ALL
 SELECT r.user_id, r.n, r.event_id, e, CASE WHEN e THEN r.s ELSE f.ls END, CASE WHEN e THEN r.rank ELSE f.lr END, CASE WHEN e THEN r.profit ELSE f.lp END FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1, LATERAL (SELECT {cond} AS e))
SELECT event_id, emitted FROM f"""


def _with_recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", "user_id", "ts", folds.epoch("ts").alias("s"), (F.col("k") % 4).alias("rank"), (F.col("k") * 100).alias("profit"), "k")


@query(_with_recursive(with_sql("events", rest=COOL.format(cond="r.s - f.ls >= 21600 OR r.rank > f.lr"))))
def cooldown_batch(spark: SparkSession, d: str) -> DataFrame:
    return folds.fold(_alerts(spark, d), ["user_id"], ["ts", "event_id"], ["s", "rank", "profit"], folds.cooldown(HOURS6), "emitted", "boolean").select("event_id", "emitted")


@query(_with_recursive(with_sql("events", rest=COOL.format(cond="r.s - f.ls >= 21600 OR r.rank > f.lr OR r.profit > 1.2::DOUBLE * f.lp"))))
def cooldown_profit_escape(spark: SparkSession, d: str) -> DataFrame:
    return folds.fold(_alerts(spark, d), ["user_id"], ["ts", "event_id"], ["s", "rank", "profit"], folds.cooldown(HOURS6, 1.2), "emitted", "boolean").select("event_id", "emitted")


@query(_with_recursive(with_sql("events", rest="""r AS (SELECT *, k % 3 AS v, k % 5 <> 0 AS ok, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev),
f AS (SELECT user_id, n, event_id, true AS passed, CASE WHEN ok THEN s END AS ls, CASE WHEN ok THEN v END AS lv FROM r WHERE n = 1 UNION ALL
 SELECT r.user_id, r.n, r.event_id, e, CASE WHEN e AND r.ok THEN r.s ELSE f.ls END, CASE WHEN e AND r.ok THEN r.v ELSE f.lv END FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1, LATERAL (SELECT NOT coalesce(f.lv = r.v AND r.s - f.ls < 86400, false) AS e))
SELECT event_id, passed FROM f""")))
def dedup_window_batch(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", "user_id", "ts", folds.epoch("ts").alias("s"), (F.col("k") % 3).alias("v"), (F.col("k") % 5 != 0).alias("ok"))
    return folds.fold(e, ["user_id"], ["ts", "event_id"], ["s", "v", "ok"], folds.dedup_window(86_400), "passed", "boolean").select("event_id", "passed")


@query(_with_recursive(with_sql("events", rest="""r AS (SELECT *, epoch(ts) AS s, k < 60 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev),
f AS (SELECT user_id, n, event_id, 'closed' AS state, CASE WHEN bad THEN 1 ELSE 0 END AS c, 0.0::DOUBLE AS u FROM r WHERE n = 1 UNION ALL
 SELECT r.user_id, r.n, r.event_id, st, CASE st WHEN 'open' THEN f.c WHEN 'tripped' THEN 0 ELSE CASE WHEN r.bad THEN f.c + 1 ELSE 0 END END, CASE st WHEN 'open' THEN f.u WHEN 'tripped' THEN r.s + 43200 ELSE 0.0::DOUBLE END
 FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1, LATERAL (SELECT CASE WHEN r.s < f.u THEN 'open' WHEN r.bad AND f.c + 1 >= 3 THEN 'tripped' ELSE 'closed' END AS st))
SELECT event_id, state FROM f""")))
def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", "user_id", "ts", folds.epoch("ts").alias("s"), (F.col("k") < 60).alias("bad"))
    return folds.fold(e, ["user_id"], ["ts", "event_id"], ["s", "bad"], folds.failure_streak(3, 43_200), "state", "string").select("event_id", "state")


@query(_with_recursive(with_sql("events", rest="""r AS (SELECT *, floor(value)::BIGINT AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev),
f AS (SELECT user_id, n, event_id, false AS spike, p AS lp, k AS lk FROM r WHERE n = 1 UNION ALL
 SELECT r.user_id, r.n, r.event_id, e, CASE WHEN e THEN r.p ELSE f.lp END, CASE WHEN e THEN r.k ELSE f.lk END FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1,
 LATERAL (SELECT (f.lp > 0 AND abs(r.p - f.lp)::DOUBLE / f.lp >= 0.5::DOUBLE) OR (f.lk > 0 AND r.k::DOUBLE / f.lk >= 2.0::DOUBLE) AS e))
SELECT event_id, spike FROM f""")))
def baseline_spikes(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", "user_id", "ts", F.floor("value").cast("bigint").alias("p"), "k")
    return folds.fold(e.withColumn("s", F.lit(0)), ["user_id"], ["ts", "event_id"], ["s", "p", "k"], folds.baseline_spike(0.5, 2.0), "spike", "boolean").select("event_id", "spike")


@query(with_sql("events", rest="SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND CURRENT ROW) AS n FROM ev"))
def rate_window(spark: SparkSession, d: str) -> DataFrame:
    """Microseconds, so the range has the precision of the times. A key's time is cut into stretches of the range's length,
    each of which is given the rows of the one before, so a key of any size is spread over its stretches."""
    length = 300_000_000
    e = events(spark, d).select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = e.withColumn("own", F.floor(F.col("us") / length)).withColumn("part", F.explode(F.array("own", F.col("own") + 1)))
    w = Window.partitionBy("event_type", "part").orderBy("us").rangeBetween(-length, 0)
    return e.withColumn("n", F.count(F.lit(1)).over(w)).where("part = own").select("event_id", "n")


@query(with_sql("events", rest="SELECT user_id, count(*) AS n, count(*) FILTER (WHERE epoch(ts) - epoch(p) <= 21600) AS refired FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM ev) GROUP BY 1"))
def refire_rate(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.change import refires

    e = events(spark, d).select("user_id", "event_id", "ts")
    again = refires(e, ["user_id"], "ts", "event_id", HOURS6).groupBy("user_id").agg(F.count(F.lit(1)).alias("r"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).join(again, "user_id", "left").select("user_id", "n", F.coalesce("r", F.lit(0)).alias("refired"))
