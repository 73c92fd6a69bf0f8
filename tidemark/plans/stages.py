"""The alert pipeline's stages: typed events and dead letters, replay, expiry, freshness, state kept over a stream next to its
batch twin, ranked lists with quotas, targets and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tiers
from ..operators import quality, report, upsert
from ..streaming import folds, pipeline
from ..views import events, market_products, read, volumes, with_sql
from .registry import query
from .state import _with_recursive
from .streams import _drain, _source

TYPES = {"view": "CatalogDumped", "click": "CandidateMatched", "purchase": "ProfitFound", "signup": "AlertSent"}


def _typed(e: DataFrame) -> DataFrame:
    """Events under the pipeline's names, with a payload that is broken for some."""
    name = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[F.col("event_type")]
    payload = F.when(F.col("k") % 10 == 9, F.lit('{"source": ')).otherwise(F.to_json(F.struct(F.lit("s").alias("source"), F.col("k").alias("product_count"), F.col("user_id").alias("product_id"), F.col("k").alias("alert_id"))))
    return e.select("event_id", F.coalesce(name, F.lit("Unknown")).alias("event_type"), payload.alias("payload"), "k", "user_id", "ts")


KIND = "CASE event_type WHEN 'view' THEN 'CatalogDumped' WHEN 'click' THEN 'CandidateMatched' WHEN 'purchase' THEN 'ProfitFound' WHEN 'signup' THEN 'AlertSent' ELSE 'Unknown' END"


@query(with_sql("events", rest="SELECT event_id, CASE WHEN k % 10 = 9 THEN 'dead' ELSE 'view' END AS kind, CASE WHEN k % 10 <> 9 THEN k END AS n FROM ev WHERE event_type = 'view' UNION ALL SELECT event_id, 'unknown', NULL FROM ev WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')"))
def stream_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """One topic of the stream, decoded; its dead letters; and events of no known type, all in one pass over the source."""
    rows = pipeline.sorted_out(_typed(_source(spark, d)), "CatalogDumped")
    kind = F.when(F.col("kind") == "good", "view").otherwise(F.col("kind"))
    return _drain(rows.select("event_id", kind.alias("kind"), F.when(F.col("kind") == "good", F.col("e.product_count")).alias("n")), "letters").select("event_id", "kind", "n")


@query(with_sql("events", rest=f"""e AS (SELECT event_id, {KIND} AS t, k % 5 AS attempts, CASE k % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'deferred' ELSE 'consumed' END AS status FROM ev)
 SELECT event_id, CASE WHEN t = 'Unknown' THEN 'failed' WHEN status = 'consumed' THEN 'consumed' WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS status FROM e"""))
def replay(spark: SparkSession, d: str) -> DataFrame:
    """What a replay makes of each stored event: unknown types and those tried three times fail, and others go on."""
    e = _typed(events(spark, d))
    status = F.when(F.col("k") % 3 == 0, "pending").when(F.col("k") % 3 == 1, "deferred").otherwise("consumed")
    known = F.col("event_type") != "Unknown"
    return e.select("event_id", F.when(known, pipeline.replay_status(F.col("k") % 5, status)).otherwise("failed").alias("status"))


ORDER = "CASE t WHEN 'ProfitFound' THEN 0 WHEN 'CandidateMatched' THEN 1 WHEN 'CatalogDumped' THEN 2 END"


@query(with_sql("events", rest=f"""e AS (SELECT event_id, {KIND} AS t FROM ev WHERE k % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY event_id) AS n FROM e WHERE t IN ('ProfitFound', 'CandidateMatched', 'CatalogDumped'))
 SELECT event_id, t AS event_type, {ORDER} AS turn, t = 'CandidateMatched' AND n > 50 AS later FROM r"""))
def recovery_order(spark: SparkSession, d: str) -> DataFrame:
    """Pending events in the order of recovery: profits, candidates (50 at first), catalogs."""
    e = _typed(events(spark, d)).where("k % 3 = 0").select("event_id", "event_type")
    return pipeline.recovery(e, "event_type", "event_id", ["ProfitFound", "CandidateMatched", "CatalogDumped"], {"CandidateMatched": 50}).select("event_id", "event_type", "turn", "later")


@query(with_sql("events", rest="SELECT event_id, ts < TIMESTAMP '2024-01-20' - INTERVAL 6 HOUR AS expired FROM ev"))
def stream_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Pending events of a stream that are too old are set aside, not lost."""
    fresh, old = pipeline.split_expired(_source(spark, d), "ts", F.lit("2024-01-20").cast("timestamp"), 21_600)
    return _drain(fresh.select("event_id", F.lit(False).alias("expired")).unionByName(old.select("event_id", F.lit(True).alias("expired"))), "expiry").select("event_id", "expired")


@query(with_sql("events", rest="""e AS (SELECT event_id, k, epoch(ts) AS made, CASE WHEN k % 3 = 0 THEN NULL ELSE epoch(ts) + k * 3600 END AS expires FROM ev)
 SELECT event_id, CASE WHEN k % 3 = 0 THEN 'record' ELSE 'stock' END AS origin, CASE WHEN k % 7 = 0 THEN true ELSE coalesce(expires, made + 21600) > epoch(TIMESTAMP '2024-01-20') END AS fresh FROM e"""))
def evidence_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Evidence with its own expiry, 0 for none; older events without evidence are given theirs by the time of the record,
    not by now."""
    e = events(spark, d).withColumn("made", folds.epoch("ts"))
    stock = F.when(F.col("k") % 3 != 0, F.struct(F.lit("stock").alias("origin"), (F.col("made") + F.col("k") * 3600).alias("expires_at")))
    got = pipeline.promoted(stock, F.col("made"), 21_600)
    expires = F.when(F.col("k") % 7 == 0, F.lit(0.0)).otherwise(got["expires_at"])
    return e.select("event_id", got["origin"].alias("origin"), pipeline.fresh_evidence(expires, F.unix_timestamp(F.lit("2024-01-20").cast("timestamp")).cast("double")).alias("fresh"))


SPIKES = """r AS (SELECT *, floor(value)::BIGINT AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev),
f AS (SELECT user_id, n, event_id, false AS spike, p AS lp, k AS lk FROM r WHERE n = 1 UNION ALL
 SELECT r.user_id, r.n, r.event_id, e, CASE WHEN e THEN r.p ELSE f.lp END, CASE WHEN e THEN r.k ELSE f.lk END FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1,
 LATERAL (SELECT (f.lp > 0 AND abs(r.p - f.lp)::DOUBLE / f.lp >= 0.5::DOUBLE) OR (f.lk > 0 AND r.k::DOUBLE / f.lk >= 2.0::DOUBLE) AS e))
SELECT event_id FROM f WHERE spike"""


@query(_with_recursive(with_sql("events", rest=SPIKES)))
def stream_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Spikes against a baseline that each one resets, with the state kept over the stream; baseline_spikes is its twin."""
    e = _source(spark, d).join(read(spark, d, "events").select("event_id", F.floor("value").cast("bigint").alias("p")), "event_id")
    e = e.select("event_id", "user_id", folds.epoch("ts").alias("s"), "p", "k")
    return _drain(folds.stream(e, ["user_id"], ["s", "event_id"], ["s", "p", "k"], folds.baseline_spike(0.5, 2.0), "p LONG, k INT"), "spikes").select("event_id")


DEDUP = """r AS (SELECT *, k % 3 AS v, k % 5 <> 0 AS ok, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev),
f AS (SELECT user_id, n, event_id, true AS passed, CASE WHEN ok THEN s END AS ls, CASE WHEN ok THEN v END AS lv FROM r WHERE n = 1 UNION ALL
 SELECT r.user_id, r.n, r.event_id, e, CASE WHEN e AND r.ok THEN r.s ELSE f.ls END, CASE WHEN e AND r.ok THEN r.v ELSE f.lv END FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1, LATERAL (SELECT NOT coalesce(f.lv = r.v AND r.s - f.ls < 86400, false) AS e))
SELECT event_id FROM f WHERE passed"""


@query(_with_recursive(with_sql("events", rest=DEDUP)))
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Candidates once in a window of time, over a stream: failures are not recorded, an expired record is released."""
    e = _source(spark, d).select("event_id", "user_id", folds.epoch("ts").alias("s"), (F.col("k") % 3).alias("v"), (F.col("k") % 5 != 0).alias("ok"))
    return _drain(folds.stream(e, ["user_id"], ["s", "event_id"], ["s", "v", "ok"], folds.dedup_window(86_400), "s DOUBLE, v INT"), "dedup").select("event_id")


@query(with_sql("events", rest="""c AS (SELECT event_id, user_id, event_type, k FROM ev WHERE event_type IN ('view', 'click')), m AS (SELECT c.*, c_mktsegment AS segment FROM c JOIN customer ON c_custkey = user_id), p AS (SELECT *, k * 100 - 2000 AS profit FROM m)
 SELECT event_id, segment, profit FROM p WHERE profit > 0"""))
def stage_chain(spark: SparkSession, d: str) -> DataFrame:
    """Stages as functions from table to table: catalog to candidates to profits."""
    customers = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))

    def dumped(e: DataFrame) -> DataFrame:
        return e.where(F.col("event_type").isin("view", "click")).select("event_id", "user_id", "k")

    def matched(c: DataFrame) -> DataFrame:
        return c.join(customers, "user_id")

    def found(m: DataFrame) -> DataFrame:
        return m.withColumn("profit", F.col("k") * 100 - 2000).where("profit > 0")

    return events(spark, d).transform(dumped).transform(matched).transform(found).select("event_id", "segment", "profit")


LISTS = """l AS (SELECT p_partkey AS id, p_type AS category, p_retailprice AS v, 0 AS list FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 'popular', p_size, 1 FROM part WHERE p_size > 10),
r AS (SELECT *, row_number() OVER (PARTITION BY list, category ORDER BY v DESC, id) AS place FROM l), u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY list, place) = 1)"""


@query(f"WITH {LISTS} SELECT id, category, place FROM u QUALIFY row_number() OVER (PARTITION BY category ORDER BY place, id) <= greatest(CASE WHEN category = 'popular' THEN 40 ELSE 50 * length(category) // 10 END, 5)")
def ranked_quotas(spark: SparkSession, d: str) -> DataFrame:
    """Ranked lists merged: the first list that has an item keeps it, and each category has a quota (5 at least)."""
    p = read(spark, d, "part")
    a = p.where("p_size > 25").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("v"), F.lit(0).alias("list"))
    b = p.where("p_size > 10").select(F.col("p_partkey").alias("id"), F.lit("popular").alias("category"), F.col("p_size").cast("double").alias("v"), F.lit(1).alias("list"))
    ranked = report.placed(a.unionByName(b), ["list", "category"], [F.desc("v"), F.asc("id")], "place")
    quota = F.greatest(F.when(F.col("category") == "popular", 40).otherwise(F.floor(F.length("category") * 5)), F.lit(5))
    once = upsert.keep_first(ranked, ["id"], [F.col("list"), F.col("place")])
    return report.placed(once, ["category"], [F.col("place"), F.col("id")], "n").where(F.col("n") <= quota).select("id", "category", "place")


@query(with_sql("market_products", "volumes", "retail_prices", "retail_products", rest="""v AS (SELECT product_id, volume, CASE WHEN product_id % 4 = 0 THEN NULL ELSE product_id % 30 END AS due FROM market_products LEFT JOIN volumes USING (product_id)), m AS (SELECT * FROM v WHERE product_id IN (SELECT product_id FROM retail_products))
 SELECT 'new' AS mode, product_id, row_number() OVER (ORDER BY product_id) AS turn FROM m WHERE volume IS NULL UNION ALL SELECT * FROM (SELECT 'recheck', product_id, row_number() OVER (ORDER BY due NULLS FIRST, product_id) AS turn FROM m WHERE volume IS NOT NULL AND (due IS NULL OR due <= 12)) WHERE turn <= 300"""))
def cold_targets(spark: SparkSession, d: str) -> DataFrame:
    """Matched products to ask for: those never measured by id; and measured ones that are due, 300 at most, by due time."""
    from ..views import retail_products

    v = market_products(spark, d).select("product_id").join(volumes(spark, d), "product_id", "left").withColumn("due", F.when(F.col("product_id") % 4 != 0, F.col("product_id") % 30))
    m = v.join(retail_products(spark, d), "product_id", "left_semi")
    new = report.numbered(m.where("volume is null").select(F.lit("new").alias("mode"), "product_id"), "product_id", "turn")
    again = m.where("volume is not null and (due is null or due <= 12)").orderBy(F.asc_nulls_first("due"), "product_id").limit(300).select(F.lit("recheck").alias("mode"), "product_id", "due")
    turn = F.row_number().over(Window.partitionBy("mode").orderBy(F.asc_nulls_first("due"), "product_id"))  # 300 rows
    return new.unionByName(again.select("mode", "product_id", turn.cast("bigint").alias("turn")))


@query(with_sql("events", rest="""s AS (SELECT user_id AS id, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS before, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS after FROM ev GROUP BY 1)
 SELECT id, CASE WHEN (before = 0 AND after >= 3) OR (before > 0 AND after::DOUBLE / before >= 2.0::DOUBLE) THEN 'hot' WHEN before + after >= 5 THEN 'warm' ELSE 'cold' END AS tier FROM s"""))
def promoted_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Spiking products go to the hot tier; the others keep the tier of their volume."""
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    s = events(spark, d).groupBy(F.col("user_id").alias("id")).agg(F.count_if(F.col("ts") < cut).alias("before"), F.count_if(F.col("ts") >= cut).alias("after"))
    spike = tiers.volume_spike(F.col("before"), F.col("after"))
    tier = F.when(F.col("before") + F.col("after") >= 5, "warm").otherwise("cold")
    return s.select("id", F.when(spike.isNotNull(), "hot").otherwise(tier).alias("tier"))


@query("SELECT e.event_id, c.c_name AS name FROM events e LEFT JOIN customer c ON c.c_custkey::VARCHAR = CASE WHEN e.event_id % 9 = 0 THEN 'x' || e.user_id ELSE e.user_id::VARCHAR END")
def cast_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are texts on one side are cast once, to the number's type; what is no number matches nothing."""
    key = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("x"), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string"))
    e = read(spark, d, "events").select("event_id", key.try_cast("bigint").alias("c_custkey"))
    return e.join(read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name")), "c_custkey", "left").select("event_id", "name")


@query(with_sql("events", rest="SELECT max(k) AS most, sum(k)::BIGINT AS total, (SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM ev GROUP BY 1)) AS by_signal FROM ev"))
def alert_summary(spark: SparkSession, d: str) -> DataFrame:
    """Maximum, total and a count by signal in one row; the signals are aggregated first, so the last step sees a few."""
    g = events(spark, d).groupBy("event_type").agg(F.max("k").alias("m"), F.sum("k").alias("s"), F.count(F.lit(1)).alias("n"))
    each = F.array_sort(F.collect_list(F.concat_ws("=", "event_type", F.col("n").cast("string"))))
    return g.agg(F.max("m").alias("most"), F.sum("s").alias("total"), F.array_join(each, ",").alias("by_signal"))


def _bad(g: Column) -> list[tuple[str, Column]]:
    return [("silent", g["fresh"] == 0), ("errors", g["errors"] * 10 > g["n"]), ("low", g["n"] < 20)]


@query(with_sql("events", rest="""g AS (SELECT user_id % 60 AS source, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE ts >= m - INTERVAL 24 HOUR) AS fresh FROM ev, (SELECT max(ts) AS m FROM ev) GROUP BY 1),
 r AS (SELECT source, list_filter([CASE WHEN fresh = 0 THEN 'silent' END, CASE WHEN errors * 10 > n THEN 'errors' END, CASE WHEN n < 20 THEN 'low' END], lambda x: x IS NOT NULL) AS rs FROM g)
 SELECT source, CASE WHEN len(rs) = 0 THEN 'ok' WHEN list_contains(rs, 'silent') THEN 'fail' ELSE 'warn' END AS verdict, array_to_string(rs, '|') AS reasons FROM r"""))
def health_verdict(spark: SparkSession, d: str) -> DataFrame:
    """All reasons that hold for a source, and the verdict over them."""
    e = events(spark, d)
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("asof"))))
    g = e.groupBy((F.col("user_id") % 60).alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("ts") >= F.col("asof") - F.expr("INTERVAL 24 HOURS")).alias("fresh"))
    reasons = quality.reasons(_bad(F.struct("n", "errors", "fresh")))
    return g.select("source", quality.verdict(reasons, fatal=("silent",)).alias("verdict"), F.array_join(reasons, "|").alias("reasons"))
