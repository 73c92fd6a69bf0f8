"""State that ends, restarts, late rows, polls with a cap and merges of keyed tables, over the shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import change, upsert
from ..session import scratch
from ..sources.keyed import KeyedTable
from ..streaming import backlog, consumers, folds, pipeline, polling, timers
from ..views import events, market_prices, read, with_sql
from .registry import query
from .stages import KIND, ORDER, _typed
from .state import HOURS6, _with_recursive
from .streams import _drain, _source

#: Rows may be an hour late; the millisecond keeps timers and watermark apart.
DELAY_MS = 3_600_001


def _timed(df: DataFrame, name: str) -> DataFrame:
    """Run a stream with timers to its end."""
    conf = df.sparkSession.conf
    before = conf.get(timers.PROVIDER, None)
    conf.set(timers.PROVIDER, timers.ROCKS)
    try:
        return _drain(df, name)
    finally:
        conf.unset(timers.PROVIDER) if before is None else conf.set(timers.PROVIDER, before)


def _deliver(parts: list[DataFrame], root: str, run: Callable[[DataFrame, int], None]) -> None:
    """Parts arrive one after another; after each, run(stream of what has come, number) is called."""
    for i, part in enumerate(parts):
        part.write.parquet(f"{root}/in/part-{i}")
        run(part.sparkSession.readStream.schema(part.schema).parquet(f"{root}/in/*"), i)


# A record's end: one fold per key, and what is left is released once the watermark has passed it.
ENDS = """wm AS (SELECT floor(epoch(max(ts)) * 1000) - {delay} AS wm FROM ev),
r AS (SELECT *, epoch(ts) AS s, {fields}, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS n FROM ev),
f AS (SELECT {keys}, n, event_id, s, NOT free AS passed, false AS freed, NULL::DOUBLE AS rel, CASE WHEN ok AND NOT free THEN s END AS ls, rank AS lr, profit AS lp FROM r WHERE n = 1
 UNION ALL SELECT {rkeys}, r.n, r.event_id, r.s, NOT r.free AND e, r.free AND c IS NOT NULL, x, CASE WHEN r.free THEN NULL WHEN e AND r.ok THEN r.s ELSE c END, CASE WHEN e THEN r.rank ELSE f.lr END, CASE WHEN e THEN r.profit ELSE f.lp END
 FROM f JOIN r ON {on} AND r.n = f.n + 1, LATERAL (SELECT CASE WHEN r.s - f.ls >= 21600 THEN f.ls + 21600 END AS x, CASE WHEN r.s - f.ls >= 21600 THEN NULL ELSE f.ls END AS c), LATERAL (SELECT c IS NULL OR {escape} AS e)),
out AS (SELECT {keys}, event_id, s AS moment, 'passed' AS kind FROM f WHERE passed UNION ALL SELECT {keys}, event_id, s, 'freed' FROM f WHERE freed UNION ALL SELECT {keys}, NULL, rel, 'released' FROM f WHERE rel IS NOT NULL
 UNION ALL SELECT {keys}, NULL, ls + 21600, 'released' FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC) = 1), wm WHERE round((ls + 21600) * 1000) < wm)
SELECT {keys}, event_id, round(moment * 1000000)::BIGINT AS at_us, kind FROM out"""


def _ends(keys: list[str], fields: str, escape: str) -> str:
    on = " AND ".join(f"r.{k} = f.{k}" for k in keys)
    return _with_recursive(with_sql("events", rest=ENDS.format(delay=DELAY_MS, keys=", ".join(keys), rkeys=", ".join(f"r.{k}" for k in keys), on=on, fields=fields, escape=escape)))


def _micros(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "event_id", F.round(F.col("at") * 1_000_000).cast("bigint").alias("at_us"), "kind")


@query(_ends(["user_id", "v"], "k % 3 AS v, k % 5 <> 0 AS ok, event_type = 'error' AS free, 0 AS rank, 0 AS profit", "false"))
def stream_release(spark: SparkSession, d: str) -> DataFrame:
    """Candidates once in six hours per (product, price): what failed isn't recorded, evidence that expired frees the record
    at once, and a timer releases it at its end."""
    e = _source(spark, d).select("event_id", "user_id", "ts", folds.epoch("ts").alias("s"), (F.col("k") % 3).alias("v"), (F.col("k") % 5 != 0).alias("ok"), (F.col("event_type") == "error").alias("free"))
    out = timers.expiring(e, ["user_id", "v"], "event_id", "ts", f"{DELAY_MS} milliseconds", ["s", "event_id"], ["s", "v", "ok"], folds.dedup_window(HOURS6), "s DOUBLE, v INT", HOURS6, "free")
    return _micros(_timed(out, "release"), "user_id", "v")


@query(_ends(["user_id"], "true AS ok, false AS free, k % 4 AS rank, k * 100 AS profit", "r.rank > f.lr OR r.profit > 1.2::DOUBLE * f.lp"))
def stream_cooldown_ends(spark: SparkSession, d: str) -> DataFrame:
    """Alerts with a cooldown of six hours, which a better signal or 1.2 times the profit escapes; a timer ends it."""
    e = _source(spark, d).select("event_id", "user_id", "ts", folds.epoch("ts").alias("s"), (F.col("k") % 4).alias("rank"), (F.col("k") * 100).alias("profit"))
    out = timers.expiring(e, ["user_id"], "event_id", "ts", f"{DELAY_MS} milliseconds", ["s", "event_id"], ["s", "rank", "profit"], folds.cooldown(HOURS6, 1.2), "s DOUBLE, rank INT, profit INT", HOURS6)
    return _micros(_timed(out, "cooldown-ends"), "user_id")


def _weeks(e: DataFrame) -> list[DataFrame]:
    """Events in three parts by time."""
    day = F.dayofmonth("ts")
    return [e.where(day <= 10), e.where((day > 10) & (day <= 20)), e.where(day > 20)]


@query(with_sql("events", rest="""e AS (SELECT CASE event_type WHEN 'purchase' THEN 'profit' ELSE 'catalog' END AS consumer, event_id // 3 AS id, k % 4 = 0 AS ok FROM ev WHERE event_type IN ('purchase', 'view', 'click'))
 SELECT consumer, id, count(*) AS attempts, CASE WHEN bool_or(ok) THEN 'consumed' WHEN count(*) >= 3 THEN 'failed' ELSE 'pending' END AS status FROM e GROUP BY ALL"""))
def stream_restart(spark: SparkSession, d: str) -> DataFrame:
    """Two consumers of one stream, which both stop in its middle, after their writes and before their commit, and are started
    again; each event's status as if they had not."""
    root = scratch(spark, "restart")
    e = events(spark, d).select(F.floor(F.col("event_id") / 3).cast("bigint").alias("id"), "event_type", "k", "ts")
    two = [consumers.Consumer("profit", F.col("event_type") == "purchase", F.col("k") % 4 == 0), consumers.Consumer("catalog", F.col("event_type").isin("view", "click"), F.col("k") % 4 == 0)]
    _deliver(_weeks(e), root, lambda stream, i: consumers.consume(stream, two, root, "id", crash_in=1 if i == 1 else None))
    rows = [consumers.sink(spark, root, c.name).read().withColumn("consumer", F.lit(c.name)) for c in two]
    return rows[0].unionByName(rows[1])


@query(with_sql("events", rest="""c AS (SELECT event_id, ts, (CASE WHEN day(ts) > 15 THEN 1 ELSE 0 END + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS batch FROM ev),
 m AS (SELECT batch + 1 AS batch, max(ts) AS t FROM c GROUP BY 1), w AS (SELECT batch, max(t) OVER (ORDER BY batch) AS top FROM m)
 SELECT event_id, batch, coalesce(ts < top - INTERVAL 6 HOUR, false) AS late FROM c LEFT JOIN w USING (batch)"""))
def stream_late(spark: SparkSession, d: str) -> DataFrame:
    """Errors come with the delivery after their own: what is over six hours behind is kept apart for audit."""
    root = scratch(spark, "late")
    e = events(spark, d).select("event_id", "event_type", "ts")
    at = (F.dayofmonth("ts") > 15).cast("int") + (F.col("event_type") == "error").cast("int")

    def run(stream: DataFrame, i: int) -> None:
        batches = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(lambda b, n: consumers.split_late(b, n, "ts", HOURS6, root))
        batches.start().awaitTermination()

    _deliver([e.where(at == i) for i in range(3)], root, run)
    rows = spark.read.schema("event_id BIGINT, batch BIGINT, late BOOLEAN").parquet(f"{root}/rows")
    return rows.select("event_id", "batch", "late")


POLL = """p{i} AS (SELECT product_id AS id, max(sell) AS v FROM market_prices WHERE ts < DATE '{date}' GROUP BY 1),
c{i} AS (SELECT id, p{i}.v, CASE WHEN s{j}.v IS NULL THEN 'new' ELSE 'changed' END AS change, row_number() OVER (ORDER BY id) AS n FROM p{i} LEFT JOIN s{j} USING (id) WHERE s{j}.v IS NULL OR s{j}.v <> p{i}.v),
d{i} AS (SELECT *, CASE WHEN n > 30 THEN 'waiting' WHEN v % 7 = 0 THEN 'failed' ELSE 'done' END AS handled FROM c{i}),
s{i} AS (SELECT id, v, {i} AS batch FROM d{i} WHERE handled = 'done' UNION ALL SELECT * FROM s{j} WHERE id NOT IN (SELECT id FROM d{i} WHERE handled = 'done'))"""
CUTS = ("1994-01-01", "1996-01-01", "1999-01-01")


@query(with_sql("market_prices", rest="s0 AS (SELECT 0::BIGINT AS id, 0::BIGINT AS v, 0 AS batch WHERE false),\n" + ",\n".join(POLL.format(i=i + 1, j=i, date=c) for i, c in enumerate(CUTS)) + """
 SELECT x.batch, x.id AS product_id, change, handled, (s3.batch - 1)::BIGINT AS marked FROM (""" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS batch, id, change, handled FROM d{i + 1}" for i in range(3)) + ") x LEFT JOIN s3 ON s3.id = x.id"))
def delta_polling(spark: SparkSession, d: str) -> DataFrame:
    """Three polls of the greatest prices so far, 30 changes each: what is over the cap or fails is found again by the next."""
    root = scratch(spark, "polls")
    poller = polling.DeltaPoller(spark, root, "product_id", ["v"], 30, lambda rows: F.col("v") % 7 != 0)
    polls = [market_prices(spark, d).where(F.col("ts") < F.lit(c).cast("date")).groupBy("product_id").agg(F.max("sell").alias("v")) for c in CUTS]

    def run(stream: DataFrame, i: int) -> None:
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(poller.poll).start().awaitTermination()

    _deliver(polls, root, run)
    marked = poller.marked.read().select("product_id", F.col("batch").alias("marked"))
    return poller.log().select(F.col("batch").cast("bigint").alias("batch"), "product_id", "change", "handled").join(marked, "product_id", "left")


def _merged(spark: SparkSession, name: str, keys: list[str], parts: list[DataFrame], schema: str, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    table = KeyedTable(spark, scratch(spark, name), keys, schema, 16)
    for version, part in enumerate(parts):
        table.merge(part, version, fold)
    return table.read()


@query(with_sql("events", rest="SELECT user_id, event_type, value, ts FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"))
def merge_latest(spark: SparkSession, d: str) -> DataFrame:
    """Three merges into a keyed table: the last row of each key stays."""
    e = events(spark, d).select("user_id", "event_type", "event_id", "value", "ts")
    keys = ["user_id", "event_type"]
    out = _merged(spark, "latest", keys, _weeks(e), e.schema, lambda old, new: upsert.upsert_latest(old, new, keys, [F.col("ts"), F.col("event_id")]))
    return out.select("user_id", "event_type", "value", "ts")


@query(with_sql("events", rest="SELECT user_id, count(*) AS seen_count, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(props, {'t': ts, 'i': event_id}) FILTER (WHERE k % 3 <> 0) AS name FROM ev GROUP BY ALL"))
def merge_accumulate(spark: SparkSession, d: str) -> DataFrame:
    """Three merges into a keyed table of counts, first and last sightings and last names that are not blank."""
    e = events(spark, d).withColumn("name", F.when(F.col("k") % 3 != 0, F.col("props")).otherwise(""))
    parts = [upsert.sightings(p, ["user_id"], "ts", "event_id", ["name"]) for p in _weeks(e)]
    out = _merged(spark, "sightings", ["user_id"], parts, parts[0].schema, lambda old, new: upsert.add_sightings(old, new, ["user_id"], ["name"]))
    return out.select("user_id", "seen_count", "first_seen", "last_seen", F.col("name.value").alias("name"))


@query("""WITH o AS (SELECT p_partkey AS id, p_size AS size, p_retailprice AS price, 'old' AS tier FROM part WHERE p_size <= 30), n AS (SELECT p_partkey AS id, p_size + 1 AS size, p_retailprice * 2 AS price FROM part WHERE p_size > 20)
 SELECT o.id, coalesce(n.size, o.size) AS size, o.price, o.tier FROM o LEFT JOIN n USING (id) UNION ALL SELECT n.id, n.size, n.price, 'new' FROM n ANTI JOIN o USING (id)""")
def merge_probe(spark: SparkSession, d: str) -> DataFrame:
    """Known products take the new size, others are added with their tier."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    old = p.where("size <= 30").withColumn("tier", F.lit("old"))
    new = p.where("size > 20").select("id", (F.col("size") + 1).alias("size"), (F.col("price") * 2).alias("price"))
    return _merged(spark, "probe", ["id"], [old, new], old.schema, lambda before, rows: upsert.probe_upsert(before, rows, "id", ["size"], {"tier": _or("tier", rows, "new")}))


def _or(column: str, rows: DataFrame, value: str) -> Column:
    return F.col(column) if column in rows.columns else F.lit(value)


# Each batch takes the first of what waits; w: what the batch before has left and what has come.
TAKE = """w{i} AS (SELECT * FROM l{j} UNION ALL SELECT event_id, event_type, turn FROM p WHERE part + 1 = {i}), n{i} AS (SELECT *, row_number() OVER (ORDER BY turn, event_id) AS n FROM w{i}),
b{i} AS (SELECT event_id, event_type, {i}::BIGINT AS batch FROM n{i} WHERE n <= 500), l{i} AS (SELECT event_id, event_type, turn FROM n{i} WHERE n > 500)"""
WEEK = "CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END"


@query(with_sql("events", rest=f"""t AS (SELECT event_id, {KIND} AS t, {WEEK} AS part FROM ev WHERE k % 3 = 0), p AS (SELECT event_id, t AS event_type, {ORDER} AS turn, part FROM t WHERE t <> 'Unknown' AND t <> 'AlertSent'),
 l0 AS (SELECT event_id, event_type, turn FROM p WHERE false), """ + ",\n".join(TAKE.format(i=i, j=i - 1) for i in range(1, 5))
    + " SELECT event_id, event_type, batch - 1 AS batch FROM (" + " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(1, 5)) + ") UNION ALL SELECT event_id, event_type, NULL FROM l4"))
def stream_catch_up(spark: SparkSession, d: str) -> DataFrame:
    """Pending events in three deliveries and four batches of 500: profits, then candidates, then catalogs of all that wait. The
    batch of each, or null for those that still wait."""
    root = scratch(spark, "catch-up")
    e = _typed(events(spark, d)).where("k % 3 = 0").select("event_id", "event_type", "ts")
    turn = F.array_position(F.array(*[F.lit(t) for t in ("ProfitFound", "CandidateMatched", "CatalogDumped")]), F.col("event_type")) - 1
    e = e.withColumn("turn", turn).where("turn >= 0")
    waiting = backlog.Backlog(spark, root, ["turn", "event_id"], 500)

    def run(stream: DataFrame, i: int) -> None:
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(waiting.take).start().awaitTermination()

    _deliver(_weeks(e), root, run)
    waiting.take(None, max(waiting.marks.versions()) + 1)
    done = waiting.taken().select("event_id", "event_type", F.col("batch").cast("bigint").alias("batch"))
    rest = waiting.waiting()
    return done if rest is None else done.unionByName(rest.select("event_id", "event_type", F.lit(None).cast("bigint").alias("batch")))


@query(with_sql("events", rest=f"""c AS (SELECT event_type, ts, {WEEK} + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS part FROM ev),
 m AS (SELECT part + 1 AS part, max(ts) AS t FROM c GROUP BY 1), w AS (SELECT part, max(t) OVER (ORDER BY part) - INTERVAL 2 DAY AS wm FROM m), f AS (SELECT max(wm) AS last FROM w),
 x AS (SELECT event_type, part, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(h::INT) AS start FROM c, range(6) r(h))
 SELECT event_type, start, start + INTERVAL 6 HOUR AS "end", count(*) AS n FROM x LEFT JOIN w USING (part), f WHERE (wm IS NULL OR start + INTERVAL 6 HOUR > wm) AND start + INTERVAL 6 HOUR <= last GROUP BY ALL"""))
def stream_rate_windows(spark: SparkSession, d: str) -> DataFrame:
    """Rows per six hours, every hour, of a stream whose errors come with the delivery after their own: rows of windows that the
    watermark (two days behind) has not closed count. A window is written once, when it closes, and its state is gone."""
    root = scratch(spark, "windows")
    e = events(spark, d).select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    day = F.dayofmonth("ts")
    at = (day > 10).cast("int") + (day > 20).cast("int") + (F.col("event_type") == "error").cast("int")
    kinds = []

    def run(stream: DataFrame, i: int) -> None:
        out = pipeline.rates(stream, "ts", ["event_type"], "6 hours", "1 hour", "2 days")
        kinds.append(out.schema)
        batches = out.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(lambda b, n: pipeline.write_once(b, n, f"{root}/rows"))
        batches.start().awaitTermination()

    _deliver([e.where(at == i) for i in range(4)], root, run)
    rows = spark.read.schema(kinds[0]).parquet(f"{root}/rows")
    return rows.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""WITH o AS (SELECT p_partkey AS id, p_retailprice AS price, p_size AS size FROM part WHERE NOT (p_size = 50 AND p_brand = 'Brand#1')),
 n AS (SELECT p_partkey AS id, CASE WHEN p_size = 49 AND p_brand = 'Brand#2' THEN p_retailprice + 1 ELSE p_retailprice END AS price, p_size AS size FROM part WHERE NOT (p_size = 48 AND p_brand = 'Brand#3'))
 SELECT id, CASE WHEN o.price IS NULL THEN 'new' WHEN n.price IS NULL THEN 'stale' WHEN o.price = n.price THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n USING (id)""")
def snapshot_diff_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots that were written independently and differ in a few products: only the buckets of these are joined."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), "p_brand")
    old = p.where("not (size = 50 and p_brand = 'Brand#1')").drop("p_brand")
    dearer = F.when((F.col("size") == 49) & (F.col("p_brand") == "Brand#2"), F.col("price") + 1).otherwise(F.col("price"))
    new = p.where("not (size = 48 and p_brand = 'Brand#3')").withColumn("price", dearer).drop("p_brand")
    tables = [KeyedTable(spark, scratch(spark, f"snapshot-{i}"), ["id"], rows.schema, 64) for i, rows in enumerate((old, new))]
    for table, rows in zip(tables, (old, new)):
        table.merge(rows, 0, lambda before, all_: all_)
    return change.bucket_diff(*tables, ["price", "size"])
