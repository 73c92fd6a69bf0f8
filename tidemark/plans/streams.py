"""Structured Streaming queries over the events file, run to its end; each has a batch twin or SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from ..streaming import folds, pipeline
from ..views import read, with_sql
from .registry import query
from .state import COOL, HOURS6, _with_recursive


def _source(spark: SparkSession, d: str) -> DataFrame:
    e = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")  # a pattern, as the source wants a folder or a pattern
    return e.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.from_json("props", "k INT")["k"].alias("k"))


def _drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run the stream over what is there, into a folder that a repeated batch overwrites, and read that."""
    spark, out, schema = df.sparkSession, scratch(df.sparkSession, name), df.schema
    q = (df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}/checkpoint")
         .foreachBatch(lambda b, i: pipeline.write_once(b, i, f"{out}/rows")).start())
    q.awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{out}/rows") if q.lastProgress or q.recentProgress else spark.createDataFrame([], schema)
    return rows


@query(_with_recursive(with_sql("events", rest=COOL.format(cond="r.s - f.ls >= 21600 OR r.rank > f.lr").replace("SELECT event_id, emitted FROM f", "SELECT event_id, user_id FROM f WHERE emitted"))))
def stream_cooldown(spark: SparkSession, d: str) -> DataFrame:
    e = _source(spark, d).select("event_id", "user_id", folds.epoch("ts").alias("s"), (F.col("k") % 4).alias("rank"), (F.col("k") * 100).alias("profit"))
    out = folds.stream(e, ["user_id"], ["s", "event_id"], ["s", "rank", "profit"], folds.cooldown(HOURS6), "s DOUBLE, rank INT, profit INT")
    return _drain(out, "cooldown").select("event_id", "user_id")


@query(with_sql("events", rest="SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n FROM ev GROUP BY ALL"))
def stream_rates(spark: SparkSession, d: str) -> DataFrame:
    out = pipeline.rates(_source(spark, d), "ts", ["event_type"], "6 hours", "6 hours", "1 hour")
    return _drain(out, "rates", "complete").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(with_sql("events", rest="SELECT event_type AS source, count(*) AS emit_count, max(ts) AS last_emit_at FROM ev GROUP BY 1"))
def stream_heartbeats(spark: SparkSession, d: str) -> DataFrame:
    beats = pipeline.last_beats(_source(spark, d).withColumnRenamed("event_type", "source"), "ts", "source")
    return _drain(beats, "beats", "complete").select("source", "emit_count", F.col("last_emit_at").cast("timestamp_ntz").alias("last_emit_at"))


@query(with_sql("events", rest="SELECT DISTINCT event_id // 2 AS id FROM ev"))
def stream_once(spark: SparkSession, d: str) -> DataFrame:
    e = _source(spark, d).select(F.floor(F.col("event_id") / 2).cast("bigint").alias("id"), "ts")
    return _drain(pipeline.once(e, "id", "ts", "60 days"), "once").select("id")
