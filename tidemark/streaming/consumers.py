"""Consumers of one stream: each reads it with a query and a checkpoint of its own, may stop at any point, and goes on where it
was. What a batch did is merged into a keyed table under the batch's number, so a batch that is run again counts once."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyed import KeyedTable

STATUS = "id LONG, attempts LONG, status STRING"
#: Tries after which an event is given up.
MOST = 3


class Consumer(NamedTuple):
    name: str
    #: Which events it takes.
    topic: Column
    #: True for events it could handle.
    handled: Column


def outcome(old: DataFrame, new: DataFrame, most: int = MOST) -> DataFrame:
    """Status of each event after more deliveries (id, ok): consumed if one was handled, failed after `most` that were not,
    else pending. Repeated deliveries of one event are summed before the shuffle."""
    seen = old.select("id", "attempts", (F.col("status") == "consumed").alias("ok")).unionByName(new.select("id", F.lit(1).cast("long").alias("attempts"), "ok"))
    sums = seen.groupBy("id").agg(F.sum("attempts").alias("attempts"), F.bool_or("ok").alias("ok"))
    return sums.select("id", "attempts", F.when(F.col("ok"), "consumed").when(F.col("attempts") >= most, "failed").otherwise("pending").alias("status"))


def sink(spark: SparkSession, root: str, name: str, buckets: int = 16) -> KeyedTable:
    return KeyedTable(spark, f"{root}/{name}/status", ["id"], STATUS, buckets)


class Crash(RuntimeError):
    """A stop between a batch's writes and its commit, the worst moment for it."""


def consume(events: DataFrame, consumers: list[Consumer], root: str, id_col: str, crash_in: int | None = None) -> None:
    """Run all consumers over what the stream holds. With crash_in they stop once that batch is written, before Spark knows
    that it is done; the next call runs it again."""
    spark = events.sparkSession

    def start(c: Consumer):
        table = sink(spark, root, c.name)

        def batch(rows: DataFrame, number: int) -> None:
            table.merge(rows.where(c.topic).select(F.col(id_col).alias("id"), F.coalesce(c.handled, F.lit(False)).alias("ok")), number, outcome)
            if number == crash_in:
                raise Crash(c.name)

        return events.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/{c.name}/checkpoint").foreachBatch(batch).start()

    for q in [start(c) for c in consumers]:
        try:
            q.awaitTermination()
        except StreamingQueryException as e:
            if crash_in is None or Crash.__name__ not in str(e):
                raise


def split_late(rows: DataFrame, number: int, at: str, delay: int, root: str) -> None:
    """For foreachBatch: rows go to on_time or late, by the greatest event time of earlier batches less `delay` seconds.
    Nothing is dropped, as Spark drops late rows before any state sees them. The marks are one row a batch."""
    spark = rows.sparkSession
    marks = f"{root}/marks"
    rows.agg(F.max(at).alias("top")).write.mode("overwrite").parquet(f"{marks}/batch={number}")
    top = spark.read.parquet(marks).where(F.col("batch") < number).agg(F.max("top").alias("top"))
    limit = F.col("top") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(delay))
    dealt = rows.join(F.broadcast(top)).withColumn("late", F.coalesce(F.col(at) < limit, F.lit(False))).drop("top")
    dealt.write.mode("overwrite").partitionBy("late").parquet(f"{root}/rows/batch={number}")
