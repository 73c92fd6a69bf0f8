"""Delta polling: each batch of a stream is a poll of all keys; what differs from the marked state is handled up to a cap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money
from ..operators import change, upsert
from ..sources.keyed import KeyedTable


class DeltaPoller:
    """Only what was handled is marked, so what is over the cap, or failed, is found again in the next poll. The marked state
    is a keyed table of hashes: a poll rewrites the buckets of the at most `cap` keys that it handled."""

    def __init__(self, spark: SparkSession, root: str, key: str, values: list[str], cap: int, worked: Callable[[DataFrame], Column], buckets: int = 16):
        self.root, self.key, self.values, self.cap, self.worked = root, key, values, cap, worked
        self.marked = KeyedTable(spark, f"{root}/marked", [key], f"{key} LONG, hash STRING, batch LONG", buckets)

    def poll(self, rows: DataFrame, number: int) -> None:
        """For foreachBatch. A poll that is run again starts from the same marked state and gives the same."""
        key, last = self.key, self.marked.before(number)
        known = self.marked.read(last) if last is not None else self.marked.read(-1)
        now = rows.withColumn("hash", money.state_hash(*[F.col(v) for v in self.values]))
        both = now.join(known.select(key, F.col("hash").alias("_old")), key, "left")
        changed = both.where(F.col("_old").isNull() | (F.col("_old") != F.col("hash"))).withColumn("change", F.when(F.col("_old").isNull(), "new").otherwise("changed"))
        asked, waiting = change.cap_changes(changed, key, self.cap)
        done = asked.withColumn("handled", F.when(self.worked(asked), "done").otherwise("failed"))
        log = done.unionByName(waiting.withColumn("handled", F.lit("waiting"))).select(key, "change", "handled", "hash")
        log.write.mode("overwrite").parquet(f"{self.root}/log/batch={number}")
        good = rows.sparkSession.read.parquet(f"{self.root}/log/batch={number}").where("handled = 'done'").select(key, "hash", F.lit(number).cast("long").alias("batch"))
        self.marked.merge(good, number, lambda old, new: upsert.upsert_latest(old, new, [key], [F.col("batch")]))

    def log(self) -> DataFrame:
        return self.marked.spark.read.parquet(f"{self.root}/log")
