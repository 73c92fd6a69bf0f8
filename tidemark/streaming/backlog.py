"""A backlog by priority that micro-batches of bounded size drain.

Each delivery is written once, in order of priority. A batch takes the first rows of all that wait, so what has been taken of
a delivery is always its first part: one mark a delivery says what is left, and no waiting row is ever written again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upsert
from ..sources.keyed import KeyedTable


class Backlog:
    """Rows wait in the order of the columns `order`, equal ones by delivery; a batch takes at most `cap` of them. Nulls come
    first, repeated rows are taken as often as they came. The columns _delivery and _place are the backlog's own."""

    def __init__(self, spark: SparkSession, root: str, order: list[str], cap: int):
        self.spark, self.root, self.order, self.cap = spark, root, order, cap
        self.marks = KeyedTable(spark, f"{root}/marks", ["delivery"], "delivery LONG, mark LONG, left LONG", 1)

    def _open(self, version: int | None) -> list[tuple[int, int, int]]:
        """(delivery, place taken last, rows left) of deliveries with rows left."""
        return [] if version is None else sorted(tuple(r) for r in self.marks.read(version).where("left > 0").select("delivery", "mark", "left").collect())

    def _waiting(self, open_: list[tuple[int, int, int]]) -> DataFrame:
        """One scan of the open deliveries. Files are sorted by place, so what was taken is skipped by their statistics."""
        beyond = [(F.col("_delivery") == d) & (F.col("_place") > mark) for d, mark, _ in open_]
        return self.spark.read.parquet(*[f"{self.root}/arrived/{d}" for d, _, _ in open_]).where(reduce(lambda a, b: a | b, beyond))

    def take(self, rows: DataFrame | None, number: int) -> None:
        """For foreachBatch: add the rows (None: only drain), then take the batch. The marks come last, so a batch that stops
        before them is run again from the same state; one that has its marks does nothing."""
        if number in self.marks.versions():
            return
        before = self._open(self.marks.before(number))
        if rows is not None:
            placed = rows.orderBy(*self.order).withColumn("_place", F.monotonically_increasing_id()).withColumn("_delivery", F.lit(number).cast("long"))
            placed.write.mode("overwrite").parquet(f"{self.root}/arrived/{number}")
            n = self.spark.read.parquet(f"{self.root}/arrived/{number}").count()
            before += [(number, -1, n)] if n else []
        now = []
        if before:
            out = f"{self.root}/taken/batch={number}"
            self._waiting(before).orderBy(*self.order, "_delivery", "_place").limit(self.cap).write.mode("overwrite").parquet(out)
            got = {r["_delivery"]: (r["mark"], r["n"]) for r in self.spark.read.parquet(out).groupBy("_delivery").agg(F.max("_place").alias("mark"), F.count(F.lit(1)).alias("n")).collect()}
            now = [(d, *((got[d][0], left - got[d][1]) if d in got else (mark, left))) for d, mark, left in before]
        new = self.spark.createDataFrame(now, self.marks.schema)
        self.marks.merge(new, number, lambda old, rows: upsert.upsert_latest(old, rows, ["delivery"], [F.lit(0)]).where("left > 0"))

    def left(self) -> int:
        return sum(x[2] for x in self._open(max(self.marks.versions(), default=None)))

    def taken(self) -> DataFrame | None:
        """All that was taken, with the number of its batch; None if there was nothing yet."""
        return self._all("taken")

    def waiting(self) -> DataFrame | None:
        """What is still in the backlog; None if nothing is."""
        open_ = self._open(max(self.marks.versions(), default=None))
        return self._waiting(open_) if open_ else None

    def _all(self, name: str) -> DataFrame | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(f"{self.root}/{name}") if there else None
