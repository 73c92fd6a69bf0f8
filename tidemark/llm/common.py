"""What the corpus operators share: the shared work folder, tables that cut lineage, and joins that stand a hot key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and \t \n \v \f \r.
WS = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"

#: A key is hot if it holds at least this share of the rows; at most 1 / HOT_SHARE keys can be.
HOT_SHARE = 1 / 500


#: Folders made by this driver and not deleted yet.
_MADE: set[str] = set()


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the session names; a temporary one only where none is set (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.add(path)
    return path


#: Spark removes the shuffle files of a query at its end if this is on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str, bucket: tuple[int, list[str]] | None = None) -> None:
    """Write a DataFrame as Parquet; the shuffle files of the write go with its end. With bucket=(n, keys) it becomes an
    external table of n buckets, each sorted by the keys, whose joins by them need neither a shuffle nor a new deal."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        out = df.write.option("compression", "zstd")
        if bucket is None:
            out.parquet(path)
        else:
            out.bucketBy(bucket[0], *bucket[1]).sortBy(*bucket[1]).option("path", path).format("parquet").saveAsTable(path.rpartition("/")[2].replace("-", "_"))
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: lineage ends there, and a lost executor costs one stage.
    Tables that nothing reads any more go by `drop`, those that a result still reads by `clear`."""
    spark, path, schema = df.sparkSession, work_path(df.sparkSession, name), df.schema
    written(df, path)
    out = spark.read.schema(schema).parquet(path)
    out._work = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_work", None):
            _delete(t.sparkSession, path)
            _MADE.discard(path)


def clear(spark: SparkSession) -> None:
    """Delete all work tables this driver has made. Results that were not written or collected yet can't be read after it."""
    for path in sorted(_MADE):
        _delete(spark, path)
    _MADE.clear()


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE, weight: Column | None = None) -> DataFrame:
    """Keys that hold at least `share` of the rows, at least 1,000 of them. No more than 1 / share keys can: a bound by
    counting, which holds at every size."""
    counts = df.groupBy(*keys).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    total = df.agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_all"))
    return counts.where("_n >= 1000").join(F.broadcast(total), F.col("_n") >= F.col("_all") * share).select(*keys)


def lookup(rows: DataFrame, unique: DataFrame, keys: list[str], hot: DataFrame, how: str = "left") -> DataFrame:
    """Join rows with a table that is unique by `keys`. The hot keys' rows (`hot`, at most 1 / HOT_SHARE keys, see
    hot_keys) stay where they are and meet broadcast copies; all others shuffle by key."""
    own = [c for c in unique.columns if c not in keys]
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    few = F.broadcast(unique.join(hot, keys, "left_semi"))
    marked = rows.join(hot, keys, "left")
    if how in ("left_semi", "left_anti"):
        return (
            marked.where("_hot").drop("_hot").join(few, keys, how)
            .unionByName(marked.where("_hot is null").drop("_hot").join(unique.hint("merge"), keys, how))
        )
    out = [*rows.columns, *own]
    return (
        marked.where("_hot").join(few, keys, how).select(*out)
        .unionByName(marked.where("_hot is null").join(unique.hint("merge"), keys, how).select(*out))
    )
