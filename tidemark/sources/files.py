"""File sources and sinks: JSON documents, JSON lines with bad rows, text logs, site maps, state files, optional tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_array(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """Elements of the array `field` of JSON documents, one row each."""
    return spark.read.schema(f"`{field}` ARRAY<STRUCT<{schema}>>").json(path, multiLine=True).select(F.inline(field))


def read_json_lines(spark: SparkSession, path: str, schema: str, since: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of JSON lines; with since=(column, time) only rows from that time on. Lines are read as text first, so that counting bad ones needs no columns."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("_r", F.from_json("value", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_r").isNull() | F.col("_r._bad").isNotNull()
    good = parsed.where(~bad).select("_r.*").drop("_bad")
    if since is not None:
        good = good.where(F.try_to_timestamp(F.col(since[0])) >= F.to_timestamp(F.lit(since[1])))
    return good, parsed.where(bad).select(F.col("value").alias("line"))


def tail(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The last n rows by `order`: a bounded top-n."""
    return df.orderBy(*order).limit(n)


def read_state(spark: SparkSession, path: str, schema: str, defaults: dict[str, Column]) -> DataFrame:
    """State rows with missing fields filled."""
    df = spark.read.schema(schema).json(path)
    return df.select(*[F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c) for c in df.columns])


def log_counts(spark: SparkSession, path: str) -> DataFrame:
    """Errors and warnings in log files."""
    lines = spark.read.text(path)
    return lines.agg(F.count_if(F.col("value").rlike(r"\bERROR\b")).alias("errors"), F.count_if(F.col("value").rlike(r"\bWARNING\b")).alias("warnings"))


def read_sitemap(spark: SparkSession, path: str, like: str = "%") -> DataFrame:
    """Product URLs of XML site maps. A record goes from one opening tag to the next, so a file of any size is read in parts."""
    text = spark.read.text(path, lineSep="<loc>")
    url = F.regexp_extract("value", r"\A\s*([^<\s]+)\s*</loc>", 1)
    return text.select(url.alias("url")).where((F.col("url") != "") & F.col("url").like(like)).distinct()


def optional_table(spark: SparkSession, name: str, schema: StructType | str) -> DataFrame:
    """The table, or no rows of its schema if it doesn't exist."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)


def page(df: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    return df.orderBy(key).offset(offset).limit(limit)


def append(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    w = df.write.mode("append").format(kind)
    (w.partitionBy(*by) if by else w).save(path)


def report_lines(df: DataFrame, template: str, columns: list[str]) -> DataFrame:
    """Rows as text lines of a printf template."""
    return df.select(F.format_string(template, *columns).alias("line"))
