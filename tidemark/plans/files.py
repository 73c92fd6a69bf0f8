"""File sources and sinks, round trips over files that are written from part's rows first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from ..sources import files
from ..views import events, read, with_sql
from .registry import query


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))


def _text(df: DataFrame, name: str) -> str:
    path = scratch(df.sparkSession, name)
    df.write.text(path)
    return path


@query("SELECT p_partkey AS id, p_name AS name FROM part")
def json_array_source(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an array of products."""
    docs = _parts(spark, d).groupBy(F.floor(F.col("id") / 500).alias("g")).agg(F.collect_list(F.struct("id", "name")).alias("products"))
    path = scratch(spark, "json-documents")
    docs.select("products").write.option("maxRecordsPerFile", 1).json(path)  # a document is a file
    return files.read_json_array(spark, path, "products", "id BIGINT, name STRING")


@query("SELECT p_partkey AS id, p_size AS size, 'good' AS kind FROM part WHERE p_partkey % 10 <> 0 AND p_size >= 10 UNION ALL SELECT NULL, count(*)::INT, 'bad' FROM part WHERE p_partkey % 10 = 0")
def json_lines_source(spark: SparkSession, d: str) -> DataFrame:
    """Lines of JSON, every tenth of them broken: good rows from a time on, and the number of bad ones."""
    line = F.to_json(F.struct("id", "size", F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.col("size"), F.lit(0)).cast("string").alias("at")))
    path = _text(_parts(spark, d).select(F.when(F.col("id") % 10 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")), "json-lines")
    good, bad = files.read_json_lines(spark, path, "id BIGINT, size INT, at STRING", since=("at", "2024-01-01 00:10:00"))
    return good.select("id", "size", F.lit("good").alias("kind")).unionByName(bad.agg(F.count(F.lit(1)).cast("int").alias("size")).select(F.lit(None).cast("bigint").alias("id"), "size", F.lit("bad").alias("kind")))


@query("SELECT p_partkey AS id, p_size AS size FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 90")
def tail_rows(spark: SparkSession, d: str) -> DataFrame:
    return files.tail(_parts(spark, d).select("id", "size"), [F.desc("size"), F.desc("id")], 90)


@query("SELECT p_partkey AS id, p_name AS name FROM part ORDER BY p_partkey LIMIT 40 OFFSET 60")
def paged_rows(spark: SparkSession, d: str) -> DataFrame:
    return files.page(_parts(spark, d).select("id", "name"), "id", 60, 40)


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE p_size END AS size, CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE p_name END AS name FROM part")
def state_defaults(spark: SparkSession, d: str) -> DataFrame:
    """A state file of which some rows lack some fields."""
    path = scratch(spark, "state")
    _parts(spark, d).select("id", F.when(F.col("id") % 3 != 0, F.col("size")).alias("size"), F.when(F.col("id") % 2 != 0, F.col("name")).alias("name")).write.json(path)
    return files.read_state(spark, path, "id BIGINT, size INT, name STRING", {"size": F.lit(7), "name": F.lit("-")})


@query(with_sql("events", rest="SELECT count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'view') AS warnings FROM ev"))
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "WARNING").otherwise("INFO no_ERRORS")
    return files.log_counts(spark, _text(e.select(F.concat_ws(" ", F.col("ts").cast("string"), level, "props").alias("value")), "log"))


@query("SELECT r_regionkey AS id, 'there' AS kind FROM region")
def optional_rows(spark: SparkSession, d: str) -> DataFrame:
    """A table that exists next to one that doesn't."""
    read(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id")).createOrReplaceTempView("optional_there")
    rows = lambda name: files.optional_table(spark, name, "id BIGINT")
    return rows("optional_there").withColumn("kind", F.lit("there")).unionByName(rows("optional_absent").withColumn("kind", F.lit("absent")))


@query("SELECT DISTINCT 'https://shop/products/' || p_size || '/' || replace(p_brand, '#', '-') AS url FROM part")
def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    loc = lambda kind: F.concat(F.lit(f"<url><loc> https://shop/{kind}/"), F.col("p_size").cast("string"), F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("</loc></url>"))
    path = _text(p.select(F.concat(loc("products"), loc("news")).alias("value")), "sitemap")
    return files.read_sitemap(spark, path, "%/products/%")


@query("SELECT p_partkey AS id, p_size AS size FROM part")
def json_append(spark: SparkSession, d: str) -> DataFrame:
    """Two appends to one folder of JSON lines, read again."""
    path, p = scratch(spark, "appended"), _parts(spark, d).select("id", "size")
    files.append(p.where("size <= 25"), path, "json")
    files.append(p.where("size > 25"), path, "json")
    return spark.read.schema("id BIGINT, size INT").json(path)


@query("SELECT printf('%s: %d parts, %d%%', p_brand, count(*), max(p_size)) AS line FROM part GROUP BY p_brand")
def report_text(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("m"))
    return files.report_lines(g, "%s: %d parts, %d%%", ["p_brand", "n", "m"])
