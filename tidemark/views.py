"""Logical tables over the shared star-schema files: DataFrame functions, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import normalize_model


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def market_products(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    raw = F.concat(F.col("p_brand"), F.lit("-"), F.col("p_partkey").cast("string"))
    return p.select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.col("p_size").cast("string").alias("size"), normalize_model(raw).alias("model_number"))


def market_prices(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("product_id"), F.col("l_linenumber").alias("size"), F.floor("l_extendedprice").cast("bigint").alias("sell"), F.col("l_shipdate").alias("ts"))


def retail_prices(spark: SparkSession, d: str) -> DataFrame:
    paid = F.floor(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).cast("bigint")
    return read(spark, d, "lineitem").where("l_returnflag <> 'R'").select(
        F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("product_id"), F.col("l_linenumber").alias("size"), paid.alias("price"),
        (F.col("l_linestatus") == "O").alias("in_stock"), F.col("l_shipdate").alias("ts"))


def retail_products(spark: SparkSession, d: str) -> DataFrame:
    return retail_prices(spark, d).select("source", "product_id").distinct()


def volumes(spark: SparkSession, d: str, days: int = 365) -> DataFrame:
    """Trades of each product within `days` of the last trade of all; products without one are absent."""
    li = read(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_shipdate").alias("ts"))
    last = li.agg(F.max("ts").alias("asof"))
    return li.join(F.broadcast(last), F.col("ts") > F.col("asof") - F.make_dt_interval(F.lit(days))).groupBy("product_id").agg(F.count(F.lit(1)).alias("volume"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with k (from the JSON properties), a status by k and the source's name."""
    e = read(spark, d, "events")
    k = F.from_json("props", "k INT")["k"]
    return e.select("event_id", "ts", "user_id", "event_type", "value", "props", k.alias("k"))


# The same views as common table expressions.
SQL = {
    "market_products": r"""market_products AS (SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS category, p_size::VARCHAR AS size,
      regexp_replace(regexp_replace(regexp_replace(upper(trim(p_brand || '-' || p_partkey)), '\s+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS model_number FROM part)""",
    "market_prices": "market_prices AS (SELECT l_partkey AS product_id, l_linenumber AS size, floor(l_extendedprice)::BIGINT AS sell, l_shipdate AS ts FROM lineitem WHERE l_returnflag = 'R')",
    "retail_prices": "retail_prices AS (SELECT l_suppkey AS source, l_partkey AS product_id, l_linenumber AS size, floor(l_extendedprice * (1.0::DOUBLE - l_discount))::BIGINT AS price, l_linestatus = 'O' AS in_stock, l_shipdate AS ts FROM lineitem WHERE l_returnflag <> 'R')",
    "retail_products": "retail_products AS (SELECT DISTINCT source, product_id FROM retail_prices)",
    "volumes": "volumes AS (SELECT l_partkey AS product_id, count(*) AS volume FROM lineitem WHERE l_shipdate > (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 365 DAY GROUP BY 1)",
    "events": "ev AS (SELECT event_id, ts, user_id, event_type, value, props, (props->>'k')::INT AS k FROM events)",
}


def with_sql(*names: str, rest: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + ("" if rest.lstrip().upper().startswith("SELECT") else ",") + "\n" + rest
