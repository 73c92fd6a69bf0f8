"""Values out of HTML pages and nested payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import nested
from ..views import events, read
from .registry import query


@query("SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title FROM pages")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", nested.title(F.col("html")).alias("title"))


@query("""SELECT page_id, pos, href FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1)::INT AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages))""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.posexplode(nested.links(F.col("html"))).alias("pos", "href")).select("page_id", (F.col("pos") + 1).alias("pos"), "href")


@query("""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, nullif(regexp_extract(html, '<meta charset="([^"]*)"', 1), '') AS charset, TRY_CAST(nullif(regexp_extract(html, 'track\\(([0-9]+)\\)', 1), '') AS BIGINT) AS tracked, contains(html, 'class="ad"') AS has_ad FROM pages""")
def embedded_values(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return read(spark, d, "pages").select("page_id", F.regexp_extract(h, '<html lang="([^"]*)"', 1).alias("lang"), F.nullif(F.regexp_extract(h, '<meta charset="([^"]*)"', 1), F.lit("")).alias("charset"),
        F.nullif(F.regexp_extract(h, r"track\(([0-9]+)\)", 1), F.lit("")).try_cast("bigint").alias("tracked"), h.contains('class="ad"').alias("has_ad"))


@query("""SELECT page_id, pos, label, href FROM (SELECT page_id, unnest(a) AS href, unnest(b) AS label, generate_subscripts(a, 1)::INT AS pos FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS a, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS b FROM pages))""")
def list_items(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("page_id", "html")
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)">'), 1).alias("href"), F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a>'), 1).alias("label"))
    return p.select("page_id", F.posexplode(both).alias("pos", "x")).select("page_id", (F.col("pos") + 1).alias("pos"), F.col("x.label").alias("label"), F.col("x.href").alias("href"))


@query("""WITH o AS (SELECT p_partkey AS id, string_split('240,' || (p_partkey % 200) || ',1/245,' || (p_size % 3) || ',1/bad/250,0,1/', '/') AS x FROM part)
SELECT id, split_part(v, ',', 1) AS size, split_part(v, ',', 2)::INT AS stock, split_part(v, ',', 2)::INT > 0 AS in_stock FROM (SELECT id, unnest(x) AS v FROM o) WHERE regexp_matches(v, '^[^,]+,-?[0-9]+')""")
def packed_option_parse(spark: SparkSession, d: str) -> DataFrame:
    packed = F.concat(F.lit("240,"), (F.col("p_partkey") % 200).cast("string"), F.lit(",1/245,"), (F.col("p_size") % 3).cast("string"), F.lit(",1/bad/250,0,1/"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.inline(nested.packed_options(packed)))


@query("""SELECT event_id, k, '{"items": [{"k": ' || k || '}, {"x": {"k": ' || (k + 1) || '}}]}' AS doc, k || '|' || (k + 1) AS found FROM (SELECT event_id, (props->>'k')::INT AS k FROM events)""")
def deep_find_json(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", "k", F.format_string('{"items": [{"k": %d}, {"x": {"k": %d}}]}', F.col("k"), F.col("k") + 1).alias("doc"))
    return e.withColumn("found", F.array_join(nested.deep_values(F.col("doc"), "k"), "|"))


@query("""SELECT event_id, (props->>'k')::INT AS k, user_id AS u FROM events""")
def graph_decode(spark: SparkSession, d: str) -> DataFrame:
    """Each event's values as a flattened graph, resolved and read again."""
    e = events(spark, d)
    flat = F.format_string('[["Reactive",1],{"k":2,"user":3,"tags":4},%d,{"id":5,"self":1},["Set",2,5],%d]', F.col("k"), F.col("user_id"))
    got = nested.resolve_graph(flat)
    return e.select("event_id", nested.dig(got, "k").cast("int").alias("k"), nested.dig(got, "user", "id").cast("bigint").alias("u"))
