"""Item rows out of attributes, nested payloads, option lists and caches. Payloads are made of part's rows, so that SQL can
say what must come out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.price import merge_size_prices
from ..sources import nested
from ..views import read
from .registry import query


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.floor("p_retailprice").cast("bigint").alias("price"))


#: Parts by hundreds: a page, a listing, a payload.
PAGED = "p AS (SELECT p_partkey AS id, p_partkey // 100 AS page, p_name AS name, p_brand AS brand, p_size AS size, floor(p_retailprice)::BIGINT AS price FROM part)"


@query(f"WITH {PAGED} SELECT page, id, name, price FROM p")
def attribute_cards(spark: SparkSession, d: str) -> DataFrame:
    """Analytics attributes of a list page, as item rows."""
    item = F.to_json(F.struct("id", "name", F.col("price").cast("string").alias("price")))
    tag = F.concat(F.lit('<li data-item="'), F.replace(item, F.lit('"'), F.lit("&quot;")), F.lit('">x</li>'))
    pages = _parts(spark, d).groupBy(F.floor(F.col("id") / 100).alias("page")).agg(F.concat_ws("", F.collect_list(tag)).alias("html"))
    return pages.select("page", F.inline(nested.attribute_items(F.col("html"), "data-item", "STRUCT<id: BIGINT, name: STRING, price: STRING>"))).withColumn("price", F.col("price").cast("bigint"))


@query(f"WITH {PAGED} SELECT id // 10 AS box, id, price FROM p WHERE (id // 10) % 4 <> 3")
def unwrapped_lists(spark: SparkSession, d: str) -> DataFrame:
    """A list, a list under one of two names, or nothing of the kind."""
    lists = _parts(spark, d).groupBy(F.floor(F.col("id") / 10).alias("box")).agg(F.to_json(F.collect_list(F.struct("id", "price"))).alias("l"))
    k = F.col("box") % 4
    doc = F.when(k == 0, F.col("l")).when(k == 1, F.concat(F.lit('{"items": '), "l", F.lit("}"))).when(k == 2, F.concat(F.lit('{"n": 1, "data": '), "l", F.lit("}"))).otherwise('{"other": 1}')
    return lists.select("box", F.inline(nested.unwrapped(doc, ("items", "data"), "STRUCT<id: BIGINT, price: BIGINT>")))


def _listing(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 25 items at two depths, each item twice."""
    card = F.to_json(F.struct(F.col("id").alias("product_id"), "name", F.struct(F.col("price").alias("amount")).alias("price")))
    rows = _parts(spark, d).groupBy(F.floor(F.col("id") / 25).alias("page")).agg(F.sort_array(F.collect_list(F.struct("id", card.alias("c")))).alias("cs"))
    some = lambda odd: F.array_join(F.transform(F.filter("cs", lambda x: x["id"] % 2 == odd), lambda x: x["c"]), ",")
    return rows.select("page", F.concat(F.lit('{"sections": [{"items": ['), some(0), F.lit(']}, {"more": {"cards": ['), some(1), F.lit("]}}], \"again\": ["), some(0), F.lit("]}")).alias("doc"))


@query("""SELECT page, row_number() OVER (PARTITION BY page ORDER BY id % 2, id)::INT AS pos, id, name, price FROM (SELECT p_partkey AS id, p_partkey // 25 AS page, p_name AS name, floor(p_retailprice)::BIGINT AS price FROM part) QUALIFY pos <= 20""")
def payload_cards(spark: SparkSession, d: str) -> DataFrame:
    out = nested.cards(_listing(spark, d), "doc", ["product_id", "name"], "product_id", 20)
    i = F.col("item")
    return out.select("page", "pos", nested.dig(i, "product_id").cast("bigint").alias("id"), nested.dig(i, "name").alias("name"), nested.dig(i, "price", "amount").cast("bigint").alias("price"))


@query("""SELECT page, max(CASE WHEN id = page * 25 + 7 THEN name END) AS name FROM (SELECT p_partkey AS id, p_partkey // 25 AS page, p_name AS name FROM part) GROUP BY 1""")
def payload_item(spark: SparkSession, d: str) -> DataFrame:
    wanted = (F.col("page") * 25 + 7).cast("string")
    return _listing(spark, d).select("page", nested.dig(nested.item_by_id(F.col("doc"), ["product_id", "name"], "product_id", wanted), "name").alias("name"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 4 < 3 THEN floor(p_retailprice)::BIGINT END AS price FROM part""")
def alias_prices(spark: SparkSession, d: str) -> DataFrame:
    v, k = F.col("price").cast("string"), F.col("size") % 4
    doc = F.when(k == 0, F.concat(F.lit('{"price": '), v, F.lit(', "amount": 1}'))).when(k == 1, F.concat(F.lit('{"price": "", "amount": '), v, F.lit("}"))).when(k == 2, F.concat(F.lit('{"value": "'), v, F.lit('"}'))).otherwise("{}")
    return _parts(spark, d).select("id", nested.first_key(doc, "price", "amount", "value").cast("bigint").alias("price"))


@query("""WITH o AS (SELECT p_partkey AS id, p_partkey * 10 + j AS opt, j FROM part, (SELECT unnest(range(3)) AS j)), i AS (SELECT l_partkey * 10 + l_linenumber % 3 AS opt, sum(l_quantity)::BIGINT - 60 AS stock FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)
 SELECT id, o.opt, coalesce(stock > 0, false) AS in_stock FROM o LEFT JOIN i USING (opt) WHERE (id + j) % 4 <> 0""")
def option_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Activated options with the inventory of another payload; an option without one is out of stock."""
    o = _parts(spark, d).select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")).select("id", (F.col("id") * 10 + F.col("j")).alias("opt"), ((F.col("id") + F.col("j")) % 4 != 0).alias("on"))
    li = read(spark, d, "lineitem").where("l_returnflag <> 'A'")
    i = li.groupBy((F.col("l_partkey") * 10 + F.col("l_linenumber") % 3).alias("opt")).agg((F.sum("l_quantity").cast("bigint") - 60).alias("stock"))
    return nested.option_stock(o, i, "opt", "on", "stock").select("id", "opt", "in_stock")


@query("""WITH o AS (SELECT p_partkey AS id, j AS n, 1 + j % 2 AS level, CASE WHEN (p_partkey + j) % 3 = 0 THEN 'red' ELSE 'blue' END AS parent, j % 5 <> 0 AS orderable, (p_partkey * j) % 4 AS stock FROM part, (SELECT unnest(range(1, 9)) AS j))
 SELECT p_partkey AS id, coalesce(s, '') AS sizes FROM part LEFT JOIN (SELECT id, string_agg('s' || n, '|' ORDER BY n) AS s FROM o WHERE level = 2 AND parent = 'red' AND n % 7 <> 0 AND orderable AND stock > 0 GROUP BY 1) x ON x.id = p_partkey""")
def colour_options(spark: SparkSession, d: str) -> DataFrame:
    option = lambda j: F.struct(
        (1 + j % 2).alias("level"), F.when((F.col("id") + j) % 3 == 0, "red").otherwise("blue").alias("parent"), F.concat(F.lit("s"), j.cast("string")).alias("name"),
        F.when(j % 7 != 0, "ON").otherwise("OFF").alias("status"), (j % 5 != 0).alias("orderable"), ((F.col("id") * j) % 4).alias("stock"))
    options = F.transform(F.sequence(F.lit(1), F.lit(8)), option)
    return _parts(spark, d).select("id", F.array_join(nested.colour_sizes(options, F.lit("red")), "|").alias("sizes"))


@query("""WITH a AS (SELECT l_partkey AS id, l_linenumber AS size, min(floor(l_extendedprice)::BIGINT) AS ask, CASE WHEN any_value(l_linenumber) % 2 = 0 THEN max(floor(l_extendedprice)::BIGINT) END AS last FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), b AS (SELECT l_partkey AS id, l_linenumber AS size, max(floor(l_tax * 10000)::BIGINT) AS last FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL)
 SELECT id, size, ask, coalesce(a.last, b.last) AS last FROM a FULL JOIN b USING (id, size)""")
def merged_sizes(spark: SparkSession, d: str) -> DataFrame:
    """A primary price list, and a second that only adds sizes and fills in last sales."""
    li = read(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("size"), F.floor("l_extendedprice").cast("bigint").alias("p"), F.floor(F.col("l_tax") * 10_000).cast("bigint").alias("t"), "l_returnflag")
    a = li.where("l_returnflag = 'R'").groupBy("id", "size").agg(F.min("p").alias("ask"), F.max("p").alias("last")).withColumn("last", F.when(F.col("size") % 2 == 0, F.col("last")))
    b = li.where("l_returnflag = 'N'").groupBy("id", "size").agg(F.max("t").alias("last"))
    return merge_size_prices(a, b, ["id", "size"], "last").select("id", "size", "ask", "last")


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'og ' || p_name WHEN 1 THEN 'title ' || p_name WHEN 2 THEN 'h1 ' || p_name WHEN 3 THEN 'ld ' || p_name WHEN 4 THEN 'link ' || p_name END AS name FROM part""")
def page_names(spark: SparkSession, d: str) -> DataFrame:
    """Five ways to a page's name, each on pages that lack those before it."""
    k, n = F.col("id") % 6, F.col("name")
    part = lambda at, a, b: F.when(k <= at, F.concat(F.lit(a), F.when(k == at, n).otherwise("other"), F.lit(b))).otherwise("")
    html = F.concat(
        F.when(k == 0, F.concat(F.lit('<meta property="og:title" content="og '), n, F.lit('">'))).otherwise('<meta property="og:title" content="">'),
        F.when(k == 1, F.concat(F.lit("<title> title "), n, F.lit(" </title>"))).otherwise("<title> </title>"), part(2, "<h1 class=t>h1 ", "</h1>"),
        part(3, '<script type="application/ld+json">{"name": "ld ', '"}</script>'), part(4, '<a href="/">link ', "</a>"))
    return _parts(spark, d).select("id", nested.page_name(html).alias("name"))


@query("SELECT p_partkey AS id, floor(p_retailprice)::BIGINT AS price, p_size AS stock FROM part")
def script_payloads(spark: SparkSession, d: str) -> DataFrame:
    """A script's JSON, whose offer is a reference into a normalised cache; the offer found by its keys."""
    cache = F.to_json(F.struct(F.struct("price", F.col("size").alias("stock")).alias("Offer:1"), F.struct(F.lit("Offer:1").alias("__ref")).alias("Product:1")))
    html = F.concat(F.lit('<script>x()</script><script id="state" type="application/json">'), cache, F.lit("</script>"))
    got = nested.script_json(html, 'id="state"')
    offer = nested.referenced(got, nested.dig(got, "Product:1"))
    price = nested.dig(F.get(nested.deep_objects(got, ["price", "stock"]), F.lit(0)), "price")
    return _parts(spark, d).select("id", price.cast("bigint").alias("price"), nested.dig(offer, "stock").cast("int").alias("stock"))


@query("""SELECT p_partkey AS id, 'S' || p_partkey AS sku, size, CASE size WHEN '240' THEN p_size ELSE 0 END::BIGINT AS stock FROM part, (SELECT unnest(['240', '250']) AS size) WHERE size = '240' OR p_size % 2 = 0""")
def cached_size_stock(spark: SparkSession, d: str) -> DataFrame:
    """A product's sizes and stock, by references into a normalised cache; one is absent and some lack a stock."""
    doc = F.concat(
        F.lit('{"Product:1": {"sku": "S'), F.col("id").cast("string"), F.lit('", "variants": ["Variant:1", "Variant:2", "Variant:9"]}, "Other:1": {"sku": "no"}, "Variant:1": {"size": "240", "stock": '),
        F.col("size").cast("string"), F.lit('}, "Variant:2": {"size": "250"'), F.when(F.col("size") % 2 == 0, ', "stock": 0').otherwise(""), F.lit("}}"))
    return _parts(spark, d).select("id", F.inline(nested.cached_sizes(doc)))
