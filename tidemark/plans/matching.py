"""Model numbers, names and joins between sources and the market, over the shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sizes
from ..functions import text as T
from ..operators import match
from ..views import events, market_products, read, with_sql
from .registry import query

N = r"""n AS (SELECT p_partkey AS id, p_brand AS brand, p_name || ' ' || CASE p_partkey % 10 WHEN 0 THEN 'DQ' || lpad(p_partkey::VARCHAR, 5, '0') || '-100' WHEN 1 THEN 'U' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') || 'PL' WHEN 2 THEN '- 화이트 / IO4244-' || lpad((p_partkey % 1000)::VARCHAR, 3, '0')
 WHEN 3 THEN '위스퍼_L' || lpad(p_partkey::VARCHAR, 8, '0') WHEN 4 THEN '그레이' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') || 'A529-100' WHEN 5 THEN lpad((p_partkey % 10000)::VARCHAR, 4, '0') || 'A759103' WHEN 6 THEN lpad(p_partkey::VARCHAR, 8, '0')
 WHEN 7 THEN lpad((p_partkey % 1000000)::VARCHAR, 6, '0') || '-01 (BLACK)' WHEN 8 THEN 'VN000' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') || 'A' ELSE '1j' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || 'c' END AS name FROM part)"""


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def named(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    code = [
        F.concat(F.lit("DQ"), _pad(k, 5), F.lit("-100")), F.concat(F.lit("U"), _pad(k % 10000, 4), F.lit("PL")), F.concat(F.lit("- 화이트 / IO4244-"), _pad(k % 1000, 3)), F.concat(F.lit("위스퍼_L"), _pad(k, 8)),
        F.concat(F.lit("그레이"), _pad(k % 10000, 4), F.lit("A529-100")), F.concat(_pad(k % 10000, 4), F.lit("A759103")), _pad(k, 8), F.concat(_pad(k % 1000000, 6), F.lit("-01 (BLACK)")),
        F.concat(F.lit("VN000"), _pad(k % 100000, 5), F.lit("A")), F.concat(F.lit("1j"), _pad(k % 1000, 3), F.lit("c")),
    ]
    pick = F.get(F.array(*code), (k % 10).cast("int"))
    return read(spark, d, "part").select(k.alias("id"), F.col("p_brand").alias("brand"), F.concat("p_name", F.lit(" "), pick).alias("name"))


def _norm_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(upper(trim({x})), '\s+', '-', 'g'), '-{{2,}}', '-', 'g'), '^-+|-+$', '', 'g')"


def _key_sql(x: str) -> str:
    return rf"regexp_replace({_norm_sql(x)}, '[\s-]', '', 'g')"


def _model_sql() -> str:
    """The cascade as SQL, from the same pattern table."""
    t = "upper(trim(name))"
    behind = f"nullif(regexp_extract({t}, '/[ \t]*([A-Z0-9][-A-Z0-9]+)', 1), '')"
    fits = " OR ".join(f"regexp_matches({behind}, '{p}')" for p in T.SLASH_PATTERNS[:2])
    out = [f"CASE WHEN {fits} THEN {behind} END", f"CASE WHEN regexp_matches({behind}, '{T.SLASH_PATTERNS[2]}') AND regexp_matches(substr({behind}, 4), '[A-Z]') THEN {behind} END"]
    for name, p in T.MODEL_PATTERNS:
        code = f"nullif(regexp_extract({t}, '(?:^|[^A-Z0-9]){p}(?:$|[^A-Z0-9])', 1), '')"
        if name == "runner_joined":
            code = f"substr({code}, 1, 8) || '-' || substr({code}, 9, 3)"
        elif name == "cap":
            code = f"CASE WHEN NOT regexp_matches({code}, '^(19|20)') THEN {code} END"
        elif name == "generic":
            code = f"CASE WHEN length({code}) >= 5 THEN {code} END"
        out.append(code)
    return f"nullif({_norm_sql(f'coalesce({', '.join(out)})')}, '')"


@query(f"WITH {N} SELECT id, name, {_model_sql()} AS model, {_key_sql('name')} AS key FROM n")
def model_extraction(spark: SparkSession, d: str) -> DataFrame:
    return named(spark, d).select("id", "name", T.extract_model(F.col("name")).alias("model"), T.model_key(F.col("name")).alias("key"))


@query(f"SELECT doc_id, {_model_sql().replace('name', 'text')} AS model FROM documents WHERE text IS NOT NULL")
def document_models(spark: SparkSession, d: str) -> DataFrame:
    """The model number of each document, from its whole text."""
    return read(spark, d, "documents").where("text is not null").select("doc_id", T.extract_model(F.col("text")).alias("model"))


@query(f"""WITH {N}, m AS (SELECT {_model_sql()} AS model, id FROM n) SELECT {_key_sql('model')} AS key, arg_min(model, id) AS first_value, string_agg(model, '|' ORDER BY id) AS all_values, count(*)::INT AS n FROM m WHERE model IS NOT NULL GROUP BY 1""")
def canonical_group_targets(spark: SparkSession, d: str) -> DataFrame:
    # Bound in a one-element array: inlined, the cascade would be generated once for each use.
    model = F.explode(F.filter(F.array(T.extract_model(F.col("name"))), lambda m: m.isNotNull()))
    m = named(spark, d).select("id", model.alias("model"))
    return match.group_targets(m.withColumn("key", T.model_key(F.col("model"))), "key", "model", "id")


SLASHED = f"""r AS (SELECT product_id, CASE product_id % 3 WHEN 0 THEN model_number WHEN 1 THEN model_number || '/X' || (product_id + 1) ELSE 'Y' || product_id || '/' || model_number END AS rm FROM market_products),
l AS (SELECT o_orderkey AS oid, CASE o_orderkey % 2 WHEN 0 THEN 'brand#' || (o_custkey % 25) || ' ' || (o_orderkey % 1000) ELSE 'x' || (o_orderkey % 500) END AS lm FROM orders),
b AS (SELECT {_key_sql('rm')} AS key, 0 AS level, product_id FROM r UNION ALL SELECT {_key_sql('p')}, 1, product_id FROM (SELECT product_id, unnest(string_split(rm, '/')) AS p, rm FROM r WHERE rm LIKE '%/%')),
best AS (SELECT * FROM b WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY level, product_id DESC) = 1)"""


def _slashed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = F.col("product_id")
    rm = F.when(p % 3 == 0, F.col("model_number")).when(p % 3 == 1, F.concat("model_number", F.lit("/X"), (p + 1).cast("string"))).otherwise(F.concat(F.lit("Y"), p.cast("string"), F.lit("/"), "model_number"))
    r = market_products(spark, d).select("product_id", rm.alias("rm"))
    o = F.col("o_orderkey")
    lm = F.when(o % 2 == 0, F.concat(F.lit("brand#"), (F.col("o_custkey") % 25).cast("string"), F.lit(" "), (o % 1000).cast("string"))).otherwise(F.concat(F.lit("x"), (o % 500).cast("string")))
    return read(spark, d, "orders").select(o.alias("oid"), lm.alias("lm")), r


@query(with_sql("market_products", rest=f"{SLASHED} SELECT oid, product_id, level FROM (SELECT *, {_key_sql('lm')} AS key FROM l) JOIN best USING (key)"))
def slash_key_match(spark: SparkSession, d: str) -> DataFrame:
    left, right = _slashed(spark, d)
    return match.slash_join(left, right, "lm", "rm", "product_id").select("oid", "product_id", "level")


@query(with_sql("market_products", rest=f"{SLASHED} SELECT oid, product_id FROM (SELECT *, {_key_sql('lm')} AS key FROM l) JOIN (SELECT key, max(product_id) AS product_id FROM b WHERE level = 0 GROUP BY 1) USING (key)"))
def key_match_last_wins(spark: SparkSession, d: str) -> DataFrame:
    left, right = _slashed(spark, d)
    return match.key_join(left, right, "lm", "rm", "product_id").select("oid", "product_id")


@query(with_sql("market_products", rest=f"""{SLASHED}, k AS (SELECT oid, v, key FROM (SELECT oid, unnest([0, 1]) AS v, unnest([{_key_sql('lm')}, substr({_key_sql('lm')}, 1, length({_key_sql('lm')}) - 1)]) AS key FROM l))
 SELECT oid, v AS variant, product_id FROM k JOIN (SELECT DISTINCT key, product_id FROM b WHERE level = 0) USING (key) QUALIFY row_number() OVER (PARTITION BY oid ORDER BY v, product_id) = 1"""))
def fallback_key_match(spark: SparkSession, d: str) -> DataFrame:
    left, right = _slashed(spark, d)
    k = T.model_key(F.col("lm"))
    keyed = right.select(T.model_key(F.col("rm")).alias("key"), "product_id").distinct()
    return match.fallback_join(left, keyed, [k, F.substring(k, F.lit(1), F.length(k) - 1)], "key", ["oid"], "product_id").select("oid", "variant", "product_id")


def _collab_sql(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in ("red", "blue")) + ")"


@query(with_sql("market_products", rest=rf"""r AS (SELECT product_id, CASE WHEN product_id % 2 = 0 THEN upper(brand) || '-' || (product_id % 40) ELSE 'ZZ-' || product_id || '/' || upper(brand) || '-' || (product_id % 40) END AS rm, CASE WHEN product_id % 3 = 0 THEN 'Supreme ' || name ELSE name END AS rn FROM market_products),
l AS (SELECT s_suppkey * 40 + j AS lid, 'brand#' || (s_suppkey % 25) || ' ' || j AS lm, CASE WHEN j % 2 = 0 THEN 'small ring' ELSE 'green widget' END AS ln FROM supplier, (SELECT unnest(range(40)) AS j)),
a AS (SELECT lid, ln, product_id, rn, prio FROM (SELECT *, {_norm_sql('lm')} AS k FROM l) JOIN (SELECT *, 0 AS prio, rm AS k FROM r UNION ALL SELECT *, 2, split_part(rm, '/', 1) FROM r WHERE rm LIKE '%/%' UNION ALL SELECT *, 2, split_part(rm, '/', -1) FROM r WHERE rm LIKE '%/%') USING (k) WHERE prio = 0 OR length(k) >= 6
 UNION ALL SELECT lid, ln, product_id, rn, 1 FROM l JOIN r ON lm = rm),
o AS (SELECT lid, product_id, min(prio) AS prio, any_value(ln) AS ln, any_value(rn) AS rn FROM a GROUP BY ALL)
SELECT lid, product_id AS rid, prio, count(*) OVER (PARTITION BY lid) AS n FROM o QUALIFY row_number() OVER (PARTITION BY lid ORDER BY contains(lower(rn), 'supreme')::INT, (len(list_filter(string_split(lower(ln), ' '), lambda w: length(w) > 3 AND contains(lower(rn), w))) > 0)::INT DESC, prio, product_id) = 1"""))
def prioritised_match(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("product_id")
    code = F.concat(F.upper("brand"), F.lit("-"), (p % 40).cast("string"))
    r = market_products(spark, d).select("product_id", F.when(p % 2 == 0, code).otherwise(F.concat(F.lit("ZZ-"), p.cast("string"), F.lit("/"), code)).alias("rm"), F.when(p % 3 == 0, F.concat(F.lit("Supreme "), "name")).otherwise(F.col("name")).alias("rn"))
    s = read(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("j"))
    left = s.select((F.col("s_suppkey") * 40 + F.col("j")).alias("lid"), F.concat(F.lit("brand#"), (F.col("s_suppkey") % 25).cast("string"), F.lit(" "), F.col("j").cast("string")).alias("lm"), F.when(F.col("j") % 2 == 0, "small ring").otherwise("green widget").alias("ln"))
    return match.ranked_match(left, r, "lid", "lm", "ln", "product_id", "rm", "rn")


@query(r"""WITH a AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 4 WHEN 0 THEN ' PRM QS' WHEN 1 THEN ' Retro (SE)' WHEN 2 THEN ' 레트로' ELSE '' END AS sn, p_name || CASE p_partkey % 3 WHEN 0 THEN ' premium' WHEN 1 THEN ' retro' ELSE ' Off-White' END AS mn FROM part),
k AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(sn), '[\s\-_/()]+'), lambda w: w <> '')) AS sk, list_distinct(list_filter(regexp_split_to_array(lower(mn), '[\s\-_/()]+'), lambda w: w <> '')) AS mk FROM a),
t AS (SELECT *, ['prm','premium','qs','retro','레트로','se','craft','next','nature','lx','flyknit','react','gore','tex','goretex','acg'] AS known FROM k),
u AS (SELECT id, contains(lower(mn), 'off-white') AND NOT contains(lower(sn), 'off-white') AS collab_fails, list_transform(list_filter(sk, lambda w: list_contains(known, w)), lambda w: CASE w WHEN 'prm' THEN 'premium' WHEN '레트로' THEN 'retro' ELSE w END) AS s, list_transform(list_filter(mk, lambda w: list_contains(known, w)), lambda w: CASE w WHEN 'prm' THEN 'premium' WHEN '레트로' THEN 'retro' ELSE w END) AS m FROM t)
SELECT id, collab_fails, array_to_string(list_sort(list_distinct(list_filter(s, lambda w: NOT list_contains(m, w)))), '|') AS extra FROM u""")
def collab_subtype_guards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    sn = F.concat("p_name", F.when(k % 4 == 0, " PRM QS").when(k % 4 == 1, " Retro (SE)").when(k % 4 == 2, " 레트로").otherwise(""))
    mn = F.concat("p_name", F.when(k % 3 == 0, " premium").when(k % 3 == 1, " retro").otherwise(" Off-White"))
    a = read(spark, d, "part").select(k.alias("id"), sn.alias("sn"), mn.alias("mn"))
    extra = T.extra_subtypes(T.keywords(F.col("mn")), T.keywords(F.col("sn")))
    return a.select("id", T.collab_mismatch(F.col("mn"), F.col("sn")).alias("collab_fails"), F.array_join(F.array_sort(extra), "|").alias("extra"))


@query("""WITH p AS (SELECT p_brand AS brand, p_partkey AS id, list_sort(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))) AS ws FROM part),
c AS (SELECT brand, ws, min(id) AS cls, count(*) AS n FROM p GROUP BY ALL)
SELECT a.cls AS lid, b.cls AS rid, len(list_intersect(a.ws, b.ws)) AS shared, a.n AS left_rows, b.n AS right_rows FROM c a JOIN c b ON a.brand = b.brand AND len(list_intersect(a.ws, b.ws)) >= 2""")
def token_overlap_match(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of equal word sets, each named by its least id."""
    p = read(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), T.keywords(F.concat_ws(" ", "p_name", "p_type")).alias("words"))
    c = match.word_classes(p, "id", "words", "brand")
    out = match.token_join(c, c, "cls", "cls", "words", "words", "brand")
    n = c.select(F.col("cls").alias("lid"), F.col("n").alias("left_rows"))
    return out.join(n, "lid").join(n.select(F.col("lid").alias("rid"), F.col("left_rows").alias("right_rows")), "rid").select("lid", "rid", "shared", "left_rows", "right_rows")


@query("""WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS w FROM part) SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM n WHERE length(w) >= 4 AND length(text) >= 4 AND (contains(lower(text), w) OR contains(w, lower(text))))""")
def substring_brand_join(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "part").select(F.split("p_name", " ")[1].alias("w")).distinct()
    docs = read(spark, d, "documents").select("doc_id", "text")
    return match.substring_join(docs, words, F.lower("text"), F.col("w")).select("doc_id")


@query(with_sql("market_products", rest="SELECT product_id FROM market_products a WHERE length(model_number) >= 4 AND EXISTS (SELECT 1 FROM market_products b WHERE b.category LIKE 'PROMO%' AND length(b.model_number) >= 4 AND starts_with(b.model_number, substr(a.model_number, 1, 10)))"))
def prefix_match(spark: SparkSession, d: str) -> DataFrame:
    m = market_products(spark, d).select("product_id", "model_number", "category")
    return match.prefix_join(m, m.where("category like 'PROMO%'"), "model_number", 10).select("product_id")


@query("""WITH l AS (SELECT o_orderkey AS oid, 'Brand#' || (o_custkey % 25) AS brand, string_split(CASE o_orderkey % 3 WHEN 0 THEN 'red widget' WHEN 1 THEN 'blue bolt' ELSE 'none' END, ' ') AS lt FROM orders),
r AS (SELECT p_brand AS brand, p_partkey AS pid, list_distinct(string_split(lower(p_name), ' ')) AS rt FROM part),
j AS (SELECT oid, pid, len(list_intersect(lt, rt)) AS shared, count(*) OVER (PARTITION BY oid) AS hits, row_number() OVER (PARTITION BY oid ORDER BY len(list_intersect(lt, rt)) DESC, len(rt), pid) AS n FROM l JOIN r USING (brand))
SELECT oid, pid, shared::INT AS shared, hits FROM j WHERE n = 1 AND (shared >= 1 OR hits = 1)""")
def colour_disambiguation(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey") % 3
    left = read(spark, d, "orders").select(F.col("o_orderkey").alias("oid"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25).cast("string")).alias("brand"), T.colour_tokens(F.when(o == 0, "red widget").when(o == 1, "blue bolt").otherwise("none")).alias("lt"))
    right = read(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("pid"), T.colour_tokens(F.col("p_name")).alias("rt"))
    return match.colour_pick(left, right, "brand", "oid", "pid", "lt", "rt").select("oid", "pid", "shared", "hits")


@query("""WITH r AS (SELECT p_brand || p_size AS k, p_partkey AS pid FROM part), h AS (SELECT k, count(*) AS hits FROM r GROUP BY k)
SELECT l.pid AS lid, r.pid, hits, CASE WHEN hits = 1 THEN 'single' WHEN hits <= 2 THEN 'several' ELSE 'ambiguous' END AS status FROM r l JOIN h USING (k) LEFT JOIN r ON r.k = l.k AND hits <= 2""")
def hit_status(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("k"), F.col("p_partkey").alias("pid"))
    return match.hit_summary(p.withColumnRenamed("pid", "lid"), p, "k", "pid").select("lid", "pid", "hits", "status")


@query(with_sql("events", rest="""c AS (SELECT user_id, k % 10 AS code, CASE WHEN event_type = 'purchase' THEN 'checkout' WHEN event_type = 'view' THEN 'pdp' END AS page_type, ts, event_id FROM ev WHERE event_type IN ('purchase', 'view', 'error')),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id, code ORDER BY CASE WHEN page_type = 'checkout' THEN 0 ELSE 1 END, ts DESC, event_id DESC) = 1), a AS (SELECT DISTINCT user_id, k % 10 AS code FROM ev)
SELECT a.user_id, a.code, b.page_type, b.event_id FROM a LEFT JOIN b USING (user_id, code)"""))
def coupon_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("code", F.col("k") % 10)
    page = F.when(F.col("event_type") == "purchase", "checkout").when(F.col("event_type") == "view", "pdp")
    catches = e.where(F.col("event_type").isin("purchase", "view", "error")).select("user_id", "code", page.alias("page_type"), "ts", "event_id")
    return match.pick_catch(e.select("user_id", "code").distinct(), catches, ["user_id", "code"], "page_type", "ts", "event_id").select("user_id", "code", "page_type", "event_id")


@query("""WITH a AS (SELECT p_partkey AS id, unnest(CASE p_partkey % 3 WHEN 0 THEN ['270(US9)', 'F'] WHEN 1 THEN ['280', ' 290'] ELSE ['One Size', 'M'] END) AS s FROM part), c AS (SELECT id, s, CASE WHEN upper(trim(s)) IN ('FREE', 'F', 'ONE SIZE', 'ONESIZE', 'OS') THEN 'ONE SIZE' ELSE upper(trim(s)) END AS canon FROM a)
SELECT id, s, m AS market_size FROM c, (VALUES ('270'), ('280'), ('290'), ('OS')) v(m) WHERE canon = CASE WHEN m = 'OS' THEN 'ONE SIZE' ELSE m END OR trim(split_part(canon, '(', 1)) = m""")
def size_intersection(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    pick = F.when(k == 0, F.array(F.lit("270(US9)"), F.lit("F"))).when(k == 1, F.array(F.lit("280"), F.lit(" 290"))).otherwise(F.array(F.lit("One Size"), F.lit("M")))
    a = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(pick).alias("s"))
    market = spark.createDataFrame([("270",), ("280",), ("290",), ("OS",)], "market_size STRING")
    # Both keys of a size are exploded, so the join is by key and not by a condition.
    a = a.withColumn("k", F.explode(F.array_distinct(F.array(sizes.canonical_size(F.col("s")), sizes.base_size(F.col("s"))))))
    m = market.withColumn("k", F.explode(F.array_distinct(F.array(sizes.canonical_size(F.col("market_size")), sizes.base_size(F.col("market_size"))))))
    return a.join(m, "k").select("id", "s", "market_size").distinct()
