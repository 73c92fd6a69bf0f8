"""Values of text columns: codes, prices, sizes, dates and schedule rules, one row per part or event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, sizes, text, tiers, times
from ..operators import gates, rules, upsert
from ..views import events, read, with_sql
from .registry import query


def _part(spark: SparkSession, d: str) -> tuple[DataFrame, Column, Column]:
    return read(spark, d, "part"), F.col("p_partkey"), F.col("p_size")


def _s(c: Column) -> Column:
    return c.cast("string")


@query(r"""WITH p AS (SELECT p_partkey AS id, 'B' || p_partkey AS style, CASE p_partkey % 3 WHEN 0 THEN lpad(p_size::VARCHAR, 3, '0') WHEN 1 THEN 'red' END AS colour,
  lpad(p_partkey::VARCHAR, 6, '0') || CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '/' END || lpad(p_size::VARCHAR, 2, '0') AS under, lpad((p_partkey % 100000)::VARCHAR, 5, '0') || CASE WHEN p_size % 2 = 0 THEN 'a1' ELSE '' END || CASE WHEN p_size % 7 = 0 THEN 'zz' ELSE '' END AS dig,
  'X00' || p_partkey || '-' || p_size AS sku, 'https://shop/p/' || lower(replace(p_brand, '#', '')) || '.' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '/?c=1' ELSE '' END AS url,
  '[' || p_brand || CASE WHEN p_size % 3 = 0 THEN ' x ' ELSE ' ' END || p_type || ']' AS br, p_name || '_100%\' AS lk FROM part)
 SELECT id, CASE WHEN regexp_matches(colour, '^[0-9]{3}$') THEN style || '-' || colour ELSE style END AS styled, CASE WHEN regexp_matches(replace(under, '_', '-'), '^[0-9]{6}-[0-9]{2}$') THEN replace(under, '_', '-') ELSE '' END AS dashed,
  nullif(regexp_extract(upper(dig), '^([0-9]{5})([A-Z][0-9])?$', 1), '') AS five, regexp_extract(sku, '([0-9]+)', 1)::BIGINT AS number, upper(replace(regexp_extract(url, '/([^/?#]+)/?(?:[?#].*)?$', 1), '.', '-')) AS last_part,
  regexp_matches(br, '\[[^\[\]]*[xX×][^\[\]]*\]') AS collab, replace(replace(replace(lk, '\', '\\'), '%', '\%'), '_', '\_') AS literal FROM p""")
def code_rules(spark: SparkSession, d: str) -> DataFrame:
    p, k, n = _part(spark, d)
    pad = lambda c, w: F.lpad(_s(c), w, "0")
    url = F.concat(F.lit("https://shop/p/"), F.lower(F.replace("p_brand", F.lit("#"))), F.lit("."), _s(k), F.when(n % 2 == 0, "/?c=1").otherwise(""))
    return p.select(
        k.alias("id"), text.style_colour(F.concat(F.lit("B"), _s(k)), F.when(k % 3 == 0, pad(n, 3)).when(k % 3 == 1, "red")).alias("styled"),
        text.underscore_model(F.concat(pad(k, 6), F.when(k % 2 == 0, "_").otherwise("/"), pad(n, 2))).alias("dashed"),
        text.style_digits(F.concat(pad(k % 100_000, 5), F.when(n % 2 == 0, "a1").otherwise(""), F.when(n % 7 == 0, "zz").otherwise(""))).alias("five"),
        text.style_number(F.concat(F.lit("X00"), _s(k), F.lit("-"), _s(n))).alias("number"), text.sku_from_url(url).alias("last_part"),
        text.bracket_collab(F.concat(F.lit("["), "p_brand", F.when(n % 3 == 0, " x ").otherwise(" "), "p_type", F.lit("]"))).alias("collab"),
        text.like_literal(F.concat("p_name", F.lit("_100%\\"))).alias("literal"))


@query("""WITH p AS (SELECT p_partkey AS id, floor(p_retailprice)::BIGINT AS v, p_size AS n, CASE p_partkey % 4 WHEN 0 THEN floor(p_retailprice)::BIGINT || '원' WHEN 1 THEN 'free' WHEN 2 THEN '1,' || lpad(p_size::VARCHAR, 3, '0') || '.5' ELSE '0' END AS t FROM part)
 SELECT id, CASE WHEN try_cast(regexp_replace(t, '[^0-9]', '', 'g') AS BIGINT) > 0 THEN try_cast(regexp_replace(t, '[^0-9]', '', 'g') AS BIGINT) END AS number, coalesce(try_cast(regexp_extract(replace(t, ',', ''), '([0-9]+)', 1) AS BIGINT), 0) AS price,
  format('{:,}', v) AS shown, greatest(5, least(30, n))::INT AS clamped, strftime(make_timestamp(CASE WHEN n % 5 = 0 THEN 0 ELSE 1700000000 + id * 1000 END * 1000000), '%Y-%m-%dT%H:%M:%S') AS at0, n % 5 = 0 AS blank,
  CASE id % 3 WHEN 0 THEN (floor((20 + n // 10)::DOUBLE * 10))::BIGINT::VARCHAR WHEN 1 THEN 'M' ELSE '270' END AS mm, CASE WHEN n % 2 = 0 THEN 'M' ELSE 'L' END AS label FROM p""".replace("strftime(", "CASE WHEN n % 5 <> 0 THEN strftime(", 1).replace("'%Y-%m-%dT%H:%M:%S') AS at0, n % 5 = 0 AS blank", "'%Y-%m-%dT%H:%M:%S') END AS at"))
def number_rules(spark: SparkSession, d: str) -> DataFrame:
    p, k, n = _part(spark, d)
    v = F.floor("p_retailprice").cast("bigint")
    t = F.when(k % 4 == 0, F.concat(_s(v), F.lit("원"))).when(k % 4 == 1, "free").when(k % 4 == 2, F.concat(F.lit("1,"), F.lpad(_s(n), 3, "0"), F.lit(".5"))).otherwise("0")
    size = F.when(k % 3 == 0, _s(20 + F.floor(n / 10))).when(k % 3 == 1, "M").otherwise(" 27 ")
    return p.select(
        k.alias("id"), money.digits(t).alias("number"), money.price_or_zero(t).alias("price"), text.thousands(v).alias("shown"), money.clamp(n, 5, 30).cast("int").alias("clamped"),
        times.epoch_iso(F.when(n % 5 == 0, 0).otherwise(1_700_000_000 + k * 1000)).alias("at"), sizes.to_mm(size).alias("mm"),
        sizes.label_size(F.when(n % 2 == 0, F.concat(F.lpad(_s(n), 3, "0"), F.lit("(M)"))).otherwise(" L ")).alias("label"))


@query("""WITH p AS (SELECT p_partkey AS id, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (p_partkey % 365) + INTERVAL 1 SECOND * (p_partkey % 86400) AS t, p_partkey % 9 AS c FROM part)
 SELECT id, CASE WHEN c IN (0, 1, 6, 7) THEN t WHEN c < 6 THEN date_trunc('day', t)::TIMESTAMP END AS at FROM p""")
def date_formats(spark: SparkSession, d: str) -> DataFrame:
    """Dates written in eight ways and one that is none."""
    p, k, _ = _part(spark, d)
    t = F.timestamp_seconds(F.lit(1_704_067_200) + (k % 365) * 86_400 + k % 86_400)
    fmt = lambda f: F.date_format(t, f)
    c, s = k % 9, F.unix_timestamp(t)
    raw = (F.when(c == 0, fmt("yyyy-MM-dd'T'HH:mm:ss")).when(c == 1, fmt("yyyy-MM-dd HH:mm:ss")).when(c == 2, fmt("yyyy/MM/dd")).when(c == 3, fmt("yyyy.MM.dd"))
           .when(c == 4, fmt("yyyy-MM-dd")).when(c == 5, fmt("yyyyMMdd")).when(c == 6, _s(s)).when(c == 7, _s(s * 1000)).otherwise("soon"))
    return p.select(k.alias("id"), times.parse_date(raw).cast("timestamp_ntz").alias("at"))


@query("""WITH p AS (SELECT p_partkey AS id, upper(p_brand || '-' || p_partkey) AS a, CASE p_partkey % 4 WHEN 0 THEN ' ' || lower(p_brand) || '  ' || p_partkey WHEN 1 THEN p_brand || p_partkey WHEN 2 THEN '' ELSE p_brand || '-' || (p_partkey + 1) END AS b FROM part)
 SELECT id, replace(a, '-', '') = regexp_replace(upper(trim(b)), '[\\s-]', '', 'g') AS same FROM p""".replace("\\\\s", "\\s"))
def models_equal(spark: SparkSession, d: str) -> DataFrame:
    p, k, _ = _part(spark, d)
    b = F.when(k % 4 == 0, F.concat(F.lit(" "), F.lower("p_brand"), F.lit("  "), _s(k))).when(k % 4 == 1, F.concat("p_brand", _s(k))).when(k % 4 == 2, "").otherwise(F.concat("p_brand", F.lit("-"), _s(k + 1)))
    return p.select(k.alias("id"), text.models_match(F.concat("p_brand", F.lit("-"), _s(k)), b).alias("same"))


#: The patterns of model codes in five sources' texts: source, priority, pattern, which match, hold without one.
SOURCE_RULES = [
    ("wconcept", 1, r"\[([A-Z0-9]+-[A-Z0-9]+)\]", "first", True),
    ("wconcept", 2, r"(?=[A-Z0-9]*\d)[A-Z0-9]{2,10}-\d{2,4}", "last", True),
    ("wconcept", 3, r"(\d{4}[A-Z]\d{3})(?:[\s-]+(\d{3}))?", "first", True),
    ("wconcept", 4, r"[A-Z]{1,3}\d[A-Z0-9]{3,9}", "last", True),
    ("eql", 1, r"(?=[A-Z0-9]*\d)[A-Z0-9]{2,8}-\d{2,4}", "last", False),
    ("eql", 2, r"[A-Z]{1,3}\d[A-Z0-9]{3,9}", "last", False),
    ("nbkorea", 1, r"[A-Z]{1,4}\d{3,5}[A-Z0-9]{0,4}", "first", False),
    ("kasina", 1, r"^[A-Z]{1,4}\d{3,5}-\d{2,4}$", "first", True),
    ("kasina", 2, r"[A-Z]{1,4}\d{3,5}[A-Z0-9]{0,4}", "first", True),
    ("asics", 1, r"(\d{4}[A-Z]\d{3}-\d{3})", "first", False),
]


@query(r"""WITH p AS (SELECT p_partkey AS id, p_partkey % 6 AS c, upper(p_name) || ' 신발' AS a, 'HQ' || (1000 + p_partkey % 9000) || '-' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS h,
  (1000 + p_partkey % 9000) || 'A' || (100 + p_partkey % 900) AS s, lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS e, 'M' || (1000 + p_partkey % 9000) || 'RXD' AS n, '[AB' || p_partkey || '-' || p_size || ']' AS b FROM part),
 t AS (SELECT id, unnest(['wconcept', 'eql', 'nbkorea', 'kasina', 'asics', 'other']) AS source, CASE c WHEN 0 THEN a || h || '와 ' || s || ' ' || e WHEN 1 THEN a || s || ' ' || e || '도' || n WHEN 2 THEN a || b || h WHEN 3 THEN h WHEN 4 THEN a || s || '-' || e ELSE a END AS t FROM p),
 x AS (SELECT id, source, CASE source WHEN 'wconcept' THEN coalesce(nullif(regexp_extract(t, '\[([A-Z0-9]+-[A-Z0-9]+)\]', 1), ''), regexp_extract_all(t, '\b([A-Z]{0,9}[0-9][A-Z0-9]{0,9}-[0-9]{2,4})\b', 1)[-1],
    nullif(concat_ws('-', nullif(regexp_extract(t, '\b([0-9]{4}[A-Z][0-9]{3})(?:[\s-]+([0-9]{3}))?\b', 1), ''), nullif(regexp_extract(t, '\b([0-9]{4}[A-Z][0-9]{3})(?:[\s-]+([0-9]{3}))?\b', 2), '')), ''), regexp_extract_all(t, '\b([A-Z]{1,3}[0-9][A-Z0-9]{3,9})\b', 1)[-1])
  WHEN 'eql' THEN coalesce(regexp_extract_all(t, '\b([A-Z]{0,7}[0-9][A-Z0-9]{0,7}-[0-9]{2,4})\b', 1)[-1], regexp_extract_all(t, '\b([A-Z]{1,3}[0-9][A-Z0-9]{3,9})\b', 1)[-1])
  WHEN 'nbkorea' THEN nullif(regexp_extract(t, '\b([A-Z]{1,4}[0-9]{3,5}[A-Z0-9]{0,4})\b', 1), '') WHEN 'kasina' THEN coalesce(nullif(regexp_extract(t, '^[A-Z]{1,4}[0-9]{3,5}-[0-9]{2,4}$', 0), ''), nullif(regexp_extract(t, '\b([A-Z]{1,4}[0-9]{3,5}[A-Z0-9]{0,4})\b', 1), ''))
  WHEN 'asics' THEN nullif(regexp_extract(t, '\b([0-9]{4}[A-Z][0-9]{3}-[0-9]{3})\b', 1), '') END AS model FROM t)
 SELECT id, source, model, CASE WHEN model IS NOT NULL THEN 'code' WHEN source IN ('wconcept', 'kasina') THEN 'hold' ELSE 'drop' END AS status FROM x""")
def source_patterns(spark: SparkSession, d: str) -> DataFrame:
    """One text in six sources: each source's own patterns read its code. Codes stand next to Hangul without a space."""
    p, k, n = _part(spark, d)
    three = F.lpad(_s(k % 1000), 3, "0")
    lead, style = F.concat(F.upper("p_name"), F.lit(" 신발")), F.concat(_s(1000 + k % 9000), F.lit("A"), _s(100 + k % 900))
    dashed, plain = F.concat(F.lit("HQ"), _s(1000 + k % 9000), F.lit("-"), three), F.concat(F.lit("M"), _s(1000 + k % 9000), F.lit("RXD"))
    t = (F.when(k % 6 == 0, F.concat(lead, dashed, F.lit("와 "), style, F.lit(" "), three)).when(k % 6 == 1, F.concat(lead, style, F.lit(" "), three, F.lit("도"), plain))
         .when(k % 6 == 2, F.concat(lead, F.lit("[AB"), _s(k), F.lit("-"), _s(n), F.lit("]"), dashed)).when(k % 6 == 3, dashed).when(k % 6 == 4, F.concat(lead, style, F.lit("-"), three)).otherwise(lead))
    sources = F.array(*[F.lit(s) for s in (*dict.fromkeys(r[0] for r in SOURCE_RULES), "other")])
    rows = p.select(k.alias("id"), F.explode(sources).alias("source"), t.alias("t"))
    return rules.codes_by_rule(rows, spark.createDataFrame(SOURCE_RULES, rules.RULES), "t").select("id", "source", "model", "status")


@query(with_sql("events", rest="""e AS (SELECT *, CASE k % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' ELSE 'cold' END AS p, k % 2 = 0 AS good, (k * 7) % 100 AS q FROM ev)
 SELECT event_id, CASE WHEN k % 5 = 0 THEN (user_id % 100)::INT ELSE least(k, (user_id % 100)::INT) END AS pulled, CASE WHEN good THEN greatest(1, CASE p WHEN 'hot' THEN 2 WHEN 'warm' THEN 6 ELSE 24 END // 2) ELSE CASE p WHEN 'hot' THEN 2 WHEN 'warm' THEN 6 ELSE 24 END END::INT AS ttl,
  CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 6 ELSE 24 END AS cached, CASE WHEN k > 0 AND abs(q - k)::DOUBLE / k >= 0.5::DOUBLE AND q > 0 AND k::DOUBLE / nullif(q, 0) >= 2.0::DOUBLE THEN 'both' WHEN k > 0 AND abs(q - k)::DOUBLE / k >= 0.5::DOUBLE THEN 'price' WHEN q > 0 AND k::DOUBLE / nullif(q, 0) >= 2.0::DOUBLE THEN 'volume' END AS spike,
  CASE WHEN k % 4 IN (0, 3) OR (k % 5 <> 0 AND k <= 50) THEN 'hold' WHEN k % 4 = 1 THEN 'drop' WHEN k % 3 = 0 THEN 'drop' ELSE 'pass' END AS stock,
  CASE WHEN k % 2 = 0 AND k > 0 THEN k * 300 >= 10000 AND k >= 5.0 ELSE q * 400 >= 20000 AND q >= 7.5 END AS floors_met FROM e"""))
def schedule_rules(spark: SparkSession, d: str) -> DataFrame:
    k, q = F.col("k"), (F.col("k") * 7) % 100
    rank = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    sizes_ = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("270")))
    state = F.when(k % 4 == 0, "UNKNOWN").when(k % 4 == 1, "OUT").when(k % 4 == 2, "IN")
    return events(spark, d).select(
        "event_id", tiers.pull_forward(F.when(k % 5 != 0, k), (F.col("user_id") % 100).cast("int")).alias("pulled"), tiers.scan_ttl(rank("hot", "warm", "cold"), k % 2 == 0).cast("int").alias("ttl"),
        tiers.cache_ttl(rank("profit", "match", "none")).alias("cached"), tiers.watcher_spike(k, q, q, k, 0.5).alias("spike"),
        tiers.stock_gate(state, sizes_, F.when(k % 5 == 0, 0).otherwise(k), F.lit(50)).alias("stock"),
        gates.estimated_floors(F.when(k % 2 == 0, k * 300).otherwise(0), q * 400, k, q).alias("floors_met"))


@query(with_sql("events", rest="SELECT event_id, k >= 20 AND user_id % 3 = 0 AS both, user_id % 3 = 0 AS one, true AS none, k % 4 = 0 OR user_id % 50 < 10 OR user_id % 5 = 2 AS free FROM ev"))
def optional_filters(spark: SparkSession, d: str) -> DataFrame:
    """A conjunction of those filters that are given; and leases that are free, expired or one's own."""
    k, u = F.col("k"), F.col("user_id")
    until = F.when(k % 4 != 0, u % 50)
    free = upsert.lease_free(until, F.when(u % 5 == 2, "me").otherwise("other"), F.lit(10), "me")
    return events(spark, d).select("event_id", gates.conjunction([k >= 20, u % 3 == 0]).alias("both"), gates.conjunction([None, u % 3 == 0]).alias("one"), gates.conjunction([None, None]).alias("none"), free.alias("free"))


@query("SELECT p_partkey AS id, p_name AS name, split_part(p_name, ' ', 1) AS phrase FROM part WHERE p_name LIKE '% bolt' UNION ALL SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN 'known' ELSE p_name END FROM part WHERE p_name NOT LIKE '% bolt'")
def search_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Brand words and parentheses go; a known phrase wins; else up to three words."""
    p, k, _ = _part(spark, d)
    raw = F.concat("p_name", F.when((k % 2 == 0) & ~F.col("p_name").like("% bolt"), " 알려진 (X)").otherwise(" (X)"))
    return p.select(k.alias("id"), F.col("p_name").alias("name"), text.search_phrase(raw, ("bolt",), {"알려진": "known"}).alias("phrase"))


@query("""SELECT p_partkey AS id, '<' || replace(p_name, ' ', ' & ') || '> "' || p_size || '"''' AS text, 'café ' || chr(65 + p_size % 26) || chr(945 + p_size % 17) || ' ' || replace(p_type, ' ', '…') AS every FROM part""")
def entities(spark: SparkSession, d: str) -> DataFrame:
    """References in texts made of the columns: the five common ones, and named, decimal and hexadecimal ones."""
    p, k, n = _part(spark, d)
    common = F.concat(F.lit("&lt;"), F.replace("p_name", F.lit(" "), F.lit(" &amp; ")), F.lit("&gt; &quot;"), _s(n), F.lit("&quot;&#39;"))
    every = F.concat(F.lit("caf&eacute; &#"), _s(65 + n % 26), F.lit(";&#x"), F.lower(F.hex(945 + n % 17)), F.lit("; "), F.replace("p_type", F.lit(" "), F.lit("&hellip;")))
    return p.select(k.alias("id"), text.unescape_html(common).alias("text"), text.unescape_all(every).alias("every"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'mens' WHEN 1 THEN 'womens' ELSE '' END AS gender, CASE WHEN p_size % 4 <> 0 THEN 'deep-' || lower(split_part(p_name, ' ', 1)) ELSE '' END AS colour FROM part""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    p, k, n = _part(spark, d)
    gender = F.when(k % 3 == 0, "Mens").when(k % 3 == 1, "womens").otherwise("menswear")
    last = F.when(n % 4 == 0, F.lit("plain")).otherwise(F.concat(F.lit("Deep-"), F.split("p_name", " ")[0], F.lit("-shoes-61."), _s(k)))
    url = F.concat(F.lit("https://shop/products/cloud/"), gender, F.lit("/"), last, F.when(n % 3 == 0, "?c=1").otherwise(""))
    return p.select(k.alias("id"), text.url_gender(url).alias("gender"), text.url_colour(url).alias("colour"))


#: Reasons that a decision may name.
REASONS = ("profit_floor", "roi_floor", "volume_floor", "no_match", "stale")


@query(with_sql("events", rest="SELECT event_id, CASE WHEN k % 7 < 5 THEN ['profit_floor', 'roi_floor', 'volume_floor', 'no_match', 'stale'][k % 7 + 1] END AS reason, k % 7 >= 5 AS rejected FROM ev"))
def decision_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Decisions whose reason is not in the closed vocabulary are set apart, with no reason."""
    k = F.col("k") % 7
    reason = F.get(F.array(*[F.lit(r) for r in REASONS], F.lit("other"), F.lit("")), k)
    return events(spark, d).select("event_id", F.when(reason.isin(*REASONS), reason).alias("reason"), (~reason.isin(*REASONS)).alias("rejected"))


@query(with_sql("events", rest="SELECT event_id, CASE WHEN k = 15 AND ts < (SELECT max(ts) FROM ev) - INTERVAL 10 DAY THEN NULL ELSE k END AS volume, CASE WHEN k = 15 AND ts < (SELECT max(ts) FROM ev) - INTERVAL 10 DAY THEN NULL ELSE ts END AS checked_at FROM ev"))
def stale_constant(spark: SparkSession, d: str) -> DataFrame:
    """A constant that a fault wrote before a cutoff is cleared, with the time it was checked."""
    e = events(spark, d)
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("asof"))))
    bad = (F.col("k") == 15) & (F.col("ts") < F.col("asof") - F.expr("INTERVAL 10 DAYS"))
    return e.select("event_id", F.when(~bad, F.col("k")).alias("volume"), F.when(~bad, F.col("ts")).alias("checked_at"))


@query("""SELECT p_partkey AS id, p_brand AS brand FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#11') AND p_name NOT LIKE '%ring%' AND p_size > 1""")
def skip_lists(spark: SparkSession, d: str) -> DataFrame:
    """Rows without skipped brands (a broadcast list of fixed size), launch items and items that can't be bought."""
    p, k, n = _part(spark, d)
    skipped = F.broadcast(spark.createDataFrame([("brand#1",), ("BRAND#2",), ("Brand#11",)], "b STRING").select(F.lower("b").alias("_b")))
    rows = p.withColumn("_b", F.lower("p_brand")).join(skipped, "_b", "left_anti")
    item = F.to_json(F.struct(F.when(F.col("p_name").contains("ring"), "COMING SOON").otherwise("ACTIVE").alias("status"), (n > 1).alias("buyable")))
    return rows.withColumn("item", item).where(gates.buyable(F.col("item"))).select(k.alias("id"), F.col("p_brand").alias("brand"))
