"""The registered queries of this subpackage: thin, over whole tables; each derives its columns from its operator's rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe import encode
from .conversations import damage, digests, repair
from .html_text import extract_text
from .line_dedup import drop_frequent_lines
from .packing import pack
from .phrases import collocations
from .quality import BASE, quality_rules
from .simhash import near_duplicates
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .toxicity import fit, score
from .warc import read_records, write_archives


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    learnt = labels.where(~held).select("doc_id", F.col("toxic").alias("label"))
    out = score(docs, fit(docs, learnt))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_frequent_lines(documents(spark, sf_dir), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), texts=False)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, query_modulus=20)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=1024, end_id=0)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir), radius=4, size=4, seed=42)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select("doc_id", *BASE, "base_failed", "kept")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_revisit_bytes=0)
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(documents(spark, sf_dir), window=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir), least=30, max_n=4, top=2000, scale=2_000_000, percent=80)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    fixed = repair(damage(rows))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    ids = rows.select("conv_id").distinct()
    out = ids.join(fixed.summary.withColumnRenamed("conv_id", "c1"), same("conv_id", "c1"), "left").join(digests(fixed.turns).withColumnRenamed("conv_id", "c2"), same("conv_id", "c2"), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_line_dedup, op3_bpe, op4_ann, op5_packing, op6_substring_dedup, op7_simhash, op8_html, op9_quality, op10_warc, op11_suffix_dedup, op12_phrases, op13_conversations)}


ORACLE = {
    "op11_suffix_dedup": r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, md5_number(substr(h, (2 * i + 1)::BIGINT, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM b)),
often AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS fresh FROM win JOIN often USING (k)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hit) GROUP BY doc_id, run),
cut AS (SELECT doc_id, a, z, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM runs),
kept AS (SELECT doc_id, count(*) AS s, sum(z - a) AS g, substr(any_value(h), 1, 2 * min(a)) || string_agg(substr(h, 2 * z + 1, 2 * (coalesce(next, n) - z)), '' ORDER BY a) AS t FROM cut JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(g, 0)::BIGINT AS n_removed, coalesce(s, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256 FROM b LEFT JOIN kept USING (doc_id)""",
    "op12_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS ws FROM pieces),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
gram AS (SELECT lang, unnest(flatten(list_transform(range(1, len(ws) + 1), lambda i: list_transform(range(0, least(4, len(ws) - i + 1)), lambda k: ws[i:i + k])))) AS g FROM w),
f AS (SELECT lang, g, count(*) AS f FROM gram GROUP BY lang, g HAVING count(*) >= 30),
cand AS (SELECT lang, g, f AS a FROM f WHERE len(g) >= 2),
cuts AS (SELECT c.*, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f))::BIGINT AS score
         FROM (SELECT *, unnest(range(1, len(g))) AS k FROM cand) c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
best AS (SELECT lang, g, a, arg_min({'l': l, 'r': r, 'score': score}, score::HUGEINT * 10 + k) AS b FROM cuts GROUP BY lang, g, a),
inner_ AS (SELECT lang, unnest(flatten(list_transform(range(2, len(g)), lambda m: list_transform(range(1, len(g) - m + 2), lambda s: g[s:s + m - 1])))) AS g, a FROM cand WHERE len(g) > 2),
held AS (SELECT lang, g, max(a) AS m FROM inner_ GROUP BY lang, g),
ranked AS (SELECT best.lang, array_to_string(best.g, ' ') AS phrase, best.a, b.l, b.r, b.score,
                  row_number() OVER (PARTITION BY best.lang ORDER BY b.score DESC, best.a DESC, array_to_string(best.g, ' ')) AS rank
           FROM best LEFT JOIN held ON held.lang = best.lang AND held.g = best.g WHERE m IS NULL OR 100 * m < 80 * best.a)
SELECT ranked.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000""",
    "op6_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
first AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (k) WHERE f < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT words.doc_id, count(*) AS n, count(gone.p) AS g, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS t
         FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(g, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)""",
    "op10_warc": r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first,
      array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(h, (j // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (j % 4))) & 31)::INT + 1, 1)), '') AS b FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, b AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op2_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(p) AS l, generate_subscripts(p, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))),
frequent AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE f)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT f), '')) AS kept_sha256
FROM (SELECT lines.*, k IN (SELECT k FROM frequent) AS f FROM lines) GROUP BY doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
