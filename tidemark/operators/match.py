"""Joins by model number: direct, by parts, with fallbacks, ranked, and by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def exploded_keys(df: DataFrame, model: str, key: str = "key") -> DataFrame:
    """A row per join key: the whole code (level 0) and the parts of a slashed one (level 1)."""
    parts = F.filter(F.split(F.col(model), "/"), lambda x: F.trim(x) != "")
    entries = F.concat(
        F.array(F.struct(T.model_key(F.col(model)).alias(key), F.lit(0).alias("level"))),
        F.when(F.size(parts) > 1, F.transform(parts, lambda p: F.struct(T.model_key(p).alias(key), F.lit(1).alias("level")))).otherwise(F.array()))
    return df.select("*", F.inline(entries)).where(F.col(key) != "")


def key_join(left: DataFrame, right: DataFrame, left_model: str, right_model: str, right_id: str) -> DataFrame:
    """Join on the stripped model number; of equal keys on the right the greatest id counts."""
    build = right.withColumn("key", T.model_key(F.col(right_model))).where("key <> ''")
    rest = [c for c in build.columns if c != "key"]
    build = build.groupBy("key").agg(F.max_by(F.struct(*rest), F.col(right_id)).alias("_r")).select("key", "_r.*")
    return left.withColumn("key", T.model_key(F.col(left_model))).where("key <> ''").join(build, "key")


def slash_join(left: DataFrame, right: DataFrame, left_model: str, right_model: str, right_id: str) -> DataFrame:
    """As key_join, but parts of slashed codes on the right match too; the whole code goes before a part."""
    build = exploded_keys(right, right_model)
    rest = [c for c in build.columns if c not in ("key", "level")]
    best = build.groupBy("key").agg(F.min_by(F.struct("level", *rest), F.struct("level", (-F.col(right_id)).alias("i"))).alias("_r")).select("key", "_r.*")
    return left.withColumn("key", T.model_key(F.col(left_model))).where("key <> ''").join(best, "key")


def fallback_join(left: DataFrame, right: DataFrame, variants: list[Column], right_key: str, left_id: list[str], right_id: str) -> DataFrame:
    """Try the key variants in order; the first that finds rows counts, of those the least right id."""
    rest = [c for c in right.columns if c != right_key]
    least = right.where(F.col(right_key).isNotNull()).groupBy(right_key).agg(F.min_by(F.struct(*rest), right_id).alias("_r")).select(right_key, "_r.*")  # a row per key
    tried = left.select("*", F.posexplode(F.array(*variants)).alias("variant", right_key))
    hit = tried.where(F.col(right_key).isNotNull()).join(least, right_key)
    cols = [F.col(c) for c in hit.columns if c not in left_id]
    return hit.groupBy(*left_id).agg(F.min_by(F.struct(*cols), "variant").alias("_h")).select(*left_id, "_h.*")


def ranked_match(left: DataFrame, right: DataFrame, left_id: str, left_model: str, left_name: str, right_id: str, right_model: str, right_name: str) -> DataFrame:
    """All candidates by normalised code, raw code and slash part, each once; then the best: not a collaboration first, a
    name that shares a long word next, then by strategy and id. A lone candidate is returned as it is. Rows on the left that
    ask for the same model and name are matched once."""
    r = right.select(F.col(right_id).alias("rid"), F.col(right_model).alias("rmodel"), F.col(right_name).alias("rname"))
    rows = left.select(F.col(left_id).alias("id"), F.col(left_model).alias("lmodel"), F.col(left_name).alias("lname"))
    lid = F.struct("lmodel", "lname")
    asked = rows.select("lmodel", "lname").distinct().select(lid.alias("lid"), "lmodel", "lname", T.normalize_model(F.col("lmodel")).alias("k"))
    exact = asked.join(r.withColumn("k", F.col("rmodel")), "k").withColumn("prio", F.lit(0))
    raw = asked.drop("k").join(r.withColumn("lmodel", F.col("rmodel")), "lmodel").withColumn("prio", F.lit(1))
    ends = F.split("rmodel", "/")
    sides = r.where(F.size(ends) > 1).select("*", F.explode(F.array_distinct(F.array(F.element_at(ends, 1), F.element_at(ends, -1)))).alias("k"))
    like = asked.where(F.length("k") >= 6).join(sides, "k").withColumn("prio", F.lit(2))
    cols = ["lid", "lname", "rid", "rname", "prio"]
    every = exact.select(cols).unionByName(raw.select(cols)).unionByName(like.select(cols))
    once = every.groupBy("lid", "rid").agg(F.min("prio").alias("prio"), F.first("lname").alias("lname"), F.first("rname").alias("rname"))
    shares = F.exists(F.split(F.lower("lname"), " "), lambda w: (F.length(w) > 3) & F.lower("rname").contains(w))
    w = Window.partitionBy("lid").orderBy(T.is_collab(F.col("rname")).cast("int"), F.coalesce(shares, F.lit(False)).cast("int").desc(), "prio", "rid")
    n = F.count(F.lit(1)).over(Window.partitionBy("lid"))
    best = once.withColumn("n", n).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("lid", "rid", "prio", "n")
    return rows.select("id", lid.alias("lid")).join(best, "lid").select(F.col("id").alias("lid"), "rid", "prio", "n")


def word_classes(rows: DataFrame, id_col: str, words: str, block: str) -> DataFrame:
    """Rows of one block with the same words are one class: its words, least id (cls) and number of rows (n). Pairs of
    classes say all that pairs of rows would, without growing with the square of the copies."""
    return rows.groupBy(block, F.array_sort(words).alias(words)).agg(F.min(id_col).alias("cls"), F.count(F.lit(1)).alias("n"))


def token_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_words: str, right_words: str, block: str, least: int = 2) -> DataFrame:
    """Pairs of one block (brand) that share at least `least` words. Words are ordered by how rare they are; of two rows
    that share `least` words, one of the first n - least + 1 words of either is shared, so only those words are joined,
    and frequent words seldom make pairs. The candidates' words are then counted."""
    both = left.select(block, F.explode(left_words).alias("word")).unionByName(right.select(block, F.explode(right_words).alias("word")))
    often = both.groupBy(block, "word").agg(F.count(F.lit(1)).alias("often"))

    def prefix(rows: DataFrame, id_col: str, words: str, name: str) -> DataFrame:
        ranked = rows.select(block, F.col(id_col).alias(name), F.explode(words).alias("word")).join(often, [block, "word"]).groupBy(block, name).agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("ws"))
        words_ = F.transform("ws", lambda x: x["word"])
        return ranked.select(block, name, words_.alias(f"{name}_ws"), F.explode(F.slice(words_, F.lit(1), F.greatest(F.size("ws") - (least - 1), F.lit(0)))).alias("word"))

    a, b = prefix(left, left_id, left_words, "lid"), prefix(right, right_id, right_words, "rid")
    shared = F.size(F.array_intersect("lid_ws", "rid_ws")).cast("bigint")
    return a.join(b, [block, "word"]).dropDuplicates([block, "lid", "rid"]).select("lid", "rid", shared.alias("shared")).where(F.col("shared") >= least)


def _dictionary(words: list[str]) -> Callable[[Column], Column]:
    """Whether a text holds one of the words or lies in one; false for null."""
    longest, every = max(map(len, words), default=0), "\0".join(words)

    @F.pandas_udf("boolean")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w in words:
            tree.add_word(w)
        tree.make_automaton()

        def one(t: str | None) -> bool:
            if t is None or not words:
                return False
            return next(tree.iter(t), None) is not None or (len(t) <= longest and t in every and ("\0" not in t or any(t in w for w in words)))

        for s in batches:
            yield s.map(one).astype(bool)

    return found


def substring_join(left: DataFrame, small: DataFrame, a: Column, b: Column, least: int = 4, few: int = 20_000) -> DataFrame:
    """Rows of `left` whose text contains one of `small`'s or the reverse, both at least `least` long. A text that holds
    another holds its first `least` letters, so both directions are equi-joins on runs of letters, verified afterwards;
    a dictionary of any size works. One whose size is checked to be small goes over each text as an automaton, in one pass
    and without a shuffle."""
    runs = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{least}}}))"), 1))
    words = small.select(b.alias("_w")).where(F.length("_w") >= least).distinct()
    known = [r[0] for r in words.limit(few + 1).collect()]
    if len(known) <= few:
        return left.where((F.length(a) >= least) & _dictionary(known)(a))
    texts = left.select(a.alias("_t")).where(F.length("_t") >= least).distinct()
    keyed = texts.withColumn("_k", F.sha2("_t", 256))
    inside = keyed.select("_k", F.explode(runs(F.col("_t"))).alias("_g")).join(words.select("_w", F.substring("_w", 1, least).alias("_g")), "_g")
    around = keyed.select("_k", F.substring("_t", 1, least).alias("_g")).join(words.select("_w", F.explode(runs(F.col("_w"))).alias("_g")), "_g")
    tried = inside.select("_k", "_w").unionByName(around.select("_k", "_w")).distinct()
    good = keyed.join(tried, "_k").where(F.col("_t").contains(F.col("_w")) | F.col("_w").contains(F.col("_t"))).select("_k").distinct()
    return left.withColumn("_k", F.sha2(a, 256)).join(good, "_k", "left_semi").drop("_k")


def prefix_join(left: DataFrame, right: DataFrame, key: str, n: int = 6, least: int = 4) -> DataFrame:
    """Rows of `left` that share the first n letters with a row of `right`; shorter keys by their own length."""
    cut = F.substring(key, 1, n)
    a = left.where(F.length(key) >= least).withColumn("_p", cut)
    lengths = list(range(least, n + 1))
    b = right.where(F.length(key) >= least).select(F.explode(F.array(*[F.substring(key, 1, i) for i in lengths])).alias("_p")).distinct()
    return a.join(b, "_p", "left_semi").drop("_p")


def colour_pick(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, left_tokens: str, right_tokens: str) -> DataFrame:
    """Of the rows under one key the one whose colour shares most words, then the one with fewer words, then the least
    id; at least one shared word is wanted unless there is only one row. Only distinct word lists of a key are paired, so
    the work grows with the colours of a key and not with the rows on either side."""
    lists = right.withColumn("_rt", F.array_sort(right_tokens))
    lists = lists.groupBy(key, "_rt").agg(F.min_by(F.struct(*[c for c in right.columns if c != key]), F.col(right_id)).alias("_best"), F.count(F.lit(1)).alias("_n"))
    hits = lists.groupBy(key).agg(F.sum("_n").alias("hits"))
    asked = left.withColumn("_lt", F.array_sort(left_tokens))
    pairs = asked.select(key, "_lt").distinct().join(lists, key).withColumn("shared", F.size(F.array_intersect("_lt", "_rt")))
    order = F.struct((-F.coalesce("shared", F.lit(-1))).alias("s"), F.size("_rt").alias("n"), F.col(f"_best.{right_id}").alias("i"))
    best = pairs.groupBy(key, "_lt").agg(F.min_by(F.struct("_best", "shared"), order).alias("_b")).join(hits, key).where("_b.shared >= 1 or hits = 1")
    best = best.select(F.col(key).alias("_k"), F.col("_lt").alias("_l"), "_b._best.*", "_b.shared", "hits")
    return asked.join(best, (F.col(key) == F.col("_k")) & F.col("_lt").eqNullSafe(F.col("_l"))).drop("_k", "_l", "_lt")


def hit_summary(left: DataFrame, right: DataFrame, key: str, right_id: str, emit_most: int = 2) -> DataFrame:
    """Pairs under one key with a status: single or several (up to emit_most rows on the right); a row on the left with more
    is ambiguous and comes once, with no right row. Keys are counted before anything is
    paired, so a row on the left meets at most emit_most rows."""
    hits = right.groupBy(key).agg(F.count(F.lit(1)).alias("hits"))
    few = left.join(right.join(hits.where(F.col("hits") <= emit_most), key), key)
    status = F.when(F.col("hits") == 1, "single").otherwise("several")
    many = left.join(hits.where(F.col("hits") > emit_most), key).withColumn("status", F.lit("ambiguous"))
    return few.withColumn("status", status).unionByName(many, allowMissingColumns=True)


def group_targets(df: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """Rows under a canonical key, in their order: the first value and all of them."""
    g = df.groupBy(key).agg(F.min_by(value, pos).alias("first_value"), F.array_sort(F.collect_list(F.struct(pos, value))).alias("_all"))
    return g.select(key, "first_value", F.array_join(F.transform("_all", lambda s: s[value].cast("string")), "|").alias("all_values"), F.size("_all").alias("n"))


def pick_catch(asked: DataFrame, catches: DataFrame, keys: list[str], page: str, at: str, tie: str) -> DataFrame:
    """The checkout page's row before others, the newest of those."""
    w = Window.partitionBy(*keys).orderBy(F.when(F.col(page) == "checkout", 0).otherwise(1), F.desc(at), F.desc(tie))
    best = catches.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return asked.join(best, keys, "left")
