"""Quality rules (native): word and line statistics of each text, a fixed floor, and robust multivariate outliers.

The outlier rule estimates location and scatter of a transformed statistic vector by the minimum covariance determinant,
for each (lang, source) and for each language: from two starts, concentration steps keep the half of the rows nearest by
Mahalanobis distance until no determinant changes; the start whose half has the smallest determinant wins. A text is
rejected if its distance exceeds a chi-squared quantile both in its group and in its language. Each step is one
aggregation of sums and products, so a hot group costs no more than its share of a scan.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, drop, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics of the outlier rule alone: ASCII digits and punctuation, and words of at most three code points.
MARKS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
OWN = ["n_marks", "n_short"]


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once: a column inside a lambda would be computed for each element."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{WS}+", -1), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text, the first included. Windows are sorted by
    hash with their places, so that equal ones are neighbours; n log n in the words of a text."""

    def of(w: Column) -> Column:
        n = F.size(w)
        windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))))
        return _bind(F.sort_array(windows), covered)

    def covered(s: Column) -> Column:
        n = F.size(s)
        places = F.filter(
            F.transform(s, lambda x, k: F.when(
                ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k + 1 < n) & (F.get(s, k + 1)["h"] == x["h"])), x["i"])),
            lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))

    return F.coalesce(F.when(F.size(words) >= 4, _bind(words, of)), F.lit(0)).cast("long")


def dup_lines(text: Column) -> Column:
    """\\n-split lines that have a word and equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
    return _bind(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the five base statistics, those of the outlier rule and base_failed; a null text counts as one without words."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    w = words_of(t)
    own = lambda a: F.struct(
        F.size(a).cast("long").alias("n"), repeat_words(a).alias("r"), F.size(F.filter(a, lambda x: F.length(x) <= 3)).cast("long").alias("s"))
    out = docs.withColumn("__w", _bind(w, own)).select(
        *[c for c in docs.columns if c not in (*BASE, *OWN)],
        F.col("__w.n").alias("n_words"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines(t).alias("n_dup_lines"),
        F.col("__w.r").alias("n_repeat_words"),
        (F.length(t) - F.length(F.translate(t, MARKS, ""))).cast("long").alias("n_marks"),
        F.col("__w.s").alias("n_short"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


P = 3
#: Words from which a text's own character, no longer chance, makes most of what its statistics differ by.
OWN_WORDS = 2000
#: A variance below the first is taken for none (a statistic that does not vary in the half); the second stands for it.
SINGULAR, RESOLUTION = 1e-8, 0.01
#: Log determinants that differ by less are taken for equal.
SETTLED = 1e-4
#: Up to so many groups (a few MB) their estimates are broadcast.
FEW_GROUPS = 50_000


def transformed() -> list[Column]:
    """The statistic vector: log mean word length, and the shares of marks and of short words by the arcsine of the root,
    which evens out their variance."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    share = lambda x: F.asin(F.sqrt(F.least(x, F.lit(1.0))))
    return [F.log((F.col("word_chars") + 1.0) / n), share(F.col("n_marks") / chars), share(F.col("n_short") / n)]


def weight() -> Column:
    """By which a difference from the centre is multiplied: statistics of n words vary by 1 / n + 1 / OWN_WORDS."""
    return F.sqrt(F.col("n_words") / (1 + F.col("n_words") / F.lit(float(OWN_WORDS))))


def chi2_tail(x: float, dof: int) -> float:
    """The chance that a chi-squared variable exceeds x."""
    k, out = (1, math.erfc(math.sqrt(x / 2))) if dof % 2 else (2, math.exp(-x / 2))
    while k < dof:
        out += math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1)) if x > 0 else 0.0
        k += 2
    return out


def chi2_quantile(tail: float, dof: int = P) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, dof) > tail else (low, mid)
    return high


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


def _estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means m0.. and the scatter's Cholesky factor l00.. of each group, by one aggregation."""
    sums = [F.avg(f"y{i}").alias(f"m{i}") for i in range(P)] + [F.covar_pop(f"y{i}", f"y{j}").alias(f"c{i}{j}") for i, j in _pairs()]
    out = rows.groupBy(*keys).agg(*sums)
    for i in range(P):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))
            # Only a singular direction gets a variance that is not its own.
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.when(rest > SINGULAR, rest).otherwise(RESOLUTION)) if i == j else rest / F.col(f"l{j}{j}"))
    det = reduce(lambda a, b: a + b, [F.log(F.col(f"l{i}{i}")) for i in range(P)])
    return out.select(*keys, det.alias("logdet"), *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in _pairs()])


def _distance(y=lambda i: F.col(f"y{i}"), e=F.col) -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i in range(P):
        rest = reduce(lambda a, k: a - e(f"l{i}{k}") * z[k], range(i), y(i) - e(f"m{i}"))
        z.append(rest / e(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, [x * x for x in z])


def _median(x: str | Column) -> Column:
    """Exact up to 10,000 rows, by rank within 1/10,000 of them beyond."""
    return F.percentile_approx(x, 0.5, 10_000)


def mcd(stats: DataFrame, keys: list[str], min_group: int = 50, always: Column | None = None, max_steps: int = 20, few: int = FEW_GROUPS) -> DataFrame:
    """Per group of at least min_group different rows (or those where `always` holds): medians q0.., location m0.. and
    scatter factor l00.. of y = w * (x - q), and `scale`, which makes the median distance that of the chi-squared law.
    stats has the keys, x0.. and w. Equal rows count once, so a text with many copies is no centre of its own."""
    xs = [f"x{i}" for i in range(P)]
    rows = table(stats.select(*keys, *xs, "w").distinct(), "mcd-rows")
    enough = F.col("size") >= min_group if always is None else (F.col("size") >= min_group) | always
    med = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), *[_median(x).alias(f"q{i}") for i, x in enumerate(xs)])
    med = table(med.where(enough).drop("size"), "mcd-medians")
    near = F.broadcast if med.count() <= few else lambda df: df
    moved = [(F.col("w") * (F.col(f"x{i}") - F.col(f"q{i}"))).alias(f"y{i}") for i in range(P)]
    ys = table(rows.join(near(med), keys).select(*keys, *moved), "mcd-rows")
    drop(rows)
    # Two starts: rows near the medians by the sum of squares, and by the largest coordinate.
    y = [F.col(f"y{i}") for i in range(P)]
    starts = F.array(
        F.struct(F.lit(0).alias("start"), reduce(lambda a, b: a + b, [v * v for v in y]).alias("d")),
        F.struct(F.lit(1).alias("start"), F.greatest(*[F.abs(v) for v in y]).alias("d")),
    )
    by = [*keys, "start"]
    started, last, done = ys.select("*", F.inline(starts)), None, []
    for step in range(max_steps):
        cut = started.groupBy(*by).agg(_median("d").alias("cut"))
        half = started.join(near(cut), by).where(F.col("d") <= F.col("cut"))
        now = _estimates(half, by)
        if last is None:
            now = now.withColumn("open", F.lit(True))
        else:
            old = last.select(*by, F.col("logdet").alias("before"))
            now = now.join(near(old), by).withColumn("open", F.abs(F.col("logdet") - F.col("before")) > SETTLED).drop("before")
        now = table(now, "mcd-step")
        done.append(now.where("not open"))
        last = now.where("open")
        if step and not last.count():
            break
        started = ys.join(near(last), keys).select(*by, *[f"y{i}" for i in range(P)], _distance().alias("d"))
    else:
        done.append(last)
    best = reduce(DataFrame.unionByName, done)
    chosen = best.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in best.columns if c not in (*keys, "open")]), F.struct("logdet", "start")).alias("e")).select(*keys, "e.*")
    chosen = table(chosen.drop("logdet", "start"), "mcd")
    scaled = ys.join(near(chosen), keys).groupBy(*keys).agg((_median(_distance()) / chi2_quantile(0.5)).alias("scale"))
    # A group of which over half lies at one point has no scale of its own.
    return chosen.join(near(med), keys).join(near(scaled), keys).withColumn("scale", F.when(F.col("scale") > SINGULAR, F.col("scale")).otherwise(1.0))


def quality_rules(
    docs: DataFrame, tail: float = 1e-9, min_group: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", few: int = FEW_GROUPS
) -> DataFrame:
    """Input columns but the text, plus the base statistics, base_failed, distance (squared, robust) and kept.

    kept is false if base_failed, or if the distance exceeds the chi-squared quantile that a share `tail` of a normal
    law exceeds. Estimates come from rows that pass the base rules. The distance is the lesser of those to the (lang,
    source) group and to the language, each if it has min_group different such rows; to all rows if neither has.
    Null lang and source are groups of their own, named by the empty text. An empty table gives an empty result.
    """
    return _judged(docs, [c for c in docs.columns if c != text_col], tail, min_group, lang_col, source_col, text_col, few)


def _judged(docs: DataFrame, carried: list[str], tail: float, min_group: int, lang_col: str, source_col: str, text_col: str, few: int) -> DataFrame:
    # What the caller's rows hold travels in one column, so no name of theirs meets one of ours.
    other = [F.col(c) for c in carried]
    slim = docs.select(
        (F.struct(*other) if other else F.struct(F.lit(None).alias("none"))).alias("__row"), F.col(text_col).alias("text"),
        F.coalesce(F.col(lang_col), F.lit("")).alias("_lang"), F.coalesce(F.col(source_col), F.lit("")).alias("_source"))
    judged = judge(table(base_statistics(slim).drop("text"), "quality-stats"), tail, min_group, few)
    own = [*BASE, "base_failed", "distance", "kept"]
    return judged.select(*[F.col("__row")[c].alias(c) for c in carried if c not in own or c == text_col], *[c for c in own if c != text_col])


def judge(stats: DataFrame, tail: float = 1e-9, min_group: int = 50, few: int = FEW_GROUPS) -> DataFrame:
    """The verdict over a table of base statistics with _lang and _source."""
    xs = [f"x{i}" for i in range(P)]
    rows = stats.select("*", *[x.alias(n) for n, x in zip(xs, transformed())], weight().alias("w"))
    # Each row counts at three levels: its (lang, source), its language, all.
    levels = rows.where(~F.col("base_failed")).select(*xs, "w", F.inline(F.array(*[
        F.struct(F.lit(k).alias("level"), lang.alias("g_lang"), source.alias("g_source"))
        for k, lang, source in ((0, F.col("_lang"), F.col("_source")), (1, F.col("_lang"), F.lit("")), (2, F.lit(""), F.lit("")))])))
    found = table(mcd(levels, ["level", "g_lang", "g_source"], min_group, F.col("level") == 2, few=few), "mcd-groups")
    values = [c for c in found.columns if c not in ("level", "g_lang", "g_source")]
    out = rows
    for k, on in ((0, ["_lang", "_source"]), (1, ["_lang"]), (2, [])):
        level = found.where(F.col("level") == k).select(*[F.col(f"g{c}").alias(c) for c in on], F.struct(*values).alias(f"e{k}"))
        # The last level is one row; the others as many as languages, and as (lang, source) pairs, which are counted.
        out = out.join(F.broadcast(level) if not on or level.count() <= few else level, on or F.lit(True), "left")

    def to(k: int) -> Column:
        e = lambda name: F.col(f"e{k}")[name]
        return _distance(lambda i: F.col("w") * (F.col(f"x{i}") - e(f"q{i}")), e) / e("scale")

    judged = out.withColumn("distance", F.coalesce(F.least(to(0), to(1)), to(2)))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_quantile(tail))
    return judged.withColumn("kept", kept).drop(*xs, "w", "e0", "e1", "e2", "_lang", "_source", *OWN)


def keep_good(docs: DataFrame, tail: float = 1e-9, min_group: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", few: int = FEW_GROUPS) -> DataFrame:
    """The rows that quality_rules keeps, columns unchanged. Rows carry their text through the verdict, so repeated rows
    and null ids are judged one by one and nothing is joined by id."""
    name = "__kept_row"
    while name in docs.columns:
        name += "_"
    boxed = docs.select(F.struct(*docs.columns).alias(name), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return _judged(boxed, [name], tail, min_group, "lang", "source", "text", few).where("kept").select(f"{name}.*")
