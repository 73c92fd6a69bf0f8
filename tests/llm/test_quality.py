"""Quality rules against brute force: base statistics, robust estimates and verdicts, on whole texts."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, queries


def brute_stats(text):
    ws = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    grams = list(zip(ws, ws[1:], ws[2:]))
    often = {g for g, n in Counter(grams).items() if n > 1}
    hit = {k for i, g in enumerate(grams) if g in often for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit))


def test_base_statistics(documents, odd_docs):
    for docs in (documents, odd_docs):
        for r in quality.base_statistics(docs.select("doc_id", "text")).collect():
            want = brute_stats(r["text"])
            assert tuple(r[c] for c in quality.BASE) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def median(x):
    return np.sort(x)[math.ceil(len(x) / 2) - 1]


def brute_mcd(x, w):
    """Centre, scatter and scale of y = w * (x - medians), over different rows."""
    x, w = np.unique(np.column_stack((x, w)), axis=0)[:, :3], np.unique(np.column_stack((x, w)), axis=0)[:, 3]
    q = np.array([median(c) for c in x.T])
    y = (x - q) * w[:, None]
    best = None
    for d in ((y**2).sum(axis=1), np.abs(y).max(axis=1)):
        before = None
        for _ in range(20):
            half = y[d <= median(d)]
            m, c = half.mean(axis=0), np.cov(half.T, bias=True)
            low = np.zeros((3, 3))
            for i in range(3):
                for j in range(i + 1):
                    rest = c[i, j] - low[i, :j] @ low[j, :j]
                    low[i, j] = (math.sqrt(rest) if rest > quality.SINGULAR else 0.1) if i == j else rest / low[j, j]
            det = np.log(np.diag(low)).sum()
            d = (np.linalg.solve(low, (y - m).T) ** 2).sum(axis=0)
            if before is not None and abs(det - before) <= quality.SETTLED:
                break
            before = det
        if best is None or det < best[0]:
            best = (det, m, low, median(d) / quality.chi2_quantile(0.5))
    return q, *best[1:]


def brute_rules(rows, tail=1e-9, min_group=50):
    """(id, base_failed, distance, kept) of (id, text, lang, source) rows."""
    found = []
    for d, t, lang, source in rows:
        n, chars, *_, rep = brute_stats(t)
        marks = len(re.findall(r"[!-@\[-`{-~]", t or ""))
        short = sum(len(x) <= 3 for x in re.split("[\x20\x09-\x0d]+", t or "") if x)
        share = lambda a, b: math.asin(math.sqrt(min(1.0, a / max(1, b))))
        x = (math.log((chars + 1.0) / max(1, n)), share(marks, chars), share(short, n))
        found.append((d, n < 50 or 100 * rep > 50 * n, x, math.sqrt(n / (1 + n / quality.OWN_WORDS)), lang or "", source or ""))
    groups = defaultdict(list)
    for _, failed, x, w, lang, source in found:
        if not failed:
            for key in ((0, lang, source), (1, lang, ""), (2, "", "")):
                groups[key].append((*x, w))
    fits = {}
    for key, g in groups.items():
        if len(set(g)) >= min_group or key[0] == 2:
            g = np.array(g)
            fits[key] = brute_mcd(g[:, :3], g[:, 3])
    out = []
    for d, failed, x, w, lang, source in found:
        far = []
        for key in ((0, lang, source), (1, lang, "")):
            if key in fits:
                far.append(fits[key])
        far = far or [f for f in [fits.get((2, "", ""))] if f]
        dist = min([float((np.linalg.solve(low, w * (np.array(x) - q) - m) ** 2).sum() / scale) for q, m, low, scale in far], default=None)
        out.append((d, failed, dist, not failed and (dist is None or dist <= quality.chi2_quantile(tail))))
    return out


@pytest.mark.parametrize("min_group,few", [(50, quality.FEW_GROUPS), (15, 0)])
def test_verdicts_equal_brute_force(documents, min_group, few):
    """Groups of all three levels, broadcast and shuffled."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in documents.collect()]
    want = {d: (f, x, k) for d, f, x, k in brute_rules(rows, min_group=min_group)}
    out = quality.quality_rules(documents, min_group=min_group, few=few)
    for r in out.collect():
        failed, dist, kept = want[r["doc_id"]]
        assert r["base_failed"] == failed and r["distance"] == pytest.approx(dist, rel=1e-3, abs=1e-6) and r["kept"] == kept


def test_estimates_decide(documents):
    """One spherical scatter for all in place of the estimates changes verdicts."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in documents.collect()]
    mine = {d: k for d, _, _, k in brute_rules(rows)}
    stats = {d: brute_stats(t) for d, t, _, _ in rows}
    flat = {d: mine[d] for d in mine}
    for d, t, _, _ in rows:
        n, chars = stats[d][:2]
        if n >= 50:
            flat[d] = abs(math.log((chars + 1) / n) - math.log(6)) * math.sqrt(n) < math.sqrt(quality.chi2_quantile(1e-9))
    assert flat != mine


def test_chi_squared():
    assert quality.chi2_quantile(0.5, 3) == pytest.approx(2.36597, abs=1e-4)
    assert quality.chi2_quantile(0.05, 4) == pytest.approx(9.48773, abs=1e-4)
    assert quality.chi2_quantile(0.001, 1) == pytest.approx(10.8276, abs=1e-3)


def test_quality_keeps_clean_and_drops_junk(spark):
    out = queries.op9_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    r = out.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept")).collect()
    by = {x["quality"]: x for x in r}
    assert by[1]["kept"] >= 0.98 * by[1]["n"]
    assert by[0]["kept"] <= 0.1 * by[0]["n"]


def test_quality_odd(odd_docs, clashing, no_docs):
    out = quality.quality_rules(clashing)
    assert out.count() == odd_docs.count() and out.where("kept is null").count() == 0
    assert set(out.columns) == (set(clashing.columns) - {"text"}) | {*quality.BASE, "base_failed", "distance", "kept"}
    assert quality.quality_rules(no_docs).count() == 0
    kept = quality.keep_good(clashing)
    assert kept.columns == clashing.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in out.where("kept").collect())


def test_quality_is_native(documents):
    plan = quality.quality_rules(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mcd_resists_outliers_and_copies(spark):
    rng = np.random.default_rng(0)
    good = rng.normal(0, 0.05, (400, 3))
    bad = rng.normal(3, 0.05, (150, 3))
    copies = np.repeat([[5.0, 5.0, 5.0]], 2000, axis=0)
    rows = spark.createDataFrame([("g", *map(float, x), 1.0) for x in np.vstack((good, bad, copies))], "k STRING, x0 DOUBLE, x1 DOUBLE, x2 DOUBLE, w DOUBLE")
    r = quality.mcd(rows, ["k"]).first()
    assert all(abs(r[f"m{i}"] + r[f"q{i}"]) < 0.1 for i in range(3))


def test_one_point_groups_do_not_fail(spark):
    rows = spark.createDataFrame([("g", 1.0, 0.0, 0.0, float(i)) for i in range(60)] + [("h", 1.0, float(i % 2), 0.0, 2.0) for i in range(60)], "k STRING, x0 DOUBLE, x1 DOUBLE, x2 DOUBLE, w DOUBLE")
    got = {r["k"]: r for r in quality.mcd(rows, ["k"], min_group=1).collect()}
    assert all(math.isfinite(got[k][c]) and got[k]["scale"] > 0 for k in "gh" for c in ("l00", "l11", "l22"))
