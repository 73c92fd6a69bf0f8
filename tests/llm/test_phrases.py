"""Collocations against counters over whole lists of words."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import phrases
from tidemark.llm.queries import op12_phrases

SCHEMA = "doc_id BIGINT, text STRING, lang STRING"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(4, len(w) - i) + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in cand.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    inside[p[s : s + m]] = max(inside[p[s : s + m]], a)
        rows = []
        for p, a in cand.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, _, left, right = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_whole_table(spark, data, documents):
    got = result(op12_phrases(spark, data))
    assert got == brute([(r["text"], r["lang"]) for r in documents.collect()])
    assert len(got) >= 50


def zipf(rng, docs, vocabulary, longest=400):
    words = [f"w{i}" if i % 5 else f"É{i}" for i in range(vocabulary)] + ["a\x01", "a", "a b".replace(" ", "\xa0")]
    return [" ".join(words[min(int(x) - 1, len(words) - 1)] + ("." if rng.random() < 0.1 else "") for x in rng.zipf(1.5, int(rng.integers(1, longest)))) for _ in range(docs)]


@pytest.mark.parametrize("bits", [4, 25])
def test_full_bitmaps_and_hot_words(spark, monkeypatch, bits):
    """With 16 slots nothing is pruned; a first word with most of the rows is dealt over many parts."""
    rng = np.random.default_rng(2)
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(zipf(rng, 300, 3000))]
    rows += [(1000 + i, " ".join(f"hot hot r{rng.integers(3000)} hot x{rng.integers(4)}" for _ in range(60)), "en") for i in range(60)]
    rows += [(2000 + i, t, lang) for i, (t, lang) in enumerate([(None, "en"), ("", None), (" \t. ;\x0b", "xx"), ("One ONE one. " * 4000, "und"), ("É é " * 40, ""), ("a\x01 b a b a\xa0b " * 50, "en")])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if bits == 25:
        hot = []
        run = phrases.F.concat
        monkeypatch.setattr(phrases.F, "concat", lambda *c: hot.append(c) or run(*c))
        assert result(phrases.collocations(df)) == brute([r[1:] for r in rows])
        assert hot, "the test must have hot words"
        return
    bitmap = type("B", (), {"value": b"\xff" * (1 << 23)})()
    got = spark.createDataFrame(df.selectExpr("coalesce(lang, 'und') lang", "text").mapInArrow(phrases._suffixes(bitmap, 4), "lang string, suffix string, n long").collect(), "lang string, suffix string, n long")
    every = got.sort("lang", "suffix", ascending=False).coalesce(1).selectExpr("lang", "false split", "suffix", "n").mapInArrow(phrases._stacked(1), "lang string, phrase string, n long")
    want = Counter()
    for t, lang in [r[1:] for r in rows]:
        for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if c.isascii() else c for c in t or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for i in range(len(w)):
                for k in range(1, min(4, len(w) - i) + 1):
                    want[(lang if lang is not None else "und", " ".join(w[i : i + k]))] += 1
    assert {(r["lang"], r["phrase"]): r["n"] for r in every.collect()} == want


def test_long_texts_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [". ".join(zipf(rng, 30, 200)) for _ in range(3)]
    rows = [(t, "en") for t in texts]
    batch = __import__("pyarrow").RecordBatch.from_pydict({"lang": ["en"] * 3, "text": texts})
    monkeypatch.setattr(phrases, "CHUNK", 50)
    parts = [t for _, ts in phrases._by_lang(iter([batch])) for t in ts]
    assert "".join(parts) == "".join(texts) and len(parts) > 20
    assert brute([(t, "en") for t in parts], 1) == brute(rows, 1)


@pytest.mark.parametrize("sums", [1 << 30, 20_000, 1])
def test_task_adds_up_its_suffixes(spark, monkeypatch, sums):
    """A task's row of a suffix stands for all of its text, unless its sums outgrow what it may hold."""
    rng = np.random.default_rng(6)
    texts = zipf(rng, 200, 40)
    batch = __import__("pyarrow").RecordBatch.from_pydict({"lang": [["en", "de"][i % 2] for i in range(200)], "text": texts})
    bitmap = type("B", (), {"value": b"\xff" * (1 << 23)})()
    rows = lambda: [tuple(r.values()) for rb in phrases._suffixes(bitmap, 3)(iter([batch])) for r in rb.to_pylist()]
    want = sorted(rows())
    monkeypatch.setattr(phrases, "CHUNK", 500)
    monkeypatch.setattr(phrases, "HELD", 1000)
    monkeypatch.setattr(phrases, "SUMS", sums, raising=False)
    got = rows()
    added = Counter()
    for lang, suffix, n in got:
        added[lang, suffix] += n
    assert sorted((*k, n) for k, n in added.items()) == want
    assert len(got) == len(want) if sums > 1 << 20 else len(got) >= len(want)
    assert sums > 1 or len(got) > 2 * len(want), "the test must write sums more than once"


def test_suffix_rows_do_not_follow_partitions(spark):
    """Rows are those of as many tasks as there are cores, not those of all partitions."""
    cores, made = spark.sparkContext.defaultParallelism, {}
    bitmap = type("B", (), {"value": b"\xff" * (1 << 23)})()
    for parts in (cores, 6 * cores):
        docs = spark.createDataFrame([("en", "a b c d e f g. h i j")] * (4 * parts), "lang string, text string").repartition(parts)
        rows = phrases.suffix_rows(docs, bitmap, 4, 40 * parts).collect()
        made[parts] = len(rows)
        assert sum(r["n"] for r in rows) == 40 * parts
    assert made[6 * cores] <= made[cores] == 10 * cores


def test_odd_rows(spark, odd_docs, clashing, no_docs):
    want = brute([(r["text"], r["lang"]) for r in odd_docs.collect()])
    assert result(phrases.collocations(odd_docs)) == want
    wide = clashing
    for c in ("suffix", "first", "split", "part", "phrase", "rank", "a", "k", "n", "words"):
        wide = wide.selectExpr("*", f"'x' as {c}")
    assert result(phrases.collocations(wide)) == want
    assert result(phrases.collocations(no_docs)) == []
    with pytest.raises(ValueError):
        phrases.collocations(no_docs, least=300)
