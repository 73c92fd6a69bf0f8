"""Near-dedup by similarity against brute-force Jaccard."""

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import similar
from tidemark.llm.similar import keep_one_similar

SCHEMA = "doc_id BIGINT, text STRING"


def brute(rows, least=0.8, size=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            n = len(a & b)
            if (not a and not b) or (n and n >= least * (len(a) + len(b) - n) - 1e-9):
                root[of(i)] = of(j)
    least_of = {}
    for i, (d, _) in enumerate(rows):
        k = of(i)
        least_of[k] = min(least_of.get(k, d), d)
    return sorted(least_of.values())


def edited(base, changes, rng):
    out = list(base)
    for at in rng.choice(len(out), changes, replace=False):
        out[at] = f"new{rng.integers(1 << 40)}"
    return out


def test_copies_between_070_and_1(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(60):
        base = [f"w{rng.integers(20_000)}" for _ in range(int(rng.integers(8, 400)))]
        for c in range(4):
            rows.append((len(rows), " ".join(edited(base, int(len(base) * rng.choice([0, 0.01, 0.02, 0.03])), rng))))
        rows.append((len(rows), " ".join(base[: int(len(base) * 0.85)])))
    want = brute(rows)
    got = sorted(r["doc_id"] for r in keep_one_similar(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == want
    assert len(rows) // 5 < len(want) < len(rows)


@pytest.mark.parametrize("block", [2, 4, 500])
def test_groups_over_several_blocks(spark, monkeypatch, block):
    """Families that candidates hold together and links only in part: large, small and single components in one group."""
    rng = np.random.default_rng(block)
    rows = []
    for _ in range(4):
        base = [f"w{rng.integers(50_000)}" for _ in range(260)]
        for _ in range(28):
            rows.append((len(rows), " ".join(edited(base, int(rng.integers(0, 9)), rng))))
        far = edited(base, 7, rng)
        rows += [(len(rows) + k, " ".join(edited(far, 3 * k, rng))) for k in range(6)]
    monkeypatch.setattr(similar, "BLOCK_NODES", block)
    want = brute(rows)
    assert sorted(r["doc_id"] for r in keep_one_similar(spark.createDataFrame(rows, SCHEMA)).collect()) == want
    assert 4 < len(want) < len(rows) // 2


def test_chain_of_copies(spark):
    """Each is similar to the next, the ends are not: one group."""
    base = [f"w{i}" for i in range(300)]
    rows = [(100 - k, " ".join(base[10 * k : 10 * k + 200])) for k in range(10)]
    assert brute(rows) == [91]
    assert [r["doc_id"] for r in keep_one_similar(spark.createDataFrame(rows, SCHEMA)).collect()] == [91]


def test_odd_rows(spark, odd_docs, clashing, no_docs):
    got = keep_one_similar(clashing)
    assert got.columns == clashing.columns
    assert sorted(((r["doc_id"], (r["text"] or "")[:10]) for r in got.collect()), key=repr) == sorted(
        [(r["doc_id"], (r["text"] or "")[:10]) for r in keep_one_similar(odd_docs).collect()], key=repr)
    assert {(r["doc_id"], r["text"]) for r in got.collect()} >= {(8, "other text"), (8, "One line\nelse"), (None, "One line")}
    assert keep_one_similar(no_docs).count() == 0


def test_stage(spark, data, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, documents, data).collect()) == brute(rows)
