"""Suffix-array dedup against sets of windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import suffix_dedup as sd
from tidemark.llm.queries import op11_suffix_dedup

SCHEMA = "doc_id BIGINT, text STRING"
COLUMNS = ["n_bytes", "n_removed", "n_spans", "sha"]


def brute(texts, window=200):
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + window] for b in bodies for i in range(len(b) - window + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()), key=repr)


def test_whole_table(spark, data, texts):
    got = {r["doc_id"]: tuple(r[c] for c in ["n_bytes", "n_removed", "n_spans", "kept_sha256"]) for r in op11_suffix_dedup(spark, data).collect()}
    assert got == dict(zip((d for d, _ in texts), brute([t for _, t in texts])))
    assert sum(x[1] for x in got.values()) > 10_000


def pieces(seed, n, letters=3, longest=400):
    rng = np.random.default_rng(seed)
    out = [bytes(rng.integers(0, letters, rng.integers(20, longest), np.uint8)) for _ in range(n)]
    for _ in range(n):
        a, b = out[rng.integers(n)], out[rng.integers(n)]
        at = int(rng.integers(len(a)))
        out.append(b[: int(rng.integers(len(b)))] + a[at:] + bytes([255, 0][: int(rng.integers(3))]))
    return [p for p in out if len(p) >= 20] + [b"\0" * 300, b"ab" * 100, b"ab" * 90]


@pytest.mark.parametrize("window", [8, 20])
def test_shards_and_merges(window):
    """Suffix arrays in sorted order, prefixes as compared, and the same answer whatever the cut into shards."""
    ps = pieces(window, 60)
    one = sd.Shard(ps, window)
    place = [b"".join(ps)[i : i + one.left[i]][:window] for i in range(len(one.left))]
    assert [place[i] for i in one.windows] == sorted(p for p in place if len(p) >= window)
    assert one.twin.tolist() == [False] + [place[a] == place[b] for a, b in zip(one.windows, one.windows[1:])]
    times = np.ones(len(ps), np.int64)
    times[3] = 2
    want = one.ranges(times)
    count = Counter(p[i : i + window] for p in ps for i in range(len(p) - window + 1))
    for k, (p, r) in enumerate(zip(ps, want)):
        flags = {i for x in r for i in range(x["a"], x["b"])}
        assert flags == {i for i in range(len(p) - window + 1) if k == 3 or count[p[i : i + window]] > 1}
    for parts in (2, 5):
        cut = np.array_split(np.arange(len(ps)), parts)
        shards = [sd.Shard([ps[i] for i in c], window) for c in cut]
        for i, a in enumerate(shards):
            for b in shards[i + 1 :]:
                a.merge(b)
        assert [r for s, c in zip(shards, cut) for r in s.ranges(times[c])] == want


@pytest.mark.parametrize("gram", sd.gram_sizes(200))
def test_segments_cover_each_window_once(gram, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 1000)
    rng = np.random.default_rng(gram)
    text = bytes(rng.integers(0, 4, 3000, np.uint8)) + b"x" * 2500 + b"ab" * 700
    start, size, key, several = sd.segments(text, 200, gram)
    assert start[0] == 0 and (start[1:] == start[:-1] + size[:-1]).all() and start[-1] + size[-1] == len(text) - 199
    assert size.max() <= sd.SEGMENT
    keys = np.repeat(key, size)
    for a, n, maybe in zip(start, size, several):
        own = [text[i : i + 200] for i in range(a, a + n)]
        assert maybe or len(set(own)) == n
    assert several.any() and not several.all()
    by = {}
    for i in range(len(text) - 199):
        assert by.setdefault(text[i : i + 200], keys[i]) == keys[i]
    assert len(sd.segments(text[:199], 200, gram)[0]) == 0 and len(sd.segments(b"", 200, gram)[0]) == 0


def made(seed):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(5000)}"
    line = " ".join(word() for _ in range(14))
    texts = [" ".join(word() for _ in range(int(rng.integers(1, 200)))) for _ in range(40)]
    texts += [" ".join([word() for _ in range(30)] + [line] + [word() for _ in range(30)]) for _ in range(60)]
    near = texts[0] * 3
    texts += [near[: int(k)] + word() + near[int(k) :] for k in rng.integers(0, len(near), 30)]
    return texts + [texts[5]] * 7 + ["é日本" * 300, "é日本" * 70, "x" * 5000, "x" * 199, "x" * 200, "", None, "\0" * 700, "abcabd" * 400]


@pytest.mark.parametrize("small", [False, True])
def test_made_texts(spark, monkeypatch, small):
    """With tiny shards and groups, common keys are cut over arrays and keyed anew, level by level."""
    levels = []
    if small:
        monkeypatch.setattr(sd, "GROUP_BYTES", 2_500)
        monkeypatch.setattr(sd, "SHARD_BYTES", 1_000)
        run = sd.repeated_windows
        monkeypatch.setattr(sd, "repeated_windows", lambda texts, window, level=0: levels.append(level) or run(texts, window, level))
    texts = made(4)
    rows = list(enumerate(texts))
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute(texts))), key=repr)
    assert result(sd.suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4))) == want
    assert not small or max(levels) >= 1


def test_spans_and_other_windows(spark):
    texts = made(6)
    out = sd.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), SCHEMA), window=37).collect()
    want = brute(texts, 37)
    for r in out:
        body = (texts[r["doc_id"]] or "").encode()
        rest, at = b"", 0
        for a, b in r["spans"]:
            assert at <= a < b and (a > at or at == 0)
            rest, at = rest + body[at:a], b
        assert rest + body[at:] == r["kept"]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) == want[r["doc_id"]]
    with pytest.raises(ValueError):
        sd.suffix_dedup(spark.createDataFrame([], SCHEMA), window=7)


def test_odd_rows(spark, odd_docs, clashing, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows]))), key=repr)
    assert result(sd.suffix_dedup(odd_docs)) == want
    wide = clashing
    for c in ("r1", "r2", "w", "h", "d", "row", "spans", "kept", "n", "found", "need", "start", "ranges"):
        wide = wide.withColumn(c, __import__("pyspark").sql.functions.lit("x"))
    got = sd.suffix_dedup(wide)
    assert result(got) == want and set(wide.columns) <= set(got.columns)
    assert sd.suffix_dedup(no_docs).count() == 0
