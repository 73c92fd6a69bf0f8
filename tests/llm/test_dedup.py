"""Line, substring and near dedup against brute force, and their edges."""

import hashlib
import itertools

import numpy as np
import pytest
import xxhash

from tidemark.llm import queries, simhash
from tidemark.llm.components import components
from tidemark.llm.line_dedup import LineRuns, drop_frequent_lines, lines_of
from tidemark.llm.substring_dedup import LAST, Automaton, find_repeats, pieces, substring_dedup


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op2_line_dedup", "op6_substring_dedup"])
def test_query_equals_sql(spark, data, same_rows, name):
    same_rows(queries.queries()[name](spark, data), queries.ORACLE[name])


def brute_lines(rows, min_docs):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    held = {}
    for i, (d, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(held[key(x)]) < min_docs]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines_odd(odd_docs, clashing):
    want = brute_lines([(r["doc_id"], r["text"]) for r in odd_docs.collect()], 2)
    for docs in (odd_docs, clashing):
        got = [tuple(r) for r in drop_frequent_lines(docs, min_docs=2).select("doc_id", "n_lines", "n_dropped", "text").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_the_query_compacts(spark, documents, monkeypatch):
    """More batches than runs fit a level, so a registered query merges runs; merges and anti joins deal nothing anew."""
    merged = []
    kept = LineRuns._merged
    monkeypatch.setattr(LineRuns, "_merged", lambda self, runs: merged.append(len(runs)) or kept(self, runs))
    drop_frequent_lines(documents).count()
    assert merged == [3, 3, 2]
    runs = LineRuns(spark, 2, fan_out=9)
    for i in range(2):
        runs.add(lines_of(documents.where(f"doc_id % 2 = {i}")))
    joined = runs._merged(runs.levels[0])
    joined.collect()
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_lines_of_an_empty_table(no_docs):
    assert drop_frequent_lines(no_docs).count() == 0


def test_runs_compact_and_count(spark, documents):
    runs = LineRuns(spark, min_docs=3, fan_out=2)
    for i in range(5):
        runs.add(lines_of(documents.where(f"doc_id % 5 = {i}")))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    want = {tuple(r)[:2] for r in lines_of(documents).select("h1", "h2", "_id").distinct().groupBy("h1", "h2").count().where("count >= 3").collect()}
    assert {tuple(r)[:2] for r in runs.frequent().collect()} == want


def brute_windows(rows, w):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    last = 1 << 63
    for d, ws in split:
        for i in range(len(ws) - w + 1):
            k = tuple(ws[i : i + w])
            first[k] = min(first.get(k, last), last - 1 if d is None else d)
    out = []
    for d, ws in split:
        gone = [False] * len(ws)
        for i in range(len(ws) - w + 1):
            if first[tuple(ws[i : i + w])] < (last - 1 if d is None else d):
                gone[i : i + w] = [True] * w
        out.append((d, len(ws), sum(gone), b" ".join(x for x, g in zip(ws, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("window", [4, 7])
def test_substrings_of_few_words(spark, window):
    rng = np.random.default_rng(window)
    rows = [(int(i), " ".join(rng.choice(list("abc"), rng.integers(0, 40)))) for i in rng.permutation(120)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = [tuple(r) for r in substring_dedup(docs, window).select("doc_id", "n_words", "n_removed", "text").collect()]
    assert sorted(got) == sorted(brute_windows(rows, window))


def test_substrings_odd(odd_docs, clashing, no_docs):
    want = brute_windows([(r["doc_id"], r["text"]) for r in odd_docs.collect()], 50)
    got = [tuple(r) for r in substring_dedup(clashing).select("doc_id", "n_words", "n_removed", "text").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substring_dedup(no_docs).count() == 0


def test_pieces_hold_every_window():
    for n in (4, 5, 9, 10, 11, 57):
        got = pieces(n, 4, 10)
        assert max(b - a for a, b in got) <= 10 and got[-1][1] == n
        assert all(any(a <= i and i + 4 <= b for a, b in got) for i in range(n - 3))


def test_a_long_owner_is_dealt_over_shards(spark):
    """One long text with two copies, cut anew in the last; and many texts without an id, of which one repeats it."""
    long = [f"w{i * 7919 % 100003}" for i in range(3000)]
    rows = [(1, " ".join(long)), (2, " ".join(long)), (3, " ".join(["x", *long[500:1500], "y", *long[100:130]]))]
    rows += [(None, " ".join([f"u{i}", *(f"n{i}_{j}" for j in range(12))])) for i in range(10_000)] + [(None, " ".join(["z", *long[700:800]]))]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    want = {d: g for d, _, g, _ in brute_windows(rows[:3], 10)}
    ranges = find_repeats(docs, 10, shard_words=200, piece_words=100).collect()
    gone: dict = {}
    for r in ranges:
        gone.setdefault(r["doc_id"], set()).update(range(r["from"], r["until"]))
    assert {d: len(g) for d, g in gone.items()} == {2: want[2], 3: want[3], LAST: 100}
    assert len({r["t"] for r in ranges if r["doc_id"] == LAST}) == 1


def test_automaton_knows_owners():
    rng = np.random.default_rng(3)
    seqs = [([b"%d" % x for x in rng.integers(0, 3, rng.integers(5, 30))], int(o)) for o in rng.integers(0, 50, 12)]
    auto = Automaton()
    for ws, o in seqs:
        auto.add(ws, o)
    auto.finish()
    for ws in [s for s, _ in seqs] + [[b"%d" % x for x in rng.integers(0, 3, 40)] for _ in range(20)]:
        grams = [({tuple(s[j : j + 5]) for j in range(len(s) - 4)}, o) for s, o in seqs]
        want = [LAST] * min(4, len(ws)) + [min([o for g, o in grams if tuple(ws[i - 4 : i + 1]) in g], default=LAST) for i in range(4, len(ws))]
        assert auto.owners(ws, 5) == want


def brute_fingerprint(text, n=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in "".join(" " if c in "\t\n\x0b\f\r" else c for c in lower).split(" ") if w]
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, radius):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))]


def test_simhash_query(spark, data, texts):
    got = [tuple(r) for r in queries.op7_simhash(spark, data).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got) == sorted(brute_components(texts, 4))


def test_simhash_odd(odd_docs, clashing, no_docs):
    want = brute_components([(r["doc_id"], r["text"]) for r in odd_docs.collect()], 4)
    got = [(r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in simhash.near_duplicates(clashing).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_golay_keys_meet_within_two_bits():
    _, errors = simhash.golay_tables()
    counts = (errors >= 0).sum(axis=1)
    assert sorted(set(counts.tolist())) == [1, 6]
    words = errors[:, 0]  # one word of each coset; the code is linear
    mine = simhash.segment_keys(words)
    for n in (1, 2):
        for bits in itertools.combinations(range(23), n):
            other = simhash.segment_keys(words ^ sum(1 << b for b in bits))
            assert ((mine[:, :, None] == other[:, None, :]) & (mine[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_keys_find_all_pairs_within_five_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 6), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys = [[set() for _ in a] for _ in range(2)]
    for side, fps in enumerate((a, b)):
        for r, k in zip(*simhash.join_keys(fps)):
            keys[side][r].add(int(k))
    assert all(x & y for x, y in zip(*keys))


def test_forest_reaches_what_links_reach():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 1 << 10, 300, dtype=np.uint64))
    edges = simhash.forest(fps, 1)
    assert len(edges) == len(fps) - len({min(c) for c in _groups(fps)})


def _groups(fps):
    left, out = set(range(len(fps))), []
    while left:
        queue, got = [left.pop()], []
        while queue:
            i = queue.pop()
            got.append(i)
            near = {j for j in left if (int(fps[i]) ^ int(fps[j])).bit_count() <= 1}
            left -= near
            queue += near
        out.append(got)
    return out


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a BIGINT, b BIGINT")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == got[90] == 90 and got[249] == 200
    assert components(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0
