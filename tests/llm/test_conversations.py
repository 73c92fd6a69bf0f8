"""Conversation repair against a table of tuples that keeps the least (cost, edits) of every state."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidemark.llm import conversations as conv
from tidemark.llm.queries import op13_conversations

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
SPACES = " \t\n\x0b\x0c\r"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        s = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{s(c)}:{s(t)}".encode()) % 20
        role, text = s(role), s(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        if kind == 4:
            role = "user"
        out += [] if kind == 0 else [(c, t, role, text)] * (2 if kind == 3 else 1)
    return out


def one(rows):
    """The contract's columns of one conversation's (turn, role, text)."""
    h = lambda text: xxhash.xxh64(text.encode(), 42).intdigest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], h(r[2]) - (1 << 64 if h(r[2]) >> 63 else 0)))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(SPACES)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    best = {"": None}

    def step(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))

    states = ["", "s", "u", "a"]
    after = {s: (0, "", []) if s in ("", "a") else (10**9, "", []) for s in states}
    for i in range(len(rows), -1, -1):
        now = dict(after)
        if i < len(rows):
            fault, (_, role, text) = faults[i], rows[i]
            for s in states:
                found = [(after[s][0] + 4, "D" + after[s][1], after[s][2])]
                if fault not in ("blank", "duplicate"):
                    more = 3 if fault == "truncated" else 0
                    for edit, as_role, cost in [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                        to = step(s, as_role[:1])
                        if to is not None:
                            found.append((after[to][0] + cost + more, edit + after[to][1], [f"{as_role}:{text}", *after[to][2]]))
                now[s] = min(found, key=lambda x: x[:2])
        for _ in range(3):
            for s in states:
                role = "assistant" if s == "u" else "user"
                to = role[0]
                now[s] = min(now[s], (now[to][0] + 3, "I" + now[to][1], [f"{role}:", *now[to][2]]), key=lambda x: x[:2])
        after = now
    best = after[""]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


def brute(rows, damage=True):
    by = defaultdict(list)
    for c, *r in damaged(rows) if damage else rows:
        by[c].append(tuple(r))
    return {c: one(by[c]) for c in {r[0] for r in rows}}


def query(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in op13_conversations(spark, str(tmp_path)).collect()}


def made(seed, convs, longest):
    rng = np.random.default_rng(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "agent"]
    texts = ["Hi.", "Yes!", "no end", "", " \t", None, "Why? ", "É.", "a\nb.\n", "."]
    return [
        (c, None if rng.random() < 0.1 else int(rng.integers(0, n + 3)), roles[rng.choice(10, p=[0.1, 0.25, 0.25, 0.1, 0.1, 0.04, 0.04, 0.04, 0.04, 0.04])], texts[rng.integers(len(texts))] if rng.random() < 0.6 else f"text {rng.integers(9)}.")
        for c in range(convs) for n in [int(rng.integers(1, longest))] for _ in range(n)
    ]


def test_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in op13_conversations(spark, data).collect()}
    assert got == brute(rows)
    assert sum(x[5] for x in got.values()) > 0


def test_odd_conversations(spark, tmp_path):
    rows = made(3, 200, 14) + [(None, None, None, None), (None, 3, "user", "Hm."), (-5, 0, "system", "Be kind.")]
    rows += [(700 + i, 0, "user", "x") for i in range(60)] + [(900, i % 2, "user", "Same.") for i in range(50)]
    rows += [(901, 0, "system", "x" * 200_000 + "."), (901, 1, "user", "y" * 100_000), (902, None, "user", "a."), (902, None, "assistant", "b.")]
    got = query(spark, tmp_path, rows)
    want = brute(rows)
    assert got == want
    assert any(x[6] == "" and x[7] == hashlib.sha256(b"").hexdigest() for x in want.values())


@pytest.mark.parametrize("piece", [1, 3, 16])
def test_long_conversations_in_pieces(spark, monkeypatch, piece):
    """Pieces of a few rows, over many partitions, must give what one table over the whole conversation gives."""
    rows = [r for r in made(piece, 12, 90)] + [(50, i, "user" if i % 3 else "assistant", f"t{i % 40}" + "." * (i % 2)) for i in range(400)]
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    monkeypatch.setattr(conv, "PIECE", piece)
    run = conv._numbered

    def numbered(batches):
        conv.PIECE = piece  # the module is imported anew in a worker
        yield from run(batches)

    monkeypatch.setattr(conv, "_numbered", numbered)
    fixed = conv.repair(spark.createDataFrame(rows, SCHEMA).repartition(5))
    sha = {r["conv_id"]: r["sha256"] for r in conv.digests(fixed.turns).collect()}
    got = {r["conv_id"]: (*(r[c] for c in COLUMNS[:-1]), sha.get(r["conv_id"], hashlib.sha256(b"").hexdigest())) for r in fixed.summary.collect()}
    assert got == brute(rows, damage=False)


def test_tensors_equal_tuples():
    """Random pieces: the matrix of a piece applied to the end costs is the cost of the whole."""
    rng = np.random.default_rng(9)
    pieces = [bytes(int(x) for x in rng.integers(0, 16, rng.integers(1, 40))) for _ in range(300)]
    whole = conv.matrices(pieces)
    for cut in (1, 5):
        parts = [conv.matrices([p[:cut]]) [0] for p in pieces if len(p) > cut]
        rests = conv.matrices([p[cut:] for p in pieces if len(p) > cut])
        joined = np.array([(a[:, :, None] + b[None]).min(axis=1) for a, b in zip(parts, rests)])
        assert np.array_equal(np.minimum(joined, conv.FAR), np.minimum([m for m, p in zip(whole, pieces) if len(p) > cut], conv.FAR))
    edits, last = conv.audits(pieces, np.tile(conv.TAIL_COST, (len(pieces), 1)))
    cost = {"D": 4, "I": 3, "R": 3, "K": 0}
    for p, e, end, m in zip(pieces, edits, last, whole):
        turns = iter(p)
        total = 0
        for x in e[0]:
            total += cost[x]
            if x != "I":
                bits = next(turns)
                total += 3 if x != "D" and bits & conv.CUT else 0
                assert x == "D" or not bits & conv.MUST
        assert total + conv.TAIL_COST[end[0]] == (m[0] + conv.TAIL_COST).min()


def test_clashing_columns_and_no_rows(spark, tmp_path):
    rows = made(8, 20, 9)
    extra = "ck STRING, cn INT, piece STRING, pos STRING, bits STRING, mark STRING, h STRING, salt STRING, g1 STRING, _t STRING, kind STRING, audit STRING, part STRING"
    wide = [(*r, *[None] * len(extra.split(", "))) for r in rows]
    assert query(spark, tmp_path / "a", wide, f"{SCHEMA}, {extra}") == brute(rows)
    assert query(spark, tmp_path / "b", []) == {}
