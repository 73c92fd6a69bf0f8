"""Conversation structure repair: cheapest edits that turn a conversation's roles into `(s?(ua)+)?`.

Rows are sorted over range partitions, so a conversation of any length is spread over as many as it needs, and cut into
pieces of at most `PIECE` rows. A piece is one row from then on: a byte per turn. Pieces are bucketed by length and solved
time-major, all pieces of a bucket at once: cost tensors go backward turn by turn and are stored, then the edits are traced
forward, again all at once. What a piece costs from each state to each is a 4 x 4 matrix, so conversations of several pieces
are put together by a fold over those matrices, which gives each piece the costs behind it, and by a second one over the
states that the traces end in.

States: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn. 0 and 3 may end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, lookup, table
from .line_dedup import STRIPPED

#: Most rows of a piece, and of a bucket's tensor.
PIECE, BUCKET = 4096, 1 << 18
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 40
#: State that an inserted turn leads to; user and assistant turns lead to the same.
THEN = np.array([2, 2, 3, 2])
#: What may still have to be inserted at the end, from each state, and its cost.
TAIL, TAIL_COST = ("", "II", "I", ""), np.array([0, 2 * INSERT, INSERT, 0], np.int64)
#: Bits of a turn: its role's initial (0 other, 1 s, 2 u, 3 a), whether it must go, whether it is truncated.
ROLE, MUST, CUT = 3, 4, 8
LEGAL = np.zeros((4, 4), bool)
LEGAL[1, 2] = LEGAL[2, 3] = LEGAL[3, 2] = True
#: Where a kept turn of each role leads from each state; -1: not allowed.
KEPT = np.array([[-1, -1, -1, -1], [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1]])


class Repaired(NamedTuple):
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row per conversation that has rows.
    summary: DataFrame
    #: conv_id, part and pos (their order in it), edit (I, K or R), role, text: the repaired turns.
    turns: DataFrame


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by the CRC-32 of `conv_id:turn` modulo 20 (a null is one space there, and in
    role and text): 0 drops a row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 makes its role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    out = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_t")).drop("_t")


# --- tensors --------------------------------------------------------------------------------------------------------


def backward(turns: np.ndarray, length: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs (time + 1, piece, end, state) from before each turn on. turns: (time, piece) bits; end: (piece, end, state)."""
    costs = np.empty((len(turns) + 1, *end.shape), np.int64)
    costs[-1] = end
    for t in range(len(turns) - 1, -1, -1):
        role, must, cut = (turns[t] & ROLE)[:, None], (turns[t] & MUST).astype(bool)[:, None], (turns[t] & CUT).astype(bool)[:, None]
        stay = np.where(must, FAR, np.where(cut, TRUNCATED, 0))
        after = costs[t + 1]
        to_user, to_assistant, to_system = stay + after[..., 2], stay + after[..., 3], stay + after[..., 1]
        user = to_user + np.where(role == 2, KEEP, REROLE)
        assistant = to_assistant + np.where(role == 3, KEEP, REROLE)
        now = after + DELETE
        for s in (0, 1, 3):
            now[..., s] = np.minimum(now[..., s], user)
        now[..., 0] = np.where(role == 1, np.minimum(now[..., 0], to_system + KEEP), now[..., 0])
        now[..., 2] = np.minimum(now[..., 2], assistant)
        two = np.minimum(now[..., 2], now[..., 3] + INSERT)
        now[..., 3] = np.minimum(now[..., 3], now[..., 2] + INSERT)
        now[..., 2] = two
        for s in (0, 1):
            now[..., s] = np.minimum(now[..., s], two + INSERT)
        costs[t] = np.where((t < length)[:, None, None], now, after)
    return costs


def trace(turns: np.ndarray, length: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters (time, 3, piece, start) of the ASCII-least cheapest edits from each start state, 0 where there is none, and
    the states (piece, start) they end in. costs as backward() gives them for one end."""
    n = turns.shape[1]
    every, state = np.arange(n)[:, None], np.tile(np.arange(4), (n, 1))
    letters = np.zeros((len(turns), 3, n, 4), np.uint8)
    for t in range(len(turns)):
        role, must = (turns[t] & ROLE)[:, None], (turns[t] & MUST).astype(bool)[:, None]
        stay = np.where(must, FAR, np.where((turns[t] & CUT).astype(bool)[:, None], TRUNCATED, 0))
        here, after = costs[t][:, 0], costs[t + 1][:, 0]
        open_ = np.tile((t < length)[:, None], (1, 4))
        for slot in range(3):
            cost = here[every, state]
            kept = KEPT[role, state]
            drop = open_ & (after[every, state] + DELETE == cost)
            insert = open_ & ~drop & (here[every, THEN[state]] + INSERT == cost)
            keep = open_ & ~drop & ~insert & (kept >= 0) & (stay + KEEP + after[every, kept] == cost)
            rerole = open_ & ~drop & ~insert & ~keep
            letters[t, slot] = drop * ord("D") + insert * ord("I") + keep * ord("K") + rerole * ord("R")
            state = np.where(keep, kept, np.where(insert | rerole, THEN[state], state))
            open_ = insert
            if not open_.any():
                break
    return letters, state


def _buckets(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of pieces of about equal length, few enough for one tensor."""
    order = np.argsort(lengths, kind="stable")
    classes = np.ceil(np.log2(np.maximum(lengths[order], 1))).astype(int)
    for c in np.unique(classes):
        of = order[classes == c]
        step = max(1, BUCKET >> c)
        for at in range(0, len(of), step):
            yield of[at : at + step]


def _tensor(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(p) for p in pieces])
    out = np.zeros((len(pieces), max(int(length.max()), 1)), np.uint8)
    for row, p in zip(out, pieces):
        row[: len(p)] = np.frombuffer(p, np.uint8)
    return np.ascontiguousarray(out.T), length


def matrices(pieces: list[bytes]) -> np.ndarray:
    """(piece, start, end): the least cost from each state to each, without what may be inserted behind the piece."""
    out = np.empty((len(pieces), 4, 4), np.int64)
    units = np.where(np.eye(4, dtype=bool), 0, FAR)
    for of in _buckets(np.array([len(p) for p in pieces])):
        turns, length = _tensor([pieces[i] for i in of])
        out[of] = backward(turns, length, np.tile(units, (len(of), 1, 1)))[0].transpose(0, 2, 1)
    return out


def audits(pieces: list[bytes], ends: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """The cheapest edits of each piece from each start state, given the costs behind it, and the states they end in."""
    edits: list[list[str]] = [[] for _ in pieces]
    last = np.empty((len(pieces), 4), np.int64)
    for of in _buckets(np.array([len(p) for p in pieces])):
        turns, length = _tensor([pieces[i] for i in of])
        letters, last[of] = trace(turns, length, backward(turns, length, ends[of][:, None, :]))
        flat = np.ascontiguousarray(letters.transpose(2, 3, 0, 1)).reshape(len(of), 4, -1)
        for i, row in zip(of, flat):
            edits[i] = [x.tobytes().replace(b"\0", b"").decode() for x in row]
    return edits, last


# --- jobs -----------------------------------------------------------------------------------------------------------

NARROW = "ck long, cn boolean, piece long, pos long, turn long, bits int, g1 long, g2 long"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds piece and pos to the sorted rows of a partition. A piece ends with its conversation or after PIECE rows."""
    part, at, key, piece, size = TaskContext.get().partitionId() << 40, 0, None, 0, 0
    for rb in batches:
        pieces = np.empty(rb.num_rows, np.int64)
        for i, now in enumerate(zip(rb.column(0).to_pylist(), rb.column(1).to_pylist())):
            if now != key or size >= PIECE:
                key, piece, size = now, part + at, 0
            pieces[i] = piece
            size += 1
            at += 1
        yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(pieces), pa.array(np.arange(part + at - rb.num_rows, part + at))], [*rb.schema.names, "piece", "pos"])


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups of the sorted key, about a batch each."""
    held: list[pa.RecordBatch] = []
    for rb in batches:
        if not rb.num_rows:
            continue
        keys = rb.column(rb.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or (held and held[-1].column(key)[-1].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, rb.slice(0, cut)])
            held = []
        held.append(rb.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


PIECES = "ck long, cn boolean, piece long, turns binary, costs array<long>, blank long, duplicate long, truncated long, illegal long, first int, last int, t0 long, t1 long, days long"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per piece from its turns, each of which a mark may follow that it is a duplicate."""
    for group in _whole(batches, "piece"):
        if not group.num_rows:
            continue
        mark = group.column("mark").to_numpy().astype(bool)
        again = np.zeros(len(mark), bool)
        again[np.flatnonzero(mark) - 1] = True
        real = ~mark
        piece, bits, again = group.column("piece").to_numpy()[real], group.column("bits").fill_null(0).to_numpy()[real], again[real]
        known = group.column("turn").is_valid().to_numpy()[real]
        turn = group.column("turn").fill_null(0).to_numpy()[real]
        blank = (bits & MUST).astype(bool)
        again &= ~blank
        cut = (bits & CUT).astype(bool) & ~blank & ~again
        role = bits & ROLE
        out = (role | np.where(blank | again, MUST, 0) | np.where(cut, CUT, 0)).astype(np.uint8)
        start = np.concatenate(([0], np.flatnonzero(np.diff(piece)) + 1))
        stop = np.append(start[1:], len(piece))
        inner = np.concatenate(([False], (piece[1:] == piece[:-1])))
        wrong = inner & ~np.concatenate(([True], LEGAL[role[:-1], role[1:]]))
        fresh = known & ~np.concatenate(([False], inner[1:] & known[:-1] & (turn[1:] == turn[:-1])))
        total = lambda x: pa.array(np.add.reduceat(x.astype(np.int64), start))
        some = np.add.reduceat(known.astype(np.int64), start) > 0
        low = np.minimum.reduceat(np.where(known, turn, np.iinfo(np.int64).max), start)
        high = np.maximum.reduceat(np.where(known, turn, np.iinfo(np.int64).min), start)
        turns = [out[a:b].tobytes() for a, b in zip(start, stop)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(group.column("ck").fill_null(0).to_numpy()[real][start]), pa.array(group.column("cn").fill_null(False).to_numpy()[real][start]), pa.array(piece[start]), pa.array(turns, pa.binary()),
             pa.array(list(matrices(turns).reshape(-1, 16)), pa.list_(pa.int64())), total(blank), total(again), total(cut), total(wrong), pa.array(role[start].astype(np.int32)),
             pa.array(role[stop - 1].astype(np.int32)), pa.array(low, mask=~some), pa.array(high, mask=~some), total(fresh)],
            [c.split(" ")[0] for c in PIECES.split(", ")])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece the costs behind it (behind), and per conversation, in the row of its first piece, the totals. Pieces come
    sorted, the last of a conversation first."""
    names = ["piece", "behind", "ck", "cn", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([("piece", pa.int64()), ("behind", pa.list_(pa.int64())), ("ck", pa.int64()), ("cn", pa.bool_()), *((c, pa.int64()) for c in names[4:])])
    key = now = None
    out: list[dict] = []

    def close() -> None:
        if now:
            t0, t1, days = now["t"]
            out[-1] |= {"ck": key[0], "cn": key[1], "gaps": 0 if t0 is None else t1 - t0 + 1 - days, "cost": int(now["costs"][0]), **now["n"]}

    for rb in batches:
        for r in rb.to_pylist():
            if (r["ck"], r["cn"]) != key:
                close()
                key, now = (r["ck"], r["cn"]), {"costs": TAIL_COST, "n": dict.fromkeys(names[5:9], 0), "t": (None, None, 0), "first": None}
            out.append({"piece": r["piece"], "behind": now["costs"].tolist()})
            now["costs"] = (np.array(r["costs"]).reshape(4, 4) + now["costs"]).min(axis=1)
            for c in names[5:9]:
                now["n"][c] += r[c]
            if now["first"] is not None:
                now["n"]["illegal"] += int(not LEGAL[r["last"], now["first"]])
            now["first"] = r["first"]
            t0, t1, days = now["t"]
            if r["t0"] is not None:
                # Pieces are in the order of turns, so two share a turn only where they meet.
                now["t"] = (r["t0"], r["t1"], r["days"]) if t0 is None else (r["t0"], t1, days + r["days"] - int(r["t1"] == t0))
            if len(out) > 10_000:
                last = out.pop()
                yield pa.RecordBatch.from_pylist(out, schema)
                out[:] = [last]
    close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        if rb.num_rows:
            ends = np.array(rb.column("behind").to_pylist(), np.int64)
            edits, last = audits(rb.column("turns").to_pylist(), ends)
            yield pa.RecordBatch.from_arrays(
                [rb.column("ck"), rb.column("cn"), rb.column("piece"), pa.array(edits, pa.list_(pa.string())), pa.array(list(last), pa.list_(pa.int64()))],
                ["ck", "cn", "piece", "edits", "ends"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows the states of a conversation through its pieces: per piece the state it starts in and its edits."""
    schema = pa.schema([("ck", pa.int64()), ("cn", pa.bool_()), ("piece", pa.int64()), ("start", pa.int32()), ("edits", pa.string())])
    key, state, out = None, 0, []
    for rb in batches:
        for r in rb.to_pylist():
            if (r["ck"], r["cn"]) != key:
                if out:
                    out[-1]["edits"] += TAIL[state]
                key, state = (r["ck"], r["cn"]), 0
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            elif len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out[:-1], schema)
                out = out[-1:]
            out.append({"ck": r["ck"], "cn": r["cn"], "piece": r["piece"], "start": state, "edits": r["edits"][state]})
            state = r["ends"][state]
    if out:
        out[-1]["edits"] += TAIL[state]
        yield pa.RecordBatch.from_pylist(out, schema)


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns of rows sorted by piece and pos, each with its piece's edits."""
    schema = pa.schema([("ck", pa.int64()), ("cn", pa.bool_()), ("part", pa.int64()), ("pos", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    piece = edits = None
    state = at = pos = 0
    row: dict = {}
    out: list[tuple] = []

    def turn(edit: str, role: str | None, text: str) -> None:
        nonlocal state, pos
        made = "assistant" if state == 2 else "user"
        out.append((row["ck"], row["cn"], row["piece"], pos, edit, made if role is None else role, text))
        state = 1 if role is not None and role[:1] == "s" else int(THEN[state])
        pos += 1

    def rest() -> None:
        nonlocal at
        while edits is not None and at < len(edits):  # only insertions can be left
            turn("I", None, "")
            at += 1

    for rb in batches:
        for now in rb.to_pylist():
            if now["piece"] != piece:
                rest()
                piece, edits, state, at, pos = now["piece"], now["edits"], now["start"], 0, 0
            row = now
            while edits[at] == "I":
                turn("I", None, "")
                at += 1
            if edits[at] != "D":
                turn(edits[at], now["role"] if edits[at] == "K" else None, now["text"])
            at += 1
        # The last row's own insertions may follow with the next batch; the rest of a batch is complete.
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
    rest()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """Faults of conversations and the cheapest edits that repair them.

    Turns are ordered by turn (nulls first), then role, then the 64-bit hash of the text; rows that repeat all of these are
    equal but for columns that play no part. A null role or text counts as one space; rows with a null conv_id are one
    conversation. Blank turns and repeats of a role and text seen earlier must be deleted; turns that don't end in `[.!?]`
    cost 3 if they stay. Extra columns play no part and aren't returned. No rows give no rows.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(
        F.coalesce(F.col(conv_col).cast("long"), F.lit(0)).alias("ck"), F.col(conv_col).isNull().alias("cn"),
        F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"),
    )
    place = ["ck", "cn", "turn", "role", "h", "salt"]
    sized = plain.withColumn("h", F.xxhash64("text")).withColumn("salt", F.monotonically_increasing_id())
    ordered = sized.repartitionByRange(*place).sortWithinPartitions(*place)
    numbered = table(ordered.select("ck", "cn", "turn", "role", "text").mapInArrow(_numbered, "ck long, cn boolean, turn long, role string, text string, piece long, pos long"), "turns")

    end = F.rtrim("text", F.lit(STRIPPED))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    bits = role + F.when(end == "", MUST).when(F.substring(end, -1, 1).isin(".", "!", "?"), 0).otherwise(CUT)
    same = ["ck", "cn", "role", "text"]
    narrow = numbered.select("ck", "cn", "piece", "pos", "turn", bits.cast("int").alias("bits"), F.xxhash64(*same).alias("g1"), F.xxhash64(F.lit("second"), *same).alias("g2"))
    first = narrow.groupBy("g1", "g2").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("g1", "g2", "first")
    hot = table(hot_keys(narrow, ["g1", "g2"]), "hot-turns")
    again = lookup(narrow.select("piece", "pos", "g1", "g2"), first, ["g1", "g2"], hot, "inner").where("pos > first")
    marks = narrow.select("ck", "cn", "piece", "pos", "turn", "bits", F.lit(False).alias("mark")).unionByName(
        again.select("piece", "pos", F.lit(True).alias("mark")), allowMissingColumns=True)
    pieces = table(marks.repartition("piece").sortWithinPartitions("piece", "pos", "mark").mapInArrow(_pieces, PIECES), "pieces")

    back = pieces.drop("turns").repartition("ck", "cn").sortWithinPartitions("ck", "cn", F.desc("piece"))
    folded = table(back.mapInArrow(_folded, "piece long, behind array<long>, ck long, cn boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"), "costs")
    traced = pieces.select("ck", "cn", "piece", "turns").join(folded.select("piece", "behind"), "piece").select("ck", "cn", "piece", "turns", "behind")
    traced = traced.mapInArrow(_traced, "ck long, cn boolean, piece long, edits array<string>, ends array<long>")
    ends = traced.repartition("ck", "cn").sortWithinPartitions("ck", "cn", "piece")
    chosen = table(ends.mapInArrow(_chosen, "ck long, cn boolean, piece long, start int, edits string"), "edits")

    conv = F.when(~F.col("cn"), F.col("ck")).alias("conv_id")
    listed = chosen.groupBy("ck", "cn").agg(F.sort_array(F.collect_list(F.struct("piece", "edits"))).alias("all"))
    audit = listed.select("ck", "cn", F.array_join("all.edits", "").alias("audit"))
    totals = folded.where("gaps is not null").drop("piece", "behind").join(audit, ["ck", "cn"])
    summary = totals.select(conv, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edited = numbered.select("ck", "cn", "piece", "pos", "role", "text").join(chosen.select("piece", "start", "edits"), "piece")
    turns = edited.repartition("piece").sortWithinPartitions("piece", "pos").mapInArrow(_rewritten, "ck long, cn boolean, part long, pos long, edit string, role string, text string")
    return Repaired(summary, turns.select(conv, "part", "pos", "edit", "role", "text"))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256: the SHA-256 (lowercase hex) of a conversation's `role:text`, joined by newlines. One digest is one
    stream, so a conversation passes through one task here, in its state of some hundred bytes."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, out = None, hashlib.sha256(), []
        for rb in batches:
            for conv, null, role, text in zip(*(rb.column(i).to_pylist() for i in range(4))):
                if (conv, null) != key:
                    if key is not None:
                        out.append((None if key[1] else key[0], h.hexdigest()))
                    key, h = (conv, null), hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(role.encode() + b":" + text.encode())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out])], ["conv_id", "sha256"])
                out = []
        if key is not None:
            out.append((None if key[1] else key[0], h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out])], ["conv_id", "sha256"])

    keyed = turns.select(F.coalesce("conv_id", F.lit(0)).alias("ck"), F.col("conv_id").isNull().alias("cn"), "part", "pos", "role", "text")
    ordered = keyed.repartition("ck", "cn").sortWithinPartitions("ck", "cn", "part", "pos").select("ck", "cn", "role", "text")
    return ordered.mapInArrow(compute, "conv_id long, sha256 string")
