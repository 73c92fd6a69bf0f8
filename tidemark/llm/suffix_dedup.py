"""Suffix-array dedup: removes every byte that a string of `window` bytes covers which also starts anywhere else.

What is compared must meet first. Each window is keyed by the least hash of the short strings in it, so equal windows have
equal keys wherever they stand; a run of windows with one key is a segment. Segments whose key is found once are done.
Those of the others, one of each different content with the number of its places, are dealt by key into shards of bounded
size. A shard's suffix array is built by Larsson-Sadakane refinement, Kasai's algorithm gives the common prefixes, and
windows are repeated where a neighbour shares all of them. A key with more text than a shard holds gets several arrays,
merged by binary search of one array's windows in the other; one with more text than a task should hold is keyed anew by
longer strings, up to the window itself, so no group is collected whole and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, hot_keys, lookup, table

#: Length of the strings that key a window at first.
GRAM = 64
#: Most windows of a segment, and of a text that are keyed at once.
SEGMENT, BLOCK = 512, 1 << 18
#: Bits of a place in a shard: a rank, another rank and a place are sorted as one 63-bit number.
BITS = 21
#: Bytes of a shard, and of the segments of one key that one task may hold.
SHARD_BYTES, GROUP_BYTES = 1 << 20, 8 << 20


# --- segments -------------------------------------------------------------------------------------------------------


def gram_sizes(window: int) -> list[int]:
    """Lengths of keying strings, level by level; the last is the window."""
    out = [min(GRAM, window)]
    while out[-1] < window:
        out.append(out[-1] + (window - out[-1] + 1) // 2)
    return out


_BYTES = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
_ODD = 0x9E3779B97F4A7C15


def gram_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """A hash of each string of `size` bytes, by doubling."""
    power, part, h, done = 1, _BYTES[text], None, 0
    while power <= size:
        if size & power:
            if h is None:
                h = part
            else:
                h = h[: len(h) - power] * np.uint64(pow(_ODD, power, 1 << 64)) + part[done : done + len(h) - power]
            done += power
        if 2 * power <= size:
            part = part[: len(part) - power] * np.uint64(pow(_ODD, power, 1 << 64)) + part[power:]
        power *= 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    n, w = len(h) - width + 1, 1
    while 2 * w <= width:
        h, w = np.minimum(h[: len(h) - w], h[w:]), 2 * w
    return np.minimum(h[:n], h[width - w : width - w + n])


def _several(h: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Which segments hold the string of their key more than once, as they must to repeat one of their own windows."""
    none = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(h == ~sliding_least(~np.concatenate((none, key, none)), width))  # strings that key some window
    low, high = np.searchsorted(chosen, start), np.searchsorted(chosen, start + size - 1 + width)
    n = high - low
    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    of = np.repeat(np.arange(len(start)), n)
    return np.bincount(of[h[chosen[at]] == key[start[of]]], minlength=len(start)) > 1


def segments(text: bytes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and key of each segment of a text, and whether it may repeat a window in itself."""
    b, found = np.frombuffer(text, np.uint8), []
    total = len(b) - window + 1
    for at in range(0, max(total, 0), BLOCK):
        to = min(total, at + BLOCK)
        h = gram_hashes(b[at : to + window - 1], gram)
        key = sliding_least(h, window - gram + 1)
        start = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        size = np.diff(np.append(start, len(key)))
        if (long := size > SEGMENT).any():
            parts = -(-size // SEGMENT)
            first = np.repeat(np.cumsum(parts) - parts, parts)
            start = np.repeat(start, parts) + SEGMENT * (np.arange(len(first)) - first)
            size = np.diff(np.append(start, len(key)))
        found.append((start + at, size, key[start].view(np.int64), _several(h, key, start, size, window - gram + 1)))
    if not found:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found))


# --- shards ---------------------------------------------------------------------------------------------------------


class Shard:
    """The suffix array of some strings, each of at least `window` bytes. `windows` are the places that hold a window, in
    the order of their suffixes; `twin` tells of each but the first whether it equals the one before; `found` collects, by
    place, which are repeated."""

    def __init__(self, pieces: list[bytes], window: int):
        self.window = window
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        n = int(self.lengths.sum())
        if n >= 1 << BITS:
            raise ValueError("a shard is too large")
        self.text = np.frombuffer(b"".join(pieces) + bytes(16), np.uint8)
        self.left = np.repeat(self.starts + self.lengths, self.lengths) - np.arange(n)
        #: Eight bytes from each place on, as one number.
        self.words = np.ndarray((n + 8,), "<u8", self.text.data, strides=(1,))
        order, rank = self._sorted()
        whole = self.left[order] >= window
        common = self._common(order, rank)
        self.windows, self.twin = order[whole], common[order[whole]] >= window
        self.found = np.zeros(n, bool)
        self.found[self.windows[self.twin]] = True
        self.found[self.windows[:-1][self.twin[1:]]] = True

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, equal ones by place, and the rank of each."""
        n, low = len(self.left), np.int64((1 << BITS) - 1)
        symbols = np.append(self.text[:n].astype(np.int64) + 1, np.zeros(4, np.int64))
        key = np.zeros(n, np.int64)
        for k in range(4):
            key = (key << 9) | np.where(self.left > k, symbols[k : k + n], 0)
        packed = np.sort((key << BITS) | np.arange(n))
        order, key = packed & low, packed >> BITS
        head = np.append(True, key[1:] != key[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        depth = 4
        while True:
            # Groups of one are sorted, and so are groups that end within their equal part. Only the others are refined, by
            # the rank of what follows it.
            at = np.flatnonzero(~(head & np.append(head[1:], True)) & (self.left[order] >= depth))
            if not len(at):
                break
            place = order[at]
            behind = np.where(self.left[place] > depth, rank[np.minimum(place + depth, n - 1)] + 1, 0)
            packed = np.sort((rank[place] << (2 * BITS)) | (behind << BITS) | place)
            place, group = packed & low, packed >> BITS
            order[at] = place
            head[at] = np.append(True, group[1:] != group[:-1])
            rank[place] = np.maximum.accumulate(np.where(head[at], at, 0))
            depth *= 2
        rank[order] = np.arange(n)
        return order, rank

    def _common(self, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Kasai: bytes that each window's suffix shares with the suffix before it, up to `window`. Going right by one byte
        loses one shared byte at most; all pieces go right together."""
        common = np.zeros(len(order), np.int64)
        owned = self.lengths - self.window + 1
        by_size = np.argsort(-owned, kind="stable")
        starts, owned = self.starts[by_size], owned[by_size]
        have = np.zeros(len(starts), np.int64)
        for t in range(int(owned.max(initial=0))):
            m = int(np.searchsorted(-owned, -t, side="left"))  # pieces with more than t windows
            place = starts[:m] + t
            at = rank[place]
            other = order[at - 1]
            have = np.maximum(have[:m] - 1, 0)
            limit = np.where(at > 0, np.minimum(self.left[other], self.window), 0)
            on = np.flatnonzero(have < limit)
            while len(on):
                differ = self.words[place[on] + have[on]] ^ self.words[other[on] + have[on]]
                same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
                have[on] += same
                on = on[(same == 8) & (have[on] < limit[on])]
            have = np.minimum(have, limit)
            common[place] = have
        return common

    def _compare(self, places: np.ndarray, other: Shard, others: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: windows at places against windows at others of another shard."""
        out = np.zeros(len(places), np.int64)
        on = np.arange(len(places))
        for k in [*range(0, self.window - 7, 8), *([self.window - 8] if self.window % 8 else [])]:
            a, b = self.words[places[on] + k].byteswap(), other.words[others[on] + k].byteswap()
            out[on] = (a > b).astype(np.int64) - (a < b)
            on = on[a == b]
            if not len(on):
                break
        return out

    def merge(self, other: Shard) -> None:
        """Marks in both what they share: the other's different windows are searched for in this one's order."""
        if not len(self.windows) or not len(other.windows):
            return
        heads = [np.flatnonzero(~x.twin) for x in (self, other)]
        mine, theirs = self.windows[heads[0]], other.windows[heads[1]]
        low, high = np.zeros(len(theirs), np.int64), np.full(len(theirs), len(mine))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            less = self._compare(mine[mid], other, theirs[open_]) < 0
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        in_range = np.flatnonzero(low < len(mine))
        both = in_range[self._compare(mine[low[in_range]], other, theirs[in_range]) == 0]
        for shard, head, hit in ((self, heads[0], low[both]), (other, heads[1], both)):
            shared = np.zeros(len(head), bool)
            shared[hit] = True
            shard.found[shard.windows[np.repeat(shared, np.diff(np.append(head, len(shard.windows))))]] = True

    def ranges(self, times: np.ndarray) -> list[list[dict]]:
        """Per piece the ranges [a, b) of its windows that are repeated; all of a piece that has several places."""
        found = self.found | np.repeat(times > 1, self.lengths)
        found &= self.left >= self.window
        edge = np.diff(np.concatenate(([False], found, [False])).astype(np.int8))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        of = np.searchsorted(self.starts, a, side="right") - 1
        out: list[list[dict]] = [[] for _ in self.starts]
        for i, x, y in zip(of.tolist(), (a - self.starts[of]).tolist(), (b - self.starts[of]).tolist()):
            out[i].append({"a": x, "b": y})
        return out


# --- jobs -----------------------------------------------------------------------------------------------------------

RANGES = "array<struct<a:long,b:long>>"
_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _split(window: int, gram: int):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (r1, r2, w, text) to segments."""
        names = ["r1", "r2", "w", "start", "n", "h", "own", "d"]
        for rb in batches:
            rows, starts, sizes, keys, selves, digests = [], [], [], [], [], []

            def out() -> pa.RecordBatch:
                of = np.repeat(np.array([r for r, _ in rows]), [k for _, k in rows])
                own = [pa.array(rb.column(c).to_numpy()[of]) for c in range(3)]
                made = [pa.array(np.concatenate(x)) for x in (starts, sizes, keys, selves)]
                for x in (rows, starts, sizes, keys, selves):
                    x.clear()
                return pa.RecordBatch.from_arrays([*own, *made, pa.array(np.array(digests, np.uint64).view(np.int64))], names)

            for i, value in enumerate(rb.column(3)):
                text = value.as_py() or b""
                start, size, key, own = segments(text, window, gram)
                if len(start):
                    rows.append((i, len(start)))
                    starts.append(start)
                    sizes.append(size)
                    keys.append(key)
                    selves.append(own)
                    digests += [xxhash.xxh3_64_intdigest(text[s:e]) for s, e in zip(start.tolist(), (start + size + window - 1).tolist())]
                    if len(digests) > 100_000:
                        yield out()
                        digests = []
            if rows:
                yield out()

    return compute


def _fetched(window: int):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (text, need) to the needed segments with their bytes."""
        schema = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("w", pa.int64()), ("bytes", pa.binary())])
        for rb in batches:
            rows: list[dict] = []
            for text, need in zip(rb.column(0), rb.column(1).to_pylist()):
                text = text.as_py()
                rows += [{"h": s["h"], "d": s["d"], "w": s["w"], "bytes": text[s["start"] : s["start"] + s["n"] + window - 1]} for s in need]
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return compute


def _sharded(window: int, shard_bytes: int):
    def answer(shards: list[Shard], rows: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        for i, a in enumerate(shards):
            for b in shards[i + 1 :]:
                a.merge(b)
        for shard, own in zip(shards, rows):
            found = shard.ranges(np.array([r[2] for r in own]))
            hit = [(r[0], r[1], f) for r, f in zip(own, found) if f]
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in hit], pa.int64()), pa.array([x[1] for x in hit], pa.int64()), pa.array([x[2] for x in hit], _RANGES)], ["h", "d", "ranges"])

    def solve(groups: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        """Arrays of whole groups; a group beyond one array's size, which comes alone, is cut over several and merged."""
        rows = [r for g in groups for r in g]
        parts: list[list[tuple]] = [[]]
        size = 0
        for r in rows:
            if parts[-1] and size + len(r[3]) > shard_bytes:
                parts.append([])
                size = 0
            parts[-1].append(r)
            size += len(r[3])
        yield from answer([Shard([r[3] for r in p], window) for p in parts], parts)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (h, d, w, bytes), sorted by h, to ranges of repeated windows."""
        groups: list[list[tuple]] = []
        held, key, now, size = 0, None, [], 0
        for rb in batches:
            for r in zip(*(rb.column(i).to_pylist() for i in range(4))):
                if r[0] != key:
                    if now:
                        if groups and held + size > shard_bytes:
                            yield from solve(groups)
                            groups, held = [], 0
                        groups.append(now)
                        held += size
                    key, now, size = r[0], [], 0
                now.append(r)
                size += len(r[3])
        if now:
            if groups and held + size > shard_bytes:
                yield from solve(groups)
                groups = []
            groups.append(now)
        if groups:
            yield from solve(groups)

    return compute


def repeated_windows(texts: DataFrame, window: int, level: int = 0) -> DataFrame:
    """(r1, r2, start, ranges): ranges of windows, relative to start, that also start elsewhere. texts: r1, r2, w (places
    that hold the text), text (binary); (r1, r2) is unique."""
    gram = gram_sizes(window)[level]
    found = table(texts.select("r1", "r2", "w", "text").mapInArrow(_split(window, gram), "r1 long, r2 long, w long, start long, n long, h long, own boolean, d long"), "segments")
    often = table(found.groupBy("h").agg(F.sum("w").alias("places"), F.max("own").alias("own")).where("places > 1 or own").select("h"), "repeated-keys")
    common = table(hot_keys(found, ["h"]), "hot-keys")
    cand = table(lookup(found, often, ["h"], common, "left_semi"), "candidates")
    drop(found)
    different = cand.groupBy("h", "d").agg(F.sum("w").alias("w"), F.min(F.struct("r1", "r2", "start", "n")).alias("at"))
    different = table(different.select("h", "d", "w", "at.*"), "different-segments")
    sizes = table(different.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n") + window - 1).alias("bytes")), "key-sizes")
    busy = table(hot_keys(different, ["h"]), "hot-keys")
    sized = lookup(different, sizes, ["h"], busy, "inner")
    need = F.struct("h", "d", "w", "start", "n")

    def with_bytes(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy("r1", "r2").agg(F.collect_list(need).alias("need"))
        return texts.select("r1", "r2", "text").join(lists, ["r1", "r2"]).select("text", "need").mapInArrow(_fetched(window), "h long, d long, w long, bytes binary")

    # A key with one content at several places has nothing to compare: they are all the same.
    alone = sized.where("k = 1 and w > 1").select("h", "d", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))).alias("ranges"))
    small = with_bytes(sized.where(((F.col("k") > 1) | (F.col("w") == 1)) & (F.col("bytes") <= GROUP_BYTES)))
    ranges = small.repartition("h").sortWithinPartitions("h").mapInArrow(_sharded(window, SHARD_BYTES), f"h long, d long, ranges {RANGES}")
    parts = [alone, ranges]
    large = F.col("bytes") > GROUP_BYTES  # never a single segment
    if gram < window and not sizes.where(large).isEmpty():
        inner = table(with_bytes(sized.where(large)).select(F.col("h").alias("r1"), F.col("d").alias("r2"), "w", F.col("bytes").alias("text")), "large-keys")
        deeper = repeated_windows(inner, window, level + 1)
        moved = F.transform("ranges", lambda x: F.struct((x["a"] + F.col("start")).alias("a"), (x["b"] + F.col("start")).alias("b")))
        parts.append(deeper.select(F.col("r1").alias("h"), F.col("r2").alias("d"), moved.alias("ranges")).groupBy("h", "d").agg(F.flatten(F.collect_list("ranges")).alias("ranges")))
    answers = parts[0]
    for p in parts[1:]:
        answers = answers.unionByName(p)
    answers = table(answers, "ranges")
    copied = table(hot_keys(cand, ["h", "d"]), "hot-segments")
    return lookup(cand.select("r1", "r2", "start", "h", "d"), answers, ["h", "d"], copied, "inner").select("r1", "r2", "start", "ranges")


def covered(ranges: list[tuple[int, list[dict]]], window: int) -> list[tuple[int, int]]:
    """Maximal runs [from, to) of bytes that the windows in the ranges cover."""
    out: list[list[int]] = []
    for a, b in sorted((start + r["a"], start + r["b"] + window - 1) for start, own in ranges for r in own):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def suffix_dedup(docs: DataFrame, window: int = 200, text_col: str = "text") -> DataFrame:
    """Every input column, and n_bytes, n_removed, n_spans, spans (array of from, to: the maximal removed runs) and kept
    (binary: the bytes that are left, which may be parts of characters).

    A byte goes if a string of `window` bytes that covers it also starts at another place, in any row or the same one;
    strings don't cross rows. Null and empty texts have no bytes. Rows that repeat are different rows, so what they hold
    goes if it is long enough. Input columns of those names are replaced. No rows give no rows. window is at least 8.
    """
    if window < 8:
        raise ValueError("window must be at least 8")
    added = ["n_bytes", "n_removed", "n_spans", "spans", "kept"]
    own = [c for c in docs.columns if c not in added]
    # Rows are numbered once and written, so that they keep their numbers.
    rows = table(docs.select(F.monotonically_increasing_id().alias("r1"), F.struct(*own).alias("row")), "rows")
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")).cast("binary")
    texts = rows.select("r1", F.lit(0).cast("long").alias("r2"), F.lit(1).cast("long").alias("w"), text.alias("text"))
    # A row has at most one segment a byte, so its list is bounded by its text.
    lists = repeated_windows(texts, window).groupBy("r1").agg(F.collect_list(F.struct("start", "ranges")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for rb in batches:
            kept, spans = [], []
            for value, found in zip(rb.column(1), rb.column(2).to_pylist()):
                body, at, parts = value.as_py(), 0, []
                runs = covered([(f["start"], f["ranges"]) for f in found or []], window)
                for a, b in runs:
                    parts.append(body[at:a])
                    at = b
                kept.append(b"".join([*parts, body[at:]]))
                spans.append([{"from": a, "to": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([len(v.as_py()) for v in rb.column(1)], pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary())], ["row", "n_bytes", "spans", "kept"])

    schema = rows.select("row").withColumns({"n_bytes": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<from:long,to:long>>"), "kept": F.lit(b"")}).schema
    done = rows.select("r1", "row", text.alias("text")).join(lists, "r1", "left").select("row", "text", "found").mapInArrow(cut, schema)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])
    return done.select(*(F.col("row")[c].alias(c) for c in own), "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", "kept")
