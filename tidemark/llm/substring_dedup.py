"""Substring dedup by suffix automata of reference shards.

1. Winnowed anchors (the least 16-word hash of each window) tell which windows could repeat: a window and its anchor
   repeat together. Only spans around anchors found in two documents go on.
2. Equal spans, by a 128-bit hash, are matched once for all their copies.
3. Spans fall into chunks of windows with one anchor, equal ones of which count once. The chunks' window hashes give the
   reference: each window that several documents hold, at its first place. These passages are cut into pieces that overlap by a window less one word, and the pieces dealt into shards of bounded
   size.
4. Each shard's pieces become one suffix automaton of words, with the least owner of each state. The spans that share a
   window with a piece are streamed through its shard; where the matching statistic reaches the window's length, the
   state's owner is noted, and the words go from every document with a greater id. Words are compared, not hashes.

Automata go to the spans that can match them, not to all documents: sending every shard to every document would grow
with the square of the corpus. Each window names one shard, so a chunk goes to no more shards than it has windows. A shard with many
spans is copied to several tasks, so a passage that a third of the documents share is spread. A collision of 64-bit
hashes can hide a repeat from its shard; it never removes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, hot_keys, lookup, table

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Words of reference pieces in a shard, of one piece, and spans that one copy of a shard's automaton serves.
SHARD_WORDS, PIECE_WORDS, SHARD_SPANS = 40_000, 4_000, 4_000
LAST = (1 << 63) - 1


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at the six white-space characters of ASCII alone


def hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 15)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64))), dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, from prefix sums."""
    up, down = powers(len(h) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))
    r = (sums[k:] - sums[:-k]) * down[: len(h) - k + 1]
    r ^= r >> np.uint64(29)
    r *= np.uint64(0xBF58476D1CE4E5B9)
    return r ^ (r >> np.uint64(32))


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each short gram, and for each window the place of its first least gram."""
    gram = max(1, window // 3)
    g = rolling(h, gram)
    return g, sliding_window_view(g, window - gram + 1).argmin(axis=1) + np.arange(len(h) - window + 1)


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    e = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(e[::2].tolist(), e[1::2].tolist()))


class Automaton:
    """Suffix automaton of several word sequences; each state knows the least owner of the sequences it occurs in."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len, self.owner = [-1], [0], [LAST]

    def _state(self, length: int, owner: int, to: dict[bytes, int]) -> int:
        self.next.append(to)
        self.link.append(0)
        self.len.append(length)
        self.owner.append(owner)
        return len(self.len) - 1

    def add(self, ws: list[bytes], owner: int) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for w in ws:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                self.owner[q] = min(self.owner[q], owner)
                continue
            if q is not None:
                last = self._clone(last, w, q)
                self.owner[last] = min(self.owner[last], owner)
                continue
            cur, p = self._state(length[last] + 1, owner, {}), last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link = self.next, self.link
        c = self._state(self.len[p] + 1, LAST, dict(nxt[q]))
        link[c] = link[q]
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def finish(self) -> None:
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.owner[self.link[v]] = min(self.owner[self.link[v]], self.owner[v])

    def owners(self, ws: list[bytes], window: int) -> list[int]:
        """For each place the least owner of a sequence with the `window` words that end there; LAST without one."""
        nxt, link, length, owner = self.next, self.link, self.len, self.owner
        v = n = 0
        out = []
        for w in ws:
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            v = nxt[v].get(w, 0)
            n = n + 1 if v else 0
            if n >= window:
                n = window  # the state of just the last `window` words
                while length[link[v]] >= n:
                    v = link[v]
                out.append(owner[v])
            else:
                out.append(LAST)
        return out


def _col(values: list | np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


def _text_key(text_col: str) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def pieces(n: int, window: int, size: int) -> list[tuple[int, int]]:
    """(from, until) of the pieces of n words: every window lies whole in one, and none is longer than `size`."""
    step = max(1, size - window + 1)
    return [(i, min(n, i + step + window - 1)) for i in range(0, max(1, n - window + 1), step)]


def find_repeats(docs: DataFrame, window: int = 50, shard_words: int = SHARD_WORDS, piece_words: int = PIECE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t (hash of the text) and ranges (from, until) of words to remove; the ranges may overlap."""
    if window < 4:
        raise ValueError("window must be at least 4 words")
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), _text_key(text_col).alias("t"), F.col(text_col).alias("text"))
    i64, i32, f64 = pa.int64(), pa.int32(), F.col

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            d, t, a, p = [], [], [], []
            for doc, key, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2)):
                ws = words(text.as_py())
                if len(ws) >= window:
                    g, at = anchors(hashes(ws), window)
                    places = np.unique(at)
                    a.append(g[places].view(np.int64))
                    p.append(places)
                    d.append(np.full(len(places), doc, np.int64))
                    t.append(np.full(len(places), key, np.int64))
            if d:
                yield pa.RecordBatch.from_arrays([_col(np.concatenate(x), i64) for x in (d, t, a)] + [_col(np.concatenate(p), i32)], ["doc_id", "t", "a", "pos"])

    found = table(base.mapInArrow(anchored, "doc_id long, t long, a long, pos int"), "anchors")
    # An anchor in two documents is a candidate. min and max are combined before the shuffle.
    twice = table(found.groupBy("a").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y").select("a", "n"), "repeated-anchors")
    hot = table(hot_keys(twice, ["a"], weight=f64("n")), "hot-anchors")
    places = lookup(found, twice.select("a"), ["a"], hot, "left_semi").groupBy("doc_id", "t").agg(F.collect_set("pos").alias("places"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, key, text, at_list in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2), rb.column(3)):
                ws = words(text.as_py())
                g, at = anchors(hashes(ws), window)
                good = np.zeros(len(g), bool)
                good[at_list.values.to_numpy(zero_copy_only=False)] = True
                for s, e in runs(good[at]):
                    part = b" ".join(ws[s : e + window - 1])
                    for x, v in zip(out, (doc, key, s, e - s, xxhash.xxh3_128_digest(part), part.decode())):
                        x.append(v)
            kinds = (i64, i64, i32, i32, pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([_col(x, k) for x, k in zip(out, kinds)], ["doc_id", "t", "start", "n", "h", "words"])

    spanned = table(base.join(places.hint("merge"), ["doc_id", "t"]).mapInArrow(spans, "doc_id long, t long, start int, n int, h binary, words string"), "spans")
    drop(found, twice, hot)
    first = F.min(F.struct("doc_id", "t", "start")).alias("first")
    owners = table(spanned.groupBy("h").agg(first, F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("copies")).select("h", "first.*", "last", "copies"), "span-owners")
    # Of equal spans the first; a place is a key on both sides, so none is hot.
    firsts = spanned.drop("h", "n").join(owners.drop("copies").hint("merge"), ["doc_id", "t", "start"])
    firsts = table(firsts.select(F.monotonically_increasing_id().alias("span"), "h", "doc_id", "last", "words"), "first-spans")

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for span, doc, last, text in zip(*(rb.column(k).to_pylist() for k in range(4))):
                ws = words(text)
                at = anchors(hashes(ws), window)[1]
                cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
                ids = [xxhash.xxh3_64_intdigest(b" ".join(ws[i : j + window - 1])) for i, j in zip(cuts, cuts[1:])]
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [_col(np.array(ids, np.uint64).view(np.int64), i64), *(_col(np.full(n, v), i64) for v in (span, doc, last)), _col(cuts[:-1], i32), _col(np.diff(cuts), i32)],
                    ["c", "span", "doc_id", "last", "off", "n"])

    # Chunks: windows in a row with one anchor. Near copies have most of them in common, so windows are taken from
    # different chunks only.
    chunks = table(firsts.select("span", "doc_id", "last", "words").mapInArrow(chunked, "c long, span long, doc_id long, last long, off int, n int"), "chunks")
    lone = chunks.groupBy("c").agg(F.min(F.struct("doc_id", "span", "off", "n")).alias("f"), F.max("last").alias("y"), F.count(F.lit(1)).alias("times"))
    lone = table(lone.select("c", f64("f.doc_id").alias("x"), "f.span", "f.off", "f.n", "y", "times"), "first-chunks")
    per = lone.groupBy("span").agg(F.collect_list(F.struct("c", "off", "n", "x", "y")).alias("cs"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for text, cs in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                w = rolling(hashes(words(text)), window).view(np.int64)
                ns = [c["n"] for c in cs]
                yield pa.RecordBatch.from_arrays(
                    [_col(np.concatenate([w[c["off"] : c["off"] + c["n"]] for c in cs]), i64), *(_col(np.repeat([c[k] for c in cs], ns), i64) for k in ("c", "x", "y"))],
                    ["w", "c", "x", "y"])

    rolled = table(firsts.select("span", "words").join(per.hint("merge"), "span").select("words", "cs").mapInArrow(windows, "w long, c long, x long, y long"), "windows")
    # The least document of each window that several hold; combined before the shuffle.
    held = rolled.groupBy("w").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y")
    held = table(held.select("w", "x", "n"), "window-owners")
    own = held.groupBy(f64("x").alias("doc_id")).agg(F.collect_list("w").alias("repeated"))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out: list[list] = [[] for _ in range(4)]
            for doc, text, repeated in zip(*(rb.column(k) for k in range(3))):
                ws = words(text.as_py())
                rolled_ = rolling(hashes(ws), window).view(np.int64)
                for s, e in runs(np.isin(rolled_, repeated.values.to_numpy(zero_copy_only=False))):
                    for a, b in pieces(e - s + window - 1, window, piece_words):
                        for x, v in zip(out, (doc.as_py(), b" ".join(ws[s + a : s + b]).decode(), b - a, rolled_[s + a : s + b - window + 1])):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([_col(x, k) for x, k in zip(out, (i64, pa.string(), i32, pa.list_(i64)))], ["owner", "words", "n", "ws"])

    reference = table(firsts.join(own, "doc_id").select("doc_id", "words", "repeated").mapInArrow(passages, "owner long, words string, n int, ws array<long>"), "reference")
    total = reference.agg(F.sum("n")).first()[0] or 0  # one number, to size the shards
    shard = F.pmod(F.xxhash64("owner", f64("ws")[0]), F.lit(1 + total // shard_words))
    reference = reference.withColumn("shard", shard)
    of_window = reference.select("shard", "owner", F.explode("ws").alias("w")).groupBy("w").agg(F.min(F.struct("owner", "shard")).alias("o")).select("w", "o.*")
    hot_windows = table(hot_keys(held, ["w"], weight=f64("n")), "hot-windows")
    # A chunk goes where its windows are, and a span where its chunks are, if a document with a copy of it comes after the
    # owner.
    placed = lookup(rolled.select("w", "c"), table(of_window, "window-shards"), ["w"], hot_windows, "inner").groupBy("c", "shard").agg(F.min("owner").alias("owner"))
    placed = table(placed.groupBy("c").agg(F.collect_list(F.struct("shard", "owner")).alias("at")), "chunk-shards")
    hot_chunks = table(hot_keys(lone, ["c"], weight=f64("times")), "hot-chunks")
    routes = lookup(chunks.select("c", "span", "last"), placed, ["c"], hot_chunks, "inner").select("span", "last", F.inline("at"))
    routes = table(routes.where("owner < last").select("span", "shard").distinct(), "routes")
    drop(rolled, held, chunks, lone, placed)
    copies_of = routes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_SPANS).cast("int").alias("salts"))
    stream = routes.join(copies_of, "shard").join(firsts.select("span", "words"), "span").select(
        "shard", F.pmod(F.xxhash64("span"), f64("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), f64("span").alias("id"), "words")
    served = reference.join(copies_of, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), f64("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), f64("owner").alias("id"), "words")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, auto, done = None, Automaton(), False
        for rb in batches:
            out: list[list] = [[] for _ in range(4)]
            for shard, salt, kind, id_, text in zip(*(rb.column(k) for k in range(5))):
                here, ws = (shard.as_py(), salt.as_py()), words(text.as_py())
                if here != at:
                    at, auto, done = here, Automaton(), False
                if kind.as_py() == 0:
                    auto.add(ws, id_.as_py())
                    continue
                if not done:
                    auto.finish()
                    done = True
                found_ = np.array(auto.owners(ws, window), np.int64)
                edges = np.flatnonzero(np.diff(found_)) + 1
                for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(ws)]):
                    if found_[s] < LAST:
                        for x, v in zip(out, (id_.as_py(), s - window + 1, e, int(found_[s]))):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([_col(x, k) for x, k in zip(out, (i64, i32, i32, i64))], ["span", "from", "until", "owner"])

    hits = stream.unionByName(served).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(matched, "span long, from int, until int, owner long")
    per_span = hits.groupBy("span").agg(F.collect_list(F.struct("from", "until", "owner")).alias("hits"))
    per_span = table(per_span.join(firsts.select("span", "h"), "span").select("h", "hits"), "span-hits")
    hot_spans = table(hot_keys(owners, ["h"], weight=f64("copies")), "hot-spans")
    copies = lookup(spanned.select("doc_id", "t", "start", "h"), per_span, ["h"], hot_spans, "inner")
    ranges = copies.select("doc_id", "t", "start", F.inline("hits")).where("owner < doc_id")
    return ranges.select("doc_id", "t", (f64("start") + f64("from")).alias("from"), (f64("start") + f64("until")).alias("until"))


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Input columns with the text's kept words joined by one space, plus n_words (before) and n_removed.

    Words are runs of other characters than space and \\t \\n \\v \\f \\r, unchanged. A word goes if it lies in `window`
    consecutive words that also start in a document with a smaller id; windows are judged on the input. Null texts have
    no words. Rows of one id are one document: they never remove from each other. A null id counts as the greatest.
    Input columns named n_words or n_removed are replaced.
    """
    ranges = table(find_repeats(docs, window, id_col=id_col, text_col=text_col), "repeats").groupBy("doc_id", "t").agg(F.collect_list(F.struct("from", "until")).alias("__ranges"))
    ranges = ranges.select(F.col("doc_id").alias("__d"), F.col("t").alias("__t"), "__ranges")
    docs = docs.drop("n_words", "n_removed")
    on = (F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)) == F.col("__d")) & (_text_key(text_col) == F.col("__t"))
    # The same plan at every size: left to estimates, small corpora broadcast the ranges and only large ones move texts.
    joined = docs.join(ranges.hint("merge"), on, "left").drop("__d", "__t")
    names = docs.columns
    at, n = names.index(text_col), len(names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts, counts, gone = [], [], []
            for text, ranges_ in zip(rb.column(at), rb.column(n)):
                ws = words(text.as_py())
                r, keep = ranges_.as_py(), np.ones(len(ws), bool)
                for x in r or ():
                    keep[x["from"] : x["until"]] = False
                texts.append((b" ".join(ws) if not r else b" ".join(w for w, k in zip(ws, keep.tolist()) if k)).decode())
                counts.append(len(ws))
                gone.append(len(ws) - int(keep.sum()))
            cols = [rb.column(i) for i in range(n)]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_words", "n_removed"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(cut, f"{kinds}, n_words long, n_removed long")
