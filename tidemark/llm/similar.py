"""Near-dedup by similarity: documents are linked if the Jaccard similarity of their shingle sets reaches a threshold.

Candidates come from the Golay keys of a fingerprint (see simhash) and from `BANDS` independent fingerprints, each of the
least hashes of three permutations of the set. Two sets at similarity s share one of those with probability
1 - (1 - s^3)^BANDS: at 0.8 one pair in over a million is missed, above it fewer. Documents that share a key are compared
by size and by two 64-bit SimHash sketches, which pass any pair at 0.8 or more but for a share of about 10^-6; what passes
is verified exactly, on the sets, in a join.

No group's pairs are written out. First each key gives a spanning forest of its members; its verified edges join them into
components. Then the members of a group that candidates hold together, but links do not, are compared: those outside the
group's largest component with all, block by block, in tasks that hold two blocks' sets; only links that join components
come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, lookup, table
from .components import components
from .simhash import links, majority

BANDS, ROWS = 20, 3
#: Of 128 bits; at similarity 0.8 about 20 differ, with a deviation of 4.
SKETCH_BITS = 44
#: Members of a block of a group, and shingles of them, on average.
BLOCK_NODES, BLOCK_GRAMS = 500, 500_000


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; one of the whole text if it has fewer words, none without words."""
    words = (text or "").encode().lower().split()
    n = max(1, len(words) - size + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*[words[i:] for i in range(size)])) if n > 1 else [b" ".join(words)]
    return np.unique(np.fromiter((digest(g, 42) for g in grams), np.uint64, n)) if n else np.empty(0, np.uint64)


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(42)
    return rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64), rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def band_keys(grams: np.ndarray) -> np.ndarray:
    xor, mul = _permutations()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 1 << 13):
        least = np.minimum(least, ((grams[at : at + (1 << 13)] ^ xor) * mul).min(axis=1))
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(bands[i].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and of the union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def _row_key(id_col: str, text_col: str) -> Column:
    """Tells rows by id and text; never null, so that rows with a null id spread too."""
    return F.xxhash64(F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.coalesce(text_col, F.lit("")))


def _sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row, node (hash of the shingle set), n (its size), two sketches and the keys of each row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            nodes, ns, s1, s2, keys = [], [], [], [], []
            for x in rb.column(2):
                grams = shingles(x.as_py(), size)
                nodes.append(xxhash.xxh64_intdigest(grams.tobytes(), 7))
                ns.append(len(grams))
                s1.append(majority(grams))
                s2.append(majority(mixed(grams)))
                keys.append(band_keys(grams) if len(grams) else [])
            u = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), rb.column(1), u(nodes), pa.array(ns, pa.int64()), u(s1), u(s2), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "row", "node", "n", "s1", "s2", "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _row_key(id_col, text_col).alias("row"), text_col)
    return rows.mapInArrow(compute, "doc_id long, row long, node long, n long, s1 long, s2 long, keys array<long>")


def _fits(m: list[np.ndarray], i, j, least: float) -> np.ndarray:
    """Whether members i and j may be similar: m is node, n, s1, s2."""
    n, s1, s2 = m[1], m[2].view(np.uint64), m[3].view(np.uint64)
    apart = np.bitwise_count(s1[i] ^ s1[j]).astype(np.int64) + np.bitwise_count(s2[i] ^ s2[j])
    return (apart <= SKETCH_BITS) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-6)


def _forest(m: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    edges: list[tuple[int, int]] = []
    rest = np.arange(len(m[0]))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _fits(m, at, rest, least)
            if near.any():
                reached = rest[near]
                edges += [(at, int(x)) for x in reached]
                queue += reached.tolist()
                rest = rest[~near]
    return edges


def _pairs(members: DataFrame, least: float) -> DataFrame:
    """(a, b) with a < b: a spanning forest of what may be similar among the members of each key."""

    def run(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.diff(cols[0])) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(cols[0])]))
        found: list[np.ndarray] = []
        m = cols[1:]
        two = starts[ends - starts == 2]
        fit = _fits(m, two, two + 1, least)
        found.append(np.stack((m[0][two][fit], m[0][two + 1][fit])))
        more = ends - starts > 2
        for s, e in zip(starts[more], ends[more]):
            if got := _forest([c[s:e] for c in m], least):
                at = np.array(got) + s
                found.append(np.stack((m[0][at[:, 0]], m[0][at[:, 1]])))
        both = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
        if both.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for rb in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in rb.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) and held[0][0] != held[0][-1]:
                cut = int(np.searchsorted(held[0], held[0][-1]))
                yield from run([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield from run(held)

    return members.repartition("key").sortWithinPartitions("key").mapInArrow(compute, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets have at least this similarity."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            keep = []
            for x, y in zip(rb.column(2), rb.column(3)):
                both, all_ = jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                keep.append(both >= least * all_ - 1e-9 * all_)
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = pairs
    for c in ("a", "b"):
        hot = table(hot_keys(pairs, [c]), "hot-nodes")
        out = lookup(out, sets.select(F.col("node").alias(c), F.col("grams").alias(f"set_{c}")), [c], hot)
    return out.select("a", "b", "set_a", "set_b").mapInArrow(compute, "a long, b long")


def _block_links(m: list[np.ndarray], roots: np.ndarray, grams: list, side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Verified links between nodes of side 0 and of side 1 that join components not joined yet."""
    up: dict[int, int] = {}

    def of(r: int) -> int:
        while r in up:
            r = up[r]
        return r

    out: list[tuple[int, int]] = []
    sets = [np.frombuffer(g, np.uint64) for g in grams]
    right = np.flatnonzero(side == 1)
    for i in np.flatnonzero(side == 0):
        for j in right[(roots[right] != roots[i]) & _fits(m, i, right, least)]:
            a, b = of(int(roots[i])), of(int(roots[j]))
            if a != b:
                both, all_ = jaccard(sets[i], sets[j])
                if both >= least * all_ - 1e-9 * all_:
                    up[a] = b
                    out.append((int(m[0][i]), int(m[0][j])))
    return out


def _blocks(nodes: str, grams: str) -> Column:
    return F.greatest(F.ceil(F.col(nodes) / BLOCK_NODES), F.ceil(F.col(grams) / BLOCK_GRAMS), F.lit(1)).cast("int")


def _across(nodes: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """Links between nodes of one loose group whose components differ. nodes: node, n, s1, s2, grams, root; groups: node,
    loose. Of two components one is not the group's largest, so only nodes outside the largest (the rest) must meet others:
    the rest and the whole group are dealt over blocks of bounded size, and each block of the rest meets each block of the
    group in a task, where pairs are compared and never written. A node travels once per block of the rest, and one of the
    rest once per block of the group: a group that hangs together, with up to BLOCK_NODES stray nodes, is sent about twice."""
    placed = nodes.join(groups, "node")
    parts = placed.groupBy("loose", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("g"))
    main = F.max(F.struct("c", "g", "root"))
    sized = parts.groupBy("loose").agg(F.sum("c").alias("c"), F.sum("g").alias("g"), main.alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1")
    sized = sized.withColumn("rc", F.col("c") - F.col("m.c")).withColumn("rg", F.col("g") - F.col("m.g"))
    sized = table(sized.select("loose", F.col("m.root").alias("main"), _blocks("c", "g").alias("ps"), _blocks("rc", "rg").alias("qs")), "loose-groups")
    hot = table(hot_keys(groups, ["loose"]), "hot-groups")
    known = lookup(groups, sized, ["loose"], hot, "inner")
    own = nodes.join(known, "node").withColumn("p", F.pmod(F.xxhash64("node"), F.col("ps")).cast("int")).withColumn("q", F.pmod(F.xxhash64(F.lit("rest"), "node"), F.col("qs")).cast("int"))
    sides = F.transform(F.sequence(F.lit(0), F.col("qs") - 1), lambda q: F.struct(F.col("p").alias("p"), q.alias("q"), F.lit(1).alias("side")))
    rest = F.transform(F.sequence(F.lit(0), F.col("ps") - 1), lambda p: F.struct(p.alias("p"), F.col("q").alias("q"), F.lit(0).alias("side")))
    to = F.when(F.col("root") != F.col("main"), F.concat(sides, rest)).otherwise(sides)
    dealt = own.withColumn("to", F.explode(to)).select("loose", "to.p", "to.q", "to.side", "node", "n", "s1", "s2", "root", "grams")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def answer() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                side, *cols = ([h[k] for h in held] for k in range(6))
                m = [np.array(c, np.int64) for c in cols]
                if got := _block_links(m[:4], m[4], [h[6] for h in held], np.array(side), least):
                    yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in got], pa.int64()), pa.array([max(x) for x in got], pa.int64())], ["a", "b"])
            held.clear()

        for rb in batches:
            for loose, p, q, *rest in zip(*(rb.column(k).to_pylist() for k in range(10))):
                if (loose, p, q) != at:
                    yield from answer()
                    at = (loose, p, q)
                held.append(rest)
        yield from answer()

    return dealt.repartition("loose", "p", "q").sortWithinPartitions("loose", "p", "q").mapInArrow(compute, "a long, b long")


def _sets(docs: DataFrame, rows: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """node and its sorted hashes, for one row of each node."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            grams = [shingles(x.as_py(), size).tobytes() for x in rb.column(1)]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(grams, pa.binary())], ["node", "grams"])

    texts = docs.select(_row_key(id_col, text_col).alias("row"), text_col)
    place = Window.partitionBy("row").orderBy("row")  # rows that repeat an id and a text
    one = texts.join(rows, "row").withColumn("_n", F.row_number().over(place)).where("_n = 1")
    return one.select("node", text_col).mapInArrow(compute, "node long, grams binary")


def similar_links(docs: DataFrame, own: DataFrame, nodes: DataFrame, least: float, size: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between nodes: verified ones, enough of them that the components are those of all links."""
    members = table(own.select(F.explode("keys").alias("key"), "node", "n", "s1", "s2").distinct(), "band-keys")
    by_fp = own.where("n > 0").groupBy(F.col("s1").alias("fp")).agg(F.min("node").alias("node"))
    golay = links(own.where("n > 0").select(F.col("s1").alias("fp")), 5)
    for c in ("a", "b"):
        golay = golay.join(by_fp.select(F.col("fp").alias(c), F.col("node").alias(f"n{c}")), c)
    golay = golay.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    first = table(_pairs(members, least).unionByName(golay).distinct(), "candidates")
    named = table(first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).distinct(), "candidate-nodes")
    sets = table(_sets(docs, nodes.join(named, "node").select("row", "node"), size, id_col, text_col), "sets")
    good = table(_verified(first, sets, least), "links")
    # What may be similar lies in one component of the candidates, as each key has spanned its members.
    info = own.select("node", "n", "s1", "s2").distinct().join(sets, "node").join(components(good), "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = table(components(first).withColumnRenamed("root", "loose"), "groups")
    second = table(_across(info, groups, least), "links")
    return good.unionByName(second)


def keep_one_similar(docs: DataFrame, least: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group that links reach, that with the smallest id (a null id comes last, then the least hash of
    the text counts); columns unchanged. Texts without words are one group."""
    own = table(_sketches(docs, size, id_col, text_col), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "row")
    nodes = table(own.groupBy("node").agg(F.min(order).alias("first")).select("node", "first", "first.row"), "nodes")
    roots = components(table(similar_links(docs, own, nodes, least, size, id_col, text_col), "links"))
    kept = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    name = "__row"
    while name in docs.columns or f"{name}n" in docs.columns:
        name += "_"
    marked = docs.withColumn(name, _row_key(id_col, text_col))
    place = Window.partitionBy(name).orderBy(name)
    once = marked.join(kept.select(F.col("first.row").alias(name)), name, "left_semi").withColumn(f"{name}n", F.row_number().over(place))
    return once.where(F.col(f"{name}n") == 1).select(*docs.columns)
