"""SimHash near-dedup with Golay-code keys.

A 64-bit fingerprint is cut into three segments, each read as a word of the perfect [23, 12] Golay code. A word's keys
are the indices of all codewords at distance 4 or less: one, or six if its nearest codeword is at distance 3. Words at
distance 2 or less share a key. Of up to 5 differing bits over three segments, at most one segment holds more than 2
(pigeonhole), so two linked fingerprints share the keys of at least one pair of segments. Those pairs of keys are the
join keys; the exact distance is verified. Fingerprints that meet under a key are linked by a search that compares each
only with those not reached yet, so a group of copies costs little and gives a spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, lookup, table
from .components import components

#: Bits of the three segments; each is padded with zeros to 23.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """A bit is 1 if set in over half of the shingles' hashes, repeats included; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and the six white-space characters of ASCII alone
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        return digest(b" ".join(words), seed)
    grams = map(b" ".join, zip(*[words[i:] for i in range(size)]))
    hashes = np.fromiter((digest(g, seed) for g in grams), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)].astype("<u8")).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """syndromes of single bits; for each of 2,048 syndromes the error patterns of weight 4 or less (-1: none)."""
    generator = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
    single = np.zeros(23, np.int64)
    for bit in range(23):
        r = 1 << bit
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= generator << (k - 11)
        single[bit] = r
    table_ = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = int(np.bitwise_xor.reduce(single[list(bits)])) if bits else 0
            table_[s, used[s]] = sum(1 << b for b in bits)
            used[s] += 1
    return single, table_


def segment_keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices of 23-bit words; -1 where a word has fewer."""
    single, errors = golay_tables()
    s = np.zeros(len(words), np.int64)
    for bit in range(23):
        s ^= np.where(words >> bit & 1, single[bit], 0)
    e = errors[s]
    return np.where(e < 0, -1, (words[:, None] ^ e) >> 11)  # the upper 12 bits of a systematic codeword tell it


def join_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all pairs of segments."""
    segs = [segment_keys((fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    rows, keys = [], []
    for which, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        both = (segs[i][:, :, None] << 12 | segs[j][:, None, :]) | which << 24
        good = (segs[i][:, :, None] >= 0) & (segs[j][:, None, :] >= 0)
        r, a, b = np.nonzero(good)
        rows.append(r)
        keys.append(both[r, a, b])
    return np.concatenate(rows), np.concatenate(keys)


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links fingerprints at distance <= radius. Each fingerprint is
    compared with those not yet reached: linear in a dense group."""
    edges: list[tuple[int, int]] = []
    rest = np.arange(len(fps))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= radius
            if near.any():
                reached = rest[near]
                edges += [(at, int(x)) for x in reached]
                queue += reached.tolist()
                rest = rest[~near]
    return edges


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key: the links within each key. Only one key's fingerprints (8 bytes each) are held."""
    held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

    def run(keys: np.ndarray, fps: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        edges = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(keys)]))
        size = ends - starts
        for n in (2, 3, 4):  # most keys hold few: all of one size at a time
            at = starts[size == n]
            for i in range(n):
                for j in range(i + 1, n):
                    near = np.bitwise_count(fps[at + i] ^ fps[at + j]) <= radius
                    out.append(np.stack((fps[at + i][near], fps[at + j][near])))
        for a, b in zip(starts[size > 4], ends[size > 4]):
            group = np.unique(fps[a:b])
            if pairs := forest(group, radius):
                p = np.array(pairs)
                out.append(np.stack((group[p[:, 0]], group[p[:, 1]])))
        return out

    def batch(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if parts:
            both = np.unique(np.concatenate(parts, axis=1), axis=1).view(np.int64)
            if both.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    for rb in batches:
        held_k = np.concatenate((held_k, rb.column(0).to_numpy(zero_copy_only=False)))
        held_f = np.concatenate((held_f, rb.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        if len(held_k) and held_k[0] != held_k[-1]:
            cut = int(np.searchsorted(held_k, held_k[-1]))
            yield from batch(run(held_k[:cut], held_f[:cut]))
            held_k, held_f = held_k[cut:], held_f[cut:]
    if len(held_k):
        yield from batch(run(held_k, held_f))


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (signed) of each row. Computed in one narrow stage; texts are not shuffled."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            fps = [signed(fingerprint(x.as_py(), size, seed)) for x in rb.column(1)]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(compute, "doc_id long, fp long")


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints: enough of them that the components are those of all links."""
    if radius > 5:
        raise ValueError("the keys find all links up to 5 differing bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            all_fps = rb.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fps), 4096):
                part = all_fps[at : at + 4096]
                rows, keys = join_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows].view(np.int64))], ["k", "fp"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _links(batches, radius)

    keys = fps.select("fp").distinct().mapInArrow(keyed, "k long, fp long")
    # Sorted within its partition, a key's rows pass by in a run; a key has few of the distinct fingerprints.
    return keys.repartition("k").sortWithinPartitions("k").mapInArrow(linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id that links reach, the document's own included) of each row.

    Texts without words have fingerprint zero and are linked like any other, as are null texts. Exact copies meet in
    their fingerprint and are never paired. Repeated rows give repeated rows. Rows with a null id take part and get a
    component like others; an empty table gives an empty result. Other columns are not read.
    """
    own = table(fingerprints(docs, size, seed, id_col, text_col), "fingerprints")
    found = table(links(own, radius), "fingerprint-links")
    return _labelled(own, found)


def _labelled(own: DataFrame, found: DataFrame) -> DataFrame:
    nodes = components(found)  # fp, root: only fingerprints that have a link
    least = own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    rooted = table(least.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "fingerprint-roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(smallest, "root").select("fp", "component_id")
    hot = table(hot_keys(rooted, ["fp"], weight=F.col("n")), "hot-fingerprints")
    return lookup(own, by_fp, ["fp"], hot)
