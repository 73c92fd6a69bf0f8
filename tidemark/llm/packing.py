"""Packing of tokenised documents into training sequences by first-fit decreasing with a tournament tree.

A document's ids are cut at multiples of the sequence length; full pieces are sequences of their own. The rests of a
randomised group of documents are packed longest first, each into the first bin with room, found by descending a
tournament tree that holds the greatest free capacity below each node. The few bins that stay partly filled keep their
pieces; the emptiest give theirs, cut where need be, to fill the others, so at most one sequence of a group has padding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: How byte-level BPE cuts a text; the same pattern as in the vocabulary's tokenizers file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = "<|endoftext|>"


class ByteBPE:
    """Byte-level BPE, ids as the tokenizers library gives them without special tokens added: the end-of-text string in
    a text is its special id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={END: len(ranks)})

    def encode(self, text: str) -> np.ndarray:
        return self.model.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


_LOADED: dict[str, ByteBPE] = {}


def encoder(path: str) -> ByteBPE:
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


class Tournament:
    """Bins by number; a node holds the greatest free capacity of the bins below it."""

    def __init__(self, n: int, capacity: int):
        self.width = 1 << max(0, n - 1).bit_length()
        self.best = [capacity] * (2 * self.width)

    def first(self, need: int) -> int:
        """The lowest bin with at least `need` free."""
        node = 1
        while node < self.width:
            node *= 2
            if self.best[node] < need:
                node += 1
        return node - self.width

    def take(self, bin_: int, amount: int) -> None:
        best, node = self.best, bin_ + self.width
        best[node] -= amount
        node //= 2
        while node:
            best[node] = max(best[2 * node], best[2 * node + 1])
            node //= 2


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; items are taken longest first, equal ones in the given order."""
    tree, bins = Tournament(max(1, len(sizes)), capacity), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        bins[i] = at = tree.first(size)
        tree.take(at, size)
    return bins


def pack_group(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start within its rest, length, bin, offset) of each piece of the rests of one group."""
    sizes = np.array(lengths, np.int64)
    bins = first_fit_decreasing(sizes, capacity)
    fill = np.bincount(bins, weights=sizes, minlength=1).astype(np.int64)
    held: list[list[tuple[int, int, int]]] = [[] for _ in fill]
    for i, b in enumerate(bins.tolist()):
        held[b].append((i, 0, int(sizes[i])))
    partly = sorted(np.flatnonzero((fill > 0) & (fill < capacity)).tolist(), key=lambda b: (-fill[b], b))
    full, giver = 0, len(partly) - 1
    while full < giver:  # the fullest are filled up from the emptiest
        to, from_ = held[partly[full]], held[partly[giver]]
        gap = capacity - sum(n for _, _, n in to)
        i, start, n = from_.pop()
        moved = min(gap, n)
        to.append((i, start, moved))
        if moved < n:
            from_.append((i, start + moved, n - moved))
        full, giver = full + (moved == gap), giver - (not from_)
    out = []
    for b, pieces in enumerate(held):
        at = 0
        for i, start, n in pieces:
            out.append((i, start, n, b, at))
            at += n
    return out


def pack(docs: DataFrame, ranks: str, capacity: int = 1024, end_id: int = 0, group_docs: int = 4096, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids followed by end_id, so null and empty texts have one id. Each id lies in one piece; sequences
    are full but for at most one per group of about group_docs documents. Groups come from a seeded hash of id, text and
    the row's number in a table of ids written before, so a task that is run again packs alike, and rows that repeat are
    spread over the groups. `ranks` is a tiktoken file at the same place on every executor. Repeated rows are packed as
    often as they come; a null id is kept. Long texts cost no more memory
    than their own ids: only a document's rest, less than `capacity` ids, is shuffled. Other columns are not read.
    """
    if capacity < 1 or capacity > 1 << 20:
        raise ValueError("capacity must lie between 1 and 2**20")

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = encoder(ranks), np.array([end_id], "<u4").tobytes()
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                rb = big.slice(at, 1000)
                tokens, crcs, rests = [], [], []
                for text in rb.column(1):
                    raw = memoryview(bpe.encode(text.as_py() or "").tobytes() + end)
                    full = len(raw) // (4 * capacity) * 4 * capacity
                    tokens.append(len(raw) // 4)
                    crcs.append([zlib.crc32(raw[i : i + 4 * capacity]) for i in range(0, full, 4 * capacity)])
                    rests.append(bytes(raw[full:]))
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.binary()), rb.column(2)], ["doc_id", "doc_tokens", "crcs", "rest", "h"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col), F.xxhash64(F.lit(seed), id_col, text_col).alias("h"))
    ids = read.mapInArrow(tokenised, "doc_id long, doc_tokens long, crcs array<long>, rest binary, h long")
    ids = table(ids.withColumn("h", F.xxhash64("h", F.monotonically_increasing_id())), "packing-ids")
    n_groups = max(1, round((ids.count()) / group_docs))
    grouped = ids.withColumn("g", F.pmod("h", F.lit(n_groups)))

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "doc_tokens"], kind="stable").reset_index(drop=True)
        docs_, totals, rests, crcs = pdf["doc_id"].to_numpy(), pdf["doc_tokens"].to_numpy(), pdf["rest"].tolist(), pdf["crcs"].tolist()
        rows, n_seq = [], 0
        for d, total, crc in zip(docs_, totals, crcs):
            for k, c in enumerate(crc):
                rows.append((d, k * capacity, capacity, int(c), total, n_seq, 0))
                n_seq += 1
        some = [i for i, r in enumerate(rests) if len(r)]
        for i, start, n, b, offset in pack_group([len(rests[i]) // 4 for i in some], capacity):
            i = some[i]
            before = len(crcs[i]) * capacity
            rows.append((docs_[i], before + start, n, zlib.crc32(rests[i][4 * start : 4 * (start + n)]), totals[i], n_seq + b, offset))
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        # Sequences are numbered within their group; the group's number stands above them.
        out["sequence_id"] = int(key[0]) * (1 << 32) + out["sequence_id"].rank(method="dense").astype("int64") - 1
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return grouped.groupBy("g").applyInPandas(packed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
