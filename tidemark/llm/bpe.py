"""BPE encoding and decoding with contiguous rank arrays.

A word's parts lie side by side in one row of an array, with the rank of each adjacent pair in a second array. The least
rank is searched by a scan, the boundary there is deleted (both rows close up), and the ranks of the two neighbouring
pairs are looked up again, until no pair has a rank. Words of one length form a block, so each scan, deletion and look-up
is one array operation over thousands of words. Texts are split at white space into chunks; the pieces of a chunk do not
depend on its surroundings, so a bounded memory of chunks spares most of the work. Scans cost the square of a word's length:
words of more than LONG bytes keep their parts in a linked row and their pairs in a heap, which gives the same ids.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int64(1 << 40)
#: White_Space of Unicode, as the tokenizers library takes it; Python's str.split() also splits at \x1c-\x1f.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
ODD = regex.compile("[\x1c-\x1f]")
SPLIT = regex.compile(f"[{SPACE}]+")
#: Bytes of a word from which pairs go to a heap.
LONG = 512
#: Marks a special token among the pieces; as white space it can start no other piece.
SPECIAL = "\n"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBPE:
    """Encoder for a lower-casing BPE vocabulary with word ends. `limit` bounds the chunks that are remembered."""

    def __init__(self, model: dict, limit: int = 200_000):
        vocab: dict[str, int] = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        suffix = model["model"]["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.last = np.array([vocab[c + suffix] for c in symbols], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        pairs = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.table: dict[int, int] | None = None  # ranks by pair, made when a long word comes
        self.limit = limit
        self.numbers = list(map(str, range(len(self.names))))
        self.known: dict[str, tuple[str, str, int]] = {}
        self.old: dict[str, tuple[str, str, int]] = {}
        self.parts: dict[str, tuple[str, str, int]] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def block(self, words: np.ndarray) -> np.ndarray:
        """ids of words of one length, given as (n, length) bytes; -1 fills the ends of rows."""
        n, width = words.shape
        parts = self.inner[words]
        parts[:, -1] = self.last[words[:, -1]]
        done = np.full((n, width), -1, np.int64)
        rows = np.arange(n)
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        while width > 1 and len(rows):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            live = least < NONE
            if not live.all():
                done[rows[~live], :width] = parts[~live]
                rows, parts, ranks, at, least = rows[live], parts[live], ranks[live], at[live], least[live]
                if not len(rows):
                    return done
            k = np.arange(len(rows))
            parts[k, at] = self.merged[least]
            # Delete the boundary after `at`: what stands to its right moves up by one.
            move = np.arange(width - 1)[None, :]
            parts = np.take_along_axis(parts, move + (move > at[:, None]), axis=1)
            move = move[:, : width - 2]
            ranks = np.take_along_axis(ranks, move + (move >= at[:, None]), axis=1)
            width -= 1
            if width > 1:
                left = np.maximum(at - 1, 0)
                ranks[k, left] = np.where(at > 0, self.rank(parts[k, left], parts[k, np.minimum(left + 1, width - 1)]), ranks[k, left])
                here = np.minimum(at, width - 2)
                ranks[k, here] = np.where(at < width - 1, self.rank(parts[k, here], parts[k, here + 1]), ranks[k, here])
        if len(rows):
            done[rows, : parts.shape[1]] = parts
        return done

    def long(self, raw: bytes) -> list[int]:
        """ids of one word of any length in n log n: the least rank, and of equal ranks the leftmost, is merged first."""
        if self.table is None:
            self.table = dict(zip(self.pairs.tolist(), self.ranks.tolist()))
        parts = self.inner[np.frombuffer(raw, np.uint8)].tolist()
        parts[-1] = int(self.last[raw[-1]])
        rank, merged, n = self.table.get, self.merged, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two was merged meanwhile
            parts[i], parts[j] = int(merged[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := rank(parts[i] << 20 | parts[k])) is not None:
                    heapq.heappush(heap, (x, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (x := rank(parts[h] << 20 | parts[i])) is not None:
                heapq.heappush(heap, (x, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def words(self, words: list[str]) -> dict[str, list[int]]:
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        out: dict[str, list[int]] = {}
        for w in words:
            raw = w.encode()
            if len(raw) > LONG:
                out[w] = self.long(raw)
            else:
                by_length.setdefault(len(raw), []).append((w, raw))
        for length, group in by_length.items():
            step = max(1, 200_000 // length)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                ids = self.block(np.frombuffer(b"".join(r for _, r in part), np.uint8).reshape(len(part), length))
                for (w, _), row, n in zip(part, ids.tolist(), (ids >= 0).sum(axis=1).tolist()):
                    out[w] = row[:n]
        return out

    @staticmethod
    def normal(chunk: str) -> str:
        """Composed, and lower case letter by letter: str.lower() alone would write a final sigma."""
        if chunk.isascii():
            return chunk.lower()
        chunk = unicodedata.normalize("NFC", chunk)
        return "".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower()

    def pieces(self, chunk: str) -> list[str]:
        """The chunk's pieces; special tokens are found first, as they stand."""
        if "<|" not in chunk or not self.cut:
            return PIECE.findall(self.normal(chunk))
        out, at = [], 0
        for m in self.cut.finditer(chunk):
            out += [*PIECE.findall(self.normal(chunk[at : m.start()])), SPECIAL + m.group()]
            at = m.end()
        return out + PIECE.findall(self.normal(chunk[at:]))

    def learn(self, chunks: set[str]) -> None:
        plan = [(c, self.pieces(c)) for c in chunks]
        new = {p for _, ps in plan for p in ps}.difference(self.parts)
        if len(self.parts) + len(new) > self.limit:
            self.parts = {}
            new = {p for _, ps in plan for p in ps}
        special = {p for p in new if p[0] == SPECIAL}
        numbers, names, parts, known = self.numbers, self.names, self.parts, self.known
        for p in special:
            parts[p] = (numbers[self.special[p[1:]]], p[1:], 1)
        for p, ids in self.words(list(new - special)).items():
            parts[p] = (" ".join([numbers[i] for i in ids]), " ".join([names[i] for i in ids]), len(ids))
        for c, ps in plan:
            if len(ps) == 1:
                known[c] = parts[ps[0]]
            else:
                found = [parts[p] for p in ps]
                known[c] = (" ".join([x[0] for x in found]), " ".join([x[1] for x in found]), sum([x[2] for x in found]))

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the vocabulary file, tokens are joined by a space; unknown ids give nothing."""
        return " ".join(self.names[i] for i in ids if 0 <= i < len(self.names) and self.names[i])

    def encode_batch(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """(ids joined by a space, decoded text, number of ids) of each text."""
        split = [[c for c in SPLIT.split(t) if c] if ODD.search(t) else t.split() for t in texts]
        out: list[tuple[str, str, int]] = []
        for at in range(0, len(split), 200):
            part = split[at : at + 200]
            new = set().union(*part).difference(self.known)
            if len(self.known) + len(new) > self.limit:  # the last generation is kept to draw from
                self.known, self.old = {}, self.known
                new = set().union(*part)
            if self.old:
                for c in new & self.old.keys():
                    self.known[c] = self.old[c]
                new.difference_update(self.known)
            self.learn(new)
            get = self.known.__getitem__
            for chunks in part:
                if chunks:
                    ids, names, counts = zip(*map(get, chunks))
                    out.append((" ".join(ids), " ".join(names), sum(counts)))
                else:
                    out.append(("", "", 0))
        return out


_LOADED: dict[str, WordBPE] = {}


def encoder(path: str) -> WordBPE:
    """One per Python worker."""
    if path not in _LOADED:
        with open(path) as f:
            _LOADED[path] = WordBPE(json.load(f))
    return _LOADED[path]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """id_col, n_tokens, ids (decimal, joined by one space) and decoded of each row; with texts=False their SHA-256 in
    lower-case hex instead, so that long texts don't leave the worker.

    `vocabulary` is the path of a tokenizers file, found at the same place on every executor. Null and empty texts have
    no ids. Texts of any length are split into chunks; memory beyond the text is bounded by the remembered chunks. Rows
    are independent: repeated rows, null ids and other columns change nothing. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for big in batches:
            for at in range(0, big.num_rows, 500):
                rb = big.slice(at, 500)
                got = bpe.encode_batch([x or "" for x in rb.column(1).to_pylist()])
                a, b = [x[0] for x in got], [x[1] for x in got]
                if not texts:
                    a, b = [sha256(x.encode()).hexdigest() for x in a], [sha256(x.encode()).hexdigest() for x in b]
                yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([x[2] for x in got], pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids string, decoded string")
    names = ("ids", "decoded") if texts else ("ids_sha256", "decoded_sha256")
    return out.select(F.col("id").alias(id_col), "n_tokens", F.col("ids").alias(names[0]), F.col("decoded").alias(names[1]))
