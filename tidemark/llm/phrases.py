"""Phrase collocation mining by suffix counting.

Every word starts a suffix of its piece, cut after `max_n` words. A task adds up equal suffixes of all it reads, and
writes one row a suffix unless they outgrow its memory. Suffixes are shuffled by language and first word, sorted in reverse
lexicographic order, and one stack counts all their prefixes in one pass: a prefix is complete when the next suffix no longer
has it. Parts of phrases are joined to their counts afterwards.

A phrase is no more frequent than what it begins with, so a suffix ends where it would become rare for certain. What is
rare is told by a first pass that adds the counts of all phrases of 1 to max_n words in `2**SLOT_BITS` slots by hash,
saturated at the threshold: a slot's total is never below the count of anything in it. The slots of all frequent ones make a
bitmap of `2**SLOT_BITS / 8` bytes, whatever the corpus, which is broadcast. A corpus that fills it gets longer suffixes, not
other results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, drop, hot_keys, lookup, table

SLOT_BITS = 26
#: Slots that one row of counts, and of the bitmap, stands for.
RANGE = 1 << 16
#: Bytes of text tokenised at once, and words whose suffixes are counted at once.
CHUNK, HELD = 2 << 20, 1 << 18
#: Bytes of counted suffixes that a task holds before it writes them out, and words that a task reads on average at most.
SUMS, READ = 40 << 20, 32_000_000
#: Rows of one first word that are hot are dealt over so many parts by their second and third word.
PARTS = 64
#: Ends a piece; no byte of UTF-8.
END = b"\xff"
_PIECE_END = re.compile("[.,;:!?\n-\r]")
_TABLE = bytes(0xFF if i in b".,;:!?\n\x0b\x0c\r" else 0x20 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))


def tokens(texts: list[str]) -> list[bytes]:
    """Words of the texts, A-Z in lower case, with END after each piece that something follows and after each text."""
    joined = "\n".join(texts).encode() + b"\n"
    return joined.translate(_TABLE).replace(END, b" \xff ").split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class _Words:
    """Ids of a task's words, in the order they are met; id 0 is END."""

    def __init__(self, seed: int):
        self.ids: dict[bytes, int] = {END: 0}
        self.hashes = [0]
        self.seed = seed

    def of(self, words: list[bytes]) -> np.ndarray:
        coded = pa.array(words, pa.binary()).dictionary_encode()
        own = np.empty(len(coded.dictionary), np.int64)
        for i, w in enumerate(coded.dictionary.to_pylist()):
            at = self.ids.get(w)
            if at is None:
                at = self.ids[w] = len(self.hashes)
                self.hashes.append(xxhash.xxh64_intdigest(w, self.seed))
            own[i] = at
        return own[coded.indices.to_numpy(zero_copy_only=False)]

    def slots(self, ids: np.ndarray, max_n: int) -> Iterator[np.ndarray]:
        """Slots of the phrases of 1, 2, ... max_n words that begin at each place that has as many words behind it."""
        h = np.array(self.hashes, np.uint64)[ids]
        code = _mixed(h * np.uint64(0xD6E8FEB86659FD93))
        for n in range(1, min(max_n, len(ids)) + 1):
            if n > 1:
                code = _mixed(code[:-1] * np.uint64(0xA0761D6478BD642F) + h[n - 1 :])
            yield (code >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang.encode())


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """Texts of a language, about CHUNK characters at a time; longer ones in parts that end with a piece."""
    for rb in batches:
        held: dict[str, list] = {}
        size: Counter = Counter()
        for lang, value in zip(rb.column(0).to_pylist(), rb.column(1)):
            text, at = value.as_py() or "", 0
            while at < len(text):
                end = _PIECE_END.search(text, at + CHUNK)
                to = end.end() if end else len(text)
                held.setdefault(lang, []).append(text[at:to])
                size[lang] += to - at
                at = to
                if size[lang] >= CHUNK:
                    yield lang, held.pop(lang)
                    size[lang] = 0
        yield from held.items()


def _counts(least: int, max_n: int):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of slots, and of words: all of a language, and each that is hot in this task."""
        slots = np.zeros(1 << SLOT_BITS, np.uint8)
        total: Counter = Counter()
        often: Counter = Counter()
        for lang, texts in _by_lang(batches):
            words = _Words(_seed(lang))
            ids = words.of(tokens(texts))
            real = ids > 0
            total[lang] += int(real.sum())
            for word, n in zip(words.ids, np.bincount(ids).tolist()):
                often[lang, word] += n if word != END else 0
            whole = real
            for k, at in enumerate(words.slots(ids, max_n)):
                whole = whole if k == 0 else whole[:-1] & real[k:]
                found, n = np.unique(at[whole], return_counts=True)
                slots[found] = np.minimum(slots[found] + n, least)
        names = ["at", "offsets", "counts", "lang", "word", "words"]
        one = lambda x, t: pa.array([x], t)
        for at in range(0, 1 << SLOT_BITS, RANGE):
            part = slots[at : at + RANGE]
            if len(nz := np.flatnonzero(part)):
                yield pa.RecordBatch.from_arrays([one(at // RANGE, pa.int32()), one(nz.astype(np.uint16).tobytes(), pa.binary()), one(part[nz].tobytes(), pa.binary()), one(None, pa.string()), one(None, pa.string()), one(None, pa.int64())], names)
        rows = [(lang, None, n) for lang, n in total.items()]
        rows += [(lang, word.decode(), n) for (lang, word), n in often.items() if n * 2 >= total.total() * HOT_SHARE and n]
        none = pa.nulls(len(rows), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int32()), none, none, *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64())))], names)

    return compute


def _bits(least: int):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the counts of each range and gives its bits; rows come sorted by range."""
        now, sums = None, np.zeros(RANGE, np.int64)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], ["at", "bits"])

        for rb in batches:
            for at, offsets, counts in zip(*(rb.column(i).to_pylist() for i in range(3))):
                if at != now:
                    if now is not None:
                        yield row()
                    now, sums = at, np.zeros(RANGE, np.int64)
                sums[np.frombuffer(offsets, np.uint16)] += np.frombuffer(counts, np.uint8)
        if now is not None:
            yield row()

    return compute


def _summed(tables: list[pa.Table]) -> pa.Table:
    """(suffix, n) with one row a suffix."""
    sums = pa.concat_tables(tables).group_by("suffix", use_threads=False).aggregate([("n", "sum")])
    pa.default_memory_pool().release_unused()
    return pa.table([sums["suffix"], sums["n_sum"]], ["suffix", "n"])


def _suffixes(bitmap, max_n: int):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        test = lambda s: (bits[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
        words: dict[str, _Words] = {}
        held: dict[str, list[np.ndarray]] = {}
        sums: dict[str, list[pa.Table]] = {}
        size = 0

        def count(lang: str) -> None:
            ids, own = np.concatenate(held.pop(lang)), words.pop(lang)
            length = np.zeros(len(ids), np.int64)
            on = real = ids > 0
            for k, at in enumerate(own.slots(ids, max_n)):
                on = (on if k == 0 else on[:-1] & real[k:]) & test(at)
                length[: len(on)] += on
            names = list(own.ids)
            spaced = pa.array([w + b" " for w in names], pa.binary())
            for n in range(1, max_n + 1):
                at = np.flatnonzero(length == n)
                code = ids[at]
                columns = [ids[at + k] for k in range(n)]
                for c in columns[1:]:
                    # Codes stay dense, so two of them always fit into 64 bits.
                    code = np.unique(code * len(names) + c, return_inverse=True)[1]
                _, first, times = np.unique(code, return_index=True, return_counts=True)
                if len(first):
                    parts = [spaced.take(pa.array(c[first])) for c in columns]
                    suffix = pc.binary_join_element_wise(*parts, b"") if n > 1 else parts[0]
                    sums.setdefault(lang, []).append(pa.table([suffix, pa.array(times.astype(np.int64))], ["suffix", "n"]))

        def full() -> bool:
            return sum(t.nbytes for ts in sums.values() for t in ts) >= SUMS

        def written() -> Iterator[pa.RecordBatch]:
            for lang in list(sums):
                for rb in _summed(sums.pop(lang)).to_batches(max_chunksize=50_000):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rb), pa.string()), rb.column(0).cast(pa.string()), rb.column(1)], ["lang", "suffix", "n"])

        for lang, texts in _by_lang(batches):
            own = words.setdefault(lang, _Words(_seed(lang)))
            held.setdefault(lang, []).append(own.of(tokens(texts)))
            size += len(held[lang][-1])
            if size >= HELD:
                for lang in list(held):
                    count(lang)
                size = 0
                if full():
                    for lang, ts in sums.items():
                        sums[lang] = [_summed(ts)]
                    # Sums that leave little room would be added up again for little.
                    if sum(ts[0].nbytes for ts in sums.values()) > SUMS * 3 // 4:
                        yield from written()
        for lang in list(held):
            count(lang)
        yield from written()

    return compute


def suffix_rows(rows: DataFrame, bitmap, max_n: int, words: int) -> DataFrame:
    """(lang, suffix, n) of (lang, text) rows with so many words, from as few tasks as keep every core at work and read READ
    words each on average at most: each task writes its own row of a suffix, so rows grow with tasks times suffixes."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-words // READ))
    return rows.coalesce(tasks).mapInArrow(_suffixes(bitmap, max_n), "lang string, suffix string, n long")


def _stacked(least: int):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of all prefixes of sorted suffixes (lang, split, suffix, n). The stack holds a phrase's words and the counts
        of its prefixes so far; a popped count goes to the prefix below. The shorter prefixes of a split first word are not
        complete here, so they are given whatever their count."""
        stack: list[str] = []
        counts: list[int] = []
        key: tuple | None = None
        out: tuple[list, list, list] = ([], [], [])

        def pop(to: int) -> None:
            while len(stack) > to:
                n = counts.pop()
                if n >= least or (key[1] and len(stack) <= 2):
                    out[0].append(key[0])
                    out[1].append(" ".join(stack))
                    out[2].append(n)
                stack.pop()
                if counts:
                    counts[-1] += n

        def rows() -> pa.RecordBatch:
            rb = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["lang", "phrase", "n"])
            for c in out:
                c.clear()
            return rb

        for rb in batches:
            for lang, split, suffix, n in zip(*(rb.column(i).to_pylist() for i in range(4))):
                words = suffix[:-1].split(" ")
                if (lang, split) != key:
                    pop(0)
                    key = (lang, split)
                same = 0
                for a, b in zip(stack, words):
                    if a != b:
                        break
                    same += 1
                pop(same)
                for w in words[same:]:
                    stack.append(w)
                    counts.append(0)
                counts[-1] += n
            if out[0]:
                yield rows()
        pop(0)
        if out[0]:
            yield rows()

    return compute


def phrase_counts(docs: DataFrame, least: int = 30, max_n: int = 4, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 1 to max_n words found at least `least` times, and (lang, words) with the number
    of words of each language. `least` must be below 256."""
    if not 1 <= least < 256:
        raise ValueError("least must be from 1 to 255, as counts of slots are bytes")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    slots = table(rows.mapInArrow(_counts(least, max_n), "at int, offsets binary, counts binary, lang string, word string, words long"), "slots")
    sizes = table(slots.where("at is null and word is null").groupBy("lang").agg(F.sum("words").alias("words")), "lang-words")
    # A word that starts HOT_SHARE of all suffixes has half that share at least in tasks where it is hot; 2 / HOT_SHARE can.
    total = sizes.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    heavy = slots.where("word is not null").groupBy("lang", "word").agg(F.sum("words").alias("n")).where(F.col("n") >= max(1000, total * HOT_SHARE / 2))
    hot = [f"{r['word']} {r['lang']}" for r in heavy.collect()]
    ranges = slots.where("at is not null").select("at", "offsets", "counts").repartition("at").sortWithinPartitions("at")
    bits = np.zeros((1 << SLOT_BITS) // RANGE * (RANGE // 8), np.uint8)
    frequent = table(ranges.mapInArrow(_bits(least), "at int, bits binary"), "slot-bits")
    drop(slots)
    for r in frequent.toLocalIterator():  # 2**SLOT_BITS / RANGE rows of RANGE / 8 bytes
        bits[r["at"] * (RANGE // 8) : (r["at"] + 1) * (RANGE // 8)] = np.frombuffer(r["bits"], np.uint8)
    bitmap = spark.sparkContext.broadcast(bits.tobytes())
    suffixes = suffix_rows(rows, bitmap, max_n, total).withColumn("first", F.substring_index("suffix", " ", 1))
    dealt = suffixes.withColumn("split", F.concat("first", F.lit(" "), "lang").isin(hot) if hot else F.lit(False))
    part = F.when(F.col("split"), F.pmod(F.xxhash64(F.substring_index("suffix", " ", 3)), F.lit(PARTS))).otherwise(0)
    dealt = dealt.withColumn("part", part).repartition("lang", "first", "part")
    # A split first word may meet others of its partition, so split comes before the suffix.
    ordered = dealt.sortWithinPartitions("lang", "split", "part", F.desc("suffix")).select("lang", "split", "suffix", "n")
    prefixes = ordered.mapInArrow(_stacked(least), "lang string, phrase string, n long")
    counts = prefixes.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    out = table(counts, "phrases"), sizes
    drop(frequent)
    return out


def _words(phrase: str) -> Column:
    return F.split(phrase, " ")


def collocations(docs: DataFrame, least: int = 30, max_n: int = 4, top: int = 2000, scale: int = 2_000_000, percent: int = 80, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to max_n words found at least `least` times.

    Words are what white space parts, with A-Z in lower case; phrases don't cross `[.,;:!?]` or line ends. A phrase is cut
    in two where floor(scale * a / (l + r)) is least, at the first such place; l and r are the counts of its parts. Phrases
    that lie in a longer one with at least `percent` % of their count are dropped. A null lang is `und`; null and empty texts
    have no words; repeated rows count as often as they come; other columns play no part. No rows give no rows.
    """
    phrases, sizes = phrase_counts(docs, least, max_n, lang_col, text_col)
    longer = phrases.where(F.col("phrase").contains(" ")).select("lang", "phrase", F.col("f").alias("a"))
    size = F.size(_words("phrase"))
    join = lambda a, b: F.array_join(F.slice(_words("phrase"), a, b), " ")
    cut = longer.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cut = cut.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, size - F.col("k")).alias("right"))
    for side, c in (("left", "l"), ("right", "r")):
        keys = ["lang", side]
        hot = table(hot_keys(cut, keys), "hot-parts")
        cut = lookup(cut, phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(c)), keys, hot, "inner")
    whole = lambda c: F.col(c).cast("decimal(28,0)")
    score = F.expr(f"(cast(a as decimal(28,0)) * {scale}) div (cast(l as decimal(28,0)) + cast(r as decimal(28,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # Counts of what a phrase lies in: the greatest of all longer ones.
    inside = longer.where(size > 2).withColumn("m", F.explode(F.sequence(F.lit(2), size - 1)))
    inside = inside.withColumn("s", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)))
    held = inside.select("lang", join(F.col("s"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("in"))
    free = best.join(held, ["lang", "phrase"], "left").where(F.col("in").isNull() | (whole("in") * 100 < whole("a") * percent))
    place = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= top)
    out = ranked.join(sizes, "lang")
    return out.select("lang", "rank", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("words").alias("n"), F.col("b.score").alias("score"))
