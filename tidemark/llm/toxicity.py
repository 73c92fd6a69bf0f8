"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded: lower case, homoglyphs to plain letters, digits and symbols inside words to the letters they stand for,
everything else to one space; accented letters of their language stay. The lexicon has whole words and word beginnings,
each with a weight learnt from labelled rows: the log of the share of texts with it in label 1 over that in label 0. A hit
inside an exception phrase doesn't count; the phrases are pairs of words in which a term is found in label 0 alone. The
sum of hit weights, plain and per length, gives the score by a logistic curve fitted on the same rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Letters of other scripts that look like Latin ones, and what stands for letters inside words.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ɡ": "g", "ɑ": "a", "ƅ": "b", "ꞵ": "b",
}
SUBSTITUTES = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
_LEET = re.compile(r"[0-9@$!|+]+")
#: Lengths of word beginnings that can become part of a lexicon.
BEGINNINGS = range(4, 9)


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in HOMOGLYPHS:
            out = HOMOGLYPHS[c]
        elif unicodedata.combining(c) or unicodedata.category(c) == "Cf":
            out = ""
        else:
            plain = unicodedata.normalize("NFKC", c).lower()
            out = "".join(HOMOGLYPHS.get(x, x) for x in plain) if plain.isalnum() else " "
        self[code] = out
        return out


_FOLD = _Fold()
_SUB = str.maketrans(SUBSTITUTES)


def fold(text: str | None) -> str:
    """Folded words, each after one space, and a space at the end."""
    t = unicodedata.normalize("NFC", text or "").lower()

    def letters(m: re.Match) -> str:
        """Only next to a letter, and symbols only between two; numbers stay numbers."""
        a, b = m.span()
        left, right = a > 0 and t[a - 1].isalpha(), b < len(t) and t[b].isalpha()
        digits = m.group().isdigit()
        return m.group().translate(_SUB) if (left and right) or (digits and (left or right)) else m.group()

    if _LEET.search(t):
        t = _LEET.sub(letters, t)
    return f" {' '.join(t.translate(_FOLD).split())} "


def features(text: str | None) -> set[str]:
    """The words ("w ") and word beginnings ("w") of a text."""
    out: set[str] = set()
    for w in set(fold(text).split()):
        out.add(w + " ")
        out.update(w[:k] for k in BEGINNINGS if len(w) >= k)
    return out


@dataclass
class Lexicon:
    """terms: weight by word (with a space at its end) or word beginning; curve: bias and the slopes of the two sums."""

    terms: dict[str, float]
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = ()
    _auto: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "curve": self.curve, "exceptions": self.exceptions, "_auto": None}

    def automaton(self):
        if self._auto is None:
            auto = ahocorasick.Automaton()
            for t, w in self.terms.items():
                auto.add_word(" " + t, (len(t) + 1, w))
            for e in self.exceptions:
                auto.add_word(f" {fold(e).strip()} ", (len(fold(e)), None))
            auto.make_automaton()
            self._auto = auto
        return self._auto

    def sums(self, text: str | None) -> tuple[int, float, int]:
        """Hits outside exception phrases, the sum of their weights, and the folded length. A word counts once, by its
        heaviest term."""
        t = fold(text)
        if not self.terms:
            return 0, 0.0, len(t)
        hits: dict[int, float] = {}
        safe: list[tuple[int, int]] = []
        for end, (n, w) in self.automaton().iter(t):
            at = end - n + 1
            if w is None:
                safe.append((at, end))
            elif w > hits.get(at, 0.0):
                hits[at] = w
        for a, b in safe:
            for at in [x for x in hits if a <= x < b]:
                del hits[at]
        return len(hits), float(sum(hits.values())), len(t)

    def phrases(self, text: str | None) -> set[str]:
        """The pairs of neighbouring words of which one holds a term."""
        words = fold(text).split()
        hit = [any(w + " " == t or w.startswith(t) for t in self._terms(w)) for w in words]
        return {f"{a} {b}" for a, b, x, y in zip(words, words[1:], hit, hit[1:]) if x or y}

    def _terms(self, word: str) -> list[str]:
        return [t for t in (word + " ", *(word[:k] for k in BEGINNINGS)) if t in self.terms]

    def score(self, hits: int, weight: float, length: int) -> float:
        z = self.curve[0] + sum(s * x for s, x in zip(self.curve[1:], _inputs(weight, length)))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _inputs(weight: float, length: int) -> tuple[float, float]:
    return float(np.log1p(weight)), float(np.log1p(1000.0 * weight / max(200, length)))


#: Standard deviations below which a term's weight lies with a chance of 5 %.
SURE = 1.645


def log_ratio(docs1: int, docs0: int, n1: int, n0: int) -> float:
    """Log of the share of n1 texts over that of n0, a half and one text added."""
    return float(np.log((docs1 + 0.5) / (n1 + 1.0)) - np.log((docs0 + 1.0) / (n0 + 1.0)))


def _counted(sample: DataFrame, of) -> DataFrame:
    """f, a, b: the number of texts of label 1 and of label 0 that have the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for text, y in zip(rb.column(0), rb.column(1).to_pylist()):
                names = list(of(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([y] * len(names), pa.int32())], ["f", "y"])

    found = sample.select("text", "label").mapInArrow(run, "f string, y int")
    return found.groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))


def chosen_terms(rated: list[tuple[str, float]]) -> dict[str, float]:
    """Of terms with weights those that weigh more than their own beginnings."""
    terms: dict[str, float] = {}
    for f, w in sorted(rated, key=lambda r: (len(r[0]), r[0])):
        if all(terms.get(f[:n], 0.0) < w - 0.5 for n in BEGINNINGS if n < len(f)):
            terms[f] = round(w, 6)
    return terms


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Bias and slopes of a ridge logistic regression, by Newton steps."""
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-3] + [0.1] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, least_weight: float = 1.0, seed: int = 11, label_col: str = "label", text_col: str = "text", id_col: str = "doc_id") -> Lexicon:
    """Learn a lexicon, its exceptions and its curve from documents with a 0/1 label.

    At most max_rows labelled ids are used, those with the least seeded hash; all else is independent of size. The
    chosen labels are broadcast, so only their texts are shuffled. An id with several labels counts as 1 if one of them is
    1; of rows that repeat an id the one with the least hash of its text is used. The executors count texts by feature and
    label. A term's weight must be least_weight at least by the lower bound of its one-sided 95 % interval, and it must be found in at least 4 texts of label 1, and in 1 of 100, so terms are at most 100 times as many
    as such a text has features; they and one pair of sums for each chosen id come to the driver. Without labels of both
    kinds the lexicon is empty and the score is the share of label 1 (0.0 without rows). Null ids and labels are left out.
    """
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = one.withColumn("h", F.xxhash64(F.lit(seed), "_id")).orderBy("h", "_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    texts = texts.groupBy("_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = table(texts.select("text", "label"), "toxicity-sample").repartition(F.xxhash64("text"))

    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        share = n1 / (n1 + n0) if n1 + n0 else 0.0
        return Lexicon({}, (float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))) if n1 + n0 else -500.0, 0.0, 0.0))
    ratio = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 1.0) / (n0 + 1.0))
    found = _counted(sample, features).where((F.col("a") >= max(4, n1 // 100)) & (ratio - SURE * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 1.0)) >= least_weight)).collect()
    lexicon = Lexicon(chosen_terms([(r["f"], log_ratio(r["a"], r["b"], n1, n0)) for r in found]))
    # Phrases of label 0 alone, in enough of its texts that chance does not make them.
    safe = _counted(sample, lexicon.phrases).where((F.col("a") == 0) & (F.col("b") >= max(4, n0 // 1000)) & (ratio <= -1.0)).select("f").collect()
    lexicon = Lexicon(lexicon.terms, exceptions=tuple(sorted(r["f"] for r in safe)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            got = [lexicon.sums(x.as_py()) for x in rb.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.int64()), rb.column(1)], ["w", "n", "y"])

    data = sample.mapInArrow(sums, "w double, n long, y int").collect()
    curve = logistic(np.array([(1.0, *_inputs(r["w"], r["n"])) for r in data]), np.array([r["y"] for r in data], float))
    return Lexicon(lexicon.terms, curve, lexicon.exceptions)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1), hits and weight of each row; only id and text are read, in one narrow stage.

    Null and empty texts get the score of a text without hits. Repeated rows and null ids are scored like others; an
    empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            got = [lexicon.sums(x.as_py()) for x in rb.column(1)]
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array([lexicon.score(*g) for g in got], pa.float64()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], ["id", "score", "hits", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, score double, hits long, weight double").withColumnRenamed("id", id_col)
