"""Line dedup by levelled sorted runs of line hashes (native: DataFrame functions only).

Lines are hashed once, into a table of documents with the hashes of their lines. A run is a bucketed table of (h1, h2,
n_docs): two 64-bit hashes of a line's key and the number of documents that hold it, sorted within each bucket. Each
batch of documents becomes a run at level 0: keys that an older run already proves frequent are removed from it by merge
anti joins of equal buckets, which need no shuffle; the rest is counted and added. When a level holds `fan_out` runs, they
are compacted, bucket by bucket, into one run of the next level, so a key is rewritten at most log(batches) times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, table, work_path, written

#: Characters stripped from a line before it is compared.
STRIPPED = " \t\n\x0b\f\r"
KEY = ["h1", "h2"]


#: One hash per line in memory while a text is split, so a bucket of this many keys sorts in well under a GB.
BUCKET_KEYS = 16 << 20


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case; other letters stay as they are."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    trimmed = F.trim(line, F.lit(STRIPPED))
    # lower() is the faster of the two, and the same on ASCII.
    return F.when(F.octet_length(trimmed) == F.length(trimmed), F.lower(trimmed)).otherwise(F.translate(trimmed, upper, lower))


def text_key(text_col: str) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def split_lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """One row per line whose key has at least min_chars code points: _id, _text, pos, h1, h2."""
    split = docs.select(F.col(id_col).alias("_id"), text_key(text_col).alias("_text"), F.posexplode(split_lines(text_col)).alias("pos", "line"))
    # A key is as long as its stripped line; a filter on the key itself would compute it twice.
    split = split.where(F.length(F.trim("line", F.lit(STRIPPED))) >= min_chars)
    keyed = split.select("_id", "_text", "pos", line_key(F.col("line")).alias("k"))
    return keyed.select("_id", "_text", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("second"), "k").alias("h2"))


class LineRuns:
    """The levelled runs of one corpus. Keys found in at least min_docs documents are frequent."""

    def __init__(self, spark: SparkSession, min_docs: int, fan_out: int = 3, buckets: int = 8):
        self.spark, self.min_docs, self.fan_out, self.buckets = spark, min_docs, fan_out, buckets
        self.levels: list[list[DataFrame]] = []

    def _write(self, counts: DataFrame) -> DataFrame:
        path = work_path(self.spark, "line-run")
        written(counts, path, (self.buckets, KEY))
        run = self.spark.table(path.rpartition("/")[2].replace("-", "_"))
        run._work = path
        return run

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.buckets, *KEY)

    def add(self, lines: DataFrame) -> None:
        """Add a batch of lines (_id, h1, h2). A document must lie in one batch."""
        # One document counts once for a key; the key with the document's id spreads a hot line over all partitions.
        counts = lines.select("_id", *KEY).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        counts = self._dealt(counts).groupBy(*KEY).agg(F.sum("n").alias("n_docs"))
        for run in (r for level in self.levels for r in level):
            counts = counts.join(run.where(F.col("n_docs") >= self.min_docs).select(*KEY).hint("merge"), KEY, "left_anti")
        self._push(0, self._write(counts))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_out:
            old, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._write(self._merged(old)))
            self._drop(old)

    def _drop(self, runs: list[DataFrame]) -> None:
        for r in runs:
            self.spark.sql(f"DROP TABLE {r._work.rpartition('/')[2].replace('-', '_')}")
        drop(*runs)

    def close(self) -> None:
        """Delete the runs, once what was asked of them is written."""
        self._drop([r for level in self.levels for r in level])
        self.levels = []

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """Counts of several runs: merge joins of equal buckets, so nothing is dealt anew."""
        out = runs[0]
        for run in runs[1:]:
            other = run.withColumnRenamed("n_docs", "m")
            out = out.join(other.hint("merge"), KEY, "full").select(*KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n_docs"))
        return out

    def counts(self) -> DataFrame:
        """All keys with their counts; a frequent key's count is a lower bound that is at least min_docs."""
        return self._merged([r for level in self.levels for r in level])

    def frequent(self) -> DataFrame:
        return self.counts().where(F.col("n_docs") >= self.min_docs)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, n_batches: int = 6, fan_out: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every input column, with the text's frequent lines removed and n_lines, n_dropped added.

    A line is frequent if its key has at least min_chars code points and is found in at least min_docs documents.
    Null and empty texts are one empty line, which is never frequent for min_chars >= 1. A document of which nothing is
    left keeps an empty text. Rows whose id repeats count as one document; a null id is a document of its own value.
    Input columns named n_lines or n_dropped are replaced. Documents come in n_batches batches by a hash of their id.
    """
    batch = F.pmod(F.xxhash64(F.lit("batch"), "_id"), F.lit(n_batches)).cast("int")
    lines = table(lines_of(docs, id_col, text_col, min_chars).withColumn("_batch", batch), "line-hashes")
    runs = LineRuns(docs.sparkSession, min_docs, fan_out, max(8, -(-lines.count() // BUCKET_KEYS)))
    for i in range(n_batches):
        runs.add(lines.where(F.col("_batch") == i))
    frequent = table(runs.frequent(), "frequent-lines")
    runs.close()
    # Lines in at least 1/200 of all documents are few by counting: a document of m lines holds m of them at most, so
    # the bound is 200 times the mean number of lines. They are broadcast; the rest is merge-joined.
    n_docs = docs.agg(F.count(F.lit(1)).alias("all"))
    hot = table(frequent.join(F.broadcast(n_docs), F.col("n_docs") * 200 >= F.col("all")).select(*KEY), "hot-lines")
    marked = lines.drop("_batch").join(F.broadcast(hot.withColumn("hot", F.lit(True))), KEY, "left")
    rare = frequent.join(F.broadcast(hot), KEY, "left_anti").select(*KEY)
    found = marked.where("hot").select("_id", "_text", "pos").unionByName(
        marked.where("hot is null").join(rare.hint("merge"), KEY, "left_semi").select("_id", "_text", "pos"))
    gone = found.groupBy("_id", "_text").agg(F.collect_set("pos").alias("__gone")).select(F.col("_id").alias("__id"), F.col("_text").alias("__text"), "__gone")
    split = split_lines(text_col)
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (text_key(text_col) == F.col("__text")), "left").drop("__id", "__text")
    kept = F.when(F.col("__gone").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(_kept(split, F.col("__gone")), "\n"))
    return (
        joined.withColumn("n_lines", F.size(split).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
        .withColumn(text_col, kept)
        .drop("__gone")
    )


def _kept(lines: Column, gone: Column) -> Column:
    """The lines at positions outside `gone`. array_except hashes, so this is linear in the document's lines; both arrays
    are bound once through the outer transform, as a lambda would evaluate them again for each element."""
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    bound = F.transform(F.array(F.struct(lines.alias("l"), keep.alias("k"))), lambda s: F.transform(s["k"], lambda i: s["l"][i]))
    return bound[0]
