"""Keyed tables in files: rows lie in buckets by a hash of their key, and a merge reads and writes only the buckets that new
rows fall into.

A version is a manifest (bucket, version that wrote it), which is written last: a merge that fails leaves the version before
as it was, and one that is run again for a version that is there does nothing, so a repeated micro-batch counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Fold = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """`keys` are the columns whose hash chooses the bucket; the fold of a merge keeps them. schema: of the rows, or its DDL."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str | StructType, buckets: int = 64):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Versions whose manifest was written whole."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return []
        names = [s.getPath() for s in fs.listStatus(hadoop)]
        return sorted(int(p.getName()) for p in names if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Bucket to the version that wrote it: at most `buckets` entries."""
        known = self.versions()
        at = max(known, default=None) if version is None else version
        if at is None or at not in known:
            return {}
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket INT, version LONG").parquet(f"{self.path}/manifest/{at}").collect()}

    def _read(self, parts: dict[int, int]) -> DataFrame:
        folders = [f"{self.path}/rows/{v}/bucket={b}" for b, v in sorted(parts.items())]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def before(self, version: int) -> int | None:
        """The last version below this one."""
        return max((v for v in self.versions() if v < version), default=None)

    def read(self, version: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """Rows of a version, the last by default; with `of` only those of the buckets that its keys fall into."""
        parts = self.manifest(version)
        if of is not None:
            touched = self._touched(of)
            parts = {b: v for b, v in parts.items() if b in touched}
        return self._read(parts)

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self._bucket()).distinct().collect()}

    def merge(self, new: DataFrame, version: int, fold: Fold) -> set[int]:
        """Make `version` of the one before it: fold(old rows of the touched buckets, new rows) replaces their rows. Returns
        the touched buckets; none if the version is there already."""
        if version in self.versions():
            return set()
        last = self.before(version)
        before = {} if last is None else self.manifest(last)
        touched = self._touched(new)
        columns = self.spark.createDataFrame([], self.schema).columns
        out = fold(self._read({b: v for b, v in before.items() if b in touched}), new).select(*columns).withColumn("bucket", self._bucket())
        # One task a bucket, by its number; what an attempt that failed has left is replaced.
        out.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/{version}")
        written = {r[0] for r in self.spark.read.parquet(f"{self.path}/rows/{version}").select("bucket").distinct().collect()} if touched and self._has_rows(version) else set()
        rows = [(b, v) for b, v in before.items() if b not in touched] + [(b, version) for b in sorted(written)]
        self.spark.createDataFrame(rows, "bucket INT, version LONG").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{version}")
        return touched

    def digests(self, version: int | None = None) -> dict[int, tuple]:
        """Bucket to (rows, xor and sum of their hashes): equal for equal rows in any order. Files of a bucket never change, so
        each is hashed once; its digest is kept beside it."""
        parts = self.manifest(version)
        columns = self.spark.createDataFrame([], self.schema).columns
        h = F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])  # a null alone would leave the hash as it is
        out: dict[int, tuple] = {}
        for v in sorted(set(parts.values())):
            kept = f"{self.path}/digests/{v}"
            if not self._exists(f"{kept}/_SUCCESS"):
                rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/{v}").withColumn("bucket", self._bucket()).withColumn("_h", h)
                each = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("_h").alias("x"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("s"))
                each.coalesce(1).write.mode("overwrite").parquet(kept)
            out |= {r["bucket"]: (r["n"], r["x"], r["s"]) for r in self.spark.read.parquet(kept).collect() if parts.get(r["bucket"]) == v}
        return out

    def only(self, buckets: set[int], version: int | None = None) -> DataFrame:
        """Rows of some buckets of a version; files of others are not listed."""
        return self._read({b: v for b, v in self.manifest(version).items() if b in buckets})

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _has_rows(self, version: int) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/{version}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return any(s.isDirectory() for s in fs.listStatus(at))

    def vacuum(self) -> None:
        """Delete all versions but the last, and the buckets that it doesn't use."""
        known = self.versions()
        used = {f"{v}/bucket={b}" for b, v in self.manifest().items()}
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for v in known:
            root = jvm.Path(f"{self.path}/rows/{v}")
            fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for s in fs.listStatus(root) if fs.exists(root) else []:
                if f"{v}/{s.getPath().getName()}" not in used:
                    fs.delete(s.getPath(), True)
            if v != known[-1]:
                fs.delete(jvm.Path(f"{self.path}/manifest/{v}"), True)
