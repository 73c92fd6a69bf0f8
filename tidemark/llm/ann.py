"""Approximate nearest neighbours by largest inner product: vantage-point trees per shard.

Vectors get one more coordinate that lifts all to the greatest norm, so that nearness by Euclidean distance is nearness
by inner product. A vantage-point tree over a bounded sample cuts space into cells, and every row goes to its cell; cells
with many rows are dealt over several shards of bounded size. Each shard becomes a vantage-point tree of its own.

A query first searches its home cell, which tells how far its k-th nearest is at most; then it goes to those other cells
that could hold a nearer one. A cell, or the side of a node of a tree, is skipped if its least possible distance by the
triangle inequality, multiplied by `factor`, exceeds the distance of the k-th nearest so far: factor 1 is exact, a greater
one searches less. Queries are answered in blocks, a node at a time for all queries that reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Vectors of a leaf; and of one where factors are tried, which is finer than any cell, so nothing prunes more later.
LEAF, FINE = 256, 32
#: Rows of the sample that cuts space into cells and tries factors, and cells, at most. Every row is indexed, whatever the
#: sample.
SAMPLE, CELLS = 8192, 1024
#: Factors to try, queries to try them with, and the recall over the sample that a factor must keep.
FACTORS, TRIED, RECALL = (8.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25), 200, 0.97


class Cells:
    """Cells of space: a vantage-point tree whose nodes split at a median radius of the sample."""

    def __init__(self, sample: np.ndarray, top: float, n_cells: int, seed: int = 5):
        self.top, self.nodes, self.n = top, [], 0
        self.rng = np.random.default_rng(seed)
        lift = np.sqrt(np.maximum(top - np.einsum("ij,ij->i", sample, sample), 0.0))
        self._build(sample, lift, n_cells)

    def _build(self, v: np.ndarray, lift: np.ndarray, n_cells: int) -> int:
        at = len(self.nodes)
        self.nodes.append((self.n,))
        if n_cells > 1 and len(v) > 1:
            i = int(self.rng.integers(len(v)))
            d = self._far(v, lift, v[i], lift[i])
            radius = float(np.median(d))
            inner = d < radius
            if inner.any():
                half = n_cells // 2
                left = self._build(v[inner], lift[inner], half)
                self.nodes[at] = (v[i], float(lift[i]), radius, left, self._build(v[~inner], lift[~inner], n_cells - half))
                return at
        self.n += 1
        return at

    def _far(self, v: np.ndarray, lift: np.ndarray, p: np.ndarray, p_lift: float) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.top - 2 * (v @ p + lift * p_lift), 0.0))

    def of(self, v: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        lift = np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", v, v), 0.0))
        out, todo = np.zeros(len(v), np.int64), [(0, np.arange(len(v)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                out[rows] = node[0]
            elif len(rows):
                inner = self._far(v[rows], lift[rows], node[0], node[1]) < node[2]
                todo += [(node[3], rows[inner]), (node[4], rows[~inner])]
        return out

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The least possible distance of each query to the members of each cell, (n, cells)."""
        base = self.top + np.einsum("ij,ij->i", q, q)
        out, todo = np.zeros((len(q), self.n)), [(0, np.zeros(len(q)))]
        while todo:
            at, bound = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                out[:, node[0]] = bound
            else:
                d = np.sqrt(np.maximum(base - 2 * (q @ node[0]), 0.0))
                todo += [(node[3], np.maximum(bound, d - node[2])), (node[4], np.maximum(bound, node[2] - d))]
        return out


class VPTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, seed: int = 5):
        self.leaf = leaf
        self.ids, self.v = ids, np.ascontiguousarray(vectors)
        norms = np.einsum("ij,ij->i", self.v, self.v)
        self.top = float(norms.max()) if len(norms) else 0.0
        self.lift = np.sqrt(np.maximum(self.top - norms, 0.0))
        self.rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        self.scored = 0  # pairs of a query and a vector that were compared
        self.root = self._build(np.arange(len(ids)))

    def _between(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Distances in the lifted space; all points lie on one sphere."""
        dot = self.v[rows] @ self.v[i] + self.lift[rows] * self.lift[i]
        return np.sqrt(np.maximum(2 * self.top - 2 * dot, 0.0))

    def _build(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= self.leaf:
            self.nodes[at] = (rows,)
            return at
        pick = rows[self.rng.integers(0, len(rows), 4)]  # the candidate whose distances spread most
        i = int(max(pick, key=lambda p: self._between(int(p), rows[:: max(1, len(rows) // 256)]).std()))
        d = self._between(i, rows)
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2  # by rank, so equal distances still split evenly
        inner, outer = order[:half], order[half:]
        self.nodes[at] = (i, float(d[inner].max()), float(d[outer].min()), self._build(rows[inner]), self._build(rows[outer]))
        return at

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), each (n, k), best first; -inf and -1 where there are fewer. A query's own id is left out, and
        nothing below its `floor` is sought."""
        n, wide = len(queries), 2 * k + 1  # more than k, as equal vectors' products can differ in their last bit
        self.q, self.qid, self.k, self.wide, self.factor = queries, ids, k, wide, factor
        self.base = self.top + np.einsum("ij,ij->i", queries, queries)
        self.floor = np.full(n, -np.inf) if floor is None else floor
        self.score, self.row = np.full((n, wide), -np.inf), np.full((n, wide), -1, np.int64)
        if not len(self.ids):
            return self.score[:, :k], self.row[:, :k]
        self._visit(self.root, np.arange(n))
        # The final scores are summed in one order, so equal vectors tie and the smaller id wins.
        exact = np.zeros((n, wide))
        for j in range(queries.shape[1]):
            exact += queries[:, j, None] * self.v[self.row, j]
        exact[self.row < 0] = -np.inf
        found = np.where(self.row < 0, -1, self.ids[self.row])
        order = np.lexsort((found, -exact), axis=1)[:, :k]
        return np.take_along_axis(exact, order, axis=1), np.take_along_axis(found, order, axis=1)

    def _reach(self, rows: np.ndarray) -> np.ndarray:
        """Distance of the k-th nearest so far."""
        return np.sqrt(np.maximum(self.base[rows] - 2 * np.maximum(self.score[rows, self.k - 1], self.floor[rows]), 0.0))

    def _visit(self, at: int, rows: np.ndarray) -> None:
        node = self.nodes[at]
        if len(node) == 1:
            members = node[0]
            s = self.q[rows] @ self.v[members].T
            self.scored += s.size
            s[self.qid[rows][:, None] == self.ids[members][None, :]] = -np.inf
            better = s.max(axis=1) >= np.maximum(self.score[rows, -1], self.floor[rows] - 1e-9)  # others gain nothing here
            if not better.any():
                return
            rows, s = rows[better], s[better]
            all_s = np.concatenate((self.score[rows], s), axis=1)
            all_r = np.concatenate((self.row[rows], np.where(s > -np.inf, members, -1)), axis=1)
            order = np.lexsort((self.ids[all_r], -all_s), axis=1)[:, : self.wide]
            self.score[rows] = np.take_along_axis(all_s, order, axis=1)
            self.row[rows] = np.take_along_axis(all_r, order, axis=1)
            return
        i, in_max, out_min, inner, outer = node
        d = np.sqrt(np.maximum(self.base[rows] - 2 * (self.q[rows] @ self.v[i]), 0.0))
        to_in, to_out = np.maximum(d - in_max, 0.0), np.maximum(out_min - d, 0.0)
        first_in = to_in <= to_out
        for child, own in ((inner, first_in), (outer, ~first_in)):
            if own.any():
                self._visit(child, rows[own])
        for child, own, gap in ((inner, ~first_in, to_in), (outer, first_in, to_out)):
            # A little slack keeps ties, of which the smaller id wins.
            go = own & (gap * self.factor <= self._reach(rows) + 1e-9)
            if go.any():
                self._visit(child, rows[go])


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v (double) and dim of the vectors that take part: not null, not zero, all components finite."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    out = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return out.where(fine).withColumn("dim", F.size("v"))


def fitted_factor(sample: np.ndarray, k: int) -> float:
    """The greatest factor that keeps RECALL over the sample; 1 (exact) where the sample is too small to tell."""
    n = len(sample)
    if n < 20 * k:
        return 1.0
    ids = np.arange(n)
    tree, asked = VPTree(ids, sample, FINE), ids[:: max(1, n // TRIED)]
    want = tree.search(asked, sample[asked], k, 1.0)[0][:, -1]  # scores, as copies tie
    for factor in FACTORS:
        if (tree.search(asked, sample[asked], k, factor)[0] >= want[:, None]).mean() >= RECALL:
            return factor
    return 1.0


def fitted(rows: DataFrame, shard_rows: int, k: int, factor: float | None) -> tuple[dict[int, Cells], dict[int, float]]:
    """Cells, and factors where none is given, by length of the vectors; from a sample of at most SAMPLE rows, those with
    the least hash of their id."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = {r["dim"]: (r["n"], r["top"]) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top")).collect()}
    drawn = rows.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(SAMPLE).select("dim", "v").toPandas()
    cells, factors = {}, {}
    for dim, (n, top) in sizes.items():
        of = np.array(drawn["v"][drawn["dim"] == dim].tolist(), float).reshape(-1, dim)
        factors[dim] = fitted_factor(of, k) if factor is None else factor
        if n > shard_rows:
            cells[dim] = Cells(of, top, min(CELLS, -(-n // shard_rows)))
    return cells, factors


def nearest(vectors: DataFrame, k: int = 20, query_modulus: int = 20, factor: float | None = None, shard_rows: int = 8192, block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score for each query row (id divisible by query_modulus) against all rows.

    Nearness is the inner product in double precision, ties go to the smaller id; a query never finds its own id. Only
    vectors of the query's length are candidates. Null, zero or non-finite vectors and null ids take no part; repeated
    rows of one id give one result each time they are found. Query rows of one id share one top k: the best of what they
    all find, where a row that several of them find counts each time. Shards hold about shard_rows vectors whatever the size of
    the table. Without a factor, the greatest is taken that keeps 97 % recall over a sample of at most SAMPLE vectors;
    1 gives exact results. Of copies of one vector a shard needs only the k + 1 smallest ids.
    """
    rows = usable(vectors, id_col, vector_col)
    cells, factors = fitted(rows, shard_rows, k, factor)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            dims = rb.column(2).to_numpy(zero_copy_only=False)
            cell = np.zeros(len(dims), np.int64)
            for dim in set(dims.tolist()) & cells.keys():
                at = np.flatnonzero(dims == dim)
                cell[at] = cells[dim].of(_matrix(rb.column(1).take(pa.array(at)), dim))
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(cell)], ["id", "v", "dim", "cell"])

    members = table(rows.select("id", "v", "dim").mapInArrow(placed, "id long, v array<double>, dim int, cell long"), "ann-cells")
    counts = members.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    shards = table(counts, "ann-shards")  # as many rows as cells
    queries = members.where(F.col("id") % query_modulus == 0).select("id", "v", "dim")

    def routed(floors: bool):
        """Queries with the cell they go to: the home cell, or with floors all others within reach."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                dims = rb.column(2).to_numpy(zero_copy_only=False)
                for dim in sorted(set(dims.tolist())):
                    if dim not in cells and floors:
                        continue
                    at = np.flatnonzero(dims == dim)
                    for part in np.split(at, range(block, len(at), block)):
                        some = rb.take(pa.array(part))
                        if dim not in cells:
                            row, cell = np.arange(len(part)), np.zeros(len(part), np.int64)
                        else:
                            q = _matrix(some.column(1), dim)
                            bound = cells[dim].bounds(q)
                            home = bound.argmin(axis=1)
                            if floors:
                                floor = some.column(3).to_numpy(zero_copy_only=False)
                                reach = np.sqrt(np.maximum(cells[dim].top + np.einsum("ij,ij->i", q, q) - 2 * floor, 0.0))
                                go = bound * factors[dim] <= reach[:, None] + 1e-9
                                go[np.arange(len(q)), home] = False
                                row, cell = np.nonzero(go)
                            else:
                                row, cell = np.arange(len(q)), home
                        out = some.take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.astype(np.int64))], [*out.schema.names, "cell"])

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        held: dict[int, list] = {0: [], 1: []}

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal tree
            if tree is None and held[1] and held[0]:
                ids, v = np.array([x[0] for x in held[0]], np.int64), np.array([x[1] for x in held[0]]).reshape(len(held[0]), -1)
                tree = VPTree(*_few_copies(ids, v, k + 1))
                held[0] = []
            if tree is not None and held[1]:
                qid, q, floor = np.array([x[0] for x in held[1]], np.int64), np.array([x[1] for x in held[1]]), np.array([x[2] for x in held[1]])
                score, found = tree.search(qid, q, k, factors[at[0]], floor)
                good = (score > -np.inf) & (score >= floor[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, good.sum(axis=1))), pa.array(found[good]), pa.array(score[good])], ["query_id", "vec_id", "score"])
            held[1] = []

        for rb in batches:
            for dim, cell, s, kind, id_, v, floor in zip(*(rb.column(i) for i in range(7))):
                here = (dim.as_py(), cell.as_py(), s.as_py())
                if here != at:
                    yield from answer()
                    at, tree = here, None
                    held[0], held[1] = [], []
                held[kind.as_py()].append((id_.as_py(), v.values.to_numpy(zero_copy_only=False), floor.as_py()))
                if len(held[1]) >= block:
                    yield from answer()
        yield from answer()

    def found(asked: DataFrame) -> DataFrame:
        """What the queries find in the cells they were sent to. A shard's members come before its queries."""
        few = F.broadcast(shards)  # at most CELLS rows a length
        to = asked.join(few, ["dim", "cell"]).select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("kind"), "id", "v", "floor")
        own = members.join(few, ["dim", "cell"]).select(
            "dim", "cell", F.pmod(F.xxhash64(F.lit("shard"), "id"), F.col("shards")).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "v", F.lit(0.0).alias("floor"))
        dealt = own.unionByName(to).repartition("dim", "cell", "shard").sortWithinPartitions("dim", "cell", "shard", "kind", "id")
        return dealt.mapInArrow(search, "query_id long, vec_id long, score double")

    kinds = "id long, v array<double>, dim int"
    home = queries.mapInArrow(routed(False), f"{kinds}, cell long").withColumn("floor", F.lit(-float("inf")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = found(home)
    if cells:
        near = table(ranked(out), "ann-home")
        floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        asked = queries.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-float("inf"))))
        others = asked.mapInArrow(routed(True), f"{kinds}, floor double, cell long")
        out = near.drop("rank").unionByName(found(others))
    return ranked(out).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _few_copies(ids: np.ndarray, v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors the `most` smallest ids: no query can have more of them among its nearest."""
    _, group = np.unique(v, axis=0, return_inverse=True)
    order = np.lexsort((ids, group.ravel()))
    g = group.ravel()[order]
    place = np.arange(len(g)) - np.searchsorted(g, g)
    keep = np.sort(order[place < most])
    return ids[keep], v[keep]
