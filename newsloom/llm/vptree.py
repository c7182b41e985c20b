"""Nearest neighbours with a vantage-point tree per shard.

Equal vectors are one point that carries its smallest ids, as many as a query can use. Points are
dealt to the nearest of a bounded number of pivots; such a cell is cut by hash into shards of bounded
size, each of which is one tree and one row of an index table. A node keeps a vantage point and the
least and largest distance from it to the points of either child. By the triangle inequality no point
of a child is nearer to a query at distance d than gap = max(d - largest, least - d, 0). A child is
passed over when factor * gap exceeds the distance of the k-th neighbour found so far: factor 1 is
exact, larger factors visit less.

Queries travel in blocks of bounded size, first to the shards of their own cell. The k-th distance
found there is the bound with which they go on, to those cells only whose gap does not exceed it by the
same rule; what shards bring back, k neighbours each, is merged per query. Distances are Euclidean in
double precision on the original components.

Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows
without an id. Vectors of different length are never compared. Repeated (id, vector) rows count once; if an id
has several vectors, each is a candidate, and a query by it merges their answers. Equal distances
are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.shared import cut, small, small_batches

#: Neighbours, points of a shard, queries of a block, points of a leaf; pivots of a dimension and of all, cells being passed over by CELL_FACTOR at most.
K, SHARD, BLOCK, LEAF = 10, 8192, 2048, 96
CELLS, MOST_PIVOTS, CELL_FACTOR = 256, 4096, 2.0
#: Factors that tune() tries, the recall that it asks for within one shard, and its number of queries.
FACTORS, RECALL, TUNING = (12.0, 10.0, 8.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.5, 1.0), 0.97, 64


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


class Tree:
    """Points in tree order, with nodes (lo, hi, mid, least and largest distance of inner and outer child)."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, nodes: np.ndarray | None = None):
        self.points, self.ids = points, ids
        self.nodes: list[tuple] = []
        if nodes is None:
            order = np.arange(len(points))
            self._grow(order, 0, len(points))
            self.points, self.ids = points[order], ids[order]
            nodes = np.array(self.nodes, np.float64).reshape(-1, 9)
        self.nodes = nodes
        self.exact = self.points.astype(np.float64)

    def _grow(self, order: np.ndarray, lo: int, hi: int) -> int:
        """Arranges order[lo:hi]; returns the node's number, -1 for a leaf."""
        if hi - lo <= LEAF:
            return -1
        me = len(self.nodes)
        self.nodes.append(())
        part = order[lo:hi]
        x = self.points[part].astype(np.float64)
        # of a few evenly spread points, the one whose distances vary most
        tries = np.linspace(0, len(part) - 1, 5).astype(int)
        dist = np.sqrt(((x[None, :: max(1, len(x) // 200)] - x[tries, None]) ** 2).sum(2))
        v = tries[dist.std(axis=1).argmax()]
        part[[0, v]], x[[0, v]] = part[[v, 0]], x[[v, 0]]
        d = np.sqrt(((x[1:] - x[0]) ** 2).sum(1))
        by = np.argsort(d, kind="stable")
        part[1:], d = part[1:][by], d[by]
        mid = len(d) // 2
        inner = self._grow(order, lo + 1, lo + 1 + mid)
        outer = self._grow(order, lo + 1 + mid, hi)
        self.nodes[me] = (lo, hi, lo + 1 + mid, d[0], d[mid - 1], d[mid], d[-1], inner, outer)
        return me

    def search(self, queries: np.ndarray, k: int, factor: float, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distance and place of the k nearest points of each query (inf, -1 where there are fewer); points beyond limit do not count."""
        self.limit = np.full(len(queries), np.inf) if limit is None else limit
        self.best = np.full((len(queries), k), np.inf)
        self.place = np.full((len(queries), k), -1)
        self.least_id = np.append(self.ids[:, 0], np.iinfo(np.int64).max)
        self.q, self.k, self.factor, self.seen = queries.astype(np.float64), k, factor, 0
        everyone = np.arange(len(queries))
        self._home(0 if len(self.nodes) else -1, 0, len(self.points), everyone)
        self._visit(0 if len(self.nodes) else -1, 0, len(self.points), everyone)
        return self.best, self.place

    def _try(self, lo: int, hi: int, who: np.ndarray) -> np.ndarray:
        """Distances of the queries to points lo:hi, which are merged into the best."""
        out = np.empty((len(who), hi - lo))
        for i in range(0, len(who), 256):
            part = who[i : i + 256]
            d = np.sqrt(((self.q[part, None] - self.exact[None, lo:hi]) ** 2).sum(2))
            out[i : i + 256] = d
            new = np.flatnonzero((d <= self.best[part, -1:]).any(axis=1))
            if new.size:
                w = part[new]
                dist = np.concatenate([self.best[w], d[new]], axis=1)
                place = np.concatenate([self.place[w], np.broadcast_to(np.arange(lo, hi), (new.size, hi - lo))], axis=1)
                # a point that is there already is met again where a query's home leaf is visited
                dist[:, self.k :][(place[:, self.k :, None] == self.place[w][:, None, :]).any(2)] = np.inf
                order = np.lexsort((self.least_id[place], dist), axis=1)[:, : self.k]
                self.best[w], self.place[w] = np.take_along_axis(dist, order, 1), np.take_along_axis(place, order, 1)
                self.place[w] = np.where(np.isinf(self.best[w]), -1, self.place[w])
        self.seen += out.size
        return out

    def _home(self, node: int, lo: int, hi: int, who: np.ndarray) -> None:
        """The leaf of each query, for a first bound."""
        if not len(who) or lo >= hi:
            return
        if node < 0:
            self._try(lo, hi, who)
            return
        at, end, mid, _, most, least, _, inner, outer = self.nodes[node]
        at, end, mid = int(at), int(end), int(mid)
        d = self._try(at, at + 1, who)[:, 0]
        near = d <= (most + least) / 2
        self._home(int(inner), at + 1, mid, who[near])
        self._home(int(outer), mid, end, who[~near])

    def _visit(self, node: int, lo: int, hi: int, who: np.ndarray) -> None:
        if not len(who) or lo >= hi:
            return
        if node < 0:
            self._try(lo, hi, who)
            return
        at, end, mid, in_least, in_most, out_least, out_most, inner, outer = self.nodes[node]
        at, end, mid = int(at), int(end), int(mid)
        d = self._try(at, at + 1, who)[:, 0]
        for least, most, child, a, b in ((in_least, in_most, inner, at + 1, mid), (out_least, out_most, outer, mid, end)):
            gap = np.maximum(0, np.maximum(d - most, least - d))
            self._visit(int(child), a, b, who[self.factor * gap <= np.minimum(self.best[who, -1], self.limit[who])])


def _pack(batch: pa.Table, most_ids: int) -> tuple[np.ndarray, np.ndarray]:
    vectors = np.array(batch.column("embedding").to_pylist())
    ids = np.full((len(vectors), most_ids), np.iinfo(np.int64).max)
    for i, x in enumerate(batch.column("ids").to_pylist()):
        ids[i, : len(x)] = x
    return vectors, ids


TREES = "dim int, cell int, sub int, n bigint, points binary, ids binary, nodes binary"
PACKED = "dim int, cell int, who binary, queries binary, limits binary"


class Cells:
    """The pivots of each dimension that has several shards, and the radius of each cell."""

    def __init__(self, pivots: dict[int, np.ndarray], radius: dict[tuple[int, int], float] | None = None):
        self.pivots, self.radius = pivots, radius or {}

    def distances(self, vectors: list[list[float]]) -> Iterator[tuple[int, np.ndarray]]:
        """(row, distances to the pivots of its dimension), none for dimensions without."""
        for i, v in enumerate(vectors):
            p = self.pivots.get(len(v))
            if p is not None:
                yield i, np.sqrt(((p - np.array(v, np.float64)) ** 2).sum(1))


def _home(cells) -> object:
    """Rows with the number of their nearest pivot and the distance to it, 0 for dimensions without pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for i, d in cells.value.distances(batch.column("embedding").to_pylist()):
                cell[i], far[i] = d.argmin(), d.min()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return run


def _with_home(rows: DataFrame, cells) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_home(cells), schema + ", cell int, far double")


class Index:
    """trees (one row a shard), parts (dim, cell, subs: the shards of each cell) and the broadcast cells."""

    def __init__(self, trees: DataFrame, parts: DataFrame, cells):
        self.trees, self.parts, self.cells = trees, parts, cells


def index(rows: DataFrame, k: int = K, shard: int = SHARD, most_cells: int = CELLS) -> Index:
    """An index of all usable (vec_id, embedding) rows."""
    spark = rows.sparkSession
    small_batches(spark)
    rows = rows.select("vec_id", "embedding").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).dropDuplicates()
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    points = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("embedding").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids")
    )
    points = cut(points.withColumn("dim", F.size("embedding")), "points")
    cells = spark.sparkContext.broadcast(_pivots(points, shard, most_cells))
    points = cut(_with_home(points, cells), "homes")
    found = cut(points.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("subs"), F.max("far").alias("radius")), "cells")
    radius = {(r.dim, r.cell): r.radius for r in found.where(F.col("dim").isin(list(cells.value.pivots))).collect()}  # MOST_PIVOTS at most
    dealt = points.join(small(found.select("dim", "cell", "subs")), ["dim", "cell"]).withColumn(
        "sub", F.pmod(F.xxhash64("embedding"), F.col("subs")).cast("int")
    )

    def build(part: pa.Table) -> pa.Table:
        points, ids = _pack(part.sort_by([("ids_first", "ascending")]), k + 1)
        t = Tree(points, ids)
        key = {c: part.column(c).slice(0, 1) for c in ("dim", "cell", "sub")}
        return pa.table(
            key | {
                "n": pa.array([len(points)]), "points": pa.array([t.points.astype(np.float64).tobytes()], pa.binary()),
                "ids": pa.array([t.ids.tobytes()], pa.binary()), "nodes": pa.array([t.nodes.tobytes()], pa.binary())
            }
        )

    dealt = dealt.select("dim", "cell", "sub", "embedding", "ids", F.col("ids")[0].alias("ids_first"))
    trees = cut(dealt.groupBy("dim", "cell", "sub").applyInArrow(build, TREES), "trees")
    return Index(trees, found.select("dim", "cell", "subs"), spark.sparkContext.broadcast(Cells(cells.value.pivots, radius)))


def _pivots(points: DataFrame, shard: int, most_cells: int) -> Cells:
    """A pivot for each shard that the points of a dimension need, most_cells at most: the points with the smallest hashes.

    A bound on the hash leaves few rows to rank. Dimensions are served by their size until there are
    MOST_PIVOTS pivots; points of others are one cell.
    """
    sizes = points.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > shard).orderBy(F.desc("n"), "dim").limit(MOST_PIVOTS).collect()
    wanted, left = {}, MOST_PIVOTS
    for r in sizes:
        wanted[r.dim] = min(most_cells, -(-r.n // shard), left)
        left -= wanted[r.dim]
    wanted = {d: n for d, n in wanted.items() if n > 1}
    if not wanted:
        return Cells({})
    top = 1 << 62
    bounds = points.sparkSession.createDataFrame(
        [(r.dim, wanted[r.dim], min(top, top // r.n * 8 * wanted[r.dim])) for r in sizes if r.dim in wanted], "dim int, wanted int, bound bigint"
    )
    h = F.pmod(F.xxhash64("embedding", F.lit("pivot")), F.lit(top))
    few = points.withColumn("h", h).join(F.broadcast(bounds), "dim").where("h <= bound")
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy("h", "embedding"))).where("place <= wanted")
    held: dict[int, list] = {}
    for r in few.select("dim", "embedding").orderBy("dim", "h").collect():
        held.setdefault(r.dim, []).append(r.embedding)
    return Cells({d: np.array(v, np.float64) for d, v in held.items()})


def _answers(k: int, factor: float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tree = _tree(r)
                who = np.frombuffer(r["who"], np.int64)
                dist, place = tree.search(np.frombuffer(r["queries"]).reshape(len(who), r["dim"]), k + 1, factor, np.frombuffer(r["limits"]))
                # every id of the points found, but the query's own
                ids = np.where(place[:, :, None] >= 0, tree.ids[place], np.iinfo(np.int64).max).reshape(len(who), -1)
                d = np.repeat(dist, tree.ids.shape[1], axis=1)
                d = np.where((ids == who[:, None]) | (ids == np.iinfo(np.int64).max), np.inf, d)
                order = np.lexsort((ids, d), axis=1)[:, :k]
                d, ids = np.take_along_axis(d, order, 1).ravel(), np.take_along_axis(ids, order, 1).ravel()
                ok = np.isfinite(d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(who, order.shape[1])[ok]), pa.array(ids[ok]), pa.array(d[ok])], names=["query_id", "vec_id", "score"]
                )

    return run


def tune(trees: DataFrame, k: int = K, recall: float = RECALL, queries: int = TUNING) -> float:
    """The largest of FACTORS that finds `recall` of the true neighbours, themselves left out, of a few points of the largest shard.

    One shard reaches the driver, whose size is bounded.
    """
    r = trees.orderBy(F.desc("n"), "dim", "cell", "sub").limit(1).toArrow().to_pylist()
    if not r:
        return 1.0
    tree = _tree(r[0])
    at = np.unique(np.linspace(0, len(tree.points) - 1, queries).astype(int))
    truth = tree.search(tree.points[at], k + 1, 1.0)[1]
    for factor in FACTORS:
        found = tree.search(tree.points[at], k + 1, factor)[1]
        others = [t[(t >= 0) & (t != i)] for t, i in zip(truth, at, strict=True)]
        hit = sum(np.isin(t, f).sum() for t, f in zip(others, found, strict=True))
        if hit >= recall * sum(t.size for t in others):
            return factor
    return 1.0


def _tree(r: dict) -> Tree:
    return Tree(
        np.frombuffer(r["points"]).reshape(r["n"], r["dim"]), np.frombuffer(r["ids"], np.int64).reshape(r["n"], -1),
        np.frombuffer(r["nodes"]).reshape(-1, 9)
    )


def _pack_queries(part: pa.Table) -> pa.Table:
    key = {c: part.column(c).slice(0, 1) for c in ("dim", "cell")}
    vectors = np.array(part.column("embedding").to_pylist(), np.float64)
    return pa.table(
        key | {
            "who": pa.array([part.column("vec_id").to_numpy().tobytes()], pa.binary()), "queries": pa.array([vectors.tobytes()], pa.binary()),
            "limits": pa.array([part.column("bound").to_numpy().tobytes()], pa.binary())
        }
    )


def _onward(cells, factor: float) -> object:
    """A row of each query for each cell but its own that its bound does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = cells.value
        for batch in batches:
            home, bound = batch.column("cell").to_numpy(), batch.column("bound").to_numpy()
            rows, goals = [], []
            for i, d in c.distances(batch.column("embedding").to_pylist()):
                dim = len(batch.column("embedding")[i])
                for goal, x in enumerate(d):
                    if goal != home[i] and (dim, goal) in c.radius and factor * (x - c.radius[dim, goal]) <= bound[i]:
                        rows.append(i)
                        goals.append(goal)
            out = batch.select(["vec_id", "embedding", "dim", "bound"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(goals, pa.int32())], names=["vec_id", "embedding", "dim", "bound", "cell"])

    return run


def search(held: Index, queries: DataFrame, k: int = K, factor: float | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each usable query (vec_id, embedding); factor None is tuned."""
    factor = tune(held.trees, k) if factor is None else factor
    small_batches(queries.sparkSession)
    q = queries.select("vec_id", "embedding").where(
        usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    ).dropDuplicates().withColumn("dim", F.size("embedding"))
    q = cut(_with_home(q, held.cells).drop("far"), "queries")

    def found(rows: DataFrame) -> DataFrame:
        """Answers of the shards of each row's cell, in blocks of queries."""
        sizes = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).alias("blocks"))
        dealt = rows.join(small(sizes), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("blocks")).cast("int"))
        packed = dealt.select(
            "dim", "cell", "block", "vec_id", "embedding", "bound"
        ).groupBy("dim", "cell", "block").applyInArrow(_pack_queries, PACKED)
        sent = packed.join(small(held.parts), ["dim", "cell"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs")
        out = sent.join(held.trees, ["dim", "cell", "sub"]).mapInArrow(_answers(k, factor), "query_id bigint, vec_id bigint, score double")
        return cut(out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "answers")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    near = found(q.withColumn("bound", F.lit(float("inf"))))
    last = near.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    bounded = q.join(last, "vec_id", "left").select("vec_id", "embedding", "dim", "cell", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    onward = bounded.mapInArrow(
        _onward(held.cells, min(factor, CELL_FACTOR)),
        "vec_id bigint, embedding " + q.schema["embedding"].dataType.simpleString() + ", dim int, bound double, cell int"
    )
    far = found(cut(onward, "onward"))
    both = near.unionByName(far).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 100, k: int = K, factor: float | None = None) -> DataFrame:
    """The k nearest found of each row whose vec_id is divisible by `every`, among all other rows."""
    return search(index(vectors, k), vectors.where(F.col("vec_id") % every == 0), k, factor)
