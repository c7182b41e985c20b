"""Product codes of vectors by Lloyd rounds over kd-trees (the filtering algorithm).

A component x counts as floor(scale * x), so all sums are exact and no order of rows shows in them. Vectors
are cut into equal consecutive parts, each with a codebook of its own. Blocks of vectors become one
kd-tree a part, whose nodes keep bounding box, count and sum of their points; the trees are written once and
read by every round. In a round the entries that may be nearest go down a tree: the entry nearest to the
middle of a box rules out each other entry that is nowhere in the box nearer (or equally near with a lower
index), and where one entry is left the whole subtree is assigned by its cached sum and count. Nodes of
all trees of a block go down together, level by level. Partial sums meet in a grouped aggregation; the
driver holds the codebooks (parts x entries x components) and nothing that grows with the rows.

Defined cases: rows whose vector is null, empty or has null or non-finite components take no part, nor do
vectors of another length than the one of the smallest vec_id (nulls last); that length must be a multiple of
the parts. With fewer vectors than entries the codebooks are that much smaller; equal vectors may fill several
entries, of which the lowest is used. Repeated rows and null ids are coded each. An empty table gives an
empty table. Components so large that squared distances leave 64 bits raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from newsloom.llm.shared import arrow_rows, cut, free, lean, small

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: vectors of a block, points of a leaf, (node, entry) pairs that are compared at once
BLOCK, LEAF, PAIRS = 4096, 8, 1 << 18
#: blocks' trees, some 3 MB each for 64 components, in an Arrow batch
TREE_ROWS = 16
#: copies of a small row for each of which a hot label's rows are dealt
SALTS = 32
TREES = "ids binary, points binary, order_ binary, first binary, last binary, low binary, high binary, sums binary"


def parts_of(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Integer vectors (rows x components) as parts x rows x components of a part."""
    return np.ascontiguousarray(vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2))


def fits(vectors: np.ndarray) -> bool:
    """Whether doubled squared distances of such vectors, summed over all components, stay within 64 bits."""
    most = float(np.abs(vectors).max(initial=0))
    return 4 * vectors.shape[-1] * (2 * most + 1) ** 2 < 2.0**63


class Forest:
    """kd-trees of all parts of a block, each complete: node i has the children 2i + 1 and 2i + 2.

    order[p] lists part p's points so that each node holds the consecutive ones from first to last (the same
    for all parts), split at the middle of the widest side of its box.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        parts, n, d = points.shape
        self.depth = 0
        while (n >> self.depth) > leaf:
            self.depth += 1
        nodes = (2 << self.depth) - 1
        self.first, self.last = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        self.last[0] = n
        self.order = np.tile(np.arange(n), (parts, 1))
        for level in range(self.depth):
            own = np.arange((1 << level) - 1, (2 << level) - 1)
            size = self.last[own] - self.first[own]
            held = np.take_along_axis(points, self.order[:, :, None], axis=1)
            low, high = self._boxes(held, own)
            side = np.repeat(np.argmax(high - low, axis=2), size, axis=1)
            at = np.take_along_axis(held, side[:, :, None], axis=2)[:, :, 0]
            node = np.repeat(np.arange(own.size), size)
            for p in range(parts):
                self.order[p] = self.order[p][np.lexsort((at[p], node))]
            middle = self.first[own] + size // 2
            self.first[2 * own + 1], self.last[2 * own + 1] = self.first[own], middle
            self.first[2 * own + 2], self.last[2 * own + 2] = middle, self.last[own]
        held = np.take_along_axis(points, self.order[:, :, None], axis=1)
        self.low, self.high, self.sums = (np.zeros((parts, nodes, d), np.int64) for _ in range(3))
        bottom = np.arange((1 << self.depth) - 1, nodes)
        self.low[:, bottom], self.high[:, bottom] = self._boxes(held, bottom)
        self.sums[:, bottom] = np.add.reduceat(held, self.first[bottom], axis=1)
        for level in range(self.depth - 1, -1, -1):
            own = np.arange((1 << level) - 1, (2 << level) - 1)
            a, b = 2 * own + 1, 2 * own + 2
            self.low[:, own] = np.minimum(self.low[:, a], self.low[:, b])
            self.high[:, own] = np.maximum(self.high[:, a], self.high[:, b])
            self.sums[:, own] = self.sums[:, a] + self.sums[:, b]

    def _boxes(self, held: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.first[nodes]
        return np.minimum.reduceat(held, at, axis=1), np.maximum.reduceat(held, at, axis=1)

    def packed(self) -> list[bytes]:
        """The arrays, in 32 bits where they fit: the first byte of each tells."""
        out = []
        for x in (self.points, self.order, self.first, self.last, self.low, self.high, self.sums):
            short = x.size == 0 or (x.min() >= -(1 << 31) and x.max() < 1 << 31)
            out.append(bytes([4 if short else 8]) + x.astype("<i4" if short else "<i8").tobytes())
        return out

    @classmethod
    def unpacked(cls, columns: list[pa.Buffer | bytes], parts: int, d: int) -> Forest:
        out = cls.__new__(cls)
        raw = map(memoryview, columns)
        points, order, out.first, out.last, low, high, sums = (np.frombuffer(x[1:], f"<i{x[0]}").astype(np.int64) for x in raw)
        out.points, out.order = points.reshape(parts, -1, d), order.reshape(parts, -1)
        out.low, out.high, out.sums = (x.reshape(parts, -1, d) for x in (low, high, sums))
        out.depth = out.first.size.bit_length() - 1
        return out

    def assign(self, books: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(part, node, entry) of subtrees that go to one entry as a whole, and of leaves' points (part, -1 - point, entry)."""
        parts, k, _ = books.shape
        part, node = np.arange(parts), np.zeros(parts, np.int64)
        keep = np.ones((parts, k), bool)
        for level in range(self.depth + 1):
            done, alive = [], []
            step = max(1, PAIRS // k)
            for i in range(0, part.size, step):
                p, x, c = part[i : i + step], node[i : i + step], keep[i : i + step]
                c = self._filtered(p, x, c, books)
                one = c.sum(axis=1) == 1
                done.append((p[one], x[one], np.argmax(c[one], axis=1)))
                alive.append((p[~one], x[~one], c[~one]))
            yield tuple(map(np.concatenate, zip(*done, strict=True)))
            part, node, keep = map(np.concatenate, zip(*alive, strict=True))
            if not part.size:
                return
            if level < self.depth:
                part, keep = np.repeat(part, 2), np.repeat(keep, 2, axis=0)
                node = (2 * node[:, None] + np.array([1, 2])).ravel()
        yield from self._leaves(part, node, keep, books)

    def _filtered(self, part: np.ndarray, node: np.ndarray, keep: np.ndarray, books: np.ndarray) -> np.ndarray:
        """keep, without the entries that are nearest to no point of the node's box."""
        row, entry = np.nonzero(keep)
        low, high = self.low[part, node], self.high[part, node]
        z = books[part[row], entry]
        far = np.full(keep.shape, np.iinfo(np.int64).max)
        far[row, entry] = ((2 * z - (low + high)[row]) ** 2).sum(axis=1)
        best = np.argmin(far, axis=1)
        star = books[part, best][row]
        # distance to z less that to the best is linear, least at the corner towards z
        corner = np.where(z > star, high[row], low[row])
        gap = ((z - corner) ** 2).sum(axis=1) - ((star - corner) ** 2).sum(axis=1)
        out = keep.copy()
        out[row, entry] = (entry == best[row]) | (gap < 0) | ((gap == 0) & (entry < best[row]))
        return out

    def _leaves(self, part: np.ndarray, node: np.ndarray, keep: np.ndarray, books: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        size = self.last[node] - self.first[node]
        step = max(1, PAIRS // (books.shape[1] * max(1, int(size.max(initial=1)))))
        for i in range(0, part.size, step):
            n, p = size[i : i + step], part[i : i + step]
            row = np.repeat(np.arange(n.size), n)
            at = np.repeat(self.first[node[i : i + step]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            own = p[row]
            point = self.order[own, at]
            far = ((self.points[own, point][:, None, :] - books[own]) ** 2).sum(axis=2)
            far[~keep[i : i + step][row]] = np.iinfo(np.int64).max
            yield own, -1 - point, np.argmin(far, axis=1)

    def moved(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums, counts) of the points of each entry."""
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for part, where, entry in self.assign(books):
            tree = where >= 0
            p, x, e = part[tree], where[tree], entry[tree]
            np.add.at(sums, (p, e), self.sums[p, x])
            np.add.at(counts, (p, e), self.last[x] - self.first[x])
            p, e = part[~tree], entry[~tree]
            np.add.at(sums, (p, e), self.points[p, -1 - where[~tree]])
            np.add.at(counts, (p, e), 1)
        return sums, counts

    def codes(self, books: np.ndarray) -> np.ndarray:
        """Nearest entry of each point, parts x rows."""
        out = np.zeros(self.order.shape, np.int64)
        for part, where, entry in self.assign(books):
            tree = where >= 0
            p, x, e = part[tree], where[tree], entry[tree]
            size = self.last[x] - self.first[x]
            at = np.repeat(self.first[x] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            own = np.repeat(p, size)
            out[own, self.order[own, at]] = np.repeat(e, size)
            out[part[~tree], -1 - where[~tree]] = entry[~tree]
        return out


def _usable(vectors: DataFrame, vector: str, key: str) -> tuple[DataFrame, int]:
    """(rows that take part, their vectors' length; 0 if there are none)."""
    v = F.col(vector)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where(F.coalesce(sound, F.lit(False)))
    first = kept.orderBy(F.col(key).asc_nulls_last(), v).select(F.size(v)).limit(1).collect()
    length = first[0][0] if first else 0
    return kept.where(F.size(v) == length), length


def _growing(parts: int, scale: int, block: int) -> object:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def tree() -> pa.RecordBatch:
            nonlocal held, size
            whole = pa.Table.from_batches(held).combine_chunks()
            flat = whole.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            scaled = np.floor(flat.reshape(whole.num_rows, -1) * scale)
            if not fits(scaled):
                raise ValueError("components are too large for exact squared distances in 64 bits")
            ids = pa.BufferOutputStream()
            with pa.ipc.new_stream(ids, whole.select([0, 2]).schema) as w:
                w.write_table(whole.select([0, 2]))
            columns = [ids.getvalue().to_pybytes(), *Forest(parts_of(scaled.astype(np.int64), parts)).packed()]
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=[f.split()[0] for f in TREES.split(", ")])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - size)
                batch = batch.slice(part.num_rows)
                held.append(part)
                size += part.num_rows
                if size == block:
                    yield tree()
        if held:
            yield tree()

    return run


def grow(kept: DataFrame, vector: str, key: str, label: str, parts: int, scale: int, block: int = BLOCK) -> DataFrame:
    """The trees of all blocks, a row a block, as a table."""
    with arrow_rows(kept.sparkSession):
        return cut(kept.select(key, vector, label).mapInArrow(_growing(parts, scale, block), TREES), "kd-trees")


def _forests(batches: Iterator[pa.RecordBatch], parts: int, d: int) -> Iterator[tuple[pa.Table, Forest]]:
    for batch in batches:
        for row in range(batch.num_rows):
            columns = [batch.column(i)[row].as_buffer() for i in range(batch.num_columns)]
            yield pa.ipc.open_stream(columns[0]).read_all(), Forest.unpacked(columns[1:], parts, d)


def _round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; entries without points stay."""
    parts, k, d = books.shape

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros((parts, k), np.int64)
        for _, forest in _forests(batches, parts, d):
            s, c = forest.moved(books)
            sums, counts = sums + s, counts + c
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "part": np.repeat(p, d), "entry": np.repeat(e, d), "at": np.tile(np.arange(d), p.size),
            "total": sums[p, e].ravel(), "n": np.repeat(counts[p, e], d)
        })

    partial = trees.mapInArrow(run, "part bigint, entry bigint, at bigint, total bigint, n bigint")
    with arrow_rows(trees.sparkSession, TREE_ROWS):
        found = partial.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    part, entry, at, total, n = (found.column(c).to_numpy() for c in ("part", "entry", "at", "total", "n"))
    out = books.copy()
    out[part, entry, at] = np.floor_divide(total, n)
    return out


def _start(kept: DataFrame, vector: str, key: str, parts: int, entries: int, scale: int) -> np.ndarray:
    """Codebooks of the vectors with the smallest keys (nulls last, ties by the vector)."""
    rows = kept.orderBy(F.col(key).asc_nulls_last(), F.col(vector)).select(vector).limit(entries).toArrow()
    flat = rows.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(flat.reshape(rows.num_rows, -1) * scale)
    if not fits(scaled):
        raise ValueError("components are too large for exact squared distances in 64 bits")
    return parts_of(scaled.astype(np.int64), parts)


def _coded(trees: DataFrame, books: np.ndarray, names: StructType) -> DataFrame:
    parts, _, d = books.shape

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, forest in _forests(batches, parts, d):
            codes = forest.codes(books)
            nearest = books[np.arange(parts)[:, None], codes]
            error = ((forest.points - nearest) ** 2).sum(axis=(0, 2))
            text = [c.tobytes().hex() for c in np.ascontiguousarray(codes.T.astype(np.uint8))]
            table = rows.append_column("code", pa.array(text)).append_column("error", pa.array(error))
            yield from table.to_batches()

    return trees.mapInArrow(run, StructType([*names.fields]).add("code", StringType()).add("error", LongType()))


def train(
    vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK
) -> tuple[np.ndarray | None, DataFrame | None, StructType]:
    """(codebooks, trees, schema of key and label); both None where no vector takes part. At most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits")
    kept, length = _usable(vectors, vector, key)
    names = StructType([vectors.schema[key], vectors.schema[label]])
    if not length:
        return None, None, names
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    books = _start(kept, vector, key, parts, entries, scale)
    trees = grow(kept, vector, key, label, parts, scale, block)
    for _ in range(rounds):
        books = _round(trees, books)
    return books, trees, names


def digest(books: np.ndarray) -> str:
    """sha256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", **options: int) -> DataFrame:
    """(key, label, code, error, label_error, codebooks_sha256) of every vector that takes part.

    label_error sums the errors of rows with an equal label, nulls together. Labels are totalled before they
    meet the rows again; where there are too many to broadcast, each total has SALTS copies, so that the
    rows of one label are dealt to as many tasks.
    """
    books, trees, names = train(vectors, vector, key, label, **options)
    own, group = names.fields
    if books is None:
        extra = StructType([own, group]).add("code", StringType()).add("error", LongType()).add("label_error", LongType()).add("codebooks_sha256", StringType())
        return vectors.sparkSession.createDataFrame([], extra)
    with arrow_rows(trees.sparkSession, TREE_ROWS):
        coded = cut(_coded(trees, books, names), "codes")
    free(trees)
    totals = coded.groupBy(F.col(group.name).alias("_label")).agg(F.sum("error").alias("label_error"))
    dim = small(totals)
    if dim is totals:
        salted = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = coded.withColumn("_s", F.pmod(F.xxhash64("code", own.name), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, rows[group.name].eqNullSafe(salted["_label"]) & (rows["_s"] == salted["_salt"]), "left").drop("_s", "_salt")
    else:
        joined = coded.join(dim, coded[group.name].eqNullSafe(dim["_label"]), "left")
    return joined.drop("_label").withColumn("codebooks_sha256", F.lit(digest(books)))


def rebuilt(coded: DataFrame, books: np.ndarray, code: str = "code", scale: int = SCALE) -> DataFrame:
    """coded with the column approximation: the vectors that the codes stand for, middles of their integer steps."""
    parts, _, d = books.shape

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        index = np.frombuffer(bytes.fromhex("".join(column)), np.uint8).reshape(-1, parts)
        return pd.Series(list((books[np.arange(parts), index].reshape(len(column), parts * d) + 0.5) / scale))

    return coded.withColumn("approximation", run(code))
