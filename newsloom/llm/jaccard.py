"""Exact n-gram Jaccard self-join with set-relation skipping.

A document's set holds the 64-bit hashes of its distinct k-word shingles (of all its words, if it
has fewer). Two sets link at Jaccard similarity `num / den` (80/100) or more. Documents with equal
sets are one node; the join runs over nodes.

1. One order of shingles for all: rare ones by hash, then those that many documents share. How many
   share a shingle is counted over all sets, in the first part of each set's hash order, from which
   prefixes are taken. Any order gives the same links; this one keeps common passages out of prefixes.
2. Prefix filter: sets that link have a shingle in common within their first n - ceil(t n) + 1.
   Prefixes become index lists (shingle -> node, size, position), by one shuffle.
3. Index skipping: a list is cut into blocks by size and position; a block pair is skipped when
   its sizes or positions rule out the overlap that a link needs.
4. Answer skipping: short lists give their pairs at once. In each size class of a long list the most
   central node is the leader; a node's best candidate, leader or partner, is verified first. What a
   leader's answer tells about two members - |x & m| + |x & z| - |x| <= |m & z| <= min(|x & m|,
   |x & z|) + min(|m - x|, |z - x|) - accepts or drops the pair without looking at its sets, and
   pairs that are connected already are not formed. Groups of thousands of near copies so cost a
   pass, not a square.
5. Of what the leaders leave apart, a task's long lists first give a forest of the likeliest links by bitmaps, fewer than
   nodes, and these are verified: a node that its leader does not link need not meet every member of its group.
6. What is left is counted per pair over all lists, bounded by the last common position and by
   parity bitmaps (two sets differ in at least as many shingles as their bitmaps differ in bits),
   and verified on the sets. Long lists are dealt by their smallest node, so the lists of one group
   of documents meet in one task and give a pair once, however many shingles it shares; the lists of
   a node that begins very many are dealt on by shingle. List entries carry a small bitmap of their
   node, and the number of its prefix shingles that any other prefix has, so pairs that share a few
   shingles by chance are not formed at all. In large sets, which would fill it, the bitmap is of
   those prefix shingles.

Node keys and shingles are 64-bit hashes. Null or word-less texts have an empty set and are
linked with nothing. Repeated rows are members of the same node. Rows with a null doc_id take part
and are named by the other members of their component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import tokens as tk
from newsloom.llm.shared import bloom, cut, free, in_bloom, lean, small, small_batches
from newsloom.operators.graph import components

#: Words of a shingle, threshold as a fraction, bound of the broadcast list of common shingles (16 MB), and their least count.
K, NUM, DEN, MOST_COMMON, COMMON = 5, 80, 100, 1 << 21, 8
BLOCK, LONG, SMALL_BITS, MOST_BITS, LARGE = 64, 8, 1024, 1 << 15, 2000
#: Shingles that a worker holds at once, and entries of long lists that begin with one node and are dealt to one task.
HELD, DEALT = 1 << 21, 1 << 12
#: Low bytes of a shingle by which it is counted, and copies of a component's row that meet its members.
COUNTED, COPIES = 6, 16


def need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest overlap with which sets of sizes a and b link."""
    return -(-(a + b) * NUM // (NUM + DEN))


def prefix(n: int) -> int:
    return n - -(-n * NUM // DEN) + 1


def shingle_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row that has a word."""
    for lo, hi, data, off in tk.chunks(batch.column("text")):
        data = tk.LOWER[data]
        s, e, row = tk.spans(data, off, tk.NOT_SPACE)
        h = tk.word_hashes(data, s, e)
        g, at = tk.grams(h, K), tk.bounds(row, hi - lo)
        for r in range(hi - lo):
            a, b = at[r], at[r + 1]
            if b - a >= K:
                yield lo + r, np.unique(g[a : b - K + 1])
            elif b > a:
                yield lo + r, tk.grams(h[a:b], int(b - a))


def node_key(own: np.ndarray) -> int:
    """Signed 64-bit key of a set."""
    with np.errstate(over="ignore"):
        return int(tk.mix(np.array([tk.mix(own.copy()).sum(dtype=np.uint64) + np.uint64(own.size)], np.uint64)).view(np.int64)[0])


def parity(own: np.ndarray, bits: int) -> bytes:
    """Bit i: whether an odd number of shingles fall on i."""
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def parity_bits(n: int) -> int:
    """Four bits a shingle, in a power of two up to MOST_BITS."""
    return min(MOST_BITS, 1 << max(6, (4 * n - 1).bit_length()))


def difference(a: bytes, b: bytes) -> int:
    """Shingles in which two sets differ at least; the larger bitmap is folded to the size of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while x.size > y.size:
        x = x[: x.size // 2] ^ x[x.size // 2 :]
    while y.size > x.size:
        y = y[: y.size // 2] ^ y[y.size // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


SUMMARY = "doc_id bigint, n bigint, node bigint, bits binary, small binary, bucket int, low binary"
KEPT = "doc_id bigint, n bigint, node bigint, bits binary, small binary, common bigint, count bigint"


def low(own: np.ndarray) -> np.ndarray:
    return own & np.uint64((1 << 8 * COUNTED) - 1)


def _summaries(buckets: int) -> object:
    """(doc_id, n, node, bitmaps) of each row, and (bucket, low) with the low bytes of the sets' first shingles.

    The bitmaps stand in the first row of each node in a task, and its shingles are counted there. A
    shingle is repeated as often as sets of a chunk have it, but no more often than makes it common.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SUMMARY.split(", ")]
        some, held, seen, at = [], 0, set(), 0

        def firsts() -> pa.RecordBatch:
            every = np.sort(np.concatenate(some))
            keep = np.r_[np.ones(min(COMMON, every.size), bool), every[COMMON:] != every[:-COMMON]]
            every = every[keep]
            bucket = (every % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, raw = bucket[order], np.ascontiguousarray(every[order].view(np.uint8).reshape(-1, 8)[:, :COUNTED]).tobytes()
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            stop = np.r_[first[1:], bucket.size]
            n = first.size
            lows = [raw[COUNTED * a : COUNTED * b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays(
                [
                    *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())), pa.array(bucket[first]),
                    pa.array(lows, pa.binary())
                ],
                names=names
            )

        for batch in batches:
            bits: list[bytes | None] = [None] * batch.num_rows
            little: list[bytes | None] = [None] * batch.num_rows
            n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for r, own in shingle_sets(batch):
                n[r], node[r] = own.size, node_key(own)
                if node[r] not in seen:
                    seen.add(node[r])
                    some.append(low(own[: 2 * prefix(own.size)]))
                    held += some[-1].size
                    if held > HELD // 2:
                        yield firsts()
                        some, held = [], 0
                    bits[r], little[r] = parity(own, parity_bits(own.size)), parity(own, SMALL_BITS)
            spread = pa.array(((at + np.arange(n.size)) % buckets).astype(np.int32))
            at += n.size
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n), pa.array(node), pa.array(bits, pa.binary()), pa.array(little, pa.binary()), spread,
                    pa.nulls(n.size, pa.binary())
                ],
                names=names
            )
        if some:
            yield firsts()

    return run


@lean
def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents as they are, and (common, count) of the shingles of a bucket that COMMON sets or more have."""
    names = [x.split()[0] for x in KEPT.split(", ")]
    held: list[bytes] = []
    last = None

    def counted_() -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(held), np.uint8).reshape(-1, COUNTED)
        every = np.zeros((len(raw), 8), np.uint8)
        every[:, :COUNTED] = raw
        every = np.sort(every.view(np.uint64).ravel())
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        count = np.diff(np.r_[first, every.size])
        keep = count >= COMMON
        k = int(keep.sum())
        return pa.RecordBatch.from_arrays(
            [
                *(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())),
                pa.array(every[first][keep].view(np.int64)), pa.array(count[keep])
            ],
            names=names
        )

    for batch in batches:
        doc = pc.is_null(batch.column("low"))
        rows = batch.filter(doc)
        yield pa.RecordBatch.from_arrays([*rows.columns[:5], pa.nulls(rows.num_rows, pa.int64()), pa.nulls(rows.num_rows, pa.int64())], names=names)
        rest = batch.filter(pc.invert(doc))
        for bucket, blob in zip(rest.column("bucket").to_pylist(), rest.column("low").to_pylist(), strict=True):
            if held and bucket != last:
                yield counted_()
                held = []
            held.append(blob)
            last = bucket
    if held:
        yield counted_()


def _postings(common) -> object:
    """First shingles of each set in the global order: (shingle, node, n, pos, rare)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for batch in batches:
            seen, cols, held = set(), [], 0
            for _, own in shingle_sets(batch):
                node = node_key(own)
                if node in seen:
                    continue
                seen.add(node)
                if held > HELD // 4:
                    yield _entries(cols)
                    cols, held = [], 0
                if known.size:
                    by = low(own)
                    late = known[np.minimum(np.searchsorted(known, by), known.size - 1)] == by
                    own = np.concatenate([own[~late], own[late]])
                    rare = own.size - int(late.sum())
                else:
                    rare = own.size
                p = prefix(own.size)
                held += p
                cols.append(
                    (
                        own[:p].view(np.int64), np.full(p, node), np.full(p, own.size, np.int32), np.arange(p, dtype=np.int32),
                        np.full(p, rare, np.int32)
                    )
                )
            if cols:
                yield _entries(cols)

    return run


def _entries(cols: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*cols, strict=True)], names=["shingle", "node", "n", "pos", "rare"])


POSTING = "shingle bigint, node bigint, n int, pos int, rare int"
LIST = POSTING + ", size int, first bigint"


def _runs(batches: Iterator[pa.RecordBatch], key: str = "shingle") -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole groups of a key, from batches in which its equal values stand together, about a batch at a time."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        cols = {f.name: c.to_numpy(zero_copy_only=False) for f, c in zip(batch.schema, batch.columns, strict=True)}
        if rest is not None:
            cols = {k: np.concatenate([rest[k], v]) for k, v in cols.items()}
        if not len(cols[key]):
            continue
        other = np.flatnonzero(cols[key] != cols[key][-1])
        at = int(other[-1]) + 1 if other.size else 0
        if at:
            yield {k: v[:at] for k, v in cols.items()}
        rest = {k: v[at:] for k, v in cols.items()}
    if rest is not None and len(rest[key]):
        yield rest


@lean
def _shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """List entries of shingles that two nodes or more have in their prefixes, with the list's size and smallest node."""
    for c in _runs(batches):
        s = c["shingle"]
        new = np.r_[True, (s[1:] != s[:-1]) | (c["node"][1:] != c["node"][:-1])]
        c = {k: v[new] for k, v in c.items()}
        s = c["shingle"]
        begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[begin, s.size])
        c["size"] = np.repeat(size, size).astype(np.int32)
        c["first"] = np.repeat(np.minimum.reduceat(c["node"], begin), size)
        keep = c["size"] > 1
        if keep.any():
            names = [x.split()[0] for x in LIST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c[x][keep]) for x in names], names=names)


@lean
def _node_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, m, prefix_map) from list entries sorted by node: the number of entries, and their parity if the set is large."""
    for c in _runs(batches, "node"):
        first = np.flatnonzero(np.r_[True, c["node"][1:] != c["node"][:-1]])
        m = np.diff(np.r_[first, c["node"].size])
        maps = [parity(c["shingle"][i : i + k].view(np.uint64), SMALL_BITS) if c["n"][i] > LARGE else None for i, k in zip(first, m, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c["node"][first]), pa.array(m.astype(np.int32)), pa.array(maps, pa.binary())], names=["node", "m", "prefix_map"]
        )


def size_class(n: np.ndarray) -> np.ndarray:
    """Sizes of one class differ by less than the threshold allows."""
    return np.floor(np.log(n) / np.log(DEN / NUM) + 1e-9).astype(np.int64)


def _possible(na: np.ndarray, nb: np.ndarray, pa_: np.ndarray, pb_: np.ndarray) -> np.ndarray:
    """Whether sizes and positions of a common shingle allow a link."""
    na, nb, pa_, pb_ = (x.astype(np.int64) for x in (na, nb, pa_, pb_))
    return (np.minimum(na, nb) * DEN >= np.maximum(na, nb) * NUM) & (np.minimum(pa_, pb_) + np.minimum(na - pa_, nb - pb_) >= need(na, nb))


@lean
def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of short lists (short), and of each size class of a long list those with its leader and the leader below."""
    out: list[tuple[np.ndarray, ...]] = []
    for c in _runs(batches):
        s, kind, brief = c["shingle"], size_class(c["n"].astype(float)), c["size"] < LONG
        order = np.lexsort((c["node"], c["rare"] / c["n"], kind, s))
        s, kind, brief, c = s[order], kind[order], brief[order], {k: v[order] for k, v in c.items()}
        first = np.r_[True, (s[1:] != s[:-1]) | (kind[1:] != kind[:-1])]
        at = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        # the leader of the own class, and that of the class below where it exists in the same list
        pairs = [(at[group], np.arange(s.size)), (at[np.maximum(group - 1, 0)], np.arange(s.size))]
        found = []
        for i, (a, b) in enumerate(pairs):
            ok = ~brief & (a != b) & (s[a] == s[b]) & (kind[b] - kind[a] == i)
            found.append((a[ok], b[ok]))
        for d in range(1, LONG):
            a = np.flatnonzero((s[d:] == s[:-d]) & brief[d:])
            found.append((a, a + d))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        ok = _possible(c["n"][a], c["n"][b], c["pos"][a], c["pos"][b])
        a, b = a[ok], b[ok]
        swap = c["node"][a] > c["node"][b]
        a, b, short = np.where(swap, b, a), np.where(swap, a, b), brief[b]
        out.append((c["node"][a], c["node"][b], c["n"][a], c["n"][b], c["pos"][a], c["pos"][b], np.ones(a.size, np.int32), short))
        if sum(x[0].size for x in out) > HELD // 8:
            yield _pair_batch(_summed(out, True), "short")
            out = []
    if out:
        yield _pair_batch(_summed(out, True), "short")


FIRST = "a bigint, b bigint, na int, nb int, pa int, pb int, c int, short boolean"
#: size of the overlap that a pair's common prefix shingles and last common positions still allow
BOUND = "c + least(na - pa - 1, nb - pb - 1)"
NEED = f"ceil((na + nb) * {NUM} / {NUM + DEN})"


def counted(pairs: DataFrame, flag: str) -> DataFrame:
    """One row per pair that its count allows: c common prefix shingles, the last common positions, and whether any row has the flag."""
    each = [
        F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.sum("c").alias("c"),
        F.bool_or(flag).alias(flag)
    ]
    return pairs.groupBy("a", "b").agg(*each).withColumn("bound", F.expr(BOUND))


def _sets(wanted) -> object:
    """(node, set) of the nodes in a bitmap, once a batch."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = wanted.value
        for batch in batches:
            nodes, sets, seen = [], [], set()
            for _, own in shingle_sets(batch):
                node = node_key(own)
                if node not in seen and in_bloom(bitmap, np.array([node], np.int64).view(np.uint64))[0]:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "own"])

    return run


@lean
def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(batch.num_rows, np.int32)
        last, a = None, np.zeros(0, np.uint64)
        for i, (x, y, key) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), batch.column("a").to_pylist(), strict=True)):
            if key != last:
                a, last = np.frombuffer(x.as_buffer(), np.uint64), key
            b = np.frombuffer(y.as_buffer(), np.uint64)
            small, large = (a, b) if a.size < b.size else (b, a)
            at = np.searchsorted(large, small)
            at[at == large.size] = 0
            out[i] = np.count_nonzero(large[at] == small)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), batch.column("na"), batch.column("nb"), pa.array(out)], names=["a", "b", "na", "nb", "overlap"]
        )


@lean
def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their bitmaps leave possible."""
    for batch in batches:
        apart = [difference(x.as_py(), y.as_py()) for x, y in zip(batch.column("bits_a"), batch.column("bits_b"), strict=True)]
        na, nb = batch.column("na").to_numpy().astype(np.int64), batch.column("nb").to_numpy().astype(np.int64)
        keep = pa.array((na + nb - np.array(apart, np.int64)) // 2 >= need(na, nb))
        yield batch.select(["a", "b", "na", "nb"]).filter(keep)


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(a, b, na, nb, overlap) of the pairs that bitmaps leave possible, computed on the sets; a table."""
    spark = docs.sparkSession
    bits = nodes.select(F.col("node").alias("a"), F.col("bits").alias("bits_a"))
    both = pairs.select("a", "b", "na", "nb").join(bits, "a").join(bits.toDF("b", "bits_b"), "b")
    pairs = cut(both.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(_near, "a bigint, b bigint, na int, nb int"), "near")
    named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    bitmap = spark.sparkContext.broadcast(bloom(named, "node"))
    sets = docs.select("text").mapInArrow(_sets(bitmap), "node bigint, own binary")
    sets = cut(sets.join(named, "node", "left_semi").dropDuplicates(["node"]), "sets")
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("own").alias("set_b")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("own").alias("set_a")), "a")
    out = cut(both.select("a", "b", "na", "nb", "set_a", "set_b").mapInArrow(_overlaps, "a bigint, b bigint, na int, nb int, overlap int"), name)
    free(pairs, sets)
    return out


def _unlike_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each list whose nodes are not all connected."""
    for c in _runs(batches):
        s = c["shingle"]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[first, s.size])
        c["maps"] = np.frombuffer(b"".join(c.pop("small")), np.uint64).reshape(s.size, SMALL_BITS // 64)
        for lo, k in zip(first, size, strict=True):
            part = {x: v[lo : lo + k] for x, v in c.items()}
            if not (part["label"] == part["label"][0]).all():
                yield part


TREE = "a bigint, b bigint, na int, nb int"


def heaviest(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The edges (a, b, na, nb, weight, label of a, label of b) of a forest of labels, the heaviest first at each of them."""
    order = np.lexsort((rows[1], rows[0], -rows[4]))
    rows = tuple(x[order] for x in rows)
    ends = np.unique(np.concatenate(rows[5:]), return_inverse=True)[1].reshape(2, -1)
    top, kept = np.arange(int(ends.max()) + 1 if ends.size else 0), np.zeros(order.size, bool)
    while True:
        x, y = top[ends[0]], top[ends[1]]
        live = np.flatnonzero(x != y)
        if not live.size:
            return tuple(v[kept] for v in rows)
        # edges stand by weight: the first of each label is its best
        label, at = np.unique(np.stack([x[live], y[live]], 1).ravel(), return_index=True)
        best = live[at // 2]
        kept[best] = True
        to = np.arange(top.size)
        to[label] = np.where(x[best] == label, y[best], x[best])
        both = to[to] == np.arange(to.size)
        to[both] = np.minimum(to, np.arange(to.size))[both]
        while (to[to] != to).any():
            to = to[to]
        top = to[top]


@lean
def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs of a task's long lists that are not connected yet a forest of likely links: fewer than nodes, whatever the pairs."""
    out: list[tuple[np.ndarray, ...]] = []
    held = 0
    for part in _unlike_lists(batches):
        for pairs in _long_pairs(part, True):
            out.append(pairs)
            held += pairs[0].size
            if held > HELD // 8:
                out = [heaviest(tuple(np.concatenate(x) for x in zip(*out, strict=True)))]
                held = 0
    if out:
        a, b, na, nb, *_ = heaviest(tuple(np.concatenate(x) for x in zip(*out, strict=True)))
        swap = a > b
        columns = (np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "na", "nb"])


@lean
def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of long lists that are not connected yet, after index and answer skipping.

    Rows: (a, b, na, nb, pa, pb, c, sure) with a < b, summed over the lists of a task: the last common
    positions, the number of lists, and whether a leader's answers accept the pair.
    """
    out: list[tuple[np.ndarray, ...]] = []
    held = 0
    for part in _unlike_lists(batches):
        for pairs in _long_pairs(part):
            out.append(pairs)
            held += pairs[0].size
            if held > HELD // 8:
                out = [_summed(out)]
                held = out[0][0].size
                if held > HELD // 16:
                    yield _pair_batch(out[0])
                    out, held = [], 0
    if out:
        yield _pair_batch(_summed(out))


SUMMED = "a bigint, b bigint, na int, nb int, pa int, pb int, c int, sure boolean"


def _summed(out: list[tuple[np.ndarray, ...]], apart: bool = False) -> tuple[np.ndarray, ...]:
    """One row per pair, or per pair and flag."""
    a, b, na, nb, pa_, pb_, c, sure = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((sure, b, a))
    a, b = a[order], b[order]
    other = sure[order][1:] != sure[order][:-1] if apart else False
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | other]) if a.size else np.zeros(0, np.int64)
    if not a.size:
        return a, b, na, nb, pa_, pb_, c, sure
    most = lambda x: np.maximum.reduceat(x[order], first)
    return a[first], b[first], na[order][first], nb[order][first], most(pa_), most(pb_), np.add.reduceat(c[order], first).astype(np.int32), np.logical_or.reduceat(sure[order], first)


def _pair_batch(row: tuple[np.ndarray, ...], flag: str = "sure") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["a", "b", "na", "nb", "pa", "pb", "c", flag])


def _pairs(c: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, weighed: bool = False) -> list[tuple[np.ndarray, ...]]:
    """What is left of the entry pairs (a, b) of one list each: none or one tuple of columns.

    weighed gives (a, b, na, nb, weight, label of a, label of b), the weight being the share of the largest overlap that bitmaps and leaders allow.
    """
    ok = c["label"][a] != c["label"][b]
    a, b = a[ok], b[ok]
    n, pos = c["n"], c["pos"]
    na, nb = n[a].astype(np.int64), n[b].astype(np.int64)
    want = need(na, nb)
    ok = _possible(na, nb, pos[a], pos[b])
    i = np.flatnonzero(ok)
    apart = np.bitwise_count(c["maps"][a[i]] ^ c["maps"][b[i]]).sum(axis=1)
    m, k = c["m"][a[i]].astype(np.int64), c["m"][b[i]].astype(np.int64)
    both_large, both_small = np.minimum(na[i], nb[i]) > LARGE, np.maximum(na[i], nb[i]) <= LARGE
    # common prefix shingles at most; of the set whose prefix ends first all others may be common
    common = np.minimum(m, k)
    common = np.where(both_large, np.minimum(common, (m + k - apart) // 2), common)
    beyond = np.maximum(-(-na[i] * NUM // DEN), -(-nb[i] * NUM // DEN)) - 1
    ok[i] = (common + beyond >= want[i]) & (~both_small | ((na[i] + nb[i] - apart) // 2 >= want[i]))
    # what a common leader's overlaps say
    led = (c["leader"][a] == c["leader"][b]) & (c["overlap"][a] >= 0) & (c["overlap"][b] >= 0)
    va, vb = c["overlap"][a].astype(np.int64), c["overlap"][b].astype(np.int64)
    sure = led & (va + vb - c["leader_n"][a] >= want)
    ok &= ~led | (np.minimum(va, vb) + np.minimum(na - va, nb - vb) >= want)
    if not ok.any():
        return []
    if weighed:
        most = np.minimum(na, nb)
        most[i] = np.where(both_small, np.minimum(most[i], (na[i] + nb[i] - apart) // 2), most[i])
        most = np.where(led, np.minimum(most, np.minimum(va, vb) + np.minimum(na - va, nb - vb)), most)
        weight = np.where(sure, 2.0, most / (na + nb - most))[ok]
        a, b = a[ok], b[ok]
        return [(c["node"][a], c["node"][b], n[a], n[b], weight, c["label"][a], c["label"][b])]
    swap = c["node"][a] > c["node"][b]
    a, b, sure = np.where(swap, b, a)[ok], np.where(swap, a, b)[ok], sure[ok]
    return [(c["node"][a], c["node"][b], n[a], n[b], pos[a], pos[b], np.ones(a.size, np.int32), sure)]


def _long_pairs(c: dict[str, np.ndarray], weighed: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of a long list, by blocks of neighbours in size and position."""
    order = np.lexsort((c["pos"], c["n"]))
    c = {k: v[order] for k, v in c.items()}
    n, pos = c["n"].astype(np.int64), c["pos"].astype(np.int64)
    starts = np.arange(0, n.size, BLOCK)
    most_n, least_n = n[np.minimum(starts + BLOCK, n.size) - 1], n[starts]
    most_p, least_p = np.maximum.reduceat(pos, starts), np.minimum.reduceat(pos, starts)
    for x, lo in enumerate(starts):
        for y in range(x, starts.size):
            if least_n[y] * NUM > most_n[x] * DEN:
                break
            # positions too far apart leave too little room for a common part
            apart = max(least_p[x] - most_p[y], least_p[y] - most_p[x], 0)
            if max(most_n[x], most_n[y]) - apart < need(least_n[x], least_n[y]):
                continue
            i, j = np.arange(lo, min(lo + BLOCK, n.size)), np.arange(starts[y], min(starts[y] + BLOCK, n.size))
            a, b = (z.ravel() for z in np.meshgrid(i, j, indexing="ij"))
            yield from _pairs(c, a[a < b], b[a < b], weighed)


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, n, node, root): each row's set and the name of its component, null for empty sets; a table."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = cut(docs.mapInArrow(_summaries(buckets), SUMMARY).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_common, KEPT), "summaries")
    summary = both.where("common is null").select("doc_id", "n", "node")
    nodes = both.where("bits is not null").select("node", "bits", "small").dropDuplicates(["node"])
    common = both.where("common is not null").orderBy(F.desc("count"), "common").limit(MOST_COMMON).select("common").toArrow()
    known = spark.sparkContext.broadcast(np.sort(common.column("common").to_numpy().view(np.uint64)))
    postings = docs.select("text").mapInArrow(_postings(known), POSTING)
    lists = cut(postings.repartition("shingle").sortWithinPartitions("shingle", "n", "node").mapInArrow(_shared_lists, LIST), "lists")
    good = f"overlap * {NUM + DEN} >= (na + nb) * {NUM}"

    first = cut(lists.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(_first_pairs, FIRST), "first-pairs")
    led = counted(first, "short").where(f"bound >= {NEED}")
    # each node's best candidate; the side that is central stands in "a" for long lists as for short ones
    ends = led.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("na").alias("nx"), F.col("nb").alias("ny"), "bound")
    ends = ends.union(led.select("b", "a", "nb", "na", "bound"))
    best = ends.groupBy("y").agg(F.max_by(F.struct("x", "nx", "ny"), F.struct("bound", "x")).alias("z"))
    stars = cut(best.select(F.col("z.x").alias("a"), F.col("y").alias("b"), F.col("z.nx").alias("na"), F.col("z.ny").alias("nb")), "star-pairs")
    star = verified(stars, docs, nodes, "star")
    # what these links connect needs no further pair
    roots = components(star.where(good).select("a", "b"))

    known_of = star.select(F.col("b").alias("node"), F.col("a").alias("leader"), F.col("na").alias("leader_n"), "overlap")
    stats = lists.select("shingle", "node", "n").repartition("node").sortWithinPartitions("node").mapInArrow(
        _node_stats, "node bigint, m int, prefix_map binary"
    )
    long = lists.where(f"size >= {LONG}").drop("size", "rare")
    deals = long.groupBy("first").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("deals")).where("deals > 1")

    def dealt(roots: DataFrame) -> DataFrame:
        told = long.join(stats, "node").join(nodes.select("node", "small"), "node").join(roots, "node", "left").join(known_of, "node", "left").join(small(deals), "first", "left").select(
            "shingle", "node", "n", "pos", F.coalesce("root", "node").alias("label"), F.coalesce("leader", F.lit(0).cast("bigint")).alias("leader"), F.coalesce("leader_n", F.lit(0)).alias("leader_n"), F.coalesce("overlap", F.lit(-1)).alias("overlap"), "m", F.coalesce("prefix_map", "small").alias("small"),
            F.xxhash64("first", F.pmod("shingle", F.coalesce("deals", F.lit(1)))).alias("deal"))
        return told.repartition("deal").sortWithinPartitions("deal", "shingle").drop("deal")

    # the likeliest links of what the stars left apart, so that a group that its leader does not reach is not compared with all of it
    tree = cut(dealt(roots).mapInArrow(_tree, TREE).dropDuplicates(["a", "b"]), "tree")
    if tree.limit(1).count():
        grown = verified(tree, docs, nodes, "grown")
        roots = components(star.union(grown).where(good).select("a", "b"))
    rest = dealt(roots).mapInArrow(_rest, SUMMED)
    rest = counted(rest.union(first.where("short").withColumn("short", F.lit(False))), "sure").where(f"sure or bound >= {NEED}")
    for side in ("a", "b"):
        rest = rest.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(tree.select("a", "b")).distinct()
    rest = rest.where("coalesce(root_a, a) <> coalesce(root_b, b)").join(tried, ["a", "b"], "left_anti")
    rest = cut(rest.select("a", "b", "na", "nb", "sure", F.coalesce("root_a", "a").alias("root_a"), F.coalesce("root_b", "b").alias("root_b")), "rest")
    free(first, lists, stars, star, sweep=True)
    edges = rest.where("sure").select("root_a", "root_b")
    unsure = rest.where("not sure")
    if unsure.limit(1).count():
        links = verified(unsure, docs, nodes, "links").where(good).select("a", "b").join(rest, ["a", "b"])
        edges = edges.union(links.select("root_a", "root_b"))
    more = components(edges.toDF("a", "b")).toDF("root", "root2")
    named = summary.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(more, "root", "left")
    members = cut(named.select("doc_id", "n", "node", F.when(F.col("n") > 0, F.coalesce("root2", "root")).alias("root")), "members")
    free(both, rest, sweep=True)
    return members


def _meet(members: DataFrame, least: DataFrame) -> DataFrame:
    """members with the columns of least, one row per root: a hot root's members meet copies of its row in several tasks."""
    spread = least.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    turn = F.pmod(F.xxhash64("doc_id", "node"), F.lit(COPIES)).cast("int")
    return members.withColumn("turn", turn).join(spread, ["root", "turn"], "left").drop("turn")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    members = labelled(docs)
    several = members.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")).where("size > 1")
    out = _meet(members, several.select("root", "first"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


@lean
def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the key of its set, 0 where it is empty."""
    for batch in batches:
        node = np.zeros(batch.num_rows, np.int64)
        text = pc.struct_field(batch.column("j_in"), "text")
        for r, own in shingle_sets(pa.RecordBatch.from_arrays([text], names=["text"])):
            node[r] = node_key(own)
        yield pa.RecordBatch.from_arrays([batch.column("j_in"), pa.array(node)], names=["j_in", "j_node"])


def representatives(docs: DataFrame, most_broadcast: int = 1 << 20) -> DataFrame:
    """The rows of docs, all columns, of one document of each group: the smallest doc_id, a null one last.

    Rows without a set stay. Of repeated rows one stays. Where a doc_id stands on several rows or is
    null, rows are told apart by their sets, so a text that only shares its doc_id with a copy stays.
    """
    members = labelled(docs)
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    least = members.where("root is not null").groupBy("root").agg(F.min(key).alias("least"), F.count("*").alias("size")).where("size > 1")
    met = _meet(members, least.select("root", "least")).where(F.col("least").isNotNull() & (key != F.col("least")))
    gone = cut(met.select(F.col("doc_id").alias("j_doc"), F.col("node").alias("j_gone")).distinct(), "gone")
    again = members.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("j_again"))
    ids = small(gone.select("j_doc").where("j_doc is not null").distinct(), most_broadcast)
    rows, dropped = docs.select(F.struct(*docs.columns).alias("j_in")), F.expr("j_in.doc_id = j_doc")
    if not again.limit(1).count():
        return rows.join(ids, dropped, "left_anti").select("j_in.*")
    again, several = small(again, most_broadcast), F.expr("j_in.doc_id <=> j_again")
    single = rows.join(again, several, "left_anti").join(ids, dropped, "left_anti")
    rest = rows.join(again, several, "left_semi")
    rest = rest.mapInArrow(_nodes, f"j_in {rest.schema['j_in'].dataType.simpleString()}, j_node bigint").withColumn("j_id", F.col("j_in.doc_id"))
    rest = rest.dropDuplicates(["j_id", "j_node"]).join(gone, F.expr("j_id <=> j_doc and j_node = j_gone"), "left_anti")
    return single.unionByName(rest.select("j_in")).select("j_in.*")
