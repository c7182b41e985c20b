"""Benchmark decontamination by winnowing.

Every text is fingerprinted by winnowing: of the k-gram hashes in each window of w consecutive
k-grams the smallest is kept. A span of k + w - 1 words that two texts share has the same window
of hashes in both, hence one fingerprint in common at the same place of the span. Fingerprints of
documents and test items are joined, and each hit is extended word by word along its alignment,
so only word-exact spans count.

Null texts and texts without a word have no words and are not contaminated. Repeated rows are
judged each on its own; other columns are carried along. Test items with a null text or without a
word are never hit; an item_id that occurs in several rows counts once. Words of items with a null
item_id are hit like others, but such items are not counted or listed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import tokens as tk
from newsloom.llm.shared import cut, lean, small_batches

#: Words of a window, of a fingerprinted gram, and characters of a benchmark whose fingerprints are broadcast.
SPAN, K, MOST_CHARS = 13, 5, 32 << 20
#: bytes of text that are worked on at once; a dozen arrays of eight bytes for each are held meanwhile
CHUNK = 1 << 18


def profile(span: int) -> tuple[int, int]:
    """k and w for which any shared run of `span` words has a common fingerprint."""
    k = min(K, span)
    return k, span - k + 1


def minima(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions that winnowing keeps: the first smallest of each window of w hashes."""
    if grams.size < w:
        return np.zeros(0, np.int64)
    if w == 1:
        return np.arange(grams.size)
    return np.unique(sliding_window_view(grams, w).argmin(axis=1) + np.arange(grams.size - w + 1))


def shifts(a: np.ndarray, b: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """The distinct differences a - b; where there are very many pairs, by one pass for each place of the shorter side."""
    if a.size * b.size <= most:
        return np.unique(a[:, None] - b[None, :])
    least = int(a.min() - b.max())
    there = np.zeros(int(a.max() - b.min()) - least + 1, bool)
    if a.size < b.size:
        for x in a:
            there[x - b - least] = True
    else:
        for y in b:
            there[a - y - least] = True
    return np.flatnonzero(there) + least


class Bench:
    """Fingerprints of test items, by span length: 13, or an item's own if shorter."""

    def __init__(self, items: list[tuple[str | None, str]], span: int = SPAN):
        self.ids: list[str | None] = []
        self.words: list[np.ndarray] = []
        self.spans: list[int] = []
        prints: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for item_id, text in items:
            data = tk.LOWER[np.frombuffer(text.encode(), np.uint8)]
            s, e, _ = tk.spans(data, np.array([0, data.size]), tk.ALNUM)
            if not s.size:
                continue
            h = tk.word_hashes(data, s, e)
            n, own = len(self.ids), min(span, h.size)
            self.ids.append(item_id)
            self.words.append(h)
            self.spans.append(own)
            k, w = profile(own)
            g = tk.grams(h, k)
            prints[own] += [(int(g[p]), n, int(p)) for p in minima(g, w)]
        self.prints = {}
        for own, rows in prints.items():
            rows.sort()
            self.prints[own] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, list[str], bool]:
        """Hit flag of each word, the named items with an occurring window, and whether any item has one."""
        flag, found = np.zeros(words.size, bool), set()
        for own, (keys, items, places) in self.prints.items():
            k, w = profile(own)
            g = tk.grams(words, k)
            at = minima(g, w)
            at = at[np.isin(g[at], keys)]
            if not at.size:
                continue
            # alignments by item: many for few distinct prints, as in runs of a word, so they are formed per print
            tried: dict[int, list[np.ndarray]] = defaultdict(list)
            order = np.argsort(g[at], kind="stable")
            prints, first = np.unique(g[at][order], return_index=True)
            for key, mine in zip(prints, np.split(at[order], first[1:]), strict=True):
                lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
                for item in np.unique(items[lo:hi]):
                    tried[int(item)].append(shifts(mine, places[lo:hi][items[lo:hi] == item]))
            for item, parts in tried.items():
                for shift in np.unique(np.concatenate(parts)).tolist():
                    if self._extend(words, flag, item, shift, own):
                        found.add(item)
        return flag, sorted({self.ids[i] for i in found if self.ids[i] is not None}), bool(found)

    def _extend(self, words: np.ndarray, flag: np.ndarray, item: int, shift: int, own: int) -> bool:
        """Mark the equal runs of `own` words or more where item word 0 stands at `shift`."""
        test = self.words[item]
        lo, hi = max(0, shift), min(words.size, shift + test.size)
        same = np.zeros(hi - lo + 2, np.int8)
        same[1:-1] = words[lo:hi] == test[lo - shift : hi - shift]
        turn = np.diff(same)
        hit = False
        for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True):
            if b - a >= own:
                flag[lo + a : lo + b] = hit = True
        return hit


def _scan(bench) -> object:
    """mapInArrow function: adds what it finds to w_words, w_hits, w_items and w_marks (hit words as bits)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bench.value
        keys = {own: np.unique(p[0]) for own, p in b.prints.items()}
        for batch in batches:
            n_words, hits, items, marks = [], batch.column("w_hits").to_pylist(), batch.column("w_items").to_pylist(), batch.column("w_marks").to_pylist()
            for lo, hi, data, off in tk.chunks(pc.struct_field(batch.column("w_in"), "text"), CHUNK):
                data = tk.LOWER[data]
                s, e, row = tk.spans(data, off, tk.ALNUM)
                h = tk.word_hashes(data, s, e)
                at = tk.bounds(row, hi - lo)
                # a row without any gram in common with a fingerprint has no hit
                maybe = np.zeros(hi - lo, bool)
                for own, known in keys.items():
                    g = tk.grams(h, profile(own)[0])
                    i = np.minimum(np.searchsorted(known, g), known.size - 1)
                    maybe[row[np.flatnonzero(known[i] == g)]] = True
                n_words += np.diff(at).tolist()
                for r in np.flatnonzero(maybe):
                    words = h[at[r] : at[r + 1]]
                    flag, ids, some = b.hits(words)
                    if some:
                        if old := marks[lo + r]:
                            flag |= np.unpackbits(np.frombuffer(old, np.uint8), count=words.size).astype(bool)
                        marks[lo + r], hits[lo + r] = np.packbits(flag).tobytes(), int(flag.sum())
                        items[lo + r] = sorted({*ids, *items[lo + r]})
            new = {
                "w_words": pa.array(n_words, pa.int64()), "w_hits": pa.array(hits, pa.int64()), "w_items": pa.array(items, pa.list_(pa.string())),
                "w_marks": pa.array(marks, pa.binary())
            }
            yield pa.RecordBatch.from_arrays([new.get(f.name, c) for c, f in zip(batch.columns, batch.schema, strict=True)], names=batch.schema.names)

    return run


def _start(docs: DataFrame) -> DataFrame:
    """w_in (a struct of all columns of docs) with nothing found yet."""
    return docs.select(
        F.struct(*docs.columns).alias("w_in"), F.lit(0).cast("bigint").alias("w_words"), F.lit(0).cast("bigint").alias("w_hits"),
        F.array().cast("array<string>").alias("w_items"), F.lit(None).cast("binary").alias("w_marks")
    )


@lean
def _bench_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, own, print) of each test item: its fingerprints, by the length of its windows."""
    for batch in batches:
        for key, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for own, (keys, _, _) in Bench([(None, text)]).prints.items():
                p = np.unique(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(p.size, key)), pa.array(np.full(p.size, own, np.int32)), pa.array(p)], names=["item", "own", "print"]
                )


def _doc_prints(lengths: list[int]) -> object:
    """(doc, own, print) of each document, for every length of windows."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("doc").to_numpy()
            for lo, hi, data, off in tk.chunks(batch.column("text"), CHUNK):
                s, e, row = tk.spans(tk.LOWER[data], off, tk.ALNUM)
                h, at = tk.word_hashes(tk.LOWER[data], s, e), None
                at = tk.bounds(row, hi - lo)
                for r in range(hi - lo):
                    words = h[at[r] : at[r + 1]]
                    for own in lengths:
                        k, w = profile(own)
                        g = tk.grams(words, k)
                        p = np.unique(g[minima(g, w)]).view(np.int64)
                        if p.size:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(p.size, key[lo + r])), pa.array(np.full(p.size, own, np.int32)), pa.array(p)],
                                names=["doc", "own", "print"]
                            )

    return run


@lean
def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents beside the test items with a common fingerprint (w_bench): what _scan finds, for one document's items."""
    for batch in batches:
        texts = pc.struct_field(batch.column("w_in"), "text")
        n_words, hits, items = [], [], []
        for text, bench in zip(texts, batch.column("w_bench").to_pylist(), strict=True):
            data = tk.LOWER[np.frombuffer((text.as_py() or "").encode(), np.uint8)]
            s, e, _ = tk.spans(data, np.array([0, data.size]), tk.ALNUM)
            n_words.append(s.size)
            flag, ids, _ = Bench([(x["item_id"], x["text"]) for x in bench]).hits(tk.word_hashes(data, s, e)) if bench else (np.zeros(0), [], False)
            hits.append(int(flag.sum()))
            items.append(ids)
        yield pa.RecordBatch.from_arrays(
            [batch.column("w_in"), pa.array(n_words, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string()))],
            names=["w_in", "w_words", "w_hits", "w_items"]
        )


def scan(docs: DataFrame, benchmark: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """w_in (a struct of all columns of docs), w_words, w_hits, w_items (sorted) of every row.

    A benchmark of at most `most` characters is fingerprinted once and sent to all workers: one pass over
    the documents and no shuffle. The fingerprints of a larger one are joined with those of the documents;
    each document then meets only the items with which it shares one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").dropDuplicates()
    size = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    out = _start(docs)
    if size <= most:
        held = spark.sparkContext.broadcast(Bench([(r.item_id, r.text) for r in bench.toLocalIterator()]))
        return out.mapInArrow(_scan(held), out.schema).select("w_in", "w_words", "w_hits", "w_items")
    bench = cut(bench.withColumn("item", F.xxhash64("item_id", "text")), "bench")
    tests = cut(bench.select("item", "text").mapInArrow(_bench_prints, "item bigint, own int, print bigint"), "bench-prints")
    lengths = sorted(r.own for r in tests.select("own").distinct().collect())  # SPAN numbers at most
    mine = docs.select(F.xxhash64("text").alias("doc"), "text").where("text is not null").mapInArrow(
        _doc_prints(lengths), "doc bigint, own int, print bigint"
    ).distinct()
    met = mine.join(tests, ["own", "print"]).select("doc", "item").distinct()
    given = cut(met.join(bench, "item").groupBy(F.col("doc").alias("w_key")).agg(F.collect_list(F.struct("item_id", "text")).alias("w_bench")), "met")
    rows = docs.select(
        F.struct(*docs.columns).alias("w_in"), F.xxhash64("text").alias("w_doc")
    ).join(given, F.col("w_doc") == F.col("w_key"), "left").select("w_in", "w_bench")
    return rows.mapInArrow(_judge, out.drop("w_marks").schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document row."""
    found = scan(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "w_in.doc_id", F.col("w_words").alias("n_words"), F.col("w_hits").alias("n_hit"), F.size("w_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("w_items", ",").cast("binary"), 256).alias("items_sha256"), _bad().alias("contaminated"),
    )


def _bad() -> Column:
    """A twentieth of the words or more is hit."""
    return (F.col("w_hits") > 0) & (F.col("w_hits") * 20 >= F.col("w_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    return scan(docs, benchmark).where(~_bad()).select("w_in.*")
