"""Substring deduplication by recompression.

A round of recompression names, in every text at once, the maximal blocks of equal symbols and of
pairs: with a bit per symbol, the border between neighbours x and y goes if x = y or if x is a
left and y a right symbol. The new name is a hash of what the block holds, so it is global: equal
substrings get equal names in all texts, except for symbols near their ends. A border that is left
after k rounds is decided by a few words around it, its context, which is tracked exactly.

A window of SPAN words is represented by its anchor: the leftmost border of the highest round
whose context lies within the window, named by the two symbols that meet there. Equal windows have
equal anchors. (A window without such a border, as in a long run of one word, is its own anchor.)
Anchors are few, and those that occur once are dropped: a first pass counts their names, a second
sends only windows with a repeated anchor, grouped by anchor, where window hashes are compared. All
occurrences within a chunk are settled before the shuffle, so a passage that a third of the
documents share sends one row a chunk. An anchor that very many different windows share, as a phrase
in many contexts, is split: its windows travel one by one under a key of their own hash, so equal ones
still meet and no task gets the whole anchor. The last step joins the marked windows back to the texts.

Names and window hashes have 64 bits. Null and empty texts have no words. Repeated rows are
occurrences of each other. The bitmap of repeated anchors has a fixed largest size; when it is
full, more windows are sent and the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import tokens as tk
from newsloom.llm.shared import bloom, cut, in_bloom, lean

#: Words of a window, rounds, bytes of a chunk, and runs of windows beyond which an anchor is split.
SPAN, ROUNDS, CHUNK, HOT = 35, 7, 2 << 20, 1 << 12
FAR = np.int64(1 << 40)


def anchors(h: np.ndarray, at: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of words `h`, rows starting at `at`: (first, last + 1) of each run of windows with one
    anchor, the anchor's name, and the hash of every window."""
    n = h.size
    whole = np.zeros(n, bool)
    for a, b in zip(at[:-1], at[1:], strict=True):
        whole[a : b - span + 1] = b - a >= span
    window = np.zeros(n, np.uint64)
    if n >= span:
        window[: n - span + 1] = tk.grams(h, span)
    where, key = np.arange(n, dtype=np.int64), window.copy()
    start, name = np.arange(n, dtype=np.int64), h
    edge = np.zeros(n, bool)
    edge[at[:-1][at[:-1] < n]] = True
    # before the first round every border is one wherever the words stand; a row's ends are certain in no later round
    lo, hi, last = start.copy(), start.copy(), np.int64(n)
    up, down = tk.powers(tk._Q, n + 1)
    for k in range(1, ROUNDS + 1):
        if start.size < 3:
            break
        right = (tk.mix(name ^ np.uint64(k * 0x632BE59BD9B4E019 & tk._M)) >> np.uint64(63)).astype(bool)
        gone = np.zeros(start.size, bool)
        gone[1:] = ((name[1:] == name[:-1]) | (~right[:-1] & right[1:])) & ~edge[1:]
        meet = np.zeros(start.size, np.uint64)
        meet[1:] = tk.mix(name[:-1] * np.uint64(0xA24BAED4963EE407) + name[1:] + np.uint64(k))
        wide_lo, wide_hi, last = np.r_[-FAR, lo[:-1]], np.r_[hi[1:], last], FAR
        keep = np.flatnonzero(~gone)
        total = np.zeros(start.size + 1, np.uint64)
        np.cumsum(name * up[: start.size], out=total[1:])
        stop = np.r_[keep[1:], start.size]
        name = tk.mix((total[stop] - total[keep]) * down[keep] + (stop - keep).astype(np.uint64))
        start, edge, meet = start[keep], edge[keep], meet[keep]
        lo, hi = np.where(edge, -FAR, wide_lo[keep]), np.where(edge, FAR, wide_hi[keep])
        good = np.flatnonzero((lo >= 0) & (hi <= n))
        if not good.size:
            break
        # of the borders whose context starts at window i or later, the first
        count = np.bincount(lo[good], minlength=n)
        first = np.minimum(np.cumsum(count) - count, good.size - 1)
        fits = (lo[good][first] >= np.arange(n)) & (hi[good][first] <= np.arange(n) + span)
        if not fits.any():
            break
        pick = good[first[fits]]
        where[fits], key[fits] = start[pick] + k * FAR, meet[pick]
    w = np.flatnonzero(whole)
    if not w.size:
        return w, w, key[:0], window
    new = np.r_[True, (np.diff(w) > 1) | (where[w][1:] != where[w][:-1])]
    begin = w[new]
    end = np.r_[w[np.flatnonzero(new)[1:] - 1], w[-1]] + 1
    return begin, end, key[begin], window


def _parsed(batch: pa.RecordBatch) -> Iterator[tuple]:
    for lo, hi, data, off in tk.chunks(batch.column("text"), CHUNK):
        s, e, row = tk.spans(data, off, tk.NOT_SPACE)
        h = tk.word_hashes(data, s, e)
        at = tk.bounds(row, hi - lo)
        yield lo, at, row, *anchors(h, at)


@lean
def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for *_, key, _ in _parsed(batch):
            names, count = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(count)], names=["key", "n"])


ROW = "key bigint, doc_id bigint, th bigint, at int, known bigint, sent boolean, windows binary"
MARK = "doc_id bigint, th bigint, at int, mask bigint"


def _windows(repeated, crowded) -> object:
    """A row for each run of windows whose anchor may be repeated: known has a bit for each window that
    its chunk holds twice; windows (hashes) is sent unless earlier runs of the chunk sent them all."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hot = repeated.value, crowded.value
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("th")
            for lo, at, row, begin, end, key, window in _parsed(batch):
                ok = in_bloom(bitmap, key)
                begin, end, key = begin[ok], end[ok], key[ok]
                if not begin.size:
                    continue
                size = end - begin
                first = np.cumsum(size) - size
                run_of = np.repeat(np.arange(size.size), size)
                place = np.arange(run_of.size) - first[run_of]
                held = window[begin[run_of] + place]
                order = np.argsort(held, kind="stable")
                again = held[order][1:] == held[order][:-1]
                twice, later = np.zeros(held.size, bool), np.zeros(held.size, bool)
                twice[order] = np.r_[again, False] | np.r_[False, again]
                later[order] = np.r_[False, again]
                bit = np.uint64(1) << place.astype(np.uint64)
                known = np.bitwise_or.reduceat(np.where(twice, bit, np.uint64(0)), first)
                sent = ~np.logical_and.reduceat(later, first)
                raw = held.tobytes()
                rows = pa.array(lo + row[begin])
                # runs that send nothing need no company
                key = np.where(sent, key, tk.mix(key + begin.astype(np.uint64)))
                split = np.flatnonzero((sent & in_bloom(hot, key))[run_of] & ~later)
                if split.size:
                    run = run_of[split]
                    where = pa.array(lo + row[begin[run]])
                    one = np.arange(split.size + 1, dtype=np.int32) * 8
                    yield pa.RecordBatch.from_arrays([
                        pa.array(tk.mix(key[run] ^ held[split]).view(np.int64)), ids.take(where), hashes.take(where), pa.array(
                            (begin[run] + place[split] - at[row[begin[run]]]).astype(np.int32)
                        ),
                        pa.array(np.zeros(split.size, np.int64)), pa.array(np.ones(split.size, bool)), pa.Array.from_buffers(
                            pa.binary(), split.size, [None, pa.py_buffer(one.tobytes()), pa.py_buffer(held[split].tobytes())]
                        ),
                    ], names=[x.split()[0] for x in ROW.split(", ")])
                    sent &= ~in_bloom(hot, key)
                blobs = [raw[8 * a : 8 * (a + z)] if s else None for a, z, s in zip(first.tolist(), size.tolist(), sent.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)), ids.take(rows), hashes.take(rows), pa.array((begin - at[row[begin]]).astype(np.int32)),
                        pa.array(known.view(np.int64)), pa.array(sent), pa.array(blobs, pa.binary())
                    ],
                    names=[x.split()[0] for x in ROW.split(", ")]
                )

    return run


@lean
def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks from rows sorted by key: windows that another run has too, and those known before."""
    rest: pa.Table | None = None

    def judged(t: pa.Table) -> pa.RecordBatch:
        known = t.column("known").to_numpy().view(np.uint64).copy()
        blobs = t.column("windows").combine_chunks()
        blobs = blobs.chunk(0) if isinstance(blobs, pa.ChunkedArray) else blobs
        off = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
        size = np.diff(off) // 8
        if size.sum():
            held = np.frombuffer(blobs.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint64)
            run_of = np.repeat(np.arange(size.size), size)
            place = (np.arange(held.size) - (np.cumsum(size) - size)[run_of]).astype(np.uint64)
            _, inverse, count = np.unique(held, return_inverse=True, return_counts=True)
            bit = np.where(count[inverse] > 1, np.uint64(1) << place, np.uint64(0))
            np.bitwise_or.at(known, run_of, bit)
        t = t.append_column("mask", pa.array(known.view(np.int64))).filter(pa.array(known > 0)).select(["doc_id", "th", "at", "mask"]).combine_chunks()
        return t.to_batches()[0] if t.num_rows else pa.RecordBatch.from_pylist([], schema=t.schema)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        keys = t.column("key").to_numpy()
        if not keys.size:
            continue
        at = int(np.searchsorted(keys, keys[-1]))
        if at:
            yield judged(t.slice(0, at))
        rest = t.slice(at)
    if rest is not None and rest.num_rows:
        yield judged(rest)


def covered(n: int, marks: list[dict], span: int = SPAN) -> np.ndarray:
    """Flags of n words: within a marked window."""
    step = np.zeros(n + 1, np.int32)
    for m in marks:
        mask, i = m["mask"] & tk._M, m["at"]
        while mask:
            low = (mask & -mask).bit_length() - 1
            width = ((mask >> low) + 1 & ~(mask >> low)).bit_length() - 1
            step[i + low] += 1
            step[i + low + width - 1 + span] -= 1
            mask &= ~(((1 << width) - 1) << low)
    return np.cumsum(step[:n]) > 0


OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string"


def _kept(texts: bool) -> object:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha, kept = [], [], [], []
            for text, marks in zip(batch.column("text"), batch.column("marks"), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n.append(len(words))
                marks = marks.as_py()
                if marks:
                    words = list(compress(words, ~covered(len(words), marks)))
                gone.append(n[-1] - len(words))
                left = b" ".join(words)
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode() if texts else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()),
                    pa.array(sha, pa.string())
                ],
                names=[x.split()[0] for x in OUT.split(", ")]
            )

    return run


def repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, th, at, mask): runs of windows, from word `at` on, that occur elsewhere; th is xxhash64(text).

    Anchors of more than `hot` runs are split by their windows.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").where("text is not null")
    names = texts.select("text").mapInArrow(_names, "key bigint, n bigint")
    repeated = cut(names.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "anchors")
    bitmap = spark.sparkContext.broadcast(bloom(repeated, "key"))
    crowded = spark.sparkContext.broadcast(bloom(repeated.where(F.col("n") > hot), "key"))
    rows = texts.mapInArrow(_windows(bitmap, crowded), ROW)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_settle, MARK)


def deduplicate(docs: DataFrame, texts: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept (with texts=True, else null), kept_sha256 of every row of docs."""
    # equal rows of one id mark the same places: each place once, so that an array is no longer than a text
    once = repeats(docs, hot).groupBy("doc_id", "th", "at").agg(F.bit_or("mask").alias("mask"))
    marks = once.groupBy("doc_id", "th").agg(F.collect_list(F.struct("at", "mask")).alias("marks")).select(
        F.col("doc_id").alias("m_doc"), F.col("th").alias("m_th"), "marks"
    )
    joined = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").join(marks, F.expr("doc_id <=> m_doc and th = m_th"), "left")
    return joined.select("doc_id", "text", "marks").mapInArrow(_kept(texts), OUT)
