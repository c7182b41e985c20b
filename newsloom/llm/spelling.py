"""Spelling variants: words that differ by one inserted, deleted or replaced character, by range reporting.

Words of one length stand in forward order and in the order of their reversed strings; a word is the point
(forward place, reverse place). The words that equal w but for position i are those between two forward
places (they begin like w) and between two reverse places (they end like w): a rectangle, whose points a
wavelet tree over the reverse places reports. So each position of each word asks for rectangles among the
words of its own length (replaced), one more (inserted) and one less (deleted).

The words are cut into shards twice, by forward and by reverse order, of about SHARD words each. Each position
goes to the order in which its prefix or suffix lies within one shard; a position where neither does goes to
all shards of the narrower interval. Thus common beginnings or endings send no word everywhere, and no
task holds more than a shard's points and a batch of words. Shard bounds come from a sample of the words
(by hash, some SAMPLE a shard); they affect the balance only. Results are summed per word in the task, then
by a grouped aggregation.

Defined cases: null and empty texts have no words; a null doc_id reads as the empty text; repeated rows count
each; an empty table has no words. Words of any length are compared; a text is read in whole, a run of letters
of any length is one word.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shared import arrow_rows, cut, free, lean, small, small_batches
from newsloom.llm.tokens import LOWER, chunks, distinct, ragged, word_hashes

#: an occurrence in so many loses a character; least characters and occurrences of a word; how much commoner its form is
SLIP, LEAST_SIZE, LEAST_COUNT, FACTOR = 199, 6, 5, 5
#: words of a shard, words sampled for the bounds of one, bytes of text at once, (word, position) pairs at once
SHARD, SAMPLE, WINDOW, PAIRS = 8192, 32, 4 << 20, 1 << 20
#: copies of a looked-up row among which the rows of a hot key are dealt
SALTS = 16
_B = np.arange(256)
_LETTER = ((_B | 0x20) >= 0x61) & ((_B | 0x20) <= 0x7A) & (_B < 0x80)
_DIGITS = 8
_LAST = chr(0x10FFFF)
ROUTED = "side int, shard int, kind int, word string, n bigint, first int, last int"
FOUND = "word string, n_near bigint, best_n bigint, best string"


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_CRC = _crc_table()


def crc32_of(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int = 64) -> np.ndarray:
    """crc32 of each span, going on from each state; a byte of all spans at a time, spans of over `most` bytes one by one."""
    order = np.argsort(-np.minimum(sizes, most + 1), kind="stable")
    at, size = starts[order], sizes[order]
    long = int(np.searchsorted(-size, -most, side="left"))
    crc = ~state[order]
    for j in range(int(size[long:].max(initial=0))):
        m = long + int(np.searchsorted(-size[long:], -j, side="left"))
        c = crc[long:m]
        crc[long:m] = _CRC[(c ^ data[at[long:m] + j]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
    crc = ~crc
    for k in range(long):
        crc[k] = zlib.crc32(data[at[k] : at[k] + size[k]].tobytes(), int(state[order[k]]))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def letter_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the maximal runs of A-Z, a-z and U+00C0 to U+00FF; a row's end ends a run."""
    two = data == 0xC3  # lead byte of just these characters
    inside = _LETTER[data] | two
    inside[1:] |= two[:-1]
    edge = np.zeros(data.size + 1, bool)
    edge[off] = True
    edge = edge[:-1]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:]
    starts = np.flatnonzero(first)
    stop = ~inside | edge
    stops = np.append(np.flatnonzero(stop), data.size)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(sizes.size + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.StringArray.from_buffers(sizes.size, pa.py_buffer(offsets), pa.py_buffer(data[ragged(starts, sizes)]))


def _counting(slip: int, least: int) -> object:
    def part(ids: list, data: np.ndarray, off: np.ndarray) -> Iterator[pa.RecordBatch]:
        data = LOWER[data]
        starts, ends, row = letter_runs(data, off)
        before = np.zeros(data.size + 1, np.int64)
        np.cumsum((data & 0xC0) == 0x80, out=before[1:])
        sizes = ends - starts
        length = sizes - (before[ends] - before[starts])
        wide = length >= least
        starts, ends, row, sizes, length = (x[wide] for x in (starts, ends, row, sizes, length))
        state = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        crc = crc32_of(state[row], data, starts, sizes)
        cut_short = crc % np.uint32(slip) == 0
        whole = np.flatnonzero(~cut_short)
        if whole.size:
            which, some = distinct(data, starts[whole], ends[whole], word_hashes(data, starts[whole], ends[whole]))
            some = whole[some]
            yield pa.RecordBatch.from_arrays(
                [_strings(data, starts[some], sizes[some]), pa.array(np.bincount(which, minlength=some.size), pa.int64())], names=["word", "n"]
            )
        slips = []
        for k in np.flatnonzero(cut_short & (length > least)):
            word, at = data[starts[k] : ends[k]].tobytes().decode(), int(crc[k]) % int(length[k])
            slips.append(word[:at] + word[at + 1 :])
        yield pa.RecordBatch.from_pydict({"word": pa.array(slips, pa.string()), "n": pa.array([1] * len(slips), pa.int64())})

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, off in chunks(batch.column(1), WINDOW):
                if data.size:
                    yield from part(ids[lo:hi], data, off)

    return run


def vocabulary(docs: DataFrame, slip: int = SLIP, least: int = LEAST_SIZE, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the lower-cased words of `least` characters or more that stand `count` times or more, slips made."""
    small_batches(docs.sparkSession)
    each = docs.select("doc_id", "text").mapInArrow(_counting(slip, least), "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


class Bounds:
    """Shards of both orders: which one a word is in, and where the intervals of its prefixes and suffixes reach."""

    def __init__(self, words: list[str], shards: int):
        self.keys = []
        for side in (0, 1):
            every = sorted(self.key(len(w), w[::-1] if side else w) for w in words)
            self.keys.append(sorted({every[len(every) * s // shards] for s in range(1, shards)}) if every else [])

    @staticmethod
    def key(length: int, text: str) -> str:
        return f"{length:0{_DIGITS}d}{text}"

    def shard(self, side: int, word: str) -> int:
        return bisect_right(self.keys[side], self.key(len(word), word[::-1] if side else word))

    def _alone(self, side: int, length: int, text: str) -> tuple[int, int]:
        """(least size of a prefix of text whose words of this length are all in one shard, that shard)."""
        keys, key = self.keys[side], self.key(length, text)
        s, most = bisect_right(keys, key), -1
        for bound in keys[max(0, s - 1) : s + 1]:
            same = 0
            for x, y in zip(key, bound, strict=False):
                if x != y:
                    break
                same += 1
            most = max(most, same - _DIGITS)
        return most + 1, s

    def routes(self, word: str, kind: int) -> Iterator[tuple[int, int, int, int]]:
        """(side, shard, first, last) position of the rectangles of words with len(word) + kind characters."""
        n, m = len(word), len(word) + kind
        skip = 0 if kind > 0 else 1  # characters of word that stand for none of the other's
        last = n - skip
        front, ahead = self._alone(0, m, word)
        back, behind = self._alone(1, m, word[::-1])
        least, most = front, last - back  # forward from least on, reverse up to most
        if least <= most + 1:
            middle = min(max((n + 1) // 2, least, 0), most + 1, last + 1)
            if middle <= last:
                yield 0, ahead, middle, last
            if middle > 0:
                yield 1, behind, 0, middle - 1
            return
        if least <= last:
            yield 0, ahead, least, last
        if most >= 0:
            yield 1, behind, 0, most
        for i in range(max(most + 1, 0), min(least - 1, last) + 1):
            spans = []
            for side, text in ((0, word[:i]), (1, word[i + skip :][::-1])):
                low = self.key(m, text)
                spans.append((bisect_right(self.keys[side], low), bisect_right(self.keys[side], low + _LAST)))
            side = 0 if spans[0][1] - spans[0][0] <= spans[1][1] - spans[1][0] else 1
            for shard in range(spans[side][0], spans[side][1] + 1):
                yield side, shard, i, i


def _routing(bounds: Bounds, lengths: set[int]) -> object:
    kinds = [f.split()[0] for f in ROUTED.split(", ")]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("side", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += ((side, bounds.shard(side, word), -9, word, n, 0, 0) for side in (0, 1))
                for kind in (-1, 0, 1):
                    if len(word) + kind in lengths:
                        rows += ((side, shard, kind, word, n, first, last) for side, shard, first, last in bounds.routes(word, kind))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


class Orders:
    """Words of one length in both orders, and the wavelet tree of their places."""

    def __init__(self, words: list[str], counts: list[int]):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words = [words[i] for i in order]
        self.counts = np.array(counts, np.int64)[order]
        k, self.size = len(words), len(words[0])
        self.forward = _codes(self.words, self.size)
        self.by_reverse = np.array(sorted(range(k), key=lambda i: self.words[i][::-1]))
        self.tries = [_trie(self.forward), _trie(self.forward[self.by_reverse][:, ::-1])]
        place = np.empty(k, np.int64)
        place[self.by_reverse] = np.arange(k)
        #: per bit, highest first: how many zeros stand before each place
        self.levels = []
        for bit in range(max(1, (k - 1).bit_length()) - 1, -1, -1):
            one = (place >> bit) & 1 == 1
            zeros = np.zeros(k + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((bit, zeros))
            place = np.concatenate([place[~one], place[one]])

    def intervals(self, side: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high), depth + 1 rows: the places of words that begin with the first 0, 1, 2, ... characters of each asked one."""
        keys, starts = self.tries[side]
        depth, k = min(asked.shape[1], self.size), len(self.words)
        low, high = (np.zeros((depth + 1, len(asked)), np.int32) for _ in range(2))
        high[0] = k
        alive, group = np.arange(len(asked)), np.zeros(len(asked), np.int64)
        for i in range(depth):
            target = (group << 21) | asked[alive, i]
            at = np.searchsorted(keys[i], target)
            hit = keys[i][np.minimum(at, k - 1)] == target
            alive, at = alive[hit], at[hit]
            if not alive.size:
                break
            group = np.searchsorted(starts[i], at, side="right") - 1
            low[i + 1, alive], high[i + 1, alive] = at, starts[i][group + 1]
        return low, high

    def report(self, low: np.ndarray, high: np.ndarray, bottom: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, forward place) of all points with low <= forward place < high and bottom <= reverse place < top."""
        which, value = np.arange(low.size), np.zeros(low.size, np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[low], zeros[high]
            total = int(zeros[-1])
            which, value = np.concatenate([which, which]), np.concatenate([value, value + (1 << bit)])
            low, high = np.concatenate([a, total + low - a]), np.concatenate([b, total + high - b])
            keep = (low < high) & (value < top[which]) & (value + (1 << bit) > bottom[which])
            which, value, low, high = which[keep], value[keep], low[keep], high[keep]
        return which, self.by_reverse[value]


def _codes(words: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size).astype(np.int64)


def _trie(rows: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per depth of sorted rows: (number of the row's prefix, next character) as one sorted key, and where each longer prefix starts."""
    group, keys, starts = np.zeros(len(rows), np.int64), [], []
    for i in range(rows.shape[1]):
        keys.append((group << 21) | rows[:, i])
        new = np.concatenate([[True], keys[-1][1:] != keys[-1][:-1]])
        starts.append(np.append(np.flatnonzero(new), len(rows)))
        group = np.cumsum(new) - 1
    return keys, starts


def near(orders: Orders, words: list[str], kind: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the asked word, forward place of a word near it), each pair once; positions first to last are asked. All words have one length."""
    n, skip = len(words[0]), 0 if kind > 0 else 1
    asked = _codes(words, n)
    low, high = orders.intervals(0, asked)
    bottom, top = orders.intervals(1, asked[:, ::-1])
    position = np.arange(n - skip + 1)
    wanted = (position[:, None] >= first) & (position[:, None] <= last)
    if kind < 0:  # of equal neighbours the last is deleted
        wanted[:-1] &= asked.T[:-1] != asked.T[1:]
    front, back = position, n - skip - position  # what must agree before and behind
    deep = orders.size
    ok = (front <= deep) & (back <= deep)
    front, back = np.minimum(front, low.shape[0] - 1), np.minimum(back, bottom.shape[0] - 1)
    own = int(kind == 0) * (high[-1] > low[-1]) if kind == 0 else 0  # a word meets itself
    wanted &= ok[:, None] & (high[front] - low[front] > own) & (top[back] - bottom[back] > own)
    i, q = np.nonzero(wanted)
    rect, place = orders.report(low[front[i], q], high[front[i], q], bottom[back[i], q], top[back[i], q])
    i, q = i[rect], q[rect]
    if kind == 0:
        keep = ~((high[-1][q] > low[-1][q]) & (low[-1][q] == place))
    elif kind > 0:  # a doubled character counts as inserted behind its equal
        keep = (i == n) | (orders.forward[place, i] != asked[q, np.minimum(i, n - 1)])
    else:
        keep = np.ones(q.size, bool)
    return q[keep], place[keep]


class Shard:
    """The points of a shard, by length."""

    def __init__(self) -> None:
        self.words: dict[int, tuple[list, list]] = {}
        self.orders: dict[int, Orders] = {}

    def add(self, words: list[str], counts: list[int]) -> None:
        for word, n in zip(words, counts, strict=True):
            held = self.words.setdefault(len(word), ([], []))
            held[0].append(word)
            held[1].append(n)

    def search(self, words: list[str], kind: int, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[str, int, int, str]]:
        """(word, number of words near it, largest count of those, the first such word)."""
        lengths = np.array(list(map(len, words)))
        for n in np.unique(lengths).tolist():
            if n + kind not in self.words:
                continue
            if n + kind not in self.orders:
                self.orders[n + kind] = Orders(*self.words[n + kind])
            orders, rows = self.orders[n + kind], np.flatnonzero(lengths == n)
            step = max(1, PAIRS // (n + 1))
            for i in range(0, rows.size, step):
                part = rows[i : i + step]
                q, place = near(orders, [words[r] for r in part], kind, first[part], last[part])
                order = np.lexsort((place, -orders.counts[place], q))
                q, place = q[order], place[order]
                each, begin, count = np.unique(q, return_index=True, return_counts=True)
                for a, b, c in zip(part[each].tolist(), place[begin].tolist(), count.tolist(), strict=True):
                    yield words[a], c, int(orders.counts[b]), orders.words[b]


@lean
def _searching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, current = Shard(), None
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)]) if batch.num_rows else np.zeros((3, 0))
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            side, number, kind = key[:, lo].tolist()
            if (side, number) != current:
                shard, current = Shard(), (side, number)
            words = part.column(3).to_pylist()
            if kind < -1:
                shard.add(words, part.column(4).to_pylist())
                continue
            rows = list(shard.search(words, kind, part.column(5).to_numpy(), part.column(6).to_numpy()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def nearest(words: DataFrame, size: int = SHARD) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have others near them: how many, and the commonest (first of equals)."""
    lengths = words.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("n")).collect()
    total = sum(r.n for r in lengths)
    shards = max(1, -(-total // size))
    every = max(1, total // (SAMPLE * shards))
    sample = [r.word for r in words.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select("word").toLocalIterator()] if shards > 1 else []
    routed = words.mapInArrow(_routing(Bounds(sample, shards), {r["size"] for r in lengths}), ROUTED)
    dealt = routed.repartition("side", "shard").sortWithinPartitions("side", "shard", "kind")
    return dealt.mapInArrow(_searching, FOUND).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("x")
    ).select("word", "n_near", (-F.col("x.m")).alias("best_n"), "x.best")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form), each followed to its end by doubling; a form is commoner than its word, so chains end.

    The looked-up links are broadcast where they are few, else copied SALTS times, so that a form
    that very many words have is not one task's work. The hint keeps Spark from broadcasting the copies, which it takes to
    be as small as the file of the links.
    """
    now = cut(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "links")
    while now.where("moved").limit(1).count():
        then = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        dim = small(then)
        if dim is then:
            salted = then.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
            rows = now.withColumn("_s", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
            joined = rows.join(salted, (rows["root"] == salted["_word"]) & (rows["_s"] == salted["_salt"]), "left")
        else:
            joined = now.join(dim, now["root"] == dim["_word"], "left")
        after = cut(joined.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "links")
        free(now)
        now = after
    return now.select("word", "root")


def variants(docs: DataFrame, factor: int = FACTOR, size: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of docs (doc_id, text); other columns play no part."""
    with arrow_rows(docs.sparkSession):
        words = cut(vocabulary(docs), "words")
        found = nearest(words, size)
        common = F.col("best_n") >= factor * F.col("n")
        formed = cut(words.join(found.hint("merge"), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best")).alias("form"),
            F.when(common, F.col("best_n")).alias("form_n")
        ), "forms")
    free(words)
    ends = roots(formed.where("form is not null"))
    return formed.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
