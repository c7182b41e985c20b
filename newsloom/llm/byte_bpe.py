"""Byte-level BPE by two lookups: a minimal perfect hash of the vocabulary, and merges on a heap for the rest.

Text is cut into pre-tokens as SPLIT says, over the UTF-8 bytes of many texts at once. A minimal perfect
hash has one slot for each token of the vocabulary; a pre-token whose slot holds the same bytes is that
token. Any other is encoded by merging the pair of lowest rank, leftmost first: the parts are a linked list
over its bytes, the pairs a heap, and entries whose pair is gone are passed over. Such pre-tokens are met
again and again, so their ids stay in a table of bounded size in each worker.

Ids are packed: little-endian unsigned 32-bit integers in a binary column. Null texts are empty and have no
ids; repeated rows are encoded each; nothing is shuffled, so an empty table gives an empty table and a lost
task is simply run again. A long text is worked off in windows that end before white space, where no
pre-token can cross; only a single pre-token is held whole. The vocabulary must hold every byte.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shared import lean, small_batches
from newsloom.llm.tokens import chunks, distinct, mix, ragged, word_hashes

#: fixed value: the rule that cuts text before merges
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: bytes of text that are worked on at once, pre-tokens in a generation of the table, bytes of one that is kept there
WINDOW, KNOWN, LONGEST_KNOWN = 1 << 20, 400_000, 64
SPACE, LETTER, NUMBER, OTHER = range(4)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: the place of a heap entry, below its rank
_AT = (1 << 40) - 1


def ranks_of(path: str) -> dict[bytes, int]:
    """Rank of each token in a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Tokens by a minimal perfect hash: keys are dealt to buckets, and a bucket's shift puts all its keys on free slots.

    Large buckets are placed first; a bucket of one key names its slot (as -1 - slot), so that the last slots
    need no search. find() compares bytes, hence no other string is ever taken for a token.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        self.bytes = np.frombuffer(b"".join(keys), np.uint8)
        sizes = np.array([len(k) for k in keys], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        hashes = word_hashes(self.bytes, starts, ends)
        n = self.n = len(keys)
        if np.unique(hashes).size != n:
            raise ValueError("two tokens are equal or have the same hash")
        self.shift = np.zeros(max(1, n // 2), np.int64)
        owner = np.full(n, -1, np.int64)
        bucket = self._bucket(hashes)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        groups = sorted(np.split(order, cuts), key=len, reverse=True) if n else []
        single = [g[0] for g in groups if len(g) == 1]
        for group in groups[: len(groups) - len(single)]:
            self._place(group, hashes[group], bucket[group[0]], owner)
        free = np.flatnonzero(owner < 0)
        owner[free] = single
        self.shift[bucket[single]] = -1 - free
        self.start, self.size = starts[owner], (ends - starts)[owner]
        self.value = np.array(values, np.uint32)[owner]

    def _place(self, group: np.ndarray, hashes: np.ndarray, bucket: int, owner: np.ndarray) -> None:
        first, many = 1, 16
        while True:
            slots = self._slot(hashes[None, :], np.arange(first, first + many)[:, None])
            ordered = np.sort(slots, axis=1)
            fits = (owner[slots] < 0).all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if fits.any():
                at = int(np.argmax(fits))
                owner[slots[at]], self.shift[bucket] = group, first + at
                return
            first, many = first + many, min(4096, 2 * many)

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) % np.uint64(self.shift.size)).astype(np.int64)

    def _slot(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(hashes + shift.astype(np.uint64) * _STEP) % np.uint64(self.n)).astype(np.int64)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which strings are tokens, their values); values of others mean nothing."""
        if not self.n or not starts.size:
            return np.zeros(starts.size, bool), np.zeros(starts.size, np.uint32)
        shift = self.shift[self._bucket(hashes)]
        slot = np.where(shift < 0, -1 - shift, self._slot(hashes, np.maximum(shift, 0)))
        size = ends - starts
        same = self.size[slot] == size
        at = np.flatnonzero(same)
        here, there = ragged(starts[at], size[at]), ragged(self.start[slot[at]], size[at])
        wrong = data[here] != self.bytes[there]
        if wrong.any():
            same[at[np.repeat(np.arange(at.size), size[at])[wrong]]] = False
        return same, self.value[slot]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    n, get = len(piece), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n))
    pair = [get(piece[i : i + 2]) for i in range(n - 1)]
    heap = [(rank << 40) | i for i, rank in enumerate(pair) if rank is not None]
    pair += (None, None)
    heapify(heap)
    while heap:
        top = heappop(heap)
        i = top & _AT
        if pair[i] != top >> 40:
            continue  # a part of the pair is gone
        j = after[i]
        end = after[i] = after[j]
        pair[j] = None
        before[end] = i
        if end < n:
            rank = pair[i] = get(piece[i : after[end]])
            if rank is not None:
                heappush(heap, (rank << 40) | i)
        else:
            pair[i] = None
        k = before[i]
        if k >= 0:
            rank = pair[k] = get(piece[k:end])
            if rank is not None:
                heappush(heap, (rank << 40) | k)
    out, i = [], 0
    while i < n:
        end = after[i]
        out.append(ranks[piece[i:end]])
        i = end
    return out


def character_classes() -> np.ndarray:
    """Class of each code point, asked of tiktoken: its tables of Unicode decide, whatever version others have."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        out[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def byte_classes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Class of the character to which each byte of UTF-8 text belongs."""
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if lead.size:
        more = np.concatenate([data, np.zeros(3, np.uint8)])
        b = [more[lead + k].astype(np.int64) & 0x3F for k in range(4)]
        size = 2 + (more[lead] >= 0xE0) + (more[lead] >= 0xF0)
        point = np.where(
            size == 2, (b[0] & 0x1F) << 6 | b[1],
            np.where(size == 3, (b[0] & 0x0F) << 12 | b[1] << 6 | b[2], (b[0] & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3])
        )
        kind = table[np.minimum(point, 0x10FFFF)]
        for k in range(4):
            here = lead[size > k] + k
            inside = here < data.size
            out[here[inside]] = kind[size > k][inside]
    return out


def cut_points(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the texts begin; each ends where the next begins."""
    n = data.size
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data, table)
    edge = np.zeros(n + 4, bool)
    edge[off] = True  # texts do not touch each other
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last character of white space before something else stands apart; a plain space goes with what follows
    run = np.flatnonzero(start & ~edge[:n] & (kind != SPACE))
    run = run[kind[run - 1] == SPACE]
    last = run - 1
    for _ in range(2):
        last = last - ((data[last] & 0xC0) == 0x80)
    start[last] = True
    start[run[data[run - 1] == 0x20]] = False
    # an apostrophe that begins a pre-token takes an ending with it
    mark = np.flatnonzero(start & (data == 0x27))
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    mark = mark[~edge[mark + 1]]
    one, two = padded[mark + 1], np.where(edge[mark + 2], 0, padded[mark + 2])
    short = np.isin(one, list(b"stmd"))
    long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
    start[mark[short | long] + 1] = False
    for at in (mark[short] + 2, mark[long] + 3):
        start[at[at < n]] = True
    return np.flatnonzero(start)


def windows(data: np.ndarray, most: int) -> list[int]:
    """Cuts of one text into parts of about `most` bytes: before ASCII white space that follows a visible ASCII character."""
    cuts, at = [0], most
    while at < data.size:
        part = data[at - 1 : at + most + 1]
        white = (part[1:] == 0x20) | ((part[1:] >= 0x09) & (part[1:] <= 0x0D))
        good = np.flatnonzero(white & (part[:-1] > 0x20) & (part[:-1] < 0x7F))
        if good.size:
            at += int(good[0])
            cuts.append(at)
        at += most
    return [*cuts, data.size]


class Encoder:
    """Ids of texts for one vocabulary; what a worker has met is kept within bounds."""

    def __init__(self, words: PerfectHash, ranks: dict[bytes, int], known: int = KNOWN, window: int = WINDOW):
        self.words, self.ranks, self.limit, self.window = words, ranks, known, window
        self.classes = character_classes()
        #: pre-tokens met lately and their ids, and those of the generation before
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of distinct pre-tokens."""
        found = list(map(self.known.get, pieces))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            piece = pieces[i]
            ids = self.older.get(piece)
            if ids is None:
                ids = np.array(merged(piece, self.ranks), np.uint32).tobytes()
            found[i] = ids
            if len(piece) <= LONGEST_KNOWN:
                if len(self.known) >= self.limit:
                    self.known, self.older = {}, self.known
                self.known[piece] = ids
        return found

    def part(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts one after another, text of each id)."""
        starts = cut_points(data, off, self.classes)
        ends = np.append(starts[1:], data.size) if starts.size else starts
        hashes = word_hashes(data, starts, ends)
        whole, value = self.words.find(data, starts, ends, hashes)
        size = np.ones(starts.size, np.int64)
        missed = np.flatnonzero(~whole)
        which, some = distinct(data, starts[missed], ends[missed], hashes[missed])
        some, raw = missed[some], data.tobytes()
        found = self._ids([raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
        lengths = np.array(list(map(len, found)), np.int64) // 4
        pool = np.frombuffer(b"".join(found), np.uint32)
        if missed.size:
            size[missed] = lengths[which]
        out = np.zeros(int(size.sum()), np.uint32)
        place = np.cumsum(size) - size
        out[place[whole]] = value[whole]
        if missed.size:
            begins = np.cumsum(lengths) - lengths
            out[ragged(place[missed], size[missed])] = pool[ragged(begins[which], size[missed])]
        return out, np.repeat(np.searchsorted(off, starts, side="right") - 1, size)

    def encode(self, column: pa.Array) -> Iterator[list[bytes]]:
        """Packed ids of each text, for as many texts at a time as fill a window."""
        for lo, hi, data, off in chunks(column, self.window):
            if hi - lo == 1:
                cuts = windows(data, self.window)
                parts = (data[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
                yield [b"".join(self.part(p, np.array([0, p.size]))[0].astype("<u4").tobytes() for p in parts)]
            else:
                ids, row = self.part(data, off)
                at = np.searchsorted(row, np.arange(hi - lo + 1)).tolist()
                yield [ids[a:b].astype("<u4").tobytes() for a, b in zip(at, at[1:], strict=False)]


_encoders: dict[str, Encoder] = {}


def _encoding(name: str, words: PerfectHash, ranks: dict[bytes, int], known: int, window: int) -> object:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = Encoder(words, ranks, known, window)
        for batch in batches:
            lo = 0
            for found in _encoders[name].encode(batch.column(1)):
                hi = lo + len(found)
                size = pa.array([len(ids) // 4 for ids in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], size, pa.array(found, pa.binary())], names=[batch.schema.names[0], "n_tokens", "ids"])
                lo = hi

    return run


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", known: int = KNOWN, window: int = WINDOW) -> DataFrame:
    """(key, n_tokens, ids) of every row, ids packed, by the vocabulary in the file at path; other columns are not kept."""
    small_batches(docs.sparkSession)
    ranks = ranks_of(path)
    words = PerfectHash(list(ranks), list(ranks.values()))
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(_encoding(f"{path} {known} {window}", words, ranks, known, window), f"`{key}` {kind}, n_tokens bigint, ids binary")


def unpacked(ids: str = "ids") -> object:
    """Packed ids as a pandas UDF's array of long, for those who want them one by one."""

    @F.pandas_udf("array<bigint>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else np.frombuffer(b, "<u4").astype(np.int64))

    return run(ids)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with the column decoded, the bytes of the packed ids; null ids give null. A clashing column is replaced."""
    ranks = ranks_of(path)
    size = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
    tokens = sorted(ranks, key=ranks.get)
    size[[ranks[t] for t in tokens]] = [len(t) for t in tokens]
    begin, pool = np.cumsum(size) - size, np.frombuffer(b"".join(tokens), np.uint8)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for packed in batch.column(ids):
                if not packed.is_valid:
                    out.append(None)
                    continue
                numbers = np.frombuffer(packed.as_buffer(), "<u4")
                parts = (numbers[i : i + WINDOW // 4] for i in range(0, numbers.size, WINDOW // 4))
                out.append(b"".join(pool[ragged(begin[p], size[p])].tobytes() for p in parts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    from pyspark.sql.types import BinaryType, StructType

    kept = encoded.drop("decoded")
    return kept.mapInArrow(run, StructType([*kept.schema.fields]).add("decoded", BinaryType()))
