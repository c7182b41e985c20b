"""Token ids as Arrow files of equal-length sequences.

Documents are range-partitioned and sorted by doc_id (null first, ties by the text's hash); each
task tokenizes its documents, appends the end id and writes Arrow IPC files. A file's record batches
have the same number of rows; a row is one sequence: ids (fixed-size list, uint16 where the
vocabulary allows), mask (fixed-size list of booleans, false for the padding at the end of a file)
and docs (doc_id, start in the file, n_tokens of the documents that begin in it). Batch b, row r of
a memory-mapped file is found by arithmetic and read without a copy. A file is closed between
documents once it holds `roll` ids, so no task holds more than that and one document.

File names depend on the partition alone and files appear when complete: a repeated task writes
the same files again. Null texts are empty: their only id is the end id.

The tokenizer's pre-tokenizer splits at white space and none of its steps looks across it, so a
text's ids are those of its white-space separated words; words are encoded once per worker and kept
in a table of bounded size.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.shared import cut, lean, shared_dir, small_batches

LENGTH, BATCH_ROWS, ROLL, END_ID, KNOWN_WORDS = 2048, 256, 4 << 20, 1, 400_000
FILES = "file string, n_ids bigint"
DOCS = "file string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
#: a character that is one token of its own between words, to tell the words of a batch apart
_BREAK = "\x01"
#: punctuation that is cut off the end of a word
_TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"

_coders: dict[str, Coder] = {}


class Coder:
    """ids of words as bytes, for one tokenizer file whose text is lower-cased and split at white space.

    A word of letters is one piece that ends in one end-of-word token, so a batch of such words is
    encoded as one text and cut at those tokens. A word of letters with punctuation behind it has
    the ids of both parts. All other words are told apart by a separator token.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = self._without_front(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        #: words met lately, and those of the generation before
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.limit = KNOWN_WORDS
        self.stop = self.ids([_BREAK])[0]

    @staticmethod
    def _without_front(path: str) -> object | None:
        """The same model for text that is normal, lower case and split already; None where its front end does more."""
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        steps = [x["type"] for x in (whole.get("normalizer") or {}).get("normalizers", [])]
        parts = (whole.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in parts] != ["Split", "ByteLevel"]:
            return None
        whole["normalizer"], parts[0] = None, {"type": "WhitespaceSplit"}
        return Tokenizer.from_str(json.dumps(whole))

    @classmethod
    def of(cls, path: str) -> Coder:
        if path not in _coders:
            _coders[path] = cls(path)
        return _coders[path]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def task_done(self) -> None:
        """Between tasks a worker keeps one generation of words."""
        self.older = {}

    def learn(self, words: set[bytes]) -> None:
        known, older = self.known, self.older
        letters, compound, other = set(), [], []
        for w in words:
            if (ids := older.get(w)) is not None:
                known[w] = ids
                continue
            stem = w.rstrip(_TAIL)
            if not stem.decode().isalpha():
                other.append(w)
                continue
            if stem != w:
                compound.append((w, stem, w[len(stem) :]))
                tail = compound[-1][2]
                if tail not in known:
                    other.append(tail)
            if stem not in known:
                letters.add(stem)
        new = [w for w in letters if not self._from_older(w)]
        # ASCII words are in lower case here; others apart, since one of them can need the full front end
        self._letters([w for w in new if w.isascii()])
        self._letters([w for w in new if not w.isascii()], 200)
        self._other(list(dict.fromkeys(other)))
        for w, stem, tail in compound:
            known[w] = known[stem] + known[tail]

    def _from_older(self, w: bytes) -> bool:
        if (ids := self.older.get(w)) is not None:
            self.known[w] = ids
        return ids is not None

    def _cut(self, words: list[bytes], ids: np.ndarray, first: list[int], last: list[int]) -> None:
        raw, size = ids.tobytes(), self.dtype.itemsize
        for w, a, b in zip(words, first, last, strict=True):
            self.known[w] = raw[a * size : b * size]

    def _letters(self, words: list[bytes], most: int = 4000) -> None:
        for i in range(0, len(words), most):
            part = words[i : i + most]
            text = b" ".join(part).decode()
            if self.plain is not None and text == text.lower() and is_normalized("NFC", text):
                ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            else:
                ids = np.array(self.ids([text])[0], self.dtype)
            at = np.flatnonzero(self.ends[ids]) + 1
            if at.size == len(part):
                self._cut(part, ids, [0, *at[:-1].tolist()], at.tolist())
            else:
                self._other(part)

    def _other(self, words: list[bytes]) -> None:
        plain = [w for w in words if b"\x01" not in w] if len(self.stop) == 1 else []
        for i in range(0, len(plain), 2000):
            part = plain[i : i + 2000]
            ids = np.array(self.ids([f" {_BREAK} ".join(w.decode() for w in part)])[0], self.dtype)
            at = np.flatnonzero(ids == self.stop[0])
            if at.size == len(part) - 1:
                self._cut(part, ids, [0, *(at + 1).tolist()], [*at.tolist(), ids.size])
        rest = [w for w in words if w not in self.known]
        for w, ids in zip(rest, self.ids([w.decode() for w in rest]) if rest else [], strict=True):
            self.known[w] = np.array(ids, self.dtype).tobytes()

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """ids of each text as bytes, about a megabyte of text at a time; null is the empty text."""
        i = 0
        while i < len(texts):
            words, at, size = [], [0], 0
            while i < len(texts) and size < 1 << 20:
                text = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
                # special tokens are matched before lower-casing
                words += (text if b"<|" in text else text.lower()).split()
                at.append(len(words))
                size += len(text)
                i += 1
            if len(self.known) > self.limit:
                self.known, self.older = {}, self.known
            found = list(map(self.known.get, words))
            gaps = [j for j, ids in enumerate(found) if ids is None]
            if gaps:
                self.learn({words[j] for j in gaps})
                for j in gaps:
                    found[j] = self.known[words[j]]
            for a, b in zip(at, at[1:], strict=False):
                yield b"".join(found[a:b])


def sequences(ids: np.ndarray, docs: list[tuple], length: int) -> pa.RecordBatch:
    """Rows of `length` ids, padded, with the documents (doc_id, start, n) that begin in each."""
    rows = -(-ids.size // length)
    padded = np.zeros(rows * length, ids.dtype)
    padded[: ids.size] = ids
    begin = np.array([d[1] for d in docs], np.int64) // length
    off = np.searchsorted(begin, np.arange(rows + 1)).astype(np.int32)
    kind = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
    columns = [pa.array(list(c), pa.int64()) for c in zip(*docs, strict=True)] if docs else [pa.array([], pa.int64())] * 3
    held = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays(columns, fields=list(kind)))
    return pa.RecordBatch.from_arrays(
        [
            pa.FixedSizeListArray.from_arrays(pa.array(padded), length),
            pa.FixedSizeListArray.from_arrays(pa.array(np.arange(padded.size) < ids.size), length), held
        ],
        names=["ids", "mask", "docs"]
    )


def _writer(folder: str, path: str, length: int, roll: int, end_id: int, known_words: int) -> object:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs
        from pyspark import TaskContext

        ctx = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        coder = Coder.of(path)
        coder.limit = known_words
        end = np.array([end_id], coder.dtype).tobytes()
        held, docs, size, files = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, docs, size, files
            name = f"part-{ctx.partitionId():06d}-{files:05d}.arrow"
            part = f"{root}/_{ctx.taskAttemptId()}-{files}.tmp"
            whole = sequences(np.frombuffer(b"".join(held), coder.dtype), docs, length)
            with store.open_output_stream(part) as f, pa.ipc.new_file(f, whole.schema) as w:
                w.write_table(pa.Table.from_batches([whole]), max_chunksize=BATCH_ROWS)
            store.move(part, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "n_ids": [size]})
            held, docs, size, files = [], [], 0, files + 1
            return row

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text")), strict=True):
                held += (ids, end)
                n = len(ids) // coder.dtype.itemsize + 1
                docs.append((doc_id, size, n))
                size += n
                if size >= roll:
                    yield flush()
        if docs:
            yield flush()
        coder.task_done()

    return run


def write(
    docs: DataFrame, folder: str, tokenizer: str, length: int = LENGTH, roll: int = ROLL, end_id: int = END_ID, known_words: int = KNOWN_WORDS
) -> DataFrame:
    """Write all documents below folder; (file, n_ids) of the files, as a table.

    known_words bounds a generation of the table of words in each Python worker (some 150 bytes a
    word, two generations); a smaller one costs time where words come back.
    """
    import pyarrow.fs as fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    small_batches(docs.sparkSession)
    ordered = docs.select(
        "doc_id", F.xxhash64("text").alias("th"), "text"
    ).repartitionByRange(F.col("doc_id").asc_nulls_first(), "th").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "th")
    return cut(ordered.select("doc_id", "text").mapInArrow(_writer(folder, tokenizer, length, roll, end_id, known_words), FILES), "token-files")


def open_file(source: str | pa.Buffer) -> pa.ipc.RecordBatchFileReader:
    """A file for random access; a path is memory-mapped."""
    return pa.ipc.open_file(pa.memory_map(source) if isinstance(source, str) else pa.BufferReader(source))


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int, batch_rows: int = BATCH_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """ids and mask of sequence i; the ids are a view of the file's bytes."""
    batch, row = reader.get_batch(i // batch_rows), i % batch_rows
    return batch.column("ids")[row].values.to_numpy(), batch.column("mask")[row].values.to_numpy(zero_copy_only=False)


@lean
def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            reader = open_file(content.as_buffer())
            parts = [reader.get_batch(i) for i in range(reader.num_record_batches)]
            ids = np.concatenate([p.column("ids").flatten().to_numpy() for p in parts])
            mask = np.concatenate([p.column("mask").flatten().to_numpy(zero_copy_only=False) for p in parts])
            ids = ids[mask].astype("<u4")
            docs = [d for p in parts for row in p.column("docs").to_pylist() for d in row]
            name = re.sub(r".*/", "", path)
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * len(docs)), pa.array(
                    [d["doc_id"] for d in docs], pa.int64()
                ), pa.array([d["start"] for d in docs], pa.int64()), pa.array(
                    [d["n_tokens"] for d in docs], pa.int64()
                ),
                pa.array([zlib.crc32(ids[d["start"] : d["start"] + d["n_tokens"]]) for d in docs], pa.int64()),
            ], names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files listed."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).drop("n_ids")
    found = spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(_reader, DOCS)
    return found.join(offsets, "file").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID, known_words: int = KNOWN_WORDS) -> DataFrame:
    """Tokenize, write and read back all documents."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    files = write(docs, folder, tokenizer, end_id=end_id, known_words=known_words)
    if not files.limit(1).count():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read(spark, folder, files)
