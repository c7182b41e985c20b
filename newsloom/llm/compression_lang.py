"""Language identification by compression.

Each language has a raw-content zstandard dictionary: texts of a bounded sample of its labelled
documents, those with the smallest hash of doc_id. The sampled documents share the dictionary
evenly: short texts are in it whole and leave their rest to longer ones, of which there are pieces
from all over the text. A text is lower-cased, everything
but letters becomes one space, and it is encoded with every dictionary in segments, so that a long
text's own repetitions do not hide what the dictionary contributes. The language with the smallest
total wins; at equal totals the one with more labelled rows. When the smallest total is within a
relative margin of the second, the answer is marked as rejected.

Null texts and texts without a letter are `und` with score 0 and rejected. With one language only
the margin is 1. Without labelled rows all is `und`. Repeated rows are judged each; in a sample they
count as one document each. A null doc_id is sampled like any other.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.shared import crc_mod, cut, lean, small, small_batches

#: Languages with most labelled rows that are learned, documents and bytes of a language's sample, zstandard level,
#: bytes of a segment, least relative margin, and bytes of a piece of a long text.
LANGUAGES, PIECE = 256, 160
SAMPLE_DOCS, DICT_BYTES, LEVEL, SEGMENT, MARGIN = 400, 128 << 10, 6, 1024, 0.005
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
#: hashes of ids are below it
_TOP = 1 << 62


def letters(text: str) -> str:
    """Lower-case letters with single spaces; empty if the text has no letter."""
    out = _OTHER.sub(" ", text.lower()).strip()
    return out if any(map(str.isalpha, out)) else ""


class Model:
    """Dictionary content and labelled rows of each language."""

    def __init__(self, dictionaries: dict[str, bytes], counts: dict[str, int], level: int = LEVEL, segment: int = SEGMENT):
        self.dictionaries, self.counts, self.level, self.segment = dictionaries, counts, level, segment
        self.coders: dict | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"coders": None}

    def _open(self) -> None:
        import zstandard as z

        self.coders = {}
        for lang, content in self.dictionaries.items():
            p = z.ZstdCompressionParameters.from_level(
                self.level, source_size=self.segment, dict_size=len(content), min_match=3, write_checksum=False, write_content_size=False
            )
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            self.coders[lang] = z.ZstdCompressor(dict_data=d, compression_params=p)

    def classify(self, text: str | None) -> tuple[str, float]:
        """Language and relative margin to the next; (und, 0) without a letter."""
        if self.coders is None:
            self._open()
        body = letters(text or "").encode()
        if not body or not self.coders:
            return UNKNOWN, 0.0
        parts = [body[i : i + self.segment] for i in range(0, len(body), self.segment)]
        sizes = sorted((sum(len(c.compress(p)) for p in parts), -self.counts.get(lang, 0), lang) for lang, c in self.coders.items())
        return sizes[0][2], (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0


def _sample(rows: DataFrame, bounds: dict[str, int], sample_docs: int) -> DataFrame:
    """(lang, row_key, place, size) of the first sample_docs distinct rows of each language by a hash of their id, within the language's bound."""
    limits = rows.sparkSession.createDataFrame(list(bounds.items()), "lang string, bound bigint")
    h = F.pmod(F.when(F.col("doc_id").isNull(), F.col("row_key")).otherwise(F.xxhash64("doc_id", F.lit("sample"))), F.lit(_TOP))
    keyed = rows.select("lang", "doc_id", "row_key", h.alias("h"), F.octet_length("text").alias("size"))
    few = keyed.join(F.broadcast(limits), "lang").where("h <= bound").dropDuplicates(["lang", "row_key"])  # a limit for each language
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "size", "row_key")
    return few.withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample_docs).select("lang", "row_key", "place", "size")


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES, languages: int = LANGUAGES) -> Model:
    """A model from (doc_id, text, lang) of the `languages` languages with most rows.

    At most sample_docs texts of each reach the driver, one at a time; equal rows count once, rows without
    an id are told apart by their text. Before rows are ranked, a bound
    on the hash leaves each language some thousands, however many it has.
    """
    rows = labelled.where("text is not null and lang is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return Model({}, {})
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))  # ids may be null or stand on many rows
    bounds = {lang: min(_TOP, _TOP // n * 8 * sample_docs) for lang, n in counts.items()}
    chosen = cut(_sample(rows, bounds, sample_docs), "language-sample")
    drawn = {r.lang: r["count"] for r in chosen.groupBy("lang").count().collect()}
    # where few ids stand on most rows the bound can leave too few: those languages are ranked whole
    poor = {lang: _TOP for lang, bound in bounds.items() if bound < _TOP and drawn.get(lang, 0) < sample_docs}
    if poor:
        again = _sample(rows, poor, sample_docs)
        chosen = cut(chosen.where(~F.col("lang").isin(list(poor))).unionByName(again), "language-sample")
    share: dict[tuple[str, int], int] = {}
    sizes: dict[str, list[tuple[int, int]]] = {}
    for r in chosen.collect():
        sizes.setdefault(r.lang, []).append((r["size"], r.place))
    for lang, docs in sizes.items():
        left = dict_bytes
        for i, (size, place) in enumerate(sorted(docs)):
            share[lang, place] = min(size, left // (len(docs) - i))
            left -= share[lang, place]
    held: dict[str, dict[int, bytes]] = {}
    texts = rows.join(small(chosen.select("lang", "row_key", "place")), ["lang", "row_key"]).select("lang", "place", "text")
    for r in texts.dropDuplicates(["lang", "place"]).orderBy("lang", "place").toLocalIterator():
        held.setdefault(r.lang, {})[r.place] = pieces(letters(r.text).encode(), share[r.lang, r.place])
    return Model({lang: b" ".join(parts.values())[:dict_bytes] for lang, parts in held.items() if any(parts.values())}, counts)


def pieces(text: bytes, most: int, length: int = PIECE) -> bytes:
    """The text if it has at most `most` bytes, else as many pieces of `length` bytes as that allows, evenly spread over it."""
    if len(text) <= most:
        return text
    n = max(1, most // length)
    step = (len(text) - most // n) / max(1, n - 1)
    return b" ".join(text[int(i * step) : int(i * step) + most // n] for i in range(n))


def _classify(model, margin: float) -> object:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            found = [m.classify(t.as_py()) for t in pc.struct_field(batch.column("li_in"), "text")]
            add = [
                pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                pa.array([x[0] == UNKNOWN or x[1] < margin for x in found], pa.bool_())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("li_in"), *add], names=["li_in", "li_lang", "li_margin", "li_rejected"])

    return run


def identify(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """li_in (a struct of all columns of docs), li_lang, li_margin, li_rejected of every row; no shuffle."""
    small_batches(docs.sparkSession)
    packed = docs.select(F.struct(*docs.columns).alias("li_in"))
    schema = f"li_in {packed.schema['li_in'].dataType.simpleString()}, li_lang string, li_margin double, li_rejected boolean"
    return packed.mapInArrow(_classify(docs.sparkSession.sparkContext.broadcast(model), margin), schema)


def held_out(doc_id) -> object:
    return crc_mod(doc_id, 3) == 1


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected; learns from the rows that are not held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model)
    score = F.when(F.col("li_lang") == UNKNOWN, 0.0).otherwise(1 - 0.5 * F.exp(-40 * F.col("li_margin")))
    return out.select(
        "li_in.doc_id", held_out(F.col("li_in.doc_id")).alias("held_out"), F.col("li_lang").alias("lang_pred"), score.alias("score"),
        F.col("li_margin").alias("margin"), F.col("li_rejected").alias("rejected")
    )


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose language is not rejected."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).where("not li_rejected").select("li_in.*")
