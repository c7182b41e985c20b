"""From documents to token files: language, near duplicates, benchmark passages, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import arrow_tokens, compression_lang, jaccard, mixing, winnowing
from newsloom.llm.shared import cut, free, table

#: The workers that encode also run the other stages; their table of words is kept smaller here.
KNOWN_WORDS = 120_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected. Null and letterless texts are; repeated rows are judged each."""
    return compression_lang.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of links, that of the smallest doc_id; of repeated rows one. Wordless texts stay."""
    return jaccard.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark passages. Texts without a word stay; repeated rows are judged each."""
    return winnowing.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in training order. Texts without a word are not taken; ties go by doc_id, then copy."""
    return mixing.training_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the token files; copies follow each other, null texts are the end id."""
    import public_tokenizers

    return arrow_tokens.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), known_words=KNOWN_WORDS)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Compression, tokens and the order of copies are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is deleted once the next one's is written; the last is read lazily."""
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        free(*written, sweep=True)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
