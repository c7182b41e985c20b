"""All pairs of similar short texts: TF-IDF cosine, Jaccard of term sets and agreement of MinHash signatures.

A pair is found by a join of postings. The terms of a text stand rare first; a text's weights are scaled
to length 1. If two texts reach the cosine t, the first term that they share stands, in each of them, where
what is left of the vector has a length of t at least: before it they share nothing, and behind that place
the product of the rests is under t. So only those prefixes are joined, and a meeting counts only if
w w' + rest rest' >= t. For the Jaccard similarity prefixes go by places instead of weights. A pair's threshold
is the later text's, times a factor where both have a tag in common; each side's prefix goes by the least
threshold that it can meet.

Texts of equal terms, threshold and tags are one node, so copies of a text form no pairs but a star. Prefixes
meet within blocks of nodes (see blocks.py), and what meets is compared there, so candidates are never written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import all_tokens
from newsloom.operators import blocks
from newsloom.sources.tables import cut, sweep_shuffles

#: fixed value: with fewer distinct terms a title is short, and its Jaccard similarity counts too
SHORT = 10
#: digits to which similarities are compared
DIGITS = 9


def texts(items: DataFrame, key: str, text: str | Column, bar: Column | float, tags: str | None = None, new: bool = True) -> DataFrame:
    """(id, words, bar, tags, new) for pairs(): all words of the text, the threshold of a pair of which this is the later text.

    Texts that are not new are compared with new ones only, as the earlier ones; their ids must be smaller.
    """
    tagged = F.array_sort(F.coalesce(F.col(tags), F.array().cast("array<string>"))) if tags else F.array().cast("array<string>")
    return items.select(
        F.col(key).alias("id"), F.coalesce(all_tokens(text if isinstance(text, Column) else F.col(text)), F.array().cast("array<string>")).alias("words"),
        (bar if isinstance(bar, Column) else F.lit(bar)).cast("double").alias("bar"), tagged.alias("tags"), F.lit(new).alias("new")
    )


def pairs(
    given: DataFrame, least: float, factors: tuple[float, float] = (1.0, 1.0), short: int | None = SHORT, minhash: bool = False, total: int | None = None,
    df: DataFrame | None = None, part: int = blocks.NODES, best: bool = False
) -> DataFrame:
    """(earlier, later, similarity, bar) of all pairs of given (as of texts()) whose similarity reaches the pair's threshold.

    least: the smallest bar in given; factors: of the threshold of pairs with a tag in common, where the
    earlier text is new and where it is not. The similarity is the cosine; where it is under the threshold and
    the later text has fewer than `short` distinct terms (short None: any number) the Jaccard similarity
    of the term sets if that is larger. With minhash the agreement of the 64-hash signatures counts as well, for pairs that share
    one of 32 bands. Frequencies are those of given unless total and df are handed in. A text that is
    not its node's first has one row, with that first; nodes are compared by their first texts. Texts
    without a word are in no pair. part: nodes of a group; best: only what best_earlier() can choose is sure to be given.
    """
    given = cut(given, "texts")
    total = given.count() if total is None else total
    same = F.xxhash64(F.array_sort("words"), "bar", "tags", "new")
    named = given.where(F.size("words") > 0).withColumn("node", same)
    nodes = cut(named.groupBy("node").agg(
        F.min("id").alias("id"), F.min_by("words", "id").alias("words"), F.min_by("bar", "id").alias("bar"), F.min_by("tags", "id").alias("tags"),
        F.first("new").alias("new"), F.count("*").alias("copies")
    ), "nodes")
    if df is None:
        df = nodes.select("copies", F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.sum("copies").alias("df"))
    vectors = cut(blocks.packed(nodes, df.select("term", F.log(F.lit(total) / (1 + F.col("df"))).alias("idf"))), "vectors")
    sweep_shuffles(given.sparkSession)
    signed = blocks.signatures(nodes) if minhash else None
    found = blocks.similar(vectors, signed, least, factors, short, False, part, best)
    near = scored(found, short).select("earlier", "later", "similarity", "bar")
    copies = named.join(nodes.select("node", F.col("id").alias("earlier")), "node").where("new and id <> earlier").select(
        "earlier", F.col("id").alias("later"), F.lit(1.0).alias("similarity"), F.col("bar").alias("bar")
    )
    return near.unionByName(copies)


def scored(found: DataFrame, short: int | None) -> DataFrame:
    """found with similarity, of blocks.similar()."""
    jaccard = F.col("c") / (F.col("e") + F.col("l") - F.col("c"))
    under = F.round("dot", DIGITS) < F.round("bar", DIGITS)
    sets = F.lit(True) if short is None else under & (F.col("l") < short)
    best = F.greatest("dot", F.when(sets, jaccard), "agreement")
    return found.withColumn("similarity", F.round(best, DIGITS)).where(F.col("similarity") >= F.round("bar", DIGITS))


def best_earlier(found: DataFrame) -> DataFrame:
    """(later, earlier, similarity): the most similar earlier text, ties to the earlier one.

    A text that is not its node's first takes that first, or what equals that first as well.
    """
    best = found.groupBy("later").agg(F.max_by(F.struct("earlier", "similarity"), F.struct("similarity", -F.col("earlier"))).alias("x"))
    best = best.select("later", "x.earlier", "x.similarity")
    above = best.where("similarity >= 1").select(F.col("later").alias("earlier"), F.col("earlier").alias("_first"))
    return best.join(above, "earlier", "left").select(
        "later", F.when(F.col("similarity") >= 1, F.coalesce("_first", "earlier")).otherwise(F.col("earlier")).alias("earlier"), "similarity"
    )
