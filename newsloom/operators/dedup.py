"""Exact and near duplicate detection of short texts: keys, MinHash bands, TF-IDF."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import HASHES, PRIME, SEED, all_tokens, tokens
from newsloom.operators.parts import in_parts
from newsloom.sources.tables import small_batches

#: the value of each hash in the signature of a text without a token
NO_TOKEN = 0xFFFFFFFF


def exact(items: DataFrame, key: str, order: list) -> DataFrame:
    """The first item of each key; rank filters are limited before the shuffle."""
    return items.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def unseen(items: DataFrame, history: DataFrame, key: str) -> DataFrame:
    return items.join(history.select(key).distinct(), key, "left_anti")


def coefficients(n: int = HASHES) -> list[tuple[int, int]]:
    draw = random.Random(SEED)
    return [(draw.randint(1, PRIME - 1), draw.randint(0, PRIME - 1)) for _ in range(n)]


def _times(a: int, x: np.ndarray) -> np.ndarray:
    """a * x modulo 2^61 - 1 in 64-bit steps, for a and x below it."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, x1, x0 = np.uint64(a >> 31), np.uint64(a & ((1 << 31) - 1)), x >> half, x & low
    mid = a1 * x0 + a0 * x1
    total = np.uint64(2) * (a1 * x1) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << half)
    return (total % np.uint64(PRIME) + (a0 * x0) % np.uint64(PRIME)) % np.uint64(PRIME)


def _least(n: int) -> Callable:
    family = coefficients(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1)
            flat = held.flatten().dictionary_encode()
            # each distinct token of a batch is hashed once
            x = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big") % PRIME for t in flat.dictionary.to_pylist()], np.uint64)
            size = np.diff(
                np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
            ) if len(held) else np.zeros(0, np.int32)
            token, some = flat.indices.to_numpy(zero_copy_only=False), size > 0
            first = (np.cumsum(size) - size)[some]
            out = np.full((n, len(held)), NO_TOKEN, np.int64)
            for row, (a, b) in zip(out, family, strict=True):
                h = ((_times(a, x) + np.uint64(b)) % np.uint64(PRIME)) & np.uint64(NO_TOKEN)
                if first.size:
                    row[some] = np.minimum.reduceat(h[token], first).astype(np.int64)
            offsets = np.arange(0, (len(held) + 1) * n, n, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.T.ravel()))], names=[batch.schema.names[0], "signature"]
            )

    return run


def signatures(items: DataFrame, key: str, text: str, n: int = HASHES) -> DataFrame:
    """(key, signature): the smallest of each hash over an item's tokens, in the item's row.

    x is the first 64 bits of a token's md5, h = (a x + b) mod (2^61 - 1), its low 32 bits are kept.
    The signature of an item without a token is NO_TOKEN throughout.
    """
    return signatures_of(items.select(key, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("t")), key, n)


def signatures_of(rows: DataFrame, key: str, n: int = HASHES) -> DataFrame:
    """(key, signature) of rows (key, t), t being distinct tokens."""
    return rows.mapInArrow(_least(n), f"{key} {rows.schema[key].dataType.simpleString()}, signature array<bigint>")


def bands(signed: DataFrame, key: str, rows: int = 2) -> DataFrame:
    """(key, band, bucket) of each item from its signature; items without a token are in no bucket."""
    n = F.size("signature") / rows
    each = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.xxhash64(F.slice("signature", i * rows + 1, F.lit(rows))))
    return signed.where(F.get("signature", F.lit(0)) != NO_TOKEN).select(key, F.posexplode(each).alias("band", "bucket"))


def candidates(banded: DataFrame, key: str) -> DataFrame:
    """(earlier, later) of all members that share a bucket, each pair once; a crowded bucket is dealt to several tasks.

    For signatures of distinct texts at a threshold that few unrelated pairs reach; the all-pairs search of
    cosine.py gives the pairs of a threshold without buckets.
    """
    a, b = banded.select("band", "bucket", F.col(key).alias("earlier")), banded.select("band", "bucket", F.col(key).alias("later"))
    return in_parts(a, b, ["band", "bucket"]).where("earlier < later").select("earlier", "later").distinct()


def agreement(pairs: DataFrame, signed: DataFrame, key: str) -> DataFrame:
    """pairs with agreement: the share of equal hashes in both signatures."""
    a, b = signed.select(
        F.col(key).alias("earlier"), F.col("signature").alias("_a")
    ), signed.select(F.col(key).alias("later"), F.col("signature").alias("_b"))
    same = F.size(F.filter(F.zip_with("_a", "_b", lambda x, y: x == y), lambda x: x)) / F.size("_a")
    return pairs.join(a, "earlier").join(b, "later").withColumn("agreement", same).drop("_a", "_b")


def similar(items: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """(earlier, later, similarity) of all pairs whose token sets have a Jaccard similarity of `least` or more.

    Items of equal sets are one node, represented by the smallest key. Nodes meet in a prefix join:
    with the rare tokens first, sets that reach the threshold share one of their first
    n - ceil(least n) + 1 tokens; short sets still meet in common ones, whose lists are dealt to several tasks. An item that is not its node's
    first has one row, with the first; a node's pairs are given between first members.
    """
    sets = items.select(key, F.array_sort(tokens(F.col(text))).alias("t")).where(F.size("t") > 0)
    named = sets.withColumn("node", F.xxhash64("t"))
    nodes = named.groupBy("node").agg(F.min(key).alias("first"), F.min_by("t", key).alias("t"))
    each = nodes.select("first", F.size("t").alias("n"), F.explode("t").alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    # tokens of one node link nothing, but count in the order
    ordered = each.join(common, "token", "left").groupBy("first", "n").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "token"))).alias("by")
    )
    length = F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1
    prefix = ordered.select(
        "first", "n", F.posexplode(F.slice("by", F.lit(1), length)).alias("pos", "x")
    ).where("x.df > 1").select("first", "n", "pos", "x.token")
    a, b = prefix.toDF("a", "na", "pa", "token"), prefix.toDF("b", "nb", "pb", "token")
    need = least / (1 + least) * (F.col("na") + F.col("nb")) - 1e-9
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9) & (
        F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need
    )
    pairs = in_parts(a, b, ["token"]).where(fits).select("a", "b").distinct()
    side = nodes.select("first", "t")
    both = pairs.join(side.toDF("a", "ta"), "a").join(side.toDF("b", "tb"), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    scored = both.select(
        F.col("a").alias("earlier"), F.col("b").alias("later"), (shared / (F.size("ta") + F.size("tb") - shared)).alias("similarity")
    ).where(F.col("similarity") >= least - 1e-9)
    same = named.join(nodes.select("node", "first"), "node").where(F.col(key) != F.col("first")).select(
        F.col("first").alias("earlier"), F.col(key).alias("later"), F.lit(1.0).alias("similarity")
    )
    return scored.unionByName(same)


def best_earlier(pairs: DataFrame, threshold: Column | float) -> DataFrame:
    """(later, earlier, similarity): the most similar earlier item that reaches the pair's threshold, ties to the earlier."""
    scored = pairs.where(F.col("similarity") >= threshold)
    return scored.groupBy("later").agg(
        F.max_by(F.struct("earlier", "similarity"), F.struct("similarity", -F.col("earlier"))).alias("x")
    ).select("later", "x.earlier", "x.similarity")


def document_frequency(items: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df) over all items."""
    small_batches(items.sparkSession)  # of long texts that leave the JVM to be normalised
    return items.select(F.explode(tokens(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(items: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df, idf) with idf = ln(N / (1 + df)), which may be negative."""
    n = items.count()
    return document_frequency(items, key, text).select("term", "df", F.log(F.lit(n) / (1 + F.col("df"))).alias("idf"))


def earlier_frequency(items: DataFrame, key: str, text: str, width: int = 100_000) -> DataFrame:
    """(key, term, earlier): how many items of a smaller key hold the term.

    Counted in two levels, within ranges of `width` keys and over the ranges' totals, so a term
    that most items hold is not one task's work.
    """
    t = items.select(key, F.explode(tokens(F.col(text))).alias("term")).withColumn("part", F.floor(F.col(key) / width))
    within = Window.partitionBy("term", "part").orderBy(key)
    before = Window.partitionBy("term").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = t.groupBy("term", "part").agg(F.count("*").alias("n")).select(
        "term", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    counted = t.withColumn("place", F.row_number().over(within) - 1)
    return counted.join(totals, ["term", "part"]).select(key, "term", (F.col("place") + F.col("before")).cast("bigint").alias("earlier"))


def tfidf_cosine(items: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """(earlier, later, cosine) of the given pairs with global document frequencies."""
    asked = pairs.select(F.col("earlier").alias(key)).union(pairs.select("later")).distinct()
    words = items.join(asked, key, "left_semi").select(key, F.explode(all_tokens(F.col(text))).alias("term"))
    counts = words.groupBy(key, "term").agg(F.count("*").alias("c"))
    totals = counts.groupBy(key).agg(F.sum("c").alias("len"))
    weights = counts.join(totals, key).join(idf(items, key, text), "term").select(key, "term", (F.col("c") / F.col("len") * F.col("idf")).alias("w"))
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    a, b = weights.select(
        F.col(key).alias("earlier"), "term", F.col("w").alias("wa")
    ), weights.select(F.col(key).alias("later"), "term", F.col("w").alias("wb"))
    dots = pairs.select("earlier", "later").join(a, "earlier").join(b, ["later", "term"]).groupBy("earlier", "later").agg(
        F.sum(F.col("wa") * F.col("wb")).alias("dot")
    )
    out = pairs.select("earlier", "later").join(dots, ["earlier", "later"], "left").join(
        norms.select(F.col(key).alias("earlier"), F.col("norm").alias("na")), "earlier", "left"
    ).join(norms.select(F.col(key).alias("later"), F.col("norm").alias("nb")), "later", "left")
    return out.select(
        "earlier", "later",
        F.when(F.col("na") * F.col("nb") > 0, F.coalesce("dot", F.lit(0.0)) / (F.col("na") * F.col("nb"))).otherwise(0.0).alias("cosine")
    )
