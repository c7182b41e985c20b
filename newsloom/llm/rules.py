"""Quality classifier: a sparse rule ensemble that compiles to column expressions.

Each text becomes a row of statistics. A shallow random forest is fitted on labelled rows; every
path from a root to a node is a rule, a conjunction of comparisons. A lasso logistic regression
over the rules keeps few of them, and the score is one Spark column expression over the statistics.

Null and empty texts have all statistics 0 and are scored like others. Without labelled rows the
score is 0.5; with one class only it is that class. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import tokens as tk
from newsloom.llm.shared import crc_mod, cut, lean, small_batches

STATS = [
    "words", "word_len", "upper", "digit", "symbol", "marked", "distinct", "same", "top", "short", "grams", "lines", "line_len", "line_same",
    "joined", "long"
]
TREES, DEPTH, LASSO, SEED, THRESHOLD = 24, 4, 0.002, 7, 0.3
#: Labelled rows that the model is fitted on: those with the smallest hashes of doc_id.
MOST_LABELLED = 20_000

_B = np.arange(256)
_UPPER = (_B >= 0x41) & (_B <= 0x5A)
_DIGIT = (_B >= 0x30) & (_B <= 0x39)
_WORD = _UPPER | _DIGIT | ((_B >= 0x61) & (_B <= 0x7A)) | (_B >= 0x80)
_SYMBOL = ~_WORD & tk.NOT_SPACE
#: symbols other than those of plain prose
_ODD = _SYMBOL & ~np.isin(_B, [ord(c) for c in ".,;:'\"-()?"])


@lean
def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, statistics) of each row."""
    for batch in batches:
        out = np.zeros((len(STATS), batch.num_rows))
        for lo, hi, data, off in tk.chunks(batch.column("text")):
            s, e, row = tk.spans(data, off, tk.NOT_SPACE)
            h = tk.word_hashes(data, s, e)
            three = tk.grams(h, 3)
            at, size = tk.bounds(row, hi - lo), e - s

            def share(table: np.ndarray, data=data, off=off) -> np.ndarray:
                total = np.r_[0, np.cumsum(table[data])]
                return (total[off[1:]] - total[off[:-1]]) / np.maximum(1, np.diff(off))

            per = lambda flag, row=row, n=hi - lo: np.bincount(row, flag, n)
            n = np.diff(at)
            some = np.maximum(n, 1)
            x = out[:, lo:hi]
            x[0], x[1], x[2], x[3], x[4] = n, per(size) / some, share(_UPPER), share(_DIGIT), share(_ODD)
            x[5] = per(_ODD[data[e - 1]]) / some
            again = np.r_[False, (h[1:] == h[:-1]) & (row[1:] == row[:-1])] if h.size else np.zeros(0, bool)
            x[7], x[9] = per(again) / some, per(size <= 3) / some
            x[14], x[15] = per(size == 1) / some, per(size > 20) / some
            lines = np.flatnonzero(data == 0x0A)
            lrow = np.searchsorted(off, lines, side="right") - 1
            x[11] = np.bincount(lrow, minlength=hi - lo)[: hi - lo] + (n > 0)
            x[12] = n / np.maximum(1, x[11])
            ls, le, lr = tk.spans(data, off, _B != 0x0A)
            lh, lat = tk.word_hashes(data, ls, le), None
            lat = tk.bounds(lr, hi - lo)
            for r in range(hi - lo):
                a, b = at[r], at[r + 1]
                if b > a:
                    _, count = np.unique(h[a:b], return_counts=True)
                    x[6, r], x[8, r] = count.size / (b - a), count.max() / (b - a)
                    x[10, r] = np.unique(three[a : b - 2]).size / (b - a - 2) if b - a > 2 else 1
                if (k := lat[r + 1] - lat[r]) > 1:
                    x[13, r] = 1 - np.unique(lh[lat[r] : lat[r + 1]]).size / k
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v) for v in out)], names=["doc_id", *STATS])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(statistics, "doc_id bigint, " + ", ".join(f"{s} double" for s in STATS))


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, at most?, bound)


def paths(forest) -> list[Rule]:
    """Every distinct path of a fitted forest, as the tightest bounds per statistic."""
    found: dict[Rule, None] = {}

    def walk(node, bounds: dict) -> None:
        if bounds:
            found[tuple((s, low, b) for (s, low), b in sorted(bounds.items()))] = None
        if node.numDescendants():
            split = node.split()
            stat, bound = STATS[split.featureIndex()], split.threshold()
            walk(node.leftChild(), bounds | {(stat, True): min(bound, bounds.get((stat, True), np.inf))})
            walk(node.rightChild(), bounds | {(stat, False): max(bound, bounds.get((stat, False), -np.inf))})

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


def condition(rule: Rule) -> Column:
    return reduce(Column.__and__, [F.col(s) <= b if low else F.col(s) > b for s, low, b in rule])


class Ensemble:
    """Rules with weights; score() is a Spark column over the statistics."""

    def __init__(self, base: float, rules: list[tuple[Rule, float]]):
        self.base, self.rules = base, rules

    def score(self) -> Column:
        total = reduce(Column.__add__, [F.when(condition(r), w).otherwise(0.0) for r, w in self.rules], F.lit(self.base))
        return 1 / (1 + F.exp(-total))


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Ensemble:
    """An ensemble from statistics and label (0 or 1)."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not n or ones in (0, n):
        return Ensemble(0.0 if not n else 20.0 if ones else -20.0, [])
    data = VectorAssembler(inputCols=STATS, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, maxBins=64, subsamplingRate=0.7, minInstancesPerNode=5).fit(data)
    rules = paths(forest)
    if not rules:
        return Ensemble(float(np.log(ones / (n - ones))), [])
    flags = rows.select("label", F.array(*(condition(r).cast("double") for r in rules)).alias("flags"))
    from pyspark.ml.functions import array_to_vector

    flags = flags.select("label", array_to_vector("flags").alias("features"))
    lr = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=True).fit(flags)
    return Ensemble(float(lr.intercept), [(r, float(w)) for r, w in zip(rules, lr.coefficients, strict=True) if w])


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 5) == 0


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """rows, or about `most` of them with the smallest hashes of doc_id; the bound is on the hash, so nothing is ranked."""
    n, top = rows.count(), 1 << 62
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("doc_id", F.lit("rules")), F.lit(top)) < top // n * most)


def predict(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns from labelled rows that are not held out, about most_labelled of them."""
    stats = cut(measure(docs), "statistics")
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("double").alias("label"))
    model = fit(cut(stats.join(sampled(known, most_labelled), "doc_id"), "labelled"))
    out = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
