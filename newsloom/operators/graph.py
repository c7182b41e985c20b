"""Connected components by contraction with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.sources.tables import cut, free


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component.

    Each round every node points at its smallest neighbour. The cycles of such pointers have two
    nodes, one of them the smallest of its tree; it becomes the root. Each tree is contracted to
    its root and edges are renamed, so a round leaves at most half of the nodes of unfinished
    components, whatever their shape, and rounds need no cap. Every step ends in a written table;
    the driver sees counts. Smallest neighbours of hub nodes are partially aggregated.
    """
    edges = cut(_distinct(edges), "edges")
    levels = []
    while not levels or edges.limit(1).count():
        near = cut(edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "near")
        levels.append(_roots(near))
        renamed = edges
        for side in ("a", "b"):
            renamed = renamed.join(levels[-1].select(F.col("node").alias(side), "root"), side).withColumn(side, F.col("root")).drop("root")
        renamed = cut(_distinct(renamed), "edges")
        free(near, edges)
        edges = renamed
    free(edges)
    labels = levels.pop()
    while levels:
        level, above = levels.pop(), labels
        joined = level.join(above.select("root", "node").toDF("top", "root"), "root", "left")
        labels = cut(joined.select("node", F.coalesce("top", "root").alias("root")), "labels")
        free(level, above)
    return labels.select("node", "root")


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(near: DataFrame) -> DataFrame:
    """(node, root, moved) from the smallest neighbours (node, root): pointers doubled until none moves."""
    first = F.when(F.col("then") == F.col("node"), F.least("node", "root")).otherwise(F.col("root"))
    labels = cut(_next(near).select("node", first.alias("root"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        doubled = cut(_next(labels).select("node", F.col("then").alias("root"), (F.col("root") != F.col("then")).alias("moved")), "labels")
        free(labels)
        labels = doubled
    return labels


def _next(labels: DataFrame) -> DataFrame:
    """(node, root, then): each node's pointer and where that points."""
    return labels.select("node", "root").join(labels.select(F.col("node").alias("root"), F.col("root").alias("then")), "root")
