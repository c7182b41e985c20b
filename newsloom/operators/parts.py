"""Joins on keys that very many rows of both sides may have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.entities import small

#: rows of a part of a key's list
PART = 2048


def in_parts(left: DataFrame, right: DataFrame, keys: list[str], part: int = PART) -> DataFrame:
    """left joined to right on keys, where a long list of a key is cut into parts and each pair of parts is a key of its own."""
    sizes = left.select(*keys).unionByName(right.select(*keys)).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > part)
    cuts = small(sizes.select(*keys, F.ceil(F.col("_n") / part).cast("int").alias("_g")))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        with_cuts = side.join(cuts, keys, "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
        place = F.pmod(F.xxhash64(*[c for c in side.columns if c not in keys]), F.col("_g")).cast("int")
        return with_cuts.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_g") - 1))).drop("_g")

    return dealt(left, "_i", "_j").join(dealt(right, "_j", "_i"), [*keys, "_i", "_j"]).drop("_i", "_j")
