"""Entity tagging and coverage. The registry is a small dimension; its size is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a dimension that may be broadcast.
MOST_BROADCAST = 100_000


def small(dimension: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The dimension with a broadcast hint if it is small, else as it is."""
    return F.broadcast(dimension) if dimension.limit(most + 1).count() <= most else dimension


def tag(items: DataFrame, registry: list[dict]) -> DataFrame:
    """Adds entities (registry order) and protected: any matched entity of tier 0.

    An entity matches by primary source or by a keyword anywhere in title and summary. The registry
    is configuration, so its tests compile into one projection without a join.
    """
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    hits = []
    for e in registry:
        by_word = text.rlike("|".join(e["keywords"])) if e["keywords"] else F.lit(False)
        hit = F.col("source_name").isin(e["primary"]) | by_word if e["primary"] else by_word
        hits.append((hit, e))
    entities = F.filter(F.array(*(F.when(h, F.lit(e["id"])) for h, e in hits)), lambda x: x.isNotNull())
    guarded = [h for h, e in hits if e["tier"] == 0]
    protected = F.coalesce(F.exists(F.array(*guarded), lambda x: x), F.lit(False)) if guarded else F.lit(False)
    return items.withColumn("entities", entities).withColumn("protected", protected)


def distribution(tagged: DataFrame) -> DataFrame:
    """Articles per entity, each article once per entity."""
    return tagged.select(F.explode(F.array_distinct("entities")).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


def coverage(tagged: DataFrame, registry: DataFrame) -> DataFrame:
    """Every entity of the registry with its count, zero included."""
    return registry.join(distribution(tagged), registry["id"] == F.col("entity"), "left").select(
        registry["id"].alias("entity"), registry["tier"], F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def source_alert(registry: DataFrame, health: DataFrame, least: int = 3) -> DataFrame:
    """Per entity: sources that work and that do not, and the alert level."""
    each = registry.select("id", F.explode(F.array_union("primary", "backup")).alias("name"))
    joined = each.join(health, "name", "left")
    down = F.coalesce(F.col("consecutive_failures"), F.lit(0)) >= least
    out = joined.groupBy("id").agg(F.count_if(~down).alias("ok"), F.count_if(down).alias("down"))
    return out.withColumn("level", F.when(F.col("down") == 0, "ok").when(F.col("ok") == 0, "critical").otherwise("degraded"))


def timelines(tagged: DataFrame, least: int, most: int, important: int = 4) -> DataFrame:
    """(entity, n, scale, key_events, timeline) of the `most` entities with most items, `least` at least.

    scale is the share of the largest, timeline the ids of the important items in time. Only the few
    entities that are shown gather ids.
    """
    each = tagged.select(F.explode(F.array_distinct("entities")).alias("entity"), "id", "importance", "collected_at").where("entity <> ''")
    top = each.groupBy("entity").agg(
        F.count("*").alias("n"), F.count_if(F.col("importance") >= important).alias("key_events")
    ).where(F.col("n") >= least).orderBy(F.desc("n"), "entity").limit(most)
    top = top.withColumn("scale", F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 4))  # `most` rows
    shown = each.where(F.col("importance") >= important).join(F.broadcast(top.select("entity")), "entity")
    ids = shown.groupBy("entity").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("collected_at", "id"))), lambda x: x["id"].cast("string")).alias("timeline")
    )
    return top.join(ids, "entity", "left")
