"""Ranking, page layout and image clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(items: DataFrame, score: Column, tie: str) -> DataFrame:
    """Items with their score; the order is total, so equal scores have a fixed order."""
    return items.withColumn("score", score).orderBy(F.desc("score"), tie)


def placed(items: DataFrame, order: list[Column]) -> DataFrame:
    """Adds place, 1 for the first, in a total order: rows are range-sorted into parts, and each part starts after those before it.

    The sorted rows are written, since a sample decides the parts and must decide them once.
    """
    from newsloom.sources.tables import cut

    part = cut(items.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "placed")
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a part
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return part.withColumn("_k", within).join(
        F.broadcast(sizes.select("_part", before.alias("_before"))), "_part"
    ).withColumn("place", F.col("_k") + F.col("_before")).drop("_part", "_k", "_before")


def _featured_key() -> Column:
    reports = F.when(F.col("reports") >= 4, 1.0).when(F.col("reports") == 3, 0.8).when(F.col("reports") == 2, 0.5).otherwise(0.0)
    return F.col("importance") + reports + F.when(F.col("today"), 0.7).otherwise(0.0)


def featured(items: DataFrame, most: int = 10) -> DataFrame:
    """The first `most` items of importance 3 and more by importance, reports and recency."""
    return items.where("importance >= 3").withColumn("key", _featured_key()).orderBy(F.desc("key"), "id").limit(most)


def page_order(items: DataFrame, most: int = 10) -> DataFrame:
    """All items with section and place in it: the first `most` featured ones, then in `more` the other featured ones before the rest.

    Featured items stand by their key, the rest in the order of id. The places come from a range sort.
    """
    chosen = F.col("importance") >= 3
    ordered = placed(
        items.withColumn("_rest", ~chosen).withColumn("key", F.when(chosen, _featured_key())), [F.col("_rest").asc(), F.col("key").desc_nulls_last(), F.col("id").asc()]
    )
    first = ~F.col("_rest") & (F.col("place") <= most)
    n = min(most, ordered.where("not _rest").limit(most).count())
    return ordered.withColumn("section", F.when(first, "featured").otherwise("more")).withColumn(
        "place", F.when(first, F.col("place")).otherwise(F.col("place") - n)
    ).drop("_rest")


def top_three(items: DataFrame) -> DataFrame:
    """Filled in three phases: importance 5 with several reports, then 4 with several, then any."""
    phase = F.when((F.col("importance") == 5) & (F.col("reports") >= 2), 1).when((F.col("importance") >= 4) & (F.col("reports") >= 2), 2).otherwise(3)
    return items.withColumn("phase", phase).orderBy("phase", F.desc("importance"), "id").limit(3)


def first_per_group(items: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return items.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def images(items: DataFrame, noise: str, generic: int = 3) -> DataFrame:
    """Adds image_used: the image unless it is noise or stands on `generic` items or more, else the first clean alternate."""
    count = items.groupBy("image").agg(F.count("*").alias("uses"))
    common = count.where(F.col("uses") >= generic).select("image")
    bad = items.join(common.withColumn("_common", F.lit(True)), "image", "left")
    shared = F.coalesce(F.col("_common"), F.lit(False))
    clean = lambda u: u.isNotNull() & u.rlike("^https?://") & ~u.rlike(noise)
    first = F.try_element_at(F.filter("alternates", clean), F.lit(1))
    return bad.withColumn(
        "image_used", F.when(clean(F.col("image")) & ~shared, F.col("image")).otherwise(F.coalesce(first, F.lit("")))
    ).drop("_common")


def storyline_guard(items: DataFrame, recurring: DataFrame, key: str) -> DataFrame:
    """Without recurring items, unless more than half would go; then all stay."""
    marked = items.join(recurring.select(key).distinct().withColumn("_old", F.lit(True)), key, "left")
    old, n = marked.agg(F.count_if("_old"), F.count("*")).first()
    return items if old * 2 > n else marked.where(F.col("_old").isNull()).drop("_old")


def page_stats(items: DataFrame, audience: str, category: str) -> DataFrame:
    """Per source: n, the mean of the importances over 0, the distinct audiences in order and the number of categories."""
    return items.groupBy("source_name").agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("importance") > 0, F.col("importance"))).alias("mean_importance"),
        F.array_sort(F.collect_set(audience)).alias("audiences"), F.count_distinct(category).alias("categories")
    )


def important_days(events: DataFrame, published: str, as_of: Column, zone: str, days: int = 7, least: int = 4) -> DataFrame:
    """events of importance `least` and more that were rendered (rendered_at) within the days, with local day and time of publication.

    Times are UTC. page is the day and shift of the rendering: its stored shift (rendered_shift, if there is such a
    column) or by its local hour. Undated events are left out. Rows of a day are not gathered; they
    order by day and published.
    """
    def local(at: Column) -> Column:
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), at.cast("timestamp_ntz"))

    recent = events.where((F.col("importance") >= least) & F.col(published).isNotNull() & (F.col("rendered_at") >= as_of - F.make_dt_interval(F.lit(days))))
    at, shown = local(F.col(published)), local(F.col("rendered_at"))
    by_hour = F.when(F.hour(shown) >= 12, "pm").otherwise("am")
    stored = F.when(F.col("rendered_shift").isin("am", "pm"), F.col("rendered_shift")) if "rendered_shift" in events.columns else F.lit(None).cast("string")
    return recent.withColumn("day", F.date_format(at, "yyyy-MM-dd")).withColumn("time", F.date_format(at, "HH:mm")).withColumn(
        "page", F.concat(F.date_format(shown, "yyyy-MM-dd"), F.lit("-"), F.coalesce(stored, by_hour))
    )
