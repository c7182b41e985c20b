"""Filters and caps of the ingest and briefing steps. All are DataFrame in, DataFrame out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.entities import small
from newsloom.sources.tables import cut, free


def tiered_age(items: DataFrame, as_of: Column, limits: dict[int, int], default_hours: int, override: str | None = None) -> DataFrame:
    """Items without a date pass; others must be no older than their own limit, their tier's, or the default."""
    limit = F.lit(default_hours)
    for tier, hours in limits.items():
        limit = F.when(F.col("tier") == tier, hours).otherwise(limit)
    if override:
        limit = F.coalesce(F.col(override), limit)
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(F.col("published").cast("timestamp_ntz"))) / 3600
    return items.where(F.col("published").isNull() | (age <= limit))


def roundup_free(items: DataFrame, lead: str, keyword: str) -> DataFrame:
    """Drops collective posts: a column label at the start, or a digest keyword anywhere."""
    title = F.coalesce(F.col("title"), F.lit(""))
    return items.where(~(title.rlike(lead) | title.rlike(keyword)))


def keyword_prefilter(items: DataFrame, english: str, chinese: str, trusted: list[str], head: int = 300) -> DataFrame:
    """Passes tier 1 and better, sources of the subject only, trusted media, protected items, and what names a keyword of
    either language in the title or the summary's first `head` characters; the cheap tests come first."""
    text = F.lower(F.concat_ws(" ", "title", F.substring("summary", 1, head)))
    always = (F.coalesce("tier", F.lit(2)) <= 1) | F.coalesce("ai_only", F.lit(False)) | F.col("source_name").isin(trusted) | F.coalesce("protected", F.lit(False))
    return items.where(F.coalesce(always, F.lit(False)) | text.rlike(english) | text.rlike(chinese))


def per_source_cap(items: DataFrame, cap: int, order: list[Column], protected: Column | None = None) -> DataFrame:
    """The first `cap` items of each source; protected items are exempt but counted."""
    place = F.row_number().over(Window.partitionBy("source_name").orderBy(*order))
    keep = F.col("_place") <= cap
    return items.withColumn("_place", place).where(keep if protected is None else keep | protected).drop("_place")


def tiered_quota(items: DataFrame, budget: int, floor: int, order: list[Column], cap: int = 8, cap0: int = 15) -> DataFrame:
    """Items of tier 0 (cap0 a source), then max(floor, half of the rest) of tier 1, then tier 2 up to the budget.

    Each source gives tiers 1 and 2 `cap` items at most; protected items are exempt from these caps. Each
    cut is a limit on a total order, so that no tier is sorted in one task.
    """
    t0, t1, t2 = (per_source_cap(items.where(F.col("tier") == tier), n, order, F.col("protected")) for tier, n in ((0, cap0), (1, cap), (2, cap)))
    n0, n1 = t0.count(), t1.count()
    k1 = min(n1, max(floor, (budget - n0) // 2))
    return t0.unionByName(t1.orderBy(*order).limit(k1)).unionByName(t2.orderBy(*order).limit(max(0, budget - n0 - k1)))


def _first(rows: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """The first `cap` rows (group, order, _e) of each entity, numbered _n; the limit is taken before the shuffle as well."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group, "_e").orderBy(order))).where(F.col("_n") <= cap)


def entity_rate_limit(items: DataFrame, cap: int, order: str, group: str = "day") -> DataFrame:
    """Accept an item if each of its entities has been accepted fewer than `cap` times before in its group.

    Protected items are always accepted and counted; items without an entity are accepted. The order is
    unique in a group (a day of one batch) and not null.

    Decided in rounds. An item is certainly rejected if one of its entities has its cap-th accepted item
    before it, and certainly accepted if for each entity fewer than cap items before it are accepted
    or still open. The earliest open item of a group is always decided, and commonly all but a few in two
    or three rounds. A round needs the first cap items of each entity only, so no group and no entity
    is one task's work.
    """
    columns, given = items.columns, group
    group = "_g"  # null is a group like any other
    items = items.withColumn(group, F.coalesce(F.concat(F.lit("="), F.col(given).cast("string")), F.lit("")))
    key = [F.col(group), F.col(order)]
    names = F.array_distinct(F.coalesce("entities", F.array().cast("array<string>")))
    bound = cut(items.where(F.size(names) > 0).select(*key, names.alias("_es"), F.coalesce("protected", F.lit(False)).alias("_p")), "bound")
    each = F.explode("_es").alias("_e")
    held = cut(_first(bound.where("_p").select(*key, each), group, order, cap).drop("_n"), "held")
    accepted, open_ = [bound.where("_p").select(*key)], cut(bound.where("not _p").drop("_p"), "open")
    while open_.limit(1).count():
        rows = open_.select(*key, each)
        sure = _first(held, group, order, cap).where(F.col("_n") == cap).select(group, "_e", F.col(order).alias("_sure"))
        most = _first(held.unionByName(rows), group, order, cap).where(F.col("_n") == cap).select(group, "_e", F.col(order).alias("_most"))
        limits = small(most.join(sure, [group, "_e"], "left"))
        judged = rows.join(limits, [group, "_e"], "left").groupBy(*key).agg(
            F.bool_or(F.coalesce(F.col(order) > F.col("_sure"), F.lit(False))).alias("_no"),
            F.bool_and(F.coalesce(F.col(order) <= F.col("_most"), F.lit(True))).alias("_yes")
        )
        judged = cut(open_.join(judged, [group, order]), "judged")
        good = judged.where("_yes and not _no")
        accepted.append(good.select(*key))
        before, old = held, open_
        held = cut(_first(held.unionByName(good.select(*key, each)), group, order, cap).drop("_n"), "held")
        open_ = cut(judged.where("not _yes and not _no").drop("_yes", "_no"), "open")
        free(before, old)
    kept = reduce(DataFrame.unionByName, accepted)
    return items.where(F.size(names) == 0).unionByName(items.where(F.size(names) > 0).join(kept, [group, order], "left_semi")).select(*columns)


def shift_window(items: DataFrame, start: Column, end: Column) -> DataFrame:
    """start <= published < end; items without a date are out."""
    return items.where((F.col("published") >= start) & (F.col("published") < end))


def not_rendered(items: DataFrame, start: Column) -> DataFrame:
    """Without those rendered since the window's start and not updated after it."""
    rendered = F.col("rendered_at")
    return items.where(~F.coalesce((rendered >= start) & ~F.coalesce(F.col("last_updated_at") > rendered, F.lit(False)), F.lit(False)))


def substance() -> Column:
    """Summary of 20 characters, and by analysis level: two key details, or any of the longer fields."""
    details = F.size(F.filter(F.coalesce("key_details", F.array()), lambda d: F.length(d) >= 10))
    deep = (F.length("background") > 0) | (F.length("deep_analysis") > 0) | (F.length("detailed_content") >= 100) | (details >= 2)
    return F.coalesce((F.length("summary") >= 20) & F.when(F.col("level") == 0, details >= 2).otherwise(F.coalesce(deep, F.lit(False))), F.lit(False))


def substantial(items: DataFrame) -> DataFrame:
    return items.where(substance())


def config_problems(sources: DataFrame) -> DataFrame:
    """(name, problem) for each constraint that a source row violates."""
    checks = [
        (F.coalesce(F.col("name"), F.lit("")) == "", "no name"), (F.coalesce(F.col("url"), F.lit("")) == "", "no url"),
        (~F.coalesce(F.col("tier"), F.lit(-1)).isin(0, 1, 2), "tier out of range"), (F.col("max_age_hours") <= 0, "age not positive"),
    ]
    found = F.filter(F.array(*(F.when(bad, F.lit(text)) for bad, text in checks)), lambda x: x.isNotNull())
    return sources.select("name", F.explode(found).alias("problem"))


def key_problems(sources: DataFrame, required: list[str], known: list[str]) -> DataFrame:
    """(name, problem) for keys that a source's configuration (name, keys) lacks or that nothing knows."""
    missing = F.transform(F.array_except(F.lit(required), F.col("keys")), lambda k: F.concat(F.lit("missing key "), k))
    unknown = F.transform(F.array_except(F.col("keys"), F.lit(known)), lambda k: F.concat(F.lit("unknown key "), k))
    return sources.select("name", F.explode(F.concat(missing, unknown)).alias("problem"))


def dangling(authorities: DataFrame, sources: DataFrame) -> DataFrame:
    """(name, problem) for configured authorities of sources that are not there."""
    return authorities.select("name").distinct().join(sources.select("name").distinct(), "name", "left_anti").select(
        "name", F.lit("authority without source").alias("problem")
    )
