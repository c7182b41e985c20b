"""Validation, caching and repair of item analyses. The analyser itself is given by the caller."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.sources.tables import cut

#: fixed values: the kinds of source and the limits of the fields
SOURCE_TYPES = ("official", "paper", "news", "opinion", "community", "video")
TITLE, SUMMARY, DETAILS, DETAIL = 60, 150, 5, 80
DIRECTIONS, CONFIDENCES, AUDIENCES = ("positive", "negative", "mixed", "neutral"), ("high", "medium", "low"), (
    "researcher", "developer", "pm", "investor", "general"
)
CHINESE = 0.6
#: fixed values: what errors of a rate limit say
RATE_LIMITS = ("429", "rate_limit", "rate limit", "overloaded", "quota", "too many requests", "usage limit")


def _list(name: str) -> Column:
    return F.coalesce(name, F.array().cast("array<string>"))


def chinese_ratio(text: Column) -> Column:
    """Chinese characters among those that are neither space nor digit; 1 if there are none."""
    rest = F.length(F.regexp_replace(text, r"[\s\p{Nd}]", ""))
    return F.when(rest > 0, F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}]")) / rest).otherwise(1.0)


def enumerated(raw: DataFrame) -> DataFrame:
    """The analysis' lists and enumerations: dotted events (3) and assets (5), a known direction, confidence and audience (3),
    reading minutes by the length of the texts where none is stated, and the names of fields that are hardly Chinese."""
    texts = F.concat_ws("", "detailed_content", "summary", "background", "deep_analysis")
    stated = F.coalesce(F.try_to_number("reading_minutes", F.lit("S999")).cast("int"), F.lit(0))
    minutes = F.when(stated > 1, stated).otherwise(
        F.greatest(F.lit(1), F.expr("int(char_length(concat_ws('', detailed_content, summary, background, deep_analysis)) div 400)"))
    )
    wanted = F.slice(F.filter(F.transform(_list("audience"), lambda a: F.lower(F.trim(a))), lambda a: a.isin(*AUDIENCES)), 1, 3)
    poor = F.array(
        *(F.when((F.length(F.col(c)) > 0) & (chinese_ratio(F.col(c)) < CHINESE), F.lit(c)) for c in ("title", "summary", "why_it_matters"))
    )
    return raw.select(
        "id", F.greatest(F.lit(1), F.least(F.lit(30), minutes)).alias("reading_minutes"), F.length(texts).alias("n_text"),
        F.filter(F.slice(_list("causal_events"), 1, 3), lambda e: F.contains(e, F.lit("."))).alias("causal_events"), F.filter(
            F.slice(_list("affected_assets"), 1, 5), lambda e: F.contains(e, F.lit("."))
        ).alias("affected_assets"),
        F.when(F.col("impact_direction").isin(*DIRECTIONS), F.col("impact_direction")).otherwise("neutral").alias("impact_direction"), F.when(
            F.col("impact_confidence").isin(*CONFIDENCES), F.col("impact_confidence")
        ).otherwise("low").alias("impact_confidence"),
        F.when(F.size(wanted) > 0, wanted).otherwise(F.array(F.lit("general"))).alias("audience"), F.filter(poor, lambda x: x.isNotNull()).alias("low_chinese_ratio"),
    ).drop("n_text")


def validated(raw: DataFrame) -> DataFrame:
    """Analyses within their limits: importance 1 to 5, a known source type, two categories, five details."""
    return raw.select(
        "id", F.substring(F.trim("title"), 1, TITLE).alias("title"), F.substring(F.trim("summary"), 1, SUMMARY).alias("summary"),
        F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(F.try_to_number("importance", F.lit("S999")).cast("int"), F.lit(3)))).alias("importance"),
        F.when(F.col("source_type").isin(*SOURCE_TYPES), F.col("source_type")).otherwise("news").alias("source_type"),
        F.slice(F.coalesce("categories", F.array().cast("array<string>")), 1, 2).alias("categories"),
        F.transform(
            F.slice(F.coalesce("details", F.array().cast("array<string>")), 1, DETAILS), lambda d: F.substring(d, 1, DETAIL)
        ).alias("details"),
    )


def from_cache(items: DataFrame, cache: DataFrame, as_of, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(items with a cached analysis of good quality, items without), by url key; old entries do not count."""
    fresh = cache.where((F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days))) & (~F.col("relevant") | (F.length("content") > 0)))
    return items.join(fresh.select("url_key", "content", "relevant"), "url_key"), items.join(
        fresh.select("url_key").distinct(), "url_key", "left_anti"
    )


def tiered(
    items: DataFrame, rules: Callable[[DataFrame], DataFrame], cache: DataFrame, analyse: Callable[[DataFrame], DataFrame] | None, as_of
) -> DataFrame:
    """Rules for all, then the cache, then the analyser for what is left; without one, the rules' result stands.

    rules and analyse return the items with columns content and relevant.
    """
    ruled = rules(items)
    hit, missed = from_cache(ruled.drop("content", "relevant"), cache, as_of)
    rest = analyse(missed) if analyse else missed.join(ruled.select("id", "content", "relevant"), "id")
    return hit.withColumn("level", F.lit("cache")).unionByName(rest.withColumn("level", F.lit("analysed" if analyse else "rules")))


def _rate_limited(error: Column) -> Column:
    """Whether an error says that the service takes no more for now."""
    return F.lower(error).rlike("|".join(RATE_LIMITS))


def fused(items: DataFrame, analyse: Callable[[DataFrame], DataFrame], order: list[Column], waves: int = 10, least: int = 3, share: float = 0.3) -> DataFrame:
    """The items that were tried (id, content, relevant, error), analysed in waves until a fuse blows.

    analyse returns these columns, error null where it worked. After each wave the failures of all waves
    are counted: at max(least, share of all items) of them, or at any answer that tells of a rate
    limit, no further wave is started. Items stand in the given order, which must be total; a wave
    is one job, so whole waves are tried. Without items nothing is tried.
    """
    from newsloom.operators.ranking import placed

    total = items.count()
    fuse, size = max(least, int(total * share)), max(1, -(-total // waves))
    ordered, tried, failures = placed(items, order), [], 0
    for wave in range(-(-total // size)):
        part = ordered.where(F.col("place").between(wave * size + 1, (wave + 1) * size)).drop("place")
        tried.append(cut(analyse(part).select("id", "content", "relevant", "error"), "analysed"))
        failed, limited = tried[-1].agg(F.count("error"), F.coalesce(F.bool_or(_rate_limited(F.col("error"))), F.lit(False))).first()
        failures += failed
        if limited or failures >= fuse:
            break
    return reduce(DataFrame.unionByName, tried) if tried else analyse(items).select("id", "content", "relevant", "error")


def tiered_fused(
    items: DataFrame, rules: Callable[[DataFrame], DataFrame], cache: DataFrame, analyse: Callable[[DataFrame], DataFrame], as_of, order: list[Column], **limits: float
) -> DataFrame:
    """tiered() with a fuse: items whose analysis failed or was not tried keep the rules' result."""
    ruled = rules(items)
    hit, missed = from_cache(ruled.drop("content", "relevant"), cache, as_of)
    good = fused(missed, analyse, order, **limits).where("error is null and relevant is not null").drop("error")
    rest = missed.join(good.select("id", F.col("content").alias("_c"), F.col("relevant").alias("_r")), "id", "left").join(
        ruled.select("id", "content", "relevant"), "id"
    )
    done = F.col("_r").isNotNull()
    rest = rest.withColumn("level", F.when(done, "analysed").otherwise("rules")).withColumn("content", F.when(done, F.col("_c")).otherwise(F.col("content")))
    rest = rest.withColumn("relevant", F.coalesce("_r", "relevant")).drop("_c", "_r")
    return hit.withColumn("level", F.lit("cache")).unionByName(rest)


def polluted(analyses: DataFrame) -> DataFrame:
    """Analyses of level 1 whose longer fields are all but empty."""
    return analyses.where(
        (F.col("level") == 1) & (
            F.length(F.coalesce("background", F.lit(""))) == 0
        ) & (F.length(F.coalesce("deep", F.lit(""))) == 0) & (F.length(F.coalesce("content", F.lit(""))) < 100)
    )


def filled(events: DataFrame, articles: DataFrame, fields: list[str]) -> DataFrame:
    """Empty event fields from the event's canonical article."""
    a = articles.select(F.col("id").alias("_id"), *(F.col(f).alias(f"_{f}") for f in fields))
    j = events.join(a, events["canonical_article_id"] == a["_id"], "left")
    return j.select(*(F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) if c in fields else F.col(c) for c in events.columns))


def publishable(judgments: DataFrame) -> DataFrame:
    return judgments.where((F.col("contradicted") == 0) & (F.col("confidence") != "low"))
