"""The briefing step: gates, page sections, labels, run records and their counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.filters import substance


def enabled_sources(sources: DataFrame, tiers: list[int] | None = None) -> DataFrame:
    """Sources that are enabled (or do not say) and not disabled, of the given tiers if any are given."""
    on = F.coalesce("enabled", F.lit(True)) & ~F.coalesce("disabled", F.lit(False))
    return sources.where(on if tiers is None else on & F.coalesce("tier", F.lit(2)).isin(tiers))


def worth_publishing(events: DataFrame) -> DataFrame:
    """Events of an official source or of official status, and those with substance."""
    return events.where((F.col("tier") == 0) | (F.col("status") == "official") | substance())


def worth_showing(items: DataFrame) -> DataFrame:
    """Analysed items with substance; by rules only, those of importance 2 with a summary of 20 characters."""
    basic = (F.coalesce("importance", F.lit(0)) >= 2) & (F.length(F.trim("summary")) >= 20)
    return items.where(F.when(F.col("level") >= 1, substance()).otherwise(F.coalesce(basic, F.lit(False))))


def due_for_scoring(judgments: DataFrame, scored: DataFrame, as_of: Column, least: int = 5, most: int = 45, limit: int = 12) -> DataFrame:
    """The oldest judgments of `least` to `most` days that have no verdict yet."""
    age = F.datediff(as_of, "date")
    return judgments.where(age.between(least, most)).join(scored.select("key").distinct(), "key", "left_anti").orderBy("date", "key").limit(limit)


def source_badge(tier: Column, source_type: Column) -> Column:
    """The badge of a source: official, academic, video, community or media."""
    kind = F.trim(F.coalesce(source_type, F.lit("")))
    named = F.when(
        (tier == 0) | (kind == "official"), "official"
    ).when(kind == "paper", "academic").when(kind == "video", "video").when(kind == "community", "community")
    return F.when(tier == 0, "official").otherwise(F.coalesce(named, F.when(tier == 1, "academic").otherwise("media")))


def label_title(title: Column, labels: dict[str, str], products: str) -> Column:
    """Up to two known names in a title and its first product, joined by ' | '; empty for titles in Chinese characters."""
    found = F.filter(F.array(*(F.when(F.contains(F.lower(title), F.lit(k)), F.lit(v)) for k, v in labels.items())), lambda x: x.isNotNull())
    parts = F.concat(F.slice(found, 1, 2), F.slice(F.regexp_extract_all(title, F.lit(f"({products})"), 1), 1, 1))
    chinese = F.regexp_count(title, F.lit(r"[\x{4E00}-\x{9FFF}]")) > 0.3 * F.length(title)
    return F.when(F.coalesce(chinese, F.lit(False)), "").otherwise(F.array_join(parts, " | "))


def category_distribution(items: DataFrame, most: int = 2) -> DataFrame:
    """Relevant items by category; the first `most` categories of an item count."""
    each = items.where("relevant").select(F.explode(F.slice("categories", 1, most)).alias("category"))
    return each.where("category <> ''").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def run_health(health: DataFrame, disabled: DataFrame, listed: int = 5) -> DataFrame:
    """One row: working, failing (3) and dead (10) sources that are not disabled, and the first dead ones by name."""
    live = health.join(disabled.select("name").distinct(), "name", "left_anti")
    dead = live.where("consecutive_failures >= 10").orderBy("name").limit(listed).agg(F.array_sort(F.collect_list("name")).alias("dead_sources"))
    counts = live.agg(
        F.count_if(F.col("status") == "ok").alias("healthy"), F.count_if(F.col("consecutive_failures") >= 3).alias("failing"),
        F.count_if(F.col("consecutive_failures") >= 10).alias("dead")
    )
    return counts.crossJoin(F.broadcast(dead))  # one row each


def failing_sources(health: DataFrame) -> DataFrame:
    """Sources that fail 3 to 9 times (failing) or 10 and more (dead), worst first."""
    level = F.when(F.col("consecutive_failures") >= 10, "dead").otherwise("failing")
    return health.where("consecutive_failures >= 3").select(
        "name", "consecutive_failures", level.alias("level")
    ).orderBy(F.desc("consecutive_failures"), "name")


def usage_totals(calls: DataFrame) -> DataFrame:
    """Per stage: calls, tokens and parse failures; a call names its tokens in either of two ways, and a total or none."""
    prompt = F.coalesce(F.nullif("prompt_tokens", F.lit(0)), "input_tokens", F.lit(0))
    answer = F.coalesce(F.nullif("completion_tokens", F.lit(0)), "output_tokens", F.lit(0))
    total = F.coalesce(F.nullif("total_tokens", F.lit(0)), prompt + answer)
    return calls.groupBy("stage").agg(
        F.count("*").alias("calls"), F.sum(prompt).alias("prompt_tokens"), F.sum(answer).alias("completion_tokens"),
        F.sum(total).alias("total_tokens"), F.count_if("parse_failed").alias("parse_failures")
    )


def last_runs(runs: DataFrame, most: int) -> DataFrame:
    """The latest `most` runs, latest first."""
    return runs.orderBy(F.desc("at"), F.desc("seq")).limit(most)


def grid(items: DataFrame, shift: str, am: int = 14, other: int = 8) -> DataFrame:
    """The items of the page's grid: most important, then largest, as many as the shift shows."""
    return items.orderBy(F.desc("importance"), F.desc("cluster_size"), "pos").limit(am if shift == "am" else other)


def by_importance(items: DataFrame) -> DataFrame:
    """Most important first, then latest collected."""
    return items.orderBy(F.desc("importance"), F.desc("collected_at"), "id")


def favourites(items: DataFrame, featured: DataFrame, vip_names: list[str], most: int = 6) -> DataFrame:
    """Relevant items of importance 2 from favoured sources (X accounts, listed names, video) that are not featured."""
    favoured = F.startswith("source_name", F.lit("X-")) | F.col("source_name").isin(vip_names) | (F.col("source_type") == "video")
    wanted = items.where(F.coalesce(favoured, F.lit(False)) & F.coalesce("ai_relevant", F.lit(True)) & (F.col("importance") >= 2))
    return wanted.join(featured.select("id").distinct(), "id", "left_anti").orderBy(F.desc("importance"), "id").limit(most)


def broadcast_list(items: DataFrame, top: int = 3, quick: int = 8) -> DataFrame:
    """The first items of a programme: `top` in full, the next `quick` in short."""
    first = items.where(F.coalesce("ai_relevant", F.lit(True))).orderBy(F.desc("importance"), "id").limit(top + quick)
    place = F.row_number().over(Window.orderBy(F.desc("importance"), "id"))  # eleven rows
    return first.withColumn("place", place).withColumn("part", F.when(F.col("place") <= top, "top").otherwise("quick"))


def mark_rendered(events: DataFrame, shown: DataFrame, at: Column, shift: str) -> DataFrame:
    """events with rendered_at and rendered_shift set for those shown; a shift other than am or pm is null."""
    known = shift.lower() if shift.lower() in ("am", "pm") else None
    mark = shown.select("event_id").distinct().withColumn("_shown", F.lit(True))
    j = events.join(mark, "event_id", "left")
    return j.withColumn("rendered_at", F.when(F.col("_shown"), at).otherwise(F.col("rendered_at"))).withColumn(
        "rendered_shift", F.when(F.col("_shown"), F.lit(known)).otherwise(F.col("rendered_shift"))
    ).drop("_shown")


def runs_with(runs: DataFrame, started: DataFrame, finished: DataFrame) -> DataFrame:
    """The log of runs after new starts and finishes: a start appends a running row, a finish completes its row."""
    every = runs.unionByName(
        started.select(
            "run_id", "started_at", F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.lit("running").alias("status"),
            F.lit(None).cast("bigint").alias("items")
        )
    )
    done = finished.select("run_id", F.col("finished_at").alias("_at"), F.col("status").alias("_status"), F.col("items").alias("_items"))
    j = every.join(done, "run_id", "left")
    return j.select(
        "run_id", "started_at", F.coalesce("_at", "finished_at").alias("finished_at"), F.coalesce("_status", "status").alias("status"),
        F.coalesce("_items", "items").alias("items")
    )


def run_summary(items: DataFrame, health: DataFrame, disabled: DataFrame, run_id: str, shift: str) -> DataFrame:
    """The summary row of a run: the page's indicators and the state of its sources."""
    kept = F.count("*")
    kpis = items.agg(
        kept.alias("kept"), F.count_if(F.col("level") >= 1).alias("llm_count"), F.coalesce(
            F.round(F.count_if(F.col("level") >= 1) / F.nullif(kept, F.lit(0)), 4), F.lit(0.0)
        ).alias("llm_coverage"),
        F.count_if(F.col("cluster_size") >= 2).alias("multi_source_count"), F.count_if(F.col("importance") >= 4).alias("important_count"), F.count_if(F.col("status") == "official").alias("official_count"),
        F.count_if((F.trim("detailed_content") != "") & (F.trim("background") != "")).alias("depth_count"))
    entities = items.select(F.explode("entities").alias("e")).where("e <> ''").agg(F.count_distinct("e").alias("entity_count"))
    out = kpis.crossJoin(F.broadcast(entities)).crossJoin(F.broadcast(run_health(health, disabled)))  # one row each
    return out.select(F.lit(run_id).alias("run_id"), F.lit(shift).alias("shift"), "*")


def append_summary(summary: DataFrame, path: str) -> None:
    """One more line in the log of runs."""
    summary.write.mode("append").json(path)


def deferred(pending: DataFrame, done: DataFrame) -> DataFrame:
    """Keys to persist: those of runs that finished well, once each."""
    return pending.join(done.where("status = 'ok'").select("run_id").distinct(), "run_id", "left_semi").dropDuplicates(["key"]).select("key")


def recurring_stories(items: DataFrame, rendered: DataFrame, decide: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Ids that repeat a rendered story line, as the injected model says of (id, title, lines); none without a model."""
    if decide is None:
        return items.select("id").limit(0)
    lines = rendered.orderBy(F.desc("rendered_at"), "title").limit(150).agg(F.array_sort(F.collect_list("title")).alias("lines"))
    return decide(items.select("id", "title").crossJoin(F.broadcast(lines)))  # 150 titles at most


def digest(
    items: DataFrame, draft: Callable[[DataFrame], DataFrame], patch: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """A digest in three stages with injected models: sections are drafted, the weakest one is written anew, facts are checked.

    draft gives (section, text, strength); patch rewrites such a row; check adds contradicted and
    confidence. Sections that are contradicted or of low confidence are not published.
    """
    drafted = draft(items)
    weakest = drafted.orderBy("strength", "section").limit(1)
    better = patch(weakest).select("section", F.col("text").alias("_text"))
    whole = drafted.join(F.broadcast(better), "section", "left").select("section", F.coalesce("_text", "text").alias("text"), "strength")
    checked = check(whole)
    return checked.where((F.col("contradicted") == 0) & (F.col("confidence") != "low"))


def repair_plan(sources: DataFrame, health: DataFrame, candidates: Column, dead: int = 10, give_up: int = 20) -> DataFrame:
    """(name, action, tries): dead sources get addresses to try, those dead for long are disabled.

    Only enabled sources are looked at: enabled is not false (a source without the mark is enabled).
    """
    j = sources.where(F.coalesce("enabled", F.lit(True))).join(health.select("name", "consecutive_failures"), "name", "left").where(
        F.coalesce("consecutive_failures", F.lit(0)) >= dead
    )
    action = F.when(F.col("consecutive_failures") >= give_up, "disable").otherwise("retry")
    return j.select("name", action.alias("action"), F.when(action == "retry", candidates).alias("tries"))


def event_type(articles: DataFrame) -> DataFrame:
    """(event_id, event_type): each source type has a vote, each known category two; the first to reach the most wins, else news."""
    c = F.lower(F.col("category"))
    named = F.when(
        c.rlike("发布|launch|release"), "product_launch"
    ).when(c.rlike("论文|paper|research"), "research").when(c.rlike("融资|fund"), "funding").when(c.rlike("监管|regulat|policy"), "regulation")
    by_type = articles.where("source_type <> ''").select(
        "event_id", F.col("source_type").alias("vote"), F.lit(1).alias("weight"), F.struct("pos", F.lit(-1).alias("i")).alias("at")
    )
    cats = articles.select("event_id", "pos", F.posexplode("categories").alias("i", "category")).select(
        "event_id", named.alias("vote"), F.lit(2).alias("weight"), F.struct("pos", "i").alias("at")
    ).where("vote is not null")
    votes = by_type.unionByName(cats).groupBy("event_id", "vote").agg(F.sum("weight").alias("n"), F.min("at").alias("at"))
    best = votes.groupBy("event_id").agg(F.min_by("vote", F.struct(-F.col("n"), "at")).alias("vote"))
    return articles.select("event_id").distinct().join(best, "event_id", "left").select(
        "event_id", F.coalesce("vote", F.lit("news")).alias("event_type")
    )


def initial_status(articles: DataFrame) -> DataFrame:
    """Status of a new event: official with an official source, confirmed by three sources with one of tier 1, else reported."""
    agg = articles.groupBy("event_id").agg(
        F.count_distinct(F.nullif("source_name", F.lit(""))).alias("sources"), F.min(F.coalesce("source_tier", F.lit(2))).alias("best")
    )
    return agg.select(
        "event_id",
        F.when(F.col("best") == 0, "official").when((F.col("sources") >= 3) & (F.col("best") <= 1), "confirmed").otherwise("reported").alias("status")
    )


def pick_best(members: DataFrame, authority: Column) -> DataFrame:
    """(cluster, id): of each cluster the report with most authority, a body and a long title; ties to the first."""
    merit = authority * 3 + F.when(F.length("full_text") > 0, 2).otherwise(0) + F.least(F.length("title"), F.lit(100)) / 100
    return members.groupBy("cluster").agg(F.max_by("id", F.struct(merit, -F.col("pos"))).alias("id"), F.count("*").alias("size"))
