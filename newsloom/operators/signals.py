"""Outside popularity signals and causal chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.scores import causal_confidence, signal_boost
from newsloom.functions.text import bound, keywords
from newsloom.operators.entities import small
from newsloom.sources.tables import cut


#: fixed values: words that name a product or maker
BRANDS = (
    "openai", "anthropic", "claude", "gpt", "chatgpt", "codex", "gemini", "llama", "mistral", "deepseek", "qwen", "nvidia", "sora", "dalle",
    "gemma", "whisper", "midjourney", "huggingface", "cursor", "perplexity", "cerebras", "tomoro", "bytedance", "kimi", "doubao", "grok",
    "xai", "meta", "apple", "google", "microsoft", "amazon", "cohere", "agent", "vllm", "transformer", "diffusion", "rag", "mcp",
    "fine-tune", "fine-tuning"
)
#: fixed values: rules in their order, and what each is worth
RULES = {"url_exact": 1.0, "url_evidence": 0.95, "title_keywords": 0.7, "title_brand": 0.6, "entity_match": 0.5, "entity_in_title": 0.5}


def _runs(text: Column, most: int = 3) -> Column:
    """Distinct runs of one to `most` characters."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(at, lambda k: F.transform(F.array(*map(F.lit, range(1, most + 1))), lambda n: F.substring(text, k, n)))))


def match(events: DataFrame, signals: DataFrame, words: int = 3, brands: Sequence[str] = BRANDS) -> DataFrame:
    """The best signal per event and source: event_id, source, signal_id, score, rule, confidence.

    events: event_id, url_key, evidence_keys, title, summary, entity_tags; signals: signal_id, source,
    url_key, title, score. The first rule that holds decides a pair; the best has the largest
    confidence * (score + 100), ties to the smaller signal id. All rules are equi-joins: on address
    keys, on inverted lists of words (a signal's side is broadcast if it is small), and on tags, after
    the distinct tags have been looked up in the signals' titles by their first characters. An empty tag
    is in no title.
    """
    # texts are read once: the rules below run on keys, words and tags
    named_words = bound(keywords(F.col("title")), lambda w: F.when(F.size(w) > 0, w).otherwise(keywords(F.col("summary"))))
    events = cut(events.select("event_id", "url_key", "evidence_keys", "entity_tags", named_words.alias("w")), "events")
    signals = cut(signals.select("signal_id", "source", "url_key", "title", "score"), "signals")
    given = events.select("event_id", "w")
    of_signal = signals.select("signal_id", keywords(F.col("title")).alias("w"))
    keyed = signals.where("url_key <> ''").select("signal_id", "url_key")

    def pairs(df: DataFrame, rule: str) -> DataFrame:
        return df.select("event_id", "signal_id", F.lit(list(RULES).index(rule)).alias("place"))

    exact = pairs(events.select("event_id", "url_key").join(keyed, "url_key"), "url_exact")
    named = pairs(events.select("event_id", F.explode("evidence_keys").alias("url_key")).join(keyed, "url_key"), "url_evidence")
    word = of_signal.select("signal_id", F.explode("w").alias("t"))
    met = given.select("event_id", F.explode("w").alias("t")).join(small(word), "t").groupBy("event_id", "signal_id").agg(
        F.count("*").alias("n"), F.bool_or(F.col("t").isin(list(brands))).alias("brand")
    )
    shared = met.where((F.col("n") >= words) | ((F.col("n") >= 2) & F.col("brand"))).select(
        "event_id", "signal_id", F.when(F.col("n") >= words, 2).otherwise(3).alias("place")
    )
    tags = events.select("event_id", F.explode(F.array_distinct(F.transform("entity_tags", F.lower))).alias("t"))
    tagged = pairs(tags.join(small(word), "t"), "entity_match")
    # a tag in a title begins with one of the title's runs of up to three characters; titles are looked up by those
    known = tags.where("t <> ''").select("t").distinct().withColumn("_g", F.substring("t", 1, 3)).join(
        signals.select("signal_id", F.lower("title").alias("low")).withColumn("_g", F.explode(_runs(F.col("low")))), "_g"
    ).where(F.contains("low", "t")).select("t", "signal_id")
    within = pairs(tags.join(small(known), "t"), "entity_in_title")
    first = exact.unionByName(named).unionByName(shared).unionByName(tagged).unionByName(within).groupBy("event_id", "signal_id").agg(F.min("place").alias("place"))
    name, worth = (F.element_at(F.lit(list(x)), F.col("place") + 1) for x in (RULES, RULES.values()))
    scored = first.join(small(signals.select("signal_id", "source", "score")), "signal_id").select(
        "event_id", "source", "signal_id", "score", name.alias("rule"), worth.alias("confidence")
    )
    best = F.max_by(F.struct("signal_id", "score", "rule", "confidence"), F.struct(F.col("confidence") * (F.col("score") + 100), -F.col("signal_id")))
    return scored.groupBy("event_id", "source").agg(best.alias("x")).select("event_id", "source", "x.*")


def match_stats(matches: DataFrame) -> DataFrame:
    """Per source: matched events, and mean confidence."""
    return matches.groupBy("source").agg(F.count("*").alias("matches"), F.round(F.avg("confidence"), 6).alias("confidence"))


def boosted(events: DataFrame, matches: DataFrame) -> DataFrame:
    """(event_id, importance, effective_importance) of matched events: raised to what their signals' numbers say, never lowered.

    matches has the matched number of each source in `score`: points, likes or stars.
    """
    wide = matches.groupBy("event_id").agg(
        *(F.max(F.when(F.col("source") == s, F.col("score"))).alias(s) for s in ("hn", "hf", "github")),
        F.bool_or(F.col("source") == "reddit").alias("reddit")
    )
    level = signal_boost(F.col("hn"), F.col("reddit"), F.col("hf"), F.col("github"))
    return events.select("event_id", "importance").join(wide, "event_id").select(
        "event_id", "importance", F.greatest("importance", level).alias("effective_importance")
    )


def breaking(
    signals: DataFrame, pushed: DataFrame, noise: str, event: str, least: dict[str, int], most: int = 5, stricter: dict[str, str] | None = None
) -> DataFrame:
    """Signals that are no noise, name an event, reach their source's threshold and were not pushed: the first `most`.

    Sources without a number have a stricter pattern instead of a threshold.
    """
    named = F.col("title").rlike(event)
    for source, pattern in (stricter or {}).items():
        named = F.when(F.col("source") == source, F.col("title").rlike(pattern)).otherwise(named)
        least = least | {source: 0}
    bar = F.lit(None).cast("int")
    for source, points in least.items():
        bar = F.when(F.col("source") == source, points).otherwise(bar)
    hot = signals.where(~F.col("title").rlike(noise) & named & (F.coalesce("points", F.lit(0)) >= bar))
    return hot.join(pushed.select("sig_id").distinct(), "sig_id", "left_anti").orderBy(F.desc("points"), "sig_id").limit(most)


def accumulated(pushed: DataFrame, found: DataFrame, at: Column) -> DataFrame:
    """(sig_id, pushed_at): what was pushed and what is pushed now; a signal keeps its first time."""
    both = pushed.select("sig_id", "pushed_at").unionByName(found.select("sig_id", at.alias("pushed_at")))
    return both.groupBy("sig_id").agg(F.min("pushed_at").alias("pushed_at"))


def in_window(pushed: DataFrame, as_of: Column, hours: int = 24, most: int = 5) -> DataFrame:
    """The latest of what was pushed within the hours, for display."""
    return pushed.where(F.col("pushed_at") >= as_of - F.expr(f"interval {hours} hours")).orderBy(F.desc("pushed_at"), "sig_id").limit(most)


def causal(articles: DataFrame, triggers: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, chain_id, assets, confidence): chains that an article's events trigger, with the assets both name."""
    hit = articles.select(
        "id", "level", F.col("assets").alias("named"), F.explode("events").alias("event")
    ).join(triggers, "event").select("id", "level", "named", "chain_id", "hit_rate").dropDuplicates(["id", "chain_id"])
    reached = edges.groupBy("chain_id").agg(F.collect_set("to").alias("reached"))
    out = hit.join(reached, "chain_id").withColumn("assets", F.size(F.array_intersect("named", "reached")))
    return out.select(
        "id", "chain_id", F.col("assets").cast("bigint"), causal_confidence(F.col("hit_rate"), F.col("assets"), F.col("level")).alias("confidence")
    )


def chain_order(matches: DataFrame, most: int | None = None) -> DataFrame:
    """Each article's chains by confidence, ties by their place in the knowledge base; the first `most` of them if given."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("confidence"), "chain_id"))
    out = matches.withColumn("place", place)
    return out if most is None else out.where(F.col("place") <= most)


def arrow(direction: Column) -> Column:
    return F.when(direction == "up", "↑").when(direction == "down", "↓").when(direction.isin("variable", "inverse"), "↕").otherwise("?")


def impacts(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(chain_id, impacts): a chain's edges in order, with the label of each asset, or its name where it has none."""
    named = edges.join(small(labels), edges["to"] == labels["asset"], "left").select(
        "chain_id", F.struct("pos", F.col("to").alias("asset"), F.coalesce("label", "to").alias("label"), "direction").alias("x")
    )
    return named.groupBy("chain_id").agg(F.array_sort(F.collect_list("x")).alias("impacts"))


def impact_summary(matches: DataFrame, chains: DataFrame, chain_impacts: DataFrame, most: int = 2, listed: int = 6) -> DataFrame:
    """(id, summary): an article's first chains, each with its hit rate, up to six impacts and how sure it is."""
    j = chain_order(matches, most).join(small(chains), "chain_id").join(small(chain_impacts), "chain_id", "left")
    parts = F.array_join(
        F.transform(F.slice(F.coalesce("impacts", F.array()), 1, listed), lambda x: F.concat(x["label"], arrow(x["direction"]))), ", "
    )
    sure = F.when(F.col("confidence") >= 0.7, "高").when(F.col("confidence") >= 0.5, "中").otherwise("低")
    head = F.concat(F.lit("["), "name", F.lit("] (历史命中率"), F.format_string("%.0f", F.bround(F.col("hit_rate") * 100)), F.lit("%)"))
    finding = F.when(F.length("finding") > 0, F.concat(F.lit("\n  参考: "), F.substring("finding", 1, 60), F.lit("..."))).otherwise("")
    line = F.concat(head, F.lit("\n  影响: "), parts, F.lit(" | 综合置信度: "), sure, finding)
    return j.select("id", F.struct("place", line.alias("line")).alias("x")).groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("summary")
    )


def impact_list(matches: DataFrame, chain_impacts: DataFrame, most: int = 3) -> DataFrame:
    """One row per impact of an article's first chains, for display: id, chain_id, confidence, asset, asset_label, direction."""
    j = chain_order(matches, most).join(small(chain_impacts), "chain_id")
    return j.select("id", "chain_id", "confidence", F.explode("impacts").alias("x")).select(
        "id", "chain_id", "confidence", "x.asset", F.col("x.label").alias("asset_label"), "x.direction"
    )
