"""Scores of news items as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values of the relevance score
TIER_FIRST_HAND = {0: 1.0, 1: 0.7, 2: 0.3}
TYPE_FIRST_HAND = {"official": 0.3, "paper": 0.3, "video": 0.1, "opinion": 0.0, "news": -0.1, "community": -0.1}
WEIGHTS = {"first_hand": 1.8, "freshness": 1.5, "novelty": 0.8, "confirmation": 0.5, "importance": 0.8}
CATEGORY_AUTHORITY = {"official": 4, "paper": 4, "research": 4, "researcher": 4, "media": 3, "industry": 2, "community": 2, "video": 2, "tech": 2}


def lookup(key: Column, table: dict, default) -> Column:
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(known, key), F.lit(default))


def freshness(hours: Column) -> Column:
    """1 up to 12 hours, linear to 0.6 at 24, then exponential decay to a floor; 0.3 if unknown."""
    late = F.greatest(F.lit(0.05), 0.6 * F.exp(-0.03 * (hours - 24)))
    return F.when(hours.isNull(), 0.3).when(hours <= 12, 1.0).when(hours <= 24, 1.0 - 0.4 * (hours - 12) / 12).otherwise(late)


def first_hand(tier: Column, source_type: Column) -> Column:
    raw = lookup(tier, TIER_FIRST_HAND, 0.3) + lookup(source_type, TYPE_FIRST_HAND, 0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.3), raw))


def confirmation(reports: Column) -> Column:
    return F.when(reports >= 4, 1.0).when(reports == 3, 0.7).when(reports == 2, 0.4).otherwise(0.0)


def relevance(tier: Column, source_type: Column, hours: Column, reports: Column, importance: Column, novel: Column, follow_up: Column) -> Column:
    fresh = freshness(hours)
    novelty = F.when(follow_up, 0.0).when(novel, 1.0).otherwise(0.5)
    boost = F.when((tier == 0) & (fresh >= 0.95), 0.5).otherwise(0.0)
    penalty = F.when(follow_up, -2.0).otherwise(0.0)
    w = WEIGHTS
    return w["first_hand"] * first_hand(tier, source_type) + w["freshness"] * fresh + w["novelty"] * novelty + w["confirmation"] * confirmation(reports) + w["importance"] * (importance - 1) / 4 + boost + penalty


def authority(name: Column, category: Column, configured: dict[str, int]) -> Column:
    base = lookup(category, CATEGORY_AUTHORITY, 2)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in configured.items() for x in kv]), name), base) if configured else base


def signal_boost(hn: Column, reddit: Column, hf: Column, github: Column) -> Column:
    """Largest level over the sources (points, presence, likes, stars), one more for two sources, 5 at most."""
    level_hn = F.when(hn >= 1000, 5).when(hn >= 500, 4).when(hn >= 200, 3).otherwise(0)
    level_reddit = F.when(reddit, 3).otherwise(0)
    level_hf = F.when(hf >= 2000, 4).when(hf >= 500, 3).otherwise(0)
    level_github = F.when(github >= 50000, 4).when(github >= 5000, 3).otherwise(0)
    seen = sum(F.coalesce(c, F.lit(False)).cast("int") for c in (hn.isNotNull(), reddit, hf.isNotNull(), github.isNotNull()))
    top = F.greatest(level_hn, level_reddit, level_hf, level_github)
    return F.least(F.lit(5), top + F.when((seen >= 2) & (top > 0), 1).otherwise(0))


def causal_confidence(hit_rate: Column, assets: Column, level: Column) -> Column:
    stated = lookup(level, {"high": 0.25, "medium": 0.15, "low": 0.05}, 0.10)
    return F.least(F.lit(1.0), F.bround(0.5 * hit_rate + F.least(0.1 * assets, F.lit(0.25)) + stated, 3))


def rule_importance(tier: Column, strong: Column, entity_boost: Column, event_verb: Column) -> Column:
    """1 to 5: tier base, strong keywords, best entity and an event verb, rounded half to even."""
    base = F.when(tier == 0, 3.0).when(tier == 1, 2.0).otherwise(1.0)
    raw = base + F.least(0.5 * strong, F.lit(1.5)) + 0.5 * entity_boost + F.when(event_verb, 0.8).otherwise(0.0)
    return F.greatest(F.lit(1), F.least(F.lit(5), F.bround(raw).cast("int")))
