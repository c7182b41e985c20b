"""Evidence, roles, status and clustering of canonical events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.keys import entity_action_key, signature_key
from newsloom.operators.graph import components
from newsloom.sources.tables import cut, free

#: fixed values: the status lattice and the order of evidence roles
STATUS = {"rumor": 0, "reported": 1, "confirmed": 2, "official": 3}
ROLE = {"official": 0, "first_reporter": 1, "confirmer": 2, "follower": 3}


def roles(evidence: DataFrame, order: list) -> DataFrame:
    """Adds role: tier 0 is official, an event's first report first_reporter, a new source confirmer, else follower."""
    nth = F.row_number().over(Window.partitionBy("event_id").orderBy(*order))
    of_source = F.row_number().over(Window.partitionBy("event_id", "source_name").orderBy(*order))
    role = F.when(F.col("source_tier") == 0, "official").when(F.col("_n") == 1, "first_reporter").when(F.col("_s") == 1, "confirmer").otherwise("follower")
    return evidence.withColumn("_n", nth).withColumn("_s", of_source).withColumn("role", role).drop("_n", "_s")


def role_rank(role) -> object:
    out = F.lit(9)
    for name, rank in ROLE.items():
        out = F.when(role == name, rank).otherwise(out)
    return out


def evidence_chain(evidence: DataFrame) -> DataFrame:
    """One row per event with its evidence as an array in role and time order."""
    entry = F.struct(role_rank(F.col("role")).alias("rank"), "reported_at", "article_id", "role", "source_name")
    return evidence.groupBy("event_id").agg(F.array_sort(F.collect_list(entry)).alias("chain"))


def canonical(evidence: DataFrame) -> DataFrame:
    """The article that stands for each event: low tier, analysed, with a body, important, long title; ties to the first."""
    merit = F.struct(
        -10 * F.col("source_tier"), 5 * F.col("has_analysis").cast("int"), 3 * F.col("has_body").cast("int"), 2 * F.col("importance"),
        F.col("title_len"), -F.col("pos")
    )
    return evidence.groupBy("event_id").agg(F.max_by("article_id", merit).alias("canonical_article_id"))


def status(evidence: DataFrame) -> DataFrame:
    """Target status by distinct named sources, tiers and roles: official by tier or role, confirmed by three sources with
    one of tier 1 or less, reported by two; a single source changes nothing, so its event has no row."""
    agg = evidence.groupBy("event_id").agg(
        F.count_distinct(F.nullif("source_name", F.lit(""))).alias("sources"), F.bool_or(
            (F.col("source_tier") == 0) | (F.col("role") == "official")
        ).alias("official"), F.bool_or(F.col("source_tier") <= 1).alias("any1"))
    level = F.when(F.col("official"), 3).when((F.col("sources") >= 3) & F.col("any1"), 2).when(F.col("sources") >= 2, 1)
    return agg.select("event_id", "sources", level.alias("level")).where("level is not null")


def upgraded(old: DataFrame, new: DataFrame) -> DataFrame:
    """Status levels only rise."""
    n = new.select("event_id", F.col("level").alias("new_level"))
    return old.join(n, "event_id", "full").select("event_id", F.greatest("level", "new_level").alias("level"))


def multi_source(evidence: DataFrame, least: int = 2) -> DataFrame:
    return evidence.groupBy("event_id").agg(
        F.count_distinct("source_name").alias("sources"), F.count("*").alias("reports")
    ).where(F.col("sources") >= least)


def cluster_histogram(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("event_id").agg(F.count("*").alias("cluster_size")).groupBy("cluster_size").agg(F.count("*").alias("events"))


def exclusive_firsts(with_roles: DataFrame) -> DataFrame:
    """Events that a source of tier 1 or less reported first, per source."""
    first = with_roles.where((F.col("role") == "first_reporter") & (F.col("source_tier") <= 1))
    return first.groupBy("source_name").agg(F.count_distinct("event_id").alias("firsts"))


def same_event_merge(items: DataFrame) -> DataFrame:
    """Of each group the item with the largest importance, then cluster size, then the earliest; ungrouped items stay."""
    merit = F.struct("importance", "cluster_size", -F.col("pos"))
    group = F.coalesce(F.col("group_id").cast("string"), F.concat(F.lit("single-"), F.col("pos")))
    return items.groupBy(group.alias("g")).agg(F.max_by("item_id", merit).alias("item_id"), F.count("*").alias("merged")).drop("g")


def _keyed(rows: DataFrame, name: str) -> DataFrame:
    """(name, rank, k): the signature key (0) and the entity-action key (1) of each row that has them."""
    keys = F.array(
        F.struct(F.lit(0).alias("rank"), signature_key(F.col("signature")).alias("k")),
        F.struct(F.lit(1).alias("rank"), entity_action_key(F.col("signature")).alias("k"))
    )
    return rows.select(name, F.explode(keys).alias("x")).select(name, "x.rank", "x.k").where("k is not null and k <> ''")


def cluster(articles: DataFrame, similar: DataFrame) -> DataFrame:
    """(id, event) by equal signature keys, equal entity-action keys and similar pairs (earlier, later).

    Members of a key point at its first member, a star per key, so keys of any size stay linear.
    """
    keyed = _keyed(articles, "id")
    first = keyed.groupBy("rank", "k").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = keyed.join(first, ["rank", "k"]).where("id <> a").select("a", F.col("id").alias("b"))
    roots = components(stars.union(similar.select("earlier", "later")))
    return articles.join(roots, articles["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("event"))


def continued(articles: DataFrame, existing: DataFrame, best: DataFrame) -> DataFrame:
    """(id, event_id, group_id) of articles that continue events of earlier runs or form new groups.

    best (later, earlier, event_id): the most similar earlier article of each article, or with earlier null
    the event that is more similar still. An article takes the event of its best match; where that is an
    article without an event, its own keys' event (see known_events). The value is handed along the chain
    of best matches by pointer doubling, the far end's coming first. Articles without an event
    form groups by equal keys and by best matches that have no event either; group_id is a group's first
    such article, null for articles with an event.
    """
    own = known_events(articles, existing).select("id", F.col("event_id").alias("own"))
    start = articles.select("id").join(own, "id", "left").join(best.withColumnRenamed("later", "id"), "id", "left")
    now = cut(start.select("id", F.col("earlier").alias("to"), F.coalesce("event_id", "own").alias("event_id")), "chains")
    while now.where("to is not null").limit(1).count():
        there = now.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("event_id").alias("_event"))
        after = cut(now.join(there, "to", "left").select("id", F.col("_to").alias("to"), F.coalesce("_event", "event_id").alias("event_id")), "chains")
        free(now)
        now = after
    found = now.select("id", "event_id")
    free_ones = found.where("event_id is null").select(F.col("id").alias("earlier"))
    linked = best.where("earlier is not null").join(free_ones, "earlier", "left_semi").select("earlier", "later")
    grouped = cluster(articles, linked).join(found, "id")
    first = grouped.where("event_id is null").groupBy("event").agg(F.min("id").alias("group_id"))
    return grouped.join(first, "event", "left").select("id", "event_id", F.when(F.col("event_id").isNull(), F.col("group_id")).alias("group_id"))


def known_events(articles: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, event_id): articles whose key an existing event (event_id, seq, signature) has; signature keys come first, then the first event."""
    owner = _keyed(existing.select(F.struct("seq", "event_id").alias("e"), "signature"), "e").groupBy("rank", "k").agg(F.min("e").alias("e"))
    hits = _keyed(articles, "id").join(owner, ["rank", "k"])
    return hits.groupBy("id").agg(F.min_by("e", "rank").alias("e")).select("id", "e.event_id")


def rolled_up(reports: DataFrame) -> DataFrame:
    """(event_id, size, importance, entities): of each event the reports, the largest importance, the union of entities in order."""
    totals = reports.groupBy("event_id").agg(F.count("*").alias("size"), F.max("importance").alias("importance"))
    tags = reports.select("event_id", F.explode("entities").alias("e")).distinct().groupBy("event_id").agg(
        F.array_sort(F.collect_list("e")).alias("entities")
    )
    return totals.join(tags, "event_id", "left")
