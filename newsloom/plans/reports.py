"""Queries of the briefing step and of the side reports: events, evidence, ranking, health, state, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import keys, scores, text
from newsloom.operators import cosine, entities, events, filters, health, ranking, signals, store
from newsloom.plans import similarity
from newsloom.plans.registry import query
from newsloom.plans.views import ARTICLES, AS_OF, ENTITIES, EVIDENCE, HEALTH, TAGGED, articles, evidence, source_runs
from newsloom.sources.tables import cut, spread, table

NOW = f"TIMESTAMP '{AS_OF}'"


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("A02, T09, F11", f"""WITH {ARTICLES}
SELECT source_name, count(*) AS total, count(*) FILTER (collected_at >= {NOW} - INTERVAL 12 HOUR) AS recent,
       count(*) FILTER (collected_at >= {NOW} - INTERVAL 12 HOUR AND importance >= 3) AS recent_high,
       round(avg(CASE WHEN ai_relevant THEN importance END), 2) AS mean_importance, max(collected_at) AS last_at
FROM a GROUP BY source_name""")
def source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: volume, recent volume, recent important items, mean importance of relevant items, last item."""
    recent = F.col("collected_at") >= now() - F.expr("interval 12 hours")
    out = articles(spark, sf_dir).groupBy("source_name").agg(
        F.count("*").alias("total"), F.count_if(recent).alias("recent"), F.count_if(recent & (F.col("importance") >= 3)).alias("recent_high"),
        F.round(
            F.avg(F.when(F.col("ai_relevant"), F.col("importance"))), 2
        ).alias("mean_importance"), F.max("collected_at").alias("last_at"))
    return out.orderBy(F.desc("recent"), F.desc("recent_high"), F.desc("total"), "source_name")


@query("A01, A05, A14",
 f"""WITH {ARTICLES} SELECT tier, count(*) AS n, count(*) FILTER (importance >= 4) AS important, count(*) FILTER (ai_relevant) AS relevant, count(DISTINCT source_name) AS sources FROM a GROUP BY tier""")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).groupBy("tier").agg(
        F.count("*").alias("n"), F.count_if(F.col("importance") >= 4).alias("important"), F.count_if("ai_relevant").alias("relevant"),
        F.count_distinct("source_name").alias("sources")
    )


@query("A01", f"""WITH {ARTICLES} SELECT lang, tier, count(*) AS n, round(avg(importance), 6) AS mean_importance FROM a GROUP BY lang, tier""")
def language_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).groupBy("lang", "tier").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("mean_importance"))


_ROLES = f"""{EVIDENCE}, r AS (SELECT *, CASE WHEN source_tier = 0 THEN 'official' WHEN pos = 1 THEN 'first_reporter'
  WHEN row_number() OVER (PARTITION BY event_id, source_name ORDER BY pos) = 1 THEN 'confirmer' ELSE 'follower' END AS role FROM e)"""


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.roles(evidence(spark, sf_dir), [F.col("pos")])


@query("P34, W04", f"WITH {_ROLES} SELECT event_id, pos, role FROM r")
def event_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roles(spark, sf_dir).select("event_id", "pos", "role")


@query("J03, W05", f"""WITH {_ROLES}, k AS (SELECT *, CASE role WHEN 'official' THEN 0 WHEN 'first_reporter' THEN 1
 WHEN 'confirmer' THEN 2 ELSE 3 END AS rank FROM r)
SELECT event_id, count(*) AS n, string_agg(role || ':' || article_id, ',' ORDER BY rank, reported_at, article_id, role, source_name)
 AS chain FROM k GROUP BY event_id""")
def evidence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = events.evidence_chain(_roles(spark, sf_dir))
    return chain.select(
        "event_id", F.size("chain").cast("bigint").alias("n"),
        F.array_join(F.transform("chain", lambda c: F.concat_ws(":", c["role"], c["article_id"])), ",").alias("chain")
    )


@query("A23", f"""WITH {EVIDENCE}, k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY -10 * source_tier DESC,
 has_analysis DESC, has_body DESC, importance DESC, title_len DESC, pos) AS n FROM e)
SELECT event_id, article_id AS canonical_article_id FROM k WHERE n = 1""")
def canonical_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.canonical(evidence(spark, sf_dir))


@query("A22, K06", f"""WITH {_ROLES}, g AS (SELECT event_id, count(DISTINCT source_name) AS sources, bool_or(source_tier = 0
 OR role = 'official') AS official, bool_or(source_tier <= 1) AS any1 FROM r GROUP BY event_id),
l AS (SELECT event_id, CASE WHEN official THEN 3 WHEN sources >= 3 AND any1 THEN 2 WHEN sources >= 2 THEN 1 END AS level FROM g),
o AS (SELECT o_orderkey AS event_id, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS level FROM orders)
SELECT event_id, greatest(o.level, l.level)::INT AS level FROM o FULL JOIN (SELECT * FROM l WHERE level IS NOT NULL) l USING (event_id)""")
def status_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("level")
    )
    return events.upgraded(old, events.status(_roles(spark, sf_dir)))


@query(
    "A03",
    f"WITH {EVIDENCE} SELECT event_id, count(DISTINCT source_name) AS sources, count(*) AS reports FROM e GROUP BY event_id HAVING count(DISTINCT source_name) >= 2"
)
def multi_source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.multi_source(evidence(spark, sf_dir))


@query(
    "A06",
    f"WITH {EVIDENCE}, g AS (SELECT event_id, count(*) AS cluster_size FROM e GROUP BY 1) SELECT cluster_size, count(*) AS events FROM g GROUP BY 1"
)
def cluster_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.cluster_histogram(evidence(spark, sf_dir))


@query(
    "A04",
    f"WITH {_ROLES} SELECT source_name, count(DISTINCT event_id) AS firsts FROM r WHERE role = 'first_reporter' AND source_tier <= 1 GROUP BY 1"
)
def exclusive_firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.exclusive_firsts(_roles(spark, sf_dir))


@query("J01, J02, J04", f"""WITH {EVIDENCE}, f AS (SELECT event_id, min_by(source_name, pos) AS first_source, min(reported_at) AS first_at
 FROM e GROUP BY 1)
SELECT o_orderkey AS event_id, o_orderpriority AS priority, first_source, date_diff('day', o_orderdate, first_at)::INT AS lag_days
 FROM orders LEFT JOIN f ON o_orderkey = event_id""")
def event_first_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = evidence(spark, sf_dir).groupBy("event_id").agg(
        F.min_by("source_name", "pos").alias("first_source"), F.min("reported_at").alias("first_at")
    )
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("priority"), "o_orderdate")
    return o.join(first, "event_id", "left").select("event_id", "priority", "first_source", F.datediff("first_at", "o_orderdate").alias("lag_days"))


@query("P29, P31", f"""WITH {EVIDENCE}, g AS (SELECT event_id, count(DISTINCT source_name) AS s, min(source_tier) AS t FROM e GROUP BY 1)
SELECT event_id, CASE WHEN s >= 3 THEN 'strong' WHEN s = 2 OR t = 0 THEN 'ok' ELSE 'weak' END AS badge FROM g""")
def trust_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = evidence(spark, sf_dir).groupBy("event_id").agg(F.count_distinct("source_name").alias("s"), F.min("source_tier").alias("t"))
    return g.select("event_id", F.when(F.col("s") >= 3, "strong").when((F.col("s") == 2) | (F.col("t") == 0), "ok").otherwise("weak").alias("badge"))


_SCORE = f"""{ARTICLES}, f AS (SELECT *, epoch({NOW} - collected_at) / 3600.0 AS h, CASE WHEN tier = 0 THEN 'official'
 WHEN importance = 1 THEN 'opinion' ELSE 'news' END AS kind, (id % 5)::INT AS reports FROM a),
x AS (SELECT *, CASE WHEN h IS NULL THEN 0.3 WHEN h <= 12 THEN 1.0 WHEN h <= 24 THEN 1.0 - 0.4 * (h - 12) / 12 ELSE greatest(0.05,
 0.6 * exp(-0.03 * (h - 24))) END AS fresh,
  greatest(0.0, least(1.3, CASE tier WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.3 END + CASE kind WHEN 'official' THEN 0.3
 WHEN 'news' THEN -0.1 ELSE 0.0 END)) AS first FROM f)"""


@query("P39, P40, T04, C05", f"""WITH {_SCORE}
SELECT id, round(fresh, 6)::DOUBLE AS fresh, round((1.8 * first + 1.5 * fresh + 0.8 * CASE WHEN lang = 'en' THEN 1.0 ELSE 0.5 END + 0.5 *
 CASE WHEN reports >= 4 THEN 1.0 WHEN reports = 3 THEN 0.7 WHEN reports = 2 THEN 0.4 ELSE 0.0 END
  + 0.8 * (importance - 1) / 4.0 + CASE WHEN tier = 0 AND fresh >= 0.95 THEN 0.5 ELSE 0.0 END)::DOUBLE, 6) AS score FROM x""")
def relevance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir)
    hours = (F.unix_micros(now().cast("timestamp")) - F.unix_micros(F.col("collected_at").cast("timestamp"))) / 3.6e9
    kind = F.when(F.col("tier") == 0, "official").when(F.col("importance") == 1, "opinion").otherwise("news")
    score = scores.relevance(F.col("tier"), kind, hours, F.col("id") % 5, F.col("importance"), F.col("lang") == "en", F.lit(False))
    return ranking.ranked(a, F.round(score, 6), "id").select("id", F.round(scores.freshness(hours), 6).alias("fresh"), "score")


_FEATURED = f"""{ARTICLES}, f AS (SELECT id, importance, (id % 5)::INT AS reports, collected_at >= {NOW} - INTERVAL 12 HOUR AS today FROM a)"""


def _display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select(
        "id", "importance", (F.col("id") % 5).cast("int").alias("reports"),
        (F.col("collected_at") >= now() - F.expr("interval 12 hours")).alias("today")
    )


@query("T05, T06", f"""WITH {_FEATURED} SELECT id, round(importance + CASE WHEN reports >= 4 THEN 1.0 WHEN reports = 3 THEN 0.8
 WHEN reports = 2 THEN 0.5 ELSE 0.0 END + CASE WHEN today THEN 0.7 ELSE 0.0 END, 3)::DOUBLE AS key
FROM f WHERE importance >= 3 ORDER BY key DESC, id LIMIT 10""")
def featured_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.featured(_display(spark, sf_dir)).select("id", F.round("key", 3).alias("key"))


@query("T07", f"""WITH {_FEATURED}, p AS (SELECT *, CASE WHEN importance = 5 AND reports >= 2 THEN 1 WHEN importance >= 4
 AND reports >= 2 THEN 2 ELSE 3 END AS phase FROM f)
SELECT id, phase FROM p ORDER BY phase, importance DESC, id LIMIT 3""")
def top_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_three(_display(spark, sf_dir)).select("id", "phase")


@query("C09", f"""WITH {ARTICLES}, r AS (SELECT source_name, id, row_number() OVER (PARTITION BY source_name ORDER BY importance DESC,
 len(title) DESC, id) AS n, count(*) OVER (PARTITION BY source_name) AS merged FROM a)
SELECT id AS item_id, merged FROM r WHERE n = 1""")
def same_event_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir).select(
        F.col("id").alias("item_id"), F.col("id").alias("pos"), "importance", F.length("title").alias("cluster_size"),
        F.col("source_name").alias("group_id")
    )
    return events.same_event_merge(a)


@query("C10, F19", f"""WITH {ARTICLES}, o AS (SELECT DISTINCT title FROM a WHERE collected_at < TIMESTAMP '2024-01-01 02:00:00'),
 m AS (SELECT id, o.title IS NOT NULL AS old FROM a LEFT JOIN o ON a.title = o.title),
s AS (SELECT count(*) FILTER (old) * 2 > count(*) AS many FROM m) SELECT id FROM m, s WHERE many OR NOT old""")
def storyline_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir)
    return ranking.storyline_guard(a, a.where(F.col("collected_at") < F.lit("2024-01-01 02:00:00").cast("timestamp_ntz")), "title").select("id")


_SHIFT = "date_trunc('day', ts - INTERVAL 6 HOUR) AS day, CASE WHEN hour(ts - INTERVAL 6 HOUR) < 12 THEN 'am' ELSE 'pm' END AS shift"


@query(
    "R02, P49",
    f"SELECT day::TIMESTAMP AS day, shift, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, {_SHIFT} FROM events) GROUP BY ALL"
)
def shift_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts") - F.expr("interval 6 hours")
    e = table(spark, sf_dir, "events").withColumn(
        "day", F.date_trunc("day", at.cast("timestamp")).cast("timestamp_ntz")
    ).withColumn("shift", F.when(F.hour(at) < 12, "am").otherwise("pm"))
    return e.groupBy("day", "shift", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("R03, F09, F11, T02", """SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR) AS h24, count(*)
 FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 72 HOUR) AS h72, count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 168 HOUR) AS h168
FROM events WHERE ts < TIMESTAMP '2024-01-30' GROUP BY 1""")
def sliding_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    e = filters.shift_window(table(spark, sf_dir, "events").withColumnRenamed("ts", "published"), F.lit("0001-01-01").cast("timestamp_ntz"), end)
    since = lambda h: F.count_if(F.col("published") >= end - F.expr(f"interval {h} hours"))
    return e.groupBy("event_type").agg(since(24).alias("h24"), since(72).alias("h72"), since(168).alias("h168"))


@query("R04, F10, K11", """WITH i AS (SELECT user_id, min(ts) AS rendered_at, max(ts) AS last_updated_at, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, n FROM i WHERE NOT coalesce(rendered_at >= TIMESTAMP '2024-01-01 12:00:00'
 AND NOT coalesce(last_updated_at > rendered_at + INTERVAL 29 DAY, FALSE), FALSE)""")
def late_reactivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("rendered_at"), F.max("ts").alias("last"), F.count("*").alias("n"))
    i = i.withColumn("last_updated_at", F.col("last") - F.expr("interval 29 days"))
    return filters.not_rendered(i, F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).select("user_id", "n")


@query("W06, R07", f"""WITH RECURSIVE {HEALTH}, o AS (SELECT name, ok, round(took * 100)::BIGINT AS c, row_number() OVER (PARTITION BY name
 ORDER BY "at", seq) AS n FROM h),
f AS (SELECT name, 0::BIGINT AS n, 0::BIGINT AS avg, 0 AS failures FROM (SELECT DISTINCT name FROM h)
  UNION ALL SELECT o.name, o.n, CASE WHEN NOT ok OR c <= 0 THEN avg WHEN avg > 0 THEN (7 * avg + 3 * c) // 10 + CASE WHEN (7 * avg + 3 * c)
 % 10 > 5 OR ((7 * avg + 3 * c) % 10 = 5 AND (7 * avg + 3 * c) // 10 % 2 = 1) THEN 1 ELSE 0 END ELSE c END,
    CASE WHEN ok THEN 0 ELSE failures + 1 END FROM f JOIN o ON o.name = f.name AND o.n = f.n + 1)
SELECT name, max_by(avg, n) / 100 AS avg_time, max_by(failures, n) AS failures, max(n) AS runs FROM f GROUP BY name""")
def health_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.moving_average(source_runs(spark, sf_dir))


@query("W07, A31", f"""WITH {HEALTH}, g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY name ORDER BY "at", seq ROWS UNBOUNDED PRECEDING) AS g FROM h)
SELECT name, min("at") AS started, count(*) AS length FROM g WHERE NOT ok GROUP BY name, g HAVING count(*) >= 3""")
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.failure_runs(source_runs(spark, sf_dir), 3)


@query("W08, W09", f"""WITH s AS (SELECT event_id, ts, {_SHIFT} FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY day, shift
 ORDER BY ts DESC, event_id DESC) AS n FROM s)
SELECT day::TIMESTAMP AS day, shift, event_id AS seq FROM r WHERE n = 1""")
def latest_run_per_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts") - F.expr("interval 6 hours")
    runs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.date_trunc("day", at.cast("timestamp")).cast("timestamp_ntz").alias("day"),
        F.when(F.hour(at) < 12, "am").otherwise("pm").alias("shift")
    )
    return health.latest_per_shift(runs).select("day", "shift", "seq")


@query("J18, U03", f"""WITH s AS (SELECT DISTINCT user_id, {_SHIFT} FROM events)
SELECT a.day::TIMESTAMP AS day, a.user_id FROM s a JOIN s b ON a.day = b.day AND a.user_id = b.user_id AND a.shift = 'am' AND b.shift = 'pm'""")
def cross_shift_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts") - F.expr("interval 6 hours")
    s = table(spark, sf_dir, "events").select(
        "user_id", F.date_trunc("day", at.cast("timestamp")).cast("timestamp_ntz").alias("day"), (F.hour(at) < 12).alias("am")
    ).distinct()
    return s.where("am").drop("am").intersect(s.where("not am").drop("am")).select("day", "user_id")


NOISE, EVENT, STRICT = "(?i)(worthless|pathetic)", "(?i)(ingtion|edonth|oriti|keit|ment)", "(?i)(erhe|lich|ndo)"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as outside signals: their source is by tier, points by length."""
    source = F.when(F.col("tier") == 0, "hn").when(F.col("tier") == 1, "reddit").otherwise("hf")
    return articles(spark, sf_dir).select(
        F.col("id").alias("sig_id"), source.alias("source"), "title", F.length("summary").cast("int").alias("points")
    )


_SIG = f"{ARTICLES}, s AS (SELECT id AS sig_id, CASE tier WHEN 0 THEN 'hn' WHEN 1 THEN 'reddit' ELSE 'hf' END AS source, title, len(summary)::INT AS points FROM a)"


_BREAKING = f"""{_SIG}, p AS (SELECT doc_id AS sig_id, min(TIMESTAMP '{AS_OF}' - to_hours((doc_id % 40)::INT)) AS pushed_at FROM labels
 WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (SELECT sig_id, source, points FROM s WHERE NOT regexp_matches(title, '{NOISE}') AND CASE source
 WHEN 'reddit' THEN regexp_matches(title, '{STRICT}') ELSE regexp_matches(title, '{EVENT}') END
 AND points >= CASE source WHEN 'hn' THEN 300 WHEN 'hf' THEN 2000 WHEN 'reddit' THEN 0 END AND sig_id NOT IN (SELECT sig_id FROM p)
 ORDER BY points DESC, sig_id LIMIT 5)"""


def _breaking(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What was pushed before, and the signals to push now."""
    at = now() - F.make_dt_interval(F.lit(0), (F.col("doc_id") % 40).cast("int"))
    pushed = table(spark, sf_dir, "labels").where("doc_id is not null").select(
        F.col("doc_id").alias("sig_id"), at.alias("pushed_at")
    ).groupBy("sig_id").agg(F.min("pushed_at").alias("pushed_at"))
    return pushed, signals.breaking(_signals(spark, sf_dir), pushed, NOISE, EVENT, {"hn": 300, "hf": 2000}, stricter={"reddit": STRICT})


@query("F13, J15, T08", f"WITH {_BREAKING} SELECT * FROM f")
def breaking_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _breaking(spark, sf_dir)[1].select("sig_id", "source", "points")


@query(
    "C08",
    f"WITH {_BREAKING}, u AS (SELECT * FROM p UNION ALL SELECT sig_id, TIMESTAMP '{AS_OF}' FROM f) SELECT sig_id, min(pushed_at) AS pushed_at FROM u GROUP BY 1 HAVING min(pushed_at) >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR ORDER BY pushed_at DESC, sig_id LIMIT 5"
)
def breaking_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals are found, chosen, added to those pushed before, and the latest of a day are shown."""
    pushed, found = _breaking(spark, sf_dir)
    return signals.in_window(signals.accumulated(pushed, found, now()), now())


_STOP = ", ".join(repr(w) for w in text.STOP_WORDS)
_KEY = r"list_distinct(list_filter(list_transform(regexp_extract_all({}, '[A-Za-z][A-Za-z0-9-]*'), lambda x: lower(x)), lambda x: len(x) >= 2 AND x NOT IN (STOP)))".replace("STOP", _STOP)
#: words that count as brands in the driver's invented languages
_BRANDS = ["sst", "und", "que", "les", "anor"]
_MATCH = f"""{ARTICLES}, e AS (SELECT id AS event_id, importance, title, summary, 'x.y/' || id % 97 AS url_key, ['x.y/' || id % 89,
 'z/' || source_name] AS evidence_keys, [coalesce(source_name, ''), 'Und'] AS tags FROM a WHERE id % 5 = 0),
s0 AS (SELECT id AS signal_id, CASE id % 4 WHEN 0 THEN 'hn' WHEN 1 THEN 'reddit' WHEN 2 THEN 'hf' ELSE 'github' END AS source, CASE
 WHEN id % 9 = 0 THEN source_name || ' repo' ELSE title END AS title, CASE WHEN id % 2 = 0 THEN 'x.y/' || id % 101 ELSE '' END AS url_key,
 len(summary)::INT AS score FROM a WHERE id % 5 <> 0),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, signal_id) AS n FROM s0) WHERE n <= 50),
ew AS (SELECT event_id, unnest(CASE WHEN len({_KEY.format("title")}) > 0 THEN {_KEY.format("title")} ELSE {_KEY.format("summary")} END) AS t
 FROM e), sw AS (SELECT signal_id, unnest({_KEY.format("title")}) AS t FROM s),
et AS (SELECT event_id, unnest(list_distinct(list_transform(tags, lambda x: lower(x)))) AS t FROM e),
p AS (SELECT event_id, signal_id, 0 AS place FROM e JOIN s ON e.url_key = s.url_key WHERE s.url_key <> '' UNION ALL SELECT event_id,
 signal_id, 1 FROM (SELECT event_id, unnest(evidence_keys) AS k FROM e) JOIN s ON k = s.url_key WHERE s.url_key <> ''
 UNION ALL SELECT event_id, signal_id, CASE WHEN n >= 3 THEN 2 ELSE 3 END FROM (SELECT event_id, signal_id, count(*) AS n,
 bool_or(t IN ({", ".join(map(repr, _BRANDS))})) AS brand FROM ew JOIN sw USING (t) GROUP BY 1, 2) WHERE n >= 3 OR (n >= 2 AND brand)
 UNION ALL SELECT event_id, signal_id, 4 FROM et JOIN sw USING (t) UNION ALL SELECT event_id, signal_id, 5 FROM et
 JOIN s ON et.t <> '' AND contains(lower(s.title), et.t)),
f AS (SELECT event_id, signal_id, min(place) AS place FROM p GROUP BY 1, 2), c AS (SELECT event_id, source, signal_id, score, CASE place
 WHEN 0 THEN 'url_exact' WHEN 1 THEN 'url_evidence' WHEN 2 THEN 'title_keywords' WHEN 3 THEN 'title_brand'
 WHEN 4 THEN 'entity_match' ELSE 'entity_in_title' END AS rule, CASE place WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.7
 WHEN 3 THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence FROM f JOIN s USING (signal_id)),
m AS (SELECT event_id, source, signal_id, score, rule, confidence FROM (SELECT *, row_number() OVER (PARTITION BY event_id, source
 ORDER BY confidence * (score + 100) DESC, signal_id) AS n FROM c) WHERE n = 1)"""


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A fifth of the articles as events, and the fifty hottest of the others per service as signals, matched."""
    a, n = articles(spark, sf_dir), F.col("id")
    e = a.where("id % 5 = 0").select(
        n.alias("event_id"), "importance", "title", "summary", F.concat(F.lit("x.y/"), n % 97).alias("url_key"), F.array(
            F.concat(F.lit("x.y/"), n % 89), F.concat(F.lit("z/"), "source_name")
        ).alias("evidence_keys"), F.array(F.coalesce("source_name", F.lit("")), F.lit("Und")).alias("entity_tags"))
    s = a.where("id % 5 <> 0").select(
        n.alias("signal_id"), F.element_at(
            F.array(*map(F.lit, ("hn", "reddit", "hf", "github"))), (n % 4 + 1).cast("int")
        ).alias("source"), F.when(n % 9 == 0, F.concat("source_name", F.lit(" repo"))).otherwise(F.col("title")).alias("title"),
        F.when(n % 2 == 0, F.concat(F.lit("x.y/"), n % 101)).otherwise("").alias("url_key"), F.length("summary").alias("score"))
    hot = ranking.first_per_group(s, "source", [F.desc("score"), F.col("signal_id")], 50)
    return e, signals.match(e, hot, brands=_BRANDS)


@query("J10, P38", f"WITH {_MATCH} SELECT * FROM m")
def signal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir)[1]


@query("A20", f"WITH {_MATCH} SELECT source, count(*) AS matches, round(avg(confidence), 6) AS confidence FROM m GROUP BY source")
def signal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.match_stats(_matched(spark, sf_dir)[1])


@query("C07, P42", f"""WITH {_MATCH}, v AS (SELECT event_id, max(score) FILTER (source = 'hn') AS hn, bool_or(source = 'reddit') AS reddit,
 max(score) FILTER (source = 'hf') AS hf, max(score) FILTER (source = 'github') AS github FROM m GROUP BY 1),
t AS (SELECT *, greatest(CASE WHEN hn >= 1000 THEN 5 WHEN hn >= 500 THEN 4 WHEN hn >= 200 THEN 3 ELSE 0 END, CASE
 WHEN reddit THEN 3 ELSE 0 END, CASE WHEN hf >= 2000 THEN 4 WHEN hf >= 500 THEN 3 ELSE 0 END, CASE WHEN github >= 50000 THEN 4
 WHEN github >= 5000 THEN 3 ELSE 0 END) AS top,
 (hn IS NOT NULL)::INT + reddit::INT + (hf IS NOT NULL)::INT + (github IS NOT NULL)::INT AS seen FROM v)
SELECT event_id, importance, greatest(importance, least(5, top + CASE WHEN seen >= 2
 AND top > 0 THEN 1 ELSE 0 END))::INT AS effective_importance FROM t JOIN e USING (event_id)""")
def signal_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose importance their signals raise."""
    return signals.boosted(*_matched(spark, sf_dir))


_CHAINS = [
    ("c1", "error", 0.65, ["oil", "gas"]), ("c1", "signup", 0.65, ["oil", "gas"]), ("c2", "purchase", 0.5, ["gold"]),
    ("c3", "click", 0.8, ["chips", "oil", "gold"]), ("c2", "click", 0.5, ["gold"])
]


_CAUSAL = """t(chain_id, event, hit) AS (VALUES ('c1', 'error', 0.65), ('c1', 'signup', 0.65), ('c2', 'purchase', 0.5), ('c3', 'click',
 0.8), ('c2', 'click', 0.5)),
r(chain_id, reached) AS (VALUES ('c1', ['oil', 'gas']), ('c2', ['gold']), ('c3', ['chips', 'oil', 'gold'])),
k AS (SELECT event_id AS id, chain_id, hit, len(list_intersect(['oil', CASE WHEN user_id % 2 = 0 THEN 'gold' ELSE 'tin' END], reached))
 AS assets, CASE WHEN value > 20 THEN 'high' WHEN value > 5 THEN 'low' ELSE 'none' END AS level
 FROM events JOIN t ON event_type = event JOIN r USING (chain_id)),
m AS (SELECT id, chain_id, hit, assets::BIGINT AS assets, least(1.0, round_even((0.5 * hit + least(0.1 * assets, 0.25) + CASE level
 WHEN 'high' THEN 0.25 WHEN 'low' THEN 0.05 ELSE 0.10 END)::DOUBLE, 3))::DOUBLE AS confidence FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, chain_id) AS place FROM m)"""
_DIRECTION = {"oil": "up", "gas": "variable", "gold": "down", "chips": "side"}


def _causal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches, chains and each chain's impacts."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.array("event_type").alias("events"),
        F.array(F.lit("oil"), F.when(F.col("user_id") % 2 == 0, "gold").otherwise("tin")).alias("assets"),
        F.when(F.col("value") > 20, "high").when(F.col("value") > 5, "low").otherwise("none").alias("level")
    )
    triggers = spark.createDataFrame([(c, t, h) for c, t, h, _ in _CHAINS], "chain_id string, event string, hit_rate double")
    edges = spark.createDataFrame(
        [(c, i, to, _DIRECTION[to]) for c, reached in {c: r for c, _, _, r in _CHAINS}.items() for i, to in enumerate(reached)],
        "chain_id string, pos int, to string, direction string"
    )
    chains = spark.createDataFrame(
        [("c1", "energy", 0.65, "f" * 70), ("c2", "metal", 0.5, ""), ("c3", "supply", 0.8, "short")],
        "chain_id string, name string, hit_rate double, finding string"
    )
    labels = spark.createDataFrame([("oil", "Crude oil"), ("gold", "Gold")], "asset string, label string")
    return signals.causal(e, triggers, edges), chains, signals.impacts(edges, labels)


@query("J11, J13, C06, P43", f"WITH {_CAUSAL} SELECT id, chain_id, assets, confidence FROM m")
def causal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _causal(spark, sf_dir)[0]


@query("T11", f"WITH {_CAUSAL} SELECT id, chain_id, place::INT AS place FROM o")
def causal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.chain_order(_causal(spark, sf_dir)[0]).select("id", "chain_id", "place")


@query("P44", f"""WITH {_CAUSAL}, x(chain_id, name, parts, finding) AS (VALUES ('c1', 'energy', 'Crude oil↑, gas↕', repeat('f', 70)), ('c2',
 'metal', 'Gold↓', ''), ('c3', 'supply', 'chips?, Crude oil↑, Gold↓', 'short'))
SELECT id, string_agg('[' || name || '] (历史命中率' || round_even(hit * 100, 0)::INT || '%)' || chr(10) || '  影响: ' || parts || ' | 综合置信度: ' ||
 CASE WHEN confidence >= 0.7 THEN '高' WHEN confidence >= 0.5 THEN '中' ELSE '低' END || CASE WHEN finding <> '' THEN chr(10)
 || '  参考: ' || substr(finding, 1, 60) || '...' ELSE '' END, chr(10) ORDER BY place) AS summary
FROM o JOIN x USING (chain_id) WHERE place <= 2 GROUP BY id""")
def causal_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.impact_summary(*_causal(spark, sf_dir))


@query("J12, P44", f"""WITH {_CAUSAL}, x(chain_id, asset, asset_label, direction) AS (VALUES ('c1', 'oil', 'Crude oil', 'up'), ('c1', 'gas',
 'gas', 'variable'), ('c2', 'gold', 'Gold', 'down'), ('c3', 'chips', 'chips', 'side'), ('c3', 'oil', 'Crude oil', 'up'), ('c3', 'gold',
 'Gold', 'down'))
SELECT id, chain_id, confidence, asset, asset_label, direction FROM o JOIN x USING (chain_id) WHERE place <= 3""")
def causal_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, _, impacts = _causal(spark, sf_dir)
    return signals.impact_list(matches, impacts)


@query("K01, K04", """WITH o AS (SELECT doc_id AS id, source AS title, lang AS summary, CASE
 WHEN lang = 'en' THEN 'analyzed' ELSE 'collected' END AS status FROM documents),
n AS (SELECT doc_id + 100 AS id, 'new ' || source AS title, CASE WHEN lang = 'fr' THEN lang END AS summary FROM documents)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.title WHEN o.status = 'collected' THEN coalesce(n.title, o.title)
 ELSE o.title END AS title,
 CASE WHEN o.id IS NULL THEN n.summary WHEN o.status = 'collected' THEN coalesce(n.summary, o.summary) ELSE o.summary END AS summary,
 coalesce(o.status, 'collected') AS status, o.id IS NULL AS is_new FROM o FULL JOIN n ON o.id = n.id""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    old = d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("summary"),
        F.when(F.col("lang") == "en", "analyzed").otherwise("collected").alias("status")
    )
    new = d.select(
        (F.col("doc_id") + 100).alias("id"), F.concat(F.lit("new "), "source").alias("title"),
        F.when(F.col("lang") == "fr", F.col("lang")).alias("summary")
    )
    return store.upsert(old, new, "id", ["title", "summary"])


@query("K03, K05, R08",
 """SELECT DISTINCT o_orderkey AS event_id, l_suppkey AS article_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o_orderkey AND x.l_suppkey = lineitem.l_suppkey AND x.l_returnflag = 'R')""")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    n, keys = rows.count(), ["event_id", "article_id"]
    pair = lambda df: df.select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("article_id"))
    old = spread(pair(rows.where("l_returnflag = 'R'")), n, *keys)
    return store.insert_ignore(old, pair(spread(rows, n, "l_orderkey").join(o, "l_orderkey", "left_semi")), keys)


@query("K08, K09, J17",
 """SELECT count(*) AS kept, count(DISTINCT l_orderkey) AS events FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL 30 DAY)""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_at = F.lit("2000-01-31 00:00:00").cast("timestamp_ntz")
    kept_events = store.retained(
        table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "event_id"), "o_orderdate", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"),
        30
    )
    rows = store.retained(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "event_id"), "l_shipdate", cut_at, 30)
    return store.without_orphans(rows, kept_events).agg(F.count("*").alias("kept"), F.count_distinct("event_id").alias("events"))


@query("K07", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return store.latest(e.where("event_type = 'view'"), e.where("event_type <> 'view'"), "user_id", F.struct("ts", "event_id"))


@query("J16", """WITH n AS (SELECT o_custkey AS key, o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders
 WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-02-01')
SELECT key, o_orderkey, month FROM n WHERE key NOT IN (SELECT o_custkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN ('1997-12',
 '1997-11'))""")
def archive_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return store.archive_new(o.where("month = '1998-01'"), o, "key", "month", ["1997-12", "1997-11"])


@query("T13",
 """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE contains(o_orderpriority, 'URGENT') ORDER BY day DESC, o_orderkey LIMIT 30""")
def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring search over the archive, newest first, a page of 30 results."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").contains("URGENT"))
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).orderBy(F.desc("day"), "o_orderkey").limit(30)


@query("A16, S21",
 """SELECT event_type AS level, 'm' || (user_id % 10) AS module, substr(props, 1, 60) AS head, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY ALL ORDER BY n DESC, level, module, head LIMIT 30""")
def error_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("level"), F.concat(F.lit("m"), F.col("user_id") % 10).alias("module"), F.col("props").alias("message"),
        F.col("ts").alias("at")
    )
    return health.error_rollup(log)


@query("A19, K14, F18", """WITH v AS (SELECT source AS "group", CASE WHEN quality = 1 AND toxic = 0 THEN 'correct'
 WHEN quality = 1 THEN 'partially' WHEN toxic = 1 THEN 'unverifiable' ELSE 'wrong' END AS verdict FROM labels JOIN documents USING (doc_id)),
n AS (SELECT "group", count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'partially') AS partially, count(*)
 FILTER (verdict = 'wrong') AS wrong, count(*) FILTER (verdict = 'unverifiable') AS unverifiable FROM v GROUP BY 1)
SELECT *, CASE WHEN correct + partially + wrong > 0 THEN round_even((correct + 0.5 * partially)::DOUBLE / (correct + partially + wrong)
 * 100, 0)::DOUBLE END AS accuracy FROM n""")
def scorecard_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("group")), "doc_id")
    verdict = F.when(
        (F.col("quality") == 1) & (F.col("toxic") == 0), "correct"
    ).when(F.col("quality") == 1, "partially").when(F.col("toxic") == 1, "unverifiable").otherwise("wrong")
    return health.scorecard(l.select("group", verdict.alias("verdict")))


@query("J21", """WITH d AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY ALL),
 f AS (SELECT user_id, min(date_trunc('day', ts))::TIMESTAMP AS judged FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT f.user_id, judged, coalesce(sum(n), 0)::BIGINT AS later FROM f LEFT JOIN d ON f.user_id = d.user_id AND d.day > judged GROUP BY ALL""")
def later_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence after a judgment: events are summed per day before the range join, whose key bounds it."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz"))
    d = e.groupBy(F.col("user_id").alias("u"), "day").agg(F.count("*").alias("n"))
    f = e.where("event_type = 'error'").groupBy("user_id").agg(F.min("day").alias("judged"))
    return f.join(
        d, (F.col("u") == F.col("user_id")) & (F.col("day") > F.col("judged")), "left"
    ).groupBy("user_id", "judged").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("later"))


@query("A21, F15, P15", """WITH i AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages), u AS (SELECT host,
 count(*) AS uses FROM i GROUP BY 1)
SELECT page_id, CASE WHEN uses < 3 THEN 'http://img/' || host ELSE 'http://alt/' || page_id END AS image_used FROM i JOIN u USING (host)""")
def image_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("http://img/"), F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("image"),
        F.array(F.lit("data:x"), F.concat(F.lit("http://alt/"), "page_id")).alias("alternates")
    )
    return ranking.images(i, "(logo|avatar|pixel)").select("page_id", "image_used")


@query("F24", """WITH p AS (SELECT s_name AS name, CASE WHEN s_nationkey % 5 = 4 THEN 'tier out of range' END AS a, CASE
 WHEN s_acctbal <= 0 THEN 'age not positive' END AS b, CASE WHEN s_suppkey % 3 = 0 THEN 'missing key url' END AS c, CASE
 WHEN s_suppkey % 4 = 0 THEN 'unknown key colour' END AS d FROM supplier)
SELECT name, a AS problem FROM p WHERE a IS NOT NULL UNION ALL SELECT name, b FROM p WHERE b IS NOT NULL UNION ALL SELECT name, c FROM p
 WHERE c IS NOT NULL UNION ALL SELECT name, d FROM p WHERE d IS NOT NULL
UNION ALL SELECT DISTINCT c_name, 'authority without source' FROM customer WHERE c_custkey % 50 = 0""")
def config_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.lit("u").alias("url"), F.when(F.col("s_nationkey") % 5 == 4, 7).otherwise(1).alias("tier"),
        F.ceil("s_acctbal").alias("max_age_hours"), "s_suppkey"
    )
    keys_ = F.filter(
        F.array(F.lit("name"), F.when(F.col("s_suppkey") % 3 != 0, F.lit("url")), F.when(F.col("s_suppkey") % 4 == 0, F.lit("colour"))),
        lambda k: k.isNotNull()
    )
    named = filters.key_problems(s.select("name", keys_.alias("keys")), ["name", "url"], ["name", "url", "tier"])
    authorities = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_name").alias("name")).unionByName(s.select("name"))
    return filters.config_problems(s).unionByName(named).unionByName(filters.dangling(authorities, s))


@query("A18",
 """SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-30') AS last_day, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS last_week, count(*) FILTER (event_type = 'error' AND ts >= TIMESTAMP '2024-01-24') AS errors, count(DISTINCT user_id) AS sources FROM events""")
def state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, at = table(spark, sf_dir, "events"), F.lit("2024-01-31").cast("timestamp_ntz")
    day, week = F.col("ts") >= at - F.expr("interval 1 day"), F.col("ts") >= at - F.expr("interval 7 days")
    return e.agg(
        F.count_if(day).alias("last_day"), F.count_if(week).alias("last_week"), F.count_if((F.col("event_type") == "error") & week).alias("errors"),
        F.count_distinct("user_id").alias("sources")
    )


@query("J14, T09", f"""WITH {ARTICLES}, c AS (SELECT 'src' || s_suppkey AS name, s_suppkey % 4 <> 0 AS enabled FROM supplier),
 st AS (SELECT source_name AS name, count(*) AS total, count(*) FILTER (collected_at >= {NOW} - INTERVAL 12 HOUR) AS w7, count(*)
 FILTER (collected_at >= {NOW} - INTERVAL 12 HOUR AND importance >= 3) AS w7_hi FROM a GROUP BY 1),
h AS (SELECT 'src' || user_id AS name, count(*) FILTER (event_type = 'error') AS f FROM events GROUP BY 1)
SELECT c.name, enabled, coalesce(total, 0) AS total, coalesce(w7, 0) AS w7, coalesce(w7_hi, 0) AS w7_hi, coalesce(f, 0) AS consec_fails,
 CASE WHEN NOT enabled THEN 'disabled' WHEN coalesce(f, 0) >= 10 THEN 'dead' WHEN coalesce(f, 0)
 >= 3 THEN 'failing' ELSE 'ok' END AS health_tag FROM c LEFT JOIN st USING (name) LEFT JOIN h USING (name)""")
def source_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = F.col("collected_at") >= now() - F.expr("interval 12 hours")
    stats = articles(spark, sf_dir).groupBy(F.col("source_name").alias("name")).agg(
        F.count("*").alias("total"), F.count_if(recent).alias("w7"), F.count_if(recent & (F.col("importance") >= 3)).alias("w7_hi")
    )
    sources = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("src"), "s_suppkey").alias("name"), (F.col("s_suppkey") % 4 != 0).alias("enabled")
    )
    state = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("src"), "user_id").alias("name")).agg(
        F.count_if(F.col("event_type") == "error").alias("consecutive_failures")
    )
    return health.dashboard(sources, stats, state)


_SIGNED = """g AS (SELECT id, title, lang, CASE id % 40 WHEN 0 THEN 'OpenAI launch ' || coalesce(lang, 'x') WHEN 1 THEN 'open-ai will unveil ' || id WHEN 2 THEN 'Zeta hires ' || id WHEN 3 THEN 'zeta to join ' || id ELSE coalesce(title, '') END AS signature FROM a)"""
_KEYS = r"""sk AS (SELECT id, signature, list_sort(list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(signature),
 '[^\p{L}\p{N}_]+', ' ', 'g')), ' +'), lambda t: len(t) > 1))) AS t, regexp_extract_all(lower(trim(signature, ' ')), '[\p{L}\p{N}_-]+') AS w FROM g),
key AS (SELECT id, 0 AS rank, array_to_string(t, ' ') AS key FROM sk WHERE len(signature) >= 6 AND len(t) >= 2
 UNION ALL SELECT id, 1, concat_ws('|', CASE WHEN w[1] IN ('openai', 'open-ai') THEN 'openai' ELSE w[1] END, v) FROM (SELECT id, w,
 list_filter(list_transform(w[2:5], lambda x: CASE WHEN x IN (VERB_LIST) THEN map(MAP_KEYS, MAP_VALUES)[x] END),
 lambda x: x IS NOT NULL)[1] AS v FROM sk) WHERE v IS NOT NULL)"""
_VERB = [(w, kind) for kind, words in keys.VERBS.items() for w in words]
_KEYS = _KEYS.replace(
    "VERB_LIST", ", ".join(repr(w) for w, _ in _VERB)
).replace("MAP_KEYS", repr([w for w, _ in _VERB])).replace("MAP_VALUES", repr([k for _, k in _VERB]))


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a signature: some by invented phrases, others by their title."""
    n, tail = F.col("id") % 40, F.col("id").cast("string")
    s = F.when(
        n == 0, F.concat(F.lit("OpenAI launch "), F.coalesce("lang", F.lit("x")))
    ).when(
        n == 1, F.concat(F.lit("open-ai will unveil "), tail)
    ).when(n == 2, F.concat(F.lit("Zeta hires "), tail)).when(n == 3, F.concat(F.lit("zeta to join "), tail))
    return articles(spark, sf_dir).select("id", s.otherwise(F.coalesce("title", F.lit(""))).alias("signature"))


#: similarity of events, of those in Chinese characters, and what a shared entity leaves of it: with an article, with a known event
EVENT_ALIKE, EVENT_ALIKE_CJK, SHARED = 0.4, 0.35, (0.7, 0.65)
#: articles of a group: events share more common words than titles, so their blocks are smaller
EVENT_GROUP = 25_000


def _event_texts(articles: DataFrame, new: bool = True) -> DataFrame:
    """What is compared of articles (id, signature, title, summary, entities); those without a title are not."""
    s = F.col("signature") if new else F.lit(None).cast("string")
    titled = articles.where("title <> ''").withColumn("_text", text.cluster_text(s, F.col("title"), F.col("summary")))
    bar = F.when(text.mostly_cjk(F.col("_text")), EVENT_ALIKE_CJK).otherwise(EVENT_ALIKE)
    return cosine.texts(titled, "id", "_text", bar, "entities", new)


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written table of articles with signature, title, entities and the head of the summary; whole texts are read once and not shuffled."""
    head = F.substring("summary", 1, 200).alias("summary")
    tagged = entities.tag(articles(spark, sf_dir), ENTITIES).select("id", "title", head, "entities")
    return cut(_signed(spark, sf_dir).join(tagged, "id"), "tagged")


def _texts_sql(old: str) -> str:
    """o: texts with words, bar and entities; old tells which articles are events of earlier runs, whose ids are negative."""
    return f"""tx AS (SELECT g.id, {old} AS old, entities, concat_ws(' ', CASE WHEN {old} THEN NULL ELSE signature || ' ' || signature || ' '
 || signature END, title, substr(summary, 1, 200)) AS body FROM g JOIN sg USING (id) WHERE title <> ''),
o AS (SELECT CASE WHEN old THEN id - 1000000000 ELSE id END AS id, old, entities, {similarity.words("body")} AS words,
 CASE WHEN {similarity.mostly_cjk("body")} THEN {EVENT_ALIKE_CJK} ELSE {EVENT_ALIKE} END AS bar FROM tx)"""


_EVENT_BAR = f"l.bar * CASE WHEN list_has_any(e.entities, l.entities) THEN CASE WHEN e.old THEN {SHARED[1]} ELSE {SHARED[0]} END ELSE 1.0 END"
_ENTITY_SIGNED = f"{TAGGED}, {_SIGNED.replace('g AS', 'sg AS').replace('SELECT id, title, lang,', 'SELECT id,')}"
_KEYED_SQL = _KEYS.replace("FROM g)", "FROM sg)")


@query("C02, C03, J19", f"""WITH RECURSIVE {_ENTITY_SIGNED}, {_KEYED_SQL}, {_texts_sql("FALSE")},
{similarity.scored("o", _EVENT_BAR, similarity.EVENT_SCORE, minhash=True)}, {similarity.BEST},
edge AS (SELECT min(id) OVER (PARTITION BY rank, key) AS x, id AS y FROM key UNION SELECT earlier, later FROM best),
two AS (SELECT x, y FROM edge UNION SELECT y, x FROM edge),
reach AS (SELECT id, id AS root FROM a UNION SELECT two.y, root FROM reach JOIN two ON reach.id = two.x WHERE root < two.y)
SELECT id, min(root) AS event FROM reach GROUP BY id""")
def event_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles grouped by equal signature keys, by entity and action, and by their best match among all earlier ones.

    Compared are signature, title and the head of the summary; the similarity is the largest of cosine,
    Jaccard and MinHash agreement, and a shared entity lowers the threshold.
    """
    a = _tagged(spark, sf_dir)
    found = cosine.pairs(_event_texts(a), EVENT_ALIKE_CJK, (SHARED[0], SHARED[0]), short=None, minhash=True, part=EVENT_GROUP, best=True)
    return events.cluster(a, cosine.best_earlier(found))


@query("C02, C03, J19", f"""WITH RECURSIVE {_ENTITY_SIGNED}, {_KEYED_SQL}, {_texts_sql("g.id % 3 = 0")},
{similarity.scored("o", _EVENT_BAR, similarity.EVENT_SCORE, minhash=True, where="x.id < y.id AND y.id >= 0")}, {similarity.BEST},
old AS (SELECT rank, key, min(id) AS event_id FROM key WHERE id % 3 = 0 GROUP BY 1, 2),
own AS (SELECT id, event_id FROM (SELECT k.id, event_id, row_number() OVER (PARTITION BY k.id ORDER BY k.rank) AS n FROM key k
 JOIN old USING (rank, key) WHERE k.id % 3 <> 0) WHERE n = 1),
n AS (SELECT a.id, b.earlier, own.event_id AS own FROM a LEFT JOIN best b ON b.later = a.id LEFT JOIN own ON own.id = a.id WHERE a.id % 3 <> 0),
fix AS (SELECT id, CASE WHEN earlier < 0 THEN earlier + 1000000000 ELSE own END AS ev FROM n WHERE coalesce(earlier, -1) < 0
 UNION ALL SELECT n.id, coalesce(fix.ev, n.own) FROM n JOIN fix ON n.earlier = fix.id),
edge AS (SELECT min(id) OVER (PARTITION BY rank, key) AS x, id AS y FROM key WHERE id % 3 <> 0 UNION SELECT n.earlier, n.id FROM n
 JOIN fix ON fix.id = n.earlier WHERE fix.ev IS NULL),
two AS (SELECT x, y FROM edge UNION SELECT y, x FROM edge),
reach AS (SELECT id, id AS root FROM n UNION SELECT two.y, root FROM reach JOIN two ON reach.id = two.x WHERE root < two.y),
m AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT id, 'e' || ev AS event_id, CASE WHEN ev IS NULL THEN min(CASE WHEN ev IS NULL THEN id END) OVER (PARTITION BY root) END AS group_id
 FROM m JOIN fix USING (id)""")
def events_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the articles as new ones, matched with the others as events of earlier runs and with each other.

    Known events are compared by title and summary, by their keys and with a lower threshold for shared
    entities; an article that matches another's text gets that article's event.
    """
    a, shift = _tagged(spark, sf_dir), 1_000_000_000
    old, new = a.where("id % 3 = 0"), a.where("id % 3 <> 0")
    given = _event_texts(old.withColumn("id", F.col("id") - shift), False).unionByName(_event_texts(new))
    best = cosine.best_earlier(cosine.pairs(given, EVENT_ALIKE_CJK, SHARED, short=None, minhash=True, part=EVENT_GROUP, best=True))
    known = F.concat(F.lit("e"), (F.col("earlier") + shift).cast("string"))
    matched = best.select("later", F.when(F.col("earlier") >= 0, F.col("earlier")).alias("earlier"), F.when(F.col("earlier") < 0, known).alias("event_id"))
    stored = old.select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("event_id"), F.col("id").alias("seq"), "signature")
    return events.continued(new.select("id", "signature"), stored, matched)


@query("J19, K05", f"""WITH {ARTICLES}, {_SIGNED}, {_KEYS}, old AS (SELECT rank, key, min(id) AS event_id FROM key WHERE id < 100
 GROUP BY 1, 2), h AS (SELECT k.id, event_id, row_number() OVER (PARTITION BY k.id ORDER BY k.rank) AS n FROM key k JOIN old USING (rank,
 key) WHERE k.id >= 100)
SELECT id, 'e' || event_id AS event_id FROM h WHERE n = 1""")
def joined_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that belong to events of earlier runs, and so get their key set."""
    a = _signed(spark, sf_dir)
    old = a.where("id < 100").select(F.concat(F.lit("e"), "id").alias("event_id"), F.col("id").alias("seq"), "signature")
    return events.known_events(a.where("id >= 100"), old)
