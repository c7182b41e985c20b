"""Queries of display fields, analyses and smaller reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import display, keys
from newsloom.operators import analysis, dedup, ranking
from newsloom.plans.registry import query
from newsloom.plans.views import ARTICLES, AS_OF, EVIDENCE, articles, evidence
from newsloom.sources.tables import table

NAMES, LEAVES = ["model", "infra"], {"es": "research", "fr": "gov"}
WORDS = [("biz", ["ingtion", "keitver"]), ("app", ["license", "tionhe"])]


@query("P28", f"""WITH {ARTICLES} SELECT id, CASE WHEN source_name IN ('model', 'infra') THEN source_name WHEN lang = 'es' THEN 'research'
 WHEN lang = 'fr' THEN 'gov'
 WHEN regexp_matches(lower(title), 'ingtion|keitver') THEN 'biz' WHEN regexp_matches(lower(title), 'license|tionhe')
 THEN 'app' ELSE 'other' END AS domain FROM a""")
def topic_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select(
        "id", display.domain(F.col("source_name"), F.col("lang"), F.col("title"), NAMES, LEAVES, WORDS, "other").alias("domain")
    )


@query("P32", f"""WITH {ARTICLES}, c AS (SELECT id, title, regexp_extract(substr(title, 1, 60), '^(.{{15,}})[,;:. -][^,;:. -]*$', 1) AS cut FROM a)
SELECT id, CASE WHEN len(title) <= 60 THEN title WHEN len(cut) > 0 THEN cut ELSE substr(title, 1, 60) END AS short, CASE WHEN len(title)
 > 46 THEN substr(title, 1, 45) || '…' ELSE title END AS head FROM c""")
def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card titles and headlines; their limits are those of the page."""
    return articles(spark, sf_dir).select(
        "id", display.short_title(F.lit(None).cast("string"), F.col("title")).alias("short"), display.headline(F.col("title"), 46).alias("head")
    )


@query("P50",
 f"""WITH {ARTICLES} SELECT id, md5(regexp_replace(replace(replace(replace(replace(summary, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '\\*\\*([^*]+)\\*\\*', '<b>\\1</b>', 'g')) AS digest FROM a""")
def escaped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("id", F.md5(display.escape(F.col("summary")).cast("binary")).alias("digest"))


@query("P30", f"WITH {EVIDENCE} SELECT event_id, (date_diff('day', min(reported_at), TIMESTAMP '2002-01-01') + 1)::INT AS days FROM e GROUP BY 1")
def days_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = evidence(spark, sf_dir).groupBy("event_id").agg(F.min("reported_at").alias("first"))
    return first.select("event_id", display.days_running(F.col("first"), F.lit("2002-01-01").cast("date")).alias("days"))


@query("P47", r"""WITH b AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^https?://(www\.)?', ''), '/+$', '') AS bare
 FROM pages), h AS (SELECT *, regexp_extract(bare, '^([^/?#]*)', 1) AS host FROM b),
m AS (SELECT page_id, url, ['https://' || bare, 'https://www.' || bare, 'http://' || bare, 'https://' || host || '/feed',
 'https://' || host || '/rss', 'https://' || host || '/rss.xml', 'https://' || host || '/atom.xml', 'https://' || host || '/feed.xml'] AS u FROM h)
SELECT page_id, array_to_string(list_filter(u, lambda x: x <> url)[1:6], ' ') AS candidates FROM m""")
def candidate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(display.candidate_urls(F.col("url")), " ").alias("candidates"))


@query("P24", """SELECT doc_id AS id, substr(trim(split_part(text, chr(10), 1)), 1, 60) AS title, greatest(1, least(5,
 (n_chars % 9 - 1)))::INT AS importance,
 CASE WHEN lang IN ('official', 'paper', 'news', 'opinion', 'community', 'video') THEN lang ELSE 'news' END AS source_type,
 array_to_string([lang, source], ',') AS categories FROM documents""")
def analysis_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    raw = d.select(
        F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("summary"),
        (F.col("n_chars") % 9 - 1).cast("string").alias("importance"), F.col("lang").alias("source_type"),
        F.array("lang", "source", F.lit("third")).alias("categories"), F.array("text").alias("details")
    )
    return analysis.validated(raw).select("id", "title", "importance", "source_type", F.array_join("categories", ",").alias("categories"))


@query("P24", """SELECT doc_id AS id, greatest(1, least(30, CASE WHEN n_chars % 40 > 1 THEN n_chars % 40 ELSE greatest(1, (len(text || lang)
 // 400)) END))::INT AS minutes, CASE WHEN doc_id % 2 = 0 THEN 'a.b' ELSE '' END AS events, CASE doc_id % 3
 WHEN 0 THEN 'mixed' ELSE 'neutral' END AS direction, CASE doc_id % 4 WHEN 0 THEN 'high' ELSE 'low' END AS confidence,
 CASE WHEN doc_id % 5 = 0 THEN 'pm,investor' ELSE 'general' END AS audience, CASE
 WHEN len(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r\\p{Nd}]', '', 'g')) > 0 AND len(regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}]'))
 < 0.6 * len(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r\\p{Nd}]', '', 'g')) THEN 'summary' ELSE '' END AS poor FROM documents WHERE text IS NOT NULL
 AND lang IS NOT NULL""")
def analysis_enumerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, enumerations, reading time and the share of Chinese in a model's answers."""
    d, n = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & F.col("lang").isNotNull()), F.col("doc_id")
    raw = d.select(
        n.alias("id"), F.lit("模型发布 X").alias("title"), F.col("text").alias("summary"), F.lit("").alias("why_it_matters"), F.lit(None).cast("string").alias("detailed_content"), F.col("lang").alias("background"), F.lit("").alias("deep_analysis"), (F.col("n_chars") % 40).cast("string").alias("reading_minutes"),
        F.array(
            F.when(n % 2 == 0, "a.b").otherwise("ab"), F.lit("plain"), F.lit("x"), F.lit("late.one")
        ).alias("causal_events"), F.lit(None).cast("array<string>").alias("affected_assets"), F.when(n % 3 == 0, "mixed").otherwise("sideways").alias("impact_direction"), F.when(n % 4 == 0, "high").otherwise("sure").alias("impact_confidence"),
        F.when(
            n % 5 == 0, F.array(F.lit(" PM "), F.lit("cat"), F.lit("investor"))
        ).otherwise(F.array(F.lit("everyone"))).alias("audience"))
    out = analysis.enumerated(raw)
    return out.select(
        "id", F.col("reading_minutes").alias("minutes"), F.array_join("causal_events", ",").alias("events"),
        F.col("impact_direction").alias("direction"), F.col("impact_confidence").alias("confidence"), F.array_join("audience", ",").alias("audience"),
        F.array_join("low_chinese_ratio", ",").alias("poor")
    )


@query("J22, F22", f"""WITH p AS (SELECT page_id, lower(regexp_replace(trim(url), '/+$', '')) AS k, len(html) AS n,
 TIMESTAMP '{AS_OF}' - to_days((page_id % 14)::INT) AS created_at FROM pages),
f AS (SELECT k, max(page_id) AS page_id FROM p WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND n > 3000 GROUP BY 1)
 SELECT p.page_id, f.page_id IS NOT NULL AS cached FROM p LEFT JOIN f USING (k)""")
def analysis_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose analysis is in a cache of pages seen within a week."""
    now = F.lit(AS_OF).cast("timestamp_ntz")
    p = table(spark, sf_dir, "pages").select(
        "page_id", keys.article_id(F.col("url")).alias("url_key"), F.col("html").alias("content"), F.lit(True).alias("relevant"),
        (now - F.make_dt_interval((F.col("page_id") % 14).cast("int"))).alias("created_at")
    )
    cache = p.withColumn(
        "content", F.when(F.length("content") > 3000, F.col("content")).otherwise("")
    ).dropDuplicates(["url_key", "created_at", "content"])
    hit, missed = analysis.from_cache(p.select("page_id", "url_key"), cache, now)
    return hit.select("page_id").distinct().withColumn("cached", F.lit(True)).unionByName(missed.select("page_id", F.lit(False).alias("cached")))


@query(
    "A28",
    f"WITH {EVIDENCE}, f AS (SELECT event_id, min_by(source_name, pos) AS first FROM e GROUP BY 1) SELECT e.event_id, e.source_name, min(reported_at) AS earliest FROM e JOIN f ON e.event_id = f.event_id AND e.source_name <> first GROUP BY ALL"
)
def other_sources_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir)
    first = e.groupBy("event_id").agg(F.min_by("source_name", "pos").alias("first"))
    return e.join(first, "event_id").where("source_name <> first").groupBy("event_id", "source_name").agg(F.min("reported_at").alias("earliest"))


_RENDERED = "collected_at + to_hours((id % 240)::INT)"


@query("A29, P49", f"""WITH {ARTICLES} SELECT strftime(collected_at + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, id, strftime(collected_at + INTERVAL 8 HOUR, '%H:%M') AS time,
 strftime({_RENDERED} + INTERVAL 8 HOUR, '%Y-%m-%d') || CASE WHEN hour({_RENDERED} + INTERVAL 8 HOUR) >= 12 THEN '-pm' ELSE '-am' END AS page
 FROM a WHERE importance >= 4 AND {_RENDERED} >= TIMESTAMP '2024-01-11 18:00:00' - INTERVAL 7 DAY""")
def important_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Important events rendered within a week, by the local date on which they were published; the page is that of the rendering."""
    a = articles(spark, sf_dir).withColumn("rendered_at", F.col("collected_at") + F.make_dt_interval(F.lit(0), (F.col("id") % 240).cast("int")))
    found = ranking.important_days(a, "collected_at", F.lit("2024-01-11 18:00:00").cast("timestamp_ntz"), "Asia/Shanghai")
    return found.select("day", "id", "time", "page")


@query(
    "T06",
    f"WITH {ARTICLES}, r AS (SELECT id, source_name, row_number() OVER (PARTITION BY source_name ORDER BY importance DESC, id) AS n FROM a WHERE importance >= 2) SELECT id, source_name FROM r WHERE n <= 6"
)
def top_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most important items of each source, the size of its box."""
    return ranking.first_per_group(
        articles(spark, sf_dir).where("importance >= 2"), "source_name", [F.desc("importance"), F.col("id")], 6
    ).select("id", "source_name")


@query(
    "F21",
    f"WITH {ARTICLES} SELECT id FROM a WHERE contains(lower(title), 'the') AND list_contains(string_split(source_name || ',' || lang, ','), 'en') AND tier = 1"
)
def page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir)
    return a.where(
        F.lower("title").contains("the") & F.array_contains(F.split(F.concat_ws(",", "source_name", "lang"), ","), "en") & (F.col("tier") == 1)
    ).select("id")


@query(
    "F14, P41",
    f"WITH {ARTICLES}, k AS (SELECT id, CASE source_name WHEN 'src1' THEN 5 WHEN 'src2' THEN 4 ELSE CASE lang WHEN 'en' THEN 3 ELSE 2 END END AS authority FROM a) SELECT id, authority::INT AS authority FROM k WHERE authority >= 3"
)
def min_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.functions.scores import authority

    a = articles(spark, sf_dir).withColumn(
        "authority", authority(F.col("source_name"), F.when(F.col("lang") == "en", "media").otherwise("tech"), {"src1": 5, "src2": 4})
    )
    return a.where("authority >= 3").select("id", "authority")


@query("W10", f"""WITH {ARTICLES}, t AS (SELECT id, unnest(list_distinct(list_filter(regexp_extract_all(lower(title),
 '[\\p{{L}}\\p{{N}}_]+'), lambda t: len(t) > 1))) AS term FROM a)
SELECT id, term, (row_number() OVER (PARTITION BY term ORDER BY id) - 1)::BIGINT AS earlier FROM t""")
def prefix_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many earlier titles hold each term of a title: the sequential document frequency."""
    return dedup.earlier_frequency(articles(spark, sf_dir), "id", "title")


@query(
    "J23",
    "SELECT o_orderkey AS event_id, coalesce(nullif(CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END, ''), c_mktsegment) AS title FROM orders LEFT JOIN customer ON o_custkey = c_custkey"
)
def event_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("canonical_article_id"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority")).alias("title")
    )
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("title"))
    return analysis.filled(e, a, ["title"]).select("event_id", "title")


@query("K18", "SELECT doc_id AS id FROM documents WHERE len(text) < 100")
def polluted_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.lit(1).alias("level"), F.lit("").alias("background"), F.lit(None).cast("string").alias("deep"),
        F.col("text").alias("content")
    )
    return analysis.polluted(d).select("id")


@query("F17", "SELECT conv_id, turn FROM conversations WHERE NOT contains(lower(text), 'not') AND role <> 'system'")
def judgment_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.lower("text").contains("not").cast("int").alias("contradicted"),
        F.when(F.col("role") == "system", "low").otherwise("high").alias("confidence")
    )
    return analysis.publishable(c).select("conv_id", "turn")
