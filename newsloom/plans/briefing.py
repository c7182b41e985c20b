"""Queries of the briefing step: gates, page sections, labels, run records, digest stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import display
from newsloom.functions.text import capitals
from newsloom.operators import briefing, filters
from newsloom.plans.registry import query
from newsloom.plans.views import AS_OF, EVIDENCE, evidence
from newsloom.sources.tables import table

ITEMS = """i AS (
  SELECT doc_id AS id, doc_id AS pos, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS summary, coalesce(source,
 '') AS source_name, (doc_id % 3)::INT AS tier, (doc_id % 2)::INT AS level,
         (1 + n_chars % 5)::INT AS importance, (1 + doc_id % 4)::INT AS cluster_size, CASE
 WHEN doc_id % 11 = 0 THEN 'official' ELSE 'reported' END AS status, doc_id % 7 <> 0 AS ai_relevant,
         CASE doc_id % 5 WHEN 0 THEN 'video' WHEN 1 THEN 'paper' WHEN 2 THEN 'community' WHEN 3 THEN 'official' ELSE '' END AS source_type,
         CASE WHEN lang = 'en' THEN coalesce(text, '') ELSE '' END AS detailed_content, coalesce(lang, '') AS background, '' AS deep_analysis,
         CASE WHEN lang = 'en' THEN [coalesce(text, ''), source || source || source] ELSE [coalesce(text, '')] END AS key_details,
         [CASE doc_id % 4 WHEN 0 THEN 'Launch' WHEN 1 THEN 'paper notes' WHEN 2 THEN 'funding' ELSE 'other' END, coalesce(lang, ''),
 'third'] AS categories,
         [coalesce(lang, ''), coalesce(source, '')] AS entities, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS collected_at
  FROM documents)"""
_DETAILS = "len(list_filter(key_details, lambda x: len(x) >= 10))"
_SUBSTANCE = f"(len(summary) >= 20 AND CASE WHEN level = 0 THEN coalesce({_DETAILS} >= 2, FALSE) ELSE len(background) > 0 OR len(detailed_content) >= 100 OR coalesce({_DETAILS} >= 2, FALSE) END)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as analysed items of a briefing."""
    d, text, lang, source = table(spark, sf_dir, "documents"), F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    n = F.col("doc_id")
    return d.select(
        n.alias("id"), n.alias("pos"), F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"), text.alias("summary"), source.alias("source_name"), (n % 3).cast("int").alias("tier"), (n % 2).cast("int").alias("level"),
        (1 + F.col("n_chars") % 5).cast("int").alias("importance"), (1 + n % 4).cast("int").alias("cluster_size"), F.when(n % 11 == 0, "official").otherwise("reported").alias("status"), (n % 7 != 0).alias("ai_relevant"),
        F.when(n % 5 == 0, "video").when(n % 5 == 1, "paper").when(n % 5 == 2, "community").when(n % 5 == 3, "official").otherwise("").alias("source_type"),
        F.when(F.col("lang") == "en", text).otherwise("").alias("detailed_content"), lang.alias("background"), F.lit("").alias("deep_analysis"),
        F.when(F.col("lang") == "en", F.array(text, F.concat("source", "source", "source"))).otherwise(F.array(text)).alias("key_details"),
        F.array(
            F.when(n % 4 == 0, "Launch").when(n % 4 == 1, "paper notes").when(n % 4 == 2, "funding").otherwise("other"), lang, F.lit("third")
        ).alias("categories"),
        F.array(lang, source).alias("entities"), F.expr(
            "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)"
        ).alias("collected_at"))


@query("F01, U01", """SELECT s_name AS name, (s_nationkey % 3)::INT AS tier FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0
 AND s_nationkey % 3 IN (0, 1)
UNION ALL SELECT c_name, 2 FROM customer WHERE c_custkey % 9 = 0""")
def enabled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of sources, enabled ones of the wanted tiers."""
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), (F.col("s_nationkey") % 3).cast("int").alias("tier"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 7 != 0).when(F.col("s_suppkey") % 7 == 0, False).alias("enabled"),
        (F.col("s_suppkey") % 5 == 0).alias("disabled")
    )
    c = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.lit(None).cast("int").alias("tier"), (F.col("c_custkey") % 9 == 0).alias("enabled"),
        F.lit(None).cast("boolean").alias("disabled")
    )
    return briefing.enabled_sources(s, [0, 1]).unionByName(briefing.enabled_sources(c, [2])).select(
        "name", F.coalesce("tier", F.lit(2)).alias("tier")
    )


@query("F06, F07", f"WITH {ITEMS} SELECT id FROM i WHERE tier = 0 OR status = 'official' OR {_SUBSTANCE}")
def published_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefing.worth_publishing(items(spark, sf_dir)).select("id")


@query("F08", f"WITH {ITEMS} SELECT id FROM i WHERE CASE WHEN level >= 1 THEN {_SUBSTANCE} ELSE importance >= 2 AND len(trim(summary, ' ')) >= 20 END")
def shown_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefing.worth_showing(items(spark, sf_dir)).select("id")


@query("F18", """SELECT o_orderkey AS key, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
 WHERE o_orderdate::DATE BETWEEN DATE '1996-03-01' - 45 AND DATE '1996-03-01' - 5 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem
 WHERE l_returnflag = 'R')
ORDER BY o_orderdate::DATE, o_orderkey LIMIT 12""")
def scorecard_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("date"))
    scored = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    return briefing.due_for_scoring(j, scored, F.lit("1996-03-01").cast("date")).select("key", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("P31",
 f"""WITH {ITEMS} SELECT id, CASE WHEN tier = 0 OR source_type = 'official' THEN 'official' WHEN source_type = 'paper' THEN 'academic' WHEN source_type IN ('video', 'community') THEN source_type WHEN tier = 1 THEN 'academic' ELSE 'media' END AS badge FROM i""")
def source_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", briefing.source_badge(F.col("tier"), F.col("source_type")).alias("badge"))


_LABELS = {"the": "Thea", "que": "Quest", "und": "Undine", "les": "Lester"}
_PRODUCTS = r"[Aa]n[a-z]*|[Vv]er[a-z]*"


@query("P22", f"""WITH {ITEMS}, l AS (SELECT id, title,
 list_filter([{", ".join(f"CASE WHEN contains(lower(title), '{k}') THEN '{v}' END" for k, v in _LABELS.items())}],
 lambda x: x IS NOT NULL)[1:2] || regexp_extract_all(title, '({_PRODUCTS})', 1)[1:1] AS p FROM i)
SELECT id, CASE WHEN len(regexp_extract_all(title, '[\\x{{4E00}}-\\x{{9FFF}}]')) > 0.3 * len(title) THEN '' ELSE array_to_string(p, ' | ')
 END AS label FROM l""")
def label_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", briefing.label_title(F.col("title"), _LABELS, _PRODUCTS).alias("label"))


@query(
    "A09",
    f"WITH {ITEMS} SELECT category, count(*) AS n FROM (SELECT unnest(categories[1:2]) AS category FROM i WHERE ai_relevant) WHERE category <> '' GROUP BY 1"
)
def category_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefing.category_distribution(items(spark, sf_dir).withColumnRenamed("ai_relevant", "relevant"))


_HEALTH_SQL = """h AS (SELECT 'u' || user_id AS name, (count(*) FILTER (event_type = 'error'))::BIGINT AS consecutive_failures, CASE
 WHEN max_by(event_type, (ts, event_id)) = 'error' THEN 'down' ELSE 'ok' END AS status FROM events GROUP BY user_id),
x AS (SELECT DISTINCT 'u' || c_custkey AS name FROM customer WHERE c_custkey % 4 = 0), live AS (SELECT * FROM h ANTI JOIN x USING (name))"""


def _health(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    name = F.concat(F.lit("u"), "user_id")
    h = table(spark, sf_dir, "events").groupBy(name.alias("name")).agg(
        F.count_if(F.col("event_type") == "error").alias("consecutive_failures"),
        F.when(F.max_by("event_type", F.struct("ts", "event_id")) == "error", "down").otherwise("ok").alias("status")
    )
    return h, table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("u"), "c_custkey").alias("name"))


@query("A17", f"""WITH {_HEALTH_SQL} SELECT count(*) FILTER (status = 'ok') AS healthy, count(*) FILTER (consecutive_failures >= 3)
 AS failing, count(*) FILTER (consecutive_failures >= 10) AS dead,
(SELECT coalesce(string_agg(name, ',' ORDER BY name), '') FROM (SELECT name FROM live WHERE consecutive_failures >= 10
 ORDER BY name LIMIT 5)) AS dead_sources FROM live""")
def run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefing.run_health(*_health(spark, sf_dir)).withColumn("dead_sources", F.array_join("dead_sources", ","))


@query(
    "A31",
    f"WITH {_HEALTH_SQL} SELECT name, consecutive_failures, CASE WHEN consecutive_failures >= 10 THEN 'dead' ELSE 'failing' END AS level FROM h WHERE consecutive_failures >= 3"
)
def failing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefing.failing_sources(_health(spark, sf_dir)[0])


@query("A30", """SELECT event_type AS stage, count(*) AS calls, sum(CASE
 WHEN event_id % 2 = 0 THEN event_id % 100 ELSE event_id % 90 END)::BIGINT AS prompt_tokens, sum(event_id % 50)::BIGINT AS completion_tokens,
 sum(CASE WHEN event_id % 3 = 0 AND event_id % 500 <> 0 THEN event_id % 500 ELSE CASE
 WHEN event_id % 2 = 0 THEN event_id % 100 ELSE event_id % 90 END + event_id % 50 END)::BIGINT AS total_tokens, count(*) FILTER (value > 50)
 AS parse_failures FROM events GROUP BY 1""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of two services, which name their counts differently; some state a total."""
    n, even = F.col("event_id"), F.col("event_id") % 2 == 0
    calls = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"), F.when(even, n % 100).alias("prompt_tokens"), F.when(~even, n % 90).alias("input_tokens"),
        F.when(even, n % 50).alias("completion_tokens"), (n % 50).alias("output_tokens"), F.when(n % 3 == 0, n % 500).alias("total_tokens"),
        (F.col("value") > 50).alias("parse_failed")
    )
    # a zero prompt count falls back to the other name, which such calls lack
    return briefing.usage_totals(calls)


@query("W09",
 """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'purchase') SELECT event_id, n <= 14 AS listed FROM r WHERE n <= 60""")
def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 60 runs of the chart, and which of them the table of 14 lists."""
    runs = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    chart, listed = briefing.last_runs(runs, 60), briefing.last_runs(runs, 14).select("event_id", F.lit(True).alias("listed"))
    return chart.join(F.broadcast(listed), "event_id", "left").select("event_id", F.coalesce("listed", F.lit(False)).alias("listed"))  # 14 rows


@query(
    "T06",
    f"WITH {ITEMS}, r AS (SELECT *, row_number() OVER (ORDER BY importance DESC, cluster_size DESC, pos) AS n FROM i) SELECT 'am' AS shift, id FROM r WHERE n <= 14 UNION ALL SELECT 'pm', id FROM r WHERE n <= 8"
)
def page_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return briefing.grid(i, "am").select(F.lit("am").alias("shift"), "id").union(briefing.grid(i, "pm").select(F.lit("pm"), "id"))


@query("T02", f"WITH {ITEMS} SELECT id, importance, collected_at FROM i WHERE importance >= 3")
def by_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefing.by_importance(items(spark, sf_dir).where("importance >= 3")).select("id", "importance", "collected_at")


_FEATURED = "f AS (SELECT id FROM i WHERE importance = 5 ORDER BY id LIMIT 10)"


@query("T12, F23",
 f"""WITH {ITEMS}, {_FEATURED} SELECT id, importance FROM i WHERE (source_name LIKE 'X-%' OR source_name IN ('src1', 'src2') OR source_type = 'video') AND ai_relevant AND importance >= 2 AND id NOT IN (SELECT id FROM f) ORDER BY importance DESC, id LIMIT 6""")
def favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return briefing.favourites(i, i.where("importance = 5").orderBy("id").limit(10), ["src1", "src2"]).select("id", "importance")


@query(
    "T15",
    f"WITH {ITEMS}, r AS (SELECT id, row_number() OVER (ORDER BY importance DESC, id) AS n FROM i WHERE ai_relevant) SELECT id, n::INT AS place, CASE WHEN n <= 3 THEN 'top' ELSE 'quick' END AS part FROM r WHERE n <= 11"
)
def broadcast_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefing.broadcast_list(items(spark, sf_dir)).select("id", "place", "part")


@query("T03", f"WITH {ITEMS} SELECT id, tier FROM i WHERE level = 0 ORDER BY tier, collected_at DESC, id LIMIT 50")
def unanalysed_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty items to analyse next: low tiers, then the latest."""
    return items(spark, sf_dir).where("level = 0").orderBy("tier", F.desc("collected_at"), "id").limit(50).select("id", "tier")


@query(
    "T10",
    f"WITH {ITEMS} SELECT id, row_number() OVER (PARTITION BY source_name ORDER BY importance DESC, cluster_size DESC, id)::INT AS place FROM i WHERE importance >= 4"
)
def archive_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each important item in its source's archive."""
    place = F.row_number().over(Window.partitionBy("source_name").orderBy(F.desc("importance"), F.desc("cluster_size"), "id"))
    return items(spark, sf_dir).where("importance >= 4").select("id", place.alias("place"))


@query("A14", f"""WITH {ITEMS} SELECT count(*) AS kept, count(*) FILTER (level >= 1) AS llm_count, round(count(*) FILTER (level >= 1)
 / count(*), 4) AS llm_coverage, count(*) FILTER (cluster_size >= 2) AS multi_source_count, count(*) FILTER (importance >= 4) AS important_count,
count(*) FILTER (status = 'official') AS official_count, count(*) FILTER (trim(detailed_content, ' ') <> '' AND trim(background, ' ') <> '')
 AS depth_count, (SELECT count(DISTINCT e) FROM (SELECT unnest(entities) AS e FROM i) WHERE e <> '') AS entity_count FROM i""")
def briefing_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "name string, consecutive_failures bigint, status string")
    return briefing.run_summary(items(spark, sf_dir), none, none, "r", "am").drop("run_id", "shift", "healthy", "failing", "dead", "dead_sources")


@query("K16", f"""WITH {ITEMS}, {_HEALTH_SQL} SELECT 'r1' AS run_id, 'am' AS shift, (SELECT count(*) FROM i) AS kept, (SELECT count(*)
 FILTER (consecutive_failures >= 10) FROM live) AS dead
UNION ALL SELECT 'r2', 'pm', (SELECT count(*) FROM i WHERE importance >= 3), (SELECT count(*) FILTER (consecutive_failures >= 10) FROM live)""")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs append their summaries to a JSON log, which is read back."""
    import uuid

    from newsloom.sources.tables import shared_dir

    path, i, health = f"{shared_dir(spark)}/run-log-{uuid.uuid4().hex}", items(spark, sf_dir), _health(spark, sf_dir)
    briefing.append_summary(briefing.run_summary(i, *health, "r1", "am"), path)
    briefing.append_summary(briefing.run_summary(i.where("importance >= 3"), *health, "r2", "pm"), path)
    return spark.read.schema("run_id string, shift string, kept bigint, dead bigint").json(path)


@query("K11",
 """SELECT o_orderkey AS event_id, CASE WHEN o_orderpriority = '1-URGENT' THEN TIMESTAMP '2024-01-01 18:00:00' WHEN o_orderstatus = 'F' THEN o_orderdate END AS rendered_at, CASE WHEN o_orderpriority = '1-URGENT' THEN 'pm' WHEN o_orderstatus = 'F' THEN 'am' END AS rendered_shift FROM orders""")
def mark_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    old = o.select(
        F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp_ntz")).alias("rendered_at"),
        F.when(F.col("o_orderstatus") == "F", "am").alias("rendered_shift")
    )
    shown = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("event_id"))
    return briefing.mark_rendered(old, shown, F.lit(AS_OF).cast("timestamp_ntz"), "PM")


@query("K12",
 """SELECT event_id AS run_id, ts AS started_at, CASE WHEN event_type IN ('view', 'click') THEN ts END AS finished_at, CASE WHEN event_type = 'view' THEN 'ok' WHEN event_type = 'click' THEN 'failed' ELSE 'running' END AS status, CASE WHEN event_type IN ('view', 'click') THEN user_id END::BIGINT AS items FROM events""")
def collection_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that start; those that end get their end, status and count."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp_ntz").alias("started_at"), "event_type",
        F.col("user_id").cast("bigint").alias("items")
    )
    none = spark.createDataFrame([], "run_id bigint, started_at timestamp_ntz, finished_at timestamp_ntz, status string, items bigint")
    ended = e.where("event_type in ('view', 'click')").select(
        "run_id", F.col("started_at").alias("finished_at"), F.when(F.col("event_type") == "view", "ok").otherwise("failed").alias("status"), "items"
    )
    return briefing.runs_with(none, e.select("run_id", "started_at"), ended)


@query("K10", "SELECT DISTINCT l_partkey AS key FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def deferred_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys seen by runs are kept only if their run ended well."""
    pending = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("key"))
    done = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status")
    )
    return briefing.deferred(pending, done)


@query(
    "J24",
    f"WITH {ITEMS}, l AS (SELECT title FROM i WHERE id % 10 = 0 ORDER BY collected_at DESC, title LIMIT 150) SELECT id FROM i WHERE id % 10 <> 0 AND title IN (SELECT title FROM l)"
)
def recurring_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The injected model says that an item repeats a line with its title."""
    i = items(spark, sf_dir)
    rendered = i.where("id % 10 = 0").select("title", F.col("collected_at").alias("rendered_at"))
    model = lambda df: df.where(F.array_contains("lines", F.col("title"))).select("id")
    return briefing.recurring_stories(i.where("id % 10 <> 0"), rendered, model)


@query("C11, F17", f"""WITH {ITEMS}, d AS (SELECT source_name AS section, max(title) AS text, count(*) AS strength FROM i GROUP BY 1),
 w AS (SELECT section FROM d ORDER BY strength, section LIMIT 1),
p AS (SELECT d.section, CASE WHEN w.section IS NOT NULL THEN upper(text) ELSE text END AS text, strength FROM d LEFT JOIN w USING (section))
 SELECT section, md5(text) AS digest, strength FROM p WHERE len(text) % 5 <> 0 AND strength > 3""")
def digest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three injected models: sections per source, capitals for the weakest, a check by length."""
    draft = lambda df: df.groupBy(F.col("source_name").alias("section")).agg(
        F.max("title").alias("text"), F.count("*").alias("strength")
    )
    patch = lambda df: df.withColumn("text", capitals(F.col("text")))
    check = lambda df: df.withColumn("contradicted", F.when(F.length("text") % 5 == 0, 1).otherwise(0)).withColumn(
        "confidence", F.when(F.col("strength") > 3, "high").otherwise("low")
    )
    return briefing.digest(items(spark, sf_dir), draft, patch, check).select(
        "section", F.md5(F.col("text").cast("binary")).alias("digest"), "strength"
    )


@query("C12, P47",
 f"""WITH {_HEALTH_SQL} SELECT name, CASE WHEN consecutive_failures >= 20 THEN 'disable' ELSE 'retry' END AS action FROM h
 WHERE consecutive_failures >= 10 AND substr(name, 2)::BIGINT % 5 <> 0""")
def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _health(spark, sf_dir)[0]
    number = F.substring("name", 2, 20).cast("bigint")
    off = F.when(number % 5 == 0, False).when(number % 2 == 0, True)  # others have no mark
    sources = h.select("name", F.concat(F.lit("https://"), "name", F.lit(".example/feed")).alias("url"), off.alias("enabled"))
    return briefing.repair_plan(sources, h, display.candidate_urls(F.col("url"))).select("name", "action")


_REPORTS = f"""{EVIDENCE}, r AS (SELECT event_id, pos, source_name, source_tier, CASE WHEN source_tier = 1 THEN 'paper' WHEN has_body THEN 'news' ELSE '' END AS source_type, [CASE WHEN has_analysis THEN 'Product Launch' ELSE 'misc' END, CASE importance WHEN 1 THEN 'AI policy' WHEN 2 THEN 'fundraising' ELSE 'x' END] AS categories FROM e)"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir)
    kind = F.when(F.col("source_tier") == 1, "paper").when(F.col("has_body"), "news").otherwise("")
    cats = F.array(
        F.when(F.col("has_analysis"), "Product Launch").otherwise("misc"),
        F.when(F.col("importance") == 1, "AI policy").when(F.col("importance") == 2, "fundraising").otherwise("x")
    )
    return e.select("event_id", "pos", "source_name", "source_tier", kind.alias("source_type"), cats.alias("categories"))


@query("P35", f"""WITH {_REPORTS}, v AS (SELECT event_id, source_type AS vote, 1 AS w, pos, -1 AS i FROM r WHERE source_type <> ''
 UNION ALL SELECT event_id, 'product_launch', 2, pos, 0 FROM r WHERE categories[1] = 'Product Launch' UNION ALL SELECT event_id,
 'regulation', 2, pos, 1 FROM r WHERE categories[2] = 'AI policy' UNION ALL SELECT event_id, 'funding', 2, pos, 1 FROM r
 WHERE categories[2] = 'fundraising'),
 g AS (SELECT event_id, vote, sum(w) AS n, min((pos, i)) AS first_at FROM v GROUP BY 1, 2), k AS (SELECT event_id, vote, row_number()
 OVER (PARTITION BY event_id ORDER BY n DESC, first_at) AS place FROM g)
SELECT e.event_id, coalesce(k.vote, 'news') AS event_type FROM (SELECT DISTINCT event_id FROM r) e LEFT JOIN k ON k.event_id = e.event_id
 AND place = 1""")
def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefing.event_type(_reports(spark, sf_dir))


@query("P36",
 f"""WITH {EVIDENCE}, g AS (SELECT event_id, count(DISTINCT source_name) AS n, min(source_tier) AS best FROM e GROUP BY 1) SELECT event_id, CASE WHEN best = 0 THEN 'official' WHEN n >= 3 AND best <= 1 THEN 'confirmed' ELSE 'reported' END AS status FROM g""")
def initial_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefing.initial_status(evidence(spark, sf_dir))


@query("A24, P41", f"""WITH {EVIDENCE}, k AS (SELECT event_id, article_id, count(*) OVER (PARTITION BY event_id) AS size, row_number()
 OVER (PARTITION BY event_id ORDER BY (CASE source_tier WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END * 3 + CASE
 WHEN has_body THEN 2 ELSE 0 END + least(title_len, 100) / 100) DESC, pos) AS n FROM e)
SELECT event_id AS cluster, article_id AS id, size FROM k WHERE n = 1""")
def pick_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir)
    members = e.select(
        F.col("event_id").alias("cluster"), F.col("article_id").alias("id"), "pos", "source_tier",
        F.when(F.col("has_body"), "body").otherwise("").alias("full_text"),
        F.repeat(F.lit("t"), F.least("title_len", F.lit(120)).cast("int")).alias("title")
    )
    return briefing.pick_best(members, F.when(F.col("source_tier") == 0, 4).when(F.col("source_tier") == 1, 3).otherwise(2))


@query(
    "A07",
    f"WITH {EVIDENCE} SELECT event_id, o_orderpriority AS priority, count(*) AS reports FROM e JOIN orders ON o_orderkey = event_id GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY reports DESC, event_id LIMIT 10"
)
def largest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten events with most reports; only they meet the event table."""
    n = evidence(spark, sf_dir).groupBy("event_id").agg(F.count("*").alias("reports")).where("reports >= 2")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("priority"))
    return n.join(o, "event_id").orderBy(F.desc("reports"), "event_id").limit(10)


@query(
    "F19",
    f"SELECT o_orderkey AS event_id FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' - INTERVAL 96 HOUR AND o_orderdate < TIMESTAMP '1997-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 150"
)
def rendered_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was rendered in the four days before a shift, latest first, 150 at most."""
    at = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("rendered_at"))
    recent = filters.shift_window(o.withColumnRenamed("rendered_at", "published"), at - F.expr("interval 96 hours"), at)
    return recent.orderBy(F.desc("published"), "event_id").limit(150).select("event_id")
