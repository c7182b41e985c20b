"""Queries of feeds and services, of state transitions, and of the remaining display and report steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import display, scores, text
from newsloom.operators import analysis, filters, health, ranking, store
from newsloom.plans.registry import query
from newsloom.plans.views import ARTICLES, AS_OF, EVIDENCE, articles, evidence
from newsloom.sources import apis, feeds
from newsloom.sources.tables import table


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("S01, S02, S03, S04, S10, P12",
 """SELECT page_id, 0 AS pos, 'Page ' || page_id || ' & more' AS title, url AS link, TIMESTAMP '2026-01-05 10:00:00' AS published, 'http://img/' || page_id || '.png' AS image, 'http' AS kind FROM pages""")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a feed of one item, with a bare ampersand in its address and an enclosure."""
    escaped = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    xml = F.concat(
        F.lit("<rss version='2.0'><channel><item><title>Page "), "page_id", F.lit(" &amp; more</title><link>"), escaped,
        F.lit("</link><pubDate>Mon, 05 Jan 2026 10:00:00 +0000</pubDate><enclosure url='http://img/"), "page_id",
        F.lit(".png'/></item></channel></rss>")
    )
    raw = table(spark, sf_dir, "pages").select("page_id", feeds.kind(F.col("url")).alias("kind"), xml.alias("xml"))
    return feeds.items(raw).select("page_id", "pos", "title", "link", F.col("published").cast("timestamp_ntz").alias("published"), "image", "kind")


@query("S05", f"""WITH {ARTICLES}, i AS (SELECT source_name, id AS pos, CASE WHEN lang = 'es' THEN NULL ELSE collected_at END AS published FROM a),
k AS (SELECT *, published IS NULL AS un, sum((published IS NULL)::INT) OVER (PARTITION BY source_name ORDER BY pos ROWS UNBOUNDED PRECEDING)
 AS nu, row_number() OVER (PARTITION BY source_name ORDER BY pos) AS n FROM i),
o AS (SELECT *, coalesce(published >= TIMESTAMP '{AS_OF}' - INTERVAL 16 HOUR, FALSE) OR (un AND nu <= 3) AS ok FROM k), m AS (SELECT *,
 bool_or(ok) OVER (PARTITION BY source_name) AS has_some FROM o),
r AS (SELECT source_name, pos, row_number() OVER (PARTITION BY source_name ORDER BY pos) AS place FROM m WHERE ok OR (NOT has_some
 AND n <= 3)) SELECT source_name, pos FROM r WHERE place <= 10""")
def feed_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recent items of each feed, ten at most: the size of a poll."""
    i = articles(spark, sf_dir).select(
        "source_name", F.col("id").alias("pos"), F.when(F.col("lang") == "es", F.lit(None)).otherwise(F.col("collected_at")).alias("published")
    )
    return feeds.recent(i, now(), 16, 10).select("source_name", "pos")


@query("S14", f"""WITH {ARTICLES}, r AS (SELECT id, source_name, collected_at, row_number() OVER (PARTITION BY source_name
 ORDER BY collected_at DESC, id) AS n FROM a WHERE lang IS DISTINCT FROM 'es'),
f AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY collected_at DESC, id) AS k FROM r WHERE n <= 25
 AND collected_at >= TIMESTAMP '2024-01-01 12:00:00' - INTERVAL 6 HOUR) SELECT source_name, id AS pos FROM f WHERE k <= 5""")
def official_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.coalesce("lang", F.lit("")) != "es", F.col("collected_at"))
    i = articles(spark, sf_dir).select("source_name", F.col("id").alias("pos"), at.alias("published"))
    return feeds.official_recent(i, F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).select("source_name", "pos")


_SUBJECT = "(tion|keit|mente)"


@query("S12, S13, S15, S16, S17, U01", f"""WITH {ARTICLES}, s AS (SELECT id, title, source_name AS url, len(summary) AS n, collected_at
 FROM a WHERE title IS NOT NULL AND source_name IS NOT NULL),
g AS (SELECT title, max(struct_pack(a := n * 100, b := id, c := url)) AS x FROM s GROUP BY title),
u AS (SELECT 'hn' AS source, title, url, (n + floor((id % 50) / 2))::INT AS signal_score, 30 AS most FROM s WHERE n >= 50
 AND regexp_matches(title, '{_SUBJECT}') AND collected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 36 HOUR
UNION ALL SELECT 'reddit', min_by(title, id), url, 100, 50 FROM s GROUP BY url UNION ALL SELECT 'hf', title, url, (n * 10 + CASE
 WHEN id % 2 = 0 THEN floor(id * 100 / 1000) ELSE 0 END)::INT, 50 FROM s WHERE n >= 5
UNION ALL SELECT 'github', title, x.c, (floor(x.a / 100) * 10 + floor(x.b / 50))::INT, 50 FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY signal_score DESC, title, url) AS k FROM u) SELECT source, title, url,
 signal_score FROM r WHERE k <= most""")
def hot_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = articles(spark, sf_dir).where("title is not null and source_name is not null").select(
        "id", "title", F.col("source_name").alias("url"), F.length("summary").alias("n"), "collected_at"
    )
    hn = s.select(
        "title", "url", F.col("n").alias("points"), (F.col("id") % 50).cast("int").alias("comments"), F.col("collected_at").alias("created_at")
    )
    hub = s.select(
        "title", "url", F.col("n").alias("likes"), (F.col("id") * 100).alias("downloads"),
        F.when(F.col("id") % 2 == 0, "model").otherwise("space").alias("kind")
    )
    github = s.select("title", "url", (F.col("n") * 100).alias("stars"), F.col("id").alias("forks"))
    out = feeds.signals(hn, s.select("title", "url", F.col("id").alias("pos")), hub, github, now(), _SUBJECT)
    return out.select("source", "title", "url", F.col("signal_score").cast("int").alias("signal_score"))


@query("S06, S10",
 """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://www.youtube.com/watch?v=p' || page_id ELSE 'https://www.youtube.com/watch?v=a' || page_id END AS link, CASE WHEN page_id % 3 = 0 THEN 'Page & ' || page_id ELSE 'Atom ' || page_id END AS title FROM pages""")
def video_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels by their Atom feed; the page's initial data is read for those whose feed holds nothing."""
    n = F.col("page_id")
    p = table(spark, sf_dir, "pages").select(n.cast("string").alias("source_name"), n)
    atom = F.when(n % 3 == 0, F.lit("<feed></feed>")).otherwise(
        F.concat(
            F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>Atom "), n, F.lit("</title><link href='https://www.youtube.com/watch?v=a"),
            n, F.lit("'/><published>2026-01-05T10:00:00+00:00</published></entry></feed>")
        )
    )
    page = F.concat(
        F.lit('<script>var ytInitialData = {"contents": [{"richItemRenderer": {"content": {"videoRenderer": {"videoId": "p'), n,
        F.lit('", "title": {"runs": [{"text": "Page & "}, {"text": "'), n, F.lit('"}]}}}}}]};</script>')
    )
    first = feeds.items(p.select("source_name", atom.alias("xml"))).select("source_name", "pos", "title", "link", "summary")
    found = apis.with_fallback(first, apis.channel_page_items(p.select("source_name", page.alias("html"))), "source_name")
    return found.select(F.col("source_name").cast("bigint").alias("page_id"), "link", "title")


@query("S07, S08, S09, P27",
 """SELECT doc_id, 'https://www.zhihu.com/question/' || doc_id AS question, 'https://x.com/' || source || '/status/' || doc_id AS post, lang AS note FROM documents""")
def service_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service JSON made of each document, read back as items of a question, post and note service."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_name"), "doc_id", "source", "lang")
    question = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("doc_id").alias("id"), F.lit("t").alias("title")).alias("target"))).alias("data")))
    note = F.when(
        F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.struct(F.col("lang").alias("title")).alias("note")))
    ).otherwise(F.to_json(F.struct(F.col("lang").alias("desc"))))
    q = apis.hot_questions(d.withColumn("json", question)).select("source_name", F.col("link").alias("question"))
    rest = d.select(
        "source_name", "doc_id",
        apis.original_post(F.concat(F.lit("https://mirror.example/"), "source", F.lit("/status/"), "doc_id", F.lit("#m"))).alias("post"),
        apis.first_of(note, ["$.note.title", "$.title", "$.desc"]).alias("note")
    )
    return rest.join(q, "source_name").select("doc_id", "question", "post", "note")


@query("S11",
 """SELECT 'p' || doc_id AS id, max(n_chars)::INT AS upvotes FROM documents WHERE doc_id * 2 <= 24 * 7 GROUP BY doc_id ORDER BY upvotes DESC, id LIMIT 10""")
def daily_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most upvoted papers of a week; each stands on two daily lists."""
    at = F.lit("2026-01-31 00:00:00").cast("timestamp")
    d = table(spark, sf_dir, "documents")
    stamp = F.date_format(at - F.make_dt_interval(F.lit(0), (F.col("doc_id") * 2).cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    paper = lambda up: F.struct(
        F.struct(
            F.concat(F.lit("p"), "doc_id").alias("id"), F.lit("t").alias("title"), F.lit("s").alias("summary"), up.cast("int").alias("upvotes"),
            stamp.alias("publishedAt")
        ).alias("paper")
    )
    days = d.select(F.to_json(F.array(paper(F.col("n_chars")), paper(F.lit(0)))).alias("json"))
    return apis.daily_papers(days, at).select("id", "upvotes")


@query("K02",
 """SELECT d.doc_id AS id, CASE WHEN l.quality IS NOT NULL THEN 'analyzed' ELSE 'collected' END AS status, coalesce(CASE WHEN l.quality = 1 THEN 4 WHEN l.quality = 0 THEN 2 END, 0)::INT AS importance FROM documents d LEFT JOIN labels l USING (doc_id)""")
def save_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("collected").alias("status"), F.lit(0).alias("importance"))
    new = table(spark, sf_dir, "labels").where("quality is not null").select(
        F.col("doc_id").alias("id"), F.lit("analyzed").alias("status"), F.when(F.col("quality") == 1, 4).otherwise(2).alias("importance")
    )
    return store.partial_update(old, new, "id", ["status", "importance"])


@query("K17, F12", f"""WITH {EVIDENCE}, few AS (SELECT event_id FROM e GROUP BY 1 HAVING count(DISTINCT source_name) < 2)
SELECT event_id, article_id, source_tier FROM e WHERE event_id IN (SELECT event_id FROM few)""")
def recluster_detached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports whose event lost its second source: unlinked again, by tier and time."""
    e = evidence(spark, sf_dir)
    kept = e.groupBy("event_id").agg(F.count_distinct("source_name").alias("n")).where("n >= 2")
    return e.join(kept, "event_id", "left_anti").orderBy(
        "source_tier", F.desc("reported_at"), "article_id"
    ).select("event_id", "article_id", "source_tier")


@query("F06",
 """SELECT doc_id AS id FROM documents WHERE len(text) >= 20 AND CASE WHEN doc_id % 2 = 0 THEN lang = 'en' AND len(source) >= 4 AND len(text) >= 10 ELSE len(text) >= 100 OR len(lang) > 0 END""")
def substantial_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("summary"), (F.col("doc_id") % 2).cast("int").alias("level"),
        F.when(
            F.col("lang") == "en", F.array("text", F.concat("source", "source", "source"))
        ).otherwise(F.array("text")).alias("key_details"), F.col("lang").alias("background"), F.lit("").alias("deep_analysis"), F.col("text").alias("detailed_content"))
    return filters.substantial(d).select("id")


@query("F20, W07", """WITH h AS (SELECT user_id AS name, count(*) FILTER (event_type = 'error') AS f, count(*)
 FILTER (event_type <> 'error') AS good, max(ts) AS last_at FROM events GROUP BY 1)
SELECT name FROM h WHERE f >= 10 AND NOT (good > 0 AND last_at <= TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 24 HOUR)""")
def health_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("name")).agg(
        F.count_if(F.col("event_type") == "error").alias("consecutive_failures"), F.count_if(F.col("event_type") != "error").alias("total_successes"),
        F.max("ts").alias("updated_at")
    )
    return health.skipped(e, F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")).select("name")


@query("P02, P03", """SELECT doc_id, md5(replace(replace(text, 'ation', 'ing'), 'tion', 'ing')) AS folded,
 len(regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}]')) > 0.3 * len(text) AS cjk,
 md5(lang || ' ' || lang || ' ' || lang || ' ' || split_part(text, chr(10), 1)) AS cluster_text FROM documents""")
def text_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    folded = text.fold_synonyms(t, [["ing", "tion", "ation"]])
    cluster = F.concat_ws(" ", "lang", "lang", "lang", F.split_part("text", F.lit("\n"), F.lit(1)))
    return d.select(
        "doc_id", F.md5(folded.cast("binary")).alias("folded"), text.mostly_cjk(t).alias("cjk"), F.md5(cluster.cast("binary")).alias("cluster_text")
    )


@query("P08", """WITH l AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'),
 lambda t: len(t) > 1)) AS t FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.t AS x, b.t AS y FROM l a JOIN l b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(x || y)) = 0 THEN 0.0 ELSE len(list_intersect(x,
 y))::DOUBLE / len(list_distinct(x || y)) END, 6) AS similarity FROM p""")
def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of each turn's words and the next turn's."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("t"))
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return c.join(following, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.jaccard(F.col("t"), F.col("u")), 6).alias("similarity"))


@query("P13",
 """SELECT event_id, (event_id % 60)::DOUBLE * CASE event_type WHEN 'view' THEN 24.0 WHEN 'click' THEN 168.0 WHEN 'error' THEN 720.0 ELSE 1.0 END AS hours FROM events""")
def relative_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("event_type") == "view", " days ago").when(F.col("event_type") == "click", "w ago").when(
        F.col("event_type") == "error", " months ago"
    ).otherwise(" hours ago")
    return table(spark, sf_dir, "events").select(
        "event_id", text.relative_age_hours(F.concat((F.col("event_id") % 60).cast("string"), unit)).alias("hours")
    )


@query("P27", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON within a fence and prose."""
    said = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(display.first_json_object(said), "k bigint")["k"].alias("k"))


@query("P33",
 """SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%m-%d %H:%M') AS local, event_type || ':' || user_id AS sig, CASE WHEN hour(ts) >= 12 THEN 'pm' ELSE 'am' END AS shift FROM events""")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = F.date_format(F.col("ts") + F.expr("interval 8 hours"), "MM-dd HH:mm")
    return table(spark, sf_dir, "events").select(
        "event_id", local.alias("local"), F.concat_ws(":", "event_type", "user_id").alias("sig"),
        F.when(F.hour("ts") >= 12, "pm").otherwise("am").alias("shift")
    )


@query("P42", """WITH v AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN event_id END) AS hn, bool_or(event_type = 'click'
 AND value > 100) AS reddit, max(CASE WHEN event_type = 'error' THEN event_id END) AS hf, max(CASE
 WHEN event_type = 'purchase' THEN event_id * 10 END) AS github FROM events GROUP BY 1),
t AS (SELECT *, greatest(CASE WHEN hn >= 1000 THEN 5 WHEN hn >= 500 THEN 4 WHEN hn >= 200 THEN 3 ELSE 0 END, CASE
 WHEN reddit THEN 3 ELSE 0 END, CASE WHEN hf >= 2000 THEN 4 WHEN hf >= 500 THEN 3 ELSE 0 END, CASE WHEN github >= 50000 THEN 4
 WHEN github >= 5000 THEN 3 ELSE 0 END) AS top,
 (hn IS NOT NULL)::INT + coalesce(reddit, FALSE)::INT + (hf IS NOT NULL)::INT + (github IS NOT NULL)::INT AS seen FROM v) SELECT user_id,
 least(5, top + CASE WHEN seen >= 2 AND top > 0 THEN 1 ELSE 0 END)::INT AS boost FROM t""")
def signal_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    v = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max(F.when(kind == "view", F.col("event_id"))).alias("hn"), F.bool_or((kind == "click") & (F.col("value") > 100)).alias("reddit"),
        F.max(F.when(kind == "error", F.col("event_id"))).alias("hf"), F.max(F.when(kind == "purchase", F.col("event_id") * 10)).alias("github")
    )
    return v.select("user_id", scores.signal_boost(F.col("hn"), F.col("reddit"), F.col("hf"), F.col("github")).alias("boost"))


@query("A25, U04",
 f"""WITH {EVIDENCE} SELECT event_id, count(*) AS size, max(importance) AS importance, string_agg(DISTINCT source_name, ',' ORDER BY source_name) AS tags FROM e GROUP BY 1""")
def cluster_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's size, largest importance and the union of its reports' tags."""
    from newsloom.operators.events import rolled_up

    tagged = evidence(spark, sf_dir).select("event_id", "importance", F.array("source_name").alias("entities"))
    return rolled_up(tagged).select("event_id", "size", "importance", F.array_join("entities", ",").alias("tags"))


@query("A15",
 """SELECT CASE o_orderstatus WHEN 'F' THEN 'official' WHEN 'O' THEN 'reported' ELSE 'rumor' END AS status, count(*) AS events FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1""")
def rendered_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered events by status."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return o.groupBy(
        F.when(F.col("o_orderstatus") == "F", "official").when(F.col("o_orderstatus") == "O", "reported").otherwise("rumor").alias("status")
    ).agg(F.count("*").alias("events"))


_PAGE_ITEMS = f"""{ARTICLES}, pi AS (SELECT *, CASE WHEN id % 3 = 0 THEN NULL ELSE importance - 1 END AS marked FROM a)"""


@query("A27", f"""WITH {_PAGE_ITEMS} SELECT source_name, count(*) AS n, round(avg(CASE WHEN marked > 0 THEN marked END), 6) AS mean_importance,
 string_agg(DISTINCT lang, ',' ORDER BY lang) AS audiences, count(DISTINCT tier) AS categories FROM pi GROUP BY 1""")
def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: items, mean importance of those that have one (some have none, some 0), distinct audiences and categories."""
    marked = F.when(F.col("id") % 3 != 0, F.col("importance") - 1)
    stats = ranking.page_stats(articles(spark, sf_dir).withColumn("importance", marked), "lang", "tier")
    return stats.select(
        "source_name", "n", F.round("mean_importance", 6).alias("mean_importance"), F.nullif(F.array_join("audiences", ","), F.lit("")).alias("audiences"), "categories"
    )


@query("U02",
 """SELECT doc_id, array_to_string(list_distinct_ordered, ',') AS names FROM (SELECT doc_id, CASE WHEN source = lang THEN [source, 'x'] WHEN source = 'x' THEN [source, lang] WHEN lang = 'x' THEN [source, lang] ELSE [source, lang, 'x'] END AS list_distinct_ordered FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)""")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names once each, in the order in which they are given first."""
    d = table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    return d.select(
        "doc_id",
        F.array_join(F.array_distinct(F.array(F.col("source"), F.col("lang"), F.col("source"), F.lit("x"), F.col("lang"))), ",").alias("names")
    )


@query("J20",
 """WITH w AS (SELECT conv_id, list(text ORDER BY turn) AS items FROM conversations GROUP BY 1) SELECT conv_id, i::INT AS i, md5(items[i + 1]) AS item FROM (SELECT conv_id, items, unnest([0, 2]) AS i FROM w) WHERE i < len(items)""")
def evidence_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a judgment names by their position."""
    items = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("items"))
    named = items.select("conv_id", "items", F.explode(F.array(F.lit(0), F.lit(2))).alias("i")).where(F.col("i") < F.size("items"))
    return named.select("conv_id", "i", F.md5(F.get("items", F.col("i"))["text"].cast("binary")).alias("item"))


@query("T01",
 f"""WITH {ARTICLES}, r AS (SELECT id, row_number() OVER (ORDER BY CASE WHEN lang = 'es' THEN NULL ELSE collected_at END DESC NULLS LAST, id) AS place FROM a) SELECT id, place::BIGINT AS place FROM r""")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each item by date, undated items last; a range sort with offsets, so no task sees all."""
    from newsloom.operators.ranking import placed

    at = F.when(F.coalesce("lang", F.lit("")) != "es", F.col("collected_at"))
    return placed(
        articles(spark, sf_dir).select("id", at.alias("published")), [F.col("published").desc_nulls_last(), F.col("id").asc()]
    ).select("id", "place")


@query("T14",
 """WITH v AS (SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders) SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM v ORDER BY o_orderdate DESC, o_orderpriority DESC, o_orderkey LIMIT 14""")
def recent_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourteen latest rows of the scorecard."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderpriority"), "o_orderkey").limit(14).select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )


@query("F16",
 """SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 22 HOUR AND ts <= TIMESTAMP '2024-01-30' AND NOT (ts::DATE = DATE '2024-01-30' AND hour(ts) < 12) AND len(props) > 0""")
def shift_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier shift left that is not this shift's own, not older than 22 hours and not empty."""
    at = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    own = (F.to_date("ts") == F.lit("2024-01-30").cast("date")) & (F.hour("ts") < 12)
    return table(spark, sf_dir, "events").where(
        (F.col("ts") >= at - F.expr("interval 22 hours")) & (F.col("ts") <= at) & ~own & (F.length("props") > 0)
    ).select("event_id")


@query("C04", """SELECT page_id AS id, CASE WHEN len(html) > 3000 THEN 'cache' ELSE 'rules' END AS level FROM pages""")
def tiered_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for every page, the cache where it has a good entry, no analyser."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("page_id").cast("string").alias("url_key"), "html")
    cache = p.select(
        "url_key", F.col("html").alias("content"), F.lit(True).alias("relevant"), now().alias("created_at")
    ).where(F.length("content") > 3000)
    rules = lambda df: df.select("id", "url_key", F.lit("rule").alias("content"), F.lit(True).alias("relevant"))
    return analysis.tiered(p, rules, cache, None, now()).select("id", "level")


_KINDS = ("youtube", "zhihu", "twitter", "xhs", "wewe-rss", "hf-papers", "wechat", "http")


@query("S01, S02, S06, S07, S08, S09, S10, S11", f"""WITH p AS (SELECT doc_id, ([{", ".join(map(repr, _KINDS))}])[(doc_id % 8 + 1)::INT] AS kind,
 coalesce(source, 'none') AS source_name, TIMESTAMP '2024-01-01' + to_hours((doc_id % 720)::INT) AS seen FROM documents)
SELECT kind, source_name, 'Item ' || doc_id AS title, CASE kind WHEN 'youtube' THEN 'https://www.youtube.com/watch?v=' WHEN 'zhihu'
 THEN 'https://www.zhihu.com/question/' WHEN 'twitter' THEN 'https://x.com/status/' WHEN 'xhs' THEN 'https://www.xiaohongshu.com/explore/'
 WHEN 'hf-papers' THEN 'https://huggingface.co/papers/' ELSE 'https://feed.example/' END || doc_id AS link,
 CASE WHEN kind NOT IN ('zhihu', 'xhs') THEN seen END AS published FROM p
 WHERE source_name <> 'src3' AND (kind <> 'http' OR seen >= TIMESTAMP '2024-01-20')""")
def plugin_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a payload of one of eight services, stored by kind and read back through the kind's own format.

    Items of the plain feeds are read from a date on, and one source is left out.
    """
    import uuid

    from newsloom.sources import plugins
    from newsloom.sources.tables import shared_dir

    n, at = F.col("doc_id").cast("string"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 720 * 3600)
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    title = F.concat(F.lit("Item "), n)
    rss = lambda link: F.concat(
        F.lit("<rss><channel><item><title>Item "), n, F.lit("</title><link>"), link, F.lit("</link><pubDate>"), iso, F.lit("</pubDate></item></channel></rss>")
    )
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 8).cast("int"))
    payload = F.when(
        F.col("kind") == "youtube", F.to_json(F.struct(F.array(F.struct(n.alias("videoId"), title.alias("title"), iso.alias("published"))).alias("videos")))
    ).when(
        F.col("kind") == "zhihu", F.to_json(F.struct(F.array(F.struct(F.struct(n.alias("id"), title.alias("title")).alias("target"))).alias("data")))
    ).when(F.col("kind") == "twitter", rss(F.concat(F.lit("https://mirror.example/status/"), n, F.lit("#m")))).when(
        F.col("kind") == "xhs", F.to_json(F.struct(F.array(F.struct(n.alias("id"), F.struct(title.alias("title")).alias("note"))).alias("notes")))
    ).when(
        F.col("kind") == "hf-papers", F.to_json(F.array(F.struct(F.struct(n.alias("id"), title.alias("title"), iso.alias("publishedAt")).alias("paper"))))
    ).otherwise(rss(F.concat(F.lit("https://feed.example/"), n)))
    raw = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.coalesce("source", F.lit("none")).alias("source_name"))
    folder = f"{shared_dir(spark)}/payloads-{uuid.uuid4().hex}"
    plugins.store(raw.select("kind", "source_name", F.lit("").alias("url"), at.alias("fetched_at"), payload.alias("payload")), folder)
    plugins.register(spark)
    found = plugins.read(spark, folder).where("source_name <> 'src3'")
    items = found.where((F.col("kind") != "http") | (F.col("published") >= F.lit("2024-01-20 00:00:00+00:00").cast("timestamp")))
    items = items.select("kind", "source_name", "title", "link", "published")
    return items.withColumn("published", F.to_utc_timestamp("published", F.current_timezone()).cast("timestamp_ntz"))
