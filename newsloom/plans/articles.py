"""Queries of article text and pictures, texts of models, labels and times of signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import articles as parts
from newsloom.functions import display, text
from newsloom.plans.registry import query
from newsloom.plans.views import ARTICLES, AS_OF, articles
from newsloom.sources.tables import spread, table


def _strip(t: str) -> str:
    """SQL of strip_html()."""
    t = f"regexp_replace({t}, '<[^>]*>', ' ', 'g')"
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        t = f"replace({t}, '{name}', '{char}')"
    return f"trim(regexp_replace(regexp_replace({t}, '&#x?[0-9A-Fa-f]+;', '', 'g'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'), ' ')"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of five kinds, so that each place of the text is the longest somewhere."""
    n, html = F.col("page_id") % 5, F.col("html")
    swap = lambda a, b: F.replace(F.replace(html, F.lit("<article"), F.lit(a)), F.lit("</article>"), F.lit(b))
    data = F.concat(
        F.lit('<script type="application/ld+json">{"articleBody": "'), F.repeat(F.lit("said &amp; done "), F.lit(9)), "page_id",
        F.lit('"}</script><p>short</p>')
    )
    meta = F.concat(
        F.lit('<head><meta name="description" content="'), F.repeat(F.lit("meta text "), F.lit(8)), "page_id", F.lit('"></head><body>x</body>')
    )
    h = F.when(
        n == 1, swap('<div class="x post-content y"', "</div>")
    ).when(n == 2, data).when(n == 3, meta).when(n == 4, swap("<i", " Advertisement. </i>")).otherwise(html)
    return table(spark, sf_dir, "pages").select("page_id", "url", h.alias("html"))


@query("P14", rf"""WITH x AS (SELECT page_id, page_id % 5 AS kind, split_part(split_part(html, '<article>', 2), '</article>', 1) AS inside,
 list_filter(list_transform(string_split(html, '</p>')[1:-2], lambda x: CASE WHEN contains(x, '<p>') THEN substr(x, strpos(x, '<p>') + 3) END), lambda x: x IS NOT NULL) AS ps
 FROM pages), y AS (SELECT page_id, kind, {_strip("inside")} AS inside, list_filter(list_transform(ps, lambda x: struct_pack(t := {_strip("x")},
 n := len(x) - len(replace(x, '<', '')))), lambda x: len(x.t) > 40 AND x.n < 0.1 * len(x.t))[1:20] AS ps FROM x),
z AS (SELECT page_id, kind, CASE WHEN kind = 4 OR len(inside) <= 100 THEN '' ELSE inside END AS inside,
 array_to_string(list_transform(ps, lambda x: x.t), '。') AS ps FROM y),
o AS (SELECT page_id, substr(CASE kind WHEN 2 THEN repeat('said & done ', 9) || page_id WHEN 3 THEN repeat('meta text ', 8) || page_id
 ELSE CASE WHEN len(ps) > greatest(len(inside), 100) THEN ps ELSE inside END END, 1, 4000) AS t FROM z)
SELECT page_id, len(t)::BIGINT AS chars, md5(t) AS digest FROM o""")
def article_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).select("page_id", parts.body(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").cast("bigint").alias("chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("P15",
 r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://cdn.x/cover' || page_id || '.png ' ELSE '' END || 'https://img.y/a.jpg?b=1&c=2' || CASE WHEN contains(url, '/ads-') THEN '' ELSE ' ' || regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/p/' || page_id || '.webp' END || CASE page_id % 4 WHEN 0 THEN ' https://d.z/' || page_id || '.gif' WHEN 1 THEN ' https://d.z/one.gif' ELSE '' END AS pictures FROM pages""")
def article_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a cover, pictures that are given in several ways, icons, and a data block."""
    n, at = F.col("page_id"), F.col("page_id").cast("string")
    cover = F.when(n % 3 == 0, F.concat(F.lit('<meta property="og:image" content="//cdn.x/cover'), at, F.lit('.png">'))).otherwise("")
    inside = F.concat(
        F.lit('</h1><img src="https://x/logo.png"><img alt="" data-src="https://img.y/a.jpg?b=1&amp;c=2"><img src=\'/p/'), at,
        F.lit(".webp'><img src=\"https://img.y/a.jpg?b=1&amp;c=2\">")
    )
    data = F.when(
        n % 4 == 0, F.concat(F.lit('<script type="application/ld+json">{"image": {"url": "https://d.z/'), at, F.lit('.gif"}}</script>'))
    ).when(
        n % 4 == 1, F.lit('<script type="application/ld+json">[{"image": ["https://d.z/one.gif", "https://d.z/icon/2.gif"]}]</script>')
    ).otherwise("")
    html = F.concat(cover, F.replace("html", F.lit("</h1>"), inside), data)
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(parts.pictures(html, F.col("url")), " ").alias("pictures"))


_README = "# Title **{}**\n![badge](http://x/y.svg) <br/>\n```sh\nmake all\n```\na [link](http://x)\n> "


def _readme_sql() -> str:
    head, tail = (part.replace("\n", "' || chr(10) || '") for part in _README.split("{}"))
    t = f"'{head}' || lang || '{tail}' || text"
    for pattern, by in display.README:
        t = f"regexp_replace({t}, '{pattern}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    return f"SELECT doc_id, md5(substr(trim({t}, ' '), 1, 2000)) AS digest FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL"


@query("P16", _readme_sql())
def readme_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dressed as a readme lose its marks again, and their own."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    dressed = F.concat(*(x for part in zip(map(F.lit, _README.split("{}")), (F.col("lang"), F.col("text")), strict=True) for x in part))
    return d.select("doc_id", F.md5(display.plain_readme(dressed).cast("binary")).alias("digest"))


@query("P25",
 r"""WITH h AS (SELECT doc_id, text, substr(text, 1, 197) AS h FROM documents WHERE text IS NOT NULL), e AS (SELECT *, regexp_extract(h, '(?s)^(.*[.!?。！？])', 1) AS e FROM h) SELECT doc_id, md5(CASE WHEN len(text) <= 200 THEN text WHEN len(e) > 0 THEN e || '...' ELSE h || '...' END) AS digest FROM e""")
def cut_at_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select(
        "doc_id", F.md5(text.truncate_at_sentence(F.col("text"), 200, "...").cast("binary")).alias("digest")
    )


@query("P26",
 """SELECT event_id, 's' || event_id || chr(10) || chr(9) || 'x' AS summary, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_id END AS n FROM events""")
def broken_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model in a fence, with raw line ends within strings, after prose, and broken off within a value."""
    n = F.col("event_id")
    said = F.concat(F.lit('{"summary": "s'), n, F.lit('\n\tx", "n": '), n)
    whole = F.concat(said, F.lit("}"))
    form = F.when(
        n % 4 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))
    ).when(
        n % 4 == 1, F.concat(F.lit("Sure: "), whole, F.lit(" Done."))
    ).when(n % 4 == 2, F.concat(said, F.lit(', "tags": ["a", "b'))).otherwise(F.concat(F.lit('{"summary": "s'), n, F.lit('\n\tx", "n')))
    x = display.tolerant_json(form, "summary string, n bigint, tags array<string>")
    ids = table(spark, sf_dir, "events").select("event_id")
    # a row costs more to read than to deal out, and a file may be one task
    read = spread(ids, ids.count(), "event_id").select("event_id", x.alias("x"))
    return read.select("event_id", F.col("x.summary").alias("summary"), F.col("x.n").alias("n"))


@query("P33",
 f"""SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%m-%d %H:%M') AS local, CASE date_diff('day', ts::DATE, DATE '2024-01-20') WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE CASE WHEN date_diff('day', ts::DATE, DATE '2024-01-20') BETWEEN 2 AND 7 THEN date_diff('day', ts::DATE, DATE '2024-01-20') || ' days ago' ELSE strftime(ts, '%m-%d') END END AS day FROM events""")
def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.date_format(F.col("ts") + F.expr("interval 8 hours"), "MM-dd HH:mm").alias("local"),
        display.relative_day(F.to_date("ts"), F.lit("2024-01-20").cast("date")).alias("day")
    )


@query("P46",
 f"""WITH {ARTICLES} SELECT id, '[' || upper(k) || ' ' || len(summary) || ' ' || u || '] ' || title AS said, k || ':' || CASE WHEN k = 'reddit' THEN substr(sha256('http://r/' || id), 1, 16) ELSE id::VARCHAR END AS sig FROM (SELECT *, ['hn', 'reddit', 'hf', 'github'][id % 4 + 1] AS k, ['points', 'upvotes', 'likes', 'stars'][id % 4 + 1] AS u FROM a WHERE title IS NOT NULL)""")
def signal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("hn", "reddit", "hf", "github"))), (F.col("id") % 4 + 1).cast("int"))
    a = articles(spark, sf_dir).where("title is not null").withColumn("kind", kind)
    own = F.when(F.col("kind") != "reddit", F.col("id").cast("string"))
    return a.select(
        "id", display.signal_text(F.col("kind"), F.col("title"), F.length("summary")).alias("said"),
        display.signal_id(F.col("kind"), own, F.concat(F.lit("http://r/"), "id")).alias("sig")
    )


@query("P48",
 f"""WITH {ARTICLES}, r AS (SELECT id, title, row_number() OVER (ORDER BY importance DESC, id) AS n FROM a WHERE title IS NOT NULL) SELECT id, n::INT AS place, CASE WHEN n = 1 THEN CASE WHEN len(title) > 52 THEN substr(title, 1, 51) || '…' ELSE title END ELSE CASE WHEN len(title) > 46 THEN substr(title, 1, 45) || '…' ELSE title END END AS head FROM r WHERE n <= 5""")
def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five headlines of a message; the first may be longer."""
    from pyspark.sql import Window

    top = articles(spark, sf_dir).where("title is not null").orderBy(F.desc("importance"), "id").limit(5)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "id")))  # five rows
    return top.select(
        "id", "place", F.when(F.col("place") == 1, display.headline(F.col("title"), 52)).otherwise(display.headline(F.col("title"), 46)).alias("head")
    )


@query(
    "P49",
    "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'am' WHEN user_id % 3 = 1 THEN CASE WHEN hour(ts) >= 12 THEN 'pm' ELSE 'am' END ELSE CASE WHEN hour(ts) >= 12 THEN 'pm' ELSE 'am' END END AS shift FROM events"
)
def stored_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.when(F.col("user_id") % 3 == 0, "am").when(F.col("user_id") % 3 == 1, "")
    return table(spark, sf_dir, "events").select("event_id", display.shift_of(stored, F.col("ts")).alias("shift"))


@query("P37",
 f"""WITH {ARTICLES} SELECT id, md5(CASE WHEN id % 2 = 0 THEN concat_ws(' ', lang, lang, lang, title, substr(summary, 1, 200)) ELSE concat_ws(' ', title, substr(summary, 1, 200)) END) AS digest FROM a""")
def cluster_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is compared: signature three times, title and the head of the summary; known events go without the signature."""
    new, known = text.cluster_text(F.col("lang"), F.col("title"), F.col("summary")), text.cluster_text(
        F.lit(None).cast("string"), F.col("title"), F.col("summary")
    )
    return articles(spark, sf_dir).select("id", F.md5(F.when(F.col("id") % 2 == 0, new).otherwise(known).cast("binary")).alias("digest"))


@query("J06",
 f"""WITH {ARTICLES}, t AS (SELECT id, collected_at, regexp_replace(lower(coalesce(title, '')), '[ \t\n\r\f\x0b]+', '', 'g') AS k FROM a) SELECT id FROM t n WHERE collected_at >= TIMESTAMP '2024-01-01 10:00:00' AND NOT EXISTS (SELECT 1 FROM t o WHERE o.k = n.k AND o.collected_at < TIMESTAMP '2024-01-01 10:00:00' AND o.collected_at >= TIMESTAMP '2024-01-01 10:00:00' - INTERVAL 4 HOUR)""")
def unseen_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New articles whose title was not seen within the hours that count."""
    from newsloom.functions.keys import title_key
    from newsloom.operators.dedup import unseen

    a = articles(spark, sf_dir).select("id", title_key(F.col("title")).alias("key"), "collected_at")
    at = F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")
    history = a.where((F.col("collected_at") < at) & (F.col("collected_at") >= at - F.expr("interval 4 hours")))
    return unseen(a.where(F.col("collected_at") >= at), history, "key").select("id")


@query("J05", """SELECT l_orderkey AS event_id, 's' || min_by(l_suppkey, (l_shipdate, l_suppkey, l_linenumber)) AS source FROM lineitem GROUP BY 1""")
def first_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("event_id")).agg(
        F.concat(F.lit("s"), F.min_by("l_suppkey", F.struct("l_shipdate", "l_suppkey", "l_linenumber"))).alias("source")
    )


@query("A12, A10", f"""WITH {ARTICLES}, w AS (SELECT unnest(list_distinct([coalesce(source_name, ''), coalesce(lang, '')])) AS entity, id,
 importance, collected_at FROM a WHERE collected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND collected_at <= TIMESTAMP '{AS_OF}'),
n AS (SELECT entity, count(*) AS n FROM w WHERE entity <> '' GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, entity LIMIT 12)
SELECT entity, n.n, round(n.n / max(n.n) OVER (), 4) AS scale, key_events, timeline FROM n JOIN (SELECT entity, count(*)
 FILTER (importance >= 4) AS key_events, string_agg(id::VARCHAR, ',' ORDER BY collected_at, id) FILTER (importance >= 4) AS timeline FROM w
 GROUP BY 1) USING (entity)""")
def entity_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The week's twelve most reported entities of three items or more: share of the largest, and their important items in time."""
    from newsloom.operators.entities import timelines

    at = F.lit(AS_OF).cast("timestamp_ntz")
    week = articles(spark, sf_dir).where((F.col("collected_at") >= at - F.expr("interval 7 days")) & (F.col("collected_at") <= at))
    tagged = week.withColumn("entities", F.array(F.coalesce("source_name", F.lit("")), F.coalesce("lang", F.lit(""))))
    return timelines(tagged, 3, 12).withColumn("timeline", F.array_join("timeline", ","))
