"""Feeds, signal lists, logs and JSON lines as DataFrames. Nothing here fetches: inputs are files or columns of raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import parse_date, strip_html

#: fixed values: address prefixes of the source kinds
PREFIXES = ("youtube", "zhihu", "twitter", "xhs", "wewe-rss", "hf-papers", "wechat")

_RSS = "channel struct<item: array<struct<title: string, link: string, description: string, pubDate: string>>>"
_ATOM = "entry array<struct<title: string, link: array<struct<_href: string, _rel: string>>, summary: string, content: string, published: string, updated: string>>"


def kind(url: Column) -> Column:
    """The source kind that an address names by its prefix, else http."""
    prefix = F.regexp_extract(url, r"^([a-z-]+)://", 1)
    return F.when(prefix.isin(*PREFIXES), prefix).otherwise("http")


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml): whole files of a folder, read by Spark."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("xml"))


def _repaired(xml: Column) -> Column:
    """Bare ampersands escaped, CDATA unwrapped and escaped, namespaced tags and the declaration dropped."""
    xml = F.regexp_replace(xml, r"^\s*<\?xml[^>]*\?>", "")
    cdata = F.regexp_replace(xml, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    bare = F.regexp_replace(cdata, r"&(?!(?:[a-zA-Z]+|#\d+|#x[0-9A-Fa-f]+);)", "&amp;")
    return F.regexp_replace(
        bare, r"(?s)<(/?)(?!/?(?:rss|channel|item|title|link|description|pubDate|feed|entry|summary|content|published|updated)\b)[^>]*>", " "
    )


def items(feeds: DataFrame, xml: str = "xml", summary_chars: int = 800) -> DataFrame:
    """A row per item of RSS 2.0 or Atom text: the other columns of feeds, pos, title, link, summary, published, image.

    Text that is not XML has no items. The image is the first enclosure, media or img address.
    """
    clean = _repaired(F.col(xml))
    options = {"mode": "PERMISSIVE", "attributePrefix": "_", "ignoreNamespace": "true"}
    rss, atom = F.from_xml(clean, _RSS, options)["channel"]["item"], F.from_xml(clean, _ATOM, options)["entry"]
    one = "struct<title: string, link: string, summary: string, published: string>"
    from_rss = F.transform(
        rss,
        lambda i: F.struct(
            i["title"].alias("title"), i["link"].alias("link"), i["description"].alias("summary"), i["pubDate"].alias("published")
        ).cast(one)
    )
    from_atom = F.transform(
        atom,
        lambda e: F.struct(
            e["title"].alias("title"), F.try_element_at(e["link"], F.lit(1))["_href"].alias("link"),
            F.coalesce(e["summary"], e["content"]).alias("summary"), F.coalesce(e["published"], e["updated"]).alias("published")
        ).cast(one)
    )
    found = F.when(F.col(xml).rlike("<rss"), from_rss).when(F.col(xml).rlike("<feed"), from_atom)
    blocks = F.regexp_extract_all(xml, F.lit(r"(?s)(<item\b.*?</item>|<entry\b.*?</entry>)"), 1)
    out = feeds.withColumn("_blocks", blocks).select("*", F.posexplode(found).alias("pos", "_i"))
    image = F.regexp_extract(
        F.try_element_at("_blocks", F.col("pos") + 1), r"""<(?:enclosure|media:content|media:thumbnail|img)\b[^>]*?\b(?:url|src)=["']([^"']+)["']""",
        1
    )
    return out.select(
        *(c for c in feeds.columns if c != xml), "pos", strip_html(F.col("_i.title")).alias("title"), F.trim("_i.link").alias("link"),
        F.substring(strip_html(F.col("_i.summary")), 1, summary_chars).alias("summary"), parse_date(F.col("_i.published")).alias("published"),
        image.alias("image")
    )


def recent(feed_items: DataFrame, as_of: Column, hours: int, cap: int, undated: int = 3) -> DataFrame:
    """Per source: dated items within the age and the first three undated; if none, the first three; `cap` at most."""
    from pyspark.sql import Window

    by = Window.partitionBy("source_name").orderBy("pos")
    fresh = F.col("published") >= as_of - F.expr(f"interval {hours} hours")
    nth_undated = F.sum(F.col("published").isNull().cast("int")).over(by)
    ok = F.coalesce(fresh, F.lit(False)) | (F.col("published").isNull() & (nth_undated <= undated))
    marked = feed_items.withColumn("_ok", ok).withColumn(
        "_any", F.max(ok).over(Window.partitionBy("source_name"))
    ).withColumn("_n", F.row_number().over(by))
    kept = marked.where(F.col("_ok") | (~F.col("_any") & (F.col("_n") <= undated)))
    return kept.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= cap).drop("_ok", "_any", "_n", "_k")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that do not parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def official_recent(feed_items: DataFrame, as_of: Column, hours: int = 6, newest: int = 25, per_feed: int = 5) -> DataFrame:
    """Of each feed's `newest` latest items by date those within the hours, per_feed at most; undated items are dropped."""
    from pyspark.sql import Window

    by = Window.partitionBy("source_name").orderBy(F.desc("published"), "pos")
    dated = feed_items.where("published is not null").withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= newest)
    fresh = dated.where(F.col("published") >= as_of - F.expr(f"interval {hours} hours"))
    return fresh.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= per_feed).drop("_n")


def signals(
    hn: DataFrame, reddit: DataFrame, hub: DataFrame, github: DataFrame, as_of: Column, subject: str, hours: int = 36, most: int = 50,
    most_hn: int = 30
) -> DataFrame:
    """One list of the four signal sources with each source's own score; repeats by address or name count once.

    Posts of the first must be of the subject (a pattern), recent and have 50 points; each source gives
    its best `most`, in a fixed order.
    """
    integer = lambda e: F.floor(e).cast("int")
    recent_hn = hn.where((F.col("points") >= 50) & F.col("title").rlike(subject) & (F.col("created_at") >= as_of - F.expr(f"interval {hours} hours")))
    lists = [
        (
            recent_hn.select(F.lit("hn").alias("source"), "title", "url", (F.col("points") + integer(F.col("comments") / 2)).alias("signal_score")),
            most_hn
        ),
        (
            reddit.groupBy("url").agg(F.min_by("title", "pos").alias("title"), F.min("pos").alias("pos")).orderBy("pos").limit(most).select(
                F.lit("reddit").alias("source"), "title", "url", F.lit(100).alias("signal_score")
            ),
            most
        ),
        (
            hub.where("likes >= 5").select(
                F.lit("hf").alias("source"), "title", "url",
                (F.col("likes") * 10 + F.when(F.col("kind") == "model", integer(F.col("downloads") / 1000)).otherwise(0)).alias("signal_score")
            ),
            most
        ),
        (
            github.groupBy("title").agg(F.max(F.struct("stars", "forks", "url")).alias("x")).select(
                F.lit("github").alias("source"), "title", "x.url",
                (integer(F.col("x.stars") / 100) * 10 + integer(F.col("x.forks") / 50)).alias("signal_score")
            ),
            most
        ),
    ]
    out = None
    for df, n in lists:
        best = df.orderBy(F.desc("signal_score"), "title", "url").limit(n)
        out = best if out is None else out.unionByName(best)
    return out


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, level, module, message) of the lines 'time [LEVEL] module: message'."""
    return parsed_lines(spark.read.text(path))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """(at, level, module, message) of the lines (value) 'time [LEVEL] module: message'; other lines are dropped."""
    p = r"^(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d)\S*\s+\[?(ERROR|WARNING|INFO|DEBUG)\]?\s+(\S+?):?\s+(.*)$"
    return lines.where(F.col("value").rlike(p)).select(
        F.try_to_timestamp(F.replace(F.regexp_extract("value", p, 1), F.lit("T"), F.lit(" "))).alias("at"),
        *(F.regexp_extract("value", p, i).alias(n) for i, n in ((2, "level"), (3, "module"), (4, "message")))
    )
