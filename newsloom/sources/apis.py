"""Items from the raw JSON of video, question, paper and note services. Inputs are columns of raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = ("title", "link", "summary")


def video_items(pages: DataFrame, json: str = "json") -> DataFrame:
    """(source_name, pos, title, link, summary) of a channel page's embedded JSON list of videos."""
    schema = "videos array<struct<videoId: string, title: string, text: string>>"
    v = pages.select("source_name", F.posexplode(F.from_json(json, schema)["videos"]).alias("pos", "v"))
    return v.where("v.videoId is not null").select(
        "source_name", "pos", F.col("v.title").alias("title"), F.concat(F.lit("https://www.youtube.com/watch?v="), "v.videoId").alias("link"),
        F.coalesce("v.text", F.lit("")).alias("summary")
    )


def channel_page_items(pages: DataFrame, html: str = "html") -> DataFrame:
    """(source_name, pos, title, link, summary) of the videos in the initial data of a channel's HTML page."""
    data = F.regexp_extract(html, r"(?s)var ytInitialData\s*=\s*(\{.*?\});\s*</script>", 1)
    text = "struct<runs: array<struct<text: string>>>"
    schema = f"contents array<struct<richItemRenderer: struct<content: struct<videoRenderer: struct<videoId: string, title: {text}, descriptionSnippet: {text}>>>>>"
    v = pages.select(
        "source_name", F.posexplode(F.from_json(data, schema)["contents"]).alias("pos", "x")
    ).select("source_name", "pos", "x.richItemRenderer.content.videoRenderer.*")
    said = lambda c: F.array_join(F.transform(F.coalesce(F.col(c)["runs"], F.array()), lambda r: r["text"]), "")
    return v.where("videoId is not null").select(
        "source_name", "pos", said("title").alias("title"), F.concat(F.lit("https://www.youtube.com/watch?v="), "videoId").alias("link"),
        said("descriptionSnippet").alias("summary")
    )


def with_fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of first, and rows of second for keys that first has none of."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti").select(*first.columns))


def hot_questions(pages: DataFrame, json: str = "json") -> DataFrame:
    schema = "data array<struct<target: struct<id: bigint, title: string, excerpt: string>, detail_text: string>>"
    q = pages.select("source_name", F.posexplode(F.from_json(json, schema)["data"]).alias("pos", "d"))
    link = F.concat(F.lit("https://www.zhihu.com/question/"), F.col("d.target.id"))
    return q.select(
        "source_name", "pos", F.col("d.target.title").alias("title"), link.alias("link"),
        F.concat_ws(" ", "d.detail_text", "d.target.excerpt").alias("summary")
    )


def original_post(link: Column) -> Column:
    """The address of a post at its own service instead of a mirror."""
    return F.regexp_replace(F.regexp_replace(link, r"^https?://[^/]+/", "https://x.com/"), r"#.*$", "")


def first_of(json: Column, paths: list[str]) -> Column:
    """The first path of a JSON text that holds something."""
    return F.coalesce(*(F.get_json_object(json, p) for p in paths))


def daily_papers(days: DataFrame, as_of: Column, json: str = "json", days_back: int = 7, most: int = 10) -> DataFrame:
    """Papers of several daily lists: once each, not older than days_back, most upvoted first."""
    schema = "array<struct<paper: struct<id: string, title: string, summary: string, upvotes: int, publishedAt: string>>>"
    p = days.select(F.explode(F.from_json(json, schema)).alias("p")).select("p.paper.*").withColumn(
        "published", F.try_to_timestamp(F.substring("publishedAt", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    )
    once = p.where(F.col("published") >= as_of - F.make_dt_interval(F.lit(days_back))).withColumn(
        "_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("upvotes")))
    ).where("_n = 1")
    return once.orderBy(F.desc("upvotes"), "id").limit(most).select(
        "id", "title", F.concat(F.lit("https://huggingface.co/papers/"), "id").alias("link"), "summary", "upvotes"
    )
