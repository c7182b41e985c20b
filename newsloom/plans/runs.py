"""Queries over what runs leave and take up again: waves of analyses, snapshots, finished items, log ends, the searchable archive, pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import analysis, health, ranking, search_index
from newsloom.plans.registry import query
from newsloom.plans.views import ARTICLES, AS_OF, articles
from newsloom.sources import feeds, log_tail, snapshots
from newsloom.sources.tables import shared_dir, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("C04, J22", """WITH p AS (SELECT page_id AS id, len(html) > 3000 AS cached FROM pages), m AS (SELECT id, row_number() OVER (ORDER BY id % 97, id) AS place,
 count(*) OVER () AS n, id % 3 = 1 AS bad FROM p WHERE NOT cached),
w AS (SELECT *, (place - 1) // greatest(1, ceil(n / 10)::BIGINT) AS wave FROM m),
s AS (SELECT wave, any_value(n) AS n, sum(count(*) FILTER (bad)) OVER (ORDER BY wave) AS failed FROM w GROUP BY wave),
f AS (SELECT coalesce(min(wave), 1000) AS fuse FROM s WHERE failed >= greatest(3, floor(n * 0.3)))
SELECT p.id, CASE WHEN cached THEN 'cache' WHEN wave <= fuse AND NOT bad THEN 'analysed' ELSE 'rules' END AS level,
 CASE WHEN cached THEN 'kept' WHEN wave <= fuse AND NOT bad THEN 'model' ELSE 'rule' END AS content FROM p LEFT JOIN w USING (id), f""")
def fused_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by rules, cache and an analyser of which every third call fails, until the fuse blows."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("page_id").cast("string").alias("url_key"), F.length("html").alias("size"))
    now = F.lit(AS_OF).cast("timestamp_ntz")
    cache = p.where("size > 3000").select("url_key", F.lit("kept").alias("content"), F.lit(True).alias("relevant"), now.alias("created_at"))

    def rules(items: DataFrame) -> DataFrame:
        return items.select("id", "url_key", F.lit("rule").alias("content"), F.lit(True).alias("relevant"))

    def analyse(items: DataFrame) -> DataFrame:
        bad = F.col("id") % 3 == 1
        return items.select("id", F.when(~bad, "model").alias("content"), (~bad).alias("relevant"), F.when(bad, "timed out").alias("error"))

    found = analysis.tiered_fused(p, rules, cache, analyse, now, [(F.col("id") % 97).asc(), F.col("id").asc()])
    return found.select("id", "level", "content")


@query("K22, K04", "SELECT event_type, count(*) AS n, sum(value * 2)::DOUBLE AS total FROM events WHERE event_id % 2 = 0 GROUP BY 1")
def restored_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of a table, of which the last is damaged: its manifest tells, and the second one counts."""
    path, e = _folder(spark, "snapshots"), table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    snapshots.save(e, path)
    snapshots.save(e.where("event_id % 2 = 0").withColumn("value", F.col("value") * 2), path)
    v = snapshots.save(e.withColumn("value", F.lit(0.0)), path)
    e.limit(1).write.mode("append").parquet(f"{path}/data/v={v}")  # a file that the manifest does not know
    snapshots.restore(spark, path)
    rows = snapshots.load(spark, path, "event_id bigint, event_type string, value double")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("K23", "SELECT doc_id, len(text)::INT AS size, CASE WHEN doc_id % 4 = 0 THEN 'first' ELSE 'second' END AS run FROM documents")
def resumed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that is stopped after a quarter of the items, and one that works on what it left."""
    path, schema = _folder(spark, "resume"), "doc_id bigint, size int, run string"
    d = table(spark, sf_dir, "documents")

    def work(name: str):
        return lambda rows: rows.select("doc_id", F.length("text").alias("size"), F.lit(name).alias("run"))

    snapshots.resume(d.where("doc_id % 4 = 0"), "doc_id", work("first"), path, schema)
    return snapshots.resume(d, "doc_id", work("second"), path, schema)


#: bytes of each log that are read
_TAIL = 20_000
_LOG_LINE = "strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'WARNING' END || '] m' || user_id % 5 || ': took ' || event_id % 7"


@query("S21, A16", f"""WITH l AS (SELECT user_id % 4 AS log, event_id, event_type, 'm' || user_id % 5 AS module, 'took ' || event_id % 7 AS head, {_LOG_LINE} AS line FROM events),
t AS (SELECT *, sum(len(line) + 1) OVER (PARTITION BY log ORDER BY event_id DESC) AS behind FROM l)
SELECT CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'WARNING' END AS level, module, head, count(*) AS n FROM t WHERE behind <= {_TAIL}
 GROUP BY ALL ORDER BY n DESC, level, module, head LIMIT 30""")
def log_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the logs of four hosts; of each only the last bytes are read, from a whole line on, and rolled up."""
    path, e = _folder(spark, "logs"), table(spark, sf_dir, "events")
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.when(F.col("event_type") == "error", "ERROR").otherwise("WARNING"), F.lit("] m"),
        F.col("user_id") % 5, F.lit(": took "), F.col("event_id") % 7
    )
    logs = e.select((F.col("user_id") % 4).alias("log"), "event_id", line.alias("value"))
    logs.repartition("log").sortWithinPartitions("log", "event_id").select("log", "value").write.partitionBy("log").text(path)
    spark.dataSource.register(log_tail.LogTail)
    tail = spark.read.format("log_tail").option("bytes", _TAIL).load(path)
    return health.error_rollup(feeds.parsed_lines(tail)).select("level", "module", "head", "n")


@query("K13, T13, S23", """WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders ORDER BY month DESC LIMIT 6)
SELECT 'o' || o_orderkey AS i, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderpriority || ' for ' || o_custkey AS t, strftime(o_orderdate, '%Y-%m') AS m FROM orders
 WHERE contains(lower(o_orderpriority || ' for ' || o_custkey), 'urgent for 1') AND strftime(o_orderdate, '%Y-%m') IN (FROM m) ORDER BY d DESC, i LIMIT 30""")
def archive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an archive by month; the newest six months are searched by the posting lists of the text's trigrams."""
    path = _folder(spark, "search")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("i"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"),
        F.substring(F.concat("o_orderpriority", F.lit(" for "), "o_custkey"), 1, search_index.TITLE).alias("t"), F.date_format("o_orderdate", "yyyy-MM").alias("m")
    )
    search_index.build(rows, path)
    entries = spark.read.schema("i string, d string, t string, m string").parquet(f"{path}/entries")
    postings = spark.read.schema("gram string, i string, m string").parquet(f"{path}/postings")
    search_index.manifest(entries, "1998-08-02", f"{path}/manifest")
    months = F.from_json("value", "months array<string>, updated string")["months"]
    newest = spark.read.text(f"{path}/manifest").select(F.slice(months, 1, 6)).first()[0]  # names of partitions
    return search_index.search(entries, postings, "URGENT for 1", newest).select("i", "d", "t", "m")


@query("K13", """SELECT DISTINCT 'd' || user_id % 7 AS date, CASE WHEN event_id % 2 = 0 THEN 'am' ELSE 'pm' END AS shift, event_type AS title FROM events WHERE event_type <> 'click'""")
def archive_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs add their judgments to the archive; date, shift and title are the key, untitled ones are left out."""
    path, schema = _folder(spark, "judgments"), "date string, shift string, title string"
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("d"), F.col("user_id") % 7).alias("date"), F.when(F.col("event_id") % 2 == 0, "am").otherwise("pm").alias("shift"),
        F.when(F.col("event_type") != "click", F.concat(F.lit(" "), "event_type")).otherwise(" ").alias("title"), F.col("event_id") % 3
    )
    there = spark.createDataFrame([], schema)
    for run in ("date < 'd4'", "date > 'd2'"):
        search_index.new_judgments(there, e.where(run).select("date", "shift", "title")).write.mode("append").json(path)
        there = spark.read.schema(schema).json(path)
    return there


_PAGE = f"""{ARTICLES}, f AS (SELECT id, importance, (id % 5)::INT AS reports, collected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 12 HOUR AS today FROM a),
k AS (SELECT id, importance >= 3 AS chosen, CASE WHEN importance >= 3 THEN importance + CASE WHEN reports >= 4 THEN 1.0 WHEN reports = 3 THEN 0.8
 WHEN reports = 2 THEN 0.5 ELSE 0.0 END + CASE WHEN today THEN 0.7 ELSE 0.0 END END AS key FROM f),
r AS (SELECT *, row_number() OVER (ORDER BY NOT chosen, key DESC NULLS LAST, id) AS place FROM k)"""


@query("T05, T06", f"""WITH {_PAGE} SELECT id, CASE WHEN chosen AND place <= 10 THEN 'featured' ELSE 'more' END AS section,
 (place - CASE WHEN chosen AND place <= 10 THEN 0 ELSE least(10, (SELECT count(*) FROM r WHERE chosen)) END)::BIGINT AS place FROM r""")
def page_sections_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's section and place: ten featured ones; the other featured ones stand before the rest."""
    items = articles(spark, sf_dir).select(
        "id", "importance", (F.col("id") % 5).cast("int").alias("reports"),
        (F.col("collected_at") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 12 hours")).alias("today")
    )
    return ranking.page_order(items).select("id", "section", F.col("place").cast("bigint").alias("place"))
