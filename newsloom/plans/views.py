"""The driver's tables as articles, evidence, source runs and signals, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources.tables import spread, table

#: 'now' of all lookback queries
AS_OF = "2024-01-01 18:00:00"

ARTICLES = """a AS (
  SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS title, d.text AS summary, d.source AS source_name,
         (d.doc_id % 3)::INT AS tier, (1 + d.n_chars % 5)::INT AS importance,
         TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS collected_at, coalesce(l.quality, 1) = 1 AS ai_relevant, d.lang
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l USING (doc_id))"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality").distinct()
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("summary"), F.col("source").alias("source_name"),
        (F.col("doc_id") % 3).cast("int").alias("tier"), (1 + F.col("n_chars") % 5).cast("int").alias("importance"),
        F.expr(
            "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)"
        ).alias("collected_at"), (F.coalesce("quality", F.lit(1)) == 1).alias("ai_relevant"), "lang",
    )


EVIDENCE = """e AS (
  SELECT l_orderkey AS event_id, concat_ws('-', l_partkey, l_suppkey, l_linenumber) AS article_id, 's' || l_suppkey AS source_name,
         (l_suppkey % 3)::INT AS source_tier, l_shipdate AS reported_at, l_linenumber AS importance,
         l_returnflag = 'R' AS has_analysis, l_linestatus = 'F' AS has_body, l_partkey AS title_len,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_suppkey, l_partkey, l_linenumber, l_extendedprice)::BIGINT AS pos
  FROM lineitem)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as reports of their order."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_suppkey", "l_partkey", "l_linenumber", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem")
    return spread(rows, rows.count(), "l_orderkey").select(
        F.col("l_orderkey").alias("event_id"), F.concat_ws(
            "-", "l_partkey", "l_suppkey", "l_linenumber"
        ).alias("article_id"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("source_name"),
        (F.col("l_suppkey") % 3).cast("int").alias("source_tier"), F.col("l_shipdate").alias("reported_at"), F.col("l_linenumber").alias("importance"),
        (F.col("l_returnflag") == "R").alias("has_analysis"), (F.col("l_linestatus") == "F").alias("has_body"), F.col("l_partkey").alias("title_len"), place.cast("bigint").alias("pos"),
    )


HEALTH = 'h AS (SELECT user_id AS name, ts AS "at", event_id AS seq, event_type <> \'error\' AS ok, value AS took FROM events)'


def source_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fetches of a source, an error being a failure."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("name"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"),
        F.col("value").alias("took")
    )


#: The registry of entities for the driver's invented languages.
ENTITIES = [
    {"id": "shipping", "tier": 0, "primary": ["src1"], "backup": ["src2"], "keywords": ["license", "theandthe"]},
    {"id": "learning", "tier": 1, "primary": ["src3"], "backup": ["src4", "src5"], "keywords": ["ingtion", "keitung"]},
    {"id": "markets", "tier": 1, "primary": [], "backup": ["src6"], "keywords": ["mentement", "ación"]},
    {"id": "people", "tier": 2, "primary": ["src7"], "backup": [], "keywords": ["ouaux"]},
]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(e["id"], e["tier"], e["primary"], e["backup"]) for e in ENTITIES], "id string, tier int, primary array<string>, backup array<string>"
    )


def _entity_sql(e: dict) -> str:
    tests = [f"source_name IN ({', '.join(repr(s) for s in e['primary'])})"] if e["primary"] else []
    tests.append(f"regexp_matches(lower(concat_ws(' ', title, summary)), '{'|'.join(e['keywords'])}')")
    return f"CASE WHEN coalesce({' OR '.join(tests)}, FALSE) THEN '{e['id']}' END"


TAGGED = ARTICLES + ", g AS (SELECT *, list_filter([" + ", ".join(map(_entity_sql, ENTITIES)) + "], lambda x: x IS NOT NULL) AS entities FROM a)"
