"""Streaming queries over the events table, run to the end of what is available."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.plans import reports  # noqa: F401  (its queries are referred to)
from newsloom.plans.registry import QUERIES, query
from newsloom.sources.tables import shared_dir, table
from newsloom.streaming import cache, jobs


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("R01, R02, R04",
 """SELECT w AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01 06:00:00') AS w FROM events) GROUP BY ALL""")
def stream_shift_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each shift as the stream last stated them: the largest count per window."""
    e = _stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    rows = jobs.run_available(jobs.shift_counts(e, "at"), _folder(spark, "shifts"), "update")
    out = rows.groupBy("window", "event_type").agg(F.max_by("total", "n").alias("total"), F.max("n").alias("n"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("R05", "SELECT count(DISTINCT (user_id, event_type, props)) AS n FROM events")
def stream_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    rows = jobs.run_available(jobs.exact_dedup(e, "at", ["user_id", "event_type", "props"], 24 * 60).select("event_id"), _folder(spark, "dedup"))
    return rows.agg(F.count("*").alias("n"))


@query("R07, W06", QUERIES["health_ema"].sql)
def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _stream(spark, sf_dir).select(
        F.col("user_id").alias("name"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"),
        (F.col("event_type") != "error").alias("ok"), F.col("value").alias("took")
    )
    rows = jobs.run_available(jobs.health(runs), _folder(spark, "health"), "update")
    return rows.groupBy("name").agg(
        F.max_by(F.struct("avg_time", "failures"), "runs").alias("x"), F.max("runs").alias("runs")
    ).select("name", "x.avg_time", "x.failures", "runs")


@query("R06",
 """WITH k AS (SELECT event_type || user_id % 5 AS key, ts, event_id AS seq FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS n FROM k) SELECT key, seq FROM r WHERE n = 1""")
def stream_first_pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that come more often than they are forgotten are pushed once."""
    e = _stream(spark, sf_dir).select(
        F.concat("event_type", (F.col("user_id") % 5).cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("at"),
        F.col("event_id").alias("seq")
    )
    return jobs.run_available(jobs.first_pushes(e), _folder(spark, "pushes")).select("key", "seq")


@query("R09", """WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
 + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id
 ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
c AS (SELECT user_id, s, min(ts) AS start, max(ts) AS last_at, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, start, n FROM c""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users as the stream last stated them; an addition of ours."""
    e = _stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    rows = jobs.run_available(jobs.session_counts(e, "at", "user_id"), _folder(spark, "sessions"), "complete")
    return rows.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("R09",
 """SELECT a.event_id AS seen, b.event_id AS bought FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'""")
def stream_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within an hour after a view, from two streams; an addition of ours."""
    e = _stream(spark, sf_dir).select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    out = jobs.joined(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id")
    return jobs.run_available(out.select(F.col("a.event_id").alias("seen"), F.col("b.event_id").alias("bought")), _folder(spark, "joined"))


@query("R06, J22",
 """WITH o AS (SELECT user_id, event_id, ts, event_type IN ('purchase', 'signup') AS puts, event_id % 4 = 0 AS poor FROM events),
s AS (SELECT *, last_value(CASE WHEN puts THEN ts END IGNORE NULLS) OVER w AS created, last_value(CASE WHEN puts THEN poor END IGNORE NULLS) OVER w AS bad
 FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT user_id, event_id, ts, coalesce(created >= ts - INTERVAL 7 DAY AND NOT bad, FALSE) AS hit FROM s WHERE NOT puts)
SELECT user_id::VARCHAR AS key, event_id AS seq, hit, (count(*) FILTER (hit) OVER w)::BIGINT AS hits, (count(*) FILTER (NOT hit) OVER w)::BIGINT AS misses
 FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as a cache's traffic: some put an entry, one in four of them a poor one, the others look it up."""
    e = _stream(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type").isin("purchase", "signup"), "set").otherwise("get").alias("kind"),
        F.when(F.col("event_id") % 4 != 0, F.lit("text")).otherwise("").alias("content"), F.lit(True).alias("relevant")
    )
    with cache.rocksdb(spark):
        rows = jobs.run_available(cache.lookups(e), _folder(spark, "cache"))
    return rows.select("key", "seq", (F.col("outcome") == "hit").alias("hit"), "hits", "misses")
