"""Configuration, archives and raw bytes as DataFrames, and the archive's own files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def json_config(spark: SparkSession, path: str, schema: str, root: str) -> DataFrame:
    """The rows of the list `root` of a JSON file that may span lines, with the columns of schema."""
    whole = spark.read.schema(f"{root} array<struct<{schema}>>").option("multiLine", True).json(path)
    return whole.select(F.explode(root).alias("x")).select("x.*")


def decoded(raw: Column) -> Column:
    """Bytes as text: UTF-8 where they are valid, else Latin-1, which reads any bytes; so later charsets are never reached."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))


def months_of(spark: SparkSession, path: str, schema: str, newest: int | None = 6) -> DataFrame:
    """The archive's rows of the newest months, or of all; partition pruning leaves other months unread."""
    rows = spark.read.schema(schema + ", month string").parquet(path)
    if newest is None:
        return rows
    names = [r.month for r in manifest(rows).limit(newest).collect()]  # names of partitions
    return rows.where(F.col("month").isin(names))


def manifest(rows: DataFrame) -> DataFrame:
    """The archive's months, newest first."""
    return rows.select("month").distinct().orderBy(F.desc("month"))


def search_rows(archived: DataFrame) -> DataFrame:
    """Rows of the search index: key (i), day (d), title in 90 characters (t), importance (k) and month (m)."""
    return archived.select(
        F.col("key").alias("i"), F.date_format("at", "yyyy-MM-dd").alias("d"), F.substring("title", 1, 90).alias("t"), F.col("importance").alias("k"),
        F.col("month").alias("m")
    )


def keyed(events: DataFrame) -> DataFrame:
    """events with key: the canonical event, the event, or the link; the first row of each key."""
    named = events.withColumn("key", F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("canonical_event_id", "event_id", "link"))))
    return named.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("at", "link"))).where("_n = 1").drop("_n")


def digest_payload(items: DataFrame) -> DataFrame:
    """One JSON row per day: its items, most important first, then largest."""
    entry = F.struct((-F.col("importance")).alias("o1"), (-F.col("cluster_size")).alias("o2"), "id", "title", "importance", "cluster_size")
    days = items.groupBy(F.to_date("collected_at").alias("day")).agg(F.array_sort(F.collect_list(entry)).alias("x"))
    shown = F.transform(
        "x", lambda e: F.struct(e["id"].alias("id"), e["title"].alias("title"), e["importance"].alias("importance"), e["cluster_size"].alias("size"))
    )
    return days.select(
        "day", F.size("x").cast("bigint").alias("n"),
        F.to_json(F.struct(F.date_format("day", "yyyy-MM-dd").alias("date"), shown.alias("items"))).alias("payload")
    )
