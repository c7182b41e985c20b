"""The event store's writes as pure functions (old, new) -> new state, and idempotent file sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """New keys are inserted; rows with status 'collected' take non-null fields of the new; others stay."""
    n = new.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_{f}") for f in fields))
    j = old.join(n, old[key] == n["_k"], "full")
    fresh, open_ = F.col(key).isNull(), F.col("status") == "collected"
    out = [F.coalesce(key, "_k").alias(key)]
    out += [F.when(fresh, F.col(f"_{f}")).when(open_, F.coalesce(f"_{f}", f)).otherwise(F.col(f)).alias(f) for f in fields]
    return j.select(*out, F.coalesce("status", F.lit("collected")).alias("status"), fresh.alias("is_new"))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key is not in old, once each."""
    return new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti")


def partial_update(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Null in new means keep."""
    n = new.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    return old.join(n, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else c for c in old.columns))


def latest(old: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """The newest row of each key of both."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn(
        "_n", F.row_number().over(Window.partitionBy(key).orderBy(order.desc(), F.desc("_new")))
    ).where("_n = 1").drop("_n", "_new")


def retained(rows: DataFrame, stamp: str, as_of: Column, days: int) -> DataFrame:
    return rows.where(F.col(stamp) >= as_of - F.make_dt_interval(F.lit(days)))


def without_orphans(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """Evidence whose event is there."""
    return evidence.join(events.select("event_id").distinct(), "event_id", "left_semi")


def archive_new(new: DataFrame, archive: DataFrame, key: str, month: str, months: list[str]) -> DataFrame:
    """Rows to append: keys that are in none of the given months' partitions."""
    return new.join(archive.where(F.col(month).isin(months)).select(key).distinct(), key, "left_anti")


def append_archive(rows: DataFrame, path: str, month: str) -> None:
    rows.write.mode("append").partitionBy(month).parquet(path)


def swap(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Overwrite a table, or only the partitions that rows has."""
    w = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if partition else "static")
    (w.partitionBy(partition) if partition else w).parquet(path)
