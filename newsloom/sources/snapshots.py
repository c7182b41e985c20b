"""Versions of a table that are checked before they are trusted, and work that goes on item by item where it stopped.

A snapshot is a folder of parquet files and a manifest of their sizes and digests, which is written last. A version is
whole if all its files are there, unchanged and no other; readers take the newest whole one. Files are
read and digested by the executors, a file at a time, so they should be no larger than a task can hold
(spark.sql.files.maxRecordsPerFile).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "file string, size bigint, digest string"
#: fixed value: versions that are kept
KEPT = 7


def _fs(spark: SparkSession, path: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _children(spark: SparkSession, path: str) -> list[str]:
    store, folder = _fs(spark, path)
    return [s.getPath().getName() for s in store.listStatus(folder)] if store.exists(folder) else []


def _delete(spark: SparkSession, path: str) -> None:
    store, folder = _fs(spark, path)
    store.delete(folder, True)


def _digests(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option(
        "ignoreCorruptFiles", True
    ).load(folder)
    return found.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions with a manifest, newest first."""
    return sorted((int(n[2:]) for n in _children(spark, f"{path}/manifest") if n.startswith("v=")), reverse=True)


def save(table: DataFrame, path: str, kept: int = KEPT) -> int:
    """Write the next version; of the versions with a manifest the newest `kept` stay."""
    spark = table.sparkSession
    there = {int(n[2:]) for kind in ("data", "manifest") for n in _children(spark, f"{path}/{kind}") if n.startswith("v=")}
    v = max(there, default=0) + 1
    table.write.mode("overwrite").parquet(f"{path}/data/v={v}")
    _digests(spark, f"{path}/data/v={v}").write.mode("overwrite").json(f"{path}/manifest/v={v}")
    for old in versions(spark, path)[kept:]:
        _delete(spark, f"{path}/manifest/v={old}")
        _delete(spark, f"{path}/data/v={old}")
    return v


def damage(spark: SparkSession, path: str, v: int) -> DataFrame:
    """(file, problem) of a version: missing (or unreadable), unknown or changed files."""
    said = spark.read.schema(MANIFEST).json(f"{path}/manifest/v={v}").toDF("file", "_size", "_digest")
    store, folder = _fs(spark, f"{path}/data/v={v}")
    found = _digests(spark, f"{path}/data/v={v}") if store.exists(folder) else spark.createDataFrame([], MANIFEST)
    problem = F.when(F.col("digest").isNull(), "missing").when(F.col("_digest").isNull(), "unknown").when(
        (F.col("size") != F.col("_size")) | (F.col("digest") != F.col("_digest")), "changed"
    )
    return said.join(found, "file", "full").select("file", problem.alias("problem")).where("problem is not null")


def newest_whole(spark: SparkSession, path: str) -> int | None:
    """The newest version without damage; None if there is none."""
    return next((v for v in versions(spark, path) if not damage(spark, path, v).limit(1).count()), None)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest whole version, or an empty table."""
    v = newest_whole(spark, path)
    return spark.createDataFrame([], schema) if v is None else spark.read.schema(schema).parquet(f"{path}/data/v={v}")


def restore(spark: SparkSession, path: str) -> int | None:
    """Set damaged newer versions aside (their manifests go, their files stay for inspection); the version that counts now."""
    whole = newest_whole(spark, path)
    for v in versions(spark, path):
        if whole is None or v > whole:
            _delete(spark, f"{path}/manifest/v={v}")
    return whole


def finished(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results of the committed parts of resume()."""
    names = [n for n in _children(spark, f"{path}/committed") if not n.startswith((".", "_"))]
    rows = spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/results/{n}" for n in names)) if names else rows


def resume(items: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, schema: str, parts: int = 8) -> DataFrame:
    """work(items) with the columns of schema, part by part; a run that was stopped is repeated for unfinished items only.

    The results of a part count once its name stands in the folder of committed ones, which appears in
    one step after they are written; a part that was not committed is done again under another name.
    Keys are not null; items of a committed key are not worked on again.
    """
    spark = items.sparkSession
    todo = items.join(finished(spark, path, schema).select(key), key, "left_anti")
    for p in range(parts):
        name = uuid.uuid4().hex
        rows = todo.where(F.pmod(F.xxhash64(key), F.lit(parts)) == p)
        if rows.limit(1).count():
            work(rows).write.parquet(f"{path}/results/{name}")
            store, mark = _fs(spark, f"{path}/committed/{name}")
            store.mkdirs(mark)
    return finished(spark, path, schema)
