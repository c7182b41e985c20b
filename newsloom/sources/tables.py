"""Driver tables, and tables that cut lineage in the shared folder."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a partition of spread().
PARTITION_ROWS = 250_000


#: Bytes of a file that one task reads, 2.8 million lineitems.
SPLIT_BYTES = 16 << 20


def small_splits(spark: SparkSession, most: int = SPLIT_BYTES) -> None:
    """From now on tasks of this session read at most `most` bytes of a file, or one row group."""
    name = "spark.sql.files.maxPartitionBytes"
    number, unit = re.fullmatch(r"(\d+)\s*([bkmgtp]?)[ib]*", spark.conf.get(name).strip().lower()).groups()
    if int(number) << 10 * "bkmgtp".index(unit or "b") > most:
        spark.conf.set(name, str(most))


def spread(rows: DataFrame, n: int, *keys: str, most: int = PARTITION_ROWS) -> DataFrame:
    """The n rows dealt by the keys to as many partitions as leave some `most` rows to each, at least the session's number.

    Sorts and groups of one task then hold as much of a large table as of a small one. So do the tasks that read it: with more
    than 200 partitions they hold what they deal out, so they read small splits.
    """
    small_splits(rows.sparkSession)
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-n // most)), *keys)


#: Rows of an Arrow batch: ten thousand long documents, Spark's default, are tens of megabytes on either side.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on Arrow batches of this session have at most `rows` rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the context's; a local one only where a local session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="newsloom-"))
    return _own_dir[0]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def free(*tables: DataFrame, sweep: bool = False) -> None:
    """Delete tables of cut() whose readers are all written; with sweep the driver also drops the shuffles behind them at once.

    Frames derived from them must not be used afterwards.
    """
    session = None
    for df in tables:
        session = df.sparkSession
        context = session.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if sweep and session is not None:
        sweep_shuffles(session)


def sweep_shuffles(spark: SparkSession) -> None:
    """Spark deletes the files of a shuffle when the driver's garbage collection finds that nothing refers to it.

    A first collection lets go of the query, which its last job may still hold, and a second one of its shuffles.
    """
    for wait in (1, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)
