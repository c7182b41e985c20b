"""Helpers that the corpus operators share: Arrow batches, bounded Bloom bitmaps; tables are the core's."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.entities import small
from newsloom.sources.tables import BATCH_ROWS, cut, free, shared_dir, small_batches, sweep_shuffles, table

__all__ = ["arrow_rows", "bloom", "crc_mod", "cut", "free", "in_bloom", "lean", "shared_dir", "small", "small_batches", "sweep_shuffles", "table"]

@contextmanager
def arrow_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Within it Arrow batches have at most `rows` rows; for steps that end in an action there."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lean(run: Callable) -> Callable:
    """An Arrow batch function that gives free memory back when a task ends, as workers are reused: its pool's and, where the C library can, the heap's."""

    @wraps(run)
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return call


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def bloom(keys: DataFrame, column: str, max_bits: int = 1 << 27) -> np.ndarray:
    """A bitmap of the long column: at least 16 bits a key up to max_bits, two probes.

    Built by the executors with bit_or per 64-bit word; the driver receives max_bits / 8 bytes
    at most, whatever the number of keys. A full bitmap only lets more keys through.
    """
    n = keys.count()
    bits = 1 << 16
    while bits < min(max_bits, 16 * n):
        bits <<= 1
    k = F.col(column)
    probes = keys.select(F.explode(F.array(k.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(k, 32).bitwiseAND(F.lit(bits - 1)))).alias("b"))
    words = probes.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy().view(np.uint64)
    return out


def in_bloom(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which uint64 keys may be in the bitmap; no key that is in it is ever missed."""
    mask = np.uint64(bitmap.size * 64 - 1)

    def has(b: np.ndarray) -> np.ndarray:
        return (bitmap[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1)

    return (has(keys & mask) & has((keys >> np.uint64(32)) & mask)).astype(bool)
