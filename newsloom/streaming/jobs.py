"""Structured Streaming versions of the micro-batch steps. Every job is exactly-once by its checkpoint and an idempotent sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HEALTH_OUT = "name bigint, avg_time double, failures bigint, runs bigint"
HEALTH_STATE = "avg bigint, failures bigint, runs bigint"
#: Hours for which a pushed key is remembered.
TTL_HOURS = 48


def exact_dedup(items: DataFrame, stamp: str, keys: list[str], hours: int = 72) -> DataFrame:
    """Drops repeats of a key within the dedup horizon; state is bounded by the watermark."""
    return items.withWatermark(stamp, f"{hours} hours").dropDuplicatesWithinWatermark(keys)


def shift_counts(items: DataFrame, stamp: str, late: str = "12 hours") -> DataFrame:
    """Counts per twelve-hour shift that starts at 06:00 or 18:00; late items within the watermark are counted."""
    return items.withWatermark(stamp, late).groupBy(
        F.window(stamp, "12 hours", "12 hours", "6 hours"), "event_type"
    ).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_counts(items: DataFrame, stamp: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a key; an addition of ours, not of the original reports."""
    return items.withWatermark(stamp, "1 hour").groupBy(F.session_window(stamp, gap), key).agg(F.count("*").alias("n"))


def _fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    avg, failures, runs = state.get if state.exists else (0, 0, 0)
    rows = pd.concat(list(parts)).sort_values(["at", "seq"], kind="stable")
    for ok, took in zip(rows.ok, rows.took, strict=True):
        runs += 1
        failures = 0 if ok else failures + 1
        cents = round(took * 100)
        if ok and cents > 0:
            whole, rest = divmod(7 * avg + 3 * cents, 10)
            avg = whole + (rest > 5 or rest == 5 and whole % 2 == 1) if avg > 0 else cents
    state.update((int(avg), int(failures), int(runs)))
    yield pd.DataFrame({"name": [key[0]], "avg_time": [avg / 100], "failures": [failures], "runs": [runs]})


def health(runs: DataFrame) -> DataFrame:
    """Keyed state of each source: moving average of fetch times, unbroken failures, runs."""
    return runs.groupBy("name").applyInPandasWithState(_fold, HEALTH_OUT, HEALTH_STATE, "update", GroupStateTimeout.NoTimeout)


def _remember(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(parts)).sort_values(["at", "seq"], kind="stable")
    first = not state.exists
    state.update((int(rows["at"].iloc[-1].timestamp()),))
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int((rows["at"].iloc[-1].timestamp() + TTL_HOURS * 3600) * 1000)))
    if first:
        yield rows.iloc[:1][["key", "at", "seq"]]


def first_pushes(signals: DataFrame) -> DataFrame:
    """The first signal (key, at, seq) of each key; a key is forgotten TTL_HOURS of event time after it was last seen."""
    return signals.withWatermark("at", "1 hour").groupBy("key").applyInPandasWithState(
        _remember, "key string, at timestamp, seq bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def joined(left: DataFrame, right: DataFrame, key: str, hours: int = 1) -> DataFrame:
    """Pairs of two streams (key, at, ...) with right within the hours after left; both sides' state is bounded by watermarks.

    An addition of ours, not of the original reports.
    """
    a, b = left.withWatermark("at", f"{hours} hours").alias("a"), right.withWatermark("at", f"{hours} hours").alias("b")
    return a.join(b, F.expr(f"a.{key} = b.{key} and b.at >= a.at and b.at <= a.at + interval {hours} hours"))


def upsert_sink(path: str, key: str, order: str):
    """foreachBatch function that keeps the newest row per key in a table of two swapping versions."""
    from newsloom.operators.store import latest

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = f"{path}/v={batch_id}"
        batch = batch.dropDuplicates([key, order])
        if batch_id:
            batch = latest(spark.read.schema(batch.schema).parquet(f"{path}/v={batch_id - 1}"), batch, key, F.col(order))
        else:
            batch = latest(batch.limit(0), batch, key, F.col(order))
        batch.write.mode("overwrite").parquet(now)

    return write


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what is available now into a table below path; in update and complete mode the last result of each batch counts.

    Parquet takes appends only, so other modes write each batch in its own folder, by batch id:
    a repeated batch replaces its own files.
    """
    spark, schema = stream.sparkSession, stream.schema
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    q = w.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/rows/batch={i}")).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/rows/*")
