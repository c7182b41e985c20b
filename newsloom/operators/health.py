"""Source health, run and error reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moving_average(events: DataFrame) -> DataFrame:
    """(name, avg_time, failures, runs): 0.7 old + 0.3 new, rounded half to even to two places at each success with a time.

    A fold over each source's runs in order, in whole hundredths, so the rounding at each step is exact.
    Rows come sorted by source, so a task holds one batch and the state of one source, however many
    runs that has.
    """
    run = events.select("name", "at", "seq", "ok", F.round(F.col("took") * 100).cast("bigint").alias("cents"))
    kind = run.schema["name"].dataType.simpleString()
    return run.repartition("name").sortWithinPartitions("name", "at", "seq").mapInArrow(
        _fold, f"name {kind}, avg_time double, failures int, runs bigint"
    )


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, avg, failures, runs, some = None, 0, 0, 0, False
    for batch in batches:
        done = []
        for key, ok, cents in zip(*(batch.column(c).to_pylist() for c in ("name", "ok", "cents")), strict=True):
            if some and key != name:
                done.append((name, avg / 100, failures, runs))
            if not some or key != name:
                name, avg, failures, runs, some = key, 0, 0, 0, True
            runs += 1
            failures = 0 if ok else failures + 1
            if ok and cents is not None and cents > 0:
                whole, rest = divmod(7 * avg + 3 * cents, 10)
                avg = whole + (rest > 5 or rest == 5 and whole % 2 == 1) if avg > 0 else cents
        if done:
            yield _states(done, batch.schema.field("name").type)
    if some:
        yield _states([(name, avg / 100, failures, runs)], batch.schema.field("name").type)


def _states(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    n, a, f, r = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(n, kind), pa.array(a, pa.float64()), pa.array(f, pa.int32()), pa.array(r, pa.int64())],
        names=["name", "avg_time", "failures", "runs"]
    )


def failure_runs(events: DataFrame, least: int = 1) -> DataFrame:
    """(name, started, length) of each unbroken run of failures."""
    order = Window.partitionBy("name").orderBy("at", "seq")
    island = events.withColumn("g", F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.where("not ok").groupBy("name", "g").agg(
        F.min("at").alias("started"), F.count("*").alias("length")
    ).where(F.col("length") >= least).drop("g")


def skipped(health: DataFrame, as_of) -> DataFrame:
    """Sources not to fetch: ten failures, and not due for the daily retry of sources that once worked."""
    due = (F.col("total_successes") > 0) & (F.col("updated_at") <= as_of - F.expr("interval 24 hours"))
    return health.where((F.col("consecutive_failures") >= 10) & ~F.coalesce(due, F.lit(False)))


def latest_per_shift(runs: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("day", "shift").orderBy(F.desc("at"), F.desc("seq")))
    return runs.withColumn("_n", n).where("_n = 1").drop("_n")


def error_rollup(log: DataFrame, most: int = 30) -> DataFrame:
    """Count, first and last of each (level, module, message head), the most frequent first."""
    out = log.groupBy("level", "module", F.substring("message", 1, 60).alias("head")).agg(
        F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )
    return out.orderBy(F.desc("n"), "level", "module", "head").limit(most)


def scorecard(verdicts: DataFrame) -> DataFrame:
    """Counts by verdict and accuracy in percent, a partly right verdict counting half."""
    n = {v: F.count_if(F.col("verdict") == v) for v in ("correct", "partially", "wrong", "unverifiable")}
    decided = n["correct"] + n["partially"] + n["wrong"]
    return verdicts.groupBy("group").agg(
        *(c.alias(v) for v, c in n.items()), F.when(decided > 0, F.bround((n["correct"] + 0.5 * n["partially"]) / decided * 100)).alias("accuracy")
    )


def dashboard(sources: DataFrame, stats: DataFrame, health: DataFrame) -> DataFrame:
    """Configured sources with their articles' numbers and their state, zero where there are none; enabled first, then by volume."""
    fails = F.coalesce("consecutive_failures", F.lit(0))
    tag = F.when(~F.col("enabled"), "disabled").when(fails >= 10, "dead").when(fails >= 3, "failing").otherwise("ok")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "w7", "w7_hi")]
    out = sources.join(stats, "name", "left").join(health.select("name", "consecutive_failures"), "name", "left").select(
        "name", "enabled", *numbers, fails.alias("consec_fails"), tag.alias("health_tag")
    )
    return out.orderBy(F.desc("enabled"), F.desc("w7"), F.desc("w7_hi"), F.desc("total"), "name")
