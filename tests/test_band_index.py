"""The stored band index: what a run finds of runs before it, what is kept, what is shuffled."""

import math
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import band_index

TITLES = "id bigint, title string, title_key string, first_seen timestamp_ntz"


def run_items(spark, rows):
    frame = spark.createDataFrame([(i, t, seen) for i, t, seen in rows], "id bigint, title string, seen string")
    return frame.select("id", "title", F.lower("title").alias("title_key"), F.col("seen").cast("timestamp_ntz").alias("first_seen"))


def decisions(frame):
    return {r.id: (r.status, r.match) for r in frame.collect()}


@pytest.fixture
def index(spark, tmp_path):
    found = band_index.BandIndex(spark, f"file://{tmp_path}/index", 4)
    yield found
    found.close()


def test_runs_see_what_was_stored(spark, index, tmp_path):
    long = "seven quiet rivers carry old timber past the northern mills"
    first = run_items(spark, [
        (1, long, "2024-01-10 00:00:00"), (2, long + " today", "2024-01-10 01:00:00"), (3, "another thing entirely happened there", "2024-01-01 00:00:00"),
        (4, None, "2024-01-10 00:00:00"), (5, "", "2024-01-10 00:00:00"), (6, "same words here again", "2024-01-10 00:00:00"), (7, "same words here again", "2024-01-10 00:00:00")
    ])
    decided, saved = band_index.fold(index, first, "2024-01-10 02:00:00", F.lit(0.6), None)
    assert decisions(decided) == {1: ("new", None), 2: ("batch", 1), 3: ("new", None), 4: ("new", None), 5: ("new", None), 6: ("new", None), 7: ("batch", 6)}
    assert {r.id for r in spark.table(index.entries).collect()} == {1, 3, 4, 5, 6}  # those like an item of the run are not stored
    # the tables are found again by another session's names
    again = band_index.BandIndex(spark, f"{index.path}/", 4)
    again.bands, again.entries = index.bands, index.entries
    second = run_items(spark, [
        (11, long.upper(), "2024-01-11 00:00:00"), (12, long + " now", "2024-01-11 00:00:00"), (13, "another thing entirely happened here", "2024-01-11 00:00:00"),
        (14, long + " now", "2024-01-11 00:00:00"), *((i, f"filler{i} only{i}", "2024-01-11 00:00:00") for i in range(20, 40))
    ])
    decided, saved = band_index.fold(again, second, "2024-01-11 02:00:00", F.lit(0.6), saved)
    # 3 is older than 72 hours; a copy of 12 has 12 itself at similarity 1
    assert {i: d for i, d in decisions(decided).items() if i < 20} == {11: ("exact", None), 12: ("stored", 1), 13: ("new", None), 14: ("batch", 12)}
    assert {r.id for r in spark.table(index.entries).collect()} == {1, 3, 4, 5, 6, 12, 13, *range(20, 40)}
    # after 30 days whole days go, with their files
    band_index.fold(again, second.limit(0), "2024-02-09 12:00:00", F.lit(0.6), saved)
    assert {r.id for r in spark.table(index.entries).collect()} == {1, 4, 5, 6, 12, 13, *range(20, 40)}
    assert not list((tmp_path / "index" / "entries").glob("day=2024-01-01*"))
    assert {r.id for r in spark.table(index.bands).select("id").distinct().collect()} == {1, 6, 12, 13, *range(20, 40)}


def test_stored_bands_are_not_shuffled(spark, index, monkeypatch):
    items = run_items(spark, [(i, f"title number {i} of many words {i % 7}", "2024-01-10 00:00:00") for i in range(50)])
    words = items.select("id", "title_key", F.split("title", " ").alias("words"), "first_seen")
    index.append(words)
    monkeypatch.setattr(band_index, "small", lambda d: d)
    asked = index.keys(words.withColumn("id", F.col("id") + 100))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = index.candidates(asked, "2024-01-08 00:00:00")
        rows = {(r.earlier, r.later) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(i, i + 100) for i in range(50)} <= rows
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "Bucketed: true" in line)
    assert "PartitionFilters: [isnotnull(day" in scan and "SelectedBucketsCount: 4 out of 4" in scan
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning(bucket") == 1  # the run's side only


def test_saved_frequencies_and_fallbacks(spark):
    def words(rows):
        return spark.createDataFrame(rows, "id bigint, words array<string>")

    saved = band_index.merged(None, words([(1, ["a", "b", "a"]), (2, ["b"]), (3, [])]))
    saved = band_index.merged(saved, words([(4, ["c"])]))
    assert {r.term: r.df for r in saved.collect()} == {"a": 1, "b": 2, "c": 1, "": 4}
    session = band_index.merged(None, words([(5, ["a", "x"]), (6, ["x"])]))
    asked = spark.createDataFrame([("a",), ("b",), ("x",), ("never",)], "term string")
    found = {r.term: round(r.idf, 9) for r in band_index.idf(asked, session, saved).collect()}
    assert found == {"a": round(math.log(2 / 2), 9), "b": round(math.log(4 / 3), 9), "x": round(math.log(2 / 3), 9), "never": round(math.log(2), 9)}
    assert {r.term: round(r.idf, 9) for r in band_index.idf(asked.where("term = 'b'"), session, None).collect()} == {"b": round(math.log(2), 9)}


def test_matching_a_run_writes_no_candidates(spark, tmp_path, monkeypatch):
    draw, written, cut = random.Random(3), {}, band_index.cut

    def counted(df, name):
        out = cut(df, name)
        written[name] = out.count()
        return out

    rows = [(i, " ".join(draw.sample([f"word{k}" for k in range(40)], 12)), f"k{i}", "2024-01-09 00:00:00") for i in range(300)]
    items = spark.createDataFrame(rows, "id bigint, title string, title_key string, t string").select("id", "title", "title_key", F.col("t").cast("timestamp_ntz").alias("first_seen"))
    index = band_index.BandIndex(spark, f"file://{tmp_path}/index")
    monkeypatch.setattr(band_index, "cut", counted)
    try:
        found = band_index.matched(index, items, "2024-01-08 00:00:00", F.lit(0.95), None)
        assert {r.status for r in found.collect()} == {"new"}
    finally:
        index.close()
    assert max(written.values()) <= 300  # pairs that shared a band were a table
