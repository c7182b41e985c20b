"""Queries whose tasks must not grow with their tables."""

import re
from functools import partial

import pytest

from newsloom import plans
from newsloom.operators import dedup
from newsloom.plans import articles, reports, views
from newsloom.sources import tables

DATA = "/root/testdata/sf0.001"


def partitions(df) -> set[int]:
    """The partition counts of the shuffles on a table's own key."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {int(n) for n in re.findall(r"hashpartitioning\([lo]_orderkey#\d+L?, (\d+)\)", plan)}


@pytest.mark.parametrize("name", ["status_upgrade"])
def test_partitions_grow_with_the_lineitems(spark, monkeypatch, name):
    n = tables.table(spark, DATA, "lineitem").count()
    monkeypatch.setattr(views, "spread", partial(tables.spread, most=500))
    assert partitions(plans.queries()[name](spark, DATA)) == {-(-n // 500)}


def test_one_shuffle_serves_places_and_roles(spark, monkeypatch):
    n = tables.table(spark, DATA, "lineitem").count()
    monkeypatch.setattr(views, "spread", partial(tables.spread, most=500))
    plan = plans.queries()["event_roles"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\(([a-z_]+)#\d+L?, (\d+)\)", plan) == [("l_orderkey", str(-(-n // 500)))]
    assert plan.count("Exchange ") == 1


def test_partitions_of_insert_ignore_grow_with_the_lineitems(spark, monkeypatch):
    n = tables.table(spark, DATA, "lineitem").count()
    monkeypatch.setattr(reports, "spread", partial(tables.spread, most=500))
    plan = plans.queries()["insert_ignore"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert {int(k) for k in re.findall(r"Exchange hashpartitioning\([^()]*, (\d+)\)", plan)} == {-(-n // 500)}


def test_texts_leave_the_jvm_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 10_000)
        found = dedup.idf(spark.createDataFrame([(1, "caf\u00e9 noir"), (2, "cafe\u0301")], "id bigint, text string"), "id", "text")
        assert int(spark.conf.get(name)) <= tables.BATCH_ROWS
        assert {r.term: r.df for r in found.collect()} == {"caf\u00e9": 2, "noir": 1}
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("name", ["signal_match", "entity_rate_limit"])
def test_result_reads_no_text_again(spark, name):
    """What a query cut to keys is read from there; the documents' texts are no part of its last plan."""
    plan = plans.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan


def test_broken_json_reads_an_answer_once(spark, monkeypatch):
    n = tables.table(spark, DATA, "events").count()
    monkeypatch.setattr(articles, "spread", partial(tables.spread, most=100))
    plan = plans.queries()["broken_json"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1
    assert re.findall(r"Exchange hashpartitioning\(event_id#\d+L?, (\d+)\)", plan) == [str(-(-n // 100))]


def test_spread_tables_are_read_in_small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        for given, want in (("128m", str(tables.SPLIT_BYTES)), ("134217728b", str(tables.SPLIT_BYTES)), ("1m", "1m"), ("4096", "4096")):
            spark.conf.set(name, given)
            plans.queries()["event_roles"](spark, DATA)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)
