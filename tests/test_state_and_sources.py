"""Keyed cache state over restarts, and sources as plug-ins."""

import json
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from newsloom.sources import plugins
from newsloom.streaming import cache, jobs

OPERATIONS = "key string, at timestamp, seq bigint, kind string, content string, relevant boolean"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def put(spark, folder, rows, name):
    shaped = [(k, START + timedelta(days=d), s, kind, content, relevant) for k, d, s, kind, content, relevant in rows]
    spark.createDataFrame(shaped, OPERATIONS).coalesce(1).write.parquet(f"{folder}/{name}")


def test_cache_survives_a_restart(spark, tmp_path):
    source, target = tmp_path / "in", f"file://{tmp_path}/out"

    def run():
        stream = spark.readStream.schema(OPERATIONS).option("recursiveFileLookup", True).parquet(str(source))
        with cache.rocksdb(spark):
            rows = jobs.run_available(cache.lookups(stream), target)
        return {r.seq: (r.outcome, r.hits, r.misses) for r in rows.collect()}

    put(spark, source, [
        ("a", 0.1, 2, "get", None, None), ("a", 0, 1, "set", "text", True), ("b", 0, 3, "get", None, None), ("b", 1, 4, "set", "", True),
        ("c", 0, 5, "set", "", False), (None, 0, 6, "get", None, None)
    ], "one")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert run() == {2: ("hit", 1, 0), 3: ("miss", 0, 1), 6: ("miss", 0, 1)}
    put(spark, source, [
        ("a", 6.9, 10, "get", None, None), ("a", 7.2, 11, "get", None, None), ("a", 7.3, 12, "get", None, None), ("b", 2, 13, "get", None, None),
        ("b", 2.1, 14, "get", None, None), ("c", 3, 15, "get", None, None)
    ], "two")
    found = run()
    # an entry of the first run counts for seven days; a poor one goes at its first lookup; irrelevant ones need no content
    assert {k: v for k, v in found.items() if k >= 10} == {
        10: ("hit", 2, 0), 11: ("expired", 2, 1), 12: ("miss", 2, 2), 13: ("poor", 0, 2), 14: ("miss", 0, 3), 15: ("hit", 1, 0)
    }
    put(spark, source, [("d", 30, 20, "set", "x", True)], "three")
    run()
    put(spark, source, [("c", 31, 30, "get", None, None)], "four")
    assert run()[30][0] in ("miss", "expired")  # the timer has cleared it, or its age tells
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


class Held:
    """A value or map of the state in memory that counts its calls."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def __getattribute__(self, name):
        if name not in ("value", "map", "calls"):
            object.__setattr__(self, "calls", object.__getattribute__(self, "calls") + 1)
        return object.__getattribute__(self, name)

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def containsKey(self, key):  # noqa: N802
        return key in self.map

    def getValue(self, key):  # noqa: N802
        return self.map[key]

    def updateValue(self, key, value):  # noqa: N802
        self.map[key] = value

    def iterator(self):
        return iter(list(self.map.items()))


def test_cache_calls_the_state_per_key_not_per_row():
    entry, counts, timers = Held(), Held(), []
    handle = SimpleNamespace(getValueState=lambda *a: entry, getMapState=lambda *a: counts, registerTimer=timers.append)
    cached = cache.CacheProcessor()
    cached.init(handle)
    rows = [
        Row(at=START + timedelta(minutes=i), seq=i, kind="set" if i % 5 == 1 else "get", content="" if i % 10 == 1 else "x", relevant=True)
        for i in range(1000)
    ]
    out = [r for half in (rows[:500], rows[500:]) for r in cached.handleInputRows(("k",), iter(half[::-1]), None)]
    assert [r.outcome for r in out[:9]] == ["miss", "poor", "miss", "miss", "miss", "hit", "hit", "hit", "hit"]
    assert (len(out), out[-1].hits, out[-1].misses) == (800, 399, 401)
    assert entry.value == (cache._micros(START + timedelta(minutes=996)), True)
    assert entry.calls + counts.calls + len(timers) < 20


RSS = "<rss><channel><item><title>{0}</title><link>http://m/{0}#x</link><description>&lt;b&gt;bold&lt;/b&gt;  text</description><pubDate>Mon, 01 Jan 2024 0{1}:00:00 GMT</pubDate></item></channel></rss>"


@pytest.fixture
def folder(spark, tmp_path):
    plugins.register(spark)
    rows = [
        ("http", "s1", RSS.format("a", 1)), ("http", "s2", RSS.format("b", 5)), ("http", "s2", "<rss"), ("http", "s3", None), ("twitter", "t", RSS.format("p", 2)),
        ("youtube", "y", json.dumps({"videos": [{"videoId": "v1", "title": "V"}, {"title": "no id"}]})),
        ("youtube", "y2", "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>E</title><link href='http://y/e'/><updated>2024-01-01T00:00:00Z</updated></entry></feed>"),
        ("zhihu", "z", json.dumps({"data": [{"target": {"id": 7, "title": "Q", "excerpt": "x"}, "detail_text": "hot"}]})), ("xhs", "x", json.dumps({"notes": [{"id": "n", "desc": "D"}]})),
        ("hf-papers", "h", json.dumps([{"paper": {"id": "1.2", "title": "P", "publishedAt": "2024-01-02T00:00:00Z"}}])), ("wechat", "w", RSS.format("w", 3)),
        ("wewe-rss", "g", RSS.format("g", 4))
    ]
    frame = spark.createDataFrame([(k, s, "", START, p) for k, s, p in rows], "kind string, source_name string, url string, fetched_at timestamp, payload string")
    plugins.store(frame, f"file://{tmp_path}/raw")
    return f"file://{tmp_path}/raw"


def test_every_kind_has_its_format(spark, folder):
    found = {(r.kind, r.source_name, r.title, r.link) for r in plugins.read(spark, folder).collect()}
    assert found == {
        ("http", "s1", "a", "http://m/a#x"), ("http", "s2", "b", "http://m/b#x"), ("twitter", "t", "p", "https://x.com/p"),
        ("youtube", "y2", "E", "http://y/e"), ("zhihu", "z", "Q", "https://www.zhihu.com/question/7"),
        ("xhs", "x", "D", "https://www.xiaohongshu.com/explore/n"), ("hf-papers", "h", "P", "https://huggingface.co/papers/1.2"),
        ("wechat", "w", "w", "http://m/w#x"), ("wewe-rss", "g", "g", "http://m/g#x")
    }  # a payload with a broken part has no items
    summary = spark.read.format("news_http").load(folder).where("title = 'a'").first().summary
    assert summary == "bold text"
    wanted = spark.createDataFrame([("s1",), ("z",)], "source_name string")
    assert {r.source_name for r in plugins.read(spark, folder, wanted).collect()} == {"s1", "z"}


def test_filters_are_pushed_down(spark, folder):
    late = spark.read.format("news_http").load(folder).where(F.col("published") >= F.lit("2024-01-01 03:00:00+00:00").cast("timestamp"))
    assert [r.title for r in late.collect()] == ["b"]
    named = spark.read.format("news_http").load(folder).where("source_name = 's1'")
    assert [r.title for r in named.collect()] == ["a"]
    reader = plugins._Reader("http", folder)
    left = list(reader.pushFilters([plugins.EqualTo(("source_name",), "s1"), plugins.In(("source_name",), ("s1", "s2")), plugins.EqualTo(("title",), "a")]))
    assert reader.names == ["s1"] and len(left) == 1
    assert [row[2] for f in reader.partitions() for row in reader.read(f)] == ["a"]


def test_empty_folder_has_no_items(spark, tmp_path):
    plugins.register(spark)
    (tmp_path / "none").mkdir()
    assert plugins.read(spark, f"file://{tmp_path}/none").count() == 0
