"""What runs leave and take up again: fuses, snapshots, finished items, log ends, search postings, page orders."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import analysis, briefing, ranking, search_index
from newsloom.sources import log_tail, snapshots

RESULT = "id bigint, content string, relevant boolean, error string"


def loop(errors: dict[int, str | None], waves: int) -> set[int]:
    """Ids that are tried, wave by wave."""
    ids, size, failed, tried = sorted(errors), max(1, -(-len(errors) // waves)), 0, set()
    for i in range(0, len(ids), size):
        part = ids[i : i + size]
        tried |= set(part)
        failed += sum(errors[k] is not None for k in part)
        if failed >= max(3, int(len(ids) * 0.3)) or any("429" in (errors[k] or "") for k in part):
            break
    return tried


@pytest.mark.parametrize(("rate", "limit_at"), [(0.0, None), (0.5, None), (0.1, 23), (0.9, None)])
def test_fuse_equals_a_loop(spark, rate, limit_at):
    draw = random.Random(3)
    errors = {i: "HTTP 429 slow down" if i == limit_at else "broken" if draw.random() < rate else None for i in range(40)}
    table = spark.createDataFrame(list(errors.items()), "id bigint, _error string").repartition(3)

    def analyse(items):
        return items.join(table, "id").select("id", F.lit("model").alias("content"), F.lit(True).alias("relevant"), F.col("_error").alias("error"))

    items = table.select("id")
    found = analysis.fused(items, analyse, [F.col("id").asc()], waves=8)
    tried = loop(errors, 8)
    assert {(r.id, r.error) for r in found.collect()} == {(i, errors[i]) for i in tried}
    assert analysis.fused(items.limit(0), analyse, [F.col("id").asc()]).count() == 0
    keyed = items.withColumn("url_key", F.col("id").cast("string"))
    cache = spark.createDataFrame([("0", "kept", True)], "url_key string, content string, relevant boolean").withColumn("created_at", F.current_timestamp())
    rules = lambda df: df.withColumn("content", F.lit("rule")).withColumn("relevant", F.lit(False))
    whole = analysis.tiered_fused(keyed, rules, cache, analyse, F.current_timestamp(), [F.col("id").asc()], waves=8)
    rest = loop({i: e for i, e in errors.items() if i}, 8)
    good = {i for i in rest if errors[i] is None}
    assert {r.id: (r.level, r.content, r.relevant) for r in whole.collect()} == {
        i: ("cache", "kept", True) if i == 0 else ("analysed", "model", True) if i in good else ("rules", "rule", False) for i in errors
    }


def test_damaged_versions_are_skipped(spark, tmp_path):
    path, schema = f"file://{tmp_path}/snap", "id bigint"
    assert snapshots.newest_whole(spark, path) is None and snapshots.load(spark, path, schema).count() == 0
    for n in range(9):
        assert snapshots.save(spark.range(n + 1).coalesce(1), path) == n + 1
    assert snapshots.versions(spark, path) == [9, 8, 7, 6, 5, 4, 3]  # seven are kept
    assert snapshots.load(spark, path, schema).count() == 9
    data = tmp_path / "snap" / "data"
    next((data / "v=9").glob("part-*.parquet")).unlink()  # missing
    changed = next((data / "v=8").glob("part-*.parquet"))
    raw = bytearray(changed.read_bytes())
    raw[len(raw) // 2] ^= 1  # one bit
    changed.write_bytes(raw)
    checksum = changed.with_name(f".{changed.name}.crc")
    assert {r.problem for r in snapshots.damage(spark, path, 8).collect()} == {"missing"}  # the file system refuses to read it
    checksum.unlink(missing_ok=True)
    (data / "v=7" / "part-extra.parquet").write_bytes(next((data / "v=7").glob("part-*.parquet")).read_bytes())
    problems = {v: {r.problem for r in snapshots.damage(spark, path, v).collect()} for v in (9, 8, 7, 6)}
    assert problems == {9: {"missing"}, 8: {"changed"}, 7: {"unknown"}, 6: set()}
    assert snapshots.load(spark, path, schema).count() == 6
    assert snapshots.restore(spark, path) == 6 and snapshots.versions(spark, path) == [6, 5, 4, 3]
    assert snapshots.save(spark.range(50), path) == 10  # damaged numbers are not used again
    assert snapshots.load(spark, path, schema).count() == 50


def test_a_stopped_run_goes_on(spark, tmp_path):
    path, schema = f"file://{tmp_path}/resume", "id bigint, by string"
    items, calls = spark.range(100), []

    def failing(rows):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("stopped")
        return rows.withColumn("by", F.lit("first"))

    with pytest.raises(RuntimeError):
        snapshots.resume(items, "id", failing, path, schema, parts=5)
    first = {r.id for r in snapshots.finished(spark, path, schema).collect()}
    assert 0 < len(first) < 100
    # results that were written but not committed do not count
    spark.range(500, 600).withColumn("by", F.lit("lost")).write.parquet(f"{path}/results/half")
    found = snapshots.resume(items, "id", lambda rows: rows.withColumn("by", F.lit("second")), path, schema, parts=5).collect()
    assert sorted(r.id for r in found) == list(range(100))
    assert {r.id for r in found if r.by == "first"} == first
    again = snapshots.resume(items, "id", lambda rows: rows.withColumn("by", F.lit("third")), path, schema)
    assert again.where("by = 'third'").count() == 0


def test_log_tail_starts_at_a_line(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_bytes(b"first line\nsecond\nthird\n")
    (tmp_path / "logs" / "b.log").write_bytes(b"only\r\nbad \xff byte")
    (tmp_path / "logs" / "c.log").write_bytes(b"")
    (tmp_path / "logs" / "_hidden").write_bytes(b"x\n")
    spark.dataSource.register(log_tail.LogTail)

    def tail(most):
        rows = spark.read.format("log_tail").option("bytes", most).load(f"file://{tmp_path}/logs").collect()
        return sorted((r.file.rsplit("/", 1)[1], r.value) for r in rows)

    assert tail(1000) == [("a.log", "first line"), ("a.log", "second"), ("a.log", "third"), ("b.log", "bad  byte"), ("b.log", "only")]
    assert tail(13) == [("a.log", "second"), ("a.log", "third"), ("b.log", "bad  byte")]  # second begins just there
    assert tail(12) == [("a.log", "third"), ("b.log", "bad  byte")]
    assert tail(3) == []

    reader = log_tail.LogTailReader(f"file://{tmp_path}/logs", 6)
    assert {(p.path.rsplit("/", 1)[1], p.start, p.size) for p in reader.partitions()} == {("a.log", 18, 24), ("b.log", 10, 16), ("c.log", 0, 0)}


def test_search_reads_postings_of_its_months(spark, tmp_path):
    draw = random.Random(2)
    rows = [
        (f"k{i}", f"2024-{1 + i % 4:02d}-{1 + i % 28:02d}", "".join(draw.choice("abAB é") for _ in range(draw.randrange(0, 30))), f"2024-{1 + i % 4:02d}")
        for i in range(400)
    ]
    frame = spark.createDataFrame(rows, "i string, d string, t string, m string")
    path = f"file://{tmp_path}/index"
    search_index.build(frame.where("m < '2024-03'"), path)
    search_index.build(frame.where("m >= '2024-03'"), path)
    entries = spark.read.schema("i string, d string, t string, m string").parquet(f"{path}/entries")
    postings = spark.read.schema("gram string, i string, m string").parquet(f"{path}/postings")
    for text in ("aba", "abab", "é a", "b", "BA", "", "aabb", "zzz"):
        for months in (["2024-02", "2024-04"], ["2024-01"]):
            found = [r.i for r in search_index.search(entries, postings, text, months, 1000).collect()]
            kept = [r for r in rows if text.lower() in r[2].lower() and r[3] in months]
            assert found == [r[0] for r in sorted(kept, key=lambda r: ([-ord(c) for c in r[1]], r[0]))]
    plan = search_index.search(entries, postings, "aba", ["2024-02"])._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "ReadSchema: struct<gram" in line)
    assert "PartitionFilters: [isnotnull(m" in scan and "EqualTo(gram,aba)" in scan
    search_index.manifest(entries, "2024-04-28", f"{path}/manifest")
    assert [r.value for r in spark.read.text(f"{path}/manifest").collect()] == ['{"months":["2024-04","2024-03","2024-02","2024-01"],"updated":"2024-04-28"}']


def test_page_order_puts_overflow_before_the_rest(spark):
    rows = [(i, 1 + i % 5, i % 5, i % 2 == 0) for i in range(30)]
    items = spark.createDataFrame(rows, "id bigint, importance int, reports int, today boolean")
    found = {(r.section, r.place): r.id for r in ranking.page_order(items, 4).collect()}
    bonus = {0: 0, 1: 0, 2: 0.5, 3: 0.8, 4: 1.0}
    ranked = sorted((r for r in rows if r[1] >= 3), key=lambda r: (-(r[1] + bonus[r[2]] + 0.7 * r[3]), r[0]))
    rest = [r[0] for r in rows if r[1] < 3]
    order = [r[0] for r in ranked]
    assert [found["featured", k + 1] for k in range(4)] == order[:4]
    assert [found["more", k + 1] for k in range(26)] == order[4:] + rest
    few = items.where("importance = 3").limit(2)
    assert {(r.section, r.place) for r in ranking.page_order(few, 4).collect()} == {("featured", 1), ("featured", 2)}


def test_rules_of_pages_and_repairs(spark):
    items = spark.createDataFrame([("s", 0, "b", 1), ("s", 1, "a", 1), ("s", None, "a", 2), ("t", 0, None, None)], "source_name string, importance int, audience string, tier int")
    stats = {r.source_name: (r.n, r.mean_importance, r.audiences, r.categories) for r in ranking.page_stats(items, "audience", "tier").collect()}
    assert stats == {"s": (3, 1.0, ["a", "b"], 2), "t": (1, None, [], 0)}
    sources = spark.createDataFrame([("a", True), ("b", None), ("c", False), ("d", True), ("e", True)], "name string, enabled boolean")
    health = spark.createDataFrame([("a", 20), ("b", 19), ("c", 50), ("d", 9)], "name string, consecutive_failures int")
    plan = briefing.repair_plan(sources, health, F.array(F.lit("u")))
    assert {r.name: (r.action, r.tries) for r in plan.collect()} == {"a": ("disable", None), "b": ("retry", ["u"])}


def test_important_days_are_local(spark):
    rows = [
        (1, 5, "2024-01-01 17:00:00", "2024-01-02 03:00:00", None), (2, 4, "2024-01-01 15:59:00", "2024-01-02 05:00:00", "am"), (3, 3, "2024-01-01 17:00:00", "2024-01-02 03:00:00", None),
        (4, 5, None, "2024-01-02 03:00:00", None), (5, 5, "2024-01-01 00:00:00", "2023-12-20 00:00:00", None)
    ]
    frame = spark.createDataFrame(rows, "id bigint, importance int, p string, r string, rendered_shift string")
    frame = frame.withColumn("published", F.col("p").cast("timestamp_ntz")).withColumn("rendered_at", F.col("r").cast("timestamp_ntz"))
    found = ranking.important_days(frame, "published", F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"), "Asia/Shanghai")
    assert {r.id: (r.day, r.time, r.page) for r in found.collect()} == {1: ("2024-01-02", "01:00", "2024-01-02-am"), 2: ("2024-01-01", "23:59", "2024-01-02-am")}


def test_judgments_have_a_key(spark):
    there = spark.createDataFrame([("d", "am", "A")], "date string, shift string, title string")
    found = spark.createDataFrame([("d", "am", " A "), ("d", "pm", "A"), ("d", "pm", "A"), ("d", None, "B"), ("d", "am", "  "), ("d", "am", None)], there.schema)
    assert {tuple(r) for r in search_index.new_judgments(there, found).collect()} == {("d", "pm", "A"), ("d", None, "B")}
