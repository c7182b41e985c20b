"""Queries that write files and read them back: JSON lines, logs, configuration, archives, state tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import health, store
from newsloom.plans.briefing import ITEMS, items
from newsloom.plans.registry import query
from newsloom.sources import feeds, files
from newsloom.sources.tables import shared_dir, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("S19", "SELECT event_id, event_type FROM events WHERE event_id % 10 <> 0")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the lines is broken and dropped."""
    path = _folder(spark, "lines")
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("value"))
    e.select(
        F.when(F.col("event_id") % 10 == 0, F.expr("substring(value, 1, length(value) - 3)")).otherwise(F.col("value")).alias("value")
    ).write.text(path)
    return feeds.json_lines(spark, path, "event_id bigint, event_type string")


@query("S21, A16", """WITH l AS (SELECT CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'WARNING' END AS level, 'm' || user_id % 5 AS module,
 substr('took ' || event_id % 7 || ' of ' || repeat('x', 70), 1, 60) AS head, ts FROM events WHERE event_type IN ('error', 'view'))
SELECT level, module, head, count(*) AS n FROM l GROUP BY ALL ORDER BY n DESC, level, module, head LIMIT 30""")
def log_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines among others, parsed and rolled up."""
    path = _folder(spark, "log")
    e = table(spark, sf_dir, "events")
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.when(F.col("event_type") == "error", "ERROR").otherwise("WARNING"), F.lit("] m"),
        F.col("user_id") % 5, F.lit(": took "), F.col("event_id") % 7, F.lit(" of "), F.repeat(F.lit("x"), F.lit(70))
    )
    e.select(F.when(F.col("event_type").isin("error", "view"), line).otherwise(F.lit("  at some frame")).alias("value")).write.text(path)
    return health.error_rollup(feeds.log_lines(spark, path)).select("level", "module", "head", "n")


@query("S22", "SELECT n_name AS id, n_regionkey::INT AS tier, lower(n_name) || ',' || lower(r_name) AS keywords FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a registry of entities: one indented JSON file, read back."""
    path = _folder(spark, "registry")
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # a name for each region
    entry = F.struct(F.col("n_name").alias("id"), F.col("n_regionkey").alias("tier"), F.array(F.lower("n_name"), F.lower("r_name")).alias("keywords"))
    whole = F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list(entry).alias("entities")), {"pretty": "true"})
    n.agg(whole.alias("value")).write.text(path)
    return files.json_config(spark, path, "id: string, tier: int, keywords: array<string>", "entities").select("id", "tier", F.array_join("keywords", ",").alias("keywords"))


@query("S24", "SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes of one of two charsets, told apart; odd ids are in Latin-1 where that can hold them."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    latin = (F.col("doc_id") % 2 == 1) & ~F.col("text").rlike(r"[^\x{00}-\x{FF}]")
    raw = F.when(latin, F.encode(F.when(latin, F.col("text")), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return d.select("doc_id", F.md5(files.decoded(raw).cast("binary")).alias("digest"))


_ARCHIVE = """n AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN 'c' || o_custkey
 WHEN o_custkey % 3 = 1 THEN 'e' || o_orderkey ELSE 'l' || o_orderkey END AS key, o_orderkey, o_orderpriority AS title, o_orderdate AS seen,
 strftime(o_orderdate, '%Y-%m') AS month FROM orders),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seen, 'l' || o_orderkey) AS c FROM n WHERE month = '1998-01')
 WHERE c = 1 AND key NOT IN (SELECT key FROM n WHERE month = '1997-12'))"""


@query("K13, J16, S20", f"""WITH {_ARCHIVE} SELECT key AS i, strftime(seen, '%Y-%m-%d') AS d, substr(title, 1, 90) AS t,
 (o_orderkey % 5)::INT AS k, month AS m FROM k UNION ALL
SELECT key, strftime(seen, '%Y-%m-%d'), substr(title, 1, 90), (o_orderkey % 5)::INT, month FROM (SELECT *, row_number()
 OVER (PARTITION BY key ORDER BY seen, 'l' || o_orderkey) AS c FROM n WHERE month = '1997-12') WHERE c = 1""")
def archive_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two months go to the archive, the second twice: keys of this and the last month are not added again. The search rows of the whole."""
    path = _folder(spark, "archive")
    o, n = table(spark, sf_dir, "orders"), F.col("o_custkey") % 3
    rows = o.select(
        F.when(n == 0, F.concat(F.lit("c"), "o_custkey")).alias("canonical_event_id"), F.when(
            n == 1, F.concat(F.lit("e"), "o_orderkey")
        ).otherwise("").alias("event_id"), F.concat(F.lit("l"), "o_orderkey").alias("link"),
        F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 5).cast("int").alias("importance"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.keyed(rows).schema if f.name != "month")
    store.append_archive(files.keyed(rows.where("month = '1997-12'")), path, "month")
    for _ in range(2):
        there = files.months_of(spark, path, schema, None)
        store.append_archive(
            store.archive_new(files.keyed(rows.where("month = '1998-01'")), there, "key", "month", ["1998-01", "1997-12"]), path, "month"
        )
    return files.search_rows(files.months_of(spark, path, schema, None))


@query("S23, S20",
 """WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders ORDER BY month DESC LIMIT 6) SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN (SELECT month FROM m) GROUP BY 1""")
def newest_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest six months of an archive by month."""
    path = _folder(spark, "months")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    store.append_archive(o.repartition("month"), path, "month")
    return files.months_of(spark, path, "o_orderkey bigint").groupBy("month").agg(F.count("*").alias("n"))


@query("K14", """WITH v AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'correct'
 WHEN 'O' THEN 'wrong' ELSE 'partially' END AS verdict FROM orders WHERE o_orderkey % 5 <> 4)
SELECT count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'partially') AS partially, count(*)
 FILTER (verdict = 'wrong') AS wrong, 0::BIGINT AS unverifiable, round_even((count(*) FILTER (verdict = 'correct') + 0.5 * count(*)
 FILTER (verdict = 'partially')) / count(*) * 100, 0)::DOUBLE AS accuracy FROM v""")
def scorecard_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs append their verdicts to a JSON log; a verdict that is there is not added again."""
    path = _folder(spark, "scorecard")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.when(F.col("o_orderstatus") == "F", "correct").when(F.col("o_orderstatus") == "O", "wrong").otherwise("partially").alias("verdict")
    )
    o.where("key % 5 < 2").write.mode("append").json(path)
    for run in ("key % 5 < 3", "key % 5 < 4"):
        there = feeds.json_lines(spark, path, "key bigint, verdict string")
        store.insert_ignore(there, o.where(run), ["key"]).write.mode("append").json(path)
    log = feeds.json_lines(spark, path, "key bigint, verdict string").withColumn("group", F.lit("all"))
    return health.scorecard(log).drop("group")


@query("K15",
 f"""WITH {ITEMS} SELECT collected_at::DATE AS day, count(*) AS n, md5(string_agg(id || ':' || importance || ':' || cluster_size, ',' ORDER BY importance DESC, cluster_size DESC, id)) AS digest FROM i WHERE importance >= 3 GROUP BY 1""")
def digest_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily payloads as JSON files, read back."""
    path = _folder(spark, "digest")
    files.digest_payload(items(spark, sf_dir).where("importance >= 3")).write.partitionBy("day").json(path)
    back = spark.read.schema("n bigint, payload string, day date").json(path)
    each = F.from_json("payload", "items array<struct<id: bigint, title: string, importance: int, size: int>>")["items"]
    return back.select(
        "day", "n",
        F.md5(F.array_join(F.transform(each, lambda e: F.concat_ws(":", e["id"], e["importance"], e["size"])), ",").cast("binary")).alias("digest")
    )


@query("K19", "SELECT user_id AS name, count(*) AS runs FROM events GROUP BY 1")
def migrated_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old state in one JSON object per source becomes a table, once: a second migration changes nothing."""
    old, new = _folder(spark, "old"), _folder(spark, "new")
    table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("name")).agg(F.count("*").alias("runs")).write.json(old)
    rows = feeds.json_lines(spark, old, "name bigint, runs bigint")
    store.swap(rows, new)
    for _ in range(2):
        there = spark.read.schema("name bigint, runs bigint").parquet(new)
        store.insert_ignore(there, rows, ["name"]).write.mode("append").parquet(new)
    return spark.read.schema("name bigint, runs bigint").parquet(new)


@query(
    "K22",
    "SELECT user_id % 4 AS part, count(*) AS n, sum(CASE WHEN user_id % 4 = 1 THEN 0 ELSE event_id END)::BIGINT AS total FROM events GROUP BY 1"
)
def swapped_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition of a table is replaced whole; the others stay as they are."""
    path = _folder(spark, "state")
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("part"))
    store.swap(e, path, "part")
    store.swap(e.where("part = 1").withColumn("event_id", F.lit(0).cast("bigint")), path, "part")
    rows = spark.read.schema("event_id bigint, part bigint").parquet(path)
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@query("K18, K04", """SELECT doc_id AS id, CASE WHEN len(text) < 100 THEN 0 ELSE 1 END AS level FROM documents WHERE text IS NOT NULL""")
def cleaned_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses that hold nothing go back to level 0."""
    from newsloom.operators.analysis import polluted

    d = table(spark, sf_dir, "documents").where("text is not null").select(
        F.col("doc_id").alias("id"), F.lit(1).alias("level"), F.lit("").alias("background"), F.lit(None).cast("string").alias("deep"),
        F.col("text").alias("content")
    )
    reset = polluted(d).select("id", F.lit(0).alias("level")).distinct()
    return store.partial_update(d.select("id", "level"), reset, "id", ["level"])


@query("K17, J17", """WITH e AS (SELECT l_orderkey AS event_id, l_suppkey AS source FROM lineitem), many AS (SELECT event_id FROM e
 GROUP BY 1 HAVING count(DISTINCT source) >= 2), o AS (SELECT o_orderkey AS event_id FROM orders)
SELECT event_id FROM o WHERE event_id IN (SELECT event_id FROM many)""")
def remaining_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of events with one source is detached, and events without evidence go."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("source"))
    kept = e.groupBy("event_id").agg(F.count_distinct("source").alias("n")).where("n >= 2")
    evidence = store.without_orphans(e, kept)
    return store.without_orphans(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id")), evidence)
