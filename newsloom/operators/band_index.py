"""A stored index of titles for near-duplicate search from run to run, and document frequencies that are saved with it.

The index is a folder with two tables that are partitioned by the day of first sight: bands (one row for each of a
title's 32 MinHash bands, bucketed by the band's key) and entries (title key and words, bucketed by id).
candidates() joins a run's bands to the stored ones of the last hours: buckets let the stored side stay where it is, only
the run's rows are shuffled or, if few, broadcast. matched() reads the entries of those hours and compares in blocks. Old
days are deleted as folders.

Similarity is the TF-IDF cosine, for short titles under their threshold the Jaccard similarity. A term's weight
comes from the run's own items, ln(N / (1 + df)); terms that only stored titles have take the saved
frequencies, and terms unknown to both ln N.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import all_tokens
from newsloom.operators import blocks, dedup
from newsloom.operators.cosine import SHORT, scored
from newsloom.operators.entities import small
from newsloom.sources.tables import cut

BUCKETS = 16
#: fixed values: hours in which stored titles count, days for which they are kept
RECENT_HOURS, KEPT_DAYS = 72, 30
#: the row of saved frequencies that counts documents; no term is empty
ALL = ""


def merged(saved: DataFrame | None, words: DataFrame) -> DataFrame:
    """(term, df) with the documents (id, words) added; the row of the term '' counts the documents."""
    one = words.select(F.explode(F.array_distinct(F.concat("words", F.array(F.lit(ALL))))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return one if saved is None else saved.unionByName(one).groupBy("term").agg(F.sum("df").alias("df"))


def documents(saved: DataFrame | None) -> int:
    return 0 if saved is None else saved.where(F.col("term") == ALL).agg(F.sum("df")).first()[0] or 0


def idf(asked: DataFrame, session: DataFrame, saved: DataFrame | None) -> DataFrame:
    """(term, idf) of the terms asked: by the session's frequencies, else the saved ones, else ln of the session's documents."""
    n, all_saved = documents(session), documents(saved)
    own = session.select("term", F.log(F.lit(n) / (1 + F.col("df"))).alias("_own"))
    out = asked.select("term").distinct().join(own, "term", "left")
    if saved is not None:
        out = out.join(saved.select("term", F.log(F.lit(all_saved) / (1 + F.col("df"))).alias("_old")), "term", "left")
    known = ["_own", "_old"] if saved is not None else ["_own"]
    return out.select("term", F.coalesce(*known, F.log(F.lit(float(n or 1)))).alias("idf"))


class BandIndex:
    """The index below a folder; a session registers the tables that it finds there."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        name = uuid.uuid5(uuid.NAMESPACE_URL, f"{self.path} {spark.sparkContext.applicationId}").hex
        self.bands, self.entries = f"bands_{name}", f"entries_{name}"
        for table, columns, key in (
            (self.bands, "bucket BIGINT, id BIGINT, first_seen TIMESTAMP_NTZ, day DATE", "bucket"),
            (self.entries, "id BIGINT, title_key STRING, words ARRAY<STRING>, first_seen TIMESTAMP_NTZ, day DATE", "id"),
        ):
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY (day) CLUSTERED BY ({key}) INTO {buckets} BUCKETS"
                f" LOCATION '{self.path}/{table.split('_')[0]}'"
            )
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table.split('_')[0]}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
            spark.sql(f"MSCK REPAIR TABLE {table}")
        self.buckets = buckets

    def close(self) -> None:
        """Forget the tables; their files stay."""
        for table in (self.bands, self.entries):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def recent(self, table: str, since: str) -> DataFrame:
        """Rows first seen at `since` or later; earlier days are not read."""
        return self.spark.table(table).where((F.col("day") >= F.to_date(F.lit(since))) & (F.col("first_seen") >= F.lit(since).cast("timestamp_ntz")))

    def keys(self, items: DataFrame) -> DataFrame:
        """(bucket, id) of the bands of items (id, words)."""
        signed = dedup.signatures_of(items.select("id", F.array_distinct("words").alias("t")), "id")
        return dedup.bands(signed, "id").select(F.xxhash64("band", "bucket").alias("bucket"), "id")

    def candidates(self, keys: DataFrame, since: str) -> DataFrame:
        """(earlier, later): stored titles that share a band with an item. The stored bands are not shuffled."""
        stored = self.recent(self.bands, since).select("bucket", F.col("id").alias("earlier"))
        return stored.join(small(keys.withColumnRenamed("id", "later")), "bucket").select("earlier", "later").distinct()

    def seen(self, items: DataFrame, since: str) -> DataFrame:
        """Items (title_key) whose title is stored word for word."""
        hit = self.recent(self.entries, since).join(small(items.select("title_key").distinct()), "title_key").select("title_key").distinct()
        return items.join(hit, "title_key", "left_semi")

    def append(self, items: DataFrame) -> None:
        """Store items (id, title_key, words, first_seen)."""
        day = F.to_date("first_seen")
        rows = items.select("id", "title_key", "words", "first_seen", day.alias("day"))
        rows.repartition(self.buckets, "id").write.insertInto(self.entries)
        bands = self.keys(items).join(items.select("id", "first_seen", day.alias("day")), "id").select("bucket", "id", "first_seen", "day")
        bands.repartition(self.buckets, "bucket").write.insertInto(self.bands)

    def drop_before(self, day: str) -> None:
        """Delete the days before."""
        files = self.spark._jvm.org.apache.hadoop.fs
        for table in (self.bands, self.entries):
            for row in self.spark.sql(f"SHOW PARTITIONS {table}").collect():
                if row[0].split("=")[1] < day:
                    self.spark.sql(f"ALTER TABLE {table} DROP PARTITION (day = DATE '{row[0].split('=')[1]}')")
                    folder = files.Path(f"{self.path}/{table.split('_')[0]}/{row[0]}")
                    folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
            self.spark.catalog.refreshTable(table)


def matched(index: BandIndex, items: DataFrame, since: str, bar: Column, saved: DataFrame | None, part: int = blocks.NODES) -> DataFrame:
    """(id, status, match, similarity) of one run's items (id, title, title_key, first_seen); bar is a column of the later title.

    status: exact (its title is stored), stored (most like a stored title), batch (most like an earlier
    item of the run) or new. Of equal similarities stored titles come first, then the smaller id. Items of equal
    words are compared through their first. Pairs that share a band and reach the threshold are found by their weighted
    prefixes, block by block of `part` titles: bands alone let every title with the same common words meet.
    """
    exact = cut(index.seen(items, since).select("id"), "exact")
    rest = cut(items.join(exact, "id", "left_anti").select(
        "id", F.coalesce(all_tokens(F.col("title")), F.array().cast("array<string>")).alias("words"), bar.cast("double").alias("bar")
    ), "items")
    named = rest.withColumn("node", F.xxhash64(F.array_sort("words"), "bar"))
    firsts = named.where(F.size("words") > 0).groupBy("node").agg(F.min("id").alias("first"))
    nodes = cut(named.join(firsts, F.col("id") == F.col("first"), "left_semi").select("id", "words", "bar"), "nodes")
    stored = index.recent(index.entries, since).where(F.size("words") > 0).select("id", "words", F.lit(1.0).alias("bar"), F.lit(False).alias("new"))
    both = stored.unionByName(nodes.withColumn("new", F.lit(True))).withColumn("tags", F.array().cast("array<string>"))
    session = cut(merged(None, rest), "session")
    vectors = cut(blocks.packed(both, idf(both.select(F.explode("words").alias("term")), session, saved)), "vectors")
    least = nodes.agg(F.min("bar")).first()[0] or 1.0
    found = blocks.similar(vectors, blocks.signatures(both), least, (1.0, 1.0), SHORT, True, part, True)
    own = scored(found, SHORT).groupBy("later").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), F.when(F.col("known"), 0).otherwise(1).alias("rank"), "earlier")).alias("x")
    ).select(F.col("later").alias("first"), "x")
    # a copy takes its first, unless what the first took is as like
    members = named.join(firsts, "node", "left").join(own, "first", "left")
    itself = F.struct(F.lit(-1.0).alias("s"), F.lit(1).alias("rank"), F.col("first").alias("earlier"))
    x = F.when(F.col("id") == F.col("first"), F.col("x")).when(F.col("first").isNotNull(), F.least(F.coalesce("x", itself), itself))
    found = members.select("id", x.alias("x")).select(
        "id", F.when(F.col("x").isNull(), "new").when(F.col("x.rank") == 0, "stored").otherwise("batch").alias("status"),
        F.col("x.earlier").alias("match"), (-F.col("x.s")).alias("similarity")
    )
    plain = exact.select("id", F.lit("exact").alias("status"), F.lit(None).cast("bigint").alias("match"), F.lit(None).cast("double").alias("similarity"))
    return found.unionByName(plain)


def fold(index: BandIndex, items: DataFrame, as_of: str, bar: Column, saved: DataFrame | None, recent: int = RECENT_HOURS, kept: int = KEPT_DAYS) -> tuple[DataFrame, DataFrame]:
    """(decisions as of matched(), new saved frequencies) of one run.

    Items that are new or like a stored title are stored; those like another item of the run are not.
    Days older than `kept` days are deleted.
    """
    times = index.spark.sql(
        f"SELECT cast(timestamp_ntz'{as_of}' - make_dt_interval(0, {recent}, 0, 0) AS string), cast(to_date(timestamp_ntz'{as_of}' - make_dt_interval({kept}, 0, 0, 0)) AS string)"
    ).first()
    decided = cut(matched(index, items, times[0], bar, saved), "decided")
    words = F.coalesce(all_tokens(F.col("title")), F.array().cast("array<string>")).alias("words")
    kept_items = cut(items.join(decided.where("status in ('new', 'stored')").select("id"), "id").select("id", "title_key", words, "first_seen"), "kept")
    session = items.join(decided.where("status <> 'exact'").select("id"), "id").select("id", words)
    after = cut(merged(saved, session), "frequencies")
    index.append(kept_items)
    index.drop_before(times[1])
    return decided, after
