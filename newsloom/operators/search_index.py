"""Substring search over archived titles by posting lists of trigrams, month by month.

postings (month, gram, i) is partitioned by month and sorted by gram, so a search reads the pages of its own grams
in its own months. An entry that contains the text has all its grams; those few entries are read and
compared. Texts under three characters have no grams: all titles of the months are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: characters of a title in the index, results of a search
TITLE, RESULTS = 90, 30


def grams(text: Column) -> Column:
    """Distinct runs of three characters of the lower-cased text."""
    low = F.lower(text)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda k: F.substring(low, k, F.lit(3)))
    return F.array_distinct(F.filter(each, lambda g: F.length(g) == 3))


def build(rows: DataFrame, path: str) -> None:
    """Append search rows (i, d, t, k, m): entries and postings below path, by month m."""
    rows.repartition("m").sortWithinPartitions("i").write.mode("append").partitionBy("m").parquet(f"{path}/entries")
    each = rows.select("m", F.explode(grams(F.col("t"))).alias("gram"), "i")
    each.repartition("m", F.substring("gram", 1, 1)).sortWithinPartitions("m", "gram").write.mode("append").partitionBy("m").parquet(f"{path}/postings")


def search(entries: DataFrame, postings: DataFrame, text: str, months: list[str], most: int = RESULTS) -> DataFrame:
    """Entries of the months whose title contains the text, case aside: latest first, `most` at most (a page of results)."""
    held = entries.where(F.col("m").isin(months))
    wanted = sorted({text.lower()[k : k + 3] for k in range(len(text) - 2)})
    if wanted:
        hits = postings.where(F.col("m").isin(months) & F.col("gram").isin(wanted)).groupBy("m", "i").agg(F.count_distinct("gram").alias("n"))
        held = held.join(hits.where(F.col("n") == len(wanted)).select("m", "i"), ["m", "i"], "left_semi")
    return held.where(F.contains(F.lower("t"), F.lit(text.lower()))).orderBy(F.desc("d"), "i").limit(most)


def manifest(entries: DataFrame, updated: str, path: str) -> None:
    """One JSON file of the months, newest first, and the run that added last."""
    months = F.reverse(F.array_sort(F.collect_set("m")))
    entries.agg(F.to_json(F.struct(months.alias("months"), F.lit(updated).alias("updated"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def new_judgments(there: DataFrame, found: DataFrame) -> DataFrame:
    """Judgments (date, shift, title, ...) that are not there by date, shift and title, each once; untitled ones are dropped."""
    from newsloom.functions.keys import judgment_key
    from newsloom.operators.store import insert_ignore

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_key", judgment_key(F.col("date"), F.col("shift"), F.col("title")))

    titled = found.withColumn("title", F.trim("title")).where("title <> ''")
    once = keyed(titled).groupBy("_key").agg(F.min(F.struct(*titled.columns)).alias("x")).select("_key", "x.*")
    return insert_ignore(keyed(there), once, ["_key"]).drop("_key")
