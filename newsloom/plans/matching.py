"""Queries that match from run to run: the stored band index and saved document frequencies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import keys, text
from newsloom.operators import band_index
from newsloom.operators.cosine import DIGITS, SHORT
from newsloom.plans import similarity
from newsloom.plans.intake import ALIKE, ALIKE_CJK
from newsloom.plans.registry import query
from newsloom.plans.views import ARTICLES, articles
from newsloom.sources.tables import cut, shared_dir

#: three runs; an article belongs to run id % 3 and was first seen up to 119 hours before it
RUNS = ("2024-01-10 00:00:00", "2024-01-12 00:00:00", "2024-01-14 00:00:00")


def _run_sql(r: int) -> str:
    since = f"TIMESTAMP '{RUNS[r]}' - INTERVAL {band_index.RECENT_HOURS} HOUR"
    before = f"SELECT * FROM st{r - 1}" if r else "SELECT * FROM o WHERE FALSE"
    earlier = " UNION ALL ".join(f"SELECT term, df, 0 AS n FROM se{k} UNION ALL SELECT '', 0, count(*) FROM it{k}" for k in range(r)) or "SELECT '' AS term, 0 AS df, 0 AS n WHERE FALSE"
    return f"""w{r} AS (SELECT * FROM ({before}) WHERE seen >= {since}),
ex{r} AS (SELECT id FROM o WHERE id % 3 = {r} AND key IN (SELECT key FROM w{r})),
it{r} AS (SELECT * FROM o WHERE id % 3 = {r} AND id NOT IN (SELECT id FROM ex{r})),
se{r} AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(words)) AS term FROM it{r}) GROUP BY term),
old{r} AS (SELECT term, sum(df) AS df, sum(sum(n)) OVER () AS n FROM ({earlier}) GROUP BY term),
al{r} AS (SELECT id, words, 0 AS rank FROM w{r} UNION ALL SELECT id, words, 1 FROM it{r}),
co{r} AS (SELECT id, rank, term, count(*) AS c, sum(count(*)) OVER (PARTITION BY id) AS len FROM (SELECT id, rank, unnest(words) AS term FROM al{r}) GROUP BY id, rank, term),
ve{r} AS (SELECT id, rank, co.term, c / len * coalesce(ln((SELECT count(*) FROM it{r}) / (1 + se.df)), ln(old.n / (1 + old.df)),
 ln((SELECT count(*) FROM it{r}))) AS w FROM co{r} co LEFT JOIN se{r} se ON se.term = co.term LEFT JOIN old{r} old ON old.term = co.term),
no{r} AS (SELECT id, sqrt(sum(w * w)) AS norm, count(*) AS n FROM ve{r} GROUP BY id),
pa{r} AS (SELECT DISTINCT x.id AS earlier, e.rank, y.id AS later FROM band x JOIN band y USING (band, bucket) JOIN al{r} e ON e.id = x.id
 JOIN it{r} l ON l.id = y.id WHERE e.rank = 0 OR x.id < y.id),
do{r} AS (SELECT earlier, p.rank, later, sum(x.w * y.w) AS dot, count(*) AS c FROM pa{r} p JOIN ve{r} x ON x.id = earlier
 JOIN ve{r} y ON y.id = later AND y.term = x.term GROUP BY ALL),
si{r} AS (SELECT earlier, rank, later, y.n, bar, round(CASE WHEN x.norm * y.norm > 0 THEN dot / (x.norm * y.norm) ELSE 0.0 END, {DIGITS}) AS cosine,
 round(c / (x.n + y.n - c), {DIGITS}) AS jaccard FROM do{r} JOIN no{r} x ON x.id = earlier JOIN no{r} y ON y.id = later JOIN o ON o.id = later),
be{r} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY later ORDER BY s DESC, rank, earlier) AS place FROM (SELECT *,
 CASE WHEN cosine < bar AND n < {SHORT} THEN greatest(cosine, jaccard) ELSE cosine END AS s FROM si{r}) WHERE s >= bar) WHERE place = 1),
de{r} AS (SELECT id, {r} AS run, CASE rank WHEN 0 THEN 'stored' WHEN 1 THEN 'batch' ELSE 'new' END AS status, earlier AS match, s AS similarity
 FROM it{r} LEFT JOIN be{r} ON later = id UNION ALL SELECT id, {r}, 'exact', NULL, NULL FROM ex{r}),
st{r} AS ({before} UNION ALL SELECT o.* FROM o JOIN de{r} USING (id) WHERE status IN ('new', 'stored'))"""


_RUNS_SQL = f"""WITH {ARTICLES}, o AS (SELECT id, regexp_replace(lower(coalesce(title, '')), '[ \t\n\r\f\x0b]+', '', 'g') AS key,
 {similarity.words("title")} AS words, CASE WHEN {similarity.mostly_cjk("title")} THEN {ALIKE_CJK} ELSE {ALIKE} END AS bar,
 ([{", ".join(f"TIMESTAMP '{t}'" for t in RUNS)}])[(id % 3 + 1)::INT] - to_hours((id * 7 % 120)::INT) AS seen FROM a),
{similarity.minima("o")}, {", ".join(map(_run_sql, range(len(RUNS))))}"""


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(decisions of all runs, saved frequencies after them)."""
    hours = F.expr("make_dt_interval(0, cast(id * 7 % 120 as int), 0, 0)")
    run = F.get(F.array(*(F.lit(t).cast("timestamp_ntz") for t in RUNS)), (F.col("id") % 3).cast("int"))
    items = articles(spark, sf_dir).select("id", "title", keys.title_key(F.col("title")).alias("title_key"), (run - hours).alias("first_seen"))
    bar = F.when(text.mostly_cjk(F.col("title")), ALIKE_CJK).otherwise(ALIKE)
    index, saved, out = band_index.BandIndex(spark, f"{shared_dir(spark)}/titles-{uuid.uuid4().hex}"), None, None
    for r, as_of in enumerate(RUNS):
        decided, saved = band_index.fold(index, items.where(F.col("id") % 3 == r), as_of, bar, saved)
        decided = decided.select("id", F.lit(r).alias("run"), "status", "match", F.round("similarity", 6).alias("similarity"))
        out = decided if out is None else out.unionByName(decided)
    index.close()
    return out, saved


@query("C01, J06, J07, P07", f"""{_RUNS_SQL} SELECT id, run, status, match, round(similarity, 6) AS similarity FROM de0
 UNION ALL SELECT id, run, status, match, round(similarity, 6) FROM de1 UNION ALL SELECT id, run, status, match, round(similarity, 6) FROM de2""")
def stored_title_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All articles in three runs, each matched with what the runs before it stored in the band index."""
    return _runs(spark, sf_dir)[0]


@query("P09, A26", f"""{_RUNS_SQL}, every AS (SELECT * FROM it0 UNION ALL SELECT * FROM it1 UNION ALL SELECT * FROM it2)
SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM every) / (1 + count(*))), 6) AS idf FROM (SELECT unnest(list_distinct(words)) AS term FROM every)
 GROUP BY term""")
def saved_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies as the three runs leave them, and the weights that they mean."""
    saved = cut(_runs(spark, sf_dir)[1], "frequencies")
    n = band_index.documents(saved)
    return saved.where(F.col("term") != band_index.ALL).select("term", "df", F.round(F.log(F.lit(n) / (1 + F.col("df"))), 6).alias("idf"))
