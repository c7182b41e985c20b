"""SQL of the similarity searches: every pair of texts that share a term is compared."""

from __future__ import annotations

from newsloom.functions.text import PRIME
from newsloom.operators import dedup
from newsloom.operators.cosine import DIGITS, SHORT

_MOD = f"{PRIME}::HUGEINT"


def words(column: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[\p{{L}}\p{{N}}_]+'), lambda t: len(t) > 1)"


def mostly_cjk(column: str) -> str:
    return rf"(len(regexp_extract_all({column}, '[\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{F900}}-\x{{FAFF}}]')) > 0.3 * len({column}))"


def hashes(n: int) -> str:
    """c: the coefficients of n hashes."""
    return "c(i, a, b) AS (VALUES " + ", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, (a, b) in enumerate(dedup.coefficients(n))) + ")"


def vectors(given: str, idf: str | None = None) -> str:
    """vec (id, term, w), norms (id, norm, n) of the table given (id, words); idf: another query for (term, idf)."""
    own = f"SELECT term, ln(any_value(n) / (1 + count(*))) AS idf FROM tf, (SELECT count(*) AS n FROM {given}) GROUP BY term"
    return f"""tf AS (SELECT id, term, count(*) AS c, sum(count(*)) OVER (PARTITION BY id) AS len
 FROM (SELECT id, unnest(words) AS term FROM {given}) GROUP BY id, term), idf AS ({idf or own}),
vec AS (SELECT id, term, c / len * idf AS w FROM tf JOIN idf USING (term)),
norms AS (SELECT id, sqrt(sum(w * w)) AS norm, count(*) AS n FROM vec GROUP BY id)"""


def minima(given: str) -> str:
    """sig (id, i, h) and band (id, band, bucket) of given (id, words)."""
    least = f"min(((c.a * (x % {_MOD})) % {_MOD} + c.b) % {_MOD} % 4294967296::HUGEINT)::BIGINT"
    return f"""{hashes(64)}, numbers AS (SELECT id, ('0x' || substr(md5(unnest(list_distinct(words))), 1, 16))::HUGEINT AS x FROM {given}),
sig AS (SELECT id, i, {least} AS h FROM numbers, c GROUP BY id, i),
band AS (SELECT id, i // 2 AS band, list(h ORDER BY i) AS bucket FROM sig GROUP BY id, band)"""


def scored(given: str, bar: str, score: str, minhash: bool = False, idf: str | None = None, where: str = "x.id < y.id") -> str:
    """pair (earlier, later, similarity, bar) of all pairs; bar is over e and l (given), score over cosine, jaccard, agreement, n."""
    near = f"""{minima(given)},
agree AS (SELECT earlier, later, (count(*) FILTER (x.h = y.h)) / 64 AS agreement FROM (SELECT DISTINCT x.id AS earlier, y.id AS later
 FROM band x JOIN band y USING (band, bucket) WHERE {where}) p JOIN sig x ON x.id = earlier JOIN sig y ON y.id = later AND y.i = x.i GROUP BY ALL),
""" if minhash else ""
    joined = "LEFT JOIN agree USING (earlier, later)" if minhash else ""
    return f"""{vectors(given, idf)}, {near}
dots AS (SELECT x.id AS earlier, y.id AS later, sum(x.w * y.w) AS dot, count(*) AS c FROM vec x JOIN vec y ON x.term = y.term AND {where} GROUP BY ALL),
met AS (SELECT earlier, later, CASE WHEN x.norm * y.norm > 0 THEN dot / (x.norm * y.norm) ELSE 0.0 END AS cosine, c / (x.n + y.n - c) AS jaccard,
 y.n AS n, {bar} AS bar, {"coalesce(agreement, 0.0)" if minhash else "0.0"} AS agreement FROM dots JOIN norms x ON x.id = earlier
 JOIN norms y ON y.id = later JOIN {given} e ON e.id = earlier JOIN {given} l ON l.id = later {joined}),
pair AS (SELECT earlier, later, cosine, round(sim, {DIGITS}) AS similarity, bar FROM (SELECT *, {score} AS sim FROM met)
 WHERE round(sim, {DIGITS}) >= round(bar, {DIGITS}))"""


#: the cosine, and for short titles under their threshold the Jaccard similarity
TITLE_SCORE = f"CASE WHEN round(cosine, {DIGITS}) < round(bar, {DIGITS}) AND n < {SHORT} THEN greatest(cosine, jaccard) ELSE cosine END"
#: the largest of all three
EVENT_SCORE = "greatest(cosine, jaccard, agreement)"
#: the best earlier text of each later one
BEST = (
    "best AS (SELECT later, earlier, similarity, cosine FROM (SELECT *, row_number() OVER (PARTITION BY later"
    " ORDER BY similarity DESC, earlier) AS place FROM pair) WHERE place = 1)"
)
