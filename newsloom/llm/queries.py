"""The registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm.shared import table


def op1_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.vptree import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"))


def op2_compression_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.compression_lang import predict

    return predict(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op4_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.boilerplate import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.winnowing import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.recompression import deduplicate

    return deduplicate(table(spark, sf_dir, "documents")).drop("kept")


def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.rules import predict

    return predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from newsloom.llm.arrow_tokens import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.jaccard import join

    return join(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form, root and near words."""
    from newsloom.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def op12_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every usable vector, its error and that of its label, and the codebooks' digest."""
    from newsloom.llm.filtering_lloyd import compress

    return compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and its ids decoded, as digests of both."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from newsloom.llm.byte_bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3, "op5_winnowing": OP5, "op6_recompression": OP6, "op7_warc": OP7, "op10_jaccard_join": OP10, "op11_spelling_variants": OP11, "op12_filtering_lloyd": OP12}


OP3 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS o
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS lesson, ((row_number() OVER (ORDER BY source NULLS LAST) - 1)
 % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight,
 source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))::DOUBLE
        / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
t AS (SELECT source, source_size, lesson, least(coalesce(max(CASE WHEN lvl <= most / weight THEN lvl END) OVER () * weight, most), most)
 AS target FROM l),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 0)::BIGINT AS start FROM d)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * size
        + greatest(0, least(size, floor(target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size)
 - start)))::BIGINT AS taken,
       round(CASE lesson WHEN 0 THEN CASE WHEN q < 1.0 THEN 1.5 - sqrt(greatest(0.0, 2.25 - 2.0 * q)) ELSE 1.0 END
         WHEN 1 THEN CASE WHEN 2.0 * q < 1.0 THEN (sqrt(1.0 + 16.0 * q) - 1.0) / 4.0 WHEN 2.0 * q < 2.0 THEN 0.5 + (3.0 - sqrt(greatest(0.0,
 9.0 - 8.0 * (2.0 * q - 1.0)))) / 4.0 ELSE 1.0 END
         ELSE CASE WHEN 3.0 * q < 3.0 THEN (sqrt(2.25 + 18.0 * q) - 1.5) / 3.0 ELSE 1.0 END END, 9) AS position
FROM (SELECT p.*, t.source_size, t.lesson, t.target, (CASE WHEN target > 0 THEN start / target ELSE 0.0 END)::DOUBLE AS q FROM p
 JOIN t ON p.source IS NOT DISTINCT FROM t.source)
"""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w, row_number() OVER () AS r FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT *, least(13, len(w)) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM n)),
dw AS (SELECT r, s.n, k, array_to_string(w[k:k + s.n - 1], ' ') AS g FROM (SELECT d.*, m.n, unnest(range(1, len(w) - m.n + 2)) AS k FROM d,
 (SELECT DISTINCT n FROM n) m) s),
hit AS (SELECT r, k, n, item FROM dw JOIN iw USING (n, g)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
t AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, row_number() OVER () AS r FROM documents),
g AS (SELECT r, k, hash(array_to_string(w[k:k + 34], ' ')) AS h, md5(array_to_string(w[k:k + 34], ' ')) AS g FROM (SELECT *, unnest(range(1,
 len(w) - 33)) AS k FROM d)),
again AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY h, g) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS p FROM again),
kept AS (SELECT u.r, string_agg(x, ' ' ORDER BY p) AS words, count(*) AS n FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p
 FROM d) u ANTI JOIN gone USING (r, p) GROUP BY u.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM d
 LEFT JOIN kept USING (r)
"""

OP7 = """
WITH d AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, max(page_id) OVER (PARTITION BY coalesce(html, ''))
 AS top FROM pages)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x,
 (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top > page_id THEN top END AS refers_to
FROM d
"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k
 FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
two AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT two.y, root FROM reach JOIN two ON reach.doc_id = two.x WHERE root < two.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM d JOIN reach USING (doc_id) LEFT
 JOIN n USING (doc_id) GROUP BY d.doc_id
"""


def _lloyd_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Plain Lloyd rounds: every part against every entry."""
    far = "list_sum(list_transform(list_zip(x.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS (SELECT x.r, x.p, min({far} * {entries} + b.k) AS best FROM x JOIN b{i} b ON x.p = b.p GROUP BY x.r, x.p)")
        if i < rounds:
            steps.append(
                f"m{i} AS (SELECT p, k, list(floor(s / n)::BIGINT ORDER BY j) AS q FROM (SELECT x.p, a.best % {entries} AS k, j, sum(x.q[j])::DOUBLE AS s,"
                f" count(*) AS n FROM x JOIN a{i} a ON x.r = a.r AND x.p = a.p, LATERAL (SELECT unnest(range(1, len(x.q) + 1)) AS j) GROUP BY ALL) GROUP BY p, k)"
            )
            steps.append(f"b{i + 1} AS (SELECT b.p, b.k, coalesce(m.q, b.q) AS q FROM b{i} b LEFT JOIN m{i} m ON b.p = m.p AND b.k = m.k)")
    joined = ",\n".join(steps)
    return f"""
WITH v AS (SELECT vec_id, label, embedding AS e, len(embedding) // {parts} AS w, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
 WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT r, p, list_transform(e[p * w + 1:p * w + w], lambda c: floor(256 * c::DOUBLE)::BIGINT) AS q FROM v, range({parts}) t(p)),
b0 AS (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY r) - 1)::BIGINT AS k, q FROM x QUALIFY k < {entries}),
{joined},
c AS (SELECT r, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r),
d AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (r), d
"""


OP12 = _lloyd_sql()

_RUN = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
 lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
r AS (SELECT doc_id, {_RUN} AS w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
 WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(concat(doc_id, ':', w), ''),
 lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))),
 lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM r, t),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2)
 ELSE w END AS word, n FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
open AS (SELECT word, n, left(word, i::INT) || ' ' || substr(word, i::INT + 2) AS k FROM places),
short AS (SELECT DISTINCT word, n, left(word, i::INT) || substr(word, i::INT + 2) AS k FROM places),
near AS (SELECT a.word, b.word AS w, b.n FROM open a JOIN open b ON a.k = b.k AND a.word <> b.word
 UNION ALL SELECT s.word, w.word, w.n FROM short s JOIN words w ON s.k = w.word
 UNION ALL SELECT w.word, s.word, s.n FROM short s JOIN words w ON s.k = w.word),
best AS (SELECT word, count(*) AS n_near, first(w ORDER BY n DESC, w) AS w, max(n) AS m FROM near GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN w END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
 FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON chain.root = f.word WHERE f.form IS NOT NULL)
SELECT f.*, root FROM f JOIN (SELECT word, root FROM chain JOIN (SELECT word AS root FROM f WHERE form IS NULL) USING (root)) USING (word)
"""
