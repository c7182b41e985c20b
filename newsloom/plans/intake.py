"""Queries of the collecting step: keys, filters, quotas, tagging, rules, exact and near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import keys, scores, text
from newsloom.operators import cosine, dedup, entities, filters
from newsloom.plans import similarity
from newsloom.plans.registry import query
from newsloom.plans.views import ARTICLES, AS_OF, ENTITIES, TAGGED, articles, registry
from newsloom.sources.tables import cut, table

LEAD, DIGEST = "^(the|la|der) (and|que|die)", "(weekly|digest|license)"
KEYWORDS, CHINESE = "(tionhe|ungen|cióncon|eaude)", "(模型|芯片|ñosque)"
STRONG, MEDIUM, VERB = "(ingtion|keitver|aciónmente|menteau)", "(tion|keit|mente|eaux)", "(erhe|lichver|ndoci|ouaux)"
CATEGORIES = [("models", "ation"), ("chips", "keit"), ("policy", "mente"), ("business", "eaux"), ("tools", "ing"), ("research", "ung")]
TYPES = [("paper", "arxiv|abstract"), ("opinion", "think|opinion"), ("community", "forum|reddit"), ("video", "video|watch")]


@query("F02",
 f"""WITH {ARTICLES} SELECT id, tier FROM a WHERE collected_at IS NULL OR epoch(TIMESTAMP '{AS_OF}' - collected_at) / 3600 <= CASE WHEN tier IN (0, 1) THEN 16 ELSE 15 END""")
def tiered_age_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = articles(spark, sf_dir).withColumnRenamed("collected_at", "published")
    return filters.tiered_age(items, F.lit(AS_OF).cast("timestamp_ntz"), {0: 16, 1: 16}, 15).select("id", "tier")


@query(
    "F03",
    f"WITH {ARTICLES} SELECT id FROM a WHERE NOT (regexp_matches(coalesce(title, ''), '(?i){LEAD}') OR regexp_matches(coalesce(title, ''), '(?i){DIGEST}'))"
)
def roundup_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.roundup_free(articles(spark, sf_dir), f"(?i){LEAD}", f"(?i){DIGEST}").select("id")


@query("F04", f"""WITH {TAGGED}, x AS (SELECT *, lower(concat_ws(' ', title, substr(summary, 1, 300))) AS t FROM g)
SELECT id, tier FROM x WHERE tier <= 1 OR coalesce(id % 13 = 0, FALSE) OR coalesce(source_name IN ('src2', 'src9'), FALSE)
 OR coalesce(list_contains(entities, 'shipping'), FALSE) OR regexp_matches(t, '{KEYWORDS}') OR regexp_matches(t, '{CHINESE}')""")
def keyword_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = entities.tag(articles(spark, sf_dir), ENTITIES).withColumn("ai_only", F.col("id") % 13 == 0)
    return filters.keyword_prefilter(i, KEYWORDS, CHINESE, ["src2", "src9"]).select("id", "tier")


@query("W01", f"""WITH {ARTICLES}, r AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY collected_at DESC, id) AS n FROM a)
SELECT id, source_name FROM r WHERE n <= 8 OR tier = 0""")
def per_source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.per_source_cap(articles(spark, sf_dir), 8, [F.desc("collected_at"), F.col("id")], F.col("tier") == 0).select("id", "source_name")


@query("W02", f"""WITH {TAGGED}, s AS (SELECT *, list_contains(entities, 'shipping') AS protected, row_number()
 OVER (PARTITION BY source_name, tier ORDER BY importance DESC, id) AS k FROM g),
q AS (SELECT * FROM s WHERE k <= CASE tier WHEN 0 THEN 15 ELSE 8 END OR protected), c AS (SELECT count(*) FILTER (tier = 0) AS n0, count(*)
 FILTER (tier = 1) AS n1 FROM q),
k AS (SELECT n0, least(n1, greatest(60, floor((250 - n0) / 2))) AS k1 FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY importance DESC, id) AS n FROM q)
SELECT id, tier FROM r, k WHERE tier = 0 OR (tier = 1 AND n <= k1) OR (tier = 2 AND n <= 250 - n0 - k1)""")
def tiered_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.tiered_quota(entities.tag(articles(spark, sf_dir), ENTITIES), 250, 60, [F.desc("importance"), F.col("id")]).select("id", "tier")


@query("W03, P17", f"""WITH RECURSIVE {TAGGED}, r AS (SELECT id, collected_at::DATE AS day, entities, row_number()
 OVER (PARTITION BY collected_at::DATE ORDER BY id) AS n, list_contains(entities, 'shipping') AS protected,
 [{", ".join(f"list_contains(entities, '{e['id']}')" for e in ENTITIES)}] AS flags FROM g WHERE len(entities) > 0),
f AS (SELECT day, 0::BIGINT AS n, NULL::BIGINT AS id, FALSE AS ok, [{", ".join("0" for _ in ENTITIES)}]::BIGINT[] AS counts FROM (SELECT DISTINCT day FROM r)
 UNION ALL SELECT day, n, id, ok, CASE WHEN ok THEN list_transform(counts, lambda c, i: c + flags[i]::BIGINT) ELSE counts END FROM (SELECT r.day, r.n, r.id, flags,
 counts, protected OR len(list_filter(counts, lambda c, i: flags[i] AND c >= 5)) = 0 AS ok FROM f JOIN r ON r.day = f.day AND r.n = f.n + 1))
SELECT id, len(entities)::BIGINT AS n_entities FROM g WHERE len(entities) = 0 OR id IN (SELECT id FROM f WHERE ok)""")
def entity_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = entities.tag(articles(spark, sf_dir), ENTITIES).select(
        "id", "entities", "protected", F.date_trunc("day", F.col("collected_at").cast("timestamp")).cast("date").alias("day")
    )
    items = cut(tagged, "tagged")  # read for the rounds and twice for their result, without the texts
    return filters.entity_rate_limit(items, 5, "id").select("id", F.size("entities").cast("bigint").alias("n_entities"))


@query("P17, J09", f"WITH {TAGGED} SELECT id, array_to_string(entities, ',') AS entities, list_contains(entities, 'shipping') AS protected FROM g")
def entity_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.tag(articles(spark, sf_dir), ENTITIES).select("id", F.array_join("entities", ",").alias("entities"), "protected")


@query("A08", f"WITH {TAGGED} SELECT entity, count(*) AS n FROM (SELECT unnest(entities) AS entity FROM g) GROUP BY entity")
def entity_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.distribution(entities.tag(articles(spark, sf_dir), ENTITIES))


_REGISTRY_SQL = ", ".join(f"('{e['id']}', {e['tier']})" for e in ENTITIES)


@query("A11", f"""WITH {TAGGED}, r(entity, tier) AS (VALUES {_REGISTRY_SQL}), n AS (SELECT unnest(entities) AS entity FROM g)
SELECT r.entity, r.tier::INT AS tier, count(n.entity) AS n FROM r LEFT JOIN n USING (entity) GROUP BY ALL""")
def entity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.coverage(entities.tag(articles(spark, sf_dir), ENTITIES), registry(spark))


@query("A13, J14", f"""WITH o AS (SELECT 'src' || user_id AS name, max(event_id) FILTER (event_type <> 'error') AS good FROM events GROUP BY 1),
h AS (SELECT o.name, count(*) FILTER (event_id > coalesce(good, -1)) AS consecutive_failures FROM events e
 JOIN o ON o.name = 'src' || e.user_id GROUP BY 1),
r(id, name) AS (VALUES {", ".join(f"('{e['id']}', '{s}')" for e in ENTITIES for s in dict.fromkeys(e["primary"] + e["backup"]))}),
j AS (SELECT id, coalesce(consecutive_failures, 0) >= 1 AS down FROM r LEFT JOIN h USING (name))
SELECT id, count(*) FILTER (NOT down) AS ok, count(*) FILTER (down) AS down,
       CASE WHEN count(*) FILTER (down) = 0 THEN 'ok' WHEN count(*) FILTER (NOT down) = 0 THEN 'critical' ELSE 'degraded' END AS level
 FROM j GROUP BY id""")
def entity_source_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("src"), "user_id").alias("name"), "event_id", (F.col("event_type") != "error").alias("ok")
    )
    good = e.where("ok").groupBy("name").agg(F.max("event_id").alias("good"))
    health = e.join(good, "name", "left").groupBy("name").agg(
        F.count_if(F.col("event_id") > F.coalesce("good", F.lit(-1))).alias("consecutive_failures")
    )
    return entities.source_alert(registry(spark), health, 1)


_RULES = f"""c AS (SELECT *, lower(summary) AS x FROM a),
s AS (SELECT *, len(regexp_extract_all(x, '{STRONG}')) AS strong, len(regexp_extract_all(x, '{MEDIUM}')) AS medium, regexp_matches(x,
 '{VERB}') AS verb FROM c)"""


@query("F05, P20", f"""WITH {ARTICLES}, {_RULES}
SELECT id, strong::BIGINT AS strong, medium::BIGINT AS medium, coalesce(tier = 0 OR strong >= 1 OR medium >= 2 OR (tier <= 1
 AND medium >= 1), FALSE) AS relevant,
       greatest(1, least(5, round_even(CASE tier WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 ELSE 1.0 END + least(0.5 * strong, 1.5) + 0.5 * CASE
 WHEN source_name = 'src1' THEN 1.5 ELSE 0.0 END + CASE WHEN verb THEN 0.8 ELSE 0.0 END, 0)::INT))::INT AS rule_importance FROM s""")
def rule_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.lower("summary")
    s = articles(spark, sf_dir).withColumn("strong", F.regexp_count(x, F.lit(STRONG))).withColumn("medium", F.regexp_count(x, F.lit(MEDIUM)))
    relevant = (F.col("tier") == 0) | (F.col("strong") >= 1) | (F.col("medium") >= 2) | ((F.col("tier") <= 1) & (F.col("medium") >= 1))
    value = scores.rule_importance(F.col("tier"), F.col("strong"), F.when(F.col("source_name") == "src1", 1.5).otherwise(0.0), x.rlike(VERB))
    return s.select(
        "id", F.col("strong").cast("bigint"), F.col("medium").cast("bigint"), F.coalesce(relevant, F.lit(False)).alias("relevant"),
        value.alias("rule_importance")
    )


_CATS = ", ".join(f"({i}, '{n}', '{p}')" for i, (n, p) in enumerate(CATEGORIES))


@query("P18", f"""WITH {ARTICLES}, p(i, name, pattern) AS (VALUES {_CATS}),
n AS (SELECT id, i, name, len(regexp_extract_all(lower(summary), pattern)) AS k FROM a, p),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC, i) AS place FROM n WHERE k > 0)
SELECT a.id, coalesce(string_agg(name, ',' ORDER BY place) FILTER (place <= 2), 'other') AS categories FROM a LEFT JOIN r USING (id) GROUP BY a.id""")
def category_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.lower("summary")
    each = F.array(
        *(F.struct((-F.regexp_count(x, F.lit(p))).alias("k"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, p) in enumerate(CATEGORIES))
    )
    top = F.transform(F.slice(F.array_sort(F.filter(each, lambda c: c["k"] < 0)), 1, 2), lambda c: c["name"])
    return articles(spark, sf_dir).select("id", F.when(F.size(top) > 0, F.array_join(top, ",")).otherwise("other").alias("categories"))


_TYPE_SQL = " ".join(f"WHEN regexp_matches(lower(summary), '{p}') THEN '{n}'" for n, p in TYPES)


@query("P19", f"WITH {ARTICLES} SELECT id, CASE WHEN tier = 0 THEN 'official' {_TYPE_SQL} ELSE 'news' END AS source_type FROM a")
def source_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("tier") == 0, "official")
    for name, pattern in TYPES:
        kind = kind.when(F.lower("summary").rlike(pattern), name)
    return articles(spark, sf_dir).select("id", kind.otherwise("news").alias("source_type"))


@query("P04", f"""WITH {ARTICLES}, k AS (SELECT id, substr(sha256(regexp_replace(lower(coalesce(title, '')), '[ \\t\\n\\r\\f\\x0b]+', '',
 'g')), 1, 32) AS key FROM a)
SELECT key, min(id) AS id, count(*) AS copies FROM k GROUP BY key""")
def title_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).groupBy(keys.title_key(F.col("title")).alias("key")).agg(F.min("id").alias("id"), F.count("*").alias("copies"))


_U = "regexp_replace(trim(url), '/+$', '')"


@query("P04, §1.4", f"""SELECT page_id, substr(sha256(lower({_U})), 1, 32) AS article_key,
 substr(sha256(lower(regexp_replace(regexp_replace({_U}, '^https?://(www\\.)?', ''), '[?#].*$', ''))), 1, 32) AS dedup_key,
 substr(sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({_U}), '^https?://(www\\.)?',
 ''), '#.*$', ''), '([?&])(utm_[^=&]*|ref|fbclid|gclid|source|mc_[^=&]*)=[^&]*', '\\1', 'g'), '&+', '&', 'g'), '\\?&', '?', 'g'), '[?&]+$',
 '')), 1, 32) AS cache_key,
 lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) || lower(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1),
 '/+$', '')) AS signal_key FROM pages""")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", keys.article_id(u).alias("article_key"), keys.dedup_url(u).alias("dedup_key"), keys.cache_url(u).alias("cache_key"),
        keys.signal_url(u).alias("signal_key")
    )


_TOK = r"list_distinct(list_filter(regexp_extract_all(lower(summary), '[\p{L}\p{N}_]+'), lambda t: len(t) > 1))"


@query("P01, P09, A26", f"""WITH {ARTICLES}, t AS (SELECT unnest({_TOK}) AS term FROM a), n AS (SELECT count(*) AS n FROM a)
SELECT term, count(*) AS df, round(ln(any_value(n) / (1 + count(*))), 6) AS idf FROM t, n GROUP BY term""")
def token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.idf(articles(spark, sf_dir), "id", "summary").select("term", "df", F.round("idf", 6).alias("idf"))


_MIN_SQL = f"min(((c.a * (x % {text.PRIME}::HUGEINT)) % {text.PRIME}::HUGEINT + c.b) % {text.PRIME}::HUGEINT % 4294967296::HUGEINT)::BIGINT"
_WORDS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'), lambda t: len(t) > 1)"
_TITLE_TOK = f"list_distinct({_WORDS.format('title')})"


@query("P05", f"""WITH {ARTICLES}, t AS (SELECT id, ('0x' || substr(md5(unnest({_TITLE_TOK})), 1, 16))::HUGEINT AS x FROM a),
 {similarity.hashes(16)}, h AS (SELECT id, i::INT AS i, {_MIN_SQL} AS h FROM t, c GROUP BY id, i)
SELECT a.id, c.i::INT AS i, coalesce(h.h, 4294967295) AS h FROM a CROSS JOIN c LEFT JOIN h ON h.id = a.id AND h.i = c.i""")
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.signatures(articles(spark, sf_dir), "id", "title", 16).select("id", F.posexplode("signature").alias("i", "h"))


@query("P06, P07, J07", f"""WITH t AS (SELECT item_id AS id, ('0x' || substr(md5(unnest(list_distinct({_WORDS.format("text")}))), 1,
 16))::HUGEINT AS x FROM benchmark), {similarity.hashes(64)}, h AS (SELECT id, i, {_MIN_SQL} AS h FROM t, c GROUP BY id, i),
b AS (SELECT id, i // 2 AS band, list(h ORDER BY i) AS bucket FROM h GROUP BY id, band), p AS (SELECT DISTINCT x.id AS earlier,
 y.id AS later FROM b x JOIN b y USING (band, bucket) WHERE x.id < y.id)
SELECT earlier, later, round(count(*) FILTER (x.h = y.h) / 64, 6) AS agreement FROM p JOIN h x ON x.id = earlier JOIN h y ON y.id = later
 AND y.i = x.i GROUP BY earlier, later""")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that share one of 32 bands of two hashes, and how many of 64 hashes agree."""
    signed = dedup.signatures(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "id"), "id", "text")
    pairs = dedup.candidates(dedup.bands(signed, "id"), "id")
    return dedup.agreement(pairs, signed, "id").select("earlier", "later", F.round("agreement", 6).alias("agreement"))


#: similarity of titles, and of titles in Chinese characters
ALIKE, ALIKE_CJK = 0.6, 0.5


def distinct_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first article of each title; of its summary only the first character, as texts are not to be shuffled."""
    short = articles(spark, sf_dir).withColumn("summary", F.left("summary", F.lit(1)))
    return dedup.exact(short.withColumn("key", keys.title_key(F.col("title"))), "key", [F.col("id")])


def nearest_titles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Articles of distinct titles, and the best earlier one of each that has one: by cosine, short titles by shared words too."""
    first = distinct_titles(spark, sf_dir)
    bar = F.when(text.mostly_cjk(F.col("title")), ALIKE_CJK).otherwise(ALIKE)
    return first, cosine.best_earlier(cosine.pairs(cosine.texts(first, "id", "title", bar), ALIKE_CJK, best=True))


_TITLES = f"""{ARTICLES}, k AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(coalesce(title, '')), '[ \t\n\r\f\x0b]+', '',
 'g') ORDER BY id) AS copy FROM a),
o AS (SELECT id, title, lang, source_name, {similarity.words("title")} AS words,
 CASE WHEN {similarity.mostly_cjk("title")} THEN {ALIKE_CJK} ELSE {ALIKE} END AS bar FROM k WHERE copy = 1)"""
BEST = f"{_TITLES}, {similarity.scored('o', 'l.bar', similarity.TITLE_SCORE)}, {similarity.BEST}"


@query("J08", f"WITH {BEST} SELECT later, earlier, round(similarity, 6) AS similarity FROM best")
def near_duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of titles are searched, by a join of weighted prefixes; the SQL compares every pair."""
    return nearest_titles(spark, sf_dir)[1].select("later", "earlier", F.round("similarity", 6).alias("similarity"))


@query("C01, A24", f"""WITH RECURSIVE {BEST}, two AS (SELECT earlier AS x, later AS y FROM best UNION SELECT later, earlier FROM best),
 reach AS (SELECT id, id AS root FROM o UNION SELECT two.y, root FROM reach JOIN two ON reach.id = two.x WHERE root < two.y),
m AS (SELECT id, min(root) AS root FROM reach GROUP BY id), s AS (SELECT m.root, o.id, count(*) OVER (PARTITION BY m.root) AS size,
 row_number() OVER (PARTITION BY m.root ORDER BY (CASE source_name WHEN 'src1' THEN 4 WHEN 'src3' THEN 3 ELSE 2 END) * 3 + CASE
 WHEN lang = 'en' THEN 2 ELSE 0 END + least(len(title), 100) / 100 DESC, o.id) AS n FROM m JOIN o USING (id))
SELECT id, size FROM s WHERE n = 1""")
def two_layer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact titles once, then of each chain of near titles the best report."""
    from newsloom.operators.briefing import pick_best
    from newsloom.operators.graph import components

    first, best = nearest_titles(spark, sf_dir)
    roots = components(best.select(F.col("earlier").alias("a"), F.col("later").alias("b")))
    body = F.when(F.col("lang") == "en", F.col("summary")).otherwise("")
    members = first.join(roots, first["id"] == roots["node"], "left").select(
        F.coalesce("root", "id").alias("cluster"), "id", F.col("id").alias("pos"), "source_name", "title", body.alias("full_text")
    )
    return pick_best(members, F.when(F.col("source_name") == "src1", 4).when(F.col("source_name") == "src3", 3).otherwise(2)).select("id", "size")


@query("P10", f"""WITH {BEST} SELECT earlier, later, round(cosine, 6) AS cosine FROM best""")
def tfidf_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, pairs = nearest_titles(spark, sf_dir)
    pairs = cut(pairs, "pairs")
    return dedup.tfidf_cosine(first, pairs, "id", "title").select("earlier", "later", F.round("cosine", 6).alias("cosine"))


@query("P11, S04", r"""WITH s AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') AS t FROM pages),
r AS (SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'),
 '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '&#x?[0-9A-Fa-f]+;', '', 'g'), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS text FROM s)
SELECT page_id, len(text)::BIGINT AS chars, md5(text) AS digest FROM r""")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))
    return clean.select("page_id", F.length("text").cast("bigint").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("P27", "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(*) AS n FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.count("*").alias("n"))


@query(
    "P45, P23",
    "SELECT doc_id, greatest(1, least(30, floor(coalesce(len(text), 0) / 400)::INT))::INT AS minutes, len(split_part(text, '. ', 1))::BIGINT AS first_sentence FROM documents"
)
def reading_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.reading_minutes(F.coalesce(F.length("text"), F.lit(0))).alias("minutes"),
        F.length(F.split_part("text", F.lit(". "), F.lit(1))).cast("bigint").alias("first_sentence")
    )


@query("P21", r"""WITH s AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS s FROM (SELECT doc_id,
 regexp_split_to_array(text, '[.\n]') AS p FROM documents)),
t AS (SELECT doc_id, pos, trim(s, ' ') AS s FROM s WHERE len(trim(s, ' ')) >= 20),
k AS (SELECT *, CASE WHEN regexp_matches(s, '[0-9]') THEN 2.0 ELSE 0.0 END + CASE WHEN regexp_matches(lower(s), 'tion')
 THEN 1.0 ELSE 0.0 END + CASE WHEN len(s) BETWEEN 40 AND 200 THEN 0.5 ELSE 0.0 END AS score FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS place FROM k)
SELECT doc_id, place::INT AS place, pos::INT AS pos, score::DOUBLE AS score FROM r WHERE place <= 3""")
def key_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best sentences of a text; arrays of sentences stay in their row, so nothing is shuffled."""
    s = F.transform(F.split("text", r"[.\n]"), lambda x, i: F.struct(F.trim(x).alias("s"), i.alias("pos")))
    s = F.filter(s, lambda x: F.length(x["s"]) >= 20)
    score = lambda x: F.when(x.rlike("[0-9]"), 2.0).otherwise(0.0) + F.when(F.lower(x).rlike("tion"), 1.0).otherwise(0.0) + F.when(F.length(x).between(40, 200), 0.5).otherwise(0.0)
    best = F.slice(F.array_sort(F.transform(s, lambda x: F.struct((-score(x["s"])).alias("k"), x["pos"].alias("pos")))), 1, 3)
    out = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(best).alias("place", "x"))
    return out.select("doc_id", (F.col("place") + 1).alias("place"), "x.pos", (-F.col("x.k")).alias("score"))
