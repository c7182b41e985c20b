"""Operators on small fixtures: order-dependent folds, state, feeds, text functions, streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions import keys, scores, text
from newsloom.operators import dedup, entities, events, filters, graph, health, ranking, signals, store
from newsloom.sources import feeds
from newsloom.streaming import jobs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("https://www.x.com/a?b=1", "http://x.com/a", True), ("http://x.com/a/", "http://x.com/a", True), ("http://x.com/a", "http://x.com/b", False)]
)
def test_dedup_url(spark, a, b, same):
    assert (one(spark, keys.dedup_url(F.col("u")), u=a) == one(spark, keys.dedup_url(F.col("u")), u=b)) is same


def test_capitals_keep_length_as_sql_upper(spark):
    import duckdb

    for t in ("Straße ßung Üé", "ŉ ﬁ ᾳ ᾀ ΐ ƛ", "a\nb😀𐐨", ""):
        assert one(spark, text.capitals(F.col("t")), t=t) == duckdb.execute("SELECT upper(?::VARCHAR)", [t]).fetchone()[0]


def test_digest_of_a_section_with_sharp_s(spark, tmp_path):
    import duckdb

    from newsloom import plans

    rows = [(i, "ßlich gehen, und 12", "de", "src1", 18) for i in range(4)] + [(9 + i, "zu zweit", "de", "src2", 8) for i in range(5)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    found = sorted(map(tuple, plans.queries()["digest_sections"](spark, d).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{d}/documents.parquet/*.parquet'")
    assert found == sorted(con.execute(plans.oracle_sql()["digest_sections"]).fetchall()) and len(found) == 2


def test_keys(spark):
    assert one(spark, keys.dedup_url(F.col("u")), u="") == ""
    assert one(spark, keys.title_key(F.col("t")), t="A b\tC") == one(spark, keys.title_key(F.col("t")), t="abc")
    assert one(spark, keys.cache_url(F.col("u")), u="http://a.b/c?utm_x=1&d=2#e") == one(spark, keys.cache_url(F.col("u")), u="https://www.a.b/c?d=2")
    assert one(spark, keys.signal_url(F.col("u")), u="https://WWW.A.com:80/Path/?q") == "www.a.com/path"
    assert one(spark, keys.signature_key(F.col("s")), s="launch: OpenAI launch gpt") == "gpt launch openai"
    assert one(spark, keys.signature_key(F.col("s")), s="a b c d e") is None


@pytest.mark.parametrize(("given", "want"), [("<p>Hello</p>", "Hello"), ("A &amp; B", "A & B"), (" a\n\n<br/>b &#8217; ", "a b")])
def test_strip_html(spark, given, want):
    assert one(spark, text.strip_html(F.col("h")), h=given) == want


@pytest.mark.parametrize(
    ("given", "hours"),
    [
        ("3 days ago", 72), ("4w ago", 672), ("2 months ago", 1440), ("1 year ago", 8760), ("5 minutes ago", 5 / 60), ("", None), ("soon", None),
        ("3 days", None)
    ]
)
def test_relative_age(spark, given, hours):
    got = one(spark, text.relative_age_hours(F.col("t")), t=given)
    assert got == (None if hours is None else pytest.approx(hours))


@pytest.mark.parametrize("given", ["Mon, 05 Jan 2026 10:00:00 +0000", "2026-01-05T10:00:00Z", "Mon, 05 Jan 2026 10:00:00 GMT", "2026-01-05 10:00:00"])
def test_parse_date(spark, given):
    assert one(spark, text.parse_date(F.col("t")), t=given) == dt.datetime(2026, 1, 5, 10)
    assert one(spark, text.parse_date(F.col("t")), t="garbage") is None


def test_truncate(spark):
    cut = lambda t, n: one(spark, text.truncate_at_sentence(F.col("t"), n, "…"), t=t)
    assert cut("short", 10) == "short"
    assert cut("One. Two three four", 10) == "One.…"
    assert cut("x" * 200, 50) == "x" * 49 + "…"


def test_synonyms_and_scripts(spark):
    assert one(spark, text.fold_synonyms(F.col("t"), [["发布", "推出", "首发"]]), t="首发 新品 推出") == "发布 新品 发布"
    assert one(spark, text.mostly_cjk(F.col("t")), t="人工智能 ok") is True
    assert one(spark, text.mostly_cjk(F.col("t")), t="mostly latin 人") is False


def test_freshness_and_boost(spark):
    fresh = [one(spark, F.round(scores.freshness(F.col("h")), 4), h=float(h)) for h in (0, 12, 18, 24, 48, 1000)]
    assert fresh == [1.0, 1.0, 0.8, 0.6, 0.2921, 0.05]
    rows = spark.createDataFrame(
        [(1200, True, None, None), (600, False, None, None), (None, False, 600, 6000), (None, False, None, None)],
        "hn int, reddit boolean, hf int, github int"
    )
    assert [r.x for r in rows.select(scores.signal_boost(*(F.col(c) for c in rows.columns)).alias("x")).collect()] == [5, 4, 4, 0]


def test_causal_confidence(spark):
    rows = spark.createDataFrame([(0.65, 0, "high"), (0.5, 3, "low"), (0.9, 9, None), (1.0, 9, "high")], "h double, n int, l string")
    assert [r.x for r in rows.select(scores.causal_confidence(F.col("h"), F.col("n"), F.col("l")).alias("x")).collect()] == [0.575, 0.55, 0.8, 1.0]


def test_rate_limit_is_a_fold(spark):
    rows = [(i, ["a"] if i % 2 else ["a", "b"], i == 9, 1) for i in range(12)] + [(20, None, False, 1), (21, ["a"], False, 2)]
    df = spark.createDataFrame(rows, "id int, entities array<string>, protected boolean, day int")
    seen, want = {}, []
    for i, e, p, d in sorted(rows):
        ok = p or all(seen.get((d, x), 0) < 3 for x in e or [])
        for x in (e or []) if ok else []:
            seen[d, x] = seen.get((d, x), 0) + 1
        want += [i] * ok
    assert sorted(r.id for r in filters.entity_rate_limit(df, 3, "id").collect()) == want


def test_rate_limit_with_many_entities_and_null_days(spark):
    draw = random.Random(4)
    rows = [(i, draw.sample("abcdef", draw.randrange(0, 4)), draw.random() < 0.05, draw.choice([1, 2, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, entities array<string>, protected boolean, day int").repartition(5)
    seen, want = {}, []
    for i, e, p, d in rows:
        ok = p or all(seen.get((d, x), 0) < 4 for x in e)
        for x in e if ok else []:
            seen[d, x] = seen.get((d, x), 0) + 1
        want += [i] * ok
    assert sorted(r.id for r in filters.entity_rate_limit(df, 4, "id").collect()) == want


def test_rate_limit_deals_a_long_day_to_many_tasks(spark):
    df = spark.range(0, 300_000, 1, 8).selectExpr("id", "array('hot', concat('e', id % 1000)) as entities", "false as protected", "1 as day")
    assert [r.id for r in filters.entity_rate_limit(df, 5, "id").collect()] == [0, 1, 2, 3, 4]


def test_quota(spark):
    kind = "id int, tier int, source_name string, protected boolean"
    for sizes in ((0, 300, 300), (200, 100, 100), (40, 10, 500)):
        rows = [(t * 1000 + k, t, f"s{k}", False) for t, n in enumerate(sizes) for k in range(n)] + [(9999, 7, "s", False)]
        got = filters.tiered_quota(spark.createDataFrame(rows, kind), 250, 60, [F.col("id")]).groupBy("tier").count().collect()
        n0, k1 = sizes[0], min(sizes[1], max(60, (250 - sizes[0]) // 2))
        want = {0: n0, 1: k1, 2: min(sizes[2], 250 - n0 - k1)}
        assert {r.tier: r["count"] for r in got} == {t: n for t, n in want.items() if n > 0}
    one_source = [(100 * t + k, t, "hot", k == 30) for t in (0, 1, 2) for k in range(40)]
    got = filters.tiered_quota(spark.createDataFrame(one_source, kind), 250, 60, [F.col("id")]).groupBy("tier").count().collect()
    assert {r.tier: r["count"] for r in got} == {0: 16, 1: 9, 2: 9}


def test_shift_suppression(spark):
    t = dt.datetime(2026, 1, 1, 6)
    h = dt.timedelta(hours=1)
    rows = [(1, None, None), (2, t - h, None), (3, t + h, None), (4, t + h, t + 2 * h), (5, t + h, t), (6, t, None)]
    df = spark.createDataFrame(rows, "id int, rendered_at timestamp, last_updated_at timestamp")
    assert sorted(r.id for r in filters.not_rendered(df, F.lit(t)).collect()) == [1, 2, 4]


def test_substantial(spark):
    rows = [
        (1, "x" * 20, 0, ["d" * 10, "e" * 10], "", "", ""), (2, "x" * 20, 0, ["d" * 10], "bg", "", ""), (3, "x" * 20, 1, None, "bg", "", ""),
        (4, "x" * 20, 1, [], "", "", ""), (5, "x", 1, [], "bg", "", "")
    ]
    df = spark.createDataFrame(
        rows, "id int, summary string, level int, key_details array<string>, background string, deep_analysis string, detailed_content string"
    )
    assert sorted(r.id for r in filters.substantial(df).collect()) == [1, 3]


def test_store(spark):
    old = spark.createDataFrame(
        [("a", "t", None, "collected"), ("b", "t", "s", "analyzed")], "id string, title string, summary string, status string"
    )
    new = spark.createDataFrame([("a", None, "n"), ("b", "x", "x"), ("c", "y", None)], "id string, title string, summary string")
    got = {r.id: tuple(r)[1:] for r in store.upsert(old, new, "id", ["title", "summary"]).collect()}
    assert got == {"a": ("t", "n", "collected", False), "b": ("t", "s", "analyzed", False), "c": ("y", None, "collected", True)}
    again = store.insert_ignore(new.select("id"), new.select("id"), ["id"])
    assert again.count() == 0
    assert [
        tuple(r) for r in store.partial_update(old, new, "id", ["title"]).orderBy("id").select("id", "title").collect()
    ] == [("a", "t"), ("b", "x")]


def test_archive_crosses_the_year(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "2026-01"), ("k2", "2026-01")], "key string, month string")
    store.append_archive(spark.createDataFrame([("k1", "2025-12"), ("k2", "2025-10")], "key string, month string"), f"{tmp_path}/a", "month")
    archive = spark.read.schema("key string, month string").parquet(f"{tmp_path}/a")
    fresh = store.archive_new(rows, archive, "key", "month", ["2026-01", "2025-12"])
    assert [r.key for r in fresh.collect()] == ["k2"]


def test_status_never_falls(spark):
    rows = [
        (1, "a", 2, "x"), (2, "a", 1, "x"), (2, "b", 2, "x"), (3, "a", 0, "x"), (4, "a", 2, "official"), (5, "a", 2, "x"), (5, "b", 2, "x"),
        (5, "c", 2, "x"), (6, "a", 1, "x"), (6, "b", 2, "x"), (6, "c", 2, "x"), (7, "", 2, "x"), (7, "a", 2, "x"), (8, "a", 1, None)
    ]
    new = events.status(spark.createDataFrame(rows, "event_id int, source_name string, source_tier int, role string"))
    # two sources report, three low ones too, three with a better one confirm; one source or a nameless second changes nothing
    assert {r.event_id: r.level for r in new.collect()} == {2: 1, 3: 3, 4: 3, 5: 1, 6: 2}
    old = spark.createDataFrame([(1, 3), (2, 0), (6, 3), (9, 2)], "event_id int, level int")
    assert {r.event_id: r.level for r in events.upgraded(old, new).collect()} == {1: 3, 2: 1, 3: 3, 4: 3, 5: 1, 6: 3, 9: 2}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100}


def test_components_of_a_shuffled_chain(spark):
    names = random.Random(3).sample(range(10**6), 2000)
    edges = spark.createDataFrame(list(zip(names, names[1:])) + [(-1, -2), (-3, -2), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**dict.fromkeys(names, min(names)), -1: -3, -2: -3, -3: -3}


def test_minhash_finds_reworded_titles(spark):
    titles = [
        (1, "openai releases the new gpt model for everyone today in europe"), (2, "openai releases the new gpt model for everyone today in asia"),
        (3, "something else entirely happened far away from here")
    ]
    df = spark.createDataFrame(titles, "id int, title string")
    signed = dedup.signatures(df, "id", "title", 64)
    pairs = dedup.agreement(dedup.candidates(dedup.bands(signed, "id", 2), "id"), signed, "id")
    assert [(r.earlier, r.later) for r in pairs.where("agreement > 0.6").collect()] == [(1, 2)]
    assert [(r.later, r.earlier) for r in dedup.best_earlier(dedup.similar(df, "id", "title", 0.6), 0.6).collect()] == [(2, 1)]
    same = spark.createDataFrame([(1, 2)], "earlier int, later int")
    more = df.union(spark.createDataFrame([(k, f"filler words number{k}") for k in range(10, 30)], "id int, title string"))
    assert dedup.tfidf_cosine(more, same, "id", "title").first().cosine > 0.4
    assert dedup.tfidf_cosine(df, same, "id", "title").first().cosine == 0  # every shared term has idf ln(3/3)


def test_minhash_matches_the_formula(spark):
    import hashlib

    rows = [(1, "alpha beta gamma"), (2, None), (3, "a - !"), (4, "gamma"), (5, "模型发布 alpha")]
    got = {r.id: r.signature for r in dedup.signatures(spark.createDataFrame(rows, "id int, t string"), "id", "t", 8).collect()}

    def least(*words):
        return [
            min(((a * int(hashlib.md5(w.encode()).hexdigest()[:16], 16) + b) % text.PRIME) & 0xFFFFFFFF for w in words) for a,
            b in dedup.coefficients(8)
        ]

    none = [dedup.NO_TOKEN] * 8
    assert got == {1: least("alpha", "beta", "gamma"), 2: none, 3: none, 4: least("gamma"), 5: least(*"模型发布", "模型", "型发", "发布", "alpha")}


def test_tokens_of_both_scripts(spark):
    cases = {"GPT－５ 发布 a": ["gpt", "发", "布", "发布"], "x上线y ｆｕｌｌ": ["发", "布", "发布", "full"], "ｅ\u0301té ab": ["été", "ab"], "": []}
    for said, want in cases.items():
        assert one(spark, text.all_tokens(F.col("t"), [["发布", "上线"]]), t=said) == want, said
    assert one(spark, text.keywords(F.col("t")), t="The GPT-5 of 模型发布 and 的 is x a1") == ["gpt-5", "a1", "模型发布"]


@pytest.mark.parametrize("least", [0.5, 0.7])
def test_similar_finds_every_pair(spark, least):
    draw = random.Random(9)
    rows = []
    for i in range(120):
        base = [
            f"w{draw.randrange(12)}" for _ in range(draw.randrange(1, 9))
        ] if i % 3 else rows[draw.randrange(len(rows))][1].split() if rows else ["w1"]
        rows.append((i, " ".join(base + [f"r{draw.randrange(3)}"] * (i % 2))))
    sets = {i: frozenset(t.split()) for i, t in rows}
    best = {}
    for later in sets:
        found = [(len(sets[e] & sets[later]) / len(sets[e] | sets[later]), -e) for e in range(later)]
        found = [f for f in found if f[0] >= least]
        if found:
            best[later] = -max(found)[1]
    df = spark.createDataFrame(rows, "id int, title string")
    assert {r.later: r.earlier for r in dedup.best_earlier(dedup.similar(df, "id", "title", least), least).collect()} == best


def test_entity_action_keys(spark):
    cases = {
        "OpenAI launch GPT-5": "openai|publish", "open-ai will soon unveil it": "openai|publish", "字节跳动 raise money": "bytedance|funding",
        "zeta one two three four launch": None, "": None, "launch": None
    }
    for said, want in cases.items():
        assert one(spark, keys.entity_action_key(F.col("s")), s=said) == want, said


def test_images_and_guard(spark):
    rows = [(i, "http://x/c.png", [f"http://x/{i}.png"]) for i in range(3)] + [(3, "http://x/logo.png", None), (4, "http://x/u.png", None)]
    df = spark.createDataFrame(rows, "id int, image string, alternates array<string>")
    assert {r.id: r.image_used for r in ranking.images(df, "logo").collect()} == {
        0: "http://x/0.png", 1: "http://x/1.png", 2: "http://x/2.png", 3: "", 4: "http://x/u.png"
    }
    items = spark.createDataFrame([(k,) for k in "abcd"], "k string")
    assert ranking.storyline_guard(items, items.where("k in ('a', 'b')"), "k").count() == 2
    assert ranking.storyline_guard(items, items.where("k <> 'd'"), "k").count() == 4
    assert ranking.storyline_guard(items, items.limit(0), "k").count() == 4


def test_breaking_and_matching(spark):
    s = spark.createDataFrame(
        [
            (1, "hn", "X launches Y", 400), (2, "hn", "why X launches Y", 900), (3, "hn", "X launches Z", 100), (4, "hf", "X launches W", 2500),
            (5, "hn", "X launches V", 800)
        ],
        "sig_id int, source string, title string, points int"
    )
    pushed = spark.createDataFrame([(5,)], "sig_id int")
    got = signals.breaking(s, pushed, "(?i)^why", "(?i)launch", {"hn": 300, "hf": 2000})
    assert [r.sig_id for r in got.collect()] == [4, 1]
    kinds = "event_id int, url_key string, evidence_keys array<string>, title string, summary string, entity_tags array<string>"
    e = spark.createDataFrame([
        (1, "u1", [], "alpha beta gamma delta", "", []), (2, "u9", ["u2", "u3"], "nothing shared", "", None), (3, "", [], "claude alpha", "", []),
        (4, "", [], "", "beta gamma alpha", []), (5, "", None, "zzz", "", ["OMEGA"]), (6, "", [], "the alpha of beta", "", []),
    ], kinds)
    g = spark.createDataFrame(
        [(10, "hn", "u1", "other", 5), (11, "hn", "u2", "alpha beta gamma", 900), (12, "hf", "", "claude alpha maker/omegatron", 1)],
        "signal_id int, source string, url_key string, title string, score int"
    )
    got = {(r.event_id, r.source): (r.signal_id, r.rule) for r in signals.match(e, g).collect()}
    assert got == {
        (1, "hn"): (11, "title_keywords"), (2, "hn"): (11, "url_evidence"), (3, "hf"): (12, "title_brand"), (4, "hn"): (11, "title_keywords"),
        (5, "hf"): (12, "entity_in_title")
    }


def test_health(spark):
    at = dt.datetime(2026, 1, 1)
    runs = [("a", at, k, ok, took) for k, (ok, took) in enumerate([(True, 1.0), (True, 2.05), (False, 9.0), (False, 9.0), (True, 0.0), (False, 1.0)])]
    df = spark.createDataFrame(runs, "name string, at timestamp, seq int, ok boolean, took double")
    assert tuple(health.moving_average(df).first()) == ("a", 1.32, 1, 6)
    assert sorted(r.length for r in health.failure_runs(df).collect()) == [1, 2]
    v = spark.createDataFrame([("g", "correct"), ("g", "partially"), ("g", "wrong"), ("h", "unverifiable")], "group string, verdict string")
    assert {r.group: r.accuracy for r in health.scorecard(v).collect()} == {"g": 50.0, "h": None}


def test_entities(spark):
    registry = [
        {"id": "x", "tier": 0, "primary": ["s1"], "backup": [], "keywords": ["alpha"]},
        {"id": "y", "tier": 1, "primary": [], "backup": [], "keywords": ["beta"]}
    ]
    df = spark.createDataFrame(
        [(1, "Alpha BETA", "", "s9"), (2, None, None, "s1"), (3, "beta", "", "s2"), (4, "none", "", None)],
        "id int, title string, summary string, source_name string"
    )
    got = {r.id: (r.entities, r.protected) for r in entities.tag(df, registry).collect()}
    assert got == {1: (["x", "y"], True), 2: (["x"], True), 3: (["y"], False), 4: ([], False)}


RSS = '<?xml version="1.0"?><rss version="2.0" xmlns:media="http://x"><channel><title>c</title><item><title>One &amp; two</title><link>http://a/1?x=1&y=2</link><description><![CDATA[<p>Hello <b>x</b> &amp; y</p>]]></description><pubDate>Mon, 05 Jan 2026 10:00:00 +0000</pubDate><media:content url="http://i/1.png"/></item><item><title>Two</title><link>http://a/2</link></item></channel></rss>'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="http://b/1" rel="alternate"/><summary>s</summary><updated>2026-01-05T10:00:00Z</updated></entry></feed>'


def test_feeds(spark, tmp_path):
    rows = [("r", RSS), ("a", ATOM), ("bad", "not xml"), ("empty", ""), ("none", None), ("broken", "<rss><channel><item><title>x")]
    got = feeds.items(spark.createDataFrame(rows, "source_name string, xml string")).orderBy("source_name", "pos").collect()
    assert [(r.source_name, r.title, r.link) for r in got] == [
        ("a", "A", "http://b/1"), ("r", "One & two", "http://a/1?x=1&y=2"), ("r", "Two", "http://a/2")
    ]
    assert got[1].summary == "Hello x & y" and got[2].published is None and got[1].published == dt.datetime(2026, 1, 5, 10)
    (tmp_path / "x.xml").write_text(RSS)
    assert feeds.items(feeds.raw_files(spark, str(tmp_path))).count() == 2
    (tmp_path / "l.log").write_text("2026-01-05 10:00:00 [ERROR] mod: failed once\nnoise\n2026-01-05 10:00:01 [ERROR] mod: failed once\n")
    assert health.error_rollup(feeds.log_lines(spark, f"{tmp_path}/l.log")).first().n == 2
    (tmp_path / "h.jsonl").write_text('{"run_id": "1", "kept": 3}\nbroken\n')
    assert feeds.json_lines(spark, f"{tmp_path}/h.jsonl", schemas.RUN_HEALTH).where("kept = 3").count() == 1


def test_recent(spark):
    now = dt.datetime(2026, 1, 10)
    day = dt.timedelta(days=1)
    rows = [
        ("a", 0, now), ("a", 1, now - 9 * day), ("a", 2, None), ("b", 0, now - 9 * day), ("b", 1, now - 8 * day)
    ] + [("c", k, None) for k in range(6)] + [("d", k, now) for k in range(9)]
    got = feeds.recent(
        spark.createDataFrame(rows, "source_name string, pos int, published timestamp"), F.lit(now), 24, 5
    ).groupBy("source_name").count().collect()
    assert {r.source_name: r["count"] for r in got} == {"a": 2, "b": 2, "c": 3, "d": 5}


def test_conform(spark):
    df = schemas.conform(spark.createDataFrame([("r", 1)], "run_id string, extra int"), schemas.RUN_HEALTH)
    assert df.columns[:3] == ["run_id", "shift", "duration_sec"] and df.first().run_id == "r"


def test_stream_state_over_batches(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    schema = "name bigint, at timestamp, seq bigint, ok boolean, took double"
    for k, part in enumerate([[(1, at, 1, True, 1.0)], [(1, at, 2, True, 2.05), (1, at, 3, False, 1.0)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = jobs.run_available(jobs.health(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out{k}", "update")
        last = rows.orderBy(F.desc("runs")).first()
    assert (last.avg_time, last.failures, last.runs) == (1.32, 1, 3)


def test_upsert_sink_is_idempotent(spark, tmp_path):
    write = jobs.upsert_sink(f"{tmp_path}/t", "k", "v")
    first, second = (spark.createDataFrame(x, "k string, v int") for x in ([("a", 1), ("b", 1)], [("a", 2)]))
    write(first, 0)
    write(second, 1)
    write(second, 1)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/t/v=1").select("k", "v").collect()) == [("a", 2), ("b", 1)]


def test_tolerant_json(spark):
    from newsloom.functions import display

    read = display.tolerant_json(F.col("t"), "summary string, n bigint, tags array<string>")
    cases = {
        '{"summary": "a", "n": 1}': ("a", 1, None),
        'Here:\n```json\n{"summary": "a\nb\tc", "n": 2, "tags": ["x"]}\n``` bye': ("a\nb\tc", 2, ["x"]),
        '{"summary": "a \\"q\\" b", "n": 3}': ('a "q" b', 3, None),
        '{"summary": "cut", "n": 4, "tags": ["x", "y': ("cut", 4, ["x", "y"]),
        '{"summary": "cut", "n": 5, "tags"': ("cut", 5, None),
        '{"summary": "cut", "n": 6, "tags": ': ("cut", 6, None),
        "no object": None,
        "": None,
        None: None,
    }
    for said, want in cases.items():
        got = spark.createDataFrame([(said,)], "t string").select(read.alias("x")).first().x
        assert (tuple(got) if got else None) == want, said


def test_article_body_takes_the_longest(spark):
    from newsloom.functions import articles

    long, longer = "word " * 30, "text " * 40
    cases = {
        f"<article><p>{long}</p></article><div class='x'>{longer}</div>": long.strip(),
        f'<article>{long}</article><div class="post-content">{longer}</div>': longer.strip(),
        f'<script type="application/ld+json">{{"articleBody": "{longer}"}}</script><article>{long}</article>': longer.strip(),
        f"<p>{long}</p><p>short</p><p>{longer}</p>": long.strip() + "。" + longer.strip(),
        f"<nav><article>{longer}</article></nav><article>{long} Advertisement. Follow us on. end</article>": long.strip() + " end",
        "<article>too short</article>": "",
        None: "",
    }
    for page, want in cases.items():
        assert one(spark, articles.body(F.col("h").cast("string")), h=page or "") == want, page


def test_broken_pages_are_read_in_one_pass():
    import time

    from newsloom.functions import articles

    began = time.perf_counter()
    for page in ("<div " * 100_000, "<form>" * 100_000, "<div>" * 100_000 + "</p>" * 100_000, "<p>" * 100_000, "<!--" * 100_000, '<a "' * 50_000, "<" * 100_000):
        assert articles.text_of(page, 10) in ("", "<<<<<<<<<<")
        assert articles.pictures_of(page, "http://a.b", 4) == []
    assert time.perf_counter() - began < 30
    draw = random.Random(1)
    parts = ["<p>", "</p>", "<div class='content'>", "</div>", "<article>", "</ARTICLE>", "<script>", "</script>", "<!--", "-->", "<", ">", "text " * 10, "<img src='x.png'>", "&amp;", '"']
    for _ in range(500):
        page = "".join(draw.choice(parts) for _ in range(draw.randrange(30)))
        assert len(articles.text_of(page, 100)) <= 100


def test_pictures_are_whole_clean_and_distinct(spark):
    from newsloom.functions import articles

    page = '<meta property="og:image" content="//c.d/1.png"><article>' + "x" * 201 + '<img src="/2.png?a=1&amp;b=2"><img src="/logo.png"><img data-src="//c.d/1.png"></article><img src="/outside.png">'
    assert one(spark, articles.pictures(F.col("h"), F.lit("http://a.b/c/d?e")), h=page) == ["https://c.d/1.png", "http://a.b/2.png?a=1&b=2"]


def test_charsets_and_labels(spark):
    from newsloom.functions import display
    from newsloom.operators import analysis, briefing
    from newsloom.sources import files

    rows = [(1, "é 模型".encode()), (2, "é".encode("latin-1")), (3, b""), (4, None)]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, b binary").select("i", files.decoded(F.col("b")).alias("t")).collect()}
    assert got == {1: "é 模型", 2: "é", 3: "", 4: None}
    assert one(spark, analysis.chinese_ratio(F.col("t")), t="模型 ab 12") == 0.5 and one(spark, analysis.chinese_ratio(F.col("t")), t=" 12") == 1.0
    labels = {"openai": "OpenAI", "google": "Google", "meta": "Meta"}
    for title, want in {"Meta and Google and OpenAI ship GPT-5": "OpenAI | Google | GPT-5", "谷歌发布 openai": "", "nothing": ""}.items():
        assert one(spark, briefing.label_title(F.col("t"), labels, r"GPT-?\d\w*"), t=title) == want
    assert one(spark, display.relative_day(F.lit(dt.date(2026, 1, 1)), F.col("d")), d=dt.date(2026, 1, 4)) == "3 days ago"


def test_event_type_vote(spark):
    from newsloom.operators import briefing

    kind = "event_id int, pos int, source_type string, categories array<string>"
    rows = [(1, 0, "news", ["Launch day"]), (1, 1, "paper", []), (2, 0, "paper", ["x"]), (2, 1, "news", []), (3, 0, "", []), (4, 0, "news", ["融资"]), (4, 1, "news", ["监管", "policy"]), (5, 0, None, None)]
    got = {r.event_id: r.event_type for r in briefing.event_type(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: "product_launch", 2: "paper", 3: "news", 4: "regulation", 5: "news"}


def test_places_and_best_reports(spark):
    from newsloom.operators import briefing

    df = spark.createDataFrame([(i, (i * 37) % 11) for i in range(200)], "id int, k int").repartition(5)
    got = {r.id: r.place for r in ranking.placed(df, [F.desc("k"), F.col("id").asc()]).collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(((i, (i * 37) % 11) for i in range(200)), key=lambda x: (-x[1], x[0])), 1)}
    rows = [(1, 10, 0, "t" * 50, "", 2), (1, 11, 1, "t", "body", 2), (1, 12, 2, "t", "body", 2), (2, 20, 3, "t", "", 4), (2, 21, 4, "t" * 200, "body", 2)]
    members = spark.createDataFrame(rows, "cluster int, id int, pos int, title string, full_text string, authority int")
    assert {r.cluster: (r.id, r.size) for r in briefing.pick_best(members, F.col("authority")).collect()} == {1: (11, 3), 2: (20, 2)}
