"""The weighted all-pairs join and what follows from it, against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsloom.operators import blocks, cosine, dedup, events, parts
from newsloom.plans import intake, reports

PRIME = (1 << 61) - 1


def some_texts(seed: int, n: int = 70) -> list[tuple]:
    """(id, text, bar, tags, new): common and rare words, copies, odd texts."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and draw.random() < 0.3:
            words = rows[draw.randrange(len(rows))][1].split()
            if words and draw.random() < 0.6:
                words[draw.randrange(len(words))] = f"new{draw.randrange(40)}"
        else:
            words = [draw.choice(["the", "of", "and"]) if draw.random() < 0.4 else f"word{draw.randrange(60)}" for _ in range(draw.randrange(1, 14))]
        rows.append((i, " ".join(words), draw.choice([0.4, 0.5]), draw.sample(["x", "y", "z"], draw.randrange(3)), i >= 20))
    return [*rows, (n, "", 0.4, ["x"], True), (n + 1, "!", 0.4, [], True), (n + 2, "the", 0.4, [], True), (n + 3, "the of", 0.5, ["x"], True)]


def plain(rows: list[tuple], factors: tuple, short: int | None, signatures: dict | None = None) -> dict:
    vectors = {r[0]: Counter(w for w in r[1].split() if len(w) > 1) for r in rows}
    df = Counter(t for v in vectors.values() for t in v)
    out = {}
    for e in rows:
        for l in rows:
            a, b = vectors[e[0]], vectors[l[0]]
            if e[0] >= l[0] or not l[4] or not a or not b:
                continue
            idf = {t: math.log(len(rows) / (1 + df[t])) for t in {*a, *b}}
            wa, wb = ({t: c / sum(v.values()) * idf[t] for t, c in v.items()} for v in (a, b))
            norm = math.sqrt(sum(x * x for x in wa.values())) * math.sqrt(sum(x * x for x in wb.values()))
            sim = sum(x * wb.get(t, 0) for t, x in wa.items()) / norm if norm else 0.0
            jac = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
            bar = l[2] * ((factors[0] if e[4] else factors[1]) if set(e[3]) & set(l[3]) else 1)
            if short is None or (round(sim, 9) < round(bar, 9) and len(b) < short):
                sim = max(sim, jac)
            if signatures:
                x, y = signatures[e[0]], signatures[l[0]]
                if any(x[i : i + 2] == y[i : i + 2] for i in range(0, 64, 2)):
                    sim = max(sim, sum(p == q for p, q in zip(x, y, strict=True)) / 64)
            if round(sim, 9) >= round(bar, 9):
                out[e[0], l[0]] = round(sim, 9)
    return out


def given(spark, rows):
    frame = spark.createDataFrame(rows, "key bigint, body string, own double, marks array<string>, fresh boolean").repartition(3)
    old, new = frame.where("not fresh"), frame.where("fresh")
    return cosine.texts(old, "key", "body", F.col("own"), "marks", False).unionByName(cosine.texts(new, "key", "body", F.col("own"), "marks"))


@pytest.mark.parametrize(("seed", "factors", "short", "minhash"), [
    (1, (1.0, 1.0), 10, False), (2, (0.7, 0.65), None, True), (3, (0.7, 0.65), None, False), (4, (0.8, 0.8), 4, False)
])
def test_all_pairs_and_best_earlier(spark, seed, factors, short, minhash):
    rows = some_texts(seed)
    texts = given(spark, rows)
    signatures = None
    if minhash:
        signed = dedup.signatures_of(texts.select("id", F.array_distinct("words").alias("t")), "id")
        signatures = {r.id: r.signature for r in signed.collect()}
    wanted = plain(rows, factors, short, signatures)
    found = cosine.pairs(texts, 0.4, factors, short, minhash, part=3)
    got = {(r.earlier, r.later): r.similarity for r in found.collect()}
    assert got.items() <= {k: pytest.approx(v) for k, v in wanted.items()}.items() or all(abs(wanted[k] - v) < 1e-8 for k, v in got.items())
    # copies stand behind their first only; no later text loses its best
    best = {}
    for (e, l), s in wanted.items():
        if l not in best or (s, -e) > (best[l][1], -best[l][0]):
            best[l] = (e, s)
    chosen = {r.later: (r.earlier, r.similarity) for r in cosine.best_earlier(found).collect()}
    assert chosen.keys() == best.keys()
    for later, (earlier, s) in best.items():
        assert chosen[later][1] == pytest.approx(s, abs=1e-8)
        assert chosen[later][0] == earlier or abs(wanted[chosen[later][0], later] - s) < 1e-8


def test_crowded_lists_are_cut_into_parts(spark):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 99)], "k string, a bigint")
    right = spark.createDataFrame([("hot", i) for i in range(30)] + [("other", 1)], "k string, b bigint")
    found = parts.in_parts(left, right, ["k"], 7)
    assert sorted((r.a, r.b) for r in found.collect()) == [(a, b) for a in range(50) for b in range(30)]


def test_many_copies_form_a_star(spark):
    rows = [(i, "one same text of words", 0.5, [], True) for i in range(3000)]
    found = cosine.pairs(given(spark, rows), 0.5)
    assert {(r.earlier, r.later) for r in found.collect()} == {(0, i) for i in range(1, 3000)}
    assert cosine.pairs(given(spark, rows).limit(0), 0.5).count() == 0


def crowded(n: int) -> list[tuple]:
    """Texts of one common list of words, of which no two are alike enough."""
    draw = random.Random(5)
    return [(i, " ".join(draw.sample([f"word{k}" for k in range(40)], 12)), 0.95, [], True) for i in range(n)]


@pytest.mark.parametrize("minhash", [False, True])
def test_no_candidate_is_written(spark, monkeypatch, minhash):
    written, cut = {}, cosine.cut

    def counted(df, name):
        out = cut(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(cosine, "cut", counted)
    assert cosine.pairs(given(spark, crowded(300)), 0.95, short=None, minhash=minhash, best=True).count() < 300
    assert max(written.values()) <= 300  # candidates and postings were tables of their own


def test_best_pairs_give_the_same_choice(spark):
    texts = given(spark, some_texts(9, 120))
    every, best = (cosine.pairs(texts, 0.4, (0.7, 0.65), None, True, part=30, best=b) for b in (False, True))
    assert best.count() < every.count()
    assert sorted(cosine.best_earlier(every).collect()) == sorted(cosine.best_earlier(best).collect())


@pytest.mark.parametrize("groups", [1, 2, 7, 8, 9, 20, 41])
def test_rounds_meet_every_two_groups_once_by_few_copies(groups):
    met = Counter()
    for steps in blocks._rounds(groups):
        assert len(steps) <= blocks.COPIES + 1
        met.update({frozenset({g, (g + s) % groups}) for g in range(groups) for s in steps})
    assert met == Counter({frozenset({a, b}) for a in range(groups) for b in range(groups)})


def test_disk_does_not_grow_with_groups(spark, monkeypatch):
    sent, cut = [], blocks.cut

    def seen(df, name):
        if name == "found":
            sent.append(df._jdf.queryExecution().analyzed().toString().count("FlatMapGroupsInArrow"))
        return cut(df, name)

    monkeypatch.setattr(blocks, "cut", seen)
    monkeypatch.setattr(blocks, "sweep_shuffles", lambda s: sent.append("swept"))
    found = cosine.pairs(given(spark, some_texts(4)), 0.4, part=5)
    assert sent[:2] == [1, "swept"] and len(sent) >= 4  # a round's blocks, and its shuffle gone, before the next
    whole = cosine.pairs(given(spark, some_texts(4)), 0.4)
    assert sorted(found.collect()) == sorted(whole.collect())


def test_a_later_text_leaves_a_block_with_its_best_only(spark):
    found = cosine.pairs(given(spark, some_texts(9, 120)), 0.4, (0.7, 0.65), None, True, best=True)
    by_later = {}
    for r in found.collect():
        by_later.setdefault(r.later, set()).add(r.similarity)
    assert by_later and max(max(s) - min(s) for s in by_later.values()) <= 1e-8


def test_continued_hands_events_along_chains(spark):
    articles = spark.createDataFrame(
        [(1, "x"), (2, "x"), (3, "x"), (4, "OpenAI launch nova"), (5, "x"), (6, "openai unveil nova two"), (7, "x"), (8, "x"), (9, "Zeta hire Bob"), (10, "zeta join Eve")],
        "id bigint, signature string"
    )
    existing = spark.createDataFrame([("E1", 1, "openai launch things"), ("E2", 2, "OpenAI publish old"), ("E3", 3, "Other sue us")], "event_id string, seq bigint, signature string")
    best = spark.createDataFrame(
        [(1, None, "E3"), (2, 1, None), (3, 2, None), (5, 4, None), (6, 5, None), (8, 7, None), (4, 7, None)], "later bigint, earlier bigint, event_id string"
    )
    found = {r.id: (r.event_id, r.group_id) for r in events.continued(articles, existing, best).collect()}
    assert found == {
        1: ("E3", None), 2: ("E3", None), 3: ("E3", None),  # a chain that ends at a known event
        4: ("E1", None), 5: ("E1", None), 6: ("E1", None),  # 4 has its key's event, which goes on to what matches it
        7: (None, 7), 8: (None, 7), 9: (None, 9), 10: (None, 9)
    }


def test_only_titles_of_pairs_are_weighed(spark):
    titles = spark.createDataFrame([(i, f"alpha beta word{i} other{i % 3}") for i in range(9)], "id bigint, title string")
    found = dedup.tfidf_cosine(titles, spark.createDataFrame([(0, 3)], "earlier bigint, later bigint"), "id", "title")
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 1


def test_titles_are_deduplicated_without_their_texts(spark):
    first = intake.distinct_titles(spark, "/root/testdata/sf0.001")
    assert first.selectExpr("max(length(summary))").first()[0] == 1


def test_texts_of_events_are_read_once(spark):
    tagged = reports._tagged(spark, "/root/testdata/sf0.001")
    assert "documents.parquet" not in "".join(tagged.inputFiles())  # a written table
    assert tagged.selectExpr("max(length(summary))").first()[0] == 200
