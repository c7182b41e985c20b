"""Decontamination, substring dedup, Jaccard join and mixing against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import jaccard, mixing, recompression, winnowing

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def by_text(found, rows, key="doc_id"):
    """Rows of a result by id; ids are unique in these fixtures but for repeated rows and the null id."""
    out = defaultdict(list)
    for r in found:
        out[r[key]].append(r)
    assert Counter(r[key] for r in found) == Counter(r[0] for r in rows)
    return out


BENCH = [(1, None), (2, ""), (3, "one"), (4, "ONE two three"), (5, None), (6, "never seen words of a test item that no document holds at all anywhere")]


def bench(spark, rows):
    long = rows[42][1].split("\n")[1] or rows[41][1]
    items = BENCH + [
        (7, " ".join(rows[42][1].split()[5:40])), (8, long), (9, "the the the the the the the the the the the the the the the"),
        (10, " ".join(rows[0][1].split()[:13]).upper())
    ]
    items += [(10, rows[0][1]), (None, " ".join(rows[45][1].split()[2:20]))]
    return items, spark.createDataFrame(items, "item_id bigint, text string")


def contamination(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t or ""))
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add(i)
    lengths = {len(k) for k in windows}
    out = {}
    for i, t, *_ in rows:
        w, hit, found = ALNUM.findall(low(t or "")), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= {str(x) for x in ids if x is not None}
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("most", [winnowing.MOST_CHARS, 0])
def test_winnowing(spark, docs, rows, most, monkeypatch):
    """Broadcast fingerprints, and fingerprints that are joined."""
    monkeypatch.setattr(winnowing.scan, "__defaults__", (most,))
    items, table = bench(spark, rows)
    want = contamination(rows, items)
    found = winnowing.decontaminate(docs, table).collect()
    for i, rs in by_text(found, rows).items():
        for r in rs:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[i], i
    kept = winnowing.clean(docs, table)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if not want[r[0]][4])


def test_alignments_of_runs():
    import time

    import numpy as np

    draw = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(draw.integers(0, 60, draw.integers(1, 30))) for _ in range(2))
        want = sorted({int(x - y) for x in a for y in b})
        assert winnowing.shifts(a, b).tolist() == want == winnowing.shifts(a, b, 0).tolist()
    # a long run of one word against an item of that word
    began = time.perf_counter()
    flag, ids, some = winnowing.Bench([("x", "the " * 600)]).hits(winnowing.Bench([("d", "the " * 8000)]).words[0])
    assert flag.all() and ids == ["x"] and some and time.perf_counter() - began < 2


def test_winnowing_empty(spark, docs, none, rows):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert winnowing.decontaminate(none, empty).count() == 0
    assert winnowing.decontaminate(docs, empty).where("contaminated").count() == 0


def test_any_shared_span_has_a_common_fingerprint():
    import numpy as np

    draw = np.random.default_rng(1)
    for span in (1, 3, 5, 8, 13):
        k, w = winnowing.profile(span)
        for _ in range(50):
            common = draw.integers(0, 2**63, span).astype(np.uint64)
            a = np.concatenate([draw.integers(0, 2**63, 20).astype(np.uint64), common, draw.integers(0, 2**63, 7).astype(np.uint64)])
            b = np.concatenate([draw.integers(0, 2**63, 3).astype(np.uint64), common])
            ga, gb = winnowing.tk.grams(a, k), winnowing.tk.grams(b, k)
            assert set(ga[winnowing.minima(ga, w)]) & set(gb[winnowing.minima(gb, w)])


def repeats(rows):
    count, split = Counter(), []
    for i, t, *_ in rows:
        w = SPACE.findall(t or "")
        split.append((i, w))
        count.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    out = {}
    for i, w in split:
        gone = set()
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept))
    return out


@pytest.mark.parametrize("hot", [recompression.HOT, 1])
def test_recompression(docs, rows, none, hot):
    """Whole anchors, and anchors that are split by their windows."""
    want = repeats(rows)
    for i, rs in by_text(recompression.deduplicate(docs, texts=True, hot=hot).collect(), rows).items():
        for r in rs:
            assert (r.n_words, r.n_removed, r.kept_sha256, r.kept) == want[i], i
    assert recompression.deduplicate(none).count() == 0


def test_equal_windows_have_equal_anchors():
    import numpy as np

    draw = np.random.default_rng(2)
    for _ in range(30):
        body = draw.integers(0, 6, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        names = []
        for pad in (0, 7, 23):
            h = np.concatenate([draw.integers(0, 2**63, pad).astype(np.uint64), body, draw.integers(0, 2**63, 9).astype(np.uint64)])
            begin, end, key, _ = recompression.anchors(h, np.array([0, h.size]))
            per = {int(i): int(k) for b, e, k in zip(begin, end, key, strict=True) for i in range(b, e)}
            names.append([per[pad + i] for i in range(60 - 35 + 1)])
        assert names[0] == names[1] == names[2]


def groups(rows):
    sets = []
    for i, t, *_ in rows:
        w = SPACE.findall(low(t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    low_id = {}
    for k, (i, x) in enumerate(sets):
        if x and i is not None:
            low_id[find(k)] = min(i, low_id.get(find(k), i))
    return [(i, len(x), low_id.get(find(k), i) if x else i) for k, (i, x) in enumerate(sets)]


def test_jaccard(docs, rows, none):
    want = Counter(groups(rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()) == want
    assert jaccard.join(none).count() == 0


def test_jaccard_large_group(spark):
    """One group of near copies none of which is close to all others, and exact copies."""
    import random

    draw = random.Random(3)
    base = [f"b{k}" for k in range(100)]
    made = []
    for i in range(300):
        own = list(base)
        for p in draw.sample(range(100), draw.choice([0, 0, 1, 2, 3])):
            own[p] = f"y{i}-{p}"
        made.append((i, " ".join(own), "en", "s", 1))
    df = spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()) == Counter(groups(made))


def test_jaccard_group_beside_its_leader(spark, monkeypatch):
    """Two families too far apart to link: the members of the one whose leader the lists do not have must not all meet."""
    one = [f"w{i}" for i in range(120)]
    two = [f"x{i}" if i in (30, 60, 90) else w for i, w in enumerate(one)]
    made = [(100 * f + i, " ".join([*words[:-1], f"end{f}y{i}"])) for f, words in enumerate((one, two)) for i in range(80)]
    written, cut = {}, jaccard.cut

    def counted(df, name):
        out = cut(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "cut", counted)
    found = {(r.doc_id, r.component_id) for r in jaccard.join(spark.createDataFrame(made, "doc_id bigint, text string")).collect()}
    assert found == {(i, i // 100 * 100) for i, _ in made}
    assert written["rest"] < len(made)


def test_jaccard_forest_keeps_the_heaviest():
    a, b = np.array([1, 1, 2, 3, 5]), np.array([2, 3, 3, 4, 6])
    ones, weight = np.ones(5, np.int64), np.array([0.9, 0.5, 0.8, 0.7, 0.1])
    kept = jaccard.heaviest((a, b, ones, ones, weight, a, b))
    assert set(zip(kept[0].tolist(), kept[1].tolist(), strict=True)) == {(1, 2), (2, 3), (3, 4), (5, 6)}
    assert not jaccard.heaviest(tuple(x[:0] for x in (a, b, ones, ones, weight, a, b)))[0].size


def test_jaccard_large_sets(spark):
    """Long texts: near copies, copies just below the threshold, and texts that share only some passages."""
    import random

    draw = random.Random(8)
    shared = [" ".join(f"c{draw.randrange(10**6)}" for _ in range(30)) for _ in range(40)]
    made = []
    for i in range(24):
        own = [f"v{i // 3}-{k}" for k in range(3000)]
        for p in draw.sample(range(3000), (i % 3) * 34):
            own[p] = f"z{i}-{p}"
        for s in draw.sample(shared, 12):
            own.insert(draw.randrange(3000), s)
        made.append((i, " ".join(own), "en", "s", 1))
    df = spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = Counter(groups(made))
    assert len({c for _, _, c in want}) > 1
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()) == want


def test_representatives(docs, rows):
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    want = {(i, c) for i, _, c in groups(rows)}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, c in want if i is not None and i == c)


def test_mixing(spark, docs, rows, none):
    found = mixing.mix(docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    sizes, total = defaultdict(int), 0
    for _, t, _, s, _ in rows:
        sizes[s] += len(SPACE.findall(t or ""))
        total += len(SPACE.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / share for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    source = {r[0]: r[3] for r in rows}
    taken = defaultdict(int)
    for r in found:
        assert r.taken <= 3 * r.size and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
    assert mixing.mix(none).count() == 0
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_training_order(docs):
    out = mixing.training_order(docs, [[(0.0, 0.0), (1.0, 2.0)], [(0.0, 1.0), (1.0, 1.0)]])
    assert out.columns == docs.columns
    n = out.select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert n == mixing.mix(docs).agg(F.sum("taken")).first()[0]


def test_positions_follow_the_schedule(spark):
    knots = [(0.0, 0.0), (0.5, 2.0), (1.0, 2.0)]
    df = spark.createDataFrame([(float(k),) for k in range(0, 151, 10)], "w double").select(
        "w", mixing.when_taken(F.col("w"), F.lit(150.0), knots).alias("t")
    )
    for r in df.collect():
        t = r.t
        area = (2 * t * t if t <= 0.5 else 0.5 + 2 * (t - 0.5)) / 1.5 * 150
        assert area == pytest.approx(r.w, abs=1e-6)


def test_jaccard_revision_chain(spark):
    """Each document is the one before, shifted by a few words: only neighbours link, in random id order."""
    draw = random.Random(3)
    stream = [f"c{draw.randrange(10**6)}" for _ in range(400 + 8 * 150)]
    ids = draw.sample(range(10**6), 150)
    rows = [(ids[i], " ".join(stream[8 * i : 8 * i + 400])) for i in range(150)]
    rows += [(10**6 + i, " ".join(f"u{draw.randrange(10**6)}" for _ in range(50))) for i in range(5)]
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {got[i] for i in ids} == {min(ids)}
    assert all(got[10**6 + i] == 10**6 + i for i in range(5))


def test_representatives_tell_repeated_ids_apart(spark):
    copy, other = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(1, copy), (2, copy), (2, other), (2, other), (3, None), (3, None), (None, copy), (None, "x y"), (4, "x y")]
    got = sorted(
        (r.doc_id is None, r.doc_id or 0, r.text or "") for r in jaccard.representatives(
            spark.createDataFrame(rows, "doc_id bigint, text string")
        ).collect()
    )
    assert got == [(False, 1, copy), (False, 2, other), (False, 3, ""), (False, 4, "x y")]


def test_very_many_equal_rows_are_marked_once(spark):
    text = " ".join(f"w{i}" for i in range(1000))
    rows = spark.range(2000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit(text).alias("text")).repartition(8)
    marks = recompression.repeats(rows).groupBy("doc_id", "th", "at").agg(F.bit_or("mask").alias("mask"))
    assert marks.count() <= 1000
    found = recompression.deduplicate(rows).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert [tuple(r) for r in found] == [(7, 1000, 1000, 2000)]
