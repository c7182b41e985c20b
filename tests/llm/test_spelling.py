import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from newsloom.llm import queries, spelling


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_near(words: dict[str, int]) -> dict:
    out = {}
    for w in words:
        close = [v for v in words if one_apart(w, v)]
        if close:
            best = min(close, key=lambda v: (-words[v], v))
            out[w] = (len(close), words[best], best)
    return out


def some_words(seed: int, n: int, letters: str, low: int = 1, high: int = 7) -> dict[str, int]:
    draw = random.Random(seed)
    return {"".join(draw.choice(letters) for _ in range(draw.randrange(low, high))): draw.randrange(1, 9) for _ in range(n)}


@pytest.mark.parametrize(("seed", "letters", "size"), [(1, "ab", 5), (2, "abc", 40), (3, "abÿ\U0001f600", 7), (4, "ab", 10**6), (5, "a", 2)])
def test_pairs_equal_all_pairs(spark, monkeypatch, seed, letters, size):
    words = some_words(seed, 250, letters)
    if seed == 2:  # a third of the words begin alike, a third end alike
        words = {("x" * 6 + w if i % 3 == 0 else w + "y" * 6 if i % 3 == 1 else w): n for i, (w, n) in enumerate(words.items())}
    monkeypatch.setattr(spelling, "PAIRS", 200)
    table = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)
    found = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.nearest(table, size).collect()}
    assert found == plain_near(words)


def test_routes_reach_every_rectangle_once():
    words = sorted(some_words(9, 400, "abc", 3, 9))
    for shards in (1, 2, 9, 60):
        bounds = spelling.Bounds(words[:: 2 if shards > 9 else 1], shards)
        at = {(side, w): bounds.shard(side, w) for side in (0, 1) for w in words}
        assert len(set(at.values())) > shards // 2
        for w in words[::7]:
            for kind in (-1, 0, 1):
                skip = 0 if kind > 0 else 1
                routes = list(bounds.routes(w, kind))
                for i in range(len(w) - skip + 1):
                    match = {v for v in words if len(v) == len(w) + kind and v.startswith(w[:i]) and v[::-1].startswith(w[i + skip :][::-1])}
                    here = [(side, s) for side, s, first, last in routes if first <= i <= last]
                    assert len(here) == len(set(here)) and len({side for side, _ in here}) == 1
                    assert {at[here[0][0], v] for v in match} <= {s for _, s in here}


def test_wavelet_tree_reports_rectangles():
    draw = random.Random(2)
    words = sorted(w for w in some_words(3, 300, "abcd", 5, 6))
    orders = spelling.Orders(words, [1] * len(words))
    place = {int(f): r for r, f in enumerate(orders.by_reverse)}
    for _ in range(200):
        a, b, c, d = (draw.randrange(len(words) + 1) for _ in range(4))
        _, found = orders.report(*(np.array([x]) for x in (a, b, c, d)))
        assert sorted(found.tolist()) == [f for f in range(a, b) if c <= place[f] < d]


def test_crc_and_runs():
    draw = random.Random(1)
    data = np.frombuffer(draw.randbytes(5000), np.uint8)
    starts = np.array([draw.randrange(4000) for _ in range(200)])
    sizes = np.array([draw.choice([0, 1, 5, 63, 64, 65, 300]) for _ in starts])
    state = np.array([draw.randrange(1 << 32) for _ in starts], np.uint32)
    wanted = [zlib.crc32(data[a : a + n].tobytes(), s) for a, n, s in zip(starts, sizes, state.tolist(), strict=True)]
    assert spelling.crc32_of(state, data, starts, sizes).tolist() == wanted
    texts = ["Ab cÿÀd1e×÷f", "", "x", "né中é", "\xbf\xc0Ā", "ab", "a" * 300]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, row = spelling.letter_runs(data, off)
    found = [(int(r), data[a:b].tobytes().decode()) for a, b, r in zip(starts, ends, row, strict=True)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in re.findall("[A-Za-zÀ-ÿ]+", t)]


def plain_counts(rows: list) -> dict[str, int]:
    out = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            out[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def letters_corpus() -> list[tuple]:
    draw = random.Random(7)
    known = ["".join(draw.choice("abcdeé") for _ in range(draw.randrange(5, 12))) for _ in range(60)]
    rows = []
    for i in range(300):
        own = [draw.choice(known) for _ in range(60)]
        for k in range(60):
            if draw.random() < 0.1:
                at = draw.randrange(len(own[k]))
                own[k] = own[k][:at] + draw.choice(["", "x", "É"]) + own[k][at + 1 :]
        rows.append((None if i == 5 else i, " ".join(own).title() if i % 9 == 0 else " ".join(own)))
    return [*rows, (400, None), (401, ""), (402, "1 2 - \n"), (403, "q" * 200_000 + " " + "q" * 200_000), rows[3], rows[3], (404, "longword" * 2000)]


def test_vocabulary_and_variants(spark, monkeypatch):
    rows = letters_corpus()
    given = spark.createDataFrame([(i, t, "w", 1, "f") for i, t in rows], "doc_id bigint, text string, word string, n int, form string").repartition(4)
    words = plain_counts(rows)
    assert {r.word: r.n for r in spelling.vocabulary(given).collect()} == words
    close = plain_near(words)
    for most in (None, 0):
        if most == 0:
            monkeypatch.setattr(spelling, "small", lambda d: d)
        found = spelling.variants(given, size=30)
        assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        form = {w: c[2] for w, c in close.items() if c[1] >= 5 * words[w]}

        def end(w, form=form):
            return end(form[w]) if w in form else w

        wanted = {
            w: (form.get(w), end(w), n, close.get(w, (0,))[0], words[form[w]] if w in form else None) for w, n in words.items()
        }
        assert {r.word: tuple(r)[1:] for r in found.collect()} == wanted
        assert form


def test_roots_follow_long_chains_and_hot_forms(spark, monkeypatch):
    links = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(40)] + [(f"x{i}", "w000") for i in range(200)]
    table = spark.createDataFrame(links, "word string, form string")
    wanted = {w: "w040" for w, _ in links}
    assert {r.word: r.root for r in spelling.roots(table).collect()} == wanted
    monkeypatch.setattr(spelling, "small", lambda d: d)
    assert {r.word: r.root for r in spelling.roots(table).collect()} == wanted
    assert spelling.roots(table.limit(0)).count() == 0


def test_copied_links_are_not_broadcast(spark, monkeypatch):
    plans, cut = [], spelling.cut

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name)

    monkeypatch.setattr(spelling, "cut", seen)
    monkeypatch.setattr(spelling, "small", lambda d: d)
    links = cut(spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)], "word string, form string"), "few")
    assert spelling.roots(links).count() == 9
    # Spark takes the copies for as small as their file
    assert len(plans) > 2 and not [p for p in plans if "Broadcast" in p]


def test_very_long_words(spark):
    base = "ab" * 2000
    words = {base: 9, base[:1500] + "x" + base[1501:]: 5, base + "c": 7, base[:-1]: 6}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert {r.word: (r.n_near, r.best_n, r.best) for r in spelling.nearest(table).collect()} == plain_near(words)


def test_empty_table(spark, none):
    assert spelling.variants(none).count() == 0


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op11_spelling_variants"])
    names = [d[0] for d in want.description]
    found = queries.queries()["op11_spelling_variants"](spark, folder)
    assert sorted(found.columns) == sorted(names)
    assert {tuple(r[n] for n in names) for r in found.collect()} == set(want.fetchall())
