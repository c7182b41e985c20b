"""Search, language, pages, archives, quality and token files against brute force, round trips and held-out accuracy."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import arrow_tokens, boilerplate, compression_lang, rules, shared, vptree, warc


def vectors(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(size=8)]) for i in range(400)]
    rows += [(i, [1.0, 2.0] + [0.0] * 6) for i in range(400, 460)]  # one common vector
    rows += [(i, [float(i % 3), float(i % 2)] + [1.0] * 6) for i in range(500, 560)]  # ties
    rows += [
        (600, None), (601, [0.0] * 8), (602, [float("nan")] * 8), (603, [float("inf")] + [0.0] * 7), (604, [1.0, None] + [0.0] * 6), (700, []),
        (None, [1.0] * 8), (800, [1.0, 2.0]), (801, [1.0, 3.0]), (400, [1.0, 2.0] + [0.0] * 6)
    ]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def nearest(rows, every, k):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in sorted(ok):
        if i % every == 0:
            by = {}
            for j, w in ok:
                if j != i and len(w) == len(v):
                    d = float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()))
                    by[j] = min(d, by.get(j, d))
            out[i] = sorted((d, j) for j, d in by.items())[:k]
    return out


@pytest.mark.parametrize("shard", [64, 8192])
def test_vptree_exact_at_factor_one(spark, shard):
    rows, df = vectors(spark)
    found = vptree.search(vptree.index(df, 10, shard), df.where("vec_id % 100 = 0"), 10, 1.0, 2).collect()
    want = nearest(rows, 100, 10)
    assert {r.query_id for r in found} == {i for i, x in want.items() if x}
    for i, x in want.items():
        got = [(r.score, r.vec_id) for r in sorted((r for r in found if r.query_id == i), key=lambda r: r.rank)]
        assert [j for _, j in got] == [j for _, j in x] and np.allclose([d for d, _ in got], [d for d, _ in x])


def test_vptree_recall_and_empty(spark):
    draw = np.random.default_rng(4)
    v = draw.normal(size=(3000, 32))
    rows = [(i, [float(x) for x in v[i]]) for i in range(len(v))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {(r.query_id, r.vec_id) for r in vptree.neighbours(df).collect()}
    want = {(i, j) for i, x in nearest(rows, 100, 10).items() for _, j in x}
    assert len(found & want) >= 0.9 * len(want)
    assert vptree.neighbours(df.limit(0)).count() == 0


def test_language(spark, docs, rows, none):
    draw = random.Random(1)
    parts = {"aa": ["lor", "ipsa", "umet", "quor", "elit"], "bb": ["zwi", "sch", "ung", "heit", "kro"], "cc": ["ayo", "nni", "oku", "mba", "tse"]}
    made = []
    for i in range(600):
        lang = draw.choice(list(parts))
        made.append(
            (
                i, " ".join("".join(draw.choices(parts[lang], k=3)) for _ in range(draw.randrange(12, 60))), lang if draw.random() < 0.97 else None,
                "s", 1
            )
        )
        parts_of = lang
    truth = {r[0]: next(k for k, v in parts.items() if any(x in r[1][:3] or r[1].startswith(x) for x in v)) for r in made}
    df = spark.createDataFrame(made, docs.schema)
    out = compression_lang.predict(df).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 600 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    odd = {r.doc_id: r for r in compression_lang.predict(docs).collect()}
    for i in (80, 81, 82, 89):
        assert odd[i].lang_pred == "und" and odd[i].rejected and odd[i].score == 0
    assert odd[88].lang_pred in ("en", "de")
    assert compression_lang.predict(none).count() == 0
    assert compression_lang.accepted(docs).columns == docs.columns


def test_language_by_plain_compression(spark, docs):
    """predict() against sizes from compressors that are made anew for every segment."""
    import zstandard as z

    model = compression_lang.train(docs.where(~compression_lang.held_out(F.col("doc_id"))), 20, 4096)
    assert set(model.dictionaries) == {"en", "de"} and all(0 < len(d) <= 4096 for d in model.dictionaries.values())
    for r in compression_lang.identify(docs.select("doc_id", "text"), model).collect():
        body = compression_lang.letters(r.li_in.text or "").encode()[:6000]
        if len(body) == 6000 or not body:
            continue
        sizes = {}
        for lang, content in model.dictionaries.items():
            p = z.ZstdCompressionParameters.from_level(
                compression_lang.LEVEL, source_size=compression_lang.SEGMENT, dict_size=len(content), min_match=3, write_checksum=False,
                write_content_size=False
            )
            coder = lambda d=content, p=p: z.ZstdCompressor(
                dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=p
            )
            sizes[lang] = sum(len(coder().compress(body[i : i + compression_lang.SEGMENT])) for i in range(0, len(body), compression_lang.SEGMENT))
        first = min(sizes, key=lambda k: (sizes[k], -model.counts[k], k))
        assert r.li_lang == first and r.li_margin == pytest.approx((max(sizes.values()) - sizes[first]) / max(sizes.values()))


def test_dictionaries_take_from_whole_texts(spark):
    text = " ".join(f"{a}{b}{c}" for a in "abcdef" for b in "aeiou" for c in "klmnop")
    long = text * 200
    assert compression_lang.pieces(long.encode(), 4000).count(b" ") > 100 and len(compression_lang.pieces(long.encode(), 4000)) <= 4100
    tail = long + " zzzyyyxxx" * 60
    assert b"zzzyyy" in compression_lang.pieces(tail.encode(), 4000)
    rows = [(i, tail, "rare") for i in (1, 2, 3)] + [(10 + i, "short text", "often") for i in range(50)]
    model = compression_lang.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 400, 6000)
    assert len(model.dictionaries["rare"]) > 5500 and len(model.dictionaries["often"]) > 500


def test_language_model_survives_no_labels(docs):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in compression_lang.predict(unlabelled).collect()} == {"und"}


PAGES = [
    (
        1, "http://a.example/x",
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu one two three</a></nav><div class='ad'>buy now</div><article><h1>Head &amp; line</h1><p>One\n two <b>three</b><p>four &lt;5&gt;</article><footer>&copy; foot</footer></body></html>"
    ),
    (2, "http://A.example:80/y", "<body><p>Welcome to our site please enjoy your stay<p>Unique words of the second page are here</body>"),
    (
        3, "http://a.example/z",
        "<body><p>Welcome to our site please enjoy your stay<p>Other content that no page but this has</p><form>name</form></body>"
    ),
    (4, None, None), (5, "", ""), (6, "http://b.example", "plain text & more"), (7, "http://b.example/q", "<article><p>same story</p></article>"), (
        8, "http://b.example/r", "<article><p>same story</p></article>"
    ),
    (
        9, "http://c.example", "<body><script>var t='</p>';</script><div id=comments>first!</div><main>kept<br>text</main></body>"
    ), (None, "http://c.example/n", "<p>x"),
]


def test_boilerplate(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    out = {r.page_id: r for r in boilerplate.extract(df).collect()}
    want = {
        1: "Head & line\nOne two three\nfour <5>", 2: "Unique words of the second page are here", 3: "Other content that no page but this has", 4: "",
        5: "", 6: "plain text & more", 7: "same story", 8: "same story", 9: "kept text", None: "x"
    }
    assert {i: r.text for i, r in out.items()} == want
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert boilerplate.extract(df.limit(0)).count() == 0


def test_boilerplate_within_articles():
    draw = random.Random(4)
    line = "read all of our terms before you copy this page"
    story = [f"s{draw.randrange(10**6)}" for _ in range(60)]
    pages = [[" ".join(f"w{draw.randrange(10**6)}" for _ in range(40)), line] for _ in range(8)]
    for i in range(8):  # near copies of one article
        pages.append([" ".join([*story[:i], f"x{i}", *story[i + 1 :]])])
    verdicts = boilerplate.judge(pages, [[boilerplate.MAIN] * len(p) for p in pages])
    assert [[k != boilerplate.OUT for k, _ in v] for v in verdicts] == [[True, False]] * 8 + [[True]] * 8


def test_a_name_hides_no_wrapper():
    def kept(page):
        found = boilerplate.blocks(page)
        return [t for t, k in found if k == max((k for _, k in found), default=0) != boilerplate.OUT]

    assert kept("<div class='has-sidebar'><nav>a</nav><article><p>one two</p></article><div class=sidebar>three</div></div>") == ["one two"]
    assert kept("<div class='has-sidebar'><h1>T</h1><p>one two three four</p><div class=sidebar>three</div></div>") == ["T", "one two three four"]
    assert kept("<article><div class='post-header'><h1>Head</h1></div><p>body</p><div class='share'>send</div></article>") == ["Head", "body"]
    assert kept("<p>story</p><div class=comments><article>first!</article><article>second!</article></div>") == ["story"]
    assert kept("<article><p>a</p><div class=ad>buy this</div></article><div class=ad>one</div>") == ["a"]
    assert kept("<div class=ad>only</div>") == []


def test_names_hide_no_prose():
    def kept(page):
        return [t for t, k in boilerplate.blocks(page) if k != boilerplate.OUT]

    assert kept("<script>var a='<!--';</script><article><p>Real text</p></article>") == ["Real text"]
    assert kept("<style>/* <!-- */</style><textarea><p>a</textarea><p>b<noscript><!-- </noscript>c --> d") == ["bc --> d"]
    assert kept(
        "<article><div class='share-price'>A</div><h2 id='search-results'>B</h2><p class='alert'>C</p><div class='share-box'>no</div></article>"
    ) == ["A", "B", "C"]
    assert boilerplate.blocks("<body><p>one<article class='comment'><p>c</p></article></body>") == [("one", boilerplate.OPEN), ("c", boilerplate.OUT)]
    assert kept("<article class='post comments-open'><p>t</p><article class='comment-item'><p>c</p></article></article>") == ["t"]


def judged(texts, kinds):
    """judge() by comparing every run of every page, where no page is a copy of another."""
    words = [[t.lower().split() for t in page] for page in texts]
    runs, of_main = {}, {}
    for i, (page, kind) in enumerate(zip(words, kinds)):
        flat = [(w, k) for b, k in zip(page, kind) for w in b]
        for j in range(len(flat) - 5):
            run = tuple(w for w, _ in flat[j : j + 6])
            runs.setdefault(run, set()).add(i)
            if flat[j][1] == boilerplate.MAIN:
                of_main.setdefault(run, set()).add(i)
    n, m = len(texts), sum(boilerplate.MAIN in k for k in kinds)
    bars = {boilerplate.MAIN: (of_main, max(3, -(-m // 10))), None: (runs, max(2, -(-n // 10)))}
    out = []
    for page, kind in zip(words, kinds):
        flat = [(w, k) for b, k in zip(page, kind) for w in b]
        hit = {boilerplate.MAIN: [False] * len(flat), None: [False] * len(flat)}
        for which, (table, least) in bars.items():
            for j in range(len(flat) - 5):
                if (which is None or flat[j][1] == which) and len(table.get(tuple(w for w, _ in flat[j : j + 6]), ())) >= least:
                    hit[which][j : j + 6] = [True] * 6
        at, new = 0, []
        for b, k in zip(page, kind):
            again = sum(hit[boilerplate.MAIN if k == boilerplate.MAIN else None][at : at + len(b)]) > 0.5 * len(b)
            new.append((boilerplate.OUT if again else k, again))
            at += len(b)
        out.append(new)
    return out


@pytest.mark.parametrize("pages", [1, 5, 30, 120])
def test_judge_by_brute_force(pages):
    draw = random.Random(pages)
    lines = [" ".join(f"l{k}x{j}" for j in range(draw.randrange(4, 12))) for k in range(6)]
    texts, kinds = [], []
    for _ in range(pages):
        main = draw.random() < 0.6
        page = [(" ".join(f"w{draw.randrange(10**6)}" for _ in range(draw.randrange(20, 60))), boilerplate.MAIN if main else boilerplate.OPEN)]
        for k, line in enumerate(lines):
            if draw.random() < (0.02, 0.08, 0.15, 0.3, 0.6, 0.9)[k]:
                page.insert(
                    draw.randrange(len(page) + 1),
                    (line, draw.choice([boilerplate.MAIN, boilerplate.OUT]) if main else draw.choice([boilerplate.OPEN, boilerplate.OUT]))
                )
        texts.append([t for t, _ in page])
        kinds.append([k for _, k in page])
    assert boilerplate.judge(texts, kinds) == judged(texts, kinds)


def test_result_does_not_depend_on_the_arrays(spark):
    """A host in one array and in many: runs at the edge of a tenth, an article with copies, a repeated row."""
    draw = random.Random(11)
    new = lambda n: " ".join(f"w{draw.randrange(10**7)}" for _ in range(n))
    lines, story, rows = [new(9) for _ in range(12)], new(60).split(), []
    for i in range(130):
        inside = "".join(f"<p>{t}</p>" for k, t in enumerate(lines) if draw.random() < 0.02 * k)
        around = "".join(f"<div>{t}</div>" for k, t in enumerate(lines) if draw.random() < 0.02 * k)
        text = " ".join([*story[: i % 60], f"x{i}", *story[i % 60 + 1 :]]) if i % 3 == 0 else new(40)
        rows.append((i, f"http://a/{i}", f"<article><p>{text}</p>{inside}</article>{around}" if i % 4 else f"<p>{text}</p>{around}"))
    df = spark.createDataFrame([*rows, rows[5]], "page_id bigint, url string, html string")
    order = [r.h for r in df.select(F.xxhash64("page_id", "url", "html").alias("h")).collect()]
    found = [boilerplate.blocks(html) for _, _, html in [*rows, rows[5]]]
    found = [[(t, boilerplate.OUT if k == boilerplate.OPEN and any(j == boilerplate.MAIN for _, j in p) else k) for t, k in p] for p in found]
    verdicts = boilerplate.judge([[t for t, _ in p] for p in found], [[k for _, k in p] for p in found], order=order)
    want = sorted(
        (i, "\n".join(t for (t, _), (k, _) in zip(p, v) if k != boilerplate.OUT), sum(a for _, a in v)) for i, p, v in zip([*range(130), 5], found, verdicts)
    )
    assert 0 < sum(n for _, _, n in want) < sum(map(len, found))
    for size in (500, 40, 7):
        assert sorted((r.page_id, r.text, r.n_repeated) for r in boilerplate.extract(df, size).collect()) == want


def test_long_pages_and_repeated_rows(spark):
    draw = random.Random(8)
    long = "<article>" + "".join(f"<p>{' '.join(f'w{draw.randrange(10**7)}' for _ in range(200))}</p>" for _ in range(900)) + "</article>"
    rows = [(1, "http://a/1", long), (2, "http://a/2", "<p>short one"), (2, "http://a/2", "<p>short one"), (3, "http://a/3", "<p>" + "x" * 10**6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = boilerplate.extract(df).collect()
    assert Counter(r.page_id for r in out) == {1: 1, 2: 2, 3: 1}
    assert next(r for r in out if r.page_id == 1).text.count("\n") == 899 and all(r.n_chars == len(r.text) for r in out)
    assert Counter(map(tuple, warc.round_trip(df).collect())) == archives(rows)


def test_suffix_array_marks_what_pages_share():
    draw = random.Random(2)
    for _ in range(40):
        pages = [[draw.randrange(3) for _ in range(draw.randrange(0, 25))] for _ in range(draw.randrange(1, 16))]
        want = []
        for i, p in enumerate(pages):
            flag = [False] * len(p)
            for k in range(len(p) - 5):
                if any(p[k : k + 6] == q[m : m + 6] for j, q in enumerate(pages) if j != i for m in range(len(q) - 5)):
                    flag[k : k + 6] = [True] * 6
            want.append(flag)
        assert [x.tolist() for x in boilerplate.repeated(pages)] == want


def archives(rows):
    same = {}
    for i, _, h in rows:
        if i is not None:
            same[h or ""] = max(i, same.get(h or "", i))
    out = []
    for i, _, h in rows:
        raw, top = (h or "").encode(), same.get(h or "")
        revisit = i is not None and top > i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return Counter(out)


def test_warc_round_trip(spark):
    rows = [
        *PAGES, (10, "http://x/\r\nWARC-Type: evil", "é" * 3000), (11, "u", "é" * 3000), (11, "u", "é" * 3000),
        (12, "u", "WARC/1.1\r\nnested\r\n\r\n")
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert Counter(map(tuple, warc.round_trip(df).collect())) == archives(rows)
    assert warc.round_trip(df.limit(0)).count() == 0
    only = warc.plan(df, min_bytes=100).where("target is not null").select("page_id").collect()
    assert [r.page_id for r in only] == [10]


@pytest.mark.parametrize("compress", [True, False])
def test_warc_salvage(compress):
    raw = [warc.record(i, "u", b"payload %d " % i * 40, None, base64.b32encode(hashlib.sha1(b"payload %d " % i * 40).digest()).decode()) for i in range(8)]
    parts = [gzip.compress(x, mtime=0) if compress else x for x in raw]
    at = [sum(map(len, parts[:i])) for i in range(9)]
    broken = bytearray(b"".join(parts))
    broken[at[2] + len(parts[2]) // 2] ^= 0x5A
    broken[at[5] : at[5] + 2] = b"??"
    found = list(warc.salvage(bytes(broken)))
    assert [r["page_id"] for r in found if r["kind"] == "response"] == [0, 1, 3, 4, 6, 7]
    assert [(r["offset"], r["length"]) for r in found if r["kind"] == "gap"] == [(at[2], len(parts[2])), (at[5], len(parts[5]))]
    cut_off = list(warc.salvage(b"".join(parts)[: at[7] + 20]))
    assert [r["kind"] for r in cut_off] == ["response"] * 7 + ["gap"] and cut_off[-1]["length"] == 20
    assert list(warc.salvage(b"")) == []


def test_warc_gaps_are_logged(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id bigint, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/w"
    warc.write(warc.plan(df), folder)
    path = next(p for p in (tmp_path / "w").iterdir() if p.name.endswith(".gz"))
    raw = bytearray(path.read_bytes())
    raw[len(raw) // 2 : len(raw) // 2 + 12] = b"?" * 12
    (tmp_path / "w" / f".{path.name}.crc").unlink(missing_ok=True)
    path.write_bytes(bytes(raw))
    found = warc.read(spark, folder)
    gaps = warc.log_gaps(found, f"{folder}-gaps")
    assert gaps == 1
    log = spark.read.json(f"{folder}-gaps").first()
    assert log.length > 0 and log.file.endswith(path.name) and log.reason
    assert 38 <= found.where("kind = 'response'").count() <= 39


def test_rules(spark, docs, none):
    draw = random.Random(6)
    made, labels = [], []
    for i in range(900):
        good = draw.random() < 0.7
        w = ["".join(draw.choices("abcdefghij", k=draw.randrange(2, 9))) for _ in range(draw.randrange(20, 80))]
        made.append((i, " ".join(w) + "." if good else " ".join(x + draw.choice(["###", "%%%", ""]) for x in w), "en", "s", 1))
        labels.append((i, int(good), 0))
    df = spark.createDataFrame([*made, (900, None, None, None, None), (901, "", "", "", 0)], docs.schema)
    known = spark.createDataFrame([*labels, (902, 1, None), (None, 0, None), (900, None, None)], "doc_id bigint, quality int, toxic int")
    out = {r.doc_id: r for r in rules.predict(df, known).collect()}
    assert len(out) == 902 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    held = [(r.predicted, labels[i][1]) for i, r in out.items() if r.held_out and i < 900]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    assert rules.predict(none, known).count() == 0
    assert {r.score for r in rules.predict(docs, known.limit(0)).collect()} == {0.5}


def test_rules_are_conjunctions(spark):
    rows = rules.measure(
        spark.createDataFrame([(1, "A b! c"), (2, "x " * 30)], "doc_id bigint, text string")
    ).withColumn("label", F.col("doc_id") - 1.0)
    r = (("words", True, 5.0), ("upper", False, 0.0))
    assert [x.hit for x in rows.orderBy("doc_id").select(rules.condition(r).alias("hit")).collect()] == [True, False]


def test_scores_by_plain_python(spark):
    """An ensemble fitted by Spark, applied rule by rule; and a bounded sample of labels gives a model too."""
    import math

    draw = random.Random(12)
    made = [(i, " ".join("".join(draw.choices("abcdefgh", k=draw.randrange(1, 9))) + draw.choice(["", "", "#" * (i % 3)]) for _ in range(draw.randrange(0, 60)))) for i in range(500)]
    stats = rules.measure(spark.createDataFrame(made, "doc_id bigint, text string")).withColumn(
        "label", F.when(F.col("doc_id") % 3 == 0, 0.0).otherwise(1.0)
    )
    model = rules.fit(shared.cut(stats, "labelled"))
    assert 0 < len(model.rules) < 400
    for r in stats.select("*", model.score().alias("score")).collect():
        total = model.base + sum(w for rule, w in model.rules if all(r[s] <= b if low else r[s] > b for s, low, b in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)
    texts = dict(made)
    for r in stats.collect():
        words = texts[r.doc_id].split()
        assert r.words == len(words) and r.word_len == pytest.approx(sum(map(len, words)) / max(1, len(words)))
        assert r.distinct == pytest.approx(len(set(words)) / len(words) if words else 0) and r.short == pytest.approx(
            sum(len(w) <= 3 for w in words) / max(1, len(words))
        )
    known = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(500)], "doc_id bigint, quality int")
    few = rules.sampled(known, 100).count()
    assert 60 < few < 140 and rules.sampled(known, 500).count() == 500


def test_token_files(spark, docs, rows, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    odd = [
        (200, "it's we've <|endoftext|> a<|startoftext|>b <|STARTOFTEXT|>", "", "", 0), (201, "a\x01b \x01 c", "", "", 0),
        (202, "ΣΑΣ İstanbul é é a　b\x85c \x1cd #tag! don't.", "", "", 0)
    ]
    df = docs.union(spark.createDataFrame(odd, docs.schema))
    key = lambda r: (r[0] is not None, r[0] or 0)
    texts = sorted([*rows, *odd], key=key)
    start, want = 0, []
    for i, t, *_ in texts:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert Counter(map(tuple, arrow_tokens.round_trip(df, path).collect())) == Counter(want)
    assert arrow_tokens.round_trip(none, path).count() == 0
    folder = f"file://{tmp_path}/t"
    files = arrow_tokens.write(df, folder, path, length=16, roll=300)
    assert files.count() > 3
    got = arrow_tokens.read(spark, folder, files)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    reader = arrow_tokens.open_file(str(next(p for p in (tmp_path / "t").iterdir() if p.suffix == ".arrow")))
    ids, mask = arrow_tokens.sequence(reader, 0)
    assert ids.size == 16 and mask.all() and ids.base is not None


def test_bloom_misses_nothing(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    for bits in (1 << 10, 1 << 27):
        bitmap = shared.bloom(keys, "k", bits)
        all_keys = keys.toPandas().k.to_numpy().view(np.uint64)
        assert shared.in_bloom(bitmap, all_keys).all()
    assert shared.in_bloom(bitmap, np.arange(10**5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).mean() < 0.1


def test_pipeline(spark, tmp_path, rows, docs):
    """Each stage against brute force on its own input, and run() against the stages one by one."""
    import corpus_pipeline
    from tests.llm.test_text_operators import SPACE, contamination, groups

    (tmp_path / "d").mkdir()
    docs = docs.withColumn("lang", F.lit("en"))  # texts of two languages alike would all be rejected
    docs.write.parquet(f"{tmp_path}/d/documents.parquet")
    items = [(1, rows[42][1])]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/d/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "tokens"]
    came, df = {"documents": [tuple(r) for r in docs.collect()]}, docs
    for name, stage in corpus_pipeline.STAGES:
        df = shared.cut(stage(spark, df, f"{tmp_path}/d"), name)
        came[name] = [tuple(r) for r in df.collect()]
        assert name == "tokens" or df.columns == docs.columns
    assert not Counter(came["language"]) - Counter(came["documents"])
    assert not {r[0] for r in came["language"]} & {80, 81, 82, 89} and len(came["language"]) > 20
    alone = {i for i, _, c in groups(came["language"]) if i == c}
    assert sorted(r[0] for r in came["near_duplicates"] if r[0] is not None) == sorted(i for i in alone if i is not None)
    bad = {i for i, x in contamination(came["near_duplicates"], items).items() if x[4]}
    assert Counter(came["decontamination"]) == Counter(r for r in came["near_duplicates"] if r[0] not in bad)
    size = Counter()
    for r in came["mixture"]:
        size[r[0]] += len(SPACE.findall(r[1] or ""))
    whole = {r[0]: len(SPACE.findall(r[1] or "")) for r in came["decontamination"]}
    assert set(size) <= set(whole) and all(n <= 3 * whole[i] for i, n in size.items())
    assert abs(sum(size.values()) - sum(whole.values())) <= 12
    assert Counter(r[0] for r in came["tokens"]) == Counter(r[0] for r in came["mixture"])
    assert Counter(map(tuple, corpus_pipeline.run(spark, f"{tmp_path}/d").collect())) == Counter(came["tokens"])


def test_extra_columns_with_names_of_ours(spark, docs, none):
    """Stages and queries with columns that are named like the operators' own, and on empty tables."""
    from newsloom.llm import jaccard, mixing, recompression, winnowing

    names = [
        "mx_at", "mx_size", "mx_others", "w_in", "w_text", "w_hits", "li_in", "li_text", "again", "node", "root", "th", "marks", "m_doc", "start",
        "n", "dim", "shard", "host", "digest", "target", "size", "j_in", "j_doc", "j_again", "w_doc", "w_key", "w_bench", "mx_th", "mx_key",
        "mx_twin", "first", "label", "words"
    ]
    more = docs.where("doc_id < 60 or doc_id > 79").select("*", *(F.lit(1).alias(c) for c in names))
    bench = spark.createDataFrame([(1, "the the the the the the the the the the the the the the", 2)], "item_id bigint, text string, w_in int")
    for out in (compression_lang.accepted(more), jaccard.representatives(more), winnowing.clean(more, bench), mixing.training_order(more)):
        assert out.columns == more.columns and out.count() > 0
    for out in (
        mixing.mix(more), recompression.deduplicate(more), jaccard.join(more), winnowing.decontaminate(more, bench), compression_lang.predict(more)
    ):
        assert out.count() == more.count()
    import public_tokenizers

    known = spark.createDataFrame([(i, i % 2, 1) for i in range(40)], "doc_id bigint, quality int, words int")
    assert rules.predict(more, known).count() == more.count() == arrow_tokens.round_trip(more, public_tokenizers.path("word_bpe_49k.json")).count()
    _, vec = vectors(spark)
    wide = vec.select("*", *(F.lit(1).alias(c) for c in [*names, "place", "ids", "rank", "score", "query_id", "block", "cell"]))
    assert Counter(map(tuple, vptree.neighbours(wide).collect())) == Counter(map(tuple, vptree.neighbours(vec).collect()))
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").select("*", *(F.lit(1).alias(c) for c in names))
    assert boilerplate.extract(pages).count() == warc.round_trip(pages).count() == len(PAGES)
    empty = none.limit(0)
    for out in (compression_lang.accepted(empty), jaccard.representatives(empty), winnowing.clean(empty, bench), mixing.training_order(empty)):
        assert out.columns == docs.columns and out.count() == 0


def test_language_sample_of_null_and_repeated_ids(spark):
    english = ["the house by the river was old and grey " + w for w in ("today", "then", "again", "there", "still")]
    german = ["das alte haus am fluss war grau und leer " + w for w in ("heute", "dann", "wieder", "dort", "noch")]
    rows = [(None, t, "en") for t in english] + [(None, t, "de") for t in german]
    model = compression_lang.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert set(model.dictionaries) == {"en", "de"} and all(w in model.dictionaries["en"] for w in (b"today", b"still"))
    rows = [(1, t, "en") for t in english for _ in range(300)] + [(1, t, "de") for t in german]
    model = compression_lang.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample_docs=3)
    assert 0 < len(model.dictionaries["en"]) <= 3 * 60  # three texts, each once
