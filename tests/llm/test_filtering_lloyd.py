import hashlib
import math

import duckdb
import numpy as np
import pytest

from newsloom.llm import filtering_lloyd as lloyd
from newsloom.llm import queries

KIND = "vec_id bigint, embedding array<float>, label int, code string, n int"


@pytest.mark.parametrize(("n", "d", "k"), [(1, 4, 1), (7, 4, 7), (8, 1, 5), (9, 4, 8), (600, 4, 64), (300, 3, 40)])
@pytest.mark.parametrize("spread", [1, 3, 40, 3000])
def test_trees_assign_as_every_pair_does(n, d, k, spread):
    draw = np.random.default_rng(n + spread)
    points = draw.integers(-spread, spread + 1, (3, n, d))
    books = points[:, :k].copy()  # with equal entries where spread is small
    forest = lloyd.Forest.unpacked(lloyd.Forest(points).packed(), 3, d)
    near = ((points[:, :, None, :] - books[:, None, :, :]) ** 2).sum(axis=3).argmin(axis=2)
    assert (forest.codes(books) == near).all()
    sums, counts = forest.moved(books)
    for p in range(3):
        assert counts[p].tolist() == np.bincount(near[p], minlength=k).tolist()
        for e in range(k):
            assert (sums[p, e] == points[p][near[p] == e].sum(axis=0)).all()


def test_whole_subtrees_are_assigned():
    draw = np.random.default_rng(1)
    middles = np.array([[0, 0], [1000, 0], [0, 1000], [1000, 1000]])
    points = (middles[draw.integers(0, 4, 4000)] + draw.integers(-20, 21, (4000, 2)))[None]
    given = sum(len(part) for part, *_ in lloyd.Forest(points).assign(middles[None]))
    assert given < 100


def plain(rows: list, parts: int = 16, entries: int = 64, rounds: int = 2) -> dict:
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    whole = [[math.floor(256 * float(np.float32(x))) for x in r[1]] for r in kept]
    w = len(whole[0]) // parts
    books = [[v[p * w : p * w + w] for v in whole[:entries]] for p in range(parts)]

    def far(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest():
        return [[min(range(len(books[p])), key=lambda e: (far(v[p * w : p * w + w], books[p][e]), e)) for p in range(parts)] for v in whole]

    for _ in range(rounds):
        code = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p * w : p * w + w] for v, c in zip(whole, code, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    code = nearest()
    error = [sum(far(v[p * w : p * w + w], books[p][c[p]]) for p in range(parts)) for v, c in zip(whole, code, strict=True)]
    by_label = {}
    for r, e in zip(kept, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(
        ((str(r[0]), "".join(f"{x:02x}" for x in c), e, by_label[r[2]], sha) for r, c, e in zip(kept, code, error, strict=True))
    )


def odd_rows() -> list:
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.normal(size=32).astype(np.float32)], i % 3, "old", 1) for i in range(90)]
    rows += [(i, rows[i % 5][1], None, "old", 1) for i in range(90, 130)]  # ties
    rows += [(3, rows[3][1], 1, None, None), (None, rows[4][1], None, None, None)]  # repeated and null ids
    rows += [
        (200, None, 1, None, 1), (201, [], 1, None, 1), (202, [1.0] * 31 + [None], 1, None, 1), (203, [float("nan")] + [0.0] * 31, 1, None, 1),
        (204, [0.0] * 31 + [float("-inf")], 1, None, 1), (205, [1.0] * 16, 1, None, 1), (206, [0.0] * 32, None, None, 1)
    ]
    return rows


@pytest.mark.parametrize("bound", [100_000, 0])
def test_rows_equal_plain_rounds(spark, monkeypatch, bound):
    monkeypatch.setattr(lloyd, "small", lambda d: d if bound == 0 else lloyd.F.broadcast(d))
    rows = odd_rows()
    given = spark.createDataFrame(rows, KIND).repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = lloyd.compress(given, block=40)
    assert found.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in found.collect()) == plain(rows)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_fewer_vectors_than_entries_and_none(spark):
    rows = odd_rows()[:5]
    given = spark.createDataFrame(rows, KIND)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in lloyd.compress(given).collect()) == plain(rows)
    for none in (given.limit(0), given.where("embedding is null")):
        empty = lloyd.compress(none)
        assert empty.count() == 0 and empty.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_unfit_lengths_and_components_are_errors(spark):
    with pytest.raises(ValueError):
        lloyd.compress(spark.createDataFrame([(1, [1.0] * 15, 1, "", 1)], KIND))
    with pytest.raises(ValueError):
        lloyd.compress(spark.createDataFrame([(1, [3e38] * 16, 1, "", 1)], KIND))
    assert lloyd.fits(np.array([[1 << 20] * 64])) and not lloyd.fits(np.array([[1 << 29] * 64]))


def test_approximations_are_close(spark):
    given = spark.createDataFrame(odd_rows()[:90], KIND)
    books, trees, names = lloyd.train(given, rounds=4)
    coded = lloyd.rebuilt(lloyd._coded(trees, books, names), books).join(given.select("vec_id", "embedding"), "vec_id")
    for r in coded.collect():
        assert np.abs(np.array(r.approximation) - np.array(r.embedding)).mean() < 0.5


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{folder}/embeddings.parquet'")
    want = con.execute(queries.oracle_sql()["op12_filtering_lloyd"])
    names = [d[0] for d in want.description]
    found = queries.queries()["op12_filtering_lloyd"](spark, folder)
    assert sorted(found.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in found.collect()) == sorted(want.fetchall())
