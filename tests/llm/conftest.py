import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(draw: random.Random, n: int, stem: str = "w", kinds: int = 400) -> list[str]:
    return [f"{stem}{draw.randrange(kinds)}" for _ in range(n)]


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, runs, odd texts, repeated rows, a hot source."""
    draw = random.Random(5)
    passage = " ".join(words(draw, 60, "p"))
    rows = []
    base = words(draw, 120)
    for i in range(40):
        own = list(base)
        for _ in range(draw.randrange(3)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    for i in range(40, 70):
        rows.append((i, " ".join(words(draw, draw.randrange(3, 200), "r", 10**6)) + "\n" + passage * (i % 3 == 0)))
    for i in range(70, 80):
        rows.append((i, " ".join(words(draw, 90, "t", 50))))
    rows += [
        (80, None), (81, ""), (82, " \t\n "), (83, "one"), (84, "one"), (85, "One two three"), (86, "the " * 200), (87, "a b " * 150),
        (88, "été 中文 \U0001f600 naïve"), (89, "1 2 3 ... !!!")
    ]
    rows += [(90, "long " + " ".join(words(draw, 30000, "l", 5000))), (91, rows[0][1]), (91, rows[0][1]), (92, rows[41][1].upper())]
    rows.append((None, rows[0][1]))
    out = []
    for i, t in rows:
        lang = None if i is None or i % 11 == 0 else "en" if i % 2 else "de"
        source = None if i == 83 else "hot" if (i or 0) % 3 == 0 else f"s{(i or 0) % 7}"
        out.append((i, t, lang, source, None if t is None else len(t)))
    return out


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
