import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=60, seed=3):
    """Small texts with copies, near copies, shared passages, nulls, blanks, long and self-repeating ones."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéöß") for _ in range(r.randint(1, 7))) for _ in range(300)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = say(70)
    rows = []
    for i in range(n):
        kind = i % 10
        text = say(r.randint(5, 120))
        if kind == 1:
            text += "\n" + shared
        elif kind == 2 and rows:
            text = r.choice(rows)[1]
        elif kind == 3 and rows and rows[-1][1]:
            w = (rows[-2][1] or "x y").split(" ")
            w[len(w) // 2] = "zzz"
            text = " ".join(w)
        elif kind == 4:
            text = "\n".join([say(4)] * r.randint(1, 6) + [say(9)])
        elif kind == 5:
            text = "abcab " * r.randint(20, 90)
        elif i == 16:
            text = None
        elif i == 17:
            text = ""
        elif i == 18:
            text = " \t\n \x0b"
        elif i == 26:
            text = say(6000)
        rows.append((i * 3 + 1, text, "en", None if i % 13 == 0 else f"s{i % 4}", len(text or "")))
    rows.append((5000, rows[7][1], "en", "s1", 1))
    rows.append((5000, rows[7][1], "en", "s1", 1))  # a repeated row
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark, docs):
    """Extra columns whose names clash with the operators' own, and a null id."""
    from pyspark.sql import functions as F

    more = docs.sparkSession.createDataFrame([(None, "some words without an id here", "en", "s1", 3)], SCHEMA)
    return docs.unionByName(more).withColumns({c: F.lit("x") for c in ("id", "row", "size", "_pack", "_text", "_id", "key", "fp", "bucket", "tokens", "kept", "copies", "a.b")})
