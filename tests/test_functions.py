"""Column functions against plain Python."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import rules, text


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_tokens(spark):
    values = ["Hello, World-42", "réeau", "aKb", "中文字 x 中", "\U00020000中文", None, " \t\n", "İx"]
    assert column(spark, values, text.tokenize) == [["hello", "world", "42"], ["r", "eau"], ["a", "b"], ["中文", "文字", "x", "中"], ["中文"], [], [], ["x"]]


def test_trim_and_blank(spark):
    values = ["\x00 a b\t\x1f", " x", None, " \t\n", ""]
    assert column(spark, values, text.java_trim) == ["a b", " x", None, "", ""]
    assert column(spark, values, text.blank) == [False, False, True, True, True]
    assert column(spark, values, lambda c: text.or_default(c, "d")) == ["\x00 a b\t\x1f", " x", "d", "d", "d"]


def norm(s):
    s = (s or "").strip("".join(map(chr, range(33)))).lower()
    if "://" in s:
        s = s[s.index("://") + 3 :]
    s = s.split("#", 1)[0]
    return s.removeprefix("www.").rstrip("/")


def test_sources(spark):
    r = random.Random(1)
    parts = ["http://", "https://", "www.", "#x", "/", "//", "a.html", "proxy.html", "dynamic-proxy.html", " ", "A", "://", "?q=1", "\n"]
    values = ["".join(r.choice(parts) for _ in range(r.randint(0, 6))) for _ in range(400)] + [None]
    got = column(spark, values, text.normalize_source)
    assert got == [norm(v) for v in values]
    pairs = [(r.choice(got), r.choice(got)) for _ in range(600)] + [("proxy.html", "dynamic-proxy.html"), ("a/proxy.html", "proxy.html")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    said = [x[0] for x in df.orderBy("i").select(text.source_matches(F.col("a"), F.col("b"))).collect()]
    assert said == [bool(a and b and (a == b or a.endswith("/" + b) or b.endswith("/" + a))) for a, b in pairs]


def test_names(spark):
    def java(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return h

    urls = ["https://a.b/c?d=1#e", "x" * 90, "", "/"]
    import re

    assert column(spark, urls, text.cache_file_name) == [re.sub("[^A-Za-z0-9]+", "_", u)[:60] + f"_{java(u):x}.txt" for u in urls]
    assert column(spark, [0, 3, 7, 2**40 + 5, -9], text.avatar_bucket, "long") == [abs((lambda f: f - 2**32 if f >= 2**31 else f)((i ^ (i % 2**64 >> 32)) & 0xFFFFFFFF)) % 4 for i in (0, 3, 7, 2**40 + 5, -9)]


def test_chunk_ids(spark):
    import hashlib

    df = spark.createDataFrame([(f"v{i}", i) for i in range(60)], "v string, i int")
    for r in df.select("v", "i", text.chunk_id(F.lit("url"), F.col("v"), F.col("i")).alias("id")).collect():
        assert r["id"] == str(uuid.UUID(bytes=hashlib.md5(f"url|{r['v']}#{r['i']}".encode()).digest(), version=3))


def test_cache_round_trip(spark):
    df = spark.createDataFrame([("u1", "body\n\nmore"), ("u2", ""), ("u3", "source: no\nheader")], "u string, b string")
    cached = df.select("u", "b", text.build_cache(F.col("u"), F.col("b")).alias("c"))
    source, body = text.parse_cache(F.col("c"), F.lit("asked"))
    assert all(r["u"] == r["s"] and r["b"] == r["t"] for r in cached.select("u", "b", source.alias("s"), body.alias("t")).collect())
    source, body = text.parse_cache(F.col("b"), F.lit("asked"))
    assert {r["s"] for r in cached.select(source.alias("s")).collect()} == {"asked"}


def test_formats(spark):
    assert column(spark, [0.1234, None, 0.0, -0.5], text.as_delta, "double") == ["+0.123", "-", "0", "-0.500"]
    assert column(spark, ["a|b\nc", None, "x" * 70], text.table_cell) == ["a/b c", "", "x" * 60 + "…"]


@pytest.mark.parametrize(("salary", "score", "change"), [(12345, 75, 617), (10010, 89, 501), (10000, 90, 1000), (10000, 60, 200), (10000, 59, -500), (10000, 40, -500), (10000, 39, -1000), (0, 90, 0), (5, 40, 0), (10, 40, -1)])
def test_salary_change(spark, salary, score, change):
    df = spark.createDataFrame([(salary, score)], "s int, x int")
    assert df.select(rules.salary_change(F.col("x"), F.col("s"))).first()[0] == change


def test_grading(spark):
    r = random.Random(3)
    rows = [(i, [r.choice("abcd") for _ in range(r.randint(0, 5))], [r.choice("abcde") for _ in range(r.randint(0, 5))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, t array<string>, u array<string>")
    for x in df.select("t", "u", rules.local_grade(F.col("t"), F.col("u")).alias("g")).collect():
        t, u = set(x["t"]), set(x["u"])
        raw = 100 * (len(u & t) - len(u - t)) / len(t) if t else 0
        assert tuple(x["g"]) == (len(u & t), len(u - t), len(t - u), max(0, min(100, int(raw + 0.5 // 1) if raw < 0 else int(raw + 0.5))))


def test_ledger_is_a_fold(spark):
    df = spark.createDataFrame([(10000, [95, 10, 10, 60]), (3, [0, 0, 0]), (7, [])], "s int, x array<int>")
    assert [r[0] for r in df.select(rules.final_salary(F.col("s"), F.col("x"))).collect()] == [9088, 3, 7]


def test_nearest_rank(spark):
    import math

    r = random.Random(5)
    for n in (0, 1, 2, 3, 19, 20, 30):
        values = [r.randint(0, 50) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "v long")
        got = df.agg(rules.nearest_rank(F.col("v"), 0.5).alias("a"), rules.nearest_rank(F.col("v"), 0.95).alias("b")).first()
        want = [sorted(values)[max(0, math.ceil(p * n) - 1)] if n else 0 for p in (0.5, 0.95)]
        assert list(got) == want
