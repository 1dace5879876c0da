"""Near copies against all pairs."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, copies

from .conftest import SCHEMA


def roots(n, links):
    top = list(range(n))

    def root(a):
        while top[a] != a:
            a = top[a]
        return a

    for a, b in links:
        top[root(a)] = root(b)
    return [root(a) for a in range(n)]


def plain_print(text, width=5, longs=16, segment_bits=32, weak=3):
    """(fingerprint, keys) bit by bit."""
    words = text.lower().split()
    grams = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    hashes = copies.shingles([text], width)[0].tolist()
    assert len(hashes) == len(grams)
    ones = [0] * (64 * longs)
    for f in range(longs):
        for h in copies.C.mix(np.array([(h + (2 * f + 1) * 0x9E3779B97F4A7C15) % 2**64 for h in hashes], np.uint64)).tolist():
            for b in range(64):
                ones[64 * f + b] += h >> b & 1
    bits = [2 * x > len(hashes) for x in ones]
    keys = set()
    for s in range(64 * longs // segment_bits):
        at = range(s * segment_bits, (s + 1) * segment_bits)
        least = sorted(at, key=lambda b: abs(2 * ones[b] - len(hashes)))[:weak]
        for flip in itertools.product((0, 1), repeat=weak):
            own = {b: bits[b] for b in at}
            for b, x in zip(least, flip):
                own[b] ^= bool(x)
            keys.add((s, tuple(own.values())))
    return sum(1 << b for b, x in enumerate(bits) if x), keys


def near_plain(rows, similarity=0.8, slack=1.0, longs=16):
    """{row: class}, rows being (id, text); a class is the number of its root row."""
    made = [plain_print((x or "").encode()) for _, x in rows]
    radius = copies.reach(similarity, 64 * longs, slack)
    return roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (made[a][0] ^ made[b][0]).bit_count() <= radius and made[a][1] & made[b][1]])


def kept_plain(rows):
    """The rows that stay, one of a class: null ids last; ties of one id are left out of the test's data."""
    best = {}
    for n, c in enumerate(near_plain(rows)):
        if c not in best or (rows[n][0] is None, rows[n][0] or 0) < (rows[best[c]][0] is None, rows[best[c]][0] or 0):
            best[c] = n
    return sorted(rows[n][0] for n in best.values())


def edited(seed=5, n=250):
    """Groups of edited copies, of 2 to 60 texts, among others."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for size in [1] * 20 + [2] * 10 + [12, 60]:
        base = [r.choice(words) for _ in range(n)]
        for _ in range(size):
            text = list(base)
            for _ in range(r.randint(0, 4)):
                text[r.randrange(n)] = f"edit{r.randrange(9)}"
            rows.append((len(rows), " ".join(text), "en", "s", 0))
    r.shuffle(rows)
    return rows


def by_class(found):
    groups = defaultdict(set)
    for r in found:
        groups[r["component_id"]].add(r["id"])
    assert all(c == min(g) for c, g in groups.items())
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("setting", [{}, {"block": 2}, {"block": 5, "pack_prints": 9}])
def test_classes_are_those_of_all_pairs_that_meet(spark, setting):
    rows = edited()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    groups = defaultdict(list)
    for (i, *_), c in zip(rows, near_plain([r[:2] for r in rows])):
        groups[c].append(i)
    assert by_class(copies.near_copies(df, **setting).collect()) == sorted(map(sorted, groups.values()))


def test_texts_of_the_similarity_are_found():
    """Each pair by itself, with from 0.8 to 1 of its shingles in common: ninety of a hundred meet and are near."""
    r, radius, found, pairs = random.Random(8), copies.reach(0.8, 1024, 1.0), 0, 0
    while pairs < 150:
        a = [str(r.random()) for _ in range(r.randint(60, 400))]
        b = list(a)
        for _ in range(max(1, round(len(a) * r.uniform(0, 0.025)))):
            b[r.randrange(len(b))] = str(r.random())
        grams = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b)]
        if not 0.8 <= len(grams[0] & grams[1]) / len(grams[0] | grams[1]) <= 0.9:
            continue
        f, least = copies.prints([" ".join(w).encode() for w in (a, b)])
        keys = copies.ball_keys(f, least, 32, 3)
        found += bool(np.intersect1d(*keys).size) and int(np.bitwise_count(f[0] ^ f[1]).sum()) <= radius
        pairs += 1
    assert found >= 0.9 * pairs


@pytest.mark.parametrize("block", [1000, 3])
def test_a_segment_that_far_groups_share(spark, block):
    """Leaders link few of its owners; the rest is compared across components."""
    r = np.random.default_rng(4)
    rows = []
    for _ in range(12):
        base = r.integers(-(2**62), 2**62, 8)
        base[0] = 77
        for _ in range(5):
            one = base.copy()
            one[r.integers(1, 8)] ^= 1 << int(r.integers(0, 60))
            rows.append((len(rows), *[int(x) for x in one], bytes(range(3)) * 16))
    df = spark.createDataFrame(rows, "node long, " + ", ".join(f"f{i} long" for i in range(8)) + ", weak binary")
    got = {x["node"]: x["component"] for x in copies.classes(df, 8, 32, 3, 77, block, 8192).collect()}
    assert got == {n: n // 5 * 5 for n in range(60)}


def test_one_row_of_each_class_by_row_not_by_id(spark):
    r = random.Random(2)
    say = lambda: " ".join(r.choice("abcdefghijklmnop") + str(r.randrange(99)) for _ in range(80))
    a, b, c = say(), say(), say()
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, say()), (None, c), (4, None), (5, ""), (5, None)]
    df = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows], SCHEMA).withColumns({"id": F.lit("x"), "first": F.lit(1), "a.b": F.lit(2), "_row": F.lit(3)})
    out = copies.one_of_each(df)
    assert out.columns == df.columns
    got = [(x["doc_id"], x["text"]) for x in out.collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (3, c), (None, rows[5][1]), (4, None)], key=str)


def test_odd_and_empty(docs, odd, empty):
    assert copies.near_copies(empty).count() == 0 and copies.one_of_each(empty).count() == 0
    assert copies.near_copies(odd).count() == odd.count()
    rows = [(x["doc_id"], x["text"]) for x in docs.dropDuplicates(["doc_id"]).collect()]
    assert sorted(x["doc_id"] for x in copies.one_of_each(docs).collect()) == kept_plain(rows)


def test_reach():
    assert copies.reach(1, 512) == 0 and 70 < copies.reach(0.8, 512) < 80 < copies.reach(0.8, 512, 1)


def test_hubs_are_spread(spark, monkeypatch):
    """Components of a star, a chain and pairs, with hubs sent to the edges; and the plan keeps all else from being sent."""
    edges = [(1000, n) for n in range(1, 400)] + [(2000 + n, 2001 + n) for n in range(40)] + [(3000 + 2 * n, 3001 + 2 * n) for n in range(30)] + [(5, 5), (1000, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    want = sorted(map(tuple, common.components(df).collect()))
    assert dict(want)[1000] == 1 and dict(want)[2040] == 2000
    monkeypatch.setattr(common, "FEW_OF_HUB", 20)
    monkeypatch.setattr(common, "HUBS", 10)
    assert sorted(map(tuple, common.components(df).collect())) == want
    big, small = df.select("u", "v"), df.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    plain = sorted(map(tuple, big.join(small.drop("n"), "u").collect()))
    assert sorted(map(tuple, common.hub_join(big, small, "u", len(edges)).collect())) == plain


def test_growing_tables_are_not_sent(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "docs"))
    found = copies.near_copies(spark.read.parquet(str(tmp_path / "docs")))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    kept = copies.one_of_each(spark.read.parquet(str(tmp_path / "docs")))
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()


def test_rows_with_maps(spark):
    rows = [(1, "some words of a text that repeats", {"a": 1}), (1, "some words of a text that repeats", {"a": 1}), (2, "another text of other words", None)]
    got = copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, facts map<string, int>")).collect()
    assert sorted((r["doc_id"], str(r["facts"])) for r in got) == [(1, "{'a': 1}"), (2, "None")]
