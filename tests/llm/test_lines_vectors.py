"""Line deduplication, Lloyd clustering and whitening against plain versions."""

import hashlib
import io
import math
import random
import re
from collections import defaultdict
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import clusters, lines, queries, whiten

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


# ---------------------------------------------------------------- lines

def plain_lines(rows, min_chars, min_docs, largest=True):
    """{(id, text): (lines, kept lines)}"""
    rank = lambda i: (i is not None, i or 0)
    held = defaultdict(set)
    key = lambda x: x.strip(WHITE).translate(LOWER)
    for i, text in rows:
        for x in (text or "").split("\n"):
            held[key(x)].add(i)
    pick = max if largest else min
    gone = {k: pick(ids, key=rank) for k, ids in held.items() if len(k) >= min_chars and len(ids) >= min_docs}
    out = {}
    for i, text in rows:
        every = (text or "").split("\n")
        out[i, text] = (every, [x for x in every if key(x) not in gone or gone[key(x)] == i])
    return out


def line_rows(n=120, seed=5):
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice(["Alpha", "beta", "gämma", "DELTA", "İx"]) + str(r.randint(0, 9)) for _ in range(k))
    common, rare = [say(6) for _ in range(6)], [say(7) for _ in range(30)]
    rows = []
    for i in range(n):
        text = [say(r.randint(0, 9)) for _ in range(r.randint(0, 5))] + r.sample(common, r.randint(0, 3)) + r.sample(rare, r.randint(0, 2))
        r.shuffle(text)
        text = [r.choice(["", " ", "\t", "\x0b"]) + (x.upper() if r.random() < 0.2 else x) + r.choice(["", " \r"]) for x in text]
        if i % 3 == 0:
            text.append(common[0])  # a line of a third of all documents
        if i % 10 == 0:
            text += [common[1]] * 3
        rows.append((i, "\n".join(text)))
    rows += [(None, common[0] + "\n" + rare[0]), (None, common[0] + "\nother"), (500, None), (501, ""), (502, "\n\n"), (7, rows[7][1]), (7, common[2] + "\n" + common[0])]
    rows.append((600, "\n".join([common[3], "x" * 30_000] + [say(3) for _ in range(2000)] + [common[3]])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("share", [(10_000, 1000), (1000, 3)])  # none hot, or all that repeat
@pytest.mark.parametrize("largest", [True, False])
def test_lines_against_plain(spark, monkeypatch, share, largest):
    monkeypatch.setattr(lines, "HOT", share[0])
    monkeypatch.setattr(lines, "FEW", share[1])
    rows = line_rows()
    want = plain_lines(rows, 20, 5, largest)
    done = lines.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(5), min_chars=20, keep_largest=largest)
    got = done.select("row.*", "n_lines", "n_dropped", "keep", lines.kept_text(F.col("row.text"), F.col("keep")).alias("kept")).collect()
    assert len(got) == len(rows)
    assert sum(r["n_dropped"] for r in got) > 100
    for r in got:
        every, kept = want[r["doc_id"], r["text"]]
        assert (r["n_lines"], r["n_dropped"], r["kept"]) == (len(every), len(every) - len(kept), "\n".join(kept))
        assert sum(x["length"] for x in r["keep"]) == len(kept) and len(r["keep"]) <= r["n_dropped"] + 1


def test_lines_odd_tables(spark, odd, empty):
    names = odd.columns
    got = lines.dedup_lines(odd)
    assert got.select("row.*").columns == names and got.count() == odd.count()
    assert lines.dedup_lines(empty).count() == 0
    twice = odd.unionByName(odd)
    assert lines.dedup_lines(twice).count() == twice.count()


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_lines_plan(spark, docs, tmp_path):
    """Native throughout; one range exchange deals lines to their streams, and no other table is shuffled for the windows."""
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    table = lines.line_table(docs, "doc_id", "text", 20)
    assert not re.search(r"Python|Arrow|Pandas|MapIn", plan(table))
    table.write.parquet(str(tmp_path / "lines"))
    gone = plan(lines.repeated_lines(spark.read.parquet(str(tmp_path / "lines")), 5))
    assert not re.search(r"Python|Arrow|Pandas|MapIn|CartesianProduct|BroadcastNestedLoop", gone)
    assert gone.count("rangepartitioning(h1") == 1 and "hashpartitioning(h1" not in gone
    done = plan(lines.dedup_lines(docs))
    assert not re.search(r"Python|Arrow|Pandas|MapIn|BroadcastHashJoin", done)


def test_lines_query_contract(spark, tmp_path):
    """The query's digest, with hand-made lines."""
    a, b = "This line of forty code points, exactly!", "A line of over forty code points that four documents hold"
    assert len(a) == 40
    rows = [(i, f"own {i}\n  {a.upper() if i % 2 else a}\t\n{b if i < 4 else 'c'}") for i in range(6)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_line_dedup"](spark, str(tmp_path)).collect()}
    for i, text in rows:
        kept = text if i == 5 else "\n".join(x for x in text.split("\n") if a.lower() not in x.lower())
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_sha256"]) == (3, int(i != 5), hashlib.sha256(kept.encode()).hexdigest())


# ---------------------------------------------------------------- Lloyd

def plain_lloyd(rows, k, rounds, dimensions):
    """{id: (cluster, distance)}, centroids; rows of (id, vector), ids distinct."""
    x = {i: [math.floor(1024 * float(c)) for c in v] for i, v in rows if v is not None and len(v) == dimensions and all(c is not None and math.isfinite(c) for c in v)}
    start = sorted(x, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:k]
    centroids = [x[i] for i in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for v in x.values():
            groups[near(v)[1]].append(v)
        centroids = [[sum(c) // len(groups[n]) for c in zip(*groups[n])] if groups[n] else old for n, old in enumerate(centroids)]
    return {i: near(v)[::-1] for i, v in x.items()}, centroids


def vectors(n=150, dimensions=4, seed=2):
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(c)) for c in r.normal(size=dimensions) * 0.2 + (i % 3)]) for i in range(n)]
    for i in range(0, n, 11):
        rows[i] = (i, rows[(i + 1) % n][1])  # equal vectors
    nan, inf = float("nan"), float("inf")
    rows += [(9001, None), (9002, [nan] * dimensions), (9003, [1.0, inf, 0.0, 0.0]), (9004, [1.0, None, 0.0, 0.0]), (9005, [1.0] * 3), (9006, []), (9007, [0.0] * dimensions)]
    return rows


VECTORS = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("k, rounds", [(5, 10), (3, 2), (200, 3), (1, 1)])
def test_lloyd_against_plain(spark, k, rounds):
    rows = vectors()
    want, centroids = plain_lloyd(rows, k, rounds, 4)
    got = clusters.lloyd(spark.createDataFrame(rows, VECTORS).repartition(4), clusters=k, rounds=rounds, dimensions=4).collect()
    assert {r["id"]: (r["cluster"], r["distance"]) for r in got} == want
    total = sum(d for _, d in want.values())
    for r in got:
        assert r["inertia"] == total and r["cluster_inertia"] == sum(d for c, d in want.values() if c == r["cluster"])
        assert r["centroid"] == centroids[r["cluster"]]


def test_lloyd_large_integers(spark):
    """Beyond longs where they must be: distances exact, or null if a long can't hold them."""
    rows = [(1, [3e8, -3e8]), (2, [2.9e8, -3e8]), (3, [0.0, 1.0]), (4, [-4e15, 4e15])]
    want, _ = plain_lloyd(rows, 2, 4, 2)
    got = clusters.lloyd(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), clusters=2, rounds=4, dimensions=2).collect()
    assert {r["id"]: (r["cluster"], r["distance"]) for r in got} == {i: (c, d if d < 2**63 else None) for i, (c, d) in want.items()}


def test_lloyd_odd_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert clusters.lloyd(none, dimensions=4).count() == 0
    assert clusters.lloyd(none, dimensions=4).columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (2**60 + 1, [0.0, 0.0]), (2**60 + 1, [0.0, 0.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("id", "cluster", "x", "sums", "a.b")})
    got = clusters.lloyd(df, clusters=2, dimensions=2).collect()
    assert sorted((r["id"] or 0, r["cluster"], r["distance"]) for r in got) == [(0, 0, 0)] * 2 + [(2**60 + 1, 1, 0)] * 2  # equal starts, one left empty at first


# ---------------------------------------------------------------- whitening

def plain_whitening(matrix, k):
    x = np.floor(1024 * matrix.astype(float)) + 100_000
    c = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(c.T @ c / len(c))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    exact = x.astype(np.int64).astype(object)
    return c @ axes / np.sqrt(values), values / ((c * c).sum() / len(c)), ((len(x) * exact - exact.sum(axis=0)) ** 2).sum(axis=1)


@pytest.mark.parametrize("spread", ["flat", "steep"])
def test_whitening_against_plain(spark, spread):
    r, d = np.random.default_rng(4), 40
    scale = np.ones(d) if spread == "flat" else 3.0 ** -np.arange(d)
    matrix = (r.normal(size=(300, d)) * scale * 0.7 @ np.linalg.qr(r.normal(size=(d, d)))[0] + 2).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(matrix)]
    bad = [(-1, None), (-2, [float("nan")] * d), (-3, [None] + [0.0] * (d - 1)), (-4, [float("-inf")] * d), (-5, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, VECTORS).repartition(5)
    got = whiten.whiten(df).collect()
    want, explained, deviation = plain_whitening(matrix, 8)
    assert sorted((x["id"], x["component"]) for x in got) == [(i, k) for i in range(300) for k in range(1, 9)]
    found = np.zeros((300, 8))
    for x in got:
        found[x["id"], x["component"] - 1] = x["whitened"]
        assert x["n"] == 300 and x["deviation"] == deviation[x["id"]] and x["identity_error"] < 1e-9
        assert abs(x["explained"] / explained[x["component"] - 1] - 1) < 1e-9
    found *= np.sign((found * want).sum(axis=0))
    assert np.abs(found - want).max() < 1e-8
    rows = whiten.C.whole_vectors(df.where("size(embedding) > 2"), "vec_id", "embedding", offset=100_000)
    fitted = whiten.fit(rows, d, passes=30 if spread == "steep" else 5)
    assert fitted.expanded == (spread == "flat")  # a steep spectrum needs no more than the subspace
    assert np.abs(fitted.axes.T @ fitted.axes - np.eye(8)).max() < 1e-12


def test_whitening_without_variance(spark):
    none = spark.createDataFrame([], VECTORS)
    assert whiten.whiten(none).columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (None, [1.0, 2.0])], [(1, []), (2, [])]):
        assert whiten.whiten(spark.createDataFrame(rows, VECTORS)).count() == 0
    line = [(i if i else None, [float(i), 2.0 * i, 5.0]) for i in range(9)] + [(8, [8.0, 16.0, 5.0])]  # a line has one component
    df = spark.createDataFrame(line, VECTORS).withColumns({c: F.lit("x") for c in ("id", "n", "x", "v", "a.b")})
    got = whiten.whiten(df).collect()
    assert len(got) == 10 and {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12
    assert None in {r["id"] for r in got}


def test_deviations_exact():
    r = np.random.default_rng(1)
    for size in (10, 10**6, 10**14):
        x = r.integers(-size, size, (20, 3)) + 100_000
        sums = tuple(int(s) for s in x.astype(object).sum(axis=0))
        want = [int(v) if v < 2**63 else None for v in ((20 * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)]
        assert whiten.deviations(x, np.array([s // 20 for s in sums], np.int64), 20, sums) == want
