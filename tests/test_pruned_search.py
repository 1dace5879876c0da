"""Searches that skip what can't be among the best, against those that read everything."""

import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import balls, blocks, bm25, vector
from tessera.session import checkpoints


def corpus(spark, n, seed):
    """Texts of a few very frequent words and many rare ones; some equal, some empty, one null."""
    r = random.Random(seed)
    common, rare = ["the", "of", "and", "to"], [f"word{k}" for k in range(300)]
    rows = []
    for i in range(n):
        words = [r.choice(common) for _ in range(r.randint(3, 12))] + [rare[min(299, int(r.expovariate(0.02)))] for _ in range(r.randint(0, 6))]
        r.shuffle(words)
        rows.append((i, " ".join(words) if i % 17 else rows[-1][1] if rows else ""))
    rows += [(n, ""), (n + 1, None)]
    return spark.createDataFrame(rows, "chunk_id long, text string").repartition(3)


@pytest.mark.parametrize("n, seed", [(3, 0), (20, 1), (5000, 2)])
def test_block_search_is_exact(spark, tmp_path, n, seed):
    plain = bm25.build_index(corpus(spark, 600, seed))
    index = blocks.build(plain, 32).write(f"file://{tmp_path}/index")
    r = random.Random(seed + 9)
    asked = [(k, " ".join(r.sample(["the", "of", "and", "to"], 2) + [f"word{r.randint(0, 40)}" for _ in range(r.randint(0, 3))])) for k in range(12)] + [(50, ""), (51, None), (52, "nowhere"), (53, "the")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    want = plain.search(queries, n)
    got = index.search(queries, n).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert index.search(queries, 0).count() == 0


def test_block_search_skips(spark, tmp_path):
    """Where a rare term decides, the frequent ones' cells stay closed."""
    index = blocks.build(bm25.build_index(corpus(spark, 3000, 4)), 8).write(f"file://{tmp_path}/index")
    queries = spark.createDataFrame([(k, f"the of and to word{k}") for k in (90, 110, 130)], "query_id int, query string")
    row = blocks.cells_read(index, queries, 2).first()
    assert row["cells_read"] < 0.25 * row["cells"]
    strings = corpus(spark, 50, 1).withColumn("chunk_id", F.concat(F.lit("c"), F.col("chunk_id").cast("string")))
    plain = bm25.build_index(strings)
    assert sorted(map(tuple, blocks.build(plain, 4).search(queries, 5).select("query_id", "chunk_id", "rank").collect())) == sorted(map(tuple, plain.search(queries, 5).select("query_id", "chunk_id", "rank").collect()))


def test_block_search_writes_no_pairs(spark, tmp_path, monkeypatch):
    """Nothing of a search is written, however many queries; postings in any order and small matrices give the same rows."""
    bm25.build_index(corpus(spark, 400, 6)).write(f"file://{tmp_path}/plain")  # sorted by term
    plain = bm25.Bm25Index.read(spark, f"file://{tmp_path}/plain")
    index = blocks.build(plain, 16).write(f"file://{tmp_path}/index")
    asked = [(k, f"the of and to word{k % 50}") for k in range(60)]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    want = sorted(map(tuple, plain.search(queries, 4).collect()))
    checkpoints(spark)
    folder = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    monkeypatch.setattr(blocks, "NUMBERS", 100)
    assert sorted(map(tuple, index.search(queries, 4).select("query_id", "chunk_id", "score", "rank").collect())) == want
    assert size() == before


@pytest.mark.parametrize("kind, n, most", [("groups", 5, 8192), ("flat", 7, 8192), ("groups", 3, 10), ("groups", 5000, 8192)])
def test_ball_search_is_exact(spark, tmp_path, monkeypatch, kind, n, most):
    monkeypatch.setattr(vector, "MOST_QUERIES", most)
    g = np.random.default_rng(5)
    middle = g.normal(size=(12, 6)) * (8 if kind == "groups" else 0)
    rows = [(f"c{i}", [float(x) for x in middle[i % 12] + g.normal(size=6)]) for i in range(700)]
    rows += [(f"e{i}", rows[i][1]) for i in range(20)] + [("none", None), ("short", [1.0]), ("zero", [0.0] * 6)]
    corpus = spark.createDataFrame(rows, "chunk_id string, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(i, rows[i * 9][1]) for i in range(25)] + [(90, None), (91, [1.0]), (92, [0.0] * 6)], "query_id int, vector array<double>")
    index = balls.build(corpus).write(f"file://{tmp_path}/balls")
    want = [r for r in vector.search(queries, corpus, n, -1e9).collect() if r["query_id"] != 91]  # no ball has its length
    got = index.search(queries, n, -1e9).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    read, every = balls.pairs_read(index, queries, n)
    assert read < 0.4 * every if (kind, n) == ("groups", 5) else read <= every
    assert sorted(map(tuple, index.search(queries, n, 0.6, "unit").collect())) == sorted(tuple(r) for r in vector.search(queries, corpus, n, 0.6, "unit").collect() if r["query_id"] != 91)


def test_ball_search_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, vector array<double>")
    assert balls.build(none).search(queries, 3).count() == 0
    assert balls.build(queries.withColumnRenamed("query_id", "chunk_id")).search(queries.limit(0), 3).count() == 0
