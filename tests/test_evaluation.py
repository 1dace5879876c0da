"""Evaluations as one call: failing steps, runs of a folder, rebuilds meanwhile."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import bm25, embed, evaluate, retrieve, segments
from tessera.operators import manifest as M
from tessera.sources import pages

TEXTS = [(1, "doc/1", "alpha beta gamma"), (2, "doc/2", "delta epsilon"), (3, "doc/3", "alpha zeta"), (4, "doc/4", "eta theta")]
CASES = [("a", "alpha beta", ["doc/1"]), ("b", "delta", ["doc/2"]), ("c", "broken", ["doc/3"]), ("d", "eta", ["doc/9"])]


def fails(text):
    if text == "broken":
        raise RuntimeError("no vector")
    return embed.hashed_terms(text, 64)


class Lost:
    def search(self, queries, n, id_cols=None):
        return queries.select(*id_cols, F.raise_error(F.lit("index lost")).cast("long").alias("chunk_id"), F.lit(1).alias("rank"))


@pytest.fixture(scope="module")
def parts(spark):
    chunks = spark.createDataFrame(TEXTS, "chunk_id long, source string, text string")
    corpus = retrieve.Corpus(chunks, embed.embed_chunks(chunks, embed.HashedTerms(64)), bm25.scan(chunks), embed.PythonEmbedder(fails))
    cases = spark.createDataFrame(CASES, "case_id string, query string, expected array<string>")
    queries = cases.select(F.col("case_id").alias("query_id"), "query", F.array().cast("array<string>").alias("rewrites"))
    return corpus, cases, queries


def test_a_failing_step_is_its_case_alone(spark, parts):
    corpus, cases, queries = parts
    rewrites = queries.withColumn("rewrites", F.when(F.col("query_id") == "b", F.array(F.lit("broken"))).otherwise(F.col("rewrites")))
    got = {(r["variant_id"], r["case_id"]): (r["error"], r["returned"]) for r in evaluate.run_variants(cases, rewrites, corpus, evaluate.parse_variants(["all-on", "no-rewrite"])).collect()}
    assert got["all-on", "a"] == (None, ["doc/1", "doc/3"])
    assert got["all-on", "b"] == ("no vector", []) and got["no-rewrite", "b"] == (None, ["doc/2"])  # only a rewrite of it fails
    assert got["all-on", "c"] == got["no-rewrite", "c"] == ("no vector", [])
    lost = retrieve.Corpus(corpus.chunks, corpus.vectors, Lost(), embed.HashedTerms(64))
    found = evaluate.run_variants(cases, queries, lost, evaluate.parse_variants(["all-on", "no-hybrid"])).collect()
    assert all(("lost" in r["error"] and not r["returned"]) if r["variant_id"] == "all-on" else r["error"] is None for r in found)
    metrics = evaluate.aggregate_metrics(evaluate.score_cases(spark.createDataFrame(found).withColumn("cost_ms", F.lit(5))), ["variant_id"]).collect()
    assert {r["variant_id"]: (r["total"], r["failed"]) for r in metrics} == {"all-on": (4, 4), "no-hybrid": (4, 0)}


def test_runs_of_a_folder(spark, parts, tmp_path):
    corpus, cases, queries = parts
    folder = f"file://{tmp_path}/runs"
    assert [x.count() for x in evaluate.read_runs(spark, folder)] == [0, 0]
    store = segments.SegmentStore(spark, f"file://{tmp_path}/index")
    docs = spark.createDataFrame([("file_name", "a", "one", 1)], "source_key string, source_value string, text string, ord long")
    segments.update(store, docs, docs.limit(0), M.Header("docs"))
    first = evaluate.evaluate(cases, queries, corpus, folder, "20240101", store=store, variants=["no-rerank"])
    assert (first.previous_run_id, first.collection, first.collection_changed, first.case_count) == (None, "docs", False, 4)
    assert first.metrics[0]["failed"] == 1 and first.metrics[0]["delta_mrr"] is None and {m["case_id"] for m in first.misses} == {"c", "d"}
    for n, text in enumerate(("", "{", '{"metrics": 3}', '{"runId": "x"}')):
        pages.write_text(spark, f"{folder}/2024010{n + 2}/report.json", text)
    second = evaluate.evaluate(cases.where("case_id <> 'c'"), queries, corpus, folder, "20240109", variants=["no-rerank", "all-on"])
    assert second.previous_run_id == "20240101" and [m["variant_id"] for m in second.metrics] == ["no-rerank", "all-on"]
    assert second.metrics[0]["delta_hit_rate"] == round(2 / 3 - 0.5, 6) and second.metrics[1]["delta_hit_rate"] is None
    runs, broken = evaluate.read_runs(spark, folder)
    assert sorted((r["run_id"], r["variant_id"]) for r in runs.collect()) == [("20240101", "no-rerank"), ("20240109", "all-on"), ("20240109", "no-rerank")]
    assert {r["run_id"] for r in broken.collect()} >= {"20240103", "20240104", "20240105"}
    assert pages.latest_run(runs).count() == 2 and pages.latest_run(runs, "20240109").count() == 1
    with pytest.raises(ValueError, match="blank"):
        evaluate.evaluate(spark.createDataFrame([("x", " ", ["a"])], cases.schema), queries, corpus, folder, "z")
