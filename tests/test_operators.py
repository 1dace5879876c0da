"""Operators against plain Python models."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as text_functions
from tessera.operators import bm25, chunk, embed, evaluate, fusion, game, manifest, retrieve, vector
from tessera.sources import adapters, pages
from tessera.streaming import rebuild


# ------------------------------------------------------------------ retrieval

@pytest.mark.parametrize("kind", ["postings", "scan", "scan of too many queries"])
def test_bm25(spark, kind, monkeypatch):
    if kind.endswith("queries"):
        monkeypatch.setattr(bm25, "MOST_QUERIES", 3)
    r = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 9)))) for i in range(40)] + [(90, None), (91, "  " + "w1 w2"), (92, "w1 w2 ")]
    queries = [(i, " ".join(r.choice(words + ["none"]) for _ in range(r.randint(0, 4)))) for i in range(15)]
    index = (bm25.build_index if kind == "postings" else bm25.scan)(spark.createDataFrame(docs, "chunk_id long, text string"))
    got = defaultdict(list)
    for x in index.search(spark.createDataFrame(queries, "query_id long, query string"), 5).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["chunk_id"], x["score"]))
    kept, seen = [], set()
    for i, t in docs:
        key = t.strip() if t is not None else None
        if key not in seen:
            seen.add(key)
            kept.append((i, (t or "").split()))
    n, mean = len(kept), sum(len(t) for _, t in kept) / len(kept)
    df = Counter(w for _, t in kept for w in set(t))
    for q, text in queries:
        scores = []
        for i, t in kept:
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in dict.fromkeys(text.split()) if w in t)
            if round(s, 6) > 0:
                scores.append((-round(s, 6), i))
        assert got[q] == [(i, -s) for s, i in sorted(scores)[:5]]
    assert index.search(spark.createDataFrame(queries, "query_id long, query string"), 0).count() == 0


def test_bm25_index_round_trip(spark, tmp_path):
    index = bm25.build_index(spark.createDataFrame([(1, "a b"), (2, "b c")], "chunk_id long, text string"))
    index.write(str(tmp_path))
    back = bm25.Bm25Index.read(spark, str(tmp_path))
    q = spark.createDataFrame([(1, "b c")], "query_id long, query string")
    assert bm25.search(index, q, 5).collect() == bm25.search(back, q, 5).collect()


@pytest.mark.parametrize("most", [8192, 2])
def test_vectors(spark, monkeypatch, most):
    monkeypatch.setattr(vector, "MOST_QUERIES", most)
    r = np.random.default_rng(1)
    x = r.normal(size=(50, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(77, x[3].tolist()), (78, None)], "chunk_id long, vector array<double>")
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(6)] + [(9, None)], "query_id long, vector array<double>")
    got = defaultdict(list)
    for row in vector.search(queries, corpus, 4, min_score=0.1).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append(row["chunk_id"])
    ids = [*range(50), 77]
    all_x = np.vstack([x, x[3]])
    for q in range(6):
        s = np.round(all_x @ x[q], 6)
        assert got[q] == [i for v, i in sorted((-s[k], ids[k]) for k in range(51)) if -v >= 0.1][:4]
    assert 9 not in got


def walk(rows, limit, m):
    used, first, rest = Counter(), [], []
    for i, s in rows:
        if m <= 0 or s is None or used[s] < m:
            first.append(i)
            if s is not None:
                used[s] += 1
        else:
            rest.append(i)
    return (first + rest)[: max(0, limit)]


@pytest.mark.parametrize(("limit", "m"), [(3, 2), (5, 1), (4, 0), (0, 2), (20, 3), (3, -1)])
def test_diverse(spark, limit, m):
    r = random.Random(limit * 10 + m)
    rows = [(q, k, r.choice(["a", "b", "c", None])) for q in range(25) for k in range(1, r.randint(2, 12))]
    df = spark.createDataFrame(rows, "q int, final_rank int, source string")
    got = defaultdict(list)
    for x in fusion.select_diverse(df, limit, m, ["q"]).orderBy("q", "pos").collect():
        got[x["q"]].append(x["final_rank"])
    for q in range(25):
        assert got[q] == walk([(k, s) for a, k, s in rows if a == q], limit, m)


def test_rrf(spark):
    rows = [(1, 0, 0, 1, "A", 10), (1, 0, 0, 2, "B", 11), (1, 0, 1, 1, "B", 12), (1, 0, 1, 2, "B", 13), (1, 1, 0, 1, "C", 14), (1, 1, 1, 1, "A", 15)]
    df = spark.createDataFrame(rows, "query_id int, q_idx int, route int, rank int, key string, chunk_id long").withColumns({"source": F.lit("s"), "text": F.col("key")})
    got = {r["key"]: (r["chunk_id"], r["rrf"]) for r in fusion.rrf(df, ["query_id"]).collect()}
    assert got == {"A": (10, round(2 / 61, 9)), "B": (11, round(1 / 62 + 1 / 61 + 1 / 62, 9)), "C": (14, round(1 / 61, 9))}


def test_expand(spark):
    df = spark.createDataFrame([(1, " q ", [" a", "", None, "a", "b", "c", "d", "e"]), (2, "x", None)], "query_id int, query string, rewrites array<string>")
    got = [(r["query_id"], r["q_idx"], r["query"]) for r in retrieve.expand_queries(df).orderBy("query_id", "q_idx").collect()]
    assert got == [(1, 0, " q "), (1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "d"), (2, 0, "x")]
    assert retrieve.expand_queries(df, enabled=False).count() == 2


def corpus(spark):
    texts = [(i, f"s{i % 3}", f"alpha{i} beta{i % 4} gamma") for i in range(20)]
    chunks = spark.createDataFrame(texts, "chunk_id long, source string, text string")
    vectors = spark.createDataFrame([(i, [math.cos(i / 5), math.sin(i / 5)]) for i in range(20)], "chunk_id long, vector array<double>")
    return retrieve.Corpus(chunks, vectors, bm25.build_index(chunks))


def test_retrieve_degrades_only_if_not_strict(spark):
    c = corpus(spark)
    q = spark.createDataFrame([(1, "alpha3 beta1", ["beta2"], [1.0, 0.0])], "query_id long, query string, rewrites array<string>, vector array<double>")
    full = retrieve.retrieve(q, c)
    assert [r["pos"] for r in full.orderBy("pos").collect()] == [1, 2, 3]
    broken = retrieve.Corpus(c.chunks, c.vectors.select("chunk_id"), c.index)
    assert retrieve.retrieve(q, broken).count() == 3
    with pytest.raises(Exception):
        retrieve.retrieve(q, broken, strict=True)
    text = retrieve.retrieve_context(q, c).first()["context"]
    assert text.count("\n\n---\n\n") == 2
    assert "rerank=off" in retrieve.RetrieveOptions().with_(rerank=False).describe()


# ------------------------------------------------------------------ index lifecycle

def sources(spark, rows):
    return spark.createDataFrame([("file_name", v, t, i) for i, (v, t) in enumerate(rows)], "source_key string, source_value string, text string, ord long")


NONE = "source_key string, source_value string"


def test_chunks(spark):
    df = spark.createDataFrame([(1, "x" * 1234), (2, ""), (3, None), (4, "y" * 500), (5, "z" * 501)], "i int, text string")
    got = defaultdict(list)
    for r in chunk.chunk_texts(df).orderBy("i", "chunk_idx").collect():
        got[r["i"]].append(len(r["chunk_text"]))
    assert got == {1: [500, 500, 434], 2: [0], 4: [500], 5: [500, 101]}
    with pytest.raises(ValueError):
        chunk.chunk_texts(df, overlap=500)


@pytest.mark.parametrize("splitter", chunk.SPLITTERS)
def test_incremental_equals_full(spark, tmp_path, splitter):
    header = manifest.Header("c1", splitter=splitter)
    store = manifest.Store(spark, str(tmp_path / "a"))
    first = [("a", "text a " * 200), ("b", "b"), ("c", "c"), ("a", "twice")]
    assert manifest.rebuild(store, sources(spark, first), spark.createDataFrame([], NONE), header).mode == "full"
    assert manifest.rebuild(store, sources(spark, first), spark.createDataFrame([], NONE), header).mode == "none"
    second = [("a", "new a " * 90), ("d", "d " * 400), ("b", "b")]
    status = manifest.rebuild(store, sources(spark, second), spark.createDataFrame([], NONE), header)
    assert (status.mode, status.counts) == ("incremental", {"added": 1, "changed": 1, "removed": 1, "unchanged": 1, "failed": 0})
    other = manifest.Store(spark, str(tmp_path / "b"))
    manifest.rebuild(other, sources(spark, second), spark.createDataFrame([], NONE), header, full=True)
    rows = lambda s: sorted(map(tuple, s.read("chunks").collect()))
    assert rows(store) == rows(other)
    assert [r["source_value"] for r in store.read("manifest").orderBy("late", "ord").collect()] == ["a", "b", "d"]
    # what failed to load stays
    third = manifest.rebuild(store, sources(spark, second[1:]), spark.createDataFrame([("file_name", "a")], NONE), header)
    assert third.mode == "none" and third.counts["failed"] == 1
    assert manifest.rebuild(store, sources(spark, second), spark.createDataFrame([], NONE), manifest.Header("c2")).reason.startswith("the manifest belongs")
    assert "chunks were" in manifest.full_rebuild_reason(header, "c1", 400, 100) and manifest.full_rebuild_reason(header, "c1", *header.cut) is None
    assert manifest.full_rebuild_reason(header, "c1", 500, 100, "recursive" if splitter == "windows" else "windows") == f"chunks were cut by {splitter}"
    with pytest.raises(ValueError, match="splitter"):
        chunk.chunk_texts(sources(spark, second), splitter="other")


def test_diff_model(spark):
    r = random.Random(7)
    for _ in range(3):
        prev = {f"k{i}": r.choice("xyz") for i in range(20) if r.random() < 0.6}
        now = {f"k{i}": r.choice("xyz") for i in range(20) if r.random() < 0.6}
        failed = {f"k{i}" for i in range(24) if r.random() < 0.2}
        p = spark.createDataFrame([("u", k, v, 1, i) for i, (k, v) in enumerate(prev.items())], NONE + ", fingerprint string, chunk_count int, ord long")
        c = spark.createDataFrame([("u", k, v, 1, i) for i, (k, v) in enumerate(now.items())], NONE + ", fingerprint string, chunk_count int, ord long")
        f = spark.createDataFrame([("u", k) for k in failed], NONE)
        got = {x["source_value"]: x["status"] for x in manifest.diff(p, c, f).collect()}
        want = {k: "added" if k not in prev else "changed" if prev[k] != now[k] else "unchanged" for k in now}
        want |= {k: "failed" if k in failed else "removed" for k in prev if k not in now}
        assert got == want


def test_manifest_text(spark):
    lines = ["collection=c", "chunk=500", "overlap=x", "source|url|http://a|f1|3", "source|url|b|f|0", "source|url|c||2", "source|url|d|f|x", "source|url|e|f|1|", "source|url|g|f", "", "junk"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [tuple(r) for r in manifest.parse_manifest(df).collect()] == [("url", "http://a", "f1", 3)]
    assert tuple(manifest.parse_header(df).first()) == ("c", 500, 0)
    m = spark.createDataFrame([("url", f"v{i}", "f", i + 1, i) for i in range(5)], NONE + ", fingerprint string, chunk_count int, ord long")
    assert sorted(map(tuple, manifest.parse_manifest(manifest.format_manifest(m)).collect())) == sorted(tuple(r)[:4] for r in m.collect())


def test_stream_of_changes(spark, tmp_path):
    schema = "source_key string, source_value string, text string, ord long"
    store = manifest.Store(spark, str(tmp_path / "store"))
    for n, rows in enumerate(([("f", "a", "one", 1), ("f", "b", "two", 2)], [("f", "a", "one more", 3), ("f", "b", None, 4), ("f", "c", "three", 5)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rebuild.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, manifest.Header("c"), str(tmp_path / "cp")).awaitTermination()
        assert store.version() == n + 1
    assert {r["source_value"]: r["chunk_text"] for r in store.read("chunks").collect()} == {"a": "one more", "c": "three"}


# ------------------------------------------------------------------ evaluation

def test_scores(spark):
    rows = [("1", ["a.html", "b.html"], ["http://www.x/a.html", None, "x/B.html#t", "c"], 5, None), ("2", ["proxy.html"], ["dynamic-proxy.html"], 7, None), ("3", ["gone", "x/c"], [], 9, "timeout"),
            ("4", ["a", "a", "z/a"], ["z/a", "z/a"], 1, None), ("5", ["a"], None, 2, None)]
    df = spark.createDataFrame(rows, "case_id string, expected array<string>, returned array<string>, cost_ms long, error string").withColumn("variant_id", F.lit("v"))
    index = spark.createDataFrame([("http://x/a.html",), ("y/x/c",), ("proxy.html",), ("z/a",)], "source_value string")
    got = {r["case_id"]: r for r in evaluate.score_cases(df, index).collect()}
    fields = lambda k: (got[k]["hit_rank"], got[k]["hit_count"], got[k]["hit_expected"], got[k]["not_in_index"], got[k]["missed"], got[k]["distinct_sources"])
    assert fields("1") == (1, 2, ["a.html", "b.html"], [], [], 3)
    assert fields("2") == (0, 0, [], [], ["proxy.html"], 1)
    assert fields("3") == (0, 0, [], ["gone"], ["x/c"], 0)
    assert fields("4") == (1, 2, ["a"], [], ["z/a"], 1)
    assert fields("5")[0] == 0
    m = evaluate.aggregate_metrics(evaluate.score_cases(df, index), ["variant_id"]).first()
    assert (m["total"], m["failed"], m["hit_rate"], m["recall"], m["precision"], m["empty_rate"], m["p50_ms"], m["p95_ms"]) == (5, 1, 0.4, round(3 / 9, 6), round(4 / 7, 6), 0.2, 5, 9)
    assert {r["case_id"]: r["reason"] for r in evaluate.miss_list(evaluate.score_cases(df, index)).collect()} == {"2": "not among the results", "3": "failed: timeout", "5": "nothing returned"}


def test_report(spark, tmp_path):
    one = dict(zip(evaluate.METRICS, (0.4, 0.25, 0.5, 0.1, 1.0, 2.0, 0.3, 12, 40))) | {"variant_id": "all-on", "total": 5, "failed": 1}
    before = {f"delta_{m}": v for m, v in zip(evaluate.METRICS, (0.125, None, 0.0, -0.5, 0.0, 1.0, 0.0, 3, -4))}
    report = evaluate.Report("20240101", "set", 5, [one | before], [{"variant_id": "all-on", "case_id": "c", "reason": "not indexed"}], {"all-on": "k=3"}, "docs", True, 1500, "20231231")
    text = report.markdown()
    for part in ("| all-on | 5 | 1 | 40.0% | 0.250 | 50.0% | 10.0% | 1.000 | 2.000 | 30.0% | 12 | 40 |", "| all-on | +0.125 | - | 0 | -0.500 | 0 | +1.000 | 0 | +3.000 | -4.000 |", "- all-on: k=3", "rebuilt during",
                 "Up to 30.0%", "### all-on: 1 of 5", "| c | not indexed |", "| seconds | 1.5 |", "| compared with | 20231231 |"):
        assert part in text
    plain = evaluate.Report("r", "set", 5, [one | {"empty_rate": 0.1}], [], {}).markdown()
    assert "no run to compare" in plain and "All cases hit" in plain and "Up to" not in plain and "rebuilt" not in plain
    folder = report.write(spark, f"file://{tmp_path}/out")
    got = evaluate.read_report(spark, folder).first()
    assert (got["run_id"], got["variant_id"], got["failed"], got["mrr"], got["p95_ms"]) == ("20240101", "all-on", 1, 0.25, 40)
    assert evaluate.Report("x", "s", 0, [], [], {}).write(spark, "nowhere://x/y").endswith("/x")  # logged, not raised


def test_worst_empty_rate(spark):
    rows = spark.createDataFrame([("a", 0.1), ("b", 0.3)], "variant_id string, empty_rate double")
    assert [tuple(evaluate.worst_empty_rate(x).first()) for x in (rows, rows.limit(1).where("empty_rate < 0.2"), rows.limit(0))] == [(0.3, True), (0.1, False), (0.0, False)]


def test_failing_models_and_recalls(spark):
    def judge(query, text):
        if query == "bad" and text == "t3":
            raise ValueError("lost")
        return len(text) + float(text[1:])

    rows = spark.createDataFrame([(q, i, q, f"t{i}") for q in ("good", "bad") for i in range(5)], "query_id string, fused_rank int, query string, text string")
    got = {(r["query_id"], r["fused_rank"]): (r["final_rank"], r["rerank_error"]) for r in fusion.rerank(rows, ["query_id"], F.lit(True), F.lit(3), fusion.PythonReranker(judge)).collect()}
    assert got == {**{("good", i): (5 - i, None) for i in range(5)}, **{("bad", i): (i + 1, "lost") for i in range(5)}}
    asked = spark.createDataFrame([(1, "a b"), (2, "fail")], "query_id long, query string")
    rewriter = retrieve.PythonRewriter(lambda q, n: 1 / 0 if q == "fail" else [" b ", None, "", "b", "a b", "c", "d"])
    assert sorted(map(tuple, retrieve.expand_queries(asked, count=2, rewriter=rewriter).collect())) == [(1, 0, "a b"), (1, 1, "b"), (1, 2, "c"), (2, 0, "fail")]
    assert retrieve.expand_queries(asked, count=-1, rewriter=rewriter).count() == 2

    class Lost:
        def search(self, queries, n, id_cols=None):
            return queries.select(*id_cols, F.raise_error(F.lit("lost")).cast("long").alias("chunk_id"), F.lit(1).alias("rank"))

    chunks = spark.createDataFrame([(1, "s", "a b"), (2, "s", "c")], "chunk_id long, source string, text string")
    model = embed.HashedTerms(64)
    corpus = retrieve.Corpus(chunks, embed.embed_chunks(chunks, model), Lost(), model)
    lists = retrieve.recall(retrieve.expand_queries(asked, enabled=False, rewrites="query"), corpus, retrieve.RetrieveOptions(eager=True, rewrite=False))
    assert [(r["query_id"], r["route"], r["chunk_id"]) for r in lists.collect()] == [(1, 0, 1)]
    with pytest.raises(Exception, match="lost"):
        retrieve.recall(retrieve.expand_queries(asked, enabled=False, rewrites="query"), corpus, retrieve.RetrieveOptions(eager=True), strict=True)


def test_result_cache():
    now = [0.0]
    cache = retrieve.ResultCache(ttl=10, max_entries=2, clock=lambda: now[0])
    cache.put("a", "1")
    cache.put("blank", " ")
    cache.put("none", None)
    cache.put("b", "2")
    assert cache.get("a") == "1" and cache.get("blank") is None and cache.get("none") is None
    cache.put("c", "3")  # b was used longest ago
    assert dict(cache.items()) == {"a": "1", "c": "3"}
    now[0] = 10.0
    assert cache.get("a") is None and cache.items() == []
    cache.put("d", "4")
    cache.clear_all()
    assert cache.get("d") is None


def test_status_without_an_index(spark, tmp_path):
    assert manifest.status(manifest.Store(spark, str(tmp_path / "none"))).count() == 0


def test_rebuild_clears_and_snapshot_shows(spark, tmp_path):
    store, cleared, none = manifest.Store(spark, str(tmp_path)), [], spark.createDataFrame([], NONE)
    go = lambda rows: manifest.rebuild(store, sources(spark, rows), none, manifest.Header("c"), after=lambda: cleared.append(store.version()))
    go([("a", "x")])
    began = evaluate.Snapshot.of(store)
    go([("a", "x")])
    assert cleared == [1] and not began.changed(store)
    go([("a", "y" * 900)])
    assert cleared == [1, 2] and began.changed(store) and tuple(store.meta().first()) == ("c", 2)


def test_embedding(spark):
    texts = ["Same words here", "here SAME words", "", None, "漢字かな x漢", "other things"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    got = {r["chunk_id"]: np.array(r["vector"]) for r in embed.embed_chunks(rows, embed.HashedTerms(512)).collect()}
    assert set(got) == {0, 1, 4, 5} and all(abs(v @ v - 1) < 1e-12 for v in got.values())
    assert abs(got[0] @ got[1] - 1) < 1e-12 and got[0] @ got[5] < 0.5
    assert [embed.tokens(t or "") for t in texts] == [list(r[0]) for r in rows.orderBy("chunk_id").select(text_functions.tokenize(F.col("text"))).collect()]


def test_split_text():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(f"{k}" + r.choice(["word ", "w. ", "x\n", "\n\n", "longerword", "é! ", "y"]) for k in range(r.randint(0, 300)))
        size = r.randint(20, 90)
        overlap = r.randint(0, size - 1)
        parts, at = chunk.split_text(text, size, overlap), 0
        for k, p in enumerate(parts):
            assert len(p) <= size
            found = text.find(p, at if k == 0 else at + 1)  # each begins behind the one before
            assert found >= 0 and (k == 0 or found <= end)
            at, end = found, found + len(p)
            if k < len(parts) - 1:
                rest = text[at : at + size]
                better = [e for e in ("\n\n", "\n", " ") if e in rest[overlap:] and rest.rfind(e) + len(e) > overlap]
                assert not better or any(p.endswith(e) for e in better)
        assert at + len(parts[-1]) == len(text)


def test_containing(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "aab"), (3, None), (4, "")], "doc_id long, body string")
    items = spark.createDataFrame([(10, "ick bro"), (11, "a"), (12, "aab"), (13, ""), (14, "zzz"), (15, "a")], "item_id long, text string")
    want = [(1, 10), (2, 11), (2, 12), (2, 15)]
    assert sorted(map(tuple, adapters.containing(docs, items).collect())) == want
    monkeypatch.setattr(adapters, "MOST_ITEMS", 2)
    assert sorted(map(tuple, adapters.containing(docs, items).collect())) == want


@pytest.mark.parametrize("width", [1, 3, 65_536])
def test_salary_ranking(spark, monkeypatch, width):
    monkeypatch.setattr(game, "RANK_IDS", width)
    r = random.Random(4)
    users = [(i, r.choice([0, 0, 0, 5, 9, None]), 0) for i in range(60)] + [(99, 7, 1)]
    df = spark.createDataFrame(users, "id long, salary int, isDelete int").repartition(3)
    want = {i: n for n, (_, i) in enumerate(sorted((-(s if s is not None else -1), i) for i, s, gone in users if not gone), 1)}
    assert {x["id"]: x["position"] for x in game.salary_ranking(df).collect()} == want


def test_append_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    first = {r["id"] for r in adapters.append_rows(path, spark.createDataFrame([("a",), ("b",)], "n string").repartition(2), "id").collect()}
    second = adapters.append_rows(path, spark.createDataFrame([("c",)], "n string"), "id").collect()
    assert len(first) == 2 and min(first) >= 1 and [r["n"] for r in second] == ["c"] and second[0]["id"] > max(first)


def test_variants_and_cases(spark):
    assert [v.id for v in evaluate.parse_variants(["topk-5", "all-on", "topk-5"])] == ["topk-5", "all-on"]
    assert evaluate.VARIANTS["vector-only"].apply(retrieve.RetrieveOptions()).rewrite
    with pytest.raises(ValueError, match="no-such"):
        evaluate.parse_variants(["no-such"])
    cases = spark.createDataFrame([("a", None, "q", ["x"]), ("b", False, "q", ["x"]), ("c", True, " ", ["x"]), ("d", True, "q", [])], "case_id string, enabled boolean, query string, expected array<string>")
    assert {r["case_id"] for r in evaluate.enabled_cases(cases).collect()} == {"a", "c", "d"}
    with pytest.raises(ValueError):
        evaluate.enabled_cases(cases, ["b"])
    with pytest.raises(ValueError, match="case"):
        evaluate.validate_cases(cases)


# ------------------------------------------------------------------ game, pages

def test_pick_with_null_user_and_fallback(spark):
    level = spark.createDataFrame([(1, "x", "AI", 0), (2, "x", "PRESET", 0), (3, "x", None, 0), (4, "g", "AI", 0), (5, "x", "PRESET", 1)], "id long, direction string, source string, isDelete int")
    played = spark.createDataFrame([(7, 2, 0), (7, 1, 0), (7, 3, 0), (8, 2, 1)], "userId long, levelId long, isDelete int")
    assert game.pick_unanswered(level, played, "x", None, "s").first()["id"] == 2
    assert game.pick_unanswered(level, played, "x", 8, "s").first()["id"] == 2
    assert game.pick_with_fallback(level, played, "x", 7, "s", "g").first()["id"] == 4
    users = spark.createDataFrame([(7,), (8,)], "id long")
    got = {(r["userId"], r["direction"]): r["levelId"] for r in game.pick_unanswered_all(level, played, users, "s").collect()}
    assert got == {(7, "g"): 4, (8, "x"): 2, (8, "g"): 4}


def plain_lines(page):
    """By a tree of lists: leaf blocks of the first root found."""
    from html.parser import HTMLParser

    bars = ("ul", "ol", "div", "article", "main", "section", "table")

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.root = ["", {}, []]
            self.open, self.skip = [self.root], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in pages.DROPPED
            if self.skip:
                return
            if tag in pages.LINES or tag in bars:
                ended = {"li": ("p", "li"), "dd": ("p", "dd", "dt"), "dt": ("p", "dd", "dt"), "td": ("p", "td", "th"), "th": ("p", "td", "th")}.get(tag, ("p",))
                k = len(self.open) - 1
                while k > 0 and self.open[k][0] not in bars + ended:
                    k -= 1
                if k and self.open[k][0] in ended:
                    del self.open[k:]
            node = [tag, dict(attrs), []]
            self.open[-1][2].append(node)
            if tag not in pages.VOID:
                self.open.append(node)

        def handle_endtag(self, tag):
            if self.skip:
                self.skip -= tag in pages.DROPPED
                return
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == tag:
                    del self.open[k:]
                    return

        def handle_data(self, data):
            if not self.skip:
                self.open[-1][2].append(data)

    tree = Tree()
    tree.feed(page)
    tree.close()
    inner = lambda n: [n] + [m for c in n[2] if not isinstance(c, str) for m in inner(c)]
    said = lambda n: "".join(c if isinstance(c, str) else (" " if c[0] == "br" else "") + said(c) for c in n[2])
    every = inner(tree.root)
    tests = [lambda n: n[0] == "article", lambda n: n[0] == "main", lambda n: n[1].get("role") == "main", lambda n: n[0] == "body"]
    root = next((n for ok in tests for n in every if ok(n)), tree.root)
    lines = [" ".join(said(n).split()) for n in inner(root) if n[0] in pages.LINES and not any(m is not n and m[0] in pages.LINES for m in inner(n))]
    return "\n".join(filter(None, lines)) or " ".join(said(root).split())


@pytest.mark.parametrize("seed", range(4))
def test_clean_html_is_that_of_a_plain_tree(seed):
    r = random.Random(seed)
    names = "div p li ul td tr table a b br section dd dl script main article body th h1 pre nav form span".split()
    for _ in range(800):
        page = "".join(r.choice([f"<{r.choice(names)}>", f"<{r.choice(names)} role=main>", f"<{r.choice(names)}>", f"</{r.choice(names)}>", "word ", "a &amp; b"]) for _ in range(r.randint(1, 40)))
        assert pages.clean_html(page) == plain_lines(page)


def test_clean_html_of_deep_pages():
    assert pages.clean_html("<div>" * 20_000 + "<p>x" + "</div>" * 20_000) == "x"
    assert pages.clean_html("<b><p>y" * 20_000).count("y") == 20_000
    assert pages.clean_html("<span>" * 30_000 + "z") == "z"


def test_clean_html():
    page = '<body><nav><p>menu</p></nav><div role="main"><h1>T &amp; u</h1><p>a<b>b</b><br>c<p>d<ul><li>x<li>y<p>z</p></ul><blockquote><p>q</p></blockquote><table><tr><td>1<td>2</table></div><p>out</p></body>'
    assert pages.clean_html(page) == "T & u\nab c\nd\nx\nz\nq\n1\n2"
    assert pages.clean_html("plain <i>text</i>") == "plain text" and pages.clean_html(None) == ""


def test_eval_set(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"version": 1, "new": 2, "cases": [{"id": "a", "query": "q", "expectedSources": ["s"], "other": 1}, {"id": "b", "enabled": false}]}')
    got = pages.eval_set(spark, str(tmp_path / "none.json"), str(tmp_path / "e.json")).collect()
    assert [(r["case_id"], r["enabled"], r["expected"]) for r in got] == [("a", True, ["s"]), ("b", False, None)]
    with pytest.raises(FileNotFoundError):
        pages.eval_set(spark, str(tmp_path / "none.json"))


def test_many_expected_sources(spark):
    """A case's expected sources are normalised once a row, not for each other one."""
    import time

    many = [f"https://www.kb.example/doc/{i}/" for i in range(1500)]
    results = spark.createDataFrame([("v", 1, many, ["doc/7", "doc/x", "doc/8", "doc/9", "doc/1499"], 5, None)], "variant_id string, case_id int, expected array<string>, returned array<string>, cost_ms int, error string")
    began = time.monotonic()
    row = evaluate.score_cases(results, spark.createDataFrame([("doc/3",), ("doc/7",)], "source_value string")).select("hit_count", "missed", F.size("not_in_index").alias("n")).first()
    assert tuple(row) == (4, ["https://www.kb.example/doc/3/"], 1495) and time.monotonic() - began < 60


def test_a_task_keeps_the_best_alone(spark):
    """Whatever a task reads, it gives each query's n best; ties go to the smaller chunk."""
    corpus = spark.range(5000).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0)).alias("vector")).coalesce(1)
    held = [{"query_id": 4, "vector": [1.0, 1.0]}, {"query_id": 5, "vector": [1.0, 0.0]}]
    found = vector._found(held, ["query_id"], "query_id int", corpus, 3, 0.2, "raw").collect()
    assert sorted((r["query_id"], -r["score"], r["chunk_id"]) for r in found) == [(4, -2.0, 0), (4, -2.0, 2), (4, -2.0, 4), (5, -1.0, 0), (5, -1.0, 1), (5, -1.0, 2)]


def test_texts_are_not_shuffled(spark):
    """Neither to count a text's tokens nor to find the first of equal keys or texts, if few are left out."""
    docs = spark.createDataFrame([(1, "k", "a", "b b a", 1), (2, "k", "a", "c", 2), (3, "k", "b", "b b a", 3)], "chunk_id long, source_key string, source_value string, text string, ord long")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    postings, first = bm25.build_index(docs).postings, manifest.first_of_key(docs)
    assert sorted(map(tuple, postings.select("chunk_id", "dl", "term", "tf").collect())) == [(1, 3, "a", 1), (1, 3, "b", 2), (2, 1, "c", 1)]
    assert sorted(r["chunk_id"] for r in first.collect()) == [1, 3]
    assert "hashpartitioning" not in plan(postings) and "hashpartitioning" not in plan(first)
