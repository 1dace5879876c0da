"""The index of segments against one that is built anew, after any updates."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import bm25, embed, segments
from tessera.operators import manifest as M
from tessera.operators import retrieve as R
from tessera.streaming import rebuild

HEADER = M.Header("docs", 60, 10)
SOURCES = "source_key string, source_value string, text string, ord long"
WORDS = ["spark", "index", "segment", "query", "vector", "posting", "merge", "delta", "x1", "y2"]


def say(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame([("file_name", k, t, i) for i, (k, t) in enumerate(sorted(texts.items()))], SOURCES)


def keys(spark, names=()):
    return spark.createDataFrame([("file_name", k) for k in names], "source_key string, source_value string")


def files(path):
    out = {}
    for folder, _, names in os.walk(path):
        for n in names:
            full = os.path.join(folder, n)
            out[full] = (os.path.getsize(full), os.stat(full).st_mtime_ns)
    return out


def state(store):
    v = store.current()
    chunks = sorted(map(tuple, store.live(v, "chunks").select("source_value", "chunk_idx", "chunk_text", "chunk_id").collect()))
    vectors = sorted((r["chunk_id"], tuple(r["vector"])) for r in store.live(v, "vectors").collect())
    postings = sorted(map(tuple, store.live(v, "postings").select("term", "chunk_id", "tf", "dl").collect()))
    entries = sorted(map(tuple, store.manifest(v).select("source_value", "fingerprint", "chunk_count").collect()))
    return chunks, vectors, postings, entries, v.texts, v.tokens


def test_updates_equal_a_fresh_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FAN", 3)
    r = random.Random(0)
    texts = {f"s{i}": say(r, r.randint(0, 30)) for i in range(12)}
    store = segments.SegmentStore(spark, f"file://{tmp_path}/a")
    merged = 0
    for step in range(3):
        done = segments.update(store, frame(spark, texts), keys(spark), HEADER)
        assert done.mode == ("full" if step == 0 else "incremental") and not done.failures
        merged += done.merged
        for k in r.sample(sorted(texts), 3):
            texts[k] = say(r, r.randint(0, 30))
        del texts[r.choice(sorted(texts))]
        texts[f"n{step}"] = texts[r.choice(sorted(texts))]  # a copy of another
    segments.update(store, frame(spark, texts), keys(spark), HEADER)
    monkeypatch.setattr(segments, "FAN", 99)
    del texts[min(texts)]
    segments.update(store, frame(spark, texts), keys(spark), HEADER)
    assert segments.update(store, frame(spark, texts), keys(spark), HEADER).mode == "none"
    assert merged
    fresh = segments.SegmentStore(spark, f"file://{tmp_path}/b")
    segments.update(fresh, frame(spark, texts), keys(spark), HEADER)
    assert state(store) == state(fresh)
    monkeypatch.setattr(segments, "FEW_GONE", 0)  # ended chunks meet the others by shuffle now
    assert any(s.gone for s in store.current().segments) and state(store) == state(fresh)
    queries = spark.createDataFrame([(i, say(r, 3), [say(r, 2)]) for i in range(4)], "query_id int, query string, rewrites array<string>")
    model = embed.HashedTerms()
    answer = [sorted(map(tuple, R.retrieve(queries, s.corpus(embedder=model)).collect())) for s in (store, fresh)]
    assert answer[0] == answer[1] and answer[0]
    chunks = fresh.corpus().chunks
    plain = bm25.build_index(chunks).search(queries, 9)
    assert sorted(map(tuple, store.corpus().index.search(queries, 9).select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))


def test_an_update_writes_what_changed(spark, tmp_path):
    r, written = random.Random(1), []
    for size in (20, 200):
        store = segments.SegmentStore(spark, f"file://{tmp_path}/{size}")
        texts = {f"s{i}": say(r, 20) for i in range(size)}
        segments.update(store, frame(spark, texts), keys(spark), HEADER)
        before = files(f"{tmp_path}/{size}")
        texts["s3"] = "something else"
        segments.update(store, frame(spark, texts), keys(spark), HEADER)
        after = files(f"{tmp_path}/{size}")
        assert before.items() <= after.items()  # nothing that was there was touched
        written.append(sum(after[f][0] for f in after.keys() - before.keys()))
    assert written[1] < 1.2 * written[0]


def flaky(broken):
    def vector(text):
        if broken in text:
            raise RuntimeError("no vector")
        return [float(len(text)), 1.0]

    return embed.PythonEmbedder(vector)


def test_a_source_without_vectors_keeps_its_chunks(spark, tmp_path):
    store = segments.SegmentStore(spark, f"file://{tmp_path}/a")
    texts = {"a": "one", "b": "two", "c": "three"}
    with pytest.raises(RuntimeError, match="no vector"):  # a first index is whole or isn't
        segments.update(store, frame(spark, texts | {"d": "broken"}), keys(spark), HEADER, flaky("broken"))
    assert store.current().number == 0 and not store.versions()
    segments.update(store, frame(spark, texts), keys(spark), HEADER, flaky("broken"))
    now = {"a": "one", "b": "broken " * 30, "d": "broken", "e": "new"}  # b changes, c goes, d and e come
    done = segments.update(store, frame(spark, now), keys(spark), HEADER, flaky("broken"))
    assert (done.mode, done.failures) == ("incremental", 2)
    live = lambda: sorted((x["source_value"], x["chunk_text"]) for x in store.live(store.current(), "chunks").where("chunk_idx = 0").select("source_value", "chunk_text").collect())
    assert live() == [("a", "one"), ("b", "two"), ("e", "new")]
    number = store.current().number
    again = segments.update(store, frame(spark, now), keys(spark), HEADER, flaky("broken"))
    assert (again.mode, again.failures, store.current().number) == ("none", 2, number)
    tried = []
    mended = segments.update(store, frame(spark, now), keys(spark), HEADER, embed.PythonEmbedder(lambda t: [1.0]), after=lambda: tried.append(1))
    assert (mended.counts["added"], mended.counts["changed"], mended.counts["unchanged"], mended.failures) == (1, 1, 2, 0) and tried
    assert [k for k, _ in live()] == ["a", "b", "d", "e"]
    fresh = segments.SegmentStore(spark, f"file://{tmp_path}/b")
    segments.update(fresh, frame(spark, now), keys(spark), HEADER, embed.PythonEmbedder(lambda t: [1.0]))
    assert state(store)[0] == state(fresh)[0] and state(store)[2:] == state(fresh)[2:]


def test_two_writers(spark, tmp_path, monkeypatch):
    """One of two that began from one version loses, begins again, and both changes are there."""
    store = segments.SegmentStore(spark, f"file://{tmp_path}/a")
    segments.update(store, frame(spark, {"a": "one"}), keys(spark), HEADER)
    other, claim, raced = segments.SegmentStore(spark, f"file://{tmp_path}/a"), segments.SegmentStore.claim, []

    def late(self, version):
        if self is store and not raced:
            raced.append(version.number)
            segments.update(other, frame(spark, {"b": "two"}), keys(spark), HEADER, named=keys(spark, ["b"]))
        claim(self, version)

    monkeypatch.setattr(segments.SegmentStore, "claim", late)
    segments.update(store, frame(spark, {"c": "three"}), keys(spark), HEADER, named=keys(spark, ["c"]))
    assert raced == [2] and store.versions() == [1, 2, 3]
    assert {r["source_value"] for r in store.manifest(store.current()).collect()} == {"a", "b", "c"}
    with pytest.raises(segments.Conflict):
        claim(store, store.current())


def test_vacuum_and_readers(spark, tmp_path):
    store = segments.SegmentStore(spark, f"file://{tmp_path}/a")
    for n in range(4):
        segments.update(store, frame(spark, {"a": f"text {n}"}), keys(spark), HEADER, full=True)
    old = store.read_version(3)
    assert store.vacuum(keep=2) == []  # too young
    assert len(store.vacuum(keep=2, after=-60)) == 2
    assert store.versions() == [3, 4]
    assert [r["chunk_text"] for r in store.live(old, "chunks").collect()] == ["text 2"]


def test_stream_of_changes(spark, tmp_path):
    store = segments.SegmentStore(spark, f"file://{tmp_path}/index")
    schema = "source_key string, source_value string, text string, ord long"
    for n, rows in enumerate(([("file_name", "a", "one", 1), ("file_name", "b", "two", 2)], [("file_name", "a", "uno", 3), ("file_name", "b", None, 4), ("file_name", "c", "three", 5)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        changes = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        rebuild.follow(changes, store, HEADER, f"file://{tmp_path}/checkpoint").awaitTermination()
        assert len(store.versions()) > n
    got = {r["source_value"]: r["chunk_text"] for r in store.live(store.current(), "chunks").collect()}
    assert got == {"a": "uno", "c": "three"}


def test_lengths_of_vectors(spark):
    """Queries only meet vectors of their own length."""
    from tessera.operators import vector

    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [0.9, 0.1]), ("d", None)], "chunk_id string, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0])], "query_id int, vector array<double>")
    got = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in vector.search(queries, corpus, 5).collect())
    assert got == [(1, 1, "a"), (1, 2, "c"), (2, 1, "b")]


def test_postings_take_few_bytes(spark, tmp_path):
    """A posting is a place and a count in its term's list, not a row with names of its own."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    texts = {f"s{i}": " ".join(r.choice(words) for _ in range(100)) for i in range(600)}
    store = segments.SegmentStore(spark, f"file://{tmp_path}/a")
    segments.update(store, frame(spark, texts), keys(spark), M.Header("docs"))
    v = store.current()
    postings = store.live(v, "postings").count()
    held = sum(size for f, (size, _) in files(f"{tmp_path}/a").items() if f.endswith(".parquet") and "/texts/" not in f and "/chunks/" not in f and "/vectors/" not in f)
    assert postings > 50_000 and held < 6 * postings


def test_postings_are_not_shuffled_to_be_written(spark, tmp_path):
    """A task writes its blocks' lists itself, once; lists that meet their docs to be counted travel packed."""
    r, context = random.Random(5), spark.sparkContext._jsc.sc()
    words = [f"w{i}" for i in range(500)]
    texts = {f"s{i}": " ".join(r.choice(words) for _ in range(100)) for i in range(600)}
    store = segments.SegmentStore(spark, f"file://{tmp_path}/a")
    segments.update(store, frame(spark, texts), keys(spark), M.Header("docs"))
    v = store.current()

    def shuffled(run):
        context.listenerBus().waitUntilEmpty()
        before = context.statusStore().executorList(True).apply(0).totalShuffleWrite()
        out = run()
        context.listenerBus().waitUntilEmpty()
        return out, context.statusStore().executorList(True).apply(0).totalShuffleWrite() - before

    store.rename(store.at(v.segments[0].number, "texts"), store.at(99, "texts"))
    _, written = shuffled(lambda: segments._write_texts(store, 99))
    held = store.table(segments.Version(segments=(segments.Segment(99, 1, 0),)), "lists").count()
    assert held and not written
    spark.createDataFrame([], segments._TABLES["texts"]).write.parquet(store.at(98, "texts"))
    segments._write_texts(store, 98)  # no texts: empty tables
    assert store.table(segments.Version(segments=(segments.Segment(98, 0, 0),)), "docs").count() == 0
    counts, sent = shuffled(lambda: segments.term_counts(store, v).collect())
    postings = store.live(v, "postings")
    plain = {x["term"]: (x["df"], x["n"]) for x in postings.groupBy("term").agg(F.countDistinct("digest").alias("df"), F.sum("tf").alias("n")).collect()}
    assert {x["term"]: (x["df"], x["occurrences"]) for x in counts} == plain
    assert sent < 4 * postings.count()
