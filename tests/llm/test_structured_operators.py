"""Pages, chats, vectors and the pipeline."""

import json
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, chat, html, packing, quality
from tessera.llm.queries import word_tokenizer

from .conftest import SCHEMA, corpus
from .test_copies import kept_plain
from .test_text_operators import repeats


# ------------------------------------------------------------------ pages

def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(0)
    w = html.initial(r)
    x = r.normal(size=(5, 3, html.PATH + html.WORDS + html.MEASURES))
    mask = np.arange(5)[:, None] < np.array([5, 3, 1])
    y = (r.random((5, 3)) < 0.5).astype(float)
    _, g = html.gradients(w, x, mask, y)
    for k in w:
        for _ in range(4):
            at = tuple(int(r.integers(n)) for n in w[k].shape)
            e = 1e-5
            up, down = ({n: v.copy() for n, v in w.items()} for _ in range(2))
            up[k][at] += e
            down[k][at] -= e
            slope = (html.gradients(up, x, mask, y)[0] - html.gradients(down, x, mask, y)[0]) / (2 * e)
            assert abs(slope - g[k][at]) < 1e-6


def test_labels_of_pages_it_has_not_seen():
    w, r, wrong, total = html.model(), np.random.default_rng(77), 0, 0
    for _ in range(150):
        page, labels = html.example(r)
        got = html.labels_of(w, [html.blocks(page)])[0]
        wrong += int((got != np.array(labels, bool)).sum())
        total += len(labels)
    assert wrong < 0.02 * total


def test_blocks():
    page = '<html><head><title>t</title></head><body>a &amp; b<p>one<br>two <b>three</b>\n four<p>five<ul><li>x<li>y</ul><script>var a="<p>no</p>";</script><!-- <p>no --><div>1 < 2 &copy; &nosuch;</div>tail<p'
    assert [b.text for b in html.blocks(page)] == ["a & b", "one two three four", "five", "x", "y", "1 < 2 © &nosuch;", "tail"]
    assert html.blocks("") == [] and html.blocks("<") != [None]


def test_batches_do_not_change_labels():
    w, r = html.model(), np.random.default_rng(5)
    pages = [html.blocks(html.example(r)[0]) for _ in range(30)] + [[]]
    together = html.labels_of(w, pages)
    assert all((a == b).all() for a, b in zip(together, (html.labels_of(w, [p])[0] for p in pages)))


def test_extract(spark):
    body = "".join(f"<p>Paragraph {i} says something of its own, at length.</p>" for i in range(6))
    page = f'<html><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>Title</h1>{body}</article><footer>&copy; us</footer></body></html>'
    rows = [(1, "u", page), (2, "v", None), (3, "w", ""), (1, "u", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit(1))
    got = {r["row"]["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(df).collect()}
    want = "\n".join(["Title", *(f"Paragraph {i} says something of its own, at length." for i in range(6))])
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0)}
    assert html.extract(df.limit(0)).count() == 0


# ------------------------------------------------------------------ chats

SCHEMAS = {"add": {"a": ("number", True), "b": ("number", True), "note": ("string", False)}, "list": {}}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a if isinstance(a, str) else json.dumps(a)} for i, n, a in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def test_linking(spark):
    rows = [
        (1, 0, "user", "hello {"), (1, 1, "assistant", call(("x", "add", {"b": 2, "a": 1}), ("y", "add", {"a": "$ref:x", "b": 1}))), (1, 2, "tool", result("x", "3")),
        (1, 3, "assistant", call(("z", "list", {"q": 1}), ("w", "nope", {}), ("v", "add", "[1]"))), (1, 4, "tool", result("z", 'a "quoted"\nline')), (1, 5, "tool", result("ghost", "?")),
        (2, 0, "assistant", call(("p", "add", {"a": "$ref:q", "b": 1}), ("q", "add", {"a": "$ref:p", "b": 1}), ("x", "add", {"a": 1.5, "b": 2, "note": None}))), (2, 1, "tool", result("x", "x")), (2, 2, "tool", result("x", "again")),
        (2, 3, "assistant", call((None, "list", {}))), (None, 4, "assistant", call(("k", "list", {}))), (2, 5, "assistant", None), (2, 6, "assistant", "{broken"),
    ]
    calls, results = chat.extract(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("status", F.lit(1)))
    got = {(r["conv_id"], r["call_id"], r["status"]): r for r in chat.link_calls(calls, results, SCHEMAS).collect()}
    status = {(c, i): s for c, i, s in got if s not in ("repeated result",)}
    assert status == {(1, "x"): "linked", (1, "y"): "unanswered", (1, "z"): "linked", (1, "w"): "unanswered", (1, "v"): "unanswered", (1, "ghost"): "orphan result",
                      (2, "p"): "cycle", (2, "q"): "cycle", (2, "x"): "linked", (2, None): "call without identifier", (None, "k"): "call without identifier"}
    assert (2, "x", "repeated result") in got
    assert got[1, "x", "linked"]["json"] == '{"arguments":{"a":1,"b":2},"call_id":"x","name":"add","result":"3","status":"linked"}'
    assert json.loads(got[1, "z", "linked"]["json"])["result"] == 'a "quoted"\nline'
    assert {k[1]: r["depth"] for k, r in got.items() if k[0] == 1} == {"x": 0, "y": 1, "z": 0, "w": 0, "v": 0, "ghost": None}
    problems = {k[1]: r["problems"] for k, r in got.items() if k[0] == 1}
    assert problems == {"x": [], "y": ["a is no number"], "z": ["unknown q"], "w": ["unknown tool"], "v": ["arguments are no object"], "ghost": None}
    assert got[2, "x", "linked"]["valid"]


def test_long_chain_of_calls(spark):
    rows = [(1, k, "assistant", call((f"c{k}", "add", {"a": f"$ref:c{k - 1}", "b": 1} if k else {"a": 1, "b": 1}))) for k in range(6)]
    calls, _ = chat.extract(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["call_id"]: r["depth"] for r in chat.depths(calls).collect()} == {f"c{k}": k for k in range(6)}


@pytest.mark.parametrize("seed", [1, 2])
def test_depths_of_chains_forks_and_cycles(spark, seed):
    """Against the definition: 0 without known references, else one more than the deepest one named; none behind a cycle."""
    import random

    r = random.Random(seed)
    needs = {f"c{k}": [f"c{k - 1}"] for k in range(1, 90)} | {"c0": []}  # a long chain
    needs |= {f"t{k}": [f"{r.choice('tc')}{r.randrange(k + 1)}" for _ in range(r.randint(0, 3))] for k in range(1, 60)} | {"t0": ["nowhere"]}
    needs |= {"x": ["y"], "y": ["z", "c3"], "z": ["x"], "behind": ["x"], "far": ["behind"], "self": ["self"]}
    found = {}
    for _ in range(200):
        for k, n in needs.items():
            own = {v for v in n if v in needs}
            if all(v in found for v in own):
                found[k] = max((found[v] + 1 for v in own), default=0)
    rows = [(1, k, json.dumps([f"$ref:{v}" for v in n])) for k, n in needs.items()] + [(2, "c5", '"$ref:c4"'), (2, "c6", '"$ref:c5"')]
    r.shuffle(rows)
    got = {(x["conv_id"], x["call_id"]): x["depth"] for x in chat.depths(spark.createDataFrame(rows, "conv_id long, call_id string, arguments string")).collect()}
    assert got == {**{(1, k): d for k, d in found.items()}, (2, "c5"): 0, (2, "c6"): 1} and max(found.values()) >= 89


def test_links_are_hash_joins(spark):
    rows = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(9)] + [(1, 9, "system", "s")], "conv_id long, turn long, role string, text string")
    calls, results, others = chat.dialogue(rows)
    linked = chat.link_calls(calls, results, {"reply": {"text": ("string", True), "turn": ("integer", True), "after": ("string", False)}}, others)
    plan = linked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") >= 2 and "Python" not in plan and "Arrow" not in plan
    got = {(x["turn"], x["status"]): x["depth"] for x in linked.collect()}
    assert got == {**{(k, "linked" if k < 8 else "unanswered"): k // 2 for k in range(0, 9, 2)}, (9, "message"): None}


def test_no_messages(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.link_calls(*chat.extract(none), SCHEMAS).count() == 0
    assert chat.link_calls(*chat.dialogue(none)[:2], SCHEMAS, chat.dialogue(none)[2]).count() == 0


# ------------------------------------------------------------------ packing

def test_words_beyond_the_cache():
    """Ids don't depend on what is remembered: long words, many words, and a limit that is always passed."""
    with open(word_tokenizer(), encoding="utf-8") as f:
        definition = f.read()
    import random

    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abcdefghijäß0123456789+/=") for _ in range(r.choice([3, 8, 150, 900]))) for _ in range(12)).encode() for _ in range(30)]
    small, large = packing.Ids(definition), packing.Ids(definition)
    small.limit = 2000
    got = [x for t in texts for x in small.of([t])]
    assert got == large.of(texts) == [np.array(large.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(small.cache) < 30 < len(large.cache) and max(map(len, large.cache)) <= packing.LONG_WORD


def test_a_row_repeated_many_times_is_packed_in_several_shards(spark):
    df = spark.createDataFrame([(7, "the same few words")] * 500 + [(k, f"other {k}") for k in range(100, 120)], "doc_id long, text string").repartition(4)
    got = packing.pack_sequences(df, word_tokenizer(), shard_rows=50).collect()
    mine = [r for r in got if r["doc_id"] == 7]
    assert len(mine) == 500 and len({r["sequence_id"] >> 32 for r in mine}) > 3
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048


# ------------------------------------------------------------------ vectors

def exact(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            s = sorted(((-float(v @ q), j) for j, v in ok if j != i and len(v) == len(q)))[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


def test_nearest(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(700, 12)) * r.uniform(0.2, 3, (700, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[5].tolist()) for i in range(60)] + [(2000, None), (2020, []), (2040, [0.0] * 12), (2060, [float("nan")] * 12), (2080, [None] * 12), (None, x[3].tolist()), (2100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).repartition(5)
    got = defaultdict(list)
    for row in ann.nearest(df, df.where("vec_id % 20 = 0"), least_shards=3, shard_rows=300, block=16).orderBy("query_id", "rank").collect():
        assert row["rank"] == len(got[row["query_id"]]) + 1
        got[row["query_id"]].append((row["id"], row["score"]))
    want = exact(rows, 20)
    assert set(got) == {q for q in want if want[q]}
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in got)
    assert hits >= 0.97 * sum(map(len, want.values()))
    scores = {i: np.array(v) for i, v in rows if i is not None and i < 2000}
    for q, found in got.items():
        assert all(abs(s - scores[i] @ scores[q]) < 1e-9 for i, s in found) and found == sorted(found, key=lambda t: (-t[1], t[0]))
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_repeated_rows_of_a_vector_take_one_place(spark):
    rows = [(5, [1.0, 1.0])] * 30 + [(i, [1.0, 1.0]) for i in range(6, 40)] + [(i, [0.5, 0.1]) for i in range(50, 90)] + [(20, [1.0, 1.0])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = ann.nearest(df, df.where("vec_id = 20")).orderBy("rank").collect()
    assert [r["id"] for r in got] == [i for i in range(5, 40) if i != 20][:20] and {r["score"] for r in got} == {2.0}


def test_equal_vectors_are_ranked_by_id(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(90, -1, -1)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id = 20")).orderBy("rank").collect()
    assert [r["id"] for r in got] == [i for i in range(21) if i != 20]


# ------------------------------------------------------------------ pipeline

def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [r for r in corpus(90, 11) if r[0] != 5000]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    # quality, near-duplicates and repeated passages by brute force
    counted = [(r[0], (r[1] or "").encode(), r[3], quality.signals((r[1] or "").encode())) for r in rows]
    good = [(i, x, s) for i, x, s, c in counted if c[0] >= 10 and 100 * c[4] <= 20 * c[0]]
    step = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert step.columns == docs.columns and sorted(r["doc_id"] for r in step.collect()) == sorted(i for i, _, _ in good)
    chief = set(kept_plain([(i, x.decode()) for i, x, _ in good]))
    left = [g for g in good if g[0] in chief]
    texts = {i: kept for i, _, removed, _, kept in repeats(left, 100) if not removed or kept.split()}
    # the rest by what must hold of it
    tok = Tokenizer.from_file(word_tokenizer())
    ids = {i: len(tok.encode(x.decode("utf-8", "ignore"), add_special_tokens=False).ids) + 1 for i, x in texts.items()}
    source, words, taken = {i: s for i, _, s in left}, Counter(), Counter()
    pieces = defaultdict(Counter)
    sequences = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert r["doc_tokens"] == ids[r["doc_id"]]
        pieces[r["doc_id"]].update(range(r["start"], r["start"] + r["length"]))
        sequences[r["sequence_id"]] += r["length"]
    assert set(pieces) <= set(texts) and max(sequences.values()) <= 2048
    copies = {}
    for i, p in pieces.items():
        assert set(p) == set(range(ids[i])) and len(set(p.values())) == 1
        copies[i] = p[0]
    assert max(copies.values()) <= 3
    for i, x in texts.items():
        words[source[i]] += len(x.split())
        taken[source[i]] += len(x.split()) * copies.get(i, 0)
    assert abs(sum(taken.values()) - sum(words.values())) < 0.5 * sum(words.values())


def test_stages_keep_odd_rows(spark, odd, empty, tmp_path):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            out.collect()
    kept = corpus_pipeline.simhash_near_dedup(spark, odd, "")
    assert kept.where("doc_id = 5000").count() <= 1 and kept.where("doc_id is null").count() == 1


def test_readme_names_no_stage_twice():
    assert len({n for n, _ in corpus_pipeline.STAGES}) == 5 and all(re.fullmatch(r"[a-z\- ]+", n) for n, _ in corpus_pipeline.STAGES)


@pytest.mark.parametrize("html_text", ["<p>a", "<div><p>x</div>y", "<table><tr><td>1<td>2</table>", "<a href='x>y'>z</a>"])
def test_broken_markup_has_blocks(html_text):
    assert html.blocks(html_text)


def test_wide_vectors_make_more_shards(spark):
    """Shards are bounded by bytes, and what is found doesn't suffer."""
    from tessera.llm import ann

    g = np.random.default_rng(8)
    x = g.normal(size=(40, 4096))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), k=5, shard_bytes=100_000, least_shards=1)
    sims = x @ x.T
    want = {(q, int(i)) for q in (0, 20) for i in [j for j in np.argsort(-sims[q]) if j != q][:5]}
    assert {(r["query_id"], r["id"]) for r in got.collect()} == want
