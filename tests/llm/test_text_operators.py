"""Corpus operators against plain Python on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, licenses, lm, mixing, packing, quality, simhash, suffix
from tessera.llm.queries import word_tokenizer

from .conftest import SCHEMA, corpus


def plain(docs):
    return [(r["doc_id"], (r["text"] or "").encode(), r["source"]) for r in docs.collect()]


# ------------------------------------------------------------------ suffix array

@pytest.mark.parametrize("length", [2, 5, 9, 13])
def test_window_classes(length):
    r = np.random.default_rng(length)
    for _ in range(60):
        parts = [bytes(r.integers(97, 97 + int(r.integers(1, 4)), int(r.integers(length, 70))).astype(np.uint8)) for _ in range(int(r.integers(1, 8)))]
        windows = [p[i : i + length] for p in parts for i in range(len(p) - length + 1)]
        classes = suffix.window_classes(parts, length).tolist()
        names = dict(zip(windows, classes))
        assert [names[w] for w in windows] == classes and len(set(names.values())) == len(names)


def test_suffix_order_is_a_suffix_array():
    r = np.random.default_rng(1)
    for _ in range(80):
        s = r.integers(1, int(r.integers(2, 6)), int(r.integers(1, 60)))
        got = suffix.suffix_order(s, 10_000).tolist()
        assert got == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def repeats(rows, length):
    seen, out = set(), []
    for i, x, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        cover = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            w = x[p : p + length]
            if w in seen:
                cover[p : p + length] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.r_[False, cover, False]))
        out.append((i, len(x), int(cover.sum()), len(edge) // 2, bytes(np.frombuffer(x, np.uint8)[~cover])))
    return Counter(out)


@pytest.mark.parametrize("setting", [{}, {"pack_bytes": 2000}, {"pack_bytes": 1000, "hot": 1}, {"length": 20, "mer": 8}])
def test_remove_repeats(docs, setting):
    got = suffix.remove_repeats(docs, **setting).collect()
    got = Counter((r["id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in got)
    assert got == repeats(plain(docs), setting.get("length", 100))


def test_remove_repeats_odd(odd, empty):
    assert suffix.remove_repeats(empty).count() == 0
    rows = suffix.remove_repeats(odd).collect()
    assert len(rows) == odd.count() and set(rows[0]["row"].asDict()) == set(odd.columns) - {"text"}


def test_long_text_in_slices(spark):
    r = np.random.default_rng(4)
    x = bytes(r.integers(97, 123, 900_000).astype(np.uint8)).decode()
    rows = [(1, x), (2, "no " + x[300_000:700_000]), (3, x[:99])]
    got = {r["id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(3, 400_003)], 3: []}


# ------------------------------------------------------------------ simhash

def simhash_plain(rows):
    import xxhash

    prints = {}
    for n, (i, x, _) in enumerate(rows):
        w = x.lower().split()
        grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[n] = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    top = list(range(len(rows)))

    def root(a):
        while top[a] != a:
            a = top[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                top[root(a)] = root(b)
    low = defaultdict(lambda: 1 << 62)
    for n, r in enumerate(rows):
        low[root(n)] = min(low[root(n)], r[0])
    return sorted((r[0], prints[n], low[root(n)]) for n, r in enumerate(rows))


@pytest.mark.parametrize("crowd", [128, 1])
def test_near_duplicates(docs, crowd):
    got = sorted((r["id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs, crowd=crowd).collect())
    assert got == simhash_plain(plain(docs))


@pytest.mark.parametrize("crowd", [128, 3])
def test_links_find_every_close_pair(spark, crowd):
    r = np.random.default_rng(8)
    prints = {int(x) for x in r.integers(-(2**63), 2**63, 30)}
    for x in list(prints):
        for _ in range(8):
            y = x % 2**64
            for b in r.choice(64, int(r.integers(1, 4)), replace=False):
                y ^= 1 << int(b)
            prints.add(y - 2**64 if y >= 2**63 else y)
    prints = sorted(prints)
    df = spark.createDataFrame([(x, n) for n, x in enumerate(prints)], "fp long, node long")
    got = {(r["node"]): r["component"] for r in common.components(simhash.links(df, crowd)).collect()}
    top = list(range(len(prints)))

    def root(a):
        while top[a] != a:
            a = top[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if bin((prints[a] ^ prints[b]) % 2**64).count("1") <= 2:
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    assert {n: got.get(n, n) for n in range(len(prints))} == {n: root(n) for n in range(len(prints))}


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(70)] + [(200, 210), (210, 205), (7, 7)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(71)}, 200: 200, 205: 200, 210: 200}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_write_few_files(spark, monkeypatch):
    files, write = [], common.spill

    def spill(df, *rows):
        out = write(df, *rows)
        files.append(len(out[0].inputFiles()))
        return out

    monkeypatch.setattr(common, "spill", spill)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r["node"]: r["component"] for r in common.components(spark.range(60).selectExpr("id u", "id + 1 v")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == dict.fromkeys(range(61), 0)
    assert len(files) > 2 and max(files[1:]) <= common.FEW_FILES


def test_simhash_odd(odd, empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(odd).count() == odd.count()


def test_simhash_broadcasts_no_table(docs, monkeypatch):
    plans, write = [], common.spill

    def spill(df, *rows):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *rows)

    monkeypatch.setattr(common, "spill", spill)
    spill(simhash.near_duplicates(docs, crowd=1))
    assert sum("SortMergeJoin" in p for p in plans) >= 4
    assert not any("Broadcast" in p for p in plans)


# ------------------------------------------------------------------ quality

def test_quality_counts(docs):
    def counts(x):
        t = x.decode()
        w = x.split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(w) < 2000 else set()
        lines = [y for y in t.split("\n") if y.encode().split()]
        return len(w), sum(len(y.decode()) for y in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice)

    got = Counter((r["row"]["doc_id"], *(r[c] for c in quality.COUNTS)) for r in quality.measure(docs).collect())
    assert got == Counter((i, *counts(x)) for i, x, _ in plain(docs))


def test_host_verdicts(spark):
    good, bad = "a b c d e f g h i j k l m", "a b"
    rows = [(i, good if h != "bad" and i % 10 else bad, h) for i in range(400) for h in ("one", "two", "bad", None)] + [(9999, bad, "small"), (10000, good, "small")]
    df = common.materialise(quality.measure(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    kept = {(r["row"]["source"], r["base_failed"]): r["kept"] for r in quality.judge(df, "source").collect()}
    assert kept[("one", False)] and kept[(None, False)] and kept[("small", False)] and not kept[("bad", True)] and not kept[("one", True)]
    strict = {(r["row"]["source"], r["base_failed"]): r["kept"] for r in quality.judge(df, "source", max_rate=0.05).collect()}
    assert not strict[("one", False)]


def test_quality_odd(odd, empty):
    assert quality.judge(quality.measure(empty), "source").count() == 0
    assert quality.judge(quality.measure(odd), "source").count() == odd.count()


# ------------------------------------------------------------------ mixing

def test_mix(docs):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    total = sum(r["size"] for r in got)
    assert math.isclose(sum({r["source"]: r["target"] for r in got}.values()), total)
    taken, size, most = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        size[r["source"]] = (r["source_size"], r["target"])
        most[r["source"]] = max(most[r["source"]], r["size"])
    order = sorted((s for s in size if s is not None)) + [None]
    w = {s: 1 + i % 3 for i, s in enumerate(order)}
    free = [s for s in order if size[s][1] < 3 * size[s][0]]
    assert len({round(size[s][1] / w[s], 6) for s in free}) == 1
    for s in order:
        assert abs(taken[s] - size[s][1]) <= 2 * most[s]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect()), key=str)


def test_mix_unequal_inclusion(spark):
    rows = [(i, "a b c d", "x") for i in range(600)] + [(1000 + i, "a b c d", "y") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("boost", F.when(F.col("doc_id") % 2 == 0, 1.6).otherwise(0.4))
    got = mixing.mix_sources(df, boost="boost", weights=(1, 3)).where("source = 'x'").collect()
    even, odd_ = (sum(r["copies"] for r in got if r["id"] % 2 == k) for k in (0, 1))
    assert even + odd_ == 300 and even > 3 * odd_


def test_mixed_rows(odd, empty):
    assert mixing.mix_sources(empty).count() == 0
    mixed = mixing.mix_sources(odd, keep_rows=True)
    out = mixing.repeat_rows(mixed)
    assert out.columns == odd.columns and out.count() == mixed.agg(F.sum("copies")).first()[0]


# ------------------------------------------------------------------ packing

def test_fill_is_the_best_subset():
    r = np.random.default_rng(2)
    for _ in range(60):
        lengths = r.integers(1, 30, int(r.integers(1, 9))).tolist()
        capacity = int(r.integers(1, 60))
        counts = np.bincount(lengths, minlength=64)
        got = packing.fill(counts, capacity)
        sums = {0}
        for n in lengths:
            sums |= {s + n for s in sums if s + n <= capacity}
        assert sum(k * n for k, n in got.items()) == max(sums) and all(n <= counts[k] for k, n in got.items())


def test_pieces(docs, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(word_tokenizer())
    assert packing.pack_sequences(empty, word_tokenizer()).count() == 0
    assert packing.pack_sequences(odd, word_tokenizer()).count() > 0
    got = packing.pack_sequences(docs, word_tokenizer(), window=256).collect()
    ids = {i: [*tok.encode(x.decode(), add_special_tokens=False).ids, 1] for i, x, _ in plain(docs)}
    copies = Counter(i for i, _, _ in plain(docs))
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        parts[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["padding"]))
    for i, p in parts.items():
        covered = Counter(k for a, n in p for k in range(a, a + n))
        assert covered == Counter({k: copies[i] for k in range(len(ids[i]))})
    waste = 0
    for s in sequences.values():
        at = 0
        for offset, n, _ in sorted(s):
            assert offset == at
            at += n
        assert at <= 256 and s[0][2] == (0 if at & (at - 1) == 0 else 256 - at)
        waste += s[0][2]
    assert waste < 0.03 * sum(map(len, ids.values()))


def test_tokens_by_words_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    with open(word_tokenizer(), encoding="utf-8") as f:
        definition = f.read()
    tok = Tokenizer.from_str(definition)
    strange = ["It's a Test, isn't\x1cit? ÅNGSTRÖM Å K ́x    123 4a5 <b>&amp;</b>", "İstanbul ΑΣ ß\r\n\x0b\x0c end", "", "日本語 テキスト", "’s 's 'S"]
    texts = strange + [x.decode() for _, x, _ in [(0, (r[1] or "").encode(), 0) for r in corpus(40, 9)]]
    got = packing.Ids(definition).of([x.encode() for x in texts])
    for x, b in zip(texts, got):
        assert np.frombuffer(b, "<u4").tolist() == tok.encode(x, add_special_tokens=False).ids, x


def test_new_words_of_letters_cost_few_calls():
    import itertools
    import sys

    with open(word_tokenizer(), encoding="utf-8") as f:
        ids = packing.Ids(f.read())
    words = ["".join(x) for x in itertools.product("abcdefgh", repeat=4)]
    calls = []
    sys.setprofile(lambda frame, event, what: calls.append(event) if event == "c_call" else None)
    try:
        got = ids.of([" ".join(words).encode()])
    finally:
        sys.setprofile(None)
    assert got == [b"".join(ids.encode(words))] and len(ids.cache) == len(words)
    assert len(calls) < 3 * len(words)


# ------------------------------------------------------------------ language model

def lm_plain(rows):
    train = [x for i, x, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c, pairs = Counter(), Counter()
    for x in train:
        t = [*x.lower().split(), None]
        c.update(t)
        pairs.update(zip([None, *t], t))
    return c, pairs, sum(c.values()), len(c)


@pytest.mark.parametrize("pack_bytes", [8 << 20, 3000])
def test_scores(docs, pack_bytes):
    rows = plain(docs)
    c, pairs, n, v = lm_plain(rows)
    got = defaultdict(list)
    for r in lm.score_texts(docs, pack_bytes=pack_bytes).collect():
        got[r["id"]].append(r)
    error = []
    for i, x, _ in rows:
        r = got[i][0]
        t = [*x.lower().split(), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 7 == 2, len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        exact = sum(math.log10((pairs[h, w] + lm.K * (c[w] + 1) / (n + v + 1)) / (c[h] + lm.K)) for h, w in zip([None, *t], t))
        error.append(abs(r["score"] - exact) / len(t))
    assert len(got) == len({i for i, _, _ in rows}) and np.mean(error) < 0.06


@pytest.mark.parametrize("pack_bytes", [8 << 20, 3000])
def test_scores_are_those_of_the_quantised_counts(docs, pack_bytes):
    """With a filter wide enough for no false answer, to the last digit."""
    rows = plain(docs)
    c, pairs, n, v = lm_plain(rows)
    said = lambda k: lm.VALUES[sum(k >= x for x in lm.LEVELS.tolist())]
    got = {r["id"]: r["score"] for r in lm.score_texts(docs, pack_bytes=pack_bytes, bits_per_event=2000).collect()}
    for i, x, _ in rows:
        t = [*x.lower().split(), None]
        want = sum(math.log10((min(said(pairs[h, w]), said(c[h]), said(c[w])) + lm.K * (said(c[w]) + 1) / (n + v + 1)) / (said(c[h]) + lm.K)) for h, w in zip([None, *t], t))
        assert math.isclose(got[i], want, rel_tol=1e-9)


def test_rows_of_one_id_and_text_are_counted_and_spread(spark):
    """A third of all rows are equal, or equal but for a null id: scores are those of the rows one by one."""
    r = np.random.default_rng(8)
    words = ["w%d" % i for i in range(50)]
    say = lambda k: " ".join(r.choice(words, k))
    hot, other = say(40), say(30)
    rows = [*[(5, hot)] * 400, *[(None, other)] * 300, *[(None, None)] * 20, *[(i, say(int(r.integers(0, 60)))) for i in range(100, 700)], (5, other), (None, hot)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plain_rows = lm.score_texts(df, bits_per_event=2000)
    spread = lm.score_texts(df, bits_per_event=2000, pack_bytes=2000, copies_at_once=7)
    assert lm.weighed(df.select(F.col("doc_id").alias("_id"), F.col("text").cast("binary").alias("_text"), F.lit(True).alias("_train")), 2000, 1 << 20, 7).where("_n > 1").count() >= 100
    key = lambda x: tuple(round(v, 7) if isinstance(v, float) else v for v in x)
    got = Counter(key(x) for x in spread.collect())
    assert got == Counter(key(x) for x in plain_rows.collect()) and sum(got.values()) == len(rows)


def test_words_that_polynomials_confuse():
    """Thue-Morse words of 2,048 bytes agree under any polynomial modulo 2**64."""
    word = b"a"
    for _ in range(11):
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    other = word.translate(bytes.maketrans(b"ab", b"ba"))
    h, _ = common.word_hashes([word, other, b"ab", b"ba", b"a", b"aa"])
    assert len(set(h.tolist())) == 6


def test_filter_has_every_level():
    r = np.random.default_rng(0)
    keys = r.integers(1, 2**63, 5000).astype(np.uint64)
    counts = np.minimum((r.pareto(1.0, 5000) + 1).astype(np.int64), 10**6)
    levels = np.searchsorted(lm.LEVELS, counts, "right")
    f = lm.Filter(int(levels.sum()))
    f.insert(keys, levels)
    got = f.level(keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.97
    assert (f.level(r.integers(1, 2**63, 5000).astype(np.uint64)) == 0).mean() > 0.95
    assert all(lm.LEVELS[k - 1] <= lm.VALUES[k] < lm.LEVELS[k] for k in range(1, len(lm.LEVELS)))


def test_units_of_many_lines():
    """Lines, blocks between blank lines and the whole, each matched by its own words."""
    t = licenses.Templates({"n": "released under the mit license", "m": "one two three four five six seven eight"}, 0.8)
    text = b"\n".join([b"released under the MIT License", b"", b"one two three", b"four five six", b"seven eight", b" \t", b"released under", b"the mit license", b""] + [b"the mit x"] * 20_000)
    assert t.scan(text) == {(0, 1): ("n", 1.0), (2, 3): ("m", 1.0), (6, 2): ("n", 1.0)}


def test_host_prior_is_that_of_the_hosts(spark):
    """Hosts of few and many documents whose rates are drawn from a beta: the rates shrink as with its true strength."""
    r = np.random.default_rng(12)
    a, b, rows = 2.0, 6.0, []
    for host in range(1500):
        n = int(r.choice([2, 5, 20, 60]))
        rows += [(host, bool(x)) for x in r.random(n) < r.beta(a, b)]
    found = {x["host"]: x["rate"] for x in quality.host_rates(spark.createDataFrame(rows, "host int, failed boolean")).collect()}
    n, f = Counter(h for h, _ in rows), Counter(h for h, x in rows if x)
    m = sum(f.values()) / len(rows)
    # rate = (f + m k) / (n + k) gives k
    k = np.median([(f[h] - found[h] * n[h]) / (found[h] - m) for h in n if abs(found[h] - m) > 1e-3])
    assert abs(k - (a + b)) < 1.5 and abs(m - a / (a + b)) < 0.02
    same = spark.createDataFrame([(h, i % 4 == 0) for h in range(20) for i in range(40)], "host int, failed boolean")
    assert {round(x["rate"], 3) for x in quality.host_rates(same).collect()} == {0.25}


def test_mix_of_rows_without_an_id(spark):
    rows = [(None, f"w{k} " * 50, "a") for k in range(200)] + [(k, "w " * 50, "b") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, weights=(1, 3), boost=mixing.prefer_ordinary).groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert len(got) == 2 and all(abs(x["taken"] - x["target"]) <= 50 for x in got)


def test_scores_odd(odd, empty):
    assert lm.score_texts(empty).count() == 0
    assert lm.score_texts(odd).count() == odd.count()


# ------------------------------------------------------------------ licences

def test_licences(spark, empty, odd):
    mit = licenses.NOTICES["mit"]
    rows = [(1, mit), (2, f"some prose here\n{mit.upper()}\nand more prose"), (3, None), (4, ""), (5, "nothing of the sort in the terms of the day"), (6, "license"),
            (7, licenses.NOTICES["isc"].replace(", ", ",\n")), (8, "Licensed under the BSD 3-Clause Licence.")]
    got = {r["id"]: (r["license"], r["matched_lines"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("mit", 1) and got[2] == ("mit", 1) and got[7] == ("isc", 0)
    assert all(got[k] == (None, 0) for k in (3, 4, 5, 6)) and got[8][0] == "bsd-3-clause"
    full = licenses.templates()
    texts = [(n, f"Copyright 2020 someone\n\n{full[k]}\n", k) for n, k in enumerate(("apache-2.0-text", "gpl-3.0-text", "bsd-3-clause-text", "mit-full", "lgpl-2.1-text", "apache-2.0-header"))]
    said = {r["id"]: r["license"] for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string, name string")).collect()}
    assert said == {n: k for n, _, k in texts}
    assert licenses.scan_licenses(empty).count() == 0 and licenses.scan_licenses(odd).count() == odd.count()


CODE = [f"def function_{i}(a, b):  # of the software" if i % 5 == 0 else f"    x{i} = a[{i}] + b[{i % 7}] if ready({i}) else None" if i % 5 < 4 else "" for i in range(200)]


@pytest.mark.parametrize("name", ["bsd-3-clause-text", "mit-full", "apache-2.0-text", "gpl-3.0-header", "lgpl-3.0-text"])
@pytest.mark.parametrize("width", [40, 100])
def test_licences_of_several_paragraphs_amid_code(name, width):
    """Before, behind and amid other lines, in paragraphs and with a line changed."""
    import textwrap

    full = licenses.templates()[name]
    lines = []
    for paragraph in full.split("\n\n") if "\n\n" in full else full.replace(": ", ":\n\n").replace(". ", ".\n\n").split("\n\n"):
        lines += [*textwrap.wrap(paragraph, width), ""]
    lines = lines[:-1]
    t = licenses.Templates(licenses.templates(), licenses.THRESHOLD)
    changed = [*lines[: len(lines) // 2], "an entirely different sentence stands here", *lines[len(lines) // 2 :]]
    for before, licence, after in ([], lines, CODE), (CODE, lines, []), (CODE, lines, CODE), (CODE, changed, CODE):
        found = t.scan("\n".join([*before, *licence, *after]).encode())
        (at, n), (said, dice) = min(found.items(), key=lambda x: (-x[1][1], x[1][0]))
        assert said == name and dice > 0.9
        assert abs(at - len(before)) <= 3 and abs(at + n - len(before) - len(licence)) <= 3  # a line beside it may share a bigram
    assert not t.scan("\n".join(CODE * 20).encode())


def test_stretches_are_runs_of_a_templates_lines():
    t = licenses.Templates({"n": "one two three four five six seven eight nine ten", "m": "red green blue"}, 0.8)
    text = [b"word", b"one two three", b"", b"four five", b"-", b"other words here", b"six seven", b"eight nine ten", b"and so on", b"to the", b"very end", b"red green", b"blue"]
    assert t.scan(b"\n".join(text)) == {(11, 2): ("m", 1.0)}  # too many other bigrams for n
    text[5] = b"other"
    assert t.scan(b"\n".join(text)) == {(1, 7): ("n", 2 * 8 / (10 + 9)), (11, 2): ("m", 1.0)}
    assert t.scan(b"\n".join(text[1:4] + text[6:8])) == {(0, 5): ("n", 1.0), (2, 3): ("n", 0.8)}
    assert licenses.Templates({}, 0.8).scan(b"one two") == {} and t.scan(b"") == {}
    # a stretch within a longer match of another template gives way to it, a line doesn't
    t = licenses.Templates({"all": "a b c d e f g h i j k l", "part": "d e f g h"}, 0.8)
    said = b"m n o p q r s t u v\n\n%s\n\nm n o p q r s t u v"
    assert t.scan(said % b"a b c\n\nd e f\n\ng h\n\ni j k l") == {(2, 7): ("all", 1.0)}
    assert t.scan(said % b"a b c\n\nd e f g h\n\ni j k l") == {(2, 5): ("all", 1.0), (4, 1): ("part", 1.0)}


def test_licence_twin_on_paragraphs(spark, tmp_path):
    """The registered query against its SQL where licences stand amid other lines."""
    import duckdb

    from tessera.llm import queries

    full = licenses.templates()
    rows = []
    for i, k in enumerate(["bsd-3-clause-text", "bsd-2-clause-text", "mit-full", "apache-2.0-text", "cc0-1.0-text", "mit-text", "isc"]):
        parts = full[k].replace(". ", ".\n\n").replace(", ", ",\n")
        rows += [(3 * i, f"{parts}\n" + "\n".join(CODE)), (3 * i + 1, "\n".join(CODE) + f"\n{parts}"), (3 * i + 2, "\n".join([*CODE, parts, "other things", *CODE, full["mit"]]))]
    rows += [(100, None), (101, ""), (102, "\n\n \n"), (103, "of the\nsoftware"), (104, "Ä\nB")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op1_license_scan(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(queries.ORACLES["op1_license_scan"]).fetchall())
    assert sum(r[1] is not None for r in got) == 21


def test_size_bounds_lose_nothing():
    t = 0.8
    for b in range(1, 40):
        low, high = licenses.size_bounds(b, t)
        for a in range(1, 80):
            if 2 * min(a, b) / (a + b) >= t:
                assert low <= a + 1e-9 and a <= high + 1e-9


@pytest.mark.parametrize("same, few", [("id", 100), ("text", 100), ("all", 0)])  # the shared keys are sent to the rows, or meet them by shuffle
def test_mix_takes_equal_rows_one_by_one(spark, monkeypatch, same, few):
    monkeypatch.setattr(mixing, "FEW_TWINS", few)
    text = " ".join(["w"] * 50)
    rows = [(None if same == "text" else 7, f"{text} {n}" if same == "id" else text, "a") for n in range(200)] + [(1000 + n, text + " z", "b") for n in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix_sources(df, keep_rows=True).select("id", "source", "size", "target", "copies").collect()
    for source in "ab":
        own = [r for r in got if r["source"] == source]
        assert len(own) == 200 and abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 51
    if same == "all":
        again = mixing.mix_sources(df.repartition(3)).select("id", "source", "size", "target", "copies").collect()
        assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_draws_by_its_odds(spark):
    """Documents with half the boost are drawn half as often; where the others are certain, they get what is left."""
    rows = [(n, " ".join(["w"] * 10), "a", 0.5 if n % 2 else 1.0) for n in range(4000)]
    rows += [(10_000 + n, " ".join(["w"] * 10), "b", 1.0) for n in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, boost double")
    for weights, want in (((3, 7), (0.8, 0.4)), ((9, 11), (1.0, 0.8))):
        got = mixing.mix_sources(df, boost="boost", weights=weights).where("source = 'a'").groupBy(F.col("id") % 2 == 0).agg(F.avg("copies")).collect()
        share = {r[0]: r[1] for r in got}
        assert abs(share[True] - want[0]) < 0.04 and abs(share[False] - want[1]) < 0.04
