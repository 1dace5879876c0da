"""Every registered corpus query on the smallest tables: its columns, its rows, and its SQL twin where there is one."""

import os
from collections import Counter

import pytest

from tessera.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")

COLUMNS = {
    "op1_license_scan": ("doc_id", "license", "dice", "matched_lines"),
    "op2_source_mix": ("doc_id", "size", "source_size", "target", "taken"),
    "op3_sequence_packing": ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padding"),
    "op4_quality_rules": ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"),
    "op5_lm_scoring": ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"),
    "op6_html_extraction": ("page_id", "url", "text", "n_chars"),
    "op7_suffix_dedup": ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"),
    "op8_simhash": ("doc_id", "fingerprint", "component_id"),
    "op9_tool_linking": ("conv_id", "call_id", "turn", "status", "depth", "valid", "problems", "json"),
    "op10_ann_search": ("query_id", "rank", "vec_id", "score"),
    "op11_whitening": ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"),
    "op12_line_dedup": ("doc_id", "n_lines", "n_dropped", "kept_sha256"),
    "op13_lloyd": ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"),
}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(repr(tuple(r[k] for k in order)) for r in found)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, DATA)
    assert tuple(found.columns) == COLUMNS[name]
    if name in queries.ORACLES:
        twin = duck.execute(queries.ORACLES[name])
        assert rows(found.columns, map(tuple, found.collect())) == rows([c[0] for c in twin.description], twin.fetchall())
        return
    got = found.toPandas()
    if "doc_id" in got and name != "op3_sequence_packing" or "page_id" in got:
        key, table = ("page_id", "pages") if "page_id" in got else ("doc_id", "documents")
        assert Counter(got[key]) == Counter(duck.execute(f"SELECT {key} FROM {table}").df()[key])
    elif name == "op3_sequence_packing":
        assert got.groupby("sequence_id")["length"].sum().max() <= 2048
        assert (got.groupby("doc_id")["length"].sum() == got.groupby("doc_id")["doc_tokens"].first()).all()
        assert got["padding"].groupby(got["sequence_id"]).first().sum() < 0.02 * got["length"].sum()
    elif name == "op11_whitening":
        assert got.groupby("vec_id")["component"].agg(list).map(sorted).map(lambda c: c == list(range(1, 9))).all()
        assert set(got["vec_id"]) == set(duck.execute("SELECT vec_id FROM embeddings").df()["vec_id"]) and got["identity_error"].max() < 1e-4
    else:
        assert set(got["query_id"]) == set(duck.execute("SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0").df()["vec_id"])
        want = duck.execute("""SELECT q.vec_id AS q, c.vec_id AS c FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
            QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) <= 20""").df()
        assert len({*zip(want["q"], want["c"])} & {*zip(got["query_id"], got["vec_id"])}) >= 0.9 * len(want)
