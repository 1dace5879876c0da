"""Registered queries over whole tables, each with DuckDB SQL that computes the same rows where SQL can."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import balls, blocks, bm25, chunk, embed, evaluate, fusion, game, manifest, ranks, retrieve, segments, vector
from ..session import shared_dir
from ..sources import adapters, keyed, pages
from ..streaming import ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- shared SQL

_USER = "u AS (SELECT c_custkey AS id, c_name AS username, greatest(0, floor(c_acctbal)::INT) AS salary, c_mktsegment AS direction FROM customer)"
_LEVEL = """l AS (SELECT p_partkey AS id, p_name AS levelName, p_type AS direction, p_brand, CASE WHEN p_size % 10 = 0 THEN 999 WHEN p_size % 5 = 0 THEN 99 ELSE 0 END AS priority,
  CASE WHEN p_partkey % 10 = 0 THEN 'PRESET' ELSE 'AI' END AS source FROM part WHERE p_partkey % 97 <> 0)"""
_PLAYED = """a AS (SELECT o_custkey AS userId, l_partkey AS levelId, l_quantity::INT * 2 AS score, l_shipdate AS createTime, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R')"""
_CHANGE = """CASE WHEN {s} >= 90 THEN floor(({p}::FLOAT * 0.1::FLOAT)::DOUBLE + 0.5)::INT WHEN {s} >= 75 THEN floor(({p}::FLOAT * 0.05::FLOAT)::DOUBLE + 0.5)::INT
  WHEN {s} >= 60 THEN floor(({p}::FLOAT * 0.02::FLOAT)::DOUBLE + 0.5)::INT WHEN {s} >= 40 THEN -floor(({p}::FLOAT * 0.05::FLOAT)::DOUBLE + 0.5)::INT
  ELSE -floor(({p}::FLOAT * 0.1::FLOAT)::DOUBLE + 0.5)::INT END"""
_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_TOKENS = "list_transform(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda x: lower(x))"
_NORM = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(coalesce({}, ''), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), '(?s)^.*?://', ''), '(?s)#.*$', ''), '^www\.', ''), '/+$', '')"""
_KEPT = f"kept AS (SELECT min(doc_id) AS doc_id, {_TRIM.format('text')} AS key FROM documents GROUP BY 2)"
_INDEX = f"""{_KEPT},
toks AS (SELECT d.doc_id, {_TOKENS.format('d.text')} AS toks FROM documents d JOIN kept USING (doc_id)),
corpus AS (SELECT count(*) AS n, avg(len(toks)) AS mean_dl FROM toks),
postings AS (SELECT doc_id, len(toks) AS dl, term, count(*) AS tf FROM (SELECT doc_id, toks, unnest(toks) AS term FROM toks) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""
_ASKED = """asked AS (SELECT item_id AS query_id, 0 AS q_idx, text AS query FROM benchmark
  UNION ALL SELECT item_id, i::INT, x FROM (SELECT item_id, list_filter(list_distinct_keep, lambda x: x <> '') AS r FROM (SELECT item_id, text,
    [array_to_string(w[1:greatest(len(w) // 2, 1)], ' '), array_to_string(w[len(w) // 2 + 1:], ' ')] AS list_distinct_keep FROM (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark))), unnest(range(1, len(r) + 1)) AS g(i), (SELECT 1), unnest([r[i]]) AS h(x))"""


def _bm25_sql(asked: str, ids: str, n: int) -> str:
    """CTE kw(ids, chunk_id, score, rank) over a CTE of queries (ids, query)."""
    return f"""qt AS (SELECT DISTINCT {ids}, unnest({_TOKENS.format('query')}) AS term FROM {asked}),
scored AS (SELECT {ids}, doc_id AS chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean_dl)))), 6) AS score
  FROM qt JOIN terms USING (term) JOIN postings USING (term), corpus GROUP BY {ids}, doc_id),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {ids} ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {n})"""


_VEC = """vs AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
  FROM (SELECT vec_id, embedding FROM embeddings JOIN benchmark ON vec_id = item_id) q, (SELECT vec_id, embedding FROM embeddings JOIN documents ON vec_id = doc_id) c),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs WHERE score >= 0.2) WHERE rank <= 20)"""
_LISTS = """lists AS (SELECT a.query_id, a.q_idx, 0 AS route, v.rank, v.chunk_id FROM asked a JOIN vec v USING (query_id) UNION ALL SELECT query_id, q_idx, 1, rank, chunk_id FROM kw)"""


def _finish_sql(by: str, lists: str, rerank: str, top_k: str, per_source: str, flaky: str = "false") -> str:
    """CTE final(by, chunk_id, source, text, rrf, rerank_score, err, pos)."""
    return f"""named AS (SELECT x.*, d.source, d.text, md5({_TRIM.format('d.text')}) AS key FROM {lists} x JOIN documents d ON x.chunk_id = d.doc_id),
fused AS (SELECT {by}, key, round(list_sum(list(1.0::DOUBLE / (60 + rank) ORDER BY q_idx, route, rank)), 9) AS rrf, min([q_idx, route, rank]) AS seen,
  arg_min(struct_pack(chunk_id := chunk_id, source := source, text := text), [q_idx, route, rank]) AS f FROM named GROUP BY {by}, key),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY rrf DESC, seen) AS fused_rank FROM fused) WHERE fused_rank <= 30),
counted AS (SELECT c.*, list_distinct({_TOKENS.format('b.text')}) AS q, {flaky} AND length(b.text) % 11 = 10 AS flaky, count(*) OVER (PARTITION BY {by}) AS n FROM capped c JOIN benchmark b ON c.query_id = b.item_id),
reranked AS (SELECT *, CASE WHEN flaky AND {rerank} AND n > {top_k} THEN 'no answer' END AS err, CASE WHEN {rerank} AND n > {top_k} AND len(q) > 0 AND NOT flaky THEN round(len(list_intersect(q, {_TOKENS.format('f.text')}))::DOUBLE / len(q), 6) ELSE 0.0 END AS rerank_score FROM counted),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY rerank_score DESC, fused_rank) AS final_rank FROM reranked),
nth AS (SELECT *, {per_source} > 0 AND f.source IS NOT NULL AND row_number() OVER (PARTITION BY {by}, f.source ORDER BY final_rank) > {per_source} AS over FROM ranked),
final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY over, final_rank) AS pos FROM nth) WHERE pos <= {top_k})"""


_RETRIEVE = f"WITH {_INDEX}, {_ASKED}, {_VEC}, {_bm25_sql('asked', 'query_id, q_idx', 20)}, {_LISTS}"
_EXPECTED = """cases AS (SELECT b.item_id AS case_id, b.text AS query, coalesce(list(CASE WHEN d.doc_id % 2 = 1 THEN 'https://www.kb.example/doc/' || d.doc_id || '/' ELSE 'doc/' || d.doc_id END ORDER BY d.doc_id)
    FILTER (WHERE d.doc_id IS NOT NULL), ['doc/absent-' || b.item_id]) AS expected FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id, b.text)"""
_MATCH = "({a} <> '' AND {b} <> '' AND ({a} = {b} OR ends_with({a}, '/' || {b}) OR ends_with({b}, '/' || {a})))"
_VARIANTS = """variants AS (SELECT * FROM (VALUES ('all-on', true, true, true, 3, 2), ('no-rewrite', false, true, true, 3, 2), ('no-hybrid', true, false, true, 3, 2), ('no-rerank', true, true, false, 3, 2),
  ('vector-only', true, false, false, 3, 2), ('no-diversity', true, true, true, 3, 0), ('topk-5', true, true, true, 5, 2)) v(variant_id, v_rewrite, v_hybrid, v_rerank, v_top_k, v_per_source))"""
_TAIL = f"""{_VARIANTS}, vlists AS (SELECT * FROM lists, variants WHERE (v_rewrite OR q_idx = 0) AND (v_hybrid OR route = 0)),
{_finish_sql('variant_id, v_rerank, v_top_k, v_per_source, query_id', 'vlists', 'v_rerank', 'v_top_k', 'v_per_source', 'true')}, {_EXPECTED},
got AS (SELECT variant_id, query_id AS case_id, list('doc/' || f.chunk_id ORDER BY pos) AS returned, max(err) AS err FROM final GROUP BY variant_id, query_id),
results AS (SELECT v.variant_id, c.case_id, c.query, c.expected, CASE WHEN coalesce(b.early, err) IS NULL THEN coalesce(g.returned, []) ELSE [] END AS returned, 10 + (c.case_id * 37) % 200 AS cost_ms, coalesce(b.early, err) AS error
  FROM cases c CROSS JOIN variants v LEFT JOIN got g ON g.variant_id = v.variant_id AND g.case_id = c.case_id LEFT JOIN bad b ON b.variant_id = v.variant_id AND b.case_id = c.case_id),
normed AS (SELECT *, list_transform(expected, lambda e: {_NORM.format('e')}) AS en, list_transform(returned, lambda r: {_NORM.format('r')}) AS rn FROM results),
credit AS (SELECT *, list_transform(rn, lambda r: expected[list_position(list_transform(en, lambda e: {_MATCH.format(a='r', b='e')}), true)]) AS c FROM normed),
scores AS (SELECT variant_id, case_id, expected, returned, cost_ms, error, coalesce(list_filter(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] IS NOT NULL THEN i END), lambda x: x IS NOT NULL)[1], 0) AS hit_rank,
  len(list_filter(c, lambda x: x IS NOT NULL)) AS hit_count, list_distinct(list_filter(c, lambda x: x IS NOT NULL)) AS hit_expected, len(returned) AS returned_count, len(list_distinct(returned)) AS distinct_sources FROM credit)"""
_RUN = f"{_RETRIEVE}, bad AS (SELECT '' AS variant_id, 0 AS case_id, '' AS early WHERE false), {_TAIL}"
# The same with vectors of texts, where the model has none for texts whose length is 3 more than a multiple of 9.
_TEXT_NEAR = f"""tf AS (SELECT id, b, count(*)::DOUBLE AS tf FROM (SELECT id, ('0x' || substr(md5(unnest({_TOKENS.format('text')})), 1, 8))::BIGINT % 256 AS b
  FROM (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'q' || query_id || '.' || q_idx, query FROM asked WHERE length(query) % 9 <> 3)) GROUP BY ALL),
unit AS (SELECT *, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS x FROM tf),
near AS (SELECT q.id AS q, c.id[2:]::BIGINT AS chunk_id, round(sum(q.x * c.x), 6) AS score FROM unit q JOIN unit c ON q.b = c.b WHERE q.id[1] = 'q' AND c.id[1] = 'd' GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk_id) AS rank FROM near WHERE score >= 0.2) WHERE rank <= 20)"""
_FAILING_RUN = f"""WITH {_INDEX}, {_ASKED}, {_TEXT_NEAR}, {_bm25_sql('asked', 'query_id, q_idx', 20)},
lists AS (SELECT a.query_id, a.q_idx, 0 AS route, v.rank, v.chunk_id FROM asked a JOIN best v ON v.q = 'q' || a.query_id || '.' || a.q_idx UNION ALL SELECT query_id, q_idx, 1, rank, chunk_id FROM kw),
bad AS (SELECT variant_id, query_id AS case_id, 'no vector' AS early FROM asked, variants WHERE length(query) % 9 = 3 AND (v_rewrite OR q_idx = 0) GROUP BY ALL), """
_FAILING_RUN = _FAILING_RUN.replace("bad AS", f"{_VARIANTS}, bad AS") + _TAIL.replace(f"{_VARIANTS}, ", "", 1)
_KNOWN = f"""idx AS (SELECT {_NORM.format("'doc/' || doc_id")} AS x FROM documents), wanted AS (SELECT DISTINCT unnest(expected) AS raw FROM cases),
known AS (SELECT coalesce(list(DISTINCT raw), []) AS k FROM (SELECT raw, {_NORM.format('raw')} AS w FROM wanted), idx WHERE {_MATCH.format(a='w', b='x')})"""
_METRICS = """metrics AS (SELECT variant_id, count(*) AS total, count(error) AS failed, round(sum((hit_rank > 0)::INT)::DOUBLE / count(*), 6) AS hit_rate,
  round(sum(CASE WHEN hit_rank > 0 THEN 1.0::DOUBLE / hit_rank ELSE 0 END) / count(*), 6) AS mrr, round(sum(len(hit_expected))::DOUBLE / sum(len(expected)), 6) AS recall,
  round(coalesce(sum(hit_count)::DOUBLE / nullif(sum(returned_count), 0), 0), 6) AS precision, round(sum(CASE WHEN returned_count > 0 THEN distinct_sources::DOUBLE / returned_count ELSE 0 END) / count(*), 6) AS diversity,
  round(sum(returned_count)::DOUBLE / count(*), 6) AS avg_returned, round(sum((error IS NULL AND returned_count = 0)::INT)::DOUBLE / count(*), 6) AS empty_rate,
  quantile_disc(cost_ms, 0.5)::BIGINT AS p50_ms, quantile_disc(cost_ms, 0.95)::BIGINT AS p95_ms FROM scores GROUP BY variant_id)"""
_MANIFEST = """k AS (SELECT doc_id AS ord, 'file_name' AS source_key, 'doc/' || doc_id AS source_value, text, greatest(1, ceil((length(text) - 100) / 400.0))::INT AS chunk_count FROM documents),
p AS (SELECT *, CASE WHEN ord % 13 = 0 THEN md5(text || 'x') ELSE md5(text) END AS fingerprint FROM k WHERE ord % 17 <> 0),
c AS (SELECT *, md5(text) AS fingerprint FROM k WHERE ord % 19 <> 0 AND ord % 23 <> 0),
diff AS (SELECT coalesce(c.source_key, p.source_key) AS source_key, coalesce(c.source_value, p.source_value) AS source_value,
  CASE WHEN c.ord IS NOT NULL AND p.ord IS NULL THEN 'added' WHEN c.ord IS NOT NULL AND p.fingerprint <> c.fingerprint THEN 'changed' WHEN c.ord IS NOT NULL THEN 'unchanged'
    WHEN p.ord % 23 = 0 THEN 'failed' ELSE 'removed' END AS status, p.chunk_count AS old_count, coalesce(c.ord, p.ord) AS ord FROM p FULL JOIN c ON p.ord = c.ord)"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _game(spark, d):
    return adapters.users(spark, d), adapters.levels(spark, d), adapters.user_levels(spark, d)


# ---------------------------------------------------------------- game

@query(f"""WITH {_LEVEL}, {_PLAYED} SELECT l.id, levelName, direction, priority, source, count(a.levelId) AS playCount FROM l LEFT JOIN a ON l.id = a.levelId
GROUP BY ALL ORDER BY playCount DESC, priority DESC, l.id DESC LIMIT 10""")
def hot_levels(spark, d):
    _, level, played = _game(spark, d)
    return game.hot_levels(level, played)


@query(f"""WITH {_LEVEL}, {_PLAYED} SELECT l.id, levelName, direction, priority, source, count(a.levelId) AS playCount FROM l LEFT JOIN a ON l.id = a.levelId
WHERE direction = (SELECT min(p_type) FROM part) GROUP BY ALL ORDER BY playCount DESC, priority DESC, l.id DESC LIMIT 50""")
def hot_levels_by_direction(spark, d):
    _, level, played = _game(spark, d)
    return game.hot_levels(level, played, 500, level.agg(F.min("direction")).first()[0])


@query(f"WITH {_USER} SELECT id, username, salary, direction, row_number() OVER (ORDER BY salary DESC NULLS LAST, id) AS position FROM u")
def salary_ranking(spark, d):
    return game.salary_ranking(adapters.users(spark, d)).select("id", "username", "salary", "direction", "position")


@query(f"""WITH {_USER}, {_PLAYED}, s AS (SELECT userId, count(*) AS answers, floor(avg(score) * 10 + 0.5)::DOUBLE / 10 AS mean_score, sum(score)::BIGINT AS score_sum FROM a GROUP BY userId)
SELECT id AS userId, salary, coalesce(answers, 0) AS answers, coalesce(mean_score, 0.0) AS mean_score, coalesce(score_sum, 0) AS score_sum FROM u LEFT JOIN s ON id = userId""")
def answer_summary(spark, d):
    user, _, played = _game(spark, d)
    return game.answer_summary(user, played)


@query(f"""WITH {_LEVEL}, {_PLAYED} SELECT userId, levelId, levelName, score, createTime, row_number() OVER (PARTITION BY userId ORDER BY createTime DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC,
l_extendedprice DESC) AS nth FROM a LEFT JOIN l ON levelId = l.id""")
def answer_history(spark, d):
    _, level, played = _game(spark, d)
    return game.answer_history(played, level).select("userId", "levelId", "levelName", "score", "createTime", F.col("nth").cast("long").alias("nth"))


@query(f"""WITH {_USER}, {_LEVEL}, {_PLAYED}, dirs AS (SELECT DISTINCT direction FROM l), o AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY (source = 'PRESET') DESC, md5(id::VARCHAR || 'seed'), id) AS place FROM l),
done AS (SELECT DISTINCT userId, levelId FROM a)
SELECT userId, direction, arg_min(id, place) AS levelId FROM (SELECT u.id AS userId, o.* FROM u, o) x LEFT JOIN done USING (userId) WHERE false GROUP BY ALL
UNION ALL SELECT x.userId, x.direction, arg_min(x.id, x.place) FROM (SELECT u.id AS userId, o.* FROM u, o) x ANTI JOIN done ON x.userId = done.userId AND x.id = done.levelId GROUP BY 1, 2""")
def unanswered_pick(spark, d):
    user, level, played = _game(spark, d)
    return game.pick_unanswered_all(level, played, user, "seed")


@query("""SELECT p_partkey AS id, p_brand || '-1,' || p_brand || '-2,' || p_brand || '-3,' || p_brand || '-4' AS optionNames FROM part""")
def option_projection(spark, d):
    return game.option_names(adapters.levels(spark, d)).select("id", F.array_join("optionNames", ",").alias("optionNames"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 1 THEN p_brand || '-1,' || p_brand || '-3' ELSE p_brand || '-2' END AS trueOptions FROM part""")
def correct_options(spark, d):
    return game.correct_options(adapters.levels(spark, d)).select("id", F.array_join("trueOptions", ",").alias("trueOptions"))


@query("""WITH s AS (SELECT l_orderkey AS o_orderkey, list_distinct(list(l_linenumber)) AS us, list_filter([1, 2, 3, 4, 5, 6, 7], lambda n: (n + l_orderkey) % 2 = 0) AS ts FROM lineitem GROUP BY l_orderkey),
g AS (SELECT o_orderkey, len(list_intersect(us, ts)) AS correct, len(us) AS n_user, len(ts) AS n_true FROM s)
SELECT o_orderkey, correct::INT AS correct, (n_user - correct)::INT AS wrong, (n_true - correct)::INT AS missed, CASE WHEN n_true = 0 THEN 0 ELSE least(100, greatest(0, floor((2 * correct - n_user) * 100.0::DOUBLE / n_true + 0.5)))::INT END AS score FROM g""")
def local_grading(spark, d):
    return adapters.option_sets(spark, d).select("o_orderkey", rules.local_grade(F.col("true_set"), F.col("user_set")).alias("g")).select("o_orderkey", "g.*")


@query("""WITH s AS (SELECT l_orderkey AS o_orderkey, list_distinct(list(l_linenumber)) AS us, list_filter([1, 2, 3, 4, 5, 6, 7], lambda n: (n + l_orderkey) % 2 = 0) AS ts FROM lineitem GROUP BY l_orderkey),
g AS (SELECT *, len(list_intersect(us, ts)) AS correct FROM s)
SELECT o_orderkey, 'Graded locally: ' || correct || ' of ' || len(ts) || ' right options chosen, ' || (len(us) - correct) || ' wrong, ' || (len(ts) - correct) || ' missed.' AS reason,
  CASE WHEN o_orderkey % 3 = 0 THEN 'As in the book.' ELSE 'Right options: ' || array_to_string(ts, ', ') || '.' END AS answer FROM g""")
def grade_report(spark, d):
    k = F.col("o_orderkey")
    rows = adapters.option_sets(spark, d).withColumn("g", rules.local_grade(F.col("true_set"), F.col("user_set")))
    standard = F.when(k % 3 == 0, "As in the book.").when(k % 3 == 1, " ")
    return rows.select("o_orderkey", rules.grade_reason(F.col("g")).alias("reason"), rules.answer_text(standard, F.col("true_set").cast("array<string>")).alias("answer"))


@query("SELECT p_partkey AS id, p_name AS levelName, p_brand || '-1,' || p_brand || '-2,' || p_brand || '-3,' || p_brand || '-4' AS optionNames FROM part WHERE p_partkey = 7")
def level_detail(spark, d):
    """One level by its key, without what is true of its options."""
    return game.option_names(adapters.by_id(adapters.levels(spark, d), 7)).select("id", "levelName", F.array_join("optionNames", ",").alias("optionNames"))


@query(f"""WITH {_USER}, {_PLAYED}, g AS (SELECT DISTINCT userId, score FROM a) SELECT userId, score, salary, {_CHANGE.format(s='score', p='salary')} AS change, greatest(0, salary + {_CHANGE.format(s='score', p='salary')}) AS after FROM g JOIN u ON userId = id""")
def salary_change(spark, d):
    user, _, played = _game(spark, d)
    rows = adapters.active(played).select("userId", "score").distinct().join(user.select(F.col("id").alias("userId"), "salary"), "userId")
    change = rules.salary_change(F.col("score"), F.col("salary"))
    return rows.select("userId", "score", "salary", change.alias("change"), rules.apply_change(F.col("salary"), change).alias("after"))


@query(f"""WITH {_USER}, {_PLAYED}, s AS (SELECT userId, list(score ORDER BY createTime, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS log FROM a GROUP BY userId)
SELECT id AS userId, salary, CASE WHEN log IS NULL THEN salary ELSE list_reduce(list_prepend(salary, log), lambda p, s: greatest(0, p + {_CHANGE.format(s='s', p='p')})) END::INT AS final_salary FROM u LEFT JOIN s ON id = userId""")
def salary_ledger(spark, d):
    user, _, played = _game(spark, d)
    return game.salary_ledger(user, played)


@query(f"""WITH {_USER}, {_PLAYED}, s AS (SELECT userId, list(score ORDER BY createTime, l_orderkey, l_linenumber) AS log FROM a GROUP BY userId)
SELECT id AS userId, CASE WHEN log IS NULL THEN salary ELSE list_reduce(list_prepend(salary, log), lambda p, s: greatest(0, p + {_CHANGE.format(s='s', p='p')})) END::INT AS salary, coalesce(len(log), 0)::BIGINT AS answers FROM u LEFT JOIN s ON id = userId""")
def ledger_stream(spark, d):
    """The salaries that a stream of all answers leaves, in batches that aren't in the order of time."""
    user, played = adapters.users(spark, d), adapters.user_levels(spark, d, "place")
    folder = _folder(spark)
    answers = adapters.active(played).select("userId", F.col("createTime").cast("timestamp").alias("at"), (F.col("ord.l_orderkey") * 8 + F.col("ord.l_linenumber")).alias("ord"),
                                             F.col("place").alias("tie"), "score")  # lines of one number, which the SQL leaves open, go as they lie in the table
    answers.write.option("maxRecordsPerFile", adapters.table(spark, d, "lineitem").count() // 6 + 1).parquet(f"{folder}/in")  # three files at least
    came = spark.read.parquet(f"{folder}/in")
    files = max(1, -(-len(came.inputFiles()) // 3))
    last = came.agg(F.lit(-1).cast("long").alias("userId"), (F.max("at") + F.expr("INTERVAL 36501 DAYS")).alias("at"), F.lit(0).cast("long").alias("ord"), F.lit(0).cast("long").alias("tie"), F.lit(0).alias("score")).where("at IS NOT NULL")
    people = user.select(F.col("id").alias("userId"), "salary")
    for turn in range(2):
        if turn:
            last.coalesce(1).write.mode("append").parquet(f"{folder}/in")  # time goes on, so that no answer waits any more
        stream = spark.readStream.schema(answers.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
        ledger.follow(stream, people, f"{folder}/table", f"{folder}/checkpoint", "36500 days").awaitTermination()
    return ledger.salaries(spark, f"{folder}/table").where("userId >= 0")


@query(f"""WITH {_LEVEL}, {_PLAYED} SELECT levelId, arg_min(levelName, l.id) AS levelName, count(*) AS answers FROM a LEFT JOIN l ON levelId = l.id GROUP BY levelId""")
def batch_lookup(spark, d):
    _, level, played = _game(spark, d)
    keys = adapters.active(played).groupBy("levelId").agg(F.count(F.lit(1)).alias("answers"))
    return keys.join(adapters.active(level).select(F.col("id").alias("levelId"), "levelName"), "levelId", "left").select("levelId", "levelName", "answers")


@query("""SELECT c_custkey AS id, CASE WHEN trim(c_mktsegment) = '' OR c_mktsegment IS NULL THEN 'general' ELSE c_mktsegment END AS direction, c_custkey % 4 AS avatar,
length(c_name) < 4 OR regexp_matches(c_name, '[^A-Za-z0-9_#]') AS bad_username, NOT contains(c_name, '@') AS bad_email, string_split(c_name, '#')[1] AS first_part FROM customer""")
def user_view(spark, d):
    user = adapters.users(spark, d)
    return user.select("id", text.or_default(F.col("direction"), "general").alias("direction"), text.avatar_bucket(F.col("id")).alias("avatar"), text.bad_username(F.col("username")).alias("bad_username"),
                       text.bad_email(F.col("username")).alias("bad_email"), F.substring_index("username", "#", 1).alias("first_part"))


@query(f"""WITH {_USER}, {_PLAYED} SELECT direction, count(*) AS users, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM a WHERE a.userId = u.id)) AS players FROM u GROUP BY direction""")
def players_by_direction(spark, d):
    user, _, played = _game(spark, d)
    has = adapters.active(played).select(F.col("userId").alias("id")).distinct().withColumn("played", F.lit(1))
    return user.join(has, "id", "left").groupBy("direction").agg(F.count(F.lit(1)).alias("users"), F.count("played").alias("players"))


@query(f"""WITH {_USER}, {_LEVEL}, {_PLAYED} SELECT userId, levelId, score, CASE WHEN score >= 60 THEN 'passed' ELSE 'not passed' END AS verdict, {_CHANGE.format(s='score', p='salary')} AS change
FROM (SELECT DISTINCT userId, levelId, CASE WHEN levelId % 2 = 1 THEN (CASE WHEN userId % 2 = 1 THEN 50 ELSE 0 END) ELSE (CASE WHEN userId % 2 = 1 THEN 0 ELSE 100 END) END AS score FROM a JOIN l ON levelId = l.id) JOIN u ON userId = u.id""")
def submit_answers(spark, d):
    user, level, played = _game(spark, d)
    brand = F.concat(F.substring_index(F.from_json("options", game.OPTIONS)[0].optionName, "-", 1), F.lit("-"))
    names = adapters.active(level).select(F.col("id").alias("levelId"), brand.alias("b"))
    answers = adapters.active(played).select("userId", "levelId").distinct().join(names, "levelId")
    answers = answers.select("userId", "levelId", F.array(F.concat("b", F.when(F.col("userId") % 2 == 1, "1").otherwise("2"))).alias("userOptions"))
    return game.submit_answers(answers, level, user).select("userId", "levelId", "score", "verdict", F.col("salaryChange").alias("change"))


# ---------------------------------------------------------------- index lifecycle

@query("""SELECT doc_id, i::INT AS chunk_idx, substr(text, 400 * i::BIGINT + 1, 500) AS chunk_text FROM documents, unnest(range(0, greatest(1, ceil((length(text) - 100) / 400.0)::INT))) AS r(i)""")
def chunk_documents(spark, d):
    return chunk.chunk_texts(adapters.table(spark, d, "documents").select("doc_id", "text"))


@query("""WITH c AS (SELECT 'doc/' || doc_id AS v, i FROM documents, unnest(range(0, greatest(1, ceil((length(text) - 100) / 400.0)::INT))) AS r(i)), h AS (SELECT v, i, md5('file_name|' || v || '#' || i) AS m FROM c)
SELECT v AS source_value, i::INT AS chunk_idx, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-3' || substr(m, 14, 3) || '-' || substr('89ab', (('0x' || substr(m, 17, 1))::INT & 3) + 1, 1) || substr(m, 18, 3) || '-' || substr(m, 21, 12) AS chunk_id FROM h""")
def chunk_ids(spark, d):
    return manifest.chunks_of(adapters.knowledge(spark, d)).select("source_value", "chunk_idx", "chunk_id")


@query("SELECT doc_id, md5(text) AS fingerprint FROM documents")
def fingerprints(spark, d):
    return adapters.table(spark, d, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"))


@query(f"WITH {_MANIFEST} SELECT * REPLACE (coalesce(old_count, 0) AS old_count) FROM diff")
def manifest_diff(spark, d):
    return manifest.diff(*adapters.manifest_fixture(spark, d)).na.fill(0, "old_count")


@query(f"""WITH {_MANIFEST} SELECT {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ('added', 'changed', 'removed', 'unchanged', 'failed'))},
count(*) FILTER (WHERE status IN ('added', 'changed', 'removed')) = 0 AS nothing_to_do FROM diff""")
def manifest_summary(spark, d):
    return manifest.summary(manifest.diff(*adapters.manifest_fixture(spark, d)))


@query(f"""WITH {_MANIFEST} SELECT source_key, source_value, fingerprint, chunk_count, 0 AS late, ord FROM p JOIN diff USING (source_key, source_value, ord) WHERE status IN ('unchanged', 'failed')
UNION ALL SELECT source_key, source_value, fingerprint, chunk_count, CASE WHEN status = 'added' THEN 1 ELSE 0 END, ord FROM c JOIN diff USING (source_key, source_value, ord) WHERE status IN ('added', 'changed')""")
def manifest_apply(spark, d):
    previous, current, failed = adapters.manifest_fixture(spark, d)
    return manifest.apply_to_manifest(previous, manifest.diff(previous, current, failed), current)


@query(f"""WITH {_MANIFEST}, o AS (SELECT p.source_value, p.chunk_count FROM p JOIN diff USING (ord) WHERE status IN ('unchanged', 'failed') UNION ALL SELECT c.source_value, c.chunk_count FROM c JOIN diff USING (ord) WHERE status IN ('added', 'changed'))
SELECT source_value, i::INT AS chunk_idx FROM o, unnest(range(0, chunk_count)) AS r(i)""")
def incremental_chunks(spark, d):
    previous, current, failed = adapters.manifest_fixture(spark, d)
    old = manifest.chunks_of(adapters.knowledge(spark, d).join(previous.select(*manifest.KEY), manifest.KEY, "left_semi"))
    return manifest.apply_to_chunks(old, manifest.diff(previous, current, failed), current).select("source_value", "chunk_idx")


@query(f"""WITH {_MANIFEST} SELECT sum(chunk_count)::BIGINT AS total, sum(CASE WHEN status IN ('added', 'changed') THEN chunk_count ELSE 0 END)::BIGINT AS embedded,
sum(CASE WHEN status IN ('added', 'changed') THEN 0 ELSE chunk_count END)::BIGINT AS skipped FROM c JOIN diff USING (ord)""")
def skip_accounting(spark, d):
    previous, current, failed = adapters.manifest_fixture(spark, d)
    return manifest.skip_accounting(manifest.diff(previous, current, failed), current)


@query(f"WITH {_MANIFEST} SELECT (SELECT sum(chunk_count)::BIGINT FROM p) AS total_chunks, (SELECT count(DISTINCT source_value) FROM p) AS sources")
def manifest_totals(spark, d):
    previous, _, _ = adapters.manifest_fixture(spark, d)
    return manifest.total_chunks(previous).crossJoin(manifest.current_sources(previous).agg(F.count(F.lit(1)).alias("sources")))  # one row each


@query(f"""WITH {_MANIFEST} SELECT source_key, source_value, fingerprint, chunk_count FROM p WHERE ord % 7 <> 0 AND ord % 29 <> 0 AND ord % 31 <> 0""")
def manifest_parse(spark, d):
    previous, _, _ = adapters.manifest_fixture(spark, d)
    lines = manifest.format_manifest(previous)
    spoiled = (F.when(F.col("ord") % 7 == 0, F.concat("value", F.lit("|more"))).when(F.col("ord") % 29 == 0, F.regexp_replace("value", r"\d+$", "x"))
               .when(F.col("ord") % 31 == 0, F.regexp_replace("value", r"\|\d+$", "|0")).otherwise(F.col("value")))
    return manifest.parse_manifest(lines.select(spoiled.alias("value")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS collection, CASE WHEN doc_id % 3 = 0 THEN -1 WHEN doc_id % 5 = 0 THEN -1 ELSE n_chars::INT END AS segments FROM documents")
def collection_meta(spark, d):
    docs = adapters.table(spark, d, "documents")
    count = F.when(F.col("doc_id") % 5 == 0, "?").otherwise(F.col("n_chars").cast("string"))
    meta = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "lang", F.lit("\n"))).otherwise(F.concat(F.lit("collection="), "source", F.lit("\nsegments="), count))
    return manifest.parse_collection_meta(docs.select("doc_id", meta.alias("text"))).select("doc_id", "collection", F.coalesce("segments", F.lit(-1)).alias("segments"))


@query("""SELECT lang AS source_key, source AS source_value, min(doc_id) AS ord FROM documents GROUP BY ALL""")
def first_sources(spark, d):
    docs = adapters.table(spark, d, "documents").select(F.col("lang").alias("source_key"), F.col("source").alias("source_value"), F.col("doc_id").alias("ord"))
    return manifest.first_of_key(docs)


def _folder(spark) -> str:
    """A new folder that all of the cluster sees."""
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"


def _sources(spark, d) -> DataFrame:
    return adapters.knowledge(spark, d).withColumnRenamed("chunk_id", "ord").select("source_key", "source_value", "text", "ord")


@query(r"""WITH RECURSIVE c(doc_id, chunk_idx, pos, size) AS (SELECT doc_id, 0, 0::BIGINT, length(text) FROM documents UNION ALL
  SELECT doc_id, chunk_idx + 1, pos + cut - 100 + CASE WHEN regexp_matches(substr(w, cut - 99, 100), '[ \n]') THEN length(regexp_extract(substr(w, cut - 99, 100), '(?s)^[^ \n]*[ \n]')) ELSE 0 END, size FROM (
    SELECT *, CASE WHEN p > 100 THEN p WHEN l > 100 THEN l WHEN s > 100 THEN s WHEN x > 100 THEN x ELSE 500 END AS cut FROM (
      SELECT c.*, w, length(regexp_extract(w, '(?s)^.*\n\n')) AS p, length(regexp_extract(w, '(?s)^.*\n')) AS l, length(regexp_extract(w, '(?s)^.*[.!?] ')) AS s, length(regexp_extract(w, '(?s)^.* ')) AS x
      FROM c JOIN (SELECT doc_id, text FROM documents) d USING (doc_id), LATERAL (SELECT substr(d.text, pos + 1, 500) AS w) WHERE size - pos > 500))),
n AS (SELECT c.*, substr(text, pos + 1, 500) AS w FROM c JOIN documents USING (doc_id)),
e AS (SELECT *, length(regexp_extract(w, '(?s)^.*\n\n')) AS p, length(regexp_extract(w, '(?s)^.*\n')) AS l, length(regexp_extract(w, '(?s)^.*[.!?] ')) AS s, length(regexp_extract(w, '(?s)^.* ')) AS x FROM n)
SELECT doc_id, chunk_idx, CASE WHEN size - pos <= 500 THEN w WHEN p > 100 THEN left(w, p) WHEN l > 100 THEN left(w, l) WHEN s > 100 THEN left(w, s) WHEN x > 100 THEN left(w, x) ELSE w END AS chunk_text FROM e""")
def split_documents(spark, d):
    return chunk.chunk_texts(adapters.table(spark, d, "documents").select("doc_id", "text"), splitter="recursive")


@query(f"""WITH {_MANIFEST} SELECT {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ('added', 'changed', 'removed', 'unchanged', 'failed'))},
count(*) FILTER (WHERE status IN ('added', 'changed', 'removed')) = 0 AS in_sync, (SELECT sum(chunk_count)::BIGINT FROM p) AS index_size FROM diff""")
def startup_reconcile(spark, d):
    return manifest.reconcile(*adapters.manifest_fixture(spark, d))


@query("""SELECT doc_id, 'collection=' || source || chr(10) || 'segments=' || n_chars || chr(10) AS text, source AS collection, n_chars::INT AS segments FROM documents""")
def collection_meta_write(spark, d):
    docs = adapters.table(spark, d, "documents")
    written = docs.select("doc_id", manifest.format_collection_meta(F.col("source"), F.col("n_chars")).alias("text"))
    return manifest.parse_collection_meta(written).select("doc_id", "text", "collection", "segments")


@query("""WITH k AS (SELECT doc_id, text, greatest(1, ceil((length(text) - 100) / 400.0))::BIGINT AS n, greatest(1, ceil((length(text) + 1 - 100) / 400.0))::BIGINT AS n1 FROM documents)
SELECT 1 AS step, 'full' AS mode, 1 AS version, count(*) AS added, 0 AS changed, 0 AS removed, sum(n)::BIGINT AS chunks, sum(n)::BIGINT AS segments FROM k
UNION ALL SELECT 2, 'none', 1, 0, 0, 0, sum(n)::BIGINT, sum(n)::BIGINT FROM k
UNION ALL SELECT 3, 'incremental', 2, 0, count(*) FILTER (WHERE doc_id % 19 <> 0 AND doc_id % 23 <> 0 AND doc_id % 13 = 0), count(*) FILTER (WHERE doc_id % 19 = 0 AND doc_id % 23 <> 0),
  sum(n) FILTER (WHERE doc_id % 23 = 0)::BIGINT + sum(CASE WHEN doc_id % 13 = 0 THEN n1 ELSE n END) FILTER (WHERE doc_id % 19 <> 0 AND doc_id % 23 <> 0)::BIGINT,
  sum(n) FILTER (WHERE doc_id % 23 = 0)::BIGINT + sum(CASE WHEN doc_id % 13 = 0 THEN n1 ELSE n END) FILTER (WHERE doc_id % 19 <> 0 AND doc_id % 23 <> 0)::BIGINT FROM k""")
def rebuild_cycle(spark, d):
    """A full rebuild, one with nothing to do, and an incremental one with changed, removed and failed sources."""
    docs, header = _sources(spark, d), manifest.Header("docs")
    store, rows = manifest.Store(spark, _folder(spark)), []
    edited = docs.where("ord % 19 <> 0 AND ord % 23 <> 0").withColumn("text", F.when(F.col("ord") % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    for step, (now, failed) in enumerate(((docs, docs.limit(0)), (docs, docs.limit(0)), (edited, docs.where("ord % 23 = 0"))), 1):
        done = manifest.rebuild(store, now, failed, header)
        rows.append((step, done.mode, store.version(), *(done.counts.get(k, 0) for k in ("added", "changed", "removed")), store.read("chunks").count(), store.meta().first()["segments"]))
    return spark.createDataFrame(rows, "step int, mode string, version int, added long, changed int, removed int, chunks long, segments long")


@query("""WITH k AS (SELECT greatest(1, ceil((length(text) - 50) / 250.0))::BIGINT AS n FROM documents)
SELECT 'docs' AS collection, 1 AS version, 300 AS size, 50 AS overlap, 'windows' AS splitter, sum(n)::BIGINT AS chunks, count(*) AS sources, sum(n)::BIGINT AS written_chunks FROM k""")
def index_status(spark, d):
    docs, store = _sources(spark, d), manifest.Store(spark, _folder(spark))
    manifest.rebuild(store, docs, docs.limit(0), manifest.Header("docs", 300, 50))
    return manifest.status(store)


@query("""WITH h AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN c_mktsegment ELSE 'docs' END AS collection, CASE WHEN c_custkey % 2 = 0 THEN 500 ELSE c_nationkey END AS size,
  CASE WHEN c_custkey % 3 = 0 THEN 50 ELSE 100 END AS overlap, CASE WHEN c_custkey % 7 = 0 THEN 'recursive' ELSE 'windows' END AS splitter FROM customer)
SELECT k, CASE WHEN collection IS NULL OR trim(collection) = '' THEN 'the manifest names no collection' WHEN collection <> 'docs' THEN 'the manifest belongs to collection ' || collection
WHEN size <> 500 OR overlap <> 100 THEN 'chunks were ' || size || ' with overlap ' || overlap WHEN splitter <> 'windows' THEN 'chunks were cut by ' || splitter END AS reason FROM h""")
def rebuild_reasons(spark, d):
    """Whether the index of each customer, with a header of its own, must be rebuilt."""
    k = F.col("c_custkey")
    header = {"collection": F.when(k % 5 == 0, None).when(k % 5 == 1, " ").when(k % 5 == 2, F.col("c_mktsegment")).otherwise("docs"), "size": F.when(k % 2 == 0, 500).otherwise(F.col("c_nationkey")),
              "overlap": F.when(k % 3 == 0, 50).otherwise(100), "splitter": F.when(k % 7 == 0, "recursive").otherwise("windows")}
    return adapters.table(spark, d, "customer").select(k.alias("k"), manifest.rebuild_reason(header, *map(F.lit, ("docs", 500, 100, "windows"))).alias("reason"))


@query("SELECT 'file_name' AS source_key, r_name || '.txt' AS source_value, 'The region ' || r_name || chr(10) || 'has the key ' || r_regionkey || '.' || chr(10) AS text FROM region")
def text_files(spark, d):
    folder = _folder(spark)
    for r in adapters.table(spark, d, "region").collect():  # five rows at any size
        pages.write_text(spark, f"{folder}/{r['r_name']}.txt", f"The region {r['r_name']}\nhas the key {r['r_regionkey']}.\n")
    return pages.text_files(spark, folder)


@query("SELECT (SELECT count(*) FROM customer) AS first_added, (SELECT count(*) FROM supplier) AS then_added, true AS distinct_keys, true AS keys_follow")
def insert_rows(spark, d):
    """Two appends to one table; keys are new each time."""
    path = _folder(spark)
    first = adapters.append_rows(path, adapters.table(spark, d, "customer").select(F.col("c_name").alias("username")), "id")
    n, last = first.agg(F.count(F.lit(1)), F.max("id")).first()
    then = adapters.append_rows(path, adapters.table(spark, d, "supplier").select(F.col("s_name").alias("username")), "id")
    every = spark.read.parquet(path).agg((F.countDistinct("id") == F.count(F.lit(1))).alias("distinct_keys"))
    return then.agg(F.lit(n).alias("first_added"), F.count(F.lit(1)).alias("then_added"), (F.min("id") > last).alias("keys_follow")).join(every).select("first_added", "then_added", "distinct_keys", "keys_follow")


@query("""WITH r AS (SELECT c_name AS username, greatest(0, floor(c_acctbal)::INT) AS salary, 'customer' AS writer FROM customer UNION ALL SELECT s_name, greatest(0, floor(s_acctbal)::INT), 'supplier' FROM supplier)
SELECT username, CASE WHEN salary % 3 = 0 THEN salary + 7 WHEN salary % 3 = 1 THEN -9 ELSE salary END AS salary, writer, CASE WHEN writer = 'customer' THEN 1 ELSE 1 + (SELECT count(*) FROM customer) END AS first_key,
  CASE WHEN writer = 'customer' THEN 0 ELSE (SELECT count(*) FROM supplier) END + (SELECT count(*) FROM customer) AS last_key, count(*) OVER (PARTITION BY writer) AS keys FROM r""")
def keyed_writers(spark, d):
    """Two writers that insert at once, of which one loses its version and takes the next, and two updates of what they wrote."""
    path, schema = _folder(spark), "username string, salary int, writer string"
    first, second = keyed.KeyedTable(spark, path, schema), keyed.KeyedTable(spark, path, schema)
    rows = lambda t, p: adapters.table(spark, d, t).select(F.col(f"{p}_name").alias("username"), F.greatest(F.lit(0), F.floor(f"{p}_acctbal").cast("int")).alias("salary"), F.lit(t).alias("writer"))
    claim = second.versions.claim

    def late(number, content):
        second.versions.claim = claim
        first.insert(rows("customer", "c"))  # while the other is about to publish
        claim(number, content)

    second.versions.claim = late
    second.insert(rows("supplier", "s"))
    held = first.read()
    first.update(held.where("salary % 3 < 2").select("id", F.lit(-1).alias("salary")))
    second.update(held.where("salary % 3 = 0").select("id", (F.col("salary") + 7).alias("salary")))
    first.update(held.where("salary % 3 = 1").select("id", F.lit(None).cast("int").alias("salary")))
    own = Window.partitionBy("writer")
    return first.read().dropDuplicates(["id"]).select("username", F.coalesce("salary", F.lit(-9)).alias("salary"), "writer", F.min("id").over(own).alias("first_key"), F.max("id").over(own).alias("last_key"), F.count("id").over(own).alias("keys"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 1 THEN 'http://x/' || c_custkey WHEN c_custkey % 4 <> 1 THEN c_name END AS source FROM customer""")
def segment_source(spark, d):
    k = F.col("c_custkey")
    url = F.when(k % 3 == 0, " ").when(k % 3 == 1, F.concat(F.lit("http://x/"), k.cast("string")))
    return adapters.table(spark, d, "customer").select(k.alias("id"), text.source_of(url, F.when(k % 4 == 1, "\t").otherwise(F.col("c_name"))).alias("source"))


@query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S-%g') AS run_id FROM events")
def run_ids(spark, d):
    return adapters.table(spark, d, "events").select("event_id", text.run_id(F.col("ts")).alias("run_id"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def local_parts(spark, d):
    mail = F.concat("c_name", F.lit("@"), "c_mktsegment", F.lit("@x"))
    return adapters.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.local_part(mail).alias("name"))


# ---------------------------------------------------------------- pages and source names

@query(r"""SELECT page_id, left(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), 60) || '_' || lower(to_hex(list_reduce(list_prepend(0::BIGINT, list_transform(regexp_extract_all(url, '.'), lambda x: ascii(x)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295))) || '.txt' AS file_name FROM pages""")
def page_cache_names(spark, d):
    return adapters.table(spark, d, "pages").select("page_id", text.cache_file_name(F.col("url")).alias("file_name"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'asked/' || page_id ELSE url END AS source, CASE WHEN page_id % 3 = 0 THEN html ELSE html END AS body FROM pages")
def page_cache_parse(spark, d):
    p = adapters.table(spark, d, "pages")
    content = F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(text.build_cache(F.col("url"), F.col("html")))
    return pages.read_cached(p.select("page_id", F.concat(F.lit("asked/"), F.col("page_id").cast("string")).alias("url"), content.alias("content"))).select("page_id", "source", "body")


@query(f"SELECT page_id, {_NORM.format('url')} AS source FROM pages")
def normalize_source(spark, d):
    return adapters.table(spark, d, "pages").select("page_id", text.normalize_source(F.col("url")).alias("source"))


@query(rf"""WITH n AS (SELECT page_id, {_NORM.format('url')} AS a, {_NORM.format("regexp_replace(url, '^[a-z]+://[^/]*', '')")} AS t FROM pages), m AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN ltrim(t, '/') ELSE substr(t, 3) END AS b FROM n)
SELECT page_id, a <> '' AND b <> '' AND (a = b OR ends_with(a, '/' || b) OR ends_with(b, '/' || a)) AS matches FROM m""")
def source_match(spark, d):
    p = adapters.table(spark, d, "pages").withColumn("t", text.normalize_source(F.regexp_replace("url", "^[a-z]+://[^/]*", "")))
    other = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("t", "^/+", "")).otherwise(F.substring("t", 3, 1 << 20))
    return p.select("page_id", text.source_matches(text.normalize_source(F.col("url")), other).alias("matches"))


@query()
def html_clean(spark, d):
    return pages.clean_pages(adapters.table(spark, d, "pages"))


@query("""WITH p AS (SELECT CASE WHEN page_id % 11 = 0 THEN ' ' ELSE url END AS url, CASE WHEN page_id % 7 = 0 THEN '' ELSE html END AS text FROM pages)
SELECT url, trim(text) <> '' AS loaded FROM p WHERE trim(url) <> ''""")
def page_load(spark, d):
    p = adapters.table(spark, d, "pages").select(F.when(F.col("page_id") % 11 == 0, " ").otherwise(F.col("url")).alias("url"), F.when(F.col("page_id") % 7 == 0, "").otherwise(F.col("html")).alias("text"))
    loaded, failed = pages.load_pages(p)
    return loaded.select("url", F.lit(True).alias("loaded")).unionByName(failed.select("url", F.lit(False).alias("loaded")))


# The percentages have no halves, which Java's formats round up and C's to even.
@query(r"""SELECT doc_id, CASE WHEN length(t) > 60 THEN left(t, 60) || '…' ELSE t END AS cell, printf('%.1f%%', (n_chars * 10 + 3) / 10000.0) AS pct, printf('%.3f', n_chars / 7.0) AS dec, string_split(source || '/' || lang, '/')[-1] AS short
FROM (SELECT *, regexp_replace(translate(text, chr(10) || '|', ' /'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS t FROM documents)""")
def report_formats(spark, d):
    docs = adapters.table(spark, d, "documents")
    return docs.select("doc_id", text.table_cell(F.col("text")).alias("cell"), text.as_percent((F.col("n_chars") * 10 + 3) / 1000000.0).alias("pct"), text.as_decimal(F.col("n_chars") / 7.0).alias("dec"),
                       text.short_name(F.concat("source", F.lit("/"), "lang")).alias("short"))


# ---------------------------------------------------------------- retrieval

def _corpus(spark, d) -> retrieve.Corpus:
    chunks = adapters.knowledge(spark, d)
    vectors = adapters.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return retrieve.Corpus(chunks, vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), bm25.scan(chunks))


def _queries(spark, d) -> DataFrame:
    vectors = adapters.table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return adapters.benchmark_queries(spark, d).join(vectors, "query_id", "left")


@query(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)")
def tokenize(spark, d):
    docs = adapters.table(spark, d, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"WITH {_INDEX} SELECT term, df, sum(tf)::BIGINT AS occurrences FROM postings JOIN terms USING (term) GROUP BY ALL")
def term_stats(spark, d):
    return bm25.build_index(adapters.knowledge(spark, d)).postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


@query(f"WITH {_INDEX} SELECT doc_id AS chunk_id, len(toks)::INT AS dl, n, round(mean_dl, 6) AS mean_dl FROM toks, corpus")
def doc_lengths(spark, d):
    kept = bm25.first_of_equal_texts(adapters.knowledge(spark, d), "chunk_id", "text")
    rows = kept.select("chunk_id", F.size(text.tokenize(F.col("text"))).alias("dl"))
    return rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dl"), 6).alias("mean_dl"))))  # one row


@query(f"WITH {_INDEX}, q AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_bm25_sql('q', 'query_id', 20)} SELECT query_id, chunk_id, score, rank FROM kw")
def bm25_search(spark, d):
    found = bm25.scan(adapters.knowledge(spark, d)).search(adapters.benchmark_queries(spark, d), 20)
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_INDEX}, q AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_bm25_sql('q', 'query_id', 20)} SELECT query_id, chunk_id, score, rank FROM kw")
def bm25_index_search(spark, d):
    """The same by way of postings."""
    found = bm25.build_index(adapters.knowledge(spark, d)).search(adapters.benchmark_queries(spark, d), 20)
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_INDEX}, q AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_bm25_sql('q', 'query_id', 20)} SELECT query_id, chunk_id, score, rank FROM kw")
def bm25_block_search(spark, d):
    """The same by way of cells, without those that can't change the best."""
    index = blocks.build(bm25.build_index(adapters.knowledge(spark, d)), 64).write(_folder(spark))
    found = index.search(adapters.benchmark_queries(spark, d), 20)
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_VEC} SELECT query_id, chunk_id, score, rank FROM vec")
def vector_search(spark, d):
    found = vector.search(_queries(spark, d), _corpus(spark, d).vectors, 20)
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_VEC} SELECT query_id, chunk_id, score, rank FROM vec")
def vector_ball_search(spark, d):
    """The same by way of balls, without those whose bounds can't reach the best."""
    index = balls.build(_corpus(spark, d).vectors).write(_folder(spark))
    found = index.search(_queries(spark, d), 20)
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_ASKED} SELECT query_id, q_idx, query FROM asked")
def multi_query_expand(spark, d):
    return retrieve.expand_queries(adapters.benchmark_queries(spark, d)).select("query_id", "q_idx", "query")


@query("""WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), f AS (SELECT conv_id, list(text ORDER BY turn) AS l FROM t GROUP BY conv_id),
r AS (SELECT conv_id, l[1] AS query, list_filter(list_transform(l[2:], lambda x: regexp_replace(x, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')), lambda x: x <> '') AS rest FROM f),
o AS (SELECT conv_id, query AS x, 0 AS i FROM r UNION ALL SELECT conv_id, rest[i], i::INT FROM r, unnest(range(1, len(rest) + 1)) AS g(i)),
u AS (SELECT conv_id, x, min(i) AS i FROM o GROUP BY conv_id, x)
SELECT conv_id, x AS query, n AS q_idx FROM (SELECT conv_id, x, (row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1)::INT AS n FROM u) WHERE n <= 4""")
def conversation_queries(spark, d):
    turns = adapters.table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s.text).alias("l"))
    asked = turns.select("conv_id", F.col("l")[0].alias("query"), F.slice("l", F.lit(2), F.size("l")).alias("rewrites"))
    return retrieve.expand_queries(asked).select("conv_id", "query", "q_idx")


@query(f"{_RETRIEVE}, {_finish_sql('query_id', 'lists', 'true', '3', '2')} SELECT query_id, key, rrf, fused_rank FROM capped")
def rrf_fusion(spark, d):
    corpus, queries = _corpus(spark, d), _queries(spark, d)
    lists = retrieve.recall(retrieve.expand_queries(queries), corpus, retrieve.RetrieveOptions(), strict=True)
    named = lists.join(corpus.chunks.select("chunk_id", "source", "text"), "chunk_id").withColumn("key", F.md5(text.java_trim(F.col("text"))))
    capped = fusion.number(fusion.rrf(named, ["query_id"]), ["query_id"], [F.desc("rrf"), F.col("seen")], "fused_rank", 30)
    return capped.select("query_id", "key", "rrf", F.col("fused_rank").cast("long").alias("fused_rank"))


@query(f"{_RETRIEVE}, {_finish_sql('query_id', 'lists', 'true', '3', '2')} SELECT query_id, pos, f.chunk_id AS chunk_id, f.source AS source, rrf, rerank_score FROM final")
def hybrid_retrieve(spark, d):
    found = retrieve.retrieve(_queries(spark, d), _corpus(spark, d), strict=True)
    return found.select("query_id", F.col("pos").cast("long").alias("pos"), "chunk_id", "source", "rrf", "rerank_score")


@query(f"{_RETRIEVE}, {_finish_sql('query_id', 'lists', 'true', '3', '2')} SELECT query_id, md5(string_agg(f.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos)) AS digest FROM final GROUP BY query_id")
def context_assembly(spark, d):
    return retrieve.retrieve_context(_queries(spark, d), _corpus(spark, d), strict=True).select("query_id", F.md5("context").alias("digest"))


@query(f"""WITH {_INDEX}, q AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_bm25_sql('q', 'query_id', 50)},
m AS (SELECT query_id, chunk_id, rank, count(*) OVER (PARTITION BY query_id) AS n, list_distinct({_TOKENS.format('query')}) AS q, {_TOKENS.format('d.text')} AS t FROM kw JOIN q USING (query_id) JOIN documents d ON chunk_id = d.doc_id),
s AS (SELECT query_id, chunk_id, rank, CASE WHEN n > 5 THEN round(len(list_intersect(q, t))::DOUBLE / len(q), 6) ELSE 0 END AS s FROM m)
SELECT query_id, chunk_id, s AS rerank_score, final_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS final_rank FROM s) WHERE final_rank <= 5""")
def rerank_topk(spark, d):
    """The five best of each query's fifty best by words, reranked."""
    chunks, queries = adapters.knowledge(spark, d), adapters.benchmark_queries(spark, d).select("query_id", "query")
    found = bm25.scan(chunks).search(queries, 50).withColumnRenamed("rank", "fused_rank")
    pairs = found.join(chunks.select("chunk_id", "text"), "chunk_id").join(queries, "query_id")
    ranked = fusion.rerank(pairs, ["query_id"], F.lit(True), F.lit(5))
    return ranked.where("final_rank <= 5").select("query_id", "chunk_id", "rerank_score", F.col("final_rank").cast("long").alias("final_rank"))


@query(f"""WITH t AS (SELECT id, b, count(*)::DOUBLE AS tf FROM (SELECT id, ('0x' || substr(md5(unnest({_TOKENS.format('text')})), 1, 8))::BIGINT % 256 AS b FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark)) GROUP BY ALL),
v AS (SELECT *, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS x FROM t),
s AS (SELECT -1 - q.id AS query_id, c.id AS chunk_id, round(sum(q.x * c.x), 6) AS score FROM v q JOIN v c ON q.b = c.b WHERE q.id < 0 AND c.id >= 0 GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score >= 0.2) WHERE rank <= 5""")
def text_embedding_search(spark, d):
    """Texts made into vectors and searched by text."""
    model = embed.HashedTerms()
    queries = adapters.benchmark_queries(spark, d).select("query_id", model.embed(F.col("query")).alias("vector"))
    found = vector.search(queries, embed.embed_chunks(adapters.knowledge(spark, d), model), 5)
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def _words(query: str, count: int) -> list[str | None]:
    """A model that fails for some queries, and else gives the outer words, one twice, and nothing."""
    if len(query) % 3 == 0:
        raise RuntimeError("no answer")
    w = query.split(" ")
    return [w[0], f"  {w[-1]} ", "", None, w[0], query]


@query(f"""WITH w AS (SELECT item_id, text, {_TRIM.format("string_split(text, ' ')[1]")} AS a, {_TRIM.format("string_split(text, ' ')[-1]")} AS b FROM benchmark)
SELECT item_id AS query_id, 0 AS q_idx, text AS query FROM w UNION ALL SELECT item_id, 1, a FROM w WHERE length(text) % 3 <> 0 AND a <> '' AND a <> text
UNION ALL SELECT item_id, CASE WHEN a = '' OR a = text THEN 1 ELSE 2 END, b FROM w WHERE length(text) % 3 <> 0 AND b <> '' AND b <> text AND b <> a""")
def rewrite_fallback(spark, d):
    asked = adapters.benchmark_queries(spark, d).select("query_id", "query")
    return retrieve.expand_queries(asked, rewriter=retrieve.PythonRewriter(_words)).select("query_id", "q_idx", "query")


class _Broken:
    """A keyword index whose search fails as it runs."""

    def search(self, queries, n, id_cols=None):
        return queries.select(*(id_cols or ["query_id"]), F.raise_error(F.lit("index lost")).cast("long").alias("chunk_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))


@query(f"WITH {_VEC}, k AS (SELECT v.*, md5({_TRIM.format('d.text')}) AS key FROM vec v JOIN documents d ON v.chunk_id = d.doc_id), f AS (SELECT query_id, key, round(list_sum(list(1.0::DOUBLE / (60 + rank) ORDER BY rank)), 9) AS rrf, min(rank) AS first FROM k GROUP BY ALL) "
       "SELECT query_id, key, rrf FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first) AS n FROM f) WHERE n <= 30")
def recall_fallback(spark, d):
    """What is fused when one recall fails while it runs: the other's results."""
    corpus = _corpus(spark, d)
    broken = retrieve.Corpus(corpus.chunks, corpus.vectors, _Broken())
    lists = retrieve.recall(retrieve.expand_queries(_queries(spark, d), enabled=False), broken, retrieve.RetrieveOptions(eager=True))
    named = lists.join(corpus.chunks.select("chunk_id", "source", "text"), "chunk_id").withColumn("key", F.md5(text.java_trim(F.col("text"))))
    return fusion.number(fusion.rrf(named, ["query_id"]), ["query_id"], [F.desc("rrf"), F.col("seen")], "n", 30).select("query_id", "key", "rrf")


@query(f"{_RETRIEVE}, {_finish_sql('query_id', 'lists', 'true', '3', '2')}, c AS (SELECT query_id, md5(string_agg(f.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos)) AS digest FROM final GROUP BY query_id) "
       "SELECT c.*, b.text IN (SELECT text FROM benchmark WHERE item_id % 2 = 0) AS cached FROM c JOIN benchmark b ON query_id = item_id")
def cached_context(spark, d):
    """Contexts of all queries after those of half of them were asked for."""
    corpus, queries, cache = _corpus(spark, d), _queries(spark, d), retrieve.ResultCache()
    retrieve.retrieve_context(queries.where("query_id % 2 = 0"), corpus, cache=cache, strict=True)
    return retrieve.retrieve_context(queries, corpus, cache=cache, strict=True).select("query_id", F.md5("context").alias("digest"), "cached")


@query("""WITH r AS (SELECT lang, doc_id, source, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY k) > 2 AS over FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY over, k) AS pos FROM o)
SELECT lang, doc_id, source, pos FROM p WHERE pos <= 50""")
def diverse_topk(spark, d):
    docs = fusion.number(adapters.table(spark, d, "documents").select("lang", "doc_id", "source", "n_chars"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], "final_rank")
    return fusion.select_diverse(docs, 50, 2, ["lang"]).select("lang", "doc_id", "source", F.col("pos").cast("long").alias("pos"))


# ---------------------------------------------------------------- the index of segments

# What the index holds after the updates of _segmented: sources that failed to load keep what they had, others are as they are now.
_SEGMENTED = f"""raw AS (SELECT 'doc/' || doc_id AS source, CASE WHEN doc_id % 23 = 0 AND doc_id % 13 = 0 THEN text || 'x' ELSE text END AS text FROM documents
  WHERE CASE WHEN doc_id % 23 = 0 THEN doc_id % 5 <> 0 ELSE doc_id % 19 <> 0 END),
pieces AS (SELECT source, i::INT AS chunk_idx, substr(text, i * 400 + 1, 500) AS text, md5('file_name|' || source || '#' || i) AS h FROM raw, unnest(range(0, greatest(1, ceil((length(text) - 100) / 400.0))::BIGINT)) AS r(i)),
held AS (SELECT source, chunk_idx, text, h[1:8] || '-' || h[9:12] || '-3' || h[14:16] || '-' || substr('89ab', ((('0x' || h[17])::INT) & 3) + 1, 1) || h[18:20] || '-' || h[21:32] AS doc_id FROM pieces)"""


def _segmented(spark, d, embedder=None) -> segments.SegmentStore:
    """An index after three updates: most sources, some with another text; all but those removed or not loaded; one more time, with nothing to do."""
    docs, store, header = _sources(spark, d), segments.SegmentStore(spark, _folder(spark)), manifest.Header("docs")
    first = docs.where("ord % 5 <> 0").withColumn("text", F.when(F.col("ord") % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    now, lost = docs.where("ord % 19 <> 0 AND ord % 23 <> 0"), docs.where("ord % 23 = 0")
    segments.update(store, first, docs.limit(0), header, embedder)
    segments.update(store, now, lost, header, embedder)
    segments.update(store, now, lost, header, embedder)
    return store


@query(f"WITH {_SEGMENTED} SELECT source, chunk_idx, doc_id AS chunk_id, md5(text) AS digest FROM held")
def segment_chunks(spark, d):
    """The chunks of an updated index once all its segments are merged."""
    store = _segmented(spark, d)
    segments.merge(store, list(store.current().segments))
    return store.live(store.current(), "chunks").select(F.col("source_value").alias("source"), "chunk_idx", "chunk_id", F.md5("chunk_text").alias("digest"))


_CHUNK_INDEX = _INDEX.replace("FROM documents", "FROM held")


@query(f"WITH {_SEGMENTED}, {_CHUNK_INDEX} SELECT term, df, n AS texts, sum(tf)::BIGINT AS occurrences, round(mean_dl, 6) AS mean_dl FROM postings JOIN terms USING (term), corpus GROUP BY ALL")
def segment_terms(spark, d):
    """Terms of an updated index by its postings, equal texts once, beside the counts that its versions carry along."""
    store = _segmented(spark, d)
    v = store.current()
    return segments.term_counts(store, v).select("term", "df", F.lit(v.texts).cast("long").alias("texts"), "occurrences", F.round(F.lit(v.tokens / v.texts), 6).alias("mean_dl"))


_SEGMENT_RUN = f"""WITH {_SEGMENTED}, {_CHUNK_INDEX.replace("FROM documents d", "FROM held d")}, {_ASKED},
tf AS (SELECT id, b, count(*)::DOUBLE AS tf FROM (SELECT id, ('0x' || substr(md5(unnest({_TOKENS.format('text')})), 1, 8))::BIGINT % 256 AS b
  FROM (SELECT doc_id AS id, text FROM held UNION ALL SELECT 'q' || query_id || '.' || q_idx, query FROM asked)) GROUP BY ALL),
unit AS (SELECT *, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS x FROM tf),
near AS (SELECT q.id AS q, c.id AS chunk_id, round(sum(q.x * c.x), 6) AS score FROM unit q JOIN unit c ON q.b = c.b WHERE q.id[1] = 'q' AND c.id[1] <> 'q' GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk_id) AS rank FROM near WHERE score >= 0.2) WHERE rank <= 20),
{_bm25_sql('asked', 'query_id, q_idx', 20)},
lists AS (SELECT a.query_id, a.q_idx, 0 AS route, v.rank, v.chunk_id FROM asked a JOIN best v ON v.q = 'q' || a.query_id || '.' || a.q_idx UNION ALL SELECT query_id, q_idx, 1, rank, chunk_id FROM kw),
{_finish_sql('query_id', 'lists', 'true', '3', '2').replace('JOIN documents d', 'JOIN held d')}"""


@query(f"{_SEGMENT_RUN} SELECT query_id, pos, f.chunk_id AS chunk_id, f.source AS source, rrf, rerank_score FROM final")
def segment_retrieve(spark, d):
    """Hybrid retrieval from an index as its updates left it, vectors by its model."""
    model = embed.HashedTerms()
    found = retrieve.retrieve(adapters.benchmark_queries(spark, d), _segmented(spark, d, model).corpus(embedder=model), strict=True)
    return found.select("query_id", F.col("pos").cast("long").alias("pos"), "chunk_id", "source", "rrf", "rerank_score")


def _sometimes(text: str) -> list[float]:
    """A model that fails for some texts."""
    if len(text) % 17 == 3:
        raise RuntimeError("no vector")
    return [float(len(text)), 1.0]


@query("""WITH k AS (SELECT doc_id, doc_id % 5 <> 0 AS known, doc_id % 13 = 0 AS edited, length(text) AS a, length(text) + (doc_id % 13 = 0)::INT AS b FROM documents),
n AS (SELECT *, greatest(1, ceil((a - 100) / 400.0))::BIGINT AS na, greatest(1, ceil((b - 100) / 400.0))::BIGINT AS nb FROM k),
s AS (SELECT *, (NOT known OR edited) AND (b - 400 * (nb - 1)) % 17 = 3 AS fails FROM n)
SELECT 1 AS step, 'full' AS mode, count(*) FILTER (WHERE known) AS added, 0::BIGINT AS changed, 0::BIGINT AS unchanged, 0 AS failures, sum(na) FILTER (WHERE known)::BIGINT AS chunks, count(*) FILTER (WHERE known) AS sources FROM s
UNION ALL SELECT 2, 'incremental', count(*) FILTER (WHERE NOT known), count(*) FILTER (WHERE known AND edited), count(*) FILTER (WHERE known AND NOT edited), (count(*) FILTER (WHERE fails))::INT,
  sum(CASE WHEN fails THEN CASE WHEN known THEN na ELSE 0 END ELSE nb END)::BIGINT, count(*) FILTER (WHERE known OR NOT fails) FROM s
UNION ALL SELECT 3, 'incremental', count(*) FILTER (WHERE fails AND NOT known), count(*) FILTER (WHERE fails AND known), count(*) FILTER (WHERE NOT fails), 0, sum(nb)::BIGINT, count(*) FROM s""")
def segment_failures(spark, d):
    """Updates whose model fails for some sources: they keep what they had, and the next update does just those."""
    docs, store, header, rows = _sources(spark, d), segments.SegmentStore(spark, _folder(spark)), manifest.Header("docs"), []
    now = docs.withColumn("text", F.when(F.col("ord") % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    works, fails = embed.PythonEmbedder(lambda text: [1.0, 0.0]), embed.PythonEmbedder(_sometimes)
    for step, (sources, model) in enumerate(((docs.where("ord % 5 <> 0"), works), (now, fails), (now, works)), 1):
        done = segments.update(store, sources, docs.limit(0), header, model)
        v = store.current()
        rows.append((step, done.mode, *(done.counts[k] for k in ("added", "changed", "unchanged")), done.failures, store.live(v, "chunks").count(), store.manifest(v).count()))
    return spark.createDataFrame(rows, "step int, mode string, added long, changed long, unchanged long, failures int, chunks long, sources long")


# ---------------------------------------------------------------- evaluation

class _Flaky(fusion.TokenCoverage):
    """A model that gives no answer for some queries."""

    def score(self, query, text):
        return F.when(F.length(query) % 11 == 10, F.struct(F.lit(None).cast("double").alias("score"), F.lit("no answer").alias("error"))).otherwise(super().score(query, text))


def _scored(spark, d, variants=tuple(evaluate.VARIANTS)) -> DataFrame:
    found = evaluate.run_variants(adapters.eval_cases(spark, d), _queries(spark, d), _corpus(spark, d), evaluate.parse_variants(list(variants)), reranker=_Flaky(), strict=True)
    return evaluate.score_cases(found.withColumn("cost_ms", 10 + (F.col("case_id") * 37) % 200), adapters.knowledge(spark, d).select("source_value"))


_joined = lambda c: F.array_join(c, ",").alias(c)


@query(f"""WITH {_EXPECTED}, m AS (SELECT case_id, CASE WHEN case_id % 7 = 0 THEN ' ' ELSE query END AS query, CASE WHEN case_id % 5 = 0 THEN [] WHEN case_id % 3 = 0 THEN list_append(expected, ' ') ELSE expected END AS expected FROM cases)
SELECT case_id, array_to_string(expected, ',') AS expected, CASE WHEN trim(query) = '' THEN 'blank query' WHEN len(expected) = 0 THEN 'no expected source' WHEN list_contains(list_transform(expected, lambda e: trim(e)), '') THEN 'blank expected source' END AS problem FROM m""")
def eval_cases(spark, d):
    """The cases, some spoiled, and what is wrong with them."""
    i, none = F.col("case_id"), F.array().cast("array<string>")
    cases = adapters.eval_cases(spark, d).withColumns({"query": F.when(i % 7 == 0, " ").otherwise(F.col("query")),
                                                       "expected": F.when(i % 5 == 0, none).when(i % 3 == 0, F.array_append("expected", F.lit(" "))).otherwise(F.col("expected"))})
    return cases.select("case_id", _joined("expected"), evaluate.case_problem(F.col("query"), F.col("expected")).alias("problem"))


@query(f"WITH {_EXPECTED} SELECT case_id, unnest(expected) AS expected FROM cases")
def eval_expected(spark, d):
    return adapters.eval_cases(spark, d).select("case_id", F.explode("expected").alias("expected"))


@query(f"{_RUN} SELECT variant_id, case_id, array_to_string(returned, ',') AS returned, hit_rank::INT AS hit_rank, hit_count::INT AS hit_count, array_to_string(list_sort(hit_expected), ',') AS hit_expected, returned_count::INT AS returned_count, distinct_sources::INT AS distinct_sources FROM scores")
def eval_scores(spark, d):
    return _scored(spark, d).select("variant_id", "case_id", _joined("returned"), "hit_rank", "hit_count", F.array_join(F.array_sort("hit_expected"), ",").alias("hit_expected"), "returned_count", "distinct_sources")


@query(f"{_RUN}, {_METRICS} SELECT * FROM metrics")
def eval_metrics(spark, d):
    return evaluate.aggregate_metrics(_scored(spark, d), ["variant_id"])


def _rarely(text: str):
    """A model that has no vector for some texts."""
    if len(text) % 9 == 3:
        raise RuntimeError("no vector")
    return embed.hashed_terms(text)


@query(f"{_FAILING_RUN}, {_METRICS} SELECT * FROM metrics")
def eval_isolation(spark, d):
    """Metrics of a run in which some vectors can't be made and some cases can't be reranked: those fail, others don't."""
    chunks, model = adapters.knowledge(spark, d), embed.PythonEmbedder(_rarely)
    corpus = retrieve.Corpus(chunks, embed.embed_chunks(chunks), bm25.scan(chunks), model)
    found = evaluate.run_variants(adapters.eval_cases(spark, d), adapters.benchmark_queries(spark, d), corpus, list(evaluate.VARIANTS.values()), reranker=_Flaky())
    scored = evaluate.score_cases(found.withColumn("cost_ms", 10 + (F.col("case_id") * 37) % 200), chunks.select("source_value"))
    return evaluate.aggregate_metrics(scored, ["variant_id"])


_TIMELESS = tuple(m for m in evaluate.METRICS if not m.endswith("_ms"))


@query(f"""WITH r1 AS ({_RUN.replace("3, 2)", "1, 2)").replace("3, 0)", "1, 0)").replace("5, 2)", "5, 2)")}, {_METRICS} SELECT * FROM metrics), r2 AS ({_RUN}, {_METRICS} SELECT * FROM metrics)
SELECT '20240101-000000-000' AS run_id, variant_id, NULL AS previous_run_id, false AS changed, failed, hit_rate, mrr, {', '.join(f'NULL::DOUBLE AS delta_{m}' for m in _TIMELESS)} FROM r1 WHERE variant_id IN ('all-on', 'no-rerank')
UNION ALL SELECT '20240103-000000-000', r2.variant_id, '20240101-000000-000', true, r2.failed, r2.hit_rate, r2.mrr, {', '.join(f'round(r2.{m} - r1.{m}, 6)' for m in _TIMELESS)} FROM r2 JOIN r1 USING (variant_id) WHERE variant_id IN ('all-on', 'no-rerank')""")
def eval_runs(spark, d):
    """Two evaluations and a broken report between them in one folder; the index is rebuilt during the second."""
    folder, docs, store, none = _folder(spark), _sources(spark, d), manifest.Store(spark, _folder(spark)), manifest.Header("docs")
    cases, queries, corpus = adapters.eval_cases(spark, d), _queries(spark, d), _corpus(spark, d)
    manifest.rebuild(store, docs, docs.limit(0), none)
    rows = []

    class Rebuilding(_Flaky):
        def score(self, query, text):
            manifest.rebuild(store, docs.where("ord % 19 <> 0"), docs.limit(0), none)
            return super().score(query, text)

    for run_id, k, judge in (("20240101-000000-000", 1, _Flaky()), ("20240103-000000-000", 3, Rebuilding())):
        report = evaluate.evaluate(cases, queries, corpus, folder, run_id, "benchmark", store, ["all-on", "no-rerank"], retrieve.RetrieveOptions(top_k=k), reranker=judge)
        rows += [(run_id, m["variant_id"], report.previous_run_id, report.collection_changed, m["failed"], m["hit_rate"], m["mrr"], *(m[f"delta_{x}"] for x in _TIMELESS)) for m in report.metrics]
        pages.write_text(spark, f"{folder}/20240102-000000-000/report.json", '{"metrics": [{"variant_id": "all-on", "mrr":')
    return spark.createDataFrame(rows, "run_id string, variant_id string, previous_run_id string, changed boolean, failed long, hit_rate double, mrr double, " + ", ".join(f"delta_{m} double" for m in _TIMELESS))


@query(f"""{_RUN}, {_METRICS}, before AS (SELECT * FROM metrics WHERE variant_id = 'vector-only') SELECT m.variant_id, m.mrr, {', '.join(f'round(m.{x} - b.{x}, 6) AS delta_{x}' for x in evaluate.METRICS)}
FROM metrics m CROSS JOIN before b""")
def eval_delta(spark, d):
    """Every variant against the vector-only run, relabelled as each variant's run before."""
    now = evaluate.aggregate_metrics(_scored(spark, d), ["variant_id"])
    names = now.select("variant_id")
    before = now.where("variant_id = 'vector-only'").drop("variant_id").crossJoin(F.broadcast(names))
    return evaluate.metric_delta(now, before).select("variant_id", "mrr", *[f"delta_{m}" for m in evaluate.METRICS])


_REST = f"{_RUN}, {_KNOWN}, rest AS (SELECT s.*, list_filter(expected, lambda e: NOT list_contains(hit_expected, e)) AS rest, k FROM scores s, known)"


@query(f"""{_REST} SELECT variant_id, case_id, array_to_string(list_filter(rest, lambda e: NOT list_contains(k, e)), ',') AS not_in_index, array_to_string(list_filter(rest, lambda e: list_contains(k, e)), ',') AS missed FROM rest""")
def miss_classification(spark, d):
    return _scored(spark, d).select("variant_id", "case_id", _joined("not_in_index"), _joined("missed"))


@query(f"""{_REST}, gone AS (SELECT *, len(list_filter(rest, lambda e: NOT list_contains(k, e))) AS absent FROM rest WHERE error IS NOT NULL OR hit_rank = 0)
SELECT variant_id, case_id, CASE WHEN error IS NOT NULL THEN 'failed: ' || error WHEN absent = len(expected) THEN 'not indexed' WHEN returned_count = 0 THEN 'nothing returned' ELSE 'not among the results' END AS reason FROM gone""")
def miss_list(spark, d):
    return evaluate.miss_list(_scored(spark, d)).select("variant_id", "case_id", "reason")


@query(f"{_RUN}, {_METRICS} SELECT max(empty_rate) AS worst, max(empty_rate) > 0.2 AS warning FROM metrics")
def worst_empty_rate(spark, d):
    return evaluate.worst_empty_rate(evaluate.aggregate_metrics(_scored(spark, d), ["variant_id"]))


@query(f"{_RUN}, {_METRICS} SELECT '20240101-000000-000' AS run_id, variant_id, total, failed, hit_rate, mrr, recall, p95_ms FROM metrics")
def eval_report(spark, d):
    """The metrics as a written report.json gives them back."""
    scored = _scored(spark, d).persist()
    try:
        metrics, misses = ([r.asDict() for r in rows.collect()] for rows in (evaluate.aggregate_metrics(scored, ["variant_id"]), evaluate.miss_list(scored).select("variant_id", "case_id", "reason")))
    finally:
        scored.unpersist()
    options = {v.id: v.apply(retrieve.RetrieveOptions()).describe() for v in evaluate.VARIANTS.values()}
    report = evaluate.Report("20240101-000000-000", "benchmark", len(misses), metrics, misses, options, collection="docs")
    found = evaluate.read_report(spark, report.write(spark, _folder(spark)))
    return found.select("run_id", "variant_id", "total", "failed", "hit_rate", "mrr", "recall", "p95_ms")


@query("""WITH k AS (SELECT doc_id, greatest(1, ceil((length(text) - 100) / 400.0))::BIGINT AS n FROM documents)
SELECT 'docs' AS collection, 1 AS version, false AS changed_at_once, true AS changed_later, sum(n)::BIGINT AS chunks, sum(n) FILTER (WHERE doc_id % 19 <> 0)::BIGINT AS chunks_later FROM k""")
def eval_snapshot(spark, d):
    """A rebuild between an evaluation's start and end shows."""
    docs = _sources(spark, d)
    store, header = manifest.Store(spark, _folder(spark)), manifest.Header("docs")
    manifest.rebuild(store, docs, docs.limit(0), header)
    began, chunks = evaluate.Snapshot.of(store), store.read("chunks")
    at_once = began.changed(store)
    manifest.rebuild(store, docs.where("ord % 19 <> 0"), docs.limit(0), header)
    known = (F.lit(began.collection).alias("collection"), F.lit(began.version).alias("version"), F.lit(at_once).alias("changed_at_once"), F.lit(began.changed(store)).alias("changed_later"))
    return chunks.agg(F.count(F.lit(1)).alias("chunks")).join(store.read("chunks").agg(F.count(F.lit(1)).alias("chunks_later"))).select(*known, "chunks", "chunks_later")  # a row each


@query("""SELECT item_id AS case_id, length(text)::INT AS n, 'tag-' || item_id % 2 AS tag FROM benchmark WHERE item_id % 3 <> 2 AND item_id % 4 <> 1""")
def eval_set_read(spark, d):
    """Cases of a written evaluation set that aren't switched off, and of those the ones asked for."""
    folder = _folder(spark)
    items = adapters.table(spark, d, "benchmark").collect()  # an evaluation set is small by nature
    cases = [{"id": str(r["item_id"]), "query": r["text"], "expectedSources": ["doc/1"], "tags": [f"tag-{r['item_id'] % 2}"], "owner": "x"} | ({"enabled": False} if r["item_id"] % 3 == 2 else {}) for r in items]
    pages.write_text(spark, f"{folder}/set.json", json.dumps({"version": 1, "cases": cases}))
    found = pages.eval_set(spark, f"{folder}/nowhere.json", f"{folder}/set.json")
    asked = evaluate.enabled_cases(found, [str(r["item_id"]) for r in items if r["item_id"] % 4 != 1])
    return asked.select(F.col("case_id").cast("long").alias("case_id"), F.length("query").alias("n"), F.col("tags")[0].alias("tag"))


@query("""SELECT o_orderkey AS id, 'k=' || o_orderkey % 9 || ', rewrite=' || CASE WHEN o_orderstatus = 'O' THEN 'on' ELSE 'off' END || ' (at most 4), hybrid=' || CASE WHEN o_orderkey % 2 = 0 THEN 'on' ELSE 'off' END ||
  ', rerank=' || CASE WHEN o_orderkey % 3 = 0 THEN 'on' ELSE 'off' END || ', recall 20+20, 30 candidates, ' || o_custkey || ' of a source' AS options FROM orders""")
def options_text(spark, d):
    """The options of each order's retrieval, as a report words them."""
    k = F.col("o_orderkey")
    said = retrieve.options_text(top_k=k % 9, rewrite=F.col("o_orderstatus") == "O", hybrid=k % 2 == 0, rerank=k % 3 == 0, max_per_source=F.col("o_custkey"))
    return adapters.table(spark, d, "orders").select(k.alias("id"), said.alias("options"))


@query("""WITH n AS (SELECT l_orderkey AS id, l_linenumber AS i, CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_suppkey % 11 = 0 THEN l_linestatus ELSE ['all-on', 'no-rewrite', 'no-hybrid', 'no-rerank', 'vector-only', 'no-diversity', 'topk-5'][l_partkey % 7 + 1] END AS v FROM lineitem),
a AS (SELECT o_orderkey AS id, coalesce(list(v ORDER BY i, v) FILTER (WHERE v IS NOT NULL), []) AS asked FROM orders LEFT JOIN n ON o_orderkey = id GROUP BY o_orderkey),
k AS (SELECT *, list_filter(asked, lambda x: NOT list_contains(['all-on', 'no-rewrite', 'no-hybrid', 'no-rerank', 'vector-only', 'no-diversity', 'topk-5'], x)) AS unknown FROM a)
SELECT id, array_to_string(asked, ',') AS asked, CASE WHEN len(unknown) > 0 THEN NULL WHEN len(asked) = 0 THEN 'all-on' ELSE array_to_string(list_filter(asked, lambda x, i: list_position(asked, x) = i), ',') END AS variants,
  CASE WHEN len(unknown) > 0 THEN 'unknown variants ' || array_to_string(unknown, ', ') || '; there are all-on, no-rewrite, no-hybrid, no-rerank, vector-only, no-diversity, topk-5' END AS problem FROM k""")
def variant_parse(spark, d):
    """What each order's lines ask to be evaluated."""
    names = F.array(*map(F.lit, evaluate.VARIANTS))
    lines = adapters.table(spark, d, "lineitem")
    one = F.when(F.col("l_orderkey") % 5 == 0, None).when(F.col("l_suppkey") % 11 == 0, F.col("l_linestatus")).otherwise(F.element_at(names, (F.col("l_partkey") % 7 + 1).cast("int")))
    asked = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", one.alias("v")))), lambda x: x.v).alias("asked")).withColumn("asked", F.filter("asked", lambda v: v.isNotNull()))
    every = adapters.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(asked, "id", "left").withColumn("asked", F.coalesce("asked", F.array().cast("array<string>")))
    variants, problem = evaluate.variants_asked(F.col("asked"))
    return every.select("id", F.array_join("asked", ",").alias("asked"), F.array_join(variants, ",").alias("variants"), problem.alias("problem"))


@query("""SELECT event_type, count(*) AS n, quantile_disc(value, 0.5)::BIGINT AS p50, quantile_disc(value, 0.95)::BIGINT AS p95, quantile_disc(value, 1.0)::BIGINT AS worst
FROM (SELECT event_type, floor(value)::BIGINT AS value FROM events) GROUP BY event_type""")
def latency_percentiles(spark, d):
    e = adapters.table(spark, d, "events").select("event_type", F.floor("value").alias("value"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), *[rules.nearest_rank(F.col("value"), p).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (1.0, "worst"))])


@query("""SELECT event_type, count(*) AS n, quantile_disc(value, 0.5)::BIGINT AS p50, quantile_disc(value, 0.95)::BIGINT AS p95, quantile_disc(value, 1.0)::BIGINT AS worst
FROM (SELECT event_type, floor(value * 1000)::BIGINT AS value FROM events) GROUP BY event_type
UNION ALL SELECT 'all', count(*), quantile_disc(value, 0.5), quantile_disc(value, 0.95), quantile_disc(value, 1.0) FROM (SELECT floor(value * 1000)::BIGINT AS value FROM events)""")
def latency_ranks(spark, d):
    """Percentiles without a task that holds a group, of each type and of all events as one group."""
    e = adapters.table(spark, d, "events").select("event_type", F.floor(F.col("value") * 1000).alias("value"))
    return ranks.nearest_ranks(e.unionByName(e.withColumn("event_type", F.lit("all"))), "event_type", "value", {"p50": 0.5, "p95": 0.95, "worst": 1.0})


@query("""WITH r AS (SELECT strftime(ts, '%Y%m%d-%H') AS run_id, user_id, value FROM events) SELECT run_id, count(*) AS n, round(sum(value), 4) AS total FROM r WHERE run_id = (SELECT max(run_id) FROM r WHERE run_id < '20240115-00') GROUP BY run_id""")
def previous_run(spark, d):
    e = adapters.table(spark, d, "events").select(F.date_format("ts", "yyyyMMdd-HH").alias("run_id"), "user_id", "value")
    return pages.latest_run(e, "20240115-00").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
