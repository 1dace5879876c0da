"""The registered queries of the corpus operators, each over its whole table, and DuckDB SQL where SQL can tell the result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, clusters, common, html, licenses, lines, lm, mixing, packing, quality, simhash, suffix, whiten


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "license", "dice", "matched_lines")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_documents(spark, sf_dir), boost=mixing.prefer_ordinary)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(_documents(spark, sf_dir), word_tokenizer())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = common.materialise(quality.measure(_documents(spark, sf_dir), carry=["doc_id", "source"]))
    return quality.judge(measured, "source").select("row.doc_id", *quality.COUNTS, "base_failed", "kept")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("row.page_id", "row.url", "text", "n_chars")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start)
    return done.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


REPLY = {"reply": {"after": ("string", False), "text": ("string", True), "turn": ("integer", True)}}


def op9_tool_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, others = chat.dialogue(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.link_calls(calls, results, REPLY, others).withColumn("problems", F.array_join("problems", ", "))


def op10_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 20 == 0)).withColumnRenamed("id", "vec_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    kept = F.when(F.col("n_dropped") == 0, F.coalesce("row.text", F.lit(""))).otherwise(lines.kept_text(F.col("row.text"), F.col("keep")))
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_source_mix, op3_sequence_packing, op4_quality_rules, op5_lm_scoring, op6_html_extraction,
                            op7_suffix_dedup, op8_simhash, op9_tool_linking, op10_ann_search, op11_whitening, op12_line_dedup, op13_lloyd)
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _license_sql() -> str:
    said = {k: b" ".join(re.findall(rb"[a-z0-9]+", v.encode().lower())).decode() for k, v in licenses.templates().items()}
    values = ", ".join(f"('{k}', '{v}')" for k, v in said.items())
    t = licenses.THRESHOLD
    return rf"""
WITH said(name, w) AS (SELECT n, string_split(v, ' ') FROM (VALUES {values}) x(n, v)),
templates AS (SELECT DISTINCT name, w[j] || ' ' || w[j + 1] AS gram FROM said, unnest(range(1, len(w))) AS r(j)),
sizes AS (SELECT name, count(*) AS b FROM templates GROUP BY name),
lines AS (SELECT doc_id, i - 1 AS i, l[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS r(i)),
marked AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS full_line, sum(CASE WHEN regexp_matches(line, '[^\x20\x09-\x0D]') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS blanks FROM lines),
said_words AS (SELECT doc_id, i, regexp_extract_all(line, '[A-Za-z0-9]+') AS w FROM lines),
spoken AS (SELECT doc_id, i, lag(lower(w[j])) OVER (PARTITION BY doc_id ORDER BY i, j) || ' ' || lower(w[j]) AS gram FROM said_words, unnest(range(1, len(w) + 1)) AS r(j)),
line_sizes AS (SELECT doc_id, i, count(*) AS grams, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM spoken WHERE gram IS NOT NULL GROUP BY doc_id, i),
owned AS (SELECT s.doc_id, s.i, t.name, count(*) AS shared FROM spoken s JOIN templates t ON s.gram = t.gram GROUP BY ALL),
mine AS (SELECT o.*, l.pos FROM owned o JOIN line_sizes l ON o.doc_id = l.doc_id AND o.i = l.i WHERE 2 * o.shared >= l.grams),
steps AS (SELECT m.*, f, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id, name, f ORDER BY pos) <= f + 1 THEN 0 ELSE 1 END AS step FROM mine m, (VALUES (0), ({licenses.FOREIGN_LINES})) x(f)),
runs AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, name, f ORDER BY pos) AS run FROM steps),
stretches AS (
  SELECT DISTINCT doc_id, a, n FROM (SELECT doc_id, name, min(i) AS a, max(i) - min(i) + 1 AS n, sum(shared) AS shared FROM runs GROUP BY doc_id, name, f, run) r
  JOIN sizes s ON r.name = s.name WHERE r.shared >= s.b::DOUBLE * {t}::DOUBLE / {2 - t}::DOUBLE),
plain AS (
  SELECT doc_id, i AS a, 1 AS n, line AS unit FROM lines
  UNION SELECT doc_id, min(i), count(*), string_agg(line, chr(10) ORDER BY i) FROM marked WHERE full_line GROUP BY doc_id, blanks
  UNION SELECT doc_id, 0, count(*), string_agg(line, chr(10) ORDER BY i) FROM lines GROUP BY doc_id),
units AS (
  SELECT doc_id, a, n, unit FROM plain
  UNION SELECT s.doc_id, s.a, s.n, string_agg(l.line, chr(10) ORDER BY l.i) FROM stretches s JOIN lines l ON s.doc_id = l.doc_id AND l.i BETWEEN s.a AND s.a + s.n - 1 GROUP BY s.doc_id, s.a, s.n),
words AS (SELECT doc_id, a, n, list_transform(regexp_extract_all(unit, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM units),
grams AS (SELECT DISTINCT doc_id, a, n, w[j] || ' ' || w[j + 1] AS gram FROM words, unnest(range(1, len(w))) AS r(j)),
counted AS (SELECT doc_id, a, n, count(*) AS own FROM grams GROUP BY ALL),
common AS (SELECT g.doc_id, g.a, g.n, t.name, count(*) AS shared FROM grams g JOIN templates t ON g.gram = t.gram GROUP BY ALL),
scored AS (SELECT c.doc_id, c.a, c.n, c.name, (2 * c.shared)::DOUBLE / (k.own + s.b) AS dice FROM common c JOIN counted k ON c.doc_id = k.doc_id AND c.a = k.a AND c.n = k.n JOIN sizes s ON c.name = s.name),
kept AS (SELECT * FROM scored WHERE dice >= {t}),
matches AS (SELECT DISTINCT ON (doc_id, a, n) * FROM kept ORDER BY doc_id, a, n, dice DESC, name),
inner_matches AS (SELECT DISTINCT u.doc_id, u.a, u.n FROM matches u JOIN matches v ON u.doc_id = v.doc_id AND v.a <= u.a AND v.a + v.n >= u.a + u.n AND u.name <> v.name ANTI JOIN plain p ON u.doc_id = p.doc_id AND u.a = p.a AND u.n = p.n),
unit_best AS (SELECT m.* FROM matches m ANTI JOIN inner_matches x ON m.doc_id = x.doc_id AND m.a = x.a AND m.n = x.n),
best AS (SELECT DISTINCT ON (doc_id) doc_id, name, dice FROM unit_best ORDER BY doc_id, dice DESC, name),
found AS (SELECT doc_id, count(*) FILTER (WHERE n = 1) AS matched_lines FROM unit_best GROUP BY doc_id)
SELECT d.doc_id, b.name AS license, b.dice, coalesce(f.matched_lines, 0)::BIGINT AS matched_lines
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id"""


_MIX_SQL = rf"""
WITH e AS (SELECT doc_id, source, coalesce(doc_id::VARCHAR, '') || '#' || md5(coalesce(text, '')) AS k, CASE WHEN text IS NULL THEN 0 ELSE len({_WORDS.format('text')}) END AS size FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY source, k) - 1 AS nth FROM e),
d AS (SELECT doc_id, source, k || CASE WHEN nth > 0 THEN '/' || nth ELSE '' END AS k, size, CASE WHEN size < 50 OR size > 5000 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS boost FROM g),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s),
o AS (SELECT *, sum(n) OVER () AS total, coalesce(sum(n) OVER (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_n,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w FROM w),
f AS (SELECT *, 3 * n * left_w <= (total - 3 * before_n) * w AS capped FROM o),
t AS (SELECT source, n, CASE WHEN capped THEN (3 * n)::DOUBLE
  ELSE ((total - 3 * sum(CASE WHEN capped THEN n ELSE 0 END) OVER ()) * w)::DOUBLE / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::DOUBLE END AS target FROM f),
p AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole FROM t),
r AS (SELECT *, target - whole * n AS rest FROM p),
b AS (SELECT source, sum(CASE WHEN boost = 1 THEN size ELSE 0 END) AS ordinary, sum(size * boost) AS weight FROM d GROUP BY source),
l AS (SELECT r.*, CASE WHEN weight > 0 THEN CASE WHEN rest / weight < 1 THEN rest / weight WHEN weight > ordinary THEN (rest - ordinary) / (weight - ordinary) ELSE 1 END ELSE 0 END AS scale FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source),
u AS (SELECT d.*, r.n, r.target, r.whole, r.rest, ('0x' || substr(md5('mix' || k), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u, least(r.scale * d.boost, 1 - 1e-9) AS q
  FROM d JOIN l r ON d.source IS NOT DISTINCT FROM r.source),
v AS (SELECT *, CASE WHEN rest > 0 THEN (u / (1 - u)) / (q / (1 - q)) END AS odds FROM u),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds), k) AS upto FROM v)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, target, (size * (whole + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c"""

_QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
grams AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS x(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS y(k) GROUP BY r),
m AS (SELECT d.doc_id, d.source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  coalesce(lines.dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words FROM d LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b GROUP BY source),
a AS (SELECT sum(f) / sum(n) AS m, sum(n) AS an, sum(f * f / n) AS ff, count(*)::DOUBLE AS h FROM h),
v AS (SELECT *, CASE WHEN m > 0 AND m < 1 AND an > h THEN ((ff / an - m * m) * an / (m * (1 - m)) - h) / (an - h) END AS rho FROM a),
k AS (SELECT m, CASE WHEN rho > 1e-12 THEN least(greatest((1 - rho) / rho, {quality.PRIOR_RANGE[0]}), {quality.PRIOR_RANGE[1]}) ELSE {quality.PRIOR_RANGE[1]} END AS k FROM v),
rates AS (SELECT source, (f + m * k) / (n + k) AS rate FROM h, k)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND rate <= 0.5 AS kept FROM b JOIN rates ON b.source IS NOT DISTINCT FROM rates.source"""

_CHAT_SQL = """
WITH RECURSIVE c AS (SELECT conv_id, turn, conv_id::VARCHAR || ':' || turn::VARCHAR AS call_id, text FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR AS call_id, text FROM conversations WHERE role = 'assistant'),
deep(conv_id, turn, depth) AS (SELECT conv_id, turn, 0::BIGINT FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, depth + 1 FROM deep JOIN c ON c.conv_id = deep.conv_id AND c.turn = deep.turn + 2),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS turn, c.turn AS c_turn, r.turn AS r_turn, c.text AS asked, r.text AS content
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id),
s AS (SELECT *, CASE WHEN c_turn IS NULL THEN 'orphan result' WHEN r_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status FROM j
  UNION ALL SELECT conv_id, NULL, turn, NULL, NULL, NULL, text, 'message' FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant'))
SELECT s.conv_id, call_id, s.turn, status, depth, CASE WHEN c_turn IS NOT NULL THEN asked IS NOT NULL END AS valid,
  CASE WHEN c_turn IS NULL THEN NULL WHEN asked IS NULL THEN 'missing text' ELSE '' END AS problems,
  '{"arguments":' || CASE WHEN c_turn IS NULL THEN 'null' ELSE '{' || CASE WHEN c_turn > 1 THEN '"after":"$ref:' || s.conv_id::VARCHAR || ':' || (c_turn - 2)::VARCHAR || '",' ELSE '' END ||
    CASE WHEN asked IS NULL THEN '' ELSE '"text":' || to_json(asked)::VARCHAR || ',' END || '"turn":' || c_turn::VARCHAR || '}' END ||
  ',"call_id":' || coalesce(to_json(call_id)::VARCHAR, 'null') || ',"name":' || CASE WHEN c_turn IS NULL THEN 'null' ELSE '"reply"' END ||
  ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"' || status || '"}' AS json
FROM s LEFT JOIN deep ON c_turn IS NOT NULL AND deep.conv_id = s.conv_id AND deep.turn = s.c_turn"""

_LINES_SQL = r"""
WITH lines AS (SELECT doc_id, i, l[i] AS line, lower_ascii AS key FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS r(i),
  LATERAL (SELECT translate(regexp_replace(regexp_replace(l[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii)),
often AS (SELECT key, max(doc_id) AS kept FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, o.kept IS NOT NULL AND o.kept <> l.doc_id AS gone FROM lines l LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""


def _lloyd_sql(clusters: int = 8, rounds: int = 10) -> str:
    """Round by round: a(r) assigns the vectors to the centroids c(r), which give c(r + 1)."""
    floor = "CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END"  # integer division rounds towards zero
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, k, d FROM (SELECT vec_id, k, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS nth
  FROM (SELECT vec_id, k, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r} c)) WHERE nth = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT k, list(({floor})::BIGINT ORDER BY j) AS x FROM (SELECT k, j, sum(x[j]) AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id), unnest(range(1, 65)) AS g(j) GROUP BY k, j) GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (k))""")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * 1024)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INT AS k, x FROM v QUALIFY k < {clusters}),
{', '.join(steps)}
SELECT vec_id, k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (k)"""


ORACLES: dict[str, str] = {"op1_license_scan": _license_sql(), "op2_source_mix": _MIX_SQL, "op4_quality_rules": _QUALITY_SQL, "op9_tool_linking": _CHAT_SQL,
                           "op12_line_dedup": _LINES_SQL, "op13_lloyd": _lloyd_sql()}
