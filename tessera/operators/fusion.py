"""Fusion, rerank, diversity and context of ranked lists, for many queries at once."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship

RRF_K = 60


def rrf(lists: DataFrame, by: list[str], key: str = "key", k: int = RRF_K, carry: tuple[str, ...] = ("chunk_id", "source", "text")) -> DataFrame:
    """Reciprocal rank fusion of lists (by, q_idx, route, rank, key, carry): one row per key with score and order.

    A key that occurs twice in a list counts twice; the first seen (by q_idx, route 0 vector / 1 keyword, rank) represents it
    and breaks ties.
    """
    seen = F.struct("q_idx", "route", "rank")
    fused = lists.groupBy(*by, key).agg(
        F.array_sort(F.collect_list(F.struct(seen.alias("seen"), (1.0 / (k + F.col("rank"))).alias("part")))).alias("_parts"), F.min_by(F.struct(*carry), seen).alias("_first"))
    score = F.round(F.aggregate("_parts", F.lit(0.0), lambda s, p: s + p.part), 9)
    return fused.select(*by, key, "_first.*", score.alias("rrf"), F.element_at("_parts", 1).seen.alias("seen"))


def number(rows: DataFrame, by: list[str], order: list[Column], name: str, cap: int | Column | None = None) -> DataFrame:
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if cap is None else out.where(F.col(name) <= cap)


class Reranker(Protocol):
    """A model as a column function: struct(score, error) of a query and a text; where it fails, an error instead of a score."""

    def score(self, query: Column, text: Column) -> Column: ...


class TokenCoverage:
    """Share of the query's distinct tokens that the text has; an offline stand-in for a model."""

    def score(self, query: Column, text: Column) -> Column:
        q = F.array_distinct(T.tokenize(query))
        share = F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, T.tokenize(text))) / F.size(q), 6)).otherwise(0.0)
        return F.struct(share.alias("score"), F.lit(None).cast("string").alias("error"))


class PythonReranker:
    """A function of a query and a text; what it raises for a pair becomes that pair's error."""

    def __init__(self, function: Callable[[str, str], float]):
        self.function = function

    def score(self, query: Column, text: Column) -> Column:
        function = self.function
        ship()

        @F.arrow_udf("score double, error string")
        def scores(queries, texts):
            import pyarrow as pa

            found, errors = [], []
            for q, t in zip(queries.to_pylist(), texts.to_pylist()):
                try:
                    found.append(float(function(q, t)))
                    errors.append(None)
                except Exception as e:  # one pair's failure is no other's
                    found.append(None)
                    errors.append(str(e) or type(e).__name__)
            return pa.StructArray.from_arrays([pa.array(found, pa.float64()), pa.array(errors, pa.string())], names=["score", "error"])

        return scores(query, text)


def rerank(rows: DataFrame, by: list[str], enabled: Column, top_k: Column, reranker: Reranker | None = None, rank: str = "fused_rank", said: Column | None = None) -> DataFrame:
    """Adds final_rank: by model score where enabled and there are more candidates than top_k, else as fused.

    The model's word on a row is `said` if given, else the reranker is asked about its query and text.  If the model fails for a
    candidate of a query, that query's rows stay as fused and carry the error (rerank_error).
    """
    group = Window.partitionBy(*by)
    if said is None:
        said = (reranker or TokenCoverage()).score(F.col("query"), F.col("text"))
    rows = rows.withColumn("candidates", F.count(F.lit(1)).over(group))
    rows = rows.withColumn("_said", F.when(enabled & (F.col("candidates") > top_k), said))
    rows = rows.withColumn("rerank_error", F.max("_said.error").over(group))
    score = F.when(F.col("rerank_error").isNull(), F.coalesce("_said.score", F.lit(0.0))).otherwise(0.0)
    return number(rows.withColumn("rerank_score", score).drop("_said"), by, [F.desc("rerank_score"), F.col(rank)], "final_rank")


def select_diverse(rows: DataFrame, limit: int | Column, max_per_source: int | Column, by: list[str], source: str = "source", rank: str = "final_rank") -> DataFrame:
    """The first `limit` with at most max_per_source of a source; what that skips fills up behind, in order.

    Rows without a source aren't counted; max_per_source <= 0 takes the prefix, limit <= 0 nothing.  Adds pos.
    """
    m = max_per_source if isinstance(max_per_source, Column) else F.lit(max_per_source)
    top = limit if isinstance(limit, Column) else F.lit(limit)
    nth = F.row_number().over(Window.partitionBy(*by, source).orderBy(rank))
    rows = rows.withColumn("_over", (m > 0) & F.col(source).isNotNull() & (nth > m))
    return number(rows, by, [F.col("_over"), F.col(rank)], "pos").where(F.col("pos") <= top).drop("_over")


def assemble_context(rows: DataFrame, by: list[str], text: str = "text", pos: str = "pos", separator: str = "\n\n---\n\n") -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda s: s[text])
    return rows.groupBy(*by).agg(F.array_join(parts, separator).alias("context"))
