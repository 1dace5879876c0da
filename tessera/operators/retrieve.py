"""Hybrid retrieval of many queries in one plan: rewrites, two recalls, fusion, rerank, diversity."""

from __future__ import annotations

import logging
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import checkpoints, ship
from . import bm25, embed, fusion, vector

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class RetrieveOptions:
    top_k: int = 3
    rewrite: bool = True
    rewrite_count: int = 4
    hybrid: bool = True
    vector_recall: int = 20
    keyword_recall: int = 20
    rrf_k: int = 60
    candidates: int = 30
    rerank: bool = True
    max_per_source: int = 2
    min_score: float = 0.2
    score_scale: str = "raw"
    #: Run each recall by itself, so that one which fails as it runs is left out too.
    eager: bool = False

    def with_(self, **changes) -> RetrieveOptions:
        return replace(self, **changes)

    def describe(self) -> str:
        on = lambda name, flag: f"{name}={'on' if flag else 'off'}"
        return (f"k={self.top_k}, {on('rewrite', self.rewrite)} (at most {self.rewrite_count}), {on('hybrid', self.hybrid)}, {on('rerank', self.rerank)}, "
                f"recall {self.vector_recall}+{self.keyword_recall}, {self.candidates} candidates, {self.max_per_source} of a source")


def options_text(**of: Column) -> Column:
    """RetrieveOptions.describe() of a row: options by name as columns, defaults for the rest."""
    value = lambda name: of.get(name, F.lit(getattr(RetrieveOptions(), name)))
    on = lambda name, flag: F.concat(F.lit(f"{name}="), F.when(value(flag), "on").otherwise("off"))
    number = lambda name: value(name).cast("string")
    return F.concat(F.lit("k="), number("top_k"), F.lit(", "), on("rewrite", "rewrite"), F.lit(" (at most "), number("rewrite_count"), F.lit("), "), on("hybrid", "hybrid"), F.lit(", "), on("rerank", "rerank"),
                    F.lit(", recall "), number("vector_recall"), F.lit("+"), number("keyword_recall"), F.lit(", "), number("candidates"), F.lit(" candidates, "), number("max_per_source"), F.lit(" of a source"))


@dataclass
class Corpus:
    """What is searched: chunks (chunk_id, source, text), their vectors (chunk_id, vector) and the keyword index.

    With an embedder the vectors of queries and rewrites are made by it; without, queries bring a column vector.
    """

    chunks: DataFrame
    vectors: DataFrame
    index: bm25.Bm25Index | bm25.TextScan
    embedder: embed.Embedder | None = None


class Rewriter(Protocol):
    """A model as a column function: other ways to say a query, at most `count`; null where it fails."""

    def rewrite(self, query: Column, count: int) -> Column: ...


class PythonRewriter:
    """A function of a query and a count; a query for which it raises keeps its own words only."""

    def __init__(self, function: Callable[[str, int], list[str] | None]):
        self.function = function

    def rewrite(self, query: Column, count: int) -> Column:
        function = self.function
        ship()

        @F.arrow_udf("array<string>")
        def rewrites(col):
            import pyarrow as pa

            def one(q):
                try:
                    return function(q, count)
                except Exception:  # one query's failure is no other's
                    return None

            return pa.array([one(q) for q in col.to_pylist()], pa.list_(pa.string()))

        return rewrites(query)


def expand_queries(queries: DataFrame, rewrites: str = "rewrites", enabled: bool = True, count: int = 4, rewriter: Rewriter | None = None) -> DataFrame:
    """(query_id, q_idx, query) with the original first, then up to `count` distinct trimmed rewrites: the rewriter's, else a column's."""
    if rewriter:
        queries = queries.withColumn(rewrites, rewriter.rewrite(F.col("query"), count))
    rest = F.filter(F.transform(F.coalesce(F.col(rewrites), F.array().cast("array<string>")), T.java_trim), lambda x: x.isNotNull() & (x != ""))
    every = F.array_distinct(F.concat(F.array("query"), rest)) if enabled else F.array("query")
    return queries.select(*[c for c in queries.columns if c not in ("query", rewrites)], F.posexplode(F.slice(every, 1, max(count, 0) + 1)).alias("q_idx", "query"))


def _tolerant(what: str, strict: bool, run: Callable[[], DataFrame], eager: bool) -> DataFrame | None:
    """A recall that fails is an error if strict, else it is left out: as its plan is made, or (eager) as it runs."""
    try:
        out = run()
        return out.checkpoint() if eager else out
    except Exception:
        if strict:
            raise
        log.warning("%s recall failed and is left out", what, exc_info=True)
        return None


def recall(asked: DataFrame, corpus: Corpus, options: RetrieveOptions, strict: bool = False) -> DataFrame:
    """Ranked lists (query_id, q_idx, route, rank, chunk_id): route 0 by vector, 1 by keyword."""
    checkpoints(asked.sparkSession)
    ids = ["query_id", "q_idx"]
    parts = []
    if corpus.embedder:
        asked = asked.withColumn("vector", corpus.embedder.embed(F.col("query")))
    by_vector = _tolerant("vector", strict, lambda: vector.search(asked, corpus.vectors, options.vector_recall, options.min_score, options.score_scale, ids), options.eager)
    if by_vector is not None:
        parts.append(by_vector.select(*ids, F.lit(0).alias("route"), "rank", "chunk_id"))
    if options.hybrid:
        by_word = _tolerant("keyword", strict, lambda: corpus.index.search(asked, options.keyword_recall, ids), options.eager)
        if by_word is not None:
            parts.append(by_word.select(*ids, F.lit(1).alias("route"), "rank", "chunk_id"))
    if not parts:
        raise RuntimeError("no recall is left")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recall_each(asked: DataFrame, corpus: Corpus, options: RetrieveOptions, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lists, errors): as recall(), both routes, and (query_id, q_idx, route, error) of what failed; both are checkpointed.

    A text whose vector can't be made is that text's error alone.  A recall that fails as it runs is the error of every text it
    was asked for; the other one's lists stay.  If strict it is raised, for callers whose rows have no place for an error.
    """
    checkpoints(asked.sparkSession)
    ids = ["query_id", "q_idx"]
    asked = asked.select(*ids, *[c for c in asked.columns if c not in ids])
    none = asked.sparkSession.createDataFrame([], f"{', '.join(f'{c} {asked.schema[c].dataType.simpleString()}' for c in ids)}, route int, error string")
    errors = [none]
    if corpus.embedder:
        asked = asked.withColumn("_said", embed.said(corpus.embedder, F.col("query"))).checkpoint()
        errors.append(asked.where("_said.error IS NOT NULL").select(*ids, F.lit(0).alias("route"), F.col("_said.error").alias("error")))
        asked = asked.withColumn("vector", F.col("_said.vector")).drop("_said")
    parts = []
    for route, run in ((0, lambda: vector.search(asked, corpus.vectors, options.vector_recall, options.min_score, options.score_scale, ids)),
                       (1, lambda: corpus.index.search(asked, options.keyword_recall, ids))):
        try:
            parts.append(run().select(*ids, F.lit(route).alias("route"), "rank", "chunk_id").checkpoint())
        except Exception as e:
            if strict:
                raise
            log.warning("%s recall failed", ("vector", "keyword")[route], exc_info=True)
            what = (str(e).strip() or type(e).__name__).splitlines()[0]
            errors.append(asked.select(*ids, F.lit(route).alias("route"), F.lit(what).alias("error")))
    kind = corpus.chunks.schema["chunk_id"].dataType.simpleString()
    lists = asked.sparkSession.createDataFrame([], none.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ").replace("error string", f"rank int, chunk_id {kind}"))
    for part in parts:
        lists = lists.unionByName(part)
    out = errors[0]
    for part in errors[1:]:
        out = out.unionByName(part)
    return lists, out.checkpoint()


def finish(lists: DataFrame, queries: DataFrame, corpus: Corpus, by: list[str], options: dict[str, Column], candidates: int, rrf_k: int, reranker: fusion.Reranker | None = None) -> DataFrame:
    """Fusion, cap, rerank and diversity; options: columns rerank, top_k and max_per_source.  Rows carry chunk_id and source, no text.

    Texts are read for what the lists hold, once, and only meet the queries for the candidates left after the cap, each pair once.
    """
    checkpoints(lists.sparkSession)
    hit = corpus.chunks.select("chunk_id", "source", "text").join(lists.select("chunk_id").distinct(), "chunk_id", "left_semi").withColumn("key", F.md5(T.java_trim(F.col("text")))).checkpoint()
    fused = fusion.rrf(lists.join(hit.drop("text"), "chunk_id"), by, k=rrf_k, carry=("chunk_id", "source"))
    capped = fusion.number(fused, by, [F.desc("rrf"), F.col("seen")], "fused_rank", candidates).checkpoint()
    pairs = capped.where(options["rerank"]).select("query_id", "chunk_id").distinct().join(hit.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    said = pairs.select("query_id", "chunk_id", (reranker or fusion.TokenCoverage()).score(F.col("query"), F.col("text")).alias("said"))
    ranked = fusion.rerank(capped.join(said, ["query_id", "chunk_id"], "left"), by, options["rerank"], options["top_k"], said=F.col("said"))
    return fusion.select_diverse(ranked, options["top_k"], options["max_per_source"], by)


def retrieve(queries: DataFrame, corpus: Corpus, options: RetrieveOptions | None = None, strict: bool = False, rewriter: Rewriter | None = None,
             reranker: fusion.Reranker | None = None) -> DataFrame:
    """(query_id, pos, chunk_id, source, text, rrf, rerank_score) for queries (query_id, query, rewrites, vector)."""
    o = options or RetrieveOptions()
    asked = expand_queries(queries, enabled=o.rewrite, count=o.rewrite_count, rewriter=rewriter)
    lists = recall(asked, corpus, o, strict).checkpoint()
    columns = {"rerank": F.lit(o.rerank), "top_k": F.lit(o.top_k), "max_per_source": F.lit(o.max_per_source)}
    out = finish(lists, queries, corpus, ["query_id"], columns, o.candidates, o.rrf_k, reranker)
    return out.join(corpus.chunks.select("chunk_id", "text"), "chunk_id").select("query_id", "pos", "chunk_id", "source", "text", "rrf", "rerank_score")


class ResultCache:
    """Contexts by query, held on the driver: at most max_entries of them, each for ttl seconds; blank ones aren't kept."""

    def __init__(self, ttl: float = 1800, max_entries: int = 1000, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.max_entries, self.clock = ttl, max_entries, clock
        self._held: OrderedDict[str, tuple[float, str]] = OrderedDict()

    def get(self, query: str) -> str | None:
        when, context = self._held.get(query, (0.0, None))
        if context is None or self.clock() - when >= self.ttl:
            self._held.pop(query, None)
            return None
        self._held.move_to_end(query)
        return context

    def put(self, query: str, context: str | None) -> None:
        if context and context.strip():
            self._held[query] = (self.clock(), context)
            self._held.move_to_end(query)
            while len(self._held) > self.max_entries:
                self._held.popitem(last=False)

    def clear_all(self) -> None:
        self._held.clear()

    def items(self) -> list[tuple[str, str]]:
        return [(q, c) for q in list(self._held) if (c := self.get(q)) is not None]


def retrieve_context(queries: DataFrame, corpus: Corpus, options: RetrieveOptions | None = None, cache: ResultCache | None = None, **models) -> DataFrame:
    """(query_id, context, cached) of the queries that find something; with a cache, those it knows aren't searched again."""
    answer = lambda q: fusion.assemble_context(retrieve(q, corpus, options, **models), ["query_id"]).withColumn("cached", F.lit(False))
    if cache is None:
        return answer(queries)
    known = queries.sparkSession.createDataFrame(cache.items(), "query string, context string")
    hits = queries.join(F.broadcast(known), "query").select("query_id", "context", F.lit(True).alias("cached"))  # max_entries at most
    missed = queries.join(F.broadcast(known), "query", "left_anti")
    checkpoints(queries.sparkSession)
    fresh = answer(missed).checkpoint()
    for row in fresh.join(missed.select("query_id", "query"), "query_id").select("query", "context").limit(cache.max_entries).toLocalIterator():
        cache.put(row["query"], row["context"])
    return hits.unionByName(fresh)
