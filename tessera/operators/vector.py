"""Exhaustive vector search by inner product, in blocks of queries."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoints, ship

#: Query rows that are sent to all tasks at once; more are searched block by block, a pass over the corpus each.
MOST_QUERIES = 8192
#: Vectors that a task multiplies at once, however many an Arrow batch has.
ROWS = 1024


def in_blocks(rows: DataFrame, by: list[str], most: int) -> Iterator[list]:
    """rows, collected in lists of about `most`; mostly there is one."""
    held = rows.limit(most + 1).collect()
    if len(held) <= most:
        yield held
        return
    blocks = math.ceil(rows.count() / most)
    for b in range(blocks):
        yield rows.where(F.pmod(F.xxhash64(*by), F.lit(blocks)) == b).collect()


def _score_scale(score, scale: str):
    return score if scale == "raw" else (score + 1) / 2


class Best:
    """The n best chunks of each query, as a task goes through its batches: by score, ties by chunk.  What it holds doesn't grow with the chunks."""

    def __init__(self, queries: int, n: int):
        self.n, self.limit, self.held, self.rows = n, np.full(queries, -np.inf), [], 0

    def add(self, scores: np.ndarray, chunks: pa.Array, first: int = 0) -> None:
        """scores: a row per query from `first` on, a column per chunk; -inf is no score."""
        upto = first + len(scores)
        if scores.shape[1] > self.n:
            cut = -np.partition(-scores, self.n - 1, axis=1)[:, self.n - 1 : self.n]  # ties at the cut all stay
            i, j = np.nonzero((scores > -np.inf) & (scores >= cut) & (scores >= self.limit[first:upto, None]))
        else:
            i, j = np.nonzero((scores > -np.inf) & (scores >= self.limit[first:upto, None]))
        if len(i):
            self.held.append(pa.table([pa.array(i + first, pa.int32()), chunks.take(pa.array(j)), pa.array(scores[i, j], pa.float64())], names=["_n", "chunk_id", "score"]))
            self.rows += len(i)
        if self.rows > 2 * self.n * len(self.limit) + 100_000:
            self._cut()

    def _cut(self) -> pa.Table:
        found = pa.concat_tables(self.held)
        found = found.take(pc.sort_indices(found, [("_n", "ascending"), ("score", "descending"), ("chunk_id", "ascending")])).combine_chunks()
        query = found.column("_n").to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.n - 1
        self.limit[query[last]] = found.column("score").to_numpy()[last]
        found = found.filter(pa.array(place < self.n))
        self.held, self.rows = [found], found.num_rows
        return found

    def batches(self) -> list[pa.RecordBatch]:
        return self._cut().to_batches(max_chunksize=1 << 16) if self.held else []


def _found(held: list, ids: list[str], kinds: str, corpus: DataFrame, n: int, min_score: float, score_scale: str) -> DataFrame:
    """(ids, chunk_id, score) of each task's n best for the queries held."""
    spark = corpus.sparkSession
    ship(spark)
    width = len(held[0]["vector"]) if held else 0
    matrix = spark.sparkContext.broadcast(np.array([r["vector"] for r in held], np.float64))  # about MOST_QUERIES rows

    def products(batches):
        q = matrix.value
        best = Best(len(q), n)
        for whole in batches:
            for start in range(0, whole.num_rows if len(q) and n > 0 else 0, ROWS):
                batch = whole.slice(start, ROWS)
                v = batch.column("vector")
                x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                for at in range(0, len(q), 512):
                    s = np.round(q[at : at + 512] @ x.T, 6)
                    best.add(np.where(_score_scale(s, score_scale) >= min_score, s, -np.inf), batch.column("chunk_id"), at)
        yield from best.batches()

    kind = corpus.schema["chunk_id"].dataType.simpleString()
    found = corpus.where(F.size("vector") == width).select("chunk_id", "vector").mapInArrow(products, f"_n int, chunk_id {kind}, score double")
    names = spark.createDataFrame([(k, *(r[c] for c in ids)) for k, r in enumerate(held)], "_n int, " + kinds)
    return found.join(names, "_n").drop("_n")


def search(queries: DataFrame, corpus: DataFrame, n: int, min_score: float = 0.2, score_scale: str = "raw", id_cols: list[str] | None = None) -> DataFrame:
    """(ids, chunk_id, score, rank): the n best of corpus (chunk_id, vector) for each query (ids, vector).

    score_scale tells what min_score is compared with: the inner product s ("raw") or (s+1)/2 ("unit").  Ties go
    to the smaller chunk.  Every task multiplies its vectors, ROWS at once, with the broadcast queries, MOST_QUERIES at once, and
    gives each query's n best only, so what is shuffled doesn't grow with the corpus' rows times queries.  A query only meets vectors
    of its own length.
    """
    ids = id_cols or ["query_id"]
    asked = queries.where("vector is not null").select(*ids, "vector")
    kinds = ", ".join(f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in ids)
    alike = lambda held: [[r for r in held if len(r["vector"]) == w] for w in sorted({len(r["vector"]) for r in held})] or [held]
    parts, blocks = [], 0
    checkpoints(queries.sparkSession)
    for held in in_blocks(asked, ids, MOST_QUERIES):
        if (blocks := blocks + 1) == 2:  # from here on the driver holds one block
            parts = [p.checkpoint() for p in parts]
        found = [_found(part, ids, kinds, corpus, n, min_score, score_scale) for part in alike(held)]
        parts += found if blocks == 1 else [p.checkpoint() for p in found]
    pairs = reduce(DataFrame.unionByName, parts)
    best = Window.partitionBy(*ids).orderBy(F.desc("score"), "chunk_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(n, 0)).select(*ids, "chunk_id", "score", "rank")
