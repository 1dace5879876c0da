"""Exact vector search by inner product that leaves out what can't be among the best.

Vectors lie in balls: each belongs to the nearest of some centres, and a ball has its centre c, its radius r (the largest distance of
one of its vectors from c) and its size.  No vector of a ball has a larger inner product with q than q.c + |q| r.  A search first
reads, for each query, the balls of the largest bounds until these hold n vectors; the n-th best score there is the query's
threshold, and of the other balls only those whose bound reaches it are read.  The rows are those of vector.search, whatever
the centres; how much is read depends on how far apart the balls lie.

Queries are taken in blocks of vector.MOST_QUERIES; a block's results are checkpointed before the next is collected, so the driver holds
one block.  Centres are a bounded sample of the vectors (`most_centres`), the rest is assigned by tasks.  Queries only meet
vectors of the index's length; null vectors aren't indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoints, ship
from . import vector

#: What a bound may be off by rounding, as a share of |q| times the largest length there.
_SLACK = 1e-9
_ROUNDED = 1e-6


@dataclass
class BallIndex:
    """vectors(ball, chunk_id, vector) and balls(ball, centre, radius, size)."""

    vectors: DataFrame
    balls: DataFrame

    def write(self, path: str) -> BallIndex:
        """Vectors sorted by ball, so that a search reads only row groups of its balls."""
        self.vectors.repartitionByRange("ball").sortWithinPartitions("ball").write.mode("overwrite").parquet(f"{path}/vectors")
        self.balls.write.mode("overwrite").parquet(f"{path}/balls")
        return BallIndex.read(self.vectors.sparkSession, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> BallIndex:
        return BallIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("vectors", "balls")))

    def search(self, queries: DataFrame, n: int, min_score: float = 0.2, score_scale: str = "raw", id_cols: list[str] | None = None) -> DataFrame:
        return search(self, queries, n, min_score, score_scale, id_cols)


def build(corpus: DataFrame, most_centres: int = 1024) -> BallIndex:
    """An index of corpus (chunk_id, vector), of the vectors of the length that most have; corpus should be written, as it is read three times."""
    spark = corpus.sparkSession
    ship(spark)
    checkpoints(spark)
    common = corpus.where("vector IS NOT NULL").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    width = common["d"] if common else 0
    rows = corpus.where(F.size("vector") == width).select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    centres = min(most_centres, math.ceil(math.sqrt(common["count"]))) if common else 0
    sample = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(centres).collect()  # most_centres at most
    shared = spark.sparkContext.broadcast(np.array([r["vector"] for r in sample]).reshape(len(sample), width))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            ball = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            away = np.sqrt(((x - c[ball]) ** 2).sum(1))
            yield pa.record_batch([pa.array(ball.astype(np.int32)), batch.column("chunk_id"), batch.column("vector"), pa.array(away)], names=["ball", "chunk_id", "vector", "away"])

    kind = rows.schema["chunk_id"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"ball int, chunk_id {kind}, vector array<double>, away double").checkpoint()
    places = spark.createDataFrame([(i, r["vector"]) for i, r in enumerate(sample)], "ball int, centre array<double>")
    sizes = placed.groupBy("ball").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("size"))
    return BallIndex(placed.drop("away"), places.join(sizes, "ball"))


def _scores(index: BallIndex, q: np.ndarray, wanted: np.ndarray, n: int) -> DataFrame:
    """(_n, chunk_id, score): each Arrow batch's n best for the queries q, of the balls that wanted (query, ball) names."""
    spark = index.vectors.sparkSession
    balls = np.flatnonzero(wanted.any(0))
    shared = spark.sparkContext.broadcast((q, {int(b): np.flatnonzero(wanted[:, b]) for b in balls}))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, asked = shared.value
        for batch in batches:
            ball = batch.column("ball").to_numpy()
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for b in np.unique(ball):
                who, own = asked[int(b)], np.flatnonzero(ball == b)
                s = np.round(q[who] @ x[own].T, 6)
                if s.shape[1] > n:
                    cut = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]  # ties at the cut all stay
                    s = np.where(s >= cut, s, -np.inf)
                i, j = np.nonzero(s > -np.inf)
                yield pa.record_batch([pa.array(who[i], pa.int32()), batch.column("chunk_id").take(pa.array(own[j])), pa.array(s[i, j])], names=["_n", "chunk_id", "score"])

    kind = index.vectors.schema["chunk_id"].dataType.simpleString()
    return index.vectors.where(F.col("ball").isin([int(b) for b in balls])).mapInArrow(products, f"_n int, chunk_id {kind}, score double")


def _block(index: BallIndex, held: list, n: int) -> tuple[DataFrame, int, int]:
    """(_n, chunk_id, score) of a block's queries; pairs of a query and a ball that were read, and all such pairs."""
    q = np.array([r["vector"] for r in held], np.float64)
    balls = index.balls.collect()  # most_centres at most
    centre, ball = np.array([b["centre"] for b in balls]), np.array([b["ball"] for b in balls])
    radius, size = np.array([b["radius"] for b in balls]), np.array([b["size"] for b in balls])
    length = np.sqrt((q * q).sum(1))
    bound = q @ centre.T + length[:, None] * radius + _SLACK * length[:, None] * (np.sqrt((centre * centre).sum(1)) + radius) + _ROUNDED
    order = np.argsort(-bound, axis=1)
    before = np.cumsum(size[order], axis=1) - size[order]
    first = np.zeros(bound.shape, bool)
    np.put_along_axis(first, order, before < n, axis=1)
    width = int(ball.max()) + 1

    def spread(flags: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), width), bool)
        out[:, ball] = flags
        return out

    found = _scores(index, q, spread(first), n).checkpoint()
    nth = F.row_number().over(Window.partitionBy("_n").orderBy(F.desc("score")))
    limit = np.full(len(q), -np.inf)
    for r in found.withColumn("nth", nth).where(F.col("nth") == n).select("_n", "score").collect():  # a row per query of the block
        limit[r["_n"]] = r["score"]
    more = ~first & (bound >= limit[:, None])
    if more.any():
        found = found.unionByName(_scores(index, q, spread(more), n)).checkpoint()
    return found, int(first.sum() + more.sum()), int(first.size)


def _searched(index: BallIndex, queries: DataFrame, n: int, ids: list[str]) -> tuple[list[DataFrame], int, int]:
    spark, parts, read, every = queries.sparkSession, [], 0, 0
    ship(spark)
    checkpoints(spark)
    one = index.balls.select(F.size("centre")).first()
    asked = queries.where(F.size("vector") == (one[0] if one else -1)).select(*ids, "vector")
    kinds = ", ".join(f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in ids)
    for held in vector.in_blocks(asked, ids, vector.MOST_QUERIES):
        if held:
            found, a, b = _block(index, held, n)
            names = spark.createDataFrame([(k, *(r[c] for c in ids)) for k, r in enumerate(held)], "_n int, " + kinds)
            parts.append(found.join(names.hint("merge"), "_n").drop("_n"))
            read, every = read + a, every + b
    return parts or [asked.select(*ids).limit(0).crossJoin(index.vectors.select("chunk_id").limit(0)).withColumn("score", F.lit(0.0))], read, every


def search(index: BallIndex, queries: DataFrame, n: int, min_score: float = 0.2, score_scale: str = "raw", id_cols: list[str] | None = None) -> DataFrame:
    """As vector.search: (ids, chunk_id, score, rank) of the n best for each query (ids, vector)."""
    ids = id_cols or ["query_id"]
    pairs = reduce(DataFrame.unionByName, _searched(index, queries, max(n, 1), ids)[0])
    score = F.col("score") if score_scale == "raw" else (F.col("score") + 1) / 2
    best = Window.partitionBy(*ids).orderBy(F.desc("score"), "chunk_id")
    return pairs.where(score >= min_score).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(n, 0)).select(*ids, "chunk_id", "score", "rank")


def pairs_read(index: BallIndex, queries: DataFrame, n: int, id_cols: list[str] | None = None) -> tuple[int, int]:
    """Pairs of a query and a ball that a search reads, and all such pairs."""
    return _searched(index, queries, max(n, 1), id_cols or ["query_id"])[1:]
