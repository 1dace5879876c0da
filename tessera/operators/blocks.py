"""Exact BM25 top n that leaves most of the frequent terms' postings unread.

A term's postings lie in cells, one per block of chunks.  A block has some chunks that were counted one after the other, and all their postings,
so it is written by the task that counts them and nothing is shuffled for it.  A term's `top` is the most that it can add to a score.  A search takes three steps:

1.  The postings of each query's rarest terms give scores that chunks reach at least; the n-th of these is the query's threshold.
2.  Of the query's terms those that add least are left aside as long as all of them together stay below the threshold: a chunk that has
    no other term can't be among the best.  The other terms' cells are met whole; chunks that stay below the threshold
    even with all that was left aside are dropped.
3.  Where a block has chunks left, its cells of the terms left aside are met too.

The cells of the terms asked for meet by block, whatever the number of queries, and a task keeps each query's n best only: no pair of a query and a chunk is
shuffled or written but those.  What comes out are the rows of bm25.search, whatever the data; how much is met depends on how far a query's terms differ.  Where a
query has fewer than n chunks its threshold is 0 and everything is met.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship
from . import bm25
from .vector import Best, in_blocks

#: Chunks in a block at most; postings of the rarest terms that set a query's threshold, in multiples of n; numbers that a matrix of a task has at most.
BLOCK_CHUNKS, RARE, NUMBERS = 4096, 64, 1 << 22
#: What a bound may be off by rounding.
_SLACK = 2e-6


@dataclass
class BlockIndex:
    """cells(term, block, postings: array of (chunk_id, tf, dl)), terms(term, df, top) and corpus (one row: n, mean_dl)."""

    cells: DataFrame
    terms: DataFrame
    corpus: DataFrame

    def write(self, path: str) -> BlockIndex:
        """Cells as they are counted, once; the terms are those of what was written."""
        spark = self.cells.sparkSession
        self.cells.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/cells")
        self.corpus.write.mode("overwrite").parquet(f"{path}/corpus")
        _terms(spark.read.parquet(f"{path}/cells"), self.corpus.first()["mean_dl"]).write.mode("overwrite").parquet(f"{path}/terms")
        return BlockIndex.read(spark, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> BlockIndex:
        return BlockIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("cells", "terms", "corpus")))

    def search(self, queries: DataFrame, n: int, id_cols: list[str] | None = None) -> DataFrame:
        return search(self, queries, n, id_cols)


def _part(tf, dl, mean):
    return tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * dl / mean))


def _terms(cells: DataFrame, mean: float) -> DataFrame:
    top = F.array_max(F.transform("postings", lambda p: _part(p.tf, p.dl, F.lit(mean))))
    return cells.select("term", F.size("postings").cast("long").alias("df"), top.alias("top")).groupBy("term").agg(F.sum("df").alias("df"), F.max("top").alias("top"))


def build(index: bm25.Bm25Index, block_chunks: int = BLOCK_CHUNKS) -> BlockIndex:
    """Cells of an index; a block has block_chunks chunks at most."""
    n, mean = index.corpus.select("n", "mean_dl").first()
    mean = mean or 1.0
    spark = index.postings.sparkSession
    ship(spark)

    def cut(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def cells(rows, block):
            term = rows.column("term").combine_chunks().dictionary_encode()
            words, code = term.dictionary.cast(pa.string()), term.indices.to_numpy()
            order, upto = np.argsort(code, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(words)))]).astype(np.int32)
            fields = [rows.column(c).combine_chunks().take(pa.array(order)) for c in ("chunk_id", "tf", "dl")]
            lists = pa.ListArray.from_arrays(pa.array(upto), pa.StructArray.from_arrays(fields, names=["chunk_id", "tf", "dl"]))
            yield from pa.table([words, pa.array(np.full(len(words), block)), lists], names=["term", "block", "postings"]).to_batches(max_chunksize=1 << 14)

        first, nth, held, runs = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held, last = [*held, pa.table(batch)], held[-1].column("chunk_id")[-1].as_py() if held else None
            ids = batch.column("chunk_id")
            runs += pc.sum(pc.not_equal(ids[1:], ids[:-1])).as_py() or 0
            runs += not len(held) > 1 or ids[0].as_py() != last
            if runs > block_chunks:
                rows = pa.concat_tables(held).combine_chunks()
                ids = rows.column("chunk_id").combine_chunks()
                starts = np.concatenate([[0], 1 + np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))])
                whole = (len(starts) - 1) // block_chunks  # the last chunk may go on
                for k in range(whole):
                    yield from cells(rows.slice(starts[k * block_chunks], starts[(k + 1) * block_chunks] - starts[k * block_chunks]), first + nth)
                    nth += 1
                held, runs = [rows.slice(starts[whole * block_chunks])], len(starts) - whole * block_chunks
        if held:
            yield from cells(pa.concat_tables(held).combine_chunks(), first + nth)

    postings = index.postings if index.together else index.postings.repartition("chunk_id").sortWithinPartitions("chunk_id")
    kind = postings.schema["chunk_id"].dataType.simpleString()
    cells = postings.select("chunk_id", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"), "term").mapInArrow(cut, f"term string, block long, postings array<struct<chunk_id: {kind}, tf: int, dl: int>>")
    return BlockIndex(cells, _terms(cells, mean), spark.createDataFrame([(n, mean)], "n long, mean_dl double"))


@dataclass
class _Asked:
    """A query's terms, as places in the vocabulary, with their idf; which set the threshold and which are left aside."""

    place: np.ndarray
    idf: np.ndarray
    first: np.ndarray
    lesser: np.ndarray
    limit: float = 0.0

    @property
    def aside(self) -> np.ndarray:
        return self.lesser < self.limit


def _asked(held: bm25.Held, index: BlockIndex, total: int, n: int) -> list[_Asked]:
    own = {r["place"]: (r["df"], r["top"]) for r in index.terms.join(F.broadcast(held.places()), "term").select("place", "df", "top").collect()}  # a row per term asked for
    place = {w: i for i, w in enumerate(held.vocabulary)}
    out = []
    for row in held.rows:
        places = np.array([p for p in sorted(place[t] for t in set(row["terms"])) if p in own], np.int64)
        df, top = (np.array([own[p][k] for p in places.tolist()], np.float64) for k in (0, 1))
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
        rarer, lesser, rare, least = np.zeros(len(df)), np.zeros(len(df)), np.argsort(df, kind="stable"), np.argsort(idf * top, kind="stable")
        rarer[rare] = np.cumsum(df[rare]) - df[rare]
        lesser[least] = np.cumsum((idf * top)[least])
        # as many of the rarest terms as give enough chunks, and more as long as they are cheap
        out.append(_Asked(places, idf, (rarer < 2 * n) | (rarer + df <= RARE * n), lesser))
    return out


def _groups(asked: list[_Asked], which, most: int) -> list[tuple]:
    """Queries in groups whose matrix of weights has `most` numbers: (first query, places, weights of the terms met whole, weights of those left aside)."""
    out, at = [], 0
    while at < len(asked):
        end, words = at + 1, set(asked[at].place.tolist())
        while end < len(asked) and (end + 1 - at) * len(words | set(asked[end].place.tolist())) <= most:
            words |= set(asked[end].place.tolist())
            end += 1
        places = np.array(sorted(words), np.int64)
        whole, aside = np.zeros((end - at, len(places))), np.zeros((end - at, len(places)))
        for k, q in enumerate(asked[at:end]):
            here, use = np.searchsorted(places, q.place), which(q)
            whole[k, here[use]] = q.idf[use]
            aside[k, here[q.aside]] = q.idf[q.aside]
        out.append((at, places, whole, aside))
        at = end
    return out


def _blocks(batches):
    """(places, sizes, chunk ids, tf, dl) of each block, whose cells follow one another."""
    import pyarrow as pa

    held = []

    def of(tables):
        rows = pa.concat_tables(tables).combine_chunks()
        lists = rows.column("postings").combine_chunks()
        p = lists.flatten()
        return (rows.column("place").to_numpy(), np.diff(lists.offsets.to_numpy()), *(p.field(c) for c in ("chunk_id", "tf", "dl")))

    for batch in batches:
        block = batch.column("block").to_numpy()
        ends = [*(1 + np.flatnonzero(block[1:] != block[:-1])).tolist(), batch.num_rows] if batch.num_rows else []
        at = 0
        for end in ends:
            if held and held[-1].column("block")[-1].as_py() != block[at]:
                yield of(held)
                held = []
            held.append(pa.table(batch.slice(at, end - at)))
            at = end
    if held:
        yield of(held)


def _pass(index: BlockIndex, held: bm25.Held, asked: list[_Asked], mean: float, n: int, first: bool, counts: bool = False) -> DataFrame:
    """(_n, chunk_id, score) of each task's n best of the queries held: by the terms that set thresholds (first), or by all; or the (met, cells) of each task."""
    spark, which = held.spark, (lambda q: q.first) if first else (lambda q: ~q.aside)
    needed = sorted({p for q in asked for p in (q.place[q.first] if first else q.place).tolist()})
    places = spark.createDataFrame([(held.vocabulary[p], p) for p in needed], "term string, place int")
    numbers, shared = NUMBERS, spark.sparkContext.broadcast(asked)  # of about MOST_QUERIES queries

    def score(batches):
        import pyarrow as pa

        asked = shared.value
        groups, best, met, cells = _groups(asked, which, numbers), Best(len(asked), n), 0, 0
        limit = np.array([q.limit for q in asked])
        most = np.array([q.lesser[q.aside].max(initial=0.0) for q in asked])
        for place, sizes, ids, tf, dl in _blocks(batches):
            coded = ids.dictionary_encode()
            owner, names = coded.indices.to_numpy(), coded.dictionary
            row = np.repeat(np.arange(len(place)), sizes)
            part = _part(tf.to_numpy(), dl.to_numpy(), mean)
            opened = np.zeros(len(asked), bool)
            wide = max(1, numbers // max(1, len(place)))
            for lo in range(0, len(names), wide):
                some = (owner >= lo) & (owner < lo + wide)
                values = np.zeros((len(place), min(wide, len(names) - lo)))
                values[row[some], owner[some] - lo] = part[some]
                for at, words, whole, aside in groups:
                    here = np.minimum(np.searchsorted(words, place), len(words) - 1) if len(words) else np.zeros(len(place), int)
                    has = words[here] == place if len(words) else np.zeros(len(place), bool)
                    mine = slice(at, at + len(whole))
                    s = whole[:, here[has]] @ values[has]
                    if not first:
                        near = (s > 0) & (s + most[mine, None] >= limit[mine, None])
                        look = near.any(axis=1) & (most[mine] > 0)
                        opened[mine] |= look
                        if look.any():
                            s[look] += aside[look][:, here[has]] @ values[has]
                        s = np.where(near, np.round(s, 6), 0.0)
                    s[s <= 0] = -np.inf
                    best.add(s, names.slice(lo, wide), at)
            if counts:
                there = [np.isin(q.place, place) for q in asked]
                cells += sum(int(t.sum()) for t in there)
                met += sum(int((t if o else t & (~q.aside | q.first)).sum()) for q, t, o in zip(asked, there, opened))
        if counts:
            yield pa.record_batch([pa.array([met], pa.int64()), pa.array([cells], pa.int64())], names=["met", "cells"])
        else:
            yield from best.batches()

    kind = index.cells.schema["postings"].dataType.elementType["chunk_id"].dataType.simpleString()
    own = index.cells.join(F.broadcast(places), "term").select("block", "place", "postings").repartition("block").sortWithinPartitions("block")  # places: a row per term asked for
    return own.mapInArrow(score, "met long, cells long" if counts else f"_n int, chunk_id {kind}, score double")


def _limited(index: BlockIndex, held: bm25.Held, n: int) -> tuple[list[_Asked], float]:
    """The queries' terms with the thresholds that their rarest ones set, and the chunks' mean length."""
    ship(held.spark)
    total, mean = index.corpus.select("n", "mean_dl").first()
    asked = _asked(held, index, total, n)
    nth = F.row_number().over(Window.partitionBy("_n").orderBy(F.desc("score")))
    for r in _pass(index, held, asked, mean, n, True).withColumn("nth", nth).where(F.col("nth") == n).select("_n", "score").collect():  # a row per query
        asked[r["_n"]].limit = max(0.0, r["score"] - _SLACK)
    return asked, mean


def search(index: BlockIndex, queries: DataFrame, n: int, id_cols: list[str] | None = None) -> DataFrame:
    """As bm25.search: (ids, chunk_id, score, rank) of the n best per query; scores to six decimals, ties by chunk."""
    ids = id_cols or ["query_id"]

    def found(held: bm25.Held) -> DataFrame:
        asked, mean = _limited(index, held, max(n, 1))
        return held.named(_pass(index, held, asked, mean, max(n, 1), False))

    return bm25.ranked(queries, ids, n, found)


def cells_read(index: BlockIndex, queries: DataFrame, n: int, id_cols: list[str] | None = None) -> DataFrame:
    """One row: pairs of a query and a cell of its terms that a search meets, and all such pairs."""
    ids = id_cols or ["query_id"]
    rows = queries.select(*ids, F.array_distinct(T.tokenize(F.col("query"))).alias("terms"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ids)
    met = cells = 0
    for some in in_blocks(rows, ids, bm25.MOST_QUERIES):
        held = bm25.Held(queries.sparkSession, some, ids, kinds)
        asked, mean = _limited(index, held, max(n, 1))
        for r in _pass(index, held, asked, mean, max(n, 1), False, True).collect():  # a row per task
            met, cells = met + r["met"], cells + r["cells"]
    return queries.sparkSession.createDataFrame([(met, cells)], "cells_read long, cells long")
