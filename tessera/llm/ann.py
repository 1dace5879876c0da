"""Nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Equal vectors are indexed once and carry their smallest distinct ids (one more than k, which is all that k places
can show).  Distinct vectors are dealt into shards; each shard's graph is one row of flat arrays.  Queries are
dealt into blocks of thousands, and each block meets each shard's row, one pair at a time, so a worker holds one graph
and one block; a graph is copied once per block.  Shard results are merged by rank.

Largest inner product becomes nearest direction by one more coordinate that brings all vectors of a shard
to one length.  A node's links are chosen as the usual heuristic does among its nearest earlier nodes of a
layer (found by blocked products, as a shard is bounded), with links back that are pruned to the layer's
limit.  Scores are exact inner products of the original vectors in double precision.

Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do null ids;
vectors of one length only meet their like.  Ties go to the smaller id.  Rows that repeat an id and its vector count once; an
id with several vectors is ranked by each of them, and its query is searched with each.  Empty tables give no rows, other columns aren't read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SHARD_ROWS = 65_536
#: Bytes of a shard's vectors, on average: they are one cell.
SHARD_BYTES = 64 << 20
#: Shards at least, so that small tables use several workers.
SHARDS = 8
LINKS = 16
REACH = 96
BLOCK = 4096


def _levels(n: int, links: int) -> np.ndarray:
    """Layer of each node by its number, geometric as usual, from a fixed seed."""
    u = np.random.default_rng(17).random(n)
    return np.minimum((-np.log(1 - u) / math.log(links)).astype(np.int64), 12)


def _unit(x: np.ndarray) -> np.ndarray:
    """Directions whose order by cosine with (q, 0) is that of the inner products with q."""
    square = np.einsum("ij,ij->i", x, x)
    rest = np.sqrt(np.maximum(square.max(initial=0.0) - square, 0.0))
    return (np.c_[x, rest] / max(math.sqrt(square.max(initial=0.0)), 1e-300)).astype(np.float32)


class Graph:
    """links[layer]: (nodes, limit) array of neighbours, -1 where there is none; nodes of upper layers by `slot`."""

    def __init__(self, unit: np.ndarray, level: np.ndarray, links: list[np.ndarray], limit: int):
        self.unit, self.level, self.links, self.limit = unit, level, links, limit
        self.members = [np.flatnonzero(level >= k) for k in range(len(links))]
        self.slot = []
        for m in self.members:
            s = np.full(len(level), -1, np.int64)
            s[m] = np.arange(len(m))
            self.slot.append(s)

    @staticmethod
    def build(unit: np.ndarray, limit: int = LINKS, reach: int = 64) -> Graph:
        level = _levels(len(unit), limit)
        top = int(level.max(initial=0))
        return Graph(unit, level, [_layer(unit, np.flatnonzero(level >= k), limit * 2 if k == 0 else limit, limit, reach) for k in range(top + 1)], limit)

    def search(self, q: np.ndarray, reach: int) -> list[tuple[float, int]]:
        """The nodes found nearest, best first."""
        at = int(self.members[-1][0])
        best = float(self.unit[at] @ q)
        for k in range(len(self.links) - 1, 0, -1):
            while True:
                near = self.links[k][self.slot[k][at]]
                near = near[near >= 0]
                if not len(near):
                    break
                s = self.unit[near] @ q
                i = int(s.argmax())
                if s[i] <= best:
                    break
                at, best = int(near[i]), float(s[i])
        seen = np.zeros(len(self.unit), bool)
        seen[at] = True
        todo, found = [(-best, at)], [(best, at)]
        links, unit = self.links[0], self.unit
        while todo:
            s, c = heapq.heappop(todo)
            if len(found) >= reach and -s < found[0][0]:
                break
            near = links[c]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for s, i in zip((unit[near] @ q).tolist(), near.tolist()):
                if len(found) < reach:
                    heapq.heappush(found, (s, i))
                    heapq.heappush(todo, (-s, i))
                elif s > found[0][0]:
                    heapq.heapreplace(found, (s, i))
                    heapq.heappush(todo, (-s, i))
        return sorted(found, reverse=True)


def _choose(order: np.ndarray, sims: np.ndarray, unit: np.ndarray, limit: int) -> list[int]:
    """The heuristic: a candidate is linked unless it is nearer to one already linked; the nearest fill up."""
    among = unit[order] @ unit[order].T
    taken: list[int] = []
    for i in range(len(order)):
        if len(taken) == limit:
            break
        if not taken or among[i, taken].max() < sims[i]:
            taken.append(i)
    if len(taken) < limit:
        chosen = set(taken)
        rest = [i for i in range(len(order)) if i not in chosen]
        taken += rest[: limit - len(taken)]
    return order[taken].tolist()


def _layer(unit: np.ndarray, nodes: np.ndarray, room: int, limit: int, reach: int) -> np.ndarray:
    """Links of a layer: each node to earlier ones, and back."""
    x, n = unit[nodes], len(nodes)
    out: list[list[int]] = [[] for _ in range(n)]
    for a in range(0, n, 256):
        b = min(n, a + 256)
        sims = x[a:b] @ x[:b].T
        sims[np.arange(a, b)[:, None] <= np.arange(b)[None, :]] = -np.inf
        wide = min(reach, b)
        part = np.argpartition(-sims, wide - 1, axis=1)[:, :wide] if wide < b else np.tile(np.arange(b), (b - a, 1))
        for i in range(a, b):
            near = part[i - a]
            s = sims[i - a, near]
            order = np.argsort(-s, kind="stable")
            order = order[s[order] > -np.inf]
            if len(order):
                out[i] += _choose(near[order], s[order], x, limit)
                for j in out[i][:]:
                    out[j].append(i)
                    if len(out[j]) > 2 * room:
                        out[j] = _prune(j, out[j], x, room)
    table = np.full((n, room), -1, np.int32)
    for i, near in enumerate(out):
        if len(near) > room:
            near = _prune(i, near, x, room)
        table[i, : len(near)] = nodes[near]
    return table


def _prune(i: int, near: list[int], x: np.ndarray, room: int) -> list[int]:
    at = np.array(near)
    s = x[at] @ x[i]
    order = np.argsort(-s, kind="stable")
    return _choose(at[order], s[order], x, room)


def _graph(links: int):
    def run(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        v = C.flat(table["v"])
        x = v.values.to_numpy(zero_copy_only=False)[v.offsets[0].as_py() : v.offsets[-1].as_py()].astype(np.float64).reshape(-1, dim)
        ids = C.flat(table["ids"])
        counts = np.diff(ids.offsets.to_numpy())
        order = np.lexsort((ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]],))  # whatever order the rows came in
        x = x[order]
        lists = ids.to_pylist()
        g = Graph.build(_unit(x), links)
        members = np.array([m for i in order.tolist() for m in sorted(lists[i])], np.int64)
        row = {"dim": [dim], "shard": [table["shard"][0].as_py()], "vectors": [x.tobytes()], "members": [members.tobytes()], "counts": [counts[order].astype(np.int64).tobytes()],
               "level": [g.level.tobytes()], "links": [[a.tobytes() for a in g.links]]}
        return pa.table(row, schema=_GRAPH_ARROW)

    return run


_GRAPH = "dim int, shard int, vectors binary, members binary, counts binary, level binary, links array<binary>"
_GRAPH_ARROW = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("vectors", pa.binary()), ("members", pa.binary()), ("counts", pa.binary()), ("level", pa.binary()), ("links", pa.list_(pa.binary()))])


def _search(k: int, links: int, reach: int):
    def run(batches):
        held, graph = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                dim, shard = row["dim"].as_py(), row["shard"].as_py()
                if held != (dim, shard):
                    x = np.frombuffer(row["vectors"].as_py(), np.float64).reshape(-1, dim)
                    counts = np.frombuffer(row["counts"].as_py(), np.int64)
                    members, upto = np.frombuffer(row["members"].as_py(), np.int64), np.cumsum(counts)
                    graph = Graph(_unit(x), np.frombuffer(row["level"].as_py(), np.int64),
                                  [np.frombuffer(b, np.int32).reshape(-1, links * 2 if i == 0 else links) for i, b in enumerate(row["links"].as_py())], links)
                    held = (dim, shard)
                out: list[tuple[int, int, float]] = []
                for q_id, q in zip(row["q_ids"].as_py(), row["q_vectors"].as_py()):
                    q = np.array(q, np.float64)
                    direction = np.append(q / np.linalg.norm(q), 0.0).astype(np.float32)
                    nodes = np.array([i for _, i in graph.search(direction, max(reach, k + 1))], np.int64)
                    exact = x[nodes] @ q
                    got: list[tuple[float, int]] = []
                    for i in np.argsort(-exact, kind="stable").tolist():
                        if len(got) > k and exact[i] < got[k][0]:
                            break
                        n = nodes[i]
                        got += [(float(exact[i]), m) for m in members[upto[n] - counts[n] : upto[n]].tolist() if m != q_id]
                    got.sort(key=lambda t: (-t[0], t[1]))
                    out += [(q_id, m, s) for s, m in got[:k]]
                cols = list(zip(*out)) or [(), (), ()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "score"])

    return run


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, links: int = LINKS,
            reach: int = REACH, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES, least_shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): for each query row its k nearest rows of df other than itself."""
    spark = df.sparkSession
    C.ship(spark)

    def clean(rows: DataFrame) -> DataFrame:
        v = F.transform(F.col(f"`{vector_col}`"), lambda e: e.cast("double"))
        rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
        fine = F.forall("v", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
        return rows.where(fine & F.exists("v", lambda e: e != 0)).withColumn("dim", F.size("v"))

    place = Window.partitionBy("v").orderBy("id")
    smallest = clean(df).withColumn("n", F.dense_rank().over(place)).where(F.col("n") <= k + 1)  # places of ids, not of rows
    distinct = C.materialise(smallest.groupBy("v", "dim").agg(F.sort_array(F.collect_set("id")).alias("ids")))
    count, components = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("dim").cast("long")), F.lit(0))).first()
    shards = max(least_shards, math.ceil(count / shard_rows), math.ceil(8 * components / shard_bytes))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    graphs = C.materialise(dealt.groupBy("dim", "shard").applyInArrow(_graph(links), _GRAPH))
    asked = clean(queries).distinct()
    blocks = max(1, math.ceil(asked.count() / block))
    dealt_q = asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    packed = dealt_q.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("q"))
    packed = packed.select("dim", "block", F.col("q.id").alias("q_ids"), F.col("q.v").alias("q_vectors"))
    copied = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))  # a key for each pair of block and shard
    each = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(copied, ["dim", "shard", "block"])
    found = each.mapInArrow(_search(k, links, reach), "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
