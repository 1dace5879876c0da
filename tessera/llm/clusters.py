"""Centroid clustering by plain Lloyd rounds, in integers.

Components become integers, so distances and sums are exact: results don't hang on the order in which partitions are
added up.  Each round broadcasts the centroids (clusters x dimensions longs, whatever the input), mapInPandas takes the
integer squared differences of a batch to one centroid after the other in NumPy, argmin takes the lowest index among
equals, and every partition gives one sum per cluster; these merge through a groupBy.  The driver receives clusters x
dimensions sums a round.  A round that moves nothing ends the rounds, as all later ones would repeat it.

The integer vectors are written once (Parquet keeps small integers in fewer bytes than the floats they come from) and read
once a round.  A cluster that holds any share of the rows is a sum per partition like any other.

Nulls, ties and odd rows: vectors that are null, of another number of dimensions, or hold a null, infinite, NaN or huge
(common.HUGE) component give no row.  A null id is kept; its vector comes last as a start.  Starts with one hash (repeated ids) are
ordered by their vectors, so reruns agree; repeated rows are vectors of their own.  Fewer vectors than clusters: as many clusters as
vectors.  An empty table gives no rows.  A distance beyond a long is null, and so are the sums that it belongs to.  Other
columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_LONG = (1 << 63) - 1


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, exact: longs, or Python integers where a long might not do."""
    limit, out = math.isqrt(_LONG // max(1, x.shape[1])), []
    for c in centroids:
        d = x - c
        if max(-int(d.min(initial=0)), int(d.max(initial=0))) > limit:
            d = d.astype(object)
        out.append((d * d).sum(axis=1))
    return np.stack(out, axis=1)


def _matrix(pdf: pd.DataFrame, dimensions: int) -> np.ndarray:
    return np.stack(pdf["x"].to_numpy()).astype(np.int64) if len(pdf) else np.zeros((0, dimensions), np.int64)


def _move(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    held, dimensions = rows.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(len(held.value), np.int64), np.zeros(held.value.shape, object)
        for pdf in batches:
            x = _matrix(pdf, dimensions)
            own = distances(x, held.value).argmin(axis=1)
            n += np.bincount(own, minlength=len(n))
            for k in np.unique(own):
                total[k] += C.exact_sum(x[own == k])
        seen = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": seen.astype(np.int32), "n": n[seen], "sums": [[Decimal(int(v)) for v in total[k]] for k in seen]})

    parts = rows.select("x").mapInPandas(sums, "cluster int, n long, sums array<decimal(38,0)>")
    merged = parts.select("cluster", "n", F.posexplode("sums").alias("j", "s")).groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = centroids.copy()
    for r in merged.collect():  # clusters x dimensions
        out[r["cluster"], r["j"]] = int(r["s"]) // r["n"]
    held.destroy()
    return out


def lloyd(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", clusters: int = 8, rounds: int = 10, dimensions: int = 64,
          scale: int = 1024, seed: str = "3") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of each vector of so many dimensions.

    Components are floor(scale * component).  Centroids start as the vectors with the least sha256 of 'seed:id', and after each
    round are the floors of their vectors' means; an empty one stays.  distance is squared; cluster_inertia and inertia are its sums
    over the cluster and over all; centroid (array<long>) is the cluster's last one.
    """
    C.ship(df.sparkSession)
    kind = df.schema[id_col].dataType
    rows = C.materialise(C.whole_vectors(df.where(F.size(f"`{vec_col}`") == dimensions), id_col, vec_col, scale))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = rows.orderBy(rank.asc_nulls_last(), "x").limit(clusters).select("x").collect()
    centroids = np.array([r["x"] for r in starts], np.int64).reshape(len(starts), dimensions)
    if not len(centroids):
        return rows.select("id", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid", "array<long>"))])
    for _ in range(rounds):
        moved = _move(rows, centroids)
        if (moved == centroids).all():
            break
        centroids = moved

    held = df.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = distances(_matrix(pdf, dimensions), held.value)
            own = d.argmin(axis=1)
            least = d[np.arange(len(d)), own]
            if d.dtype == object:
                least = pd.array([v if v <= _LONG else None for v in least], "Int64")
            yield pd.DataFrame({"id": pdf["id"], "cluster": own.astype(np.int32), "distance": least})

    # ids pass as strings, as pandas has no longs with nulls
    found = C.materialise(rows.select(F.col("id").cast("string").alias("id"), "x").mapInPandas(assign, "id string, cluster int, distance long"))
    known = F.count("distance") == F.count(F.lit(1))
    own = found.groupBy("cluster").agg(F.when(known, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()  # a row per cluster
    every = None if any(r["s"] is None for r in own) else sum(int(r["s"]) for r in own)
    long = lambda v: int(v) if v is not None and v <= _LONG else None
    facts = df.sparkSession.createDataFrame([(r["cluster"], long(r["s"]), long(every), centroids[r["cluster"]].tolist()) for r in own],
                                            "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").cast(kind).alias("id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # facts: a row per cluster
