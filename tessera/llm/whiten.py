"""Embedding whitening by a randomised range finder.

Components become integers x = floor(scale * c) + offset; V is their covariance (divisor n).  A random subspace of the
components asked for and some more (oversampling) is multiplied by V again and again: each pass sends the
orthonormal basis Q to all partitions, which centre their rows and give C'(C Q), a matrix of dimensions x subspace; the
sums of these over the partitions are V Q.  Rayleigh-Ritz on Q'V Q gives approximate components and, from the same pass,
their residuals.  If these aren't near double precision after the given number of passes, which a slowly falling spectrum
allows, the subspace is expanded to all dimensions: one more pass then gives V itself.

Rows are centred before anything is multiplied: by the whole part of the mean in integers, then by its fraction, so a
large offset costs no digits.  Counts and sums are exact integers.  What passes through the driver are matrices of dimensions x
subspace, at most dimensions x dimensions, however many rows there are; all else stays in partitions, each of which adds up before it
sends.  The integer vectors are written once and read once a pass.

Nulls, ties and odd rows: vectors that are null or hold a null, infinite, NaN or huge (common.HUGE) component are dropped.  The
vectors of the length that most have are fitted and whitened (of equally frequent lengths, the greater); others give no row.
Equal eigenvalues: any basis of their space is right; which one comes may hang on the order of sums, as the last digits do.  Signs make each
component's largest entry positive.  Components without variance (e of at most RANK x trace) can't be whitened and give no
rows: one vector, or equal ones, or an empty table give none.  Repeated rows and ids, and null ids, are rows of their own.  A
deviation beyond a long is null.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Share of the trace up to which an eigenvalue counts as zero.
RANK = 1e-13
#: Numbers in a row of a partition's matrix, as it is merged.
WIDE = 64
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums; the columns of axes are unit components of their covariance, values its eigenvalues, trace its trace."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    expanded: bool

    @property
    def shift(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)


def _x(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dimensions)


def _added(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], dimensions: int) -> np.ndarray:
    """The sum over all rows of a matrix that `part` makes from a batch of x."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(_x(batch, dimensions))
        flat = np.zeros(-(-total.size // WIDE) * WIDE)
        flat[: total.size] = total.ravel()
        cells = pa.array(flat.reshape(-1, WIDE).tolist(), pa.list_(pa.float64()))
        yield pa.record_batch([pa.array(np.arange(len(cells)), pa.int32()), cells], names=["cell", "v"])

    parts = rows.select("x").mapInArrow(run, "cell int, v array<double>")
    merged = parts.groupBy("cell").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(WIDE)]).alias("v"))
    flat = np.zeros(-(-shape[0] * shape[1] // WIDE) * WIDE)
    for r in merged.collect():  # shape, however many rows
        flat[r["cell"] * WIDE : (r["cell"] + 1) * WIDE] = r["v"]
    return flat[: shape[0] * shape[1]].reshape(shape)


def _sums(rows: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the sum of each component; exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dimensions, object)
        for batch in batches:
            n += batch.num_rows
            total += C.exact_sum(_x(batch, dimensions))
        yield pa.record_batch([pa.array(range(-1, dimensions), pa.int32()), pa.array([Decimal(int(v)) for v in (n, *total)], pa.decimal128(38, 0))], names=["j", "s"])

    found = {r["j"]: int(r["s"]) for r in rows.select("x").mapInArrow(run, "j int, s decimal(38,0)").groupBy("j").agg(F.sum("s").alias("s")).collect()}
    return found.get(-1, 0), [found.get(j, 0) for j in range(dimensions)]


def fit(rows: DataFrame, dimensions: int, components: int = 8, oversample: int = 8, passes: int = 5, tolerance: float = 1e-13, seed: int = 11) -> Whitening | None:
    """The first components of rows (x of so many longs each); None without rows."""
    n, sums = _sums(rows, dimensions)
    if not n or not dimensions:
        return None
    shift = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    centred = lambda x: (x - shift) - rest
    wide = min(dimensions, components + oversample)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, wide)))[0]
    for turn in range(1, passes + 2):
        expanded = turn > passes or wide == dimensions
        if expanded:
            basis = np.eye(dimensions)
        held = rows.sparkSession.sparkContext.broadcast(basis)  # dimensions x subspace

        def part(x: np.ndarray) -> np.ndarray:
            c, out = centred(x), np.zeros((dimensions + 1, held.value.shape[1]))
            out[:-1] = c.T @ (c if expanded else c @ held.value)
            out[-1, 0] = (c * c).sum()
            return out

        got = _added(rows, part, (dimensions + 1, basis.shape[1]), dimensions) / n
        held.destroy()
        image, trace = got[:-1], float(got[-1, 0])
        small = basis.T @ image
        values, turned = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")[: min(components, dimensions)]
        values, turned = values[order], turned[:, order]
        axes = basis @ turned
        off = np.linalg.norm(image @ turned - axes * values, axis=0).max()
        if expanded or off <= tolerance * max(values[0], 0.0):
            break
        basis = np.linalg.qr(image)[0]
    axes = axes / np.linalg.norm(axes, axis=0)
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    kept = values > RANK * trace
    return Whitening(n, tuple(sums), axes[:, kept], values[kept], trace, turn, expanded)


def deviations(x: np.ndarray, shift: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)**2 of each row, exact; None beyond a long.  With y = x - shift and r = S - n * shift, it is
    n * n * sum(y * y) - 2 * n * sum(y * r) + sum(r * r), where only the last step may need more than a long."""
    y, r = x - shift, [s - n * int(k) for s, k in zip(sums, shift)]
    top = max(-int(y.min(initial=0)), int(y.max(initial=0)), 1)
    squares = y if top * top * y.shape[1] <= _LONG else y.astype(object)
    crossed = (y, np.array(r, np.int64)) if top * n * y.shape[1] <= _LONG else (y.astype(object), np.array(r, object))
    a, b, c = (squares * squares).sum(axis=1), (crossed[0] * crossed[1]).sum(axis=1), sum(v * v for v in r)
    out = (n * n * int(p) - 2 * n * int(q) + c for p, q in zip(a, b))
    return [v if v <= _LONG else None for v in out]


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8, oversample: int = 8, passes: int = 5,
           scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per vector and component, from 1 by falling eigenvalue e.

    whitened is the centred x projected on the component, over sqrt(e); explained is e over the trace; identity_error the largest
    entry of whitened's covariance less the identity, measured over all rows.  fit() gives the components themselves.
    """
    spark = df.sparkSession
    C.ship(spark)
    rows = C.materialise(C.whole_vectors(df, id_col, vec_col, scale, offset))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.where(F.size("x") == (common["d"] if common else 0))
    found = fit(rows, common["d"], components, oversample, passes) if common else None
    if found is None or not len(found.values):
        return spark.createDataFrame([], kind)
    d, k, n, sums, shift = common["d"], len(found.values), found.n, found.sums, found.shift
    rest = np.array([(s % n) / n for s in sums])
    held = spark.sparkContext.broadcast(found.axes / np.sqrt(found.values))  # dimensions x components

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - shift) - rest) @ held.value

    def moments(x: np.ndarray) -> np.ndarray:
        w = project(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    got = _added(rows, moments, (k + 1, k), d) / n
    error = float(np.abs(got[:-1] - np.outer(got[-1], got[-1]) - np.eye(k)).max())
    explained = found.values / found.trace

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _x(batch, d)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.record_batch([
                batch.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviations(x, shift, n, sums), pa.int64()).take(each),
                pa.array(project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, kind)
