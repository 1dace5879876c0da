"""What the corpus operators share: written intermediate tables, packs, byte views, hashes and components.

Packs
-----
Several operators need facts about a document's words that depend on the whole corpus (how often a word
or a passage occurs).  Shuffling one row per word would cost far more than the text itself, so documents
are dealt into *packs* of a few megabytes and each pack sends, per hash range ("bucket"), one blob of its
distinct 64-bit keys.  A bucket sees every key of its range at once, answers each pack with an array
aligned to that pack's keys, and the pack joins the answers to its own text.  A key that occurs in a third
of all rows is sent once per pack, so no bucket grows with the popularity of a key.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import inspect
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..session import shared_dir

#: Text bytes in a pack; a group of this size is all that a worker holds at once.
PACK_BYTES = 8 << 20
#: Rows in a pack at most, on average.
PACK_ROWS = 20_000

#: Tasks over packs or hash ranges at most; beyond, a task works on several, one after the other.
MOST_TASKS = 20_000

#: Rows that pass between Spark and a worker at once; whole texts make the default's batches too large.
BATCH_ROWS = 2000

#: Rows of a counted table in a file, and files that it may always have.
FILE_ROWS, FEW_FILES = 50_000, 8

#: A key with more than 1 / HUBS of the rows of a join, and over FEW_OF_HUB, is one of at most HUBS hubs.
HUBS, FEW_OF_HUB = 10_000, 1000

_written: list[tuple[SparkSession, str]] = []


# ---------------------------------------------------------------- shared folder

def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be gone by now, or the table
            _delete(spark, path)


@contextlib.contextmanager
def scratch():
    """Yields a function that writes a table (as materialise); the other tables written meanwhile go at the end."""
    before, kept = len(_written), []

    def keep(df: DataFrame) -> DataFrame:
        out, path = spill(df)
        kept.append(path)
        return out

    yield keep
    for spark, path in _written[before:]:
        if path not in kept:
            _delete(spark, path)
    _written[before:] = [x for x in _written[before:] if x[1] in kept]


def materialise(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors.

    rows: if known, so many at most, which go to few files: without native Hadoop libraries a writer starts a process
    per file, as which its executor's memory counts once more for a moment.
    """
    return spill(df, rows)[0]


def spill(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, str]:
    """As materialise(); also returns the path, for drop()."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(FEW_FILES, math.ceil(rows / FILE_ROWS)))
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table written by spill() that no DataFrame needs any more."""
    _delete(spark, path)


def ship(spark: SparkSession) -> None:
    """Ready a session: this package importable on the workers, and small Arrow batches."""
    session.ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release() -> None:
    """Give a worker's freed memory back, as workers outlive their tasks and share a machine."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(stage):
    """A function of Arrow tables that leaves no freed memory with its worker."""
    @functools.wraps(stage)
    def run(*tables: pa.Table) -> pa.Table:
        out = stage(*tables)
        release()
        return out

    run.__signature__ = inspect.signature(stage)  # Spark goes by the number of parameters
    return run


# ---------------------------------------------------------------- packs

def pack_count(df: DataFrame, text: str, pack_bytes: int = PACK_BYTES) -> int:
    """How many packs df's texts need; one aggregate over the column."""
    size, rows = df.agg(F.sum(F.octet_length(F.col(text))), F.count(F.lit(1))).first()
    return max(1, math.ceil((size or 0) / pack_bytes), math.ceil(rows / PACK_ROWS))


def task_count(packs: int) -> int:
    """Partitions for a shuffle by pack or hash range: a task's share doesn't grow with the input up to MOST_TASKS."""
    return min(packs, MOST_TASKS)


def pack_of(key: Column, packs: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(packs)).cast("int")


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Hash range of each 64-bit key; sorted keys give sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cuts(sorted_buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each run in an array of sorted bucket numbers."""
    if not len(sorted_buckets):
        return []
    at = np.flatnonzero(np.r_[True, sorted_buckets[1:] != sorted_buckets[:-1]])
    return list(zip(sorted_buckets[at].tolist(), at.tolist(), [*at[1:].tolist(), len(sorted_buckets)]))


# ---------------------------------------------------------------- Arrow

def flat(col: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        return col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    return col


def texts(col: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Values of a binary column; null counts as empty."""
    return [x or b"" for x in flat(col).to_pylist()]


def longs(col: pa.ChunkedArray | pa.Array, null: int) -> np.ndarray:
    """Values of an integer column, null as given."""
    return flat(col).fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(items: list[bytes], size: int, overlap: int = 0):
    """Deal texts into chunks of about `size` bytes.

    Yields lists of (index, offset, bytes); a longer text comes in slices that overlap by `overlap`.
    """
    out, held = [], 0
    for i, x in enumerate(items):
        if len(x) <= size + overlap:
            out.append((i, 0, x))
            held += len(x)
            if held >= size:
                yield out
                out, held = [], 0
        else:
            if out:
                yield out
                out, held = [], 0
            for at in range(0, len(x) - overlap, size):
                yield [(i, at, x[at : at + size + overlap])]
    if out:
        yield out


def arrow_table(rows: list[tuple], kinds: tuple[str, ...], names: tuple[str, ...]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * len(kinds)
    return pa.table([pa.array(c, pa.type_for_alias(k)) for c, k in zip(cols, kinds)], names=list(names))


# ---------------------------------------------------------------- hashes

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 17)
        up, down = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Polynomial hashes (modulo 2**64, over random byte values) of any substring of a buffer."""

    def __init__(self, buf: np.ndarray):
        up, self.down = _power_tables(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def every(self, width: int) -> np.ndarray:
        """Of each substring of the width, by start."""
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.down[:n]


#: Bytes of a word up to which its hash is a polynomial; below 1024 no two words agree under all of these.
LONG_WORD = 255
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every ASCII-white-space-delimited word, and how many words each text has.

    Words of over LONG_WORD bytes are hashed by a scrambled sum, as polynomials always give some pairs of very long words one
    hash; so different words agree by chance only.  Hash 0 is never a word's; it is free for the end token.
    """
    buf = np.frombuffer(b"\n".join(items) + b"\n", np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[0::2], edge[1::2]
    size = (end - start).astype(np.uint64)
    h = mix(Rolling(buf).of(start, end) + size)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i : i + 1] = mix(mix(_BYTE[buf[start[i] : end[i]]] + np.arange(size[i], dtype=np.uint64) * np.uint64(_P)).sum(keepdims=True, dtype=np.uint64) + size[i])
    h[h == 0] = 1
    ends = np.cumsum([len(x) + 1 for x in items]) if items else np.zeros(0, np.int64)
    return h, np.diff(np.searchsorted(start, ends), prepend=0)


# ---------------------------------------------------------------- joins

def merged(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of tables that grow with the input: both sides are shuffled and sorted, so none is collected by the driver."""
    return a.join(b.hint("merge"), on, how)


def hub_join(big: DataFrame, small: DataFrame, on: str, total: int) -> DataFrame:
    """big (of `total` rows) joined with small, which has one row per key and in n how many rows of big the key has.

    Keys with more than 1 / HUBS of the rows are HUBS at most, so they are sent to all tasks, and big's rows of them stay where they
    are; all others are shuffled and sorted.
    """
    share = max(FEW_OF_HUB, total // HUBS)
    if small.where(F.col("n") > share).isEmpty():
        return merged(big, small.drop("n"), on)
    small = materialise(small)
    hubs, rest = small.where(F.col("n") > share).drop("n"), small.where(F.col("n") <= share).drop("n")
    others = big.join(F.broadcast(hubs.select(on)), on, "left_anti")
    return big.join(F.broadcast(hubs), on).unionByName(merged(others, rest, on))  # HUBS rows at most


# ---------------------------------------------------------------- vectors

#: Components of this size or more have no integer of 64 bits once scaled; they count as not finite.
HUGE = float(1 << 52)


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 1024, offset: int = 0) -> DataFrame:
    """(id, x): floor(scale * c) + offset, as longs, of each component c (as double) of the vectors that are neither null
    nor hold a component that is null, not finite or HUGE."""
    v = F.col(f"`{vec_col}`")
    sound = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < HUGE))  # NaN is greater than any number
    x = F.transform(v, lambda c: F.floor(c.cast("double") * float(scale)).cast("long") + F.lit(offset).cast("long"))
    return df.where(v.isNotNull() & sound).select(F.col(f"`{id_col}`").alias("id"), x.alias("x"))


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Sums of the columns of a matrix of longs, as Python integers."""
    safe = not len(x) or max(-int(x.min(initial=0)), int(x.max(initial=0))) < (1 << 62) // len(x)
    return (x if safe else x.astype(object)).sum(axis=0).astype(object)


# ---------------------------------------------------------------- connected components

def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected edges (u, v), both long; component is the smallest node.

    Alternating large-star and small-star rounds: each is one grouped minimum and one join, edges never
    outnumber the input, and rounds grow with the logarithm of the longest path.  Each round is a written
    table.  A hub's edges don't meet in one task (hub_join).  Nodes without an edge don't appear.  Self-loops are ignored, empty input gives no rows.
    """
    spark = edges.sparkSession
    table, path = spill(_oriented(edges.select("u", "v")))
    before = _signature(table)
    while before[0]:
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = hub_join(both, low, "u", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _oriented(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = merged(large, least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        following, new = spill(_oriented(small), before[0])
        after = _signature(following)
        drop(spark, path)
        table, path = following, new
        if after == before:
            break
        before = after
    star = table.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
