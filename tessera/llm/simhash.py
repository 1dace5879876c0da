"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set where more than half of the text's shingle hashes (XXH64, seed 42) have it.
Two fingerprints at most two bits apart agree, in one of their two 32-bit segments, up to one bit.  So
each distinct fingerprint is filed under both of its segments, and looks up, for each segment, the small
Hamming ball around it: the segment itself and the segment with one set bit cleared (of two segments that
differ in one bit, one has that bit cleared).  Matches are verified over all 64 bits.  At 10**10
fingerprints a 32-bit segment has two or three owners, so a lookup meets few others.

A segment shared by more than `crowd` distinct fingerprints would give all pairs of its owners.  It holds a
marker instead; those who meet it are linked exactly through midpoints: fingerprints two bits
apart share a neighbour one bit from either, so each files itself under its 65 neighbours and those
filed together are linked to the least of them.  This is linear in the fingerprints, whatever their number.

Copies share a fingerprint and are never paired: classes are found over distinct fingerprints and joined
back.  Nulls: a null text has no words and fingerprint 0; a null id takes part in no component number
unless all ids of its fingerprint are null.  Repeated rows share a class.  Texts of any length are hashed whole, other
columns aren't read.  Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Owners of a segment from which on midpoints replace pairs.
CROWD = 128


def shingle_hashes(text: bytes, width: int = 3, seed: int = 42) -> np.ndarray:
    """Of the lower-cased (A-Z) words' shingles, repeats included; fewer words make one shingle, none give none."""
    import xxhash

    one, words = xxhash.xxh64_intdigest, text.lower().split()
    joined, n = b" ".join(words), len(words)
    if n <= width:
        return np.array([one(joined, seed)] if words else [], np.uint64)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    start = np.concatenate([[0], end[: n - width] + 1])
    return np.array([one(joined[a:b], seed) for a, b in zip(start.tolist(), end[width - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """0 without words."""
    return majority(shingle_hashes(text, width, seed))


def _prints(width: int, seed: int):
    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x, width, seed) for x in C.texts(batch.column("_text"))], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    C.ship(df.sparkSession)
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("_text"))
    return source.mapInArrow(_prints(width, seed), "id long, fp long")


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints two bits apart or less.  prints: (fp, node), distinct."""
    segments = F.array(F.struct(F.lit(0).alias("s"), F.shiftrightunsigned("fp", 32).alias("key")),
                       F.struct(F.lit(1).alias("s"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("key")))
    filed = prints.withColumn("x", F.explode(segments)).select("x.s", "x.key", "fp", "node")
    owners = filed.groupBy("s", "key").agg(F.count(F.lit(1)).alias("owners"))
    crowded = owners.where(F.col("owners") > crowd).select("s", "key")
    table = C.merged(filed, crowded, ["s", "key"], "left_anti").unionByName(
        crowded.select("s", "key", F.lit(None).cast("long").alias("fp"), F.lit(None).cast("long").alias("node")))
    bits = F.array(*[F.lit(1 << i) for i in range(32)])
    ball = F.concat(F.array("key"), F.transform(F.filter(bits, lambda b: F.col("key").bitwiseAND(b) != 0), lambda b: F.col("key").bitwiseXOR(b)))
    looks = filed.select("s", F.explode(ball).alias("key"), F.col("fp").alias("fp_a"), F.col("node").alias("a"))
    near = F.col("fp").isNull() | ((F.col("fp") != F.col("fp_a")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_a"))) <= 2))
    met = C.materialise(C.merged(looks, table.withColumnRenamed("node", "b"), ["s", "key"]).where(near).select("a", "b", F.when(F.col("b").isNull(), F.col("fp_a")).alias("fp")).distinct())
    pairs = met.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v"))
    # the crowded: the owners themselves look their own segment up, so they are among those who met a marker
    some = met.where("b is null").select("fp", F.col("a").alias("node")).distinct()
    one_off = F.array(F.lit(0), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    around = some.select("node", F.explode(F.transform(one_off, lambda b: F.col("fp").bitwiseXOR(b))).alias("mid"))
    least = around.groupBy("mid").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return pairs.unionByName(C.merged(around, least, "mid").where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, crowd: int = CROWD) -> DataFrame:
    """(id, fp, component_id) of every row."""
    rows = C.materialise(fingerprints(df, id_col, text_col, width, seed))
    prints = C.materialise(rows.groupBy("fp").agg(F.min("id").alias("node")))
    found = C.components(links(prints.where("node is not null"), crowd))
    named = C.merged(prints, found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return C.merged(rows, named, "fp").select("id", "fp", "component_id")
