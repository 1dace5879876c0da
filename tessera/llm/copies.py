"""Near copies by similarity of word shingles: multi-index hashing over wide SimHash fingerprints.

64 bits can't index texts that differ in a seventh of them, so a fingerprint has 64 * longs bits here, a bit being
set where more than half of the text's distinct shingles have it.  It is cut into segments; each text is filed,
for each segment, under a small Hamming ball: the segment with any subset of its `weak` least certain bits
flipped (those whose votes were closest).  Texts meet where their balls meet, which is where they differ in no
other bits of the segment than the weak ones of either.  Those who meet are verified over all bits.  `reach` bits may
differ: what texts of the similarity are expected to, and `slack` standard deviations more.

No link is left out, and what grows with the square of a group's size is only the last comparison of step 3, of texts that meet and still are in
different classes:

1.  Packs report the distinct keys they hold, and hash ranges answer which of them have a second owner (see
    common); only rows (key, node, fingerprint) of shared keys are made.
2.  Every owner of a key is verified against the key's leader, its least owner, and components are found.
3.  A key whose owners are all in one component has nothing left to tell.  In the others, all owners outside of
    the key's largest component are compared with all owners outside their own, in blocks of `block` rows that a
    task holds at once; what comes out are the edges of a forest.  So the classes are the components of all near
    pairs that meet, whatever the block.

Rows with one fingerprint are one node; classes are joined back to rows.  Nulls: a null text has no words and
fingerprint 0, as an empty one; a null id counts as larger than any.  Repeated rows are in one class.  A text of
fewer words than `width` is one shingle; long texts are read whole.  Other columns, whatever their names, aren't
touched.  Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Fingerprints in a pack.
PACK_PRINTS = 4096
#: Rows of a side that a task compares at once.
BLOCK = 1024
_LANES = np.uint64(0x0101010101010101)
_STEP = 0x9E3779B97F4A7C15


def reach(similarity: float, bits: int, slack: float = 0.0) -> int:
    """Differing bits of two equally long texts of that Jaccard similarity: as expected, and standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + slack * math.sqrt(bits * p * (1 - p)))


# ---------------------------------------------------------------- fingerprints

def shingles(items: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of lower-cased (A-Z) words, text by text; how many each text has."""
    words, count = C.word_hashes([x.lower() for x in items])
    own = np.maximum(count - width + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(len(items)), own)
    first = np.cumsum(count) - count
    at = np.arange(len(text)) - np.repeat(np.cumsum(own) - own, own) + first[text]
    end = (first + count)[text]
    padded = np.append(words, np.zeros(width, np.uint64))
    h = np.zeros(len(text), np.uint64)
    for k in range(width):
        h = C.mix(h * np.uint64(_STEP) + np.where(at + k < end, padded[at + k], np.uint64(0)))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[keep], np.bincount(text[keep], minlength=len(items))


def votes(hashes: np.ndarray, count: np.ndarray, longs: int) -> np.ndarray:
    """(text, bit): how many of the text's shingles have the bit, in `longs` families of 64 made from one hash.

    Bits are added up in the bytes of words, 255 shingles at a time.
    """
    out = np.zeros((len(count), longs, 64), np.int64)
    full = np.flatnonzero(count)
    if not len(full):
        return out.reshape(len(count), -1)
    first = np.cumsum(count) - count
    steps = np.concatenate([np.arange(first[i], first[i] + count[i], 255) for i in full.tolist()])
    of_text = np.searchsorted(steps, first[full])
    for f in range(longs):
        x = C.mix(hashes + np.uint64((2 * f + 1) * _STEP % 2**64))
        for j in range(8):
            lanes = np.add.reduceat(x >> np.uint64(j) & _LANES, steps)
            out[full, f, j::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), of_text, axis=0)
    return out.reshape(len(count), -1)


def prints(items: list[bytes], width: int = 5, longs: int = 16, segment_bits: int = 32, weak: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (text, long) and, for each segment, the places of its least certain bits (text, segment * weak)."""
    hashes, count = shingles(items, width)
    ones = votes(hashes, count, longs)
    bits = 2 * ones > count[:, None]
    segments = 64 * longs // segment_bits
    margin = np.abs(2 * ones - count[:, None])[:, : segments * segment_bits].reshape(-1, segments, segment_bits)
    least = np.argsort(margin, axis=2, kind="stable")[:, :, :weak].astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), least.reshape(len(items), -1)


def _make_prints(width: int, longs: int, segment_bits: int, weak: int):
    def run(batches):
        for batch in batches:
            found, least = [np.zeros((0, longs), np.uint64)], []
            for chunk in C.pieces(C.texts(batch.column("_text")), 1 << 18, 1 << 40):
                f, w = prints([x for _, _, x in chunk], width, longs, segment_bits, weak)
                found.append(f)
                least += [x.tobytes() for x in w]
            f = np.concatenate(found).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(f[:, i]) for i in range(longs)], pa.array(least, pa.binary())],
                                  names=["id", "digest", *[f"f{i}" for i in range(longs)], "weak"])
        C.release()

    return run


# ---------------------------------------------------------------- shared keys

def ball_keys(fingerprints: np.ndarray, least: np.ndarray, segment_bits: int, weak: int) -> np.ndarray:
    """(text, key): the keys of all segments' balls, told apart by segment and spread over 64 bits."""
    n, segments = len(fingerprints), fingerprints.shape[1] * 64 // segment_bits
    bits = np.unpackbits(np.ascontiguousarray(fingerprints).view(np.uint8), axis=1, bitorder="little")[:, : segments * segment_bits]
    place = np.uint64(1) << np.arange(segment_bits, dtype=np.uint64)
    value = (bits.reshape(n, segments, segment_bits) * place).sum(2, dtype=np.uint64)
    flips = np.uint64(1) << least.reshape(n, segments, weak).astype(np.uint64)
    out = value[:, :, None]
    for i in range(weak):
        out = np.concatenate([out, out ^ flips[:, :, i : i + 1]], axis=2)
    return C.mix(out * np.uint64(segments) + np.arange(segments, dtype=np.uint64)[None, :, None]).reshape(n, -1)


_REPORT = "bucket int, pack int, keys binary, again binary"
_ANSWER = "pack int, bucket int, shared binary"


def _stages(longs: int, segment_bits: int, weak: int, buckets: int):
    """The functions of a pack, a hash range, and a pack with its answers."""
    bits = [f"f{i}" for i in range(longs)]

    def keys_of(table: pa.Table) -> np.ndarray:
        f = np.stack([C.flat(table[c]).to_numpy() for c in bits], axis=1).view(np.uint64)
        least = np.frombuffer(b"".join(table["weak"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
        return ball_keys(f, least, segment_bits, weak)

    def report(table: pa.Table) -> pa.Table:
        keys, count = np.unique(keys_of(table), return_counts=True)
        number, again = table["_pack"][0].as_py(), count > 1
        rows = [(b, number, keys[i:j].tobytes(), np.packbits(again[i:j]).tobytes()) for b, i, j in C.cuts(C.bucket_of(keys, buckets))]
        return C.arrow_table(rows, ("int32", "int32", "binary", "binary"), ("bucket", "pack", "keys", "again"))

    def judge(table: pa.Table) -> pa.Table:
        blobs = table["keys"].to_pylist()
        size = [len(x) // 8 for x in blobs]
        keys = np.frombuffer(b"".join(blobs), np.uint64)
        again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["again"].to_pylist(), size)]) > 0
        order = np.argsort(keys)
        near = keys[order][1:] == keys[order][:-1]
        shared = again.copy()
        shared[order[1:][near]] = True
        shared[order[:-1][near]] = True
        rows, at = [], 0
        for b, p, n in zip(table["bucket"].to_pylist(), table["pack"].to_pylist(), size):
            rows.append((p, b, np.packbits(shared[at : at + n]).tobytes()))
            at += n
        return C.arrow_table(rows, ("int32", "int32", "binary"), ("pack", "bucket", "shared"))

    def owners(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("key", "node", *bits)})
        keys = keys_of(table)
        distinct, back = np.unique(keys, return_inverse=True)
        told = dict(zip(answers["bucket"].to_pylist(), answers["shared"].to_pylist()))
        shared = np.concatenate([np.unpackbits(np.frombuffer(told[b], np.uint8), count=j - i) for b, i, j in C.cuts(C.bucket_of(distinct, buckets))])
        row, col = np.nonzero(shared[back].reshape(keys.shape))
        out = pa.table({"key": pa.array(keys[row, col].view(np.int64)), **{c: C.flat(table[c]).take(pa.array(row)) for c in ("node", *bits)}})
        return out

    return C.lean(report), C.lean(judge), C.lean(owners)


def shared_keys(nodes: DataFrame, longs: int, segment_bits: int, weak: int, pack_prints: int) -> DataFrame:
    """(key, node, f0, f1, ...) of the keys that several nodes own; nodes: (node, f0, f1, ..., weak), written."""
    packs = max(1, math.ceil(nodes.count() / pack_prints))
    report, judge, owners = _stages(longs, segment_bits, weak, packs)
    dealt = nodes.withColumn("_pack", C.pack_of(F.col("node"), packs))
    answers = dealt.drop("node").groupBy("_pack").applyInArrow(report, _REPORT).groupBy("bucket").applyInArrow(judge, _ANSWER)
    return dealt.groupBy("_pack").cogroup(answers.groupBy("pack")).applyInArrow(owners, "key long, node long, " + ", ".join(f"f{i} long" for i in range(longs)))


# ---------------------------------------------------------------- links

def forest(label: np.ndarray, fingerprints: np.ndarray, asking: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Rows (asking, asked) whose links join the labels that near rows of different labels join."""
    out, label = [], label.copy()
    asked = np.flatnonzero(~asking)
    table = fingerprints[asked]
    for i in np.flatnonzero(asking).tolist():
        other = label[asked] != label[i]
        if not other.any():
            continue
        near = np.flatnonzero(other)[np.bitwise_count(table[other] ^ fingerprints[i]).sum(1) <= radius]
        for j in asked[near[np.unique(label[asked[near]], return_index=True)[1]]].tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _meet(longs: int, radius: int):
    """Compares the rows of each (key, part, ask), which come one after the other."""

    def cell(t: pa.RecordBatch | pa.Table) -> list[tuple[int, int]]:
        label = t["c"].to_numpy()
        f = np.stack([t[f"f{i}"].to_numpy() for i in range(longs)], axis=1).view(np.uint64)
        return [(int(label[i]), int(label[j])) for i, j in forest(label, f, t["asking"].to_numpy(zero_copy_only=False), radius)]

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None

        def flush():
            pairs = sorted(set(cell(pa.Table.from_batches(held).combine_chunks()))) if held else []
            held.clear()
            return pairs

        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy() for c in ("key", "part", "ask")], axis=1)
            edge = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
            found: list[tuple[int, int]] = []
            for a, b in zip(edge, edge[1:]):
                now = tuple(place[a].tolist())
                if now != last:
                    found += flush()
                    last = now
                held.append(batch.slice(a, b - a))
            yield pa.record_batch([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["u", "v"])
        rest = flush()
        yield pa.record_batch([pa.array([p[k] for p in rest], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def classes(nodes: DataFrame, longs: int, segment_bits: int, weak: int, radius: int, block: int, pack_prints: int) -> DataFrame:
    """(node, component) of the nodes that have a near one; nodes: (node, f0, f1, ..., weak), written."""
    count = nodes.count()
    owners = C.materialise(shared_keys(nodes, longs, segment_bits, weak, pack_prints))
    bits = [f"f{i}" for i in range(longs)]
    # every owner against its key's leader
    leads = owners.groupBy("key").agg(F.min(F.struct("node", *bits)).alias("lead"), F.count(F.lit(1)).alias("n"))
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"lead.{b}"))) for b in bits), F.lit(0))
    near = C.hub_join(owners, leads, "key", owners.count()).where((F.col("node") != F.col("lead.node")) & (apart <= radius))
    named = C.materialise(C.components(near.select(F.col("node").alias("u"), F.col("lead.node").alias("v"))), count)
    # what is left to compare: keys whose owners are in several components
    owned = C.merged(owners, named, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    members = owned.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    cells = members.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("host")).where("n > host.n")
    parts = lambda n: F.ceil(n / block).cast("int")
    cells = cells.select("key", F.col("host.c").alias("host"), parts(F.col("n")).alias("parts"), parts(F.col("n") - F.col("host.n")).alias("asks"))
    owned = C.merged(owned, cells, "key")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = owned.select("key", place("parts").alias("part"), every("asks").alias("ask"), "c", *bits, F.lit(False).alias("asking"))
    asking = owned.where("c <> host").select("key", every("parts").alias("part"), place("asks").alias("ask"), "c", *bits, F.lit(True).alias("asking"))
    both = asked.unionByName(asking).repartition("key", "part", "ask").sortWithinPartitions("key", "part", "ask")
    more = C.materialise(C.components(both.mapInArrow(_meet(longs, radius), "u long, v long")), count)
    joined = C.merged(named.withColumnRenamed("component", "c"), more.select(F.col("node").alias("c"), F.col("component").alias("d")), "c", "left")
    joined = joined.select("node", F.coalesce("d", "c").alias("component"))
    return joined.unionByName(C.merged(more, named, "node", "left_anti"))  # components of one node, joined in the second round


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, slack: float = 1.0, longs: int = 16,
                segment_bits: int = 32, weak: int = 3, block: int = BLOCK, pack_prints: int = PACK_PRINTS) -> DataFrame:
    """(id, digest, component_id, first) of every row: digest is the xxhash64 of its text, component_id the smallest id of its class.

    first: true for the class's smallest (id, digest), and so for all rows that repeat that one.  A segment of n
    fingerprints has n * 2**(weak - segment_bits) owners by chance: beyond some 10**9 distinct texts take wider segments.
    """
    C.ship(df.sparkSession)
    bits = [f"f{i}" for i in range(longs)]
    text = F.col(f"`{text_col}`")
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("digest"), text.cast("binary").alias("_text"))
    rows = C.materialise(source.mapInArrow(_make_prints(width, longs, segment_bits, weak), "id long, digest long, " + ", ".join(f"{b} long" for b in bits) + ", weak binary"))
    own = F.struct(F.col("id").isNull().alias("unnamed"), "id", "digest")
    nodes = rows.groupBy(*bits).agg(F.min(own).alias("own"), F.min("weak").alias("weak")).withColumn("node", F.monotonically_increasing_id())
    nodes = C.materialise(nodes, rows.count())  # from here on the numbers stay
    found = classes(nodes.select("node", *bits, "weak"), longs, segment_bits, weak, reach(similarity, 64 * longs, slack), block, pack_prints)
    named = C.merged(nodes.select("node", "own", *bits), found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("n"))
    named = C.hub_join(named, least, "component", nodes.count()).select(*bits, "least")
    return C.merged(rows.drop("weak"), named, bits).select("id", "digest", F.col("least.id").alias("component_id"), (own == F.col("least")).alias("first"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """df's rows, one of each class of near copies: that of the smallest id, then of the smallest digest; repeated rows once."""
    found = C.materialise(near_copies(df, id_col, text_col, **settings))
    names = [f"`{c}`" for c in df.columns]
    keyed = df.select(F.struct(*names).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("digest"))
    same = lambda other: keyed["id"].eqNullSafe(other["id"]) & (keyed["digest"] == other["digest"])
    others = found.where("NOT first").select("id", "digest").distinct()
    kept = keyed.join(others.hint("merge"), same(others), "left_anti")
    again = found.where("first").groupBy("id", "digest").count().where("count > 1").select("id", "digest")
    if not again.isEmpty():
        repeated = kept.join(again.hint("merge"), kept["id"].eqNullSafe(again["id"]) & (kept["digest"] == again["digest"]), "left_semi")
        ordered = not any(k in df.select(F.struct(*names)).schema.simpleString() for k in ("map<", "variant"))  # these have no order; their text has
        once = repeated.groupBy("id", "digest").agg((F.min("_row") if ordered else F.min_by("_row", F.to_json("_row"))).alias("_row")).select("_row", "id", "digest")
        kept = kept.join(again.hint("merge"), kept["id"].eqNullSafe(again["id"]) & (kept["digest"] == again["digest"]), "left_anti").unionByName(once)
    return kept.select(*[F.col(f"_row.{n}") for n in names])
