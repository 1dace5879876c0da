"""Language-model scores from a log-frequency Bloom filter.

Tokens of the training texts are counted exactly, by packs and hash ranges (see common).  A range sums the
words and word pairs of its keys and sets its own stretch of one Bloom filter.  A count enters the filter as its
level on a logarithmic scale (LEVELS): the events (n-gram, 1), ..., (n-gram, level) are all inserted, and a count is
recovered by probing the levels upwards until one is missing.

The filter grows with the corpus, so it is neither gathered nor broadcast whole: each worker holds the stretch
of the range it works on, probes it for all n-grams that the packs have asked about (those of held-out texts too), and
answers every pack with the levels found and, for the base score, the exact word counts.  A stretch has
BITS_PER_EVENT bits for each event of its range, whatever the corpus' size; nothing is left out of it.

The score smooths pairs with single words, both from the filter: with h the word before (the end token
before the first), p(w|h) = (c(h,w) + K p(w)) / (c(h) + K), p(w) = (c(w) + 1)/(N + V + 1).

Words are told apart by 64-bit hashes (common.word_hashes): of V distinct words V**2 / 2**65 pairs share one.

Nulls: a null text is empty (its only token is the end); a null id trains.  Packs take rows by id and text, so rows that share an id are
spread.  Rows equal in both would all lie in one pack, so where they are large together they travel as rows with a count
(weighed), which are scored once and given back as often as they came; repeated rows all count.  Long texts are read whole, in a pack of their own size.  Other columns aren't read.  Empty tables
give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bits of a stretch for each event in it; with HASHES probes about one in a hundred missing events seems there.
BITS_PER_EVENT = 12
HASHES = 3
#: Weight of the single-word estimate, in occurrences of the word before; of 4 to 1024 the best for a fold (3) that is neither trained on nor reported.
K = 256.0
#: Least count of each level: 1, 2, 3, 4, 6, 8, 12, 16, 24, ...
LEVELS = np.array([1, 2, 3, *[x << i for i in range(1, 45) for x in (2, 3)]], np.int64)
#: What a level stands for, level 0 being none.
VALUES = np.concatenate([[0.0], np.sqrt(LEVELS[:-1] * (LEVELS[1:] - 1.0)), [float(LEVELS[-1])]])
_CHUNK = 1 << 18
#: Groups of equal rows that travel as counts, at most; their hashes are broadcast, 8 bytes each.
HOT_ROWS = 1_000_000
#: Equal rows that one row stands for, at most.
COPIES_AT_ONCE = 10_000
_END = np.uint64(0)
_ONE = np.uint64(0xA24BAED4963EE407)
_TWO = np.uint64(0x9FB21C651E98DF25)


def tokens_of(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words, each text closed by an end token; tokens by text."""
    words, count = C.word_hashes([x.lower() for x in items])
    out = np.full(len(words) + len(items), _END, np.uint64)
    owner = np.repeat(np.arange(len(items)), count)
    out[np.arange(len(words)) + owner] = words
    return out, count + 1


def pair_keys(tokens: np.ndarray) -> np.ndarray:
    """Of each token with the one before; texts end with the end token, which stands before the first."""
    return C.mix(np.concatenate([[_END], tokens[:-1]]) * _TWO + C.mix(tokens + _TWO))


def word_keys(words: np.ndarray) -> np.ndarray:
    return C.mix(words ^ _ONE)


class Filter:
    """The filter's stretch of one hash range."""

    def __init__(self, events: int, bits_per_event: int = BITS_PER_EVENT):
        self.bits = -(-max(64, events * bits_per_event) // 8) * 8
        self.data = np.zeros(self.bits // 8, np.uint8)

    def places(self, keys: np.ndarray, level: int):
        h = C.mix(keys + np.uint64(level * int(_ONE) % 2**64))
        a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            yield ((a + np.uint64(i) * b) % np.uint64(self.bits)).astype(np.int64)

    def insert(self, keys: np.ndarray, levels: np.ndarray) -> None:
        bits = np.zeros(self.bits, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            keys, levels = keys[levels >= level], levels[levels >= level]
            for at in self.places(keys, level):
                bits[at] = True
        self.data |= np.packbits(bits, bitorder="little")

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key by membership probes."""
        out = np.zeros(len(keys), np.uint8)
        left = np.arange(len(keys))
        for level in range(1, len(LEVELS) + 1):
            there = np.ones(len(left), bool)
            for at in self.places(keys[left], level):
                there &= (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            left = left[there]
            if not len(left):
                break
            out[left] = level
        return out


def _count(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        keys, n = np.unique(keys, return_counts=True)
        return keys, n.astype(np.int64)
    keys, back = np.unique(keys, return_inverse=True)
    return keys, np.bincount(back, weights, len(keys)).astype(np.int64)


def _small(n: np.ndarray) -> bytes:
    """Counts, mostly 1: one byte each, and those of 255 or more once again behind."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<i8").tobytes()


def _large(blob: bytes, size: int) -> np.ndarray:
    n = np.frombuffer(blob, np.uint8, size).astype(np.int64)
    n[n == 255] = np.frombuffer(blob, "<i8", offset=size)
    return n


_SENT = "bucket int, pack int, words binary, word_counts binary, pairs binary, pair_counts binary"
_TOLD = "pack int, bucket int, counts binary, word_levels binary, pair_levels binary, distinct long, total long"
_SCORES = "id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double, copies long"


def _send(ranges: int):
    def run(table: pa.Table) -> pa.Table:
        number = table["_pack"][0].as_py()
        items, train = C.texts(table["_text"]), C.flat(table["_train"]).to_numpy(zero_copy_only=False) * C.longs(table["_n"], 1)
        words, pairs = [], []
        for chunk in C.pieces(items, _CHUNK, 1 << 40):
            tokens, count = tokens_of([x for _, _, x in chunk])
            used = np.repeat(train[[i for i, _, _ in chunk]], count)
            words.append(_count(tokens, used))
            pairs.append(_count(pair_keys(tokens), used))
        words, pairs = (_count(*(np.concatenate(x) for x in zip(*part))) for part in (words, pairs))
        # the end token's hash is 0, so ranges are taken of the words' keys, which are spread
        by = word_keys(words[0])
        order = np.argsort(by)
        own = {b: [words[0][order[i:j]].tobytes(), _small(words[1][order[i:j]]), b"", b""] for b, i, j in C.cuts(C.bucket_of(by[order], ranges))}
        for b, i, j in C.cuts(C.bucket_of(pairs[0], ranges)):
            own.setdefault(b, [b"", b"", b"", b""])[2:] = [pairs[0][i:j].tobytes(), _small(pairs[1][i:j])]
        rows = [(b, number, *x) for b, x in own.items()]
        return C.arrow_table(rows, ("int32", "int32", *["binary"] * 4), ("bucket", "pack", "words", "word_counts", "pairs", "pair_counts"))

    return run


def _sum(bits_per_event: int):
    def run(table: pa.Table) -> pa.Table:
        cols = {c: table[c].to_pylist() for c in table.column_names}
        size = {c: [len(x) // 8 for x in cols[c]] for c in ("words", "pairs")}
        words, pairs = (np.frombuffer(b"".join(cols[c]), np.uint64) for c in ("words", "pairs"))
        count, pair_count = (np.concatenate([_large(n, k) for n, k in zip(cols[c], size[of])]) for c, of in (("word_counts", "words"), ("pair_counts", "pairs")))
        distinct, back = np.unique(words, return_inverse=True)
        total = np.bincount(back, count, len(distinct)).astype(np.int64)
        both, pair_back = np.unique(pairs, return_inverse=True)
        pair_total = np.bincount(pair_back, pair_count, len(both)).astype(np.int64)
        keys = np.concatenate([word_keys(distinct), both])
        levels = np.searchsorted(LEVELS, np.concatenate([total, pair_total]), "right")
        stretch = Filter(int(levels.sum()), bits_per_event)
        stretch.insert(keys[levels > 0], levels[levels > 0])
        read = stretch.level(keys)  # from here on only what the filter says
        word_level, pair_level = read[: len(distinct)][back], read[len(distinct) :][pair_back]
        told, rows = total[back], [(-1, cols["bucket"][0], b"", b"", b"", int((total > 0).sum()), int(total.sum()))]
        at = pair_at = 0
        for p, b, n, m in zip(cols["pack"], cols["bucket"], size["words"], size["pairs"]):
            rows.append((p, b, told[at : at + n].astype("<i8").tobytes(), word_level[at : at + n].tobytes(), pair_level[pair_at : pair_at + m].tobytes(), 0, 0))
            at, pair_at = at + n, pair_at + m
        return C.arrow_table(rows, ("int32", "int32", *["binary"] * 3, "int64", "int64"), ("pack", "bucket", "counts", "word_levels", "pair_levels", "distinct", "total"))

    return run


_NAMES = ("id", "held_out", "n_tokens", "n_known", "base_sum", "score", "copies")
_KINDS = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())


def _score(total: int, vocabulary: int, weight: float):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in _KINDS], names=list(_NAMES))
        by_range = np.argsort(told["bucket"].to_numpy())
        answers = {c: b"".join([told[c][int(i)].as_py() for i in by_range]) for c in ("counts", "word_levels", "pair_levels")}
        spoken = [tokens_of([x for _, _, x in chunk]) for chunk in C.pieces(C.texts(table["_text"]), _CHUNK, 1 << 40)]
        tokens, count = (np.concatenate(x) for x in zip(*spoken))
        words, at = np.unique(tokens, return_inverse=True)
        order = np.argsort(word_keys(words))
        exact, about = np.empty(len(words), np.int64), np.empty(len(words))
        exact[order] = np.frombuffer(answers["counts"], "<i8")
        about[order] = VALUES[np.frombuffer(answers["word_levels"], np.uint8)]
        single = (about + 1) / (total + vocabulary + 1.0)
        first = about[np.concatenate([[np.searchsorted(words, _END)], at[:-1]])]
        pair_at = np.unique(pair_keys(tokens), return_inverse=True)[1]
        pair = np.minimum(VALUES[np.frombuffer(answers["pair_levels"], np.uint8)][pair_at], np.minimum(first, about[at]))
        start = np.cumsum(count) - count
        by_text = lambda x: np.add.reduceat(x, start)
        cols = (count, by_text((exact > 0).astype(np.int64)[at]), by_text((np.log10(exact + 1.0) - np.log10(total + vocabulary + 1.0))[at]),
                by_text(np.log10((pair + weight * single[at]) / (first + weight))))
        held = pa.array(~C.flat(table["_train"]).to_numpy(zero_copy_only=False).astype(bool))
        return pa.table([table["_id"].combine_chunks(), held, *[pa.array(c, k) for c, k in zip(cols, _KINDS[2:])], table["_n"].combine_chunks()], names=list(_NAMES))

    return run


def weighed(rows: DataFrame, pack_bytes: int, total_bytes: int, copies_at_once: int = COPIES_AT_ONCE) -> DataFrame:
    """rows (_id, _text, _train) with _n, how many equal rows one stands for, and _part, which tells such rows apart.

    Groups of equal rows that fill an eighth of a pack and a HOT_ROWS-th of all bytes become rows with counts, summed before the
    shuffle; the others have _n 1.
    """
    key = F.xxhash64("_id", "_text")
    size = F.coalesce(F.octet_length("_text"), F.lit(0)) + 8
    groups = rows.groupBy(key.alias("_h")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n"))
    hot = C.materialise(groups.where((F.col("n") > 1) & (F.col("bytes") > max(pack_bytes // 8, total_bytes // HOT_ROWS))).select("_h"), HOT_ROWS)
    plain = [F.lit(1).cast("long").alias("_n"), F.lit(0).cast("long").alias("_part")]
    if hot.isEmpty():
        return rows.select("*", *plain)
    keyed = rows.withColumn("_h", key)
    once = keyed.join(F.broadcast(hot), "_h", "left_anti").select(*rows.columns, *plain)
    counted = keyed.join(F.broadcast(hot), "_h").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_all"))
    parts = counted.withColumn("_part", F.explode(F.expr(f"sequence(0L, (_all - 1) div {copies_at_once})")))
    n = F.least(F.lit(copies_at_once).cast("long"), F.col("_all") - F.col("_part") * copies_at_once)
    return once.unionByName(parts.select(*rows.columns, n.alias("_n"), "_part"))


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, weight: float = K,
                pack_bytes: int = C.PACK_BYTES, bits_per_event: int = BITS_PER_EVENT,
                copies_at_once: int = COPIES_AT_ONCE) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    C.ship(df.sparkSession)
    packs = C.pack_count(df, text_col, pack_bytes)
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    fold = F.crc32(key.cast("string").cast("binary")) % folds
    rows = df.select(key.cast("long").alias("_id"), text.cast("binary").alias("_text"), F.coalesce(fold != held_fold, F.lit(True)).alias("_train"))
    rows = weighed(rows, pack_bytes, packs * pack_bytes, copies_at_once)
    tasks = C.task_count(packs)
    dealt = rows.withColumn("_pack", C.pack_of(F.struct("_id", "_text", "_part"), packs)).drop("_part").repartition(tasks, "_pack")
    sent = dealt.groupBy("_pack").applyInArrow(C.lean(_send(packs)), _SENT).repartition(tasks, "bucket")
    told = C.materialise(sent.groupBy("bucket").applyInArrow(C.lean(_sum(bits_per_event)), _TOLD))
    vocabulary, total = told.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    answers = told.where("pack >= 0").select("pack", "bucket", "counts", "word_levels", "pair_levels").repartition(tasks, "pack")
    scored = dealt.groupBy("_pack").cogroup(answers.groupBy("pack")).applyInArrow(C.lean(_score(total, vocabulary, weight)), _SCORES)
    scored = scored.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return scored.select("id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base_sum").alias("base_score"), "score")
