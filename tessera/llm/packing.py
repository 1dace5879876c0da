"""Packing token sequences with the minimum bin slack heuristic.

A document's ids are cut into pieces of the window's length and one remainder.  Full pieces fill a sequence
each.  The remainders of a shard (about SHARD_ROWS documents, dealt by a hash of the id, so a shard is as
long for a hot source as for any other) are packed by minimum bin slack: the longest remainder left opens a
sequence, and a subset-sum dynamic programme over the counts of the other lengths finds the multiset that
fills the rest of the window closest to its capacity.  Reachable sums are the bits of one integer; each
length enters in chunks of 1, 2, 4, ... copies, and walking back through the stored bit sets yields how
many of each length to take.  As a pattern is found for lengths, not documents, it is applied as often as
its counts allow.

A sequence is padded to the window unless its length is a power of two.

Nulls: a null text is empty and gives the end token alone; a null id hashes like any value and stays null.
Repeated rows are packed as rows of their own, and spread over the shards.  Texts of any length are read whole; other columns aren't
read.  Empty tables give no rows.
"""

from __future__ import annotations

import json
import math
import string
import unicodedata
import zlib
from itertools import chain, compress, islice, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHARD_ROWS = 20_000
#: Bytes that a worker spends on remembering the ids of words, and what an entry costs besides its word and ids; beyond, it keeps
#: what was in use last.  Words of over LONG_WORD bytes are encoded each time.
CACHE_BYTES, ENTRY_BYTES, LONG_WORD = 240 << 20, 180, 128
_known: dict = {}
#: What may stand behind a word as one token of its own: ASCII punctuation but the apostrophe, which also begins contractions.
_MARKS = string.punctuation.replace("'", "")
_MARK_BYTES = _MARKS.encode()


class Ids:
    """Ids of texts by a tokenizer that never joins words across ASCII white space, by way of distinct words.

    Words are lower-cased (A-Z) first, as the tokenizer does it anyway.  Of a new word, letters and the punctuation behind them are separate
    tokens; the letters of many new words are encoded as one text, whose ids fall apart at the ids that end a word.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.cache: dict[bytes, bytes] = {}
        self.limit, self.held = CACHE_BYTES, 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.plain = self._without_normalizer(definition, vocabulary)

    def _without_normalizer(self, definition: str, vocabulary: dict[str, int]):
        """The same merges for words that are normalised already, if a sample of words agrees; else the tokenizer itself."""
        from tokenizers import Tokenizer

        parts = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        plain = Tokenizer.from_str(json.dumps(json.loads(definition) | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": parts}}))
        words = [w for t in list(vocabulary)[::17] if (w := t.removesuffix("</w>")).isascii() and w.isalpha()]
        words = [a.lower() + b.lower() for a, b in zip(words, words[1:])] + ["àéîöüß", "größeñ", "слово"]
        same = all(a.ids == b.ids for a, b in zip(plain.encode_batch_fast(words, add_special_tokens=False), self.tokenizer.encode_batch_fast(words, add_special_tokens=False)))
        return plain if same else self.tokenizer

    def encode(self, words: list[str]) -> list[bytes]:
        """Each word by itself."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode_letters(self, words: list[bytes]) -> list[bytes]:
        """Normalised words of letters only, by the thousand."""
        groups = [words[at : at + 1024] for at in range(0, len(words), 1024)]
        out: list[bytes] = []
        for group, e in zip(groups, self.plain.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            upto = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(upto) != len(group):
                out += self.encode([w.decode() for w in group])
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *upto], upto)]
        return out

    def learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that the cache lacks, and of their letters."""
        letters, later, odd = {w: w for w in new if w.isalpha()}, [], []  # of bytes, that is ASCII letters
        for w in new:
            if w in letters:
                continue
            core = w.rstrip(_MARK_BYTES)
            if core.isalpha():
                later.append((w, core, w[len(core):]))
                letters[core] = core
                continue
            s = w.decode("utf-8", "replace")
            core = s.rstrip(_MARKS)
            if core.isascii():
                norm = core
            else:  # composed and lower-cased letter by letter, which only differs for a capital sigma
                norm = unicodedata.normalize("NFC", core).lower() if "\u03a3" not in core else ""
            if norm.isalpha():
                b = core.encode()
                if len(core) < len(s):
                    later.append((w, b, s[len(core):].encode()))
                letters[b] = norm.encode()
            else:
                odd.append(w)
        cache = self.cache
        letters = {b: norm for b, norm in letters.items() if b not in cache}
        out = dict(zip(letters, self.encode_letters(list(letters.values()))))
        tails = list({t for _, _, t in later})
        behind = dict(zip(tails, self.encode([t.decode() for t in tails])))
        for w, core, t in later:
            out[w] = (out[core] if core in out else cache[core]) + behind[t]
        out.update(zip(odd, self.encode([w.decode("utf-8", "replace") for w in odd])))
        return out

    def of(self, items: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        words = [x.lower().split() for x in items]
        count, words = list(map(len, words)), list(chain.from_iterable(words))
        found = list(map(self.cache.get, words))
        unknown = list(compress(range(len(words)), map(is_, found, repeat(None))))
        new = {words[i] for i in unknown}
        long = [k for k in new if len(k) > LONG_WORD]
        once = dict(zip(long, self.encode([k.decode("utf-8", "replace") for k in long])))
        learnt = self.learn(list(new.difference(once)))
        self.cache.update(learnt)
        self.held += _size(learnt)
        learnt.update(once)
        for i in unknown:
            found[i] = learnt[words[i]]
        if self.held > self.limit:
            self.cache = {k: v for k, v in zip(words, found) if len(k) <= LONG_WORD}
            self.held = _size(self.cache)
        rest = iter(found)
        return [b"".join(islice(rest, n)) for n in count]


def _size(cache: dict[bytes, bytes]) -> int:
    return sum(map(len, cache)) + sum(map(len, cache.values())) + ENTRY_BYTES * len(cache)


def ids_by(definition: str) -> Ids:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = zlib.crc32(definition.encode())
    if key not in _known:
        _known.clear()
        _known[key] = Ids(definition)
    return _known[key]


def fill(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """Of counts by length, the multiset with the largest sum up to the capacity."""
    reach, steps, full = 1, [], 1 << capacity
    mask = (full << 1) - 1
    for length in (np.flatnonzero(counts[1 : capacity + 1])[::-1] + 1).tolist():
        left, chunk = min(int(counts[length]), capacity // length), 1
        while left:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left -= take
            chunk *= 2
        if reach & full:
            break
    total, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            out[length] = out.get(length, 0) + take
    return out


def slack_patterns(lengths: np.ndarray, window: int):
    """Yield (pattern, times): patterns are {length: count} and together hold every length once."""
    counts = np.bincount(lengths, minlength=window + 1)
    for longest in range(len(counts) - 1, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            pattern = fill(counts, window - longest) if longest < window else {}
            counts[longest] += 1
            pattern[longest] = pattern.get(longest, 0) + 1
            times = min(int(counts[k]) // n for k, n in pattern.items())
            for k, n in pattern.items():
                counts[k] -= n * times
            yield pattern, times


def _tokenise(definition, window: int, end_id: int, cache_bytes: int):
    def run(batches):
        ids = ids_by(definition.value)
        ids.limit = cache_bytes
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            own, all_texts = batch.column("_id"), C.texts(batch.column("_text"))
            tokens, crcs = [], []
            for chunk in _slices(all_texts, 4 << 20):
                for x in ids.of(chunk):
                    x += end
                    tokens.append(len(x) // 4)
                    crcs.append([zlib.crc32(x[at : at + 4 * window]) for at in range(0, len(x), 4 * window)])
            yield pa.record_batch([own, pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["_id", "tokens", "crcs"])
        C.release()

    return run


def _slices(items: list[bytes], size: int):
    at = held = 0
    for i, x in enumerate(items):
        held += len(x)
        if held >= size:
            yield items[at : i + 1]
            at, held = i + 1, 0
    if at < len(items):
        yield items[at:]


def _arrange(window: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table["_shard"][0].as_py()
        tokens = table["tokens"].to_numpy()
        order = np.lexsort((table["first_crc"].to_numpy(), tokens, C.longs(table["_id"], -1)))
        full, tail = tokens // window, tokens % window
        # full pieces: a sequence each
        row = np.repeat(order, full[order])
        nth = np.arange(len(row)) - np.repeat(np.cumsum(full[order]) - full[order], full[order])
        seq, done = np.arange(len(row)), len(row)
        cols = [(row, nth, seq, np.zeros(len(row), np.int64), np.full(len(row), window))]
        # remainders: rows of each length in order, dealt out to the patterns
        rest = order[tail[order] > 0]
        by_length: dict[int, list[int]] = {}
        for i, n in zip(rest.tolist(), tail[rest].tolist()):
            by_length.setdefault(n, []).append(i)
        for queue in by_length.values():
            queue.reverse()
        rows, seqs, offsets, sizes = [], [], [], []
        for pattern, times in slack_patterns(tail[rest], window):
            total = sum(k * n for k, n in pattern.items())
            for _ in range(times):
                at = 0
                for k, n in pattern.items():
                    for _ in range(n):
                        rows.append(by_length[k].pop())
                        seqs.append(done)
                        offsets.append(at)
                        sizes.append(total)
                        at += k
                done += 1
        rows = np.array(rows, np.int64)
        cols.append((rows, full[rows], np.array(seqs, np.int64), np.array(offsets, np.int64), np.array(sizes, np.int64)))
        row, nth, seq, offset, size = (np.concatenate(x).astype(np.int64) for x in zip(*cols))
        start = nth * window
        crcs = table["crcs"].combine_chunks()
        at = crcs.offsets.to_numpy()[row] + nth
        padded = np.where(size & (size - 1) == 0, size, window)
        return pa.table({
            "doc_id": table["_id"].combine_chunks().take(pa.array(row)), "start": start, "length": np.minimum(window, tokens[row] - start),
            "ids_crc32": crcs.values.take(pa.array(at)), "doc_tokens": tokens[row], "sequence_id": (np.int64(shard) << np.int64(32)) + seq,
            "offset": offset, "sequence_tokens": size, "padding": padded - size,
        })

    return run


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padding long"


def pack_sequences(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048,
                   end_id: int = 1, shard_rows: int = SHARD_ROWS, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """One row per piece: where its ids start in the document and where they lie in which sequence.

    The tokenizer must not join characters across ASCII white space and must drop it (a word tokenizer).
    """
    spark = df.sparkSession
    C.ship(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())  # of the vocabulary's size
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text"))
    tokens = source.mapInArrow(_tokenise(definition, window, end_id, cache_bytes), "_id long, tokens long, crcs array<long>")
    tokens = C.materialise(tokens.withColumn("first_crc", F.element_at("crcs", 1)))  # a few numbers a row
    shards = max(1, math.ceil(tokens.count() / shard_rows))
    # rows that repeat one another are spread, others' shards don't depend on how the table is laid out
    again = tokens.groupBy("_id", "first_crc").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_id").alias("_i"), F.col("first_crc").alias("_c"), F.lit(True).alias("_again"))
    dealt = tokens.join(again, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("first_crc") == F.col("_c")), "left")
    salt = F.when(F.col("_again"), F.monotonically_increasing_id()).otherwise(0)
    dealt = dealt.select("_id", "tokens", "crcs", "first_crc", C.pack_of(F.struct("_id", "first_crc", salt), shards).alias("_shard"))
    return dealt.groupBy("_shard").applyInArrow(_arrange(window), _PIECES)
