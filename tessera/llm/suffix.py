"""Removal of repeated passages by a distributed difference-cover suffix sort.

Every byte covered by a `length`-byte string that also starts earlier (smaller id, or same document and
earlier start) goes.  The suffix sort is distributed by content:

1.  Each document is cut into runs of consecutive windows (of `length` bytes) that share their smallest
    `MER`-byte hash.  Equal windows have equal minima, so runs with different minima never hold equal
    windows.  Packs report the minima they hold; a minimum that occurs in one run of the corpus only
    needs no further work, which clears most of a natural text without shipping it.
2.  The texts of the remaining runs go to the hash range of their minimum, each distinct text of a pack
    once.  A minimum of very many distinct texts (`hot`) is split further: its windows go one by one to
    the hash range of their whole content, so that no range fills with one popular passage.
3.  In a range, the suffixes of the gathered texts are sorted by the difference cover {1, 2} modulo 3:
    triples at the sampled positions are sorted and named, the names are sorted recursively, the remaining
    suffixes are merged in, and adjacent suffixes are compared over their first `length` bytes.  The
    recursion ends once names span `length` bytes, as longer prefixes don't matter.
4.  Each class of equal windows keeps its first occurrence; the others are reported to their packs as bits.

Nulls: a null text is empty; a null id sorts after all ids.  Packs take rows by id and text, so rows that share an id are spread;
of rows with one id, the order of packs and rows decides.  Texts shorter than `length` stay whole, long ones are read whole in
slices that overlap.  Other columns are handed through as a struct, whatever their names.  Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Bytes hashed for minima; below the window so that near-by windows share them.
MER = 32
#: A minimum with more distinct run texts than this is split by window content.
HOT = 20_000
#: Hash ranges per pack: the suffixes of one range are sorted in memory.
RANGES = 4
_CHUNK = 1 << 18
#: Low bits of a minimum that hold its place in the chunk: windows share a run only with one place of their minimum,
#: so the windows of one run never equal each other, and text that repeats itself gives several runs of one minimum.
_PLACE = np.uint64(20)
_LAST = (1 << 63) - 1


# ---------------------------------------------------------------- suffix sort in one range

def _names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 1, and how many there are."""
    order = np.argsort(keys)
    s = keys[order]
    step = np.ones(len(s), bool)
    step[1:] = s[1:] != s[:-1]
    rank = np.empty(len(s), np.int64)
    rank[order] = np.cumsum(step)
    return rank, int(step.sum())


def _pair(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return (a << bits) | b


def suffix_order(s: np.ndarray, need: int, span: int = 1) -> np.ndarray:
    """Suffixes of s (integers from 0, of which each stands for `span` symbols) in the order of their first
    `need` symbols at least; those that agree so far come in any order, next to each other."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    bits = max(int(s.max()).bit_length(), n.bit_length()) + 1
    p = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    if 3 * bits > 62:  # a pair of symbols gets a name first
        pair = np.zeros(n + 3, np.int64)
        pair[:n] = _names(_pair(p[:n], p[1 : n + 1], bits))[0]
    else:
        pair = np.zeros(n + 3, np.int64)
        pair[:n] = _pair(p[:n], p[1 : n + 1], bits)
    names, count = _names(_pair(pair[sample], p[sample + 2], bits))
    if count == len(sample) or span * 3 >= need:
        order = sample[np.argsort(names)]
    else:
        cut = len(one)
        below = suffix_order(np.concatenate([names[:cut], [0], names[cut:]]), need, span * 3)
        below = below[below != cut]
        order = sample[np.where(below > cut, below - 1, below)]
    rank = np.zeros(n + 3, np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    rest = np.arange(0, n, 3)
    by_one = _pair(p, np.append(rank[1:], 0), bits)
    rest = rest[np.argsort(by_one[rest])]
    mod = order % 3
    before = np.searchsorted(by_one[order[mod == 1]], by_one[rest])
    by_two = _pair(pair, np.append(rank[2:], [0, 0]), bits)
    before += np.searchsorted(by_two[order[mod == 2]], by_two[rest])
    before = np.maximum.accumulate(before)
    out = np.empty(n, np.int64)
    at = before + np.arange(len(rest))
    out[at] = rest
    free = np.ones(n, bool)
    free[at] = False
    out[free] = order
    return out


def window_classes(parts: list[bytes], length: int) -> np.ndarray:
    """Class of each window of `length` bytes in each part, in order; equal windows have equal classes."""
    size = np.array([len(x) for x in parts], np.int64)
    joined = b"\0".join(parts) + b"\0" * 16
    raw = np.frombuffer(joined, np.uint8)
    s = raw[: len(joined) - 15].astype(np.int64) + 1
    end = np.cumsum(size + 1) - 1
    s[end] = 0
    wanted = np.zeros(len(s) + 1, np.int64)
    np.add.at(wanted, end - size, 1)
    np.add.at(wanted, end - length + 1, -1)
    window = np.cumsum(wanted)[:-1] > 0
    order = suffix_order(s, length)
    order = order[window[order]]
    same = np.ones(max(0, len(order) - 1), bool)
    words = np.lib.stride_tricks.as_strided(raw[:8].view(np.uint64), (len(raw) - 7,), (1,))
    for at in [*range(0, length - 7, 8), length - 8] if length >= 8 else []:
        w = words[order + at]
        same &= w[1:] == w[:-1]
    for at in range(length if length < 8 else 0):
        w = raw[order + at]
        same &= w[1:] == w[:-1]
    cls = np.empty(len(s), np.int64)
    cls[order] = np.concatenate([[0], np.cumsum(~same)]) if len(order) else 0
    return cls[: len(s)][window]


# ---------------------------------------------------------------- runs of a pack

def runs(items: list[bytes], length: int, mer: int):
    """Arrays (document, start, windows, minimum, text hash) of all runs, by document and start."""
    got: list[list[np.ndarray]] = []
    wide = length - mer + 1
    for chunk in C.pieces(items, _CHUNK, length - 1):
        chunk = [x for x in chunk if len(x[2]) >= length]
        if not chunk:
            continue
        buf = np.frombuffer(b"".join(x[2] for x in chunk), np.uint8)
        size = np.array([len(x[2]) for x in chunk], np.int64)
        end = np.cumsum(size)
        roll = C.Rolling(buf)
        hashed = C.mix(roll.every(mer)) >> _PLACE << _PLACE
        low, reach = hashed | np.arange(len(hashed), dtype=np.uint64), 1
        while reach * 2 <= wide:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if wide > reach:
            low = np.minimum(low[: len(low) - (wide - reach)], low[wide - reach :])
        owner = np.repeat(np.arange(len(chunk)), size)[: len(low)]
        inside = np.arange(len(low)) + length <= end[owner]
        step = np.ones(len(low), bool)
        step[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
        at = np.flatnonzero(step)
        upto = np.append(at[1:], len(low))
        keep = inside[at]
        at, upto = at[keep], upto[keep]
        who = owner[at]
        index, base = (np.array([x[k] for x in chunk], np.int64) for k in (0, 1))
        got.append([index[who], at - (end - size)[who] + base[who], upto - at, C.mix(low[at] >> _PLACE),
                    C.mix(roll.of(at, upto + length - 1) + (upto - at).astype(np.uint64))])
    if not got:
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
    return [np.concatenate(x) for x in zip(*got)]


class Pack:
    """A pack's rows in the order of their ids, and its runs."""

    def __init__(self, table: pa.Table, length: int, mer: int):
        self.ids = C.longs(table["_id"], _LAST)
        self.order = np.argsort(self.ids, kind="stable")
        every = C.texts(table["_text"])
        self.items = [every[i] for i in self.order.tolist()]
        self.ids = self.ids[self.order]
        self.length, self.mer = length, mer
        self.doc, self.start, self.n, self.low, self.text = runs(self.items, length, mer)
        self.keys, self.key_of = np.unique(self.low, return_inverse=True)

    def report(self) -> tuple[np.ndarray, np.ndarray]:
        """For each minimum: whether its windows may repeat here, and its distinct texts."""
        again = np.bincount(self.key_of, minlength=len(self.keys)) > 1
        _, first = np.unique(self.text, return_index=True)
        return again.astype(np.uint8), np.bincount(self.key_of[first], minlength=len(self.keys)).astype(np.uint32)

    def suspects(self, codes: np.ndarray):
        """Entries to be sorted: (document, start, windows, key, text hash), hot runs window by window."""
        code = codes[self.key_of] if len(self.keys) else np.zeros(0, np.uint8)
        pick = np.flatnonzero(code == 1)
        out = [x[pick] for x in (self.doc, self.start, self.n, self.low, self.text)]
        hot = np.flatnonzero(code == 2)
        if len(hot):
            n = self.n[hot]
            doc = np.repeat(self.doc[hot], n)
            start = np.repeat(self.start[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            key = np.empty(len(doc), np.uint64)
            for a, b in _groups(doc):
                roll = C.Rolling(np.frombuffer(self.items[doc[a]], np.uint8))
                key[a:b] = C.mix(roll.of(start[a:b], start[a:b] + self.length) + np.uint64(1))
            split = [doc, start, np.ones(len(doc), np.int64), key, key]
            out = [np.concatenate(x) for x in zip(out, split)]
            order = np.lexsort((out[1], out[0]))
            out = [x[order] for x in out]
        return out


def _groups(sorted_ids: np.ndarray):
    at = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
    return zip(at.tolist(), [*at[1:].tolist(), len(sorted_ids)])


def _replies(table: pa.Table, kind: int) -> list[bytes]:
    """Blobs of a kind by bucket."""
    rows = [(b, x) for k, b, x in zip(*(table[c].to_pylist() for c in ("kind", "bucket", "data"))) if k == kind]
    return [x for _, x in sorted(rows, key=lambda r: r[0])]


def _codes(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(_replies(table, 0)), np.uint8)


def _distinct(entries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First entry of each distinct (key, text), ordered by key; the place there of each entry."""
    _, first, back = np.unique(C.mix(entries[4] ^ C.mix(entries[3])), return_index=True, return_inverse=True)
    order = np.argsort(entries[3][first], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return first[order], place[back]


_KEYS = "bucket int, pack int, keys binary, again binary, texts binary"
_REPLY = "pack int, kind int, bucket int, data binary"
_ENTRIES = "bucket int, pack int, ids binary, starts binary, windows binary, keys binary, hashes binary, data binary"


def _stages(length: int, mer: int, hot: int, buckets: int, schema: pa.Schema):
    """The functions of the plan: of a pack, a range, a pack, a range and a pack."""
    as_text = pa.types.is_string(schema.field("kept").type)

    def report(table: pa.Table) -> pa.Table:
        pack, number = Pack(table, length, mer), table["_pack"][0].as_py()
        again, count = pack.report()
        rows = [(b, number, pack.keys[i:j].tobytes(), again[i:j].tobytes(), count[i:j].tobytes())
                for b, i, j in C.cuts(C.bucket_of(pack.keys, buckets))]
        return C.arrow_table(rows, ("int32", "int32", "binary", "binary", "binary"), ("bucket", "pack", "keys", "again", "texts"))

    def judge(table: pa.Table) -> pa.Table:
        blobs = table["keys"].to_pylist()
        keys = np.frombuffer(b"".join(blobs), np.uint64)
        again = np.frombuffer(b"".join(table["again"].to_pylist()), np.uint8)
        count = np.frombuffer(b"".join(table["texts"].to_pylist()), np.uint32)
        _, back, packs = np.unique(keys, return_inverse=True, return_counts=True)
        repeated = (packs > 1) | (np.bincount(back, again) > 0)
        code = repeated.astype(np.uint8) + (repeated & (np.bincount(back, count) > hot))
        code, at, rows = code.astype(np.uint8)[back], 0, []
        for b, p, x in zip(table["bucket"].to_pylist(), table["pack"].to_pylist(), blobs):
            rows.append((p, 0, b, code[at : at + len(x) // 8].tobytes()))
            at += len(x) // 8
        return C.arrow_table(rows, ("int32", "int32", "int32", "binary"), ("pack", "kind", "bucket", "data"))

    def submit(table: pa.Table, replies: pa.Table) -> pa.Table:
        names = ("bucket", "pack", "ids", "starts", "windows", "keys", "hashes", "data")
        rows: list[tuple] = []
        if table.num_rows:
            pack, number = Pack(table, length, mer), table["_pack"][0].as_py()
            entries = pack.suspects(_codes(replies))
            first, _ = _distinct(entries)
            doc, start, n, key, text = (x[first] for x in entries)
            for b, i, j in C.cuts(C.bucket_of(key, buckets)):
                data = b"".join(pack.items[d][a : a + w + length - 1] for d, a, w in zip(doc[i:j].tolist(), start[i:j].tolist(), n[i:j].tolist()))
                rows.append((b, number, pack.ids[doc[i:j]].tobytes(), start[i:j].tobytes(), n[i:j].astype(np.uint32).tobytes(), key[i:j].tobytes(), text[i:j].tobytes(), data))
        return C.arrow_table(rows, ("int32", "int32", *["binary"] * 6), names)

    def settle(table: pa.Table) -> pa.Table:
        cols = {c: table[c].to_pylist() for c in ("ids", "starts", "windows", "keys", "hashes", "data")}
        ids, start = (np.frombuffer(b"".join(cols[c]), np.int64) for c in ("ids", "starts"))
        key, text = (np.frombuffer(b"".join(cols[c]), np.uint64) for c in ("keys", "hashes"))
        n = np.frombuffer(b"".join(cols["windows"]), np.uint32).astype(np.int64)
        each = [len(x) // 4 for x in cols["windows"]]
        number = np.repeat(np.array(table["pack"].to_pylist()), each)
        data = b"".join(cols["data"])
        upto = np.cumsum(n + length - 1)
        order = np.lexsort((start, number, ids))  # as the whole corpus is ordered
        _, first, back = np.unique(C.mix(text[order] ^ C.mix(key[order])), return_index=True, return_inverse=True)
        rank = np.argsort(first)  # distinct texts in the order of their first occurrences
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        distinct = np.empty(len(n), np.int64)
        distinct[order] = place[back]
        chief = order[first[rank]]
        # a minimum with one distinct text needs no sorting, as its windows differ
        _, at, many = np.unique(key[chief], return_inverse=True, return_counts=True)
        sort = many[at] > 1
        windows = n[chief]
        ends = np.cumsum(windows)
        later = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        if sort.any():
            cls = window_classes([data[upto[i] - n[i] - length + 1 : upto[i]] for i in chief[sort].tolist()], length)
            _, lead = np.unique(cls, return_index=True)
            mark = np.ones(len(cls), np.uint8)
            mark[lead] = 0
            later[np.repeat(sort, windows)] = mark
        rows, at = [], 0
        is_chief = np.zeros(len(n), bool)
        is_chief[chief] = True
        for b, p, size in zip(table["bucket"].to_pylist(), table["pack"].to_pylist(), each):
            own = np.arange(at, at + size)
            bits = np.ones(int(n[own].sum()), np.uint8)
            to = np.cumsum(n[own])
            for i, e in zip(own.tolist(), to.tolist()):
                if is_chief[i]:
                    d = distinct[i]
                    bits[e - n[i] : e] = later[ends[d] - windows[d] : ends[d]]
            rows.append((p, 1, b, np.packbits(bits).tobytes()))
            at += size
        return C.arrow_table(rows, ("int32", "int32", "int32", "binary"), ("pack", "kind", "bucket", "data"))

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        pack = Pack(table, length, mer)
        entries = pack.suspects(_codes(replies))
        first, place = _distinct(entries)
        doc, start, n, key, _ = entries
        windows = n[first]
        bits = np.zeros(int(windows.sum()), np.uint8)
        at = 0
        for (_, i, j), blob in zip(C.cuts(C.bucket_of(key[first], buckets)), _replies(replies, 1), strict=True):
            size = int(windows[i:j].sum())
            bits[at : at + size] = np.unpackbits(np.frombuffer(blob, np.uint8), count=size)
            at += size
        ends = np.cumsum(windows)
        is_first = np.zeros(len(n), bool)
        is_first[first] = True
        total = int(n.sum())
        offset = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        who, begin = np.repeat(doc, n), np.repeat(start, n) + offset
        hit = np.where(np.repeat(is_first, n), bits[np.repeat((ends - windows)[place], n) + offset] if total else bits, 1) > 0
        who, begin = who[hit], begin[hit]
        # maximal removed runs
        step = np.ones(len(who), bool)
        step[1:] = (who[1:] != who[:-1]) | (begin[1:] > begin[:-1] + length)
        left = np.flatnonzero(step)
        right = np.append(left[1:], len(who)) - 1
        spans: dict[int, list[tuple[int, int]]] = {}
        if len(who):
            for d, a, b in zip(who[left].tolist(), begin[left].tolist(), (begin[right] + length).tolist()):
                spans.setdefault(d, []).append((a, b))
        back = np.argsort(pack.order)
        kept, cut = [], []
        for d in back.tolist():
            x, own = pack.items[d], spans.get(d, [])
            if own:
                edge = [0, *(e for s in own for e in s), len(x)]
                x = b"".join(x[edge[k] : edge[k + 1]] for k in range(0, len(edge), 2))
            kept.append(x.decode("utf-8", "ignore") if as_text else x)
            cut.append([{"start": a, "end": b} for a, b in own])
        return pa.table([table["_row"].combine_chunks(), table["_id"].combine_chunks(),
                         pa.array([len(pack.items[d]) for d in back.tolist()], pa.int64()),
                         pa.array(cut, schema.field("spans").type), pa.array(kept, schema.field("kept").type)],
                        schema=pa.schema([table.schema.field("_row"), table.schema.field("_id"), *[schema.field(i) for i in (2, 3, 4)]]))

    return tuple(map(C.lean, (report, judge, submit, settle, remove)))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100,
                   mer: int = MER, hot: int = HOT, pack_bytes: int = C.PACK_BYTES, as_text: bool = False) -> DataFrame:
    """df's rows with row (a struct of the other columns), id, n_bytes, spans (removed, in bytes) and kept (binary, or
    with as_text a string without the bytes of characters that were cut)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if length < mer:
        mer = max(1, length // 2)
    C.ship(df.sparkSession)
    packs = C.pack_count(df, text_col, pack_bytes)
    tasks = C.task_count(packs)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col])
    dealt = df.select(C.pack_of(F.struct(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), packs).alias("_pack"), F.col(f"`{id_col}`").cast("long").alias("_id"),
                      F.col(f"`{text_col}`").cast("binary").alias("_text"), row.alias("_row")).repartition(tasks, "_pack")
    added = T.StructType.fromDDL("n_bytes long, spans array<struct<start: long, end: long>>, kept " + ("string" if as_text else "binary"))
    out = T.StructType([*dealt.select("_row", "_id").schema.fields, *added.fields])
    report, judge, submit, settle, remove = _stages(length, mer, hot, RANGES * packs, to_arrow_schema(out))
    keys = dealt.groupBy("_pack").applyInArrow(report, _KEYS).repartition(tasks, "bucket")
    answers = keys.groupBy("bucket").applyInArrow(judge, _REPLY).repartition(tasks, "pack")
    entries = dealt.groupBy("_pack").cogroup(answers.groupBy("pack")).applyInArrow(submit, _ENTRIES).repartition(tasks, "bucket")
    settled = entries.groupBy("bucket").applyInArrow(settle, _REPLY).repartition(tasks, "pack")
    both = answers.unionByName(settled)  # both dealt by pack already
    done = dealt.groupBy("_pack").cogroup(both.groupBy("pack")).applyInArrow(remove, out)
    return done.withColumnsRenamed({"_row": "row", "_id": "id"})
