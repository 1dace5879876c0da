"""An index of immutable segments: chunks, vectors and postings that updates add to and never rewrite.

An update writes one segment: the chunks, vectors and postings of the sources that came or changed, their manifest entries,
and a list of what it ends in earlier segments.  A row is live unless a list of a later segment names it, so what an update
writes grows with what changed, not with the index.  Vectors are made, and written, before anything is ended; a source for which
the model fails keeps its old chunks and its old entry, and the next update tries it again.

A version is a small JSON file that names its segments with their counts.  It is moved into its place by a rename that fails if the
place is taken: of two writers one loses and begins again from the other's version.  Readers hold on to the version they opened.

Segments of about one size are merged once there are `FAN` of them, or when half of one is dead, so a row is rewritten about
log(rows) times.  vacuum() deletes segments that no kept version names.

A segment's chunks lie in blocks; a posting list is a term's places in one block and how often it is there, and the segment's docs tell
which chunk a place is.  So a posting takes a few bytes, and what ends a chunk is looked up by its place.  Vectors lie beside their chunks' texts.

Keyword search counts equal texts once, wherever they are: docs carry the digest of their text, whose copies have the
same terms, so the least live chunk of a digest stands for it.  How many distinct texts there are, and
how long they are, is carried from version to version by the digests that an update touches.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import checkpoints, ship
from ..sources.versions import Conflict, Versions
from . import bm25, chunk, embed
from . import manifest as M
from . import retrieve as R

#: Segments of about one size that are merged, entries of the lists of ended sources up to which they are broadcast, bytes of text of a block, and lists that are packed at once.
FAN, FEW_GONE, BLOCK, PIECE = 8, 500_000, 1 << 23, 1 << 17
#: How a segment's tables are compressed: chunks overlap and vectors are mostly zeros.
CODEC = "zstd"
_KEY = "source_key string, source_value string"
_TABLES = {
    "texts": f"seg int, {_KEY}, chunk_id string, chunk_idx int, chunk_text string, vector array<double>",
    "docs": f"seg int, {_KEY}, block long, place int, chunk_id string, digest binary, dl int",
    "lists": "seg int, term string, block long, places array<int>, tfs array<int>",
    "sources": f"seg int, {_KEY}, fingerprint string, chunk_count int, born int, ord long",
    "gone": f"{_KEY}, before int, chunks int",
}
_BLOCKS = f"kind string, block long, place int, {_KEY}, chunk_id string, digest binary, dl int, term string, places array<int>, tfs array<int>"
_AT = ["seg", "block"]


@dataclass(frozen=True)
class Segment:
    number: int
    chunks: int
    gone: int  # chunks that it ends
    ended: int = 0  # entries of its list of ended sources


@dataclass(frozen=True)
class Version:
    number: int = 0
    header: M.Header | None = None
    segments: tuple[Segment, ...] = ()
    texts: int = 0  # distinct live texts
    tokens: int = 0  # of those

    def json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of(d: dict) -> Version:
        return Version(d["number"], M.Header(**d["header"]), tuple(Segment(**s) for s in d["segments"]), d["texts"], d["tokens"])


@dataclass(frozen=True)
class UpdateStatus:
    """mode: full, incremental or none; failures: sources whose vectors couldn't be made, which stay as they were."""

    mode: str
    reason: str | None
    version: int
    counts: dict[str, int] = field(default_factory=dict)
    failures: int = 0
    merged: int = 0


class SegmentStore:
    """Segments and versions in one folder of a file system that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._versions = Versions(spark, f"{self.path}/versions")

    # ------------------------------------------------------------ files

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._p("").getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        fs, where = self._fs(), self._p(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def versions(self) -> list[int]:
        return self._versions.numbers()

    def read_version(self, number: int) -> Version:
        return Version.of(self._versions.read(number))

    def current(self) -> Version:
        found = self._versions.last()
        return Version.of(found) if found else Version()

    def version(self) -> int:
        return self.current().number

    def header(self) -> M.Header | None:
        return self.current().header

    def claim(self, version: Version) -> None:
        """Publishes a version, or raises Conflict if its number is taken."""
        self._versions.claim(version.number, version.json())

    def new_segment(self) -> int:
        """A number that no segment has or had; its folder is made by the call, which one writer wins."""
        fs = self._fs()
        number = 1 + max((int(n[1:]) for n in self._names("segments") if n.startswith("s")), default=0)
        while True:
            marker = self._p(f"segments/s{number:08d}/_claimed")
            try:
                fs.create(marker, False).close()
                return number
            except Exception as e:
                if "exist" not in str(e).lower():
                    raise
                number += 1

    def at(self, segment: int, table: str) -> str:
        return f"{self.path}/segments/s{segment:08d}/{table}"

    def delete(self, path: str) -> None:
        self._fs().delete(self._jvm.org.apache.hadoop.fs.Path(path), True)

    def rename(self, path: str, to: str) -> None:
        if not self._fs().rename(self._jvm.org.apache.hadoop.fs.Path(path), self._jvm.org.apache.hadoop.fs.Path(to)):
            raise OSError(f"{path} can't be renamed to {to}")

    def move(self, path: str, to: str) -> None:
        """Renames a table's folder; a table without rows, whose folder isn't there, becomes an empty one."""
        fs, of = self._fs(), self._jvm.org.apache.hadoop.fs.Path
        if fs.exists(of(path)):
            self.rename(path, to)
        else:
            fs.mkdirs(of(to))

    def vacuum(self, keep: int = 2, after: float = 3600) -> list[int]:
        """Deletes versions but the last `keep`, and the segments that these don't name and that were begun `after` seconds ago or earlier, so that no
        writer is at them any more; returns their numbers."""
        known = self.versions()
        if not known:
            return []
        for n in known[:-keep]:
            self._versions.drop(n)
        used = {s.number for n in known[-keep:] for s in self.read_version(n).segments}
        fs, limit, gone = self._fs(), (time.time() - after) * 1000, []
        for s in fs.listStatus(self._p("segments")):
            number = int(s.getPath().getName()[1:])
            if number not in used and s.getModificationTime() <= limit:
                fs.delete(s.getPath(), True)
                gone.append(number)
        return sorted(gone)

    # ------------------------------------------------------------ tables

    def table(self, version: Version, name: str) -> DataFrame:
        """The rows of a table in all segments of a version, ended ones included."""
        paths = [self.at(s.number, name) for s in version.segments]
        return self.spark.read.schema(_TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], _TABLES[name])

    def live(self, version: Version, name: str) -> DataFrame:
        """The rows of a table that no later segment ended.  chunks and vectors are those of texts, postings (term, chunk_id, digest, tf, dl) those of lists."""
        if name == "chunks":
            return self.live(version, "texts").drop("vector")
        if name == "vectors":
            return self.live(version, "texts").where("vector IS NOT NULL").select("seg", "chunk_id", "vector")
        if name == "postings":
            lists = self.table(version, "lists").select(*_AT, "term", F.explode(F.arrays_zip("places", "tfs")).alias("p"))
            placed = lists.select(*_AT, "term", F.col("p.places").alias("place"), F.col("p.tfs").cast("long").alias("tf"))
            return placed.join(self.live(version, "docs"), [*_AT, "place"]).select("seg", "term", "chunk_id", "digest", "tf", "dl")
        return without(self.table(version, name), self.table(version, "gone"), M.KEY, sum(s.ended for s in version.segments))

    def firsts(self, version: Version) -> DataFrame:
        """(seg, block, place, chunk_id, dl) of the least live chunk of each text."""
        first = F.min(F.struct("chunk_id", *_AT, "place", "dl")).alias("d")
        return self.live(version, "docs").groupBy("digest").agg(first).select(*[f"d.{c}" for c in (*_AT, "place", "chunk_id", "dl")])

    def manifest(self, version: Version) -> DataFrame:
        return self.live(version, "sources").drop("seg")

    def corpus(self, version: Version | None = None, embedder: embed.Embedder | None = None) -> R.Corpus:
        """What retrieve() searches: a version's live chunks (source: their source's value), vectors and postings."""
        v = version or self.current()
        chunks = self.live(v, "chunks").select("chunk_id", F.col("source_value").alias("source"), F.col("chunk_text").alias("text"))
        return R.Corpus(chunks, self.live(v, "vectors").select("chunk_id", "vector"), SegmentBm25(self, v), embedder)


def without(rows: DataFrame, gone: DataFrame, on: list[str], entries: int) -> DataFrame:
    """rows (seg) that no entry of gone (before) ends; a list of few entries is sent to the rows, others meet them by shuffle."""
    if not entries:
        return rows
    last = gone.groupBy(*on).agg(F.max("before").alias("before"))
    last = F.broadcast(last) if entries <= FEW_GONE else last.hint("merge")
    same = [F.col(f"r.{c}") == F.col(f"g.{c}") for c in on]
    return rows.alias("r").join(last.alias("g"), [*same, F.col("r.seg") < F.col("g.before")], "left_anti")


def _placed(docs: pa.Table, lists: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, list, tf) of a block's postings of these docs, as places in both tables."""
    place, where, sizes = docs.column("place").to_numpy(), lists.column("places").combine_chunks(), lists.column("places").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    at = where.flatten().to_numpy(zero_copy_only=False)
    of = np.full(1 + max(int(place.max(initial=-1)), int(at.max(initial=-1))), -1, np.int64)
    of[place] = np.arange(len(place))
    doc = of[at]
    held = doc >= 0
    return doc[held], np.repeat(np.arange(lists.num_rows), sizes)[held], lists.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)[held]


def _rows_of(docs: pa.Table, lists: pa.Table) -> pa.Table:
    """(chunk_id, dl, terms, tf) of a block's docs that have any of the lists' terms (word)."""
    doc, at, tf = _placed(docs, lists)
    order = np.argsort(doc, kind="stable")
    word, sizes = lists.column("word").to_numpy()[at[order]], np.bincount(doc, minlength=docs.num_rows)
    own = np.flatnonzero(sizes)
    upto = pa.array(np.concatenate([[0], np.cumsum(sizes[own])]).astype(np.int32))
    terms, tfs = (pa.ListArray.from_arrays(upto, pa.array(x.astype(np.int32))) for x in (word, tf[order]))
    few = docs.take(pa.array(own))
    return pa.table([few.column("chunk_id"), few.column("dl"), terms, tfs], names=["chunk_id", "dl", "terms", "tf"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seg, block, piece): lists in compressed pieces of one block each, places as differences; shuffled as rows they take several times as much as in files."""
    held, rows = [], 0
    for batch in batches:
        held, rows = [*held, batch], rows + batch.num_rows
        if rows >= PIECE:
            yield _pieces(held)
            held, rows = [], 0
    if rows:
        yield _pieces(held)


def _pieces(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    seg, block = (table.column(c).to_numpy().astype(np.int64) for c in _AT)
    order = np.lexsort((block, seg))
    new = np.flatnonzero((np.diff(seg[order]) != 0) | (np.diff(block[order]) != 0)) + 1
    out = []
    for own in np.split(order, new):
        lists = table.select(["term", "places", "tfs"]).take(pa.array(own)).combine_chunks()
        places = lists.column("places").combine_chunks()
        apart = pa.ListArray.from_arrays(places.offsets, pa.array(np.diff(places.flatten().to_numpy(), prepend=0).astype(np.int32)))
        sink, how = pa.BufferOutputStream(), {"term": "DELTA_BYTE_ARRAY", "places.list.element": "BYTE_STREAM_SPLIT", "tfs.list.element": "BYTE_STREAM_SPLIT"}
        pq.write_table(lists.set_column(1, "places", apart), sink, compression=CODEC, use_dictionary=False, column_encoding=how)
        out.append((int(seg[own[0]]), int(block[own[0]]), sink.getvalue().to_pybytes()))
    return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))], names=[*_AT, "piece"])


def _unpacked(piece: bytes) -> pa.Table:
    lists = pq.read_table(pa.BufferReader(piece)).combine_chunks()
    apart = lists.column("places").combine_chunks()
    places = pa.array(np.cumsum(apart.flatten().to_numpy(), dtype=np.int64).astype(np.int32))
    return lists.set_column(1, "places", pa.ListArray.from_arrays(apart.offsets, places))


def _counts_of(docs: pa.Table, pieces: pa.Table) -> pa.Table:
    """(term, df, occurrences) of a block's lists among these docs."""
    found = [_unpacked(x.as_py()) for x in pieces.column("piece")]
    if not found:
        return pa.table({"term": pa.array([], pa.string()), "df": pa.array([], pa.int64()), "occurrences": pa.array([], pa.int64())})
    lists = pa.concat_tables(found)
    _, at, tf = _placed(docs, lists)
    df, n = np.bincount(at, minlength=lists.num_rows), np.bincount(at, weights=tf, minlength=lists.num_rows)
    some = df > 0
    return pa.table([lists.column("term").filter(pa.array(some)), pa.array(df[some], pa.int64()), pa.array(n[some].astype(np.int64))], names=["term", "df", "occurrences"])


def term_counts(store: SegmentStore, version: Version) -> DataFrame:
    """(term, df, occurrences) of a version's terms, equal texts once; what is shuffled are docs, packed lists and a count per term and block."""
    ship(store.spark)
    packed = store.table(version, "lists").mapInArrow(_packed, "seg int, block long, piece binary")
    one = store.live(version, "docs").groupBy("digest").agg(F.min(F.struct(*_AT, "place")).alias("d")).select("d.*")  # any one of equal texts
    found = one.groupBy(*_AT).cogroup(packed.groupBy(*_AT)).applyInArrow(_counts_of, "term string, df long, occurrences long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences"))


@dataclass(frozen=True)
class SegmentBm25:
    """BM25 over the postings of a version; as bm25.Bm25Index over its live chunks.  Lists of the terms asked for meet their block's docs; a query never meets postings by a join."""

    store: SegmentStore
    version: Version

    def search(self, queries: DataFrame, n: int, id_cols: list[str] | None = None) -> DataFrame:
        store, v = self.store, self.version
        checkpoints(store.spark)
        ship(store.spark)

        def found(held: bm25.Held) -> DataFrame:
            lists = store.table(v, "lists").join(F.broadcast(held.places().withColumnRenamed("place", "word")), "term").select(*_AT, "word", "places", "tfs")  # words: of about MOST_QUERIES queries
            rows = store.firsts(v).groupBy(*_AT).cogroup(lists.groupBy(*_AT)).applyInArrow(_rows_of, "chunk_id string, dl int, terms array<int>, tf array<int>").checkpoint()
            df = {r["word"]: r["count"] for r in rows.select(F.explode("terms").alias("word")).groupBy("word").count().collect()}  # a row per word
            return held.best(rows, df, v.texts, v.tokens / max(1, v.texts) or 1.0, n)

        return bm25.ranked(queries, id_cols or ["query_id"], n, found)


# ---------------------------------------------------------------- updates

def _write(store: SegmentStore, seg: int, name: str, df: DataFrame, folder: str | None = None) -> None:
    kinds = [c.strip().split(" ") for c in _TABLES[name].split(", ")]
    full = df if "seg" in df.columns or not _TABLES[name].startswith("seg") else df.withColumn("seg", F.lit(seg))
    full.select(*[F.col(c).cast(k).alias(c) for c, k in kinds]).write.parquet(store.at(seg, folder or name), compression=CODEC)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of chunks: a row for each of a block's docs, and one for each of its terms."""
    task, n = TaskContext.get().partitionId(), 0
    kinds = {"kind": pa.string(), "block": pa.int64(), "place": pa.int32(), "source_key": pa.string(), "source_value": pa.string(), "chunk_id": pa.string(), "digest": pa.binary(),
             "dl": pa.int32(), "term": pa.string(), "places": pa.list_(pa.int32()), "tfs": pa.list_(pa.int32())}

    def rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.record_batch([columns[c].cast(k) if c in columns else pa.nulls(size, k) for c, k in kinds.items()], names=list(kinds))

    for whole in batches:
        for batch in bm25.pieces(whole, most=BLOCK):
            block, n = (task << 32) + n, n + 1
            owner, code, tf, words, dl = bm25.counts_of(batch.column("text"))
            order = np.argsort(code, kind="stable")
            sizes = np.bincount(code, minlength=len(words))
            own = np.flatnonzero(sizes)
            upto = pa.array(np.concatenate([[0], np.cumsum(sizes[own])]).astype(np.int32))
            places, tfs = (pa.ListArray.from_arrays(upto, pa.array(x[order].astype(np.int32))) for x in (owner, tf))
            same = lambda kind, size: {"kind": pa.array([kind] * size, pa.string()), "block": pa.array(np.full(size, block))}
            yield rows(len(dl), **same("docs", len(dl)), place=pa.array(np.arange(len(dl))), dl=pa.array(dl), **{c: batch.column(c) for c in ("source_key", "source_value", "chunk_id", "digest")})
            yield rows(len(own), **same("lists", len(own)), term=words.take(pa.array(own)), places=places, tfs=tfs)


def _write_texts(store: SegmentStore, seg: int) -> None:
    """Docs and lists of the texts that segment `seg` holds: each task writes its blocks' once, sorted by term, so nothing is shuffled and nothing is written twice."""
    texts = store.spark.read.schema(_TABLES["texts"]).parquet(store.at(seg, "texts"))
    ship(store.spark)
    said = texts.select(*M.KEY, "chunk_id", F.unhex(F.md5(T.java_trim(F.col("chunk_text")))).alias("digest"), F.col("chunk_text").alias("text"))
    cut = said.mapInArrow(_blocks, _BLOCKS).withColumn("seg", F.lit(seg)).sortWithinPartitions("kind", "term", "block", "place")
    cut.write.partitionBy("kind").parquet(store.at(seg, "cut"), compression=CODEC)
    for name in ("docs", "lists"):
        store.move(store.at(seg, f"cut/kind={name}"), store.at(seg, name))
    store.delete(store.at(seg, "cut"))


def _sizes(gone: DataFrame) -> tuple[int, int]:
    """(chunks that a list ends, its entries)"""
    return gone.agg(F.coalesce(F.sum(F.greatest(F.lit(1), "chunks")), F.lit(0)), F.count(F.lit(1))).first()


def _text_counts(docs: DataFrame) -> tuple[int, int]:
    """(distinct texts, tokens of those)."""
    n, t = docs.groupBy("digest").agg(F.min("dl").alias("dl")).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return n, t


def _stage(store: SegmentStore, seg: int, fresh: DataFrame, header: M.Header, embedder: embed.Embedder | None) -> DataFrame:
    """The chunks of sources with vector and error, written before anything is ended; they are the segment's texts unless some fail."""
    cut = M.chunks_of(fresh, *header.cut)
    said = embed.said(embedder or embed.HashedTerms(), F.col("chunk_text"))
    cut.withColumn("said", said).select(F.lit(seg).alias("seg"), *cut.columns, "said.vector", "said.error").write.parquet(store.at(seg, "texts"), compression=CODEC)
    return store.spark.read.schema(f"{_TABLES['texts']}, error string").parquet(store.at(seg, "texts"))


def update(store: SegmentStore, sources: DataFrame, failed: DataFrame, header: M.Header, embedder: embed.Embedder | None = None, full: bool = False,
           after: Callable[[], None] | None = None, tries: int = 3, named: DataFrame | None = None) -> UpdateStatus:
    """Brings the index up to sources (key, text, ord): incrementally, or all anew if asked for or needed.

    failed: keys that weren't loaded now; they stay as they are.  named: if given, the only keys that are compared; others stay too.  after: called once something new is published.  A full update whose
    vectors can't all be made raises, and the index stays as it was.  If another writer publishes first, all begins again from
    its version, `tries` times at most.
    """
    for left in range(max(1, tries) - 1, -1, -1):
        try:
            done = _update(store, sources, failed, header, embedder, full, named)
            break
        except Conflict:
            if not left:
                raise
    if done.mode != "none":
        done = replace(done, merged=merge(store))
        if after:
            after()
    return done


def _update(store: SegmentStore, sources: DataFrame, failed: DataFrame, header: M.Header, embedder: embed.Embedder | None, full: bool, named: DataFrame | None) -> UpdateStatus:
    base = store.current()
    now = M.first_of_key(sources).withColumns({"fingerprint": T.fingerprint(F.col("text")), "chunk_count": chunk.chunk_count(F.col("text"), *header.cut)})
    reason = "asked for" if full else M.full_rebuild_reason(base.header, header.collection or "", *header.cut)
    if reason:
        base = Version(base.number)  # nothing of it is kept
    before = store.manifest(base)
    compared = M.diff(before if named is None else before.join(named.select(*M.KEY).distinct(), M.KEY, "left_semi"), now, failed).persist()
    seg = store.new_segment()
    try:
        counts = M.summary(compared).first().asDict()
        if counts.pop("nothing_to_do") and not reason:
            store.delete(f"{store.path}/segments/s{seg:08d}")
            return UpdateStatus("none", None, base.number, counts)
        wanted = compared.where("status IN ('added', 'changed')").select(*M.KEY, "status")
        same, n = compared.where("status = 'unchanged'").select(*M.KEY), counts["added"] + counts["changed"]
        fresh = bm25.left_out(now, same, M.KEY) if counts["unchanged"] <= n else bm25.left_in(now, wanted, M.KEY, n)
        staged = _stage(store, seg, fresh, header, embedder)
        checkpoints(store.spark)
        broken = staged.where("error IS NOT NULL").select(*M.KEY).distinct().checkpoint()
        failures = broken.count()
        if failures and reason:
            error = staged.where("error IS NOT NULL").select("source_value", "error").first()
            raise RuntimeError(f"vectors of {failures} sources can't be made, such as {error['source_value']}: {error['error']}")
        if failures:
            _write(store, seg, "texts", bm25.left_out(staged, broken, M.KEY), "good")
            store.delete(store.at(seg, "texts"))
            store.rename(store.at(seg, "good"), store.at(seg, "texts"))
        done = wanted.join(broken, M.KEY, "left_anti") if failures else wanted
        ended = done.where("status = 'changed'").select(*M.KEY).unionByName(compared.where("status = 'removed'").select(*M.KEY)).join(before, M.KEY).select(*M.KEY, "chunk_count")
        _write(store, seg, "gone", ended.select(*M.KEY, F.lit(seg).alias("before"), F.col("chunk_count").alias("chunks")))
        _write_texts(store, seg)
        places = before.select(*M.KEY, F.col("born").alias("_born"), F.col("ord").alias("_ord"))
        entries = now.join(done, M.KEY).join(places, M.KEY, "left")
        _write(store, seg, "sources", entries.select(*M.KEY, "fingerprint", "chunk_count", F.coalesce("_born", F.lit(seg)).alias("born"), F.coalesce("_ord", F.col("ord").cast("long")).alias("ord")))
        read = lambda name: store.spark.read.schema(_TABLES[name]).parquet(store.at(seg, name))
        added, (ended_chunks, entries) = read("docs").count(), _sizes(read("gone"))
        if not (added or entries or reason or read("sources").count()):  # all that came failed
            store.delete(f"{store.path}/segments/s{seg:08d}")
            return UpdateStatus("none", None, base.number, counts, failures)
        new = Version(base.number + 1, header, (*base.segments, Segment(seg, added, ended_chunks, entries)))
        texts, tokens = _counts_after(store, base, new, read("docs"), read("gone"))
        store.claim(replace(new, texts=texts, tokens=tokens))
        return UpdateStatus("full" if reason else "incremental", reason, new.number, counts, failures)
    except BaseException:
        store.delete(f"{store.path}/segments/s{seg:08d}")
        raise
    finally:
        compared.unpersist()


def _counts_after(store: SegmentStore, base: Version, new: Version, fresh: DataFrame, gone: DataFrame) -> tuple[int, int]:
    """Distinct texts and their tokens in the new version: the base's, less and plus those among the digests that the update touches."""
    old = store.live(base, "docs")
    ended = old.join(gone.select(*M.KEY), M.KEY, "left_semi")
    touched = fresh.select("digest").unionByName(ended.select("digest")).distinct()
    was, now = (_text_counts(docs.join(touched, "digest", "left_semi")) for docs in (old, store.live(new, "docs")))
    return base.texts - was[0] + now[0], base.tokens - was[1] + now[1]


# ---------------------------------------------------------------- merging

def due(version: Version, dead: dict[int, int] | None = None) -> list[Segment]:
    """Segments to merge now: FAN or more of one size class, or those of which half is dead."""
    classes: dict[int, list[Segment]] = {}
    for s in version.segments:
        size, k = max(1, s.chunks + s.gone), 0
        while size >= FAN:
            size, k = size // FAN, k + 1
        classes.setdefault(k, []).append(s)
    for k in sorted(classes):
        if len(classes[k]) >= FAN:
            return classes[k]
    return [s for s in version.segments if s.chunks and 2 * (dead or {}).get(s.number, 0) >= s.chunks]


def _maybe_dead(version: Version) -> list[Segment]:
    """Segments of which later ones end enough that half may be dead."""
    later = lambda s: sum(x.gone for x in version.segments if x.number > s.number)
    return [s for s in version.segments if s.chunks and 2 * later(s) >= s.chunks]


def merge(store: SegmentStore, segments: list[Segment] | None = None) -> int:
    """Merges segments (by default those that are due) into one; returns how many.  A merge that loses its version to an update is dropped."""
    version = store.current()
    if segments is None:
        segments = due(version)
        if not segments and (old := _maybe_dead(version)):
            held = without(store.table(replace(version, segments=tuple(old)), "docs"), store.table(version, "gone"), M.KEY, sum(s.ended for s in version.segments))
            living = {r["seg"]: r["count"] for r in held.groupBy("seg").count().collect()}  # a row per segment
            segments = due(version, {s.number: s.chunks - living.get(s.number, 0) for s in old})
    if not segments:
        return 0
    part, rest = replace(version, segments=tuple(segments)), [s for s in version.segments if s not in segments]
    oldest = min((s.number for s in rest), default=None)
    seg = store.new_segment()
    try:
        numbers = [s.number for s in segments]
        for name in ("texts", "sources"):
            _write(store, seg, name, store.live(version, name).where(F.col("seg").isin(numbers)).drop("seg"))
        _write_texts(store, seg)
        # what ends rows of segments that aren't merged stays
        _write(store, seg, "gone", store.table(part, "gone").where(F.lit(False) if oldest is None else F.col("before") > oldest))
        read = lambda name: store.spark.read.schema(_TABLES[name]).parquet(store.at(seg, name))
        store.claim(replace(version, number=version.number + 1, segments=(*rest, Segment(seg, read("docs").count(), *_sizes(read("gone"))))))
        return len(segments)
    except Conflict:
        store.delete(f"{store.path}/segments/s{seg:08d}")
        return 0
    except BaseException:
        store.delete(f"{store.path}/segments/s{seg:08d}")
        raise
