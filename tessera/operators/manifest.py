"""Index lifecycle: fingerprints, comparison with the manifest, incremental and full rebuilds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunk
from .bm25 import left_in, left_out

KEY = ["source_key", "source_value"]


@dataclass(frozen=True)
class Header:
    collection: str | None
    size: int = chunk.SIZE
    overlap: int = chunk.OVERLAP
    splitter: str = "windows"

    @property
    def cut(self) -> tuple[int, int, str]:
        return self.size, self.overlap, self.splitter


def full_rebuild_reason(previous: Header | None, collection: str, size: int, overlap: int, splitter: str = "windows") -> str | None:
    """Why everything must be rebuilt, checked in this order; None if a comparison is enough."""
    if previous is None or not (previous.collection or "").strip():
        return "the manifest names no collection"
    if previous.collection != collection:
        return f"the manifest belongs to collection {previous.collection}"
    if (previous.size, previous.overlap) != (size, overlap):
        return f"chunks were {previous.size} with overlap {previous.overlap}"
    if previous.splitter != splitter:
        return f"chunks were cut by {previous.splitter}"
    return None


def rebuild_reason(previous: dict[str, Column], collection: Column, size: Column, overlap: Column, splitter: Column) -> Column:
    """full_rebuild_reason() of a row: previous has the columns collection, size, overlap and splitter of a header (a null collection: there is none)."""
    return (F.when(T.blank(previous["collection"]), "the manifest names no collection")
            .when(previous["collection"] != collection, F.concat(F.lit("the manifest belongs to collection "), previous["collection"]))
            .when((previous["size"] != size) | (previous["overlap"] != overlap), F.concat(F.lit("chunks were "), previous["size"].cast("string"), F.lit(" with overlap "), previous["overlap"].cast("string")))
            .when(previous["splitter"] != splitter, F.concat(F.lit("chunks were cut by "), previous["splitter"])))


def first_of_key(sources: DataFrame) -> DataFrame:
    """Sources configured twice: the first by ord counts."""
    named = sources.where(" AND ".join(f"{c} IS NOT NULL" for c in (*KEY, "ord")))
    again = named.groupBy(*KEY).agg(F.min("ord").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    later = named.select(*KEY, "ord").join(again, KEY).where("ord <> _first").select(*KEY, "ord")
    return left_out(named, later, [*KEY, "ord"])  # texts aren't shuffled


def diff(previous: DataFrame, current: DataFrame, failed: DataFrame) -> DataFrame:
    """(key, status, old_count, ord) per key: added, changed, unchanged, removed, or failed (known, not loaded now: left alone)."""
    p = previous.select(*KEY, F.col("fingerprint").alias("old"), F.col("chunk_count").alias("old_count"), F.col("ord").alias("p_ord"))
    c = current.select(*KEY, F.col("fingerprint").alias("new"), F.col("ord").alias("c_ord"))
    joined = p.join(c, KEY, "full_outer").join(failed.select(*KEY).distinct().withColumn("lost", F.lit(True)), KEY, "left")
    status = (F.when(F.col("new").isNotNull() & F.col("old").isNull(), "added").when(F.col("new").isNotNull() & (F.col("old") != F.col("new")), "changed")
              .when(F.col("new").isNotNull(), "unchanged").when(F.coalesce("lost", F.lit(False)), "failed").otherwise("removed"))
    return joined.select(*KEY, status.alias("status"), "old_count", F.coalesce("c_ord", "p_ord").alias("ord"))


def summary(compared: DataFrame) -> DataFrame:
    """One row of counts; nothing_to_do if all is unchanged or failed."""
    n = {s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(s) for s in ("added", "changed", "removed", "unchanged", "failed")}
    return compared.agg(*n.values()).withColumn("nothing_to_do", (F.col("added") == 0) & (F.col("changed") == 0) & (F.col("removed") == 0))


def chunks_of(sources: DataFrame, size: int = chunk.SIZE, overlap: int = chunk.OVERLAP, splitter: str = "windows") -> DataFrame:
    """(chunk_id, key, chunk_idx, chunk_text) of sources (key, text)."""
    cut = chunk.chunk_texts(sources.select(*KEY, "text"), "text", size, overlap, splitter)
    return cut.select(T.chunk_id(F.col("source_key"), F.col("source_value"), F.col("chunk_idx")).alias("chunk_id"), *KEY, "chunk_idx", "chunk_text")


def apply_to_chunks(old_chunks: DataFrame, compared: DataFrame, current: DataFrame, size: int = chunk.SIZE, overlap: int = chunk.OVERLAP, splitter: str = "windows") -> DataFrame:
    """The chunk table after the comparison: rows of removed and changed keys go, those of added and changed come."""
    gone = compared.where("status IN ('removed', 'changed')").select(*KEY)
    wanted = compared.where("status IN ('added', 'changed')").select(*KEY)
    fresh = left_in(current, wanted, KEY, wanted.count())
    return left_out(old_chunks, gone, KEY).unionByName(chunks_of(fresh, size, overlap, splitter)).select(old_chunks.columns)


def apply_to_manifest(previous: DataFrame, compared: DataFrame, current: DataFrame) -> DataFrame:
    """The manifest after the comparison; a key that stays keeps its place, new ones come behind in their order."""
    keep = previous.join(compared.where("status IN ('unchanged', 'failed')").select(*KEY), KEY, "left_semi").select(*KEY, "fingerprint", "chunk_count", F.lit(0).alias("late"), "ord")
    touched = compared.where("status IN ('added', 'changed')").select(*KEY, F.when(F.col("status") == "added", 1).otherwise(0).alias("late"))
    places = previous.select(*KEY, F.col("ord").alias("old_ord"))
    fresh = current.join(touched, KEY).join(places, KEY, "left").select(*KEY, "fingerprint", "chunk_count", "late", F.coalesce("old_ord", "ord").alias("ord"))
    return keep.unionByName(fresh)


def skip_accounting(compared: DataFrame, current: DataFrame) -> DataFrame:
    """(total, embedded, skipped) chunks of a run."""
    work = compared.where("status IN ('added', 'changed')").select(*KEY).withColumn("embed", F.lit(True))
    joined = current.join(work, KEY, "left")
    total, done = F.coalesce(F.sum("chunk_count"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("embed"), F.col("chunk_count"))), F.lit(0))
    return joined.agg(total.alias("total"), done.alias("embedded")).withColumn("skipped", F.col("total") - F.col("embedded"))


def total_chunks(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"))


def current_sources(manifest: DataFrame) -> DataFrame:
    return manifest.select("source_value").distinct()


def parse_manifest(lines: DataFrame, line: str = "value") -> DataFrame:
    """Entries of 'source|key|value|fingerprint|count' lines; malformed ones, empty fingerprints and counts below 1 are skipped."""
    f = F.split(F.col(line), r"\|", -1)
    count = F.coalesce(F.expr(f"try_cast(element_at(split(`{line}`, '\\\\|', -1), -1) AS INT)"), F.lit(0))
    entry = lines.where((F.size(f) == 5) & (f[0] == "source"))
    return entry.select(f[1].alias("source_key"), f[2].alias("source_value"), f[3].alias("fingerprint"), count.alias("chunk_count")).where("fingerprint <> '' AND chunk_count > 0")


def parse_header(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row (collection, chunk, overlap) of the 'name=value' lines; numbers that aren't are 0."""
    def named(name: str):
        return F.max(F.when(F.startswith(F.col(line), F.lit(f"{name}=")), F.substring(F.col(line), len(name) + 2, (1 << 31) - 1)))

    raw = lines.agg(named("collection").alias("collection"), named("chunk").alias("c"), named("overlap").alias("o"))
    return raw.select("collection", F.coalesce(F.expr("try_cast(c AS INT)"), F.lit(0)).alias("chunk"), F.coalesce(F.expr("try_cast(o AS INT)"), F.lit(0)).alias("overlap"))


def format_manifest(manifest: DataFrame) -> DataFrame:
    """(value, ord): the lines of the entries, whose parse gives them back."""
    return manifest.select(F.concat_ws("|", F.lit("source"), *KEY, "fingerprint", F.col("chunk_count").cast("string")).alias("value"), "ord")


def parse_collection_meta(content: DataFrame, text: str = "text") -> DataFrame:
    """(collection, segments) of 'collection=', 'segments=' texts, or of a single older line (segments null)."""
    t = F.col(text)
    named = t.rlike(r"(?m)^collection=")
    name = F.when(named, F.regexp_extract(t, r"(?m)^collection=([^\n]*)", 1)).otherwise(T.java_trim(t))
    count = F.when(named, F.expr(f"try_cast(regexp_extract(`{text}`, '(?m)^segments=([^\\\\n]*)', 1) AS INT)"))
    return content.withColumns({"collection": name, "segments": count})


def format_collection_meta(name: Column, segments: Column) -> Column:
    """The two lines that parse_collection_meta reads."""
    return F.concat(F.lit("collection="), name, F.lit("\nsegments="), segments.cast("string"), F.lit("\n"))


@dataclass
class Store:
    """Versions of a chunk table and its manifest in one folder; a pointer table names the current version and is written last."""

    spark: SparkSession
    path: str

    def version(self) -> int:
        try:
            return self.spark.read.parquet(f"{self.path}/pointer").agg(F.max("version")).first()[0] or 0
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return 0
            raise

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version()}/{name}")

    def publish(self, chunks: DataFrame, manifest: DataFrame, header: Header) -> int:
        new = self.version() + 1
        chunks.write.mode("overwrite").parquet(f"{self.path}/v{new}/chunks")
        manifest.write.mode("overwrite").parquet(f"{self.path}/v{new}/manifest")
        self.spark.createDataFrame([(header.collection, *header.cut)], "collection string, chunk int, overlap int, splitter string").write.mode("overwrite").parquet(f"{self.path}/v{new}/header")
        meta = manifest.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("segments"))
        meta.select(format_collection_meta(F.lit(header.collection or ""), F.col("segments")).alias("text")).coalesce(1).write.mode("overwrite").text(f"{self.path}/v{new}/meta")
        self.spark.createDataFrame([(new,)], "version int").write.mode("append").parquet(f"{self.path}/pointer")
        return new

    def meta(self) -> DataFrame:
        """(collection, segments) as the current version's meta file says."""
        return parse_collection_meta(self.spark.read.text(f"{self.path}/v{self.version()}/meta", wholetext=True).withColumnRenamed("value", "text")).select("collection", "segments")

    def header(self) -> Header | None:
        return Header(*self.read("header").first()) if self.version() else None


def status(store: Store) -> DataFrame:
    """What the index holds, one row: collection, version, how it is cut, chunks (by its manifest), sources and written_chunks; none if there is no version."""
    header, version = store.header(), store.version()
    if header is None:
        return store.spark.createDataFrame([], "collection string, version int, size int, overlap int, splitter string, chunks long, sources long, written_chunks long")
    held = store.read("manifest").agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.count(F.lit(1)).alias("sources"))
    known = [F.lit(x).alias(n) for n, x in zip(("collection", "version", "size", "overlap", "splitter"), (header.collection, version, *header.cut))]
    return held.join(store.read("chunks").agg(F.count(F.lit(1)).alias("written_chunks"))).select(*known, "chunks", "sources", "written_chunks")  # a row each


def reconcile(previous: DataFrame, current: DataFrame, failed: DataFrame, same_collection: bool = True) -> DataFrame:
    """What a start finds, one row: the counts of the comparison, whether index and sources agree (in_sync), and the index's
    size in chunks: the manifest's if it is of the collection in use, else that of the sources as they are now."""
    size = previous if same_collection else current
    compared = summary(diff(previous, current, failed)).withColumnRenamed("nothing_to_do", "in_sync")
    return compared.join(size.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("index_size")))  # a row each


@dataclass(frozen=True)
class RebuildStatus:
    mode: str
    reason: str | None
    version: int
    counts: dict[str, int]


def rebuild(store: Store, sources: DataFrame, failed: DataFrame, header: Header, full: bool = False, after: Callable[[], None] | None = None) -> RebuildStatus:
    """Brings the store up to sources (key, text, ord): incrementally, or all anew if asked for or needed.

    after: called once something new is published, such as a cache's clear_all.

    A full rebuild keeps what failed to load now, as an incremental one does, if the old version fits; nothing is
    written if nothing changed.
    """
    now = first_of_key(sources).withColumns({"fingerprint": T.fingerprint(F.col("text")), "chunk_count": chunk.chunk_count(F.col("text"), *header.cut)})
    old = store.header()
    reason = "asked for" if full else full_rebuild_reason(old, header.collection or "", *header.cut)
    if reason:
        manifest = now.select(*KEY, "fingerprint", "chunk_count", F.lit(1).alias("late"), "ord")
        version = store.publish(chunks_of(now, *header.cut), manifest, header)
        if after:
            after()
        return RebuildStatus("full", reason, version, {"added": manifest.count()})
    before = store.read("manifest")
    compared = diff(before, now, failed).persist()
    try:
        counts = summary(compared).first().asDict()
        if counts.pop("nothing_to_do"):
            return RebuildStatus("none", None, store.version(), counts)
        version = store.publish(apply_to_chunks(store.read("chunks"), compared, now, *header.cut), apply_to_manifest(before, compared, now), header)
        if after:
            after()
        return RebuildStatus("incremental", None, version, counts)
    finally:
        compared.unpersist()
