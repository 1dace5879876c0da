"""Line deduplication over the whole corpus, with SQL functions only.

A line's key is the line without ASCII white space at its ends, A-Z in lower case.  Keys of at least `min_chars` code points that
at least `min_docs` documents hold lose all their lines but those of one document: that of the largest id, or of the smallest.

Lines are 128-bit hashes of their keys beside their document's id, a fingerprint of its text and their position: no text is shuffled for
its lines.  They are written once.  Hashes are counted with partial aggregation; those with more than 1 / HOT of all lines
are HOT at most, so they can be broadcast, and what is to be known of them (how many documents, which one is kept) is a count of
distinct ids, which Spark spreads over (key, id) before it merges.  All others are range-partitioned by hash, sorted by
document and position behind it, and streamed: the first document of a hash keeps its lines.  No task holds more than that
share of the lines for one key.

The result is the keep bitmap of each document, run-length coded: the runs (start, length) of the lines that stay.
kept_text() applies it to a text in one pass.

Nulls, ties and odd rows: a null or empty text is one empty line.  Rows with one id are one document: their lines count together,
each row has its own bitmap, and rows equal in id and text have equal ones.  Rows without an id count as one document that comes
before all others.  Repeated lines of one document count once and stay or go together.  Very long texts are taken whole;
their lines are rows of their own.  Other columns may have any name.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: A key with more than 1 / HOT of all lines, and over FEW of them, is one of at most HOT hot ones.
HOT, FEW = 10_000, 1000
_WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    """The lines of a text, empty ones included; null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(_WHITE)), _UPPER, _LOWER)


def line_table(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, mark, pos, h1, h2) of each line whose key is long enough; mark tells the texts of one id apart."""
    text = F.col(f"`{text_col}`")
    lines = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("mark"), F.posexplode(split_lines(text)).alias("pos", "line"))
    keyed = lines.select("id", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def repeated_lines(lines: DataFrame, min_docs: int, keep_largest: bool = True) -> DataFrame:
    """(id, mark, pos) of the lines to drop; lines is a written line_table()."""
    share = max(FEW, lines.count() // HOT)
    hot = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share).select("h1", "h2")  # HOT rows at most
    best = F.max("doc") if keep_largest else F.min("doc")
    doc = F.struct("id").alias("doc")  # a struct with a null counts, as a null wouldn't
    some = lines.join(F.broadcast(hot), ["h1", "h2"])
    known = C.materialise(some.select("h1", "h2", doc).groupBy("h1", "h2").agg(F.countDistinct("doc").alias("docs"), best.alias("kept")), HOT)
    of_hot = lines.join(F.broadcast(known), ["h1", "h2"]).where((F.col("docs") >= min_docs) & ~F.col("kept.id").eqNullSafe(F.col("id")))
    rest = lines.join(F.broadcast(known.select("h1", "h2")), ["h1", "h2"], "left_anti")
    order = F.col("id").desc_nulls_last() if keep_largest else F.col("id").asc_nulls_first()
    dealt = rest.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", order, "mark", "pos")
    same = Window.partitionBy("h1", "h2")
    ranked = dealt.withColumn("nth", F.dense_rank().over(same.orderBy(order))).withColumn("docs", F.max("nth").over(same))
    later = ranked.where((F.col("docs") >= min_docs) & (F.col("nth") > 1))
    return of_hot.select("id", "mark", "pos").unionByName(later.select("id", "mark", "pos"))


def keep_runs(dropped: Column, n: Column) -> Column:
    """Runs (start, length) of the numbers below n that aren't in dropped, which is in order."""
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    gaps = F.zip_with(starts, F.concat(dropped, F.array(n)), lambda a, b: F.struct(a.alias("start"), (b - a).alias("length")))
    return F.filter(gaps, lambda g: g["length"] > 0)


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of a text that the runs keep, joined by line ends."""
    both = F.array(F.struct(split_lines(text).alias("lines"), keep.alias("runs")))  # an array, so that the lines are split once
    kept = F.transform(both, lambda b: F.flatten(F.transform(b["runs"], lambda r: F.slice(b["lines"], r["start"] + 1, r["length"]))))
    return F.array_join(kept[0], "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, keep_largest: bool = True) -> DataFrame:
    """(row, n_lines, n_dropped, keep) of each row of docs: the row as a struct, and the runs (start, length) of its lines that stay."""
    C.ship(docs.sparkSession)
    lines = C.materialise(line_table(docs, id_col, text_col, min_chars))
    gone = repeated_lines(lines, min_docs, keep_largest)
    gone = C.materialise(gone.groupBy("id", "mark").agg(F.array_sort(F.collect_set("pos")).alias("gone")).withColumnsRenamed({"id": "of", "mark": "of_mark"}))
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("mark"), F.size(split_lines(text)).alias("n"))
    found = rows.join(gone.hint("merge"), rows["id"].eqNullSafe(gone["of"]) & (rows["mark"] == gone["of_mark"]), "left")
    dropped = F.coalesce("gone", F.array().cast("array<int>"))
    return found.select("row", F.col("n").cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"), keep_runs(dropped, F.col("n")).alias("keep"))
