"""Mixing sources to target weights by Pareto order sampling.

A source of N words with target T is taken T/N times on average: every document gets the whole part of T/N
as certain copies, and the rest of the target is drawn as an unequal-probability sample without
replacement.  Document i of the source has inclusion probability p_i in proportion to its boost (a column or a function of
its size), scaled so that the words expected are those wanted; where that would exceed 1 it is 1, and the others share
what is left.  With a uniform number u_i from a hash of its id and text it is ranked by the random odds divided by the
inclusion odds, (u/(1-u)) / (p/(1-p)), and the sample is the shortest prefix whose words come nearest to the words wanted.

Rows of one source, id and text are numbered, and the number goes into the hash, so each is drawn by itself.  Which of
them has which number doesn't matter, as they are equal; so they are numbered within the partitions of a written table, behind what
the partitions before hold, and no group comes into one task.

The prefix is found without sorting a source: ranks are mapped to [0, 1), words are summed by source and
1/1024th, the one part that holds the boundary is split again, and only the rows of that part of a part
are put in order.  No task sees more than about a millionth of a source.

Nulls and ties: a null text has size 0; a null source is a source of its own, last in order; rows without an id are told apart
by their texts, and numbered as others.  A source of no words has target 0 and isn't taken.  Long texts are
counted whole; other columns aren't read, whatever their names.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

PARTS = 1024
#: Keys of several rows up to which they are sent to all rows.
FEW_TWINS = 100_000


def words_of(text: Column) -> Column:
    """Number of maximal runs of other characters than ASCII white space; null has none."""
    @F.arrow_udf("long")
    def count(col):
        import pyarrow as pa

        return pa.array([len(x.split()) if x else 0 for x in col.to_pylist()], pa.int64())

    return count(text.cast("binary"))


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the key."""
    digest = F.substring(F.md5(F.concat(F.lit(seed), key).cast("binary")), 1, 13)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sized: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """(source, source_size, target): weights by the order of code points, null last, capped and reshared.

    One row per source and windows over all of them: the number of sources bounds the work.
    """
    every = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    w = F.element_at(cycle, (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    every = every.withColumn("w", w)
    # the sources that reach their cap are those with the least size for their weight
    filled = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_rows = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(all_rows)
    left = total - max_repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    share = F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0))
    every = every.withColumns({"total": total, "full": max_repeats * F.col("source_size") * share <= left * F.col("w")})
    size_left = F.col("total") - max_repeats * F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(all_rows)
    w_left = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(all_rows)
    target = F.when(F.col("full"), (max_repeats * F.col("source_size")).cast("double")).otherwise(
        (size_left * F.col("w")).cast("double") / w_left.cast("double"))
    return every.select("source", "source_size", target.alias("target"))


def _rank(boost: Column, key: Column, seed: str) -> Column:
    """The Pareto rank on [0, 1): r/(1+r) of r = odds(u)/odds(p)."""
    u, p = uniform(key, seed), F.least(F.col("scale") * boost, F.lit(1 - 1e-9))
    r = (u / (1 - u)) / (p / (1 - p))
    return F.when(F.col("rest") > 0, r / (1 + r))


def scales(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """goal with scale: what a boost is multiplied by to be an inclusion probability, so that a source's expected words are its rest.

    Probabilities that reach 1 stay there and the others are scaled anew, until none is new: a round per class of boosts at
    most, each an aggregate of sized.
    """
    same = F.col("d.source").eqNullSafe(F.col("g.source"))
    goal = goal.withColumn("scale", F.lit(0.0))
    while True:
        certain = F.col("g.scale") * F.col("d.boost") >= 1
        sums = sized.alias("d").join(goal.alias("g"), same).groupBy("g.source").agg(
            F.sum(F.when(certain, F.col("d.size")).otherwise(0)).alias("full"), F.sum(F.when(~certain, F.col("d.size") * F.col("d.boost")).otherwise(0.0)).alias("weight"))
        scale = F.when(F.col("d.weight") > 0, F.greatest(F.col("g.scale"), (F.col("g.rest") - F.col("d.full")) / F.col("d.weight"))).otherwise(F.col("g.scale"))
        new = C.materialise(goal.alias("g").join(sums.alias("d"), same, "left").select("g.source", "g.source_size", "g.target", "g.whole", "g.rest", F.coalesce(scale, F.col("g.scale")).alias("scale"),
                                                                                       (F.coalesce(scale, F.col("g.scale")) > F.col("g.scale")).alias("more")))
        goal = new.drop("more")
        if new.where("more").isEmpty():
            return goal


def numbered(rows: DataFrame, twins: DataFrame | None = None) -> DataFrame:
    """rows (source, key, more) with a number in the keys of those that share source and key, but for the first.

    twins: the keys that several rows have, a written table of (source, key), if it is known; equal rows may change numbers
    from run to run, the numbers of all of them don't.
    """
    twins = repeated(rows) if twins is None else twins
    many = twins.count()
    if not many:
        return rows
    held = F.broadcast(twins) if many <= FEW_TWINS else twins.hint("merge")
    on = F.col("d.source").eqNullSafe(F.col("w.source")) & (F.col("d.key") == F.col("w.key"))
    some = C.materialise(rows.alias("d").join(held.alias("w"), on, "left_semi").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    upto = Window.partitionBy("source", "key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = some.groupBy("source", "key", "_part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy("source", "key", "_part").orderBy("_at"))
    on = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.key") == F.col("p.key")) & (F.col("d._part") == F.col("p._part"))
    placed = some.withColumn("_nth", nth).alias("d").join(parts.hint("merge").alias("p"), on).select("d.*", (F.col("d._nth") - 1 + F.col("p.before")).alias("_place"))
    key = F.when(F.col("_place") > 0, F.concat("key", F.lit("/"), F.col("_place").cast("string"))).otherwise(F.col("key"))
    placed = placed.withColumn("key", key).select(rows.columns)
    on = F.col("d.source").eqNullSafe(F.col("w.source")) & (F.col("d.key") == F.col("w.key"))
    return rows.alias("d").join(held.alias("w"), on, "left_anti").unionByName(placed)


def repeated(rows: DataFrame) -> DataFrame:
    """(source, key) of those that several rows have, written."""
    return C.materialise(rows.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("source", "key"))


def plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """One row per source: source_size, target, whole (certain copies) and the last rank that is taken (t, key).

    sized: (source, key, size, boost).
    """
    goal = targets(sized, weights, max_repeats).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = (goal.withColumn("rest", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")))
    goal = scales(sized, C.materialise(goal))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    ranked = sized.alias("d").join(goal.where("rest > 0").alias("g"), same("d", "g")).select("d.source", "d.key", "d.size", "d.boost", "g.rest", "g.scale")
    ranked = ranked.withColumn("t", _rank(F.col("boost"), F.col("key"), seed)).select("source", "key", "size", "rest", "t")

    def boundary(rows: DataFrame, scale: int) -> DataFrame:
        """(source, part, low, need): the part in which a source's words reach the rest."""
        summed = rows.groupBy("source", "rest", F.floor(F.col("t") * scale).alias("part")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("part"))
        summed = summed.withColumns({"upto": upto, "low": upto - F.col("words")})
        first = F.row_number().over(Window.partitionBy("source").orderBy("part"))
        return summed.where("upto >= rest and low < rest").withColumn("n", first).where("n = 1").select("source", "part", (F.col("rest") - F.col("low")).alias("need"))

    def within(rows: DataFrame, bound: DataFrame, scale: int) -> DataFrame:
        on = same("r", "b") & (F.floor(F.col("r.t") * scale) == F.col("b.part"))
        return rows.alias("r").join(bound.alias("b"), on).select("r.source", "r.key", "r.size", F.col("b.need").alias("rest"), "r.t")

    coarse = C.materialise(boundary(ranked, PARTS))
    inner = within(ranked, coarse, PARTS)
    fine = C.materialise(boundary(inner, PARTS * PARTS))
    last = within(inner, fine, PARTS * PARTS).groupBy("source", "rest", "t", "key").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("t", "key"))
    last = last.withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    chosen = last.groupBy("source").agg(F.max(F.struct("t", "key")).alias("last"))
    ends = fine.alias("f").join(chosen.alias("c"), same("f", "c"), "left").select(
        "f.source", F.coalesce(F.col("c.last.t"), F.col("f.part") / F.lit(float(PARTS * PARTS))).alias("t_last"), F.col("c.last.key").alias("key_last"))
    return C.materialise(goal.alias("g").join(ends.alias("e"), same("g", "e"), "left").select(
        "g.source", "g.source_size", "g.target", "g.whole", "g.rest", "g.scale", F.coalesce("e.t_last", F.lit(-1.0)).alias("t_last"), "e.key_last"))


def copies(sized: DataFrame, planned: DataFrame, seed: str = "mix") -> DataFrame:
    """sized with source_size, target and copies (how often each document is taken)."""
    joined = sized.alias("d").join(planned.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    joined = joined.select("d.*", "p.source_size", "p.target", "p.whole", "p.rest", "p.scale", "p.t_last", "p.key_last")
    t = _rank(F.col("boost"), F.col("key"), seed)
    more = (t < F.col("t_last")) | ((t == F.col("t_last")) & (F.col("key") <= F.col("key_last")))
    n = F.col("whole") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)
    return joined.withColumn("copies", n.cast("long")).drop("whole", "rest", "scale", "t_last", "key_last")


def prefer_ordinary(size: Column) -> Column:
    """A boost: fragments and very long documents are drawn half as often as others."""
    return F.when((size < 50) | (size > 5000), F.lit(0.5)).otherwise(F.lit(1.0))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", boost: str | Callable[[Column], Column] | None = None,
                weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix", keep_rows: bool = False) -> DataFrame:
    """(id, source, size, source_size, target, copies) of every row; with keep_rows also row, a struct of df's columns.

    boost: the name of a column, or a function of the size.
    """
    C.ship(df.sparkSession)
    named, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    key = F.concat(F.coalesce(named.cast("string"), F.lit("")), F.lit("#"), F.md5(F.coalesce(text.cast("binary"), F.lit("").cast("binary"))))
    cols = [named.alias("id"), F.col(f"`{source_col}`").alias("source"), key.alias("key"), words_of(text).alias("size")]
    cols += [F.col(f"`{boost}`").cast("double").alias("boost")] if isinstance(boost, str) else []

    def boosted(rows: DataFrame) -> DataFrame:
        return rows if isinstance(boost, str) else rows.withColumn("boost", boost(F.col("size")) if boost else F.lit(1.0))

    small = C.materialise(df.select(*cols))
    twins = repeated(small)
    small = boosted(numbered(small, twins))
    planned = plan(small, weights, max_repeats, seed)
    rows = boosted(numbered(df.select(*cols, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")), twins)) if keep_rows else small
    return copies(rows, planned, seed).drop("key", "boost")


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mixed corpus: each row as often as it is taken."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
