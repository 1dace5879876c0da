"""Exact values at ranks of groups of any size, by histograms of histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoints

#: Parts of a range that are counted at once, and rows of the bounds up to which they are sent to all tasks.
PARTS, FEW_BOUNDS = 1024, 100_000


def nearest_ranks(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, *shares): of each group the long at ceil(share * n) of its values in order, as rules.nearest_rank; null values don't count, and a group
    of nothing else has 0.

    Each pass counts the values of the range that still is in question in PARTS parts of equal width and goes on with the part
    that holds the rank, until a part is one value: a pass per PARTS-fold of the widest group's range, at most 7.  What is shuffled are
    counts, PARTS per group and share, which are added up before; no task holds a group's values.
    """
    spark = rows.sparkSession
    checkpoints(spark)
    data = rows.select(F.col(by).alias("_g"), F.col(value).cast("long").alias("_v"))
    groups = data.groupBy("_g").agg(F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).checkpoint()
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))).cast("long")
    every = F.explode(F.array(*[F.struct(F.lit(name).alias("share"), rank(p).alias("rank")) for name, p in shares.items()]))
    bounds = groups.where("n > 0").select("_g", "low", "high", every.alias("x")).select("_g", "low", "high", "x.*").checkpoint()
    small = bounds.count() <= FEW_BOUNDS
    held = F.broadcast if small else lambda df: df.hint("merge")
    # widths as decimals, as a range of longs may not fit a long
    width = F.greatest(F.ceil((F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") + 1) / PARTS), F.lit(1)).cast("decimal(20,0)")
    while not bounds.where("low < high").isEmpty():
        bounds = bounds.withColumn("width", width)
        inside = F.col("d._g").eqNullSafe(F.col("b._g")) & (F.col("d._v") >= F.col("b.low")) & (F.col("d._v") <= F.col("b.high"))
        part = F.floor((F.col("d._v").cast("decimal(20,0)") - F.col("b.low").cast("decimal(20,0)")) / F.col("b.width")).cast("long")
        counts = data.alias("d").join(held(bounds).alias("b"), inside).groupBy("b._g", "b.share", "b.low", "b.high", "b.width", "b.rank", part.alias("part")).agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy("_g", "share").orderBy("part"))
        found = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
        low = F.col("low").cast("decimal(20,0)") + F.col("part") * F.col("width")
        bounds = found.select("_g", low.cast("long").alias("low"), F.least(low + F.col("width") - 1, F.col("high").cast("decimal(20,0)")).cast("long").alias("high"), "share",
                              (F.col("rank") - F.col("upto") + F.col("c")).alias("rank")).checkpoint()
    values = bounds.groupBy("_g").agg(*[F.max(F.when(F.col("share") == name, F.col("low"))).alias(name) for name in shares])
    same = F.col("a._g").eqNullSafe(F.col("v._g"))
    return groups.alias("a").join(held(values).alias("v"), same, "left").select(F.col("a._g").alias(by), "a.n", *[F.coalesce(f"v.{name}", F.lit(0).cast("long")).alias(name) for name in shares])
