"""Scoring rules of the game and the rounding they use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import or_default


def half_up(c: Column) -> Column:
    """Nearest integer, halves upwards, also below zero (Spark's round goes away from zero there)."""
    return F.floor(c.cast("double") + 0.5).cast("long")


def one_decimal(c: Column) -> Column:
    return F.floor(c * 10 + 0.5).cast("double") / 10


def local_grade(true_set: Column, user_set: Column) -> Column:
    """struct(correct, wrong, missed, score): 100 * (correct - wrong) / all true, within 0 and 100; arrays count as sets."""
    t, u = F.array_distinct(true_set), F.array_distinct(user_set)
    n, good = F.size(t), F.size(F.array_intersect(u, t))
    wrong = F.size(u) - good
    score = F.when(n <= 0, F.lit(0)).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), half_up((good - wrong) * 100.0 / n))))
    return F.struct(good.alias("correct"), wrong.alias("wrong"), (n - good).alias("missed"), score.cast("int").alias("score"))


def grade_text(score: Column) -> Column:
    return F.when(score >= 60, F.lit("passed")).otherwise(F.lit("not passed"))


def grade_reason(grade: Column) -> Column:
    """The counts of a local_grade in words."""
    return F.format_string("Graded locally: %d of %d right options chosen, %d wrong, %d missed.", grade["correct"], grade["correct"] + grade["missed"], grade["wrong"], grade["missed"])


def answer_text(standard: Column, true_options: Column) -> Column:
    """A level's own answer text, else one that names the right options."""
    return or_default(standard, F.concat(F.lit("Right options: "), F.array_join(true_options, ", "), F.lit(".")))


def salary_change(score: Column, salary: Column) -> Column:
    """Steps by score in single precision; a loss is rounded before it is negated."""
    part = lambda rate: half_up(salary.cast("float") * F.lit(rate).cast("float")).cast("int")
    return (F.when(score >= 90, part(0.10)).when(score >= 75, part(0.05)).when(score >= 60, part(0.02)).when(score >= 40, -part(0.05)).otherwise(-part(0.10)))


def apply_change(salary: Column, change: Column) -> Column:
    return F.greatest(F.lit(0), salary + change)


def final_salary(start: Column, scores: Column) -> Column:
    """Salary after an ordered array of scores: each change depends on the salary reached."""
    return F.aggregate(scores, start.cast("int"), lambda s, x: apply_change(s, salary_change(x, s)).cast("int"))


def nearest_rank(c: Column, p: float) -> Column:
    """Aggregate: the value at ceil(p n) of the sorted values; 0 without values."""
    return F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c._jc.toString()})").cast("long"), F.lit(0).cast("long"))
