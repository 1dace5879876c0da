"""Relational analytics of the quiz game: hot levels, picks, ranking, summaries and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..sources.adapters import active

#: Users of one salary whose positions a task counts at once, by the width of their range of ids.
RANK_IDS = 65_536
OPTIONS = "array<struct<optionName:string,trueAnswer:boolean>>"


def clamp_limit(limit: int, most: int = 50) -> int:
    return max(1, min(limit, most))


def hot_levels(level: DataFrame, user_level: DataFrame, limit: int = 10, direction: str | None = None) -> DataFrame:
    """Levels by plays, priority and id; levels nobody played count 0."""
    shown = active(level)
    if direction:
        shown = shown.where(F.col("direction") == direction)
    plays = active(user_level).groupBy("levelId").agg(F.count(F.lit(1)).alias("playCount"))
    joined = shown.join(plays, shown["id"] == plays["levelId"], "left").withColumn("playCount", F.coalesce("playCount", F.lit(0).cast("long")))
    return joined.select("id", "levelName", "direction", "priority", "source", "playCount").orderBy(F.desc("playCount"), F.desc("priority"), F.desc("id")).limit(clamp_limit(limit))


def _pick_order(seed: str):
    return [F.desc_nulls_last(F.col("source") == "PRESET"), F.md5(F.concat(F.col("id").cast("string"), F.lit(seed))), F.col("id")]


def pick_unanswered(level: DataFrame, user_level: DataFrame, direction: str, user_id: int | None, seed: str) -> DataFrame:
    """One level of the direction that the user hasn't answered, preset ones first, else by a seeded hash; a null user has answered none."""
    answered = active(user_level).where(F.col("userId") == user_id if user_id is not None else F.lit(False)).select("levelId")
    free = active(level).where(F.col("direction") == direction)
    return free.join(answered, free["id"] == answered["levelId"], "left_anti").orderBy(*_pick_order(seed)).limit(1)


def pick_with_fallback(level: DataFrame, user_level: DataFrame, direction: str, user_id: int | None, seed: str, general: str) -> DataFrame:
    """As pick_unanswered, else from the general pool, else no row (the caller has a built-in level)."""
    own = pick_unanswered(level, user_level, direction, user_id, seed).withColumn("step", F.lit(1))
    pool = pick_unanswered(level, user_level, general, user_id, seed).withColumn("step", F.lit(2))
    return own.unionByName(pool).orderBy("step").limit(1)


def pick_unanswered_all(level: DataFrame, user_level: DataFrame, users: DataFrame, seed: str) -> DataFrame:
    """(userId, direction, levelId) for every user and direction with a level left.

    Levels get their place in the pick order once per direction; a user's pick is the first place missing
    among the places answered, so users never meet all levels.
    """
    place = Window.partitionBy("direction").orderBy(*_pick_order(seed))
    placed = active(level).withColumn("place", F.row_number().over(place)).select("direction", F.col("id").alias("levelId"), "place")
    done = active(user_level).select("userId", "levelId").distinct().join(placed, "levelId").select("userId", "direction", "place")
    nth = F.row_number().over(Window.partitionBy("userId", "direction").orderBy("place"))
    gaps = done.withColumn("n", nth).groupBy("userId", "direction").agg(
        F.coalesce(F.min(F.when(F.col("place") != F.col("n"), F.col("n"))), F.count(F.lit(1)) + 1).alias("place"))
    directions = placed.select("direction").distinct()
    everyone = users.select(F.col("id").alias("userId")).crossJoin(F.broadcast(directions))  # directions: a handful of names
    first = everyone.join(gaps, ["userId", "direction"], "left").withColumn("place", F.coalesce("place", F.lit(1)))
    return first.join(placed, ["direction", "place"]).select("userId", "direction", "levelId")


def salary_ranking(user: DataFrame, limit: int | None = None) -> DataFrame:
    """Users by salary with their position; ties by id.

    With a limit the sort is a distributed top-k; without one, positions are counted in steps: users of higher salaries, those of
    the same one in smaller ranges of RANK_IDS ids, and a number within the range, so that no task holds all users of a salary.
    """
    shown = active(user)
    if limit is not None:
        top = shown.orderBy(F.desc_nulls_last("salary"), "id").limit(limit)
        return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc_nulls_last("salary"), "id")))
    part = F.floor(F.col("id") / RANK_IDS)
    counts = shown.groupBy("salary", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    so_far = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_salary = counts.groupBy("salary").agg(F.sum("n").alias("n"))
    of_salary = of_salary.select("salary", so_far(Window.orderBy(F.desc_nulls_last("salary"))).alias("richer"))  # a row per salary
    within = counts.withColumn("before", so_far(Window.partitionBy("salary").orderBy("part"))).drop("n")
    offset = within.alias("w").join(of_salary.alias("s"), F.col("w.salary").eqNullSafe(F.col("s.salary"))).select("w.salary", "w.part", (F.col("before") + F.col("richer")).alias("before"))
    joined = shown.withColumn("_part", part).alias("u").join(offset.alias("o"), F.col("u.salary").eqNullSafe(F.col("o.salary")) & (F.col("u._part") == F.col("o.part")))
    place = F.row_number().over(Window.partitionBy("u.salary", "u._part").orderBy("u.id"))
    return joined.select(*[f"u.{c}" for c in shown.columns], (F.col("o.before") + place).cast("long").alias("position"))


def answer_summary(user: DataFrame, user_level: DataFrame) -> DataFrame:
    """Per user: answers, mean score (one decimal), sum of changes at the current salary; zeros without answers."""
    own = active(user_level).groupBy(F.col("userId").alias("id")).agg(
        F.count(F.lit(1)).alias("answers"), R.one_decimal(F.avg(F.coalesce("score", F.lit(0)))).alias("mean_score"), F.sum(F.coalesce("score", F.lit(0))).alias("score_sum"))
    zero = {"answers": 0, "mean_score": 0.0, "score_sum": 0}
    return active(user).join(own, "id", "left").na.fill(zero).select(F.col("id").alias("userId"), F.coalesce("salary", F.lit(0)).alias("salary"), *zero)


def answer_history(user_level: DataFrame, level: DataFrame) -> DataFrame:
    """Answers with their level's name (null if it is gone) and place in the user's history, newest first."""
    names = active(level).select(F.col("id").alias("levelId"), "levelName")
    newest = Window.partitionBy("userId").orderBy(F.desc("createTime"), F.desc("ord"))
    return active(user_level).join(names, "levelId", "left").withColumn("nth", F.row_number().over(newest))


def option_names(level: DataFrame) -> DataFrame:
    """Levels with the names of their options, without what is true."""
    return level.withColumn("optionNames", F.transform(F.from_json("options", OPTIONS, {"mode": "FAILFAST"}), lambda o: o.optionName)).drop("options")


def correct_options(level: DataFrame) -> DataFrame:
    true = F.filter(F.from_json("options", OPTIONS, {"mode": "FAILFAST"}), lambda o: F.coalesce(o.trueAnswer, F.lit(False)))
    return level.withColumn("trueOptions", F.transform(true, lambda o: o.optionName))


def submit_answers(answers: DataFrame, level: DataFrame, user: DataFrame) -> DataFrame:
    """Grades answers (userId, levelId, userOptions array) and gives the salary each leads to."""
    truth = correct_options(active(level)).select(F.col("id").alias("levelId"), "trueOptions")
    paid = active(user).select(F.col("id").alias("userId"), F.coalesce("salary", F.lit(0)).alias("salary"))
    graded = answers.join(truth, "levelId").join(paid, "userId").withColumn("g", R.local_grade(F.col("trueOptions"), F.col("userOptions")))
    change = R.salary_change(F.col("g.score"), F.col("salary"))
    return graded.select("userId", "levelId", "g.*", R.grade_text(F.col("g.score")).alias("verdict"), R.grade_reason(F.col("g")).alias("reason"), change.alias("salaryChange"), R.apply_change(F.col("salary"), change).alias("newSalary"))


def salary_ledger(user: DataFrame, user_level: DataFrame) -> DataFrame:
    """Salary after replaying each user's answers in order; the fold is per user, as each change depends on the last."""
    played = active(user_level).groupBy("userId").agg(F.array_sort(F.collect_list(F.struct("createTime", "ord", "score"))).alias("log"))
    start = active(user).select(F.col("id").alias("userId"), "salary")
    scores = F.coalesce(F.transform("log", lambda x: x.score), F.array().cast("array<int>"))
    return start.join(played, "userId", "left").select("userId", "salary", R.final_salary(F.col("salary"), scores).alias("final_salary"))
