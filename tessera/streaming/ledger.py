"""The salary ledger as a keyed stateful stream: each user's answers are applied in their order, whatever batches they come in.

State per user is the salary reached and the answers that wait.  Users are dealt into groups, and a group's state is held together
as packed columns: a batch costs a group's calls, not a user's.  Answers wait until the watermark has passed them, so one that is late by less
than `delay` is still applied in its place; later ones Spark drops.  What a batch changes is written as the batch's own folder of
updates, so a batch that is run again after a failure replaces what it wrote.  salaries() reads the table as the updates
leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..session import ship

#: Users whose state is held together, on average, and groups that there are at least.
GROUP_USERS, FEWEST_GROUPS = 2048, 16
PROVIDER, PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
UPDATES = "userId long, salary int, answers long"
# Least score and the share of the salary that it changes, best first; below all of them a tenth is lost.
STEPS = ((90, 0.10), (75, 0.05), (60, 0.02), (40, -0.05))
_ORDER = ["userId", "ms", "ord", "tie"]


def after(salary, score):
    """rules.apply_change of rules.salary_change, for answers of different users: single precision, halves upwards, losses rounded before they are negated."""
    salary, score = np.asarray(salary, np.int64), np.asarray(score)
    rate = np.select([score >= least for least, _ in STEPS], [r for _, r in STEPS], -0.10)
    part = np.floor((salary.astype(np.float32) * np.abs(rate).astype(np.float32)).astype(np.float64) + 0.5).astype(np.int64)
    return np.maximum(0, np.where(rate > 0, salary + part, salary - part))


def _answers(pdf: pd.DataFrame) -> pa.Table:
    """Rows as columns of one kind whatever pandas took them for; a null fails."""
    text = pdf["tie"].map(type).eq(str).any()
    kinds = pa.schema([pa.field(c, pa.string() if c == "tie" and text else pa.int64(), False) for c in (*_ORDER, "score")])
    return pa.Table.from_pandas(pdf[kinds.names], kinds, preserve_index=False)


def _pack(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _unpack(held: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(held)).read_all()


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _salaries(users, salary, answers) -> pa.Table:
    return pa.table({"userId": pa.array(users, pa.int64()), "salary": pa.array(salary, pa.int64()).cast(pa.int32()), "answers": pa.array(answers, pa.int64())})


def _apply(held: pa.Table, ready: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The salaries after answers that are sorted by user and order, and those of them that had one; the nth answers of all users go at once."""
    user, score = _column(ready, "userId"), _column(ready, "score")
    own, first, many = np.unique(user, return_index=True, return_counts=True)
    users = np.union1d(_column(held, "userId"), own)
    salary, answers = np.zeros(len(users), np.int64), np.zeros(len(users), np.int64)
    known = np.searchsorted(users, _column(held, "userId"))
    salary[known], answers[known] = _column(held, "salary"), _column(held, "answers")
    at = np.searchsorted(users, own)
    most = np.argsort(-many, kind="stable")
    at, first, many = at[most], first[most], many[most]
    left = len(at)
    for n in range(int(many[0]) if len(many) else 0):
        while many[left - 1] <= n:
            left -= 1
        salary[at[:left]] = after(salary[at[:left]], score[first[:left] + n])
    answers[at] += many
    every = _salaries(users, salary, answers)
    return every, every.take(pa.array(np.sort(at)))


class _Ledger(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.salary = handle.getValueState("salary", "held binary")
        self.waiting = handle.getListState("waiting", "held binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        first = initialState.drop_duplicates("userId").sort_values("userId")
        self.salary.update((_pack(_salaries(first["userId"], first["salary"], np.zeros(len(first), np.int64))),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [_answers(pdf) for pdf in rows]
        if came:
            table = pa.concat_tables(came).sort_by([(c, "ascending") for c in _ORDER])
            self.waiting.appendValue((_pack(table),))
            self.handle.registerTimer(int(_column(table, "ms").min()))  # the next one is set when this one has expired
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        held = [_unpack(bytes(r[0])) for r in self.waiting.get()]
        if not held:  # another of this batch's timers has applied them
            return
        waiting = pa.concat_tables(held)
        passed = _column(waiting, "ms") <= upto
        if not passed.any():
            return
        ready = waiting.filter(pa.array(passed)).sort_by([(c, "ascending") for c in _ORDER])
        before = _unpack(bytes(self.salary.get()[0])) if self.salary.exists() else _salaries([], [], [])
        every, changed = _apply(before, ready)
        if passed.all():
            self.waiting.clear()
        else:
            rest = waiting.filter(pa.array(~passed))
            self.waiting.put([(_pack(rest),)])
            self.handle.registerTimer(int(_column(rest, "ms").min()))
        self.salary.update((_pack(every),))
        yield changed.to_pandas()

    def close(self) -> None:
        pass


def follow(answers: DataFrame, users: DataFrame, path: str, checkpoint: str, delay: str = "7 days", available_now: bool = True) -> StreamingQuery:
    """answers: a stream of (userId long, at timestamp, ord long, score int), in order of (at, ord), and of tie (a string or number) if there is such a column; users: (userId, salary), which start the table at path.

    Answers of users that aren't known begin at 0; those of no user (null) aren't anyone's and aren't applied.  State lies in RocksDB, as what waits may be large.
    The number of groups is that of the users the table began with over GROUP_USERS, so a group's size doesn't grow with them.
    """
    spark = answers.sparkSession
    ship(spark)
    base = f"{path.rstrip('/')}/base"
    users.select(F.col("userId").cast("long").alias("userId"), F.coalesce(F.col("salary").cast("int"), F.lit(0)).alias("salary")).write.mode("ignore").parquet(base)
    began = spark.read.parquet(base)
    groups = max(FEWEST_GROUPS, -(-began.count() // GROUP_USERS))
    group = F.pmod(F.xxhash64("userId"), F.lit(groups)).cast("int").alias("part")
    tie = F.lit("")
    if "tie" in answers.columns:
        kind = answers.schema["tie"].dataType.simpleString()
        tie = F.coalesce("tie", F.lit("" if kind == "string" else 0).cast(kind))
    keyed = answers.where("userId IS NOT NULL").select(group, "userId", "at", F.unix_millis("at").alias("ms"), "ord", tie.alias("tie"), F.coalesce("score", F.lit(0)).alias("score")).withWatermark("at", delay).groupBy("part")
    changed = keyed.transformWithStateInPandas(_Ledger(), UPDATES, outputMode="Update", timeMode="EventTime", initialState=began.where("userId IS NOT NULL").select(group, "userId", "salary").groupBy("part"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/updates/batch={number}")

    writer = changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    own = {PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", PARTITIONS: str(min(groups, 2 * spark.sparkContext.defaultParallelism, int(spark.conf.get(PARTITIONS))))}  # a stream keeps what it started with; a task costs the start of its worker
    before = {name: spark.conf.get(name, None) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        return writer.trigger(availableNow=True).start() if available_now else writer.start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def salaries(spark: SparkSession, path: str) -> DataFrame:
    """(userId, salary, answers) as all updates leave them; the last batch that names a user counts, a user's last update in it."""
    base = spark.read.parquet(f"{path.rstrip('/')}/base").select("userId", "salary", F.lit(0).cast("long").alias("answers"), F.lit(-1).cast("long").alias("batch"))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/updates")
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        updates = spark.read.schema(f"{UPDATES}, batch long").option("basePath", f"{path.rstrip('/')}/updates").parquet(f"{path.rstrip('/')}/updates")
        base = base.unionByName(updates.select("userId", "salary", "answers", "batch"))
    return base.groupBy("userId").agg(F.max_by(F.struct("salary", "answers"), F.struct("answers", "batch")).alias("x")).select("userId", "x.*")
