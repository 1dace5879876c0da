"""The ledger as a stream against the fold over all answers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.plans import catalog
from tessera.streaming import ledger

SCHEMA = "userId long, at timestamp, ord long, score int"


def test_steps_are_the_rules(spark):
    r = random.Random(1)
    rows = [(r.choice([0, 1, 5, 10, 999, 12345, 2**24 + 1, r.randint(0, 10**6)]), r.randint(-5, 105)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "salary int, score int")
    found = df.select("salary", "score", rules.apply_change(F.col("salary"), rules.salary_change(F.col("score"), F.col("salary"))).alias("after")).collect()
    assert all(ledger.after(x["salary"], x["score"]) == x["after"] for x in found)


@pytest.mark.parametrize("seed", [0, 1])
def test_any_split_into_batches(spark, tmp_path, seed):
    r, day = random.Random(seed), dt.datetime(2024, 1, 1)
    answers = [(r.randint(1, 6), day + dt.timedelta(days=r.randint(0, 20)), n, r.randint(0, 100)) for n in range(120)] + [(77, day, 500, 95)]
    users = [(u, 1000 * u) for u in range(1, 8)]
    want = {u: (s, 0) for u, s in users} | {77: (0, 0)}
    for u, _, _, score in sorted(answers, key=lambda x: x[1:3]):
        want[u] = (ledger.after(want[u][0], score), want[u][1] + 1)
    r.shuffle(answers)
    cut = sorted(r.sample(range(1, len(answers)), 2))
    batches = [answers[: cut[0]], answers[cut[0] : cut[1]], answers[cut[1] :], [(-1, day + dt.timedelta(days=90), 0, 0)]]
    people = spark.createDataFrame(users, "userId long, salary int")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        ledger.follow(stream, people, f"file://{tmp_path}/table", f"file://{tmp_path}/checkpoint", "30 days").awaitTermination()
    got = {x["userId"]: (x["salary"], x["answers"]) for x in ledger.salaries(spark, f"file://{tmp_path}/table").collect() if x["userId"] != -1}
    assert got == want


def test_answers_of_one_time_and_number_are_told_apart(spark, tmp_path):
    """The tie decides, not the score."""
    day, schema = dt.datetime(2024, 1, 1), SCHEMA + ", tie string"
    rows = [(1, day, 7, 95, "a"), (1, day, 7, 10, "b"), (2, day, 7, 95, "b"), (2, day, 7, 10, "a"), (-1, day + dt.timedelta(days=90), 0, 0, "")]
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        ledger.follow(stream, spark.createDataFrame([(1, 105), (2, 105)], "userId long, salary int"), f"file://{tmp_path}/table", f"file://{tmp_path}/checkpoint", "30 days").awaitTermination()
    got = {x["userId"]: x["salary"] for x in ledger.salaries(spark, f"file://{tmp_path}/table").collect()}
    assert (got[1], got[2]) == (ledger.after(ledger.after(105, 95), 10), ledger.after(ledger.after(105, 10), 95)) and got[1] != got[2]


def test_answers_that_the_sql_leaves_open_go_as_they_lie_in_the_table(spark, tmp_path):
    """Lines of one order and number whose part keys would have it the other way round, in one file and in two."""
    day = dt.date(2024, 1, 1)
    lines = [(1, 1, 9, 9, 48, day, 9.0), (1, 1, 2, 2, 5, day, 2.0), (2, 1, 3, 3, 5, day, 3.0), (2, 1, 8, 8, 48, day, 8.0), (3, 1, 9, 9, 48, day, 9.0), (3, 1, 2, 2, 5, day, 2.0)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_shipdate date, l_extendedprice double, l_returnflag string"
    rows = [(k, n, p, s, float(q), t, x, "N") for k, n, p, s, q, t, x in lines]
    for name, part in (("a", rows[:5]), ("b", rows[5:])):  # order 3 lies in both files
        spark.createDataFrame(part, schema).toPandas().to_parquet(_made(tmp_path / "lineitem.parquet") / f"{name}.parquet")
    spark.createDataFrame([(k, k) for k in (1, 2, 3)], "o_orderkey long, o_custkey long").toPandas().to_parquet(tmp_path / "orders.parquet")
    spark.createDataFrame([(k, f"c{k}", 105.0, "x") for k in (1, 2, 3, 4)], "c_custkey long, c_name string, c_acctbal double, c_mktsegment string").toPandas().to_parquet(tmp_path / "customer.parquet")
    got = sorted(map(tuple, catalog.ledger_stream(spark, str(tmp_path)).select("userId", "salary", "answers").collect()))
    up, down = ledger.after(ledger.after(105, 96), 10), ledger.after(ledger.after(105, 10), 96)
    assert [r[1] for r in got] == [up, down, up, 105] and up != down


def test_state_is_held_by_groups_of_users(spark, tmp_path):
    """Entries of state, each of which costs its own calls, don't grow with the users; one user has far more answers than others."""
    r, day, many = random.Random(3), dt.datetime(2024, 1, 1), 3000
    answers = [(r.randint(1, many + 50), day + dt.timedelta(days=r.randint(0, 9)), n, r.randint(0, 100)) for n in range(6000)] + [(5, day, 10000 + n, 100 if n % 2 else 0) for n in range(500)]
    want = {u: (7 * u, 0) for u in range(1, many + 1)}
    for u, _, _, score in sorted(answers, key=lambda x: x[1:3]):
        salary, n = want.get(u, (0, 0))
        want[u] = (int(ledger.after(salary, score)), n + 1)
    people = spark.createDataFrame([(u, 7 * u) for u in range(1, many + 1)], "userId long, salary int")
    for rows in (answers, [(-1, day + dt.timedelta(days=90), 0, 0)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ledger.follow(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), people, f"file://{tmp_path}/table", f"file://{tmp_path}/checkpoint", "30 days")
        stream.awaitTermination()
        assert max(s["numRowsTotal"] for p in stream.recentProgress for s in p["stateOperators"]) < 200
    assert {x["userId"]: (x["salary"], x["answers"]) for x in ledger.salaries(spark, f"file://{tmp_path}/table").collect() if x["userId"] != -1} == want


def _made(folder):
    folder.mkdir(exist_ok=True)
    return folder
