"""Keys and updates that two writers survive."""

import threading

import pytest
from pyspark.sql import functions as F

from tessera.sources.keyed import KeyedTable
from tessera.sources.versions import Conflict, Versions


def test_writers_at_once(spark, tmp_path):
    """Threads that insert into one table: keys are gapless, each row has one, and every insert is one run of them."""
    path, returned = f"file://{tmp_path}/t", {}

    def write(k):
        rows = spark.range(100 * k, 100 * k + 7 + k).select(F.col("id").alias("n")).repartition(3)
        returned[k] = [(r["id"], r["n"]) for r in KeyedTable(spark, path, "n long").insert(rows).collect()]

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = sorted((r["id"], r["n"]) for r in KeyedTable(spark, path, "n long").read().collect())
    assert [i for i, _ in got] == list(range(1, 25)) and len({n for _, n in got}) == 24
    assert sorted(x for rows in returned.values() for x in rows) == got
    for k, rows in returned.items():
        keys = sorted(i for i, _ in rows)
        assert len(keys) == 7 + k and keys == list(range(keys[0], keys[0] + 7 + k))


def test_updates_and_versions(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "name string, salary int")
    assert table.read().count() == 0
    table.insert(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, salary int").coalesce(1))
    table.insert(spark.createDataFrame([], "name string, salary int"))
    table.update(spark.createDataFrame([(1, 10), (2, 20), (99, 5)], "id long, salary int"))
    table.update(spark.createDataFrame([(2, None, "B")], "id long, salary int, name string"))
    assert sorted(map(tuple, table.read().select("id", "name", "salary").collect())) == [(1, "a", 10), (2, "B", None), (3, "c", 3)]
    assert sorted(map(tuple, table.read(1).select("id", "salary").collect())) == [(1, 1), (2, 2), (3, 3)]
    assert table.insert(spark.createDataFrame([("d", 4)], "name string, salary int")).first()["id"] == 4


def test_a_version_is_claimed_once(spark, tmp_path):
    versions = Versions(spark, f"file://{tmp_path}/v")
    assert versions.last() is None
    versions.claim(1, '{"number": 1}')
    with pytest.raises(Conflict):
        versions.claim(1, '{"number": "other"}')
    assert versions.last() == {"number": 1} and versions.names() == ["v00000001.json"]
