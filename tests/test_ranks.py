"""Ranks by histograms against sorted lists."""

import math
import random

import pytest

from tessera.operators import ranks


@pytest.mark.parametrize("parts, few", [(2, 0), (1024, 100)])
def test_ranks_are_those_of_sorted_values(spark, monkeypatch, parts, few):
    monkeypatch.setattr(ranks, "PARTS", parts)
    monkeypatch.setattr(ranks, "FEW_BOUNDS", few)
    r = random.Random(parts)
    spread = 40 if parts == 2 else 2**62
    groups = {"one": [7], "same": [3] * 50, "ties": [r.randint(-2, 2) for _ in range(90)], "wide": [r.randint(-spread, spread) for _ in range(200)], None: [r.randint(0, 9) for _ in range(11)]}
    if parts > 2:
        groups["edges"] = [-(2**63), 2**63 - 1, 0, 0]
    rows = [(g, v) for g, values in groups.items() for v in values] + [("wide", None), ("none", None)]
    r.shuffle(rows)
    shares = {"least": 0.0, "p50": 0.5, "p95": 0.95, "all": 1.0}
    got = {x["g"]: x for x in ranks.nearest_ranks(spark.createDataFrame(rows, "g string, v long").repartition(3), "g", "v", shares).collect()}
    for g, values in groups.items():
        want = [sorted(values)[max(1, math.ceil(p * len(values))) - 1] for p in shares.values()]
        assert [got[g][name] for name in shares] == want and got[g]["n"] == len(values)
    assert [got["none"][name] for name in ("n", *shares)] == [0, 0, 0, 0, 0]
    assert ranks.nearest_ranks(spark.createDataFrame([], "g string, v long"), "g", "v", shares).count() == 0
