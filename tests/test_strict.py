"""Registered queries fail where a recall fails: what is left would look like their result."""

import os

import pytest

from tessera.operators import retrieve
from tessera.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", ["cached_context", "context_assembly", "eval_scores", "eval_metrics", "hybrid_retrieve", "rrf_fusion", "segment_retrieve"])
def test_lost_recall_is_an_error(spark, monkeypatch, name):
    def lost(*_):
        raise RuntimeError("vectors lost")

    monkeypatch.setattr(retrieve.vector, "search", lost)
    with pytest.raises(Exception, match="vectors lost"):
        catalog.QUERIES[name](spark, DATA).collect()
