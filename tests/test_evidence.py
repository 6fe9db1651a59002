"""A node's evidence is one grouping of its touches as they are."""

import pytest

from tracewell.operators import nodes

ROWS = "host string, node_id long, kind string, score double, thr double, as_src int, as_dst int, peer long, peer_kind string, action string"


def test_actions_are_counted_without_more_rows(spark):
    rows = [("h", 1, "process", float(i), 2.0, 1, 0, i % 3, "file", a) for i, a in enumerate(["EVENT_READ", "EVENT_WRITE", "EVENT_READ", None, "EVENT_OPEN"])]
    rows.append(("h", 2, "file", 1.0, 2.0, 0, 1, 7, "process", None))
    found = nodes.evidence(spark.createDataFrame(rows, ROWS))
    assert {r.node_id: (r.n, r.peers, r.actions) for r in found.collect()} == {1: (5, 3, 3), 2: (1, 1, 0)}
    assert "Expand" not in found._jdf.queryExecution().toString()


def test_an_action_of_none_is_an_error(spark):
    with pytest.raises(Exception, match="not among the actions"):
        nodes.evidence(spark.createDataFrame([("h", 1, "process", 1.0, 2.0, 1, 0, 3, "file", "EVENT_NEW")], ROWS)).collect()
