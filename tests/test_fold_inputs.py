"""A fold's rows are numbered, sent and ordered with the columns that it reads, no others."""

import pytest

from tracewell.queries import stateful
from tracewell.sources.audit import Audit
from tracewell.streaming.fold import folded
from tracewell.streaming.folds import EVENT_FOLDS

SF = "/root/testdata/sf0.001"


def test_a_threshold_only_takes_scores(spark):
    placed = stateful.needed(Audit.of(spark, SF).flow, EVENT_FOLDS["adaptive_threshold"])
    assert set(placed.columns) == {"host", "ts_us", "event_id", "score", "stream_pos"}


@pytest.mark.parametrize("name", ["adaptive_threshold", "online_node_risk", "compact_chain_bonus", "episode_sketch"])
def test_rows_are_those_of_the_whole_flow(spark, name):
    a, fold = Audit.of(spark, SF), EVENT_FOLDS[name]
    whole = folded(stateful.bucketed(a.placed), fold)
    got = folded(stateful.needed(a.flow, fold), fold)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
