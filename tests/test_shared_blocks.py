"""Shared states over blocks of rows give what the step gives row by row, at a cost that doesn't grow with the states of a bucket."""

import time

import pandas as pd
import pytest
from test_blocks import by_block, by_step, flow, same

from tracewell.streaming import merging
from tracewell.streaming.folds import KEEP, REALDIAG_KEEP


@pytest.mark.parametrize("m", [merging.Merging(), merging.Merging("time_domain", 0.95), merging.Merging("none"), merging.Merging(most_compared=5, interval=2, first=3, least=0.9)])
@pytest.mark.parametrize("keep", [KEEP, REALDIAG_KEEP])
def test_blocks_are_steps(m, keep):
    rows = flow(2500, 300)
    fold = merging.merging_fold(m, keep)
    want = by_step(fold, rows)
    for size in (1, 700):
        same(by_block(fold, rows if size > 1 else rows[:600], size), want if size > 1 else want[:600])
    assert (max(r[-1] for r in want) > 0 and max(r[-2] for r in want) > 0) == (m.mode != "none")


def test_an_event_costs_no_more_with_many_states():
    """A bucket of 30,000 states is neither copied nor searched when one of them changes."""
    fold = merging.merging_fold(merging.Merging("none"))
    taken, took = fold.block(), []
    for start in range(0, 60_000, 10_000):
        n = range(start, start + 10_000)
        rows = pd.DataFrame({"host": "h", "stream_pos": n, "event_id": n, "action": "EVENT_READ", "src_kind": "file", "dst_kind": "process", "info_src": n, "info_dst": [i + 10**6 for i in n]})
        at = time.process_time()
        taken(rows)
        again = taken(rows)  # each state is its own node's: it leaves its bucket and comes back
        took.append(time.process_time() - at)
        assert again["states"][-1] == 2 * (start + 10_000)
    assert took[-1] < 4 * min(took)
