"""The chain bonus against a plain model with objects for nodes, and by hand."""

import math
from types import SimpleNamespace

import pytest
from test_blocks import by_step, flow

from tracewell.sources.mapping import ACTIONS
from tracewell.streaming import folds

HIGH, FROM, DECAY = folds.P.high, 0.9, folds.P.decay


class Node:
    def __init__(self):
        self.bonus, self.support, self.at = 0.0, 0.0, None
        self.forget()

    def forget(self):
        self.actions, self.kinds, self.near, self.slots = set(), set(), set(), {}

    def fall(self, now):
        if self.at is not None:
            self.bonus, self.support = (v * math.exp(-(now - self.at) / DECAY) for v in (self.bonus, self.support))
        self.at = now
        if self.bonus <= 1e-4 and self.support <= 1e-4:
            self.forget()

    def scores(self, now):
        return {n: score * math.exp(-(now - t) / DECAY) for n, (score, t) in self.slots.items()}

    def refresh(self, now):
        self.fall(now)
        diversity = len(self.actions) + len(self.kinds) + min(len(self.near), 8)
        if diversity < 2:
            return 0.0
        best = max(self.scores(now).values(), default=0.0)
        self.bonus = max(self.bonus, min(3.0, 0.35 * math.log1p(self.support) + 0.45 * math.log1p(diversity) + 0.65 * max(best - FROM, 0.0)))
        return self.bonus

    def take(self, other, action, kind, share, now):
        self.fall(now)
        self.support = min(8.0, self.support + min(share, 8.0))
        self.actions.add(action)
        self.kinds.add(kind)
        self.near.add(other * 2654435761 % 32)
        scores = self.scores(now)
        if other in self.slots or len(self.slots) < 3:
            self.slots[other] = max(share, self.slots.get(other, (0.0, 0))[0]), now
        else:
            weakest = min(scores, key=scores.get)  # of equals the first slot
            # the new neighbour takes the weakest's place, and keeps its place in the order
            self.slots = {(other if n == weakest else n): ((max(share, v[0]), now) if n == weakest else v) for n, v in self.slots.items()}
        self.refresh(now)


def plain(rows):
    nodes, out = {}, []
    for e in rows.itertuples():
        now, share = e.ts_us / 1e6, e.score / HIGH
        s, d = (nodes.setdefault(n, Node()) for n in (e.info_src, e.info_dst))
        out.append(max(s.bonus, d.bonus))
        if s is not d and share >= FROM:
            s.take(e.info_dst, e.action, e.dst_kind, share, now)
            d.take(e.info_src, e.action, e.src_kind, share, now)
        for end in dict.fromkeys((s, d)):
            if (seed := end.refresh(now)) > 0:
                for n, score in end.scores(now).items():
                    bonus = min(3.0, seed + 0.65 * max(score - FROM, 0.0))
                    if bonus > nodes[n].bonus:
                        nodes[n].fall(now)
                        nodes[n].bonus = bonus
    return out


@pytest.mark.parametrize("nodes", [12, 150])
def test_bonuses_are_those_of_the_plain_model(nodes):
    rows = flow(3000, nodes)
    rows["ts_us"] = 10**15 + (rows["ts_us"] - 10**15) * 3  # long enough apart for some to be forgotten
    want = plain(rows)
    assert [r[-1] for r in by_step(folds.EVENT_FOLDS["compact_chain_bonus"], rows)] == pytest.approx(want, abs=1e-8)
    assert max(want) > 2 and len({round(v, 6) for v in want}) > 100


def test_bonuses_by_hand():
    day, states = 86400.0, {}

    def bonus(src, dst, score, at, action="EVENT_WRITE", dst_kind="file"):
        e = SimpleNamespace(host="h", stream_pos=0, action=action, src_kind="process", dst_kind=dst_kind, info_src=src, info_dst=dst, score=score, ts_us=int(at * day * 1e6))
        return folds._chain(states, e)[-1]

    assert bonus(1, 2, 0.89 * HIGH, 0) == 0 == bonus(1, 2, 0.89 * HIGH, 0)  # low scores leave nothing
    assert bonus(1, 2, HIGH, 0) == 0  # what was before the event
    one = 0.35 * math.log1p(1) + 0.45 * math.log1p(3) + 0.65 * 0.1  # an action, a kind, a neighbour
    passed = one + 0.65 * 0.1  # each end passes its own to the other, raised by what that scored
    assert bonus(2, 9, 0.0, 0) == pytest.approx(passed, abs=1e-8)
    assert bonus(1, 9, 0.0, 0) == pytest.approx(passed + 0.65 * 0.1, abs=1e-8)  # 2 passed it back in the same event
    quiet = {k: list(v) for k, v in states.items()}
    bonus(1, 1, 0.0, 30)
    assert states["c1"][1] == pytest.approx(quiet["c1"][1] / math.e)  # support falls by e in P.decay
    assert len(ACTIONS) == 10 and states["c1"][3:6] == quiet["c1"][3:6]
    bonus(1, 1, 0.0, 3000)
    assert states["c1"][3:] == folds.fresh_chain()[3:]  # nothing is left
