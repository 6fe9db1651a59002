"""Node states that share: a fold in which nodes of one kind with like states hold one state together, until one of them changes.

Every state has a place and a count of the nodes that hold it. A node that changes while others hold its state leaves it (copy on
write) with a copy that takes the change; a state that one node holds is that node's own again, and changes in place. A
changed state is then compared with others of its kind in the same bucket of signatures, at most ``most_compared`` of them, the last
changed first; if the nearest has a cosine of ``least`` or more, the node joins it, and it becomes the mean of what its
nodes held as they joined. The signature is the real part of the lower half of the state's Fourier transform, or the state itself.

States of a host are values of one map, by name, so that a stream loads what an event touches: the ends, their states, and
the states of the buckets that they are compared in.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd

from tracewell.streaming.blocks import _KIND, _LAMBDA, _MESSAGES, _RHO, _SCALE, _codes, _OverNumbers
from tracewell.streaming.fold import Fold
from tracewell.streaming.folds import D, KEEP, LAMBDA, RHO, SCALE, message, unit

MODES = ("fourier", "time_domain", "none")
#: the real part of a Fourier transform's lower half, as products with cosines
_COSINES = np.cos(2 * np.pi / D * np.outer(np.arange(D), np.arange(D // 4 + 1)))


@dataclass(frozen=True)
class Merging:
    mode: str = "fourier"
    least: float = 0.98
    #: signs of the signature's first numbers that make a bucket
    bits: int = 4
    most_compared: int = 64
    #: a node is compared at each ``interval``-th of its changes, from the ``first``-th on
    interval: int = 1
    first: int = 1

    def signature(self, state: np.ndarray) -> np.ndarray:
        return unit(state @ _COSINES if self.mode == "fourier" else state)

    def bucket(self, signature: np.ndarray) -> int:
        return sum(1 << i for i, x in enumerate(signature[: self.bits].tolist()) if x > 0)

    def step(self, keep: np.ndarray = KEEP):
        """The fold's step; names: n<node> [place, changes], s<place> state, g<place> its signature, c<place> [holders, kind, bucket], b<kind>:<bucket> places, last changed last."""
        kinds = list(SCALE)

        def unlisted(states, place: int, kind: int, bucket: int) -> None:
            name = f"b{kind}:{bucket}"
            places = list(states[name])
            places.remove(place)
            states[name] = places

        def listed(states, place: int, holders: int, kind: int, signature: np.ndarray) -> None:
            bucket = self.bucket(signature)
            states[f"g{place}"] = signature
            states[f"c{place}"] = [float(holders), float(kind), float(bucket)]
            name = f"b{kind}:{bucket}"
            states[name] = [*states.get(name, []), float(place)]

        def read(states, node: int) -> np.ndarray | None:
            at = states.get(f"n{node}")
            return None if at is None else np.asarray(states[f"s{int(at[0])}"])

        def fresh(states) -> int:
            place = states.get("next", [0.0])[0]
            states["next"] = [place + 1]
            states["places"] = [states.get("places", [0.0])[0] + 1]
            return int(place)

        def change(states, node: int, kind: int, m: np.ndarray) -> tuple[int, bool, bool]:
            at, copied, joined = states.get(f"n{node}"), False, False
            if at is None:
                place, changes, old = fresh(states), 0, np.zeros(D)
                states["nodes"] = [states.get("nodes", [0.0])[0] + 1]
            else:
                place, changes = int(at[0]), int(at[1])
                old = np.asarray(states[f"s{place}"])
                holders, listed_as, bucket = states[f"c{place}"]
                if holders > 1:
                    # the others keep their state; from one holder on it is that node's own
                    states[f"c{place}"] = [holders - 1, listed_as, bucket]
                    place, copied = fresh(states), True
                else:
                    unlisted(states, place, int(listed_as), int(bucket))
            states[f"s{place}"] = keep * old + (1 - keep) * m
            changes += 1
            signature = self.signature(states[f"s{place}"])
            if self.mode != "none" and changes >= self.first and changes % self.interval == 0:
                others = [int(p) for p in states.get(f"b{kind}:{self.bucket(signature)}", [])[: -self.most_compared - 1 : -1]]
                cosines = np.array([states[f"g{p}"] for p in others]) @ signature if others else np.zeros(1)
                if others and cosines.max() >= self.least:
                    best = others[int(cosines.argmax())]  # of equals the last changed
                    holders, _, bucket = states[f"c{best}"]
                    mean = (np.asarray(states[f"s{best}"]) * holders + np.asarray(states.pop(f"s{place}"))) / (holders + 1)
                    states.pop(f"c{place}", None)
                    states.pop(f"g{place}", None)
                    unlisted(states, best, kind, int(bucket))
                    states[f"s{best}"] = mean
                    states["places"] = [states["places"][0] - 1]
                    listed(states, best, int(holders) + 1, kind, self.signature(mean))
                    place, joined = best, True
            if not joined:
                listed(states, place, 1, kind, signature)
            states[f"n{node}"] = [float(place), float(changes)]
            return place, copied, joined

        def step(states, e) -> tuple:
            z = message(e.action, e.src_kind, e.dst_kind)
            scale = SCALE[e.src_kind]
            lam, rho = LAMBDA[e.action] * scale, RHO[e.action] * scale
            held = read(states, e.info_src)
            held = np.zeros(D) if held is None else held
            copied = joined = 0
            if e.info_src != e.info_dst:
                _, c, j = change(states, e.info_src, kinds.index(e.src_kind), rho * z)
                copied, joined = copied + c, joined + j
            dst, c, j = change(states, e.info_dst, kinds.index(e.dst_kind), unit(z + lam * held))
            src = int(states[f"n{e.info_src}"][0])
            ends = int(e.info_src), e.src_kind, src, int(e.info_dst), e.dst_kind, dst
            return e.host, int(e.stream_pos), int(e.event_id), *ends, int(states["nodes"][0]), int(states["places"][0]), copied + c, joined + j

        return step


class _Bucket:
    """Signatures in the order of change, those of the last ``most`` in a stretch of one array. What has left is a row of zeros until the stretch is packed again."""

    def __init__(self, width: int, most: int):
        self.most, self.rows, self.signatures, self.start, self.held, self.all = most, [], np.zeros((16, width)), 0, 0, 0

    def append(self, row: int, signature: np.ndarray, where: list[int]) -> None:
        rows, at = self.rows, len(self.rows)
        if at > 2 * self.all + 4 * self.most:
            self._pack(0, where)
            at = len(rows)
        if at == len(self.signatures):
            self.signatures = np.concatenate((self.signatures, np.zeros_like(self.signatures)))
        self.signatures[at] = signature
        rows.append(row)
        where[row] = at
        self.all += 1
        if self.held < self.most:
            self.held += 1
        else:  # the earliest of the stretch is out of it
            while rows[self.start] < 0:
                self.start += 1
            self.start += 1

    def remove(self, row: int, where: list[int]) -> None:
        rows, at = self.rows, where[row]
        rows[at] = -1
        self.signatures[at] = 0.0
        self.all -= 1
        if at >= self.start:
            if self.held > self.all:
                self.held -= 1
                self.start = 0
            else:  # one that changed earlier is among the last again
                self.start -= 1
                while rows[self.start] < 0:
                    self.start -= 1
            if len(rows) - self.start > self.held + self.most:
                self._pack(self.start, where)

    def _pack(self, first: int, where: list[int]) -> None:
        kept = [i for i in range(first, len(self.rows)) if self.rows[i] >= 0]
        before = sum(i < self.start for i in kept)
        self.signatures[first : first + len(kept)] = self.signatures[kept]
        self.rows[first:] = [self.rows[i] for i in kept]
        for i in range(first, len(self.rows)):
            where[self.rows[i]] = i
        self.start = first + before

    def nearest(self, signature: np.ndarray) -> tuple[int, float]:
        """Of equals the last changed."""
        cosines = self.signatures[self.start : len(self.rows)] @ signature
        at = len(cosines) - 1 - int(cosines[::-1].argmax())
        return self.rows[self.start + at], cosines[at]


class SharedStates(_OverNumbers):
    """``Merging.step`` over blocks: states are rows of an array, signatures rows of their buckets', and a change neither copies nor searches a bucket.

    A row is free again once its state is gone, so there are as many as states that are held at a time; ``names`` has the places' numbers.
    """

    arrays = {"at": ("q", -1, 1), "changes": ("q", 0, 1)}

    def __init__(self, merging: Merging, keep: np.ndarray):
        super().__init__()
        self.merging, self.keep, self.rest = merging, keep, 1 - keep
        self.states, self.width = np.zeros((64, D)), len(merging.signature(np.zeros(D)))
        self.names, self.holders, self.listed, self.where, self.free = [], [], [], [], []
        self.buckets: dict[int, _Bucket] = {}
        self.next = self.nodes = 0
        action, kind = np.arange(len(_MESSAGES)) // len(SCALE) ** 2, np.arange(len(_MESSAGES)) // len(SCALE) % len(SCALE)
        self.lam, self.sent = (_LAMBDA[action] * _SCALE[kind]).tolist(), list(self.rest * ((_RHO[action] * _SCALE[kind])[:, None] * _MESSAGES))

    def fresh(self) -> int:
        if self.free:
            row = self.free.pop()
            self.names[row] = self.next
        else:
            row = len(self.names)
            for column, first in ((self.names, self.next), (self.holders, 0), (self.listed, None), (self.where, -1)):
                column.append(first)
            if row == len(self.states):
                self.states = np.concatenate((self.states, np.zeros_like(self.states)))
        self.next += 1
        return row

    def bucket(self, kind: int, signature: np.ndarray) -> _Bucket:
        key = kind
        for x in signature[: self.merging.bits].tolist():
            key = 2 * key + (x > 0)
        found = self.buckets.get(key)
        if found is None:
            found = self.buckets[key] = _Bucket(self.width, self.merging.most_compared)
        return found

    def change(self, node: int, kind: int, taken: np.ndarray) -> tuple[bool, bool]:
        m, row, copied, joined, n = self.merging, self.at[node], False, False, 0
        if row < 0:
            row, state = self.fresh(), taken
            self.nodes += 1
        else:
            state = self.keep * self.states[row]
            state += taken
            if self.holders[row] > 1:
                self.holders[row] -= 1
                row, copied = self.fresh(), True
            else:
                self.listed[row].remove(row, self.where)
        self.changes[node] = changes = self.changes[node] + 1
        signature = m.signature(state)
        bucket = self.bucket(kind, signature)
        if bucket.held and m.mode != "none" and changes >= m.first and changes % m.interval == 0:
            best, cosine = bucket.nearest(signature)
            if cosine >= m.least:
                self.free.append(row)
                bucket.remove(best, self.where)
                n, row, joined = self.holders[best], best, True
                state = (self.states[best] * n + state) / (n + 1)
                signature = m.signature(state)
                bucket = self.bucket(kind, signature)
        self.holders[row] = n + 1
        self.states[row] = state
        self.listed[row] = bucket
        bucket.append(row, signature, self.where)
        self.at[node] = row
        return copied, joined

    def __call__(self, rows: pd.DataFrame) -> dict:
        src, dst = self.ends(rows)
        at, names, free, out, messages = self.at, self.names, self.free, [], list(_MESSAGES)
        kinds = (rows[c].map(_KIND).tolist() for c in ("src_kind", "dst_kind"))
        for s, d, code, s_kind, d_kind in zip(src, dst, _codes(rows)[0].tolist(), *kinds):
            if at[s] < 0:
                to = messages[code].copy()
            else:
                to = self.lam[code] * self.states[at[s]]
                to += messages[code]
            n = math.sqrt(to.dot(to))
            if n > 1e-8:
                to /= n
            to *= self.rest
            copied = joined = 0
            if s != d:
                copied, joined = self.change(s, s_kind, self.sent[code])
            c, j = self.change(d, d_kind, to)
            out.append((names[at[s]], names[at[d]], self.nodes, len(names) - len(free), copied + c, joined + j))
        src_place, dst_place, nodes, states, copied, joined = zip(*out)
        ends = {"info_src": rows["info_src"], "src_kind": rows["src_kind"], "src_place": src_place, "info_dst": rows["info_dst"], "dst_kind": rows["dst_kind"], "dst_place": dst_place}
        return {"host": rows["host"], "stream_pos": rows["stream_pos"], "event_id": rows["event_id"], **ends, "nodes": nodes, "states": states, "copied": copied, "joined": joined}


def merging_fold(merging: Merging = Merging(), keep: np.ndarray = KEEP) -> Fold:
    """Of each event: its ends with the places of their states after it, the host's nodes and states, and how often a state was copied and joined."""
    inputs = ("event_id", "action", "src_kind", "dst_kind", "info_src", "info_dst")
    ends = "info_src long, src_kind string, src_place long, info_dst long, dst_kind string, dst_place long"
    output = f"host string, stream_pos long, event_id long, {ends}, nodes long, states long, copied int, joined int"
    return Fold(("host",), ("stream_pos",), inputs, output, merging.step(keep), (lambda: SharedStates(merging, keep)) if merging.least > 0 else None)
