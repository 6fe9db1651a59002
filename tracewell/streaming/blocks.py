"""The folds' steps over blocks of rows: what batch runs, equal to the steps that a stream runs row by row.

A block is a data frame of one host's rows in order (of many nodes' rows for folds by node). Where only events that share a node depend on
each other, a block's events are dealt to levels (one more than the latest level of their ends), and a level is one array operation;
elsewhere rows are taken one at a time over arrays of numbers. States of many numbers are rows of one array, and of a file beyond a
bounded number of nodes, so the memory of a task doesn't grow with a host's nodes but for some tens of bytes each.
"""

from __future__ import annotations

import math
import os
import tempfile
from array import array
from bisect import bisect_left
from collections import OrderedDict, deque
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd

from tracewell.sources.mapping import ACTIONS
from tracewell.streaming import folds

D, KINDS = folds.D, list(folds.SCALE)
_ACTION = {a: i for i, a in enumerate(ACTIONS)}
_KIND = {k: i for i, k in enumerate(KINDS)}
_MESSAGES = np.stack([folds.message(a, s, d) for a in ACTIONS for s in KINDS for d in KINDS])
_LAMBDA, _RHO = (np.array([gate[a] for a in ACTIONS]) for gate in (folds.LAMBDA, folds.RHO))
_SCALE = np.array(list(folds.SCALE.values()))
KEEP = folds.KEEP


def levels(src: list[int], dst: list[int]) -> np.ndarray:
    """The least level of each event such that events that share a node have different levels, in their order."""
    latest: dict[int, int] = {}
    out = np.empty(len(src), np.int64)
    for i, (s, d) in enumerate(zip(src, dst)):
        level = max(latest.get(s, 0), latest.get(d, 0))
        out[i] = level
        latest[s] = latest[d] = level + 1
    return out


def _by_level(src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
    level = levels(src.tolist(), dst.tolist())
    order = np.argsort(level, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(level[order])) + 1)


def _codes(rows: pd.DataFrame, a: str = "src_kind", b: str = "dst_kind") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the rows' messages, actions and first kinds."""
    action, first, second = (rows[c].map(m).to_numpy(np.int64) for c, m in (("action", _ACTION), (a, _KIND), (b, _KIND)))
    return (action * len(KINDS) + first) * len(KINDS) + second, action, first


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _units(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(_dots(x, x))
    return x / np.where(n > 1e-8, n, 1.0)[:, None]


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.round(np.sqrt(_dots(x, x)), 9)


class Places:
    """Numbers of nodes from 0 in the order of their first block: sorted arrays (16 bytes a node), and a small dict of the latest."""

    def __init__(self, most_recent: int = 1 << 18):
        self.ids, self.at, self.recent, self.most_recent = np.zeros(0, np.int64), np.zeros(0, np.int64), {}, most_recent

    def __len__(self) -> int:
        return len(self.ids) + len(self.recent)

    def __call__(self, *columns: pd.Series) -> list[np.ndarray]:
        found, back = np.unique(np.concatenate([c.to_numpy(np.int64) for c in columns]), return_inverse=True)
        at = np.searchsorted(self.ids, found)
        inside = np.minimum(at, max(len(self.ids) - 1, 0))
        known = self.ids[inside] == found if len(self.ids) else np.zeros(len(found), bool)
        place = np.empty(len(found), np.int64)
        place[known] = self.at[inside[known]]
        first, recent = len(self.ids), self.recent
        for i in np.flatnonzero(~known).tolist():
            place[i] = recent.setdefault(int(found[i]), first + len(recent))
        if len(recent) > self.most_recent:
            ids, places = (np.concatenate((old, np.fromiter(new, np.int64, len(recent)))) for old, new in ((self.ids, recent.keys()), (self.at, recent.values())))
            order = np.argsort(ids, kind="stable")
            self.ids, self.at, self.recent = ids[order], places[order], {}
        return np.split(place[back], len(columns))


class Rows:
    """A row of numbers for each place, zeros at first: the first ``most`` in memory, the others in a file that has no name and ends with the task."""

    def __init__(self, width: int = D, most: int = 1 << 19):
        self.width, self.most, self.held, self.file, self.n_file = width, most, np.zeros((0, width)), None, 0

    def take(self, places: np.ndarray) -> np.ndarray:
        """Rows of places in ascending order."""
        cut, out = int(np.searchsorted(places, self.most)), np.zeros((len(places), self.width))
        if cut:
            need = int(places[cut - 1]) + 1
            if need > len(self.held):
                more = min(self.most, max(need, 2 * len(self.held))) - len(self.held)
                self.held = np.concatenate((self.held, np.zeros((more, self.width))))
            out[:cut] = self.held[places[:cut]]
        if cut < len(places):
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            fd, size = self.file.fileno(), 8 * self.width
            for i, p in enumerate((places[cut:] - self.most).tolist(), cut):
                if p >= self.n_file:
                    break  # ascending: the rest is new
                out[i] = np.frombuffer(os.pread(fd, size, p * size))
        return out

    def put(self, places: np.ndarray, rows: np.ndarray) -> None:
        cut = int(np.searchsorted(places, self.most))
        self.held[places[:cut]] = rows[:cut]
        if cut < len(places):
            fd, size = self.file.fileno(), 8 * self.width
            for p, row in zip((places[cut:] - self.most).tolist(), rows[cut:]):
                os.pwrite(fd, row.tobytes(), p * size)  # a hole reads as zeros
            self.n_file = max(self.n_file, int(places[-1]) - self.most + 1)


class _OverNodes:
    """A block's ends as numbers of the block's own nodes, whose rows are taken before it and put back after."""

    def __init__(self, width: int = D):
        self.places, self.rows = Places(), Rows(width)

    def __call__(self, rows: pd.DataFrame) -> dict:
        src, dst = self.places(rows["info_src"], rows["info_dst"])
        nodes, back = np.unique(np.concatenate((src, dst)), return_inverse=True)
        h = self.rows.take(nodes)
        out = self.block(rows, *np.split(back, 2), h)
        self.rows.put(nodes, h)
        return out

    def block(self, rows: pd.DataFrame, src: np.ndarray, dst: np.ndarray, h: np.ndarray) -> dict:
        raise NotImplementedError


class HostState(_OverNodes):
    """``folds._flow``; the last number of a row says that the node is known."""

    def __init__(self):
        super().__init__(D + 1)

    def block(self, rows, src, dst, h):
        code, action, kind = _codes(rows)
        scale = _SCALE[kind]
        lam, rho, z = _LAMBDA[action] * scale, _RHO[action] * scale, _MESSAGES[code]
        norms, score = np.empty((2, len(rows))), np.empty(len(rows))
        for at in _by_level(src, dst):
            s, d = src[at], dst[at]
            read, seen = h[s, :D], h[d, :D]
            norms[0, at], norms[1, at] = _lengths(read), _lengths(seen)
            score[at] = np.where(h[d, D] > 0, 1.0 - _dots(z[at], _units(seen)), 1.0)
            apart = s != d
            a = at[apart]
            h[s[apart], :D] = KEEP * read[apart] + (1 - KEEP) * (rho[a, None] * z[a])
            h[d, :D] = KEEP * seen + (1 - KEEP) * _units(z[at] + lam[at, None] * read)
            h[s, D] = h[d, D] = 1.0
        return {"host": rows["host"], "stream_pos": rows["stream_pos"], "event_id": rows["event_id"], "src_norm": norms[0], "dst_norm": norms[1], "score": np.round(score, 9)}


class Probation(_OverNodes):
    """``folds._probation``; the last numbers of a row are the node's events and whether it was a source."""

    def __init__(self):
        super().__init__(D + 2)

    def block(self, rows, src, dst, h):
        z = _MESSAGES[_codes(rows)[0]]
        process = [(rows[c] == "process").to_numpy() for c in ("src_kind", "dst_kind")]
        read = np.empty((2, len(rows)))

        def reads(end: int, at: np.ndarray, nodes: np.ndarray) -> None:
            n, was = h[nodes, D], h[nodes, D + 1]
            active = (process[end][at] & (n >= 1)) | (n >= 2) | (was > 0)
            read[end, at] = np.where(active, _lengths(h[nodes, :D]), 0.0)

        def moved(at: np.ndarray, nodes: np.ndarray) -> None:
            h[nodes, D] += 1
            h[nodes, :D] = KEEP * h[nodes, :D] + (1 - KEEP) * z[at]

        for at in _by_level(src, dst):
            s, d = src[at], dst[at]
            reads(0, at, s)
            moved(at, s)
            h[s, D + 1] = 1.0
            reads(1, at, d)  # of a loop what the source has made of it
            apart = s != d
            moved(at[apart], d[apart])
        return {"host": rows["host"], "stream_pos": rows["stream_pos"], "src_read": read[0], "dst_read": read[1]}


class Residual(_OverNodes):
    """``folds._residual``; the host's own memory is a running mean over the block, row by row."""

    def __init__(self):
        super().__init__(D + 1)
        self.all, self.seen = np.zeros(D), False

    def block(self, rows, src, dst, h):
        code = _codes(rows)[0]
        z, n = _MESSAGES[code], len(rows)
        taken, before, g = (1 - KEEP) * _MESSAGES, np.empty((n, D)), self.all
        for i, c in enumerate(code.tolist()):
            before[i] = g
            g *= KEEP
            g += taken[c]
        known = np.ones(n)
        if not self.seen:
            known[0], self.seen = 0.0, True
        residual = np.empty(n)
        for at in _by_level(src, dst):
            s, d = src[at], dst[at]
            n_known = known[at] + h[s, D] + h[d, D]
            gap = z[at] - (before[at] + h[s, :D] + h[d, :D]) / np.maximum(n_known, 1.0)[:, None]
            residual[at] = _dots(gap, gap) / D
            apart = s != d
            h[s, :D] = KEEP * h[s, :D] + (1 - KEEP) * z[at]
            h[d[apart], :D] = KEEP * h[d[apart], :D] + (1 - KEEP) * z[at[apart]]
            h[s, D] = h[d, D] = 1.0
        return {"host": rows["host"], "stream_pos": rows["stream_pos"], "residual": np.round(residual, 9)}


class MixedStates(_OverNodes):
    """``folds._mixed_states``: every event reads what the one before left in the host's state, so rows are taken one at a time."""

    def __init__(self):
        super().__init__()
        self.all = np.zeros(D)

    def block(self, rows, src, dst, h):
        g, distance, rest, held, messages = self.all, [], 1 - KEEP, list(h), list(_MESSAGES)
        for c, s, d in zip(_codes(rows)[0].tolist(), src.tolist(), dst.tolist()):
            a, b, z = held[s], held[d], messages[c]
            mix = 0.3 * a
            mix += z
            mix += 0.3 * b
            mix += 0.1 * g
            n = math.sqrt(mix.dot(mix))
            if n > 1e-8:
                mix /= n
            distance.append(round(1.0 - float(z.dot(mix)), 9))
            new = rest * mix
            a *= KEEP
            a += new
            if s != d:
                b *= KEEP
                b += new
            g *= KEEP
            g += new
        return {"host": rows["host"], "stream_pos": rows["stream_pos"], "event_id": rows["event_id"], "distance": distance}


class Adaptive:
    """``folds._adaptive``."""

    def __init__(self):
        self.seen, self.alerts, self.threshold = 0, 0, folds.P.alert

    def __call__(self, rows: pd.DataFrame) -> dict:
        p, seen, alerts, threshold, used, is_alert = folds.P, self.seen, self.alerts, self.threshold, [], []
        for score in rows["score"].tolist():
            alert = score >= threshold
            seen += 1
            alerts += alert
            used.append(round(threshold, 6))
            is_alert.append(alert)
            if seen > p.warm_up:
                rate = alerts / seen
                threshold *= 1.05 if rate > 1.5 * p.rate else 0.95 if rate < 0.5 * p.rate else 1.0
        self.seen, self.alerts, self.threshold = seen, alerts, threshold
        return {"host": rows["host"], "stream_pos": rows["stream_pos"], "threshold": used, "is_alert": is_alert}


class _OverNumbers:
    """A few numbers for each node, in arrays by place."""

    #: of each array its type, first value (or a list of them), and numbers for each node
    arrays: dict[str, tuple[str, float | list[float], int]] = {}

    def __init__(self):
        self.places, self.size = Places(), 0
        for name, (kind, *_) in self.arrays.items():
            setattr(self, name, array(kind))

    def ends(self, rows: pd.DataFrame) -> tuple[list[int], list[int]]:
        src, dst = self.places(rows["info_src"], rows["info_dst"])
        more = len(self.places) - self.size
        for name, (kind, first, width) in self.arrays.items():
            getattr(self, name).extend(array(kind, first if isinstance(first, list) else [first] * width) * more)
        self.size += more
        return src.tolist(), dst.tolist()


class Propagated(_OverNumbers):
    """``folds._propagated``; a node's neighbours are places, -1 for none, the latest last."""

    def __init__(self):
        self.width = folds.P.neighbours
        self.arrays = {"risks": ("d", 0.0, 1), "times": ("d", 0.0, 1), "near": ("q", -1, self.width)}
        super().__init__()

    def __call__(self, rows: pd.DataFrame) -> dict:
        p, w, exp = folds.P, self.width, math.exp
        src, dst = self.ends(rows)
        risks, times, near = self.risks, self.times, self.near
        raised, written = [], []
        for s, d, score, us in zip(src, dst, rows["score"].tolist(), rows["ts_us"].tolist()):
            now, n = us / 1e6, 0
            r = risks[s]
            total = score + 0.5 * (r * exp(-(now - times[s]) / p.decay)) if r else score + 0.0
            if score >= p.high:
                share, reached, front = 0.3 * total, {s, d}, [s]

                def raise_to(node: int, share: float) -> None:
                    r = risks[node]
                    risks[node] = max(r * exp(-(now - times[node]) / p.decay), share) if r else max(0.0, share)
                    times[node] = now

                for node in reached:
                    raise_to(node, share)
                for _ in range(p.hops):
                    share *= p.back
                    front = list({x for at in front for x in near[at * w : at * w + w] if x >= 0 and x not in reached})
                    reached.update(front)
                    for node in front:
                        raise_to(node, share)
                    n += len(front)
            if s != d:
                at = d * w
                if near[at + w - 1] != s:
                    kept = [x for x in near[at : at + w] if x != s and x >= 0]
                    kept = [*kept, s][-w:]
                    near[at : at + w] = array("q", [-1] * (w - len(kept)) + kept)
            raised.append(round(total, 6))
            written.append(n)
        return {"host": rows["host"], "stream_pos": rows["stream_pos"], "event_id": rows["event_id"], "raised": raised, "written": written}


class Chain(_OverNumbers):
    """``folds._chain``; a node's numbers are in one array, and its slots hold places."""

    def __init__(self):
        self.width = len(folds.fresh_chain())
        self.arrays = {"held": ("d", folds.fresh_chain(), self.width)}
        super().__init__()

    def __call__(self, rows: pd.DataFrame) -> dict:
        src, dst = self.ends(rows)
        x, w, event, out = self.held, self.width, folds.chain_event, []
        bits = ((1 << (rows[c].to_numpy(np.int64).astype(np.uint64) * np.uint64(2654435761) & np.uint64(31)).astype(np.int64)).tolist() for c in ("info_src", "info_dst"))
        kinds = (rows[c].map(_KIND).tolist() for c in ("src_kind", "dst_kind"))
        held = lambda place: (x, place * w)
        for s, d, ends, a, of, score, us in zip(src, dst, zip(*bits), rows["action"].map(_ACTION).tolist(), zip(*kinds), rows["score"].tolist(), rows["ts_us"].tolist()):
            out.append(event(held, s, d, ends, a, of, score, us / 1e6))
        return {"host": rows["host"], "stream_pos": rows["stream_pos"], "bonus": out}


class BoundedRisk:
    """``folds._bounded_risk``: the queue of touches holds each node's last one alone, as only that counts."""

    def __init__(self):
        self.of: OrderedDict[int, tuple[float, float, float, int]] = OrderedDict()  # by last touch: risk, events, time, touch
        self.heap, self.touches = [], 0

    def __call__(self, rows: pd.DataFrame) -> dict:
        p, of, exp, log, log1p = folds.P, self.of, math.exp, math.log, math.log1p
        heap, touches = self.heap, self.touches
        src_risk, dst_risk, nodes, all_gone = [], [], [], []
        for s, d, score, us in zip(rows["info_src"].tolist(), rows["info_dst"].tolist(), rows["score"].tolist(), rows["ts_us"].tolist()):
            now, gone, ends = us / 1e6, [], (s, d) if s != d else (s,)
            while of and of[(node := next(iter(of)))][2] < now - p.risk_ttl:
                del of[node]
                gone.append(node)
            for node in ends:
                risk, n, t, _ = of.get(node) or (0.0, 0.0, now, 0)
                risk = max(risk * exp(-(now - t) / p.decay), score / 1e4 + log1p(n) - 0.1 * n**0.5)
                touches += 1
                of[node] = risk, n + 1, now, touches
                of.move_to_end(node)
                heappush(heap, (log(max(risk, 1e-300)) + now / p.decay, node, touches))
                if node == s:
                    src_risk.append(round(risk, 9))
            dst_risk.append(round(risk, 9))
            spared = []
            while len(of) > p.most_risks and heap:
                entry = heappop(heap)
                node = entry[1]
                if (at := of.get(node)) is None or at[3] != entry[2]:
                    continue
                if node in ends:
                    spared.append(entry)
                else:
                    del of[node]
                    gone.append(node)
            for entry in spared:
                heappush(heap, entry)
            if len(heap) > 4 * max(len(of), 16):
                heap = [x for x in heap if (at := of.get(x[1])) is not None and at[3] == x[2]]
                heapify(heap)
            nodes.append(len(of))
            all_gone.append(gone)
        self.heap, self.touches = heap, touches
        return {"host": rows["host"], "stream_pos": rows["stream_pos"], "event_id": rows["event_id"], "src_risk": src_risk, "dst_risk": dst_risk, "nodes": nodes, "gone": all_gone}


class Bounded:
    """``folds._bounded``: of each kind's nodes, the protected ones are counted by their order instead of being passed over one by one.

    Nodes wait in the order of their last touch (``waiting``). Protected ones are out of it, sorted (``spared``), until their time is up; then
    they are among ``back`` in that order. Entries of ``back`` and ``ending`` count only if the node wasn't touched, or alerted, again since.
    """

    def __init__(self, protect: bool):
        self.protect = protect
        self.of: dict[int, list] = {}  # order of the last touch, until, number of kind, state, where: 0 waiting, 1 spared, 2 back
        self.waiting = [OrderedDict() for _ in folds.EVICTED_FIRST]
        self.spared, self.back = [[] for _ in folds.EVICTED_FIRST], [[] for _ in folds.EVICTED_FIRST]
        self.ending, self.proto = deque(), {k: np.zeros(D) for k in KINDS}

    def _leave(self, node: int, at: list) -> None:
        order, _, k, _, where = at
        if where == 0:
            del self.waiting[k][node]
        elif where == 1:
            spared = self.spared[k]
            del spared[bisect_left(spared, order)]

    def _evict(self, pos: int, ends: tuple[int, int]) -> tuple[int | None, int]:
        of, ending, passed = self.of, self.ending, 0
        while ending and ending[0][0] < pos:
            until, node = ending.popleft()
            at = of.get(node)
            if at is not None and at[4] == 1 and at[1] == until:
                self._leave(node, at)
                at[4] = 2
                heappush(self.back[at[2]], (at[0], node))
        for k, kind in enumerate(folds.EVICTED_FIRST):
            gone, back, spared = None, self.back[k], self.spared[k]
            for node in self.waiting[k]:
                if node not in ends:
                    gone = node
                    break
            while back and ((at := of.get(back[0][1])) is None or at[4] != 2 or at[0] != back[0][0]):
                heappop(back)
            if back and (gone is None or back[0][0] < of[gone][0]):
                gone = heappop(back)[1]
            if gone is None:
                passed += len(spared)
                continue
            at = of.pop(gone)
            self._leave(gone, at)
            proto = self.proto[kind]
            proto *= 1 - folds.P.prototype
            proto += folds.P.prototype * at[3]
            return gone, passed + bisect_left(spared, at[0])
        return None, passed

    def __call__(self, rows: pd.DataFrame) -> dict:
        p, of, first = folds.P, self.of, folds.EVICTED_FIRST
        taken, sqrt = (1 - KEEP) * _MESSAGES, math.sqrt
        n_states, evicted, spared, starts = [], [], [], ([], [])
        columns = (rows[c].tolist() for c in ("stream_pos", "info_src", "info_dst", "src_kind", "dst_kind", "score"))
        for c, pos, s, d, s_kind, d_kind, score in zip(_codes(rows)[0].tolist(), *columns):
            alert = self.protect and score >= p.alert
            for end, (node, kind) in enumerate(((s, s_kind), (d, d_kind)) if s != d else ((s, s_kind),)):
                k, at = first.get(kind, 0), of.get(node)
                if at is None:
                    h, until = self.proto[kind].copy(), -1.0
                else:
                    self._leave(node, at)
                    h, until = at[3], at[1]
                starts[end].append(round(sqrt(h.dot(h)), 9))
                h *= KEEP
                h += taken[c]
                order = 2 * pos + end
                if alert:
                    until = float(pos + p.protected)
                    self.ending.append((until, node))
                where = 1 if until >= pos else 0
                of[node] = [order, until, k, h, where]
                if where:
                    self.spared[k].append(order)
                else:
                    self.waiting[k][node] = None
            if s == d:
                starts[1].append(starts[0][-1])
            gone, passed = self._evict(pos, (s, d)) if len(of) > p.most_states else (None, 0)
            n_states.append(len(of))
            evicted.append(gone)
            spared.append(passed)
        gone = pd.array(evicted, dtype="Int64")
        return {"host": rows["host"], "stream_pos": rows["stream_pos"], "n_states": n_states, "evicted": gone, "spared": spared, "src_start": starts[0], "dst_start": starts[1]}


class NodeStates:
    """A linear state of a node, ``state <- keep * state + taken[message]``, of all nodes in a block at once: a level holds each node's next row."""

    def __init__(self, keep: np.ndarray, taken: np.ndarray, norm):
        self.keep, self.taken, self.norm, self.at, self.last = keep, taken, norm, None, None

    def __call__(self, rows: pd.DataFrame) -> dict:
        host, node, n = rows["host"].to_numpy(), rows["node_id"].to_numpy(), len(rows)
        x = self.taken[_codes(rows, "kind", "peer_kind")[0]]
        first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (host[1:] != host[:-1])])
        lengths = np.diff(np.r_[first, n])
        if self.at == (host[0], node[0]):
            x[0] += self.keep * self.last
        order = np.argsort(-lengths, kind="stable")
        first, lengths = first[order], lengths[order]
        for k in range(1, int(lengths[0])):
            at = first[: np.searchsorted(-lengths, -k, side="left")] + k
            x[at] += self.keep * x[at - 1]
        self.at, self.last = (host[-1], node[-1]), x[-1].copy()
        return {"host": host, "node_id": node, "stream_pos": rows["stream_pos"], "norm": self.norm(x)}


def node_vector(keep: np.ndarray) -> NodeStates:
    return NodeStates(keep, (1 - keep) * _MESSAGES, _lengths)


def s4d() -> NodeStates:
    return NodeStates(folds._POLES, _MESSAGES @ folds._IN.T, lambda x: np.round(np.linalg.norm(2 * (x @ folds._OUT).real, axis=1), 6))
