"""The engine's stateful operators as folds.

Host-keyed folds read and change several nodes at one event (a destination reads its source's state at that instant), so a host is
their unit of scale. Node-keyed folds only need a node's own past and scale with the nodes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from tracewell.sources.mapping import ACTIONS
from tracewell.streaming.fold import Fold

D = 64
# Time constants over the dimensions, gates of actions and source kinds, and the real-diagonal decay floor.
TAUS = np.tile([2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0], 8)
LAMBDA = {"EVENT_CLONE": 0.4, "EVENT_CONNECT": 0.5, "EVENT_EXECUTE": 0.5, "EVENT_OPEN": 0.1, "EVENT_READ": 0.1, "EVENT_RECVFROM": 0.1, "EVENT_RECVMSG": 0.1, "EVENT_SENDMSG": 0.5, "EVENT_SENDTO": 0.5, "EVENT_WRITE": 0.5}
RHO = {"EVENT_CLONE": 0.2, "EVENT_CONNECT": 0.2, "EVENT_EXECUTE": 0.2, "EVENT_OPEN": 0.05, "EVENT_READ": 0.05, "EVENT_RECVFROM": 0.05, "EVENT_RECVMSG": 0.05, "EVENT_SENDMSG": 0.2, "EVENT_SENDTO": 0.2, "EVENT_WRITE": 0.2}
SCALE = {"process": 1.0, "file": 0.3, "netflow": 0.3, "unknown": 0.1}

KEEP = np.exp(-1 / TAUS)
REALDIAG_KEEP = np.exp(-(np.log1p(np.exp(np.linspace(-4, 0, D))) + 1e-3))
_RNG = np.random.default_rng(23)
_ACTION = dict(zip(ACTIONS, _RNG.normal(size=(len(ACTIONS), D))))
_SOURCE, _TARGET = ({k: v for k, v in zip(SCALE, _RNG.normal(size=(4, D)))} for _ in range(2))
_MODES = 32
_POLES = np.exp(-1 / np.geomspace(2, 256, _MODES)) * np.exp(1j * np.linspace(0, np.pi / 2, _MODES))
_IN, _OUT = ((_RNG.normal(size=(_MODES, D)) + 1j * _RNG.normal(size=(_MODES, D))) / math.sqrt(D) for _ in range(2))


def unit(x: np.ndarray) -> np.ndarray:
    n = math.sqrt(float(x @ x))
    return x / n if n > 1e-8 else x


@lru_cache(maxsize=None)
def message(action: str, src_kind: str, dst_kind: str) -> np.ndarray:
    return unit(_ACTION[action] + _SOURCE[src_kind] + _TARGET[dst_kind])


def length(h) -> float:
    h = np.asarray(h)
    return round(math.sqrt(float(h @ h)), 9)


def norm_of(states, name: str) -> float:
    h = states.get(name)
    return 0.0 if h is None else length(h)


def _ema(states, name: str, m: np.ndarray, q: float = 1.0, keep: np.ndarray = KEEP) -> np.ndarray:
    h = states.get(name)
    h = keep * (0.0 if h is None else np.asarray(h)) + (1 - keep) * q * m
    states[name] = h
    return h


def _flow(states, e) -> tuple:
    """Score against the states as they are, then the source is updated, then the destination with what it read before."""
    z, src, dst = message(e.action, e.src_kind, e.dst_kind), f"n{e.info_src}", f"n{e.info_dst}"
    scale = SCALE[e.src_kind]
    lam, rho = LAMBDA[e.action] * scale, RHO[e.action] * scale
    before, at = states.get(src), states.get(dst)
    read = np.zeros(D) if before is None else np.asarray(before)
    seen = np.zeros(D) if at is None else np.asarray(at)
    score = 1.0 - float(z @ unit(seen)) if at is not None else 1.0
    norms = norm_of(states, src), norm_of(states, dst)
    if src != dst:
        _ema(states, src, rho * z)
    _ema(states, dst, unit(z + lam * read))
    return e.host, int(e.stream_pos), int(e.event_id), *norms, round(score, 9)


def _probation(states, e) -> tuple:
    """Files and netflows stay on probation until seen twice or as a source; reads of probationary nodes give nothing."""
    z, out = message(e.action, e.src_kind, e.dst_kind), []
    for node, kind, is_source in ((e.info_src, e.src_kind, True), (e.info_dst, e.dst_kind, False)):
        name, count = f"n{node}", f"c{node}"
        n = states.get(count, [0.0])[0]
        active = kind == "process" and n >= 1 or n >= 2 or states.get(f"p{node}", [0.0])[0] > 0
        out.append(norm_of(states, name) if active else 0.0)
        if not (e.info_src == e.info_dst and not is_source):
            states[count] = [n + 1]
            if is_source:
                states[f"p{node}"] = [1.0]
            _ema(states, name, z)
    return e.host, int(e.stream_pos), *out


@dataclass(frozen=True)
class Parameters:
    """Constants of the folds; times are in seconds, scores on the scale of the events' scores."""

    #: scores from here on write risk back, and alert
    high: float = 60000.0
    alert: float = 80000.0
    #: the alert rate that the adaptive threshold aims at, and rows before it moves
    rate: float = 0.01
    warm_up: int = 100
    #: time in which risk, support and bursts fall by e
    decay: float = 2.592e6
    burst_cap: float = 50.0
    #: node states that a host keeps, and events for which an alerted node is kept anyway
    most_states: int = 200
    protected: int = 500
    #: share of an evicted state that goes into its kind's prototype
    prototype: float = 0.1
    sketch_buckets: int = 4096
    #: vectors that a memory needs before it measures, and deviations beyond which it keeps one out
    least_kept: int = 10
    tail: float = 4.0
    #: nodes whose risk a host keeps, and for how long after their last touch
    most_risks: int = 200
    risk_ttl: float = 3.15e7
    #: backwards from a high score: neighbours that a node remembers, steps, and the share that a step passes on
    neighbours: int = 4
    hops: int = 2
    back: float = 0.5
    #: chains: neighbours that a node keeps, the share of ``high`` from which an event counts, caps of support and bonus, the diversity
    #: that a bonus needs, and the weights of support, diversity and the best neighbour
    chain_slots: int = 3
    chain_from: float = 0.9
    chain_support_cap: float = 8.0
    chain_cap: float = 3.0
    chain_diversity: int = 2
    chain_support: float = 0.35
    chain_kinds: float = 0.45
    chain_neighbour: float = 0.65


P = Parameters()


def _propagated(states, e) -> tuple:
    """An event's score is raised by its source's decayed risk; high scores write back to both ends, and backwards.

    A node keeps the last P.neighbours nodes that flowed into it. From the source of a high score risk goes to these, and to theirs,
    P.hops steps back, a P.back share at each; nodes met on a shorter way aren't written again.
    """
    now = e.ts_us / 1e6

    def risk(node: int) -> float:
        r, t = states.get(f"r{node}", [0.0, now])
        return r * math.exp(-(now - t) / P.decay)

    score = e.score + 0.5 * risk(e.info_src)
    written = 0
    if e.score >= P.high:
        share, reached, front = 0.3 * score, {e.info_src, e.info_dst}, [e.info_src]
        for node in dict.fromkeys((e.info_src, e.info_dst)):
            states[f"r{node}"] = [max(risk(node), share), now]
        for _ in range(P.hops):
            share *= P.back
            before = dict.fromkeys(int(n) for at in front for n in states.get(f"k{at}", []))
            front = [n for n in before if n not in reached]
            reached.update(front)
            for node in front:
                states[f"r{node}"] = [max(risk(node), share), now]
                written += 1
    if e.info_src != e.info_dst:
        name = f"k{e.info_dst}"
        states[name] = [*(n for n in states.get(name, []) if n != e.info_src), float(e.info_src)][-P.neighbours :]
    return e.host, int(e.stream_pos), int(e.event_id), round(score, 6), written


def fresh_chain() -> list[float]:
    """What a node holds before its first event: bonus, support, time of its last change, bits of actions, kinds and neighbours; of each slot neighbour, score, time."""
    return [0.0, 0.0, -math.inf, 0.0, 0.0, 0.0, *[-1.0, 0.0, -math.inf] * P.chain_slots]


def neighbour_bit(node: int) -> int:
    return 1 << (int(node) * 2654435761 & 31)


def _chain_fallen(x, o: int, now: float) -> None:
    """Bonus and support fall; if nothing is left of them, bits and slots are forgotten."""
    if x[o + 2] != now:
        fall = math.exp((x[o + 2] - now) / P.decay)
        x[o] *= fall
        x[o + 1] *= fall
        x[o + 2] = now
    if x[o + 1] <= 1e-4 and x[o] <= 1e-4 and x[o + 3]:
        for i, first in enumerate(fresh_chain()[3:], o + 3):
            x[i] = first


def _chain_edge(x, o: int, other: int, bit: int, action: int, kind: int, share: float, now: float) -> None:
    """A node takes an event with ``other``, whose score is ``share`` times P.high: support, bits, and a slot: its own, a free one, or the weakest."""
    _chain_fallen(x, o, now)
    x[o + 1] = min(x[o + 1] + share, P.chain_support_cap)
    x[o + 3], x[o + 4], x[o + 5] = int(x[o + 3]) | 1 << action, int(x[o + 4]) | 1 << kind, int(x[o + 5]) | bit
    weakest, at = math.inf, -1
    for i in range(o + 6, o + 6 + 3 * P.chain_slots, 3):
        if x[i] == other or x[i] < 0:
            at = i
            break
        if (score := x[i + 1] * math.exp((x[i + 2] - now) / P.decay)) < weakest:
            weakest, at = score, i
    if at >= 0:
        x[at], x[at + 1], x[at + 2] = other, max(share, x[at + 1]), now


def chain_event(held, s: int, d: int, bits: tuple[int, int], action: int, kinds: tuple[int, int], score: float, now: float) -> float:
    """The larger bonus of the event's ends before it; then both take the event, if it scores high, and pass on what they have.

    ``held`` gives a node's numbers (``fresh_chain``) and where they begin. Scores are in units of P.high. A bonus falls, and rises to what
    support, diversity and the best neighbour give; it goes to the neighbours in the node's slots, raised by what these scored. It is as of the
    node's last change.
    """
    (x, o), (y, q) = held(s), held(d)
    before, share, p = max(x[o], y[q]), score / P.high, P
    least, weight, decay, exp, log1p = p.chain_from, p.chain_neighbour, p.decay, math.exp, math.log1p
    if s != d and share >= least:
        _chain_edge(x, o, d, bits[1], action, kinds[1], share, now)
        _chain_edge(y, q, s, bits[0], action, kinds[0], share, now)
    for x, o in ((x, o), (y, q)) if s != d else ((x, o),):
        _chain_fallen(x, o, now)
        diversity = int(x[o + 3]).bit_count() + int(x[o + 4]).bit_count() + min(int(x[o + 5]).bit_count(), 8)
        if diversity < p.chain_diversity:
            continue
        best, near = 0.0, []
        for i in range(o + 6, o + 6 + 3 * p.chain_slots, 3):
            if x[i] < 0:
                break  # slots fill in their order
            over = x[i + 1] * exp((x[i + 2] - now) / decay) - least
            near.append((int(x[i]), over if over > 0 else 0.0))
            if over > best:
                best = over
        seed = p.chain_support * log1p(x[o + 1]) + p.chain_kinds * log1p(diversity) + weight * best
        if seed > p.chain_cap:
            seed = p.chain_cap
        if seed > x[o]:
            x[o] = seed
        else:
            seed = x[o]
        for node, over in near:
            bonus = seed + weight * over
            if bonus > p.chain_cap:
                bonus = p.chain_cap
            z, r = held(node)
            if bonus > z[r]:
                _chain_fallen(z, r, now)
                z[r] = bonus
    return round(before, 9)


def _chain(states, e) -> tuple:
    """Decayed support and diversity of actions, kinds and neighbours at a node, as a bonus that it shares with the neighbours that scored highest."""

    def held(node: int):
        name = f"c{node}"
        x = states.get(name)
        x = fresh_chain() if x is None else x if isinstance(x, list) else list(x)
        states[name] = x
        return x, 0

    kinds = list(SCALE)
    ends = (neighbour_bit(e.info_src), neighbour_bit(e.info_dst)), ACTIONS.index(e.action), (kinds.index(e.src_kind), kinds.index(e.dst_kind))
    return e.host, int(e.stream_pos), chain_event(held, e.info_src, e.info_dst, *ends, float(e.score), e.ts_us / 1e6)


def _residual(states, e) -> tuple:
    """Distance of the event's vector to the mean of global, source and destination memory, before they change."""
    z = message(e.action, e.src_kind, e.dst_kind)
    names = ("g", f"n{e.info_src}", f"n{e.info_dst}")
    known = [np.asarray(h) for n in names if (h := states.get(n)) is not None]
    d = z - (sum(known) / len(known) if known else 0.0)
    for n in dict.fromkeys(names):
        _ema(states, n, z)
    return e.host, int(e.stream_pos), round(float(d @ d) / D, 9)


def _adaptive(states, e) -> tuple:
    """A threshold steered by the observed alert rate: up above 1.5 times the target, down below half of it."""
    seen, alerts, threshold = states.get("t", [0.0, 0.0, P.alert])
    alert = e.score >= threshold
    seen, alerts = seen + 1, alerts + alert
    used = threshold
    if seen > P.warm_up:
        rate = alerts / seen
        threshold *= 1.05 if rate > 1.5 * P.rate else 0.95 if rate < 0.5 * P.rate else 1.0
    states["t"] = [seen, alerts, threshold]
    return e.host, int(e.stream_pos), round(used, 6), bool(alert)


def _memory(states, e) -> tuple:
    """A running mean vector for each kind of event: its root mean square distance to the event's vector z, and whether z was kept out.

    From P.least_kept vectors on, a vector further away than the kept ones' mean distance and P.tail deviations is quarantined: it
    leaves mean and distances as they are. Before, the distance is 0.
    """
    z, n = np.asarray(e.z, float), states.get("n", [0.0])[0]
    mean = np.asarray(states.get("m", np.zeros(len(z))))
    gap = float(np.sqrt(((z - mean) ** 2).mean())) if n >= P.least_kept else 0.0
    count, centre, spread = states.get("g", [0.0, 0.0, 0.0])
    out = count >= P.least_kept and gap > centre + P.tail * math.sqrt(spread / count)
    if not out:
        states["n"], states["m"] = [n + 1], mean + (z - mean) / (n + 1)
        if n >= P.least_kept:
            away = gap - centre
            centre += away / (count + 1)
            states["g"] = [count + 1, centre, spread + away * (gap - centre)]
    return e.host, e.action, e.src_kind, e.dst_kind, int(e.stream_pos), int(e.event_id), round(gap, 9), bool(out)


def _node_vector(keep: np.ndarray):
    def step(states, e) -> tuple:
        h = _ema(states, "h", message(e.action, e.kind, e.peer_kind), keep=keep)
        return e.host, int(e.node_id), int(e.stream_pos), length(h)

    return step


def _s4d(states, e) -> tuple:
    """32 complex modes, kept interleaved: x <- pole x + B m, read 2 Re(C x)."""
    x = np.asarray(states.get("x", [0.0] * 2 * _MODES))
    x = _POLES * (x[::2] + 1j * x[1::2]) + _IN @ message(e.action, e.kind, e.peer_kind)
    states["x"] = np.stack([x.real, x.imag], 1).ravel().tolist()
    return e.host, int(e.node_id), int(e.stream_pos), round(float(np.linalg.norm(2 * (x @ _OUT).real)), 6)


def _burst(states, e) -> tuple:
    now, x = e.ts_us / 1e6, math.log1p(max(e.score, 0.0))
    value, t = states.get("b", [0.0, now])
    prev = value * math.exp(-(now - t) / P.decay)
    states["b"] = [min(P.burst_cap, prev + x), now]
    return e.host, int(e.node_id), int(e.stream_pos), round(x * math.log1p(prev), 6)


def _risk_updates(states, e) -> tuple | None:
    """Alert again only if the gain over the last emitted score is large, absolutely or relatively."""
    threshold = P.alert
    if e.score < threshold:
        return None
    prev = states.get("e", [0.0])[0]
    if prev and e.score - prev < max(0.5, 0.1 * threshold) and e.score < 1.2 * max(prev, threshold, 1.0):
        return None
    states["e"] = [e.score]
    return e.host, int(e.node_id), int(e.stream_pos), float(e.score), float(prev)


def _pool(states, e) -> tuple:
    """Sum of a node's 32 best scores so far."""
    best = sorted([*states.get("p", []), float(e.score)], reverse=True)[:32]
    states["p"] = best
    return e.host, int(e.node_id), int(e.stream_pos), round(sum(best), 4)


def _bounded_risk(states, e) -> tuple:
    """Decayed risk of a host's nodes: at most P.most_risks of them, and none untouched for P.risk_ttl; who goes is the least risky.

    All risks fall at one rate, so their order only changes with touches: ln(risk) + t / decay of the last touch is a key for good. The keys
    are a heap (h<i>: key, node, touch; values of the state by name, so that a step reads a few); an entry counts only if its touch is
    the node's last. Touches queue up by time (q<i>), and the front of the queue leaves as it passes the time to live. The heap is built
    anew when it holds more than four times as many entries as there are nodes, so both stay bounded. Ends of the event itself stay.
    """
    now, gone = e.ts_us / 1e6, []

    def forget(node: int) -> None:
        states.pop(f"r{node}")
        states["n"] = [states["n"][0] - 1]
        gone.append(node)

    def swap(i: int, j: int) -> None:
        states[f"h{i}"], states[f"h{j}"] = list(states[f"h{j}"]), list(states[f"h{i}"])

    def push(entry: list[float]) -> None:
        i = int(states.get("heap", [0.0])[0])
        states["heap"], states[f"h{i}"] = [i + 1.0], entry
        while i and tuple(states[f"h{i}"]) < tuple(states[f"h{(i - 1) // 2}"]):
            swap(i, (i - 1) // 2)
            i = (i - 1) // 2

    def pop() -> list[float]:
        size = int(states["heap"][0]) - 1
        swap(0, size)
        least = list(states.pop(f"h{size}"))
        states["heap"] = [float(size)]
        i = 0
        while (j := 2 * i + 1) < size:
            if j + 1 < size and tuple(states[f"h{j + 1}"]) < tuple(states[f"h{j}"]):
                j += 1
            if tuple(states[f"h{i}"]) <= tuple(states[f"h{j}"]):
                break
            swap(i, j)
            i = j
        return least

    def touch(node: int) -> float:
        risk, n, t, _ = states.get(f"r{node}", [0.0, 0.0, now, 0.0])
        if not n:
            states["n"] = [states.get("n", [0.0])[0] + 1]
        risk = max(risk * math.exp(-(now - t) / P.decay), e.score / 1e4 + math.log1p(n) - 0.1 * n**0.5)
        touched = states.get("touches", [0.0])[0] + 1
        states["touches"], states[f"r{node}"] = [touched], [risk, n + 1, now, touched]
        push([math.log(max(risk, 1e-300)) + now / P.decay, float(node), touched])
        head, tail = states.get("queue", [0.0, 0.0])
        states[f"q{int(tail)}"], states["queue"] = [float(node), touched, now], [head, tail + 1]
        return round(risk, 9)

    head, tail = states.get("queue", [0.0, 0.0])
    while head < tail and states[f"q{int(head)}"][2] < now - P.risk_ttl:
        node, touched, _ = states.pop(f"q{int(head)}")
        head += 1
        if states.get(f"r{int(node)}", [0, 0, 0, -1])[3] == touched:
            forget(int(node))
    states["queue"] = [head, tail]
    ends = list(dict.fromkeys((e.info_src, e.info_dst)))
    risks = [touch(node) for node in ends]
    spared = []
    while states["n"][0] > P.most_risks and states["heap"][0] > 0:
        key, node, touched = pop()
        if states.get(f"r{int(node)}", [0, 0, 0, -1])[3] != touched:
            continue
        if int(node) in ends:
            spared.append([key, node, touched])
        else:
            forget(int(node))
    for entry in spared:
        push(entry)
    if states["heap"][0] > 4 * max(states["n"][0], 16):
        kept = [x for _ in range(int(states["heap"][0])) if states.get(f"r{int((x := pop())[1])}", [0, 0, 0, -1])[3] == x[2]]
        for entry in kept:
            push(entry)
    return e.host, int(e.stream_pos), int(e.event_id), risks[0], risks[-1], int(states["n"][0]), gone


# Of node kinds, the first is evicted first.
EVICTED_FIRST = {"netflow": 0, "file": 1, "process": 2}


def _bounded(protect: bool):
    """At most P.most_states node states in a host: of the kind that goes first, the longest untouched is evicted, never an end of the event itself.

    Touches queue up for each kind, and an entry counts only if the node wasn't touched again since, so that a step takes few
    look-ups however many states there are. With ``protect``, nodes of an alert are passed over for P.protected events. An evicted
    state goes into its kind's prototype, from which new nodes of the kind start.
    """

    def touch(states, e, node: int, kind: str, z) -> float:
        name, pos = f"m{node}", float(e.stream_pos)
        known = states.get(name)
        if known is None:
            h = np.asarray(states.get(f"proto{kind}", np.zeros(D)))
            states["n"] = [states.get("n", [0.0])[0] + 1]
            until = -1.0
        else:
            h, until = np.asarray(states[f"h{node}"]), known[1]
        start = length(h)
        if protect and e.score >= P.alert:
            until = pos + P.protected
        states[f"h{node}"] = KEEP * h + (1 - KEEP) * z
        states[name] = [pos, until]
        queue(states, EVICTED_FIRST.get(kind, 0), node, pos)
        return start

    def queue(states, k: int, node: int, pos: float) -> None:
        head, tail = states.get(f"q{k}", [0.0, 0.0])
        states[f"q{k}:{int(tail)}"] = [float(node), pos]
        states[f"q{k}"] = [head, tail + 1]

    def evict(states, e) -> tuple[int | None, int]:
        spared = 0
        for kind, k in EVICTED_FIRST.items():
            head, tail = states.get(f"q{k}", [0.0, 0.0])
            kept, gone = [], None
            while head < tail and gone is None:
                node, pos = states.pop(f"q{k}:{int(head)}")
                head += 1
                now = states.get(f"m{int(node)}")
                if now is None or now[0] != pos:
                    continue  # touched again, or gone
                if int(node) in (e.info_src, e.info_dst) or now[1] >= e.stream_pos:
                    spared += now[1] >= e.stream_pos
                    kept.append([node, pos])
                    continue
                gone = int(node)
            for x in reversed(kept):  # passed over: they stay in front, in their order
                head -= 1
                states[f"q{k}:{int(head)}"] = x
            states[f"q{k}"] = [head, tail]
            if gone is not None:
                h = np.asarray(states.pop(f"h{gone}"))
                states.pop(f"m{gone}")
                proto = np.asarray(states.get(f"proto{kind}", np.zeros(D)))
                states[f"proto{kind}"] = (1 - P.prototype) * proto + P.prototype * h
                states["n"] = [states["n"][0] - 1]
                return gone, spared
        return None, spared

    def step(states, e) -> tuple:
        z = message(e.action, e.src_kind, e.dst_kind)
        src_start = touch(states, e, e.info_src, e.src_kind, z)
        dst_start = touch(states, e, e.info_dst, e.dst_kind, z) if e.info_dst != e.info_src else src_start
        gone, spared = None, 0
        if states["n"][0] > P.most_states:
            gone, spared = evict(states, e)
        return e.host, int(e.stream_pos), int(states["n"][0]), gone, int(spared), src_start, dst_start

    return step


def _sketch(states, e) -> tuple:
    """Decayed support of a bucket of (source, relation, kinds), and of how many actions it has seen; one action alone counts half."""
    now = e.ts_us / 1e6
    support, mask, t = states.get("s", [0.0, 0.0, now])
    support *= math.exp(-(now - t) / P.decay)
    bits = int(mask) | 1 << ACTIONS.index(e.action)
    states["s"] = [support + 1, float(bits), now]
    return e.host, int(e.bucket), int(e.stream_pos), round(math.log1p(support) * (1.0 if bits.bit_count() > 1 else 0.5), 9)


def _closure(states, e) -> tuple:
    """An actor's decayed support, its kinds and actions so far, how new the object is to it, and the best score it had with the object."""
    now = e.ts_us / 1e6
    support, actions, kinds, objects, t = states.get("a", [0.0, 0.0, 0.0, 0.0, now])
    support *= math.exp(-(now - t) / P.decay)
    seen, best = states.get(f"o{e.object_id}", [0.0, 0.0])
    actions, kinds = int(actions) | 1 << ACTIONS.index(e.action), int(kinds) | 1 << list(SCALE).index(e.object_kind)
    states["a"] = [support + 1, float(actions), float(kinds), objects + (seen == 0), now]
    states[f"o{e.object_id}"] = [seen + 1, max(best, e.score)]
    return e.host, int(e.actor_id), int(e.stream_pos), round(math.log1p(support) * actions.bit_count() * kinds.bit_count() / (1 + math.log1p(seen)), 9), max(best, float(e.score))


def _mixed_states(states, e) -> tuple:
    """The event's vector mixed with the states of source, destination and host before it, and how far it lies from the mix."""
    z = message(e.action, e.src_kind, e.dst_kind)
    names = (f"n{e.info_src}", f"n{e.info_dst}", "g")
    h = [np.zeros(D) if (x := states.get(n)) is None else np.asarray(x) for n in names]
    mix = unit(z + 0.3 * h[0] + 0.3 * h[1] + 0.1 * h[2])
    for n in dict.fromkeys(names):
        _ema(states, n, mix)
    return e.host, int(e.stream_pos), int(e.event_id), round(1.0 - float(z @ mix), 9)


_ENDS = ("info_src", "info_dst")
_VECTOR = ("action", "src_kind", "dst_kind", *_ENDS)
_RISK = ("event_id", *_ENDS, "score", "ts_us")
_TOUCH = ("action", "kind", "peer_kind", "score", "ts_us")
_HOST, _NODE = ("host",), ("host", "node_id")


def _by_blocks(name: str, *args):
    """What makes the block form of a step; ``blocks`` imports this module."""

    def made():
        from tracewell.streaming import blocks

        return getattr(blocks, name)(*args)

    return made


def _host(inputs: tuple[str, ...], output: str, step, *block) -> Fold:
    """Of an event only ``inputs`` are sent to its host's task and ordered there."""
    return Fold(_HOST, ("stream_pos",), inputs, f"host string, stream_pos long, {output}", step, _by_blocks(*block) if block else None)


def _node(output: str, step, *block) -> Fold:
    return Fold(_NODE, ("stream_pos",), _TOUCH, f"host string, node_id long, stream_pos long, {output}", step, _by_blocks(*block) if block else None)


#: over ``flow`` (with the bucket of (source, relation, kinds), for the sketch)
EVENT_FOLDS: dict[str, Fold] = {
    "host_state_fold": _host(("event_id", *_VECTOR), "event_id long, src_norm double, dst_norm double, score double", _flow, "HostState"),
    "probationary_memory": _host(_VECTOR, "src_read double, dst_read double", _probation, "Probation"),
    "risk_propagation": _host(_RISK, "event_id long, raised double, written int", _propagated, "Propagated"),
    "online_node_risk": _host(_RISK, "event_id long, src_risk double, dst_risk double, nodes long, gone array<long>", _bounded_risk, "BoundedRisk"),
    "compact_chain_bonus": _host((*_VECTOR, "score", "ts_us"), "bonus double", _chain, "Chain"),
    "temporal_memory_residual": _host(_VECTOR, "residual double", _residual, "Residual"),
    "adaptive_threshold": _host(("score",), "threshold double, is_alert boolean", _adaptive, "Adaptive"),
    "lru_eviction": _host((*_VECTOR, "score"), "n_states long, evicted long, spared long, src_start double, dst_start double", _bounded(False), "Bounded", False),
    "alert_protection": _host((*_VECTOR, "score"), "n_states long, evicted long, spared long, src_start double, dst_start double", _bounded(True), "Bounded", True),
    "lowrank_state_baseline": _host(("event_id", *_VECTOR), "event_id long, distance double", _mixed_states, "MixedStates"),
    "actor_object_closure": Fold(("host", "actor_id"), ("stream_pos",), ("action", "object_id", "object_kind", "score", "ts_us"), "host string, actor_id long, stream_pos long, closure double, best_link double", _closure),
    "episode_sketch": Fold(("host", "bucket"), ("stream_pos",), ("action", "ts_us"), "host string, bucket long, stream_pos long, support double", _sketch),
    "adaptive_memory": Fold(("host", "action", "src_kind", "dst_kind"), ("stream_pos",), ("event_id", "z"), "host string, action string, src_kind string, dst_kind string, stream_pos long, event_id long, gap double, quarantined boolean", _memory),
}
#: over ``touch``
NODE_FOLDS: dict[str, Fold] = {
    "node_state_ema": _node("norm double", _node_vector(KEEP), "node_vector", KEEP),
    "node_state_realdiag": _node("norm double", _node_vector(REALDIAG_KEEP), "node_vector", REALDIAG_KEEP),
    "node_state_s4d": _node("norm double", _s4d, "s4d"),
    "decayed_burst": _node("signal double", _burst),
    "risk_update_alerts": _node("score double, previous double", _risk_updates),
    "online_node_pool": _node("pool double", _pool),
}
