"""Suffix arrays of byte strings in numpy: Larsson-Sadakane refinement, Kasai common prefixes, merging by binary search."""

from __future__ import annotations

import numpy as np

#: the least big-endian words with 1, 2, ... 8 bytes that aren't zero
_BYTE_STEPS = np.array([1 << 8 * k for k in range(8)], np.uint64)


def padded_words(text: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first n positions on, as big-endian numbers (zeros after the end)."""
    buf = np.zeros(n + 8, np.uint8)
    buf[: min(len(text), n + 8)] = text[: n + 8]
    return np.ndarray((n,), ">u8", buf, strides=(1,)).astype(np.uint64)


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Positions in the order of their suffixes' first ``depth`` bytes or more, ties in any order; those ``wanted``, or all.

    Larsson-Sadakane: a suffix's rank is the last place of its group of equal prefixes; each round doubles the prefix, and
    sorts only groups that still have several suffixes, by the rank that lies one prefix further on. A suffix that ends
    before that is the lesser, the more so the shorter it is. Positions that aren't wanted only serve to rank the others,
    and are left out of the last round.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words = padded_words(text, n)
    order = np.argsort(words)
    sorted_ = words[order]
    ends = np.append(sorted_[1:] != sorted_[:-1], True)
    for word in np.unique(words[max(0, n - 7) :]):  # the zeros after the end are no bytes of the text
        a, b = np.searchsorted(sorted_, word), np.searchsorted(sorted_, word, side="right")
        left = np.minimum(n - order[a:b], 8)
        to = np.argsort(left, kind="stable")
        order[a:b], left = order[a:b][to], left[to]
        ends[a : b - 1] = left[1:] != left[:-1]
    last = np.flatnonzero(ends)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(last, np.diff(last, prepend=-1))
    # places of groups with several suffixes; groups are consecutive and stay so
    several = np.repeat(np.diff(last, prepend=-1) > 1, np.diff(last, prepend=-1))
    open_, size = np.flatnonzero(several), 8
    while size < depth:
        if wanted is not None and 2 * size >= depth:
            order = order[wanted[order]]
            group = rank[order]
            open_ = np.flatnonzero(np.append(group[1:] == group[:-1], False) | np.concatenate(([False], group[1:] == group[:-1])))
        if not len(open_):
            break
        at = order[open_]
        group = rank[at]
        ahead = np.where(at + size < n, rank[np.minimum(at + size, n - 1)] + size, n - at - 1)
        key = group * np.int64(n + size + 1) + ahead
        to = np.argsort(key)
        at, key = at[to], key[to]
        order[open_] = at
        if 2 * size >= depth:
            break
        stops = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        counts = np.diff(stops, prepend=-1)
        rank[at] = np.repeat(open_[stops], counts)
        open_ = open_[np.repeat(counts > 1, counts)]
        size *= 2
    return order if wanted is None or 2 * size >= depth else order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, lane: int = 64) -> np.ndarray:
    """For each place in ``order``, the bytes its suffix shares with the one before it, counted up to ``most``.

    Kasai's walk through the text, where each position starts from one less than its predecessor had; taken in lanes of
    ``lane`` positions that step together, eight bytes at a time. ``order`` may leave positions out, and need only hold for
    the suffixes' first ``most`` bytes: where it puts the next position before its old neighbour's next one (a tie that
    later bytes don't break), or lacks one of them, the count starts anew.
    """
    n, m = len(text), len(order)
    out = np.zeros(m, np.int64)
    if m < 2:
        return out
    place = np.full(n + 1, -1, np.int64)
    place[order] = np.arange(m)
    walk = np.sort(order)
    words = padded_words(text, n + most + 8)
    starts = np.arange(0, m, lane)
    h = np.zeros(len(starts), np.int64)
    for step in range(lane):
        live = np.flatnonzero(starts + step < m)
        i = walk[starts[live] + step]
        at = place[i]
        live, i, at = live[at > 0], i[at > 0], at[at > 0]
        j = order[at - 1]
        k = h[live]
        bound = np.minimum(most, n - np.maximum(i, j))
        grow = np.flatnonzero(k < bound)
        while len(grow):
            x = words[i[grow] + k[grow]] ^ words[j[grow] + k[grow]]
            same = 8 - np.searchsorted(_BYTE_STEPS, x, side="right")
            k[grow] += same
            grow = grow[(same == 8) & (k[grow] < bound[grow])]
        k = np.minimum(k, bound)
        out[at] = k
        h[:] = 0
        ahead = place[i + 1]
        fits = (ahead > 0) & (place[j + 1] >= 0)
        fits[fits] = place[j[fits] + 1] < ahead[fits]
        h[live] = np.where(fits, np.maximum(k - 1, 0), 0)
    return out


def window_keys(text: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from each position in ``at`` on, as rows of big-endian numbers that compare like the bytes."""
    cols = []
    for first in range(0, width, 8):
        w = padded_words(text[first:], max(len(text) - first, 1))
        col = w[np.minimum(at, len(w) - 1)]
        if width - first < 8:
            col = col >> np.uint64(8 * (8 - (width - first)))
        cols.append(col)
    return np.stack(cols, axis=1)


def binary_search(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each row of ``keys``, the place of an equal row of ``sorted_keys``, or -1."""
    out = np.full(len(keys), -1, np.int64)
    if not len(sorted_keys) or not len(keys):
        return out
    # the first column narrows the range; the others decide within it
    lead = np.ascontiguousarray(sorted_keys[:, 0])
    lo, hi = np.searchsorted(lead, keys[:, 0]), np.searchsorted(lead, keys[:, 0], side="right")
    for c in range(1, keys.shape[1]):
        live = np.flatnonzero(lo < hi)
        column, want = sorted_keys[:, c], keys[live, c]
        one = hi[live] - lo[live] == 1
        hi[live[one]] = lo[live[one]] + (column[lo[live[one]]] == want[one])
        live, want = live[~one], want[~one]
        ends = []
        for right in (False, True):
            a, b = lo[live], hi[live].copy()
            while (open_ := np.flatnonzero(a < b)).size:
                mid = (a[open_] + b[open_]) // 2
                less = column[mid] <= want[open_] if right else column[mid] < want[open_]
                a[open_] = np.where(less, mid + 1, a[open_])
                b[open_] = np.where(less, b[open_], mid)
            ends.append(a)
        lo[live], hi[live] = ends
    hit = lo < hi
    out[hit] = lo[hit]
    return out


def least_owner(pieces: list[bytes], owner: np.ndarray, width: int, shard_bytes: int) -> list[np.ndarray]:
    """For each piece and each of its windows of ``width`` bytes: the least owner of a piece that holds an equal window.

    Pieces are laid into shards of about ``shard_bytes``; each shard gets a suffix array and common prefixes, which put
    equal windows in runs; a run's windows are then searched in the runs of all other shards.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    cut = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(sizes))) // shard_bytes, prepend=-1)) if len(pieces) else np.zeros(0, int)
    shards = []
    for a, b in zip(cut, [*cut[1:], len(pieces)]):
        if a == b:
            continue
        text = np.frombuffer(b"".join(pieces[a:b]), np.uint8)
        # windows that lie in one piece
        ends = np.cumsum(sizes[a:b])
        starts = np.zeros(len(text), bool)
        edge = np.zeros(len(text) + 1, np.int8)
        edge[ends - sizes[a:b]] += 1
        edge[ends - width + 1] -= 1
        starts = np.cumsum(edge[:-1], dtype=np.int8) > 0
        order = suffix_array(text, width, starts)
        run = np.cumsum(common_prefixes(text, order, width) < width, dtype=np.int32) - 1
        own = np.repeat(owner[a:b], sizes[a:b] - width + 1)
        by_place = np.cumsum(starts, dtype=np.int32)[order] - 1
        first = np.flatnonzero(np.diff(run, prepend=-1))
        best = np.minimum.reduceat(own[by_place], first) if len(first) else own
        shards.append({"place": by_place, "count": np.diff(np.append(first, len(run))), "best": best, "keys": window_keys(text, order[first], width) if len(cut) > 1 else None, "windows": sizes[a:b] - width + 1})
    merged = [s["best"].copy() for s in shards]
    for i, s in enumerate(shards):
        for j, other in enumerate(shards):
            if i != j:
                found = binary_search(other["keys"], s["keys"])
                hit = found >= 0
                merged[i][hit] = np.minimum(merged[i][hit], other["best"][found[hit]])
    out = []
    for s, best in zip(shards, merged):
        by_position = np.empty(len(s["place"]), np.int64)
        by_position[s["place"]] = np.repeat(best, s["count"])
        out += np.split(by_position, np.cumsum(s["windows"])[:-1])
    return out
