"""Byte-level BPE with a public vocabulary: a segment tree over the ranks of adjacent pairs decides each merge.

A word's symbols are the leaves' places; a leaf holds the rank of the pair that starts there, and inner nodes the least of
their children, so the root yields the lowest rank and, among equal ones, the leftmost place. A merge changes three leaves
(the pair itself, the one before, the one that vanishes) and the nodes above them, until the root shows that no mergeable
pair is left. Many words are taken at once: row i of every array is word i's tree, and all rows step together.

Texts are taken in blocks. A block's words (the vocabulary's splitting rule, applied to all its characters at once) are
made a dictionary by Arrow, so that each distinct word is looked up or merged once, and a text's ids are gathered from the
distinct words' ids. The look-up table is bounded and starts anew when full. The special token's string in a text becomes
its id, as in the library.

A word of over LONG_WORD bytes is merged by itself: all places of the root's rank, found by descending the tree, merge in
one round, left to right. That is exact where every merge's result only takes part in later merges (checked for the
vocabulary; else the places go one by one), and a word of a megabyte takes rounds by distinct ranks, not by bytes.

Defined results. Null text is empty: no ids. Any text decodes to itself. Rows with a null doc_id are encoded like others,
repeated rows each on their own, an empty table gives no rows. Only doc_id and the text column are read, so that no other
column's name can clash.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import sized_blocks, text_bytes

# Fixed values of the vocabulary's format: white space as it means it, and the endings that stand as words of their own.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")
LONG_WORD = 256
_NONE = np.iinfo(np.int64).max


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary: itself if printable in Latin-1, else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.first = np.array([ids[letters[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([ids[m[k]] for m in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = left << 20 | right
        by = np.argsort(keys)
        self.keys, self.rank_of = keys[by], by
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        pair = np.arange(1 << 16)
        self.byte_rank = self.rank(self.first[pair >> 8], self.first[pair & 255]).astype(np.int32)
        made = {int(i): r for r, i in enumerate(self.merged)}
        #: every merge's result only takes part in later merges
        self.ordered = all(made.get(int(x), -1) < r for r, pair in enumerate(zip(left, right)) for x in pair) and len(made) == len(self.merged)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.sizes[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(total)].tobytes()


def merge_words(words: list[bytes], vocabulary: Vocabulary, most_cells: int = 1 << 19) -> list[np.ndarray]:
    """Each word's ids."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
    lengths = np.array([len(w) for w in words], np.int64)
    widths = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    for width in np.unique(widths[lengths <= LONG_WORD]):
        rows = np.flatnonzero((widths == width) & (lengths <= LONG_WORD))
        step = max(1, most_cells // int(width))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            sym, n = _merge_block([words[i] for i in part], lengths[part], int(width), vocabulary)
            ends = np.cumsum(n)
            for i, a, b in zip(part.tolist(), (ends - n).tolist(), ends.tolist()):
                out[i] = sym[a:b]
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = _merge_long(words[i], vocabulary)
    return out


def _merge_long(word: bytes, v: Vocabulary) -> np.ndarray:
    """The ids of one long word: each round merges all places of the root's rank."""
    n = len(word)
    width = 1 << (n - 1).bit_length()
    shift = width.bit_length()
    sym = v.first[np.frombuffer(word, np.uint8)]
    place = np.arange(n)
    after, before = np.append(place[1:], -1), place - 1
    alive = np.ones(n, bool)
    tree = np.full(2 * width, _NONE)
    rank = v.rank(sym[:-1], sym[1:])
    tree[width : width + n - 1] = np.where(rank >= 0, rank << shift | place[:-1], _NONE)
    size = width
    while size > 1:
        tree[size // 2 : size] = np.minimum(tree[size : 2 * size : 2], tree[size + 1 : 2 * size : 2])
        size //= 2
    while tree[1] != _NONE:
        r = int(tree[1]) >> shift
        if v.ordered:
            nodes = np.ones(1, np.int64)
            while nodes[0] < width:
                nodes = np.stack((2 * nodes, 2 * nodes + 1), axis=1).ravel()
                nodes = nodes[tree[nodes] >> shift == r]
            at = nodes - width
            # where places overlap (a run of one symbol), every other one of the run merges
            follows = np.concatenate(([False], after[at[:-1]] == at[1:]))
            if follows.any():
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(follows, 0, k))) % 2 == 0]
        else:
            at = np.array([int(tree[1]) & ((1 << shift) - 1)])
        gone = after[at]
        sym[at] = v.merged[r]
        alive[gone] = False
        nxt = after[gone]
        after[at] = nxt
        before[nxt[nxt >= 0]] = at[nxt >= 0]
        prev = before[at][before[at] >= 0]
        tree[width + gone] = _NONE
        for x in (at, prev):
            y = after[x]
            rank = np.where(y >= 0, v.rank(sym[x], sym[np.maximum(y, 0)]), -1)
            tree[width + x] = np.where(rank >= 0, rank << shift | x, _NONE)
        nodes = (width + np.concatenate((at, gone, prev))) >> 1
        while nodes[0]:
            nodes = np.unique(nodes) if len(nodes) > 8 else nodes
            tree[nodes] = np.minimum(tree[2 * nodes], tree[2 * nodes + 1])
            nodes = nodes >> 1
    return sym[alive]


def _merge_block(words: list[bytes], lengths: np.ndarray, width: int, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    n = len(words)
    raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
    place = np.arange(width, dtype=np.int32)
    alive = place < lengths[:, None]
    shift = width.bit_length()
    # ranks and places fit into 32 bits: LONG_WORD bounds the places, the vocabulary the ranks
    whole = np.int32 if len(v.merged) << shift < 1 << 31 else np.int64
    none = np.iinfo(whole).max
    sym = v.first.astype(np.int32)[raw]
    after = np.where(place + 1 < lengths[:, None], place + 1, np.int32(-1))
    before = np.tile(place - 1, (n, 1))
    tree = np.full((n, 2 * width), none, whole)
    rank = v.byte_rank[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]]
    tree[:, width : 2 * width - 1] = np.where((rank >= 0) & alive[:, 1:], rank.astype(whole) << shift | place[:-1], none)
    size = width
    while size > 1:
        tree[:, size // 2 : size] = np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2])
        size //= 2
    # flat views: row i's place p is i * width + p
    flat_sym, flat_after, flat_before, flat_alive, flat_tree = (x.reshape(-1) for x in (sym, after, before, alive, tree))
    rows = np.arange(n)
    root = tree[:, 1]
    while len(rows := rows[root != none]):
        root = root[root != none]
        base, top = rows * width, rows * (2 * width)
        at = root & ((1 << shift) - 1)
        gone = flat_after[base + at]
        new = v.merged[root >> shift]
        flat_sym[base + at] = new
        flat_alive[base + gone] = False
        nxt, prev = flat_after[base + gone], flat_before[base + at]
        flat_after[base + at] = nxt
        on = nxt >= 0
        flat_before[(base + nxt)[on]] = at[on]
        r = np.where(on, v.rank(new, flat_sym[base + np.maximum(nxt, 0)].astype(np.int64)), -1).astype(whole)
        flat_tree[top + width + at] = np.where(r >= 0, r << shift | at, none)
        flat_tree[top + width + gone] = none
        has = np.flatnonzero(prev >= 0)
        p = prev[has]
        r = v.rank(flat_sym[base[has] + p].astype(np.int64), new[has]).astype(whole)
        flat_tree[top[has] + width + p] = np.where(r >= 0, r << shift | p, none)
        for who, leaf in ((top, gone), (top, at), (top[has], p)):
            node = (width + leaf.astype(np.int64)) >> 1
            while node.size and node[0]:
                left = who + 2 * node
                flat_tree[who + node] = np.minimum(flat_tree[left], flat_tree[left + 1])
                node = node >> 1
        root = flat_tree[top + 1]
    return sym[alive], alive.sum(axis=1)


@cache
def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, for every code point."""
    every = "".join(map(chr, range(0x110000)))
    out = np.full(len(every), 3, np.uint8)
    for k, members in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, f"[{SPACE}]+")):
        for m in regex.finditer(members, every):
            out[m.start() : m.end()] = k
    return out


def word_starts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a word begins at each of the code points; ``starts``: where texts begin.

    Words are runs of one class. White space before a word gives its last character to a word of its own, or, if that is
    a blank, to the word. A lone apostrophe takes one of the fixed endings.
    """
    n = len(points)
    kind = _classes()[points]
    fresh = np.ones(n + 3, bool)
    np.not_equal(kind[1:], kind[:-1], out=fresh[1:n])
    edge = np.zeros(n + 3, bool)
    edge[starts] = True
    edge[n:] = True
    fresh |= edge
    begin = fresh.copy()
    last = np.flatnonzero((kind == 0) & fresh[1 : n + 1] & ~edge[1 : n + 1])
    begin[last] = True
    begin[last[points[last] == 32] + 1] = False
    mark = np.flatnonzero(points == 39)
    mark = mark[begin[mark] & fresh[mark + 1] & ~edge[mark + 1]]
    if len(mark):
        far = np.concatenate((points, np.zeros(3, points.dtype)))
        one = np.isin(far[mark + 1], [ord(x) for x in SHORT_ENDINGS])
        two = np.zeros(len(mark), bool)
        for a, b in LONG_ENDINGS:
            two |= (far[mark + 1] == ord(a)) & (far[mark + 2] == ord(b)) & ~edge[mark + 2]
        begin[mark[one | two] + 1] = False
        begin[mark[one] + 2] = True
        begin[mark[two] + 3] = True
    return begin[:n]


class Encoder:
    """Ids of texts, with a bounded table of words."""

    def __init__(self, path: str, most_words: int = 500_000):
        self.v = Vocabulary(path)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.v.special)) + ")").split if self.v.special else None
        self.marks = [s.encode() for s in self.v.special]
        self.most_words = most_words
        self._clear()

    def _clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.start, self.size, self.ids, self.filled = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.int32), 0

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the table; words that aren't there are merged."""
        if len(self.words) + len(words) > self.most_words:
            self._clear()
        number = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(number < 0)
        if len(at):
            fresh = [words[i] for i in at.tolist()]
            ids = merge_words(fresh, self.v)
            size = np.array([len(x) for x in ids], np.int64)
            number[at] = np.arange(len(self.start), len(self.start) + len(at))
            self.words.update(zip(fresh, number[at].tolist()))
            total = int(size.sum())
            if self.filled + total > len(self.ids):
                self.ids = np.concatenate((self.ids[: self.filled], np.zeros(max(total, self.filled), np.int32)))
            self.ids[self.filled : self.filled + total] = np.concatenate(ids)
            self.start = np.append(self.start, self.filled + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.filled += total
        return number

    def _plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, one after the other, and where each text's begin (and the end)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        data = b"".join(texts)
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        first = np.cumsum(sizes) - sizes
        if len(points) == len(data):
            at = np.flatnonzero(word_starts(points, first[sizes > 0]))
        else:
            lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            at = lead[word_starts(points, np.searchsorted(lead, first[sizes > 0]))]
        offsets = np.append(at, len(data)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        _, ends, raw = found.dictionary.buffers()
        ends, raw = np.frombuffer(ends, np.int32)[: len(found.dictionary) + 1].tolist(), raw.to_pybytes()
        word = self._numbers([raw[i:j] for i, j in zip(ends, ends[1:])])[found.indices.to_numpy()]
        size = self.size[word]
        ends = np.cumsum(size)
        before = np.concatenate(([0], ends))
        ids = self.ids[np.repeat(self.start[word] - before[:-1], size) + np.arange(int(ends[-1]))]
        return ids, before[np.searchsorted(at, np.append(first, len(data)))]

    def encode_block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (and the end)."""
        if not any(m in t for t in texts for m in self.marks):
            return self._plain(texts)
        parts = [[x for x in self.special(t.decode()) if x] if any(m in t for m in self.marks) else [t.decode()] for t in texts]
        flat = [x for p in parts for x in p]
        ids, at = self._plain([b"" if x in self.v.special else x.encode() for x in flat])
        out = [np.array([self.v.special[x]], np.int32) if x in self.v.special else ids[a:b] for x, a, b in zip(flat, at[:-1], at[1:])]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)
        return np.concatenate([np.zeros(0, np.int32), *out]), ends[np.cumsum([0, *(len(p) for p in parts)])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_blocks(column: pa.Array, path: str, most: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, ids, where each row's begin) of a string column, in blocks of about ``most`` bytes."""
    texts = text_bytes(column)
    for a, b in sized_blocks([len(t) for t in texts], most):
        yield a, b - a, *encoder(path).encode_block(texts[a:b])


def encoded(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every row."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, n, ids, ends in encode_blocks(b.column(1), path):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, n), pa.ListArray.from_arrays(ends.astype(np.int32), ids)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of ids (array of int); bytes that aren't UTF-8 become U+FFFD, as in the library."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = encoder(path).v
            texts = [v.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them; ids never leave the task."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for b in batches:
            for a, n, ids, ends in encode_blocks(b.column(1), path):
                v = encoder(path).v
                raw, at = ids.astype("<u4").tobytes(), ends.tolist()
                text = v.decode(ids)
                cut = np.concatenate(([0], np.cumsum(v.sizes[ids])))[ends].tolist()
                hashed = [sha(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(at, at[1:])]
                back = [sha(text[i:j].decode("utf-8", "replace").encode()).hexdigest() for i, j in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, n), pa.array(np.diff(ends)), pa.array(hashed), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
