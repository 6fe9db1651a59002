"""Exact substring dedup: bytes covered by a 50-byte string that also starts in a document with a smaller doc_id go.

Plan, in passes over a table that is written once, bucketed by chunk (chunks of about CHUNK_BYTES of text), so that the
passes don't shuffle the text itself:

1. Every 50-byte window is known by its anchor, the least hash of the 24-byte strings in it, which depends on the window's
   bytes alone. Neighbouring windows share an anchor and form a run (14 windows on the average). Each chunk sends each
   anchor once, as 32 bits within a range of anchors, and how many runs of it the chunk's documents have, if several do.
2. Each anchor range tells each chunk, by two bits for each anchor sent, which anchors several documents have, and which
   are hot. Only windows of shared anchors can repeat. The chunk sends these runs' bytes, each distinct run once, with its
   first document; of a hot anchor (over HOT_RUNS runs) it sends each distinct window, to the range of a hash of
   the whole window, so that a phrase with ever new surroundings doesn't gather in one task.
3. Each range lays the distinct runs into shards, builds suffix arrays (Larsson-Sadakane refinement) and common
   prefixes (Kasai) of them all, merges the shards by binary search, and returns the least doc_id for each window.
4. The chunk removes what is covered and digests the rest.

What one key can bring to a task: HOT_RUNS runs of an anchor, or one window from each chunk. Ranges and chunks grow in
number with the input, not in size.

Defined results. Null text is empty. Rows with a null doc_id take no part and stay whole. Rows of one doc_id are never
compared with each other. Texts under 50 bytes stay whole. A text larger than a chunk is one row of one chunk, and stands
as a whole. Removal may cut a character: the text column keeps the remaining bytes that decode. Extra columns pass through;
a column that has one of the added names is replaced by it. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import shared_dir, shuffle_partitions, sized_blocks, stage, text_bytes
from tracewell.llm.suffixes import least_owner, window_keys

WIDTH, GRAM = 50, 24
CHUNK_BYTES = 8_000_000
SHARD_BYTES = 2_000_000
#: runs of one anchor over which its windows are dealt out one by one
HOT_RUNS = 1 << 17
#: of text, for a bucket of the written table, where the number of shuffle partitions would give more
BUCKET_BYTES = 256_000_000
_BLOCK = 1 << 19
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M[3]
    h = (h ^ (h >> np.uint64(29))) * _M[4]
    return h ^ (h >> np.uint64(32))


def window_anchors(buf: np.ndarray) -> np.ndarray:
    """The anchor of each window of WIDTH bytes of ``buf``."""
    n = len(buf) - WIDTH + 1
    out = np.empty(max(n, 0), np.uint64)
    for a in range(0, max(n, 0), _BLOCK):
        b = min(a + _BLOCK, n)
        part = np.concatenate((buf[a : b + WIDTH - 1], np.zeros(8, np.uint8)))
        k = b - a + WIDTH - GRAM
        w = np.ndarray((k + GRAM - 8,), "<u8", part, strides=(1,)).copy()
        h = w[:k] * _M[0]
        h += w[8 : k + 8] * _M[1]
        h += w[16 : k + 16] * _M[2]
        h ^= h >> np.uint64(32)
        h *= _M[3]
        h ^= h >> np.uint64(29)
        span, want = 1, WIDTH - GRAM + 1
        while 2 * span <= want:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if span < want:
            h = np.minimum(h[: len(h) - (want - span)], h[want - span :])
        out[a:b] = h
    return out


class Runs:
    """The runs of a chunk's documents: first window, number of windows, document, mixed anchor."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id")
        order = pc.sort_indices(table.select(["doc_id", "__row"]), sort_keys=[("doc_id", "ascending"), ("__row", "ascending")])
        self.table = table.take(order)
        self.ids = self.table.column("doc_id").to_pylist()
        texts = text_bytes(self.table.column("text"))
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.base = np.cumsum(self.sizes) - self.sizes
        long = np.flatnonzero((self.sizes >= WIDTH) & np.array([x is not None for x in self.ids], bool))
        anchors = window_anchors(self.buf)
        n = len(anchors)
        fresh = np.ones(n, bool)
        np.not_equal(anchors[1:], anchors[:-1], out=fresh[1:])
        fresh[self.base[long]] = True
        edge = np.zeros(n + 1, np.int8)
        np.add.at(edge, self.base[long], 1)
        np.add.at(edge, self.base[long] + self.sizes[long] - WIDTH + 1, -1)
        inside = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
        self.at = np.flatnonzero(fresh & inside)
        self.doc = np.searchsorted(self.base[long], self.at, side="right") - 1
        self.doc = long[self.doc] if len(long) else self.doc
        stop = self.base[self.doc] + self.sizes[self.doc] - WIDTH + 1
        self.count = np.minimum(np.append(self.at[1:], n), stop) - self.at
        self.anchor = _mixed(anchors[self.at])
        #: equal doc_ids count as one document
        number = np.zeros(len(self.ids), np.int64)
        for i in range(1, len(self.ids)):
            number[i] = number[i - 1] + (self.ids[i] != self.ids[i - 1])
        self.number = number[self.doc] if len(self.doc) else self.doc
        del ids

    def unique(self, parts: int):
        """Distinct anchors in order, their runs if two documents have them (else 0), where each part begins, and each run's place."""
        order = np.argsort(self.anchor, kind="stable")
        a = self.anchor[order]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(a)) - 1 if len(a) else first
        several = np.where(self.number[order][first] != self.number[order][last], last - first + 1, 0)
        keys = a[first]
        part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        bounds = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        place = np.empty(len(a), np.int64)
        place[order] = np.repeat(np.arange(len(first)), last - first + 1)
        return keys, several, bounds, place


_ANCHORS = "__part int, __chunk long, keys binary, several binary, runs binary"
_SHARED = "__chunk long, __part int, kind int, bits binary, hot binary, places binary, least binary"
_RUNS = "__part int, __chunk long, sizes binary, docs binary, data binary"


def _send_anchors(parts: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("__chunk")[0].as_py()
        keys, several, bounds, _ = Runs(table).unique(parts)
        rows = [(p, chunk, keys[a:b].astype(np.uint32).tobytes(), np.packbits(several[a:b] > 0).tobytes(), several[a:b][several[a:b] > 0].astype(np.uint32).tobytes()) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
        return _rows(rows, _ANCHORS)

    return run


def _rows(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _tell_shared(hot_runs: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """Of all chunks' anchors in a range: which are in several documents, and which of them are hot."""
        part, chunks = table.column("__part")[0].as_py(), table.column("__chunk").to_pylist()
        keys = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
        cut = np.cumsum([len(k) for k in keys])[:-1]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(table.column("several").to_pylist(), keys)])
        runs = np.ones(len(several), np.int64)
        runs[several] = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("runs").to_pylist()])
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], every[order][1:] != every[order][:-1])))
        count = np.diff(np.append(first, len(order)))
        # two anchors of one chunk that agree in these 32 bits are only taken for shared: more to compare, no other result
        shared, hot = several.copy(), np.empty(len(every), bool)
        shared[order] |= np.repeat(count > 1, count)
        hot[order] = np.repeat(np.add.reduceat(runs[order], first) > hot_runs, count)
        return _rows([(c, part, 0, np.packbits(s).tobytes(), np.packbits(h).tobytes(), None, None) for c, s, h in zip(chunks, np.split(shared, cut), np.split(hot, cut))], _SHARED)

    return run


def _window_hash(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    keys = window_keys(buf, at, WIDTH)
    h = np.zeros(len(at), np.uint64)
    for c in range(keys.shape[1]):
        h = _mixed(h ^ keys[:, c] * _M[0])
    return h


class Shared:
    """A chunk's runs whose anchor several documents have, and the distinct ones among them by part, in a fixed order."""

    def __init__(self, runs: Runs, told: pa.Table, parts: int):
        keys, _, bounds, place = runs.unique(parts)
        flag, warm = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for p, kind, bits, hot in zip(*(told.column(c).to_pylist() for c in ("__part", "kind", "bits", "hot"))):
            if kind == 0:
                a, b = bounds[p], bounds[p + 1]
                flag[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
                warm[a:b] = np.unpackbits(np.frombuffer(hot, np.uint8), count=b - a).astype(bool)
        of = np.flatnonzero(flag[place]) if len(place) else np.zeros(0, np.int64)
        at, count, doc, anchor = runs.at[of], runs.count[of], runs.doc[of], runs.anchor[of]
        if (single := warm[place[of]]).any():
            n = np.where(single, count, 1)
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            single, at, doc = np.repeat(single, n), np.repeat(at, n) + step, np.repeat(doc, n)
            anchor = np.where(single, _window_hash(runs.buf, at), np.repeat(anchor, n))
            count = np.where(single, 1, np.repeat(count, n))
        self.at, self.count, self.doc = at, count, doc
        data = runs.buf.tobytes()
        known: dict[bytes, int] = {}
        self.id = np.fromiter((known.setdefault(data[s:e], len(known)) for s, e in zip(at.tolist(), (at + count + WIDTH - 1).tolist())), np.int64, len(at))
        self.pieces = list(known)
        _, first = np.unique(self.id, return_index=True)
        self.owner = np.array([runs.ids[d] for d in doc[first]], np.int64)
        self.part = (((anchor[first] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        self.by_part = np.argsort(self.part, kind="stable")

    def parts(self):
        ends = np.flatnonzero(np.diff(self.part[self.by_part], append=-1)) + 1
        for a, b in zip([0, *ends[:-1]], ends):
            yield int(self.part[self.by_part[a]]), self.by_part[a:b]


def _send_runs(parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not told.num_rows:
            return _rows([], _RUNS)
        shared = Shared(Runs(table), told, parts)
        chunk = table.column("__chunk")[0].as_py()
        return _rows([(p, chunk, np.array([len(shared.pieces[i]) for i in ids], np.int32).tobytes(), shared.owner[ids].tobytes(), pa.compress(b"".join([shared.pieces[i] for i in ids]), "zstd", asbytes=True)) for p, ids in shared.parts()], _RUNS)

    return run


def _tell_least(shard_bytes: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """Of all chunks' runs in a range: the least doc_id for each window, where it changes from the window before."""
        part, chunks = table.column("__part")[0].as_py(), table.column("__chunk").to_pylist()
        known: dict[bytes, int] = {}
        ids, docs = [], []
        for sizes, owner, data in zip(*(table.column(c).to_pylist() for c in ("sizes", "docs", "data"))):
            ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
            data = pa.decompress(data, ends[-1], "zstd", asbytes=True)
            ids.append(np.fromiter((known.setdefault(data[s:e], len(known)) for s, e in zip([0, *ends], ends)), np.int64, len(ends)))
            docs.append(np.frombuffer(owner, np.int64))
        pieces = list(known)
        least = np.full(len(pieces), np.iinfo(np.int64).max)
        for i, d in zip(ids, docs):
            np.minimum.at(least, i, d)
        windows = least_owner(pieces, least, WIDTH, shard_bytes)
        rows = []
        for c, i in zip(chunks, ids):
            flat = np.concatenate([windows[k] for k in i])
            at = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
            rows.append((c, part, 1, None, None, at.astype(np.uint32).tobytes(), flat[at].tobytes()))
        return _rows(rows, _SHARED)

    return run


def _remove(parts: int, schema: T.StructType, text_at: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        runs = Runs(table)
        gone = np.zeros(len(runs.buf) + 1, np.int8)
        if told.num_rows and (told.column("kind").to_numpy() == 1).any():
            shared = Shared(runs, told, parts)
            found = {p: (np.frombuffer(a, np.uint32), np.frombuffer(b, np.int64)) for p, k, a, b in zip(*(told.column(c).to_pylist() for c in ("__part", "kind", "places", "least"))) if k == 1}
            count = np.array([len(p) - WIDTH + 1 for p in shared.pieces], np.int64)
            start, flat = np.zeros(len(count), np.int64), np.zeros(int(count.sum()), np.int64)
            done = 0
            for p, ids in shared.parts():
                start[ids] = done + np.cumsum(count[ids]) - count[ids]
                total = int(count[ids].sum())
                at, value = found[p]
                flat[done : done + total] = np.repeat(value, np.diff(np.append(at.astype(np.int64), total)))
                done += total
            own = np.array([-1 if x is None else x for x in runs.ids], np.int64)
            for a, b in sized_blocks(shared.count.tolist(), _BLOCK):
                ids, n = shared.id[a:b], shared.count[a:b]
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                windows = np.repeat(shared.at[a:b], n) + step
                covered = windows[flat[np.repeat(start[ids], n) + step] < np.repeat(own[shared.doc[a:b]], n)]
                # windows are distinct places; a place may end one window and start another
                gone[covered] += 1
                gone[covered + WIDTH] -= 1
        mask = np.cumsum(gone[:-1], dtype=np.int8) > 0
        n_removed, n_spans, digests, kept, spans = [], [], [], [], []
        for a, size in zip(runs.base, runs.sizes):
            m = mask[a : a + size]
            raw = runs.buf[a : a + size]
            edges = np.flatnonzero(np.diff(m.astype(np.int8), prepend=0, append=0))
            left = raw[~m].tobytes() if len(edges) else raw.tobytes()
            n_removed.append(int(m.sum()))
            n_spans.append(len(edges) // 2)
            digests.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])])
        t = runs.table
        null = t.column("text").is_null().to_pylist()
        columns = {"n_bytes": pa.array(runs.sizes), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
        texts = pa.array([None if x else k.decode("utf-8", "ignore") for x, k in zip(null, kept)], pa.string())
        user = [texts if i == text_at else t.column(f"c{i}") for i in range(text_at_count(t))]
        return pa.table([*user, *columns.values()], names=schema.names)

    return run


def text_at_count(t: pa.Table) -> int:
    return sum(c[0] == "c" and c[1:].isdigit() for c in t.column_names)


_ADDED = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]


def deduplicated(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """The columns of ``docs`` with what is left of each text, then n_bytes, n_removed, n_spans, kept_sha256 and removed (byte spans).

    A column of ``docs`` that has one of the added names is replaced by it.
    """
    spark = docs.sparkSession
    added = {f.name for f in _ADDED}
    fields = [f for f in docs.schema.fields if f.name not in added]
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    size = total["n"] + 64 * total["rows"]
    chunks = max(1, -(-size // chunk_bytes))
    buckets = min(max(shuffle_partitions(spark), -(-size // BUCKET_BYTES)), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    name = f"llm_chunks_{uuid.uuid4().hex}"
    numbered = docs.select(F.monotonically_increasing_id().alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields) if f.name != "text"))
    text_at = [f.name for f in fields].index("text")
    # the text is kept once: its own column is made again in the last pass
    chunked = numbered.withColumn("__chunk", F.pmod(F.xxhash64("__row"), F.lit(chunks)))
    # dealt out as the buckets are, so that each bucket is one file
    chunked.repartition(buckets, "__chunk").write.bucketBy(buckets, "__chunk").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry: the files stay in the shared folder, like all that is staged there
    lean = stored.select("__chunk", "__row", "doc_id", "text").groupBy("__chunk")
    shared = stage(lean.applyInArrow(_send_anchors(chunks), _ANCHORS).groupBy("__part").applyInArrow(_tell_shared(hot_runs), _SHARED), "substring-shared")
    runs = lean.cogroup(shared.groupBy("__chunk")).applyInArrow(_send_runs(chunks), _RUNS)
    least = stage(runs.groupBy("__part").applyInArrow(_tell_least(shard_bytes), _SHARED), "substring-least")
    schema = T.StructType([*fields, *_ADDED])
    whole = stored.withColumn(f"c{text_at}", F.lit(None).cast("string")).select("__chunk", "__row", "doc_id", "text", *(f"c{i}" for i in range(len(fields)))).groupBy("__chunk")
    told = shared.unionByName(least).groupBy("__chunk")
    return whole.cogroup(told).applyInArrow(_remove(chunks, schema, text_at), schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
