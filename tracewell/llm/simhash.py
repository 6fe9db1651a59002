"""SimHash near-duplicates: documents whose fingerprints differ in few bits, found by self-joins of binary tries.

Fingerprints. A-Z are lower-cased, words are runs of bytes other than ASCII white space, shingles are three words joined by
a space (the whole sequence if there are fewer). A bit is set if it is set in over half of the shingles' XXH64 (seed 42).
A text without words, or null, has fingerprint zero and is linked like any other.

Links. Equal fingerprints are collapsed first. The distinct ones form a binary trie that is joined with itself: pairs of
nodes are walked together from the (root, root) pair on, level by level; differing bits add up, a pair over the budget is
pruned, and fingerprints themselves are compared only where both nodes have come down to one.

Routes spread that join over tasks. Two fingerprints that differ in at most two bits agree on one of three groups of k bits
(at bits 0, 21 and 42), so each goes to three routes, rotated so that the agreed bits lead. k is only as large as it must be
for a route to hold about ROUTE_KEYS fingerprints and for every shuffle partition to have one, so routes are wide and the
trie decides what links. A route of over LARGE_ROUTE fingerprints is divided by the trie's own node pairs: its next
SPLIT_BITS levels are walked at once, and each fingerprint goes to the pairs of nodes in which it may still have a partner;
what is still too large is divided again, down to single fingerprints. A task therefore gathers LARGE_ROUTE
fingerprints at most. It sends the links on as a forest (each fingerprint and its least partner reachable in the route),
never as all pairs, and components are found by alternating star contractions on that forest.

Defined results. Rows with a null doc_id are fingerprinted and linked; a component's id is its smallest doc_id that isn't
null (null if there is none). Repeated rows stay repeated. An empty table gives no rows. Texts of any length are read
whole, one at a time. Only doc_id and the text column are read, so that no other column's name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import shuffle_partitions, sized_blocks, stage, text_bytes

BITS, BUDGET, SEED, SHINGLE = 64, 2, 42, 3
#: first bits of the three groups, counted from the highest bit; any prefix of up to 21 bits can serve
STARTS = (0, 21, 42)
#: fingerprints that a route should hold; over the second number it is divided
ROUTE_KEYS, LARGE_ROUTE = 1 << 15, 1 << 17
#: levels of the trie by which a large route is divided
SPLIT_BITS = 6
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip([0, *(e + 1 for e in ends)], ends[SHINGLE - 1 :])]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Unsigned 64-bit fingerprints. Bits are counted in eight byte-wide lanes at once, in runs of at most 255 hashes."""
    out = np.zeros(len(texts), np.uint64)
    hashes = [np.array(shingle_hashes(t), np.uint64) for t in texts]
    sizes = np.array([len(h) for h in hashes])
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return out
    flat, starts = np.concatenate([hashes[i] for i in rows]), np.cumsum(sizes[rows]) - sizes[rows]
    runs = -(-sizes[rows] // 255)
    first_run = np.cumsum(runs) - runs
    at = np.repeat(starts, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first_run, runs))
    for k in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(k)) & _LANES, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
        for byte in range(8):
            out[rows] |= (2 * counts[:, byte] > sizes[rows]).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", row: str | None = None) -> DataFrame:
    """doc_id, the column ``row`` if it is named, and the fingerprint as a signed long of the same bits."""
    named = [F.col("doc_id").cast("long").alias("doc_id"), *([F.col(row).cast("long").alias(row)] if row else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column(0))
            fps = [fingerprints(texts[i:j]) for i, j in sized_blocks([len(t) for t in texts], 2_000_000)]
            fp = np.concatenate(fps).view(np.int64) if fps else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp)], names=[*b.schema.names[1:], out])

    return docs.select(F.col(text).alias("text"), *named).mapInArrow(run, f"doc_id long, {f'{row} long, ' if row else ''}{out} long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def least_labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Least reachable index for each of n nodes, given links a-b and the labels so far."""
    label = np.arange(n) if label is None else label
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        low, high = np.minimum(la, lb)[differ], np.maximum(la, lb)[differ]
        np.minimum.at(label, high, low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped


def trie_components(groups: np.ndarray, keys: np.ndarray, budget: int = BUDGET, most: int = 1 << 17) -> np.ndarray:
    """Least index reachable in each group over links of at most ``budget`` bits; keys are sorted within their group.

    A trie node is a range of the sorted keys that share a prefix. All groups are walked at once from their (root, root)
    pairs; frontiers of over ``most`` node pairs are split and taken one after the other, so memory stays bounded.
    """
    n = len(keys)
    label = np.arange(n)
    if n < 2:
        return label
    ones: dict[int, np.ndarray] = {}

    def before(depth: int) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int32)))
        return ones[depth]

    start = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    end = np.append(start[1:], n)
    keep = end - start > 1
    frontiers = [(0, start[keep], end[keep], start[keep], end[keep], np.zeros(keep.sum(), np.int8))]
    while frontiers:
        depth, alo, ahi, blo, bhi, err = frontiers.pop()
        if len(alo) > most:
            half = len(alo) // 2
            frontiers += [(depth, *(x[half:] for x in (alo, ahi, blo, bhi, err))), (depth, *(x[:half] for x in (alo, ahi, blo, bhi, err)))]
            continue
        small = (ahi - alo == 1) & (bhi - blo == 1)  # both nodes hold one key
        if small.any():
            a, b = alo[small], blo[small]
            linked = (a != b) & (popcount(keys[a] ^ keys[b]) <= budget)
            label = least_labels(n, a[linked], b[linked], label)
        alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        one = before(depth)
        amid, bmid = ahi - (one[ahi] - one[alo]), bhi - (one[bhi] - one[blo])
        own = (alo == blo) & (ahi == bhi)
        parts = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1), (amid[~own], ahi[~own], blo[~own], bmid[~own], err[~own] + 1)]
        nxt = [np.concatenate(x) for x in zip(*parts)]
        alive = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= budget) & ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1) & (nxt[3] - nxt[2] == 1))
        if alive.any():
            frontiers.append((depth + 1, *(x[alive] for x in nxt)))
    return label


def _group_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fp, key, route), routes one after the other, to (fp, root): fingerprints that aren't the least of their links."""

    def joined(fp: np.ndarray, key: np.ndarray, route: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((key.view(np.uint64), route))
        fp, key, route = fp[order], key[order].view(np.uint64), route[order]
        # a divided route may bring a key along two ways
        once = np.concatenate(([True], (route[1:] != route[:-1]) | (key[1:] != key[:-1])))
        fp, key, route = fp[once], key[once], route[once]
        label = trie_components(route, key)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], names=["u", "v"])

    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        held.append(tuple(b.column(i).to_numpy() for i in range(3)))
        if sum(len(x[0]) for x in held) >= ROUTE_KEYS:
            fp, key, route = (np.concatenate(x) for x in zip(*held))
            # whole routes go; the last may continue in the next batch
            cut = int(np.flatnonzero(route != route[-1])[-1]) + 1 if (route != route[-1]).any() else 0
            held = [(fp[cut:], key[cut:], route[cut:])]
            if cut:
                yield joined(fp[:cut], key[:cut], route[:cut])
    if held and (fp := np.concatenate([x[0] for x in held])).size:
        yield joined(fp, *(np.concatenate([x[i] for x in held]) for i in (1, 2)))


def _divided(large: DataFrame) -> DataFrame:
    """Routes divided by the pairs of trie nodes SPLIT_BITS levels further down that are still within the budget."""
    bits = min(SPLIT_BITS, BITS)
    flips = [sum(1 << b for b in range(bits) if x >> b & 1) for x in range(1 << bits) if x.bit_count() <= BUDGET]
    # levels from depth on; past the last bit a key has zeros
    node = F.expr(f"shiftrightunsigned(shiftleft(key, depth), {BITS - bits})")
    node = F.when(F.col("depth") >= BITS, F.lit(0).cast("long")).otherwise(node)
    each = large.withColumn("node", node).withColumn("flip", F.explode(F.array(*map(F.lit, flips)))).withColumn("other", F.col("node").bitwiseXOR(F.col("flip").cast("long")))
    spent = F.col("err") + F.bit_count("flip")
    return each.where(spent <= BUDGET).select(
        "fp", "key", F.xxhash64("route", F.least("node", "other"), F.greatest("node", "other"), "depth").alias("route"), (F.col("depth") + bits).alias("depth"), spent.cast("int").alias("err")
    )


def _routes(distinct: DataFrame, bits: int) -> DataFrame:
    """Three rows (fp, key, route, depth, err) for each fingerprint: the key is rotated, the route is its first ``bits`` bits."""
    key = [F.col("fp") if a == 0 else F.shiftleft("fp", a).bitwiseOR(F.shiftrightunsigned("fp", BITS - a)) for a in STARTS]
    rows = F.array(*(F.struct(F.lit(i).alias("start"), k.alias("key")) for i, k in enumerate(key)))
    each = distinct.select("fp", F.explode(rows).alias("r")).select("fp", "r.start", "r.key")
    lead = F.shiftrightunsigned("key", BITS - bits) if bits else F.lit(0).cast("long")
    return each.select("fp", "key", F.xxhash64("start", lead).alias("route"), F.lit(bits).alias("depth"), F.lit(0).alias("err"))


def link_forest(distinct: DataFrame) -> DataFrame:
    """Links (u, v) between fingerprints, a spanning forest in each route."""
    partitions = shuffle_partitions(distinct.sparkSession)
    bits = min(STARTS[1], max(0, (max(partitions, -(-distinct.count() // ROUTE_KEYS)) - 1).bit_length()))
    todo, done = _routes(distinct, bits), []
    while True:
        # two sums a route on the map side; what is over the bound is few and large
        large = todo.groupBy("route").count().where(F.col("count") > LARGE_ROUTE).select("route")
        large = stage(large, "simhash-large")
        if large.isEmpty():
            done.append(todo)
            break
        done.append(todo.join(large, "route", "left_anti"))
        todo = stage(_divided(todo.join(large, "route", "left_semi").where(F.col("depth") < BITS)), "simhash-divided")
    sent = reduce(DataFrame.unionByName, done).select("fp", "key", "route")
    return sent.repartition(partitions, "route").sortWithinPartitions("route").mapInArrow(_group_forest, "u long, v long")


def components(edges: DataFrame, label: str = "star") -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), by alternating large and small stars until nothing changes."""

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)))).first()

    cur = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    seen = state(cur)
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = stage(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), label)
        down = star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        cur = stage(down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
        now = state(cur)
        if now == seen:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now


def _rooted(by_fp: DataFrame) -> DataFrame:
    """The columns of ``by_fp`` (fp and others, a row for each fingerprint) and the root of its component."""
    linked = components(link_forest(by_fp.select("fp")), "simhash-star")
    return by_fp.join(linked, by_fp.fp == linked.node, "left").select(*by_fp.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long) and component_id for every row of ``docs`` (doc_id, text)."""
    fps = stage(with_fingerprints(docs), "simhash-fp")
    by_fp = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    rooted = _rooted(by_fp)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = stage(rooted.join(ids, "root").select("fp", "component_id"), "simhash-member")
    return fps.join(member, "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of near-duplicates: that with the smallest doc_id, and of several such the first; rows without doc_id stay.

    What is kept is decided for rows, not for ids: of rows that repeat an id with an unlike text, each stands for its own
    component. Rows are numbered in a written copy, ids and numbers decide, and texts are shuffled once, to their numbers.
    """
    row = next(f"__row{i}" for i in range(len(docs.columns) + 1) if f"__row{i}" not in docs.columns)
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    fps = with_fingerprints(numbered.where(F.col("doc_id").isNotNull()), row=row)
    by_fp = stage(fps.groupBy("fp").agg(F.min(F.struct("doc_id", F.col(row).alias("row"))).alias("first")), "simhash-distinct")
    kept = _rooted(by_fp).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    unnamed = numbered.where(F.col("doc_id").isNull())
    return numbered.where(F.col("doc_id").isNotNull()).join(kept, row, "left_semi").unionByName(unnamed).drop(row)
