"""Approximate nearest neighbours by multi-index hashing: rotated binary codes, split into substrings that are each indexed.

Codes. Unit vectors are centred, projected on at most MOST_DIMENSIONS principal directions and turned by learned rotations
(iterative quantisation), as many as make BITS bits; their signs are the code. They are fitted on at most SAMPLE distinct vectors,
the first by a hash. Every vector is indexed.

Search. A code within R bits of a query's differs from it in at most ``R // substrings`` bits in some substring (one bit
less suffices in all but the first ``R % substrings + 1``), so probing the cells of those values in each substring retrieves
every code within R. A query starts with a small radius and widens it until its nearest are safe: until a vector as near as
the last of them would lie within the radius, given the bits in which codes at that angle differ (mean and SAFE
standard deviations). The first radii are fixed shares of the bits, the next is what the query itself needs. Queries that still
find fewer rows than they are due (outliers, small tables) double theirs, up to all bits, so that each has all its ranks. Only ids
and codes are shuffled to probe; of the codes within the radius the entries' numbers go on, 16 bits each, to where the
vectors are, which are read last, for cosines in double precision, each vector times a power of two: components of any size count.

How much is probed depends on the data: of vectors without structure a query's nearest differ in over a third of the
bits, and then most cells are within the pigeonhole's reach, though few codes are within the radius (README has figures).

Skew. Equal vectors are one entry, with the smallest of their ids: more can't be among the nearest. Cells are laid out one after
the other over parts of PART_ROWS index rows; a cell with more goes over several parts, and a query goes to all of them.
A part's rows are gathered in a task; queries stream past them.

Defined results. Vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows with a null vec_id. A row that repeats another in full counts once. Ties go to the smaller vec_id. An
empty table gives no rows. Only vec_id and embedding are read, so that no other column's name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.common import shuffle_partitions, stage

SAMPLE, SEED, ROUNDS = 20_000, 42, 30
BITS, MOST_DIMENSIONS, SUBSTRING = 128, 64, 16
#: the first radii as shares of the bits, and the standard deviations between a safe neighbour and the radius
FIRST_RADII, SAFE = (0.19, 0.38), 1.0
PART_ROWS = 200_000
NEAREST, EVERY = 5, 50
_LOW = 16


def v_type(vectors: DataFrame) -> str:
    """The type that vectors are kept in: single precision only if that is what they have."""
    return "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, v (array of double) of rows that take part, and their length."""
    v = F.col("embedding")
    v = v if v_type(vectors) == "array<float>" else v.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (length["d"] if length else -1)), length["d"] if length else 0


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, each times the power of two that brings its largest component near 1, so that no square over- or underflows."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if x.size else x


class Code:
    """Codes of ``bits`` bits, as columns of 64-bit words, and their substrings."""

    def __init__(self, mean: np.ndarray, turn: np.ndarray, substring: int = SUBSTRING):
        self.mean, self.turn = mean, turn
        self.bits, self.words = turn.shape[1], -(-turn.shape[1] // 64)
        self.substrings = max(1, self.bits // substring)
        ends = np.linspace(0, self.bits, self.substrings + 1).astype(int)
        self.spans = list(zip(ends[:-1].tolist(), np.diff(ends).tolist()))

    def codes(self, x: np.ndarray) -> np.ndarray:
        x = scaled(x)
        on = (x / np.linalg.norm(x, axis=1, keepdims=True) - self.mean) @ self.turn > 0
        raw = np.packbits(on, axis=1, bitorder="little")
        return np.pad(raw, ((0, 0), (0, 8 * self.words - raw.shape[1]))).view("<u8")

    def values(self, codes: np.ndarray) -> np.ndarray:
        """The substrings' values, one column each."""
        on = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8), axis=1, bitorder="little")
        return np.stack([on[:, a : a + n].astype(np.int64) @ (1 << np.arange(n)) for a, n in self.spans], axis=1)

    def limits(self, radius: int) -> np.ndarray:
        """For each substring, in how many bits a value to be probed may differ."""
        least, extra = divmod(radius, self.substrings)
        return np.where(np.arange(self.substrings) <= extra, least, least - 1)

    def needed(self, cosine: np.ndarray) -> np.ndarray:
        """The radius within which vectors of a cosine are safe."""
        p = np.arccos(np.clip(cosine, -1, 1)) / np.pi
        return np.minimum(np.ceil(self.bits * p + SAFE * np.sqrt(self.bits * p * (1 - p))), self.bits).astype(np.int64)


def learn(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = SEED) -> Code:
    """Principal directions and the rotations that bring the projected sample nearest to its signs, from several beginnings."""
    x = scaled(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    centred = unit - mean
    _, directions = np.linalg.eigh(centred.T @ centred)
    directions = directions[:, ::-1][:, :MOST_DIMENSIONS]
    p, turns, rng = centred @ directions, [], np.random.default_rng(seed)
    for _ in range(max(1, bits // p.shape[1])):
        turn = np.linalg.qr(rng.normal(size=(p.shape[1], p.shape[1])))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(p @ turn > 0, 1.0, -1.0).T @ p)
            turn = (u @ vt).T
        turns.append(directions @ turn)
    return Code(mean, np.concatenate(turns, axis=1)[:, :bits])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Cells:
    """Where index rows go: cells in the order of (substring, value), laid out over parts of ``part_rows`` rows."""

    def __init__(self, code: Code, j: np.ndarray, value: np.ndarray, count: np.ndarray, part_rows: int):
        order = np.lexsort((value, j))
        self.j, self.value, count = j[order], value[order], count[order]
        start = np.cumsum(count) - count
        self.first, self.last = start // part_rows, (start + count - 1) // part_rows
        self.parts = int(self.last[-1]) + 1 if len(count) else 1
        self.bounds = np.searchsorted(self.j, np.arange(code.substrings + 1))
        self.code = code

    def index_parts(self, values: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The part of each row and substring."""
        out = np.empty(values.shape, np.int64)
        for j in range(values.shape[1]):
            at = self.bounds[j] + np.searchsorted(self.value[self.bounds[j] : self.bounds[j + 1]], values[:, j])
            out[:, j] = self.first[at] + number % (self.last[at] - self.first[at] + 1)
        return out

    def query_parts(self, values: np.ndarray, radius: int) -> np.ndarray:
        found = np.zeros(self.parts + 1, np.int64)
        for j, limit in enumerate(self.code.limits(radius)):
            a, b = self.bounds[j], self.bounds[j + 1]
            at = a + np.flatnonzero(np.bitwise_count(self.value[a:b] ^ values[j]) <= limit)
            np.add.at(found, self.first[at], 1)
            np.add.at(found, self.last[at] + 1, -1)
        return np.flatnonzero(np.cumsum(found[:-1]))


def _words(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    return np.stack([batch.column(first + i).to_numpy() for i in range(n)], axis=1).view(np.uint64)


def search(vectors: DataFrame, every: int = EVERY, nearest: int = NEAREST, code: Code | None = None, part_rows: int = PART_ROWS, probed: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found for each row whose vec_id is divisible by ``every``.

    ``probed``, if given, gets a row for each pass: queries, the sums of their radii, of codes probed and of codes in reach.
    """
    spark = vectors.sparkSession
    rows, d = usable(vectors)
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    take, vectors_as = nearest + 1, v_type(vectors)  # one may be the query itself
    rows = rows.dropDuplicates(["vec_id", "v"])
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= take)
    entries = best.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("no", F.monotonically_increasing_id())
    entries = stage(entries.select("no", "ids", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")), "index-entries")
    if code is None:
        sample = entries.orderBy(F.xxhash64("k1"), "k1").limit(SAMPLE).select("v").collect()  # at most SAMPLE rows
        code = learn(np.array([r.v for r in sample], np.float64))
    words = [f"c{i}" for i in range(code.words)]
    w = len(words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = code.codes(_matrix(b.column(1), d)).view(np.int64) if b.num_rows else np.zeros((0, w), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(codes[:, i])) for i in range(w))], names=["no", *words])

    ddl = ", ".join(f"{c} long" for c in words)
    coded = stage(entries.select("no", "v").mapInArrow(encode, f"no long, {ddl}"), "index-codes")

    def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = code.values(_words(b, 1, w))
            for j in range(code.substrings):
                value, n = np.unique(values[:, j], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), j, np.int32)), pa.array(value.astype(np.int32)), pa.array(n)], names=["j", "value", "n"])

    # one row for each cell that is used: substrings x 2 ** SUBSTRING at most, whatever the input
    cells = coded.mapInArrow(in_cells, "j int, value int, n long").groupBy("j", "value").agg(F.sum("n").alias("n")).toArrow()
    placed = Cells(code, *(cells.column(c).to_numpy().astype(np.int64) for c in ("j", "value", "n")), part_rows)
    shared = spark.sparkContext.broadcast(placed)
    size = entries.agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).first()
    due = min(take, size["ids"])
    asked = stage(rows.where(F.col("vec_id") % every == 0).select(F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"), F.col("vec_id").alias("query_id")).join(entries.select("k1", "k2", "no"), ["k1", "k2"]).select("query_id", "no"), "index-asked")
    queries = stage(asked.select("no").distinct().join(coded, "no").join(entries.select("no", "v"), "no").select("no", "v", *words), "index-queries")

    def spread_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = code.substrings
        for b in batches:
            values, no = code.values(_words(b, 1, w)), b.column(0).to_numpy()
            at = pa.array(np.repeat(np.arange(len(no)), n))
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.index_parts(values, no).ravel().astype(np.int32)), pa.array(np.zeros(len(at), np.int8)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(no))), *(x.take(at) for x in b.columns)], names=names)

    def spread_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                c = b.slice(a, 1024)
                parts = [shared.value.query_parts(v, r) for v, r in zip(code.values(_words(c, 2, w)), c.column(0).to_pylist())]
                at = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
                part = np.concatenate(parts).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.ones(len(part), np.int8)), *(x.take(at) for x in c.columns)], names=names)

    # j holds the radius in a query's row
    names, spread_ddl = ["part", "kind", "j", "no", *words], f"part int, kind byte, j int, no long, {ddl}"
    index = coded.mapInArrow(spread_index, spread_ddl)
    vector_rows = entries.select(F.shiftright("no", _LOW).alias("block"), F.lit(0).cast("byte").alias("kind"), F.col("no").bitwiseAND(F.lit((1 << _LOW) - 1)).alias("no"), F.element_at("ids", 1).alias("least"), F.lit(None).cast("binary").alias("reach"), "v")

    def looked_up(reached: DataFrame) -> DataFrame:
        """query, score, vec_id: the nearest of the entries that are in reach (query, block, reach) of each query, at most ``take``."""
        sent = reached.join(queries.select(F.col("no").alias("query"), "v"), "query").select("block", F.lit(1).cast("byte").alias("kind"), F.col("query").alias("no"), F.lit(None).cast("long").alias("least"), "reach", "v")
        near = vector_rows.unionByName(sent).repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block", "kind").mapInArrow(_rerank(d, take), "query long, no long, least long, score double")
        top = near.dropDuplicates(["query", "no"]).withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least", "no"))).where(F.col("n") <= take)
        found = top.select("query", "no", "score").join(entries.select("no", "ids"), "no").select("query", "score", F.explode("ids").alias("vec_id"))
        return found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= take).select("query", "score", "vec_id")

    needs = F.pandas_udf(lambda s: pd.Series(code.needed(s.to_numpy())), "long")
    fixed = [round(r * code.bits) for r in FIRST_RADII]
    todo, done = queries.select("no", *words, F.lit(fixed.pop(0)).cast("int").alias("radius")), []
    while True:
        probes = todo.select("radius", "no", *words).mapInArrow(spread_queries, spread_ddl)
        dealt = index.unionByName(probes).repartition(max(shuffle_partitions(spark), min(placed.parts, 20_000)), "part").sortWithinPartitions("part", "kind")
        reached = stage(dealt.mapInArrow(_probe(code, probed is not None), "query long, block long, reach binary, probed long, hits long"), "index-reached")
        if probed is not None:
            probed.append((*todo.agg(F.count("*"), F.sum("radius")).first(), *reached.agg(F.sum("probed"), F.sum("hits")).first()))
        found = stage(looked_up(reached.where("block is not null").select("query", "block", "reach")), "index-found")
        state = found.groupBy(F.col("query").alias("no")).agg(F.count("*").alias("n"), F.min("score").alias("last"))
        state = todo.join(state, "no", "left").withColumn("need", F.when(F.coalesce("n", F.lit(0)) >= due, needs("last")))
        open_ = state.where(F.col("radius") < code.bits).where("need is null or need > radius")
        open_ = stage(open_.select("no", *words, "radius", "need"), "index-open")
        done.append(found.join(open_.select(F.col("no").alias("query")), "query", "left_anti"))
        if open_.isEmpty():
            break
        # a query without its due ranks can't tell what it needs: its radius is doubled, up to all bits
        wider = F.lit(fixed.pop(0)) if fixed else F.coalesce("need", F.least(2 * F.col("radius"), F.lit(code.bits)))
        todo = open_.select("no", *words, wider.cast("int").alias("radius"))
    pairs = asked.join(reduce(DataFrame.unionByName, done), F.col("no") == F.col("query")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(part, kind, rows) of rows sorted by their first two columns."""
    for b in batches:
        if b.num_rows:
            parts, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1]))))
            for a, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(parts)]):
                yield int(parts[a]), int(kinds[a]), b.slice(a, e - a)


def _probe(code: Code, counted: bool):
    """Rows (part, kind, j, no, code) sorted by part and kind: queries probe the part's cells; entries in reach go on by blocks of numbers.

    With ``counted``, the codes that were probed are counted, too, each once.
    """

    def built(rows: list[pa.RecordBatch]) -> dict:
        j, no = (np.concatenate([b.column(i).to_numpy() for b in rows]) for i in (2, 3))
        codes = np.concatenate([_words(b, 4, code.words) for b in rows])
        values = code.values(codes)
        own = values[np.arange(len(j)), j]
        order = np.lexsort((own, j))
        j, own = j[order], own[order]
        first = np.flatnonzero(np.concatenate(([True], (j[1:] != j[:-1]) | (own[1:] != own[:-1]))))
        return {"no": no[order], "code": codes[order], "values": values[order], "j": j[first], "value": own[first], "first": first, "count": np.diff(np.append(first, len(j)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_part, held, index = None, [], None
        for part, kind, b in _by_part(batches):
            if part != at_part:
                at_part, held, index = part, [], None
            if kind == 0:
                held.append(b)
                continue
            if held:
                index, held = built(held), []
            if index is None:
                continue
            out = []
            codes = _words(b, 4, code.words)
            for radius, no, c, v in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), codes, code.values(codes)):
                limit = code.limits(radius)
                cell = np.flatnonzero(np.bitwise_count(index["value"] ^ v[index["j"]]) <= limit[index["j"]])
                n = index["count"][cell]
                rows = np.repeat(index["first"][cell] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                j = np.repeat(index["j"][cell], n)
                near = np.bitwise_count(index["code"][rows, 0] ^ c[0])
                for k in range(1, code.words):
                    near = near + np.bitwise_count(index["code"][rows, k] ^ c[k])
                near = near <= radius
                # a code that several substrings find is taken for the first of them
                mine = lambda rows, j: np.argmax(np.bitwise_count(index["values"][rows] ^ v) <= limit, axis=1) == j  # noqa: B023, E731
                n_probed = int(mine(rows, j).sum()) if counted else 0
                rows, j = rows[near], j[near]
                found = np.sort(index["no"][rows[mine(rows, j)]])
                blocks = found >> _LOW
                cuts = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1]))) if len(found) else np.zeros(0, np.int64)
                low = (found & ((1 << _LOW) - 1)).astype("<u2")
                out.append((no, None, None, n_probed, len(found)))
                out += [(no, int(blocks[a]), low[a:e].tobytes(), 0, 0) for a, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(found)])]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["query", "block", "reach", "probed", "hits"])

    return run


def _rerank(d: int, take: int):
    """Rows (block, kind, no, least, reach, v) sorted by block and kind: cosines of a block's vectors in reach with each query that comes by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_block, held, number, least, x, norm = None, [], None, None, None, None
        for block, kind, b in _by_part(batches):
            if block != at_block:
                at_block, held, x = block, [], None
            if kind == 0:
                held.append(b)
                continue
            if held:
                number, least = (np.concatenate([y.column(i).to_numpy() for y in held]) for i in (2, 3))
                order = np.argsort(number)
                x = np.concatenate([_matrix(y.column(5), d) for y in held])[order]
                number, least, x = number[order], least[order], x if x.dtype == np.float32 else scaled(x)
                norm, held = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64)), []
            if x is None:
                continue
            out = []
            for query, reach, v in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), scaled(_matrix(b.column(5), d))):
                at = np.searchsorted(number, np.frombuffer(reach, "<u2"))
                score = np.einsum("ij,j->i", x[at].astype(np.float64), v) / (norm[at] * np.sqrt(np.einsum("i,i->", v, v)))
                first = np.lexsort((least[at], -score))[:take]
                out.append((np.full(len(first), query), (block << _LOW) | number[at[first]], least[at[first]], score[first]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in zip(*out)], names=["query", "no", "least", "score"])

    return run
