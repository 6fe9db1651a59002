"""Vector code compression: product codes by exact integer k-means whose bounds are norms of sums.

Components are floor(4096 x). Vectors are cut into parts, each with a codebook of its own; rounds assign every part to its
nearest entry and move the entries to their parts' means, rounded down. All sums and distances are whole numbers, so that
the result doesn't depend on how rows are dealt out.

Bounds. A row keeps, for each part, its entry, an upper bound on the distance to it, a lower bound on the distance to every
other entry, and the rounds in which these two were exact. All codebooks so far are retained. In a later round the
bounds are moved by the true net displacement of the entries since the bound's own round, ||C_now - C_then||, the norm of
the sum of all steps, which is never more than the sum of the steps' norms that bounds moved round by round add up to. Only
where the moved bounds can't tell (first with the upper bound made exact again) are all entries compared. Bounds are kept
in single precision, rounded outward, and decide only beyond a margin: what they settle is what the comparison would find.

A round is one pass over the rows, each written with its bounds into the shared folder in place of the last round's. Each
task ends with one row of what parts brought to and took from their entries' sums and counts; those add up exactly, and
entries x (vector length + parts) numbers reach the driver, whatever the input.

Defined results. Rows whose vector is null, or holds null or non-finite components, are dropped, as are vectors of another
length than most. Lengths that don't divide evenly make the first parts one longer. Ties between rows of one vec_id are
ordered by their vectors; a null vec_id comes last. With fewer than ``entries`` rows, codebooks have as many entries as
there are rows. Repeated rows count each. Components too large for 64-bit distances are compared in whole numbers of any
size; errors beyond 64 bits are given as the largest long. An empty table gives no rows. Only vec_id, embedding and
label are read, so that no other column's name can clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import emptied, stage, staged_at

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
BLOCK_ROWS = 4096
MARGIN = 1e-5
LARGEST = (1 << 63) - 1

_STATE = np.dtype([("entry", "u1"), ("upper_round", "u1"), ("lower_round", "u1"), ("upper", "<f4"), ("lower", "<f4")])


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE x) as whole numbers of any size."""
    return np.array([math.floor(v * SCALE) if abs(v) < 1e300 else int(v) * SCALE for v in x.ravel().tolist()], object).reshape(x.shape)


class Layout:
    """How vectors of length ``d`` are stored and cut; ``wide`` if their distances may not fit in 64 bits."""

    def __init__(self, d: int, parts: int, wide: bool):
        self.d, self.wide = d, wide
        self.edges = [0, *np.cumsum([d // parts + (p < d % parts) for p in range(parts)]).tolist()]

    @property
    def parts(self) -> int:
        return len(self.edges) - 1

    def encode(self, vectors: np.ndarray) -> list[bytes]:
        stored = vectors.astype("<f8") if self.wide else np.floor(vectors.astype(np.float64) * SCALE).astype("<i4")
        return [v.tobytes() for v in stored]

    def decode(self, column: pa.Array) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(column.to_pylist()), "<f8" if self.wide else "<i4").reshape(-1, self.d)
        whole = _whole(raw) if self.wide else raw.astype(np.int64)
        return [whole[:, a:b] for a, b in zip(self.edges, self.edges[1:])]


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=-1) if x.shape[-1] else np.zeros(x.shape[:-1], np.int64)


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt(_squares(x).astype(np.float64))


class History:
    """Codebooks of all rounds so far, [round][part] -> entries x components, and how far bounds of each round have moved."""

    def __init__(self, books: list[list[np.ndarray]], wide: bool):
        self.books, self.now, self.wide = books, len(books) - 1, wide
        self.moved, self.others_moved, self.apart = [], [], []
        for p, entries in enumerate(books[-1] if not wide else []):
            k = len(entries)
            moved = np.stack([_norm(entries - then[p]) for then in books])
            others = np.where(np.eye(k, dtype=bool), -np.inf, moved[:, None, :]).max(axis=2) if k > 1 else np.zeros_like(moved)
            between = _norm(entries[:, None] - entries[None]) + np.where(np.eye(k, dtype=bool), np.inf, 0)
            self.moved.append(moved)
            self.others_moved.append(others)
            self.apart.append(between.min(axis=1) / 2)

    def assigned(self, p: int, x: np.ndarray, state: np.ndarray | None) -> tuple[np.ndarray, int]:
        """Each row's state after this round's assignment of part ``p``, and how many rows were compared with all entries."""
        entries, n = self.books[-1][p], len(x)
        if state is None or self.wide:
            state, open_ = np.zeros(n, _STATE), np.arange(n)
        else:
            state = state.copy()
            upper = state["upper"] + self.moved[p][state["upper_round"], state["entry"]]
            lower = np.maximum(state["lower"] - self.others_moved[p][state["lower_round"], state["entry"]], self.apart[p][state["entry"]])
            open_ = np.flatnonzero(~_below(upper, lower))
            exact = _norm(x[open_] - entries[state["entry"][open_]])
            state["upper"][open_], state["upper_round"][open_] = _up(exact), self.now
            open_ = open_[~_below(exact, lower[open_])]
        for a in range(0, len(open_), BLOCK_ROWS):
            at = open_[a : a + BLOCK_ROWS]
            squares = _squares(x[at, None, :] - entries[None])
            best = squares.argmin(axis=1)  # of equals the lower index
            state["entry"][at] = best
            if not self.wide:
                distance = np.sqrt(squares.astype(np.float64))
                state["upper"][at] = _up(distance[np.arange(len(at)), best])
                distance[np.arange(len(at)), best] = np.inf
                state["lower"][at] = np.nextafter(distance.min(axis=1).astype(np.float32), np.float32(-np.inf))
                state["upper_round"][at] = state["lower_round"][at] = self.now
        return state, len(open_)


def _below(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return upper * (1 + MARGIN) + MARGIN < lower * (1 - MARGIN)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _round(layout: Layout, history: History, k: int):
    """One round: rows (id, label, x, state, ...) with their new state, and at each task's end a row of what moved between entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((k, b - a + 1), object) for a, b in zip(layout.edges, layout.edges[1:])]
        compared, schema = 0, None
        for batch in batches:
            schema = batch.schema
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                b = batch.slice(a, BLOCK_ROWS)
                parts = layout.decode(b.column(2))
                before = None if b.column(3).null_count else np.frombuffer(b"".join(b.column(3).to_pylist()), _STATE).reshape(-1, layout.parts)
                after = np.empty((b.num_rows, layout.parts), _STATE)
                for p, x in enumerate(parts):
                    old = None if before is None else before[:, p]
                    after[:, p], n = history.assigned(p, x, old)
                    compared += n
                    new = after[:, p]["entry"]
                    went = np.arange(len(x)) if old is None else np.flatnonzero(old["entry"] != new)
                    own = np.concatenate([np.ones((len(x), 1), x.dtype), x], axis=1)[went]
                    moved = np.zeros((k, own.shape[1]), own.dtype)
                    np.add.at(moved, new[went], own)
                    if old is not None:
                        np.subtract.at(moved, old["entry"][went], own)
                    sums[p] = sums[p] + moved.astype(object)
                state = pa.array([row.tobytes() for row in after], pa.binary())
                empty = pa.nulls(b.num_rows, pa.list_(pa.string())), pa.nulls(b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], state, *empty], names=_NAMES)
        if schema is not None:
            total = [str(v) for s in sums for v in s.ravel().tolist()]
            nulls = [pa.nulls(1, f.type) for f in schema][:4]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array([total], pa.list_(pa.string())), pa.array([compared])], names=_NAMES)

    return run


_NAMES = ["vec_id", "label", "x", "state", "moved", "compared"]


def _added(table: pa.Table) -> pa.Table:
    return pa.table({"at": table["at"][:1], "total": pa.array([str(sum(map(int, table["moved"].to_pylist())))])})


def _totals(written: DataFrame, wide: bool) -> dict[int, int]:
    """What moved in all, by place in the layout of sums: one row for each task and place is added up."""
    moved = written.where("moved is not null").select(F.posexplode("moved").alias("at", "moved")).where("moved <> '0'")
    if wide:
        added = moved.groupBy("at").applyInArrow(_added, "at int, total string")
    else:
        added = moved.groupBy("at").agg(F.sum(F.col("moved").cast("decimal(38,0)")).cast("string").alias("total"))
    return {r["at"]: int(r["total"]) for r in added.collect()}  # entries x (length + parts) rows at most


def usable(vectors: DataFrame) -> tuple[DataFrame, int, float]:
    """vec_id, label and v of the rows that take part, the vectors' length, and their largest absolute component."""
    v = F.col("embedding")
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    v = v if single else v.cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", "label", v.alias("v"))
    largest = F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x).cast("double"))), F.lit(0.0))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(largest).alias("largest"))
    most = lengths.orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (most["d"] if most else -1)), *((most["d"], most["largest"]) if most else (0, 0.0))


def compressed(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, compared: list[int] | None = None
) -> tuple[DataFrame, list[list[np.ndarray]]]:
    """vec_id, label, code (entries by part), error (squared distances summed over parts), and the final codebooks by part.

    ``compared``, if given, gets for each round the number of parts that were compared with all entries.
    """
    spark = vectors.sparkSession
    rows, d, largest = usable(vectors)
    schema = rows.schema
    out = f"vec_id {schema['vec_id'].dataType.simpleString()}, label {schema['label'].dataType.simpleString()}, code array<int>, error long"
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # at most ``entries`` rows
    if not first:
        return spark.createDataFrame([], out), []
    wide = 4 * (math.floor(largest) * SCALE + SCALE) ** 2 * max(d, 1) >= 1 << 62 or math.floor(largest) * SCALE + SCALE >= 1 << 31
    layout, k = Layout(d, parts, wide), len(first)
    book = layout.decode(pa.array(layout.encode(np.array([r.v for r in first], np.float64).reshape(k, d)), pa.binary()))
    books, sums = [book], [np.zeros((k, b - a + 1), object) for a, b in zip(layout.edges, layout.edges[1:])]
    starts = np.cumsum([0, *(s.size for s in sums)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
            nulls = [pa.nulls(b.num_rows, t) for t in (pa.binary(), pa.list_(pa.string()), pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(layout.encode(v), pa.binary()), *nulls], names=_NAMES)

    ddl = out.split(", code")[0] + ", x binary, state binary, moved array<string>, compared long"
    current, at = rows.mapInArrow(encode, ddl), None
    for _ in range(rounds):
        history = History(books, wide)
        written, path = staged_at(current.mapInArrow(_round(layout, history, k), ddl), "code-round")
        if at:
            emptied(spark, at)  # the new round has all its rows
        at, current = path, written.where("moved is null")
        moved = _totals(written, wide)
        if compared is not None:
            compared.append(written.agg(F.sum("compared")).first()[0])
        if not moved:
            break  # no part changed its entry: neither will any later
        for p, s in enumerate(sums):
            s += np.array([moved.get(i, 0) for i in range(starts[p], starts[p + 1])], object).reshape(s.shape)
        books.append([_means(s, old, layout) for s, old in zip(sums, books[-1])])
    history = History(books, wide)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            states = None if b.column(3).null_count else np.frombuffer(b"".join(b.column(3).to_pylist()), _STATE).reshape(-1, layout.parts)
            code, error = np.empty((b.num_rows, layout.parts), np.int32), np.zeros(b.num_rows, object)
            for p, x in enumerate(layout.decode(b.column(2))):
                code[:, p] = history.assigned(p, x, None if states is None else states[:, p])[0]["entry"]
                error = error + _squares(x - history.books[-1][p][code[:, p]]).astype(object)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * layout.parts), pa.array(code.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], codes, pa.array([min(e, LARGEST) for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    return current.mapInArrow(finish, out), books[-1]


def _means(sums: np.ndarray, old: np.ndarray, layout: Layout) -> np.ndarray:
    """Sums by counts, rounded down; entries without parts stay."""
    rows = [[v // int(s[0]) for v in s[1:]] if s[0] else was.tolist() for s, was in zip(sums.tolist(), old)]
    return np.array(rows, object if layout.wide else np.int64).reshape(old.shape)


def codebooks_text(books: list[list[np.ndarray]]) -> str:
    """All entries' components by part, entry and position."""
    return ",".join(str(v) for book in books for v in book.ravel().tolist())


def _bounded(total: Column) -> Column:
    return F.least(total, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")


def digest(vectors: DataFrame, **parameters: int) -> DataFrame:
    """vec_id, code in hex, error, label_error and codebooks_sha256."""
    found, books = compressed(vectors, **parameters)
    found = stage(found, "codes")
    totals = found.groupBy("label").agg(_bounded(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"))
    totals = stage(totals, "code-labels").select(F.col("label").alias("of"), "label_error")  # written, so that the planner knows its size
    sha = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    code = F.array_join(F.transform("code", lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
    joined = found.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
