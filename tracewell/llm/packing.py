"""Packing in the order of a space-filling curve: documents that are near each other share sequences.

A document's vector counts its hashed 4-byte strings; it is scaled to unit length, projected to four dimensions by a fixed
random matrix, and its place on the Hilbert curve through the quantised projections is its key (48 bits; 15 bits of a
hash of the row follow, so that copies, which share a place, still spread over tasks).

Keys are computed once and written with the texts. The stretches of the curve that make tasks are then cut by bytes: the
keys alone, without texts, are range-sorted and their sizes added up, which gives the first key of each stretch; there are
as many as the session has shuffle partitions, or one for each STRETCH_BYTES, whatever is more, and their first keys are
what the driver sees. Each task sorts its stretch and cuts it into sequences of SEQUENCE tokens as it streams by: every
sequence but a task's last is full, so padding is under SEQUENCE tokens for each task. Texts are tokenised after the
shuffle, once; ids are never shuffled.

Defined results. Null text is empty: a document of the end id alone. Rows with a null doc_id are packed like others, repeated
rows each on their own. A long text is cut into pieces over as many sequences as it needs; the text is one row of one task.
An empty table gives no rows. Only doc_id and text are read, so that no other column's name can clash. The sequence_id is
the task's number times 2**33 plus the sequence's number in the task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.bpe import default_vocabulary, encode_blocks
from tracewell.llm.common import running_offsets, shuffle_partitions, stage, text_bytes

SEQUENCE, END_ID = 2048, 1
DIMENSIONS, PRECISION, BUCKETS, TIE_BITS = 4, 12, 256, 15
#: of text, for a task, where the session's number of shuffle partitions would give more
STRETCH_BYTES = 256 << 20
_PLANES = np.random.default_rng(42).standard_normal((BUCKETS, DIMENSIONS))


def hilbert_keys(points: np.ndarray, bits: int = PRECISION) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows) with ``bits`` bits in each dimension (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(texts: list[bytes]) -> np.ndarray:
    counts = np.zeros((len(texts), BUCKETS))
    for i, t in enumerate(texts):
        for a in range(0, max(len(t) - 3, 0), 1 << 20):
            part = t[a : a + (1 << 20) + 3]
            grams = np.ndarray((len(part) - 3,), "<u4", part, strides=(1,)) * np.uint32(0x9E3779B1)
            counts[i] += np.bincount((grams >> np.uint32(24)).astype(np.uint8), minlength=BUCKETS)
    counts = np.log1p(counts)
    norm = np.linalg.norm(counts, axis=1, keepdims=True)
    at = (counts / np.where(norm == 0, 1, norm)) @ _PLANES
    return hilbert_keys(np.clip((at / 8 + 0.5) * (1 << PRECISION), 0, (1 << PRECISION) - 1).astype(np.int64))


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_bytes and the place on the curve, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array(curve_keys(texts))], names=["doc_id", "text", "n_bytes", "place"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, n_bytes long, place long")
    tie = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    return rows.withColumn("key", F.shiftleft("place", TIE_BITS).bitwiseOR(tie)).drop("place")


def stretches(keyed: DataFrame, most_bytes: int = STRETCH_BYTES) -> list[int]:
    """The first keys of the stretches but the first: cuts of the curve into ranges of about equal numbers of bytes."""
    sized = keyed.select("key", (F.col("n_bytes") + 64).alias("size"))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(shuffle_partitions(keyed.sparkSession), -(-total // most_bytes))
    each = max(1, -(-total // parts))
    # equal keys are one row here: their ties are hashed, so that none holds more than its share
    by_key = sized.groupBy("key").agg(F.sum("size").alias("size"))
    at = running_offsets(by_key, ["key"], "size", "at", "packing-cuts")
    # one row for each stretch: bounded by total bytes over bytes of a stretch
    return [r.key for r in at.groupBy(F.floor(F.col("at") / each).alias("stretch")).agg(F.min("key").alias("key")).orderBy("key").collect()][1:]


def packed(docs: DataFrame, path: str | None = None, length: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids on request."""
    path = path or default_vocabulary()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, filled = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            for row, n_rows, found, ends in encode_blocks(b.column(1), path):
                doc, start, size, crc, tokens, at, ids = [], [], [], [], [], [], []
                raw, bounds = found.astype("<u4").tobytes(), (4 * ends).tolist()
                for i in range(n_rows):
                    x = raw[bounds[i] : bounds[i + 1]] + end
                    n, done = len(x) // 4, 0
                    while done < n:
                        k = min(n - done, length - filled % length)
                        piece = x[4 * done : 4 * (done + k)]
                        doc.append(row + i)
                        start.append(done)
                        size.append(k)
                        crc.append(zlib.crc32(piece))
                        tokens.append(n)
                        at.append(filled)
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                        done += k
                        filled += k
                where = np.array(at, np.int64)
                columns = [b.column(0).take(pa.array(doc, pa.int64())), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(tokens, pa.int64()), pa.array(base + where // length), pa.array(where % length)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    keyed = stage(with_keys(docs), "packing-keys")
    cuts = stretches(keyed)

    def numbered(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        first = np.array(cuts, np.int64)
        for k in keys:
            yield pd.Series(np.searchsorted(first, k.to_numpy(), side="right").astype(np.int32))

    stretch = F.pandas_udf(numbered, "int")
    rows = keyed.repartitionById(len(cuts) + 1, stretch("key")).sortWithinPartitions("key", "doc_id")
    return rows.select("doc_id", "text").mapInArrow(run, schema)
