"""Filter interaction audit: what each of five filters removes in each of the 120 orders in which they may run.

Sparse document-term matrix. Texts are counted in blocks of BLOCK_BYTES: words become rows and columns of a block's own CSR
matrix, whose columns are the block's distinct words in the order of a hash. These are sent, one packed row for each block and
range of hashes, to where a range's words are numbered for all documents (its number and the order of first appearance by
block make a word's id), and the ids go back to their blocks: one CSR shard for each block, all under one dictionary. A word
is sent once by each block that has it, however often it stands there. A row's sum is its document's number of words (filter
A), its count of nonzero columns the number of distinct ones (filter B).

The other flags (C, D and a digest for E) are taken while a text is at hand and ride in the shard's rows. A copy is a
document whose (doc_id, digest) isn't that of the smallest doc_id with the digest: a join by doc_id, on which no group of
copies meets. Documents are then counted by part, the set of filters they fail, quality and toxicity; the orders are worked
out from those counts, at most 128 for each part.

Words are maximal runs of bytes other than space and TAB to CR. Texts longer than SLICE_BYTES are counted piece by piece, so
that only their distinct words are held.

Defined results. A null text is empty: it fails A, not B (0 of 0 words), and is equal to any empty text. A null lang is the
part ''. A null doc_id is neither smaller nor larger than another: its row never fails E, and has no labels. Rows that
repeat a doc_id count each; they fail E only if a smaller doc_id has their text. Of several labels for one doc_id, the
largest count; null labels are 0. An empty table gives no rows. Only doc_id, text, lang and doc_id, quality, toxic are read,
so that no other column's name can clash.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import shuffle_partitions, sized_blocks, stage, staged_at, text_bytes

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 3
BLOCK_BYTES, SLICE_BYTES = 2 << 20, 1 << 20
RANGE_WORDS = 2_000_000
# Bytes that end a word, upper case, symbols, and bytes that continue a code point.
SPACES = bytes([*range(9, 14), 32])
UPPER = bytes(range(65, 91))
SYMBOLS = b"#$%&*|"
CONTINUATION = bytes(range(0x80, 0xC0))

_IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))
_SPACE = re.compile(rb"[\x09-\x0D\x20]")
_ROW = "doc_id long, part string, c boolean, d boolean, digest binary"
_ROW_TYPE = pa.struct([("doc_id", pa.int64()), ("part", pa.string()), ("c", pa.bool_()), ("d", pa.bool_()), ("digest", pa.binary())])


def pieces(text: bytes, most: int) -> Iterator[bytes]:
    """A text cut at spaces into pieces of about ``most`` bytes."""
    start = 0
    while len(text) - start > most:
        cut = _SPACE.search(text, start + most)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:] if start else text


def _slice_counts(rows: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, column, count) of nonzero cells and the columns' words, of pieces that belong to ``rows``."""
    buf = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    inside = ~_IS_SPACE[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf[inside])])
    coded = words.dictionary_encode()
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    n = np.diff(np.searchsorted(starts, bounds))
    key = np.repeat(rows, n) * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
    key, count = np.unique(key, return_counts=True)
    row, column = np.divmod(key, max(1, len(coded.dictionary)))
    return row, column, count, coded.dictionary


def block_matrix(texts: list[bytes], slice_bytes: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """CSR (indptr, columns, counts) of a block of texts, and its columns' words."""
    cut = [(i, p) for i, t in enumerate(texts) for p in pieces(t, slice_bytes)]
    found = []
    for a, b in sized_blocks([len(p) for _, p in cut], slice_bytes):
        found.append(_slice_counts(np.array([i for i, _ in cut[a:b]], np.int64), [p for _, p in cut[a:b]]))
    if len(found) == 1:
        row, column, count, words = found[0]
    else:
        words = pa.concat_arrays([f[3] for f in found]).dictionary_encode()
        first = np.cumsum([0, *(len(f[3]) for f in found)])
        renamed = words.indices.to_numpy().astype(np.int64)
        words, width = words.dictionary, max(1, len(words.dictionary))
        key = np.concatenate([f[0] * width + renamed[first[k] + f[1]] for k, f in enumerate(found)])
        key, at = np.unique(key, return_inverse=True)
        count = np.bincount(at, np.concatenate([f[2] for f in found]), len(key)).astype(np.int64)
        row, column = np.divmod(key, width)
    return np.searchsorted(row, np.arange(len(texts) + 1)), column, count, words


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([a.tobytes()], pa.binary()) for a in arrays]


def _by_hash(words: pa.Array) -> tuple[np.ndarray, bytes, np.ndarray]:
    """The words' order by hash, and in that order their bytes and lengths."""
    plain = words.to_pylist()
    order = np.argsort(np.array([crc32(w) for w in plain], np.uint32), kind="stable")
    ordered = [plain[i] for i in order.tolist()]
    return order, b"".join(ordered), np.array([len(w) for w in ordered], np.int32)


def _blocks(block_bytes: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for a, b in sized_blocks([len(t) for t in texts], block_bytes):
                block = texts[a:b]
                indptr, columns, counts, words = block_matrix(block, slice_bytes)
                order, plain, lengths = _by_hash(words)
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order), dtype=np.int32)
                upper = [len(t) - len(t.translate(None, UPPER)) for t in block]
                points = [len(t.translate(None, CONTINUATION)) for t in block]
                rows = pa.StructArray.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array([100 * u > UPPER_PERCENT * n for u, n in zip(upper, points)], pa.bool_()),
                        pa.array([len(t.translate(None, SYMBOLS)) < len(t) for t in block], pa.bool_()),
                        pa.array([hashlib.sha256(t).digest() for t in block], pa.binary()),
                    ],
                    fields=list(_ROW_TYPE),
                )
                matrix = _packed(indptr.astype("<i8"), place[columns], counts.astype("<i4"))
                names = ["shard", "rows", "indptr", "columns", "counts", "words", "lengths"]
                yield pa.RecordBatch.from_arrays([pa.array([shard]), _list(rows), *matrix, pa.array([plain], pa.binary()), *_packed(lengths)], names=names)
                shard += 1
            pa.default_memory_pool().release_unused()

    return run


def _sent(ranges: int):
    """The words of each block, a packed row for each range of hashes that it has words of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, words, lengths in zip(*(b.column(i).to_pylist() for i in range(3))):
                ends = np.concatenate(([0], np.cumsum(np.frombuffer(lengths, "<i4"), dtype=np.int64)))
                at = ends.tolist()
                hashed = np.array([crc32(words[i:j]) for i, j in zip(at, at[1:])], np.uint64)
                range_ = ((hashed * np.uint64(ranges)) >> np.uint64(32)).astype(np.int32)
                cuts = np.flatnonzero(np.diff(range_, prepend=-1))
                after = np.append(cuts[1:], len(range_))
                columns = [
                    pa.array(range_[cuts], pa.int32()),
                    pa.array([shard] * len(cuts), pa.int64()),
                    pa.array(cuts, pa.int32()),
                    pa.array([words[at[i] : at[j]] for i, j in zip(cuts.tolist(), after.tolist())], pa.binary()),
                    pa.array([lengths[4 * i : 4 * j] for i, j in zip(cuts.tolist(), after.tolist())], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "of", "first", "words", "lengths"])

    return run


def _coded(sent: pa.Table) -> tuple[pa.Table, pa.DictionaryArray, np.ndarray]:
    """A range's rows in the order of blocks, its words' codes in the order of first appearance, and where each row ends."""
    sent = sent.sort_by("of")
    lengths = np.frombuffer(b"".join(sent["lengths"].to_pylist()), "<i4")
    ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(sent["words"].to_pylist()))])
    return sent, words.dictionary_encode(), np.cumsum(pc.binary_length(sent["lengths"]).to_numpy() // 4)


def _numbered(sent: pa.Table) -> pa.Table:
    sent, coded, ends = _coded(sent)
    base = sent["range"][0].as_py() << 32
    ids = np.split(coded.indices.to_numpy().astype("<i8") + base, ends[:-1])
    return pa.table({"of": sent["of"], "first": sent["first"], "ids": pa.array([i.tobytes() for i in ids], pa.binary())})


def _dictionary(sent: pa.Table) -> pa.Table:
    _, coded, _ = _coded(sent)
    base = sent["range"][0].as_py() << 32
    return pa.table({"word": coded.dictionary.cast(pa.large_string()).cast(pa.string()), "id": pa.array(np.arange(len(coded.dictionary), dtype=np.int64) + base)})


def _renumbered(shards: pa.Table, numbers: pa.Table) -> pa.Table:
    """A shard with the columns' ids in the whole dictionary, each row's in ascending order."""
    parts = [np.frombuffer(x, "<i8") for x in numbers["ids"].to_pylist()]
    number = np.zeros(sum(map(len, parts)), np.int64)
    for first, ids in zip(numbers["first"].to_pylist(), parts):
        number[first : first + len(ids)] = ids
    indptr, own, n = (np.frombuffer(shards[c][0].as_py(), kind) for c, kind in (("indptr", "<i8"), ("columns", "<i4"), ("counts", "<i4")))
    found = number[own]
    order = np.lexsort((found, np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))))
    ids, counts = _packed(found[order], n[order])
    return pa.table({"shard": shards["shard"], "rows": shards["rows"], "indptr": shards["indptr"], "ids": ids, "counts": counts})


def document_terms(
    docs: DataFrame, block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE_BYTES, range_words: int = RANGE_WORDS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The document-term matrix of doc_id, text and lang.

    Gives the dictionary (word, id), the CSR shards (shard, rows, indptr, ids, counts: the last three packed as little-endian
    64-, 64- and 32-bit numbers) with ``rows`` telling each row's doc_id, part, flags c and d and digest, and these rows by themselves.
    """
    spark = docs.sparkSession
    part = F.coalesce("lang", F.lit("")).alias("part")
    row = f"shard long, rows array<struct<{_ROW.replace(' ', ':').replace(',:', ',')}>>, indptr binary"
    ddl = f"{row}, columns binary, counts binary, words binary, lengths binary"
    counted = docs.select(F.col("doc_id").cast("long"), part, "text").mapInArrow(_blocks(block_bytes, slice_bytes), ddl)
    counted, _ = staged_at(counted, "term-blocks", compression="zstd")
    n_words = counted.agg(F.sum(F.length("lengths"))).first()[0] or 0
    ranges = max(shuffle_partitions(spark), n_words // 4 // range_words)
    sent = counted.select("shard", "words", "lengths").mapInArrow(_sent(ranges), "range int, of long, first int, words binary, lengths binary")
    dictionary = sent.groupBy("range").applyInArrow(_dictionary, "word string, id long")
    numbers = sent.groupBy("range").applyInArrow(_numbered, "of long, first int, ids binary")
    own = counted.select("shard", "rows", "indptr", "columns", "counts")
    shards = own.groupBy("shard").cogroup(numbers.groupBy("of")).applyInArrow(_renumbered, f"{row}, ids binary, counts binary")
    return dictionary, shards, counted.select(F.explode("rows").alias("r")).select("r.*")


def _row_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and nonzero columns of the shards' rows, a row for each document."""
    for b in batches:
        for k in range(b.num_rows):
            rows = b.column(1)[k].values
            indptr, counts = np.frombuffer(b.column(2)[k].as_py(), "<i8"), np.frombuffer(b.column(4)[k].as_py(), "<i4")
            before = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
            totals = [pa.array(np.diff(before[indptr])), pa.array(np.diff(indptr))]
            yield pa.RecordBatch.from_arrays([*rows.flatten(), *totals], names=[*(f.name for f in _ROW_TYPE), "n_words", "n_distinct"])


def failed(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, part, n_words, n_distinct and the boolean flags A to E: which filters each document fails."""
    _, shards, rows = document_terms(docs, **sizes)
    totals = shards.mapInArrow(_row_totals, f"{_ROW}, n_words long, n_distinct long")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest", F.lit(True).alias("first"))
    flags = totals.join(first, ["doc_id", "digest"], "left")
    return flags.select(
        "doc_id",
        "part",
        "n_words",
        "n_distinct",
        (F.col("n_words") < MIN_WORDS).alias("A"),
        (100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words")).alias("B"),
        F.col("c").alias("C"),
        F.col("d").alias("D"),
        (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias("E"),
    )


def audit(docs: DataFrame, labels: DataFrame, **sizes: int) -> DataFrame:
    """part, filter_order, step and the counts of each part, order and step."""
    marks = {c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c) for c in ("quality", "toxic")}
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*marks.values())
    mask = sum(F.col(f).cast("int") * (1 << i) for i, f in enumerate(FILTERS))
    rows = failed(docs, **sizes).join(known, "doc_id", "left")
    good, toxic = (F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic"))
    counts = stage(rows.groupBy("part", mask.alias("mask"), good, toxic).agg(F.count("*").alias("n")), "filter-counts")
    steps = [
        {"filter_order": order, "step": k + 1, "before": sum(1 << FILTERS.index(f) for f in order[:k]), "own": 1 << FILTERS.index(order[k])}
        for order in map("".join, itertools.permutations(FILTERS))
        for k in range(len(FILTERS))
    ]
    # a fixed list of 600 entries, whatever the input; each meets at most 128 counts of a part
    entries = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,own:int>>")
    each = counts.select("*", F.explode(entries).alias("s")).select("*", "s.*").drop("s")
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    orders = len(steps) // len(FILTERS)

    def total(condition, weight=F.lit(1)):
        return F.coalesce(F.sum(F.when(condition, F.col("n") * weight)), F.lit(0)).cast("long")

    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & ~earlier & F.col("quality")).alias("good_lost"),
        total(fails & ~earlier & F.col("toxic")).alias("toxic_lost"),
        # each of the filters that a document fails comes first in as many orders
        total(fails, (F.lit(orders) / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long")).alias("shapley"),
    )


#: the same by counting words and walking the orders in SQL
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM d LEFT JOIN l USING (doc_id)),
counts AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM letters a, letters b, letters c, letters e, letters g
  WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
steps AS (SELECT filter_order, s AS step, substr(filter_order, s, 1) AS own, left(filter_order, s - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS s)),
each AS (
  SELECT *, contains(fails, own) AS now, len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND fails <> '' AND before <> '' AS earlier
  FROM counts, steps),
found AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT now AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN now AND NOT earlier THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN now AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN now AND NOT earlier AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN now AND NOT earlier AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM each GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM found
"""
