"""URL filter: a blocked Bloom filter of the listed canonical URLs lets possible hits through to an exact hash join.

A listed URL is a host and a path prefix. A page's candidate keys are its host and parent domains, each with the path prefixes
of the lengths that occur in the list. Each key sets or tests eight bits of one 512-bit block. The filter is built by
grouped ``bit_or`` and has FILTER_BITS bits at most, however long the list: past that, more keys pass and the join, which
alone decides, removes them. Pages none of whose keys pass are done: they meet neither join nor grouping, and only the
others are shuffled. Parents longer than the longest listed host can't be listed and are not built, so that a long host costs no
more than its last part.

Defined results. Null URLs and URLs without ``://`` have an empty host and path and no rule. Of several rules that fit, the
longest wins (then the longer host). Of equal listed URLs with different verdicts, ``block`` wins. Repeated pages stay
repeated. Pages without a rule get the default verdict. An empty table gives no rows; an empty list gives all pages the
default. Only page_id and the URL are read, so that no other column's name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import stage

BITS_PER_KEY, FILTER_BITS, BLOCK_BITS = 16, 1 << 27, 512
#: rules up to this number are sent to all tasks for the join; it is checked by counting
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)

#: the list of the registered query: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def listed(rules: DataFrame) -> DataFrame:
    """key, rule, verdict, size: one row for each listed URL."""
    key = F.concat(F.translate("host", _UPPER, _LOWER), "path")
    named = rules.where("host <> '' and path is not null").select(key.alias("key"), F.length("path").alias("path_length"), F.length("host").alias("host_length"), F.when(F.lower("verdict") == "block", "block").otherwise("allow").alias("verdict"))
    return named.groupBy("key", "path_length", "host_length").agg(F.max("verdict").alias("verdict"))


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Eight bit places (0 to 63), one for each word of a key's block."""
    low = hashes.view(np.uint64) & np.uint64(0xFFFFFFFF)
    return ((low[:, None] * np.array(_SALTS, np.uint64)) & np.uint64(0xFFFFFFFF)) >> np.uint64(26)


def build_filter(rules: DataFrame) -> np.ndarray:
    """The filter's blocks, as rows of eight 64-bit words."""
    n = rules.count()
    blocks = 1 << max(0, (min(max(n, 1) * BITS_PER_KEY, FILTER_BITS) // BLOCK_BITS).bit_length())
    blocks = min(blocks, FILTER_BITS // BLOCK_BITS)
    h = F.xxhash64("key")
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    words = []
    grouped = rules.select(F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(blocks - 1)).alias("block"), low.alias("low"))
    for i, salt in enumerate(_SALTS):
        # only the low 32 bits of the product count
        place = F.shiftrightunsigned((F.col("low").cast("decimal(20,0)") * F.lit(salt).cast("decimal(20,0)") % F.lit(1 << 32).cast("decimal(20,0)")).cast("long"), 26).cast("int")
        words.append(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias(f"w{i}"))
    out = np.zeros((blocks, 8), np.int64)
    for r in grouped.groupBy("block").agg(*words).collect():  # at most FILTER_BITS / BLOCK_BITS rows
        out[r["block"]] = r[1:]
    return out.view(np.uint64)


def passes(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    block = (hashes.view(np.uint64) >> np.uint64(32)) & np.uint64(len(filter_) - 1)
    want = np.uint64(1) << _bits(hashes)
    return ((filter_[block.astype(np.int64)] & want) == want).all(axis=1)


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """page_id, host, path, rule (null without), verdict for every row of ``pages``."""
    spark = pages.sparkSession
    rules = stage(listed(rules), "url-rules")
    lengths = sorted(r[0] for r in rules.select("path_length").distinct().collect())  # lengths of URL paths
    longest = rules.agg(F.coalesce(F.max("host_length"), F.lit(0))).first()[0]
    shared = spark.sparkContext.broadcast(build_filter(rules))
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.monotonically_increasing_id().alias("__row"), "page_id", host.alias("host"), path.alias("path"))
    # of a host that is longer than any listed one, the last part, without the label that is cut
    over = F.length("host") > longest
    labels = F.split(F.when(over, F.substring("host", -(longest + 1), longest + 1)).otherwise(F.col("host")), r"\.")
    labels = F.when(over, F.slice(labels, 2, F.size(labels))).otherwise(labels)
    parents = F.transform(F.when(F.size(labels) > 0, F.sequence(F.lit(1), F.size(labels))).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)), lambda x: x.isNotNull())
    keys = F.when((F.col("host") != "") & (F.size(prefixes) > 0), F.flatten(F.transform(parents, lambda p: F.transform(prefixes, lambda x: F.concat(p, x)))))
    keyed = rows.withColumn("keys", F.coalesce(keys, F.array().cast("array<string>"))).withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = shared.value
        for b in batches:
            keys, hashes = b.column(4), b.column(5)
            ok = passes(filter_, hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            ends = np.concatenate(([0], np.cumsum(ok)))[np.concatenate(([0], np.cumsum(np.array([len(x) for x in hashes]))))].astype(np.int32)
            hits = pa.ListArray.from_arrays(pa.array(ends), keys.flatten().filter(pa.array(ok)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), hits], names=["__row", "page_id", "host", "path", "hits"])

    page_type = pages.schema["page_id"].dataType.simpleString()
    tested = stage(keyed.mapInArrow(run, f"__row long, page_id {page_type}, host string, path string, hits array<string>"), "url-tested")
    hit = tested.where(F.size("hits") > 0).select("__row", F.struct("page_id", "host", "path").alias("page"), F.explode("hits").alias("key"))
    known = rules.select("key", F.struct(F.length("key").alias("n"), "host_length", F.col("key").alias("rule"), "verdict").alias("fit"))
    known = F.broadcast(known) if rules.count() <= BROADCAST_RULES else known
    best = hit.join(known, "key", "left").groupBy("__row").agg(F.first("page").alias("page"), F.max("fit").alias("fit"))
    found = best.select("page.page_id", "page.host", "page.path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))
    return found.unionByName(tested.where(F.size("hits") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))


ORACLE = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT page_id, host, path, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
