"""Merkle fixity audit of WARC replicas: hashes of records and of ordered offset ranges form trees; differing branches are descended.

A leaf of an archive's tree covers the records that start in LEAF_BYTES of it, in the order of their offsets; FANOUT
nodes make one node of the level above, up to one root for each archive. The roots of two replicas are joined first; each
further level is joined only below nodes that differ, and records are compared only in leaves that differ. A node's hash
gathers at most FANOUT hashes, a leaf's the records of LEAF_BYTES, so no group grows with an archive, and all of
it is DataFrame work on digests: the records themselves are read once and never shuffled.

Defined results. A record that only one replica has is ``missing`` (from the second) or ``extra``; one with another digest or length
is ``corrupt``. Null URL or HTML is empty. Rows with a null page_id come first in the order of records; repeated rows
are records of their own. Empty tables give no rows. Columns named archive, offset or status are replaced by the added ones;
others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import running_offsets, stage

ARCHIVE_BYTES, LEAF_BYTES, FANOUT = 1 << 24, 1 << 16, 16


#: pages have no time of their own
DATE = "1970-01-01T00:00:00Z"


def record_id(url: Column, html: Column) -> Column:
    """A record's id, from the MD5 of what it holds."""
    h = F.md5(F.concat(F.coalesce(url, F.lit("")), F.lit("\n"), F.coalesce(html, F.lit(""))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def record(url: Column, html: Column, identity: Column, date: str = DATE) -> Column:
    """A response record as its WARC file holds it."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: "), identity, F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n")
    )
    return F.concat(head, html, F.lit("\r\n\r\n"))


def manifest(records: DataFrame, order: list[str], archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Lay records (with ``length``) out in the given order: adds archive and offset (its place in the archive)."""
    row, at = (next(f"__{name}{i}" for i in range(len(records.columns) + 1) if f"__{name}{i}" not in records.columns) for name in ("row", "at"))
    placed = running_offsets(records.drop("archive", "offset").withColumn(row, F.monotonically_increasing_id()), [*order, row], "length", at, "fixity-offsets")
    return placed.withColumn("archive", F.floor(F.col(at) / archive_bytes)).withColumn("offset", F.pmod(at, F.lit(archive_bytes))).drop(at, row)


def levels(archive_bytes: int = ARCHIVE_BYTES, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> int:
    """Levels above the leaves."""
    n, up = -(-archive_bytes // leaf_bytes), 0
    while n > 1:
        n, up = -(-n // fanout), up + 1
    return up


def tree(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """(archive, node, hash) for each level, leaves first."""

    def hashed(df: DataFrame, node: Column, *parts: str) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*parts))), lambda x: F.concat_ws(":", *(x[p].cast("string") for p in parts))), ",")
        return df.groupBy("archive", node.alias("node")).agg(F.sha2(joined, 256).alias("hash"))

    out = [hashed(records, F.floor(F.col("offset") / leaf_bytes), "offset", "length", "digest")]
    for _ in range(levels(archive_bytes, leaf_bytes, fanout)):
        out.append(hashed(out[-1], F.floor(F.col("node") / fanout), "node", "hash"))
    return out


def differing_records(a: DataFrame, b: DataFrame, archive_bytes: int = ARCHIVE_BYTES, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(archive, offset, status) of every record on which two replicas (archive, offset, length, digest) differ."""
    trees = [[stage(x, "fixity-level") for x in tree(r, archive_bytes, leaf_bytes, fanout)] for r in (a, b)]
    suspects = None
    for x, y in zip(*(t[::-1] for t in trees)):
        if suspects is not None:
            above = suspects.withColumnRenamed("node", "parent")
            x, y = (t.withColumn("parent", F.floor(F.col("node") / fanout)).join(above, ["archive", "parent"], "left_semi").drop("parent") for t in (x, y))
        both = x.withColumnRenamed("hash", "x").join(y.withColumnRenamed("hash", "y"), ["archive", "node"], "full_outer")
        suspects = stage(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("archive", "node"), "fixity-suspects")
    leaf = suspects.withColumnRenamed("node", "leaf")
    # several records may start at one offset only if they are empty; their digests are compared in order
    x, y = (
        r.withColumn("leaf", F.floor(F.col("offset") / leaf_bytes)).join(leaf, ["archive", "leaf"], "left_semi").groupBy("archive", "offset").agg(F.array_sort(F.collect_list(F.struct("length", "digest"))).alias(n))
        for r, n in ((a, "x"), (b, "y"))
    )
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("corrupt")
    return x.join(y, ["archive", "offset"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("archive", "offset", status.alias("status"))


def audited(a: DataFrame, b: DataFrame, **sizes: int) -> DataFrame:
    """The records of replica ``a`` with a status, ``ok`` where ``b`` agrees, and rows of ``b`` that ``a`` lacks."""
    a, b = a.drop("status"), b.drop("status")
    wrong = stage(differing_records(a, b, **sizes), "fixity-wrong")
    own = a.join(wrong.where("status <> 'extra'"), ["archive", "offset"], "left").withColumn("status", F.coalesce("status", F.lit("ok")))
    extra = b.join(wrong.where("status = 'extra'"), ["archive", "offset"])
    return own.unionByName(extra, allowMissingColumns=True)


# The registered query audits the pages' archive against a replica in which some records were altered and some lost.
CORRUPT, LOST = (41, 7), (53, 11)


def replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    html = F.coalesce("html", F.lit(""))
    altered = F.coalesce(F.col("page_id") % CORRUPT[0] == CORRUPT[1], F.lit(False))
    lost = F.coalesce(F.col("page_id") % LOST[0] == LOST[1], F.lit(False))
    copy = F.when(altered, F.concat(F.lit("~"), F.substring(html, 2, F.length(html)))).otherwise(html)
    own = pages.select("page_id", "url", "html", record_id(F.col("url"), html).alias("identity"))
    both = own.select("page_id", record(F.col("url"), html, F.col("identity")).alias("x"), record(F.col("url"), copy, F.col("identity")).alias("y"), lost.alias("lost"))
    digests = both.select("page_id", F.octet_length("x").cast("long").alias("length"), F.sha2("x", 256).alias("digest"), F.octet_length("y").cast("long").alias("copy_length"), F.sha2("y", 256).alias("copy_digest"), "lost")
    placed = stage(manifest(digests, ["page_id", "digest"]), "fixity-manifest")
    first = placed.select("page_id", "archive", "offset", "length", "digest")
    return first, placed.where("not lost").select("page_id", "archive", "offset", F.col("copy_length").alias("length"), F.col("copy_digest").alias("digest"))


def audit_of_pages(pages: DataFrame) -> DataFrame:
    return audited(*replicas(pages)).select("page_id", "archive", "offset", "length", "digest", "status")


ORACLE = f"""
WITH i AS (SELECT *, md5(concat(coalesce(url, ''), chr(10), coalesce(html, ''))) AS m FROM pages),
r AS (SELECT page_id, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:uuid:', substr(m, 1, 8), '-', substr(m, 9, 4), '-', substr(m, 13, 4), '-',
    substr(m, 17, 4), '-', substr(m, 21, 12), '>', chr(13), chr(10), 'WARC-Date: {DATE}', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10),
    'Content-Length: ', CAST(strlen(coalesce(html, '')) AS VARCHAR), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS x FROM i),
d AS (SELECT page_id, CAST(strlen(x) AS BIGINT) AS length, sha256(x) AS digest FROM r),
o AS (SELECT *, CAST(sum(length) OVER (ORDER BY page_id NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length AS BIGINT) AS a FROM d)
SELECT page_id, a // {ARCHIVE_BYTES} AS archive, a % {ARCHIVE_BYTES} AS "offset", length, digest,
  CASE WHEN page_id % {LOST[0]} = {LOST[1]} THEN 'missing' WHEN page_id % {CORRUPT[0]} = {CORRUPT[1]} THEN 'corrupt' ELSE 'ok' END AS status FROM o
"""
