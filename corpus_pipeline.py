"""The corpus pipeline: five operators in a row, each on all that the one before it kept.

Each stage's rows are written as Parquet in the shared folder and read again as the next one's documents. All but the last
stage return the columns of ``documents``; the last returns the pieces of packed sequences. Null and empty texts, rows without
doc_id, repeated rows and empty tables pass through as each operator's docstring says; extra columns pass through whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import packing, pii, quality_gam, simhash, substring_dedup
from tracewell.llm.common import stage, table


def _applied(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], resized: bool = False) -> DataFrame:
    """An operator's rows with the columns of ``docs``, whatever names the operator adds; n_chars is counted again if texts change.

    The columns beside doc_id and text travel as one struct, so that none of their names can meet one of the operator's.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", *([F.struct(*(F.col(f"`{c}`") for c in others)).alias("__others")] if others else []))
    done = operator(packed).select("doc_id", "text", *(F.col("__others").getField(c).alias(c) for c in others))
    if resized and "n_chars" in others:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*(F.col(f"`{c}`") for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model doesn't reject."""
    return _applied(docs, lambda d: quality_gam.kept(d, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id has."""
    return _applied(docs, substring_dedup.deduplicated, resized=True)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data, under the key that the session has in KEY_CONF."""
    key = spark.conf.get(KEY_CONF, None)
    return _applied(docs, lambda d: pii.with_pseudonyms(d, key.encode() if key else pii.DEFAULT_KEY), resized=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.packed(docs)


#: the pseudonyms' secret key; without it they can be inverted by anyone, and serve for tests only
KEY_CONF = "spark.tracewell.pseudonymKey"
STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages), ("PII", pseudonyms), ("packing", pack)]
#: learned scores, suffix arrays and BPE can't be stated in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{k}")
    return docs
