"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import bpe, filter_audit, fixity, hash_index, license_index, packing, pii, product_codes, quality_gam, simhash, substring_dedup, url_rules, weak_rules
from tracewell.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages").select("page_id", "url"), url_rules.rule_table(spark))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audit_of_pages(table(spark, sf_dir, "pages"))


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_index.search(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_weak_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.digest(weak_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.digest(license_index.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes.digest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_warc_fixity": op3_warc_fixity,
    "op4_multi_index_hashing": op4_multi_index_hashing,
    "op5_packing": op5_packing,
    "op6_quality_gam": op6_quality_gam,
    "op7_pii_pseudonyms": op7_pii_pseudonyms,
    "op8_weak_quality_rules": op8_weak_quality_rules,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_license_scan": op11_license_scan,
    "op12_product_codes": op12_product_codes,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {"op1_url_filter": url_rules.ORACLE, "op3_warc_fixity": fixity.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
