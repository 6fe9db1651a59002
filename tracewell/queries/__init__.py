"""Registered queries of the audit engine and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.plans import etl, evaluation, profiles, semantics
from tracewell.plans.text import registered
from tracewell.queries import core, files, learned, stateful
from tracewell.sources.mapping import BASE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_COMMON = BASE | etl.COMMON | evaluation.COMMON | profiles.COMMON | semantics.COMMON
for _plans in (etl, evaluation, profiles, semantics, files):
    _queries, _checks = registered(_plans.TEXTS, _COMMON)
    QUERIES |= _queries
    ORACLE_SQL |= _checks

# operators; the text stays as the check
QUERIES |= core.QUERIES | stateful.QUERIES | learned.QUERIES | files.QUERIES
# these work on learned losses and on clusters of states, which have no SQL
for _name in ("state_compression_summary", "alert_merge_analysis", "case_loss_summary", "run_comparison"):
    ORACLE_SQL.pop(_name, None)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which alerts exceed their group's threshold, and which nodes do they cover?"""
    return QUERIES["node_coverage"](spark, sf_dir)
