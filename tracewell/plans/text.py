"""Query texts shared by two SQL engines, and the common tables they are built from.

A text is plain SQL. Where the engines differ, ``/*spark ... */`` and ``/*duck ... */`` hold the part of one of them. A text
gets, in front, those common tables that it or they themselves name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.sources.mapping import BASE

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def for_engine(sql: str, engine: str) -> str:
    other = {"spark": "duck", "duck": "spark"}[engine]
    return re.sub(rf"/\*{engine}(.*?)\*/", r"\1", re.sub(rf"/\*{other}.*?\*/", "", sql, flags=re.S), flags=re.S)


def counted_as_long(sql: str) -> str:
    """``count_if(x)`` as ``count(*) FILTER (WHERE x)``, which is a 64-bit number in every engine."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + len('count_if(') : end - 1]}){sql[end:]}"
    return sql


def with_tables(sql: str, common: dict[str, str]) -> str:
    """``sql`` with the common tables it needs, in their given order, as one WITH clause."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in common.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(body)
    found = [f"{name} AS /*duck MATERIALIZED*/ ({body})" for name, body in common.items() if name in needed]
    if not found:
        return sql
    head = "WITH " + ",\n".join(found)
    return f"{head},\n{sql.lstrip()[4:]}" if re.match(r"\s*WITH\b", sql) else f"{head}\n{sql}"


def used_tables(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql, flags=re.I)]


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for t in used_tables(sql):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def registered(texts: dict[str, str], common: dict[str, str] = BASE) -> tuple[dict[str, Callable], dict[str, str]]:
    """Queries and check SQL of a set of texts."""
    queries, checks = {}, {}
    for name, text in texts.items():
        whole = with_tables(text, common)
        queries[name] = lambda spark, sf_dir, sql=for_engine(whole, "spark"): run(spark, sf_dir, sql)
        checks[name] = counted_as_long(for_engine(whole, "duck"))
    return queries, checks
