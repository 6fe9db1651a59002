"""Compare a Spark query's rows with those of its SQL in DuckDB, whatever their order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.6g}" if abs(x) < 1e15 else f"{x:.6g}"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, int):
        return f"{float(x):.6g}" if abs(x) < 100000 else str(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if the rows agree, else what differs."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    theirs = rows_of(names, got.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if mine != theirs:
        odd = [x for x in mine if x not in set(theirs)][:2], [x for x in theirs if x not in set(mine)][:2]
        return f"{len(mine)} and {len(theirs)} rows; {odd}"
    return "" if mine else "no rows"
