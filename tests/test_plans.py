from concurrent.futures import ThreadPoolExecutor

import parity
import pytest

import __spark_entry__
from tracewell import queries
from tracewell.plans import etl, text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def compared(spark):
    """What differs between each query and its SQL; a few run at a time, since most are small jobs."""
    with ThreadPoolExecutor(5) as pool:
        running = {n: pool.submit(parity.compare, spark, SF, queries.QUERIES[n], sql) for n, sql in queries.ORACLE_SQL.items()}
    return running


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_its_sql(compared, name):
    # a small table may leave a query without rows; what there is must agree
    assert compared[name].result() in ("", "no rows")


def test_engine_parts():
    assert text.for_engine("a /*spark b*/ /*duck c*/", "duck").split() == ["a", "c"]
    assert text.counted_as_long("SELECT count_if(a AND (b OR c)) AS n") == "SELECT count(*) FILTER (WHERE a AND (b OR c)) AS n"
    assert text.with_tables("SELECT * FROM y", {"x": "SELECT 1", "y": "SELECT * FROM x", "z": "SELECT 2"}).startswith("WITH x AS /*duck MATERIALIZED*/ (SELECT 1),\ny AS")


def test_scoring_reads_no_labels(spark):
    for name in ("resolve_group_threshold", "label_free_projection", "compact_event_index", "host_state_fold"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString()
        assert "label" not in plan and "gt_nodes" not in plan


def test_every_sql_belongs_to_a_query_and_entry_runs(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["host", "node_id", "first_alert", "last_alert", "n_src", "n_dst", "max_score"]
    assert etl.TEXTS
