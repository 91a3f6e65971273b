"""Each query with SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from edgewise.operators.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["check_exclusion_batch", "check_hierarchy_batch", "list_resources_user", "changelog_replay", "resolve_recursive", "simulate_overlay", "trace_node_counts", "check_errors_batch", "check_module_batch", "evaluations_items", "invalid_tuples", "page_relationships", "store_steps", "watch_stream", "streaming_evaluate", "tenant_dimensions", "asof_per_request", "streaming_delete", "audit_windows"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(df.select(columns).collect()) == text(want)
