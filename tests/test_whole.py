"""On small tables: each row counts, whatever its key."""

import re

import duckdb
import pytest

from flowloom.plans import catalog


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    many = "FROM range(24) r(i)) TO"
    made = {
        "lineitem": "SELECT 1 + i * 397 AS l_orderkey, 1 + i % 5 AS l_partkey, 1 + i % 9 AS l_suppkey, (1 + i % 3)::INT AS l_linenumber, CASE WHEN i % 4 = 0 THEN 50.0 ELSE 10.0 + i * 2 END AS l_quantity, ['N', 'A', 'R'][1 + i % 3] AS l_returnflag",
        "part": "SELECT 1 + i * 80 AS p_partkey, 'p' || i AS p_name",
        "orders": "SELECT 1 + i * 397 AS o_orderkey, CASE WHEN i = 1 THEN 50 ELSE 1 + i % 20 END AS o_custkey, ['1-URGENT', '5-LOW', '5-LOW'][1 + i % 3] AS o_orderpriority, ['P', 'O'][1 + i % 2] AS o_orderstatus",
        "customer": "SELECT CASE WHEN i = 20 THEN 50 ELSE 1 + i END AS c_custkey, 3 AS c_nationkey, 'X' AS c_mktsegment",
        "supplier": "SELECT 1 + i AS s_suppkey, 3 AS s_nationkey",
        "documents": "SELECT i AS doc_id, 'a' || chr(10) || 'b' || i || chr(10) || 'c' AS text",
    }
    for name, sql in made.items():
        duckdb.sql(f"COPY ({sql} {many} '{d}/{name}.parquet' (FORMAT parquet)")
    return d


def rows(spark, d, name, sql=None):
    """The query's rows, which must be those of its SQL."""
    c = duckdb.connect()
    for t in set(re.findall(r"\b(lineitem|part|documents|orders|customer|supplier)\b", catalog.ORACLE[name])):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = sorted(map(repr, c.sql(catalog.ORACLE[name]).fetchall()))
    got = [tuple(r) for r in catalog.QUERIES[name](spark, d).collect()]
    assert sorted(map(repr, got)) == want
    return got


@pytest.mark.parametrize("name, least", [("find_edges_by_type", 8), ("edge_content_dedupe", 24), ("alias_merge", 1), ("line_window", 48)])
def test_no_key_is_left_out(spark, tables, name, least):
    assert len(rows(spark, tables, name)) >= least


#: The classes that occur in the small tables.
CLASSES = {"flow_completeness": {"function-only", "caller-only", "endpoint-only", "complete"}, "stitch_report_partition": {"stitched", "external", "dynamic", "unresolved"}}
FLOWS = [*CLASSES, *"flow_db_hops impact_by_table impact_by_endpoint diff_flows screen_impact unmatched_callers uncalled_endpoints orphan_tables".split()]


@pytest.mark.parametrize("name", FLOWS)
def test_every_order_counts(spark, tables, name):
    found = rows(spark, tables, name)
    assert found and {r[0] for r in found} == CLASSES.get(name, {r[0] for r in found})


def test_nested_flows_of_every_order(spark, tables):
    found = catalog.QUERIES["nested_flow_struct"](spark, tables).collect()
    assert {x.split(":")[0] for r in found for x in r["flows"].split(" ")} - {"-"} == {str(1 + i * 397) for i in range(24)}
