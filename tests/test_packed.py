"""Lists packed as bytes; queries whose joins would be as large as rows times rows."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_whole import rows

from flowloom.operators import packed

ENDS = (-(1 << 63), (1 << 63) - 1)


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Two suppliers with 400 large lines each, of as many orders and parts; one line has no part, four customers no order."""
    d = str(tmp_path_factory.mktemp("many"))
    made = {
        "lineitem": "SELECT i AS l_orderkey, CASE WHEN i <> 7 THEN 1 + i * 31 % 600 END AS l_partkey, 1 + i % 2 AS l_suppkey, 1 AS l_linenumber, 45.0 AS l_quantity, 'N' AS l_returnflag",
        "orders": "SELECT i AS o_orderkey, i * 7 % 90 AS o_custkey, '5-LOW' AS o_orderpriority, 'O' AS o_orderstatus",
        "customer": "SELECT i AS c_custkey, 3 AS c_nationkey, 'X' AS c_mktsegment FROM range(94) r(i)",
        "supplier": "SELECT i AS s_suppkey, 3 AS s_nationkey FROM range(1, 4) r(i)",
    }
    for name, sql in made.items():
        duckdb.sql(f"COPY ({sql}{'' if 'FROM' in sql else ' FROM range(800) r(i)'}) TO '{d}/{name}.parquet' (FORMAT parquet)")
    return d


def shuffled(spark, what: str = "shuffleWriteRecords") -> int:
    """Rows, or bytes, that the session's stages have written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages, none = sc.statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    seen = stages.stageList(None, False, False, none, None)
    return sum(getattr(seen.apply(i), what)() for i in range(seen.size()))


def test_round_trip():
    for ids in ([5], [0, 1, 2], [-9, 4, 300, 70_000, 1 << 40], ENDS, [ENDS[1] - 1, ENDS[1]], range(0, 10**6, 997)):
        assert packed.unpack(packed.pack(np.array(ids, "int64"))).tolist() == list(ids)
    assert packed.inflate(packed.deflate("12,é,7")) == "12,é,7"


@pytest.mark.parametrize("merge", [1, 1 << 21])
def test_union(monkeypatch, merge):
    monkeypatch.setattr(packed, "MERGE", merge)
    rng = np.random.default_rng(3)
    lists = [np.unique(rng.integers(0, 500, 60)) for _ in range(40)]
    for n in (1, 2, 3, 40):
        u = packed.Union()
        for x in lists[:n]:
            u.add(packed.pack(x))
        assert len(u) == len(set(np.concatenate(lists[:n]).tolist()))


def test_groups_go_on_in_later_batches():
    batches = [pa.record_batch({"k": pa.array(k, pa.int64())}) for k in ([None, None], [None, 0], [], [0, 0, 2], [2], [3])]

    def add(state, piece):
        state.append(piece.num_rows)

    found = [(k, sum(s)) for k, s in packed.groups(batches, "k", list, add)]
    assert found == [(None, 3), (0, 3), (2, 2), (3, 1)]


def test_impact_ships_lists_and_not_each_flow_to_each_table(spark, many):
    before = shuffled(spark)
    got = rows(spark, many, "impact_by_table")
    assert len(got) > 500 and None in {r[0] for r in got}
    assert shuffled(spark) - before < 40_000  # with a row for each flow and table it was 271,043


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Thirty suppliers with 200 large lines each, of processes that follow each other; supplier 5 has no part, process 2 is there twice."""
    d = str(tmp_path_factory.mktemp("wide"))
    made = {
        "lineitem": "SELECT i AS l_orderkey, CASE WHEN i // 200 <> 5 THEN 1000000 + i * 7919 % 6000 * 3571 END AS l_partkey, i // 200 AS l_suppkey, 1 AS l_linenumber, 45.0 AS l_quantity, 'N' AS l_returnflag FROM range(6000) r(i)",
        "orders": "SELECT i AS o_orderkey, i // 2 * 2 AS o_custkey, '5-LOW' AS o_orderpriority, 'O' AS o_orderstatus FROM range(6000) r(i)",
        "customer": "SELECT i AS c_custkey, 3 AS c_nationkey, 'X' AS c_mktsegment FROM (SELECT unnest(range(6010)) UNION ALL SELECT 2) r(i)",
        "supplier": "SELECT i AS s_suppkey, 3 AS s_nationkey FROM range(30) r(i)",
    }
    for name, sql in made.items():
        duckdb.sql(f"COPY ({sql}) TO '{d}/{name}.parquet' (FORMAT parquet)")
    return d


def test_nested_flows_ship_a_text_once_to_a_range(spark, wide):
    large = {"spark.sql.shuffle.partitions": "300", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    held = {k: spark.conf.get(k) for k in large}
    try:
        for k, v in large.items():
            spark.conf.set(k, v)
        before = shuffled(spark, "shuffleWriteBytes")
        got = {r[0]: r for r in rows(spark, wide, "nested_flow_struct")}
        assert shuffled(spark, "shuffleWriteBytes") - before < 2_500_000  # 4.5 MB with the text in each flow
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(got) == 6010
    assert got[1][1:] == ("-:-:function-only:-", 1) and got[1000][1] == "1000:5:complete:- 1001:5:complete:-" and got[2][2] == 4


def test_nested_keeps_what_has_no_process_or_handler(spark):
    flows = spark.createDataFrame([(None, "-:-:x:", None), (4, "10:1:x:", 1), (4, "1:1:x:", 1), (-4, "2:2:x:", 2), (None, "3:9:x:", 9)], "process_id long, head string, handler_id long")
    texts = spark.createDataFrame([(1, "5,6"), (2, None)], "handler_id long, text string")
    got = {tuple(r) for r in packed.nested(flows, texts).collect()}
    assert got == {(None, "-:-:x:- 3:9:x:-", 2), (4, "10:1:x:5,6 1:1:x:5,6", 2), (-4, "2:2:x:-", 1)}


def test_flows_without_a_handler_are_not_one_task(spark):
    flows = spark.range(20_000).selectExpr("id AS process_id", "concat('-:', id, ':x:') AS head", "CAST(NULL AS long) AS handler_id")
    texts = spark.createDataFrame([(1, "5")], "handler_id long, text string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    seen, spread = [], packed.spread

    def watched(df, *keys, by_range=False):
        out = spread(df, *keys, by_range=by_range)
        seen.append(out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return out

    packed.spread = watched
    try:
        assert packed.nested(flows, texts).count() == 20_000
    finally:
        packed.spread = spread
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert len(seen) == 2 and max(seen) < 1_000
