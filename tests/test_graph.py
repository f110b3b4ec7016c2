import pytest
from pyspark.sql import functions as F

from flowloom import schema
from flowloom.functions import ids, strings
from flowloom.graph import Graph, SchemaValidationError
from flowloom.operators import walk


def files(spark, *rows):
    df = spark.createDataFrame([(p, r) for p, r in rows], "filePath string, repository string")
    return df.select(ids.node_id("SourceFile", repository="repository", filePath="filePath").alias("id"), "filePath", "repository", F.lit("ts").alias("language"))


def seeded(spark):
    f = files(spark, ("a.ts", "web"), ("b.ts", "api"))
    fid = {r["filePath"]: r["id"] for r in f.collect()}
    fn = spark.createDataFrame([("fn1", "f", fid["a.ts"], 1, True, False), ("fn2", "g", fid["b.ts"], 2, True, False)], "id string, name string, sourceFileId string, sourceLine int, isExported boolean, isAsync boolean")
    e = spark.createDataFrame([("DEFINED_IN", "fn1", fid["a.ts"], None), ("CALLS_FUNCTION", "fn1", "fn2", 3), ("CALLS_FUNCTION", "fn1", "fn2", 4)], "edge_type string, from_id string, to_id string, sourceLine int")
    return Graph(spark).commit({"SourceFile": f, "FunctionDefinition": fn}, e, {"plugin": "t", "createdAt": "2020"}), fid


def test_commit_is_idempotent_and_counts_input(spark):
    g, _ = seeded(spark)
    again = g.commit({"SourceFile": g.node("SourceFile").drop("_ord")}, g.edge.drop("_ord"))
    assert again.edge.count() == 3 and again.node("SourceFile").count() == 2
    assert [(r["id"], r["nodeCount"], r["edgeCount"]) for r in again.batch_list().collect()] == [(1, 4, 3), (2, 2, 3)]
    assert g.repositories().count() == 2


def test_invalid_batch_changes_nothing(spark):
    bad = files(spark, ("a.ts", "web")).withColumn("language", F.lit(None).cast("string"))
    with pytest.raises(SchemaValidationError):
        Graph(spark).commit({"SourceFile": bad})
    with pytest.raises(ValueError):
        schema.node_schema("Nothing")


def test_lookups(spark):
    g, fid = seeded(spark)
    assert g.get_node("FunctionDefinition", "fn1").count() == 1 and g.get_node("APIEndpoint", "fn1").count() == 0
    assert g.get_node_by_id("fn2").first()["node_type"] == "FunctionDefinition"
    assert g.find_nodes("FunctionDefinition", {"isExported": True, "returnType": None}).count() == 2
    with pytest.raises(TypeError):
        g.find_nodes("FunctionDefinition", {"parameters": []})
    assert g.find_edges(to_id="fn2", edge_type="CALLS_FUNCTION").count() == 2


def test_cascade_deletes(spark):
    g, fid = seeded(spark)
    left, n = g.delete_by_repository("web")
    assert n == {"nodes": 2, "edges": 3} and left.node("FunctionDefinition").count() == 1
    same, n = g.delete_by_file("web", "missing.ts")
    assert n["nodes"] == 0 and same is g
    left, n = g.delete_by_file("api", "b.ts")
    assert n == {"nodes": 2, "edges": 2}


def test_save_and_load(spark, tmp_path):
    g, _ = seeded(spark)
    g.save(str(tmp_path))
    back = Graph.load(spark, str(tmp_path), ["SourceFile", "FunctionDefinition"])
    assert back.edge.count() == 3 and back.node("SourceFile").count() == 2
    g.set_meta("root", "/w").save(str(tmp_path / "all"))
    every = Graph.load(spark, str(tmp_path / "all"))
    assert every.node("SourceFile").count() == 2 and every.node("DatabaseTable").count() == 0 and every.get_meta("root") == "/w"


def test_names(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    cases = {"queries": "query", "classes": "class", "addresses": "address", "databases": "database", "boxes": "box", "batches": "batch", "people": "person", "data": "datum", "versions": "version", "bus": None, "men": None, "houses": "house", "fish": None}
    for s, want in cases.items():
        assert one(strings.singular(F.lit(s))) == want, s
    got = set(one(strings.table_aliases(F.lit("app_versions"))))
    assert {"app_versions", "AppVersions", "appVersions", "app_version", "AppVersion", "appVersion"} <= got


def test_alias_merge_and_prune(spark):
    t = spark.createDataFrame([("t1", "s", "data_queries", "table", "f"), ("t2", "s", "dataQuery", "table", None), ("t3", "s", "other", "table", None)], "id string, systemId string, name string, kind string, declaredIn string")
    s = spark.createDataFrame([("s", "postgres", "db"), ("s2", "redis", "cache")], "id string, kind string, name string")
    e = spark.createDataFrame([("READS", "i", "t2"), ("TABLE_IN", "t2", "s"), ("TABLE_IN", "zz", "s2")], "edge_type string, from_id string, to_id string")
    g = Graph(spark).commit({"DatabaseTable": t, "DatabaseSystem": s}, e)
    merged, moved = g.merge_aliased_tables()
    assert [tuple(r) for r in moved.collect()] == [("t2", "t1")]
    assert {r["id"] for r in merged.edge.collect()} == {r["id"] for r in Graph(spark).commit({"DatabaseTable": t, "DatabaseSystem": s}, e.replace("t2", "t1")).edge.collect()}
    twice, _ = Graph(spark).commit({"DatabaseTable": t, "DatabaseSystem": s}, e.unionAll(spark.createDataFrame([("READS", "i", "t1")], e.schema))).merge_aliased_tables()
    assert twice.edge.count() == 3  # both reads are of one table now
    assert {(r["from_id"], r["to_id"]) for r in merged.edge.collect()} == {("i", "t1"), ("t1", "s"), ("zz", "s2")}
    pruned, gone = merged.prune_empty_systems()
    assert [r[0] for r in gone.collect()] == ["s2"] and pruned.edge.count() == 2


def test_flow_ladder(spark):
    P = spark.createDataFrame([("p1", "f1"), ("p2", "f2"), ("p3", "f9"), ("p4", "f4"), ("p5", "f5"), ("p6", None)], "process_id string, function_id string")
    T = spark.createDataFrame([], "src string, dst string, ord long")
    calls = spark.createDataFrame([("f1", "g"), ("g", "f1"), ("h1", "db"), ("f4", "f4")], "src string, dst string")
    callers = spark.createDataFrame([("c1", "g"), ("c2", "f4"), ("c3", "f5")], "caller_id string, function_id string")
    resolves = spark.createDataFrame([("c1", "e1"), ("c3", "e3")], "caller_id string, endpoint_id string")
    ends = spark.createDataFrame([("e1", "h1"), ("e3", None)], "endpoint_id string, handler_id string")
    inter = spark.createDataFrame([("db", "i1")], "function_id string, interaction_id string")
    fns = spark.createDataFrame([(x,) for x in ("f1", "f2", "g", "f4", "f5", "h1", "db")], "function_id string")
    got = {r["process_id"]: r["completeness"] for r in walk.flows(P, T, calls, callers, resolves, ends, inter, fns).collect()}
    assert got == {"p1": "complete", "p2": "function-only", "p3": "process-only", "p4": "caller-only", "p5": "endpoint-only", "p6": "process-only"}


def test_hops_paths_and_asof(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    hops = walk.service_hops(spark.createDataFrame([("f", "a")], "flow_id string, endpoint_id string"), calls, 5)
    assert {(r["endpoint_id"], r["depth"]) for r in hops.collect()} == {("b", 1), ("c", 2)}
    assert walk.service_hops(spark.createDataFrame([("f", "a")], "flow_id string, endpoint_id string"), calls, 1).count() == 0
    paths = walk.shortest_paths(spark.createDataFrame([("r", "a")], "root string, node string"), calls)
    assert {r["node"]: r["path"] for r in paths.collect()}["c"] == ["a", "b", "c"]
    fns = spark.createDataFrame([("f1", "x", 1), ("f2", "x", 10)], "function_id string, file string, line int")
    at = spark.createDataFrame([("c1", "x", 9), ("c2", "x", 10), ("c3", "x", 0), ("c4", "y", 5)], "call_id string, file string, line int")
    assert {r["call_id"]: r["function_id"] for r in walk.enclosing(at, fns).collect()} == {"c1": "f1", "c2": "f2", "c3": None, "c4": None}
