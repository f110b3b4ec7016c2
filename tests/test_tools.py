"""The query tools over a small seeded graph: a page that calls a service that reads a table."""

import pytest
from pyspark.sql import functions as F

from flowloom.graph import Graph
from flowloom.plans import tools


@pytest.fixture(scope="module")
def g(spark):
    def df(rows, ddl):
        return spark.createDataFrame(rows, ddl)

    ev = "evidence struct<filePath:string,lineStart:int,lineEnd:int,snippet:string,confidence:string>"
    nodes = {
        "SourceFile": df([("F1", "src/Users.tsx", "web", "ts"), ("F2", "src/server.ts", "api", "ts"), ("F3", "src/Other.tsx", "web", "ts")], "id string, filePath string, repository string, language string"),
        "FunctionDefinition": df([("fp", "UsersPage.load", "F1", 10, True, False), ("fl", "loadUsers", "F1", 20, False, True), ("fh", "listUsers", "F2", 5, True, True), ("fs", "service", "F2", 30, False, True), ("fo", "Other", "F3", 1, True, False)], "id string, name string, sourceFileId string, sourceLine int, isExported boolean, isAsync boolean"),
        "ClientSideProcess": df([("P1", "event_handler", "onClick", "fp", "F1", 11, "react", "web"), ("P2", "event_handler", "idle", "fo", "F3", 2, "react", "web")], "id string, kind string, name string, functionId string, sourceFileId string, sourceLine int, framework string, repository string"),
        "ClientSideAPICaller": df([("C1", "fl", "F1", 21, "GET", "/api/users", "exact", "fetch", "web", None, None), ("C2", "fl", "F1", 22, "GET", "https://x.org/a", "exact", "fetch", "web", True, "x.org"), ("C3", "fo", "F3", 3, "GET", "/nowhere", "exact", "fetch", "web", None, None)], "id string, functionId string, sourceFileId string, sourceLine int, httpMethod string, urlLiteral string, egressConfidence string, framework string, repository string, isExternal boolean, externalHost string"),
        "APIEndpoint": df([("E1", "GET", "/api/users", "fh", "express", "api", ("src/server.ts", 1, 2, "x", "exact"), [("m", "auth", 0)]), ("E2", "POST", "/api/users", None, "express", "api", None, None)], f"id string, httpMethod string, routePattern string, handlerFunctionId string, framework string, repository string, {ev}, middlewareChain array<struct<functionId:string,name:string,order:int>>"),
        "DatabaseSystem": df([("S", "postgres", "db")], "id string, kind string, name string"),
        "DatabaseTable": df([("T1", "S", "users", "table"), ("T2", "S", "logs", "table")], "id string, systemId string, name string, kind string"),
        "DatabaseInteraction": df([("I1", "fs", "read", "prisma", "direct")], "id string, callSiteFunctionId string, operation string, orm string, confidence string"),
        "Screen": df([("N1", "Users", "fp", "/users", "F1", 1, "router", "web"), ("N2", "Other", "fo", None, "F3", 1, "router", "web")], "id string, name string, componentFunctionId string, routePath string, sourceFileId string, sourceLine int, framework string, repository string"),
        "EnvironmentVariable": df([("V1", "PORT", "config", True, "process.env", "F2", 1, "api"), ("V2", "PORT", "config", False, "process.env", "F2", 9, "api")], "id string, name string, category string, hasDefault boolean, accessPattern string, sourceFileId string, sourceLine int, repository string"),
    }
    e = df([("DEFINED_IN", "fp", "F1", None), ("DEFINED_IN", "fl", "F1", None), ("DEFINED_IN", "fh", "F2", None), ("CALLS_FUNCTION", "fp", "fl", None), ("CALLS_FUNCTION", "fh", "fs", None), ("CALLS_FUNCTION", "fs", "fh", None), ("READS", "I1", "T1", None), ("PERFORMED_BY", "I1", "fs", None), ("NAVIGATES_TO", "fp", "N2", "push")], "edge_type string, from_id string, to_id string, method string")
    return tools.stitch_graph(Graph(spark).commit(nodes, e, {"plugin": "seed"}).keep()).keep()


def ids(df, column):
    return {r[column] for r in df.collect()}


def test_flows_and_impact(g):
    got = {(r["process_id"], r["caller_id"]): r["completeness"] for r in tools.walk_all_flows(g).collect()}
    assert got == {("P1", "C1"): "complete", ("P1", "C2"): "caller-only", ("P2", "C3"): "caller-only"}
    assert tools.walk_all_flows(g, table="users").count() == 1 and tools.walk_all_flows(g, table="logs").count() == 0
    assert tools.walk_all_flows(g, endpoint="/api").count() == 1 and tools.walk_all_flows(g, file="src/server.ts").count() == 1
    assert tools.impact_analysis(g, route="/api/users").count() == 1 and tools.impact_analysis(g, table="users").count() == 1
    assert {(r["operation"], r["n"]) for r in tools.operation_histogram(g, tools.impact_analysis(g, table="users")).collect()} == {("read", 1)}
    assert tools.diff_flows(g, ["src/Other.tsx"]).count() == 1 and tools.list_incomplete_flows(g).count() == 2
    assert tools.walk_flows(g, "P2").count() == 1
    with pytest.raises(ValueError):
        tools.impact_analysis(g)


def test_lists(g):
    assert ids(tools.list_unmatched_callers(g), "caller_id") == {"C3"} and ids(tools.list_uncalled_endpoints(g), "endpoint_id") == {"E2"}
    assert ids(tools.list_orphan_tables(g), "name") == {"logs"} and ids(tools.list_unreachable_screens(g), "name") == {"Users"}
    r = tools.list_server_endpoints(g).where("endpoint_id = 'E1'").first()
    assert r["reads"] == ["users"] and r["writes"] == [] and r["middleware"] == ["auth"] and r["handler"] == "listUsers"
    assert tools.list_client_api_calls(g).where("caller_id = 'C1'").first()["path"] == "src/Users.tsx"
    assert tools.list_env_vars(g).first()["uses"][0]["sourceLine"] == 1
    assert [(x["name"], x["endpoints"]) for x in tools.list_middleware(g, name="AUTH").collect()] == [("auth", 1)]
    assert {x["node_type"]: x["n"] for x in tools.stats(g, "web").collect()}["FunctionDefinition"] == 2
    assert [x["repository"] for x in tools.list_repositories(g).collect()] == ["web", "api"]
    assert tools.describe_architecture(g)["domains"].first()["domain"] == "/api"
    assert tools.list_nodes(g, "APIEndpoint", limit=1, offset=1).first()["total"] == 2
    with pytest.raises(tools.NotFound):
        tools.get_node(g, "APIEndpoint", "zz")


def test_screens(g):
    assert tools.list_screens(g).where("screen = 'Users'").first()["endpoints"] == ["GET /api/users"]
    assert [r["screen"] for r in tools.list_pages(g).collect()] == ["Users"]
    assert {(r["src"], r["dst"]) for r in tools.navigation_graph(g).collect()} == {("Users", "Other")}
    assert tools.navigation_graph(g, start="Users", end="Other").first()["path"] == ["Users", "Other"]
    assert tools.walk_screen_flows(g, "Users").count() == 2 and tools.describe_screen(g, "Users").first()["leads_to"] == ["Other"]
    assert {r["node_type"] for r in tools.describe_file(g, "Users").collect()} == {"FunctionDefinition", "ClientSideAPICaller", "ClientSideProcess", "Screen"}


def test_stitch_tools(g):
    assert {r["state"]: r["n"] for r in tools.stitch_report(g).groupBy("state").agg(F.count("*").alias("n")).collect()} == {"stitched": 1, "external": 1, "unresolved": 1}
    done = tools.confirm_stitch(g, "C3", "E2", "2020-01-01")
    assert done.edges_of("RESOLVES_TO_ENDPOINT").count() == 2 and tools.confirm_stitch(done, "C3", "E2", "2021") is done
    assert tools.reject_stitch(done, "C3", "E2")["existing"] == 1
    same, edges = tools.auto_stitch(g, dry_run=True)
    assert same is g and edges.count() == 0
    rule = {"name": "r", "from": "web", "to": "api", "replace": ("/nowhere", "/api/users")}
    ruled, hit = tools.apply_stitch_rules(g, tools.add_rule([], rule))
    assert ids(hit, "endpoint_id") == {"E1"} and len(tools.add_rule([rule], dict(rule, name="again"))) == 1


def test_source_lines(spark):
    t = spark.createDataFrame([("a.ts", "1\n2\n3\n4")], "path string, content string")
    assert [r["line"] for r in tools.get_source_lines(t, "a.ts", 2, 2, 1).collect()] == ["1", "2", "3"]
    with pytest.raises(ValueError):
        tools.get_source_lines(t, "../a.ts", 1, 1)
