"""The query surface: one function for each question that can be asked of a graph.

Each takes a ``Graph`` and parameters and returns a DataFrame (or, where the answer changes
the graph, a new ``Graph`` with it). Filters go to the roots before a walk where that gives
the same answer. Results are frames, so limits and formats are the caller's business.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom import schema
from flowloom.functions import urls
from flowloom.graph import Graph, equals
from flowloom.operators import stitch, walk

SKILL = "Walk flows from user actions to tables, match callers to endpoints, and ask what a change touches."


class NotFound(LookupError):
    """What was asked for isn't in the graph."""


# --- views of the graph that the operators take -----------------------------------------


def _edge(g: Graph, edge_type: str, *more: str) -> DataFrame:
    cols = [F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("_ord").alias("ord"), *more]
    return g.edges_of(edge_type).select(*cols)


def caller_view(g: Graph) -> DataFrame:
    return g.node("ClientSideAPICaller").select(
        F.col("id").alias("caller_id"), F.col("functionId").alias("function_id"), F.col("httpMethod").alias("method"), F.col("urlLiteral").alias("url"),
        F.col("egressConfidence").alias("egress"), F.col("templateParts").alias("template_parts"), F.col("templateSpanCount").alias("span_count"),
        F.col("templateSegmentCount").alias("segment_count"), "repository", F.coalesce("isExternal", F.lit(False)).alias("is_external"), F.col("externalHost").alias("external_host"),
        F.col("sourceFileId").alias("file_id"), F.col("sourceLine").alias("line"), "framework",
    )


def endpoint_view(g: Graph) -> DataFrame:
    return g.node("APIEndpoint").select(
        F.col("id").alias("endpoint_id"), F.col("httpMethod").alias("method"), F.col("routePattern").alias("route"), F.col("handlerFunctionId").alias("handler_id"),
        "repository", "framework", F.col("_ord").alias("ord"), F.col("evidence.filePath").alias("evidence_path"), "middlewareChain",
    )


def process_view(g: Graph) -> DataFrame:
    return g.node("ClientSideProcess").select(F.col("id").alias("process_id"), F.col("functionId").alias("function_id"), "kind", "name", "repository", F.col("sourceFileId").alias("file_id"))


def accesses(g: Graph) -> DataFrame:
    """(interaction_id, table_id) by READS and WRITES."""
    return g.edges_of("READS", "WRITES").select(F.col("from_id").alias("interaction_id"), F.col("to_id").alias("table_id")).distinct()


def interaction_view(g: Graph, by: str = "call_site") -> DataFrame:
    """(interaction_id, function_id, operation): by the call site, or by PERFORMED_BY edges. The two differ where a front-end emits only one."""
    i = g.node("DatabaseInteraction")
    if by == "call_site":
        return i.select(F.col("id").alias("interaction_id"), F.col("callSiteFunctionId").alias("function_id"), "operation")
    e = _edge(g, "PERFORMED_BY")
    return i.join(e, F.col("id") == F.col("src")).select(F.col("id").alias("interaction_id"), F.col("dst").alias("function_id"), "operation")


def resolves_view(g: Graph) -> DataFrame:
    return g.edges_of("RESOLVES_TO_ENDPOINT").select(F.col("from_id").alias("caller_id"), F.col("to_id").alias("endpoint_id"), "id", "matchedBy", "matchConfidence")


def flow_view(g: Graph, repository: str | None = None, kind: str | None = None, process_id: str | None = None, max_depth: int = walk.MAX_DEPTH) -> DataFrame:
    """A row for each flow; roots are chosen before the walk."""
    p = process_view(g)
    for column, value in (("repository", repository), ("kind", kind), ("process_id", process_id)):
        if value is not None:
            p = p.where(F.col(column) == value)
    f = walk.flows(p, _edge(g, "TRIGGERS"), _edge(g, "CALLS_FUNCTION"), caller_view(g), resolves_view(g), endpoint_view(g), interaction_view(g), g.node("FunctionDefinition").select(F.col("id").alias("function_id")), max_depth)
    return f.join(p.select("process_id", "kind", "name", "repository"), "process_id")


def tables_of_handlers(g: Graph, by: str = "call_site", max_depth: int | None = walk.MAX_DEPTH) -> DataFrame:
    """(handler_id, interaction_id, operation, table_id): a null table where an interaction names none."""
    handlers = endpoint_view(g).where("handler_id IS NOT NULL").select("handler_id").distinct()
    hops = walk.database_hops(handlers, _edge(g, "CALLS_FUNCTION"), interaction_view(g, by), accesses(g), max_depth)
    return hops.select("handler_id", "interaction_id", "operation", F.explode_outer("tables").alias("table_id"))


def endpoint_calls(g: Graph, max_depth: int = walk.MAX_DEPTH) -> DataFrame:
    """(src, dst): an endpoint whose handler's call graph holds a caller of another endpoint."""
    e = endpoint_view(g).where("handler_id IS NOT NULL")
    reached = walk.reach(e.select(F.col("endpoint_id").alias("root"), F.col("handler_id").alias("node")), _edge(g, "CALLS_FUNCTION"), max_depth)
    callers = caller_view(g).select("caller_id", F.col("function_id").alias("node"))
    return reached.join(callers, "node").join(resolves_view(g), "caller_id").select(F.col("root").alias("src"), F.col("endpoint_id").alias("dst")).distinct()


def _scoped(df: DataFrame, repository: str | None) -> DataFrame:
    return df if repository is None else df.where(F.col("repository") == repository)


# --- summaries -----------------------------------------------------------------------------


def describe_skill() -> str:
    return SKILL


def list_repositories(g: Graph) -> DataFrame:
    rows = reduce(DataFrame.unionByName, [
        g.node("SourceFile").select("repository", "language", "framework"),
        *[g.node(t).select("repository", F.lit(None).cast("string").alias("language"), "framework") for t in ("APIEndpoint", "ClientSideAPICaller", "ClientSideProcess")],
    ])
    names = rows.groupBy("repository").agg(F.array_sort(F.collect_set("language")).alias("languages"), F.array_sort(F.collect_set("framework")).alias("frameworks"))
    return g.repositories().join(names, "repository").orderBy(F.desc("source_files"), "repository")


def stats(g: Graph, repository: str | None = None) -> DataFrame:
    """(node_type, n). Within a repository, functions count by the file they are defined in; systems, tables and interactions stay global."""
    out = []
    for t in schema.NODES:
        df = g.node(t)
        if repository is not None:
            if "repository" in df.columns:
                df = _scoped(df, repository)
            elif t == "FunctionDefinition":
                files = _scoped(g.node("SourceFile"), repository).select(F.col("id").alias("dst"))
                df = df.join(_edge(g, "DEFINED_IN").join(files, "dst", "left_semi"), F.col("id") == F.col("src"), "left_semi")
        out.append(df.agg(F.count("*").alias("n")).select(F.lit(t).alias("node_type"), "n"))
    return reduce(DataFrame.unionAll, out)


def describe_architecture(g: Graph, repository: str | None = None) -> dict[str, DataFrame]:
    """Frames by topic: domains (first route segment), processes by kind, screens by navigator, external hosts."""
    e, c = _scoped(endpoint_view(g), repository), _scoped(caller_view(g), repository)
    domain = F.concat(F.lit("/"), F.coalesce(F.try_element_at(urls.path_segments(F.col("route")), F.lit(1)), F.lit("")))
    return {
        "domains": e.groupBy(domain.alias("domain")).agg(F.count("*").alias("endpoints"), F.array_sort(F.collect_set("method")).alias("methods")).orderBy(F.desc("endpoints"), "domain"),
        "processes": _scoped(process_view(g), repository).groupBy("kind").agg(F.count("*").alias("n")),
        "screens": _scoped(g.node("Screen"), repository).groupBy(F.coalesce("navigatorKind", F.lit("<none>")).alias("navigator")).agg(F.count("*").alias("n")),
        "external_hosts": c.where("is_external").groupBy("external_host").agg(F.count("*").alias("callers")).orderBy(F.desc("callers"), "external_host"),
    }


def list_nodes(g: Graph, node_type: str, where: dict | None = None, limit: int = 50, offset: int = 0, count_only: bool = False, fields: list[str] | None = None, include_evidence: bool = False) -> DataFrame:
    """A page of nodes in the order of writing, with the total before paging."""
    found = g.node(node_type).where(equals(where or {}))
    total = found.agg(F.count("*").alias("total"))
    if count_only:
        return total
    cols = fields or [c for c in found.columns if c != "_ord" and (include_evidence or c != "evidence")]
    return found.orderBy("_ord", "id").offset(offset).limit(limit).select(*cols).crossJoin(F.broadcast(total))


def get_node(g: Graph, node_type: str, node_id: str) -> DataFrame:
    found = g.get_node(node_type, node_id)
    if found.isEmpty():
        raise NotFound(f"{node_type} {node_id}")
    return found.drop("_ord")


def find_edges(g: Graph, from_id: str | None = None, to_id: str | None = None, edge_type: str | None = None) -> DataFrame:
    return g.find_edges(from_id, to_id, edge_type).drop("_ord")


# --- flows -----------------------------------------------------------------------------------


def walk_flows(g: Graph, process_id: str, max_depth: int = walk.MAX_DEPTH) -> DataFrame:
    return flow_view(g, process_id=process_id, max_depth=max_depth)


def hops_of_flows(g: Graph, flows: DataFrame, max_hops: int = walk.MAX_HOPS) -> DataFrame:
    """(endpoint_id, hop_endpoint_id, depth, path) of the flows' endpoints."""
    starts = flows.where("endpoint_id IS NOT NULL").select(F.col("endpoint_id").alias("flow_id"), "endpoint_id").distinct()
    h = walk.service_hops(starts, endpoint_calls(g), max_hops)
    return h.select(F.col("flow_id").alias("endpoint_id"), F.col("endpoint_id").alias("hop_endpoint_id"), "depth", "path")


def _touched_tables(g: Graph, flows: DataFrame, hops: bool) -> DataFrame:
    """(endpoint_id, table_id): tables behind an endpoint, and with ``hops`` behind those that it calls."""
    e = endpoint_view(g).select("endpoint_id", "handler_id")
    own = e.join(tables_of_handlers(g), "handler_id").select("endpoint_id", "table_id").where("table_id IS NOT NULL").distinct()
    if not hops:
        return own
    far = hops_of_flows(g, flows).select("endpoint_id", F.col("hop_endpoint_id").alias("_h")).join(own.select(F.col("endpoint_id").alias("_h"), "table_id"), "_h").select("endpoint_id", "table_id")
    return own.unionByName(far).distinct()


def _table_ids(g: Graph, name: str) -> DataFrame:
    return g.node("DatabaseTable").where(F.col("name") == name).select(F.col("id").alias("table_id"))


def _files_of_flows(g: Graph, flows: DataFrame) -> DataFrame:
    """The flows with ``path``, a row for each file of process, caller, endpoint and handler."""
    files = g.node("SourceFile").select(F.col("id").alias("_file"), F.col("filePath").alias("path"))
    p = process_view(g).select(F.col("process_id").alias("_k"), F.col("file_id").alias("_file")).join(files, "_file").select("_k", "path")
    c = caller_view(g).select(F.col("caller_id").alias("_k"), F.col("file_id").alias("_file")).join(files, "_file").select("_k", "path")
    h = g.node("FunctionDefinition").select(F.col("id").alias("_k"), F.col("sourceFileId").alias("_file")).join(files, "_file").select("_k", "path")
    e = endpoint_view(g).where("evidence_path IS NOT NULL").select(F.col("endpoint_id").alias("_k"), F.col("evidence_path").alias("path"))
    where = reduce(DataFrame.unionAll, [p, c, h, e]).distinct()
    keyed = flows.withColumn("_k", F.explode(F.array_compact(F.array("process_id", "caller_id", "endpoint_id", "handler_id"))))
    return keyed.join(where, "_k").drop("_k")


def walk_all_flows(g: Graph, completeness: str | None = None, table: str | None = None, endpoint: str | None = None, file: str | None = None, repository: str | None = None, kind: str | None = None, max_depth: int = walk.MAX_DEPTH) -> DataFrame:
    """All flows, filtered; ``endpoint`` is a prefix of the route, ``table`` counts tables behind called services as well."""
    f = flow_view(g, repository, kind, max_depth=max_depth)
    if completeness is not None:
        f = f.where(F.col("completeness") == completeness)
    if endpoint is not None:
        f = f.join(endpoint_view(g).where(F.col("route").startswith(endpoint)), "endpoint_id", "left_semi")
    if table is not None:
        f = f.join(_touched_tables(g, f, True).join(_table_ids(g, table), "table_id"), "endpoint_id", "left_semi")
    if file is not None:
        f = _files_of_flows(g, f).where(F.col("path") == file).drop("path").distinct()
    return f


def list_incomplete_flows(g: Graph, max_depth: int = walk.MAX_DEPTH) -> DataFrame:
    return flow_view(g, max_depth=max_depth).where("completeness != 'complete'")


def impact_analysis(g: Graph, route: str | None = None, table: str | None = None, file: str | None = None) -> DataFrame:
    """Complete flows that touch the first of route, table or file that is given."""
    f = flow_view(g)
    if route is not None:
        return f.where("completeness = 'complete'").join(endpoint_view(g).where(F.col("route") == route), "endpoint_id", "left_semi")
    if table is not None:
        hit = _touched_tables(g, f, False).join(_table_ids(g, table), "table_id")
        return f.where("completeness = 'complete'").join(hit, "endpoint_id", "left_semi")
    if file is not None:
        return _files_of_flows(g, f).where(F.col("path") == file).drop("path").distinct()
    raise ValueError("a route, a table or a file is needed")


def operation_histogram(g: Graph, flows: DataFrame) -> DataFrame:
    hit = flows.select("handler_id").distinct().join(tables_of_handlers(g), "handler_id")
    return hit.select("interaction_id", "operation").distinct().groupBy("operation").agg(F.count("*").alias("n"))


def diff_flows(g: Graph, changed: list[str]) -> DataFrame:
    """Flows that touch one of the changed files."""
    paths = g.spark.createDataFrame([(p,) for p in changed], "path string")
    return _files_of_flows(g, flow_view(g)).join(paths, "path", "left_semi").drop("path").distinct()


# --- stitching ---------------------------------------------------------------------------------


def stitch_graph(g: Graph, mode: str = "exact", apps: DataFrame | None = None, rules: list[tuple[str, bool]] = ()) -> Graph:
    edges = stitch.stitch(caller_view(g), endpoint_view(g), apps, rules, mode)
    return g.commit(edges=resolve_edges(edges), meta={"plugin": "stitch"})


def resolve_edges(edges: DataFrame, strategy: str | None = None, confirmed_by: str | None = None, confirmed_at: str | None = None) -> DataFrame:
    cols = {"strategy": strategy, "confirmedBy": confirmed_by, "confirmedAt": confirmed_at}
    extra = [F.lit(v).cast("string").alias(k) for k, v in cols.items()]
    repo = [F.col(c).alias(n) for c, n in (("from_repository", "fromRepository"), ("to_repository", "toRepository")) if c in edges.columns]
    return edges.select(F.lit("RESOLVES_TO_ENDPOINT").alias("edge_type"), F.col("caller_id").alias("from_id"), F.col("endpoint_id").alias("to_id"), F.col("matched_by").alias("matchedBy"), F.col("confidence").alias("matchConfidence"), *extra, *repo)


def stitch_report(g: Graph) -> DataFrame:
    return stitch.report(caller_view(g), resolves_view(g))


def suggest_stitches(g: Graph, apps: DataFrame | None = None) -> DataFrame:
    return stitch.tiers(caller_view(g), endpoint_view(g), apps=apps)


def auto_stitch(g: Graph, least: str = "deterministic", dry_run: bool = False) -> tuple[Graph, DataFrame]:
    edges = stitch.auto_stitch(caller_view(g), endpoint_view(g), resolves_view(g), least)
    return (g if dry_run else g.commit(edges=resolve_edges(edges, "auto"), meta={"plugin": "auto_stitch"})), edges


def confirm_stitch(g: Graph, caller_id: str, endpoint_id: str, at: str, reason: str | None = None) -> Graph:
    """A manual edge; nothing changes where the pair is stitched already."""
    if not g.find_edges(caller_id, endpoint_id, "RESOLVES_TO_ENDPOINT").isEmpty():
        return g
    c = get_node(g, "ClientSideAPICaller", caller_id).select(F.col("egressConfidence").alias("eg"), F.col("urlLiteral").alias("u"))
    e = get_node(g, "APIEndpoint", endpoint_id).select(F.col("routePattern").alias("r"))
    by = F.when((F.col("eg") == "exact") & (F.col("u") == F.col("r")), "exact-url").otherwise("pattern")
    row = c.crossJoin(e).select(F.lit(caller_id).alias("caller_id"), F.lit(endpoint_id).alias("endpoint_id"), by.alias("matched_by"), F.lit("high").alias("confidence"))
    return g.commit(edges=resolve_edges(row, "manual", "user", at).withColumn("reason", F.lit(reason).cast("string")))


def reject_stitch(g: Graph, caller_id: str, endpoint_id: str) -> dict:
    """A report only: the edge stays where it is."""
    return {"caller": caller_id, "endpoint": endpoint_id, "existing": g.find_edges(caller_id, endpoint_id, "RESOLVES_TO_ENDPOINT").count()}


def add_rule(rules: list[dict], rule: dict) -> list[dict]:
    """The list with the rule, unless one with the same ends and transform is there."""
    key = lambda r: (r["from"], r["to"], r.get("strip"), r.get("add"), r.get("replace"))
    return rules if any(key(r) == key(rule) for r in rules) else [*rules, rule]


def apply_stitch_rules(g: Graph, rules: list[dict]) -> tuple[Graph, DataFrame]:
    hit = stitch.apply_rules(caller_view(g).where("NOT is_external AND egress != 'dynamic'"), endpoint_view(g), rules, resolves_view(g))
    return g.commit(edges=resolve_edges(hit, "rule"), meta={"plugin": "rules"}), hit


def review(g: Graph, least: int = 2) -> DataFrame:
    """Prefixes whose removal would stitch callers of one repository to routes of another, most first."""
    open_ = caller_view(g).where("NOT is_external AND egress != 'dynamic'").join(resolves_view(g), "caller_id", "left_anti")
    return stitch.mine_prefixes(open_, endpoint_view(g), least).orderBy(F.desc("fixes"), "prefix")


# --- lists ------------------------------------------------------------------------------------


def list_server_endpoints(g: Graph, repository: str | None = None) -> DataFrame:
    """Endpoints with handler, middleware, and the tables read and written by whatever the handler reaches."""
    e = _scoped(endpoint_view(g), repository)
    names = g.node("DatabaseTable").select(F.col("id").alias("table_id"), F.col("name").alias("table"))
    kinds = g.edges_of("READS", "WRITES").select(F.col("from_id").alias("interaction_id"), F.col("to_id").alias("table_id"), "edge_type")
    t = tables_of_handlers(g, "performed_by", None).drop("table_id").distinct().join(kinds, "interaction_id").join(names, "table_id")
    t = t.groupBy("handler_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("edge_type") == k, F.col("table")))).alias(k.lower()) for k in ("READS", "WRITES")])
    fn = g.node("FunctionDefinition").select(F.col("id").alias("handler_id"), F.col("name").alias("handler"))
    return e.join(fn, "handler_id", "left").join(t, "handler_id", "left").withColumn("middleware", F.transform(F.col("middlewareChain"), lambda x: x["name"])).drop("middlewareChain", "ord")


def list_client_api_calls(g: Graph, repository: str | None = None) -> DataFrame:
    c = _scoped(caller_view(g), repository)
    fn = g.node("FunctionDefinition").select(F.col("id").alias("function_id"), F.substring_index("name", ".", 1).alias("component"))
    files = g.node("SourceFile").select(F.col("id").alias("file_id"), F.col("filePath").alias("path"))
    trig = _edge(g, "TRIGGERS").groupBy(F.col("dst").alias("function_id")).agg(F.min_by("src", F.struct("ord", "src")).alias("process_id"))
    return c.join(fn, "function_id", "left").join(files, "file_id", "left").join(trig, "function_id", "left")


def list_unmatched_callers(g: Graph, include_external: bool = False) -> DataFrame:
    c = caller_view(g) if include_external else caller_view(g).where("NOT is_external")
    return c.join(resolves_view(g), "caller_id", "left_anti")


def list_uncalled_endpoints(g: Graph, repository: str | None = None) -> DataFrame:
    return _scoped(endpoint_view(g), repository).join(resolves_view(g), "endpoint_id", "left_anti")


def list_unreachable_screens(g: Graph, repository: str | None = None) -> DataFrame:
    s = _scoped(g.node("Screen"), repository)
    return s.join(_edge(g, "NAVIGATES_TO"), F.col("id") == F.col("dst"), "left_anti").drop("_ord")


def list_orphan_tables(g: Graph) -> DataFrame:
    t = g.node("DatabaseTable")
    return t.join(g.edges_of("READS", "WRITES").select("to_id"), F.col("id") == F.col("to_id"), "left_anti").drop("_ord")


def list_env_vars(g: Graph, repository: str | None = None) -> DataFrame:
    v = _scoped(g.node("EnvironmentVariable"), repository)
    use = F.struct("repository", "sourceFileId", "sourceLine", "hasDefault", "accessPattern")
    return v.groupBy("name").agg(F.min_by("category", F.struct("_ord", "id")).alias("category"), F.array_sort(F.collect_list(use)).alias("uses")).orderBy("name")


def list_middleware(g: Graph, repository: str | None = None, name: str | None = None) -> DataFrame:
    m = _scoped(endpoint_view(g), repository).select("endpoint_id", "method", "route", F.explode("middlewareChain").alias("m"))
    if name is not None:
        m = m.where(F.lower("m.name").contains(name.lower()))
    return m.groupBy(F.col("m.name").alias("name")).agg(F.countDistinct("endpoint_id").alias("endpoints"), F.array_sort(F.collect_set(F.concat_ws(" ", "method", "route"))).alias("routes")).orderBy("name")


# --- files and screens -----------------------------------------------------------------------


def get_source_lines(texts: DataFrame, path: str, first: int, last: int, context: int = 0) -> DataFrame:
    """(line_no, line) of a file around a range; ``texts`` (path, content). The context is held between 0 and 200; paths must stay inside."""
    if path.startswith(("/", "~")) or ".." in path.split("/"):
        raise ValueError("the path leaves the project")
    context = min(200, max(0, context))
    lines = texts.where(F.col("path") == path).select(F.posexplode(F.split("content", "\n", -1)).alias("i", "line"))
    return lines.select((F.col("i") + 1).alias("line_no"), "line").where(F.col("line_no").between(first - context, last + context)).orderBy("line_no")


def describe_file(g: Graph, part: str, repository: str | None = None) -> DataFrame:
    """(path, node_type, names) of what is in the files whose path contains ``part``."""
    files = _scoped(g.node("SourceFile"), repository).where(F.col("filePath").contains(part)).select(F.col("id").alias("file_id"), F.col("filePath").alias("path"))
    label = {"FunctionDefinition": "name", "ClientSideAPICaller": "urlLiteral", "ClientSideProcess": "name", "Screen": "name", "EnvironmentVariable": "name"}
    rows = reduce(DataFrame.unionAll, [g.node(t).select(F.col("sourceFileId").alias("file_id"), F.lit(t).alias("node_type"), F.struct(F.col("sourceLine").alias("line"), F.col(c).alias("name")).alias("x")) for t, c in label.items()])
    return rows.join(files, "file_id").groupBy("path", "node_type").agg(F.array_sort(F.collect_list("x")).alias("items"))


def list_screens(g: Graph, repository: str | None = None, text: str | None = None) -> DataFrame:
    """Screens with what their component's file calls: endpoints, and the tables of these endpoints' handlers themselves."""
    s = _scoped(g.node("Screen"), repository).select(F.col("id").alias("screen_id"), F.col("name").alias("screen"), "routePath", "navigatorKind", "repository", F.col("sourceFileId").alias("own_file"), "componentFunctionId")
    if text is not None:
        s = s.where(F.lower("screen").contains(text.lower()) | F.lower("routePath").contains(text.lower()))
    comp = _edge(g, "SCREEN_COMPONENT").groupBy(F.col("src").alias("screen_id")).agg(F.min_by("dst", F.struct("ord", "dst")).alias("_fn"))
    fn = g.node("FunctionDefinition").select(F.col("id").alias("component_id"), F.col("sourceFileId").alias("_file"))
    s = s.join(comp, "screen_id", "left").withColumn("component_id", F.coalesce("componentFunctionId", "_fn")).drop("_fn", "componentFunctionId").join(fn, "component_id", "left")
    s = s.withColumn("file_id", F.coalesce("_file", "own_file")).drop("_file", "own_file")
    calls = caller_view(g).select("file_id", "caller_id").join(resolves_view(g).select("caller_id", "endpoint_id"), "caller_id").join(endpoint_view(g).select("endpoint_id", "handler_id", "method", "route"), "endpoint_id")
    direct = interaction_view(g, "performed_by").select(F.col("function_id").alias("handler_id"), "interaction_id").join(accesses(g), "interaction_id")
    names = g.node("DatabaseTable").select(F.col("id").alias("table_id"), F.col("name").alias("table"))
    per = calls.join(direct.join(names, "table_id").select("handler_id", "table"), "handler_id", "left")
    per = per.groupBy("file_id").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "method", "route"))).alias("endpoints"), F.array_sort(F.collect_set("table")).alias("tables"))
    return s.join(per, "file_id", "left")


def list_pages(g: Graph, repository: str | None = None) -> DataFrame:
    return list_screens(g, repository).where("routePath IS NOT NULL").orderBy("routePath")


def describe_screen(g: Graph, name: str) -> DataFrame:
    s = list_screens(g).where(F.col("screen") == name)
    nav = _edge(g, "NAVIGATES_TO", "method")
    fns = g.node("FunctionDefinition").select(F.col("id").alias("src"), F.col("sourceFileId").alias("file_id"))
    names = g.node("Screen").select(F.col("id").alias("dst"), F.col("name").alias("target"))
    out = nav.join(fns, "src").join(names, "dst").groupBy("file_id").agg(F.array_sort(F.collect_set("target")).alias("leads_to"))
    return s.join(out, "file_id", "left")


def walk_screen_flows(g: Graph, name: str, max_depth: int = walk.MAX_DEPTH) -> DataFrame:
    """Flows of the processes in the screen's component file."""
    files = list_screens(g).where(F.col("screen") == name).select("file_id")
    mine = process_view(g).join(files, "file_id", "left_semi").select("process_id")
    return flow_view(g, max_depth=max_depth).join(mine, "process_id", "left_semi")


def screen_impact(g: Graph, name: str | None = None, route: str | None = None) -> DataFrame:
    """Other screens that share a table with the screen, and the tables."""
    s = list_screens(g).select("screen_id", "screen", "routePath", F.explode("tables").alias("table"))
    mine = s.where(F.col("screen") == name) if name is not None else s.where(F.col("routePath") == route)
    other = s.select(F.col("screen_id").alias("other_id"), F.col("screen").alias("other"), "table")
    return mine.join(other, "table").where("other_id != screen_id").groupBy("screen", "other").agg(F.array_sort(F.collect_set("table")).alias("tables"))


def screen_edges(g: Graph, repository: str | None = None) -> DataFrame:
    """(src, dst): names of screens, by navigation from a function or file of one to another."""
    s = list_screens(g, repository)
    fns = g.node("FunctionDefinition").select(F.col("id").alias("_at"), F.col("sourceFileId").alias("file_id"))
    files = g.node("SourceFile").select(F.col("id").alias("_at"), F.col("id").alias("file_id"))
    at = fns.unionAll(files)
    nav = _edge(g, "NAVIGATES_TO").withColumnRenamed("src", "_at")
    target = g.node("Screen").select(F.col("id").alias("dst"), F.col("name").alias("_to"))
    return nav.join(at, "_at").join(s.select("file_id", F.col("screen").alias("_from")), "file_id").join(target, "dst").select(F.col("_from").alias("src"), F.col("_to").alias("dst")).distinct()


def navigation_graph(g: Graph, repository: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The screen edges, or a shortest path between two screens."""
    e = screen_edges(g, repository)
    if start is None or end is None:
        return e if start is None and end is None else e.where((F.col("src") == start) if start is not None else (F.col("dst") == end))
    root = g.spark.createDataFrame([(start, start)], "root string, node string")
    return walk.shortest_paths(root, e).where(F.col("node") == end).select("depth", "path")


def without_evidence(df: DataFrame) -> DataFrame:
    return df.drop("evidence", "snippet")


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON without null fields."""
    cols: list[Column] = [F.col(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("json"))
