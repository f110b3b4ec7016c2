"""Traversal of the graph: reachability, paths, flows, hops between services.

All walks start from all roots at once. A step is a join of the frontier with the edges,
an anti-join against what was visited and a ``distinct``; lineage is cut with
``checkpoint`` into the session's shared folder, so a lost executor costs no more than the
step at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.keeping import keep

MAX_DEPTH = 10
MAX_HOPS = 5


def reach(roots: DataFrame, calls: DataFrame, max_depth: int | None = MAX_DEPTH) -> DataFrame:
    """(root, node, depth): all nodes within ``max_depth`` calls of each root, the root itself at 0; cycles end.

    ``roots``: (root, node). ``calls``: (src, dst). Without a depth the walk ends when nothing is new.
    """
    calls = keep(calls.select("src", "dst").distinct())  # read at every step
    frontier = keep(roots.select("root", "node").distinct().withColumn("depth", F.lit(0)))
    found, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(calls, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = keep(step.join(found, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)  # every part is a checkpoint already
    return found


def shortest_paths(roots: DataFrame, calls: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth, path): a shortest path to every node reached; of several, the least by its nodes. Without a depth the walk ends when nothing is new."""
    calls = keep(calls.select("src", "dst").distinct())  # read at every step
    frontier = keep(roots.select("root", "node").distinct().withColumns({"depth": F.lit(0), "path": F.array("node")}))
    found, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(calls, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        fresh = step.join(found.select("root", "node"), ["root", "node"], "left_anti").groupBy("root", "node").agg(F.min("path").alias("path"))
        frontier = keep(fresh.select("root", "node", F.lit(depth).alias("depth"), "path"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


COMPLETENESS = ("process-only", "function-only", "caller-only", "endpoint-only", "handler-only", "complete")


def completeness(process_fn: str = "function_id", caller: str = "caller_id", endpoint: str = "endpoint_id", handler: str = "handler_id", has_db: str = "has_db"):
    """How far a flow got, from what its row has."""
    c = F.col
    return (
        F.when(c(process_fn).isNull(), "process-only")
        .when(c(caller).isNull(), "function-only")
        .when(c(endpoint).isNull(), "caller-only")
        .when(c(handler).isNull(), "endpoint-only")
        .when(~F.coalesce(c(has_db), F.lit(False)), "handler-only")
        .otherwise("complete")
    )


def root_functions(processes: DataFrame, triggers: DataFrame) -> DataFrame:
    """(process_id, function_id): the first function a process triggers, else its own."""
    first = triggers.groupBy(F.col("src").alias("process_id")).agg(F.min_by("dst", F.struct("ord", "dst")).alias("_t"))
    return processes.join(first, "process_id", "left").withColumn("function_id", F.coalesce("_t", "function_id")).drop("_t")


def flows(processes: DataFrame, triggers: DataFrame, calls: DataFrame, callers: DataFrame, resolves: DataFrame, endpoints: DataFrame, interactions: DataFrame, functions: DataFrame | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """A row for each flow: process, function, caller, endpoint, handler, completeness.

    processes (process_id, function_id), triggers (src, dst, ord), calls (src, dst), callers (caller_id,
    function_id), resolves (caller_id, endpoint_id), endpoints (endpoint_id, handler_id), interactions
    (function_id, interaction_id). ``functions`` (function_id): where given, a root that isn't in it counts as absent.
    """
    roots = root_functions(processes, triggers).select("process_id", "function_id")
    if functions is not None:
        known = functions.select(F.col("function_id").alias("_f"))
        roots = roots.join(known, F.col("function_id") == F.col("_f"), "left").withColumn("function_id", F.col("_f")).drop("_f")
    client = reach(roots.where("function_id IS NOT NULL").select(F.col("process_id").alias("root"), F.col("function_id").alias("node")), calls, max_depth)
    called = client.join(callers.select("caller_id", F.col("function_id").alias("node")), "node").select(F.col("root").alias("process_id"), "caller_id").distinct()
    handlers = endpoints.where("handler_id IS NOT NULL").select("handler_id").distinct()
    server = reach(handlers.select(F.col("handler_id").alias("root"), F.col("handler_id").alias("node")), calls, max_depth)
    with_db = server.join(interactions.select(F.col("function_id").alias("node")).distinct(), "node").select(F.col("root").alias("handler_id")).distinct().withColumn("has_db", F.lit(True))
    out = roots.join(called, "process_id", "left").join(resolves.select("caller_id", "endpoint_id"), "caller_id", "left")
    out = out.join(endpoints.select("endpoint_id", "handler_id"), "endpoint_id", "left").join(with_db, "handler_id", "left")
    return out.select("process_id", "function_id", "caller_id", "endpoint_id", "handler_id", F.coalesce("has_db", F.lit(False)).alias("has_db")).withColumn("completeness", completeness())


def database_hops(handlers: DataFrame, calls: DataFrame, interactions: DataFrame, accesses: DataFrame, max_depth: int | None = MAX_DEPTH) -> DataFrame:
    """(handler_id, interaction_id, operation, tables): what a handler's call graph does to tables.

    interactions (interaction_id, function_id, operation); accesses (interaction_id, table_id). One without a table stays, with none.
    """
    server = reach(handlers.select(F.col("handler_id").alias("root"), F.col("handler_id").alias("node")), calls, max_depth)
    hit = server.join(interactions, F.col("node") == F.col("function_id")).select(F.col("root").alias("handler_id"), "interaction_id", "operation").distinct()
    tables = accesses.groupBy("interaction_id").agg(F.array_sort(F.collect_set("table_id")).alias("tables"))
    return hit.join(tables, "interaction_id", "left").withColumn("tables", F.coalesce("tables", F.array().cast("array<string>")))


def service_hops(starts: DataFrame, endpoint_calls: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(flow_id, endpoint_id, depth, path): endpoints that a flow's endpoint calls in turn, no endpoint twice on a path.

    starts (flow_id, endpoint_id); endpoint_calls (src, dst): an endpoint's handler reaches a caller that resolves to dst.
    """
    hops = min(max_hops, MAX_HOPS) - 1
    now = starts.select("flow_id", "endpoint_id", F.lit(0).alias("depth"), F.array("endpoint_id").alias("path"))
    out = now.limit(0)
    for depth in range(1, hops + 1):
        step = now.join(endpoint_calls.distinct(), F.col("endpoint_id") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        now = keep(step.select("flow_id", F.col("dst").alias("endpoint_id"), F.lit(depth).alias("depth"), F.concat("path", F.array("dst")).alias("path")))
        if now.isEmpty():
            break
        out = out.unionByName(now)
    return out


def navigation_targets(reached: DataFrame, navigates: DataFrame) -> DataFrame:
    """(root, screen_id, methods): screens that a root's functions lead to; without a method it is ``navigate``."""
    joined = reached.join(navigates, F.col("node") == F.col("src"))
    return joined.groupBy("root", F.col("dst").alias("screen_id")).agg(F.array_sort(F.collect_set(F.coalesce("method", F.lit("navigate")))).alias("methods"))


def enclosing(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """As-of join: each call (call_id, file, line) with the function of its file that starts last at or before the line.

    One sort-merge pass: both sides are unioned by file and line, and the last function seen is carried forward.
    """
    f = functions.select("file", F.col("line").alias("line"), F.lit(0).alias("_side"), F.lit(None).cast("string").alias("call_id"), F.struct("line", F.col("function_id").cast("string").alias("function_id")).alias("_f"))
    c = calls.select("file", "line", F.lit(1).alias("_side"), F.col("call_id").cast("string").alias("call_id"), F.lit(None).cast(f.schema["_f"].dataType).alias("_f"))
    w = Window.partitionBy("file").orderBy("line", "_side", "_f.function_id").rowsBetween(Window.unboundedPreceding, 0)
    both = f.unionByName(c).withColumn("_last", F.last("_f", ignorenulls=True).over(w))
    return both.where("_side = 1").select("call_id", "file", "line", F.col("_last.function_id").alias("function_id"))


def importers(changed: DataFrame, imports: DataFrame) -> DataFrame:
    """(file): files that import a changed one and haven't changed themselves; one hop."""
    hit = imports.join(changed.select(F.col("file").alias("dst")), "dst").select(F.col("src").alias("file")).distinct()
    return hit.join(changed.select("file"), "file", "left_anti")


def hash_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repository, path, state): added, changed, removed or unchanged, by content hash."""
    o, n = old.select("repository", "path", F.col("hash").alias("_o")), new.select("repository", "path", F.col("hash").alias("_n"))
    state = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "changed").otherwise("unchanged")
    return o.join(n, ["repository", "path"], "full").select("repository", "path", state.alias("state"))


def refresh_plan(diff: DataFrame, cascade: DataFrame, total: int, most_files: int = 100, most_share: float = 0.3) -> str:
    """``incremental`` or ``full``: what the cascade of importers would cost decides."""
    n = diff.where("state IN ('added', 'changed')").count() + cascade.count()
    return "full" if n > most_files or total and n / total > most_share else "incremental"
