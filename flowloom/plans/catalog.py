"""Queries over the driver tables and the SQL that must give the same rows.

Each query runs a library operator on roles that the star-schema tables play (see
``sources.driver_tables``). The SQL states the same result independently of the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.functions import ids, strings, urls
from flowloom.graph import alias_moves, last_write_wins
from flowloom.operators import packed, stitch, walk
from flowloom.sources import driver_tables as T

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query and the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- store ------------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def node_scan_filter(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "customer").where(F.col("c_mktsegment").eqNullSafe("BUILDING") & F.col("c_nationkey").eqNullSafe(3)).select("c_custkey", "c_name")


@query("""SELECT node_type, n FROM (SELECT 'ClientSideProcess' node_type, count(*) n FROM customer UNION ALL SELECT 'ClientSideAPICaller', count(*) FROM orders
UNION ALL SELECT 'APIEndpoint', count(*) FROM supplier UNION ALL SELECT 'DatabaseTable', count(*) FROM part)""")
def node_count_by_type(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, name in (("ClientSideProcess", "customer"), ("ClientSideAPICaller", "orders"), ("APIEndpoint", "supplier"), ("DatabaseTable", "part")):
        one = T.read(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(t).alias("node_type"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT l_orderkey AS from_id, l_partkey AS to_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL")
def find_edges_by_type(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "lineitem").where("l_returnflag = 'N'")
    return e.groupBy(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1""")
def upsert_last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    return last_write_wins(T.read(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""SELECT c_custkey, 'ClientSideProcess:' || substring(sha1(c_name || chr(1) || c_nationkey::VARCHAR || chr(1) || coalesce(nullif(c_mktsegment, 'BUILDING'), chr(0))), 1, 16) AS id FROM customer""")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    part = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return T.read(spark, d, "customer").select("c_custkey", ids.node_id("ClientSideProcess", sourceFileId="c_name", sourceLine="c_nationkey", name=part).alias("id"))


@query("""SELECT 'CALLS_FUNCTION:' || substring(sha1('{"edgeType":"CALLS_FUNCTION","from":"' || l_orderkey || '","sourceLine":' || l_linenumber || ',"to":"' || l_suppkey || '"}'), 1, 16) AS id,
count(*) AS n FROM lineitem GROUP BY 1""")
def edge_content_dedupe(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "lineitem").select(F.lit("CALLS_FUNCTION").alias("edge_type"), F.col("l_orderkey").cast("string").alias("from_id"), F.col("l_suppkey").cast("string").alias("to_id"), F.col("l_linenumber").cast("int").alias("sourceLine"))
    return e.select(ids.edge_id(e.columns).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


@query("""SELECT n_name AS repository, count(*) FILTER (kind = 'p') AS processes, count(*) FILTER (kind = 'e') AS endpoints FROM
(SELECT c_nationkey k, 'p' kind FROM customer UNION ALL SELECT s_nationkey, 'e' FROM supplier) JOIN nation ON k = n_nationkey GROUP BY 1""")
def repo_conditional_agg(spark: SparkSession, d: str) -> DataFrame:
    rows = T.read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("p").alias("kind")).unionAll(T.read(spark, d, "supplier").select("s_nationkey", F.lit("e")))
    counts = rows.groupBy("k").agg(F.count_if(F.col("kind") == "p").alias("processes"), F.count_if(F.col("kind") == "e").alias("endpoints"))
    return counts.join(T.read(spark, d, "nation"), F.col("k") == F.col("n_nationkey")).select(F.col("n_name").alias("repository"), "processes", "endpoints")


@query("""SELECT n_name AS repository, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS processes, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS endpoints,
(SELECT count(*) FROM part) AS tables FROM nation""")
def repo_stats(spark: SparkSession, d: str) -> DataFrame:
    n = T.read(spark, d, "nation")
    p = T.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("p"))
    e = T.read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("e"))
    t = T.read(spark, d, "part").agg(F.count("*").alias("tables"))
    zero = F.lit(0).cast("bigint")
    return n.join(p, "n_nationkey", "left").join(e, "n_nationkey", "left").crossJoin(F.broadcast(t)).select(F.col("n_name").alias("repository"), F.coalesce("p", zero).alias("processes"), F.coalesce("e", zero).alias("endpoints"), "tables")


_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '')"


@query(f"""SELECT split_part(ltrim({_PATH}, '/'), '/', 1) AS domain, count(*) AS pages, count(DISTINCT {_PATH}) AS paths FROM pages GROUP BY 1""")
def architecture_domains(spark: SparkSession, d: str) -> DataFrame:
    first = F.coalesce(F.try_element_at(urls.path_segments(F.col("path")), F.lit(1)), F.lit(""))
    return T.page_paths(spark, d).groupBy(first.alias("domain")).agg(F.count("*").alias("pages"), F.countDistinct("path").alias("paths"))


@query(f"""SELECT split_part(ltrim({_PATH}, '/'), '/', 1) AS segment, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) >= 2""")
def first_segment_histogram(spark: SparkSession, d: str) -> DataFrame:
    first = F.coalesce(F.try_element_at(urls.path_segments(F.col("path")), F.lit(1)), F.lit(""))
    return T.page_paths(spark, d).groupBy(first.alias("segment")).agg(F.count("*").alias("n")).where("n >= 2")


@query("""SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1 HAVING host LIKE '%.%' AND NOT host LIKE '%.local'
AND NOT host LIKE '10.%' AND NOT host LIKE '192.168.%' AND NOT host LIKE '172.%' AND NOT host LIKE '169.254.%'""")
def external_hosts(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "pages").select(urls.external_host(F.col("url")).alias("host")).where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"))


@query(f"""SELECT page_id, len(string_split(trim({_PATH}, '/'), '/')) AS n_segments, {_PATH} LIKE '%/' AND {_PATH} <> '/' AS trailing,
replace(trim({_PATH}, '/'), '/', '|') AS segments FROM pages WHERE trim({_PATH}, '/') <> ''""")
def url_parse_segments(spark: SparkSession, d: str) -> DataFrame:
    s = urls.path_segments(F.col("path"))
    return T.page_paths(spark, d).where(F.size(s) > 0).select("page_id", F.size(s).cast("bigint").alias("n_segments"), urls.has_trailing_slash(F.col("path")).alias("trailing"), F.array_join(s, "|").alias("segments"))


# --- stitching ----------------------------------------------------------------------

#: Fixed routes: what the pages' paths are matched against.
ROUTES = ["/en/:id", "/de/:id", "/fr/:id", "/es/:id", "/:lang/:id", "/en/*", "/en/:id/:rest?", "/fr"]


def _page_callers(spark: SparkSession, d: str) -> DataFrame:
    return T.page_paths(spark, d).select(
        F.col("page_id").alias("caller_id"), F.when(F.col("page_id") % 5 != 0, F.lit("GET")).alias("method"), F.col("path").alias("url"),
        F.when(F.col("page_id") % 11 == 0, "dynamic").when(F.col("page_id") % 7 == 0, "pattern").otherwise("exact").alias("egress"), F.concat(F.lit("r"), F.col("page_id") % 3).alias("repository"),
    )


def _routes(spark: SparkSession) -> DataFrame:
    rows = [(f"e{i}", "POST" if i == 3 else "GET", r, f"r{i % 4}", i) for i, r in enumerate(ROUTES)]
    return spark.createDataFrame(rows, "endpoint_id string, method string, route string, repository string, ord long")


def _match_sql() -> str:
    """Matches of the fixed routes spelled out as regular expressions on the path."""
    full = {"/en/:id": "^/*en/[^/]+$", "/de/:id": "^/*de/[^/]+$", "/fr/:id": "^/*fr/[^/]+$", "/es/:id": "^/*es/[^/]+$", "/:lang/:id": "^/*[^/]+/[^/]+$", "/en/*": "^/*en(/.*[^/])?$", "/en/:id/:rest?": "^/*en/[^/]+(/[^/]+)?$", "/fr": "^/*fr$"}
    parts = []
    for i, r in enumerate(ROUTES):
        m = "POST" if i == 3 else "GET"
        ok = f"(method IS NULL OR method = '{m}')"
        rank = 5 if r == "/fr" else 4
        parts.append(f"SELECT caller_id, repository, 'e{i}' AS endpoint_id, 'r{i % 4}' AS e_repository, CASE WHEN egress = 'exact' THEN {rank} ELSE 2 END AS rank FROM c WHERE {ok} AND NOT trail AND regexp_matches(path, '{full[r]}')")
        # a prefix that ends in a slash fits unless it has exactly the route's segments: shorter ones leave room, longer ones are taken as well
        more = "[^/]+/[^/]+(/[^/]+)*/+$"
        room = {"/en/:id": f"^/*en(/+$|/{more})", "/de/:id": f"^/*de(/+$|/{more})", "/fr/:id": f"^/*fr(/+$|/{more})", "/es/:id": f"^/*es(/+$|/{more})", "/:lang/:id": f"^/*[^/]+(/+$|/{more})", "/en/*": "^/*en(/.*)?/+$", "/en/:id/:rest?": f"^/*en((/[^/]+)?/+$|/[^/]+/{more})", "/fr": "^/*fr(/[^/]+)+/+$"}[r]
        if room:
            parts.append(f"SELECT caller_id, repository, 'e{i}', 'r{i % 4}', 2 FROM c WHERE {ok} AND trail AND regexp_matches(path, '{room}')")
    c = f"""SELECT page_id AS caller_id, CASE WHEN page_id % 5 <> 0 THEN 'GET' END AS method, {_PATH} AS path, CASE WHEN page_id % 11 = 0 THEN 'dynamic' WHEN page_id % 7 = 0 THEN 'pattern' ELSE 'exact' END AS egress,
'r' || (page_id % 3) AS repository, {_PATH} LIKE '%/' AND trim({_PATH}, '/') <> '' AS trail FROM pages"""
    return f"WITH c AS (SELECT * FROM ({c}) WHERE egress <> 'dynamic'), m AS ({' UNION ALL '.join(parts)})"


@query(_match_sql() + " SELECT caller_id, endpoint_id, rank FROM m")
def route_match_rank(spark: SparkSession, d: str) -> DataFrame:
    return stitch.match(_page_callers(spark, d), _routes(spark)).select("caller_id", "endpoint_id", "rank")


_TOP = ", t AS (SELECT *, max(rank) OVER (PARTITION BY caller_id) best FROM m), e AS (SELECT *, count(*) OVER (PARTITION BY caller_id) n FROM t WHERE rank = best)"


@query(_match_sql() + _TOP + """ SELECT caller_id, endpoint_id, CASE WHEN n > 1 THEN 'inferred' WHEN rank = 5 THEN 'exact-url' ELSE 'pattern' END AS matched_by,
CASE WHEN n > 1 THEN 'low' WHEN rank >= 4 THEN 'high' ELSE 'medium' END AS confidence FROM e""")
def stitch_top_rank_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    return stitch.stitch(_page_callers(spark, d), _routes(spark)).select("caller_id", "endpoint_id", "matched_by", "confidence")


@query(_match_sql() + ", a(application, repository) AS (VALUES ('x', 'r0'), ('x', 'r1'), ('y', 'r1'), ('y', 'r2')) SELECT caller_id, endpoint_id, rank FROM m WHERE repository NOT IN (SELECT repository FROM a) OR e_repository NOT IN (SELECT repository FROM a) OR EXISTS (SELECT 1 FROM a x JOIN a y USING (application) WHERE x.repository = m.repository AND y.repository = m.e_repository)")
def stitch_scope_filter(spark: SparkSession, d: str) -> DataFrame:
    apps = spark.createDataFrame([("x", "r0"), ("x", "r1"), ("y", "r1"), ("y", "r2")], "application string, repository string")
    return stitch.application_scope(apps, stitch.match(_page_callers(spark, d), _routes(spark))).select("caller_id", "endpoint_id", "rank")


@query(f"""SELECT page_id AS caller_id, 'p' AS endpoint_id FROM pages WHERE regexp_matches({_PATH}, '^/en/[^/]+$') OR regexp_matches({_PATH}, '^/[^/]+(/[^/]+)+/+$')""")
def proxy_rewrite_match(spark: SparkSession, d: str) -> DataFrame:
    calls = T.page_paths(spark, d).select(F.col("page_id").alias("caller_id"), F.lit("GET").alias("method"), F.col("path").alias("url"), F.lit("exact").alias("egress"))
    target = spark.createDataFrame([("p", "GET", "/:id")], "endpoint_id string, method string, route string")
    return stitch.match(calls, target, [("/e", True), ("/de", False), ("/en", True)]).select("caller_id", "endpoint_id")


@query(_match_sql() + _TOP + """, b AS (SELECT caller_id, max(n) n, max(rank) r FROM e GROUP BY 1) SELECT CASE WHEN b.n IS NULL THEN 'unmatched' WHEN b.n > 1 THEN 'ambiguous' WHEN r >= 4 THEN 'deterministic' ELSE 'heuristic' END AS tier,
count(*) AS n FROM pages p LEFT JOIN b ON p.page_id = b.caller_id GROUP BY 1""")
def stitch_tiers(spark: SparkSession, d: str) -> DataFrame:
    return stitch.tiers(_page_callers(spark, d), _routes(spark)).groupBy("tier").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT p.page_id, x.prefix FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/[^/?#]+/?(?:[?#].*)?$', 1) seg FROM pages) p, LATERAL (SELECT '/' || seg AS prefix) x WHERE seg <> '')
SELECT 'web' AS from_repository, 'api' AS to_repository, prefix, fixes FROM (SELECT prefix, count(DISTINCT page_id) AS fixes FROM f GROUP BY 1 HAVING count(DISTINCT page_id) >= 3 ORDER BY fixes DESC, length(prefix), prefix LIMIT 1)""")
def prefix_mining(spark: SparkSession, d: str) -> DataFrame:
    calls = T.page_paths(spark, d).select(F.col("page_id").alias("caller_id"), F.col("path").alias("url"), F.lit("web").alias("repository"))
    target = spark.createDataFrame([("api", "/{id}")], "repository string, route string")
    return stitch.mine_prefixes(calls, target)


@query("""WITH hit AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 40)
SELECT CASE WHEN l_orderkey IS NOT NULL THEN 'stitched' WHEN o_orderpriority = '1-URGENT' THEN 'external' WHEN o_orderstatus = 'P' THEN 'dynamic' ELSE 'unresolved' END AS state, count(*) AS n
FROM orders LEFT JOIN hit ON o_orderkey = l_orderkey GROUP BY 1""")
def stitch_report_partition(spark: SparkSession, d: str) -> DataFrame:
    c = T.callers(spark, d).select("caller_id", (F.col("o_orderpriority") == "1-URGENT").alias("is_external"), F.lit("/x").alias("url"), F.when(F.col("o_orderstatus") == "P", "dynamic").otherwise("exact").alias("egress"))
    return stitch.report(c, T.resolves(spark, d)).groupBy("state").agg(F.count("*").alias("n"))


# --- walks --------------------------------------------------------------------------

_CALLS = """e AS (SELECT DISTINCT 'u' || (user_id % 25) || event_type AS src, 'u' || ((user_id * 3 + 1) % 25) || nxt AS dst FROM
(SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) nxt FROM events) WHERE nxt IS NOT NULL)"""


@query("""WITH RECURSIVE c AS (SELECT p_partkey src, (p_partkey * 7) % (SELECT count(*) FROM part) + 1 dst FROM part),
w(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM w JOIN c ON node = src WHERE depth < 10) SELECT node, min(depth) AS depth FROM w GROUP BY 1""")
def bfs_reach_depth10(spark: SparkSession, d: str) -> DataFrame:
    root = spark.range(1).select(F.lit("r").alias("root"), F.lit(1).cast("bigint").alias("node"))
    return walk.reach(root, T.part_calls(spark, d)).select("node", "depth")


@query(f"""WITH RECURSIVE {_CALLS}, w(node, depth) AS (SELECT 'u1click', 0 UNION SELECT dst, depth + 1 FROM w JOIN e ON node = src WHERE depth < 32) SELECT node, min(depth) AS depth FROM w GROUP BY 1""")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    root = spark.range(1).select(F.lit("r").alias("root"), F.lit("u1click").alias("node"))
    return walk.shortest_paths(root, T.call_graph(spark, d)).select("node", "depth")


_FLOWS = """r AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity >= 40),
f AS (SELECT c_custkey process_id, o_orderkey caller_id, l_suppkey endpoint_id, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END handler_id FROM customer
LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN r ON l_orderkey = o_orderkey)"""
_LADDER = "CASE WHEN caller_id IS NULL THEN 'function-only' WHEN endpoint_id IS NULL THEN 'caller-only' WHEN handler_id IS NULL THEN 'endpoint-only' WHEN handler_id IN (SELECT l_suppkey FROM r) THEN 'complete' ELSE 'handler-only' END"


def _flows(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "src bigint, dst bigint, ord bigint")
    return walk.flows(T.processes(spark, d), none, none, T.callers(spark, d), T.resolves(spark, d), T.endpoints(spark, d), T.interactions(spark, d))


@query(f"WITH {_FLOWS} SELECT {_LADDER} AS completeness, count(*) AS n FROM f GROUP BY 1")
def flow_completeness(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d).groupBy("completeness").agg(F.count("*").alias("n"))


@query("""SELECT l_suppkey AS handler_id, CASE l_returnflag WHEN 'N' THEN 'read' WHEN 'A' THEN 'update' ELSE 'write' END AS operation, count(DISTINCT (l_orderkey, l_linenumber, l_partkey)) AS interactions, count(DISTINCT l_partkey) AS tables
FROM lineitem WHERE l_quantity >= 40 AND l_suppkey % 7 <> 0 GROUP BY ALL""")
def flow_db_hops(spark: SparkSession, d: str) -> DataFrame:
    i = T.interactions(spark, d)
    none = spark.createDataFrame([], "src bigint, dst bigint")
    hops = walk.database_hops(T.endpoints(spark, d).where("handler_id IS NOT NULL").select("handler_id"), none, i.drop("table_id"), i.select("interaction_id", F.col("table_id").cast("string").alias("table_id")))
    return hops.select("handler_id", "operation", "interaction_id", F.explode("tables").alias("t")).groupBy("handler_id", "operation").agg(F.countDistinct("interaction_id").alias("interactions"), F.countDistinct("t").alias("tables"))


_EP = "c AS (SELECT DISTINCT s_suppkey src, (s_suppkey * k) % (SELECT count(*) FROM supplier) + 1 dst FROM supplier, (VALUES (3), (5)) v(k))"


@query(f"""WITH {_EP} SELECT flow_id, depth, endpoint_id, count(*) AS paths FROM (SELECT a.src flow_id, 1 AS depth, a.dst endpoint_id FROM c a WHERE a.dst <> a.src
UNION ALL SELECT a.src, 2, b.dst FROM c a JOIN c b ON a.dst = b.src WHERE a.dst <> a.src AND b.dst <> a.src AND b.dst <> a.dst) GROUP BY ALL""")
def service_hops_2(spark: SparkSession, d: str) -> DataFrame:
    s = T.read(spark, d, "supplier")
    n = s.agg(F.count("*").alias("n"))
    calls = s.crossJoin(F.broadcast(n)).select(F.col("s_suppkey").alias("src"), F.explode(F.array(*[(F.col("s_suppkey") * k) % F.col("n") + 1 for k in (3, 5)])).alias("dst"))
    starts = s.select(F.col("s_suppkey").alias("flow_id"), F.col("s_suppkey").alias("endpoint_id"))
    return walk.service_hops(starts, calls, 3).groupBy("flow_id", "depth", "endpoint_id").agg(F.count("*").alias("paths"))


@query(f"""WITH {_FLOWS} SELECT l_partkey AS table_id, count(DISTINCT (process_id, caller_id, endpoint_id)) AS flows, count(DISTINCT process_id) AS processes, count(DISTINCT endpoint_id) AS endpoints
FROM f JOIN lineitem ON handler_id = l_suppkey AND l_quantity >= 40 WHERE {_LADDER} = 'complete' GROUP BY 1""")
def impact_by_table(spark: SparkSession, d: str) -> DataFrame:
    touched = T.interactions(spark, d).select(F.col("function_id").alias("handler_id"), "table_id").distinct()
    return packed.impact(_flows(spark, d).where("completeness = 'complete'"), touched)


@query(f"""WITH {_FLOWS} SELECT endpoint_id, count(*) AS flows, count(DISTINCT process_id) AS processes, count(DISTINCT caller_id) AS callers FROM f WHERE {_LADDER} = 'complete' GROUP BY 1""")
def impact_by_endpoint(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d).where("completeness = 'complete'").groupBy("endpoint_id").agg(F.count("*").alias("flows"), F.countDistinct("process_id").alias("processes"), F.countDistinct("caller_id").alias("callers"))


@query(f"""WITH {_FLOWS} SELECT process_id, caller_id, endpoint_id FROM f WHERE process_id % 50 = 0 OR coalesce(endpoint_id % 20 = 0, false)""")
def diff_flows(spark: SparkSession, d: str) -> DataFrame:
    changed = T.read(spark, d, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("p"), "c_custkey").alias("file")).unionAll(T.read(spark, d, "supplier").where("s_suppkey % 20 = 0").select(F.concat(F.lit("e"), "s_suppkey")))
    f = _flows(spark, d)
    touched = f.withColumn("file", F.explode(F.array_compact(F.array(F.concat(F.lit("p"), "process_id"), F.concat(F.lit("e"), "endpoint_id"))))).join(changed, "file", "left_semi")
    return touched.select("process_id", "caller_id", "endpoint_id").distinct()


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 1)")
def uncalled_endpoints(spark: SparkSession, d: str) -> DataFrame:
    called = T.read(spark, d, "lineitem").where("l_quantity = 50 AND l_linenumber = 1")
    s = T.read(spark, d, "supplier")
    return s.join(called, s["s_suppkey"] == called["l_suppkey"], "left_anti").select("s_suppkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 40)")
def orphan_tables(spark: SparkSession, d: str) -> DataFrame:
    p, used = T.read(spark, d, "part"), T.interactions(spark, d)
    return p.join(used, p["p_partkey"] == used["table_id"], "left_anti").select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 40)")
def unmatched_callers(spark: SparkSession, d: str) -> DataFrame:
    c = T.callers(spark, d).where("o_orderpriority <> '1-URGENT'")
    return c.join(T.resolves(spark, d), "caller_id", "left_anti").select(F.col("caller_id").alias("o_orderkey"))


_HREF = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) href FROM pages"


def _hrefs(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query(f"""WITH h AS ({_HREF}) SELECT DISTINCT rtrim({_PATH}, '/') || '/' AS path FROM pages WHERE rtrim({_PATH}, '/') || '/' NOT IN (SELECT rtrim(href, '/') || '/' FROM h WHERE href LIKE '/%')""")
def unreachable_screens(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.regexp_replace("path", "/+$", ""), F.lit("/")).alias("path")
    linked = _hrefs(spark, d).select(urls.normal_href(F.col("href")).alias("path")).where("path IS NOT NULL")
    return T.page_paths(spark, d).select(path).distinct().join(linked, "path", "left_anti")


@query("""WITH t AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity >= 40) SELECT a.l_suppkey AS screen, count(DISTINCT b.l_suppkey) AS others, count(DISTINCT a.l_partkey) AS tables
FROM t a LEFT JOIN t b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1""")
def screen_impact(spark: SparkSession, d: str) -> DataFrame:
    t = T.interactions(spark, d).select(F.col("function_id").alias("screen"), "table_id").distinct()
    other = t.select(F.col("screen").alias("o"), "table_id")
    joined = t.join(other, "table_id")
    return joined.groupBy("screen").agg(F.countDistinct(F.when(F.col("o") != F.col("screen"), F.col("o"))).alias("others"), F.countDistinct("table_id").alias("tables"))


@query(f"""WITH h AS ({_HREF}) SELECT page_id, count(DISTINCT href) AS links FROM h WHERE href LIKE '/%' GROUP BY 1""")
def navigation_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return _hrefs(spark, d).where(urls.normal_href(F.col("href")).isNotNull()).groupBy("page_id").agg(F.countDistinct("href").alias("links"))


# --- scalars and maintenance ----------------------------------------------------------

#: Fixed: names that are tried with every category.
_NAMES = ("DATABASE_URL", "db_host", "JWT_SECRET", "API_KEY", "api_base", "STRIPE_ID", "PORT", "LOG_LEVEL", "APP_X", "HOME", "tokenize", "Redis")


@query("""SELECT event_id, name, CASE WHEN regexp_matches(upper(name), '^(DATABASE|DB|MONGO|MYSQL|POSTGRES|PG|REDIS|SQLITE|CASSANDRA|DYNAMO)') THEN 'database'
WHEN regexp_matches(upper(name), '^(JWT|AUTH|OAUTH|SESSION|SECRET|TOKEN|PASSWORD|CREDENTIALS|API_KEY|PRIVATE_KEY)') THEN 'auth' WHEN regexp_matches(upper(name), '^(API_|OPENAI|STRIPE|TWILIO|SENDGRID|FIREBASE|AWS|GCP|AZURE|WEBHOOK)') THEN 'api'
WHEN regexp_matches(upper(name), '^(PORT|HOST|NODE_ENV|LOG|DEBUG|CORS|RATE_LIMIT|TIMEOUT|BASE_URL|APP_)') THEN 'config' ELSE 'unknown' END AS category
FROM (SELECT event_id, ([""" + ", ".join(f"'{n}'" for n in _NAMES) + "])[1 + event_id % 12] AS name FROM events)")
def env_var_category(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (1 + F.col("event_id") % len(_NAMES)).cast("int"))
    e = T.read(spark, d, "events").select("event_id", name.alias("name"))
    return e.select("event_id", "name", strings.env_category(F.col("name")).alias("category"))


@query("SELECT event_type AS name, count(DISTINCT user_id) AS endpoints, count(*) AS uses, min(event_id) AS first_use FROM events GROUP BY 1")
def middleware_groups(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events").select("user_id", F.explode(F.array(F.struct(F.col("event_type").alias("name"), F.col("event_id").alias("order")))).alias("m"))
    return e.groupBy(F.col("m.name").alias("name")).agg(F.countDistinct("user_id").alias("endpoints"), F.count("*").alias("uses"), F.min("m.order").alias("first_use"))


@query("""WITH a AS (SELECT p_partkey, p_name FROM part), k AS (SELECT 'table_' || (p_partkey % 90) || 's' AS name, min(p_partkey) id FROM a GROUP BY 1),
i AS (SELECT 1000000 + p_partkey AS old_id, 'table' || chr(95) || (p_partkey % 110) AS name FROM a) SELECT old_id::VARCHAR AS old_id, id::VARCHAR AS new_id FROM i JOIN k ON k.name = i.name || 's'""")
def alias_merge(spark: SparkSession, d: str) -> DataFrame:
    a = T.read(spark, d, "part")
    known = a.groupBy(F.concat(F.lit("table_"), F.col("p_partkey") % 90, F.lit("s")).alias("name")).agg(F.min("p_partkey").cast("string").alias("id"))
    known = known.select("id", "name", F.lit("f").alias("declaredIn"), F.col("id").cast("bigint").alias("_ord"))
    guess = a.select((F.col("p_partkey") + 1000000).cast("string").alias("id"), F.concat(F.lit("table_"), F.col("p_partkey") % 110).alias("name"), F.lit(None).cast("string").alias("declaredIn"), F.lit(0).cast("bigint").alias("_ord"))
    return alias_moves(known.unionByName(guess).withColumn("systemId", F.lit("s")))


@query("SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def prune_empty_systems(spark: SparkSession, d: str) -> DataFrame:
    n, s = T.read(spark, d, "nation"), T.read(spark, d, "supplier").where("s_acctbal > 5000")
    return n.join(s, n["n_nationkey"] == s["s_nationkey"], "left_anti").select("n_name")


@query("""WITH v AS (SELECT c_custkey id FROM customer WHERE c_nationkey = 7) SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT id FROM v)) AS edges""")
def cascade_delete_counts(spark: SparkSession, d: str) -> DataFrame:
    v = T.read(spark, d, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("id"))
    e = T.read(spark, d, "orders").join(v, F.col("o_custkey") == F.col("id"), "left_semi")
    return v.agg(F.count("*").alias("nodes")).crossJoin(e.agg(F.count("*").alias("edges")))


@query("""WITH o AS (SELECT doc_id, sha256(text) h FROM documents WHERE doc_id % 13 <> 0), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) h FROM documents WHERE doc_id % 11 <> 0)
SELECT state, count(*) AS n FROM (SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS state FROM o FULL JOIN n USING (doc_id)) GROUP BY 1""")
def hash_diff_incremental(spark: SparkSession, d: str) -> DataFrame:
    docs = T.read(spark, d, "documents")
    old = docs.where("doc_id % 13 <> 0").select(F.lit("r").alias("repository"), F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    new = docs.where("doc_id % 11 <> 0").select(F.lit("r").alias("repository"), F.col("doc_id").alias("path"), F.sha2(text, 256).alias("hash"))
    return walk.hash_diff(old, new).groupBy("state").agg(F.count("*").alias("n"))


@query(f"WITH {_CALLS} SELECT DISTINCT src AS file FROM e WHERE dst LIKE '%click' AND src NOT LIKE '%click'")
def importer_invalidation(spark: SparkSession, d: str) -> DataFrame:
    e = T.call_graph(spark, d)
    nodes = e.select(F.col("src").alias("file")).unionAll(e.select("dst")).distinct()
    return walk.importers(nodes.where(F.col("file").endswith("click")), e)


@query("""SELECT e.event_id::VARCHAR AS call_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = e.user_id AND b.event_type = 'view' AND b.event_id <= e.event_id)::VARCHAR AS function_id FROM events e WHERE e.event_type = 'click'""")
def asof_enclosing_function(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events").withColumn("file", F.col("user_id").cast("string"))
    calls = e.where("event_type = 'click'").select(F.col("event_id").alias("call_id"), "file", F.col("event_id").alias("line"))
    fns = e.where("event_type = 'view'").select(F.col("event_id").alias("function_id"), "file", F.col("event_id").alias("line"))
    return walk.enclosing(calls, fns).select("call_id", "function_id")


#: Fixed: statements around a table name.
_SQL = ("SELECT a FROM {}", "insert into db.{} values (1)", "UPDATE {} SET a = 1", "/* from x */ delete from {}", "select 1 -- from y", "INSERT INTO {} SELECT * FROM z", "select 1 from db.schema.{}")


@query("""SELECT n_nationkey, i, CASE WHEN i = 4 THEN NULL ELSE 't' || n_nationkey END AS "table", (['read', 'insert', 'update', 'delete', NULL, 'insert', 'read'])[i + 1] AS operation FROM nation, range(7) x(i)""")
def sql_table_op(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("t"), "n_nationkey")
    made = F.array(*[F.replace(F.lit(s), F.lit("{}"), name) for s in _SQL])
    n = T.read(spark, d, "nation").select("n_nationkey", F.posexplode(made).alias("i", "sql"))
    return n.select("n_nationkey", F.col("i").cast("bigint").alias("i"), strings.sql_table_op(F.col("sql")).alias("x")).select("n_nationkey", "i", "x.*")


@query("""SELECT doc_id, path, regexp_matches(lower(name), '(\\.min|-min|-vendor|\\.umd)\\.m?js$') OR (regexp_matches(lower(name), '\\.m?js$') AND ((lower(name) IN ('jquery.js', 'moment.js') AND size >= 51200)
OR (size >= 102400 AND length(head) > 0 AND (NOT contains(head, chr(10)) OR length(head) > 200 * (length(head) - length(replace(head, chr(10), '')))))))  AS vendored
FROM (SELECT doc_id, source || '/' || name AS path, name, size, head FROM (SELECT doc_id, source, (['a.min.js', 'b-Vendor.MJS', 'x.ts', 'jquery.js', 'jquery-3.js', 'moment.JS', 'c-min.js', 'd.bundle.js'])[1 + doc_id % 8] AS name,
n_chars * 16 AS size, substring(text, 1, 4096) AS head FROM documents))""")
def vendored_sniff(spark: SparkSession, d: str) -> DataFrame:
    names = ("a.min.js", "b-Vendor.MJS", "x.ts", "jquery.js", "jquery-3.js", "moment.JS", "c-min.js", "d.bundle.js")
    name = F.element_at(F.array(*map(F.lit, names)), (1 + F.col("doc_id") % 8).cast("int"))
    path = F.concat("source", F.lit("/"), name)
    docs = T.read(spark, d, "documents").select("doc_id", path.alias("path"), "n_chars", "text")
    return docs.select("doc_id", "path", strings.looks_vendored(F.col("path"), F.col("n_chars") * 16, F.col("text")).alias("vendored"))


@query(f"""WITH h AS ({_HREF}) SELECT rtrim(href, '/') || '/' AS path, count(*) AS n FROM h WHERE href LIKE '/%' AND NOT href LIKE '//%' GROUP BY 1""")
def href_normalise(spark: SparkSession, d: str) -> DataFrame:
    return _hrefs(spark, d).select(urls.normal_href(F.col("href")).alias("path")).where("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, i AS line_no, string_split(text, chr(10))[i] AS line FROM documents, range(1, 200) r(i) WHERE i <= len(string_split(text, chr(10))) AND i BETWEEN 2 AND 5""")
def line_window(spark: SparkSession, d: str) -> DataFrame:
    docs = T.read(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"), "line").where("line_no BETWEEN 2 AND 5")


@query("SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_size > 10) AS total FROM part WHERE p_size > 10 ORDER BY p_partkey LIMIT 20 OFFSET 40")
def page_limit_offset(spark: SparkSession, d: str) -> DataFrame:
    p = T.read(spark, d, "part").where("p_size > 10")
    return p.orderBy("p_partkey").offset(40).limit(20).select("p_partkey", "p_name").crossJoin(p.agg(F.count("*").alias("total")))


@query(f"""WITH {_FLOWS}, t AS (SELECT l_suppkey, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS tables FROM lineitem WHERE l_quantity >= 40 GROUP BY 1)
SELECT process_id, string_agg(x, ' ' ORDER BY x) AS flows, count(*) AS n FROM (SELECT process_id, coalesce(caller_id::VARCHAR, '-') || ':' || coalesce(endpoint_id::VARCHAR, '-') || ':' || {_LADDER} || ':' || coalesce(tables, '-') AS x
FROM f LEFT JOIN t ON handler_id = l_suppkey) GROUP BY 1""")
def nested_flow_struct(spark: SparkSession, d: str) -> DataFrame:
    """Flows as nested records, as text: a process with its callers, endpoints and the tables behind these."""
    name = F.col("table_id").cast("string")
    touched = T.interactions(spark, d).groupBy(F.col("function_id").alias("handler_id")).agg(F.nullif(F.array_join(F.array_sort(F.collect_set(name)), ","), F.lit("")).alias("text"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    head = F.concat_ws(":", text("caller_id"), text("endpoint_id"), "completeness", F.lit(""))
    return packed.nested(_flows(spark, d).select("process_id", head.alias("head"), "handler_id"), touched)


@query("""SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, cycle""")
def session_debounce(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user that come within an hour of each other are one cycle."""
    e = T.read(spark, d, "events")
    s = e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


@query()
def streaming_hash_diff(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a stream of files: each micro-batch's hashes against what is known."""
    from flowloom.streaming import watch

    return watch.hash_stream_once(spark, f"{d}/documents.parquet")
