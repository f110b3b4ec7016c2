"""Stitching: callers of HTTP endpoints joined to the routes that their URLs match.

The join is blocked so that Spark plans a hash join, never a nested loop: an endpoint is
filed under its method and under "any method", and under its first segment if that is a
literal, else under a wildcard; a caller looks under its own method (or "any") and under
both its first segment and the wildcard. The match itself is one closed-form expression
over the segment arrays. Ranks are windows over a caller's matches only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions import urls

ANY = "\0any"
WILD = "\0wild"

CALLER = ("caller_id", "method", "url", "egress", "template_parts", "span_count", "segment_count", "repository")
ENDPOINT = ("endpoint_id", "method", "route", "repository", "ord")


def _with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in defaults.items() if c not in df.columns})


def caller_frame(df: DataFrame) -> DataFrame:
    return _with_defaults(df, {"template_parts": "array<string>", "span_count": "int", "segment_count": "int", "repository": "string"}).select(*CALLER)


def endpoint_frame(df: DataFrame) -> DataFrame:
    df = _with_defaults(df, {"repository": "string"})
    return (df if "ord" in df.columns else df.withColumn("ord", F.lit(0).cast("bigint"))).select(*ENDPOINT)


def _filed(endpoints: DataFrame) -> DataFrame:
    """Endpoints under each (method key, segment key)."""
    segments = urls.path_segments(F.col("route"))
    first = F.try_element_at(segments, F.lit(1))
    literal = first.isNotNull() & (first != "*") & ~urls.is_param(first)
    return (
        endpoints.withColumns({"p": segments, "seg_key": F.when(literal, first).otherwise(WILD)})
        .withColumn("method_key", F.explode(F.array("method", F.lit(ANY))))
        .where(F.col("method_key").isNotNull())
        .select("endpoint_id", "ord", "route", "p", F.col("repository").alias("e_repository"), "method_key", "seg_key")
    )


def _looking(callers: DataFrame) -> DataFrame:
    url = urls.strip_leading_base(F.col("url"))
    c = callers.where(F.col("url").isNotNull() & (F.col("egress") != "dynamic"))
    c = c.withColumns({"c": urls.path_segments(urls.without_query(url)), "trailing": urls.has_trailing_slash(url), "method_key": F.coalesce("method", F.lit(ANY))})
    first = F.try_element_at("c", F.lit(1))
    return c.withColumn("seg_key", F.explode(F.array_distinct(F.array(F.coalesce(first, F.lit(WILD)), F.lit(WILD)))))


def match_rank(c: Column, p: Column, trailing: Column, exact: Column, span_count: Column, segment_count: Column) -> Column:
    """5 exact URL, 4 pattern, 2 plausible prefix, null no match: caller segments against a route's."""
    nc, np_ = F.size(c), F.size(p)
    splat = F.array_position(p, "*").cast("int") - 1  # -1: none
    has_splat = splat >= 0
    stop = F.when(has_splat, splat).otherwise(np_)  # the route's segments before any splat
    aligned = F.least(nc, stop)
    pairs = F.arrays_zip(F.slice(c, 1, aligned).alias("c"), F.slice(p, 1, aligned).alias("p"))
    line_up = F.forall(pairs, lambda x: F.when(urls.is_param(x["p"]), x["c"] != "").otherwise(x["p"] == x["c"]))
    any_param = F.exists(F.slice(p, 1, aligned), urls.is_param)
    ahead = F.slice(p, aligned + 1, F.greatest(stop - aligned, F.lit(0)))  # route left when the caller ran out
    stuck = F.exists(ahead, lambda x: ~urls.is_optional(x))
    skipped = (F.size(ahead) > 0) & urls.is_optional(F.try_element_at(ahead, F.lit(1)))
    splatted = has_splat & ~stuck
    caller_done = splatted | (nc <= aligned)
    route_done = ~stuck & F.when(splatted, splat + 1 >= np_).otherwise(True)
    after_splat = F.slice(p, splat + 2, F.greatest(np_ - splat - 1, F.lit(0)))
    rest_optional = F.when(splatted, F.forall(after_splat, urls.is_optional)).otherwise(True)
    full = exact & ~trailing
    expected = F.coalesce(segment_count, F.when(span_count > 0, nc + span_count))
    return (
        F.when(~line_up | (stuck & ~trailing), None)
        .when(full, F.when(caller_done & (route_done | rest_optional), F.when(~any_param & ~splatted, 5).otherwise(4)))
        .when(trailing & route_done & caller_done & ~splatted & ~skipped, None)
        .when(trailing, F.when(expected.isNull(), 2).when(np_ == expected, 4))
        .when(route_done & caller_done, 2)
    )


def matched_by(rank: Column) -> Column:
    return F.when(rank == 5, "exact-url").otherwise("pattern")


def confidence(rank: Column) -> Column:
    return F.when(rank >= 4, "high").when(rank == 2, "medium").otherwise("low")


def _slow(callers: DataFrame, endpoints: DataFrame) -> DataFrame:
    joined = _looking(callers).join(_filed(endpoints), ["method_key", "seg_key"])
    rank = match_rank(F.col("c"), F.col("p"), F.col("trailing"), F.col("egress") == "exact", F.col("span_count"), F.col("segment_count"))
    return joined.withColumn("rank", rank).where("rank IS NOT NULL").select("caller_id", "endpoint_id", "ord", "rank", "repository", "e_repository")


def _template(callers: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Callers with template parts: the URL rebuilt with a parameter for each gap, the first endpoint of as many segments that lines up."""
    parts = F.col("template_parts")
    rebuilt = F.array_join(F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.concat(x, F.lit(":p"), i.cast("string"))).otherwise(x)), "")
    path = F.regexp_replace(urls.strip_leading_base(urls.without_query(rebuilt)), "/+$", "")
    c = callers.where(F.col("url").isNotNull() & (F.col("egress") != "dynamic") & (F.size("template_parts") > 1)).withColumn("path", path).where("path != ''")

    def pieces(x: Column) -> Column:
        return F.split(F.regexp_replace(F.regexp_replace(x, "/+$", ""), "^/+", ""), "/", -1)

    c = c.withColumns({"c": pieces(F.col("path")), "method_key": F.coalesce("method", F.lit(ANY))}).withColumn("n", F.size("c"))
    e = _filed(endpoints).withColumn("p", pieces(F.col("route"))).withColumn("n", F.size("p"))
    fits = F.forall(F.arrays_zip("c", "p"), lambda x: urls.is_param(x["c"]) | urls.is_param(x["p"]) | (x["c"] == x["p"]))
    found = c.join(e, ["method_key", "n"]).where(fits)
    first = F.row_number().over(Window.partitionBy("caller_id").orderBy("ord", "endpoint_id"))
    return found.withColumn("_i", first).where("_i = 1").select("caller_id", "endpoint_id", "ord", F.lit(4).alias("rank"), "repository", "e_repository")


def match_direct(callers: DataFrame, endpoints: DataFrame) -> DataFrame:
    """All matches; a caller whose template lines up has that match alone."""
    fast = _template(callers, endpoints)
    slow = _slow(callers, endpoints).join(fast.select("caller_id"), "caller_id", "left_anti")
    return fast.unionByName(slow)


def match(callers: DataFrame, endpoints: DataFrame, proxy_rules: list[tuple[str, bool]] = ()) -> DataFrame:
    """(caller_id, endpoint_id, ord, rank, matched_by, confidence, ...): direct matches, else those of the first proxy rule that gives any.

    ``proxy_rules``: (prefix, whether the proxy strips it), a short list from a config file.
    """
    callers, endpoints = caller_frame(callers), endpoint_frame(endpoints)
    out = match_direct(callers, endpoints)
    for prefix, strips in proxy_rules:
        if not strips:
            continue
        open_ = callers.join(out.select("caller_id"), "caller_id", "left_anti")
        head = F.element_at("template_parts", 1)
        parts = F.when(F.size("template_parts") > 0, F.concat(F.array(F.coalesce(urls.strip_prefix(head, prefix), head)), F.slice("template_parts", 2, F.greatest(F.size("template_parts") - 1, F.lit(0)))))
        variant = open_.withColumns({"url": urls.strip_prefix(F.col("url"), prefix), "template_parts": parts}).where("url IS NOT NULL")
        out = out.unionByName(match_direct(variant, endpoints))
    return out.withColumns({"matched_by": matched_by(F.col("rank")), "confidence": confidence(F.col("rank"))})


def application_scope(apps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (repository, e_repository) that may be stitched: a side in no application, or one in common.

    ``apps``: (application, repository).
    """
    of = apps.groupBy("repository").agg(F.collect_set("application").alias("apps"))
    left = of.select(F.col("repository").alias("_l"), F.col("apps").alias("_la"))
    right = of.select(F.col("repository").alias("_r"), F.col("apps").alias("_ra"))
    joined = pairs.join(left, F.col("repository") == F.col("_l"), "left").join(right, F.col("e_repository") == F.col("_r"), "left")
    return joined.where(F.col("_la").isNull() | F.col("_ra").isNull() | F.arrays_overlap("_la", "_ra")).drop("_l", "_la", "_r", "_ra")


def stitch(callers: DataFrame, endpoints: DataFrame, apps: DataFrame | None = None, proxy_rules: list[tuple[str, bool]] = (), mode: str = "all") -> DataFrame:
    """The best matches of each caller as RESOLVES_TO_ENDPOINT edges; several at the top are all kept, as low and inferred.

    ``mode``: none, exact (only high confidence) or all.
    """
    found = match(callers, endpoints, proxy_rules)
    if apps is not None:
        found = application_scope(apps, found)
    w = Window.partitionBy("caller_id")
    top = found.withColumn("_best", F.max("rank").over(w)).where("rank = _best").withColumn("_n", F.count("*").over(w))
    edges = top.select(
        "caller_id", "endpoint_id",
        F.when(F.col("_n") > 1, "inferred").otherwise(F.col("matched_by")).alias("matched_by"),
        F.when(F.col("_n") > 1, "low").otherwise(F.col("confidence")).alias("confidence"),
        F.col("repository").alias("from_repository"), F.col("e_repository").alias("to_repository"),
    )
    if mode == "none":
        return edges.where(F.lit(False))
    return edges.where("confidence = 'high'") if mode == "exact" else edges


def tiers(callers: DataFrame, endpoints: DataFrame, **options) -> DataFrame:
    """(caller_id, tier): deterministic, heuristic, ambiguous or unmatched."""
    best = stitch(callers, endpoints, **options).groupBy("caller_id").agg(F.max("confidence").alias("confidence"), F.max("matched_by").alias("by"), F.count("*").alias("n"))
    tier = F.when(F.col("n").isNull(), "unmatched").when(F.col("by") == "inferred", "ambiguous").when(F.col("confidence") == "high", "deterministic").otherwise("heuristic")
    return callers.select("caller_id").join(best, "caller_id", "left").select("caller_id", tier.alias("tier"))


def auto_stitch(callers: DataFrame, endpoints: DataFrame, existing: DataFrame, least: str = "deterministic", **options) -> DataFrame:
    """New edges of callers not stitched yet, unambiguous and of the tier asked for."""
    edges = stitch(callers, endpoints, **options).where("matched_by != 'inferred'")
    if least == "deterministic":
        edges = edges.where("confidence = 'high'")
    return edges.join(existing.select("caller_id"), "caller_id", "left_anti")


# --- rules ------------------------------------------------------------------------


def route_fits(path: Column, route: Column) -> Column:
    """A plain match: as many segments, empty ones don't count, ``:name`` and ``{name}`` stand for anything."""

    def pieces(x: Column) -> Column:
        return F.filter(F.split(urls.without_query(x), "/", -1), lambda s: s != "")

    def free(x: Column) -> Column:
        return x.startswith(":") | (x.startswith("{") & x.endswith("}"))

    a, b = pieces(path), pieces(route)
    return (F.size(a) == F.size(b)) & F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: free(x["b"]) | (x["a"] == x["b"]))


def apply_rules(callers: DataFrame, endpoints: DataFrame, rules: list[dict], stitched: DataFrame) -> DataFrame:
    """Rules in turn, earlier ones first: a caller of the rule's repository, its URL transformed, takes the first endpoint that fits.

    Joined on the number of segments, so each rule is a hash join. A rule: name, from, to,
    and strip, add or replace.
    """
    done, out = stitched.select("caller_id"), []
    count = lambda x: F.size(F.filter(F.split(urls.without_query(x), "/", -1), lambda s: s != ""))
    for rule in rules:
        c = callers.where((F.col("repository") == rule["from"]) & F.col("url").isNotNull()).join(done, "caller_id", "left_anti")
        c = c.withColumn("path", urls.transform_url(F.col("url"), rule.get("strip"), rule.get("add"), rule.get("replace"))).withColumn("n", count(F.col("path")))
        e = endpoints.where(F.col("repository") == rule["to"]).select("endpoint_id", F.col("method").alias("e_method"), "route", "ord", count(F.col("route")).alias("n"))
        ok = route_fits(F.col("path"), F.col("route")) & (F.col("method").isNull() | (F.col("method") == F.col("e_method")) | (F.col("e_method") == "ALL"))
        first = F.row_number().over(Window.partitionBy("caller_id").orderBy("ord", "endpoint_id"))
        hit = c.join(e, "n").where(ok).withColumn("_i", first).where("_i = 1").select("caller_id", "endpoint_id", F.lit("inferred").alias("matched_by"), F.lit("high").alias("confidence"), F.lit(rule["name"]).alias("rule"))
        out.append(hit)
        done = done.unionAll(hit.select("caller_id"))
    return reduce(DataFrame.unionByName, out) if out else stitched.limit(0)


def mine_prefixes(callers: DataFrame, endpoints: DataFrame, least: int = 3, longest: int = 3) -> DataFrame:
    """For each pair of repositories, the prefix of one to three segments whose removal lets most callers match a route."""
    segments = F.filter(F.split(urls.without_query(F.col("url")), "/", -1), lambda s: s != "")
    c = callers.where("url IS NOT NULL").withColumn("s", segments).where(F.size("s") > 1)
    c = c.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.size("s") - 1, F.lit(longest)))))
    c = c.withColumns({"prefix": F.concat(F.lit("/"), F.array_join(F.slice("s", 1, F.col("k")), "/")), "path": F.concat(F.lit("/"), F.array_join(F.slice("s", F.col("k") + 1, F.size("s") - F.col("k")), "/")), "n": F.size("s") - F.col("k")})
    e = endpoints.select(F.col("repository").alias("to_repository"), "route", F.size(F.filter(F.split("route", "/", -1), lambda s: s != "")).alias("n")).distinct()
    fixed = c.join(e, "n").where(route_fits(F.col("path"), F.col("route")) & (F.col("repository") != F.col("to_repository")))
    counts = fixed.groupBy(F.col("repository").alias("from_repository"), "to_repository", "prefix").agg(F.countDistinct("caller_id").alias("fixes")).where(F.col("fixes") >= least)
    best = F.row_number().over(Window.partitionBy("from_repository", "to_repository").orderBy(F.desc("fixes"), F.length("prefix"), "prefix"))
    return counts.withColumn("_i", best).where("_i = 1").drop("_i")


def report(callers: DataFrame, edges: DataFrame) -> DataFrame:
    """(caller_id, state): stitched, external, dynamic or unresolved. ``callers`` has is_external and egress."""
    hit = edges.select("caller_id").distinct().withColumn("_hit", F.lit(True))
    state = F.when(F.col("_hit"), "stitched").when(F.col("is_external"), "external").when(F.col("url").isNull() | (F.col("egress") == "dynamic"), "dynamic").otherwise("unresolved")
    return callers.join(hit, "caller_id", "left").withColumn("state", state)
