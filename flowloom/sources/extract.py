"""Framework extractors, table-driven: patterns over the text of files give endpoints, callers and database uses.

One pass over a file's text runs every pattern of its language; a row of the tables says
which framework it is, what it emits and how groups of the match are read. Everything is a
built-in expression, so the scan stays in the JVM and files are independent of each other.
Line patterns see one statement; prefixes that come from another file (router mounts,
blueprints) are joined afterwards with ``compose_prefix``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import strings, urls

_Q = r"""["'`]([^"'`\n]*)["'`]"""
_VERBS = "get|post|put|patch|delete|head|options|all"

#: The method of routes that name several in a chain, in the second group.
EACH = "each"

#: (framework, language, pattern, group of the method or a fixed method, group of the route)
ENDPOINTS: list[tuple[str, str, str, int | str, int]] = [
    ("express", "ts", rf"(?:app|router|server|api)\w*\.({_VERBS})\(\s*{_Q}", 1, 2),
    ("fastify", "ts", rf"fastify\w*\.({_VERBS})\(\s*{_Q}", 1, 2),
    ("koa", "ts", rf"koaRouter\.({_VERBS})\(\s*{_Q}", 1, 2),
    ("hapi", "ts", rf"server\.route\(\s*\{{[^}}]*?method:\s*{_Q}[^}}]*?path:\s*{_Q}", 1, 2),
    ("nestjs", "ts", rf"@(Get|Post|Put|Patch|Delete|Head|Options|All)\(\s*(?:{_Q})?\s*\)", 1, 2),
    ("flask", "py", rf"@\w+\.(get|post|put|patch|delete)\(\s*{_Q}", 1, 2),
    ("flask", "py", rf"@\w+\.route\(\s*{_Q}(?![^)]*methods)", "GET", 1),
    ("django", "py", rf"\b(?:re_)?path\(\s*r?{_Q}", "ALL", 1),
    ("aiohttp", "py", rf"\.add_(get|post|put|patch|delete)\(\s*{_Q}", 1, 2),
    ("gin", "go", r"\.(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Any)\(\s*\"([^\"]*)\"", 1, 2),
    ("chi", "go", r"\br\.(Get|Post|Put|Patch|Delete|Head|Options)\(\s*\"([^\"]*)\"", 1, 2),
    ("gohttp", "go", r"\.HandleFunc\(\s*\"(?:[A-Z]+ )?([^\"]*)\"", "ALL", 1),
    ("actix", "rust", r"#\[(get|post|put|patch|delete|head)\(\s*\"([^\"]*)\"", 1, 2),
    ("axum", "rust", r"\.route\(\s*\"([^\"]*)\"\s*,\s*((?:(?:\w+::)*\.?\s*(?:get|post|put|patch|delete|head|options|any)\([^()]*(?:\([^()]*\)[^()]*)*\)\s*)+)", EACH, 1),
    ("spring", "java", r"@(Get|Post|Put|Patch|Delete)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]*)\"", 1, 2),
    ("laravel", "php", rf"Route::({_VERBS})\(\s*{_Q}", 1, 2),
]
#: The same for HTTP clients.
CALLERS: list[tuple[str, str, str, int | str, int]] = [
    ("axios", "ts", rf"\b(?:axios|http|api|client)\.(get|post|put|patch|delete|head)\(\s*{_Q}", 1, 2),
    ("fetch", "ts", rf"\bfetch\(\s*{_Q}(?!\s*,\s*\{{[^}}]*method)", "GET", 1),
    ("httpx", "py", rf"\b(?:requests|httpx|client|session)\.(get|post|put|patch|delete|head)\(\s*f?{_Q}", 1, 2),
    ("gohttp", "go", r"\bhttp\.(Get|Post|Head)\(\s*\"([^\"]*)\"", 1, 2),
    ("reqwest", "rust", r"\b(?:reqwest::|client\.)(get|post|put|patch|delete|head)\(\s*\"([^\"]*)\"", 1, 2),
]
#: Producers and consumers of queues: (framework, language, pattern, side, prefix, group of the name).
MESSAGES: list[tuple[str, str, str, str, str, int]] = [
    ("kafkajs", "ts", rf"\.send\(\s*\{{\s*topic:\s*{_Q}", "caller", "kafka", 1),
    ("kafkajs", "ts", rf"\.subscribe\(\s*\{{\s*topic:\s*{_Q}", "endpoint", "kafka", 1),
    ("bullmq", "ts", rf"new\s+Queue\(\s*{_Q}", "caller", "bullmq", 1),
    ("bullmq", "ts", rf"new\s+Worker\(\s*{_Q}", "endpoint", "bullmq", 1),
    ("amqplib", "ts", rf"\.sendToQueue\(\s*{_Q}", "caller", "amqp", 1),
    ("amqplib", "ts", rf"\.consume\(\s*{_Q}", "endpoint", "amqp", 1),
    ("celery", "py", r"\b(\w+)\.delay\(", "caller", "celery", 1),
    ("kafkapy", "py", rf"KafkaConsumer\(\s*{_Q}", "endpoint", "kafka", 1),
    ("kafkapy", "py", rf"\.produce\(\s*{_Q}", "caller", "kafka", 1),
    ("pika", "py", rf"basic_consume\(\s*(?:queue\s*=\s*)?{_Q}", "endpoint", "amqp", 1),
    ("ws-ts", "ts", rf"new\s+WebSocket\(\s*{_Q}", "caller", "ws", 1),
]
#: Calls on models: (orm, language, pattern, group of the table, group of the verb).
DATABASES: list[tuple[str, str, str, int, int]] = [
    ("prisma", "ts", r"\bprisma\.(\w+)\.(find\w+|create\w*|update\w*|delete\w*|upsert|count|aggregate|groupBy)\(", 1, 2),
    ("knex", "ts", rf"\bknex\(\s*{_Q}\s*\)(?:\.\w+\([^)]*\))*?\.(select|first|insert|update|del|delete|count)\(", 1, 2),
    ("mongoose", "ts", r"\b([A-Z]\w+)\.(find\w*|create|insertMany|update\w*|delete\w*|countDocuments|aggregate)\(", 1, 2),
    ("supabase", "ts", rf"\.from\(\s*{_Q}\s*\)\s*\.(select|insert|update|delete|upsert)\(", 1, 2),
    ("django", "py", r"\b([A-Z]\w+)\.objects\.(all|get|filter|exclude|create|update|delete|count|first|bulk_create)\(", 1, 2),
    ("peewee", "py", r"\b([A-Z]\w+)\.(select|get|create|insert|update|delete)\(", 1, 2),
    ("pymongo", "py", rf"\bdb\[{_Q}\]\.(find\w*|insert\w*|update\w*|delete\w*|count_documents|aggregate)\(", 1, 2),
    ("mongogo", "go", r"\.Collection\(\"([^\"]*)\"\)\.(Find\w*|Insert\w*|Update\w*|Delete\w*|Count\w*|Aggregate)\(", 1, 2),
    ("laravel", "php", r"\b([A-Z]\w+)::(all|find\w*|where|create|update|delete|insert)\(", 1, 2),
]


def operation(verb: Column) -> Column:
    """What a verb does to a table."""
    v = F.lower(verb)
    return F.when(v.rlike("^upsert"), "upsert").when(v.rlike("^(?:create|insert|bulk_create|save|add)"), "write").when(v.rlike("^update"), "update").when(v.rlike("^(?:del|remove)"), "delete").otherwise("read")


def lines_of(text: Column, pattern: str) -> Column:
    """array<struct<hit, line>> of all matches in turn, each with the line on which it begins."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(hits.alias("hit"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"))

    def breaks(x: Column) -> Column:
        return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))

    def step(acc: Column, x: Column) -> Column:
        line = acc["line"] + breaks(x["gap"])
        return F.struct((line + breaks(x["hit"])).alias("line"), F.array_append(acc["out"], F.struct(x["hit"].alias("hit"), line.alias("line"))).alias("out"))

    none = F.from_json(F.lit("[]"), "array<struct<hit:string,line:int>>")
    return F.aggregate(pairs, F.struct(F.lit(1).alias("line"), none.alias("out")), step, lambda acc: acc["out"])


def matches(files: DataFrame, pattern: str) -> DataFrame:
    """(repository, path, content, ord, hit, line): a row for each match."""
    rows = files.where(F.col("content").rlike(pattern)).select("repository", "path", "content", F.posexplode(lines_of(F.col("content"), pattern)).alias("ord", "_hit"))
    return rows.select("repository", "path", "content", "ord", "_hit.hit", "_hit.line")


def _hits(files: DataFrame, language: str, pattern: str) -> DataFrame:
    return matches(files.where(F.col("language") == language), pattern)


def normal_route(route: Column) -> Column:
    """``{id}``, ``<int:id>`` and ``(?P<id>...)`` become ``:id``; one leading slash."""
    x = F.regexp_replace(route, r"\{(\w+)(?::[^}]*)?\}", ":$1")
    x = F.regexp_replace(x, r"<(?:\w+:)?(\w+)>", ":$1")
    x = F.regexp_replace(x, r"\(\?P:?(\w+)[^)]*\)", ":$1")
    return F.concat(F.lit("/"), F.regexp_replace(x, "^[/^]+|[$]$", ""))


def endpoints(files: DataFrame) -> DataFrame:
    """(repository, path, line, framework, method, route) of files (repository, path, language, content)."""
    out = []
    for framework, language, pattern, method, route in ENDPOINTS:
        h = _hits(files, language, pattern)
        if method == EACH:  # a chain of verbs: an endpoint each
            h = h.withColumn("_verb", F.explode(F.regexp_extract_all(F.regexp_extract("hit", pattern, 2), F.lit(r"(?:^|::|\.\s*)(\w+)\("), F.lit(1))))
            m = F.upper("_verb")
        else:
            m = F.lit(method) if isinstance(method, str) else F.upper(F.regexp_extract("hit", pattern, method))
        out.append(h.select("repository", "path", "line", F.lit(framework).alias("framework"), F.when(m == "ANY", "ALL").otherwise(m).alias("method"), normal_route(F.regexp_extract("hit", pattern, route)).alias("route")))
    for framework, language, pattern, side, prefix, name in MESSAGES:
        if side == "endpoint":
            h = _hits(files, language, pattern)
            out.append(h.select("repository", "path", "line", F.lit(framework).alias("framework"), F.lit("JOB").alias("method"), F.concat(F.lit(f"{prefix}:"), F.regexp_extract("hit", pattern, name)).alias("route")))
    return reduce(DataFrame.unionByName, out)


def callers(files: DataFrame) -> DataFrame:
    """(repository, path, line, framework, method, url, egress, external_host)."""
    out = []
    for framework, language, pattern, method, url in CALLERS:
        h = _hits(files, language, pattern)
        m = F.lit(method) if isinstance(method, str) else F.upper(F.regexp_extract("hit", pattern, method))
        out.append(h.select("repository", "path", "line", F.lit(framework).alias("framework"), m.alias("method"), F.regexp_extract("hit", pattern, url).alias("raw")))
    for framework, language, pattern, side, prefix, name in MESSAGES:
        if side == "caller":
            h = _hits(files, language, pattern)
            out.append(h.select("repository", "path", "line", F.lit(framework).alias("framework"), F.lit("JOB").alias("method"), F.concat(F.lit(f"{prefix}:"), F.regexp_extract("hit", pattern, name)).alias("raw")))
    rows = reduce(DataFrame.unionByName, out)
    holes = F.regexp_count("raw", F.lit(r"\$\{[^}]*\}|\{\w+\}"))
    pieces = F.split(F.regexp_replace("raw", r"\$\{[^}]*\}|\{\w+\}", "\x00"), "\x00", -1)
    rebuilt = F.array_join(F.transform(pieces, lambda x, i: F.when(i < F.size(pieces) - 1, F.concat(x, F.lit(":p"), i.cast("string"))).otherwise(x)), "")
    return rows.select("repository", "path", "line", "framework", "method", rebuilt.alias("url"), F.when(holes > 0, "pattern").otherwise("exact").alias("egress"), F.when(holes > 0, pieces).alias("template_parts"), urls.external_host(F.col("raw")).alias("external_host"))


def interactions(files: DataFrame) -> DataFrame:
    """(repository, path, line, orm, table, operation): model calls and SQL in strings."""
    out = []
    for orm, language, pattern, table, verb in DATABASES:
        h = _hits(files, language, pattern)
        out.append(h.select("repository", "path", "line", F.lit(orm).alias("orm"), F.regexp_extract("hit", pattern, table).alias("table"), operation(F.regexp_extract("hit", pattern, verb)).alias("operation")))
    literal = r"""(?is)["'`](\s*(?:select|insert|update|delete)\b[^"'`]*)["'`]"""
    h = matches(files, literal).withColumn("hit", F.regexp_extract("hit", literal, 1))
    sql = h.select("repository", "path", "line", F.lit("sql").alias("orm"), strings.sql_table_op(F.col("hit")).alias("x")).where("x IS NOT NULL")
    out.append(sql.select("repository", "path", "line", "orm", "x.table", "x.operation"))
    return reduce(DataFrame.unionByName, out)


_ENV = r"process\.env\.([A-Z_][A-Z0-9_]*)|process\.env\[[\"']([A-Z_][A-Z0-9_]*)[\"']\]|os\.(?:environ(?:\.get\(|\[)|getenv\()[\"']([A-Z_][A-Z0-9_]*)[\"']|os\.Getenv\(\"([A-Z_][A-Z0-9_]*)\"|env::var\(\"([A-Z_][A-Z0-9_]*)\""


def env_vars(files: DataFrame) -> DataFrame:
    """(repository, path, line, name, category, has_default)."""
    h = matches(files, rf"(?:{_ENV})[^\n]{{0,6}}")
    name = F.coalesce(*[F.when(F.regexp_extract("hit", _ENV, i) != "", F.regexp_extract("hit", _ENV, i)) for i in range(1, 6)])
    return h.select("repository", "path", "line", name.alias("name"), strings.env_category(name).alias("category"), F.col("hit").rlike(r"(?:\?\?|\|\||,)\s*\S?$|(?:\?\?|\|\|)").alias("has_default"))


def compose_prefix(found: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Endpoints with the prefix under which their file is mounted, beside the unprefixed ones: (repository, path, prefix)."""
    mounted = found.join(prefixes, ["repository", "path"]).withColumn("route", F.concat(F.regexp_replace("prefix", "/+$", ""), "route")).drop("prefix")
    return found.unionByName(mounted).distinct()
