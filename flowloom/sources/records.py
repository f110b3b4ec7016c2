"""Small structured sources: runtime traces, Prisma schemas, redirect files; JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import ids
from flowloom.operators import walk

TRACE = "kind STRING, callSite STRUCT<filePath: STRING, line: INT, column: INT>, method STRING, url STRING, hookName STRING, boundFnName STRING, timestamp BIGINT, _corrupt STRING"


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace lines; malformed ones have ``_corrupt`` and are for the caller to count."""
    return spark.read.schema(TRACE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def merge_trace(trace: DataFrame, files: DataFrame, functions: DataFrame) -> DataFrame:
    """Traced requests as callers of the function around their call site, one for each caller id; hooks and unknown files drop out.

    files (file_id, path), functions (function_id, file_id, line).
    """
    calls = trace.where("_corrupt IS NULL AND kind IN ('fetch', 'axios')").select(F.col("callSite.filePath").alias("path"), F.col("callSite.line").alias("line"), F.upper("method").alias("method"), "url")
    calls = calls.join(files, "path").withColumn("call_id", F.concat_ws("\x01", "file_id", "line", "method", "url"))
    at = walk.enclosing(calls.select("call_id", F.col("file_id").alias("file"), "line").distinct(), functions.select("function_id", F.col("file_id").alias("file"), "line")).where("function_id IS NOT NULL")
    out = calls.dropDuplicates(["call_id"]).join(at.select("call_id", "function_id"), "call_id")
    caller = ids.node_id("ClientSideAPICaller", sourceFileId="file_id", sourceLine="line", urlLiteral="url")
    return out.select(caller.alias("caller_id"), "function_id", "file_id", "line", "method", "url", F.lit("pattern").alias("egress")).dropDuplicates(["caller_id"])


def prisma_models(schemas: DataFrame) -> DataFrame:
    """(repository, path, model, ord, column, type, nullable, is_primary, references) of schema files (repository, path, content)."""
    models = F.regexp_extract_all("content", F.lit(r"(?m)^\s*model\s+\w+\s*\{[^}]*\}"), F.lit(0))
    m = schemas.select("repository", "path", F.explode(models).alias("m"))
    m = m.select("repository", "path", F.regexp_extract("m", r"model\s+(\w+)", 1).alias("model"), F.posexplode(F.split(F.regexp_extract("m", r"(?s)\{(.*)\}", 1), "\n")).alias("ord", "x"))
    f = m.where(F.col("x").rlike(r"^\s*\w+\s+\w+") & ~F.col("x").rlike(r"^\s*(?://|@@)"))
    col = f.select("repository", "path", "model", "ord", F.regexp_extract("x", r"^\s*(\w+)", 1).alias("column"), F.regexp_extract("x", r"^\s*\w+\s+(\w+)", 1).alias("type"), F.col("x").rlike(r"^\s*\w+\s+\w+\?").alias("nullable"), F.col("x").rlike(r"@id\b").alias("is_primary"), F.col("x").rlike(r"^\s*\w+\s+\w+\[\]").alias("is_list"), "x")
    names = col.select("repository", F.col("model").alias("type")).distinct()
    plain = col.join(names, ["repository", "type"], "left_anti").where("NOT is_list")
    link = col.where(F.col("x").rlike(r"@relation\([^)]*fields"))

    def listed(field: str):
        return F.split(F.regexp_replace(F.regexp_extract("x", rf"{field}:\s*\[([^\]]*)\]", 1), r"\s", ""), ",")

    refs = link.select("repository", "path", "model", F.col("type").alias("target"), F.explode(F.arrays_zip(listed("fields").alias("column"), listed("references").alias("key"))).alias("z"))
    refs = refs.select("repository", "path", "model", "z.column", F.concat_ws(".", "target", "z.key").alias("references"))
    return plain.join(refs, ["repository", "path", "model", "column"], "left").drop("x", "is_list")


def redirects(files: DataFrame, most: int = 5000) -> DataFrame:
    """(repository, path, source, destination, status) of firebase.json and vercel.json files; at most ``most`` a file, as that format's reader has it."""
    row = "array<struct<source:string,destination:string,type:int,statusCode:int,permanent:boolean>>"
    both = F.coalesce(F.from_json(F.get_json_object("content", "$.hosting.redirects"), row), F.from_json(F.get_json_object("content", "$.redirects"), row))
    r = files.select("repository", "path", F.explode(F.slice(both, 1, most)).alias("r"))
    status = F.coalesce("r.type", "r.statusCode", F.when(F.col("r.permanent"), 308).otherwise(307))
    return r.select("repository", "path", "r.source", "r.destination", status.alias("status")).where("source IS NOT NULL AND destination IS NOT NULL")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)
