"""Content-addressed ids of nodes and edges as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.schema import PROPERTIES

#: Which columns make the id of a type, in order.
PARTS: dict[str, tuple[str, ...]] = {
    "SourceFile": ("repository", "filePath"),
    "FunctionDefinition": ("sourceFileId", "name", "sourceLine"),
    "APIEndpoint": ("repository", "httpMethod", "routePattern", "filePath", "lineStart"),
    "ClientSideAPICaller": ("sourceFileId", "sourceLine", "urlLiteral"),
    "ClientSideProcess": ("sourceFileId", "sourceLine", "name"),
    "DatabaseSystem": ("kind", "name"),
    "DatabaseTable": ("systemId", "schema", "name"),
    "DatabaseColumn": ("tableId", "name"),
    "DatabaseInteraction": ("callSiteFunctionId", "operation", "targetTableId"),
    "Screen": ("repository", "name", "routePath"),
    "EnvironmentVariable": ("sourceFileId", "name", "sourceLine"),
    "StateStore": ("declaredIn", "name"),
}


def content_id(kind: str, *parts: Column) -> Column:
    """``kind:`` and 16 hex digits of the SHA-1 of the parts; a null part is one zero byte."""
    joined = F.array_join(F.array(*[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts]), "\x01")
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha1(joined), 1, 16))


def node_id(node_type: str, **columns: Column | str) -> Column:
    """The id of a node from the columns that ``PARTS`` names."""
    values = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    parts = []
    for name in PARTS[node_type]:
        c = values[name]
        if name == "httpMethod":
            c = F.upper(c)
        if node_type == "ClientSideAPICaller" and name == "urlLiteral":
            c = F.coalesce(c, F.lit("dynamic"))
        parts.append(c)
    return content_id(node_type, *parts)


def edge_id(columns: list[str]) -> Column:
    """The id of an edge: SHA-1 of its JSON with sorted keys and without absent properties."""
    named = {"edgeType": "edge_type", "from": "from_id", "to": "to_id"} | {p: p for p in PROPERTIES if p in columns}
    record = F.struct(*[F.col(named[k]).alias(k) for k in sorted(named)])
    return F.concat(F.col("edge_type"), F.lit(":"), F.substring(F.sha1(F.to_json(record)), 1, 16))
