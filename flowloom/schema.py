"""The closed world of node and edge types: Spark schemas and row checks.

Nodes of one type share a DataFrame. Edges share one, with the properties that any edge
type can have as nullable columns, partitioned by ``edge_type`` when stored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION = "0.3.0"

EVIDENCE = "STRUCT<filePath: STRING, lineStart: INT, lineEnd: INT, snippet: STRING, confidence: STRING>"
PARAMETERS = "ARRAY<STRUCT<name: STRING, type: STRING>>"
RESPONSES = "ARRAY<STRUCT<statusCode: INT, bodyExpression: STRING, isErrorPath: BOOLEAN, sourceLine: INT>>"
REQUEST_FIELDS = "ARRAY<STRUCT<name: STRING, source: STRING, type: STRING>>"
MIDDLEWARE = "ARRAY<STRUCT<functionId: STRING, name: STRING, order: INT>>"
HANDLERS = "ARRAY<STRUCT<kind: STRING, expression: STRING, targetStateVar: STRING, sourceLine: INT>>"

#: Columns of each node type. ``!`` marks those that must not be null.
NODES: dict[str, str] = {
    "SourceFile": "id! STRING, filePath! STRING, repository! STRING, language! STRING, framework STRING",
    "FunctionDefinition": f"id! STRING, name! STRING, sourceFileId! STRING, sourceLine! INT, parameters {PARAMETERS}, returnType STRING, isExported! BOOLEAN, isAsync! BOOLEAN, evidence {EVIDENCE}, responses {RESPONSES}, requestFields {REQUEST_FIELDS}",
    "APIEndpoint": f"id! STRING, httpMethod! STRING, routePattern! STRING, handlerFunctionId STRING, framework! STRING, repository! STRING, evidence {EVIDENCE}, middlewareChain {MIDDLEWARE}, responses {RESPONSES}",
    "ClientSideAPICaller": f"id! STRING, functionId! STRING, sourceFileId! STRING, sourceLine! INT, httpMethod STRING, urlLiteral STRING, egressConfidence! STRING, templateSpanCount INT, templateSegmentCount INT, templateParts ARRAY<STRING>, framework! STRING, repository! STRING, isExternal BOOLEAN, externalHost STRING, evidence {EVIDENCE}, responseHandlers {HANDLERS}",
    "ClientSideProcess": f"id! STRING, kind! STRING, name! STRING, functionId! STRING, sourceFileId! STRING, sourceLine! INT, framework! STRING, repository! STRING, evidence {EVIDENCE}",
    "DatabaseSystem": "id! STRING, kind! STRING, name! STRING, connectionSource STRING",
    "DatabaseTable": "id! STRING, systemId! STRING, name! STRING, schema STRING, kind! STRING, declaredIn STRING",
    "DatabaseColumn": "id! STRING, tableId! STRING, name! STRING, type STRING, nullable BOOLEAN, isPrimaryKey! BOOLEAN, isForeignKey! BOOLEAN",
    "DatabaseInteraction": f"id! STRING, callSiteFunctionId! STRING, operation! STRING, orm! STRING, rawQuery STRING, confidence! STRING, evidence {EVIDENCE}",
    "Screen": f"id! STRING, name! STRING, componentFunctionId STRING, navigatorKind STRING, routePath STRING, parentScreenId STRING, sourceFileId! STRING, sourceLine! INT, framework! STRING, repository! STRING, evidence {EVIDENCE}",
    "EnvironmentVariable": "id! STRING, name! STRING, category! STRING, hasDefault! BOOLEAN, accessPattern! STRING, sourceFileId! STRING, sourceLine! INT, functionId STRING, repository! STRING",
    "StateStore": f"id! STRING, name! STRING, framework! STRING, declaredIn! STRING, fields {PARAMETERS}, actions ARRAY<STRING>, sourceLine! INT, repository! STRING",
}

#: Extra properties of each edge type.
EDGES: dict[str, tuple[str, ...]] = {
    "IMPORTS": ("symbols", "isDefault", "isDynamic"),
    "EXPORTS": ("exportName", "isDefault"),
    "DEFINED_IN": (),
    "CALLS_FUNCTION": ("sourceLine", "arguments", "isConditional", "confidence"),
    "TRIGGERS": (),
    "MAKES_REQUEST": (),
    "RESOLVES_TO_ENDPOINT": ("matchedBy", "matchConfidence", "confirmedBy", "confirmedAt", "strategy", "reason", "fromRepository", "toRepository"),
    "TABLE_IN": (),
    "COLUMN_IN": (),
    "FOREIGN_KEY": ("onDelete", "onUpdate"),
    "READS": ("columns", "filters"),
    "WRITES": ("columns", "kind"),
    "PERFORMED_BY": ("sourceLine",),
    "NAVIGATES_TO": ("method", "sourceLine"),
    "SCREEN_COMPONENT": (),
    "READS_STATE": ("field", "sourceLine"),
    "WRITES_STATE": ("action", "sourceLine"),
    "RENDERS": ("templateName", "sourceLine"),
    "BUNDLES_TO": ("bundler", "entryName", "configPath"),
}

_PROPS = (
    "symbols ARRAY<STRING>, isDefault BOOLEAN, isDynamic BOOLEAN, exportName STRING, sourceLine INT, arguments ARRAY<STRING>, isConditional BOOLEAN, "
    "confidence STRING, matchedBy STRING, matchConfidence STRING, confirmedBy STRING, confirmedAt STRING, strategy STRING, reason STRING, fromRepository STRING, "
    "toRepository STRING, onDelete STRING, onUpdate STRING, columns ARRAY<STRING>, filters ARRAY<STRING>, kind STRING, method STRING, field STRING, action STRING, "
    "templateName STRING, bundler STRING, entryName STRING, configPath STRING"
)
EDGE = f"id STRING, edge_type STRING, from_id STRING, to_id STRING, {_PROPS}"
PROPERTIES = tuple(p.split()[0] for p in _PROPS.split(", "))

#: Allowed values of enumerated columns.
ENUMS: dict[tuple[str, str], str] = {
    ("ClientSideAPICaller", "egressConfidence"): "exact pattern dynamic",
    ("ClientSideProcess", "kind"): "event_handler lifecycle_hook route_handler background_task cli_command script_entry bridge_command saga_watcher query_hook scheduled_job",
    ("DatabaseSystem", "kind"): "postgres mysql sqlite mongodb redis elasticsearch dynamodb memcached supabase mssql cassandra unknown",
    ("DatabaseTable", "kind"): "table view collection",
    ("DatabaseInteraction", "operation"): "read write update delete upsert raw",
    ("DatabaseInteraction", "confidence"): "direct inferred dynamic",
    ("EnvironmentVariable", "category"): "database auth api config unknown",
    ("CALLS_FUNCTION", "confidence"): "direct method indirect dynamic",
    ("RESOLVES_TO_ENDPOINT", "matchedBy"): "exact-url pattern inferred",
    ("RESOLVES_TO_ENDPOINT", "matchConfidence"): "high medium low",
    ("WRITES", "kind"): "insert update upsert delete",
}


def node_schema(node_type: str) -> StructType:
    if node_type not in NODES:
        raise ValueError(f"unknown node type {node_type}")
    return StructType.fromDDL(NODES[node_type].replace("! ", " "))


def edge_schema() -> StructType:
    return StructType.fromDDL(EDGE)


def required(node_type: str) -> list[str]:
    return [part.split("!")[0].strip() for part in NODES[node_type].split(", ") if "! " in part]


def _enum_ok(owner: str, columns: list[str]) -> list[Column]:
    return [F.col(c).isNull() | F.col(c).isin(allowed.split()) for (o, c), allowed in ENUMS.items() if o == owner and c in columns]


def node_is_valid(node_type: str, columns: list[str]) -> Column:
    """True for rows that have what the type asks for."""
    checks = [F.col(c).isNotNull() for c in required(node_type)] + _enum_ok(node_type, columns)
    checks += [F.col(c) >= 0 for c in ("sourceLine",) if c in required(node_type)]
    if "evidence" in columns:
        checks.append(F.col("evidence").isNull() | (F.col("evidence.lineEnd") >= F.col("evidence.lineStart")))
    return F.coalesce(reduce(Column.__and__, checks), F.lit(False))


def edge_is_valid(columns: list[str]) -> Column:
    """True for edges of a known type with both ends; ends may dangle."""
    checks = [F.col("edge_type").isin(list(EDGES)), F.col("from_id").isNotNull(), F.col("to_id").isNotNull()]
    for owner in EDGES:
        ok = _enum_ok(owner, columns)
        if ok:
            checks.append((F.col("edge_type") != owner) | reduce(Column.__and__, ok))
    return F.coalesce(reduce(Column.__and__, checks), F.lit(False))


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in order: missing ones null, unknown ones dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
