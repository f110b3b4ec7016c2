"""The graph store: typed node frames and one edge frame, immutable.

Every change returns a new ``Graph``. Rows carry ``_ord`` (batch, position) so that what
the order of writing decides (the last write wins, the first alias wins) is decided alike in
every run. Nothing here collects rows; counts and lookups are small aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom import schema
from flowloom.functions import ids
from flowloom.functions.strings import table_aliases
from flowloom.keeping import keep


class SchemaValidationError(ValueError):
    """A batch has rows that their type doesn't allow."""


BATCHES = "id BIGINT, plugin STRING, schemaVersion STRING, createdAt STRING, nodeCount BIGINT, edgeCount BIGINT"
HASHES = "repository STRING, filePath STRING, hash STRING, schemaVersion STRING, updatedAt STRING"


def equals(where: dict) -> Column:
    """AND of null-safe equalities; only scalars are allowed."""
    out = F.lit(True)
    for k, v in where.items():
        if isinstance(v, (list, dict, set, tuple)):
            raise TypeError(f"{k}: only scalars can be looked up")
        out &= F.col(k).eqNullSafe(F.lit(v))
    return out


def batch_meta(plugin: str, created_at: str, version: str = schema.SCHEMA_VERSION) -> dict:
    return {"plugin": plugin, "schemaVersion": version, "createdAt": created_at}


def last_write_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the one written last."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


@dataclass(frozen=True)
class Graph:
    spark: SparkSession
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: DataFrame | None = None
    batches: DataFrame | None = None
    hashes: DataFrame | None = None
    meta: DataFrame | None = None

    def node(self, node_type: str) -> DataFrame:
        """All nodes of a type; an empty frame where there are none."""
        if node_type in self.nodes:
            return self.nodes[node_type]
        return self.spark.createDataFrame([], schema.node_schema(node_type)).withColumn("_ord", F.lit(0).cast("bigint"))

    @property
    def edge(self) -> DataFrame:
        if self.edges is not None:
            return self.edges
        return self.spark.createDataFrame([], schema.edge_schema()).withColumn("_ord", F.lit(0).cast("bigint"))

    def edges_of(self, *types: str) -> DataFrame:
        return self.edge.where(F.col("edge_type").isin(list(types)))

    def with_nodes(self, **frames: DataFrame) -> Graph:
        return replace(self, nodes=self.nodes | frames)

    # --- writing -----------------------------------------------------------------

    def commit(self, nodes: dict[str, DataFrame] | None = None, edges: DataFrame | None = None, meta: dict | None = None) -> Graph:
        """Upserts a batch by id, the last write winning. The whole batch is checked first, in one action; nothing changes if a row fails."""
        nodes = {t: schema.conform(df, schema.node_schema(t)) for t, df in (nodes or {}).items()}
        if edges is not None:
            edges = schema.conform(edges.withColumn("id", F.lit(None).cast("string")) if "id" not in edges.columns else edges, schema.edge_schema())
            edges = edges.withColumn("id", F.coalesce("id", ids.edge_id(edges.columns)))
        checks = [df.select(F.lit(t).alias("t"), schema.node_is_valid(t, df.columns).alias("ok")) for t, df in nodes.items()]
        if edges is not None:
            checks.append(edges.select(F.lit("edge").alias("t"), schema.edge_is_valid(edges.columns).alias("ok")))
        counts = {}
        if checks:
            for r in reduce(DataFrame.unionAll, checks).groupBy("t").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad")).collect():
                if r["bad"]:
                    raise SchemaValidationError(f"{r['bad']} invalid rows of {r['t']}")
                counts[r["t"]] = r["n"]
        batch = (self.batch_list().agg(F.max("id")).first()[0] or 0) + 1
        stamp = F.lit(batch).cast("bigint")
        new_nodes = dict(self.nodes)
        for t, df in nodes.items():
            both = self.node(t).unionByName(df.withColumn("_ord", stamp))
            new_nodes[t] = last_write_wins(both, ["id"], ["_ord"])
        new_edges = self.edges
        if edges is not None:
            new_edges = last_write_wins(self.edge.unionByName(edges.withColumn("_ord", stamp)), ["id"], ["_ord"])
        m = batch_meta("", "") | (meta or {})
        row = (batch, m["plugin"], m["schemaVersion"], m["createdAt"], sum(n for t, n in counts.items() if t != "edge"), counts.get("edge", 0))
        return replace(self, nodes=new_nodes, edges=new_edges, batches=self.batch_list().unionByName(self.spark.createDataFrame([row], BATCHES)))

    def batch_list(self) -> DataFrame:
        """The ledger of batches, in order. Counts are those of the batch, not of what was new."""
        found = self.batches if self.batches is not None else self.spark.createDataFrame([], BATCHES)
        return found.orderBy("id")

    # --- reading -----------------------------------------------------------------

    def get_node(self, node_type: str, node_id: str) -> DataFrame:
        return self.node(node_type).where(F.col("id") == node_id)

    def all_nodes(self) -> DataFrame:
        """(id, node_type, repository, data): every node, its columns as JSON."""
        out = []
        for t in schema.NODES:
            df = self.node(t)
            repo = F.col("repository") if "repository" in df.columns else F.lit(None).cast("string")
            out.append(df.select("id", F.lit(t).alias("node_type"), repo.alias("repository"), F.to_json(F.struct(*[c for c in df.columns if c != "_ord"])).alias("data")))
        return reduce(DataFrame.unionAll, out)

    def get_node_by_id(self, node_id: str) -> DataFrame:
        return self.all_nodes().where(F.col("id") == node_id)

    def find_nodes(self, node_type: str, where: dict | None = None) -> DataFrame:
        return self.node(node_type).where(equals(where or {}))

    def find_edges(self, from_id: str | None = None, to_id: str | None = None, edge_type: str | None = None) -> DataFrame:
        found = self.edge
        for column, value in (("from_id", from_id), ("to_id", to_id), ("edge_type", edge_type)):
            if value is not None:
                found = found.where(F.col(column) == value)
        return found

    # --- deleting ----------------------------------------------------------------

    def _without(self, victims: DataFrame) -> tuple[Graph, DataFrame, DataFrame]:
        """The graph without the nodes (_id) and the edges at them; both sets of victims."""
        gone = victims.select("_id").distinct()
        kept = {t: df.join(gone, df["id"] == gone["_id"], "left_anti") for t, df in self.nodes.items()}
        edge = self.edge
        by_from = edge.join(gone, edge["from_id"] == gone["_id"], "left_anti")
        left = by_from.join(gone, by_from["to_id"] == gone["_id"], "left_anti")
        dead_edges = edge.join(left.select("id"), "id", "left_anti")
        return replace(self, nodes=kept, edges=left), gone, dead_edges

    def _by_file(self, files: DataFrame, column: str, types: tuple[str, ...]) -> list[DataFrame]:
        return [self.node(t).join(files, F.col(column) == F.col("_file"), "left_semi").select(F.col("id").alias("_id")) for t in types]

    def delete_by_repository(self, repository: str) -> tuple[Graph, dict[str, int]]:
        """Nodes of the repository, nodes in its files, and all edges at these. Interactions name neither and stay."""
        direct = [self.node(t).where(F.col("repository") == repository).select(F.col("id").alias("_id")) for t in schema.NODES if "repository" in schema.node_schema(t).names]
        files = self.node("SourceFile").where(F.col("repository") == repository).select(F.col("id").alias("_file"))
        in_files = self._by_file(files, "sourceFileId", tuple(t for t in schema.NODES if "sourceFileId" in schema.node_schema(t).names))
        graph, gone, dead = self._without(reduce(DataFrame.unionAll, direct + in_files))
        return graph, {"nodes": gone.count(), "edges": dead.count()}

    def delete_by_file(self, repository: str, path: str) -> tuple[Graph, dict[str, int]]:
        """A file, nodes in it or declared in it, endpoints with evidence in it, and all edges at these."""
        files = self.node("SourceFile").where((F.col("repository") == repository) & (F.col("filePath") == path)).select(F.col("id").alias("_file"))
        victims = [files.select(F.col("_file").alias("_id"))]
        victims += self._by_file(files, "sourceFileId", tuple(t for t in schema.NODES if "sourceFileId" in schema.node_schema(t).names))
        victims += self._by_file(files, "declaredIn", ("DatabaseTable", "StateStore"))
        victims.append(self.node("APIEndpoint").where((F.col("repository") == repository) & (F.col("evidence.filePath") == path)).select(F.col("id").alias("_id")))
        graph, gone, dead = self._without(reduce(DataFrame.unionAll, victims))
        n = gone.count()
        return (graph, {"nodes": n, "edges": dead.count()}) if n else (self, {"nodes": 0, "edges": 0})

    # --- file hashes and settings ----------------------------------------------------

    def file_hashes(self, repository: str | None = None) -> DataFrame:
        found = self.hashes if self.hashes is not None else self.spark.createDataFrame([], HASHES)
        return found if repository is None else found.where(F.col("repository") == repository)

    def set_file_hashes(self, rows: DataFrame) -> Graph:
        both = self.file_hashes().withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
        return replace(self, hashes=last_write_wins(both, ["repository", "filePath"], ["_new", "updatedAt"]).drop("_new"))

    def delete_file_hashes(self, rows: DataFrame) -> Graph:
        return replace(self, hashes=self.file_hashes().join(rows, ["repository", "filePath"], "left_anti"))

    def set_meta(self, key: str, value: str) -> Graph:
        new = self.spark.createDataFrame([(key, value)], "key STRING, value STRING")
        old = self.meta.where(F.col("key") != key) if self.meta is not None else new.limit(0)
        return replace(self, meta=old.unionByName(new))

    def get_meta(self, key: str) -> str | None:
        row = None if self.meta is None else self.meta.where(F.col("key") == key).first()
        return row["value"] if row else None

    # --- tables under several names --------------------------------------------------

    def merge_aliased_tables(self) -> tuple[Graph, DataFrame]:
        """Inferred tables become the declared one they are an alias of; edges follow. Also (old_id, new_id)."""
        moved = alias_moves(self.node("DatabaseTable"))
        kept = self.node("DatabaseTable").join(moved, F.col("id") == F.col("old_id"), "left_anti")
        e = self.edge.join(moved.select(F.col("old_id").alias("_f"), F.col("new_id").alias("_nf")), F.col("from_id") == F.col("_f"), "left")
        e = e.join(moved.select(F.col("old_id").alias("_t"), F.col("new_id").alias("_nt")), F.col("to_id") == F.col("_t"), "left")
        columns = self.edge.columns
        e = e.withColumns({"from_id": F.coalesce("_nf", "from_id"), "to_id": F.coalesce("_nt", "to_id"), "_moved": F.col("_nf").isNotNull() | F.col("_nt").isNotNull()})
        # an edge that moves gets the id of its new content, so what has become the same edge is one
        e = e.withColumn("id", F.when(F.col("_moved"), ids.edge_id(columns)).otherwise(F.col("id"))).select(*columns)
        e = last_write_wins(e, ["id"], ["_ord"])
        return replace(self, nodes=self.nodes | {"DatabaseTable": kept}, edges=e), moved

    def prune_empty_systems(self) -> tuple[Graph, DataFrame]:
        """Without database systems that have no table; also the ids that went."""
        system, table = self.node("DatabaseSystem"), self.node("DatabaseTable")
        empty = system.join(table, system["id"] == table["systemId"], "left_anti").select(F.col("id").alias("_id"))
        graph, gone, _ = self._without(empty)
        return graph, gone

    def repositories(self) -> DataFrame:
        """Counts of the main node types for each repository, most source files first."""
        kinds = {"source_files": "SourceFile", "endpoints": "APIEndpoint", "callers": "ClientSideAPICaller", "processes": "ClientSideProcess"}
        rows = reduce(DataFrame.unionAll, [self.node(t).select("repository", F.lit(t).alias("t")) for t in kinds.values()])
        return rows.groupBy("repository").agg(*[F.count_if(F.col("t") == t).alias(k) for k, t in kinds.items()]).orderBy(F.desc("source_files"), "repository")

    # --- keeping -------------------------------------------------------------------

    def save(self, path: str) -> None:
        """Parquet: a folder a node type, edges partitioned by type."""
        for t in schema.NODES:
            self.node(t).write.mode("overwrite").parquet(f"{path}/nodes/{t}")
        meta = self.meta if self.meta is not None else self.spark.createDataFrame([], "key STRING, value STRING")
        meta.write.mode("overwrite").parquet(f"{path}/meta")
        self.edge.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")
        self.batch_list().write.mode("overwrite").parquet(f"{path}/batches")
        self.file_hashes().write.mode("overwrite").parquet(f"{path}/hashes")

    @classmethod
    def load(cls, spark: SparkSession, path: str, types: list[str] | None = None) -> Graph:
        read = {t: spark.read.parquet(f"{path}/nodes/{t}") for t in (types or list(schema.NODES))}
        return cls(spark, read, spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/batches"), spark.read.parquet(f"{path}/hashes"), spark.read.parquet(f"{path}/meta"))

    def keep(self) -> Graph:
        """The same graph with its frames checkpointed: short plans, and no work done twice."""
        return replace(self, nodes={t: keep(df) for t, df in self.nodes.items()}, edges=None if self.edges is None else keep(self.edges), batches=None if self.batches is None else keep(self.batches))

    def close(self) -> None:
        for df in (*self.nodes.values(), self.edges, self.batches):
            if df is not None:
                df.unpersist()


def alias_moves(tables: DataFrame) -> DataFrame:
    """(old_id, new_id) of inferred tables whose name is an alias of a declared table of their system.

    The first declared table, by (_ord, id), has an alias; a name that is itself declared stays.
    """
    declared = tables.where(F.col("declaredIn").isNotNull() & (F.col("declaredIn") != ""))
    names = declared.select("systemId", F.col("id").alias("new_id"), "_ord", F.explode(table_aliases(F.col("name"))).alias("name"))
    first = names.groupBy("systemId", "name").agg(F.min_by("new_id", F.struct("_ord", "new_id")).alias("new_id"))
    inferred = tables.where(F.col("declaredIn").isNull() | (F.col("declaredIn") == "")).select(F.col("id").alias("old_id"), "systemId", "name")
    open_ = inferred.join(declared.select("systemId", "name"), ["systemId", "name"], "left_anti")
    return open_.join(first, ["systemId", "name"]).where(F.col("old_id") != F.col("new_id")).select("old_id", "new_id")
