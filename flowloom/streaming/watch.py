"""Continuous refresh: changed files as a stream, debounced, routed to repositories, diffed by hash.

A file source reports new files only, so removed ones come from comparing the listing in
``foreachBatch`` with what is known. A cycle that fails is reported and doesn't stop
the stream. Micro-batches queue while a cycle runs, so a repository that changes meanwhile
is refreshed again.
"""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import walk

log = logging.getLogger(__name__)
DEBOUNCE = "1 second"


def route(events: DataFrame, repositories: DataFrame) -> DataFrame:
    """Each event's path with the repository whose root is its longest prefix. ``repositories``: (repository, root).

    A path looks each of its folders up, so this is an equi-join however many repositories there are.
    """
    parts = F.split("path", "/", -1)
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    looked = events.where(F.size(parts) > 1).select("path", F.explode(folders).alias("_folder")).distinct()
    roots = repositories.select("repository", F.regexp_replace("root", "/+$", "").alias("_folder"))
    return looked.join(roots, "_folder").groupBy("path").agg(F.max_by("repository", F.length("_folder")).alias("repository"))


def debounced(events: DataFrame, gap: str = DEBOUNCE, late: str = "10 seconds") -> DataFrame:
    """(repository, start, end, n): bursts of events of a repository, each closed by a quiet gap."""
    s = events.withWatermark("ts", late).groupBy("repository", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("repository", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def refresh_stream(changes: DataFrame, refresh: Callable[[DataFrame], None], checkpoint: str, interval: str | None = DEBOUNCE):
    """Starts a query that calls ``refresh`` with the distinct dirty repositories of each cycle; ``interval=None`` handles what is there and ends."""

    def cycle(batch: DataFrame, number: int) -> None:
        try:
            dirty = batch.select("repository").distinct()
            if not dirty.isEmpty():
                refresh(dirty)
        except Exception:  # noqa: BLE001  one bad cycle must not end the watch
            log.exception("cycle %s failed", number)

    writer = changes.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()


def hash_cycle(known: DataFrame, listed: DataFrame) -> DataFrame:
    """States of all files: the listing against the known hashes, removed files included."""
    return walk.hash_diff(known, listed)


def hash_stream_once(spark: SparkSession, path: str) -> DataFrame:
    """Runs a file stream over ``path`` to its end; (repository, path, state) of what it held against nothing known."""
    schema = spark.read.parquet(path).schema
    where = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="flowloom-")
    base = f"{where.rstrip('/')}/stream-{uuid.uuid4().hex}"
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    rows = source.parquet(f"{folder}/{{{name},_none_}}") if not name.startswith("part-") else source.parquet(path)
    hashed = rows.select(F.col("source").alias("repository"), F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"))
    query = hashed.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    new = spark.read.schema(hashed.schema).parquet(f"{base}/out")
    return hash_cycle(new.limit(0), new)
