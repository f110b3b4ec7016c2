"""What the operators share: reading tables, the shared folder, cutting lineage."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers give freed memory back instead of keeping it for the next stage.
pa.set_memory_pool(pa.system_memory_pool())

#: Rows in an Arrow batch. Documents can be 100 KB and more, so batches stay small.
ARROW_ROWS = 512
#: Largest Long stands for a null doc_id in an order.
LAST = (1 << 63) - 1
#: Bits of a table of wanted keys, and rows that a table of counters is sent in: fixed sizes.
BITS = 1 << 25
SLICES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set; any path that Spark's readers can open."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds the memory of a Python worker: few rows in each Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    It is set here only where the session has none, as in tests on one machine.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if where is None:
        found = sc._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if where is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="flowloom-")
        sc.setCheckpointDir(where)
    return where


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone
        pass


def cut(df: DataFrame, kind: str = "table") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Cuts the lineage with files that outlive any executor; unlike ``checkpoint()`` the
    copy is columnar, so later reads take only the columns they need.
    """
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    del df  # else what it has shuffled stays until the next table
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out._flowloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df._flowloom_path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that no live frame needs: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(_row: a struct of all columns, _d, _th, _text): whatever the columns are called, they can't clash with others.

    _d is the doc_id (``LAST`` for null), _th a hash of the text (null: empty): together the key of a document.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("_row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("_d"), F.xxhash64(text).alias("_th"), text.alias("_text"))


def counters(rows: DataFrame, count: Callable, size: int, kind: type = np.int64) -> np.ndarray:
    """The sum over all tasks of a table of ``size`` counters that ``count(batch, table)`` adds to.

    Tables are summed slice by slice by as many tasks; what reaches the driver is one table.
    """
    width = -(-size // SLICES)

    def each(batches):
        total = np.zeros(size, kind)
        for batch in batches:
            count(batch, total)
        found = [(k, zlib.compress(part.tobytes(), 1)) for k in range(SLICES) if (part := total[k * width : (k + 1) * width]).any()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], ["k", "blob"])

    def summed(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(zlib.decompress(blob), kind)
                totals[k] = totals[k] + part if k in totals else part
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in totals.values()], pa.binary())], ["k", "blob"])

    out = np.zeros(size, kind)
    for k, blob in rows.mapInArrow(each, "k int, blob binary").repartition("k").mapInArrow(summed, "k int, blob binary").collect():
        part = np.frombuffer(zlib.decompress(blob), kind)
        out[k * width : k * width + len(part)] = part
    return out


class Bits:
    """A packed bit table, small to send to tasks."""

    def __init__(self, bits: np.ndarray):
        self.packed = zlib.compress(bits.tobytes(), 1)

    def array(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self.packed), np.uint8)


def bit_table(keys: DataFrame, place: Callable) -> Bits:
    """A table of ``BITS`` bits with one set for each row; ``place`` makes hashes from the columns' numpy arrays.

    It only saves shuffling: what it names is joined with the exact keys afterwards.
    """

    def run(batches):
        table_ = np.zeros(BITS // 8, np.uint8)
        for batch in batches:
            at = (place(*(c.to_numpy() for c in batch.columns)) % np.uint64(BITS)).astype(np.int64)
            np.bitwise_or.at(table_, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        width = BITS // 8 // SLICES
        found = [(k, part.tobytes()) for k in range(SLICES) if (part := table_[k * width : (k + 1) * width]).any()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([zlib.compress(b, 1) for _, b in found], pa.binary())], ["k", "blob"])

    def joined(batches):
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(zlib.decompress(blob), np.uint8)
                tables[k] = tables[k] | part if k in tables else part
        if tables:
            yield pa.RecordBatch.from_arrays([pa.array(list(tables), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in tables.values()], pa.binary())], ["k", "blob"])

    out = np.zeros(BITS // 8, np.uint8)
    for k, blob in keys.mapInArrow(run, "k int, blob binary").repartition("k").mapInArrow(joined, "k int, blob binary").collect():
        part = np.frombuffer(zlib.decompress(blob), np.uint8)
        out[k * len(part) : (k + 1) * len(part)] = part
    return Bits(out)


def has_bit(table_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes % np.uint64(BITS)).astype(np.int64)
    return (table_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def by_size(batches, column: int | Callable, limit: int = 4 << 20):
    """Slices of Arrow batches with at most ``limit`` bytes of text, or a single longer row; ``column`` is a number or gets the texts of a batch."""
    for batch in batches:
        texts = column(batch) if callable(column) else batch.column(column)
        sizes = pc.binary_length(texts).fill_null(0).to_pylist()
        first = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < len(sizes):
            yield batch.slice(first)


def hashed_sample(rows: DataFrame, key: str, size: int, count: int) -> DataFrame:
    """About ``size`` rows and at most that many, the ones whose key has the least hashes.

    ``count`` is the number of rows. The hash is first cut off where a few more rows than
    wanted remain in all tasks together, so no task sends on its own full sample.
    """
    top = 1 << 30
    bound = top if count <= size else min(top, int(top * (1.2 * size + 50) / count) + 1)
    return rows.where(F.pmod(F.xxhash64(key), F.lit(top)) < bound).orderBy(F.pmod(F.xxhash64(key), F.lit(top)), key).limit(size)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, where=None) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class`` documents for each of the labels 0 and 1.

    Labelled ids are chosen by a hash, so the sample is the same in every run. The list of
    ids is bounded by ``per_class`` and so safe to broadcast; the texts of that many
    documents are all that reaches the driver.
    """
    ok = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if where is not None:
        ok = ok.where(where)
    counts = {r["k"]: r["n"] for r in ok.groupBy(F.col(label).alias("k")).agg(F.count("*").alias("n")).collect()}
    chosen = []
    for k in (0, 1):
        ids = ok.where(F.col(label) == k).select(F.col("doc_id").alias("_id"), F.lit(k).alias("_label"))
        chosen.append(hashed_sample(ids, "_id", per_class, counts.get(k, 0)))
    ids = chosen[0].unionAll(chosen[1]).dropDuplicates(["_id"])
    # an id can be repeated: its least text stands for it
    rows = docs.select(F.col("doc_id").alias("_id"), text_or_empty().alias("_text")).join(F.broadcast(ids), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")).collect()
    rows.sort(key=lambda r: (r["_id"], r["_text"]))
    return [(r["_text"], r["_label"]) for r in rows]
