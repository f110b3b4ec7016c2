"""Lists that go from a handler to many rows, packed as bytes.

A list that each of a handler's rows needs is sent as often as there are rows, whatever the
plan. As rows of ids, or as text, it is shuffled, sorted and spilled at 7 to 30 bytes a member;
packed it takes 2 to 4, and is opened only in the task that makes the result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members that a group holds before they are merged, bytes of text in a batch of results.
MERGE, TEXT = 1 << 21, 1 << 23
#: Up to 200 partitions Spark's map tasks open a file for each.
ONE_FILE = 201


def spread(df: DataFrame, *keys: str, by_range: bool = False) -> DataFrame:
    """``df`` dealt by ``keys``, or ranges of them, to so many tasks that what a task makes or sorts stays in memory; not fewer where the rows are still short."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 24 * spark.sparkContext.defaultParallelism, ONE_FILE)
    return df.repartitionByRange(n, *keys) if by_range else df.repartition(n, *keys)


def pack(ids: np.ndarray) -> bytes:
    """Sorted int64: the width of a gap, the first, the gaps in so many bytes each."""
    gaps = np.diff(ids.view("<u8"))
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + ids[:1].tobytes() + gaps.view("u1").reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    gaps = np.frombuffer(blob, "u1", offset=9).reshape(-1, blob[0])
    wide = np.zeros((len(gaps) + 1, 8), "u1")
    wide[0] = np.frombuffer(blob, "u1", 8, 1)
    wide[1:, : blob[0]] = gaps
    return np.cumsum(wide.view("<u8").ravel(), dtype="u8").view("<i8")


def deflate(text: str) -> bytes:
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(text.encode()) + c.flush()


def inflate(blob: bytes) -> str:
    return zlib.decompress(blob, -15).decode()


def runs(batches, key: str):
    """(key or None, batch, whether the group goes on): the pieces of each group, of batches sorted by an integer key."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        column = b.column(key)
        null, ids = column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy()
        cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(null.view("i1")) != 0)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            now = (bool(null[start]), int(ids[start]))
            yield None if now[0] else now[1], b.slice(start, end - start), now == last
            last = now


def groups(batches, key: str, begin, add):
    """(key, state) of each group: ``begin()`` and then ``add(state, piece)`` for its pieces."""
    state, held = None, None
    for k, piece, same in runs(batches, key):
        if not same:
            if state is not None:
                yield held, state
            state, held = begin(), k
        add(state, piece)
    if state is not None:
        yield held, state


def batched(rows, schema: pa.Schema, size_of=lambda r: 0, most: int = 8192):
    """Tuples as batches of at most ``most`` rows and about TEXT bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += size_of(r)
        if len(held) >= most or size >= TEXT:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


class Union:
    """The number of different ids among packed lists; one list alone isn't opened."""

    def __init__(self):
        self.lists, self.n_lists, self.ids, self.size = [], 0, [], 0

    def add(self, blob: bytes) -> None:
        self.n_lists += 1
        if self.n_lists == 1:
            self.lists.append(blob)
            return
        for x in map(unpack, [*self.lists, blob]):
            self.ids.append(x)
            self.size += len(x)
        self.lists = []
        if self.size > MERGE and len(self.ids) > 1:
            self.ids = [np.unique(np.concatenate(self.ids))]
            self.size = 0  # what comes on top

    def __len__(self) -> int:
        if self.lists:
            return (len(self.lists[0]) - 9) // self.lists[0][0] + 1
        return len(np.unique(np.concatenate(self.ids)))


def impact(flows: DataFrame, touched: DataFrame) -> DataFrame:
    """(table_id, flows, processes, endpoints): how many of each end at a table.

    flows (handler_id, endpoint_id, process_id, caller_id), where an endpoint has one handler; touched
    (handler_id, table_id), each pair once; all ids are longs. Different handlers have different
    endpoints and flows, so their numbers add up; their processes may be the same, and are united
    from packed lists.
    """

    def lists(batches):
        def add(state, piece):
            state.append((np.unique(piece.column("process_id").to_numpy()), np.unique(piece.column("endpoint_id").to_numpy()), piece.num_rows))

        for k, parts in groups(batches, "handler_id", list, add):
            p, e, n = zip(*parts)
            yield k, sum(n), len(np.unique(np.concatenate(e))), pack(np.unique(np.concatenate(p)))

    def united(batches):
        def add(state, piece):
            state[0] += sum(piece.column("flows").to_pylist())
            state[1] += sum(piece.column("endpoints").to_pylist())
            for blob in piece.column("processes").to_pylist():
                state[2].add(blob)

        for k, (n, e, p) in groups(batches, "table_id", lambda: [0, 0, Union()], add):
            yield k, n, len(p), e

    listed = pa.schema([("handler_id", pa.int64()), ("flows", pa.int64()), ("endpoints", pa.int64()), ("processes", pa.binary())])
    result = pa.schema([("table_id", pa.int64()), ("flows", pa.int64()), ("processes", pa.int64()), ("endpoints", pa.int64())])
    whole = flows.select("handler_id", "endpoint_id", "process_id", "caller_id").repartition("handler_id").distinct().drop("caller_id").sortWithinPartitions("handler_id")
    of = whole.mapInArrow(lambda b: batched(lists(b), listed, lambda r: len(r[3])), "handler_id long, flows long, endpoints long, processes binary")
    sent = spread(touched, "handler_id").join(of, "handler_id").select("table_id", "flows", "endpoints", "processes")
    return spread(sent, "table_id", by_range=True).sortWithinPartitions("table_id").mapInArrow(lambda b: batched(united(b), result), "table_id long, flows long, processes long, endpoints long")


def nested(flows: DataFrame, texts: DataFrame) -> DataFrame:
    """(process_id, flows, n): each flow's head and its handler's text, or ``-``; sorted, with a space between.

    flows (process_id, head, handler_id): heads of a process that are the same have the same handler, and
    none is the beginning of another, so that heads sort as the whole would. texts (handler_id, text), each
    handler once. Ranges of processes, not hashes of them: where the ids of a handler's processes lie
    close together, its text goes to few tasks, and copies that follow each other are compressed away.
    """

    def small(batches):
        for b in batches:
            for k, text in zip(b.column("handler_id").to_pylist(), b.column("text")):
                yield k, deflate(text.as_py())

    def joined(batches):
        def add(state, piece):
            for head, blob in zip(piece.column("head").to_pylist(), piece.column("text").to_pylist()):
                state.append(head + ("-" if blob is None else inflate(blob)))

        for k, found in groups(batches, "process_id", list, add):
            yield k, " ".join(found), len(found)

    texted = pa.schema([("handler_id", pa.int64()), ("text", pa.binary())])
    result = pa.schema([("process_id", pa.int64()), ("flows", pa.string()), ("n", pa.int64())])
    of = texts.where("text IS NOT NULL").select("handler_id", "text").mapInArrow(lambda b: batched(small(b), texted, lambda r: len(r[1])), "handler_id long, text binary")
    # flows without a handler, a third or more, are dealt by what they are
    keyed = flows.select("process_id", "head", F.coalesce("handler_id", F.pmod(F.xxhash64("process_id", "head"), F.lit(4096))).alias("_h"), F.col("handler_id").isNull().alias("_none"))
    of = of.select(F.col("handler_id").alias("_h"), F.lit(False).alias("_none"), "text")
    sent = spread(keyed, "_h", "_none").join(of, ["_h", "_none"], "left").select("process_id", "head", "text")
    return spread(sent, "process_id", by_range=True).sortWithinPartitions("process_id", "head").mapInArrow(lambda b: batched(joined(b), result, lambda r: len(r[1])), "process_id long, flows string, n long")
