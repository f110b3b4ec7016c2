"""Operator 3, best-fit packing: a configuration linear program over the length histogram.

1. Tokenise: whole texts become ids of a public tokenizer and a closing id; longer ones are
   cut into pieces of ``CAPACITY``. Map-only; the pieces (not their ids) are written to the
   shared folder.
2. Plan: the histogram of piece lengths (``CAPACITY`` rows whatever the input) goes to the
   driver. The configuration program is to cover every length as often as it occurs by the
   least sum of configurations (contents of a sequence), in fractions. Multiplicative
   weights over the lengths price the configurations; an exact knapsack dynamic program
   finds the dearest one, which bounds the optimum from below, and the dearest completion of
   each length. Demand is covered in ``SLICES``: completions enter the solution with fractional
   amounts up to the slice's demand, longest lengths first, and lengths that lag behind become
   dearer; what is left in the end enters by best fit in fractions. The solution is rounded down to whole multiples,
   and what the rounding leaves is put by best fit decreasing into the room left. Work
   and plan size depend on the number of distinct lengths only, never on the number of documents.
3. Place: pieces of one length are ranked by (bucket, row number in the bucket) with bucket
   counts added up, so a length that a third of all rows share is ranked by many tasks.
   A piece's rank and the plan's table of that length give its sequence and offset.

Defined cases: null and empty texts are one piece that holds the closing id; a null
doc_id is packed like any other; repeated rows are packed each; other columns are ignored;
an empty table gives no row. Pieces of equal length are interchangeable; they are ranked by
doc_id, piece and checksum. A very long text is tokenised whole.
"""

from __future__ import annotations

import bisect
import os
import re
import unicodedata
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm.common import bound_batches, cut, table, text_or_empty

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Slices of the demand that are covered in turn, passes over each, and how fast lengths that lag behind become dearer.
SLICES, PASSES, RATE = 12, 3, 0.3
#: Entries that a task remembers of chunks and of tokens; memory bounds only.
MEMO_CHUNKS, MEMO_TOKENS = 250_000, 300_000

#: Fixed by the tokenizer file: its split pattern, special strings and the end of a word.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = "<|"
#: The same pattern for texts of ASCII and of Latin letters up to U+00FF only.
_SIMPLE_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_NOT_SIMPLE = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others come after U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Ids:
    """Token ids of whole texts as little-endian 32-bit bytes; the same ids as the tokenizer's ``encode``.

    The normaliser and splitter of the file never look across white space, so the ids of a
    text are those of its white-space-separated chunks; chunks and tokens are remembered.
    Texts with special strings or letters outside Latin-1 take the library's own path.
    """

    def __init__(self, name: str = TOKENIZER):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def _token(self, token: str) -> bytes:
        mapped = "".join(map(self.letters.__getitem__, token.encode()))
        found = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        if len(self.tokens) >= MEMO_TOKENS:
            self.tokens.clear()
        self.tokens[token] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        known = self.tokens
        found = b"".join([known.get(t) or self._token(t) for t in _SIMPLE_SPLIT.findall(chunk)])
        if len(self.chunks) >= MEMO_CHUNKS:
            self.chunks.clear()
        if len(chunk) <= 64:
            self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        if SPECIAL in text or _NOT_SIMPLE.search(text):
            normal = unicodedata.normalize("NFC", text)
            if SPECIAL in text or _NOT_SIMPLE.search(normal):
                return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            text = normal
        known = self.chunks
        return b"".join([known.get(c) or self._chunk(c) for c in text.lower().split()])


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER) -> DataFrame:
    """``PIECES`` of each row of ``docs`` (doc_id, text)."""
    bound_batches(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        ids = Ids(name)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = ids.encode(text) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


@dataclass(frozen=True)
class Plan:
    """For each length: from which rank on, which first sequence, copies a sequence, offset of the first copy."""

    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sequences: int
    tokens: int
    #: Sum of the fractional solution, and the lower bound that the prices prove.
    fractional: float = 0.0
    bound: float = 0.0

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, first, copies, offsets = self.tables[length]
        at = np.searchsorted(starts, ranks, "right") - 1
        q = ranks - starts[at]
        return first[at] + q // copies[at], offsets[at] + q % copies[at] * length


class _Knapsack:
    """0/1 program over lengths and their doubles; the best fill of every room up to the capacity."""

    def __init__(self, lengths, left, value, capacity):
        self.items = []
        for n in lengths:
            k = 1
            have = left[n]
            while have > 0 and k * n <= capacity:
                self.items.append((n, min(k, have)))
                have -= k
                k *= 2
        best = np.zeros(capacity + 1)
        self.taken = np.zeros((len(self.items), capacity + 1), bool)
        for i, (n, k) in enumerate(self.items):
            size = n * k
            if size > capacity:
                continue
            with_it = best[: capacity + 1 - size] + value[n] * k
            better = with_it > best[size:] + 1e-12
            self.taken[i, size:] = better
            best[size:] = np.where(better, with_it, best[size:])
        #: Of the dearest configuration.
        self.value = float(best[capacity])

    def fill(self, room: int) -> dict[int, int]:
        out: dict[int, int] = {}
        column = self.taken[:, room]
        top = len(self.items)
        while True:
            hit = np.flatnonzero(column[:top])
            if not len(hit):
                return out
            top = int(hit[-1])
            n, k = self.items[top]
            out[n] = out.get(n, 0) + k
            room -= n * k
            column = self.taken[:, room]


def fractional(need: dict[int, int], capacity: int = CAPACITY, slices: int = SLICES) -> tuple[list[tuple[dict[int, int], float]], float]:
    """A solution of the configuration program (configurations and amounts that cover each length exactly), and a lower bound of the optimum."""
    lengths = sorted(need)
    weight, covered = dict.fromkeys(lengths, 1.0), dict.fromkeys(lengths, 0.0)
    found: dict[tuple, float] = {}
    # prices are feasible for the dual once divided by the dearest configuration; pieces over half a sequence never share one
    bound = float(sum(c for n, c in need.items() if 2 * n > capacity))
    for r in range(slices):
        target = {n: need[n] * (r + 1) / slices for n in lengths}
        for _ in range(PASSES):
            open_ = [n for n in lengths if target[n] - covered[n] > 1e-9 * need[n]]
            if not open_:
                break
            price = {n: n * weight[n] / capacity for n in open_}
            program = _Knapsack(open_, need, price, capacity)
            if len(open_) == len(lengths):
                bound = max(bound, sum(need[n] * price[n] for n in open_) / program.value)
            for n in reversed(open_):
                config = program.fill(capacity - n)
                config[n] = config.get(n, 0) + 1
                amount = min((target[a] - covered[a]) / k for a, k in config.items())
                if amount > 0:
                    key = tuple(sorted(config.items()))
                    found[key] = found.get(key, 0.0) + amount
                    for a, k in key:
                        covered[a] += k * amount
        # lengths that lag behind become dearer
        for n in lengths:
            weight[n] *= float(np.exp(RATE * (1 - covered[n] / target[n])))
    rest = {n: need[n] - covered[n] for n in lengths if need[n] - covered[n] > 1e-9 * need[n]}
    return _best_fit([(dict(k), x) for k, x in found.items()], rest, capacity, whole=False), bound


def solve(histogram: dict[int, int], capacity: int = CAPACITY, slices: int = SLICES) -> Plan:
    """Configurations for the histogram, as few sequences as they come to."""
    need = {n: c for n, c in histogram.items() if c > 0}
    solution, bound = fractional(need, capacity, slices)
    merged: dict[tuple, float] = {}
    for config, amount in solution:
        key = tuple(sorted(config.items()))
        merged[key] = merged.get(key, 0.0) + amount
    left, taken = dict(need), []
    for key, amount in sorted(merged.items(), key=lambda x: (-x[1], x[0])):
        times = min([int(amount + 1e-9), *(left[n] // k for n, k in key)])
        if times > 0:
            taken.append((dict(key), times))
            for n, k in key:
                left[n] -= k * times
    plan = _plan(_best_fit(taken, left, capacity), capacity)
    return replace(plan, fractional=sum(merged.values()), bound=bound)


def _best_fit(taken, left, capacity, whole=True):
    """Adds the lengths left over, longest first, to the fullest configurations that have room; amounts are ``whole`` or fractions."""
    rooms: dict[int, list] = {}
    done = []

    def put(config, times):
        room = capacity - sum(a * b for a, b in config.items())
        if room:
            rooms.setdefault(room, []).append((config, times))
        else:
            done.append((config, times))

    for config, times in taken:
        put(config, times)
    for n in sorted(left, reverse=True):
        have = left[n]
        while have > 0:
            keys = sorted(rooms)
            at = bisect.bisect_left(keys, n)
            if at == len(keys):
                config, times, room = {}, have, capacity
            else:
                room = keys[at]
                config, times = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            if whole:
                each = min(room // n, have)
                use = min(times, have // each)
            else:
                each = room // n
                use = min(times, have / each)
            if times > use and config:
                put(config, times - use)
            put(config | {n: config.get(n, 0) + each}, use)
            have = 0 if use * each >= have else have - each * use
    return done + [x for group in rooms.values() for x in group]


def _plan(configs, capacity) -> Plan:
    parts: dict[int, list] = {}
    used: dict[int, int] = {}
    first = tokens = 0
    for config, times in configs:
        offset = 0
        for n in sorted(config, reverse=True):
            k = config[n]
            parts.setdefault(n, []).append((used.get(n, 0), first, k, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        tokens += offset * times
        first += times
    tables = {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in parts.items()}
    return Plan(tables, first, tokens)


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``: 0, 1, 2 ... among the pieces of a length; no length meets in one task."""
    buckets = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    inside = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("_r", F.row_number().over(inside) - 1)
    counts = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))).groupBy("length", "_b").agg(F.count("*").alias("_n"))
    # at most `buckets` rows a length
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("length").alias("_l"), F.col("_b").alias("_c"), "_s")
    return rows.join(starts, (rows["length"] == starts["_l"]) & (rows["_b"] == starts["_c"])).withColumn("rank", F.col("_r") + F.col("_s"))


PLACED = PIECES + ", sequence_id long, offset long"


def pack(docs: DataFrame, capacity: int = CAPACITY, slices: int = SLICES) -> DataFrame:
    """``PLACED``: where each piece of ``docs`` (doc_id, text) goes."""
    pieces = cut(tokenised(docs, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = solve(histogram, capacity, slices)

    def run(batches):
        for batch in batches:
            lengths = batch.column(3).to_numpy()
            ranks = batch.column(5).to_numpy()
            seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for n in np.unique(lengths):
                at = lengths == n
                seq[at], off[at] = plan.place(int(n), ranks[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], [c.split()[0] for c in PLACED.split(", ")])

    rows = ranked(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInArrow(run, PLACED)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
