"""Operator 1, suffix-array dedup: every repeated string of ``LENGTH`` bytes goes, by run-length indexes.

The bytes to remove are those covered by a string of ``LENGTH`` bytes that also starts
anywhere else in the corpus. One index of 100 TB can't be built or streamed, so the
corpus is first cut down, without loss, to pieces that can hold such a string:

1. Anchors. Of the ``SPAN`` k-grams in any string of ``LENGTH`` bytes, the one with the least
   hash (the rightmost of ties) is the string's anchor: equal strings have equal anchors at
   the same place. An anchor k-gram that the corpus has once can't lie in a repeat.
2. Windows. For other anchors, the window holds every string with that anchor: up to
   ``LENGTH`` bytes from the anchor's start and ``LENGTH - K`` before it. Equal windows
   collapse to one with a count by an aggregate with map-side combine, however many
   documents share a passage. A window found twice is removed whole.
3. Index. The distinct windows of an anchor with two or more are indexed together: suffix
   array by prefix doubling, Burrows-Wheeler transform, its runs, and the suffix array
   sampled at run ends. The longest match of the suffix at a run's head is compared byte
   by byte; all others follow by streaming the text, one less at each step (a suffix inside
   a run extends to the left as its neighbour does). What matches ``LENGTH`` bytes or more is
   marked. Windows of a document that overlap are joined first, so no byte matches itself.
4. An anchor with more than ``GROUP`` distinct windows (a very common passage whose
   contexts all differ) isn't put into one task: its windows are grouped by the ``HALF``
   bytes on either side of the anchor, one side of which any match has in common. A group
   that is still too large is cut into blocks of ``GROUP`` windows, and the index is built
   for each two blocks: a task holds as much however large the group is.
5. The marks go back to all places of their window by an equi-join that Spark can split,
   and are merged in each document.

Anchors that can repeat are told to the tasks as a bit table of fixed size, which only
saves shuffling: exact keys are counted again afterwards.

Defined cases: null is the empty text; texts shorter than ``LENGTH`` bytes lose nothing;
repeated rows repeat each other; a null doc_id keeps its row; other columns are ignored;
an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import bound_batches, by_size, cut, discard, table, text_or_empty

LENGTH = 200
K = 50
SPAN = LENGTH - K + 1
#: Distinct windows of an anchor that are indexed together; more are cut into blocks.
GROUP = 3000
#: Bytes next to an anchor by which the windows of a very common one are told apart.
HALF = (LENGTH - K) // 2
#: Bytes of windows that are indexed at a time.
BLOCK = 1 << 20
#: Bits of the table of anchors that can repeat: a fixed size.
BITS = 1 << 25
#: Bytes of texts that are hashed at a time; small enough for a processor's cache.
SLICE = 80 << 10
#: Longest stretch of a text that is searched for anchors at a time.
STRETCH = 16 << 20
_POS = 26
LAST = (1 << 63) - 1
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2 ** 64."""
    if len(_POWERS.get("up", ())) < n:
        m = max(n, 1 << 19)
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


_LETTER = _mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors in ``data``, texts that end at ``ends`` laid end to end."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _powers(n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * up)))
    grams = _mix((total[K:] - total[:-K]) * down[: n - K + 1])
    mask = (1 << _POS) - 1
    least = (grams & _U(~mask & (2**64 - 1))) | (_U(mask) - np.arange(len(grams), dtype=np.uint64))
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = SPAN - width
    least = np.minimum(least[: len(least) - rest], least[rest:])
    # strings that begin in one text and end in another don't count
    starts = np.concatenate(([0], ends[:-1]))
    edge = np.zeros(n + 1, np.int32)
    sizes = ends - starts
    whole = sizes >= LENGTH
    np.add.at(edge, starts[whole], 1)
    np.add.at(edge, ends[whole] - LENGTH + 1, -1)
    valid = np.cumsum(edge)[: len(least)] > 0
    places = np.unique(mask - (least[valid] & _U(mask)).astype(np.int64))
    return places, grams[places]


def _text_anchors(texts: list[bytes]):
    """(text number, place, hash) arrays over all texts."""
    out = []
    for first, group in _stretches(texts):
        data = np.frombuffer(b"".join(x for _, _, x in group), np.uint8)
        ends = np.cumsum([len(x) for _, _, x in group])
        at, h = anchors(data, ends)
        which = np.searchsorted(ends, at, "right")
        number = np.array([i for i, _, _ in group])
        offset = np.array([o for _, o, _ in group])
        begin = np.concatenate(([0], ends[:-1]))
        out.append((number[which], at - begin[which] + offset[which], h))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, place, h = (np.concatenate(x) for x in zip(*out))
    if any(len(t) > STRETCH for t in texts):  # stretches overlap: an anchor can be found twice
        _, at = np.unique(np.stack([doc, place], 1), axis=0, return_index=True)
        doc, place, h = doc[at], place[at], h[at]
    return doc, place, h


def _stretches(texts: list[bytes]):
    group, held = [], 0
    for i, t in enumerate(texts):
        for o in range(0, max(1, len(t) - LENGTH + 1), STRETCH):
            part = t[o : o + STRETCH + LENGTH - 1]
            if held and held + len(part) > STRETCH:
                yield 0, group
                group, held = [], 0
            group.append((i, o, part))
            held += len(part)
    if group:
        yield 0, group


def _bit_table(rows: DataFrame, column: str) -> bytes:
    """A packed table of ``BITS`` bits with the bit of each value's remainder set."""
    hits = rows.selectExpr(f"pmod({column}, {BITS}) AS w").selectExpr("w div 8 AS at", "shiftleft(1, cast(w % 8 AS int)) AS bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(BITS // 8, np.uint8)
    bits[hits.column("at").to_numpy()] = hits.column("bits").to_numpy().astype(np.uint8)
    return zlib.compress(bits.tobytes(), 1)


def _has(table_: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.view(np.int64) % BITS
    return (table_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


HITS = "_a long, _w1 long, _w2 long, _d long, _th long, _pos int"


def _window(text: bytes, place: int) -> bytes:
    """The window of an anchor, led by how much of it lies before the anchor."""
    left = min(place, LENGTH - K)
    return bytes((left,)) + text[place - left : place + LENGTH]


def repeated_anchors(keyed: DataFrame) -> DataFrame:
    """(_a) of the anchors that the corpus has twice or more."""

    def run(batches):
        for batch in by_size(batches, 2, SLICE):
            _, _, h = _text_anchors([t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()])
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["_a"])

    return keyed.mapInArrow(run, "_a long").groupBy("_a").agg(F.count("*").alias("_n")).where("_n > 1").select("_a")


def windows(keyed: DataFrame, packed: bytes) -> DataFrame:
    """``HITS``: the places of anchors that the bit table has, with a hash of the window."""

    def run(batches):
        table_ = np.frombuffer(zlib.decompress(packed), np.uint8)
        for batch in by_size(batches, 2, SLICE):
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            doc, place, h = _text_anchors(texts)
            hit = _has(table_, h)
            doc, place, h = doc[hit], place[hit], h[hit]
            if not len(h):
                continue
            w = np.frombuffer(b"".join([xxhash.xxh3_128_digest(_window(texts[i], p)) for i, p in zip(doc.tolist(), place.tolist())]), np.int64).reshape(-1, 2)
            pick = pa.array(doc)
            cols = [pa.array(h.view(np.int64)), pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), batch.column(0).take(pick), batch.column(1).take(pick), pa.array(place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in HITS.split(", ")])

    return keyed.mapInArrow(run, HITS)


def _window_bytes(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (_a, _w1, _w2, _d, _th, _pos, ...) with ``_left`` and ``_bytes`` of the window."""
    packed = _bit_table(wanted.select(F.xxhash64("_th", "_pos").alias("_x")), "_x")

    def run(batches):
        table_ = np.frombuffer(zlib.decompress(packed), np.uint8)
        for batch in by_size(batches, 2, SLICE):
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            doc, place, _ = _text_anchors(texts)
            th = batch.column(1).to_numpy()[doc] if len(doc) else np.zeros(0, np.int64)
            hit = _has(table_, _place_hash(th, place))
            doc, place = doc[hit], place[hit]
            if len(doc):
                found = [_window(texts[i], p) for i, p in zip(doc.tolist(), place.tolist())]
                pick = pa.array(doc)
                cols = [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(place.astype(np.int32)), pa.array([x[0] for x in found], pa.int32()), pa.array([x[1:] for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["_d", "_th", "_pos", "_left", "_bytes"])

    found = keyed.mapInArrow(run, "_d long, _th long, _pos int, _left int, _bytes binary").dropDuplicates(["_d", "_th", "_pos"])
    return wanted.join(found, ["_d", "_th", "_pos"])


def _place_hash(th: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64(_th, _pos)`` for a long and an int, seed 42."""
    p1, p2, p3, p4, p5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def rotl(x, r):
        return (x << _U(r)) | (x >> _U(64 - r))

    def last(h):
        h = (h ^ (h >> _U(33))) * p2
        h = (h ^ (h >> _U(29))) * p3
        return h ^ (h >> _U(32))

    h = np.full(len(th), (42 + int(p5) + 8) % 2**64, np.uint64)
    h = h ^ (rotl(th.view(np.uint64) * p2, 31) * p1)
    h = last(rotl(h, 27) * p1 + p4)
    h = h + p5 + _U(4)
    h = h ^ ((place.astype(np.int64).view(np.uint64) & _U(0xFFFFFFFF)) * p1)
    return last(rotl(h, 23) * p2 + p3)


def _ranks(keys: np.ndarray) -> np.ndarray:
    """For each key, how many are less."""
    order = np.argsort(keys)
    s = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.maximum.accumulate(np.where(np.concatenate((np.ones(min(1, len(s)), bool), s[1:] != s[:-1])), np.arange(len(s)), 0))
    return out


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler index of pieces; pieces of different groups don't match."""

    def __init__(self, pieces: list[bytes], groups: list[int]):
        self.ends = np.cumsum([len(p) for p in pieces])
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(self.data)
        piece = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        self.left = self.ends[piece] - np.arange(n)  # bytes to the piece's end
        self.first = np.concatenate(([True], piece[1:] != piece[:-1])) if n else np.zeros(0, bool)
        self.group = np.array(groups)[piece] if n else np.zeros(0, np.int64)
        padded = np.concatenate((self.data, np.zeros(8, np.uint8))).astype(np.uint64)
        eight = np.zeros(n, np.uint64)
        for k in range(8):
            inside = self.left > k
            eight |= np.where(inside, padded[k : n + k], 0).astype(np.uint64) << _U(56 - 8 * k)
        self.eight = eight
        self._sort()

    def _sort(self):
        """Suffix array by prefix doubling over whole pieces; equal suffixes come in the order of their pieces.

        A rank is the number of suffixes that are less, so a tied group is refined on its own:
        only suffixes that still tie are sorted again.
        """
        n = len(self.data)
        short = np.minimum(self.left, 8)
        rank = _ranks((self.group * (n + 1) + _ranks(self.eight)) * 9 + short)
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1) if n else rank
        h = 8
        while len(tied) and h < self.left.max():
            after = np.where(self.left[tied] > h, rank[np.minimum(tied + h, n - 1)] + 1, 0)
            both = rank[tied] * (n + 1) + after
            order = np.argsort(both)
            tied, both = tied[order], both[order]
            was = rank[tied]
            i = np.arange(len(tied))
            fresh = np.concatenate(([True], both[1:] != both[:-1]))
            old = np.concatenate(([True], was[1:] != was[:-1]))
            rank[tied] = was + np.maximum.accumulate(np.where(fresh, i, 0)) - np.maximum.accumulate(np.where(old, i, 0))
            tied = tied[~(fresh & np.concatenate((fresh[1:], [True])))]
            h *= 2
        order = np.argsort(rank * (n + 1) + np.arange(n))
        self.sa = order
        before = self.data[np.maximum(order - 1, 0)].astype(np.int64) if n else np.zeros(0, np.int64)
        bwt = np.where(self.first[order], 256 + np.arange(n), before)  # a piece's first byte has nothing before it
        group = self.group[order]
        #: Heads of the runs: elsewhere the match follows from the place before.
        self.head = np.concatenate(([True], (bwt[1:] != bwt[:-1]) | (group[1:] != group[:-1]))) if n else np.zeros(0, bool)

    def _common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at p and q have in common."""
        most = np.minimum(self.left[p], self.left[q])
        out = np.zeros(len(p), np.int64)
        on = np.arange(len(p))
        step = 0
        while len(on):
            x = self.eight[p[on] + step] ^ self.eight[q[on] + step]
            same = x == 0
            lead = np.full(len(on), 8)
            if (~same).any():
                y = x[~same]
                count = np.zeros(len(y), np.int64)
                for k in range(1, 8):
                    count += (y >> _U(64 - 8 * k)) == 0
                lead[~same] = count
            out[on] += lead
            step += 8
            on = on[same & (most[on] > step)]
        return np.minimum(out, most)

    def matching(self) -> np.ndarray:
        """For each place, the longest match with a suffix at another place of its group."""
        n = len(self.data)
        plcp = np.full(n, -1, np.int64)
        if not n:
            return plcp
        at = np.flatnonzero(self.head)
        group = self.group[self.sa]
        paired = at[(at > 0) & (group[at] == group[np.maximum(at - 1, 0)])]
        plcp[self.sa[at]] = 0
        plcp[self.sa[paired]] = self._common(self.sa[paired], self.sa[paired - 1])
        # streaming the text: one less than at the place before, until the next sampled place
        known = plcp >= 0
        last = np.maximum.accumulate(np.where(known, np.arange(n), 0))
        plcp = np.maximum(plcp[last] - (np.arange(n) - last), 0)
        lcp = plcp[self.sa]
        lcp[1:][group[1:] != group[:-1]] = 0
        lcp[0] = 0
        out = np.empty(n, np.int64)
        out[self.sa] = np.maximum(lcp, np.concatenate((lcp[1:], [0])))
        return out


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


MARKS = "_a long, _w1 long, _w2 long, _from array<int>, _to array<int>"


def _mark(rows: list[tuple]) -> list[tuple]:
    """``MARKS`` of the single windows among (group, w1, w2, d, th, pos, left, bytes, n, a) rows that hold whole groups."""
    rows.sort(key=lambda r: (r[0], r[3], r[4], r[5]))
    pieces: list[bytes] = []
    groups, where, group = [], [], -1
    last = None
    for a, _, _, d, th, pos, left, data, _, _ in rows:
        begin = pos - left
        if last is None or last[0] != a:
            group += 1
        if last and last[:3] == (a, d, th) and begin <= last[4]:  # overlaps the window before: one piece
            piece_begin = last[3]
            more = begin + len(data) - last[4]
            if more > 0:
                pieces[-1] += data[-more:]
            end = max(last[4], begin + len(data))
        else:
            pieces.append(data)
            groups.append(group)
            piece_begin, end = begin, begin + len(data)
        where.append((len(pieces) - 1, begin - piece_begin, len(data), left))
        last = (a, d, th, piece_begin, end)
    index = RunLengthIndex(pieces, groups)
    match = index.matching()
    long_ = np.flatnonzero(match >= LENGTH)
    edge = np.zeros(len(match) + 1, np.int32)
    np.add.at(edge, long_, 1)
    np.add.at(edge, long_ + match[long_], -1)
    covered = np.cumsum(edge)[:-1] > 0
    begins = np.concatenate(([0], index.ends[:-1])) if pieces else []
    out = []
    for (_, w1, w2, *_, n, a), (piece, off, size, left) in zip(rows, where):
        if n > 1:
            continue
        at = begins[piece] + off
        if covered[at : at + size].any():
            runs = _runs(covered[at : at + size])
            out.append((a, w1, w2, [x - left for x, _ in runs], [y - left for _, y in runs]))
    return out


def _batch(rows: list[tuple], schema: str, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in schema.split(", ")])


def split_groups(large: DataFrame) -> DataFrame:
    """Windows of anchors with very many, dealt to groups (_g) of at most ``2 * GROUP`` or so that an index takes.

    A string that holds the anchor has ``HALF`` bytes or more before it or after it. Windows
    with equal bytes there are a group; a window alone in both of its groups has no match.
    A group still over ``GROUP`` is cut into blocks, and each two blocks are indexed together.
    """
    before = F.when(F.col("_left") >= HALF, F.xxhash64(F.expr(f"substring(_bytes, _left - {HALF - 1}, {HALF + K})")))
    after = F.when(F.octet_length("_bytes") - F.col("_left") >= HALF + K, F.xxhash64(F.expr(f"substring(_bytes, _left + 1, {HALF + K})")))
    sides = large.withColumn("_s", F.explode(F.array(F.struct(F.lit(0).alias("k"), before.alias("h")), F.struct(F.lit(1).alias("k"), after.alias("h"))))).where("_s.h IS NOT NULL")
    sides = sides.withColumn("_g", F.xxhash64("_a", "_s.k", "_s.h")).drop("_s")
    sizes = sides.groupBy("_g").agg(F.count("*").alias("_size")).where("_size > 1")
    both = sides.join(sizes, "_g").withColumn("_blocks", F.ceil(F.col("_size") / GROUP).cast("int"))
    own = F.pmod(F.xxhash64("_w1", "_w2"), F.col("_blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.xxhash64("_g", F.least(own, j), F.greatest(own, j)))
    return both.withColumn("_g", F.explode(cells)).drop("_size", "_blocks")


def indexed_marks(grouped: DataFrame) -> DataFrame:
    """``MARKS`` from the index; each group's (_g) rows are in one task, at most ``GROUP`` of them."""
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int32())] * 2

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > BLOCK and row[0] != held[-1][0]:
                    if out := _mark(held):
                        yield _batch(out, MARKS, kinds)
                    held, size = [], 0
                held.append(row)
                size += len(row[7])
        if held and (out := _mark(held)):
            yield _batch(out, MARKS, kinds)

    rows = grouped.select("_g", "_w1", "_w2", "_d", "_th", "_pos", "_left", "_bytes", "_n", "_a").repartition("_g").sortWithinPartitions("_g")
    return rows.mapInArrow(run, MARKS)


def removed_spans(keyed: DataFrame) -> DataFrame:
    """(_d, _th, _spans: merged array of (s, e), the last of which may reach beyond the text) of documents that lose bytes."""
    bound_batches(keyed.sparkSession)
    keyed = keyed.select("_d", "_th", "_text")
    hits = cut(windows(keyed, _bit_table(repeated_anchors(keyed), "_a")), "hits")
    place = F.struct("_d", "_th", "_pos")
    distinct = cut(hits.groupBy("_a", "_w1", "_w2").agg(F.count("*").alias("_n"), F.min(place).alias("_at")), "windows")
    # windows found twice go whole; they are indexed only as partners of single ones
    anchors_ = distinct.groupBy("_a").agg(F.count("*").alias("_kinds"), F.min("_n").alias("_least")).where("_kinds > 1 AND _least = 1")
    several = cut(distinct.join(anchors_, "_a").select("_a", "_w1", "_w2", "_n", "_kinds", "_at.*"), "several")
    texts = cut(_window_bytes(keyed, several), "texts")
    whole = F.array(F.lit(K - LENGTH)), F.array(F.lit(LENGTH))
    marks = distinct.where("_n > 1").select("_a", "_w1", "_w2", whole[0].alias("_from"), whole[1].alias("_to"))
    found = indexed_marks(texts.where(F.col("_kinds") <= GROUP).withColumn("_g", F.col("_a")))
    large = texts.where(F.col("_kinds") > GROUP)
    if not large.isEmpty():  # the marks of a window's cells are gathered again
        found = found.unionByName(indexed_marks(split_groups(large)))
        found = found.groupBy("_a", "_w1", "_w2").agg(F.collect_set(F.struct("_from", "_to")).alias("_x"))
        found = found.select("_a", "_w1", "_w2", F.flatten("_x._from").alias("_from"), F.flatten("_x._to").alias("_to"))
    found = cut(found, "marks")
    discard(several, texts)
    marks = marks.unionByName(found)
    # a window has up to two rows of marks, both bounded by the window's length
    found = hits.join(marks, ["_a", "_w1", "_w2"])
    spans = F.arrays_zip(F.transform("_from", lambda x: F.greatest(x + F.col("_pos"), F.lit(0))).alias("s"), F.transform("_to", lambda x: x + F.col("_pos")).alias("e"))
    spans = found.select("_d", "_th", F.explode(spans).alias("_x")).groupBy("_d", "_th").agg(F.collect_set("_x").alias("_spans"))

    def merged(batches):
        for batch in batches:
            x = batch.column(2)
            flat, sizes = x.flatten(), x.value_lengths().to_numpy()
            start, end = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((start, doc))
            start, end, doc = start[order], end[order], doc[order]
            # a span begins where the reach of all before it in its document ends
            shift = doc << 40
            reach = np.maximum.accumulate(end + shift)
            fresh = np.concatenate(([True], start[1:] + shift[1:] > reach[:-1]))
            at = np.flatnonzero(fresh)
            ends = np.maximum.reduceat(end, at)
            counts = np.bincount(doc[at], minlength=len(sizes))
            kind = pa.struct([("s", pa.int32()), ("e", pa.int32())])
            pairs = pa.StructArray.from_arrays([pa.array(start[at].astype(np.int32)), pa.array(ends.astype(np.int32))], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["_d", "_th", "_spans"])

    return spans.mapInArrow(merged, "_d long, _th long, _spans array<struct<s:int,e:int>>")


def dedup_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, _text, _n_bytes and _merged: the spans (s, e) of bytes that go, in order, apart from each other."""
    bound_batches(docs.sparkSession)
    text = text_or_empty()
    keyed = docs.withColumns({"_d": F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)), "_th": F.xxhash64(text), "_text": text})
    joined = keyed.join(removed_spans(keyed), ["_d", "_th"], "left")
    n = F.octet_length("_text")
    spans = F.coalesce("_spans", F.from_json(F.lit("[]"), "array<struct<s:int,e:int>>"))
    inside = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.least(x["e"], n).alias("e")))
    return joined.select(*docs.columns, "_text", n.cast("long").alias("_n_bytes"), inside.alias("_merged"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def run(batches):
        for batch in by_size(batches, 1):
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                data, at, sha, gone = text.encode("utf-8", "surrogatepass"), 0, hashlib.sha256(), 0
                for span in spans:
                    sha.update(data[at : span["s"]])
                    gone += span["e"] - span["s"]
                    at = span["e"]
                sha.update(data[at:])
                rows.append((gone, len(spans), sha.hexdigest()))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    rows = found.select(F.col("doc_id").cast("long").alias("doc_id"), "_text", "_n_bytes", "_merged")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
