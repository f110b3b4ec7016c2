"""Groups in tasks: whole groups of rows, sets that are compared in them, and connected components in and across tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import cut

#: Sets of a group that get bit rows, if these take no more than so many bytes.
MANY, BIT_ROWS = 12, 32 << 20
#: Elements of pairs that are compared at a time.
VERIFY = 1 << 20


def groups_of(batches, size_of=None, limit: int = 20_000):
    """Arrow tables of whole groups, many at a time: batches come sorted by their first column; ``size_of`` tells a batch's rows' sizes."""
    held, size = [], 0
    for batch in batches:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        if held and size > limit and keys[0] != held[-1].column(0)[-1].as_py():
            yield pa.Table.from_batches(held)
            held, size = [], 0
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        sizes = np.cumsum(size_of(batch) if size_of else np.ones(len(keys), np.int64))
        begin, last = 0, 0
        for e in edges.tolist():
            if size + sizes[e - 1] - last > limit:
                held.append(batch.slice(begin, e - begin))
                yield pa.Table.from_batches(held)
                held, size, begin, last = [], 0, e, sizes[e - 1]
        held.append(batch.slice(begin))
        size += sizes[-1] - last
    if held:
        yield pa.Table.from_batches(held)


class Union:
    """Components of numbers 0 to n - 1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        """The least number of each number's component."""
        up = self.up
        while True:
            further = up[up]
            if (further == up).all():
                return up
            up[:] = further

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Greater roots go below lesser ones until all pairs agree."""
        while True:
            root = self._own_roots()
            x, y = root[a], root[b]
            on = x != y
            if not on.any():
                return
            a, b, x, y = a[on], b[on], x[on], y[on]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))

    def _own_roots(self) -> np.ndarray:
        return Union.roots(self)


class Sets:
    """Sets in groups (rows sorted by ``key``), and how many elements two of a group have in common.

    ``elements`` are laid end to end, ``count`` of them for each set, distinct in a set. Groups of many
    sets are compared on bit rows of the elements that two of them have.
    """

    def __init__(self, elements: np.ndarray, count: np.ndarray, key: np.ndarray):
        _, self.local = np.unique(elements, return_inverse=True)
        self.count, self.starts = count, np.cumsum(count) - count
        #: Bit rows of each group of ``MANY`` sets or more, and where a set's row is.
        self.bits: list[np.ndarray] = []
        self.place = np.full((2, len(key)), -1)
        edges = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        for a, b in zip(edges, [*edges[1:], len(key)]):
            if b - a >= MANY:
                self._rows(a, b)

    def _rows(self, a: int, b: int) -> None:
        ids = self.local[self.starts[a] : self.starts[b - 1] + self.count[b - 1]]
        _, at, times = np.unique(ids, return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1
        width = int((times > 1).sum()) // 64 + 1
        if width * (b - a) * 8 > BIT_ROWS:
            return
        doc, on = np.repeat(np.arange(b - a), self.count[a:b]), times[at] > 1
        bits = np.zeros((b - a) * width, np.uint64)
        column = number[at[on]]
        np.bitwise_or.at(bits, doc[on] * width + (column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
        self.place[0, a:b], self.place[1, a:b] = len(self.bits), np.arange(b - a)
        self.bits.append(bits.reshape(b - a, width))

    def portions(self, a: np.ndarray, b: np.ndarray):
        """Pairs in portions of about ``VERIFY`` elements, those of a group with bit rows apart."""
        of = self.place[0, a]
        for k in np.unique(of).tolist():
            x, y = (a[of == k], b[of == k]) if (of != k).any() else (a, b)
            total = np.cumsum(self.count[x] + self.count[y] if k < 0 else np.full(len(x), self.bits[k].shape[1]))
            begin = 0
            while begin < len(x):
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + VERIFY)))
                yield x[begin:end], y[begin:end]
                begin = end

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the pairs of a portion."""
        k = int(self.place[0, x[0]])
        if k >= 0:
            return np.bitwise_count(self.bits[k][self.place[1, x]] & self.bits[k][self.place[1, y]]).sum(1, dtype=np.int64)
        sizes = np.concatenate((self.count[x], self.count[y]))
        at = np.repeat(np.concatenate((self.starts[x], self.starts[y])) - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        pair = np.repeat(np.concatenate((np.arange(len(x)), np.arange(len(x)))), sizes) << 32 | self.local[at]
        pair.sort()
        return np.bincount(pair[1:][pair[1:] == pair[:-1]] >> 32, minlength=len(x))


def components(links: DataFrame) -> DataFrame:
    """(_k, _c): the least key of the connected component of every key in the links (_a, _b).

    Large and small stars in turn: every round links a node's larger neighbours, then
    its neighbours up to itself, to the least of them; a node's number of links never
    grows in sum, and rounds grow with the logarithm of the longest path.
    """
    edges = cut(links.where("_a != _b").select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v")).distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        """The same for equal sets of edges."""
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)"))).first())

    now = mark(edges)
    for _ in range(40):
        both = edges.unionAll(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        least = both.groupBy("_u").agg(F.min("_v").alias("_m")).select("_u", F.least("_u", "_m").alias("_m"))
        # large star: larger neighbours go to the least
        large = both.join(least, "_u").where(F.col("_v") > F.col("_u")).select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).distinct()
        # small star: a node and its smaller neighbours go to the least of these
        small_m = large.groupBy("_u").agg(F.min("_v").alias("_m"))
        joined = large.join(small_m, "_u")
        small = joined.select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).unionAll(small_m.select("_u", F.col("_m").alias("_v"))).where("_u != _v").distinct()
        edges = cut(small, "edges")
        was, now = now, mark(edges)
        if was == now:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("_u").alias("_k"), F.col("_v").alias("_c")).unionAll(edges.select(F.col("_v").alias("_k"), F.col("_v").alias("_c"))).groupBy("_k").agg(F.min("_c").alias("_c"))
