"""Operator 8, MinHash near-dedup: BagMinHash signatures, bands, verified multiset overlap.

A document is the bag of its five-word shingles (lower-case chunks between white space; a
shorter text is one shingle). Two documents are near copies when the weighted Jaccard
similarity of their bags is at least ``THRESHOLD``; classes are the connected components.

BagMinHash: the weight axis is cut into dyadic ranges (0,1], (1,2], (2,4], (4,8] ... Each
shingle has a Poisson process on each range with the range's width as its rate, so an
element of weight w owns the whole ranges below w and, of the range that holds w, the
points whose cell, found by halving, is at most w. A point has a time and a component of
the signature; a component keeps its least time. Times are made in rounds, and a
process stops once its time passes the document's largest component: the components
collide with a probability equal to the weighted Jaccard similarity. Everything is done
for many documents at once in numpy.

Candidates share one of ``BANDS`` bands of ``ROWS`` components and agree in ``AGREE`` of the
``COMPONENTS`` at least (a similarity of 0.8 falls short of that once in 50 million). No
candidate is dropped, and no pair of documents is ever a row:

1. Equal bags collapse into one, whatever the number of copies.
2. Families: in each band, documents that candidates connect are linked to one of them, so
   links grow with the documents. A band value of more than ``CROWD`` documents makes one
   family of them all, by an aggregate.
3. A family's documents are sent to a task, in blocks of ``BLOCK`` with the family's first
   document in each. Candidates are compared there on all their shingles, unless they are in a
   component already; out come the links that join components.
4. In a family of several blocks, the documents outside its largest component meet, block by
   block, each other and those inside: that is all that can still be linked.
5. Every document gets the class of its component.

Equality of shingles is that of 64-bit hashes.

Defined cases: texts without words are classes of their own; a null doc_id sorts last; rows
with equal doc_id and text are one document; a very long text is taken whole; other columns
are ignored; no row gives none.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import LAST, bit_table, bound_batches, by_size, cut, discard, has_bit, keyed_rows, table
from flowloom.llm.groups import Sets, Union, components, groups_of
from flowloom.llm.words import mix as _mix
from flowloom.llm.words import word_hashes

THRESHOLD = 0.8
SHINGLE = 5
BANDS, ROWS = 16, 4
COMPONENTS = BANDS * ROWS
#: Components in which candidates agree at least.
AGREE = 33
#: Documents with a band value that are paired in one place; more make a family without that.
CROWD = 4096
#: Documents of a family that are compared in one place.
BLOCK = 1024
#: Bytes of text that are read at a time.
SLICE = 1 << 20
_U = np.uint64


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1) * 2.0**-53


def bag_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, components: int = COMPONENTS) -> np.ndarray:
    """n_docs x components: least times of the BagMinHash processes.

    ``doc`` numbers the documents from 0 and each has an element; ``element`` are hashes, distinct in a document.
    """
    out = np.full(n_docs * components, np.inf)
    # whole ranges and the one that holds the weight: level 0 is (0, 1], level k is (2 ** (k - 1), 2 ** k]
    top = np.ceil(np.log2(weight)).astype(np.int64)
    top = np.where(weight == 1, 0, top)
    rows = np.repeat(np.arange(len(doc)), top + 1)
    level = np.arange(len(rows)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    doc, element, weight = doc[rows], element[rows], weight[rows]
    low = np.where(level == 0, 0, 2 ** np.maximum(level - 1, 0))
    width = np.where(level == 0, 1, low)
    seed = _mix(element + _U(0x9E3779B97F4A7C15) * (level.astype(np.uint64) + _U(1)))
    time = np.zeros(len(seed))
    point = 0
    while len(seed):
        point += 1
        r = _mix(seed + _U(0xD1B54A32D192ED03 * point % 2**64))
        time = time - np.log(_uniform(r)) / width
        r = _mix(r + _U(0x8CB92BA72F3D8DD7))
        # the point's cell in its range, found by halving: the leading bits of a uniform number
        cell = low + 1 + np.minimum((_uniform(_mix(r)) * width).astype(np.int64), width - 1)
        mine = cell <= weight
        np.minimum.at(out, doc[mine] * components + (r[mine] % _U(components)).astype(np.int64), time[mine])
        limit = out.reshape(n_docs, components).max(1)
        on = time <= limit[doc]
        doc, seed, time, weight, low, width = doc[on], seed[on], time[on], weight[on], low[on], width[on]
    return out.reshape(n_docs, components)


def shingles_of(text: str) -> Counter:
    words = text.lower().split()
    if len(words) < SHINGLE:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[k:] for k in range(SHINGLE))))


def overlap(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity."""
    if len(a) > len(b):
        a, b = b, a
    same = sum(min(n, b[x]) for x, n in a.items() if x in b)
    total = sum(a.values()) + sum(b.values()) - same
    return same / total if total else 0.0


def bags_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of the distinct shingles of each text, sorted, and how many shingles each text has."""
    w, n = word_hashes(texts, trimmed=False)
    # a short text's one shingle: its words and then nothing
    count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), count)
    first = np.arange(len(doc)) + np.repeat((np.cumsum(n) - n) - (np.cumsum(count) - count), count)
    whole = n[doc] >= SHINGLE
    h = np.zeros(len(doc), np.uint64)
    for k in range(SHINGLE):
        at = np.minimum(first + k, len(w) - 1)
        x = w[at] if whole.all() else np.where(whole | (k < n[doc]), w[at], _U(k + 1))
        h = _mix(h * _U(0x9E3779B97F4A7C15) + x)
    order = np.argsort(doc.astype(np.uint64) << _U(46) | h >> _U(18))
    h, doc = h[order], doc[order]
    fresh = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))))
    weight = np.diff(np.concatenate((fresh, [len(h)])))
    return doc[fresh], h[fresh], weight, count


SIGNED = "_d long, _th long, _g1 long, _g2 long, _n long, _bands array<long>, _sig binary"


def signed(keyed: DataFrame) -> DataFrame:
    """``SIGNED`` of each document (_d, _th, _text): its bag's hash and size (0: no words), its bands, and a byte of each component."""

    def run(batches):
        for batch in by_size(batches, 2, SLICE):
            doc, h, weight, count = bags_of(batch.column(2))
            at, bare = np.flatnonzero(count), pa.array(np.flatnonzero(count == 0))
            if len(bare):
                zeros = pa.array(np.zeros(len(bare), np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(bare), batch.column(1).take(bare), zeros, zeros, zeros, pa.nulls(len(bare), pa.list_(pa.int64())), pa.nulls(len(bare), pa.binary())], [c.split()[0] for c in SIGNED.split(", ")])
            if not len(at):
                continue
            doc = np.searchsorted(at, doc)
            heads = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            bag = [np.add.reduceat(_mix(h + _U(s)) * weight.astype(np.uint64), heads) for s in (0x1234567, 0x89ABCDEF)]
            sig = bag_signatures(doc, h, weight, len(at)).view(np.uint64)
            band = np.zeros((len(at), BANDS), np.uint64)
            for k in range(ROWS):
                band = _mix(band * _U(0x9E3779B97F4A7C15) + sig.reshape(len(at), BANDS, ROWS)[:, :, k])
            pick = pa.array(at)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * BANDS), pa.array(band.view(np.int64).ravel()))
            short = (_mix(sig) & _U(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pick), batch.column(1).take(pick), *(pa.array(x.view(np.int64)) for x in bag), pa.array(count[at].astype(np.int64)), lists, pa.array([x.tobytes() for x in short], pa.binary())],
                [c.split()[0] for c in SIGNED.split(", ")],
            )

    return keyed.select("_d", "_th", "_text").mapInArrow(run, SIGNED)


def _candidates(key, n, sig, union: Union):
    """Pairs of rows with equal keys (sorted), not in one component yet, whose sizes and signatures allow a link; in turn."""
    at, step = np.arange(len(key)), 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        a, b = at, at + step
        step += 1
        root = union.roots()
        on = (root[a] != root[b]) & (np.minimum(n[a], n[b]) >= THRESHOLD * np.maximum(n[a], n[b]) - 1e-9)
        a, b = a[on], b[on]
        for k in range(0, len(a), 1 << 16):
            x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            on = (sig[x] == sig[y]).sum(1) >= AGREE
            if on.any():
                yield x[on], y[on]


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COMPONENTS)


def families(bags: DataFrame) -> DataFrame:
    """(_id, _f: the least number of the family) of the bags that have a candidate."""
    rows = bags.select("_id", "_n", "_sig", F.posexplode("_bands").alias("_band", "_v")).withColumn("_key", F.xxhash64("_band", "_v"))
    crowds = rows.groupBy("_key").agg(F.count("*").alias("_size"), F.min("_id").alias("_lead")).where("_size > 1")
    met = cut(rows.select("_key", "_id", "_n", "_sig").join(crowds, "_key"), "met")

    def run(batches):
        for group in groups_of(batches):
            key, ids, n = (group.column(k).to_numpy() for k in range(3))
            union = Union(len(key))
            for a, b in _candidates(key, n, _signatures(group.column(3)), union):
                union.join(a, b)
            root = union.roots()
            on = root != np.arange(len(root))
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(ids[root[on]])], ["_a", "_b"])

    small = met.where(F.col("_size") <= CROWD).select("_key", "_id", "_n", "_sig").repartition("_key").sortWithinPartitions("_key")
    links = small.mapInArrow(run, "_a long, _b long")
    links = links.unionAll(met.where(F.col("_size") > CROWD).select(F.col("_id").alias("_a"), F.col("_lead").alias("_b")))
    found = components(links).select(F.col("_k").alias("_id"), F.col("_c").alias("_f"))
    return found


def joined(rows: DataFrame) -> DataFrame:
    """(_a, _b) of components that are one: rows (_cell, _c: component, _n, _sig, _text), where documents of a cell are compared."""

    def run(batches):
        for group in groups_of(batches, lambda b: pc.binary_length(b.column(4)).to_numpy(), 2 << 20):
            key, comp, n = (group.column(k).to_numpy() for k in range(3))
            bags, sig = _elements(group.column(4).combine_chunks(), key), _signatures(group.column(3))
            known, number = np.unique(comp, return_inverse=True)
            union = _Labelled(len(key), number)
            for a, b in _candidates(key, n, sig, union):
                for x, y in bags.portions(a, b):
                    root = union.roots()
                    on = root[x] != root[y]
                    x, y = x[on], y[on]
                    if len(x):
                        same = bags.common(x, y)
                        near = same >= THRESHOLD * (bags.count[x] + bags.count[y] - same) - 1e-9
                        union.join(x[near], y[near])
            up = union.up
            on = up != np.arange(len(up))
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(known[on]), pa.array(known[union.all()[on]])], ["_a", "_b"])

    rows = rows.select("_cell", "_c", "_n", "_sig", "_text").repartition("_cell").sortWithinPartitions("_cell")
    return rows.mapInArrow(run, "_a long, _b long")


def _elements(texts: pa.StringArray, key: np.ndarray) -> Sets:
    """The shingles of documents in groups: each occurrence is an element of its own, so common elements are the common weight."""
    _, h, weight, count = bags_of(texts)
    rows = np.repeat(np.arange(len(h)), weight)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(weight) - weight, weight)
    return Sets(_mix(h[rows] + nth.astype(np.uint64) * _U(0xD1B54A32D192ED03)), count, key)


class _Labelled(Union):
    """Components of rows that have labels from the start: the labels are joined."""

    def __init__(self, n: int, label: np.ndarray):
        super().__init__(int(label.max()) + 1 if n else 0)
        self.label = label

    def all(self) -> np.ndarray:
        return super().roots()

    def roots(self) -> np.ndarray:
        return super().roots()[self.label]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        super().join(self.label[a], self.label[b])


def _with_text(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (_d, _th, ...) with ``_text``: from a pass that emits those that a bit table of fixed size names."""

    def place(th):
        return th.view(np.uint64)

    bits = bit_table(wanted.select("_th"), place)

    def named(batches):
        on = bits.array()
        for batch in batches:
            yield batch.filter(pa.array(has_bit(on, place(batch.column(1).to_numpy()))))

    found = keyed.select("_d", "_th", "_text").mapInArrow(named, "_d long, _th long, _text string")
    # rows with equal keys are one document: the key's rows meet in the join, and one of them stays
    return found.join(wanted, ["_d", "_th"]).dropDuplicates(["_d", "_th"])


def near_classes(keyed: DataFrame) -> DataFrame:
    """(_d, _th, _class: the least key of the class) of every document (_d, _th, _text)."""
    bound_batches(keyed.sparkSession)
    every = cut(signed(keyed), "signed")
    docs = every.where("_n > 0")
    key = F.struct("_d", "_th")
    one = docs.groupBy("_g1", "_g2").agg(F.min(key).alias("_k"), F.first(F.struct("_n", "_bands", "_sig")).alias("_f"))
    bags = cut(one.select("_g1", "_g2", "_k", "_f.*", F.monotonically_increasing_id().alias("_id")), "bags")
    found = cut(families(bags), "families")
    sizes = found.groupBy("_f").agg(F.count("*").alias("_size"))
    wanted = found.join(sizes, "_f").join(bags.select("_id", "_k.*", "_n", "_sig"), "_id")
    members = cut(_with_text(keyed, cut(wanted, "wanted")), "members")

    # blocks of each family, with the family's first document in each
    blocks = F.ceil(F.col("_size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("_id"), blocks).cast("int")
    at = F.when(F.col("_id") == F.col("_f"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
    cells = members.withColumn("_at", F.explode(at)).select(F.xxhash64("_f", "_at").alias("_cell"), F.col("_id").alias("_c"), "_n", "_sig", "_text")
    links = cut(joined(cells), "links")
    comps = cut(components(links), "comps")

    large = members.where(F.col("_size") > BLOCK)
    if not large.isEmpty():
        more = cut(_across(large, comps), "links")
        comps = cut(components(links.unionAll(more)), "comps")
    of_bag = bags.select("_g1", "_g2", "_id", "_k").join(comps.select(F.col("_k").alias("_id"), "_c"), "_id", "left").select("_g1", "_g2", "_k", F.coalesce("_c", "_id").alias("_c"))
    least = of_bag.groupBy("_c").agg(F.min("_k").alias("_class"))
    out = docs.select("_d", "_th", "_g1", "_g2").join(of_bag.join(least, "_c").select("_g1", "_g2", "_class"), ["_g1", "_g2"])
    discard(members)
    return out.select("_d", "_th", "_class").unionAll(every.where("_n = 0").select("_d", "_th", key.alias("_class")))


def _across(large: DataFrame, comps: DataFrame) -> DataFrame:
    """Links between components of families of several blocks: documents outside the largest component meet all others."""
    rows = large.join(comps.select(F.col("_k").alias("_id"), "_c"), "_id", "left").withColumn("_c", F.coalesce("_c", "_id"))
    most = rows.groupBy("_f", "_c").agg(F.count("*").alias("_in")).groupBy("_f").agg(F.max(F.struct("_in", "_c")).alias("_m"), F.sum("_in").alias("_all"))
    most = most.select("_f", F.col("_m._c").alias("_most"), F.col("_m._in").alias("_in"), (F.col("_all") - F.col("_m._in")).alias("_out")).where("_out > 0")
    rows = rows.join(most, "_f")
    out_blocks, in_blocks = (F.ceil(F.col(x) / BLOCK).cast("int") for x in ("_out", "_in"))
    h = F.xxhash64("_id")
    outside = F.col("_c") != F.col("_most")
    own = F.pmod(h, F.when(outside, out_blocks).otherwise(in_blocks)).cast("int")

    def cell(kind, i, j):
        return F.xxhash64("_f", F.lit(kind), i, j)

    each = F.transform(F.sequence(F.lit(0), out_blocks - 1), lambda i: F.when(outside, cell(0, F.least(i, own), F.greatest(i, own))).otherwise(cell(1, i, own)))
    others = F.when(outside, F.transform(F.sequence(F.lit(0), in_blocks - 1), lambda j: cell(1, own, j))).otherwise(F.array().cast("array<bigint>"))
    return joined(rows.withColumn("_cell", F.explode(F.concat(each, others))))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its class, named by the least doc_id in it, and whether the document is the one that stays."""
    found = near_classes(keyed_rows(table(spark, sf_dir, "documents").select("doc_id", "text")).select("_d", "_th", "_text"))
    doc_id = F.when(F.col("_d") != LAST, F.col("_d"))
    return found.select(doc_id.alias("doc_id"), F.when(F.col("_class._d") != LAST, F.col("_class._d")).alias("class_id"), (F.struct("_d", "_th") == F.col("_class")).alias("stays"))
