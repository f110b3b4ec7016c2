"""Operator 5, line dedup: an exact set-similarity join of lines; later matches go.

A line's tokens are its distinct words (``words.split_words``). Lines with equal token sets
form a class; its first occurrence, by (doc_id, text hash, line number), stands for it. A
line is removed when an earlier line has a Jaccard similarity of at least ``THRESHOLD``
with it: all but the first line of a class, and the first as well when another class has an
earlier, similar line. A link is a pair of similar classes; none is lost.

The join of the classes, exact:

* Order: a token's number holds its rarity (a log count over the whole corpus from a table
  of ``BUCKETS`` counters, so its size is fixed) and then its hash: one order for all lines.
  Any order gives the same result; rarity makes prefixes selective.
* Prefix: lines that match share one of their first ``n - ceil(t n) + 1`` tokens. Each such
  token of a class is an entry. Entries with a token go to a part by its hash, packed so that
  a row of the shuffle holds many. Tokens that the whole corpus has once are no entries.
* Length, position and a 128-bit map of the tokens, whose differing bits bound the symmetric
  difference, rule pairs out; numpy walks the pairs of a part. Only the classes that still have a
  partner in a part (not the pairs) come out of this.
* A pair is met at every common token of its prefixes, but counts at the first one only. An entry
  holds the two entries of its line before it: where two lines have one of these in common, the pair
  is met there as well and is passed over here. So few parts get the words of a class.
* Verification: the words of these classes are read again and sent to the parts concerned, where
  the Jaccard similarity is computed; a pair counts where its first common entry is. What
  comes out is each class's number of links and whether an earlier class is similar: rows grow
  with the classes, also in a family of near copies, whose links grow with its square.
* A token with more than ``HOT`` entries (a table of fixed size counts them) has its classes
  cut into blocks, and each two blocks meet in a part of their own: a task holds as much
  however common the token is.

Equality of token sets is that of 128-bit hashes, equality of words that of 57-bit hashes.

Defined cases: null and empty texts have no lines; lines without words are kept and match
nothing; a null doc_id sorts last; rows with equal doc_id and text are one document: each
copy keeps what the first keeps; a very long text or line is treated whole; columns of the
input come back in a struct, so that no name can clash. An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import LAST, bit_table, bound_batches, by_size, counters, cut, discard, has_bit, keyed_rows, table
from flowloom.llm.groups import groups_of
from flowloom.llm.words import mix, spans, split_words

THRESHOLD = 0.8
#: Counters of the rarity table and of the table of hot tokens: fixed sizes.
BUCKETS = 1 << 20
#: Entries of a token that are compared in one place; more are cut into blocks.
HOT = 8192
#: Entries that a part holds on average, and the least number of parts.
PART, PARTS = 100_000, 2048
#: Entries that a task packs at a time.
PACK = 1 << 18
#: Text that is tokenised at a time, tokens of pairs that are verified at a time, and bytes of whole parts that are walked at a time.
SLICE, VERIFY, WALK = 1 << 18, 1 << 20, 4 << 20
LEVEL_SHIFT = 57
_U = np.uint64


def words_of(line: str) -> frozenset[str]:
    return frozenset(split_words(line))


def rarity(keyed: DataFrame) -> np.ndarray:
    """Counts of all words of all texts, by hash, in ``BUCKETS`` counters."""

    def count(batch, total):
        for part in by_size([batch], 0, SLICE):
            np.add.at(total, spans(part.column(0))[0] % _U(BUCKETS), 1)

    return counters(keyed.select("_text"), count, BUCKETS)


def levels(counts: np.ndarray) -> np.ndarray:
    """A level of rarity for each counter, 0: once in the corpus."""
    return np.minimum(63, np.ceil(np.log2(np.maximum(counts, 1)) * 2)).astype(np.uint8)


class Lines:
    """The distinct tokens of each line of the texts of an Arrow string array, in the common order."""

    def __init__(self, texts: pa.StringArray, level: np.ndarray):
        #: ``count``: how many lines each text has.
        h, line, self.count = spans(texts)
        token = level[h % _U(BUCKETS)].astype(np.uint64) << _U(LEVEL_SHIFT) | h >> _U(64 - LEVEL_SHIFT)
        order = np.argsort(token)
        key = line[order] << 32 | np.arange(len(order))
        key.sort()
        line, token = key >> 32, token[order[key & 0xFFFFFFFF]]
        if len(key):
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (line[1:] != line[:-1])))
            line, token = line[new], token[new]
        #: Numbers of the lines that have words; the tokens, laid end to end; how many each has; where each begins.
        n = np.bincount(line, minlength=self.count.sum())
        self.at = np.flatnonzero(n)
        self.tokens, self.n = token, n[self.at]
        self.starts = np.cumsum(self.n) - self.n

    def classes(self) -> list[np.ndarray]:
        bare = self.tokens & _U((1 << LEVEL_SHIFT) - 1)
        return [np.add.reduceat(mix(bare + _U(seed)), self.starts).view(np.int64) for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)]

    def bits(self) -> tuple[np.ndarray, np.ndarray]:
        return token_bits(self.tokens, self.starts)

    def prefixes(self, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(short hashes of the prefix tokens that the corpus has more than once, how many each line has, how many come before them)."""
        shorts = short(self.tokens)
        line, inside, entry = prefix_entries(self.tokens, shorts, self.starts, self.n, threshold)
        return shorts[entry], np.bincount(line[entry], minlength=len(self.n)), np.bincount(line[inside & (self.tokens >> _U(LEVEL_SHIFT) == 0)], minlength=len(self.n))


def prefix_entries(tokens: np.ndarray, shorts: np.ndarray, starts: np.ndarray, n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its line, whether it is in the line's prefix, whether it is an entry. A short hash is an entry of a line once."""
    line = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(line)) - starts[line] < (n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)[line]
    again = np.concatenate((np.zeros(min(1, len(line)), bool), shorts[1:] == shorts[:-1]))
    again[starts] = False
    return line, inside, inside & ~again & (tokens >> _U(LEVEL_SHIFT) > 0)


def before(t: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries one and two places before each entry ``t`` of a line; 0, which is no entry, where there is none."""
    one, two = np.zeros(len(t), np.uint64), np.zeros(len(t), np.uint64)
    one[1:], two[2:] = t[:-1], t[:-2]
    return np.where(place > 0, one, _U(0)), np.where(place > 1, two, _U(0))


def token_bits(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words of 64 bits for each line: every token flips one of the 128 bits, so that long lines don't fill them."""
    h = mix(tokens & _U((1 << LEVEL_SHIFT) - 1))
    bit, word = _U(1) << (h & _U(63)), h >> _U(6) & _U(1)
    return np.bitwise_xor.reduceat(bit * (_U(1) - word), starts), np.bitwise_xor.reduceat(bit * word, starts)


def short(tokens: np.ndarray) -> np.ndarray:
    """The first 40 bits of a token, in the same order: enough to find candidates, which are verified on whole tokens."""
    return tokens >> _U(24)


def places_of(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, line number in it) of all lines of texts that have ``count`` lines."""
    doc = np.repeat(np.arange(len(count)), count)
    return doc, np.arange(len(doc)) - (np.cumsum(count) - count)[doc]


LINES = "_d long, _th long, _no int, _h1 long, _h2 long, _n int, _b0 long, _b1 long, _skip int, _pre binary"


def line_table(keyed: DataFrame, level: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``LINES``: a row for each line with words of each (_d, _th, _text)."""

    def run(batches):
        for batch in by_size(batches, 2, SLICE):
            found = Lines(batch.column(2), level)
            if not len(found.at):
                continue
            doc, no = places_of(found.count)
            doc, no = doc[found.at], no[found.at]
            entries, many, skip = found.prefixes(threshold)
            data = np.ascontiguousarray(entries.view(np.uint8).reshape(-1, 8)[:, :5])
            offsets = np.concatenate(([0], np.cumsum(many * 5))).astype(np.int32)
            pre = pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            pick = pa.array(doc)
            cols = [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(no.astype(np.int32)), *map(pa.array, found.classes()), pa.array(found.n.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in found.bits()), pa.array(skip.astype(np.int32)), pre]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in LINES.split(", ")])

    return keyed.select("_d", "_th", "_text").mapInArrow(run, LINES)


def _unpacked(pre: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(short hashes, how many each row has)."""
    data, offsets = _bytes(pre)
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = data.reshape(-1, 5)
    return out.view(np.uint64).ravel(), np.diff(offsets) // 5


def _bytes(blobs: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all rows, laid end to end, offsets of the rows in them)."""
    offsets = np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1, blobs.offset * 4).astype(np.int64) if len(blobs) else np.zeros(1, np.int64)
    data = np.frombuffer(blobs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


#: q0, q1 and q2 hold the entries before (``before``): their first 32 bits, and the other 8 of both.
ENTRY = np.dtype([("g", "<u8"), ("id", "<i8"), ("b0", "<u8"), ("b1", "<u8"), ("n", "<u4"), ("p", "<u2"), ("side", "u1"), ("q0", "<u4"), ("q1", "<u4"), ("q2", "<u2")])
BOTH = 2


def put_before(e: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    e["q0"], e["q1"], e["q2"] = one & _U(0xFFFFFFFF), two & _U(0xFFFFFFFF), one >> _U(32) | two >> _U(32) << _U(8)


def get_before(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    high = e["q2"].astype(np.uint64)
    return e["q0"] | (high & _U(255)) << _U(32), e["q1"] | high >> _U(8) << _U(32)


class Dealer:
    """Where entries go: a group for each token, or for each two blocks of a hot one; a part holds many groups."""

    def __init__(self, hot: np.ndarray, parts: int):
        self.blocks, self.parts = np.maximum(1, -(-hot // HOT)).astype(np.int64), parts

    def deal(self, t: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the entry, group, side) of all copies; ``line`` are hashes by which the blocks are dealt."""
        blocks = self.blocks[t % _U(BUCKETS)]
        rows = np.repeat(np.arange(len(t)), blocks)
        other = np.arange(len(rows)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        own = (mix(line.view(np.uint64) + t) % blocks.astype(np.uint64)).astype(np.int64)[rows]
        low, high = np.minimum(own, other), np.maximum(own, other)
        # 48 bits, of which a short hash takes 40
        group = np.where(blocks[rows] == 1, t[rows], mix(t[rows] * _U(0x9E3779B97F4A7C15) + (low << 32 | high).astype(np.uint64)) >> _U(17) | _U(1 << 47))
        return rows, group, np.where(low == high, BOTH, np.where(own == low, 0, 1)).astype(np.uint8)

    def part(self, group: np.ndarray) -> np.ndarray:
        return (mix(group + _U(0x51ED270B)) % _U(self.parts)).astype(np.int32)


def _apart(na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """How many tokens two similar lines can differ in."""
    return na + nb - 2 * np.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9).astype(np.int64)


def _differing(b0, b1, a, b) -> np.ndarray:
    """Differing bits of the lines' maps, those that differing tokens flip: at most as many as these."""
    return np.bitwise_count(b0[a] ^ b0[b]).astype(np.int64) + np.bitwise_count(b1[a] ^ b1[b])


def near_pairs(e: np.ndarray, threshold: float):
    """Places (i, j) in the entries ``e``, sorted by group and length, of pairs that the filters let through; yielded in arrays.

    Pairs with a common one among the two entries before are left to the groups of those.
    """
    one, two = get_before(e)
    none = _U((1 << 64) - 1)  # where a line has no entry before, that is nothing in common
    one_b, two_b = np.where(one == 0, none, one), np.where(two == 0, none, two)
    g, n, p, b0, b1, side, ids = e["g"].copy(), e["n"].astype(np.int64), e["p"].astype(np.int64), e["b0"].copy(), e["b1"].copy(), e["side"], e["id"]
    at, step = np.arange(len(e)), 1
    while True:
        at = at[at + step < len(e)]
        a, b = at, at + step
        on = (g[a] == g[b]) & (n[a] >= threshold * n[b] - 1e-9)
        at = a[on]
        if not len(at):
            return
        a, b = at, at + step
        step += 1
        apart = _apart(n[a], n[b], threshold)
        # a token is shared at p: what comes before it, and is shared as well, only counts where it is met itself
        on = (p[a] + p[b] <= apart) & ((side[a] != side[b]) | (side[a] == BOTH)) & (ids[a] != ids[b])
        a, b, apart = a[on], b[on], apart[on]
        on = _differing(b0, b1, a, b) <= apart
        a, b = a[on], b[on]
        on = (one[a] != one_b[b]) & (one[a] != two_b[b]) & (two[a] != one_b[b]) & (two[a] != two_b[b])
        if on.any():
            yield a[on], b[on]


def _sorted(e: np.ndarray) -> np.ndarray:
    if len(e) and e["n"].max() >= 1 << 16:
        return e[np.lexsort((e["n"], e["g"]))]
    return e[np.argsort(e["g"] << _U(16) | e["n"])]


def partnered(classes: DataFrame, dealer: Dealer, threshold: float) -> DataFrame:
    """(_h1, _part) of the classes that have a partner in a part."""

    def pack(batches):
        held, size = [], 0

        def flush():
            e, parts = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            order = np.argsort(parts)
            e, parts = e[order], parts[order]
            edges = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1])))
            blobs = [e[a:b].tobytes() for a, b in zip(edges, [*edges[1:], len(e)])]
            for k in range(0, len(blobs), 256):
                yield pa.RecordBatch.from_arrays([pa.array(parts[edges][k : k + 256]), pa.array(blobs[k : k + 256], pa.binary())], ["_part", "_blob"])

        for batch in batches:
            t, sizes = _unpacked(batch.column(5))
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(t)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ids, n, b0, b1, skip = (batch.column(k).to_numpy() for k in range(5))
            copy, group, side = dealer.deal(t, ids[row])
            e = np.zeros(len(copy), ENTRY)
            at = row[copy]
            e["g"], e["id"], e["b0"], e["b1"], e["n"], e["side"] = group, ids[at], b0[at].view(np.uint64), b1[at].view(np.uint64), n[at], side
            e["p"] = np.minimum(skip[at] + place[copy], 65535)
            put_before(e, *(x[copy] for x in before(t, place)))
            held.append((e, dealer.part(group)))
            size += len(e)
            if size >= PACK:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def meet(batches):
        for rows in groups_of(batches, lambda batch: pc.binary_length(batch.column(1)).to_numpy(), WALK):
            e = _sorted(np.frombuffer(b"".join(rows.column(1).to_pylist()), ENTRY))
            on = np.zeros(len(e), bool)
            for a, b in near_pairs(e, threshold):
                on[a] = on[b] = True
            if on.any():
                ids, parts = e["id"][on], dealer.part(e["g"][on])
                order = np.lexsort((parts, ids))
                ids, parts = ids[order], parts[order]
                new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (parts[1:] != parts[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(ids[new]), pa.array(parts[new])], ["_h1", "_part"])

    packed = classes.select("_h1", "_n", "_b0", "_b1", "_skip", "_pre").mapInArrow(pack, "_part int, _blob binary")
    return packed.repartition("_part").sortWithinPartitions("_part").mapInArrow(meet, "_h1 long, _part int")


def _tokens(keyed: DataFrame, wanted: DataFrame, level: np.ndarray) -> DataFrame:
    """``wanted`` (_d, _th, _no, ...) with ``_tokens`` of these lines, from a pass that emits lines that a bit table of fixed size names."""

    def place(th, no):
        return mix(th.view(np.uint64) + no.astype(np.uint64) * _U(0x9E3779B97F4A7C15))

    bits = bit_table(wanted.select("_th", "_no"), place)

    def run(batches):
        named = bits.array()
        for batch in by_size(batches, 2, SLICE):
            lines = pc.split_pattern(batch.column(2), "\n")
            doc, no = places_of(lines.value_lengths().to_numpy())
            at = np.flatnonzero(has_bit(named, place(batch.column(1).to_numpy()[doc], no)))
            found = Lines(lines.flatten().take(pa.array(at)), level)
            if len(found.at):
                at = at[found.at]
                offsets = np.concatenate(([0], np.cumsum(found.n) * 8)).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(found.tokens))])
                pick = pa.array(doc[at])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(no[at].astype(np.int32)), blobs], ["_d", "_th", "_no", "_tokens"])

    found = keyed.select("_d", "_th", "_text").mapInArrow(run, "_d long, _th long, _no int, _tokens binary").dropDuplicates(["_d", "_th", "_no"])
    return found.join(wanted, ["_d", "_th", "_no"])


def _linked(e, tokens, entries, threshold):
    """Of the pairs of entries that may be similar, those that are and whose first common entry is this one: arrays of line numbers.

    ``tokens`` and ``entries`` of the lines: numbers laid end to end, in order, where each line begins, how many it has.
    """
    out, many = [], tokens[2]

    def common(x, y, numbers, starts, count):
        """(pair, number) of what the lines of the pairs have in common, in order."""
        sizes = np.concatenate((count[x], count[y]))
        at = np.repeat(np.concatenate((starts[x], starts[y])) - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        key = np.repeat(np.concatenate((np.arange(len(x)), np.arange(len(x)))), sizes) << 32 | numbers[at]
        key.sort()
        both = key[1:][key[1:] == key[:-1]]
        return both >> 32, both & 0xFFFFFFFF

    def verify(a, b):
        x, y = e["id"][a], e["id"][b]
        pair, number = common(x, y, *entries)
        first = np.full(len(x), -1)
        first[pair[::-1]] = number[::-1]
        on = (first == e["t"][a]) & (first == e["t"][b])
        x, y = x[on], y[on]
        pair, _ = common(x, y, *tokens)
        same = np.bincount(pair, minlength=len(x))
        ok = same >= threshold * (many[x] + many[y] - same) - 1e-9
        out.append((x[ok], y[ok]))

    for a, b in near_pairs(e, threshold):
        sizes = np.cumsum(many[e["id"][a]] + many[e["id"][b]] + 16)
        cuts = np.searchsorted(sizes, np.arange(VERIFY, sizes[-1] + VERIFY, VERIFY), "left")
        for x, y in zip([0, *(cuts + 1)], cuts + 1):
            if x < min(y, len(a)):
                verify(a[x:y], b[x:y])
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


LINKS = "_h1 long, _h2 long, _links long, _late boolean"


def verified(lines: DataFrame, dealer: Dealer, threshold: float) -> DataFrame:
    """``LINKS`` of the classes in each part (_part, _h1, _h2, _d, _th, _no, _tokens): a class can have several rows."""
    wide = np.dtype([*ENTRY.descr, ("t", "<i8")])

    def run(batches):
        for rows in groups_of(batches, lambda batch: pc.binary_length(batch.column(6)).to_numpy(), WALK):
            part, h1, h2, d, th, no = (rows.column(k).combine_chunks().to_numpy() for k in range(6))
            data, offsets = _bytes(rows.column(6).combine_chunks())
            tokens, n = data.view(np.uint64), np.diff(offsets) // 8
            starts = np.cumsum(n) - n
            known, local = np.unique(tokens, return_inverse=True)
            shorts = short(known)
            number = np.cumsum(np.concatenate(([0], shorts[1:] != shorts[:-1])))
            line, _, entry = prefix_entries(tokens, shorts[local], starts, n, threshold)
            t, row, p = shorts[local[entry]], line[entry], (np.arange(len(line)) - starts[line])[entry]
            many = np.bincount(row, minlength=len(n))
            begin = np.cumsum(many) - many
            copy, group, side = dealer.deal(t, h1[row])
            here = dealer.part(group) == part[row[copy]]
            copy, group, side = copy[here], group[here], side[here]
            e = np.zeros(len(copy), wide)
            at = row[copy]
            b0, b1 = token_bits(tokens, starts)
            e["g"], e["id"], e["b0"], e["b1"], e["n"], e["side"] = group, at, b0[at], b1[at], n[at], side
            e["p"], e["t"] = np.minimum(p[copy], 65535), number[local[entry]][copy]
            put_before(e, *(x[copy] for x in before(t, np.arange(len(t)) - begin[row])))
            x, y = _linked(_sorted(e), (local, starts, n), (number[local[entry]], begin, many), threshold)
            if not len(x):
                continue
            order = np.empty(len(n), np.int64)
            order[np.lexsort((no, th, d))] = np.arange(len(n))
            links = np.bincount(x, minlength=len(n)) + np.bincount(y, minlength=len(n))
            late = np.zeros(len(n), bool)
            late[np.where(order[x] > order[y], x, y)] = True
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(h1[at]), pa.array(h2[at]), pa.array(links[at]), pa.array(late[at])], ["_h1", "_h2", "_links", "_late"])

    rows = lines.select("_part", "_h1", "_h2", "_d", "_th", "_no", "_tokens").repartition("_part").sortWithinPartitions("_part")
    return rows.mapInArrow(run, LINKS)


def line_links(keyed: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Two tables: the lines (_d, _th, _no, _h1, _h2: their class), and the classes that have links or several lines
    (_h1, _h2, _first: first line, _links: how many other classes are similar, _late: whether an earlier one is)."""
    spark = keyed.sparkSession
    bound_batches(spark)
    level = levels(rarity(keyed))
    lines = cut(line_table(keyed, level, threshold), "lines")
    place = F.struct("_d", "_th", "_no")
    features = F.struct("_n", "_b0", "_b1", "_skip", "_pre")
    classes = cut(lines.groupBy("_h1", "_h2").agg(F.min(place).alias("_first"), (F.max(place) != F.min(place)).alias("_more"), F.first(features).alias("_f")).select("_h1", "_h2", "_first", "_more", "_f.*"), "classes")

    # what is needed no more goes before entries and words are dealt
    places = cut(lines.select("_d", "_th", "_no", "_h1", "_h2"), "places")
    discard(lines)

    def count(batch, total):
        t, _ = _unpacked(batch.column(0))
        np.add.at(total, t % _U(BUCKETS), 1)

    hot = counters(classes.select("_pre"), count, BUCKETS)
    dealer = Dealer(hot, max(PARTS, int(hot.sum()) // PART))
    found = cut(partnered(classes, dealer, threshold).groupBy("_h1").agg(F.collect_set("_part").alias("_parts")), "partnered")
    wanted = cut(classes.select("_h1", "_h2", "_first.*").join(found, "_h1"), "wanted")
    tokens = cut(_tokens(keyed, wanted, level), "tokens")
    slim = cut(classes.select("_h1", "_h2", "_first", "_more"), "slim")
    discard(found, wanted, classes)
    links = cut(verified(tokens.withColumn("_part", F.explode("_parts")), dealer, threshold).groupBy("_h1", "_h2").agg(F.sum("_links").alias("_links"), F.max("_late").alias("_late")), "links")
    discard(tokens)
    joined = slim.join(links, ["_h1", "_h2"], "left").where("_links IS NOT NULL OR _more")
    flagged = cut(joined.select("_h1", "_h2", "_first", F.coalesce("_links", F.lit(0)).alias("_links"), F.coalesce("_late", F.lit(False)).alias("_late")), "flagged")
    discard(slim, links)
    return places, flagged


def line_marks(keyed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of the documents (_d, _th) with lines that aren't alone: _gone (lines that go), n_similar, n_links and classes as in ``dedup_lines``."""
    places, flagged = line_links(keyed, threshold)
    # equal documents have equal lines
    rows = places.join(flagged, ["_h1", "_h2"]).groupBy("_d", "_th").agg(F.sort_array(F.collect_set(F.struct("_no", "_first", "_links", "_late"))).alias("_lines"))

    def own(x):
        return x["_first"] == F.struct(F.col("_d"), F.col("_th"), x["_no"].alias("_no"))

    def line_class(x):
        first = x["_first"]
        class_id = F.concat_ws(":", F.when(first["_d"] == LAST, "").otherwise(first["_d"].cast("string")), F.hex(first["_th"]), first["_no"].cast("string"))
        return F.struct(x["_no"].alias("line_no"), class_id.alias("class_id"))

    return rows.select(
        "_d", "_th", F.transform(F.filter("_lines", lambda x: x["_late"] | ~own(x)), lambda x: x["_no"]).alias("_gone"),
        F.size(F.filter("_lines", lambda x: x["_late"] & own(x))).cast("long").alias("n_similar"),
        F.aggregate("_lines", F.lit(0).cast("long"), lambda total, x: total + x["_links"]).alias("n_links"), F.transform("_lines", line_class).alias("classes"),
    )


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, back: list[str] | None = None) -> DataFrame:
    """A row for each of ``docs``: ``row`` (a struct of its columns, or of those in ``back``), ``kept`` (the text without removed lines), n_lines (with
    words), n_removed, n_similar (of them, first lines of their class that go for an earlier similar class), n_links (similar
    classes of its lines, in sum) and classes (line number and class id of each line whose class has several lines or links).

    A class id is the place of the class's first line: doc_id, text hash and line number. Any other line is a class of its own.
    """
    bound_batches(docs.sparkSession)
    keyed = keyed_rows(docs)
    joined = keyed.select("_row", "_d", "_th").join(line_marks(keyed, threshold), ["_d", "_th"], "left")

    def run(batches):
        for batch in by_size(batches, lambda b: pc.struct_field(b.column(0), "text").cast(pa.string()), 1 << 20):
            texts = pc.fill_null(pc.struct_field(batch.column(0), "text").cast(pa.string()), "")
            kept, lines_, removed = [], [], []
            for text, gone in zip(texts.to_pylist(), batch.column(1).to_pylist()):
                lines = text.split("\n")
                lines_.append(len(lines) - sum(map(str.isspace, lines)) - lines.count(""))
                gone = frozenset(gone or ())
                kept.append("\n".join([line for i, line in enumerate(lines) if i not in gone]) if gone else text)
                removed.append(len(gone))
            counts = [pa.array(lines_, pa.int64()), pa.array(removed, pa.int64())]
            row = batch.column(0) if back is None else pa.StructArray.from_arrays([pc.struct_field(batch.column(0), c) for c in back], back)
            yield pa.RecordBatch.from_arrays([row, pa.array(kept, pa.string()), *counts, *batch.columns[2:]], ["row", "kept", "n_lines", "n_removed", "n_similar", "n_links", "classes"])

    counts = "kept string, n_lines long, n_removed long, n_similar long, n_links long, classes array<struct<line_no:int,class_id:string>>"
    given = keyed.schema["_row"].dataType
    schema = T.StructType([T.StructField("row", given if back is None else T.StructType([given[c] for c in back])), *T.StructType.fromDDL(counts)])
    none = F.from_json(F.lit("[]"), "array<struct<line_no:int,class_id:string>>")
    return joined.select("_row", "_gone", F.coalesce("n_similar", F.lit(0)), F.coalesce("n_links", F.lit(0)), F.coalesce("classes", none)).mapInArrow(run, schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: lines with words, lines removed, those of them that go for a similar line in other words, links of
    its lines, the classes of its lines, and the kept text's digest."""
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), back=["doc_id"])
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", "n_similar", "n_links", "classes", F.sha2("kept", 256).alias("kept_sha256"))
