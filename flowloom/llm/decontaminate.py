"""Operator 6, benchmark decontamination: latent semantic retrieval, then sequence and answer checks.

The benchmark is the query set. It is searched in blocks of ``BLOCK`` query passages (items;
longer ones in overlapping parts of ``WINDOW`` words), so what a task holds is bounded
however large the benchmark is. For a block:

1. Terms: the block's words that at most ``RARE`` of the documents have, and the rarest
   words of an item without enough of these: a word in more documents than that says little
   and isn't searched by, but counts in the checks. Document frequencies cover the whole corpus.
2. Passages: windows of ``WINDOW`` words at every ``STRIDE``, as TF-IDF rows over the terms;
   rows with one distinct term or none can't reach the threshold with a whole item and
   are not written. The sparse rows are kept in the shared folder.
3. Distributed randomised SVD of the corpus's rows, of rank ``RANK`` whatever the number of
   queries: each task multiplies its rows with a random test matrix and sums ``A'(A R)``; a
   power iteration does so again with an orthonormal basis ``Q`` of the sums, and the
   eigenvectors of ``Q'A'A Q`` give the singular vectors. The sums have a row a term.
4. Search: queries are folded into the latent space. Cosines of all windows with all
   queries of the block are taken there; every pair of at least ``COSINE`` is a candidate,
   without a cap. A window that equals a query has a cosine of 1 at any rank.
5. Checks on the words around the candidate window: the longest common subsequence must
   hold ``LCS_SURE`` of the item's words, or ``LCS_LIKE`` if the item's rare words and its
   answer (its last sentence or last quarter) are there as well: a paraphrase.

Items of fewer than ``LEAST_WORDS`` words have too little for this: a document leaks one when it
holds the item's words in a row, found by a map-only pass over all texts. Items of which the
corpus has fewer than two distinct terms anywhere in a window are leaked by no document.

Texts for the checks come from a pass that emits only documents that a bit table of fixed
size names; exact keys are joined afterwards.

Defined cases: null and empty texts and items leak nothing; a null doc_id or item_id stays
null in the result; rows with equal doc_id and text give their pairs once for each row; a very
long text is searched whole; ties in the cosine don't matter, as each candidate is checked; an
empty corpus or benchmark gives no row; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import LAST, bit_table, bound_batches, by_size, counters, cut, has_bit, keyed_rows, table, text_or_empty
from flowloom.llm.words import MARKS, coded, hashes, plain, split_words

WINDOW, STRIDE = 48, 16
BLOCK = 2048
RANK, OVERSAMPLE = 256, 16
RARE = 0.01
LEAST_TERMS = 8
COSINE = 0.6
LCS_SURE, LCS_LIKE = 0.8, 0.6
COVERED = 0.6
#: Items of fewer words are matched word for word, so many distinct ones in a pass.
LEAST_WORDS = 6
SHORT_BLOCK = 50_000
SLICE = 2 << 20


def words_of(text: str) -> list[str]:
    """The words of a text; chunks of punctuation only are none."""
    return [w for w in split_words(text) if w.strip(MARKS)]


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel in ``a``."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = at.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def answer_of(text: str) -> list[str]:
    """The item's last sentence if that is shorter than half of it, else its last quarter."""
    words = words_of(text)
    parts = [p for p in map(words_of, re.split(r"[.!?:]\s+", text.strip())) if p]
    if len(parts) > 1 and 2 <= len(parts[-1]) <= len(words) // 2:
        return parts[-1]
    return words[-max(1, len(words) // 4) :]


class Terms:
    """Numbers of listed words."""

    def __init__(self, words: list[str]):
        h = hashes(pa.array(words, pa.string()))
        self.order = np.argsort(h)
        self.known = h[self.order]

    def places(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in its words, number) of each listed word, and how many words each text has."""
        numbers, distinct, sizes = coded(texts)
        words = plain(distinct, True)
        h = hashes(words)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        listed = np.where(self.known[at] == h, self.order[at], -1)[numbers]
        text = np.repeat(np.arange(len(sizes)), sizes)
        word = ~pc.equal(pc.utf8_trim(words, MARKS), "").to_numpy(zero_copy_only=False)[numbers] if len(words) else np.zeros(0, bool)
        if not word.all():
            listed, text = listed[word], text[word]
            sizes = np.bincount(text, minlength=len(sizes))
        on = np.flatnonzero(listed >= 0)
        return text[on], on - (np.cumsum(sizes) - sizes)[text[on]], listed[on], sizes


def document_frequencies(keyed: DataFrame, words: list[str]) -> tuple[np.ndarray, int]:
    """How many documents have each listed word, and how many documents there are."""
    terms, n = Terms(words), len(words)

    def count(batch, total):
        for part in by_size([batch], 0, SLICE):
            text, _, t, _ = terms.places(part.column(0))
            total[:n] += np.bincount(np.unique(text * n + t) % n, minlength=n)
        total[n] += batch.num_rows

    out = counters(keyed.select("_text"), count, n + 1)
    return out[:n], int(out[n])


ROWS = "_d long, _th long, _w int, _terms array<int>"


def passages(keyed: DataFrame, words: list[str]) -> DataFrame:
    """``ROWS``: windows with two distinct terms or more."""
    terms = Terms(words)

    def run(batches):
        for batch in by_size(batches, 2, SLICE):
            text, place, t, sizes = terms.places(batch.column(2))
            last = np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
            # the windows that a place lies in
            found = []
            for back in range(WINDOW // STRIDE):
                w = place // STRIDE - back
                on = (w >= 0) & (w <= last[text]) & (place < w * STRIDE + WINDOW)
                found.append((text[on], w[on], t[on]))
            text, w, t = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((t, w, text))
            text, w, t = text[order], w[order], t[order]
            if not len(t):
                continue
            head = np.concatenate(([True], (text[1:] != text[:-1]) | (w[1:] != w[:-1])))
            window = np.cumsum(head) - 1
            distinct = np.bincount(window[head | np.concatenate(([True], t[1:] != t[:-1]))])
            keep = (distinct > 1)[window]
            text, w, t, head = text[keep], w[keep], t[keep], head[keep]
            if not len(t):
                continue
            at = np.flatnonzero(head)
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(t)).astype(np.int32)), pa.array(t.astype(np.int32)))
            pick = pa.array(text[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(w[at].astype(np.int32)), lists], ["_d", "_th", "_w", "_terms"])

    return keyed.select("_d", "_th", "_text").mapInArrow(run, ROWS)


def _sparse(lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of an Arrow list column or of lists."""
    if isinstance(lists, list):
        lists = pa.array(lists, pa.list_(pa.int32()))
    t = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    if not len(t):
        return row, t, np.zeros(0)
    key, n = np.unique(row << 32 | t, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, n.astype(np.float32)


def _times(sparse, idf: np.ndarray, m: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF rows times a matrix, and the rows' squared norms."""
    row, t, n = sparse
    weight = (n * idf[t]).astype(np.float32)
    out = np.zeros((rows, m.shape[1]), np.float32)
    norms = np.bincount(row, weight.astype(np.float64) ** 2, rows)
    for a in range(0, len(row), 1 << 15):
        r = row[a : a + (1 << 15)]
        part = m[t[a : a + (1 << 15)]] * weight[a : a + (1 << 15), None]
        heads = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        out[r[heads]] += np.add.reduceat(part, heads, 0)
    return out, norms


def _back(sparse, idf: np.ndarray, y: np.ndarray, terms: int) -> np.ndarray:
    """The transposed rows times ``y``."""
    row, t, n = sparse
    order = np.argsort(t, kind="stable")
    row, t, weight = row[order], t[order], (n * idf[t])[order].astype(np.float32)
    out = np.zeros((terms, y.shape[1]), np.float64)
    for a in range(0, len(row), 1 << 15):
        u = t[a : a + (1 << 15)]
        part = y[row[a : a + (1 << 15)]] * weight[a : a + (1 << 15), None]
        heads = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
        out[u[heads]] += np.add.reduceat(part, heads, 0)
    return out


def latent_space(rows: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """terms x rank: the leading right singular vectors of the rows, by a randomised SVD with a power iteration."""
    terms = len(idf)
    k = min(terms, rank + OVERSAMPLE)

    def gathered(m: np.ndarray) -> np.ndarray:
        """A'(A m) over all rows."""
        m = m.astype(np.float32)

        def add(batch, total):
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                s = _sparse(part.column(0))
                y, _ = _times(s, idf, m, part.num_rows)
                total.reshape(terms, k)[:] += _back(s, idf, y, terms)

        return counters(rows.select("_terms"), add, terms * k, np.float32).reshape(terms, k).astype(np.float64)

    basis, _ = np.linalg.qr(gathered(np.random.default_rng(seed).standard_normal((terms, k))))
    images = gathered(basis)
    gram = basis.T @ images
    _, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return (basis @ vectors[:, ::-1][:, :rank]).astype(np.float32)


CANDIDATES = "_d long, _th long, _w int, _q int, _cos float"


def search(rows: DataFrame, queries: list[list[int]], idf: np.ndarray, space: np.ndarray, least: float = COSINE) -> DataFrame:
    """``CANDIDATES``: all pairs of a window and a query with a latent cosine of ``least``."""

    def unit(y: np.ndarray) -> np.ndarray:
        return y / np.sqrt(np.maximum((y * y).sum(1), 1e-12))[:, None]

    target = unit(_times(_sparse(queries), idf, space, len(queries))[0]).T.copy()

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                cos = unit(_times(_sparse(part.column(3)), idf, space, part.num_rows)[0]) @ target
                r, q = np.nonzero(cos >= least)
                if len(r):
                    pick = pa.array(r)
                    yield pa.RecordBatch.from_arrays([*(part.column(i).take(pick) for i in range(3)), pa.array(q.astype(np.int32)), pa.array(cos[r, q].astype(np.float32))], ["_d", "_th", "_w", "_q", "_cos"])

    return rows.mapInArrow(run, CANDIDATES)


FOUND = "_d long, _th long, item_id long, first_word int, cosine float, lcs double, answer double, covered double"


def chunks_of(text: str) -> list[str]:
    """The chunks of a text that are words, as they stand there."""
    return [c for c in text.split() if c[0].isalnum() or c.strip(MARKS)]


def _check(chunks: list[str], item: dict, windows: list[int]) -> tuple:
    """The best (first word, lcs, answer, covered) around the windows."""
    n, best = len(item["words"]), (0, 0.0, 0.0, 0.0)
    for w in windows:
        a = max(0, w * STRIDE - n)
        part = split_words(" ".join(chunks[a : w * STRIDE + WINDOW + n]))
        share = lcs(item["words"], part) / n
        if share > best[1]:
            have = set(part)
            covered = sum(x for t, x in item["rare"].items() if t in have) / max(1e-9, sum(item["rare"].values()))
            best = (a, share, lcs(item["answer"], part) / len(item["answer"]), covered)
    return best


def leaks(keyed: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``FOUND``: the pairs of a document (_d, _th, _text) and an item that it leaks."""
    spark = keyed.sparkSession
    bound_batches(spark)
    keyed = keyed.select("_d", "_th", "_text")
    blocks, block = [], []
    short: dict[tuple, set] = {}
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), text_or_empty().alias("text")).distinct().orderBy("item_id", "text")
    for row in items.toLocalIterator():  # one block at a time is held
        words = words_of(row["text"])
        if len(words) < LEAST_WORDS:
            if words:
                short.setdefault(tuple(words), set()).add(row["item_id"])
            if len(short) >= SHORT_BLOCK:
                blocks.append(_short_leaks(keyed, short))
                short = {}
            continue
        parts = [words[i : i + WINDOW] for i in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2)] if len(words) > WINDOW else [words]
        if block and sum(len(x["parts"]) for x in block) + len(parts) > BLOCK:
            blocks.append(_leaks_of(keyed, block))
            block = []
        block.append({"id": row["item_id"], "words": words, "parts": parts, "answer": answer_of(row["text"])})
    if block:
        blocks.append(_leaks_of(keyed, block))
    if short:
        blocks.append(_short_leaks(keyed, short))
    if not blocks:
        return spark.createDataFrame([], FOUND)
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionAll(b)
    return out


def _short_leaks(keyed: DataFrame, items: dict[tuple, set]) -> DataFrame:
    """``FOUND`` for items of a few words: the documents that hold just these words in a row."""
    sizes = sorted({len(x) for x in items})

    def run(batches):
        for batch in batches:
            out = []
            for d, th, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                first: dict = {}
                for n in sizes:
                    for i, part in enumerate(zip(*(words[k:] for k in range(n)))):
                        for item in items.get(part, ()):
                            first.setdefault((part, item), i)
                out += [(d, th, item, i, 1.0, 1.0, 1.0, 1.0) for (_, item), i in first.items()]
            if out:
                kinds = [pa.int64()] * 3 + [pa.int32(), pa.float32()] + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in FOUND.split(", ")])

    return keyed.mapInArrow(run, FOUND)


def _leaks_of(keyed: DataFrame, block: list[dict]) -> DataFrame:
    listed = {w: i for i, w in enumerate(sorted({w for x in block for w in x["words"]}))}
    df, n_docs = document_frequencies(keyed, list(listed))
    rare = {w for w, i in listed.items() if df[i] <= max(RARE * n_docs, 3)}
    for x in block:
        if len(set(x["words"]) & rare) < LEAST_TERMS:
            rare |= set(sorted(set(x["words"]), key=lambda w: (df[listed[w]], w))[:LEAST_TERMS])
    # words that no document has can't be searched by
    terms = {w: i for i, w in enumerate(sorted(w for w in rare if df[listed[w]]))}
    if not terms:
        return keyed.sparkSession.createDataFrame([], FOUND)
    idf = np.array([np.log(1 + n_docs / (1 + df[listed[w]])) for w in terms], np.float32)
    queries, of_item = [], []
    for i, x in enumerate(block):
        x["rare"] = {w: float(np.log(1 + n_docs / (1 + df[listed[w]]))) for w in sorted(set(x["words"]) & rare)}
        for part in x["parts"]:
            queries.append([terms[w] for w in part if w in terms])
            of_item.append(i)
    rows = cut(passages(keyed, list(terms)), "passages")
    found = cut(search(rows, queries, idf, latent_space(rows, idf)), "candidates")
    grouped = found.groupBy("_d", "_th").agg(F.collect_set(F.struct("_w", "_q", "_cos")).alias("_found"))

    def place(th):
        return th.view(np.uint64)

    bits = bit_table(found.select("_th"), place)

    def named(batches):
        on = bits.array()
        for batch in batches:
            yield batch.filter(pa.array(has_bit(on, place(batch.column(1).to_numpy()))))

    texts = keyed.select("_d", "_th", "_text").mapInArrow(named, "_d long, _th long, _text string")

    def run(batches):
        for batch in by_size(batches, 2):
            out = []
            for d, th, text, pairs in zip(*(c.to_pylist() for c in batch.columns)):
                words = chunks_of(text)
                by_item: dict[int, list] = {}
                for p in pairs:
                    by_item.setdefault(of_item[p["_q"]], []).append(p)
                for i, ps in by_item.items():
                    item = block[i]
                    first, share, answer, covered = _check(words, item, sorted({p["_w"] for p in ps}))
                    if share >= LCS_SURE or share >= LCS_LIKE and answer >= COVERED and covered >= COVERED:
                        out.append((d, th, item["id"], first, max(p["_cos"] for p in ps), share, answer, covered))
            if out:
                kinds = [pa.int64()] * 3 + [pa.int32(), pa.float32()] + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in FOUND.split(", ")])

    return texts.join(grouped, ["_d", "_th"]).select("_d", "_th", "_text", "_found").mapInArrow(run, FOUND)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each pair of a document and a benchmark item that it leaks."""
    keyed = keyed_rows(table(spark, sf_dir, "documents").select("doc_id", "text")).select("_d", "_th", "_text")
    found = leaks(keyed, table(spark, sf_dir, "benchmark"))
    return found.select(F.when(F.col("_d") != LAST, F.col("_d")).alias("doc_id"), "item_id", "first_word", F.round("cosine", 4).alias("cosine"), "lcs", "answer")
