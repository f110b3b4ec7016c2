"""Operator 4, quality rules: a linear-chain CRF marks each line as content or boilerplate.

Every text is split at ``\\n``. Each line gets features (shares of symbols, digits and
capitals, length, repeats, pipes), a conditional random field scores the two states with
transitions between neighbouring lines, and Viterbi decoding gives the best sequence. A
document is kept when the content lines hold at least ``min_share`` of the characters of
its words. Fixed base rules come first: too few words, or too many words in repeated
five-word windows.

The field is trained on the driver from at most ``sample`` labelled documents a class
(``labels.quality``), of which all lines count, a long one in chains of ``CHAIN`` lines (the
transition from one chain to the next isn't learnt); a line's training label is its document's, and as lines of ordinary
prose are common in good documents, the field learns which lines set bad ones apart.

Defined cases: a null text has no words and no line (base_failed, not kept). Blank lines
carry no weight. Repeated rows are judged one by one. Without labels of both classes the
field keeps every line, so only the base rules decide. Extra columns are ignored.
Rows are independent of each other: one map-only job, no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.common import bound_batches, labelled_sample, table, text_or_empty

#: Labelled documents of each class that the driver fits the field on, and lines of a chain they are cut into.
SAMPLE = 1200
CHAIN = 64
MIN_SHARE = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Fixed: the symbols that are counted.
SYMBOLS = "#*$%&|<>"
#: Fixed: white space between words.
SPACES = " \t\n\x0b\x0c\r"
N_FEATURES = 13

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double, line_labels string"
)

_CLASS = None


def _classes() -> np.ndarray:
    """Class of each code point below 65,536: 1 lower, 2 upper, 3 digit, 4 symbol, 5 '!' and '?', 6 space, 0 other."""
    global _CLASS
    if _CLASS is None:
        found = np.zeros(65536, np.uint8)
        for c in range(65536):
            ch = chr(c)
            if ch in SPACES:
                found[c] = 6
            elif ch in SYMBOLS:
                found[c] = 4
            elif ch in "!?":
                found[c] = 5
            elif ch.islower():
                found[c] = 1
            elif ch.isupper():
                found[c] = 2
            elif ch.isdigit():
                found[c] = 3
        _CLASS = found
    return _CLASS


@dataclass(frozen=True)
class LineField:
    """Weights of the states (boilerplate 0, content 1) and of their transitions."""

    weights: np.ndarray  # 2 x N_FEATURES
    moves: np.ndarray  # 2 x 2

    def decode(self, scores: np.ndarray) -> list[int]:
        """The best sequence of states; a tie goes to content."""
        if not len(scores):
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = scores[0].tolist()
        back = []
        for s0, s1 in scores[1:].tolist():
            from0, from1 = b + m10 >= a + m00, b + m11 >= a + m01
            a, b = (b + m10 if from0 else a + m00) + s0, (b + m11 if from1 else a + m01) + s1
            back.append((from0, from1))
        states = [int(b >= a)]
        for step in reversed(back):
            states.append(int(step[states[-1]]))
        return states[::-1]


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line, and the characters of its words."""
    lines = text.split("\n")
    codes = np.frombuffer((text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[np.minimum(codes, 65535)]
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.stack([np.add.reduceat((kind == k).astype(np.int32), starts) for k in range(1, 7)], 1).astype(np.float64)
    counts[:, 5] -= 1  # the line's own end
    length = (ends - starts).astype(np.float64)
    solid = np.maximum(length - counts[:, 5], 0)
    per = np.maximum(solid, 1)
    seen: set[str] = set()
    extra = np.zeros((len(lines), 5))
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        extra[i] = (min(n, 60) / 60, len(set(words)) / n if n else 1.0, line in seen, " | " in line, n <= 3)
        seen.add(line)
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    out = np.empty((len(lines), N_FEATURES))
    out[:, 0] = 1
    out[:, 1] = counts[:, 3] / per * 4
    out[:, 2] = counts[:, 2] / per * 2
    out[:, 3] = counts[:, 1] / letters * 2
    out[:, 4] = counts[:, 4] / per * 4
    out[:, 5] = (counts[:, 0] + counts[:, 1]) / per
    out[:, 6] = np.minimum(per / np.maximum(counts[:, 5] + 1, 1), 20) / 10
    out[:, 7:12] = extra
    out[:, 12] = counts[:, 1] > counts[:, 0]
    return out, solid


def fit_field(sample: list[tuple[str, int]], steps: int = 150, rate: float = 0.15, ridge: float = 1e-3) -> LineField:
    """Maximum likelihood by forward-backward and Adam over the padded sample."""
    keep_all = LineField(np.zeros((2, N_FEATURES)), np.zeros((2, 2)))
    docs, n_docs = [], np.zeros(2)
    for text, label in sample:
        x, solid = line_features(text)
        x = x[solid > 0]
        total = len(x)
        docs += [(x[i : i + CHAIN], label, total) for i in range(0, total, CHAIN)]
        n_docs[label] += total > 0
    if not n_docs.all():
        return keep_all
    n, t = len(docs), max(len(x) for x, _, _ in docs)
    X, M, Y = np.zeros((n, t, N_FEATURES)), np.zeros((n, t)), np.array([label for _, label, _ in docs])
    for i, (x, _, _) in enumerate(docs):
        X[i, : len(x)], M[i, : len(x)] = x, 1
    each = 1 / np.array([total for _, _, total in docs]) / n_docs[Y]  # documents of either class weigh the same
    w, v = np.zeros((2, N_FEATURES)), np.zeros((2, 2))
    p = np.concatenate([w.ravel(), v.ravel()])
    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    gold = np.zeros((n, t, 2))
    gold[np.arange(n), :, Y] = 1
    gold *= M[:, :, None]
    gold_moves = np.zeros((2, 2))
    for y in (0, 1):
        gold_moves[y, y] = ((M[:, 1:].sum(1)) * each)[Y == y].sum()
    for step in range(1, steps + 1):
        w, v = p[: 2 * N_FEATURES].reshape(2, -1), p[2 * N_FEATURES :].reshape(2, 2)
        S = X @ w.T
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = S[:, 0]
        for i in range(1, t):
            now = np.logaddexp(alpha[:, i - 1, :1] + v[0], alpha[:, i - 1, 1:] + v[1]) + S[:, i]
            alpha[:, i] = np.where(M[:, i, None] > 0, now, alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            after = S[:, i + 1] + beta[:, i + 1]
            now = np.stack([np.logaddexp(v[k, 0] + after[:, 0], v[k, 1] + after[:, 1]) for k in (0, 1)], 1)
            beta[:, i] = np.where(M[:, i + 1, None] > 0, now, beta[:, i + 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        marginal = np.exp(alpha + beta - z[:, None, None]) * M[:, :, None]
        g_w = np.einsum("ntk,ntf,n->kf", gold - marginal, X, each)
        pair = np.exp(alpha[:, :-1, :, None] + v[None, None] + (S + beta)[:, 1:, None, :] - z[:, None, None, None])
        g_v = gold_moves - np.einsum("ntab,nt,n->ab", pair, M[:, 1:], each)
        g = np.concatenate([g_w.ravel(), g_v.ravel()]) - ridge * p
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        p = p + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    return LineField(p[: 2 * N_FEATURES].reshape(2, -1), p[2 * N_FEATURES :].reshape(2, 2))


def _repeat_words(words: list[bytes]) -> int:
    """Words in five-word windows that the text has twice or more."""
    n = len(words) - 4
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == n:
        return 0
    first: dict = {}
    found = np.zeros(n, bool)
    for i, x in enumerate(windows):
        j = first.setdefault(x, i)
        if j != i:
            found[i] = found[j] = True
    edges = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(found)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + 5, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def judge(text: str, field: LineField, min_share: float = MIN_SHARE) -> tuple:
    """The columns after ``doc_id`` in ``SCHEMA`` for one text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split takes ASCII white space only
    n_words = len(words)
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    solid_lines = [x for x in text.split("\n") if x.strip(SPACES)]
    n_repeat = _repeat_words(words)
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    x, solid = line_features(text)
    states = field.decode((x @ field.weights.T)[solid > 0])
    weights = solid[solid > 0]
    share = float(weights @ np.array(states, float) / weights.sum()) if len(weights) else 0.0
    labels = "".join("BC"[s] for s in states)
    return n_words, word_chars, n_symbols, len(solid_lines) - len(set(solid_lines)), n_repeat, failed, not failed and share >= min_share, share, labels


def quality_rules(docs: DataFrame, field: LineField, min_share: float = MIN_SHARE) -> DataFrame:
    """``SCHEMA`` for each row of ``docs`` (doc_id, text)."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [judge(t, field, min_share) for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(cols, kinds)], names)

    bound_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineField:
    return fit_field(labelled_sample(docs, labels, "quality", sample))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fitted(docs, table(spark, sf_dir, "labels")))
