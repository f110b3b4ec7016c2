"""Operator 9, toxicity: noisy-channel deobfuscation, then a linear score of the restored text.

Character language model: four-gram counts over the letters of every word of the whole
corpus. Each task counts its words, turns them into at most ``27 ** 4`` counts and these
are summed, so what is shuffled and collected is bounded by the alphabet.

Restoring: a token that shows signs of disguise (digits or symbols among its letters,
stretched letters, letters spaced out) becomes a lattice in which each character may stand
for one of several letters or for nothing. Viterbi decoding takes the path with the best
sum of channel and language-model scores, over all states. Plain words have one path and skip the search.

Scoring: words whose presence goes with the label (a log-likelihood ratio test) are the
features of a ridge logistic regression. It is fitted on the driver from at most ``SAMPLE``
labelled documents a class, of rows whose crc32(doc_id) mod 4 is not 2. Label, language,
source and id are no inputs of a score.

Defined cases: null and empty texts score as texts without any listed word. A null doc_id
is not held out and never learnt from. Repeated rows are scored one by one. Without labels
of both classes every score is ``0``. Extra columns are ignored. Scoring is map-only.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import bound_batches, labelled_sample, table, text_or_empty

#: Labelled documents of each class that the score is fitted on.
SAMPLE = 3000
MIN_LLR = 18.0
THRESHOLD = 0.3
#: Distinct tokens that a task remembers before it starts afresh; a memory bound, results don't depend on it.
MEMO = 300_000

#: Fixed: what a character may stand for besides itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "§": "s", "¢": "c",
}
#: Fixed: letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухікмтвнѕјԁո", "aeopcyxikmtbhsjdn")
#: Fixed: characters without width.
HIDDEN = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))
#: Costs in the channel, as natural logarithms.
SWAP, SKIP, SKIP_LEET, SQUEEZE, WILD = -0.5, -1.0, -9.0, -0.1, 0.0
WILDCARDS = "*#%_?"

_SPACED = re.compile(r"(?<!\S)\w(?:[ \t._*-]{1,3}\w){2,}(?!\w)")
_STRETCH = re.compile(r"(.)\1\1")
#: A separator after each letter, the same one throughout.
_DOTTED = re.compile(r"\w([._*\-~|/\\+])\w(?:\1\w)+")
_LETTERS = re.compile(r"[^\W\d_]+")
_LEAD = "\"'([{<*#%&.,;:-_~^`“”‘’«»¿¡"
_TAIL = ".,;:!?\"')]}>*#%&-_~^|`“”‘’«»…"
A = 27  # a to z, and 0: the edge of a word


def _codes(word: str) -> list[int]:
    """Letters of a word as 1 to 26, accents dropped; other letters are left out."""
    if not word.isascii():
        word = unicodedata.normalize("NFD", word)
    return [c - 96 for c in map(ord, word) if 97 <= c <= 122]


def gram_counts(docs: DataFrame) -> np.ndarray:
    """27 x 27 x 27 x 27 counts over every word of every text."""
    bound_batches(docs.sparkSession)

    def run(batches):
        total = np.zeros(A**4, np.int64)
        words: Counter = Counter()

        def flush():
            for word, n in words.items():
                g = 0
                for k in (*_codes(word), 0):
                    g = g % A**3 * A + k
                    total[g] += n
            words.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update(_LETTERS.findall(text.lower()))
                if len(words) > MEMO:
                    flush()
        flush()
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    out = np.zeros(A**4)
    grams = docs.select(text_or_empty().alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    for gram, n in grams.collect():  # at most 27 ** 4 rows
        out[gram] = n
    return out.reshape(A, A, A, A)


@dataclass
class Channel:
    """Viterbi decoding of disguised tokens under the character model."""

    counts: np.ndarray
    memo: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        c = self.counts
        p = (c.sum((0, 1, 2)) + 1) / (c.sum() + A)
        for drop, weight in (((0, 1), 20), ((0,), 5), ((), 2)):  # interpolated: longer contexts lean on shorter ones
            now = c.sum(drop) if drop else c
            p = (now + weight * p) / (now.sum(-1, keepdims=True) + weight)
        self.grams = np.log(p)
        self.log = self.grams.ravel().tolist()

    def __getstate__(self):
        return {"counts": self.counts}

    def __setstate__(self, state):
        self.counts, self.memo = state["counts"], {}
        self.__post_init__()

    def decode(self, token: str) -> str:
        """The likeliest letters behind ``token``; a state is the last three letters."""
        if sum(map(token.count, WILDCARDS)) > 1:
            return self._decode_dense(token)
        log, cube = self.log, A**3
        best: dict = {0: (0.0, None)}
        run = 0
        for i, ch in enumerate(token):
            run = run + 1 if i and token[i - 1] == ch else 1
            stretched = run > 1 and (run > 2 or token[i + 1 : i + 2] == ch)
            base = _codes(ch)
            options = [(base[0], 0.0)] if base else []
            options += [(ord(x) - 96, SWAP) for x in LEET.get(ch, "")]
            if ch in WILDCARDS:
                options += [(k, WILD) for k in range(1, 27)]
            skip = None if base else SKIP_LEET if ch in LEET or ch in WILDCARDS else SKIP
            now: dict = {}
            for state, (score, path) in best.items():
                for k, cost in options:
                    gram = state * A + k
                    s, to = score + cost + log[gram], gram % cube
                    if to not in now or s > now[to][0]:
                        now[to] = (s, (path, k))
                    if stretched and k == state % A:  # the letter again, nothing new
                        s = score + SQUEEZE
                        if state not in now or s > now[state][0]:
                            now[state] = (s, path)
                if skip is not None:
                    s = score + skip
                    if state not in now or s > now[state][0]:
                        now[state] = (s, path)
            best = now
        path = max(best.items(), key=lambda x: (x[1][0] + log[x[0] * A], x[0]))[1][1]
        out = []
        while path:
            path, k = path
            out.append(chr(96 + k))
        return "".join(reversed(out))

    def _decode_dense(self, token: str) -> str:
        """The same search over arrays of all ``27 ** 3`` states: masked letters reach most of them."""
        score = np.full((A, A, A), -np.inf)
        score[0, 0, 0] = 0.0
        back = []
        run = 0
        for i, ch in enumerate(token):
            run = run + 1 if i and token[i - 1] == ch else 1
            stretched = run > 1 and (run > 2 or token[i + 1 : i + 2] == ch)
            base = _codes(ch)
            costs = {k: WILD for k in range(1, 27)} if ch in WILDCARDS else {}
            costs |= {ord(x) - 96: SWAP for x in LEET.get(ch, "")}
            costs |= {base[0]: 0.0} if base else {}
            skip = None if base else SKIP_LEET if ch in LEET or ch in WILDCARDS else SKIP
            now, origin = np.full((A, A, A), -np.inf), np.full((A, A, A), -1, np.int8)  # -1: no new letter
            if skip is not None:
                now = score + skip
            if stretched and costs:
                k = list(costs)
                now[:, :, k] = np.maximum(now[:, :, k], score[:, :, k] + SQUEEZE)
            if costs:
                k = list(costs)
                new = score[..., None] + np.array(list(costs.values())) + self.grams[..., k]
                least = new.max(0)
                better = least > now[:, :, k]
                origin[:, :, k] = np.where(better, new.argmax(0), -1)
                now[:, :, k] = np.where(better, least, now[:, :, k])
            back.append(origin)
            score = now
        total = (score + self.grams[..., 0]).ravel()
        at = np.unravel_index(len(total) - 1 - int(total[::-1].argmax()), score.shape)
        out = []
        for origin in reversed(back):
            if origin[at] >= 0:
                out.append(chr(96 + at[2]))
                at = (int(origin[at]), at[0], at[1])
        return "".join(reversed(out))

    def restore(self, token: str) -> str:
        """The plain word behind a lower-case token; the token's core where nothing is disguised."""
        if (found := self.memo.get(token)) is not None:
            return found
        word = token
        if not word.isascii():
            word = unicodedata.normalize("NFKC", word).translate(HIDDEN)
            if any("Ѐ" <= c <= "֏" for c in word):
                word = word.translate(LOOKALIKES)
        word = word.lstrip(_LEAD).rstrip(_TAIL)
        if word.endswith("$$$"):
            word = word.rstrip("$" + _TAIL)
        if _DOTTED.fullmatch(word):
            word = word[::2]
        if not word.isalpha() and any(c.isalpha() for c in word) or _STRETCH.search(word):
            word = self.decode(word)
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.memo[token] = word
        return word

    def words(self, text: str) -> set[str]:
        """The distinct restored words of a text, words with spaced-out letters included."""
        text = text.lower()
        raw = set(text.split())
        found = set(map(self.restore, raw))
        for m in _SPACED.finditer(text):
            if any(c.isalpha() for c in m[0]):
                run = "".join(m[0].split())
                found.update(map(self.restore, (run, run[1:], run[:-1])))  # a word of one letter may stand beside it
        found.discard("")
        return found


@dataclass(frozen=True)
class ToxicScore:
    channel: Channel
    weights: dict
    bias: float
    alone: dict  # how surely a word by itself tells

    def of(self, found: list[str]) -> float:
        """The score of a text that has these of the listed words: the regression's, or that of its most telling word."""
        if not self.weights:
            return 0.0
        z = self.bias + sum(self.weights[x] for x in found)
        return max(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), max((self.alone[x] for x in found), default=0.0))

    def listed(self, text: str) -> list[str]:
        return sorted(x for x in self.channel.words(text) if x in self.weights)

    def score(self, text: str) -> float:
        return self.of(self.listed(text))


def fit_score(channel: Channel, sample: list[tuple[str, int]], odds: float | None = None, min_llr: float = MIN_LLR) -> ToxicScore:
    """Words chosen by a likelihood ratio, weights by Newton steps of a ridge logistic regression.

    ``odds``: of label 1 among all labelled rows, where the sample has other shares.
    """
    n = Counter(y for _, y in sample)
    if len(n) < 2:
        return ToxicScore(channel, {}, 0.0, {})
    bags = [(channel.words(t), y) for t, y in sample]
    df = {y: Counter() for y in (0, 1)}
    for words, y in bags:
        df[y].update(words)

    def llr(word: str) -> float:
        k1, k0, n1, n0 = df[1][word], df[0][word], n[1], n[0]
        p = (k1 + k0) / (n1 + n0)

        def like(k, m, q):
            return (k * math.log(q) if k else 0.0) + ((m - k) * math.log(1 - q) if m - k else 0.0)

        return 2 * (like(k1, n1, k1 / n1) + like(k0, n0, k0 / n0) - like(k1, n1, p) - like(k0, n0, p))

    chosen = sorted(w for w, k in df[1].items() if k >= 2 and k / n[1] > 3 * df[0][w] / n[0] and llr(w) >= min_llr)
    at = {w: i for i, w in enumerate(chosen)}
    X = np.zeros((len(bags), len(chosen) + 1))
    X[:, -1] = 1
    for r, (words, _) in enumerate(bags):
        for w in words:
            if w in at:
                X[r, at[w]] = 1
    y = np.array([y for _, y in bags], float)
    b = np.zeros(X.shape[1])
    ridge = np.full(X.shape[1], 0.05)
    ridge[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-X @ b))
        step = np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + np.diag(ridge), X.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    shift = math.log(odds / (n[1] / n[0])) if odds else 0.0

    def alone(word: str) -> float:
        """Lower confidence bound of the share of label 1 among texts with the word, at the labels' own odds."""
        k = df[1][word]
        p, m, z = k / (k + df[0][word] * math.exp(-shift)), k + df[0][word], 2.58
        return (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)

    return ToxicScore(channel, dict(zip(chosen, b[:-1].tolist())), float(b[-1]) + shift, {w: alone(w) for w in chosen})


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicScore:
    channel = Channel(gram_counts(docs))
    learn = ~held_out(F.col("doc_id"))
    n = {r["toxic"]: r["n"] for r in labels.where(learn & F.col("toxic").isin(0, 1)).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    odds = n[1] / n[0] if len(n) == 2 else None
    return fit_score(channel, labelled_sample(docs, labels, "toxic", sample, learn), odds)


def toxicity(docs: DataFrame, model: ToxicScore, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, and the listed words that the restored text has."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            scores, words = [], []
            for text in batch.column(2).to_pylist():
                found = model.listed(text)
                scores.append(model.of(found))
                words.append(" ".join(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(words, pa.string())],
                ["doc_id", "held_out", "score", "predicted", "matched_words"],
            )

    doc_id = docs["doc_id"]
    rows = docs.select(doc_id.cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, matched_words string")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fitted(docs, table(spark, sf_dir, "labels")))
