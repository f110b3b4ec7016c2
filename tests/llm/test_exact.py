"""Searches that must not leave anything out, against brute force."""

import itertools
import random
from collections import Counter

import numpy as np

from flowloom.llm import decontaminate as D
from flowloom.llm.common import keyed_rows
from flowloom.llm import quality as Q
from flowloom.llm import toxicity as T


def channel(words):
    total = np.zeros(T.A**4)
    for word, n in words.items():
        g = 0
        for k in (*T._codes(word), 0):
            g = g % T.A**3 * T.A + k
            total[g] += n
    return T.Channel(total.reshape((T.A,) * 4))


def best_of_all(c, token):
    """The best letters for a token of letters and masks without neighbours alike but masks, all paths tried."""
    ways = [[(k, T.WILD) for k in range(1, 27)] + [(0, T.SKIP_LEET)] if ch in T.WILDCARDS else [(ord(ch) - 96, 0.0)] for ch in token]
    best = (-np.inf, "")
    for path in itertools.product(*ways):
        state, score = 0, 0.0
        for k, cost in path:
            score += cost
            if k:
                score += c.log[state * T.A + k]
                state = (state * T.A + k) % T.A**3
        best = max(best, (score + c.log[state * T.A], "".join(chr(96 + k) for k, _ in path if k)))
    return best[1]


def test_masked_rare_word_among_common_ones():
    letters = "abcdeghilmnoprstuvwy"
    words = Counter({f"f{a}{b}a": 50 for a in letters for b in letters}) + Counter({"fxzk": 3, "quick": 900, "think": 900})
    c = channel(words)
    for token in ("f**k", "f#?k", "q**c*", "t*?nk", "*a*", "f*_a"):
        assert c.decode(token) == best_of_all(c, token), token
    assert c.decode("f**k") == "fxzk"


def test_arrays_and_dictionaries_decode_alike():
    c = channel(Counter({"fuck": 30, "shit": 30, "hello": 90, "bitch": 20, "silly": 40, "class": 40, "ball": 30}))
    for token in ("sh1t", "h3ll0", "b!tch", "f*ck", "heeelllo", "s.i.l.l.y", "5i11y", "cl@$$", "ba11", "b-a-l-l", "1616161", "sh*t"):
        assert c.decode(token) == c._decode_dense(token), token


def test_lines_far_down_teach_the_field():
    rng = random.Random(4)
    prose = [" ".join(rng.choice(["some", "plain", "words", "of", "a", "text", "here"]) for _ in range(9)) for _ in range(400)]
    junk = [" | ".join("#$%&*"[rng.randrange(5)] * 3 for _ in range(4)) for _ in range(100)]
    good = [("\n".join(rng.sample(prose, 100)), 1) for _ in range(6)]
    bad = [("\n".join(rng.sample(prose, 64) + rng.sample(junk, 90)), 0) for _ in range(6)]
    field = Q.fit_field(good + bad)
    x, _ = Q.line_features("\n".join(junk[:30]))
    assert sum(field.decode(x @ field.weights.T)) == 0
    x, _ = Q.line_features("\n".join(prose[:30]))
    assert sum(field.decode(x @ field.weights.T)) == 30


def test_short_items_are_matched_word_for_word(spark):
    docs = [(1, "Well: the capital, of France is Paris."), (2, "capital of Spain"), (3, "france"), (None, "x capital of FRANCE and capital of france")]
    items = [(7, "Capital of France?"), (8, "is paris"), (None, "capital of"), (9, "no such words"), (10, "..."), (11, "capital of france")]
    made = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["_d"], r["item_id"], r["first_word"], r["lcs"]) for r in D.leaks(keyed_rows(made[0]), made[1]).collect()}
    want = {(1, 7, 2, 1.0), (1, 11, 2, 1.0), (1, 8, 5, 1.0), (1, None, 2, 1.0), (2, None, 0, 1.0)}
    assert found == want | {(D.LAST, 7, 1, 1.0), (D.LAST, 11, 1, 1.0), (D.LAST, None, 1, 1.0)}
