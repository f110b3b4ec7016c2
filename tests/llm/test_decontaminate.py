import random

import numpy as np
from pyspark.sql import functions as F

from flowloom.llm import decontaminate as D
from flowloom.llm.common import keyed_rows


def test_lcs_and_answer():
    assert D.lcs("a b c d e".split(), "x a c y e b".split()) == 3
    assert D.lcs([], ["a"]) == 0 and D.lcs(["a"], []) == 0
    assert D.answer_of("One two three four five six? The answer.") == ["the", "answer"]


def test_planted_passages_and_paraphrases(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 16)  # several blocks
    rng = random.Random(9)
    vocab = ["the", "of", "and", "to"] * 60 + [f"w{i}" for i in range(1500)]

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    items = [(i, prose(rng.randint(16, 60)) + ".") for i in range(30)] + [(30, prose(150)), (31, None), (32, ""), (33, "w1 w2"), (None, prose(30))]
    want, docs = set(), []
    for d in range(300):
        text = prose(rng.randint(5, 400))
        if d % 6 == 0:
            i, t = rng.choice(items[:31])
            w = t.split()
            if d % 12 == 0:  # a paraphrase: an eighth of the words replaced, some left out
                for _ in range(len(w) // 8):
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            text = text + "\n" + " ".join(w).upper() + "\n" + prose(rng.randint(0, 200))
            want.add((d, i))
        docs.append((d, text, "en"))
    docs += [(900, None, "x"), (901, "", "x"), (None, "x " + items[3][1], "x"), (902, items[34][1], "x")]
    want |= {(D.LAST, 3), (902, None)}
    found = D.leaks(keyed_rows(spark.createDataFrame(docs, "doc_id long, text string, _d string")), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["_d"], r["item_id"]) for r in found} == want
    # recall of the latent search against brute force on the words
    brute = set()
    for d, t, _ in docs:
        words = D.words_of(t or "")
        for i, x in items:
            q = D.words_of(x or "")
            if len(q) >= D.LEAST_WORDS and any(D.lcs(q, words[a : a + D.WINDOW + 2 * len(q)]) >= D.LCS_SURE * len(q) for a in range(0, max(1, len(words)), D.STRIDE)):
                brute.add((d if d is not None else D.LAST, i))
    assert len(brute & want) >= 0.9 * len(brute)


def test_latent_space_is_the_leading_one(spark):
    """The subspace holds as much of the rows as the exact singular vectors do, and is no wider than asked for."""
    rng = np.random.default_rng(3)
    terms = 60
    topics = [rng.choice(terms, 8, replace=False) for _ in range(5)]
    lists = [[int(t) for t in rng.choice(topics[rng.integers(5)], 6)] + [int(rng.integers(terms))] for _ in range(400)]
    idf = rng.uniform(0.5, 2, terms).astype(np.float32)
    rows = spark.createDataFrame([(x,) for x in lists], "_terms array<int>").repartition(3)
    space = D.latent_space(rows, idf, rank=6)
    dense = np.zeros((len(lists), terms))
    for i, x in enumerate(lists):
        for t in x:
            dense[i, t] += idf[t]
    exact = np.linalg.svd(dense, full_matrices=False)[1]
    assert space.shape == (terms, 6)
    assert (np.linalg.norm(dense @ space) ** 2) >= 0.98 * (exact[:6] ** 2).sum()


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert D.leaks(keyed_rows(none), items).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    assert D.leaks(keyed_rows(docs), items.where(F.lit(False))).count() == 0
