import random

import numpy as np
from pyspark.sql import functions as F

from flowloom.llm import near_dedup as N
from flowloom.llm.common import keyed_rows


def test_signature_collisions_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    hits, want = [], []
    for t in range(60):
        els = rng.integers(0, 2**63, 80).astype(np.uint64)
        wa, wb = rng.integers(0, 9, 80), rng.integers(0, 9, 80)
        keep = rng.random(80) < 0.7
        wb = np.where(keep, wa, wb)
        a, b = wa > 0, wb > 0
        doc = np.concatenate([np.zeros(a.sum(), int), np.ones(b.sum(), int)])
        s = N.bag_signatures(doc, np.concatenate([els[a], els[b]]), np.concatenate([wa[a], wb[b]]), 2, 64)
        hits.append((s[0] == s[1]).mean())
        want.append(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(hits) - np.mean(want)) < 0.02
    assert np.corrcoef(hits, want)[0, 1] > 0.5


def classes(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, _d string")
    keyed = keyed_rows(docs)
    return {(r["_d"], r["_th"]): r["_class"]["_d"] for r in N.near_classes(keyed).collect()}, docs


def brute(rows):
    bags = [(i if i is not None else N.LAST, N.shingles_of(t or "")) for i, t, _ in rows]
    up = {i: i for i, _ in bags}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(bags):
        for j, b in bags[:k]:
            if a and N.overlap(a, b) >= 0.8 - 1e-9:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i, _ in bags}


def test_classes_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for f in range(25):
        base = rng.choices(vocab, k=rng.randint(30, 200))
        for _ in range(rng.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w), "en"))
    rows += [(1000, "", "x"), (1001, None, None), (None, rows[0][1], "x"), (1002, "a b", "x"), (1003, "a  B", "x"), (1004, "a b c", None), rows[3], (1005, "la " * 3000, "x"), (1006, "la " * 2900, "x"), (1007, "la " * 1500, "x")]
    got, docs = classes(spark, rows)
    want = brute([r for k, r in enumerate(rows) if r not in rows[:k]])
    assert {d: c for (d, _), c in got.items()} == want


def test_small_blocks_and_crowds(spark, monkeypatch):
    """The same classes when families are cut into blocks and bands are crowded."""
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "CROWD", 3)
    test_classes_equal_brute_force(spark)
    test_chain_of_copies_and_empty(spark)


def test_chain_of_copies_and_empty(spark):
    rows, w = [], [f"c{i}" for i in range(300)]
    for i in range(30):
        rows.append((i, " ".join(w), "en"))
        w = list(w)
        w[i * 9] = f"new{i}"
        w[i * 9 + 1] = f"newer{i}"
    got, _ = classes(spark, rows)
    assert {d: c for (d, _), c in got.items()} == brute(rows)
    assert classes(spark, [])[0] == {}
