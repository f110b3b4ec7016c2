import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from flowloom.llm import suffix_dedup as S


def brute(texts):
    data = [(t or "").encode() for t in texts]
    count = {}
    for d in data:
        for i in range(len(d) - S.LENGTH + 1):
            x = d[i : i + S.LENGTH]
            count[x] = count.get(x, 0) + 1
    out = []
    for d in data:
        mask = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - S.LENGTH + 1):
            if count[d[i : i + S.LENGTH]] > 1:
                mask[i : i + S.LENGTH] = True
        runs = S._runs(mask[: len(d)])
        kept = bytes(b for b, m in zip(d, mask) if not m)
        out.append((len(d), int(mask.sum()), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def test_index_equals_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        pieces, groups = [], []
        for k in range(rng.randint(1, 6)):
            unit = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9)))
            pieces.append((unit * 400)[: rng.randint(1, 1500)] if rng.random() < 0.7 else bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 60))))
            groups.append(rng.randint(0, 1))
        got = S.RunLengthIndex(pieces, groups).matching()
        flat = [(g, p[i:]) for p, g in zip(pieces, groups) for i in range(len(p))]
        order = sorted(range(len(flat)), key=lambda i: flat[i])
        want = [0] * len(flat)
        for x, y in zip(order, order[1:]):
            if flat[x][0] == flat[y][0]:
                a, b = flat[x][1], flat[y][1]
                n = min(len(a), len(b))
                same = n if a[:n] == b[:n] else next(i for i in range(n) if a[i] != b[i])
                want[x], want[y] = max(want[x], same), max(want[y], same)
        assert got.tolist() == want


def check(spark, tmp_path, texts, name):
    path = tmp_path / name
    rows = [(None if i == 3 else i // 2 if i < 2 else i, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, _d string").repartition(3).write.parquet(str(path / "documents.parquet"))
    got = S.op1_suffix_array_dedup(spark, str(path)).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(brute(texts))


def made(rng, n):
    return "".join(rng.choice("abcdefgh é\n") for _ in range(n))


def test_equals_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    passages = [made(rng, rng.randint(150, 900)) for _ in range(8)]
    texts = [None, "", "short", "ab" * 700, "x" * 1500, made(rng, 300)]
    for _ in range(50):
        parts = [rng.choice(passages) if rng.random() < 0.5 else made(rng, rng.randint(0, 300)) for _ in range(rng.randint(1, 4))]
        t = list("".join(parts))
        for _ in range(rng.randint(0, 3)):
            if t:
                t[rng.randrange(len(t))] = "#"
        texts.append("".join(t))
    texts += [texts[10], texts[11], texts[11]]
    check(spark, tmp_path, texts, "a")
    monkeypatch.setattr(S, "GROUP", 3)  # most anchors take the counted way
    check(spark, tmp_path, texts, "b")


def test_no_rows(spark, tmp_path):
    check(spark, tmp_path, [], "c")


def test_place_hash_is_sparks(spark):
    th, pos = np.array([5, -7, 2**62], np.int64), np.array([0, 9, 123456], np.int64)
    rows = [(int(a), int(b)) for a, b in zip(th, pos)]
    got = [r[0] for r in spark.createDataFrame(rows, "t long, p int").select(F.xxhash64("t", "p")).collect()]
    assert S._place_hash(th, pos).view(np.int64).tolist() == got
