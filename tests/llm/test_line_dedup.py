import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowloom.llm import line_dedup as L
from flowloom.llm.words import hashes, spans, split_words


def brute(rows):
    docs = sorted(((i if i is not None else L.LAST), th, t) for i, t, th in rows)
    seen, kept = [], {}
    done = {}
    for d, th, t in docs:
        if (d, th) in done:
            continue
        out = []
        for line in t.split("\n"):
            w = L.words_of(line)
            if not w:
                out.append(line)
                continue
            hit = any(len(w & v) >= 0.8 * len(w | v) - 1e-9 for v in seen)
            seen.append(w)
            if not hit:
                out.append(line)
        done[d, th] = "\n".join(out)
    return done


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, _d string, _n int")
    found = L.dedup_lines(docs)
    got = [r.asDict() | r["row"].asDict() for r in found.withColumn("th", F.xxhash64(F.coalesce("row.text", F.lit("")))).collect()]
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["_d"], r["_n"]) for r in got))) == sorted(map(repr, rows))
    want = brute([(r["doc_id"], r["text"] or "", r["th"]) for r in got])
    for r in got:
        assert r["kept"] == want[r["doc_id"] if r["doc_id"] is not None else L.LAST, r["th"]], r
    links(got)
    return got


def links(got):
    """Counts of links and class ids equal those of all pairs."""
    places = {(r["doc_id"] if r["doc_id"] is not None else L.LAST, r["th"], no): w for r in got for no, t in enumerate((r["text"] or "").split("\n")) if (w := L.words_of(t))}
    first: dict = {}
    size: dict = {}
    for at in sorted(places):
        first.setdefault(places[at], at)
        size[places[at]] = size.get(places[at], 0) + 1
    of = {w: sum(v != w and len(v & w) >= 0.8 * len(v | w) - 1e-9 for v in first) for w in first}
    for r in got:
        d = r["doc_id"] if r["doc_id"] is not None else L.LAST
        mine = [(no, places[d, r["th"], no]) for no in range(len((r["text"] or "").split("\n"))) if (d, r["th"], no) in places]
        assert r["n_lines"] == len(mine) and r["n_links"] == sum(of[w] for _, w in mine), r
        ids = []
        for no, w in mine:
            a, th, n = first[w]
            if size[w] > 1 or of[w]:
                ids.append((no, f"{'' if a == L.LAST else a}:{th & (1 << 64) - 1:X}:{n}"))
        assert [(x["line_no"], x["class_id"]) for x in r["classes"]] == ids
    return sum(of.values())


def test_equals_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{int(abs(rng.gauss(0, 60)))}" for _ in range(400)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 40))) for _ in range(60)]

    def edit(line):
        w = line.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab + ["new" + str(rng.randrange(999))])
        return " ".join(w) + rng.choice(["", ".", "  "])

    texts = ["\n".join(edit(rng.choice(base)) if rng.random() < 0.9 else rng.choice(["", " ", "..."]) for _ in range(rng.randint(1, 8))) for _ in range(150)]
    rows = [(i, t, "en", 1) for i, t in enumerate(texts)] + [(None, texts[0], None, None), (7, None, "x", 2), (8, "", "x", 2), (9, texts[9], "en", 1), (5, base[1], "x", 1)]
    got = run(spark, rows)
    assert len(got) == len(rows)
    assert sum(r["n_similar"] for r in got) > 20


def test_family_of_near_copies_and_long_text(spark):
    rng = random.Random(6)
    line = [f"t{i}" for i in range(30)]
    rows = []
    for i in range(120):
        w = list(line)
        w[rng.randrange(30)] = f"x{i}"
        rows.append((i, " ".join(w), "en", 0))
    rows.append((500, " ".join(f"z{i}" for i in range(3000)) + "\n" + " ".join(f"z{i}" for i in range(1, 3000)), "en", 0))
    got = {r["doc_id"]: r for r in run(spark, rows)}
    assert got[0]["n_removed"] == 0 and sum(r["n_removed"] for r in got.values()) == 120


def test_empty(spark):
    assert run(spark, []) == []


def test_every_link_of_a_family(spark, monkeypatch):
    rng = random.Random(8)
    line = [f"t{i}" for i in range(30)]
    rows = []
    for i in range(40):
        w = list(line)
        w[rng.randrange(30)] = f"x{i}"
        rows.append((i, " ".join(w) + f"\nonly words of {i} here a{i} b{i}", "en", 0))
    rows += [(100, rows[3][1], "en", 0), (3, rows[3][1], "en", 0), (None, rows[0][1] + "\n" + " ".join(line), "en", 0)]
    assert sum(r["n_links"] for r in run(spark, rows)) > 1400
    monkeypatch.setattr(L, "HOT", 7)  # common tokens are cut into blocks
    assert sum(r["n_links"] for r in run(spark, rows)) > 1400


def test_words_go_to_few_parts(spark, monkeypatch):
    """A pair is verified where its first common entry is, not in a part of each common entry."""
    rng = random.Random(9)
    rows = []
    for i in range(12):
        w = [f"w{i}x{k}" for k in range(100)]
        v = list(w)
        v[rng.randrange(100)] = f"other{i}"
        rows += [(2 * i, " ".join(w), "en", 0), (2 * i + 1, " ".join(v), "en", 0)]
    sent, verified = [], L.verified

    def counted(lines, *rest):
        sent.append(lines.count())
        return verified(lines, *rest)

    monkeypatch.setattr(L, "verified", counted)
    assert sum(r["n_links"] for r in run(spark, rows)) == 24
    assert 24 <= sent[0] <= 60


def test_spans_are_the_words_of_the_lines():
    rng = random.Random(10)
    letters = list("abZÉßİК漢😀.,-«»“”…°'\"\n\n \t\x85\xa0  　\x1c") + ["..", "— ", "x"]
    for _ in range(300):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(rng.randint(0, 9))] + ["a ", "«　"]
        found = pa.array(["left out", *texts]).slice(1)
        h, line, count = spans(found)
        words = [split_words(x) for t in texts for x in t.split("\n")]
        assert h.tolist() == hashes(pa.array([w for x in words for w in x], pa.string())).tolist()
        assert line.tolist() == [i for i, x in enumerate(words) for _ in x]
        assert count.tolist() == [t.count("\n") + 1 for t in texts]


def test_entries_are_sorted_by_group_and_length():
    rng = np.random.default_rng(11)
    for most in (100, 1 << 17):
        e = np.zeros(5000, L.ENTRY)
        e["g"], e["n"] = rng.integers(1 << 47, (1 << 47) + 50, 5000), rng.integers(1, most, 5000)
        found = L._sorted(e)
        assert sorted(zip(e["g"].tolist(), e["n"].tolist())) == list(zip(found["g"].tolist(), found["n"].tolist()))


def test_maps_rule_out_long_lines():
    rng = np.random.default_rng(12)
    n, lines = 220, 40
    words = rng.integers(1, 1 << 62, 400 * lines, dtype=np.uint64)
    a, b = np.triu_indices(lines, 1)
    for vocabulary, bound in ((words, 0.95), (words[:240], 0)):
        sets = [rng.choice(vocabulary, n, replace=False) for _ in range(lines)]
        b0, b1 = L.token_bits(np.concatenate(sets), np.arange(lines) * n)
        differing = L._differing(b0, b1, a, b)
        true = np.array([len(set(sets[i].tolist()) ^ set(sets[j].tolist())) for i, j in zip(a, b)])
        assert (differing <= true).all()
        assert (differing > L._apart(np.array(n), np.array(n), 0.8)).mean() >= bound
