"""Operators whose rows are independent: quality rules, HTML extraction, packing, WARC, toxicity."""

import base64
import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from flowloom.llm import html_extract as H
from flowloom.llm import packing as P
from flowloom.llm import quality as Q
from flowloom.llm import toxicity as T
from flowloom.llm import warc as W

PROSE = ["the and of to in a is it was for on with as by at from this that be are".split(), [f"w{i}ing" for i in range(300)]]


def prose(rng, n):
    return " ".join(rng.choice(PROSE[rng.random() < 0.5]) for _ in range(n)).capitalize() + "."


# --- quality -----------------------------------------------------------------------------


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(1)
    good = ["\n".join(prose(rng, rng.randint(12, 40)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    bad = ["\n".join(" ".join(w + rng.choice(["***", "$$$"]) for w in prose(rng, 20).split()) for _ in range(4)) for _ in range(60)]
    odd = [None, "", " \n\t", "a b c d e " * 30, "x\x1cy\xa0z \x0bq", "line\nline\n\nline", "é😀 " * 12, "w " * 20000]
    texts = good + bad + odd + [good[0]]
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(i < 60), None) for i in range(1, 110)] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    rows = Q.quality_rules(docs, Q.fitted(docs, labels)).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = by[i if i else None]
        assert tuple(r)[1:7] == brute_quality(t or ""), i
    assert all(by[i if i else None]["kept"] for i in range(60)) and not any(by[i]["kept"] for i in range(110, 120))
    assert Q.quality_rules(docs.limit(0), Q.fitted(docs, labels.limit(0))).count() == 0
    assert all(Q.judge(t, Q.fit_field([]))[6] for t in good)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n, field = rng.integers(1, 8), Q.LineField(None, rng.normal(size=(2, 2)))
        s = rng.normal(size=(n, 2))

        def value(x):
            return sum(s[i, a] for i, a in enumerate(x)) + sum(field.moves[a, b] for a, b in zip(x, x[1:]))

        best = max((tuple((k >> i) & 1 for i in range(n)) for k in range(2**n)), key=value)
        assert value(field.decode(s)) == pytest.approx(value(best))


# --- HTML --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def trees():
    return H.fit_trees([], layouts=300)


def test_extraction_on_unseen_layouts(trees):
    rng = random.Random(77)
    paragraphs = [prose(rng, 60) for _ in range(40)]
    good = wrong = 0
    for _ in range(80):
        source, content = H.layout(rng, paragraphs)
        text = H.extract(source, trees)
        taken = set(re.findall(r"qz\d+x", text))
        good += len(taken & content)
        wrong += len(taken ^ content)
    assert wrong < 0.05 * good


def test_extraction_edge_cases(spark, trees):
    rng = random.Random(3)
    a, b = prose(rng, 40), prose(rng, 30)
    page = f"<html><head><title>t</title><style>p{{}}</style><script>var x='<p>no</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul></nav><article><h1>{a}</h1><p>{a} &amp; &lt;b&gt;<br>  {b}<!-- no --><p>{b}</article><footer>&copy; nobody</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p"), (1, "u", page), (4, "x", "<div>" * 2000 + a), (5, "y", "<script>no")]
    got = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), trees).collect()
    want = "\n".join([a, f"{a} & <b> {b}", b])
    assert [r["text"] for r in got if r["page_id"] == 1] == [want, want]
    by = {r["page_id"]: r for r in got}
    assert by[1]["n_chars"] == len(want) and by[2]["text"] == by[3]["text"] == by[5]["text"] == "" and by[None]["text"] == ""
    assert html.unescape("&am") == "&am"


ARTICLE = "<article><h1>Title here</h1>" + "".join(f"<p>This is paragraph {i} of the article.</p>" for i in range(5)) + "</article>"
BEFORE = [
    "<script>if(a<b&&c)d()</script>", "<script>if(a<b){x=\"it's\"}</script>", "<script>var a='<!--';</script>", "<select><option>One<option>Two</select>", "<option>",
    "<div><button>Go</div>", "<button>Go", "<textarea>", "<noscript>", '<div class="x>', "<a title='it>", "<svg><path d='x'/><title>t</title></svg>", "<video><source src=x><p>none</p></video>",
]


@pytest.mark.parametrize("before", BEFORE)
@pytest.mark.parametrize("head", ["<html><head><title>x</title></head><body>", "<head><meta charset=utf-8><title>x</title>"])
def test_what_stands_before_an_article_loses_none_of_it(head, before):
    want = ["Title here", *(f"This is paragraph {i} of the article." for i in range(5))]
    runs = [t for t in H.parse(head + before + ARTICLE).text if t]
    assert [t for t in runs if t in want] == want
    assert not {"none", "One", "x", "t"} & set(runs)


@pytest.mark.parametrize("part", ['<a "', "<div>", "<textarea>", "<p><button>", "<!", "</p>", '<p title="x'])
def test_long_pages_take_linear_time(part):
    import time

    took = []
    for n in (100_000, 1_000_000):
        began = time.process_time()
        H.parse(part * (n // len(part)))
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.02)


def test_math_is_text():
    assert [t for t in H.parse("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, 1 < 2 and a<3.</p>").text if t] == ["So x=2, 1 < 2 and a<3."]


def test_decoding_equals_the_best_of_all_cuts():
    """Against all consistent choices: each node is taken whole, left whole, or split for a cost."""
    rng = np.random.default_rng(5)

    def best(dom, s, i):
        """(score, runs taken) of the best choice for the subtree of i."""
        below = [j for j in range(len(dom.tag)) if _under(dom, j, i)]
        kids = [j for j in range(len(dom.tag)) if dom.parent[j] == i]
        whole = sum(H.OWN_WEIGHT * s[j] for j in below)
        runs = {j for j in below if dom.tag[j] == "#text"}
        options = [(whole, runs), (-whole, set())]
        if dom.tag[i] != "#text":
            parts = [best(dom, s, k) for k in kids]
            options.append((sum(p[0] for p in parts) - H.SPLIT, set().union(*(p[1] for p in parts)) if parts else set()))
        return max(options, key=lambda x: x[0])

    for _ in range(40):
        dom = H.parse("<div><p>a</p><div><p>b</p>c</div></div><ul><li>d<li>e</ul><p>f")
        s = rng.normal(size=len(dom.tag)) * 2
        got = {i for i, y in enumerate(H.decode(dom, s)) if y and dom.tag[i] == "#text"}
        assert got == best(dom, s, 0)[1]


def test_tree_decoding_is_consistent_and_best():
    rng = np.random.default_rng(4)
    for _ in range(30):
        dom = H.parse("<div><p>a</p><div><p>b</p>c</div></div><ul><li>d<li>e</ul>")
        s = rng.normal(size=len(dom.tag)) * 2
        got = H.decode(dom, s)
        for i, y in enumerate(got):
            assert not y or dom.tag[i] != "#text" or dom.text[i]
        inner = [i for i, t in enumerate(dom.tag) if t != "#text"]
        for i in inner:  # a subtree that is taken has all its runs taken
            if got[i]:
                assert all(got[j] for j in range(len(dom.tag)) if _under(dom, j, i))


def _under(dom, j, i):
    while j >= 0:
        if j == i:
            return True
        j = dom.parent[j]
    return False


# --- packing -----------------------------------------------------------------------------


def least_bins(lengths, c=4096):
    """A lower bound of the bins that any packing needs (by thresholds)."""
    best = 0
    for k in {0, *[x for x in lengths if x <= c // 2]}:
        one = sum(x > c - k for x in lengths)
        two = [x for x in lengths if c // 2 < x <= c - k]
        small = sum(x for x in lengths if k <= x <= c // 2)
        best = max(best, one + len(two) + max(0, -(-(small - (len(two) * c - sum(two))) // c)))
    return best


def test_pieces_and_places(spark):
    rng = random.Random(5)
    texts = [None, "", "Hello, it's 42!", "<|endoftext|> x", "日本 ½ ﬁ", prose(rng, 6000)] + [prose(rng, rng.randint(1, 900)) for _ in range(150)]
    texts += [texts[7]] * 40
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)] + [(9, texts[9], 2)], "doc_id long, text string, piece int")
    rows = P.pack(docs).collect()
    ids = P.Ids()
    want = Counter()
    for i, t in [(i if i else None, t) for i, t in enumerate(texts)] + [(9, texts[9])]:
        data = np.array(ids.whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(data), 4096):
            part = data[k : k + 4096].tobytes()
            want[i, k // 4096, k, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= least_bins([r["length"] for r in rows]) + 1
    assert P.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("histogram", [{}, {4096: 7}, {1: 10000}, {3000: 5, 2000: 5}, {2049: 9, 2047: 9}, {1366: 3}])
def test_plan_is_near_the_bound(histogram):
    plan = P.solve(histogram, slices=8)
    total = sum(a * b for a, b in histogram.items())
    assert plan.tokens == total
    big = sum(c for n, c in histogram.items() if n > 2048)
    assert plan.sequences <= max(-(-total // 4096), big) + 3
    # the prices prove a bound, and the fractional solution covers every length exactly
    assert plan.bound <= plan.fractional + 1e-6 and plan.bound <= plan.sequences + 1e-6
    cover: dict = {}
    for config, amount in P.fractional({n: c for n, c in histogram.items() if c}, slices=8)[0]:
        assert sum(n * k for n, k in config.items()) <= 4096 and amount > 0
        for n, k in config.items():
            cover[n] = cover.get(n, 0) + k * amount
    assert cover == pytest.approx({n: c for n, c in histogram.items() if c})


def test_fractional_solution_is_near_the_optimum():
    rng = np.random.default_rng(6)
    histogram = {int(n): int(c) for n, c in zip(rng.choice(np.arange(50, 3500), 300, replace=False), rng.integers(1, 5000, 300))}
    plan = P.solve(histogram)
    assert plan.fractional <= 1.01 * plan.bound and plan.sequences <= 1.01 * plan.bound + 1


# --- WARC --------------------------------------------------------------------------------


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "TRAIN_BYTES", 20_000)
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 30_000)
    rng = random.Random(6)
    rows = [(i, f"http://x/{i}\r\n", f"<p>{prose(rng, rng.randint(1, 300))} é {i}</p>") for i in range(300)]
    rows += [(1000 + i, None, "same " * 50) for i in range(120)] + [(2000, "u", None), (2001, "u", ""), (None, "u", "same " * 50), (None, "v", "alone"), (5, *rows[5][1:]), (3000, "big", "x" * 200_000)]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, sha int").repartition(3)
    manifest = W.write_archives(pages, f"file://{tmp_path}/a")
    got = W.read_archives(manifest).collect()
    assert Counter((r["page_id"], r["payload_digest"], r["payload_bytes"]) for r in got) == Counter((i, base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), len((h or "").encode())) for i, _, h in rows)
    assert not any(r["error"] for r in got)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", -1))
    text = {base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(): h or "" for _, _, h in rows}
    for r in got:
        h = text[r["payload_digest"]]
        response = last.get(h) is None or r["page_id"] == last[h]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if response else ("revisit", last[h]))
        assert r["payload"] == (h.encode() if response else None)
    assert W.read_archives(W.write_archives(pages.limit(0), f"file://{tmp_path}/b")).count() == 0


def test_faults_are_found():
    good = W.record(1, "u", b"abc", W.base32_sha1(b"abc"), None, True)
    assert W._parse(good)[-1] is None
    assert "record length" in W._parse(good[:-1])[-1]
    assert "payload digest" in W._parse(good.replace(b"abc", b"abd"))[-1]
    assert "version" in W._parse(good.replace(b"WARC/1.1", b"WARC/9"))[-1]
    import io

    with pytest.raises(ValueError):
        list(W.frames(io.BytesIO(b"\x28\xb5\x2f\xfd0000")))


# --- toxicity ----------------------------------------------------------------------------


def test_disguised_words_are_restored_and_scored(spark):
    rng = random.Random(7)
    mean = "idiot moron clown loser worthless pathetic stupid disgusting".split()
    docs, labels = [], []
    for i in range(700):
        words = prose(rng, 40).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(mean))
        docs.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(bad)))
    docs_df = spark.createDataFrame(docs + [(None, "an idiot", "x"), (701, None, "x"), (702, "", "x")], "doc_id long, text string, score string")
    labels_df = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = T.fitted(docs_df, labels_df)
    rows = {r["doc_id"]: r for r in T.toxicity(docs_df, model).collect()}
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(rows[i]["predicted"] == y for i, _, y in labels)
    assert rows[701]["predicted"] == rows[702]["predicted"] == 0 and 0 <= rows[701]["score"] <= 1
    for text in ("you 1d10t", "what a l o s e r", "st*pid", "m.o.r.o.n", "pathetiiiiic", "w0rthl3$s", "CL0WN!!!"):
        assert model.score("and this was " + text) >= T.THRESHOLD, text
    assert T.toxicity(docs_df.limit(0), T.fitted(docs_df.limit(0), labels_df.limit(0))).count() == 0
