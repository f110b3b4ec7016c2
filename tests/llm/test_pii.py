import hashlib
import random
import re

from flowloom.llm import pii

RX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def ok(kind, m):
    d = re.sub(r"[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, r in RX.items() for m in re.finditer(r, text or "") if ok(k, m[0])]


def derived(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, kind string")
    found = pii.find_pii(docs)
    return found.select("doc_id", pii._joined("base").alias("b"), pii._joined("spans").alias("s")).collect()


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    bits = ["a@b.co", "x.y+z@mail-1.example.com", "é😀", " ", "\n", "42.144.35.254", "1.2.3", "300.1.1.1", "4808370617528420", "4808 3706 1752 8420",
            "+1 (409) 555-8387", "+49", "@", "..", "-", "foo@bar", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "40418949746087", "0" * 25, "call ", "%", "+"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += [None, "", "a" * 30000, "a." * 9000 + "@" + "b." * 9000 + "c", "1." * 9000, "9" * 30000, "+1" + " " * 20000]
    rows = [(i, t, "x", None) for i, t in enumerate(texts)] + [(None, "a@b.co", None, "k"), (0, texts[0], "x", "k")]
    got = derived(spark, rows)
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in enumerate(texts):
        assert by_id[i]["b"] == ",".join(f"{k}:{s}:{e}" for k, s, e in brute(t)), repr(t)[:200]
        assert set(filter(None, by_id[i]["b"].split(","))) <= set(by_id[i]["s"].split(","))
    assert by_id[None]["b"] == "email:0:6"


def test_further_spans_and_empty_table(spark):
    good = "Please call (409) 555-8387 or write to jane [at] mail [dot] com today"
    got = derived(spark, [(i, good, None, None) for i in range(5)])
    assert all("phone_local:12:26" in r["s"] and "email_obfuscated" in r["s"] and r["b"] == "" for r in got)
    assert derived(spark, []) == []


def test_query_digest(spark, tmp_path):
    spark.createDataFrame([(1, "x a@b.co"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in pii.op10_pii(spark, str(tmp_path)).collect()}
    assert rows[1]["n_email"] == 1 and rows[1]["base_sha256"] == hashlib.sha256(b"email:2:8").hexdigest()
    assert rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[2]["spans"] == ""
