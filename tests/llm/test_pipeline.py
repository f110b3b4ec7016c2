import corpus_pipeline as C
from flowloom.llm import line_dedup, near_dedup, registry

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_a_planted_corpus(spark, tmp_path):
    import random

    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(2000)]

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n)) + "."

    texts = ["\n".join(prose(30) for _ in range(4)) for _ in range(80)]
    item = prose(30)
    texts[10] = texts[10] + "\n" + item
    texts[11] = texts[12]
    texts[20] = texts[21].split("\n")[0] + "\n" + texts[20]
    texts[30] = "too short"
    junk = ["\n".join(" ".join(w + "***" for w in prose(20).split()) for _ in range(3)) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(200 + i, t, "en", "s", len(t)) for i, t in enumerate(junk)] + [(400, None, None, None, None)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2) if i != 30] + [(200 + i, 0, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = C.table(spark, str(tmp_path), "documents")
    seen = {}
    for name, stage in C.STAGES:
        docs = C.cut(stage(spark, docs, str(tmp_path)))
        seen[name] = docs.collect()
        if name != "best-fit packing":
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    ids = {k: {r["doc_id"] for r in v} for k, v in seen.items()}
    assert ids["quality rules"] == set(range(80)) - {30}
    assert ids["line dedup"] == ids["quality rules"] - {12}  # every line of it is in document 11
    kept = {r["doc_id"]: r for r in seen["line dedup"]}
    assert kept[20]["text"] == texts[20] and kept[21]["text"] == "\n".join(texts[21].split("\n")[1:]) and kept[21]["n_chars"] == len(kept[21]["text"])
    assert ids["MinHash near-dedup"] == ids["line dedup"] and ids["benchmark decontamination"] == ids["line dedup"] - {10}
    assert ids["best-fit packing"] == ids["benchmark decontamination"]


def test_near_stage_keeps_one_of_each_class(spark):
    text = " ".join(f"a{i}" for i in range(100))
    rows = [(1, text, "en", "s", 1), (2, text + " z", "en", "s", 1), (2, text + " z", "en", "s", 1), (3, "other words here", "en", "s", 1), (3, "other words here", "en", "s", 1)]
    got = C.near_stage(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3]


def test_which_of_equal_rows_stays_is_defined(spark):
    text = " ".join(f"a{i}" for i in range(100))
    rows = [(1, text, lang, "s", 1) for lang in ("fr", "en", "de")]
    for order in (rows, rows[::-1]):
        got = C.near_stage(spark, spark.createDataFrame(order, COLUMNS).repartition(3), "").collect()
        assert [(r["doc_id"], r["lang"]) for r in got] == [(1, "de")]


def test_clashing_columns_long_texts_and_nulls_pass_through_the_stages(spark, tmp_path):
    long_text = "\n".join(" ".join(f"long{i}x{k}" for k in range(20)) for i in range(20_000))
    prose = "\n".join(" ".join(f"w{i}x{k}" for k in range(30)) for i in range(4))
    rows = [(1, long_text, "K1", "r", 5), (2, prose, "K2", "r", 6), (3, prose + "\n" + prose.replace("w", "v"), "K3", None, 7), (None, prose.replace("w", "u"), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _d string, _row string, _th long")
    got = C.line_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert {(r["doc_id"], r["_d"], r["_row"], r["_th"]) for r in got.collect()} == {(r[0], r[2], r[3], r[4]) for r in rows}
    near = C.near_stage(spark, docs, "")
    assert near.columns == docs.columns and {r["doc_id"] for r in near.collect()} == {1, 2, 3, None}
    spark.createDataFrame([(1, " ".join(f"w0x{k}" for k in range(20)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = C.clean_stage(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and {(r["doc_id"], r["_d"]) for r in clean.collect()} == {(1, "K1"), (None, None)}


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], COLUMNS)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in C.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES) == list(range(1, 11))
    assert line_dedup.THRESHOLD == near_dedup.THRESHOLD == 0.8 and near_dedup.SHINGLE == 5
