"""A corpus pipeline of five operators: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept;
``run`` writes each result as Parquet in the shared folder and reads it again. All stages but
the last return the columns of ``documents``. SQL can't express the trained and iterative
stages, so ``ORACLE_SQL`` is None and the stages are tested against brute force.

Repeated rows and nulls: a null text fails the base rules and goes in the first stage; rows
with equal doc_id and text are one document, of which near-dedup keeps one row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import decontaminate, line_dedup, near_dedup, packing, quality
from flowloom.llm.common import bound_batches, cut, keyed_rows, table

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose content share is high enough."""
    bound_batches(spark)
    field = quality.fitted(docs, table(spark, sf_dir, "labels"))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([quality.judge(t or "", field)[6] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that match an earlier one; a text without any line left goes.

    Lines of null and empty texts: none, so they stay. Equal rows keep the same lines.
    """
    found = line_dedup.dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("kept").rlike(r"\S"))
    new = {"text": F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(new["text"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least (doc_id, text hash).

    Of rows with equal doc_id and text the one with the least other columns, as JSON, stays. Texts without words are no copies.
    """
    keyed = keyed_rows(docs)
    classes = near_dedup.near_classes(keyed.select("_d", "_th", "_text"))
    go = classes.where(F.struct("_d", "_th") != F.col("_class")).select("_d", "_th").distinct()
    rest = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    one = keyed.groupBy("_d", "_th").agg(F.min_by("_row", F.to_json(F.struct(*rest)) if rest else F.lit(0)).alias("_row"))
    return one.join(go, ["_d", "_th"], "left_anti").select("_row.*")


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of the benchmark; an empty benchmark leaves all."""
    keyed = keyed_rows(docs)
    found = decontaminate.leaks(keyed.select("_d", "_th", "_text"), table(spark, sf_dir, "benchmark")).select("_d", "_th").distinct()
    return keyed.select("_row", "_d", "_th").join(found, ["_d", "_th"], "left_anti").select("_row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the remaining documents goes."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", clean_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return docs
