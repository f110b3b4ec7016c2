"""The graph's roles played by the star-schema tables, as plain selects.

process = customer, caller = order, endpoint = supplier (its handler is itself),
table = part, repository = nation, application = region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def processes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("process_id"), F.col("c_custkey").alias("function_id"), F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("nation"))


def callers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("caller_id"), F.col("o_custkey").alias("function_id"), "o_orderpriority", "o_orderstatus")


def resolves(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").where("l_quantity >= 40").select(F.col("l_orderkey").alias("caller_id"), F.col("l_suppkey").alias("endpoint_id")).distinct()


def endpoints(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("endpoint_id"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey")).alias("handler_id"), F.col("s_nationkey").alias("nation"))


def interactions(spark: SparkSession, d: str) -> DataFrame:
    """The orders' large lines: an access of the supplier's handler to a part."""
    line = read(spark, d, "lineitem").where("l_quantity >= 40")
    return line.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("interaction_id"), F.col("l_suppkey").alias("function_id"), F.col("l_partkey").alias("table_id"),
        F.when(F.col("l_returnflag") == "N", "read").when(F.col("l_returnflag") == "A", "update").otherwise("write").alias("operation"),
    )


def call_graph(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): successive event types of a user, the users dealt into 25 groups."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events").withColumn("next", F.lead("event_type").over(w)).where("next IS NOT NULL")
    src = F.concat(F.lit("u"), (F.col("user_id") % 25).cast("string"), F.col("event_type"))
    dst = F.concat(F.lit("u"), ((F.col("user_id") * 3 + 1) % 25).cast("string"), F.col("next"))
    return e.select(src.alias("src"), dst.alias("dst")).distinct()


def part_calls(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    n = p.agg(F.count("*").alias("n"))
    return p.join(F.broadcast(n)).select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7) % F.col("n") + 1).alias("dst"))


def page_paths(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return read(spark, d, "pages").select("page_id", url, F.regexp_replace(F.regexp_replace(url, "^[a-z]+://[^/]*", ""), "[?#].*$", "").alias("path"))
