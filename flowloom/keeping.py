"""Cuts lineage with tables in the folder that the cluster names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where the session names none, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if where is None:
        where = "file://" + tempfile.mkdtemp(prefix="flowloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: it outlives executors, and plans on top of it stay short.

    ``checkpoint()`` would compute the frame twice. The table goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/keep-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone
        pass
