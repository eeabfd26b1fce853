"""Reading tables: only the columns a query needs reach the scan."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a logical batch, wherever batches are visible in a result.
BATCH_ROWS = 2048


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; on one machine a temporary one if none is set."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
        root = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def key_value(df: DataFrame, key: str | Column, val: str | Column) -> DataFrame:
    """The (key, val) form of a table: two BIGINT columns."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_column(key).cast("long").alias("key"), as_column(val).cast("long").alias("val"))


def batch_of(row_id: str) -> Column:
    """The logical batch of a row id."""
    return F.expr(f"{row_id} div {BATCH_ROWS}")
