"""The threshold aggregation over a stream of files, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession

from tessera.operators.aggregate import threshold_sum
from tessera.sources.tables import work_folder


def stream_sum(spark: SparkSession, path: str, key: Column, val: Column, threshold: int | float, files_at_once: int = 1) -> DataFrame:
    """key, total over the Parquet files at ``path``: bounded hand-over of files, one running sum a key.

    Ends when all files present have been read; an empty file or batch does not
    end it. State grows with the number of keys. The result table is complete.
    """
    schema = spark.read.parquet(path).schema
    folder = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    files = f"{path[:-1]}[{path[-1]}]"  # as a pattern, so that one file is a source as well as a folder
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(files)
    sums = threshold_sum(rows.select(key.cast("long").alias("key"), val.cast("long").alias("val")), threshold)
    done: list[str] = []

    def keep(df: DataFrame, batch: int) -> None:
        """Each trigger writes the whole result anew; a repeated trigger overwrites its own."""
        df.write.mode("overwrite").parquet(f"{folder}/{batch}")
        done.append(f"{folder}/{batch}")

    query = sums.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(done[-1]) if done else spark.createDataFrame([], "key long, total long")
