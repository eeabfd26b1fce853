"""Shared plumbing: tables, the shared work folder, and files in it.

Nothing here keeps state on one machine. Intermediate tables and files go to a
fresh folder below ``spark.checkpoint.dir``, which every executor can reach; without
that setting one machine takes a temporary folder, and a cluster raises an error.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import work_folder

PACKAGE = Path(__file__).resolve().parents[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path below the cluster's shared folder that no other run uses."""
    return f"{work_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def cleared(spark: SparkSession) -> None:
    """Remove what all runs have left below the shared folder; for the end of a session, when no table of theirs is read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{work_folder(spark)}/tessera")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def importable(spark: SparkSession) -> None:
    """Ship this package to the executors, compiled, once a session; Spark brings it to every Python worker."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tessera-package-")  # on the driver alone, which serves it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/tessera_package.zip"
    with zipfile.PyZipFile(archive, "w") as out:
        out.writepy(str(PACKAGE))
    context.addPyFile(archive)
    context._tessera_shipped = True


def give_back() -> None:
    """Give the memory that a Python worker has freed back to the machine; a worker lives on after its task and would keep it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library of Linux has it, others need not
        trim(0)


def open_output(uri: str):
    """A stream that writes the file ``uri`` (file, s3, gs or hdfs), folders made."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    return files.open_output_stream(path, compression=None)


def open_input(uri: str):
    """A seekable reader of the file ``uri``."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return files.open_input_file(path)
