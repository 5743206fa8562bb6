"""Session helpers: table access, the shared scratch folder, lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where a session on one machine leaves it unset (tests, notebooks) a temporary folder is set and removed at exit. On a cluster a
    folder of one machine would lose what the others need, so there it must be named.
    """
    own = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        own = "file://" + tempfile.mkdtemp(prefix="adlens-")
        atexit.register(shutil.rmtree, own[7:], ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(own)
    return own


def _own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; the file system removes it when the driver's JVM ends."""
    folder = os.path.join(scratch_dir(spark), f"adlens-{spark.sparkContext.applicationId}")
    if folder not in _marked:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _marked.add(folder)
    return folder


_marked: set[str] = set()


def written(df: DataFrame, *partition_by: str, rows_a_file: int = 0) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: a cheap, fault-tolerant lineage cut.

    ``rows_a_file`` keeps files small where rows are large, so that they are read in as many tasks.
    """
    spark = df.sparkSession
    path = os.path.join(_own_folder(spark), f"{uuid.uuid4().hex}.parquet")
    writer = df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
