"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes that a Python worker gets at once at most.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker gets at once, as texts and pages may be long: the default of 10,000 rows is some hundred MB of them. These are
    settings of the session, which Spark reads when it plans an action; they only bound the size of batches, never what comes out."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _new_path(spark: SparkSession, name: str):
    """A path in spark.checkpoint.dir that isn't there yet, as text, as Hadoop's, and its file system. Where that setting is unset, a local session (as in
    tests) gets a temporary folder, and a cluster an error, as its executors don't share the driver's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, which goes when the application ends."""
    path, place, fs = _new_path(spark, name)
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to a shared folder and read back, which cuts its lineage. Its files go when the application ends."""
    path, place, fs = _new_path(df.sparkSession, name)
    df.write.parquet(path)
    fs.deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)
