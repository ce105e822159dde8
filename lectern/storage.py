"""The shared folder, and tables that are kept there."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a batch that goes to Python: files are large rows, and four tasks hold several batches of Spark's 64 MB each.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let batches that go to Python have BATCH_BYTES at most, or one row; a bound that the session gives with a unit (64m) stays."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    named = spark.conf.get(bound).removesuffix("b")
    if named == "-1" or (named.isdigit() and int(named) > BATCH_BYTES):
        spark.conf.set(bound, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names; one of our own only in local mode, where it names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lectern-checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, kept in the cluster's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system with all it holds."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
