"""The streaming form: files as they arrive, through the same stateless functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """(doc_id, filename, content) of files that arrive under a path."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def table_stream(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A parquet table's files as a stream, with the schema of what is there.

    What ``pattern`` names below path is a file, or a folder that a job has written;
    a filter by name would see the folder's files and not its own name.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path, pattern)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if "*" not in pattern and files.exists(at) and files.getFileStatus(at).isDirectory():
        path, pattern = f"{path}/{pattern}", "*"
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def run_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Apply a batch function to all that has arrived and append the rows to parquet.

    Batches are written under their number, so that a batch that is repeated
    after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
