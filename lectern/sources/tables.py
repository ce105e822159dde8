"""Tables and settings on disk: parquet, requests, dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests from JSON lines, with the fixed schema."""
    return spark.read.schema(schema.REQUESTS).json(path)


def character_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(index, character) of a dictionary file, a character a line, as one file.

    Index 0 is the blank, shown as '#'; a space follows the last line's entry.
    Characters repeat, so rows are told apart by index alone.
    """
    text = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    return text.select(F.posexplode(F.concat(F.array(F.lit("#")), lines, F.array(F.lit(" ")))).alias("index", "character"))


def dictionary_of(spark: SparkSession, characters: list[str]) -> DataFrame:
    """The same from a list."""
    return spark.createDataFrame(list(enumerate(["#", *characters, " "])), "index int, character string")
