"""Pages from text and CSV files."""

from __future__ import annotations

import csv
import io
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.validation import SPACE, trim

def _text() -> Column:
    """The content as text; null where it is not UTF-8."""
    text = F.col("content").cast("string")
    return F.when(F.call_function("is_valid_utf8", text), text)


def _trimmed_lines(text: Column) -> Column:
    """Lines of a text without a comma, each without surrounding white space."""
    return F.array_join(F.transform(F.split(F.regexp_replace(text, r"\n$", ""), "\n"), trim), "\n")


def _plain_records(text: Column) -> Column:
    """Records of a text without quotes: a record is a line, the first is the header, widths must agree."""
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    fields = lambda line: F.size(F.split(line, ","))
    kept = F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: fields(x) == fields(lines[0]))
    return F.array_join(kept, "\n")


def _csv_text() -> Column:
    """Page text of a CSV file's ``_text``; only quotes and carriage returns need the Python reader."""

    @F.pandas_udf("string")
    def records(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else csv_records(t))

    text = F.col("_text")
    comma, odd = F.instr(text, ",") > 0, (F.instr(text, '"') > 0) | (F.instr(text, "\r") > 0)
    return F.when(~comma, _trimmed_lines(text)).when(~odd, _plain_records(text)).otherwise(records(F.when(comma & odd, text)))


def _page(docs: DataFrame, text: Column, error: Column) -> DataFrame:
    """One page for each document; bytes that are not UTF-8 are an error."""
    rows = docs.withColumn("_text", _text())
    return rows.select("doc_id", F.lit(1).alias("page_number"), text.alias("text"), F.when(F.col("_text").isNull(), error).alias("error_kind"))


def text_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page_number, text, error_kind) of text files (doc_id, content)."""
    return _page(docs, F.col("_text"), F.lit("TextLoadError"))


def csv_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page_number, text, error_kind) of CSV files, in one pass."""
    return _page(docs, _csv_text(), F.lit("CsvLoadError"))


def text_and_csv_pages(docs: DataFrame) -> DataFrame:
    """Both, by document_type, in one pass; a page without text for images."""
    kind = F.col("document_type")
    image = kind.isin("Png", "Jpeg", "Tiff")
    rows = docs.withColumn("_text", F.when(~image, _text()))
    text = F.when(kind == "Csv", _csv_text()).otherwise(F.col("_text"))
    error = F.when(F.col("_text").isNull() & ~image, F.when(kind == "Csv", "CsvLoadError").otherwise("TextLoadError"))
    return rows.select("doc_id", F.lit(1).alias("page_number"), text.alias("text"), error.alias("error_kind"))


def csv_records(text: str) -> str:
    """Records of a text with a comma, the first record and odd widths left out.

    Records of one field are lines; others join their fields by commas, without
    quotes.
    """
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), strict=False) if r]
    return "\n".join(",".join(r) for r in rows[1:] if len(r) == len(rows[0]))


def csv_text(content: bytes) -> str | None:
    """Page text of a CSV file, as ``csv_pages`` has it; None if it is not UTF-8."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if "," in text:
        return csv_records(text)
    return "\n".join(re.sub(f"^{SPACE}+|{SPACE}+$", "", line) for line in text.removesuffix("\n").split("\n"))
