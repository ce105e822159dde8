"""Table functions for SQL: contents of files as rows, by lateral join.

``SELECT d.doc_id, c.* FROM files d, LATERAL lectern_docx(d.content, 'cells') c`` needs no
DataFrame code. The second argument, a constant, says which rows are wanted and
with them the columns that the analyzer gets.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from lectern.sources import office_files, text_files
from lectern.sources.office_files import cells_of_blocks as word_cells
from lectern.sources.office_files import pages_of_blocks as word_pages
from lectern.storage import bounded_batches

_WORD = {what: columns for what, (columns, _) in office_files.WORD_ROWS.items()}


_TYPES = {"int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _columns(ddl: str) -> T.StructType:
    """Names and simple types; the analyzer's process has no session that could read them."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(","))])


def _wanted(argument: AnalyzeArgument | None, known: dict[str, str], default: str) -> str:
    """The columns that a constant argument names."""
    if argument is not None and not argument.isConstantExpression:
        raise ValueError(f"the second argument has to be a constant: one of {', '.join(known)}")
    name = default if argument is None else argument.value
    if name not in known:
        raise ValueError(f"{name!r} is none of {', '.join(known)}")
    return known[name]


@udtf
class WordRows:
    """lectern_docx(content, 'pages' | 'cells' | 'blocks'): rows of a word-processor file; pages if nothing is named."""

    @staticmethod
    def analyze(content: AnalyzeArgument, what: AnalyzeArgument | None = None) -> AnalyzeResult:
        return AnalyzeResult(_columns(_wanted(what, _WORD, "pages")))

    def eval(self, content: bytes, what: str = "pages") -> Iterator[tuple]:
        if content is not None:
            rows = office_files.block_rows(bytes(content))
            yield from {"blocks": iter, "cells": word_cells, "pages": word_pages}[what](rows)


@udtf(returnType="page_number int, text string, error_kind string")
class SheetRows:
    """lectern_xlsx(content): a page for each sheet of a spreadsheet."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is not None:
            yield from office_files.sheet_rows(bytes(content))


@udtf(returnType="page_number int, text string, error_kind string")
class CsvRows:
    """lectern_csv(content): the page of a CSV file."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is not None:
            text = text_files.csv_text(bytes(content))
            yield 1, text, "CsvLoadError" if text is None else None


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    bounded_batches(spark)
    for name, function in (("lectern_docx", WordRows), ("lectern_xlsx", SheetRows), ("lectern_csv", CsvRows)):
        spark.udtf.register(name, function)
