"""Requests: file name rules, base64 with size limits, type dispatch.

Errors are data: error_kind and error_detail of a row, never a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FILE_SIZE = 1 << 30
MAX_NAME_BYTES = 255
# Document type by extension.
EXTENSIONS = {
    "txt": "Text", "docx": "Word", "pdf": "Pdf", "xlsx": "Excel", "csv": "Csv",
    "png": "Png", "jpg": "Jpeg", "jpeg": "Jpeg", "tiff": "Tiff", "tif": "Tiff",
}
CANONICAL = {"Text": "txt", "Word": "docx", "Pdf": "pdf", "Excel": "xlsx", "Csv": "csv", "Png": "png", "Jpeg": "jpg", "Tiff": "tiff"}
MODALITIES = {kind: ["Text"] for kind in ("Text", "Word", "Excel", "Csv")} | {"Pdf": ["Text", "Image"]} | {k: ["Image"] for k in ("Png", "Jpeg", "Tiff")}
VALIDATION, DOCUMENT, INTERNAL = (
    ("EmptyFilename", "FilenameTooLong", "ForbiddenCharacter", "PathTraversal", "MissingExtension", "InvalidFilenameEdges", "Base64DataTooLarge", "InvalidBase64", "FileSizeTooLarge"),
    ("UnsupportedFileType", "TextLoadError", "CsvLoadError", "ExcelLoadError", "WordLoadError", "PdfLoadError", "ImageLoadError", "InferenceError"),
    ("InternalError",),
)
#: White space as Unicode has it.
SPACE = r"[\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(trim(text) == "", F.lit(True))


def filename_error(filename: Column) -> Column:
    """The first rule that a file name breaks; null if it is fine. Null counts as empty."""
    name = trim(F.coalesce(filename, F.lit("")))
    return (
        F.when(name == "", "EmptyFilename")
        .when(F.octet_length(name) > MAX_NAME_BYTES, "FilenameTooLong")
        .when(name.rlike(r"[/\\\x00]"), "ForbiddenCharacter")
        .when(F.instr(name, "..") > 0, "PathTraversal")
        .when((F.instr(name, ".") == 0) | name.endswith("."), "MissingExtension")
        .when(name.startswith("."), "InvalidFilenameEdges")
    )


def decoded(data: Column) -> Column:
    return F.try_to_binary(data, F.lit("base64"))


def data_error(data: Column, max_file_size: int = MAX_FILE_SIZE) -> Column:
    """What is wrong with base64 data; null if nothing. Encoded size is judged first."""
    content = decoded(F.coalesce(data, F.lit("")))
    return (
        F.when(F.octet_length(data) > (max_file_size // 3 + 1) * 4, "Base64DataTooLarge")
        .when(content.isNull(), "InvalidBase64")
        .when(F.octet_length(content) > max_file_size, "FileSizeTooLarge")
    )


def extension(filename: Column) -> Column:
    """Lower-case text after the last dot; '' without one."""
    return F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"\.([^.]*)$", 1))


def _lookup(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def document_type(filename: Column) -> Column:
    return _lookup(extension(filename), EXTENSIONS)


def canonical_extension(kind: Column) -> Column:
    return _lookup(kind, CANONICAL)


def modalities(kind: Column) -> Column:
    table = [x for k, v in MODALITIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.element_at(F.create_map(*table), kind)


def process_mode(process_id: Column) -> Column:
    """Read for exactly 'read', else General."""
    return F.when(F.coalesce(process_id, F.lit("general")) == "read", "Read").otherwise("General")


def validate(requests: DataFrame, max_file_size: int = MAX_FILE_SIZE) -> DataFrame:
    """requests with trimmed filename, process_id, mode, document_type, content and errors.

    The file name is judged before the data, and both before the type.
    """
    bad_type = F.when(document_type(F.col("filename")).isNull(), "UnsupportedFileType")
    detail = F.when(F.col("error_kind") == "UnsupportedFileType", F.when(extension(F.col("filename")) == "", "(no extension)").otherwise(extension(F.col("filename"))))
    return (
        requests.withColumn("filename", trim(F.coalesce("filename", F.lit(""))))
        .withColumn("process_id", F.coalesce("process_id", F.lit("general")))
        .withColumn("mode", process_mode(F.col("process_id")))
        .withColumn("error_kind", F.coalesce(filename_error(F.col("filename")), data_error(F.col("data"), max_file_size), bad_type))
        .withColumn("error_detail", detail)
        .withColumn("document_type", F.when(F.col("error_kind").isNull(), document_type(F.col("filename"))))
        .withColumn("content", F.when(F.col("error_kind").isNull(), decoded(F.coalesce("data", F.lit("")))))
        .drop("data")
    )


def status(error_kind: Column) -> Column:
    """200, or 400 for the request, 422 for the document, 500 for the rest."""
    return F.when(error_kind.isNull(), 200).when(error_kind.isin(*VALIDATION), 400).when(error_kind.isin(*DOCUMENT), 422).otherwise(500)
