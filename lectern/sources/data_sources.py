"""Files as Spark data sources, to be read by name: ``spark.read.format("lectern-docx").load(path)``.

``register`` makes them known to a session: word-processor files (blocks),
spreadsheets (pages), CSV (pages), character dictionaries (entries) and plain
files. Of word-processor files the option ``rows`` asks for pages or cells in place of
blocks: a file is read in one task, so they need no shuffle. All list a path once on the driver, deal the files out by size, and read a
partition's files in its task; ``readStream`` has the files that arrive. Files are
opened through Arrow's file systems, so the path is a folder, or one file, on
any of those. Broken files are rows with an error_kind, never failed jobs.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from lectern.sources import office_files, text_files
from lectern.storage import bounded_batches

#: What a partition has at most, and rows of a batch; the first two are options of that name.
BYTES, FILES, ROWS = 32 << 20, 1_000, 1_000
#: The same of zip files, whose XML may be twenty times as large.
ZIPPED = 1 << 20
_KEY = "doc_id bigint, path string, filename string"
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


@dataclass
class FileGroup(InputPartition):
    """Paths that one task reads."""

    paths: list[str]


def listed(path: str) -> list[fs.FileInfo]:
    """Files under a path, by path; those whose names begin with _ or . are not data."""
    system, root = opened(path)
    info = system.get_file_info(root)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    inner = lambda f: f.path[len(root.rstrip("/")) + 1 :].split("/")
    return sorted((f for f in found if f.is_file and (f is info or not any(p[0] in "_." for p in inner(f)))), key=lambda f: f.path)


def dealt(files: list[fs.FileInfo], most_bytes: int, most_files: int) -> list[FileGroup]:
    """Files in groups of neighbours; a larger file is a group of its own."""
    groups, size = [], 0
    for f in files:
        if not groups or size + f.size > most_bytes or len(groups[-1].paths) >= most_files:
            groups.append(FileGroup([]))
            size = 0
        groups[-1].paths.append(f.path)
        size += f.size
    return groups


def document_id(path: str) -> int:
    """What ``F.xxhash64`` has of a path."""
    n = xxhash.xxh64_intdigest(path.encode(), 42)
    return n - (1 << 64) if n >> 63 else n


class _Files:
    """What readers of tables and streams have in common: options, and rows of files."""

    def __init__(self, options: dict, ddl: str, rows, most_bytes: int = BYTES):
        self.path = options["path"]
        self.most_bytes, self.most_files = int(options.get("bytesPerPartition", most_bytes)), int(options.get("filesPerPartition", FILES))
        self.fields = [c.strip().split() for c in ddl.split(",")]
        self.rows = rows

    def batches(self, group: FileGroup) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        held: list[tuple] = []
        for path in group.paths:
            with system.open_input_stream(path) as f:
                content = f.read()
            key = (document_id(path), path, path.rsplit("/", 1)[-1])
            for row in self.rows(content):
                held.append((*key, *row))
                if len(held) >= ROWS:
                    yield self._batch(held)
                    held = []
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, self.fields, strict=True)], names=[n for n, _ in self.fields])


class FileReader(_Files, DataSourceReader):
    """Filters on ``filename`` leave files unopened."""

    names: set | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("filename",):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.names = wanted if self.names is None else self.names & wanted
            else:
                yield f

    def partitions(self) -> list[FileGroup]:
        files = [f for f in listed(self.path) if self.names is None or f.base_name in self.names]
        return dealt(files, self.most_bytes, self.most_files) or [FileGroup([])]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class FileStreamReader(_Files, DataSourceStreamReader):
    """Files in the order of their time and path; the offset is the last one's.

    A file has to come complete and with the time of its coming (moved into
    place, say, once written): one whose time lies before the offset is not seen.
    """

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((f.mtime_ns, f.path) for f in listed(self.path)), default=(-1, ""))
        return {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[FileGroup]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return dealt([f for f in listed(self.path) if low < (f.mtime_ns, f.path) <= high], self.most_bytes, self.most_files)

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class _FileSource(DataSource):
    """A format: the columns after doc_id, path and filename, and a file's rows."""

    columns = ""
    format = ""
    most_bytes = BYTES

    @classmethod
    def name(cls) -> str:
        return cls.format

    def schema(self) -> str:
        return f"{_KEY}, {self.columns}"

    @staticmethod
    def rows(content: bytes) -> list[tuple]:
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return FileReader(self.options, self.schema(), self.rows, self.most_bytes)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FileStreamReader(self.options, self.schema(), self.rows, self.most_bytes)


class WordFiles(_FileSource):
    """Block rows of word-processor files, for ``office_files.word_pages`` and ``word_tables``; or what the option ``rows`` names."""

    format, most_bytes = "lectern-docx", ZIPPED

    def __init__(self, options: dict):
        super().__init__(options)
        what = options.get("rows", "blocks")
        if what not in office_files.WORD_ROWS:
            raise ValueError(f"{what!r} is none of {', '.join(office_files.WORD_ROWS)}")
        self.columns, self.rows = office_files.WORD_ROWS[what]


class ExcelFiles(_FileSource):
    """A page for each sheet of a spreadsheet."""

    format, columns = "lectern-xlsx", "page_number int, text string, error_kind string"

    @staticmethod
    def rows(content: bytes) -> list[tuple]:
        return office_files.sheet_rows(content)


class CsvFiles(_FileSource):
    """One page for each CSV file."""

    format, columns = "lectern-csv", "page_number int, text string, error_kind string"

    @staticmethod
    def rows(content: bytes) -> list[tuple]:
        text = text_files.csv_text(content)
        return [(1, text, "CsvLoadError" if text is None else None)]


class Dictionaries(_FileSource):
    """Entries of character dictionaries: index 0 is the blank, shown as '#', and a space follows the last line's."""

    format, columns = "lectern-dictionary", "index int, character string"

    @staticmethod
    def rows(content: bytes) -> list[tuple]:
        lines = content.decode("utf-8", "replace").split("\n")
        entries = [x.removesuffix("\r") for x in (lines[:-1] if lines[-1] == "" and len(lines) > 1 else lines)]
        return list(enumerate(["#", *entries, " "]))


class Contents(_FileSource):
    """Whole files, for loaders of (doc_id, content)."""

    format, columns = "lectern-files", "content binary"

    @staticmethod
    def rows(content: bytes) -> list[tuple]:
        return [(content,)]

    def writer(self, schema, overwrite: bool):
        from lectern.sources.staged_files import FileWriter

        return FileWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make all formats known to a session."""
    from lectern.sources.staged_files import Results

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    bounded_batches(spark)
    for source in (WordFiles, ExcelFiles, CsvFiles, Dictionaries, Contents, Results):
        spark.dataSource.register(source)
