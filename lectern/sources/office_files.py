"""Pages and tables from spreadsheet and word-processor files.

Both are zip archives of XML. A Python reader emits plain block rows; pages,
tables and cells are built from them with DataFrame operations.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.storage import bounded_batches

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_P, _TBL, _TR, _TC, _TCPR, _SPAN, _VAL, _RUN, _T, _TAB, _BR, _TYPE = (_W + name for name in ("p", "tbl", "tr", "tc", "tcPr", "gridSpan", "val", "r", "t", "tab", "br", "type"))
_ROW, _CELL, _VALUE = (_S + name for name in ("row", "c", "v"))
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}

#: Of a part's header the signature and the lengths of name and rest; of its entry in the directory what a reader needs; of the directory's end all.
_HEADER, _ENTRY, _END = struct.Struct("<L22x2H"), struct.Struct("<L2xBx2H4x3L3H8xL"), struct.Struct("<L4H2LH")
#: Of a part's flags those that change nothing for a reader: how it was packed, sums after the part, names in UTF-8.
_PLAIN_FLAGS = 0x80E


class Archive:
    """Parts of a zip file by name.

    The plain form that office programs write is read from its bytes, since ``zipfile``
    takes longer to open a small file than its XML takes to be parsed; whatever is not
    plain, or not sound, is left to ``zipfile``, to be read or refused.
    """

    __slots__ = ("content", "parts", "zip")

    def __init__(self, content: bytes):
        self.content, self.zip, self.parts = content, None, self._directory(content)
        if self.parts is None:
            self._opened()

    def _opened(self) -> zipfile.ZipFile:
        if self.zip is None:
            self.zip = zipfile.ZipFile(io.BytesIO(self.content))
        return self.zip

    @staticmethod
    def _directory(content: bytes) -> dict[bytes, tuple] | None:
        """(begin, end, method, sum, packed size, size) of each part; None where the file is not plain."""
        last = len(content) - 22
        if last < 0:
            return None
        signature, disk, first, here, count, size, start, comment = _END.unpack_from(content, last)
        if signature != 0x06054B50 or disk or first or here != count or comment or start + size != last or count == 0xFFFF:
            return None
        entries, found, at, end = [], {}, start, start
        while at + 46 <= last:
            signature, needs, flags, method, crc, packed, full, named, extra, said, begin = _ENTRY.unpack_from(content, at)
            name = content[at + 46 : at + 46 + named]
            if signature != 0x02014B50 or needs > 20 or flags & ~_PLAIN_FLAGS or extra or (method and method != 8) or not name.isascii() or b"\0" in name:
                return None
            entries.append((name, begin, method, crc, packed, full))
            at += 46 + named + said
        if at != last or len(entries) != count:
            return None
        for name, begin, *about in reversed(entries):  # a part ends where the next one begins
            if begin >= end or name in found:
                return None
            found[name] = (begin, end, *about)
            end = begin
        return found

    def part(self, name: str) -> bytes | None:
        if self.parts is None:
            return self.zip.read(name) if name in self.zip.NameToInfo else None
        raw = name.encode()
        place = self.parts.get(raw)
        if place is None:
            return None
        begin, end, method, crc, packed, full = place
        content, at = self.content, begin + 30
        if at <= end:
            signature, named, extra = _HEADER.unpack_from(content, begin)
            data = at + named + extra
            if signature == 0x04034B50 and content[at : at + named] == raw and data + packed <= end:
                data = content[data : data + packed]
                if method:
                    try:
                        data = zlib.decompressobj(-zlib.MAX_WBITS).decompress(data, full + 1)
                    except zlib.error:
                        data = b""
                if len(data) == full and zlib.crc32(data) == crc:
                    return data
        return self._opened().read(name)

    def xml(self, name: str):
        part = self.part(name)
        return ElementTree.fromstring(part) if part is not None else None


#: Parts up to this size are often alike in many files of one maker; what they say is kept for so many of them.
SMALL_PART, SMALL_PARTS = 4_096, 64


def _kept(read):
    """read, whose results of small parts are kept."""
    small = lru_cache(SMALL_PARTS)(read)
    return lambda *parts: (small if sum(len(p or b"") for p in parts) <= SMALL_PART else read)(*parts)


@_kept
def _sheets(book: bytes, links: bytes | None) -> list[tuple[str, str]]:
    """(name, part) of a workbook's sheets."""
    targets = {x.get("Id"): x.get("Target", "") for x in (ElementTree.fromstring(links) if links is not None else ())}
    found = [(sheet.get("name", ""), targets.get(sheet.get(f"{_R}id"), "").lstrip("/")) for sheet in ElementTree.fromstring(book).iter(f"{_S}sheet")]
    return [(name, target if target.startswith("xl/") else f"xl/{target}") for name, target in found]


@_kept
def _strings(part: bytes | None) -> list[str]:
    return ["".join(t.text or "" for t in x.iter(f"{_S}t")) for x in ElementTree.fromstring(part).iter(f"{_S}si")] if part is not None else []


@_kept
def _dates(part: bytes | None) -> list[bool]:
    """Whether each cell style is a date's."""
    return [int(x.get("numFmtId", 0)) in _DATE_FORMATS for x in ElementTree.fromstring(part).find(f"{_S}cellXfs") or ()] if part is not None else []


@lru_cache(20_000)
def _column(reference: str) -> int:
    """The column of a cell's reference, whose row need not be there."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _number(text: str, as_date: bool) -> str:
    value = float(text)
    if as_date:
        return str(datetime(1899, 12, 30) + timedelta(days=value))
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


#: Rows as programs write them for numbers, truth values and shared strings: no formulas, entities or letters beyond ASCII.
_PLAIN_ROW = re.compile("""<row r="([0-9]+)"(?: spans="[0-9:]+")?>""")
_PLAIN_CELL = re.compile("""(<c r="([A-Z]+)[0-9]+"(?: s="([0-9]+)")?(?: t="([a-z]+)")?(?:/>|><v>([ -%'-;=?-~]+)</v></c>))""")


@_kept
def _frame(before: bytes, after: bytes) -> bool:
    """Whether what stands around a sheet's rows is one sound sheet that means nothing else for them."""
    if b"<!" in before or (before.startswith(b"<?") and b"encoding=" in before and b'encoding="UTF-8"' not in before):
        return False
    try:
        root = ElementTree.fromstring(before + b"<sheetData/>" + after)
    except ElementTree.ParseError:
        return False
    data = root.findall(f"{_S}sheetData")
    return len(data) == 1 and sum(x.tag.endswith("sheetData") for x in root.iter()) == 1 and next(root.iter(_ROW), None) is None


def _plain_cells(part: bytes) -> list[tuple] | None:
    """(row, column, kind, style, value) of a sheet's cells, where its rows are plain: as parsed XML has them, in less time."""
    before, opened, rest = part.partition(b"<sheetData>")
    rows, closed, after = rest.rpartition(b"</sheetData>") if opened else (b"", b"", b"")
    if not opened:
        before, closed, after = part.partition(b"<sheetData/>")
    if not closed or not part.isascii() or not _frame(before, after):
        return None
    out, (*rows, end) = [], rows.decode().split("</row>")
    for row in rows:
        begun = _PLAIN_ROW.match(row)
        if begun is None:
            return None
        y, left = int(begun[1]) - 1, len(row) - begun.end()
        for whole, x, style, kind, value in _PLAIN_CELL.findall(row, begun.end()):
            left -= len(whole)
            out.append((y, _column(x), kind or "n", style or 0, value or None))
        if left:
            return None
    return None if end else out


def _parsed_cells(part: bytes) -> Iterator[tuple]:
    """The same of any sheet; no value is None."""
    for r, row in enumerate(ElementTree.fromstring(part).iter(_ROW)):
        y = int(row.get("r", r + 1)) - 1
        for c, cell in enumerate(row.iter(_CELL)):
            reference, kind = cell.get("r"), cell.get("t", "n")
            x = _column(reference.rstrip("0123456789")) if reference else c
            value = "".join(t.text or "" for t in cell.iter(f"{_S}t")) if kind == "inlineStr" else cell.findtext(_VALUE)
            yield y, x, kind, cell.get("s", 0), value


def read_sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows of texts) of each sheet, cut to the used range."""
    archive = Archive(content)
    book, links = archive.part("xl/workbook.xml"), archive.part("xl/_rels/workbook.xml.rels")
    if book is None:
        raise ValueError("no workbook")
    sheets, shared, dates = _sheets(book, links), _strings(archive.part("xl/sharedStrings.xml")), _dates(archive.part("xl/styles.xml"))
    out = []
    for name, part in sheets:
        part = archive.part(part)
        found = _plain_cells(part) if part is not None else ()
        cells: dict[tuple[int, int], str] = {}
        for y, x, kind, style, value in _parsed_cells(part) if found is None else found:
            if value is None:
                continue
            if kind == "s":
                value = shared[int(value)]
            elif kind == "b":
                value = "true" if value == "1" else "false"
            elif kind == "n":
                style = int(style)
                value = _number(value, style < len(dates) and dates[style])
            cells[y, x] = value
        rows = []
        if cells:
            ys, xs = [k[0] for k in cells], [k[1] for k in cells]
            columns = range(min(xs), max(xs) + 1)
            rows = [[cells.get((y, x), "") for x in columns] for y in range(min(ys), max(ys) + 1)]
        out.append((name, rows))
    return out


def sheet_text(name: str, rows: list[list[str]]) -> str:
    return "\n".join([f"Sheet: {name}", *("\t".join(r) for r in rows)])


def sheet_rows(content: bytes) -> list[tuple]:
    """(page_number, text, error_kind) of a spreadsheet's sheets."""
    try:
        return [(k + 1, sheet_text(*s), None) for k, s in enumerate(read_sheets(content))]
    except Exception:  # any broken archive is this document's error
        return [(1, None, "ExcelLoadError")]


#: Rows and bytes of files that are read together: they are what a worker holds.
ROWS_AT_ONCE, BYTES_AT_ONCE = 2_000, 1 << 20
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _read(docs: DataFrame, rows_of, ddl: str) -> DataFrame:
    """(doc_id, ddl) of files (doc_id, content), some files at a time, however large a batch is."""
    fields = [("doc_id", pa.int64()), *((name, _ARROW[kind]) for name, kind in (c.split() for c in ddl.split(",")))]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = content.as_py()
                rows += [(doc_id, *row) for row in rows_of(content)]
                size += len(content or b"")
                if rows and (len(rows) >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE):
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "content").mapInArrow(run, f"doc_id bigint, {ddl}")


def excel_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page_number, text, error_kind): a page for each sheet."""
    return _read(docs, sheet_rows, "page_number int, text string, error_kind string")


def _paragraph(p) -> tuple[str, bool]:
    """Raw text of a paragraph's runs, and whether one has a page break."""
    parts, broken = [], False
    for run in p.iter(_RUN):
        for x in run:
            if x.tag == _T:
                parts.append(x.text or "")
            elif x.tag == _TAB:
                parts.append("\t")
            elif x.tag == _BR and x.get(_TYPE) == "page":
                broken = True
    return "".join(parts), broken


def _cell_text(cell) -> str:
    """Texts of a cell and of the tables in it, joined by spaces."""
    out = []
    for x in cell:
        if x.tag == _P:
            out.append(_paragraph(x)[0])
        elif x.tag == _TBL:
            out += [_cell_text(c) for row in x.findall(_TR) for c in row.findall(_TC)]
    return " ".join(t for t in out if t)


def read_blocks(content: bytes) -> list[tuple]:
    """Rows (block, kind, text, broken, row, cell, span) of a document's body: paragraphs and table cells."""
    root = Archive(content).xml("word/document.xml")
    body = root.find(f"{_W}body") if root is not None else None
    if body is None:
        raise ValueError("no document")
    out = []
    for k, x in enumerate(body):
        if x.tag == _P:
            text, broken = _paragraph(x)
            out.append((k, "p", text, broken, None, None, None))
        elif x.tag == _TBL:
            rows = x.findall(_TR)
            found = [(r, c, cell) for r, row in enumerate(rows) for c, cell in enumerate(row.findall(_TC))]
            for r, c, cell in found:
                about = cell.find(_TCPR)
                span = about.find(_SPAN) if about is not None else None
                out.append((k, "t", _cell_text(cell), False, r, c, int(span.get(_VAL, 1)) if span is not None else 1))
            if not found:
                out.append((k, "t", "", False, None, None, None))
    return out


BLOCK_COLUMNS = "block int, kind string, text string, broken boolean, row int, cell int, span int, error_kind string"


def block_rows(content: bytes) -> list[tuple]:
    """Rows of BLOCK_COLUMNS of a word-processor file; a broken file is one row with error_kind."""
    try:
        return [(*b, None) for b in read_blocks(content)] or [(0, "p", "", False, None, None, None, None)]
    except Exception:  # any broken archive is this document's error
        return [(0, "e", None, False, None, None, None, "WordLoadError")]


def paged_blocks(rows: list[tuple]) -> list[tuple[int, tuple]]:
    """(page, block row): a page ends after a paragraph with a break, if it has content by then."""
    out, page, content, ended, before = [], 1, False, False, None
    for row in rows:
        block, kind, text, broken = row[:4]
        own = kind == "t" or bool(text)
        if block != before and ended:
            page, content, ended = page + 1 if content else page, False, False
        content = content or own
        ended = ended or bool(broken)
        out.append((page, row))
        before = block
    last = max((p for p, r in out if r[1] == "t" or r[2]), default=1)
    return [(min(p, last), r) for p, r in out]


def cells_of_blocks(rows: list[tuple]) -> Iterator[tuple]:
    """Cells of a document's tables; a cell starts where the spans before it in its row end."""
    at, key = 0, None
    for page, (block, kind, text, _, row, _, span, _) in paged_blocks(rows):
        if kind == "t" and row is not None:
            if key != (block, row):
                at, key = 0, (block, row)
            yield page, block, row, at, 1, span, text or None
            at += span


def pages_of_blocks(rows: list[tuple]) -> Iterator[tuple]:
    """Page texts: paragraphs, and tables as lines of cells with tabs between them."""
    if rows and rows[0][1] == "e":
        yield 1, None, rows[0][-1]
        return
    parts: dict[int, dict] = {1: {}}
    for page, (block, kind, text, _, row, *_) in paged_blocks(rows):
        own = parts.setdefault(page, {})
        if kind == "t":
            if row is not None:
                own.setdefault(block, {}).setdefault(row, []).append(text)
        elif text:
            own[block] = text
    for page, own in parts.items():
        texts = [p if isinstance(p, str) else "\n".join("\t".join(cells) for cells in p.values()) for p in own.values()]
        yield page, "\n".join(t for t in texts if t) if texts else None, None


def page_rows(content: bytes) -> list[tuple]:
    """(page_number, text, error_kind) of a word-processor file's pages."""
    return list(pages_of_blocks(block_rows(content)))


def cell_rows(content: bytes) -> list[tuple]:
    """Cells of a word-processor file's tables."""
    return list(cells_of_blocks(block_rows(content)))


#: What can be asked of a word-processor file: the columns, and the rows that a file has of them.
WORD_ROWS = {
    "blocks": (BLOCK_COLUMNS, block_rows),
    "cells": ("page_number int, table_ord int, row_index int, column_index int, row_span int, column_span int, text string", cell_rows),
    "pages": ("page_number int, text string, error_kind string", page_rows),
}


def word_blocks(docs: DataFrame) -> DataFrame:
    """Block rows of word-processor files; a broken file is one row with error_kind."""
    return _read(docs, block_rows, BLOCK_COLUMNS)


def read_word_pages(docs: DataFrame) -> DataFrame:
    """What ``word_pages`` has of whole files: a file's blocks are in one task as they are read, so its pages need no shuffle."""
    return _read(docs, page_rows, WORD_ROWS["pages"][0])


def _with_pages(blocks: DataFrame) -> DataFrame:
    """Block rows with their page, by one shuffle.

    A page ends after a paragraph with a break, if it has content by then; so
    breaks that follow each other add no page. Of a table's rows none has a break.
    """
    places = ["block", "row", "cell"]
    order = Window.partitionBy("doc_id").orderBy(*places)
    content = ((F.col("kind") == "t") | (F.col("text") != "")).cast("int")
    # breaks cut the blocks into runs; runs without content vanish
    before = F.sum(F.col("broken").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = blocks.withColumn("_has", content).withColumn("_run", F.coalesce(before, F.lit(0)))
    run = Window.partitionBy("doc_id", "_run")
    starts = F.max("_has").over(run) * (F.row_number().over(run.orderBy(*places)) == 1).cast("int")
    page = F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("_start", starts).withColumn("page_number", F.greatest(page, F.lit(1)).cast("int")).drop("_has", "_run", "_start")


def _paged(blocks: DataFrame) -> DataFrame:
    """One row a block with its text and page."""
    cells = F.sort_array(F.collect_list(F.when(F.col("kind") == "t", F.struct("row", "cell", "text"))))
    by_block = _with_pages(blocks).groupBy("doc_id", "page_number", "block", "kind", "error_kind").agg(cells.alias("_cells"), F.max("text").alias("_text"))
    rows = F.expr("transform(array_distinct(transform(filter(_cells, c -> c.row IS NOT NULL), c -> c.row)), r -> array_join(transform(filter(_cells, c -> c.row = r), c -> c.text), '\\t'))")
    return by_block.withColumn("text", F.when(F.col("kind") == "t", F.array_join(rows, "\n")).otherwise(F.col("_text"))).drop("_cells", "_text")


def word_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_number, text, error_kind); a document without content is one page without text."""
    paged = _paged(blocks)
    texts = F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("block", "text"))))
    out = paged.groupBy("doc_id", "page_number").agg(F.transform(texts, lambda t: t["text"]).alias("_t"), F.max("error_kind").alias("error_kind"))
    return out.select("doc_id", "page_number", F.when(F.size("_t") > 0, F.array_join("_t", "\n")).alias("text"), "error_kind")


def word_tables(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables, cells): shapes from rows and column spans; cells start at the spans before them."""
    rows = _with_pages(blocks).where(F.col("kind") == "t")
    before = Window.partitionBy("doc_id", "block", "row").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(
        "doc_id", "page_number", F.col("block").alias("table_ord"), F.col("row").alias("row_index"),
        F.coalesce(F.sum("span").over(before), F.lit(0)).cast("int").alias("column_index"), F.lit(1).alias("row_span"), F.col("span").alias("column_span"),
        F.when(F.col("text") != "", F.col("text")).alias("text"),
    )
    # a table without cells is one row without a place
    shape = [(F.max("row_index") + 1).alias("row_count"), F.max(F.col("column_index") + F.col("column_span")).alias("column_count")]
    tables = placed.groupBy("doc_id", "page_number", "table_ord").agg(*shape).fillna(0, ["row_count", "column_count"])
    return tables.withColumns({"table_type": F.lit("Docx"), "confidence": F.lit(1.0)}), placed.where(F.col("row_index").isNotNull())
