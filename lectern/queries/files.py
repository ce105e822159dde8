"""Office files: every order is written as one, then read back by the loaders."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from lectern.queries.base import items, query
from lectern.sources import office_files
from lectern.storage import bounded_batches

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


#: A zip file's records after their signatures: of a part, of the same part in the directory, and of the directory.
_PART, _ENTRY, _END = struct.Struct("<4s2B4H3L2H"), struct.Struct("<4s4B4H3L5H2L"), struct.Struct("<4s4H2LH")
_STORED, _DEFLATED, _FIRST_DAY = 0, 8, 1 << 5 | 1


def _part(name: str, text: str, deflated: bool = False) -> tuple[bytes, bytes, bytes]:
    """A part of a zip file with an ASCII name, and its entry before and after the place where the part begins."""
    data, named = text.encode(), name.encode("ascii")
    sums = zlib.crc32(data), len(data)
    if deflated:
        packer = zlib.compressobj(1, zlib.DEFLATED, -zlib.MAX_WBITS)
        data = packer.compress(data) + packer.flush()
    about = 20, 0, 0, _DEFLATED if deflated else _STORED, 0, _FIRST_DAY, sums[0], len(data), sums[1], len(named), 0
    entry = _ENTRY.pack(b"PK\1\2", 20, 3, *about, 0, 0, 0, 0o600 << 16, 0)
    return _PART.pack(b"PK\3\4", *about) + named + data, entry[:-4], named


def _joined(parts: list[tuple[bytes, bytes, bytes]]) -> bytes:
    """The zip file of parts: the bytes that ``zipfile`` would write, without its objects for each part."""
    at, entries = 0, []
    for part, entry, name in parts:
        entries += entry, at.to_bytes(4, "little"), name
        at += len(part)
    directory = b"".join(entries)
    return b"".join([*(part for part, _, _ in parts), directory, _END.pack(b"PK\5\6", 0, 0, len(parts), len(parts), len(directory), at, 0)])


def make_docx(rows: list) -> bytes:
    """A paragraph for each item, a page break after every third part, and a table of parts and suppliers."""
    p = lambda text, broken=False: f"<w:p><w:r><w:t>{text}</w:t>{'<w:br w:type=\"page\"/>' if broken else ''}</w:r></w:p>"
    cell = lambda text, span=1: f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/></w:tcPr>{p(text)}</w:tc>'
    body = "".join(p(f"item {r['n']} part {r['part']}", r["part"] % 3 == 0) for r in rows)
    table = "<w:tr>" + cell("parts", 2) + "</w:tr>" + "".join(f"<w:tr>{cell(r['part'])}{cell(r['supplier'])}</w:tr>" for r in rows)
    return _zip({"word/document.xml": f'<w:document xmlns:w="{_W}"><w:body>{body}<w:tbl>{table}</w:tbl></w:body></w:document>'}, deflated=True)


def _zip(parts: dict[str, str], deflated: bool = False) -> bytes:
    return _joined([_part(name, text, deflated) for name, text in parts.items()])


#: Parts of a workbook that all have.
_BOOK = [
    _part("xl/workbook.xml", f'<workbook xmlns="{_S}" xmlns:r="{_R}"><sheets><sheet name="Items" r:id="a"/><sheet name="Rest" r:id="b"/></sheets></workbook>'),
    _part("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/a.xml"/><Relationship Id="b" Target="worksheets/b.xml"/></Relationships>'),
    _part("xl/sharedStrings.xml", f'<sst xmlns="{_S}"><si><t>part</t></si></sst>'),
]
_REST = _part("xl/worksheets/b.xml", f'<worksheet xmlns="{_S}"><sheetData/></worksheet>')


def make_xlsx(rows: list) -> bytes:
    """Two sheets: items with a shared string and numbers, starting at C2; and one without cells."""
    lines = "".join(f'<row r="{k + 2}"><c r="C{k + 2}" t="s"><v>0</v></c><c r="D{k + 2}"><v>{r["part"]}</v></c><c r="E{k + 2}" t="b"><v>{r["supplier"] % 2}</v></c></row>' for k, r in enumerate(rows))
    return _joined([*_BOOK, _part("xl/worksheets/a.xml", f'<worksheet xmlns="{_S}"><sheetData>{lines}</sheetData></worksheet>'), _REST])


#: Files that are written at a time, and the items of a batch of files: a file's size goes by its items.
FILES_AT_ONCE, ITEMS_AT_ONCE = 500, 10_000


def written(rows, make):
    """(doc_id, content) of rows (doc_id, rows): the file that ``make`` has of each, in batches of few large or many small files; callers bound the batches that come."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            names = [f.name for f in lists.type.value_type]
            sizes, start = lists.value_lengths().to_pylist(), 0
            while start < len(sizes):
                end, n = start + 1, sizes[start]
                while end < len(sizes) and end - start < FILES_AT_ONCE and n + sizes[end] <= ITEMS_AT_ONCE:
                    n, end = n + sizes[end], end + 1
                # columns become Python values at once; nested values would, one by one, take longer than the files
                items = lists.slice(start, end - start).flatten()
                parts, at, contents = [dict(zip(names, v, strict=True)) for v in zip(*(c.to_pylist() for c in items.flatten()), strict=True)], 0, []
                for k in sizes[start:end]:
                    contents.append(make(parts[at : at + k]))
                    at += k
                yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), pa.array(contents, pa.binary())], names=["doc_id", "content"])
                start = end

    return rows.select("doc_id", "rows").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, content binary")


def _files(spark, sf_dir, make):
    """(doc_id, content): a file for each order."""
    bounded_batches(spark)
    rows = items(spark, sf_dir).groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.sort_array(F.collect_list(F.struct("n", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")))).alias("rows")
    )
    return written(rows, make)


_LI = "li AS (SELECT l_orderkey AS doc_id, l_partkey AS part, l_suppkey AS supplier, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS n FROM lineitem)"
_PAGED = "paged AS (SELECT *, coalesce(sum(CASE WHEN part % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT + 1 AS page_number FROM li)"
_TABLE = "tables AS (SELECT doc_id, sum(CASE WHEN part % 3 = 0 THEN 1 ELSE 0 END)::INT + 1 AS page_number, 'parts' || chr(10) || string_agg(part || chr(9) || supplier, chr(10) ORDER BY n) AS text, count(*)::INT + 1 AS row_count FROM li GROUP BY doc_id)"


@query(f"""WITH {_LI}, {_PAGED}, {_TABLE}, parts AS (SELECT doc_id, page_number, n, 'item ' || n || ' part ' || part AS text FROM paged UNION ALL SELECT doc_id, page_number, 1000000, text FROM tables)
SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY n) AS text FROM parts GROUP BY doc_id, page_number""")
def word_pages(spark, sf_dir):
    return office_files.read_word_pages(_files(spark, sf_dir, make_docx)).select("doc_id", "page_number", "text")


@query(f"""WITH {_LI}, {_TABLE} SELECT doc_id, page_number, 'Docx' AS table_type, row_count, 2 AS column_count FROM tables""")
def word_tables(spark, sf_dir):
    tables, _ = office_files.word_tables(office_files.word_blocks(_files(spark, sf_dir, make_docx)))
    return tables.select("doc_id", "page_number", "table_type", "row_count", "column_count")


@query(f"""WITH {_LI} SELECT doc_id, 0 AS row_index, 0 AS column_index, 2 AS column_span, 'parts' AS text FROM (SELECT DISTINCT doc_id FROM li)
UNION ALL SELECT doc_id, n, 0, 1, part::VARCHAR FROM li UNION ALL SELECT doc_id, n, 1, 1, supplier::VARCHAR FROM li""")
def word_cells(spark, sf_dir):
    _, cells = office_files.word_tables(office_files.word_blocks(_files(spark, sf_dir, make_docx)))
    return cells.select("doc_id", "row_index", "column_index", "column_span", "text")


@query(f"""WITH {_LI} SELECT doc_id, 1 AS page_number, 'Sheet: Items' || chr(10) || string_agg('part' || chr(9) || part || chr(9) || CASE WHEN supplier % 2 = 1 THEN 'true' ELSE 'false' END, chr(10) ORDER BY n) AS text FROM li GROUP BY doc_id
UNION ALL SELECT doc_id, 2, 'Sheet: Rest' FROM (SELECT DISTINCT doc_id FROM li)""")
def excel_pages(spark, sf_dir):
    return office_files.excel_pages(_files(spark, sf_dir, make_xlsx)).select("doc_id", "page_number", "text")
