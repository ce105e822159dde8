"""Data sources, the staged sink, table functions and the stateful stream.

Files are written from lineitem, one for each supplier, through the sink for
files, and read back by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import table_functions
from lectern.operators import results
from lectern.queries.base import kept, query, work_folder
from lectern.queries.documents import _results
from lectern.queries.files import make_docx, make_xlsx, written
from lectern.sources import data_sources
from lectern.sources.tables import table
from lectern.storage import bounded_batches, removed
from lectern.streaming import documents as streaming
from lectern.streaming import languages


def _parts(spark, sf_dir) -> DataFrame:
    """(doc_id, rows): a supplier's items in order."""
    # items that are alike in these are alike in all that a file has of them: the price need not be shuffled to tell them apart
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    items = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order))
    row = F.struct("n", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    return items.groupBy(F.col("l_suppkey").alias("doc_id")).agg(F.sort_array(F.collect_list(row)).alias("rows"))


def _contents(spark, sf_dir, make) -> DataFrame:
    bounded_batches(spark)
    return written(_parts(spark, sf_dir), make)


def _as_files(spark, contents: DataFrame, suffix: str) -> str:
    """A folder with a file for each document, named by its id."""
    data_sources.register(spark)
    named = contents.select(F.concat(F.col("doc_id").cast("string"), F.lit(suffix)).alias("filename"), "content")
    named.write.format("lectern-files").mode("append").save(folder := work_folder(spark))
    return folder


def _by_name(rows: DataFrame) -> DataFrame:
    """rows with the id that the file's name has."""
    return rows.withColumn("doc_id", F.substring_index("filename", ".", 1).cast("bigint"))


_LI = "li AS (SELECT l_suppkey AS doc_id, l_partkey AS part, l_suppkey AS supplier, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)::INT AS n FROM lineitem)"
_PAGED = "paged AS (SELECT *, coalesce(sum(CASE WHEN part % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT + 1 AS page_number FROM li)"
_TABLE = "tables AS (SELECT doc_id, sum(CASE WHEN part % 3 = 0 THEN 1 ELSE 0 END)::INT + 1 AS page_number, 'parts' || chr(10) || string_agg(part || chr(9) || supplier, chr(10) ORDER BY n) AS text, count(*)::INT + 1 AS row_count FROM li GROUP BY doc_id)"
_PAGES = f"""WITH {_LI}, {_PAGED}, {_TABLE}, parts AS (SELECT doc_id, page_number, n, 'item ' || n || ' part ' || part AS text FROM paged UNION ALL SELECT doc_id, page_number, 1000000, text FROM tables)
SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY n) AS text FROM parts GROUP BY doc_id, page_number"""
_CELLS = f"""WITH {_LI} SELECT doc_id, 0 AS row_index, 0 AS column_index, 2 AS column_span, 'parts' AS text FROM (SELECT DISTINCT doc_id FROM li)
UNION ALL SELECT doc_id, n, 0, 1, part::VARCHAR FROM li UNION ALL SELECT doc_id, n, 1, 1, supplier::VARCHAR FROM li"""
_SHEETS = f"""WITH {_LI} SELECT doc_id, 1 AS page_number, 'Sheet: Items' || chr(10) || string_agg('part' || chr(9) || part || chr(9) || CASE WHEN supplier % 2 = 1 THEN 'true' ELSE 'false' END, chr(10) ORDER BY n) AS text FROM li GROUP BY doc_id
UNION ALL SELECT doc_id, 2, 'Sheet: Rest' FROM (SELECT DISTINCT doc_id FROM li)"""


@query(_PAGES)
def docx_source(spark, sf_dir):
    """Word-processor files by ``lectern-docx``."""
    folder = _as_files(spark, _contents(spark, sf_dir, make_docx), ".docx")
    pages = _by_name(spark.read.format("lectern-docx").option("rows", "pages").load(folder))
    return kept(spark, pages.select("doc_id", "page_number", "text"), folder)


@query(_SHEETS)
def xlsx_source(spark, sf_dir):
    """Spreadsheets by ``lectern-xlsx``."""
    folder = _as_files(spark, _contents(spark, sf_dir, make_xlsx), ".xlsx")
    return kept(spark, _by_name(spark.read.format("lectern-xlsx").load(folder)).select("doc_id", "page_number", "text"), folder)


@query(f"WITH {_LI} SELECT doc_id, 1 AS page_number, string_agg(n || ',' || part, chr(10) ORDER BY n) AS text FROM li GROUP BY doc_id")
def csv_source(spark, sf_dir):
    """CSV files by ``lectern-csv``: the header and the rows of odd width are not in the text."""
    lines = F.transform("rows", lambda r: F.concat_ws(",", r["n"].cast("string"), F.concat(F.lit('"'), r["part"].cast("string"), F.lit('"'))))
    text = F.array_join(F.concat(F.array(F.lit("n,part"), F.lit("a,b,c")), lines), "\n")
    folder = _as_files(spark, _parts(spark, sf_dir).select("doc_id", text.cast("binary").alias("content")), ".csv")
    return kept(spark, _by_name(spark.read.format("lectern-csv").load(folder)).select("doc_id", "page_number", "text"), folder)


@query(f"""WITH {_LI} SELECT doc_id, n AS "index", part::VARCHAR AS character FROM li UNION ALL SELECT DISTINCT doc_id, 0, '#' FROM li UNION ALL SELECT doc_id, count(*)::INT + 1, ' ' FROM li GROUP BY doc_id""")
def dictionary_source(spark, sf_dir):
    """Character dictionaries by ``lectern-dictionary``: a part's number stands for a character."""
    text = F.array_join(F.transform("rows", lambda r: r["part"].cast("string")), "\n")
    folder = _as_files(spark, _parts(spark, sf_dir).select("doc_id", text.cast("binary").alias("content")), ".txt")
    return kept(spark, _by_name(spark.read.format("lectern-dictionary").load(folder)).select("doc_id", "index", "character"), folder)


@query(_PAGES)
def docx_stream(spark, sf_dir):
    """The same files as a stream of ``lectern-docx``, pages built from what has come."""
    folder, work = _as_files(spark, _contents(spark, sf_dir, make_docx), ".docx"), work_folder(spark)
    stream = spark.readStream.format("lectern-docx").option("rows", "pages").load(folder)
    streaming.run_available(stream, lambda pages: _by_name(pages).select("doc_id", "page_number", "text"), f"{work}/out", f"{work}/state")
    removed(spark, folder)  # what has come is in the table: its copy need not find room beside the files
    return kept(spark, spark.read.parquet(f"{work}/out").select("doc_id", "page_number", "text"), work)


@query(_CELLS)
def word_cells_sql(spark, sf_dir):
    """Cells of word-processor files by one SQL text over a view."""
    table_functions.register(spark)
    _contents(spark, sf_dir, make_docx).createOrReplaceTempView("lectern_word_files")
    return spark.sql("""
        SELECT f.doc_id, c.row_index, c.column_index, c.column_span, c.text
        FROM lectern_word_files f, LATERAL lectern_docx(f.content, 'cells') c""")


@query(_PAGES)
def word_pages_sql(spark, sf_dir):
    """Pages of word-processor files by SQL."""
    table_functions.register(spark)
    _contents(spark, sf_dir, make_docx).createOrReplaceTempView("lectern_word_files")
    return spark.sql("SELECT f.doc_id, p.page_number, p.text FROM lectern_word_files f, LATERAL lectern_docx(f.content) p")


@query(_SHEETS)
def excel_pages_sql(spark, sf_dir):
    """Sheets of spreadsheets by SQL."""
    table_functions.register(spark)
    _contents(spark, sf_dir, make_xlsx).createOrReplaceTempView("lectern_sheet_files")
    return spark.sql("SELECT f.doc_id, p.page_number, p.text FROM lectern_sheet_files f, LATERAL lectern_xlsx(f.content) p")


@query("""SELECT doc_id, 200 AS status, coalesce(text, '') AS content, 'success' AS state FROM documents""")
def written_results(spark, sf_dir):
    """Results written through the staged sink, twice under one job id, and read back."""
    data_sources.register(spark)
    folder, rows = work_folder(spark), results.result_json(_results(spark, sf_dir))
    for _ in range(2):  # a job that is run again adds nothing
        rows.write.format("lectern-results").option("jobId", "documents").mode("append").save(folder)
    value = lambda path: F.get_json_object("body", path)
    read = spark.read.format("lectern-results").load(folder)
    return kept(spark, read.select("doc_id", "status", value("$.result.content").alias("content"), value("$.status").alias("state")), folder)


@query("""SELECT conv_id AS doc_id, turn::INT AS page_number, CASE WHEN conv_id % 4 = 0 THEN 'french' ELSE first_value(CASE WHEN turn % 3 = 2 THEN 'lang' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) END AS language FROM conversations""")
def stream_document_language(spark, sf_dir):
    """``document_language`` of a stream: pages in any order, the language kept as a document's state."""
    folder = work_folder(spark)
    pages = streaming.table_stream(spark, sf_dir, "conversations.parquet").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), F.expr("if(conv_id % 4 = 0, 'french', null)").alias("requested"), F.expr("if(turn % 3 = 2, concat('lang', turn), null)").alias("found")
    )
    found = languages.page_languages(pages, first_page=0).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    found.trigger(availableNow=True).start().awaitTermination()
    return kept(spark, spark.read.parquet(f"{folder}/out"), folder)
