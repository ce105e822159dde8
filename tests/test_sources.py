"""Data sources, the staged sink, table functions and the stateful stream."""

import io
import json
import os
import subprocess
import sys
import textwrap
import time
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern.functions import table_functions
from lectern.operators import language
from lectern.queries.files import make_docx, make_xlsx
from lectern.sources import data_sources, office_files, staged_files, text_files
from lectern import storage
from lectern.streaming import languages

ROOT = str(Path(__file__).resolve().parent.parent)


@pytest.fixture
def sources(spark):
    data_sources.register(spark)
    return spark


def test_files_are_listed_and_dealt_by_size(tmp_path):
    for k in range(10):
        (tmp_path / f"f{k}.txt").write_bytes(b"x" * (100 if k == 3 else 10))
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "a.txt").write_text("no")
    (tmp_path / ".b").write_text("no")
    files = data_sources.listed(str(tmp_path))
    assert [f.base_name for f in files] == [f"f{k}.txt" for k in range(10)]
    groups = [[p.rsplit("/", 1)[-1] for p in g.paths] for g in data_sources.dealt(files, 30, 1000)]
    assert groups == [["f0.txt", "f1.txt", "f2.txt"], ["f3.txt"], ["f4.txt", "f5.txt", "f6.txt"], ["f7.txt", "f8.txt", "f9.txt"]]
    assert len(data_sources.dealt(files, 10**9, 4)) == 3
    assert [f.base_name for f in data_sources.listed(f"{tmp_path}/f3.txt")] == ["f3.txt"] and data_sources.listed(f"file://{tmp_path}/none") == []


def test_document_id_is_the_hash_that_spark_has(spark):
    paths = ["/a/b.docx", "é", "", "x" * 100]
    found = spark.createDataFrame([(p,) for p in paths], "p string").select(F.xxhash64("p").alias("h")).collect()
    assert [r["h"] for r in found] == [data_sources.document_id(p) for p in paths]


def test_formats_and_broken_files(sources, tmp_path):
    rows = [{"n": 1, "part": 3, "supplier": 5}, {"n": 2, "part": 4, "supplier": 6}]
    (tmp_path / "a.docx").write_bytes(make_docx(rows))
    (tmp_path / "b.docx").write_bytes(b"no archive")
    blocks = sources.read.format("lectern-docx").load(str(tmp_path))
    pages = {(r["doc_id"], r["page_number"]): (r["text"], r["error_kind"]) for r in office_files.word_pages(blocks).collect()}
    a, b = (data_sources.document_id(f"{tmp_path}/{n}.docx") for n in "ab")
    assert pages == {(a, 1): ("item 1 part 3", None), (a, 2): ("item 2 part 4\nparts\n3\t5\n4\t6", None), (b, 1): (None, "WordLoadError")}
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "s.xlsx").write_bytes(make_xlsx(rows))
    (tmp_path / "x" / "t.xlsx").write_bytes(b"")
    found = sources.read.format("lectern-xlsx").load(f"file://{tmp_path}/x").collect()
    assert {(r["filename"], r["page_number"], r["error_kind"]) for r in found} == {("s.xlsx", 1, None), ("s.xlsx", 2, None), ("t.xlsx", 1, "ExcelLoadError")}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.txt").write_bytes("a\nb\r\né".encode())
    (tmp_path / "d" / "none.txt").write_bytes(b"")
    found = {(r["filename"], r["index"]): r["character"] for r in sources.read.format("lectern-dictionary").load(f"{tmp_path}/d").collect()}
    assert [found["one.txt", k] for k in range(5)] == ["#", "a", "b", "é", " "] and found["none.txt", 0] == "#"


def test_csv_pages_as_the_expressions_have_them(sources, tmp_path):
    texts = ["h,i\n1,2\n3\n4,5", ' a \n\tb\n', "", 'h,i\n"x,y",2\n', "a,b\r\n1,2\r\n", "é,ü\n1,2", "　x　\ny"]
    for k, t in enumerate(texts):
        (tmp_path / f"{k}.csv").write_bytes(t.encode())
    (tmp_path / "7.csv").write_bytes(b"\xff,\xfe")
    docs = sources.createDataFrame([(k, t.encode()) for k, t in enumerate(texts)] + [(7, b"\xff,\xfe")], "doc_id int, content binary")
    expected = {r["doc_id"]: (r["text"], r["error_kind"]) for r in text_files.csv_pages(docs).collect()}
    found = {int(r["filename"][0]): (r["text"], r["error_kind"]) for r in sources.read.format("lectern-csv").load(str(tmp_path)).collect()}
    assert found == expected


def test_filters_on_names_leave_files_unopened(sources, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.txt").write_text(n)
    (tmp_path / "c.txt").chmod(0)
    read = sources.read.format("lectern-files").load(str(tmp_path))
    assert [r["content"] for r in read.where("filename = 'a.txt'").collect()] == [b"a"]
    assert read.where("filename in ('a.txt', 'b.txt') and filename <> 'a.txt'").count() == 1
    assert read.where("filename = 'a.txt' and filename = 'b.txt'").count() == 0
    reader = data_sources.FileReader({"path": str(tmp_path)}, "doc_id bigint, path string, filename string, content binary", data_sources.Contents.rows)
    rest = list(reader.pushFilters([data_sources.EqualTo(("filename",), "a.txt"), data_sources.EqualTo(("doc_id",), 3)]))
    assert [f.attribute for f in rest] == [("doc_id",)] and [len(p.paths) for p in reader.partitions()] == [1]


def test_an_empty_folder_has_the_columns(sources, tmp_path):
    read = sources.read.format("lectern-docx").load(str(tmp_path))
    assert read.count() == 0 and read.columns[:4] == ["doc_id", "path", "filename", "block"]


def test_stream_of_files_goes_on_where_it_stopped(sources, tmp_path):
    (tmp_path / "in").mkdir()

    def put(k):
        (tmp_path / "in" / f"{k}.csv").write_text(f"h,i\n{k},{k}")
        os.utime(tmp_path / "in" / f"{k}.csv", (1_000_000 + k, 1_000_000 + k))

    def run():
        stream = sources.readStream.format("lectern-csv").load(f"{tmp_path}/in")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(r["text"] for r in sources.read.parquet(f"{tmp_path}/out").collect())

    put(1)
    put(2)
    assert run() == ["1,1", "2,2"]
    put(3)
    assert run() == ["1,1", "2,2", "3,3"] == run()


def results_of(spark, n, start=0):
    return spark.range(start, start + n).selectExpr("id AS doc_id", "200 AS status", "concat('{\"b\":', id, '}') AS body")


def test_sink_writes_a_job_once_and_overwrites_whole_jobs(sources, tmp_path):
    path, read = str(tmp_path / "r"), lambda: sorted(r["doc_id"] for r in sources.read.format("lectern-results").load(str(tmp_path / "r")).collect())
    write = lambda rows, mode, job: rows.write.format("lectern-results").option("jobId", job).mode(mode).save(path)
    write(results_of(sources, 20), "append", "a")
    write(results_of(sources, 20), "append", "a")
    write(results_of(sources, 5, 100), "append", "b")
    assert read() == [*range(20), *range(100, 105)]
    # a commit that broke off before its manifest leaves files that no reader sees; the job that is run again takes their names
    Path(path, "results-c-000000.jsonl").write_text('{"doc_id": 7, "status": 1, "body": "x"}\n')
    assert len(read()) == 25
    write(results_of(sources, 3, 50), "overwrite", "c")
    assert read() == [50, 51, 52]
    names = sorted(os.listdir(path))
    assert names[0] == "_manifest-c.json" and all(n.startswith("results-c-") for n in names[1:])
    assert set(json.loads(Path(path, names[0]).read_text())) == set(names[1:])
    write(results_of(sources, 0), "overwrite", "d")
    assert read() == [] and os.listdir(path) == ["_manifest-d.json"]


def test_sink_where_a_task_fails_twice(tmp_path):
    """In a session that repeats tasks: one task fails in its first two attempts, once half-way through its rows."""
    code = textwrap.dedent(f"""
        import os, sys
        sys.path.insert(0, {ROOT!r})
        from pyspark import TaskContext
        from pyspark.sql import SparkSession, functions as F
        spark = (SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
            .config("spark.sql.shuffle.partitions", "4").config("spark.sql.adaptive.coalescePartitions.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate())
        from lectern.operators import results
        from lectern.queries.documents import _results
        from lectern.sources import data_sources
        data_sources.register(spark)

        @F.udf("string")
        def careless(body, i):
            c = TaskContext.get()
            if c.partitionId() == 1 and c.attemptNumber() < 2 and i >= 20 * c.attemptNumber():
                open("{tmp_path}/failed", "a").write("x")
                raise RuntimeError("lost")
            return body

        rows = results.result_json(_results(spark, "/root/testdata/sf0.001")).repartition(4, "doc_id").sortWithinPartitions("doc_id")
        rows.select("doc_id", "status", careless("body", F.monotonically_increasing_id() % (1 << 33)).alias("body")).write.format("lectern-results").option("jobId", "j").mode("append").save("{tmp_path}/out")
        found = spark.read.format("lectern-results").load("{tmp_path}/out")
        assert found.exceptAll(rows).count() == 0 == rows.exceptAll(found).count() and found.count() == 200, found.count()

        @F.udf("string")
        def broken(body):
            raise RuntimeError("never")

        try:
            rows.select("doc_id", "status", broken("body").alias("body")).write.format("lectern-results").option("jobId", "k").mode("append").save("{tmp_path}/out")
            raise SystemExit("the job should fail")
        except Exception as e:
            assert "never" in str(e)
        assert spark.read.format("lectern-results").load("{tmp_path}/out").count() == 200
    """)
    env = os.environ | {"PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert (tmp_path / "failed").read_text() == "xx"
    names = sorted(os.listdir(tmp_path / "out"))
    assert names[0] == "_manifest-j.json" and len(names) == 5 and all(n.startswith("results-j-") for n in names[1:])


def test_a_stream_batch_that_is_committed_again_is_written_once(sources, tmp_path):
    results_of(sources, 6).write.json(f"{tmp_path}/in")
    kind = "doc_id bigint, status int, body string"

    def run():
        stream = sources.readStream.schema(kind).json(f"{tmp_path}/in")
        out = stream.writeStream.format("lectern-results").option("path", f"{tmp_path}/out").option("jobId", "s").option("checkpointLocation", f"{tmp_path}/state")
        out.trigger(availableNow=True).start().awaitTermination()
        return sorted(r["doc_id"] for r in sources.read.format("lectern-results").load(f"{tmp_path}/out").collect())

    assert run() == list(range(6))
    for p in (tmp_path / "state" / "commits").iterdir():  # the engine did not hear of the commit: the batch runs again
        p.unlink()
    assert run() == list(range(6))
    results_of(sources, 2, 10).write.mode("append").json(f"{tmp_path}/in")
    assert run() == [*range(6), 10, 11]
    assert not [n for n in os.listdir(tmp_path / "out") if n.startswith("_staging")]
    with pytest.raises(ValueError, match="jobId"):
        staged_files.ResultStreamWriter({"path": "/x"}, False)


def test_table_functions(spark):
    table_functions.register(spark)
    rows = [{"n": 1, "part": 3, "supplier": 5}, {"n": 2, "part": 4, "supplier": 6}]
    spark.createDataFrame([(1, make_docx(rows)), (2, b"broken"), (3, None)], "doc_id int, content binary").createOrReplaceTempView("some_files")
    ask = lambda columns, args: spark.sql(f"SELECT doc_id, {columns} FROM some_files, LATERAL lectern_docx({args}) x")
    pages = {tuple(r) for r in ask("page_number, text, error_kind", "content").collect()}
    assert pages == {(1, 1, "item 1 part 3", None), (1, 2, "item 2 part 4\nparts\n3\t5\n4\t6", None), (2, 1, None, "WordLoadError")}
    cells = {tuple(r) for r in ask("page_number, row_index, column_index, column_span, x.text", "content, 'cells'").collect()}
    assert cells == {(1, 2, 0, 0, 2, "parts"), (1, 2, 1, 0, 1, "3"), (1, 2, 1, 1, 1, "5"), (1, 2, 2, 0, 1, "4"), (1, 2, 2, 1, 1, "6")}
    assert ask("block, kind", "content, 'blocks'").count() == 8
    for bad in ("content, 'lines'", "content, string(doc_id)"):
        with pytest.raises(Exception, match="none of|constant"):
            ask("1", bad).collect()
    spark.createDataFrame([(1, make_xlsx(rows)), (2, b"h,i\n1,2")], "doc_id int, content binary").createOrReplaceTempView("other_files")
    assert spark.sql("SELECT * FROM other_files, LATERAL lectern_xlsx(content) WHERE doc_id = 1").count() == 2
    assert spark.sql("SELECT text FROM other_files, LATERAL lectern_csv(content) WHERE doc_id = 2").first()["text"] == "1,2"


@pytest.mark.parametrize("breaks", ["1", "12", "0102", "", "3x1"])
def test_pages_of_blocks_as_the_windows_have_them(spark, breaks):
    """1: a paragraph with a break, 2: an empty one with a break, 0: an empty one, 3: a table, others plain."""
    rows = []
    for k, c in enumerate(breaks):
        if c == "3":
            rows += [(k, "t", "a", False, 0, 0, 2, None), (k, "t", "", False, 1, 0, 1, None), (k, "t", "b", False, 1, 1, 1, None)]
        else:
            rows.append((k, "p", "" if c in "02" else f"text {k}", c in "12", None, None, None, None))
    rows = rows or [(0, "p", "", False, None, None, None, None)]
    blocks = spark.createDataFrame([(1, *r) for r in rows], f"doc_id bigint, {office_files.BLOCK_COLUMNS}")
    expected = {(r["page_number"], r["text"], r["error_kind"]) for r in office_files.word_pages(blocks).collect()}
    assert set(table_functions.word_pages(rows)) == expected
    _, cells = office_files.word_tables(blocks)
    columns = ["page_number", "table_ord", "row_index", "column_index", "row_span", "column_span", "text"]
    assert sorted(table_functions.word_cells(rows)) == sorted(tuple(r[c] for c in columns) for r in cells.select(*columns).collect())


def run_pages(spark, tmp_path, patience):
    stream = spark.readStream.schema("doc_id bigint, page_number int, requested string, found string").json(f"{tmp_path}/in")
    found = languages.page_languages(stream, 1, patience).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    found.trigger(availableNow=True).start().awaitTermination()
    return sorted(((r["doc_id"], r["page_number"], r["language"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=str)


def put_pages(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id bigint, page_number int, requested string, found string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")


def test_languages_of_a_stream_that_is_stopped_half_way(spark, tmp_path):
    """Pages in a wild order, in two runs on one checkpoint: the rows that the whole table gives."""
    pages = [(d, p, "french" if d % 4 == 0 else None, f"lang{p}" if (d + p) % 3 == 0 else None) for d in range(1, 9) for p in range(1, 7)]
    pages.sort(key=lambda r: hash((r[0] * 31 + r[1] * 17) % 23))
    put_pages(spark, tmp_path, pages[:24])
    first = run_pages(spark, tmp_path, "1 day")
    put_pages(spark, tmp_path, pages[24:])
    second = run_pages(spark, tmp_path, "1 day")
    table = spark.createDataFrame(pages, "doc_id bigint, page_number int, requested string, found string")
    expected = sorted(((r["doc_id"], r["page_number"], r["language"]) for r in language.document_language(table).collect()), key=str)
    assert len(first) < 48 and set(first) <= set(second) and second == expected


def test_pages_that_stay_away_are_given_up(spark, tmp_path):
    put_pages(spark, tmp_path, [(1, 1, None, None), (1, 3, None, "greek"), (1, 4, None, "thai"), (2, 2, None, None), (None, 1, None, "x")])
    found = run_pages(spark, tmp_path, "1 day")
    assert found == [(1, 1, None), (None, 1, "x")]
    put_pages(spark, tmp_path / "b", [(1, 1, None, None), (1, 3, None, "greek"), (1, 4, None, "thai"), (2, 2, None, None), (2, None, None, "x")])
    run_pages(spark, tmp_path / "b", "0 seconds")
    put_pages(spark, tmp_path / "b", [(3, 1, None, "dutch")])
    assert run_pages(spark, tmp_path / "b", "0 seconds") == [(1, 1, None), (1, 3, "greek"), (1, 4, "greek"), (2, 2, None), (3, 1, "dutch")]
    put_pages(spark, tmp_path / "b", [(1, 2, None, "late"), (1, 5, "asked", None)])
    assert run_pages(spark, tmp_path / "b", "0 seconds")[1:3] == [(1, 2, "greek"), (1, 3, "greek")]


def test_stream_of_a_table_that_is_a_folder_of_files(spark, tmp_path):
    from lectern.streaming import documents

    spark.range(0, 100, 1, 3).write.parquet(str(tmp_path / "conversations.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "others.parquet"))
    stream = documents.table_stream(spark, str(tmp_path), "conversations.parquet")
    documents.run_available(stream, lambda batch: batch, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(100))


def test_large_files_are_written_in_small_batches(spark):
    import pyarrow as pa

    from lectern.queries import files

    held = []

    class Rows:
        """Stands for a DataFrame: runs the function of mapInArrow on one batch."""

        schema = spark.createDataFrame([], "doc_id bigint, rows array<int>").schema

        def select(self, *columns):
            return self

        def mapInArrow(self, run, ddl):
            item = {"n": 1, "part": 3, "supplier": 7}
            batch = pa.RecordBatch.from_pylist([{"doc_id": k, "rows": [item] * n} for k, n in enumerate([4_000] * 20 + [1] * 1_000 + [0])])
            held.extend(run([batch]))

    files.written(Rows(), files.make_docx)
    assert [k for b in held for k in b.column(0).to_pylist()] == list(range(1_021))
    assert max(b.nbytes for b in held) < 8_000_000 and len(held) < 20


def test_tables_of_word_files_are_read_once(spark):
    from lectern.queries import files
    from lectern.sources import office_files

    docs = spark.createDataFrame([(1, files.make_docx([{"n": 1, "part": 3, "supplier": 7}])), (2, b"broken")], "doc_id bigint, content binary")
    tables, cells = office_files.word_tables(office_files.word_blocks(docs))
    assert tables._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [(r["doc_id"], r["page_number"], r["row_count"], r["column_count"]) for r in tables.collect()] == [(1, 2, 2, 2)]
    assert cells.count() == 3


def test_batches_of_files_are_bounded_by_their_bytes(sources):
    kib = sources.range(0, 2000, 1, 1).select("id", F.expr("repeat('x', 10240)").cast("binary").alias("content"))
    sizes = kib.mapInPandas(lambda batches: (b.iloc[:1].assign(id=sum(map(len, b["content"])))[["id"]] for b in batches), "id bigint").collect()
    assert sum(r["id"] for r in sizes) == 2000 * 10240 and max(r["id"] for r in sizes) < 2 * storage.BATCH_BYTES


def test_a_sheet_takes_time_by_its_rows():
    def seconds(n):
        content = make_xlsx([{"n": k, "part": k, "supplier": k} for k in range(n)])
        began = time.perf_counter()
        assert len(office_files.read_sheets(content)[0][1]) == n
        return time.perf_counter() - began

    seconds(10)
    assert min(seconds(4000) for _ in range(2)) < 12 * min(seconds(800) for _ in range(3))  # 25 times where each row looks at all


def test_pages_of_whole_files_are_those_of_their_blocks(spark):
    of = lambda n: [{"n": k + 1, "part": 3 * k + n, "supplier": k} for k in range(n)]
    docs = spark.createDataFrame([*((n, bytearray(make_docx(of(n)))) for n in range(12)), (99, bytearray(b"broken"))], "doc_id bigint, content binary")
    shuffled = {tuple(r) for r in office_files.word_pages(office_files.word_blocks(docs)).collect()}
    assert {tuple(r) for r in office_files.read_word_pages(docs).collect()} == shuffled


def test_word_files_are_packed_and_read_as_pages_without_a_shuffle(sources, tmp_path):
    rows = [{"n": k + 1, "part": 7919 * k % 20_000, "supplier": 7} for k in range(600)]
    for n in range(4):
        (tmp_path / f"{n}.docx").write_bytes(make_docx(rows[: 200 * n]))
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "3.docx") as z:
        assert z.testzip() is None and z.getinfo("word/document.xml").file_size > 10 * (tmp_path / "3.docx").stat().st_size
    read = lambda what: sources.read.format("lectern-docx").option("rows", what).load(str(tmp_path))
    expected = {tuple(r) for r in office_files.word_pages(read("blocks")).collect()}
    pages = read("pages").select("doc_id", "page_number", "text", "error_kind")
    assert {tuple(r) for r in pages.collect()} == expected and "Exchange" not in pages._jdf.queryExecution().executedPlan().toString()
    cells = office_files.word_tables(read("blocks"))[1].select("doc_id", "page_number", "row_index", "column_index", "text")
    assert {tuple(r) for r in read("cells").select(*cells.columns).collect()} == {tuple(r) for r in cells.collect()}
    with pytest.raises(Exception, match="none of"):
        read("lines").collect()


def test_zip_files_are_those_of_zipfile():
    with zipfile.ZipFile(io.BytesIO(make_xlsx([{"n": 1, "part": 3, "supplier": 7}]))) as z:
        parts = {name: z.read(name).decode() for name in z.namelist()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    assert len(parts) == 5 and make_xlsx([{"n": 1, "part": 3, "supplier": 7}]) == out.getvalue()


def test_streamed_word_files_go_before_their_pages_are_copied(spark, monkeypatch):
    from urllib.parse import urlparse

    from lectern.queries import sources as queries

    folders, left = [], []
    new, copy = queries.work_folder, queries.kept
    monkeypatch.setattr(queries, "work_folder", lambda session: folders.append(new(session)) or folders[-1])

    def kept(session, df, *those):
        left.append([os.path.exists(urlparse(f).path) for f in folders])
        return copy(session, df, *those)

    monkeypatch.setattr(queries, "kept", kept)
    streamed = {tuple(r) for r in queries.docx_stream(spark, "/root/testdata/sf0.001").collect()}
    assert left == [[False, True]] and not any(os.path.exists(urlparse(f).path) for f in folders)
    assert streamed and streamed == {tuple(r) for r in queries.docx_source(spark, "/root/testdata/sf0.001").collect()}
