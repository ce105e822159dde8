import base64
import io
import json
import math
import re
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern import schema
from lectern.config import ConfigError, Settings
from lectern.functions import languages
from lectern.operators import language, language_model, questions, results, validation
from lectern.plans import analysis
from lectern.plans.models import generate
from lectern.sources import office_files, pdf_files, text_files
from lectern.streaming import documents as streaming

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def p(text="", broken=False):
    return "<w:p><w:r>" + (f"<w:t>{text}</w:t>" if text else "") + ('<w:br w:type="page"/>' if broken else "") + "</w:r></w:p>"


def tbl(rows):
    cell = lambda c: f"<w:tc>{f'<w:tcPr><w:gridSpan w:val=\"{c[1]}\"/></w:tcPr>' if isinstance(c, tuple) else ''}{p(c[0] if isinstance(c, tuple) else c)}</w:tc>"
    return "<w:tbl>" + "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in rows) + "</w:tbl>"


def xlsx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{S}" xmlns:r="{r}"><sheets><sheet name="One" r:id="a"/><sheet name="Empty" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{S}"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{S}"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2"><v>3</v></c></row><row r="3"><c r="C3"><v>2.5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{S}"><sheetData/></worksheet>')
    return out.getvalue()


def files(spark, *contents):
    return spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(contents)], "doc_id bigint, content binary")


def test_text(spark):
    rows = text_files.text_pages(files(spark, b"Hello\nWorld\nTest", b"", b"\xff\xfe\xfd")).orderBy("doc_id").collect()
    assert [(r["text"], r["error_kind"]) for r in rows] == [("Hello\nWorld\nTest", None), ("", None), (None, "TextLoadError")]


def test_csv(spark):
    contents = [b"line1\nline2\nline3", b"h1,h2\na,b", b'h,i\n"value,1",x\r\n"value,4",y\nshort\n', b"", b"a,b\nc,d\nonly\n\ne,f", b" x \n y "]
    rows = text_files.csv_pages(files(spark, *contents)).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["line1\nline2\nline3", "a,b", "value,1,x\nvalue,4,y", "", "c,d\ne,f", "x\ny"]


def test_excel(spark):
    rows = office_files.excel_pages(files(spark, xlsx(), b"no")).orderBy("doc_id", "page_number").collect()
    assert [(r["page_number"], r["text"], r["error_kind"]) for r in rows] == [(1, "Sheet: One\nname\t3\n\t2.5", None), (2, "Sheet: Empty", None), (1, None, "ExcelLoadError")]


def test_word_table(spark):
    body = p("Before") + tbl([["Header 1", "Header 2"], [("wide", 2)]]) + p("After")
    blocks = office_files.word_blocks(files(spark, docx(body)))
    assert office_files.word_pages(blocks).first()["text"] == "Before\nHeader 1\tHeader 2\nwide\nAfter"
    tables, cells = office_files.word_tables(blocks)
    assert (tables.first()["row_count"], tables.first()["column_count"]) == (2, 2)
    rows = cells.orderBy("row_index", "column_index").collect()
    assert [(r["row_index"], r["column_index"], r["column_span"], r["text"]) for r in rows] == [(0, 0, 1, "Header 1"), (0, 1, 1, "Header 2"), (1, 0, 2, "wide")]


@pytest.mark.parametrize(("body", "expected"), [
    (p("a") + p(broken=True) + p("b") + p(broken=True) + p("c"), [(1, "a"), (2, "b"), (3, "c")]),
    (p(broken=True) + p(broken=True) + p("a", True) + p("b"), [(1, "a"), (2, "b")]), ("", [(1, None)]), (p(broken=True), [(1, None)]),
])
def test_word_breaks(spark, body, expected):
    pages = office_files.word_pages(office_files.word_blocks(files(spark, docx(body)))).where("text IS NOT NULL OR page_number = 1").orderBy("page_number").collect()
    assert [(r["page_number"], r["text"]) for r in pages] == expected


def test_file_names(spark):
    cases = {"": "EmptyFilename", "n" * 256: "FilenameTooLong", "a/b.txt": "ForbiddenCharacter", "a..txt": "PathTraversal", "abc": "MissingExtension", "abc.": "MissingExtension", ".txt": "InvalidFilenameEdges", " a.txt　": None, "é" * 126 + ".txt": "FilenameTooLong"}
    rows = spark.createDataFrame(list(cases.items()), "n string, e string").select("e", validation.filename_error(F.col("n")).alias("f")).collect()
    assert all(r["e"] == r["f"] for r in rows)


def test_data_rules(spark):
    rows = spark.createDataFrame([("aGk=", None), ("!!", "InvalidBase64"), ("a" * 24, "Base64DataTooLarge"), (None, None)], "d string, e string")
    assert all(r["e"] == r["f"] for r in rows.select("e", validation.data_error(F.col("d"), 8).alias("f")).collect())


def test_modes_and_types(spark):
    rows = spark.createDataFrame([("general", "General"), ("read", "Read"), ("unknown", "General"), ("", "General"), (None, "General")], "p string, m string")
    assert all(r["m"] == r["f"] for r in rows.select("m", validation.process_mode(F.col("p")).alias("f")).collect())
    kinds = spark.createDataFrame([("a.TXT",), ("b.tif",), ("c",), ("d.x",)], "n string").select(validation.document_type(F.col("n")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["Text", "Tiff", None, None]
    classes = {r["class_id"]: r["class"] for r in schema.layout_classes(spark).collect()}
    assert (classes[0], classes[10], classes[19], classes.get(20)) == ("paragraph_title", "doc_title", "reference_content", None)


def test_pdf(spark):
    def reader(content):
        chars = [("a", 0.0, 0.0, 5.9, 10.0), ("b", None, None, None, None), (" ", None, None, None, None), ("c", 10.2, 0.0, 15.0, 10.0), (" ", 0.0, 0.0, 0.0, 0.0), ("c", 10.9, 0.0, 15.5, 10.5), (" ", 0.0, 0.0, 0.0, 0.0), ("d", None, None, None, None)]
        yield {"text": " one \n\n two", "height": 792.0, "rotations": [0.0, 90.0, 45.0, 90.0], "characters": chars}

    pages = pdf_files.read_pages(files(spark, b"x"), reader)
    assert pdf_files.page_texts(pages).first()["text"] == "one two"
    assert pdf_files.page_orientations(pages).first()["orientation"] == 90
    chars = pages.select("doc_id", "page_number", F.posexplode("characters").alias("ord", "c")).select("doc_id", "page_number", "ord", "c.*")
    words = pdf_files.words_of(chars, ["doc_id", "page_number"]).orderBy("word").collect()
    assert [(w["text"], w["left"], w["offset"], w["length"]) for w in words] == [("ab", 0, 0, 2), ("c", 10, 3, 1)]
    assert pdf_files.read_pages(files(spark, b"x"), None).first()["error_kind"] == "PdfLoadError"


def test_catalog(spark):
    models = languages.catalog(languages.catalog_rows(spark)).collect()
    by = {r["language"]: r for r in models}
    assert len(by) == 68 and by["korean"]["model_file"] == "text_recognition_korean.onnx" and by["russian"]["is_script_model"] is False and by["persian"]["directionality"] == "rtl"
    rows = spark.createDataFrame([("Norwegian", "bokmal"), ("TELEGU", "telugu"), ("klingon", None)], "n string, l string")
    assert all(r["l"] == r["f"] for r in rows.select("l", languages.parse_language(F.col("n")).alias("f")).collect())


def test_language_detection(spark):
    texts = {
        "der Hund ist nicht mit den Katzen": "german", "Привет мир": "russian", "123": None, "": None, "xyz": "english", "Це їжа": "ukrainian", "Ово је љубав": "serbian",
        "این یک گربه است": "persian", "これは漢字です": "japanese", "这是中文": "chinese", "och det är inte": "swedish", "és ez nem egy": "hungarian", "kaj estas, ne mi": "esperanto",
    }
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", language.detect(F.col("t")).alias("l")).collect()
    assert {r["t"]: r["l"] for r in found} == texts
    rows = spark.createDataFrame([("le chat est dans la maison", ["english", "french"]), ("Привет", ["greek", "english"])], "t string, l array<string>")
    assert [r["f"] for r in rows.select(language.detected(F.col("t"), F.col("l")).alias("f")).collect()] == ["french", "greek"]


def test_catalog_file(spark, tmp_path):
    entry = {"name": "persian", "model_file": "a.onnx", "dict_file": "a.txt", "is_script_model": True, "directionality": "rtl"}
    (tmp_path / "c.json").write_text(json.dumps({"persian": entry, "english": {"name": "english", "model_file": "e.onnx", "dict_file": "e.txt"}}, indent=1))
    models = languages.read_catalog(spark, str(tmp_path / "c.json"), "models/edge")
    rows = {r["language"]: r for r in models.collect()}
    assert rows["persian"]["model_file"] == "models/edge/a.onnx" and rows["english"]["directionality"] == "ltr" and rows["english"]["is_script_model"] is False
    assert languages.model_info(models).where("model_file = 'models/edge/a.onnx'").first()["directionality"] == "rtl"


def test_language_of_samples(spark):
    groups = languages.model_groups(languages.catalog(languages.catalog_rows(spark)), script_only=True)
    latin, greek = "text_recognition_latin.onnx", "text_recognition_el.onnx"
    samples = spark.createDataFrame([(1, latin, 0, "der Hund", 0.9), (1, latin, 1, "ist nicht mit", None), (1, greek, 0, "x", 0.1), (1, greek, 1, "y", 0.2)], "page int, model_file string, ord int, text string, score double")
    row = language.language_of_samples(samples, groups, ["page"]).first()
    assert (row["language"], row["model_file"], row["confidence"]) == ("german", latin, 0.45)


def test_greedy_tokens():
    scores = {(5, 6): [0, 1, 1], (2,): [3, 0, 0], (0,): [0, 9, 0]}
    assert generate(lambda new: scores[tuple(new)], [5, 6], {1}) == [2, 0]
    assert generate(lambda new: [0, 1], [1], set(), limit=3) == [1, 1, 1]


def test_questions(spark):
    pages = spark.createDataFrame([(1, 1, "text", ["q1", " ", "q2"]), (1, 2, " \n", ["q"]), (2, 1, None, ["q"]), (3, 1, "x", [])], "doc_id int, page_number int, text string, questions array<string>")
    rows = questions.prompts(pages).orderBy("ord").collect()
    assert [(r["page_number"], r["ord"], r["question"]) for r in rows] == [(1, 0, "q1"), (1, 2, "q2")]
    assert "Document Context:\ntext" in rows[0]["prompt"]


def test_result_json(spark):
    docs = spark.createDataFrame([(1, "general", "Text", None, None), (2, "general", None, "PathTraversal", None)], "doc_id bigint, process_id string, document_type string, error_kind string, error_detail string")
    pages = spark.createDataFrame([(1, 1, 'say "a"', None, "english"), (1, 2, None, 90, None)], "doc_id bigint, page_number int, text string, orientation int, detected_language string")
    rows = {r["doc_id"]: r for r in results.result_json(results.assemble(docs, pages)).collect()}
    body = json.loads(rows[1]["body"])
    assert rows[1]["status"] == 200 and body["status"] == "success"
    assert body["result"]["pages"] == [{"page_number": 1, "text": 'say "a"', "orientation": None, "detected_language": "english"}, {"page_number": 2, "text": None, "orientation": 90}]
    assert body["result"]["metadata"] == {"document_type": "Text", "page_count": "2", "language": "english"} and "tables" not in body["result"]
    assert rows[2]["status"] == 400 and json.loads(rows[2]["body"]) == {"status": "error", "error": "Validation Error", "details": "Filename contains path traversal sequence"}
    assert results.health() == {"status": "ok", "version": "0.1.0"}


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"max_file_size": 5, "model_directory": "m", "host_url": "h"}')
    settings = Settings.load(str(path))
    assert settings.inference_pool_size == 1 and settings.shared_path("x") == "m/x"
    with pytest.raises(ConfigError):
        settings.model_path("x")
    assert Settings().model_path("test.onnx") == "models/edge/test.onnx" and Settings().cache_directory() == "models/edge/trt_engines"
    with pytest.raises(ConfigError):
        Settings.load(str(tmp_path / "missing.json"))


def test_analysis_of_all_formats(spark):
    contents = {"a.txt": b"plain", "b.csv": b"h,i\n1,2", "c.xlsx": xlsx(), "d.docx": docx(p("word") + tbl([["x"]])), "e.pdf": b"%PDF", "f.exe": b"", "g.txt": b"\xff\xfe"}
    rows = [(k, n, base64.b64encode(c).decode(), "general", None, ["why?"]) for k, (n, c) in enumerate(contents.items())]
    found = {r["doc_id"]: r for r in analysis.analyze(spark.createDataFrame(rows, schema.REQUESTS)).collect()}
    assert [found[k]["content"] for k in range(4)] == ["plain", "1,2", "Sheet: One\nname\t3\n\t2.5\nSheet: Empty", "word\nx"]
    assert [found[k]["error_kind"] for k in range(7)] == [None, None, None, None, "PdfLoadError", "UnsupportedFileType", "TextLoadError"]
    assert len(found[3]["tables"]) == 1 and len(found[0]["question_answers"]) == 1


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"{k}.txt").write_text(f"text {k}")
    stream = streaming.file_stream(spark, str(tmp_path / "in"), 2)
    streaming.run_available(stream, lambda rows: text_files.text_pages(rows), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"text {k}" for k in range(5)]


def plain_runs(text):
    letters = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
    return [letters[i : i + 3] for i in range(len(letters) - 2) if letters[i + 1] != " "]


def test_runs_of_letters(spark):
    texts = ["Ab, c", "", " ", "é1ü", "x" * 5, "Das Öl"]
    found = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", language_model.runs(F.col("t")).alias("r")).collect()
    assert {r["k"]: r["r"] for r in found} == {k: plain_runs(t) for k, t in enumerate(texts)}


def test_learned_languages_by_plain_python(spark):
    known = [("a", "abab abba"), ("a", "baba"), ("b", "xyxy xyyx yx"), ("c", "abxy"), (None, "zzz"), ("d", None), ("e", "")]
    asked = [(1, "abba xy"), (2, "yxyx"), (3, "qqq"), (4, None), (5, ""), (6, "AB ba"), (7, "abxy")]
    keep = 4
    counts = {x: Counter() for x in "abc"}
    for name, text in known:
        if name in counts and text:
            counts[name].update(plain_runs(text))
    v = len(set().union(*counts.values()))
    score = lambda name, n: math.floor(1000 * math.log((n + 0.5) / (sum(counts[name].values()) + 0.5 * v)))
    kept = {name: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:keep]) for name, c in counts.items()}
    expected = {}
    for k, text in asked:
        own = [r for r in plain_runs(text or "") if any(r in c for c in kept.values())]
        totals = {name: sum(score(name, kept[name].get(r, 0)) for r in own) for name in "abc"}
        expected[k] = min("abc", key=lambda name: (-totals[name], name)) if own else None
    model = language_model.learn(spark.createDataFrame(known, "language string, text string"), keep=keep)
    rows = spark.createDataFrame(asked, "k int, text string").withColumn("among", F.array(F.lit("b"), F.lit("z")))
    assert {r["k"]: r["found"] for r in language_model.identify(rows, model, ["k"]).collect()} == expected
    assert {r["k"]: r["found"] for r in language_model.identify(rows, model, ["k"], among="among").collect()} == {k: "b" for k in expected}
    nothing = language_model.learn(spark.createDataFrame([], "language string, text string"))
    assert {r["found"] for r in language_model.identify(rows, nothing, ["k"]).collect()} == {None}
    found = {r["k"]: (r["language"], r["error_kind"]) for r in language_model.language_of_text(rows, model, ["k"]).collect()}
    assert found[3] == ("english", None) and found[4] == found[5] == (None, "InferenceError")


def test_learned_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.col("lang").alias("language"), "text").where("lang is not null")
    model = language_model.learn(docs.where("doc_id % 3 <> 1"))
    rows = language_model.identify(docs.where("doc_id % 3 = 1 and text rlike '[a-z]'"), model, ["doc_id"]).select("language", "found").collect()
    assert len(rows) > 250 and sum(r["language"] == r["found"] for r in rows) / len(rows) >= 0.95


def test_learned_languages_need_no_row_for_each_run(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "en", "The cat, the dog"), (2, "de", "Die Katze \U0001d400 das Ü-Tier"), (3, None, "the"), (4, "en", None), (5, "en", "")], "doc_id int, language string, text string")
    monkeypatch.setattr(language_model, "AT_ONCE", 7)
    said = [t for batch in language_model._coded(language_model.pa.array([r["t"] for r in rows.where("text IS NOT NULL").select("doc_id", language_model._letters(F.col("text")).alias("t")).orderBy("doc_id").collect()])) for t in zip(*map(list, batch), strict=True)]
    wanted = rows.where("text IS NOT NULL").orderBy("doc_id").select(language_model.runs(F.col("text")).alias("r")).collect()
    assert said == [(k, language_model._coded_one(run)) for k, r in enumerate(wanted) for run in r["r"]]
    found = language_model.identify(rows, language_model.learn(rows), ["doc_id"])
    assert {r["doc_id"]: r["found"] for r in found.collect()} == {1: "en", 2: "de", 3: "en", 4: None, 5: None}
    assert "Explode" not in found._jdf.queryExecution().optimizedPlan().toString() and "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_sheets_with_plain_rows_are_read_as_their_xml(spark):
    frame = lambda rows, before="", after="": f'{before}<worksheet xmlns="{S}"><sheetData>{rows}</sheetData>{after}</worksheet>'.encode()
    row = '<row r="3" spans="2:9"><c r="B3" s="1"/><c r="AB3" t="s"><v>0</v></c><c r="C3" s="2" t="b"><v>1</v></c><c r="D3" t="str"><v>x; =1</v></c><c r="E3"><v>-2.5</v></c></row>'
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    plain = [frame(row), frame(row * 2 + '<row r="9"></row>', head, '<pageMargins left="0.7"/>'), frame(""), f'<worksheet xmlns="{S}"><sheetData/></worksheet>'.encode()]
    for part in plain:
        assert [c for c in office_files._plain_cells(part) if c[-1] is not None] == [c for c in office_files._parsed_cells(part) if c[-1] is not None]
    other = [
        frame(row.replace("x;", "&lt;")), frame(row.replace("x;", "é")), frame(row.replace("</v></c></row>", "</v></c>")), frame(row.replace("<v>0</v>", "<f>A1</f><v>0</v>")), frame(row.replace("<v>0</v>", "<v></v>")),
        frame(row) + b"<", frame(row, "<!-- <sheetData>"), frame(row).replace(S.encode(), b"urn:other"), frame(row, after=f"<sheetData>{row}</sheetData>"), frame(row + "<!-- a -->"), frame(f"\n{row}"),
        frame(row, '<?xml version="1.0" encoding="latin-1"?>'), b"", b"<sheetData>",
    ]
    assert [office_files._plain_cells(part) for part in other] == [None] * len(other)


def test_archives_are_read_as_zipfile_reads_them():
    parts = {"a.xml": b"<a/>" * 300, "b.xml": b"", "xl/c.xml": b"text"}

    def zipped(kind, comment=b"", date=(1980, 1, 1, 0, 0, 0), stream=False):
        out = io.BytesIO()
        with zipfile.ZipFile(Unseekable(out) if stream else out, "w", kind) as z:
            z.comment = comment
            for name, data in parts.items():
                z.writestr(zipfile.ZipInfo(name, date), data, kind)
        return out.getvalue()

    class Unseekable(io.RawIOBase):
        def __init__(self, out):
            self.out = out

        def writable(self):
            return True

        def write(self, data):
            return self.out.write(data)

    stored, deflated = zipped(zipfile.ZIP_STORED), zipped(zipfile.ZIP_DEFLATED)
    for content in (stored, deflated, zipped(zipfile.ZIP_DEFLATED, stream=True)):
        archive = office_files.Archive(content)
        assert {n: archive.part(n) for n in parts} == parts and archive.part("none") is None and archive.zip is None
    for content in (zipped(zipfile.ZIP_DEFLATED, b"a comment"), zipped(zipfile.ZIP_LZMA), b"before" + stored):
        archive = office_files.Archive(content)
        assert {n: archive.part(n) for n in parts} == parts and archive.zip is not None

    def outcome(read):
        try:
            return {n: read(n) for n in parts}
        except Exception as e:
            return type(e)

    for content in (stored, deflated):  # a byte that is wrong, anywhere, and files cut short
        for k in range(len(content)):
            for bad in (content[:k] + bytes([content[k] ^ 0x55]) + content[k + 1 :], content[:k]):
                expected = outcome(lambda n: zipfile.ZipFile(io.BytesIO(bad)).read(n))  # noqa: B023
                found = outcome(lambda n: office_files.Archive(bad).part(n) if n.encode() else None)  # noqa: B023
                if isinstance(expected, dict):
                    assert found == expected, k
                elif isinstance(found, dict):  # a part that is not there by its name is no error here
                    assert expected is KeyError or found == parts, (k, expected)
