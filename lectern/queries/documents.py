"""Loading, validation, languages, questions, results and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import schema
from lectern.functions import languages
from lectern.operators import language, questions, results, validation
from lectern.plans import analysis, pages
from lectern.queries.base import LINES, kept, lines, page_boxes, query, work_folder
from lectern.sources import text_files
from lectern.sources.tables import table
from lectern.streaming import documents as streaming


def as_documents(spark, sf_dir):
    """documents as text files: (doc_id, process_id, document_type, content, ...)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return rows.withColumns({
        "document_type": F.lit("Text"), "process_id": F.expr("if(doc_id % 3 = 0, 'read', 'general')"), "mode": F.expr("if(doc_id % 3 = 0, 'Read', 'General')"),
        "error_kind": F.lit(None).cast("string"), "error_detail": F.lit(None).cast("string"),
        "questions": F.array(F.lit("What is this about?"), F.lit(" "), F.lit("Who wrote it?")),
    })


@query("SELECT doc_id, 1 AS page_number, coalesce(text, '') AS text, NULL::VARCHAR AS error_kind FROM documents")
def load_text_pages(spark, sf_dir):
    return text_files.text_pages(as_documents(spark, sf_dir))


@query("""WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines,
    string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) AS plain FROM documents)
SELECT doc_id, 1 AS page_number, CASE WHEN contains(text, ',')
  THEN coalesce(array_to_string(list_filter(lines[2:], lambda x: len(string_split(x, ',')) = len(string_split(lines[1], ','))), chr(10)), '')
  ELSE array_to_string(list_transform(plain, lambda x: trim(x)), chr(10)) END AS text FROM l""")
def csv_page_text(spark, sf_dir):
    return text_files.csv_pages(as_documents(spark, sf_dir)).select("doc_id", "page_number", "text")


_NAMES = "CASE page_id % 10 WHEN 0 THEN 'doc.TXT' WHEN 1 THEN url WHEN 2 THEN '  ' WHEN 3 THEN 'a..csv' WHEN 4 THEN 'noext' WHEN 5 THEN 'x.' WHEN 6 THEN '.hidden' WHEN 7 THEN '  pic.jpeg ' WHEN 8 THEN 'y.exe' ELSE repeat('n', 260) || '.pdf' END"
_DATA = "CASE WHEN page_id % 4 = 3 THEN '!!!' ELSE 'aGVsbG8=' END"


@query(f"""WITH r AS (SELECT page_id AS doc_id, trim({_NAMES}) AS filename, {_DATA} AS data, CASE page_id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'Read' END AS process_id FROM pages),
e AS (SELECT *, CASE WHEN filename = '' THEN 'EmptyFilename' WHEN strlen(filename) > 255 THEN 'FilenameTooLong' WHEN contains(filename, '/') OR contains(filename, '\\') THEN 'ForbiddenCharacter' WHEN contains(filename, '..') THEN 'PathTraversal'
  WHEN NOT contains(filename, '.') OR ends_with(filename, '.') THEN 'MissingExtension' WHEN starts_with(filename, '.') THEN 'InvalidFilenameEdges' WHEN data = '!!!' THEN 'InvalidBase64'
  WHEN lower(regexp_extract(filename, '\\.([^.]*)$', 1)) NOT IN ('txt', 'docx', 'pdf', 'xlsx', 'csv', 'png', 'jpg', 'jpeg', 'tiff', 'tif') THEN 'UnsupportedFileType' END AS error_kind FROM r)
SELECT doc_id, filename, CASE WHEN process_id = 'read' THEN 'Read' ELSE 'General' END AS mode, error_kind,
  CASE WHEN error_kind IS NULL THEN CASE lower(regexp_extract(filename, '\\.([^.]*)$', 1)) WHEN 'txt' THEN 'Text' WHEN 'jpeg' THEN 'Jpeg' END END AS document_type,
  CASE WHEN error_kind IS NULL THEN 200 WHEN error_kind = 'UnsupportedFileType' THEN 422 ELSE 400 END AS status FROM e""")
def validate_requests(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"), F.expr(_NAMES).alias("filename"), F.expr(_DATA).alias("data"), F.expr("CASE page_id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'Read' END").alias("process_id")
    )
    return validation.validate(rows).select("doc_id", "filename", "mode", "error_kind", "document_type", validation.status(F.col("error_kind")).alias("status"))


_EXT = "CASE doc_id % 11 WHEN 0 THEN 'txt' WHEN 1 THEN 'DOCX' WHEN 2 THEN 'pdf' WHEN 3 THEN 'xlsx' WHEN 4 THEN 'Csv' WHEN 5 THEN 'png' WHEN 6 THEN 'jpg' WHEN 7 THEN 'jpeg' WHEN 8 THEN 'tiff' WHEN 9 THEN 'tif' ELSE 'bin' END"


@query(f"""WITH d AS (SELECT doc_id, source || '.' || {_EXT} AS filename FROM documents), t AS (SELECT *, lower(split_part(filename, '.', 2)) AS e FROM d),
k AS (SELECT *, CASE e WHEN 'txt' THEN 'Text' WHEN 'docx' THEN 'Word' WHEN 'pdf' THEN 'Pdf' WHEN 'xlsx' THEN 'Excel' WHEN 'csv' THEN 'Csv' WHEN 'png' THEN 'Png' WHEN 'jpg' THEN 'Jpeg' WHEN 'jpeg' THEN 'Jpeg' WHEN 'tiff' THEN 'Tiff' WHEN 'tif' THEN 'Tiff' END AS document_type FROM t)
SELECT doc_id, document_type, CASE WHEN document_type IN ('Text', 'Word', 'Excel', 'Csv') THEN 'Text' WHEN document_type = 'Pdf' THEN 'Text,Image' WHEN document_type IS NOT NULL THEN 'Image' END AS modalities,
  CASE e WHEN 'jpeg' THEN 'jpg' WHEN 'tif' THEN 'tiff' WHEN 'bin' THEN NULL ELSE e END AS canonical FROM k""")
def dispatch_types(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("."), F.expr(_EXT)).alias("filename"))
    kind = validation.document_type(F.col("filename"))
    return rows.withColumn("document_type", kind).select(
        "doc_id", "document_type", F.array_join(validation.modalities(F.col("document_type")), ",").alias("modalities"), validation.canonical_extension(F.col("document_type")).alias("canonical")
    )


@query("""SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS content, count(*)::BIGINT AS page_count, min_by(role, turn) FILTER (role IS NOT NULL AND role <> 'system') AS language FROM conversations GROUP BY conv_id""")
def document_text(spark, sf_dir):
    """Conversations as documents, turns as pages, a role for the language."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "text", F.expr("nullif(role, 'system')").alias("detected_language"))
    return results.document_text(rows)


@query("""SELECT doc_id, 'Text' AS document_type, '1' AS page_count, lang AS language, CASE WHEN lang IS NULL THEN 2 ELSE 3 END AS entries FROM documents""")
def result_metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", results.metadata(F.lit("Text"), F.lit(1), F.col("lang")).alias("m"))
    return rows.select("doc_id", F.col("m")["document_type"].alias("document_type"), F.col("m")["page_count"].alias("page_count"), F.element_at("m", "language").alias("language"), F.size("m").alias("entries"))


def _results(spark, sf_dir):
    docs = as_documents(spark, sf_dir)
    loaded = analysis.text_pages_only(docs)
    return results.assemble(docs, loaded.drop("error_kind"), answers=analysis.answer_pages(docs, loaded))


@query("""SELECT doc_id, '0.1.0' AS api_version, CASE WHEN doc_id % 3 = 0 THEN 'read' ELSE 'general' END AS process_id, 'text' AS content_format, coalesce(text, '') AS content, 1::INT AS n_pages, 'Text' AS document_type,
  CASE WHEN doc_id % 3 = 0 OR trim(coalesce(text, '')) = '' THEN 0 ELSE 2 END::INT AS n_answers FROM documents""")
def document_results(spark, sf_dir):
    """Flagship: documents as text requests through pages, questions and assembly."""
    return _results(spark, sf_dir).select(
        "doc_id", "api_version", "process_id", "content_format", "content", F.size("pages").alias("n_pages"), F.col("metadata")["document_type"].alias("document_type"), F.size("question_answers").alias("n_answers")
    )


@query("""SELECT doc_id, 200 AS status, coalesce(text, '') AS content, 'success' AS state, doc_id % 3 <> 0 AND trim(coalesce(text, '')) <> '' AS has_answers, false AS has_tables FROM documents""")
def result_json(spark, sf_dir):
    """The JSON of every result, read back."""
    rows = results.result_json(_results(spark, sf_dir))
    value = lambda path: F.get_json_object("body", path)
    return rows.select(
        "doc_id", "status", value("$.result.content").alias("content"), value("$.status").alias("state"), value("$.result.question_answers").isNotNull().alias("has_answers"), value("$.result.tables").isNotNull().alias("has_tables")
    )


_BOX_JSON = "to_json(transform(sequence(0, 3 + int(ord % 2)), i -> named_struct('x', int(x1 + i), 'y', int(y1))))"


@query("""SELECT page, ord, ord % 2 = 0 AS valid, CASE WHEN ord % 2 = 0 THEN x1 + 3 END AS last_x FROM (
  SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS ord, (l_partkey % 90)::INT AS x1 FROM lineitem)""")
def bounds_json(spark, sf_dir):
    """Bounds written and read as JSON: only four points are a box."""
    read = results.read_bounds(F.expr(_BOX_JSON))
    return page_boxes(spark, sf_dir).withColumn("b", read).select("page", "ord", F.col("b").isNotNull().alias("valid"), F.element_at("b", 4)["x"].alias("last_x"))


_CATALOG = "(VALUES " + ", ".join(f"({k}, '{language}', '{model}', {str(script).lower()}, '{d}')" for k, (model, names, script, d) in enumerate(languages.MODELS) for language in names.split()) + ") c(ord, language, model, script, directionality)"
_BEST = f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY script, ord) AS n FROM {_CATALOG}) WHERE n = 1)"


@query(f"WITH {_BEST} SELECT language, 'text_recognition_' || model || '.onnx' AS model_file, model || '_dict.txt' AS dict_file, script AS is_script_model, directionality FROM best")
def language_catalog(spark, sf_dir):
    return languages.catalog(languages.catalog_rows(spark)).drop("ord")


@query(f"WITH {_BEST} SELECT 'text_recognition_' || model || '.onnx' AS model_file, string_agg(language, ',' ORDER BY language) AS languages FROM best WHERE script GROUP BY model")
def model_groups(spark, sf_dir):
    groups = languages.model_groups(languages.catalog(languages.catalog_rows(spark)), script_only=True)
    return groups.select("model_file", F.array_join("languages", ",").alias("languages"))


@query(f"""WITH {_BEST}, d AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' WHEN 'es' THEN 'spanish' END AS language FROM documents)
SELECT doc_id, d.language, 'text_recognition_' || model || '.onnx' AS model_file, coalesce(directionality, 'ltr') AS directionality FROM d LEFT JOIN best b ON d.language = b.language""")
def page_language(spark, sf_dir):
    names = F.element_at(F.create_map(*(F.lit(x) for pair in languages.ISO.items() for x in pair)), F.col("lang"))
    rows = table(spark, sf_dir, "documents").select("doc_id", languages.parse_language(F.upper(names)).alias("language"))
    return languages.with_model(rows, languages.catalog(languages.catalog_rows(spark))).select("doc_id", "language", "model_file", "directionality")


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def detect_sql(text: str) -> str:
    """SQL of ``language.detect``."""
    letters = f"regexp_replace({text}, '[^\\p{{L}}]', '', 'g')"
    count = lambda low, high: f"length(regexp_replace({letters}, '[^\\x{{{low:04X}}}-\\x{{{high:04X}}}]', '', 'g'))"
    scripts = [f"{{'n': {count(low, high)}, 'p': {-k}, 'name': '{name}'}}" for k, (name, low, high) in enumerate(language.SCRIPTS)]
    edges = language.EDGES.replace("'", "''")
    words = f"list_transform(regexp_split_to_array(lower({text}), '\\s+'), lambda w: regexp_replace(w, '^[{edges}]+|[{edges}]+$', '', 'g'))"
    scores = [
        f"{{'n': len(list_filter({words}, lambda w: list_contains({_list(common.split())}, w))), 'f': {str(name == language.FALLBACK).lower()}, 'p': {-k}, 'name': '{name}'}}"
        for k, (name, common) in enumerate(language.COMMON.items())
    ]
    script, best = f"list_max([{', '.join(scripts)}])", f"list_max([{', '.join(scores)}])"
    own = " ".join(f"WHEN {script}.name = '{base}' AND regexp_matches({text}, '[{signs}]') THEN '{name}'" for base, name, signs in language.OWN_LETTERS)
    kana = next(count(low, high) for name, low, high in language.SCRIPTS if name == "japanese")
    n = f"length({letters})"
    return (
        f"CASE WHEN {n} = 0 THEN NULL WHEN {kana} > {language.KANA_SHARE} * {n} THEN 'japanese' WHEN {script}.n > {language.SCRIPT_SHARE} * {n} THEN CASE {own} ELSE {script}.name END "
        f"WHEN {best}.n > 0 THEN {best}.name ELSE '{language.FALLBACK}' END"
    )


@query(f"""SELECT doc_id, CASE WHEN coalesce(text, '') <> '' THEN coalesce({detect_sql('text')}, 'english') END AS language, CASE WHEN coalesce(text, '') <> '' THEN 1.0::DOUBLE END AS confidence,
  CASE WHEN coalesce(text, '') = '' THEN 'InferenceError' END AS error_kind FROM documents""")
def detected_language(spark, sf_dir):
    """The language of every text by script, letters and frequent words."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), "text")
    return language.language_of_text(rows, ["doc_id"]).select("doc_id", "language", "confidence", "error_kind")


_SCORES = "scores AS (SELECT l_orderkey AS doc_id, 'm' || (l_partkey % 4) AS model_file, avg(CASE WHEN l_suppkey % 6 = 0 THEN 0 ELSE (l_suppkey % 64)::DOUBLE / 64 END) AS score FROM lineitem GROUP BY ALL)"


def _scores(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr("concat('m', l_partkey % 4)").alias("model_file"), F.expr("if(l_suppkey % 6 = 0, null, double(l_suppkey % 64) / 64)").alias("score"))
    return language.mean_score(rows, ["doc_id"])


@query(f"WITH {_SCORES} SELECT doc_id, model_file, round(score, 9) AS score FROM scores")
def model_scores(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("score", F.round("score", 9))


@query(f"WITH {_SCORES}, r AS (SELECT doc_id, model_file, round(score, 9) AS score FROM scores) SELECT doc_id, model_file, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, model_file) AS n FROM r) WHERE n = 1")
def best_model(spark, sf_dir):
    return language.best_model(model_scores(spark, sf_dir), ["doc_id"])


@query("""SELECT conv_id AS doc_id, turn AS page_number, CASE WHEN conv_id % 4 = 0 THEN 'french' ELSE first_value(CASE WHEN turn % 3 = 2 THEN 'lang' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) END AS language FROM (SELECT DISTINCT conv_id, turn FROM conversations)""")
def document_language(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), F.expr("if(conv_id % 4 = 0, 'french', null)").alias("requested"), F.expr("if(turn % 3 = 2, concat('lang', turn), null)").alias("found")
    )
    return language.document_language(rows)


@query(f"""WITH {LINES}, p AS (SELECT page, ord, row_number() OVER (PARTITION BY page ORDER BY ord) - 1 AS place FROM lines)
SELECT page, ord FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY place * 7919 % 10007, place) AS n FROM p) WHERE n <= 3""")
def sample_lines(spark, sf_dir):
    """The lines that are sampled of each page: three at most, by place."""
    return language.sample_lines(lines(spark, sf_dir), ["page"]).select("page", "ord")


_ASKED = "asked AS (SELECT a.conv_id AS doc_id, a.turn AS page_number, b.turn AS q_turn, a.text, b.text AS question FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.role = 'user' WHERE a.role = 'assistant' AND trim(coalesce(a.text, '')) <> '')"


def _pages_with_questions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    asked = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    own = rows.where("role = 'user'").groupBy("conv_id").agg(asked.alias("questions"))
    return rows.where("role = 'assistant'").join(own, "conv_id").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "text", "questions")


@query(f"""WITH {_ASKED}, n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY q_turn, question) - 1)::INT AS ord FROM asked)
SELECT doc_id, page_number, ord, question, '<|system|>{questions.SYSTEM_MESSAGE}<|end|><|user|>Document Context:' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || question || '<|end|><|assistant|>' AS prompt FROM n WHERE trim(question) <> ''""")
def qa_prompts(spark, sf_dir):
    """Assistant turns as pages, the user's turns as questions."""
    return questions.prompts(_pages_with_questions(spark, sf_dir))


@query("""SELECT doc_id, CASE WHEN trim(t) = '' THEN NULL ELSE trim(t) END AS answer FROM (SELECT doc_id, '  ' || coalesce(CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END, '') || ' ' AS t FROM documents)""")
def parsed_answers(spark, sf_dir):
    raw = F.concat(F.lit(" \t"), F.expr("coalesce(if(doc_id % 7 = 0, '', source), '')"), F.lit("\n "))
    return table(spark, sf_dir, "documents").select("doc_id", questions.parse_answer(raw).alias("answer"))


@query("""WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Pdf' WHEN 1 THEN 'Png' WHEN 2 THEN 'Text' WHEN 3 THEN 'Tiff' ELSE 'Pdf' END AS kind, doc_id % 2 = 0 AS turned, doc_id % 3 = 0 AS worded FROM documents)
SELECT doc_id, CASE WHEN kind = 'Pdf' THEN CASE WHEN turned AND worded THEN 'embedded' ELSE 'image' END WHEN kind IN ('Png', 'Tiff') THEN 'image' ELSE 'text' END AS route FROM p""")
def page_routes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit(1).alias("page_number"), F.expr("CASE doc_id % 5 WHEN 0 THEN 'Pdf' WHEN 1 THEN 'Png' WHEN 2 THEN 'Text' WHEN 3 THEN 'Tiff' ELSE 'Pdf' END").alias("document_type"), F.expr("if(doc_id % 2 = 0, 0, null)").alias("orientation")
    )
    return pages.route(rows, rows.where("doc_id % 3 = 0")).select("doc_id", "route")


@query("""SELECT doc_id, 1 AS page_number, CASE WHEN doc_id % 2 = 0 THEN 90 ELSE 0 END AS orientation, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE lang END AS detected_language, CASE WHEN doc_id % 4 = 0 THEN 'found' ELSE source END AS text FROM documents""")
def merge_page_results(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), F.lit(0).alias("orientation"), F.col("lang").alias("detected_language"), F.col("source").alias("text"))
    found = rows.where("doc_id % 2 = 0").select("doc_id", "page_number", F.lit(90).alias("orientation"), F.lit("new").alias("detected_language"), F.expr("if(doc_id % 4 = 0, 'found', '')").alias("text"))
    return pages.merge_results(rows, found)


_LAYOUT = "(VALUES " + ", ".join(f"({i}, '{c}', {str(c in schema.REGION_CLASSES).lower()})" for i, c in enumerate(schema.LAYOUT_CLASSES)) + ") t(class_id, class, is_region)"


@query(f"SELECT class, is_region, count(*)::BIGINT AS boxes FROM (SELECT (l_partkey % 24)::INT AS class_id FROM lineitem) JOIN {_LAYOUT} USING (class_id) GROUP BY class, is_region")
def layout_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.expr("int(l_partkey % 24)").alias("class_id"))
    return rows.join(F.broadcast(schema.layout_classes(spark)), "class_id").groupBy("class", "is_region").agg(F.count("*").alias("boxes"))


@query("SELECT event_id AS doc_id, 1 AS page_number, event_type || ' ' || user_id AS text FROM events")
def stream_pages(spark, sf_dir):
    """events as a stream of text documents, through the batch loader."""
    folder = work_folder(spark)
    stream = streaming.table_stream(spark, sf_dir, "events.parquet")

    def pages_of(batch):
        rows = batch.select(F.col("event_id").alias("doc_id"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).cast("binary").alias("content"))
        return text_files.text_pages(rows).select("doc_id", "page_number", "text")

    streaming.run_available(stream, pages_of, f"{folder}/out", f"{folder}/state")
    return kept(spark, spark.read.parquet(f"{folder}/out").drop("batch"), folder)
