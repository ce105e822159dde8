"""Requests, catalogs, dictionaries, settings, result children, errors, pixels and tokens."""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lectern import schema
from lectern.config import Settings
from lectern.functions import geometry as g
from lectern.functions import languages, maps, pixels, polygons
from lectern.operators import language, language_model, matching, results, validation
from lectern.plans.models import generate
from lectern.queries.base import CELLS, LINES, PAGE_BOXES, box_columns, cells, items, kept, lines, page_boxes, query, sql_area, work_folder
from lectern.queries.documents import _BEST, _CATALOG, _list, detect_sql
from lectern.queries.files import _LI, _W, _files, _zip
from lectern.sources import office_files, tables
from lectern.sources.tables import table


@query("""SELECT conv_id * 1000 + turn AS doc_id, 'f' || turn || '.txt' AS filename, coalesce(text, '') AS content, role AS process_id, NULL::VARCHAR AS language, 2 AS n_questions FROM conversations""")
def decoded_requests(spark, sf_dir):
    """Requests written as JSON lines, read with the fixed schema and decoded."""
    rows = table(spark, sf_dir, "conversations").select(
        F.expr("conv_id * 1000 + turn").alias("doc_id"), F.expr("concat('f', turn, '.txt')").alias("filename"), F.base64(F.coalesce("text", F.lit("")).cast("binary")).alias("data"),
        F.col("role").alias("process_id"), F.array(F.lit("a"), F.lit("b")).alias("questions"),
    )
    rows.write.json(path := work_folder(spark))
    read = tables.read_requests(spark, path).select("doc_id", "filename", validation.decoded(F.col("data")).cast("string").alias("content"), "process_id", "language", F.size("questions").alias("n_questions"))
    return kept(spark, read, path)


@query("SELECT n_nationkey::INT + 1 AS \"index\", n_name AS character FROM nation UNION ALL SELECT 0, '#' UNION ALL SELECT (SELECT count(*) FROM nation)::INT + 1, ' '")
def dictionary_file(spark, sf_dir):
    """A character dictionary from its file: names of nations as entries, a line each."""
    names = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name")
    names.coalesce(1).write.text(path := work_folder(spark))
    return kept(spark, tables.character_dictionary(spark, path), path)


def _catalog_file(spark) -> str:
    """The models as a catalog file, one language for each of their names; the first entry of a language counts."""
    best = languages.catalog(languages.catalog_rows(spark)).collect()
    entries = {r["language"]: {"name": r["language"], "model_file": r["model_file"], "dict_file": r["dict_file"], "is_script_model": r["is_script_model"], "directionality": r["directionality"]} for r in best}
    spark.createDataFrame([(json.dumps(entries),)], "value string").coalesce(1).write.text(path := work_folder(spark))
    return path


@query(f"WITH {_BEST} SELECT language, 'models/edge/text_recognition_' || model || '.onnx' AS model_file, 'models/edge/' || model || '_dict.txt' AS dict_file, script AS is_script_model, directionality FROM best")
def catalog_file(spark, sf_dir):
    """A catalog read from its JSON file, with paths."""
    return kept(spark, languages.read_catalog(spark, path := _catalog_file(spark), "models/edge"), path)


@query(f"""WITH {_BEST} SELECT 'text_recognition_' || model || '.onnx' AS model_file, min(model || '_dict.txt') AS dict_file, bool_and(script) AS is_script_model, min(directionality) AS directionality FROM best GROUP BY model""")
def model_info(spark, sf_dir):
    """What all languages of a model file share."""
    return kept(spark, languages.model_info(languages.read_catalog(spark, path := _catalog_file(spark))), path)


@query(f"""WITH {_BEST} SELECT 'text_recognition_' || model || '.onnx' AS model_file,
  array_to_string(list_concat(list(language ORDER BY language), list_filter(['english', 'chinese'], lambda x: NOT list_contains(list(language), x))), ',') AS languages FROM best WHERE script GROUP BY model""")
def candidate_languages(spark, sf_dir):
    """A model's languages, and those that are always candidates."""
    groups = languages.model_groups(languages.catalog(languages.catalog_rows(spark)), script_only=True)
    return groups.select("model_file", F.array_join(language.candidates(F.col("languages")), ",").alias("languages"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'bokmal' WHEN 1 THEN 'german' WHEN 2 THEN 'telugu' ELSE 'english' END AS language FROM documents""")
def chosen_languages(spark, sf_dir):
    """The language of a request where it can be read, else the default."""
    asked = F.expr("CASE doc_id % 5 WHEN 0 THEN 'Norwegian' WHEN 1 THEN 'GERMAN' WHEN 2 THEN 'telegu' WHEN 3 THEN 'klingon' END")
    return table(spark, sf_dir, "documents").select("doc_id", languages.chosen_language(asked, F.lit("english")).alias("language"))


_GROUP = f"SELECT model, list(language ORDER BY language) AS names FROM best WHERE script GROUP BY model"


@query(f"""WITH {_BEST}, groups AS ({_GROUP}), d AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'latin' WHEN 1 THEN 'el' ELSE 'cyrillic' END AS model FROM documents WHERE coalesce(text, '') <> ''),
s AS (SELECT d.doc_id, d.model, list_concat(names, ['english', 'chinese']) AS among, {detect_sql('text')} AS found FROM d JOIN groups USING (model))
SELECT doc_id, CASE WHEN list_contains(among, found) THEN found ELSE among[1] END AS language, 'text_recognition_' || model || '.onnx' AS model_file, 0.875::DOUBLE AS confidence FROM s""")
def language_of_samples(spark, sf_dir):
    """Whole texts as two lines that recognisers have read: the surest model's, among its languages."""
    return _of_samples(spark, sf_dir)


def _of_samples(spark, sf_dir, identify=None):
    groups = languages.model_groups(languages.catalog(languages.catalog_rows(spark)), script_only=True)
    rows = table(spark, sf_dir, "documents").where("coalesce(text, '') <> ''").select("doc_id", "text", F.expr("CASE doc_id % 3 WHEN 0 THEN 'latin' WHEN 1 THEN 'el' ELSE 'cyrillic' END").alias("sure"))
    tried = F.explode(F.array(*(F.lit(m) for m in ("latin", "el", "cyrillic", "th"))))
    rows = rows.withColumn("model", tried).withColumn("ord", F.explode(F.array(F.lit(0), F.lit(1))))
    half = F.when(F.col("ord") == 0, F.col("text"))
    score = F.expr("if(model = sure, if(ord = 0, 1.0D, 0.75D), if(ord = 0, 0.5D, null))")
    samples = rows.select("doc_id", F.concat(F.lit("text_recognition_"), "model", F.lit(".onnx")).alias("model_file"), "ord", half.alias("text"), score.alias("score"))
    return language.language_of_samples(samples, groups, ["doc_id"], identify)


_NAMES = "CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' WHEN 'es' THEN 'spanish' END"
_LEARNED = f"""spaced AS (
  SELECT doc_id, {_NAMES} AS language, ' ' || regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g') || ' ' AS s FROM documents WHERE text IS NOT NULL
), runs AS (
  SELECT doc_id, language, run FROM (SELECT doc_id, language, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS run FROM (SELECT *, string_split(s, '') AS c FROM spaced)) WHERE substring(run, 2, 1) <> ' '
), counted AS (
  SELECT language, run, count(*) AS n FROM runs WHERE language IS NOT NULL GROUP BY language, run
), totals AS (
  SELECT language, sum(n)::BIGINT AS total, (SELECT count(DISTINCT run) FROM counted) AS v FROM counted GROUP BY language
), least AS (
  SELECT *, floor(1000.0::DOUBLE * ln((0 + 0.5::DOUBLE) / (total + 0.5::DOUBLE * v)))::BIGINT AS least FROM totals
), kept AS (
  SELECT language, run, floor(1000.0::DOUBLE * ln((n + 0.5::DOUBLE) / (total + 0.5::DOUBLE * v)))::BIGINT - least AS over
  FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY n DESC, run) AS place FROM counted) JOIN least USING (language) WHERE place <= 2000
), known AS (
  SELECT doc_id, run, count(*) AS n FROM runs SEMI JOIN kept USING (run) GROUP BY doc_id, run
), sizes AS (
  SELECT doc_id, sum(n) AS n FROM known GROUP BY doc_id
), sums AS (
  SELECT doc_id, language, sum(n * over) AS over FROM known JOIN kept USING (run) GROUP BY doc_id, language
), learned AS (
  SELECT doc_id, min_by(language, {{'s': -score, 'l': language}}) AS found FROM (
    SELECT z.doc_id, l.language, z.n * l.least + coalesce(s.over, 0) AS score FROM sizes z CROSS JOIN least l LEFT JOIN sums s ON s.doc_id = z.doc_id AND s.language = l.language) GROUP BY doc_id)"""


def _learned(spark, sf_dir):
    """A model of all documents whose language is known."""
    return language_model.learn(table(spark, sf_dir, "documents").select(F.expr(_NAMES).alias("language"), "text"))


@query(f"""WITH {_LEARNED} SELECT doc_id, CASE WHEN coalesce(text, '') <> '' THEN coalesce(found, 'english') END AS language, CASE WHEN coalesce(text, '') <> '' THEN 1.0::DOUBLE END AS confidence,
  CASE WHEN coalesce(text, '') = '' THEN 'InferenceError' END AS error_kind FROM documents LEFT JOIN learned USING (doc_id)""")
def learned_language(spark, sf_dir):
    """The language of every text by a model that was learned from the documents' own."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return language_model.language_of_text(rows, _learned(spark, sf_dir), ["doc_id"]).select("doc_id", "language", "confidence", "error_kind")


@query(f"""WITH {_BEST}, groups AS ({_GROUP}), {_LEARNED}, d AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'latin' WHEN 1 THEN 'el' ELSE 'cyrillic' END AS model FROM documents WHERE coalesce(text, '') <> ''),
s AS (SELECT d.doc_id, d.model, list_concat(names, ['english', 'chinese']) AS among, found FROM d JOIN groups USING (model) LEFT JOIN learned USING (doc_id))
SELECT doc_id, CASE WHEN list_contains(among, found) THEN found ELSE among[1] END AS language, 'text_recognition_' || model || '.onnx' AS model_file, 0.875::DOUBLE AS confidence FROM s""")
def learned_language_of_samples(spark, sf_dir):
    """``language_of_samples`` with the learned model."""
    model = _learned(spark, sf_dir)
    return _of_samples(spark, sf_dir, lambda rows, text, among: language_model.identify(rows, model, ["doc_id"], text, among))


@query(f"WITH {_BEST} SELECT language, 'models/edge/text_recognition_' || model || '.onnx' AS model_path, 'models/' || model || '_dict.txt' AS shared_path, 'models/edge/trt_engines' AS cache, 1073741824::BIGINT AS max_file_size FROM best")
def settings_paths(spark, sf_dir):
    """Settings from their file, and the paths that follow from them."""
    with tempfile.TemporaryDirectory() as folder:  # settings are the driver's own
        Path(folder, "app.json").write_text(json.dumps({"max_file_size": 1 << 30, "model_directory": "models", "host_url": "0.0.0.0:3000", "model_set": "edge"}), encoding="utf-8")
        settings = Settings.load(str(Path(folder, "app.json")))
    rows = languages.catalog(languages.catalog_rows(spark)).collect()
    found = [(r["language"], settings.model_path(r["model_file"]), settings.shared_path(r["dict_file"]), settings.cache_directory(), settings.max_file_size) for r in rows]
    return spark.createDataFrame(found, "language string, model_path string, shared_path string, cache string, max_file_size bigint")


@query("SELECT 'ok' AS status, '0.1.0' AS version")
def health(spark, sf_dir):
    return spark.createDataFrame([results.health()], "status string, version string")


@query("""WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 + 1 AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, l_partkey AS p FROM lineitem)
SELECT doc_id, 3::INT AS n_pages, string_agg(p::VARCHAR, ',' ORDER BY page, n) FILTER (p % 2 = 0) AS regions, string_agg(p::VARCHAR, ',' ORDER BY page, n) FILTER (p % 5 = 0) AS tables,
  count(*) FILTER (p % 5 = 0) > 0 AS has_tables, true AS has_regions FROM i GROUP BY doc_id""")
def result_children(spark, sf_dir):
    """Regions and tables of an order's three pages in one result, by page and then in their own order; empty tables leave the JSON."""
    rows = items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.expr("int(l_linenumber % 3 + 1)").alias("page_number"), F.col("n").alias("ord"), F.col("l_partkey").alias("part"))
    docs = rows.select("doc_id").distinct().withColumns({"process_id": F.lit("general"), "document_type": F.lit("Png")})
    pages = docs.select("doc_id", F.explode(F.array(*map(F.lit, (3, 1, 2)))).alias("page_number")).withColumns({"text": F.lit("t"), "orientation": F.lit(0), "detected_language": F.lit(None).cast("string")})
    found = results.assemble(docs, pages, rows.where("part % 2 = 0"), rows.where("part % 5 = 0"))
    body = results.result_json(found).select("doc_id", "body")
    joined = lambda c: F.expr(f"nullif(array_join(transform({c}, x -> string(x.part)), ','), '')").alias(c)
    has = lambda c: F.get_json_object("body", f"$.result.{c}").isNotNull().alias(f"has_{c}")
    return found.join(body, "doc_id").select("doc_id", F.size("pages").alias("n_pages"), joined("regions"), joined("tables"), has("tables"), has("regions"))


_KINDS = [*results.ERROR_DETAILS, "InternalError"]


@query(f"""WITH d AS (SELECT doc_id, {_list(_KINDS)}[1 + doc_id % {len(_KINDS)}] AS kind, {_list([*results.ERROR_DETAILS.values(), ''])}[1 + doc_id % {len(_KINDS)}] AS details, source FROM documents)
SELECT doc_id, CASE WHEN kind IN {tuple(validation.VALIDATION)} THEN 400 WHEN kind IN {tuple(validation.DOCUMENT)} THEN 422 ELSE 500 END AS status, 'error' AS state,
  CASE WHEN kind IN {tuple(validation.VALIDATION)} THEN 'Validation Error' WHEN kind IN {tuple(validation.DOCUMENT)} THEN 'Document Processing Error' ELSE 'Internal Server Error' END AS error,
  CASE WHEN kind = 'UnsupportedFileType' THEN details || ': ' || source ELSE nullif(details, '') END AS details FROM d""")
def error_bodies(spark, sf_dir):
    """Status and JSON of every kind of error, read back."""
    kinds = F.array(*map(F.lit, _KINDS))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.element_at(kinds, (F.col("doc_id") % len(_KINDS) + 1).cast("int")).alias("kind"), "source")
    body = results.error_json(F.col("kind"), F.when(F.col("kind") == "UnsupportedFileType", F.col("source")))
    value = lambda path: F.get_json_object(body, path)
    return rows.select("doc_id", validation.status(F.col("kind")).alias("status"), value("$.status").alias("state"), value("$.error").alias("error"), value("$.details").alias("details"))


@query(f"""WITH {PAGE_BOXES} SELECT page, ord, (y2 - y1) >= (x2 - x1) * 1.5::DOUBLE AS vertical, CASE WHEN (y2 - y1) >= (x2 - x1) * 1.5::DOUBLE THEN 90 ELSE 0 END AS angle FROM page_boxes""")
def vertical_boxes(spark, sf_dir):
    """Boxes one and a half times as high as wide, and the angle that lines in them start from."""
    vertical = g.is_vertical(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return page_boxes(spark, sf_dir).select("page", "ord", vertical.alias("vertical"), F.when(vertical, 90).otherwise(0).alias("angle"))


@query(f"""WITH {CELLS} SELECT page, ord, {_list(schema.LAYOUT_CLASSES)}[class_id + 1] AS class, x1, y1, x2, y2, {sql_area('cells')} AS area FROM cells WHERE class_id = 8""")
def table_boxes(spark, sf_dir):
    """Layout boxes of the class table, as four points and back."""
    rows = cells(spark, sf_dir).join(F.broadcast(schema.layout_classes(spark)), "class_id").where(F.col("class_id") == schema.TABLE_CLASS)
    b = g.rectangle(*box_columns())
    return rows.select("page", "ord", "class", *g.extent(b), g.polygon_area(b).alias("area"))


@query("""WITH p AS (SELECT vec_id, embedding AS e, (vec_id % 4)::INT AS a, (vec_id % 3)::INT AS b FROM embeddings)
SELECT vec_id, round(avg(e[y * 8 + x + 1]::DOUBLE), 5) AS score FROM p, range(8) r(y), range(8) s(x) WHERE x BETWEEN a AND a + 3 AND y BETWEEN b AND b + 4 GROUP BY vec_id""")
def mean_inside_box(spark, sf_dir):
    """Mean score of the map's pixels in or on a box."""
    x, y = F.expr("int(vec_id % 4)"), F.expr("int(vec_id % 3)")
    score = maps.mean_inside(F.col("embedding"), 8, g.rectangle(x, y, x + 3, y + 4))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(score, 5).alias("score"))


@query("""WITH p AS (SELECT vec_id, embedding AS e, (1 + vec_id % 6)::INT AS a, (1 + vec_id % 5)::INT AS b, (1 + vec_id % 4)::INT AS r FROM embeddings)
SELECT vec_id, round(avg(e[y * 8 + x + 1]::DOUBLE), 5) AS score FROM p, range(8) s(y), range(8) t(x) WHERE abs(x - a) + abs(y - b) <= r GROUP BY vec_id""")
def mean_inside_slanted(spark, sf_dir):
    """Mean score of the map's pixels in or on a square that stands on a corner and may reach over the map's edge."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("int(1 + vec_id % 6)").alias("a"), F.expr("int(1 + vec_id % 5)").alias("b"))
    corners = _diamond(rows, "corners", "a", "b", "int(1 + vec_id % 4)")
    return corners.select("vec_id", F.round(maps.mean_inside(F.col("embedding"), 8, F.col("corners")), 5).alias("score"))


@query(f"""WITH {PAGE_BOXES} SELECT page, ord, '[{{"x":' || x1 || ',"y":' || y1 || '}},{{"x":' || x2 || ',"y":' || y1 || '}},{{"x":' || x2 || ',"y":' || y2 || '}},{{"x":' || x1 || ',"y":' || y2 || '}}]' AS json, true AS same FROM page_boxes""")
def bounds_written(spark, sf_dir):
    """Bounds as JSON, and whether they are read back as they were."""
    rows = page_boxes(spark, sf_dir).withColumn("b", g.rectangle(*box_columns()))
    json_ = results.bounds_json(F.col("b"))
    return rows.select("page", "ord", json_.alias("json"), (results.read_bounds(json_) == F.col("b")).alias("same"))


@query(f"""WITH {PAGE_BOXES} SELECT page, ord, x1 - 7 AS x1, y1 + 11 AS y1, x2 - 7 AS x2, y2 + 11 AS y2, x2 - 7 AS third_x, 0 AS zero, ord % 3 <> 0 AS valid FROM page_boxes""")
def bounds_moved(spark, sf_dir):
    """Boxes moved point by point, a point by its place, the empty box, and which lists of points are boxes."""
    b, moved = g.rectangle(*box_columns()), F.col("moved")
    rows = page_boxes(spark, sf_dir).withColumn("moved", g.translated(b, F.lit(-7), F.lit(11)))
    points = F.when(F.col("ord") % 3 == 0, F.slice("moved", 1, 3)).otherwise(moved)
    zero = F.aggregate(F.transform(g.zero_bounds(), lambda p: p["x"] + p["y"]), F.lit(0), lambda s, v: s + v)
    return rows.select("page", "ord", *g.extent(moved), moved[2]["x"].alias("third_x"), zero.alias("zero"), g.valid_bounds(points).alias("valid"))


@query("""WITH s AS (SELECT vec_id, t, (8 - list_position(list_reverse(embedding[t * 8 + 1 : t * 8 + 8]), list_max(embedding[t * 8 + 1 : t * 8 + 8])))::INT AS token FROM embeddings, range(8) r(t)),
e AS (SELECT vec_id, coalesce(min(t) FILTER (token = 7), 6) AS stop FROM s WHERE t < 6 GROUP BY vec_id)
SELECT vec_id, coalesce(string_agg(token::VARCHAR, ',' ORDER BY t) FILTER (t < stop), '') AS tokens FROM s JOIN e USING (vec_id) GROUP BY vec_id""")
def greedy_tokens(spark, sf_dir):
    """Tokens by the last of the largest scores, up to the stop token 7 or six of them."""

    @F.pandas_udf("string")
    def said(values: pd.Series) -> pd.Series:
        def one(v):
            steps = iter(np.array(v, np.float32).reshape(8, 8))
            return ",".join(map(str, generate(lambda new: next(steps), [1, 2, 3], {7}, 6)))

        return values.map(one)

    return table(spark, sf_dir, "embeddings").select("vec_id", said("embedding").alias("tokens"))


def _image(v) -> np.ndarray:
    """A vector as a picture of 8 x 8 pixels; green and blue are one and two more than red."""
    red = np.abs(np.trunc(np.array(v, np.float32) * np.float32(100))).astype(int).reshape(8, 8) % 200
    return np.stack([red, red + 1, red + 2], axis=2).astype(np.uint8)


def _operations(image: np.ndarray) -> dict[str, np.ndarray]:
    quarter = [(2, 1), (6, 1), (6, 7), (2, 7)]
    lines, widths = pixels.recognition_batch([np.repeat(np.repeat(image, 6, axis=0), 6, axis=1), np.repeat(np.repeat(image, 6, axis=0), 3, axis=1)])
    right, _ = pixels.recognition_batch([np.repeat(np.repeat(image, 6, axis=0), 6, axis=1), np.repeat(np.repeat(image, 6, axis=0), 3, axis=1)], rtl=True)
    line = np.tile(image, (10, 20, 1))
    (cropped, tall), (moved, _) = pixels.crop_all(image, [quarter, [(0, 0), (4, 0), (4, 4), (0, 4)]])
    return {
        "turned_90": pixels.rotate(image, 90), "turned_180": pixels.rotate(image, 180), "turned_270": pixels.rotate(image, 270), "same": pixels.rotate(image, 0),
        "padded": pixels.pad(image, 1, 2, 3, 0, 7), "half": pixels.resize(image, 4, 4), "cropped": cropped, "tall": np.full((1, 1, 3), tall), "corner": moved,
        "stacked": pixels.stack([image, pixels.rotate(image, 180)]), "line": lines[1, ::6, ::6][:, :8], "line_right": right[1, ::6, ::6][:, :8], "widths": np.array(widths)[None, :, None].repeat(3, axis=2),
        "line_input": pixels.line_input(line, False)[:8, :8], "line_input_vertical": pixels.line_input(np.rot90(line), True)[:8, :8],
    }


_PX = "px AS (SELECT vec_id, (i // 8)::INT AS y, (i % 8)::INT AS x, abs(trunc(embedding[i + 1] * 100::FLOAT))::INT % 200 AS v FROM embeddings, range(64) r(i))"


@query(f"""WITH {_PX}, v AS (SELECT vec_id, list(v ORDER BY y, x) AS p FROM px GROUP BY vec_id),
o AS (
  SELECT vec_id, 'same' AS op, y, x, v FROM px
  UNION ALL SELECT vec_id, 'turned_90', 7 - x, y, v FROM px
  UNION ALL SELECT vec_id, 'turned_180', 7 - y, 7 - x, v FROM px
  UNION ALL SELECT vec_id, 'turned_270', x, 7 - y, v FROM px
  UNION ALL SELECT vec_id, 'padded', y::INT, x::INT, CASE WHEN y BETWEEN 1 AND 8 AND x BETWEEN 3 AND 10 THEN p[(y - 1) * 8 + x - 2] ELSE 7 END FROM v, range(11) a(y), range(11) b(x)
  UNION ALL SELECT vec_id, 'half', (y // 2)::INT, (x // 2)::INT, round_even(avg(v), 0)::INT FROM px GROUP BY vec_id, y // 2, x // 2
  UNION ALL SELECT vec_id, 'cropped', y - 1, x - 2, v FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6
  UNION ALL SELECT vec_id, 'corner', y, x, v FROM px WHERE x < 4 AND y < 4
  UNION ALL SELECT vec_id, 'tall', 0, 0, 1 FROM v
  UNION ALL SELECT vec_id, 'stacked', y, x, v FROM px UNION ALL SELECT vec_id, 'stacked', 15 - y, 7 - x, v FROM px
  UNION ALL SELECT vec_id, 'line', y::INT, x::INT, CASE WHEN x < 4 THEN p[y * 8 + x * 2 + 1] ELSE 127 END FROM v, range(8) a(y), range(8) b(x)
  UNION ALL SELECT vec_id, 'line_right', y::INT, x::INT, CASE WHEN x >= 4 THEN p[y * 8 + (x - 4) * 2 + 1] ELSE 127 END FROM v, range(8) a(y), range(8) b(x)
  UNION ALL SELECT vec_id, 'widths', 0, x::INT, CASE x WHEN 0 THEN 48 ELSE 24 END FROM v, range(2) b(x)
  UNION ALL SELECT vec_id, 'line_input', y, x, v FROM px
  UNION ALL SELECT vec_id, 'line_input_vertical', y, x, v FROM px)
SELECT vec_id, op, y, x, v::INT AS red FROM o""")
def picture_operations(spark, sf_dir):
    """Turning, padding, resizing, cropping and stacking of pictures, pixel by pixel."""
    def run(batches):
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # a picture's pixels at a time
                held = [(op, *np.indices(out.shape[:2]).reshape(2, -1), out[:, :, 0].ravel()) for op, out in _operations(_image(v.as_py())).items()]
                ops = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
                y, x, red = (np.concatenate([h[i] for h in held]).astype(np.int32) for i in (1, 2, 3))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(ops), batch.schema.field(0).type), pa.array(ops, pa.string()), pa.array(y), pa.array(x), pa.array(red)], names=["vec_id", "op", "y", "x", "red"])

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, op string, y int, x int, red int")


@query(f"""WITH {_LI} SELECT doc_id, 'top ' || string_agg('in ' || part, ' ' ORDER BY n) AS text FROM li GROUP BY doc_id""")
def nested_cells(spark, sf_dir):
    """The text of a cell that holds a table: its paragraphs, then the inner table's cells."""

    def make(rows):
        p = lambda text: f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"
        inner = "".join(f"<w:tr><w:tc>{p('in ' + str(r['part']))}</w:tc></w:tr>" for r in rows)
        return _zip({"word/document.xml": f'<w:document xmlns:w="{_W}"><w:body><w:tbl><w:tr><w:tc>{p("top")}<w:tbl>{inner}</w:tbl></w:tc></w:tr></w:tbl></w:body></w:document>'})

    _, found = office_files.word_tables(office_files.word_blocks(_files(spark, sf_dir, make)))
    return found.select("doc_id", "text")


def _diamond(rows, prefix: str, cx: str, cy: str, r: str):
    """Slanted boxes: squares that stand on a corner."""
    points = [f"named_struct('x', int({cx} {dx}), 'y', int({cy} {dy}))" for dx, dy in ((f"- {r}", ""), ("", f"- {r}"), (f"+ {r}", ""), ("", f"+ {r}"))]
    return rows.withColumn(prefix, F.expr(f"array({', '.join(points)})"))


@query(f"""WITH {LINES}, d AS (SELECT page, ord, x1 + 20 AS cx, y1 + 20 AS cy, 10 + ord % 5 AS r FROM lines)
SELECT a.page, a.ord AS a, b.ord AS b, round((greatest(least(a.cx + a.cy + a.r, b.cx + b.cy + b.r) - greatest(a.cx + a.cy - a.r, b.cx + b.cy - b.r), 0)::DOUBLE
  * greatest(least(a.cx - a.cy + a.r, b.cx - b.cy + b.r) - greatest(a.cx - a.cy - a.r, b.cx - b.cy - b.r), 0)) / (4 * a.r * a.r), 5) AS overlap
FROM d a JOIN d b ON a.page = b.page AND a.ord <> b.ord""")
def slanted_overlap(spark, sf_dir):
    """Overlap of squares that stand on a corner; turned by 45 degrees they are upright."""
    rows = lines(spark, sf_dir).select("page", "ord", "x1", "y1")
    rows = _diamond(rows, "bounds", "x1 + 20", "y1 + 20", "(10 + ord % 5)")
    a, b = rows.select("page", F.col("ord").alias("a"), F.col("bounds").alias("p")), rows.select("page", F.col("ord").alias("b"), F.col("bounds").alias("q"))
    pairs = a.join(b, "page").where(F.col("a") != F.col("b"))
    return pairs.select("page", "a", "b", F.round(polygons.quad_overlap_udf("p", "q").cast("double"), 5).alias("overlap"))


@query(f"""WITH {LINES}, d AS (SELECT page, ord, x1 + 20 AS cx, y1 + 20 AS cy, 10 + ord % 5 AS r, text FROM lines),
o AS (SELECT a.page, a.ord, min(b.ord) AS box_ord FROM d a JOIN d b ON a.page = b.page AND CAST((greatest(least(a.cx + a.cy + a.r, b.cx + b.cy + b.r) - greatest(a.cx + a.cy - a.r, b.cx + b.cy - b.r), 0)::DOUBLE
  * greatest(least(a.cx - a.cy + a.r, b.cx - b.cy + b.r) - greatest(a.cx - a.cy - a.r, b.cx - b.cy - b.r), 0)) / (4 * a.r * a.r) AS FLOAT) > 0.5::FLOAT GROUP BY a.page, a.ord)
SELECT page, ord, box_ord FROM o""")
def slanted_regions(spark, sf_dir):
    """Slanted lines in slanted region boxes: each line's first box that holds over half of it."""
    rows = lines(spark, sf_dir).select("page", "ord", "x1", "y1")
    rows = _diamond(rows, "bounds", "x1 + 20", "y1 + 20", "(10 + ord % 5)")
    b = F.col("bounds")
    rows = rows.select("page", "ord", "bounds", *g.extent(b))
    boxes = rows.withColumns({"class_id": F.lit(10), "confidence": F.lit(1.0)})
    return matching.lines_to_regions(boxes, rows, ["page"])
