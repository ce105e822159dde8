"""How queries are kept, and the derived inputs that several share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import geometry as g
from lectern.sources.tables import table
from lectern.storage import checkpointed, removed, shared_folder

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def work_folder(spark) -> str:
    """A new folder below the shared one, for what a query writes and reads again."""
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


def kept(spark, df: DataFrame, *folders: str) -> DataFrame:
    """df apart from the folders that it was read from, which go."""
    out = checkpointed(df)
    for folder in folders:
        removed(spark, folder)
    return out


def _boxes(rows: DataFrame, x1: str, y1: str, width: str, height: str) -> DataFrame:
    return rows.withColumn("x1", F.expr(x1).cast("int")).withColumn("y1", F.expr(y1).cast("int")).withColumn("x2", F.expr(f"x1 + {width}").cast("int")).withColumn("y2", F.expr(f"y1 + {height}").cast("int"))


def items(spark, sf_dir: str) -> DataFrame:
    """lineitem with n, an item's place in its order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order))


def page_boxes(spark, sf_dir: str) -> DataFrame:
    """(page, ord, x1, y1, x2, y2, class_id, confidence): an order is a page, its items are boxes."""
    rows = items(spark, sf_dir).select(
        F.col("l_orderkey").alias("page"), F.col("n").alias("ord"), "l_partkey", "l_suppkey",
        F.expr("(ascii(l_returnflag) % 3)").alias("class_id"), F.expr("((l_partkey * 31 + l_suppkey * 17 + n * 7) % 1000) / double(1000)").alias("confidence"),
    )
    return _boxes(rows, "l_partkey % 90", "l_suppkey % 40", "20 + l_partkey % 37", "10 + 3 * ord").drop("l_partkey", "l_suppkey")


PAGE_BOXES = """page_boxes AS (
  SELECT page, ord, x1, y1, x1 + w AS x2, y1 + h AS y2, class_id, confidence FROM (
    SELECT l_orderkey AS page, n AS ord, (l_partkey % 90)::INT AS x1, (l_suppkey % 40)::INT AS y1,
           (20 + l_partkey % 37)::INT AS w, 10 + 3 * n AS h, ascii(l_returnflag) % 3 AS class_id,
           ((l_partkey * 31 + l_suppkey * 17 + n * 7) % 1000)::DOUBLE / 1000 AS confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS n FROM lineitem)))"""


def words(spark, sf_dir: str) -> DataFrame:
    """(page, ord, x1, y1, x2, y2, text, box_score, text_score): some words have no text."""
    rows = items(spark, sf_dir).select(
        F.col("l_orderkey").alias("page"), F.col("n").alias("ord"), "l_partkey", "l_suppkey",
        F.expr("if(l_partkey % 11 = 0, null, concat('w', l_partkey % 100))").alias("text"),
        F.expr("double(l_partkey % 64) / 64").alias("box_score"), F.expr("double(l_suppkey % 32) / 32").alias("text_score"),
    )
    return _boxes(rows, "l_partkey % 160", "l_suppkey % 60", "12 + l_partkey % 17", "9").drop("l_partkey", "l_suppkey")


WORDS = """words AS (
  SELECT page, ord, x1, y1, x1 + w AS x2, y1 + 9 AS y2, text, box_score, text_score FROM (
    SELECT l_orderkey AS page, n AS ord, (l_partkey % 160)::INT AS x1, (l_suppkey % 60)::INT AS y1, (12 + l_partkey % 17)::INT AS w,
           CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 'w' || (l_partkey % 100) END AS text,
           (l_partkey % 64)::DOUBLE / 64 AS box_score, (l_suppkey % 32)::DOUBLE / 32 AS text_score
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS n FROM lineitem)))"""


def cells(spark, sf_dir: str) -> DataFrame:
    """(page, ord, x1, y1, x2, y2, class_id, confidence): large boxes on the same pages."""
    rows = items(spark, sf_dir).select(
        F.col("l_orderkey").alias("page"), F.col("n").alias("ord"), "l_partkey", "l_suppkey", F.expr("l_partkey % 20").cast("int").alias("class_id"),
        F.expr("double((l_partkey * 13 + n) % 128) / 128").alias("confidence"),
    )
    return _boxes(rows, "(l_partkey * 7) % 100", "(l_suppkey * 3) % 40", "70 + l_partkey % 50", "30 + l_suppkey % 20").drop("l_partkey", "l_suppkey")


CELLS = """cells AS (
  SELECT page, ord, x1, y1, x1 + w AS x2, y1 + h AS y2, class_id, confidence FROM (
    SELECT l_orderkey AS page, n AS ord, ((l_partkey * 7) % 100)::INT AS x1, ((l_suppkey * 3) % 40)::INT AS y1,
           (70 + l_partkey % 50)::INT AS w, (30 + l_suppkey % 20)::INT AS h, (l_partkey % 20)::INT AS class_id,
           ((l_partkey * 13 + n) % 128)::DOUBLE / 128 AS confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS n FROM lineitem)))"""


def lines(spark, sf_dir: str) -> DataFrame:
    """(page, ord, x1, y1, x2, y2, angle, text, box_score, text_score): lines over the words."""
    rows = items(spark, sf_dir).select(
        F.col("l_orderkey").alias("page"), F.col("n").alias("ord"), "l_partkey", "l_suppkey",
        F.expr("if(l_suppkey % 3 = 0, null, int(90 * (l_partkey % 4)))").alias("angle"), F.expr("if(l_partkey % 5 = 0, null, concat('line', n))").alias("text"),
        F.expr("double(l_partkey % 16) / 16").alias("box_score"), F.expr("double(l_suppkey % 8) / 8").alias("text_score"),
    )
    return _boxes(rows, "(l_partkey * 3) % 60", "(l_suppkey * 7) % 55", "60 + l_partkey % 60", "14").drop("l_partkey", "l_suppkey")


LINES = """lines AS (
  SELECT page, ord, x1, y1, x1 + w AS x2, y1 + 14 AS y2, angle, text, box_score, text_score FROM (
    SELECT l_orderkey AS page, n AS ord, ((l_partkey * 3) % 60)::INT AS x1, ((l_suppkey * 7) % 55)::INT AS y1, (60 + l_partkey % 60)::INT AS w,
           CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE (90 * (l_partkey % 4))::INT END AS angle,
           CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 'line' || n END AS text,
           (l_partkey % 16)::DOUBLE / 16 AS box_score, (l_suppkey % 8)::DOUBLE / 8 AS text_score
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS n FROM lineitem)))"""


def sql_both(a: str, b: str) -> str:
    """SQL area that two boxes share."""
    return f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0)::DOUBLE * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0))"


def sql_area(a: str) -> str:
    return f"(greatest({a}.x2 - {a}.x1, 0)::DOUBLE * greatest({a}.y2 - {a}.y1, 0))"


def sql_iou(a: str, b: str) -> str:
    both = sql_both(a, b)
    return f"CASE WHEN {sql_area(a)} > 0 AND {sql_area(b)} > 0 THEN CAST({both} / ({sql_area(a)} + {sql_area(b)} - {both}) AS FLOAT) ELSE 0::FLOAT END"


def sql_overlap(a: str, b: str) -> str:
    return f"CASE WHEN {sql_area(a)} > 0 THEN CAST({sql_both(a, b)} / {sql_area(a)} AS FLOAT) ELSE 0::FLOAT END"


def box_columns(prefix: str = "") -> list:
    return [F.col(prefix + c) for c in ("x1", "y1", "x2", "y2")]


def bounds_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bounds", g.rectangle(*box_columns()))
