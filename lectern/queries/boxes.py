"""Geometry, suppression, grids and spatial joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lectern.functions import geometry as g
from lectern.functions import polygons
from lectern.operators import grid, matching, suppression
from lectern.queries.base import (
    CELLS, LINES, PAGE_BOXES, WORDS, bounds_of, box_columns, cells, lines, page_boxes, query, sql_iou, sql_overlap, words,
)
from lectern.sources.tables import table


@query(f"""WITH {PAGE_BOXES}
SELECT page, ord, x1 AS l, y1 AS t, x2 AS r, y2 AS b, greatest(x2 - x1, 1) AS width, greatest(y2 - y1, 1) AS height,
       ((x1 + x2) // 2)::INT AS center_x, ((y1 + y2) // 2)::INT AS center_y, ((x2 - x1) * (y2 - y1))::DOUBLE AS area, (2.0 * (x2 - x1 + y2 - y1))::DOUBLE AS around,
       (y2 - y1) >= (x2 - x1) * 1.5 AS tall
FROM page_boxes""")
def box_metrics(spark, sf_dir):
    b = F.col("bounds")
    rows = bounds_of(page_boxes(spark, sf_dir))
    return rows.select(
        "page", "ord", g.left(b).alias("l"), g.top(b).alias("t"), g.right(b).alias("r"), g.bottom(b).alias("b"),
        g.span_of(g.left(b), g.right(b)).alias("width"), g.span_of(g.top(b), g.bottom(b)).alias("height"),
        g.middle(F.col("x1"), F.col("x2")).alias("center_x"), g.middle(F.col("y1"), F.col("y2")).alias("center_y"),
        g.polygon_area(b).alias("area"), g.perimeter(b).cast("double").alias("around"), g.is_vertical(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("tall"),
    )


@query(f"""WITH {PAGE_BOXES}
SELECT a.page, a.ord AS a, b.ord AS b, ({sql_iou('a', 'b')})::DOUBLE AS iou, ({sql_overlap('a', 'b')})::DOUBLE AS overlap
FROM page_boxes a JOIN page_boxes b ON a.page = b.page AND a.ord < b.ord""")
def pairwise_iou(spark, sf_dir):
    rows = page_boxes(spark, sf_dir).select("page", "ord", "x1", "y1", "x2", "y2")
    a, b = rows.toDF("page", "a", *(f"a_{c}" for c in ("x1", "y1", "x2", "y2"))), rows.toDF("page", "b", *(f"b_{c}" for c in ("x1", "y1", "x2", "y2")))
    pairs = a.join(b, "page").where(F.col("a") < F.col("b"))
    p, q = box_columns("a_"), box_columns("b_")
    return pairs.select("page", "a", "b", g.iou(p, q).cast("double").alias("iou"), g.overlap(p, q).cast("double").alias("overlap"))


@query(f"""WITH {PAGE_BOXES}, s AS (SELECT page, ord, x2 - x1 AS w, y2 - y1 AS h FROM page_boxes)
SELECT page, ord, round(CAST((w * h - 2 * (h - 3) - 3 * (w - 2))::DOUBLE / (w * h) AS FLOAT)::DOUBLE, 6) AS iou FROM s""")
def quad_iou(spark, sf_dir):
    """IoU of a box and a slanted one whose corners lie on its sides: what four triangles leave of it, by polygon clipping."""
    rows = bounds_of(page_boxes(spark, sf_dir))
    slanted = F.array(*(g.point(F.col("bounds")[i]["x"] + dx, F.col("bounds")[i]["y"] + dy) for i, (dx, dy) in enumerate(((2, 0), (0, 3), (-2, 0), (0, -3)))))
    return rows.select("page", "ord", F.round(polygons.quad_iou_udf("bounds", slanted).cast("double"), 6).alias("iou"))


@query(f"""WITH {PAGE_BOXES}, points AS (
  SELECT page, ord, [{{'x': x2, 'y': y1 + 3}}, {{'x': x2 - 2, 'y': y2}}, {{'x': x1, 'y': y2 - 1}}, {{'x': x1 + 1, 'y': y1}}] AS p FROM page_boxes
), sorted AS (SELECT page, ord, p, list_sort(p) AS s FROM points)
SELECT page, ord, greatest(sqrt((p[2].x - p[1].x) ** 2 + (p[2].y - p[1].y) ** 2), sqrt((p[3].x - p[2].x) ** 2 + (p[3].y - p[2].y) ** 2))::FLOAT::DOUBLE AS longest,
  CASE WHEN s[2].y > s[1].y THEN s[1].x ELSE s[2].x END AS first_x, CASE WHEN s[4].y > s[3].y THEN s[3].y ELSE s[4].y END AS second_y,
  CASE WHEN s[4].y > s[3].y THEN s[4].x ELSE s[3].x END AS third_x, CASE WHEN s[2].y > s[1].y THEN s[2].y ELSE s[1].y END AS fourth_y
FROM sorted""")
def corner_order(spark, sf_dir):
    c = F.col
    points = F.array(g.point(c("x2"), c("y1") + 3), g.point(c("x2") - 2, c("y2")), g.point(c("x1"), c("y2") - 1), g.point(c("x1") + 1, c("y1")))
    rows = page_boxes(spark, sf_dir).withColumn("p", points)
    ordered, longest = g.corner_order(c("p"))
    return rows.withColumn("o", ordered).select(
        "page", "ord", longest.cast("double").alias("longest"), c("o")[0]["x"].alias("first_x"), c("o")[1]["y"].alias("second_y"), c("o")[2]["x"].alias("third_x"), c("o")[3]["y"].alias("fourth_y")
    )


@query(f"""WITH {PAGE_BOXES}
SELECT page, ord, round(((x2 - x1) * (y2 - y1)) * 1.6::DOUBLE / (2 * (x2 - x1 + y2 - y1)), 6) AS distance FROM page_boxes""")
def expansion_distance(spark, sf_dir):
    return bounds_of(page_boxes(spark, sf_dir)).select("page", "ord", F.round(g.expansion_distance(F.col("bounds"), 1.6), 6).alias("distance"))


def _ring(value: str) -> str:
    """SQL of a coordinate, rounded away from zero."""
    return f"(sign({value}) * floor(abs({value}) + 0.5::DOUBLE))::INT"


@query(f"""WITH {PAGE_BOXES}, d AS (SELECT *, ((x2 - x1) * (y2 - y1)) * 1.6::DOUBLE / (2 * (x2 - x1 + y2 - y1)) AS d FROM page_boxes)
SELECT page, ord, {_ring('x1 - d')} AS x1, {_ring('y1 - d')} AS y1, {_ring('x2 + d')} AS x2, {_ring('y2 + d')} AS y2, true AS around FROM d""")
def expanded_rings(spark, sf_dir):
    """Boxes pushed outwards with round corners: the ring's extent, and whether all its points are as far out as they should be."""

    @F.arrow_udf("x1 int, y1 int, x2 int, y2 int, around boolean")
    def ring(boxes: pa.Array) -> pa.Array:
        x1, y1, x2, y2 = (boxes.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2"))
        box, points = polygons.expand_all(np.stack([x1, y1, x2, y1, x2, y2, x1, y2], axis=1).reshape(-1, 4, 2), 1.6)
        d = (x2 - x1) * (y2 - y1) * 1.6 / (2 * (x2 - x1 + y2 - y1))
        x, y = points.T
        out = np.hypot(np.maximum(np.maximum(x1[box] - x, x - x2[box]), 0), np.maximum(np.maximum(y1[box] - y, y - y2[box]), 0))
        first = np.flatnonzero(np.diff(box, prepend=-1))  # every box has points
        ends = [f.reduceat(c, first).astype(np.int32) for f, c in ((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y))]
        around = np.logical_and.reduceat(np.abs(out - d[box]) <= 0.75, first)
        return pa.StructArray.from_arrays([pa.array(v) for v in (*ends, around)], names=["x1", "y1", "x2", "y2", "around"])

    rows = page_boxes(spark, sf_dir).select("page", "ord", ring(F.struct(*box_columns())).alias("r"))
    return rows.select("page", "ord", "r.*")


@query(f"""WITH {PAGE_BOXES}
SELECT page, ord,
  trunc(least(greatest((x1 * (960::DOUBLE / 960) - 3) * (1900::DOUBLE / 953), 0), 1899))::INT AS x,
  trunc(least(greatest((y2 * (640::DOUBLE / 320) - 5) * (1200::DOUBLE / 630), 0), 1199))::INT AS y
FROM page_boxes""")
def map_to_source_pixels(spark, sf_dir):
    k = lambda v: F.lit(v)
    return page_boxes(spark, sf_dir).select(
        "page", "ord", g.unpadded(F.col("x1"), k(3), k(4), k(960), k(960), k(1900)).alias("x"), g.unpadded(F.col("y2"), k(5), k(5), k(640), k(320), k(1200)).alias("y")
    )


@query(f"""WITH {PAGE_BOXES}
SELECT page, ord, round(x1 * 1.25::DOUBLE)::INT AS x1, round(y1 * 0.5::DOUBLE)::INT AS y1 FROM page_boxes""")
def detector_scale(spark, sf_dir):
    return page_boxes(spark, sf_dir).select("page", "ord", g.rounded(F.col("x1").cast("double"), F.lit(1.25)).alias("x1"), g.rounded(F.col("y1").cast("double"), F.lit(0.5)).alias("y1"))


@query(f"""WITH {PAGE_BOXES}, p AS (
  SELECT a.page, a.ord AS a, b.ord AS b, (greatest(a.y2 - a.y1, 1) + greatest(b.y2 - b.y1, 1)) // 2 AS h,
         (b.y1 + b.y2) // 2 - (a.y1 + a.y2) // 2 AS v, (a.x1 + a.x2) // 2 AS ax, (b.x1 + b.x2) // 2 AS bx, a.x1 AS al, a.x2 AS ar, b.x1 AS bl, b.x2 AS br
  FROM page_boxes a JOIN page_boxes b ON a.page = b.page AND a.ord < b.ord)
SELECT page, a, b, v > trunc(h * 0.3::DOUBLE) OR (abs(v) <= trunc(h * 0.5::DOUBLE) AND ax < bx AND ar <= bl + h // 4) AS ltr,
       v > trunc(h * 0.3::DOUBLE) OR (abs(v) <= trunc(h * 0.5::DOUBLE) AND ax > bx AND al >= br - h // 4) AS rtl FROM p""")
def comes_before(spark, sf_dir):
    rows = page_boxes(spark, sf_dir).select("page", "ord", "x1", "y1", "x2", "y2")
    a, b = rows.toDF("page", "a", *(f"a_{c}" for c in ("x1", "y1", "x2", "y2"))), rows.toDF("page", "b", *(f"b_{c}" for c in ("x1", "y1", "x2", "y2")))
    pairs = a.join(b, "page").where(F.col("a") < F.col("b"))
    p, q = ({c: F.col(k + c) for c in ("x1", "y1", "x2", "y2")} for k in ("a_", "b_"))
    return pairs.select("page", "a", "b", g.comes_before(p, q, F.lit(False)).alias("ltr"), g.comes_before(p, q, F.lit(True)).alias("rtl"))


@query(f"""WITH {PAGE_BOXES} SELECT page, ord, class_id, confidence FROM page_boxes WHERE confidence >= 0.5 AND class_id BETWEEN 0 AND 1 AND x2 > x1 AND y2 > y1""")
def detection_filter(spark, sf_dir):
    return suppression.valid_detections(page_boxes(spark, sf_dir), 2).select("page", "ord", "class_id", "confidence")


_SAME = sql_iou("k", "b")


@query(f"""WITH {PAGE_BOXES}, grouped AS (
  SELECT page, class_id, list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'ord': ord}} ORDER BY confidence DESC, ord) AS l FROM page_boxes GROUP BY page, class_id
), folded AS (
  SELECT page, class_id, list_reduce(list_transform(l, lambda x: [x]), lambda kept, one:
    CASE WHEN len(list_filter(kept, lambda k: ({_SAME.replace('b.', 'one[1].')}) > 0.4::FLOAT)) > 0 THEN kept ELSE list_concat(kept, one) END) AS kept FROM grouped
)
SELECT page, class_id, unnest(kept).ord AS ord FROM folded""")
def nms_keep(spark, sf_dir):
    return suppression.suppress(page_boxes(spark, sf_dir), ["page"]).select("page", "class_id", "ord")


_EDGES = """edges AS (
  SELECT page, 'row' AS axis, unnest([y1, y2]) AS edge FROM page_boxes UNION ALL SELECT page, 'column', unnest([x1, x2]) FROM page_boxes
), marked AS (
  SELECT *, CASE WHEN edge - lag(edge) OVER (PARTITION BY page, axis ORDER BY edge) > 10 THEN 1 ELSE 0 END AS fresh FROM edges
), runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY page, axis ORDER BY edge RANGE UNBOUNDED PRECEDING) AS line_index FROM marked
), grid AS (
  SELECT page, axis, line_index::INT AS line_index, (sum(edge) // count(*))::INT AS line FROM runs GROUP BY ALL)"""


@query(f"WITH {PAGE_BOXES}, {_EDGES} SELECT page, axis, line_index, line FROM grid")
def cluster_grid_lines(spark, sf_dir):
    return grid.cell_lines(page_boxes(spark, sf_dir), ["page"])


def _near(axis: str, edge: str) -> str:
    return f"(SELECT min_by(line_index, {{'d': abs(p.{edge} - g.line), 'i': g.line_index}}) FROM grid g WHERE g.page = p.page AND g.axis = '{axis}')"


@query(f"""WITH {PAGE_BOXES}, {_EDGES}, near AS (
  SELECT page, ord, {_near('row', 'y1')} AS r1, {_near('row', 'y2')} AS r2, {_near('column', 'x1')} AS c1, {_near('column', 'x2')} AS c2 FROM page_boxes p)
SELECT page, ord, r1 AS row_index, c1 AS column_index, greatest(r2 - r1, 1) AS row_span, greatest(c2 - c1, 1) AS column_span FROM near""")
def snap_cells_to_grid(spark, sf_dir):
    return grid.place_cells(page_boxes(spark, sf_dir), ["page"]).select("page", "ord", "row_index", "column_index", "row_span", "column_span")


@query(f"""WITH {PAGE_BOXES}, {_EDGES}, shape AS (
  SELECT page, greatest(count(*) FILTER (axis = 'row') - 1, 1)::INT AS row_count, greatest(count(*) FILTER (axis = 'column') - 1, 1)::INT AS column_count FROM grid GROUP BY page)
SELECT o_orderkey AS page, coalesce(row_count, 0) AS row_count, coalesce(column_count, 0) AS column_count FROM orders LEFT JOIN shape ON o_orderkey = page""")
def table_shapes(spark, sf_dir):
    tables = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    return grid.table_shape(tables, page_boxes(spark, sf_dir), ["page"])


@query(f"""WITH {PAGE_BOXES} SELECT page, ord, x1 + 15 AS x1, y1 + 25 AS y1, x2 + 15 AS x2, y2 + 25 AS y2 FROM page_boxes""")
def cells_to_page(spark, sf_dir):
    rows = page_boxes(spark, sf_dir).withColumns({"table_left": F.lit(15), "table_top": F.lit(25)})
    return grid.to_page(rows).select("page", "ord", "x1", "y1", "x2", "y2")


@query(f"""WITH {CELLS}, {WORDS}
SELECT c.page, c.ord, string_agg(w.text, ' ' ORDER BY w.ord) AS text, round(avg(w.box_score) FILTER (w.text IS NOT NULL), 6) AS box_score, round(avg(w.text_score) FILTER (w.text IS NOT NULL), 6) AS text_score
FROM cells c LEFT JOIN words w ON c.page = w.page AND ({sql_overlap('w', 'c')}) >= 0.5::FLOAT GROUP BY c.page, c.ord""")
def words_to_cells(spark, sf_dir):
    rows = matching.words_to_cells(cells(spark, sf_dir).drop("class_id", "confidence"), words(spark, sf_dir), ["page"])
    return rows.select("page", "ord", "text", F.round("box_score", 6).alias("box_score"), F.round("text_score", 6).alias("text_score"))


@query(f"""WITH {LINES}, {WORDS}, found AS (
  SELECT l.page, l.ord, string_agg(w.text, ' ' ORDER BY w.y1, w.ord) AS text, avg(w.text_score) AS score FROM lines l JOIN words w
  ON l.page = w.page AND w.text IS NOT NULL AND w.y1 BETWEEN l.y1 - (l.y2 - l.y1) AND l.y2 AND ({sql_overlap('w', 'l')}) > 0.75::FLOAT GROUP BY l.page, l.ord)
SELECT l.page, l.ord, coalesce(f.text, l.text) AS text, round(CASE WHEN f.text IS NULL THEN l.text_score ELSE f.score END, 6) AS text_score,
       CASE WHEN f.text IS NULL THEN l.angle ELSE coalesce(l.angle, 0) END AS angle
FROM lines l LEFT JOIN found f ON l.page = f.page AND l.ord = f.ord""")
def words_to_lines(spark, sf_dir):
    rows = matching.words_to_lines(lines(spark, sf_dir), words(spark, sf_dir), ["page"])
    return rows.select("page", "ord", "text", F.round("text_score", 6).alias("text_score"), "angle")


_FIRST = f"""first AS (
  SELECT l.page, l.ord, min(c.ord) AS box_ord FROM lines l JOIN cells c ON l.page = c.page AND c.class_id IN (0, 3, 6, 10, 11, 12, 14) AND ({sql_overlap('l', 'c')}) > 0.5::FLOAT GROUP BY l.page, l.ord)"""


@query(f"WITH {LINES}, {CELLS}, {_FIRST} SELECT page, ord, box_ord FROM first")
def region_boxes_first_match(spark, sf_dir):
    return matching.lines_to_regions(cells(spark, sf_dir), lines(spark, sf_dir), ["page"])


@query(f"""WITH {LINES}, {CELLS}, {_FIRST}, members AS (
  SELECT l.*, f.box_ord FROM lines l JOIN first f ON l.page = f.page AND l.ord = f.ord
), turned AS (
  SELECT page, box_ord, max_by(angle, {{'n': n, 'a': angle}}) AS angle FROM (SELECT page, box_ord, angle, count(*) AS n FROM members WHERE angle IS NOT NULL GROUP BY ALL) GROUP BY page, box_ord
), regions AS (
  SELECT page, box_ord, string_agg(text, ' ' ORDER BY y1, x1, ord) AS content, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, avg(box_score) AS box_score, avg(text_score) AS text_score
  FROM members GROUP BY page, box_ord)
SELECT r.page, r.box_ord, c.class_id, r.content, r.x1, r.y1, r.x2, r.y2, round(r.box_score, 6) AS box_score, round(greatest(r.text_score, c.confidence), 6) AS confidence, t.angle
FROM regions r JOIN cells c ON r.page = c.page AND r.box_ord = c.ord LEFT JOIN turned t ON r.page = t.page AND r.box_ord = t.box_ord""")
def build_regions(spark, sf_dir):
    rows = matching.build_regions(cells(spark, sf_dir), lines(spark, sf_dir), ["page"])
    return rows.select("page", "box_ord", "class_id", "content", "x1", "y1", "x2", "y2", F.round("box_score", 6).alias("box_score"), F.round("confidence", 6).alias("confidence"), "angle")
