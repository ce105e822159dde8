import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import geometry as g
from lectern.functions import pixels, polygons
from lectern.operators import grid, matching, orientation, suppression


def box(x1, y1, x2, y2):
    return [F.lit(v) for v in (x1, y1, x2, y2)]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("a", "b", "expected"), [
    ((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (20, 20, 30, 30), 0.0), ((0, 0, 10, 10), (5, 0, 15, 10), 1 / 3), ((5, 5, 5, 9), (0, 0, 10, 10), 0.0),
    ((-10, -10, 0, 0), (-5, -10, 5, 0), 1 / 3), ((0, 0, 20, 20), (5, 5, 15, 15), 0.25), ((0, 0, 10, 10), (10, 0, 20, 10), 0.0),
])
def test_iou(spark, a, b, expected):
    assert value(spark, g.iou(box(*a), box(*b))) == pytest.approx(expected, abs=1e-6)
    quad = lambda x1, y1, x2, y2: np.array([(x1, y1), (x2, y1), (x2, y2), (x1, y2)], float)
    assert polygons.quad_iou(quad(*a), quad(*b)) == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize(("a", "b", "expected"), [((0, 0, 10, 10), (5, 0, 15, 10), 0.5), ((5, 5, 10, 10), (0, 0, 20, 20), 1.0), ((5, 5, 5, 5), (0, 0, 10, 10), 0.0)])
def test_overlap(spark, a, b, expected):
    assert value(spark, g.overlap(box(*a), box(*b))) == pytest.approx(expected)


def test_middle_goes_towards_zero(spark):
    assert value(spark, g.middle(F.lit(-4), F.lit(-3))) == -3


def test_corner_order(spark):
    points = g.rectangle(*box(0, 0, 10, 10))
    ordered, longest = g.corner_order(points)
    assert [tuple(p) for p in value(spark, ordered)] == [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert value(spark, longest) == 10


def test_polygons():
    square = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)
    wide = polygons.expand(square, 2.0)
    assert wide[:, 0].min() < 0 and wide[:, 0].max() > 10 and wide[:, 1].min() < 0 and wide[:, 1].max() > 10
    assert not len(polygons.expand(np.zeros((4, 2)), 2.0))
    diamond = np.array([(5, 0), (10, 5), (5, 10), (0, 5)], float)
    assert polygons.shared_area(square, diamond) == pytest.approx(50)
    assert polygons.area(polygons.smallest_rectangle(diamond)) == pytest.approx(50)
    assert polygons.mean_inside(square, np.full((20, 20), 0.5)) == pytest.approx(0.5)


DETECTIONS = [(0, 0, 10, 10, 0, 0.9), (1, 1, 11, 11, 0, 0.8), (20, 20, 30, 30, 0, 0.7)]


@pytest.mark.parametrize(("boxes", "threshold", "kept"), [
    (DETECTIONS, 0.5, [0, 2]), ([DETECTIONS[0], (1, 1, 11, 11, 1, 0.8)], 0.5, [0, 1]), ([DETECTIONS[0], (1, 1, 11, 11, 0, 0.9)], 0.5, [0]),
    ([DETECTIONS[0], (5, 0, 15, 10, 0, 0.8)], 0.33, [0]), ([DETECTIONS[0], (9, 0, 19, 10, 0, 0.8)], 0.0, [0]), ([DETECTIONS[0], (5, 0, 15, 10, 0, 0.8)], 1.0, [0, 1]),
])
def test_suppression(spark, boxes, threshold, kept):
    rows = spark.createDataFrame([(1, k, *b) for k, b in enumerate(boxes)], "page int, ord int, x1 int, y1 int, x2 int, y2 int, class_id int, confidence double")
    found = suppression.suppress(rows.repartition(3), ["page"], threshold=threshold)
    assert sorted(r["ord"] for r in found.collect()) == kept


def test_grid_lines(spark):
    edges = spark.createDataFrame([(1, "row", e) for e in (0, 3, 12, 50, 58, 100)], "t int, axis string, edge int")
    rows = grid.grid_lines(edges.repartition(3), ["t"]).orderBy("line_index").collect()
    assert [r["line"] for r in rows] == [5, 54, 100]


def test_empty_table_and_nearest_tie(spark):
    tables = spark.createDataFrame([(1,), (2,)], "t int")
    cells = spark.createDataFrame([(1, 0, 0, 0, 100, 100), (1, 1, 50, 0, 100, 100)], "t int, ord int, x1 int, y1 int, x2 int, y2 int")
    shapes = {r["t"]: (r["row_count"], r["column_count"]) for r in grid.table_shape(tables, cells, ["t"]).collect()}
    assert shapes == {1: (1, 2), 2: (0, 0)}
    edges = spark.sql("SELECT 5 AS edge, named_struct('line_index', 0, 'line', 0, 'after', 10) AS last")
    assert edges.select(grid._nearest("last", "edge").alias("i")).first()["i"] == 0


def test_orientations(spark):
    degrees = {0: 0, 90: 90, -90: 270, -180: 180, -270: 90, 360: 0, 450: 90, 720: 0, 45: None, 225: None, 359.6: None}
    rows = spark.createDataFrame([(float(d), a) for d, a in degrees.items()], "d double, a int").select("a", orientation.from_degrees(F.col("d")).alias("f")).collect()
    assert all(r["a"] == r["f"] for r in rows)
    modes = [([], None), ([90], 90), ([0, 0, 90, 0, 180], 0), ([270] * 3, 270), ([0, 90], 90)]
    rows = spark.createDataFrame(modes, "l array<int>, m int").select("m", orientation.most_common(F.col("l")).alias("f")).collect()
    assert all(r["m"] == r["f"] for r in rows)


@pytest.mark.parametrize(("angles", "expected"), [((0, 180), [0, 0]), ((90, 270), [90, 90]), ((180, 180, 0, 270), [180, 180, 180, 270])])
def test_vote(spark, angles, expected):
    rows = spark.createDataFrame([(1, k, a) for k, a in enumerate(angles)], "page int, ord int, angle int")
    assert [r["angle"] for r in orientation.vote_by_axis(rows, ["page"]).orderBy("ord").collect()] == expected


def test_word_in_two_cells_and_line_in_first_region(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 20, 10), (1, 1, 0, 0, 30, 10), (1, 2, 90, 90, 99, 99)], "page int, ord int, x1 int, y1 int, x2 int, y2 int")
    words = spark.createDataFrame([(1, 0, 5, 0, 15, 10, "w", 1.0, 0.5)], "page int, ord int, x1 int, y1 int, x2 int, y2 int, text string, box_score double, text_score double")
    rows = {r["ord"]: r["text"] for r in matching.words_to_cells(cells, words, ["page"]).collect()}
    assert rows == {0: "w", 1: "w", 2: None}
    boxes = cells.selectExpr("*", "10 AS class_id", "0.25D AS confidence")
    lines = words.selectExpr("*", "cast(null as int) AS angle")
    regions = matching.build_regions(boxes, lines, ["page"]).collect()
    assert [(r["box_ord"], r["content"], r["confidence"], r["angle"]) for r in regions] == [(0, "w", 0.5, None)]


def test_pixels():
    image = np.zeros((10, 10, 3), np.uint8)
    padded = pixels.pad(image, 2, 2, 2, 2)
    assert padded.shape == (14, 14, 3) and padded[0, 0, 0] == 255 and padded[2, 2, 0] == 0
    two = np.array([[[255, 0, 0], [0, 0, 255]]], np.uint8)
    assert (pixels.rotate(two, 180) == two[:, ::-1]).all()
    flat = np.full((2, 2, 3), 100, np.uint8)
    out = pixels.normalise(flat, (50, 50, 50), (2, 2, 2))
    assert out.shape == (1, 3, 2, 2) and (out == 100).all()
    assert pixels.normalise(flat, (50, 25, 0), (1, 2, 0.5))[0, :, 0, 0].tolist() == [50, 150, 50]
    white = np.full((20, 20, 3), 255, np.uint8)
    cropped, tall = pixels.crop(white, [(5, 5), (10, 5), (10, 10), (5, 10)])
    assert cropped.shape == (5, 5, 3) and (cropped == 255).all() and not tall
    with pytest.raises(ValueError):
        pixels.crop(white, [(0, 0), (1, 0), (1, 1)])
    assert pixels.detection_plan(1920, 1000) == {"width": 960, "height": 500, "left": 0, "right": 0, "top": 6, "bottom": 6}
    assert pixels.binary_map(np.eye(5) == 2.0).sum() == 0
    batch, widths = pixels.recognition_batch([np.zeros((24, 30, 3), np.uint8), np.zeros((48, 20, 3), np.uint8)], rtl=True)
    assert batch.shape == (2, 48, 60, 3) and widths == [60, 20] and batch[1, 0, 0, 0] == 127


def _quads(n: int) -> np.ndarray:
    """Slanted rectangles of either turn, and any four points."""
    draw = np.random.default_rng(5)
    slanted = [polygons.smallest_rectangle(draw.integers(0, 60, (4, 2))).astype(int) for _ in range(n)]
    return np.array([*slanted, *(s[::-1] for s in slanted), *draw.integers(0, 60, (n, 4, 2))])


def test_many_rings_at_once_are_those_of_one_box_each():
    quads = _quads(100)
    box, points = polygons.expand_all(quads, 1.6)
    for k, quad in enumerate(quads):
        assert sorted(map(tuple, points[box == k].tolist())) == sorted(map(tuple, polygons.expand(quad, 1.6).tolist()))
    assert (np.diff(box) >= 0).all()
    assert len(polygons.expand_all(np.empty((0, 4, 2)), 1.6)[0]) == 0


def test_many_pairs_at_once_share_what_one_pair_each_does(spark):
    a = _quads(100)
    b = a[np.random.default_rng(6).permutation(len(a))]
    one = np.array([polygons.shared_area(p, q) for p, q in zip(a, b, strict=True)])
    assert np.abs(polygons.shared_areas(a.astype(float), b.astype(float)) - one).max() < 1e-9
    rows = [([(int(x), int(y)) for x, y in p], [(int(x), int(y)) for x, y in q]) for p, q in zip(a[:200], b[:200], strict=True)]
    rows += [(None, rows[0][1]), ([(0, 0), (4, 0), (4, 4)], [(0, 0), (4, 0), (4, 4), (0, 4)])]
    frame = spark.createDataFrame(rows, "a array<struct<x:int,y:int>>, b array<struct<x:int,y:int>>")
    found = [r[0] for r in frame.select(polygons.quad_overlap_udf("a", "b")).collect()]
    assert found[200:] == [None, 1.0]
    assert found[:200] == [polygons.quad_overlap(p, q) for p, q in zip(a[:200], b[:200], strict=True)]


def test_lines_of_cells_are_those_of_their_edges_without_windows(spark):
    rows = [(t, o, *(int(hash((t, o, c)) % 97 - 40) for c in range(4))) for t in range(40) for o in range(t % 9)] + [(50, 0, None, 3, 4, None), (50, 1, 7, None, 30, None), (51, 0, None, None, None, None)]
    cells = spark.createDataFrame(rows, "t int, ord int, x1 int, y1 int, x2 int, y2 int").repartition(3)
    found = grid.cell_lines(cells, ["t"])
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in grid.grid_lines(grid.edges_of(cells, ["t"]), ["t"]).collect()}
    for rows in (found, grid.place_cells(cells, ["t"]), grid.table_shape(cells.select("t").distinct(), cells, ["t"])):
        assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert grid.place_cells(cells, ["t"]).count() == cells.count()
