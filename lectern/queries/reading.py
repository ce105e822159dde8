"""Orientations, reading order, offsets, recognition and pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import geometry as g
from lectern.functions import contours, maps, pixels
from lectern.operators import orientation, reading_order, recognition
from lectern.plans import pages
from lectern.queries.base import LINES, PAGE_BOXES, items, lines, page_boxes, query
from lectern.sources import pdf_files
from lectern.sources.tables import dictionary_of, table


@query(f"""WITH {LINES} SELECT page, max_by(angle, {{'n': n, 'a': angle}}) AS orientation FROM (SELECT page, angle, count(*) AS n FROM lines WHERE angle IS NOT NULL GROUP BY page, angle) GROUP BY page""")
def dominant_orientation(spark, sf_dir):
    return orientation.dominant(lines(spark, sf_dir), ["page"])


@query(f"""WITH {LINES}, votes AS (SELECT page, count(*) FILTER (angle = 0) AS a, count(*) FILTER (angle = 90) AS b, count(*) FILTER (angle = 180) AS c, count(*) FILTER (angle = 270) AS d FROM lines GROUP BY page)
SELECT page, ord, CASE WHEN angle IN (0, 180) THEN CASE WHEN a >= c THEN 0 ELSE 180 END WHEN angle IN (90, 270) THEN CASE WHEN b >= d THEN 90 ELSE 270 END END AS angle FROM lines JOIN votes USING (page)""")
def orientation_vote(spark, sf_dir):
    return orientation.vote_by_axis(lines(spark, sf_dir), ["page"]).select("page", "ord", "angle")


_DEGREES = "(l_partkey % 25) * 45 - 450 + (l_suppkey % 3) * 0.3"


@query(f"""WITH d AS (SELECT l_orderkey AS page, l_partkey AS part, l_suppkey AS supplier, {_DEGREES}::DOUBLE AS degrees FROM lineitem), r AS (SELECT *, round(degrees - 360 * floor(degrees / 360))::INT AS a FROM d)
SELECT page, part, supplier, CASE WHEN a IN (0, 90, 180, 270) THEN a END AS angle FROM r""")
def orientation_from_degrees(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.expr(f"double({_DEGREES})").alias("degrees"))
    return rows.select("page", "part", "supplier", orientation.from_degrees(F.col("degrees")).alias("angle"))


_ROWS = "n AS ord, (l_partkey % 300)::INT AS x1, 40 * (n // 2) AS y1, (l_partkey % 300 + 30 + l_suppkey % 40)::INT AS x2, 40 * (n // 2) + 20 AS y2"
_LI = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS n FROM lineitem)"


def _aligned(spark, sf_dir):
    return items(spark, sf_dir).select(
        F.col("l_orderkey").alias("page"), F.col("n").alias("ord"), F.expr("int(l_partkey % 300)").alias("x1"), F.expr("int(40 * (n div 2))").alias("y1"),
        F.expr("int(l_partkey % 300 + 30 + l_suppkey % 40)").alias("x2"), F.expr("int(40 * (n div 2) + 20)").alias("y2"),
    )


def _order_sql(sign: str) -> str:
    return f"""WITH b AS (SELECT l_orderkey AS page, {_ROWS} FROM {_LI})
SELECT page, ord, (row_number() OVER (PARTITION BY page ORDER BY (y1 + y2) // 2, {sign}((x1 + x2) // 2), ord) - 1)::INT AS position FROM b"""


@query(_order_sql(""))
def reading_order_rows(spark, sf_dir):
    return reading_order.read_pages(_aligned(spark, sf_dir), ["page"]).select("page", "ord", "position")


@query(_order_sql("-"))
def reading_order_rows_rtl(spark, sf_dir):
    return reading_order.read_pages(_aligned(spark, sf_dir), ["page"], rtl=True).select("page", "ord", "position")


@query(f"""WITH {PAGE_BOXES} SELECT page, ord, (row_number() OVER (PARTITION BY page ORDER BY (y1 + y2) // 2, (x1 + x2) // 2, ord) - 1)::INT AS position FROM page_boxes""")
def plain_order(spark, sf_dir):
    return reading_order.plain_order(page_boxes(spark, sf_dir), ["page"]).select("page", "ord", F.col("position").cast("int").alias("position"))


@query(f"""WITH RECURSIVE {PAGE_BOXES}, b AS (
  SELECT *, (y1 + y2) // 2 AS cy, (x1 + x2) // 2 AS cx, greatest(y2 - y1, 1) AS h, row_number() OVER (PARTITION BY page ORDER BY (y1 + y2) // 2, ord) AS place,
         row_number() OVER (PARTITION BY page ORDER BY (y1 + y2) // 2, (x1 + x2) // 2, ord) AS k, max(greatest(y2 - y1, 1)) OVER (PARTITION BY page) AS tallest FROM page_boxes
), near AS (
  SELECT a.*, (SELECT count(*) FROM b o WHERE o.page = a.page AND o.cy <= a.cy + a.tallest) AS last_near FROM b a
), pairs AS (
  SELECT a.page, a.k AS a, c.k AS c, (a.h + c.h) // 2 AS h, c.cy - a.cy AS below, a.cx AS ax, c.cx AS cx, a.x2 AS a_right, c.x1 AS c_left,
         greatest(a.place, c.place) <= least(a.last_near, c.last_near) AS is_near, c.place = a.last_near + 1 AS is_next
  FROM near a JOIN near c ON a.page = c.page AND a.k <> c.k
), edges AS (
  SELECT page, a, c FROM pairs WHERE is_next OR (is_near AND (below > trunc(h * 0.3::DOUBLE) OR (abs(below) <= trunc(h * 0.5::DOUBLE) AND ax < cx AND a_right <= c_left + h // 4)))
), nodes AS (
  SELECT page, list(coalesce(held, []::BIGINT[]) ORDER BY k) AS held FROM b LEFT JOIN (SELECT page, c AS k, list(a) AS held FROM edges GROUP BY page, c) USING (page, k) GROUP BY page
), reading AS (
  SELECT page, held, []::BIGINT[] AS done FROM nodes
  UNION ALL
  SELECT page, held, list_append(done, pick) FROM (
    SELECT page, held, done, list_filter(range(1, len(held) + 1), lambda i: NOT list_contains(done, i) AND list_has_all(done, held[i]))[1] AS pick FROM reading) WHERE pick IS NOT NULL
), read_all AS (
  SELECT page, list_concat(done, list_filter(range(1, len(held) + 1), lambda i: NOT list_contains(done, i))) AS done FROM (SELECT page, max_by(held, len(done)) AS held, max_by(done, len(done)) AS done FROM reading GROUP BY page)
), placed AS (SELECT page, unnest(done) AS k, (generate_subscripts(done, 1) - 1)::INT AS position FROM read_all)
SELECT page, ord, position FROM placed JOIN b USING (page, k)""")
def reading_order_pages(spark, sf_dir):
    """Overlapping boxes, where no sort gives the order."""
    return reading_order.read_pages(page_boxes(spark, sf_dir), ["page"]).select("page", "ord", "position")


def text_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "text"))


_TEXT_LINES = "text_lines AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS position, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def _spans_sql(extra: str) -> str:
    return f"""WITH {_TEXT_LINES} SELECT doc_id, position, coalesce(sum(strlen(text){extra}) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", strlen(text)::BIGINT AS length FROM text_lines"""


@query(_spans_sql(" + 1"))
def line_spans_embedded(spark, sf_dir):
    return reading_order.spans_embedded(text_lines(spark, sf_dir), ["doc_id"]).drop("text")


@query(_spans_sql(""))
def line_spans_recognised(spark, sf_dir):
    return reading_order.spans_recognised(text_lines(spark, sf_dir), ["doc_id"]).drop("text")


@query(f"""WITH {_TEXT_LINES}, kept AS (SELECT *, max(CASE WHEN text <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position) AS begun FROM text_lines)
SELECT d.doc_id, coalesce(string_agg(k.text, chr(10) ORDER BY k.position), 'old') AS text FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id AND k.begun = 1 GROUP BY d.doc_id""")
def page_text_from_lines(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit("old").alias("text"))
    return reading_order.page_text(text_lines(spark, sf_dir), pages, ["doc_id"])


def frames(spark, sf_dir):
    """(line, t, scores): each vector as 8 frames of 8 class scores."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("t"), "embedding")
    return rows.select("line", "t", F.slice("embedding", F.col("t") * 8 + 1, 8).alias("scores"))


_FRAMES = """scored AS (
  SELECT vec_id AS line, t::INT AS t, list_max(embedding[t * 8 + 1 : t * 8 + 8]) AS score, embedding[t * 8 + 1 : t * 8 + 8] AS s FROM embeddings, range(8) r(t)
), best AS (
  SELECT line, t, score, (8 - list_position(list_reverse(s), score))::INT AS best FROM scored
), kept AS (
  SELECT *, coalesce(best <> lag(best) OVER (PARTITION BY line ORDER BY t), true) AND best > 0 AND best < 7 AS kept FROM best
), chars AS (
  SELECT line, t, score, best, CASE best WHEN 6 THEN ' ' ELSE chr(96 + best) END AS c FROM kept WHERE kept)"""
_LETTERS = ["a", "b", "c", "d", "e"]


@query(f"WITH {_FRAMES} SELECT line, t, best, kept FROM kept")
def argmax_class(spark, sf_dir):
    return recognition.frame_classes(frames(spark, sf_dir), ["line"], 7).select("line", "t", "best", "kept")


@query(f"""WITH {_FRAMES} SELECT e.vec_id AS line, coalesce(string_agg(c, '' ORDER BY t), '') AS text, round(coalesce(avg(score::DOUBLE), 0), 5) AS text_score
FROM embeddings e LEFT JOIN chars ON vec_id = line GROUP BY e.vec_id""")
def ctc_decode_lines(spark, sf_dir):
    rows = recognition.decode_lines(frames(spark, sf_dir), dictionary_of(spark, _LETTERS), ["line"], 7)
    return rows.select("line", "text", F.round("text_score", 5).alias("text_score"))


@query(f"""WITH {_FRAMES}, worded AS (
  SELECT *, sum(CASE WHEN c = ' ' THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY t) AS word, row_number() OVER (PARTITION BY line ORDER BY t) - 1 AS "offset" FROM chars
), ends AS (SELECT line, word - 1 AS word, t - 1 AS e FROM worded WHERE c = ' ')
SELECT w.line, w.word::INT AS word, string_agg(c, '' ORDER BY t) AS text, round(avg(score::DOUBLE), 5) AS score, min(t) AS "start", coalesce(min(e), 7)::INT AS "end", min("offset")::BIGINT AS "offset"
FROM worded w LEFT JOIN ends USING (line, word) WHERE c <> ' ' GROUP BY w.line, w.word""")
def ctc_words(spark, sf_dir):
    rows = recognition.decode_words(frames(spark, sf_dir), dictionary_of(spark, _LETTERS), ["line"], 7)
    return rows.withColumn("score", F.round("score", 5))


def _line_boxes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line"), F.expr("int(vec_id % 50)").alias("x1"), F.expr("int(vec_id % 30)").alias("y1"))
    return rows.withColumn("bounds", g.rectangle(F.col("x1"), F.col("y1"), F.col("x1") + 160, F.col("y1") + 24)).withColumn("n_frames", F.lit(8))


@query(f"""WITH {_FRAMES}, worded AS (SELECT *, sum(CASE WHEN c = ' ' THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY t) AS word FROM chars), ends AS (SELECT line, word - 1 AS word, t - 1 AS e FROM worded WHERE c = ' '),
words AS (SELECT w.line, w.word::INT AS word, min(t) AS s, coalesce(min(e), 7)::INT AS e FROM worded w LEFT JOIN ends USING (line, word) WHERE c <> ' ' GROUP BY w.line, w.word)
SELECT line, word, (line % 50)::INT + trunc(160 * (s / 8.0))::INT AS x1, (line % 50)::INT + trunc(160 * ((e + 1) / 8.0))::INT AS x2, (line % 30)::INT AS y1, (line % 30 + 24)::INT AS y2 FROM words""")
def word_boxes(spark, sf_dir):
    words = recognition.decode_words(frames(spark, sf_dir), dictionary_of(spark, _LETTERS), ["line"], 7)
    rows = recognition.place_words(words, _line_boxes(spark, sf_dir), ["line"])
    b = F.col("bounds")
    return rows.select("line", "word", g.left(b).alias("x1"), g.right(b).alias("x2"), g.top(b).alias("y1"), g.bottom(b).alias("y2"))


@query("""SELECT vec_id, (4 - list_position(list_reverse(embedding[1:4]), list_max(embedding[1:4])))::INT * 90 AS page_angle,
  CASE WHEN embedding[5] > embedding[6] THEN CASE WHEN vec_id % 2 = 0 THEN 90 ELSE 0 END ELSE CASE WHEN vec_id % 2 = 0 THEN 270 ELSE 180 END END AS line_angle,
  CASE WHEN embedding[7] > embedding[8] THEN 'Wired' ELSE 'Wireless' END AS table_type FROM embeddings""")
def classifier_choices(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", orientation.document_orientation(F.slice(e, 1, 4)).alias("page_angle"), orientation.line_orientation(F.slice(e, 5, 2), F.col("vec_id") % 2 == 0).alias("line_angle"),
        orientation.table_type(F.slice(e, 7, 2)).alias("table_type"),
    )


@query("""WITH p AS (SELECT vec_id, i::INT AS i, abs(trunc(embedding[i + 1] * 100))::INT % 256 AS v FROM embeddings, range(12) r(i))
SELECT vec_id, i, round(v * n - m * n, 4) AS value FROM (SELECT *, CASE i % 3 WHEN 0 THEN 50 WHEN 1 THEN 25 ELSE 0 END AS m, CASE i % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 0.5 END::DOUBLE AS n FROM p)""")
def normalize_pixels(spark, sf_dir):
    """Four RGB pixels of each vector, as the models get them."""
    raw = F.transform(F.slice("embedding", 1, 12), lambda x: F.abs((x * 100).cast("int")) % 256)
    scaled = maps.normalised(raw, (50, 25, 0), (1, 2, 0.5))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(scaled).alias("i", "value"))
    return rows.select("vec_id", "i", F.round(F.col("value").cast("double"), 4).alias("value"))


@query("""WITH p AS (SELECT vec_id, (i // 8)::INT AS y, (i % 8)::INT AS x, embedding[i + 1] > 0.3::FLOAT AS o FROM embeddings, range(64) r(i))
SELECT a.vec_id, a.y, a.x, bool_or(b.o) AS lit FROM p a JOIN p b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.vec_id, a.y, a.x""")
def binarize_map(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(maps.lit_nearby(F.col("embedding"), 8, 0.3)).alias("i", "lit"))
    return rows.select("vec_id", F.expr("int(i div 8)").alias("y"), F.expr("int(i % 8)").alias("x"), "lit")


@query("""WITH s AS (SELECT l_orderkey AS page, l_partkey AS part, (200 + l_partkey % 3000)::INT AS w, (100 + l_suppkey % 90 * 20)::INT AS h FROM lineitem),
r AS (SELECT *, CASE WHEN greatest(w, h) < 960 THEN 1::FLOAT ELSE 960::FLOAT / greatest(w, h)::FLOAT END AS k FROM s), z AS (SELECT *, trunc(w::FLOAT * k)::INT AS rw, trunc(h::FLOAT * k)::INT AS rh FROM r)
SELECT page, part, w, h, rw, rh, ((32 - rw % 32) % 32 // 2)::INT AS pad_left, ((32 - rh % 32) % 32 // 2)::INT AS pad_top FROM z""")
def detection_plans(spark, sf_dir):
    """Sizes of pages as the text detector gets them."""
    one = lambda c: F.col(c).cast("float")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("part"), F.expr("int(200 + l_partkey % 3000)").alias("w"), F.expr("int(100 + l_suppkey % 90 * 20)").alias("h"))
    side = F.greatest("w", "h")
    ratio = F.when(side < pixels.LONGEST, F.lit(1.0).cast("float")).otherwise((F.lit(float(pixels.LONGEST)).cast("float") / side.cast("float")).cast("float"))
    rows = rows.withColumn("k", ratio).withColumns({"rw": (one("w") * F.col("k")).cast("float").cast("int"), "rh": (one("h") * F.col("k")).cast("float").cast("int")})
    half = lambda c: F.expr(f"int(((32 - {c} % 32) % 32) div 2)")
    return rows.select("page", "part", "w", "h", "rw", "rh", half("rw").alias("pad_left"), half("rh").alias("pad_top"))


@query("""WITH c AS (SELECT conv_id, turn, i::INT AS ord, text[i + 1] AS ch, ((i * 6) % 480)::FLOAT AS l FROM (SELECT *, unnest(range(length(text))) AS i FROM conversations WHERE text IS NOT NULL)
), r AS (SELECT *, ch IN (' ', chr(9), chr(10), chr(13)) AS blank, sum(CASE WHEN ch IN (' ', chr(9), chr(10), chr(13)) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY ord) AS run FROM c
), w AS (SELECT conv_id, turn, run, string_agg(ch, '' ORDER BY ord) AS text, min(l)::INT AS "left", max(l + 5)::INT AS "right" FROM r WHERE NOT blank GROUP BY conv_id, turn, run
), o AS (SELECT *, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY conv_id, turn ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM w
), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, text, "left", "right" ORDER BY run) AS n FROM o)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY run) - 1)::INT AS word, text, trunc("left" * (300::FLOAT / 72))::INT AS x1, trunc("right" * (300::FLOAT / 72))::INT AS x2, trunc((792 - 110) * (300::FLOAT / 72))::INT AS y1, "offset" FROM f WHERE n = 1""")
def pdf_words(spark, sf_dir):
    """Words from characters with boxes: every turn of a conversation as a page."""
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.posexplode(F.split("text", "")).alias("ord", "ch")).where("ch != ''")
    left = ((F.col("ord") * 6) % 480).cast("float")
    chars = rows.select("conv_id", "turn", "ord", "ch", left.alias("left"), F.lit(100.0).cast("float").alias("bottom"), (left + 5).alias("right"), F.lit(110.0).cast("float").alias("top"))
    words = pdf_files.to_pixels(pdf_files.words_of(chars, ["conv_id", "turn"]).withColumn("height", F.lit(792.0)))
    return words.select("conv_id", "turn", "word", "text", "x1", "x2", "y1", "offset")


@query("""SELECT l_orderkey AS doc_id, 1 AS page_number, max_by(a, {'n': n, 'a': a})::INT AS orientation FROM (
  SELECT l_orderkey, (l_partkey % 5 * 90) % 360 AS a, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""")
def pdf_orientations(spark, sf_dir):
    """The main rotation of pages whose text objects have these degrees."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(((F.col("l_partkey") % 5) * 90).cast("float")).alias("rotations"))
    return pdf_files.page_orientations(rows.withColumn("page_number", F.lit(1)))


def _widths(spark, sf_dir):
    """Lines in batches of ten, of widths from 10 to 159, left to right or right to left."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("line"), F.expr("int(vec_id div 10)").alias("page"), F.expr("int(10 + vec_id * 37 % 150)").alias("width"), F.lit(8).alias("n_frames"), (F.col("vec_id") % 20 >= 10).alias("rtl"),
        F.expr("int(vec_id % 50)").alias("x1"), F.expr("int(vec_id % 30)").alias("y1"),
    )
    rows = rows.withColumn("bounds", g.rectangle(F.col("x1"), F.col("y1"), F.col("x1") + F.col("width"), F.col("y1") + 24))
    return recognition.with_frames_read(rows, ["page"])


_SHARES = """widths AS (
  SELECT vec_id AS line, vec_id // 10 AS page, (10 + vec_id * 37 % 150)::INT AS width, vec_id % 20 >= 10 AS rtl, (vec_id % 50)::INT AS box_x, (vec_id % 30)::INT AS box_y FROM embeddings
), shares AS (
  SELECT *, ceil(8::FLOAT * (width::DOUBLE / max(width) OVER (PARTITION BY page))::FLOAT)::INT AS frames_read FROM widths
), scored AS (
  SELECT vec_id AS line, t::INT AS t, frames_read, embedding[t * 8 + 1 : t * 8 + CASE WHEN t = 7 THEN 7 ELSE 8 END] AS s FROM embeddings JOIN shares ON vec_id = line, range(8) r(t) WHERE t < frames_read
), best AS (
  SELECT line, t, frames_read, list_max(s) AS score, (len(s) - list_position(list_reverse(s), list_max(s)))::INT AS best FROM scored
), kept AS (
  SELECT *, coalesce(best <> lag(best) OVER (PARTITION BY line ORDER BY t), true) AND best > 0 AND best < 8 AS kept FROM best
), chars AS (
  SELECT line, t, frames_read, score, best, CASE best WHEN 7 THEN ' ' ELSE chr(96 + best) END AS c FROM kept WHERE kept)"""
_SIX = [*_LETTERS, "f"]


@query(f"""WITH {_SHARES} SELECT s.line, s.frames_read, coalesce(string_agg(c, '' ORDER BY t), '') AS text, round(coalesce(avg(score::DOUBLE), 0), 5) AS text_score
FROM shares s LEFT JOIN chars USING (line) GROUP BY s.line, s.frames_read""")
def frames_read_lines(spark, sf_dir):
    """Lines of batches read as far as their share of the widest line goes; the widest lose the last frame's space."""
    lines_ = _widths(spark, sf_dir)
    rows = recognition.decode_lines(recognition.frames_within(frames(spark, sf_dir), lines_, ["line"]), dictionary_of(spark, _SIX), ["line"], 8)
    return rows.join(lines_.select("line", "frames_read"), "line").select("line", "frames_read", "text", F.round("text_score", 5).alias("text_score"))


@query(f"""WITH {_SHARES}, worded AS (SELECT *, sum(CASE WHEN c = ' ' THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY t) AS word FROM chars), ends AS (SELECT line, word - 1 AS word, t - 1 AS e FROM worded WHERE c = ' '),
words AS (SELECT w.line, w.word::INT AS word, string_agg(c, '' ORDER BY t) AS text, min(t) AS s, coalesce(min(e), max(w.frames_read) - 1)::INT AS e, max(w.frames_read) AS n FROM worded w LEFT JOIN ends USING (line, word) WHERE c <> ' ' GROUP BY w.line, w.word),
placed AS (SELECT w.*, b.width, b.rtl, b.box_x, b.box_y, (s::DOUBLE / n)::FLOAT AS a, ((e + 1)::DOUBLE / n)::FLOAT AS z FROM words w JOIN widths b ON w.line = b.line)
SELECT line, word, text, box_x + trunc(width * CASE WHEN rtl THEN 1::FLOAT - z ELSE a END)::INT AS x1, box_x + trunc(width * CASE WHEN rtl THEN 1::FLOAT - a ELSE z END)::INT AS x2, box_y AS y1, box_y + 24 AS y2 FROM placed""")
def word_boxes_of_both_directions(spark, sf_dir):
    """Words of lines that run from the left or the right, cut from the lines' boxes by the frames that were read."""
    lines_ = _widths(spark, sf_dir)
    words = recognition.decode_words(recognition.frames_within(frames(spark, sf_dir), lines_, ["line"]), dictionary_of(spark, _SIX), ["line"], 8)
    rows = words.join(lines_.select("line", "bounds", "frames_read", "rtl"), "line")
    b = g.word_box(F.col("bounds"), F.col("start"), F.col("end"), F.col("frames_read"), F.col("rtl"))
    return rows.withColumn("b", b).select("line", "word", "text", g.left(F.col("b")).alias("x1"), g.right(F.col("b")).alias("x2"), g.top(F.col("b")).alias("y1"), g.bottom(F.col("b")).alias("y2"))


@query("""WITH RECURSIVE grid AS (
  SELECT vec_id, p::INT AS p, coalesce(p // 10 BETWEEN 1 AND 8 AND p % 10 BETWEEN 1 AND 8 AND embedding[(p // 10 - 1) * 8 + p % 10] > 0.05::FLOAT, false) AS lit FROM embeddings, range(100) r(p)
), reached AS (
  SELECT vec_id, lit, p AS first, p AS p FROM grid
  UNION
  SELECT r.vec_id, r.lit, r.first, n.p FROM reached r JOIN grid n ON n.vec_id = r.vec_id AND n.lit = r.lit AND (abs(n.p - r.p) IN (1, 10) OR (r.lit AND abs(n.p - r.p) IN (9, 11)))
), areas AS (
  SELECT vec_id, lit, p, min(first) AS area FROM reached GROUP BY vec_id, lit, p
), meets AS (
  SELECT DISTINCT a.vec_id, a.area AS inside, b.area AS around, (a.p // 10 - 1) * 8 + a.p % 10 - 1 AS pixel FROM areas a JOIN areas b ON a.vec_id = b.vec_id AND a.lit AND NOT b.lit AND abs(a.p - b.p) IN (1, 10)
), found AS (
  SELECT vec_id, around > inside AS hole, CASE WHEN around > inside THEN around % 10 - 2 ELSE inside % 10 - 1 END AS start_x, CASE WHEN around > inside THEN around // 10 - 1 ELSE inside // 10 - 1 END AS start_y,
         count(*)::INT AS n_pixels, string_agg(pixel::VARCHAR, ',' ORDER BY pixel) AS pixels FROM meets GROUP BY vec_id, inside, around)
SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY start_y, start_x) - 1)::INT AS contour, hole, start_x, start_y, n_pixels, pixels FROM found""")
def map_contours(spark, sf_dir):
    """Borders of lit areas and of their holes, of each vector as a map of 8 x 8."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("width"), F.transform("embedding", lambda v: v > F.lit(0.05).cast("float")).alias("lit"))
    return contours.map_contours(rows, ["vec_id"], pages.MAX_CONTOURS).withColumn("pixels", F.array_join("pixels", ","))
