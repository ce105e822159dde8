"""Integer box geometry as column expressions.

A box is four points (top left, top right, bottom right, bottom left) in an
array of structs; relational operators work on its extent x1, y1, x2, y2.
Everything here stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:int,y:int>"
BOUNDS = f"array<{POINT}>"
BOUNDS_FIELD = "bounds:array<struct<x:int,y:int>>"


def _int(value: Column) -> Column:
    return value.cast("int")


def point(x: Column, y: Column) -> Column:
    return F.struct(_int(x).alias("x"), _int(y).alias("y"))


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The four points of an upright box."""
    return F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2))


def zero_bounds() -> Column:
    return rectangle(*[F.lit(0)] * 4)


def left(bounds: Column) -> Column:
    return F.array_min(F.transform(bounds, lambda p: p["x"]))


def right(bounds: Column) -> Column:
    return F.array_max(F.transform(bounds, lambda p: p["x"]))


def top(bounds: Column) -> Column:
    return F.array_min(F.transform(bounds, lambda p: p["y"]))


def bottom(bounds: Column) -> Column:
    return F.array_max(F.transform(bounds, lambda p: p["y"]))


def extent(bounds: Column, prefix: str = "") -> list[Column]:
    """x1, y1, x2, y2 of a box."""
    return [f(bounds).alias(prefix + n) for f, n in ((left, "x1"), (top, "y1"), (right, "x2"), (bottom, "y2"))]


def span_of(low: Column, high: Column) -> Column:
    """Width or height: 1 at least."""
    return F.greatest(high - low, F.lit(1))


def middle(low: Column, high: Column) -> Column:
    """Centre of two coordinates; halves go towards zero."""
    return F.call_function("div", low + high, F.lit(2)).cast("int")


def valid_bounds(bounds: Column) -> Column:
    return F.coalesce(F.size(bounds) == 4, F.lit(False))


def translated(bounds: Column, dx: Column, dy: Column) -> Column:
    return F.transform(bounds, lambda p: point(p["x"] + dx, p["y"] + dy))


def _area(x1, y1, x2, y2) -> Column:
    return (F.greatest(x2 - x1, F.lit(0)).cast("double")) * F.greatest(y2 - y1, F.lit(0))


def intersection(a: list[Column], b: list[Column]) -> Column:
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(wide, F.lit(0)).cast("double") * F.greatest(high, F.lit(0))


def _ratio(part: Column, whole: Column, valid: Column) -> Column:
    """part / whole in single precision, as the detector's thresholds are."""
    return F.when(valid & (whole > 0), (part / whole).cast("float")).otherwise(F.lit(0.0).cast("float"))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of upright boxes (x1, y1, x2, y2); 0 if one is flat."""
    both = intersection(a, b)
    area_a, area_b = _area(*a), _area(*b)
    return _ratio(both, area_a + area_b - both, (area_a > 0) & (area_b > 0))


def overlap(a: list[Column], b: list[Column]) -> Column:
    """Share of box a that box b covers; 0 if a is flat."""
    return _ratio(intersection(a, b), _area(*a), F.lit(True))


def is_upright(bounds: Column) -> Column:
    """Whether four points are an upright box, from its top left clockwise."""
    x, y = (lambda i: bounds[i]["x"]), (lambda i: bounds[i]["y"])
    return (x(0) == x(3)) & (x(1) == x(2)) & (y(0) == y(1)) & (y(2) == y(3)) & (x(0) <= x(1)) & (y(0) <= y(3))


def quad_overlap(a: str, b: str) -> Column:
    """Share of box a that box b covers, of columns of four points of any convex shape; 0 if a is flat.

    Box a is cut by the four sides of b, one after another; a side keeps what is
    left of it, once b's points go round with a positive area.
    """
    twice = lambda p: f"aggregate(sequence(0, size({p}) - 1), 0D, (s, i) -> s + {p}[i].x * {p}[(i + 1) % size({p})].y - {p}[i].y * {p}[(i + 1) % size({p})].x)"
    points = lambda c: f"transform({c}, p -> named_struct('x', double(p.x), 'y', double(p.y)))"
    side = lambda p: f"((e.r.x - e.q.x) * ({p}.y - e.q.y) - (e.r.y - e.q.y) * ({p}.x - e.q.x))"
    window = f"transform(array({points(b)}), w -> if({twice('w')} < 0, reverse(w), w))[0]"
    sides = f"transform(array({window}), w -> transform(sequence(0, 3), i -> named_struct('q', w[i], 'r', w[(i + 1) % 4])))[0]"
    here, after = "poly[i]", "poly[(i + 1) % size(poly)]"
    share = f"({side(here)} / ({side(here)} - {side(after)}))"
    crossing = f"named_struct('x', {here}.x + ({after}.x - {here}.x) * {share}, 'y', {here}.y + ({after}.y - {here}.y) * {share})"
    kept = f"if({side(here)} >= 0, array({here}), filter(array({here}), x -> false))"
    crossed = f"if(({side(here)} >= 0) <> ({side(after)} >= 0), array({crossing}), filter(array({here}), x -> false))"
    cut = f"if(size(poly) = 0, poly, flatten(transform(sequence(0, size(poly) - 1), i -> concat({kept}, {crossed}))))"
    common = f"aggregate({sides}, {points(a)}, (poly, e) -> {cut})"
    area = f"transform(array({common}), c -> if(size(c) < 3, 0D, abs({twice('c')}) / 2))[0]"
    return F.expr(f"float(transform(array({points(a)}), o -> if({twice('o')} = 0, 0D, {area} / (abs({twice('o')}) / 2)))[0])")


def corner_order(bounds: Column) -> tuple[Column, Column]:
    """(points from the top left clockwise, longest side) of a four-point box.

    Points are sorted by x, then y; of each half the one further up comes first.
    The longest side is of the first two sides as given.
    """
    side = lambda i: F.sqrt(F.pow(bounds[i + 1]["x"] - bounds[i]["x"], F.lit(2)) + F.pow(bounds[i + 1]["y"] - bounds[i]["y"], F.lit(2)))
    s = F.array_sort(bounds)
    low_left, low_right = s[1]["y"] > s[0]["y"], s[3]["y"] > s[2]["y"]
    ordered = F.array(
        F.when(low_left, s[0]).otherwise(s[1]),
        F.when(low_right, s[2]).otherwise(s[3]),
        F.when(low_right, s[3]).otherwise(s[2]),
        F.when(low_left, s[1]).otherwise(s[0]),
    )
    return ordered, F.greatest(side(0), side(1)).cast("float")


def polygon_area(bounds: Column) -> Column:
    """Absolute shoelace area of four points."""
    terms = [bounds[i]["x"] * bounds[(i + 1) % 4]["y"] - bounds[i]["y"] * bounds[(i + 1) % 4]["x"] for i in range(4)]
    return F.abs(sum(terms[1:], terms[0]).cast("double") / 2)


def perimeter(bounds: Column) -> Column:
    sides = [F.sqrt(F.pow(bounds[i]["x"] - bounds[(i + 1) % 4]["x"], F.lit(2)) + F.pow(bounds[i]["y"] - bounds[(i + 1) % 4]["y"], F.lit(2))) for i in range(4)]
    return sum(sides[1:], sides[0])


def expansion_distance(bounds: Column, ratio: float) -> Column:
    """How far a text box is pushed outwards: area times ratio by perimeter."""
    return polygon_area(bounds) * F.lit(float(ratio)) / perimeter(bounds)


def unpadded(value: Column, pad_before: Column, pad_after: Column, padded: Column, predicted: Column, source: Column) -> Column:
    """A map coordinate in source pixels: scaled, padding removed, clamped, truncated."""
    scaled = value.cast("double") * (padded.cast("double") / predicted) - pad_before
    content = (padded - pad_before - pad_after).cast("double")
    original = F.when(content > 1e-6, scaled * (source.cast("double") / content)).otherwise(F.lit(0.0))
    limit = F.greatest(source - 1, F.lit(0)).cast("double")
    return F.when(predicted < 1, F.lit(0)).otherwise(F.least(F.greatest(original, F.lit(0.0)), limit)).cast("int")


def rounded(value: Column, scale: Column) -> Column:
    """value * scale, halves away from zero."""
    return F.round(value * scale, 0).cast("int")


def along(start: Column, stop: Column, ratio: Column) -> Column:
    """The place at a ratio between two; the product is single precision, a whole number times a float would not be."""
    return start + ((stop - start).cast("float") * ratio.cast("float")).cast("int")


def word_box(line: Column, start: Column, end: Column, frames: Column, rtl: Column) -> Column:
    """Box of the word in frames start..end of a line's ``frames``; mirrored if rtl.

    Ratios are single precision, as frame positions are in the recogniser.
    """
    one = F.lit(1.0).cast("float")
    begin = (start.cast("double") / frames).cast("float")
    stop = ((end + 1).cast("double") / frames).cast("float")
    a, b = F.when(rtl, one - stop).otherwise(begin), F.when(rtl, one - begin).otherwise(stop)
    at = lambda p, q, r: point(along(line[p]["x"], line[q]["x"], r), along(line[p]["y"], line[q]["y"], r))
    return F.array(at(0, 1, a), at(0, 1, b), at(3, 2, b), at(3, 2, a))


def is_vertical(width: Column, height: Column) -> Column:
    return height >= width * 1.5


def comes_before(a: dict[str, Column], b: dict[str, Column], rtl: Column) -> Column:
    """Whether box a is read before box b, both given as x1, y1, x2, y2.

    Both directions can hold at once; reading order resolves that. The mean of two
    heights is a whole number, as is a quarter of it: halves go towards zero.
    """
    height = F.call_function("div", span_of(a["y1"], a["y2"]) + span_of(b["y1"], b["y2"]), F.lit(2)).cast("int")
    quarter = F.call_function("div", height, F.lit(4)).cast("int")
    below = middle(b["y1"], b["y2"]) - middle(a["y1"], a["y2"])
    ax, bx = middle(a["x1"], a["x2"]), middle(b["x1"], b["x2"])
    ltr = (ax < bx) & (a["x2"] <= b["x1"] + quarter)
    mirrored = (ax > bx) & (a["x1"] >= b["x2"] - quarter)
    beside = F.abs(below) <= (height * 0.5).cast("int")
    return (below > (height * 0.3).cast("int")) | (beside & F.when(rtl, mirrored).otherwise(ltr))
