"""Score maps and pixel lists as column expressions: arrays of values by rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(values: Column, means: tuple[float, ...], scales: tuple[float, ...]) -> Column:
    """value * scale - mean * scale of interleaved channels, in single precision."""
    one = lambda v: F.lit(float(v)).cast("float")
    n = len(means)

    def channel(i: Column, of: tuple[float, ...]) -> Column:
        return F.element_at(F.array(*map(one, of)), (i % n + 1).cast("int"))

    shifts = tuple(m * s for m, s in zip(means, scales, strict=True))
    return F.transform(values, lambda v, i: v.cast("float") * channel(i, scales) - channel(i, shifts))


def lit_nearby(values: Column, width: int, threshold: float) -> Column:
    """For each value of a map whether it or one of its eight neighbours is over the threshold."""
    n = F.size(values)

    def near(i: Column) -> Column:
        steps = F.array(*(F.struct(F.lit(dx).alias("x"), F.lit(dy * width + dx).alias("step")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
        there = lambda s: (i + s["step"] >= 0) & (i + s["step"] < n) & (i % width + s["x"]).between(0, width - 1)
        return F.exists(steps, lambda s: there(s) & (F.get(values, i + s["step"]) > F.lit(threshold).cast("float")))

    return F.transform(F.sequence(F.lit(0), n - 1), near)


def mean_inside(values: Column, width: int, corners: Column) -> Column:
    """Mean of the values whose pixels lie in or on a convex polygon of points (x, y); 0 without any."""

    def sides(points: Column) -> Column:
        """Each side as its first point and its run, the points in the order that turns to the right on a map."""
        n = F.size(points)
        after = lambda k: points[(k + 1) % n]
        places = F.sequence(F.lit(0), n - 1)
        twice = F.aggregate(places, F.lit(0.0), lambda s, k: s + points[k]["x"].cast("double") * after(k)["y"] - points[k]["y"].cast("double") * after(k)["x"])
        turn = F.signum(twice)
        run = lambda k, c: (after(k)[c] - points[k][c]) * turn
        return F.transform(places, lambda k: F.struct(points[k]["x"].alias("x"), points[k]["y"].alias("y"), run(k, "x").alias("dx"), run(k, "y").alias("dy")))

    def mean(found: Column) -> Column:
        def within(i: Column) -> Column:
            x, y = i % width, F.call_function("div", i, F.lit(width))
            return F.forall(found, lambda s: s["dx"] * (y - s["y"]) - s["dy"] * (x - s["x"]) >= 0)

        inside = F.filter(F.transform(values, lambda v, i: F.struct(v.alias("v"), within(i).alias("in"))), lambda p: p["in"])
        total = F.aggregate(inside, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, p: F.struct((a["s"] + p["v"]).alias("s"), (a["n"] + 1).alias("n")))
        return F.transform(F.array(total), lambda t: F.when(t["n"] > 0, t["s"] / t["n"]).otherwise(F.lit(0.0)))[0]

    # what stands in a one-element array is computed once
    return F.transform(F.transform(F.array(corners), sides), mean)[0]
