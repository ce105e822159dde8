"""Orientations: from degrees, the most common one, votes by axis, from scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANGLES = (0, 90, 180, 270)


def from_degrees(degrees: Column) -> Column:
    """0, 90, 180 or 270 if the angle rounds to it within [0, 360); else null."""
    turned = F.round(F.pmod(degrees.cast("double"), F.lit(360.0))).cast("int")
    return F.when(turned.isin(*ANGLES), turned)


def most_common(angles: Column) -> Column:
    """Mode of an array of angles, the larger on a tie; null if empty."""
    counted = F.array(*(F.struct((F.size(angles) - F.size(F.array_remove(angles, k))).alias("n"), F.lit(k).alias("a")) for k in ANGLES))
    best = F.array_max(counted)
    return F.when(best["n"] > 0, best["a"])


def dominant(rows: DataFrame, keys: list[str], angle: str = "angle") -> DataFrame:
    """(keys, orientation): the mode of each group, the larger angle on a tie."""
    counts = rows.where(F.col(angle).isin(*ANGLES)).groupBy(*keys, angle).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.max_by(angle, F.struct("_n", angle)).alias("orientation"))


def vote_by_axis(rows: DataFrame, keys: list[str], angle: str = "angle") -> DataFrame:
    """Every row's angle becomes the winner of its axis in the group; ties go to 0 and 90."""
    group = Window.partitionBy(*keys)
    n = {k: F.sum((F.col(angle) == k).cast("int")).over(group) for k in ANGLES}
    level = F.when(n[0] >= n[180], 0).otherwise(180)
    upright = F.when(n[90] >= n[270], 90).otherwise(270)
    return rows.withColumn(angle, F.when(F.col(angle).isin(0, 180), level).when(F.col(angle).isin(90, 270), upright))


def last_maximum(scores: Column) -> Column:
    """Index of the largest score, the last of several."""
    return F.size(scores) - F.array_position(F.reverse(scores), F.array_max(scores)).cast("int")


def document_orientation(scores: Column) -> Column:
    """Angle from four scores (0, 90, 180, 270)."""
    return F.element_at(F.array(*map(F.lit, ANGLES)), last_maximum(scores) + 1)


def line_orientation(scores: Column, vertical: Column) -> Column:
    """Angle from two scores; upright lines are 90 or 270. A tie counts as turned."""
    return F.when(scores[0] > scores[1], F.when(vertical, 90).otherwise(0)).otherwise(F.when(vertical, 270).otherwise(180))


def table_type(scores: Column) -> Column:
    return F.when(scores[0] > scores[1], "Wired").otherwise("Wireless")
