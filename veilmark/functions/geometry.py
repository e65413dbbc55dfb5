"""Boxes as expressions: overlap measures and the canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 100000.0


def area(b: Column) -> Column:
    return b["width"] * b["height"]


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without area."""
    i = intersection(a, b)
    union = area(a) + area(b) - i
    return F.when((area(a) > 0) & (area(b) > 0) & (union > 0), i / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 without area."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(F.lit(0.0))


def contains(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["x"], b["x"] + b["width"]) & y.between(b["y"], b["y"] + b["height"])


def _number(v: Column, low: float) -> Column:
    whole = F.floor(v + 0.5)
    return F.when(v.isNull() | F.isnan(v), F.lit(low)).otherwise(F.greatest(F.lit(low), F.least(F.lit(LIMIT), whole.cast("double"))))


def canonical(b: Column) -> Column:
    """Whole numbers within [0, limit], sides of at least 1; what is no number becomes the lower bound."""
    # NaN sorts above every number
    inf = lambda v: F.when(F.isnan(v), v).when(v > LIMIT, LIMIT).when(v < -LIMIT, -LIMIT).otherwise(v)
    return F.struct(
        _number(inf(b["x"]), 0.0).alias("x"), _number(inf(b["y"]), 0.0).alias("y"), _number(inf(b["width"]), 1.0).alias("width"), _number(inf(b["height"]), 1.0).alias("height")
    )


def confidence(c: Column) -> Column:
    """Within [0, 1]; 0.5 for what is no finite number."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) > 1e300), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
