"""Column expressions on boxes, pitch metres and the tagger's grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tactigrid import config as c


def foot(x1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Where a box stands: the middle of its lower edge."""
    return (x1 + x2) / 2, y2


def centre(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def metres_to_grid(x: Column, y: Column) -> tuple[Column, Column]:
    return x / c.LENGTH * c.GRID_X, y / c.WIDTH * c.GRID_Y


def grid_to_metres(x: Column, y: Column) -> tuple[Column, Column]:
    return x / c.GRID_X * c.LENGTH, y / c.GRID_Y * c.WIDTH


def mirror(x: Column, y: Column) -> tuple[Column, Column]:
    return F.lit(c.LENGTH) - x, F.lit(c.WIDTH) - y


def to_tagger(x: Column, y: Column, half: Column) -> tuple[Column, Column]:
    """Grid coordinates as stored: the second half turned round, clamped to the grid."""
    mx, my = mirror(x, y)
    gx, gy = metres_to_grid(F.when(half == 2, mx).otherwise(x), F.when(half == 2, my).otherwise(y))
    return clamp(gx, 0.0, c.GRID_X), clamp(gy, 0.0, c.GRID_Y)


def in_pitch(x: Column, y: Column) -> Column:
    return x.between(0.0, c.LENGTH) & y.between(0.0, c.WIDTH)


def in_box(x: Column, y: Column, right: Column) -> Column:
    """In the penalty box at the right end, or else the left."""
    half = c.BOX_WIDTH / 2
    deep = F.when(right, x >= c.LENGTH - c.BOX_DEPTH).otherwise(x <= c.BOX_DEPTH)
    return deep & y.between(c.WIDTH / 2 - half, c.WIDTH / 2 + half)


def in_goal_mouth(y: Column, margin: float = 0.0) -> Column:
    return F.abs(y - c.WIDTH / 2) <= c.GOAL_WIDTH / 2 + margin


def project(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 3x3 matrix given as nine numbers, row by row."""
    w = h[6] * x + h[7] * y + h[8]
    return F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 where they don't meet."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def vector_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays, in double precision."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def rounded(x: Column, digits: int) -> Column:
    """A double to ``digits`` places, half away from zero, judged on the number itself and not on
    its shortest decimal, of which it may fall short."""
    whole = F.round(x * 10.0**digits) / 10.0**digits
    return F.when(F.isnan(whole) | (F.abs(whole) == float("inf")), x).otherwise(whole)


def half_even(x: Column, digits: int) -> Column:
    """A double to ``digits`` places, half to the even one, judged like ``rounded``."""
    whole = F.rint(x * 10.0**digits) / 10.0**digits
    return F.when(F.isnan(whole) | (F.abs(whole) == float("inf")), x).otherwise(whole)


def half_up(x: Column, digits: int) -> Column:
    """Browser rounding: half goes up, also below zero."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to one place, 0 where there is nothing."""
    return F.when(whole > 0, half_even(100.0 * part / whole, 1)).otherwise(F.lit(0.0))


def clock(seconds: Column) -> tuple[Column, Column]:
    return F.floor(seconds / 60).cast("int"), F.floor(F.pmod(seconds, F.lit(60.0))).cast("int")


def evidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.6, "Strong").when(confidence >= 0.4, "Fair").otherwise("Weak")
