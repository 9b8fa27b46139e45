"""Tables around the detectors: tiles, crops, false positives, best boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.functions.geometry import iou


def tile_windows(frames: DataFrame, size: int = 640, overlap: int = 128) -> DataFrame:
    """Frames (width, height) cut into windows (x, y, w, h) that cover them; the last of a row or
    column is moved flush with the edge, and a small frame is one window."""

    def places(length: Column) -> Column:
        last = F.greatest(length - size, F.lit(0))
        n = F.ceil(last / (size - overlap)).cast("int")
        return F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda i: F.least(i * (size - overlap), last)))

    out = frames.select("*", F.explode(places(F.col("height").cast("int"))).alias("y")).select("*", F.explode(places(F.col("width").cast("int"))).alias("x"))
    return out.select(*frames.columns, "x", "y", F.least(F.lit(size), F.col("width")).cast("int").alias("w"), F.least(F.lit(size), F.col("height")).cast("int").alias("h"))


def false_positives(predictions: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Predictions that meet no true box of their frame by ``least``: what a model should unlearn."""
    t = truth.select("frame", *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")])
    v = iou([F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col(f"t_{c}") for c in ("x1", "y1", "x2", "y2")])
    keys = predictions.columns
    best = predictions.join(t, "frame", "left").groupBy(*keys).agg(F.max(v).alias("best_iou"))
    return best.where(F.coalesce("best_iou", F.lit(0.0)) < least)


def best_box(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The surest box of each key; of equally sure ones the leftmost."""
    rest = [c for c in boxes.columns if c not in keys]
    return boxes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("conf", F.negative("x1"))).alias("b")).select(*keys, "b.*")


def best_instance(instances: DataFrame, keys: list[str]) -> DataFrame:
    """Of keypoint sets (array<struct<x, y, conf>>) the one with the highest mean confidence."""
    mean = F.aggregate("keypoints", F.lit(0.0), lambda s, k: s + k["conf"]) / F.size("keypoints")
    return instances.groupBy(*keys).agg(F.max_by("keypoints", mean).alias("keypoints"))


def suppress(boxes: DataFrame, keys: list[str], most: float = 0.6) -> DataFrame:
    """Boxes (with conf, x1, y1, x2, y2) in order of confidence, without those that one kept before
    them in the same frame covers by more than ``most``; what is suppressed suppresses nothing.
    A frame's boxes are folded as one list, which a frame bounds."""
    rest = [c for c in boxes.columns if c not in keys]
    box = F.struct(F.negative("conf").alias("__order"), "x1", "y1", *[c for c in rest if c not in ("x1", "y1")])
    listed = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("__all"))
    corners = ("x1", "y1", "x2", "y2")
    covered = lambda kept, b: F.exists(kept, lambda k: iou([b[c] for c in corners], [k[c] for c in corners]) > most)
    none = F.filter("__all", lambda b: F.lit(False))
    kept = F.aggregate("__all", none, lambda out, b: F.when(covered(out, b), out).otherwise(F.concat(out, F.array(b))))
    rows = listed.select(*keys, F.explode(kept).alias("b"))
    return rows.select(*[F.col(c) if c in keys else F.col(f"b.{c}").alias(c) for c in boxes.columns])


def window_at(x: Column, y: Column, width: Column, height: Column, size: int = 640) -> tuple[Column, Column]:
    """Where a crop begins that has a point in the middle, as far as the picture allows."""
    place = lambda v, length: F.least(F.greatest(v - size / 2, F.lit(0.0)), F.greatest(length - size, F.lit(0)).cast("double")).cast("int")
    return place(x, width), place(y, height)


def inside_window(x: Column, y: Column, size: int = 640, margin: int = 2) -> Column:
    """Whether the whole box (x1, y1, x2, y2) is in the window at x, y with a margin: half a ball is none."""
    return (F.col("x1") >= x + margin) & (F.col("y1") >= y + margin) & (F.col("x2") <= x + size - margin) & (F.col("y2") <= y + size - margin)


def in_window(x: Column, y: Column, size: int = 640) -> list[Column]:
    """Middle and size of the box (x1, y1, x2, y2) as shares of the window at x, y."""
    return [((F.col("x1") + F.col("x2")) / 2 - x) / size, ((F.col("y1") + F.col("y2")) / 2 - y) / size, (F.col("x2") - F.col("x1")) / size, (F.col("y2") - F.col("y1")) / size]


def crops(boxes: DataFrame, positives: int = 2, negatives: int = 1, jitter: float = 240.0, size: int = 640) -> DataFrame:
    """Crops of frames (frame, width, height, x1, y1, x2, y2) to train with: (frame, crop_x, crop_y,
    cx, cy, w, h), up to ``positives`` with the whole box at places drawn around it, and up to
    ``negatives`` that it doesn't touch, whose label is null. Draws are seeded by the frame; of
    12 tries for each positive and 20 for each negative the first that fit count."""

    def draw(k: Column, name: str) -> Column:
        return F.pmod(F.xxhash64(F.col("frame"), k, F.lit(name)), F.lit(1 << 30)) / float(1 << 30)

    k = F.col("__try")
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    near = window_at(cx + (2 * draw(k, "x") - 1) * jitter, cy + (2 * draw(k, "y") - 1) * jitter, F.col("width"), F.col("height"), size)
    span = lambda c: F.greatest(F.col(c) - size, F.lit(0)) + 1
    anywhere = [F.floor(draw(k, "u") * span("width")).cast("int"), F.floor(draw(k, "v") * span("height")).cast("int")]

    def some(most: int, tries: int, place: tuple | list, fits: Callable[[Column, Column], Column]) -> DataFrame:
        rows = boxes.select("*", F.explode(F.sequence(F.lit(1), F.lit(most * tries))).alias("__try")) if most else boxes.select("*", F.lit(0).alias("__try")).where(F.lit(False))
        rows = rows.withColumns({"crop_x": place[0], "crop_y": place[1]}).where(fits(F.col("crop_x"), F.col("crop_y")))
        first = F.row_number().over(Window.partitionBy("frame").orderBy("__try"))
        return rows.withColumn("__n", first).where(F.col("__n") <= most)

    at = (F.col("crop_x"), F.col("crop_y"))
    label = dict(zip(("cx", "cy", "w", "h"), in_window(*at, size), strict=True))
    keys = ["frame", "crop_x", "crop_y"]
    with_box = some(positives, 12, near, lambda x, y: inside_window(x, y, size)).select(*keys, *[v.alias(c) for c, v in label.items()])
    apart = lambda x, y: (F.col("x2") < x) | (F.col("x1") > x + size) | (F.col("y2") < y) | (F.col("y1") > y + size)
    return with_box.union(some(negatives, 20, anywhere, apart).select(*keys, *[F.lit(None).cast("double").alias(c) for c in label]))


def hard_crops(mistakes: DataFrame, truth: DataFrame, size: int = 640) -> DataFrame:
    """Crops around false positives (frame, width, height, x1, y1, x2, y2): (frame, crop_x, crop_y,
    cx, cy, w, h). The true box of the frame is their label where the crop holds the whole of it,
    as such a crop isn't empty; else it is null. Pictures smaller than a crop give none."""
    x, y = window_at((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.col("width"), F.col("height"), size)
    at = mistakes.where(F.least("width", "height") >= size).select("frame", x.alias("crop_x"), y.alias("crop_y"))
    rows = at.join(truth.select("frame", "x1", "y1", "x2", "y2"), "frame", "left")
    here = (F.col("crop_x"), F.col("crop_y"))
    has = F.coalesce(inside_window(*here, size), F.lit(False))
    return rows.select("frame", "crop_x", "crop_y", *[F.when(has, v).alias(c) for c, v in zip(("cx", "cy", "w", "h"), in_window(*here, size), strict=True)])
