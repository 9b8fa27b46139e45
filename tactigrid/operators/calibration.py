"""Homographies: as-of lookup, blending, fitting and what they are worth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.config import LENGTH, WIDTH
from tactigrid.functions.geometry import distance, half_even, project

CORNERS = np.array([[0.0, 0.0], [LENGTH, 0.0], [LENGTH, WIDTH], [0.0, WIDTH]])
#: A fit is believed up to so many pixels of mean error, if the pitch takes such a share of the picture.
MOST_ERROR, AREA = 60.0, (0.05, 400.0)


def as_of(frames: DataFrame, solved: DataFrame, max_reuse: int = 75) -> DataFrame:
    """Each frame (match_id, shot, frame) with the latest homography (matrix, n_points, error) of the
    same shot at or before it, if it is at most ``max_reuse`` frames old."""
    h = F.struct("frame", "matrix", "n_points", "error")
    both = frames.select("match_id", "shot", "frame", F.lit(1).alias("k"), F.lit(None).cast(solved.select(h.alias("h")).schema["h"].dataType).alias("h")).unionByName(solved.select("match_id", "shot", "frame", F.lit(0).alias("k"), h.alias("h")))
    last = F.last("h", ignorenulls=True).over(Window.partitionBy("match_id", "shot").orderBy("frame", "k"))
    out = both.withColumn("h", last).where("k = 1")
    fresh = F.col("frame") - F.col("h.frame") <= max_reuse
    return out.select("match_id", "shot", "frame", F.when(fresh, F.col("h.frame")).alias("solved_frame"), F.when(fresh, F.col("h.matrix")).alias("matrix"), F.when(fresh, F.col("h.error")).alias("error"))


def two_sided(frames: DataFrame, solved: DataFrame, max_reuse: int = 75) -> DataFrame:
    """Frames with the last homography before them and the next (frame, matrix, n_points, error)
    and the share of the next that a blend takes: 0 and 1 where one of them alone counts."""
    h = F.struct("frame", "matrix", "n_points", "error")
    both = frames.select("match_id", "shot", "frame", F.lit(1).alias("k"), F.lit(None).cast(solved.select(h.alias("h")).schema["h"].dataType).alias("h")).unionByName(solved.select("match_id", "shot", "frame", F.lit(0).alias("k"), h.alias("h")))
    order = Window.partitionBy("match_id", "shot").orderBy("frame", "k")
    ahead = Window.partitionBy("match_id", "shot").orderBy("frame", "k").rowsBetween(0, Window.unboundedFollowing)
    out = both.withColumns({"p": F.last("h", ignorenulls=True).over(order), "n": F.first("h", ignorenulls=True).over(ahead)}).where("k = 1")
    near = lambda c: F.when(F.abs(F.col("frame") - F.col(f"{c}.frame")) <= max_reuse, F.col(c))
    out = out.withColumns({"p": near("p"), "n": near("n")})
    share = F.when(F.col("p").isNull(), 1.0).when(F.col("n").isNull() | (F.col("n.frame") == F.col("p.frame")), 0.0).otherwise((F.col("frame") - F.col("p.frame")) / (F.col("n.frame") - F.col("p.frame")))
    return out.where(F.col("p").isNotNull() | F.col("n").isNotNull()).select("match_id", "shot", "frame", F.col("p").alias("before"), F.col("n").alias("after"), share.alias("share"))


def blended(frames: DataFrame, solved: DataFrame, max_reuse: int = 75) -> DataFrame:
    """(match_id, shot, frame, matrix, n_points, error) of every frame with a homography of its shot
    within ``max_reuse`` frames: its own, or the only near one, or one between the two.

    For the last, each of both takes the pitch's corners to the picture, the corners are moved
    along the line between by the time gone, and a homography is fitted to them; it has the
    lower number of points of the two and an error in between."""
    sides = two_sided(frames, solved, max_reuse)
    own = F.when(F.col("share") <= 0, F.col("before")).when(F.col("share") >= 1, F.col("after"))

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = (np.array(pdf[c].tolist(), float).reshape(-1, 3, 3) for c in ("before_matrix", "after_matrix"))
            t = pdf["share"].to_numpy(float)[:, None, None]
            q = (1 - t) * _corners_in_picture(a) + t * _corners_in_picture(b)
            yield pdf[["match_id", "shot", "frame"]].assign(matrix=[m.ravel().tolist() for m in _through_corners(q)])

    two = own.isNull()
    rows = sides.where(two).select("match_id", "shot", "frame", F.col("before.matrix").alias("before_matrix"), F.col("after.matrix").alias("after_matrix"), "share")
    made = rows.mapInPandas(between, "match_id bigint, shot bigint, frame bigint, matrix array<double>")
    line = lambda c: F.col(f"before.{c}") + (F.col(f"after.{c}") - F.col(f"before.{c}")) * F.col("share")
    worth = sides.where(two).select("match_id", "shot", "frame", F.least("before.n_points", "after.n_points").alias("n_points"), line("error").alias("error"))
    keys = ["match_id", "shot", "frame"]
    one = sides.where(~two).select(*keys, own.alias("h")).select(*keys, "h.matrix", "h.n_points", "h.error")
    return one.union(made.join(worth, keys).select(*keys, "matrix", "n_points", "error"))


def _through(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    q = np.column_stack([points, np.ones(len(points))]) @ h.T
    with np.errstate(all="ignore"):
        return q[:, :2] / q[:, 2:]


def _corners_in_picture(h: np.ndarray) -> np.ndarray:
    """Where many matrices (n, 3, 3) have the pitch's corners in the picture: (n, 4, 2)."""
    q = np.column_stack([CORNERS, np.ones(4)]) @ np.linalg.inv(h).transpose(0, 2, 1)
    return q[:, :, :2] / q[:, :, 2:]


def _through_corners(picture: np.ndarray) -> np.ndarray:
    """The matrices (n, 3, 3) that take four points each (n, 4, 2) to the pitch's corners."""
    return _of_four(picture, np.broadcast_to(CORNERS, picture.shape))


def fit_homography(image: np.ndarray, pitch: np.ndarray) -> np.ndarray | None:
    """The 3x3 matrix from image points to pitch points: direct linear transform on centred and
    scaled points; None for fewer than four points or points on a line."""
    if len(image) < 4:
        return None

    def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, s = p.mean(axis=0), max(np.sqrt(((p - p.mean(axis=0)) ** 2).sum(axis=1)).mean(), 1e-9)
        t = np.array([[np.sqrt(2) / s, 0, -np.sqrt(2) / s * c[0]], [0, np.sqrt(2) / s, -np.sqrt(2) / s * c[1]], [0, 0, 1]])
        return t, (p - c) * np.sqrt(2) / s

    ta, a = normal(np.asarray(image, float))
    tb, b = normal(np.asarray(pitch, float))
    if min(np.linalg.svd(a - a.mean(axis=0), compute_uv=False)[-1], np.linalg.svd(b - b.mean(axis=0), compute_uv=False)[-1]) < 1e-3:
        return None
    one, zero = np.ones(len(a)), np.zeros((len(a), 3))
    p = np.column_stack([a, one])
    m = np.concatenate([np.hstack([p, zero, -b[:, :1] * p]), np.hstack([zero, p, -b[:, 1:] * p])])
    h = np.linalg.svd(m)[2][-1].reshape(3, 3)
    h = np.linalg.inv(tb) @ h @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def _of_four(image: np.ndarray, pitch: np.ndarray) -> np.ndarray:
    """The matrices (m, 3, 3) of m draws of four points (m, 4, 2) each; draws with three points on a
    line, which make none, are left out."""
    n = len(image)
    x, y, u, v = image[:, :, 0], image[:, :, 1], pitch[:, :, 0], pitch[:, :, 1]
    one, zero = np.ones((n, 4)), np.zeros((n, 4))
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -x * u, -y * u], 2), np.stack([zero, zero, zero, x, y, one, -x * v, -y * v], 2)], 1)
    scale = np.abs(rows).max(axis=1, keepdims=True) + 1e-12
    fine = np.abs(np.linalg.det(rows / scale)) > 1e-9
    h = np.linalg.solve(rows[fine], np.concatenate([u, v], 1)[fine][:, :, None])[:, :, 0]
    return np.column_stack([h, np.ones(len(h))]).reshape(-1, 3, 3)


def robust_homography(image: np.ndarray, pitch: np.ndarray, tolerance: float = 8.0, tries: int = 200, at_once: int = 20) -> tuple[np.ndarray | None, np.ndarray]:
    """Fit to the largest set of points that one matrix maps within ``tolerance`` (seeded draws, so
    many at once, until it is very unlikely that a larger set was missed)."""
    image, pitch = np.asarray(image, float), np.asarray(pitch, float)
    n = len(image)
    best = np.zeros(n, bool)
    rng = np.random.default_rng(0)
    flat = np.column_stack([image, np.ones(n)])
    done = 0
    while n >= 4 and done < tries:
        pick = np.arange(4)[None] if n == 4 else np.argsort(rng.random((at_once, n)), axis=1)[:, :4]
        done += tries if n == 4 else at_once
        h = _of_four(image[pick], pitch[pick])
        if len(h):
            q = flat[None] @ h.transpose(0, 2, 1)
            with np.errstate(all="ignore"):
                near = np.nan_to_num(np.linalg.norm(q[:, :, :2] / q[:, :, 2:] - pitch[None], axis=2), nan=np.inf) <= tolerance
            first = int(near.sum(axis=1).argmax())
            if near[first].sum() > best.sum():
                best = near[first]
        if (1 - best.mean() ** 4) ** done < 1e-6:
            break
    return (fit_homography(image[best], pitch[best]) if best.sum() >= 4 else None), best


def believable(image: np.ndarray, pitch: np.ndarray, width: float, height: float, tolerance: float = 8.0) -> tuple[np.ndarray, np.ndarray, int, float] | None:
    """(matrix, inverse, points used, mean error in pixels) of a fit that can be believed.

    The points that it uses, taken back to the picture, are within ``MOST_ERROR`` pixels of where
    they were seen on average, and the pitch covers a share of the picture between those of
    ``AREA``: a fit that collapses or explodes is turned down."""
    h, used = robust_homography(image, pitch, tolerance)
    if h is None or abs(np.linalg.det(h)) < 1e-15:
        return None
    inverse = np.linalg.inv(h)
    error = float(np.hypot(*(_through(inverse, pitch[used]) - image[used]).T).mean())
    if not error <= MOST_ERROR:
        return None
    quad = _through(inverse, CORNERS)
    x, y = quad.T
    area = abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2
    if not (np.isfinite(quad).all() and AREA[0] < area / (width * height) < AREA[1]):
        return None
    return h, inverse, int(used.sum()), error


def manual_homography(image: np.ndarray, pitch: np.ndarray, width: float = 1920.0, height: float = 1080.0) -> tuple[np.ndarray, np.ndarray, int, float]:
    """As ``believable``, of points that a person marked, which it takes four of; else ValueError."""
    image, pitch = np.asarray(image, float).reshape(-1, 2), np.asarray(pitch, float).reshape(-1, 2)
    if len(image) != len(pitch):
        raise ValueError("each point of the picture needs one of the pitch")
    if len(image) < 4:
        raise ValueError("four points at least make a homography")
    found = believable(image, pitch, width, height, 12.0)
    if found is None:
        raise ValueError("these points make no homography: they may lie on a line, be mixed up or too close")
    return found


def fit_frames(points: DataFrame, least: int = 5, tolerance: float = 8.0, width: float = 1920.0, height: float = 1080.0) -> DataFrame:
    """Points (match_id, frame, img_x, img_y, pitch_x, pitch_y) to one homography per frame, where
    there are ``least`` points and the fit is believable: matrix, inverse, n_points, mean error in
    pixels. For points that a person marked ``least`` is 4 and ``tolerance`` 12."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["match_id", "frame", "matrix", "inverse", "n_points", "error"]
        for pdf in batches:
            out = []
            for match, frame, at in zip(pdf["match_id"], pdf["frame"], pdf["points"], strict=True):
                p = np.array([tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in at], float)
                found = believable(p[:, :2], p[:, 2:], width, height, tolerance)
                if found is not None:
                    h, inverse, used, error = found
                    out.append((match, frame, h.ravel().tolist(), inverse.ravel().tolist(), used, error))
            yield pd.DataFrame(out, columns=names)

    # a frame's points, a few dozen at most, travel as one row
    point = F.struct(*[F.col(c).cast("double").alias(c) for c in ("img_x", "img_y", "pitch_x", "pitch_y")])
    rows = points.groupBy("match_id", "frame").agg(F.array_sort(F.collect_list(point)).alias("points")).where(F.size("points") >= least)
    return rows.mapInPandas(fit, "match_id bigint, frame bigint, matrix array<double>, inverse array<double>, n_points int, error double")


def visible_points(keypoints: Column, width: float, height: float, confidence: float = 0.4, margin: float = 0.1, least: int = 5, least_inside: int = 4) -> Column:
    """Of array<struct<x, y, conf, ...>> the points sure enough and not far outside the picture;
    null where fewer than ``least`` are sure or fewer than ``least_inside`` of these are inside."""
    sure = F.filter(keypoints, lambda k: k["conf"] >= confidence)
    near = lambda v, size: (v > -margin * size) & (v < (1 + margin) * size)
    inside = F.filter(sure, lambda k: near(k["x"], width) & near(k["y"], height))
    return F.when((F.size(sure) >= least) & (F.size(inside) >= least_inside), inside)


def held_out_errors(points: DataFrame) -> DataFrame:
    """Fit on even points, score on odd: distance in metres of every odd point (index column i)."""
    h = fit_frames(points.where("i % 2 = 0"), least=4)
    x, y = project(F.col("matrix"), F.col("img_x"), F.col("img_y"))
    return points.where("i % 2 = 1").join(h.select("match_id", "frame", "matrix"), ["match_id", "frame"]).select("match_id", "frame", "i", distance(x, y, F.col("pitch_x"), F.col("pitch_y")).alias("error_m"))


def calibration_summary(solved: DataFrame, matches: DataFrame) -> DataFrame:
    """For each of ``matches`` (match_id) how many frames were solved, the mean error in pixels and
    the mean number of points; 0 and nulls where none was."""
    n = solved.groupBy("match_id").agg(F.count("*").alias("solved"), half_even(F.avg("error"), 2).alias("mean_error"), half_even(F.avg("n_points"), 1).alias("mean_points"))
    return matches.select("match_id").distinct().join(n, "match_id", "left").withColumn("solved", F.coalesce("solved", F.lit(0)))
