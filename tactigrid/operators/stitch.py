"""Fragments of tracks joined into people: tracklets, pair costs, assignment in rounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.config import PLAYER, Stitch
from tactigrid.functions.geometry import distance, half_even, vector_distance
from tactigrid.operators.assignment import assign
from tactigrid.sources.scratch import stored
from tactigrid.operators.tracks import TRACK


def tracklets(people: DataFrame, teams: DataFrame, classes: DataFrame, kits: DataFrame | None = None, config: Stitch = Stitch()) -> DataFrame:
    """One row per track of ``min_rows`` rows or more: its ends (medians of up to ``window`` rows),
    its speeds there in units per frame, team, class and kit. Tracks without an image position at
    an end are left out."""
    w = Window.partitionBy(*TRACK)
    rows = people.withColumns({"up": F.row_number().over(w.orderBy("frame")), "down": F.row_number().over(w.orderBy(F.desc("frame"))), "n": F.count("*").over(w)}).where(F.col("n") >= config.min_rows)
    k = config.window

    def end(rank: str, x: str, y: str) -> Column:
        near = (F.col(rank) <= k) & F.col(x).isNotNull() & F.col(y).isNotNull()
        mx, my = F.median(F.when(near, F.col(x))), F.median(F.when(near, F.col(y)))
        return F.when(mx.isNotNull(), F.struct(mx.alias("x"), my.alias("y")))

    def speed(rank: str) -> Column:
        near = (F.col(rank) <= k) & F.col("pitch_x").isNotNull() & F.col("pitch_y").isNotNull()
        point = F.struct("frame", F.col("pitch_x").alias("x"), F.col("pitch_y").alias("y"))
        a, b = F.min_by(F.when(near, point), F.when(near, F.col("frame"))), F.max_by(F.when(near, point), F.when(near, F.col("frame")))
        span = b["frame"] - a["frame"]
        zero = F.lit(0.0)
        return F.struct(F.coalesce(F.when(span > 0, (b["x"] - a["x"]) / span), zero).alias("x"), F.coalesce(F.when(span > 0, (b["y"] - a["y"]) / span), zero).alias("y"))

    out = rows.groupBy(*TRACK).agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n"),
        end("up", "pitch_x", "pitch_y").alias("head"), end("down", "pitch_x", "pitch_y").alias("tail"), speed("up").alias("head_speed"), speed("down").alias("tail_speed"),
        end("up", "img_x", "img_y").alias("head_img"), end("down", "img_x", "img_y").alias("tail_img"),
    ).where(F.col("head_img").isNotNull() & F.col("tail_img").isNotNull())
    out = out.join(classes.select(*TRACK, "cls"), TRACK, "left").join(teams.select(*TRACK, "team"), TRACK, "left").withColumn("cls", F.coalesce("cls", F.lit(PLAYER)))
    if kits is None:
        return out.withColumn("kit", F.lit(None).cast("array<double>"))
    return out.join(kits.select(*TRACK, F.col("kit").cast("array<double>").alias("kit")), TRACK, "left")


def pair_costs(parts: DataFrame, most_gap_s: float, fps: float = 25.0, frame_width: float = 1920.0, config: Stitch = Stitch()) -> DataFrame:
    """(match_id, a, b, cost, image) of fragments that one person can have left and begun.

    The later one begins within the round's gap after the earlier one ends, so both are met in
    buckets of that many frames."""
    step = max(int(most_gap_s * fps), 1)
    names = ["start_frame", "end_frame", "head", "tail", "head_speed", "tail_speed", "head_img", "tail_img", "cls", "team", "kit", "n"]

    def side(p: str) -> DataFrame:
        return parts.select("match_id", F.col("track_id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in names])

    one = side("a").withColumn("bucket", F.explode(F.array(F.floor(F.col("a_end_frame") / step), F.floor(F.col("a_end_frame") / step) + 1)))
    two = side("b").withColumn("bucket", F.floor(F.col("b_start_frame") / step))
    gap = F.col("b_start_frame") - F.col("a_end_frame")
    kit = vector_distance(F.col("a_kit"), F.col("b_kit"))
    pairs = one.join(two, ["match_id", "bucket"]).withColumns({"gap": gap, "kit_gap": kit}).where((gap > 0) & (gap <= most_gap_s * fps) & (F.col("a_cls") == F.col("b_cls")))
    known = (F.coalesce("a_team", F.lit(0)) > 0) & (F.coalesce("b_team", F.lit(0)) > 0)
    pairs = pairs.where(~known | (F.col("a_team") == F.col("b_team"))).where(F.coalesce("kit_gap", F.lit(0.0)) <= config.kit_limit)
    seconds = F.col("gap") / fps
    ahead = F.least(F.col("gap").cast("double"), F.lit(config.horizon * fps))
    miss = lambda p, v, sign, q: distance(p["x"] + sign * v["x"] * ahead, p["y"] + sign * v["y"] * ahead, q["x"], q["y"])
    metres = (miss(F.col("a_tail"), F.col("a_tail_speed"), 1, F.col("b_head")) + miss(F.col("b_head"), F.col("b_head_speed"), -1, F.col("a_tail"))) / 2
    reach = F.least(seconds, F.lit(config.burst_time)) * config.burst + F.greatest(seconds - config.burst_time, F.lit(0.0)) * config.sustained + config.tolerance
    pixels = distance(F.col("a_tail_img.x"), F.col("a_tail_img.y"), F.col("b_head_img.x"), F.col("b_head_img.y"))
    image = F.col("a_tail").isNull() | F.col("b_head").isNull()
    share = F.when(image, pixels / (config.image_share * frame_width * (1 + seconds))).otherwise(metres / reach)
    pairs = pairs.withColumns({"image": image, "share": share}).where(F.col("share") <= 1.0)
    if not config.use_image:
        pairs = pairs.where(~F.col("image"))
    cost = F.col("share") + config.kit_weight * F.coalesce("kit_gap", F.lit(0.0)) / config.kit_limit
    return pairs.select("match_id", "a", "b", cost.alias("cost"), "image")


def choose(costs: DataFrame, ambiguity: float = 0.75) -> DataFrame:
    """The one-to-one links (match_id, a, b) of least total cost whose choice is clear: the cost is
    at most ``ambiguity`` times that of the runner-up of either end."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.unique(pdf["a"]), np.unique(pdf["b"])
        grid = np.full((len(a), len(b)), 1e6)
        grid[np.searchsorted(a, pdf["a"]), np.searchsorted(b, pdf["b"])] = pdf["cost"]
        rows = []
        for i, j in assign(grid):
            best = grid[i, j]
            rivals = np.concatenate([np.delete(grid[i], j), np.delete(grid[:, j], i)])
            second = rivals.min() if len(rivals) else 1e6
            if best < 1e6 and (best <= 0 or second >= 1e6 or best <= ambiguity * second):
                rows.append((pdf["match_id"].iloc[0], int(a[i]), int(b[j])))
        return pd.DataFrame(rows, columns=["match_id", "a", "b"])

    return costs.groupBy("match_id").applyInPandas(pick, "match_id bigint, a int, b int")


def merge(parts: DataFrame, roots: DataFrame) -> DataFrame:
    """Fragments of one root (match_id, track_id, root) as one: the first's head, the last's tail,
    kits weighted by rows, class and team by most rows."""
    rows = parts.join(roots, TRACK, "left").withColumn("root", F.coalesce("root", "track_id"))
    first = lambda c: F.min_by(c, F.struct("start_frame", "track_id")).alias(c)
    last = lambda c: F.max_by(c, F.struct("end_frame", "track_id")).alias(c)
    kits = rows.where(F.col("kit").isNotNull()).select("match_id", "root", "n", F.posexplode("kit").alias("i", "v")).groupBy("match_id", "root", "i").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"))
    kits = kits.groupBy("match_id", "root").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("kit"))
    out = rows.groupBy("match_id", "root").agg(
        F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.sum("n").alias("n"), first("head"), last("tail"), first("head_speed"), last("tail_speed"), first("head_img"), last("tail_img"),
        F.max_by("cls", F.struct("n", F.negative("cls"))).alias("cls"), F.max_by("team", F.when(F.coalesce("team", F.lit(0)) > 0, F.col("n"))).alias("team"),
    )
    return out.join(kits, ["match_id", "root"], "left").withColumnRenamed("root", "track_id")


def link(parts: DataFrame, fps: float = 25.0, frame_width: float = 1920.0, config: Stitch = Stitch()) -> DataFrame:
    """(match_id, track_id, root) after all rounds, near gaps first; the root is the smallest id.

    A round's links form paths (one-to-one, forwards in time), resolved within the match, which
    bounds the group. What a round leaves is written out (``stored``), as the next one reads it
    several times."""

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        top: dict[int, int] = {}
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            group = {a, b} | {k for k, v in top.items() if v in (top.get(a, a), top.get(b, b))}
            least = min(group | {top.get(a, a), top.get(b, b)})
            top.update(dict.fromkeys(group, least))
        return pd.DataFrame({"match_id": pdf["match_id"].iloc[0], "track_id": list(top), "root": list(top.values())})

    parts = stored(parts)
    mapping = parts.select("match_id", "track_id", F.col("track_id").alias("root"))
    for gap in config.rounds:
        chosen = choose(pair_costs(parts, gap, fps, frame_width, config), config.ambiguity)
        roots = stored(chosen.groupBy("match_id").applyInPandas(resolve, "match_id bigint, track_id int, root int"))
        parts = stored(merge(parts, roots))
        up = roots.select("match_id", F.col("track_id").alias("root"), F.col("root").alias("over"))
        mapping = mapping.join(up, ["match_id", "root"], "left").select("match_id", "track_id", F.coalesce("over", "root").alias("root"))
    return mapping


def report(mapping: DataFrame) -> DataFrame:
    n = mapping.groupBy("match_id").agg(F.count("*").alias("before"), F.countDistinct("root").alias("after"))
    return n.withColumns({"merges": F.col("before") - F.col("after"), "reduction": half_even(1 - F.col("after") / F.col("before"), 3)})


def remap_labels(labels: DataFrame, mapping: DataFrame, label: str) -> DataFrame:
    """Labels of tracks carried over to their roots, by majority."""
    from tactigrid.operators.tracks import majority

    rows = labels.join(mapping, TRACK, "left").withColumn("root", F.coalesce("root", "track_id"))
    return majority(rows, ["match_id", "root"], label).drop("share").withColumnRenamed("root", "track_id")
