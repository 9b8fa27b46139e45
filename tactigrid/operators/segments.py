"""Camera shots: cuts found in a series of picture signatures, and what lies in which shot."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.functions.geometry import half_even
from tactigrid.functions.ranges import between_frames


@dataclass
class CutFinder:
    """Relative threshold: a step counts as a cut if it is ``ratio`` times the median of the last
    ``window`` steps of the shot (the step of a cut belongs to neither side) and large enough."""

    ratio: float = 4.0
    least: float = 0.022
    window: int = 40
    recent: deque = field(default_factory=deque)

    def step(self, d: float | None) -> bool:
        if d is None:  # the first picture
            return False
        floor = self.least * (1 if self.recent else 2)
        cut = d >= max(floor, float(np.median(self.recent)) * self.ratio if self.recent else 0.0)
        if cut:
            self.recent.clear()
            return True
        self.recent.append(d)
        while len(self.recent) > self.window:
            self.recent.popleft()
        return False


def steps(signatures: DataFrame) -> DataFrame:
    """Mean absolute difference of each signature (array of numbers) and the one before."""
    before = F.lag("signature").over(Window.partitionBy("match_id").orderBy("frame"))
    d = F.aggregate(F.zip_with("signature", before, lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v) / F.size("signature")
    return signatures.withColumn("step", F.when(before.isNotNull(), d)).drop("signature")


def find_cuts(stepped: DataFrame, ratio: float = 4.0, least: float = 0.022, window: int = 40) -> DataFrame:
    """(match_id, frame, step, cut), folded in frame order within each match."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        finder = CutFinder(ratio, least, window)
        return pdf.assign(cut=[finder.step(None if pd.isna(d) else float(d)) for d in pdf["step"]])

    return stepped.select("match_id", "frame", "step").groupBy("match_id").applyInPandas(fold, "match_id bigint, frame bigint, step double, cut boolean")


def shots(cuts: DataFrame, solved: DataFrame | None = None) -> DataFrame:
    """(match_id, shot, start_frame, end_frame, frames, attempted, calibrated): runs between cuts."""
    number = F.sum(F.col("cut").cast("int")).over(Window.partitionBy("match_id").orderBy("frame")).cast("int")
    rows = cuts.withColumn("shot", number)
    if solved is not None:
        rows = rows.join(solved.select("match_id", "frame", "solved"), ["match_id", "frame"], "left")
    else:
        rows = rows.withColumn("solved", F.lit(None).cast("boolean"))
    return rows.groupBy("match_id", "shot").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("frames"), F.count("solved").alias("attempted"), F.count_if("solved").alias("calibrated"))


def playable(found: DataFrame, min_frames: int = 6, min_share: float = 0.35) -> DataFrame:
    share = F.when(F.col("attempted") > 0, F.col("calibrated") / F.col("attempted")).otherwise(0.0)
    return found.withColumn("playable", (F.col("frames") >= min_frames) & (share >= min_share))


def shot_summary(found: DataFrame) -> DataFrame:
    """Of shots with their ``playable`` flag; coverage is the true share of solved attempts."""
    play = F.coalesce(F.sum(F.when(F.col("playable"), F.col("frames"))), F.lit(0))
    return found.groupBy("match_id").agg(
        F.count("*").alias("shots"), (F.count("*") - 1).alias("cuts"), F.count_if("playable").alias("playable_shots"), play.alias("playable_frames"),
        half_even(play / F.sum("frames"), 3).alias("playable_share"), F.max("frames").alias("longest_shot_frames"),
        F.coalesce(half_even(F.try_divide(F.sum("calibrated"), F.sum("attempted")), 3), F.lit(0.0)).alias("coverage"),
    )


def with_shot(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (match_id, frame, ...) with the first shot that holds their frame; others are dropped."""
    met = between_frames(found.select("match_id", "shot", "start_frame", "end_frame"), rows, "start_frame", "end_frame")
    first = F.row_number().over(Window.partitionBy("match_id", *[c for c in rows.columns if c != "match_id"]).orderBy("shot"))
    return met.withColumn("__r", first).where("__r = 1").select(*rows.columns, "shot")
