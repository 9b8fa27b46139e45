"""Who has the ball: nearest player, steadied holder, spells, shares."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.config import GOALKEEPER, REFEREE, Possession
from tactigrid.functions.geometry import distance, percent
from tactigrid.functions.ranges import between_frames


def nearest_holder(people: DataFrame, ball: DataFrame, teams: DataFrame, config: Possession = Possession(), frame_width: float = 1920.0) -> DataFrame:
    """Per ball frame the nearest person within reach (holder -1: nobody), referees aside.

    Distances are in metres where both have a place on the pitch, else in pixels with a reach
    of a share of the picture's width. Of equally near ones the smallest id counts."""
    who = people.where(F.col("cls") != REFEREE).select("match_id", "frame", "track_id", *[F.col(c).alias(f"p_{c}") for c in ("pitch_x", "pitch_y", "img_x", "img_y")])
    near = ball.select("match_id", "frame", "pitch_x", "pitch_y", "img_x", "img_y").join(who, ["match_id", "frame"])
    metres = distance(F.col("pitch_x"), F.col("pitch_y"), F.col("p_pitch_x"), F.col("p_pitch_y"))
    pixels = distance(F.col("img_x"), F.col("img_y"), F.col("p_img_x"), F.col("p_img_y"))
    # metres if anybody in the frame can be measured in them
    measured = F.max(metres.isNotNull().cast("int")).over(Window.partitionBy("match_id", "frame")) == 1
    near = near.withColumn("d", F.when(measured, metres).otherwise(pixels)).withColumn("reach", F.when(measured, config.max_distance).otherwise(config.max_share_of_width * frame_width))
    best = near.where(F.col("d").isNotNull()).groupBy("match_id", "frame").agg(F.min(F.struct("d", "track_id", "reach")).alias("b"))
    best = best.where(F.col("b.d") <= F.col("b.reach")).select("match_id", "frame", F.col("b.track_id").alias("holder"), F.col("b.d").alias("distance"))
    out = ball.select("match_id", "frame", "time_s").join(best, ["match_id", "frame"], "left")
    out = out.join(teams.select("match_id", F.col("track_id").alias("holder"), F.col("team").alias("holder_team")), ["match_id", "holder"], "left")
    return out.select("match_id", "frame", "time_s", F.coalesce("holder", F.lit(-1)).cast("int").alias("holder"), F.coalesce("holder_team", F.lit(0)).cast("int").alias("holder_team"), "distance")


class Hysteresis:
    """Possession that must be won: a run of frames to take it, a longer one from an opponent.

    ``step`` takes the nearest player of a frame (-1: nobody) and gives the possessor. The
    state is five numbers, so that a stream can carry it from batch to batch."""

    def __init__(self, config: Possession, state: tuple[int, int, int, int, int] = (-1, -1, 0, 0, -1)):
        self.config = config
        self.owner, self.rival, self.streak, self.gap, self.previous = state

    @property
    def state(self) -> tuple[int, int, int, int, int]:
        return self.owner, self.rival, self.streak, self.gap, self.previous

    def _no_rival(self) -> None:
        self.rival, self.streak = -1, 0

    def step(self, near: int, opposed: bool) -> int:
        """``opposed``: the player near the ball isn't in the possessor's team."""
        c = self.config
        if near < 0:
            self.gap += 1
            self._no_rival()
            self.owner = -1 if self.gap > c.release else self.owner
            return self.owner
        blink, self.gap = self.owner < 0 and near == self.previous and self.gap <= c.regain, 0
        if blink:
            self.owner = near
            self._no_rival()
            return near
        if near == self.owner:
            self._no_rival()
        else:
            self.streak = self.streak + 1 if near == self.rival else 1
            self.rival = near
            wanted = c.steal if opposed and self.owner >= 0 else c.confirm
            if self.streak >= wanted:
                self.owner = near
                self._no_rival()
        self.previous = self.owner if self.owner >= 0 else self.previous
        return self.owner


def steady(holders: Iterable[int], config: Possession = Possession(), teams: dict[int, int] | None = None) -> list[int]:
    """The fold over one series; without ``teams`` nobody is an opponent."""
    fold = Hysteresis(config)
    team = (lambda t: 0) if teams is None else (lambda t: teams.get(t, 0))
    return [fold.step(h, team(h) != team(fold.owner)) for h in holders]


def steady_holder(holders: DataFrame, config: Possession = Possession()) -> DataFrame:
    """``holder`` and ``holder_team`` steadied in frame order, one match at a time (a match is a
    bounded group); the raw holder stays as ``raw``."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame", kind="stable").reset_index(drop=True)
        teams = dict(zip(pdf["holder"].tolist(), pdf["holder_team"].tolist(), strict=True))
        out = pdf.assign(raw=pdf["holder"], holder=steady(pdf["holder"].tolist(), config, teams))
        return out.assign(holder_team=[teams.get(h, 0) if h >= 0 else 0 for h in out["holder"].tolist()])[["match_id", "frame", "time_s", "holder", "holder_team", "raw"]]

    return holders.select("match_id", "frame", "time_s", "holder", "holder_team").groupBy("match_id").applyInPandas(fold, "match_id bigint, frame bigint, time_s double, holder int, holder_team int, raw int")


def spells(steadied: DataFrame, people: DataFrame, ball: DataFrame, teams: DataFrame, classes: DataFrame, config: Possession = Possession()) -> DataFrame:
    """Runs of one holder with where they began and ended.

    A run counts from ``min_spell`` rows on and if its holder was located on the pitch in it;
    the first and the last such sighting are its contacts, where the ball is looked up too."""
    order = Window.partitionBy("match_id").orderBy("frame")
    turn = F.when(F.col("holder") != F.coalesce(F.lag("holder").over(order), F.lit(-2)), 1).otherwise(0)
    runs = steadied.withColumn("__turn", turn).withColumn("spell", F.sum("__turn").over(order)).where(F.col("holder") >= 0)
    runs = runs.groupBy("match_id", "spell", F.col("holder").alias("track_id")).agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.min("time_s").alias("start_time"), F.max("time_s").alias("end_time"), F.count("*").alias("rows")
    ).where(F.col("rows") >= config.min_spell)
    seen = people.where(F.col("pitch_x").isNotNull() & F.col("pitch_y").isNotNull()).select("match_id", "track_id", "frame", F.struct(F.col("pitch_x").alias("x"), F.col("pitch_y").alias("y")).alias("xy"))
    # (runs and sightings are met in buckets of frames, not all of a track with all)
    met = between_frames(runs, seen, "start_frame", "end_frame", ("match_id", "track_id"))
    keys = ["match_id", "spell", "track_id", "start_frame", "end_frame", "start_time", "end_time"]
    found = met.groupBy(*keys).agg(F.min("frame").alias("contact_start"), F.max("frame").alias("contact_end"), F.min_by("xy", "frame").alias("start_xy"), F.max_by("xy", "frame").alias("end_xy"))
    where = ball.where(F.col("pitch_x").isNotNull() & F.col("pitch_y").isNotNull()).select("match_id", "frame", F.struct(F.col("pitch_x").alias("x"), F.col("pitch_y").alias("y")).alias("ball"))
    for end in ("start", "end"):
        at = where.select("match_id", F.col("frame").alias(f"contact_{end}"), F.col("ball").alias(f"ball_{end}_xy"))
        found = found.join(at, ["match_id", f"contact_{end}"], "left")
    found = found.join(teams.select("match_id", "track_id", "team"), ["match_id", "track_id"], "left").join(classes.select("match_id", "track_id", "cls"), ["match_id", "track_id"], "left")
    number = F.row_number().over(Window.partitionBy("match_id").orderBy("start_frame")).cast("int")
    return found.select(
        "match_id", number.alias("spell"), "track_id", F.coalesce("team", F.lit(0)).cast("int").alias("team"), "start_frame", "end_frame", "start_time", "end_time",
        "start_xy", "end_xy", "ball_start_xy", "ball_end_xy", (F.coalesce("cls", F.lit(-1)) == GOALKEEPER).alias("is_goalkeeper"), "contact_start", "contact_end",
    )


def possession_share(steadied: DataFrame) -> DataFrame:
    """Share of the frames that either team had."""
    known = steadied.where(F.col("holder_team") > 0)
    n = known.groupBy("match_id", F.col("holder_team").alias("team")).agg(F.count("*").alias("frames"))
    return n.withColumn("share", percent(F.col("frames"), F.sum("frames").over(Window.partitionBy("match_id"))))


def possession_timeline(holders: DataFrame, seconds: float = 30.0) -> DataFrame:
    """Tumbling buckets over the nearest holder: each team's share of all frames with a holder."""
    held = holders.where(F.col("holder") >= 0).withColumn("bucket", F.floor(F.col("time_s") / seconds).cast("int"))
    team = lambda t: percent(F.count_if(F.col("holder_team") == t), F.count("*"))
    return held.groupBy("match_id", "bucket").agg(team(1).alias("team_1"), team(2).alias("team_2"))
