"""Structured Streaming editions of the ordered operators.

Rows of a match must come in order of frames within a micro-batch's reach: a batch is sorted,
and a frame older than the last one folded is late and dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tactigrid.config import Possession
from tactigrid.functions.geometry import half_even
from tactigrid.operators.possession import Hysteresis
from tactigrid.operators.segments import CutFinder


def steady_stream(holders: DataFrame, config: Possession = Possession()) -> DataFrame:
    """A stream of (match_id, frame, time_s, holder, holder_team) with the possessor of each frame."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner, rival, streak, gap, previous, owner_team, last = state.get if state.exists else (-1, -1, 0, 0, -1, 0, -1)
        rows = pd.concat(list(batches)).sort_values("frame")
        rows = rows[rows["frame"] > last]
        run = Hysteresis(config, (owner, rival, streak, gap, previous))
        teams, out = {owner: owner_team}, []
        for r in rows.itertuples():
            teams[r.holder] = r.holder_team
            out.append(run.step(int(r.holder), r.holder_team != teams.get(run.owner, 0)))
            last = max(last, int(r.frame))
        state.update((*(int(x) for x in run.state), int(teams.get(run.owner, 0)) if run.owner >= 0 else 0, last))
        yield rows.assign(holder=out, holder_team=[teams.get(h, 0) if h >= 0 else 0 for h in out])[["match_id", "frame", "time_s", "holder", "holder_team"]]

    return holders.groupBy("match_id").applyInPandasWithState(
        fold, "match_id bigint, frame bigint, time_s double, holder int, holder_team int", "owner int, rival int, streak int, gap int, previous int, team int, last bigint", "append", GroupStateTimeout.NoTimeout
    )


def cut_stream(stepped: DataFrame, ratio: float = 4.0, least: float = 0.022, window: int = 40) -> DataFrame:
    """A stream of (match_id, frame, step) with whether a shot begins at each frame."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, last = state.get if state.exists else ([], -1)
        finder = CutFinder(ratio, least, window)
        finder.recent.extend(recent)
        rows = pd.concat(list(batches)).sort_values("frame")
        rows = rows[rows["frame"] > last]
        out = [finder.step(None if pd.isna(d) else float(d)) for d in rows["step"]]
        if len(rows):
            last = int(rows["frame"].max())
        state.update(([float(x) for x in finder.recent], last))
        yield rows.assign(cut=out)[["match_id", "frame", "step", "cut"]]

    return stepped.groupBy("match_id").applyInPandasWithState(fold, "match_id bigint, frame bigint, step double, cut boolean", "recent array<double>, last bigint", "append", GroupStateTimeout.NoTimeout)


def timeline_stream(holders: DataFrame, kickoff: str = "2000-01-01 00:00:00", width: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """Possession in tumbling windows of match time, with a watermark for late frames."""
    at = F.timestamp_micros((F.unix_micros(F.to_timestamp(F.lit(kickoff))) + F.col("time_s") * 1_000_000).cast("bigint"))
    rows = holders.where(F.col("holder") >= 0).withColumn("at", at).withWatermark("at", late)
    n = rows.groupBy("match_id", F.window("at", width).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("holder_team") == 1).alias("n1"), F.count_if(F.col("holder_team") == 2).alias("n2"))
    share = lambda c: half_even(100.0 * F.col(c) / F.col("n"), 1)
    return n.select("match_id", F.col("w.start").alias("start"), share("n1").alias("team_1"), share("n2").alias("team_2"))


def votes_stream(observations: DataFrame) -> DataFrame:
    """Team votes per track as they come in (update mode)."""
    return observations.groupBy("match_id", "track_id", "team").agg(F.count("*").alias("n"))


def calibration_stream(rows: DataFrame, max_reuse: int = 75) -> DataFrame:
    """The homography to use for each frame as it comes: the last one solved since the last cut, if
    it is at most ``max_reuse`` frames old. ``rows`` are (match_id, frame, cut, matrix), with a null
    matrix where a frame wasn't solved; a frame at a cut is of the new shot. What comes later
    can't be seen, so nothing is blended."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, matrix, last = state.get if state.exists else (-1, [], -1)
        pdf = pd.concat(list(batches)).sort_values("frame")
        pdf = pdf[pdf["frame"] > last]
        froms, matrices = [], []
        for r in pdf.itertuples():
            last = int(r.frame)
            if r.cut:
                at, matrix = -1, []
            if r.matrix is not None:
                at, matrix = last, [float(x) for x in r.matrix]
            fresh = at >= 0 and last - at <= max_reuse
            froms.append(at if fresh else None)
            matrices.append(matrix if fresh else None)
        state.update((at, matrix, last))
        yield pdf[["match_id", "frame"]].assign(solved_frame=pd.array(froms, "Int64"), matrix=matrices)

    return rows.groupBy("match_id").applyInPandasWithState(fold, "match_id bigint, frame bigint, solved_frame bigint, matrix array<double>", "at bigint, matrix array<double>, last bigint", "append", GroupStateTimeout.NoTimeout)
