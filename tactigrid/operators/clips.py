"""Highlight clips: windows around events, merged while they stay short enough."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.functions.geometry import half_even

from tactigrid.config import Clips

EVENT = "struct<event:string,player:string,team:string,event_frame:bigint,confidence:double>"


def plan(tags: DataFrame, fps: float, total_frames: int, config: Clips = Clips()) -> DataFrame:
    """(match_id, clip, start_frame, end_frame, events): the surest ``most`` events of the kinds
    wanted, in order of time, each with its lead and trail, merged where they touch."""
    at = F.coalesce(F.when(F.col("frame") > 0, F.col("frame")), F.bround((F.col("mins") * 60 + F.col("secs")) * fps).cast("bigint"))
    rows = tags.where(F.col("event").isin(*config.kinds)).withColumn("event_frame", at)
    best = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc_nulls_last("confidence"), "event_frame", "event_id"))
    rows = rows.withColumn("__r", best).where(F.col("__r") <= config.most)
    lead, trail, cap = int(config.lead * fps), int(config.trail * fps), int(config.cap * fps)
    rows = rows.select("match_id", "event_id", "event", "player", "team", "confidence", "event_frame", F.greatest(F.col("event_frame") - lead, F.lit(0)).alias("start_frame"), F.least(F.col("event_frame") + trail, F.lit(total_frames - 1)).alias("end_frame"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for r in pdf.sort_values(["event_frame", "event_id"]).itertuples():
            what = {"event": r.event, "player": r.player, "team": r.team, "event_frame": r.event_frame, "confidence": None if pd.isna(r.confidence) else r.confidence}
            open_ = out[-1] if out else None
            if open_ and r.start_frame <= open_["end_frame"] and max(r.end_frame, open_["end_frame"]) - open_["start_frame"] <= cap:
                open_["end_frame"] = max(open_["end_frame"], r.end_frame)
                open_["events"].append(what)
            else:
                out.append({"match_id": r.match_id, "clip": len(out), "start_frame": r.start_frame, "end_frame": r.end_frame, "events": [what]})
        return pd.DataFrame(out)

    return rows.groupBy("match_id").applyInPandas(fold, f"match_id bigint, clip int, start_frame bigint, end_frame bigint, events array<{EVENT}>")


def label(start_frame: Column, events: Column, fps: float) -> Column:
    """``MMmSSs`` and the first three different kinds, safe as a file name."""
    s = F.floor(start_frame / fps)
    kinds = F.array_join(F.slice(F.array_distinct(F.transform(events, lambda e: e["event"])), 1, 3), "-")
    text = F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit("m"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("s_"), kinds)
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "-"), 1, 80)


def described(clips: DataFrame, fps: float) -> DataFrame:
    return clips.select("match_id", "clip", "start_frame", "end_frame", label(F.col("start_frame"), F.col("events"), fps).alias("label"), half_even((F.col("end_frame") - F.col("start_frame")) / fps, 2).alias("duration_s"), F.size("events").alias("n_events"))
