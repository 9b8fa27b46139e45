"""From spells and ball flights to events, as one plan: lead, range joins, aggregates, cases."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.config import BOX_WIDTH, GOALKEEPER, LENGTH, WIDTH, Events
from tactigrid.functions.geometry import clock, distance, half_even, in_box, in_goal_mouth, to_tagger
from tactigrid.functions.ranges import between_frames

KEYS = ["match_id", "spell"]
EVENT = "match_id bigint, seq bigint, team int, track_id int, event string, outcome string, frame bigint, time_s double, start_x double, start_y double, end_x double, end_y double, confidence double"


def attacking_directions(people: DataFrame, teams: DataFrame, classes: DataFrame, least_rows: int = 10) -> DataFrame:
    """(match_id, team, direction): +1 towards the right. A team attacks away from its keeper or,
    without one, from the end at which its two deepest tracks stand; of two teams that seem to
    attack the same goal the second is turned round."""
    placed = people.where(F.col("pitch_x").isNotNull()).join(teams, ["match_id", "track_id"]).join(classes.withColumnRenamed("cls", "settled"), ["match_id", "track_id"], "left").where(F.col("team").isin(1, 2))
    per = placed.groupBy("match_id", "team", "track_id").agg(F.median("pitch_x").alias("x"))
    low = F.row_number().over(Window.partitionBy("match_id", "team").orderBy("x", "track_id"))
    high = F.row_number().over(Window.partitionBy("match_id", "team").orderBy(F.desc("x"), "track_id"))
    ends = per.withColumns({"lo": low, "hi": high}).groupBy("match_id", "team").agg(F.avg(F.when(F.col("lo") <= 2, F.col("x"))).alias("low"), F.avg(F.when(F.col("hi") <= 2, F.col("x"))).alias("high"))
    keeper = F.coalesce("settled", "cls") == GOALKEEPER
    goal = placed.groupBy("match_id", "team").agg(F.count_if(keeper).alias("n"), F.median(F.when(keeper, F.col("pitch_x"))).alias("x"))
    own = F.when(F.col("n") >= least_rows, F.col("x")).when(F.abs("low") < F.abs(F.col("high") - LENGTH), F.col("low")).otherwise(F.col("high"))
    way = ends.join(goal, ["match_id", "team"]).select("match_id", "team", F.when(own < LENGTH / 2, 1).otherwise(-1).alias("direction"))
    first = F.first(F.when(F.col("team") == 1, F.col("direction")), ignorenulls=True).over(Window.partitionBy("match_id"))
    return way.withColumn("first", first).select("match_id", "team", F.when((F.col("team") == 2) & (F.col("direction") == F.col("first")), -F.col("direction")).otherwise(F.col("direction")).alias("direction"))


def evidence(spells: DataFrame, ball: DataFrame, reference: float = 0.7) -> DataFrame:
    """(match_id, spell, evidence): how much of a spell the ball was really seen, times how surely."""
    position = next((c for c in ("img_x", "pitch_x") if c in ball.columns), None)
    if position is None:
        return spells.select(*KEYS, F.lit(1.0).alias("evidence"))
    seen = F.col(position).isNotNull()
    if "interpolated" in ball.columns:
        seen = seen & ~F.coalesce("interpolated", F.lit(False))
    sure = F.least(F.greatest(F.col("conf") / reference, F.lit(0.0)), F.lit(1.0)) if "conf" in ball.columns else F.lit(1.0)
    rows = ball.select("match_id", "frame", seen.alias("seen"), sure.alias("sure"))
    met = between_frames(spells.select(*KEYS, "start_frame", "end_frame"), rows, "start_frame", "end_frame")
    per = met.groupBy(*KEYS).agg(F.coalesce(F.avg(F.col("seen").cast("double")) * F.avg(F.when(F.col("seen"), F.col("sure"))), F.lit(0.0)).alias("evidence"))
    return spells.select(*KEYS).join(per, KEYS, "left").select(*KEYS, F.coalesce("evidence", F.lit(0.0)).alias("evidence"))


def flights(spells: DataFrame, ball: DataFrame, cosine: float = -0.3) -> DataFrame:
    """The ball's path from ``from_frame`` to ``to_frame`` of each spell, up to where it turns back:
    n, first and last point (f_, l_: frame, x, y), and path (array of frame, x, y)."""
    rows = ball.where(F.col("pitch_x").isNotNull()).select("match_id", "frame", F.col("pitch_x").alias("x"), F.col("pitch_y").alias("y"))
    met = between_frames(spells.select(*KEYS, "from_frame", "to_frame"), rows, "from_frame", "to_frame")
    w = Window.partitionBy(*KEYS).orderBy("frame")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    met = met.withColumns({"i": F.row_number().over(w), "dx": dx, "dy": dy})
    second = lambda c: F.max(F.when(F.col("i") == 2, F.col(c))).over(Window.partitionBy(*KEYS))
    met = met.withColumns({"hx": second("dx"), "hy": second("dy")})
    size = lambda x, y: F.sqrt(F.col(x) ** 2 + F.col(y) ** 2)
    turned = (F.col("i") > 2) & (size("hx", "hy") >= 1e-6) & (size("dx", "dy") >= 1e-6) & ((F.col("dx") * F.col("hx") + F.col("dy") * F.col("hy")) / (size("dx", "dy") * size("hx", "hy")) < cosine)
    met = met.withColumn("stop", F.min(F.when(turned, F.col("i"))).over(Window.partitionBy(*KEYS))).where(F.col("stop").isNull() | (F.col("i") < F.col("stop")))
    point = F.struct("frame", "x", "y")
    return met.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min_by(point, "frame").alias("f"), F.max_by(point, "frame").alias("l"), F.array_sort(F.collect_list(point)).alias("path"))


def transitions(spells: DataFrame, ball: DataFrame, directions: DataFrame, fps: float = 25.0, config: Events = Events()) -> DataFrame:
    """Events of every spell and what follows it, before shot assists; ``seq`` is their order."""
    c = config
    w = Window.partitionBy("match_id").orderBy("start_frame")
    ev = evidence(spells, ball, c.evidence_reference)
    way = directions.select("match_id", "team", "direction")
    s = spells.join(way, ["match_id", "team"], "left").join(ev, KEYS)
    nxt = F.struct("team", "track_id", "start_frame", "start_time", "end_frame", "start_xy", "ball_start_xy", "is_goalkeeper", "evidence")
    s = s.withColumn("nxt", F.lead(nxt).over(w)).withColumn("order", F.row_number().over(w))
    n = F.col("nxt")
    has = n.isNotNull()
    keeper_next = n["is_goalkeeper"] & (n["team"] != F.col("team"))
    limit = F.col("contact_end") + int(c.max_flight * fps)
    s = s.withColumn("from_frame", F.col("contact_end")).withColumn("to_frame", F.when(has, F.least(n["start_frame"] + F.when(keeper_next, int(c.keeper_tail * fps)).otherwise(0), limit)).otherwise(limit))
    s = s.join(flights(s, ball, c.trim_cosine), KEYS, "left")
    start = F.coalesce("ball_end_xy", "end_xy")
    receive = F.coalesce(n["ball_start_xy"], n["start_xy"])
    gap = lambda a, b: distance(a["x"], a["y"], b["x"], b["y"])
    goal_x = F.when(F.col("direction") > 0, LENGTH).otherwise(0.0)
    f, last = F.col("f"), F.col("l")
    vx, vy = last["x"] - f["x"], last["y"] - f["y"]
    travelled = F.sqrt(vx * vx + vy * vy)
    seconds = F.greatest((last["frame"] - f["frame"]) / fps, F.lit(1e-3))
    t = F.try_divide(goal_x - f["x"], vx)
    s = s.withColumns({"start": start, "receive": receive, "goal_x": goal_x, "carried": gap(F.col("start_xy"), F.col("end_xy")), "y_goal": f["y"] + vy * t})
    shot = (
        F.col("direction").isNotNull()
        & (F.col("n") >= 2)
        & (F.abs(f["x"] - F.col("goal_x")) <= c.shot_range)
        & (travelled >= c.shot_travel)
        & (travelled / seconds >= c.shot_speed)
        & ((F.abs(last["x"] - F.col("goal_x")) <= c.shot_arrival) | F.coalesce(keeper_next, F.lit(False)))
        & (F.abs(vx) >= 1e-6)
        & (F.signum(vx) == F.signum("direction"))
        & (t > 0)
        & in_goal_mouth(F.col("y_goal"), c.shot_margin)
    )
    beyond = F.get(F.filter("path", lambda p: F.when(F.col("direction") > 0, p["x"] >= F.col("goal_x") - 0.5).otherwise(p["x"] <= F.col("goal_x") + 0.5)), F.lit(0))
    result = (
        F.when(beyond.isNotNull() & in_goal_mouth(beyond["y"]), F.struct(F.lit("Goal").alias("o"), F.lit(0.75).alias("p")))
        .when(beyond.isNotNull(), F.struct(F.lit("Off Target").alias("o"), F.lit(0.7).alias("p")))
        .when(has & n["is_goalkeeper"], F.struct(F.lit("Saved").alias("o"), F.lit(0.65).alias("p")))
        .when(has & (F.abs(n["start_xy"]["x"] - F.col("goal_x")) < c.block_range), F.struct(F.lit("Blocked").alias("o"), F.lit(0.5).alias("p")))
        .when(in_goal_mouth(F.col("y_goal")), F.struct(F.lit("Saved").alias("o"), F.lit(0.4).alias("p")))
        .otherwise(F.struct(F.lit("Off Target").alias("o"), F.lit(0.45).alias("p")))
    )
    s = s.withColumns({"shot": F.coalesce(shot, F.lit(False)), "result": result, "flight": F.greatest(n["start_time"] - F.col("end_time"), F.lit(1e-3)), "far": gap(F.col("start"), F.col("receive"))})
    same = (F.col("team") > 0) & (n["team"] > 0) & (F.col("team") == n["team"])
    near = gap(n["start_xy"], F.col("end_xy"))
    right = F.col("direction") > 0
    sx, sy, ex, ey = F.col("start.x"), F.col("start.y"), F.col("receive.x"), F.col("receive.y")
    wide = (sy < (WIDTH - BOX_WIDTH) / 2) | (sy > (WIDTH + BOX_WIDTH) / 2)
    cross = F.coalesce(F.when(right, sx > 2 * LENGTH / 3).otherwise(sx < LENGTH / 3) & wide & in_box(ex, ey, right) & F.col("direction").isNotNull(), F.lit(False))
    clear = F.coalesce(F.when(right, sx < LENGTH * c.clearance_third).otherwise(sx > LENGTH * (1 - c.clearance_third)) & (F.col("far") >= c.clearance_length) & F.col("direction").isNotNull(), F.lit(False))
    on = ~F.col("shot") & has & (F.col("flight") <= c.max_flight)
    tackle = on & ~same & (near <= c.tackle_reach) & (F.col("flight") <= c.tackle_time)
    played = on & ~tackle & (F.col("far") >= c.min_pass) & (F.col("far") <= F.when(F.col("is_goalkeeper"), c.max_keeper_pass).otherwise(c.max_pass))
    rest = round(1 - c.evidence_floor, 9)  # (0.45, and not a little less, which would turn halves down)
    weigh = lambda prior, e: half_even(prior * (c.evidence_floor + rest * e), 3)

    def own(slot: int, when: Column, event: Column, outcome: Column, begin: Column, end: Column, prior: Column) -> Column:
        return F.when(when, F.struct(F.lit(slot).alias("slot"), F.col("team").alias("team"), F.col("track_id").alias("track_id"), event.alias("event"), outcome.alias("outcome"), F.col("end_frame").alias("frame"), F.col("end_time").alias("time_s"), begin.alias("start"), end.alias("end"), weigh(prior, F.col("evidence")).alias("confidence")))

    def theirs(slot: int, when: Column, event: str, outcome: str) -> Column:
        return F.when(when, F.struct(F.lit(slot).alias("slot"), n["team"].alias("team"), n["track_id"].alias("track_id"), F.lit(event).alias("event"), F.lit(outcome).alias("outcome"), n["start_frame"].alias("frame"), n["start_time"].alias("time_s"), n["start_xy"].alias("start"), F.lit(None).cast("struct<x:double,y:double>").alias("end"), weigh(F.lit(0.55), n["evidence"]).alias("confidence")))

    kind = F.when(cross, "Cross").otherwise("Pass")
    dribbled = (F.col("carried") >= c.carry) & (F.col("end_time") - F.col("start_time") > c.carry_time)
    parts = [
        own(0, dribbled, F.lit("Dribble"), F.when(F.coalesce(n["team"] == F.col("team"), F.lit(False)), "Successful").otherwise("Failed"), F.col("start_xy"), F.col("end_xy"), F.lit(0.55)),
        own(1, F.col("shot"), F.lit("Shot"), F.col("result.o"), F.col("start"), F.struct(F.col("goal_x").alias("x"), F.col("y_goal").alias("y")), F.col("result.p")),
        theirs(2, tackle, "Tackle", "Successful"),
        own(3, played & same, kind, F.lit("Successful"), F.col("start"), F.col("receive"), F.when(cross | (F.col("far") >= c.long_pass), 0.6).otherwise(0.75)),
        own(4, played & ~same & clear, F.lit("Clearance"), F.lit(""), F.col("start"), F.col("receive"), F.lit(0.5)),
        own(5, played & ~same & ~clear, kind, F.lit("Unsuccessful"), F.col("start"), F.col("receive"), F.lit(0.65)),
        theirs(6, played & ~same & ~clear, "Interception", ""),
    ]
    out = s.select("match_id", "order", F.explode(F.array_compact(F.array(*parts))).alias("e"))
    return out.select("match_id", (F.col("order") * 10 + F.col("e.slot")).cast("bigint").alias("seq"), F.col("e.team").cast("int").alias("team"), F.col("e.track_id").cast("int").alias("track_id"), "e.event", "e.outcome", F.col("e.frame").cast("bigint").alias("frame"), "e.time_s", F.col("e.start.x").alias("start_x"), F.col("e.start.y").alias("start_y"), F.col("e.end.x").alias("end_x"), F.col("e.end.y").alias("end_y"), "e.confidence")


def shot_assists(events: DataFrame, config: Events = Events()) -> DataFrame:
    """The pass that set up a shot becomes a Shot Assist. Shots choose in order, each the latest
    pass left, so a match (a bounded group) is folded at a time."""

    def relabel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq").reset_index(drop=True)
        free = ((pdf["event"] == "Pass") & (pdf["outcome"] == "Successful") & pdf["end_x"].notna()).to_numpy().copy()
        for shot in pdf[pdf["event"] == "Shot"].itertuples():
            wait = shot.time_s - pdf["time_s"]
            reach = ((pdf["end_x"] - shot.start_x) ** 2 + (pdf["end_y"] - shot.start_y) ** 2) ** 0.5
            fits = free & (pdf["team"] == shot.team) & (wait > 0) & (wait <= config.assist_time) & (reach <= config.assist_reach)
            if fits.any():
                chosen = pdf.index[fits][pdf.loc[fits, "time_s"].to_numpy().argmax()]
                free[chosen] = False
                pdf.loc[chosen, "event"] = "Shot Assist"
                pdf.loc[chosen, "confidence"] = min(pdf.loc[chosen, "confidence"], 0.6)
        return pdf

    return events.groupBy("match_id").applyInPandas(relabel, EVENT)


def build_events(spells: DataFrame, ball: DataFrame, directions: DataFrame, fps: float = 25.0, config: Events = Events()) -> DataFrame:
    return shot_assists(transitions(spells, ball, directions, fps, config), config)


def tagger_rows(events: DataFrame, half: int = 1) -> DataFrame:
    """Events as the tagging app stores them: grid coordinates to one place, clock, source."""
    h = F.lit(half)
    x, y = to_tagger(F.col("start_x"), F.col("start_y"), h)
    x2, y2 = to_tagger(F.col("end_x"), F.col("end_y"), h)
    mins, secs = clock(F.col("time_s"))
    none = F.col("end_x").isNull()
    return events.select(
        "match_id", "seq", "team", "track_id", "event", "outcome", mins.alias("mins"), secs.alias("secs"), half_even(x, 1).alias("x"), half_even(y, 1).alias("y"),
        F.when(~none, half_even(x2, 1)).alias("x2"), F.when(~none, half_even(y2, 1)).alias("y2"), h.alias("half"), F.lit("ai").alias("source"), half_even(F.col("confidence"), 2).alias("confidence"), "frame",
    )
