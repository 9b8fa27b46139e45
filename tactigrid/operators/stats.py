"""Player and team tables, pass network, payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactigrid.config import GOALKEEPER, REFEREE
from tactigrid.functions.geometry import distance, half_even, percent
from tactigrid.operators.tracks import TRACK, physical_stats

PASSES = ("Pass", "Cross", "Shot Assist")


def _is(*names: str):
    return F.col("event").isin(*names)


def player_table(events: DataFrame, people: DataFrame, teams: DataFrame, classes: DataFrame, fps: float = 25.0, step: int = 10, least: int = 25) -> DataFrame:
    """One row per tracked player of ``least`` rows or more, referees aside, with counts of what
    they did and how they moved. Players never located keep their row, with minutes by rows."""
    seen = people.groupBy(*TRACK).agg(F.count("*").alias("rows")).where(F.col("rows") >= least)
    seen = seen.join(classes, TRACK, "left").where(F.coalesce("cls", F.lit(-1)) != REFEREE).join(teams, TRACK, "left")
    done = _is("Pass", "Cross") & (F.col("outcome") == "Successful") | _is("Shot Assist")
    counts = events.groupBy(*TRACK).agg(
        F.count("*").alias("touches"), F.count_if(_is(*PASSES)).alias("passes"), F.count_if(done).alias("passes_completed"), F.count_if(_is("Cross")).alias("crosses"),
        F.count_if(_is("Shot")).alias("shots"), F.count_if(_is("Shot") & (F.col("outcome") == "Goal")).alias("goals"), F.count_if(_is("Shot Assist")).alias("shot_assists"),
        F.count_if(_is("Dribble")).alias("dribbles"), F.count_if(_is("Tackle")).alias("tackles"), F.count_if(_is("Interception")).alias("interceptions"), F.count_if(_is("Clearance")).alias("clearances"),
    )
    moved = physical_stats(people, step).select(*TRACK, "distance_m", "top_kmh", F.col("minutes").alias("m"), "avg_x", "avg_y")
    out = seen.join(counts, TRACK, "left").join(moved, TRACK, "left")
    numbers = [c for c in counts.columns if c not in TRACK]
    role = F.when(F.col("cls") == GOALKEEPER, "goalkeeper").otherwise("player")
    return out.select(*TRACK, F.coalesce("team", F.lit(0)).cast("int").alias("team"), role.alias("role"), *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.coalesce("distance_m", F.lit(0.0)).alias("distance_m"), F.coalesce("top_kmh", F.lit(0.0)).alias("top_kmh"), F.coalesce("m", F.col("rows") / fps / 60).alias("minutes"), "avg_x", "avg_y")


def team_table(events: DataFrame, players: DataFrame, share: DataFrame, matches: DataFrame) -> DataFrame:
    """Totals of both teams of every match of ``matches`` (match_id), also of those that did nothing."""
    spine = matches.select("match_id").distinct().select("match_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("team"))
    shots = _is("Shot")
    done = _is("Pass", "Cross") & (F.col("outcome") == "Successful") | _is("Shot Assist")
    counts = events.groupBy("match_id", "team").agg(
        F.count_if(_is(*PASSES)).alias("passes"), F.count_if(done).alias("passes_completed"), F.count_if(shots).alias("shots"), F.count_if(shots & F.col("outcome").isin("Goal", "Saved")).alias("shots_on_target"),
        F.count_if(shots & (F.col("outcome") == "Goal")).alias("goals"), *[F.count_if(_is(k)).alias(n) for k, n in (("Cross", "crosses"), ("Dribble", "dribbles"), ("Tackle", "tackles"), ("Interception", "interceptions"), ("Clearance", "clearances"))],
    )
    squad = players.groupBy("match_id", "team").agg((F.sum("distance_m") / 1000).alias("km"), F.count("*").alias("players"))
    out = spine.join(counts, ["match_id", "team"], "left").join(squad, ["match_id", "team"], "left").join(share.select("match_id", "team", "share"), ["match_id", "team"], "left")
    numbers = [c for c in counts.columns if c not in ("match_id", "team")]
    zero = out.select("match_id", "team", F.coalesce("share", F.lit(0.0)).alias("possession"), *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.round(F.coalesce("km", F.lit(0.0)), 2).alias("distance_km"), F.coalesce("players", F.lit(0)).alias("players"))
    return zero.withColumn("pass_accuracy", percent(F.col("passes_completed"), F.col("passes")))


def pass_network(events: DataFrame, players: DataFrame, least: int = 2) -> DataFrame:
    """(match_id, team, from_id, to_id, n): completed passes to the team-mate whose mean position
    the ball arrived nearest to; links of ``least`` passes or more, none to oneself."""
    done = _is("Pass", "Cross") & (F.col("outcome") == "Successful") | _is("Shot Assist") & F.col("outcome").isin("Successful", "")
    sent = events.where(done & F.col("end_x").isNotNull()).select("match_id", "team", "seq", F.col("track_id").alias("from_id"), "end_x", "end_y")
    mates = players.where(F.col("avg_x").isNotNull()).select("match_id", "team", F.col("track_id").alias("to_id"), "avg_x", "avg_y")
    d = distance(F.col("avg_x"), F.col("avg_y"), F.col("end_x"), F.col("end_y"))
    got = sent.join(mates, ["match_id", "team"]).groupBy("match_id", "team", "seq", "from_id").agg(F.min_by("to_id", F.struct(d, "to_id")).alias("to_id"))
    return got.where("from_id <> to_id").groupBy("match_id", "team", "from_id", "to_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def pass_nodes(players: DataFrame) -> DataFrame:
    return players.where(F.col("avg_x").isNotNull() & F.col("team").isin(1, 2)).select("match_id", "team", "track_id", half_even(F.col("avg_x"), 1).alias("x"), half_even(F.col("avg_y"), 1).alias("y"), "touches")


def totals(events: DataFrame, people: DataFrame) -> DataFrame:
    seen = people.groupBy("match_id").agg(F.countDistinct("track_id").alias("tracked"), half_even((F.max("time_s") - F.min("time_s")) / 60, 1).alias("minutes"))
    n = events.groupBy("match_id").agg(F.count("*").alias("events"))
    return seen.join(n, "match_id", "left").withColumn("events", F.coalesce("events", F.lit(0)))


def summary(players: DataFrame, teams: DataFrame, links: DataFrame, timeline: DataFrame, total: DataFrame) -> DataFrame:
    """(match_id, payload): the whole of a match as one JSON document."""

    def nested(df: DataFrame, name: str, order: list) -> DataFrame:
        rest = [c for c in df.columns if c != "match_id"]
        return df.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], *rest))).alias(name))

    out = total
    for df, name, order in ((players, "players", [F.col("team"), -F.col("touches"), F.col("track_id")]), (teams, "teams", [F.col("team")]), (links, "links", [-F.col("n"), F.col("from_id"), F.col("to_id")]), (timeline, "timeline", [F.col("bucket")])):
        out = out.join(nested(df, name, order), "match_id", "left")
    return out.select("match_id", F.to_json(F.struct(*[c for c in out.columns if c != "match_id"])).alias("payload"))
