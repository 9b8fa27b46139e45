"""The tagging app's tables as relations: matches, events, edits, counts, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tactigrid.config import GRID_X, GRID_Y
from tactigrid.functions.geometry import clamp, half_even, half_up

PASS_LIKE = ("Pass", "Cross", "Shot Assist")

# The event kinds in their order, whether each has an end point, its outcomes and colour.
VOCABULARY = [
    ("Pass", True, ["Successful", "Unsuccessful"], "#4fd6a0"),
    ("Cross", True, ["Successful", "Unsuccessful"], "#7ab8ff"),
    ("Shot", True, ["Goal", "Saved", "Off Target", "Blocked"], "#ffb020"),
    ("Shot Assist", True, ["Successful"], "#ffd88a"),
    ("Dribble", True, ["Successful", "Failed"], "#c58cff"),
    ("Tackle", False, ["Successful", "Unsuccessful"], "#ff8a5c"),
    ("Interception", False, [], "#ffc861"),
    ("Block", False, [], "#9fb0cc"),
    ("Clearance", True, [], "#6f8fbf"),
]
OTHER_COLOUR = "#8fa3c4"
KIND = "position int, kind string, arrow boolean, outcomes array<string>, colour string, own boolean"


def vocabulary(spark: SparkSession) -> DataFrame:
    """The event kinds as a table; ``own`` says that an analyst added it (none so far)."""
    return spark.createDataFrame([(i, *row, False) for i, row in enumerate(VOCABULARY)], KIND)


def with_kinds(kinds: DataFrame, added: DataFrame) -> DataFrame:
    """Kinds (column ``kind``) added that aren't there, after the others, in order of name: one
    click, no outcomes."""
    new = added.select(F.trim("kind").alias("kind")).where("kind <> ''").distinct().join(kinds, "kind", "left_anti")
    last = kinds.agg(F.max("position")).first()[0]
    rank = F.row_number().over(Window.orderBy("kind"))  # a handful of names that a person typed
    rows = new.withColumn("rank", rank)
    return kinds.unionByName(rows.select((F.lit(-1 if last is None else last) + F.col("rank")).cast("int").alias("position"), "kind", F.lit(False).alias("arrow"), F.array().cast("array<string>").alias("outcomes"), F.lit(OTHER_COLOUR).alias("colour"), F.lit(True).alias("own")))


def without_kinds(kinds: DataFrame, removed: DataFrame) -> DataFrame:
    """Kinds less those of ``removed`` that an analyst added; the others can't go."""
    return kinds.join(removed.select("kind", F.lit(True).alias("own")).distinct(), ["kind", "own"], "left_anti").select(*kinds.columns)


def kinds_used(events: DataFrame) -> DataFrame:
    """The kinds that a match's events have, for a menu."""
    return events.where("event <> ''").select("match_id", "event").distinct()


def team_index(name: Column, one: Column, two: Column) -> Column:
    """1 or 2 for the match's teams, 0 for any other name."""
    return F.when(name == one, 1).when(name == two, 2).otherwise(0)


def click_to_grid(cx: Column, cy: Column, pad: Column, width: Column, height: Column, half: Column) -> tuple[Column, Column]:
    """A click on the drawn pitch as stored: on the grid, to one place, and turned round in the
    second half."""
    x = half_up(clamp((cx - pad) / width * GRID_X, 0.0, GRID_X), 1)
    y = half_up(clamp((cy - pad) / height * GRID_Y, 0.0, GRID_Y), 1)
    return F.when(half == 2, half_up(GRID_X - x, 1)).otherwise(x), F.when(half == 2, half_up(GRID_Y - y, 1)).otherwise(y)


def placed(clicks: DataFrame) -> DataFrame:
    """Hand-tagged events of clicks (team, player, event, outcome, t, x, y, x2, y2, half): the clock
    from the video's time, and a person as the source."""
    t = F.coalesce("t", F.lit(0.0))
    mins, secs = F.floor(t / 60).cast("int"), F.floor(t % 60).cast("int")
    rest = [c for c in clicks.columns if c not in ("t", "half")]
    return clicks.select(*rest, mins.alias("mins"), secs.alias("secs"), F.col("half").cast("int").alias("half"), F.lit("manual").alias("source"), t.alias("t"))


def appended(events: DataFrame, imported: DataFrame) -> DataFrame:
    """Events with imported ones after them; columns that one side lacks are null there."""
    return events.unionByName(imported, allowMissingColumns=True)


def event_at(events: DataFrame, clicks: DataFrame, axis: float, reach: float = 9.0) -> DataFrame:
    """(click_id, event_id): the event drawn nearest to each click (click_id, match_id, x, y, width,
    duration_s) on the timeline, events of team 2 below the axis, others above, less than
    ``reach`` away (height counts a quarter). Events (event_id, match_id, t, team_no) that can be
    near in time are met in buckets of a second's share of the width. Of those drawn at one place
    the smallest id goes on, as it is the one that a click there would get."""
    # (an event is drawn at t / duration * width, in this order: places that are equally far stay so)
    per = F.col("duration_s") / F.col("width")
    c = clicks.withColumns({"at": F.col("x") * per, "span": per * reach + 1e-6})
    c = c.withColumn("b", F.explode(F.sequence(F.floor(F.col("at") - F.col("span")).cast("bigint"), F.floor(F.col("at") + F.col("span")).cast("bigint"))))
    below = F.coalesce(F.col("team_no") == 2, F.lit(False))
    e = events.groupBy("match_id", "t", below.alias("below")).agg(F.min("event_id").alias("event_id")).withColumn("b", F.floor("t").cast("bigint"))
    d = F.abs(F.col("t") / F.col("duration_s") * F.col("width") - F.col("x")) + F.abs(F.when(F.col("below"), axis + 15.0).otherwise(axis - 15.0) - F.col("y")) * 0.25
    return c.join(e, ["match_id", "b"]).withColumn("d", d).where(F.col("d") < reach).groupBy("click_id").agg(F.min_by("event_id", F.struct("d", "event_id")).alias("event_id"))


def recent_jobs(jobs: DataFrame, most: int = 25) -> DataFrame:
    return jobs.orderBy(F.desc("created"), "job_id").limit(most)


def job_status(jobs: DataFrame, result: str, wanted: bool = True) -> DataFrame:
    """Jobs with their result, parsed by the schema ``result``, where it is wanted and they are done."""
    parsed = F.when(F.lit(wanted) & (F.col("status") == "done"), F.from_json("result", result))
    return jobs.withColumn("result", parsed)


def may_cancel(status: Column) -> Column:
    return status.isin("queued", "running")


def may_delete(status: Column) -> Column:
    return status != "running"


def start_problem(busy: Column, name: Column, size: Column, suffixes: tuple[str, ...] = (".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v")) -> Column:
    """Why an analysis can't start (null: it can), the first reason that holds."""
    suffix = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^.](\.[^./]*)$", 1))
    return F.when(busy, "busy").when(F.coalesce(name, F.lit("")) == "", "no file").when(~suffix.isin(*suffixes), "unsupported").when(size == 0, "empty")


def positive_number(text: Column) -> Column:
    """An option that must be above zero, or null."""
    n = F.when(~text.rlike(r"[0-9.]\s*[dDfF]\s*$"), text.try_cast("double"))
    return F.when(~F.isnan(n) & (n > 0), n)


def identity_detail(before: Column, after: Column, merges: Column) -> Column:
    """What re-linking did, in words."""
    share = F.floor(100.0 * merges / before + 0.5).cast("bigint").cast("string")
    none = F.concat(after.cast("string"), F.lit(" identities, none needed re-linking"))
    some = F.concat(before.cast("string"), F.lit(" tracked fragments joined into "), after.cast("string"), F.lit(" players ("), share, F.lit("% were duplicates)"))
    return F.when(F.coalesce(before, F.lit(0)) == 0, "—").when(F.coalesce(merges, F.lit(0)) == 0, none).otherwise(some)


def diagnostics(videos: DataFrame, **parts: DataFrame) -> DataFrame:
    """(match_id, diagnostics): one JSON object a match, of videos (match_id, width, height, fps,
    frames, stride) and of any ``parts``, tables of one row a match, each under its name."""
    v = videos.select("match_id", F.struct("width", "height", half_even(F.col("fps"), 2).alias("fps"), "frames", half_even(F.col("frames") / F.col("fps"), 1).alias("duration_s")).alias("video"), F.struct("stride", half_even(F.col("fps") / F.col("stride"), 2).alias("effective_fps")).alias("sampling"))
    for name, df in parts.items():
        v = v.join(df.select("match_id", F.struct(*[c for c in df.columns if c != "match_id"]).alias(name)), "match_id", "left")
    return v.select("match_id", F.to_json(F.struct(*[c for c in v.columns if c != "match_id"])).alias("diagnostics"))


def event_time(t: Column | None = None) -> Column:
    """Seconds into the match: ``t``, the time of a row to a part of a second, where it is known,
    else by the clock."""
    by_clock = (F.coalesce("mins", F.lit(0)) * 60 + F.coalesce("secs", F.lit(0))).cast("double")
    return by_clock if t is None else F.coalesce(F.nanvl(t, F.lit(None).cast("double")), by_clock)


def imported_time(fps: float) -> Column:
    return F.coalesce(F.when(F.col("frame") > 0, F.col("frame") / fps), event_time())


def match_list(matches: DataFrame, events: DataFrame, most: int = 100) -> DataFrame:
    """Newest matches with how many events they have."""
    n = events.groupBy("match_id").agg(F.count("*").alias("n_events"))
    return matches.join(n, "match_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0))).orderBy(F.desc("created"), "match_id").limit(min(most, 500))


def search(events: DataFrame, text: str = "", team: str | None = None, event: str | None = None, source: str | None = None, order: str = "t", ascending: bool = True) -> DataFrame:
    """Rows that match every filter given and hold ``text`` (case doesn't count) in a name."""
    out = events
    for column, value in (("team", team), ("event", event), ("source", source)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if text:
        out = out.where(F.lower(F.concat_ws("\u0001", "team", "player", "event", "outcome")).contains(text.lower()))
    out = out.withColumn("t", event_time())
    return out.orderBy(F.asc(order) if ascending else F.desc(order), "event_id")


def counted(events: DataFrame, keys: list[str]) -> DataFrame:
    """What the browser counts, at any grain."""
    e = lambda *k: F.col("event").isin(*k)
    done = e("Pass", "Cross") & (F.col("outcome") == "Successful") | e("Shot Assist")
    return events.groupBy(*keys).agg(
        F.count("*").alias("events"), F.count_if(e(*PASS_LIKE)).alias("passes"), F.count_if(done).alias("passes_completed"), F.count_if(e("Cross")).alias("crosses"), F.count_if(e("Shot")).alias("shots"),
        F.count_if(e("Shot") & F.col("outcome").isin("Goal", "Saved")).alias("shots_on_target"), F.count_if(e("Shot") & (F.col("outcome") == "Goal")).alias("goals"), F.count_if(e("Shot Assist")).alias("shot_assists"),
        F.count_if(e("Dribble")).alias("dribbles"), F.count_if(e("Dribble") & (F.col("outcome") == "Successful")).alias("dribbles_completed"),
        *[F.count_if(e(k)).alias(n) for k, n in (("Tackle", "tackles"), ("Interception", "interceptions"), ("Block", "blocks"), ("Clearance", "clearances"))],
    )


def team_stats(events: DataFrame) -> DataFrame:
    """Per team, with the share of on-ball events as a stand-in for possession."""
    out = counted(events, ["match_id", "team"])
    ball = F.col("passes") + F.col("shots") + F.col("dribbles") + F.col("clearances")
    whole = F.sum(ball).over(Window.partitionBy("match_id"))
    return out.withColumns({"possession": F.when(whole > 0, 100.0 * ball / whole).otherwise(0.0), "pass_accuracy": F.when(F.col("passes") > 0, 100.0 * F.col("passes_completed") / F.col("passes")).otherwise(0.0)})


def player_stats(events: DataFrame) -> DataFrame:
    out = counted(events.withColumn("player", F.coalesce(F.nullif("player", F.lit("")), F.lit("—"))), ["match_id", "team", "player"])
    accuracy = F.when(F.col("passes") > 0, F.floor(100.0 * F.col("passes_completed") / F.col("passes") + 0.5)).otherwise(F.lit(0)).cast("bigint")
    return out.withColumns({"defensive": F.col("tackles") + F.col("interceptions") + F.col("blocks") + F.col("clearances"), "accuracy": accuracy})


def live_score(events: DataFrame) -> DataFrame:
    return events.groupBy("match_id", "team").agg(F.count_if((F.col("event") == "Shot") & (F.col("outcome") == "Goal")).alias("goals"))


def versus(home: Column, away: Column) -> tuple[Column, Column]:
    """Either side's share of a bar; 0 where there is nothing."""
    whole = home + away
    return F.when(whole > 0, home / whole).otherwise(0.0), F.when(whole > 0, away / whole).otherwise(0.0)


def feed(events: DataFrame, most: int = 40) -> DataFrame:
    return events.withColumn("t", event_time()).orderBy(F.desc("t"), F.desc("event_id")).limit(most)


def apply_edits(events: DataFrame, edits: DataFrame) -> DataFrame:
    """Last write wins: edits (event_id, version, op, columns...) on top of ``events``; op 'delete'
    removes. Coordinates of a row can't be edited."""
    fixed = [c for c in ("match_id", "x", "y", "x2", "y2") if c in events.columns]
    last = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("version")))
    newest = edits.withColumn("__r", last).where("__r = 1").drop("__r")
    free = [c for c in events.columns if c in edits.columns and c not in ("event_id", *fixed)]
    new = newest.select("event_id", F.col("op").alias("__op"), *[F.col(c).alias(f"__{c}") for c in free])
    out = events.join(new, "event_id", "left").where(F.coalesce("__op", F.lit("")) != "delete")
    return out.select(*[F.when(F.col("__op").isNotNull(), F.coalesce(f"__{c}", c)).otherwise(F.col(c)).alias(c) if c in free else F.col(c) for c in events.columns])


def rename_teams(events: DataFrame, names: dict[str, str]) -> DataFrame:
    """All renames at once, so that two teams can swap names."""
    out = F.col("team")
    case = None
    for old, new in names.items():
        case = F.when(F.col("team") == old, new) if case is None else case.when(F.col("team") == old, new)
    return events.withColumn("team", case.otherwise(out)) if case is not None else events


def name_tracks(events: DataFrame, names: DataFrame) -> DataFrame:
    """Players of analysed events named by ``names`` (track_id, name)."""
    out = events.join(names, "track_id", "left")
    return out.select(*[F.when(F.col("source") == "ai", F.coalesce("name", "player")).otherwise(F.col("player")).alias("player") if c == "player" else F.col(c) for c in events.columns])


def tracked_players(events: DataFrame) -> DataFrame:
    return events.where((F.col("source") == "ai") & F.col("track_id").isNotNull()).select("match_id", "track_id").distinct()


def events_per_track(events: DataFrame) -> DataFrame:
    return events.where(F.col("track_id").isNotNull()).groupBy("match_id", "track_id").agg(F.count("*").alias("n"))


def source_of(events: DataFrame) -> DataFrame:
    """A match's source: that of its events, 'mixed' where there are several."""
    kinds = F.collect_set(F.coalesce(F.nullif("source", F.lit("")), F.lit("manual")))
    return events.groupBy("match_id").agg(kinds.alias("k")).select("match_id", F.when(F.size("k") > 1, "mixed").otherwise(F.get("k", F.lit(0))).alias("source"))


def outcome_class(outcome: Column) -> Column:
    return F.when(outcome == "Goal", "goal").when(outcome.isin("Successful", "Saved"), "good").otherwise("bad")


def fade(gap_s: Column) -> Column:
    """How strongly a mark is drawn that far from the playhead."""
    return F.when(F.abs(gap_s) > 25, 0.3).when(F.abs(gap_s) > 8, 0.55).otherwise(1.0)


def roster(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def timeline_length(events: DataFrame, video_s: float) -> DataFrame:
    return events.groupBy("match_id").agg(F.greatest(F.lit(video_s), F.max(event_time()) + 10, F.lit(60.0)).alias("duration_s"))


def job_progress(stage: Column, fraction: Column, stages: dict[str, tuple[float, float]]) -> Column:
    """Progress of a job from its stage's span of the whole and how far that stage is."""
    out = F.lit(0.0)
    for name, (start, end) in stages.items():
        out = F.when(stage == name, start + (end - start) * F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0))).otherwise(out)
    return out


def may_replace(state: Column) -> Column:
    return state.isNull() | state.isin("done", "failed", "cancelled")
