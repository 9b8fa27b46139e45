"""Event rules on hand-built spells: one rule a case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tactigrid.operators.events import build_events, tagger_rows

SPELL = "match_id bigint, spell int, track_id int, team int, start_frame bigint, end_frame bigint, start_time double, end_time double, start_xy struct<x:double,y:double>, end_xy struct<x:double,y:double>, ball_start_xy struct<x:double,y:double>, ball_end_xy struct<x:double,y:double>, is_goalkeeper boolean, contact_start bigint, contact_end bigint"
BALL = "match_id bigint, frame bigint, time_s double, pitch_x double, pitch_y double"


def rows(match, cases):
    """cases: (track, team, first, last, start, end, keeper)"""
    return [(match, i + 1, t, team, a, b, a / 25, b / 25, s, e, None, None, k, a, b) for i, (t, team, a, b, s, e, k) in enumerate(cases)]


def fly(match, first, last, start, end):
    n = last - first
    return [(match, first + i, (first + i) / 25, start[0] + (end[0] - start[0]) * i / n, start[1] + (end[1] - start[1]) * i / n) for i in range(n + 1)]


def spell(t, team, a, b, s, e=None, keeper=False):
    return (t, team, a, b, s, e or s, keeper)


# Team 1 plays to the right, team 2 to the left; every case is made from the rule it shows.
HOME_KEEPER = spell(1, 1, 745, 760, (1.5, 33.0), keeper=True)
STRIKER = spell(21, 2, 700, 708, (17.0, 30.0))
CASES = {
    # team-mates 14.4 m apart, 0.56 s later
    "pass": ([spell(14, 2, 30, 44, (61.0, 47.0)), spell(16, 2, 58, 70, (49.0, 55.0))], None, {("Pass", "Successful", 14)}),
    # to an opponent 19.7 m away: too short for a clearance, too far for a duel
    "lost": ([spell(3, 1, 30, 44, (33.0, 12.0)), spell(18, 2, 70, 82, (51.0, 20.0))], None, {("Pass", "Unsuccessful", 3), ("Interception", "", 18)}),
    # an opponent takes over 2.8 m away, 0.4 s later; or 1.4 s later, which is neither duel nor pass
    "duel": ([spell(20, 2, 400, 410, (70.0, 50.0)), spell(6, 1, 420, 433, (72.0, 52.0))], None, {("Tackle", "Successful", 6)}),
    "slow duel": ([spell(20, 2, 400, 410, (70.0, 50.0)), spell(6, 1, 445, 460, (72.0, 52.0))], None, set()),
    # over the line inside the posts, over it beside them, stopped by the keeper, by somebody else
    "in": ([STRIKER, HOME_KEEPER], (708, 722, (17.0, 30.0), (-0.4, 33.0)), {("Shot", "Goal", 21)}),
    "beside": ([STRIKER, HOME_KEEPER], (708, 722, (17.0, 30.0), (-0.4, 39.5)), {("Shot", "Off Target", 21)}),
    "held": ([STRIKER, spell(1, 1, 717, 730, (4.0, 33.0), keeper=True)], (708, 716, (17.0, 30.0), (4.0, 33.0)), {("Shot", "Saved", 21)}),
    "in the way": ([STRIKER, spell(5, 1, 717, 730, (6.0, 32.5))], (708, 716, (17.0, 30.0), (6.0, 32.5)), {("Shot", "Blocked", 21)}),
    # at the goal, but ten metres beside it: no shot, and nobody gets it
    "past": ([STRIKER], (708, 722, (17.0, 30.0), (-0.4, 52.0)), set()),
    # from the wing of the last third into the box
    "from the wing": ([spell(15, 2, 900, 908, (24.0, 60.0)), spell(22, 2, 925, 935, (9.0, 30.0))], None, {("Cross", "Successful", 15)}),
    # 39 m out of the own third, to an opponent
    "cleared": ([spell(13, 2, 1000, 1006, (88.0, 31.0)), spell(8, 1, 1060, 1070, (50.0, 22.0))], None, {("Clearance", "", 13)}),
    # 7.2 m with the ball, then lost
    "run": ([spell(10, 1, 1200, 1230, (50.0, 20.0), (56.0, 24.0)), spell(17, 2, 1260, 1270, (80.0, 40.0))], None, {("Dribble", "Failed", 10), ("Pass", "Unsuccessful", 10), ("Interception", "", 17)}),
    # the pass arrives where the shot is struck, a second before
    "set up": ([spell(18, 2, 1300, 1306, (40.0, 30.0)), spell(19, 2, 1322, 1330, (22.0, 33.0))], (1330, 1344, (22.0, 33.0), (-0.5, 34.0)), {("Shot Assist", "Successful", 18), ("Shot", "Goal", 19)}),
    # more than eight seconds between, and more than 60 m, which only a keeper kicks
    "thread lost": ([spell(14, 2, 30, 44, (61.0, 47.0)), spell(16, 2, 250, 262, (49.0, 55.0))], None, set()),
    "too far": ([spell(4, 1, 30, 44, (30.0, 30.0)), spell(11, 1, 90, 99, (96.0, 42.0))], None, set()),
    "kicked far": ([spell(1, 1, 30, 44, (8.0, 30.0), keeper=True), spell(11, 1, 90, 99, (74.0, 42.0))], None, {("Pass", "Successful", 1)}),
}


@pytest.fixture(scope="module")
def found(spark):
    names = list(CASES)
    s = [r for m, n in enumerate(names) for r in rows(m, CASES[n][0])]
    b = [r for m, n in enumerate(names) for r in (fly(m, *CASES[n][1]) if CASES[n][1] else [(m, 0, 0.0, 52.5, 34.0)])]
    ways = [(m, t, 1 if t == 1 else -1) for m in range(len(names)) for t in (1, 2)]
    events = build_events(spark.createDataFrame(s, SPELL), spark.createDataFrame(b, BALL), spark.createDataFrame(ways, "match_id bigint, team int, direction int"))
    return {n: [r for r in events.collect() if r.match_id == m] for m, n in enumerate(names)}


@pytest.mark.parametrize("name", list(CASES))
def test_rule(found, name):
    assert {(r.event, r.outcome, r.track_id) for r in found[name]} == CASES[name][2]


def test_second_half_is_turned_round(spark):
    e = spark.createDataFrame([(0, 1, 1, 7, "Pass", "Successful", 100, 64.9, 26.25, 17.0, 110.0, 72.0, 0.5)], "match_id bigint, seq bigint, team int, track_id int, event string, outcome string, frame bigint, time_s double, start_x double, start_y double, end_x double, end_y double, confidence double")
    one, two = (tagger_rows(e, h).first() for h in (1, 2))
    assert (one.x, one.y, one.x2, one.y2, one.mins, one.secs) == (30.0, 20.0, 120.0, 80.0, 1, 4)
    assert (two.x, two.y, two.x2, two.y2) == (90.0, 60.0, 0.0, 0.0)


def test_streams_agree_with_batches(spark, tmp_path):
    from tactigrid.operators.possession import steady_holder
    from tactigrid.streaming.stateful import steady_stream

    series = [-1, 1, 1, 1, 1, 2, 2, 2, 2, -1, -1, -1, -1, -1, -1, 8, 8, 8, 8, 8, 1, 1, 8, 8, 1, 1, 1, 1, 1]
    rows = [(m, i, i / 12.5, h, 0 if h < 0 else 1 if h < 5 else 2) for m in (1, 2) for i, h in enumerate(series)]
    schema = "match_id bigint, frame bigint, time_s double, holder int, holder_team int"
    every = spark.createDataFrame(rows, schema)
    for k in range(3):
        every.where(F.col("frame").between(k * 10, k * 10 + 9)).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    q = steady_stream(stream).writeStream.format("memory").queryName("steady").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.match_id, r.frame, r.holder) for r in df.collect())
    assert key(spark.table("steady")) == key(steady_holder(every))
