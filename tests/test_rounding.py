"""Halves: numbers that lie, or seem to lie, just between two others."""

from __future__ import annotations

import duckdb

from tactigrid.functions.geometry import half_even, rounded
from tactigrid.operators.events import EVENT, tagger_rows, transitions

SPELL = "match_id bigint, spell int, track_id int, team int, start_frame bigint, end_frame bigint, start_time double, end_time double, start_xy struct<x:double,y:double>, end_xy struct<x:double,y:double>, ball_start_xy struct<x:double,y:double>, ball_end_xy struct<x:double,y:double>, is_goalkeeper boolean, contact_start bigint, contact_end bigint"
NUMBERS = [0.545, 0.125, 0.135, 0.4825, 0.48250000000000004, 0.5046875, 0.0015625, -0.0015625, -2.5, 1e300, 0.0, None]


def test_halves_are_rounded_as_sql_does(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(NUMBERS)], "i int, v double")
    for digits in (0, 1, 2, 3, 6):
        got = {r.i: (r.a, r.b) for r in rows.select("i", rounded(rows.v, digits).alias("a"), half_even(rows.v, digits).alias("b")).collect()}
        for i, v in enumerate(NUMBERS):
            assert got[i] == duckdb.execute("SELECT round($1::DOUBLE, $2::INT), round_even($1::DOUBLE, $2::INT)", [v, digits]).fetchone(), (v, digits)


def test_confidences_just_above_a_half_go_up(spark):
    row = (1, 1, 1, 1, "Pass", "Unsuccessful", 712, 28.5, 105.0, 30.0, 40.0, 30.0, 0.545)
    assert tagger_rows(spark.createDataFrame([row], EVENT), 2).first().confidence == 0.55  # (0.545 is a little more than 0.545)


def test_two_fifths_of_the_evidence_arent_taken_for_less(spark):
    """0.65 * (0.55 + 0.45 * 0.4) is a little more than 0.4745 and goes up, if the weight is 0.45."""
    at = lambda x: {"x": x, "y": 30.0}
    cases = [(1, 1, 3, 1, 0, 4, 0.0, 0.16, at(33.0), at(33.0), None, None, False, 0, 4), (1, 2, 18, 2, 30, 34, 1.2, 1.36, at(51.0), at(51.0), None, None, False, 30, 34)]
    ball = spark.createDataFrame([(1, f, f / 25, 40.0 if f < 2 else None, 30.0 if f < 2 else None, 0.9) for f in range(5)], "match_id bigint, frame bigint, time_s double, pitch_x double, pitch_y double, conf double")
    ways = spark.createDataFrame([(1, 1, 1), (1, 2, -1)], "match_id bigint, team int, direction int")
    passed = transitions(spark.createDataFrame(cases, SPELL), ball, ways).where("event = 'Pass'").first()
    assert (passed.outcome, passed.confidence) == ("Unsuccessful", 0.475)
