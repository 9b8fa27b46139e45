"""Marks of a timeline that are as far from a click as others."""

from __future__ import annotations

from tactigrid.operators import tagstore as A


def test_marks_equally_far_from_a_click(spark):
    # 1301 s and 1303 s are drawn at 433 2/3 and 434 1/3, as far from 434; the second of two at one place has the smaller id
    events = spark.createDataFrame([(9, 1, 1303.0, 1), (5, 1, 1301.0, 1), (7, 1, 1301.0, 2), (4, 1, 1303.0, 2), (3, 2, 1302.0, 1)], "event_id bigint, match_id bigint, t double, team_no int")
    clicks = spark.createDataFrame([(k, 1, 434.0, y, 1000.0, 3000.0) for k, y in ((1, 25.0), (2, 55.0))] + [(3, 1, 443.0 + 1 / 3, 25.0, 1000.0, 3000.0), (4, 3, 434.0, 25.0, 1000.0, 3000.0)], "click_id bigint, match_id bigint, x double, y double, width double, duration_s double")
    want = {}
    for c in clicks.collect():
        near = [(abs(e.t / c.duration_s * c.width - c.x) + abs((55.0 if e.team_no == 2 else 25.0) - c.y) * 0.25, e.event_id) for e in events.collect() if e.match_id == c.match_id]
        if near and min(near)[0] < 9:
            want[c.click_id] = min(near)[1]
    assert {r.click_id: r.event_id for r in A.event_at(events, clicks, 40.0).collect()} == want


def test_marks_in_many_places_as_brute_force_has_them(spark):
    events = spark.createDataFrame([(i, i % 2, float(i * 37 % 2700), 1 + i % 3 % 2) for i in range(900)], "event_id bigint, match_id bigint, t double, team_no int")
    clicks = spark.createDataFrame([(i, i % 2, float(i * 11 % 900), float(i * 7 % 80), 1000.0, 3000.0) for i in range(300)], "click_id bigint, match_id bigint, x double, y double, width double, duration_s double")
    e, want = events.collect(), {}
    for c in clicks.collect():
        near = [(abs(r.t / c.duration_s * c.width - c.x) + abs((55.0 if r.team_no == 2 else 25.0) - c.y) * 0.25, r.event_id) for r in e if r.match_id == c.match_id]
        if near and min(near)[0] < 9:
            want[c.click_id] = min(near)[1]
    assert {r.click_id: r.event_id for r in A.event_at(events, clicks, 40.0).collect()} == want
