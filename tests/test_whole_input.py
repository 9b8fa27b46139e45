"""Registered queries take all rows of their input."""

from __future__ import annotations

from tactigrid.plans.registry import QUERIES


def test_no_rows_are_left_out(spark, tmp_path):
    spark.range(1, 121).selectExpr("id AS event_id").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.event_id for r in QUERIES["tile_windows"](spark, str(tmp_path)).select("event_id").collect()} == set(range(1, 121))
    # k is 1 to 12 here
    assert [r.match_id for r in QUERIES["homography_fit"](spark, str(tmp_path)).collect()] == [0]
