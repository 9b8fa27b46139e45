"""Labels of crops that lie just between two numbers."""

from __future__ import annotations

import duckdb

from tactigrid.operators import detection as D
from tactigrid.plans.core import rounded as as_registered


def test_labels_of_crops_are_rounded_as_sql_does(spark):
    box = spark.createDataFrame([(1751, 1920, 1080, 1457.0, 755.0, 1473.0, 771.0)], "frame bigint, width int, height int, x1 double, y1 double, x2 double, y2 double")
    far = box.selectExpr("frame", "width", "height", "1900e0 AS x1", "1000e0 AS y1", "1916e0 AS x2", "1016e0 AS y2")
    r = as_registered(D.hard_crops(far, box)).first()
    assert (r.cx, r.cy) == duckdb.execute("SELECT round((1457e0 + 8 - 1280) / 640, 6), round((755e0 + 8 - 440) / 640, 6)").fetchone()
