"""Joins by range of frames, as joins on equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows are met by range; both sides are cut into buckets of so many frames to join on equality.
BUCKET = 256


def between_frames(spans: DataFrame, rows: DataFrame, low: str, high: str, on: tuple[str, ...] = ("match_id",)) -> DataFrame:
    """``spans`` with every row of the same match (and what else is in ``on``) whose frame is from
    ``low`` to ``high``."""
    cut = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / BUCKET), F.floor(F.greatest(low, high) / BUCKET))))
    right = rows.withColumn("__bucket", F.floor(F.col("frame") / BUCKET))
    return cut.join(right, [*on, "__bucket"]).where(F.col("frame").between(F.col(low), F.col(high))).drop("__bucket")
