"""Reading labels, events, payloads and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tactigrid.functions.geometry import centre, foot

WIRE = "Team string, Player string, Event string, Outcome string, Mins double, Secs double, X double, Y double, X2 string, Y2 string, half int, source string, confidence double, track_id int, frame bigint, t double"


def box_labels(spark: SparkSession, path: str, width: float, height: float) -> DataFrame:
    """Label files (``cls cx cy w h``, shares of the picture; the first line counts) to pixel boxes."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_name"), "[.]"), 1).alias("name"), F.split(F.trim(F.substring_index(F.trim("value"), "\n", 1)), r"\s+").alias("v"))
    v = lambda i: F.get(F.col("v"), F.lit(i)).try_cast("double")
    return rows.where(F.size("v") >= 5).select("name", v(0).cast("int").alias("cls"), ((v(1) - v(3) / 2) * width).alias("x1"), ((v(2) - v(4) / 2) * height).alias("y1"), ((v(1) + v(3) / 2) * width).alias("x2"), ((v(2) + v(4) / 2) * height).alias("y2"))


def pose_labels(spark: SparkSession, path: str, points: int = 32) -> DataFrame:
    """Pose label files: five numbers of the box, then x, y and visibility of every point."""
    rows = spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_name"), "[.]"), 1).alias("name"), F.transform(F.split(F.trim("value"), r"\s+"), lambda s: s.try_cast("double")).alias("v"))
    at = lambda i, k: F.get(F.col("v"), 5 + i * 3 + k)
    return rows.where(F.size("v") >= 5 + 3 * points).select("name", F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(at(i, 0).alias("x"), at(i, 1).alias("y"), at(i, 2).alias("v"))).alias("keypoints"))


def events_json(spark: SparkSession, path: str) -> DataFrame:
    """Event files: a bare list, or an object with the list under ``events``."""
    raw = spark.read.text(path, wholetext=True)
    kind = f"array<struct<{WIRE.replace(' ', ':').replace(',:', ',')}>>"
    listed = F.coalesce(F.when(F.ltrim("value").startswith("["), F.from_json("value", kind)), F.from_json("value", f"events {kind}")["events"])
    return raw.select(F.col("_metadata.file_name").alias("file"), F.explode(listed).alias("e")).select("file", "e.*")


def match_events(spark: SparkSession, path: str, match_id: int) -> DataFrame:
    """One match of the event store, in order; the filter reaches the files."""
    return spark.read.parquet(path).where(F.col("match_id") == match_id).orderBy("mins", "secs", "event_id")


def _number(c: Column) -> Column:
    """A number (an infinite one too), or null. (A cast would take a letter for a kind after it.)"""
    n = F.when(~c.rlike(r"[0-9.]\s*[dDfF]\s*$"), c.try_cast("double"))
    return F.when(~F.isnan(n), n)


def _whole(c: Column, kind: str) -> Column:
    """A whole number, or null: digits as they stand, as a double holds 15 of them, and other
    numbers less what is after the point."""
    digits = F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(c).try_cast(kind))
    return F.coalesce(digits, _number(c).try_cast(kind))


def payload_rows(raw: DataFrame) -> DataFrame:
    """Event payloads, all columns text as sent, to store rows: texts cut to size, numbers coerced,
    what is no number null, zero track and frame null, no half the first, no source a person."""
    text = lambda c, n, default="": F.substring(F.coalesce(c, F.lit(default)), 1, n).alias(c.lower())
    whole = lambda c, default: F.coalesce(_whole(F.col(c), "int"), F.lit(default))
    return raw.select(
        text("Team", 100), text("Player", 200), text("Event", 100), text("Outcome", 100), whole("Mins", 0).alias("mins"), whole("Secs", 0).alias("secs"),
        *[_number(F.col(c)).alias(c.lower()) for c in ("X", "Y", "X2", "Y2")], F.coalesce(F.nullif(whole("half", 1), F.lit(0)), F.lit(1)).alias("half"), F.substring(F.coalesce(F.nullif("source", F.lit("")), F.lit("manual")), 1, 20).alias("source"),
        _number(F.col("confidence")).alias("confidence"), F.nullif(whole("track_id", 0), F.lit(0)).alias("track_id"), F.nullif(_whole(F.col("frame"), "bigint"), F.lit(0)).alias("frame"),
    )


def sampled(frames: DataFrame, start: int = 0, stop: int | None = None, stride: int = 1) -> DataFrame:
    """Every ``stride``-th frame from ``start`` on, before ``stop``."""
    out = frames.where((F.col("frame") >= start) & ((F.col("frame") - start) % stride == 0))
    return out if stop is None else out.where(F.col("frame") < stop)


def survey(videos: DataFrame, count: int = 16) -> DataFrame:
    """``count`` frames spread evenly over each video (total): (…, i, frame)."""
    last = F.greatest(F.col("total") - 1, F.lit(0))
    return videos.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i")).withColumn("frame", F.floor(F.col("i") * last / max(count - 1, 1)).cast("bigint"))


def probed(videos: DataFrame) -> DataFrame:
    """Video metadata with odd rates (not between 1 and 240) at 25 and negative counts at 0."""
    return videos.withColumns({"fps": F.when((F.col("fps") > 1) & (F.col("fps") < 240), F.col("fps")).otherwise(25.0), "total": F.greatest("total", F.lit(0))})


def stale_uploads(files: DataFrame, now_s: float, days: float = 7.0) -> DataFrame:
    return files.where(F.col("mtime") < now_s - days * 86400)


def batched(frames: DataFrame, size: int = 8) -> DataFrame:
    """(match_id, batch, frames): frames of each match in order, ``size`` at a time."""
    i = F.row_number().over(Window.partitionBy("match_id").orderBy("frame")) - 1
    rows = frames.withColumn("batch", F.floor(i / size).cast("bigint"))
    return rows.groupBy("match_id", "batch").agg(F.array_sort(F.collect_list("frame")).alias("frames"))


def split_counts(files: DataFrame) -> DataFrame:
    """How many pictures (path .../<folder>/images/<name>) each split of a data set has; the folder
    of the split ``val`` is called valid."""
    folder = F.regexp_extract("path", r"([^/]+)/images/[^/]+$", 1)
    rows = files.withColumn("split", F.when(folder == "valid", "val").otherwise(folder))
    return rows.where(F.col("split").isin("train", "val", "test")).groupBy("data_set", "split").agg(F.count("*").alias("n"))


def people_rows(detections: DataFrame) -> DataFrame:
    """Tracked detections (match_id, frame, time_s, track_id, cls, x1, y1, x2, y2, pitch: struct<x, y>)
    as observations; what has no track is left out, and a place that isn't known is null."""
    x, y = foot(F.col("x1"), F.col("x2"), F.col("y2"))
    return detections.where(F.col("track_id").isNotNull()).select("match_id", "frame", "time_s", "track_id", "cls", "x1", "y1", "x2", "y2", x.alias("img_x"), y.alias("img_y"), F.col("pitch.x").alias("pitch_x"), F.col("pitch.y").alias("pitch_y"))


def ball_rows(detections: DataFrame) -> DataFrame:
    """A row for each frame (match_id, frame, time_s, box: struct<x1, y1, x2, y2>, pitch: struct<x, y>,
    conf): where the ball is not seen, all of it is null and the confidence 0."""
    seen = F.col("box").isNotNull()
    x, y = centre(*[F.col(f"box.{c}") for c in ("x1", "y1", "x2", "y2")])
    return detections.select("match_id", "frame", "time_s", x.alias("img_x"), y.alias("img_y"), F.when(seen, F.col("pitch.x")).alias("pitch_x"), F.when(seen, F.col("pitch.y")).alias("pitch_y"), F.when(seen, F.col("conf")).otherwise(0.0).alias("conf"))


def cached(observations: DataFrame, path: str) -> DataFrame:
    """Observations kept for experiments: written on the first call, by match, then read back."""
    spark = observations.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        observations.write.mode("overwrite").partitionBy("match_id").parquet(path)
    return spark.read.parquet(path)


def append_observations(rows: DataFrame, path: str) -> None:
    """Observations added to those of their matches."""
    rows.write.mode("append").partitionBy("match_id").parquet(path)
