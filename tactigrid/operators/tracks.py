"""People observations: one row per (match_id, frame, track_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.functions.geometry import distance

TRACK = ["match_id", "track_id"]


def by_track() -> Window:
    return Window.partitionBy(*TRACK).orderBy("frame")


def clean(df: DataFrame, *columns: str) -> DataFrame:
    """NaN is no value: to null at the door, as NaN compares above everything in Spark."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns})


def drop_short_tracks(people: DataFrame, least: int = 8) -> DataFrame:
    rows = F.count("*").over(Window.partitionBy(*TRACK))
    return people.withColumn("__n", rows).where(F.col("__n") >= least).drop("__n")


def smooth_positions(people: DataFrame, window: int = 5) -> DataFrame:
    """Centred rolling median over rows of a track; what is missing is ignored."""
    around = by_track().rowsBetween(-(window // 2), window // 2)
    return people.withColumns({c: F.percentile(c, F.lit(0.5)).over(around) for c in ("pitch_x", "pitch_y")})


def majority(df: DataFrame, keys: list[str], label: str, weight: Column | None = None) -> DataFrame:
    """The most frequent label of each key; of equally frequent ones the smallest."""
    votes = df.groupBy(*keys, label).agg((F.count("*") if weight is None else F.sum(weight)).alias("votes"))
    return votes.groupBy(*keys).agg(F.max_by(label, F.struct("votes", F.negative(F.col(label)))).alias(label), (F.max("votes") / F.sum("votes")).alias("share"))


def track_classes(people: DataFrame) -> DataFrame:
    return majority(people, TRACK, "cls").drop("share")


def track_medians(people: DataFrame) -> DataFrame:
    return people.groupBy(*TRACK).agg(F.median("pitch_x").alias("med_x"), F.median("pitch_y").alias("med_y"))


def physical_stats(people: DataFrame, step: int = 10, most: float = 12.0) -> DataFrame:
    """Distance, top speed, minutes and mean position of tracks with two located rows or more.

    Steps faster than ``most`` m/s are identity swaps and count for nothing; a step that takes
    no time has speed 0. Top speed is taken over ``step`` rows."""
    w = by_track()
    located = people.where(F.col("pitch_x").isNotNull() & F.col("pitch_y").isNotNull())

    def back(k: int) -> tuple[Column, Column]:
        d = distance(F.col("pitch_x"), F.col("pitch_y"), F.lag("pitch_x", k).over(w), F.lag("pitch_y", k).over(w))
        gap = F.col("time_s") - F.lag("time_s", k).over(w)
        return d, F.when(gap > 0, d / gap).when(gap.isNotNull(), 0.0)

    d1, v1 = back(1)
    _, vk = back(step)
    rows = located.select(*TRACK, "frame", "time_s", "pitch_x", "pitch_y", d1.alias("d"), v1.alias("v"), vk.alias("vk"))
    stats = rows.groupBy(*TRACK).agg(
        F.count("*").alias("frames"),
        F.coalesce(F.sum(F.when(F.col("v") <= most, F.col("d"))), F.lit(0.0)).alias("distance_m"),
        F.coalesce(F.max(F.when(F.col("vk") <= most, F.col("vk") * 3.6)), F.lit(0.0)).alias("top_kmh"),
        ((F.max_by("time_s", "frame") - F.min_by("time_s", "frame")) / 60).alias("minutes"),
        F.avg("pitch_x").alias("avg_x"),
        F.avg("pitch_y").alias("avg_y"),
    )
    return stats.where("frames >= 2")


def lifetimes(people: DataFrame) -> DataFrame:
    return people.groupBy(*TRACK).agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("rows"), (F.max("time_s") - F.min("time_s")).alias("span_s"))


def lifetime_summary(people: DataFrame, long_s: float = 5.0) -> DataFrame:
    """How long identities of a match last: how many, how many ``long_s`` seconds or more, median
    and mean in seconds."""
    return lifetimes(people).groupBy("match_id").agg(F.count("*").alias("identities"), F.count_if(F.col("span_s") >= long_s).alias("lasting"), F.median("span_s").alias("median_s"), F.avg("span_s").alias("mean_s"))


def of_team(people: DataFrame, teams: DataFrame, team: int) -> DataFrame:
    """Rows of a team's tracks."""
    return people.join(teams.where(F.col("team") == team), TRACK, "left_semi")


def churn(people: DataFrame) -> DataFrame:
    """Identities per person on screen, with a verdict."""
    per = people.groupBy("match_id", "frame").agg(F.count("*").alias("n")).groupBy("match_id").agg(F.avg("n").alias("mean_on_screen"))
    ids = people.groupBy("match_id").agg(F.countDistinct("track_id").alias("identities"))
    rate = F.col("identities") / F.greatest(F.col("mean_on_screen"), F.lit(1.0))
    out = ids.join(per, "match_id").withColumn("churn", rate)
    return out.withColumn("verdict", F.when(F.col("churn") <= 1.8, "good").when(F.col("churn") <= 3.0, "fair").otherwise("poor"))


def heatmap(people: DataFrame, keys: list[str], bins_x: int = 12, bins_y: int = 8, length: float = 105.0, width: float = 68.0) -> DataFrame:
    """Counts on a grid over the pitch, as a share of the fullest cell. Cells are half open, the
    last one closed; points outside are dropped. All cells of a key are returned."""
    cell = lambda v, size, n: F.when(v == size, n - 1).otherwise(F.floor(v / (size / n))).cast("int")
    inside = people.where(F.col("pitch_x").between(0.0, length) & F.col("pitch_y").between(0.0, width))
    counts = inside.groupBy(*keys, cell(F.col("pitch_x"), length, bins_x).alias("bx"), cell(F.col("pitch_y"), width, bins_y).alias("by")).agg(F.count("*").alias("n"))
    grid = people.select(*keys).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(bins_x - 1))).alias("bx")).select("*", F.explode(F.sequence(F.lit(0), F.lit(bins_y - 1))).alias("by"))
    full = grid.join(counts, [*keys, "bx", "by"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    peak = F.max("n").over(Window.partitionBy(*keys))
    return full.withColumn("value", F.when(peak > 0, F.round(F.col("n") / peak, 3)).otherwise(0.0))


def remap(people: DataFrame, mapping: DataFrame) -> DataFrame:
    """Track ids replaced by ``mapping`` (match_id, track_id, root) where it has them."""
    return people.join(mapping, TRACK, "left").withColumn("track_id", F.coalesce("root", "track_id")).drop("root")
