"""Ball observations: one row per sampled (match_id, frame), null where unseen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interpolate_ball(ball: DataFrame, max_gap: int = 12) -> DataFrame:
    """Gaps of up to ``max_gap`` rows between sightings filled along a line (by rows, not time),
    smoothed by a centred median of three; longer gaps and the ends stay empty. A gap is where
    the image position is missing. Matches in which the ball is never seen come back unchanged."""
    match = Window.partitionBy("match_id")
    order = match.orderBy("frame")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    missing = F.col("img_x").isNull()
    rows = ball.withColumns({"__rn": F.row_number().over(order), "__miss": missing, "__any": F.count("img_x").over(match) > 0})
    rows = rows.withColumn("__turn", F.when(F.col("__miss") != F.coalesce(F.lag("__miss").over(order), ~F.col("__miss")), 1).otherwise(0))
    rows = rows.withColumn("__run", F.sum("__turn").over(order))
    rows = rows.withColumn("__long", F.count("*").over(Window.partitionBy("match_id", "__run")))
    edge = ~(F.max(F.when(~missing, 1)).over(back).isNotNull() & F.max(F.when(~missing, 1)).over(ahead).isNotNull())
    rows = rows.withColumn("__blank", F.col("__miss") & ((F.col("__long") > max_gap) | edge))
    columns = ("img_x", "img_y", "pitch_x", "pitch_y")
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("__rn").alias("rn"), F.col(c).alias("v"))) for c in columns}
    rows = rows.withColumns({f"__p_{c}": F.last(known[c], ignorenulls=True).over(back) for c in columns} | {f"__n_{c}": F.first(known[c], ignorenulls=True).over(ahead) for c in columns})
    filled = {}
    for c in columns:
        p, n = F.col(f"__p_{c}"), F.col(f"__n_{c}")
        line = p["v"] + (n["v"] - p["v"]) * (F.col("__rn") - p["rn"]) / (n["rn"] - p["rn"])
        filled[c] = F.when(F.col("__blank"), None).when(F.col(c).isNotNull(), F.col(c)).otherwise(line)
    rows = rows.withColumns({f"__f_{c}": v for c, v in filled.items()})
    smooth = {c: F.when(F.col("__blank"), None).otherwise(F.percentile(f"__f_{c}", F.lit(0.5)).over(order.rowsBetween(-1, 1))) for c in columns}
    out = rows.withColumns({f"__s_{c}": v for c, v in smooth.items()})
    out = out.withColumns({c: F.when(F.col("__any"), F.col(f"__s_{c}")).otherwise(F.col(c)) for c in columns})
    out = out.withColumn("interpolated", F.when(F.col("__any"), F.col("__miss") & ~F.col("__blank")))
    return out.select(*[c for c in ball.columns if c != "interpolated"], "interpolated")


def median_step(sightings: DataFrame, most: int = 2) -> DataFrame:
    """The median move of the ball between sightings at most ``most`` frames apart."""
    w = Window.partitionBy("match_id").orderBy("frame")
    seen = sightings.select("match_id", "frame", "x", "y", *[F.lag(c).over(w).alias(f"p_{c}") for c in ("frame", "x", "y")])
    d = F.sqrt((F.col("x") - F.col("p_x")) ** 2 + (F.col("y") - F.col("p_y")) ** 2)
    return seen.where((F.col("frame") - F.col("p_frame") <= most) & d.isNotNull()).groupBy("match_id").agg(F.median(d).alias("step"))


def teleports(sightings: DataFrame, factor: float = 6.0, max_gap: int = 3) -> DataFrame:
    """Sightings that leave and come back: far from both neighbours, which are near each other."""
    w = Window.partitionBy("match_id").orderBy("frame")
    names = {f"{p}_{c}": f(c).over(w) for p, f in (("p", F.lag), ("n", F.lead)) for c in ("frame", "x", "y")}
    rows = sightings.withColumns(names).join(median_step(sightings), "match_id")
    limit = factor * F.col("step")
    far = lambda a, b: F.sqrt((F.col(f"{a}x") - F.col(f"{b}x")) ** 2 + (F.col(f"{a}y") - F.col(f"{b}y")) ** 2)
    near = (F.col("frame") - F.col("p_frame") <= max_gap) & (F.col("n_frame") - F.col("frame") <= max_gap)
    rows = rows.where((limit > 0) & near & (far("", "p_") > limit) & (far("n_", "") > limit) & (far("n_", "p_") <= limit))
    share = (F.col("frame") - F.col("p_frame")) / (F.col("n_frame") - F.col("p_frame"))
    return rows.select("match_id", "frame", "x", "y", *[(F.col(f"p_{c}") + (F.col(f"n_{c}") - F.col(f"p_{c}")) * share).alias(f"expected_{c}") for c in ("x", "y")])
