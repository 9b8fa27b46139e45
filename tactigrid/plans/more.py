"""Registered queries on tags, evaluation, stitching, calibration, shots, clips and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactigrid.functions import geometry as G
from tactigrid.operators import calibration as C
from tactigrid.operators import clips as K
from tactigrid.operators import detection as D
from tactigrid.operators import evaluate as V
from tactigrid.operators import segments as M
from tactigrid.operators import stitch as Z
from tactigrid.operators import tagstore as A
from tactigrid.operators import teams as TM
from tactigrid.operators import tracks as T
from tactigrid.plans.core import rounded
from tactigrid.plans.views import view, with_views
from tactigrid.sources import readers, writers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TAGS = with_views("tags")
_COUNTS = """count(*) AS events, count(*) FILTER (event IN ('Pass', 'Cross', 'Shot Assist')) AS passes, count(*) FILTER ((event IN ('Pass', 'Cross') AND outcome = 'Successful') OR event = 'Shot Assist') AS passes_completed, count(*) FILTER (event = 'Cross') AS crosses, count(*) FILTER (event = 'Shot') AS shots,
 count(*) FILTER (event = 'Shot' AND outcome IN ('Goal', 'Saved')) AS shots_on_target, count(*) FILTER (event = 'Shot' AND outcome = 'Goal') AS goals, count(*) FILTER (event = 'Shot Assist') AS shot_assists, count(*) FILTER (event = 'Dribble') AS dribbles, count(*) FILTER (event = 'Dribble' AND outcome = 'Successful') AS dribbles_completed,
 count(*) FILTER (event = 'Tackle') AS tackles, count(*) FILTER (event = 'Interception') AS interceptions, count(*) FILTER (event = 'Block') AS blocks, count(*) FILTER (event = 'Clearance') AS clearances"""


@query(TAGS + f", c AS (SELECT match_id, team, {_COUNTS} FROM tags GROUP BY 1, 2), b AS (SELECT *, passes + shots + dribbles + clearances AS ball FROM c) SELECT * EXCLUDE (ball), round(100.0 * ball / sum(ball) OVER (PARTITION BY match_id), 6) AS possession, round(CASE WHEN passes > 0 THEN 100.0 * passes_completed / passes ELSE 0 END, 6) AS pass_accuracy FROM b")
def tag_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.team_stats(view(spark, d, "tags")))


@query(TAGS + f" SELECT match_id, team, player, {_COUNTS}, count(*) FILTER (event IN ('Tackle', 'Interception', 'Block', 'Clearance')) AS defensive, CAST(CASE WHEN count(*) FILTER (event IN ('Pass', 'Cross', 'Shot Assist')) > 0 THEN floor(100.0 * count(*) FILTER ((event IN ('Pass', 'Cross') AND outcome = 'Successful') OR event = 'Shot Assist') / count(*) FILTER (event IN ('Pass', 'Cross', 'Shot Assist')) + 0.5) ELSE 0 END AS BIGINT) AS accuracy FROM tags GROUP BY 1, 2, 3")
def tag_player_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.player_stats(view(spark, d, "tags"))


@query(TAGS + " SELECT match_id, team, count(*) FILTER (event = 'Shot' AND outcome = 'Goal') AS goals FROM tags GROUP BY 1, 2")
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    return A.live_score(view(spark, d, "tags"))


@query(TAGS + " SELECT match_id, max(event_id) AS created, count(*) AS n_events FROM tags GROUP BY 1 ORDER BY created DESC, match_id LIMIT 5")
def match_list(spark: SparkSession, d: str) -> DataFrame:
    tags = view(spark, d, "tags")
    return A.match_list(tags.groupBy("match_id").agg(F.max("event_id").alias("created")), tags, 5)


@query(TAGS + " SELECT event_id, match_id, team, player, event, outcome, CAST(mins * 60 + secs AS DOUBLE) AS t FROM tags WHERE team = 'Home' AND (contains(lower(player), 'er 1') OR contains(lower(event), 'er 1') OR contains(lower(outcome), 'er 1') OR contains(lower(team), 'er 1'))")
def event_search(spark: SparkSession, d: str) -> DataFrame:
    return A.search(view(spark, d, "tags"), "ER 1", team="Home").select("event_id", "match_id", "team", "player", "event", "outcome", "t")


@query(TAGS + " SELECT event_id, CASE WHEN confidence >= 0.6 THEN 'Strong' WHEN confidence >= 0.4 THEN 'Fair' ELSE 'Weak' END AS label, CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS percent FROM tags WHERE confidence IS NOT NULL")
def evidence_labels(spark: SparkSession, d: str) -> DataFrame:
    tags = view(spark, d, "tags").where(F.col("confidence").isNotNull())
    return tags.select("event_id", G.evidence_label(F.col("confidence")).alias("label"), F.floor(F.col("confidence") * 100 + 0.5).alias("percent"))


@query(TAGS + " SELECT match_id, CASE WHEN count(DISTINCT coalesce(nullif(source, ''), 'manual')) > 1 THEN 'mixed' ELSE min(coalesce(nullif(source, ''), 'manual')) END AS source FROM tags GROUP BY 1")
def match_source(spark: SparkSession, d: str) -> DataFrame:
    return A.source_of(view(spark, d, "tags"))


@query(TAGS + " SELECT event_id FROM tags WHERE coalesce(nullif(source, ''), 'manual') <> 'ai'")
def hand_tagged(spark: SparkSession, d: str) -> DataFrame:
    return V.hand_tagged(view(spark, d, "tags")).select("event_id")


@query(TAGS + " SELECT match_id, track_id, count(*) AS n FROM tags WHERE track_id IS NOT NULL GROUP BY 1, 2")
def events_per_track(spark: SparkSession, d: str) -> DataFrame:
    return A.events_per_track(view(spark, d, "tags"))


@query(TAGS + " SELECT DISTINCT match_id, track_id FROM tags WHERE source = 'ai' AND track_id IS NOT NULL")
def tracked_players(spark: SparkSession, d: str) -> DataFrame:
    return A.tracked_players(view(spark, d, "tags"))


@query(TAGS + " SELECT event_id, CASE team WHEN 'Home' THEN 'Away' WHEN 'Away' THEN 'Home' ELSE team END AS team FROM tags")
def swapped_teams(spark: SparkSession, d: str) -> DataFrame:
    return A.rename_teams(view(spark, d, "tags"), {"Home": "Away", "Away": "Home"}).select("event_id", "team")


@query(TAGS + " SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'Edited' ELSE player END AS player FROM tags WHERE event_id % 11 <> 0")
def edited_events(spark: SparkSession, d: str) -> DataFrame:
    tags = view(spark, d, "tags")
    first = tags.where("event_id % 7 = 0").select("event_id", F.lit(1).alias("version"), F.lit("update").alias("op"), F.lit("Draft").alias("player"))
    second = tags.where("event_id % 7 = 0").select("event_id", F.lit(2).alias("version"), F.lit("update").alias("op"), F.lit("Edited").alias("player"))
    gone = tags.where("event_id % 11 = 0").select("event_id", F.lit(3).alias("version"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("player"))
    return A.apply_edits(tags, first.union(second).union(gone)).select("event_id", "player")


@query(TAGS + " SELECT event_id FROM (SELECT *, mins * 60 + secs AS t FROM tags) ORDER BY t DESC, event_id DESC LIMIT 40")
def latest_feed(spark: SparkSession, d: str) -> DataFrame:
    return A.feed(view(spark, d, "tags")).select("event_id")


@query(TAGS + " SELECT match_id, CAST(greatest(100, max(mins * 60 + secs) + 10, 60) AS DOUBLE) AS duration_s FROM tags GROUP BY 1")
def timeline_length(spark: SparkSession, d: str) -> DataFrame:
    return A.timeline_length(view(spark, d, "tags"), 100.0)


@query(TAGS + " SELECT team, player, event, outcome, mins, secs, x, y, x2, y2, half, source, round_even(confidence, 2) AS confidence FROM tags")
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    return writers.export_rows(view(spark, d, "tags"))


@query(TAGS + " SELECT event_id, round(x / 120 * 105, 6) AS metres_x, round(y / 80 * 68, 6) AS metres_y, CAST(least(greatest(CASE WHEN half = 2 THEN 120 - x ELSE x END, 0), 120) AS DOUBLE) AS grid_x, CAST(least(greatest(CASE WHEN half = 2 THEN 80 - y ELSE y END, 0), 80) AS DOUBLE) AS grid_y FROM tags")
def grid_geometry(spark: SparkSession, d: str) -> DataFrame:
    tags = view(spark, d, "tags")
    mx, my = G.grid_to_metres(F.col("x"), F.col("y"))
    gx, gy = G.to_tagger(mx, my, F.col("half"))
    return rounded(tags.select("event_id", mx.alias("metres_x"), my.alias("metres_y"), F.round(gx, 9).alias("grid_x"), F.round(gy, 9).alias("grid_y")))


_EVAL = TAGS + ", ev AS (SELECT * REPLACE (CASE WHEN event_id % 4 < 2 THEN 'Home' ELSE ' Away ' END AS team), CAST(mins * 60 + secs AS DOUBLE) AS t FROM tags), truth AS (SELECT * FROM ev WHERE event_id % 2 = 1), pred AS (SELECT * FROM ev WHERE event_id % 2 = 0)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # odd rows are the truth, even rows the prediction; both have events of both teams
    tags = view(spark, d, "tags").withColumn("t", A.event_time()).withColumn("team", F.when(F.col("event_id") % 4 < 2, "Home").otherwise(" Away "))
    return tags.where("event_id % 2 = 1"), tags.where("event_id % 2 = 0")


@query(_EVAL + " SELECT t.match_id, t.event_id AS t_id, p.event_id AS p_id, abs(t.t - p.t) AS gap FROM truth t JOIN pred p ON t.match_id = p.match_id AND lower(t.event) = lower(p.event) AND trim(t.team) = trim(p.team) AND abs(t.t - p.t) <= 4")
def score_candidates(spark: SparkSession, d: str) -> DataFrame:
    return V.candidates(*_sides(spark, d)).select("match_id", "t_id", "p_id", "gap")


@query()
def event_scorer(spark: SparkSession, d: str) -> DataFrame:
    truth, predicted = _sides(spark, d)
    return rounded(V.score(truth, predicted, V.match_events(truth, predicted)))


@query()
def chance_baseline(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.chance(*_sides(spark, d), span_s=2700.0))


@query(with_views("people") + ", l AS (SELECT match_id, track_id, min(frame) AS a0, max(frame) AS a1 FROM people GROUP BY 1, 2) SELECT a.match_id, a.track_id AS a, b.track_id AS b FROM l a JOIN l b ON a.match_id = b.match_id AND a.track_id < b.track_id AND a.a0 <= b.a1 AND b.a0 <= a.a1")
def co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return V.co_occurrence(T.lifetimes(view(spark, d, "people")))


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return V.split_tracks(view(spark, d, "people"))


_CUT = with_views("people") + """, n AS (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY match_id, track_id) AS c FROM people),
cut AS (SELECT * REPLACE (CAST(CASE WHEN c >= 60 AND i >= c // 2 THEN track_id + 10000 ELSE track_id END AS INT) AS track_id) FROM n WHERE c < 60 OR i < c // 2 - 5 OR i >= c // 2 + 5)"""


@query(_CUT + " SELECT match_id, track_id, frame FROM cut")
def split_tracks(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).select("match_id", "track_id", "frame")


_PARTS = _CUT + """, r AS (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame) AS up, row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame DESC) AS down, count(*) OVER (PARTITION BY match_id, track_id) AS rows_ FROM cut),
parts AS (SELECT match_id, track_id, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n, median(pitch_x) FILTER (up <= 5 AND pitch_x IS NOT NULL) AS hx, median(pitch_y) FILTER (up <= 5 AND pitch_x IS NOT NULL) AS hy, median(pitch_x) FILTER (down <= 5 AND pitch_x IS NOT NULL) AS tx, median(pitch_y) FILTER (down <= 5 AND pitch_x IS NOT NULL) AS ty,
 (arg_max(pitch_x, frame) FILTER (down <= 5 AND pitch_x IS NOT NULL) - arg_min(pitch_x, frame) FILTER (down <= 5 AND pitch_x IS NOT NULL)) / nullif(max(frame) FILTER (down <= 5 AND pitch_x IS NOT NULL) - min(frame) FILTER (down <= 5 AND pitch_x IS NOT NULL), 0) AS tvx FROM r WHERE rows_ >= 3 GROUP BY 1, 2)"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    cut = _cut(spark, d)
    return Z.tracklets(cut, cut.select("match_id", "track_id").distinct().withColumn("team", F.lit(0)), T.track_classes(cut))


@query(_PARTS + " SELECT match_id, track_id, start_frame, end_frame, n, round(hx, 6) AS head_x, round(hy, 6) AS head_y, round(tx, 6) AS tail_x, round(ty, 6) AS tail_y, round(coalesce(tvx, 0), 6) AS tail_speed_x FROM parts")
def tracklets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_parts(spark, d).select("match_id", "track_id", "start_frame", "end_frame", "n", F.col("head.x").alias("head_x"), F.col("head.y").alias("head_y"), F.col("tail.x").alias("tail_x"), F.col("tail.y").alias("tail_y"), F.col("tail_speed.x").alias("tail_speed_x")))


@query(
    _PARTS.replace("AS tvx FROM r", "AS tvx, (arg_max(pitch_y, frame) FILTER (down <= 5 AND pitch_x IS NOT NULL) - arg_min(pitch_y, frame) FILTER (down <= 5 AND pitch_x IS NOT NULL)) / nullif(max(frame) FILTER (down <= 5 AND pitch_x IS NOT NULL) - min(frame) FILTER (down <= 5 AND pitch_x IS NOT NULL), 0) AS tvy,"
                   " (arg_max(pitch_x, frame) FILTER (up <= 5 AND pitch_x IS NOT NULL) - arg_min(pitch_x, frame) FILTER (up <= 5 AND pitch_x IS NOT NULL)) / nullif(max(frame) FILTER (up <= 5 AND pitch_x IS NOT NULL) - min(frame) FILTER (up <= 5 AND pitch_x IS NOT NULL), 0) AS hvx,"
                   " (arg_max(pitch_y, frame) FILTER (up <= 5 AND pitch_x IS NOT NULL) - arg_min(pitch_y, frame) FILTER (up <= 5 AND pitch_x IS NOT NULL)) / nullif(max(frame) FILTER (up <= 5 AND pitch_x IS NOT NULL) - min(frame) FILTER (up <= 5 AND pitch_x IS NOT NULL), 0) AS hvy,"
                   " median(img_x) FILTER (up <= 5) AS hix, median(img_y) FILTER (up <= 5) AS hiy, median(img_x) FILTER (down <= 5) AS tix, median(img_y) FILTER (down <= 5) AS tiy, mode(cls) AS cls FROM r")
    + """, met AS (SELECT a.match_id, a.track_id AS a, b.track_id AS b, b.start_frame - a.end_frame AS gap, a.tx, a.ty, b.hx, b.hy, coalesce(a.tvx, 0) AS vx, coalesce(a.tvy, 0) AS vy, coalesce(b.hvx, 0) AS wx, coalesce(b.hvy, 0) AS wy, a.tix, a.tiy, b.hix, b.hiy FROM parts a JOIN parts b ON a.match_id = b.match_id AND b.start_frame - a.end_frame BETWEEN 1 AND 40 AND a.cls = b.cls),
way AS (SELECT *, least(gap, 0.45 * 25) AS ahead, gap / 25 AS secs FROM met),
part AS (SELECT *, tx IS NULL OR hx IS NULL AS image, CASE WHEN tx IS NULL OR hx IS NULL THEN sqrt((tix - hix) ** 2 + (tiy - hiy) ** 2) / (0.06 * 1920 * (1 + secs)) ELSE (sqrt((tx + vx * ahead - hx) ** 2 + (ty + vy * ahead - hy) ** 2) + sqrt((hx - wx * ahead - tx) ** 2 + (hy - wy * ahead - ty) ** 2)) / 2 / (least(secs, 0.45) * 9 + greatest(secs - 0.45, 0) * 3 + 1.8) END AS cost FROM way)
 SELECT match_id, a, b, round(cost, 6) AS cost, image FROM part WHERE cost <= 1"""
)
def pair_costs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Z.pair_costs(_parts(spark, d), 1.6))


@query()
def stitch_links(spark: SparkSession, d: str) -> DataFrame:
    return Z.link(_parts(spark, d))


@query()
def stitch_bench(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.rejoined(Z.link(_parts(spark, d)), _cut(spark, d)))


_SOLVED = with_views("frames") + ", f AS (SELECT match_id, k // 100 AS shot, frame FROM frames), s AS (SELECT match_id, k // 100 AS shot, frame, 1.0 + k / 1e3 AS a, CAST(4 + k % 9 AS INT) AS n_points, (k % 13) / 1e1 AS error FROM frames WHERE k % 37 = 3 OR k % 50 < 2)"


def _solved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = view(spark, d, "frames").withColumn("shot", F.expr("k div 100"))
    a = 1.0 + F.col("k") / F.lit(1e3)
    s = f.where("k % 37 = 3 or k % 50 < 2").select("match_id", "shot", "frame", F.array(a, F.lit(0.1), F.lit(2.0), F.lit(0.05), a, F.lit(1.0), F.lit(0.0001), F.lit(0.0002), F.lit(1.0)).alias("matrix"), (4 + F.col("k") % 9).cast("int").alias("n_points"), ((F.col("k") % 13) / F.lit(10.0)).alias("error"))
    return f.select("match_id", "shot", "frame"), s


@query(_SOLVED + " SELECT f.match_id, f.shot, f.frame, CASE WHEN f.frame - s.frame <= 75 THEN s.frame END AS solved_frame, CASE WHEN f.frame - s.frame <= 75 THEN round(s.error, 6) END AS error FROM f ASOF LEFT JOIN s ON f.match_id = s.match_id AND f.shot = s.shot AND f.frame >= s.frame")
def calibration_asof(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.as_of(*_solved(spark, d)).select("match_id", "shot", "frame", "solved_frame", "error"))


@query(_SOLVED + " SELECT f.match_id, coalesce(n, 0) AS solved, mean_error, mean_points FROM (SELECT DISTINCT match_id FROM frames UNION SELECT -1) f LEFT JOIN (SELECT match_id, count(*) AS n, round_even(avg(error), 2) AS mean_error, round_even(avg(n_points), 1) AS mean_points FROM s GROUP BY 1) q ON q.match_id = f.match_id")
def calibration_summary(spark: SparkSession, d: str) -> DataFrame:
    frames, solved = _solved(spark, d)
    return C.calibration_summary(solved, frames.select("match_id").union(spark.range(-1, 0).select("id")))


#: Each frame with its neighbours solved; where there are two, the corner at (105, 68) is moved
#: along the line between where both have it in the picture.
_BLEND = _SOLVED + """, inv AS (SELECT *, a * 1 - 1 * 0.0002 AS c00, -(0.1 * 1 - 2 * 0.0002) AS c01, 0.1 * 1 - 2 * a AS c02, -(0.05 * 1 - 1 * 0.0001) AS c10, a * 1 - 2 * 0.0001 AS c11, -(a * 1 - 2 * 0.05) AS c12, 0.05 * 0.0002 - a * 0.0001 AS c20, -(a * 0.0002 - 0.1 * 0.0001) AS c21, a * a - 0.1 * 0.05 AS c22 FROM s),
corner AS (SELECT *, (c00 * 105 + c01 * 68 + c02) / (c20 * 105 + c21 * 68 + c22) AS ix, (c10 * 105 + c11 * 68 + c12) / (c20 * 105 + c21 * 68 + c22) AS iy FROM inv),
sides AS (SELECT f.*, p.frame AS pf, p.error AS pe, p.n_points AS pn, p.ix AS px, p.iy AS py FROM f ASOF LEFT JOIN corner p ON f.match_id = p.match_id AND f.shot = p.shot AND f.frame >= p.frame),
both_ AS (SELECT f.*, n.frame AS nf, n.error AS ne, n.n_points AS nn, n.ix AS nx, n.iy AS ny FROM sides f ASOF LEFT JOIN corner n ON f.match_id = n.match_id AND f.shot = n.shot AND f.frame <= n.frame),
near_ AS (SELECT match_id, shot, frame, CASE WHEN frame - pf <= 75 THEN pf END AS pf, CASE WHEN nf - frame <= 75 THEN nf END AS nf, pe, ne, pn, nn, px, py, nx, ny FROM both_),
t_ AS (SELECT *, CASE WHEN pf IS NULL THEN 1.0 WHEN nf IS NULL OR nf = pf THEN 0.0 ELSE (frame - pf) / (nf - pf) END AS t FROM near_ WHERE pf IS NOT NULL OR nf IS NOT NULL)"""


@query(_BLEND + " SELECT match_id, shot, frame, CASE WHEN t > 0 AND t < 1 THEN least(pn, nn) WHEN t >= 1 THEN nn ELSE pn END AS n_points, round(CASE WHEN t > 0 AND t < 1 THEN pe + (ne - pe) * t WHEN t >= 1 THEN ne ELSE pe END, 6) AS error, CASE WHEN t > 0 AND t < 1 THEN 105.0 END AS x, CASE WHEN t > 0 AND t < 1 THEN 68.0 END AS y FROM t_")
def calibration_blend(spark: SparkSession, d: str) -> DataFrame:
    frames, solved = _solved(spark, d)
    made = C.blended(frames, solved).withColumn("n_points", F.col("n_points").cast("int"))
    # the blended matrix takes the corner of the picture that it was made of to the pitch's corner
    sides = C.two_sided(frames, solved).where("share > 0 and share < 1")
    inverse = lambda m: [m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4], m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5], m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3]]
    corner = lambda c: G.project(inverse(F.col(f"{c}.matrix")), F.lit(105.0), F.lit(68.0))
    (ax, ay), (bx, by) = corner("before"), corner("after")
    at = sides.select("match_id", "shot", "frame", (ax + (bx - ax) * F.col("share")).alias("ix"), (ay + (by - ay) * F.col("share")).alias("iy"))
    rows = made.join(at, ["match_id", "shot", "frame"], "left")
    x, y = G.project(F.col("matrix"), F.col("ix"), F.col("iy"))
    return rounded(rows.select("match_id", "shot", "frame", "n_points", "error", F.round(x, 4).alias("x"), F.round(y, 4).alias("y")))


@query(_SOLVED + " SELECT match_id, frame, round((a * 300 + 0.1 * 200 + 2) / (0.0001 * 300 + 0.0002 * 200 + 1), 6) AS x, round((0.05 * 300 + a * 200 + 1) / (0.0001 * 300 + 0.0002 * 200 + 1), 6) AS y FROM s")
def homography_apply(spark: SparkSession, d: str) -> DataFrame:
    x, y = G.project(F.col("matrix"), F.lit(300.0), F.lit(200.0))
    return rounded(_solved(spark, d)[1].select("match_id", "frame", x.alias("x"), y.alias("y")))


@query()
def homography_fit(spark: SparkSession, d: str) -> DataFrame:
    frames = view(spark, d, "frames")
    p = frames.select("match_id", "frame", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"))
    p = p.withColumns({"pitch_x": (F.col("i") % 4) * 35.0, "pitch_y": F.floor(F.col("i") / 4) * 34.0})
    w = 1 + 0.001 * F.col("pitch_x") + 0.002 * F.col("pitch_y")
    # seen up to two pixels from where they are, and every seventh far off
    off = F.when((F.col("frame") + F.col("i")) % 7 == 6, 90.0).otherwise(((F.col("frame") * 31 + F.col("i") * 17) % 41 - 20) / 10.0)
    p = p.withColumns({"img_x": (12 * F.col("pitch_x") + 3 * F.col("pitch_y") + 200) / w + off, "img_y": (1 * F.col("pitch_x") + 9 * F.col("pitch_y") + 150) / w - off / 2})
    return rounded(V.error_summary(C.held_out_errors(p), ["match_id"]), 3)


_STEP = with_views("frames") + ", st AS (SELECT match_id, frame, k, CASE WHEN k = 0 THEN NULL WHEN k % 90 = 45 THEN 4e-1 ELSE (k % 7) / 1e3 + 1e-2 END AS step FROM frames)"


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "frames").select("match_id", "frame", F.expr("case when k = 0 then null when k % 90 = 45 then 4e-1 else (k % 7) / 1e3 + 1e-2 end").alias("step"))


def _shots(spark: SparkSession, d: str) -> DataFrame:
    solved = view(spark, d, "frames").where("k % 5 = 0").select("match_id", "frame", F.expr("k % 10 = 0 and k > 45").alias("solved"))
    return M.playable(M.shots(M.find_cuts(_steps(spark, d)), solved))


_SHOTS = _STEP + """, cuts AS (SELECT *, coalesce(step >= 0.4, false) AS cut FROM st), numbered AS (SELECT *, CAST(sum(CAST(cut AS INT)) OVER (PARTITION BY match_id ORDER BY frame) AS INT) AS shot FROM cuts),
shots AS (SELECT match_id, shot, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS frames, count(*) FILTER (k % 5 = 0) AS attempted, count(*) FILTER (k % 10 = 0 AND k > 45) AS calibrated FROM numbered GROUP BY 1, 2),
play AS (SELECT *, frames >= 6 AND calibrated / nullif(attempted, 0) >= 0.35 AS playable FROM shots)"""


@query(_SHOTS + " SELECT match_id, shot, start_frame, end_frame, frames, attempted, calibrated, coalesce(playable, false) AS playable FROM play")
def shot_segments(spark: SparkSession, d: str) -> DataFrame:
    return _shots(spark, d)


@query(_SHOTS + " SELECT match_id, count(*) AS shots, count(*) - 1 AS cuts, count(*) FILTER (playable) AS playable_shots, CAST(coalesce(sum(frames) FILTER (playable), 0) AS BIGINT) AS playable_frames, round_even(coalesce(sum(frames) FILTER (playable), 0) / sum(frames), 3) AS playable_share, max(frames) AS longest_shot_frames, coalesce(round_even(sum(calibrated) / nullif(sum(attempted), 0), 3), 0) AS coverage FROM play GROUP BY 1")
def shot_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.shot_summary(_shots(spark, d))


@query(_SHOTS + " SELECT b.match_id, b.frame, min(shot) AS shot FROM frames b JOIN shots s ON b.match_id = s.match_id AND b.frame BETWEEN start_frame AND end_frame GROUP BY 1, 2")
def frames_by_shot(spark: SparkSession, d: str) -> DataFrame:
    return M.with_shot(view(spark, d, "frames").select("match_id", "frame"), _shots(spark, d))


_CLIP = TAGS + """, c AS (SELECT *, coalesce(CASE WHEN frame > 0 THEN frame END, CAST(round_even((mins * 60 + secs) * 25, 0) AS BIGINT)) AS ef FROM tags WHERE event IN ('Shot', 'Goal', 'Cross', 'Shot Assist', 'Tackle')),
t AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY confidence DESC NULLS LAST, ef, event_id) AS r FROM c),
o AS (SELECT match_id, greatest(ef - 150, 0) AS s, least(ef + 75, 89999) AS e, row_number() OVER (PARTITION BY match_id ORDER BY ef, event_id) AS i FROM t WHERE r <= 60),
f AS (SELECT match_id, i, 0 AS clip, s AS cs, e AS ce FROM o WHERE i = 1 UNION ALL SELECT o.match_id, o.i, CASE WHEN j THEN clip ELSE clip + 1 END, CASE WHEN j THEN cs ELSE o.s END, CASE WHEN j THEN greatest(ce, o.e) ELSE o.e END
 FROM (SELECT f.*, o2.s AS ns, o2.e AS ne, o2.s <= f.ce AND greatest(o2.e, f.ce) - f.cs <= 1125 AS j FROM f JOIN o o2 ON o2.match_id = f.match_id AND o2.i = f.i + 1) AS f2 JOIN o ON o.match_id = f2.match_id AND o.i = f2.i + 1)"""


@query(_CLIP + " SELECT match_id, CAST(clip AS INT) AS clip, min(cs) AS start_frame, max(ce) AS end_frame, CAST(count(*) AS INT) AS n_events FROM f GROUP BY 1, 2")
def clip_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = K.plan(view(spark, d, "tags"), 25.0, 90_000)
    return plan.select("match_id", "clip", "start_frame", "end_frame", F.size("events").alias("n_events"))


@query(
    _CLIP
    + """, e AS (SELECT f.match_id, f.clip, f.cs, f.ce, o.i, t.event FROM f JOIN o ON o.match_id = f.match_id AND o.i = f.i JOIN (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ef, event_id) AS i FROM t WHERE r <= 60) t ON t.match_id = f.match_id AND t.i = f.i),
k AS (SELECT match_id, clip, event, min(i) AS i FROM e GROUP BY 1, 2, 3), n AS (SELECT match_id, clip, string_agg(event, '-' ORDER BY i) AS kinds FROM (SELECT *, row_number() OVER (PARTITION BY match_id, clip ORDER BY i) AS r FROM k) WHERE r <= 3 GROUP BY 1, 2),
g AS (SELECT match_id, clip, min(cs) AS s, max(ce) AS e, count(*) AS n FROM e GROUP BY 1, 2)
 SELECT g.match_id, CAST(g.clip AS INT) AS clip, s AS start_frame, e AS end_frame, regexp_replace(lpad(CAST(s // 25 // 60 AS VARCHAR), 2, '0') || 'm' || lpad(CAST(s // 25 % 60 AS VARCHAR), 2, '0') || 's_' || kinds, '[^A-Za-z0-9_.-]+', '-', 'g') AS label, round_even((e - s) / 25, 2) AS duration_s, CAST(n AS INT) AS n_events FROM g JOIN n ON n.match_id = g.match_id AND n.clip = g.clip"""
)
def clip_labels(spark: SparkSession, d: str) -> DataFrame:
    return K.described(K.plan(view(spark, d, "tags"), 25.0, 90_000), 25.0)


_BOX = with_views("people") + ", b AS (SELECT match_id, frame, track_id, x1 AS t_x1, y1 AS t_y1, x2 AS t_x2, y2 AS t_y2, CASE WHEN (frame + track_id) % 9 = 0 THEN NULL ELSE x1 + frame % 30 END AS p_x1, y1 AS p_y1, x2 + frame % 30 AS p_x2, y2 AS p_y2, (frame % 100) / 1e2 AS conf FROM people)"


@query(_BOX + """, i AS (SELECT *, greatest(least(t_x2, p_x2) - greatest(t_x1, p_x1), 0) * greatest(least(t_y2, p_y2) - greatest(t_y1, p_y1), 0) AS inter, (t_x2 - t_x1) * (t_y2 - t_y1) AS area FROM b), u AS (SELECT *, coalesce(inter / (2 * area - inter), 0) AS iou FROM i)
 SELECT track_id, count(*) AS n, round(avg(CASE WHEN p_x1 IS NOT NULL AND iou >= 0.3 THEN 1.0 ELSE 0 END), 6) AS found, round(avg(CASE WHEN p_x1 IS NOT NULL AND iou < 0.3 THEN 1.0 ELSE 0 END), 6) AS wrong, round(avg(CASE WHEN p_x1 IS NULL THEN 1.0 ELSE 0 END), 6) AS missed, round(avg(CASE WHEN p_x1 IS NOT NULL AND iou >= 0.3 THEN iou END), 6) AS mean_iou, round(avg(CASE WHEN p_x1 IS NOT NULL THEN conf END), 6) AS mean_conf FROM u GROUP BY 1""")
def iou_rates(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "people").selectExpr("track_id", "x1 t_x1", "y1 t_y1", "x2 t_x2", "y2 t_y2", "case when (frame + track_id) % 9 = 0 then null else x1 + frame % 30 end p_x1", "y1 p_y1", "x2 + frame % 30 p_x2", "y2 p_y2", "(frame % 100) / 1e2 conf")
    return rounded(V.detector_rates(b, ["track_id"]))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def kit_distance(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    one, two = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"), (F.col("vec_id") - 1).alias("a"))
    return one.join(two, "a").select("a", "b", F.round(G.vector_distance(F.col("ea"), F.col("eb")), 4).alias("d"))


@query()
def kit_clusters(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.expr("vec_id div 60").alias("match_id"), F.col("vec_id").alias("track_id"), F.col("embedding").alias("kit"))
    return TM.cluster_kits(e).groupBy("match_id", "cluster").agg(F.count("*").alias("n"))


@query(with_views("people") + ", v AS (SELECT match_id, track_id, CASE WHEN frame % 5 = 0 THEN 2 ELSE 1 END AS team, count(*) AS n FROM people GROUP BY 1, 2, 3), s AS (SELECT match_id, track_id, arg_max(team, n) AS team, max(n) / sum(n) AS share FROM v GROUP BY 1, 2) SELECT match_id, round(avg(share), 6) AS confidence, count(*) AS tracks FROM s GROUP BY 1")
def vote_confidence(spark: SparkSession, d: str) -> DataFrame:
    obs = view(spark, d, "people").select("match_id", "track_id", F.when(F.col("frame") % 5 == 0, 2).otherwise(1).alias("team"))
    return rounded(TM.vote_confidence(TM.vote(obs)))


@query(with_views("people") + """, s AS (SELECT *, CASE WHEN track_id IN (1, 12) THEN 1 ELSE 2 END AS c FROM people WHERE pitch_x IS NOT NULL), f AS (SELECT match_id, CASE WHEN track_id <= 11 THEN 1 ELSE 2 END AS team, avg(pitch_x) AS m FROM s WHERE c <> 1 AND track_id <= 22 GROUP BY 1, 2), k AS (SELECT match_id, track_id, median(pitch_x) AS x FROM s WHERE c = 1 GROUP BY 1, 2)
 SELECT match_id, track_id, CAST(team AS INT) AS team FROM (SELECT k.match_id, track_id, team, row_number() OVER (PARTITION BY k.match_id, track_id ORDER BY abs(x - m) DESC, team) AS r FROM k JOIN f ON k.match_id = f.match_id) WHERE r = 1""")
def keeper_assignment(spark: SparkSession, d: str) -> DataFrame:
    people = view(spark, d, "people")
    return TM.assign_keepers(people, view(spark, d, "teams"), T.track_classes(people))


@query(
    "WITH f AS (SELECT event_id, 400 + event_id * 37 % 2000 AS width, 300 + event_id * 53 % 1500 AS height FROM events),"
    " r AS (SELECT *, unnest(range(0, CAST(ceil(greatest(height - 640, 0) / 512) AS BIGINT) + 1)) AS j FROM f), c AS (SELECT *, unnest(range(0, CAST(ceil(greatest(width - 640, 0) / 512) AS BIGINT) + 1)) AS i FROM r)"
    " SELECT DISTINCT event_id, width, height, CAST(least(i * 512, greatest(width - 640, 0)) AS INT) AS x, CAST(least(j * 512, greatest(height - 640, 0)) AS INT) AS y, CAST(least(640, width) AS INT) AS w, CAST(least(640, height) AS INT) AS h FROM c"
)
def tile_windows(spark: SparkSession, d: str) -> DataFrame:
    f = spark.read.parquet(f"{d}/events.parquet").select("event_id", (400 + F.col("event_id") * 37 % 2000).alias("width"), (300 + F.col("event_id") * 53 % 1500).alias("height"))
    return D.tile_windows(f)


@query(with_views("frames") + " SELECT match_id, frame FROM frames WHERE frame >= 10 AND (frame - 10) % 6 = 0 AND frame < 500")
def sampled_frames(spark: SparkSession, d: str) -> DataFrame:
    return readers.sampled(view(spark, d, "frames").select("match_id", "frame"), 10, 500, 6)


@query(with_views("frames") + ", v AS (SELECT match_id, max(frame) + 1 AS total FROM frames GROUP BY 1) SELECT match_id, total, CAST(range AS INT) AS i, range * (total - 1) // 15 AS frame FROM v CROSS JOIN range(16)")
def survey_frames(spark: SparkSession, d: str) -> DataFrame:
    return readers.survey(view(spark, d, "frames").groupBy("match_id").agg((F.max("frame") + 1).alias("total")))


@query("SELECT event_id, CASE WHEN v ~ '^-?[0-9.]+$' THEN CAST(v AS DOUBLE) END AS x, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 4 AS INT) END AS track_id, substr(event_type, 1, 100) AS event FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS VARCHAR) || '.5' WHEN 1 THEN '' ELSE 'NaN' END AS v FROM events)")
def payload_rows(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    v = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_id").cast("string"), F.lit(".5"))).when(F.col("event_id") % 3 == 1, "").otherwise("NaN")
    none = F.lit(None).cast("string")
    raw = e.select("event_id", none.alias("Team"), none.alias("Player"), F.col("event_type").alias("Event"), none.alias("Outcome"), none.alias("Mins"), none.alias("Secs"), v.alias("X"), none.alias("Y"), none.alias("X2"), none.alias("Y2"), none.alias("half"), none.alias("source"), none.alias("confidence"), (F.col("event_id") % 4).cast("string").alias("track_id"), F.col("event_id").cast("string").alias("frame"))
    return readers.payload_rows(raw).select((F.coalesce("frame", F.lit(0))).alias("event_id"), "x", "track_id", "event")
