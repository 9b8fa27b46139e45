"""Registered queries on tracks, ball, possession and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactigrid.functions import geometry as G
from tactigrid.operators import ball as B
from tactigrid.operators import events as E
from tactigrid.operators import possession as P
from tactigrid.operators import stats as S
from tactigrid.operators import tracks as T
from tactigrid.plans.views import view, with_views
from tactigrid.sources.scratch import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, as both engines sum in orders of their own."""
    return df.select(*[G.rounded(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    with_views("people")
    + """, l AS (SELECT *, lag(pitch_x) OVER w AS ax, lag(pitch_y) OVER w AS ay, lag(time_s) OVER w AS at_, lag(pitch_x, 10) OVER w AS bx, lag(pitch_y, 10) OVER w AS by_, lag(time_s, 10) OVER w AS bt
 FROM people WHERE pitch_x IS NOT NULL AND pitch_y IS NOT NULL WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame)),
v AS (SELECT *, sqrt((pitch_x - ax) ** 2 + (pitch_y - ay) ** 2) AS d, sqrt((pitch_x - bx) ** 2 + (pitch_y - by_) ** 2) / nullif(time_s - bt, 0) AS vk FROM l)
SELECT match_id, track_id, count(*) AS frames, round(coalesce(sum(CASE WHEN d / nullif(time_s - at_, 0) <= 12 THEN d END), 0.0), 6) AS distance_m, round(coalesce(max(CASE WHEN vk <= 12 THEN vk * 3.6 END), 0.0), 6) AS top_kmh,
 round((max(time_s) - min(time_s)) / 60, 6) AS minutes, round(avg(pitch_x), 6) AS avg_x, round(avg(pitch_y), 6) AS avg_y FROM v GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def physical_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.physical_stats(view(spark, d, "people")))


@query(with_views("people") + " SELECT match_id, frame, track_id, round(quantile_cont(pitch_x, 0.5) OVER w, 6) AS pitch_x, round(quantile_cont(pitch_y, 0.5) OVER w, 6) AS pitch_y FROM people WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def smooth_positions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.smooth_positions(view(spark, d, "people")).select("match_id", "frame", "track_id", "pitch_x", "pitch_y"))


@query(with_views("people") + ", n AS (SELECT match_id, track_id, cls, count(*) AS c FROM people GROUP BY 1, 2, 3) SELECT match_id, track_id, cls FROM (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY c DESC, cls) AS r FROM n) WHERE r = 1")
def track_classes(spark: SparkSession, d: str) -> DataFrame:
    return T.track_classes(view(spark, d, "people"))


@query(with_views("people") + " SELECT match_id, frame, track_id FROM (SELECT *, count(*) OVER (PARTITION BY match_id, track_id) AS n FROM people) WHERE n >= 60")
def drop_short_tracks(spark: SparkSession, d: str) -> DataFrame:
    return T.drop_short_tracks(view(spark, d, "people"), 60).select("match_id", "frame", "track_id")


@query(with_views("people") + " SELECT match_id, track_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS rows, round(max(time_s) - min(time_s), 6) AS span_s FROM people GROUP BY 1, 2")
def track_lifetimes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.lifetimes(view(spark, d, "people")))


@query(with_views("people") + " SELECT match_id, track_id, round(median(pitch_x), 6) AS med_x, round(median(pitch_y), 6) AS med_y FROM people GROUP BY 1, 2")
def track_medians(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.track_medians(view(spark, d, "people")))


@query(
    with_views("people")
    + ", f AS (SELECT match_id, avg(n) AS m FROM (SELECT match_id, frame, count(*) AS n FROM people GROUP BY 1, 2) GROUP BY 1), i AS (SELECT match_id, count(DISTINCT track_id) AS n FROM people GROUP BY 1)"
    " SELECT match_id, n AS identities, round(m, 6) AS mean_on_screen, round(n / greatest(m, 1), 6) AS churn, CASE WHEN n / greatest(m, 1) <= 1.8 THEN 'good' WHEN n / greatest(m, 1) <= 3 THEN 'fair' ELSE 'poor' END AS verdict FROM f JOIN i USING (match_id)"
)
def churn(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.churn(view(spark, d, "people")))


@query(
    with_views("people", "teams")
    + """, c AS (SELECT p.match_id, team, CASE WHEN pitch_x = 105 THEN 11 ELSE CAST(floor(pitch_x / 8.75) AS INT) END AS bx, CASE WHEN pitch_y = 68 THEN 7 ELSE CAST(floor(pitch_y / 8.5) AS INT) END AS by_, count(*) AS n
 FROM people p JOIN teams t ON p.match_id = t.match_id AND p.track_id = t.track_id WHERE pitch_x BETWEEN 0 AND 105 AND pitch_y BETWEEN 0 AND 68 GROUP BY 1, 2, 3, 4),
g AS (SELECT match_id, team, CAST(a.range AS INT) AS bx, CAST(b.range AS INT) AS by_ FROM (SELECT DISTINCT match_id, team FROM teams) CROSS JOIN range(12) a CROSS JOIN range(8) b)
SELECT g.match_id, g.team, g.bx, g.by_ AS by, coalesce(n, 0) AS n, round(coalesce(n, 0) / max(coalesce(n, 0)) OVER (PARTITION BY g.match_id, g.team), 3) AS value FROM g LEFT JOIN c ON g.match_id = c.match_id AND g.team = c.team AND g.bx = c.bx AND g.by_ = c.by_"""
)
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    people = view(spark, d, "people").join(view(spark, d, "teams"), T.TRACK)
    return T.heatmap(people, ["match_id", "team"])


@query(
    with_views("ball")
    + """, a AS (SELECT *, row_number() OVER w AS rn, img_x IS NULL AS miss, count(img_x) OVER (PARTITION BY match_id) AS n_seen FROM ball WINDOW w AS (PARTITION BY match_id ORDER BY frame)),
t AS (SELECT *, rn - row_number() OVER (PARTITION BY match_id, miss ORDER BY frame) AS run FROM a),
l AS (SELECT *, count(*) OVER (PARTITION BY match_id, miss, run) AS long_,
 max(CASE WHEN NOT miss THEN rn END) OVER b AS seen_before, min(CASE WHEN NOT miss THEN rn END) OVER f AS seen_after,
 last_value(CASE WHEN img_x IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS i0, last_value(img_x IGNORE NULLS) OVER b AS ix0, last_value(img_y IGNORE NULLS) OVER b AS iy0,
 first_value(CASE WHEN img_x IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS i1, first_value(img_x IGNORE NULLS) OVER f AS ix1, first_value(img_y IGNORE NULLS) OVER f AS iy1,
 last_value(CASE WHEN pitch_x IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS p0, last_value(pitch_x IGNORE NULLS) OVER b AS px0, last_value(pitch_y IGNORE NULLS) OVER b AS py0,
 first_value(CASE WHEN pitch_x IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS p1, first_value(pitch_x IGNORE NULLS) OVER f AS px1, first_value(pitch_y IGNORE NULLS) OVER f AS py1
 FROM t WINDOW b AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
k AS (SELECT *, miss AND (long_ > 12 OR seen_before IS NULL OR seen_after IS NULL) AS blank FROM l),
g AS (SELECT *, CASE WHEN blank THEN NULL WHEN img_x IS NOT NULL THEN img_x ELSE ix0 + (ix1 - ix0) * (rn - i0) / (i1 - i0) END AS a1, CASE WHEN blank THEN NULL WHEN img_y IS NOT NULL THEN img_y ELSE iy0 + (iy1 - iy0) * (rn - i0) / (i1 - i0) END AS a2,
 CASE WHEN blank THEN NULL WHEN pitch_x IS NOT NULL THEN pitch_x ELSE px0 + (px1 - px0) * (rn - p0) / (p1 - p0) END AS a3, CASE WHEN blank THEN NULL WHEN pitch_y IS NOT NULL THEN pitch_y ELSE py0 + (py1 - py0) * (rn - p0) / (p1 - p0) END AS a4 FROM k),
s AS (SELECT *, quantile_cont(a1, 0.5) OVER m AS m1, quantile_cont(a2, 0.5) OVER m AS m2, quantile_cont(a3, 0.5) OVER m AS m3, quantile_cont(a4, 0.5) OVER m AS m4 FROM g WINDOW m AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT match_id, frame, round(CASE WHEN n_seen = 0 THEN img_x WHEN NOT blank THEN m1 END, 6) AS img_x, round(CASE WHEN n_seen = 0 THEN img_y WHEN NOT blank THEN m2 END, 6) AS img_y, round(CASE WHEN n_seen = 0 THEN pitch_x WHEN NOT blank THEN m3 END, 6) AS pitch_x, round(CASE WHEN n_seen = 0 THEN pitch_y WHEN NOT blank THEN m4 END, 6) AS pitch_y,
 CASE WHEN n_seen > 0 THEN miss AND NOT blank END AS interpolated FROM s"""
)
def interpolate_ball(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.interpolate_ball(view(spark, d, "ball"), 12).select("match_id", "frame", "img_x", "img_y", "pitch_x", "pitch_y", "interpolated"))


_SIGHT = ", s AS (SELECT match_id, frame, img_x AS x, img_y AS y FROM ball), p AS (SELECT *, lag(frame) OVER w AS pf, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(frame) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM s WINDOW w AS (PARTITION BY match_id ORDER BY frame)), m AS (SELECT match_id, median(sqrt((x - px) ** 2 + (y - py) ** 2)) AS step FROM p WHERE frame - pf <= 2 AND x IS NOT NULL AND px IS NOT NULL GROUP BY 1)"


def _sightings(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "ball").select("match_id", "frame", F.col("img_x").alias("x"), F.col("img_y").alias("y"))


@query(with_views("ball") + _SIGHT + " SELECT match_id, round(step, 6) AS step FROM m")
def median_step(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.median_step(_sightings(spark, d)))


@query(
    with_views("ball")
    + _SIGHT
    + """ SELECT p.match_id, frame, round(x, 6) AS x, round(y, 6) AS y, round(px + (nx - px) * (frame - pf) / (nf - pf), 6) AS expected_x, round(py + (ny - py) * (frame - pf) / (nf - pf), 6) AS expected_y FROM p JOIN m ON p.match_id = m.match_id
 WHERE step > 0 AND frame - pf <= 3 AND nf - frame <= 3 AND sqrt((x - px) ** 2 + (y - py) ** 2) > 6 * step AND sqrt((x - nx) ** 2 + (y - ny) ** 2) > 6 * step AND sqrt((nx - px) ** 2 + (ny - py) ** 2) <= 6 * step"""
)
def teleports(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.teleports(_sightings(spark, d)))


_HOLDER = """, near AS (SELECT b.match_id, b.frame, track_id, sqrt((b.pitch_x - p.pitch_x) ** 2 + (b.pitch_y - p.pitch_y) ** 2) AS m, sqrt((b.img_x - p.img_x) ** 2 + (b.img_y - p.img_y) ** 2) AS px FROM ball b JOIN people p ON b.match_id = p.match_id AND b.frame = p.frame WHERE cls <> 3),
measured AS (SELECT match_id, frame, bool_or(m IS NOT NULL) AS metres FROM near GROUP BY 1, 2),
best AS (SELECT match_id, frame, track_id, d, metres, row_number() OVER (PARTITION BY match_id, frame ORDER BY d, track_id) AS r FROM (SELECT n.match_id, n.frame, track_id, metres, CASE WHEN metres THEN m ELSE px END AS d FROM near n JOIN measured x ON n.match_id = x.match_id AND n.frame = x.frame) WHERE d IS NOT NULL),
holder AS (SELECT b.match_id, b.frame, b.time_s, coalesce(track_id, -1) AS holder, coalesce(CASE WHEN track_id <= 11 THEN 1 WHEN track_id <= 22 THEN 2 END, 0) AS holder_team, d AS distance FROM ball b LEFT JOIN best n ON b.match_id = n.match_id AND b.frame = n.frame AND r = 1 AND d <= CASE WHEN metres THEN 2.4 ELSE 0.045 * 1920 END)"""


def _holder(spark: SparkSession, d: str) -> DataFrame:
    return P.nearest_holder(view(spark, d, "people"), view(spark, d, "ball"), view(spark, d, "teams"))


@query(with_views("people", "ball") + _HOLDER + " SELECT match_id, frame, CAST(holder AS INT) AS holder, CAST(holder_team AS INT) AS holder_team, round(distance, 6) AS distance FROM holder")
def ball_holder(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_holder(spark, d).drop("time_s"))


_STEADY = (
    _HOLDER
    + """, o AS (SELECT match_id, frame, time_s, CAST(holder AS INT) AS h, CAST(row_number() OVER (PARTITION BY match_id ORDER BY frame) AS INT) AS i FROM holder),
fold AS (SELECT match_id, 0 AS i, -1 AS cur, -1 AS cand, 0 AS run, 0 AS gap, -1 AS last_ FROM (SELECT DISTINCT match_id FROM o) UNION ALL
 SELECT match_id, i, CASE WHEN h = -1 THEN CASE WHEN gap + 1 > 4 THEN -1 ELSE cur END WHEN back OR take THEN h ELSE cur END,
 CASE WHEN h = -1 OR back OR h = cur OR take THEN -1 ELSE h END, CASE WHEN h = -1 OR back OR h = cur OR take THEN 0 ELSE streak END, CASE WHEN h = -1 THEN gap + 1 ELSE 0 END,
 CASE WHEN h = -1 OR back THEN last_ WHEN take THEN h WHEN cur <> -1 THEN cur ELSE last_ END
 FROM (SELECT *, NOT back AND h <> -1 AND h <> cur AND streak >= 4 AS take FROM (SELECT o.match_id, o.i, h, cur, gap, last_, h = last_ AND h <> -1 AND cur = -1 AND gap <= 2 AS back, CASE WHEN h = cand THEN run + 1 ELSE 1 END AS streak FROM fold JOIN o ON o.match_id = fold.match_id AND o.i = fold.i + 1) AS q1) AS q2),
steady AS (SELECT o.match_id, frame, time_s, cur AS holder, CASE WHEN cur < 1 THEN 0 WHEN cur <= 11 THEN 1 WHEN cur <= 22 THEN 2 ELSE 0 END AS holder_team FROM o JOIN fold ON o.match_id = fold.match_id AND o.i = fold.i)"""
)


def _steady(spark: SparkSession, d: str) -> DataFrame:
    return P.steady_holder(_holder(spark, d))


@query(with_views("people", "ball") + _STEADY + " SELECT match_id, frame, holder, CAST(holder_team AS INT) AS holder_team FROM steady")
def possession_smoothed(spark: SparkSession, d: str) -> DataFrame:
    return _steady(spark, d).select("match_id", "frame", "holder", "holder_team")


@query(with_views("people", "ball") + _STEADY + " SELECT match_id, CAST(holder_team AS INT) AS team, count(*) AS frames, round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY match_id), 1) AS share FROM steady WHERE holder_team > 0 GROUP BY 1, 2")
def possession_share(spark: SparkSession, d: str) -> DataFrame:
    return P.possession_share(_steady(spark, d))


@query(with_views("people", "ball") + _HOLDER + " SELECT match_id, CAST(floor(time_s / 30) AS INT) AS bucket, round_even(100.0 * count(*) FILTER (holder_team = 1) / count(*), 1) AS team_1, round_even(100.0 * count(*) FILTER (holder_team = 2) / count(*), 1) AS team_2 FROM holder WHERE holder >= 0 GROUP BY 1, 2")
def possession_timeline(spark: SparkSession, d: str) -> DataFrame:
    return P.possession_timeline(_holder(spark, d))


_SPELLS = (
    _STEADY
    + """, turn AS (SELECT *, sum(CASE WHEN holder IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame) AS run FROM (SELECT *, lag(holder) OVER (PARTITION BY match_id ORDER BY frame) AS prev FROM steady)),
runs AS (SELECT match_id, run, holder AS track_id, min(frame) AS start_frame, max(frame) AS end_frame, min(time_s) AS start_time, max(time_s) AS end_time FROM turn WHERE holder >= 0 GROUP BY 1, 2, 3 HAVING count(*) >= 2),
met AS (SELECT r.*, p.frame, p.pitch_x, p.pitch_y FROM runs r JOIN people p ON r.match_id = p.match_id AND r.track_id = p.track_id AND p.frame BETWEEN start_frame AND end_frame WHERE p.pitch_x IS NOT NULL AND p.pitch_y IS NOT NULL),
base AS (SELECT match_id, run, track_id, start_frame, end_frame, start_time, end_time, min(frame) AS contact_start, max(frame) AS contact_end, arg_min(pitch_x, frame) AS sx, arg_min(pitch_y, frame) AS sy, arg_max(pitch_x, frame) AS ex, arg_max(pitch_y, frame) AS ey FROM met GROUP BY 1, 2, 3, 4, 5, 6, 7),
spells AS (SELECT base.*, CAST(row_number() OVER (PARTITION BY base.match_id ORDER BY start_frame) AS INT) AS spell, CASE WHEN track_id <= 11 THEN 1 WHEN track_id <= 22 THEN 2 ELSE 0 END AS team, b.pitch_x AS bsx, b.pitch_y AS bsy, c.pitch_x AS bex, c.pitch_y AS bey, track_id IN (1, 12) AS is_goalkeeper FROM base LEFT JOIN ball b ON b.match_id = base.match_id AND b.frame = contact_start AND b.pitch_x IS NOT NULL LEFT JOIN ball c ON c.match_id = base.match_id AND c.frame = contact_end AND c.pitch_x IS NOT NULL)"""
)


def _spells(spark: SparkSession, d: str) -> DataFrame:
    people = view(spark, d, "people")
    return P.spells(_steady(spark, d), people, view(spark, d, "ball"), view(spark, d, "teams"), T.track_classes(people))


@query(with_views("people", "ball") + _SPELLS + " SELECT match_id, spell, track_id, CAST(team AS INT) AS team, start_frame, end_frame, contact_start, contact_end, round(sx, 6) AS start_x, round(sy, 6) AS start_y, round(ex, 6) AS end_x, round(ey, 6) AS end_y, round(bsx, 6) AS ball_start_x, round(bey, 6) AS ball_end_y, is_goalkeeper FROM spells")
def spells(spark: SparkSession, d: str) -> DataFrame:
    s = _spells(spark, d)
    return rounded(s.select("match_id", "spell", "track_id", "team", "start_frame", "end_frame", "contact_start", "contact_end", F.col("start_xy.x").alias("start_x"), F.col("start_xy.y").alias("start_y"), F.col("end_xy.x").alias("end_x"), F.col("end_xy.y").alias("end_y"), F.col("ball_start_xy.x").alias("ball_start_x"), F.col("ball_end_xy.y").alias("ball_end_y"), "is_goalkeeper"))


@query(with_views("people", "ball") + _SPELLS + """, ev AS (SELECT s.match_id, s.spell, coalesce(avg(CASE WHEN b.img_x IS NOT NULL THEN 1.0 ELSE 0.0 END) * avg(CASE WHEN b.img_x IS NOT NULL THEN least(greatest(conf / 0.7, 0), 1) END), 0) AS e FROM spells s LEFT JOIN ball b ON b.match_id = s.match_id AND b.frame BETWEEN s.start_frame AND s.end_frame GROUP BY 1, 2)
 SELECT match_id, spell, round(e, 6) AS evidence FROM ev""")
def spell_evidence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.evidence(_spells(spark, d), view(spark, d, "ball")))


_WAY = """, settled AS (SELECT match_id, track_id, CASE WHEN track_id IN (1, 12) THEN 1 WHEN track_id = 23 THEN 3 ELSE 2 END AS cls, CASE WHEN track_id <= 11 THEN 1 WHEN track_id <= 22 THEN 2 ELSE 0 END AS team FROM (SELECT DISTINCT match_id, track_id FROM people)),
placed AS (SELECT p.match_id, p.track_id, s.team, s.cls, p.pitch_x AS x FROM people p JOIN settled s ON p.match_id = s.match_id AND p.track_id = s.track_id WHERE p.pitch_x IS NOT NULL AND s.team IN (1, 2)),
per AS (SELECT match_id, team, track_id, median(x) AS x FROM placed GROUP BY 1, 2, 3),
deep AS (SELECT match_id, team, avg(x) FILTER (lo <= 2) AS low, avg(x) FILTER (hi <= 2) AS high FROM (SELECT *, row_number() OVER (PARTITION BY match_id, team ORDER BY x, track_id) AS lo, row_number() OVER (PARTITION BY match_id, team ORDER BY x DESC, track_id) AS hi FROM per) GROUP BY 1, 2),
goal AS (SELECT match_id, team, count(*) FILTER (cls = 1) AS n, median(x) FILTER (cls = 1) AS x FROM placed GROUP BY 1, 2),
way AS (SELECT d.match_id, d.team, CASE WHEN CASE WHEN n >= 10 THEN x WHEN abs(low) < abs(high - 105) THEN low ELSE high END < 52.5 THEN 1 ELSE -1 END AS direction FROM deep d JOIN goal g ON d.match_id = g.match_id AND d.team = g.team),
directions AS (SELECT w.match_id, w.team, CASE WHEN w.team = 2 AND w.direction = o.direction THEN -w.direction ELSE w.direction END AS direction FROM way w LEFT JOIN way o ON o.match_id = w.match_id AND o.team = 1)"""


def _directions(spark: SparkSession, d: str) -> DataFrame:
    people = view(spark, d, "people")
    return E.attacking_directions(people, view(spark, d, "teams"), T.track_classes(people))


@query(with_views("people") + _WAY + " SELECT match_id, CAST(team AS INT) AS team, CAST(direction AS INT) AS direction FROM directions")
def attacking_directions(spark: SparkSession, d: str) -> DataFrame:
    return _directions(spark, d)


_EVENTS = (
    _SPELLS
    + _WAY
    + """, sure AS (SELECT s.match_id, s.spell, coalesce(avg(CASE WHEN b.img_x IS NOT NULL THEN 1.0 ELSE 0.0 END) * avg(CASE WHEN b.img_x IS NOT NULL THEN least(greatest(conf / 0.7, 0), 1) END), 0) AS e FROM spells s LEFT JOIN ball b ON b.match_id = s.match_id AND b.frame BETWEEN s.start_frame AND s.end_frame GROUP BY 1, 2),
held AS (SELECT s.*, e, dd.direction AS dir, CASE WHEN dd.direction > 0 THEN 105e0 WHEN dd.direction < 0 THEN 0e0 END AS gx, coalesce(bex, ex) AS fx, coalesce(bey, ey) AS fy, coalesce(bsx, sx) AS tx, coalesce(bsy, sy) AS ty FROM spells s JOIN sure USING (match_id, spell) LEFT JOIN directions dd ON dd.match_id = s.match_id AND dd.team = s.team),
after AS (SELECT *, lead(track_id) OVER w AS n_track, lead(team) OVER w AS n_team, lead(start_frame) OVER w AS n_frame, lead(start_time) OVER w AS n_time, lead(is_goalkeeper) OVER w AS n_keeper, lead(e) OVER w AS n_e, lead(sx) OVER w AS nsx, lead(sy) OVER w AS nsy, lead(tx) OVER w AS ntx, lead(ty) OVER w AS nty FROM held WINDOW w AS (PARTITION BY match_id ORDER BY start_frame)),
aimed AS (SELECT *, coalesce(n_keeper AND n_team <> team, false) AS gathers FROM after),
flown AS (SELECT a.match_id, a.spell, list({'f': b.frame, 'x': b.pitch_x, 'y': b.pitch_y} ORDER BY b.frame) AS p FROM aimed a JOIN ball b ON b.match_id = a.match_id AND b.pitch_x IS NOT NULL AND b.frame BETWEEN a.contact_end AND least(coalesce(n_frame + CASE WHEN gathers THEN 17 ELSE 0 END, 1000000000), a.contact_end + 200) GROUP BY 1, 2),
turned AS (SELECT *, list_filter(range(3, len(p) + 1), lambda i: sqrt((p[2].x - p[1].x) ** 2 + (p[2].y - p[1].y) ** 2) >= 1e-6 AND sqrt((p[i].x - p[i - 1].x) ** 2 + (p[i].y - p[i - 1].y) ** 2) >= 1e-6
 AND ((p[2].x - p[1].x) * (p[i].x - p[i - 1].x) + (p[2].y - p[1].y) * (p[i].y - p[i - 1].y)) / (sqrt((p[2].x - p[1].x) ** 2 + (p[2].y - p[1].y) ** 2) * sqrt((p[i].x - p[i - 1].x) ** 2 + (p[i].y - p[i - 1].y) ** 2)) < -0.3) AS at_ FROM flown),
path AS (SELECT match_id, spell, CASE WHEN len(at_) > 0 THEN p[1:at_[1] - 1] ELSE p END AS p FROM turned),
struck AS (SELECT a.*, p, len(p) AS pn, p[1].x AS px, p[1].y AS py, p[-1].x - p[1].x AS vx, p[-1].y - p[1].y AS vy, p[-1].x AS lx, greatest((p[-1].f - p[1].f) / 25.0, 1e-3) AS secs FROM aimed a LEFT JOIN path USING (match_id, spell)),
tried AS (SELECT *, CASE WHEN abs(vx) >= 1e-6 THEN py + vy * ((gx - px) / vx) END AS yg, CASE WHEN abs(vx) >= 1e-6 THEN (gx - px) / vx END AS tg FROM struck),
shot AS (SELECT *, coalesce(pn >= 2 AND abs(px - gx) <= 35 AND sqrt(vx ** 2 + vy ** 2) >= 2 AND sqrt(vx ** 2 + vy ** 2) / secs >= 7 AND (abs(lx - gx) <= 14 OR gathers) AND sign(vx) = sign(dir) AND tg > 0 AND abs(yg - 34) <= 3.66 + 3.5, false) AS is_shot,
 list_filter(p, lambda q: CASE WHEN dir > 0 THEN q.x >= gx - 0.5 ELSE q.x <= gx + 0.5 END)[1] AS over_, greatest(n_time - end_time, 1e-3) AS flight, sqrt((ntx - fx) ** 2 + (nty - fy) ** 2) AS far, sqrt((nsx - ex) ** 2 + (nsy - ey) ** 2) AS near_, coalesce(team > 0 AND n_team > 0 AND team = n_team, false) AS same FROM tried),
judged AS (SELECT *, CASE WHEN over_ IS NOT NULL AND abs(over_.y - 34) <= 3.66 THEN 'Goal' WHEN over_ IS NOT NULL THEN 'Off Target' WHEN n_keeper THEN 'Saved' WHEN abs(nsx - gx) < 18 THEN 'Blocked' WHEN abs(yg - 34) <= 3.66 THEN 'Saved' ELSE 'Off Target' END AS result,
 CASE WHEN over_ IS NOT NULL AND abs(over_.y - 34) <= 3.66 THEN 0.75 WHEN over_ IS NOT NULL THEN 0.7 WHEN n_keeper THEN 0.65 WHEN abs(nsx - gx) < 18 THEN 0.5 WHEN abs(yg - 34) <= 3.66 THEN 0.4 ELSE 0.45 END AS prior,
 coalesce(CASE WHEN dir > 0 THEN fx > 70 ELSE fx < 35 END AND (fy < 34 - 20.16 OR fy > 34 + 20.16) AND nty BETWEEN 34 - 20.16 AND 34 + 20.16 AND CASE WHEN dir > 0 THEN ntx >= 88.5 ELSE ntx <= 16.5 END AND dir IS NOT NULL, false) AS is_cross,
 coalesce(CASE WHEN dir > 0 THEN fx < 105 * 0.34 ELSE fx > 105 * 0.66 END AND far >= 22 AND dir IS NOT NULL, false) AS is_clear,
 NOT is_shot AND n_track IS NOT NULL AND flight <= 8 AS on_ FROM shot),
ruled AS (SELECT *, on_ AND NOT same AND near_ <= 3.5 AND flight <= 1.2 AS is_tackle FROM judged),
play AS (SELECT *, on_ AND NOT is_tackle AND far >= 3 AND far <= CASE WHEN is_goalkeeper THEN 85 ELSE 60 END AS moved FROM ruled),
made AS (
 SELECT match_id, spell * 10 AS seq, team, track_id, 'Dribble' AS event, CASE WHEN n_team = team THEN 'Successful' ELSE 'Failed' END AS outcome, end_frame AS frame, end_time AS time_s, sx AS start_x, sy AS start_y, ex AS end_x, ey AS end_y, 0.55 AS prior, e FROM play WHERE sqrt((ex - sx) ** 2 + (ey - sy) ** 2) >= 4 AND end_time - start_time > 0.4
 UNION ALL SELECT match_id, spell * 10 + 1, team, track_id, 'Shot', result, end_frame, end_time, fx, fy, gx, yg, prior, e FROM play WHERE is_shot
 UNION ALL SELECT match_id, spell * 10 + 2, n_team, n_track, 'Tackle', 'Successful', n_frame, n_time, nsx, nsy, NULL, NULL, 0.55, n_e FROM play WHERE is_tackle
 UNION ALL SELECT match_id, spell * 10 + 3, team, track_id, CASE WHEN is_cross THEN 'Cross' ELSE 'Pass' END, 'Successful', end_frame, end_time, fx, fy, ntx, nty, CASE WHEN is_cross OR far >= 32 THEN 0.6 ELSE 0.75 END, e FROM play WHERE moved AND same
 UNION ALL SELECT match_id, spell * 10 + 4, team, track_id, 'Clearance', '', end_frame, end_time, fx, fy, ntx, nty, 0.5, e FROM play WHERE moved AND NOT same AND is_clear
 UNION ALL SELECT match_id, spell * 10 + 5, team, track_id, CASE WHEN is_cross THEN 'Cross' ELSE 'Pass' END, 'Unsuccessful', end_frame, end_time, fx, fy, ntx, nty, 0.65, e FROM play WHERE moved AND NOT same AND NOT is_clear
 UNION ALL SELECT match_id, spell * 10 + 6, n_team, n_track, 'Interception', '', n_frame, n_time, nsx, nsy, NULL, NULL, 0.55, n_e FROM play WHERE moved AND NOT same AND NOT is_clear),
told AS (SELECT match_id, CAST(seq AS BIGINT) AS seq, CAST(team AS INT) AS team, CAST(track_id AS INT) AS track_id, event, outcome, frame, time_s, start_x, start_y, end_x, end_y, round_even(prior * (0.55 + 0.45 * e), 3) AS confidence FROM made),
fits AS (SELECT s.match_id, s.seq AS shot, dense_rank() OVER (PARTITION BY s.match_id ORDER BY s.seq) AS i, p.seq AS pass, p.time_s FROM told s JOIN told p ON p.match_id = s.match_id AND s.event = 'Shot' AND p.event = 'Pass' AND p.outcome = 'Successful' AND p.team = s.team AND p.end_x IS NOT NULL AND s.time_s - p.time_s > 0 AND s.time_s - p.time_s <= 5 AND sqrt((p.end_x - s.start_x) ** 2 + (p.end_y - s.start_y) ** 2) <= 6),
offers AS (SELECT match_id, i, list(pass ORDER BY time_s DESC, pass) AS l FROM fits GROUP BY 1, 2),
chosen AS (SELECT match_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS taken FROM (SELECT DISTINCT match_id FROM offers) UNION ALL SELECT o.match_id, o.i, CASE WHEN len(list_filter(l, lambda q: NOT list_contains(taken, q))) > 0 THEN list_append(taken, list_filter(l, lambda q: NOT list_contains(taken, q))[1]) ELSE taken END FROM chosen c JOIN offers o ON o.match_id = c.match_id AND o.i = c.i + 1),
assists AS (SELECT DISTINCT match_id, unnest(taken) AS seq FROM chosen),
events_ AS (SELECT t.* REPLACE (CASE WHEN a.seq IS NOT NULL THEN 'Shot Assist' ELSE event END AS event, CASE WHEN a.seq IS NOT NULL THEN least(confidence, 0.6) ELSE confidence END AS confidence) FROM told t LEFT JOIN assists a ON a.match_id = t.match_id AND a.seq = t.seq)"""
)
_EVENT_ROW = "match_id, seq, team, track_id, event, outcome, frame, round(time_s, 6) AS time_s, round(start_x, 6) AS start_x, round(start_y, 6) AS start_y, round(end_x, 6) AS end_x, round(end_y, 6) AS end_y, confidence"


def _transitions(spark: SparkSession, d: str) -> DataFrame:
    # spells and directions are read several times, so they are written out first
    return E.transitions(stored(_spells(spark, d)), view(spark, d, "ball"), stored(_directions(spark, d)))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events of all matches, written out, as what follows reads them several times."""
    return stored(E.shot_assists(_transitions(spark, d)))


@query(with_views("people", "ball") + _EVENTS + f" SELECT {_EVENT_ROW} FROM told")
def transition_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_transitions(spark, d))


@query(with_views("people", "ball") + _EVENTS + f" SELECT {_EVENT_ROW} FROM events_")
def shot_assists(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.shot_assists(_transitions(spark, d)))


def _grid(x: str, length: str, size: str) -> str:
    return f"round_even(least(greatest(({length} - {x}) / {length} * {size}, 0), {size}), 1)"


@query(
    with_views("people", "ball")
    + _EVENTS
    + f""" SELECT match_id, seq, team, track_id, event, outcome, CAST(floor(time_s / 60) AS INT) AS mins, CAST(floor(time_s - 60 * floor(time_s / 60)) AS INT) AS secs, {_grid('start_x', '105', '120')} AS x, {_grid('start_y', '68', '80')} AS y,
 CASE WHEN end_x IS NOT NULL THEN {_grid('end_x', '105', '120')} END AS x2, CASE WHEN end_x IS NOT NULL THEN {_grid('end_y', '68', '80')} END AS y2, 2 AS half, 'ai' AS source, round_even(confidence, 2) AS confidence, frame FROM events_"""
)
def tagger_rows(spark: SparkSession, d: str) -> DataFrame:
    return E.tagger_rows(E.shot_assists(_transitions(spark, d)), half=2)


def _players(spark: SparkSession, d: str, events: DataFrame) -> DataFrame:
    people = view(spark, d, "people")
    return S.player_table(events, people, view(spark, d, "teams"), T.track_classes(people))


_PLAYERS = (
    _EVENTS
    + """, lagged AS (SELECT *, lag(pitch_x) OVER w AS ax, lag(pitch_y) OVER w AS ay, lag(time_s) OVER w AS at_, lag(pitch_x, 10) OVER w AS bx, lag(pitch_y, 10) OVER w AS by_, lag(time_s, 10) OVER w AS bt FROM people WHERE pitch_x IS NOT NULL AND pitch_y IS NOT NULL WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame)),
paced AS (SELECT *, sqrt((pitch_x - ax) ** 2 + (pitch_y - ay) ** 2) AS d, sqrt((pitch_x - bx) ** 2 + (pitch_y - by_) ** 2) / nullif(time_s - bt, 0) AS vk FROM lagged),
walked AS (SELECT match_id, track_id, coalesce(sum(CASE WHEN d / nullif(time_s - at_, 0) <= 12 THEN d END), 0.0) AS distance_m, coalesce(max(CASE WHEN vk <= 12 THEN vk * 3.6 END), 0.0) AS top_kmh, (max(time_s) - min(time_s)) / 60 AS minutes, avg(pitch_x) AS avg_x, avg(pitch_y) AS avg_y FROM paced GROUP BY 1, 2 HAVING count(*) >= 2),
did AS (SELECT match_id, track_id, count(*) AS touches, count(*) FILTER (event IN ('Pass', 'Cross', 'Shot Assist')) AS passes, count(*) FILTER ((event IN ('Pass', 'Cross') AND outcome = 'Successful') OR event = 'Shot Assist') AS passes_completed, count(*) FILTER (event = 'Cross') AS crosses, count(*) FILTER (event = 'Shot') AS shots, count(*) FILTER (event = 'Shot' AND outcome = 'Goal') AS goals,
 count(*) FILTER (event = 'Shot Assist') AS shot_assists, count(*) FILTER (event = 'Dribble') AS dribbles, count(*) FILTER (event = 'Tackle') AS tackles, count(*) FILTER (event = 'Interception') AS interceptions, count(*) FILTER (event = 'Clearance') AS clearances FROM events_ GROUP BY 1, 2),
tracked AS (SELECT match_id, track_id, count(*) AS n_rows FROM people GROUP BY 1, 2 HAVING count(*) >= 25),
players AS (SELECT t.match_id, t.track_id, CAST(coalesce(s.team, 0) AS INT) AS team, CASE WHEN s.cls = 1 THEN 'goalkeeper' ELSE 'player' END AS role, coalesce(touches, 0) AS touches, coalesce(passes, 0) AS passes, coalesce(passes_completed, 0) AS passes_completed, coalesce(crosses, 0) AS crosses, coalesce(shots, 0) AS shots, coalesce(goals, 0) AS goals, coalesce(shot_assists, 0) AS shot_assists,
 coalesce(dribbles, 0) AS dribbles, coalesce(tackles, 0) AS tackles, coalesce(interceptions, 0) AS interceptions, coalesce(clearances, 0) AS clearances, coalesce(distance_m, 0.0) AS distance_m, coalesce(top_kmh, 0.0) AS top_kmh, coalesce(w.minutes, n_rows / 25 / 60) AS minutes, avg_x, avg_y
 FROM tracked t JOIN settled s USING (match_id, track_id) LEFT JOIN did ON did.match_id = t.match_id AND did.track_id = t.track_id LEFT JOIN walked w ON w.match_id = t.match_id AND w.track_id = t.track_id WHERE s.cls <> 3),
teams_ AS (SELECT f.match_id, CAST(f.team AS INT) AS team, coalesce(share, 0.0) AS possession, coalesce(passes, 0) AS passes, coalesce(passes_completed, 0) AS passes_completed, coalesce(shots, 0) AS shots, coalesce(shots_on_target, 0) AS shots_on_target, coalesce(goals, 0) AS goals, coalesce(crosses, 0) AS crosses, coalesce(dribbles, 0) AS dribbles, coalesce(tackles, 0) AS tackles, coalesce(interceptions, 0) AS interceptions, coalesce(clearances, 0) AS clearances,
 round(coalesce(km, 0.0), 2) AS distance_km, coalesce(n, 0) AS players, CASE WHEN coalesce(passes, 0) > 0 THEN round_even(100.0 * passes_completed / passes, 1) ELSE 0.0 END AS pass_accuracy
 FROM (SELECT DISTINCT match_id, t.range AS team FROM frames CROSS JOIN range(1, 3) t) f
 LEFT JOIN (SELECT match_id, team, count(*) FILTER (event IN ('Pass', 'Cross', 'Shot Assist')) AS passes, count(*) FILTER ((event IN ('Pass', 'Cross') AND outcome = 'Successful') OR event = 'Shot Assist') AS passes_completed, count(*) FILTER (event = 'Shot') AS shots, count(*) FILTER (event = 'Shot' AND outcome IN ('Goal', 'Saved')) AS shots_on_target, count(*) FILTER (event = 'Shot' AND outcome = 'Goal') AS goals, count(*) FILTER (event = 'Cross') AS crosses,
  count(*) FILTER (event = 'Dribble') AS dribbles, count(*) FILTER (event = 'Tackle') AS tackles, count(*) FILTER (event = 'Interception') AS interceptions, count(*) FILTER (event = 'Clearance') AS clearances FROM events_ GROUP BY 1, 2) c ON c.match_id = f.match_id AND c.team = f.team
 LEFT JOIN (SELECT match_id, team, sum(distance_m) / 1000 AS km, count(*) AS n FROM players GROUP BY 1, 2) q ON q.match_id = f.match_id AND q.team = f.team
 LEFT JOIN (SELECT match_id, holder_team AS team, round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY match_id), 1) AS share FROM steady WHERE holder_team > 0 GROUP BY 1, 2) h ON h.match_id = f.match_id AND h.team = f.team),
links AS (SELECT match_id, team, from_id, to_id, count(*) AS n FROM (SELECT e.match_id, e.team, e.seq, e.track_id AS from_id, p.track_id AS to_id, row_number() OVER (PARTITION BY e.match_id, e.team, e.seq, e.track_id ORDER BY sqrt((avg_x - end_x) ** 2 + (avg_y - end_y) ** 2), p.track_id) AS r FROM events_ e JOIN players p ON p.match_id = e.match_id AND p.team = e.team AND avg_x IS NOT NULL
 WHERE ((event IN ('Pass', 'Cross') AND outcome = 'Successful') OR (event = 'Shot Assist' AND outcome IN ('Successful', ''))) AND end_x IS NOT NULL) AS x WHERE r = 1 AND from_id <> to_id GROUP BY 1, 2, 3, 4)"""
)


@query(with_views("people", "ball") + _PLAYERS + " SELECT * REPLACE (round(distance_m, 6) AS distance_m, round(top_kmh, 6) AS top_kmh, round(minutes, 6) AS minutes, round(avg_x, 6) AS avg_x, round(avg_y, 6) AS avg_y) FROM players")
def player_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_players(spark, d, _events(spark, d)))


@query(with_views("people", "ball") + _PLAYERS + " SELECT * FROM teams_")
def team_table(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    return S.team_table(events, _players(spark, d, events), P.possession_share(_steady(spark, d)), view(spark, d, "frames"))


@query(with_views("people", "ball") + _PLAYERS + " SELECT * FROM links WHERE n >= 2")
def pass_network(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    return S.pass_network(events, _players(spark, d, events))


@query(with_views("people", "ball") + _PLAYERS + " SELECT match_id, team, track_id, round_even(avg_x, 1) AS x, round_even(avg_y, 1) AS y, touches FROM players WHERE avg_x IS NOT NULL AND team IN (1, 2)")
def pass_nodes(spark: SparkSession, d: str) -> DataFrame:
    return S.pass_nodes(_players(spark, d, _events(spark, d)))


@query(with_views("people", "ball") + _EVENTS + " SELECT match_id, count(DISTINCT track_id) AS tracked, round_even((max(time_s) - min(time_s)) / 60, 1) AS minutes, coalesce(any_value(n), 0) AS events FROM people LEFT JOIN (SELECT match_id AS m, count(*) AS n FROM events_ GROUP BY 1) ON m = match_id GROUP BY 1")
def match_totals(spark: SparkSession, d: str) -> DataFrame:
    return S.totals(_events(spark, d), view(spark, d, "people"))


@query(
    with_views("people", "ball")
    + _PLAYERS
    + " SELECT f.match_id, coalesce(p.l, []) AS players, coalesce(t.goals, []) AS goals, coalesce(l.n, 0) AS links FROM (SELECT DISTINCT match_id FROM people) f LEFT JOIN (SELECT match_id, list(track_id ORDER BY team, -touches, track_id) AS l FROM players GROUP BY 1) p USING (match_id) LEFT JOIN (SELECT match_id, list(goals ORDER BY team) AS goals FROM teams_ GROUP BY 1) t USING (match_id) LEFT JOIN (SELECT match_id, count(*) AS n FROM links WHERE n >= 2 GROUP BY 1) l USING (match_id)"
)
def match_summary(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    steady = stored(_steady(spark, d))
    players = stored(_players(spark, d, events))
    team = S.team_table(events, players, P.possession_share(steady), view(spark, d, "frames"))
    out = S.summary(players, team, S.pass_network(events, players), P.possession_timeline(_holder(spark, d)), S.totals(events, view(spark, d, "people")))
    read = F.from_json("payload", "players array<struct<track_id:int>>, teams array<struct<goals:bigint>>, links array<struct<n:bigint>>")
    none = F.array()
    return out.select("match_id", read.alias("p")).select("match_id", F.coalesce(F.col("p.players.track_id"), none.cast("array<int>")).alias("players"), F.coalesce(F.col("p.teams.goals"), none.cast("array<bigint>")).alias("goals"), F.greatest(F.coalesce(F.size("p.links"), F.lit(0)), F.lit(0)).cast("bigint").alias("links"))
