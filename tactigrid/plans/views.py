"""Match relations derived from the plain tables by integer arithmetic that Spark and DuckDB
agree on, so that every operator can run on data of any size and be held against SQL.

The texts are valid in both dialects once ``{div}`` is put in; ``e`` notation makes doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Every event is a frame; 4000 of them are a match.
FRAMES = "SELECT event_id {div} 4000 AS match_id, event_id % 4000 AS k, (event_id % 4000) * 2 AS frame, (event_id % 4000) / 125e-1 AS time_s FROM events"

#: Where a track is at step k: keepers and the referee stand, the others walk to and fro.
_X = "(abs((k * 24 + {t} * 997) % 21000 - 10500) / 1e2)"
_Y = "(abs((k * 11 + {t} * 617) % 13600 - 6800) / 1e2)"

PEOPLE = (
    "SELECT match_id, frame, time_s, track_id, cls, img_x - 10e0 AS x1, img_y - 40e0 AS y1, img_x + 10e0 AS x2, img_y AS y2, img_x, img_y,"
    " CASE WHEN (k + track_id) % 41 = 0 THEN NULL ELSE px END AS pitch_x, CASE WHEN (k + track_id) % 41 = 0 THEN NULL ELSE py END AS pitch_y"
    " FROM (SELECT match_id, k, frame, time_s, track_id, cls, px, py, px * 16e0 + 100e0 AS img_x, py * 10e0 + 200e0 AS img_y"
    " FROM (SELECT match_id, k, frame, time_s, track_id, CASE WHEN track_id IN (1, 12) THEN 1 WHEN track_id = 23 THEN 3 WHEN (k + track_id) % 50 = 7 THEN 3 ELSE 2 END AS cls,"
    " CASE WHEN track_id = 1 THEN 4e0 WHEN track_id = 12 THEN 101e0 ELSE " + _X.format(t="track_id") + " + CASE WHEN k % 97 = 0 AND track_id % 2 = 1 THEN 40e0 WHEN k % 7 = 0 THEN 5e-1 ELSE 0e0 END END AS px,"
    " CASE WHEN track_id IN (1, 12) THEN 34e0 ELSE " + _Y.format(t="track_id") + " END AS py"
    " FROM frames CROSS JOIN ids WHERE (k + track_id * 7) % 29 <> 0 AND NOT (track_id = 22 AND k > 15)) AS a) AS b"
)

#: The ball is with somebody for nine of twelve steps. Who has it near the goal they attack shoots:
#: from the sixth step on it flies to a place in or beside the goal.
BALL = (
    "SELECT match_id, frame, time_s, CASE WHEN seen THEN bx * 16e0 + 100e0 END AS img_x, CASE WHEN seen THEN by_ * 10e0 + 200e0 END AS img_y,"
    " CASE WHEN seen AND k % 23 <> 5 THEN bx END AS pitch_x, CASE WHEN seen AND k % 23 <> 5 THEN by_ END AS pitch_y, CASE WHEN seen THEN (40 + k % 50) / 97e0 ELSE 0e0 END AS conf"
    " FROM (SELECT match_id, frame, time_s, k, k % 12 < 9 AND NOT (k BETWEEN 200 AND 230) AS seen,"
    " CASE WHEN shoots THEN cx + (goal - cx) * (k % 12 - 4) / 4e0 ELSE cx + 5e-1 + CASE WHEN k % 61 = 20 THEN 30e0 ELSE 0e0 END END AS bx,"
    " CASE WHEN shoots THEN cy + (34e0 + ((k {div} 12 + match_id) % 5 - 2) * 2e0 - cy) * (k % 12 - 4) / 4e0 ELSE cy + 25e-2 END AS by_"
    " FROM (SELECT *, CASE WHEN carrier <= 11 THEN 105e0 ELSE 0e0 END AS goal, k % 12 > 4 AND ((carrier <= 11 AND cx >= 75e0) OR (carrier > 11 AND cx <= 30e0)) AS shoots"
    " FROM (SELECT *, " + _X.format(t="carrier") + " AS cx, " + _Y.format(t="carrier") + " AS cy FROM (SELECT match_id, frame, time_s, k, 2 + ((k {div} 12 + match_id) * 5) % 21 AS carrier FROM frames) AS c) AS p) AS q) AS d"
)

TEAMS = "SELECT DISTINCT match_id, track_id, CASE WHEN track_id <= 11 THEN 1 WHEN track_id <= 22 THEN 2 ELSE 0 END AS team FROM people"

#: Tag rows: what a person or the analysis stored for a match.
TAGS = (
    "SELECT event_id, user_id % 8 AS match_id, CASE WHEN event_id % 2 = 0 THEN 'Home' ELSE 'Away' END AS team, 'Player ' || CAST(user_id % 11 AS VARCHAR(10)) AS player,"
    " CASE event_type WHEN 'view' THEN 'Pass' WHEN 'click' THEN 'Dribble' WHEN 'purchase' THEN 'Shot' WHEN 'signup' THEN 'Tackle' ELSE 'Cross' END AS event,"
    " CASE WHEN event_type = 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 'Goal' WHEN 1 THEN 'Saved' WHEN 2 THEN 'Off Target' ELSE 'Blocked' END WHEN event_id % 3 = 0 THEN 'Unsuccessful' ELSE 'Successful' END AS outcome,"
    " event_id {div} 60 % 45 AS mins, event_id % 60 AS secs, (event_id * 7 % 1200) / 1e1 AS x, (event_id * 13 % 800) / 1e1 AS y,"
    " CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id * 11 % 1200) / 1e1 END AS x2, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id * 17 % 800) / 1e1 END AS y2,"
    " 1 + event_id {div} 60 % 90 {div} 45 AS half, CASE event_id % 3 WHEN 0 THEN 'ai' WHEN 1 THEN 'manual' END AS source,"
    " CASE WHEN event_id % 3 = 0 THEN (event_id * 37 % 100) / 1e2 END AS confidence, CASE WHEN event_id % 3 = 0 THEN CAST(1 + event_id % 22 AS INT) END AS track_id, CASE WHEN event_id % 3 = 0 THEN event_id * 2 % 90000 END AS frame FROM events"
)

TEXTS = {"frames": FRAMES, "ids": None, "people": PEOPLE, "ball": BALL, "teams": TEAMS, "tags": TAGS}
NEEDS = {"frames": [], "people": ["frames", "ids"], "ball": ["frames"], "teams": ["people"], "tags": []}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "ids":
        return spark.range(1, 24).selectExpr("cast(id as int) AS track_id")
    inputs = {n: view(spark, sf_dir, n) for n in NEEDS[name]} or {"events": spark.read.parquet(f"{sf_dir}/events.parquet")}
    text = TEXTS[name].replace("{div}", "div")
    for n in inputs:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(text, **inputs)


def with_views(*names: str) -> str:
    """``WITH`` clauses for DuckDB that define the views named and those they need."""
    wanted: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in wanted:
            wanted.append(n)

    for n in names:
        add(n)
    text = {n: "SELECT CAST(range AS INT) AS track_id FROM range(1, 24)" if n == "ids" else TEXTS[n].replace("{div}", "//") for n in wanted}
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({t})" for n, t in text.items())
