"""Readers and writers round trip, and the streams against their batch editions."""

from __future__ import annotations

import csv
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tactigrid.config import Possession
from tactigrid.operators import calibration as C
from tactigrid.operators import evaluate as V
from tactigrid.operators import stats as S
from tactigrid.operators import stitch as Z
from tactigrid.operators import sweep as W
from tactigrid.operators import teams as TM
from tactigrid.sources import readers, writers

TAGS = "event_id bigint, match_id bigint, team string, player string, event string, outcome string, mins int, secs int, x double, y double, x2 double, y2 double, half int, source string, confidence double"


@pytest.fixture(scope="module")
def tags(spark):
    rows = [(k, k % 3, "Home, FC" if k % 2 else 'The "Away"', f"P\n{k}" if k == 5 else f"P{k}", "Pass", "", 30 - k, k, 1.5 * k, 2.0, None, None, 1 + k % 2, "ai", None if k % 4 else 0.125 * k) for k in range(9)]
    return spark.createDataFrame(rows, TAGS)


def one_file(path):
    return next(Path(path).glob("part-*")).read_text()


def test_csv_is_read_back_as_it_was(tags, tmp_path):
    writers.write_csv(tags.coalesce(1), f"{tmp_path}/csv")
    text = "".join(p.read_text() for p in sorted(Path(f"{tmp_path}/csv").glob("part-*")))
    rows = [r for r in csv.reader(text.splitlines(keepends=True)) if r != writers.EXPORT]
    want = sorted(tags.collect(), key=lambda r: (r.match_id, r.mins, r.secs, r.event_id))
    assert [(r[0], r[1], r[4], r[12]) for r in rows] == [(w.team, w.player, str(w.mins), "" if w.confidence is None else str(round(w.confidence, 2))) for w in want]


def test_json_and_events_files(spark, tags, tmp_path):
    writers.write_json(tags, f"{tmp_path}/json")
    assert sorted(r.player for r in spark.read.json(f"{tmp_path}/json").collect()) == sorted(r.player for r in tags.collect())
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps([{"Team": "A", "Event": "Pass", "Mins": 3}]))
    (tmp_path / "in/b.json").write_text(json.dumps({"events": [{"Team": "B", "Event": "Shot", "X": 1.5}, {"Team": "C"}]}))
    got = readers.events_json(spark, f"{tmp_path}/in")
    assert sorted((r.file, r.Team, r.Mins, r.X) for r in got.collect()) == [("a.json", "A", 3.0, None), ("b.json", "B", None, 1.5), ("b.json", "C", None, None)]


def test_label_files(spark, tmp_path):
    (tmp_path / "box").mkdir()
    (tmp_path / "box/f1.txt").write_text("0 0.5 0.25 0.1 0.2\n1 0 0 0 0\n")
    (tmp_path / "box/f2.txt").write_text("\n")
    got = readers.box_labels(spark, f"{tmp_path}/box", 200.0, 100.0).collect()
    assert [(r.name, r.cls, r.x1, r.y1, r.x2, r.y2) for r in got] == [("f1", 0, pytest.approx(90.0), pytest.approx(15.0), pytest.approx(110.0), pytest.approx(35.0))]
    (tmp_path / "pose").mkdir()
    (tmp_path / "pose/p.txt").write_text(" ".join(str(v) for v in [0, 0.5, 0.5, 1, 1, *[w for k in range(4) for w in (k / 10, k / 5, 2)]]))
    points = readers.pose_labels(spark, f"{tmp_path}/pose", 4).first().keypoints
    assert [(p.x, p.y, p.v) for p in points] == [(0.0, 0.0, 2.0), (0.1, 0.2, 2.0), (0.2, 0.4, 2.0), (0.3, 0.6, 2.0)]


def test_the_match_store(spark, tags, tmp_path, monkeypatch):
    path = f"{tmp_path}/store"
    writers.save_matches(tags, path)
    assert [r.event_id for r in readers.match_events(spark, path, 1).collect()] == [7, 4, 1]
    writers.replace_matches(tags.where("event_id = 4"), path)
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == [0, 2, 3, 4, 5, 6, 8]
    writers.delete_matches(spark, path, [0])
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == [2, 4, 5, 8]
    writers.save_matches(tags.where("event_id = 0").withColumn("note", F.lit("new")), path)
    assert sorted((r.event_id, r.note) for r in writers.merged_store(spark, path).collect()) == [(0, "new"), (2, None), (4, None), (5, None), (8, None)]
    monkeypatch.setattr(writers, "MOST_EVENTS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        writers.save_matches(tags, path)
    readers.append_observations(tags.select("match_id", "event_id"), f"{tmp_path}/o")
    readers.append_observations(tags.select("match_id", "event_id"), f"{tmp_path}/o")
    assert spark.read.parquet(f"{tmp_path}/o").count() == 18
    assert readers.cached(tags, f"{tmp_path}/kept").count() == 9
    assert readers.cached(tags.where("false"), f"{tmp_path}/kept").count() == 9  # what was kept is read


def test_results_of_jobs_are_saved(spark):
    results = spark.createDataFrame([(1, '{"events":[{"event":"Pass"},{"event":"Shot"}]}'), (2, '{"events":[{"event":"Pass"}]}')], "job_id bigint, result string")
    body = spark.createDataFrame([(2, [("Cross",)])], "job_id bigint, events array<struct<event:string>>")
    got = writers.save_result(body, results, "array<struct<event:string>>")
    assert sorted((r.job_id, r.event) for r in got.collect()) == [(1, "Pass"), (1, "Shot"), (2, "Cross")]


def test_reports(spark):
    teams = spark.createDataFrame([(1, 61.5, 8, 10, 80.0, 3, 1, 2.5)], "team int, possession double, passes_completed bigint, passes bigint, pass_accuracy double, shots bigint, goals bigint, distance_km double")
    players = spark.createDataFrame([(k, 1, 20 - k, 5, 4, 0, 0, 0, 0, 100.0, 20.0) for k in range(15)], "track_id int, team int, touches bigint, passes bigint, passes_completed bigint, shots bigint, goals bigint, tackles bigint, interceptions bigint, distance_m double, top_kmh double")
    text = writers.report(teams, players)
    assert "61.5" in text and "8/10" in text.replace(" ", "")
    text = writers.metrics_report([None, {"model": "ball", "split": "test", "metrics": [("found", 0.9)]}, {"model": "players", "columns": ["class", "recall"], "rows": [("keeper", 0.8)]}])
    assert text.split("\n") == ["# Model evaluation", "", "## ball  (test)", "", "| metric | value |", "|---|---|", "| found | 0.9 |", "", "## players  ()", "", "| class | recall |", "|---|---|", "| keeper | 0.8 |", ""]


def streamed(spark, tmp_path, rows, schema, stream, name, per=10, mode="append"):
    """What ``stream`` gives over files of ``per`` frames each, one a batch."""
    every = spark.createDataFrame(rows, schema)
    last = max(r[1] for r in rows)
    for k in range(last // per + 1):
        every.where(F.col("frame").between(k * per, k * per + per - 1)).coalesce(1).write.parquet(f"{tmp_path}/{name}/in/b{k:03d}")
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in/*")
    q = stream(found).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}/c").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name), every


def test_cuts_in_a_stream(spark, tmp_path):
    from tactigrid.operators.segments import find_cuts
    from tactigrid.streaming.stateful import cut_stream

    rng = random.Random(4)
    rows = [(m, i, None if i == 0 else 0.5 if i in (17, 33) else rng.uniform(0.001, 0.012)) for m in (1, 2) for i in range(48)]
    got, every = streamed(spark, tmp_path, rows, "match_id bigint, frame bigint, step double", cut_stream, "cuts")
    key = lambda df: sorted((r.match_id, r.frame, r.cut) for r in df.collect())
    assert key(got) == key(find_cuts(every)) and sum(r[2] for r in key(got)) == 4


def test_the_last_homography_in_a_stream(spark, tmp_path):
    from tactigrid.streaming.stateful import calibration_stream

    solved, cuts = {0, 12, 60}, {30}
    rows = [(7, i, i in cuts, [float(i)] * 9 if i in solved else None) for i in range(100)]
    got, _ = streamed(spark, tmp_path, rows, "match_id bigint, frame bigint, cut boolean, matrix array<double>", lambda s: calibration_stream(s, 25), "homographies", 16)
    want = {}
    for i in range(100):
        since = max((c for c in cuts if c <= i), default=0)
        last = max((s for s in solved if since <= s <= i), default=None)
        want[i] = last if last is not None and i - last <= 25 else None
    assert {r.frame: r.solved_frame for r in got.collect()} == want
    assert all((r.matrix is None) == (r.solved_frame is None) and (r.matrix is None or r.matrix[0] == r.solved_frame) for r in got.collect())


def test_votes_and_timeline_in_a_stream(spark, tmp_path):
    from tactigrid.operators.possession import possession_timeline
    from tactigrid.streaming.stateful import timeline_stream, votes_stream

    rows = [(1, i, i / 1.0, i % 5 - 1, 1 + i % 2) for i in range(100)]
    schema = "match_id bigint, frame bigint, time_s double, holder int, holder_team int"
    got, every = streamed(spark, tmp_path, rows, schema, timeline_stream, "timeline")
    # the last window is open still: nothing later has come
    want = sorted((r.team_1, r.team_2) for r in possession_timeline(every).where("bucket < 2").collect())
    assert sorted((r.team_1, r.team_2) for r in got.collect())[: len(want)] == want or sorted((r.team_1, r.team_2) for r in got.collect()) == want
    got, every = streamed(spark, tmp_path, [(1, i, i % 3, 1 + (i % 7 > 2)) for i in range(40)], "match_id bigint, frame bigint, track_id int, team int", votes_stream, "votes", mode="complete")
    key = lambda df: sorted((r.track_id, r.team, r.n) for r in df.collect())
    assert key(got) == key(every.groupBy("track_id", "team").agg(F.count("*").alias("n")))


def test_keepers_stand_far_from_their_own(spark):
    # team 1 is high up the pitch, team 2 sits deep at the right: the keeper at the left is team 1's
    people = [(1, f, t, cls, x) for f in range(12) for t, cls, x in ((40, 1, 6.0), (41, 1, 99.0), (50, 2, 58.0 + f % 3), (51, 2, 66.0), (60, 2, 80.0), (61, 2, 84.0 - f % 2))]
    p = spark.createDataFrame(people, "match_id bigint, frame bigint, track_id int, cls int, pitch_x double")
    teams = spark.createDataFrame([(1, 50, 1), (1, 51, 1), (1, 60, 2), (1, 61, 2)], "match_id bigint, track_id int, team int")
    classes = spark.createDataFrame([(1, 40, 1), (1, 41, 1), (1, 50, 2), (1, 51, 2), (1, 60, 2), (1, 61, 2)], "match_id bigint, track_id int, cls int")
    assert {r.track_id: r.team for r in TM.assign_keepers(p, teams, classes).collect()} == {40: 2, 41: 1}
    one = teams.where("team = 1")
    assert TM.assign_keepers(p, one, classes).count() == 0


def test_kits_fall_in_two_groups_for_each_match(spark):
    rng = random.Random(1)
    rows = []
    for m, (a, b) in {1: (0.0, 10.0), 2: (10.0, 20.0)}.items():  # the same kit is another team's elsewhere
        rows += [(m, t, [(a if t < 7 else b) + rng.random(), rng.random()]) for t in range(11)]
    rows += [(3, t, [float(t), 0.0]) for t in range(5)]
    got = {(r.match_id, r.track_id): r.cluster for r in TM.cluster_kits(spark.createDataFrame(rows, "match_id bigint, track_id int, kit array<double>")).collect()}
    assert got == {(m, t): 1 if t < 7 else 2 for m in (1, 2) for t in range(11)} | {(3, t): 0 for t in range(5)}


def test_homographies_that_cant_be_believed():
    import numpy as np

    h = np.linalg.inv(np.array([[14.0, 2.0, 150.0], [0.5, 9.0, 200.0], [1e-4, 2e-3, 1.0]]))
    pitch = np.array([[0, 0], [105, 0], [105, 68], [0, 68], [52.5, 34], [20, 50.0]])
    back = np.column_stack([pitch, np.ones(6)]) @ np.linalg.inv(h).T
    image = back[:, :2] / back[:, 2:]
    matrix, inverse, used, error = C.manual_homography(image, pitch)
    assert used == 6 and error < 1e-6 and np.allclose(matrix @ inverse, np.eye(3))
    assert C.believable(image / 2000, pitch, 1920, 1080) is None  # collapsed to a speck
    assert C.believable(image * 1e3, pitch, 1920, 1080) is None  # far larger than the picture
    for bad, match in ((image[:3], "same|each point"), (image[:2], "each point")):
        with pytest.raises(ValueError, match=match):
            C.manual_homography(bad, pitch)
    with pytest.raises(ValueError, match="four points"):
        C.manual_homography(image[:3], pitch[:3])
    with pytest.raises(ValueError, match="no homography"):
        C.manual_homography(np.column_stack([np.arange(5.0), np.arange(5.0)]), pitch[:5])


def test_a_blend_lies_between(spark):
    import numpy as np

    # the camera pans 200 pixels between the solved frames
    pan = lambda dx: np.linalg.inv(np.array([[12.0, 0, 100.0 + dx], [0, 8.0, 60.0], [0, 0, 1.0]])).ravel().tolist()
    solved = spark.createDataFrame([(1, 0, 100, pan(0), 9, 4.0), (1, 0, 110, pan(200), 6, 8.0), (1, 1, 300, pan(0), 7, 1.0)], "match_id bigint, shot bigint, frame bigint, matrix array<double>, n_points int, error double")
    frames = spark.createDataFrame([(1, 0, f) for f in (95, 100, 103, 110, 140, 186)] + [(1, 1, 290)], "match_id bigint, shot bigint, frame bigint")
    got = {r.frame: r for r in C.blended(frames, solved).collect()}
    assert sorted(got) == [95, 100, 103, 110, 140, 290]  # 186 is more than 75 frames after the last
    assert np.allclose(got[103].matrix, pan(60), atol=1e-6) and (got[103].n_points, round(got[103].error, 6)) == (6, 5.2)
    for f, dx, n in ((95, 0, 9), (100, 0, 9), (110, 200, 6), (140, 200, 6), (290, 0, 7)):
        assert np.allclose(got[f].matrix, pan(dx)) and got[f].n_points == n


def test_pairs_are_as_many_and_as_near_as_can_be(spark):
    import itertools

    rng = random.Random(9)
    rows = lambda n, first: [(m, first + 100 * m + k, rng.choice(["Pass", "Shot"]), rng.choice(["A", " A ", "B"]), "x", round(rng.uniform(0, 40), 1)) for m in range(4) for k in range(n)]
    schema = "match_id bigint, event_id bigint, event string, team string, outcome string, t double"
    truth, told = rows(7, 0), rows(6, 5000)
    got = V.match_events(spark.createDataFrame(truth, schema), spark.createDataFrame(told, schema), 4.0).collect()
    fits = lambda t, p: t[0] == p[0] and t[2] == p[2] and t[3].strip() == p[3].strip() and abs(t[5] - p[5]) <= 4
    by = {r[1]: r for r in truth + told}
    assert all(fits(by[r.t_id], by[r.p_id]) for r in got) and len({r.t_id for r in got}) == len({r.p_id for r in got}) == len(got)
    for m in range(4):
        ts, ps = [t for t in truth if t[0] == m], [p for p in told if p[0] == m]
        best = (0, 0.0)
        for perm in itertools.permutations(range(len(ts)), len(ps)):
            pairs = [(ts[i], p) for i, p in zip(perm, ps, strict=True) if fits(ts[i], p)]
            best = min(best, (-len(pairs), sum(abs(t[5] - p[5]) for t, p in pairs)))
        own = [r for r in got if r.match_id == m]
        assert (-len(own), pytest.approx(sum(r.gap for r in own))) == best


def test_links_join_what_one_person_left(spark):
    # three fragments of one walk at 5 m/s and a bystander; gaps of 0.4 s and 2.4 s
    walk = [(1, f, 10 + (f >= 60) + (f >= 140), 2, f / 25, 10 + f * 0.2 / 4, 30.0) for f in [*range(0, 50), *range(60, 80), *range(140, 180)]]
    rows = walk + [(1, f, 30, 2, f / 25, 90.0, 60.0) for f in range(0, 180)]
    p = spark.createDataFrame([(m, f, t, c, s, x * 16, y * 10, x, y) for m, f, t, c, s, x, y in rows], "match_id bigint, frame bigint, track_id int, cls int, time_s double, img_x double, img_y double, pitch_x double, pitch_y double")
    ids = p.select("match_id", "track_id").distinct()
    parts = Z.tracklets(p, ids.withColumn("team", F.lit(1)), ids.withColumn("cls", F.lit(2)))
    got = {r.track_id: r.root for r in Z.link(parts).collect()}
    assert got == {10: 10, 11: 10, 12: 10, 30: 30}
    assert Z.report(Z.link(parts)).first().asDict() == {"match_id": 1, "before": 4, "after": 2, "merges": 2, "reduction": 0.5}


def test_pass_links(spark):
    events = [(1, k, 1, 5, "Pass", "Successful", 0, 0.0, 10.0, 10.0, 30.0 + k, 20.0, 0.5) for k in range(3)] + [(1, 8, 1, 6, "Pass", "Successful", 0, 0.0, 30.0, 20.0, 11.0, 10.0, 0.5), (1, 9, 1, 5, "Pass", "Unsuccessful", 0, 0.0, 10.0, 10.0, 30.0, 20.0, 0.5), (1, 10, 1, 6, "Pass", "Successful", 0, 0.0, 30.0, 20.0, 31.0, 20.0, 0.5)]
    e = spark.createDataFrame(events, "match_id bigint, seq bigint, team int, track_id int, event string, outcome string, frame bigint, time_s double, start_x double, start_y double, end_x double, end_y double, confidence double")
    players = spark.createDataFrame([(1, 1, 5, 10.0, 10.0), (1, 1, 6, 30.0, 20.0), (1, 2, 7, 31.0, 20.0), (1, 1, 8, None, None)], "match_id bigint, team int, track_id int, avg_x double, avg_y double")
    key = lambda df: sorted((r.from_id, r.to_id, r.n) for r in df.collect())
    assert key(S.pass_network(e, players)) == [(5, 6, 3)] and key(S.pass_network(e, players, 1)) == [(5, 6, 3), (6, 5, 1)]


def test_settings():
    c = W.overridden(Possession(), ["confirm=7", "max_distance=1.5"])
    assert (c.confirm, c.max_distance, c.release) == (7, 1.5, Possession().release)
    with pytest.raises(ValueError, match="no setting 'speed'"):
        W.overridden(Possession(), ["speed=1"])
    assert [(g.confirm, g.steal) for g in W.grid(Possession(), confirm=[2, 4], steal=[3, 9])] == [(2, 3), (2, 9), (4, 3), (4, 9)]
