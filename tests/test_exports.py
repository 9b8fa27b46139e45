"""A match's document in parts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tactigrid.sources import writers


def test_parts_of_a_document_make_up_the_whole(spark):
    schema = "match_id bigint, event_id bigint, event string, outcome string, mins int, secs int, x double"
    rows = [(m, m * 100 + k, f'P"{k}],[é', None if k % 2 else "Goal", k * 7 % 5, k * 3 % 4, k / 3) for m in (1, 2) for k in range(7 * m)] + [(None, 999, "x", "x", 0, 0, 0.0)]
    events = spark.createDataFrame(rows, schema)
    matches = spark.createDataFrame([(1, "a"), (2, None), (3, "none")], "match_id bigint, name string")
    parts = writers.nested_export_parts(matches, events, 3).collect()
    assert max(len(json.loads(r.listed)) for r in parts) == 3 and len(parts) == 3 + 5 + 1
    order = lambda m: sorted((r for r in rows if r[0] == m), key=lambda r: (r[4], r[5], r[1]))
    whole = {r.match_id: r.document for r in writers.nested_export(matches, events).collect()}
    for m, name in ((1, "a"), (2, None), (3, "none")):
        text = "".join(r.before + r.listed[1:-1] + r.after for r in sorted((r for r in parts if r.match_id == m), key=lambda r: r.part))
        assert text == whole[m]
        fields = "event_id event outcome mins secs x".split()
        listed = [{k: v for k, v in zip(fields, r[1:], strict=True) if v is not None} for r in order(m)]
        assert json.loads(text) == {k: v for k, v in (("match_id", m), ("name", name), ("events", listed)) if v is not None}


def test_a_long_match_is_held_by_no_task(spark):
    events = spark.range(20000).select(F.lit(1).cast("bigint").alias("match_id"), F.col("id").alias("event_id"), F.lit(0).alias("mins"), F.lit(0).alias("secs"), F.repeat(F.lit("x"), 100).alias("event"))
    r = writers.nested_export_parts(events.select("match_id").distinct(), events).agg(F.count("*").alias("n"), F.max(F.length("listed")).alias("longest"), F.sum(F.size(F.from_json("listed", "array<struct<event:string>>"))).alias("events")).first()
    assert (r.n, r.events) == (10, 20000) and r.longest < 400_000
