"""Writing events: exports and the partitioned match store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactigrid.functions.geometry import half_even

EXPORT = ["team", "player", "event", "outcome", "mins", "secs", "x", "y", "x2", "y2", "half", "source", "confidence"]
MOST_EVENTS = 20_000


def export_rows(events: DataFrame) -> DataFrame:
    """The export's columns in order; confidence to two places, nothing where it is null."""
    rows = events.orderBy("match_id", "mins", "secs", "event_id") if "match_id" in events.columns else events.orderBy("mins", "secs", "event_id")
    return rows.select(*[half_even(F.col("confidence"), 2).alias(c) if c == "confidence" else F.col(c) for c in EXPORT if c in events.columns])


def write_csv(events: DataFrame, path: str) -> None:
    export_rows(events).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_json(events: DataFrame, path: str) -> None:
    export_rows(events).write.mode("overwrite").json(path)


def nested_export_parts(matches: DataFrame, events: DataFrame, most: int = 2000) -> DataFrame:
    """(match_id, part, before, listed, after): the document of a match in parts of at most ``most``
    events, so that a long match needs no task that holds it. ``listed`` is a JSON array; in order
    of parts, ``before``, what is inside the array and ``after`` make up the document."""
    rest = [c for c in events.columns if c != "match_id"]
    made = F.to_json(F.struct(*matches.columns))
    head = F.concat(F.substring(made, F.lit(1), F.length(made) - 1), F.when(made == "{}", "").otherwise(","), F.lit('"events":['))
    heads = matches.select("match_id", head.alias("head")).join(events.groupBy("match_id").agg(F.count("*").alias("n")), "match_id", "left")
    place = F.row_number().over(Window.partitionBy("match_id").orderBy("e.mins", "e.secs", "e.event_id")) - 1
    # (the few heads are the side that is hashed, and a match's rows are shuffled once for join and window)
    rows = events.select("match_id", F.struct(*rest).alias("e")).join(heads.where("n IS NOT NULL").hint("shuffle_hash"), "match_id").withColumn("place", place)
    rows = rows.select("match_id", F.floor(F.col("place") / most).cast("int").alias("part"), "place", "e", F.when(F.col("place") == 0, F.col("head")).alias("before"), F.when(F.col("place") == F.col("n") - 1, "]}").alias("after"))
    inside = F.transform(F.array_sort(F.collect_list(F.struct("place", "e"))), lambda s: s["e"])
    parts = rows.repartition("match_id", "part").groupBy("match_id", "part").agg(F.coalesce(F.max("before"), F.lit(",")).alias("before"), F.to_json(inside).alias("listed"), F.coalesce(F.max("after"), F.lit("")).alias("after"))
    return parts.unionByName(heads.where("n IS NULL").select("match_id", F.lit(0).alias("part"), F.col("head").alias("before"), F.lit("[]").alias("listed"), F.lit("]}").alias("after")))


def nested_export(matches: DataFrame, events: DataFrame) -> DataFrame:
    """(match_id, document): a match with its events in order, as JSON. The document is one value;
    ``nested_export_parts`` gives it in pieces."""
    text = F.concat("before", F.substring("listed", F.lit(2), F.length("listed") - 2), "after")
    parts = nested_export_parts(matches, events).select("match_id", "part", text.alias("text"))
    return parts.groupBy("match_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda s: s["text"]), "").alias("document"))


def csv_cell(c: str):
    """A cell quoted where it must be."""
    v = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def save_matches(events: DataFrame, path: str) -> None:
    """New matches into the store; one with more than ``MOST_EVENTS`` events is refused."""
    over = events.groupBy("match_id").count().where(F.col("count") > MOST_EVENTS).take(1)
    if over:
        raise ValueError(f"match {over[0][0]} has more than {MOST_EVENTS} events")
    events.write.partitionBy("match_id").mode("append").parquet(path)


def replace_matches(events: DataFrame, path: str) -> None:
    """The events of the matches given take the place of those stored; other matches stay."""
    events.write.partitionBy("match_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def delete_matches(spark, path: str, match_ids: list[int]) -> None:
    """Match partitions removed with all they hold."""
    jvm = spark.sparkContext._jvm
    for m in match_ids:
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/match_id={m}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def save_result(body: DataFrame, results: DataFrame, schema: str) -> DataFrame:
    """Events to store for finished jobs: those sent with the request, else those of the result."""
    stored = results.select("job_id", F.from_json("result", f"events {schema}")["events"].alias("found"))
    return stored.join(body.select("job_id", F.col("events").alias("sent")), "job_id", "left").select("job_id", F.explode(F.coalesce("sent", "found")).alias("e")).select("job_id", "e.*")


def merged_store(spark, path: str) -> DataFrame:
    """The store with the columns of all its generations; older rows have nulls in newer ones."""
    return spark.read.option("mergeSchema", True).parquet(path)


def report(teams: DataFrame, players: DataFrame, most: int = 12) -> str:
    """The text report of a match: small tables, formatted on the driver."""
    lines = ["TEAM  POSS   PASSES        SHOTS GOALS"]
    lines += [f"{r.team:>4}  {r.possession:5.1f}  {r.passes_completed:>4}/{r.passes:<4} {r.pass_accuracy:5.1f}% {r.shots:>5} {r.goals:>5}" for r in teams.orderBy("team").collect()]
    lines.append("PLAYER  TEAM  TOUCHES  DISTANCE  TOP")
    lines += [f"#{r.track_id:<6} {r.team:>4}  {r.touches:>7}  {r.distance_m:>7.0f} m {r.top_kmh:5.1f}" for r in players.orderBy(F.desc("touches"), "track_id").limit(most).collect()]
    return "\n".join(lines)


def whole_export(events: DataFrame, stats: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(match_id, document): events in order, statistics and diagnostics of a match as one JSON
    object. ``stats`` (match_id, payload) and ``diagnostics`` (match_id, diagnostics) are JSON
    texts already and go in as they are; what a match lacks is an empty list or object."""
    rest = [c for c in events.columns if c != "match_id"]
    listed = events.groupBy("match_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.struct("mins", "secs", "event_id").alias("o"), F.struct(*rest).alias("e")))), lambda s: s["e"])).alias("events"))
    out = listed.join(stats, "match_id", "full").join(diagnostics, "match_id", "full")
    part = lambda c, empty: F.coalesce(F.col(c), F.lit(empty))
    return out.select("match_id", F.concat(F.lit('{"events":'), part("events", "[]"), F.lit(',"stats":'), part("payload", "{}"), F.lit(',"diagnostics":'), part("diagnostics", "{}"), F.lit("}")).alias("document"))


def metrics_report(sections: list[dict]) -> str:
    """Measured models as Markdown. A section has a model, a split, and either a list ``metrics`` of
    (name, value) or, as tables, ``columns`` and ``rows``; an empty one is passed over."""
    lines = ["# Model evaluation", ""]
    for s in filter(None, sections):
        head = s.get("columns", ["metric", "value"])
        rows = s.get("rows") or s.get("metrics", [])
        lines += [f"## {s['model']}  ({s.get('split', '')})", ""]
        lines += [f"| {' | '.join(head)} |", "|" + "---|" * len(head)]
        lines += [f"| {' | '.join(str(v) for v in row)} |" for row in rows] + [""]
    return "\n".join(lines)
