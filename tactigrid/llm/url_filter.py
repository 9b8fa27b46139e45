"""URL filters: host-suffix / path-prefix expressions joined on short hash prefixes.

Each URL is expanded into the expressions ``host suffix + path prefix`` that a rule could
have; the SHA-256 of every expression is cut to its first 32 bits and equi-joined with the
rules' digests; a hit counts only if the full digests agree, and the longest rule wins.
Built-in functions only.

Only suffixes with as many labels, and prefixes as long, as some rule has are expanded: a
URL with thousands of dots or slashes gives no more rows than the rules have shapes.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits no rule and
gets the default verdict. Repeated rows are judged one by one. An empty table gives an empty
result. An empty rule list leaves the default everywhere. Rules that name the same
expression twice: the last one listed wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactigrid.llm.common import column, fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules up to this number are broadcast (100 bytes each or so); beyond it the join shuffles.
MOST_BROADCAST_RULES = 50_000

#: (host, path, verdict) of the registered query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.translate(host, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    kept = {(h, p): (i, v) for i, (h, p, v) in enumerate(rules)}
    rows = [(h, p, v) for (h, p), (_, v) in kept.items()]
    return spark.createDataFrame(rows, T.StructType([T.StructField(c, T.StringType()) for c in ("rule_host", "rule_path", "rule_verdict")]))


def filter_urls(urls: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with columns host, path, rule and verdict added (one row per input row);
    a name that ``urls`` has already gets underscores after it."""
    spark = urls.sparkSession
    if not isinstance(rules, DataFrame):
        rules = rule_table(spark, rules)
    rules = rules.select("rule_host", "rule_path", "rule_verdict")
    # the shapes of the rules: as many as there are distinct label counts and path lengths
    labels = [r[0] for r in rules.select(F.size(F.split("rule_host", r"\.")).alias("n")).distinct().collect()]
    lengths = [r[0] for r in rules.select(F.length("rule_path").alias("n")).distinct().collect()]
    few = len(rules.take(MOST_BROADCAST_RULES + 1)) <= MOST_BROADCAST_RULES
    expression = F.concat("rule_host", "rule_path")
    known = rules.select(
        F.substring(F.sha2(expression, 256), 1, 8).alias("short"),
        F.struct(F.length(expression).alias("long"), expression.alias("rule"), F.col("rule_verdict").alias("verdict"), F.sha2(expression, 256).alias("digest")).alias("known"),
    )
    kept = urls.columns
    host_as, path_as, rule_as, verdict_as = (fresh(kept, c) for c in ("host", "path", "rule", "verdict"))
    # numbered columns, so that clashing names of the input are safe
    one = F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(kept)], host_of(column(url)).alias("host"), path_of(column(url)).alias("path"))
    rows = urls.select(F.monotonically_increasing_id().alias("row"), one.alias("one"))
    host, path = F.col("one.host"), F.col("one.path")

    def told(rows: DataFrame, rule: Column, verdict: Column) -> DataFrame:
        return rows.select(*[F.col("one")[f"c{i}"].alias(c) for i, c in enumerate(kept)], host.alias(host_as), path.alias(path_as), rule.alias(rule_as), F.coalesce(verdict, F.lit(default)).alias(verdict_as))

    if not labels:
        return told(rows, F.lit(None).cast("string"), F.lit(default))
    dots = F.size(F.split(host, r"\."))
    suffixes = F.array_compact(F.array(*[F.when(dots >= n, F.substring_index(host, ".", -n)) for n in sorted(labels)]))
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths)]))
    tried = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat(s, p), 256))))
    # one scan: the row rides along through the join and meets its own hits again in the map-side
    # half of the aggregation, so that the row number need not be the same in two scans
    tries = rows.select("row", "one", F.explode_outer(tried).alias("digest")).withColumn("prefix", F.substring("digest", 1, 8))
    sure = (F.col("prefix") == F.col("short")) & (F.col("digest") == F.col("known.digest"))
    found = tries.join(F.broadcast(known) if few else known, sure, "left").groupBy("row").agg(F.first("one").alias("one"), F.max("known").alias("best"))
    return told(found, F.col("best.rule"), F.col("best.verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT page_id, host, path, rh || rp AS rule, rv,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM parts LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM best WHERE k = 1
"""
