"""Benchmark decontamination by winnowing, in built-in functions only.

A window of ``WINDOW`` words holds ``WINDOW - GRAM + 1`` grams of ``GRAM`` words; the leftmost
least gram hash of each window is its fingerprint. Equal windows have equal fingerprints at
equal places, so joining the fingerprints of texts and items misses no shared window. A hit
is then extended word by word to both sides within the window's reach; it counts if the run
of equal words is a window long. All words of such a run are inside occurring windows, and
every occurring window lies in the run of its own fingerprint.

Items of fewer words than a window are one window of their own length; only if there are any,
the texts' grams of those lengths are looked up as well.

A bitmap of the items' marks turns down most places of the texts before anything is built of
them. The item side is broadcast when it has at most ``MOST_BROADCAST`` rows (of about 300 bytes),
and joined by a shuffle beyond that. The text side is read once; neither texts nor
fingerprints of clean documents are shuffled.

Edge cases: null or wordless texts have no words and no hits; null or wordless items no
windows; rows that repeat (key, text) give as many equal rows; ties between equal hashes go
to the leftmost; empty tables give an empty result or no hits; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactigrid.llm.common import column, materialize

WINDOW, GRAM = 10, 5
MOST_BROADCAST = 100_000
#: A place in a part of a text has so many bits, and the hash of a gram the rest of 64.
PLACE = 24
BITS, MOST_BITS = 32, 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower-case: all of ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(folded, SEPARATORS), "")


def _numbers(upto: Column) -> Column:
    """1 .. upto, or nothing."""
    return F.when(upto >= 1, F.sequence(F.lit(1), upto)).otherwise(F.array().cast("array<int>"))


def _mark(words: Column, at: Column, mark: Column, kind: int, long: int, reach: int) -> Column:
    """A fingerprint at word ``at`` with the words up to ``reach`` before (nearest first) and after it."""
    before = F.reverse(F.slice(words, F.greatest(at - reach, F.lit(1)), F.least(F.lit(reach), at - 1))) if reach else F.array().cast("array<string>")
    after = F.slice(words, at + long, reach) if reach else F.array().cast("array<string>")
    return F.struct(F.lit(kind).alias("kind"), mark.alias("mark"), at.cast("int").alias("at"), F.slice(words, at, long).alias("middle"), before.alias("before"), after.alias("after"))


def _grams(words: Column, long: int) -> Column:
    """For each place a number: above the hash of ``long`` words, below the place."""
    return F.transform(_numbers(F.size(words) - long + 1), lambda i: F.xxhash64(F.slice(words, i, long)).bitwiseAND(F.lit(-1 << PLACE)).bitwiseOR(i.cast("bigint")))


def _chosen(words: Column, window: int, gram: int) -> Column:
    """The numbers (``_grams``) of the leftmost least gram of every window."""
    per = window - gram + 1
    of = lambda g: F.array_distinct(F.transform(_numbers(F.size(g) - per + 1), lambda j: F.array_min(F.slice(g, j, per))))
    return let(_grams(words, gram), of)


def _marks(words: Column, kind: int, long: int, reach: int, known: Column | None, numbers: Callable[[Column], Column]) -> Column:
    """Marks at the places that ``numbers`` chooses, of those whose bit is in ``known`` (or of all).
    Long texts are cut into parts that share a window less one word, as places have ``PLACE`` bits."""
    step, more = 1 << (PLACE - 1), reach + long - 1

    def part(c: Column) -> Column:
        found = let(F.slice(words, c + 1, step + more), numbers)
        if known is not None:

            def has(v: Column) -> Column:
                group = F.get(known, F.shiftright(v, PLACE + 6).bitwiseAND(F.size(known) - 1).cast("int"))
                return F.call_function("shiftright", group, F.shiftright(v, PLACE).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

            found = F.filter(found, has)
        return F.transform(found, lambda v: _mark(words, c + v.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int"), F.shiftright(v, PLACE), kind, long, reach))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - more, F.lit(1)) - 1, F.lit(step)), part))


def fingerprints(words: Column, window: int, gram: int, known: Column | None = None) -> Column:
    """Marks at the leftmost least gram of every window."""
    return _marks(words, 0, gram, window - gram, known, lambda w: _chosen(w, window, gram))


def shorts(words: Column, long: int, known: Column | None = None) -> Column:
    """Marks of every place with ``long`` words."""
    return _marks(words, long, long, 0, known, lambda w: _grams(w, long))


def _bits(known: DataFrame, n: int) -> Column:
    """The ``n`` marks of ``known`` as a bitmap: a constant list of a power of two of 64-bit numbers.
    It has ``BITS`` bits for each mark up to ``MOST_BITS``; beyond, it turns down fewer."""
    size = 1 << (min(max(n * BITS, 1 << 12), MOST_BITS) - 1).bit_length() >> 6
    group = F.shiftright("i_mark", 6).bitwiseAND(F.lit(size - 1)).alias("group")
    rows = known.select(group, F.expr("shiftleft(1L, cast(i_mark & 63 as int))").alias("bit")).groupBy("group").agg(F.bit_or("bit").alias("bits"))
    own = {r.group: r.bits for r in rows.collect()}  # MOST_BITS / 64 rows at most
    return F.split(F.lit(",".join(str(own.get(k, 0)) for k in range(size))), ",").cast("array<bigint>")


def _equal_run(a: Column, b: Column, most: int) -> Column:
    """How many words at the start of two lists are equal."""
    out = F.lit(most)
    for i in reversed(range(most)):
        out = F.when(F.coalesce(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), F.lit(False)), out).otherwise(i)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key``, n_words, n_hit, item_ids (sorted as strings), spans (of hit words: first and
    how many, from 1, perhaps overlapping) and contaminated of every row."""
    reach = window - gram
    known = items.select(F.col(item).cast("string").alias("item"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    lengths = sorted(r[0] for r in known.select(F.size("words").alias("n")).where(F.col("n") < window).distinct().collect())  # at most window - 1 numbers
    w = F.col("words")
    marks = F.when(F.size(w) >= window, fingerprints(w, window, gram))
    for m in lengths:
        marks = marks.when(F.size(w) == m, shorts(w, m))
    known = known.select("item", F.explode(marks).alias("i")).select("item", *[F.col(f"i.{c}").alias(f"i_{c}") for c in ("kind", "mark", "middle", "before", "after")]).distinct()
    known = materialize(known, "marks")
    marked = known.count()
    few = marked <= MOST_BROADCAST
    bits = _bits(known, marked)

    def tried(words: Column) -> Column:
        none = F.array().cast("array<string>")
        # (a mark of its own, which nothing meets, so that a join by shuffle deals these rows out)
        own = F.xxhash64(F.col("__key")).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
        base = F.struct(F.lit(-1).alias("kind"), own.alias("mark"), F.size(words).cast("int").alias("at"), none.alias("middle"), none.alias("before"), none.alias("after"))
        return F.concat(F.array(base), fingerprints(words, window, gram, bits), *[shorts(words, m, bits) for m in lengths])

    rows = docs.select(column(key).alias("__key"), column(text).alias("__words")).select("__key", F.xxhash64(F.coalesce("__words", F.lit(""))).alias("__text"), F.explode(let(words_of(F.col("__words")), tried)).alias("d"))
    rows = rows.select("__key", "__text", *[F.col(f"d.{c}").alias(c) for c in ("kind", "mark", "at", "middle", "before", "after")])
    met = rows.join(F.broadcast(known) if few else known, (F.col("kind") == F.col("i_kind")) & (F.col("mark") == F.col("i_mark")), "left")
    left, right = _equal_run(F.col("before"), F.col("i_before"), reach), _equal_run(F.col("after"), F.col("i_after"), reach)
    met = met.select("__key", "__text", "kind", "at", "item", (F.col("middle") == F.col("i_middle")).alias("same"), left.alias("left"), right.alias("right"))
    hit = F.col("same") & ((F.col("kind") > 0) | (F.col("left") + gram + F.col("right") >= window))
    span = F.when(F.col("kind") > 0, F.struct(F.col("at").alias("start"), F.col("kind").alias("long"))).otherwise(F.struct((F.col("at") - F.col("left")).alias("start"), (F.col("left") + gram + F.col("right")).alias("long")))
    met = met.where((F.col("kind") == -1) | hit).select("__key", "__text", F.when(F.col("kind") == -1, F.col("at")).alias("n"), F.when(F.col("kind") >= 0, span).alias("span"), "item")
    found = met.groupBy("__key", "__text").agg(F.max("n").alias("n_words"), F.count("n").alias("__times"), F.collect_set("span").alias("spans"), F.array_sort(F.collect_set("item")).alias("item_ids"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["long"] - 1))))
    # a row for each of the rows that were alike
    return found.select(
        F.col("__key").alias(key),
        F.col("n_words").cast("bigint").alias("n_words"),
        F.size(covered).cast("bigint").alias("n_hit"),
        "item_ids",
        "spans",
        (F.size("spans") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__times"))).alias("__copy"),
    ).drop("__copy")


def op6_winnow_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), m AS (SELECT DISTINCT least(len(w), 10) AS k FROM i WHERE len(w) > 0),
iw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d CROSS JOIN m WHERE len(w) >= k)
), hit AS (SELECT doc_id, s, dw.k AS k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word ON d.doc_id = word.doc_id LEFT JOIN item ON d.doc_id = item.doc_id
"""
