"""Document fingerprints by spot signatures, in built-in functions only.

A spot is a chain of ``CHAIN`` content words that follow a run of common words (the anchor);
common words inside the chain are passed over. A text's fingerprint is the set of the 32-bit
hashes of its spots. Sets are compared by Jaccard likeness; in the search for near pairs they
are indexed by their rarest members and, where they meet, filtered by length and position. The
index isn't partitioned by length.

Edge cases: a text without an anchor has one spot, its words; one without words (null, empty,
punctuation) has none and the empty fingerprint. Two empty sets have likeness 1, an empty and
another one 0. Rows that repeat an id follow one another in the order of their texts. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tactigrid.llm.winnow import let

CHAIN = 2

#: Common words of English, German, French and Spanish: articles, prepositions, pronouns, auxiliaries.
COMMON = sorted(
    set(
        """
        a an the of and to in is that it was for on are as with his they be at have this from or had by but not were we which she he you her their will
        der die das und in den von zu mit sich auf ist im dem des nicht ein eine einen als auch es an aus er hat dass sie nach bei war wird für
        le la les de des du et en un une que qui dans pour par sur est au aux avec il elle ne se pas ce son plus où
        el la los las de del que en y un una por con para se su al lo como más no es
        """.split()
    )
)


def _any(words: list[str]) -> str:
    """A pattern for any of ``words`` that reads common beginnings once."""
    out = []
    for letter in sorted({w[:1] for w in words if w}):
        rest = [w[1:] for w in words if w[:1] == letter]
        out.append(letter + _any(rest))
    end = "" in words
    if not out:
        return ""
    body = out[0] if len(out) == 1 and not end else "(?:" + "|".join(out) + ")"
    return body + "?" * end


#: One common word. (A pattern for a run of them would be matched by recursion, which a text of
#: nothing else takes beyond the stack; between two of a run the cut leaves nothing, which goes.)
ANCHOR = " " + _any(COMMON) + "(?= )"


def spots(text: Column, chain: int = CHAIN) -> Column:
    """The ascending distinct spot hashes of a text."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))

    def of(words: Column) -> Column:
        def chained(parts: Column) -> Column:
            # parts: the content words after each anchor, up to the next
            def one(part: Column, i: Column) -> Column:
                return F.hash(F.substring_index(F.concat_ws(" ", part, *[F.get(parts, i + k) for k in range(1, chain)]), " ", chain))

            return F.when(F.size(parts) > 0, F.sort_array(F.array_distinct(F.transform(parts, one)))).otherwise(F.array(F.hash(words)))

        cut = F.split(F.concat(F.lit(" "), words, F.lit(" ")), ANCHOR)
        return F.when(words == "", F.array().cast("array<int>")).otherwise(let(F.array_remove(F.transform(F.slice(cut, 2, 1 << 30), lambda p: F.trim(p)), ""), chained))

    return let(plain, of)


def fingerprint(spots: Column) -> Column:
    """A set as text: eight hexadecimal digits for each member."""
    return F.array_join(F.transform(spots, lambda h: F.lpad(F.hex(h.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    return let(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both)))


def near_pairs(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (a, b, likeness) of different fingerprints at least ``least`` alike, each named by
    its smallest id, which stands for all texts with that fingerprint."""
    # in whole millionths: doubles lose pairs that are just at the threshold
    million = 1_000_000
    part = round(least * million)
    sets = docs.select(F.col(key).alias("id"), spots(F.col(text)).alias("s")).where(F.size("s") > 0).groupBy("s").agg(F.min("id").alias("id"))
    rare = sets.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    ranked = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("h")).join(rare, "h")
    order = Window.partitionBy("id").orderBy("df", "h")
    prefix = F.col("n") - F.floor((F.col("n").cast("bigint") * part + million - 1) / million) + 1
    index = ranked.withColumn("at", F.row_number().over(order)).where(F.col("at") <= prefix)
    one = index.select("h", F.col("id").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"))
    two = index.select("h", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    # length, then position: what can still be shared after this member must be enough
    rest = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) + F.least("ia", "ib")
    fits = (F.col("a") < F.col("b")) & (million * F.least("na", "nb").cast("bigint") >= part * F.greatest("na", "nb")) & (rest.cast("bigint") * (million + part) >= part * (F.col("na") + F.col("nb")))
    pairs = one.join(two, "h").where(fits).select("a", "b").distinct()
    full = sets.select("id", "s")
    found = pairs.join(full.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(full.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return found.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= least)


def _range_of(key: str, bounds: list) -> Column:
    """How many of the ascending ``bounds`` are below the key, in two steps of about a root of them."""
    if not bounds:
        return F.lit(0)
    m = max(1, int(len(bounds) ** 0.5))
    chunks = [bounds[i : i + m] for i in range(0, len(bounds), m)]
    below = lambda values: F.size(F.filter(values, lambda x: x < F.col(key)))
    chunk = below(F.array(*[F.lit(c[-1]) for c in chunks]))
    within = lambda k: k * m + F.coalesce(below(F.get(F.array(*[F.array(*[F.lit(x) for x in c]) for c in chunks]), k)), F.lit(0))
    return F.when(F.col(key).isNull(), 0).otherwise(let(chunk, within))


def with_next(docs: DataFrame, text: str, derive: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> DataFrame:
    """``derive(docs)`` with next_<column> for each of its columns but the key: the values of the
    row with the next larger ``key`` (the first one's after the last). Keys are numbers.

    Rows are dealt by ranges of the key, whose bounds are approximate quantiles, twice as many
    as there are shuffle partitions, and follow one another within a range; the last of a range
    takes the first row of the next range that has any."""
    n = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0]
    part = _range_of(key, sorted(set(found or [])))
    # of each range its first key, then (the ranges' number bounds this) that row's columns
    firsts = docs.select(key, part.alias("__part")).groupBy("__part").agg(F.min(F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("first"))).alias("f"))
    firsts = firsts.select("__part", F.col("f.first").alias("__first"))
    heads = docs.join(F.broadcast(firsts), docs[key].eqNullSafe(firsts["__first"])).select("__part", key, text)
    heads = heads.groupBy("__part").agg(F.min_by(F.struct(key, text), F.xxhash64(text)).alias("h")).select("__part", "h.*")
    heads = derive(heads)
    kept = [c for c in heads.columns if c not in ("__part", key)]
    every = Window.partitionBy(F.lit(0)).orderBy("__part")
    after = firsts.select("__part", F.coalesce(F.lead("__part").over(every), F.first("__part").over(every)).alias("__after"))
    heads = after.join(heads.withColumnRenamed("__part", "__after"), "__after").select("__part", *[F.col(c).alias(f"__head_{c}") for c in kept])
    rows = derive(docs.withColumn("__part", part)).withColumn("__tie", F.xxhash64(text))
    order = Window.partitionBy("__part").orderBy(key, "__tie")
    rows = rows.select("*", F.lead("__part").over(order).isNull().alias("__last"), *[F.lead(c).over(order).alias(f"next_{c}") for c in kept])
    rows = rows.join(heads, "__part", "left")
    return rows.select(key, *kept, *[F.when(F.col("__last"), F.col(f"__head_{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in kept])


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs, "text", lambda d: d.withColumn("spots", spots(F.col("text"))))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    seen = let(edited, lambda t: F.struct(F.sha2(t, 256).alias("sha"), spots(t).alias("spots")))
    return docs.select("doc_id", n.cast("bigint").alias("n_chars"), "spots", "next_spots", seen.alias("e")).select(
        "doc_id",
        "n_chars",
        F.col("e.sha").alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("e.spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("e.spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )
