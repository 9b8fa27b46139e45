"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, stars.

1. A document's shingle set is hashed once; the top bits of a hash are its bin and the least
   hash of a bin is one of ``BINS`` min-hashes. Empty bins borrow from the bin that comes first
   in an order of their own (the same for all documents), so that they stay independent.
2. Documents with equal sets are folded into one by a 128-bit digest of the set.
3. ``BANDS`` groups of ``BINS // BANDS`` min-hashes are bucket keys. A bucket links its members
   to its smallest id only (a star), so candidates grow with members and not with pairs.
4. Candidates are confirmed on the full sets, recomputed from the texts. First each document
   is tried with the centre it shares most buckets with; then only stars between different
   components; then, as members of a bucket may be alike without being like its centre, pairs
   of different components within buckets, each pair in one of the buckets it shares. Members of
   buckets with more than ``PAIRS_UP_TO`` are tried with one another in blocks of ``BLOCK``, which
   give no more links than unite their components.
5. Components follow by pointer jumping and, on what few links are left between them, by
   large-star / small-star rounds.

Texts of candidates are kept in a table bucketed by id, so that they are shuffled once. Links
to a centre that many documents share are salted by ``CHUNK``.

At a similarity of 0.8 two sets share no bucket with a probability of 5e-8.

Edge cases: a null or empty text, or one of white space, has an empty set and is linked with
nothing; one word is a set of one; rows that repeat a doc_id are one document and give equal
rows; a row with a null id is linked with nothing and kept, and has no component; an empty table
gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactigrid.llm.common import bucketed, column, eased, materialize, slices, strings
from tactigrid.llm.textkit import FOLD, NOT_SPACE, mix, pair, words

BINS, BANDS = 128, 32
PAIRS_UP_TO = 48
CHUNK = 1000
#: Members of a block of a crowd, and words' columns multiplied at a time.
BLOCK, COLUMNS = 256, 4096

#: For each bin the others in an order of its own; fixed by the generator's seed.
_RANK = np.argsort(np.argsort(np.random.default_rng(20240607).random((BINS, BINS)), axis=1), axis=1).astype(np.uint8)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def shingle_sets(texts: pa.StringArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, one text after the other; and how many.
    A text of fewer words than ``width`` is one shingle."""
    found = words(texts, NOT_SPACE, FOLD)
    gram = mix(found.hashes())
    h = gram.copy()
    for k in range(1, min(width, len(h))):
        gram[: len(h) - k] = pair(gram[: len(h) - k], h[k:])
    first, n = found.first.tolist(), found.n.tolist()
    out = []
    for at, count in zip(first, n, strict=True):
        if count >= width:
            out.append(np.unique(gram[at : at + count - width + 1]))
        elif count:
            whole = h[at : at + 1]
            for k in range(1, count):
                whole = pair(whole, h[at + k : at + k + 1])
            out.append(mix(whole + np.uint64(count)))
        else:
            out.append(h[:0])
    return np.concatenate(out) if out else h[:0], np.fromiter(map(len, out), np.int64, len(out))


def signatures(sets: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of ``BINS`` densified min-hashes for each set (zeros for an empty one)."""
    out = np.zeros((len(n), BINS), np.uint64)
    ends = np.cumsum(n)
    for i, (to, count) in enumerate(zip(ends.tolist(), n.tolist(), strict=True)):
        if not count:
            continue
        own = sets[to - count : to]
        at = np.searchsorted(own, _EDGES)
        has = np.diff(at, append=count) > 0
        full = np.flatnonzero(has)
        if len(full) == BINS:
            out[i] = own[at]
        else:
            out[i] = own[at[full]][np.where(has, np.searchsorted(full, np.arange(BINS)).clip(max=len(full) - 1), np.argmin(_RANK[:, full], axis=1))]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = BINS // BANDS
    parts = signature.reshape(len(signature), BANDS, rows)
    key = mix(parts[:, :, 0] + np.arange(BANDS, dtype=np.uint64)[None, :])
    for k in range(1, rows):
        key = pair(key, parts[:, :, k])
    return key


def _sketch(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, n = shingle_sets(strings(batch.column(1)), width)
            signature = signatures(sets, n)
            keys = band_keys(signature).view(np.int64)
            low, high = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            starts = (np.cumsum(n) - n)[n > 0]
            if len(starts):
                low[n > 0] = np.add.reduceat(mix(sets), starts)
                high[n > 0] = np.add.reduceat(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), bands], names=["id", "n", "low", "high", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    sent = docs.select(column(key).alias("id"), column(text).cast("string").alias("text"))
    return sent.mapInArrow(eased(sketched), f"id {kind}, n bigint, low bigint, high bigint, bands array<bigint>")


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those whose full sets have the similarity."""

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ta"):
            one, n_one = shingle_sets(strings(batch.column(2)), width)
            two, n_two = shingle_sets(strings(batch.column(3)), width)
            row = np.concatenate([np.repeat(np.arange(len(n_one)), n_one), np.repeat(np.arange(len(n_two)), n_two)])
            value = np.concatenate([one, two])
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
            both = np.flatnonzero((row[1:] == row[:-1]) & (value[1:] == value[:-1]))
            shared = np.bincount(row[both], minlength=len(n_one))
            fine = 100 * shared >= percent * (n_one + n_two - shared)
            yield batch.select(["a", "b"]).filter(pa.array(fine))

    kind = pairs.schema["a"].dataType.simpleString()
    per = pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("salts"))
    centres = per.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("b", "tb", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    members = pairs.join(per, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    members = members.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return members.join(centres, ["b", "salt"]).select("a", "b", "ta", "tb").mapInArrow(eased(confirmed), f"a {kind}, b {kind}")


def _jump(parents: DataFrame) -> DataFrame:
    """(id, root) of a forest given as (id, parent), parents being smaller."""
    roots = materialize(parents.select("id", F.col("parent").alias("root")), "roots")
    while True:
        up = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = roots.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = materialize(step, "roots")
        roots = step.select("id", "root")
        if step.where("moved").isEmpty():
            return roots


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of ``edges`` (a, b); the root is the smallest id reachable.
    Alternates large-star and small-star, each written out, until nothing changes."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", few=True)
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star", few=True)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = materialize(small, "small-star", few=True)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now


def _links(texts: pa.StringArray, roots: np.ndarray, side: np.ndarray, width: int, percent: int) -> list[tuple[int, int]]:
    """Pairs of rows whose sets have the similarity, of all on side 0 with all on side 1 (or, if
    there is none, of all with all): as many as unite the same ``roots`` as all such pairs do."""
    parts = [shingle_sets(strings(b.column(0)), width) for b in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text")]
    value, n = np.concatenate([s for s, _ in parts]), np.concatenate([k for _, k in parts])
    row = np.repeat(np.arange(len(n)), n)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    column = np.cumsum(np.diff(value, prepend=value[:1]) != 0)
    often = np.bincount(column)[column] > 1
    row, column = row[often], np.unique(column[often], return_inverse=True)[1]
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == (1 if side.any() else 0))
    shared = np.zeros((len(one), len(two)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((len(n), COLUMNS), np.float32)
        has[row[lo:hi], column[lo:hi] - at] = 1
        shared += (has[one] @ has[two].T).astype(np.int64)
    fine = (100 * shared >= percent * (n[one][:, None] + n[two][None, :] - shared)) & (roots[one][:, None] != roots[two][None, :])
    x, y = np.nonzero(fine)
    x, y = one[x], two[y]
    first = np.unique(np.stack([roots[x], roots[y]]), axis=1, return_index=True)[1]
    top = list(range(int(roots.max()) + 1))

    def up(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    out = []
    for a, b in zip(x[first].tolist(), y[first].tolist(), strict=True):
        p, q = up(int(roots[a])), up(int(roots[b]))
        if p != q:
            top[p] = q
            out.append((a, b))
    return out


def _crowds(large: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between components, enough to unite all that links between members of the
    ``large`` buckets (id, key, root) unite.

    Buckets with members in common make one crowd. It is cut into blocks of about ``BLOCK``
    members, those of a large component into blocks of their own, and all pairs of blocks are
    tried on full sets, but not two of the same component."""

    def tried(block: pa.Table) -> pa.Table:
        ids = block.column("id").combine_chunks()
        roots = np.unique(np.array(block.column("root").to_pylist()), return_inverse=True)[1]
        found = _links(strings(block.column("text")), roots, block.column("side").to_numpy(), width, percent)
        a, b = (pa.array([p[k] for p in found], pa.int64()) for k in (0, 1))
        return pa.table({"a": ids.take(a), "b": ids.take(b)})

    kind = large.schema["id"].dataType.simpleString()
    ends = large.groupBy("key").agg(F.min("id").alias("b"))
    crowd = connected(large.join(ends, "key").select(F.col("id").alias("a"), "b")).withColumnRenamed("root", "crowd")
    members = large.select("id", "root").distinct().join(crowd, "id", "left").select("id", "root", F.coalesce("crowd", "id").alias("crowd"))
    members = materialize(members, "crowds", few=True)
    sizes = members.groupBy("crowd", "root").agg(F.count("*").alias("size"))
    rest = sizes.where(f"size < {BLOCK}").groupBy("crowd").agg(F.sum("size").alias("rest"))
    cut = lambda size: F.pmod(F.xxhash64("id"), F.ceil(F.col(size) / BLOCK)).cast("string")
    own = F.col("size") >= BLOCK
    blocks = members.join(sizes, ["crowd", "root"]).join(rest, "crowd", "left").select("crowd", "id", "root", F.when(own, F.col("root")).alias("whole"), F.when(own, F.concat(F.lit("own "), F.col("root").cast("string"), F.lit(" "), cut("size"))).otherwise(F.concat(F.lit("rest "), cut("rest"))).alias("block"))
    blocks = materialize(blocks, "blocks", few=True)
    names = blocks.select("crowd", "block", "whole").distinct()
    one, two = names.select("crowd", F.col("block").alias("one"), F.col("whole").alias("wa")), names.select("crowd", F.col("block").alias("two"), F.col("whole").alias("wb"))
    meet = one.join(two, "crowd").where("one <= two and (wa <> wb or wa is null or wb is null)").select("crowd", "one", "two")
    sides = F.when(F.col("one") == F.col("two"), F.array(F.struct(F.col("one").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("one").alias("block"), F.lit(0).alias("side")), F.struct(F.col("two").alias("block"), F.lit(1).alias("side"))))
    meet = meet.select("crowd", "one", "two", F.explode(sides).alias("s")).select("crowd", "one", "two", "s.*")
    rows = meet.join(blocks.select("crowd", "block", "id", "root"), ["crowd", "block"]).select("crowd", "one", "two", "side", "id", "root")
    return rows.join(texts, "id").groupBy("crowd", "one", "two").applyInArrow(tried, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles, component_id and kept (the smallest id of its component) of every row."""
    every = _sketch(docs, width, key, text)
    kind = every.schema["id"].dataType
    every = materialize(every, "sketch")
    unnamed = every.where("id is null").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.lit(None).cast(kind).alias("component_id"), F.lit(True).alias("kept"))
    sketch = every.where("id is not null")
    some = sketch.where("n > 0")
    # equal sets: one of them stands for all
    folded = some.groupBy("low", "high", "n").agg(F.min_by(F.struct("id", "bands"), "id").alias("first"))
    single = materialize(folded.select("first.id", "n", "first.bands", "low", "high"), "single")
    rows = materialize(single.select("id", "n", F.posexplode("bands").alias("band", "key")), "buckets")
    stars = rows.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("members")).where("members > 1")
    linked = rows.join(stars, "key").where("id <> b").select(F.col("id").alias("a"), "b")
    edges = materialize(linked.groupBy("a", "b").agg(F.count("*").alias("shared")), "stars")
    ids = rows.join(stars.select("key"), "key").select("id").distinct()
    texts = docs.select(column(key).alias("id"), column(text).cast("string").alias("text")).join(ids, "id").dropDuplicates(["id"])
    texts = bucketed(texts, "id", "texts")

    best = edges.groupBy("a").agg(F.max_by("b", F.struct("shared", F.negative("b"))).alias("b"))
    sure = materialize(_confirm(best, texts, width, percent), "confirmed")
    roots = _jump(sure.select(F.col("a").alias("id"), F.col("b").alias("parent")))

    def across(pairs: DataFrame) -> DataFrame:
        """Pairs whose members are in different components so far."""
        one = roots.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        two = roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        return pairs.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*pairs.columns)

    def merged(found: DataFrame) -> DataFrame:
        """The components with the links of ``found`` added."""
        one = roots.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        two = roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        between = found.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        over = connected(between).select(F.col("id").alias("root"), F.col("root").alias("over"))
        known = roots.join(over, "root", "left").select("id", F.coalesce("over", "root").alias("root"))
        fresh = over.select(F.col("root").alias("id"), F.col("over").alias("root")).join(roots.select("id"), "id", "left_anti")
        return materialize(known.union(fresh), "roots")

    size = single.select("id", "n")
    near = lambda p: p.join(size.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b")
    tried = best.select("a", "b")
    todo = materialize(near(across(edges.select("a", "b"))).join(tried, ["a", "b"], "left_anti"), "star-pairs", few=True)
    if not todo.isEmpty():
        found = materialize(_confirm(todo, texts, width, percent), "confirmed")
        if not found.isEmpty():
            roots = merged(found)

    # members that are alike but not like the centre: pairs of different components in a bucket
    of = rows.join(roots, "id", "left").select("id", "n", "band", "key", F.coalesce("root", "id").alias("root"))
    mixed = of.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("lo <> hi and members > 2").select("key", "members")
    mixed = materialize(of.join(mixed, "key"), "mixed")
    large = mixed.where(f"members > {PAIRS_UP_TO}")
    if not large.isEmpty():
        found = materialize(_crowds(large, texts, width, percent), "confirmed")
        if not found.isEmpty():
            roots = merged(found)
    parts = mixed.where(f"members <= {PAIRS_UP_TO}").select("id", "n", "key").join(roots, "id", "left").select("id", "n", "key", F.coalesce("root", "id").alias("root"))
    # a pair that shares many of these buckets is taken in the one of the least key only
    parts = parts.join(parts.groupBy("id").agg(F.collect_set("key").alias("keys")), "id")
    one = parts.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("keys").alias("ka"), "key")
    two = parts.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("keys").alias("kb"), "key")
    first = F.array_min(F.array_intersect("ka", "kb")) == F.col("key")
    fits = F.expr(f"a > b and ra <> rb and 100 * least(na, nb) >= {percent} * greatest(na, nb)") & first
    pairs = one.join(two, "key").where(fits).select("a", "b")
    pairs = pairs.join(tried, ["a", "b"], "left_anti").join(todo, ["a", "b"], "left_anti")
    pairs = materialize(pairs, "pairs")
    if not pairs.isEmpty():
        found = materialize(_confirm(pairs, texts, width, percent), "confirmed")
        if not found.isEmpty():
            roots = merged(found)

    stand = single.join(roots, "id", "left").select("low", "high", "n", F.coalesce("root", "id").alias("root"))
    out = sketch.join(stand, ["low", "high", "n"], "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
    return out.withColumn("kept", column(key) == F.col("component_id")).union(unnamed)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)
