"""Substring dedup by recompression.

Every document is a string of words. Rounds of renaming replace, everywhere and by the same
rule, first runs of one symbol, then pairs: a round's hash bit puts each symbol on the left or
the right side, and a left symbol followed by a right one becomes one symbol. A name is a hash
of what it stands for, so it is global without a dictionary, and as the rule looks at a symbol
and its neighbours only, equal substrings are parsed equally but for some words at their ends.

A window of ``WINDOW`` words is removed if the same words start earlier. Long repeats are
revealed by high-level symbols, all others by low-level ones:

* After ``HIGH`` rounds symbols are about fifty words long. Two neighbours whose names occurred
  before, side by side, repeat whatever lies inside them, so all windows inside are settled.
* After ``LOW`` rounds symbol boundaries depend on a few words around them. Each window takes
  as its anchor the boundary whose following ``GRAM`` words have the least hash, among those
  that its own words settle, so equal windows have equal anchors. Only windows whose anchor's
  words occur more than once (or that have no anchor, as in long runs) can be repeats; these
  alone are compared, by a hash of the whole window.

Of equal names in one batch of texts only the first goes to the global comparison, so a passage
that very many documents share gives an entry for each batch. Names travel packed, a list for
each batch and part of the name space; a part is compared in memory, so ``spark.sql.shuffle.
partitions`` bounds what a task holds. Texts are shuffled by id once; the
second use reads the same shuffle.

Names are 64 bits: of ``n`` different windows about ``n * n / 2**65`` pairs are taken for
equal, less than one in a billion windows.

Edge cases: null or wordless texts have no words and nothing removed; texts shorter than a
window keep everything; overlapping repeats (runs) are removed but for the first window; ids
are of any kind that has an order, and rows with the same id are taken for one document, so that
rows repeated as a whole give equal results; a row with a null id keeps its words, and they count
for no other; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactigrid.llm.common import column, numbered, slices, strings
from tactigrid.llm.textkit import NOT_SPACE, Words, mix, pair, words

WINDOW, GRAM, LOW, HIGH = 20, 9, 2, 14
SLICE = 4 << 20
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_B = np.uint64(0x9E3779B97F4A7C15 | 1)


def rounds(names: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names and places (of the first word) of the symbols after ``n`` rounds, and from which word
    up to which (exclusive) one must read to know that a symbol begins there. ``first`` marks
    words that begin a document."""
    place = np.arange(len(names))
    size = len(names)
    low, high = place.copy(), place.copy()
    for k in range(n):
        for step in ("runs", "pairs"):
            # to know about a boundary, know the symbols on both sides
            # (elsewhere more words may stand before the first or after the last of a document:
            # that a word ends there is known at first, but not that a symbol does later on)
            ends = np.append(first[1:], True)
            stop = np.append(place[1:], size)
            before = np.where(first, place - 1, np.append(low[:1], low[:-1]))
            after = np.where(ends, stop + (k > 0 or step == "pairs"), np.append(high[1:], size))
            low, high = np.minimum(low, before), np.maximum(high, after)
            keep = np.ones(len(names), bool)
            named = names
            if step == "runs":
                same = np.zeros(len(names), bool)
                same[1:] = (names[1:] == names[:-1]) & ~first[1:]
                if not same.any():
                    continue
                begin = np.flatnonzero(~same)
                count = np.diff(begin, append=len(names))
                at = begin[count > 1]
                named = names.copy()
                named[at] = pair(names[at], count[count > 1].astype(np.uint64) + np.uint64(1 << 40))
                keep = ~same
            else:
                left = ((mix(names + np.uint64(k + 1)) >> np.uint64(17)) & np.uint64(1)) == 0
                at = np.flatnonzero(left[:-1] & ~left[1:] & ~first[1:])
                named = names.copy()
                named[at] = pair(names[at], names[at + 1])
                keep[at + 1] = False
            names, first, place, low, high = named[keep], first[keep], place[keep], low[keep], high[keep]
    return names, place, low, high


def window_hashes(h: np.ndarray, long: int) -> np.ndarray:
    """A hash of ``long`` words from each place on (not to be used where fewer follow), by
    doubling: of 2^k words from two of 2^(k-1)."""
    done, bit = 0, 1
    acc, step = np.zeros(len(h), np.uint64), h.copy()
    while bit <= long:
        if long & bit:
            acc[: max(len(h) - done, 0)] += step[done:] * np.uint64(pow(int(_B), done, 1 << 64))
            done += bit
        if len(h) > bit:
            step[:-bit] += step[bit:] * np.uint64(pow(int(_B), bit, 1 << 64))
        bit <<= 1
    return mix(acc)


def starts(found: Words) -> np.ndarray:
    first = np.zeros(len(found.rows), bool)
    first[found.first[found.n > 0]] = True
    return first


def left_in_text(found: Words) -> np.ndarray:
    """Words from each one to the end of its text, itself included."""
    return found.n[found.rows] - (np.arange(len(found.rows)) - found.first[found.rows])


def anchors(h: np.ndarray, found: Words, first: np.ndarray, window: int, gram: int, low_rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word that begins a window the word its anchor is at (-1: it has none), and the
    hash of the gram at each word."""
    names, place, low, high = rounds(h, first, low_rounds)
    n = len(h)
    grams = window_hashes(h, gram)
    value = np.full(n + window, LAST)
    value[place] = grams[place]
    lo, hi = np.zeros(n + window, np.int64), np.zeros(n + window, np.int64)
    lo[place], hi[place] = low, high
    best, where = np.full(n, LAST), np.full(n, -1)
    i = np.arange(n)
    for d in range(window - gram + 1):
        v = value[d : d + n]
        better = (v < best) & (lo[d : d + n] >= i) & (hi[d : d + n] <= i + window)
        best[better] = v[better]
        where[better] = i[better] + d
    where[left_in_text(found) < window] = -1
    return where, grams


def _one_of_each(name: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which entries stand for their name (the first by doc, then place), which names occur again,
    and which entries are later than the first (a row that is there twice is no later)."""
    order = np.lexsort((at, doc, name))
    name, doc, at = name[order], doc[order], at[order]
    new = np.ones(len(order), bool)
    new[1:] = name[1:] != name[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(begin, append=len(order))
    out = np.zeros((3, len(order)), bool)
    out[0][order] = new
    out[1][order] = np.repeat(size > 1, size)
    out[2][order] = (doc != np.repeat(doc[begin], size)) | (at != np.repeat(at[begin], size))
    return out[0], out[1], out[2]


def _packed(n: int, key: np.ndarray, doc: np.ndarray, start: np.ndarray, long: np.ndarray) -> pa.RecordBatch:
    """A row for each of ``n`` parts of the keys, with all entries of a batch that fall to it: lists
    of one kind of number side by side take a third of the room that rows would."""
    part = (key % np.uint64(n)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    ends = pa.array(np.append(cuts, len(order)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (key.view(np.int64), doc, start.astype(np.int32), long.astype(np.int32))]
    return pa.RecordBatch.from_arrays([pa.array(part[order][cuts]), *lists, pa.array(np.zeros(len(cuts), bool))], names=PACKED)


def _settled(part: int, doc: np.ndarray, start: np.ndarray, long: np.ndarray) -> pa.RecordBatch:
    """A row of entries that need no comparison."""
    ends = pa.array(np.array([0, len(doc)], np.int32))
    lists = [pa.ListArray.from_arrays(pa.array(np.array([0, 0], np.int32)), pa.array(np.zeros(0, np.int64)))]
    lists += [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (doc, start.astype(np.int32), long.astype(np.int32))]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *lists, pa.array([True])], names=PACKED)


PACKED = ["part", "keys", "ids", "starts", "longs", "settled"]
PACKED_SCHEMA = "part int, keys array<bigint>, ids array<bigint>, starts array<int>, longs array<int>, settled boolean"


def _compared(packed: DataFrame, n: int) -> DataFrame:
    """(id, start, long) of what is settled, of all grams (long 0) that came more than once, and
    of everything else with an earlier entry of the same key.

    A part is compared as a whole in memory; there are as many as shuffle partitions."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start", "long"]
        held: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            flags = batch.column(5).to_numpy(zero_copy_only=False)
            for settled in (True, False):
                rows = batch.filter(pa.array(flags == settled))
                if not rows.num_rows:
                    continue
                flat = [rows.column(k).flatten() for k in range(1, 5)]
                if settled:
                    yield pa.RecordBatch.from_arrays(flat[1:], names=names)
                else:
                    for k in range(4):
                        held[k].append(flat[k].to_numpy(zero_copy_only=False))
        if not held[0]:
            return
        key, doc, start, long = (np.concatenate(x) for x in held)
        _, more, later = _one_of_each(key, doc, start)
        out = np.where(long == 0, more, later)
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (doc, start, long)], names=names)

    return packed.repartitionById(n, "part").mapInArrow(compare, "id bigint, start int, long int")


def _names(docs: DataFrame, n: int, window: int, gram: int, low: int, high: int) -> DataFrame:
    """Names of neighbouring high-level symbols (with their length) and of anchors (length 0), packed."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found = words(strings(batch.column(1)), NOT_SPACE)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            h, first = found.hashes(), starts(found)
            if not len(h):
                continue
            doc, at0 = ids[found.rows], np.arange(len(h)) - found.first[found.rows]
            names, place, _, _ = rounds(h, first, high)
            lead = first[place]
            stop = np.append(place[1:], len(h))
            both = np.flatnonzero(~np.append(lead[1:], True))
            alone = np.flatnonzero(lead & np.append(lead[1:], True))
            after = np.minimum(both + 1, len(names) - 1)
            symbol = np.concatenate([pair(names[both], names[after]), mix(names[alone])])
            begin = place[np.concatenate([both, alone])]
            end = np.concatenate([stop[after], stop[alone]])
            wide = end - begin >= window
            symbol, begin, end = symbol[wide], begin[wide], end[wide]
            new, _, old = _one_of_each(symbol, doc[begin], at0[begin])
            where, grams = anchors(h, found, first, window, gram, low)
            place = np.unique(where[where >= 0])
            is_first, again, _ = _one_of_each(grams[place], doc[place], at0[place])
            # one of each for the others to see; what was seen again here is settled
            key = np.concatenate([symbol[new], grams[place[is_first]] ^ LAST])
            spot = np.concatenate([begin[new], place[is_first]])
            long = np.concatenate([end[new] - begin[new], np.zeros(int(is_first.sum()), np.int64)])
            if len(key):
                yield _packed(n, key, doc[spot], at0[spot], long)
            spot = np.concatenate([begin[old], place[again]])
            if len(spot):
                yield _settled(int(h[0] % np.uint64(n)), doc[spot], at0[spot], np.concatenate([end[old] - begin[old], np.zeros(int(again.sum()), np.int64)]))

    return docs.mapInArrow(named, PACKED_SCHEMA)


def _places(column: pa.Array, found: Words) -> np.ndarray:
    """Positions in texts, a list for each row, as numbers of words of the batch."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    per = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    return flat + np.repeat(found.first, per)


def _filled(column: pa.ListArray) -> pa.ListArray:
    return column if not column.null_count else pa.array([x or [] for x in column.to_pylist()], column.type)


def _inside(found: Words, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which words lie in any of the spans."""
    depth = np.zeros(len(found.rows) + 1, np.int64)
    np.add.at(depth, begin, 1)
    np.add.at(depth, end, -1)
    return np.cumsum(depth[:-1]) > 0


def _windows(docs: DataFrame, n: int, window: int, gram: int, low: int) -> DataFrame:
    """Of docs (id, text, starts, longs) the windows that may be repeats, and what is settled, packed."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found = words(strings(batch.column(1)), NOT_SPACE)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            h, first = found.hashes(), starts(found)
            if not len(h):
                continue
            where, _ = anchors(h, found, first, window, gram, low)
            spot, size = _places(_filled(batch.column(2)), found), _filled(batch.column(3)).flatten().to_numpy(zero_copy_only=False)
            met = np.zeros(len(h) + 1, bool)
            met[spot[size == 0]] = True
            begin, end = spot[size > 0], spot[size > 0] + size[size > 0]
            maybe = (left_in_text(found) >= window) & ((where < 0) | met[where]) & ~_inside(found, begin, end - window + 1)
            at = np.flatnonzero(maybe)
            key = window_hashes(h, window)[at]
            doc, start = ids[found.rows], np.arange(len(h)) - found.first[found.rows]
            new, _, later = _one_of_each(key, doc[at], start[at])
            if new.any():
                yield _packed(n, key[new], doc[at[new]], start[at[new]], np.full(int(new.sum()), window))
            # repeats side by side are one span
            seen = at[later]
            cut = np.flatnonzero((np.diff(seen, prepend=-2) != 1) | (doc[seen] != np.append(doc[seen][:1], doc[seen][:-1]))) if len(seen) else seen
            begin = np.concatenate([begin, seen[cut]])
            size = np.concatenate([size[size > 0], np.diff(cut, append=len(seen)) + window - 1]) if len(seen) else size[size > 0]
            if len(begin):
                yield _settled(int(h[0] % np.uint64(n)), doc[begin], start[begin], size)

    return docs.mapInArrow(compared, PACKED_SCHEMA)


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, low: int = LOW, high: int = HIGH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, starts, longs, key): every row with the spans, in words from 0, that repeat."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = numbered(docs, key)
    every = docs.select(column(docs.columns[-1]).alias("id"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"), column(key).alias("key"))
    texts = every.where("id is not null")
    dealt = texts.repartition(n, "id")

    def with_spans(found: DataFrame) -> DataFrame:
        per = found.groupBy("id").agg(F.collect_list(F.struct("start", "long")).alias("s"))
        return dealt.join(per.select("id", "s.start", "s.long"), "id", "left").select("id", "text", F.col("start").alias("starts"), F.col("long").alias("longs"), "key")

    marked = with_spans(_compared(_names(texts, n, window, gram, low, high), n))
    found = with_spans(_compared(_windows(marked, n, window, gram, low), n))
    none = F.lit(None).cast("array<int>")
    return found.union(every.where("id is null").select("id", "text", none, none, "key"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", texts: bool = True, **parameters) -> DataFrame:
    """``key``, n_words, n_removed, kept_sha256 and (with ``texts``) kept of every row, where kept
    are the words that are in no repeated window, joined by one space."""

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            own_texts = strings(batch.column(1))
            found = words(own_texts, NOT_SPACE)
            begin = _places(_filled(batch.column(2)), found)
            gone = _inside(found, begin, begin + _filled(batch.column(3)).flatten().to_numpy(zero_copy_only=False))
            removed = np.bincount(found.rows[gone], minlength=len(own_texts))
            sha, kept, first = [], [], found.first
            for i, t in enumerate(own_texts.to_pylist()):
                own = t.encode().split()
                if removed[i]:
                    own = [own[k] for k in np.flatnonzero(~gone[first[i] : first[i] + len(own)]).tolist()]
                raw = b" ".join(own)
                sha.append(hashlib.sha256(raw).hexdigest())
                if texts:
                    kept.append(raw.decode())
            out = [batch.column(4), pa.array(found.n), pa.array(removed), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.string())] * texts, names=["key", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts)

    found = repeats(docs, window, key=key, text=text, **parameters)
    kind = docs.schema[key].dataType.simpleString()
    return found.mapInArrow(cleaned, f"key {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * texts).withColumnRenamed("key", key)


def op2_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM win),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM ranked WHERE k > 1)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
