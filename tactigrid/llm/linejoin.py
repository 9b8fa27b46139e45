"""Line dedup by an exact set-similarity join.

A line (of a text cut at line feeds) is the set of its words. It is removed if an earlier line
(smaller document id, or the same document and further up), removed or not, has a Jaccard
similarity of at least ``percent`` / 100.

1. Word counts over all texts go to ``BUCKETS`` counters, a table of fixed size that every
   worker gets; words in order of (counter's level, hash) are words by rarity.
2. Of lines with equal sets in one task only the first goes on; the others are settled.
3. A line that reaches the similarity shares one of its first ``n - ceil(p n) + 1`` words (its
   prefix). Each line goes, with its size and a bitmap of its words, once to each part of
   the words' space that one of these falls into, packed with others.
4. In a part, lines with equal sets are settled by a digest. Lines that share a prefix word and
   pass the length filter, the positional filter (what can still be shared after the place of
   the common word) and the bitmaps are candidates. A line of which few lines share a word is
   held against all of them; where more than ``WIDE`` do, against those next in size, and unless
   one of these is hardly in doubt against the others (as long as that is no more than twice the work).
5. Candidates are confirmed on the words of both lines, for each line the most likely one
   first, and the others only if that one fails. Lines that are not settled then, and haven't
   met all lines they share a word with, are held against all of these in a second run, to which
   only lines go that have such a word.

Lines of fewer than ``least`` different words are left alone; with 1, the default, none are.
Words are compared by 46-bit numbers until the confirmation: of a line of 44 words about one
in 10**10 has two that are taken for one. A group of lines that share a rare word is held in
one task (100 bytes a line or so), whose work grows with the group, and in the second run with the
group times those of its lines that nothing has settled.

Texts are shuffled by id once, into a bucketed table that the later uses read.

Edge cases: null texts stay null, and blank lines stay; equal lines in one document count too;
ids are of any kind that has an order; rows with the same id are one document (rows repeated as
a whole give equal results); a row with a null id is left as it is, and its lines count for
nothing; an empty table gives an empty result. Other columns stay as they are, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactigrid.llm.common import bucketed, column, eased, free, fresh, materialize, numbered, slices, strings
from tactigrid.llm.textkit import NOT_SPACE, Words, mix, words
from tactigrid.llm.winnow import let

PERCENT, LEAST = 80, 1
BUCKETS = 1 << 18
#: Lines that share a word of which a line is tried with so many at first.
WIDE = 1024
#: Of a line with a candidate that is hardly in doubt so many candidates are told at first; of
#: every line, if there are more than ``ROOM`` for each entry of a part.
ROOM, BEST = 8, 4
#: Lines of up to so many words have a bitmap of 128 bits, those of twice as many one of 256, ...
DENSE, MOST_WORDS = 60, 256
#: The words' space has so many parts at least: with a few, most of a line's words share one, and
#: what a line costs would depend on the number.
PARTS = 64
CHUNK = 1000
#: So many pairs are tried at a time, which a processor's cache holds.
TRIED = 1 << 17
SLICE = 4 << 20
#: Texts are cut into words so many bytes at a time, which a processor's cache holds with what comes of them.
BLOCK = 1 << 19
HASH, LINE = np.uint64(39), np.uint64(46)
ONE = np.uint64(1)

#: Words of lines that go into the second run are marked in a table of so many places, by all but
#: the last ``MARK`` bits.
MARKS, MARK = 1 << 22, np.uint32(10)

CANDIDATE, SETTLED, MORE = 0, 1, 2
PACKED = "part int, size bigint, payload binary"
FOUND = "id bigint, line int, to_id bigint, to_line int, far int, kind int"


def line_of(found: Words, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its line, counted over the batch, and for each row its first line."""
    ends = np.flatnonzero(found.raw == 10)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    offsets -= offsets[0]
    # a line ends at each line feed and at the end of each text
    places = np.sort(np.concatenate([ends, offsets[1:]]), kind="stable")
    per = np.diff(np.searchsorted(found.starts, places), prepend=0)
    return np.repeat(np.arange(len(per)), per), np.searchsorted(ends, offsets[:-1]) + np.arange(len(texts))


def _levels(docs: DataFrame) -> np.ndarray:
    """How often words fall into each of ``BUCKETS`` counters, over all texts, as levels (three
    to a doubling), ready to stand above the hash of a word."""
    own = BUCKETS // 64

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, "text", BLOCK):
            h = words(strings(batch.column(1)), NOT_SPACE).hashes()
            total += np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        yield _rows(total)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[k] = total.get(k, 0) + x.values.to_numpy()
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.ListArray.from_arrays(pa.array([0, own], pa.int32()), pa.array(x))], names=["k", "n"])

    def _rows(total: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.arange(0, BUCKETS + 1, own, dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(64, dtype=np.int32)), pa.ListArray.from_arrays(ends, pa.array(total))], names=["k", "n"])

    got = docs.mapInArrow(eased(counted), "k int, n array<bigint>").repartition(64, "k").mapInArrow(eased(summed), "k int, n array<bigint>").toArrow()  # 64 rows
    out = np.zeros(BUCKETS, np.int64)
    for k, x in zip(got["k"].to_pylist(), got["n"].to_pylist(), strict=True):
        out[k * own : (k + 1) * own] = x
    return np.minimum(127, 3 * np.log2(1 + out)).astype(np.uint64) << HASH


def _packed(part: int, arrays: list[np.ndarray]) -> tuple[int, int, bytes]:
    raw = np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)
    return part, len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(size: int, payload: bytes, kinds: tuple) -> list[np.ndarray]:
    raw = pa.decompress(payload, size, codec="zstd", asbytes=True)
    lengths = np.frombuffer(raw, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for kind, n in zip(kinds, lengths.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


#: Of each line: how far its document's number is from the one before, line, size, digest, bitmap
#: (all one after the other), how many entries follow for it; of each entry: word, place.
SETS = (np.int64, np.int32, np.int32, np.uint32, np.uint64, np.int32, np.uint32, np.int32)
PLACES = (np.int64, np.int32)


def _send(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, size, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(size, pa.int64()), pa.array(payload, pa.binary())], names=["part", "size", "payload"])


def _tokens(found: Words, levels: np.ndarray) -> np.ndarray:
    """Words as numbers whose order is by rarity."""
    h = found.hashes()
    return levels[(h % np.uint64(BUCKETS)).astype(np.int64)] | (mix(h) >> (np.uint64(64) - HASH))


def _line_words(batch: pa.RecordBatch, at: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts in column ``at`` as ``_tokens``, the line of each, and each text's first line."""
    out, before = [], 0
    for block in slices(iter([batch]), batch.schema.names[at], BLOCK):
        texts = strings(block.column(at))
        found = words(texts, NOT_SPACE)
        line, first = line_of(found, texts)
        out.append((_tokens(found, levels), line + before, first + before))
        before += int(np.count_nonzero(found.raw == 10)) + len(texts)
    token, line, first = (np.concatenate(x) for x in zip(*out, strict=True))
    return token, line, first


def _sets(token: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, ...]:
    """(line, its first word in token, its size, token) of the sets of words, rarest first."""
    own = np.cumsum(np.diff(line, prepend=line[:1]) != 0)  # lines that have words, from 0
    out, rows = [], []
    for to in range(0, int(own[-1]) + 1, 1 << 11):
        lo, hi = np.searchsorted(own, [to, to + (1 << 11)])
        key = np.sort(token[lo:hi] | ((own[lo:hi] - to).astype(np.uint64) << LINE))
        new = np.ones(hi - lo, bool)
        new[1:] = key[1:] != key[:-1]
        out.append(key[new] & ((ONE << LINE) - ONE))
        rows.append(own[lo:hi][new])
    token, row = np.concatenate(out), np.concatenate(rows)
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    return line[np.flatnonzero(np.diff(own, prepend=-1))], begin, np.diff(begin, append=len(row)), token


def _width(size: np.ndarray) -> np.ndarray:
    """How many 64-bit numbers the bitmap of a line takes."""
    return np.minimum(2 << np.ceil(np.log2(np.maximum(size / DENSE, 1))).astype(np.int64), MOST_WORDS)


def _bitmaps(token: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of sets of words, one after the other, and the width of each."""
    width = _width(size)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    bit = mix(token + np.uint64(7))
    at = np.repeat(ends - width, size) + ((bit >> np.uint64(6)).astype(np.int64) & np.repeat(width - 1, size))
    np.bitwise_or.at(out, at, ONE << (bit & np.uint64(63)))
    return out, width


class _Seen:
    """The first place of each digest in this task, so far."""

    def __init__(self) -> None:
        self.digest, self.doc, self.line = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def first(self, digest: np.ndarray, doc: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the new places are the first of their digest, and which are later than one."""
        old = len(self.digest)
        all_digest = np.concatenate([self.digest, digest])
        all_doc, all_line = np.concatenate([self.doc, doc]), np.concatenate([self.line, line])
        new = np.arange(len(all_digest)) >= old  # of equal places the known one comes first
        order = np.lexsort((new, all_line, all_doc, all_digest))
        d, i, k = all_digest[order], all_doc[order], all_line[order]
        lead = np.ones(len(order), bool)
        lead[1:] = d[1:] != d[:-1]
        begin = np.flatnonzero(lead)
        size = np.diff(begin, append=len(order))
        later = (i != np.repeat(i[begin], size)) | (k != np.repeat(k[begin], size))
        self.digest, self.doc, self.line = d[begin], i[begin], k[begin]
        firsts, laters = np.zeros(len(order), bool), np.zeros(len(order), bool)
        firsts[order], laters[order] = lead, later
        return firsts[old:], laters[old:]


def _short(token: np.ndarray) -> np.ndarray:
    """A prefix word as it is sent; its part of ``n`` is the remainder by ``n``."""
    return (mix(token) >> np.uint64(32)).astype(np.uint32)


def _prefixes(begin: np.ndarray, size: np.ndarray, token: np.ndarray, on: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, place, word) of the prefix words of the sets that are ``on``."""
    # (a set so small that one word more is too many is only like itself: one word will do)
    long = np.where(on, np.where(100 * size < percent * (size + 1), 1, size - (size * percent + 99) // 100 + 1), 0)
    ends = np.cumsum(long)
    place = (np.arange(int(ends[-1])) - np.repeat(ends - long, long)).astype(np.int32)
    return np.repeat(np.arange(len(size)), long), place, _short(token[np.repeat(begin, long) + place])


def _marks(probes: DataFrame, table: DataFrame, levels: np.ndarray, n: int, percent: int, least: int) -> np.ndarray:
    """Which of ``MARKS`` classes the prefix words fall into that ``probes`` (part, id, line) share
    with others in their parts. A table of fixed size; words that fall into a class by chance do no harm."""
    shared = table.sparkSession.sparkContext.broadcast(levels)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(MARKS, bool)
        for batch in slices(batches, "text", SLICE):
            texts = strings(batch.column(0))
            found = words(texts, NOT_SPACE)
            if not len(found.rows):
                continue
            row, begin, size, token = _sets(_tokens(found, shared.value), line_of(found, texts)[0])  # (a text is a line)
            owner, _, word = _prefixes(begin, size, token, size >= least, percent)
            parts = batch.column(1).combine_chunks() if isinstance(batch.column(1), pa.ChunkedArray) else batch.column(1)
            own = np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy()) * n + parts.flatten().to_numpy()
            out[word[np.isin(row[owner] * n + word % np.uint32(n), own)] >> MARK] = True
        yield pa.RecordBatch.from_arrays([pa.array([pa.compress(np.packbits(out).tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["m"])

    place = ["id", "line"]
    per = probes.groupBy(*place).agg(F.collect_set("part").alias("parts"))
    texts = _line_texts(table, probes.select(*place)).join(per, place).select("text", "parts")
    out = np.zeros(MARKS // 8, np.uint8)
    for m in texts.repartition(16).mapInArrow(eased(marked), "m binary").toArrow()["m"].to_pylist():  # 16 rows
        out |= np.frombuffer(pa.decompress(m, MARKS // 8, codec="zstd", asbytes=True), np.uint8)
    return np.unpackbits(out).astype(bool)


def _entries(docs: DataFrame, levels: np.ndarray, n: int, percent: int, least: int, marks: np.ndarray | None = None) -> DataFrame:
    """Packed rows of ``n`` parts: lines with their prefix words, and (size below 0) settled places.
    With ``marks`` only prefix words so marked, and the lines that have one."""
    shared = docs.sparkSession.sparkContext.broadcast((levels, marks))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in slices(batches, "text", SLICE):
            ids = batch.column(0).to_numpy()
            levels, marks = shared.value
            token, line, first_line = _line_words(batch, 1, levels)
            if not len(token):
                continue
            if marks is not None:
                some = np.zeros(int(line[-1]) + 1, bool)
                some[line[marks[_short(token) >> MARK]]] = True
                line, token = line[some[line]], token[some[line]]
                if not len(line):
                    continue
            line, begin, size, token = _sets(token, line)
            row = np.searchsorted(first_line, line, side="right") - 1
            doc, at = ids[row], (line - first_line[row]).astype(np.int32)
            digest = np.add.reduceat(mix(token), begin)
            some = size >= least
            firsts, laters = np.zeros(len(size), bool), np.zeros(len(size), bool)
            firsts[some], laters[some] = seen.first(digest[some], doc[some], at[some])
            out = []
            if laters.any() and marks is None:
                part, long, payload = _packed(int(digest[0] % np.uint64(n)), [doc[laters], at[laters]])
                out.append((part, -long, payload))
            bits, width = _bitmaps(token, begin, size)
            bits_end = np.cumsum(width)
            owner, place, entry = _prefixes(begin, size, token, firsts, percent)
            if marks is not None:
                some = marks[entry >> MARK]
                owner, place, entry = owner[some], place[some], entry[some]
                if not len(owner):
                    continue
            part = entry % np.uint32(n)
            order = np.argsort(part, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(part[order].astype(np.int64), prepend=-1)), len(order))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = order[lo:hi]
                who = owner[own]
                lead = np.flatnonzero(np.diff(who, prepend=-1))
                s = who[lead]
                wide = width[s]
                own_bits = bits[np.repeat(bits_end[s] - np.cumsum(wide), wide) + np.arange(int(wide.sum()))]
                out.append(_packed(int(part[own[0]]), [np.diff(doc[s], prepend=0), at[s], size[s].astype(np.int32), (digest[s] >> np.uint64(32)).astype(np.uint32), own_bits, np.diff(lead, append=len(who)).astype(np.int32), entry[own], place[own]]))
            if out:
                yield _send(out)

    return docs.mapInArrow(eased(listed), PACKED)


class _Lines:
    """All lines of a part, and the entries of those that go on, by word and size."""

    def __init__(self, parts: list[list[np.ndarray]]) -> None:
        self.doc, self.line, self.size, digest, bits, per, token, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        # each bitmap, and after all of them each folded in two, as lines of other widths see it
        self.width = _width(self.size)
        self.bits_at = np.cumsum(self.width) - self.width
        half = self.width // 2
        self.half_at = len(bits) + np.cumsum(half) - half
        low = np.repeat(self.bits_at - (np.cumsum(half) - half), half) + np.arange(int(half.sum()))
        self.bits = np.concatenate([bits, bits[low] | bits[low + np.repeat(half, half)]])
        owner = np.repeat(np.arange(len(per)), per)
        leads = np.zeros(len(per), bool)  # the part that has a line's first word speaks for it
        leads[owner[place == 0]] = True
        name = mix((digest.astype(np.uint64) << np.uint64(32) | self.size.astype(np.uint64)) ^ mix(bits[self.bits_at] ^ mix(bits[self.bits_at + 1])))
        order = np.argsort(name)
        twin = np.zeros(len(order), bool)
        twin[1:] = name[order[1:]] == name[order[:-1]]
        twin[:-1] |= twin[1:]
        some = order[twin]
        some = some[np.lexsort((self.line[some], self.doc[some], name[some]))]
        lead = np.ones(len(some), bool)
        lead[1:] = name[some[1:]] != name[some[:-1]]
        begin = np.flatnonzero(lead)
        first = np.repeat(some[begin], np.diff(begin, append=len(some)))
        later = (self.doc[some] != self.doc[first]) | (self.line[some] != self.line[first])
        self.settled = some[later & leads[some]]
        self.on = np.ones(len(per), bool)
        self.on[some[~lead]] = False
        fine = self.on[owner]
        owner, token, place = owner[fine], token[fine], place[fine]
        key = (token.astype(np.uint64) << np.uint64(32)) | self.size[owner].astype(np.uint64)
        order = np.argsort(key)
        self.key, self.owner, self.place = key[order], owner[order], place[order]
        # of each entry the size of its line, its bitmap's width and first number, and that of the folded one
        self.long, self.wide = self.size[self.owner], self.width[self.owner].astype(np.int32)
        self.head, self.half_head = self.bits[self.bits_at[self.owner]], self.bits[self.half_at[self.owner]]

    def upto(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """For each entry the first and the end of those with its word that the length filter lets pass.
        A line so small that one word more is too many has none: it is only like its twins."""
        word, size = self.key & ~np.uint64(0xFFFFFFFF), self.long
        lo = np.searchsorted(self.key, word | ((size * percent + 99) // 100).astype(np.uint64))
        hi = np.searchsorted(self.key, word | np.minimum(size.astype(np.int64) * 100 // percent, 0xFFFFFFFF).astype(np.uint64), side="right")
        i = np.arange(len(lo))
        alone = 100 * size < percent * (size + 1)
        return np.where(alone, i, lo), np.where(alone, i + 1, hi)

    def tried(self, one: np.ndarray, two: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(later, earlier, far) of the pairs of entries that pass the positional filter and the bitmaps."""
        na, nb, pa_, pb = self.long[one], self.long[two], self.place[one], self.place[two]
        fine = np.flatnonzero((100 + percent) * (np.minimum(na - pa_, nb - pb) + np.minimum(pa_, pb)) >= percent * (na + nb))
        na, nb = na[fine], nb[fine]
        one, two = one[fine], two[fine]
        # most pairs are no candidates after the first bits
        wa, wb = self.wide[one], self.wide[two]
        p, q = self.head[one], self.head[two]
        if (wa != wb).any():
            p, q = np.where(wa <= wb, p, self.half_head[one]), np.where(wb <= wa, q, self.half_head[two])
        fine = (100 + percent) * np.minimum(na - np.bitwise_count(p & ~q), nb - np.bitwise_count(q & ~p)) >= percent * (na + nb)
        fine = np.flatnonzero(fine | (np.maximum(wa, wb) > 2 * np.minimum(wa, wb)))
        na, nb = na[fine], nb[fine]
        # (sets of equal size that aren't equal lack a word of each other at least)
        few = np.flatnonzero((100 + percent) * (np.minimum(na, nb) - (na == nb)) >= percent * (na + nb))
        a, b, na, nb = self.owner[one[fine[few]]], self.owner[two[fine[few]]], na[few], nb[few]
        wa, wb = self.width[a], self.width[b]
        common = np.where(np.maximum(wa, wb) <= 2 * np.minimum(wa, wb), np.minimum(wa, wb), 0)
        kept, fars = [np.flatnonzero(common == 0)], [np.zeros(int((common == 0).sum()), np.int32)]
        for w in np.unique(common[common > 0]).tolist():
            own = np.flatnonzero(common == w)
            x, y = (np.where(self.width[s] == w, self.bits_at[s], self.half_at[s]) for s in (a[own], b[own]))
            least = percent * (na[own] + nb[own])
            in_a, in_b = na[own], nb[own]  # words that may be shared, as far as bits have been seen
            for k in range(w):
                p, q = self.bits[x + k], self.bits[y + k]
                in_a = in_a - np.bitwise_count(p & ~q)
                in_b = in_b - np.bitwise_count(q & ~p)
                fine = np.flatnonzero((100 + percent) * np.minimum(in_a, in_b) >= least)
                if len(fine) < len(own):
                    own, x, y, least, in_a, in_b = own[fine], x[fine], y[fine], least[fine], in_a[fine], in_b[fine]
            kept.append(own)
            fars.append(na[own] + nb[own] - in_a - in_b)
        own, far = np.concatenate(kept), np.concatenate(fars)
        a, b = a[own], b[own]
        swap = (self.doc[a] < self.doc[b]) | ((self.doc[a] == self.doc[b]) & (self.line[a] < self.line[b]))
        return np.where(swap, b, a), np.where(swap, a, b), far


def _sure(lines: _Lines, a: np.ndarray, b: np.ndarray, far: np.ndarray, percent: int, share: int) -> np.ndarray:
    """Which candidates' bitmaps show at most one of ``share`` of the words that may differ. With 5 a
    candidate is hardly in doubt (bitmaps hide up to two of three), with 2 it is likely; but of many
    lines that are a bit less alike than it takes, some always look likely."""
    return share * (100 + percent) * far <= (100 - percent) * (lines.size[a] + lines.size[b])


def _pairs(lines: _Lines, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, percent: int, room: int = 0, best: int = BEST, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier, far) of the candidates among entries ``rows`` with those from ``lo`` to ``hi``,
    each once, and the lines of which only the ``best`` are kept (with ``room``): those with a candidate
    that is hardly in doubt, and all if there are more than ``room``. With ``wanted`` only those of
    which the later line is one of them."""
    many = hi - lo
    ends = np.cumsum(many)
    names, fars, cut = np.zeros(0, np.uint64), np.zeros(0, np.int32), [np.zeros(0, np.int64)]
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def reduced(last: bool) -> None:
        nonlocal names, fars
        names = np.concatenate([names, *[h[0] for h in held]])
        fars = np.concatenate([fars, *[h[1] for h in held]])
        held.clear()
        names, first = np.unique(names, return_index=True)  # (all of a pair are as far)
        fars = fars[first]
        if room and len(names) and (last or len(names) > room):
            a = (names >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((fars, a))
            begin = np.flatnonzero(np.diff(a[order], prepend=-1))
            size = np.diff(begin, append=len(order))
            nth = np.arange(len(order)) - np.repeat(begin, size)
            lead = order[begin]
            few = _sure(lines, a[lead], (names[lead] & np.uint64(0xFFFFFFFF)).astype(np.int64), fars[lead], percent, 5) | (len(names) > room)
            cut.append(a[lead][few & (size > best)])
            order = np.sort(order[(nth < best) | ~np.repeat(few, size)])
            names, fars = names[order], fars[order]

    at, waiting = 0, 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TRIED, side="right")))
        size = many[at:to]
        one = np.repeat(rows[at:to], size)
        two = np.arange(len(one)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[at:to], size)
        at = to
        a, b, far = lines.tried(one, two, percent)
        fine = a != b
        if wanted is not None:
            fine &= wanted[a]
        if fine.any():
            held.append(((a[fine].astype(np.uint64) << np.uint64(32)) | b[fine].astype(np.uint64), far[fine]))
            waiting += int(fine.sum())
        if waiting > 2_000_000:
            reduced(False)
            waiting = 0
    reduced(True)
    return (names >> np.uint64(32)).astype(np.int64), (names & np.uint64(0xFFFFFFFF)).astype(np.int64), fars, np.unique(np.concatenate(cut))


def _found(lines: _Lines, a: np.ndarray, b: np.ndarray | None, far: np.ndarray | int, kind: int) -> pa.RecordBatch:
    n = len(a)
    to = (np.zeros(n, np.int64), np.full(n, far, np.int32)) if b is None else (lines.doc[b], lines.line[b])
    cols = [lines.doc[a], lines.line[a], *to, np.full(n, far, np.int32) if np.isscalar(far) else far, np.full(n, kind, np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "line", "to_id", "to_line", "far", "kind"])


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[list, list, list, int]:
    """Lines, settled places and probes of a part, and its number."""
    sets, settled, probes, part = [], [], [], 0
    for batch in batches:
        for part, size, payload, *probe in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if payload is None:
                probes.append(probe)
            elif size < 0:
                settled.append(_unpacked(-size, payload, PLACES))
            else:
                own = _unpacked(size, payload, SETS)
                own[0] = np.cumsum(own[0])
                sets.append(own)
    return sets, settled, probes, part


def _first_run(percent: int, wide: int, room: int, best: int) -> Callable:
    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, settled, _, part = _read(batches)
        for doc, line in settled:
            zero = np.zeros(len(doc), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc, line, zero.astype(np.int64), zero, zero, zero + SETTLED)], names=["id", "line", "to_id", "to_line", "far", "kind"])
        if not sets:
            return
        lines = _Lines(sets)
        if len(lines.settled):
            yield _found(lines, lines.settled, None, 0, SETTLED)
        i = np.arange(len(lines.key))
        lo, hi = lines.upto(percent)
        most = 1 + room * len(i)
        a, b, far, cut = _pairs(lines, i, np.maximum(lo, i - wide), i, percent, most, best)
        if len(a):
            yield _found(lines, a, b, far, CANDIDATE)
        partly = (i - lo > wide) | (hi - 1 - i > wide)
        left = np.zeros(len(lines.size), bool)
        left[lines.owner[partly]] = True
        # lines without a candidate that is hardly in doubt are held against all at once, those without a
        # likely one first, as far as that takes no more than twice the above; most of these are the first
        # of their kind, which nothing settles
        doubt, likely = left.copy(), np.zeros(len(left), bool)
        doubt[a[_sure(lines, a, b, far, percent, 5)]] = False
        likely[a[_sure(lines, a, b, far, percent, 2)]] = True
        rows = np.flatnonzero(doubt[lines.owner])
        if len(rows):
            cost = np.bincount(lines.owner[rows], hi[rows] - lo[rows], len(left))
            order = np.flatnonzero(doubt)
            order = order[np.lexsort((cost[order], likely[order]))]
            doubt[order[np.cumsum(cost[order]) > 2 * wide * len(i)]] = False
            rows = rows[doubt[lines.owner[rows]]]
            a, b, far, more = _pairs(lines, rows, lo[rows], hi[rows], percent, most, best, doubt)
            if len(a):
                yield _found(lines, a, b, far, CANDIDATE)
            left[doubt] = False
            left[more] = True
        left[cut] = True
        more = np.flatnonzero(left)
        if len(more):
            yield _found(lines, more, None, part, MORE)

    return tried


def _second_run(percent: int) -> Callable:
    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, _, probes, _ = _read(batches)
        if not sets or not probes:
            return
        lines = _Lines(sets)
        name = lambda doc, line: mix(doc.view(np.uint64) ^ mix(line.astype(np.uint64)))  # noqa: E731  (more than wanted do no harm)
        wanted = np.isin(name(lines.doc, lines.line), name(np.array([p[0] for p in probes], np.int64), np.array([p[1] for p in probes], np.int32)))
        lo, hi = lines.upto(percent)
        rows = np.flatnonzero(wanted[lines.owner])
        a, b, far, _ = _pairs(lines, rows, lo[rows], hi[rows], percent, wanted=wanted)
        if len(a):
            yield _found(lines, a, b, far, CANDIDATE)

    return tried


def _line_texts(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, line, text) of the ``wanted`` (id, line)."""

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            out: tuple[list, list, list] = ([], [], [])
            for i, t, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = t.split("\n")
                for k in at:
                    if k < len(own):
                        out[0].append(i)
                        out[1].append(k)
                        out[2].append(own[k])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=["id", "line", "text"])

    per = wanted.groupBy("id").agg(F.collect_set("line").alias("lines"))
    return table.select("id", F.col("__text").alias("text")).join(per.hint("shuffle_hash"), "id").select("id", "text", "lines").mapInArrow(eased(picked), "id bigint, line int, text string")


def _confirmed(pairs: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """The later lines (id, line) of those ``pairs`` (id, line, to_id, to_line) that reach the similarity."""

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            fine, known = [], {}
            for a, b in zip(one, two, strict=True):
                x = set(a.encode().split())
                y = known.get(b)
                if y is None:
                    known[b] = y = set(b.encode().split())
                both = len(x & y)
                fine.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["id", "line"]).filter(pa.array(fine, pa.bool_()))

    pairs = materialize(pairs, "pairs")
    wanted = pairs.select("id", "line").union(pairs.select(F.col("to_id").alias("id"), F.col("to_line").alias("line")))
    texts = materialize(_line_texts(table, wanted), "line-texts")
    # a line that very many are held against is dealt out with as many copies as that takes
    salts = F.ceil(F.count("*") / CHUNK).cast("int")
    per = pairs.groupBy("to_id", "to_line").agg(salts.alias("salts"))
    to = texts.select(F.col("id").alias("to_id"), F.col("line").alias("to_line"), F.col("text").alias("to_text")).join(per, ["to_id", "to_line"])
    to = to.select("to_id", "to_line", "to_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = pairs.join(per, ["to_id", "to_line"]).withColumn("salt", F.pmod(F.xxhash64("id", "line"), F.col("salts")).cast("int"))
    rows = rows.join(texts, ["id", "line"]).join(to, ["to_id", "to_line", "salt"]).select("id", "line", "text", "to_text")
    out = materialize(rows.mapInArrow(eased(confirmed), "id bigint, line int").distinct(), "confirmed", few=True)
    free(pairs, texts)
    return out


def repeated_lines(docs: DataFrame, table: DataFrame, percent: int, least: int, wide: int = WIDE, room: int = ROOM, best: int = BEST) -> DataFrame:
    """(id, line) of the lines to remove. ``docs`` are (id, text), ``table`` has (id, __text) by id."""
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), PARTS)
    levels = _levels(docs)
    entries = _entries(docs, levels, n, percent, least)
    found = materialize(entries.repartitionById(n, "part").mapInArrow(eased(_first_run(percent, wide, room, best)), FOUND), "found")
    place, other = ["id", "line"], ["to_id", "to_line"]
    settled = [found.where(f"kind = {SETTLED}").select(*place)]
    candidates = found.where(f"kind = {CANDIDATE}").select(*place, *other, "far")
    per = candidates.groupBy(*place).agg(F.min(F.struct("far", *other)).alias("b"), F.collect_set(F.struct(*other)).alias("all"))
    per = materialize(per.select(*place, F.struct("b.to_id", "b.to_line").alias("b"), "all"), "candidates")
    settled.append(_confirmed(per.select(*place, "b.*"), table, percent))
    # the others, of lines that the likeliest one didn't settle
    rest = per.where("size(all) > 1").join(settled[1], place, "left_anti").select(*place, F.explode(F.array_remove("all", F.col("b"))).alias("o"))
    settled.append(_confirmed(rest.select(*place, "o.*"), table, percent))
    free(per)
    probes = found.where(f"kind = {MORE}").select(F.col("to_line").alias("part"), *place)
    probes = materialize(probes.join(settled[1], place, "left_anti").join(settled[2], place, "left_anti"), "probes")
    if not probes.isEmpty():
        none = F.lit(None)
        marks = _marks(probes, table, levels, n, percent, least)
        rows = _entries(docs, levels, n, percent, least, marks).select("*", none.cast("bigint").alias("id"), none.cast("int").alias("line"))
        rows = rows.union(probes.select("part", F.lit(0).cast("bigint"), none.cast("binary"), *place))
        again = rows.repartitionById(n, "part").mapInArrow(eased(_second_run(percent)), FOUND)
        settled.append(_confirmed(again.select(*place, *other).distinct(), table, percent))
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out


def dedup_lines(docs: DataFrame, percent: int = PERCENT, least: int = LEAST, key: str = "doc_id", text: str = "text", **first_run: int) -> DataFrame:
    """``docs`` with ``text`` less the removed lines, and n_lines, n_removed and emptied (nothing
    but white space is left of a text that had more); a name that ``docs`` has already gets
    underscores after it until it is free."""
    names = [fresh(docs.columns, c) for c in ("n_lines", "n_removed", "emptied")]
    kept = [c for c in docs.columns if c != text]
    with_id = numbered(docs, key)
    number = column(with_id.columns[-1])
    with_id = with_id.select(*[column(c).alias(f"c{i}") for i, c in enumerate(kept)], column(text).cast("string").alias("__text"), number.alias("id"))
    plain = with_id.where("id is not null").select("id", F.coalesce("__text", F.lit("")).alias("text"))
    table = bucketed(with_id, "id", "lines")
    gone = repeated_lines(plain, table, percent, least, **first_run).groupBy("id").agg(F.collect_set("line").alias("__lines"))
    rows = table.join(gone.hint("shuffle_hash"), "id", "left")

    def cut(own):
        left = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.coalesce("__lines", F.array().cast("array<int>")))
        return F.struct(F.size(own).alias("total"), F.when(F.col("__lines").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(own, i)), "\n")).alias("text"))

    rows = rows.withColumn("__cut", let(F.split(F.coalesce("__text", F.lit("")), "\n"), cut))
    removed = F.coalesce(F.size("__lines"), F.lit(0))
    left = F.when(F.col("__text").isNull(), None).otherwise(F.col("__cut.text"))
    emptied = F.coalesce(F.col("__lines").isNotNull() & ~F.col("__cut.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    at = {c: F.col(f"c{i}") for i, c in enumerate(kept)} | {text: left}
    return rows.select(*[at[c].alias(c) for c in docs.columns], F.col("__cut.total").cast("bigint").alias(names[0]), F.greatest(removed, F.lit(0)).cast("bigint").alias(names[1]), emptied.alias(names[2]))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
