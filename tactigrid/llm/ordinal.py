"""Cumulative-link ordinal regression on hashed text features.

One weight per feature is shared by all thresholds: ``P(grade >= k) = sigma(w.x - t_k)`` with
``t_1 <= t_2 <= ...``. Features are sparse and binary: hashed lower-case words and
their beginnings, and, if asked for, hashed word shapes with how much of the text they make
up (binned).

Training takes a bounded sample of labelled rows (``most_labelled``, chosen by a hash of the
key, so that it is the same on every run), collected as hashed features only. Copies in the
sample are dropped by a sketch of their shingles; features are kept where the
likelihood ratio for a difference is ``least_ratio`` or more, and the model is fitted to those on the
driver. Scoring reads every row of the corpus once, beside the scan, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactigrid.llm.common import column, eased, fresh, slices, strings
from tactigrid.llm.textkit import FOLD, LETTERS, NOT_SPACE, mix, pair, words

#: The sample: at most so many labelled rows; the model: at most so many features.
MOST_LABELLED = 4000
MOST_FEATURES = 1024
SKETCHES = 8
#: Lengths in bytes of the word beginnings that are features.
STEMS = (4, 5, 6, 7, 8)
#: Feature ids are the upper bits of a 64-bit hash.
BITS = 40

_SHAPE = np.array([97 if chr(b).islower() or b >= 128 else 65 if chr(b).isupper() else 48 if chr(b).isdigit() else b for b in range(256)], np.uint8)


def sketches(texts: pa.StringArray, n: int = SKETCHES) -> np.ndarray:
    """For each text ``n`` min-hashes of its runs of five words (of its words, where fewer)."""
    found = words(texts, LETTERS, FOLD)
    gram = found.hashes()
    h = gram.copy()
    for k in range(1, min(5, len(h))):
        gram[: len(h) - k] = pair(gram[: len(h) - k], h[k:])
    last = found.n[found.rows] - (np.arange(len(h)) - found.first[found.rows])
    whole = (last >= 5) | (found.n[found.rows] < 5)
    out = np.full((len(texts), n), np.uint64(0xFFFFFFFFFFFFFFFF))
    if whole.any():
        owner, value = found.rows[whole], gram[whole]
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        for k in range(n):
            out[owner[cuts], k] = np.minimum.reduceat(mix(value ^ mix(np.uint64([k + 1]))), cuts)
    return out


def features(texts: pa.StringArray, shapes: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs as they come, a feature of a text perhaps more than once: each word,
    and each of its beginnings of ``STEMS`` bytes that is shorter than the word."""
    n = len(texts)
    found = words(texts, LETTERS, FOLD)
    rows, ids = [found.rows], [found.hashes() >> np.uint64(64 - BITS)]
    long, begin = found.ends - found.starts, found.beginnings()
    for k in STEMS:
        has = np.flatnonzero(long > k)
        rows.append(found.rows[has])
        ids.append(mix((begin[has] & np.uint64((1 << 8 * k) - 1)) ^ np.uint64(0x5EED << 48 ^ k)) >> np.uint64(64 - BITS))
    if shapes:
        tokens = words(texts, NOT_SPACE)
        kind = _SHAPE[tokens.raw]
        keep = np.ones(len(kind), bool)
        keep[1:] = kind[1:] != kind[:-1]
        keep[tokens.starts] = True
        inside = np.zeros(len(kind) + 1, np.int64)
        np.add.at(inside, tokens.starts, 1)
        np.add.at(inside, tokens.ends, -1)
        keep &= np.cumsum(inside[:-1]) > 0
        at = np.cumsum(keep) - keep
        tokens.raw, tokens.starts, tokens.ends = kind[keep], at[tokens.starts], at[tokens.ends - 1] + keep[tokens.ends - 1]
        shape = tokens.hashes(seed=1)
        order = np.lexsort((shape, tokens.rows))
        r, s = tokens.rows[order], shape[order]
        new = np.flatnonzero((np.diff(r, prepend=-1) != 0) | np.concatenate([[True], s[1:] != s[:-1]])) if len(r) else np.zeros(0, np.int64)
        count = np.diff(new, append=len(r))
        share = np.floor(np.log2(count / np.maximum(tokens.n[r[new]], 1)) + 1e-9) if len(new) else np.zeros(0)
        for step in range(5):  # "at least a half, a quarter, ... of the words have this shape"
            has = share >= -1 - step
            rows.append(r[new][has])
            ids.append(pair(s[new][has], np.full(int(has.sum()), step, np.uint64)) >> np.uint64(64 - BITS))
        size = np.floor(np.log2(np.maximum(tokens.n, 1))).astype(np.uint64)
        rows.append(np.arange(n))
        ids.append(mix(size + np.uint64(1 << 50)) >> np.uint64(64 - BITS))
    return np.concatenate(rows), np.concatenate(ids).astype(np.int64)


def distinct(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = (np.diff(row, prepend=-1) != 0) | (np.diff(feature, prepend=-1) != 0)
    return row[new], feature[new]


@dataclass
class Model:
    ids: np.ndarray  # features, ascending
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; as many as grades above the lowest
    shapes: bool = False

    def tails(self, texts: pa.StringArray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each text."""
        score = np.zeros(len(texts))
        if len(self.ids):
            row, feature = features(texts, self.shapes)
            few = np.zeros(1 << 16, bool)
            few[self.ids & 0xFFFF] = True
            maybe = np.flatnonzero(few[feature & 0xFFFF])
            row, feature = distinct(row[maybe], feature[maybe])
            at = np.minimum(np.searchsorted(self.ids, feature), len(self.ids) - 1)
            hit = self.ids[at] == feature
            score = np.bincount(row[hit], weights=self.weights[at[hit]], minlength=len(texts))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit(x: np.ndarray, grade: np.ndarray, grades: int, rounds: int = 200, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds for dense 0/1 ``x``: L-BFGS on the penalised likelihood. Gaps
    between thresholds stay positive, as their logarithms are fitted."""
    n, d = x.shape
    share = np.array([(grade >= k).mean() if n else 0.5 for k in range(1, grades)])
    share = np.clip(share, 1e-3, 1 - 1e-3)
    theta = -np.log(share / (1 - share))
    edge = np.arange(n)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, gaps = p[:d], np.exp(np.clip(p[d + 1 :], -20, 20))
        theta = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = 1 / (1 + np.exp(np.clip(theta[None, :] - (x @ w)[:, None], -60, 60)))
        tail = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], axis=1)
        slope = tail * (1 - tail)
        prob = np.maximum(tail[edge, grade] - tail[edge, grade + 1], 1e-12)
        by_score = -(slope[edge, grade] - slope[edge, grade + 1]) / prob / max(n, 1)
        by_theta = np.bincount(grade, weights=slope[edge, grade] / prob, minlength=grades + 1) - np.bincount(grade + 1, weights=slope[edge, grade + 1] / prob, minlength=grades + 1)
        below = np.cumsum(by_theta[1:grades][::-1])[::-1] / max(n, 1)
        return -np.log(prob).mean() + l2 / 2 * w @ w if n else 0.0, np.concatenate([x.T @ by_score + l2 * w, below[:1], below[1:] * gaps])

    p = np.concatenate([np.zeros(d), theta[:1], np.log(np.maximum(np.diff(theta), 0.05))])
    value, g = loss(p)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds if n else 0):
        q, marks = g.copy(), []
        for s, y in reversed(past):
            marks.append((s @ q) / (s @ y))
            q -= marks[-1] * y
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), m in zip(past, reversed(marks), strict=True):
            q += (m - (y @ q) / (s @ y)) * s
        step = 1.0 if past else 1.0 / max(1.0, np.abs(g).sum())
        while step > 1e-10:
            after, g_after = loss(p - step * q)
            if after <= value - 1e-4 * step * (g @ q):
                break
            step /= 2
        else:
            break
        s, y = -step * q, g_after - g
        done = value - after < 1e-9
        p, value, g = p + s, after, g_after
        if s @ y > 1e-12:
            past = [*past[-9:], (s, y)]
        if done:
            break
    return p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(p[d + 1 :], -20, 20)))])


def train(docs: DataFrame, labels: DataFrame, up: bool, key: str = "doc_id", text: str = "text", fault: str = "fault", shapes: bool = False, most_labelled: int = MOST_LABELLED, least_ratio: float = 25.0) -> Model:
    """Fit on at most ``most_labelled`` rows of ``labels`` (key, fault 0 or 1).

    The labels say whether, not how much; how much is the evidence: of the rows with the fault,
    those with at least the median number of features that go with it are grade 2, the others
    grade 1, and rows without it grade 0. With ``up`` false the scale is turned round (2 is
    without the fault). Rows with a null key or label are passed over; a key that is labelled
    more than once counts with the highest. Without labelled rows every text gets base odds."""
    grades = 3
    chosen = labels.where(F.col(key).isNotNull() & F.col(fault).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(fault).cast("int").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64("key"), "key").limit(most_labelled)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = strings(batch.column(1))
            row, feature = distinct(*features(texts, shapes))
            sketch = sketches(texts)
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(np.arange(0, sketch.size + 1, SKETCHES, dtype=np.int32)), pa.array(sketch.view(np.int64).ravel())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature))], names=["key", "grade", "sketch", "features"])

    kind = docs.schema[key].dataType.simpleString()
    # (of rows that repeat an id one, so that the sample is bounded; the broadcast is of most_labelled rows)
    rows = docs.select(column(key).alias("key"), column(text).cast("string").alias("text")).join(F.broadcast(chosen), "key").groupBy("key").agg(F.max("text").alias("text"), F.max("grade").alias("grade"))
    rows = rows.mapInArrow(eased(hashed), f"key {kind}, grade int, sketch array<bigint>, features array<bigint>")
    sample = rows.toArrow().combine_chunks() if hasattr(rows, "toArrow") else pa.Table.from_pandas(rows.toPandas())
    sample = sample.sort_by([("key", "ascending")])
    # a text that shares a sketch with one before it is a copy, whose words would count twice
    seen: set[int] = set()
    once = []
    for i, marks in enumerate(sample["sketch"].to_pylist()):
        if seen.isdisjoint(marks):
            once.append(i)
        seen.update(marks)
    sample = sample.take(pa.array(once, pa.int64()))
    bad = sample["grade"].to_numpy() > 0
    lists = sample["features"].combine_chunks()
    n = len(bad)
    per = np.diff(lists.offsets.to_numpy()) if n else np.zeros(0, np.int64)
    ids, of = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    row = np.repeat(np.arange(n), per)
    # likelihood ratio of "faulty as often as all rows are" against what was seen
    have = np.bincount(of, minlength=len(ids)).astype(float)
    base = min(max(bad.mean(), 1 / (n + 1)), n / (n + 1)) if n else 0.5
    with_fault = np.bincount(of, weights=bad[row], minlength=len(ids))
    without = have - with_fault
    ratio = np.zeros(len(ids))
    for seen, share in ((with_fault, base), (without, 1 - base)):
        ratio += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(have * share, 1e-9)), 0)
    speaks = (ratio >= least_ratio) & (with_fault > base * have)
    evidence = np.bincount(row, weights=speaks[of], minlength=n)
    some = evidence[bad & (evidence > 0)]
    severity = np.where(bad, np.where(evidence >= (np.median(some) if len(some) else 1), 2, 1), 0)
    y = severity if up else 2 - severity
    chosen_ids = np.flatnonzero(ratio >= least_ratio)
    chosen_ids = chosen_ids[np.argsort(-ratio[chosen_ids], kind="stable")[:MOST_FEATURES]]
    chosen_ids.sort()
    x = np.zeros((n, len(chosen_ids)))
    at = np.minimum(np.searchsorted(chosen_ids, of), max(len(chosen_ids) - 1, 0))
    if len(chosen_ids):
        hit = chosen_ids[at] == of
        x[row[hit], at[hit]] = 1
    weights, thresholds = fit(x, y, grades)
    used = np.flatnonzero(weights)
    return Model(ids[chosen_ids][used], weights[used], thresholds, shapes)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """``key``, expected (grade) and tail (array of P(grade >= k)) of every row; with ``keep``
    all columns of the input instead of the key alone."""
    columns = docs.columns if keep else [key]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            tails = np.round(model.tails(strings(batch.column(batch.num_columns - 1))), 6)
            ends = np.arange(0, tails.size + 1, tails.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.round(tails.sum(axis=1), 6)), pa.ListArray.from_arrays(pa.array(ends), pa.array(tails.ravel()))], names=[*batch.schema.names[:-1], "__expected", "__tail"])

    # clashing names of the input are safe: only numbered columns go through the worker
    sent = docs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(columns)], column(text).cast("string").alias("__text"))
    fields = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    out = sent.mapInArrow(eased(scored), f"{fields}, __expected double, __tail array<double>")
    return out.toDF(*columns, fresh(columns, "__expected"), fresh(columns, "__tail"))
