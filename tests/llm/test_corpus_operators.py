"""Operators across texts, held against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tactigrid.llm import linejoin, minhash, recompress, winnow

DOCS = "doc_id bigint, text string, id string, line int"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed: int, n: int = 60, vocabulary: int = 60) -> list[tuple]:
    """Texts with copies, near copies, shared passages, runs, short and odd ones."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % vocabulary}"
    passage = [f"p{rng.randint(0, 500)}" for _ in range(55)]
    out: list[str | None] = [None, "", " \n ", "one", "one two", "é ß", "run " * 70, "ab ab " * 40, "\n".join(["same line of some words here"] * 3)]
    while len(out) < n:
        kind = rng.random()
        if kind < 0.2 and len(out) > 12:
            out.append(rng.choice(out[9:]))
        elif kind < 0.5 and len(out) > 12:
            t = (rng.choice(out[9:]) or "").split(" ")
            for _ in range(rng.randint(1, 4)):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
        else:
            t = [word() + ("\n" if rng.random() < 0.1 else "") for _ in range(rng.randint(1, 150))]
            if rng.random() < 0.4:
                at = rng.randrange(len(t))
                t[at:at] = passage
            out.append(" ".join(t))
    return [(i * 3, t, "clash", 7) for i, t in enumerate(out)]


def tokens(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module", params=[1, 2, 3])
def rows(request):
    return corpus(request.param, vocabulary=[12, 60, 400][request.param - 1])


@pytest.mark.parametrize("window", [20, 12])
def test_repeats_are_exactly_the_windows_that_start_earlier(spark, rows, window):
    seen: set = set()
    want = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = tokens(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if g in seen:
                gone[k : k + window] = [True] * window
            seen.add(g)
        kept = " ".join(x for x, z in zip(w, gone, strict=True) if not z)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    got = recompress.remove_repeats(spark.createDataFrame(rows, DOCS), window, gram=min(9, window - 6), high=6)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got.collect()} == want


def test_settled_boundaries_do_not_depend_on_context():
    rng = np.random.default_rng(4)
    inner = rng.integers(0, 3, 40).astype(np.uint64)
    names = []
    for _ in range(12):
        left, right = (rng.integers(0, 3, rng.integers(0, 30)).astype(np.uint64) for _ in range(2))
        h = np.concatenate([left, inner, right])
        first = np.zeros(len(h), bool)
        first[0] = True
        _, place, low, high = recompress.rounds(recompress.mix(h + np.uint64(5)), first, 3)
        settled = (low >= len(left)) & (high <= len(left) + 40)
        names.append((set((place[settled] - len(left)).tolist()), set((place - len(left)).tolist())))
    for settled, _ in names:
        for _, places in names:
            assert settled <= places


@pytest.mark.parametrize("first_run", [{}, {"wide": 1, "room": 0, "best": 1}])
def test_line_dedup(spark, rows, first_run):
    earlier: list[frozenset] = []
    want = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        keep = []
        for line in (t or "").split("\n"):
            s = frozenset(x.encode() for x in tokens(line))
            hit = s and any(100 * len(s & o) >= 80 * len(s | o) for o in earlier)
            earlier.append(s)
            if not hit:
                keep.append(line)
        want[i] = "\n".join(keep)
    got = linejoin.dedup_lines(spark.createDataFrame(rows, DOCS), **first_run).collect()
    assert {r.doc_id: r.text or "" for r in got} == want
    assert all(r.id == "clash" and r.line == 7 for r in got) and next(r.text for r in got if r.doc_id == 0) is None
    assert all(r["emptied"] == (r["n_removed"] > 0 and not r.text.strip()) for r in got if r.text is not None)


def test_winnowing(spark, rows):
    rng = random.Random(11)
    long = [tokens(t) for _, t, *_ in rows if t and len(tokens(t)) > 40]
    items = [(k, " ".join(w[5 : 5 + rng.randint(8, 30)]).upper()) for k, w in enumerate(long[:14])] + [(100, "one two"), (101, None), (102, "!!"), (103, "w1"), (104, "never seen " * 6)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
    want = {}
    for i, t, *_ in rows:
        w, hit, ids = words(t), set(), set()
        for k, it in items:
            v = words(it)
            m = min(10, len(v))
            grams = {tuple(v[a : a + m]) for a in range(len(v) - m + 1)} if m else set()
            for a in range(len(w) - m + 1 if m else 0):
                if tuple(w[a : a + m]) in grams:
                    hit.update(range(a, a + m))
                    ids.add(str(k))
        want[i] = (len(w), len(hit), sorted(ids))
    d = spark.createDataFrame(rows, DOCS)
    got = winnow.decontaminate(d.union(d.where("doc_id = 9")), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in got} == want and len(got) == len(rows) + 1
    assert winnow.decontaminate(d, spark.createDataFrame([], "item_id bigint, text string")).where("contaminated").count() == 0
    many = winnow.MOST_BROADCAST
    winnow.MOST_BROADCAST = 0  # the way without a broadcast
    try:
        got = winnow.decontaminate(d, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    finally:
        winnow.MOST_BROADCAST = many
    assert {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in got} == want


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, rows, width):
    sets = {}
    for i, t, *_ in rows:
        w = tokens((t or "").translate(UP))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS_UP_TO", 3)
    monkeypatch.setattr(minhash, "CHUNK", 2)
    rows = corpus(5, 50, 400)
    d = spark.createDataFrame(rows, DOCS)
    small = {r.doc_id: r.component_id for r in minhash.near_duplicates(d, 2).collect()}
    monkeypatch.undo()
    assert small == {r.doc_id: r.component_id for r in minhash.near_duplicates(d, 2).collect()}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in minhash.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(i, i) == top(i) for i in root)


def test_empty_tables_and_repeated_rows(spark):
    none = spark.createDataFrame([], DOCS)
    assert recompress.remove_repeats(none).count() == linejoin.dedup_lines(none).count() == minhash.near_duplicates(none).count() == 0
    t = "some words that are here for a while and then again some words"
    twice = spark.createDataFrame([(1, t, "a", 1), (1, t, "a", 1), (2, t, "b", 2)], DOCS)
    assert sorted((r.doc_id, r.kept) for r in minhash.near_duplicates(twice).collect()) == [(1, True), (1, True), (2, False)]
    assert sorted((r.doc_id, r["n_removed"]) for r in linejoin.dedup_lines(twice).collect()) == [(1, 0), (1, 0), (2, 1)]
    assert sorted((r.doc_id, r.n_removed) for r in recompress.remove_repeats(twice, 10).collect()) == [(1, 0), (1, 0), (2, 13)]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    clean = [" ".join(f"c{rng.randint(0, 3000)}" for _ in range(120)) for _ in range(60)]
    item = " ".join(f"b{k}" for k in range(25))
    docs, labels = [], []
    for i, t in enumerate(clean):
        docs.append((i, t))
        labels.append((i, 1, 0))
    for i in range(20):
        docs.append((100 + i, f"{clean[i]} vile nasty horrid z{i}"))
        labels.append((100 + i, 1, 1))
    docs += [(200, clean[30]), (201, clean[31] + " tail"), (202, clean[0][:200] + " " + item), (203, None), (204, "")]
    out = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    left = {r.doc_id for r in corpus_pipeline.run(spark, out).collect()}
    assert left == set(range(60)) | {203, 204}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
