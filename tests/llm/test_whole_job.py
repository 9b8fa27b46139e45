"""Cases that cuts of the work once left out, held against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from itertools import combinations

import pyarrow as pa

from tactigrid.llm import linejoin, minhash, spotsigs


def near_copies(seed: int, n: int, edits: int = 7, length: int = 200) -> list[tuple[int, str]]:
    """Copies of one text with some words replaced: pairs around a similarity of 0.8."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = [f"w{k}" for k in range(length)]
        for _ in range(edits):
            t[rng.randrange(length)] = f"n{rng.randint(0, 10**9)}"
        out.append((i, " ".join(t)))
    return out


def links(rows: list[tuple[int, str]]) -> set[tuple[int, int]]:
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in rows}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}


def components(spark, rows: list[tuple[int, str]]) -> dict[int, int]:
    return {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()}


def test_links_in_small_buckets_are_found(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS_UP_TO", 28)
    rows = near_copies(6, 120)
    buckets = defaultdict(list)
    for i, t in rows:
        for k in minhash.band_keys(minhash.signatures(*minhash.shingle_sets(pa.array([t]), 2)))[0].tolist():
            buckets[k].append(i)
    true = links(rows)
    meet = {p for own in buckets.values() if len(own) <= 28 for p in combinations(sorted(own), 2)} & true
    got = components(spark, rows)
    assert meet and not [p for p in meet if got[p[0]] != got[p[1]]]


def test_large_groups_of_near_copies(spark):
    rows = near_copies(2, 300)
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links(rows):
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    assert components(spark, rows) == {i: top(i) for i in root}


def test_blocks_cover_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS_UP_TO", 3)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rows = near_copies(8, 60)
    got = components(spark, rows)
    assert all(got[a] == got[b] for a, b in links(rows))


def test_short_lines_are_deduplicated(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    lines = ["Les.", "Read more", "read more", "more Read", "one two three", "three two one", "a b c d", "a b c d e", "", " "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(4)) + f"\nown{i}") for i in range(40)] + [(40, "Les."), (41, None), (42, " ")]
    earlier: list[set] = []
    want = {}
    for i, t in rows:
        keep = []
        for line in (t or "").split("\n"):
            s = set(line.split())
            if not any(s and 100 * len(s & o) >= 80 * len(s | o) for o in earlier):
                keep.append(line)
            earlier.append(s)
        want[i] = "\n".join(keep)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.kept_sha256 for r in linejoin.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    stage = {r.doc_id: r.text or "" for r in corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)).collect()}
    assert stage == {i: t for i, t in want.items() if t.strip() or not (dict(rows)[i] or "").strip()}


def test_near_pairs_at_the_threshold(spark):
    text = lambda k: " ".join(f"the w{i} v{i}" for i in range(k))
    d = spark.createDataFrame([(1, text(28)), (2, text(35))], "doc_id bigint, text string")
    assert [(r.a, r.b, r.likeness) for r in spotsigs.near_pairs(d).collect()] == [(1, 2, 0.8)]
