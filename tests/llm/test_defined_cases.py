"""Nulls, clashing names, empty tables, ties and the queries' SQL, each with its defined result."""

from __future__ import annotations

import hashlib
import random
import re
from math import floor

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tactigrid.llm import linejoin, minhash, ordinal, packing, quality, recompress, registry, spotsigs, toxicity, url_filter, winnow
from tactigrid.llm.textkit import FOLD, LETTERS, words

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def of_documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def repeats_by_hand(rows, window=20):
    """(n_words, n_removed) by document id, with windows judged on the input."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if g in seen:
                gone[k : k + window] = [True] * window
            seen.add(g)
        out[i] = (len(w), sum(gone))
    return out


def runs(seed, n):
    """Documents of few words with runs, templates and shared passages, many ending inside one."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        few = rng.choice([2, 3, 5])
        base = [random.Random(f"{i // 4} {k}").randrange(few) for k in range(60)]
        d = []
        while len(d) < rng.randint(20, 60):
            kind = rng.random()
            if kind < 0.35:
                d += [rng.randrange(few)] * rng.randint(1, 12)
            elif kind < 0.75:
                at = rng.randrange(60)
                d += base[at : at + rng.randint(5, 40)]
            else:
                d.append(rng.randrange(few))
        out.append((i, " ".join(f"v{i // 4}x{x}" for x in d)))
    return out


def test_repeats_at_the_end_of_a_text(spark):
    one = "0 3 1 3 1 2 3 1 1 4 4 4 2 2 3 3 4 4 4 4 4 4 1 1 4"
    two = "2 3 1 1 4 4 4 2 2 3 3 4 4 4 4 4 4 1 1 4 4 4 4 4 4"
    rows = [(1098, " ".join(f"v549x{x}" for x in one.split())), (1099, " ".join(f"v549x{x}" for x in two.split())), *runs(3, 900)]
    got = recompress.remove_repeats(of_documents(spark, rows), texts=False).collect()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got} == repeats_by_hand(rows)
    assert repeats_by_hand(rows)[1099] == (25, 20)


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_windows_have_equal_anchors(seed):
    rows = runs(seed, 6000)
    found = words(pa.array([t for _, t in rows]))
    h = found.hashes()
    for window, gram in ((20, 9), (12, 6)):
        where, _ = recompress.anchors(h, found, recompress.starts(found), window, gram, 2)
        seen: dict = {}
        for i in np.flatnonzero(recompress.left_in_text(found) >= window).tolist():
            at = -1 if where[i] < 0 else int(where[i]) - i
            assert seen.setdefault(h[i : i + window].tobytes(), at) == at


def test_null_ids_other_kinds_of_ids_and_clashing_names(spark):
    t = "\n".join(f"line {k} " + " ".join(f"w{k}x{j}" for j in range(12)) for k in range(4))
    rows = [(None, t), (None, t), (5, t), (3, t), (7, None), (8, "")]
    d = of_documents(spark, rows)
    got = recompress.remove_repeats(d, texts=False).collect()
    n = len(t.split())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in got) == [(False, 0, 0), (False, 0, 0), (True, 3, 0), (True, 5, n), (True, 7, 0), (True, 8, 0)]
    got = linejoin.dedup_lines(d).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in got) == [(False, 0, 0), (False, 0, 0), (True, 3, 0), (True, 5, 4), (True, 7, 0), (True, 8, 0)]
    assert {r.doc_id: r.text for r in got}[7] is None
    got = minhash.near_duplicates(d, 2).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (3, 3, True), (5, 3, False), (7, 7, True), (8, 8, True)]
    items = spark.createDataFrame([(1, " ".join(t.split()[:14])), (None, "one two three " * 5)], "item_id bigint, text string")
    got = winnow.decontaminate(d, items).collect()
    assert sorted((r.doc_id or 0, r.n_hit) for r in got) == [(0, 14), (0, 14), (3, 14), (5, 14), (7, 0), (8, 0)]
    # ids that are strings, in their order; names that the results use too
    named = d.where("doc_id is not null").select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("doc_id"), "text", F.lit(1).alias("N_Removed"), F.lit(2).alias("emptied"), F.lit(3).alias("__id"), F.lit(4).alias("a.b"))
    got = linejoin.dedup_lines(named)
    assert got.columns == [*named.columns, "n_lines", "n_removed_", "emptied_"]
    assert sorted((r.doc_id, r["n_removed_"], r["N_Removed"], r["emptied"], r["a.b"]) for r in got.collect()) == [("k3", 0, 1, 2, 4), ("k5", 4, 1, 2, 4), ("k7", 0, 1, 2, 4), ("k8", 0, 1, 2, 4)]
    assert sorted((r.doc_id, r.n_removed) for r in recompress.remove_repeats(named, texts=False).collect()) == [("k3", 0), ("k5", n), ("k7", 0), ("k8", 0)]
    assert sorted((r.doc_id, r.kept) for r in minhash.near_duplicates(named, 2).collect()) == [("k3", True), ("k5", False), ("k7", True), ("k8", True)]


def test_clashing_names_of_scores_and_rules(spark):
    d = spark.createDataFrame([(1, "some text", True, 0.5, "x", "com")], "doc_id bigint, text string, rejected boolean, p_good double, selected string, host string")
    empty = ordinal.Model(np.zeros(0, np.int64), np.zeros(0), np.array([1.0, 2.0]))
    got = toxicity.toxicity(d, empty, keep=True)
    assert got.columns == [*d.columns, "expected_severity", "p_toxic", "p_severe", "rejected_"] and got.first().rejected is True
    got = quality.quality(d, empty, keep=True)
    assert got.columns == [*d.columns, "expected_rating", "p_fair", "p_good_", "selected_"]
    got = url_filter.filter_urls(d.withColumn("url", F.lit("http://A.com/x")), url_filter.RULES)
    assert got.columns == [*d.columns, "url", "host_", "path", "rule", "verdict"]
    r = got.first()
    assert (r.host, r["host_"], r.path, r.rule, r.verdict) == ("com", "a.com", "/x", "com/", "allow")
    assert url_filter.filter_urls(d.withColumn("url", F.lit(None).cast("string")), []).first().verdict == "allow"


def test_empty_tables(spark):
    none = of_documents(spark, [])
    items = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert winnow.decontaminate(none, items).count() == 0
    assert quality.quality(none, quality.train_quality(none, labels)).count() == 0
    P = pytest.importorskip("public_tokenizers")
    assert packing.pack(none, P.path("byte_bpe_50k.json")).count() == 0


def test_the_pipeline_of_an_empty_table_and_of_null_ids(spark, tmp_path):
    import corpus_pipeline

    t = " ".join(f"word{k}" for k in range(30))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(12)))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    d = of_documents(spark, [(None, t), (None, t), (4, t), (2, t), (2, t)])
    got = stages["near_dedup"](spark, d, str(tmp_path))
    assert got.columns == d.columns and sorted((r.doc_id or 0) for r in got.collect()) == [0, 0, 2]
    got = stages["decontamination"](spark, d, str(tmp_path))
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 0, 2, 2, 4]
    of_documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_sql_gives_the_same(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "the", "Run", "x1", "été", "É", "w2", "w3", "go"])
    rows = [(i, t) for i, t in runs(8, 60)] + [(100 + i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(30)] + [(200, None), (201, "")]
    of_documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    items = [(k, " ".join(t.split()[3 : 3 + rng.randint(2, 25)])) for k, t in enumerate(texts[::6])] + [(90, None), (91, "É é")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    urls = ["http://www.Example.com/en/x?q#f", "https://a.net/es/1", "b.net/fr/", "ftp://net/fr/", "://", "http://example.com", None, "x://EXAMPLE.com/en/", "http://a.example.com/en/#", "http://com/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark", "pages"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name, sql in registry.ORACLES.items():
        want = db.sql(sql)
        got = registry.QUERIES[name](spark, str(tmp_path))
        columns = sorted(want.columns)
        assert columns == sorted(got.columns), name
        assert sorted(map(str, got.select(*columns).toPandas().itertuples(index=False, name=None))) == sorted(map(str, want.select(*columns).df().itertuples(index=False, name=None))), name


def spots_by_hand(text):
    words = " ".join(re.findall(r"[^\W_]+", text.lower()))
    anchors, out, chain = set(spotsigs.COMMON), [], []
    parts, seen = [], None
    for w in words.split():
        if w in anchors:
            if seen is not None:
                parts.append(seen)
            seen = []
        elif seen is not None:
            seen.append(w)
    if seen is not None:
        parts.append(seen)
    parts = [p for p in parts if p]
    for i, p in enumerate(parts):
        chain = [w for q in parts[i : i + spotsigs.CHAIN] for w in q][: spotsigs.CHAIN]
        out.append(" ".join(chain))
    return set(out) if parts else {words} if words else set()


def test_spot_signatures_of_edited_texts(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "a", "of", "der", "que", "river", "stone", "blue", "Öl", "élan", "x", "tree", "runs"])
    texts = [" ".join(word() for _ in range(rng.randint(0, 50))) for _ in range(30)] + ["", None, "the the", "👍 the sun", "same the old words"] * 2
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    of_documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in spotsigs.op10_spotsigs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = floor(len(t) / 2)
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own = spots_by_hand(t)
        assert len(r.fingerprint) == 8 * len(own) and len(r.edited_fingerprint) == 8 * len(spots_by_hand(edited))
        assert r.near_edited == pytest.approx(like(own, spots_by_hand(edited))) and r.near_next == pytest.approx(like(own, spots_by_hand(after)))
    for (i, t), (j, u) in [(a, b) for a in rows for b in rows if (a[1] or "") == (b[1] or "")]:
        assert got[i].fingerprint == got[j].fingerprint


def test_scores_are_the_models_on_held_out_rows(spark):
    rng = random.Random(6)
    bad = ["vile", "nasty", "horrid", "filthy"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        t = [f"c{rng.randrange(400)}" for _ in range(rng.randint(20, 60))]
        if toxic:
            for w in rng.sample(bad, rng.choice([1, 3])):
                t[rng.randrange(len(t))] = w
        rows.append((i, " ".join(t)))
        labels.append((i, 1 - int(toxic), int(toxic)))
    d, marks = of_documents(spark, rows[:450]), spark.createDataFrame(labels[:450], "doc_id bigint, quality int, toxic int")
    held = of_documents(spark, [*rows[450:], (450, rows[450][1]), (9000, None), (9001, "vile " * 100_000)])
    model = toxicity.train_toxicity(d, marks)
    got = toxicity.toxicity(held, model).collect()
    assert len(got) == 153
    by = {r.doc_id: r for r in got}
    assert sum(by[i].rejected == (i % 3 == 0) for i in range(450, 600)) >= 145
    assert by[9000].rejected is False and by[9001].rejected is True
    weight = dict(zip(model.ids.tolist(), model.weights.tolist(), strict=True))
    for i, t in rows[450:480]:
        found = words(pa.array([t]), LETTERS, FOLD)
        own = set(ordinal.features(pa.array([t]), False)[1].tolist())
        assert found.n[0] and by[i].p_toxic >= by[i].p_severe
        s = sum(weight.get(f, 0.0) for f in own)
        tails = [1 / (1 + np.exp(t - s)) for t in model.thresholds]
        assert by[i].p_toxic == pytest.approx(tails[0], abs=2e-6) and by[i].p_severe == pytest.approx(tails[1], abs=2e-6) and by[i].expected_severity == pytest.approx(sum(tails), abs=4e-6)
    scored = {r.doc_id: r for r in quality.quality(held, quality.train_quality(d, marks)).collect()}
    assert sum(scored[i].selected == (i % 3 != 0) for i in range(450, 600)) >= 145
    assert all(0 <= r.p_good <= r.p_fair <= 1 and r.expected_rating == pytest.approx(r.p_good + r.p_fair, abs=2e-6) for r in scored.values())
