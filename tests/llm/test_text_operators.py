"""Operators on single texts: tokens, packing, classifiers, URLs, fingerprints."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tactigrid.llm import bpe, ordinal, packing, quality, spotsigs, token_counts, toxicity, url_filter

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, text2 string, key int"

PIECES = [" ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "a", "word", "Word's", "'ll", "123", "٣", "é", "ß", "漢字", " ", "　", "<|endoftext|>", "<|", "!!", "...", "€", "“q”", "\x1c", "\x0b", "​", "👍🏽", "Ωμ", "²", "\x00", "x" * 90]


def texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["", " ", "\n", " a", "a "] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts(60, 7))] + [(900, None, None, None), (900, None, None, None), (901, "long words here, " * 20_000, "x", 2), (None, "no id", "y", 3)]
    return spark.createDataFrame(rows, DOCS)


def test_units_give_the_librarys_ids():
    e = bpe.Encoder(VOCABULARY)
    assert e.fast is not None
    some = texts(1500, 1)
    want = [x.ids for x in e.library.encode_batch(some, add_special_tokens=False)]
    counts, ids = e.encode(pa.array(some))
    at = np.cumsum(counts) - counts
    assert [ids[a : a + n].tolist() for a, n in zip(at, counts, strict=True)] == want
    assert (e.encode(pa.array(some), False)[0] == counts).all()


def test_a_small_store_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_UNITS", 50)
    e = bpe.Encoder(VOCABULARY)
    for seed in range(5):
        some = texts(40, seed)
        assert e.encode(pa.array(some), False)[0].tolist() == [len(x.ids) for x in e.library.encode_batch(some, add_special_tokens=False)]


def test_segments_are_safe():
    text = "abc def, ghi " * 20_000 + "x" * 200_000
    parts = bpe.segments(text)
    assert "".join(parts) == text and len(parts) > 2
    lib = bpe.encoder(VOCABULARY).library
    assert [i for p in parts for i in lib.encode(p, add_special_tokens=False).ids] == lib.encode(text, add_special_tokens=False).ids


def test_token_counts(spark, docs):
    lib = bpe.encoder(VOCABULARY).library
    got = token_counts.count_tokens(docs, VOCABULARY)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got.collect())
    assert token_counts.count_tokens(docs.limit(0), VOCABULARY).count() == 0


def test_packing_round_trip(spark, docs):
    lib = bpe.encoder(VOCABULARY).library
    rows = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), VOCABULARY).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for d in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        own = sorted((r for r in rows if r.doc_id == d.doc_id), key=lambda r: r.start)
        ids = lib.encode(d.text or "", add_special_tokens=False).ids + [0]
        assert [i for r in own for i in r.ids] == ids
        assert all(r.offset == 0 and r.length == len(r.ids) and r.length & (r.length - 1) == 0 and r.length <= 1024 and r.doc_tokens == len(ids) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
        assert len([r for r in own if r.length < 1024]) == bin(len(ids) % 1024).count("1")


def test_classifiers_learn_words_and_keep_the_rest(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    rows, labels = [], []
    for i in range(500):
        bad = i % 5 == 0
        own = [rng.choice(words) for _ in range(60)] + (["vile", "nasty"] if bad else [])
        rows.append((i, " ".join(own), "x", 1))
        if i < 300:
            labels.append((i, 1, int(bad)))
    rows += [(1000, None, None, None), (1001, "", None, None), (1002, "VILE nasty", None, None)]
    d = spark.createDataFrame(rows, DOCS)
    model = toxicity.train_toxicity(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.toxicity(d, model, keep=True).collect()}
    assert len(got) == len(rows) and set(docs_columns := list(next(iter(got.values())).asDict())) >= {"text2", "key", "expected_severity"}, docs_columns
    held = [i for i in range(300, 500)]
    assert all(got[i].rejected == (i % 5 == 0) for i in held)
    assert got[1002].rejected and not got[1000].rejected and not got[1001].rejected
    assert all(abs(r.expected_severity - r.p_toxic - r.p_severe) < 1e-5 and r.p_toxic >= r.p_severe for r in got.values())
    empty = toxicity.train_toxicity(d, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert toxicity.toxicity(d, empty).count() == len(rows)
    assert toxicity.toxicity(d.limit(0), model).count() == 0


def test_quality_uses_shapes(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        own = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
        rows.append((i, " ".join(w + "%%%" for w in own) if i % 4 == 0 else " ".join(own), "x", 1))
        if i < 250:
            labels.append((i, int(i % 4 != 0), 0))
    d = spark.createDataFrame(rows, DOCS)
    model = quality.train_quality(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = {r.doc_id: r.selected for r in quality.quality(d, model).collect()}
    assert all(got[i] == (i % 4 != 0) for i in range(250, 400))


def test_ordinal_fit_orders_thresholds():
    rng = np.random.default_rng(0)
    x = (rng.random((600, 4)) < 0.4).astype(float)
    score = x @ np.array([2.0, -1.0, 0.5, 0.0]) + rng.logistic(size=600)
    y = (score > 0).astype(int) + (score > 2).astype(int)
    w, t = ordinal.fit(x, y, 3)
    assert t[0] < t[1] and w[0] > 1 and w[1] < 0 and abs(w[3]) < 0.6


def test_urls(spark):
    urls = ["http://a.example.com/en/1", "HTTP://www.EXAMPLE.com/en/x?y", "https://x.net/es/1#t", "http://x.net", None, "no scheme", "http://net/fr/", "http://notexample.com/en/", "http://b.org?x/en/", "http://" + "a." * 5000 + "net/es/" + "p/" * 5000, "http://x.net/es/1"]
    rows = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(0, urls[0], "h", "r")], "page_id bigint, url string, host string, rule string")
    got = url_filter.filter_urls(rows, url_filter.RULES).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(urls) + 1
    assert [by[i].verdict for i in range(11)] == ["block", "allow", "block", "allow", "allow", "allow", "block", "allow", "allow", "block", "block"]
    assert by[1].host == "www.example.com" and by[1].rule == "www.example.com/en/" and by[3].path == "" and by[4].host == "" and by[7].rule == "com/"
    assert {r.verdict for r in url_filter.filter_urls(rows, []).collect()} == {"allow"}
    assert url_filter.filter_urls(rows.limit(0), url_filter.RULES).count() == 0


def test_url_rules_against_brute_force(spark):
    rng = random.Random(2)
    rules = [(rng.choice(["a.b", "b", "x.a.b", "c"]), rng.choice(["/", "/p", "/p/q", ""]), rng.choice(["allow", "block"])) for _ in range(12)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = ["http://" + rng.choice(["a.b", "x.a.b", "b", "c", "y.c", "ab", "z"]) + rng.choice(["", "/", "/p", "/p/q", "/pq", "/x"]) for _ in range(80)]
    got = {r.i: r.rule for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "i int, url string"), rules).collect()}
    for i, u in enumerate(urls):
        host, _, path = u[7:].partition("/")
        path = "/" + path if "/" in u[7:] else ""
        fits = [h + p for h, p, _ in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert len(got[i] or "") == max(map(len, fits), default=0)


def test_spots(spark):
    rows = [(1, "The cat of dog sat, in the House!"), (2, "it " * 30_000), (3, None), (4, "... !!"), (5, "zebra quagga"), (6, "zebra, QUAGGA"), (7, "x" * 100_000)]
    got = {r.doc_id: r.s for r in spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", spotsigs.spots(F.col("text")).alias("s")).collect()}
    assert len(got[1]) == 3 and got[3] == got[4] == [] and got[5] == got[6] and len(got[2]) == len(got[7]) == 1


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(9)
    base = [[rng.choice(["the", "of"]) if k % 2 else f"w{rng.randint(0, 900)}" for k in range(80)] for _ in range(12)]
    texts_ = []
    for b in base:
        for _ in range(4):
            t = list(b)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(0, 80, 2)] = f"n{rng.randint(0, 10**6)}"
            texts_.append(" ".join(t))
    d = spark.createDataFrame(list(enumerate(texts_)), "doc_id bigint, text string")
    sets = {r.doc_id: frozenset(r.s) for r in d.select("doc_id", spotsigs.spots(F.col("text")).alias("s")).collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in spotsigs.near_pairs(d).collect()} == want and want


def test_next_document(spark):
    rows = [(i * 7 % 50, f"text {i} of the many words") for i in range(50)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.next_text for r in spotsigs.with_next(d, "text", lambda x: x).collect()}
    by = dict(rows)
    assert all(got[i] == by[(i + 1) % 50] for i in range(50))
    one = spotsigs.with_next(d.where("doc_id = 3"), "text", lambda x: x).first()
    assert one.next_text == by[3] and spotsigs.with_next(d.limit(0), "text", lambda x: x).count() == 0
