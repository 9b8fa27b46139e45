"""The second run of line dedup takes the lines that it needs, and no others."""

from __future__ import annotations

import random

from tactigrid.llm import linejoin


def test_only_lines_with_a_shared_word_go_into_the_second_run(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    common = [word() for _ in range(12)]
    # many lines of the same rare words, of which some are alike, among many of words of their own
    docs = [(i, " ".join(rng.sample(common, 9) + [word() for _ in range(rng.randrange(4))])) for i in range(60)]
    docs += [(100 + i, "\n".join(" ".join(word() for _ in range(8)) for _ in range(5))) for i in range(200)]
    sent = []
    entries = linejoin._entries

    def counted(*args):
        out = entries(*args)
        if len(args) > 5:
            sent.append(sum(len(linejoin._unpacked(r["size"], r["payload"], linejoin.SETS)[0]) for r in out.collect() if r["size"] > 0))
        return out

    monkeypatch.setattr(linejoin, "_entries", counted)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in linejoin.dedup_lines(df, wide=2, room=1, best=1).collect()}
    assert sent and 0 < sent[0] < 60 * 12, sent  # of the 1,000 other lines hardly any
    lines = [(i, k, set(x.split())) for i, t in docs for k, x in enumerate(t.split("\n"))]
    for i, t in docs:
        own = t.split("\n")
        keep = [x for k, x in enumerate(own) if not any((j, m) < (i, k) and 100 * len(s & set(x.split())) >= 80 * len(s | set(x.split())) for j, m, s in lines)]
        assert got[i] == "\n".join(keep), i


def test_the_first_of_many_variants_is_settled_in_the_first_run(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    # variants of one line that share its rare words, as many as the first run doesn't all hold together,
    # lines of three words that share one, and others
    base = [word() for _ in range(18)]
    docs = [(i, " ".join([*base[:k], word(), *base[k:]])) for i, k in enumerate(rng.choices(range(18), k=120))]
    docs += [(200 + i, f"{base[0]}q {word()} {word()}") for i in range(90)] + [(300 + i, " ".join(word() for _ in range(8))) for i in range(50)]
    rng.shuffle(docs)
    second = []
    entries = linejoin._entries
    monkeypatch.setattr(linejoin, "_entries", lambda *args: (second.append(1) if len(args) > 5 else None, entries(*args))[1])
    got = {r.doc_id: r.text for r in linejoin.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), wide=40).collect()}
    assert not second
    sets = sorted((i, set(t.split())) for i, t in docs)
    for n, (i, s) in enumerate(sets):
        gone = any(100 * len(s & x) >= 80 * len(s | x) for _, x in sets[:n])
        assert (got[i] == "") == gone, i
    assert sum(t == "" for t in got.values()) == 119


def test_lines_with_a_false_likely_candidate_are_settled_in_the_first_run(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    # lines of which any two differ in three words of twenty, one more than may differ: bitmaps of some show
    # half of these only; and a copy of one of them with two words changed
    base = [word() for _ in range(17)]
    docs = [(i, " ".join([*base, word(), word(), word()])) for i in range(120)]
    docs += [(200, " ".join([*docs[70][1].split()[:18], word(), word()]))] + [(300 + i, " ".join(word() for _ in range(8))) for i in range(50)]
    second = []
    entries = linejoin._entries
    monkeypatch.setattr(linejoin, "_entries", lambda *args: (second.append(1) if len(args) > 5 else None, entries(*args))[1])
    got = {r.doc_id: r.text for r in linejoin.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), wide=80, room=60).collect()}
    assert not second
    assert [i for i, t in got.items() if t == ""] == [200]
