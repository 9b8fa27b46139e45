"""What a worker keeps when its task is done, as it serves the next stage, and how many files it writes."""

from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa

from tactigrid.llm import bpe, minhash, packing, token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_workers_keep_no_units_after_their_tasks(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(bpe.encoder(VOCABULARY).code)], pa.int64())})

    for run in (lambda: packing.pack(docs, VOCABULARY), lambda: token_counts.count_tokens(docs, VOCABULARY)):
        assert run().count() >= len(rows)
        assert {r.n for r in spark.range(0, 16, 1, 4).mapInArrow(kept, "n bigint").collect()} == {0}


def test_small_tables_have_few_files(spark, monkeypatch):
    files = []
    write = minhash.materialize

    def counted(df, label, **more):
        out = write(df, label, **more)
        files.append((label, len(out.inputFiles())))
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(200) if i % 10 != 9], "a bigint, b bigint")
        got = {r.id: r.root for r in minhash.connected(edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i // 10 * 10 for i in range(200) if i % 10}
    assert files and max(n for _, n in files) <= 4, files
