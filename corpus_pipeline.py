"""The training-data pipeline: five stages, each written out and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactigrid.llm.common import column, free, fresh, materialize
from tactigrid.llm.linejoin import dedup_lines
from tactigrid.llm.minhash import near_duplicates
from tactigrid.llm.packing import pack
from tactigrid.llm.toxicity import toxicity, train_toxicity
from tactigrid.llm.winnow import decontaminate


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the severity model rejects."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity(docs, model, keep=True)
    return scored.where(~column(fresh(docs.columns, "rejected"))).select(*[column(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier line is like; documents of which nothing is left go."""
    out = dedup_lines(docs)
    out = out.where(~column(fresh(docs.columns, "emptied")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[column(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, a similarity of 0.8), the one of the
    smallest id; of rows that repeat an id any one. Rows with a null id stay."""
    named = docs.where("doc_id is not null")
    kept = near_duplicates(named).where("kept").select("doc_id").distinct()
    one = named.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    columns = [column(c) for c in docs.columns]
    return one.select(*columns).union(docs.where("doc_id is null").select(*columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a window of a benchmark item occurs. (Ids are compared with
    null as a value, so that a row with a null id goes only if one of these has such a window.)"""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontaminate(docs, benchmark).where("contaminated").select("doc_id").distinct()
    named = docs.join(hit.where("doc_id is not null"), "doc_id", "left_anti").select(*[column(c) for c in docs.columns])
    return named if hit.where("doc_id is null").isEmpty() else named.where("doc_id is not null")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of powers of two of token ids, none across documents."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Training a model and tokenizing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = materialize(stage(spark, docs, sf_dir), name)
        free(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
