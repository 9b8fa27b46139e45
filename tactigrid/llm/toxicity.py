"""Toxicity: expected severity from a cumulative-link ordinal regression (see ``ordinal``).

Severity grades: 0 not toxic, 1 toxic with little evidence in the words, 2 toxic with much.
The labels are yes or no; the evidence is counted in training. A text is rejected when
``P(severity >= 1)`` reaches ``reject_at``.

Edge cases: null and empty texts have no features and get the base rate, which is below the
threshold unless most labelled rows are toxic; repeated rows are scored one by one; an empty
table gives an empty result; without labels every probability is that of the empty model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactigrid.llm.common import column, fresh
from tactigrid.llm.ordinal import Model, score, train

REJECT_AT = 0.5


def train_toxicity(docs: DataFrame, labels: DataFrame) -> Model:
    return train(docs, labels.select("doc_id", F.col("toxic").alias("fault")), up=True)


def toxicity(docs: DataFrame, model: Model, reject_at: float = REJECT_AT, keep: bool = False) -> DataFrame:
    """doc_id (or, with ``keep``, every column of ``docs``), expected_severity, p_toxic,
    p_severe and rejected of every row; a name that ``docs`` has already gets underscores after it."""
    out = score(docs, model, keep=keep)
    kept = out.columns[:-2]
    names = [fresh(kept, c) for c in ("expected_severity", "p_toxic", "p_severe", "rejected")]
    expected, tail = (column(c) for c in out.columns[-2:])
    return out.select(*[column(c) for c in kept], expected.alias(names[0]), tail[0].alias(names[1]), tail[1].alias(names[2]), (tail[0] >= reject_at).alias(names[3]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, train_toxicity(docs, labels))
