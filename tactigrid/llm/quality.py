"""Quality: cumulative-link ordinal regression on graded ratings (see ``ordinal``).

Ratings: 0 low with much evidence, 1 low with little, 2 good. The labels are yes or no; the
evidence is counted in training. Features are hashed words and hashed word shapes. A text is
selected when its tail probability ``P(rating >= 2)`` reaches ``select_at``.

Edge cases: null and empty texts have the length feature alone; repeated rows are scored one
by one; an empty table gives an empty result; without labels the model is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactigrid.llm.common import column, fresh
from tactigrid.llm.ordinal import Model, score, train

SELECT_AT = 0.5


def train_quality(docs: DataFrame, labels: DataFrame) -> Model:
    return train(docs, labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("fault")), up=False, shapes=True)


def quality(docs: DataFrame, model: Model, select_at: float = SELECT_AT, keep: bool = False) -> DataFrame:
    """doc_id (or, with ``keep``, every column of ``docs``), expected_rating, p_fair (of a rating of
    1 or more), p_good (of 2) and selected of every row; a name that ``docs`` has already gets
    underscores after it."""
    out = score(docs, model, keep=keep)
    kept = out.columns[:-2]
    names = [fresh(kept, c) for c in ("expected_rating", "p_fair", "p_good", "selected")]
    expected, tail = (column(c) for c in out.columns[-2:])
    return out.select(*[column(c) for c in kept], expected.alias(names[0]), tail[0].alias(names[1]), tail[1].alias(names[2]), (tail[1] >= select_at).alias(names[3]))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(docs, train_quality(docs, labels))
