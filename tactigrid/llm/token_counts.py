"""Token counts: lengths only, from Arrow batches cut by bytes.

Every text is encoded whole; long ones are cut at safe boundaries (see ``bpe``). A worker
holds one slice of about ``SLICE`` bytes (or one longer text), whatever the number of rows.

Edge cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted one by
one; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactigrid.llm.bpe import encoder
from tactigrid.llm.common import eased, slices, strings

SLICE = 6 << 20


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in slices(batches, "text", SLICE):
            texts = strings(batch.column(1))
            tokens, _ = own.encode(texts, want_ids=False)
            size = pc.cast(pc.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(tokens), pa.array(tokens > limit)], names=["key", "n_bytes", "n_tokens", "over_limit"])
        own.forget()

    kind = docs.schema[key].dataType.simpleString()
    got = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(eased(lengths), f"key {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return got.withColumnRenamed("key", key)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
