"""Packing by power-of-two decomposition.

A document's ids (its tokens and a closing id) are cut into pieces whose lengths are the
powers of two of its length's binary form, the longest first and as many of ``limit`` as fit.
Each piece is a sequence of its own, so no sequence crosses documents and none is padded;
the bucket of a piece is its length, and a reader draws batches from one bucket.

The cut is made beside the scan, without a shuffle: a document never waits for another.
``sequence_id`` numbers the pieces; it is unique, and the same again when a lost partition is
recomputed.

Edge cases: null and empty texts are the closing id alone (one piece of length 1); repeated
rows are packed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactigrid.llm.bpe import encoder
from tactigrid.llm.common import eased, slices, strings

SLICE = 6 << 20
LIMIT = 1024


def cut(total: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, start, length) of all pieces of documents of ``total`` ids each."""
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    owners, starts, lengths = [], [], []
    whole = total // limit
    n = np.repeat(np.arange(len(total)), whole)
    owners.append(n)
    starts.append((np.arange(len(n)) - np.repeat(np.cumsum(whole) - whole, whole)) * limit)
    lengths.append(np.full(len(n), limit))
    at = whole * limit
    power = limit >> 1
    while power:
        has = np.flatnonzero(total & power)
        owners.append(has)
        starts.append(at[has])
        lengths.append(np.full(len(has), power))
        at = at + (total & power)
        power >>= 1
    owner, start, length = map(np.concatenate, (owners, starts, lengths))
    order = np.lexsort((start, owner))
    return owner[order], start[order], length[order]


def pack(docs: DataFrame, vocabulary: str, limit: int = LIMIT, end_id: int = 0, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """One row per piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and (with ``ids``) the ids themselves."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in slices(batches, "text", SLICE):
            counts, flat = own.encode(strings(batch.column(1)))
            total = counts + 1
            ends = np.cumsum(total)
            every = np.full(int(ends[-1]), end_id, np.uint32)
            closing = np.zeros(len(every), bool)
            closing[ends - 1] = True
            every[~closing] = flat
            owner, start, length = cut(total, limit)
            at = ends[owner] - total[owner] + start
            raw = memoryview(every.astype("<u4").tobytes())
            crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip((at * 4).tolist(), ((at + length) * 4).tolist(), strict=True)), np.int64, len(at))
            out = [batch.column(0).take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(crc), pa.array(total[owner])]
            names = ["key", "start", "length", "ids_crc32", "doc_tokens"]
            if ids:  # the pieces of a document follow one another, so the ids are in order already
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(every.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)
        own.forget()

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * ids
    got = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(eased(pieces), schema)
    return got.withColumnRenamed("key", key).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))


def bucket_of(length: str = "length"):
    """The bucket a piece belongs to: the power of its length, for ``partitionBy`` on write."""
    return F.log2(F.col(length)).cast("int")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False)
