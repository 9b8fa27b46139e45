"""Shared plumbing: table access, the shared scratch folder and Arrow batch slicing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark's own setting by which the shuffle files of a query go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Paths and tables to remove, the session they belong to, and tables dropped by name.
_made: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a folder of
    our own, on one machine only: elsewhere executors couldn't read one another's files."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tactigrid-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _remove(what: str) -> None:
    """Best effort: a session that has ended can't remove anything; its folder is the cluster's to clear."""
    spark = _made.pop(what, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    with contextlib.suppress(Exception):
        if "/" not in what:
            spark.sql(f"DROP TABLE IF EXISTS {what}")
            return
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(what)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    for what in list(_made):
        _remove(what)


atexit.register(_remove_all)


def free(*frames: DataFrame) -> None:
    """Remove the tables that ``materialize`` or ``bucketed`` wrote, once nothing reads them any more."""
    for df in frames:
        _remove(getattr(df, "_tactigrid_table", ""))


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries inside go when each has ended."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, label: str, few: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared folder and read it back, so
    that a lost executor costs only the stage in flight. Removed by ``free`` or when the driver ends.
    With ``few`` (rows, for their number of tasks) an eighth as many tasks at most write it as there
    are shuffle partitions: on a local disk each file costs Hadoop two processes that set its mode."""
    spark = df.sparkSession
    if few:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_dir(spark)}/tactigrid/{label}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._tactigrid_table = path
    return out


def strings(column: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """A plain contiguous string array with null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Re-cut Arrow batches so that each holds at most ``most_bytes`` of ``column`` (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts = strings(batch.column(batch.schema.get_field_index(column)))
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        at = 0
        while at < n:
            to = int(np.searchsorted(ends, ends[at] + most_bytes, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at)
            at = to


def eased(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``each``, at the end of which freed memory goes back to the machine. Workers live on from one
    stage to the next, and what they keep would count against the next one's."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # (not every C library has it)
                ctypes.CDLL(None).malloc_trim(0)

    return own


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """``df`` as a table bucketed by ``key`` into as many buckets as there are shuffle partitions: one
    shuffle, after which joins on ``key`` take the other side to where these rows are."""
    spark = df.sparkSession
    name = f"tactigrid_{label}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _cleaned(spark):
        df.repartition(n, key).write.bucketBy(n, key).option("compression", "zstd").saveAsTable(name)
    _made[name] = spark
    out = spark.table(name)
    out._tactigrid_table = name
    return out


def column(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list[str], name: str) -> str:
    """``name``, with as many underscores after it as it takes not to clash (in any case)."""
    has = {c.lower() for c in taken}
    while name.lower() in has:
        name += "_"
    return name


def numbered(docs: DataFrame, key: str) -> DataFrame:
    """(of docs: all columns, and a bigint of the same order as ``key`` as the last) under the
    name that ``fresh`` gives to "__id". Whole numbers are taken as they are; other kinds by
    their rank among the keys. A null key stays null."""
    name = fresh(docs.columns, "__id")
    if isinstance(docs.schema[key].dataType, T.IntegralType):
        return docs.withColumn(name, column(key).cast("bigint"))
    # (numbers of rows that are sorted by ranges ascend)
    ranks = docs.select(column(key).alias("k")).where("k is not null").distinct().orderBy("k").select("k", F.monotonically_increasing_id().alias("r"))
    ranks = materialize(ranks, "ranks").toDF(fresh(docs.columns, "__key"), name)
    return docs.join(ranks, column(key) == column(ranks.columns[0]), "left").drop(ranks.columns[0])
