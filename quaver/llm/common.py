"""Reading tables, cutting lineage and walking Arrow batches in bounded slices."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task; bounds the numpy temporaries of a Python worker.
SLICE_BYTES = 2_000_000
#: Rows in an Arrow batch handed to Python.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of so many rows: documents differ in length by a factor of 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Whether the shuffles of a query are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside have their shuffles deleted as they end."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def durable(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there. Its shuffles, which nothing reads any more, are deleted.

    The folder is the session's spark.checkpoint.dir. Only where that is unset and all runs in one process (tests, bench)
    a local one is taken; on a cluster a folder that all machines share must be named.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^,]*(, *\d+)?\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints/quaver")
    with swept(df.sparkSession):
        return df.select("*").checkpoint()  # a query of its own, so that df keeps its shuffles if it is run elsewhere


def dropped(*frames: DataFrame) -> None:
    """Deletes what durable() wrote of the frames, which nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._jdf.logicalPlan().rdd().getCheckpointFile().get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: A key with at least this fraction of the rows is hot; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 512


def hot_keys(counts: DataFrame, key: str, total: int, count: str = "count") -> list:
    """The keys of (key, count) with at least HOT_SHARE of all `total` rows, at most 1 / HOT_SHARE of them."""
    return [r[0] for r in counts.where(F.col(count) >= F.lit(total * HOT_SHARE)).select(key).collect()]


def split_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """left joined with right, which has at most one row for each key.

    The rows of right for hot keys of left, as hot_keys() bounds them, are sent to all tasks, so no task gets all rows of
    such a key; only the other rows are shuffled by key.
    """
    if not hot:
        return left.join(right, key, how)
    few = F.broadcast(right.where(F.col(key).isin(hot)))
    other = left.where(F.col(key).isNull() | ~F.col(key).isin(hot)).join(right.where(~F.col(key).isin(hot)), key, how)
    return left.where(F.col(key).isin(hot)).join(few, key, how).unionByName(other)


#: Bits of the filter of marked(), in words of 32: at most 2 ** 18 rows are broadcast, whatever the number of keys.
FILTER_BITS = 23


def marked(rows: DataFrame, key: Column, few: DataFrame, name: str) -> DataFrame:
    """rows with a boolean column `name` that is true for all keys in the one column of `few`, and rarely for others.

    The keys go into a filter of fixed size, which is broadcast. It spares a shuffle of the rows it leaves out; if there
    are so many keys that it fills up, more rows are marked, and the exact join that follows does more of the work.
    """

    def bit(k: Column) -> Column:
        return F.pmod(F.xxhash64(k.cast("long")), F.lit(1 << FILTER_BITS)).cast("int")

    at, word, mask = f"{name}_at", f"{name}_word", f"{name}_mask"
    bits = few.select(bit(few[few.columns[0]]).alias(at))
    words = bits.groupBy(F.shiftright(at, 5).alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1, {at} & 31)")).alias(mask))
    out = rows.withColumn(at, bit(key)).withColumn(word, F.shiftright(at, 5)).join(F.broadcast(words), word, "left")
    return out.withColumn(name, F.coalesce(F.expr(f"({mask} & shiftleft(1, {at} & 31)) <> 0"), F.lit(False))).drop(at, word, mask)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key written as text, modulo n."""
    return (F.crc32(key.cast("string").cast("binary")) % n).cast("int")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one after another, and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_BYTES of text; a longer text comes alone, whole."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.binary_length(b.column(text)).fill_null(0)), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
            yield b.slice(at, to - at)
            at = to


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i], ..., starts[i]+sizes[i]-1 for each i, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
