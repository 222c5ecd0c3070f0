"""Time series in chunks: rolling windows and recursions that need not have a whole symbol in one task.

A chunk is a fixed span of time of one symbol. Rolling windows run inside chunks, whose rows are preceded by a halo of
as many rows as the window is long. Recursions are affine, y = a * y_before + b: the steps of a chunk are composed, the
few composed steps of a symbol are chained, and every row then follows from the start of its chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.session import written

CHUNK_ROWS = 1024


def chunk_of(step: int, rows: int = CHUNK_ROWS) -> Column:
    return F.floor(F.col("epoch") / (step * rows)).cast("long")


def segmented(candles: DataFrame, step: int) -> DataFrame:
    """Adds chunk and segment, the epoch at which the contiguous run of candles begins that a row is in."""
    rows = written(candles.withColumn("chunk", chunk_of(step)))  # candles are asked for thrice
    by_symbol = Window.partitionBy("symbol").orderBy("chunk")
    ends = rows.groupBy("symbol", "chunk").agg(F.max("epoch").alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(by_symbol)).drop("last")
    inside = Window.partitionBy("symbol", "chunk").orderBy("epoch")
    rows = rows.join(ends, ["symbol", "chunk"]).withColumn("before", F.coalesce(F.lag("epoch").over(inside), F.col("before")))
    rows = rows.withColumn("start", F.when(F.col("before").isNull() | (F.col("epoch") - F.col("before") != step), F.col("epoch")))
    carried = rows.groupBy("symbol", "chunk").agg(F.max("start").alias("start"))
    carried = carried.select("symbol", "chunk", F.max("start").over(by_symbol.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    rows = rows.join(carried, ["symbol", "chunk"])
    return rows.withColumn("segment", F.coalesce(F.max("start").over(inside), F.col("carried"))).drop("before", "start", "carried")


def haloed(rows: DataFrame, step: int, halo: int) -> DataFrame:
    """Every row in its chunk, and once more, with halo = true, in each later chunk that its next `halo` rows reach."""
    last = F.floor((F.col("epoch") + halo * step) / (step * CHUNK_ROWS)).cast("long")
    return rows.withColumn("part", F.explode(F.sequence(F.col("chunk"), last))).withColumn("halo", F.col("part") != F.col("chunk"))


def order() -> Window:
    return Window.partitionBy("symbol", "part", "segment").orderBy("epoch")


def last(n: int, until: int = 0) -> Window:
    """The n rows up to the one `until` rows on."""
    return order().rowsBetween(until - n + 1, until)


def when_full(value: Column, over: Window, n: int, counted: str) -> Column:
    """The value where the window has n non-null rows of `counted`."""
    return F.when(F.count(counted).over(over) == n, value)


def scanned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The steps y = a * y_before + b put one after another: after row i, y is a[i] * start + b[i]. log2(n) rounds of whole arrays."""
    a, b, d = a.copy(), b.copy(), 1
    while d < len(a):
        b[d:] = a[d:] * b[:-d] + b[d:]
        a[d:] = a[d:] * a[:-d]
        d *= 2
    return a, b


def affine(rows: DataFrame, **steps: tuple[Column, Column]) -> DataFrame:
    """Adds, for each name, y = a * y_before + b along each symbol's epochs, from its columns (a, b); y before the first row is 0.

    A chunk's rows are composed as arrays, chunks are chained by their last rows, and the values follow from both.
    """
    names = list(steps)
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()))  # a number for each row, as epochs may be repeated
    slim = rows.select("_row", "symbol", "chunk", "epoch", *[c.cast("double").alias(f"{k}{i}") for i, pair in enumerate(steps.values()) for k, c in zip("ab", pair, strict=True)])
    columns = [f"{k}{i}" for i in range(len(names)) for k in "ab"]
    ends = ", ".join(f"{c} double" for c in columns)

    def composed(pdf: pd.DataFrame, order: str) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True, kind="stable")
        a, b = scanned(pdf[[f"a{i}" for i in range(len(names))]].to_numpy(), pdf[[f"b{i}" for i in range(len(names))]].to_numpy())
        return pdf.assign(**{f"a{i}": a[:, i] for i in range(len(names))}, **{f"b{i}": b[:, i] for i in range(len(names))})

    done = slim.groupBy("symbol", "chunk").applyInPandas(lambda pdf: composed(pdf, "epoch"), f"_row long, symbol string, chunk long, epoch long, {ends}")
    done = written(done)
    last_rows = done.groupBy("symbol", "chunk").agg(*[F.max_by(c, "epoch").alias(c) for c in columns])
    chained = last_rows.groupBy("symbol").applyInPandas(lambda pdf: composed(pdf, "chunk"), f"symbol string, chunk long, {ends}")
    before = Window.partitionBy("symbol").orderBy("chunk")
    starts = chained.select("symbol", "chunk", *[F.coalesce(F.lag(f"b{i}").over(before), F.lit(0.0)).alias(f"y{i}") for i in range(len(names))])
    done = done.join(starts, ["symbol", "chunk"]).select("_row", *[(F.col(f"a{i}") * F.col(f"y{i}") + F.col(f"b{i}")).alias(n) for i, n in enumerate(names)])
    return rows.join(done, "_row").drop("_row")
