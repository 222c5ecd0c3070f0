"""Means of blocks drawn from long series: running sums make a block's sum a difference of two rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1024


def running_sums(rows: DataFrame, step: int, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """((keys, at, s): the sum of the first `at` values by epoch; (keys, n, total))."""
    from quaver.operators.trades import numbered

    rows = numbered(rows.where(F.col(value).isNotNull()), step, keys)
    rows = rows.select(*keys, "at", F.col(value).cast("double").alias("v")).withColumn("chunk", F.floor(F.col("at") / CHUNK))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "chunk").agg(F.sum("v").alias("t")).select(*keys, "chunk", F.coalesce(F.sum("t").over(before), F.lit(0.0)).alias("base"))
    inside = F.sum("v").over(Window.partitionBy(*keys, "chunk").orderBy("at"))
    running = rows.withColumn("s", inside).join(totals, [*keys, "chunk"]).select(*keys, (F.col("at") + 1).alias("at"), (F.col("s") + F.col("base")).alias("s"))
    return running, rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def block_means(drawn: DataFrame, running: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, replication, mean) of (keys, replication, n, total, start, end, turns) blocks, which run from start to before end
    after `turns` times around the series; the blocks of a replication have n rows in all."""
    for edge in ("start", "end"):
        drawn = drawn.join(running.select(*keys, F.col("at").alias(edge), F.col("s").alias(f"{edge}_sum")), [*keys, edge], "left")
    got = F.coalesce("end_sum", F.lit(0.0)) - F.coalesce("start_sum", F.lit(0.0)) + F.col("turns") * F.col("total")
    return drawn.groupBy(*keys, "replication").agg((F.sum(got) / F.first("n")).alias("mean"))


def stationary_means(rows: DataFrame, step: int, keys: list[str], value: str, replications: int, seed: int, length: float | None = None) -> DataFrame:
    """One mean for each key and replication of a stationary bootstrap: blocks of geometric length, sqrt(n) on average by default.

    A replication is about sqrt(n) lookups of running sums and no task holds a series. Random numbers come from (seed,
    replication), however the work is dealt."""
    running, sizes = running_sums(rows, step, keys, value)

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.to_dict("records"):
                n, left, out, draw = int(row["n"]), int(row["n"]), [], np.random.default_rng([seed, int(row["replication"])])
                while left > 0:
                    start, size = int(draw.integers(0, n)), min(int(draw.geometric(1 / (length or max(1.0, n**0.5)))), left)
                    left -= size
                    turns, end = divmod(start + size, n)
                    out.append((start, end, turns))
                yield pd.DataFrame({k: row[k] for k in [*keys, "replication", "n", "total"]} | {c: [x[i] for x in out] for i, c in enumerate(("start", "end", "turns"))})

    each = sizes.withColumn("replication", F.explode(F.sequence(F.lit(0), F.lit(replications - 1)))).repartition(*keys, "replication")
    kinds = dict(sizes.dtypes)
    drawn = each.mapInPandas(blocks, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", replication int, n long, total double, start long, end long, turns long")
    return block_means(drawn, running, keys)


def grouped_means(rows: DataFrame, step: int, keys: list[str], group: str, value: str, replications: int, seed: int) -> DataFrame:
    """As stationary_means(), with every group of a key resampled by itself: the mean of a replication is over all groups."""
    sizes = rows.where(F.col(value).isNotNull()).groupBy(*keys, group).agg(F.count("*").alias("n"))
    means = stationary_means(rows, step, [*keys, group], value, replications, seed).join(sizes, [*keys, group])
    return means.groupBy(*keys, "replication").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"))


def interval(means: DataFrame, keys: list[str], confidence: float = 0.95) -> DataFrame:
    tail = (1 - confidence) / 2
    return means.groupBy(*keys).agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"))
