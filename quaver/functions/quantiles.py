"""Exact quantiles of groups of any size: ever narrower ranges of values are counted until one value is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaver.session import written

BINS = 4096


def quantile(rows: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """(keys, name): the quantile of each group, between the two values next to it in proportion; null and NaN are left out.

    A pass counts the values between the least and the greatest that are still in question in BINS bins for each group, and
    keeps the bin that has the wanted rank, with the values at its ends; so tasks hand on counts of bins, and no task holds the
    values of a group. Each pass narrows a range; evenly spread values take three for a group of 10 ** 10. rows are read
    once a pass: write them before."""
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    ends = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    exact = F.lit(share) * (F.col("n") - 1)
    ranks = ends.withColumn("exact", exact).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(exact), F.ceil(exact)))))
    state = written(ranks.select(*keys, "exact", "rank", "low", "high", F.lit(0).cast("long").alias("below")))
    while state.where("low < high").limit(1).count():
        some = rows.join(state.where("low < high"), keys).where("_v BETWEEN low AND high")
        width = F.col("high") / BINS - F.col("low") / BINS  # of finite values, whatever their distance
        bin_of = F.when(F.col("_v") == F.col("high"), BINS - 1).otherwise(F.least(F.lit(BINS - 2), F.floor(F.try_divide(F.col("_v") - F.col("low"), width))))
        counts = some.groupBy(*keys, "exact", "rank", "below", F.coalesce(bin_of, F.lit(0)).alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        before = Window.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("base", F.col("below") + F.coalesce(F.sum("c").over(before), F.lit(0)))
        found = counts.where((F.col("rank") >= F.col("base")) & (F.col("rank") < F.col("base") + F.col("c")))
        state = written(state.where("low >= high").unionByName(found.select(*keys, "exact", "rank", "low", "high", F.col("base").alias("below"))))
    first, last = F.min_by("low", "rank"), F.max_by("low", "rank")
    part = F.first("exact") - F.min("rank")
    return state.groupBy(*keys).agg((first + F.when(last == first, 0.0).otherwise((last - first) * part)).alias(name))
