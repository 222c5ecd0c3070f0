"""The portfolio's view of symbols: correlations of aligned returns and the volatility of their sum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def portfolio_view(returns: DataFrame, symbols: DataFrame, weights: dict[str, float] | None = None, threshold: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """((one, two, correlation) of every pair of symbols; (observations, annual_volatility, max_correlation, warning)).

    returns: (symbol, epoch, r). Only epochs at which every symbol of the registry has a return count. annual_volatility is
    that of independent symbols at their stated volatilities; symbols weigh alike by default."""
    names = sorted(r.symbol for r in symbols.select("symbol").collect())
    weights = {n: 1 / len(names) for n in names} if weights is None else weights
    if set(weights) != set(names) or min(weights.values()) < 0 or abs(sum(weights.values()) - 1) > 1e-9 or not 0 <= threshold <= 1:
        raise ValueError("weights are one for each symbol, none below 0, and add up to 1")
    whole = returns.where(F.col("r").isNotNull() & F.col("symbol").isin(names)).groupBy("epoch").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "r"))).alias("m")).where(F.size("m") == len(names))
    x = {n: F.element_at("m", n) for n in names}
    n, sums = F.count("*"), {a: F.sum(x[a]) for a in names}

    def correlation(a: str, b: str) -> Column:
        top = n * F.sum(x[a] * x[b]) - sums[a] * sums[b]
        return F.try_divide(top, F.sqrt((n * F.sum(x[a] * x[a]) - sums[a] * sums[a]) * (n * F.sum(x[b] * x[b]) - sums[b] * sums[b])))

    cells = [F.struct(F.lit(a).alias("one"), F.lit(b).alias("two"), correlation(a, b).alias("correlation")) for a in names for b in names if a < b]
    totals = whole.agg(n.alias("observations"), F.array(*cells).alias("cells"))
    pairs = totals.select(F.explode("cells").alias("x")).select("x.*")
    stated = {r.symbol: r.stated_vol for r in symbols.collect()}
    volatility = math.sqrt(sum((weights[a] * stated[a]) ** 2 for a in names))
    most = F.array_max(F.transform("cells", lambda c: F.abs(c["correlation"])))
    view = totals.select("observations", F.lit(volatility).alias("annual_volatility"), most.alias("max_correlation")).withColumn("warning", F.col("max_correlation") > threshold)
    return pairs, view
