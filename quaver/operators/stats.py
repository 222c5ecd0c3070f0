"""Monitors, tests of randomness and multiple testing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from quaver.functions import dist, shifts
from quaver.functions.quantiles import quantile
from quaver.functions.series import last, order, when_full
from quaver.operators import quality, resampling, trades
from quaver.operators.indicators import YEAR, rolled
from quaver.session import written


def _each(f, *columns: pd.Series) -> pd.Series:
    """f of every row that has all its values."""
    return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _each(dist.chi2_sf, x, df)


@pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return _each(lambda v: math.erfc(abs(v) / math.sqrt(2)), z)


@pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return _each(lambda v: math.erfc(-v / math.sqrt(2)) / 2, z)


@pandas_udf(DoubleType())
def normal_isf(p: pd.Series) -> pd.Series:
    """z that a normal value exceeds with probability p, for p between 0 and 1."""
    return _each(lambda v: -dist.NORMAL.inv_cdf(v), p)


@pandas_udf(DoubleType())
def binomial_sf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return _each(lambda a, b, c: dist.binomial_sf(int(a), int(b), c), k, n, p)


@pandas_udf(DoubleType())
def binomial_two_sided(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return _each(lambda a, b, c: dist.binomial_two_sided(int(a), int(b), c), k, n, p)


@pandas_udf(DoubleType())
def least_detectable(n: pd.Series) -> pd.Series:
    known = {v: dist.least_detectable_deviation(int(v)) for v in n.dropna().unique() if v > 0}
    return _each(lambda v: known.get(v, math.nan), n).where(lambda x: x == x)


def kept_returns(candles: DataFrame, step: int) -> DataFrame:
    """(symbol, epoch, r, at): log returns over exactly one step, numbered by symbol from 0; gaps are skipped, not kept apart."""
    rows = quality.with_previous(candles.select("symbol", "epoch", "close").where("close > 0"), "epoch", step * 1024, "epoch", "close").where(F.col("epoch") - F.col("previous_epoch") == step)
    return quality.numbered_by(rows.select("symbol", "epoch", F.log(F.col("close") / F.col("previous_close")).alias("r")), "epoch", step * 1024, ["symbol"])


def volatility_monitor(candles: DataFrame, symbols: DataFrame, step: int, n: int = 500, confidence: float = 0.99) -> DataFrame:
    """Realised volatility of each window of n kept returns, its exact interval, and whether the stated one lies outside.

    Windows run over gaps. A symbol with fewer returns has one row with status insufficient_data."""
    if isinstance(n, bool) or n < 2 or not 0 < confidence < 1:
        raise ValueError("a window of two or more and a confidence between 0 and 1 are needed")
    low, high = dist.chi2_ppf((1 - confidence) / 2, n - 1), dist.chi2_ppf((1 + confidence) / 2, n - 1)
    returns = kept_returns(candles, step)
    w = Window.partitionBy("symbol", "part").orderBy("at").rowsBetween(1 - n, 0)
    rows = quality.in_parts(returns, n).withColumn("v", F.when(F.count("r").over(w) == n, F.var_samp("r").over(w)) * (YEAR / step)).where("not halo and v is not null")
    rows = rows.select("symbol", "epoch", F.lit(n).cast("long").alias("observations"), "v")
    ends = returns.groupBy("symbol").agg(F.max("epoch").alias("last"), F.count("*").alias("observations"))
    ends = candles.groupBy("symbol").agg(F.max("epoch").alias("epoch")).join(ends, "symbol", "left").na.fill(0, ["observations"]).where(F.col("observations") < n)
    rows = rows.unionByName(ends.select("symbol", F.coalesce("last", "epoch").alias("epoch"), "observations", F.lit(None).cast("double").alias("v"))).join(symbols.select("symbol", "stated_vol"), "symbol")
    stated = F.col("stated_vol")
    bounds = F.sqrt(F.col("v") * (n - 1) / high), F.sqrt(F.col("v") * (n - 1) / low)
    status = F.when(F.col("v").isNull(), "insufficient_data").otherwise("ok")
    return rows.select("symbol", "epoch", "observations", "stated_vol", status.alias("status"), F.sqrt("v").alias("realized"), bounds[0].alias("low"), bounds[1].alias("high"), ((stated < bounds[0]) | (stated > bounds[1])).alias("alert"))


def latest_monitor(monitor: DataFrame) -> DataFrame:
    """The last window of each symbol."""
    names = [c for c in monitor.columns if c != "symbol"]
    return monitor.groupBy("symbol").agg(F.max_by(F.struct(*names), "epoch").alias("v")).select("symbol", "v.*")


def variance_test(latest: DataFrame) -> DataFrame:
    """(symbol, statistic, p): chi-square of the last window's variance against the stated one, two-sided."""
    rows = latest.where("status = 'ok'").withColumn("df", F.col("observations") - 1)
    rows = rows.withColumn("statistic", F.col("df") * F.pow(F.col("realized") / F.col("stated_vol"), 2)).withColumn("above", chi2_sf("statistic", F.col("df").cast("double")))
    return rows.select("symbol", "observations", "statistic", F.least(F.lit(1.0), 2 * F.least("above", 1 - F.col("above"))).alias("p"))


def ljung_box(candles: DataFrame, step: int, lags: int = 5) -> DataFrame:
    """Q over a symbol's returns inside contiguous candles."""
    rows = rolled(candles, step, lags).withColumns({f"l{k}": F.lag("r", k).over(order()) for k in range(1, lags + 1)}).where("not halo and r is not null")
    ends = rows.groupBy("symbol").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.var_pop("r").alias("v"))
    rows = rows.join(ends, "symbol")
    rho = [F.try_divide(F.sum((F.col("r") - F.col("m")) * (F.col(f"l{k}") - F.col("m"))), F.first("n") * F.first("v")) for k in range(1, lags + 1)]
    n = F.first("n")
    return rows.groupBy("symbol").agg(n.alias("n"), (n * (n + 2) * sum(F.pow(x, 2) / (n - k) for k, x in enumerate(rho, 1))).alias("q"))


def runs_test(candles: DataFrame, step: int) -> DataFrame:
    """Wald-Wolfowitz over the signs of non-zero returns, with continuity correction."""
    rows = rolled(candles, step, 1).where("not halo and r <> 0")
    rows = quality.with_previous(rows.select("symbol", "epoch", F.signum("r").alias("s")), "epoch", step * 1024, "s")
    t = rows.groupBy("symbol").agg(F.sum(F.when(F.col("s") > 0, 1).otherwise(0)).alias("up"), F.sum(F.when(F.col("s") < 0, 1).otherwise(0)).alias("down"), F.sum(F.when(F.col("previous_s").isNull() | (F.col("s") != F.col("previous_s")), 1).otherwise(0)).alias("runs"))
    n, both = F.col("up") + F.col("down"), 2.0 * F.col("up") * F.col("down")
    mean = both / n + 1
    var = both * (both - n) / (n * n * (n - 1))
    gap = F.greatest(F.lit(0.0), F.abs(F.col("runs") - mean) - 0.5) * F.signum(F.col("runs") - mean)
    return t.select("symbol", "up", "down", "runs", F.coalesce(F.try_divide(gap, F.sqrt(var)), F.lit(0.0)).alias("z"))


def decisions(candles: DataFrame, step: int, signal: Column, horizon: int) -> DataFrame:
    """(symbol, place, direction, ret) of every candle: close to close over `horizon` positions, whatever lies between."""
    rows = trades.numbered(candles.withColumn("direction", F.signum(signal.cast("double"))).select("symbol", "epoch", "close", "direction"), step, ["symbol"])
    w = Window.partitionBy("symbol", "part").orderBy("at")
    rows = quality.in_parts(rows, horizon).withColumn("before", F.lag("close", horizon).over(w)).withColumn("side", F.lag("direction", horizon).over(w)).where("not halo and before is not null")
    return rows.select("symbol", (F.col("at") - horizon).alias("place"), F.col("side").alias("direction"), (F.col("close") / F.col("before") - 1).alias("ret"))


def signal_evaluation(candles: DataFrame, step: int, signal: Column, horizon: int, permutations: int | None = None, seed: int = 0) -> DataFrame:
    """Returns after a signal: moments and ties of all, and hit rate, mean, exact two-sided binomial p and permutation p of
    decisions that don't overlap.

    The permutation p turns the signals of valid decisions, flat ones among them, against their returns: all turns, or
    `permutations` drawn without replacement; it is two-sided, and null with fewer than two decisions."""
    every = written(decisions(candles, step, signal, horizon).where("direction IS NOT NULL AND ret IS NOT NULL AND NOT isnan(ret)"))
    rows = every.where("direction <> 0").withColumn("out", F.col("direction") * F.col("ret"))
    apart = F.col("place") % horizon == 0
    hits, real = F.count(F.when(apart & (F.col("out") > 0), 1)), F.count(F.when(apart & (F.col("out") != 0), 1))
    median = quantile(every.where("direction <> 0"), ["symbol"], "ret", 0.5, "median")
    rows = rows.groupBy("symbol").agg(
        F.count("out").alias("observations"), F.count(F.when(F.col("out") == 0, 1)).alias("tie_count"), real.alias("n_effective"), F.avg("ret").alias("mean"),
        F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("sd"), F.coalesce(F.try_divide(hits, real), F.lit(0.0)).alias("hit_rate"), F.avg(F.when(apart, F.col("out"))).alias("mean_signed"), hits.alias("hits"),
    )
    p = F.when(F.col("n_effective") > 0, binomial_two_sided("hits", "n_effective", F.lit(0.5))).otherwise(1.0)
    turned = every.where(apart)
    turned_p = shifts.turn_p(turned, ["symbol"], "place", 1 << 20, "direction", "ret", permutations, seed, True, 1e-12).withColumnRenamed("p", "permutation_p")
    enough = turned.groupBy("symbol").agg(F.count("*").alias("valid")).where("valid > 1").select("symbol")
    rows = rows.join(median, "symbol").join(turned_p.join(enough, "symbol"), "symbol", "left")
    return rows.withColumn("binomial_p", p).withColumn("binomial_is_inferential", F.lit(horizon == 1))


def signal_bootstrap(candles: DataFrame, step: int, signal: Column, horizon: int, replications: int, seed: int, block: float | None = None) -> DataFrame:
    """(symbol, p): two-sided p of a mean of 0 for decisions that don't overlap, flat ones as 0, by the stationary bootstrap of centered values."""
    rows = decisions(candles, step, signal, horizon).where(F.col("place") % horizon == 0)
    rows = rows.select("symbol", F.col("place").alias("epoch"), F.coalesce(F.col("direction") * F.col("ret"), F.lit(0.0)).alias("v"))
    means = resampling.stationary_means(rows, 1, ["symbol"], "v", replications, seed, float(block or max(1, horizon)))
    own = rows.groupBy("symbol").agg(F.avg("v").alias("own"))
    hit = F.abs(F.col("mean") - F.col("own")) >= F.abs("own")
    return means.join(own, "symbol").groupBy("symbol").agg(((1 + F.count(F.when(hit, 1))) / (replications + 1)).alias("p"))


def cross_correlation(candles: DataFrame, step: int) -> DataFrame:
    """Pearson correlation of aligned returns for each pair of symbols; a pair joins on epoch."""
    r = rolled(candles, step, 1).where("not halo and r is not null").select("symbol", "epoch", "r")
    both = r.select(F.col("symbol").alias("one"), "epoch", F.col("r").alias("x")).join(r.select(F.col("symbol").alias("two"), "epoch", F.col("r").alias("y")), "epoch").where("one < two")
    n, sx, sy = F.count("*"), F.sum("x"), F.sum("y")
    c = F.try_divide(n * F.sum(F.col("x") * F.col("y")) - sx * sy, F.sqrt((n * F.sum(F.col("x") * F.col("x")) - sx * sx) * (n * F.sum(F.col("y") * F.col("y")) - sy * sy)))
    return both.groupBy("one", "two").agg(n.alias("n"), c.alias("correlation"), (4 / F.sqrt(n)).alias("threshold"))


def _probability(p: str) -> Column:
    """p, or an error where it isn't in 0..1."""
    return F.when(F.col(p).between(0, 1), F.col(p)).otherwise(F.raise_error(F.concat(F.lit("not a probability: "), F.col(p).cast("string"))).cast("double"))


def benjamini_hochberg(tests: DataFrame, p: str = "p", q: str = "q", *family: str) -> DataFrame:
    """Adds q over all rows (of one family) that have a p; others drop out. A p outside 0..1 raises an error when it is read.

    For families of hypotheses, which are (symbol, flag, horizon, ...) and as small as such lists are: one task orders them and
    the tests are worked out once. benjamini_hochberg_large() is for families that grow with the data."""
    rows = tests.where(F.col(p).isNotNull()).withColumn(p, _probability(p)).withColumn("_k", F.row_number().over(Window.partitionBy(*family).orderBy(p))).withColumn("_m", F.count("*").over(Window.partitionBy(*family)))
    least = F.min(F.col(p) * F.col("_m") / F.col("_k")).over(Window.partitionBy(*family).orderBy("_k").rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn(q, F.least(F.lit(1.0), least)).drop("_k", "_m")


def benjamini_hochberg_large(tests: DataFrame, p: str = "p", q: str = "q") -> DataFrame:
    """As benjamini_hochberg(), for a family of any size: tests are counted by their p in ranges first, so that ranks and the
    running least value are chained over ranges and no task orders the whole family. tests is read more than once: write it before."""
    rows = tests.where(F.col(p).isNotNull()).withColumn(p, _probability(p)).withColumn("_range", F.floor(-64 * F.log2(F.greatest(F.col(p), F.lit(1e-300)))).cast("int"))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_c"))
    down = Window.orderBy(F.desc("_range"))  # small p first; there are at most 64 * 997 ranges
    counts = counts.select("_range", F.coalesce(F.sum("_c").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_c").over(Window.partitionBy()).alias("_m"))
    own = Window.partitionBy("_range").orderBy(p)
    rows = rows.join(counts, "_range").withColumn("_k", F.col("_base") + F.row_number().over(own)).withColumn("_v", F.col(p) * F.col("_m") / F.col("_k"))
    later = rows.groupBy("_range").agg(F.min("_v").alias("_least"))
    later = later.select("_range", F.min("_least").over(down.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    inside = F.min("_v").over(Window.partitionBy("_range").orderBy("_k").rowsBetween(0, Window.unboundedFollowing))
    return rows.join(later, "_range").withColumn(q, F.least(F.lit(1.0), inside, F.col("_later"))).drop("_range", "_base", "_m", "_k", "_v", "_later")


def adjusted(tests: DataFrame, p: str = "p", q: str = "q") -> DataFrame:
    """Adds q over the rows that have a p; others keep null."""
    has = F.col(p).isNotNull()
    rows = tests.withColumn(p, F.when(has, _probability(p))).withColumn("_k", F.row_number().over(Window.orderBy(F.col(p).asc_nulls_last()))).withColumn("_m", F.count(p).over(Window.partitionBy()))
    least = F.min(F.col(p) * F.col("_m") / F.col("_k")).over(Window.orderBy("_k").rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn(q, F.when(has, F.least(F.lit(1.0), least))).drop("_k", "_m")


def variance_ratio_test(candles: DataFrame, step: int, h: int = 2) -> DataFrame:
    """z of the variance of sums of h returns, inside contiguous candles, against that of one; 0 without variance."""
    rows = rolled(candles, step, h).withColumn("s", when_full(F.sum("r").over(last(h)), last(h), h, "r")).where("not halo and r is not null")
    ends = rows.groupBy("symbol").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.var_samp("r").alias("v"))
    many = F.sum(F.pow(F.col("s") - h * F.col("m"), 2)) / (h * (F.first("n") - h + 1) * (1 - h / F.first("n")))
    scale = F.sqrt(2.0 * (2 * h - 1) * (h - 1) / (3.0 * h * F.first("n")))
    out = rows.join(ends, "symbol").groupBy("symbol").agg(F.first("n").alias("n"), F.coalesce((F.try_divide(many, F.first("v")) - 1) / scale, F.lit(0.0)).alias("z"))
    return out.where(F.col("n") > h)


def arch_lm(candles: DataFrame, step: int, lags: int = 1) -> DataFrame:
    """n times R squared of squared returns on their lags; the sums of products are Spark's, a task solves one small system."""
    rows = rolled(candles, step, lags).withColumn("y0", F.col("r") * F.col("r"))
    rows = rows.withColumns({f"y{k}": F.lag("y0", k).over(order()) for k in range(1, lags + 1)}).where("not halo").dropna(subset=[f"y{k}" for k in range(lags + 1)])
    # Squared returns are small: they are taken in units of their mean, which leaves R squared as it is.
    unit = rows.groupBy("symbol").agg(F.avg("y0").alias("unit"))
    rows = rows.join(unit, "symbol")
    x = [F.lit(1.0), *[F.coalesce(F.try_divide(F.col(f"y{k}"), F.col("unit")), F.lit(0.0)) for k in range(1, lags + 1)], F.coalesce(F.try_divide(F.col("y0"), F.col("unit")), F.lit(0.0))]
    sums = rows.groupBy("symbol").agg(F.array(*[F.sum(a * b) for a in x for b in x]).alias("xx"))

    def solve(parts):
        for pdf in parts:
            out = []
            for symbol, xx in zip(pdf["symbol"], pdf["xx"], strict=True):
                m = np.array(xx).reshape(lags + 2, lags + 2)
                n, sst = m[0, 0], m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
                beta = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
                lm = max(0.0, n * (1 - (m[-1, -1] - beta @ m[:-1, -1]) / sst)) if sst > 1e-12 * m[-1, -1] else 0.0
                out.append((symbol, int(n), lm))
            yield pd.DataFrame(out, columns=["symbol", "n", "lm"])

    return sums.mapInPandas(solve, "symbol string, n long, lm double")


def breach_rate(monitor: DataFrame, symbols: DataFrame, step: int, n: int, rate: float = 0.01) -> DataFrame:
    """Alerts among windows that don't overlap, every n-th, and a one-sided exact test of their rate; a symbol without windows has p 1."""
    rows = trades.numbered(monitor.where("status = 'ok'"), step, ["symbol"]).where(F.col("at") % n == 0)
    rows = rows.groupBy("symbol").agg(F.count("*").alias("windows"), F.count(F.when(F.col("alert"), 1)).alias("breaches"))
    rows = symbols.select("symbol").join(rows, "symbol", "left").na.fill(0, ["windows", "breaches"])
    return benjamini_hochberg(rows.withColumn("p", F.when(F.col("windows") > 0, binomial_sf("breaches", "windows", F.lit(rate))).otherwise(1.0)))


def identical_ratios(monitor: DataFrame) -> DataFrame:
    """Pairs of symbols whose last realised volatility over the stated one is equal to three places."""
    rows = latest_monitor(monitor).where("status = 'ok'")
    same = rows.groupBy(F.round(F.col("realized") / F.col("stated_vol"), 3)).agg(F.count("*").alias("k"))
    return same.agg(F.coalesce(F.sum(F.floor(F.col("k") * (F.col("k") - 1) / 2)), F.lit(0)).cast("long").alias("pairs"))


def randomness_battery(candles: DataFrame, step: int, lags: int = 5, h: int = 2, arch_lags: int = 1, alpha: float = 0.05) -> DataFrame:
    """(symbol, test, statistic, p, q, reject): four tests of every symbol's returns as one family."""
    parts = [
        ljung_box(candles, step, lags).select("symbol", F.lit("ljung_box").alias("test"), F.col("q").alias("statistic"), chi2_sf("q", F.lit(float(lags))).alias("p")),
        runs_test(candles, step).select("symbol", F.lit("runs").alias("test"), F.col("z").alias("statistic"), normal_two_sided("z").alias("p")),
        variance_ratio_test(candles, step, h).select("symbol", F.lit("variance_ratio").alias("test"), F.col("z").alias("statistic"), normal_two_sided("z").alias("p")),
        arch_lm(candles, step, arch_lags).select("symbol", F.lit("arch_lm").alias("test"), F.col("lm").alias("statistic"), chi2_sf("lm", F.lit(float(arch_lags))).alias("p")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return benjamini_hochberg(rows).withColumn("reject", F.col("q") <= alpha)
