"""Rolling indicators over contiguous candles: causal, null until the window is full."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.functions.series import affine, haloed, last, order, segmented, when_full

YEAR = 31_536_000


def rolled(candles: DataFrame, step: int, halo: int) -> DataFrame:
    """Candles by segment with a halo, and the log return r."""
    rows = haloed(segmented(candles, step), step, halo + 1)
    before = F.lag("close").over(order())
    return rows.withColumn("r", F.when((F.col("close") > 0) & (before > 0), F.log(F.col("close") / before)))


def finished(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.select("symbol", "epoch", "halo", *[c.alias(n) for n, c in columns.items()]).where("not halo").drop("halo")


def log_return(candles: DataFrame, step: int) -> DataFrame:
    return finished(rolled(candles, step, 1), r=F.col("r"))


def need(n: int, least: int) -> None:
    if isinstance(n, bool) or not isinstance(n, int) or n < least:
        raise ValueError(f"a whole number of at least {least} is needed, not {n!r}")


def z_value(n: int) -> Column:
    w = last(n)
    return when_full(F.try_divide(F.col("close") - F.avg("close").over(w), F.nullif(F.stddev_pop("close").over(w), F.lit(0.0))), w, n, "close")


def bollinger_z(candles: DataFrame, step: int, n: int = 20) -> DataFrame:
    need(n, 2)
    return finished(rolled(candles, step, n), z=z_value(n))


def realized_vol(candles: DataFrame, step: int, n: int = 20) -> DataFrame:
    need(n, 2)
    w = last(n)
    return finished(rolled(candles, step, n), vol=annualized(when_full(F.stddev_samp("r").over(w), w, n, "r"), step))


def elapsed_value(step: int, n: int) -> Column:
    w = last(n)
    return when_full(F.sqrt(F.sum(F.col("r") * F.col("r")).over(w) * YEAR / (n * step)), w, n, "r")


def realized_vol_elapsed(candles: DataFrame, step: int, n: int = 20) -> DataFrame:
    """Not demeaned, by the time that passed."""
    need(n, 1)
    return finished(rolled(candles, step, n), vol=elapsed_value(step, n))


def parkinson(candles: DataFrame, step: int, n: int = 20) -> DataFrame:
    need(n, 1)
    w = last(n)
    x = F.when((F.col("low") > 0) & (F.col("high") > 0), F.pow(F.log(F.col("high") / F.col("low")), 2))
    rows = rolled(candles, step, n).withColumn("x", x)
    return finished(rows, vol=when_full(F.sqrt(F.avg("x").over(w) / (4 * math.log(2))), w, n, "x") * math.sqrt(YEAR / step))


def autocorrelation_value(n: int, lag: int) -> Column:
    """Of rows with r and y, r `lag` rows before."""
    w, m = last(n - lag), n - lag
    sx, sy, sxx, syy, sxy = (F.sum(x).over(w) for x in (F.col("r"), F.col("y"), F.col("r") * F.col("r"), F.col("y") * F.col("y"), F.col("r") * F.col("y")))
    vx, vy = m * sxx - sx * sx, m * syy - sy * sy
    c = F.when((vx > 1e-18) & (vy > 1e-18), F.try_divide(m * sxy - sx * sy, F.sqrt(vx * vy)))
    return F.when((F.count("r").over(w) == m) & (F.count("y").over(w) == m), c)


def autocorrelation(candles: DataFrame, step: int, n: int = 50, lag: int = 1) -> DataFrame:
    """Pearson correlation of the window without its last and without its first `lag` returns."""
    need(lag, 1)
    need(n, lag + 2)
    if lag > 10:
        raise ValueError("a lag of at most 10 is needed")
    rows = rolled(candles, step, n + lag).withColumn("y", F.lag("r", lag).over(order()))
    return finished(rows, autocorr=autocorrelation_value(n, lag))


def variance_ratio_value(n: int, h: int) -> Column:
    """Of rows with r and s, the sum of h returns."""
    w, v, m = last(n), last(n - h + 1), n - h + 1
    mean = F.avg("r").over(w)
    one = F.var_samp("r").over(w)
    many = (F.sum(F.col("s") * F.col("s")).over(v) - 2 * h * mean * F.sum("s").over(v) + m * h * h * mean * mean) / (h * m * (1 - h / n))
    return when_full(F.try_divide(many, F.nullif(one, F.lit(0.0))), w, n, "r")


def variance_ratio(candles: DataFrame, step: int, n: int = 100, h: int = 2) -> DataFrame:
    """Overlapping h-sums of demeaned returns against single returns."""
    need(h, 2)
    need(n, h + 1)
    rows = rolled(candles, step, n + h).withColumn("s", when_full(F.sum("r").over(last(h)), last(h), h, "r"))
    return finished(rows, vr=variance_ratio_value(n, h))


def hurst_variance(candles: DataFrame, step: int, n: int = 100, h: int = 2) -> DataFrame:
    need(h, 2)
    need(n, h + 1)
    rows = rolled(candles, step, n + h).withColumn("s", when_full(F.sum("r").over(last(h)), last(h), h, "r"))
    one, many = F.var_samp("r").over(last(n)), F.var_samp("s").over(last(n - h + 1))
    x = F.when((one > 0) & (many > 0), F.log(many / one) / (2 * math.log(h)))
    return finished(rows, hurst=when_full(x, last(n), n, "r"))


def hurst_rs(candles: DataFrame, step: int, n: int = 64) -> DataFrame:
    """Slope of log rescaled range on log size over non-overlapping chunks of the window, from its start.

    A row holds its window's n returns for a moment; n is a few hundred at most, as sizes end at 256."""
    need(n, 16)
    rows = rescaled_range(rolled(candles, step, n).withColumn("xs", full_list(n)), n)
    return finished(rows, hurst=F.col("hurst"))


def full_list(n: int) -> Column:
    return when_full(F.collect_list("r").over(last(n)), last(n), n, "r")


def rescaled_range(rows: DataFrame, n: int) -> DataFrame:
    """Adds hurst, from xs, the n returns of a window."""
    sizes = [s for s in (8, 16, 32, 64, 128, 256) if s <= n // 2]
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(float("-inf")).alias("hi"), F.lit(float("inf")).alias("lo"), F.lit(0.0).alias("q"))

    def range_over_deviation(x: Column, size: int) -> Column:
        def step_on(mean: Column):
            return lambda s, v: F.struct((s["c"] + v - mean).alias("c"), F.greatest(s["hi"], s["c"] + v - mean).alias("hi"), F.least(s["lo"], s["c"] + v - mean).alias("lo"), (s["q"] + (v - mean) * (v - mean)).alias("q"))

        mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v, lambda s: s / size)
        once = F.array(F.struct(x.alias("x"), mean.alias("m")))  # so that neither is worked out again for each element
        return F.transform(once, lambda t: F.aggregate(t["x"], zero, step_on(t["m"]), lambda s: F.when(s["q"] > 0, (s["hi"] - s["lo"]) / F.sqrt(s["q"] / (size - 1)))))[0]

    def level(size: int) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.lit(n // size)), lambda i: range_over_deviation(F.slice("xs", (i - 1) * size + 1, size), size))
        total = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
        return F.aggregate(parts, total, lambda t, v: F.when(v.isNull(), t).otherwise(F.struct((t["s"] + v).alias("s"), (t["n"] + 1).alias("n"))), lambda t: F.when(t["n"] > 0, F.log(t["s"] / t["n"])))

    for s in sizes:
        rows = rows.withColumn(f"l{s}", level(s))
    mean = sum(math.log(s) for s in sizes) / len(sizes)
    bottom = sum((math.log(s) - mean) ** 2 for s in sizes)
    slope = sum(((math.log(s) - mean) / bottom * F.col(f"l{s}") for s in sizes), F.lit(0.0))
    return rows.withColumn("hurst", F.when(F.col("xs").isNotNull(), slope))


def skewness(candles: DataFrame, step: int, n: int = 20) -> DataFrame:
    """Unbiased; 0 over equal returns."""
    need(n, 3)
    w = last(n)
    g = F.when(F.var_pop("r").over(w) > 0, F.skewness("r").over(w) * math.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    return finished(rolled(candles, step, n), skew=when_full(g, w, n, "r"))


def kurtosis(candles: DataFrame, step: int, n: int = 20) -> DataFrame:
    """Unbiased excess; -3 over equal returns."""
    need(n, 4)
    w = last(n)
    g = F.when(F.var_pop("r").over(w) > 0, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("r").over(w) + 6)).otherwise(-3.0)
    return finished(rolled(candles, step, n), kurtosis=when_full(g, w, n, "r"))


def _rows(candles: DataFrame, step: int) -> DataFrame:
    """Segmented candles with the place of a row in its segment and the close before it."""
    rows = haloed(segmented(candles, step), step, 1).withColumn("before", F.lag("close").over(order())).where("not halo")
    return placed(rows, step)


def placed(rows: DataFrame, step: int) -> DataFrame:
    return rows.withColumn("i", ((F.col("epoch") - F.col("segment")) / step).cast("int"))


def ema_step(n: int) -> tuple[Column, Column]:
    k = 2 / (n + 1)
    return F.when(F.col("i") == 0, 0.0).otherwise(1 - k), F.when(F.col("i") == 0, F.col("close")).otherwise(F.col("close") * k)


def wilder_step(n: int, value: Column, seed: int) -> tuple[Column, Column]:
    """The mean of the first n values, which end at row `seed` of a segment, then smoothed by 1/n."""
    return F.when(F.col("i") == 0, 0.0).when(F.col("i") <= seed, 1.0).otherwise(1 - 1 / n), value / n


def rsi_steps(n: int) -> dict[str, tuple[Column, Column]]:
    change = F.coalesce(F.col("close") - F.col("before"), F.lit(0.0))
    return {"gain": wilder_step(n, F.greatest(change, F.lit(0.0)), n), "loss": wilder_step(n, F.greatest(-change, F.lit(0.0)), n)}


def rsi_value(n: int) -> Column:
    value = F.when((F.col("gain") == 0) & (F.col("loss") == 0), 50.0).otherwise(100 * F.try_divide(F.col("gain"), F.col("gain") + F.col("loss")))
    return F.when(F.col("i") >= n, value)


def ema(candles: DataFrame, step: int, n: int = 14) -> DataFrame:
    need(n, 1)
    return affine(_rows(candles, step), y=ema_step(n)).select("symbol", "epoch", F.when(F.col("i") >= n - 1, F.col("y")).alias("ema"))


def rsi(candles: DataFrame, step: int, n: int = 14) -> DataFrame:
    """Wilder's: the mean of the first n changes, then smoothed by 1/n."""
    need(n, 1)
    return affine(_rows(candles, step), **rsi_steps(n)).select("symbol", "epoch", rsi_value(n).alias("rsi"))


def atr(candles: DataFrame, step: int, n: int = 14) -> DataFrame:
    need(n, 1)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("before")), F.abs(F.col("low") - F.col("before")))
    return affine(_rows(candles, step), y=wilder_step(n, tr, n - 1)).select("symbol", "epoch", F.when(F.col("i") >= n - 1, F.col("y")).alias("atr"))


def annualized(volatility: Column, step: int) -> Column:
    """A volatility of returns over `step` seconds as one of a year."""
    need(step, 1)
    return volatility * math.sqrt(YEAR / step)


def frame(candles: DataFrame, step: int) -> DataFrame:
    """close, rsi, z, ema20, ema50, vol, autocorr, hurst and vr of every candle: one scan, one segmenting, one frame with a halo for
    all windows and one composition for all recursions. Null while a window isn't full."""
    rows = placed(rolled(candles, step, 66).withColumn("before", F.lag("close").over(order())), step)
    rows = rows.withColumn("y", F.lag("r").over(order())).withColumn("s", when_full(F.sum("r").over(last(2)), last(2), 2, "r"))
    columns = {"z": z_value(20), "vol": elapsed_value(step, 20), "autocorr": autocorrelation_value(50, 1), "vr": variance_ratio_value(64, 2), "xs": full_list(64)}
    rows = rows.select("symbol", "chunk", "epoch", "halo", "i", "close", "before", *[c.alias(n) for n, c in columns.items()]).where("not halo").drop("halo")
    rows = affine(rows, **rsi_steps(14), e20=ema_step(20), e50=ema_step(50))
    rows = rescaled_range(rows, 64)
    ready = {"rsi": rsi_value(14), **{f"ema{n}": F.when(F.col("i") >= n - 1, F.col(f"e{n}")) for n in (20, 50)}}
    return rows.select("symbol", "epoch", "close", ready["rsi"].alias("rsi"), "z", ready["ema20"].alias("ema20"), ready["ema50"].alias("ema50"), "vol", "autocorr", "hurst", "vr")
