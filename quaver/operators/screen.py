"""Screen of symbols: features, causal flags, the row on display, and how trades after a flag came out in calibration."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.functions.series import segmented
from quaver.operators import indicators as ind
from quaver.operators import stats
from quaver.operators.trades import Product, forward_trades
from quaver.session import written

#: Names of the flags, in their order.
FLAGS = ["overbought", "stretched", "vol_mismatch", "trending_regime", "mean_reverting_regime"]
#: The last rows of a symbol that are screened, and their parts: 60 % calibrate, 10 % are held out, the rest are shown.
LATEST, CALIBRATION, EVALUATION = 2000, 0.6, 0.1
LEAST_EVENTS = 5
#: Between a symbol and the part of its rows, where parts are series of their own.
MARK = "|"


def registered(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """rows with what the registry says of their symbol; a symbol that it doesn't have raises an error when its row is read."""
    known = symbols.select("symbol", "stated_vol", F.lit(True).alias("_known"))
    name = F.split_part("symbol", F.lit(MARK), F.lit(1))
    rows = rows.withColumn("_name", name).join(known.withColumnRenamed("symbol", "_name"), "_name", "left")
    stated = F.when(F.col("_known"), F.col("stated_vol")).otherwise(F.raise_error(F.concat(F.lit("unregistered symbol: "), F.col("_name"))).cast("double"))
    return rows.withColumn("stated_vol", stated).drop("_name", "_known")


def features(candles: DataFrame, symbols: DataFrame, step: int) -> DataFrame:
    """close, rsi, z, ema20, ema50, vol, autocorr, hurst, vr and vol_ratio at every candle; null while a window isn't full."""
    rows = registered(ind.frame(candles, step), symbols)
    return rows.withColumn("vol_ratio", F.col("vol") / F.col("stated_vol"))


def flags() -> dict[str, Column]:
    c = F.col
    return dict(zip(FLAGS, [
        c("rsi") >= 70, F.abs("z") >= 2, (c("vol_ratio") > 1.5) | (c("vol_ratio") < 0.5),
        F.when(c("hurst").isNotNull() & c("vr").isNotNull(), (c("hurst") > 0.55) & (c("vr") > 1)), F.when(c("hurst").isNotNull() & c("vr").isNotNull(), (c("hurst") < 0.45) & (c("vr") < 1)),
    ], strict=True))


def flagged(candles: DataFrame, symbols: DataFrame, step: int) -> DataFrame:
    """The flags of every candle, null during warm-up."""
    rows = features(candles, symbols, step)
    return rows.select("symbol", "epoch", *[f.alias(n) for n, f in flags().items()])


def causal_flags(candles: DataFrame, symbols: DataFrame, step: int) -> DataFrame:
    """The flags of every candle, false during warm-up."""
    return flagged(candles, symbols, step).na.fill(False, FLAGS)


def latest_rows(candles: DataFrame, n: int) -> DataFrame:
    """The last n candles of each symbol with their rank from the end; tasks hand on n rows of a symbol at most."""
    return candles.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("epoch")))).where(F.col("rank") <= n)


def split(candles: DataFrame, n: int = LATEST, calibration: float = CALIBRATION, evaluation: float = EVALUATION) -> DataFrame:
    """The last n candles of each symbol and their part: calibration, holdout or display."""
    if not 0 < calibration < 1 or not 0 < evaluation < 1 or calibration + evaluation >= 1:
        raise ValueError("calibration and evaluation are fractions that leave a rest")
    rows = latest_rows(candles, n).withColumn("size", F.count("*").over(Window.partitionBy("symbol")))
    at = F.col("size") - F.col("rank")
    part = F.when(at < F.floor(F.col("size") * F.lit(calibration)), "calibration").when(at < F.floor(F.col("size") * F.lit(calibration + evaluation)), "holdout").otherwise("display")
    return rows.withColumn("part", part).drop("rank")


def last_segments(parts: DataFrame, step: int) -> DataFrame:
    """The last contiguous run of calibration and of display rows; a part is a series of its own, named symbol|part."""
    rows = parts.where("part <> 'holdout'").withColumn("symbol", F.concat_ws(MARK, "symbol", "part")).drop("part", "size")
    rows = segmented(rows, step).withColumn("top", F.max("segment").over(Window.partitionBy("symbol")))
    return rows.where("segment = top").drop("chunk", "segment", "top")


def trend() -> Column:
    """The labels."""
    c = F.col
    return (
        F.when(c("ema20").isNull() | c("ema50").isNull(), "insufficient_data")
        .when(c("ema20") > c("ema50"), "ema20_above_ema50").when(c("ema20") < c("ema50"), "ema20_below_ema50").otherwise("ema20_equal_ema50")
    )


def of_part(rows: DataFrame, part: str) -> DataFrame:
    return rows.where(F.col("symbol").endswith(MARK + part)).withColumn("symbol", F.split_part("symbol", F.lit(MARK), F.lit(1)))


def latest(candles: DataFrame, symbols: DataFrame, step: int, n: int = LATEST) -> DataFrame:
    """The row on display of each symbol, from the last contiguous run of display rows: measures, trend, active flags, sizes of the parts."""
    parts = written(split(candles, n))
    rows = features(of_part(last_segments(parts, step), "display"), symbols, step)
    rows = rows.withColumn("trend", trend()).withColumn("flags", F.array_compact(F.array(*[F.when(f, n) for n, f in flags().items()])))
    names = [c for c in rows.columns if c != "symbol"]
    rows = rows.groupBy("symbol").agg(F.max_by(F.struct(*names), "epoch").alias("v")).select("symbol", "v.*")
    sizes = parts.groupBy("symbol").agg(*[F.count(F.when(F.col("part") == p, 1)).alias(f"{p}_candles") for p in ("calibration", "holdout", "display")])
    return rows.join(sizes, "symbol")


#: The contract that reliability is measured with.
PLAIN = Product(stake=1.0, multiplier=1.0, stop_out=1.0)


def calibration_signals(candles: DataFrame, symbols: DataFrame, step: int, product: Product = PLAIN, n: int = LATEST) -> DataFrame:
    """(symbol, epoch, ret, one column for each flag) of the last calibration run: whether a trade follows, and its net return.

    The last row of the run can't be traded: its flags are false and its return is null."""
    rows = written(of_part(last_segments(split(candles, n), step), "calibration"))
    trades = forward_trades(rows, step, F.lit(1.0), 1, product).select("symbol", (F.col("decision") - step).alias("epoch"), (F.col("net") / product.stake).alias("ret"))
    marks = causal_flags(rows, symbols, step).join(trades, ["symbol", "epoch"], "left")
    return written(marks.select("symbol", "epoch", "ret", *[(F.col(f) & F.col("ret").isNotNull()).alias(f) for f in FLAGS]))


def by_flag(signals: DataFrame) -> DataFrame:
    """(symbol, flag, epoch, on, ret)."""
    each = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("on")) for f in FLAGS])
    return signals.select("symbol", "epoch", "ret", F.explode(each).alias("x")).select("symbol", "x.flag", "epoch", "x.on", "ret")


def reliability(signals: DataFrame, least: int = LEAST_EVENTS) -> DataFrame:
    """Long one-candle trades after each flag: count, mean net return and hit rate; null below `least` trades."""
    n, on = F.count(F.when(F.col("on"), 1)), F.when(F.col("on"), F.col("ret"))
    out = by_flag(signals).groupBy("symbol", "flag").agg(n.alias("observations"), F.avg(on).alias("edge"), F.avg((on > 0).cast("double")).alias("hit_rate"))
    enough = F.col("observations") >= least
    return out.select("symbol", "flag", "observations", F.when(enough, F.col("edge")).alias("edge"), F.when(enough, F.col("hit_rate")).alias("hit_rate"))


def seed_hash(seed: int, text: Column) -> Column:
    """seed plus the sum of each character's code times its place."""
    return F.lit(seed) + F.aggregate(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: i * F.ascii(F.substring(text, i, F.lit(1)))), F.lit(0), lambda a, v: a + v)


def shift_p(signals: DataFrame, permutations: int | None = None, seed: int = 0, least: int = LEAST_EVENTS) -> DataFrame:
    """(symbol, flag, p): how often the mean return after a flag is as far from 0 when its row of marks is turned by some rows.

    All turns are tried, or `permutations` drawn from the flag's own seed. A run has LATEST * CALIBRATION rows at most."""
    rows = by_flag(signals).withColumn("seed", seed_hash(seed, F.concat("symbol", "flag")).cast("long"))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("epoch")
        on, ret, n = pdf["on"].to_numpy(bool), pdf["ret"].to_numpy(float), len(pdf)
        p = np.nan
        if on.sum() >= least and n >= 2:
            can, value = np.isfinite(ret), np.nan_to_num(ret)
            turns = np.arange(1, n) if permutations is None else np.random.default_rng(int(pdf["seed"].iloc[0])).integers(1, n, permutations)
            at = (np.flatnonzero(on)[None, :] + turns[:, None]) % n
            many = can[at].sum(1)
            means = np.where(many > 0, value[at].sum(1) / np.maximum(many, 1), 0.0)
            p = (1 + (np.abs(means) >= abs(ret[on].mean()) - 1e-12).sum()) / (len(turns) + 1)
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[:1], "flag": pdf["flag"].iloc[:1], "p": [p]})

    return rows.groupBy("symbol", "flag").applyInPandas(test, "symbol string, flag string, p double").withColumn("p", F.when(~F.isnan("p"), F.col("p")))


def screen(candles: DataFrame, symbols: DataFrame, step: int, product: Product = PLAIN, permutations: int | None = None, seed: int = 0) -> DataFrame:
    """The row on display with a map of each flag's reliability, p value, and p value adjusted over all flags and symbols that have one."""
    signals = calibration_signals(candles, symbols, step, product)
    tests = reliability(signals).join(stats.adjusted(shift_p(signals, permutations, seed)), ["symbol", "flag"], "left")
    found = tests.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("flag", F.struct("observations", "edge", "hit_rate", "p", "q")))).alias("reliability"))
    return latest(candles, symbols, step).join(found, "symbol", "left")


def as_json(rows: DataFrame) -> DataFrame:
    """(symbol, json): a row as JSON text, in which what isn't a finite number is null."""
    safe = {c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(None)).otherwise(F.col(c)) for c, t in rows.dtypes if t == "double"}
    return rows.withColumns(safe).select("symbol", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def causality(candles: DataFrame, symbols: DataFrame, step: int, cuts: int = 50, flags_of: Callable = flagged) -> DataFrame:
    """(symbol, cuts, compared, differing): whether the flags of a candle change when later candles are taken away.

    Each symbol's time is cut at `cuts` even points; what is before a cut is a series of its own, named symbol|cut, so one plan
    works out the flags of all prefixes, and each row of each prefix is compared with the same row of the whole series."""
    ends = candles.groupBy("symbol").agg(F.min("epoch").alias("_low"), F.max("epoch").alias("_high"))
    cut = F.col("_low") + F.floor((F.col("_high") - F.col("_low")) * F.col("_k") / cuts)
    rows = candles.join(ends, "symbol").withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(cuts)))).where(F.col("epoch") <= cut)
    rows = rows.withColumn("symbol", F.concat_ws(MARK, "symbol", "_k")).drop("_low", "_high", "_k")
    part = flags_of(rows, symbols, step).withColumn("symbol", F.split_part("symbol", F.lit(MARK), F.lit(1)))
    whole = flags_of(candles, symbols, step).select("symbol", "epoch", F.struct(*FLAGS).alias("_whole"))
    same = F.struct(*FLAGS).eqNullSafe(F.col("_whole"))
    return part.join(whole, ["symbol", "epoch"]).groupBy("symbol").agg(F.lit(cuts).alias("cuts"), F.count("*").alias("compared"), F.count(F.when(~same, 1)).alias("differing"))
