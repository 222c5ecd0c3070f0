"""Settlement of trades on candles, and reports over them.

A decision at candle t enters at the open of t + 1 and leaves at the close of t + h; all candles between are contiguous.
Trades are made at the row of their exit, from rows before it, so that chunks with a halo suffice; one frame serves all
horizons. A decision and an exit are told by the second at which their candle closes, an entry by its candle's epoch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quaver.functions.dist import NORMAL
from quaver.functions.series import chunk_of, haloed, last, order, segmented
from quaver.operators import quality, resampling, stats
from quaver.operators.indicators import YEAR
from quaver.session import written


@dataclass(frozen=True)
class Product:
    """Contract terms."""

    kind: str = "multiplier"
    stake: float = 10.0
    multiplier: float = 5.0
    stop_out: float = 1.0
    payout: float = 0.95
    commission: float = 0.0
    spread: float = 0.0

    def __post_init__(self) -> None:
        if self.kind not in ("multiplier", "fixed_payout") or self.stake <= 0 or self.multiplier <= 0 or not 0 < self.stop_out <= 1 or self.payout <= 0 or min(self.commission, self.spread) < 0:
            raise ValueError(f"not a product: {self}")


def validated(candles: DataFrame, place: str | None = None, single: bool = False) -> DataFrame:
    """The candles, written; ValueError with the first bad row if prices aren't above 0 and finite, an epoch of a symbol comes again or,
    in the order of the column `place`, doesn't rise, granularities are mixed, or, where a single one is asked for, symbols are.

    The checks are metrics of the write, so the candles are read once."""
    rows = candles
    if place is None:
        rows = rows.withColumn("_bad", F.count("*").over(Window.partitionBy("symbol", "epoch")) > 1)
    else:
        rows = quality.with_previous(rows, place, quality.ARRIVALS, "epoch").withColumn("_bad", F.coalesce(F.col("epoch") <= F.col("previous_epoch"), F.lit(False))).drop("previous_epoch")
    price = F.lit(False)
    for c in ("open", "high", "low", "close"):
        price = price | ~F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.lit(False))
    row, grain = F.struct("symbol", "epoch"), F.col("granularity") if "granularity" in candles.columns else F.lit(1)
    seen = Observation()
    rows = rows.observe(
        seen, F.min(F.when(F.col("_bad"), row)).alias("epoch"), F.min(F.when(price, row)).alias("price"), F.min("symbol").alias("first"), F.max("symbol").alias("last"),
        F.min(grain).alias("fine"), F.max(grain).alias("coarse"),
    )
    out = written(rows.drop("_bad"))
    found = seen.get
    if found["fine"] != found["coarse"]:
        raise ValueError(f"granularities are mixed: {found['fine']} and {found['coarse']}")
    if found["fine"] is not None and found["fine"] <= 0:
        raise ValueError("a granularity is above 0")
    if single and found["first"] != found["last"]:
        raise ValueError(f"symbols are mixed: {found['first']} and {found['last']}")
    for what, says in (("epoch", "epochs don't rise"), ("price", "prices aren't above 0")):
        if found[what] is not None:
            raise ValueError(f"{says}: {found[what]['symbol']} at {found[what]['epoch']}")
    return out


def body_signal() -> Column:
    """1 for a rising candle, -1 for a falling one, else 0."""
    return F.signum(F.col("close") - F.col("open"))


def paths(candles: DataFrame, step: int, horizons: tuple[int, ...], *carried: str) -> DataFrame:
    """(symbol, segment, at, last, horizon, entry, exit, low, high and the carried columns of the decision) of every candle and horizon.

    at and last are the epochs of the candles of decision and exit."""
    for h in horizons:
        if isinstance(h, bool) or not isinstance(h, int) or h <= 0:
            raise ValueError(f"a horizon is a whole number above 0, not {h!r}")
    rows, o = haloed(segmented(candles, step), step, max(horizons) + 1), order()
    each = [
        F.struct(
            F.lit(h).alias("horizon"), F.lag("epoch", h).over(o).alias("at"), F.lag("open", h - 1).over(o).alias("entry"), F.min("low").over(last(h)).alias("low"), F.max("high").over(last(h)).alias("high"),
            *[F.lag(c, h).over(o).alias(c) for c in carried],
        )
        for h in horizons
    ]
    rows = rows.select("symbol", "segment", "halo", F.col("epoch").alias("last"), F.col("close").alias("exit"), F.array(*each).alias("x")).where("not halo")
    return rows.select("symbol", "segment", "last", "exit", F.explode("x").alias("x")).select("symbol", "segment", "last", "exit", "x.*").where("at is not null and entry > 0")


def settled(rows: DataFrame, step: int, product: Product) -> DataFrame:
    """Trades of (path, direction) rows: gross and net results, costs, reason and whether they won before and after costs."""
    sign, entry = F.col("direction"), F.col("entry")
    move = sign * (F.col("exit") - entry) / entry
    if product.kind == "multiplier":
        notional, limit = product.stake * product.multiplier, product.stake * product.stop_out
        worst = sign * (F.when(sign > 0, F.col("low")).otherwise(F.col("high")) - entry) / entry
        out = notional * worst <= -limit
        gross, reason = F.when(out, -limit).otherwise(notional * move), F.when(out, "stop_out").otherwise("bar_close")
        leave = F.when(out, entry * (1 - sign * product.stop_out / product.multiplier)).otherwise(F.col("exit"))
        gross_won = gross > 0
    else:
        notional, leave, gross_won = product.stake, F.col("exit"), move > 0
        gross, reason = F.when(gross_won, product.stake * product.payout).otherwise(-product.stake), F.lit("bar_close")
    spread = notional * product.spread
    return rows.withColumns({"gross": gross, "leave": leave, "reason": reason, "gross_won": gross_won}).withColumns(
        {"decision": F.col("at") + step, "entry_epoch": F.col("at") + step, "exit_epoch": F.col("last") + step, "exit": F.col("leave"), "commission": F.lit(product.commission), "spread_cost": F.lit(spread),
         "net": F.col("gross") - product.commission - spread}
    ).withColumn("won", F.col("net") > 0)


TRADE = ["symbol", "decision", "entry_epoch", "exit_epoch", "direction", "entry", "exit", "gross", "commission", "spread_cost", "net", "reason", "won", "gross_won"]


def forward_trades(candles: DataFrame, step: int, signal: Column, horizon: int, product: Product) -> DataFrame:
    """The trades of every candle whose signal is a number other than 0; its sign is the direction."""
    rows = paths(candles.withColumn("signal", signal.cast("double")), step, (horizon,), "signal")
    rows = rows.where("signal <> 0 and not isnan(signal)").withColumn("direction", F.signum("signal"))
    return settled(rows, step, product).select(*TRADE)


def strided_trades(candles: DataFrame, step: int, signal: Column, horizon: int, product: Product) -> DataFrame:
    """Trades at every `horizon`-th candle of a symbol, counted from its first."""
    rows = numbered(candles.withColumn("signal", signal.cast("double")), step, ["symbol"])
    return forward_trades(rows, step, F.when(F.col("at") % horizon == 0, F.col("signal")).otherwise(0.0), horizon, product)


def numbered(rows: DataFrame, step: int, keys: list[str]) -> DataFrame:
    """Adds at, a row's number from 0 by epoch among its keys: its number in its chunk plus the rows of chunks before."""
    rows = rows.withColumn("_chunk", chunk_of(step))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*keys, "_chunk").agg(F.count("*").alias("_c")).select(*keys, "_chunk", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy("epoch"))
    return rows.withColumn("_in", inside).join(base, [*keys, "_chunk"]).withColumn("at", F.col("_base") + F.col("_in") - 1).drop("_chunk", "_base", "_in")


def break_even_rate(product: Product) -> float | None:
    """The share of wins at which a fixed payout gains nothing after costs; a multiplier has none."""
    if product.kind != "fixed_payout":
        return None
    return (product.stake + product.commission + product.stake * product.spread) / (product.stake * (1 + product.payout))


#: Euler's constant.
GAMMA = 0.5772156649015329


def expected_maximum(trials: int) -> float:
    """Of the Sharpe ratios of so many independent trials without an edge."""
    if isinstance(trials, bool) or not isinstance(trials, int) or trials < 1:
        raise ValueError("trials must be a whole number above 0")
    return 0.0 if trials == 1 else (1 - GAMMA) * NORMAL.inv_cdf(1 - 1 / trials) + GAMMA * NORMAL.inv_cdf(1 - 1 / (trials * math.e))


def deflated_z(value: Column, trials: int) -> Column:
    """An aggregate: z of the probability that a Sharpe ratio beats the best of so many trials; null where values don't vary."""
    n, sd = F.count(value), F.stddev_samp(value)
    sharpe, skew, kurtosis = F.avg(value) / sd, F.skewness(value), F.kurtosis(value) + 3
    spread = 1 - skew * sharpe + (kurtosis - 1) * sharpe * sharpe / 4
    z = (sharpe - expected_maximum(trials)) * F.sqrt(n - F.lit(1.0)) / F.sqrt(F.when(spread > 0, spread))
    return F.when((n > 1) & (sd > 2.220446049250313e-16 * F.greatest(F.lit(1.0), F.max(F.abs(value)))), z)


def deflated_sharpe(trades: DataFrame, stake: float, trials: int, keys: list[str]) -> DataFrame:
    """(keys, observations, z, deflated_sharpe): one half where a ratio isn't told."""
    each = F.col("net") / stake
    rows = trades.groupBy(*keys).agg(F.count("net").alias("observations"), deflated_z(each, trials).alias("z"))
    return rows.withColumn("deflated_sharpe", F.coalesce(stats.normal_cdf("z"), F.lit(0.5)))


def report(candles: DataFrame, trades: DataFrame, step: int, product: Product, keys: list[str] | None = None, trials: int = 1) -> DataFrame:
    """Totals of a backtest; the Sharpe ratio is over all candles evaluated, with 0 where no trade enters.

    candles has the keys' columns (symbol by default); gaps between candles of the same keys are counted."""
    keys = keys or ["symbol"]
    rows = quality.with_previous(candles.select(*keys, "epoch"), "epoch", step * 1024, "epoch", keys=keys)
    missing = F.greatest(F.lit(0), F.ceil((F.col("epoch") - F.col("previous_epoch")) / step) - 1).cast("long")
    rows = rows.join(trades.select("symbol", F.col("entry_epoch").alias("epoch"), "net"), ["symbol", "epoch"], "left")
    each, net = F.coalesce("net", F.lit(0.0)) / product.stake, F.col("net")
    sd = F.stddev_samp(each)
    need = break_even_rate(product)
    return rows.groupBy(*keys).agg(
        F.count("net").alias("observations"), F.count("*").alias("period_observations"), F.coalesce(F.sum(missing), F.lit(0)).alias("gap_count"), F.coalesce(F.sum("net"), F.lit(0.0)).alias("net"),
        F.coalesce(F.avg("net"), F.lit(0.0)).alias("expectancy"), F.coalesce(F.stddev_samp("net"), F.lit(0.0)).alias("sd_net"), F.coalesce(F.try_divide(F.count(F.when(net > 0, 1)), F.count("net")), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.try_divide(F.avg(each), F.nullif(sd, F.lit(0.0))) * math.sqrt(YEAR / step), F.lit(0.0)).alias("sharpe"), F.lit(need).cast("double").alias("break_even_win_rate"),
        deflated_z(net / product.stake, trials).alias("deflated_z"),
    )


def drawdown(trades: DataFrame, step: int, equity: float, keys: list[str] | None = None) -> DataFrame:
    """Largest relative fall from a peak of equity; running sums and peaks are chained over chunks."""
    if equity <= 0:
        raise ValueError("equity must be above 0")
    keys = keys or ["symbol"]
    rows = trades.select(*keys, F.col("decision").alias("epoch"), "net").withColumn("chunk", chunk_of(step))
    inside = Window.partitionBy(*keys, "chunk").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)

    def carried(value: Column, how) -> DataFrame:
        ends = rows.groupBy(*keys, "chunk").agg(value.alias("v"))
        return ends.select(*keys, "chunk", how("v").over(before).alias("carried"))

    rows = rows.join(carried(F.sum("net"), F.sum), [*keys, "chunk"]).withColumn("equity", equity + F.coalesce("carried", F.lit(0.0)) + F.sum("net").over(inside)).drop("carried")
    rows = rows.join(carried(F.max("equity"), F.max), [*keys, "chunk"]).withColumn("peak", F.greatest(F.lit(equity), F.col("carried"), F.max("equity").over(inside)))
    return rows.groupBy(*keys).agg(F.max((F.col("peak") - F.col("equity")) / F.col("peak")).alias("drawdown"))


def walk_forward(candles: DataFrame, trades: DataFrame, step: int, product: Product, train: int, test: int, stride: int | None = None, equity: float = 10_000.0, trials: int = 1) -> DataFrame:
    """The report of each fold of a symbol, and with fold null of all folds together; drawdown is that of the worst fold there.

    Folds don't overlap, so a candle's fold follows from its number: no join of candles with ranges. A trade counts in the fold
    in which it enters; trades: those of one candle, of all candles."""
    stride = test if stride is None else stride
    if min(train, test, stride) <= 0 or stride < test:
        raise ValueError("train, test and stride must be above 0, and stride no less than test")
    place = F.col("at") - train
    rows = numbered(candles, step, ["symbol"]).where((place >= 0) & (place % stride < test)).withColumn("fold", F.floor(place / stride).cast("int"))
    mine = trades.join(rows.select("symbol", F.col("epoch").alias("entry_epoch"), "fold"), ["symbol", "entry_epoch"])
    falls = drawdown(mine, step, equity, ["symbol", "fold"])
    folds = report(rows, mine, step, product, ["symbol", "fold"], trials).join(falls, ["symbol", "fold"], "left").withColumn("drawdown", F.coalesce("drawdown", F.lit(0.0)))
    inner = folds.groupBy("symbol").agg(F.sum("gap_count").alias("gap_count"), F.max("drawdown").alias("drawdown"))
    whole = report(rows, mine, step, product, ["symbol"], trials).drop("gap_count").join(inner, "symbol").withColumn("fold", F.lit(None).cast("int"))
    return folds.unionByName(whole)


def reality_check(rows: DataFrame, step: int, replications: int, seed: int, block: int = 1) -> DataFrame:
    """(observed, p, strategies): the best mean of (strategy, epoch, value) rows against that of centered rows resampled in circular blocks.

    All strategies of a replication are resampled alike. The sum of a block is a difference of running sums, so no task
    holds a series; a replication's blocks come from (seed, replication)."""
    if min(replications, block) <= 0:
        raise ValueError("replications and block must be above 0")
    running, sizes = resampling.running_sums(rows, step, ["strategy"], "value")
    shape = sizes.agg(F.min("n").alias("least"), F.max("n").alias("n")).first()
    if shape.n is None or shape.n != shape.least or shape.n < 2 or block > shape.n:
        raise ValueError("strategies must have the same two or more times, and a block no more of them")
    n = int(shape.n)

    def blocks(parts):
        for pdf in parts:
            out = []
            for replication in pdf["replication"]:
                left = n
                for start in np.random.default_rng([seed, int(replication)]).integers(0, n, -(-n // block)).tolist():
                    size = min(block, left)
                    left -= size
                    turns, end = divmod(start + size, n)
                    out.append((replication, start, end, turns))
            yield pd.DataFrame(out, columns=["replication", "start", "end", "turns"])

    drawn = rows.sparkSession.range(replications).select(F.col("id").cast("int").alias("replication")).mapInPandas(blocks, "replication int, start long, end long, turns long")
    drawn = drawn.withColumn("strategy", F.explode(F.array(*[F.lit(r.strategy) for r in sizes.select("strategy").collect()])))
    means = resampling.block_means(drawn.join(sizes, "strategy"), running, ["strategy"])
    centered = means.join(sizes.select("strategy", (F.col("total") / F.col("n")).alias("own")), "strategy").groupBy("replication").agg(F.max(F.col("mean") - F.col("own")).alias("best"))
    best = sizes.agg(F.max(F.col("total") / F.col("n")).alias("observed"), F.count("*").alias("strategies")).first()
    p = (1 + F.count(F.when(F.col("best") >= best.observed, 1))) / (replications + 1)
    return centered.agg(F.lit(best.observed).alias("observed"), p.alias("p"), F.lit(best.strategies).cast("long").alias("strategies"))


def walk_forward_splits(counts: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """(symbol, fold, train_end, test_start, test_end) of expanding folds over n rows; the last is cut off."""
    starts = F.when(F.col("n") > train, F.sequence(F.lit(train).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>"))
    rows = counts.select("symbol", "n", F.posexplode(starts).alias("fold", "train_end"))
    return rows.select("symbol", "fold", "train_end", F.col("train_end").alias("test_start"), F.least(F.col("train_end") + test, F.col("n")).alias("test_end"))
