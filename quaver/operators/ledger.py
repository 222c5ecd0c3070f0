"""Forward-test ledger: calls of four strategies, their outcomes and the tallies; position sizes and the loss breaker."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.operators import stats
from quaver.operators.trades import Product

#: Fixed value: seconds after its record at which a call that still waits becomes void.
EXPIRY = 3 * 86_400
#: Payout assumed, scored calls before a verdict, level of significance, candles of a call, results kept.
PAYOUT, LEAST_CALLS, ALPHA, HORIZON, RECENT = 0.95, 200, 0.05, 5, 100
#: The strategies; the coin is a control and no part of the family that is corrected for.
STRATEGIES = ("trend", "reversion", "rsi", "coin")
REAL = len(STRATEGIES) - 1
#: The verdicts.
COLLECTING, NO_EDGE, EDGE, CONTROL = "collecting data", "no edge detected", "edge detected", "control"


def rules() -> dict[str, Column]:
    """1 for long, -1 for short, else null, by strategy, from the columns of a screen row."""
    c = F.col
    coin = F.conv(F.substring(F.sha2(F.concat_ws(":", "symbol", "epoch"), 256), 1, 2), 16, 10).cast("int") % 2
    return dict(zip(STRATEGIES, (
        F.when(c("ema20") > c("ema50"), 1).when(c("ema20") < c("ema50"), -1), F.when(c("z") <= -1, 1).when(c("z") >= 1, -1), F.when(c("rsi") < 30, 1).when(c("rsi") > 70, -1), F.when(coin == 0, 1).otherwise(-1),
    ), strict=True))


def directions(features: DataFrame) -> DataFrame:
    """(symbol, epoch, strategy, direction) for each strategy that calls."""
    each = F.array(*[F.struct(F.lit(n).alias("strategy"), d.alias("direction")) for n, d in rules().items()])
    return features.select("symbol", "epoch", F.explode(F.filter(each, lambda x: x["direction"].isNotNull())).alias("x")).select("symbol", "epoch", "x.strategy", "x.direction")


def recorded(features: DataFrame, known: DataFrame, step: int, now: int) -> DataFrame:
    """The new calls of rows whose entry candle hasn't opened by `now`, each once: those whose id is known are left out."""
    calls = directions(features.where(F.col("epoch") + step > now)).withColumn("id", F.concat_ws("|", "symbol", "strategy", "epoch"))
    return calls.dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti").withColumn("recorded", F.lit(now).cast("long"))


def scored(calls: DataFrame, candles: DataFrame, step: int, horizon: int = HORIZON, now: int | None = None) -> DataFrame:
    """win, loss (a flat path too), void (a missing candle) or pending (its last candle not closed by `now`) for each call.

    Entry is at the next open, exit `horizon` closes on. A call that has the epoch at which it was recorded becomes void if it
    still waits EXPIRY seconds after."""
    entry = candles.select("symbol", (F.col("epoch") - step).alias("epoch"), F.col("open").alias("entry"))
    leave = candles.select("symbol", (F.col("epoch") - horizon * step).alias("epoch"), F.col("close").alias("exit"))
    rows = calls.join(entry, ["symbol", "epoch"], "left").join(leave, ["symbol", "epoch"], "left")
    move = F.col("direction") * (F.col("exit") - F.col("entry"))
    waiting = F.lit(False) if now is None else F.col("epoch") + (horizon + 1) * step > now
    if now is not None and "recorded" in calls.columns:
        late = waiting & (F.lit(now) - F.col("recorded") > EXPIRY)
        rows = rows.withColumns({c: F.when(~late, F.col(c)) for c in ("entry", "exit")})
        waiting, move = waiting & ~late, F.when(~late, move)
    return rows.withColumn("outcome", F.when(waiting, "pending").when(move.isNull(), "void").when(move > 0, "win").otherwise("loss"))


def recent(rows: DataFrame, n: int = RECENT) -> DataFrame:
    """The last n calls that are decided."""
    return rows.where("outcome <> 'pending'").orderBy(F.desc("epoch"), "symbol", "strategy").limit(n)


def summary(rows: DataFrame) -> DataFrame:
    """Tallies of every strategy, the exact one-sided p of its wins against break-even, corrected for the real strategies, and the verdict."""
    wins, n = F.count(F.when(F.col("outcome") == "win", 1)), F.count(F.when(F.col("outcome").isin("win", "loss"), 1))
    need = 1 / (1 + PAYOUT)
    names = rows.sparkSession.createDataFrame([(s,) for s in STRATEGIES], "strategy string")
    out = rows.groupBy("strategy").agg(n.alias("calls"), wins.alias("wins"), F.count(F.when(F.col("outcome") == "void", 1)).alias("voids"), F.count(F.when(F.col("outcome") == "pending", 1)).alias("pending"), F.try_divide(wins, n).alias("hit_rate"))
    out = names.join(out, "strategy", "left").na.fill(0, ["calls", "wins", "voids", "pending"]).withColumn("break_even", F.lit(need))
    out = out.withColumn("p", F.when(F.col("calls") > 0, stats.binomial_sf("wins", "calls", F.lit(need)))).withColumn("adjusted_p", F.least(F.lit(1.0), F.col("p") * REAL))
    verdict = F.when(F.col("strategy") == "coin", CONTROL).when(F.col("calls") < LEAST_CALLS, COLLECTING).when(F.col("adjusted_p") < ALPHA, EDGE).otherwise(NO_EDGE)
    return out.withColumn("adjusted_p", F.when(F.col("p").isNotNull(), F.col("adjusted_p"))).withColumn("verdict", verdict)


def loss_share(product: Product) -> float:
    """What a unit of stake can lose, commission left out."""
    return product.stop_out + product.multiplier * product.spread if product.kind == "multiplier" else 1 + product.spread


def stake_for(budget: float, product: Product) -> float:
    stake = (budget - product.commission) / loss_share(product)
    if stake <= 0:
        raise ValueError("a budget of risk must exceed the commission")
    return stake


def _fractions(*values: float) -> None:
    if any(not math.isfinite(v) or not 0 < v <= 1 for v in values):
        raise ValueError("a fraction of risk is above 0 and at most 1")


def sizes(symbols: DataFrame, equity: float, target: float, product: Product, fraction: float, most: float = 0.02) -> DataFrame:
    """Stakes by volatility target and by fixed fraction of equity, each capped where it risks more than `most` of the equity.

    risk is the share of equity that a stake can lose; requested that of the stake before the cap."""
    _fractions(fraction, most)
    if product.kind != "multiplier" or min(equity, target) <= 0:
        raise ValueError("a volatility target needs a multiplier, equity and a target above 0")
    share, cap = loss_share(product), stake_for(equity * most, product)
    risk = lambda stake: (stake * share + product.commission) / equity
    free = F.lit(equity * target) / (F.col("stated_vol") * product.multiplier)
    rows = symbols.withColumn("vol_target_requested", risk(free)).withColumn("vol_target_stake", F.when(risk(free) <= most, free).otherwise(cap))
    fixed = stake_for(equity * min(fraction, most), product)
    return rows.select(
        "symbol", "vol_target_stake", "vol_target_requested", risk(F.col("vol_target_stake")).alias("vol_target_risk"), (F.col("vol_target_stake") * product.multiplier * F.col("stated_vol") / equity).alias("expected_volatility"),
        F.lit(fixed).alias("fixed_fraction_stake"), F.lit(fraction > most).alias("fixed_fraction_capped"), (F.col("vol_target_stake") * share + product.commission).alias("max_loss"),
    )


def kelly(rates: DataFrame, ratio: float, fraction: float, cap: float, equity: float | None = None, product: Product | None = None) -> DataFrame:
    """The share of equity to risk by a fraction of Kelly's rule, capped; with equity and a product also the stake that risks as
    much, its share of equity, its risk and whether the cap holds. A share that the commission uses up is an error."""
    _fractions(fraction, cap)
    full = F.greatest(F.lit(0.0), F.col("win_rate") - (1 - F.col("win_rate")) / ratio)
    rows = rates.select("symbol", (full * fraction).alias("requested"), F.least(full * fraction, F.lit(cap)).alias("applied"))
    if equity is None or product is None:
        return rows
    if not math.isfinite(equity) or equity <= 0:
        raise ValueError("equity is above 0")
    some, free = F.col("applied") > 0, (F.col("applied") * equity - product.commission) / loss_share(product)
    stake = F.when(some & (free <= 0), F.raise_error(F.lit("a budget of risk must exceed the commission")).cast("double")).when(some, free).otherwise(0.0)
    rows = rows.withColumn("stake", stake).withColumn("equity_fraction", F.col("stake") / equity)
    return rows.withColumn("risk", F.when(some, (F.col("stake") * loss_share(product) + product.commission) / equity).otherwise(0.0)).withColumn("capped", F.col("requested") > cap)


def with_day(trades: DataFrame) -> DataFrame:
    """Adds day, that of UTC."""
    return trades.withColumn("day", F.floor(F.col("exit_epoch") / 86_400))


def breaker(trades: DataFrame, limit: float, streak: int) -> DataFrame:
    """The state after every trade if none were skipped: running result of its UTC day, losses in a row, and why it would halt.

    The day's sum begins anew each day. Losses in a row go on over days: each day's are those since its last gain, and days
    without a gain add to those of the days before."""
    if limit <= 0 or streak <= 0:
        raise ValueError("a limit above 0 and a streak of at least 1 are needed")
    day = Window.partitionBy("symbol", "day").orderBy("exit_epoch").rowsBetween(Window.unboundedPreceding, 0)
    rows = with_day(trades).withColumn("lost", (F.col("net") < 0).cast("int"))
    rows = rows.withColumn("daily_net", F.sum("net").over(day)).withColumn("gains", F.sum(1 - F.col("lost")).over(day))
    since = Window.partitionBy("symbol", "day", "gains").orderBy("exit_epoch").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.sum("lost").over(since))
    ends = rows.groupBy("symbol", "day").agg(F.max("gains").alias("g"), F.max_by("own", "exit_epoch").alias("tail"))
    before = Window.partitionBy("symbol").orderBy("day")
    ends = ends.withColumn("spell", F.sum(F.when(F.col("g") > 0, 1).otherwise(0)).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    spell = Window.partitionBy("symbol", "spell").orderBy("day")
    ends = ends.withColumn("run", F.sum("tail").over(spell.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.select("symbol", "day", F.coalesce(F.lag("run").over(before), F.lit(0)).alias("carried"))
    rows = rows.join(ends, ["symbol", "day"]).withColumn("losses", F.col("own") + F.when(F.col("gains") == 0, F.col("carried")).otherwise(0))
    why = F.array_compact(F.array(F.when(F.col("daily_net") <= -limit, "daily-loss-limit"), F.when(F.col("losses") >= streak, "consecutive-loss-limit")))
    return rows.select("symbol", "exit_epoch", "day", "net", "daily_net", F.col("losses").cast("long").alias("losses"), F.concat_ws(",", why).alias("reasons"))


def breaker_fold(trades: DataFrame, limit: float, streak: int) -> DataFrame:
    """(symbol, exit_epoch, taken, daily_net, losses) of the breaker at work: trades while it is halted are skipped and count for nothing.

    A day's trades turn the losses in a row it begins with into those it ends with; as there are only `streak` of them, each
    day is summed up as a table, the tables are chained, one row a day, and each day is then run from what it begins with."""
    if limit <= 0 or streak <= 0:
        raise ValueError("a limit above 0 and a streak of at least 1 are needed")

    def run(nets: list[float], losses: int) -> list[tuple]:
        total, out = 0.0, []
        for net in nets:
            taken = total > -limit and losses < streak
            if taken:
                total, losses = total + net, losses + 1 if net < 0 else 0
            out.append((taken, total, losses))
        return out

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        nets = pdf.sort_values("exit_epoch")["net"].tolist()
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[:1], "day": pdf["day"].iloc[:1], "ends": [[run(nets, s)[-1][2] for s in range(streak + 1)]]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        at, begins = 0, []
        pdf = pdf.sort_values("day", ignore_index=True)
        for ends in pdf["ends"]:
            begins.append(at)
            at = int(ends[at])
        return pdf[["symbol", "day"]].assign(begins=begins)

    def day(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("exit_epoch", ignore_index=True)
        out = run(pdf["net"].tolist(), int(pdf["begins"].iloc[0]))
        return pd.DataFrame({"symbol": pdf["symbol"], "exit_epoch": pdf["exit_epoch"], "taken": [x[0] for x in out], "daily_net": [x[1] for x in out], "losses": [x[2] for x in out]})

    rows = with_day(trades).select("symbol", "day", "exit_epoch", "net")
    begins = rows.groupBy("symbol", "day").applyInPandas(table, "symbol string, day long, ends array<int>").groupBy("symbol").applyInPandas(chain, "symbol string, day long, begins int")
    return rows.join(begins, ["symbol", "day"]).groupBy("symbol", "day").applyInPandas(day, "symbol string, exit_epoch long, taken boolean, daily_net double, losses int")
