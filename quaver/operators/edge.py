"""Edge research: outcomes of non-overlapping trades, one row for each hypothesis, pooled rows, break-even.

A hypothesis is (flag, horizon, direction, split) of one symbol, or of all. Candidates stand at every `horizon`-th candle
of a contiguous run inside a split; the first 70 % of a symbol's candles are for discovery, the rest for confirmation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.functions import shifts
from quaver.operators import ledger, quality, resampling, screen, stats
from quaver.operators.trades import Product, numbered, paths, settled
from quaver.session import written

HORIZONS, DISCOVERY = (1, 5, 15), 0.7
DIRECTIONS = {"long": 1.0, "short": -1.0}
SPLITS = ("discovery", "confirmation")
KEYS = ["flag", "horizon", "direction", "split"]
#: Seconds of a part of a series whose candidates a task numbers.
SPAN = 1 << 26


def split_starts(candles: DataFrame, step: int) -> DataFrame:
    """(symbol, boundary): the epoch of the first candle for confirmation; null where there is none."""
    rows = numbered(candles.select("symbol", "epoch"), step, ["symbol"])
    n = candles.groupBy("symbol").agg(F.count("*").alias("n"))
    return rows.join(n, "symbol").groupBy("symbol").agg(F.min(F.when(F.col("at") >= F.floor(F.col("n") * DISCOVERY), F.col("epoch"))).alias("boundary"))


def candidates(candles: DataFrame, step: int, product: Product, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(symbol, decision, run, horizon, direction, split, gross, net in basis points of the stake); decision is the epoch of its candle.

    One frame of paths serves all horizons; a direction is a sign."""
    rows = paths(candles, step, horizons).join(split_starts(candles, step), "symbol")
    late = F.coalesce(F.col("at") >= F.col("boundary"), F.lit(False))
    begin = F.when(late, F.greatest("segment", "boundary")).otherwise(F.col("segment"))
    apart = (F.col("at") - begin) % (F.col("horizon") * step) == 0
    inside = late | F.col("boundary").isNull() | (F.col("last") < F.col("boundary"))
    rows = rows.withColumn("split", F.when(late, SPLITS[1]).otherwise(SPLITS[0])).withColumn("run", begin).where(apart & inside)
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("sign")) for n, v in DIRECTIONS.items()]))
    rows = rows.withColumn("side", sides).withColumn("direction", F.col("side.sign"))
    scale = 10_000 / product.stake
    return settled(rows, step, product).select(
        "symbol", F.col("at").alias("decision"), "run", "horizon", F.col("side.name").alias("direction"), "split", (F.col("gross") * scale).alias("gross"), (F.col("net") * scale).alias("net")
    )


def marked(candles: DataFrame, symbols: DataFrame, step: int) -> DataFrame:
    """(symbol, decision, flags): the active flags of every candle that has one, written once for all that is asked of them."""
    active = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in screen.FLAGS]))
    return written(screen.flagged(candles, symbols, step).select("symbol", F.col("epoch").alias("decision"), active.alias("flags")).where(F.size("flags") > 0))


def flagged_candidates(candles: DataFrame, symbols: DataFrame, step: int, product: Product, marks: DataFrame | None = None) -> DataFrame:
    rows = candidates(candles, step, product).join(marked(candles, symbols, step) if marks is None else marks, ["symbol", "decision"])
    return rows.withColumn("flag", F.explode("flags")).drop("flags")


def outcomes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, means and the hit rate (ties left out) of each hypothesis that has a trade."""
    wins, real = F.count(F.when(F.col("net") > 0, 1)), F.count(F.when(F.col("net") != 0, 1))
    return rows.groupBy(*keys, *KEYS).agg(
        F.count("net").alias("n_effective"), real.alias("n_non_tied"), wins.alias("wins"), F.avg("gross").alias("gross_mean_bps"), F.avg("net").alias("net_mean_bps"), F.try_divide(wins, real).alias("hit_rate"),
    )


def signals(candles: DataFrame, step: int, marks: DataFrame) -> DataFrame:
    """(symbol, flag, split, n_signals): flagged candles, whether a trade follows or not."""
    rows = marks.join(split_starts(candles, step), "symbol")
    late = F.coalesce(F.col("decision") >= F.col("boundary"), F.lit(False))
    rows = rows.withColumn("split", F.when(late, SPLITS[1]).otherwise(SPLITS[0])).withColumn("flag", F.explode("flags"))
    return rows.groupBy("symbol", "flag", "split").agg(F.count("*").alias("n_signals"))


def grid(candles: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Every hypothesis of every symbol, with a trade or without."""
    rows = candles.select("symbol").distinct()
    for name, values in zip(KEYS, (screen.FLAGS, horizons, DIRECTIONS, SPLITS), strict=True):
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return rows


def hypotheses(candles: DataFrame, symbols: DataFrame, step: int, product: Product, marks: DataFrame | None = None) -> DataFrame:
    """Every hypothesis of every symbol and, as symbol ALL, of all together; those without trades have counts of 0 and null means."""
    both, marks = F.explode(F.array("symbol", F.lit("ALL"))), marked(candles, symbols, step) if marks is None else marks
    found = outcomes(flagged_candidates(candles, symbols, step, product, marks).withColumn("symbol", both), ["symbol"])
    many = signals(candles, step, marks).withColumn("symbol", both).groupBy("symbol", "flag", "split").agg(F.sum("n_signals").alias("n_signals"))
    rows = grid(candles).withColumn("symbol", both).distinct().join(found, ["symbol", *KEYS], "left").join(many, ["symbol", "flag", "split"], "left")
    rows = rows.withColumn("scope", F.when(F.col("symbol") == "ALL", "pooled").otherwise("symbol"))
    return written(rows.na.fill(0, ["n_effective", "n_non_tied", "wins", "n_signals"]))


def tested(rows: DataFrame) -> DataFrame:
    """Adds the one-sided exact binomial p (1 without a trade that counts), its adjustment over all rows and the least detectable deviation."""
    p = F.when(F.col("n_non_tied") > 0, stats.binomial_sf("wins", "n_non_tied", F.lit(0.5))).otherwise(1.0)
    rows = rows.withColumn("binomial_p", p).withColumn("mde_points", stats.least_detectable(F.col("n_effective").cast("double")))
    return stats.benjamini_hochberg(rows, "binomial_p", "binomial_adjusted_p")


def turned(candles: DataFrame, symbols: DataFrame, step: int, product: Product, marks: DataFrame | None = None) -> DataFrame:
    """(symbol, hypothesis, decision, run, on, net): all candidates of a hypothesis and whether its flag is on."""
    rows = candidates(candles, step, product).join(marked(candles, symbols, step) if marks is None else marks, ["symbol", "decision"], "left")
    each = F.array(*[F.struct(F.lit(f).alias("flag"), F.coalesce(F.array_contains("flags", f), F.lit(False)).alias("on")) for f in screen.FLAGS])
    return rows.withColumn("x", F.explode(each)).select("symbol", "x.flag", "horizon", "direction", "split", "decision", "run", "x.on", "net")


TURN_KEYS = ["symbol", *KEYS]


def shift_p_all(rows: DataFrame) -> DataFrame:
    """p of every hypothesis and symbol of turned() rows: how many turns of the marks over the whole split have as large a sum; 1 without a mark."""
    return shifts.turn_p(written(rows), TURN_KEYS, "decision", SPAN, "on", "net")


def shift_p_drawn(rows: DataFrame, many: int, seed: int) -> DataFrame:
    """As shift_p_all(), for `many` turns that are drawn without replacement from each series' own seed."""
    return shifts.turn_p(written(rows), TURN_KEYS, "decision", SPAN, "on", "net", many, seed)


def shift_p(rows: DataFrame, many: int, seed: int) -> DataFrame:
    """p of every hypothesis and symbol of turned() rows: each run is turned by itself, by amounts drawn from the hypothesis' and the run's own seed.

    Hypotheses up to shifts.IN_TASK rows are worked out in one task each. Of longer ones, tasks add up the sums of some runs, and
    a run that is longer by itself is turned in tiles."""
    rows = written(rows)
    kinds = "symbol string, flag string, horizon int, direction string, split string"
    runs = rows.groupBy(*TURN_KEYS, "run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*TURN_KEYS).orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = written(runs.withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / shifts.IN_TASK)))

    def own_seed(key: tuple) -> int:
        return seed + sum((i + 1) * ord(c) for i, c in enumerate("|".join(map(str, [*key, "shift"]))))

    def drawn(key: tuple, run: int, n: int) -> np.ndarray:
        return np.random.default_rng([own_seed(key), run]).integers(1, n, many)

    def totals(key: tuple, pdf: pd.DataFrame) -> np.ndarray:
        total = np.zeros(many)
        for run, part in pdf.sort_values("decision").groupby("run", sort=True):
            sums = shifts.shift_sums(part["on"].to_numpy(bool), part["net"].to_numpy(float))
            total += sums[0] if len(sums) < 2 else sums[drawn(key, int(run), len(sums))]
        return total

    def p_of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        on = pdf["on"].to_numpy(bool)
        p = (1 + (totals(key, pdf) >= pdf["net"].to_numpy(float)[on].sum() - shifts.SLACK).sum()) / (many + 1) if on.any() else 1.0
        return pd.DataFrame([[*key, float(p)]], columns=[*TURN_KEYS, "p"])

    long = runs.groupBy(*TURN_KEYS).agg(F.sum("n").alias("all")).where(F.col("all") > shifts.IN_TASK).select(*TURN_KEYS)
    small = rows.join(long, TURN_KEYS, "left_anti").groupBy(*TURN_KEYS).applyInPandas(p_of, f"{kinds}, p double")
    if not long.limit(1).count():
        return small

    def part_sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key[:-1], totals(key[:-1], pdf).tolist()]], columns=[*TURN_KEYS, "sums"])

    def at_drawn(n: int, own: float, key: int, offsets: np.ndarray, sums: np.ndarray) -> dict:
        wanted = np.random.default_rng([key >> 32, key & 0xFFFFFFFF]).integers(1, n, many)
        order = np.argsort(offsets)
        at = np.minimum(np.searchsorted(offsets[order], wanted), len(offsets) - 1)
        hit = np.flatnonzero(offsets[order][at] == wanted)
        return {"draw": hit.astype(np.int64), "sum": sums[order][at[hit]]}

    def names(pdf: pd.DataFrame) -> pd.DataFrame:
        """The hypothesis' and the run's seeds in one number; runs are epochs and fit into 32 bits or are folded into them."""
        keys = [tuple(x) for x in pdf[TURN_KEYS].itertuples(index=False)]
        return pdf.assign(key=[f"{'|'.join(map(str, k))}|{r}" for k, r in zip(keys, pdf["run"], strict=True)], seed=[(own_seed(k) & 0x7FFFFFFF) << 32 | int(r) & 0xFFFFFFFF for k, r in zip(keys, pdf["run"], strict=True)])

    of_long = rows.join(long, TURN_KEYS)
    parts = of_long.join(runs.where(F.col("n") <= shifts.IN_TASK).select(*TURN_KEYS, "run", "part"), [*TURN_KEYS, "run"])
    found = parts.groupBy(*TURN_KEYS, "part").applyInPandas(part_sums, f"{kinds}, sums array<double>").select(*TURN_KEYS, F.posexplode("sums").alias("draw", "sum"))
    alone = runs.where(F.col("n") > shifts.IN_TASK).mapInPandas(lambda parts: map(names, parts), f"{kinds}, run long, n long, part long, key string, seed long")
    series = quality.numbered_by(of_long.join(alone.drop("part"), [*TURN_KEYS, "run"]), "decision", SPAN, [*TURN_KEYS, "run"])
    series = series.select("key", "n", F.lit(0.0).alias("own"), "seed", "at", F.col("on").cast("double").alias("on"), F.col("net").alias("value"))
    turned_alone = shifts.tiled(series, at_drawn, "draw long, sum double").join(alone.select("key", *TURN_KEYS), "key").select(*TURN_KEYS, "draw", "sum")
    sums = found.unionByName(turned_alone).groupBy(*TURN_KEYS, "draw").agg(F.sum("sum").alias("sum"))
    own = of_long.groupBy(*TURN_KEYS).agg(F.sum(F.when(F.col("on"), F.col("net"))).alias("own"))
    hit = F.count(F.when(F.col("sum") >= F.col("own") - shifts.SLACK, 1))
    large = own.join(sums, TURN_KEYS).groupBy(*TURN_KEYS).agg(F.when(F.first("own").isNull(), 1.0).otherwise((1 + hit) / (many + 1)).alias("p"))
    return small.unionByName(large)


def stouffer(rows: DataFrame, p: str, keys: list[str]) -> DataFrame:
    """(keys, stouffer_z): z values of members' p, weighted by the root of n_effective; null where no member has a trade."""
    safe = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    rows = rows.where("n_effective > 0").withColumn("_z", stats.normal_isf(safe)).withColumn("_w", F.sqrt("n_effective"))
    return rows.groupBy(*keys).agg((F.sum(F.col("_z") * F.col("_w")) / F.sqrt(F.sum(F.col("_w") * F.col("_w")))).alias("stouffer_z"))


def analysis(candles: DataFrame, symbols: DataFrame, step: int, product: Product, draws: int | None = None, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """All hypotheses with both families of p values adjusted, Bonferroni, and whether discovery and confirmation agree.

    The p of a turned series is exhaustive, or by `draws` draws for each run; a pooled one combines those of its members."""
    marks = marked(candles, symbols, step)
    rows = tested(hypotheses(candles, symbols, step, product, marks))
    turns = turned(candles, symbols, step, product, marks)
    found = shift_p_all(turns) if draws is None else shift_p(turns, draws, seed)
    own = rows.where("scope = 'symbol'").join(found.withColumnRenamed("p", "circular_shift_p"), ["symbol", *KEYS], "left").na.fill(1.0, ["circular_shift_p"])
    own = written(own)
    z = stouffer(own, "circular_shift_p", KEYS)
    pooled = rows.where("scope = 'pooled'").join(z, KEYS, "left").withColumn("circular_shift_p", F.coalesce(1 - stats.normal_cdf("stouffer_z"), F.lit(1.0)))
    rows = own.withColumn("stouffer_z", F.lit(None).cast("double")).unionByName(pooled)
    rows = written(stats.benjamini_hochberg(rows, "circular_shift_p", "adjusted_p"))
    rows = rows.withColumn("bonferroni_adjusted_p", F.least(F.lit(1.0), F.col("circular_shift_p") * F.count("*").over(Window.partitionBy())))
    keys = ["scope", "symbol", "flag", "horizon", "direction"]
    return rows.join(confirmed(rows, ["scope", "symbol"], "adjusted_p", alpha), keys)


def confirmed(tests: DataFrame, keys: list[str], q: str = "q", alpha: float = 0.05) -> DataFrame:
    """Hypotheses with q under alpha and a gain after costs in both splits."""
    good = F.count(F.when((F.col(q) < alpha) & (F.col("net_mean_bps") > 0), 1)) == 2
    return tests.groupBy(*keys, "flag", "horizon", "direction").agg(good.alias("confirmed"))


def top_pooled(tests: DataFrame, q: str, n: int = 15) -> DataFrame:
    """The pooled hypotheses with the least q."""
    return tests.where("scope = 'pooled'").orderBy(q, "flag", "horizon", "direction", "split").limit(n)


def pooled_pairs(tests: DataFrame, q: str, n: int = 15) -> DataFrame:
    """Discovery and confirmation of each pooled hypothesis side by side, the least q in confirmation first."""
    late = F.col("split") == SPLITS[1]
    rows = tests.where("scope = 'pooled'").groupBy("flag", "horizon", "direction").agg(
        F.max(F.when(~late, F.col("net_mean_bps"))).alias("discovery_net_bps"), F.max(F.when(late, F.col("net_mean_bps"))).alias("confirmation_net_bps"), F.max(F.when(late, F.col(q))).alias("confirmation_q"),
        F.max(F.when(late, F.col("n_effective"))).alias("n_effective"),
    )
    return rows.orderBy("confirmation_q", "flag", "horizon", "direction").limit(n)


def break_even(rows: DataFrame, *payouts: float) -> DataFrame:
    """Wins against the rate at which each fixed payout breaks even, and the expected value of a unit stake, over rows with a trade that
    counts; the rows of a payout are a family."""
    rows = rows.where("n_non_tied > 0").withColumn("wins", F.bround(F.col("hit_rate") * F.col("n_non_tied")).cast("long")).withColumn("win_rate", F.col("wins") / F.col("n_non_tied"))
    rows = rows.withColumn("payout", F.explode(F.array(*map(F.lit, payouts)))).withColumn("break_even", 1 / (1 + F.col("payout")))
    rows = rows.withColumn("expected_value", F.col("win_rate") * F.col("payout") - (1 - F.col("win_rate")))
    return stats.benjamini_hochberg(rows.withColumn("p", stats.binomial_sf("wins", "n_non_tied", "break_even")), "p", "q", "payout")


def replicated(rows: DataFrame, least: int = 100) -> DataFrame:
    """Pooled (flag, horizon, direction) with an expected gain in both splits, each of `least` trades or more."""
    good = F.count(F.when((F.col("n_non_tied") >= least) & (F.col("expected_value") > 0), 1)) == 2
    return rows.where("scope = 'pooled'").groupBy("flag", "horizon", "direction").agg(good.alias("good")).where("good").drop("good")


def payout_summary(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    return rows.groupBy("payout").agg(
        F.count("*").alias("rows_tested"), F.count(F.when(F.col("win_rate") > F.col("break_even"), 1)).alias("rows_above_break_even"), F.count(F.when(F.col("q") < alpha, 1)).alias("significant_rows"), F.min("q").alias("least_q"),
    )


def ranked(rows: DataFrame, least: int = 30, top: int = 8) -> DataFrame:
    """The best hypotheses by p, to six places as sums of tails near 1 differ by rounding, then by expected value."""
    names = [c for c in ("scope", "symbol", *KEYS) if c in rows.columns]
    return rows.where(F.col("n_non_tied") >= least).orderBy(F.round("p", 6), F.desc(F.round("expected_value", 9)), *names).limit(top)


def confidence(rows: DataFrame, step: int, keys: list[str], replications: int, seed: int) -> DataFrame:
    """(keys, low, high): percentile interval of the mean net outcome; every run of a symbol is resampled by itself."""
    rows = rows.withColumn("group", F.concat_ws("|", "symbol", "run")).withColumn("epoch", F.col("decision"))
    return resampling.interval(resampling.grouped_means(rows, step, keys, "group", "net", replications, seed), keys)


def data_window(candles: DataFrame) -> DataFrame:
    """The span that all symbols share: fewest candles, the latest first epoch and the earliest last one."""
    ends = candles.groupBy("symbol").agg(F.count("*").alias("n"), F.min("epoch").alias("first"), F.max("epoch").alias("last"))
    return ends.agg(F.min("n").alias("candles"), F.max("first").alias("first_epoch"), F.min("last").alias("last_epoch"))


#: The phrases of a technical read.
UP, DOWN, UNCLEAR = "up (short average above long)", "down (short average below long)", "unclear"
WALK, OFF_WALK, NOT_TOLD = "consistent with a random walk", "small deviation from random walk (usually noise)", "n/a"
MOMENTUM = ("oversold", "overbought", "neutral")
STRETCH = ("far above average", "above average", "far below average", "below average", "near average")
VOLATILITY = ("running hotter than stated", "running cooler than stated", "as stated")


def technical_read(latest: DataFrame) -> DataFrame:
    """Phrases for the row on display of each symbol, and the calls its strategies make; a null measure reads n/a."""
    c = F.col

    def phrase(name: str, shown: str, cases: tuple[Column, ...], texts: tuple[str, ...]) -> Column:
        out = F.when(c(name).isNull(), NOT_TOLD)
        for when, text in zip(cases, texts, strict=False):
            out = out.when(when, F.format_string(f"{text} ({shown})", name))
        return out.otherwise(F.format_string(f"{texts[-1]} ({shown})", name))

    walk = c("hurst").between(0.45, 0.55) & c("vr").between(0.85, 1.15) & (F.abs("autocorr") < 0.1)
    rows = latest.select(
        "symbol", c("close").alias("price"),
        F.when(c("trend") == "ema20_above_ema50", UP).when(c("trend") == "ema20_below_ema50", DOWN).otherwise(UNCLEAR).alias("trend"),
        phrase("rsi", "RSI %.0f", (c("rsi") < 30, c("rsi") > 70), MOMENTUM).alias("momentum"),
        phrase("z", "z %+.1f", (c("z") >= 2, c("z") >= 1, c("z") <= -2, c("z") <= -1), STRETCH).alias("stretch"),
        phrase("vol_ratio", "%.2fx", (c("vol_ratio") > 1.15, c("vol_ratio") < 0.85), VOLATILITY).alias("volatility"),
        F.when(c("hurst").isNull() | c("vr").isNull() | c("autocorr").isNull(), NOT_TOLD).when(walk, WALK).otherwise(OFF_WALK).alias("behaviour"),
        F.concat_ws(",", *[F.when(d == 1, f"{n}:long").when(d == -1, f"{n}:short") for n, d in ledger.rules().items() if n != "coin"]).alias("calls"),
    )
    return rows.withColumn("headline", F.format_string("Trend %s; momentum %s; price %s.", "trend", "momentum", "stretch"))
