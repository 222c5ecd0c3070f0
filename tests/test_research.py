"""Resampling, simulation and edge research against small brute force."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from quaver.functions import quantiles, shifts
from quaver.operators import edge, resampling, risk, screen, stats
from quaver.operators import trades
from quaver.operators.trades import Product
from quaver.plans.queries import QUERIES

D = "/root/testdata/sf0.01"


def candles(spark, closes, step=60):
    rows = [("x", i * step, c, c + 1, c - 1, c) for i, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, "symbol string, epoch long, open double, high double, low double, close double")


def alternating(n):
    return np.exp(np.cumsum([0.0, *[0.01, -0.01] * (n // 2)])) * 100


def test_variance_ratio_of_alternating_returns(spark):
    assert stats.variance_ratio_test(candles(spark, alternating(20)), 60).first()["z"] == pytest.approx(-math.sqrt(20), rel=1e-6)


def test_arch_lm(spark):
    assert stats.arch_lm(candles(spark, alternating(20)), 60, 2).first()["lm"] == pytest.approx(0.0, abs=1e-6)
    r = np.random.default_rng(1).normal(0, 0.01, 300)
    sq = r**2
    x = np.column_stack([np.ones(297), *[sq[3 - k : 300 - k] for k in (1, 2, 3)]])
    rest = sq[3:] - x @ np.linalg.lstsq(x, sq[3:], rcond=None)[0]
    want = 297 * (1 - rest @ rest / ((sq[3:] - sq[3:].mean()) ** 2).sum())
    assert stats.arch_lm(candles(spark, 100 * np.exp(np.cumsum([0, *r]))), 60, 3).first()["lm"] == pytest.approx(want, rel=1e-6)


def test_bootstrap(spark):
    rows = spark.createDataFrame([("c", i * 60, 2.5) for i in range(12)] + [("v", i * 60, float(i % 7)) for i in range(400)] + [("one", 0, -1.0), ("n", 0, None)], "k string, epoch long, v double")
    means = resampling.stationary_means(rows, 60, ["k"], "v", 60, 3)
    got = {r["k"]: r for r in resampling.interval(means, ["k"]).collect()}
    assert set(got) == {"c", "v", "one"}
    assert (got["c"]["low"], got["c"]["high"]) == pytest.approx((2.5, 2.5)) and (got["one"]["low"], got["one"]["high"]) == (-1.0, -1.0)
    assert got["v"]["low"] < np.mean([i % 7 for i in range(400)]) < got["v"]["high"]
    values, draw, left, out = [float(i % 7) for i in range(400)], np.random.default_rng([3, 5]), 400, []
    while left:
        start, size = int(draw.integers(0, 400)), min(int(draw.geometric(1 / 20)), left)
        out += [values[(start + j) % 400] for j in range(size)]
        left -= size
    assert means.where("k = 'v' and replication = 5").first()["mean"] == pytest.approx(np.mean(out))


def test_confirmation_needs_both_splits(spark):
    rows = [("f", 1, "long", "discovery", 0.01, 5.0), ("f", 1, "long", "confirmation", 0.02, 1.0), ("g", 1, "long", "discovery", 0.01, 5.0), ("g", 1, "long", "confirmation", 0.01, -1.0)]
    tests = spark.createDataFrame(rows, "flag string, horizon int, direction string, split string, q double, net_mean_bps double")
    assert {r["flag"]: r["confirmed"] for r in edge.confirmed(tests, []).collect()} == {"f": True, "g": False}


@pytest.mark.parametrize("name", ["edge_bootstrap", "arch_lm_lags", "wrc", "signal_bootstrap"])
def test_queries_without_sql_have_rows(spark, name):
    assert QUERIES[name](spark, D.replace("0.01", "0.001")).count() > 0


def test_shift_sums():
    on, value = np.array([True, False, True, False, False]), np.array([1.0, 2.0, 3.0, 4.0, 5.0])
    assert shifts.shift_sums(on, value) == pytest.approx([sum(value[(i + k) % 5] for i in (0, 2)) for k in range(5)])


def turns(spark, on, net, run=None):
    rows = [("s", "f", 1, "long", "discovery", i, (run or [0] * len(on))[i], bool(on[i]), float(net[i])) for i in range(len(on))]
    return spark.createDataFrame(rows, "symbol string, flag string, horizon int, direction string, split string, decision long, run long, on boolean, net double")


def test_shift_p(spark):
    r = np.random.default_rng(2)
    on, net = r.random(40) < 0.3, r.normal(0, 1, 40)
    sums = [sum(net[(i + k) % 40] for i in np.flatnonzero(on)) for k in range(40)]
    assert edge.shift_p_all(turns(spark, on, net)).first()["p"] == pytest.approx(sum(x >= sums[0] - 1e-9 for x in sums) / 40)
    assert edge.shift_p_all(turns(spark, [False] * 4, [1, 2, 3, 4])).first()["p"] == 1.0
    alone = turns(spark, [True, True, False], [1, 2, -5], [0, 1, 2])  # runs of one row stay as they are
    assert edge.shift_p(alone, 20, 3).first()["p"] == 1.0
    text = "s|f|1|long|discovery|shift"
    draw = np.random.default_rng([9 + sum((i + 1) * ord(c) for i, c in enumerate(text)), 0]).integers(1, 40, 50)
    assert edge.shift_p(turns(spark, on, net), 50, 9).first()["p"] == pytest.approx((1 + sum(sums[k] >= sums[0] - 1e-9 for k in draw)) / 51)


@pytest.fixture
def tiny(monkeypatch):
    """Series of over 10 rows are long; tiles have 64 numbers."""
    monkeypatch.setattr(shifts, "IN_TASK", 10)
    monkeypatch.setattr(shifts, "TILE", 64)


@pytest.mark.parametrize("n", [11, 16, 100, 257, 1000])
def test_sums_in_tiles_are_those_of_the_whole_series(spark, tiny, n):
    r = np.random.default_rng(n)
    on, value = r.normal(0, 1, n), r.normal(0, 1, n)
    series = spark.createDataFrame([("k", n, 0.0, 1, i, float(on[i]), float(value[i])) for i in range(n)], "key string, n long, own double, seed long, at long, on double, value double")
    got = shifts.tiled(series, lambda n, own, seed, k, s: {"k": k, "s": s}, "k long, s double").collect()
    assert np.array([r.s for r in sorted(got, key=lambda r: r.k)]) == pytest.approx(shifts.shift_sums(on, value)) and len(got) == n


def test_long_series_have_the_same_p(spark, tiny, monkeypatch):
    r = np.random.default_rng(2)
    on, net, run = r.random(90) < 0.3, r.normal(0, 1, 90), [0] * 40 + [40] * 5 + [45] * 8 + [53] * 37
    rows = turns(spark, on, net, run).union(turns(spark, [True, False], [1, 2]).withColumn("flag", F.lit("g")))
    found = lambda: [sorted(map(tuple, f.collect())) for f in (edge.shift_p_all(rows), edge.shift_p_drawn(rows, 9, 4), edge.shift_p(rows, 200, 9))]
    long = found()
    monkeypatch.setattr(shifts, "IN_TASK", 1000)
    short = found()
    assert long[:2] == short[:2]
    assert [x[:-1] for x in long[2]] == [x[:-1] for x in short[2]] and [x[-1] for x in long[2]] == pytest.approx([x[-1] for x in short[2]], abs=0.12)
    sums = shifts.shift_sums(on, net)
    drawn = shifts.drawn(90, 9, 4 + sum((i + 1) * ord(c) for i, c in enumerate("s|f|1|long|discovery")))
    assert len(set(drawn.tolist())) == 9 and short[1][0][-1] == pytest.approx((1 + sum(sums[k] >= sums[0] for k in drawn)) / 10)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_permutation(n):
    p = shifts.Permutation(n, 77)
    y = p.of(np.arange(n))
    assert sorted(y.tolist()) == list(range(n)) and p.place(y).tolist() == list(range(n))
    assert n < 100 or y.tolist() != shifts.Permutation(n, 78).of(np.arange(n)).tolist()


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 1.0])
def test_quantiles(spark, share, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", 8)
    r = np.random.default_rng(1)
    groups = {"a": r.normal(0, 1, 501), "b": r.choice([1.0, 2.0], 100), "c": np.array([5.0]), "d": np.array([1e300, -1e300, 1e-300, 0.0]), "e": np.exp(r.normal(0, 30, 200)), "f": np.full(7, 3.25)}
    rows = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("z", None), ("b", float("nan"))], "g string, v double")
    got = {r.g: r.q for r in quantiles.quantile(rows, ["g"], "v", share, "q").collect()}
    assert got == {k: pytest.approx(np.quantile(x, share), rel=1e-12) for k, x in groups.items()}


def test_stouffer(spark):
    rows = spark.createDataFrame([("f", 0.5, 100), ("f", 0.02275013194817921, 100), ("f", 0.3, 0), ("g", 0.2, 0)], "flag string, p double, n_effective int")
    assert {r.flag: r.stouffer_z for r in edge.stouffer(rows, "p", ["flag"]).collect()} == {"f": pytest.approx(2 / math.sqrt(2))}


def test_large_families_are_adjusted_alike(spark):
    r = np.random.default_rng(5)
    p = [*np.round(r.random(300) ** 3, 3).tolist(), 0.0, 1.0, 1e-12, 0.25, 0.25]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(999, None)], "i int, p double")
    small, large = ({r.i: r.q for r in f(rows).collect()} for f in (stats.benjamini_hochberg, stats.benjamini_hochberg_large))
    assert small == pytest.approx(large) and 999 not in small
    assert {r.i: r.q for r in stats.adjusted(rows).collect()} == {**{k: pytest.approx(v) for k, v in small.items()}, 999: None}
    with pytest.raises(Exception, match="not a probability"):
        stats.benjamini_hochberg(spark.createDataFrame([(1.5,)], "p double")).collect()


def test_reality_check(spark):
    r = np.random.default_rng(8)
    x = np.column_stack([r.normal(0.3, 1, 60), r.normal(0, 1, 60)])
    rows = spark.createDataFrame([(n, i * 60, float(x[i, k])) for k, n in enumerate("ab") for i in range(60)], "strategy string, epoch long, value double")
    got = trades.reality_check(rows, 60, 40, 11, 7).first()
    best, centered = x.mean(0).max(), x - x.mean(0)
    hits = 0
    for b in range(40):
        starts = np.random.default_rng([11, b]).integers(0, 60, 9)
        hits += centered[((starts[:, None] + np.arange(7)) % 60).ravel()[:60]].mean(0).max() >= best
    assert (got.observed, got.p, got.strategies) == (pytest.approx(best), pytest.approx((1 + hits) / 41), 2)


def test_deflated_sharpe(spark):
    x = np.random.default_rng(3).normal(0.1, 1, 50)
    rows = spark.createDataFrame([("s", float(v)) for v in x] + [("flat", 1.0)] * 3, "symbol string, net double")
    got = {r.symbol: r for r in trades.deflated_sharpe(rows, 1.0, 5, ["symbol"]).collect()}
    c, sharpe = x - x.mean(), x.mean() / x.std(ddof=1)
    skew, kurt = (c**3).mean() / (c**2).mean() ** 1.5, (c**4).mean() / (c**2).mean() ** 2
    z = (sharpe - trades.expected_maximum(5)) * 7 / math.sqrt(1 - skew * sharpe + (kurt - 1) * sharpe**2 / 4)
    assert got["s"].deflated_sharpe == pytest.approx(math.erfc(-z / math.sqrt(2)) / 2) and got["flat"].deflated_sharpe == 0.5


def test_portfolio(spark):
    known = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "symbol string, stated_vol double")
    rows = spark.createDataFrame([("a", i, float(i % 3)) for i in range(9)] + [("b", i, float(i % 3)) for i in range(8)], "symbol string, epoch long, r double")
    pairs, view = risk.portfolio_view(rows, known)
    assert pairs.first()["correlation"] == pytest.approx(1) and view.first()["warning"] and view.first()["observations"] == 8
    assert view.first()["annual_volatility"] == pytest.approx(math.sqrt(0.0625 + 0.25))
    with pytest.raises(ValueError):
        risk.portfolio_view(rows, known, {"a": 1.0})


@pytest.mark.parametrize(("change", "says"), [
    (lambda c: c.union(c.where("epoch = 60")), "epochs don't rise: x at 60"), (lambda c: c.withColumn("low", F.when(F.col("epoch") == 120, 0.0).otherwise(F.col("low"))), "prices aren't above 0: x at 120"),
    (lambda c: c.withColumn("high", F.when(F.col("epoch") == 120, float("inf")).otherwise(F.col("high"))), "prices"), (lambda c: c.withColumn("close", F.when(F.col("epoch") > 0, F.col("close"))), "x at 0"),
    (lambda c: c.withColumn("granularity", F.col("epoch") + 60), "granularities are mixed"), (lambda c: c.withColumn("granularity", F.lit(0)), "granularity is above 0"),
    (lambda c: c.union(c.withColumn("symbol", F.lit("y"))), "symbols are mixed: x and y"),
])
def test_bad_candles_are_refused(spark, change, says):
    rows = candles(spark, [5, 6, 7, 8])
    assert trades.validated(rows, single=True).count() == 4 and trades.validated(rows.limit(0), single=True).count() == 0
    with pytest.raises(ValueError, match=says):
        trades.validated(change(rows), single=True)


def test_epochs_rise_in_order_of_arrival(spark):
    rows = candles(spark, [5, 6, 7, 8]).withColumn("place", F.col("epoch"))
    assert trades.validated(rows, "place").count() == 4
    with pytest.raises(ValueError, match="x at 60"):
        trades.validated(rows.withColumn("place", F.when(F.col("epoch") == 60, 999).otherwise(F.col("place"))), "place")


def test_a_flag_that_looks_ahead_is_found(spark):
    symbols = spark.createDataFrame([("x", 0.5, 1)], "symbol string, stated_vol double, tick_interval int")
    rows = candles(spark, 100 + np.arange(90) % 7)

    def ahead(c, s, step):
        last = c.groupBy("symbol").agg(F.max("epoch").alias("last"))
        out = screen.flagged(c, s, step).join(last, "symbol")
        return out.withColumn(screen.FLAGS[0], F.col("epoch") == F.col("last")).drop("last")

    assert [tuple(r) for r in screen.causality(rows, symbols, 60, 6).collect()] == [("x", 6, 15 + 30 + 45 + 60 + 75 + 90, 0)]
    assert screen.causality(rows, symbols, 60, 6, ahead).first().differing == 5
