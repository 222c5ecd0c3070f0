"""Known answers on literal rows, and causality: later rows never change earlier values."""

import math

import pytest

from quaver.functions import dist, series
from quaver.operators import indicators as ind
from quaver.operators import ledger, quality, screen, stats, trades
from quaver.plans import queries
from quaver.sources import history, market
from quaver.sources.store import Store


def candles(spark, closes, step=60, epochs=None):
    rows = [("X", e, float(c), c + 1.0, c - 1.0, float(c)) for e, c in zip(epochs or range(0, step * len(closes), step), closes, strict=True)]
    return spark.createDataFrame(rows, "symbol string, epoch long, open double, high double, low double, close double")


def column(df):
    name = [c for c in df.columns if c not in ("symbol", "epoch")][0]
    return [r[name] for r in df.orderBy("epoch").collect()]


def test_rsi(spark):
    assert column(ind.rsi(candles(spark, [10, 11, 12, 13, 14]), 60, 2)) == [None, None, 100, 100, 100]
    assert column(ind.rsi(candles(spark, [5, 5, 5, 5]), 60, 2))[-1] == 50
    got = column(ind.rsi(candles(spark, [10, 11, 10, 12, 11]), 60, 3))
    assert got[3] == pytest.approx(75) and got[4] == pytest.approx(54.5454545455)


def test_ema_and_atr(spark):
    assert column(ind.ema(candles(spark, [1, 2, 3, 4]), 60, 2)) == [None, pytest.approx(5 / 3), pytest.approx(23 / 9), pytest.approx(95 / 27)]
    assert column(ind.atr(candles(spark, [1, 2, 3, 4]), 60, 2)) == [None, 2, 2, 2]


def test_windows(spark):
    assert column(ind.bollinger_z(candles(spark, [1, 2, 3, 4]), 60, 3)) == [None, None, pytest.approx(math.sqrt(1.5)), pytest.approx(math.sqrt(1.5))]
    year = ind.YEAR
    assert column(ind.realized_vol(candles(spark, [math.exp(x) + 0 for x in (0, 1, 2, 4)], year), year, 2)) == [None, None, pytest.approx(0, abs=1e-9), pytest.approx(math.sqrt(0.5))]


def test_chunks_change_nothing(spark, monkeypatch):
    rows = candles(spark, [100 + 7 * math.sin(i) + i % 5 for i in range(60)], epochs=[60 * i + (300 if i > 33 else 0) for i in range(60)])
    whole = [column(f(rows, 60, 6)) for f in (ind.rsi, ind.ema, ind.bollinger_z, ind.skewness)]
    monkeypatch.setattr(series, "CHUNK_ROWS", 7)
    monkeypatch.setattr(series.chunk_of, "__defaults__", (7,))
    for before, f in zip(whole, (ind.rsi, ind.ema, ind.bollinger_z, ind.skewness), strict=True):
        assert column(f(rows, 60, 6)) == [None if x is None else pytest.approx(x) for x in before]


def test_causal(spark):
    closes = [100 + 7 * math.sin(i) for i in range(30)]
    for f in (ind.rsi, ind.ema, ind.bollinger_z, ind.variance_ratio):
        a, b = column(f(candles(spark, closes), 60, 8)), column(f(candles(spark, [*closes[:20], *[500.0] * 10]), 60, 8))
        assert a[:20] == [None if x is None else pytest.approx(x) for x in b[:20]]


def test_quality(spark):
    assert [r.epoch for r in quality.gaps(candles(spark, [1, 1, 1], epochs=[0, 60, 240]), 60).orderBy("epoch").collect()] == [120, 180]
    ticks = spark.createDataFrame([("X", 2 * i, 110.0 if i == 4 else 100.0, i) for i in range(5)], "symbol string, epoch long, quote double, arrival long")
    assert [r.kind for r in quality.abnormal_jumps(ticks).collect()] == ["zero-variance-break"]


def test_settlement(spark):
    rows = spark.createDataFrame([("X", 0, 1.0, 1.0, 1.0, 1.0), ("X", 60, 100.0, 103.0, 85.0, 101.0)], "symbol string, epoch long, open double, high double, low double, close double")
    p = trades.Product(stake=10.0, multiplier=5.0, stop_out=0.5, commission=0.1, spread=0.002)
    from pyspark.sql import functions as F

    one = trades.forward_trades(rows, 60, F.lit(1.0), 1, p).collect()[0]
    assert (one.reason, one.gross, one.net) == ("stop_out", -5.0, pytest.approx(-5.2))
    short = trades.forward_trades(rows, 60, F.lit(-1.0), 1, p).collect()[0]
    assert short.net == pytest.approx(-0.5 - 0.2)
    with pytest.raises(ValueError):
        trades.Product(stake=-1)


def test_distributions():
    assert dist.binomial_sf(540, 1079, 1 / 1.95) == pytest.approx(0.8002721096376009, abs=1e-9)
    assert dist.least_detectable_deviation(100) == pytest.approx(12.5614209725, abs=1e-6)
    assert dist.chi2_sf(dist.chi2_ppf(0.95, 499), 499) == pytest.approx(0.05, abs=1e-10)
    assert dist.binomial_two_sided(2, 3) == pytest.approx(1.0)


def test_benjamini_hochberg(spark):
    rows = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.002,)], "p double")
    assert [round(r.q, 12) for r in stats.benjamini_hochberg(rows).orderBy("p").collect()] == [0.008, 0.02, 0.04, 0.04]


def test_stream(spark, tmp_path):
    from quaver.streaming import candles as live

    ticks = spark.createDataFrame([("X", f"2024-01-01 00:0{m}:{s:02d}", 1.0 * m + s, str(s)) for m in range(3) for s in range(0, 60, 20)], "symbol string, ts string, quote double, tick_id string")
    ticks.selectExpr("symbol", "cast(ts as timestamp) ts", "quote", "tick_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol string, ts timestamp, quote double, tick_id string").parquet(str(tmp_path / "in"))
    live.write_latest(live.candles(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = live.latest(spark.read.parquet(str(tmp_path / "out"))).orderBy("epoch").collect()
    assert [(r.open, r.high, r.low, r.close) for r in got] == [(m, m + 40.0, m, m + 40.0) for m in (0.0, 1.0, 2.0)]


def test_whole_tick_table_is_scanned_and_upserted(spark):
    d = "/root/testdata/sf0.001"
    ticks = market.ticks(spark, d)
    mine = sorted(r.epoch for r in ticks.where("symbol = 'click'").collect())
    assert sorted(r.epoch for r in queries.ticks_between(ticks, "click", mine[0], mine[-1]).collect()) == mine
    assert queries.ticks_between(ticks, "click", mine[0] + 1, mine[-1] - 1).count() == len([e for e in mine if mine[0] < e < mine[-1]])
    got = {(r.symbol, r.epoch) for r in queries.upsert_all_ticks(spark, d).collect()}
    assert got == {(r.symbol, r.epoch) for r in ticks.collect()}


def test_composed_steps_are_the_loop():
    import numpy as np

    r = np.random.default_rng(1)
    a, b = r.random((300, 2)), r.normal(0, 1, (300, 2))
    a[[0, 50, 120]] = 0
    whole_a, whole_b = series.scanned(a, b)
    y = np.array([3.0, -2.0])
    for i in range(300):
        y = a[i] * y + b[i]
        assert whole_a[i] * [3.0, -2.0] + whole_b[i] == pytest.approx(y)


def test_periods_are_checked(spark):
    rows = candles(spark, [1, 2, 3])
    for call in (lambda: ind.rsi(rows, 60, 0), lambda: ind.bollinger_z(rows, 60, 1), lambda: ind.autocorrelation(rows, 60, 50, 11), lambda: ind.variance_ratio(rows, 60, 2, 2), lambda: ind.hurst_rs(rows, 60, 15), lambda: ind.skewness(rows, 60, 2), lambda: trades.forward_trades(rows, 60, rows.close, 0, trades.Product())):
        with pytest.raises(ValueError):
            call()


def known(spark, *rows):
    return spark.createDataFrame([*rows], "symbol string, stated_vol double")


def test_trend_compares_the_two_averages(spark):
    rows = spark.createDataFrame([(2.0, 1.0), (1.0, 2.0), (1.0, 1.0), (None, 1.0)], "ema20 double, ema50 double").withColumn("t", screen.trend())
    assert [r.t for r in rows.collect()] == ["ema20_above_ema50", "ema20_below_ema50", "ema20_equal_ema50", "insufficient_data"]


def test_parts_and_their_last_runs(spark):
    rows = candles(spark, range(1, 21), epochs=[60 * i + (600 if i > 8 else 0) + (600 if i > 16 else 0) for i in range(20)])
    parts = {r.part: r["count"] for r in screen.split(rows, 20).groupBy("part").count().collect()}
    assert parts == {"calibration": 12, "holdout": 2, "display": 6}
    assert {r.symbol: r["count"] for r in screen.last_segments(screen.split(rows, 20), 60).groupBy("symbol").count().collect()} == {"X|calibration": 3, "X|display": 3}
    with pytest.raises(ValueError):
        screen.split(rows, 20, 0.9, 0.1)


def test_reliability_needs_five_trades(spark):
    rows = spark.createDataFrame([("X", i, float(i), *[j <= i for j in (1, 4, 0, 9, 9)]) for i in range(8)], "symbol string, epoch long, ret double, " + ", ".join(f"{f} boolean" for f in screen.FLAGS))
    got = {r.flag: (r.observations, r.edge, r.hit_rate) for r in screen.reliability(rows).collect()}
    assert got["overbought"] == (7, 4.0, 1.0) and got["stretched"] == (4, None, None) and got["vol_mismatch"] == (8, 3.5, 7 / 8) and got["trending_regime"] == (0, None, None)


def test_turned_marks_against_a_loop(spark):
    import numpy as np

    r = np.random.default_rng(4)
    ret, on = [*r.normal(0, 1, 29).tolist(), None], [*(r.random(29) < 0.4).tolist(), False]
    rows = spark.createDataFrame([("X", i, ret[i], *[bool(on[i])] * 5) for i in range(30)], "symbol string, epoch long, ret double, " + ", ".join(f"{f} boolean" for f in screen.FLAGS))
    mean = lambda k: np.mean([ret[(i + k) % 30] for i in range(30) if on[i] and ret[(i + k) % 30] is not None] or [0.0])
    want = (1 + sum(abs(mean(k)) >= abs(mean(0)) - 1e-12 for k in range(1, 30))) / 30
    assert [r.p for r in screen.shift_p(rows).collect()] == pytest.approx([want] * 5)


def test_unregistered_symbols_are_refused(spark):
    with pytest.raises(Exception, match="unregistered symbol: X"):
        screen.features(candles(spark, range(1, 6)), known(spark, ("Y", 1.0)), 60).collect()


def test_monitor_windows_run_over_gaps(spark):
    closes = [math.exp(x) for x in (0, 0.1, 0.3, 0.2, 0.9, 1.0)]
    rows = candles(spark, closes, epochs=[0, 60, 120, 600, 660, 720])
    got = stats.volatility_monitor(rows, known(spark, ("X", 1.0)), 60, 4).collect()
    returns = [0.1, 0.2, 0.7, 0.1]
    mean = sum(returns) / 4
    assert [(r.epoch, r.status, r.observations) for r in got] == [(720, "ok", 4)]
    assert got[0].realized == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in returns) / 3 * ind.YEAR / 60)) and got[0].alert
    few = stats.volatility_monitor(rows, known(spark, ("X", 1.0)), 60, 5).first()
    assert (few.status, few.observations, few.epoch, few.realized, few.alert) == ("insufficient_data", 4, 720, None, None)


def test_signal_evaluation(spark):
    from pyspark.sql import functions as F

    got = stats.signal_evaluation(candles(spark, [1, 2, 2, 4, 2]), 60, F.lit(1.0), 1).first()
    assert (got.observations, got.tie_count, got.n_effective, got.hit_rate, got["mean"], got["median"]) == (4, 1, 3, pytest.approx(2 / 3), pytest.approx(0.375), pytest.approx(0.5))
    assert got.binomial_p == pytest.approx(1.0) and got.binomial_is_inferential
    wide = stats.signal_evaluation(candles(spark, [1, 2, 3, 4, 5], epochs=[0, 60, 900, 960, 1020]), 60, F.lit(-1.0), 2).first()
    assert (wide.observations, wide.n_effective, wide.hit_rate, wide.mean_signed) == (3, 2, 0.0, pytest.approx(-(2 + 2 / 3) / 2))


def settled(spark, *rows):
    return spark.createDataFrame([("X", e, float(n)) for e, n in rows], "symbol string, exit_epoch long, net double")


def test_breaker(spark):
    day = 86_400
    rows = settled(spark, (10, -3), (20, -3), (day + 1, -1), (day + 2, 2), (3 * day, -1), (4 * day, -9))
    got = ledger.breaker(rows, 6.0, 3).orderBy("exit_epoch").collect()
    assert [(r.daily_net, r.losses) for r in got] == [(-3, 1), (-6, 2), (-1, 3), (1, 0), (-1, 1), (-9, 2)]
    assert [r.reasons for r in got] == ["", "daily-loss-limit", "consecutive-loss-limit", "", "", "daily-loss-limit"]
    fold = ledger.breaker_fold(settled(spark, (1, -3), (2, -3), (3, 5), (day, -1), (day + 1, 4), (2 * day, -1), (3 * day, -1), (4 * day, -1), (5 * day, 7)), 6.0, 3).orderBy("exit_epoch").collect()
    assert [r.taken for r in fold] == [True, True, False, True, False, False, False, False, False]
    reset = ledger.breaker_fold(settled(spark, (1, -3), (2, 1), (day, -1), (day + 1, -6), (day + 2, 9), (2 * day, 4)), 6.0, 3).orderBy("exit_epoch").collect()
    assert [(r.taken, r.losses) for r in reset] == [(True, 1), (True, 0), (True, 1), (True, 2), (False, 2), (True, 0)]


def test_sizes_are_capped_by_risk(spark):
    p = trades.Product(stake=1.0, multiplier=2.0, stop_out=0.5, commission=0.2, spread=0.001)
    low, high = (ledger.sizes(known(spark, ("X", v)), 10_000.0, 0.1, p, 0.01).first() for v in (5.0, 0.1))
    assert low.vol_target_stake == pytest.approx(100.0) and low.vol_target_risk == pytest.approx((100 * 0.502 + 0.2) / 10_000)
    assert high.vol_target_stake == pytest.approx((200 - 0.2) / 0.502) and high.vol_target_risk == pytest.approx(0.02) and high.fixed_fraction_stake == pytest.approx(99.8 / 0.502)
    with pytest.raises(ValueError):
        ledger.sizes(known(spark, ("X", 1.0)), 10_000.0, 0.1, p, 1.5)


def test_verdicts(spark):
    rows = spark.createDataFrame([(s, o) for s, w, n in (("trend", 150, 200), ("reversion", 100, 200), ("rsi", 9, 10), ("coin", 180, 200)) for o in ["win"] * w + ["loss"] * (n - w)] + [("rsi", "void"), ("rsi", "pending")], "strategy string, outcome string")
    got = {r.strategy: r for r in ledger.summary(rows).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"trend": "edge detected", "reversion": "no edge detected", "rsi": "collecting data", "coin": "control"}
    assert got["rsi"].voids == got["rsi"].pending == 1 and got["trend"].adjusted_p == pytest.approx(3 * got["trend"].p)


def test_walk_forward(spark):
    rows = spark.createDataFrame([("X", 60 * i, 10.0, 11.0, 9.0, 10.0 + (1 if i % 2 else -1)) for i in range(10)], "symbol string, epoch long, open double, high double, low double, close double")
    from pyspark.sql import functions as F

    made = trades.forward_trades(rows, 60, F.lit(1.0), 1, trades.Product(stake=1.0, multiplier=1.0))
    got = {r.fold: r for r in trades.walk_forward(rows, made, 60, trades.Product(stake=1.0, multiplier=1.0), 4, 3).collect()}
    assert {k: (r.observations, r.period_observations) for k, r in got.items()} == {0: (3, 3), 1: (3, 3), None: (6, 6)}
    assert got[None].drawdown == max(got[0].drawdown, got[1].drawdown)
    with pytest.raises(ValueError):
        trades.walk_forward(rows, made, 60, trades.Product(), 4, 3, 2)


def test_trade_times_and_restated_exit(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("X", 0, 1.0, 1.0, 1.0, 1.0), ("X", 60, 100.0, 103.0, 85.0, 101.0)], "symbol string, epoch long, open double, high double, low double, close double")
    one = trades.forward_trades(rows, 60, F.lit(2.0), 1, trades.Product(stake=10.0, multiplier=5.0, stop_out=0.5)).first()
    assert (one.decision, one.entry_epoch, one.exit_epoch, one.exit, one.gross_won) == (60, 60, 120, pytest.approx(90.0), False)
    paid = trades.forward_trades(rows, 60, F.lit(1.0), 1, trades.Product(kind="fixed_payout", stake=20.0, payout=0.02, commission=1.0)).first()
    assert paid.gross_won and not paid.won and trades.break_even_rate(trades.Product(kind="fixed_payout", stake=20.0, payout=0.8, commission=0.2, spread=0.01)) == pytest.approx(20.4 / 36)


def test_store(spark, tmp_path):
    rows = candles(spark, [1, 2, 3], epochs=[0, 60, 600_000])
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "none"), read_only=True)
    store = Store(spark, str(tmp_path / "s"))
    assert store.put_candles(rows, 60) == 3 and store.put_candles(candles(spark, [9], epochs=[60]), 60) == 1
    assert [(r.epoch, r.close) for r in store.candles(60).collect()] == [(0, 1.0), (60, 9.0), (600_000, 3.0)]
    assert [r.epoch for r in store.candles(60, "X", 60, 600_000).collect()] == [60, 600_000] and store.has("candles", 60) and not store.has("ticks")
    ticks = spark.createDataFrame([("X", 1, 5.0, "1"), ("X", 1, 6.0, "2")], "symbol string, epoch long, quote double, tick_id string")
    assert store.put_ticks(ticks) == 2 and [r.quote for r in store.ticks().collect()] == [6.0]
    assert [r.epoch for r in store.gaps(60, 0, 240).collect()] == [120, 180]
    for wrong in (lambda: store.export("other", "x"), lambda: store.put_candles(rows.withColumn("granularity", rows.epoch), 60), lambda: store.put_ticks(ticks.drop("quote"))):
        with pytest.raises(ValueError):
            wrong()
    reader = Store(spark, str(tmp_path / "s"), read_only=True)
    with pytest.raises(PermissionError):
        reader.put_ticks(ticks)
    reader.close()
    with pytest.raises(RuntimeError):
        reader.ticks()


def test_malformed_pages_are_refused(spark):
    page = lambda text: spark.createDataFrame([("X", 1, text)], "symbol string, page long, json string")
    assert [(r.epoch, r.quote) for r in history.tick_pages(page('{"history": {"times": [1, 2], "prices": [3.5, 4]}, "more": 1}')).collect()] == [(1, 3.5), (2, 4.0)]
    for text in ('{"history": {"times": [1], "prices": [3.5, 4]}}', '{"other": 1}', "{"):
        with pytest.raises(Exception, match="alformed"):
            history.tick_pages(page(text)).collect()


def test_snapshot_files(spark, tmp_path):
    rows = screen.as_json(spark.createDataFrame([("X", float("nan"), 1.5)], "symbol string, a double, b double"))
    assert history.write_snapshot(rows, str(tmp_path / "s.json")) == 1 and history.read_snapshot(str(tmp_path / "s.json")) == [{"symbol": "X", "a": None, "b": 1.5}]
    (tmp_path / "t.json").write_text("[{}]")
    with pytest.raises(ValueError):
        history.read_snapshot(str(tmp_path / "t.json"))


def test_breaker_over_a_stream(spark, tmp_path):
    from quaver.streaming import breaker

    rows = settled(spark, (1, -3), (2, -3), (3, 5), (86_400, -1))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol string, exit_epoch long, net double").parquet(str(tmp_path / "in"))
    q = breaker.watched(stream, 6.0, 9).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.taken, r.daily_net) for r in spark.table("watched").orderBy("exit_epoch").collect()] == [(True, -3.0), (True, -6.0), (False, -6.0), (True, -1.0)]
    assert breaker.late_rows(q) == 0


def test_removed_folders_leave_the_rest(tmp_path):
    """Without the training-data operators the entry points import and have the library's queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "quaver", tmp_path / "quaver", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})
