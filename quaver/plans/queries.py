"""Registered queries: every operator over the sample tables. Doubles are rounded to six places."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaver.operators import indicators as ind
from quaver.operators import edge, ledger, quality, resampling, risk, screen, stats, trades
from quaver.operators.trades import Product, body_signal
from quaver.session import checkpoint_folder
from quaver.sources import history, market, recorded
from quaver.sources.ledgers import LedgerStore
from quaver.sources.store import Store
from quaver.sources.market import DAY, HOUR
from quaver.streaming import candles as live

Query = Callable[[SparkSession, str], DataFrame]
PRODUCT = Product(stop_out=0.5, commission=0.1, spread=0.002)
PAYOUT = Product(kind="fixed_payout", stake=20.0, payout=0.8, commission=0.2, spread=0.01)
RANGE = (820_454_400, 852_076_800)  # 1996
TICK_RANGE = (1_704_672_000, 1_705_276_800)  # 8 to 15 January 2024


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def on_daily(f: Callable, *args) -> Query:
    return lambda spark, d: rounded(f(market.daily(spark, d), DAY, *args))


def on_hourly(f: Callable, *args) -> Query:
    return lambda spark, d: rounded(f(market.hourly(spark, d), *args))


def on_ticks(f: Callable, *args) -> Query:
    return lambda spark, d: rounded(f(market.ticks(spark, d), *args))


def with_symbols(f: Callable, *args) -> Query:
    return lambda spark, d: rounded(f(market.daily(spark, d), market.symbols(spark), DAY, *args))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all machines share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def scan_ticks_range(spark: SparkSession, d: str) -> DataFrame:
    """All symbols' ticks between two inclusive epochs; the bounds reach the scan."""
    return rounded(market.ticks(spark, d, None, *TICK_RANGE).select("symbol", "epoch", "quote", "tick_id"))


def ticks_between(rows: DataFrame, symbol: str, start: int, end: int) -> DataFrame:
    """The ticks of a symbol from start to end, both inclusive."""
    return rows.where(F.col("epoch").between(start, end) & (F.col("symbol") == symbol)).select("symbol", "epoch", "quote", "tick_id")


def scan_ticks_bounds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.ticks(spark, d, "click", *TICK_RANGE).select("symbol", "epoch", "quote", "tick_id"))


def scan_candles_range(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.daily(spark, d, "A", *RANGE))


def store_candles(spark: SparkSession, d: str, name: str) -> Store:
    """A store with all daily candles, and all hourly ones put in twice."""
    store = Store(spark, shared_folder(spark, name))
    store.put_candles(market.daily(spark, d), DAY)
    hourly = market.hourly(spark, d)
    store.put_candles(hourly.withColumn("close", F.col("close") + 1), HOUR)
    store.put_candles(hourly, HOUR)
    return store


def upsert_candles(spark: SparkSession, d: str) -> DataFrame:
    store = store_candles(spark, d, "upsert")
    return rounded(store.candles(DAY).withColumn("granularity", F.lit(DAY)).unionByName(store.candles(HOUR).withColumn("granularity", F.lit(HOUR))))


def store_scan(spark: SparkSession, d: str) -> DataFrame:
    return rounded(store_candles(spark, d, "scan").candles(DAY, "A", *RANGE))


def export_parquet_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    store = store_candles(spark, d, "export")
    path = store.path("exported")
    store.export("candles", path, DAY)
    return rounded(spark.read.parquet(path))


def upsert_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """Every tick is stored; then every tick comes again half an hour later, with twice its quote."""
    ticks = market.ticks(spark, d).select("symbol", "epoch", "quote", F.col("tick_id").cast("long").alias("tick_id"))
    stored = quality.upserted(ticks.limit(0), ticks.withColumn("at", F.col("tick_id")), ["symbol", "epoch"], "at")
    return rounded(quality.upserted(stored, ticks.withColumns({"at": F.col("tick_id"), "epoch": F.col("epoch") + 1800, "quote": F.col("quote") * 2}), ["symbol", "epoch"], "at"))


def upsert_all_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Every tick is stored; then every tick comes again with its quote raised by one."""
    ticks = market.ticks(spark, d).select("symbol", "epoch", "quote", F.col("tick_id").cast("long").alias("tick_id"))
    ticks = ticks.withColumn("at", F.col("tick_id"))
    stored = quality.upserted(ticks.drop("at").limit(0), ticks, ["symbol", "epoch"], "at")
    return rounded(quality.upserted(stored, ticks.withColumn("quote", F.col("quote") + 1), ["symbol", "epoch"], "at"))


#: Codes of the sample's symbols.
CODE = "^[A-Za-z]+$"


def upsert_ties(spark: SparkSession, d: str) -> DataFrame:
    """All ticks under the beginning of their minutes, put as one batch: of one minute the tick with the highest number wins. Then the
    ticks of every other hour come again, in order of arrival, so that the order of rows decides."""
    store = Store(spark, shared_folder(spark, "ties"))
    ticks = market.ticks(spark, d).withColumns({"epoch": F.col("epoch") - F.col("epoch") % 60, "number": F.col("tick_id").cast("long")})
    store.put_ticks(ticks, "number")
    store.put_ticks(ticks.where(F.col("epoch") % (2 * HOUR) < HOUR).withColumn("quote", F.col("quote") + 1).orderBy("arrival"))
    return rounded(store.ticks())


def history_paged_ticks(spark: SparkSession, d: str) -> DataFrame:
    """All ticks as recorded pages, read by walking back from the end."""
    folder, end = shared_folder(spark, "pages"), GRID[1]
    recorded.record(recorded.pages(market.ticks(spark, d), "ticks", end, 500), folder)
    return rounded(recorded.read_history(spark, folder, kind="ticks", start=GRID[0], end=end, count=500))


def history_paged_candles(spark: SparkSession, d: str) -> DataFrame:
    """All daily candles as pages that the service cuts at 1000, read in three spans of a symbol."""
    folder, end = shared_folder(spark, "pages"), 2_000_000_000
    recorded.record(recorded.pages(market.daily(spark, d), "candles", end, recorded.CANDLE_LIMIT), folder)
    return rounded(recorded.read_history(spark, folder, kind="candles", start=0, end=end, granularity=DAY, spans=3).drop("granularity"))


def live_messages(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """(file, line, json): every event as a message, an hour a file; as a tick, or as what it makes of its hour's candle so far."""
    rows = market.ticks(spark, d).withColumn("open_time", F.col("epoch") - F.col("epoch") % HOUR).withColumn("number", F.col("tick_id").cast("long"))
    so_far = Window.partitionBy("symbol", "open_time").orderBy("epoch", "number").rowsBetween(Window.unboundedPreceding, 0)
    if kind == "tick":
        said = F.struct("symbol", "epoch", "quote", F.col("tick_id").alias("id"))
    else:
        prices = {"open": F.first("quote"), "high": F.max("quote"), "low": F.min("quote"), "close": F.last("quote")}
        said = F.struct("symbol", "open_time", *[f.over(so_far).cast("string").alias(n) for n, f in prices.items()], F.lit(HOUR).alias("granularity"))
    rows = rows.withColumn("line", F.row_number().over(Window.partitionBy("open_time").orderBy("epoch", "number")))
    return rows.select(F.format_string("%012d", "open_time").alias("file"), "line", F.to_json(F.struct(said.alias(kind))).alias("json"))


def live_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Ticks of a live stream, each once, though the stream was stopped half-way and its last batch begun anew.

    The first stream has the messages before the middle hour. The second has the others too and dies when it has written them,
    before their batch is done; the third begins this batch anew."""
    folder, died = shared_folder(spark, "live"), []

    def run(written: Callable[[int], None] | None = None) -> None:
        live.write_latest(recorded.read_live(spark, f"{folder}/messages"), f"{folder}/out", f"{folder}/check", written=written).awaitTermination()

    def die(number: int) -> None:
        died.append(number)
        raise RuntimeError(f"stopped before batch {number} is done")

    middle = market.ticks(spark, d).agg(F.floor((F.min("epoch") + F.max("epoch")) / (2 * HOUR)) * HOUR).first()[0]
    messages, later = live_messages(spark, d, "tick"), F.col("file") >= F.format_string("%012d", F.lit(middle))
    recorded.record_lines(messages.where(~later), f"{folder}/messages")
    run()
    recorded.record_lines(messages.where(later), f"{folder}/messages")
    try:
        run(die)
    except StreamingQueryException:
        if not died:
            raise
    run()
    return rounded(spark.read.parquet(f"{folder}/out").select("symbol", "epoch", "quote", "tick_id"))


def live_candles(spark: SparkSession, d: str) -> DataFrame:
    """The last update of every hour's candle from a live stream."""
    folder = shared_folder(spark, "live")
    recorded.record_lines(live_messages(spark, d, "ohlc"), f"{folder}/messages")
    live.write_latest(recorded.read_live(spark, f"{folder}/messages", "ohlc"), f"{folder}/out", f"{folder}/check", ["file", "line"]).awaitTermination()
    return rounded(live.LatestTable(spark, f"{folder}/out").read().drop("granularity"))


def symbol_registry_diff(spark: SparkSession, d: str) -> DataFrame:
    return history.registry_diff(market.daily(spark, d).select("symbol"), market.symbols(spark), CODE)


def tick_pages(spark: SparkSession, d: str) -> DataFrame:
    """All ticks as pages of JSON text, a day each, which overlap by the first ten minutes of the next day."""
    rows = market.ticks(spark, d).select("symbol", "epoch", "quote").withColumn("page", F.floor(F.col("epoch") / DAY))
    rows = rows.unionByName(rows.where(F.col("epoch") % DAY < 600).withColumn("page", F.col("page") - 1))
    held = F.sort_array(F.collect_list(F.struct("epoch", "quote")))
    rows = rows.groupBy("symbol", "page").agg(held.alias("x"))
    return rows.select("symbol", "page", F.to_json(F.struct(F.struct(F.col("x.epoch").alias("times"), F.col("x.quote").alias("prices")).alias("history"))).alias("json"))


def candle_pages(spark: SparkSession, d: str) -> DataFrame:
    """All daily candles as pages of JSON text, a year each; a later page has the first candles of a year again, one higher."""
    rows = market.daily(spark, d).withColumn("page", F.floor(F.col("epoch") / (365 * DAY)))
    again = rows.where(F.col("epoch") % (365 * DAY) < 30 * DAY).withColumn("page", F.col("page") + 1).withColumn("close", F.col("close") + 1)
    held = F.collect_list(F.struct("epoch", "open", "high", "low", "close"))
    return rows.unionByName(again).groupBy("symbol", "page").agg(F.to_json(F.struct(held.alias("candles"))).alias("json"))


def parse_history_json(spark: SparkSession, d: str) -> DataFrame:
    return rounded(history.tick_pages(tick_pages(spark, d)))


def history_pages_dedup(spark: SparkSession, d: str) -> DataFrame:
    return rounded(history.merged_ticks(history.tick_pages(tick_pages(spark, d)), *TICK_RANGE))


def candle_pages_dedup(spark: SparkSession, d: str) -> DataFrame:
    return rounded(history.merged_candles(history.candle_pages(candle_pages(spark, d)), *RANGE))


def report_texts(spark: SparkSession, d: str) -> DataFrame:
    """(name, text): a report on daily candles and one on hourly ones, with the window of each symbol."""

    def of(name: str, rows: DataFrame) -> DataFrame:
        each = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.min("epoch").alias("first"), F.max("epoch").alias("last"), F.count(F.when(F.col("close") > F.col("open"), 1)).alias("up"), F.count(F.when(F.col("close") < F.col("open"), 1)).alias("down"))
        lines = F.array_join(F.sort_array(F.collect_list(F.format_string("| %s | %d | %d | %d |", "symbol", "n", "first", "last"))), "\n")
        numbers = {
            "UTC report date": F.from_unixtime(F.max("last"), "yyyy-MM-dd"), "Alpha": F.lit("0.05"), "Eligible rows per p-value family": F.sum("n"), "Bonferroni discoveries": F.sum("up"), "Seeded driftless GBM replications": F.count("*"),
            "Tests per replication": F.max("n"), "Raw circular-shift p < alpha": F.format_string("%.3f%%", 100 * F.sum("up") / F.sum("n")), "BH survivors / all null tests": F.format_string("%.3f%%", 100 * F.sum("down") / F.sum("n")), "Confirmed null edges": F.sum("down"),
        }
        text = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in numbers.items()], F.lit("\n| symbol | candles | first | last |\n|---|---|---|---|"), lines)
        return each.agg(text.alias("value")).withColumn("name", F.lit(name))

    return of("daily", market.daily(spark, d)).unionByName(of("hourly", market.hourly(spark, d)))


def parse_report_header(spark: SparkSession, d: str) -> DataFrame:
    """Of reports that are stored as text files."""
    folder = shared_folder(spark, "reports")
    report_texts(spark, d).write.partitionBy("name").option("lineSep", "\n").text(folder)
    return rounded(history.parse_reports(spark.read.text(folder, wholetext=True).withColumnRenamed("value", "text")))


def bad_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Every tick with its quote, and with a quote of 0, below 0, that isn't a number, and without one, by the number of the tick."""
    spoiled = F.array(F.lit(0.0), -F.col("quote"), F.lit(float("nan")), F.lit(None).cast("double"), F.lit(float("inf")), F.col("quote"))
    return market.ticks(spark, d).withColumn("quote", F.element_at(spoiled, (F.col("tick_id").cast("long") % 6 + 1).cast("int")))


def invalid_prices(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.invalid_prices(bad_ticks(spark, d), ["quote"])
    return rows.select("symbol", "epoch", "field", F.when(F.isnan("price"), "nan").otherwise(F.when(F.abs("price") == float("inf"), "inf").otherwise(F.round("price", 6).cast("string"))).alias("kind")).select("symbol", "epoch", "field", F.when(F.col("kind").isin("nan", "inf"), F.col("kind")).when(F.col("kind").isNull(), "null").otherwise("not positive").alias("kind"))


def hourly_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.daily_report(market.hourly(spark, d), HOUR, ["open", "high", "low", "close"])


def symbol_status(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.symbol_status(hourly_report(spark, d), market.symbols(spark), 50.0))


def union_reports(spark: SparkSession, d: str) -> DataFrame:
    """The reports of hourly and of daily candles as one."""
    daily = quality.daily_report(market.daily(spark, d), DAY, ["open", "high", "low", "close"])
    return rounded(hourly_report(spark, d).withColumn("granularity", F.lit(HOUR)).unionByName(daily.withColumn("granularity", F.lit(DAY))))


#: The grid of gaps and backfills over hourly candles: it begins before the first and ends after the last one.
GRID = (1_703_980_800, 1_707_004_800)


def coverage(spark: SparkSession, d: str) -> DataFrame:
    return quality.daily_coverage(market.ticks(spark, d), market.symbols(spark))


def latest_n(spark: SparkSession, d: str) -> DataFrame:
    return rounded(screen.latest_rows(market.daily(spark, d), 20))


def of_screen(f: Callable) -> Query:
    """f of the calibration signals of every symbol."""
    return lambda spark, d: rounded(f(screen.calibration_signals(market.daily(spark, d), market.symbols(spark), DAY)))


def screen_rows(spark: SparkSession, d: str) -> DataFrame:
    return screen.latest(market.daily(spark, d), market.symbols(spark), DAY)


def screen_latest(spark: SparkSession, d: str) -> DataFrame:
    return rounded(screen_rows(spark, d).withColumn("flags", F.array_join("flags", ",")))


def screen_flags_array(spark: SparkSession, d: str) -> DataFrame:
    return screen_rows(spark, d).select("symbol", F.posexplode("flags").alias("place", "flag"))


def screen_json(spark: SparkSession, d: str) -> DataFrame:
    return screen.as_json(screen.screen(market.daily(spark, d), market.symbols(spark), DAY))


def last_segment(spark: SparkSession, d: str) -> DataFrame:
    return screen.last_segments(screen.split(market.daily(spark, d)), DAY).groupBy("symbol").agg(F.count("*").alias("n"), F.min("epoch").alias("first"), F.max("epoch").alias("last"))


def seed_hash(spark: SparkSession, d: str) -> DataFrame:
    """The seeds of all flags of all symbols that have candles."""
    names = market.daily(spark, d).select("symbol").unionByName(market.hourly(spark, d).select("symbol")).distinct()
    rows = names.withColumn("flag", F.explode(F.array(*map(F.lit, screen.FLAGS))))
    return rows.select("symbol", "flag", screen.seed_hash(12345, F.concat("symbol", "flag")).cast("long").alias("seed"))


def annualized(spark: SparkSession, d: str) -> DataFrame:
    """The volatility of all returns of each symbol, as one of a year."""
    rows = ind.log_return(market.daily(spark, d), DAY).groupBy("symbol").agg(F.stddev_samp("r").alias("v"))
    return rounded(rows.select("symbol", ind.annualized(F.col("v"), DAY).alias("volatility")))


def snapshot_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol of the registry with its state, the row on display and the last monitor window, where it has them."""
    monitor = stats.latest_monitor(stats.volatility_monitor(market.daily(spark, d), market.symbols(spark), DAY, 500))
    state = quality.symbol_status(quality.daily_report(market.daily(spark, d), DAY, ["open", "high", "low", "close"]), market.symbols(spark))
    rows = state.select("symbol", F.col("status").alias("data_status")).join(screen_latest(spark, d).select("symbol", "epoch", "close", "trend", "flags"), "symbol", "left")
    return rounded(rows.join(monitor.select("symbol", F.col("status").alias("monitor_status"), "realized", "alert"), "symbol", "left"))


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol").agg(F.count("*").alias("n"))


def forward(horizon: int, product: Product) -> Query:
    return lambda spark, d: rounded(trades.forward_trades(market.daily(spark, d), DAY, body_signal(), horizon, product))


def validated_trades(spark: SparkSession, d: str) -> DataFrame:
    """Trades over candles that have been checked in the pass that writes them."""
    rows = trades.validated(market.daily(spark, d).withColumn("granularity", F.lit(DAY)))
    return rounded(trades.forward_trades(rows.drop("granularity"), DAY, body_signal(), 1, PRODUCT))


def strided(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trades.strided_trades(market.daily(spark, d), DAY, body_signal(), 5, PRODUCT))


def one_day(spark: SparkSession, d: str, product: Product = PRODUCT) -> tuple[DataFrame, DataFrame]:
    rows = market.daily(spark, d)
    return rows, trades.forward_trades(rows, DAY, body_signal(), 1, product)


def backtest_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trades.report(*one_day(spark, d), DAY, PRODUCT))


def backtest_payout(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trades.report(*one_day(spark, d, PAYOUT), DAY, PAYOUT, trials=20))


def backtest_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trades.drawdown(one_day(spark, d)[1], DAY, 10_000.0))


def wf_backtest(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trades.walk_forward(*one_day(spark, d), DAY, PRODUCT, 500, 200, 250))


def dsr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trades.deflated_sharpe(one_day(spark, d)[1], PRODUCT.stake, 10, ["symbol"]))


def strategies(spark: SparkSession, d: str) -> DataFrame:
    """(strategy, epoch, value): daily candles' body and range against the open, summed over symbols, as returns of two strategies."""
    rows = market.daily(spark, d).groupBy("epoch").agg(F.avg(F.col("close") / F.col("open") - 1).alias("body"), F.avg(F.col("open") / F.col("close") - 1).alias("fade"))
    return rows.select("epoch", F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(n).alias("value")) for n in ("body", "fade")])).alias("x")).select("x.strategy", "epoch", "x.value")


def wrc_statistic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trades.reality_check(strategies(spark, d), DAY, 199, 3, 5)).select("observed", "strategies")


def wrc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trades.reality_check(strategies(spark, d), DAY, 199, 3, 5))


def one_hour(spark: SparkSession, d: str) -> DataFrame:
    """Trades of an hour each, so that a day has many."""
    return trades.forward_trades(market.hourly(spark, d), HOUR, body_signal(), 1, PRODUCT)


def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ledger.breaker(one_hour(spark, d), 15.0, 3))


def circuit_breaker_fold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ledger.breaker_fold(one_hour(spark, d), 15.0, 12))


def kelly(spark: SparkSession, d: str) -> DataFrame:
    rows = market.daily(spark, d)
    rates = trades.forward_trades(rows, DAY, body_signal(), 1, Product()).groupBy("symbol").agg(F.avg(F.when(F.col("won"), 1.0).otherwise(0.0)).alias("win_rate"))
    return rounded(ledger.kelly(rates, 1.5, 0.5, 0.02, 10_000.0, SIZED))


#: The contract that stakes are measured for.
SIZED = Product(stake=1.0, multiplier=2.0, stop_out=0.5, commission=0.2, spread=0.001)


def sizes(spark: SparkSession, d: str) -> DataFrame:
    """Stakes of the symbols that have candles, by the volatility of their last window of 5 returns."""
    last = ind.realized_vol(market.daily(spark, d), DAY, 5).where("vol is not null").groupBy("symbol").agg(F.max_by("vol", "epoch").alias("stated_vol"))
    return rounded(ledger.sizes(last, 10_000.0, 0.1, SIZED, 0.03))


def settle_returns(spark: SparkSession, d: str) -> DataFrame:
    """Every candle as a trade on its own open, high, low and close, in both directions."""
    rows = market.daily(spark, d).select("symbol", F.col("epoch").alias("at"), F.col("epoch").alias("last"), F.col("open").alias("entry"), F.col("close").alias("exit"), "low", "high", F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("direction"))
    return rounded(trades.settled(rows.where("entry > 0"), DAY, PRODUCT).select("symbol", "decision", "direction", "gross", "net", "reason"))


def traded(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The registry's symbols that have candles."""
    return market.symbols(spark).join(rows.select("symbol").distinct(), "symbol", "left_semi")


def portfolio_corr(spark: SparkSession, d: str) -> DataFrame:
    """Of all symbols that have daily candles."""
    rows = market.daily(spark, d)
    return rounded(risk.portfolio_view(ind.log_return(rows, DAY), traded(spark, rows))[0])


def portfolio_risk(spark: SparkSession, d: str) -> DataFrame:
    rows = market.daily(spark, d)
    return rounded(risk.portfolio_view(ind.log_return(rows, DAY), traded(spark, rows), threshold=0.05)[1])


def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    """The family: one-sided exact binomial p of each symbol's rising candles in each year."""
    rows = market.daily(spark, d).groupBy("symbol", F.floor(F.col("epoch") / 31_557_600).alias("year")).agg(F.count("*").alias("n"), F.count(F.when(F.col("close") > F.col("open"), 1)).alias("k"))
    rows = rows.withColumn("p", stats.binomial_sf(F.col("k"), F.col("n"), F.lit(0.5)))
    tests = stats.benjamini_hochberg(rows)
    return rounded(tests.withColumn("bonferroni", F.least(F.lit(1.0), F.col("p") * F.count("*").over(Window.partitionBy()))))


def ledger_calls(spark: SparkSession, d: str) -> DataFrame:
    return ledger.directions(screen.features(market.daily(spark, d), market.symbols(spark), DAY))


#: When the ledger is looked at, and when a screen is recorded.
NOW, RECORDED = 852_076_800, 800_000_000


def ledger_record(spark: SparkSession, d: str) -> DataFrame:
    """Calls of all screen rows whose entry isn't open at RECORDED; the reversion calls are known already."""
    rows = screen.features(market.daily(spark, d), market.symbols(spark), DAY)
    known = ledger.directions(rows).where("strategy = 'reversion'").select(F.concat_ws("|", "symbol", "strategy", "epoch").alias("id"))
    return ledger.recorded(rows, known, DAY, RECORDED)


def ledger_score(spark: SparkSession, d: str) -> DataFrame:
    """Calls recorded at their candle: those that wait at NOW expire after three days."""
    return rounded(ledger.scored(ledger_calls(spark, d).withColumn("recorded", F.col("epoch")), market.daily(spark, d), DAY, now=NOW).drop("recorded"))


def ledger_store(spark: SparkSession, d: str) -> DataFrame:
    """A stored ledger: calls recorded at RECORDED, twice, and scored at two times, of which the second ends all waiting."""
    store = LedgerStore(spark, shared_folder(spark, "ledger"))
    rows, candles = screen.features(market.daily(spark, d), market.symbols(spark), DAY), market.daily(spark, d)
    for _ in range(2):
        store.record(rows, DAY, RECORDED)
    for now in (RECORDED + 100 * DAY, NOW):
        store.score(candles, DAY, now)
    return rounded(store.rows())


def ledger_recent(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ledger.recent(ledger.scored(ledger_calls(spark, d), market.daily(spark, d), DAY, now=NOW)))


def ledger_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ledger.summary(ledger.scored(ledger_calls(spark, d), market.daily(spark, d), DAY, now=NOW)))


def monitor(spark: SparkSession, d: str, n: int) -> DataFrame:
    return stats.volatility_monitor(market.daily(spark, d), market.symbols(spark), DAY, n)


def hypothesis_rows(spark: SparkSession, d: str) -> DataFrame:
    return edge.hypotheses(market.daily(spark, d), market.symbols(spark), DAY, PRODUCT)


def edge_scope(scope: str) -> Query:
    return lambda spark, d: rounded(hypothesis_rows(spark, d).where(F.col("scope") == scope))


def edge_tests(spark: SparkSession, d: str) -> DataFrame:
    return edge.tested(hypothesis_rows(spark, d))


def edge_shift_p_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(edge.shift_p_all(edge.turned(market.daily(spark, d), market.symbols(spark), DAY, PRODUCT)))


def edge_analysis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(edge.analysis(market.daily(spark, d), market.symbols(spark), DAY, PRODUCT))


def edge_analysis_seeded(spark: SparkSession, d: str) -> DataFrame:
    return rounded(edge.analysis(market.daily(spark, d), market.symbols(spark), DAY, PRODUCT, 2000, 12345))


def edge_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path, rows = shared_folder(spark, "csv"), rounded(hypothesis_rows(spark, d))
    history.write_csv(rows, path)
    return history.read_csv(spark, path, ", ".join(f"{c} {t}" for c, t in rows.dtypes))


def payouts(spark: SparkSession, d: str) -> DataFrame:
    return edge.break_even(hypothesis_rows(spark, d), 0.95).drop("payout")


def payout_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(edge.payout_summary(edge.break_even(hypothesis_rows(spark, d), 0.9, 0.95, 1.0)))


def edge_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    net = one_day(spark, d)[1].select("symbol", F.col("decision").alias("epoch"), "net")
    return rounded(resampling.interval(resampling.stationary_means(net, DAY, ["symbol"], "net", 200, 7), ["symbol"]))


def edge_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = edge.flagged_candidates(market.daily(spark, d), market.symbols(spark), DAY, PRODUCT)
    return rounded(edge.confidence(rows, DAY, edge.KEYS, 50, 7))


def signal(f: Callable, *args) -> Query:
    return lambda spark, d: rounded(f(market.daily(spark, d), DAY, body_signal(), *args))


QUERIES: dict[str, Query] = {
    "scan_ticks_range": scan_ticks_range,
    "scan_ticks_bounds": scan_ticks_bounds,
    "scan_candles_range": scan_candles_range,
    "upsert_candles": upsert_candles,
    "store_scan": store_scan,
    "upsert_ties": upsert_ties,
    "history_paged_ticks": history_paged_ticks,
    "history_paged_candles": history_paged_candles,
    "live_ticks": live_ticks,
    "live_candles": live_candles,
    "export_parquet_roundtrip": export_parquet_roundtrip,
    "parse_history_json": parse_history_json,
    "history_pages_dedup": history_pages_dedup,
    "candle_pages_dedup": candle_pages_dedup,
    "parse_report_header": parse_report_header,
    "backfill_missing_epochs": on_hourly(quality.missing_epochs, HOUR, GRID[1]),
    "backfill_coverage": on_hourly(quality.backfill_coverage, HOUR, *GRID),
    "dq_symbol_status": symbol_status,
    "dq_union_reports": union_reports,
    "upsert_latest_wins": upsert_latest_wins,
    "upsert_all_ticks": upsert_all_ticks,
    "symbol_registry_diff": symbol_registry_diff,
    "dq_duplicate_epochs": on_ticks(quality.duplicate_epochs),
    "dq_non_monotonic": on_ticks(quality.non_monotonic),
    "dq_invalid_prices": invalid_prices,
    "dq_abnormal_jumps": on_ticks(quality.abnormal_jumps, 3.0, 100),
    "dq_daily_coverage": lambda spark, d: rounded(coverage(spark, d)),
    "dq_coverage_rollup": lambda spark, d: rounded(quality.coverage_rollup(coverage(spark, d))),
    "find_gaps": on_hourly(quality.gaps, HOUR, *GRID),
    "gap_count": on_hourly(quality.gap_count, HOUR),
    "segment_islands": lambda spark, d: ind.segmented(market.hourly(spark, d), HOUR).groupBy("symbol", "segment").agg(F.count("*").alias("n"), F.max("epoch").alias("last")),
    "ind_log_return": on_daily(ind.log_return),
    "ind_bollinger_z": on_daily(ind.bollinger_z),
    "ind_annualize": annualized,
    "ind_realized_vol": on_daily(ind.realized_vol),
    "ind_realized_vol_elapsed": on_daily(ind.realized_vol_elapsed),
    "ind_parkinson": on_daily(ind.parkinson),
    "ind_autocorr": on_daily(ind.autocorrelation),
    "ind_variance_ratio": on_daily(ind.variance_ratio),
    "ind_hurst_vr": on_daily(ind.hurst_variance),
    "ind_hurst_rs": on_daily(ind.hurst_rs),
    "ind_skew": on_daily(ind.skewness),
    "ind_kurtosis": on_daily(ind.kurtosis),
    "ind_ema": on_daily(ind.ema),
    "ind_rsi": on_daily(ind.rsi),
    "ind_atr": on_daily(ind.atr),
    "screen_features": with_symbols(screen.features),
    "flags_causal": with_symbols(screen.flagged),
    "flags_filled": with_symbols(screen.causal_flags),
    "causality": with_symbols(screen.causality, 20),
    "validated_trades": validated_trades,
    "screen_latest": screen_latest,
    "screen_flags_array": screen_flags_array,
    "screen_json": screen_json,
    "last_segment": last_segment,
    "seed_hash": seed_hash,
    "snapshot_rows": snapshot_rows,
    "screen_reliability": of_screen(screen.reliability),
    "screen_shift_p_all": of_screen(screen.shift_p),
    "screen_shift_p": of_screen(lambda rows: screen.shift_p(rows, 199, 12345)),
    "screen_bh": of_screen(lambda rows: stats.benjamini_hochberg(screen.shift_p(rows))),
    "latest_n": latest_n,
    "split_calibration": lambda spark, d: screen.split(market.daily(spark, d)).select("symbol", "epoch", "part"),
    "trades_h1": forward(1, PRODUCT),
    "trades_h5": forward(5, PRODUCT),
    "trades_fixed_payout": forward(1, PAYOUT),
    "trades_strided": strided,
    "backtest_report": backtest_report,
    "backtest_payout": backtest_payout,
    "wf_backtest": wf_backtest,
    "dsr": dsr,
    "wrc_statistic": wrc_statistic,
    "wrc": wrc,
    "settle_returns": settle_returns,
    "portfolio_corr": portfolio_corr,
    "portfolio_risk": portfolio_risk,
    "circuit_breaker_fold": circuit_breaker_fold,
    "backtest_drawdown": backtest_drawdown,
    "wf_splits": lambda spark, d: trades.walk_forward_splits(counts(market.daily(spark, d)), 500, 250, 200),
    "vol_monitor": lambda spark, d: rounded(monitor(spark, d, 500)),
    "vol_monitor_latest": lambda spark, d: rounded(stats.latest_monitor(monitor(spark, d, 500))),
    "vol_variance_stat": lambda spark, d: rounded(stats.variance_test(stats.latest_monitor(monitor(spark, d, 100)))),
    "ljung_box": on_daily(stats.ljung_box),
    "runs_test": on_daily(stats.runs_test),
    "randomness_battery": on_daily(stats.randomness_battery),
    "signal_eval": signal(stats.signal_evaluation, 5),
    "signal_eval_h1": signal(stats.signal_evaluation, 1),
    "signal_bootstrap": signal(stats.signal_bootstrap, 5, 99, 5),
    "xsym_corr": on_daily(stats.cross_correlation),
    "bh_adjust": bh_adjust,
    "ledger_directions": ledger_calls,
    "ledger_record": ledger_record,
    "ledger_score": ledger_score,
    "ledger_store": ledger_store,
    "ledger_recent": ledger_recent,
    "ledger_summary": ledger_summary,
    "size_positions": sizes,
    "size_kelly": kelly,
    "circuit_breaker_running": circuit_breaker,
    "variance_ratio_test": on_daily(stats.variance_ratio_test),
    "arch_lm": on_daily(stats.arch_lm, 1),
    "arch_lm_lags": on_daily(stats.arch_lm, 5),
    "vol_breach_rate": lambda spark, d: rounded(stats.breach_rate(monitor(spark, d, 100), market.symbols(spark), DAY, 100)),
    "identical_ratio_pairs": lambda spark, d: stats.identical_ratios(monitor(spark, d, 100)),
    "edge_candidates": lambda spark, d: rounded(edge.candidates(market.daily(spark, d), DAY, PRODUCT).drop("run")),
    "edge_symbol_rows": edge_scope("symbol"),
    "edge_pooled_rows": edge_scope("pooled"),
    "edge_tests": lambda spark, d: rounded(edge_tests(spark, d).drop("mde_points")),
    "edge_mde": lambda spark, d: rounded(edge_tests(spark, d).select("scope", "symbol", *edge.KEYS, "n_effective", "mde_points")),
    "edge_shift_p_all": edge_shift_p_all,
    "edge_csv_roundtrip": edge_csv_roundtrip,
    "edge_top15": lambda spark, d: rounded(edge.top_pooled(edge_tests(spark, d).drop("mde_points").withColumn("binomial_adjusted_p", F.round("binomial_adjusted_p", 6)), "binomial_adjusted_p")),
    "pooled_tests": lambda spark, d: rounded(edge.pooled_pairs(edge_tests(spark, d).withColumn("binomial_adjusted_p", F.round("binomial_adjusted_p", 6)), "binomial_adjusted_p")),
    "edge_analysis_seeded": edge_analysis_seeded,
    "edge_confidence": edge_confidence,
    "edge_analysis": edge_analysis,
    "edge_confirmed": lambda spark, d: edge.confirmed(edge_tests(spark, d), ["scope", "symbol"], "binomial_adjusted_p", 0.9),
    "payout_breakeven": lambda spark, d: rounded(payouts(spark, d)),
    "payout_replicated": lambda spark, d: edge.replicated(payouts(spark, d), 5),
    "payout_summary": payout_summary,
    "payout_top8": lambda spark, d: rounded(edge.ranked(payouts(spark, d))),
    "edge_bootstrap": edge_bootstrap,
    "data_window": lambda spark, d: edge.data_window(market.daily(spark, d)),
    "technical_read": with_symbols(lambda c, s, step: edge.technical_read(screen.latest(c, s, step))),
}
