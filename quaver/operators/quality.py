"""Data quality of tick and candle series: duplicates, order of arrival, prices, jumps, coverage and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_epochs(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol", "epoch").agg(F.count("*").alias("n")).where("n > 1")


def with_previous(rows: DataFrame, order: str, span: int, *columns: str, keys: list[str] | None = None) -> DataFrame:
    """Adds previous_<column>, the value of the row before in `order`; windows run inside spans, whose last rows are chained."""
    keys = keys or ["symbol"]
    rows = rows.withColumn("_span", F.floor(F.col(order) / span))
    ends = rows.groupBy(*keys, "_span").agg(*[F.max_by(c, order).alias(f"_end_{c}") for c in columns])
    chain = Window.partitionBy(*keys).orderBy("_span")
    ends = ends.select(*keys, "_span", *[F.lag(f"_end_{c}").over(chain).alias(f"_end_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "_span").orderBy(order)
    first = F.row_number().over(inside) == 1
    return rows.join(ends, [*keys, "_span"]).withColumns({f"previous_{c}": F.when(first, F.col(f"_end_{c}")).otherwise(F.lag(c).over(inside)) for c in columns}).drop("_span", *[f"_end_{c}" for c in columns])


#: Arrival numbers in a span; about 1000 spans of the sample's numbers.
ARRIVALS = 100_000_000


def non_monotonic(ticks: DataFrame) -> DataFrame:
    """Ticks whose epoch is before that of the tick which arrived just before."""
    return with_previous(ticks, "arrival", ARRIVALS, "epoch").where("epoch < previous_epoch").select("symbol", "arrival", "previous_epoch", "epoch")


def invalid_prices(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each price field that isn't a finite number above 0."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (c <= 0)
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("price")) for c in columns])
    return rows.select("symbol", "epoch", F.explode(F.filter(fields, lambda x: bad(x["price"]))).alias("x")).select("symbol", "epoch", "x.field", "x.price")


def abnormal_jumps(ticks: DataFrame, sigma: float = 8.0, n: int = 100) -> DataFrame:
    """Returns beyond sigma deviations of up to n returns before, in order of arrival and over rising epochs only.

    Kept returns are numbered; a window of n runs in a chunk of numbers that begins with a halo of the n before."""
    valid = ticks.where("quote > 0 and quote < double('infinity')")  # NaN is above infinity
    kept = with_previous(valid, "arrival", ARRIVALS, "epoch", "quote").where("epoch > previous_epoch").withColumn("r", F.log(F.col("quote") / F.col("previous_quote")))
    kept = numbered_by(kept.select("symbol", "arrival", "epoch", "r"), "arrival", ARRIVALS, ["symbol"])
    kept = in_parts(kept, n)
    w = Window.partitionBy("symbol", "part").orderBy("at").rowsBetween(-n, -1)
    kept = kept.withColumn("sd", F.stddev_pop("r").over(w)).withColumn("seen", F.count("r").over(w)).where("seen >= 2 and not halo")
    kind = F.when((F.col("sd") == 0) & (F.col("r") != 0), "zero-variance-break").when(F.abs("r") > sigma * F.col("sd"), "sigma-threshold")
    return kept.withColumn("kind", kind).where("kind is not null").select("symbol", "arrival", "epoch", "kind", "r")


def numbered_by(rows: DataFrame, order: str, span: int, keys: list[str]) -> DataFrame:
    """Adds at, a row's number from 0 in `order` among its keys: its number in its span plus the rows of spans before."""
    rows = rows.withColumn("_span", F.floor(F.col(order) / span))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*keys, "_span").agg(F.count("*").alias("_c")).select(*keys, "_span", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(order))
    return rows.withColumn("_in", inside).join(base, [*keys, "_span"]).withColumn("at", F.col("_base") + F.col("_in") - 1).drop("_span", "_base", "_in")


def in_parts(rows: DataFrame, n: int) -> DataFrame:
    """Numbered rows in parts of their numbers, each after a halo of the n rows before it."""
    size = max(1024, 8 * n)
    own = F.floor(F.col("at") / size)
    return rows.withColumn("part", F.explode(F.sequence(own, F.floor((F.col("at") + n) / size)))).withColumn("halo", F.col("part") != own)


def aligned(low: Column, high: Column, step: Column) -> Column:
    """How many multiples of step lie in low..high."""
    return F.greatest(F.lit(0), F.floor(high / step) - F.ceil(low / step) + 1).cast("long")


def daily_coverage(ticks: DataFrame, symbols: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Expected and observed epochs on the symbol's grid, for each UTC day between start and end, by default its first and last epoch."""
    rows = ticks.join(symbols.select("symbol", "tick_interval"), "symbol")
    low, high = (how("epoch") if at is None else F.lit(at).cast("long") for how, at in ((F.min, start), (F.max, end)))
    ends = rows.groupBy("symbol", "tick_interval").agg(low.alias("low"), high.alias("high"))
    days = ends.select("*", F.explode(F.sequence(F.floor(F.col("low") / 86400), F.floor(F.col("high") / 86400))).alias("day"))
    days = days.withColumn("expected", aligned(F.greatest("low", F.col("day") * 86400), F.least("high", F.col("day") * 86400 + 86399), F.col("tick_interval")))
    seen = rows.where("epoch % tick_interval = 0").groupBy("symbol", F.floor(F.col("epoch") / 86400).alias("day")).agg(F.count_distinct("epoch").alias("observed"))
    share = F.when(F.col("expected") == 0, 100.0).otherwise(100.0 * F.try_divide(F.col("observed"), F.col("expected")))
    return days.join(seen, ["symbol", "day"], "left").withColumn("observed", F.coalesce("observed", F.lit(0))).select("symbol", "day", "expected", "observed", share.alias("coverage"))


def gaps(candles: DataFrame, step: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """Epochs on the grid, from start to before end, at which a symbol has no candle; without bounds from its first to its last one.

    Only breaks are expanded, so contiguous data cost one window and no grid. The bounds count as the ends of breaks; a symbol
    without any candle between them is not known here."""
    rows = candles.select("symbol", "epoch")
    if start is not None:
        rows = rows.where(F.col("epoch") >= start)
    if end is not None:
        rows = rows.where(F.col("epoch") < end)
    found = with_previous(rows, "epoch", step * 1024, "epoch").select("symbol", F.col("previous_epoch").alias("low"), F.col("epoch").alias("high"))
    ends = rows.groupBy("symbol").agg(F.min("epoch").alias("first"), F.max("epoch").alias("last"))
    if start is not None:
        found = found.unionByName(ends.select("symbol", F.lit(start - 1).cast("long").alias("low"), F.col("first").alias("high")))
    if end is not None:
        found = found.unionByName(ends.select("symbol", F.col("last").alias("low"), F.lit(end).cast("long").alias("high")))
    found = found.where("low is not null").withColumn("a", (F.floor(F.col("low") / step) + 1) * step).where("a < high")
    return found.select("symbol", F.explode(F.sequence("a", F.col("high") - 1, F.lit(step).cast("long"))).alias("epoch"))


def gap_count(candles: DataFrame, step: int) -> DataFrame:
    missing = F.greatest(F.lit(0), F.ceil((F.col("epoch") - F.col("previous_epoch")) / step) - 1).cast("long")
    return with_previous(candles, "epoch", step * 1024, "epoch").groupBy("symbol").agg(F.coalesce(F.sum(missing), F.lit(0)).alias("missing"))


def coverage_rollup(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("symbol").agg(F.sum("observed").alias("observed"), F.sum("expected").alias("expected"), (100.0 * F.sum("observed") / F.sum("expected")).alias("coverage"))


def upserted(stored: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """stored with the rows of batch put in by key; of rows with one key the last of the batch wins."""
    values = [c for c in stored.columns if c not in keys]
    both = stored.select(*keys, *values, F.struct(F.lit(0).alias("new"), F.lit(0).cast("long").alias("at")).alias("_at")).unionByName(
        batch.select(*keys, *values, F.struct(F.lit(1).alias("new"), F.col(order).cast("long").alias("at")).alias("_at"))
    )
    return both.groupBy(*keys).agg(F.max_by(F.struct(*values), "_at").alias("v")).select(*keys, "v.*")


def daily_report(rows: DataFrame, step: int, columns: list[str]) -> DataFrame:
    """(symbol, duplicates, invalid, gaps, coverage) of candles: findings and the least daily coverage between the first and last candle of all."""
    bounds = rows.agg(F.min("epoch").alias("low"), F.max("epoch").alias("high")).first()
    names = rows.select("symbol").distinct()
    coverage = daily_coverage(rows, names.withColumn("tick_interval", F.lit(step)), bounds.low, bounds.high)
    parts = [
        duplicate_epochs(rows).groupBy("symbol").agg(F.count("*").alias("duplicates")), invalid_prices(rows, columns).groupBy("symbol").agg(F.count("*").alias("invalid")),
        gap_count(rows.dropDuplicates(["symbol", "epoch"]), step).withColumnRenamed("missing", "gaps"), coverage.groupBy("symbol").agg(F.min("coverage").alias("coverage")),
    ]
    for part in parts:
        names = names.join(part, "symbol", "left")
    return names.na.fill(0, ["duplicates", "invalid", "gaps"])


def symbol_status(report: DataFrame, symbols: DataFrame, least: float = 99.0) -> DataFrame:
    """healthy, degraded or missing for every symbol of the registry."""
    healthy = (F.col("coverage") >= least) & (F.col("duplicates") + F.col("invalid") == 0)
    state = F.when(F.col("coverage").isNull(), "missing").when(healthy, "healthy").otherwise("degraded")
    return symbols.select("symbol").join(report, "symbol", "left").withColumn("status", state)


def backfill_coverage(candles: DataFrame, step: int, start: int, end: int) -> DataFrame:
    """(symbol, expected, observed, coverage) of the epochs on the grid from start to before end; 0 % where none is expected."""
    expected = max(0, -(-end // step) - -(-start // step))
    here = candles.where((F.col("epoch") >= start) & (F.col("epoch") < end) & (F.col("epoch") % step == 0)).groupBy("symbol").agg(F.count_distinct("epoch").alias("observed"))
    rows = candles.select("symbol").distinct().join(here, "symbol", "left").na.fill(0, ["observed"]).withColumn("expected", F.lit(expected).cast("long"))
    return rows.withColumn("coverage", F.coalesce(F.try_divide(100.0 * F.col("observed"), F.col("expected")), F.lit(0.0)))


def missing_epochs(stored: DataFrame, step: int, end: int) -> DataFrame:
    """(symbol, epoch) that a resumed backfill has to fetch: from the earlier of the first gap and two candles before the last
    stored one, up to before `end`, all epochs on the grid that aren't stored."""
    holes = gaps(stored, step)
    last = stored.groupBy("symbol").agg(F.max("epoch").alias("last"))
    start = last.join(holes.groupBy("symbol").agg(F.min("epoch").alias("hole")), "symbol", "left").select("symbol", F.least(F.col("last") - 2 * step, "hole").alias("start"))
    ahead = last.withColumn("a", (F.floor(F.col("last") / step) + 1) * step).where(F.col("a") < end).select("symbol", F.explode(F.sequence("a", F.lit(end - 1).cast("long"), F.lit(step).cast("long"))).alias("epoch"))
    return holes.unionByName(ahead).join(start, "symbol").where("epoch >= start").select("symbol", "epoch")


def upserted_candles(stored: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """stored with the candles of batch put in by (symbol, epoch, granularity); a batch of several granularities is refused."""
    if batch.select("granularity").distinct().limit(2).count() > 1:
        raise ValueError("a batch of candles must have one granularity")
    return upserted(stored, batch, ["symbol", "epoch", "granularity"], order)
