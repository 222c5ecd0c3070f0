"""Candles, ticks and symbols as DataFrames.

The schemas are those of stored market data: a candle is (symbol, epoch of its open in UTC seconds, open, high, low,
close), a tick is (symbol, epoch, quote, tick_id). Candles are built from the order lines of a day or the events of an
hour, so that every operator runs on any of the sample tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY, HOUR = 86_400, 3_600
TICK = T.StructType([T.StructField("symbol", T.StringType(), False), T.StructField("epoch", T.LongType(), False), T.StructField("quote", T.DoubleType()), T.StructField("tick_id", T.StringType())])
CANDLE = T.StructType([T.StructField("symbol", T.StringType(), False), T.StructField("epoch", T.LongType(), False), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")]])

#: Annual volatility and seconds between ticks of each symbol.
SYMBOLS = [("A", 0.75, 1), ("N", 0.50, 1), ("R", 1.00, 2), ("click", 0.10, 1), ("view", 0.25, 1), ("purchase", 0.50, 2), ("signup", 0.75, 2), ("error", 1.00, 2)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    """UTC seconds of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def candles(rows: DataFrame, price: str, order: list[str]) -> DataFrame:
    """Candles of (symbol, epoch, price) rows; the first and last price of a candle are told by `order`."""
    at = F.struct(*order)
    return rows.groupBy("symbol", "epoch").agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"))


def between(column: str, start: int | None, end: int | None) -> list:
    """Conditions on a timestamp column, as literals that reach the Parquet scan, for seconds from start to end, both inclusive."""
    at = lambda s: F.expr(f"TIMESTAMP_NTZ '1970-01-01 00:00:00' + INTERVAL '{s}' SECOND")
    return [F.col(column) >= at(start)] * (start is not None) + ([F.col(column) < at(end + 1)] if end is not None else [])


def kept(rows: DataFrame, conditions: list) -> DataFrame:
    for c in conditions:
        rows = rows.where(c)
    return rows


def daily(spark: SparkSession, sf_dir: str, symbol: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Daily candles of order line prices by return flag; a symbol and inclusive bounds of epochs prune the scan."""
    rows = read(spark, sf_dir, "lineitem")
    rows = kept(rows, [F.col("l_returnflag") == symbol] * (symbol is not None) + between("l_shipdate", start, None if end is None else end - end % DAY + DAY - 1))
    rows = rows.select(F.col("l_returnflag").alias("symbol"), seconds("l_shipdate").alias("epoch"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return candles(rows, "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


def ticks(spark: SparkSession, sf_dir: str, symbol: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Event values as ticks; `arrival` is an order of arrival that isn't that of time. Bounds are inclusive and prune the scan."""
    rows = kept(read(spark, sf_dir, "events"), [F.col("event_type") == symbol] * (symbol is not None) + between("ts", start, end))
    return rows.select(
        F.col("event_type").alias("symbol"), seconds("ts").alias("epoch"), F.col("value").alias("quote"), F.col("event_id").cast("string").alias("tick_id"), (F.col("event_id") * 7919 % 10007 * 10_000_000 + F.col("event_id")).alias("arrival")
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles of event values by type."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), seconds("ts").alias("second"), "event_id", "value")
    return candles(rows.withColumn("epoch", F.col("second") - F.col("second") % HOUR), "value", ["second", "event_id"])


def symbols(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYMBOLS, "symbol string, stated_vol double, tick_interval int")
