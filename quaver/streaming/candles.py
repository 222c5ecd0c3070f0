"""Candles from a stream of ticks, and a table that the last update of each candle wins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.sources.versions import Folder, Version, Versions


def candles(ticks: DataFrame, step: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Candles of (symbol, ts, quote, tick_id) ticks; ticks later than `late` are dropped, which bounds the state."""
    at = F.struct("ts", "tick_id")
    rows = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", step).alias("w"))
    rows = rows.agg(F.min_by("quote", at).alias("open"), F.max("quote").alias("high"), F.min("quote").alias("low"), F.max_by("quote", at).alias("close"))
    return rows.select("symbol", F.unix_timestamp("w.start").alias("epoch"), "open", "high", "low", "close")


def write_latest(updates: DataFrame, path: str, checkpoint: str, order: list[str] | None = None, written: Callable[[int], None] | None = None):
    """Appends every update with its batch number; latest() reads the last one of each candle. With `order`, columns that order
    the updates of one batch, only the last of these is kept. A batch whose number the checkpoint doesn't hold as done is begun
    anew by the next stream, and takes the place of what was written of it. `written` is told a batch's number between the two,
    once it is written and before it is done; what it raises ends the stream there."""

    def append(batch: DataFrame, number: int) -> None:
        if order:
            values = [c for c in batch.columns if c not in ("symbol", "epoch", *order)]
            batch = batch.groupBy("symbol", "epoch").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select("symbol", "epoch", "v.*")
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")
        if written:
            written(number)

    return updates.writeStream.outputMode("append" if order else "update").option("checkpointLocation", checkpoint).foreachBatch(append).trigger(availableNow=True).start()


def latest(rows: DataFrame) -> DataFrame:
    names = [c for c in rows.columns if c not in ("symbol", "epoch", "batch")]
    return rows.groupBy("symbol", "epoch").agg(F.max_by(F.struct(*names), "batch").alias("v")).select("symbol", "epoch", "v.*")


class LatestTable:
    """What write_latest() has written, whose batches are put together from time to time while the stream goes on.

    A version holds the last updates of all batches up to one; later batches are read beside it. The last batch is left out when
    batches are put together, as a stream that restarts may write it again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.table, self.files = spark, path, Versions(spark, f"{path}/_latest"), Folder(spark, path)

    def _batches(self, above: int) -> list[int]:
        """The numbers of the batches that are written whole."""
        found = [int(n.removeprefix("batch=")) for n in self.files.names() if n.startswith("batch=")]
        return [n for n in sorted(found) if n > above and self.files.exists(f"batch={n:012d}/_SUCCESS")]

    def _rows(self, version: Version, batches: list[int]) -> DataFrame:
        paths = [f"{self.path}/batch={n:012d}" for n in batches] + [f"{self.path}/_latest/{f}" for f in version.parts.get("base", [])]
        if not paths:
            raise FileNotFoundError(self.path)
        parts = [self.spark.read.parquet(p).withColumn("batch", F.col("batch").cast("long")) for p in paths[-1:]]
        if paths[:-1]:
            parts.append(self.spark.read.schema(parts[0].schema).option("recursiveFileLookup", "true").parquet(*paths[:-1]))
        return reduce(DataFrame.unionByName, parts)

    def read(self) -> DataFrame:
        version = self.table.current()
        return latest(self._rows(version, self._batches(version.notes.get("upto", -1))))

    def compact(self) -> int:
        """Puts all batches but the last one together; returns how many there were."""
        version = self.table.current()
        batches = self._batches(version.notes.get("upto", -1))[:-1]
        if batches:
            base = self.table.write(latest(self._rows(version, batches)).withColumn("batch", F.lit(batches[-1])))
            self.table.commit(version, {"base": [base]}, {"upto": batches[-1]})
        return len(batches)

    def vacuum(self) -> None:
        """Deletes batches that all kept versions hold, and bases that none has; no reader may be at one of these."""
        self.table.vacuum(1)
        upto = self.table.current().notes.get("upto", -1)
        for n in self._batches(-1):
            if n <= upto:
                self.files.delete(f"batch={n:012d}")
