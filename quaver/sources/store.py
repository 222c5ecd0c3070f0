"""A folder of stored ticks and candles: Parquet by spans of time, range scans that prune and push down, upserts of whole spans at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.operators import quality
from quaver.session import written
from quaver.sources.market import CANDLE, DAY, TICK
from quaver.sources.versions import Versions

#: Steps of a series in one folder; a tick counts as a second.
SPAN = {"ticks": 7 * DAY, "candles": 8192}


def checked(rows: DataFrame, schema: T.StructType, *more: str) -> DataFrame:
    """rows as the schema has them, and `more` columns: its columns, in its types; a missing column or a null in a key is an error."""
    lost = [f.name for f in schema if f.name not in rows.columns]
    if lost:
        raise ValueError(f"columns are missing: {lost}")
    held = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]
    keys = [f.name for f in schema if not f.nullable]
    return rows.select(*[c if n not in keys else F.coalesce(c, F.raise_error(F.lit(f"null in {n}")).cast(schema[n].dataType)).alias(n) for c, n in zip(held, schema.names, strict=True)], *more)


class Store:
    """Ticks under root/ticks and candles under root/candles, each a table of versions whose parts are spans of time, for candles of a
    granularity. A write replaces the spans that it touches, all at once.

    With read_only the folder must exist and nothing is written. After close() nothing is read or written."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only, self.open = spark, root.rstrip("/"), read_only, True
        self.tables = {name: Versions(spark, self.path(name)) for name in SPAN}
        if read_only and not any(t.current().number for t in self.tables.values()):
            raise FileNotFoundError(root)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.open = False

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _ready(self, write: bool = False) -> None:
        if not self.open:
            raise RuntimeError("the store is closed")
        if write and self.read_only:
            raise PermissionError("the store is read-only")

    def has(self, name: str, granularity: int | None = None) -> bool:
        self._ready()
        return any(granularity is None or int(p.partition("/")[0]) == granularity for p in self.tables[name].current().parts)

    def ticks(self, symbol: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """Ticks of a symbol from start to end, both inclusive; ordered by symbol and epoch."""
        return self._scan("ticks", TICK, 0, symbol, start, end)

    def candles(self, granularity: int, symbol: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """Candles of one granularity; reads the spans and files that can have them."""
        return self._scan("candles", CANDLE, granularity, symbol, start, end)

    def _scan(self, name: str, schema: T.StructType, granularity: int, symbol: str | None, start: int | None, end: int | None) -> DataFrame:
        self._ready()
        version, span = self.tables[name].current(), SPAN[name] * max(1, granularity)
        if not version.number:
            raise FileNotFoundError(self.path(name))
        low, high = None if start is None else start // span, None if end is None else end // span
        folders = []
        for part, held in version.parts.items():
            of, at = map(int, part.split("/"))
            if of == granularity and (low is None or at >= low) and (high is None or at <= high):
                folders += held
        rows = self.tables[name].read(schema, folders)
        for wanted in [F.col("symbol") == symbol] * (symbol is not None) + [F.col("epoch") >= start] * (start is not None) + [F.col("epoch") <= end] * (end is not None):
            rows = rows.where(wanted)
        return rows.orderBy("symbol", "epoch")

    def put_ticks(self, batch: DataFrame, order: str | None = None) -> int:
        """Upserts by (symbol, epoch); of equal keys the last one wins, by `order` in its own type or as the rows of the batch
        follow each other. Returns the number of rows in the batch."""
        return self._put("ticks", TICK, batch, order, 0)

    def put_candles(self, batch: DataFrame, granularity: int, order: str | None = None) -> int:
        """Upserts candles of one granularity by (symbol, epoch), as put_ticks() does."""
        if "granularity" in batch.columns and batch.where(F.col("granularity") != granularity).limit(1).count():
            raise ValueError("a batch of candles must have one granularity")
        return self._put("candles", CANDLE, batch, order, granularity)

    def _put(self, name: str, schema: T.StructType, batch: DataFrame, order: str | None, granularity: int) -> int:
        """Only the spans of the batch are read and written anew; the version that has them takes the place of the one before at once."""
        self._ready(write=True)
        span, table = SPAN[name] * max(1, granularity), self.tables[name]
        at = F.monotonically_increasing_id() if order is None else F.col(order)
        rows = checked(batch.withColumn("_at", at), schema, "_at").withColumn("_new", F.lit(1))
        rows = written(rows)
        count = rows.count()
        if not count:
            return 0
        version = table.current()
        part = F.floor(F.col("epoch") / span).cast("long")
        spans = sorted(r[0] for r in rows.select(part).distinct().collect())
        stored = table.read(schema, [f for s in spans for f in version.parts.get(f"{granularity}/{s}", [])])
        rows = stored.withColumns({"_at": F.lit(None).cast(rows.schema["_at"].dataType), "_new": F.lit(0)}).unionByName(rows)
        values = [c for c in schema.names if c not in ("symbol", "epoch")]
        merged = rows.groupBy("symbol", "epoch").agg(F.max_by(F.struct(*values), F.struct("_new", "_at")).alias("v")).select("symbol", "epoch", "v.*").withColumn("span", part)
        folder = table.write(merged.repartitionByRange("span", "symbol", "epoch").sortWithinPartitions("span", "symbol", "epoch"), "span")
        table.commit(version, version.parts | {f"{granularity}/{s}": [f"{folder}/span={s}"] for s in spans})
        return count

    def gaps(self, granularity: int, start: int, end: int) -> DataFrame:
        """Epochs of the grid from start to before end that no candle of a symbol has."""
        return quality.gaps(self.candles(granularity, None, start, end - 1), granularity, start, end)

    def export(self, name: str, path: str, granularity: int | None = None) -> None:
        """Writes all ticks or the candles of a granularity as Zstandard Parquet; other names are refused."""
        if name not in ("ticks", "candles") or (name == "candles") != (granularity is not None):
            raise ValueError(f"no table to export: {name}")
        rows = self.ticks() if name == "ticks" else self.candles(granularity)
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
