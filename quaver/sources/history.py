"""Pages of price history as JSON text, and text files of results: parsed by declared schemas, malformed input is an error."""

from __future__ import annotations

import json
import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TICK_PAGE = "struct<history: struct<times: array<long>, prices: array<double>>>"
CANDLE_PAGE = "struct<candles: array<struct<epoch: long, open: double, high: double, low: double, close: double>>>"
#: Fixed value: codes of volatility symbols.
SYMBOL_CODE = r"^(?:R_\d+|1HZ\d+V)$"


def _parsed(kind: str) -> Column:
    return F.from_json("json", kind, {"mode": "FAILFAST"})


def tick_pages(pages: DataFrame) -> DataFrame:
    """(symbol, page, epoch, quote) of (symbol, page, json) rows; pages without history, or of uneven times and prices, raise an error."""
    x = pages.select("symbol", "page", _parsed(TICK_PAGE).alias("x")).select("symbol", "page", "x.history.times", "x.history.prices")
    right = F.col("times").isNotNull() & F.col("prices").isNotNull() & (F.size("times") == F.size("prices"))
    zipped = F.when(right, F.arrays_zip("times", "prices")).otherwise(F.raise_error(F.lit("malformed history page")).cast("array<struct<times: long, prices: double>>"))
    return x.select("symbol", "page", F.explode(zipped).alias("v")).select("symbol", "page", F.col("v.times").alias("epoch"), F.col("v.prices").alias("quote"))


def candle_pages(pages: DataFrame) -> DataFrame:
    """(symbol, page, epoch, open, high, low, close) of (symbol, page, json) rows; pages without candles raise an error."""
    found = F.coalesce(F.col("x.candles"), F.raise_error(F.lit("malformed candle page")).cast("array<struct<epoch: long, open: double, high: double, low: double, close: double>>"))
    return pages.select("symbol", "page", _parsed(CANDLE_PAGE).alias("x")).select("symbol", "page", F.explode(found).alias("v")).select("symbol", "page", "v.*")


def merged_ticks(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Ticks of overlapping pages from start to end, each (symbol, epoch, quote) once."""
    return rows.where(F.col("epoch").between(start, end)).select("symbol", "epoch", "quote").distinct()


def merged_candles(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Candles of overlapping pages from start to end; of one epoch that of the last page stays."""
    values = ["open", "high", "low", "close"]
    return rows.where(F.col("epoch").between(start, end)).groupBy("symbol", "epoch").agg(F.max_by(F.struct(*values), "page").alias("v")).select("symbol", "epoch", "v.*")


def registry_diff(active: DataFrame, known: DataFrame, code: str = SYMBOL_CODE) -> DataFrame:
    """(symbol, state): available, missing from the market, or unregistered; of the market only symbols whose name has the code count."""
    active, known = active.where(F.col("symbol").rlike(code)).select("symbol").distinct(), known.select("symbol").distinct()
    parts = [known.join(active, "symbol", "left_anti"), active.join(known, "symbol", "left_anti"), active.join(known, "symbol", "left_semi")]
    missing, unknown, both = (p.select("symbol", F.lit(s).alias("state")) for p, s in zip(parts, ("missing", "unregistered", "available"), strict=True))
    return missing.unionByName(unknown).unionByName(both)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)


#: The labels of a report's numbers, a colon after each; those of PERCENT end in a per cent sign.
REPORT = {
    "report_date": "UTC report date", "alpha": "Alpha", "rows_per_family": "rows per p-value family", "bonferroni": "Bonferroni discoveries",
    "replications": "Seeded driftless GBM replications", "tests": "Tests per replication", "confirmed_null": "Confirmed null edges",
}
PERCENT = {"raw_significant": "Raw circular-shift p < alpha", "bh_surviving": "BH survivors / all null tests"}


def parse_reports(texts: DataFrame) -> DataFrame:
    """One row for each (name, text): the numbers of the report and the window that its symbols share, which is told from the lines
    of a table with a name and three whole numbers. A report that lacks any of them is an error."""
    lines = F.split("text", "\n")

    def after(label: str) -> Column:
        """What follows the label in the first line that has it."""
        line = F.get(F.filter(lines, lambda x: F.contains(x, F.lit(label + ":"))), 0)
        return F.trim(F.substring_index(line, label + ":", -1))

    cells = F.transform(F.filter(lines, lambda x: x.startswith("|")), lambda x: F.transform(F.split(F.btrim(F.btrim(x), F.lit("|")), "[|]"), lambda v: F.btrim(v)))
    table = F.filter(cells, lambda c: (F.size(c) == 4) & F.forall(F.slice(c, 2, 3), lambda v: v.rlike("^[0-9]+$")))
    column = lambda i: F.transform("_table", lambda c: c[i].cast("long"))
    rows = texts.select("name", *[after(v).alias(k) for k, v in REPORT.items()], *[F.when(after(v).endswith("%"), F.rtrim(after(v), F.lit("%"))).alias(k) for k, v in PERCENT.items()], table.alias("_table"))
    wanted = [F.col(k).try_cast("long") if k not in ("report_date", "alpha", *PERCENT) else F.col(k).try_cast("date" if k == "report_date" else "double") for k in (*REPORT, *PERCENT)]
    whole = F.size("_table") > 0
    for c in wanted:
        whole = whole & c.isNotNull()
    name = F.when(F.coalesce(whole, F.lit(False)), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("not a report: "), F.col("name"))).cast("string"))
    return rows.select(
        name.alias("name"), "report_date", F.col("alpha").cast("double"), *[F.col(k).cast("long") for k in list(REPORT)[2:]], *[(F.col(k).cast("double") / 100).alias(k) for k in PERCENT],
        F.size("_table").alias("symbols"), F.array_min(column(1)).alias("candles"), F.array_max(column(2)).alias("first_epoch"), F.array_min(column(3)).alias("last_epoch"),
    )


def write_snapshot(rows: DataFrame, path: str) -> int:
    """Writes the few rows of a snapshot (a row for each symbol) as one JSON file that is replaced at once; returns their number."""
    lines = [r.json for r in rows.select("json").collect()]
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write("[" + ",\n".join(lines) + "]")
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)
    return len(lines)


def read_snapshot(path: str) -> list[dict]:
    """The rows of a snapshot; a missing file raises FileNotFoundError, another content ValueError."""
    with open(path, encoding="utf-8") as f:
        try:
            rows = json.load(f)
        except json.JSONDecodeError as e:
            raise ValueError(f"not a snapshot: {path}") from e
    if not isinstance(rows, list) or any(not isinstance(r, dict) or not re.search(r"\S", str(r.get("symbol", ""))) for r in rows):
        raise ValueError(f"not a snapshot: {path}")
    return rows
