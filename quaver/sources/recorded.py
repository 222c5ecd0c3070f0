"""Recorded answers and messages of a price service as Spark data sources.

`quaver_history` reads a folder of history pages. A page is the JSON text that answered a request for so many rows up to an
epoch, and is named after that epoch: symbol=S/END.json. A partition walks one symbol's pages backwards from its end: the
next request ends before the oldest row of the page before. It stops at the start, at an empty page, and at a page with
fewer rows than were asked for, unless the page is one of candles that the service has cut at CANDLE_LIMIT rows. With
`spans`, a symbol's time is dealt to so many partitions, each of which walks its own part. A row isn't after the end of its
page, so a partition hands on what the pages before that end can't hold, and keeps no more than a few pages. Pages that don't
go back, and malformed ones, are errors.

`quaver_live` reads a folder of subscription messages as a stream: files of one JSON object a line, NAME.jsonl, which are
never changed and whose names ascend. An offset is the last file read, so a query that restarts reads the same files again
for the same batch. `file` and `line` order the updates. A message of an error raises it, others of another kind are passed
over, malformed ones are errors.
"""

from __future__ import annotations

import io
import json
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quaver.sources.market import DAY

#: Rows that a request asks for at most, and candles that an answer has at most.
PAGE_ROWS, CANDLE_LIMIT = 5000, 1000
PRICES = ("open", "high", "low", "close")
#: Files of messages that a task reads.
FILES = 64


def _names(path: str, ending: str, folders: bool = False) -> list[str]:
    """The names in a folder that end so, without the ending."""
    system, root = fs.FileSystem.from_uri(path)
    found = system.get_file_info(fs.FileSelector(root))
    return sorted(x.base_name[: len(x.base_name) - len(ending)] for x in found if x.base_name.endswith(ending) and (x.type == fs.FileType.Directory) == folders)


def _text(path: str) -> str:
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at) as f:
        return f.read().decode()


def _lines(path: str) -> Iterator[str]:
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at) as f, io.TextIOWrapper(f, "utf-8") as text:
        for line in text:
            yield line.rstrip("\n")


class Walk(InputPartition):
    def __init__(self, symbol: str, start: int, end: int):
        self.symbol, self.start, self.end = symbol, start, end


def page_rows(text: str, kind: str) -> list[tuple]:
    """(epoch, value ...) of a page; ValueError if it isn't one of its kind."""
    try:
        answer = json.loads(text)
        if kind == "candles":
            return [(int(c["epoch"]), *(float(c[p]) for p in PRICES)) for c in answer["candles"]]
        times, prices = answer["history"]["times"], answer["history"]["prices"]
        return [(int(t), float(p)) for t, p in zip(times, prices, strict=True)]
    except (KeyError, TypeError, ValueError) as e:
        raise ValueError(f"malformed history page: {text[:80]}") from e


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"].rstrip("/"), options.get("kind", "ticks")
        self.end, self.count = int(options["end"]), int(options.get("count", PAGE_ROWS))
        self.start = int(options["start"]) if "start" in options else self.end - int(float(options["days"]) * DAY)
        self.granularity, self.spans = int(options.get("granularity", 0)), int(options.get("spans", 1))
        if self.kind not in ("ticks", "candles") or self.start > self.end or not 1 <= self.count <= PAGE_ROWS or self.spans < 1:
            raise ValueError("kind is ticks or candles, start isn't after end, count is at most 5000, spans are at least one")
        if self.kind == "candles" and self.granularity <= 0:
            raise ValueError("candles need a granularity above 0")

    def partitions(self) -> list[Walk]:
        cuts = [self.start + (self.end + 1 - self.start) * i // self.spans for i in range(self.spans + 1)]
        symbols = [n.removeprefix("symbol=") for n in _names(self.path, "", True) if n.startswith("symbol=")]
        return [Walk(s, a, b - 1) for s in symbols for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def read(self, partition: Walk) -> Iterator[tuple]:
        def row(r: tuple) -> tuple:
            return (partition.symbol, *r) if self.kind == "ticks" else (partition.symbol, *r, self.granularity)

        ends = sorted(int(n) for n in _names(f"{self.path}/symbol={partition.symbol}", ".json"))
        cursor, before = partition.end, None
        kept: dict[tuple, tuple] = {}
        while cursor >= partition.start and ends:
            k = min(bisect_left(ends, cursor), len(ends) - 1)
            page = page_rows(_text(f"{self.path}/symbol={partition.symbol}/{ends[k]}.json"), self.kind)
            if not page:
                break
            oldest = min(r[0] for r in page)
            if before is not None and oldest >= before:
                raise RuntimeError(f"history of {partition.symbol} doesn't go back beyond {oldest}")
            for r in page:
                if before is not None and r[0] > ends[k]:
                    raise RuntimeError(f"history of {partition.symbol} up to {ends[k]} holds {r[0]}")
                if partition.start <= r[0] <= partition.end:
                    kept[r if self.kind == "ticks" else r[:1]] = r
            if k:
                done = [x for x, r in kept.items() if r[0] > ends[k - 1]]
                yield from map(row, sorted(kept.pop(x) for x in done))
            cut = self.kind == "candles" and len(page) == CANDLE_LIMIT
            if oldest <= partition.start or (len(page) < self.count and not cut):
                break
            before, cursor = oldest, oldest - 1
        yield from map(row, sorted(kept.values()))


class History(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quaver_history"

    def schema(self) -> str:
        return "symbol string, epoch long, quote double" if self.options.get("kind", "ticks") == "ticks" else "symbol string, epoch long, open double, high double, low double, close double, granularity int"

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(dict(self.options))


class Lines(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


def updates(lines: Iterator[str], kind: str) -> Iterator[tuple[int, dict]]:
    """(number of the line, what it says) of the messages of a kind."""
    for number, line in enumerate(lines):
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except json.JSONDecodeError as e:
            raise ValueError(f"not JSON: {line[:80]}") from e
        if not isinstance(message, dict):
            raise ValueError(f"not a message: {line[:80]}")
        if isinstance(message.get("error"), dict):
            raise RuntimeError(f"{message['error'].get('code', 'UnknownError')}: {message['error'].get('message', '')}")
        if isinstance(message.get(kind), dict):
            yield number, message[kind]


class LiveReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"].rstrip("/"), options.get("kind", "tick")
        if self.kind not in ("tick", "ohlc"):
            raise ValueError("kind is tick or ohlc")

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        return {"file": max(_names(self.path, ".jsonl"), default="")}

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        names = [n for n in _names(self.path, ".jsonl") if start["file"] < n <= end["file"]]
        return [Lines(names[i : i + FILES]) for i in range(0, len(names), FILES)]

    def read(self, partition: Lines) -> Iterator[tuple]:
        for name in partition.names:
            for number, x in updates(_lines(f"{self.path}/{name}.jsonl"), self.kind):
                try:
                    if self.kind == "tick":
                        yield str(x["symbol"]), int(x["epoch"]), float(x["quote"]), None if x.get("id") is None else str(x["id"]), name, number
                    else:
                        yield str(x["symbol"]), int(x["open_time"]), *(float(x[p]) for p in PRICES), int(x["granularity"]), name, number
                except (KeyError, TypeError, ValueError) as e:
                    raise ValueError(f"malformed update: {x}") from e


class Live(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quaver_live"

    def schema(self) -> str:
        values = "quote double, tick_id string" if self.options.get("kind", "tick") == "tick" else "open double, high double, low double, close double, granularity int"
        return f"symbol string, epoch long, {values}, file string, line long"

    def streamReader(self, schema) -> LiveReader:
        return LiveReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(History)
    spark.dataSource.register(Live)


def read_history(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format(History.name()).options(path=path, **options).load()


def read_live(spark: SparkSession, path: str, kind: str = "tick") -> DataFrame:
    register(spark)
    return spark.readStream.format(Live.name()).options(path=path, kind=kind).load()


def pages(rows: DataFrame, kind: str, end: int, count: int) -> DataFrame:
    """(symbol, end, json): the answers to requests for `count` rows that walk back from `end`; rows of one epoch stay on one page.

    The last answer of a symbol is empty: a page of its first rows may be as long as was asked for, and is then not the last."""
    of = Window.partitionBy("symbol")
    page = F.floor((F.dense_rank().over(of.orderBy(F.desc("epoch"))) - 1) / count)
    rows = rows.where(F.col("epoch") <= end).withColumn("page", page)
    if kind == "ticks":
        held = F.struct(F.col("x.epoch").alias("times"), F.col("x.quote").alias("prices"))
        rows = rows.groupBy("symbol", "page").agg(F.sort_array(F.collect_list(F.struct("epoch", "quote"))).alias("x"), F.min("epoch").alias("oldest"))
        rows = rows.withColumn("json", F.to_json(F.struct(held.alias("history"))))
    else:
        rows = rows.groupBy("symbol", "page").agg(F.sort_array(F.collect_list(F.struct("epoch", *PRICES))).alias("candles"), F.min("epoch").alias("oldest"))
        rows = rows.withColumn("json", F.to_json(F.struct("candles")))
    newer = F.lag("oldest").over(of.orderBy("page")) - 1
    answer = F.struct(F.coalesce(newer, F.lit(end)).alias("end"), "json")
    empty = F.struct((F.col("oldest") - 1).alias("end"), F.lit('{"history":{"times":[],"prices":[]}}' if kind == "ticks" else '{"candles":[]}').alias("json"))
    last = F.lead("oldest").over(of.orderBy("page")).isNull()
    return rows.select("symbol", answer.alias("x"), last.alias("last"), empty.alias("none")).select("symbol", F.explode(F.when(F.col("last"), F.array("x", "none")).otherwise(F.array("x"))).alias("x")).select("symbol", "x.*")


def record(answers: DataFrame, path: str) -> int:
    """Writes (symbol, end, json) pages into a folder as tasks, each page whole; returns how many. The same page may be written again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        for b in batches:
            for r in b.to_pylist():
                folder = f"{root}/symbol={r['symbol']}"
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/_{r['end']}") as f:
                    f.write(r["json"].encode())
                system.move(f"{folder}/_{r['end']}", f"{folder}/{r['end']}.json")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    return answers.select("symbol", "end", "json").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def record_lines(messages: DataFrame, path: str) -> int:
    """Writes (file, line, json) messages into a folder as one file for each name, its lines in order; returns how many files.
    A task writes its sorted messages as they come and holds a batch of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        rows = ((name, text) for b in batches for name, text in zip(b.column("file").to_pylist(), b.column("json").to_pylist(), strict=True))
        n = 0
        for name, lines in groupby(rows, itemgetter(0)):
            with system.open_output_stream(f"{root}/_{name}") as f:
                f.writelines((b"\n" if i else b"") + text.encode() for i, (_, text) in enumerate(lines))
            system.move(f"{root}/_{name}", f"{root}/{name}.jsonl")
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    system, root = fs.FileSystem.from_uri(path)
    system.create_dir(root, recursive=True)  # also without messages: a stream may begin there before the first comes
    rows = messages.select("file", "line", "json").repartition("file").sortWithinPartitions("file", "line")
    return rows.select("file", "json").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
