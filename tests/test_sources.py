"""Recorded history and live messages, versions of stored tables, the ledger, and compaction beside a stream."""

import json
from collections import Counter

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from quaver.plans import queries
from quaver.sources import market, recorded
from quaver.sources.ledgers import LedgerStore
from quaver.sources.market import CANDLE
from quaver.sources.store import Store
from quaver.sources.versions import CorruptTable, Versions, WriteConflict
from quaver.streaming import candles as live


def candle_page(epochs):
    return json.dumps({"candles": [{"epoch": e, "open": "1", "high": "2", "low": "0.5", "close": str(e)} for e in epochs]})


def recording(path, symbol, pages):
    folder = path / f"symbol={symbol}"
    folder.mkdir(parents=True)
    for end, text in pages.items():
        (folder / f"{end}.json").write_text(text)
    return str(path)


def history(spark, path, **options):
    return recorded.read_history(spark, path, **options).orderBy("symbol", "epoch").collect()


def test_candles_go_on_after_a_page_of_exactly_the_limit(spark, tmp_path):
    step, end = 60, 600_000
    times = list(range(0, end + 1, step))
    first, second, third = times[-1000:], times[-2000:-1000], times[-2400:-2000]
    path = recording(tmp_path, "X", {end: candle_page(first), first[0] - 1: candle_page(second), second[0] - 1: candle_page(third), third[0] - 1: candle_page(times[:100])})
    got = history(spark, path, kind="candles", start=0, end=end, granularity=step)
    assert [r.epoch for r in got] == times[-2400:]  # a page of fewer than 1000 is the last one
    assert {r.granularity for r in got} == {step} and got[5].close == got[5].epoch
    some = history(spark, path, kind="candles", start=second[10], end=first[10], granularity=step)
    assert [r.epoch for r in some] == [t for t in times if second[10] <= t <= first[10]]
    assert [r.epoch for r in history(spark, path, kind="candles", start=second[0], end=end, granularity=step, spans=4)] == times[-2000:]


def test_ticks_stop_at_a_short_page_and_count_once(spark, tmp_path):
    page = lambda *x: json.dumps({"history": {"times": [t for t, _ in x], "prices": [p for _, p in x]}})
    path = recording(tmp_path, "A", {100: page((90, 1.0), (95, 2.0), (95, 2.0), (95, 3.0)), 89: page((70, 5.0), (80, 4.0)), 69: page((60, 9.0))})
    recording(tmp_path, "B", {100: page()})
    assert [(r.symbol, r.epoch, r.quote) for r in history(spark, path, start=0, end=100, count=5)] == [("A", 90, 1.0), ("A", 95, 2.0), ("A", 95, 3.0)]
    assert [r.epoch for r in history(spark, path, start=0, end=100, count=2)] == [60, 70, 80, 90, 95, 95]
    assert [r.epoch for r in history(spark, path, start=75, end=100, count=2)] == [80, 90, 95, 95]
    assert [r.epoch for r in history(spark, path, days=30 / 86400, end=100, count=2)] == [70, 80, 90, 95, 95]


@pytest.mark.parametrize("text", ["[]", "{", '{"history": {"times": [1], "prices": []}}', '{"history": {"times": ["x"], "prices": [1]}}', '{"candles": []}'])
def test_malformed_history_is_refused(spark, tmp_path, text):
    with pytest.raises(PythonException, match="malformed"):
        history(spark, recording(tmp_path, "A", {100: text}), start=0, end=100)


def test_history_must_go_back(spark, tmp_path):
    path = recording(tmp_path, "A", {100: candle_page([60] * 1000), 50: candle_page([70] * 1000)})
    with pytest.raises(PythonException, match="go back"):
        history(spark, path, kind="candles", start=0, end=100, granularity=60)
    for wrong in ({"kind": "other"}, {"start": 101}, {"count": 5001}, {"kind": "candles"}):
        with pytest.raises(Exception, match="kind is|granularity"):
            history(spark, path, **{"start": 0, "end": 100, **wrong})


@pytest.mark.parametrize("kind", ["ticks", "candles"])
def test_a_walk_ends_though_its_last_page_is_full(spark, tmp_path, kind):
    ticks = spark.range(12).selectExpr("'X' symbol", "id div 3 * 10 epoch", "cast(id as double) quote")  # three of each epoch
    candles = spark.range(2 * recorded.CANDLE_LIMIT).selectExpr("'X' symbol", "id * 60 epoch", *[f"cast(id + 1 as double) {p}" for p in recorded.PRICES])
    rows, count = (ticks, 2) if kind == "ticks" else (candles, recorded.CANDLE_LIMIT)
    recorded.record(recorded.pages(rows, kind, 200_000, count), str(tmp_path))
    for spans in (1, 3):
        got = recorded.read_history(spark, str(tmp_path), kind=kind, start=-50_000, end=200_000, count=count, spans=spans, **({} if kind == "ticks" else {"granularity": 60}))
        assert sorted(map(tuple, got.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))


def test_a_walk_hands_on_page_by_page(tmp_path, monkeypatch):
    path = recording(tmp_path, "X", {60 * k + 60_000 - 1: candle_page(range(60 * k, 60 * k + 60_000, 60)) for k in range(0, 3000, 1000)})
    reader, read = recorded.HistoryReader({"path": path, "kind": "candles", "start": "0", "end": "200000", "granularity": "60"}), []
    monkeypatch.setattr(recorded, "_text", lambda p, text=recorded._text: read.append(p) or text(p))
    rows = reader.read(reader.partitions()[0])
    assert next(rows)[1] == 120_000 and len(read) == 1  # the two pages before aren't asked for yet
    assert [r[1] for r in rows] == [60 * k for k in (*range(2001, 3000), *range(1000, 2000), *range(1000))]


def say(folder, name, *messages):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in messages))


def tick(epoch, quote, **more):
    return {"tick": {"symbol": "X", "epoch": epoch, "quote": quote, **more}, "subscription": {"id": "s"}}


def test_a_restarted_stream_gives_each_tick_once(spark, tmp_path):
    folder, out = tmp_path / "m", str(tmp_path / "out")
    run = lambda: recorded.read_live(spark, str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
    say(folder, "001", tick(1, 1.5, id=7), {"msg_type": "ping"}, "", tick(2, 2.5))
    run()
    say(folder, "002", tick(3, 3.5))
    say(folder, "003", tick(4, 4.5), {"ohlc": {"symbol": "X"}})
    run()
    run()
    got = spark.read.parquet(out).orderBy("epoch").collect()
    assert [(r.epoch, r.quote, r.tick_id, r.file) for r in got] == [(1, 1.5, "7", "001"), (2, 2.5, None, "001"), (3, 3.5, None, "002"), (4, 4.5, None, "003")]


def test_messages_are_written_and_read_as_they_come(spark, tmp_path, monkeypatch):
    rows = spark.range(3000).selectExpr("lpad(id % 3, 3, '0') file", "3000 - id line", "to_json(named_struct('tick', named_struct('symbol', '\u2028X', 'epoch', id, 'quote', 1.5))) json")
    plain = type(rows).groupBy
    monkeypatch.setattr(type(rows), "groupBy", lambda self, *keys: pytest.fail("a file's messages are gathered into one row") if keys else plain(self))
    assert recorded.record_lines(rows, str(tmp_path / "m")) == 3
    held = [[json.loads(x)["tick"]["epoch"] for x in (tmp_path / f"m/{k:03d}.jsonl").read_text().split("\n")] for k in range(3)]
    assert held == [list(range(2997 + k, -1, -3)) for k in range(3)]
    monkeypatch.setattr(recorded, "_text", lambda _: pytest.fail("a file is read whole"))
    reader = recorded.LiveReader({"path": str(tmp_path / "m")})
    got = [r for part in reader.partitions({"file": "000"}, reader.latestOffset()) for r in reader.read(part)]
    assert [(r[0], r[1], r[4], r[5]) for r in got] == [("\u2028X", e, f"{k:03d}", i) for k in (1, 2) for i, e in enumerate(held[k])]


def test_live_ticks_begin_their_last_batch_anew(spark, monkeypatch):
    begun, plain = [], DataStreamWriter.foreachBatch
    monkeypatch.setattr(DataStreamWriter, "foreachBatch", lambda self, f: plain(self, lambda rows, n: (begun.append((n, rows.count())), f(rows, n))))
    got = queries.live_ticks(spark, "/root/testdata/sf0.001").collect()
    want = queries.rounded(market.ticks(spark, "/root/testdata/sf0.001").select("symbol", "epoch", "quote", "tick_id")).collect()
    first, last, again = begun
    assert (first[0], last[0]) == (0, 1) and again == last
    assert first[1] and last[1] and first[1] + last[1] == len(want)
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize(("line", "says"), [("{", "not JSON"), ("[1]", "not a message"), ({"tick": {"symbol": "X"}}, "malformed"), ({"error": {"code": "Busy", "message": "later"}}, "Busy: later")])
def test_bad_messages_end_the_stream(spark, tmp_path, line, says):
    say(tmp_path / "m", "1", line)
    query = recorded.read_live(spark, str(tmp_path / "m")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match=says):
        query.awaitTermination()


def ohlc(open_time, close, **more):
    return {"ohlc": {"symbol": "X", "open_time": open_time, "open": "1", "high": "9", "low": "0.5", "close": str(close), "granularity": 60, **more}}


def test_updates_of_a_candle_end_as_one_and_compaction_is_safe_beside_the_stream(spark, tmp_path):
    folder, out, check = tmp_path / "m", str(tmp_path / "out"), str(tmp_path / "c")
    run = lambda: live.write_latest(recorded.read_live(spark, str(folder), "ohlc"), out, check, ["file", "line"]).awaitTermination()
    table = live.LatestTable(spark, out)
    rows = lambda: sorted((r.epoch, r.close) for r in table.read().collect())
    with pytest.raises(FileNotFoundError):
        table.read()
    want = {}
    for k in range(4):
        say(folder, f"{k:03d}", *[ohlc(60 * (k + j), 10 * k + j) for j in (0, 1, 1)], ohlc(60 * (k + 1), 10 * k + 5))
        want |= {60 * k: 10.0 * k, 60 * (k + 1): 10.0 * k + 5}
        run()
        held = table.read()
        assert rows() == sorted(want.items())
        assert table.compact() == (1 if k else 0)
        assert rows() == sorted(want.items())
        assert len(held.collect()) == len(want)  # a reader from before is left with its files
    table.vacuum()
    assert rows() == sorted(want.items()) and table._batches(-1) == [3]


def test_versions(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([("X", 1, 1.0, 1.0, 1.0, 1.0)], CANDLE)
    empty = table.current()
    assert empty.number == 0 and table.read(CANDLE, []).count() == 0
    one = table.commit(empty, {"a": [table.write(rows)]})
    lost = table.write(rows.unionByName(rows))  # a write that dies before its version
    assert table.read(CANDLE, table.current().parts["a"]).count() == 1
    with pytest.raises(WriteConflict):
        table.commit(empty, {"a": [lost]})
    assert table.current() == one
    table.vacuum()
    assert not table.folder.exists(lost) and table.read(CANDLE, table.current().parts["a"]).count() == 1
    (tmp_path / "t/_versions/000000000002.json").write_text('{"parts": 3')
    with pytest.raises(CorruptTable):
        table.current()


def test_the_last_row_of_a_batch_wins(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    kind = "symbol string, epoch long, quote double, tick_id string, number long"
    store.put_ticks(spark.createDataFrame([("A", 0, 1.0, "9", 9), ("A", 0, 2.0, "10", 10), ("A", 0, 3.0, "8", 8)], kind), "number")
    assert [r.quote for r in store.ticks().collect()] == [2.0]
    store.put_ticks(spark.createDataFrame([("A", 0, 5.0, "z", 9), ("A", 0, 4.0, "a", 1)], kind))
    assert [r.quote for r in store.ticks().collect()] == [4.0]
    candle = lambda close: ("A", 60, 1.0, 2.0, 0.5, close)
    store.put_candles(spark.createDataFrame([candle(x) for x in (7.0, 6.0, 8.0)], CANDLE).coalesce(1), 60)
    assert [r.close for r in store.candles(60).collect()] == [8.0]
    assert store.put_candles(spark.createDataFrame([], CANDLE), 60) == 0 and store.tables["candles"].current().number == 1


def test_a_write_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    ticks = spark.createDataFrame([("A", 0, 1.0, "1"), ("A", 10_000_000, 1.0, "2")], "symbol string, epoch long, quote double, tick_id string")
    store.put_ticks(ticks)
    monkeypatch.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        store.put_ticks(ticks.withColumn("quote", F.lit(2.0)))
    monkeypatch.undo()
    assert [r.quote for r in store.ticks().collect()] == [1.0, 1.0]
    store.put_ticks(ticks.withColumn("quote", F.lit(3.0)).limit(1))
    assert [r.quote for r in store.ticks().collect()] == [3.0, 1.0]


def test_scans_read_only_the_spans_they_need(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    ticks = spark.range(40).select(F.lit("A").alias("symbol"), (F.col("id") * 86_400).alias("epoch"), F.lit(1.0).alias("quote"), F.lit(None).cast("string").alias("tick_id"))
    store.put_ticks(ticks)
    rows = store.ticks("A", 8 * 86_400, 9 * 86_400)
    assert rows.count() == 2 and len(rows.inputFiles()) == 1 and len(store.ticks().inputFiles()) >= 6


def features(spark, epochs):
    return spark.createDataFrame([("X", e, 2.0, 1.0, -1.5, 20.0) for e in epochs], "symbol string, epoch long, ema20 double, ema50 double, z double, rsi double")


def test_ledger_store(spark, tmp_path):
    path = str(tmp_path / "l")
    store = LedgerStore(spark, path)
    assert store.rows().count() == 0 and {r.verdict for r in store.summary().collect()} == {"control", "collecting data"}
    assert store.record(features(spark, [600, 660]), 60, 650) == 8 and store.record(features(spark, [600, 660]), 60, 650) == 0
    candles = spark.createDataFrame([("X", 600 + 60 * k, 10.0 + k, 20.0, 5.0, 10.5 + k) for k in range(20)], CANDLE)
    assert store.score(candles, 60, 959) == 0  # the last of five candles is open
    assert store.score(candles, 60, 960) == 4
    again = LedgerStore(spark, path)
    by = Counter((r.epoch, r.outcome) for r in again.rows().collect())
    assert by[660, "pending"] == 4 and by[600, "win"] + by[600, "loss"] == 4
    assert again.record(features(spark, [600]), 60, 100) == 0  # known, though decided
    assert again.table.current().notes == {"first_recorded": 650, "last_updated": 960}
    assert again.score(candles.limit(0), 60, 1000 + 3 * 86_400) == 4 and again.pending().count() == 0
    assert {r.outcome for r in again.decided().where("epoch = 660").collect()} == {"void"}
    (tmp_path / "l/_versions/000000000009.json").write_text("")
    with pytest.raises(CorruptTable):
        again.rows()


def test_a_call_that_waits_too_long_is_void(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "l"))
    far = 86_400 * 30
    store.record(features(spark, [far]), 86_400, 5)
    none = spark.createDataFrame([], CANDLE)
    assert store.score(none, 86_400, 5 + 3 * 86_400) == 0 and store.score(none, 86_400, 6 + 3 * 86_400) == 4
    assert {(r.outcome, r.entry) for r in store.rows().collect()} == {("void", None)}
