"""The ledger of calls as a stored table: calls that wait, and calls that are decided, in one version after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.operators import ledger
from quaver.session import written
from quaver.sources.versions import Versions

CALL = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("symbol", T.StringType()), ("epoch", T.LongType()), ("strategy", T.StringType()), ("direction", T.IntegerType()), ("recorded", T.LongType()))])
DECIDED = T.StructType([*CALL, T.StructField("entry", T.DoubleType()), T.StructField("exit", T.DoubleType()), T.StructField("outcome", T.StringType())])


class LedgerStore:
    """Calls under a folder. A folder that isn't there is an empty ledger, an unreadable manifest an error. A write is seen whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.table = Versions(spark, root)

    def pending(self) -> DataFrame:
        return self.table.read(CALL, self.table.current().parts.get("pending", []))

    def decided(self) -> DataFrame:
        return self.table.read(DECIDED, self.table.current().parts.get("decided", []))

    def record(self, features: DataFrame, step: int, now: int) -> int:
        """Adds the calls of screen rows whose entry candle hasn't opened by `now` and which aren't in the ledger; returns how many."""
        version = self.table.current()
        known = self.pending().select("id").unionByName(self.decided().select("id"))
        new = written(ledger.recorded(features, known, step, now).select(*CALL.names))
        count = new.count()
        if count:
            held = version.parts.get("pending", []) + [self.table.write(new)]
            self.table.commit(version, version.parts | {"pending": held}, {"first_recorded": version.notes.get("first_recorded", now)})
        return count

    def score(self, candles: DataFrame, step: int, now: int, horizon: int = ledger.HORIZON) -> int:
        """Decides the calls whose last candle has closed by `now`, or which have waited too long; returns how many."""
        version = self.table.current()
        rows = written(ledger.scored(self.pending(), candles, step, horizon, now))
        done = rows.where("outcome <> 'pending'")
        count = done.count()
        if count:
            left = self.table.write(rows.where("outcome = 'pending'").select(*CALL.names))
            add = self.table.write(done.select(*DECIDED.names))
            self.table.commit(version, {"pending": [left], "decided": version.parts.get("decided", []) + [add]}, version.notes | {"last_updated": now})
        return count

    def rows(self) -> DataFrame:
        """All calls with their outcome; those that wait are pending."""
        waiting = self.pending().withColumns({"entry": F.lit(None).cast("double"), "exit": F.lit(None).cast("double"), "outcome": F.lit("pending")})
        return self.decided().unionByName(waiting)

    def summary(self) -> DataFrame:
        return ledger.summary(self.rows())
