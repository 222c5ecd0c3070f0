"""The loss breaker over a stream of settled trades: state by symbol, kept by Spark; and how many late rows a stream dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState

DAY = 86_400
OUT = "symbol string, exit_epoch long, taken boolean, daily_net double, losses int"


def watched(trades: DataFrame, limit: float, streak: int) -> DataFrame:
    """(symbol, exit_epoch, taken, daily_net, losses) of every trade of (symbol, exit_epoch, net): trades while the breaker is halted
    are skipped. The day's result begins anew at each UTC day, losses in a row go on. A symbol's state is four numbers."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, total, losses, last = state.get if state.exists else (-1, 0.0, 0, -1)
        rows = pd.concat(list(parts)).sort_values("exit_epoch")
        out = []
        for epoch, net in zip(rows["exit_epoch"].tolist(), rows["net"].tolist(), strict=True):
            if epoch < last:
                out.append((key[0], epoch, False, total, losses))  # out of order: not a trade of the present
                continue
            day, total = (day, total) if epoch // DAY == day else (epoch // DAY, 0.0)
            taken, last = total > -limit and losses < streak, epoch
            if taken:
                total, losses = total + net, losses + 1 if net < 0 else 0
            out.append((key[0], epoch, taken, total, losses))
        state.update((day, total, losses, last))
        yield pd.DataFrame(out, columns=["symbol", "exit_epoch", "taken", "daily_net", "losses"])

    return trades.groupBy("symbol").applyInPandasWithState(update, OUT, "day long, total double, losses int, last long", "append", "NoTimeout")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were dropped, over the batches the query still remembers."""
    return sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)
