"""Mixture-controlled packing of documents into fixed windows.

Every source has a queue of its documents' token ids. Windows of `window` ids are filled by deficit round-robin: a
source earns credit in proportion to its target weight, spends it token by token, and carries what is left (its
deficit, always under one token) to the next window. As each source's credit after w windows has a closed form, any
task can tell which window a token falls into: nothing is passed from window to window, and deficits carry across
partitions as well. A source that runs dry leaves its share to the others. All windows are full; what remains at the
end is cut into sequences of power-of-two lengths, so nothing is padded.

Steps: encode every text once into a checkpointed table with running totals per task and source; add up the totals of
earlier tasks; cut every document at the windows it crosses.

Null and empty texts consist of the end id alone. A null source is a source of its own. Repeated rows are packed once
each. Only doc_id, text and source are read, so other columns can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaver.llm.common import durable, ragged, slices, small_batches
from quaver.llm.token_counts import Coder, merges

#: Sources that a schedule can hold, 24 bytes each in every task; more are refused, not merged.
MAX_SOURCES = 1_000_000
#: Numbers (rows times sources) that are worked out at once.
MAX_CELLS = 1 << 21
#: (task, source) totals up to this number are broadcast, beyond it they are joined by a shuffle.
MAX_BROADCAST_ROWS = 200_000


def encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, mix, part, before, n, ids (little-endian unsigned, as wide as the vocabulary needs) of every document.

    `part` is the task; `before` counts the ids of the same source earlier in that task.
    """
    kind = id_kind(path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(merges(path))
        part, totals = TaskContext.get().partitionId(), {}
        for b in slices(batches, "text"):
            ids, bounds = coder.encode(b.column("text").to_pylist())
            ids, end = ids.astype(kind), np.array([end_id], kind).tobytes()
            rows, before = [], []
            counts = np.diff(bounds) + 1
            for i, (mix, n) in enumerate(zip(b.column("mix").to_pylist(), counts.tolist(), strict=True)):
                rows.append(ids[bounds[i] : bounds[i + 1]].tobytes() + end)
                before.append(totals.get(mix, 0))
                totals[mix] = before[-1] + n
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("mix"), pa.array([part] * len(rows), pa.int32()), pa.array(before, pa.int64()), pa.array(counts), pa.array(rows, pa.binary())],
                ["doc_id", "mix", "part", "before", "n", "ids"],
            )

    return docs.mapInArrow(run, "doc_id long, mix string, part int, before long, n long, ids binary")


def id_kind(path: str, end_id: int) -> str:
    """The narrowest type that holds every id."""
    return "<u2" if max(merges(path).width, end_id + 1) <= 1 << 16 else "<u4"


class Schedule:
    """How many ids of each source lie before each window."""

    def __init__(self, totals: list[int], weights: list[float], window: int):
        self.totals, self.weights, self.window = np.array(totals, np.int64), np.array(weights, float), window
        self.total = int(self.totals.sum())
        self.full = self.total // window
        rest, self.tail = self.total % window, [0]
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                self.tail.append(self.tail[-1] + (1 << bit))

    def _earned(self, credit: np.ndarray) -> np.ndarray:
        return np.minimum(self.totals, np.floor(credit[:, None] * self.weights + 0.5).astype(np.int64))

    def _blocks(self, n: int) -> list[slice]:
        """Parts of n rows that need about MAX_CELLS numbers each."""
        rows = max(1, MAX_CELLS // max(1, len(self.totals)))
        return [slice(at, at + rows) for at in range(0, n, rows)]

    def served(self, w: np.ndarray) -> np.ndarray:
        """Row i: ids of each source in windows before w[i]; they add up to w[i] windows."""
        goal = np.minimum(w.astype(np.int64) * self.window, self.total)
        low, high = np.zeros(len(w)), np.full(len(w), (self.totals / self.weights).max(initial=0) + 1)
        for _ in range(80):
            mid = (low + high) / 2
            enough = self._earned(mid).sum(1) >= goal
            low, high = np.where(enough, low, mid), np.where(enough, mid, high)
        base, top = self._earned(low), self._earned(high)
        base[goal == 0], top[goal == 0] = 0, 0
        more, spare = (goal - base.sum(1))[:, None], top - base
        return base + np.clip(more - (np.cumsum(spare, 1) - spare), 0, spare)

    def window_of(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The window of id number x[i] of source s[i]."""
        credit = (x + 0.5) / self.weights[s]
        w = np.clip(self._earned(credit).sum(1) // self.window, 0, self.total // self.window)
        every = np.arange(len(x))
        while len(every):
            at = s[every]
            early = x[every] < self.served(w[every])[np.arange(len(every)), at]
            late = x[every] >= self.served(w[every] + 1)[np.arange(len(every)), at]
            w[every] += late.astype(np.int64) - early
            every = every[early | late]
        return w

    def bounds(self, w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of source s[i] before window w[i], before the window after it, ids of earlier sources in the window)."""
        order = np.argsort(w, kind="stable")
        out = np.empty((3, len(w)), np.int64)
        for part in self._blocks(len(w)):
            at = order[part]
            some, back = np.unique(w[at], return_inverse=True)
            now, then = self.served(some), self.served(some + 1)
            lead = np.cumsum(then - now, 1) - (then - now)
            for k, a in enumerate((now, then, lead)):
                out[k, at] = a[back, s[at]]
        return out[0], out[1], out[2]

    def pieces(self, s: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, start, length, sequence, offset) of what documents of n ids, from x on in the queue of s, are cut into."""
        low, high = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for part in self._blocks(len(x)):
            low[part], high[part] = self.window_of(x[part], s[part]), self.window_of((x + n - 1)[part], s[part])
        doc = np.repeat(np.arange(len(x)), high - low + 1)
        w = ragged(low, high - low + 1)
        now, then, lead = self.bounds(w, s[doc])
        begin, end = np.maximum(x[doc], now), np.minimum((x + n)[doc], then)
        offset = lead + begin - now
        start, length = begin - x[doc], end - begin
        last = np.flatnonzero((w == self.full) & (length > 0))
        keep = (w < self.full) & (length > 0)
        out = [[a[keep]] for a in (doc, start, length, w, offset)]
        for k, (a, b) in enumerate(zip(self.tail, self.tail[1:], strict=False)):
            lo, hi = np.maximum(offset[last], a), np.minimum(offset[last] + length[last], b)
            cut = last[hi > lo]
            lo, hi = lo[hi > lo], hi[hi > lo]
            for column, part in zip(out, (doc[cut], start[cut] + lo - offset[cut], hi - lo, np.full(len(cut), self.full + k), lo - a), strict=True):
                column.append(part)
        return tuple(np.concatenate(c) for c in out)


def pack(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2, targets: dict[str, float] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids.

    targets: weight of each source in a window; a source it lacks weighs as many as it has ids, so without targets the
    windows are mixed as the corpus is. A null source is named "". ids are little-endian unsigned 32-bit.
    """
    small_batches(docs.sparkSession)
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), source.alias("mix"))
    kind = id_kind(path, end_id)
    coded = durable(encode(rows, path, end_id))

    by_task = durable(coded.groupBy("mix", "part").agg(F.sum("n").alias("m")))
    by_source = by_task.groupBy("mix").agg(F.sum("m").alias("m")).limit(MAX_SOURCES + 1).collect()
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"a schedule holds a number for each source; over {MAX_SOURCES} sources are no mixture")
    totals = {r.mix: r.m for r in by_source}
    names = sorted(totals)
    sure = {m: i for i, m in enumerate(names)}
    weights = [float((targets or {}).get(m, totals[m])) or 1e-9 for m in names]
    scale = sum(weights) or 1.0
    plan = Schedule([totals[m] for m in names], [x / scale for x in weights], window)

    earlier = Window.partitionBy("mix").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("mix", "part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"))
    if by_task.count() <= MAX_BROADCAST_ROWS:
        base = F.broadcast(base)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = np.array([sure[m] for m in b.column("mix").to_pylist()])
            n = b.column("n").to_numpy()
            doc, start, length, seq, offset = plan.pieces(s, b.column("x").to_numpy(), n)
            raw = b.column("ids").to_pylist()
            ids = [np.frombuffer(raw[d], kind)[a : a + m].astype("<u4").tobytes() for d, a, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), *map(pa.array, (start, length)), pa.array([zlib.crc32(x) for x in ids], pa.int64()), b.column("n").take(take), *map(pa.array, (seq, offset)), b.column("mix").take(take), pa.array(ids, pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"],
            )

    at = coded.join(base, ["mix", "part"]).select("doc_id", "mix", (F.col("base") + F.col("before")).alias("x"), "n", "ids")
    return at.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary")
