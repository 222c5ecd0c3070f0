"""Circular shifts of one series against another, for series of any length, and offsets drawn without replacement.

Entry k of the shift sums is the sum of value over the places of `on`, each k further, around the end. A series that fits
into a task is one Fourier transform there. A longer one is transformed in four steps over tiles of at most TILE
numbers: the series is laid out as a matrix by columns, columns are transformed and twisted, tiles are dealt anew by rows,
rows are transformed, multiplied and transformed back, and tiles go back to columns. value is laid out twice in a row and
`on` once, padded with zeros, so that what comes back for the first n entries is the circular sum. The rows of a series
are shuffled three times whatever its length, and no task holds more than a tile.

Offsets without replacement are the first places of a permutation of all offsets, a Feistel network over their numbers; any
task can tell whether an offset is among them from the offset alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a series that is transformed inside one task; numbers of a tile.
IN_TASK, TILE = 1 << 20, 1 << 20
ROUNDS = 4
_U = np.uint64
#: A sum counts as at least as large as another within this.
SLACK = 1e-6


def shift_sums(on: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Entry k: the sum of value over the places of `on`, each k further, around the end."""
    return np.fft.irfft(np.conj(np.fft.rfft(on.astype(float))) * np.fft.rfft(value), len(value)) if len(value) else np.zeros(0)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Permutation:
    """A permutation of 0 to n - 1 that a key picks; numbers beyond n are walked on until they fall below."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, _U(max(1, ((n - 1).bit_length() + 1) // 2))
        self.low = _U((1 << int(self.half)) - 1)
        self.keys = _mix(np.array([key & ((1 << 64) - 1)], _U) + np.arange(1, ROUNDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.low
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & self.low)
        return right << self.half | left  # halves change places, so that keys in reverse undo it

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self._once(x.astype(_U), keys)
            while (far := np.flatnonzero(out >= _U(self.n))).size:
                out[far] = self._once(out[far], keys)
        return out.astype(np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys)

    def place(self, y: np.ndarray) -> np.ndarray:
        """The x of each y."""
        return self._walk(y, self.keys[::-1])


def shape(n: int, tile: int) -> tuple[int, int, int, int]:
    """(rows and columns of the matrix, columns of a tile of columns, rows of a tile of rows) for a series of n."""
    bits = (2 * n - 1).bit_length()
    wide = 1 << bits // 2
    high = 1 << bits - bits // 2
    return high, wide, max(1, min(wide, tile // high)), max(1, min(high, tile // wide))


def twist(rows: np.ndarray, columns: np.ndarray, total: int, sign: int) -> np.ndarray:
    return np.exp(sign * 2j * np.pi * ((rows[:, None] * columns[None, :]) % total) / total)


def _names(keys: list[str]) -> str:
    return ", ".join(f"k{i} string" for i in range(len(keys)))


def tiled(series: DataFrame, finish: Callable[[int, float, int, np.ndarray, np.ndarray], dict], columns: str) -> DataFrame:
    """(key, columns): what finish(n, own, seed, offsets, sums) says of parts of the offsets of each series.

    series: (key, n, own, seed, at, on, value), at from 0 to n - 1; own is the sum without a shift."""
    kind = "key string, n long, own double, seed long, tile long, other long, block binary"
    head = ("key", "n", "own", "seed")
    most = TILE

    def block_rows(t: pa.Table, tile: int, blocks: list[tuple[int, bytes]]) -> pa.Table:
        same = {c: [t.column(c)[0].as_py()] * len(blocks) for c in head}
        return pa.table({**same, "tile": [k for k, _ in blocks], "other": [tile] * len(blocks), "block": [b for _, b in blocks]}, pa.schema([("key", pa.string()), ("n", pa.int64()), ("own", pa.float64()), ("seed", pa.int64()), ("tile", pa.int64()), ("other", pa.int64()), ("block", pa.binary())]))

    def columns_in(t: pa.Table) -> pa.Table:
        high, wide, across, down = shape(t.column("n")[0].as_py(), most)
        tile, at = t.column("tile")[0].as_py(), t.column("at").to_numpy()
        x = np.zeros((2, high, across))
        for k, c in enumerate(("on", "value")):
            x[k, at // wide, at % wide - tile * across] = t.column(c).to_numpy()
        y = np.fft.fft(x, axis=1) * twist(np.arange(high), tile * across + np.arange(across), high * wide, -1)
        return block_rows(t, tile, [(k, np.ascontiguousarray(y[:, k * down : (k + 1) * down]).tobytes()) for k in range(high // down)])

    def rows(t: pa.Table) -> pa.Table:
        high, wide, across, down = shape(t.column("n")[0].as_py(), most)
        tile = t.column("tile")[0].as_py()
        y = np.empty((2, down, wide), complex)
        for other, b in zip(t.column("other").to_pylist(), t.column("block").to_pylist(), strict=True):
            y[:, :, other * across : (other + 1) * across] = np.frombuffer(b, complex).reshape(2, down, across)
        y = np.fft.fft(y, axis=2)
        z = np.fft.ifft(np.conj(y[0]) * y[1], axis=1) * twist(tile * down + np.arange(down), np.arange(wide), high * wide, 1)
        return block_rows(t, tile, [(k, np.ascontiguousarray(z[:, k * across : (k + 1) * across]).tobytes()) for k in range(wide // across)])

    def columns_out(t: pa.Table) -> pa.Table:
        n = t.column("n")[0].as_py()
        high, wide, across, down = shape(n, most)
        z = np.empty((high, across), complex)
        for other, b in zip(t.column("other").to_pylist(), t.column("block").to_pylist(), strict=True):
            z[other * down : (other + 1) * down] = np.frombuffer(b, complex).reshape(down, across)
        sums = np.fft.ifft(z, axis=0).real.ravel()
        offsets = (np.arange(high)[:, None] * wide + t.column("tile")[0].as_py() * across + np.arange(across)).ravel()
        ok = offsets < n
        found = finish(n, t.column("own")[0].as_py(), t.column("seed")[0].as_py(), offsets[ok], sums[ok])
        many = len(next(iter(found.values())))
        return pa.table({"key": pa.array([t.column("key")[0].as_py()] * many, pa.string()), **{k: pa.array(v) for k, v in found.items()}})

    wide = F.expr("shiftleft(1L, CAST(length(bin(2 * n - 1)) DIV 2 AS INT))")
    high = F.expr("shiftleft(1L, CAST(length(bin(2 * n - 1)) - length(bin(2 * n - 1)) DIV 2 AS INT))")
    across = F.greatest(F.lit(1), F.least(wide, F.floor(F.lit(most) / high)))
    twice = F.explode(F.array(F.struct(F.col("at").alias("at"), F.col("on").alias("on")), F.struct((F.col("at") + F.col("n")).alias("at"), F.lit(0.0).alias("on"))))
    laid = series.withColumn("x", twice).select(*head, F.col("x.at").alias("at"), F.col("x.on").alias("on"), F.col("value").cast("double").alias("value"))
    laid = laid.withColumn("tile", F.floor(F.col("at") % wide / across).cast("long"))
    blocks = laid.groupBy("key", "tile").applyInArrow(columns_in, kind)
    blocks = blocks.groupBy("key", "tile").applyInArrow(rows, kind)
    return blocks.groupBy("key", "tile").applyInArrow(columns_out, f"key string, {columns}")


def as_far(sums: np.ndarray, own: float, two_sided: bool, slack: float) -> np.ndarray:
    return np.abs(sums) >= abs(own) - slack if two_sided else sums >= own - slack


def drawn(n: int, shifts: int, seed: int) -> np.ndarray:
    """`shifts` offsets from 1 to n - 1: different ones if there are so many."""
    if shifts <= n - 1:
        return 1 + Permutation(n - 1, seed).of(np.arange(shifts))
    return np.random.default_rng(seed).integers(1, n, shifts)


def turn_p(rows: DataFrame, keys: list[str], order: str, span: int, on: str, value: str, shifts: int | None = None, seed: int = 0, two_sided: bool = False, slack: float = SLACK) -> DataFrame:
    """(keys, p): how many turns of `on` along each series, in `order`, have a sum of value as large as that without one.

    All turns count, or `shifts` of them that are drawn without replacement from the series' own seed, and the series as it is.
    p is 1 where `on` is 0 everywhere, or a series has one row. Orders are different; `span` is that of a part of them that a
    task numbers. rows are read more than once: write them before."""
    from quaver.operators.quality import numbered_by

    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    own_seed = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: i.cast("long") * F.ascii(F.substring(text, i, F.lit(1)))), F.lit(0).cast("long"), lambda a, v: a + v) + seed
    rows = rows.select(*keys, F.col(order).alias("_order"), F.col(on).cast("double").alias("on"), F.col(value).cast("double").alias("value"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(F.col("on") != 0, 1)).alias("marks"), F.sum(F.col("on") * F.col("value")).alias("own")).withColumn("key", text).withColumn("seed", own_seed)
    plain = sizes.where((F.col("n") < 2) | (F.col("marks") == 0)).select(*keys, F.lit(1.0).alias("p"))
    rest = sizes.where((F.col("n") >= 2) & (F.col("marks") > 0))
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)

    def in_task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_order", ignore_index=True)
        sums = shift_sums(pdf["on"].to_numpy(), pdf["value"].to_numpy())
        n, own = len(pdf), float((pdf["on"] * pdf["value"]).sum())
        turns = np.arange(1, n) if shifts is None else drawn(n, shifts, int(pdf["seed"].iloc[0]))
        return pd.DataFrame([[*pdf.loc[0, keys], float((1 + as_far(sums[turns], own, two_sided, slack).sum()) / (len(turns) + 1))]], columns=[*keys, "p"])

    small = rows.join(rest.where(F.col("n") <= IN_TASK).select(*keys, "seed"), keys)
    out = plain.unionByName(small.groupBy(*keys).applyInPandas(in_task, f"{kinds}, p double"))
    long = rest.where(F.col("n") > IN_TASK)
    if not long.limit(1).count():
        return out

    def hits(n: int, own: float, key: int, offsets: np.ndarray, sums: np.ndarray) -> dict:
        ok = offsets > 0
        if shifts is not None:
            ok &= np.where(ok, Permutation(n - 1, key).place(np.maximum(offsets - 1, 0)) < shifts, False)
        return {"hits": [int(as_far(sums[ok], own, two_sided, slack).sum())]}

    if shifts is not None and shifts > IN_TASK:
        raise ValueError(f"at most {IN_TASK} shifts are drawn")
    series = numbered_by(rows.join(long.select(*keys, "n", "own", "seed", "key"), keys), "_order", span, keys)
    found = tiled(series.select("key", "n", "own", "seed", "at", "on", "value"), hits, "hits long").groupBy("key").agg(F.sum("hits").alias("hits"))
    turns = F.col("n") - 1 if shifts is None else F.lit(shifts)
    return out.unionByName(long.join(found, "key").select(*keys, ((1 + F.col("hits")) / (turns + 1)).alias("p")))
