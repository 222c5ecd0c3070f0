"""Exact top-k inner products by a bit-sliced index of quantised attributes.

Components are quantised to integers and shifted by a constant to be non-negative. The index cuts the vectors into
blocks; a block holds, for each component and bit, a bitmap over its rows (bit slices, packed 64 rows to a word).

A query adds slices by bitmap arithmetic: its score is a sum over components and bits, so the score's own slices come
from carry-save adders over the bitmaps of the set bits of the query's weights (binary multiplication of slices), once
for the positive and once for the negative weights, and a subtraction of slices. The top rows of a block are then selected from the most significant score slice downward: while more than k candidates
remain, those with a set bit are kept if they are enough; the boundary is resolved exactly by score, then vec_id.

Queries go to all tasks in batches of at most MAX_QUERIES; every block answers a batch with its top k of each query,
and Spark's aggregate joins these, k rows a query and task. So nothing is shuffled but candidates.

Vectors that are null or empty, or that hold null or non-finite components, take no part. Vectors of different lengths
have no inner product: a query is answered from those of its own length. Every query row is answered on its own, so a
query that occurs twice gives its answer twice; rows with the query's vec_id are never found by it, and other rows that
share a vec_id are each a candidate. Only vec_id and embedding are read; other columns can't clash. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import durable

SCALE = 256
#: Rows in a block of the index, and queries handed to the tasks at once.
BLOCK_ROWS, MAX_QUERIES = 8192, 20_000


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and q, the integers floor(SCALE * x); only complete, finite vectors."""
    q = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * SCALE))
    whole = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return whole.where(~bad & (F.size("embedding") > 0)).select("vec_id", q.alias("q"))


class Slices:
    """A block of the index: slice[component][bit] is a bitmap over rows, packed into 64-bit words."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, shift: int, bits: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.n = ids[order], len(ids)
        self.words = -(-self.n // 64)
        up = (q[order] + shift).T  # component, row
        padded = np.zeros((len(up), self.words * 64), np.int64)
        padded[:, : self.n] = up
        self.bits = bits
        self.slice = np.stack([np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for b in range(bits)], 1)
        self.zero = np.zeros((1, self.words), np.uint64)
        self.all = np.packbits(np.arange(self.words * 64) < self.n, bitorder="little").view(np.uint64)

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the sum over components of weight * value, weights non-negative."""
        waiting: dict[int, list[np.ndarray]] = {}
        for bit in range(int(weights.max(initial=0)).bit_length()):
            on = self.slice[weights >> bit & 1 == 1]
            for b in range(self.bits):
                waiting.setdefault(bit + b, []).append(on[:, b])
        out, level = [], 0
        while waiting:
            layer = np.concatenate(waiting.pop(level, [self.zero]))
            carry = []
            while len(layer) > 2:  # carry-save adders, on all triples at once
                m = len(layer) // 3
                x, y, z = layer[:m], layer[m : 2 * m], layer[2 * m : 3 * m]
                half = x ^ y
                carry.append((x & y) | (half & z))
                layer = np.concatenate([half ^ z, layer[3 * m :]])
            if len(layer) == 2:
                carry.append(layer[:1] & layer[1:])
                layer = layer[:1] ^ layer[1:]
            out.append(layer[0] if len(layer) else self.zero[0])
            level += 1
            if carry:
                waiting.setdefault(level, []).extend(carry)
        return out

    def top(self, query: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(vec_ids, values) of the block's best k for the query; a value is the inner product with the shifted rows."""
        alive = self.all.copy()
        own = np.arange(*np.searchsorted(self.ids, [query, query + 1]))
        np.bitwise_and.at(alive, own // 64, ~(np.uint64(1) << (own % 64).astype(np.uint64)))
        value, sure = subtract(self.sums(np.maximum(q, 0)), self.sums(np.maximum(-q, 0)), self.all), np.zeros_like(alive)
        count = 0
        for s in reversed(value):
            hit = alive & s
            c = int(np.bitwise_count(hit).sum())
            if count + c >= k:
                alive = hit
            else:
                sure |= hit
                count += c
                alive &= ~s
        left = np.flatnonzero(np.unpackbits((sure | alive).view(np.uint8), bitorder="little"))
        total = np.full(len(left), -1 << (len(value) - 1), np.int64)
        for b, s in enumerate(value):
            total += (s[left // 64] >> (left % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64) << b
        order = np.lexsort((self.ids[left], -total))[:k]
        return self.ids[left[order]], total[order]


def subtract(a: list[np.ndarray], b: list[np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
    """Slices of a - b + 2**m, m the number of slices: positive for all rows, as |a - b| < 2**m."""
    m = max(len(a), len(b))
    zero = np.zeros_like(rows)
    a, b = a + [zero] * (m - len(a)), b + [zero] * (m - len(b))
    carry, out = rows.copy(), []
    for x, y in zip(a, b, strict=True):
        y = ~y & rows
        out.append(x ^ y ^ carry)
        carry = (x & y) | (carry & (x ^ y))
    return [*out, carry]


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query row, ties to the smaller vec_id."""
    spark = vectors.sparkSession
    rows = durable(quantised(vectors).withColumn("row", F.monotonically_increasing_id()))
    low, high = rows.agg(F.min(F.array_min("q")), F.max(F.array_max("q"))).first()
    queries = rows.where(is_query)
    many = -(-queries.count() // MAX_QUERIES)
    if not many:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shift, bits = max(0, -low), max(1, int(high + max(0, -low)).bit_length())
    found = None
    for part in range(many):
        some = queries.where(F.pmod(F.xxhash64("row"), F.lit(many)) == part).select("row", "vec_id", "q").toArrow()
        answer = ask(rows, some, shift, bits, k)
        best = answer.groupBy("query_row").agg(F.first("query_id").alias("query_id"), F.slice(F.sort_array(F.collect_list(F.struct(F.negative("score").alias("less"), "vec_id"))), 1, k).alias("best"))
        best = durable(best) if many > 1 else best
        found = best if found is None else found.unionByName(best)
    return found.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", F.negative("x.less").alias("score"))


def by_length(q: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(places of the vectors, their components [vector, component]) by their number of components."""
    q = q.combine_chunks() if isinstance(q, pa.ChunkedArray) else q
    size = np.asarray(pc.list_value_length(q))
    return {n: (at := np.flatnonzero(size == n), np.asarray(q.take(pa.array(at)).flatten()).reshape(len(at), n)) for n in np.unique(size).tolist()}


def ask(rows: DataFrame, queries: pa.Table, shift: int, bits: int, k: int) -> DataFrame:
    """query_row, query_id, vec_id, score: every task's best k for each query row."""
    names, numbers = (queries.column(c).to_numpy() for c in ("vec_id", "row"))
    shared = rows.sparkSession.sparkContext.broadcast((names, numbers, by_length(queries.column("q"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, numbers, asked = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2] * len(names)

        def block(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held)
            ids = t.column("vec_id").to_numpy()
            for n, (at, x) in by_length(t.column("q")).items():
                if n not in asked:
                    continue
                index = Slices(ids[at], x, shift, bits)
                for i, w in zip(*asked[n], strict=True):
                    v, s = index.top(int(names[i]), w, k)
                    v, s = np.concatenate([best[i][0], v]), np.concatenate([best[i][1], s - shift * w.sum()])
                    order = np.lexsort((v, -s))[:k]
                    best[i] = v[order], s[order]

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BLOCK_ROWS:
                block(held)
                held = []
        if sum(x.num_rows for x in held):
            block(held)
        size = [len(v) for v, _ in best]
        columns = [np.repeat(numbers, size), np.repeat(names, size), *(np.concatenate([b[j] for b in best]).astype(np.int64) for j in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_row", "query_id", "vec_id", "score"])

    return rows.select("vec_id", "q").mapInArrow(run, "query_row long, query_id long, vec_id long, score long")
