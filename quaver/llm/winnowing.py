"""Document fingerprints by winnowing, and the likeness of each document to an edited copy and to the next one.

A text's code points are hashed in grams of GRAM with a rolling polynomial. Of every WINDOW grams in a row the least hash
is selected, of equal ones the rightmost; the selected hashes, with their places, are the fingerprint. So any stretch
of GRAM + WINDOW - 1 code points that two texts share gives them a hash in common, and two texts of equal stretches never
differ in what is selected inside. A text with fewer grams than a window has one window; one shorter than a gram is one
gram; an empty text has an empty fingerprint. Likeness is the Jaccard coefficient of the sets of selected hashes, 1 for
two empty ones.

neighbours() puts every document beside the one before it in ascending doc_id in a single shuffle of the texts: ranges
of doc_id, whose bounds come from a sketch of quantiles, are dealt out, and the last document of each range is copied to
the next range. An id that many documents have is split over its ranges by the hash of the text. The driver holds one row
for each range, RANGES for each shuffle partition.

A null text counts as empty. A null doc_id comes after all others in descending order, as the least long. Rows of one
doc_id follow each other by the 64-bit hash of their texts; repeated rows are each other's next, and each is returned.
Only doc_id and text are read; other columns can't clash. An empty table gives an empty result; a single document is its
own next one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quaver.llm.common import ragged, slices, small_batches
from quaver.llm.words import mix

GRAM, WINDOW = 20, 45
#: Ranges of doc_id for each shuffle partition.
RANGES = 8
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_U = np.uint64
_NONE = np.uint64((1 << 64) - 1)


class Selected(NamedTuple):
    """What winnowing keeps of n texts: bounds[i]:bounds[i+1] are text i's hashes and places."""

    bounds: np.ndarray
    hashes: np.ndarray
    places: np.ndarray


def power(n: int) -> np.uint64:
    return _U(pow(int(BASE), n, 1 << 64))


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """The mixed polynomial hashes of all stretches of `gram` points, 63 bits wide; longer stretches are put together from halves."""
    with np.errstate(over="ignore"):
        step, size, out, length = mix(points.astype(np.uint64)), 1, None, 0
        while size <= gram:
            if gram & size:
                n = len(points) - length - size + 1
                out = step if out is None else out[:n] * power(size) + step[length : length + n]
                length += size
            if 2 * size <= gram:
                n = max(0, len(points) - 2 * size + 1)
                step = step[:n] * power(size) + step[size : size + n]
            size *= 2
        return mix(out) >> _U(1)


def winnowed(points: np.ndarray, bounds: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> Selected:
    """The fingerprints of the texts points[bounds[i]:bounds[i+1]]."""
    sizes = np.diff(bounds)
    texts = np.flatnonzero(sizes)
    grams = np.maximum(1, sizes[texts] - gram + 1)
    laid = np.maximum(grams, window)  # a text with too few grams is filled up to one window
    start = np.cumsum(laid) - laid
    h = np.full(int(laid.sum()), _NONE)
    long = sizes[texts] >= gram
    if long.any():
        every = gram_hashes(points, gram)
        h[ragged(start[long], grams[long])] = every[ragged(bounds[texts[long]], grams[long])]
    for i in np.flatnonzero(~long):  # shorter than a gram: the text and its length
        own = points[bounds[texts[i]] : bounds[texts[i] + 1]]
        h[start[i]] = mix(gram_hashes(own, len(own)) ^ _U(len(own)))[0] >> _U(1)
    least, at, size = h, np.arange(len(h)), 1
    while size < window:
        step = min(size, window - size)
        n = len(least) - step
        right = least[step:] <= least[:n]
        least, at = np.where(right, least[step:], least[:n]), np.where(right, at[step:], at[:n])
        size += step
    chosen = at[ragged(start, laid - window + 1)]
    keep = np.ones(len(chosen), bool)
    keep[1:] = chosen[1:] != chosen[:-1]
    chosen = chosen[keep]
    text = np.searchsorted(start, chosen, "right") - 1
    return Selected(np.searchsorted(texts[text], np.arange(len(sizes) + 1)), h[chosen], chosen - start[text])


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the code points of all texts, the n+1 bounds of each)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    return points, np.cumsum([0, *map(len, texts)])


def likeness(one: set[int], two: set[int]) -> float:
    both = len(one & two)
    return both / (len(one) + len(two) - both) if one or two else 1.0


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes and places (code points from the start of the text) of every document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = winnowed(*points_of(b.column("text").to_pylist()), gram, window)
            lists = [pa.ListArray.from_arrays(pa.array(s.bounds.astype(np.int32)), pa.array(x.astype(np.int64))) for x in (s.hashes, s.places)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *lists], ["doc_id", "hashes", "places"])

    return rows.mapInArrow(run, "doc_id long, hashes array<long>, places array<long>")


def neighbours(docs: DataFrame) -> DataFrame:
    """(part, guest, doc_id, text), sorted by part, guests first, then ascending doc_id, with no part cut: the row before a
    row is the document that comes next in descending order. A guest is a copy of the last row of the part before."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("hash", F.xxhash64("text"))
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("at", [i / n for i in range(1, n)], 4 * n)).first()[0]
    bounds = np.array(cuts or [], np.int64)

    def parts(at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(bounds, at, "left"), np.searchsorted(bounds, at, "right")
        share = ((hashes >> 32) + (1 << 31)) * (high - low + 1) >> 32
        return np.where(high > low, low + share, low)

    @pandas_udf("int")
    def part_of(at: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(parts(at.to_numpy(), hashes.to_numpy()), dtype="int32")

    ends = rows.groupBy(part_of("at", "hash").alias("part")).agg(F.max(F.struct("at", "hash")).alias("m")).select("part", "m.*").orderBy("part").collect()
    last = {r.part: (r.at, r.hash) for r in ends}
    after = dict(pairwise([*last, *list(last)[:1]])) if last else {}
    known = np.array([[p, *last[p], after[p]] for p in last], np.int64).reshape(-1, 4)

    @pandas_udf("array<int>")
    def parts_of(at: pd.Series, hashes: pd.Series) -> pd.Series:
        """The part of a row, and that to which it goes as a guest."""
        a, h = at.to_numpy(), hashes.to_numpy()
        own = parts(a, h)
        k = np.searchsorted(known[:, 0], own)
        end = (known[k, 1] == a) & (known[k, 2] == h)
        return pd.Series([[p, q] if e else [p] for p, q, e in zip(own.tolist(), known[k, 3].tolist(), end.tolist(), strict=True)])

    dealt = rows.select("*", F.posexplode(parts_of("at", "hash")).alias("guest", "part"))
    dealt = dealt.repartition("part").sortWithinPartitions("part", F.desc("guest"), "at", "hash")
    return dealt.select("part", (F.col("guest") > 0).alias("guest"), "doc_id", "text")


def compare(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has its last third replaced by the beginning of the next document, by descending doc_id. A fingerprint is
    written as the selected hashes in order, eight hexadecimal digits (the lower 32 of their 63 bits) for each."""
    small_batches(docs.sparkSession)

    def written(s: Selected) -> list[str]:
        digits = (s.hashes & _U((1 << 32) - 1)).astype(">u4").tobytes().hex()
        return [digits[8 * a : 8 * b] for a, b in pairwise(s.bounds.tolist())]

    def sets(s: Selected) -> list[set[int]]:
        every = s.hashes.tolist()
        return [set(every[a:b]) for a, b in pairwise(s.bounds.tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, text, prints = None, "", set()  # of the row before
        for b in slices(batches, "text"):
            own, parts, guest = b.column("text").to_pylist(), b.column("part").to_pylist(), b.column("guest").to_numpy(zero_copy_only=False)
            before = [text, *own[:-1]]
            edited = [x[: len(x) - len(x) // 3] + y[: len(x) // 3] for x, y in zip(own, before, strict=True)]
            one, two = winnowed(*points_of(own), gram, window), winnowed(*points_of(edited), gram, window)
            mine, theirs = sets(one), sets(two)
            out = np.flatnonzero(~guest).tolist()
            assert all(parts[i] == (parts[i - 1] if i else part) for i in out), "a part begins with a guest"
            others = [prints, *mine[:-1]]
            hex_one, hex_two = written(one), written(two)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(out, pa.int64())),
                    pa.array([len(own[i]) for i in out], pa.int64()),
                    pa.array([sha256(edited[i].encode()).hexdigest() for i in out], pa.string()),
                    pa.array([hex_one[i] for i in out], pa.string()),
                    pa.array([hex_two[i] for i in out], pa.string()),
                    pa.array([likeness(mine[i], theirs[i]) for i in out], pa.float64()),
                    pa.array([likeness(mine[i], others[i]) for i in out], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            part, text, prints = parts[-1], own[-1], mine[-1]

    return neighbours(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
