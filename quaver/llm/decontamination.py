"""Benchmark decontamination by a BM25 index of the test items and block-max WAND.

The index holds the test items; queries are the passages of all training documents: windows of twice the longest
item's words, each beginning half a window after the last, so that every occurrence of an item lies whole in one.
Scores are divided by the item's score against itself: an item that a passage holds in full scores 1, and one
threshold serves all items. A passage is dropped when for no block of items the sum of its terms' block maxima
reaches the threshold; what is left is searched by block-max WAND, which returns every item above the threshold.
Each is verified on word shingles: most of the item, and at least half of its question (the first two thirds) and of
its answer (the rest), must occur in the passage.

The items come to the driver in blocks of about MAX_INDEX_BYTES of text. A block's index is broadcast, its result is
written, and the index is released before the next block comes; more items mean more blocks, not a larger index. The
number of items, their mean and largest length and the document frequencies are those of all items, counted by Spark, so
blocks score as one index would.

Letters are compared in lower case. Null and empty documents or items match nothing. Items of fewer than five words match where all their words occur in a
row. Repeated documents and repeated items give repeated pairs. Only doc_id, text, item_id are read by find(); other
columns can't clash. Without items there are no pairs.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import durable, slices, small_batches, utf8
from quaver.llm.words import SHINGLE, Words, shingles, words

MAX_INDEX_BYTES = 16_000_000
#: Blocks for the first, vectorised test of a passage, and postings in a block of the search proper.
OUTER_BLOCKS, INNER_BLOCK = 64, 8
K1, B = 1.2, 0.75
#: Low bits of a hash by which most words that no item has are told.
SEEN_MASK = np.uint64((1 << 18) - 1)


class Hit(NamedTuple):
    row: int
    item: int
    score: float
    overlap: float
    question: float
    answer: float
    at: int


class Statistics(NamedTuple):
    """Of all items: their number, words in all and in the longest, and the document frequency of some terms, sorted."""

    items: int
    words: int
    longest: int
    terms: np.ndarray
    df: np.ndarray


def windows_of(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The shingle hashes of a run of word hashes, in order."""
    bounds = np.array([0, len(h)])
    w = Words(np.arange(len(h)), np.ones(len(h), np.int64), np.zeros(len(h), np.int64), h, bounds)
    return shingles(w, k)[1]


END = 1 << 62


class Postings:
    """A cursor over one term's postings, with the largest impact of the list and of each block."""

    def __init__(self, docs: list[int], impacts: list[float], maxima: list[float]):
        self.docs, self.impacts, self.maxima, self.at = docs, impacts, maxima, 0
        self.most = max(maxima, default=0.0)

    @property
    def doc(self) -> int:
        return self.docs[self.at] if self.at < len(self.docs) else END

    def seek(self, doc: int) -> None:
        self.at = bisect_left(self.docs, doc, self.at)

    def block(self, doc: int) -> tuple[float, int]:
        """(largest impact, last item) of the block that would hold doc."""
        at = bisect_left(self.docs, doc, self.at)
        if at == len(self.docs):
            return 0.0, END
        k = at // INNER_BLOCK
        return self.maxima[k], self.docs[min(len(self.docs), (k + 1) * INNER_BLOCK) - 1]

    def take(self, doc: int) -> float:
        """The impact on doc; the cursor goes past it."""
        self.seek(doc)
        if self.doc != doc:
            return 0.0
        self.at += 1
        return self.impacts[self.at - 1]


class Index:
    """BM25 postings with block maxima, and each item's shingles for verification."""

    def __init__(self, ids: list[int], texts: list[str], threshold: float, whole: Statistics | None = None):
        data, offs = utf8(pc.utf8_lower(pa.array(texts, pa.string())))
        w = words(data, offs)
        self.threshold = threshold
        n = np.diff(w.bounds)
        full = np.flatnonzero(n)
        self.ids = [ids[i] for i in full]
        self.longest = int(n.max(initial=0)) if whole is None else whole.longest
        mean = (n[full].mean() if len(full) else 1.0) if whole is None else whole.words / whole.items
        many = len(full) if whole is None else whole.items
        self.terms, term = np.unique(w.hash, return_inverse=True)
        self.seen = np.zeros(int(SEEN_MASK) + 1, bool)
        self.seen[self.terms & SEEN_MASK] = True
        place = np.searchsorted(full, w.doc)
        pair, tf = np.unique(term * max(1, len(full)) + place, return_counts=True)
        term, item = pair // max(1, len(full)), pair % max(1, len(full))
        df = np.bincount(term, minlength=len(self.terms)) if whole is None else whole.df[np.searchsorted(whole.terms, self.terms)]
        idf = np.log1p((many - df + 0.5) / (df + 0.5))
        size = n[full][item]
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
        own = np.bincount(item, impact, minlength=len(full))
        impact = impact / own[item]
        self.at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.item, self.impact, self.cut = item, impact, {}
        self.per_outer = max(1, math.ceil(len(full) / OUTER_BLOCKS))
        self.outer = np.zeros((len(self.terms), max(1, math.ceil(len(full) / self.per_outer))), np.float32)
        np.maximum.at(self.outer, (term, item // self.per_outer), impact.astype(np.float32))
        self.k, self.shingles, self.question, self.answer = [], [], [], []
        for i in full:
            h = w.hash[w.bounds[i] : w.bounds[i + 1]]
            k, cut = min(SHINGLE, len(h)), len(h) * 2 // 3
            self.k.append(k)
            self.shingles.append(windows_of(h, k))
            self.question.append(windows_of(h[: max(cut, k)], k))
            self.answer.append(windows_of(h[min(cut, len(h) - k) :], k))

    def postings(self, term: int, low: int, high: int) -> tuple[list[int], list[float], list[float]]:
        """(items, impacts, block maxima) of a term among items low:high, kept for the next passage."""
        if (term, low) not in self.cut:
            a, b = self.at[term], self.at[term + 1]
            a, b = a + np.searchsorted(self.item[a:b], (low, high))
            impacts = self.impact[a:b].tolist()
            self.cut[term, low] = self.item[a:b].tolist(), impacts, [max(impacts[i : i + INNER_BLOCK]) for i in range(0, len(impacts), INNER_BLOCK)]
        return self.cut[term, low]

    def search(self, terms: list[int], low: int, high: int) -> list[tuple[int, float]]:
        """(item, score) of all items in low:high whose score reaches the threshold: block-max WAND."""
        enough, found = self.threshold - 1e-9, []
        lists = [Postings(*self.postings(t, low, high)) for t in terms]
        while True:
            lists = sorted((c for c in lists if c.doc < END), key=lambda c: c.doc)
            bound, pivot = 0.0, -1
            for i, c in enumerate(lists):
                bound += c.most
                if bound >= enough:
                    pivot = i
                    break
            if pivot < 0:
                return found
            doc = lists[pivot].doc
            while pivot + 1 < len(lists) and lists[pivot + 1].doc == doc:
                pivot += 1
            blocks = [c.block(doc) for c in lists[: pivot + 1]]
            if sum(most for most, _ in blocks) < enough:
                goal = min([last + 1 for _, last in blocks] + [c.doc for c in lists[pivot + 1 : pivot + 2]])
                for c in lists[: pivot + 1]:
                    c.seek(max(goal, doc + 1))
            else:
                score = sum(c.take(doc) for c in lists[: pivot + 1])
                if score >= enough:
                    found.append((doc, score))

    def candidates(self, w: Words) -> Iterator[tuple[int, int, int, list[tuple[int, float]]]]:
        """(row, first word, word after the last, [(item, score)]) of passages that reach the threshold for some item."""
        if not len(self.ids) or not len(w.hash):
            return
        half = self.longest
        n = np.diff(w.bounds)
        per_row = np.maximum(1, -(-n // half) - 1) * (n > 0)
        base = np.cumsum(per_row) - per_row
        known = np.flatnonzero(self.seen[w.hash & SEEN_MASK])
        at = np.minimum(np.searchsorted(self.terms, w.hash[known]), len(self.terms) - 1)
        right = self.terms[at] == w.hash[known]
        known, term = known[right], at[right]
        row = w.doc[known]
        step = (known - w.bounds[row]) // half
        one, two = np.minimum(step, per_row[row] - 1), np.minimum(np.maximum(step - 1, 0), per_row[row] - 1)
        passage = np.concatenate([base[row] + one, (base[row] + two)[one != two]])
        term = np.concatenate([term, term[one != two]])
        pair = np.sort(passage * len(self.terms) + term)
        pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
        passage, term = pair // len(self.terms), pair % len(self.terms)
        first = np.flatnonzero(np.append(True, passage[1:] != passage[:-1])) if len(passage) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(passage))
        for lo in range(0, len(first), 2000):
            some = slice(first[lo], ends[min(lo + 2000, len(first)) - 1])
            best = np.add.reduceat(self.outer[term[some]], first[lo : lo + 2000] - first[lo], axis=0)
            for p, block in zip(*np.nonzero(best >= self.threshold - 1e-4), strict=True):
                a, b = first[lo + p], ends[lo + p]
                low = int(block) * self.per_outer
                got = self.search(term[a:b].tolist(), low, low + self.per_outer)
                if got:
                    r = int(np.searchsorted(base, passage[a], "right")) - 1
                    while not per_row[r]:
                        r -= 1
                    begin = int(passage[a] - base[r]) * half
                    end = int(n[r]) if passage[a] - base[r] == per_row[r] - 1 else begin + 2 * half
                    yield r, begin, end, got

    def hits(self, column: pa.Array, overlap: float, part: float) -> list[Hit]:
        """Verified hits of the texts, the best passage of each row and item."""
        data, offs = utf8(pc.utf8_lower(column))
        w = words(data, offs)
        best: dict[tuple[int, int], Hit] = {}
        for row, begin, end, got in self.candidates(w):
            run = w.hash[w.bounds[row] + begin : w.bounds[row] + end]
            texts: dict[int, np.ndarray] = {}
            for item, score in got:
                k = self.k[item]
                if k not in texts:
                    texts[k] = windows_of(run, k)
                held = [float(np.isin(s[item], texts[k]).mean()) for s in (self.shingles, self.question, self.answer)]
                if held[0] >= overlap and min(held[1:]) >= part and ((row, item) not in best or held[0] > best[row, item].overlap):
                    best[row, item] = Hit(row, item, score, *held, begin)
        return list(best.values())


def item_terms(rows: DataFrame) -> DataFrame:
    """(term, words): every distinct term of an item, and once for each item, as term null, its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words(*utf8(pc.utf8_lower(b.column("text"))))
            n = np.diff(w.bounds)
            pair = np.unique(np.stack([w.doc.astype(np.uint64), w.hash]), axis=1)[1] if len(w.hash) else w.hash
            yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.nulls(len(pair), pa.int64())], ["term", "words"])
            yield pa.RecordBatch.from_arrays([pa.nulls(int((n > 0).sum()), pa.int64()), pa.array(n[n > 0])], ["term", "words"])

    return rows.mapInArrow(run, "term long, words long")


def indexes(items: DataFrame, threshold: float) -> Iterator[tuple[Index, bool]]:
    """(index, whether there are others) of each block of items; items fall into blocks by the hash of their text."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    many = 1 if total <= MAX_INDEX_BYTES else -(-2 * total // MAX_INDEX_BYTES)
    if many == 1:
        got = rows.orderBy("item_id", "text").collect()
        yield Index([r.item_id for r in got], [r.text for r in got], threshold), False
        return
    found = item_terms(rows)
    size = found.where("words is not null").agg(F.count("*").alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.max("words"), F.lit(0)).alias("longest")).first()
    df = durable(found.where("term is not null").groupBy("term").agg(F.count("*").alias("df")))
    for i in range(many):
        block = rows.where(F.pmod(F.xxhash64("text"), F.lit(many)) == i)
        got = block.orderBy("item_id", "text").collect()
        t = df.join(item_terms(block).where("term is not null").select("term").distinct(), "term").toArrow()
        terms = t.column("term").to_numpy().view(np.uint64)
        order = np.argsort(terms)
        yield Index([r.item_id for r in got], [r.text for r in got], threshold, Statistics(size.n, size.words, size.longest, terms[order], t.column("df").to_numpy()[order])), True


def find(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.75, part: float = 0.5) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap, word of every contaminated pair."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found: list[DataFrame] = []
    for index, others in indexes(items, threshold):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                hits = shared.value.hits(b.column("text"), overlap, part)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array([h.row for h in hits], pa.int64())), pa.array([shared.value.ids[h.item] for h in hits], pa.int64())]
                    + [pa.array([getattr(h, k) for h in hits], pa.float64()) for k in ("score", "overlap", "question", "answer")]
                    + [pa.array([h.at for h in hits], pa.int64())],
                    ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap", "word"],
                )

        pairs = rows.mapInArrow(run, "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double, word long")
        if others:
            pairs = durable(pairs)
            shared.unpersist()
        found.append(pairs)
    return reduce(DataFrame.unionByName, found)


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.75, part: float = 0.5) -> DataFrame:
    """The documents without any benchmark item, all columns kept; each block of items is one filter over the rows."""
    spark = docs.sparkSession
    small_batches(spark)
    for index, others in indexes(items, threshold):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                keep = np.ones(b.num_rows, bool)
                keep[[h.row for h in shared.value.hits(b.column("text"), overlap, part)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if others:
            docs = durable(docs)
            shared.unpersist()
    return docs
