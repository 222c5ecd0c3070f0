"""Language-model scores by a probabilistic suffix tree over words.

Tokens are words (quaver.llm.words), A-Z as a-z, then one END for each text. A state of the tree is a context of up to
`depth` words. Strings (context and next symbol) that occur LEAST_COUNT times are stored, and contexts that occur
least_context times are tested, at every size of the corpus, so the tree grows with it. A tested context is a state if its next-symbol distribution diverges from that of its suffix: the gain in log-likelihood must be
at least GAIN nats for each string it stores. Suffixes of states are states. Stored counts are discounted by DISCOUNT;
what that leaves is given to the suffix's distribution, down to the root, (c + 0.1) / (N + 0.1 (V + 1)). A text's score
is the sum of log10 probabilities, each in the longest suffix of its history that is a state.

All counts are exact and over all training texts. Words are counted first, then names of strings: of two words that are
both frequent, then of longer ones all of whose pairs are. Names travel sorted and packed by range, so that the many
rare strings cost few bytes. Filters of fixed size spare strings with a part that is too rare
to be stored; what it lets through is dropped by its count. The tree is a table: each token's log10 probability is a sum
of terms that are named by the 64-bit hashes of strings and states. The terms of the most frequent strings, HOT at most
of each kind, are sent to all tasks; the others are joined to the texts that may need them. How many are sent changes
no score. The more of the tree isn't sent, the more rounds there are: each scores a share of the texts, and what it asked
and shuffled is deleted before the next. All texts are scored, each in one round.

Null and empty texts consist of END alone. Repeated rows are learned from and scored each. held_out rows (null counts
as false) are never learned from. A null doc_id stays null. Only doc_id and text are read; other columns can't clash. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import HOT_SHARE, dropped, durable, hot_keys, slices, small_batches, split_join, swept, utf8
from quaver.llm.words import mix, words

LEAST_COUNT = 16
GAIN, DISCOUNT, ALPHA = 4.0, 0.5, 0.1
#: Words of the longest context.
DEPTH = 4
#: Terms of each kind (words, other strings and states) that are sent to all tasks, at most.
HOT = 1 << 20
#: Names that a round asks for: one for so many training tokens, about.
TOKENS_A_NAME = 8
FILTER_BITS = 27
#: Counters a task holds before it hands them on.
MAX_HELD = 4_000_000
#: Training tokens for each task that adds counters up.
KEYS_A_PART = 4_000_000
#: Rows of one key that a task may join.
ROWS_A_KEY = 100_000
_U = np.uint64
END = np.uint64(0x9D5C0FB1E3A76F21)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts, each text's followed by END; n+1 bounds)."""
    w = words(*utf8(column))
    n = len(w.bounds) - 1
    out = np.empty(len(w.hash) + n, np.uint64)
    bounds = w.bounds + np.arange(n + 1)
    out[np.arange(len(w.hash)) + w.doc] = w.hash
    out[bounds[1:] - 1] = END
    return out, bounds


def chained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of the string of a and b."""
    return mix(mix(a ^ _U(0x51ED270B)) ^ b)


def state_name(a: np.ndarray) -> np.ndarray:
    return mix(a ^ _U(0xC2B2AE3D27D4EB4F))


def histories(t: np.ndarray, bounds: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For contexts of 1, 2, ... depth words: (places of tokens with so long a history, their contexts' names, their suffix strings' names).

    The name of the string of k + 1 tokens that ends at a place is chained() of the string of k tokens before and of that
    which ends there.
    """
    here, seen = t, np.arange(len(t)) - np.repeat(bounds[:-1], np.diff(bounds))
    for k in range(1, depth + 1):
        before = np.append(_U(0), here[:-1])
        at = np.flatnonzero(seen >= k)
        yield at, before[at], here[at]
        here = chained(before, here)


class Places:
    """Finds sorted, evenly spread 64-bit names: their first bits lead to the few that share them."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = _U(64 - max(1, (2 * len(keys)).bit_length()))
        self.start = np.searchsorted(keys >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The place of each x in the keys, or -1."""
        out = np.full(len(x), -1)
        first = (x >> self.shift).astype(np.int64)
        at, end = self.start[first], self.start[first + 1]
        live = np.flatnonzero(at < end)
        at, end = at[live], end[live]
        while len(live):
            hit = self.keys[at] == x[live]
            out[live[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            live, at, end = live[more], at[more], end[more]
        return out


def bits_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the filter for each x."""
    h = mix(x ^ _U(0x27D4EB2F165667C5))
    return (h >> _U(64 - FILTER_BITS)).astype(np.int64), (h & _U((1 << FILTER_BITS) - 1)).astype(np.int64)


def passes(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    one, two = bits_of(x)
    return ((bits[one >> 3] >> (one & 7).astype(np.uint8)) & (bits[two >> 3] >> (two & 7).astype(np.uint8)) & 1).astype(bool)


def filter_of(names: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS that all names pass, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(bits_of(b.column(0).to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(1 << (at & 31))], ["word", "mask"])

    with swept(names.sparkSession):
        t = names.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 5), "<u4")
    out[t.column("word").to_numpy()] = t.column("mask").to_numpy().astype("<u4")
    return out.view(np.uint8)


def held_by_all(terms: DataFrame, most: int) -> int:
    """The least count such that at most `most` rows have it or more."""
    step = F.floor(32 * F.log2("c")).cast("int")
    left, bar = most, 1 << 62
    for r in sorted(terms.where(F.col("c") > 0).groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("low")).collect(), key=lambda r: -r.s):
        left -= r.n
        if left < 0:
            break
        bar = r.low
    return bar


def gathered(batches: Iterator[pa.RecordBatch], keys: Callable[[pa.Array], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct keys of the texts and how often each occurs, in as few parts as MAX_HELD counters allow."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for b in slices(batches, "text"):
        k, c = np.unique(keys(b.column("text")), return_counts=True)
        held.append((k, c.astype(np.int64)))
        size += len(k)
        if size > MAX_HELD:
            held = [merged(held)]
            size = len(held[0][0])
            if size > MAX_HELD // 2:
                yield held[0]
                held, size = [], 0
    if size:
        yield merged(held)


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, c = (np.concatenate([x[i] for x in held]) for i in (0, 1))
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[first], np.add.reduceat(c, first)


def counters(k: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(k), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(k[at : at + 100_000].view(np.int64)), pa.array(c[at : at + 100_000])], ["key", "c"])


def counted(docs: DataFrame, keys: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """(key, c): how often the keys that `keys` makes of the texts occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, c in gathered(batches, keys):
            yield from counters(k, c)

    return docs.select("text").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def packed(x: np.ndarray) -> bytes:
    """Numbers of 64 bits, their highest bytes together, so that small ones compress well."""
    return np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def frequent(docs: DataFrame, keys: Callable[[pa.Array], np.ndarray], least: int, parts: int) -> DataFrame:
    """(key, c) of the evenly spread keys that occur `least` times; `parts` tasks add the counters up.

    Most keys are rare, so no row is made of each: a task sorts its keys and hands on their differences, packed by range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, c in gathered(batches, keys):
            part = ((k >> _U(32)) * _U(parts)) >> _U(32)
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = np.append(first[1:], len(k))
            blocks = [(packed(np.diff(k[i:j], prepend=_U(0))), packed(c[i:j])) for i, j in zip(first, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), *(pa.array(x, pa.binary()) for x in zip(*blocks, strict=True))], ["part", "k", "c"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            for k, c in zip(b.column("k"), b.column("c"), strict=True):
                held.append((np.cumsum(unpacked(k.as_py()), dtype=np.uint64), unpacked(c.as_py()).astype(np.int64)))
                size += len(held[-1][0])
            if size > MAX_HELD:
                held = [merged(held)]
                size = 0
        if held:
            k, c = merged(held)
            yield from counters(k[c >= least], c[c >= least])

    blocks = docs.select("text").mapInArrow(run, "part int, k binary, c binary")
    return durable(blocks.repartitionById(parts, "part").mapInArrow(added, "key long, c long"))


def kept_runs(t: np.ndarray, bounds: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For each place: how many strings of two words in a row, up to the one that ends there, pass the filter."""
    at, a, b = next(histories(t, bounds, 1))
    ok = np.zeros(len(t), bool)
    ok[at] = passes(bits, chained(a, b))
    place = np.arange(len(t))
    return place - np.maximum.accumulate(np.where(ok, -1, place))


def strings(docs: DataFrame, able: DataFrame, total: int, depth: int) -> DataFrame:
    """(k, a, b, c, key): all strings of context a, of k words, and b that occur LEAST_COUNT times, their counts and names.

    Three passes whatever the depth: names of strings of two words; names of longer ones all of whose pairs are frequent;
    contexts and suffixes of the strings whose names are. able: the words that occur LEAST_COUNT times.
    """
    sc = docs.sparkSession.sparkContext
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // KEYS_A_PART))
    known = sc.broadcast(filter_of(able.select("key")))

    def pairs(column: pa.Array) -> np.ndarray:
        t, bounds = tokens(column)
        ok = passes(known.value, t)
        at, a, b = next(histories(t, bounds, 1))
        both = ok[at - 1] & ok[at]
        return chained(a[both], b[both])

    names = frequent(docs, pairs, LEAST_COUNT, parts)
    two = sc.broadcast(filter_of(names.select("key")))
    dropped(names)
    known.destroy()

    def longer(column: pa.Array) -> np.ndarray:
        t, bounds = tokens(column)
        runs = kept_runs(t, bounds, two.value)
        found = [chained(a[runs[at] >= k], b[runs[at] >= k]) for k, (at, a, b) in enumerate(histories(t, bounds, depth), 1) if k > 1]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    if depth > 1:
        names = frequent(docs, longer, LEAST_COUNT, parts)
        more = sc.broadcast(filter_of(names.select("key")))
        dropped(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            t, bounds = tokens(b.column("text"))
            runs = kept_runs(t, bounds, two.value)
            for k, (at, x, y) in enumerate(histories(t, bounds, depth), 1):
                ok = runs[at] >= k
                x, y = x[ok], y[ok]
                key = chained(x, y)
                if k > 1:
                    ok = passes(more.value, key)
                    x, y, key = x[ok], y[ok], key[ok]
                _, first, c = np.unique(key, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), k, np.int32)), pa.array(x[first].view(np.int64)), pa.array(y[first].view(np.int64)), pa.array(c)], ["k", "a", "b", "c"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(k).to_numpy().view(np.uint64) for k in "ab")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chained(x, y).view(np.int64))], ["k", "a", "b", "c", "key"])

    rows = docs.select("text").mapInArrow(run, "k int, a long, b long, c long").groupBy("k", "a", "b").agg(F.sum("c").alias("c"))
    out = durable(rows.where(F.col("c") >= LEAST_COUNT).mapInArrow(named, "k int, a long, b long, c long, key long"))
    two.destroy()
    if depth > 1:
        more.destroy()
    return out


def joined(rows: DataFrame, n: int, right: DataFrame, key: str) -> DataFrame:
    """rows, n at most, joined with right, which has one row for each key; keys of ROWS_A_KEY rows are sent to all tasks."""
    with swept(rows.sparkSession):
        hot = hot_keys(rows.groupBy(key).count(), key, max(n, int(ROWS_A_KEY / HOT_SHARE))) if n >= ROWS_A_KEY else []
    return split_join(rows, right, key, hot)


def states(rows: DataFrame) -> DataFrame:
    """(a, total, rest, stays) of the contexts of (a, c, total, below), below: what the suffix gives to the string."""
    rest = 1 - (F.sum("c") - DISCOUNT * F.count("*")) / F.first("total")
    one = rows.groupBy("a").agg(F.first("total").alias("total"), rest.alias("rest"), F.sum("c").alias("seen"), F.sum("below").alias("given"), F.count("*").alias("stored"))
    add = (F.col("c") - DISCOUNT) / F.col("total")
    gain = F.sum(F.col("c") * F.log(F.greatest(add + F.col("rest") * F.col("below"), F.lit(1e-300)) / F.col("below")))
    two = rows.drop("total").join(one, "a").groupBy("a").agg(gain.alias("gain"))
    left = (F.col("total") - F.col("seen")) * F.log(F.greatest("rest", F.lit(1e-300)) / F.greatest(1 - F.col("given"), F.lit(1e-9)))
    return durable(one.join(two, "a").select("a", "total", "rest", (F.col("gain") + F.least(left, F.lit(0.0)) >= GAIN * F.col("stored")).alias("stays")))


class Model(NamedTuple):
    """The tree as tables: levels[k - 1] has (a, b, c, key, rest, below, p) of the strings in states of k words."""

    counts: DataFrame
    total: int
    kinds: int
    levels: list[DataFrame]


def learn(docs: DataFrame, counts: DataFrame, depth: int = DEPTH, least_context: int = LEAST_COUNT) -> Model:
    """The tree of the training texts; counts: their words' counts. Contexts that occur less than least_context times aren't tested."""
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    able = counts.where(F.col("c") >= LEAST_COUNT)
    stored = strings(docs, able, total, depth)
    sizes = {r.k: r["count"] for r in stored.groupBy("k").count().collect()}
    shorter = able.select("key", "c", ((F.col("c") + ALPHA) / (total + ALPHA * (kinds + 1))).alias("p"))
    rows: list[DataFrame] = []
    tests: list[DataFrame] = []
    for k in range(1, depth + 1):
        found = stored.where(F.col("k") == k).drop("k")
        contexts = shorter.where(F.col("c") >= least_context).select(F.col("key").alias("a"), F.col("c").alias("total"))
        n = sizes.get(k, 0)
        found = joined(found, n, shorter.select(F.col("key").alias("b"), F.col("p").alias("below")), "b")
        found = durable(joined(found, n, contexts, "a"))
        test = states(found)
        add = (F.col("c") - DISCOUNT) / F.col("total")
        shorter = durable(joined(found.drop("total"), n, test, "a").select("a", "b", "c", "key", "rest", "below", (add + F.col("rest") * F.col("below")).alias("p")))
        rows.append(shorter)
        dropped(found)
        tests.append(test)
    dropped(stored)
    # suffixes of states are states: the context a of k words is a string of the level before, whose b is its suffix
    passed = [test.where("stays").select("a") for test in tests]
    stay, stays, levels = passed[-1], [], []
    for k in range(depth, 0, -1):
        stay = durable(stay.distinct())
        stays.append(stay)
        levels.append(durable(rows[k - 1].join(stay, "a", "left_semi")))
        if k > 1:
            suffix = stay.join(rows[k - 2].select(F.col("key").alias("a"), F.col("b").alias("w")), "a").select(F.col("w").alias("a"))
            stay = passed[k - 2].union(suffix)
    dropped(*rows, *tests, *stays)
    return Model(counts, total, kinds, levels[::-1])


def terms(m: Model) -> DataFrame:
    """(key, c, v): what a string or state adds to log10 of the probability."""

    def states_of(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(state_name(b.column("a").to_numpy().view(np.uint64)).view(np.int64)), b.column("c"), b.column("v")], ["key", "c", "v"])

        return rows.groupBy("a").agg(F.sum("c").alias("c"), F.log10(F.first("rest")).alias("v")).mapInArrow(run, "key long, c long, v double")

    found = [part for rows in m.levels for part in (rows.select("key", "c", F.log10(F.col("p") / F.col("below") / F.col("rest")).alias("v")), states_of(rows))]
    return durable(reduce(DataFrame.unionByName, found).coalesce(int(m.counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def score(docs: DataFrame, held_out: Column, depth: int = DEPTH, least_context: int = LEAST_COUNT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    training = docs.where(~F.col("held_out"))
    counts = durable(counted(training, lambda column: tokens(column)[0]))
    m = learn(training, counts, depth, least_context)
    bottom = m.total + ALPHA * (m.kinds + 1)
    unseen = math.log10(ALPHA / bottom)
    roots = counts.select("key", "c", F.log10((F.col("c") + ALPHA) / bottom).alias("v"))
    tree = terms(m)
    dropped(*m.levels)
    bars = [held_by_all(roots.where(F.col("c") >= LEAST_COUNT), HOT), held_by_all(tree, HOT)]

    def sent(rows: DataFrame, bar: int) -> tuple[np.ndarray, np.ndarray]:
        t = rows.where(F.col("c") >= bar).select("key", "v").toArrow()
        key = t.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        return key[order], t.column("v").to_numpy()[order]

    cold = tree.where(F.col("c") < bars[1])
    shared = spark.sparkContext.broadcast((*sent(roots, bars[0]), *sent(tree, bars[1]), filter_of(cold.select("key"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root_keys, root_v, keys, v, bits = shared.value
        root_v, v = np.append(root_v, unseen), np.append(v, 0.0)
        root_places, places = Places(root_keys), Places(keys)
        for b in slices(batches, "text"):
            t, bounds = tokens(b.column("text"))
            x = root_places.of(t)
            p, new = root_v[x], np.flatnonzero(x < 0)
            lists = [(new, t[new])]
            model = p.copy()
            state = np.ones(len(t), bool)  # whether the context so far may be one; no longer one is where it isn't
            for at, context, suffix in histories(t, bounds, depth):
                some = state[at]
                at, context, suffix = at[some], context[some], suffix[some]
                for is_state, name in ((True, state_name(context)), (False, chained(context, suffix))):
                    if not is_state:
                        at, name = at[found], name[found]
                    got = places.of(name)
                    model[at] += v[got]
                    ask = (got < 0) & passes(bits, name)
                    lists.append((at[ask], name[ask]))
                    if is_state:
                        found = (got >= 0) | ask
                        state[:] = False
                        state[at[found]] = True
            asked, names = (np.concatenate([y[i] for y in lists]) for i in (0, 1))
            order = np.argsort(asked, kind="stable")
            names = pa.ListArray.from_arrays(pa.array(np.searchsorted(asked[order], bounds).astype(np.int32)), pa.array(names[order].view(np.int64)))
            sums = [np.add.reduceat(y, bounds[:-1]) for y in ((x >= 0).astype(np.int64), p, model)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(np.diff(bounds)), *map(pa.array, sums), names], ["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "asked"])

    # a word that isn't sent counts as unseen so far
    rare = roots.where(F.col("c") < bars[0]).select("key", "c", F.lit(1).cast("long").alias("known"), (F.col("v") - unseen).alias("p"), F.lit(0.0).alias("q"))
    more = rare.unionByName(cold.select("key", "c", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("p"), F.col("v").alias("q")))
    asked = more.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    rounds = max(1, -(-asked * TOKENS_A_NAME // max(m.total, 1)))

    def scored(some: DataFrame) -> DataFrame:
        rows = durable(some.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, asked array<long>").withColumn("row", F.monotonically_increasing_id()))
        found = rows.select("row", F.explode("asked").alias("key")).join(more.drop("c"), "key")
        rest = durable(found.groupBy("row").agg(F.sum("known").alias("known"), F.sum("p").alias("p"), F.sum("q").alias("q")))
        out = rows.join(rest, "row", "left").select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
            F.lit(m.total).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("p", F.lit(0.0))).alias("base_score"),
            (F.col("model") + F.coalesce("p", F.lit(0.0)) + F.coalesce("q", F.lit(0.0))).alias("score"),
        )
        out = durable(out)
        dropped(rows, rest)
        return out

    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))
    out = reduce(DataFrame.unionByName, [scored(docs.where(share == i) if rounds > 1 else docs) for i in range(rounds)])
    shared.destroy()
    dropped(counts, tree)
    return out
