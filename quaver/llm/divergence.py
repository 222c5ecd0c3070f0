"""How far the sources of a language diverge from each other, and which terms make a source stand out.

A term is a run of ASCII letters and characters beyond ASCII; A-Z count as a-z. A language keeps the V terms that are in at
least least_docs of its documents. A group is a language, or one of its sources; N counts the group's occurrences of kept
terms, and each kept term has p = 1 + floor(UNIT (count + 1) / (N + V)) there. The divergence of p from q is
floor((p - q) (p - q) / q). Part `pair` sums it over all kept terms for each ordered pair of sources of a language; part
`term` ranks the terms that a source uses more than its language does, `most` of them. All numbers are exact integers.

Tasks count the terms of some texts and add them to a radix trie over bytes for each language, whose leaves count
occurrences by source and documents; tries that have grown to MAX_LEAVES are handed on, leaf by leaf in byte order, and begun
anew. Leaves are dealt out by ranges of (language, term), so the tries of one range of prefixes merge in one task: equal
leaves of their walks meet in UTF-8 order, and kept terms are handed on in chunks. Chunks meet the language's groups in blocks of BLOCK
sources; tasks sum divergences for each pair of blocks, and keep the best `most` candidates of each source, equal values
in byte order; Spark adds and ranks what they hand on. Only counters are shuffled, never texts.

Null text, lang and source count as empty. Repeated rows are documents each. Languages without kept terms have pairs of
divergence 0. A language of one source has no pair. Sources are told apart by 64-bit hashes, and a collision inside a
language is an error. Only text, lang and source are read; other columns can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import gc
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaver.llm.common import durable, slices, small_batches

UNIT = 1_000_000_000
#: Counters that a task holds before they go into its tries; leaves of these before it hands them on.
MAX_HELD, MAX_LEAVES = 400_000, 250_000
#: Kept terms in a chunk; sources in a block; rows of an Arrow batch of leaves, and of one of chunks.
CHUNK, BLOCK, LEAF_ROWS, CHUNK_ROWS = 1024, 128, 20_000, 16
#: Parts into which the chunks of one language are dealt.
SALT = 64
#: Bytes of a term: ASCII letters, A-Z as a-z, and all bytes of characters beyond ASCII; others part terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
DOCS = -1


class Trie:
    """A radix trie over bytes. A node is [label, children by first byte, leaf]; a leaf counts by source, and documents under DOCS."""

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.leaves = 0

    def leaf(self, term: bytes) -> dict:
        """The counters of a term, new ones if there are none."""
        node = self.root
        while term:
            child = node[1].get(term[0])
            if child is None:
                child = node[1][term[0]] = [term, {}, None]
                node = child
                break
            label = child[0]
            if term.startswith(label):
                node, term = child, term[len(label) :]
                continue
            k = 1
            while k < len(term) and k < len(label) and term[k] == label[k]:
                k += 1
            child[0] = label[k:]
            node[1][term[0]] = node = [label[:k], {label[k]: child}, None]
            term = term[k:]
        if node[2] is None:
            node[2] = {}
            self.leaves += 1
        return node[2]

    def add(self, term: bytes, counters) -> None:
        """Merges (source, count) pairs into a term's leaf."""
        leaf = self.leaf(term)
        for k, c in counters:
            leaf[k] = leaf.get(k, 0) + c

    def walk(self) -> Iterator[tuple[bytes, dict]]:
        """Terms and their counters in byte order, which for UTF-8 is that of code points."""
        todo = [(b"", self.root)]
        while todo:
            above, node = todo.pop()
            name = above + node[0]
            if node[2] is not None:
                yield name, node[2]
            todo += [(name, node[1][k]) for k in sorted(node[1], reverse=True)]


LEAF = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
LEAVES = "lang string, term string, docs long, sources array<long>, counts array<long>"


def rows_of(tries: dict[str, Trie]) -> Iterator[pa.RecordBatch]:
    """The leaves of tries, by language and in byte order."""
    for lang, trie in tries.items():
        walk = trie.walk()
        while part := [x for _, x in zip(range(20_000), walk)]:
            docs = [leaf.pop(DOCS) for _, leaf in part]
            bounds = pa.array(np.cumsum([0, *(len(leaf) for _, leaf in part)]), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int64())) for x in ([k for _, leaf in part for k in leaf], [c for _, leaf in part for c in leaf.values()])]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([t for t, _ in part], pa.binary()).cast(pa.string()), pa.array(docs, pa.int64()), *lists], schema=LEAF)


def counted(docs: DataFrame) -> DataFrame:
    """The leaves of the tries that tasks have counted, from (lang, source as a number, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # tries have no cycles, and many nodes to look through
        tries: dict[str, Trie] = {}
        seen: dict[str, dict[int, Counter]] = {}
        found: dict[str, Counter] = {}

        def gathered() -> None:
            """The counts held so far go into the tries."""
            for lang, docs_of in found.items():
                trie = tries.setdefault(lang, Trie())
                leaves = {}
                for term, c in docs_of.items():
                    leaves[term] = leaf = trie.leaf(term)
                    leaf[DOCS] = leaf.get(DOCS, 0) + c
                for source, counts in seen[lang].items():
                    for term, c in counts.items():
                        leaf = leaves[term]
                        leaf[source] = leaf.get(source, 0) + c
            seen.clear()
            found.clear()

        for b in slices(batches, "text"):
            for lang, source, text in zip(*[b.column(c).to_pylist() for c in ("lang", "source", "text")], strict=True):
                words = text.encode().translate(LETTERS).split()
                of = seen.get(lang)
                if of is None:
                    of, found[lang] = seen.setdefault(lang, {}), Counter()
                if source not in of:
                    of[source] = Counter()
                of[source].update(words)
                found[lang].update(set(words))
            if sum(len(x) for of in seen.values() for x in of.values()) > MAX_HELD:
                gathered()
                if sum(t.leaves for t in tries.values()) > MAX_LEAVES:
                    yield from rows_of(tries)
                    tries.clear()
        gathered()
        yield from rows_of(tries)
        gc.enable()

    return docs.mapInArrow(run, LEAVES)


def merged(t: pa.Table) -> pa.Table:
    """Leaves in order, those of one term put together."""
    t = t.combine_chunks()
    lang, term, docs, sources, counts = (t.column(c).chunk(0) for c in LEAF.names)
    new = np.ones(len(t), bool)
    new[1:] = np.asarray(pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])))
    first = np.flatnonzero(new)
    runs = np.repeat(np.cumsum(new) - 1, np.asarray(sources.value_lengths()))
    ids, n = np.asarray(sources.flatten()), np.asarray(counts.flatten())
    order = np.lexsort((ids, runs))
    runs, ids, n = runs[order], ids[order], n[order]
    own = np.ones(len(ids), bool)
    own[1:] = (runs[1:] != runs[:-1]) | (ids[1:] != ids[:-1])
    start = np.flatnonzero(own)
    bounds = pa.array(np.searchsorted(runs[start], np.arange(len(first) + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int64())) for x in (ids[start], np.add.reduceat(n, start))]
    return pa.table([lang.take(pa.array(first)), term.take(pa.array(first)), pa.array(np.add.reduceat(np.asarray(docs), first)), *lists], schema=LEAF)


def kept_terms(leaves: DataFrame, least_docs: int) -> DataFrame:
    """Chunks (lang, terms, bounds, sources, counts) of the terms in least_docs documents of a language, in byte order.

    Term i has counts[bounds[i]:bounds[i + 1]] occurrences in the sources at the same places."""

    def chunks(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.filter(pc.greater_equal(t.column("docs"), least_docs)).combine_chunks()
        cuts = pc.run_end_encode(t.column("lang").combine_chunks()) if len(t) else None
        at = 0
        for end in cuts.chunk(0).run_ends.to_pylist() if isinstance(cuts, pa.ChunkedArray) else cuts.run_ends.to_pylist() if cuts is not None else []:
            while at < end:
                to = min(end, at + CHUNK)
                part = t.slice(at, to - at).combine_chunks()
                sources, counts = (part.column(c).chunk(0) for c in ("sources", "counts"))
                whole = [[np.cumsum([0, *sources.value_lengths().to_pylist()])], [sources.flatten()], [counts.flatten()]]
                yield pa.RecordBatch.from_arrays([part.column("lang").chunk(0)[:1], pa.array([part.column("term").chunk(0)], pa.list_(pa.string())), *[pa.array(x, pa.list_(pa.int64())) for x in whole]], ["lang", "terms", "bounds", "sources", "counts"])
                at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None  # the last term, of which more may come
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b]).cast(LEAF)
                t = merged(t if rest is None else pa.concat_tables([rest, t]))
                rest = t.slice(len(t) - 1)
                yield from chunks(t.slice(0, len(t) - 1))
        if rest is not None:
            yield from chunks(rest)

    rows = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return rows.mapInArrow(run, "lang string, terms array<string>, bounds array<long>, sources array<long>, counts array<long>")


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT (count + 1) / total) by long division, three digits at a time; exact for totals up to 2 ** 53."""
    rest, out = counts + 1, np.zeros(np.broadcast_shapes(counts.shape, totals.shape), np.int64)
    rest = np.broadcast_to(rest, out.shape)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // totals
        rest = rest % totals
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); both are at most UNIT + 1, so squares fit."""
    return (p - q) * (p - q) // q


def blocks_of(groups: DataFrame) -> DataFrame:
    """(lang, block, sources, totals) of (lang, source, n): the sources of a language in blocks of BLOCK, by number."""
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    rows = groups.withColumn("block", F.floor(at / BLOCK).cast("int"))
    return rows.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("x")).select("lang", "block", F.col("x.source").alias("sources"), F.col("x.n").alias("totals"))


def dense(bounds: np.ndarray, sources: np.ndarray, counts: np.ndarray, known: np.ndarray) -> np.ndarray:
    """counts as a matrix of terms and known sources."""
    order = np.argsort(known)
    at = np.searchsorted(known[order], sources)
    at = np.minimum(at, len(known) - 1)
    hit = known[order][at] == sources
    out = np.zeros((len(bounds) - 1, len(known)), np.int64)
    out[np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[hit], order[at[hit]]] = counts[hit]
    return out


def audited(joined: DataFrame, most: int) -> DataFrame:
    """(lang, source, other, term, value): sums of divergence for pairs, `most` candidates at most for each source, of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        best: dict[tuple, list] = {}
        for b in batches:
            for r in b.to_pylist():
                bounds, ids, counts = (np.array(r[c], np.int64) for c in ("bounds", "sources", "counts"))
                one, two = np.array(r["one"], np.int64), np.array(r["two"], np.int64)
                v = r["kinds"]
                own = dense(bounds, ids, counts, one)
                p = shares(own, np.array(r["one_totals"], np.int64) + v)
                q = p if r["a"] == r["b"] else shares(dense(bounds, ids, counts, two), np.array(r["two_totals"], np.int64) + v)
                held = sums.setdefault((r["lang"], r["a"], r["b"]), [one, two, np.zeros((len(one), len(two)), np.int64)])
                for i in range(len(one)):
                    held[2][i] += divergence(p[:, i : i + 1], q).sum(axis=0)
                if r["a"] != r["b"]:
                    continue
                all_counts = np.add.reduceat(counts, bounds[:-1])
                lang_p = shares(all_counts, np.array([r["total"] + v]))[:, None]
                value = np.where((own > 0) & (p > lang_p), divergence(p, lang_p), -1)
                for i, source in enumerate(r["one"]):
                    some = np.flatnonzero(value[:, i] >= 0)
                    if len(some) > most:  # terms ascend, so a stable order keeps the first of equal values
                        some = some[np.argsort(-value[some, i], kind="stable")[:most]]
                    heap = best.setdefault((r["lang"], source), [])
                    heap += [(-int(value[t, i]), r["terms"][t].encode()) for t in some.tolist()]
                    if len(heap) > 4 * most:
                        best[r["lang"], source] = heapq.nsmallest(most, heap)
        out = [(lang, int(x), int(y), None, int(m[i, j])) for (lang, *_), (one, two, m) in sums.items() for i, x in enumerate(one) for j, y in enumerate(two) if x != y]
        out += [(lang, source, None, term.decode(), -value) for (lang, source), heap in best.items() for value, term in heapq.nsmallest(most, heap)]
        for k in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[k : k + 10_000], strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["lang", "source", "other", "term", "value"])

    return joined.mapInArrow(run, "lang string, source long, other long, term string, value long")


def audit(docs: DataFrame, least_docs: int = 3, most: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank of every pair of a language's sources, and of the leading terms of each source."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    names = durable(rows.select("lang", "source").distinct().withColumn("id", F.shiftright(F.xxhash64("source"), 1)))
    clash = names.groupBy("lang", "id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if clash:
        raise ValueError("two sources of a language have one hash")
    spark = docs.sparkSession
    leaves = durable(counted(rows.select("lang", F.shiftright(F.xxhash64("source"), 1).alias("source"), "text")))
    small_batches(spark, LEAF_ROWS)
    chunks = durable(kept_terms(leaves, least_docs))
    small_batches(spark, CHUNK_ROWS)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[int]] = {}
        for b in batches:
            for lang, terms, sources, counts in zip(*[b.column(c).to_pylist() for c in ("lang", "terms", "sources", "counts")], strict=True):
                found.setdefault((lang, DOCS), [0, 0])[1] += len(terms)
                for k, c in zip(sources, counts, strict=True):
                    found.setdefault((lang, k), [0, 0])[0] += c
        if found:
            yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in found], "source": [k[1] for k in found], "n": [v[0] for v in found.values()], "kinds": [v[1] for v in found.values()]})

    sums = chunks.select("lang", "terms", "sources", "counts").mapInArrow(totals, "lang string, source long, n long, kinds long")
    sums = durable(sums.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")))
    langs = sums.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("kinds").alias("kinds"))
    groups = names.select("lang", F.col("id").alias("source")).join(sums.select("lang", "source", "n"), ["lang", "source"], "left").na.fill(0, ["n"])
    blocks = durable(blocks_of(groups))
    one = blocks.select("lang", F.col("block").alias("a"), F.col("sources").alias("one"), F.col("totals").alias("one_totals"))
    two = blocks.select("lang", F.col("block").alias("b"), F.col("sources").alias("two"), F.col("totals").alias("two_totals"))
    pairs = one.join(two, "lang").join(langs, "lang").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = chunks.withColumn("salt", F.pmod(F.xxhash64(F.element_at("terms", 1)), F.lit(SALT)).cast("int"))
    parts = durable(audited(dealt.join(pairs, ["lang", "salt"]).drop("salt"), most))
    found = parts.where("term is null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    every = names.select("lang", F.col("source").alias("name"), F.col("id").alias("source"))
    both = every.join(every.select("lang", F.col("name").alias("item"), F.col("source").alias("other")), "lang").where("source <> other")
    pair = both.join(found, ["lang", "source", "other"], "left").select("lang", F.col("name").alias("source"), F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    small_batches(spark)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = parts.where("term is not null").select("lang", "source", F.col("term").alias("item"), "value")
    term = term.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= most)
    term = term.join(every, ["lang", "source"]).select("lang", F.col("name").alias("source"), F.lit("term").alias("part"), "item", "value", "rank")
    return pair.withColumn("rank", F.row_number().over(best).cast("int")).unionByName(term)
