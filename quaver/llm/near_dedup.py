"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full sets and distributed union-find.

A document's set holds the hashes of its distinct five-word shingles (quaver.llm.words). Documents with equal sets form
a class; from there on only classes are compared, so exact copies cost one row each. A class has a SuperMinHash
signature of REGISTERS values: every element draws one place of a random permutation after another, with growing
ranks, and the draws stop as soon as no register can fall any more. Signatures are cut into BANDS bands; a pair at
similarity 0.75 misses all of them with probability under 1e-5.

Links are found in two rounds, neither of which lists the pairs inside a bucket:
1. every class is paired with the least class of each of its buckets; connected classes are joined;
2. buckets that still hold several components are cut into tiles of bounded size; a tile confirms pairs of classes
   of different components, each pair in its first common bucket only, and skips what it has connected by then.
A pair whose signatures agree in far fewer registers than 0.75 of them (six standard deviations) is left out; all others
are confirmed on the full shingle sets of the two texts. Components are found by alternating large-star and small-star
steps over checkpointed edges.

Null texts and texts without words have the empty set, n_shingles 0 and are linked with nothing. Repeated rows are
linked with each other and each returned. Rows have numbers of their own: a null or repeated doc_id neither hides a link
nor makes one. The component_id is the least doc_id among all rows of a component, null where none has one; a null
doc_id equals a null component_id. Only doc_id and text are read; other columns can't clash. An empty table gives an
empty result.

Joins of documents or buckets by class, bucket or component split hot keys (quaver.llm.common.split_join), so that a large
group of copies is dealt over all tasks. Joins of edges, of which a class has few, are left to Spark's skew join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import durable, hot_keys, marked, ragged, slices, small_batches, split_join, utf8
from quaver.llm.words import mix, shingles, words

REGISTERS, BANDS = 128, 32
BAND_BYTES = 2 * REGISTERS // BANDS
#: A link needs this share of common shingles among all: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: Registers that must agree; 0.75 * 128 less six standard deviations.
LEAST_EQUAL = 66
#: Members tested in one group against one leader; a larger group is split.
GROUP_ROWS = 256
#: Edges that a task reads in a step of the union-find, so that few edges are not dealt over as many tasks as texts are.
EDGE_ROWS = 8192
#: Classes in a block of a bucket; a task holds the sets of two blocks.
TILE_ROWS = 256

_U = np.uint64


def superminhash(doc: np.ndarray, h: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """Signatures [n, m] (uint16) of the sets given as (doc, element hash) pairs, doc rising."""
    full = np.full((n, m), np.iinfo(np.uint64).max, np.uint64)
    flat = full.reshape(-1)
    perm: np.ndarray | None = None
    for j in range(m):
        if not len(h):
            break
        u = mix(h ^ _U(0x51ED270B * (j + 1)))
        k = j + ((u & _U(0xFFFFFFFF)) * _U(m - j) >> _U(32)).astype(np.int64)
        value = (u >> _U(32)) | _U(j << 32)
        if perm is None:
            np.minimum.at(flat, doc * m + k, value)
        else:
            row = np.arange(len(h))
            place = perm[row, k]
            perm[row, k] = perm[:, j]
            perm[:, j] = place
            np.minimum.at(flat, doc * m + place, value)
        live = (full.max(1) >> _U(32)) > _U(j)  # early stop: ranks beyond j + 1 can't lower a register
        keep = live[doc]
        if perm is None:
            doc, h, k = doc[keep], h[keep], k[keep]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(h), 1))
            row = np.arange(len(h))
            perm[row, k], perm[:, 0] = perm[:, 0], k
        elif not keep.all():
            doc, h, perm = doc[keep], h[keep], perm[keep]
    return (mix(full) >> _U(48)).astype(np.uint16)


def set_ids(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 64-bit name) of each set."""
    size = np.bincount(doc, minlength=n)
    sums = np.zeros(n, np.uint64)
    has = np.flatnonzero(size)
    if len(has):
        with np.errstate(over="ignore"):
            sums[has] = np.add.reduceat(mix(h ^ _U(0xA5A5A5A5)), (np.cumsum(size) - size)[has])
    with np.errstate(over="ignore"):
        return size, mix(sums ^ mix(size.astype(np.uint64))).view(np.int64)


def alike_sets(one: np.ndarray | None, two: np.ndarray | None) -> bool:
    """Whether two sorted sets are linked."""
    if one is None or two is None:
        return False
    both = int((one[np.minimum(np.searchsorted(one, two), len(one) - 1)] == two).sum())
    return 100 * both >= SIMILARITY * (len(one) + len(two) - both)


def signed(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, n (set size), cls (name of the set) and signature of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            doc, h = shingles(words(*utf8(b.column("text"))))
            size, cls = set_ids(doc, h, b.num_rows)
            sig = superminhash(doc, h, b.num_rows)
            sig = pa.array([x.tobytes() if k else None for x, k in zip(sig, size, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*map(b.column, ("row", "doc_id", "text_hash")), pa.array(size), pa.array(cls), sig], ["row", "doc_id", "text_hash", "n", "cls", "sig"])

    return docs.mapInArrow(run, "row long, doc_id long, text_hash long, n long, cls long, sig binary")


def alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least LEAST_EQUAL registers and whose set sizes allow the link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("sa", "sb"))
            yield b.filter(pa.array((one == two).sum(1) >= LEAST_EQUAL)).select(["a", "b"])

    one = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    sized = pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb"))
    return sized.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def texts_of(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """asked with the text of each row; only texts that may be asked for are shuffled."""
    some = marked(docs.select("row", "text"), F.col("row"), asked.select("row"), "_asked").where("_asked").drop("_asked")
    return some.join(asked, "row")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets. Texts are sent once to each group of pairs with the same b."""
    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("parts"))
    rows = pairs.join(groups, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    asked = rows.select("b", "part", F.col("a").alias("cls"), F.lit(1).alias("kind"))
    leaders = rows.select("b", "part").distinct().select("b", "part", F.col("b").alias("cls"), F.lit(0).alias("kind"))
    asked = asked.unionByName(leaders).join(classes.select("cls", "row"), "cls")
    asked = durable(asked)
    sent = texts_of(asked, docs).select("b", "part", "kind", "cls", "text").repartition("b", "part").sortWithinPartitions("b", "part", "kind", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, mine = None, np.zeros(0, np.uint64)
        for b in slices(batches, "text"):
            doc, h = shingles(words(*utf8(b.column("text"))))
            _, cls = set_ids(doc, h, b.num_rows)
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            found = []
            to, part, want = (b.column(c).to_pylist() for c in ("b", "part", "cls"))
            for i, (k, c) in enumerate(zip(b.column("kind").to_pylist(), cls.tolist(), strict=True)):
                if c != want[i]:
                    continue  # another text
                own = h[cut[i] : cut[i + 1]]
                if not k:
                    lead, mine = (to[i], part[i]), own
                elif lead == (to[i], part[i]):
                    if alike_sets(mine, own):
                        found.append((want[i], to[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return sent.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(cls, comp) of every class in an edge (a, b): comp is the least class of its component."""

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def few(e: DataFrame, n: int) -> DataFrame:
        return e.coalesce(max(1, -(-n // EDGE_ROWS)))

    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(edges)
    while seen[0]:
        edges = few(edges, seen[0])
        two = both(edges)
        least = two.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = two.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = durable(small.where("a <> b").distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    tops = edges.select(F.col("b").alias("cls")).distinct().select("cls", F.col("cls").alias("comp"))
    return durable(edges.select(F.col("a").alias("cls"), F.col("b").alias("comp")).unionByName(tops))


def buckets(classes: DataFrame) -> DataFrame:
    """(key, band, cls) of all bands."""
    keys = [F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.substring("sig", i * BAND_BYTES + 1, BAND_BYTES)).alias("key")) for i in range(BANDS)]
    return classes.select("cls", F.explode(F.array(*keys)).alias("x")).select("x.key", "x.band", "cls")


TILE = ["key", "one", "two"]


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile in batches that hold whole tiles."""

    def joined(held: list) -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def name(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(c)[i].as_py() for c in TILE)

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        same = np.logical_and.reduce([b.column(c).to_numpy() == b.column(c)[-1].as_py() for c in TILE])
        start = int(same.argmax())
        if start:
            yield joined([*held, b.slice(0, start)])
            held = [b.slice(start)]
        elif held and name(held[-1], -1) != name(b, 0):
            yield joined(held)
            held = [b]
        else:
            held.append(b)
    if held:
        yield joined(held)


def crossing(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, tile of each row): rows of a tile and of different components that are alike by signature, in their first equal band."""
    tile = np.cumsum(np.append(0, np.logical_or.reduce([np.diff(b.column(c).to_numpy()) != 0 for c in TILE])))
    comp, cls, home, band = (b.column(c).to_numpy() for c in ("comp", "cls", "home", "band"))
    inner = (b.column("one").to_numpy() == b.column("two").to_numpy())
    sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(b.num_rows, -1)
    row = np.arange(b.num_rows)
    more = np.searchsorted(tile, tile, "right") - row - 1
    out = []
    at = 0
    while at < b.num_rows:  # about a million pairs at once
        to = max(at + 1, int(np.searchsorted(np.cumsum(more[at:]), 1 << 20, "right")) + at)
        i, j = np.repeat(row[at:to], more[at:to]), ragged(row[at:to] + 1, more[at:to])
        ok = (comp[i] != comp[j]) & (cls[i] != cls[j]) & (inner[i] | (home[i] != home[j]))
        i, j = i[ok], j[ok]
        for lo in range(0, len(i), 1 << 15):
            x, y = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
            same = sig[x] == sig[y]
            first = same.reshape(len(x), BANDS, -1).all(2).argmax(1)
            ok = (same.sum(1) >= LEAST_EQUAL) & (first == band[x])
            out.append((x[ok], y[ok]))
        at = to
    i, j = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
    return i, j, tile


def rest(shared: DataFrame, hot: list, comp: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between components that share a bucket; none between the same two components of a tile twice.

    A bucket is cut into blocks of about TILE_ROWS classes, and every two blocks are a tile. Tiles first tell, by
    signature, which of their classes have a possible partner outside their component; the texts of those are sent to
    the tile, which confirms pairs and skips those that are connected by then.
    """
    here = shared.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    sizes = here.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    here = split_join(here, sizes.select("key", F.ceil(F.col("c") / TILE_ROWS).cast("int").alias("blocks")), "key", hot)
    here = here.withColumn("home", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    spread = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("home", x).alias("one"), F.greatest("home", x).alias("two")))
    here = here.select("key", "band", "cls", "comp", "home", F.explode(spread).alias("t")).select("key", "t.one", "t.two", "band", "cls", "comp", "home")
    here = here.join(classes.select("cls", "sig", "row"), "cls")
    schema = "key long, one int, two int, band int, cls long, comp long, home int, sig binary, row long"

    def by_tile(rows: DataFrame) -> DataFrame:
        return rows.repartition(*TILE).sortWithinPartitions(*TILE, "cls")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tiles(batches):
            i, j, _ = crossing(b)
            yield b.take(pa.array(np.union1d(i, j)))

    asked = durable(by_tile(here.select(*[x.split()[0] for x in schema.split(", ")])).mapInArrow(wanted, schema))
    sent = by_tile(texts_of(asked, docs))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tiles(batches):
            sets = []
            for part in slices(iter([b]), "text"):
                doc, h = shingles(words(*utf8(part.column("text"))))
                _, got = set_ids(doc, h, part.num_rows)
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                sets += [h[cut[k] : cut[k + 1]] if right else None for k, right in enumerate(got == part.column("cls").to_numpy())]
            i, j, tile = crossing(b)
            _, top = np.unique(np.stack([tile, b.column("comp").to_numpy()]), axis=1, return_inverse=True)
            up, top = list(range(b.num_rows)), top.reshape(-1).tolist()

            def find(x: int) -> int:
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            found = []
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                a, c = find(top[x]), find(top[y])
                if a != c and alike_sets(sets[x], sets[y]):
                    up[a] = c
                    found.append((x, y))
            cls = b.column("cls")
            yield pa.RecordBatch.from_arrays([cls.take(pa.array([f[k] for f in found], pa.int64())) for k in (0, 1)], ["a", "b"])

    return sent.mapInArrow(confirm, "a long, b long")


def links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cls, comp) of the classes that are linked with another class."""
    rows = buckets(classes)
    first = durable(rows.groupBy("key").agg(F.count("*").alias("count"), F.min("cls").alias("b")).where("count > 1"))
    hot = hot_keys(first, "key", BANDS * classes.count())
    shared = durable(split_join(rows, first.select("key", "b"), "key", hot).select("key", "band", "cls", "b"))
    pairs = durable(shared.where("cls <> b").select(F.col("cls").alias("a"), "b").distinct())
    pairs = durable(alike(pairs, classes))
    edges = durable(confirmed(pairs, classes, docs))
    more = durable(rest(shared.select("key", "band", "cls"), hot, components(edges), classes, docs))
    return components(edges.unionByName(more))


def classified(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, n, cls and comp (null without words) of all documents (row, doc_id, text)."""
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    docs = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = durable(signed(docs))
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("n").alias("n"), F.min_by("sig", "row").alias("sig"), F.min("row").alias("row"), F.count("*").alias("count"))
    classes = durable(classes)
    comp = classes.select("cls").join(links(classes, docs), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    rows = rows.drop("sig")
    return durable(split_join(rows.where("n > 0"), comp, "cls", hot_keys(classes, "cls", rows.count())).unionByName(rows.where("n = 0").withColumn("comp", F.lit(None).cast("long"))))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written with a number for each row, and the name of that column, which docs doesn't have."""
    name = "_row"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return durable(docs.withColumn(name, F.monotonically_increasing_id())), name


def group(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs, row = numbered(docs.select("doc_id", "text"))
    found = classified(docs.select(F.col(row).alias("row"), "doc_id", "text"))
    least = durable(found.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("count")))
    linked = split_join(found.where("n > 0"), least.drop("count"), "comp", hot_keys(least, "comp", found.count()))
    alone = found.where("n = 0").withColumn("component_id", F.col("doc_id"))
    rows = linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, that with the least doc_id (null is last), all columns kept.

    Of one doc_id in one group, the row whose set and text have the least hashes stays. Texts without words are copies
    only of those with the same doc_id. Only rows that may go are looked up; all others pass through.
    """
    columns = docs.columns
    docs, row = numbered(docs)
    found = classified(docs.select(F.col(row).alias("row"), "doc_id", "text")).where("n > 0 or doc_id is not null")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls", "text_hash", "row")
    first = found.where("n > 0").groupBy("comp").agg(F.min(order).alias("f")).select("f.row")
    first = first.unionByName(found.where("n = 0").groupBy("doc_id").agg(F.min("row").alias("row")).select("row"))
    gone = durable(found.select("row").join(first, "row", "left_anti").withColumnRenamed("row", row))
    rows = marked(docs, F.col(row), gone, f"{row}doubt")
    doubtful = rows.where(f"`{row}doubt`").join(gone, row, "left_anti")
    return rows.where(f"not `{row}doubt`").select(columns).unionByName(doubtful.select(columns))
