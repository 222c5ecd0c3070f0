"""A Merkle manifest of a table: a leaf for each row, a tree for each group, a tree over the groups' roots, and proofs.

H is the lowercase hex SHA-256 of its inputs one after another, digests as hex text. A leaf is H of the row's fields, "-"
for null and otherwise the number of UTF-8 bytes, ":", the value. The leaves of a group ascend; every ARITY nodes in a
row become their H until one is left, the subroot; subroots, by group, become the root in the same way. How many children
a node has follows from the number of leaves of its tree alone.

The trees are built by events. Rows are sorted by ranges, so a task knows the place of each of its leaves; a child that
arrives is held by its partial parent under its index, and a parent that has all children that the tree's size gives it
emits its own digest, which is an event for its parent. What a task can't finish is its frontier, at most two runs of
children a level; frontiers are dealt again by blocks of the tree, ever larger ones, until only roots are left. In each
round a node keeps the reverse link to the node above which its block can't go, with the siblings on the way; joined from
the root down, these are the proofs. A task holds one range of rows, or the nodes of one block; the driver holds a few
numbers for each range.

Equal places (rows of one doc_id in a group) follow each other by leaf; equal leaves each have a proof of their own. A null
group is the first group, a null doc_id the first of its group and never tampered with. An empty table gives an empty
result. Only the columns of FIELDS are read; other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import durable

ARITY = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Ranges of leaves that a first block of frontiers covers, and levels that each later block rises.
COVER, RISE = 64, 10
#: A step of a proof is one byte for the siblings on the left of the path, one for all siblings, then their digests.
DIGEST = 32
NODE = "tree long, n long, level int, at long, digest binary"


def combined(digests: list[bytes]) -> bytes:
    """H of nodes; digests are held as bytes and hashed as hex text."""
    return sha256("".join(x.hex() for x in digests).encode()).digest()


def sizes(n: int, arity: int) -> list[int]:
    """Nodes on each level of a tree of n leaves, down to 1."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


class Combiner:
    """The partial parents of one tree: children gather under their index, a complete parent is an event for its own."""

    def __init__(self, n: int, arity: int, top: int | None = None):
        self.sizes, self.arity = sizes(n, arity), arity
        self.top = len(self.sizes) - 1 if top is None else min(top, len(self.sizes) - 1)
        self.partial: dict[tuple[int, int], dict[int, bytes]] = {}
        self.parents: dict[tuple[int, int], tuple[bytes, ...]] = {}  # children of complete parents
        self.rest: dict[tuple[int, int], bytes] = {}

    def add(self, level: int, at: int, digest: bytes) -> None:
        while level < self.top:
            key = (level + 1, at // self.arity)
            held = self.partial.setdefault(key, {})
            held[at % self.arity] = digest
            if len(held) < min(self.arity, self.sizes[level] - self.arity * key[1]):
                return
            self.parents[key] = tuple(held[i] for i in range(len(held)))
            del self.partial[key]
            digest, (level, at) = combined(list(self.parents[key])), key
        self.rest[level, at] = digest

    def frontier(self) -> list[tuple[int, int, bytes]]:
        """(level, at, digest) of the nodes that have no parent yet."""
        found = [(level - 1, at * self.arity + i, d) for (level, at), held in self.partial.items() for i, d in held.items()]
        return found + [(level, at, d) for (level, at), d in self.rest.items()]

    def path(self, level: int, at: int) -> tuple[bytes, int, int]:
        """(steps of the proof, level and place of the node it ends at) from a node as far up as parents are known."""
        steps = bytearray()
        while (key := (level + 1, at // self.arity)) in self.parents:
            children, own = self.parents[key], at % self.arity
            steps += bytes((own, len(children) - 1)) + b"".join(children[:own] + children[own + 1 :])
            level, at = key
        return bytes(steps), level, at


def steps_of(path: bytes) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """(siblings on the left, on the right) of each step."""
    i = 0
    while i < len(path):
        left, many = path[i], path[i + 1]
        found = [path[j : j + DIGEST] for j in range(i + 2, i + 2 + many * DIGEST, DIGEST)]
        yield found[:left], found[left:]
        i += 2 + many * DIGEST


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    for left, right in steps_of(path):
        leaf = combined([*left, leaf, *right])
    return leaf


def proof_digest(path: bytes) -> str:
    """H of all siblings, from the leaf's level to the root's, left to right."""
    return combined([x for left, right in steps_of(path) for x in left + right]).hex()


def leaf_of(fields: dict[str, Column]) -> Column:
    """The leaf digest, as bytes, of fields by name in the order of FIELDS."""
    parts = []
    for name in FIELDS:
        value = fields[name].cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


class Range(NamedTuple):
    """What a task must know to place its leaves: of its first tree the number, leaves before and all; leaves of its last tree."""

    tree: int
    before: int
    first_n: int
    last_n: int


def sorted_ranges(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, dict[int, Range], int]:
    """(rows sorted by group and order, with their range `part`; what each range must know; the number of groups)."""
    done = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("part", F.spark_partition_id())
    done = durable(done)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, first_n, last_n, groups = None, None, None, 0, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column("part")[0].as_py()
            runs = pc.run_end_encode(b.column(group))
            before = 0
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if not groups or value != last:
                    groups, last, last_n = groups + 1, value, 0
                    first = value if groups == 1 else first
                last_n += end - before
                first_n += (end - before) * (groups == 1)
                before = end
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "first": [first], "last": [last], "first_n": [first_n], "last_n": [last_n], "groups": [groups]}, pa.schema([("part", pa.int32()), ("first", kind), ("last", kind), *[(c, pa.int64()) for c in ("first_n", "last_n", "groups")]]))

    kind = pa.string()
    said = sorted(done.select("part", group).mapInArrow(ends, "part int, first string, last string, first_n long, last_n long, groups long").collect())
    known: dict[int, Range] = {}
    tree, running, name = -1, 0, object()
    begun: list[list] = []  # of each range: part, first tree, leaves before, last tree
    totals: dict[int, int] = {}  # of trees that a range begins or ends with
    for r in said:
        going_on = r.first == name
        tree = tree if going_on else tree + 1
        begun.append([r.part, tree, running if going_on else 0, tree + r.groups - 1])
        totals[tree] = totals.get(tree, 0) + r.first_n if going_on else r.first_n
        tree += r.groups - 1
        if r.groups > 1:
            totals[tree] = r.last_n
        running, name = totals[tree], r.last
    for part, first, before, last in begun:
        known[part] = Range(first, before, totals[first], totals[last])
    return done, known, tree + 1


def trees_of(batch_groups: list, place: Range) -> Iterator[tuple[int, int, int, int, int]]:
    """(tree, leaves in all, place of the first, start, end) of each run of equal groups in a range's rows."""
    cuts = [0, *(i for i in range(1, len(batch_groups)) if batch_groups[i] != batch_groups[i - 1]), len(batch_groups)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        n = place.first_n if k == 0 else place.last_n if k == len(cuts) - 2 else b - a
        yield place.tree + k, n, place.before if k == 0 else 0, a, b


def local_trees(groups: list, leaves: list[bytes], place: Range, arity: int) -> Iterator[tuple[Combiner, int, int, int, int, int]]:
    for tree, n, before, a, b in trees_of(groups, place):
        c = Combiner(n, arity)
        for i in range(a, b):
            c.add(0, before + i - a, leaves[i])
        yield c, tree, n, before, a, b


def climbed(nodes: DataFrame, arity: int, cover: int) -> tuple[DataFrame, DataFrame]:
    """((tree, digest) of each tree's root; (tree, level, at, path) from each of the given nodes to its root).

    nodes: (tree, n, level, at, digest), the frontiers of trees of n leaves. A round combines the nodes of blocks of a tree
    that cover `cover` levels, then RISE more each time; after a round a block has one node."""
    links: list[DataFrame] = []

    def combine(top: int):
        def run(t: pa.Table) -> pa.Table:
            c = Combiner(t.column("n")[0].as_py(), arity, top)
            rows = list(zip(t.column("level").to_pylist(), t.column("at").to_pylist(), t.column("digest").to_pylist(), strict=True))
            for row in sorted(rows):
                c.add(*row)
            paths = [c.path(level, at) for level, at, _ in rows]
            ends = {(level, at): d for level, at, d in c.frontier()}
            assert all(p[1:] in ends for p in paths), "an incomplete block"
            found = [pa.array([p[0] for p in paths], pa.binary()), pa.array([p[1] for p in paths], pa.int32()), pa.array([p[2] for p in paths], pa.int64()), pa.array([ends[p[1:]] for p in paths], pa.binary())]
            return pa.table([*[t.column(c) for c in ("tree", "n", "level", "at")], *found], ["tree", "n", "level", "at", "steps", "up", "up_at", "up_digest"])

        return run

    top = cover
    height = len(sizes(nodes.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0], arity)) - 1
    while True:
        block = F.floor(F.col("at") / F.pow(F.lit(float(arity)), F.lit(top) - F.col("level"))).cast("long")
        done = nodes.groupBy("tree", block.alias("block")).applyInArrow(combine(top), "tree long, n long, level int, at long, steps binary, up int, up_at long, up_digest binary")
        done = durable(done)
        links.append(done)
        nodes = done.select("tree", "n", F.col("up").alias("level"), F.col("up_at").alias("at"), F.col("up_digest").alias("digest")).distinct()
        if top >= height:
            break
        top += RISE
    paths = links[-1].select("tree", "level", "at", F.col("steps").alias("path"))
    for link in links[-2::-1]:
        above = paths.select("tree", F.col("level").alias("up"), F.col("at").alias("up_at"), F.col("path").alias("rest"))
        paths = link.join(above, ["tree", "up", "up_at"]).select("tree", "level", "at", F.concat("steps", "rest").alias("path"))
    return nodes.select("tree", "digest"), paths


def manifest(docs: DataFrame, tampered: Column, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row, in a tree for each lang.

    tampered: rows whose n_chars is one more when they are verified."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")], F.col("n_chars").cast("long").alias("n_chars"), F.coalesce(tampered, F.lit(False)).alias("changed"))
    fields = {c: F.col(c) for c in FIELDS}
    slim = rows.select("lang", "doc_id", leaf_of(fields).alias("leaf"), F.when(F.col("changed"), leaf_of(fields | {"n_chars": F.col("n_chars") + 1})).alias("claim"))
    held, known, groups = sorted_ranges(slim, "lang", ["doc_id", "leaf"])
    if not groups:
        return held.select("doc_id", *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"))
    places = spark.sparkContext.broadcast(known)

    def frontiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := [b for b in batches if b.num_rows]):
            t = pa.Table.from_batches(found)
            part = t.column("part")[0].as_py()
            for c, tree, n, *_ in local_trees(t.column("lang").to_pylist(), t.column("leaf").to_pylist(), places.value[part], arity):
                out = c.frontier()
                yield pa.RecordBatch.from_pydict({"part": [part] * len(out), "tree": [tree] * len(out), "n": [n] * len(out), "level": [x[0] for x in out], "at": [x[1] for x in out], "digest": [x[2] for x in out]}, pa.schema([("part", pa.int32()), ("tree", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("digest", pa.binary())]))

    nodes = durable(held.select("part", "lang", "leaf").mapInArrow(frontiers, f"part int, {NODE}"))
    leaves = max(1, sum(r.last_n for r in known.values()) // max(1, len(known)))
    cover = max(RISE, len(sizes(COVER * leaves, arity)) - 1)
    subroots, lower = climbed(nodes.drop("part"), arity, cover)
    subroots = durable(subroots)
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(groups).cast("long").alias("n"), F.lit(0).alias("level"), F.col("tree").alias("at"), "digest")
    roots, upper = climbed(tops, arity, RISE)
    root = roots.first().digest
    ends = subroots.join(upper.select(F.col("at").alias("tree"), F.col("path").alias("rest")), "tree").select("tree", F.col("digest").alias("subroot"), "rest")
    paths = nodes.select("part", "tree", "level", "at").join(lower, ["tree", "level", "at"]).join(ends, "tree").select("part", "tree", "level", "at", "subroot", F.concat("path", "rest").alias("path"))

    def verify(one: pa.Table, two: pa.Table) -> pa.Table:
        above = {(tree, level, at): (subroot, path) for tree, level, at, subroot, path in zip(*[two.column(c).to_pylist() for c in ("tree", "level", "at", "subroot", "path")], strict=True)}
        order = pc.sort_indices(one, [("lang", "ascending"), ("doc_id", "ascending"), ("leaf", "ascending")], null_placement="at_start")
        one = one.take(order)
        leaves, claims = one.column("leaf").to_pylist(), one.column("claim").to_pylist()
        out: list[tuple] = []
        for c, tree, _, before, a, b in local_trees(one.column("lang").to_pylist(), leaves, places.value[one.column("part")[0].as_py()], arity):
            for i in range(a, b):
                steps, level, at = c.path(0, before + i - a)
                subroot, rest = above[tree, level, at]
                path = steps + rest
                back = folded(leaves[i] if claims[i] is None else claims[i], path)
                out.append((leaves[i].hex(), subroot.hex(), root.hex(), proof_digest(path), back.hex(), back == root))
        return pa.table([one.column("doc_id"), *[pa.array(x) for x in zip(*out, strict=True)]], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return held.groupBy("part").cogroup(paths.groupBy("part")).applyInArrow(verify, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
