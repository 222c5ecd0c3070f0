"""Merkle manifest, winnowing and source divergence against brute force, over nulls, ties, repeats, long texts, clashing columns and empty tables."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver.llm import divergence, merkle, queries, winnowing
from quaver.llm.common import crc_mod
from quaver.llm.words import mix

KINDS = "doc_id long, text string, lang string, source string, n_chars long, part int, at long, tree long, level int, leaf string, hash long, guest boolean, rank int, item string, docs int"
D = "/root/testdata/sf0.001"


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, n, 1, 2, 3, 4, "l", 5, True, 6, "i", 7) for i, t, lang, src, n in rows], KINDS)


@pytest.fixture(scope="module")
def odd():
    r = random.Random(3)
    word = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    rows = [(i, " ".join(word(3) for _ in range(r.randrange(60))), r.choice(["en", "fr", "de"]), r.choice("abcd"), r.choice([None, 5, 70])) for i in range(90)]
    rows += [(200, None, None, None, None), (201, "", "", "", 0), (202, "é" * 9000, None, "a", 9000), (203, "Ünï CODE-code Code9x", "x", "a", 20), (203, "Ünï CODE-code Code9x", "x", "a", 20), (203, "another text", "x", "b", 3)]
    rows += [(None, "a b c", "en", "a", 5), (None, "some other", "en", "q", 5), (None, None, "en", None, None), (-(1 << 63), "least", "en", "a", 1), (205, " ".join(word(5) for _ in range(20000)), "en", "a", 1)]
    return rows + [(300 + i, "the same text of many rows, again and again and again " * 3, "en", "a", 1) for i in range(30)]


def plain_manifest(rows, arity=2):
    h = lambda *x: sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k : k + arity]) for k in range(0, len(levels[-1]), arity)])
        return levels

    def siblings(levels, k):
        for level in levels[:-1]:
            run = level[k - k % arity : k - k % arity + arity]
            yield run[: k % arity], run[k % arity + 1 :]
            k //= arity

    groups = defaultdict(list)
    for i, t, lang, src, n in rows:
        odd = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        groups[lang].append((i is not None, i, h(*map(field, (i, src, lang, n, t))), h(*map(field, (i, src, lang, n + 1 if odd else n, t)))))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in groups[g]]) for g in names if groups[g].sort(key=lambda x: (x[0], x[1] or 0, x[2])) is None}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for j, (_, i, leaf, claim) in enumerate(groups[g]):
            steps = [*siblings(trees[g], j), *siblings(top, k)]
            node = claim
            for a, b in steps:
                node = h(*a, node, *b)
            out.append((i, leaf, trees[g][-1][0], top[-1][0], h(*[x for a, b in steps for x in a + b]), node, node == top[-1][0]))
    return sorted(map(repr, out))


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest(spark, odd, arity):
    got = merkle.manifest(make(spark, odd).repartition(5), crc_mod(F.col("doc_id"), 7) == 0, arity)
    rows = got.collect()
    assert sorted(repr(tuple(r)) for r in rows) == plain_manifest(odd, arity)
    assert 0 < sum(not r.verified for r in rows) < len(rows)


def test_manifest_of_few_rows(spark, odd):
    for some in (odd[:1], odd[:2], [x for x in odd if x[2] == "x"], []):
        got = merkle.manifest(make(spark, some), crc_mod(F.col("doc_id"), 7) == 0)
        assert sorted(repr(tuple(r)) for r in got.collect()) == plain_manifest(some) if some else got.count() == 0


def test_frontiers_climb_in_several_rounds(spark, odd, monkeypatch):
    """Small blocks and many ranges, so that nodes of all levels meet over many rounds."""
    monkeypatch.setattr(merkle, "RISE", 1)
    monkeypatch.setattr(merkle, "COVER", 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = merkle.manifest(make(spark, odd), crc_mod(F.col("doc_id"), 7) == 0)
        assert sorted(repr(tuple(r)) for r in got.collect()) == plain_manifest(odd)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_partial_parents_wait_for_all_children():
    c = merkle.Combiner(5, 2)
    for at in (3, 0, 4):
        c.add(0, at, bytes([at]) * 32)
    assert {x[:2] for x in c.frontier()} == {(0, 0), (0, 3), (2, 1)}  # the fifth leaf is alone: its ancestors have one child
    c.add(0, 1, b"\1" * 32)
    c.add(0, 2, b"\2" * 32)
    (level, at, root), = c.frontier()
    assert (level, at) == (3, 0) and all(merkle.folded(bytes([k]) * 32, c.path(0, k)[0]) == root for k in range(5))


def plain_winnow(text, gram=winnowing.GRAM, window=winnowing.WINDOW):
    """(hash, place) pairs, from the definition."""
    cps = [int(x) for x in mix(np.array([ord(c) for c in text], np.uint64))]
    poly = lambda x: sum(c * pow(int(winnowing.BASE), len(x) - 1 - j, 1 << 64) for j, c in enumerate(x)) % (1 << 64)
    last = lambda x: int(mix(np.array([x], np.uint64))[0])
    if not cps:
        return []
    if len(cps) < gram:
        return [(last(last(poly(cps)) >> 1 ^ len(cps)) >> 1, 0)]
    h = [last(poly(cps[i : i + gram])) >> 1 for i in range(len(cps) - gram + 1)]
    out = []
    for i in range(max(1, len(h) - window + 1)):
        some = h[i : i + window]
        at = i + max(j for j, x in enumerate(some) if x == min(some))
        if (h[at], at) not in out[-1:]:
            out.append((h[at], at))
    return out


@pytest.mark.parametrize(("gram", "window"), [(winnowing.GRAM, winnowing.WINDOW), (3, 4), (1, 1), (7, 1)])
def test_winnowing(spark, odd, gram, window):
    some = [x for x in odd if len(x[1] or "") < 3000] + [(400, "ab" * 300, "", "", 0), (401, "x" * 19, "", "", 0), (402, "x" * 20, "", "", 0), (403, "\U0001f600" * 70, "", "", 0)]
    got = [(r.doc_id, list(zip(r.hashes, r.places, strict=True))) for r in winnowing.fingerprints(make(spark, some), gram, window).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, plain_winnow(t or "", gram, window))) for i, t, *_ in some)


def test_common_stretches_share_a_hash():
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    for _ in range(200):
        common = text(winnowing.GRAM + winnowing.WINDOW - 1)
        one, two = (winnowing.winnowed(*winnowing.points_of([text(r.randrange(90)) + common + text(r.randrange(90))])) for _ in range(2))
        assert set(one.hashes.tolist()) & set(two.hashes.tolist())


def test_edits(spark, odd):
    docs = make(spark, odd).repartition(6)
    h = {r.text: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((-(1 << 63) if i is None else i, h[t or ""], i is not None, i, t or "") for i, t, *_ in odd), key=lambda x: x[:2])
    want = []
    for k, (*_, i, t) in enumerate(order):
        other = order[k - 1][-1]
        edited = t[: len(t) - len(t) // 3] + other[: len(t) // 3]
        mine, theirs, nexts = ({x for x, _ in plain_winnow(y)} for y in (t[:4000], edited[:4000], other[:4000]))
        near = lambda a, b: round(len(a & b) / len(a | b), 9) if a | b else 1.0
        want.append((i, len(t), sha256(edited.encode()).hexdigest(), *((near(mine, theirs), near(mine, nexts)) if len(t) < 4000 and len(other) < 4000 else ())))
    got = winnowing.compare(docs).collect()
    long = {i for _, _, _, i, t in order if len(t) > 4000}
    rows = [(r.doc_id, r.n_chars, r.edited_sha256, *((round(r.near_edited, 9), round(r.near_next, 9)) if len(w) > 3 else ())) for r, w in zip(sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.edited_sha256)), sorted(want, key=lambda w: (w[0] is not None, w[0] or 0, w[2])), strict=True)]
    assert sorted(map(repr, rows)) == sorted(map(repr, want)) and long
    texts = {i: t for _, _, _, i, t in order}
    prints = {}
    for r in got:
        if r.doc_id is not None and r.doc_id != 203:
            assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)
    assert winnowing.compare(docs.limit(0)).count() == 0
    alone = winnowing.compare(docs.where("doc_id = 205")).first()
    assert alone.near_next == 1


def test_hot_id_is_split(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    parts = winnowing.neighbours(docs)
    assert parts.groupBy("part").count().agg(F.max("count")).first()[0] < 400
    got = winnowing.compare(docs).collect()
    assert len(got) == 3000


def plain_audit(rows, least=3, most=200):
    docs = [(lang or "", src or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, lang, src, _ in rows]
    out = []
    for lang in {x[0] for x in docs}:
        df = Counter(t for name, _, words in docs if name == lang for t in set(words))
        kept = [t for t, c in df.items() if c >= least]
        counts = defaultdict(Counter)
        for name, src, words in docs:
            if name == lang:
                counts[src].update(w for w in words if df[w] >= least)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        f = lambda p, q: (p - q) * (p - q) // q
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, k) for k, (t, v) in enumerate(found, 1) if part == "pair" or k <= most]
    return sorted(map(repr, out))


@pytest.mark.parametrize("most", [3, 200])
def test_audit(spark, odd, most, monkeypatch):
    got = divergence.audit(make(spark, odd).repartition(4), 3, most)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_audit(odd, 3, most)


def test_audit_in_small_pieces(spark, odd, monkeypatch):
    """Blocks of two sources, chunks of five terms, tries that are handed on at every slice."""
    for name, value in (("BLOCK", 2), ("CHUNK", 5), ("MAX_LEAVES", 10)):
        monkeypatch.setattr(divergence, name, value)
    assert sorted(repr(tuple(r)) for r in divergence.audit(make(spark, odd)).collect()) == plain_audit(odd)
    assert divergence.audit(make(spark, odd).limit(0)).count() == 0
    few = [(1, "one two", "en", "a", 1), (2, "one", "en", "b", 1)]  # no term is kept
    assert sorted(tuple(r) for r in divergence.audit(make(spark, few)).collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact():
    r = random.Random(2)
    for _ in range(2000):
        total = r.randrange(1, 1 << 53)
        c = r.randrange(total)
        assert int(divergence.shares(np.array([c]), np.array([total]))[0]) == 1 + 10**9 * (c + 1) // total


def test_trie():
    r = random.Random(4)
    trie, want = divergence.Trie(), {}
    for _ in range(3000):
        term = "".join(r.choice("abé") for _ in range(r.randrange(1, 7))).encode()
        trie.add(term, [(1, 1)])
        want[term] = want.get(term, 0) + 1
    assert [(t, leaf[1]) for t, leaf in trie.walk()] == sorted(want.items()) and trie.leaves == len(want)


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_source_divergence"])
def test_sql(spark, name):
    sql = {"op11_merkle_manifest": queries.OP11_SQL, "op13_source_divergence": queries.OP13_SQL}[name]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    found = con.sql(sql)
    got = getattr(queries, name)(spark, D)
    assert set(got.columns) == set(found.columns)
    assert sorted(repr(tuple(r)) for r in got.select(*found.columns).collect()) == sorted(map(repr, found.fetchall()))


def test_op12_on_the_sample(spark):
    rows = {r.doc_id: r for r in queries.op12_winnowing_fingerprints(spark, D).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        t, other = texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 3] + other[: len(t) // 3]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == sha256(edited.encode()).hexdigest()
        if len(t) > 2000:
            assert rows[i].near_edited > max(0.2, rows[i].near_next - 0.5)
    long = [r for r in rows.values() if r.n_chars > 2000]
    assert sum(r.near_edited for r in long) / len(long) > 0.45 and sum(r.near_next < 0.02 for r in long) > 0.8 * len(long)
