"""Operators of quaver.llm against brute force, and over nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import itertools
import json
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quaver.llm import chat, common, decontamination, html_wrappers, language_id, near_dedup, packing, sharding, suffix_tree, token_counts, top_k
from quaver.llm.common import crc_mod

BPE = public_tokenizers.path("word_bpe_49k.json")
KINDS = "doc_id long, text string, lang string, source string, key string, row long, part int, n int, cls string, at long, halo string, shard string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, "k", 1, 2, 3, "c", 4, "h", "s") for i, t, lang, src in rows], KINDS)


@pytest.fixture(scope="module")
def odd():
    r = random.Random(1)
    word = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    base = " ".join(word(5) for _ in range(80))
    near = base.split()
    near[40] = "changed"
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, None, None, None), (5, "", "fr", "a"), (6, " \n\t ", "fr", "a"), (7, "1234 5678", "fr", "b"), (8, "two words", "fr", "b"), (8, "two words", "fr", "b"), (9, "é" * 5000, "fr", None), (10, " ".join(word(4) for _ in range(6000)), "fr", "a"), (11, "<|endoftext|> Σ ΑΣ don't", "en", "a")]
    return rows + [(100 + i, " ".join(word(4) for _ in range(30)), "en" if i % 2 else "fr", "a") for i in range(30)]


def test_suffix_tree(spark, odd):
    held = crc_mod(F.col("doc_id"), 10) == 0
    got = suffix_tree.score(make(spark, odd), held).collect()
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    tokens = [([x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate(low)) if x] + [None], zlib.crc32(str(i).encode()) % 10 == 0, i) for i, t, _, _ in odd]
    counts: dict = {}
    for words, out, _ in tokens:
        for w in words if not out else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, len(w), sum(x in counts for x in w), n, round(sum(np.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for w, _, i in tokens)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert suffix_tree.score(make(spark, odd).limit(0), held).count() == 0


def test_suffix_tree_is_a_distribution(spark):
    rows = make(spark, [(i, "a b c d " * 40 + "x y " * (i % 3), "en", "s") for i in range(60)])
    docs = rows.select("doc_id", "text")
    counts = suffix_tree.counted(docs, lambda c: suffix_tree.tokens(c)[0])
    m = suffix_tree.learn(docs, counts)
    assert len(m.levels) == suffix_tree.DEPTH and m.levels[0].count()
    for rows in m.levels:
        for r in rows.groupBy("a").agg(F.sum(F.col("p") - F.col("rest") * F.col("below")).alias("stored"), F.first("rest").alias("rest")).collect():
            assert r.stored + r.rest == pytest.approx(1)


def test_packing(spark, odd):
    rows = packing.pack(make(spark, odd), BPE, window=256).collect()
    t = Tokenizer.from_file(BPE)
    ids = {}
    for i, text, _, _ in odd:
        ids.setdefault(i, []).append(t.encode(text or "", add_special_tokens=False).ids + [2])
    assert sum(r.length for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for r in rows:
        assert zlib.crc32(np.array(ids[r.doc_id][0][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, pieces in sequences.items():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end & (end - 1) == 0 and end <= 256
    assert packing.pack(make(spark, odd).limit(0), BPE).count() == 0


def scheduled(totals, weights, window):
    """ids of each source in every full window, as the closed form has it."""
    plan = packing.Schedule(totals, weights, window)
    return np.diff(np.stack([plan.served(np.array([w]))[0] for w in range(plan.full + 1)]), axis=0)


def brute_windows(totals, weights, window):
    """Token by token: every id of a source has the credit at which it is earned; the windows take ids by rising credit."""
    order = sorted(((x + 0.5) / weights[s], s) for s in range(len(totals)) for x in range(totals[s]))
    out = []
    for w in range(sum(totals) // window):
        part = [s for _, s in order[w * window : (w + 1) * window]]
        out.append([part.count(s) for s in range(len(totals))])
    return np.array(out)


@pytest.mark.parametrize(("totals", "weights"), [([500, 300, 200], [0.5, 0.3, 0.2]), ([500, 300, 200], [0.2, 0.2, 0.6]), ([900, 7, 93], [0.1, 0.45, 0.45]), ([64, 64], [0.5, 0.5])])
def test_windows_are_those_of_a_plain_round_robin(totals, weights):
    assert (scheduled(totals, weights, 50) == brute_windows(totals, weights, 50)).all()


def window_shares(rows, window):
    out = {}
    for r in rows:
        if r.offset + r.length <= window:
            out.setdefault(r.sequence_id, {}).setdefault(r.source, 0)
            out[r.sequence_id][r.source] += r.length
    return {k: v for k, v in out.items() if sum(v.values()) == window}


def test_packing_holds_targets_until_a_source_is_dry(spark):
    r = random.Random(4)
    say = lambda k: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    docs = [(i, say(60), "en", "ab"[i % 2] if i % 5 else "c") for i in range(120)]
    rows = packing.pack(make(spark, docs), BPE, window=256, targets={"a": 0.25, "b": 0.25, "c": 0.5}).collect()
    shares = window_shares(rows, 256)
    total = {k: sum(x.length for x in rows if x.source == k) for k in "abc"}
    dry = int(total["c"] // 128)  # c, with half of each window, runs dry first
    for k in sorted(shares)[: dry - 1]:
        assert abs(shares[k]["c"] - 128) <= 2 and abs(shares[k]["a"] - 64) <= 2
    for k in sorted(shares)[dry + 1 :]:
        assert "c" not in shares[k] and abs(shares[k].get("a", 0) - shares[k].get("b", 0)) <= 256
    assert sum(total.values()) == sum(x.length for x in rows)


def test_packing_many_sources(spark):
    docs = spark.createDataFrame([(i, f"word{i} and some more of it", f"source {i}") for i in range(2000)], "doc_id long, text string, source string")
    rows = packing.pack(docs, BPE, window=256).collect()
    assert {(x.doc_id, x.source) for x in rows} == {(i, f"source {i}") for i in range(2000)}
    used = {}
    for x in rows:
        used.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for pieces in used.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end & (end - 1) == 0
    assert sum(len(set(p)) for p in used.values()) == len(rows)


def test_top_k(spark):
    r = np.random.default_rng(3)
    x = np.round(r.normal(0, 0.4, (300, 8)), 2)
    short = np.round(r.normal(0, 0.4, (12, 3)), 2)
    rows = [(i % 290, [float(v) for v in x[i]]) for i in range(300)] + [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (None, [0.5] * 8), (403, [])]
    rows += [(550 + i, [float(v) for v in short[i]]) for i in range(12)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k.search(table, F.col("vec_id") % 50 == 0, 5).collect()
    vectors = [(i, np.floor(np.array(v) * 256).astype(int)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for i, q in vectors:
        if i % 50 == 0:
            found = sorted((-int(q @ w), j) for j, w in vectors if j != i and len(w) == len(q))[:5]
            want += [(i, k + 1, v, -s) for k, (s, v) in enumerate(found)]
    assert sorted(tuple(g) for g in got) == sorted(want) and sum(g.query_id == 0 for g in got) == 10
    assert top_k.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_in_many_batches(spark, monkeypatch):
    x = np.round(np.random.default_rng(4).normal(0, 0.4, (200, 6)), 2)
    table = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(200)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, top_k.search(table, F.col("vec_id") % 10 == 0).collect()))
    monkeypatch.setattr(top_k, "MAX_QUERIES", 7)
    assert sorted(map(tuple, top_k.search(table, F.col("vec_id") % 10 == 0).collect())) == whole


def test_near_dedup(spark, odd):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.group(make(spark, odd)).collect()}
    assert {(1, 76, 1, True), (2, 76, 1, False), (3, 76, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True), (8, 1, 8, True)} <= got
    kept = [r.doc_id for r in near_dedup.keep_one(make(spark, odd)).collect()]
    assert sorted(kept) == sorted({i for i, *_ in odd} - {2, 3})
    assert near_dedup.group(make(spark, odd).limit(0)).count() == 0


def test_keep_one_decides_by_row(spark):
    r = random.Random(11)
    one, two, three, four = (" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(4))
    near = " ".join([*one.split()[:-1], "changed"])
    rows = [(None, two, 1), (None, three, 2), (None, near, 3), (None, "", 4), (None, None, 5), (5, one, 6), (5, four, 7), (5, four, 8), (9, near, 9), (7, None, 10), (7, "", 11)]
    rows += [(None, three, 12), (None, " ".join([*two.split()[:-1], "changed"]), 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at long")
    got = near_dedup.keep_one(docs)
    assert got.columns == docs.columns
    got = [(g.doc_id, g.text, g.at) for g in got.collect()]
    assert len(got) == 7 and sum(g[:2] == (5, four) for g in got) == 1 and sum(g[0] == 7 for g in got) == 1
    assert {4, 5, 6} <= {g[2] for g in got} and {2, 12} & {g[2] for g in got} and len({1, 13} & {g[2] for g in got}) == 1


def test_near_links_of_rows_without_id(spark):
    r = random.Random(13)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    near, other = " ".join([*text.split()[:-1], "changed"]), " ".join(reversed(text.split()))
    rows = [(1, text), (None, near), (None, other), (4, near), (4, other), (7, None), (None, None)]
    got = near_dedup.group(spark.createDataFrame(rows, "doc_id long, text string"))
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(g) for g in got.collect()), key=key) == sorted(
        [(1, 76, 1, True), (None, 76, 1, False), (None, 76, 4, False), (4, 76, 1, False), (4, 76, 4, True), (7, 0, 7, True), (None, 0, None, True)], key=key
    )


def test_keep_one_with_clashing_columns(spark):
    r = random.Random(14)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    docs = spark.createDataFrame([(1, text, 5, "x"), (2, text, 6, "y"), (3, None, 7, "z")], "doc_id long, text string, _row int, _row_doubt string")
    got = near_dedup.keep_one(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, text, 5, "x"), (3, None, 7, "z")]


def test_hot_keys_change_no_component(spark, monkeypatch):
    """The same components whether no key counts as hot or nearly every one does."""
    r = random.Random(15)
    docs = []
    for g in range(6):
        base = ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(60)]
        for i in range(10):
            w = list(base)
            w[r.randrange(60)] = f"z{r.randrange(3)}"
            docs.append((len(docs), " ".join(w), "en", "a"))
    group = lambda: sorted(map(tuple, near_dedup.group(make(spark, docs)).collect()))
    monkeypatch.setattr(common, "HOT_SHARE", 2.0)
    cool = group()
    monkeypatch.setattr(common, "HOT_SHARE", 1e-9)
    assert group() == cool and len({c[2] for c in cool}) < len(docs)


def test_near_dedup_brute_force(spark):
    r = random.Random(7)
    docs = []
    for g in range(12):
        base = ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(r.choice([30, 60, 200]))]
        for _ in range(8):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 20))):
                w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
            docs.append((len(docs), " ".join(w), "en", "a"))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t, _, _ in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    got = {r.doc_id: r.component_id for r in near_dedup.group(make(spark, docs)).collect()}
    assert got == {i: find(i) for i in range(len(docs))}


def test_language(spark, odd):
    none = language_id.predict(make(spark, odd).limit(0), F.lit(False))
    assert none.count() == 0
    got = {r.doc_id: r for r in language_id.predict(make(spark, odd), crc_mod(F.col("doc_id"), 4) == 2).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6, 7))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_learns(spark):
    r = random.Random(5)
    say = {"xx": "aeiou", "yy": "bcdfg"}
    rows = [(i, " ".join("".join(r.choice(say[k]) for _ in range(5)) for _ in range(30)), k, "s") for i in range(80) for k in [("xx", "yy")[i % 2]]]
    held = F.col("doc_id") >= 60
    got = language_id.predict(make(spark, rows), held).where("held_out").collect()
    assert all(g.lang_pred == ("xx", "yy")[g.doc_id % 2] for g in got) and len(got) == 20


def test_stretches_are_the_network(monkeypatch):
    """Labels of the fast reading are those of a plain pass over each stretch, and the state runs on over words."""
    net = language_id.Network(["a", "b", "c"], 3)
    texts = [b"one two", b"", b"x" * 700 + b" and more words behind it " * 30, b" \n ", "\u00e9t\u00e9".encode() * 200]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = net.text_sums(data, offs)
    for text, sums in zip(texts, got, strict=True):
        want = np.zeros(3)
        for core in range(0, len(text), language_id.CORE):
            start, stop = max(0, core - language_id.MARGIN), min(len(text), core + language_id.CORE)
            x, mask = language_id.pad([text[start : min(len(text), stop + language_id.MARGIN)]])
            both = np.concatenate([net._pass(x, mask, d, False)[0] for d in "fb"], axis=2)
            e = np.exp(both @ net.p["V"] + net.p["c"])
            p = (e / e.sum(2, keepdims=True))[:, 0]
            want += sum((p[i - start] for i in range(core, stop) if text[i] not in b" \t\n\x0b\x0c\r"), np.zeros(3))
        assert sums == pytest.approx(want, rel=1e-3, abs=1e-4)
    one, other = (net.text_sums(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in (b"word next", b"next word"))
    assert np.abs(one - other).max() > 1e-3
    monkeypatch.setattr(language_id, "STRETCHES", 2)
    assert net.text_sums(data, offs) == pytest.approx(got, rel=1e-4)


def test_language_without_ids(spark):
    docs = spark.createDataFrame([(None, "abc abc", "xx"), (1, "abc", "xx"), (None, None, "yy"), (1, "abc", None)], "doc_id long, text string, lang string")
    got = [tuple(r)[:3] for r in language_id.predict(docs, F.col("doc_id") == 1).collect()]
    assert sorted(got, key=str) == sorted([(None, False, "xx"), (1, True, "xx"), (None, False, "und"), (1, True, "xx")], key=str)
    assert {c for c in language_id.keep_known(docs, F.lit(False), 0.3).columns} == {"doc_id", "text", "lang"}


def test_gradients():
    net = language_id.Network(["a", "b"], 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = language_id.pad([b"abc", b"de"])
    y = np.array([0, 1])
    _, grads = net.gradients(x, mask, y)
    for name, place in (("Uf", (0, 1)), ("Wb", (2, 3)), ("V", (1, 0)), ("E", (97, 0))):
        old, eps = net.p[name][place], 1e-3
        net.p[name][place] = old + eps
        up = net.gradients(x, mask, y)[0]
        net.p[name][place] = old - eps
        down = net.gradients(x, mask, y)[0]
        net.p[name][place] = old
        assert grads[name][place] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=1e-4)


def least_capacity(sizes, shards):
    """The smallest capacity by trying all cuts: the largest shard of several groups, over all contiguous partitions."""
    best = [[None] * (shards + 1) for _ in range(len(sizes) + 1)]
    best[0] = [0] * (shards + 1)
    for n in range(1, len(sizes) + 1):
        for k in range(1, shards + 1):
            found = [max(best[m][k - 1], 0 if n - m == 1 else sum(sizes[m:n])) for m in range(n) if best[m][k - 1] is not None]
            best[n][k] = min(found) if found else None
    return best[len(sizes)][shards]


def shards_of(sizes, starts):
    ends = [*starts, len(sizes)]
    return [sum(sizes[a:b]) for a, b in zip([0, *starts], ends, strict=True)], [b - a for a, b in zip([0, *starts], ends, strict=True)]


def test_cuts_are_minimax():
    r = random.Random(12)
    for _ in range(200):
        sizes = [r.choice([1, 2, 3, 5, 8, 40]) for _ in range(r.randrange(1, 14))]
        shards = r.randrange(1, 6)
        capacity, starts, _ = sharding.cuts(sizes, shards)
        totals, groups = shards_of(sizes, starts)
        assert len(totals) <= shards
        assert max(totals) <= capacity
        assert max((t for t, g in zip(totals, groups, strict=True) if g > 1), default=0) <= least_capacity(sizes, shards) or max(totals) < capacity


def test_capacity_is_the_least_of_all_partitions():
    """Against every way to cut a list into contiguous parts."""
    r = random.Random(12)
    assert sharding.cuts([100, 1, 1, 1, 1], 4)[0] == 100
    for _ in range(300):
        sizes = [r.choice([1, 2, 5, 9, 60]) * r.randrange(1, 4) for _ in range(r.randrange(1, 9))]
        shards = r.randrange(1, 6)
        ways = [c for k in range(min(shards, len(sizes))) for c in itertools.combinations(range(1, len(sizes)), k)]
        largest = lambda c: max(sum(sizes[a:b]) for a, b in itertools.pairwise([0, *c, len(sizes)]))
        capacity, starts, _ = sharding.cuts(sizes, shards)
        assert capacity == min(map(largest, ways))
        assert largest(starts) <= capacity and len(starts) < shards


def test_a_huge_group_leaves_the_others_even():
    r = random.Random(13)
    sizes = [r.randrange(20, 60) for _ in range(4000)]
    sizes[1700] = 80_000  # a third
    capacity, starts, _ = sharding.cuts(sizes, 40)
    totals = shards_of(sizes, starts)[0]
    assert capacity == 80_000 and len(totals) == 40 and max(totals) == 80_000
    rest = sorted(totals)[:-1]
    assert rest[-1] < 1.1 * rest[1]


def test_shards(spark, odd):
    r = random.Random(6)
    rows = [*odd, (None, "no id", "en", "a"), (None, "no id", "en", "a")] + [(1000 + i, "".join(r.choice("ab é") for _ in range(r.randrange(200))), "en", "a") for i in range(400)]
    rows += [(3000 + i, "many copies of one text " * 20, "en", "a") for i in range(150)]
    got = sharding.shard(make(spark, rows), 5).collect()
    assert len(got) == len(rows) and {g.law for g in got} == {"bytes"}
    want = sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert sorted((g.doc_id is None, g.doc_id or 0, g["size"], g.text_crc32) for g in got) == want
    slots, text = {}, dict((i, t or "") for i, t, _, _ in rows)
    home: dict = {}
    for g in got:
        slots.setdefault(g.shard, []).append(g.slot)
        home.setdefault(text[g.doc_id], set()).add(g.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    assert all(len(h) == 1 for h in home.values())
    assert sharding.shard(make(spark, odd).limit(0), 5).count() == 0


def test_shards_find_the_capacity_of_all_groups(spark, monkeypatch):
    """Starting from few, wide ranges of keys, the search ends with the capacity of a search over every single group."""
    r = random.Random(8)
    docs = spark.createDataFrame([(i, "".join(r.choice("abc ") for _ in range(r.choice([3, 30, 300])))) for i in range(1500)], "doc_id long, text string")
    groups = docs.select(F.xxhash64("text").alias("key"), (F.octet_length("text") + 16).cast("long").alias("size")).groupBy("key").agg(F.sum("size").alias("size")).orderBy("key").collect()
    sizes = [g["size"] for g in groups]
    capacity, starts, _ = sharding.cuts(sizes, 7)
    monkeypatch.setattr(sharding, "FIRST_BITS", 4)
    got = sharding.shard(docs, 7).groupBy("shard").agg(F.sum("size").alias("total")).orderBy("shard").collect()
    assert [g.total for g in got] == shards_of(sizes, starts)[0]
    assert max(g.total for g in got) <= capacity and min(g.total for g in got) > 0.9 * sum(sizes) / 7


def test_token_counts(spark, odd):
    t = Tokenizer.from_file(BPE)
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(make(spark, odd), BPE).collect())
    n = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _, _ in odd]
    assert got == sorted((*x, x[2] > 2048) for x in n)


def test_token_counts_of_long_words(spark):
    r = random.Random(9)
    texts = ["".join(r.choice("abcdefgh") for _ in range(60_000)), "a" * 100_001, "".join(r.choice("aab") for _ in range(3000)), "ab" * 5000 + " <|endoftext|>x<|endoftext|> é" + "é" * 3000, "z" * 1_000_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = Tokenizer.from_file(BPE)
    began = time.time()
    got = {g.doc_id: g.n_tokens for g in token_counts.count_tokens(docs, BPE).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert time.time() - began < 60
    assert token_counts.count_tokens(docs.limit(0), BPE).count() == 0


def test_token_counts_of_parts(monkeypatch):
    """Where a text is cut into parts makes no difference, nor does what a task remembers."""
    r = random.Random(10)
    text = " ".join("".join(r.choice("abcétœ'.,<|") for _ in range(r.randrange(1, 12))) for _ in range(3000))
    t, coder = Tokenizer.from_file(BPE), token_counts.Coder(token_counts.merges(BPE))
    want = t.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(token_counts, "PART_CHARS", 100)
    monkeypatch.setattr(token_counts, "MAX_PIECES", 50)
    for _ in range(2):
        assert coder.encode([text, None, ""])[0].tolist() == want


PAGE = "<html><head><title>t</title><script>var a='<p>';</script></head><body><nav><ul><li>menu</li></ul></nav><div class='cookie-notice'>We use</div>{}<div class='comments'><p>first!</p></div><footer>&copy; x</footer></body></html>"


def test_html(spark):
    body = "<article><h1>Title &amp; more</h1><p>one <b>two</b>\n three<br>four<p>five</p><aside>side</aside><ul><li>six<li>seven</ul><form>f</form></article>"
    plain = "<div id='content'><h2>Head</h2><p>long text of the page itself</p><p>and more text here</p></div>"
    rows = [(1, "http://a.b/1", PAGE.format(body)), (2, "http://a.b/2", PAGE.format("<article><p>short</p></article>")), (3, None, ""), (4, "x", None), (5, "http://c.d/", PAGE.format(plain)), (5, "http://c.d/", PAGE.format(plain)), (6, "http://e.f/", "just text"), (7, "http://g.h", "<p>cut <b of")]
    table = spark.createDataFrame([(*r, "w", 1) for r in rows], "page_id long, url string, html string, wrapper string, salt int")
    got = {r.page_id: (r.text, r.n_chars) for r in html_wrappers.extract(table).collect()}
    assert got[1][0] == "Title & more\n\none two three four\n\nfive\n\nsix\n\nseven"
    assert got[2] == ("short", 5) and got[3] == ("", 0) and got[4] == ("", 0) and got[6][0] == "just text" and got[7][0] == "cut"
    assert got[5][0] == "Head\n\nlong text of the page itself\n\nand more text here"
    assert html_wrappers.extract(table.limit(0)).count() == 0


def test_slots_decide_where_no_element_says_article(spark):
    """Lines that the pages of a host share drop out, wherever they stand; the texts that differ stay."""
    page = "<html><body><div class='x'><p>Share this story</p>{}<p>Copyright notice of site</p></div></body></html>"
    bodies = [[f"body {i} {k} with words of its own" for k in range(1 + i % 3)] for i in range(6)]
    rows = [(i, f"http://one.host/{i}", page.format("".join(f"<p>{t}</p>" for t in body))) for i, body in enumerate(bodies)]
    rows += [(10, "http://two.host/1", page.format("<p>first of two</p>")), (11, "http://two.host/2", page.format("<p>second of two</p>"))]
    same = "<html><body><article><p>a line of every article</p>{}</article></body></html>"
    rows += [(20 + i, f"http://three.host/{i}", same.format(f"<p>number {i}</p>")) for i in range(4)]
    rows += [(30 + i, "http://four.host/", "<body><p>one page, stored twice</p></body>") for i in range(2)]
    got = {r.page_id: r.text for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(6)] == ["\n\n".join(b) for b in bodies]
    assert got[10] == "first of two" and got[11] == "second of two"
    assert all(got[20 + i] == f"a line of every article\n\nnumber {i}" for i in range(4))
    assert got[30] == got[31] == "one page, stored twice"


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 100_000 + "<p>deep text</p>" + "</div>" * 100_000 + "<p>after</p>"
    wide = "".join(f"<p>t{i}</p><hr class='c{i * i % 97}'>" for i in range(6000))
    menu = "<div>" * 1000 + "<nav><ul><li>menu</li></ul></nav><p>text</p>"
    rows = [(1, "http://d/1", deep), (2, "http://d/2", deep.replace("deep", "other")), (3, "http://w/1", wide), (4, "http://w/2", wide.replace("c5'", "d5'").replace("t", "u")), (5, "http://m/1", menu), (6, "http://s/", "</x>" * 100_000 + "<li>" * 3000 + "end")]
    began = time.time()
    got = {r.page_id: r.text for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert "deep text" in got[1] and "other text" in got[2] and got[3].split("\n\n") == [f"t{i}" for i in range(6000)]
    assert "text" in got[5] and "menu" not in got[5] and got[6] == "end"
    assert time.time() - began < 120


def test_wrappers_fold():
    items = html_wrappers.folded(html_wrappers.copied(html_wrappers.parse("<ul><li>a<li>b<li>c</ul><h2>x</h2><p>1</p><h2>y</h2><p>2</p>")[0]))
    assert items[0][0] == "ul" and items[0][1][0][3] and items[1][0] == "()" and [x[0] for x in items[1][1]] == ["h2", "p"]
    assert json.loads(json.dumps(items)) == items


def test_decontamination(spark, odd):
    r = random.Random(2)
    item = " ".join("".join(r.choice("klmnop") for _ in range(6)) for _ in range(30))
    docs = [*odd, (200, f"before {item.upper()} after", "en", "a"), (201, " ".join(item.split()[:8]) + " other words here", "en", "a"), (202, "x " * 5000 + item, "en", "a")]
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two"), (1, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find(make(spark, docs), items).collect()}
    assert got == {(200, 1), (202, 1)}
    kept = decontamination.drop_contaminated(make(spark, docs), items)
    assert kept.columns == make(spark, docs).columns and kept.count() == len(docs) - 2
    assert decontamination.find(make(spark, docs), items.limit(0)).count() == 0


def bench_items(r, n):
    say = lambda k: " ".join("".join(r.choice("abcdefg") for _ in range(2)) for _ in range(k))
    return [(i, say(r.randrange(6, 40))) for i in range(n)]


def test_block_max_wand_scores_every_item():
    """What the search returns is what scoring every item of every passage returns."""
    r = random.Random(21)
    items = bench_items(r, 120)
    index = decontamination.Index([i for i, _ in items], [t for _, t in items], 0.3)
    seen = 0
    for _ in range(150):
        terms = sorted(r.sample(range(len(index.terms)), r.randrange(1, min(60, len(index.terms)))))
        want = {}
        for t in terms:
            for item, impact in zip(index.item[index.at[t] : index.at[t + 1]].tolist(), index.impact[index.at[t] : index.at[t + 1]].tolist(), strict=True):
                want[item] = want.get(item, 0.0) + impact
        got = dict(index.search(terms, 0, len(items)))
        assert got == pytest.approx({i: s for i, s in want.items() if s >= index.threshold - 1e-9})
        seen += len(got)
    assert seen > 50


def test_decontamination_in_blocks(spark, monkeypatch):
    """Many small indexes find what one does, with the same scores."""
    r = random.Random(22)
    items = bench_items(r, 40)
    docs = [(i, " ".join(["filler words"] * r.randrange(5)) + " " + items[i % 40][1] + " tail", i) for i in range(60)] + [(100, None, 1), (101, "", 1)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    table = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted((x.doc_id, x.item_id, round(x.score, 9), x.overlap) for x in decontamination.find(docs, table).collect())
    whole, kept = found(), sorted(map(str, decontamination.drop_contaminated(docs, table).collect()))
    assert {(i, i % 40) for i in range(60)} <= {x[:2] for x in whole}
    monkeypatch.setattr(decontamination, "MAX_INDEX_BYTES", 1000)
    assert found() == whole and sorted(map(str, decontamination.drop_contaminated(docs, table).collect())) == kept


def test_chat(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd + "\\"), (2, 0, "assistant", "no"), (3, 0, "user", None), (3, 0, "user", None), (None, 1, None, "x\\<|y"), (4, 0, "ro\nle", "<\\|")]
    table = spark.createDataFrame([(*r, "s") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(table)).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", odd), ("assistant", odd + "\\")] and back[1].loss_text == odd + "\\" and back[1].valid
    assert not back[2].valid and not back[3].valid and [tuple(t) for t in back[3].turns] == [("user", "")] * 2
    assert tuple(back[None].turns[0]) == ("", "x\\<|y") and tuple(back[4].turns[0]) == ("ro\nle", "<\\|")
    assert chat.format_chats(table.limit(0)).count() == 0


def test_durable_gives_up_its_shuffles(spark):
    dirs = [Path(str(d)) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {x.name for d in dirs for x in d.rglob("shuffle_*.data")}
    rows = spark.range(5000).groupBy((F.col("id") % 70).alias("k")).count()
    before = shuffles()
    assert len(rows.collect()) == 70 and shuffles() - before  # its own shuffle stays
    before = shuffles()
    joined = rows.join(spark.range(70).withColumnRenamed("id", "k").repartition(3), "k")
    held = common.durable(joined)
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert sum(r["count"] for r in held.collect()) == sum(r["count"] for r in joined.collect()) == 5000 and len(rows.collect()) == 70
