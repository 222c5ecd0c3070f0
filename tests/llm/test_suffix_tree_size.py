"""The suffix tree's scores depend neither on the size of the corpus nor on how much of the tree is sent to all tasks."""

import math
import pathlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaver.llm import suffix_tree


def test_strings_stay_stored_in_a_larger_corpus(spark):
    rows = [(i, "red fox ran off") for i in range(40)] + [(1000 + i, " ".join(["pad"] * 60_000)) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = suffix_tree.learn(docs, suffix_tree.counted(docs, lambda c: suffix_tree.tokens(c)[0]))
    assert m.total > 40 / 1e-5
    assert m.levels[0].select("a").distinct().count() >= 3


def test_sent_part_changes_nothing(spark, monkeypatch):
    rows = [(i, "red fox ran off " * (1 + i % 3) + "the red hen sat " * (i % 2)) for i in range(80)] + [(900, "red"), (901, None), (902, "fox red new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda: {r.doc_id: r.score for r in suffix_tree.score(docs, F.col("doc_id") >= 70).collect()}
    whole = score()
    monkeypatch.setattr(suffix_tree, "HOT", 3)
    monkeypatch.setattr(suffix_tree, "ROWS_A_KEY", 2)
    assert score() == pytest.approx(whole)


def test_rounds_score_every_text_once(spark, monkeypatch):
    rows = [(i // 2 or None, "red fox ran off " * (1 + i % 3) + f"word{i % 50} " * (i % 2)) for i in range(90)] + [(900, "red"), (901, None), (902, "fox red new"), (902, "fox red new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda: sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in suffix_tree.score(docs, F.col("doc_id") >= 40).collect())
    monkeypatch.setattr(suffix_tree, "HOT", 3)
    monkeypatch.setattr(suffix_tree, "TOKENS_A_NAME", 0)
    whole = score()
    assert len(whole) == len(rows)
    rounds, dropped = [], suffix_tree.dropped
    monkeypatch.setattr(suffix_tree, "dropped", lambda *x: (rounds.append(x), dropped(*x)))
    monkeypatch.setattr(suffix_tree, "TOKENS_A_NAME", 5)
    assert score() == whole
    assert sum("asked" in x[0].columns for x in rounds if x) > 1


def test_only_the_result_stays_on_disk(spark):
    docs = spark.createDataFrame([(i, "red fox ran off " * (1 + i % 3)) for i in range(80)], "doc_id long, text string")
    suffix_tree.score(docs.limit(0), F.col("doc_id") >= 70).count()
    folder = pathlib.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = {p.name for p in folder.glob("rdd-*")}
    assert before
    assert suffix_tree.score(docs, F.col("doc_id") >= 70).count() == 80
    assert len({p.name for p in folder.glob("rdd-*")} - before) == 1


def brute_scores(texts, held, depth):
    """The tree in plain dictionaries: counts of strings, divergence tests level by level, longest suffix states."""
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    tokens = [[w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate(low)) if w] + [None] for t in texts]
    counts = Counter(tuple(t[i : i + k]) for t, h in zip(tokens, held, strict=True) if not h for k in range(1, depth + 2) for i in range(len(t) - k + 1))
    total, kinds = sum(c for s, c in counts.items() if len(s) == 1), sum(len(s) == 1 for s in counts)
    p = {s: (c + 0.1) / (total + 0.1 * (kinds + 1)) for s, c in counts.items() if len(s) == 1}
    root, rest, stay = dict(p), {}, [set() for _ in range(depth + 2)]
    stored = {s for s, c in counts.items() if len(s) == 1 and c >= suffix_tree.LEAST_COUNT}
    for k in range(1, depth + 1):
        found = {s for s, c in counts.items() if len(s) == k + 1 and c >= suffix_tree.LEAST_COUNT and s[:-1] in stored and s[1:] in stored}
        by: dict = {}
        for s in found:
            by.setdefault(s[:-1], []).append(s)
        for a, some in by.items():
            n = counts[a]
            rest[a] = 1 - (sum(counts[s] for s in some) - 0.5 * len(some)) / n
            for s in some:
                p[s] = (counts[s] - 0.5) / n + rest[a] * p[s[1:]]
            gain = sum(counts[s] * math.log(p[s] / p[s[1:]]) for s in some)
            left = (n - sum(counts[s] for s in some)) * math.log(max(rest[a], 1e-300) / max(1 - sum(p[s[1:]] for s in some), 1e-9))
            if gain + min(left, 0) >= suffix_tree.GAIN * len(some):
                stay[k].add(a)
        stored |= found
    for k in range(depth, 1, -1):
        stay[k - 1] |= {a[1:] for a in stay[k]}
    floor = 0.1 / (total + 0.1 * (kinds + 1))

    def prob(t, i, k):
        if not k:
            return root.get((t[i],), floor)
        a = tuple(t[i - k : i])
        if a not in stay[k]:
            return prob(t, i, k - 1)
        s = (*a, t[i])
        return p[s] if s in stored else rest[a] * prob(t, i, k - 1)

    return [sum(math.log10(prob(t, i, min(i, depth))) for i in range(len(t))) for t in tokens], [len(s) for s in stay]


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_scores_are_those_of_plain_dictionaries(spark, depth):
    r = random.Random(depth)
    chain = {"a": "bbbc", "b": "ccca", "c": "aabd", "d": "abcd"}
    texts = [None, "", "A b", "unseen words only"]
    for _ in range(150):
        words = [r.choice("abcd")]
        while r.random() < 0.95 and len(words) < 40:
            words.append(r.choice(chain[words[-1]] if len(words) < 2 or words[-2] != "a" else "dddb"))
        texts.append(" ".join(words))
    texts += [texts[10]] * 3
    held = [i % 10 == 0 for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, states = brute_scores(texts, held, depth)
    assert sum(1 for n in states if n) >= min(depth, 3)
    got = {g.doc_id: g.score for g in suffix_tree.score(docs, F.col("doc_id") % 10 == 0, depth).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-6)


def test_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (None, None, 2), (1, "a b", 3)], "doc_id long, text string, c int")
    got = suffix_tree.score(docs, F.col("doc_id") == 1).collect()
    assert sorted((g.doc_id is None, g.held_out, g.n_tokens) for g in got) == [(False, True, 3), (True, False, 1), (True, False, 3)]


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_places(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    ask = np.concatenate([keys, keys + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
    where = {k: i for i, k in enumerate(keys.tolist())}
    assert suffix_tree.Places(keys).of(ask).tolist() == [where.get(k, -1) for k in ask.tolist()]


def test_packed_numbers_come_back():
    x = np.concatenate([np.arange(300, dtype=np.uint64), np.array([(1 << 64) - 1, 1 << 63], np.uint64)])
    assert (suffix_tree.unpacked(suffix_tree.packed(x)) == x).all()
    assert len(suffix_tree.unpacked(suffix_tree.packed(x[:0]))) == 0


@pytest.mark.parametrize("held", [1, 4_000_000])
def test_frequent_keys(spark, monkeypatch, held):
    monkeypatch.setattr(suffix_tree, "MAX_HELD", held)
    r = random.Random(held)
    texts = [None, ""] + [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(30)) for _ in range(60)]
    want = Counter(int(h) for t in texts for h in suffix_tree.tokens(pa.array([t]))[0])
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = suffix_tree.frequent(docs, lambda c: suffix_tree.tokens(c)[0], 60, 5).collect()
    assert sorted((g.key % (1 << 64), g.c) for g in got) == sorted((k, c) for k, c in want.items() if c >= 60)
    assert not suffix_tree.frequent(docs.limit(0), lambda c: suffix_tree.tokens(c)[0], 1, 5).count()
