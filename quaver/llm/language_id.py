"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes (A-Z as a-z) in both directions, white space included, labels every position, and a
document's probabilities are the mean over all positions of the whole text that aren't white space. A text is read in
stretches of CORE bytes with MARGIN bytes before and after, which only warm up the state: so the state runs on over
words, a stretch costs bounded memory, and every byte is labelled once with its surroundings known. Training is plain
numpy: backpropagation through time and Adam, on the driver, over windows of a bounded sample of labelled documents.

The sample: for each language up to SAMPLE_DOCS documents of at most SAMPLE_BYTES together (SAMPLE_TOTAL over all
languages), by hash of doc_id, whole texts; documents for which `held_out` holds are never learned from. All languages
are learned. All other rows are only predicted, from their text alone.

Null texts and texts without a letter are `und` with score 0; so is everything if there is nothing to learn from.
Repeated rows are predicted alike. A null doc_id stays null. predict() reads doc_id, text and lang only; other columns
can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.llm.common import slices, small_batches, utf8
from quaver.llm.words import LOWER, SPACE

SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_TOTAL = 300, 1_000_000, 64_000_000
#: Bytes of a stretch that are labelled, and bytes read before and after them; stretches read at once.
CORE, MARGIN, STRETCHES = 448, 32, 512
EMBED, HIDDEN = 12, 12
#: Training: batches of BATCH windows of WINDOW bytes.
STEPS, BATCH, WINDOW, RATE, SEED = 320, 96, 80, 0.012, 7
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): between -1 and 1 like tanh, with slope (1 - |y|)**2, at a seventh of its cost."""
    return x / (1 + np.abs(x))


class Network:
    """Byte embeddings, a gated recurrent layer for each direction, and a softmax at every position."""

    def __init__(self, languages: list[str], seed: int = SEED):
        r = np.random.default_rng(seed)
        self.languages = languages
        k = len(languages)

        def normal(*shape: int) -> np.ndarray:
            return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"E": normal(256, EMBED) * 4, "V": normal(2 * HIDDEN, k), "c": np.zeros(k, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": normal(EMBED, 3 * HIDDEN), f"U{d}": normal(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States [time, word, hidden] in direction d; x: bytes [time, word]; masked positions leave the state as it is."""
        w, u, b = self.p[f"W{d}"], self.p[f"U{d}"], self.p[f"b{d}"]
        table = self.p["E"] @ w + b  # what each byte adds to the gates
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h, out, saved = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((*x.shape, HIDDEN), np.float32), []
        for t in steps:
            g = table[x[t]]
            a = h @ u
            zr = 0.5 * squash(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]) + 0.5
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = squash(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            m = mask[t][:, None]
            if keep:
                saved.append((t, h, z, r, n, a[:, 2 * HIDDEN :], m))
            h = np.where(m, new, h)
            out[t] = h
        return out, saved

    def _states(self, x: np.ndarray, d: str) -> np.ndarray:
        """States [time, hidden, stretch] of one direction over bytes [time, stretch], read from the first on."""
        table = np.ascontiguousarray((self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"]).T)
        u, x = np.ascontiguousarray(self.p[f"U{d}"].T), x.astype(np.intp)
        n = x.shape[1]
        out, h = np.empty((len(x), HIDDEN, n), np.float32), np.zeros((HIDDEN, n), np.float32)
        g, a, zr, low, new = (np.empty((k * HIDDEN, n), np.float32) for k in (3, 3, 2, 2, 1))
        z, r = zr[:HIDDEN], zr[HIDDEN:]

        def squashed(v: np.ndarray, w: np.ndarray) -> None:
            np.abs(v, out=w)
            w += 1
            v /= w

        for t in range(len(x)):
            np.take(table, x[t], axis=1, out=g, mode="clip")
            np.matmul(u, h, out=a)
            np.add(g[: 2 * HIDDEN], a[: 2 * HIDDEN], out=zr)
            squashed(zr, low)
            zr *= 0.5
            zr += 0.5
            np.multiply(r, a[2 * HIDDEN :], out=new)
            new += g[2 * HIDDEN :]
            squashed(new, low[:HIDDEN])
            h -= new
            h *= z
            h += new
            out[t] = h
        return out

    def posteriors(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Probabilities [time, language, stretch] of stretches of size[i] bytes; what lies beyond a stretch has no meaning."""
        ahead = self.p["V"][:HIDDEN].T @ self._states(x, "f") + self.p["c"][:, None]
        if size.min() == size.max():
            back = (self.p["V"][HIDDEN:].T @ self._states(x[::-1], "b"))[::-1]
        else:
            turned, column = np.maximum(size - 1 - np.arange(len(x))[:, None], 0), np.arange(x.shape[1])
            back = np.moveaxis((self.p["V"][HIDDEN:].T @ self._states(x[turned, column], "b"))[turned, :, column], 2, 1)
        s = ahead + back
        s -= s.max(1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(1, keepdims=True)
        return s

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(loss, gradient) of the mean cross-entropy over positions; y: language of each word."""
        p, grads = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        runs = {d: self._pass(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        s = both @ p["V"] + p["c"]
        s = np.exp(s - s.max(2, keepdims=True))
        s /= s.sum(2, keepdims=True)
        total = mask.sum()
        loss = -float((np.log(s[:, np.arange(len(y)), y] + 1e-9) * mask).sum() / total)
        s[:, np.arange(len(y)), y] -= 1
        s *= mask[:, :, None] / np.float32(total)
        grads["V"] = both.reshape(-1, 2 * HIDDEN).T @ s.reshape(-1, s.shape[2])
        grads["c"] = s.sum((0, 1))
        up = s @ p["V"].T
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            w, u = p[f"W{d}"], p[f"U{d}"]
            back, into = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((256, 3 * HIDDEN), np.float32)
            for t, h, z, r, n, a, m in reversed(runs[d][1]):
                dh = back + up[t][:, part]
                live = dh * m
                dn = live * (1 - z) * (1 - np.abs(n)) ** 2
                dz = live * (h - n) * (1 - np.abs(2 * z - 1)) ** 2 / 2
                dr = dn * a * (1 - np.abs(2 * r - 1)) ** 2 / 2
                gate, inner = np.concatenate([dz, dr, dn], axis=1), np.concatenate([dz, dr, dn * r], axis=1)
                grads[f"U{d}"] += h.T @ inner
                np.add.at(into, x[t], gate)
                back = dh * ~m + live * z + inner @ u.T
            grads[f"W{d}"] = p["E"].T @ into
            grads[f"b{d}"] = into.sum(0)
            grads["E"] += into @ w.T
        return loss, grads

    def train(self, texts: list[np.ndarray], y: np.ndarray, steps: int = STEPS) -> float:
        """Adam over batches of windows, as many of each language; the mean loss of the last 20 steps."""
        r = np.random.default_rng(SEED)
        weight = np.sqrt(np.array([len(t) for t in texts], float))
        weight = weight / np.bincount(y, weight)[y]
        weight /= weight.sum()
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        losses = []
        for step in range(1, steps + 1):
            pick = r.choice(len(texts), BATCH, p=weight)
            begin = [int(r.integers(0, max(1, len(texts[i]) - WINDOW + 1))) for i in pick]
            x, mask = pad([texts[i][a : a + WINDOW].tobytes() for i, a in zip(pick, begin, strict=True)])
            loss, grads = self.gradients(x, mask, y[pick])
            losses.append(loss)
            rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        return float(np.mean(losses[-20:]))

    def text_sums(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """For each text data[offs[i]:offs[i+1]], the sum of its positions' probabilities, white space left out."""
        out = np.zeros((len(offs) - 1, len(self.languages)))
        parts = -(-np.diff(offs) // CORE)
        doc = np.repeat(np.arange(len(parts)), parts)
        core = offs[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * CORE
        stop = np.minimum(core + CORE, offs[doc + 1])
        start, end = np.maximum(core - MARGIN, offs[doc]), np.minimum(stop + MARGIN, offs[doc + 1])
        order = np.argsort(end - start, kind="stable")
        for at in range(0, len(order), STRETCHES):
            some = order[at : at + STRETCHES]
            size = end[some] - start[some]
            place = start[some] + np.arange(size.max())[:, None]
            x = data[np.minimum(place, len(data) - 1)]
            counts = ((place >= core[some]) & (place < stop[some]) & ~SPACE[x]).astype(np.float32)
            sums = np.einsum("tks,ts->sk", self.posteriors(x, size), counts)
            np.add.at(out, doc[some], sums)
        return out


def pad(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes [time, word], mask) of words of any lengths up to SEGMENT."""
    size = np.fromiter(map(len, found), np.int64, len(found))
    width = int(size.max(initial=1))
    x = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in found), np.uint8).reshape(len(found), width).T
    return np.ascontiguousarray(x), np.arange(width)[:, None] < size


def sample(docs: DataFrame, held_out: Column) -> list:
    """(text, lang) rows to learn from, within the bounds of the module."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.coalesce(held_out, F.lit(False)))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    known = rows.groupBy("lang").count().collect()
    if not known:
        return []
    most = min(SAMPLE_BYTES, SAMPLE_TOTAL // len(known))
    scale = 1 << 20
    limits = rows.sparkSession.createDataFrame([(r["lang"], min(scale, -(-4 * SAMPLE_DOCS * scale // r["count"]))) for r in known], "lang string, most long")
    few = rows.join(F.broadcast(limits), "lang").where(F.pmod("h", F.lit(scale)) < F.col("most"))
    first = Window.partitionBy("lang").orderBy("h", "text")
    few = few.withColumn("i", F.row_number().over(first)).where(F.col("i") <= SAMPLE_DOCS)
    few = few.withColumn("bytes", F.sum(F.octet_length("text")).over(first.rowsBetween(Window.unboundedPreceding, 0)))
    return few.where((F.col("bytes") <= most) | (F.col("i") == 1)).select("text", "lang").orderBy("lang", "h").collect()


def train(docs: DataFrame, held_out: Column) -> Network | None:
    """A network trained on a sample of docs; None if there is none."""
    rows = [(r.lang, LOWER[np.frombuffer(r.text.encode(), np.uint8)]) for r in sample(docs, held_out) if r.text.strip()]
    if not rows:
        return None
    net = Network(sorted({lang for lang, _ in rows}))
    at = {lang: i for i, lang in enumerate(net.languages)}
    net.train([t for _, t in rows], np.array([at[lang] for lang, _ in rows]))
    return net


def label(net: Network | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """(language, probability) of each text."""
    data, offs = utf8(column)
    n = len(offs) - 1
    if net is None:
        return [UNKNOWN] * n, np.zeros(n)
    total = net.text_sums(LOWER[data], offs)
    known = np.array([t is not None and _LETTER.search(t) is not None for t in column.to_pylist()], bool)
    mean = total / np.maximum(total.sum(1, keepdims=True), 1e-12)
    best = mean.argmax(1)
    lang = [net.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
    return lang, np.where(known, np.clip(mean[np.arange(n), best], 0, 1), 0.0)


def predict(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    small_batches(docs.sparkSession)
    net = train(docs, held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            lang, score = label(net, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, held_out: Column, least: float) -> DataFrame:
    """The documents whose language is known with at least that probability, all columns kept."""
    small_batches(docs.sparkSession)
    net = train(docs, held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            lang, score = label(net, b.column("text"))
            yield b.filter(pa.array((np.array(lang, object) != UNKNOWN) & (score >= least), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
