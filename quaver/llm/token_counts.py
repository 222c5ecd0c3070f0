"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a slice lie in one ragged numpy array of symbol ids. In each round every sequence finds the
lowest rank among its adjacent pairs and all sequences apply theirs at once; ranks are looked up anew only beside what
was merged, and a sequence without a known pair is done. What is left of each sequence are its tokens. A pre-token of
more than LONG bytes is merged alone, in the same order of ranks: the places of each rank are kept in lists, so that a
round costs as much as it merges and a text without any white space takes time in proportion to its length.

Texts are cut at ASCII white space, which no token crosses, into parts of bounded size, and each distinct pre-token of a
task is merged once. Null and empty texts have 0 tokens. Repeated rows give repeated rows; only doc_id and text are
read, so other columns can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import ragged, slices, small_batches

#: Bytes of a pre-token from which it is merged alone.
LONG = 1024
#: Characters of a text that are cut into pre-tokens at once, and pre-tokens a task remembers.
PART_CHARS, MAX_PIECES = 1_000_000, 1_000_000
_BREAK = regex.compile(r"[ \t-\r]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Merges:
    """The vocabulary file of a byte-level BPE with word ends: pre-tokenization and ranked merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.cut = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.width = int(max(vocab.values())) + 1
        key = left * self.width + right
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order, made

    def normal(self, text: str) -> str:
        """NFC and lower case, character by character; a final sigma has no form of its own here."""
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text, with special strings as they are."""
        out: list[str] = []
        at = 0
        while at < len(text):
            end = at + PART_CHARS
            if end < len(text):
                stop = _BREAK.search(text, end)
                end = stop.start() if stop else len(text)
            part, at = text[at:end], end
            if self.special and self.cut.search(part):
                last = 0
                for m in self.cut.finditer(part):
                    out += [*self.pattern.findall(self.normal(part[last : m.start()])), m[0]]
                    last = m.end()
                part = part[last:]
            out += self.pattern.findall(self.normal(part))
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, len(self.key) where it has none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], len(self.key))

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pre-tokens, one after another; number of tokens of each)."""
        whole = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # piece numbers, sizes, tokens
        sym = self.inner[raw]
        last = np.cumsum(whole) - 1
        sym[last[whole > 0]] = self.final[raw[last[whole > 0]]]
        for i in np.flatnonzero(whole > LONG).tolist():
            got = self.merge_long(sym[last[i] + 1 - whole[i] : last[i] + 1])
            done.append((np.array([i]), np.array([len(got)]), got))
        live = np.flatnonzero((whole > 0) & (whole <= LONG))
        size = whole[live]
        sym = sym[ragged(last[live] + 1 - size, size)]
        far = len(self.key)
        rank = np.append(self.ranks(sym[:-1], sym[1:]), far)[: len(sym)]
        rank[np.cumsum(size) - 1] = far  # no pair crosses sequences
        while len(live):
            first = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, first)
            ended = low == far
            seq = np.repeat(np.arange(len(size)), size)
            if ended.any():
                out = ended[seq]
                done.append((live[ended], size[ended], sym[out]))
                live, size, sym, rank, low = live[~ended], size[~ended], sym[~out], rank[~out], low[~ended]
                if not len(live):
                    break
                seq = np.repeat(np.arange(len(size)), size)
            # of overlapping occurrences, as in "aaa", every second counts from the left
            place = np.flatnonzero(rank == low[seq])
            fresh = np.ones(len(place), bool)
            fresh[1:] = place[1:] != place[:-1] + 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - run) % 2 == 0]
            sym[place] = self.made[rank[place]]
            keep = np.ones(len(sym), bool)
            keep[place + 1] = False
            rank[place] = np.where(rank[place + 1] == far, far, -1)  # the end of a sequence stays its end
            size = size - np.bincount(seq[place], minlength=len(size))
            at = np.cumsum(keep)[place] - 1
            sym, rank = sym[keep], rank[keep]
            ends = np.zeros(len(sym), bool)
            ends[np.cumsum(size) - 1] = True
            stale = np.union1d(at, at[at > 0] - 1)
            stale = stale[~ends[stale]]
            rank[ends] = far
            rank[stale] = self.ranks(sym[stale], sym[stale + 1])
        number, sizes, tokens = (np.concatenate([d[k] for d in done] or [np.zeros(0, np.int64)]) for k in range(3))
        size = np.zeros(len(pieces), np.int64)
        size[number] = sizes
        order = np.argsort(number)
        return tokens[ragged((np.cumsum(sizes) - sizes)[order], sizes[order])], size

    def merge_long(self, sym: np.ndarray) -> np.ndarray:
        """The tokens of one long pre-token: rank by rank, at the places where each rank is."""
        n, far = len(sym), len(self.key)
        first = self.ranks(sym[:-1], sym[1:])
        s, after, before = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [*first.tolist(), far]
        places: dict[int, list[int]] = {}
        for i in np.flatnonzero(first < far).tolist():
            places.setdefault(rank[i], []).append(i)
        heap = list(places)
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def look(i: int) -> None:
            j = after[i]
            if j >= n:
                rank[i] = far
                return
            pair = (s[i], s[j])
            if pair not in known:
                known[pair] = int(self.ranks(*np.array([[s[i]], [s[j]]]))[0])
            rank[i] = r = known[pair]
            if r < far:
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(i)

        while heap:
            r = heapq.heappop(heap)
            for i in sorted(set(places.pop(r))):
                if rank[i] != r:
                    continue
                j = after[i]
                s[i], rank[j], after[i] = int(self.made[r]), -1, after[j]
                if after[i] < n:
                    before[after[i]] = i
                look(i)
                if before[i] >= 0:
                    look(before[i])
        out, i = [], 0
        while i < n:
            out.append(s[i])
            i = after[i]
        return np.array(out, np.int64)


class Coder:
    """Tokens of texts; each distinct pre-token of a task is merged once."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.first, self.size, self.tokens = (np.zeros(0, np.int64) for _ in range(3))

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the pre-tokens of all texts, one after another; n+1 bounds); they hold until the next call."""
        if len(self.at) > MAX_PIECES:
            self.clear()
        found: list[np.ndarray] = []
        bounds, fresh = [0], []
        at = self.at
        for text in texts:
            pieces = self.merges.pretokens(text) if text else []
            for x in set(pieces).difference(at):
                at[x] = len(at)
                fresh.append(x)
            found.append(np.fromiter(map(at.__getitem__, pieces), np.int64, len(pieces)))
            bounds.append(bounds[-1] + len(pieces))
        if fresh:
            special = self.merges.special
            tokens, size = self.merges.merge([b"" if x in special else x.encode() for x in fresh])
            marks = [i for i, x in enumerate(fresh) if x in special]
            if marks:
                where = (np.cumsum(size) - size)[marks]
                tokens = np.insert(tokens, where, [special[fresh[i]] for i in marks])
                size[marks] = 1
            self.first = np.concatenate([self.first, len(self.tokens) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.tokens = np.concatenate([self.tokens, tokens])
        return (np.concatenate(found) if found else np.zeros(0, np.int64)), np.array(bounds)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        number, bounds = self.numbers(texts)
        sums = np.concatenate([[0], np.cumsum(self.size[number])])
        return np.diff(sums[bounds])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts, one after another; n+1 bounds)."""
        number, bounds = self.numbers(texts)
        sums = np.concatenate([[0], np.cumsum(self.size[number])])
        return self.tokens[ragged(self.first[number], self.size[number])], sums[bounds]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text, by the vocabulary file at `path`."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(merges(path))
        for b in slices(batches, "text"):
            text = b.column("text")
            n = coder.count(text.to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
