"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts are lower-cased and cut into words (\\w+). Of each test item's word n-grams the corpus
frequency is counted over all documents; in every run of RUN neighbouring n-grams the rarest is
a seed, so any unedited stretch of RUN + SEED - 1 words of an item holds one however often the
item leaked. Documents' seeds name (item, place); the passage around each is aligned with the
item word by word, and a pair is reported if the alignment scores THRESHOLD of a perfect one, or
holds a stretch with LONG matched words of which few are broken, and MATCHED words agree at least.
An item of fewer than MATCHED words is a passage only where it stands by itself: it matches documents that
have it as a line, word for word.

Test items come in parts of PART_CHARS at most, each part with its own scans of the documents, so
what is sent to the tasks is bounded whatever the benchmark's size. Null and empty texts match nothing,
nor do items without a word; repeated rows are reported each.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.llm.common import bounded_batches

SEED, RUN = 3, 4
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD, MATCHED = 0.45, 5
LONG, LONG_IDENTITY = 13, 0.8
#: Characters of test items that are handled at once.
PART_CHARS = 8 << 20
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def longest_stretch(steps: list[bool]) -> int:
    """Matched words of the stretch of an alignment that has most of them at LONG_IDENTITY."""
    same = np.array(steps, dtype=bool)
    # Matches less what the identity asks, in whole numbers: a stretch is good if its sum isn't negative.
    ups = round(1 / (1 - LONG_IDENTITY)) - 1
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -ups))])
    first = np.searchsorted(-np.minimum.accumulate(total), -total)
    matched = np.concatenate([[0], np.cumsum(same)])
    return int((matched - matched[first]).max())


def leaked(found: tuple[int, int, int, int, int], n: int) -> bool:
    """Whether what align gave for an item of n words is a leak."""
    score, same, stretch, _, _ = found
    return same >= MATCHED and (score >= THRESHOLD * MATCH * n or stretch >= LONG)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int]:
    """Best local alignment of two word-id arrays: score, matches, matches of its longest good stretch, begin and end in b.

    Ids of -1 agree with nothing. Linear gaps; the matrix is filled row by row, the gaps along a
    row by a running maximum.
    """
    n, m = len(a), len(b)
    ramp = np.arange(m + 1) * -GAP
    h = np.zeros((n + 1, m + 1), np.int32)
    for i in range(1, n + 1):
        row = np.zeros(m + 1, np.int32)
        same = (b == a[i - 1]) & (a[i - 1] >= 0)
        row[1:] = np.maximum(h[i - 1, :-1] + np.where(same, MATCH, MISMATCH), h[i - 1, 1:] + GAP)
        np.maximum(row, 0, out=row)
        h[i] = np.maximum.accumulate(row + ramp) - ramp
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    score, end, steps = int(h[i, j]), int(j), []
    while i and j and h[i, j] > 0:
        same = a[i - 1] == b[j - 1] and a[i - 1] >= 0
        if straight := h[i, j] == h[i - 1, j - 1] + (MATCH if same else MISMATCH):
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
        steps.append(bool(straight and same))
    return score, sum(steps), longest_stretch(steps), int(j), end


class Items:
    """Test items of one part, as word ids, and their seeds."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        self.ids, self.texts = [], []
        self.short: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for item, text in rows:
            w = words(text or "")
            if 0 < len(w) < MATCHED:
                self.short[tuple(w)].append(item)
            elif w:
                self.ids.append(item)
                self.texts.append(np.array([self.number.setdefault(x, len(self.number)) for x in w], dtype=np.int64))
        self.codes = np.unique(np.concatenate([self.grams(t) for t in self.texts])) if self.texts else np.zeros(0, np.int64)
        self.seeds: dict[int, list[tuple[int, int]]] = {}
        self.sorted_seeds = self.codes

    def grams(self, x: np.ndarray) -> np.ndarray:
        """Codes of the n-grams at each place, -1 where a word is unknown. A part has under 2^21 words."""
        n = len(x) - SEED + 1
        if n < 1:
            return np.zeros(0, np.int64)
        code, known = x[:n].copy(), x[:n] >= 0
        for k in range(1, SEED):
            code = code << 21 | x[k : k + n] & 0x1FFFFF
            known &= x[k : k + n] >= 0
        return np.where(known, code, -1)

    def found(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids of a document, and the places of n-grams among sorted_seeds with their codes."""
        get = self.number.get
        x = np.array([get(w, -1) for w in words(text)], dtype=np.int64)
        g = self.grams(x)
        at = np.flatnonzero(g >= 0)
        if len(at) and len(self.sorted_seeds):
            spot = np.minimum(np.searchsorted(self.sorted_seeds, g[at]), len(self.sorted_seeds) - 1)
            at = at[self.sorted_seeds[spot] == g[at]]
        else:
            at = at[:0]
        return x, at, g[at]

    def choose(self, frequency: dict[int, int]) -> None:
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(self.texts):
            g = self.grams(t).tolist()
            often = [frequency.get(c, 0) for c in g]
            chosen = {min(range(i, min(i + RUN, len(g))), key=lambda j: (often[j], j)) for i in range(max(1, len(g) - RUN + 1))}
            for j in sorted(chosen):
                seeds[g[j]].append((k, j))
        self.seeds, self.sorted_seeds = dict(seeds), np.array(sorted(seeds), dtype=np.int64)

    def matches(self, text: str, memo: dict) -> list[tuple]:
        """(item_id, score, matched, item_words, begin, end) of the best passage for each item found."""
        x, at, codes = self.found(text)
        spans: dict[int, list[list[int]]] = defaultdict(list)
        for place, code in zip(at.tolist(), codes.tolist(), strict=True):
            for k, j in self.seeds[code]:
                n = len(self.texts[k])
                a, b = max(0, place - j - n // 4 - 2), min(len(x), place - j + n + n // 4 + 2)
                if spans[k] and a <= spans[k][-1][1]:
                    spans[k][-1] = [min(a, spans[k][-1][0]), max(b, spans[k][-1][1])]
                else:
                    spans[k].append([a, b])
        out = []
        for k, own in spans.items():
            best = None
            n = len(self.texts[k])
            for a, b in own:
                for c in range(a, b, 4 * n + 64):  # seeds all along a text: pieces that overlap by an item and a half
                    piece = x[c : min(b, c + 6 * n + 64)]
                    key = (k, piece.tobytes())
                    if key not in memo:
                        if len(memo) > 20_000:
                            memo.clear()
                        memo[key] = align(self.texts[k], piece)
                    score, same, _, i, j = memo[key]
                    if leaked(memo[key], n) and (best is None or score > best[0]):
                        best = (score, same, c + i, c + j)
            if best:
                out.append((self.ids[k], best[0] / (MATCH * n), best[1], n, best[2], best[3]))
        return sorted([*out, *(self.alone(text) if self.short else [])], key=lambda r: (r[0] is not None, r[0] or 0))

    def alone(self, text: str) -> list[tuple]:
        """As matches, of the short items that are a line of the text."""
        found, at = {}, 0
        for line in text.split("\n"):
            w = tuple(words(line))
            for item in self.short.get(w, ()) if len(w) < MATCHED else ():
                found.setdefault(item, (item, 1.0, len(w), len(w), at, at + len(w)))
            at += len(w)
        return list(found.values())


def parts(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Test items, a bounded part at a time."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= PART_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def prepared(docs: DataFrame, benchmark: DataFrame) -> list[Items]:
    """All parts with seeds chosen by their frequency in the documents."""
    out = []
    bounded_batches(docs)
    for rows in parts(benchmark):
        items = Items(rows)

        def count(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            n: dict[int, int] = defaultdict(int)
            for b in batches:
                for text in b.column(0).to_pylist():
                    for c in set(items.found(text or "")[2].tolist()):
                        n[c] += 1
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.int64()), pa.array(n.values(), pa.int64())], names=["code", "n"])

        if len(items.codes) or items.short:
            rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
            items.choose({r[0]: r[1] for r in rows.toLocalIterator()})
            out.append(items)
    return out


PAIRS = "doc_id long, item_id long, score double, matched long, item_words long, begin long, end long"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id) pairs with the best alignment's score (of a perfect one), matched words, and words' span."""
    found = docs.sparkSession.createDataFrame([], PAIRS)
    for items in prepared(docs, benchmark):

        def work(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            memo: dict = {}
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in items.matches(t or "", memo)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in PAIRS.split(", ")])

        found = found.unionByName(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, PAIRS))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a passage of a test item; all columns stay; text must be a string."""
    for items in prepared(docs, benchmark):

        def clean(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            memo: dict = {}
            for b in batches:
                texts = b.column(b.schema.get_field_index("text")).to_pylist()
                yield b.filter(pa.array([not items.matches(t or "", memo) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
