"""Suffix arrays with common prefixes by external induced sorting.

A suffix is S if it is less than the next one, else L; an S suffix after an L one is a sample (S*).

1. Samples are sorted by their text up to the next one and named by it; if names repeat, the string of
   names is sorted by recursion, which ranks the samples. Common prefixes of neighbouring samples are read off the text.
2. From the samples, in ascending order, the L suffixes are induced: whatever has been placed hands the suffix
   before it, if that is L, to the queue of that one's first symbol.
3. From the L suffixes, in descending order, the S suffixes are induced likewise.

Two suffixes with one first symbol agree on one symbol more than those that induced them, and these on the least
common prefix of any neighbours between them: so every tuple carries its common prefix with the one before it in
its queue. Common prefixes are counted up to a cap, as only that is asked of them.

Texts, types and ranks lie in files of the task's folder that are mapped into memory once they exceed a bound, and all
queues write what exceeds theirs: what is held at once doesn't grow with the text. The levels of names have
too many first symbols for queues by symbol; they are sorted through runs on disk by packed words of text and by the
ranks of the level below.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

#: Tuples that a queue holds in memory.
HELD = 1 << 21
#: An array of more entries is a mapped file.
MAPPED = 1 << 23
#: Tuples that are read from a run at once.
READ = 1 << 17
#: Positions that are handled at once.
CHUNK = 1 << 20


def _array(folder: str, n: int, kind: type) -> np.ndarray:
    """Zeros, in a mapped file if there are many."""
    if n <= MAPPED:
        return np.zeros(n, kind)
    handle, name = tempfile.mkstemp(dir=folder)
    os.close(handle)
    return np.memmap(name, kind, "w+", shape=(n,))


class TupleQueue:
    """A disk-backed priority queue of (word, position) that is filled, then emptied in order of words."""

    def __init__(self, folder: str, held: int = HELD):
        self.folder, self.held, self.size = folder, held, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.runs: list[tuple[str, str]] = []

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        word = np.concatenate([w for w, _ in self.parts]) if self.parts else np.zeros(0, np.uint64)
        at = np.concatenate([a for _, a in self.parts]) if self.parts else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        self.parts, self.size = [], 0
        return word[order], at[order]

    def push(self, word: np.ndarray, at: np.ndarray) -> None:
        self.parts.append((word, at))
        self.size += len(word)
        if self.size >= self.held:
            names = tuple(tempfile.mkstemp(suffix=".npy", dir=self.folder)[1] for _ in range(2))
            for name, x in zip(names, self._sorted(), strict=True):
                np.save(name, x)
            self.runs.append(names)

    def drain(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks in order; equal words are never parted."""
        if not self.runs:
            yield self._sorted()
            return
        runs = [tuple(np.load(name, mmap_mode="r") for name in names) for names in self.runs]
        if self.parts:
            runs.append(self._sorted())
        at = [0] * len(runs)
        while any(i < len(w) for i, (w, _) in zip(at, runs, strict=True)):
            last = min(w[min(i + READ, len(w)) - 1] for i, (w, _) in zip(at, runs, strict=True) if i < len(w))
            words, places = [], []
            for k, (w, a) in enumerate(runs):
                end = at[k] + int(np.searchsorted(w[at[k] :], last, side="right"))
                words.append(np.asarray(w[at[k] : end]))
                places.append(np.asarray(a[at[k] : end]))
                at[k] = end
            word, place = np.concatenate(words), np.concatenate(places)
            order = np.argsort(word, kind="stable")
            yield word[order], place[order]
        for names in self.runs:
            for name in names:
                os.remove(name)
        self.runs = []


class Buckets:
    """Queues of (position, common prefix) by first symbol, first in, first out; what exceeds memory lies in a file."""

    def __init__(self, symbols: int, folder: str, held: int):
        self.parts: list[deque] = [deque() for _ in range(symbols)]
        self.held, self.size, self.folder, self.name = held, 0, folder, None

    def push(self, symbol: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> None:
        """Tuples in order; symbols ascend."""
        cuts = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(symbol)], strict=True):
            if j > i:
                self.parts[symbol[i]].append((at[i:j], lcp[i:j]))
        self.size += len(at)
        if self.size > self.held:
            self._spill()

    def _spill(self) -> None:
        if self.name is None:
            handle, self.name = tempfile.mkstemp(dir=self.folder)
            os.close(handle)
        with open(self.name, "ab") as f:
            for own in self.parts:
                held = [i for i, x in enumerate(own) if isinstance(x[0], np.ndarray)]
                for i in held:
                    at, lcp = own[i]
                    own[i] = (f.tell(), len(at))
                    f.write(at.astype("<i8").tobytes())
                    f.write(lcp.tobytes())
        self.size = 0

    def _read(self, part: tuple) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(part[0], np.ndarray):
            self.size -= len(part[0])
            return part
        begin, n = part
        return np.fromfile(self.name, "<i8", n, offset=begin), np.fromfile(self.name, np.uint8, n, offset=begin + 8 * n)

    def pop(self, symbol: int, last: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """The next tuples of a symbol in their order: the first, or the last ones."""
        own, got, n = self.parts[symbol], [], 0
        while own and (not got or n < CHUNK):
            got.append(self._read(own.pop() if last else own.popleft()))
            n += len(got[-1][0])
        if last:
            got.reverse()
        return (np.concatenate([a for a, _ in got]), np.concatenate([c for _, c in got])) if got else None


class Inducer:
    """Hands the suffixes before placed ones to queues, with the common prefixes of neighbours there."""

    def __init__(self, text: np.ndarray, symbols: int, cap: int, queue: Buckets):
        self.text, self.cap, self.queue = text, cap, queue
        self.least = np.full(symbols, cap, np.uint8)  # common prefix since the last tuple of each queue
        self.any = np.zeros(symbols, bool)

    def take(self, at: np.ndarray, lcp: np.ndarray, low: int, high: int) -> None:
        """Placed suffixes in order, each with its common prefix with the one before; low to high: symbols to be induced."""
        before = self.text[np.maximum(at - 1, 0)]
        own = np.flatnonzero((before >= low) & (before <= high) & (at > 0))
        whole = np.minimum.accumulate(lcp)
        if not len(own):
            np.minimum(self.least, whole[-1], out=self.least)
            return
        symbol = before[own]
        order = np.argsort(symbol, kind="stable")
        own, symbol = own[order], symbol[order]
        fresh = np.concatenate([[True], symbol[1:] != symbol[:-1]])
        heads = np.flatnonzero(fresh)
        found = np.empty(len(own), np.uint8)
        found[heads] = np.minimum(self.least[symbol[heads]], whole[own[heads]])
        rest = np.flatnonzero(~fresh)
        found[rest] = range_min(lcp, own[rest - 1] + 1, own[rest])
        found = np.minimum(found.astype(np.int16) + 1, self.cap).astype(np.uint8)
        found[heads[~self.any[symbol[heads]]]] = 0
        np.minimum(self.least, whole[-1], out=self.least)
        tails = own[np.concatenate([heads[1:] - 1, [len(own) - 1]])]
        behind = np.concatenate([np.minimum.accumulate(lcp[::-1])[::-1], [self.cap]])
        self.least[symbol[heads]] = behind[tails + 1]
        self.any[symbol[heads]] = True
        self.queue.push(symbol, at[own] - 1, found)


def range_min(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of x between two places each, both included."""
    out = np.empty(len(first), x.dtype)
    width = last - first + 1
    level, step = x, 1
    while len(left := np.flatnonzero(width >= step)):
        own = left[width[left] < 2 * step]
        out[own] = np.minimum(level[first[own]], level[last[own] - step + 1])
        if len(own) == len(left):
            break
        level = np.minimum(level[:-step], level[step:])
        step *= 2
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Symbols (of 16 bits) on which suffixes agree, up to a cap; text has its end, which is nowhere else, and three symbols to spare."""
    out = np.full(len(a), cap, np.int64)
    four = np.ndarray((len(text) - 3,), "<u8", buffer=text, strides=(2,))
    left, n = np.arange(len(a)), 0
    while len(left) and n < cap:
        apart = four[a[left] + n] ^ four[b[left] + n]
        end = np.flatnonzero(apart)
        more = sum(((apart[end] & np.uint64(mask)) == 0).astype(np.int64) for mask in (0xFFFF, 0xFFFFFFFF, 0xFFFFFFFFFFFF))
        out[left[end]] = n + more
        left = left[apart == 0]
        n += 4
    return np.minimum(out, cap).astype(np.uint8)


class _Level:
    """One string of the recursion: symbols from 1, with a 0 at the end."""

    def __init__(self, symbols: np.ndarray, folder: str):
        self.folder = folder
        n = len(symbols) + 1
        self.bits = int(max((symbols[i : i + CHUNK].max() for i in range(0, n - 1, CHUNK)), default=0)).bit_length() + 1
        self.per = max(1, 63 // self.bits)
        kind = np.uint16 if self.bits <= 16 else np.uint32 if self.bits <= 32 else np.uint64
        self.code, self.ahead = _array(folder, n, kind), _array(folder, n, np.int32 if n < 1 << 31 else np.int64)
        self.code[n - 1] = 1
        is_sample = _array(folder, n, bool)
        is_sample[n - 1] = True
        # From the end on, a piece at a time; equal neighbours take the type of what follows their run.
        after, after_grows = 0, True
        for i in range((n - 2) // CHUNK * CHUNK, -1, -CHUNK) if n > 1 else ():
            j = min(i + CHUNK, n - 1)
            t = np.append(symbols[i:j].astype(np.int64), after)
            step = np.sign(np.diff(t))
            known = np.where(step != 0, np.arange(j - i), j - i)
            grows = np.append(step, 1 if after_grows else -1)[np.minimum.accumulate(known[::-1])[::-1]] > 0
            self.code[i:j] = (t[:-1] << 1 | grows).astype(kind)
            is_sample[i + 1 : j] = grows[1:] & ~grows[:-1]
            if j < n - 1:
                is_sample[j] = after_grows and not grows[-1]
            after, after_grows = int(t[0]), bool(grows[0])
        m = sum(int(is_sample[i : i + CHUNK].sum()) for i in range(0, n, CHUNK))
        self.samples, seen = _array(folder, m, np.int64), 0
        for i in range(0, n, CHUNK):
            own = np.flatnonzero(is_sample[i : i + CHUNK])
            self.samples[seen : seen + len(own)] = own + i
            self.ahead[i : i + CHUNK] = np.minimum(seen + np.cumsum(is_sample[i : i + CHUNK]), m - 1)
            seen += len(own)

    def next_sample(self, at: np.ndarray) -> np.ndarray:
        """Index of the first sample behind each position; the end is its own."""
        return self.ahead[at]

    def word(self, at: np.ndarray, to: np.ndarray, skip: int) -> np.ndarray:
        """The next packed symbols up to and with the sample at `to`; zeros behind it."""
        out = np.zeros(len(at), np.uint64)
        for j in range(skip, skip + self.per):
            p = at + j
            own = np.where(p <= to, self.code[np.minimum(p, to)], 0).astype(np.uint64)
            out = out << np.uint64(self.bits) | own
        return out

    def order(self, places: np.ndarray | range, rank: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in order, in blocks, with a flag for the first of each group of equal ones.

        Without ranks of samples, equal means the same text up to the next sample.
        """
        queue = TupleQueue(self.folder)
        for i in range(0, len(places), CHUNK):
            at = np.asarray(places[i : i + CHUNK])
            queue.push(self.word(at, self.samples[self.next_sample(at)], 0), at)
        for word, at in queue.drain():
            if len(at):
                yield self._resolved(word, at, rank)

    def _resolved(self, word: np.ndarray, at: np.ndarray, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        head = np.concatenate([[True], word[1:] != word[:-1]])
        at = at.copy()
        nxt = self.next_sample(at)
        to, skip = self.samples[nxt], self.per
        while True:
            alone = head & np.concatenate([head[1:], [True]])
            left = np.flatnonzero(~alone & (to - at >= skip))
            if not len(left):
                break
            group = np.cumsum(head)[left]
            w = self.word(at[left], to[left], skip)
            order = np.lexsort((w, group))
            at[left], to[left] = at[left[order]], to[left[order]]
            w = w[order]
            head[left[1:]] |= (w[1:] != w[:-1]) & (group[1:] == group[:-1])
            skip += self.per
        if rank is not None:
            alone = head & np.concatenate([head[1:], [True]])
            left = np.flatnonzero(~alone)
            if len(left):
                group = np.cumsum(head)[left]
                r = rank[self.next_sample(at[left])]
                order = np.lexsort((r, group))
                at[left] = at[left[order]]
                head[left] = True
        return at, head

    def ranks(self) -> np.ndarray:
        """The rank of each sample's suffix."""
        m = len(self.samples)
        names, last = _array(self.folder, m, np.int64), 0
        for at, head in self.order(self.samples[:-1], None):
            name = last + np.cumsum(head)
            names[self.ahead[at] - 1] = name
            last = int(name[-1])
        if last == m - 1:
            return names  # the end has 0
        below = _Level(names[:-1], self.folder)
        rank = _array(self.folder, m, np.int64)
        below_rank = below.ranks()
        i = 1
        for at, _ in below.order(range(m - 1), below_rank):
            rank[at] = np.arange(i, i + len(at))
            i += len(at)
        return rank


def sorted_suffixes(symbols: np.ndarray, cap: int, held: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of suffixes in descending order, in blocks, each with its common prefix with the one before, up to a cap below 255.

    symbols: integers from 1 on. Files lie in a temporary folder of the process, which goes at the end.
    """
    if not len(symbols):
        return
    folder = tempfile.mkdtemp(prefix="suffixes-")
    try:
        yield from _induced(symbols, cap, held or HELD, folder)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _induced(symbols: np.ndarray, cap: int, held: int, folder: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    level = _Level(symbols, folder)
    rank, n = level.ranks(), len(symbols)
    text = _array(folder, n + 4, np.uint16)
    count = 1
    for i in range(0, n, CHUNK):
        text[i : min(i + CHUNK, n)] = symbols[i : i + CHUNK]
        count = max(count, int(symbols[i : i + CHUNK].max()) + 1)

    stars = Buckets(count, folder, held)
    ordered = _array(folder, len(rank), np.int64)
    for i in range(0, len(rank), CHUNK):
        ordered[rank[i : i + CHUNK]] = level.samples[i : i + CHUNK]
    del level, rank
    for i in range(0, len(ordered), CHUNK):
        at = np.asarray(ordered[i : i + CHUNK])
        before = np.asarray(ordered[max(0, i - 1) : i + len(at) - 1])
        lcp = common_prefix(text, at[len(at) - len(before) :], before, cap)
        stars.push(np.asarray(text[at]), at, np.concatenate([np.zeros(len(at) - len(before), np.uint8), lcp]))

    def run(at: int) -> int:
        """How often a suffix repeats its first symbol, up to the cap."""
        own = np.asarray(text[at : min(at + cap, n + 1)])
        other = np.flatnonzero(own != own[0])
        return int(other[0]) if len(other) else min(cap, len(own))

    placed, smaller = Buckets(count, folder, held), Buckets(count, folder, held)
    inducer = Inducer(text, count, cap, smaller)
    for c in range(count):
        last = None
        while (block := smaller.pop(c)) is not None:
            at, lcp = block
            placed.push(np.full(len(at), c), at, lcp)
            inducer.take(at, lcp, c, count)
            last = int(at[-1])
        first = True
        while (block := stars.pop(c)) is not None:
            at, lcp = block
            if first:  # an L and an S suffix agree on the shorter run of their first symbol
                lcp = lcp.copy()
                lcp[0] = 0 if last is None else min(run(last), run(int(at[0])))
                first = False
            inducer.take(at, lcp, c + 1, count)

    larger = Buckets(count, folder, held)
    inducer = Inducer(text, count, cap, larger)
    for c in range(count - 1, -1, -1):
        last = None
        while (block := larger.pop(c)) is not None:
            at, lcp = block
            yield at, lcp
            inducer.take(at, lcp, 1, c)
            last = int(at[-1])
        carried = None
        while (block := placed.pop(c, last=True)) is not None:
            at, own = block[0][::-1], block[1][::-1]
            if carried is None:
                carried = 0 if last is None else min(run(last), run(int(at[0])))
            lcp = np.concatenate([[carried], own[:-1]]).astype(np.uint8)
            yield at, lcp
            inducer.take(at, lcp, 1, c - 1)
            carried = int(own[-1])


