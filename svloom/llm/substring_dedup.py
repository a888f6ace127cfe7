"""Suffix-array dedup: bytes of strings of LENGTH that also start earlier are removed.

Each string of LENGTH bytes has an anchor: the gram of GRAM bytes of the least hash in it. Equal strings
have equal anchors, so strings are dealt to shards by their anchor's hash and no match is lost. Neighbouring
strings with one anchor make a run of at most LENGTH - GRAM + 1 strings; their bytes are its context.

1. Of runs with equal contexts (by two 64-bit digests), the first in (doc_id, start) speaks for all; every string of
   the others starts earlier there. A string holds the SIDE bytes left of its anchor's gram or those right of it,
   so a context that shares neither with another one of its anchor has no string in common with any, and is done.
2. The other contexts are gathered by anchor, and each shard's suffixes sorted by external induced sorting
   (suffix_array), which carries common prefixes. Neighbours that agree over LENGTH bytes are equal strings;
   all but the first of equal strings start earlier elsewhere.
3. Strings found become spans of bytes, united by document.

An anchor of more than HOT contexts is split: its strings go by how far into them the anchor lies, STEP places
at a time, and by a hash of the bytes around the anchor that all strings of these places hold. So equal strings stay
together, and contexts that differ there part. A shard that still exceeds memory is sorted from disk.

Null texts count as empty; matches never cross documents. Where doc_ids repeat or are null, rows count as
documents in the order of doc_id, nulls first, and of one doc_id in an order of their texts. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.llm.common import bounded_batches, saved, whole_text
from svloom.llm.sharding import numbered
from svloom.llm.suffix_array import sorted_suffixes

LENGTH, GRAM = 100, 16
#: Bytes beside an anchor's gram: strings in which it begins at most LEFT bytes in hold those right of it, all others those left of it.
SIDE, LEFT = 40, 42
#: Contexts of one anchor that are compared by their sides; of an anchor with more, all are gathered.
COMPARED = 1 << 18
#: Bits of an anchor's place in a buffer; the rest of the word is its hash, on which strings choose.
PLACE_BITS = 31
#: Bytes of documents that are handled at once; a document is never cut.
BUFFER = 4 << 20
#: Bytes of contexts that are sorted together, as long as whole anchors fit.
SHARD = 4 << 20
#: Strings that are united to spans at once.
FOUND = 1 << 20
#: An anchor of more contexts is split by STEP places of it.
HOT, STEP = 4096, 22
#: Hot anchors (8 bytes each) that may be broadcast.
BROADCAST_ANCHORS = 100_000
#: Bytes of spans that may be broadcast; beyond, the join is by shuffle.
BROADCAST_BYTES = 16 << 20

RUNS = "anchor long, digest long, check long, row long, start int, n short, sides long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on; data must have 8 to spare."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def _grams(eight: np.ndarray, n: int) -> np.ndarray:
    """The hashes of the grams at the first n places."""
    return _mix(eight[:n] * np.uint64(0x9E3779B97F4A7C15) + _mix(eight[8 : n + 8]))


def _side(eight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Digests of 32 bits, above 0, of the SIDE bytes from each place on."""
    out = np.zeros(len(at), np.uint64)
    for k in range(0, SIDE, 8):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + eight[at + k])
    return out >> np.uint64(32) | np.uint64(1)


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents one after the other: begin and strings of each run, its anchor's hash, context's two digests and sides.

    Sides: digests of what lies right (upper half) and left of the anchor, 0 where no string of the run needs that one.
    """
    total = int(ends[-1]) if len(ends) else 0
    none = np.zeros(0, np.int64)
    if total < LENGTH:
        return none, none, *[none.view(np.uint64)] * 4
    padded = np.concatenate([data, np.zeros(LENGTH + 16, np.uint8)])
    eight = _words(padded)
    full = _grams(eight, total)
    least = full & ~np.uint64((1 << PLACE_BITS) - 1) | np.arange(total, dtype=np.uint64)
    grams, width = LENGTH - GRAM + 1, 1
    while 2 * width <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: total - LENGTH + 1], least[grams - width : grams - width + total - LENGTH + 1])
    place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    # The last LENGTH - 1 positions of a document begin no string.
    back = np.minimum(np.diff(np.concatenate([[0], ends])), LENGTH - 1)
    mark = np.zeros(total + 1, np.int32)
    np.add.at(mark, ends - back, 1)
    np.add.at(mark, ends, -1)
    own = np.cumsum(mark)[: len(place)] == 0
    fresh = own.copy()
    fresh[1:] &= ~own[:-1] | (place[1:] != place[:-1])
    begin = np.flatnonzero(fresh)
    stop = np.flatnonzero(own & np.concatenate([~own[1:] | fresh[1:], [True]])) + 1
    n = stop - begin
    size = n + LENGTH - 1
    digest, check = _mix(size.astype(np.uint64)), _mix(size.astype(np.uint64) + np.uint64(0xA0761D6478BD642F))
    for k in range(0, LENGTH + grams, 8):
        left = np.clip(size - k, 0, 8)
        live = np.flatnonzero(left > 0)
        if not len(live):
            break
        word = eight[begin[live] + k]
        cut = left[live]
        word = np.where(cut < 8, word & ((np.uint64(1) << (cut % 8 * 8).astype(np.uint64)) - np.uint64(1)), word)
        digest[live] = _mix(digest[live] * np.uint64(0x9E3779B97F4A7C15) + word)
        check[live] = _mix((check[live] ^ word) * np.uint64(0xE7037ED1A0B428DB))
    sides, at = np.zeros(len(begin), np.uint64), place[begin]
    right, left = np.flatnonzero(at - stop + 1 <= LEFT), np.flatnonzero(at - begin > LEFT)
    sides[right] = _side(eight, at[right] + GRAM) << np.uint64(32)
    sides[left] |= _side(eight, at[left] - SIDE)
    return begin, n, full[at], digest, check, sides


def _buffers(rows: np.ndarray, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, bytes and ends of some documents at a time."""
    at = held = 0
    for i, t in enumerate([*texts, None]):
        if t is None or held and held + len(t) > BUFFER:
            if i > at:
                part = texts[at:i]
                yield rows[at:i], np.frombuffer(b"".join(part), np.uint8), np.cumsum([len(x) for x in part])
            at, held = i, 0
        held += len(t or b"")


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows, data, ends in _buffers(b.column(0).to_numpy(), b.column(1).to_pylist()):
            begin, n, anchor, digest, check, sides = runs(data, ends)
            doc = np.searchsorted(ends, begin, side="right")
            start = begin - np.concatenate([[0], ends[:-1]])[doc] if len(begin) else begin
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(check.view(np.int64)), pa.array(rows[doc] if len(doc) else np.zeros(0, np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(sides.view(np.int64))], names=["anchor", "digest", "check", "row", "start", "n", "sides"])


def _alike(group: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Whether a context shares a side with another one of its group."""
    out = np.zeros(len(group), bool)
    for side in (sides >> np.uint64(32), sides & np.uint64(0xFFFFFFFF)):
        own = np.flatnonzero(side)
        key = group[own].astype(np.uint64) << np.uint64(32) | side[own]
        order = np.argsort(key, kind="stable")
        equal = key[order[1:]] == key[order[:-1]]
        out[own[order[1:][equal]]] = out[own[order[:-1][equal]]] = True
    return out


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs come sorted by anchor, digests, row and start. Goes out: later runs of a context (first = false), and the
    first runs of contexts that share a side with another one of their anchor (first = true)."""
    names = ["anchor", "row", "start", "n", "first"]
    before: tuple[int, int, int] | None = None
    waiting: list[list[np.ndarray]] = []  # first runs of the contexts of the last anchor so far
    held, all_go = 0, False  # how many these are; whether there were too many to compare

    def out(columns: list[np.ndarray], first: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, columns[:4]), pa.array(np.full(len(columns[0]), first))], names=names)

    def compared(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        group = np.cumsum(np.concatenate([[False], columns[0][1:] != columns[0][:-1]]))
        at = np.flatnonzero(_alike(group, columns[4].view(np.uint64)))
        return out([c[at] for c in columns], True)

    for b in batches:
        if not b.num_rows:
            continue
        anchor, digest, check, row, start, n, sides = (c.to_numpy() for c in b.columns)
        fresh = np.concatenate([[before is None or before[0] != anchor[0]], anchor[1:] != anchor[:-1]])
        head = fresh | np.concatenate([[before is None or before[1:] != (digest[0], check[0])], (digest[1:] != digest[:-1]) | (check[1:] != check[:-1])])
        before = (int(anchor[-1]), int(digest[-1]), int(check[-1]))
        columns = [anchor, row, start, n, sides]
        yield out([c[~head] for c in columns], False)
        # Up to the first fresh row, the last anchor goes on; from the last fresh row on, its anchor may go on.
        starts = np.flatnonzero(fresh)
        cut, end = (starts[0], starts[-1]) if len(starts) else (b.num_rows, 0)
        goes_on = np.flatnonzero(head[:cut])
        if all_go:
            yield out([c[goes_on] for c in columns], True)
        elif len(goes_on):
            waiting.append([c[goes_on] for c in columns])
            held += len(goes_on)
        if len(starts):
            whole = cut + np.flatnonzero(head[cut:end])
            waiting.append([c[whole] for c in columns])
            yield compared(waiting)
            last = end + np.flatnonzero(head[end:])
            waiting, held, all_go = [[c[last] for c in columns]], len(last), False
        if held > COMPARED:
            for part in waiting:
                yield out(part, True)
            waiting, held, all_go = [], 0, True
    if waiting:
        yield compared(waiting)


def _places(anchors: list[int], contexts: list[bytes]) -> list[int]:
    """Where each context's anchor begins: its first gram of that hash."""
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    base = np.cumsum(size) - size
    data = np.concatenate([np.frombuffer(b"".join(contexts), np.uint8), np.zeros(16, np.uint8)])
    n = len(data) - 16
    hit = np.flatnonzero(_grams(_words(data), n) == np.repeat(np.array(anchors, np.int64).view(np.uint64), size))
    owner = np.searchsorted(base, hit, side="right") - 1
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    return (hit[first] - base[owner[first]]).tolist()


def _split(row: int, start: int, n: int, context: bytes, anchor: int, place: int) -> Iterator[tuple]:
    """A run of a hot anchor as runs of its own deals."""
    for low in range(0, LENGTH - GRAM + 1, STEP):
        high = low + STEP - 1  # strings in which the anchor lies low to high bytes in
        i, j = max(0, place - high), min(n - 1, place - low)
        if i <= j:
            common = context[place - low : place + LENGTH - high]
            deal = xxhash.xxh64_intdigest(common, (anchor + low) & ((1 << 64) - 1))
            yield deal - (1 << 63), row, start + i, j - i + 1, context[i : j + LENGTH]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.binary())
    for b in batches:
        out: list[tuple] = []
        hot: list[tuple] = []
        for row, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            for r in own:
                (hot if r["hot"] else out).append((r["anchor"], row, r["start"], r["n"], text[r["start"] : r["start"] + r["n"] + LENGTH - 1]))
        if hot:
            for (anchor, row, start, n, context), place in zip(hot, _places([x[0] for x in hot], [x[4] for x in hot]), strict=True):
                out += _split(row, start, n, context, anchor, place)
        for i in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 20_000], strict=True), kinds, strict=True)], names=["deal", "row", "start", "n", "context"])


class Shard:
    """Contexts one after the other as symbols (1 between them, a byte plus 2 in them), in files if there are many."""

    def __init__(self) -> None:
        self.held: list[pa.RecordBatch] = []
        self.size = self.waiting = 0
        self.folder: str | None = None

    def add(self, b: pa.RecordBatch, size: int) -> None:
        self.held.append(b)
        self.size += size
        self.waiting += size
        if self.waiting >= 4 * SHARD:
            self._flush()

    def _arrays(self, begin: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of what is held, and row, start, strings and first symbol of each context."""
        t = pa.Table.from_batches(self.held)
        contexts = t["context"].to_pylist()
        data = np.frombuffer(b"".join(contexts), np.uint8)
        size = np.fromiter(map(len, contexts), np.int64, len(contexts))
        symbols = np.ones(len(data) + len(size), np.uint16)
        symbols[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data.astype(np.uint16) + 2
        at = begin + np.cumsum(size + 1) - size - 1
        return symbols, np.stack([t["row"].to_numpy(), t["start"].to_numpy().astype(np.int64), t["n"].to_numpy().astype(np.int64), at], axis=1)

    def _flush(self) -> None:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="shard-")
        texts, runs = os.path.join(self.folder, "text"), os.path.join(self.folder, "runs")
        begin = os.path.getsize(texts) // 2 if os.path.exists(texts) else 0
        for name, x in zip((texts, runs), self._arrays(begin), strict=True):
            with open(name, "ab") as f:
                f.write(x.tobytes())
        self.held, self.waiting = [], 0

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        if self.folder is None:
            return self._arrays(0)
        if self.held:
            self._flush()
        return np.memmap(os.path.join(self.folder, "text"), np.uint16, "r"), np.memmap(os.path.join(self.folder, "runs"), np.int64, "r").reshape(-1, 4)

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


def shared_strings(shard: Shard) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and start of the strings of LENGTH that start earlier in another of these contexts."""
    symbols, known = shard.arrays()
    row, start, n, begin = (np.asarray(known[:, k]) for k in range(4))
    first: tuple[int, int] | None = None  # of the last group, which may go on
    for at, lcp in sorted_suffixes(symbols, LENGTH):
        own = np.searchsorted(begin, at, side="right") - 1
        offset = at - begin[own]
        group = np.cumsum(lcp < LENGTH)  # 0 goes on with the last one
        keep = np.flatnonzero(offset < n[own])
        g, r, s = group[keep], row[own[keep]], start[own[keep]] + offset[keep]
        if first is not None:
            g, r, s = np.append(g, 0), np.append(r, first[0]), np.append(s, first[1])
        order = np.lexsort((s, r, g))
        g, r, s = g[order], r[order], s[order]
        head = np.concatenate([[True], g[1:] != g[:-1]])[: len(g)]
        yield r[~head], s[~head]
        last = np.searchsorted(g, group[-1])
        first = (int(r[last]), int(s[last])) if last < len(g) else None


def _spans(row: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans united by row."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], start[order] + size[order]
    if not len(row):
        return row, start, end
    # Ends as of a key that grows from row to row, so that a running maximum stays within a row.
    base = (np.cumsum(np.concatenate([[0], (row[1:] != row[:-1]).astype(np.int64)]))) << 33
    reach = np.maximum.accumulate(base + end)
    head = np.concatenate([[True], base[1:] + start[1:] > reach[:-1]])
    heads = np.flatnonzero(head)
    last = np.concatenate([heads[1:], [len(row)]]) - 1
    return row[heads], start[heads], (reach - base)[last]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts come sorted by deal; a shard is ended between deals."""

    def united(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        row, start = (np.concatenate(x) for x in zip(*found, strict=True))
        row, start, end = _spans(row, start, np.full(len(row), LENGTH))
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["row", "start", "end"])

    def out(shard: Shard) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        try:
            for x in shared_strings(shard) if shard.size else ():
                if len(x[0]):
                    found.append(x)
                    size += len(x[0])
                if size >= FOUND:
                    yield united(found)
                    found, size = [], 0
            if found:
                yield united(found)
        finally:
            shard.close()

    shard, last = Shard(), None
    for b in batches:
        if not b.num_rows:
            continue
        deal = b.column(0).to_numpy()
        ends = [*(np.flatnonzero(deal[1:] != deal[:-1]) + 1).tolist(), b.num_rows]
        lens = np.concatenate([[0], np.cumsum(np.fromiter(map(len, b.column(4).to_pylist()), np.int64, b.num_rows))])
        if shard.size >= SHARD and last != deal[0]:
            yield from out(shard)
            shard = Shard()
        at = 0
        for end in ends:
            if shard.size + lens[end] - lens[at] >= SHARD and end < b.num_rows:
                shard.add(b.slice(at, end - at), int(lens[end] - lens[at]))
                yield from out(shard)
                shard, at = Shard(), end
        shard.add(b.slice(at), int(lens[-1] - lens[at]))
        last = deal[-1]
    yield from out(shard)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(1)
        flat, offsets = lists.flatten(), lists.offsets.to_numpy()
        at = np.repeat(np.arange(b.num_rows), np.diff(offsets))
        begin, stop = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
        row, start, end = _spans(at, begin, stop - begin)
        n = np.bincount(row, minlength=b.num_rows)
        cut = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(cut, pa.array(start.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(end.astype(np.int32)))], names=["row", "starts", "ends"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """row, starts and ends (united, ascending) of the bytes to remove; texts: row (unique long) and text."""
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = texts.select("row", whole_text().cast("binary").alias("text"))
    dealt = data.mapInArrow(_run_rows, RUNS).repartition(n, "anchor").sortWithinPartitions("anchor", "digest", "check", "row", "start")
    found = saved(dealt.mapInArrow(_classes, "anchor long, row long, start int, n short, first boolean"), "runs")
    first = found.where("first").select("anchor", "row", "start", "n")
    hot = saved(first.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot")), "hot-anchors")
    few = hot.limit(BROADCAST_ANCHORS + 1).count() <= BROADCAST_ANCHORS
    marked = first.join(F.broadcast(hot) if few else hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    asked = marked.groupBy("row").agg(F.collect_list(F.struct("anchor", "start", "n", "hot")).alias("runs"))
    contexts = data.join(asked, "row").select("row", "text", "runs").mapInArrow(_contexts, "deal long, row long, start int, n short, context binary")
    strings = contexts.repartition(n, "deal").sortWithinPartitions("deal").mapInArrow(_shards, "row long, start int, end int")
    whole = found.where("not first").select("row", "start", F.expr(f"cast(start + n + {LENGTH - 1} as int)").alias("end"))
    spans = whole.unionByName(strings).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return spans.mapInArrow(_united, "row long, starts array<int>, ends array<int>")


def _numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id and text; row orders the documents."""
    plain = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    clash = plain.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if clash.isEmpty():
        return plain.select(F.col("doc_id").alias("row"), "doc_id", "text")
    return saved(numbered(plain, "doc_id", ["text"], "row")[0].select("row", "doc_id", "text"), "numbered")


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), starts and ends (null without any) of each row of docs."""
    texts = _numbered(docs)
    spans = saved(repeated_spans(texts), "spans")
    size = spans.agg(F.sum(8 * F.size("starts") + 40).alias("s")).first()["s"] or 0
    spans = F.broadcast(spans) if size <= BROADCAST_BYTES else spans
    return texts.join(spans, "row", "left").select("doc_id", whole_text().alias("text"), "starts", "ends")


def _cut(data: bytes, starts: list[int] | None, ends: list[int] | None) -> bytes:
    if not starts:
        return data
    return b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)], strict=True))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id and kept, the remaining bytes of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [_cut(t.encode(), s, e) for t, s, e in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary())], names=["doc_id", "kept"])

    return with_spans(docs).mapInArrow(work, "doc_id long, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, spans, kept = [], [], [], []
            for t, s, e in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                data = t.encode()
                n.append(len(data))
                gone.append(sum(e) - sum(s) if s else 0)
                spans.append(len(s or []))
                kept.append(hashlib.sha256(_cut(data, s, e)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in (n, gone, spans)], pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs).mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
