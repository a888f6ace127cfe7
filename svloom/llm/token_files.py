"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

A file holds whole documents in ascending order of doc_id. Its ids are replaced by their rank
by frequency in the file, so common ids take one byte; the byte lengths (1 to 4) stand apart
in control bytes of four 2-bit codes each. Decoding looks up each control byte in a table of
lengths and gathers the data bytes, all in numpy.

Layout, little-endian: 8 bytes magic; 6 counts of 8 bytes (documents, ids, ranked ids, data
bytes, documents without a doc_id, which come first, ids in earlier files of the part); doc_ids and ids by
document (8 bytes each); the ids by rank (4 bytes each); control bytes; data bytes.

The range of doc_ids is cut into parts, and a part into files; where a document's ids start among all follows
from its file, what lies before it in its part, and the parts' totals, so no list of files is gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.llm.common import bounded_batches, key_bounds, part_count, whole_text
from svloom.llm.tokenizing import by_chars, encoder

MAGIC = b"RANKVB2\n"
#: A file is ended by the document that takes it over so many ids.
FILE_IDS = 1 << 22
#: Documents that go back to Spark at once.
ROWS = 4096
#: Lengths of four codes by control byte.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.int64) + 1


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, nulls: int = 0, before: int = 0) -> bytes:
    """One file's bytes; the first doc_ids, so many as nulls, stand for none."""
    values, seen = np.unique(ids, return_counts=True)
    by_rank = values[np.lexsort((values, -seen))].astype("<u4")
    rank_of = np.zeros(int(values.max()) + 1 if len(values) else 1, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = rank_of[ids] if len(ids) else np.zeros(0, np.uint32)
    codes = ((ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    quads = np.zeros((len(codes) + 3) // 4 * 4, np.uint8)
    quads[: len(codes)] = codes
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= codes[:, None]]
    head = np.array([len(doc_ids), len(ids), len(by_rank), len(data), nulls, before], dtype="<i8")
    return b"".join([MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), by_rank.tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()])


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """doc_ids, ids by document and all ids of a file; how many doc_ids are none, and the ids before it in its part."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id file")
    docs, n, ranked, size, nulls, before = (int(x) for x in np.frombuffer(data, "<i8", 6, len(MAGIC)))
    at = len(MAGIC) + 48
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    counts = np.frombuffer(data, "<i8", docs, at := at + 8 * docs)
    by_rank = np.frombuffer(data, "<u4", ranked, at := at + 8 * docs)
    control = np.frombuffer(data, np.uint8, (n + 3) // 4, at := at + 4 * ranked)
    body = np.frombuffer(data, np.uint8, size, at + len(control))
    lengths = LENGTHS[control].reshape(-1)[:n]
    starts = np.cumsum(lengths) - lengths
    ranks = body[starts].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        ranks[more] |= body[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return doc_ids, counts, by_rank[ranks] if n else ranks, nulls, before


def _seats(spark, n: int) -> np.ndarray:
    """For each of n parts a key that repartition(n) sends to a task of its own."""
    rows = spark.range(40 * n).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect()
    found = {r["p"]: r["k"] for r in rows}
    return np.array([found.get(p, 40 * n + p) for p in range(n)], np.int32)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end: int, bounds: np.ndarray, seats: np.ndarray) -> Iterator[pa.RecordBatch]:
    enc, press = encoder(path), zstandard.ZstdCompressor(level=1)
    tail = np.array([end], enc.width).tobytes()
    for b in batches:
        rows, texts = b.column(0), b.column(1).to_pylist()
        for part in by_chars(texts):
            ids = rows[part].cast(pa.int64())
            at = np.searchsorted(bounds, ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="left")
            yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), pa.array(seats[at]), pa.array([press.compress(x + tail) for x in enc.encode_all(texts[part])], pa.binary())], names=["doc_id", "part", "seat", "ids"])


def _put(root: str, name: str, data: bytes) -> None:
    """Whole or not at all: a task that runs again writes the same bytes under the same name."""
    where, folder = fs.FileSystem.from_uri(root)
    context = TaskContext.get()
    own = f"{folder}/_{name}.{context.taskAttemptId() if context else 0}"
    with where.open_output_stream(own) as f:
        f.write(data)
    try:
        where.move(own, f"{folder}/{name}")
    except OSError:  # not every file system replaces a file, as one that an earlier attempt wrote
        where.delete_file(f"{folder}/{name}")
        where.move(own, f"{folder}/{name}")


def _name(part: int, seq: int) -> str:
    return f"ids-{part:06d}-{seq:06d}.rvb"


def _part(name: str) -> int:
    return int(name.rsplit("/", 1)[-1].split("-")[1])


def _written(batches: Iterator[pa.RecordBatch], root: str, file_ids: int, width: str) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdDecompressor()
    now, seq, held, size, before = None, 0, [], 0, 0
    done: list[tuple[int, int]] = []

    def close() -> None:
        nonlocal held, size, seq, before
        if held:
            counts = np.array([len(x) for _, x in held], np.int64)
            nulls = sum(d is None for d, _ in held)
            _put(root, _name(now, seq), pack(np.array([d or 0 for d, _ in held], np.int64), counts, np.concatenate([x for _, x in held]), nulls, before))
            done.append((now, int(counts.sum())))
            held, size, seq, before = [], 0, seq + 1, before + int(counts.sum())

    for b in batches:
        for doc, part, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "part", "ids")), strict=True):
            if part != now:
                close()
                now, seq, before = part, 0, 0
            held.append((doc, np.frombuffer(press.decompress(ids), width)))
            if (size := size + len(held[-1][1])) >= file_ids:
                close()
    close()
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else ([], []), (pa.int32(), pa.int64()), strict=True)], names=["part", "n_ids"])


def write_ids(docs: DataFrame, path: str, end: int, root: str, file_ids: int = FILE_IDS) -> dict[int, int]:
    """Writes all documents' ids, each ended by the id end, to files in the folder root.

    Returns the ids of each part of the range; there are 4,096 parts at most. A null text is an empty one: it has
    the end id only. Documents of equal doc_id are ordered by their ids; null doc_ids come first. Other columns
    are left out.
    """
    spark = docs.sparkSession
    where, folder = fs.FileSystem.from_uri(root)
    where.create_dir(folder, recursive=True)
    n = part_count(spark)
    bounds, seats, width = key_bounds(docs, "doc_id", n), _seats(spark, n), encoder(path).width
    rows = bounded_batches(docs).select("doc_id", whole_text().alias("text")).mapInArrow(lambda it: _encoded(it, path, end, bounds, seats), "doc_id long, part int, seat int, ids binary")
    ordered = rows.repartition(n, "seat").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    files = ordered.mapInArrow(lambda it: _written(it, root, file_ids, width), "part int, n_ids long")
    return {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}


def _doc_ids(doc_ids: np.ndarray, nulls: int) -> pa.Array:
    return pa.array(doc_ids, pa.int64(), mask=np.arange(len(doc_ids)) < nulls)


def _files(spark, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.rvb").load(root).select("path", "content")


def read_ids(spark, root: str) -> DataFrame:
    """file, doc_id, at (place of the document in its file), ids: the files' documents, read back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids, counts, ids, nulls, _ = unpack(data.as_py())
                cuts = np.concatenate([[0], np.cumsum(counts)])
                for i in range(0, len(doc_ids), ROWS):
                    j = min(i + ROWS, len(doc_ids))
                    own = pa.ListArray.from_arrays(pa.array((cuts[i : j + 1] - cuts[i]).astype(np.int32)), pa.array(ids[cuts[i] : cuts[j]].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]] * (j - i)), _doc_ids(doc_ids[i:j], max(0, nulls - i)), pa.array(np.arange(i, j)), own], names=["file", "doc_id", "at", "ids"])

    return _files(spark, root).mapInArrow(work, "file string, doc_id long, at long, ids array<int>")


def read_digests(spark, root: str, parts: dict[int, int]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files; parts: what write_ids gave."""
    begins, total = {}, 0
    for part in sorted(parts):
        begins[part] = total
        total += parts[part]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids, counts, ids, nulls, before = unpack(data.as_py())
                ends = np.cumsum(counts)
                crcs = [zlib.crc32(ids[e - c : e].astype("<u4")) for e, c in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([_doc_ids(doc_ids, nulls), pa.array(ends - counts + before + begins[_part(name)]), pa.array(counts), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    if not parts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return _files(spark, root).mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
