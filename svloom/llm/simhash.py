"""SimHash near-duplicates: pigeonhole blocks, Hamming verification, connected components.

A fingerprint's 64 bits are cut into six blocks. Two fingerprints that differ in three bits at
most agree on three blocks at least, so each of the 20 choices of three blocks is a table to
join on. Equal fingerprints are one node from the start. What shares a table's key is verified
within its task, where a spanning star for each linked set stands for its pairs, so groups of
copies cost rows in proportion to their size; no bucket is capped.

Null and empty texts have fingerprint zero and are linked like any other; a group whose doc_ids
are all null has a null component_id; repeated rows are linked to each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from svloom.llm.common import P, bounded_batches, saved, whole_text

SHINGLE, SEED, DISTANCE = 3, 42, 3
WIDTHS = (11, 11, 11, 11, 10, 10)
#: Above so many fingerprints under one key, they are split by their own varying bits.
DIRECT = 2048
_PIECE = 1 << 15


def _masks() -> list[int]:
    starts = np.cumsum((0, *WIDTHS))
    blocks = [((1 << w) - 1) << int(s) for w, s in zip(WIDTHS, starts, strict=False)]
    return [sum(c) for c in combinations(blocks, len(WIDTHS) - DISTANCE)]


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a whole text."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(shingle, len(words))
    ends = ends[span - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(ends), _PIECE):
        part = ends[i : i + _PIECE]
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + len(part)].tolist(), part.tolist(), strict=True)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(ends)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (a long of the same bits) for each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made)], names=["doc_id", "fingerprint"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(work, "doc_id long, fingerprint long")


def _merge(x: np.ndarray, root: np.ndarray, at: np.ndarray) -> None:
    """Joins in root, a union-find forest, all linked fingerprints among x[at]."""

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if len(at) > DIRECT:
        bits = [k for k in range(64) if (np.uint64(1) << np.uint64(k)) & np.bitwise_or.reduce(x[at] ^ x[at[0]])]
        for j in range(DISTANCE + 1):  # one of these parts is equal in a linked pair
            mask = np.uint64(sum(1 << k for k in bits[j :: DISTANCE + 1]))
            part = x[at] & mask
            order = np.argsort(part, kind="stable")
            for own in np.split(at[order], np.flatnonzero(np.diff(part[order])) + 1):
                if len(own) > 1:
                    _merge(x, root, own)
        return
    left = at
    while len(left):  # each linked set is gathered from its first member on
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(x[left] ^ x[i]) <= DISTANCE
            for j in left[near]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
                queue.append(j)
            left = left[~near]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; each key's linked sets go out as (least, other) pairs."""

    def links(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(x)]])
        size = ends - begins
        two = begins[size == 2]
        two = two[np.bitwise_count(x[two] ^ x[two + 1]) <= DISTANCE]
        a, b = [x[two]], [x[two + 1]]
        for i, j in zip(begins[size > 2], ends[size > 2], strict=True):
            own = x[i:j]
            root = np.arange(len(own))
            _merge(own, root, np.arange(len(own)))
            for k in range(len(own)):
                root[k] = root[root[k]]  # roots lie before their members
            child = np.flatnonzero(root != np.arange(len(own)))
            a.append(own[root[child]])
            b.append(own[child])
        return np.concatenate(a), np.concatenate(b)

    def out(key: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        a, b = links(key, x)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []  # of one key, as it comes
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        x = batch.column(2).to_numpy().view(np.uint64)
        if held and (held[0][0][0] == key[-1]).all():
            held.append((key, x))
            continue
        whole = np.flatnonzero(np.any(key != key[-1], axis=1))
        end = whole[-1] + 1 if len(whole) else 0
        parts = [*held, (key[:end], x[:end])]
        if sum(len(p[1]) for p in parts):
            yield out(np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts]))
        held = [(key[end:], x[end:])]
    if held:
        yield out(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))


def linked_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that span all linked sets; nodes has them in fingerprint."""
    spark = nodes.sparkSession
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("m")) for i, m in enumerate(_masks())])
    keyed = nodes.select("fingerprint", F.explode(masks).alias("k")).select(F.col("k.t").cast("long").alias("t"), F.col("fingerprint").bitwiseAND(F.col("k.m")).alias("key"), "fingerprint")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "t", "key").sortWithinPartitions("t", "key", "fingerprint").mapInArrow(_stars, "a long, b long").distinct()


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (least node of its component) for every node in pairs (a, b).

    Alternating large-star and small-star steps; each round's edges are written to the shared
    folder. Rounds grow as the logarithm of the longest chain.
    """
    edges = saved(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        edges = saved(small, "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, root (a fingerprint that names the component) and component_id for each row of docs."""
    marks = saved(fingerprints(docs), "fingerprints")
    nodes = marks.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    roots = components(linked_pairs(nodes.select("fingerprint")))
    placed = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return marks.join(placed.join(least, "root").select("fingerprint", "root", "component_id"), "fingerprint").select("doc_id", "fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (long) and component_id for each row of docs."""
    return _grouped(docs).select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the least doc_id, nulls last, then of the least text.

    Groups are told by their fingerprints alone: rows that share a doc_id, or have none, but aren't
    linked are kept each.
    """
    found = saved(_grouped(docs), "near-duplicates")
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        ids = first.select(F.col("doc_id").alias(f"{P}id")).distinct()
        return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(f"{P}id")), "left_semi")
    groups = first.select(F.col("fingerprint").alias(f"{P}fp"), F.col("root").alias(f"{P}root"), F.col("component_id").alias(f"{P}least")).distinct()
    own = _with_fingerprint(docs).join(groups, f"{P}fp").where(F.col("doc_id").cast("long").eqNullSafe(F.col(f"{P}least")))
    by_group = Window.partitionBy(f"{P}root").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    return own.select(*docs.columns, F.row_number().over(by_group).alias(f"{P}n")).where(f"{P}n = 1").select(*docs.columns)


def _with_fingerprint(docs: DataFrame) -> DataFrame:
    """docs with each row's fingerprint in a column of an internal prefix."""
    rows = bounded_batches(docs).select("*", whole_text().alias(f"{P}text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t) for t in b.column(b.num_columns - 1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made)], names=[*b.schema.names[:-1], f"{P}fp"])

    kind = StructType([*docs.schema.fields, StructField(f"{P}fp", LongType())])
    return rows.mapInArrow(work, kind)


def hex_digits(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
