"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered from 0 in the order of their key (ties by the other order columns, of a key
with very many rows by a hash of them first, so that they spread; rows equal in all of them are interchangeable). A keyed Feistel network with cycle walking
permutes the numbers; of the permuted number q, q mod n is the shard and q div n the slot.
So shard sizes in rows differ by one at most, slots have no gaps, and both can be computed
from a row number, a count and a seed, as can the row number from shard and slot.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svloom.llm.common import P, key_bounds, part_count

ROUNDS = 8
#: Tasks that share the rows of a key that fills parts by itself.
SPREAD = 32


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser; its constants are the usual splitmix64 ones."""
    z = x + np.uint64(key)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [int(_mix(np.array([seed % (1 << 63)], dtype=np.uint64), 0x9E3779B97F4A7C15 * (r + 1) % (1 << 64))[0]) for r in range(ROUNDS)]


def _network(x: np.ndarray, bits: int, keys: Sequence[int], back: bool) -> np.ndarray:
    """One pass of the network over numbers of so many bits; back undoes it."""
    high, low = bits - bits // 2, bits // 2
    for r in range(ROUNDS)[:: -1 if back else 1]:
        # In round r the halves have widths (a, b); the halves swap after each round.
        a, b = (high, low) if r % 2 == 0 else (low, high)
        if back:
            left, right = x >> np.uint64(a), x & np.uint64((1 << a) - 1)
            x = ((right ^ (_mix(left, keys[r]) & np.uint64((1 << a) - 1))) << np.uint64(b)) | left
        else:
            left, right = x >> np.uint64(b), x & np.uint64((1 << b) - 1)
            x = (right << np.uint64(a)) | (left ^ (_mix(right, keys[r]) & np.uint64((1 << a) - 1)))
    return x


def permute(rows: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 under a seed, of many numbers at once; back is its inverse."""
    x = np.asarray(rows, dtype=np.uint64).copy()
    if n < 2 or not len(x):
        return x.astype(np.int64)
    bits, keys = max(2, (n - 1).bit_length()), _keys(seed)
    with np.errstate(over="ignore"):
        x = _network(x, bits, keys, back)
        while len(out := np.flatnonzero(x >= np.uint64(n))):  # walk the cycle until inside
            x[out] = _network(x[out], bits, keys, back)
    return x.astype(np.int64)


def numbered(df: DataFrame, key: str, ties: Sequence[str], row: str) -> tuple[DataFrame, int]:
    """df with global row numbers from 0 in ascending order of key, then ties; the number of rows.

    The key's range is cut into parts at literal bounds; counts by part make the offsets
    and a window numbers each part, so nothing passes through one task and a recomputed
    task yields the same numbers. A key that fills parts by itself, as a null may, is cut by a hash of its ties.
    Null keys come first.
    """
    spark = df.sparkSession
    parts = part_count(spark)
    cuts, times = np.unique(key_bounds(df, key, parts, distinct=False), return_counts=True)
    hot = cuts[times > 1]
    bounds = np.unique(np.concatenate([cuts, hot[hot > np.iinfo(np.int64).min] - 1])).astype(np.int64)
    alone = np.concatenate([[True], np.isin(bounds, hot), [False]])  # parts of one key: nulls first

    @F.pandas_udf("int")
    def part(x: pd.Series) -> pd.Series:
        known = x.notna().to_numpy()
        at = np.zeros(len(x), dtype=np.int32)
        at[known] = 1 + np.searchsorted(bounds, x[known].astype("int64").to_numpy(), side="left")
        return pd.Series(at)

    hashed = F.pmod(F.xxhash64(*ties), F.lit(SPREAD)).cast("int") if ties else F.lit(0)
    own = F.lit(alone.tolist())[F.col(f"{P}part")]
    keyed = df.withColumn(f"{P}part", part(F.col(key).cast("long"))).withColumn(f"{P}sub", F.when(own, hashed).otherwise(0))
    counts = {(r[0], r[1]): r[2] for r in keyed.groupBy(f"{P}part", f"{P}sub").count().collect()}
    starts, total = np.zeros((len(alone), SPREAD), np.int64), 0
    for i, j in sorted(counts):
        starts[i, j] = total
        total += counts[i, j]

    @F.pandas_udf("long")
    def offset(i: pd.Series, j: pd.Series) -> pd.Series:
        return pd.Series(starts[i.to_numpy(), j.to_numpy()])

    w = Window.partitionBy(f"{P}part", f"{P}sub").orderBy(F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in ties])
    local = F.row_number().over(w)
    return keyed.withColumn(row, local).withColumn(row, F.col(row) - 1 + offset(f"{P}part", f"{P}sub")).drop(f"{P}part", f"{P}sub"), total


def shard(df: DataFrame, shards: int, seed: int = 20240601, key: str = "doc_id", ties: Sequence[str] = ()) -> DataFrame:
    """df with columns row (global number), shard and slot; columns of these names are replaced.

    Null keys, repeated rows and empty tables are fine: each row has one number.
    """
    rows, n = numbered(df, key, ties, f"{P}row")

    @F.pandas_udf("long")
    def place(i: pd.Series) -> pd.Series:
        return pd.Series(permute(i.to_numpy(), n, seed))

    moved = rows.withColumn(f"{P}at", place(f"{P}row"))
    return (
        moved.withColumn("row", F.col(f"{P}row"))
        .withColumn("shard", (F.col(f"{P}at") % shards).cast("int"))
        .withColumn("slot", F.floor(F.col(f"{P}at") / shards).cast("long") if shards == 1 else F.expr(f"{P}at div {shards}"))
        .drop(f"{P}row", f"{P}at")
    )


def row_of(shard_id: int, slot: int, shards: int, n: int, seed: int = 20240601) -> int:
    """The row number that lies in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard_id]), n, seed, back=True)[0])
