"""Generic kernels. Each is a composition of joins, windows and aggregates that Catalyst plans.

Every window is partitioned by the caller's keys, so no kernel gathers a table in one task.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def _ordered(keys: Keys, order: Keys):
    return Window.partitionBy(*keys).orderBy(*[F.col(c) for c in order])


def written(df: DataFrame, what: str = "step", by: Keys = ()) -> DataFrame:
    """df, written to the shared folder of the cluster and read again, so that its lineage is cut.

    With by, a filter on these columns reads its own rows only.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="svloom-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def dealt(df: DataFrame, rows: int, key: str) -> DataFrame:
    """df of so many rows, each of which takes long, dealt by key to a few tasks a core however few bytes it has."""
    parts = min(4 * df.sparkSession.sparkContext.defaultParallelism, rows // 2_000 + 1)
    return df.repartition(parts, F.xxhash64(key))  # not by the key itself: such a dealing is dropped behind a join by it


#: Rows that may be sent to all tasks.
SENT = 100_000


def beside(df: DataFrame) -> DataFrame:
    """df, already written, for a join with a larger table: sent to all tasks if its rows are few, else both sides are sorted.

    The planner goes by bytes on disk and would send millions of equal rows, of the larger side too.
    """
    return F.broadcast(df) if df.count() <= SENT else df.hint("merge")


def asof_last(df: DataFrame, keys: Keys, order: Keys, value: Column, out: str, default: Column | None = None) -> DataFrame:
    """The value in force at each row: the last non-null one up to and including it, else the default."""
    w = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(value, ignorenulls=True).over(w)
    return df.withColumn(out, last if default is None else F.coalesce(last, default))


def asof_with_reset(df: DataFrame, keys: Keys, order: Keys, value: Column, reset: Column, out: str, default: Column | None = None) -> DataFrame:
    """As asof_last, but a reset row forgets all values before it."""
    w = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = df.withColumn("__reset_group", F.sum(F.when(reset, 1).otherwise(0)).over(w))
    return asof_last(groups, [*keys, "__reset_group"], order, value, out, default).drop("__reset_group")


def asof_join(left: DataFrame, right: DataFrame, keys: Keys, order: str, values: Keys, default: dict[str, Column] | None = None) -> DataFrame:
    """Each left row with the right side's values at the greatest order up to its own (ties: right first)."""
    blank = [F.lit(None).cast(dict(right.dtypes)[v]).alias(f"__r_{v}") for v in values]
    carried = [c for c in left.columns if c not in (*keys, order)]
    a = left.select(*keys, order, F.lit(1).alias("__side"), F.struct(*carried).alias("__row") if carried else F.lit(None).alias("__row"), *blank)
    b = right.select(*keys, order, F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), *[F.col(v).alias(f"__r_{v}") for v in values])
    w = _ordered(keys, [order, "__side"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    packed = F.when(F.col("__side") == 0, F.struct(*[F.col(f"__r_{v}").alias(v) for v in values]))
    both = a.unionByName(b).withColumn("__last", F.last(packed, ignorenulls=True).over(w)).where("__side = 1")
    found = {v: F.col(f"__last.{v}") for v in values}
    return both.select(*keys, order, *[F.col(f"__row.{c}").alias(c) for c in carried], *[(F.coalesce(x, default[v]) if default and v in default else x).alias(v) for v, x in found.items()])


def interval_join(points: DataFrame, spans: DataFrame, keys: Keys, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with all spans of their keys that contain them, start <= at < end; integral positions.

    Spans are dealt to the bins of a width that they touch, so the join is on equality and a
    point meets the spans near it only. Choose the width near a span's usual length.
    """
    p = points.withColumn("__bin", F.expr(f"floor({at} / {width})"))
    s = spans.where(f"{end} > {start}").withColumn("__bin", F.explode(F.expr(f"sequence(floor({start} / {width}), floor(({end} - 1) / {width}))")))
    return p.join(s, [*keys, "__bin"]).where(f"{start} <= {at} and {at} < {end}").drop("__bin")


def precedence_pick(candidates: DataFrame, keys: Keys, ranks: Keys) -> DataFrame:
    """The candidate of the best rank for each key."""
    return candidates.withColumn("__rank", F.row_number().over(_ordered(keys, ranks))).where("__rank = 1").drop("__rank")


def ambiguous_pick(candidates: DataFrame, keys: Keys, rank: str, target: str, origin: str) -> DataFrame:
    """The first rank with any candidate decides: one target resolves, more are ambiguous.

    Returns keys, the rank, outcome, target (null if ambiguous) and the sorted origins.
    """
    by_rank = candidates.groupBy(*keys, rank).agg(F.min(target).alias("__low"), F.max(target).alias("__high"), F.array_sort(F.collect_set(origin)).alias("origins"))
    first = by_rank.groupBy(*keys).agg(F.min_by(F.struct(rank, "__low", "__high", "origins"), rank).alias("__f"))
    one = F.col("__f.__low") == F.col("__f.__high")
    return first.select(*keys, F.col(f"__f.{rank}").alias(rank), F.when(one, "resolved").otherwise("ambiguous").alias("outcome"), F.when(one, F.col("__f.__low")).alias(target), F.col("__f.origins").alias("origins"))


def duplicates_after_first(df: DataFrame, keys: Keys, order: Keys) -> DataFrame:
    """Every row but the first of each key, with its ordinal from 2."""
    return df.withColumn("ordinal", F.row_number().over(_ordered(keys, order))).where("ordinal > 1")


def adjacent_duplicates(df: DataFrame, keys: Keys, order: Keys, site: str, out: str) -> DataFrame:
    """Rows whose key occurred before, with the site of the previous occurrence."""
    return df.withColumn(out, F.lag(site).over(_ordered(keys, order))).where(F.col(out).isNotNull())


def closure(edges: DataFrame, child: str, parent: str, most: int = 64) -> DataFrame:
    """All (child, ancestor, distance) with distance from 1, of an acyclic parent relation.

    Path doubling: rounds grow as the logarithm of the depth. Each round is written out. A relation
    that is still growing after `most` rounds has a cycle and raises.
    """
    paths = written(edges.where(F.col(parent).isNotNull()).select(F.col(child).alias("child"), F.col(parent).alias("ancestor"), F.lit(1).alias("distance")).distinct(), "closure")
    reach = 1
    for _ in range(most):
        tail = paths.where(f"distance = {reach}").select("child", F.col("ancestor").alias("mid"))
        onward = paths.select(F.col("child").alias("mid"), F.col("ancestor"), F.col("distance").alias("d"))
        more = written(tail.join(onward, "mid").select("child", "ancestor", (F.col("d") + reach).alias("distance")), "closure")
        if more.isEmpty():
            return paths
        paths, reach = written(paths.unionByName(more).distinct(), "closure"), 2 * reach
    raise ValueError("the parent relation has a cycle")


def adjacent_parents(df: DataFrame, keys: Keys, node: str, out: str) -> DataFrame:
    """keys and node with the node before it in its key as parent, null for the first."""
    return df.select(*keys, node, F.lag(node).over(_ordered(keys, [node])).alias(out))


def depth_and_root(nodes: DataFrame, keys: Keys, node: str, parent: str, most: int = 64) -> DataFrame:
    """keys, node, depth (0 at a root) and root, by pointer jumping: one row for each node in each round."""
    now = written(nodes.select(*keys, node, F.coalesce(parent, node).alias("root"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("depth")), "depth")
    for _ in range(most):
        up = now.select(*keys, F.col(node).alias("root"), F.col("root").alias("__next"), F.col("depth").alias("__more"))
        step = written(now.join(up, [*keys, "root"]).select(*keys, node, F.col("__next").alias("root"), (F.col("depth") + F.col("__more")).alias("depth"), (F.col("__more") > 0).alias("__moved")), "depth")
        now = step.drop("__moved")
        if step.where("__moved").isEmpty():
            return now
    raise ValueError("the parent relation has a cycle")


def nearest_ancestor(uses: DataFrame, ancestors: DataFrame, bindings: DataFrame, scope: str, use_key: Keys, name: str, symbol: str) -> DataFrame:
    """For each use the binding of its name in the nearest enclosing scope (its own at distance 0).

    ancestors: (scope, ancestor, distance) with distance 0 rows; bindings: (ancestor, name, symbol).
    The first of several symbols in one scope wins.
    """
    found = uses.join(ancestors, scope).join(bindings, ["ancestor", name])
    return found.groupBy(*use_key).agg(F.min(F.struct("distance", symbol)).alias("__b")).select(*use_key, F.col("__b.distance").alias("distance"), F.col(f"__b.{symbol}").alias(symbol))


def merged_surface(entries: DataFrame, keys: Keys, precedence: str, order: Keys) -> DataFrame:
    """One entry for each key: that of the best precedence, then of the least order."""
    return precedence_pick(entries, keys, [precedence, *order])


def positional_join(actual: DataFrame, formal: DataFrame, keys: Keys, position: str) -> DataFrame:
    """Full outer join by position, with status matched, overflow (actual only) or missing (formal only)."""
    a, f = actual.withColumn("__a", F.lit(True)), formal.withColumn("__f", F.lit(True))
    status = F.when(F.col("__a").isNull(), "missing").when(F.col("__f").isNull(), "overflow").otherwise("matched")
    return a.join(f, [*keys, position], "full_outer").withColumn("status", status).drop("__a", "__f")


def named_match(actual: DataFrame, formal: DataFrame, keys: Keys, order: Keys) -> DataFrame:
    """Full outer join by name: matched, duplicate (a later actual of a name), unknown or missing."""
    nth = F.row_number().over(_ordered(keys, order))
    a, f = actual.withColumn("__n", nth), formal.withColumn("__f", F.lit(True))
    status = F.when(F.col("__n").isNull(), "missing").when(F.col("__f").isNull(), "unknown").when(F.col("__n") > 1, "duplicate").otherwise("matched")
    return a.join(f, list(keys), "full_outer").withColumn("status", status).drop("__n", "__f")


def realized_between(uses: DataFrame, spans: DataFrame, keys: Keys, at: str, after: str, before: str, out: str) -> DataFrame:
    """Spans with the earliest use strictly between their ends; spans without one are left out."""
    inside = spans.join(uses.select(*keys, at), list(keys)).where(f"{after} < {at} and {at} < {before}")
    return inside.groupBy(*spans.columns).agg(F.min(at).alias(out))


def prefix_fold(df: DataFrame, keys: Keys, order: Keys, value: str, reset: str, out: str) -> DataFrame:
    """Running values that a non-null reset sets and each following row raises by value."""
    w = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = df.withColumn("__g", F.count(reset).over(w))
    inner = _ordered([*keys, "__g"], order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.coalesce(F.first(reset).over(inner), F.lit(0))
    return grouped.withColumn(out, start + F.sum(value).over(inner) - F.first(value).over(inner)).drop("__g")


def frontier(roots: DataFrame, edges: DataFrame, node: str, child: str, most: int = 256) -> DataFrame:
    """Hierarchical expansion: every path from a root with node, depth and path (array of nodes).

    A level at a time, each written out. A child already on its path is not entered again but
    kept with guard = 'recursion'; at `most` levels a row has guard = 'depth'.
    """
    level = written(roots.select(F.col(node).alias("node"), F.lit(0).alias("depth"), F.array(F.col(node)).alias("path"), F.lit(None).cast("string").alias("guard")), "frontier")
    out = level
    for depth in range(1, most + 1):
        open_ = level.where("guard is null")
        nxt = open_.join(edges.select(F.col(node).alias("node"), F.col(child).alias("__child")), "node")
        cut = F.when(F.array_contains("path", F.col("__child")), "recursion").when(F.lit(depth == most), "depth")
        level = written(nxt.select(F.col("__child").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("__child")).alias("path"), cut.alias("guard")), "frontier")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out
