"""Lines, offsets and names in text, by byte, as column expressions and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keywords that are also plain words, for counting them in prose (fixed values of the language).
PLAIN_WORD_KEYWORDS = ("and", "or", "not", "for", "if", "else", "while", "do", "with", "this", "before", "within", "inside", "these", "are", "in", "an", "on", "to", "by", "is", "was")


def line_count(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def line_starts(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 0), start (byte offset) and len (bytes without the line end)."""
    lines = files.select(key, F.posexplode(F.split(text, "\n")).alias("line", "__t")).select(key, "line", F.octet_length("__t").cast("long").alias("len"))
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select(key, "line", F.coalesce(F.sum(F.col("len") + 1).over(before), F.lit(0)).cast("long").alias("start"), "len")


def to_line_col(points: DataFrame, starts: DataFrame, key: str, at: str) -> DataFrame:
    """points with line and col (bytes) of their offsets, both from 0."""
    lines = starts.select(F.col(key).alias("__k"), "line", "start", "len")
    inside = (F.col(key) == F.col("__k")) & (F.col("start") <= F.col(at)) & (F.col(at) <= F.col("start") + F.col("len"))
    return points.join(lines, inside).withColumn("col", F.col(at) - F.col("start")).drop("__k", "start", "len")


def to_offset(points: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """points (key, line, col) with at, null where the line is absent or ends before the column."""
    found = points.join(starts, [key, "line"], "left")
    return found.withColumn("at", F.when(F.col("col") <= F.col("len"), F.col("start") + F.col("col"))).drop("start", "len")


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_$]*"), F.lit(0))


def keywords(spark: SparkSession, words: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def expand_count(members: DataFrame, name: str, count: Column) -> DataFrame:
    """name[N]: rows ordinal 0..N-1 named name0, name1, ...; none for a count of 0."""
    rows = members.where(count > 0).withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)))
    return rows.withColumn("name", F.concat(name, F.col("ordinal").cast("string")))


def expand_range(members: DataFrame, name: str, first: Column, last: Column) -> DataFrame:
    """name[a:b]: rows named from a to b, upwards or downwards."""
    rows = members.withColumn("__a", first.cast("long")).withColumn("__b", last.cast("long"))
    rows = rows.select("*", F.posexplode(F.sequence("__a", "__b", F.when(F.col("__a") <= F.col("__b"), 1).otherwise(-1).cast("long"))).alias("ordinal", "__i"))
    return rows.withColumn("name", F.concat(name, F.col("__i").cast("string"))).withColumn("ordinal", F.col("ordinal").cast("long")).drop("__a", "__b", "__i")
