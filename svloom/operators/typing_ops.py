"""Operator typing: width, sign and state of results, as column expressions over a dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the language: binary operators by how their operands determine the result.
CONTEXT = ("+", "-", "*", "/", "%", "&", "|", "^", "^~", "~^")
LEFT_OPERAND = ("<<", ">>", "<<<", ">>>", "**")
COMPARISON = ("==", "!=", "<", "<=", ">", ">=", "==?", "!=?")
CASE_EQUALITY = ("===", "!==")
LOGICAL = ("&&", "||", "->", "<->")


def op_spec(spark: SparkSession) -> DataFrame:
    """op, category (context, shift, comparison, logical) and result_state (either or two) of each binary operator."""
    rows = [(o, "context", "either") for o in CONTEXT] + [(o, "shift", "either") for o in LEFT_OPERAND]
    rows += [(o, "comparison", "either") for o in COMPARISON] + [(o, "comparison", "two") for o in CASE_EQUALITY] + [(o, "logical", "either") for o in LOGICAL]
    return spark.createDataFrame(rows, "op string, category string, result_state string")


def bits(width: Column, signed: Column, four_state: Column) -> Column:
    return F.struct(width.alias("width"), signed.alias("signed"), four_state.alias("four_state"))


def result_type(category: Column, state: Column, left: Column, right: Column) -> Column:
    """The self-determined type: the greater width, or the left one's, or one bit."""
    one_bit = category.isin("comparison", "logical")
    width = F.when(one_bit, F.lit(1).cast("long")).when(category == "shift", left["width"]).otherwise(F.greatest(left["width"], right["width"]))
    signed = F.when(one_bit, F.lit(False)).when(category == "shift", left["signed"]).otherwise(left["signed"] & right["signed"])
    return bits(width, signed, F.when(state == "two", F.lit(False)).otherwise(left["four_state"] | right["four_state"]))


def in_context(own: Column, width: Column, signed: Column, four_state: Column) -> Column:
    """A type widened to its context (null parts: none given)."""
    return bits(F.greatest(own["width"], F.coalesce(width, own["width"])), F.coalesce(signed, own["signed"]), own["four_state"] | F.coalesce(four_state, F.lit(False)))


def comparison_context(left: Column, right: Column) -> Column:
    return bits(F.greatest(left["width"], right["width"]), left["signed"] & right["signed"], left["four_state"] | right["four_state"])


def conditional_type(left: Column, right: Column) -> Column:
    return comparison_context(left, right)


def concat_type(parts: Column) -> Column:
    """Of an array of types: widths added, unsigned; null if any width is unknown."""
    width = F.when(F.exists(parts, lambda p: p["width"].isNull()), F.lit(None)).otherwise(F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["width"]))
    return bits(width, F.lit(False), F.exists(parts, lambda p: p["four_state"]))


def replicated(count: Column, part: Column) -> Column:
    return bits(F.when(count >= 0, count * part["width"]), F.lit(False), part["four_state"])


def fixed_slice_width(a: Column, b: Column) -> Column:
    return F.abs(a - b) + 1


def indexed_slice_width(w: Column) -> Column:
    return F.when(w >= 0, w)


def time_rank(literal: Column) -> Column:
    """1/10/100 times fs..s as 0..17, greater for coarser; null if it isn't such a literal."""
    unit = F.regexp_extract(literal, r"^(1|10|100)\s*(s|ms|us|ns|ps|fs)$", 2)
    size = F.length(F.regexp_extract(literal, r"^(1|10|100)\s*(s|ms|us|ns|ps|fs)$", 1)) - 1
    step = F.array_position(F.array(*map(F.lit, ("fs", "ps", "ns", "us", "ms", "s"))), unit) - 1
    return F.when(unit != "", size + step * 3).cast("long")
