"""Answers at a place in the expanded text: what a name is, and of which type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.operators.resolve import Unit
from svloom.operators.types import Types


def resolve_at(unit: Unit, places: DataFrame) -> DataFrame:
    """places (file_id, at) with name, step, target_file, target and the declaration's start, where a use is."""
    uses = unit.uses.select("file_id", "use_ordinal", "name", "start", "len")
    inside = places.join(uses, "file_id").where("start <= at and at < start + len")
    found = inside.join(unit.resolutions().where("outcome = 'resolved'"), ["file_id", "use_ordinal"])
    symbols = unit.symbols.select(F.col("file_id").alias("target_file"), F.col("symbol_id").alias("target"), F.col("start").alias("declared_at"), "kind")
    defs = unit.defs.select(F.col("file_id").alias("target_file"), F.col("ordinal").alias("target"), F.col("start").alias("declared_at"), "kind")
    columns = ["file_id", "at", "name", "step", "target_file", "target", "declared_at", "kind"]
    own = found.where("step <> 'definition'").join(symbols, ["target_file", "target"]).select(*columns)
    return own.unionByName(found.where("step = 'definition'").join(defs, ["target_file", "target"]).select(*columns))


def type_at(types: Types, places: DataFrame) -> DataFrame:
    """places (file_id, at) with the width, sign and state of the name there."""
    found = resolve_at(types.unit, places).where("step <> 'definition'").select("file_id", "at", "name", "target_file", "target")
    there = types.settled.select(F.col("file_id").alias("target_file"), F.col("symbol_id").alias("target"), "width", "signed", "four_state")
    return found.join(there, ["target_file", "target"]).select("file_id", "at", "name", "width", "signed", "four_state")
