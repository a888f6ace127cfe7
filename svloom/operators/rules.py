"""Rules: filters over facts that leave findings, and their places in the source files.

A finding is file_id, code, severity, name and start (a byte of the expanded text). Codes: see each rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svloom.operators import policies
from svloom.operators import relops as ro
from svloom.operators.resolve import Unit
from svloom.operators.typing_ops import time_rank
from svloom.sources import text_index as ti


def _finding(rows: DataFrame, code: str | Column, name: str | Column = "name", severity: str = "error") -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    return rows.select("file_id", code.alias("code"), F.lit(severity).alias("severity"), (F.col(name) if isinstance(name, str) else name).alias("name"), F.col("start").cast("int").alias("start"))


def use_outcomes(unit: Unit, events: DataFrame) -> DataFrame:
    """Uses with their outcome; an unresolved name where a net may be implied is implicit_net or implicit_net_forbidden."""
    uses = unit.uses.select("file_id", "use_ordinal", "name", "start", "implicit")
    rows = uses.join(unit.resolutions(), ["file_id", "use_ordinal"])
    policy = policies.default_nettype(events, uses.where("implicit")).withColumnRenamed("value", "net")
    rows = rows.join(policy, ["file_id", "start"], "left")
    lost = (F.col("outcome") == "unresolved") & F.col("implicit")
    return rows.withColumn("outcome", F.when(lost & (F.col("net") == "none"), "implicit_net_forbidden").when(lost, "implicit_net").otherwise(F.col("outcome")))


def name_findings(outcomes: DataFrame) -> DataFrame:
    """unresolved_name, ambiguous_name and implicit_net_forbidden."""
    code = F.when(F.col("outcome") == "unresolved", "unresolved_name").when(F.col("outcome") == "ambiguous", "ambiguous_name").otherwise(F.col("outcome"))
    return _finding(outcomes.where("outcome in ('unresolved', 'ambiguous', 'implicit_net_forbidden')"), code)


def implicit_nets(outcomes: DataFrame) -> DataFrame:
    """file_id, name and net kind of the nets that undeclared names declare."""
    return outcomes.where("outcome = 'implicit_net'").select("file_id", "name", F.col("net").alias("net_kind")).distinct()


def duplicate_findings(unit: Unit) -> DataFrame:
    """duplicate_definition and duplicate_declaration."""
    return _finding(unit.duplicate_definitions(), "duplicate_definition").unionByName(_finding(unit.duplicate_symbols(), "duplicate_declaration"))


def statement_findings(unit: Unit) -> DataFrame:
    """jump_outside_loop, return_outside_callable, case_modifier and highz_strength."""
    sites = unit.sites
    jump = sites.where("kind in ('break', 'continue') and loop_depth = 0")
    back = sites.where("kind = 'return' and callable is null")
    case = sites.where("kind in ('casex', 'casez') and detail is not null")
    weak = sites.where("kind = 'strength' and detail like '%highz0%' and detail like '%highz1%'")
    found = _finding(jump, "jump_outside_loop", "kind").unionByName(_finding(back, "return_outside_callable", "kind"))
    return found.unionByName(_finding(case, "case_modifier", "detail")).unionByName(_finding(weak, "highz_strength", "detail"))


def import_findings(unit: Unit) -> DataFrame:
    """import_conflict."""
    return _finding(unit.import_conflicts(), "import_conflict")


def timescale_findings(events: DataFrame) -> DataFrame:
    """timescale_magnitude (not 1, 10 or 100) and timescale_precision (coarser than the unit)."""
    parts = events.where("kind = 'timescale'").select("file_id", "start", "arg", time_rank(F.split("arg", "/")[0]).alias("u"), time_rank(F.split("arg", "/")[1]).alias("p"))
    code = F.when(F.col("u").isNull() | F.col("p").isNull(), "timescale_magnitude").when(F.col("p") > F.col("u"), "timescale_precision")
    return _finding(parts.where("u is null or p is null or p > u"), code, "arg")


def findings(unit: Unit, events: DataFrame) -> DataFrame:
    """All findings whose start is in the expanded text."""
    outcomes = use_outcomes(unit, events)
    return name_findings(outcomes).unionByName(duplicate_findings(unit)).unionByName(statement_findings(unit)).unionByName(import_findings(unit))


def placed(found: DataFrame, segments: DataFrame, sources: DataFrame) -> DataFrame:
    """Findings with origin_file, line and col (from 0, in bytes) in the source; within a macro's text, its use."""
    spans = segments.select("file_id", F.col("exp_start").alias("a"), F.col("exp_end").alias("b"), "origin_file", "origin_start", "origin_len", F.col("kind").alias("origin"))
    inside = ro.interval_join(found, spans, ["file_id"], "start", "a", "b", 4096)
    at = F.when(F.col("origin") == "macro", F.col("origin_start")).otherwise(F.col("origin_start") + F.col("start") - F.col("a"))
    rows = inside.select("file_id", "code", "severity", "name", "origin_file", at.cast("long").alias("at"))
    starts = ti.line_starts(sources, "file_id", "text").withColumnRenamed("file_id", "origin_file")
    return ti.to_line_col(rows, starts, "origin_file", "at").select("file_id", "code", "severity", "name", "origin_file", F.col("line").cast("long").alias("line"), "col")


def rendered(found: DataFrame, sources: DataFrame) -> DataFrame:
    """path, line and col from 1, and the message line of each placed finding."""
    rows = found.join(sources.select(F.col("file_id").alias("origin_file"), "path"), "origin_file")
    return rows.select("path", (F.col("line") + 1).alias("line"), (F.col("col") + 1).alias("col"), F.format_string("%s:%d:%d: %s[%s]: %s", "path", F.col("line") + 1, F.col("col") + 1, "severity", "code", "name").alias("message"))
