"""Net and time policies in force at a place: as-of joins on directive events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.operators import relops as ro


def _timeline(events: DataFrame, sites: DataFrame, kind: str) -> DataFrame:
    """Events and sites of each file in order; an event at a site's own place comes before it."""
    e = events.where(F.col("kind").isin(kind, "resetall")).select("file_id", F.col("expanded_offset").alias("at"), F.lit(0).alias("side"), "event_seq", F.when(F.col("kind") == kind, F.col("arg")).alias("arg"), (F.col("kind") == "resetall").alias("reset"), F.lit(None).cast("int").alias("start"))
    s = sites.select("file_id", F.col("start").alias("at"), F.lit(1).alias("side"), F.lit(0).alias("event_seq"), F.lit(None).cast("string").alias("arg"), F.lit(False).alias("reset"), "start")
    return e.unionByName(s)


def active(events: DataFrame, sites: DataFrame, kind: str, default: str | None) -> DataFrame:
    """file_id, start and value: what the last directive of a kind before each site says; resetall forgets."""
    rows = _timeline(events, sites, kind)
    value = F.lit(None).cast("string") if default is None else F.lit(default)
    out = ro.asof_with_reset(rows, ["file_id"], ["at", "side", "event_seq"], F.col("arg"), F.col("reset"), "value", value)
    return out.where("side = 1").select("file_id", "start", "value").distinct()


def default_nettype(events: DataFrame, sites: DataFrame) -> DataFrame:
    return active(events, sites, "default_nettype", "wire")


def timescale(events: DataFrame, sites: DataFrame) -> DataFrame:
    return active(events, sites, "timescale", None)
