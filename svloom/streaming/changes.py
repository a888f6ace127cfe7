"""Incremental recomputation: a file whose names, scopes and imports are as before needs no new resolution.

A file's fingerprint is over its facts without offsets, in reading order, so an edit of white space or comments
leaves it alone. The stream takes files as they appear in a folder and keeps the state of each path: digest of the
text, fingerprint and included paths. A micro-batch works on the files that are new or written again and on those that
include them or a file that is gone, however indirectly, and yields the paths whose fingerprint is new or which are gone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from svloom.functions import preprocess as pp
from svloom.functions.parser import facts
from svloom.operators import relops as ro
from svloom.sources import sv_files

#: Facts that resolution depends on, and what in them is a place.
NAME_TABLES = ("defs", "scopes", "symbols", "imports", "exports", "uses")


def name_fingerprints(all_facts: DataFrame) -> DataFrame:
    """file_id and a fingerprint of what resolution depends on."""
    plain = F.regexp_replace(F.regexp_replace("row", r'\\*"(start|len|site)\\*": -?\d+(, )?', ""), r", \d+\]", "]")
    rows = all_facts.where(F.col("table").isin(*NAME_TABLES)).select("file_id", F.concat_ws("|", "table", plain).alias("r"))
    return rows.groupBy("file_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list("r")), "\n")).alias("fingerprint"))


def fingerprints(sources: DataFrame) -> DataFrame:
    """file_id, content (of the text) and fingerprint (of its names). sources: file_id, path, text, includes."""
    names = name_fingerprints(facts(pp.expanded(sources)))
    return sources.select("file_id", F.md5("text").alias("content")).join(names, "file_id", "left")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """file_id and what: added, removed, names (to be resolved again) or layout (text alone)."""
    a, b = before.select("file_id", F.col("content").alias("c0"), F.col("fingerprint").alias("f0")), after.select("file_id", F.col("content").alias("c1"), F.col("fingerprint").alias("f1"))
    what = F.when(F.col("c0").isNull(), "added").when(F.col("c1").isNull(), "removed").when(~F.col("f0").eqNullSafe(F.col("f1")), "names").when(F.col("c0") != F.col("c1"), "layout")
    return a.join(b, "file_id", "full_outer").select("file_id", what.alias("what")).where("what is not null")


def _latest(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("path").orderBy(F.col("version").desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


_STATE = "path string, content string, fingerprint string, includes array<string>"


def _includers(known: DataFrame, paths: DataFrame) -> DataFrame:
    """path: these, and all known files that include them, however indirectly."""
    edges = known.select("path", F.explode("includes").alias("target"))
    seen = ro.written(paths.select("path").distinct(), "affected")
    while True:  # files are finite and each round adds some
        more = ro.written(edges.join(seen.withColumnRenamed("path", "target"), "target").select("path").distinct().join(seen, "path", "left_anti"), "affected")
        if more.isEmpty():
            return seen
        seen = ro.written(seen.unionByName(more), "affected")


def _states(spark: SparkSession, state: str, version: int) -> DataFrame:
    """The state that the last batch before this version left; a batch that is run again after a failure reads the same."""
    fs = spark._jvm.org.apache.hadoop.fs
    folder = fs.Path(state)
    where = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in where.listStatus(folder)] if where.exists(folder) else []
    before = [v for n in names if n.startswith("version=") and (v := int(n.removeprefix("version="))) < version and where.exists(fs.Path(f"{state}/{n}/_SUCCESS"))]
    return spark.read.schema(_STATE).parquet(f"{state}/version={max(before)}") if before else spark.createDataFrame([], _STATE)


def update(spark: SparkSession, files: DataFrame, changed_paths: DataFrame, before: DataFrame, include_dirs: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The new state, and path, fingerprint and what (names or removed) of what is to be resolved again.

    files: path and text of all files there are; changed_paths: those written since the state before.
    """
    gone = before.select("path").join(files.select("path"), "path", "left_anti")
    affected = _includers(before, changed_paths.select("path").unionByName(gone)).join(files.select("path"), "path", "left_semi")
    sources = sv_files.numbered(files).select("file_id", "path", "text")
    own = sources.join(affected, "path", "left_semi").select("file_id", "path", "text")
    found = sv_files.include_map(sources, include_dirs, own)
    paths = sources.select(F.col("file_id").alias("target_file_id"), F.col("path").alias("target"))
    targets = found.join(paths, "target_file_id").groupBy("file_id").agg(F.collect_set("target").alias("targets"))
    full = sv_files.with_includes(sources, found).join(own.select("file_id"), "file_id", "left_semi")
    rows = full.select("file_id", "path").join(fingerprints(full), "file_id").join(targets, "file_id", "left")
    none = F.array().cast("array<string>")
    now = ro.written(rows.select("path", "content", "fingerprint", F.coalesce("targets", none).alias("includes")), "fingerprints")
    state = before.join(affected, "path", "left_anti").join(gone, "path", "left_anti").unionByName(now)
    was = before.select("path", F.col("fingerprint").alias("was"), F.lit(True).alias("known"))
    names = now.join(was, "path", "left").where("known is null or not (was <=> fingerprint)").select("path", "fingerprint", F.lit("names").alias("what"))
    return state, names.unionByName(gone.select("path", F.lit(None).cast("string").alias("fingerprint"), F.lit("removed").alias("what")))


def stream(spark: SparkSession, folder: str, state: str, checkpoint: str, on_change: Callable[[DataFrame], None], include_dirs: Sequence[str] = ()) -> StreamingQuery:
    """Follows a folder of source files; on_change gets path, fingerprint and what of each batch (see update).

    state is a folder of versions, of which a batch reads the one before and writes its own whole; it keeps the last two.
    """

    def batch(rows: DataFrame, version: int) -> None:
        read = spark.read.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        after, found = update(spark, ro.written(read, "files"), _latest(rows.select("path", F.col("at").alias("version"))), _states(spark, state, version), include_dirs)
        found = ro.written(found, "changes")
        after.write.mode("overwrite").parquet(f"{state}/version={version}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/version={version - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        on_change(found)

    files = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.unix_micros("_metadata.file_modification_time").alias("at"))
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
