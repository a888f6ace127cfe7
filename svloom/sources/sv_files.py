"""Source files as tables: readers, the include closure, and a unit's inputs."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svloom.functions.lexer import lex
from svloom.operators import relops as ro

SOURCES = "file_id int, path string, text string"


def from_texts(spark: SparkSession, files: Sequence[tuple[str, str]]) -> DataFrame:
    """Sources of (path, text) pairs, numbered in their order."""
    return spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], SOURCES)


def numbered(rows: DataFrame) -> DataFrame:
    """rows (path and more, each path once) with file_id from 0, a function of the set of paths.

    Paths are counted by 1,024 buckets of their hash, so no task sees them all.
    """
    groups = rows.select("path").distinct().groupBy(F.xxhash64("path").bitwiseAND(F.lit(0x3FF)).alias("b")).agg(F.array_sort(F.collect_set("path")).alias("p"))
    begins, at = {}, 0
    for r in sorted(groups.select("b", F.size("p").alias("n")).collect()):
        begins[r["b"]], at = at, at + r["n"]
    begin = F.create_map(*[F.lit(x) for kv in begins.items() for x in kv]) if begins else F.create_map(F.lit(0).cast("long"), F.lit(0))
    ids = groups.select("b", F.posexplode("p").alias("i", "path")).select("path", (F.col("i") + begin[F.col("b")]).cast("int").alias("file_id"))
    return rows.join(ids, "path")


def read(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Sources of whole text files."""
    rows = spark.read.text(list(paths), wholetext=True).select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:///").alias("path"), F.col("value").alias("text"))
    return numbered(rows).select("file_id", "path", "text")


_REQUEST = re.compile(r'[ \t]*("[^"\n]*"|<[^>\n]*>)')


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[tuple[int, str, str], None] = {}
        for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            at = 0
            for t in lex(text) if text and "`include" in text else ():
                at += len(t.text)
                if t.kind == "directive" and t.text == "`include" and (m := _REQUEST.match(text, at)):
                    out[file, "quoted" if m[1][0] == '"' else "angle", m[1][1:-1]] = None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.string()), strict=True)], names=["file_id", "kind", "spelling"])


def include_requests(sources: DataFrame) -> DataFrame:
    """file_id, kind (quoted or angle) and spelling of the `include directives, each once a file; comments and strings hold none."""
    return sources.select("file_id", "text").mapInArrow(_requests, "file_id int, kind string, spelling string").distinct()


def include_map(sources: DataFrame, include_dirs: Sequence[str] = (), asking: DataFrame | None = None) -> DataFrame:
    """file_id, kind, spelling and target_file_id: the first place on the search path that has the file; asking: of those sources alone.

    Quoted names are sought beside the including file first, then in the include folders; others in the folders.
    """
    asked = include_requests(sources if asking is None else asking).join(sources.select("file_id", "path"), "file_id")
    beside = F.when(F.col("path").contains("/"), F.concat(F.regexp_extract("path", "^(.*)/", 1), F.lit("/"), "spelling")).otherwise(F.col("spelling"))
    places = [F.when(F.col("kind") == "quoted", beside), *[F.concat(F.lit(d.rstrip("/") + "/"), F.col("spelling")) for d in include_dirs]]
    tried = asked.select("file_id", "kind", "spelling", F.posexplode(F.array(*places)).alias("rank", "path")).where("path is not null")
    found = tried.join(sources.select("path", F.col("file_id").alias("target_file_id")), "path")
    return ro.precedence_pick(found, ["file_id", "kind", "spelling"], ["rank", "target_file_id"]).select("file_id", "kind", "spelling", "target_file_id")


def include_closure(includes: DataFrame, roots: DataFrame) -> DataFrame:
    """file_id of all roots and of the files that they include, however indirectly."""
    seen = ro.written(roots.select("file_id").distinct(), "includes")
    edge = includes.select("file_id", F.col("target_file_id").alias("next")).distinct()
    while True:  # files are finite and each round adds some
        more = ro.written(seen.join(edge, "file_id").select(F.col("next").alias("file_id")).distinct().join(seen, "file_id", "left_anti"), "includes")
        if more.isEmpty():
            return seen
        seen = ro.written(seen.unionByName(more), "includes")


def with_includes(sources: DataFrame, includes: DataFrame) -> DataFrame:
    """sources with includes, an array of (kind, spelling, file_id, text), as preprocessing takes them."""
    target = sources.select(F.col("file_id").alias("target_file_id"), F.col("text").alias("body"))
    packed = includes.join(target, "target_file_id").groupBy("file_id").agg(F.collect_list(F.struct("kind", "spelling", F.col("target_file_id").alias("file_id"), F.col("body").alias("text"))).alias("includes"))
    return sources.join(packed, "file_id", "left")


def unit_files(files: DataFrame) -> DataFrame:
    """Each file once."""
    return files.dropDuplicates(["file_id"])
