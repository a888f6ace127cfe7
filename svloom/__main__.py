"""python -m svloom check [--top MODULE] [-I FOLDER]... FILE...   findings of a compilation unit; exit code 1 if any is an error
python -m svloom facts FILE   the fact rows of one file
python -m svloom tree FILE   its syntax tree
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svloom.functions import preprocess as pp
from svloom.functions.parser import facts
from svloom.functions.tree import listing
from svloom.operators import connect, elab, legality, members, rules
from svloom.operators import relops as ro
from svloom.operators.resolve import Unit
from svloom.operators.types import Types
from svloom.sources import sv_files


def uri(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path)


def unit_findings(unit: Unit, events: DataFrame, top: str | None) -> DataFrame:
    """file_id, code, severity, name and start of all findings; elaboration problems lie at the top module."""
    types = Types(unit)
    columns = ["file_id", "code", "severity", "name", "start"]
    found = rules.findings(unit, events).select(columns)
    found = found.unionByName(connect.findings(unit).select(columns)).unionByName(legality.findings(types).select(columns))
    for rows, severity in ((members.method_findings(types), "error"), (members.system_findings(unit), "error"), (types.enum_findings(), "error"), (types.packed_union_findings(), "error")):
        found = found.unionByName(rows.withColumn("severity", F.lit(severity)).select(columns))
    cut = types.truncations().select("file_id", F.lit("assignment_truncation").alias("code"), F.lit("warning").alias("severity"), F.format_string("%d to %d bits", "rhs_width", "lhs_width").alias("name"), "start")
    found = found.unionByName(cut)
    if top:
        at = unit.definitions().where(F.col("name") == top).select("file_id", "start")
        problems = elab.elaborate(unit, top).where("kind = 'problem'").select(F.lit("elaboration").alias("code"), F.lit("error").alias("severity"), F.concat_ws(": ", "path", "guard").alias("name"))
        found = found.unionByName(problems.withColumn("module", F.lit(top)).join(at.withColumn("module", F.lit(top)), "module").select(columns))
    return found


def check(spark: SparkSession, files: list[str], folders: list[str], top: str | None) -> DataFrame:
    """path, line, col, severity and message of the findings of root files, in order."""
    roots = [uri(f) for f in files]
    sources = ro.written(sv_files.read(spark, [*roots, *map(uri, folders)]), "sources")
    full = sv_files.with_includes(sources, sv_files.include_map(sources, [uri(d) for d in folders])).where(F.col("path").isin(roots))
    full = ro.written(full, "roots")
    events = pp.directive_events(full)
    found = unit_findings(Unit(ro.written(facts(pp.expanded(full)), "facts")), events, top)
    placed = rules.placed(found, pp.segments(full), sources)
    # Errors of directives and of time literals have their place in the file itself.
    early = pp.errors(full).select("file_id", F.lit("preprocess").alias("code"), F.lit("error").alias("severity"), F.col("message").alias("name"), "start").unionByName(rules.timescale_findings(events))
    own = rules.ti.to_line_col(early.withColumn("at", F.col("start").cast("long")).drop("start"), rules.ti.line_starts(full, "file_id", "text"), "file_id", "at")
    placed = placed.unionByName(own.select("file_id", "code", "severity", "name", F.col("file_id").alias("origin_file"), F.col("line").cast("long").alias("line"), "col"))
    return rules.rendered(placed, sources).orderBy("path", "line", "col", "message")


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="svloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("verb", choices=("check", "facts", "tree"))
    parser.add_argument("--top")
    parser.add_argument("-I", dest="folders", action="append", default=[])
    parser.add_argument("files", nargs="+")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("svloom").getOrCreate()
    if args.verb == "tree":
        print(listing(sv_files.read(spark, [uri(args.files[0])]).first()["text"]))
        return 0
    if args.verb == "facts":
        for r in facts(sv_files.read(spark, [uri(args.files[0])])).toLocalIterator():
            print(r["table"], r["row"])
        return 0
    rows = check(spark, args.files, args.folders, args.top).collect()
    for r in rows:
        print(r["message"].removeprefix("file://"))
    return int(any(": error[" in r["message"] for r in rows))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
