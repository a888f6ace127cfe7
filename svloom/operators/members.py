"""System functions and built-in methods: dimension tables, and calls that break their rules."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svloom.functions.typing import Typer
from svloom.operators.resolve import Unit
from svloom.operators.types import Types

#: Fixed values of the language: least and greatest number of arguments (None: no limit), and the kind of result.
SYSTEM_FUNCTIONS = {
    "$clog2": (1, 1, "int"), "$signed": (1, 1, "same"), "$unsigned": (1, 1, "same"), "$bits": (1, 1, "int"), "$countones": (1, 1, "int"), "$countbits": (2, None, "int"),
    "$onehot": (1, 1, "bit"), "$onehot0": (1, 1, "bit"), "$isunknown": (1, 1, "bit"),
    "$ln": (1, 1, "real"), "$log10": (1, 1, "real"), "$exp": (1, 1, "real"), "$sqrt": (1, 1, "real"), "$floor": (1, 1, "real"), "$ceil": (1, 1, "real"),
    "$sin": (1, 1, "real"), "$cos": (1, 1, "real"), "$tan": (1, 1, "real"), "$asin": (1, 1, "real"), "$acos": (1, 1, "real"), "$atan": (1, 1, "real"),
    "$sinh": (1, 1, "real"), "$cosh": (1, 1, "real"), "$tanh": (1, 1, "real"), "$asinh": (1, 1, "real"), "$acosh": (1, 1, "real"), "$atanh": (1, 1, "real"),
    "$pow": (2, 2, "real"), "$atan2": (2, 2, "real"), "$hypot": (2, 2, "real"),
    "$left": (1, 2, "int"), "$right": (1, 2, "int"), "$low": (1, 2, "int"), "$high": (1, 2, "int"), "$size": (1, 2, "int"), "$increment": (1, 2, "int"), "$dimensions": (1, 1, "int"), "$unpacked_dimensions": (1, 1, "int"),
    "$itor": (1, 1, "real"), "$rtoi": (1, 1, "int"), "$realtobits": (1, 1, "bits64"), "$bitstoreal": (1, 1, "real"), "$shortrealtobits": (1, 1, "bits32"), "$bitstoshortreal": (1, 1, "shortreal"),
}
#: (least, greatest number of arguments) by receiver and method.
STRING_METHODS = {"len": (0, 0), "putc": (2, 2), "getc": (1, 1), "toupper": (0, 0), "tolower": (0, 0), "compare": (1, 1), "icompare": (1, 1), "substr": (2, 2), "atoi": (0, 0), "atohex": (0, 0), "atooct": (0, 0), "atobin": (0, 0), "atoreal": (0, 0), "itoa": (1, 1), "hextoa": (1, 1), "octtoa": (1, 1), "bintoa": (1, 1), "realtoa": (1, 1)}
ENUM_METHODS = {"first": (0, 0), "last": (0, 0), "next": (0, 1), "prev": (0, 1), "num": (0, 0), "name": (0, 0)}
LOCATORS = ("find", "find_index", "find_first", "find_first_index", "find_last", "find_last_index")
SEQUENCE_METHODS = {**dict.fromkeys((*LOCATORS, "min", "max", "unique", "unique_index", "sort", "rsort", "reverse", "shuffle", "sum", "product", "and", "or", "xor", "map", "size"), (0, 0))}
QUEUE_METHODS = {"insert": (2, 2), "push_front": (1, 1), "push_back": (1, 1), "pop_front": (0, 0), "pop_back": (0, 0), "delete": (0, 1)}
ASSOC_METHODS = {"size": (0, 0), "num": (0, 0), "exists": (1, 1), "delete": (0, 1), "first": (1, 1), "last": (1, 1), "next": (1, 1), "prev": (1, 1)}
#: Methods that must, and that mustn't, have a with clause.
WITH_NEEDED, WITH_FORBIDDEN = (*LOCATORS, "map"), ("reverse", "shuffle", "size")
RECEIVERS = {"string": STRING_METHODS, "enum": ENUM_METHODS, "fixed": SEQUENCE_METHODS, "dynamic": SEQUENCE_METHODS | {"delete": (0, 0)}, "queue": SEQUENCE_METHODS | QUEUE_METHODS, "assoc": ASSOC_METHODS}


def system_functions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, a, b, r) for n, (a, b, r) in SYSTEM_FUNCTIONS.items()], "name string, least int, most int, result string")


def methods(spark: SparkSession) -> DataFrame:
    """receiver, name, least and most arguments, with_rule (needed, forbidden or optional)."""
    rule = lambda r, n: "forbidden" if r in ("string", "enum", "assoc") or n in WITH_FORBIDDEN or n in QUEUE_METHODS else "needed" if n in WITH_NEEDED else "optional"
    return spark.createDataFrame([(r, n, a, b, rule(r, n)) for r, own in RECEIVERS.items() for n, (a, b) in own.items()], "receiver string, name string, least int, most int, with_rule string")


def system_findings(unit: Unit) -> DataFrame:
    """system_call_unsupported and system_call_arity."""
    calls = unit.sites.where("kind = 'system'").select("file_id", "start", F.get_json_object("detail", "$[0]").alias("name"), F.get_json_object("detail", "$[1]").cast("int").alias("n"))
    known = F.broadcast(system_functions(unit.sites.sparkSession))
    rows = calls.join(known, "name", "left")
    code = F.when(F.col("least").isNull(), "system_call_unsupported").when((F.col("n") < F.col("least")) | (F.col("n") > F.col("most")), "system_call_arity")
    return rows.select("file_id", "start", "name", code.alias("code")).where("code is not null")


def receiver(t: dict) -> str | None:
    """The kind of receiver that a type is to methods."""
    outer = next(iter(t["shape"]), None)
    if outer is not None and not outer["packed"]:
        return {"fixed": "fixed", "dynamic": "dynamic", "queue": "queue", "assoc": "assoc"}[outer["form"]]
    return t["kind"] if t["kind"] in ("string", "enum") else None


def method_calls(types: Types) -> DataFrame:
    """file_id, start, receiver (null: none), name, n arguments and has_with of calls on values of a known type."""

    def work(r: dict, typer: Typer) -> list[tuple]:
        (_, (_, inner, name), args), has = json.loads(r["detail"])
        t = typer.expr(inner)
        if t["kind"] in ("error", "unresolved"):
            return []
        return [(r["file_id"], r["start"], receiver(t), name, len(args), has)]

    sites = types.unit.sites.where("kind = 'method'").select("file_id", "start", "detail")
    return types._per_file(sites, "file_id int, start int, receiver string, name string, n int, has_with boolean", work)


def method_findings(types: Types) -> DataFrame:
    """no_such_method, method_arity, with_needed and with_forbidden."""
    known = F.broadcast(methods(types.unit.sites.sparkSession))
    rows = method_calls(types).where("receiver is not null").join(known, ["receiver", "name"], "left")
    code = (
        F.when(F.col("least").isNull(), "no_such_method")
        .when((F.col("n") < F.col("least")) | (F.col("n") > F.col("most")), "method_arity")
        .when((F.col("with_rule") == "needed") & ~F.col("has_with"), "with_needed")
        .when((F.col("with_rule") == "forbidden") & F.col("has_with"), "with_forbidden")
    )
    return rows.select("file_id", "start", "name", code.alias("code")).where("code is not null")
