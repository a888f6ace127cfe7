"""Legality of declarations, assignments, calls, loops and interface members; syntax errors.

Each function yields findings: file_id, code, severity, name and start. What can't be told of a type breaks no rule.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svloom.functions.parser import TARGETS
from svloom.functions.typing import Typer
from svloom.operators import policies
from svloom.operators import relops as ro
from svloom.operators.resolve import Unit
from svloom.operators.types import Types

_FOUND = "file_id int, code string, name string, start int"
COLUMNS = ("file_id", "code", "severity", "name", "start")


def _findings(rows: DataFrame, severity: str = "error") -> DataFrame:
    return rows.withColumn("severity", F.lit(severity)).select(*COLUMNS)


def _known(t: dict) -> bool:
    return t["kind"] not in ("error", "unresolved", "none")


def _unpacked(t: dict) -> list[dict]:
    return [d for d in t["shape"] if not d["packed"]]


# Declarations


def _packable(t: dict) -> bool:
    """Whether a member of this type may lie in a packed record."""
    if not _known(t):
        return True
    return not _unpacked(t) and (t["kind"] in ("integral", "enum") or t["kind"] in ("struct", "union", "tagged") and t.get("packed", False))


def _record(r: dict, t: Typer) -> list[tuple]:
    """void_member (outside tagged unions) and packed_member_type."""
    packed, out = json.loads(r["base"]).get("packed"), []
    for m in json.loads(r["members"]):
        if m["type"].get("name") == "void":
            if r["kind"] != "tagged":
                out.append((r["file_id"], "void_member", m["name"], r["start"]))
        elif packed and not _packable(t.declared(m["type"])):
            out.append((r["file_id"], "packed_member_type", m["name"], r["start"]))
    return out


def _enum_base(r: dict, t: Typer) -> list[tuple]:
    base = t.declared(json.loads(r["base"]))
    bad = _known(base) and (base["kind"] != "integral" or bool(_unpacked(base)))
    return [(r["file_id"], "enum_base", "enum", r["start"])] if bad else []


def _dims(r: dict, t: Typer) -> list[tuple]:
    """queue_bound_not_constant, queue_bound_not_positive and array_size_not_positive."""
    out, type_ = [], json.loads(r["type"])
    for d in [*(type_.get("dims") or []), *(type_.get("unpacked") or [])]:
        if d[0] == "queue" and d[1] is not None or d[0] == "size":
            n = t.const(d[1])
            if isinstance(n, str):
                if d[0] == "queue":
                    out.append((r["file_id"], "queue_bound_not_constant", r["name"], r["start"]))
            elif n <= 0:
                out.append((r["file_id"], "queue_bound_not_positive" if d[0] == "queue" else "array_size_not_positive", r["name"], r["start"]))
    return out


def declaration_findings(types: Types) -> DataFrame:
    """Members of records, bases of enums, bounds of queues and arrays, and words that a declaration can't have or lacks."""
    unit = types.unit
    records = types._per_file(unit.types.where("kind in ('struct', 'union', 'tagged')").select("file_id", "start", "kind", "base", "members"), _FOUND, _record)
    enums = types._per_file(unit.types.where("kind = 'enum'").select("file_id", "start", "base"), _FOUND, _enum_base)
    dims = types._per_file(unit.symbols.where("kind in ('variable', 'net', 'port', 'typedef') and type is not null").select("file_id", "name", "start", "type"), _FOUND, _dims)
    words = unit.sites.where("kind in ('automatic', 'const_uninitialised', 'void_variable')")
    own = words.select("file_id", F.when(F.col("kind") == "automatic", "automatic_outside_procedure").otherwise(F.col("kind")).alias("code"), F.coalesce("detail", F.lit("automatic")).alias("name"), "start")
    return _findings(records.unionByName(enums).unionByName(dims).unionByName(own))


# Assignments


def _mismatch(a: dict, b: dict) -> str | None:
    """Why a value of type b can't be assigned to a type a."""
    if not _known(a) or not _known(b):
        return None
    left, right = _unpacked(a), _unpacked(b)
    size = lambda d: None if d["left"] is None else abs(d["left"] - d["right"])
    if len(left) != len(right):
        return "array_assignment"
    for p, q in zip(left, right, strict=True):
        if p["form"] == q["form"] == "fixed" and None not in (size(p), size(q)) and size(p) != size(q) or "assoc" in (p["form"], q["form"]) and p["form"] != q["form"]:
            return "array_assignment"
    if a["kind"] == "enum":
        other = b["kind"] == "enum" and a.get("id") != b.get("id")
        return "enum_assignment" if other or b["kind"] == "integral" else None
    records = ("struct", "union", "tagged")
    if a["kind"] in records or b["kind"] in records:
        loose = [x for x in (a, b) if x["kind"] in records and not x.get("packed")]
        same = a["kind"] in records and b["kind"] in records and a.get("id") == b.get("id")
        return "record_assignment" if loose and not same else None
    return None


def _made(a: dict, right: list, t: Typer) -> str | None:
    """Why new[n] can't be assigned to a type a."""
    if right[0] != "new" or right[1] is None or not _known(a):
        return None
    if not _unpacked(a) or a["shape"][0]["form"] != "dynamic":
        return "new_not_dynamic"
    n = t.const(right[1])
    return "new_size_negative" if isinstance(n, int) and n < 0 else None


def _assigned(r: dict, t: Typer) -> list[tuple]:
    left, right = json.loads(r["detail"])
    if not left or not right:
        return []
    if left[0] not in (*TARGETS, "none"):
        return [(r["file_id"], "invalid_target", r["name"], r["start"])]
    a = t.expr(left)
    why = _made(a, right, t) or _mismatch(a, t.expr(right))
    return [(r["file_id"], why, r["name"], r["start"])] if why else []


def _initialised(r: dict, t: Typer) -> list[tuple]:
    a, right = t.declared(json.loads(r["type"])), json.loads(r["value"])
    why = _made(a, right, t) or _mismatch(a, t.expr(right))
    return [(r["file_id"], why, r["name"], r["start"])] if why else []


def assignment_findings(types: Types) -> DataFrame:
    """array_assignment, enum_assignment, record_assignment, new_not_dynamic and new_size_negative, of statements and of initial
    values, and invalid_target."""
    sites = types.unit.sites.where("kind = 'assign'").select("file_id", "start", "detail", F.lit("=").alias("name"))
    first = types.unit.symbols.where("kind = 'variable' and value is not null and type is not null").select("file_id", "name", "start", "type", "value")
    return _findings(types._per_file(sites, _FOUND, _assigned, alike=True).unionByName(types._per_file(first, _FOUND, _initialised, alike=True)))


def _cast(r: dict, t: Typer) -> list[tuple]:
    _, to, what = json.loads(r["detail"])
    type_, n = t.type_of(to[3]), t.const(what)
    ok = type_ and type_.get("is_type") and type_["kind"] == "enum" and not type_["shape"][:-1] and isinstance(n, int)
    return [(r["file_id"], r["start"], to[2], type_["id"], n)] if ok else []


def cast_findings(types: Types) -> DataFrame:
    """cast_enum_range: a constant that is none of the enum's values (a warning)."""
    casts = types._per_file(types.unit.sites.where("kind = 'cast'").select("file_id", "start", "detail"), "file_id int, start int, name string, id string, value long", _cast)
    known = types.known_value_sets().where("values is not null").select(F.concat_ws(":", "file_id", "start").alias("id"), "values")
    out = casts.join(known, "id").where(~F.array_contains("values", F.col("value")))
    return _findings(out.select("file_id", F.lit("cast_enum_range").alias("code"), "name", "start"), "warning")


# Calls


def call_findings(unit: Unit) -> DataFrame:
    """not_callable, too_many_arguments, missing_argument, unknown_argument, duplicate_argument and argument_not_assignable."""
    given = F.from_json("detail", "array<struct<name:string,given:boolean,target:boolean>>")
    calls = unit.sites.where("kind = 'call'").select("file_id", "start", given.alias("given"))
    uses = unit.uses.select("file_id", "use_ordinal", "start", "name")
    targets = unit.resolutions().where("outcome = 'resolved' and step <> 'definition'").join(uses.hint("merge"), ["file_id", "use_ordinal"]).select("file_id", "start", "name", "target_file", F.col("target").cast("int").alias("target"))
    there = unit.symbols.select(F.col("file_id").alias("target_file"), F.col("symbol_id").alias("target"), "kind", F.col("start").alias("declared"))
    found = calls.join(targets.hint("merge"), ["file_id", "start"]).join(there.hint("merge"), ["target_file", "target"])
    params = F.from_json("params", "array<struct<name:string,direction:string,optional:boolean>>")
    callables = unit.callables.select(F.col("file_id").alias("target_file"), F.col("start").alias("declared"), params.alias("params"))
    rows = found.join(callables.hint("merge"), ["target_file", "declared"], "left")
    rows = rows.withColumn("placed", F.filter("given", lambda x: x["name"].isNull())).withColumn("named", F.filter("given", lambda x: x["name"].isNotNull()))
    has = lambda name: F.exists("named", lambda x: x["name"] == name)
    at_place = lambda i: F.coalesce(F.get("placed", i)["given"], F.lit(False))
    lacking = F.filter(F.transform("params", lambda p, i: F.struct(p["name"].alias("name"), (~p["optional"] & ~at_place(i) & ~has(p["name"])).alias("bad"))), lambda x: x["bad"])
    unknown = F.filter("named", lambda x: ~F.exists("params", lambda p: p["name"] == x["name"]))
    twice = F.filter(F.transform("params", lambda p, i: F.struct(p["name"].alias("name"), ((F.size(F.filter("named", lambda x: x["name"] == p["name"])) + at_place(i).cast("int")) > 1).alias("bad"))), lambda x: x["bad"])

    value_only = lambda p, i: F.exists("named", lambda x: (x["name"] == p["name"]) & x["given"] & ~x["target"]) | F.coalesce(F.get("placed", i)["given"] & ~F.get("placed", i)["target"], F.lit(False))
    fixed = F.filter(F.transform("params", lambda p, i: F.struct(p["name"].alias("name"), (p["direction"].isin("output", "inout", "ref") & value_only(p, i)).alias("bad"))), lambda x: x["bad"])

    none = F.array().cast("array<struct<code:string,name:string>>")
    told = lambda code, name: F.struct(F.lit(code).alias("code"), name.alias("name"))

    def each(what: Column, code: str) -> Column:
        return F.coalesce(F.transform(what, lambda x: told(code, x["name"])), none)

    def own(when: Column, code: str) -> Column:
        return F.when(when, F.array(told(code, F.col("name")))).otherwise(none)

    wrong = own(F.col("kind").isin("variable", "net", "port", "parameter", "localparam", "genvar", "enum_member"), "not_callable")
    many = own(F.col("params").isNotNull() & (F.size("placed") > F.size("params")), "too_many_arguments")
    every = F.concat(wrong, many, each(lacking, "missing_argument"), each(unknown, "unknown_argument"), each(twice, "duplicate_argument"), each(fixed, "argument_not_assignable"))
    # One pass over the calls for all rules.
    return _findings(rows.select("file_id", "start", F.explode(every).alias("f")).select("file_id", "f.code", "f.name", "start"))


# Loops


def _foreach(r: dict, t: Typer) -> list[tuple]:
    """foreach_not_array, foreach_too_many_variables, foreach_duplicate_variable and foreach_wildcard."""
    own = json.loads(r["detail"])
    names, out = [v for v in own["vars"] if v], []
    out += [(r["file_id"], "foreach_duplicate_variable", v, r["start"]) for i, v in enumerate(names) if v in names[:i] or v == own["array"]]
    type_ = t.expr(["name", None, own["array"], r["start"]])
    if _known(type_):
        if not type_["shape"] and type_["kind"] != "string":
            out.append((r["file_id"], "foreach_not_array", own["array"], r["start"]))
        elif len(own["vars"]) > max(1, len(type_["shape"])):
            out.append((r["file_id"], "foreach_too_many_variables", own["array"], r["start"]))
        if any(d.get("wild") and v for d, v in zip(type_["shape"], own["vars"], strict=False)):
            out.append((r["file_id"], "foreach_wildcard", own["array"], r["start"]))
    return out


def loop_findings(types: Types) -> DataFrame:
    """Rules of foreach, and assignments to its variables: foreach_variable_assigned."""
    unit = types.unit
    loops = types._per_file(unit.sites.where("kind = 'foreach'").select("file_id", "start", "detail"), _FOUND, _foreach)
    variables = unit.symbols.join(unit.sites.where("kind = 'loop_variable'").select("file_id", "start"), ["file_id", "start"], "left_semi").select(F.col("file_id").alias("target_file"), F.col("symbol_id").alias("target"), "name")
    left = F.get_json_object("detail", "$[0][0]")
    assigned = unit.sites.where("kind = 'assign'").where(left == "name").select("file_id", F.get_json_object("detail", "$[0][3]").cast("int").alias("start"))
    hit = assigned.join(types.targets, ["file_id", "start"]).join(variables, ["target_file", "target"]).select("file_id", F.lit("foreach_variable_assigned").alias("code"), "name", "start")
    return _findings(loops.unionByName(hit))


# Interfaces


def modport_findings(unit: Unit) -> DataFrame:
    """Members of interface ports against the modport: modport_member, modport_write and modport_read."""
    uses = unit.uses.select("file_id", "use_ordinal", "start")
    targets = unit.resolutions().where("outcome = 'resolved' and step <> 'definition'").join(uses, ["file_id", "use_ordinal"]).select("file_id", "start", "target_file", F.col("target").cast("int").alias("target"))
    field = lambda k: F.get_json_object("detail", f"$.{k}").alias(k)
    members = unit.sites.where("kind = 'member'").select("file_id", "start", field("member"), field("access"))
    ports = unit.symbols.where("kind = 'port'").select(F.col("file_id").alias("target_file"), F.col("symbol_id").alias("target"), "scope_id", "name")
    homes = unit.defs.select(F.col("file_id").alias("target_file"), "scope_id", F.col("ordinal").alias("def_ordinal"))
    typed = unit.ports.where("modport is not null").select(F.col("file_id").alias("target_file"), "def_ordinal", "name", "modport", "interface")
    seen = members.join(targets, ["file_id", "start"]).join(ports, ["target_file", "target"]).join(homes, ["target_file", "scope_id"]).join(typed, ["target_file", "def_ordinal", "name"]).select("file_id", "start", "member", "access", "interface", "modport")
    interfaces = unit.definitions().where("kind = 'interface'").select("file_id", "scope_id", F.col("name").alias("interface"))
    entries = F.from_json("members", "array<struct<name:string,direction:string>>")
    modports = unit.types.where("kind = 'modport'").join(interfaces, ["file_id", "scope_id"]).select("interface", F.get_json_object("base", "$").alias("modport"), entries.alias("entries"))
    rows = seen.join(modports, ["interface", "modport"]).withColumn("entry", F.get(F.filter("entries", lambda e: e["name"] == F.col("member")), 0))
    direction = F.col("entry.direction")
    code = (
        F.when(F.col("entry").isNull(), "modport_member")
        .when((direction == "input") & F.col("access").isin("write", "both"), "modport_write")
        .when((direction == "output") & F.col("access").isin("read", "both"), "modport_read")
    )
    return _findings(rows.select("file_id", code.alias("code"), F.col("member").alias("name"), "start").where("code is not null"))


# Texts


def syntax_findings(unit: Unit) -> DataFrame:
    """What the reader missed or couldn't place."""
    return _findings(unit.sites.where("kind = 'syntax'").select("file_id", F.lit("syntax").alias("code"), F.col("detail").alias("name"), "start"))


def time_parameters(unit: Unit, events: DataFrame) -> DataFrame:
    """file_id, name, unit and precision in force in each design unit: its own declarations, else the directive before it."""
    defs = unit.defs.select("file_id", "name", "start", "scope_id")
    own = unit.sites.where("kind in ('timeunit', 'timeprecision')").select("file_id", "scope_id", "kind", "start", F.split("detail", "/").alias("parts"))
    first = ro.precedence_pick(own, ["file_id", "scope_id", "kind"], ["start"])
    said = first.groupBy("file_id", "scope_id").agg(F.max(F.when(F.col("kind") == "timeunit", F.col("parts"))).alias("u"), F.max(F.when(F.col("kind") == "timeprecision", F.col("parts"))).alias("p"))
    rows = policies.timescale(events, defs.select("file_id", "start")).withColumnRenamed("value", "scale").join(defs, ["file_id", "start"]).join(said, ["file_id", "scope_id"], "left")
    scale = F.split("scale", "/")
    return rows.select("file_id", "name", F.coalesce(F.get("u", F.lit(0)), F.get(scale, F.lit(0))).alias("unit"), F.coalesce(F.get("p", F.lit(0)), F.get("u", F.lit(1)), F.get(scale, F.lit(1))).alias("precision"))


def findings(types: Types) -> DataFrame:
    """All findings of this module."""
    found = declaration_findings(types).unionByName(assignment_findings(types)).unionByName(cast_findings(types)).unionByName(call_findings(types.unit))
    return found.unionByName(loop_findings(types)).unionByName(modport_findings(types.unit)).unionByName(syntax_findings(types.unit))
