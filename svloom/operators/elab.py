"""Elaboration: from a top module down, one level of instances at a time.

A level's instances are joined with their module's body and parameters; a task expands each
(generate constructs included) into child instances with their parameter values, which the next
level joins on. All instances of a level go together, each level is written out, and a module on
its own path or at the depth limit leaves a guard row instead of going on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.functions import const
from svloom.operators import relops as ro
from svloom.operators.resolve import Unit

MOST_DEPTH, MOST_ITERATIONS = 256, 10_000

INSTANCES = "path string, parent string, module string, depth int, trail array<string>, given string, guard string"
_OUT = "kind string, path string, parent string, module string, depth int, trail array<string>, given string, guard string, params string"


def _holds(cond: list, name, var: str, v: int):
    """A loop's condition for a value: a comparison, or a constant."""
    own = lambda q, n: v if q is None and n == var else name(q, n)
    if cond[0] == "bin" and cond[1] in ("<", "<=", ">", ">=", "!="):
        a, b = const.evaluate(cond[2], own), const.evaluate(cond[3], own)
        return a if isinstance(a, str) else b if isinstance(b, str) else const.compare(cond[1], a, b)
    got = const.evaluate(cond, own)
    return got if isinstance(got, str) else got != 0


class _Expander:
    def __init__(self, path: str, module: str, depth: int, trail: list[str], env: dict[str, const.Value], packages: dict[str, const.Value]):
        self.path, self.module, self.depth, self.trail, self.env, self.packages = path, module, depth, trail, env, packages
        self.rows: list[tuple] = []

    def name(self, genvars: dict[str, int]):
        return lambda q, n: genvars[n] if q is None and n in genvars else self.env[n] if q is None and n in self.env else self.packages.get(f"{q}::{n}" if q else n, "Unresolved")

    def row(self, kind: str, path: str, module: str | None, given: str | None, guard: str | None = None) -> None:
        self.rows.append((kind, path, self.path, module, self.depth + 1, [*self.trail, module] if module else self.trail, given, guard, None))

    def body(self, items: list, at: str, genvars: dict[str, int]) -> None:
        unnamed = 0
        for item in items:
            kind = item["k"]
            if kind == "inst":
                self.instance(item, at, genvars)
                continue
            unnamed += 1
            label = item.get("name") or f"genblk{unnamed}"
            if kind == "block":
                self.scope(item, f"{at}.{label}", genvars)
            elif kind == "if":
                self.if_(item, at, unnamed, genvars)
            elif kind == "case":
                self.case(item, at, unnamed, genvars)
            elif kind == "for":
                self.for_(item, f"{at}.{label}", genvars)

    def scope(self, block: dict, path: str, genvars: dict[str, int], value: int | None = None) -> None:
        self.row("scope", path, None, None if value is None else str(value))
        self.body(block["body"], path, genvars)

    def if_(self, item: dict, at: str, n: int, genvars: dict[str, int]) -> None:
        got = const.evaluate(item["cond"], self.name(genvars))
        if isinstance(got, str):
            self.row("problem", f"{at}.genblk{n}", None, None, f"condition: {got}")
            return
        block = item["then"] if got else item["else"]
        if block:
            self.scope(block, f"{at}.{block['name'] or f'genblk{n}'}", genvars)

    def case(self, item: dict, at: str, n: int, genvars: dict[str, int]) -> None:
        got = const.evaluate(item["value"], self.name(genvars))
        if isinstance(got, str):
            self.row("problem", f"{at}.genblk{n}", None, None, f"condition: {got}")
            return
        labels = lambda arm: [const.evaluate(x, self.name(genvars)) for x in arm["labels"]]
        arm = next((a for a in item["arms"] if a["labels"] is not None and got in labels(a)), None)
        arm = arm or next((a for a in item["arms"] if a["labels"] is None), None)
        if arm:
            block = arm["block"]
            self.scope(block, f"{at}.{block['name'] or f'genblk{n}'}", genvars)

    def for_(self, item: dict, path: str, genvars: dict[str, int]) -> None:
        name, var = self.name(genvars), item["var"]
        init = const.evaluate(item["init"], name)
        if isinstance(init, str) or item["step"] is None:
            self.row("problem", path, None, None, f"loop: {init if isinstance(init, str) else 'Unsupported'}")
            return
        step = lambda v: const.evaluate(item["step"], lambda q, n: v if q is None and n == var else name(q, n))
        values, why = const.loop_values(init, lambda v: _holds(item["cond"], name, var, v), step, MOST_ITERATIONS)
        for v in values:
            self.scope(item, f"{path}[{v}]", genvars | {var: v}, v)
        if why:
            self.row("problem", path, None, None, f"loop: {why}")

    def instance(self, item: dict, at: str, genvars: dict[str, int]) -> None:
        name = self.name(genvars)
        given = {"named": {}, "positional": []}
        for x in item["params"]:
            value = const.evaluate(x[1], name) if len(x) == 2 and x[1] else None
            if len(x) == 2 and x[0]:
                given["named"][x[0]] = value
            elif len(x) == 2:
                given["positional"].append(value)
        module = item["module"]
        guard = "recursion" if module in self.trail else "depth" if self.depth + 1 >= MOST_DEPTH else None
        self.row("instance", f"{at}.{item['name']}", module, json.dumps(given, sort_keys=True), guard)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _OUT.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string()]
    for b in batches:
        for r in b.to_pylist():
            params = [json.loads(p["row"]) | {"value": json.loads(p["value"]) if p["value"] else None} for p in sorted(r["params"] or [], key=lambda p: p["ordinal"])]
            packages = {p["name"]: p["value"] for p in r["packages"] or []}
            given = json.loads(r["given"] or '{"named": {}, "positional": []}')
            look = lambda q, n: packages.get(f"{q}::{n}" if q else n, "Unresolved")  # noqa: B023, E731
            env = const.environment(params, given["named"], given["positional"], look)
            e = _Expander(r["path"], r["module"], r["depth"], r["trail"], env, packages)
            e.rows.append(("self", r["path"], r["parent"], r["module"], r["depth"], r["trail"], None, None, json.dumps(env)))
            known = {p["name"] for p in params}
            e.rows += [("problem", r["path"], r["parent"], r["module"], r["depth"], r["trail"], None, f"unknown parameter {n}", None) for n in given["named"] if n not in known]
            if len(given["positional"]) > sum(not p["local"] for p in params):
                e.rows.append(("problem", r["path"], r["parent"], r["module"], r["depth"], r["trail"], None, "too many parameters", None))
            e.body(json.loads(r["body"]), r["path"], {})
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*e.rows, strict=True), types, strict=True)], names=names)


_KNOWN = "array<struct<q:string,n:string,value:bigint,err:string>>"


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packages with the references that lead out of them: all parameters whose values can be told."""
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
    for b in batches:
        out = []
        for r in b.to_pylist():
            package = r["package"]
            trees = {x["name"]: json.loads(x["value"]) for x in r["params"]}
            known = {(x["q"], x["n"]): x["value"] if x["err"] is None else x["err"] for x in r["known"] or []}
            outer = {(x["q"], x["n"]) for x in r["links"] or []}
            values: dict[str, const.Value] = {}
            # A name is its package's own, or one that was found elsewhere; others are Unresolved.
            own = lambda q, n: q in (None, package) and n in trees  # noqa: B023, E731
            look = lambda q, n: values[n] if own(q, n) else known.get((q, n), "Unresolved")  # noqa: B023, E731
            waits, waiting = {}, {}
            for name, tree in trees.items():
                names = const.names(tree)
                if any(not own(q, n) and (q, n) in outer and (q, n) not in known for q, n in names):
                    continue
                wanted = {n for q, n in names if own(q, n)}
                waits[name] = len(wanted)
                for n in wanted:
                    waiting.setdefault(n, []).append(name)
            ready = [n for n, k in waits.items() if not k]
            while ready:
                name = ready.pop()
                values[name] = const.evaluate(trees[name], look)
                for n in waiting.get(name, ()):
                    waits[n] -= 1
                    if not waits[n]:
                        ready.append(n)
            out += [(package, n, None if isinstance(v, str) else v, v if isinstance(v, str) else None) for n, v in values.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["package", "name", "value", "err"])


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(package, q, n) for package, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for q, n in const.names(json.loads(value))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["package", "q", "n"])


def package_values(unit: Unit) -> DataFrame:
    """package, name, value and err of package parameters.

    A package's own parameters are evaluated together, however long their chains; a round follows the references that
    lead from package to package, until one settles nothing more. What is left then depends on itself: a Cycle.
    """
    schema = "package string, name string, value long, err string"
    packages = unit.definitions().where("kind = 'package'").select("file_id", "scope_id", F.col("name").alias("package"))
    symbols = unit.symbols.where("kind in ('parameter', 'localparam', 'enum_member') and value is not null")
    params = ro.written(symbols.join(packages, ["file_id", "scope_id"]).select("package", "name", "value", "file_id", "symbol_id").dropDuplicates(["package", "name"]), "parameters")
    names = params.select("package", F.col("name").alias("n"))
    out = params.select("package", "value").mapInArrow(_references, "package string, q string, n string").distinct()
    out = ro.written(out.where("q is not null and q <> package").unionByName(out.where("q is null").join(names, ["package", "n"], "left_anti")), "references")
    if out.isEmpty():
        links = unit.defs.sparkSession.createDataFrame([], "package string, q string, n string, source string, name string")
    else:
        owner = params.select(F.col("file_id").alias("target_file"), F.col("symbol_id").alias("target"), F.col("package").alias("source"), F.col("name").alias("name"))
        offered = unit.package_surface().where("ns = 'value'").withColumnRenamed("name", "n").join(owner, ["target_file", "target"]).select(F.col("package").alias("from"), "n", "source", "name")
        imports = unit.imports.withColumnRenamed("package", "from").join(packages, ["file_id", "scope_id"]).select("package", "from", "member")
        named = out.where("q is not null").withColumn("from", F.col("q")).join(offered, ["from", "n"]).withColumn("rank", F.lit(0))
        seen = out.where("q is null").join(imports, "package").where("member is null or member = n").withColumn("rank", F.when(F.col("member").isNull(), 1).otherwise(0)).drop("member").join(offered, ["from", "n"])
        every = named.select("package", "q", "n", "source", "name", "rank").unionByName(seen.select("package", "q", "n", "source", "name", "rank"))
        links = ro.written(ro.precedence_pick(every, ["package", "q", "n"], ["rank", "source", "name"]).drop("rank"), "links")
    bodies = params.groupBy("package").agg(F.collect_list(F.struct("name", "value")).alias("params"), F.count("*").alias("total"))
    bodies = ro.written(bodies.join(links.groupBy("package").agg(F.collect_list(F.struct("q", "n")).alias("links")), "package", "left"), "packages")
    settled = ro.written(bodies.withColumn("known", F.lit(None).cast(_KNOWN)).select("package", "params", "links", "known").mapInArrow(_settled, schema), "constants")
    count = settled.count()
    while True:
        known = links.join(settled.select(F.col("package").alias("source"), "name", "value", "err"), ["source", "name"]).groupBy("package").agg(F.collect_list(F.struct("q", "n", "value", "err")).alias("known"))
        done = settled.groupBy("package").agg(F.count("*").alias("done"))
        left = bodies.join(done, "package", "left").where("coalesce(done, 0) < total").select("package", "params", "links")
        more = left.join(known, "package").select("package", "params", "links", "known").mapInArrow(_settled, schema)
        fresh = more.join(settled.select("package", "name"), ["package", "name"], "left_anti").select("package", "name", "value", "err")
        settled = ro.written(settled.unionByName(fresh), "constants")
        before, count = count, settled.count()
        if count == before:
            break
    lost = params.select("package", "name").join(settled, ["package", "name"], "left_anti")
    return settled.unionByName(lost.select("package", "name", F.lit(None).cast("long").alias("value"), F.lit("Cycle").alias("err")))


def elaborate(unit: Unit, top: str, most: int = MOST_DEPTH) -> DataFrame:
    """kind (instance, scope, problem), path, parent, module, depth, guard, and params (JSON) of the whole tree."""
    defs = unit.definitions().where("kind in ('module', 'interface', 'program')").select("file_id", F.col("ordinal").alias("def_ordinal"), F.col("name").alias("module"))
    bodies = unit.bodies.withColumnRenamed("ordinal", "def_ordinal")
    rows = F.struct("ordinal", F.to_json(F.struct("name", "local")).alias("row"), "value")
    params = unit.params.groupBy("file_id", "def_ordinal").agg(F.collect_list(rows).alias("params"))
    values = package_values(unit).where("err is null")
    # A package also offers what it exports of others.
    at = unit.symbols.select(F.col("file_id").alias("target_file"), F.col("symbol_id").alias("target"), "scope_id", F.col("name").alias("own"))
    homes = unit.definitions().where("kind = 'package'").select(F.col("file_id").alias("target_file"), "scope_id", F.col("name").alias("home"))
    offered = unit.package_surface().where("ns = 'value'").join(at, ["target_file", "target"]).join(homes, ["target_file", "scope_id"])
    values = offered.join(values.select(F.col("package").alias("home"), F.col("name").alias("own"), "value"), ["home", "own"]).select("package", "name", "value")
    surface = unit.imports.join(values, "package").where("member is null or member = name").groupBy("file_id").agg(F.collect_set(F.struct("name", "value")).alias("imported"))
    named = unit.uses.where("qualifier is not null").select("file_id", F.col("qualifier").alias("package"), "name").distinct().join(values, ["package", "name"])
    qualified = named.groupBy("file_id").agg(F.collect_set(F.struct(F.concat_ws("::", "package", "name").alias("name"), "value")).alias("qualified"))
    none = F.array().cast("array<struct<name:string,value:bigint>>")
    packages = F.concat(F.coalesce("imported", none), F.coalesce("qualified", none))
    modules = defs.join(bodies, ["file_id", "def_ordinal"]).join(params, ["file_id", "def_ordinal"], "left").join(surface, "file_id", "left").join(qualified, "file_id", "left").withColumn("packages", packages)
    modules = ro.written(modules.select("module", "body", "params", "packages"), "modules")
    spark = unit.defs.sparkSession
    level = spark.createDataFrame([(top, None, top, 0, [top], None, None)], INSTANCES)
    found = spark.createDataFrame([], _OUT)
    for _ in range(most + 1):
        grown = ro.written(level.join(modules, "module").select("path", "parent", "module", "depth", "trail", "given", "body", "params", "packages").mapInArrow(_expand, _OUT), "elaborated")
        lost = level.join(modules, "module", "left_anti").select(F.lit("problem").alias("kind"), "path", "parent", "module", "depth", "trail", "given", F.lit("unknown module").alias("guard"), F.lit(None).cast("string").alias("params"))
        found = found.unionByName(grown.where("kind <> 'instance' or guard is not null")).unionByName(lost)
        level = ro.written(grown.where("kind = 'instance' and guard is null").select("path", "parent", "module", "depth", "trail", "given", "guard"), "level")
        if level.isEmpty():
            break
    kind = F.when(F.col("kind") == "self", "instance").when((F.col("kind") == "instance") & F.col("guard").isNotNull(), "problem").otherwise(F.col("kind"))
    return found.select(kind.alias("kind"), "path", "parent", "module", "depth", "guard", "params")
