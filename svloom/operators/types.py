"""Constants, declared types and assignments of a unit.

A file's symbols are evaluated together, in the order of what they depend on; a round follows the uses that
resolve to other files, until one settles nothing more. What is left then depends on itself. All joins are on
(file, symbol) and (file, offset).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.functions.typing import Typer
from svloom.operators import relops as ro
from svloom.operators.resolve import Unit

_SETTLED = "file_id int, symbol_id int, value long, err string, type string, width int, signed boolean, four_state boolean"
_KINDS = ("parameter", "localparam", "variable", "net", "port", "typedef", "genvar", "enum_member")
_NAMED = "array<struct<start:int,value:bigint,err:string,type:string>>"

#: Bytes of texts of equal files whose results a task keeps.
KEPT = 1 << 24
#: In place of a file's number in its own types' ids, while equal files are worked together. JSON holds it there only.
_SELF = "@"


def _renamed(text: str | None, old: int | str, new: int | str) -> str | None:
    return text.replace(f'"id": "{old}:', f'"id": "{new}:') if text else text


class _Kept:
    """Results by what they follow from, up to KEPT bytes."""

    def __init__(self) -> None:
        self.by: dict[str, list[tuple]] = {}
        self.size = 0

    def get(self, key: str, work: Callable[[], list[tuple]]) -> list[tuple]:
        found = self.by.get(key)
        if found is None:
            found = work()
            cost = len(key) + sum(len(x) if isinstance(x, str) else 8 for row in found for x in row)
            if self.size + cost > KEPT:
                self.by, self.size = {}, 0
            self.by[key], self.size = found, self.size + cost
        return found


def _starts(e) -> set[int]:
    """Offsets of the uses in a tree or type."""
    if isinstance(e, dict):
        own = {e["start"]} if e.get("user") else set()
        return own.union(*map(_starts, e.values())) if e else own
    if isinstance(e, list):
        if len(e) == 4 and e[0] == "name" and isinstance(e[3], int):
            return {e[3]}
        return set().union(*map(_starts, e)) if e else set()
    return set()


def _rows(known: list[dict] | None, file: int | str) -> tuple[dict[int, dict], Typer]:
    by = {k["start"]: k for k in known or []}

    def value(s: int):
        if s not in by:
            return None
        k = by[s]
        return k["err"] or ("NonConstant" if k["value"] is None else k["value"])

    return by, Typer(value, lambda s: json.loads(by[s]["type"]) if s in by and by[s]["type"] else None, file)


def _evaluated(symbol: dict, tree: list | None, type_: dict | None, typer: Typer) -> dict:
    value, err = None, None
    if tree is not None:
        got = typer.const(tree)
        value, err = (None, got) if isinstance(got, str) else (got, None)
    t = typer.declared(type_) if type_ else typer.expr(tree) if tree else {"width": None, "signed": False, "four_state": False, "kind": "none", "shape": []}
    return {"value": value, "err": err, "type": t | {"is_type": symbol["kind"] == "typedef"}}


def _solve(symbols: list[dict], links: list[tuple], known: list[dict]) -> list[tuple]:
    """symbol_id, value, err, type, width, signed and four_state of all symbols of a file that can be told; links: start and own symbol, or None behind those that lead out."""
    known = {k["start"]: k | {"type": json.loads(k["type"]) if k["type"] else None} for k in known}
    own = {start: target for start, target in links if target is not None}
    outer = {start for start, target in links if target is None}
    done: dict[int, dict] = {}
    at = lambda s: done.get(own[s]) if s in own else known.get(s)

    def value(s: int):
        k = at(s)
        return None if k is None else k["err"] or ("NonConstant" if k["value"] is None else k["value"])

    typer = Typer(value, lambda s: (at(s) or {}).get("type"), _SELF)
    by = {x["symbol_id"]: x for x in symbols}
    trees, waits, waiting = {}, {}, {}
    for i, x in by.items():
        tree = json.loads(x["value"]) if x["value"] and x["kind"] in ("parameter", "localparam") else None
        type_ = json.loads(x["type"]) if x["type"] else None
        starts = _starts(tree) | _starts(type_)
        if any(s in outer and s not in known for s in starts):
            continue
        trees[i] = tree, type_
        wanted = {own[s] for s in starts if s in own}
        waits[i] = len(wanted)
        for j in wanted:
            waiting.setdefault(j, []).append(i)
    ready = [i for i, k in waits.items() if not k]
    while ready:
        i = ready.pop()
        done[i] = _evaluated(by[i], *trees[i], typer)
        for j in waiting.get(i, ()):
            waits[j] -= 1
            if not waits[j]:
                ready.append(j)
    return [(i, x["value"], x["err"], json.dumps(x["type"]), x["type"]["width"], x["type"]["signed"], x["type"]["four_state"]) for i, x in done.items()]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files with the uses that lead to their own symbols or out: all symbols that can be told. Equal files of a task are worked once."""
    names = [x.split()[0] for x in _SETTLED.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_()]
    kept = _Kept()
    for b in batches:
        out = []
        for r in b.to_pylist():
            file = r["file_id"]
            links = [(x["start"], x["target"] if x["target_file"] == file else None) for x in r["links"] or []]
            known = [k | {"type": _renamed(k["type"], file, _SELF)} for k in r["known"] or []]
            found = kept.get(repr((r["symbols"], links, known)), lambda r=r, links=links, known=known: _solve(r["symbols"], links, known))
            out += [(file, i, value, err, _renamed(type_, _SELF, file), *rest) for i, value, err, type_, *rest in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


class Types:
    """settled: value, type, width, sign and state of every symbol that could be told."""

    def __init__(self, unit: Unit):
        self.unit = unit
        uses = unit.uses.select("file_id", "use_ordinal", "start")
        targets = unit.resolutions().where("outcome = 'resolved' and step <> 'definition'").join(uses.hint("merge"), ["file_id", "use_ordinal"])
        self.targets = ro.written(targets.select("file_id", "start", F.col("target_file"), F.col("target").cast("int").alias("target")), "targets")
        self.settled = self._settle()
        self._by_file: DataFrame | None = None

    def _known(self, settled: DataFrame, outer: bool = False) -> DataFrame:
        """file_id, start and what the use there resolves to; outer: in another file."""
        there = settled.select(F.col("file_id").alias("target_file"), F.col("symbol_id").alias("target"), "value", "err", "type")
        targets = self.targets.where("target_file <> file_id") if outer else self.targets
        return targets.join(there.hint("merge"), ["target_file", "target"]).select("file_id", "start", "value", "err", "type")

    def _settle(self) -> DataFrame:
        rows = self.unit.symbols.where(F.col("kind").isin(*_KINDS))
        left = ro.written(rows.select("file_id", "symbol_id", "kind", F.when(F.col("kind").isin("parameter", "localparam"), F.col("value")).alias("value"), "type"), "symbols")
        there = left.select(F.col("file_id").alias("target_file"), F.col("symbol_id").alias("target"))
        links = self.targets.join(there.hint("merge"), ["target_file", "target"]).groupBy("file_id").agg(F.collect_list(F.struct("start", "target_file", "target")).alias("links"))
        files = left.groupBy("file_id").agg(F.collect_list(F.struct("symbol_id", "kind", "value", "type")).alias("symbols"), F.count("*").alias("total"))
        files = ro.written(files.join(links.hint("merge"), "file_id", "left"), "files")
        self._count = files.count()
        settled = ro.written(ro.dealt(files.withColumn("known", F.lit(None).cast(_NAMED)).select("file_id", "symbols", "links", "known"), self._count, "file_id").mapInArrow(_solved, _SETTLED), "settled")
        while True:
            done = settled.groupBy("file_id").agg(F.count("*").alias("done"))
            open_ = files.join(done.hint("merge"), "file_id", "left").where("coalesce(done, 0) < total").select("file_id", "symbols", "links")
            known = self._known(settled, outer=True).groupBy("file_id").agg(F.collect_list(F.struct("start", "value", "err", "type")).alias("known"))
            more = open_.join(known.hint("merge"), "file_id").select("file_id", "symbols", "links", "known").mapInArrow(_solved, _SETTLED)
            fresh = ro.written(more.join(settled.select("file_id", "symbol_id").hint("merge"), ["file_id", "symbol_id"], "left_anti").select(settled.columns), "settled")
            if fresh.isEmpty():
                return settled
            settled = ro.written(settled.unionByName(fresh), "settled")

    def symbols(self) -> DataFrame:
        """Each symbol with value, err, width, signed, four_state; err is Cycle where nothing could be told."""
        rows = self.unit.symbols.select("file_id", "symbol_id", "name", "kind", "scope_id", F.col("value").isNotNull().alias("has"))
        found = rows.join(self.settled.drop("type"), ["file_id", "symbol_id"], "left")
        lost = F.col("kind").isin("parameter", "localparam") & F.col("value").isNull() & F.col("err").isNull()
        return found.withColumn("err", F.when(lost, "Cycle").otherwise(F.col("err"))).drop("has")

    def _per_file(self, rows: DataFrame, schema: str, work: Callable[[dict, Typer], list[tuple]], alike: bool = False) -> DataFrame:
        """work on each row; a file's rows come together, with all that the file's uses resolve to.

        alike: what work tells begins with the file's id and names it nowhere else, so that equal files of a task are worked once.
        """
        if self._by_file is None:
            self._by_file = ro.written(self._known(self.settled).groupBy("file_id").agg(F.collect_list(F.struct("start", "value", "err", "type")).alias("known")), "known")
        known = self._by_file
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        names = [x.split()[0] for x in schema.split(", ")]
        types = [kinds[x.split()[1]] for x in schema.split(", ")]

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = _Kept()

            def told(rows: list[dict], known: list[dict], file: int | str) -> list[tuple]:
                typer = _rows(known, file)[1]
                return [x for r in rows for x in work(r, typer)]

            for b in batches:
                out = []
                for f in b.to_pylist():
                    file = f["file_id"]
                    if not alike:
                        out += told(f["rows"], f["known"], file)
                        continue
                    rows = [r | {"file_id": _SELF} for r in f["rows"]]
                    uses = [k | {"type": _renamed(k["type"], file, _SELF)} for k in f["known"] or []]
                    out += [(file, *x[1:]) for x in kept.get(repr((rows, uses)), lambda rows=rows, uses=uses: told(rows, uses, _SELF))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        files = rows.groupBy("file_id").agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
        return ro.dealt(files.join(known.hint("merge"), "file_id", "left"), self._count, "file_id").mapInArrow(each, schema)

    def enum_members(self) -> DataFrame:
        """file_id, start (of the enum), ordinal, name, value, err, generated, and at, where the member is declared."""
        work = lambda r, t: [(r["file_id"], r["start"], *m) for m in t.members(json.loads(r["base"]), json.loads(r["members"]))]
        return self._per_file(self.unit.types.where("kind = 'enum'").select("file_id", "start", "base", "members"), "file_id int, start int, ordinal int, name string, value long, err string, generated boolean, at int", work)

    def enum_findings(self) -> DataFrame:
        """enum_overflow, enum_duplicate_value and enum_bad_range; overflown members are no duplicates."""
        members = self.enum_members().withColumnRenamed("ordinal", "nth")
        broken = members.where("err in ('Overflow', 'BadRange', 'RangeLimit')").withColumn("code", F.when(F.col("err") == "Overflow", "enum_overflow").otherwise("enum_bad_range"))
        twice = ro.duplicates_after_first(members.where("value is not null"), ["file_id", "start", "value"], ["nth"]).withColumn("code", F.lit("enum_duplicate_value"))
        return broken.select("file_id", F.col("at").alias("start"), "name", "code").unionByName(twice.select("file_id", F.col("at").alias("start"), "name", "code"))

    def known_value_sets(self) -> DataFrame:
        """file_id, start and the sorted values of each enum, null if one can't be told."""
        return self.enum_members().groupBy("file_id", "start").agg(F.when(F.bool_and(F.col("value").isNotNull()), F.array_sort(F.collect_set("value"))).alias("values"))

    def record_fields(self) -> DataFrame:
        """file_id, start (of the record), kind, ordinal, name and width."""

        def work(r: dict, t: Typer) -> list[tuple]:
            return [(r["file_id"], r["start"], r["kind"], i, m["name"], t.declared(m["type"])["width"]) for i, m in enumerate(json.loads(r["members"]))]

        rows = self.unit.types.where("kind in ('struct', 'union', 'tagged')").select("file_id", "start", "kind", "members")
        return self._per_file(rows, "file_id int, start int, kind string, ordinal int, name string, width int", work)

    def packed_union_findings(self) -> DataFrame:
        """Members of packed unions whose width isn't the first one's: packed_union_width."""
        packed = self.unit.types.where("kind = 'union' and get_json_object(base, '$.packed') = 'true'").select("file_id", "start")
        fields = self.record_fields().join(packed, ["file_id", "start"], "left_semi")
        first = fields.where("ordinal = 0").select("file_id", "start", F.col("width").alias("w0"))
        return fields.join(first, ["file_id", "start"]).where("width <> w0").select("file_id", "start", "name", F.lit("packed_union_width").alias("code"))

    def assignments(self) -> DataFrame:
        """file_id, start, lhs_width, rhs_width, rhs_sized, four_to_two (4-state into 2-state)."""

        def work(r: dict, t: Typer) -> list[tuple]:
            left, right = json.loads(r["detail"])
            if not left or not right:
                return []
            a, b = t.expr(left), t.expr(right)
            return [(r["file_id"], r["start"], a["width"], b["width"], b.get("sized", True), b["four_state"] and not a["four_state"])]

        return self._per_file(self.unit.sites.where("kind = 'assign'").select("file_id", "start", "detail"), "file_id int, start int, lhs_width int, rhs_width int, rhs_sized boolean, four_to_two boolean", work)

    def truncations(self) -> DataFrame:
        """Assignments of a sized expression that is wider than what it is assigned to (a warning)."""
        return self.assignments().where("rhs_sized and rhs_width > lhs_width")
