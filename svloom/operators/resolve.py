"""Name resolution over fact tables: candidates with ranks, then the best rank decides.

Steps in order, for each namespace in turn: enclosing scopes, explicit imports, wildcard imports,
the compilation unit, and definitions. An import counts for a use behind it only. A step with several
targets is ambiguous and ends the search. All joins are on names and scopes, so they spread over
a cluster however many files there are; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.functions.parser import FACTS, TOGETHER, fact_table
from svloom.operators import relops as ro

STEPS = ("lexical", "explicit_import", "wildcard_import", "unit", "definition")


_ABOVE = "file_id int, scope_id int, ancestor_id int, distance int"


def _above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files with their scopes: each scope with those around it."""
    names = [x.split()[0] for x in _ABOVE.split(", ")]
    made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in out], names=names)
    out: tuple[list[int], ...] = ([], [], [], [])
    for b in batches:
        for file, scopes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parents = {x["scope_id"]: x["parent_id"] for x in scopes}
            for scope in parents:
                at, distance = scope, 0
                while at is not None:
                    for column, x in zip(out, (file, scope, at, distance), strict=True):
                        column.append(x)
                    if len(out[0]) >= TOGETHER:
                        yield made(out)
                        out = ([], [], [], [])
                    at, distance = parents.get(at), distance + 1
    if out[0]:
        yield made(out)


class Unit:
    """Fact tables of the files of one compilation unit."""

    def __init__(self, facts: DataFrame):
        for table in FACTS:
            setattr(self, table, fact_table(facts, table))
        self._surface: DataFrame | None = None
        self._resolved: DataFrame | None = None

    def ancestors(self) -> DataFrame:
        """file_id, scope_id, ancestor_id and distance, each scope its own at 0; a file's scopes nest in it alone, so a file is one step."""
        return self.scopes.groupBy("file_id").agg(F.collect_list(F.struct("scope_id", "parent_id")).alias("scopes")).mapInArrow(_above, _ABOVE)

    def definitions(self) -> DataFrame:
        """The first definition of each name in the unit (by file, then order)."""
        first = self.defs.groupBy("name").agg(F.min(F.struct("file_id", "ordinal", *[c for c in self.defs.columns if c not in ("file_id", "ordinal", "name")])).alias("d"))
        return first.select("name", "d.*").select(self.defs.columns)

    def duplicate_definitions(self) -> DataFrame:
        return ro.duplicates_after_first(self.defs, ["name"], ["file_id", "ordinal"]).drop("ordinal")

    def duplicate_symbols(self) -> DataFrame:
        """Symbols whose scope and namespace had the name before, with the place of the one before."""
        return ro.adjacent_duplicates(self.symbols, ["file_id", "scope_id", "ns", "name"], ["start", "symbol_id"], "start", "previous")

    def package_surface(self) -> DataFrame:
        """package, ns, name, target_file and target: what a package offers.

        Its own symbols come first, then explicit exports, exports of a package's all, and of all imports;
        packages that are exported in turn are followed. Computed once a unit.
        """
        if self._surface is None:
            self._surface = ro.written(self._offered(), "surface")
        return self._surface

    def _offered(self) -> DataFrame:
        packages = self.definitions().where("kind = 'package'").select(F.col("name").alias("package"), "file_id", "scope_id")
        own = packages.join(self.symbols, ["file_id", "scope_id"]).select("package", "ns", "name", F.col("file_id").alias("target_file"), F.col("symbol_id").alias("target"), F.lit(0).alias("prec"))
        out = packages.join(self.exports.withColumnRenamed("package", "source"), ["file_id", "scope_id"])
        imported = packages.join(self.imports.withColumnRenamed("package", "source"), ["file_id", "scope_id"])
        # Edges (package, source, member or null, precedence).
        explicit = out.where("form = 'explicit'").select("package", "source", "member", F.lit(1).alias("prec"))
        wildcard = out.where("form = 'wildcard'").select("package", "source", F.lit(None).cast("string").alias("member"), F.lit(2).alias("prec"))
        every = out.where("form = 'all'").select("package").distinct().join(imported.select("package", "source", "member").distinct(), "package").withColumn("prec", F.lit(3))
        edges = explicit.unionByName(wildcard).unionByName(every.select("package", "source", "member", "prec")).distinct()
        surface = own
        while True:  # names are finite and each round adds some
            there = surface.select(F.col("package").alias("source"), "ns", "name", "target_file", "target")
            more = edges.join(there, "source").where("member is null or member = name").select("package", "ns", "name", "target_file", "target", "prec")
            known = surface.select("package", "ns", "name")
            fresh = ro.written(ro.precedence_pick(more, ["package", "ns", "name"], ["prec", "target_file", "target"]).join(known, ["package", "ns", "name"], "left_anti"), "surface")
            if fresh.isEmpty():
                return surface.drop("prec")
            surface = ro.written(surface.unionByName(fresh), "surface")

    def resolutions(self) -> DataFrame:
        """file_id, use_ordinal, outcome, step, target_file and target of every use; computed once a unit.

        outcome: resolved, ambiguous or unresolved. A definition's target is its ordinal.
        """
        if self._resolved is None:
            self._resolved = ro.written(self._resolve(), "resolutions")
        return self._resolved

    def _resolve(self) -> DataFrame:
        surface = ro.beside(self.package_surface())
        above = ro.written(self.ancestors(), "ancestors")
        spaces = F.when(F.col("expected_ns") == "type_then_value", F.array(F.lit("type"), F.lit("value"))).otherwise(F.array("expected_ns"))
        uses = self.uses.select("file_id", "use_ordinal", "qualifier", "name", "scope_id", "order_key", "expected_ns", F.posexplode(spaces).alias("ns_rank", "ns"))
        plain = uses.where("qualifier is null").join(above.hint("merge"), ["file_id", "scope_id"])  # files of equal rows look small, but must not be sent to all

        def rows(df: DataFrame, step: int, distance: str = "distance") -> DataFrame:
            return df.select("file_id", "use_ordinal", (F.col("ns_rank") * 10 + step).alias("rank"), F.col(distance).alias("distance"), "target_file", "target")

        bound = self.symbols.groupBy("file_id", "scope_id", "ns", "name").agg(F.min("symbol_id").alias("target")).withColumnRenamed("scope_id", "ancestor_id").withColumn("target_file", F.col("file_id"))
        lexical = rows(plain.join(bound.hint("merge"), ["file_id", "ancestor_id", "ns", "name"]), 0)
        imports = self.imports.withColumnRenamed("scope_id", "ancestor_id").withColumnRenamed("order_key", "import_key").drop("start", "ordinal")
        visible = plain.join(ro.beside(imports), ["file_id", "ancestor_id"]).where("import_key < order_key")
        explicit = rows(visible.where("member = name").join(surface, ["package", "ns", "name"]), 1)
        wildcard = rows(visible.where("member is null").join(surface, ["package", "ns", "name"]), 2)
        unit = self.symbols.where("scope_id = 0").select("ns", "name", F.col("file_id").alias("target_file"), F.col("symbol_id").alias("target"))
        there = rows(uses.where("qualifier is null or qualifier = '$unit'").withColumn("distance", F.lit(0)).join(ro.beside(unit), ["ns", "name"]), 3)
        defs = ro.written(self.definitions().select("name", F.col("file_id").alias("target_file"), F.col("ordinal").alias("target")), "definitions")
        last = uses.where("qualifier is null and expected_ns in ('definition', 'type_then_value') and ns_rank = 0").withColumn("distance", F.lit(0)).withColumn("ns_rank", F.lit(2)).join(ro.beside(defs), "name")
        qualified = rows(uses.where("qualifier is not null").withColumn("distance", F.lit(0)).join(surface.withColumnRenamed("package", "qualifier"), ["qualifier", "ns", "name"]), 1)
        found = lexical.unionByName(explicit).unionByName(wildcard).unionByName(there).unionByName(rows(last, 4)).unionByName(qualified)
        # The nearest scope of the best step; several targets there are ambiguous.
        best = found.groupBy("file_id", "use_ordinal", "rank", "distance").agg(F.min(F.struct("target_file", "target")).alias("low"), F.max(F.struct("target_file", "target")).alias("high"))
        first = best.groupBy("file_id", "use_ordinal").agg(F.min(F.struct("rank", "distance", "low", "high")).alias("f"))
        one = F.col("f.low") == F.col("f.high")
        step = F.element_at(F.array(*map(F.lit, STEPS)), (F.col("f.rank") % 10 + 1).cast("int"))
        decided = first.select("file_id", "use_ordinal", F.when(one, "resolved").otherwise("ambiguous").alias("outcome"), step.alias("step"), F.when(one, F.col("f.low.target_file")).alias("target_file"), F.when(one, F.col("f.low.target")).alias("target"))
        every = self.uses.select("file_id", "use_ordinal").join(decided.hint("merge"), ["file_id", "use_ordinal"], "left")
        return every.withColumn("outcome", F.coalesce("outcome", F.lit("unresolved")))

    def import_conflicts(self) -> DataFrame:
        """Explicit imports of a name that the scope also declares, or that another import gives another target."""
        surface = self.package_surface()
        named = self.imports.where("member is not null").join(surface, (F.col("member") == surface["name"]) & (self.imports["package"] == surface["package"])).select(self.imports["file_id"], "scope_id", "ns", "name", F.col("start"), "target_file", "target")
        local = self.symbols.select("file_id", "scope_id", "ns", "name")
        declared = named.join(local, ["file_id", "scope_id", "ns", "name"], "left_semi").select("file_id", "scope_id", "name", "start", F.lit("declared").alias("conflict"))
        many = named.groupBy("file_id", "scope_id", "ns", "name").agg(F.count_distinct("target_file", "target").alias("n"), F.max("start").alias("start")).where("n > 1")
        return declared.unionByName(many.select("file_id", "scope_id", "name", "start", F.lit("imported").alias("conflict"))).distinct()
