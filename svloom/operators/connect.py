"""Connections of instances to the ports of their modules: by name, by place, and implied."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.operators import relops as ro
from svloom.operators.resolve import Unit

_FLAT = "file_id int, def_ordinal int, inst_start int, instance string, module string, wildcard boolean, connections array<struct<ordinal:int,port:string,connected:boolean>>"


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every instance statement of a body, generate constructs included."""

    def walk(items: list) -> Iterator[dict]:
        for x in items:
            if x["k"] == "inst":
                yield x
            for inner in (x.get("body"), *(b["body"] for b in (x.get("then"), x.get("else")) if b), *(a["block"]["body"] for a in x.get("arms", []))):
                yield from walk(inner or [])

    kind = pa.list_(pa.struct([("ordinal", pa.int32()), ("port", pa.string()), ("connected", pa.bool_())]))
    for b in batches:
        out = []
        for file, ordinal, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for x in walk(json.loads(body)):
                ports = [{"ordinal": i, "port": p[0], "connected": p[1] is not None} for i, p in enumerate(q for q in x["ports"] if len(q) == 2)]
                out.append((file, ordinal, x["start"], x["name"], x["module"], ["*"] in x["ports"], ports))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), kind), strict=True)], names=[x.split()[0] for x in _FLAT.split(", ")])


def instances(unit: Unit) -> DataFrame:
    """file_id, def_ordinal, inst_start, instance, module, wildcard (.*) and connections of each instance statement."""
    return unit.bodies.select("file_id", "ordinal", "body").mapInArrow(_flat, _FLAT)


def connections(unit: Unit) -> DataFrame:
    """file_id, inst_start, instance, port, formal (ordinal) and status of each connection and open port.

    status: matched, implied (by .*), duplicate, unknown, missing, or overflow (more than there are ports).
    """
    found = ro.written(instances(unit), "instances")
    key = ["file_id", "inst_start", "instance"]
    formal = unit.definitions().where("kind in ('module', 'interface', 'program')").select(F.col("file_id").alias("def_file"), F.col("ordinal").alias("def_at"), F.col("name").alias("module"))
    ports = formal.join(unit.ports.select(F.col("file_id").alias("def_file"), F.col("def_ordinal").alias("def_at"), F.col("ordinal").alias("formal"), F.col("name").alias("port")), ["def_file", "def_at"]).select("module", "formal", "port")
    known = found.join(formal.select("module"), "module", "left_semi")
    expected = known.join(ports, "module").select(*key, "formal", "port", "wildcard", F.exists("connections", lambda c: c["port"].isNotNull()).alias("by_name"), F.size("connections").alias("given"))
    actual = known.select(*key, F.explode("connections").alias("c")).select(*key, F.col("c.ordinal").alias("ordinal"), F.col("c.port").alias("port"))
    named = ro.named_match(actual.where("port is not null"), expected.where("by_name or wildcard or given = 0"), [*key, "port"], ["ordinal"])
    implied = F.when((F.col("status") == "missing") & F.col("wildcard"), "implied").otherwise(F.col("status"))
    named = named.select(*key, "port", "formal", implied.alias("status"))
    placed = ro.positional_join(actual.where("port is null").select(*key, F.col("ordinal").alias("formal")), expected.where("not by_name and not wildcard and given > 0").select(*key, "formal", "port"), key, "formal")
    return named.unionByName(placed.select(*key, "port", "formal", "status"))


def findings(unit: Unit) -> DataFrame:
    """unknown_port, duplicate_port, too_many_ports (errors) and missing_port (a warning)."""
    rows = connections(unit).where("status in ('unknown', 'duplicate', 'overflow', 'missing')")
    code = F.when(F.col("status") == "overflow", "too_many_ports").otherwise(F.concat("status", F.lit("_port")))
    return rows.select("file_id", code.alias("code"), F.when(F.col("status") == "missing", "warning").otherwise("error").alias("severity"), F.coalesce("port", "instance").alias("name"), F.col("inst_start").alias("start"))
