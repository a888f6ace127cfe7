"""Cases that reviewers of earlier rounds found."""

import datetime
import json

import oracle
import pyarrow as pa
from oracle import compare

from svloom.functions import parser
from svloom.operators import legality
from svloom.operators import relops as ro
from svloom.operators import types as types_of
from svloom.operators.resolve import Unit
from svloom.operators.types import Types
from svloom.plans import lane_a, lane_b


def test_interval_containment_rounds_seconds(spark, tmp_path, monkeypatch):
    at = lambda day, h, m, s, us: datetime.datetime(2024, 1, day, h, m, s, us)
    signups = [(0, at(1, 0, 0, 0, 600_000)), (1, at(1, 0, 0, 0, 400_000)), (2, at(1, 0, 0, 0, 500_000)), (3, at(1, 0, 0, 1, 500_000))]
    errors = [(4, at(1, 0, 0, 0, 700_000)), (5, at(1, 0, 0, 0, 300_000)), (6, at(1, 0, 0, 1, 500_000)), (7, at(2, 3, 46, 40, 300_000)), (8, at(2, 3, 46, 40, 500_000)), (9, at(2, 3, 46, 39, 700_000)), (10, at(2, 3, 46, 41, 500_000))]
    rows = [(i, t, kind) for kind, own in (("signup", signups), ("error", errors)) for i, t in own]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame([(i, t, 1, kind, 0.0, "{}") for i, t, kind in rows], schema).coalesce(1).write.parquet(str(tmp_path / "own"))
    part = next((tmp_path / "own").glob("*.parquet"))
    for t in oracle.TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(part if t == "events" else f"{oracle.DATA}/{t}.parquet")
    monkeypatch.setattr(oracle, "DATA", str(tmp_path))
    compare(spark, lane_b.QUERIES["interval_containment"], lane_b.ORACLES["interval_containment"])


TEXTS = [
    lane_a._F + "x = f(1, 2, 3, 4); t(1); x = x(1); x = f(1, .z(2)) + f(1, .a(2)); t(1, 5); end endmodule",
    "package p; typedef enum logic [1:0] { A, B[3] } e_t; parameter W = \"\u00fc\"; endpackage module m import p::*; #(parameter N = 2) (input logic a); for (genvar i = 0; i < N; i++) begin : g if (i) begin wire b; end end endmodule",
    "",
]


def test_typed_facts_are_the_facts(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS * 2)), "file_id int, text string").coalesce(1)
    plain, typed = parser.facts(texts).cache(), ro.written(parser.typed_facts(texts), "facts", by=["table"])
    for table in parser.FACTS:
        a, b = parser.fact_table(plain, table), parser.fact_table(typed, table)
        assert a.dtypes == b.dtypes
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_texts_of_one_small_file_are_read_in_several_tasks(spark, tmp_path):
    spark.range(10_000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    u = lane_a.written_texts(spark, str(tmp_path), "part", "p_partkey", "'wire w;'")
    assert len(u.symbols.inputFiles()) > 1 and u.symbols.count() == 10_000


def test_rules_of_calls_share_one_pass(spark):
    u = Unit(parser.facts(spark.createDataFrame(list(enumerate(TEXTS)), "file_id int, text string")).cache())
    found = legality.call_findings(u)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
    assert sorted((r["code"], r["name"]) for r in found.collect()) == [("argument_not_assignable", "o"), ("duplicate_argument", "a"), ("missing_argument", "o"), ("not_callable", "x"), ("too_many_arguments", "f"), ("unknown_argument", "z")]


def test_scopes_nest_without_joins(spark):
    u = Unit(parser.facts(spark.createDataFrame(list(enumerate(TEXTS)), "file_id int, text string")).cache())
    parents = {(r["file_id"], r["scope_id"]): r["parent_id"] for r in u.scopes.collect()}
    expected = []
    for file, scope in parents:
        at, distance = scope, 0
        while at is not None:
            expected.append((file, scope, at, distance))
            at, distance = parents[file, at], distance + 1
    above = u.ancestors()
    assert "Join" not in above._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in above.collect()) == sorted(expected)


def test_dealt_rows_stay_dealt_behind_a_join(spark):
    a, b = spark.range(8_000).withColumnRenamed("id", "file_id"), spark.range(8_000).withColumnRenamed("id", "file_id")
    rows = ro.dealt(a.join(b.hint("merge"), "file_id"), 8_000, "file_id")
    assert rows.rdd.getNumPartitions() == 5 and rows.count() == 8_000


def test_many_equal_uses_are_not_sent_to_all_tasks(spark):
    text = "module m; typedef enum { A, B } e; e x; initial x = A; endmodule"
    texts = spark.range(8_000).selectExpr("cast(id as int) as file_id", f"'{text}' as text").repartition(2)
    u = Unit(ro.written(parser.typed_facts(texts), "facts", by=["table"]))
    plan = u._resolve()._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_sides_of_many_rows_are_not_sent_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(ro, "SENT", 0)
    u = Unit(ro.written(parser.typed_facts(spark.createDataFrame([(0, "package p; parameter W = 2; endpackage module m import p::*; (input a); wire [W:0] b; endmodule"), (1, "wire w; module n; assign w = 1; m u(w); endmodule")], "file_id int, text string")), "facts", by=["table"]))
    u._surface = ro.written(u._offered(), "surface")
    resolved = u._resolve()
    assert "BroadcastExchange" not in resolved._jdf.queryExecution().executedPlan().toString()
    steps = {(r["file_id"], r["step"]) for r in resolved.collect()}
    assert {(0, "wildcard_import"), (1, "lexical"), (1, "definition")} <= steps


def test_equal_files_are_worked_once_and_keep_their_own_types(spark, monkeypatch):
    own = "module m; typedef enum { A, B } e; e x; p::f z; initial begin x = A; x = z; z = p::F; z = x; end endmodule"
    texts = [(9, "package p; typedef enum { F, G } f; endpackage"), *((i, own) for i in range(4))]
    u = Unit(ro.written(parser.typed_facts(spark.createDataFrame(texts, "file_id int, text string").coalesce(1)), "facts", by=["table"]))
    types = Types(u)
    named = {(r["file_id"], json.loads(r["type"]).get("id", "").split(":")[0]) for r in types.settled.join(u.symbols.where("name = 'e'"), ["file_id", "symbol_id"]).collect()}
    assert named == {(i, str(i)) for i in range(4)}
    found = sorted((r["file_id"], r["code"], r["start"]) for r in legality.assignment_findings(types).collect())
    assert found == sorted((i, "enum_assignment", own.index(at)) for i in range(4) for at in ("x = z", "z = x"))

    solved, worked = [], lambda *a: solved.append(a) or []
    monkeypatch.setattr(types_of, "_solve", worked)
    link = {"start": 1, "target": 0}
    rows = [{"file_id": i, "symbols": [], "links": [link | {"target_file": i}], "known": None} for i in range(3)] + [{"file_id": 3, "symbols": [], "links": [link | {"target_file": 0}], "known": None}]
    list(types_of._solved(iter([pa.RecordBatch.from_pylist(rows)])))
    assert [a[1] for a in solved] == [[(1, 0)], [(1, None)]]
