"""Fingerprints, the stream of changed sources, connections, calls and types of small sources."""

import os
import time

import pytest

from svloom.functions.parser import facts
from svloom.operators import connect, cursor, members
from svloom.operators.resolve import Unit
from svloom.operators.types import Types
from svloom.streaming import changes


def unit_of(spark, *texts):
    return Unit(facts(spark.createDataFrame(list(enumerate(texts)), "file_id int, text string")).cache())


def test_stream_yields_changed_names_only(spark, tmp_path):
    folder, seen = tmp_path / "src", []
    folder.mkdir()
    (folder / "a.sv").write_text("module a; int x; assign y = x; endmodule")
    (folder / "b.sv").write_text("module b; endmodule")

    def run():
        found = []
        changes.stream(spark, str(folder), str(tmp_path / "state"), str(tmp_path / "checkpoint"), lambda d: found.extend(os.path.basename(r["path"]) for r in d.collect())).awaitTermination()
        seen.append(sorted(found))

    run()
    time.sleep(1.1)
    os.remove(folder / "a.sv")
    (folder / "a2.sv").write_text("module a2; endmodule")
    run()
    assert seen == [["a.sv", "b.sv"], ["a.sv", "a2.sv"]]  # the one is gone


def test_a_changed_header_changes_what_includes_it(spark):
    head, other = ("/s/h.svh", "wire w;"), ("/s/c.sv", "module c; endmodule")
    mid = ("/s/m.svh", '`include "h.svh"\nwire v;')
    files = lambda h: spark.createDataFrame([("/s/a.sv", 'module a;\n`include "h.svh"\nendmodule'), ("/s/b.sv", '// `include "h.svh"\nmodule b; string s = "`include <h.svh>"; endmodule'), h, mid, other], "path string, text string")
    none = spark.createDataFrame([], changes._STATE)
    first, found = changes.update(spark, files(head), files(head), none)
    assert {r["path"] for r in found.collect()} == {"/s/a.sv", "/s/b.sv", "/s/h.svh", "/s/m.svh", "/s/c.sv"}
    first = spark.createDataFrame(first.collect(), changes._STATE)
    assert {r["path"]: r["includes"] for r in first.collect()} == {"/s/a.sv": ["/s/h.svh"], "/s/b.sv": [], "/s/h.svh": [], "/s/m.svh": ["/s/h.svh"], "/s/c.sv": []}
    second = files(("/s/h.svh", "wire q;"))
    _, found = changes.update(spark, second, second.where("path = '/s/h.svh'"), first)
    assert {(r["path"], r["what"]) for r in found.collect()} == {(p, "names") for p in ("/s/a.sv", "/s/h.svh", "/s/m.svh")}
    fewer = second.where("path <> '/s/c.sv'")
    _, found = changes.update(spark, fewer, fewer.limit(0), first)
    assert {(r["path"], r["what"]) for r in found.collect()} == {("/s/c.sv", "removed")}


def test_layout_changes_no_fingerprint(spark):
    text = "module m #(parameter N = 4)(input a); typedef enum {A, B} e_t; e_t v; assign v = N + a; endmodule"
    one = lambda t: spark.createDataFrame([(0, "p", t, [])], "file_id int, path string, text string, includes array<struct<kind:string,spelling:string,file_id:int,text:string>>")
    before = changes.fingerprints(one(text))
    what = lambda t: [r["what"] for r in changes.changed(before, changes.fingerprints(one(t))).collect()]
    assert what(text) == []
    assert what(text.replace(" ", "\n /* c */ ")) == ["layout"]
    assert what(text.replace("N + a", "N - a")) in (["layout"], ["names"])
    assert what(text.replace("assign v", "assign w")) == ["names"]


@pytest.mark.parametrize(
    ("ports", "statuses"),
    [
        (".a(1), .b(2)", ["matched", "matched"]), (".a(1), .*", ["implied", "matched"]), ("1", ["matched", "missing"]), ("1, 2, 3", ["matched", "matched", "overflow"]),
        (".a(1), .a(2), .b()", ["duplicate", "matched", "matched"]), (".q(1)", ["missing", "missing", "unknown"]), ("", ["missing", "missing"]),
    ],
)
def test_connections(spark, ports, statuses):
    u = unit_of(spark, f"module leaf(input a, b); endmodule module m; leaf u({ports}); endmodule")
    assert sorted(r["status"] for r in connect.connections(u).collect()) == statuses


def test_types(spark):
    u = unit_of(
        spark,
        """package p; parameter W = 4; typedef logic signed [W-1:0] s_t; typedef struct packed { s_t a; bit [1:0] b; } r_t; typedef union tagged { s_t a; byte b; bit c; } t_t; endpackage
        module m; import p::*; s_t a; r_t b; t_t c; byte d [3]; integer e; real f; string g; logic [7:0] h; s_t i [2][0:2]; logic [X:0] bad; parameter X = Y; parameter Y = X; endmodule""",
    )
    found = {r["name"]: (r["width"], r["signed"], r["four_state"]) for r in Types(u).symbols().where("kind = 'variable'").collect()}
    assert found == {"a": (4, True, True), "b": (6, False, True), "c": (10, False, True), "d": (24, True, False), "e": (32, True, True), "f": (64, False, False), "g": (None, False, False), "h": (8, False, True), "i": (24, True, True), "bad": (None, None, None)}
    assert {r["name"]: r["err"] for r in Types(u).symbols().where("kind = 'parameter'").collect()} == {"W": None, "X": "Cycle", "Y": "Cycle"}


def test_array_queries(spark):
    queries = {"$left(v)": 7, "$right(v)": 2, "$low(v)": 2, "$high(v)": 7, "$size(v)": 6, "$increment(v)": 1, "$bits(m)": 24, "$size(m)": 3, "$left(m)": 0, "$size(m, 2)": 8, "$dimensions(m)": 2, "$unpacked_dimensions(m)": 1, "$size(v, 3)": None}
    text = "module t; logic [7:2] v; logic [7:0] m [3]; " + "".join(f"localparam Q{i} = {q};" for i, q in enumerate(queries)) + " endmodule"
    found = {r["name"]: r["value"] for r in Types(unit_of(spark, text)).symbols().where("kind = 'localparam'").collect()}
    assert found == {f"Q{i}": v for i, v in enumerate(queries.values())}


def test_enums(spark):
    text = "module m; typedef enum bit [1:0] {A, B = 2, C, D} a_t; typedef enum {X, Y = 0, Z[3:1], W} b_t; typedef enum {P = lost, Q, R[-1], S, T = 9} c_t; endmodule"
    t = Types(unit_of(spark, text))
    got = {r["name"]: (r["value"], r["err"]) for r in t.enum_members().collect()}
    assert got == {
        "A": (0, None), "B": (2, None), "C": (3, None), "D": (None, "Overflow"), "X": (0, None), "Y": (0, None), "Z3": (1, None), "Z2": (2, None), "Z1": (3, None), "W": (4, None),
        "P": (None, "Unresolved"), "Q": (0, None), "R": (None, "BadRange"), "S": (None, "Unresolved"), "T": (9, None),
    }
    assert sorted((r["name"], r["code"]) for r in t.enum_findings().collect()) == [("D", "enum_overflow"), ("R", "enum_bad_range"), ("Y", "enum_duplicate_value")]
    assert sorted(str(r["values"]) for r in t.known_value_sets().collect()) == ["None", "None", "[0, 1, 2, 3, 4]"]


@pytest.mark.parametrize(
    ("assign", "widths"),
    [
        ("x = y", (4, 8)), ("x = y[3:0]", (4, 4)), ("x = {x, x}", (4, 8)), ("x = {3{x}}", (4, 12)), ("y = x + y", (8, 8)), ("x = y == y", (4, 1)), ("x = &y", (4, 1)), ("x = y[1]", (4, 1)),
        ("x = y << 2", (4, 8)), ("y[2] = x", (1, 4)), ("x = 9'd1", (4, 9)), ("x = 1 ? x : y", (4, 8)), ("x = byte'(x)", (4, 8)), ("x = y[0 +: 3]", (4, 3)), ("x = m[1]", (4, 16)), ("x = m[1][2]", (4, 1)),
    ],
)
def test_assignment_widths(spark, assign, widths):
    t = Types(unit_of(spark, f"module m; logic [3:0] x; logic [7:0] y; logic [15:0] m [4]; initial {assign}; endmodule"))
    row = t.assignments().collect()[0]
    assert (row["lhs_width"], row["rhs_width"]) == widths


def test_calls(spark):
    text = "module m; typedef enum {A} e_t; e_t e; int q[$]; int d[]; int f[4]; string s; initial begin e.next(); e.next(1, 2); q.push_front(1); d.push_front(1); f.sum(); f.sum() with (item); f.reverse() with (item); s.substr(1); $bits(q); $display(); end endmodule"
    u = unit_of(spark, text)
    found = [(r["name"], r["code"]) for r in members.method_findings(Types(u)).unionByName(members.system_findings(u)).orderBy("start").collect()]
    assert found == [("next", "method_arity"), ("push_front", "no_such_method"), ("reverse", "with_forbidden"), ("substr", "method_arity"), ("$display", "system_call_unsupported")]


def test_cursor(spark):
    text = "package p; parameter A = 1; endpackage module m; import p::A; logic [3:0] v; assign v = A; n u(); endmodule module n; endmodule"
    t = Types(unit_of(spark, text))
    places = spark.createDataFrame([(0, text.index("= A;") + 2), (0, text.index("assign v") + 7), (0, text.index("n u")), (0, 3)], "file_id int, at int")
    found = {r["name"]: (r["step"], r["kind"]) for r in cursor.resolve_at(t.unit, places).collect()}
    assert found == {"A": ("explicit_import", "parameter"), "v": ("lexical", "variable"), "n": ("definition", "module")}
    assert {r["name"]: r["width"] for r in cursor.type_at(t, places).collect()} == {"A": 32, "v": 4}


def test_check_command(spark, tmp_path, capsys):
    from svloom.__main__ import main

    (tmp_path / "inc").mkdir()
    (tmp_path / "inc" / "w.svh").write_text("wire included;\n")
    (tmp_path / "a.sv").write_text('`include <w.svh>\n`timescale 1ps/1ns\nmodule a;\n  leaf u(.z(included));\n  assign included = lost;\nendmodule\n')
    (tmp_path / "b.sv").write_text("module leaf(input z); gone g(); endmodule\n")
    code = main(["check", "--top", "a", "-I", str(tmp_path / "inc"), str(tmp_path / "a.sv"), str(tmp_path / "b.sv")])
    found = [line.removeprefix(f"{tmp_path}/") for line in capsys.readouterr().out.splitlines() if "[" in line]
    assert code == 1
    assert found == [
        "a.sv:2:1: error[timescale_precision]: 1ps/1ns",
        "a.sv:3:8: error[elaboration]: a.u.g: unknown module",
        "a.sv:5:21: error[unresolved_name]: lost",
        "b.sv:1:23: error[unresolved_name]: gone",
    ]
    (tmp_path / "ok.sv").write_text("module ok; endmodule\n")
    assert main(["check", str(tmp_path / "ok.sv")]) == 0
