"""Lexing, preprocessing, parsing, constants, resolution and elaboration of small authored sources."""

import random

import pytest
from pyspark.sql import functions as F

from svloom.functions import const
from svloom.functions import preprocess as pp
from svloom.functions.lexer import lex
from svloom.functions.parser import facts, parse
from svloom.operators import elab, policies, rules
from svloom.operators.resolve import Unit
from svloom.sources import sv_files


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("8'hFF", ["based"]), ("'1", ["unbased"]), ("1.5e3", ["real"]), ("10ns", ["time"]), ("\\a+b ", ["escaped", "space"]), ("a<<<=b", ["ident", "op", "ident"]),
        ('"a\\"b"', ["string"]), ('"open', ["string"]), ("/* open", ["block_comment"]), ("é", ["error"]), ("`x", ["directive"]), ("module", ["keyword"]), ("$clog2", ["system"]), ("12 'd 5", ["based"]),
    ],
)
def test_lex_kinds(text, kinds):
    assert [t.kind for t in lex(text)] == kinds


def test_lex_loses_nothing():
    rng = random.Random(1)
    parts = ["module", " ", "\n", '"', "'h", "/*", "*/", "//", "é", "\\x ", "`X(1)", "x", "8'hff", "1.5e3", "10ns", "\x0b", "<<<", "$", "#"]
    for _ in range(500):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        found = lex(s)
        assert "".join(t.text for t in found) == s
        assert sum(t.len for t in found) == len(s.encode())
        assert [t.start for t in found] == [sum(x.len for x in found[:i]) for i in range(len(found))]


def text_of(source, includes=None):
    return pp.preprocess(0, "f.sv", source, includes)


@pytest.mark.parametrize(
    ("source", "expanded"),
    [
        ("`define A 1\n`A", "\n1"),
        ("`define F(a,b=2) (a+b)\n`F(1) `F(1,3) `F((4,5),6)", "\n(1+2) (1+3) ((4,5)+6)"),
        ("`define C(x) x``_q\n`C(a)", "\na_q"),
        ('`define S(x) `"x`"\n`S(hi)', '\n"hi"'),
        ("`define A `B\n`define B 2\n`A", "\n\n2"),
        ("`ifdef X\na\n`elsif Y\nb\n`else\nc\n`endif", "\nc\n"),
        ("`define X\n`ifdef X\na\n`else\nb\n`endif", "\n\na\n"),
        ("`ifndef X\n`ifdef Y\na\n`endif\nb\n`endif", "\n\nb\n"),
        ("`define X 1\n`undef X\n`ifdef X\na\n`endif", "\n\n"),
        ("a\n`__LINE__", "a\n2"),
    ],
)
def test_preprocess(source, expanded):
    out = text_of(source)
    assert out.text == expanded
    assert not out.errors


def test_preprocess_errors_and_events():
    assert [m for _, _, m in text_of("`else\n").errors] == ["`else without `ifdef"]
    assert [m for _, _, m in text_of("`ifdef A\n`else\n`elsif B\n`endif").errors] == ["`elsif after `else"]
    assert "too deeply" in text_of("`define A `A\n`A").errors[0][2]
    assert [e[1] for e in text_of("`default_nettype none\n`resetall\n`timescale 1ns/1ps\n").events] == ["default_nettype", "resetall", "timescale"]
    assert text_of("`default_nettype foo\n").errors
    assert [e[1] for e in text_of("`nope\n").events] == ["undefined"]


def test_include_is_spliced_raw():
    out = text_of('`include "a.svh"\nx', {("quoted", "a.svh"): (7, "`define Q 1\nwire w;")})
    assert out.text == "`define Q 1\nwire w;\nx"
    assert out.pieces[0][1] == 7
    assert text_of("`include <a.svh>\n", {("quoted", "a.svh"): (7, "")}).errors


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("1_000", 1000), ("9223372036854775808", "Overflow"), ("8'hFF", 255), ("4'hFF", 15), ("64'hFFFFFFFFFFFFFFFF", -1), ("65'd1", "Overflow"), ("8'sh1", "Unsupported"), ("4'bx0", "NonConstant"), ("0'd5", 0),
        ("1+2*3", 7), ("7/-2", -3), ("-7%2", -1), ("5/0", "DivideByZero"), ("1<<63", -(1 << 63)), ("1<<64", "Overflow"), ("-8>>1", -4), ("9223372036854775807+1", "Overflow"), ("~0", -1), ("6&3|8^1", 11),
        ("$clog2(1)", 0), ("$clog2(9)", 4), ("$clog2(-1)", "InvalidArgument"), ("1>2", "Unsupported"), ("2**3", "Unsupported"), ("byte'(300)", 300), ("x", "Unresolved"),
    ],
)
def test_constants(text, value):
    symbol = next(s for s in parse(f"parameter Q = {text};")["symbols"] if s["name"] == "Q")
    import json

    assert const.evaluate(json.loads(symbol["value"]), lambda q, n: "Unresolved") == value


def unit_of(spark, *files):
    sources = sv_files.from_texts(spark, [(f"f{i}.sv", t) for i, t in enumerate(files)])
    full = sv_files.with_includes(sources, sv_files.include_map(sources))
    return full, pp.directive_events(full), Unit(facts(pp.expanded(full)).cache())


def outcomes(spark, *files):
    u = unit_of(spark, *files)[2]
    rows = u.resolutions().join(u.uses, ["file_id", "use_ordinal"]).orderBy("file_id", "use_ordinal").collect()
    return [(r["name"], r["outcome"], r["step"]) for r in rows]


@pytest.mark.parametrize(
    ("files", "expected"),
    [
        (["package p; parameter A = 1; endpackage module m; parameter A = 2; import p::A; assign A = A; endmodule"], [("A", "resolved", "lexical")] * 2),
        (["package p; parameter A = 1; endpackage", "module m; import p::A; parameter B = A; endmodule"], [("A", "resolved", "explicit_import")]),
        (["package p; parameter A = 1; endpackage", "module m; parameter B = A; import p::A; endmodule"], [("A", "unresolved", None)]),
        (["package p; parameter A = 1; endpackage package q; parameter A = 2; endpackage", "module m; import p::*; import q::*; parameter B = A; endmodule"], [("A", "ambiguous", "wildcard_import")]),
        (["package p; parameter A = 1; endpackage package q; parameter A = 2; endpackage", "module m; import p::*; import q::A; parameter B = A; endmodule"], [("A", "resolved", "explicit_import")]),
        (["parameter A = 1;", "module m; parameter B = A; endmodule"], [("A", "resolved", "unit")]),
        (["package p; parameter A = 1; endpackage", "module m; parameter B = p::A + p::C; endmodule"], [("A", "resolved", "explicit_import"), ("C", "unresolved", None)]),
        (["package p; typedef int t; endpackage package q; import p::*; export p::t; endpackage", "module m; import q::*; t x; endmodule"], [("t", "resolved", "wildcard_import")]),
        (["module a; b u(); endmodule module b; endmodule"], [("b", "resolved", "definition")]),
    ],
)
def test_resolution_steps(spark, files, expected):
    assert outcomes(spark, *files) == expected


def test_resolution_ignores_layout(spark):
    a = "module m; parameter A = 1; parameter B = A; endmodule"
    assert outcomes(spark, a) == outcomes(spark, a.replace(" ", "\n\n  "))


def test_policies(spark):
    _, events, u = unit_of(spark, "module a; endmodule\n`default_nettype none\n`timescale 1ns/1ps\nmodule b; endmodule\n`resetall\nmodule c; endmodule\n")
    nets = policies.default_nettype(events, u.defs.select("file_id", "start")).orderBy("start").collect()
    assert [r["value"] for r in nets] == ["wire", "none", "wire"]
    times = policies.timescale(events, u.defs.select("file_id", "start")).orderBy("start").collect()
    assert [r["value"] for r in times] == [None, "1ns/1ps", None]


def codes(spark, *files):
    _, events, u = unit_of(spark, *files)
    return sorted((r["code"], r["name"]) for r in rules.findings(u, events).collect())


def test_findings(spark):
    assert codes(spark, "module m; initial break; initial while (1) break; endmodule") == [("jump_outside_loop", "break")]
    assert codes(spark, "module m; initial return; function int f(); return 1; endfunction endmodule") == [("return_outside_callable", "return")]
    assert codes(spark, "module m; initial casez (1) inside 1: ; endcase endmodule") == [("case_modifier", "inside")]
    assert codes(spark, "module m; int a; int a; endmodule module m; endmodule") == [("duplicate_declaration", "a"), ("duplicate_definition", "m")]
    assert codes(spark, "`default_nettype none\nmodule m; assign w = 1; endmodule") == [("implicit_net_forbidden", "w")]
    assert codes(spark, "package p; parameter A = 1; endpackage module m; import p::A; int A; endmodule") == [("import_conflict", "A")]


def test_timescale_findings(spark):
    _, events, _ = unit_of(spark, "`timescale 1ps/1ns\n`timescale 2ns/1ps\n`timescale 1ns/1ns\n")
    assert sorted(r["code"] for r in rules.timescale_findings(events).collect()) == ["timescale_magnitude", "timescale_precision"]


def test_findings_are_placed_behind_macros(spark):
    line = "module m; parameter A = `LONG; parameter B = lost; parameter C = `LONG + gone; endmodule"
    sources, events, u = unit_of(spark, f"`define LONG 1234567890\n{line}\n")
    found = rules.placed(rules.findings(u, events), pp.segments(sources), sources)
    assert sorted((r["name"], r["line"], r["col"]) for r in found.collect()) == [("gone", 1, line.index("gone")), ("lost", 1, line.index("lost"))]


def test_elaboration(spark):
    design = """
    module top #(parameter N = 2); for (genvar i = 0; i < N; i++) begin : g sub #(.A(i)) u(); end
      if (N) begin : yes leaf l(); end else begin : no leaf l(); end
      case (N) 1: leaf c1(); 2: leaf c2(); default: leaf c3(); endcase
      sub #(7, 8) many(); sub #(.Z(1)) odd(); rec r(); lost x(); endmodule
    module sub #(parameter A = 1, localparam B = A * 2); endmodule
    module leaf; endmodule
    module rec; rec again(); endmodule
    """
    rows = elab.elaborate(unit_of(spark, design)[2], "top").collect()
    at = {r["path"]: r for r in rows if r["kind"] == "instance"}
    assert set(at) == {"top", "top.g[0].u", "top.g[1].u", "top.yes.l", "top.genblk3.c2", "top.many", "top.odd", "top.r"}
    assert at["top.g[1].u"]["params"] == '{"A": 1, "B": 2}'
    problems = {(r["path"], r["guard"]) for r in rows if r["kind"] == "problem"}
    assert problems == {("top.many", "too many parameters"), ("top.odd", "unknown parameter Z"), ("top.r.again", "recursion"), ("top.x", "unknown module")}


def test_generate_limits(spark):
    rows = elab.elaborate(unit_of(spark, "module top; for (genvar i = 0; i < 20000; i++) begin : g end for (genvar j = 0; j < 2; j = j + 0) begin : h end endmodule")[2], "top").collect()
    assert sum(r["kind"] == "scope" for r in rows) == elab.MOST_ITERATIONS
    assert [r["guard"] for r in rows if r["kind"] == "problem"] == ["loop: IterationLimit"]


def test_package_constants(spark):
    u = unit_of(spark, "package p; parameter A = q::B + 1; parameter X = Y; parameter Y = X; endpackage package q; parameter B = 4; endpackage")[2]
    assert {(r["name"], r["value"], r["err"]) for r in elab.package_values(u).collect()} == {("A", 5, None), ("B", 4, None), ("X", None, "Cycle"), ("Y", None, "Cycle")}


def test_include_map_and_closure(spark):
    files = [("src/a.sv", '`include "b.svh"\n// `include "no.svh"\n'), ("src/b.svh", "`include <c.svh>\n"), ("inc/b.svh", ""), ("inc/c.svh", "")]
    sources = sv_files.from_texts(spark, files)
    found = sv_files.include_map(sources, ["inc"])
    assert {tuple(r) for r in found.collect()} == {(0, "quoted", "b.svh", 1), (1, "angle", "c.svh", 3)}
    assert sorted(r[0] for r in sv_files.include_closure(found, sources.where("file_id = 0")).collect()) == [0, 1, 3]


def test_read_files(spark, tmp_path):
    for n in ("a.sv", "b.sv"):
        (tmp_path / n).write_text(f"module {n[0]};\nendmodule\n")
    rows = sv_files.read(spark, [str(tmp_path)]).orderBy("file_id").collect()
    assert sorted(r["file_id"] for r in rows) == [0, 1]
    assert {r["text"] for r in rows} == {"module a;\nendmodule\n", "module b;\nendmodule\n"}


def test_parser_survives_anything():
    base = [t.text for t in lex("module m import p::*; #(parameter N = 4) (input a); typedef enum {A, B=3} e; for (genvar i=0;i<N;i++) begin : g sub #(.X(i)) u(.a(d), .*); end always @(posedge c) if (d) q <= {2{d}}; endmodule")]
    rng = random.Random(2)
    for _ in range(400):
        s = base[:]
        for _ in range(rng.randint(1, 20)):
            j = rng.randrange(len(s))
            if rng.random() < 0.5:
                del s[j]
            else:
                s.insert(j, rng.choice(base))
        parse("".join(s))


def test_relational_kernels(spark):
    from svloom.operators import relops as ro

    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "d")], "c string, p string")
    assert {(r[0], r[1], r[2]) for r in ro.closure(edges, "c", "p").collect()} >= {("e", "a", 4), ("c", "a", 2), ("b", "a", 1)}
    with pytest.raises(ValueError, match="cycle"):
        ro.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "c string, p string"), "c", "p", most=6)
    points = spark.createDataFrame([(1, 0), (1, 5), (1, 10)], "k int, at int")
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 11), (1, 3, 3)], "k int, a int, b int")
    assert {(r["at"], r["a"]) for r in ro.interval_join(points, spans, ["k"], "at", "a", "b", 4).collect()} == {(0, 0), (5, 5), (10, 5)}
    empty = spark.createDataFrame([], "k int, at int")
    assert ro.interval_join(empty, spans, ["k"], "at", "a", "b", 4).count() == 0
    tree = ro.frontier(spark.createDataFrame([("a",)], "n string"), spark.createDataFrame([("a", "b"), ("b", "a")], "n string, c string"), "n", "c")
    assert {(r["node"], r["depth"], r["guard"]) for r in tree.collect()} == {("a", 0, None), ("b", 1, None), ("a", 2, "recursion")}


def test_column_constants(spark):
    from svloom.functions import consteval as ce

    rows = spark.createDataFrame([("8'hFF",), ("64'hFFFFFFFFFFFFFFFF",), ("4'bx",), ("65'd1",), ("8'sd1",), ("'d7",)], "t string")
    got = [tuple(r["v"]) for r in rows.select(ce.based_literal(F.col("t")).alias("v")).collect()]
    assert got == [(255, None), (-1, None), (None, "NonConstant"), (None, "Overflow"), (None, "Unsupported"), (7, None)]


def test_trees():
    from svloom.functions.tree import listing, tree

    text = "module m; wire a; assign a = 1 + 2; endmodule // end"
    nodes = tree(text)
    assert [(n[2], text[n[4] : n[5]]) for n in nodes if n[2] in ("unit", "item")] == [("unit", "module m; wire a; assign a = 1 + 2; endmodule"), ("item", "wire a;"), ("item", "assign a = 1 + 2;")]
    assert [n[0] for n in nodes] == list(range(len(nodes)))
    assert all(n[1] is None or nodes[n[1]][4] <= n[4] <= n[5] <= nodes[n[1]][5] for n in nodes)
    assert [n[:4] for n in tree(text.replace("// end", "").replace(" ", "\n  "))] == [n[:4] for n in nodes]
    lines = listing(text).split("\n")
    assert lines[0] == f"file@0..{len(text)}"
    assert '    keyword@0..6 "module"' in lines
    assert sum('"' in x for x in lines) == sum(t.kind not in ("space", "line_comment") for t in lex(text))
    base = [t.text for t in lex("module m import p::*; #(parameter N = 4) (input a); for (genvar i=0;i<N;i++) begin : g sub #(.X(i)) u(.a(d), .*); end endmodule")]
    rng = random.Random(4)
    for _ in range(200):
        s = "".join(rng.sample(base, rng.randint(0, len(base))))
        assert sum('"' in x for x in listing(s).split("\n")) >= sum(t.kind not in ("space", "line_comment", "block_comment") for t in lex(s))


def test_check_reports_findings(spark, tmp_path):
    from svloom.__main__ import check

    (tmp_path / "inc").mkdir()
    (tmp_path / "inc" / "h.svh").write_text("wire h;")
    (tmp_path / "a.sv").write_text('module a;\n`include "h.svh"\ntypedef enum { A, B } e;\ne x;\ninitial x = 1;\nint c\nendmodule\n')
    rows = check(spark, [str(tmp_path / "a.sv")], [str(tmp_path / "inc")], None).collect()
    assert [(r["line"], r["message"].split(": ")[1:]) for r in rows] == [(5, ["error[enum_assignment]", "="]), (7, ["error[syntax]", "expected ;"])]
