"""The language operators over a design that is written from ordinary tables.

Each supplier becomes a file with a module that imports its nation's package, nations and regions
become packages, and one file holds the top module that instantiates every supplier's. So the design grows with
the tables and what the operators must find follows from the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svloom.functions import consteval as ce
from svloom.functions import lexer, parser, tree
from svloom.functions import preprocess as pp
from svloom.operators import connect, cursor, elab, legality, members, policies, rules
from svloom.operators import relops as ro
from svloom.operators.resolve import Unit
from svloom.operators.types import Types
from svloom.plans.lane_b import query, read
from svloom.sources import sv_files
from svloom.streaming import changes

NATIONS, REGIONS, TOP = 1_000_000, 2_000_000, 3_000_000

#: Texts as SQL that both engines read.
_NET = "(CASE s_suppkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'wire' ELSE 'tri' END)"
SUPPLIER_TEXT = f"""'`default_nettype ' || {_NET} || chr(10) || '`define P ' || (s_suppkey % 7) || chr(10)
|| 'module sup_' || s_suppkey || ' import nat_' || s_nationkey || '::*; #(parameter P = `P) (input logic a);' || chr(10) || '  localparam Q = P * 2 + K;' || chr(10)
|| '  for (genvar i = 0; i < P; i++) begin : g' || chr(10) || '    leaf u(.a(a));' || chr(10) || '  end' || chr(10)
|| (CASE WHEN s_suppkey % 2 = 0 THEN '  wire y;' || chr(10) ELSE '' END) || '  assign y = a & lost_' || s_suppkey || ';' || chr(10) || 'endmodule' || chr(10) || '`resetall' || chr(10) || 'module dup_' || (s_suppkey % 10) || '; endmodule' || chr(10)"""
NATION_TEXT = "'package nat_' || n_nationkey || '; parameter K = ' || n_nationkey || ' << 2; parameter R = reg_' || n_regionkey || '::B + K; export reg_' || n_regionkey || '::*; endpackage' || chr(10)"
REGION_TEXT = "'package reg_' || r_regionkey || '; parameter B = 3 * ' || r_regionkey || ' + 1; typedef enum { A' || r_regionkey || ', Z } e_t; endpackage' || chr(10)"


_TOP_BEGIN, _TOP_END = "module leaf(input logic a); endmodule\nmodule design_top;\n", "endmodule\n"


def design(spark: SparkSession, d: str) -> DataFrame:
    """file_id, path, text and includes (none)."""
    own = lambda t, key, base, stem, text: read(spark, d, t).select((F.col(key) + base).cast("int").alias("file_id"), F.concat(F.lit(stem), key, F.lit(".sv")).alias("path"), F.expr(text).alias("text"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda k: F.format_string("  sup_%d s_%d(.a(1'b1));\n", k, k)), "")
    top = read(spark, d, "supplier").agg(F.concat(F.lit(_TOP_BEGIN), lines, F.lit(_TOP_END)).alias("text")).select(F.lit(TOP).alias("file_id"), F.lit("top.sv").alias("path"), "text")
    files = own("supplier", "s_suppkey", 0, "sup_", SUPPLIER_TEXT).unionByName(own("nation", "n_nationkey", NATIONS, "nat_", NATION_TEXT)).unionByName(own("region", "r_regionkey", REGIONS, "reg_", REGION_TEXT)).unionByName(top)
    return files.withColumn("includes", F.array().cast("array<struct<kind:string,spelling:string,file_id:int,text:string>>"))


def unit(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, Unit]:
    """Sources, directive events and fact tables of the design; the facts are written once."""
    sources = ro.written(design(spark, d), "sources")
    facts = ro.written(parser.facts(pp.expanded(sources)), "facts")
    return sources, pp.directive_events(sources), Unit(facts)


@query(f"""SELECT s_suppkey AS file_id, strlen({SUPPLIER_TEXT}) AS n_bytes, 0::BIGINT AS n_errors FROM supplier UNION ALL SELECT n_nationkey + {NATIONS}, strlen({NATION_TEXT}), 0 FROM nation
UNION ALL SELECT r_regionkey + {REGIONS}, strlen({REGION_TEXT}), 0 FROM region
UNION ALL SELECT {TOP}, sum(strlen('  sup_' || s_suppkey || ' s_' || s_suppkey || '(.a(1''b1));' || chr(10)))::BIGINT + {len(_TOP_BEGIN) + len(_TOP_END)}, 0 FROM supplier""")
def sv_tokens(spark, d):
    tokens = lexer.tokens(design(spark, d))
    return tokens.groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.sum("len").alias("n_bytes"), F.sum(F.when(F.col("kind") == "error", 1).otherwise(0)).cast("long").alias("n_errors"))


@query(f"SELECT s_suppkey AS file_id, 0 AS event_seq, 'default_nettype' AS kind, {_NET} AS arg FROM supplier UNION ALL SELECT s_suppkey, 1, 'resetall', NULL FROM supplier")
def sv_directives(spark, d):
    return pp.directive_events(design(spark, d)).select(F.col("file_id").cast("long").alias("file_id"), "event_seq", "kind", "arg")


@query(f"SELECT 'sup_' || s_suppkey AS name, {_NET} AS net FROM supplier UNION ALL SELECT 'dup_' || (s_suppkey % 10), 'wire' FROM supplier")
def sv_default_nettype(spark, d):
    sources, events, u = unit(spark, d)
    modules = u.defs.where(f"kind = 'module' and file_id < {NATIONS}")
    return policies.default_nettype(events, modules.select("file_id", "start")).join(modules, ["file_id", "start"]).select("name", F.col("value").alias("net"))


@query(f"""SELECT s_suppkey AS file_id, 'sup_' || s_suppkey AS name, 'module' AS kind FROM supplier UNION ALL SELECT s_suppkey, 'dup_' || (s_suppkey % 10), 'module' FROM supplier UNION ALL SELECT n_nationkey + {NATIONS}, 'nat_' || n_nationkey, 'package' FROM nation
UNION ALL SELECT r_regionkey + {REGIONS}, 'reg_' || r_regionkey, 'package' FROM region UNION ALL SELECT {TOP}, 'leaf', 'module' UNION ALL SELECT {TOP}, 'design_top', 'module'""")
def sv_definitions(spark, d):
    return unit(spark, d)[2].defs.select(F.col("file_id").cast("long").alias("file_id"), "name", "kind")


@query("SELECT s_suppkey AS file_id, 'dup_' || (s_suppkey % 10) AS name FROM supplier QUALIFY row_number() OVER (PARTITION BY s_suppkey % 10 ORDER BY s_suppkey) > 1")
def sv_duplicate_definitions(spark, d):
    return unit(spark, d)[2].duplicate_definitions().select(F.col("file_id").cast("long").alias("file_id"), "name")


@query("""SELECT 'reg_' || r_regionkey AS package, 'value' AS ns, v.name, 'reg_' || r_regionkey AS origin FROM region JOIN (VALUES ('B'), ('Z')) v(name) ON true UNION ALL SELECT 'reg_' || r_regionkey, 'value', 'A' || r_regionkey, 'reg_' || r_regionkey FROM region
UNION ALL SELECT 'reg_' || r_regionkey, 'type', 'e_t', 'reg_' || r_regionkey FROM region
UNION ALL SELECT 'nat_' || n_nationkey, 'value', v.name, 'nat_' || n_nationkey FROM nation JOIN (VALUES ('K'), ('R')) v(name) ON true
UNION ALL SELECT 'nat_' || n_nationkey, 'value', v.name, 'reg_' || n_regionkey FROM nation JOIN (VALUES ('B'), ('Z')) v(name) ON true UNION ALL SELECT 'nat_' || n_nationkey, 'value', 'A' || n_regionkey, 'reg_' || n_regionkey FROM nation
UNION ALL SELECT 'nat_' || n_nationkey, 'type', 'e_t', 'reg_' || n_regionkey FROM nation""")
def sv_package_surface(spark, d):
    u = unit(spark, d)[2]
    origin = u.defs.where("kind = 'package'").select(F.col("file_id").alias("target_file"), F.col("name").alias("origin"))
    return u.package_surface().join(origin, "target_file").select("package", "ns", "name", "origin")


@query("SELECT 'nat_' || n_nationkey AS package, 'K' AS name, (n_nationkey * 4)::BIGINT AS value FROM nation UNION ALL SELECT 'nat_' || n_nationkey, 'R', 3 * n_regionkey + 1 + n_nationkey * 4 FROM nation UNION ALL SELECT 'reg_' || r_regionkey, 'B', 3 * r_regionkey + 1 FROM region")
def sv_constants(spark, d):
    return elab.package_values(unit(spark, d)[2]).select("package", "name", "value")


@query(f"""SELECT s_suppkey AS file_id, v.name, v.outcome, v.step, v.n FROM supplier JOIN (VALUES ('P', 'resolved', 'lexical', 2::BIGINT), ('K', 'resolved', 'wildcard_import', 1), ('i', 'resolved', 'lexical', 2), ('leaf', 'resolved', 'definition', 1), ('a', 'resolved', 'lexical', 2)) v(name, outcome, step, n) ON true
UNION ALL SELECT s_suppkey, 'lost_' || s_suppkey, 'unresolved', NULL, 1 FROM supplier
UNION ALL SELECT s_suppkey, 'y', CASE WHEN s_suppkey % 2 = 0 THEN 'resolved' WHEN s_suppkey % 3 = 0 THEN 'implicit_net_forbidden' ELSE 'implicit_net' END, CASE WHEN s_suppkey % 2 = 0 THEN 'lexical' END, 1 FROM supplier
UNION ALL SELECT {TOP}, 'sup_' || s_suppkey, 'resolved', 'definition', 1 FROM supplier
UNION ALL SELECT n_nationkey + {NATIONS}, v.name, 'resolved', v.step, 1 FROM nation JOIN (VALUES ('B', 'explicit_import'), ('K', 'lexical')) v(name, step) ON true""")
def sv_resolutions(spark, d):
    _, events, u = unit(spark, d)
    return rules.use_outcomes(u, events).groupBy(F.col("file_id").cast("long").alias("file_id"), "name", "outcome", "step").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS file_id, 'y' AS name, CASE WHEN s_suppkey % 3 = 1 THEN 'wire' ELSE 'tri' END AS net_kind FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 3 <> 0")
def sv_implicit_nets(spark, d):
    _, events, u = unit(spark, d)
    return rules.implicit_nets(rules.use_outcomes(u, events)).withColumn("file_id", F.col("file_id").cast("long"))


@query("""WITH p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 9 ELSE 8 END AS line FROM supplier)
SELECT 'sup_' || s_suppkey || '.sv:' || line || ':18: error[unresolved_name]: lost_' || s_suppkey AS message FROM p UNION ALL SELECT 'sup_' || s_suppkey || '.sv:' || line || ':10: error[implicit_net_forbidden]: y' FROM p WHERE s_suppkey % 2 = 1 AND s_suppkey % 3 = 0
UNION ALL SELECT 'sup_' || s_suppkey || '.sv:' || (line + 3) || ':8: error[duplicate_definition]: dup_' || (s_suppkey % 10) FROM p QUALIFY row_number() OVER (PARTITION BY s_suppkey % 10 ORDER BY s_suppkey) > 1""")
def sv_diagnostics(spark, d):
    sources, events, u = unit(spark, d)
    found = rules.placed(rules.findings(u, events), pp.segments(sources), sources)
    return rules.rendered(found, sources).select("message")


@query("""SELECT 'instance' AS kind, 'design_top' AS path, 'design_top' AS module, 0 AS depth, NULL::BIGINT AS p, NULL::BIGINT AS q
UNION ALL SELECT 'instance', 'design_top.s_' || s_suppkey, 'sup_' || s_suppkey, 1, s_suppkey % 7, (s_suppkey % 7) * 2 + s_nationkey * 4 FROM supplier
UNION ALL SELECT 'scope', 'design_top.s_' || s_suppkey || '.g[' || i || ']', NULL, 2, NULL, NULL FROM (SELECT s_suppkey, unnest(range(0, s_suppkey % 7)) AS i FROM supplier) x
UNION ALL SELECT 'instance', 'design_top.s_' || s_suppkey || '.g[' || i || '].u', 'leaf', 2, NULL, NULL FROM (SELECT s_suppkey, unnest(range(0, s_suppkey % 7)) AS i FROM supplier) x""")
def sv_elaborate(spark, d):
    tree = elab.elaborate(unit(spark, d)[2], "design_top")
    value = lambda n: F.get_json_object("params", f"$.{n}").cast("long")
    return tree.select("kind", "path", "module", "depth", value("P").alias("p"), value("Q").alias("q"))


# Types: each nation becomes a package of types and a module that uses them.

_W = "(n_nationkey % 7 + 1)"
TYPED_TEXT = f"""'package tp_' || n_nationkey || ';' || chr(10) || 'parameter W = ' || {_W} || ';' || chr(10) || 'typedef logic [W-1:0] word_t;' || chr(10) || 'typedef struct packed {{ word_t a; logic signed [3:0] b; }} rec_t;' || chr(10)
|| 'typedef union packed {{ word_t a; byte b; }} un_t;' || chr(10) || 'typedef enum logic [7:0] {{ E0, E1 = W, E2[2], E5 }} en_t;' || chr(10) || 'endpackage' || chr(10)
|| 'module tm_' || n_nationkey || '; import tp_' || n_nationkey || '::*; word_t x; rec_t r; un_t u; en_t e; logic [$bits(r)-1:0] m [0:W]; int i;' || chr(10)
|| 'localparam B = $bits(m) + $size(m) + $left(x);' || chr(10) || 'assign x = r;' || chr(10) || 'assign i = x;' || chr(10) || 'assign x = x + 1;' || chr(10) || 'assign x = {{x, 1''b0}};' || chr(10) || 'assign x = r.a;' || chr(10) || 'endmodule' || chr(10)"""


def typed(spark: SparkSession, d: str) -> Types:
    sources = read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("file_id"), F.concat(F.lit("tp_"), "n_nationkey", F.lit(".sv")).alias("path"), F.expr(TYPED_TEXT).alias("text"), F.array().cast("array<struct<kind:string,spelling:string,file_id:int,text:string>>").alias("includes"))
    return Types(Unit(ro.written(parser.facts(pp.expanded(sources)), "facts")))


@query(f"""WITH n AS (SELECT n_nationkey AS file_id, {_W} AS w FROM nation)
SELECT file_id, v.name, CASE v.name WHEN 'x' THEN w WHEN 'r' THEN w + 4 WHEN 'u' THEN greatest(w, 8) WHEN 'e' THEN 8 WHEN 'm' THEN (w + 4) * (w + 1) ELSE 32 END AS width, v.name = 'i' AS signed, v.name <> 'i' AS four_state
FROM n JOIN (VALUES ('x'), ('r'), ('u'), ('e'), ('m'), ('i')) v(name) ON true""")
def sv_symbol_types(spark, d):
    return typed(spark, d).symbols().where("kind = 'variable'").select("file_id", "name", "width", "signed", "four_state")


@query(f"""WITH n AS (SELECT n_nationkey AS file_id, {_W} AS w FROM nation) SELECT file_id, 'W' AS name, w::BIGINT AS value FROM n UNION ALL SELECT file_id, 'B', (w + 4) * (w + 1) + w + 1 + w - 1 FROM n""")
def sv_parameter_values(spark, d):
    return typed(spark, d).symbols().where("kind in ('parameter', 'localparam')").select("file_id", "name", "value")


@query(f"""WITH n AS (SELECT n_nationkey AS file_id, {_W} AS w FROM nation)
SELECT file_id, v.i AS ordinal, v.name, (CASE WHEN v.i = 0 THEN 0 ELSE w + v.i - 1 END)::BIGINT AS value, v.i IN (2, 3) AS generated FROM n JOIN (VALUES (0, 'E0'), (1, 'E1'), (2, 'E20'), (3, 'E21'), (4, 'E5')) v(i, name) ON true""")
def sv_enum_members(spark, d):
    return typed(spark, d).enum_members().select("file_id", "ordinal", "name", "value", "generated")


@query(f"""WITH n AS (SELECT n_nationkey AS file_id, {_W} AS w FROM nation) SELECT file_id, v.kind, v.i AS ordinal, v.name, CASE WHEN v.name = 'a' THEN w WHEN v.kind = 'struct' THEN 4 ELSE 8 END AS width
FROM n JOIN (VALUES ('struct', 0, 'a'), ('struct', 1, 'b'), ('union', 0, 'a'), ('union', 1, 'b')) v(kind, i, name) ON true""")
def sv_record_fields(spark, d):
    return typed(spark, d).record_fields().select("file_id", "kind", "ordinal", "name", "width")


@query("SELECT n_nationkey AS file_id, 'b' AS name, 'packed_union_width' AS code FROM nation")
def sv_packed_unions(spark, d):
    return typed(spark, d).packed_union_findings().select("file_id", "name", "code")


@query(f"""WITH n AS (SELECT n_nationkey AS file_id, {_W} AS w FROM nation) SELECT file_id, w AS lhs_width, w + 4 AS rhs_width FROM n UNION ALL SELECT file_id, w, w + 1 FROM n""")
def sv_truncations(spark, d):
    return typed(spark, d).truncations().select("file_id", "lhs_width", "rhs_width")


# Connections, places and calls


@query(f"""SELECT s_suppkey AS file_id, 'u' AS instance, 'a' AS port, 'matched' AS status FROM supplier UNION ALL SELECT {TOP}, 's_' || s_suppkey, 'a', 'matched' FROM supplier""")
def sv_connections(spark, d):
    return connect.connections(unit(spark, d)[2]).select(F.col("file_id").cast("long").alias("file_id"), "instance", "port", "status")


PORTS_TEXT = "'module leaf(input a, input b); endmodule module p' || p_partkey || '; leaf u(' || (CASE p_partkey % 6 WHEN 0 THEN '1, 2' WHEN 1 THEN '1, 2, 3' WHEN 2 THEN '.a(1)' WHEN 3 THEN '.a(1), .z(2), .b(3)' WHEN 4 THEN '.a(1), .a(2), .b(1)' ELSE '.*' END) || '); endmodule'"


@query("""SELECT p_partkey AS file_id, v.code, v.severity, v.name FROM part JOIN (VALUES (1, 'too_many_ports', 'error', 'u'), (2, 'missing_port', 'warning', 'b'), (3, 'unknown_port', 'error', 'z'), (4, 'duplicate_port', 'error', 'a')) v(k, code, severity, name) ON v.k = p_partkey % 6""")
def sv_port_findings(spark, d):
    sources = read(spark, d, "part").select(F.col("p_partkey").cast("int").alias("file_id"), F.expr(PORTS_TEXT).alias("text"))
    return connect.findings(Unit(ro.written(parser.facts(sources), "facts"))).select(F.col("file_id").cast("long").alias("file_id"), "code", "severity", "name")


@query(f"""SELECT n_nationkey + {NATIONS} AS file_id, 'K' AS name, 'lexical' AS step, 'parameter' AS kind, strpos({NATION_TEXT}, 'K =') - 1 AS declared_at FROM nation""")
def sv_resolve_at(spark, d):
    u = unit(spark, d)[2]
    text = read(spark, d, "nation").select((F.col("n_nationkey") + NATIONS).cast("int").alias("file_id"), F.expr(f"instr({NATION_TEXT}, '+ K;') + 1").alias("at"))
    return cursor.resolve_at(u, text).select("file_id", "name", "step", "kind", F.col("declared_at").cast("long").alias("declared_at"))


CALLS_TEXT = "'module c' || s_suppkey || '; int q[$]; string s; int m[string]; initial begin ' || (CASE s_suppkey % 7 WHEN 0 THEN 'q.push_back(1);' WHEN 1 THEN 'q.push_back();' WHEN 2 THEN 'q.find();' WHEN 3 THEN 's.nope();' WHEN 4 THEN 'm.push_back(1);' WHEN 5 THEN '$pow(1);' ELSE '$nope(1); $clog2(2);' END) || ' end endmodule'"


@query("""SELECT s_suppkey AS file_id, v.name, v.code FROM supplier JOIN (VALUES (1, 'push_back', 'method_arity'), (2, 'find', 'with_needed'), (3, 'nope', 'no_such_method'), (4, 'push_back', 'no_such_method'), (5, '$pow', 'system_call_arity'), (6, '$nope', 'system_call_unsupported')) v(k, name, code) ON v.k = s_suppkey % 7""")
def sv_call_findings(spark, d):
    sources = read(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("file_id"), F.expr(CALLS_TEXT).alias("text"))
    u = Unit(ro.written(parser.facts(sources), "facts"))
    return members.method_findings(Types(u)).unionByName(members.system_findings(u)).select(F.col("file_id").cast("long").alias("file_id"), "name", "code")


@query("SELECT n_nationkey AS file_id, CASE n_nationkey % 3 WHEN 0 THEN 'layout' ELSE 'names' END AS what FROM nation WHERE n_nationkey % 3 < 2")
def sv_changes(spark, d):
    """Every third file gets other white space, every third another name."""
    nation = read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("file_id"), F.concat(F.lit("n"), "n_nationkey").alias("path"), F.expr(TYPED_TEXT).alias("text"), F.array().cast("array<struct<kind:string,spelling:string,file_id:int,text:string>>").alias("includes"))
    edited = F.when(F.col("file_id") % 3 == 0, F.replace("text", F.lit(" "), F.lit("  "))).when(F.col("file_id") % 3 == 1, F.replace("text", F.lit("word_t"), F.lit("term_t"))).otherwise(F.col("text"))
    return changes.changed(changes.fingerprints(nation), changes.fingerprints(nation.withColumn("text", edited)))


# Chains, literals, includes and enums

DEEP_TEXT = """'package deep_' || n_nationkey || ';' || array_join(transform(sequence(200, 1, -1), i -> 'parameter A' || i || ' = A' || (i - 1) || ' + 1;'), '') || 'parameter A0 = ' || n_nationkey || ';'
|| 'parameter X = Y; parameter Y = X; parameter Z = nowhere + 1; endpackage module dm_' || n_nationkey || '; import deep_' || n_nationkey || '::*; localparam L0 = A200;' || array_join(transform(sequence(1, 200), i -> 'localparam L' || i || ' = L' || (i - 1) || ' + 1;'), '') || 'endmodule'"""
_DEEP_ODD = "SELECT n_nationkey AS file_id, v.name, NULL::BIGINT AS value, v.err FROM nation JOIN (VALUES ('X', 'Cycle'), ('Y', 'Cycle'), ('Z', 'Unresolved')) v(name, err) ON true"


def written_texts(spark: SparkSession, d: str, table: str, key: str, text: str) -> Unit:
    """The facts of a file a row. Texts take a hundred times their rows' room and time, so the rows are dealt out first."""
    rows = read(spark, d, table)
    texts = ro.dealt(rows, rows.count(), key).select(F.col(key).cast("int").alias("file_id"), F.expr(text).alias("text"))
    return Unit(ro.written(parser.typed_facts(texts), "facts", by=["table"]))


@query(f"SELECT n_nationkey AS file_id, 'A' || i AS name, (n_nationkey + i)::BIGINT AS value, NULL AS err FROM nation, range(0, 201) r(i) UNION ALL {_DEEP_ODD}")
def sv_deep_constants(spark, d):
    values = elab.package_values(written_texts(spark, d, "nation", "n_nationkey", DEEP_TEXT))
    return values.select(F.regexp_extract("package", "_(.*)", 1).cast("int").alias("file_id"), "name", "value", "err")


@query(f"""SELECT n_nationkey AS file_id, 'A' || i AS name, (n_nationkey + i)::BIGINT AS value, NULL AS err FROM nation, range(0, 201) r(i) UNION ALL {_DEEP_ODD}
UNION ALL SELECT n_nationkey, 'L' || i, (n_nationkey + 200 + i)::BIGINT, NULL FROM nation, range(0, 201) r(i)""")
def sv_deep_parameters(spark, d):
    return Types(written_texts(spark, d, "nation", "n_nationkey", DEEP_TEXT)).symbols().where("kind in ('parameter', 'localparam')").select("file_id", "name", "value", "err")


#: What stands before the digits, and whether these are the row's own.
_LITERALS = (("'h", "own"), ("8'h", "own"), ("8'bx", ""), ("8'sh", "own"), ("'hFFFFFFFF", "long"), ("8'shx", ""), ("12'h00000000000000000000", "own"), ("64'hFFFFFFFFFFFFFFFF", ""), ("'h7fffffffffffffff", ""), ("65'h", "own"))


@query("""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN p_partkey * 1000003 WHEN 1 THEN (p_partkey * 1000003) % 256 WHEN 6 THEN (p_partkey * 1000003) % 4096 WHEN 7 THEN -1 WHEN 8 THEN 9223372036854775807 END::BIGINT AS value,
CASE p_partkey % 10 WHEN 2 THEN 'NonConstant' WHEN 3 THEN 'Unsupported' WHEN 4 THEN 'Overflow' WHEN 5 THEN 'NonConstant' WHEN 9 THEN 'Overflow' END AS err FROM part""")
def sv_literals(spark, d):
    digits = F.hex(F.col("p_partkey") * 1000003)
    text = F.lit(None).cast("string")
    for i, (head, rest) in enumerate(_LITERALS):
        own = F.concat(F.lit(head), {"own": digits, "long": F.lpad(digits, 16, "0"), "": F.lit("")}[rest])
        text = F.when(F.col("p_partkey") % 10 == i, own).otherwise(text)
    got = ce.based_literal(text)
    return read(spark, d, "part").select("p_partkey", got["value"].alias("value"), got["err"].alias("err"))


INCLUDING = """'string s = "`include <no.svh> /* ";' || chr(10) || '// `include "no.svh"' || chr(10) || '`include "h_' || n_regionkey || '.svh"' || chr(10) || '/* `include <no.svh> */ `include <h_' || (n_regionkey + 1) % 5 || '.svh>' || chr(10)"""


@query(f"""SELECT n_nationkey AS file_id, v.kind, 'h_' || (CASE v.kind WHEN 'quoted' THEN n_regionkey ELSE (n_regionkey + 1) % 5 END) || '.svh' AS spelling, {REGIONS} + (CASE v.kind WHEN 'quoted' THEN n_regionkey ELSE (n_regionkey + 1) % 5 END) AS target_file_id
FROM nation JOIN (VALUES ('quoted'), ('angle')) v(kind) ON true""")
def sv_includes(spark, d):
    roots = read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("file_id"), F.concat(F.lit("src/n_"), "n_nationkey", F.lit(".sv")).alias("path"), F.expr(INCLUDING).alias("text"))
    heads = read(spark, d, "region").select((F.col("r_regionkey") + REGIONS).cast("int").alias("file_id"), F.concat(F.lit("inc/h_"), "r_regionkey", F.lit(".svh")).alias("path"), F.lit("").alias("text"))
    return sv_files.include_map(ro.written(roots.unionByName(heads), "sources"), ["inc"])


ENUMS_TEXT = "'package en_' || n_nationkey || '; typedef enum logic [2:0] { B = 1, A = 1, C = ' || (n_nationkey % 12) || ', D' || ' } e_t; endpackage'"


@query(f"""WITH n AS (SELECT n_nationkey AS k, n_nationkey % 12 AS c, {ENUMS_TEXT} AS t FROM nation)
SELECT k AS file_id, 'A' AS name, 'enum_duplicate_value' AS code, strpos(t, 'A = 1') - 1 AS start FROM n UNION ALL SELECT k, 'C', 'enum_overflow', strpos(t, 'C = ') - 1 FROM n WHERE c > 7 UNION ALL SELECT k, 'C', 'enum_duplicate_value', strpos(t, 'C = ') - 1 FROM n WHERE c = 1
UNION ALL SELECT k, 'D', 'enum_overflow', strpos(t, ', D') + 1 FROM n WHERE c + 1 > 7 UNION ALL SELECT k, 'D', 'enum_duplicate_value', strpos(t, ', D') + 1 FROM n WHERE c + 1 = 1""")
def sv_enum_findings(spark, d):
    found = Types(written_texts(spark, d, "nation", "n_nationkey", ENUMS_TEXT)).enum_findings()
    return found.select("file_id", "name", "code", F.col("start").cast("long").alias("start"))


# Legality: each part becomes a file that follows a rule or breaks it, by its key


def _cases(table: str, key: str, cases: list[tuple[str, list[tuple[str, str]]]]) -> tuple[str, str]:
    """The text of a row's file, and SQL for the findings: (text, [(code, name)]) by the key's remainder."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    text = f"CASE {key} % {len(cases)} " + " ".join(f"WHEN {i} THEN {quoted(t)}" for i, (t, _) in enumerate(cases)) + " END"
    rows = ", ".join(f"({i}, {quoted(code)}, {quoted(name)})" for i, (_, found) in enumerate(cases) for code, name in found)
    return text, f"SELECT {key} AS file_id, v.code, v.name FROM {table} JOIN (VALUES {rows}) v(k, code, name) ON v.k = {key} % {len(cases)}"


def _told(found: DataFrame) -> DataFrame:
    return found.select(F.col("file_id").cast("long").alias("file_id"), "code", "name")


DECLARATIONS, _DECLARATIONS_SQL = _cases("part", "p_partkey", [
    ("module m; typedef struct { int a; real b; } s; typedef union tagged { void x; int y; } t; int q[$:4]; const int c = 1; endmodule", []),
    ("module m; typedef struct { void a; int b; } s; endmodule", [("void_member", "a")]),
    ("module m; typedef struct packed { logic [3:0] a; real b; } s; endmodule", [("packed_member_type", "b")]),
    ("module m; typedef struct { int x; } u; typedef struct packed { u a; byte b; string c; } s; endmodule", [("packed_member_type", "a"), ("packed_member_type", "c")]),
    ("module m; typedef enum real { A, B } e; endmodule", [("enum_base", "enum")]),
    ("module m; int n; int q[$:n]; int r[$:0]; endmodule", [("queue_bound_not_constant", "q"), ("queue_bound_not_positive", "r")]),
    ("module m; localparam N = 2 - 3; int a[N]; const int c; endmodule", [("array_size_not_positive", "a"), ("const_uninitialised", "c")]),
    ("module m; automatic int a; initial begin automatic int b; end void v; endmodule", [("automatic_outside_procedure", "automatic"), ("void_variable", "v")]),
])


@query(_DECLARATIONS_SQL)
def sv_declaration_findings(spark, d):
    return _told(legality.declaration_findings(Types(written_texts(spark, d, "part", "p_partkey", DECLARATIONS))))


ASSIGNMENTS, _ASSIGNMENTS_SQL = _cases("part", "p_partkey", [
    ("module m; typedef enum { A, B } e; e x, y; int i; int p[3]; int q[3]; initial begin x = y; x = A; x = e'(1); i = x; p = q; end endmodule", []),
    ("module m; typedef enum { A, B } e; typedef enum { C, D } f; e x; f y; initial begin x = y; x = 1; end e z = y; endmodule", [("enum_assignment", "=")] * 2 + [("enum_assignment", "z")]),
    ("module m; typedef struct { int a; } s; typedef struct { int a; } t; s x, w; t y; int i; initial begin x = w; x = y; i = x; x = i; end endmodule", [("record_assignment", "=")] * 3),
    ("module m; typedef struct packed { int a; } s; typedef struct packed { int a; } t; s x; t y; int i; initial begin x = y; i = x; x = i; end endmodule", []),
    ("module m; int a[3]; int b[4]; int c; int d[]; initial begin a = b; c = a; d = a; a = c; end endmodule", [("array_assignment", "=")] * 3),
    ("module m; assign w = x; endmodule", []),
    ("module m; int d[]; int e[] = new[3]; int f[3]; initial begin d = new[4]; f = new[2]; d = new[1 - 2]; end endmodule", [("new_not_dynamic", "="), ("new_size_negative", "=")]),
    ("module m; int a; initial begin 3 = a; a + 1 = 2; {a, a} = 3; end endmodule", [("invalid_target", "=")] * 2),
])


@query(_ASSIGNMENTS_SQL)
def sv_assignment_findings(spark, d):
    return _told(legality.assignment_findings(Types(written_texts(spark, d, "part", "p_partkey", ASSIGNMENTS))))


_F = "module m; int x; function int f(input int a, int b = 2, int c = 3); return a; endfunction task t; input i; output [3:0] o; endtask initial begin "
CALLS, _CALLS_SQL = _cases("part", "p_partkey", [
    (_F + "x = f(1) + f(1, 2) + f(1, .c(3)) + f(.a(1)) + f(1, , 3); t(1, x); lost(1); end endmodule", []),
    (_F + "x = f(1, 2, 3, 4); end endmodule", [("too_many_arguments", "f")]),
    (_F + "x = f(); t(1); x = f(, 2); end endmodule", [("missing_argument", "a"), ("missing_argument", "o"), ("missing_argument", "a")]),
    (_F + "x = f(1, .z(2)); end endmodule", [("unknown_argument", "z")]),
    (_F + "x = f(1, .a(2)) + f(1, .b(1), .b(2)); end endmodule", [("duplicate_argument", "a"), ("duplicate_argument", "b")]),
    (_F + "x = x(1); end endmodule", [("not_callable", "x")]),
    (_F + "t(1, 5); t(x, {x, x}); t(.i(2), .o(x + 1)); end endmodule", [("argument_not_assignable", "o")] * 2),
])


@query(_CALLS_SQL)
def sv_argument_findings(spark, d):
    return _told(legality.call_findings(written_texts(spark, d, "part", "p_partkey", CALLS)))


LOOPS, _LOOPS_SQL = _cases("part", "p_partkey", [
    ("module m; int a[3][4]; int s; string t; int w[*]; initial begin foreach (a[i, j]) s = s + i; foreach (a[i]) s = i; foreach (t[k]) s = k; foreach (a[, j]) s = j; end endmodule", []),
    ("module m; int a[3][4]; int s; initial foreach (a[i, j, k, l]) s = i; endmodule", [("foreach_too_many_variables", "a")]),
    ("module m; int a[3][4]; int s; initial foreach (a[i, i]) s = i; endmodule", [("foreach_duplicate_variable", "i")]),
    ("module m; int a[3][4]; initial foreach (a[i]) i = 1; endmodule", [("foreach_variable_assigned", "i")]),
    ("module m; real r; int w[*]; int s; initial begin foreach (r[i]) s = i; foreach (w[j]) s = j; end endmodule", [("foreach_not_array", "r"), ("foreach_wildcard", "w")]),
])


@query(_LOOPS_SQL)
def sv_loop_findings(spark, d):
    return _told(legality.loop_findings(Types(written_texts(spark, d, "part", "p_partkey", LOOPS))))


_I = "'interface bus_' || n_nationkey || '; logic a, b, c; modport mp(input a, output b, ref c); endinterface module m_' || n_nationkey || '(bus_' || n_nationkey || '.mp p); '"
MEMBERS_TEXT = f"{_I} || (CASE n_nationkey % 5 WHEN 0 THEN 'logic x; assign x = p.a; assign p.b = x; assign p.c = p.c;' WHEN 1 THEN 'assign p.a = 1;' WHEN 2 THEN 'logic x; assign x = p.b;' WHEN 3 THEN 'assign p.z = 1;' ELSE 'initial begin p.a += 1; p.b += 1; end' END) || ' endmodule'"


@query("""SELECT n_nationkey AS file_id, v.code, v.name FROM nation JOIN (VALUES (1, 'modport_write', 'a'), (2, 'modport_read', 'b'), (3, 'modport_member', 'z'), (4, 'modport_write', 'a'), (4, 'modport_read', 'b')) v(k, code, name) ON v.k = n_nationkey % 5""")
def sv_modport_findings(spark, d):
    return _told(legality.modport_findings(written_texts(spark, d, "nation", "n_nationkey", MEMBERS_TEXT)))


SYNTAX, _SYNTAX_SQL = _cases("part", "p_partkey", [
    ("module m; wire a; assign a = 1; initial begin a = 1; end function void f(); endfunction endmodule", []),
    ("module m; wire a", [("syntax", "expected ;"), ("syntax", "missing endmodule")]),
    ("module m; wire a; assign a = 1 endmodule", [("syntax", "expected ;")]),
    ("module m; initial begin a = 1; endmodule", [("syntax", "missing end")]),
    ("module ; endmodule", [("syntax", "expected a name")]),
    ("module m; 5; function f; endmodule", [("syntax", "unexpected 5"), ("syntax", "missing endfunction")]),
    ("package p; class c; rand int x; constraint k { x > 0; } endclass endpackage module m; property q; @(posedge c) a |-> b; endproperty endmodule", []),
])


@query(_SYNTAX_SQL)
def sv_syntax_findings(spark, d):
    return _told(legality.syntax_findings(written_texts(spark, d, "part", "p_partkey", SYNTAX)))


TIMES_TEXT = "(CASE n_nationkey % 4 WHEN 0 THEN '' ELSE '`timescale 1ns/1ps' END) || chr(10) || 'module m; ' || (CASE n_nationkey % 4 WHEN 2 THEN 'timeunit 1us;' WHEN 3 THEN 'timeunit 10ns / 100ps;' ELSE '' END) || ' endmodule'"


@query("""SELECT n_nationkey AS file_id, 'm' AS name, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '1ns' WHEN 2 THEN '1us' ELSE '10ns' END AS unit, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 3 THEN '100ps' ELSE '1ps' END AS precision FROM nation""")
def sv_time_parameters(spark, d):
    sources = read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("file_id"), F.lit("t.sv").alias("path"), F.expr(TIMES_TEXT).alias("text"), F.array().cast("array<struct<kind:string,spelling:string,file_id:int,text:string>>").alias("includes"))
    return legality.time_parameters(Unit(ro.written(parser.facts(pp.expanded(sources)), "facts")), pp.directive_events(sources))


RANGES_TEXT = "'package rp_' || n_nationkey || '; typedef enum { R[' || (n_nationkey % 4) || '], S[3:2], T } e_t; endpackage module rm_' || n_nationkey || '; import rp_' || n_nationkey || '::*; int x; initial begin x = R0 + R2 + S2 + S4 + T; end enum { S2, R1 } y; endmodule'"


@query("""SELECT n_nationkey AS file_id, v.name, CASE WHEN v.least <= n_nationkey % 4 THEN 'resolved' ELSE 'unresolved' END AS outcome FROM nation JOIN (VALUES ('R0', 1), ('R2', 3), ('S4', 9), ('T', 0), ('S2', 0)) v(name, least) ON true""")
def sv_range_names(spark, d):
    u = written_texts(spark, d, "nation", "n_nationkey", RANGES_TEXT)
    names = u.uses.select("file_id", "use_ordinal", "name").where("name not in ('x', 'e_t')")
    return u.resolutions().join(names, ["file_id", "use_ordinal"]).select("file_id", "name", "outcome")


CASTS_TEXT = "'module ca_' || n_nationkey || '; typedef enum int { A = 1, B = 3 } e_t; e_t x; initial begin x = e_t''(' || n_nationkey || '); x = e_t''(B); end endmodule'"


@query("SELECT n_nationkey AS file_id, 'cast_enum_range' AS code, 'warning' AS severity, 'e_t' AS name FROM nation WHERE n_nationkey NOT IN (1, 3)")
def sv_cast_findings(spark, d):
    return legality.cast_findings(Types(written_texts(spark, d, "nation", "n_nationkey", CASTS_TEXT))).select("file_id", "code", "severity", "name")


@query(f"""WITH t AS (SELECT n_nationkey AS file_id, {NATION_TEXT} AS x FROM nation) SELECT file_id, 'file' AS kind, 0 AS ordinal, 0 AS start, strlen(x) AS end_ FROM t UNION ALL SELECT file_id, 'unit', 0, 0, strlen(x) - 1 FROM t
UNION ALL SELECT file_id, 'item', 0, strpos(x, 'parameter K') - 1, strpos(x, '; parameter R') FROM t UNION ALL SELECT file_id, 'item', 1, strpos(x, 'parameter R') - 1, strpos(x, '; export') FROM t UNION ALL SELECT file_id, 'item', 2, strpos(x, 'export') - 1, strpos(x, ' endpackage') - 1 FROM t""")
def sv_nodes(spark, d):
    texts = read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("file_id"), F.expr(NATION_TEXT).alias("text"))
    found = tree.nodes(texts).where("kind in ('file', 'unit', 'item')")
    return found.select("file_id", "kind", "ordinal", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_"))
