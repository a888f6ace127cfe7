"""The kernels and scalar functions applied to ordinary tables, each beside its oracle in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svloom.functions import consteval as ce
from svloom.functions import svfuncs as sv
from svloom.operators import relops as ro
from svloom.sources import text_index as ti

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Positions in text


@query("SELECT doc_id, strlen(text) - strlen(replace(text, chr(10), '')) + 1 AS n_lines FROM documents")
def line_count(spark, d):
    return read(spark, d, "documents").select("doc_id", ti.line_count(F.col("text")).cast("long").alias("n_lines"))


_LINES = """
l AS (SELECT doc_id, unnest(ls) AS t, unnest(range(0, len(ls))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) x),
s AS (SELECT doc_id, line, coalesce(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, strlen(t) AS len FROM l)
"""


@query(f"WITH {_LINES} SELECT doc_id, line, start FROM s")
def line_starts(spark, d):
    return ti.line_starts(read(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("line").cast("long").alias("line"), "start")


@query(f"""WITH {_LINES}, o AS (SELECT doc_id, strlen(text) // 2 AS at FROM documents)
SELECT o.doc_id, o.at, s.line, o.at - s.start AS col FROM o JOIN s ON s.doc_id = o.doc_id AND s.start <= o.at AND o.at < s.start + s.len + 1""")
def offset_to_linecol(spark, d):
    docs = read(spark, d, "documents")
    at = docs.select("doc_id", F.expr("cast(octet_length(text) div 2 as bigint)").alias("at"))
    return ti.to_line_col(at, ti.line_starts(docs, "doc_id", "text"), "doc_id", "at").select("doc_id", "at", F.col("line").cast("long").alias("line"), "col")


@query(f"""WITH {_LINES} SELECT d.doc_id, CASE WHEN 30 <= s.len THEN s.start + 30 END AS at FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id AND s.line = 1""")
def linecol_to_offset(spark, d):
    docs = read(spark, d, "documents")
    asked = docs.select("doc_id", F.lit(1).alias("line"), F.lit(30).cast("long").alias("col"))
    return ti.to_offset(asked, ti.line_starts(docs, "doc_id", "text"), "doc_id").select("doc_id", "at")


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_$]*')) AS n_idents FROM documents")
def ident_count(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(ti.identifiers(F.col("text"))).cast("long").alias("n_idents"))


@query(f"""WITH k AS (SELECT unnest(string_split('{" ".join(ti.PLAIN_WORD_KEYWORDS)}', ' ')) AS word), w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_$]*')) AS word FROM documents)
SELECT w.word, count(*) AS hits FROM w JOIN k ON k.word = w.word GROUP BY w.word""")
def keyword_hits(spark, d):
    words = read(spark, d, "documents").select(F.explode(ti.identifiers(F.col("text"))).alias("word"))
    return words.join(F.broadcast(ti.keywords(spark, ti.PLAIN_WORD_KEYWORDS)), "word", "left_semi").groupBy("word").agg(F.count("*").alias("hits"))


@query("SELECT 'documents' AS source, doc_id AS id, strlen(text) - length(text) AS extra_bytes FROM documents UNION ALL SELECT 'pages', page_id, strlen(html) - length(html) FROM pages")
def non_ascii_bytes(spark, d):
    extra = lambda t, key, c: read(spark, d, t).select(F.lit(t).alias("source"), F.col(key).alias("id"), (F.octet_length(c) - F.length(c)).cast("long").alias("extra_bytes"))
    return extra("documents", "doc_id", "text").unionByName(extra("pages", "page_id", "html"))


@query("SELECT doc_id, md5(text) AS text_fingerprint, md5(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS shape_fingerprint FROM documents")
def fingerprint_changed(spark, d):
    shape = F.regexp_replace("text", "[ \\t\\r\\n]+", " ")
    return read(spark, d, "documents").select("doc_id", F.md5("text").alias("text_fingerprint"), F.md5(shape).alias("shape_fingerprint"))


# Duplicates and precedence


@query("SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS ordinal FROM nation QUALIFY ordinal > 1")
def duplicates_after_first(spark, d):
    return ro.duplicates_after_first(read(spark, d, "nation").select("n_nationkey", "n_regionkey"), ["n_regionkey"], ["n_nationkey"]).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS ordinal FROM lineitem QUALIFY ordinal > 1")
def duplicate_definitions(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return ro.duplicates_after_first(rows, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"]).drop("l_suppkey").withColumn("ordinal", F.col("ordinal").cast("long"))


@query("SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS previous FROM orders QUALIFY previous IS NOT NULL")
def scope_dup_lag(spark, d):
    return ro.adjacent_duplicates(read(spark, d, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderkey"], "o_orderkey", "previous").select("o_orderkey", "previous")


_CANDIDATES = """
c AS (SELECT n.n_nationkey AS nation, 1 AS step, s.s_suppkey AS target, s.s_name AS name FROM nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000
UNION ALL SELECT n.n_nationkey, 2, c.c_custkey, c.c_name FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal < -900
UNION ALL SELECT n_nationkey, 3, n_nationkey, n_name FROM nation)
"""


def _candidates(spark, d):
    nation, supplier, customer = (read(spark, d, t) for t in ("nation", "supplier", "customer"))
    pick = lambda rows, step, target, name: rows.select(F.col("n_nationkey").alias("nation"), F.lit(step).alias("step"), F.col(target).cast("long").alias("target"), F.col(name).alias("name"))
    first = pick(nation.join(supplier.where("s_acctbal > 9000"), F.col("s_nationkey") == F.col("n_nationkey")), 1, "s_suppkey", "s_name")
    second = pick(nation.join(customer.where("c_acctbal < -900"), F.col("c_nationkey") == F.col("n_nationkey")), 2, "c_custkey", "c_name")
    return first.unionByName(second).unionByName(pick(nation, 3, "n_nationkey", "n_name"))


@query(f"WITH {_CANDIDATES} SELECT nation, step, target, name FROM c QUALIFY row_number() OVER (PARTITION BY nation ORDER BY step, target) = 1")
def precedence_pick(spark, d):
    return ro.precedence_pick(_candidates(spark, d), ["nation"], ["step", "target"])


@query(f"""WITH {_CANDIDATES}, g AS (SELECT nation, step, min(target) AS lo, max(target) AS hi, count(DISTINCT name) AS n_origins FROM c GROUP BY nation, step)
SELECT nation, step, CASE WHEN lo = hi THEN 'resolved' ELSE 'ambiguous' END AS outcome, CASE WHEN lo = hi THEN lo END AS target, n_origins FROM g QUALIFY row_number() OVER (PARTITION BY nation ORDER BY step) = 1""")
def ambiguous_pick(spark, d):
    picked = ro.ambiguous_pick(_candidates(spark, d), ["nation"], "step", "target", "name")
    return picked.select("nation", "step", "outcome", "target", F.size("origins").cast("long").alias("n_origins"))


@query("""WITH e AS (SELECT n_regionkey AS package, substr(n_name, 1, 1) AS name, n_nationkey AS target, 1 AS prec FROM nation
UNION ALL SELECT n.n_regionkey, substr(s.s_name, length(s.s_name), 1), s.s_suppkey, 2 FROM nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey
UNION ALL SELECT r_regionkey, substr(r_name, 1, 1), r_regionkey, 3 FROM region)
SELECT package, name, target, prec FROM e QUALIFY row_number() OVER (PARTITION BY package, name ORDER BY prec, target) = 1""")
def surface_merge(spark, d):
    nation, supplier, region = (read(spark, d, t) for t in ("nation", "supplier", "region"))
    entry = lambda rows, package, name, target, prec: rows.select(F.col(package).alias("package"), name.alias("name"), F.col(target).cast("long").alias("target"), F.lit(prec).alias("prec"))
    own = entry(nation, "n_regionkey", F.substring("n_name", 1, 1), "n_nationkey", 1)
    exported = entry(nation.join(supplier, F.col("s_nationkey") == F.col("n_nationkey")), "n_regionkey", F.substring("s_name", -1, 1), "s_suppkey", 2)
    return ro.merged_surface(own.unionByName(exported).unionByName(entry(region, "r_regionkey", F.substring("r_name", 1, 1), "r_regionkey", 3)), ["package", "name"], "prec", ["target"])


# Scopes and hierarchies


@query("""WITH b AS (SELECT c_custkey AS use, c_mktsegment AS name, c_nationkey AS nation FROM customer),
bind AS (SELECT n_nationkey AS nation, 0 AS distance, 'BUILDING' AS name, n_nationkey AS sym FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT n.n_nationkey, 1, v.name, 100 + r.r_regionkey FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey JOIN (VALUES ('BUILDING'), ('MACHINERY')) v(name) ON r.r_regionkey < 4
UNION ALL SELECT n_nationkey, 2, 'AUTOMOBILE', 200 FROM nation)
SELECT b.use, bind.distance, bind.sym::BIGINT AS sym FROM b JOIN bind ON bind.nation = b.nation AND bind.name = b.name QUALIFY row_number() OVER (PARTITION BY b.use ORDER BY bind.distance, bind.sym) = 1""")
def nearest_ancestor(spark, d):
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    scopes = nation.select(F.col("n_nationkey").cast("string").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent")).unionByName(region.select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("root").alias("parent")))
    above = ro.closure(scopes, "child", "parent").select(F.col("child").alias("scope"), "ancestor", "distance")
    ancestors = above.unionByName(nation.select(F.col("n_nationkey").cast("string").alias("scope")).withColumn("ancestor", F.col("scope")).withColumn("distance", F.lit(0)))
    bind = lambda rows, scope, name, sym: rows.select(scope.cast("string").alias("ancestor"), name.alias("name"), sym.cast("long").alias("sym"))
    inner = bind(nation.where("n_nationkey % 3 = 0"), F.col("n_nationkey"), F.lit("BUILDING"), F.col("n_nationkey"))
    middle = bind(region.where("r_regionkey < 4").withColumn("name", F.explode(F.array(F.lit("BUILDING"), F.lit("MACHINERY")))), F.concat(F.lit("r"), "r_regionkey"), F.col("name"), 100 + F.col("r_regionkey"))
    outer = bind(spark.range(1), F.lit("root"), F.lit("AUTOMOBILE"), F.lit(200))
    uses = read(spark, d, "customer").select(F.col("c_custkey").alias("use"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("string").alias("scope"))
    return ro.nearest_ancestor(uses, ancestors, inner.unionByName(middle).unionByName(outer), "scope", ["use"], "name", "sym")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth, min(turn) OVER (PARTITION BY conv_id) AS root FROM conversations")
def closure_depth(spark, d):
    turns = ro.adjacent_parents(read(spark, d, "conversations"), ["conv_id"], "turn", "parent")
    return ro.depth_and_root(turns, ["conv_id"], "turn", "parent").select("conv_id", "turn", F.col("depth").cast("long").alias("depth"), "root")


@query("""SELECT 0 AS depth, 'r' || r_regionkey AS node, NULL AS guard FROM region UNION ALL SELECT 1, 'n' || n_nationkey, NULL FROM nation
UNION ALL SELECT 2, 's' || s_suppkey, NULL FROM supplier UNION ALL SELECT 2, 'r' || n_regionkey, 'recursion' FROM nation WHERE n_nationkey % 10 = 0""")
def frontier_expand(spark, d):
    nation, supplier, region = (read(spark, d, t) for t in ("nation", "supplier", "region"))
    node = lambda p, c: F.concat(F.lit(p), c)
    edges = (
        nation.select(node("r", "n_regionkey").alias("node"), node("n", "n_nationkey").alias("child"))
        .unionByName(supplier.select(node("n", "s_nationkey").alias("node"), node("s", "s_suppkey").alias("child")))
        .unionByName(nation.where("n_nationkey % 10 = 0").select(node("n", "n_nationkey").alias("node"), node("r", "n_regionkey").alias("child")))
    )
    return ro.frontier(region.select(node("r", "r_regionkey").alias("node")), edges, "node", "child").select("depth", "node", "guard")


@query("""SELECT conv_id, turn FROM conversations c WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM conversations u WHERE u.conv_id = c.conv_id AND u.role = 'user' AND u.turn < c.turn AND length(u.text) > 200)""")
def loop_ancestor_anti(spark, d):
    turns = read(spark, d, "conversations")
    loops = turns.where("role = 'user' and length(text) > 200").groupBy("conv_id").agg(F.min("turn").alias("first"))
    return turns.where("role = 'assistant'").join(loops, "conv_id", "left").where("first is null or first >= turn").select("conv_id", "turn")


# As-of and intervals


@query("SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS active FROM events")
def asof_last(spark, d):
    return ro.asof_last(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "active", F.lit(-1.0)).select("event_id", "active")


_RESET = """
g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM events),
a AS (SELECT event_id, user_id, value, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active FROM g)
"""


def _reset(spark, d):
    return ro.asof_with_reset(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "view", F.col("value")), F.col("event_type") == "error", "active")


@query(f"WITH {_RESET} SELECT event_id, active FROM a")
def asof_with_reset(spark, d):
    return _reset(spark, d).select("event_id", "active")


@query(f"WITH {_RESET} SELECT a.event_id, coalesce(CASE WHEN o.o_orderstatus = 'F' THEN o.o_totalprice END, a.active, 0) AS effective FROM a LEFT JOIN orders o ON o.o_orderkey = a.event_id")
def asof_coalesce(spark, d):
    explicit = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("explicit"))
    return _reset(spark, d).join(explicit, "event_id", "left").select("event_id", F.coalesce("explicit", "active", F.lit(0.0)).alias("effective"))


@query("""WITH s AS (SELECT user_id, event_id AS span, epoch(ts)::BIGINT AS a, epoch(ts)::BIGINT + 100000 AS b FROM events WHERE event_type = 'signup')
SELECT e.event_id, s.span FROM events e JOIN s ON s.user_id = e.user_id AND e.event_type = 'error' AND s.a <= epoch(e.ts)::BIGINT AND epoch(e.ts)::BIGINT < s.b""")
def interval_containment(spark, d):
    # The nearest second, halves to the even one, as the SQL's cast has it.
    events = read(spark, d, "events").withColumn("at", F.expr("cast(rint(unix_micros(cast(ts as timestamp)) / 1e6D) as bigint)"))
    spans = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("span"), F.col("at").alias("a"), (F.col("at") + 100000).alias("b"))
    return ro.interval_join(events.where("event_type = 'error'").select("user_id", "event_id", "at"), spans, ["user_id"], "at", "a", "b", 100000).select("event_id", "span")


@query("""WITH s AS (SELECT user_id, event_id AS span, event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events WHERE event_type = 'signup')
SELECT s.span, min(e.event_id) AS realized FROM s JOIN events e ON e.user_id = s.user_id AND e.event_type = 'click' AND s.a < e.event_id AND e.event_id < s.b GROUP BY s.span""")
def realized_between(spark, d):
    from pyspark.sql import Window

    events = read(spark, d, "events")
    spans = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("a"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("b")).where("b is not null")
    found = ro.realized_between(events.where("event_type = 'click'"), spans, ["user_id"], "event_id", "a", "b", "realized")
    return found.select(F.col("a").alias("span"), "realized")


@query("SELECT e.event_id, (SELECT max(o.event_id) FROM events o WHERE o.user_id = e.user_id AND o.event_type = 'signup' AND o.event_id <= e.event_id) AS directive FROM events e WHERE e.event_type = 'purchase'")
def asof_join(spark, d):
    events = read(spark, d, "events").select("user_id", "event_id", "event_type")
    right = events.where("event_type = 'signup'").select("user_id", "event_id", F.col("event_id").alias("directive"))
    return ro.asof_join(events.where("event_type = 'purchase'").select("user_id", "event_id"), right, ["user_id"], "event_id", ["directive"]).select("event_id", "directive")


# Connection of ports and parameters


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_missing(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey AS port, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem),
f AS (SELECT s_suppkey * 2 AS port FROM supplier)
SELECT coalesce(a.port, f.port) AS port, l_orderkey, l_linenumber, CASE WHEN n IS NULL THEN 'missing' WHEN f.port IS NULL THEN 'unknown' WHEN n > 1 THEN 'duplicate' ELSE 'matched' END AS status FROM a FULL JOIN f ON a.port = f.port""")
def full_outer_ports(spark, d):
    actual = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("port"))
    formal = read(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("port"))
    return ro.named_match(actual, formal, ["port"], ["l_orderkey", "l_linenumber"])


@query("""WITH a AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS pos, l_partkey FROM lineitem), f AS (SELECT o_orderkey AS k, p.pos FROM orders JOIN (VALUES (1::BIGINT), (2), (3), (4)) p(pos) ON true)
SELECT coalesce(a.k, f.k) AS k, coalesce(a.pos, f.pos) AS pos, l_partkey, CASE WHEN a.k IS NULL THEN 'missing' WHEN f.k IS NULL THEN 'overflow' ELSE 'matched' END AS status FROM a FULL JOIN f ON a.k = f.k AND a.pos = f.pos""")
def positional_join(spark, d):
    actual = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("pos"), "l_partkey")
    formal = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("pos"))
    return ro.positional_join(actual, formal, ["k"], "pos")


@query("SELECT l_orderkey, bit_or(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END) AS ns_mask FROM lineitem GROUP BY l_orderkey")
def ns_bit_or(spark, d):
    mask = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(4)
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bit_or(mask).alias("ns_mask"))


@query("SELECT p.p_partkey, s.s_suppkey FROM part p JOIN supplier s ON s.s_suppkey = p.p_partkey UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def implicit_bindings(spark, d):
    return read(spark, d, "part").select("p_partkey").join(read(spark, d, "supplier").select("s_suppkey"), F.col("p_partkey") == F.col("s_suppkey"), "left")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'input' WHEN l_returnflag = 'N' THEN 'output' ELSE 'ref' END AS dir, CASE WHEN l_linestatus = 'O' THEN 'write' ELSE 'read' END AS access FROM lineitem)
SELECT l_orderkey, l_linenumber, dir, access FROM a WHERE (dir = 'input' AND access = 'write') OR (dir = 'output' AND access = 'read')""")
def modport_direction(spark, d):
    dirs = F.when(F.col("l_returnflag") == "A", "input").when(F.col("l_returnflag") == "N", "output").otherwise("ref")
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", dirs.alias("dir"), F.when(F.col("l_linestatus") == "O", "write").otherwise("read").alias("access"))
    forbidden = spark.createDataFrame([("input", "write"), ("output", "read")], "dir string, access string")
    return rows.join(F.broadcast(forbidden), ["dir", "access"], "left_semi")


# Values, widths and enums


@query("SELECT l_orderkey, CASE WHEN bool_and(l_quantity < 50) THEN array_to_string(list_sort(list(DISTINCT l_quantity::BIGINT)), ',') END AS known FROM lineitem GROUP BY l_orderkey")
def distinct_value_set(spark, d):
    values = F.array_sort(F.collect_set(F.col("l_quantity").cast("long")))
    known = F.when(F.bool_and(F.col("l_quantity") < 50), F.array_join(F.transform(values, lambda x: x.cast("string")), ","))
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(known.alias("known"))


@query("""WITH g AS (SELECT l_orderkey, sum(l_linenumber * 3)::BIGINT AS s, max(l_linenumber * 3)::BIGINT AS m, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, s AS struct_width, m AS union_width, m + (CASE WHEN n <= 1 THEN 0 ELSE length(bin(n - 1)) END) AS tagged_width FROM g""")
def width_sum_max(spark, d):
    w = F.col("l_linenumber") * 3
    g = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(w).cast("long").alias("struct_width"), F.max(w).cast("long").alias("union_width"), F.count("*").alias("n"))
    return g.select("l_orderkey", "struct_width", "union_width", (F.col("union_width") + ce.clog2(F.col("n"))["value"]).alias("tagged_width"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey <= 1 THEN 0 ELSE length(bin(l_partkey - 1)) END AS bits FROM lineitem")
def clog2(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ce.clog2(F.col("l_partkey"))["value"].alias("bits"))


_A, _B = "(l_partkey % 2000 * 4611686018427387 - l_suppkey)", "(l_linenumber - 3)"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, {_A.replace('l_partkey', 'l_partkey::HUGEINT')} AS a, {_B}::HUGEINT AS b FROM lineitem),
y AS (SELECT *, a * b AS p, a + b AS s FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN p BETWEEN -9223372036854775808::HUGEINT AND 9223372036854775807::HUGEINT THEN p::BIGINT END AS product,
CASE WHEN p BETWEEN -9223372036854775808::HUGEINT AND 9223372036854775807::HUGEINT THEN NULL ELSE 'Overflow' END AS product_err, s::BIGINT AS total,
CASE WHEN b = 0 THEN NULL ELSE (a // b)::BIGINT END AS quotient, CASE WHEN b = 0 THEN 'DivideByZero' END AS quotient_err, CASE WHEN b = 0 THEN NULL ELSE (a % b)::BIGINT END AS rest FROM y""")
def checked_arith(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_A).alias("a"), F.expr(f"cast({_B} as bigint)").alias("b"))
    a, b = F.col("a"), F.col("b")
    p, s, q, r = ce.multiply(a, b), ce.add(a, b), ce.divide(a, b), ce.remainder(a, b)
    return rows.select("l_orderkey", "l_linenumber", p["value"].alias("product"), p["err"].alias("product_err"), s["value"].alias("total"), q["value"].alias("quotient"), q["err"].alias("quotient_err"), r["value"].alias("rest"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 70 BETWEEN 0 AND 63 THEN (CASE WHEN l_suppkey % 70 < 40 THEN l_linenumber::BIGINT << (l_suppkey % 70)::INTEGER ELSE 0 END) END AS left_value,
CASE WHEN l_suppkey % 70 > 63 THEN 'Overflow' END AS left_err, CASE WHEN l_suppkey % 70 > 63 THEN NULL ELSE l_partkey >> (l_suppkey % 70)::INTEGER END AS right_value FROM lineitem""")
def shift_ops(spark, d):
    rows = read(spark, d, "lineitem")
    s = F.col("l_suppkey") % 70
    left, right = ce.shift_left(F.when((s < 40) | (s > 63), F.col("l_linenumber")).otherwise(0), s), ce.shift_right(F.col("l_partkey"), s)
    return rows.select("l_orderkey", "l_linenumber", left["value"].alias("left_value"), left["err"].alias("left_err"), right["value"].alias("right_value"))


@query("SELECT o_orderkey, o_orderkey & o_custkey AS a, o_orderkey | o_custkey AS o, xor(o_orderkey, o_custkey) AS x, ~o_orderkey AS n FROM orders")
def bit_ops(spark, d):
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, d, "orders").select("o_orderkey", a.bitwiseAND(b).alias("a"), a.bitwiseOR(b).alias("o"), a.bitwiseXOR(b).alias("x"), F.bitwise_not(a).alias("n"))


@query("SELECT p_partkey, bit_count(p_partkey)::BIGINT AS ones, bit_count(p_partkey) = 1 AS onehot, bit_count(p_size)::BIGINT <= 1 AS onehot0, 8 - bit_count(p_partkey & 255)::BIGINT AS zeros8, CASE WHEN (p_partkey & 255) >= 128 THEN (p_partkey & 255) - 256 ELSE p_partkey & 255 END AS signed8 FROM part")
def countones_onehot(spark, d):
    v = F.col("p_partkey")
    return read(spark, d, "part").select("p_partkey", sv.countones(v).cast("long").alias("ones"), sv.onehot(v).alias("onehot"), sv.onehot0(F.col("p_size")).alias("onehot0"), sv.countbits(v, 8, False, True).cast("long").alias("zeros8"), sv.as_signed(v, 8).alias("signed8"))


_REAL = {"$ln": "ln(x)", "$log10": "log10(x)", "$sqrt": "sqrt(x)", "$floor": "floor(x)", "$ceil": "ceil(x)", "$sin": "sin(y)", "$cos": "cos(y)", "$atan": "atan(x)", "$tanh": "tanh(y)", "$sinh": "sinh(y)", "$cosh": "cosh(y)", "$asinh": "asinh(y)", "$exp": "exp(y)", "$asin": "asin(z)", "$acos": "acos(z)", "$tan": "tan(z)", "$atanh": "atanh(z)", "$acosh": "acosh(x)"}


@query("WITH v AS (SELECT p_partkey, p_retailprice AS x, p_size / 10.0 AS y, p_size / 100.0 AS z FROM part) SELECT p_partkey, " + ", ".join(f"round({e}, 6) AS f_{n[1:]}" for n, e in _REAL.items()) + ", round(pow(z, 2.0), 6) AS f_pow, round(atan2(y, z), 6) AS f_atan2, round(sqrt(y * y + z * z), 6) AS f_hypot FROM v")
def real_math(spark, d):
    v = read(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("x"), (F.col("p_size") / 10.0).alias("y"), (F.col("p_size") / 100.0).alias("z"))
    one = [F.round(sv.REAL_FUNCTIONS[n](F.col(e[e.index("(") + 1])), 6).alias(f"f_{n[1:]}") for n, e in _REAL.items()]
    x, y = F.col("y"), F.col("z")
    two = [F.round(sv.REAL_FUNCTIONS["$pow"](y, F.lit(2.0)), 6).alias("f_pow"), F.round(sv.REAL_FUNCTIONS["$atan2"](x, y), 6).alias("f_atan2"), F.round(sv.REAL_FUNCTIONS["$hypot"](x, y), 6).alias("f_hypot")]
    return v.select("p_partkey", *one, *two)


@query("SELECT n_nationkey, i AS ordinal, n_name || i AS name FROM (SELECT n_nationkey, n_name, unnest(range(0, (n_nationkey % 4)::BIGINT)) AS i FROM nation) x")
def enum_expand_count(spark, d):
    return ti.expand_count(read(spark, d, "nation"), "n_name", F.expr("n_nationkey % 4")).select("n_nationkey", "ordinal", "name")


@query("""WITH m AS (SELECT n_nationkey, n_name, (n_regionkey % 3)::BIGINT AS a, (n_nationkey % 5)::BIGINT AS b FROM nation),
x AS (SELECT n_nationkey, n_name, a, b, unnest(range(0, abs(a - b) + 1)) AS k FROM m)
SELECT n_nationkey, k AS ordinal, n_name || (CASE WHEN a <= b THEN a + k ELSE a - k END) AS name FROM x""")
def enum_expand_range(spark, d):
    return ti.expand_range(read(spark, d, "nation"), "n_name", F.expr("n_regionkey % 3"), F.expr("n_nationkey % 5")).select("n_nationkey", "ordinal", "name")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS init FROM lineitem), g AS (SELECT *, count(init) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM r)
SELECT l_orderkey, l_linenumber, coalesce(first_value(init) OVER w, 0) + row_number() OVER w - 1 AS value FROM g WINDOW w AS (PARTITION BY l_orderkey, grp ORDER BY l_linenumber, l_partkey)""")
def enum_autoincrement(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey")).alias("init"), F.lit(1).alias("step"))
    return ro.prefix_fold(rows, ["l_orderkey"], ["l_linenumber", "l_partkey"], "step", "init", "value").select("l_orderkey", "l_linenumber", "value")


@query("""WITH m AS (SELECT n_nationkey, n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation)
SELECT m.n_nationkey, a.n_name AS next2, b.n_name AS prev1, m.c AS num FROM m JOIN m a ON a.n_regionkey = m.n_regionkey AND a.i = (m.i + 2) % m.c JOIN m b ON b.n_regionkey = m.n_regionkey AND b.i = (m.i - 1 + m.c) % m.c""")
def enum_next_prev(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("n_regionkey")
    m = read(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name", (F.row_number().over(w.orderBy("n_nationkey")) - 1).alias("i"), F.count("*").over(w).alias("num"))
    other = lambda name: m.select("n_regionkey", F.col("i").cast("long").alias("j"), F.col("n_name").alias(name))
    i, n = F.col("i"), F.col("num")
    step = m.withColumn("j", sv.enum_next(i, F.lit(2), n).cast("long")).join(other("next2"), ["n_regionkey", "j"]).drop("j")
    return step.withColumn("j", sv.enum_prev(i, F.lit(1), n).cast("long")).join(other("prev1"), ["n_regionkey", "j"]).select("n_nationkey", "next2", "prev1", "num")


@query("""SELECT p_partkey, m::BIGINT AS d_left, l::BIGINT AS d_right, least(m, l)::BIGINT AS d_low, greatest(m, l)::BIGINT AS d_high, (abs(m - l) + 1)::BIGINT AS d_size, (CASE WHEN m >= l THEN 1 ELSE -1 END)::BIGINT AS d_increment
FROM (SELECT p_partkey, p_size AS m, (p_partkey % 50)::INTEGER AS l FROM part) x""")
def dim_queries(spark, d):
    msb, lsb = F.col("p_size"), (F.col("p_partkey") % 50).cast("int")
    names = ("left", "right", "low", "high", "size", "increment")
    return read(spark, d, "part").select("p_partkey", *[ce.dim_query(n, msb, lsb).alias(f"d_{n}") for n in names])


@query("""SELECT p_partkey, (CASE WHEN a >= b THEN a - b ELSE b - a END) + 1 AS fixed_width, (p_size % 8)::BIGINT AS indexed_width FROM (SELECT p_partkey, p_size, p_size::BIGINT AS a, p_partkey % 64 AS b FROM part) x""")
def slice_width(spark, d):
    from svloom.operators import typing_ops as ty

    return read(spark, d, "part").select("p_partkey", ty.fixed_slice_width(F.col("p_size").cast("long"), F.col("p_partkey") % 64).alias("fixed_width"), ty.indexed_slice_width((F.col("p_size") % 8).cast("long")).alias("indexed_width"))


@query("""WITH v AS (SELECT a.p_partkey AS k, a.p_size::BIGINT AS w1, (a.p_partkey % 33)::BIGINT AS w2, a.p_partkey % 2 = 0 AS s1, a.p_size % 2 = 0 AS s2, a.p_partkey % 3 = 0 AS x1, a.p_size % 3 = 0 AS x2 FROM part a), o AS (SELECT * FROM (VALUES ('+'), ('<<'), ('=='), ('===')) t(op))
SELECT k, op, CASE WHEN op IN ('==', '===') THEN 1 WHEN op = '<<' THEN w1 ELSE greatest(w1, w2) END AS width, CASE WHEN op IN ('==', '===') THEN false WHEN op = '<<' THEN s1 ELSE s1 AND s2 END AS signed,
CASE WHEN op = '===' THEN false ELSE x1 OR x2 END AS four_state FROM v JOIN o ON true""")
def op_typing(spark, d):
    from svloom.operators import typing_ops as ty

    p = read(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("w1"), (F.col("p_partkey") % 33).cast("long").alias("w2"), (F.col("p_partkey") % 2 == 0).alias("s1"), (F.col("p_size") % 2 == 0).alias("s2"), (F.col("p_partkey") % 3 == 0).alias("x1"), (F.col("p_size") % 3 == 0).alias("x2"), F.explode(F.array(*map(F.lit, ("+", "<<", "==", "===")))).alias("op"))
    typed = rows.join(F.broadcast(ty.op_spec(spark)), "op")
    left, right = ty.bits(F.col("w1"), F.col("s1"), F.col("x1")), ty.bits(F.col("w2"), F.col("s2"), F.col("x2"))
    r = ty.result_type(F.col("category"), F.col("result_state"), left, right)
    return typed.select("k", "op", r["width"].alias("width"), r["signed"].alias("signed"), r["four_state"].alias("four_state"))


@query("SELECT l_orderkey, l_linenumber, length(bin(l_partkey))::BIGINT AS rhs_width, (l_linenumber * 2)::BIGINT AS lhs_width FROM lineitem WHERE length(bin(l_partkey)) > l_linenumber * 2")
def assign_truncation(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.length(F.bin("l_partkey")).cast("long").alias("rhs_width"), (F.col("l_linenumber") * 2).cast("long").alias("lhs_width"))
    return rows.where("rhs_width > lhs_width")


@query("""WITH t AS (SELECT event_id, (CASE event_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '10' ELSE '100' END) || (CASE event_id % 6 WHEN 0 THEN 's' WHEN 1 THEN 'ms' WHEN 2 THEN 'us' WHEN 3 THEN 'ns' WHEN 4 THEN 'ps' ELSE 'fs' END) AS lit, event_id % 3 AS m, event_id % 6 AS u FROM events)
SELECT event_id, lit, m + (5 - u) * 3 AS rank FROM t""")
def timescale_rank(spark, d):
    from svloom.operators import typing_ops as ty

    lit = F.concat(F.element_at(F.array(*map(F.lit, ("1", "10", "100"))), (F.col("event_id") % 3 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("s", "ms", "us", "ns", "ps", "fs"))), (F.col("event_id") % 6 + 1).cast("int")))
    return read(spark, d, "events").select("event_id", lit.alias("lit"), ty.time_rank(lit).alias("rank"))


# Strings and arrays


@query("""SELECT c_custkey, strlen(c_name) AS len, ascii(substr(c_name, 3, 1)) AS getc, CASE WHEN c_name < c_mktsegment THEN -1 WHEN c_name > c_mktsegment THEN 1 ELSE 0 END AS cmp,
CASE WHEN lower(c_name) < lower(c_mktsegment) THEN -1 WHEN lower(c_name) > lower(c_mktsegment) THEN 1 ELSE 0 END AS icmp, substr(c_name, 3, 4) AS sub, '' AS sub_bad, upper(c_name) AS up, lower(c_name) AS lo FROM customer""")
def str_methods(spark, d):
    s, t = F.col("c_name"), F.col("c_mktsegment")
    i = F.lit
    return read(spark, d, "customer").select("c_custkey", sv.str_len(s).cast("long").alias("len"), sv.str_getc(s, i(2)).alias("getc"), sv.str_compare(s, t).alias("cmp"), sv.str_icompare(s, t).alias("icmp"), sv.str_substr(s, i(2), i(5)).alias("sub"), sv.str_substr(s, i(3), i(1)).alias("sub_bad"), F.upper(s).alias("up"), F.lower(s).alias("lo"))


@query("""SELECT p_partkey, p_partkey::VARCHAR AS itoa, lower(to_base(p_partkey, 16)) AS hextoa, to_base(p_partkey, 8) AS octtoa, to_base(p_partkey, 2) AS bintoa, p_partkey AS atoi, 0::BIGINT AS atoi_none, p_retailprice AS atoreal FROM part""")
def str_conversions(spark, d):
    n = F.col("p_partkey")
    digits = F.concat(n.cast("string"), F.lit("_x"))
    return read(spark, d, "part").select("p_partkey", sv.toa(n, 10).alias("itoa"), sv.toa(n, 16).alias("hextoa"), sv.toa(n, 8).alias("octtoa"), sv.toa(n, 2).alias("bintoa"), sv.str_ato(digits, 10).alias("atoi"), sv.str_ato(F.lit("zz"), 10).cast("long").alias("atoi_none"), sv.str_atoreal(F.col("p_retailprice").cast("string")).alias("atoreal"))


_ARR = "a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS v FROM lineitem GROUP BY l_orderkey)"


def _arrays(spark, d):
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(items.alias("s")).select("l_orderkey", F.transform("s", lambda x: x["l_partkey"]).alias("v"))


def _text(a):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


@query(f"""WITH {_ARR} SELECT l_orderkey, array_to_string(list_filter(v, lambda x: x % 2 = 0), ',') AS found, array_to_string(list_filter(v, lambda x: x % 2 = 0)[1:1], ',') AS first_found, coalesce(list_filter(v, lambda x: x % 2 = 0)[-1]::VARCHAR, '') AS last_found,
coalesce((list_position(v, list_filter(v, lambda x: x % 2 = 0)[1]) - 1)::VARCHAR, '') AS first_index, list_min(v)::VARCHAR AS low, list_max(v)::VARCHAR AS high, len(list_distinct(v)) AS n_unique FROM a""")
def arr_find(spark, d):
    v, even = F.col("v"), lambda x: x % 2 == 0
    return _arrays(spark, d).select("l_orderkey", _text(sv.find(v, even)).alias("found"), _text(sv.find_first(v, even)).alias("first_found"), _text(sv.find_last(v, even)).alias("last_found"), _text(sv.find_first_index(v, even)).alias("first_index"), _text(sv.arr_min(v)).alias("low"), _text(sv.arr_max(v)).alias("high"), F.size(sv.unique_index(v)).cast("long").alias("n_unique"))


@query(f"""WITH {_ARR}, i AS (SELECT l_orderkey, sum(l_partkey)::BIGINT AS s, bit_and(l_partkey) AS ba, bit_or(l_partkey) AS bo, bit_xor(l_partkey) AS bx FROM lineitem GROUP BY l_orderkey)
SELECT a.l_orderkey, array_to_string(list_sort(v), ',') AS sorted, array_to_string(list_reverse_sort(v), ',') AS rsorted, array_to_string(list_reverse(v), ',') AS reversed, array_to_string(list_transform(v, lambda x: x * 2 + 1), ',') AS mapped, s AS total, ba, bo, bx FROM a JOIN i ON i.l_orderkey = a.l_orderkey""")
def arr_order_reduce(spark, d):
    v, zero = F.col("v"), F.lit(0).cast("long")
    return _arrays(spark, d).select("l_orderkey", _text(sv.arr_sort(v)).alias("sorted"), _text(sv.arr_rsort(v)).alias("rsorted"), _text(F.reverse(v)).alias("reversed"), _text(F.transform(v, lambda x: x * 2 + 1)).alias("mapped"), sv.reduce(v, "sum", zero).alias("total"), sv.reduce(v, "and", F.lit(-1).cast("long")).alias("ba"), sv.reduce(v, "or", zero).alias("bo"), sv.reduce(v, "xor", zero).alias("bx"))


@query(f"""WITH {_ARR} SELECT l_orderkey, array_to_string(list_prepend(7, v), ',') AS pushed_front, array_to_string(list_append(v, 7), ',') AS pushed_back, array_to_string(v[2:], ',') AS popped_front, array_to_string(v[1:len(v)-1], ',') AS popped_back,
array_to_string(list_concat(list_concat(v[1:1], [9]), v[2:]), ',') AS inserted FROM a""")
def queue_ops(spark, d):
    v = F.col("v")
    seven, nine = F.lit(7).cast("long"), F.lit(9).cast("long")
    return _arrays(spark, d).select("l_orderkey", _text(sv.push_front(v, seven)).alias("pushed_front"), _text(sv.push_back(v, seven)).alias("pushed_back"), _text(sv.pop_front(v)).alias("popped_front"), _text(sv.pop_back(v)).alias("popped_back"), _text(sv.insert(v, F.lit(1), nine)).alias("inserted"))


@query("""SELECT o_custkey, count(*) AS num, min(o_orderkey) AS first, max(o_orderkey) AS last, min(CASE WHEN o_orderkey > 5000 THEN o_orderkey END) AS next, max(CASE WHEN o_orderkey < 5000 THEN o_orderkey END) AS prev, bool_or(o_orderkey = 5000) AS has FROM orders GROUP BY o_custkey""")
def assoc_ops(spark, d):
    m = read(spark, d, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("m"))
    c, k = F.col("m"), F.lit(5000).cast("long")
    return m.select("o_custkey", F.size(c).cast("long").alias("num"), sv.assoc_first(c).alias("first"), sv.assoc_last(c).alias("last"), sv.assoc_next(c, k).alias("next"), sv.assoc_prev(c, k).alias("prev"), sv.assoc_exists(c, k).alias("has"))
