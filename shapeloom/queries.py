"""Queries over the sample tables, mapped to a graph, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.functions.terms import lex
from shapeloom.operators import report
from shapeloom.operators.infer import Along, Const, Filtered, Rule, This, infer
from shapeloom.operators.paths import reach
from shapeloom.operators.shapes import Compiler, select
from shapeloom.plans.paths import Alt, Id, Inv, Opt, Plus, Pred, Seq, Star
from shapeloom.plans.shapes import And, Closed, Component, Count, Definition, Not, Or, Pair, Ref, Schema, Target, Test, UniqueLang, Xone, every, sh
from shapeloom.sources.storage import materialize
from shapeloom.sources.terms import SUBCLASS, TYPE, XSD
from shapeloom.sources.triples import MappedTables, Mapping, TripleTable, node, value

EX = "http://example.org/"


def p(name: str) -> str:
    return f"<{EX}{name}>"


def P(name: str) -> Pred:
    return Pred(p(name))


def num(x, kind: str = "decimal") -> str:
    return f'"{x}"^^<{XSD}{kind}>'


def text(x: str) -> str:
    return f'"{x}"'


def tables(spark: SparkSession, sf_dir: str) -> MappedTables:
    """The sample tables as a graph: one IRI per row (per key), one predicate per column."""
    order, line = node(EX + "order/", "o_orderkey"), node(EX + "line/", "l_orderkey", "l_linenumber")
    cust, supp, part = node(EX + "customer/", "c_custkey"), node(EX + "supplier/", "s_suppkey"), node(EX + "part/", "p_partkey")
    nation, turn = node(EX + "nation/", "n_nationkey"), node(EX + "turn/", "conv_id", "turn")
    doc, event, page = node(EX + "doc/", "doc_id"), node(EX + "event/", "event_id"), node(EX + "page/", "page_id")
    one = lambda t, s, o: [Mapping(t, s, o, unique=True)]
    next_turn = F.concat(F.lit(f"<{EX}turn/"), F.concat_ws("/", F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string")), F.lit(">"))
    category = F.concat(F.lit(f"<{EX}type/"), F.regexp_replace("p_type", " ", "_"), F.lit(">"))
    return MappedTables(
        spark,
        sf_dir,
        {
            p("custkey"): one("orders", order, node(EX + "customer/", "o_custkey")),
            p("status"): one("orders", order, value("o_orderstatus")),
            p("priority"): one("orders", order, value("o_orderpriority")),
            p("orderdate"): one("orders", order, value("o_orderdate", "dateTime")),
            p("totalprice"): one("orders", order, value("o_totalprice", "double")),
            p("order"): [Mapping("lineitem", line, node(EX + "order/", "l_orderkey"))],
            p("shipped"): [Mapping("lineitem", node(EX + "order/", "l_orderkey"), value("l_shipdate", "dateTime"))],
            p("returnflag"): [Mapping("lineitem", line, value("l_returnflag"))],
            p("quantity"): [Mapping("lineitem", line, value("l_quantity", "double"))],
            p("supplier"): [Mapping("lineitem", line, node(EX + "supplier/", "l_suppkey"))],
            p("acctbal"): one("customer", cust, value("c_acctbal", "double")),
            p("segment"): one("customer", cust, value("c_mktsegment")),
            p("cname"): one("customer", cust, value("c_name")),
            p("cnation"): one("customer", cust, node(EX + "nation/", "c_nationkey")),
            p("snation"): one("supplier", supp, node(EX + "nation/", "s_nationkey")),
            p("region"): one("nation", nation, node(EX + "region/", "n_regionkey")),
            p("nname"): one("nation", nation, value("n_name")),
            p("rname"): one("region", node(EX + "region/", "r_regionkey"), value("r_name")),
            p("pname"): one("part", part, value("p_name")),
            p("brand"): one("part", part, value("p_brand")),
            p("ptype"): one("part", part, value("p_type")),
            p("size"): one("part", part, value("p_size", "integer")),
            TYPE: [Mapping("part", part, category, True)],
            SUBCLASS: [Mapping("part", category, F.concat(F.lit(f"<{EX}class/"), F.substring_index("p_type", " ", 1), F.lit(">")))],
            p("text"): one("documents", doc, value("text", lang="lang")),
            p("source"): one("documents", doc, value("source")),
            p("content"): [Mapping("documents", node(EX + "source/", "source"), F.concat(F.lit('"'), F.substring("source", 1, 3), F.lit('"@'), F.col("lang")))],
            p("url"): one("pages", page, value("url")),
            p("next"): one("conversations", turn, next_turn),
            p("role"): one("conversations", turn, value("role")),
            p("amount"): one("part", part, F.when(F.col("p_size") <= 25, value("p_size", "integer")).otherwise(value("p_size", "decimal"))),
            p("small"): one("part", part, F.concat(F.lit('"'), (F.col("p_size") * 5).cast("string"), F.lit(f'"^^<{XSD}byte>'))),
            p("party"): one("orders", order, F.when(F.col("o_orderstatus") == "F", node(EX + "customer/", "o_custkey")).otherwise(value("o_orderpriority"))),
            p("mark"): one("orders", order, F.when(F.col("o_orderkey") % 3 == 0, value("o_orderstatus")).otherwise(F.lit('"Z"'))),
            p("of"): [Mapping("documents", F.concat(F.lit(f"<{EX}pair/"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit(">")), F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit('"@'), F.col("lang")))],
            p("utype"): one("events", event, value("event_type")),
            p("user"): one("events", event, node(EX + "customer/", "user_id")),
        },
    )


def key(c):
    """The last part of an IRI."""
    return F.substring_index(F.regexp_replace(c, ">$", ""), "/", -1)


def _int(c: str, name: str):
    return key(c).cast("bigint").alias(name)


CATALOGUE: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None):
    def add(f):
        CATALOGUE[f.__name__.rstrip("_")] = (f, sql)
        return f

    return add


def _nodes(g, kind: str, term: str) -> DataFrame:
    return select(g, Target(kind, term))


def failing(g, domain: DataFrame, shape) -> DataFrame:
    return Compiler(g).fails(shape, domain)


# ---------------------------------------------------------------- targets


@query("SELECT p_partkey AS part FROM part WHERE p_type LIKE 'ECONOMY%'")
def target_class(spark, sf):
    return _nodes(tables(spark, sf), "class", f"<{EX}class/ECONOMY>").select(_int("v", "part"))


@query("SELECT 'http://example.org/nothing' AS focus")
def target_node(spark, sf):
    return _nodes(tables(spark, sf), "node", p("nothing")).select(lex(F.col("v")).alias("focus"))


@query("SELECT DISTINCT o_orderkey AS focus FROM orders")
def target_subjects_of(spark, sf):
    return _nodes(tables(spark, sf), "subjectsOf", p("custkey")).select(_int("v", "focus"))


@query("SELECT DISTINCT o_custkey AS focus FROM orders")
def target_objects_of(spark, sf):
    return _nodes(tables(spark, sf), "objectsOf", p("custkey")).select(_int("v", "focus"))


# ---------------------------------------------------------------- counts


@query("SELECT o_orderkey AS focus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def min_count_inverse(spark, sf):
    g = tables(spark, sf)
    return failing(g, _nodes(g, "subjectsOf", p("custkey")), Count(Inv(P("order")), 1)).select(_int("v", "focus"))


@query("SELECT l_orderkey AS focus FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) > 5")
def max_count(spark, sf):
    g = tables(spark, sf)
    return failing(g, _nodes(g, "subjectsOf", p("custkey")), Count(Inv(P("order")), 0, 5)).select(_int("v", "focus"))


@query("SELECT l_orderkey AS focus FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1 HAVING count(*) >= 2")
def qualified_min(spark, sf):
    g = tables(spark, sf)
    returned = Count(P("returnflag"), 1, None, Test("in", (text("R"),)))
    return Compiler(g).sat(Count(Inv(P("order")), 2, None, returned), _nodes(g, "subjectsOf", p("custkey"))).select(_int("v", "focus"))


@query("SELECT l_orderkey AS focus FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1 HAVING count(*) > 3")
def qualified_max(spark, sf):
    g = tables(spark, sf)
    returned = Count(P("returnflag"), 1, None, Test("in", (text("R"),)))
    return failing(g, _nodes(g, "subjectsOf", p("custkey")), Count(Inv(P("order")), 0, 3, returned)).select(_int("v", "focus"))


@query(
    """SELECT o_orderkey AS focus FROM orders LEFT JOIN (
      SELECT l_orderkey FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2
        HAVING bool_or(l_returnflag = 'R') AND NOT bool_or(l_returnflag = 'A'))
      GROUP BY 1 HAVING count(*) >= 1) x ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL"""
)
def qualified_disjoint(spark, sf):
    g = tables(spark, sf)
    flag = lambda f: Count(P("returnflag"), 1, None, Test("in", (text(f),)))
    shape = Count(Inv(P("order")), 1, None, And((flag("R"), Not(flag("A")))))
    return failing(g, _nodes(g, "subjectsOf", p("custkey")), shape).select(_int("v", "focus"))


# ---------------------------------------------------------------- values


def _every(name: str, kind: str, pred: str, facet: Test, sql: str):
    def f(spark, sf):
        g = tables(spark, sf)
        return failing(g, _nodes(g, "subjectsOf", p(pred)), every(P(pred), facet)).select(_int("v", "focus"))

    CATALOGUE[name] = (f, sql)


_every("in_list", "in", "priority", Test("in", (text("1-URGENT"), text("2-HIGH"))), "SELECT o_orderkey AS focus FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
_every("has_value", "in", "segment", Test("in", (text("BUILDING"),)), "SELECT c_custkey AS focus FROM customer WHERE c_mktsegment <> 'BUILDING'")
_every("datatype", "d", "amount", Test("datatype", XSD + "integer"), "SELECT p_partkey AS focus FROM part WHERE p_size > 25")
_every("datatype_valid", "d", "small", Test("datatype", XSD + "byte"), "SELECT p_partkey AS focus FROM part WHERE p_size * 5 > 127")
_every("node_kind", "k", "party", Test("nodeKind", ("IRI",)), "SELECT o_orderkey AS focus FROM orders WHERE o_orderstatus <> 'F'")
_every("range_inclusive", "r", "acctbal", Test("minInclusive", num(0)), "SELECT c_custkey AS focus FROM customer WHERE c_acctbal < 0")
_every("range_exclusive", "r", "size", Test("maxExclusive", num(25, "integer")), "SELECT p_partkey AS focus FROM part WHERE p_size >= 25")
_every("range_dates", "r", "orderdate", Test("minInclusive", num("1998-01-01T00:00:00", "dateTime")), "SELECT o_orderkey AS focus FROM orders WHERE date_trunc('second', o_orderdate) < TIMESTAMP '1998-01-01'")
_every("min_length", "l", "pname", Test("minLength", 12), "SELECT p_partkey AS focus FROM part WHERE length(p_name) < 12")
_every("max_length", "l", "text", Test("maxLength", 3000), "SELECT doc_id AS focus FROM documents WHERE length(text) > 3000")
_every("pattern", "p", "url", Test("pattern", (r"[02468]$", None)), "SELECT page_id AS focus FROM pages WHERE NOT regexp_matches(url, '[02468]$')")
_every("pattern_flags", "p", "pname", Test("pattern", ("^RED ", "i")), "SELECT p_partkey AS focus FROM part WHERE NOT regexp_matches(p_name, '^RED ', 'i')")
_every("language_in", "g", "text", Test("languageIn", ("en", "de")), "SELECT doc_id AS focus FROM documents WHERE lang NOT IN ('en', 'de')")


@query("SELECT DISTINCT floor(doc_id / 2)::BIGINT AS focus FROM documents GROUP BY floor(doc_id / 2), lang HAVING count(*) > 1")
def unique_lang(spark, sf):
    g = tables(spark, sf)
    return failing(g, _nodes(g, "subjectsOf", p("of")), UniqueLang(P("of"))).select(_int("v", "focus"))


# ---------------------------------------------------------------- pairs


@query("SELECT o_orderkey AS focus FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT date_trunc('second', o_orderdate) < date_trunc('second', l_shipdate))")
def less_than(spark, sf):
    g = tables(spark, sf)
    return failing(g, _nodes(g, "subjectsOf", p("orderdate")), Pair("LessThan", P("orderdate"), p("shipped"))).select(_int("v", "focus"))


@query("SELECT o_orderkey AS focus FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT date_trunc('second', o_orderdate) <= date_trunc('second', l_shipdate))")
def less_than_or_equals(spark, sf):
    g = tables(spark, sf)
    return failing(g, _nodes(g, "subjectsOf", p("orderdate")), Pair("LessThanOrEquals", P("orderdate"), p("shipped"))).select(_int("v", "focus"))


@query("SELECT o_orderkey AS focus FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus <> 'Z'")
def equals(spark, sf):
    g = tables(spark, sf)
    return failing(g, _nodes(g, "subjectsOf", p("status")), Pair("Equals", P("status"), p("mark"))).select(_int("v", "focus"))


@query("SELECT o_orderkey AS focus FROM orders WHERE o_orderkey % 3 = 0 OR o_orderstatus = 'Z'")
def disjoint(spark, sf):
    g = tables(spark, sf)
    return failing(g, _nodes(g, "subjectsOf", p("status")), Pair("Disjoint", P("status"), p("mark"))).select(_int("v", "focus"))


@query("SELECT c_custkey AS focus FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def closed(spark, sf):
    g = TripleTable(tables(spark, sf).scan(p("acctbal")).selectExpr("s", f"'{p('acctbal')}' p", "o").unionByName(tables(spark, sf).scan(p("custkey")).selectExpr("o s", f"'{p('ordered')}' p", "s o")))
    return failing(g, _nodes(g, "subjectsOf", p("acctbal")), Closed((p("acctbal"),))).select(_int("v", "focus"))


# ---------------------------------------------------------------- boolean operators and composition

SMALL = every(P("size"), Test("maxInclusive", num(20, "integer")))
BRAND = Count(P("brand"), 1, None, Test("in", (text("Brand#11"), text("Brand#12"), text("Brand#13"))))
STEEL = every(P("ptype"), Test("pattern", ("STEEL$", None)))
_SQL = ("p_size <= 20", "p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')", "p_type LIKE '%STEEL'")


def _boolean(name: str, shape, condition: str):
    def f(spark, sf):
        g = tables(spark, sf)
        return Compiler(g).sat(shape, _nodes(g, "subjectsOf", p("brand"))).select(_int("v", "focus"))

    CATALOGUE[name] = (f, f"SELECT p_partkey AS focus FROM part WHERE {condition}")


_boolean("and", And((SMALL, BRAND)), f"({_SQL[0]}) AND ({_SQL[1]})")
_boolean("or", Or((SMALL, BRAND, STEEL)), " OR ".join(f"({s})" for s in _SQL))
_boolean("not", Not(Or((SMALL, STEEL))), f"NOT (({_SQL[0]}) OR ({_SQL[2]}))")
_boolean("xone", Xone((SMALL, BRAND, STEEL)), " + ".join(f"CAST(({s}) AS INT)" for s in _SQL) + " = 1")


@query("SELECT o_orderkey AS focus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1")
def node_ref(spark, sf):
    g = tables(spark, sf)
    s = Schema({"nation": Definition("nation", P("region"), None, [Component("In", (f"<{EX}region/1>",))]), "customer": Definition("customer", P("cnation"), None, [Component("Node", "nation")])})
    return Compiler(g, s).fails(every(P("custkey"), Ref("customer")), _nodes(g, "subjectsOf", p("custkey"))).select(_int("v", "focus"))


# ---------------------------------------------------------------- paths


def _pairs(name: str, path, sql: str, domain=None):
    def f(spark, sf):
        g = tables(spark, sf)
        return reach(g, path, domain(g) if domain else None).select(lex(F.col("v")).alias("v"), lex(F.col("u")).alias("u"))

    CATALOGUE[name] = (f, sql)


_E = EX
_pairs("path_inverse", Inv(P("region")), f"SELECT '{_E}region/' || n_regionkey AS v, '{_E}nation/' || n_nationkey AS u FROM nation")
_pairs("path_sequence", Seq((P("cnation"), P("region"), P("rname"))), f"SELECT '{_E}customer/' || c_custkey AS v, r_name AS u FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_pairs("path_alternative", Alt((P("cnation"), P("snation"))), f"SELECT '{_E}customer/' || c_custkey AS v, '{_E}nation/' || c_nationkey AS u FROM customer UNION SELECT '{_E}supplier/' || s_suppkey, '{_E}nation/' || s_nationkey FROM supplier")
_pairs("path_opt", Opt(P("region")), f"SELECT '{_E}nation/' || n_nationkey AS v, '{_E}region/' || n_regionkey AS u FROM nation UNION SELECT '{_E}nation/' || n_nationkey, '{_E}nation/' || n_nationkey FROM nation", lambda g: _nodes(g, "subjectsOf", p("region")))
_TURNS = f"WITH RECURSIVE e AS (SELECT DISTINCT '{_E}turn/' || conv_id || '/' || turn AS v, '{_E}turn/' || conv_id || '/' || (turn + 1) AS u FROM conversations), r(v, u) AS (SELECT v, u FROM e UNION SELECT r.v, e.u FROM r JOIN e ON r.u = e.v)"
_pairs("path_plus", Plus(P("next")), _TURNS + " SELECT v, u FROM r")
_pairs("path_star", Star(P("next")), _TURNS + " SELECT v, u FROM r UNION SELECT v, v FROM e", lambda g: _nodes(g, "subjectsOf", p("next")))
_pairs("path_predecessor", Seq((Inv(P("custkey")), P("priority"))), f"SELECT DISTINCT '{_E}customer/' || o_custkey AS v, o_orderpriority AS u FROM orders")


@query(
    """SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS
      (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn >= c.turn AND d.role = 'system')"""
)
def recursive_gfp(spark, sf):
    """Turns from which on no turn is a system's: a recursive shape along ``next``."""
    g = tables(spark, sf)
    s = Schema({"calm": Definition("calm", None, None, [Component("Not", "system"), Component("Property", "rest")]), "system": Definition("system", P("role"), None, [Component("HasValue", text("system"))]), "rest": Definition("rest", P("next"), None, [Component("Node", "calm")])})
    small = TripleTable(g.scan(p("next")).selectExpr("s", f"'{p('next')}' p", "o").unionByName(g.scan(p("role")).selectExpr("s", f"'{p('role')}' p", "o")))
    found = Compiler(small, s).sat(Ref("calm"), _nodes(small, "subjectsOf", p("role")))
    part = F.split(F.regexp_replace("v", ">$", ""), "/")
    return found.select(F.element_at(part, -2).cast("bigint").alias("conv_id"), F.element_at(part, -1).cast("bigint").alias("turn"))


# ---------------------------------------------------------------- reports


def customer_schema() -> Schema:
    target = [Target("subjectsOf", p("acctbal"))]
    return Schema(
        {
            "<balance>": Definition("<balance>", P("acctbal"), p("acctbal"), [Component("MinInclusive", num(0)), Component("MaxCount", 1)], target, sh("Warning")),
            "<segment>": Definition("<segment>", P("segment"), p("segment"), [Component("In", (text("BUILDING"), text("MACHINERY")))], target, sh("Violation")),
            "<orders>": Definition("<orders>", Inv(P("custkey")), "^custkey", [Component("MinCount", 1)], target, sh("Info")),
        }
    )


_REPORT = f"""SELECT '{EX}customer/' || c_custkey AS focus, 'MinInclusive' AS component, '<balance>' AS source_shape, 'Warning' AS severity FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT '{EX}customer/' || c_custkey, 'In', '<segment>', 'Violation' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
  UNION ALL SELECT '{EX}customer/' || c_custkey, 'MinCount', '<orders>', 'Info' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""


def _short(rows: DataFrame) -> DataFrame:
    last = lambda c: F.regexp_replace(F.regexp_extract(c, "#([A-Za-z]+)>$", 1), "ConstraintComponent$", "")
    return rows.select(lex(F.col("focus")).alias("focus"), last("component").alias("component"), "source_shape", last("severity").alias("severity"))


@query(_REPORT)
def report_rows(spark, sf):
    return _short(report.validate_rows(tables(spark, sf), customer_schema()))


@query(f"SELECT * FROM ({_REPORT}) WHERE severity IN ('Warning', 'Violation')")
def severity_threshold(spark, sf):
    return _short(report.at_least(report.validate_rows(tables(spark, sf), customer_schema()), sh("Warning")))


@query(f"SELECT component, severity, count(*) AS n FROM ({_REPORT}) GROUP BY 1, 2")
def report_summary(spark, sf):
    rows = report.validate_rows(tables(spark, sf), customer_schema())
    return _short(rows).groupBy("component", "severity").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS focus, list_aggregate(list_sort(list(DISTINCT o_orderkey::VARCHAR)), 'string_agg', ' ') AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def property_witnesses(spark, sf):
    g = tables(spark, sf)
    d = Definition("<orders>", Inv(P("custkey")), None, [Component("MinCount", 1)], [Target("subjectsOf", p("acctbal"))])
    rows = report.property_witnesses(Compiler(g, Schema({d.id: d})), d)
    return rows.select(_int("focus", "focus"), F.array_join(F.array_sort(F.transform("values", key)), " ").alias("orders"))


# ---------------------------------------------------------------- rules and graphs


@query("SELECT o_orderkey AS s, c_nationkey AS o FROM orders JOIN customer ON o_custkey = c_custkey")
def rule_triple(spark, sf):
    g = tables(spark, sf)
    small = TripleTable(g.scan(p("custkey")).selectExpr("s", f"'{p('custkey')}' p", "o").unionByName(g.scan(p("cnation")).selectExpr("s", f"'{p('cnation')}' p", "o")))
    rule = Rule([Target("subjectsOf", p("custkey"))], This(), Const(p("from")), Along(Seq((P("custkey"), P("cnation")))))
    return infer(small, [rule]).select(_int("s", "s"), _int("o", "o"))


@query(_TURNS + " SELECT v AS s, u AS o FROM r")
def rule_fixpoint(spark, sf):
    g = tables(spark, sf)
    small = TripleTable(g.scan(p("next")).selectExpr("s", f"'{p('next')}' p", "o"))
    both = Along(Alt((P("next"), Seq((P("next"), P("later"))))))
    return infer(small, [Rule([Target("subjectsOf", p("next"))], This(), Const(p("later")), both)]).select(lex(F.col("s")).alias("s"), lex(F.col("o")).alias("o"))


@query("SELECT c_custkey AS s, 'big' AS o FROM customer WHERE c_acctbal >= 5000 UNION ALL SELECT c_custkey, 'rest' FROM customer WHERE c_acctbal < 5000")
def rule_order(spark, sf):
    """The second rule sees what the first, of lower order, has added."""
    g = TripleTable(tables(spark, sf).scan(p("acctbal")).selectExpr("s", f"'{p('acctbal')}' p", "o"))
    target = [Target("subjectsOf", p("acctbal"))]
    big = Rule(target, This(), Const(p("class")), Const(text("big")), [every(P("acctbal"), Test("minInclusive", num(5000)))], 1)
    rest = Rule(target, This(), Const(p("class")), Const(text("rest")), [Count(P("class"), 0, 0)], 2)
    return infer(g, [rest, big]).select(_int("s", "s"), lex(F.col("o")).alias("o"))


@query("SELECT o_orderkey AS v, c_custkey AS u FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0")
def node_expression(spark, sf):
    from shapeloom.operators.infer import evaluate

    g = tables(spark, sf)
    poor = every(P("acctbal"), Test("maxExclusive", num(0)))
    found = evaluate(Compiler(g), Filtered(Along(P("custkey")), poor), _nodes(g, "subjectsOf", p("custkey")))
    return found.select(_int("v", "v"), _int("u", "u"))


@query("SELECT 'new' AS s, 'x' AS o UNION ALL SELECT r_name, r_regionkey::VARCHAR FROM region WHERE r_regionkey <> 1")
def delta_apply(spark, sf):
    from shapeloom.api import apply_delta

    g = TripleTable(tables(spark, sf).scan(p("rname")).selectExpr("o s", f"'{p('of')}' p", "s o"))
    add = TripleTable(spark.createDataFrame([(text("new"), p("of"), f"<{EX}x>")], "s string, p string, o string"))
    out = apply_delta(g, add, TripleTable(g.all().where(F.col("o") == f"<{EX}region/1>")))
    return out.all().select(lex(F.col("s")).alias("s"), key("o").alias("o"))


@query(
    """SELECT c_custkey AS focus, CASE WHEN c_acctbal < 0 AND c_acctbal >= -500 THEN 'fixed' WHEN c_acctbal < -500 THEN 'remaining' ELSE 'introduced' END AS status
      FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9500"""
)
def gate_diff(spark, sf):
    from shapeloom.api import gate

    g, target = tables(spark, sf), [Target("subjectsOf", p("acctbal"))]
    schema = lambda *c: Schema({"<s>": Definition("<s>", P("acctbal"), None, list(c), target)})
    before = report.validate_rows(g, schema(Component("MinInclusive", num(0))))
    after = report.validate_rows(g, schema(Component("MinInclusive", num(-500)), Component("MaxInclusive", num(9500))))
    return gate(before, after).select(_int("focus", "focus"), "status")


@query("SELECT 'custkey' AS p, count(*) AS n FROM orders UNION ALL SELECT 'region', count(*) FROM nation")
def statistics(spark, sf):
    g = tables(spark, sf)
    rows = g.scan(p("custkey")).selectExpr("s", f"'{p('custkey')}' p", "o").unionByName(g.scan(p("region")).selectExpr("s", f"'{p('region')}' p", "o"))
    return TripleTable(rows).statistics().select(key("p").alias("p"), "n")


# ---------------------------------------------------------------- queries inside shapes, functions, reports as data


_RICH = f"?value >= {num(5000)}"


def _component(kind: str, query: str, **extra) -> Component:
    return Component("Custom", query, {"kind": kind, "prefixes": (("ex", EX),), "iri": p("Rich"), "message": None, "parameters": {}} | extra)


@query("SELECT c_custkey AS focus, c_acctbal < 5000 AS poor FROM customer WHERE c_acctbal < 5000")
def custom_component(spark, sf):
    """A component with an ASK validator for every value."""
    g = tables(spark, sf)
    s = Schema({"<rich>": Definition("<rich>", P("acctbal"), p("acctbal"), [_component("ask", f"ASK {{ FILTER ({_RICH}) }}")], [Target("subjectsOf", p("acctbal"))])})
    return report.validate_rows(g, s).select(_int("focus", "focus"), (F.col("component") == p("Rich")).alias("poor"))


@query("SELECT c_custkey AS focus, 'balance of ' || c_custkey || ' is low' AS message FROM customer WHERE c_acctbal < 0")
def message_template(spark, sf):
    g = tables(spark, sf)
    part = Component("SPARQL", "SELECT $this ?key { $this ex:acctbal ?b FILTER (?b < 0) BIND (STRAFTER(STR($this), 'customer/') AS ?key) }", {"kind": "select", "prefixes": (("ex", EX),), "message": "balance of {?key} is low"})
    s = Schema({"<low>": Definition("<low>", None, None, [part], [Target("subjectsOf", p("acctbal"))])})
    return report.validate_rows(g, s).select(_int("focus", "focus"), "message")


@query("SELECT c_custkey AS focus FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def ask_constraint(spark, sf):
    from shapeloom.plans.shapes import Ask

    g = tables(spark, sf)
    shape = Ask(Id(), f'ASK {{ ?o ex:custkey $this ; ex:priority {text("1-URGENT")} }}', (("ex", EX),))
    return failing(g, _nodes(g, "subjectsOf", p("acctbal")), shape).select(_int("v", "focus"))


def _big():
    from shapeloom.plans.functions import Function, Parameter

    return Function(p("big"), (Parameter("x", p("x")),), "ASK { FILTER ($x > 40) }", ())


@query("SELECT p_partkey AS focus FROM part WHERE p_size <= 40")
def expression_constraint(spark, sf):
    from shapeloom.operators.infer import Apply
    from shapeloom.plans.shapes import Expression

    g = tables(spark, sf)
    return failing(g, _nodes(g, "subjectsOf", p("size")), Expression(Apply(_big(), (Along(P("size")),)))).select(_int("v", "focus"))


@query("SELECT p_partkey AS part FROM part WHERE p_size > 40")
def sparql_function(spark, sf):
    from shapeloom.operators import sparql

    found = sparql.select(tables(spark, sf), "SELECT ?s { ?s ex:size ?n FILTER (ex:big(?n)) }", {"ex": EX}, functions={p("big"): _big()})
    return found.select(_int("s", "part"))


@query("SELECT c_custkey AS focus, 'MinInclusive' AS component FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'In' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT c_custkey, 'MinCount' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def report_graph(spark, sf):
    """The report as triples, read back by a SPARQL query."""
    from shapeloom.operators import sparql

    g = TripleTable(materialize(report.report_graph(report.validate_rows(tables(spark, sf), customer_schema()), False)))
    rows = sparql.select(g, "SELECT ?f ?c { ?report sh:result ?r . ?r sh:focusNode ?f ; sh:sourceConstraintComponent ?c }", {"sh": sh("")[1:-1]})
    return rows.select(_int("f", "focus"), F.regexp_extract("c", "#([A-Za-z]+)ConstraintComponent>$", 1).alias("component"))


@query("""SELECT '{"r":{"type":"uri","value":"http://example.org/region/' || r_regionkey || '"},"n":{"type":"literal","value":"' || r_name || '"}}' AS value FROM region""")
def results_json(spark, sf):
    from shapeloom.operators import sparql
    from shapeloom.sources.results import json_rows

    return json_rows(sparql.select(tables(spark, sf), "SELECT ?r ?n { ?r ex:rname ?n }", {"ex": EX}))


@query("SELECT 'nations' AS g, n_nationkey AS s FROM nation UNION ALL SELECT 'regions', r_regionkey FROM region")
def named_graph(spark, sf):
    from shapeloom.operators import sparql
    from shapeloom.sources.triples import QuadTable

    g = tables(spark, sf)
    quads = None
    for name, pred in (("nations", "nname"), ("regions", "rname")):
        rows = g.match(p=p(pred)).select(F.lit(p(name)).alias("g"), "s", F.lit(p("name")).alias("p"), "o")
        quads = rows if quads is None else quads.unionByName(rows)
    table = QuadTable(quads)
    rows = sparql.select(table.graph(None), "SELECT ?g ?s { GRAPH ?g { ?s ex:name ?n } }", {"ex": EX}, graphs=table.graphs())
    return rows.select(key("g").alias("g"), _int("s", "s"))


@query("SELECT o_orderkey AS o FROM orders WHERE o_custkey = 7")
def pattern_scan(spark, sf):
    """A constant object becomes a condition on the key column of the scan."""
    return tables(spark, sf).match(p=p("custkey"), o=f"<{EX}customer/7>").select(_int("s", "o"))


@query("SELECT o_orderkey AS o, CASE WHEN o_orderpriority = '1-URGENT' THEN 'now' ELSE 'later' END AS t FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def sparql_exists_expression(spark, sf):
    from shapeloom.operators import sparql

    rows = sparql.select(tables(spark, sf), "SELECT ?o ?t { ?o ex:status ?s BIND (IF(EXISTS { ?o ex:priority '1-URGENT' }, 'now', 'later') AS ?t) FILTER (?s != 'F' || NOT EXISTS { ?o ex:priority '1-URGENT' }) }", {"ex": EX})
    return rows.select(_int("o", "o"), lex(F.col("t")).alias("t"))


@query("SELECT n_nationkey AS n, count(c_custkey) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def sparql_lateral(spark, sf):
    """A count for every nation, of those without customers as well."""
    from shapeloom.operators import sparql

    rows = sparql.select(tables(spark, sf), "SELECT ?n ?k { ?n ex:region ?r LATERAL { SELECT ?n (COUNT(?c) AS ?k) { ?c ex:cnation ?n } } }", {"ex": EX})
    return rows.select(_int("n", "n"), lex(F.col("k")).cast("bigint").alias("k"))


@query("SELECT 'region' AS p, n_regionkey::VARCHAR AS o FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'nname', n_name FROM nation WHERE n_nationkey = 3")
def sparql_describe(spark, sf):
    from shapeloom.operators import sparql

    g = tables(spark, sf)
    small = TripleTable(g.match(p=p("region")).unionByName(g.match(p=p("nname"))))
    rows = sparql.describe(small, f"DESCRIBE <{EX}nation/3>")
    return rows.select(key("p").alias("p"), F.when(F.col("o").startswith("<"), key("o")).otherwise(lex(F.col("o"))).alias("o"))


@query("SELECT DISTINCT c_nationkey AS focus FROM customer WHERE c_acctbal > 9000")
def target_exists(spark, sf):
    """Nodes that a path leads from to a node that satisfies a shape."""
    g = tables(spark, sf)
    t = Target("exists", "", path=Seq((Inv(P("cnation")), P("acctbal"))), shape=Test("minExclusive", num(9000)))
    small = TripleTable(g.match(p=p("cnation")).unionByName(g.match(p=p("acctbal"))))
    return select(small, t).select(_int("v", "focus"))


@query("SELECT p_partkey AS part, replace(p_type, ' ', '_') AS class FROM part UNION ALL SELECT p_partkey, split_part(p_type, ' ', 1) FROM part")
def class_index(spark, sf):
    from shapeloom.operators.shapes import classes

    return classes(tables(spark, sf)).select(_int("v", "part"), key("class").alias("class"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import shapeloom.sparql_queries  # noqa: F401  adds its queries to the catalogue

    return {name: f for name, (f, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}


__all__ = ["Id", "oracle_sql", "queries"]
