"""Rules: forward chaining to a fixpoint, in order groups, with node expressions as DataFrames.

All rules of a group read the same snapshot; the triples that they add are there for the next
group.  A pass runs every group; passes go on until one adds nothing.  A rule whose predicates did
not change since it last ran is skipped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeloom.operators import sparql
from shapeloom.operators.paths import reach
from shapeloom.operators.shapes import TRUE, Compiler, foci
from shapeloom.plans.functions import Function
from shapeloom.plans.paths import Path, from_graph, predicates
from shapeloom.plans.shapes import Ref, Schema, Shape, Target, prefixes_of, sh
from shapeloom.plans.sparql import parse as plan
from shapeloom.sources.storage import materialize
from shapeloom.sources.terms import Graph, parts
from shapeloom.sources.triples import TripleTable


class Expr:
    pass


@dataclass(frozen=True)
class This(Expr):
    pass


@dataclass(frozen=True)
class Const(Expr):
    term: str


@dataclass(frozen=True)
class Along(Expr):
    """Values of a path from the values of another expression."""

    path: Path
    of: Expr = This()


@dataclass(frozen=True)
class Filtered(Expr):
    of: Expr
    shape: Shape


@dataclass(frozen=True)
class Both(Expr):
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Any(Expr):
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Apply(Expr):
    """A declared function, called for every combination of its arguments' values."""

    function: Function
    args: tuple[Expr, ...]


@dataclass
class Rule:
    targets: list[Target]
    subject: Expr
    predicate: Expr
    object: Expr
    conditions: list[Shape] = field(default_factory=list)
    order: float = 0
    deactivated: bool = False
    construct: str | None = None  # a CONSTRUCT with $this bound to the foci, instead of the three expressions
    prefixes: tuple[tuple[str, str], ...] = ()


def evaluate(c: Compiler, e: Expr, focus: DataFrame) -> DataFrame:
    """(v, u): distinct values u of the expression for each focus v."""
    if isinstance(e, This):
        return focus.select("v", F.col("v").alias("u"))
    if isinstance(e, Const):
        return focus.select("v", F.lit(e.term).alias("u"))
    if isinstance(e, Along):
        start = evaluate(c, e.of, focus).select("v", F.col("u").alias("m"))
        step = reach(c.source, e.path, start.select(F.col("m").alias("v")).distinct())
        return start.join(step.select(F.col("v").alias("m"), "u"), "m").select("v", "u").distinct()
    if isinstance(e, Filtered):
        values = evaluate(c, e.of, focus)
        good = c.sat(e.shape, values.select(F.col("u").alias("v")).distinct())
        return values.join(good.select(F.col("v").alias("u")), "u", "left_semi").select("v", "u")
    if isinstance(e, Apply):
        return _called(c, e, focus)
    parts = [evaluate(c, x, focus) for x in e.parts]
    out = parts[0]
    for x in parts[1:]:
        out = out.intersect(x) if isinstance(e, Both) else out.unionByName(x)
    return out.distinct()


def _called(c: Compiler, e: Apply, focus: DataFrame) -> DataFrame:
    """The function's body, with its parameters pre-bound; it may read the graph."""
    f, rows = e.function, focus.select(F.col("v").alias("this"))
    for p, x in zip(f.parameters, e.args, strict=False):
        rows = rows.join(evaluate(c, x, focus).select(F.col("v").alias("this"), F.col("u").alias(p.name)), "this")
    if plan(f.text, dict(f.prefixes)).kind == "ASK":
        good = sparql.ask(c.source, f.text, dict(f.prefixes), this=rows, functions=c.schema.functions).withColumn("_hit", F.lit(True))
        found = rows.join(good, rows.columns, "left").select("this", F.when(F.col("_hit"), TRUE[0]).otherwise(TRUE[0].replace("true", "false")).alias("u"))
    else:
        out = sparql.select(c.source, f.text, dict(f.prefixes), this=rows, functions=c.schema.functions)
        found = out.select("this", F.col(next(n for n in out.columns if n not in rows.columns)).alias("u")).where("u is not null")
    return found.select(F.col("this").alias("v"), "u").distinct()


def apply_rule(c: Compiler, rule: Rule) -> DataFrame:
    """(s, p, o) that a rule makes; literal subjects and predicates that are no IRIs make none."""
    focus = foci(c.source, rule.targets)
    for shape in rule.conditions:
        focus = c.sat(shape, focus)
    if rule.construct is not None:
        return sparql.construct(c.source, rule.construct, dict(rule.prefixes), this=focus, functions=c.schema.functions)
    s, p, o = (evaluate(c, e, focus).withColumnRenamed("u", name) for e, name in ((rule.subject, "s"), (rule.predicate, "p"), (rule.object, "o")))
    out = s.join(p, "v").join(o, "v").select("s", "p", "o")
    return out.where(~F.col("s").startswith('"') & F.col("p").startswith("<")).distinct()


def _reads(rule: Rule) -> set[str] | None:
    """Predicates that a rule reads; None if it may read any."""

    def of(e: Expr) -> set[str] | None:
        if isinstance(e, Along):
            inner = of(e.of)
            return None if inner is None else inner | predicates(e.path)
        if isinstance(e, Filtered):
            return None
        if isinstance(e, Apply):
            return None
        if isinstance(e, Both | Any):
            parts = [of(x) for x in e.parts]
            return None if None in parts else set().union(*parts)
        return set()

    if rule.conditions or rule.construct is not None or any(t.kind in ("class", "sparql") for t in rule.targets):
        return None
    found = [of(e) for e in (rule.subject, rule.predicate, rule.object)]
    return None if None in found else set().union(*found, {t.term for t in rule.targets if t.kind != "node"})


def infer(graph: TripleTable, rules: list[Rule], schema: Schema | None = None) -> DataFrame:
    """The triples that the rules add to the graph; passes go on until one adds nothing."""
    now, added = graph, None
    groups = sorted({r.order for r in rules})
    changed: dict[int, set[str] | None] = {id(r): None for r in rules}
    while True:
        grown = False
        for order in groups:
            out = None
            for r in rules:
                reads = _reads(r)
                if r.deactivated or r.order != order or (changed[id(r)] is not None and reads is not None and not reads & changed[id(r)]):
                    continue
                changed[id(r)] = set()
                made = apply_rule(Compiler(now, schema), r)
                out = made if out is None else out.unionByName(made)
            if out is None:
                continue
            new = materialize(out.distinct().join(now.all(), ["s", "p", "o"], "left_anti").select("s", "p", "o"))
            touched = {r["p"] for r in new.select("p").distinct().collect()}  # predicates of the rules' heads
            if touched:
                grown = True
                added = new if added is None else materialize(added.unionByName(new))
                now = TripleTable(graph.all().unionByName(added))
                for r in rules:
                    changed[id(r)] = touched if changed[id(r)] is None else changed[id(r)] | touched
        if not grown:
            break
    return added if added is not None else graph.spark.createDataFrame([], "s string, p string, o string")


def lower_expr(g: Graph, node: str, functions: dict | None = None) -> Expr:
    """A node expression of a shapes graph; ``functions`` are those that it may call."""
    if node == sh("this"):
        return This()
    inner = g.value(node, sh("nodes"))
    of = lower_expr(g, inner, functions) if inner is not None else This()
    for f in (functions or {}).values():
        if (x := g.value(node, f.iri)) is not None:
            return Apply(f, tuple(lower_expr(g, y, functions) for y in g.items(x)))
    if (x := g.value(node, sh("path"))) is not None:
        return Along(from_graph(g, x), of)
    if (x := g.value(node, sh("filterShape"))) is not None:
        return Filtered(of, Ref(x))
    for name, kind in (("union", Any), ("intersection", Both)):
        if (x := g.value(node, sh(name))) is not None:
            return kind(tuple(lower_expr(g, y, functions) for y in g.items(x)))
    return Const(node)


def lower_rules(g: Graph, schema: Schema) -> list[Rule]:
    """The rules of a shapes graph, for the targets of the shapes that have them."""
    out = []
    for shape in sorted(g.subjects_of(sh("rule"))):
        targets = schema.shapes[shape].targets if shape in schema.shapes else []
        for r in g.objects(shape, sh("rule")):
            get = lambda name, r=r: g.value(r, sh(name))
            common = {
                "conditions": [Ref(x) for x in g.objects(r, sh("condition"))],
                "order": float(parts(get("order"))[1]) if get("order") else 0.0,
                "deactivated": any(parts(x)[1] == "true" for x in g.objects(r, sh("deactivated"))),
            }
            if get("construct") is not None:
                out.append(Rule(targets, This(), This(), This(), **common, construct=parts(get("construct"))[1], prefixes=prefixes_of(g, r)))
            elif all(get(x) is not None for x in ("subject", "predicate", "object")):
                out.append(Rule(targets, *(lower_expr(g, get(x), schema.functions) for x in ("subject", "predicate", "object")), **common))
    return out
