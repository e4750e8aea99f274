"""Selectors and ``sat``: which nodes of a domain satisfy a shape, as one lazy DataFrame.

Domains and results have one column, v, of distinct terms.  Counts, pairs and other leaves are sets of
nodes that joins and grouped counts find; conjunctions, disjunctions and negations are formulas over
marks of these sets; nothing iterates over nodes.  Recursive shapes are fixpoints over whole strongly connected components.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.functions.terms import compare_parsed, facet, lang, parsed
from shapeloom.operators.paths import ends, reach
from shapeloom.plans.paths import Inv, Pred, Seq, Star
from shapeloom.plans.shapes import And, Ask, Closed, Count, Expression, Not, Or, Pair, Ref, Schema, Shape, Sparql, Target, Test, Top, UniqueLang, Xone, normalize, strata
from shapeloom.sources.storage import materialize
from shapeloom.sources.terms import SUBCLASS, TYPE, XSD

TRUE = (f'"true"^^<{XSD}boolean>', f'"1"^^<{XSD}boolean>')


def select(source, target: Target) -> DataFrame:
    """Focus nodes of a target (v)."""
    if target.kind == "node":
        return source.spark.createDataFrame([(target.term,)], "v string")  # even if the graph does not have it
    if target.kind == "subjectsOf":
        return source.scan(target.term).select(F.col("s").alias("v")).distinct()
    if target.kind == "objectsOf":
        return source.scan(target.term).select(F.col("o").alias("v")).distinct()
    if target.kind == "sparql":
        from shapeloom.operators import sparql

        found = sparql.select(source, target.term, dict(target.prefixes)).select(F.col("this").alias("v")).distinct()
        return found.join(source.nodes(), "v", "left_semi")
    if target.kind == "exists":
        return Compiler(source).sat(Count(target.path, 1, None, target.shape), source.nodes())
    return instances(source, target.term)


def instances(source, cls: str) -> DataFrame:
    """Nodes whose type is the class or a subclass of it; only what is below the class is walked."""
    below = ends(source.scan(SUBCLASS).select(F.col("o").alias("v"), F.col("s").alias("u")), cls)
    return source.scan(TYPE).join(below.select(F.col("v").alias("o")), "o", "left_semi").select(F.col("s").alias("v")).distinct()


def classes(source) -> DataFrame:
    """(v, class): every node with its types and all classes above them."""
    up = reach(source, Star(Pred(SUBCLASS)), source.scan(TYPE).select(F.col("o").alias("v")).distinct())
    return source.scan(TYPE).select(F.col("s").alias("v"), F.col("o").alias("c")).join(up.select(F.col("v").alias("c"), F.col("u").alias("class")), "c").select("v", "class").distinct()


def foci(source, targets: list[Target]) -> DataFrame:
    out = None
    for t in targets:
        found = select(source, t)
        out = found if out is None else out.unionByName(found)
    return out.distinct() if out is not None else source.spark.createDataFrame([], "v string")


class Compiler:
    """Shapes of a schema over a triple source."""

    def __init__(self, source, schema: Schema | None = None):
        self.source, self.schema = source, schema or Schema({})
        self._recursive = {n for part in strata(self.schema) if len(part) > 1 or self._self(part[0]) for n in part}
        self._assumed: dict[str, DataFrame] = {}
        self._fixed: dict[str, tuple[DataFrame, dict[str, DataFrame]]] = {}

    def _self(self, name: str) -> bool:
        from shapeloom.plans.shapes import references

        return any(n == name for n, _ in references(self.schema.formula(name)))

    def sat(self, shape: Shape, domain: DataFrame) -> DataFrame:
        """The nodes of ``domain`` that satisfy ``shape``."""
        return self._sat(normalize(shape), domain)

    def fails(self, shape: Shape, domain: DataFrame) -> DataFrame:
        return domain.join(self.sat(shape, domain), "v", "left_anti")

    def _sat(self, s: Shape, d: DataFrame) -> DataFrame:
        """Every leaf is one set of nodes, found once over the same domain; the shape is then a formula over a row of marks.

        So the plan grows with the number of leaves, however they are combined.
        """
        if isinstance(s, And):  # conditions on the term alone narrow the domain first
            plain = [x for x in s.shapes if _plain(x)]
            for x in plain:
                d = d.where(self._formula(x, d, {}))
            s = And(tuple(x for x in s.shapes if x not in plain))
        leaves: dict[Shape, tuple[str, bool, DataFrame]] = {}
        ok = self._formula(s, d, leaves)
        if not leaves:
            return d.where(ok)
        if len(leaves) == 1 and (s in leaves or (isinstance(s, Not) and s.shape in leaves)):
            ((_, positive, found),) = leaves.values()
            return d.join(found, "v", "left_semi" if positive == (s in leaves) else "left_anti")
        marks = None
        for name, _, found in leaves.values():
            rows = found.select("v", F.lit(name).alias("m"))
            marks = rows if marks is None else marks.unionByName(rows)
        row = marks.groupBy("v").agg(*[F.max(F.col("m") == name).alias(name) for name, _, _ in leaves.values()])
        return d.join(row, "v", "left").where(ok).select("v")

    def _formula(self, s: Shape, d: DataFrame, leaves: dict) -> Column:
        """A boolean column, never null, over v and the marks of ``leaves``, which it fills."""
        if isinstance(s, Top):
            return F.lit(True)
        if isinstance(s, Test):
            return facet(F.col("v"), s.facet, s.value)
        if isinstance(s, Not):
            return ~self._formula(s.shape, d, leaves)
        if isinstance(s, And | Or):
            parts = [self._formula(x, d, leaves) for x in s.shapes]
            return reduce(lambda x, y: x & y if isinstance(s, And) else x | y, parts, F.lit(isinstance(s, And)))
        if isinstance(s, Xone):  # a member that stands twice counts twice
            return reduce(lambda x, y: x + y, [self._formula(x, d, leaves).cast("int") for x in s.shapes], F.lit(0)) == 1
        if isinstance(s, Ref) and s.name not in self._assumed and s.name not in self._recursive:
            return self._formula(normalize(self.schema.formula(s.name)), d, leaves)
        if s not in leaves:
            positive, found = self._leaf(s, d)
            leaves[s] = (f"_m{len(leaves)}", positive, found)
        name, positive, _ = leaves[s]
        marked = F.coalesce(F.col(name), F.lit(False))
        return marked if positive else ~marked

    def _leaf(self, s: Shape, d: DataFrame) -> tuple[bool, DataFrame]:
        """(True, nodes that satisfy a leaf) or (False, nodes that do not); nodes outside of ``d`` do no harm."""
        if isinstance(s, Ref):
            return True, self._ref(s.name, d)
        if isinstance(s, Closed):
            other = self.source.all().where(~F.col("p").isin(list(s.allowed))) if s.allowed else self.source.all()
            return False, other.select(F.col("s").alias("v")).join(d, "v", "left_semi").distinct()
        if isinstance(s, Pair):
            return False, self.pair_failures(s, d).select("v").distinct()
        if isinstance(s, UniqueLang):
            return False, self.repeated_tags(s, d).select("v").distinct()
        if isinstance(s, Count):
            return self._count(s, d)
        if isinstance(s, Sparql):
            from shapeloom.operators import sparql

            rows = sparql.select(self.source, s.text, dict(s.prefixes), this=d, functions=self.schema.functions)
            return False, rows.select(F.col("this").alias("v")).distinct()
        if isinstance(s, Ask):
            return False, self.refuted(s, self.values(s.path, d)).select("v").distinct()
        if isinstance(s, Expression):
            return False, self.untrue(s, d).select("v").distinct()
        raise TypeError(f"no such shape: {s}")

    def refuted(self, s: Ask, values: DataFrame) -> DataFrame:
        """The pairs (v, u) for which an ASK has no match."""
        from shapeloom.operators import sparql

        pairs = values.select(F.col("v").alias("this"), F.col("u").alias("value"))
        good = sparql.ask(self.source, s.text, dict(s.prefixes), this=pairs, functions=self.schema.functions)
        return pairs.join(good, ["this", "value"], "left_anti").select(F.col("this").alias("v"), F.col("value").alias("u"))

    def untrue(self, s: Expression, d: DataFrame) -> DataFrame:
        """(v, u): results of a node expression that are not true."""
        from shapeloom.operators.infer import evaluate

        return evaluate(self, s.expr, d).where(~F.col("u").isin(*TRUE))

    def values(self, path, d: DataFrame) -> DataFrame:
        """(v, u) of the nodes of a domain."""
        return reach(self.source, path, d).join(d, "v", "left_semi")

    def qualified(self, s: Count, d: DataFrame) -> DataFrame:
        values = self.values(s.path, d)
        if isinstance(s.shape, Top):
            return values
        if isinstance(s.shape, Test):
            return values.where(facet(F.col("u"), s.shape.facet, s.shape.value))
        if isinstance(s.shape, Not) and isinstance(s.shape.shape, Test):
            return values.where(~facet(F.col("u"), s.shape.shape.facet, s.shape.shape.value))
        good = self._sat(s.shape, values.select(F.col("u").alias("v")).distinct())
        return values.join(good.select(F.col("v").alias("u")), "u", "left_semi").select("v", "u")

    def _count(self, s: Count, d: DataFrame) -> tuple[bool, DataFrame]:
        q = self.qualified(s, d)
        if s.high is None and s.low == 1:
            return True, q.select("v").distinct()
        if s.high == 0:
            return False, q.select("v").distinct()
        n = q.groupBy("v").agg(F.count("*").alias("n"))  # pairs are distinct
        if s.low <= 0:
            return False, n.where(F.col("n") > s.high).select("v")
        inside = F.col("n") >= s.low
        return True, n.where(inside if s.high is None else inside & (F.col("n") <= s.high)).select("v")

    def pair_failures(self, s: Pair, d: DataFrame) -> DataFrame:
        """Equals and Disjoint: (v, u) of offending values; LessThan: (v, u, w) of offending pairs."""
        left, right = self.values(s.path, d), self.source.scan(s.pred).select(F.col("s").alias("v"), F.col("o").alias("w")).join(d, "v", "left_semi")
        same = (F.col("l.v") == F.col("r.v")) & (F.col("l.u") == F.col("r.w"))
        if s.kind == "Disjoint":
            return left.alias("l").join(right.alias("r"), same, "left_semi")
        if s.kind == "Equals":
            missing = right.alias("r").join(left.alias("l"), same, "left_anti").select("v", F.col("w").alias("u"))
            return left.alias("l").join(right.alias("r"), same, "left_anti").unionByName(missing)
        # Each side is parsed before the join, once for a value, and in a stage of its own.
        both = left.withColumn("_a", parsed(F.col("u"))).join(right.withColumn("_b", parsed(F.col("w"))), "v")
        c = compare_parsed(F.col("_a"), F.col("_b"))
        ok = c < 0 if s.kind == "LessThan" else c <= 0
        return both.where(~F.coalesce(ok, F.lit(False))).drop("_a", "_b")

    def repeated_tags(self, s: UniqueLang, d: DataFrame) -> DataFrame:
        """(v, tag) of language tags that stand on more than one value."""
        tag = F.lower(lang(F.col("u")))
        return self.values(s.path, d).where(F.coalesce(tag, F.lit("")) != "").groupBy("v", tag.alias("tag")).count().where("count > 1").select("v", "tag")

    # recursion: greatest fixpoint of the component, over all nodes of the graph and of the domains that ask

    def _ref(self, name: str, d: DataFrame) -> DataFrame:
        if name in self._assumed:
            return d.join(self._assumed[name], "v", "left_semi")
        part = next(p for p in strata(self.schema) if name in p)
        nodes, now = self._fixed.get(name, (None, {}))
        # A domain may hold nodes that the graph does not: these are asked for in a fixpoint that has them.
        if nodes is None or not d.join(nodes, "v", "left_anti").isEmpty():
            nodes = materialize((self.source.nodes() if nodes is None else nodes).unionByName(d).distinct())
            now = self._fixpoint(part, nodes)
            self._fixed.update(dict.fromkeys(part, (nodes, now)))
        return d.join(now[name], "v", "left_semi")

    def _fixpoint(self, part: list[str], nodes: DataFrame) -> dict[str, DataFrame]:
        now = dict.fromkeys(part, nodes)
        sizes = dict.fromkeys(part, nodes.count())
        while True:
            inner = Compiler.__new__(Compiler)
            inner.source, inner.schema, inner._recursive, inner._fixed = self.source, self.schema, self._recursive, self._fixed
            inner._assumed = {**self._assumed, **now}
            new = {n: materialize(inner.sat(self.schema.formula(n), nodes)) for n in part}
            counts = {n: df.count() for n, df in new.items()}
            if counts == sizes:
                return new
            now, sizes = new, counts


def _plain(s: Shape) -> bool:
    """Whether a shape is a condition on the term alone."""
    if isinstance(s, Not):
        return _plain(s.shape)
    return all(map(_plain, s.shapes)) if isinstance(s, And | Or | Xone) else isinstance(s, Top | Test)
