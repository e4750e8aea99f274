"""Validation results: one row per focus, path, value, component and source shape."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.functions.terms import facet, lex, make_literal
from shapeloom.operators.paths import reach
from shapeloom.operators.shapes import Compiler, foci
from shapeloom.plans.paths import Id
from shapeloom.plans.shapes import FACETS, Ask, Component, Definition, Expression, Pair, Schema, Target, UniqueLang, sh
from shapeloom.sources.terms import SH, TYPE, XSD

COLUMNS = ["focus", "path", "value", "component", "source_shape", "severity", "message"]
_RANK = {f"<{SH}Info>": 0, f"<{SH}Warning>": 1}

#: Messages where neither the shape nor one above it has its own; {0} is the constraint's value.
MESSAGES = {
    "MinCount": "fewer than {0} values",
    "MaxCount": "more than {0} values",
    "HasValue": "missing value {0}",
    "Class": "{?value} is not an instance of {0}",
    "Datatype": "{?value} is not a valid {0}",
    "NodeKind": "{?value} is of the wrong node kind",
    "In": "{?value} is not in the list of allowed values",
    "Pattern": "{?value} does not match {0}",
    "MinLength": "{?value} is shorter than {0}",
    "MaxLength": "{?value} is longer than {0}",
    "MinInclusive": "{?value} is not {0} or more",
    "MinExclusive": "{?value} is not more than {0}",
    "MaxInclusive": "{?value} is not {0} or less",
    "MaxExclusive": "{?value} is not less than {0}",
    "LanguageIn": "{?value} has none of the allowed languages",
    "UniqueLang": "language used more than once",
    "Equals": "{?value} is not on both sides: not equal to the values of {0}",
    "Disjoint": "{?value} is a value of {0} as well",
    "LessThan": "{?value} is not less than the values of {0}",
    "LessThanOrEquals": "{?value} is more than a value of {0}",
    "Closed": "predicate is not allowed",
    "QualifiedMinCount": "fewer than {0} values satisfy the qualified shape",
    "QualifiedMaxCount": "more than {0} values satisfy the qualified shape",
    "Node": "{?value} does not satisfy {0}",
    "Not": "{?value} satisfies {0}, which it must not",
    "And": "{?value} does not satisfy all shapes",
    "Or": "{?value} satisfies none of the shapes",
    "Xone": "{?value} does not satisfy exactly one of the shapes",
    "SPARQL": "the query of the constraint has a result",
    "Expression": "{?value} is not true",
}
GENERIC = "{?value} does not satisfy the constraint"


def filled(text: str, terms: dict[str, Column]) -> Column:
    """A message with {$name} and {?name} replaced: literals by their lexical form, other terms as they are; unknown names stay."""
    out = []
    for k, x in enumerate(re.split(r"(\{[$?]\w+\})", text)):
        t = terms.get(x[2:-1]) if k % 2 else None
        out.append(F.lit(x) if t is None else F.coalesce(F.when(t.startswith('"'), lex(t)).otherwise(t), F.lit(x)))
    return F.concat(*out)


def validate_rows(source, schema: Schema, data=None, shapes: list[str] | None = None) -> DataFrame:
    """All results of a schema over a source; with ``data``, only its nodes (and node targets) are foci.

    ``shapes`` names the shapes whose targets are looked at, all by default.
    """
    compiler = Compiler(source, schema)
    out = source.spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS))
    for name in sorted(schema.shapes):
        d = schema.shapes[name]
        if d.targets and not d.deactivated and (shapes is None or name in shapes):
            out = out.unionByName(_shape(compiler, d, _foci(source, d.targets, data), None))
    return out


def _foci(source, targets: list[Target], data) -> DataFrame:
    found = foci(source, targets)
    if data is None or all(t.kind == "node" for t in targets):
        return found
    inside = found.join(data.nodes(), "v", "left_semi")
    named = [t for t in targets if t.kind == "node"]
    return inside.unionByName(foci(source, named)).distinct() if named else inside


def _shape(c: Compiler, d: Definition, focus: DataFrame, message: str | None) -> DataFrame:
    values = reach(c.source, d.path, focus).join(focus, "v", "left_semi") if d.path is not None else focus.select("v", F.col("v").alias("u"))
    message = d.message or message
    out = None
    for part in d.components:
        rows = _component(c, d, part, focus, values, message)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return c.source.spark.createDataFrame([], ", ".join(f"{x} string" for x in COLUMNS))
    return out


def _rows(d: Definition, part: Component, found: DataFrame, value: Column | None, message: str | None, path: Column | None = None, terms: dict | None = None, own: Column | None = None) -> DataFrame:
    """``terms``: what message templates may name besides the focus, the value and the path; ``own``: a message of the row."""
    none = F.lit(None).cast("string")
    shown = part.value[0] if isinstance(part.value, tuple) and part.value else part.value
    text = message or MESSAGES.get(part.name, GENERIC).replace("{0}", str(shown))
    path = path if path is not None else F.lit(d.path_text).cast("string")
    names = {"this": F.col("v"), "path": path} | ({"value": value} if value is not None else {}) | (terms or {})
    said = filled(text, names)
    return found.select(
        F.col("v").alias("focus"),
        path.alias("path"),
        (value if value is not None else none).alias("value"),
        F.lit(part.extra.get("iri") or sh(part.name + "ConstraintComponent")).alias("component"),
        F.lit(d.id).alias("source_shape"),
        F.lit(d.severity).alias("severity"),
        (F.coalesce(own, said) if own is not None else said).alias("message"),
    )


def _component(c: Compiler, d: Definition, part: Component, focus: DataFrame, values: DataFrame, message: str | None) -> DataFrame:
    n = part.name
    if n in ("MinCount", "MaxCount", "HasValue", "QualifiedMinCount", "QualifiedMaxCount"):
        return _rows(d, part, c.fails(c.schema.constraint(d, part), focus), None, message)
    if n == "UniqueLang":
        return _rows(d, part, c.repeated_tags(UniqueLang(d.path or Id()), focus), None, message)
    if n in ("Equals", "Disjoint", "LessThan", "LessThanOrEquals"):
        return _rows(d, part, c.pair_failures(Pair(n, d.path or Id(), part.value), focus), F.col("u"), message)
    if n in ("SPARQL", "Custom"):
        return _queried(c, d, part, focus, values, part.extra["message"] or message)
    if n == "Expression":
        return _rows(d, part, c.untrue(Expression(part.value), focus), F.col("u"), message, F.lit(None).cast("string"))
    if n == "Closed":
        out = c.source.all()
        out = out.where(~F.col("p").isin(list(part.value))) if part.value else out
        found = values.join(out.select(F.col("s").alias("u"), "p", "o"), "u").select("v", "p", "o")
        return _rows(d, part, found, F.col("o"), message, F.col("p"))
    if n == "Property":
        child = c.schema.shapes.get(part.value)
        if child is None or child.deactivated:
            return _rows(d, part, values.where(F.lit(False)), None, message)
        return _shape(c, child, values.select(F.col("u").alias("v")).distinct(), message)
    if n in FACETS:
        return _rows(d, part, values.where(~facet(F.col("u"), FACETS[n], part.value)), F.col("u"), message)
    bad = c.fails(c.schema.value_test(part), values.select(F.col("u").alias("v")).distinct())
    return _rows(d, part, values.join(bad.select(F.col("v").alias("u")), "u", "left_semi"), F.col("u"), message)


def _queried(c: Compiler, d: Definition, part: Component, focus: DataFrame, values: DataFrame, message: str | None) -> DataFrame:
    """Rows of a query with pre-bound foci: of a SELECT one for each of its rows, of an ASK one for each value without a match."""
    from shapeloom.operators import sparql

    known = {k: F.lit(v) for k, v in part.extra.get("parameters", {}).items()}
    if part.extra["kind"] == "ask":
        pairs = values if part.name == "Custom" else focus.select("v", F.col("v").alias("u"))
        bad = c.refuted(Ask(d.path or Id(), part.value, part.extra["prefixes"]), pairs)
        return _rows(d, part, bad, F.col("u") if part.name == "Custom" else None, message, terms=known)
    rows = sparql.select(c.source, part.value, dict(part.extra["prefixes"]), this=focus, functions=c.schema.functions)
    has = rows.columns
    rows = rows.withColumnRenamed("this", "v")
    focus_too = part.name == "SPARQL" or d.path is None  # what stands for a value that the query does not name
    value = F.coalesce("value", "v") if "value" in has and focus_too else F.col("value") if "value" in has else F.col("v") if focus_too else None
    path = F.coalesce(F.col("path"), F.lit(d.path_text)) if "path" in has else None
    own = F.when(F.col("message").startswith('"'), lex(F.col("message"))) if "message" in has else None
    terms = known | {x: F.col(x) for x in has if x not in ("this", "value", "path")}
    return _rows(d, part, rows, value, message, path, terms, own)


def rank(severity: Column) -> Column:
    """0 info, 1 warning, 2 violation or any other."""
    out = F.lit(2)
    for name, r in _RANK.items():
        out = F.when(severity == name, r).otherwise(out)
    return out


def at_least(rows: DataFrame, severity: str) -> DataFrame:
    return rows.where(rank(F.col("severity")) >= _RANK.get(severity, 2))


def conforms(rows: DataFrame, minimum: str = f"<{SH}Info>") -> bool:
    return at_least(rows, minimum).isEmpty()


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("component", "severity").agg(F.count("*").alias("n"))


def violations(compiler: Compiler, statements: list[tuple[DataFrame, object]]) -> DataFrame:
    """(focus, statement): the nodes of each statement's domain that fail its shape."""
    out = None
    for k, (domain, shape) in enumerate(statements):
        rows = compiler.fails(shape, domain).select(F.col("v").alias("focus"), F.lit(k).alias("statement"))
        out = rows if out is None else out.unionByName(rows)
    return out


def property_witnesses(compiler: Compiler, d: Definition) -> DataFrame:
    """(focus, shape, values) of conforming foci: the values that a property shape's path leads to."""
    good = compiler.sat(compiler.schema.formula(d.id), foci(compiler.source, d.targets))
    values = reach(compiler.source, d.path or Id(), good).join(good, "v", "left_semi")
    return good.join(values.groupBy("v").agg(F.array_sort(F.collect_set("u")).alias("values")), "v", "left").select(F.col("v").alias("focus"), F.lit(d.id).alias("shape"), F.coalesce("values", F.array().cast("array<string>")).alias("values"))


def report_graph(rows: DataFrame, conforming: bool) -> DataFrame:
    """(s, p, o) of a validation report; every result is a blank node."""
    spark, root = rows.sparkSession, "_:report"
    head = spark.createDataFrame([(root, TYPE, sh("ValidationReport")), (root, sh("conforms"), f'"{str(conforming).lower()}"^^<{XSD}boolean>')], "s string, p string, o string")
    named = rows.withColumn("r", F.concat(F.lit("_:r"), F.hex(F.xxhash64(*COLUMNS)), F.lit("x"), F.hex(F.monotonically_increasing_id())))
    members = {"focusNode": "focus", "resultPath": "path", "value": "value", "sourceConstraintComponent": "component", "sourceShape": "source_shape", "resultSeverity": "severity"}
    pairs = [F.struct(F.lit(TYPE).alias("p"), F.lit(sh("ValidationResult")).alias("o"))]
    pairs += [F.struct(F.lit(sh(name)).alias("p"), F.col(c).alias("o")) for name, c in members.items()]
    pairs.append(F.struct(F.lit(sh("resultMessage")).alias("p"), make_literal(F.col("message")).alias("o")))
    own = named.select(F.col("r").alias("s"), F.explode(F.array(F.struct(F.lit(None).cast("string").alias("p"), F.col("r").alias("o")), *pairs)).alias("x")).select("s", "x.p", "x.o")
    links = own.where("p is null").select(F.lit(root).alias("s"), F.lit(sh("result")).alias("p"), "o")
    return head.unionByName(own.where("p is not null and o is not null")).unionByName(links)
