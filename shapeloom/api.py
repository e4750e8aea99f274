"""Validation of graphs: texts or files of shapes and data, graph modes, severities, deltas and gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.operators import report
from shapeloom.plans.shapes import Schema, lower
from shapeloom.sources import formats
from shapeloom.sources.terms import SH, Graph
from shapeloom.sources.triples import TripleTable


def load(source) -> Graph:
    """A graph from a text, a file path or address, a Graph, or a list of these (united)."""
    if isinstance(source, Graph):
        return source
    if isinstance(source, list | tuple):
        out = Graph()
        for x in source:
            out = out.union(load(x))
        return out
    text = source.decode() if isinstance(source, bytes) else str(source)
    is_name = "\n" not in text and (text.startswith(("http://", "https://")) or text.rsplit(".", 1)[-1].lower() in formats.EXTENSIONS)
    return formats.read(text) if is_name else formats.parse(text)


@dataclass
class Result:
    conforms: bool
    rows: DataFrame
    diagnostics: list[str]

    def graph(self) -> TripleTable:
        """The report as triples."""
        return TripleTable(report.report_graph(self.rows, self.conforms))


class Validator:
    """Shapes that are lowered once and applied to many data graphs."""

    def __init__(self, spark: SparkSession, shapes):
        self.spark, self.graph = spark, load(shapes)
        self.schema: Schema = lower(self.graph)

    def validate(self, data, mode: str = "union", minimum: str = "Info", shapes: list[str] | None = None) -> Result:
        """``data``: foci and evaluation over the data graph; ``union``: foci from the data, evaluation over both
        graphs; ``union-all``: both over both.  ``shapes``: only the targets of these."""
        table = data if hasattr(data, "scan") else TripleTable.of(self.spark, load(data))
        source = table if mode == "data" else table.union(TripleTable.of(self.spark, self.graph))
        rows = report.validate_rows(source, self.schema, table if mode == "union" else None, shapes)
        return Result(report.conforms(rows, f"<{SH}{minimum}>"), rows, self.schema.diagnostics)


def infer(spark: SparkSession, data, shapes=None) -> TripleTable:
    """The triples that the rules of the shapes graph add to the data."""
    from shapeloom.operators.infer import infer as run
    from shapeloom.operators.infer import lower_rules

    graph = load(shapes if shapes is not None else data)
    schema = lower(graph)
    table = data if hasattr(data, "scan") else TripleTable.of(spark, load(data).union(graph))
    return TripleTable(run(table, lower_rules(graph, schema), schema))


def evaluate(spark: SparkSession, expression: str, shapes=None) -> str | None:
    """The term that a SPARQL expression over no data gives; declared functions of ``shapes`` may be called."""
    from shapeloom.operators import sparql
    from shapeloom.plans.functions import functions_of

    graph = load(shapes) if shapes is not None else Graph()
    empty = TripleTable(spark.createDataFrame([], "s string, p string, o string"))
    return sparql.select(empty, f"SELECT ({expression} AS ?result) {{}}", dict(graph.prefixes), functions=functions_of(graph)).first()[0]


def validate(spark: SparkSession, data, shapes=None, **options) -> Result:
    """Validate ``data`` against ``shapes``, or against the shapes that it holds itself."""
    return Validator(spark, shapes if shapes is not None else data).validate(data, **options)


def apply_delta(graph: TripleTable, add: TripleTable, delete: TripleTable) -> TripleTable:
    return graph.minus(delete).union(add)


def gate(before: DataFrame, after: DataFrame) -> DataFrame:
    """(focus, source_shape, status): fixed, introduced or remaining between two sets of results."""
    key = ["focus", "source_shape"]
    a, b = before.select(*key).distinct().withColumn("_a", F.lit(True)), after.select(*key).distinct().withColumn("_b", F.lit(True))
    status = F.when(F.col("_b").isNull(), "fixed").when(F.col("_a").isNull(), "introduced").otherwise("remaining")
    return a.join(b, key, "full").select(*key, status.alias("status"))
