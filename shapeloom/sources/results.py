"""SPARQL query results as JSON, one binding for each row, made on the executors."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.functions import terms as T
from shapeloom.sources.terms import RDF, XSD


def binding(t: Column) -> Column:
    """A term as a struct of type, value, datatype and language; null for an unbound variable."""
    kind = T.datatype(t)
    plain = kind.isin(XSD + "string", RDF + "langString")
    tag = F.nullif(T.lang(t), F.lit(""))
    return F.when(
        t.isNotNull(),
        F.struct(
            F.when(T.is_iri(t), "uri").when(T.is_blank(t), "bnode").otherwise("literal").alias("type"),
            F.when(T.is_iri(t), F.substring(t, F.lit(2), F.length(t) - 2)).when(T.is_blank(t), F.substring(t, F.lit(3), F.length(t))).otherwise(T.lex(t)).alias("value"),
            F.when(T.is_literal(t) & ~plain, kind).alias("datatype"),
            F.when(T.is_literal(t), tag).alias("xml:lang"),
        ),
    )


def json_rows(rows: DataFrame) -> DataFrame:
    """One JSON object (value) for each row; unbound variables are left out."""
    return rows.select(F.to_json(F.struct(*[binding(F.col(n)).alias(n) for n in rows.columns])).alias("value"))


def results_json(found: DataFrame | bool) -> Iterator[str]:
    """Pieces of a results document: of a SELECT, streamed row by row, or of an ASK."""
    if isinstance(found, bool):
        yield json.dumps({"head": {}, "boolean": found})
        return
    yield json.dumps({"head": {"vars": found.columns}})[:-1] + ', "results": {"bindings": ['
    first = True
    for r in json_rows(found).toLocalIterator():
        yield r.value if first else ", " + r.value
        first = False
    yield "]}}"
