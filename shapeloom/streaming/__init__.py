"""Continuous validation: shapes over a stream of triples, batch by batch.

An extension over batch engines of this kind: every micro-batch of (s, p, o) rows is validated
by itself and its results are handed to a sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from shapeloom.operators.report import validate_rows
from shapeloom.plans.shapes import Schema
from shapeloom.sources.triples import TripleTable


def validate_stream(stream: DataFrame, schema: Schema, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that passes the results of each micro-batch, and its number, to ``sink``."""

    def batch(df: DataFrame, number: int) -> None:
        sink(validate_rows(TripleTable(df.distinct()), schema), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
