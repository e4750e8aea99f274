"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words.  Each of its documents then has the expected number
of copies ``target / source size``; its fraction is rounded so that the source's words stay in
sum: two documents with fractional copies play against each other, mass moves from one to the
other until one of them is integral, and the expected value of each stays what it was.  Words,
not documents, are what a move keeps constant (the masses are weighted by document size).

The rounding runs in buckets of a fixed number of documents; what is left of a bucket, one
fractional document at most, goes up a reduction tree whose nodes combine ``FAN_IN`` residuals.
A source that holds a third of all rows is thus many buckets.  Only the last residual of a
source is rounded alone, so that a source misses its target by less than one document.

Defined results: a null text has size 0; a null source is a source of its own and comes last; a
source of size 0 has target 0; repeated rows and equal doc_ids are rounded one by one; an empty
table gives an empty result.  Nothing depends on the partitioning of the input: buckets and
random numbers are hashes of doc_id, size and text.  Only rows that agree in all of these are
interchangeable.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapeloom.llm.common import discard, materialize, text_of, tune, words_of

BUCKET_ROWS = 4096
FAN_IN = 16
#: Up to so many sources the per-source table is broadcast (about 100 bytes a row).
BROADCAST_SOURCES = 50_000


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank``: place by code point, null last, from 0; sorted in ranges, so that no task has them all."""
    order = F.col("source").asc_nulls_last()
    parts = materialize(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("_id", 33)
    counts = sorted((r["k"], r["n"]) for r in parts.groupBy(part.alias("k")).agg(F.count("*").alias("n")).collect())  # one row a partition
    before, bases = 0, []
    for k, n in counts:
        bases.append((k, before - (k << 33)))
        before += n
    base = sources.sparkSession.createDataFrame(bases, "k long, base long")
    return parts.join(F.broadcast(base), part == base.k).withColumn("rank", F.col("_id") + F.col("base")).drop("_id", "k", "base")


def targets_of(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``sources`` (source, size, ...) with ``target``: ``share`` of all sizes by weight; none over ``cap`` times its size.

    Shares of sources that are full go to the others by weight.  A source is full if its size for
    each unit of weight is below a bound, so that a pass needs two sums, and few passes are needed.
    """
    of = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = materialize(ranked(sources).withColumn("weight", of), "sources")
    total, unit = share * int(table.agg(F.sum("size")).first()[0] or 0), 0.0
    while True:
        full = F.col("weight") * unit > cap * F.col("size")
        taken, open_ = table.agg(F.sum(F.when(full, F.col("size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_:
            unit = math.inf
            break
        now = max(0.0, total - cap * int(taken or 0)) / open_
        if now <= unit:
            break
        unit = now
    most = cap * F.col("size")
    return table.withColumn("target", F.least(F.col("weight") * unit, most) if unit < math.inf else most).drop("rank", "weight")


def _draw(seed: int, a: tuple, b: tuple) -> float:
    return xxhash.xxh64_intdigest(f"{a[2]}:{a[3]}:{a[4]}|{b[2]}:{b[3]}:{b[4]}", seed) / 2.0**64


def duel(a: float, p: float, b: float, q: float, u: float) -> tuple[float, float]:
    """Move mass between two fractions of weights a and b; a * p + b * q stays, one gets integral."""
    up, down = min(1 - p, q * b / a), min(p, (1 - q) * b / a)
    if u * (up + down) < down:
        return (1.0, q - (1 - p) * a / b) if up == 1 - p else (p + up, 0.0)
    return (0.0, q + p * a / b) if down == p else (p - down, 1.0)


_EPS = 1e-9
_KEYS = ["source", "doc_id", "size", "h"]
_ROW = ["source", "bucket", "doc_id", "size", "h", "copies", "p"]
_OUT = "source string, bucket long, doc_id long, size long, h long, copies long, p double, open boolean"


def _rounder(seed: int):
    """Rows sorted by (source, bucket): all but one fractional row of a bucket get their copies."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None  # held: values of _ROW

        def close(row, out):
            if row is not None:
                out.append((*row, True))

        for frame in frames:
            out: list[tuple] = []
            for r in frame.itertuples(index=False, name=None):
                row = [None if x is pd.NA or (isinstance(x, float) and math.isnan(x)) else x for x in r]
                row[2:6] = [None if x is None else int(x) for x in row[2:6]]
                if (row[0], row[1]) != key:
                    close(held, out)
                    key, held = (row[0], row[1]), None
                if row[3] == 0 and _EPS < row[6] < 1 - _EPS:  # carries no words: alone
                    row[5] += _draw(seed, row, row) < row[6]
                    row[6] = 0.0
                if held is not None and _EPS < row[6] < 1 - _EPS:
                    held[6], row[6] = duel(held[3], held[6], row[3], row[6], _draw(seed, held, row))
                    if not _EPS < held[6] < 1 - _EPS:
                        held[5] += round(held[6])
                        out.append((*held[:6], 0.0, False))
                        held = None
                if _EPS < row[6] < 1 - _EPS:
                    if held is not None:  # both still fractional only by rounding errors
                        close(held, out)
                    held = row
                else:
                    row[5] += round(row[6])
                    out.append((*row[:6], 0.0, False))
            yield _frame(out)
        out = []
        close(held, out)
        yield _frame(out)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=[*_ROW, "open"])
    return df.astype({c: "Int64" for c in ("bucket", "doc_id", "size", "h", "copies")} | {"p": "float64", "open": "boolean"})


def _level(rows: DataFrame, seed: int) -> DataFrame:
    dealt = rows.select(*_ROW).repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.desc("size"), "doc_id", "h", "copies", "p")
    return materialize(dealt.mapInPandas(_rounder(seed), _OUT), "mix")


def assign_copies(
    docs: DataFrame,
    size: Column,
    share: float = 1.5,
    weights: Sequence[float] = (3, 1, 2),
    cap: float = 2.0,
    seed: int = 7,
    bucket_rows: int = BUCKET_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """doc_id, size, h (hash of the text), source, source_size, target and copies of each row of ``docs``.

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` times all
    sizes; a target stops at ``cap`` times its source's size.
    """
    spark = docs.sparkSession
    tune(spark)
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), size.cast("long").alias("size"), text_hash().alias("h")), "sizes")
    sources = targets_of(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), weights, share, cap)
    times = F.coalesce(F.try_divide("target", "size"), F.lit(0.0))
    plan = materialize(
        sources.select(
            F.col("source").alias("name"),
            F.col("size").alias("source_size"),
            "target",
            F.floor(times).alias("copies"),
            (times - F.floor(times)).alias("p"),
            F.ceil(F.col("n") / bucket_rows).alias("buckets"),
        ),
        "plan",
    )
    count, width = plan.agg(F.count("*"), F.max("buckets")).first()
    table = F.broadcast(plan) if count <= BROADCAST_SOURCES else plan
    by_source = F.col("source").eqNullSafe(F.col("name"))
    bucket = F.pmod(F.xxhash64("doc_id", "size", "h"), F.col("buckets"))
    level = _level(sized.join(table, by_source).withColumn("bucket", bucket), seed)
    levels, width = [level], width or 1
    while width > 1:
        width = -(-width // fan_in)
        up = level.where("open").withColumn("bucket", F.floor(F.col("bucket") / fan_in))
        level = _level(up, seed + len(levels))
        levels.append(level)
    done = [x.where("not open").select(*_KEYS, "copies") for x in levels]
    alone = F.pmod(F.xxhash64(*_KEYS, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    last = level.where("open").select(*_KEYS, (F.col("copies") + (alone < F.col("p")).cast("long")).alias("copies"))
    out = last
    for x in done:
        out = out.unionByName(x)
    discard(sized)
    return out.join(table.select("name", "source_size", "target"), by_source).drop("name")


def text_size() -> Column:
    return F.size(words_of(text_of())).cast("long")


def text_hash() -> Column:
    return F.xxhash64(text_of())


def repeated(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as decided.

    Decisions are matched by doc_id, source, size and text hash; rows that share all four have
    theirs dealt out one by one.
    """
    order = Window.partitionBy(*_KEYS)
    left = docs.withColumn("size", text_size()).withColumn("h", text_hash()).withColumn("_k", F.row_number().over(order.orderBy("h")))
    right = copies.select(*_KEYS, "copies").withColumn("_k", F.row_number().over(order.orderBy(F.desc("copies")))).where("copies > 0")
    on = F.expr("l.doc_id <=> r.doc_id and l.source <=> r.source and l.size = r.size and l.h = r.h and l._k = r._k")
    joined = left.alias("l").join(right.alias("r"), on)
    return joined.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("r.copies").cast("int")))).select(*[F.col(f"l.{c}") for c in docs.columns])
