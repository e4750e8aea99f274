"""``reach``: a path as a DataFrame of distinct (v, u) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeloom.plans.paths import Alt, Id, Inv, Opt, Path, Plus, Pred, Seq, Star, normalize
from shapeloom.sources.storage import materialize


def pairs(df: DataFrame, v: str, u: str) -> DataFrame:
    return df.select(F.col(v).alias("v"), F.col(u).alias("u"))


def reach(source, path: Path, domain: DataFrame | None = None) -> DataFrame:
    """(v, u): u is reached from v.  ``domain`` (v) holds the possible starts; where it matters only, all nodes by default.

    Pairs from outside the domain may be among the result; whoever has foci joins with them anyway.
    """
    return _reach(source, normalize(path), domain)


def _reach(source, p: Path, domain: DataFrame | None) -> DataFrame:
    if isinstance(p, Id):
        starts = source.nodes() if domain is None else domain
        return starts.select("v", F.col("v").alias("u"))
    if isinstance(p, Pred):
        return pairs(source.scan(p.iri), "s", "o")
    if isinstance(p, Inv):
        return pairs(_reach(source, p.path, None), "u", "v")
    if isinstance(p, Seq):
        out, starts = None, domain
        for part in p.parts:
            step = _reach(source, part, starts)
            if out is None:
                out = step
            else:
                out = pairs(out.alias("l").join(step.alias("r"), F.col("l.u") == F.col("r.v")).select(F.col("l.v").alias("a"), F.col("r.u").alias("b")), "a", "b").distinct()
            starts = out.select(F.col("u").alias("v")).distinct()
        return out
    if isinstance(p, Alt):
        out = None
        for part in p.parts:
            step = _reach(source, part, domain)
            out = step if out is None else out.unionByName(step)
        return out.distinct() if out is not None else source.spark.createDataFrame([], "v string, u string")
    step = _reach(source, p.path, None)
    if isinstance(p, Opt):
        return step.unionByName(_reach(source, Id(), domain)).distinct()
    closed = remembered(source, p.path, step)
    if isinstance(p, Plus):
        return closed
    assert isinstance(p, Star)
    return closed.unionByName(_reach(source, Id(), domain)).distinct()


def remembered(source, path: Path, step: DataFrame) -> DataFrame:
    """The closure of a path over a source, computed once; sources do not change."""
    memo = vars(source).setdefault("_closures", {})
    if path not in memo:
        memo[path] = closure(step)
    return memo[path]


def ends(step: DataFrame, start: str) -> DataFrame:
    """(v): the nodes that lead from ``start`` along (v, u) pairs, itself included; a frontier walks from there."""
    edges = [(r["v"], r["u"]) for r in step.limit(SMALL_EDGES + 1).collect()]
    if len(edges) <= SMALL_EDGES:
        follow: dict[str, list[str]] = {}
        for v, u in edges:
            follow.setdefault(v, []).append(u)
        seen, todo = {start}, [start]
        while todo:
            new = [u for u in follow.get(todo.pop(), ()) if u not in seen]
            seen.update(new)
            todo += new
        return step.sparkSession.createDataFrame([(v,) for v in sorted(seen)], "v string")
    seen = front = materialize(step.sparkSession.createDataFrame([(start,)], "v string"))
    while True:
        after = step.join(front, "v", "left_semi").select(F.col("u").alias("v")).distinct()
        front = materialize(after.join(seen, "v", "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


#: Up to so many edges, and pairs of their closure, a closure is computed on the driver (class hierarchies); beyond, by joins.
SMALL_EDGES, SMALL_PAIRS = 5_000, 200_000


def closure(step: DataFrame) -> DataFrame:
    """Transitive closure.

    Small step relations, whose size is checked first, are closed on the driver.  Others double their
    paths in every round, so that the number of rounds is the logarithm of the longest path.
    """
    edges = [(r["v"], r["u"]) for r in step.limit(SMALL_EDGES + 1).collect()]
    if len(edges) <= SMALL_EDGES and (found := _close(edges)) is not None:
        return step.sparkSession.createDataFrame(found, "v string, u string")
    now = materialize(step.distinct())
    count = now.count()
    while True:
        longer = now.alias("l").join(now.alias("r"), F.col("l.u") == F.col("r.v")).select(F.col("l.v").alias("v"), F.col("r.u").alias("u"))
        grown = materialize(now.unionByName(longer).distinct())
        more = grown.count()
        if more == count:
            return grown
        now, count = grown, more


def _close(edges: list[tuple[str, str]]) -> list[tuple[str, str]] | None:
    """The closure of a few edges; None if it has over SMALL_PAIRS pairs."""
    follow: dict[str, list[str]] = {}
    for v, u in edges:
        follow.setdefault(v, []).append(u)
    out: list[tuple[str, str]] = []
    for v in follow:
        seen, todo = set(), [v]
        while todo:
            for u in follow.get(todo.pop(), ()):
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        out += [(v, u) for u in seen]
        if len(out) > SMALL_PAIRS:
            return None
    return out
