"""SPARQL algebra to DataFrames: a column per variable, null where it is unbound.

``bound`` names the variables that every row has; joins on these are plain equi-joins, others
compare with nulls as wildcards.  Pre-bound variables (``$this``) are a DataFrame that the
outer group starts from, so that a query runs once for all foci.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapeloom.functions import terms as T
from shapeloom.operators.paths import closure, reach
from shapeloom.plans import sparql as Q
from shapeloom.plans.paths import Alt, Inv, Opt, Path, Plus, Pred, Seq, Star
from shapeloom.sources.terms import RDF, XSD


@dataclass
class Rows:
    df: DataFrame
    bound: set[str]

    @property
    def names(self) -> list[str]:
        return self.df.columns


class Unsupported(ValueError):
    pass


TRUE, FALSE = f'"true"^^<{XSD}boolean>', f'"false"^^<{XSD}boolean>'
ZERO = f'"0"^^<{XSD}integer>'


class Engine:
    def __init__(self, source, graphs: dict | None = None, prebound: Rows | None = None):
        self.source, self.spark, self.graphs, self.prebound = source, source.spark, graphs or {}, prebound

    # ------------------------------------------------------------ patterns

    def unit(self) -> Rows:
        return Rows(self.spark.range(1).select(F.lit(1).alias("_unit")).drop("_unit"), set())

    def join(self, a: Rows | None, b: Rows, how: str = "inner", extra=None) -> Rows:
        if a is None:
            return b
        shared = [n for n in a.names if n in b.names]
        loose = next((n for n in shared if n not in a.bound or n not in b.bound), None)
        if loose is not None and how == "inner" and extra is None and len(shared) > 1:
            return self._join_loose(a, b, loose)
        on, left, right = None, a.df.alias("l"), b.df.alias("r")
        for n in shared:
            same = F.col(f"l.{n}") == F.col(f"r.{n}")
            if n not in a.bound:
                same = same | F.col(f"l.{n}").isNull()
            if n not in b.bound:
                same = same | F.col(f"r.{n}").isNull()
            on = same if on is None else on & same
        columns = [F.coalesce(F.col(f"l.{n}"), F.col(f"r.{n}")).alias(n) if n in shared and n not in a.bound else F.col(f"l.{n}").alias(n) for n in a.names]
        columns += [F.col(f"r.{n}").alias(n) for n in b.names if n not in shared]
        if extra is not None:
            scope = {n: (F.coalesce(F.col(f"l.{n}"), F.col(f"r.{n}")) if n in shared else F.col(f"l.{n}" if n in a.names else f"r.{n}")) for n in [*a.names, *b.names]}
            cond = self.ebv(extra, scope)
            on = cond if on is None else on & cond
        joined = left.join(right, on, how) if on is not None else left.join(right, F.lit(True), how) if how != "inner" else left.crossJoin(right)
        return Rows(joined.select(*columns), a.bound | (b.bound if how == "inner" else set()))

    def _join_loose(self, a: Rows, b: Rows, n: str) -> Rows:
        """A join on a variable that may be unbound: rows that have it meet by equality, others by the rest."""
        has, lacks, out = (lambda x: x.df.where(F.col(n).isNotNull())), (lambda x: x.df.where(F.col(n).isNull())), []
        free = lambda x: Rows(lacks(x).drop(n), x.bound)
        out.append(self.join(Rows(has(a), a.bound | {n}), Rows(has(b), b.bound | {n})))
        if n not in a.bound:
            out.append(self.join(free(a), b))
        if n not in b.bound:
            out.append(self.join(Rows(has(a), a.bound | {n}), free(b)))
        names = [*a.names, *(x for x in b.names if x not in a.names)]
        return Rows(reduce(lambda x, y: x.unionByName(y), [r.df.select(*names) for r in out]), a.bound | b.bound)

    def group(self, g: Q.Group, start: Rows | None = None) -> Rows:
        out, filters = start, []
        for part in g.parts:
            if isinstance(part, Q.Filter_):
                filters.append(part.expr)
            elif isinstance(part, Q.Bgp):
                out = self.bgp(part.triples, out)
            elif isinstance(part, Q.Optional_):
                inner = Q.Group([x for x in part.group.parts if not isinstance(x, Q.Filter_)])
                conds = [x.expr for x in part.group.parts if isinstance(x, Q.Filter_)]
                extra = reduce(lambda x, y: Q.Call("&&", [x, y]), conds) if conds else None
                out = self.join(out or self.unit(), self.group(inner), "left", extra)
            elif isinstance(part, Q.Lateral_):
                out = self.lateral(out or self.unit(), part.group)
            elif isinstance(part, Q.Union_):
                out = self.join(out, self.union([self.group(x) for x in part.groups]))
            elif isinstance(part, Q.Minus_):
                out = self.minus(out or self.unit(), self.group(part.group))
            elif isinstance(part, Q.Bind_):
                out = self.extend(out or self.unit(), part.var, part.expr)
            elif isinstance(part, Q.Values_):
                out = self.join(out, self.values(part))
            elif isinstance(part, Q.Graph_):
                out = self.join(out, self.named(part))
            elif isinstance(part, Q.Query):
                out = self.join(out, self.select(part))
            else:
                out = self.join(out, self.group(part))
        out = out or self.unit()
        for e in filters:
            out = self.filter(out, e)
        return out

    def named(self, part: Q.Graph_) -> Rows:
        """GRAPH: over the graph of that name, or over each, whose name is then the variable's value."""
        if isinstance(part.name, str):
            if part.name not in self.graphs:
                raise Unsupported(f"no graph is named {part.name}")
            return Engine(self.graphs[part.name], self.graphs).group(part.group)
        each = []
        for name in self.graphs:
            rows = Engine(self.graphs[name], self.graphs).group(part.group)
            if part.name.name in rows.names:
                each.append(Rows(rows.df.where(F.col(part.name.name) == name), rows.bound))
            else:
                each.append(Rows(rows.df.withColumn(part.name.name, F.lit(name)), rows.bound | {part.name.name}))
        if each:
            return self.union(each)
        names = sorted(Q.variables(part.group) | {part.name.name})
        return Rows(self.spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names)), set())

    def lateral(self, a: Rows, g: Q.Group) -> Rows:
        """The pattern for each row: it starts from the distinct bindings that it shares with the rows."""
        shared = [n for n in a.names if n in Q.variables(g) or any(isinstance(x, Q.Query) for x in g.parts)]
        start = Rows(a.df.select(*shared).distinct(), a.bound & set(shared)) if shared else None
        if len(g.parts) == 1 and isinstance(g.parts[0], Q.Query):
            inner = self.select(g.parts[0], start)
        else:
            inner = self.group(g, start)
        if not shared:
            return self.join(a, inner)
        on = reduce(lambda x, y: x & y, [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in shared])
        new = [n for n in inner.names if n not in a.names]
        df = a.df.alias("l").join(inner.df.alias("r"), on).select(*[F.col(f"l.{n}") for n in a.names], *[F.col(f"r.{n}") for n in new])
        return Rows(df, a.bound | (inner.bound & set(new)))

    def union(self, parts: list[Rows]) -> Rows:
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.df for p in parts])
        return Rows(df, set.intersection(*(p.bound for p in parts)))

    def minus(self, a: Rows, b: Rows) -> Rows:
        shared = [n for n in a.names if n in b.names]
        if not shared:
            return a
        match, some = F.lit(True), F.lit(False)
        for n in shared:
            x, y = F.col(f"l.{n}"), F.col(f"r.{n}")
            both = n in a.bound and n in b.bound
            match = match & ((x == y) if both else (x == y) | x.isNull() | y.isNull())
            some = some | (F.lit(True) if both else x.isNotNull() & y.isNotNull())
        return Rows(a.df.alias("l").join(b.df.alias("r"), match & some, "left_anti"), a.bound)

    def values(self, v: Q.Values_) -> Rows:
        df = self.spark.createDataFrame([tuple(r) for r in v.rows], ", ".join(f"`{n}` string" for n in v.names))
        return Rows(df, {n for k, n in enumerate(v.names) if all(r[k] is not None for r in v.rows)})

    def flat(self, a: Rows, e):
        """Arguments of calls become columns of their own, so that no expression is repeated inside another."""
        if not isinstance(e, Q.Call) or e.name in Q.AGGREGATES:
            return a, e
        args = []
        for x in e.args:
            a, x = self.flat(a, x)
            if isinstance(x, Q.Call) and x.name not in _BOOLEAN | {"IN", "NOT IN"} | Q.AGGREGATES:
                self.temps = getattr(self, "temps", 0) + 1
                name = f"_t{self.temps}"
                a = Rows(a.df.withColumn(name, self.term(x, scope(a))), a.bound)
                x = Q.Var(name)
            args.append(x)
        return a, Q.Call(e.name, args, e.distinct, e.separator)

    def with_exists(self, a: Rows, e):
        """EXISTS inside an expression: a column of its own, true or false for each row."""
        if isinstance(e, Q.Exists):
            self.temps = getattr(self, "temps", 0) + 1
            name, plain = f"_t{self.temps}", a.names
            hits = self.filter(Rows(a.df.select(*plain).distinct(), a.bound), Q.Exists(e.group, True)).df
            on = reduce(lambda x, y: x & y, [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in plain], F.lit(True))
            flag = F.when(F.col("r._hit"), F.lit(TRUE if e.positive else FALSE)).otherwise(FALSE if e.positive else TRUE)
            df = a.df.alias("l").join(hits.withColumn("_hit", F.lit(True)).alias("r"), on, "left").select(*[F.col(f"l.{n}") for n in plain], flag.alias(name))
            return Rows(df, a.bound | {name}), Q.Var(name)
        if isinstance(e, Q.Call):
            args = []
            for x in e.args:
                a, x = self.with_exists(a, x)
                args.append(x)
            return a, Q.Call(e.name, args, e.distinct, e.separator)
        return a, e

    def extend(self, a: Rows, name: str, e) -> Rows:
        if name in a.names:
            raise Q.SparqlError(f"?{name} is bound already")
        b, e = self.with_exists(a, e)
        b, e = self.flat(b, e)
        df = b.df.withColumn(name, self.term(e, scope(b))).select(*a.names, name)
        return Rows(df, a.bound | ({name} if isinstance(e, str) else set()))

    def filter(self, a: Rows, e) -> Rows:
        if isinstance(e, Q.Call) and e.name == "&&":
            return self.filter(self.filter(a, e.args[0]), e.args[1])
        if isinstance(e, Q.Call) and e.name == "!" and isinstance(e.args[0], Q.Exists):
            e = Q.Exists(e.args[0].group, not e.args[0].positive)
        if isinstance(e, Q.Exists):
            shared = [n for n in a.names if n in Q.variables(e.group)]
            loose = [n for n in shared if n not in a.bound]
            # the row's values reach into the pattern's own filters: it starts from the distinct bindings
            start = Rows(a.df.select(*shared).distinct(), a.bound & set(shared)) if shared else None
            inner = self.group(e.group, start)
            if not shared:
                hit = not inner.df.isEmpty()
                return a if hit == e.positive else Rows(a.df.where(F.lit(False)), a.bound)
            found = inner.df.select(*shared).distinct()
            on = reduce(lambda x, y: x & y, [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) if n in loose else F.col(f"l.{n}") == F.col(f"r.{n}") for n in shared])
            return Rows(a.df.alias("l").join(found.alias("r"), on, "left_semi" if e.positive else "left_anti"), a.bound)
        b, e = self.with_exists(a, e)
        b, e = self.flat(b, e)
        return Rows(b.df.where(self.ebv(e, scope(b))).select(*a.names), a.bound)

    # ------------------------------------------------------------ triples and paths

    def bgp(self, triples: list[Q.Triple], start: Rows | None) -> Rows:
        """Patterns joined so that each shares a variable with what is there, constants first."""
        left = list(triples)
        out = start
        while left:
            known = set(out.names) if out else set()
            weight = lambda t: (not (Q.variables(t) & known) if known else False, isinstance(t.p, Path), -sum(isinstance(x, str) for x in (t.s, t.o)))
            t = min(left, key=weight)
            left.remove(t)
            rows = self.pattern(t.s, t.p, t.o, out)
            out = self.join(out, rows)
        return out or self.unit()

    def pattern(self, s, p, o, known: Rows | None = None) -> Rows:
        if isinstance(p, str):
            return self.bind(self.source.match(s if isinstance(s, str) else None, p, o if isinstance(o, str) else None).select("s", "o"), {"s": s, "o": o})
        if isinstance(p, Q.Var):
            return self.bind(self.source.all(), {"s": s, "p": p, "o": o})
        if isinstance(p, Pred):
            return self.pattern(s, p.iri, o)
        if isinstance(p, Inv):
            return self.pattern(o, p.path, s, known)
        if isinstance(p, Seq):
            middle = [Q.Var(f"_p{id(p)}_{k}") for k in range(len(p.parts) - 1)]
            ends, out = [s, *middle, o], None
            for k, part in enumerate(p.parts):
                out = self.join(out, self.pattern(ends[k], part, ends[k + 1]))
            return Rows(out.df.drop(*[m.name for m in middle]), out.bound - {m.name for m in middle})
        if isinstance(p, Alt):
            return self.union([self.pattern(s, part, o) for part in p.parts])
        if isinstance(p, Q.NotIn):
            all_ = self.source.all()
            out = []
            if p.forward or not p.inverse:
                out.append(self.bind(all_.where(~F.col("p").isin(list(p.forward))), {"s": s, "o": o}))
            if p.inverse:
                out.append(self.bind(all_.where(~F.col("p").isin(list(p.inverse))), {"s": o, "o": s}))
            return self.union(out)
        if isinstance(p, Star | Plus | Opt):
            starts = self._domain(s, o, known)
            step = self.pattern(Q.Var("v"), p.path, Q.Var("u")).df.select("v", "u").distinct() if _has_negation(p.path) else reach(self.source, p.path)
            found = step if isinstance(p, Opt) else closure(step)
            if not isinstance(p, Plus):
                found = found.unionByName(starts.select("v", F.col("v").alias("u"))).distinct()
            return self.bind(found.select(F.col("v").alias("s"), F.col("u").alias("o")), {"s": s, "o": o})
        raise Unsupported(f"path {p}")

    def _domain(self, s, o, known: Rows | None) -> DataFrame:
        """Nodes of zero-length paths: the constant or known end, else all nodes."""
        for x in (s, o):
            if isinstance(x, str):
                return self.spark.createDataFrame([(x,)], "v string")
            if known is not None and isinstance(x, Q.Var) and x.name in known.bound:
                return known.df.select(F.col(x.name).alias("v")).distinct()
        return self.source.nodes()

    def bind(self, df: DataFrame, ends: dict) -> Rows:
        columns: dict[str, Column] = {}
        for c, x in ends.items():
            if isinstance(x, str):
                df = df.where(F.col(c) == x)
            elif x.name in columns:
                df = df.where(F.col(c) == columns[x.name])
            else:
                columns[x.name] = F.col(c)
        return Rows(df.select(*[c.alias(n) for n, c in columns.items()]), set(columns))

    # ------------------------------------------------------------ query forms

    def select(self, q: Q.Query, start: Rows | None = None) -> Rows:
        rows = self.group(q.where, start)
        calls = [a for _, e in q.items if e is not None for a in Q.aggregates(e)] + [a for e in q.having for a in Q.aggregates(e)] + [a for e, _ in q.order_by for a in Q.aggregates(e)]
        extra = list(start.names) if start is not None else []
        if calls or q.group_by:
            rows, table = self.aggregate(rows, q, calls, extra, start)
        else:
            table = []
        swap = lambda e: _replace(e, table)
        for e in q.having:
            rows = self.filter(rows, swap(e))
        names = []
        for name, e in q.items:
            if e is not None:
                rows = self.extend(rows, name, swap(e))
            elif name not in rows.names:
                rows = Rows(rows.df.withColumn(name, F.lit(None).cast("string")), rows.bound)
            names.append(name)
        names = names or [n for n in rows.names if not n.startswith("_")]
        keep = [n for n in extra if n not in names] + names
        df = rows.df
        if q.order_by:
            order = []
            for e, down in q.order_by:
                for c in order_key(self.term(swap(e), scope(rows))):
                    order.append(c.desc_nulls_last() if down else c.asc_nulls_first())
        if q.distinct:
            df = df.select(*keep).distinct()
        if extra and (q.limit is not None or q.offset):
            w = Window.partitionBy(*extra).orderBy(*(order if q.order_by else [F.lit(0)]))
            n = F.col("_n") > q.offset
            df = df.withColumn("_n", F.row_number().over(w)).where(n if q.limit is None else n & (F.col("_n") <= q.offset + q.limit))
        else:
            df = df.orderBy(*order) if q.order_by else df
            df = df.offset(q.offset) if q.offset else df
            df = df.limit(q.limit) if q.limit is not None else df
        return Rows(df.select(*keep), rows.bound & set(keep))

    def aggregate(self, rows: Rows, q: Q.Query, calls: list[Q.Call], extra: list[str], start: Rows | None = None) -> tuple[Rows, list]:
        keys = list(extra)
        for name, e in q.group_by:
            if e is not None:
                rows = self.extend(rows, name, e)
            if name not in keys:
                keys.append(name)
        table, columns = [], []
        for call in calls:
            if any(c is call for c, _ in table):
                continue
            name = f"_a{len(table)}"
            if call.args and not isinstance(call.args[0], str | Q.Var):
                rows = self.extend(rows, f"_x{len(table)}", call.args[0])
                argument = Q.Call(call.name, [Q.Var(f"_x{len(table)}")], call.distinct, call.separator)
            else:
                argument = call
            columns.append(self.aggregator(argument, scope(rows)).alias(name))
            table.append((call, name))
        grouped = rows.df.groupBy(*keys).agg(*columns) if columns else rows.df.select(*keys).distinct()
        if start is not None and not q.group_by:
            # Without GROUP BY there is one group, even of no solutions: for every start.
            empty = {"COUNT": F.lit(ZERO), "SUM": F.lit(ZERO), "AVG": F.lit(ZERO), "GROUP_CONCAT": F.lit('""')}
            filled = [F.coalesce(F.col(name), empty[call.name]).alias(name) if call.name in empty else F.col(name) for call, name in table]
            grouped = start.df.select(*extra).distinct().join(grouped, extra, "left").select(*extra, *filled)
        return Rows(grouped, rows.bound & set(keys)), table

    def aggregator(self, call: Q.Call, s: dict) -> Column:
        if call.name == "COUNT":
            if not call.args:
                n = F.count("*") if not call.distinct else F.count_distinct(F.struct(*s.values()))
            else:
                t = self.term(call.args[0], s)
                n = F.count_distinct(t) if call.distinct else F.count(t)
            return T.make_literal(n.cast("string"), "integer")
        t = self.term(call.args[0], s)
        if call.name == "SAMPLE":
            return F.min(t)
        if call.name == "GROUP_CONCAT":
            items = F.collect_set(T.lex(t)) if call.distinct else F.collect_list(T.lex(t))
            return T.make_literal(F.array_join(F.array_sort(items), call.separator))
        if call.name in ("MIN", "MAX"):
            key = F.struct(*order_key(t))
            return (F.min_by if call.name == "MIN" else F.max_by)(t, F.when(t.isNotNull(), key))
        exact, dbl = T.exact(t), T.floating(t)
        if call.distinct:
            total = F.aggregate(F.collect_set(exact), F.lit(0).cast("decimal(38,18)"), lambda a, x: (a + x).cast("decimal(38,18)"))
            count = F.count_distinct(exact)
        else:
            total, count = F.sum(exact).cast("decimal(38,18)"), F.count(t)
        whole = F.bool_and(~T.has_type(t, "decimal"))
        all_exact = F.coalesce(F.bool_and(exact.isNotNull()), F.lit(True))
        fine = F.bool_and(dbl.isNotNull())
        if call.name == "SUM":
            zero = F.coalesce(total, F.lit(0).cast("decimal(38,18)"))
            text = F.when(F.coalesce(whole, F.lit(True)), T.make_literal(zero.cast("decimal(38,0)").cast("string"), "integer")).otherwise(T.make_literal(trim(zero), "decimal"))
            return F.when(all_exact, text).when(fine, T.make_literal(F.sum(dbl).cast("string"), "double"))
        mean = F.try_divide(total, count)
        return F.when(F.count(t) == 0, T.make_literal(F.lit("0"), "integer")).when(all_exact, T.make_literal(trim(mean.cast("decimal(38,18)")), "decimal")).when(fine, T.make_literal(F.avg(dbl).cast("string"), "double"))

    # ------------------------------------------------------------ expressions

    def term(self, e, s: dict) -> Column:
        """The value of an expression as a term; null on error."""
        if isinstance(e, str):
            return F.lit(e)
        if isinstance(e, Q.Var):
            return s.get(e.name, F.lit(None).cast("string"))
        if isinstance(e, Q.Call) and (e.name in _BOOLEAN or e.name in ("IN", "NOT IN")):
            b = self.ebv(e, s)
            return F.when(b, F.lit(TRUE)).when(~b, F.lit(FALSE))
        if isinstance(e, Q.Call):
            return self.call(e, s)
        raise Unsupported("EXISTS inside an expression")

    def ebv(self, e, s: dict) -> Column:
        """Effective boolean value; null on error."""
        if isinstance(e, Q.Call):
            n, a = e.name, e.args
            if n == "&&":
                return self.ebv(a[0], s) & self.ebv(a[1], s)
            if n == "||":
                return self.ebv(a[0], s) | self.ebv(a[1], s)
            if n == "!":
                return ~self.ebv(a[0], s)
            if n == "BOUND":
                return self.term(a[0], s).isNotNull()
            if n in ("=", "!="):
                same = equal(self.term(a[0], s), self.term(a[1], s), literal_kind(a))
                return same if n == "=" else ~same
            if n in ("<", "<=", ">", ">="):
                c = self.compared(a, s)
                return {"<": c < 0, "<=": c <= 0, ">": c > 0, ">=": c >= 0}[n]
            if n in ("IN", "NOT IN"):
                x = self.term(a[0], s)
                hit = reduce(lambda p, q: p | q, [equal(x, self.term(y, s), literal_kind([a[0], y])) for y in a[1:]], F.lit(False))
                return hit if n == "IN" else ~hit
            if n in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL", "ISNUMERIC"):
                t = self.term(a[0], s)
                return {"ISIRI": T.is_iri, "ISURI": T.is_iri, "ISBLANK": T.is_blank, "ISLITERAL": T.is_literal, "ISNUMERIC": T.is_numeric}[n](t)
            if n == "SAMETERM":
                return self.term(a[0], s) == self.term(a[1], s)
            if n in ("STRSTARTS", "STRENDS", "CONTAINS"):
                x, y = self.text(a[0], s), self.text(a[1], s)
                return {"STRSTARTS": x.startswith, "STRENDS": x.endswith, "CONTAINS": x.contains}[n](y)
            if n == "REGEX":
                if isinstance(a[1], str):
                    return F.rlike(self.text(a[0], s), F.lit(self.pattern_text(a[1:])))
                return F.rlike(self.text(a[0], s), self.flagged(a[1], a[2:], s))
            if n == "LANGMATCHES":
                tag, r = F.lower(T.lex(self.term(a[0], s))), F.lower(T.lex(self.term(a[1], s)))
                return F.when(r == "*", tag != "").otherwise((tag == r) | tag.startswith(F.concat(r, F.lit("-"))))
        t = self.term(e, s)
        kind, x = T.datatype(t), T.lex(t)
        number = T.floating(t)
        return F.when(kind == XSD + "boolean", x.isin("true", "1")).when(kind.isin(XSD + "string", RDF + "langString"), x != "").when(number.isNotNull(), number != 0)

    def compared(self, a: list, s: dict) -> Column:
        if numeric_literal(a[0]) or numeric_literal(a[1]):
            x, y = self.term(a[0], s), self.term(a[1], s)
            c = lambda p, q: F.when(p < q, -1).when(p > q, 1).when(p == q, 0)
            return F.coalesce(c(T.exact(x), T.exact(y)), c(T.floating(x), T.floating(y)))
        return T.compare(self.term(a[0], s), self.term(a[1], s))

    def pattern_text(self, args: list) -> str:
        from shapeloom.sources.terms import parts

        if not all(isinstance(x, str) for x in args):
            raise Unsupported("patterns and flags are constants")
        found = T.java_pattern(parts(args[0])[1], parts(args[1])[1] if len(args) > 1 else None)
        if found is None:
            raise Q.SparqlError("invalid pattern")
        return found

    def flagged(self, pattern, flags: list, s: dict) -> Column:
        """A pattern that is a value of the row; its flags are constant."""
        from shapeloom.sources.terms import parts

        if not all(isinstance(x, str) for x in flags):
            raise Unsupported("flags are constants")
        return F.concat(F.lit(f"(?{parts(flags[0])[1]})" if flags else ""), self.text(pattern, s))

    def text(self, e, s: dict) -> Column:
        """Lexical form of a string argument; null for other terms."""
        t = self.term(e, s)
        return F.when(T.datatype(t).isin(XSD + "string", RDF + "langString"), T.lex(t))

    def call(self, e: Q.Call, s: dict) -> Column:
        n, a = e.name, e.args
        arg = lambda k: self.term(a[k], s)
        string = lambda c: T.make_literal(c)
        if n == "STR":
            return F.when(~T.is_blank(arg(0)), string(T.lex(arg(0))))
        if n == "LANG":
            return string(T.lang(arg(0)))
        if n == "DATATYPE":
            return F.concat(F.lit("<"), T.datatype(arg(0)), F.lit(">"))
        if n in ("IRI", "URI"):
            return F.when(T.is_iri(arg(0)), arg(0)).otherwise(F.concat(F.lit("<"), self.text(a[0], s), F.lit(">")))
        if n == "STRDT":
            return F.concat(string(self.text(a[0], s)), F.lit("^^"), arg(1))
        if n == "STRLANG":
            return F.concat(string(self.text(a[0], s)), F.lit("@"), T.lex(arg(1)))
        if n in ("UCASE", "LCASE", "SUBSTR", "REPLACE", "STRBEFORE", "STRAFTER"):
            x = self.text(a[0], s)
            if n in ("UCASE", "LCASE"):
                out = F.upper(x) if n == "UCASE" else F.lower(x)
            elif n == "SUBSTR":
                start = T.exact(arg(1)).cast("int")
                out = F.substring(x, start, T.exact(arg(2)).cast("int") if len(a) > 2 else F.lit(1 << 30))
            elif n == "REPLACE":
                pattern = F.lit(self.pattern_text([a[1], *a[3:]])) if isinstance(a[1], str) else self.flagged(a[1], a[3:], s)
                out = F.regexp_replace(x, pattern, self.text(a[2], s))
            else:
                y = self.text(a[1], s)
                at = F.call_function("instr", x, y)
                found = F.substring(x, F.lit(1), at - 1) if n == "STRBEFORE" else F.substring(x, at + F.length(y), F.lit(1 << 30))
                return string(F.when(at > 0, found).otherwise(""))
            return retag(arg(0), out)
        if n == "STRLEN":
            return T.make_literal(F.char_length(self.text(a[0], s)).cast("string"), "integer")
        if n == "CONCAT":
            return string(F.concat(*[self.text(x, s) for x in a]) if a else F.lit(""))
        if n == "ENCODE_FOR_URI":
            return string(F.regexp_replace(F.url_encode(self.text(a[0], s)), r"\+", "%20"))
        if n in ("MD5", "SHA1", "SHA256", "SHA384", "SHA512"):
            x = self.text(a[0], s).cast("binary")
            return string(F.md5(x) if n == "MD5" else F.sha1(x) if n == "SHA1" else F.sha2(x, int(n[3:])))
        if n in ("+", "-", "*", "/"):
            return arithmetic(n, arg(0), arg(1))
        if n in ("ABS", "ROUND", "CEIL", "FLOOR"):
            x, d = T.exact(arg(0)), T.floating(arg(0))
            f = {"ABS": F.abs, "ROUND": lambda c: F.floor(c + F.lit("0.5").cast("decimal(2,1)")), "CEIL": F.ceil, "FLOOR": F.floor}[n]
            g = {"ABS": F.abs, "ROUND": lambda c: F.floor(c + 0.5).cast("double"), "CEIL": lambda c: F.ceil(c).cast("double"), "FLOOR": lambda c: F.floor(c).cast("double")}[n]
            kind = F.when(T.has_type(arg(0), "decimal"), F.lit(XSD + "decimal")).otherwise(XSD + "integer")
            whole = F.concat(F.lit('"'), trim(f(x).cast("decimal(38,18)")), F.lit('"^^<'), kind, F.lit(">"))
            return F.when(x.isNotNull(), whole).when(d.isNotNull(), T.make_literal(g(d).cast("string"), "double"))
        if n in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS"):
            part = {"YEAR": r"^(-?\d+)-", "MONTH": r"^-?\d+-(\d\d)", "DAY": r"^-?\d+-\d\d-(\d\d)", "HOURS": r"T(\d\d)", "MINUTES": r"T\d\d:(\d\d)", "SECONDS": r"T\d\d:\d\d:([\d.]+)"}[n]
            x = F.nullif(F.regexp_extract(T.lex(arg(0)), part, 1), F.lit(""))
            ok = T.has_type(arg(0), "dateTime") | T.has_type(arg(0), "date")
            return F.when(ok, T.make_literal(trim(x.cast("decimal(38,18)")), "decimal" if n == "SECONDS" else "integer"))
        if n in ("TZ", "TIMEZONE"):
            zone = F.nullif(F.regexp_extract(T.lex(arg(0)), r"(Z|[+-]\d\d:\d\d)$", 1), F.lit(""))
            if n == "TZ":
                return F.when(T.has_type(arg(0), "dateTime"), string(F.coalesce(zone, F.lit(""))))
            part = lambda k: F.regexp_extract(zone, r"(\d\d):(\d\d)", k).try_cast("int")
            some = lambda k, unit: F.when(part(k) > 0, F.concat(part(k).cast("string"), F.lit(unit))).otherwise("")
            text = F.concat(F.when(zone.startswith("-"), "-").otherwise(""), F.lit("PT"), some(1, "H"), some(2, "M"))
            return F.when(T.has_type(arg(0), "dateTime") & zone.isNotNull(), T.make_literal(F.when(zone.isin("Z", "+00:00", "-00:00"), "PT0S").otherwise(text), "dayTimeDuration"))
        if n == "NOW":
            return T.make_literal(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), "dateTime")
        if n == "RAND":
            return T.make_literal(F.rand().cast("string"), "double")
        if n in ("UUID", "STRUUID"):
            return F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")) if n == "UUID" else string(F.expr("uuid()"))
        if n == "BNODE":
            return F.concat(F.lit("_:b"), F.md5(self.text(a[0], s).cast("binary")) if a else F.regexp_replace(F.expr("uuid()"), "-", ""))
        if n == "IF":
            c = self.ebv(a[0], s)
            return F.when(c, arg(1)).when(~c, arg(2))
        if n == "COALESCE":
            return F.coalesce(*[self.term(x, s) for x in a])
        if n.startswith(f"<{XSD}"):
            return cast(arg(0), n[len(XSD) + 1 : -1])
        raise Unsupported(f"function {n}")


_BOOLEAN = {"&&", "||", "!", "=", "!=", "<", "<=", ">", ">=", "BOUND", "ISIRI", "ISURI", "ISBLANK", "ISLITERAL", "ISNUMERIC", "SAMETERM", "STRSTARTS", "STRENDS", "CONTAINS", "REGEX", "LANGMATCHES"}


def scope(a: Rows) -> dict[str, Column]:
    return {n: F.col(n) for n in a.names}


def _has_negation(p: Path) -> bool:
    return isinstance(p, Q.NotIn) or any(_has_negation(x) for x in getattr(p, "parts", ())) or (hasattr(p, "path") and _has_negation(p.path))


def _replace(e, table):
    for call, name in table:
        if e is call:
            return Q.Var(name)
    return Q.Call(e.name, [_replace(x, table) for x in e.args], e.distinct, e.separator) if isinstance(e, Q.Call) else e


def numeric_literal(e) -> bool:
    return isinstance(e, str) and any(e.endswith(f"^^<{XSD}{k}>") for k in ("integer", "decimal", "double"))


def literal_kind(args: list) -> str | None:
    """string, iri or number if one argument is a constant of that kind."""
    for e in args:
        if isinstance(e, str):
            return "iri" if e.startswith("<") else "number" if numeric_literal(e) else "string" if e.endswith('"') or "@" in e[-12:] else None
    return None


def equal(a: Column, b: Column, kind: str | None = None) -> Column:
    """SPARQL equality: null where literals cannot be compared."""
    if kind in ("iri", "string"):
        return a == b
    same = F.when(a == b, True)
    if kind == "number":
        return same.when(T.floating(a).isNotNull() & T.floating(b).isNotNull(), F.coalesce(T.exact(a) == T.exact(b), T.floating(a) == T.floating(b))).when(~(T.is_literal(a) & T.is_literal(b)), False)
    c = T.compare(a, b)
    plain = T.datatype(a).isin(XSD + "string", RDF + "langString") & T.datatype(b).isin(XSD + "string", RDF + "langString")
    return same.when(~(T.is_literal(a) & T.is_literal(b)) | plain, False).when(c.isNotNull(), c == 0)


def trim(d: Column) -> Column:
    """Shortest text of a decimal."""
    text = d.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def retag(t: Column, text: Column) -> Column:
    plain = T.make_literal(text)
    return F.when(T.lang(t) != "", F.concat(plain, F.lit("@"), T.lang(t))).otherwise(plain)


def arithmetic(op: str, a: Column, b: Column) -> Column:
    f = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": F.try_divide}[op]
    x, y = T.exact(a).cast("decimal(28,10)"), T.exact(b).cast("decimal(28,10)")
    value = f(x, y).cast("decimal(38,18)")
    whole = ~T.has_type(a, "decimal") & ~T.has_type(b, "decimal") if op != "/" else F.lit(False)
    exact = F.when(whole, T.make_literal(value.cast("decimal(38,0)").cast("string"), "integer")).otherwise(T.make_literal(trim(value), "decimal"))
    dbl = f(T.floating(a), T.floating(b))
    return F.when(x.isNotNull() & y.isNotNull(), exact).otherwise(T.make_literal(dbl.cast("string"), "double"))


def cast(t: Column, kind: str) -> Column:
    x = T.lex(t)
    if kind == "string":
        return F.when(~T.is_blank(t), T.make_literal(x))
    if kind == "boolean":
        number = T.floating(t)
        b = F.when(number.isNotNull(), number != 0).when(x.isin("true", "1"), True).when(x.isin("false", "0"), False)
        return F.when(b, F.lit(TRUE)).when(~b, F.lit(FALSE))
    if kind == "integer":
        text = F.when(T.floating(t).isNotNull(), T.floating(t).cast("decimal(38,0)").cast("string")).when(F.rlike(x, F.lit(T.full(T.FORMS["integer"]))), x)
        return T.make_literal(F.when(T.exact(t).isNotNull(), trim(F.when(T.exact(t) < 0, F.ceil(T.exact(t))).otherwise(F.floor(T.exact(t))).cast("decimal(38,0)"))).otherwise(text), kind)
    if kind in ("decimal", "double", "float"):
        ok = F.rlike(x, F.lit(T.full(T.FORMS[kind])))
        text = F.when(ok, x)
        return T.make_literal(text if kind != "decimal" else F.coalesce(text, trim(T.floating(t).cast("decimal(38,18)"))), kind)
    return F.when(F.rlike(x, F.lit(T.full(T.FORMS.get(kind, "(?!)")))), T.make_literal(x, kind))


def order_key(t: Column) -> list[Column]:
    """Blank nodes, IRIs, literals; numbers by value, the rest by text."""
    kind = F.when(T.is_blank(t), 1).when(T.is_iri(t), 2).when(T.is_literal(t), 3)
    return [kind, T.floating(t), T.exact(t), T.lex(t), t]


# ---------------------------------------------------------------- entry points


def _start(this: DataFrame | None) -> Rows | None:
    """Pre-bound rows: the first column is ?this, others are variables of their names."""
    if this is None:
        return None
    first, *more = this.columns
    return Rows(this.select(F.col(first).alias("this"), *more), {"this", *more})


def select(source, text: str, prefixes: dict | None = None, this: DataFrame | None = None, graphs: dict | None = None, functions: dict | None = None) -> DataFrame:
    """Rows of a SELECT; with ``this`` (a column of foci, and others), ?this is pre-bound to each of them."""
    return Engine(source, graphs).select(Q.parse(text, prefixes, functions), _start(this)).df


def ask(source, text: str, prefixes: dict | None = None, this: DataFrame | None = None, graphs: dict | None = None, functions: dict | None = None) -> bool | DataFrame:
    """Whether the pattern has a match; with ``this``, the pre-bound rows for which it has one."""
    q, start = Q.parse(text, prefixes, functions), _start(this)
    found = Engine(source, graphs).group(q.where, start).df
    return not found.isEmpty() if start is None else found.select(*start.names).distinct()


def construct(source, text: str, prefixes: dict | None = None, this: DataFrame | None = None, graphs: dict | None = None, functions: dict | None = None) -> DataFrame:
    """(s, p, o) of a CONSTRUCT.  Blank nodes make no triples, nor do unbound or misplaced terms."""
    q = Q.parse(text, prefixes, functions)
    rows = Engine(source, graphs).group(q.where, _start(this))
    at = lambda x: F.lit(x) if isinstance(x, str) else (F.col(x.name) if x.name in rows.names else F.lit(None).cast("string"))
    out = None
    for t in q.template:
        made = rows.df.select(at(t.s).alias("s"), at(t.p).alias("p"), at(t.o).alias("o"))
        out = made if out is None else out.unionByName(made)
    ok = F.col("s").startswith("<") & F.col("p").startswith("<") & F.col("o").isNotNull() & ~F.col("o").startswith("_:")
    return out.where(ok).distinct()


def describe(source, text: str, prefixes: dict | None = None, graphs: dict | None = None) -> DataFrame:
    """(s, p, o): the triples whose subject is a named or found resource."""
    q = Q.parse(text, prefixes)
    found = source.spark.createDataFrame([(x,) for x in q.template], "v string")
    if q.where.parts:
        rows = Engine(source, graphs).group(q.where)
        for n in [n for n, _ in q.items] or ([] if q.template else [n for n in rows.names if not n.startswith("_")]):
            found = found.unionByName(rows.df.select(F.col(n).alias("v")))
    triples = source.all()
    return triples.join(found.distinct(), triples.s == found.v, "left_semi").select("s", "p", "o")


def query(source, text: str, prefixes: dict | None = None, **options) -> DataFrame | bool:
    """Any query form: rows, triples, or whether there is a match."""
    run = {"SELECT": select, "ASK": ask, "CONSTRUCT": construct, "DESCRIBE": describe}
    return run[Q.parse(text, prefixes, options.get("functions")).kind](source, text, prefixes, **options)
