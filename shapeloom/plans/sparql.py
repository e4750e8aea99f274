"""SPARQL text to algebra: SELECT, ASK and CONSTRUCT with the usual patterns, paths, expressions and aggregates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from shapeloom.plans.paths import Alt, Inv, Opt, Path, Plus, Pred, Seq, Star
from shapeloom.sources.terms import FIRST, NIL, REST, TYPE, XSD, literal, unescape


class SparqlError(ValueError):
    pass


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class NotIn(Path):
    """A negated property set: forward and inverse predicates that are excluded."""

    forward: tuple[str, ...]
    inverse: tuple[str, ...]


@dataclass
class Triple:
    s: object
    p: object  # a term, a Var or a Path
    o: object


@dataclass
class Group:
    """Elements of a group graph pattern in order."""

    parts: list = field(default_factory=list)


@dataclass
class Bgp:
    triples: list[Triple]


@dataclass
class Optional_:
    group: Group


@dataclass
class Union_:
    groups: list[Group]


@dataclass
class Minus_:
    group: Group


@dataclass
class Lateral_:
    """A pattern that is evaluated for each row before it."""

    group: Group


@dataclass
class Filter_:
    expr: object


@dataclass
class Bind_:
    expr: object
    var: str


@dataclass
class Values_:
    names: list[str]
    rows: list[list]


@dataclass
class Graph_:
    name: object
    group: Group


@dataclass
class Call:
    name: str
    args: list
    distinct: bool = False
    separator: str = " "


@dataclass
class Exists:
    group: Group
    positive: bool


@dataclass
class Query:
    kind: str
    where: Group
    items: list = field(default_factory=list)  # (name, expr or None); empty: all
    distinct: bool = False
    group_by: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order_by: list = field(default_factory=list)  # (expr, descending)
    limit: int | None = None
    offset: int = 0
    template: list[Triple] = field(default_factory=list)


AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}
_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
  | (?P<iri><[^\x00-\x20<>"{}|^`]*>)
  | (?P<var>[?$][A-Za-z_][\w]*)
  | (?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
  | (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<blank>_:[\w]+)
  | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<double>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+)
  | (?P<decimal>\d*\.\d+)
  | (?P<integer>\d+)
  | (?P<name>(?:[A-Za-z][\w\-.]*)?:(?:[\w:](?:[\w:.\-]*[\w:\-])?)?)
  | (?P<word>[A-Za-z_][A-Za-z_0-9]*)
  | (?P<mark>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].,;|/^*+?!=<>\-])""",
    re.X | re.S,
)


def parse(text: str, prefixes: dict[str, str] | None = None, functions: dict | None = None) -> Query:
    """``functions``: declared functions by IRI, whose calls are replaced by their bodies."""
    p = _Parser(text, dict(prefixes or {}), functions or {})
    q = p.query()
    if p.kind() != "end":
        raise SparqlError(f"unexpected {p.peek()!r}")
    return q


class _Parser:
    def __init__(self, text: str, prefixes: dict[str, str], functions: dict):
        self.prefixes, self.functions, self.base, self.tokens, at = prefixes, functions, "", [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"unexpected text: {text[at : at + 30]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.i = self.blanks = 0

    # tokens

    def kind(self) -> str:
        return self.tokens[self.i][0]

    def peek(self, k: int = 0) -> str:
        return self.tokens[min(self.i + k, len(self.tokens) - 1)][1]

    def next(self) -> tuple[str, str]:
        self.i += 1
        return self.tokens[self.i - 1]

    def word(self, *names: str) -> str | None:
        if self.kind() == "word" and self.peek().upper() in names:
            return self.next()[1].upper()
        return None

    def mark(self, *marks: str) -> str | None:
        if self.kind() == "mark" and self.peek() in marks:
            return self.next()[1]
        return None

    def expect(self, m: str) -> None:
        if not self.mark(m):
            raise SparqlError(f"expected {m!r}, found {self.peek()!r}")

    def fresh(self) -> Var:
        self.blanks += 1
        return Var(f"_b{self.blanks}")

    # queries

    def query(self) -> Query:
        while self.kind() == "word" and self.peek().upper() in ("PREFIX", "BASE"):
            if self.word("PREFIX"):
                name = self.next()[1][:-1]
                self.prefixes[name] = self.next()[1][1:-1]
            else:
                self.next()
                self.base = self.next()[1][1:-1]
        if self.word("DESCRIBE"):
            return self.describe()
        kind = self.word("SELECT", "ASK", "CONSTRUCT")
        if not kind:
            raise SparqlError(f"unsupported query form {self.peek()!r}")
        return self.select() if kind == "SELECT" else self.other(kind)

    def other(self, kind: str) -> Query:
        template = []
        if kind == "CONSTRUCT":
            self.expect("{")
            template = self.triples("}")
            self.expect("}")
        self.word("WHERE")
        q = Query(kind, self.group(), template=template)
        self.modifiers(q)
        return q

    def describe(self) -> Query:
        """``items`` names variables (none: all), ``template`` holds the constants."""
        names, constants = [], []
        while not self.mark("*") and (self.kind() == "var" or self.peek().startswith("<") or ":" in self.peek()):
            if self.kind() == "var":
                names.append((self.next()[1][1:], None))
            else:
                constants.append(self.term())
        self.word("WHERE")
        q = Query("DESCRIBE", self.group() if self.peek() == "{" else Group(), names, template=constants)
        self.modifiers(q)
        return q

    def select(self) -> Query:
        distinct = self.word("DISTINCT", "REDUCED") == "DISTINCT"
        items = []
        if not self.mark("*"):
            while True:
                if self.kind() == "var":
                    items.append((self.next()[1][1:], None))
                elif self.mark("("):
                    e = self.expression()
                    if not self.word("AS"):
                        raise SparqlError("expected AS")
                    items.append((self.next()[1][1:], e))
                    self.expect(")")
                else:
                    break
        self.word("WHERE")
        q = Query("SELECT", self.group(), items, distinct)
        self.modifiers(q)
        return q

    def modifiers(self, q: Query) -> None:
        if self.word("GROUP"):
            self.word("BY")
            while self.kind() == "var" or self.peek() == "(":
                if self.kind() == "var":
                    q.group_by.append((self.next()[1][1:], None))
                else:
                    self.expect("(")
                    e = self.expression()
                    name = self.next()[1][1:] if self.word("AS") else f"_g{len(q.group_by)}"
                    q.group_by.append((name, e))
                    self.expect(")")
        if self.word("HAVING"):
            while self.peek() == "(":
                q.having.append(self.primary())
        if self.word("ORDER"):
            self.word("BY")
            while True:
                way = self.word("ASC", "DESC")
                if way or self.peek() == "(":
                    q.order_by.append((self.primary(), way == "DESC"))
                elif self.kind() == "var":
                    q.order_by.append((Var(self.next()[1][1:]), False))
                else:
                    break
        while w := self.word("LIMIT", "OFFSET"):
            n = int(self.next()[1])
            if w == "LIMIT":
                q.limit = n
            else:
                q.offset = n
        if self.kind() == "word" and self.peek().upper() == "VALUES":
            self.next()
            q.where.parts.append(self.values())

    # patterns

    def group(self) -> Group:
        self.expect("{")
        g = Group()
        if self.kind() == "word" and self.peek().upper() == "SELECT":
            self.next()
            g.parts.append(self.select())
            self.expect("}")
            return g
        while not self.mark("}"):
            if self.mark("."):
                continue
            w = self.peek().upper() if self.kind() == "word" else ""
            if w == "FILTER":
                self.next()
                g.parts.append(Filter_(self.constraint()))
            elif w == "OPTIONAL":
                self.next()
                g.parts.append(Optional_(self.group()))
            elif w == "LATERAL":
                self.next()
                g.parts.append(Lateral_(self.group()))
            elif w == "MINUS":
                self.next()
                g.parts.append(Minus_(self.group()))
            elif w == "BIND":
                self.next()
                self.expect("(")
                e = self.expression()
                self.word("AS")
                g.parts.append(Bind_(e, self.next()[1][1:]))
                self.expect(")")
            elif w == "VALUES":
                self.next()
                g.parts.append(self.values())
            elif w == "GRAPH":
                self.next()
                g.parts.append(Graph_(self.term(), self.group()))
            elif w == "SERVICE":
                raise SparqlError("SERVICE is not supported")
            elif self.peek() == "{":
                groups = [self.group()]
                while self.word("UNION"):
                    groups.append(self.group())
                g.parts.append(Union_(groups) if len(groups) > 1 else groups[0])
            else:
                g.parts.append(Bgp(self.triples("}")))
        return g

    def values(self) -> Values_:
        if self.kind() == "var":
            names, single = [self.next()[1][1:]], True
        else:
            self.expect("(")
            names, single = [], False
            while self.kind() == "var":
                names.append(self.next()[1][1:])
            self.expect(")")
        self.expect("{")
        rows = []
        while not self.mark("}"):
            if not single:
                self.expect("(")
            row = [None if self.word("UNDEF") else self.term() for _ in names]
            if not single:
                self.expect(")")
            rows.append(row)
        return Values_(names, rows)

    def triples(self, end: str) -> list[Triple]:
        out: list[Triple] = []
        while self.peek() != end and self.kind() != "end" and not (self.kind() == "word" and self.peek().upper() in ("FILTER", "OPTIONAL", "MINUS", "BIND", "VALUES", "GRAPH", "UNION", "SERVICE")) and self.peek() != "{":
            bracket = self.peek() == "["
            s = self.node(out)
            if not (bracket and self.peek() in (".", end)):
                self.properties(s, out)
            if not self.mark("."):
                break
        return out

    def properties(self, s, out: list[Triple]) -> None:
        while True:
            verb = Var(self.next()[1][1:]) if self.kind() == "var" else self.path()
            verb = verb.iri if isinstance(verb, Pred) else verb
            while True:
                out.append(Triple(s, verb, self.node(out)))
                if not self.mark(","):
                    break
            if not self.mark(";"):
                return
            while self.mark(";"):
                pass
            if self.peek() in (".", "]", "}"):
                return

    def node(self, out: list[Triple]):
        if self.mark("["):
            n = self.fresh()
            if not self.mark("]"):
                self.properties(n, out)
                self.expect("]")
            return n
        if self.mark("("):
            items = []
            while not self.mark(")"):
                items.append(self.node(out))
            head: object = NIL
            for x in reversed(items):
                cell = self.fresh()
                out += [Triple(cell, FIRST, x), Triple(cell, REST, head)]
                head = cell
            return head
        return self.term()

    def path(self) -> Path:
        parts = [self.path_seq()]
        while self.mark("|"):
            parts.append(self.path_seq())
        return parts[0] if len(parts) == 1 else Alt(tuple(parts))

    def path_seq(self) -> Path:
        parts = [self.path_step()]
        while self.mark("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else Seq(tuple(parts))

    def path_step(self) -> Path:
        inverse = bool(self.mark("^"))
        if self.mark("!"):
            p: Path = self.negated()
        elif self.mark("("):
            p = self.path()
            self.expect(")")
        else:
            p = Pred(self.verb())
        if m := self.mark("*", "+", "?"):
            p = {"*": Star, "+": Plus, "?": Opt}[m](p)
        return Inv(p) if inverse else p

    def negated(self) -> NotIn:
        forward, inverse = [], []
        many = bool(self.mark("("))
        while True:
            (inverse if self.mark("^") else forward).append(self.verb())
            if not (many and self.mark("|")):
                break
        if many:
            self.expect(")")
        return NotIn(tuple(forward), tuple(inverse))

    def verb(self) -> str:
        if self.kind() == "word" and self.peek() == "a":
            self.next()
            return TYPE
        t = self.term()
        if not (isinstance(t, str) and t.startswith("<")):
            raise SparqlError("a predicate is an IRI")
        return t

    def term(self):
        kind, v = self.next()
        if kind == "var":
            return Var(v[1:])
        if kind == "iri":
            if ":" not in v and not self.base:
                raise SparqlError(f"relative IRI {v} without a BASE")
            return f"<{self.base if ':' not in v else ''}{unescape(v[1:-1])}>"
        if kind == "name":
            prefix, _, local = v.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"unknown prefix {prefix!r}")
            return f"<{self.prefixes[prefix]}{local}>"
        if kind == "blank":
            return Var("_" + v[2:])
        if kind in ("string", "long"):
            text = unescape(v[3:-3] if kind == "long" else v[1:-1])
            if self.kind() == "at":
                return literal(text, lang=self.next()[1][1:])
            return literal(text, self.term()[1:-1]) if self.mark("^^") else literal(text)
        if kind in ("integer", "decimal", "double"):
            return literal(v, XSD + kind)
        if v in ("-", "+") and self.kind() in ("integer", "decimal", "double"):
            k, n = self.next()
            return literal(v.replace("+", "") + n, XSD + k)
        if kind == "word" and v.lower() in ("true", "false"):
            return literal(v.lower(), XSD + "boolean")
        raise SparqlError(f"unexpected {v!r}")

    # expressions

    def constraint(self):
        if self.peek() == "(" or (self.kind() in ("word", "iri", "name")):
            return self.primary()
        raise SparqlError(f"unexpected {self.peek()!r}")

    def expression(self):
        return self._chain(self._and, "||")

    def _and(self):
        return self._chain(self._relation, "&&")

    def _chain(self, inner, op: str):
        e = inner()
        while self.mark(op):
            e = Call(op, [e, inner()])
        return e

    def _relation(self):
        e = self._sum()
        if m := self.mark("=", "!=", "<", ">", "<=", ">="):
            return Call(m, [e, self._sum()])
        negative = self.kind() == "word" and self.peek().upper() == "NOT" and self.peek(1).upper() == "IN"
        if negative:
            self.next()
        if self.word("IN"):
            args = self.arguments()
            return Call("NOT IN" if negative else "IN", [e, *args])
        return e

    def _sum(self):
        e = self._product()
        while m := self.mark("+", "-"):
            e = Call(m, [e, self._product()])
        return e

    def _product(self):
        e = self._unary()
        while m := self.mark("*", "/"):
            e = Call(m, [e, self._unary()])
        return e

    def _unary(self):
        if self.mark("!"):
            return Call("!", [self._unary()])
        if self.mark("-"):
            return Call("-", [literal("0", XSD + "integer"), self._unary()])
        if self.mark("+"):
            return self._unary()
        return self.primary()

    def arguments(self) -> list:
        self.expect("(")
        out = []
        while not self.mark(")"):
            out.append(self.expression())
            self.mark(",")
        return out

    def primary(self):
        if self.mark("("):
            e = self.expression()
            self.expect(")")
            return e
        if self.kind() == "word" and self.peek().lower() not in ("true", "false"):
            name = self.next()[1].upper()
            if name == "NOT" and self.word("EXISTS"):
                return Exists(self.group(), False)
            if name == "EXISTS":
                return Exists(self.group(), True)
            if name in AGGREGATES:
                self.expect("(")
                distinct = bool(self.word("DISTINCT"))
                args = [] if self.mark("*") else [self.expression()]
                call = Call(name, args, distinct)
                if self.mark(";"):
                    self.word("SEPARATOR")
                    self.expect("=")
                    call.separator = unescape(self.next()[1][1:-1])
                self.expect(")")
                return call
            return Call(name, self.arguments())
        t = self.term()
        if isinstance(t, str) and t.startswith("<") and self.peek() == "(":
            args = self.arguments()
            if t in self.functions:
                from shapeloom.plans.functions import inline

                return inline(self.functions[t], args)
            return Call(t, args)
        return t


def variables(e) -> set[str]:
    """Variables of an expression or pattern."""
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, Call):
        return set().union(*(variables(x) for x in e.args))
    if isinstance(e, Exists):
        return variables(e.group)
    if isinstance(e, Triple):
        return variables(e.s) | variables(e.p) | variables(e.o)
    if isinstance(e, Bgp):
        return set().union(*map(variables, e.triples))
    if isinstance(e, Group):
        return set().union(*map(variables, e.parts))
    if isinstance(e, Optional_ | Graph_ | Lateral_):
        return variables(e.group)
    if isinstance(e, Union_):
        return set().union(*map(variables, e.groups))
    if isinstance(e, Filter_):
        return variables(e.expr)
    if isinstance(e, Bind_):
        return {e.var} | variables(e.expr)
    if isinstance(e, Values_):
        return set(e.names)
    if isinstance(e, Query):
        return {n for n, _ in e.items} or variables(e.where)
    return set()


def aggregates(e) -> list[Call]:
    if isinstance(e, Call):
        return [e] if e.name in AGGREGATES else [a for x in e.args for a in aggregates(x)]
    return []
