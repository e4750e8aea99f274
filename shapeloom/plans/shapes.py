"""The shape algebra, target selectors and statements, and their SHACL syntax."""

from __future__ import annotations

from dataclasses import dataclass, field

from shapeloom.plans.paths import Id, Path, Pred, Seq, Star, from_graph
from shapeloom.sources.terms import RDFS, SH, SUBCLASS, TYPE, Graph, parts


class Shape:
    pass


@dataclass(frozen=True)
class Top(Shape):
    pass


@dataclass(frozen=True)
class Test(Shape):
    """A facet of the node itself; ``in`` with one member is equality with a term."""

    __test__ = False  # not a test case

    facet: str
    value: object


@dataclass(frozen=True)
class Closed(Shape):
    allowed: tuple[str, ...]


@dataclass(frozen=True)
class Pair(Shape):
    """equals, disjoint, lessThan or lessThanOrEquals between the values of a path and of a predicate."""

    kind: str
    path: Path
    pred: str


@dataclass(frozen=True)
class UniqueLang(Shape):
    path: Path


@dataclass(frozen=True)
class Not(Shape):
    shape: Shape


@dataclass(frozen=True)
class And(Shape):
    shapes: tuple[Shape, ...]


@dataclass(frozen=True)
class Or(Shape):
    shapes: tuple[Shape, ...]


@dataclass(frozen=True)
class Xone(Shape):
    shapes: tuple[Shape, ...]


@dataclass(frozen=True)
class Count(Shape):
    """Between ``low`` and ``high`` distinct values of ``path`` satisfy ``shape``."""

    path: Path
    low: int = 0
    high: int | None = None
    shape: Shape = Top()


@dataclass(frozen=True)
class Ref(Shape):
    """A named shape of the schema; may be recursive."""

    name: str


@dataclass(frozen=True)
class Sparql(Shape):
    """Holds for nodes for which a SELECT with $this bound to them has no row."""

    text: str
    prefixes: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Ask(Shape):
    """Holds for nodes for all of whose values an ASK with $this and $value bound to them has a match."""

    path: Path
    text: str
    prefixes: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Expression(Shape):
    """Holds for nodes for which a node expression gives true and nothing else."""

    expr: object


def every(path: Path, shape: Shape) -> Shape:
    return Count(path, 0, 0, Not(shape))


def class_test(cls: str) -> Shape:
    return Count(Seq((Pred(TYPE), Star(Pred(SUBCLASS)))), 1, None, Test("in", (cls,)))


# ---------------------------------------------------------------- selectors and schema


@dataclass(frozen=True)
class Target:
    """kind: class, node, subjectsOf, objectsOf, sparql (``term`` is then a SELECT of ?this) or exists (a path to a shape)."""

    kind: str
    term: str
    prefixes: tuple[tuple[str, str], ...] = ()
    path: Path | None = None
    shape: Shape | None = None


@dataclass
class Component:
    """One constraint of a shape as the report sees it: component name and its value."""

    name: str
    value: object
    extra: dict = field(default_factory=dict)


@dataclass
class Definition:
    id: str
    path: Path | None = None
    path_text: str | None = None
    components: list[Component] = field(default_factory=list)
    targets: list[Target] = field(default_factory=list)
    severity: str = f"<{SH}Violation>"
    message: str | None = None
    deactivated: bool = False


@dataclass
class Schema:
    shapes: dict[str, Definition]
    diagnostics: list[str] = field(default_factory=list)
    functions: dict = field(default_factory=dict)

    def formula(self, name: str) -> Shape:
        """What a node has to satisfy to conform to a shape."""
        d = self.shapes.get(name)
        if d is None or d.deactivated:
            return Top()
        found = tuple(self.constraint(d, c) for c in d.components)
        return found[0] if len(found) == 1 else And(found)

    def constraint(self, d: Definition, c: Component) -> Shape:
        path = d.path if d.path is not None else Id()
        n, v = c.name, c.value
        if n == "MinCount":
            return Count(path, v)
        if n == "MaxCount":
            return Count(path, 0, v)
        if n == "HasValue":
            return Count(path, 1, None, Test("in", (v,)))
        if n in ("Equals", "Disjoint", "LessThan", "LessThanOrEquals"):
            return Pair(n, path, v)
        if n == "UniqueLang":
            return UniqueLang(path)
        if n == "Closed":
            return every(path, Closed(v))
        if n == "QualifiedMinCount":
            return Count(path, v, None, self.qualifier(c))
        if n == "QualifiedMaxCount":
            return Count(path, 0, v, self.qualifier(c))
        if n in ("SPARQL", "Custom"):
            if c.extra.get("kind") == "ask":
                return Ask(path if n == "Custom" else Id(), v, c.extra["prefixes"])
            return Sparql(v, c.extra["prefixes"])
        if n == "Expression":
            return Expression(v)
        own = self.value_test(c)
        return own if d.path is None else every(path, own)

    def qualifier(self, c: Component) -> Shape:
        shape, others = Ref(c.extra["shape"]), c.extra.get("siblings", ())
        return And((shape, *(Not(Ref(x)) for x in others))) if others else shape

    def value_test(self, c: Component) -> Shape:
        """What the component asks of each value node."""
        n, v = c.name, c.value
        if n == "Class":
            return class_test(v)
        if n in ("Node", "Property"):
            return Ref(v)
        if n == "Not":
            return Not(Ref(v))
        if n in ("And", "Or", "Xone"):
            return {"And": And, "Or": Or, "Xone": Xone}[n](tuple(Ref(x) for x in v))
        return Test(FACETS[n], v)


#: Components that test one value, and the facet each is.
FACETS = {
    "Datatype": "datatype",
    "NodeKind": "nodeKind",
    "MinInclusive": "minInclusive",
    "MaxInclusive": "maxInclusive",
    "MinExclusive": "minExclusive",
    "MaxExclusive": "maxExclusive",
    "MinLength": "minLength",
    "MaxLength": "maxLength",
    "Pattern": "pattern",
    "LanguageIn": "languageIn",
    "In": "in",
}
NODE_KINDS = {
    "IRI": ("IRI",),
    "BlankNode": ("BlankNode",),
    "Literal": ("Literal",),
    "BlankNodeOrIRI": ("BlankNode", "IRI"),
    "BlankNodeOrLiteral": ("BlankNode", "Literal"),
    "IRIOrLiteral": ("IRI", "Literal"),
}


def sh(name: str) -> str:
    return f"<{SH}{name}>"


def lower(g: Graph) -> Schema:
    """The schema of a shapes graph: every shape that is declared, targeted or referred to."""
    from shapeloom.plans.functions import components_of, functions_of, refused

    schema = Schema({}, functions=functions_of(g))
    schema.diagnostics += [f"{x}: JavaScript is not run" for x in refused(g)]
    custom = components_of(g)
    classes = {f"<{RDFS}Class>", "<http://www.w3.org/2002/07/owl#Class>"}
    heads = [s for s, p, o in g.triples if (p == TYPE and o in (sh("NodeShape"), sh("PropertyShape"))) or p in (sh("sparql"), sh("expression"), sh("rule"), sh("target"), sh("targetClass"), sh("targetNode"), sh("targetSubjectsOf"), sh("targetObjectsOf"))]
    heads += [o for s, p, o in g.triples if p in (sh("condition"), sh("filterShape"))]
    declared = {o for s, p, o in g.triples if p == sh("parameter")}
    heads += [s for s in g.subjects_of(sh("path")) if s not in declared]
    todo, siblings = sorted(dict.fromkeys(heads)), _siblings(g)
    while todo:
        s = todo.pop()
        if s in schema.shapes:
            continue
        d = schema.shapes[s] = Definition(s)
        try:
            _fill(g, d, siblings, custom, schema.functions)
        except ValueError as e:
            schema.diagnostics.append(f"{s}: {e}")
            d.deactivated = True
        for c in d.components:
            refs = [c.value] if c.name in ("Node", "Property", "Not") else c.value if c.name in ("And", "Or", "Xone") else []
            todo += [*refs, *([c.extra["shape"]] if "shape" in c.extra else []), *c.extra.get("siblings", ())]
        for kind in ("class", "node", "subjectsOf", "objectsOf"):
            d.targets += [Target(kind, o) for o in g.objects(s, sh("target" + kind[0].upper() + kind[1:]))]
        for o in g.objects(s, sh("target")):
            if (q := g.value(o, sh("select"))) is not None:
                d.targets.append(Target("sparql", parts(q)[1], prefixes_of(g, o)))
        if s.startswith("<") and any(_is_class(g, t, classes) for t in g.objects(s, TYPE)):
            d.targets.append(Target("class", s))
    return schema


def _is_class(g: Graph, t: str, classes: set[str]) -> bool:
    seen, todo = set(), [t]
    while todo:
        x = todo.pop()
        if x in classes:
            return True
        if x not in seen:
            seen.add(x)
            todo += g.objects(x, SUBCLASS)
    return False


def _siblings(g: Graph) -> dict[str, list[str]]:
    """Of a property shape: qualified value shapes of the other property shapes of its parents."""
    out: dict[str, list[str]] = {}
    for s in dict.fromkeys(s for s, p, _ in g.triples if p == sh("property")):
        children = g.objects(s, sh("property"))
        for c in children:
            mine = g.objects(c, sh("qualifiedValueShape"))
            out.setdefault(c, []).extend(q for o in children for q in g.objects(o, sh("qualifiedValueShape")) if q not in mine)
    return out


def prefixes_of(g: Graph, node: str) -> tuple[tuple[str, str], ...]:
    """Prefixes of the document and those that sh:prefixes declares, imports followed."""
    found, todo, seen = dict(g.prefixes), list(g.objects(node, sh("prefixes"))), set()
    while todo:
        x = todo.pop()
        if x in seen:
            continue
        seen.add(x)
        todo += g.objects(x, "<http://www.w3.org/2002/07/owl#imports>")
        for d in g.objects(x, sh("declare")):
            found[parts(g.value(d, sh("prefix")))[1]] = parts(g.value(d, sh("namespace")))[1]
    return tuple(sorted(found.items()))


def checked(text: str, prefixes: tuple[tuple[str, str], ...]) -> str:
    """A query that may be run with pre-bound variables: no MINUS, SERVICE or VALUES."""
    from shapeloom.plans import sparql

    def walk(x) -> None:
        if isinstance(x, sparql.Minus_ | sparql.Values_):
            raise ValueError("MINUS and VALUES cannot be used with pre-bound variables")
        for y in getattr(x, "parts", None) or getattr(x, "groups", None) or [z for z in (getattr(x, "group", None), getattr(x, "where", None)) if z is not None]:
            walk(y)

    walk(sparql.parse(text, dict(prefixes)))
    return text


def _fill(g: Graph, d: Definition, siblings: dict[str, list[str]], custom: list = (), functions: dict | None = None) -> None:
    s = d.id
    lexical = lambda t: parts(t)[1]
    true = lambda name: any(lexical(o) in ("true", "1") for o in g.objects(s, sh(name)))
    if (p := g.value(s, sh("path"))) is not None:
        d.path, d.path_text = from_graph(g, p), p
    d.deactivated = any(lexical(o) == "true" for o in g.objects(s, sh("deactivated")))
    d.severity = g.value(s, sh("severity")) or d.severity
    messages = g.objects(s, sh("message"))
    d.message = lexical(messages[0]) if messages else None
    add = lambda name, value, **extra: d.components.append(Component(name, value, extra))
    for name in ("minCount", "maxCount"):
        if d.path is not None:
            for o in g.objects(s, sh(name)):
                add(name[0].upper() + name[1:], int(lexical(o)))
    for o in g.objects(s, sh("hasValue")):
        add("HasValue", o)
    for name in ("equals", "disjoint", "lessThan", "lessThanOrEquals"):
        for o in g.objects(s, sh(name)):
            if d.path is None and name.startswith("less"):
                raise ValueError(f"sh:{name} needs a path")
            add(name[0].upper() + name[1:], o)
    if true("uniqueLang") and d.path is not None:
        add("UniqueLang", True)
    if true("closed"):
        ignored = [x for o in g.objects(s, sh("ignoredProperties")) for x in g.items(o)]
        own = [q for c in g.objects(s, sh("property")) if (q := g.value(c, sh("path"))) is not None and q.startswith("<")]
        add("Closed", tuple(dict.fromkeys([*own, *ignored])))
    for o in g.objects(s, sh("class")):
        add("Class", o)
    for o in g.objects(s, sh("datatype")):
        add("Datatype", o[1:-1])
    for o in g.objects(s, sh("nodeKind")):
        add("NodeKind", NODE_KINDS[o[1:-1].removeprefix(SH)])
    for name in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive"):
        for o in g.objects(s, sh(name)):
            add(name[0].upper() + name[1:], o)
    for name in ("minLength", "maxLength"):
        for o in g.objects(s, sh(name)):
            add(name[0].upper() + name[1:], int(lexical(o)))
    flags = g.value(s, sh("flags"))
    for o in g.objects(s, sh("pattern")):
        add("Pattern", (lexical(o), lexical(flags) if flags else None))
    for o in g.objects(s, sh("languageIn")):
        add("LanguageIn", tuple(lexical(x) for x in g.items(o)))
    for o in g.objects(s, sh("in")):
        add("In", tuple(g.items(o)))
    for name in ("not", "node", "property"):
        for o in g.objects(s, sh(name)):
            add(name.capitalize(), o)
    for name in ("and", "or", "xone"):
        for o in g.objects(s, sh(name)):
            add(name.capitalize(), tuple(g.items(o)))
    from shapeloom.plans.functions import bind
    from shapeloom.plans.paths import render as shown

    at_path = lambda text: text.replace("$PATH", shown(d.path, False) if d.path is not None else "$PATH")
    for o in g.objects(s, sh("sparql")):
        kind = next((k for k in ("select", "ask") if g.value(o, sh(k)) is not None), None)
        if kind is not None and not any(lexical(x) == "true" for x in g.objects(o, sh("deactivated"))):
            prefixes = prefixes_of(g, o)
            text = bind(at_path(lexical(g.value(o, sh(kind)))), {"currentShape": s} if s.startswith("<") else {})
            note = g.value(o, sh("message"))
            add("SPARQL", checked(text, prefixes), prefixes=prefixes, message=lexical(note) if note else None, kind=kind)
    for c in custom:
        values = {p.name: v for p in c.parameters if (v := g.value(s, p.path)) is not None}
        validator = c.validator(d.path is not None)
        if validator is None or any(p.name not in values and not p.optional for p in c.parameters):
            continue
        named = {k: v for k, v in (values | {"currentShape": s}).items() if not v.startswith("_:")}
        text = checked(bind(at_path(validator.text), named), validator.prefixes)
        add("Custom", text, prefixes=validator.prefixes, kind=validator.kind, iri=c.iri, parameters=values, message=validator.messages[0] if validator.messages else None)
    for o in g.objects(s, sh("expression")):
        from shapeloom.operators.infer import lower_expr

        add("Expression", lower_expr(g, o, functions))
    q = g.value(s, sh("qualifiedValueShape"))
    if q is not None and d.path is not None:
        extra = {"shape": q, "siblings": tuple(dict.fromkeys(siblings.get(s, ()))) if true("qualifiedValueShapesDisjoint") else ()}
        for name in ("qualifiedMinCount", "qualifiedMaxCount"):
            for o in g.objects(s, sh(name)):
                add(name[0].upper() + name[1:], int(lexical(o)), **extra)


# ---------------------------------------------------------------- rewrites


def normalize(s: Shape) -> Shape:
    """Negations at the leaves, flat conjunctions and disjunctions, truth and repeats removed."""
    if isinstance(s, Not):
        x = s.shape
        if isinstance(x, Not):
            return normalize(x.shape)
        if isinstance(x, And | Or):
            return normalize((Or if isinstance(x, And) else And)(tuple(Not(y) for y in x.shapes)))
        if isinstance(x, Count):
            below = (Count(x.path, 0, x.low - 1, x.shape),) if x.low > 0 else ()
            above = (Count(x.path, x.high + 1, None, x.shape),) if x.high is not None else ()
            both = below + above
            return normalize(both[0] if len(both) == 1 else Or(both))
        if isinstance(x, Test) and x.facet == "nodeKind":
            return Test("nodeKind", tuple(k for k in ("IRI", "BlankNode", "Literal") if k not in x.value))
        return Not(normalize(x))
    if isinstance(s, And | Or):
        kind = type(s)
        flat = dict.fromkeys(y for x in s.shapes for n in [normalize(x)] for y in (n.shapes if isinstance(n, kind) else [n]))
        top, bottom = Top(), Or(())
        drop, absorb = (top, bottom) if kind is And else (bottom, top)
        flat = [x for x in flat if x != drop]
        if absorb in flat or any(isinstance(x, Not) and x.shape in flat for x in flat):
            return absorb
        return flat[0] if len(flat) == 1 else (drop if not flat else kind(tuple(flat)))
    if isinstance(s, Xone):
        return Xone(tuple(normalize(x) for x in s.shapes))  # members keep their number
    if isinstance(s, Count):
        inner = normalize(s.shape)
        if s.low <= 0 and s.high is None:
            return Top()
        if s.high is not None and s.low > s.high:
            return Or(())
        if inner == Or(()):
            return Top() if s.low <= 0 else Or(())
        return Count(s.path, s.low, s.high, inner)
    return s


def references(s: Shape, positive: bool = True) -> list[tuple[str, bool]]:
    """(name, whether it is used positively); below a count with an upper bound both signs apply."""
    if isinstance(s, Ref):
        return [(s.name, positive)]
    if isinstance(s, Not):
        return references(s.shape, not positive)
    if isinstance(s, And | Or):
        return [r for x in s.shapes for r in references(x, positive)]
    if isinstance(s, Xone):
        return [r for x in s.shapes for sign in (True, False) for r in references(x, sign)]
    if isinstance(s, Expression):
        return [(n, sign) for n in _named(s.expr) for sign in (True, False)]
    if isinstance(s, Count):
        out = references(s.shape, positive) if s.low > 0 else []
        return out + (references(s.shape, not positive) if s.high is not None else [])
    return []


def _named(expr) -> list[str]:
    """Shapes that the filters of a node expression name."""
    own = [n for n, _ in references(expr.shape)] if isinstance(getattr(expr, "shape", None), Shape) else []
    inner = [*getattr(expr, "parts", ()), *getattr(expr, "args", ()), *([expr.of] if hasattr(expr, "of") else [])]
    return own + [n for x in inner for n in _named(x)]


class NotStratified(ValueError):
    pass


def strata(schema: Schema) -> list[list[str]]:
    """Strongly connected components of shape references, dependencies first; refused if one has a negative loop."""
    edges = {n: references(normalize(schema.formula(n))) for n in schema.shapes}
    index, low, stack, on, out, count = {}, {}, [], set(), [], [0]

    def visit(n):
        index[n] = low[n] = count[0]
        count[0] += 1
        stack.append(n)
        on.add(n)
        for m, _ in edges.get(n, []):
            if m not in edges:
                continue
            if m not in index:
                visit(m)
                low[n] = min(low[n], low[m])
            elif m in on:
                low[n] = min(low[n], index[m])
        if low[n] == index[n]:
            part = []
            while True:
                m = stack.pop()
                on.discard(m)
                part.append(m)
                if m == n:
                    break
            out.append(part)

    for n in sorted(edges):
        if n not in index:
            visit(n)
    for part in out:
        inside, sign, todo = set(part), {part[0]: True}, [part[0]]
        while todo:
            n = todo.pop()
            for m, positive in edges[n]:
                if m in inside and m not in sign:
                    sign[m] = sign[n] == positive
                    todo.append(m)
        if any(sign[m] != (sign[n] == positive) for n in part for m, positive in edges[n] if m in inside):
            raise NotStratified(f"shapes depend negatively on each other: {sorted(part)}")
    return out


def render(s: Shape) -> str:
    """One-line text of a shape."""
    from shapeloom.plans.paths import render as path

    if isinstance(s, Top):
        return "true"
    if isinstance(s, Ref):
        return f"@{s.name}"
    if isinstance(s, Sparql):
        return f"sparql({' '.join(s.text.split())})"
    if isinstance(s, Ask):
        return f"ask({path(s.path)}, {' '.join(s.text.split())})"
    if isinstance(s, Expression):
        return f"expression({s.expr})"
    if isinstance(s, Test):
        return f"{s.facet}({s.value})"
    if isinstance(s, Closed):
        return f"closed({', '.join(s.allowed)})"
    if isinstance(s, Pair):
        return f"{s.kind}({path(s.path)}, {s.pred})"
    if isinstance(s, UniqueLang):
        return f"uniqueLang({path(s.path)})"
    if isinstance(s, Not):
        return f"not {render(s.shape)}"
    if isinstance(s, Count):
        return f"[{s.low}..{'*' if s.high is None else s.high}] {path(s.path)} . {render(s.shape)}"
    word = {And: " and ", Or: " or ", Xone: " xone "}[type(s)]
    return "(" + word.join(map(render, s.shapes)) + ")" if s.shapes else ("true" if isinstance(s, And) else "false")
