"""SPARQL functions and constraint components that a shapes graph declares."""

from __future__ import annotations

import re
from dataclasses import dataclass

from shapeloom.sources.terms import SH, TYPE, Graph, parts

_sh = lambda name: f"<{SH}{name}>"


@dataclass(frozen=True)
class Parameter:
    name: str
    path: str
    optional: bool = False
    order: float = 0.0


@dataclass(frozen=True)
class Function:
    iri: str
    parameters: tuple[Parameter, ...]
    text: str
    prefixes: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Validator:
    kind: str  # ask or select
    text: str
    prefixes: tuple[tuple[str, str], ...]
    messages: tuple[str, ...]


@dataclass(frozen=True)
class CustomComponent:
    iri: str
    parameters: tuple[Parameter, ...]
    validators: dict[str, Validator]  # node, property, any

    def validator(self, on_property: bool) -> Validator | None:
        return self.validators.get("property" if on_property else "node") or self.validators.get("any")


def _text(g: Graph, s: str, name: str) -> str | None:
    found = g.value(s, _sh(name))
    return parts(found)[1] if found is not None else None


def _true(g: Graph, s: str, name: str) -> bool:
    return _text(g, s, name) in ("true", "1")


def parameters_of(g: Graph, s: str) -> tuple[Parameter, ...]:
    """Parameters by sh:order, then by name; a name is the local name of the path unless there is one."""
    out = []
    for p in g.objects(s, _sh("parameter")):
        path = g.value(p, _sh("path"))
        local = re.split(r"[#/:]", path[1:-1])[-1]
        out.append(Parameter(_text(g, p, "name") or local if _is_function(g, s) else local, path, _true(g, p, "optional"), float(_text(g, p, "order") or 0)))
    return tuple(sorted(out, key=lambda x: (x.order, x.name)))


def _is_function(g: Graph, s: str) -> bool:
    return _sh("SPARQLFunction") in g.objects(s, TYPE)


def functions_of(g: Graph) -> dict[str, Function]:
    """SPARQL functions; functions in other languages are not run."""
    from shapeloom.plans.shapes import prefixes_of

    out = {}
    for s in g.subjects(TYPE, _sh("SPARQLFunction")):
        text = _text(g, s, "select") or _text(g, s, "ask")
        if text is not None:
            out[s] = Function(s, parameters_of(g, s), text, prefixes_of(g, s))
    return out


def refused(g: Graph) -> list[str]:
    """Declarations in JavaScript, which is not run."""
    kinds = [_sh(k) for k in ("JSFunction", "JSConstraint", "JSValidator", "JSRule", "JSTarget")]
    return sorted({s for k in kinds for s in g.subjects(TYPE, k)} | {s for s in g.subjects_of(_sh("js"))})


def components_of(g: Graph) -> list[CustomComponent]:
    """Constraint components with validators of their own; the built-in ones are not among them."""
    from shapeloom.plans.shapes import prefixes_of

    out = []
    for s in sorted(g.subjects(TYPE, _sh("ConstraintComponent"))):
        validators = {}
        for key, name in (("node", "nodeValidator"), ("property", "propertyValidator"), ("any", "validator")):
            for v in g.objects(s, _sh(name)):
                for kind in ("ask", "select"):
                    if (text := _text(g, v, kind)) is not None and key not in validators:
                        notes = g.objects(v, _sh("message")) or g.objects(s, _sh("message"))
                        validators[key] = Validator(kind, text, prefixes_of(g, v), tuple(parts(m)[1] for m in notes))
        if validators and not s.startswith(f"<{SH}"):
            out.append(CustomComponent(s, parameters_of(g, s), validators))
    return out


def bind(text: str, values: dict[str, str]) -> str:
    """A query with variables replaced by terms, outside of strings."""
    name = re.compile(r"[$?](" + "|".join(map(re.escape, values)) + r")\b") if values else None
    if name is None:
        return text
    pieces = re.split(r"(\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')", text, flags=re.S)
    return "".join(x if k % 2 else name.sub(lambda m: values[m[1]], x) for k, x in enumerate(pieces))


def inline(f: Function, args: list):
    """The expression that a call of a function stands for; its body must not read a graph."""
    from shapeloom.plans import sparql as Q

    if len(args) != len(f.parameters) and not all(p.optional for p in f.parameters[len(args) :]):
        raise Q.SparqlError(f"{f.iri} takes {len(f.parameters)} arguments")
    q = Q.parse(f.text, dict(f.prefixes))
    known = {p.name: a for p, a in zip(f.parameters, args, strict=False)}

    def swap(e):
        if isinstance(e, Q.Var):
            return known.get(e.name, e)
        if isinstance(e, Q.Call):
            return Q.Call(e.name, [swap(x) for x in e.args], e.distinct, e.separator)
        if isinstance(e, Q.Exists):
            raise Q.SparqlError(f"{f.iri} reads the graph")
        return e

    conditions = []
    for part in q.where.parts:
        if isinstance(part, Q.Bind_):
            known[part.var] = swap(part.expr)
        elif isinstance(part, Q.Filter_):
            conditions.append(swap(part.expr))
        elif not (isinstance(part, Q.Bgp) and not part.triples):
            raise Q.SparqlError(f"{f.iri} reads the graph")
    true = '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'
    both = conditions[0] if conditions else true
    for c in conditions[1:]:
        both = Q.Call("&&", [both, c])
    if q.kind == "ASK":
        return Q.Call("COALESCE", [both, true.replace("true", "false")]) if conditions else true
    name, e = q.items[0]
    result = swap(e) if e is not None else known.get(name, Q.Var("_unbound"))
    return Q.Call("IF", [both, result, Q.Var("_unbound")]) if conditions else result
