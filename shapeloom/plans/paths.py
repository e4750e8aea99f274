"""Property paths, their SHACL syntax and their normal form."""

from __future__ import annotations

from dataclasses import dataclass

from shapeloom.sources.terms import SH, Graph, is_iri


class Path:
    pass


@dataclass(frozen=True)
class Id(Path):
    pass


@dataclass(frozen=True)
class Pred(Path):
    iri: str  # a term: <...>


@dataclass(frozen=True)
class Inv(Path):
    path: Path


@dataclass(frozen=True)
class Seq(Path):
    parts: tuple[Path, ...]


@dataclass(frozen=True)
class Alt(Path):
    parts: tuple[Path, ...]


@dataclass(frozen=True)
class Star(Path):
    path: Path


@dataclass(frozen=True)
class Plus(Path):
    path: Path


@dataclass(frozen=True)
class Opt(Path):
    path: Path


class PathError(ValueError):
    pass


def from_graph(g: Graph, node: str, seen: frozenset = frozenset()) -> Path:
    """The path that a SHACL path node describes."""
    if is_iri(node) and not g.is_list(node):
        return Pred(node)
    if node in seen:
        raise PathError(f"path {node} refers to itself")
    seen |= {node}
    if g.is_list(node):
        items = g.items(node)
        if len(items) < 2:
            raise PathError("a sequence path has two members at least")
        return Seq(tuple(from_graph(g, x, seen) for x in items))
    for name, kind in (("inversePath", Inv), ("zeroOrMorePath", Star), ("oneOrMorePath", Plus), ("zeroOrOnePath", Opt)):
        if (x := g.value(node, f"<{SH}{name}>")) is not None:
            return kind(from_graph(g, x, seen))
    if (x := g.value(node, f"<{SH}alternativePath>")) is not None:
        return Alt(tuple(from_graph(g, y, seen) for y in g.items(x)))
    raise PathError(f"not a path: {node}")


def from_text(text: str, prefixes: dict[str, str] | None = None) -> Path:
    """The path that a SPARQL path text describes; negated property sets are refused."""
    from shapeloom.plans import sparql

    p = sparql._Parser(text, dict(prefixes or {}), {})
    found = p.path()
    if p.kind() != "end":
        raise PathError(f"unexpected {p.peek()!r}")

    def check(x) -> None:
        if isinstance(x, sparql.NotIn):
            raise PathError("negated property sets are no key paths")
        for y in [*getattr(x, "parts", ()), *([x.path] if hasattr(x, "path") else [])]:
            check(y)

    check(found)
    return Pred(found) if isinstance(found, str) else found


def normalize(p: Path) -> Path:
    """Inverses at the leaves, flat sequences and alternatives without repeats, simple closures."""
    if isinstance(p, Inv):
        q = p.path
        if isinstance(q, Inv):
            return normalize(q.path)
        if isinstance(q, Id):
            return q
        if isinstance(q, Seq):
            return normalize(Seq(tuple(Inv(x) for x in reversed(q.parts))))
        if isinstance(q, Alt):
            return normalize(Alt(tuple(Inv(x) for x in q.parts)))
        if isinstance(q, Star | Plus | Opt):
            return normalize(type(q)(Inv(q.path)))
        return p
    if isinstance(p, Seq):
        flat = [y for x in p.parts for n in [normalize(x)] for y in (n.parts if isinstance(n, Seq) else [n]) if not isinstance(y, Id)]
        return Id() if not flat else flat[0] if len(flat) == 1 else Seq(tuple(flat))
    if isinstance(p, Alt):
        flat = dict.fromkeys(y for x in p.parts for n in [normalize(x)] for y in (n.parts if isinstance(n, Alt) else [n]))
        return next(iter(flat)) if len(flat) == 1 else Alt(tuple(flat))
    if isinstance(p, Star | Plus | Opt):
        q = normalize(p.path)
        if isinstance(q, Id):
            return q
        if isinstance(q, Star) or (isinstance(q, Plus | Opt) and isinstance(p, Star)):
            return Star(q.path)
        if isinstance(q, Opt) and isinstance(p, Plus) or isinstance(q, Plus) and isinstance(p, Opt):
            return Star(q.path)
        if isinstance(q, type(p)):
            return q
        return type(p)(q)
    return p


def render(p: Path, top: bool = True) -> str:
    """SPARQL property path text."""
    if isinstance(p, Pred):
        return p.iri
    if isinstance(p, Id):
        return "()"
    if isinstance(p, Inv):
        return "^" + render(p.path, False)
    if isinstance(p, Star | Plus | Opt):
        return render(p.path, False) + {"Star": "*", "Plus": "+", "Opt": "?"}[type(p).__name__]
    text = ("/" if isinstance(p, Seq) else "|").join(render(x, False) for x in p.parts)
    return text if top else f"({text})"


def predicates(p: Path) -> set[str]:
    if isinstance(p, Pred):
        return {p.iri}
    if isinstance(p, Seq | Alt):
        return set().union(*(predicates(x) for x in p.parts))
    return predicates(p.path) if isinstance(p, Inv | Star | Plus | Opt) else set()
