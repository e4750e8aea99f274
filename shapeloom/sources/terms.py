"""Terms as N-Triples strings: ``<iri>``, ``_:label``, ``"lexical"^^<datatype>``, ``"lexical"@lang``.

A term is its string, on the driver and in columns: equal terms, equal strings.  Plain literals
carry no datatype; xsd:string is dropped, so that both spellings are one term.
"""

from __future__ import annotations

import re

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SH = "http://www.w3.org/ns/shacl#"
TYPE, FIRST, REST, NIL = (f"<{RDF}{x}>" for x in ("type", "first", "rest", "nil"))
SUBCLASS = f"<{RDFS}subClassOf>"

_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_UNESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_PLAIN = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?', re.S)


def iri(x: str) -> str:
    return f"<{x}>"


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), text)


def literal(lexical: str, datatype: str | None = None, lang: str | None = None) -> str:
    out = '"' + "".join(_ESCAPES.get(c, c) for c in lexical) + '"'
    if lang:
        return f"{out}@{lang}"
    return out if datatype in (None, XSD + "string") else f"{out}^^<{datatype}>"


def parts(term: str) -> tuple[str, str, str | None, str | None]:
    """(kind, lexical or IRI, datatype, lang); kind is iri, blank or literal."""
    if term.startswith("<"):
        return "iri", term[1:-1], None, None
    if term.startswith("_:"):
        return "blank", term[2:], None, None
    m = LITERAL.fullmatch(term)
    if not m:
        raise ValueError(f"not a term: {term}")
    lang = m[3]
    return "literal", unescape(m[1]), (RDF + "langString" if lang else m[2] or XSD + "string"), lang


def is_iri(term: str) -> bool:
    return term.startswith("<")


def is_blank(term: str) -> bool:
    return term.startswith("_:")


def is_literal(term: str) -> bool:
    return term.startswith('"')


class Graph:
    """A small graph on the driver: shapes, rules, expectations."""

    def __init__(self, triples=(), prefixes: dict[str, str] | None = None):
        self.triples: dict[tuple[str, str, str], None] = {}
        self.prefixes = dict(prefixes or {})
        self._out: dict[tuple[str, str], list[str]] = {}
        self._in: dict[tuple[str, str], list[str]] = {}
        for t in triples:
            self.add(*t)

    def add(self, s: str, p: str, o: str) -> None:
        if (s, p, o) not in self.triples:
            self.triples[s, p, o] = None
            self._out.setdefault((s, p), []).append(o)
            self._in.setdefault((p, o), []).append(s)

    def objects(self, s: str, p: str) -> list[str]:
        return self._out.get((s, p), [])

    def value(self, s: str, p: str) -> str | None:
        found = self.objects(s, p)
        return found[0] if found else None

    def subjects(self, p: str, o: str) -> list[str]:
        return self._in.get((p, o), [])

    def subjects_of(self, p: str) -> list[str]:
        return list(dict.fromkeys(s for s, q, _ in self.triples if q == p))

    def items(self, head: str) -> list[str]:
        """Members of an rdf:List; a loop ends it."""
        out, seen = [], set()
        while head != NIL and head not in seen:
            seen.add(head)
            first = self.value(head, FIRST)
            if first is None:
                break
            out.append(first)
            head = self.value(head, REST) or NIL
        return out

    def is_list(self, node: str) -> bool:
        return node == NIL or self.value(node, FIRST) is not None

    def union(self, other: Graph) -> Graph:
        return Graph([*self.triples, *other.triples], self.prefixes | other.prefixes)

    def __len__(self) -> int:
        return len(self.triples)
