"""RDF/XML text to a driver-side graph."""

from __future__ import annotations

import itertools
import xml.etree.ElementTree as ET
from urllib.parse import urljoin

from shapeloom.sources.terms import FIRST, NIL, RDF, REST, TYPE, Graph, literal
from shapeloom.sources.turtle import TurtleError

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + RDF + "}"
_SYNTAX = {_R + x for x in ("about", "ID", "nodeID", "resource", "parseType", "datatype", "li")}
_sources = itertools.count()


def parse(text: str, base: str = "") -> Graph:
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise TurtleError(f"not XML: {e}") from e
    p = _Parser(f"x{next(_sources)}")
    base = root.get(_XML + "base", base)
    for e in list(root) if root.tag == _R + "RDF" else [root]:
        p.node(e, base, root.get(_XML + "lang", ""))
    return p.graph


class _Parser:
    def __init__(self, label: str):
        self.graph, self.label, self.count = Graph(), label, 0

    def fresh(self) -> str:
        self.count += 1
        return f"_:{self.label}n{self.count}"

    @staticmethod
    def iri(tag: str) -> str:
        return "<" + tag.replace("{", "", 1).replace("}", "", 1) + ">"

    def node(self, e: ET.Element, base: str, lang: str) -> str:
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
        if (x := e.get(_R + "about")) is not None:
            s = f"<{urljoin(base, x)}>"
        elif (x := e.get(_R + "ID")) is not None:
            s = f"<{urljoin(base, '#' + x)}>"
        elif (x := e.get(_R + "nodeID")) is not None:
            s = f"_:{self.label}{x}"
        else:
            s = self.fresh()
        if e.tag != _R + "Description":
            self.graph.add(s, TYPE, self.iri(e.tag))
        self.attributes(s, e, base, lang)
        number = 0
        for c in e:
            tag = c.tag
            if tag == _R + "li":
                number += 1
                tag = f"{_R}_{number}"
            self.property(s, self.iri(tag), c, base, lang)
        return s

    def attributes(self, s: str, e: ET.Element, base: str, lang: str) -> None:
        for k, v in e.attrib.items():
            if k == _R + "type":
                self.graph.add(s, TYPE, f"<{urljoin(base, v)}>")
            elif k not in _SYNTAX and not k.startswith(_XML) and k.startswith("{"):
                self.graph.add(s, self.iri(k), literal(v, lang=lang or None))

    def property(self, s: str, p: str, e: ET.Element, base: str, lang: str) -> None:
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
        kind = e.get(_R + "parseType")
        if kind == "Collection":
            items = [self.node(c, base, lang) for c in e]
            head = NIL
            for x in reversed(items):
                cell = self.fresh()
                self.graph.add(cell, FIRST, x)
                self.graph.add(cell, REST, head)
                head = cell
            o = head
        elif kind == "Resource":
            o = self.fresh()
            for c in e:
                self.property(o, self.iri(c.tag), c, base, lang)
        elif kind == "Literal":
            inner = (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e)
            o = literal(inner, RDF + "XMLLiteral")
        elif len(e):
            o = self.node(e[0], base, lang)
        elif (x := e.get(_R + "resource")) is not None:
            o = f"<{urljoin(base, x)}>"
            self.attributes(o, e, base, lang)
        elif (x := e.get(_R + "nodeID")) is not None:
            o = f"_:{self.label}{x}"
        elif any(k not in _SYNTAX and not k.startswith(_XML) for k in e.attrib) and not (e.text or "").strip():
            o = self.fresh()
            self.attributes(o, e, base, lang)
        else:
            datatype = e.get(_R + "datatype")
            o = literal(e.text or "", urljoin(base, datatype) if datatype else None, None if datatype else lang or None)
        self.graph.add(s, p, o)
