"""Turtle, N-Triples, TriG and N-Quads text to a driver-side graph; named graphs are refused."""

from __future__ import annotations

import itertools
import re
from urllib.parse import urljoin

from shapeloom.sources.terms import FIRST, NIL, REST, TYPE, XSD, Graph, literal, unescape

_TOKEN = re.compile(
    r"""(?P<skip>[ \t\r\n]+|\#[^\r\n]*)
  | (?P<iri><[^\x00-\x20<>"{}|^`]*>)
  | (?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
  | (?P<string>"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')
  | (?P<blank>_:[\w][\w.\-·]*(?<!\.))
  | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<double>[+-]?(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+)
  | (?P<decimal>[+-]?\d*\.\d+)
  | (?P<integer>[+-]?\d+)
  | (?P<name>(?:[^\W\d_][\w\-·.]*)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:[\w:.\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*)?)
  | (?P<word>[A-Za-z]+)
  | (?P<mark>\^\^|[\[\](){}.;,])""",
    re.X | re.S,
)
_sources = itertools.count()


class TurtleError(ValueError):
    pass


def parse(text: str, base: str = "", label: str | None = None) -> Graph:
    """The graph of a Turtle document (N-Triples is a subset); blank labels get a prefix of their source."""
    return _Parser(text, base, label if label is not None else f"g{next(_sources)}").run()


class _Parser:
    def __init__(self, text: str, base: str, label: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TurtleError(f"unexpected text at line {text.count(chr(10), 0, at) + 1}: {text[at : at + 30]!r}")
            at = m.end()
            if m.lastgroup == "name" and m[0].endswith("."):  # a trailing dot ends the statement
                name = m[0].rstrip(".")
                at -= len(m[0]) - len(name)
                self.tokens.append(("name", name))
            elif m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
        self.tokens.append(("end", ""))
        self.i, self.base, self.label, self.count = 0, base, label, 0
        self.graph = Graph()

    def peek(self) -> str:
        return self.tokens[self.i][1]

    def next(self) -> tuple[str, str]:
        self.i += 1
        return self.tokens[self.i - 1]

    def take(self, mark: str) -> bool:
        if self.tokens[self.i] == ("mark", mark):
            self.i += 1
            return True
        return False

    def expect(self, mark: str) -> None:
        if not self.take(mark):
            raise TurtleError(f"expected {mark!r}, found {self.peek()!r}")

    def fresh(self) -> str:
        self.count += 1
        return f"_:{self.label}n{self.count}"

    def run(self) -> Graph:
        while self.tokens[self.i][0] != "end":
            kind, value = self.tokens[self.i]
            if (kind, value.lower()) in (("at", "@prefix"), ("word", "prefix")):
                self.next()
                name = self.next()[1][:-1]
                self.graph.prefixes[name] = self.resolve(self.next()[1])
                self.directive_end(kind)
            elif (kind, value.lower()) in (("at", "@base"), ("word", "base")):
                self.next()
                self.base = self.resolve(self.next()[1])
                self.directive_end(kind)
            elif self.take("{"):  # the default graph of a TriG document
                while not self.take("}"):
                    self.statement(inside=True)
            else:
                self.statement()
        return self.graph

    def directive_end(self, kind: str) -> None:
        if kind == "at":
            self.expect(".")

    def statement(self, inside: bool = False) -> None:
        if self.peek() == "{" or (self.tokens[self.i + 1] == ("mark", "{")):
            raise TurtleError("named graphs are not supported")
        bracket = self.peek() == "["
        subject = self.node()
        if not (bracket and self.peek() in (".", "}")):
            self.properties(subject)
        if inside and self.peek() == "}":
            return
        if self.peek() != ".":
            raise TurtleError(f"expected '.', found {self.peek()!r} (a fourth term names a graph, which is not supported)")
        self.expect(".")

    def properties(self, subject: str) -> None:
        while True:
            kind, value = self.tokens[self.i]
            if (kind, value) == ("word", "a"):
                self.next()
                verb = TYPE
            else:
                verb = self.node()
            while True:
                self.graph.add(subject, verb, self.node())
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.peek() in (".", "]", "}"):
                return

    def resolve(self, ref: str) -> str:
        found = unescape(ref[1:-1])
        return urljoin(self.base, found) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", found) else found

    def node(self) -> str:
        kind, value = self.next()
        if kind == "iri":
            return f"<{self.resolve(value)}>"
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.graph.prefixes:
                raise TurtleError(f"unknown prefix {prefix!r}")
            return f"<{self.graph.prefixes[prefix]}{re.sub(chr(92) * 2 + '(.)', r'\1', local)}>"
        if kind == "blank":
            return f"_:{self.label}{value[2:]}"
        if kind in ("string", "long"):
            text = unescape(value[3:-3] if kind == "long" else value[1:-1])
            if self.tokens[self.i][0] == "at":
                return literal(text, lang=self.next()[1][1:])
            if self.take("^^"):
                return literal(text, self.node()[1:-1])
            return literal(text)
        if kind in ("integer", "decimal", "double"):
            return literal(value, XSD + kind)
        if kind == "word" and value in ("true", "false"):
            return literal(value, XSD + "boolean")
        if value == "[":
            node = self.fresh()
            if not self.take("]"):
                self.properties(node)
                self.expect("]")
            return node
        if value == "(":
            items = []
            while not self.take(")"):
                items.append(self.node())
            head = NIL
            for x in reversed(items):
                cell = self.fresh()
                self.graph.add(cell, FIRST, x)
                self.graph.add(cell, REST, head)
                head = cell
            return head
        raise TurtleError(f"unexpected {value!r}")


def serialize(graph: Graph) -> str:
    """N-Triples lines, sorted."""
    return "".join(f"{s} {p} {o} .\n" for s, p, o in sorted(graph.triples))
