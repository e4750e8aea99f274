"""Which parser reads a text: by media type, by file name, by a look at its start, else by trying all."""

from __future__ import annotations

import re
from urllib.request import urlopen

from shapeloom.sources import rdfxml, turtle
from shapeloom.sources.terms import Graph

EXTENSIONS = {"ttl": "turtle", "nt": "turtle", "n3": "turtle", "nq": "turtle", "trig": "turtle", "rdf": "xml", "owl": "xml", "xml": "xml"}
MEDIA = {"text/turtle": "turtle", "application/n-triples": "turtle", "application/n-quads": "turtle", "application/trig": "turtle", "text/n3": "turtle", "application/rdf+xml": "xml"}
PARSERS = {"turtle": turtle.parse, "xml": rdfxml.parse}


def detect(text: str, name: str = "", media: str = "") -> str | None:
    media = media.split(";")[0].strip().lower()
    if media in MEDIA:
        return MEDIA[media]
    extension = name.rsplit("?", 1)[0].rsplit(".", 1)[-1].lower() if "." in name else ""
    if extension in EXTENSIONS:
        return EXTENSIONS[extension]
    start = text[:4096].lstrip()
    if re.match(r"<\?xml|<rdf:RDF|<!DOCTYPE", start):
        return "xml"
    return "turtle" if re.match(r"@prefix|@base|PREFIX|BASE|<[^>\s]*>\s|_:|#", start, re.I) else None


def parse(text: str, base: str = "", name: str = "", media: str = "") -> Graph:
    found = detect(text, name, media)
    errors = []
    for kind in [found] if found else list(PARSERS):
        try:
            return PARSERS[kind](text, base)
        except turtle.TurtleError as e:
            errors.append(e)
    raise errors[-1]


def read(source: str) -> Graph:
    """A graph from a file path or an http(s) address."""
    if re.match(r"https?://", source):
        with urlopen(source) as f:  # noqa: S310
            return parse(f.read().decode(), source, source, f.headers.get("Content-Type", ""))
    with open(source, encoding="utf-8") as f:
        return parse(f.read(), "", source)
