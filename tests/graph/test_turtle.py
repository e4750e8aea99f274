import pytest

from shapeloom.plans import paths
from shapeloom.plans.shapes import And, Count, Not, NotStratified, Or, Test, Top, lower, normalize, strata
from shapeloom.sources.terms import Graph, literal, parts
from shapeloom.sources.turtle import TurtleError, parse, serialize

PREFIX = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix ex: <http://ex/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
"""


def test_terms():
    assert parts(literal('a"\\\n')) == ("literal", 'a"\\\n', "http://www.w3.org/2001/XMLSchema#string", None)
    assert parts('"x"@en-GB')[3] == "en-GB" and parts("<http://a>")[0] == "iri" and parts("_:b")[0] == "blank"


def test_turtle():
    g = parse(PREFIX + '''ex:a a ex:B ; ex:p 1, 2.5, 1e3, true, "x"@en, """long "q" """, 'é\\n' . # comment
      ex:l ex:items ( ex:x [ ex:q "1"^^xsd:int ] ) ; ex:n ex:c.d, <rel> . [] ex:p ex:a . ''', base="http://base/")
    assert len(g.objects("<http://ex/a>", "<http://ex/p>")) == 7
    items = g.items(g.value("<http://ex/l>", "<http://ex/items>"))
    assert items[0] == "<http://ex/x>" and g.value(items[1], "<http://ex/q>") == '"1"^^<http://www.w3.org/2001/XMLSchema#int>'
    assert g.objects("<http://ex/l>", "<http://ex/n>") == ["<http://ex/c.d>", "<http://base/rel>"]
    assert parse(serialize(g), label="") and len(parse(serialize(g))) == len(g)
    for bad in ("ex:a ex:p ex:b .", "<a> <b> .", "<a> <b> <c> <d> .", '<a> <b> "x', "<g> { <a> <b> <c> }"):
        with pytest.raises(TurtleError):
            parse(bad)


def test_path_normal_form():
    p, q = paths.Pred("<p>"), paths.Pred("<q>")
    assert paths.normalize(paths.Inv(paths.Seq((p, paths.Star(q))))) == paths.Seq((paths.Star(paths.Inv(q)), paths.Inv(p)))
    assert paths.normalize(paths.Star(paths.Opt(p))) == paths.Star(p) and paths.normalize(paths.Alt((p, p))) == p
    assert paths.render(paths.Seq((p, paths.Alt((q, paths.Inv(p)))))) == "<p>/(<q>|^<p>)"


def test_shape_normal_form():
    a, b = Test("minLength", 1), Test("maxLength", 2)
    assert normalize(Not(And((a, Not(b))))) == Or((Not(a), b))
    assert normalize(Not(Count(paths.Id(), 1, 2))) == Or((Count(paths.Id(), 0, 0), Count(paths.Id(), 3, None)))
    assert normalize(And((a, Top(), a))) == a and normalize(Or((a, Not(a)))) == Top() and normalize(And((a, Not(a)))) == Or(())


def test_stratification():
    loop = lambda body: lower(parse(PREFIX + f"ex:S a sh:NodeShape ; sh:targetNode ex:a ; {body} ."))
    strata(loop("sh:property [ sh:path ex:p ; sh:node ex:S ]"))
    with pytest.raises(NotStratified):
        strata(loop("sh:not [ sh:property [ sh:path ex:p ; sh:minCount 1 ; sh:node ex:S ] ]"))
    assert isinstance(Graph(), Graph)


def test_rdfxml_and_detection():
    from shapeloom.sources import formats

    xml = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://ex/" xml:base="http://base/">
      <ex:C rdf:about="a" ex:note="n"><ex:p rdf:resource="#b"/><ex:q rdf:datatype="http://www.w3.org/2001/XMLSchema#int">5</ex:q><ex:l xml:lang="en">hi</ex:l>
        <ex:items rdf:parseType="Collection"><rdf:Description rdf:about="http://ex/x"/></ex:items><ex:r rdf:parseType="Resource"><ex:z>1</ex:z></ex:r></ex:C></rdf:RDF>"""
    g = formats.parse(xml)
    a = "<http://base/a>"
    assert g.value(a, "<http://ex/p>") == "<http://base/#b>" and g.value(a, "<http://ex/l>") == '"hi"@en' and g.value(a, "<http://ex/note>") == '"n"'
    assert g.value(a, "<http://ex/q>") == '"5"^^<http://www.w3.org/2001/XMLSchema#int>' and g.items(g.value(a, "<http://ex/items>")) == ["<http://ex/x>"]
    assert g.value(g.value(a, "<http://ex/r>"), "<http://ex/z>") == '"1"'
    assert len(formats.parse("{ <a> <b> <c> . <a> <b> 1 }")) == 2 and formats.detect("", "x.rdf") == "xml" and formats.detect("", "", "text/turtle; charset=utf-8") == "turtle"
    with pytest.raises(TurtleError):
        formats.parse("<g> { <a> <b> <c> }")
