import json

from test_sparql import DATA, E, N, P
from test_turtle import PREFIX

from shapeloom.api import Validator, evaluate, validate
from shapeloom.operators import sparql
from shapeloom.sources.results import results_json
from shapeloom.sources.terms import SH
from shapeloom.sources.triples import TripleTable
from shapeloom.sources.turtle import parse

COMPONENT = """
ex:Longer a sh:ConstraintComponent ;
  sh:parameter [ sh:path ex:least ] , [ sh:path ex:note ; sh:optional true ] ;
  sh:validator [ a sh:SPARQLAskValidator ; sh:message "{?value} of {$this} is shorter than {$least}" ; sh:ask "ASK { FILTER (STRLEN(STR($value)) >= $least) }" ] .
ex:Only a sh:ConstraintComponent ; sh:parameter [ sh:path ex:only ] ;
  sh:propertyValidator [ a sh:SPARQLSelectValidator ; sh:select "SELECT $this ?value { $this $PATH ?value FILTER (?value != $only) }" ] .
"""


def rows(spark, text, data, **options):
    return {(r.focus, r.path, r.value, r.component, r.message) for r in Validator(spark, parse(PREFIX + text)).validate(parse(PREFIX + data), "data", **options).rows.collect()}


def test_custom_components(spark):
    shapes = COMPONENT + 'ex:S a sh:NodeShape ; sh:targetNode ex:a, ex:b ; sh:property [ sh:path ex:k ; ex:least 3 ] ; sh:property [ sh:path ex:m ; ex:only 1 ; sh:message "not {$only}" ] .'
    got = rows(spark, shapes, 'ex:a ex:k "ab", "abc" ; ex:m 1, 2 . ex:b ex:k "abcd" ; ex:m 1 .')
    assert got == {(E("a"), E("k"), '"ab"', E("Longer"), "ab of <http://ex/a> is shorter than 3"), (E("a"), E("m"), N(2), E("Only"), "not 1")}
    inner = COMPONENT + "ex:S a sh:NodeShape ; sh:targetNode ex:a, ex:b ; sh:not [ sh:path ex:k ; ex:least 3 ] ."
    assert {r[0] for r in rows(spark, inner, 'ex:a ex:k "ab" . ex:b ex:k "abcd" .')} == {E("b")}


def test_ask_constraints_and_messages(spark):
    shapes = """ex:S a sh:NodeShape ; sh:targetSubjectsOf ex:k ; sh:sparql [ sh:ask "ASK { $this ex:ok true }" ; sh:message "{$this} is not ok {?other}" ] ;
      sh:sparql [ sh:select "SELECT $this ?value ?message { $this ex:k ?value FILTER (?value > 1) BIND (IF(?value > 5, 'very much', ?none) AS ?message) }" ; sh:message "{?value} is much" ] ."""
    got = rows(spark, shapes, "ex:a ex:k 1, 9, 3 ; ex:ok true . ex:b ex:k 1 .")
    name = f"<{SH}SPARQLConstraintComponent>"
    assert got == {(E("b"), None, None, name, "<http://ex/b> is not ok {?other}"), (E("a"), None, N(9), name, "very much"), (E("a"), None, N(3), name, "3 is much")}


FUNCTIONS = """
ex:join a sh:SPARQLFunction ; sh:parameter [ sh:path ex:second ; sh:order 2 ] , [ sh:path ex:first ; sh:order 1 ] ; sh:select "SELECT ?r { BIND (CONCAT($first, '-', $second) AS ?r) }" .
ex:big a sh:SPARQLFunction ; sh:parameter [ sh:path ex:x ] ; sh:ask "ASK { FILTER ($x > 10) }" .
ex:friends a sh:SPARQLFunction ; sh:parameter [ sh:path ex:who ] ; sh:select "SELECT (COUNT(?f) AS ?n) { $who ex:knows ?f }" .
ex:js a sh:JSFunction .
"""


def test_functions(spark):
    f = parse(PREFIX + FUNCTIONS)
    assert evaluate(spark, "ex:join('a', 'b')", f) == '"a-b"'
    assert evaluate(spark, "ex:big(11) && !ex:big(3)", f) == N("true", "boolean")
    shapes = FUNCTIONS + """ex:S a sh:NodeShape ; sh:targetSubjectsOf ex:n ; sh:expression [ ex:big ( [ sh:path ex:n ] ) ] .
      ex:R a sh:NodeShape ; sh:targetSubjectsOf ex:n ; sh:rule [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate ex:count ; sh:object [ ex:friends ( sh:this ) ] ] ."""
    data = "ex:a ex:n 12 ; ex:knows ex:b, ex:c . ex:b ex:n 5 ; ex:knows ex:c . ex:c ex:n 40 ."
    got = rows(spark, shapes, data)
    assert {(r[0], r[2], r[3]) for r in got} == {(E("b"), N("false", "boolean"), f"<{SH}ExpressionConstraintComponent>")}
    from shapeloom.api import infer

    made = infer(spark, parse(PREFIX + data), parse(PREFIX + shapes))
    assert {(r.s, r.o) for r in made.all().collect()} == {(E("a"), N(2)), (E("b"), N(1)), (E("c"), N(0))}
    assert any("JavaScript" in d for d in Validator(spark, f).schema.diagnostics)


def test_entry_shapes_and_the_report_as_a_graph(spark):
    shapes = "ex:S a sh:NodeShape ; sh:targetNode ex:a ; sh:property [ sh:path ex:k ; sh:minCount 1 ] . ex:T a sh:NodeShape ; sh:targetNode ex:b ; sh:nodeKind sh:Literal ."
    assert {r[0] for r in rows(spark, shapes, "ex:a ex:n 1 .", shapes=[E("S")])} == {E("a")}
    report = validate(spark, parse(PREFIX + "ex:a ex:n 1 ."), parse(PREFIX + shapes))
    found = [tuple(r) for r in report.graph().all().collect()]
    of = lambda name: [(s, o) for s, p, o in found if p == f"<{SH}{name}>"]
    assert of("conforms") == [("_:report", N("false", "boolean"))] and len(of("result")) == 2 == len({o for _, o in of("result")})
    assert {o for _, o in of("focusNode")} == {E("a"), E("b")} and len(of("value")) == 1 and len(of("resultMessage")) == 2
    assert {s for s, _ in of("focusNode")} == {o for _, o in of("result")}


def test_default_messages(spark):
    shapes = "ex:S a sh:NodeShape ; sh:targetNode ex:a ; sh:property [ sh:path ex:k ; sh:maxInclusive 3 ; sh:class ex:C ] ."
    assert {r[4] for r in rows(spark, shapes, "ex:a ex:k 5 .")} == {f"5 is not {N(3)} or less", "5 is not an instance of <http://ex/C>"}


def test_results_as_json(spark):
    table = TripleTable.of(spark, parse(DATA))
    found = sparql.query(table, "SELECT ?s ?n ?l { ?s ex:n ?n OPTIONAL { ?s ex:l ?l } FILTER (?s IN (ex:a, ex:d)) } ORDER BY ?s", P)
    got = json.loads("".join(results_json(found)))
    assert got["head"]["vars"] == ["s", "n", "l"]
    assert got["results"]["bindings"] == [
        {"s": {"type": "uri", "value": "http://ex/a"}, "n": {"type": "literal", "value": "1", "datatype": "http://www.w3.org/2001/XMLSchema#integer"}, "l": {"type": "literal", "value": "x", "xml:lang": "en"}},
        {"s": {"type": "uri", "value": "http://ex/d"}, "n": {"type": "literal", "value": "old"}},
    ]
    assert json.loads("".join(results_json(True))) == {"head": {}, "boolean": True}
