import pytest
from test_turtle import PREFIX

from shapeloom.operators import sparql
from shapeloom.plans.sparql import SparqlError, parse
from shapeloom.sources.triples import TripleTable
from shapeloom.sources.turtle import parse as turtle

P = {"ex": "http://ex/", "xsd": "http://www.w3.org/2001/XMLSchema#"}
DATA = PREFIX + """ex:a ex:p ex:b, ex:c ; ex:n 1 ; ex:l "x"@en . ex:b ex:p ex:c ; ex:n 2.50 . ex:c ex:n "1"^^xsd:integer ; ex:q ex:a . ex:d ex:n "old" ."""
#: (query, expected rows as terms; None: unbound)
E = lambda x: f"<http://ex/{x}>"
N = lambda x, k="integer": f'"{x}"^^<http://www.w3.org/2001/XMLSchema#{k}>'
CASES = {
    "equality by value": ("SELECT ?s { ?s ex:n ?n FILTER (?n = 1.0) }", [(E("a"),), (E("c"),)]),
    "error is dropped": ("SELECT ?s { ?s ex:n ?n FILTER (?n * 2 > 1) }", [(E("a"),), (E("b"),), (E("c"),)]),
    "unbound in optional": ("SELECT ?s ?q { ?s ex:n ?n OPTIONAL { ?s ex:q ?q } FILTER (!bound(?q)) }", [(E("a"), None), (E("b"), None), (E("d"), None)]),
    "null-compatible join": ("SELECT ?s ?q { { ?s ex:n 1 OPTIONAL { ?s ex:q ?q } } { ?x ex:p ex:b . ?q ex:n 1 } }", [(E("a"), E("a")), (E("a"), E("c")), (E("c"), E("a"))]),
    "closure": ("SELECT ?y { ex:a (ex:p|ex:q)+ ?y }", [(E("a"),), (E("b"),), (E("c"),)]),
    "zero length of an absent node": ("SELECT ?y { ex:nothing ex:p* ?y }", [(E("nothing"),)]),
    "negated set": ("SELECT ?o { ex:a !(ex:p|ex:n) ?o }", [('"x"@en',)]),
    "inverse sequence": ("SELECT ?x { ex:c ^ex:p/ex:n ?x }", [(N(1),), (N("2.50", "decimal"),)]),
    "sum and average": ("SELECT (SUM(?n) AS ?s) (AVG(?n) AS ?a) { ?x ex:n ?n FILTER (?x != ex:d) }", [(N("4.5", "decimal"), N("1.5", "decimal"))]),
    "group concat": ("SELECT ?s (GROUP_CONCAT(STR(?o) ; SEPARATOR = '|') AS ?g) { ?s ex:p ?o } GROUP BY ?s", [(E("a"), '"http://ex/b|http://ex/c"'), (E("b"), '"http://ex/c"')]),
    "exists with outer value": ("SELECT ?s { ?s ex:n ?n FILTER EXISTS { ?s ex:p ?o . ?o ex:n ?m FILTER (?m > ?n) } }", [(E("a"),)]),
    "casts": ("SELECT ?x { BIND (xsd:integer('7') + xsd:decimal('0.5') AS ?x) }", [(N("7.5", "decimal"),)]),
    "three-valued or": ("SELECT ?s { ?s ex:n ?n FILTER (?n > 2 || ?s = ex:d) }", [(E("b"),), (E("d"),)]),
    "minus without shared": ("SELECT ?s { ?s ex:q ?o MINUS { ?z ex:p ?w } }", [(E("c"),)]),
    "values undef": ("SELECT ?s ?n { VALUES (?s ?n) { (ex:a UNDEF) (UNDEF 2.50) } ?s ex:n ?n }", [(E("a"), N(1)), (E("b"), N("2.50", "decimal"))]),
}


@pytest.fixture(scope="module")
def graph(spark):
    return TripleTable.of(spark, turtle(DATA))


@pytest.mark.parametrize("name", CASES)
def test_select(graph, name):
    text, want = CASES[name]
    got = [tuple(r) for r in sparql.select(graph, text, P).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_forms(graph, spark):
    assert sparql.ask(graph, "ASK { ex:a ex:p ex:b }", P) and not sparql.ask(graph, "ASK { ex:b ex:p ex:a }", P)
    made = sparql.construct(graph, "CONSTRUCT { ?o ex:of ?s . ?n ex:bad ?s . ?s ex:new _:b } { ?s ex:p ?o ; ex:n ?n }", P).collect()
    assert {(r.s, r.o) for r in made} == {(E("b"), E("a")), (E("c"), E("a")), (E("c"), E("b"))}
    foci = spark.createDataFrame([(E("a"),), (E("b"),)], "this string")
    got = sparql.select(graph, "SELECT ?this ?o { ?this ex:p ?o } ORDER BY DESC(?o) LIMIT 1", P, this=foci).collect()
    assert {tuple(r) for r in got} == {(E("a"), E("c")), (E("b"), E("c"))}


def test_refusals():
    for bad in ("SELECT ?x { SERVICE <http://x> { ?x ?y ?z } }", "SELECT ?x { ?x zz:p ?y }", "DESCRIBE <x>", "SELECT ?x { ?x ?y }"):
        with pytest.raises(SparqlError):
            parse(bad, P)


def test_one_group_for_every_focus(graph, spark):
    foci = spark.createDataFrame([(E("a"),), (E("c"),), (E("nowhere"),)], "v string")
    rows = sparql.select(graph, "SELECT (COUNT(?x) AS ?n) (SUM(?x) AS ?t) (MIN(?x) AS ?m) { $this ex:p ?x }", P, this=foci).collect()
    assert {(r.this, r.n, r.t, r.m) for r in rows if r.this != E("a")} == {(E("c"), N(0), N(0), None), (E("nowhere"), N(0), N(0), None)}
    assert [r.n for r in rows if r.this == E("a")] == [N(2)]


def test_unbound_variables_need_no_nested_loop(graph):
    rows = sparql.select(graph, "SELECT ?s ?q ?x { { ?s ex:n ?n OPTIONAL { ?s ex:q ?q } } { ?s ex:p ?x OPTIONAL { ?s ex:q ?q } } }", P)
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(E("a"), None, E("b")), (E("a"), None, E("c")), (E("b"), None, E("c"))], key=str)
    assert "NestedLoop" not in rows._jdf.queryExecution().executedPlan().toString()


def test_relative_iris_need_a_base():
    with pytest.raises(SparqlError, match="BASE"):
        parse("SELECT ?x { ?x <p> ?y }", P)
    assert parse("BASE <http://x/> DESCRIBE <a>", P).template == ["<http://x/a>"]
    assert parse("DESCRIBE <http://x/a>", P).template == ["<http://x/a>"]
