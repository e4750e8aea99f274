import re

import pytest
from test_turtle import PREFIX

from shapeloom.api import Validator, apply_delta, gate, validate
from shapeloom.sources.terms import SH
from shapeloom.sources.triples import TripleTable, read_ntriples, write_ntriples
from shapeloom.sources.turtle import parse

#: (shapes and data, expected (focus, path, value, component))
CASES = {
    "minCount": ("ex:S a sh:NodeShape ; sh:targetClass ex:P ; sh:targetNode ex:gone ; sh:property [ sh:path ex:n ; sh:minCount 1 ] . ex:a a ex:P ; ex:n 1 . ex:b a ex:P .", {("b", "n", None, "MinCount"), ("gone", "n", None, "MinCount")}),
    "maxCount": ("ex:S sh:targetSubjectsOf ex:n ; sh:property [ sh:path ex:n ; sh:maxCount 1 ] . ex:a ex:n 1, 2 . ex:b ex:n 1 .", {("a", "n", None, "MaxCount")}),
    "class": ("ex:S sh:targetNode ex:a ; sh:property [ sh:path ex:k ; sh:class ex:C ] . ex:D rdfs:subClassOf ex:C . ex:a ex:k ex:x, ex:y, 'z' . ex:x a ex:D . ex:y a ex:E .", {("a", "k", "y", "Class"), ("a", "k", "z", "Class")}),
    "datatype": ("ex:S sh:targetNode ex:a ; sh:property [ sh:path ex:k ; sh:datatype xsd:byte ] . ex:a ex:k '5'^^xsd:byte, '300'^^xsd:byte, 5, 'x'^^xsd:byte .", {("a", "k", "300", "Datatype"), ("a", "k", "5", "Datatype"), ("a", "k", "x", "Datatype")}),
    "ranges": ("ex:S sh:targetNode ex:a ; sh:property [ sh:path ex:k ; sh:minInclusive 1 ; sh:maxExclusive 4.5 ] . ex:a ex:k 0, 1, 4, '4.5'^^xsd:decimal, 'x', '1e0'^^xsd:double .", {("a", "k", "0", "MinInclusive"), ("a", "k", "4.5", "MaxExclusive"), ("a", "k", "x", "MinInclusive"), ("a", "k", "x", "MaxExclusive")}),
    "dates": ("ex:S sh:targetNode ex:a ; sh:property [ sh:path ex:k ; sh:minExclusive '2019-03-07T08:30:00-03:00'^^xsd:dateTime ] . ex:a ex:k '2019-03-07T08:30:01-03:00'^^xsd:dateTime, '2019-03-07T08:30:00'^^xsd:dateTime, '2019-03-06T08:30:00-03:00'^^xsd:dateTime .", {("a", "k", "2019-03-07T08:30:00", "MinExclusive"), ("a", "k", "2019-03-06T08:30:00-03:00", "MinExclusive")}),
    "lengths": ("ex:S sh:targetNode ex:a ; sh:property [ sh:path ex:k ; sh:minLength 2 ; sh:maxLength 3 ] . ex:a ex:k 'a', 'éé', 'abcd', _:b .", {("a", "k", "a", "MinLength"), ("a", "k", "abcd", "MaxLength"), ("a", "k", "*", "MinLength"), ("a", "k", "*", "MaxLength")}),
    "pattern": ("ex:S sh:targetNode ex:a ; sh:property [ sh:path ex:k ; sh:pattern '^joh' ; sh:flags 'i' ] . ex:a ex:k 'John', 'x' .", {("a", "k", "x", "Pattern")}),
    "languages": ("ex:S sh:targetNode ex:a ; sh:property [ sh:path ex:k ; sh:languageIn ( 'en' 'mi' ) ; sh:uniqueLang true ] . ex:a ex:k 'a'@en, 'b'@EN-nz, 'c'@de, 'd', 'e'@en .", {("a", "k", "c", "LanguageIn"), ("a", "k", "d", "LanguageIn"), ("a", "k", None, "UniqueLang")}),
    "nodeKind": ("ex:S sh:targetNode ex:a ; sh:property [ sh:path ex:k ; sh:nodeKind sh:BlankNodeOrIRI ] . ex:a ex:k 'l', ex:i, [] .", {("a", "k", "l", "NodeKind")}),
    "in and hasValue": ("ex:S sh:targetNode ex:a ; sh:property [ sh:path ex:k ; sh:in ( ex:x 1 ) ; sh:hasValue ex:q ] . ex:a ex:k ex:x, 1, '1' .", {("a", "k", "1", "In"), ("a", "k", None, "HasValue")}),
    "not": ("ex:S sh:targetNode ex:a, ex:b ; sh:not [ sh:property [ sh:path ex:k ; sh:minCount 1 ] ] . ex:a ex:k 1 .", {("a", None, "a", "Not")}),
    "and or": ("ex:S sh:targetNode ex:a ; sh:and ( [ sh:property [ sh:path ex:k ; sh:minCount 1 ] ] ) ; sh:or ( [ sh:class ex:C ] [ sh:nodeKind sh:IRI ] ) .", {("a", None, "a", "And")}),
    "xone twice": ("ex:S sh:targetNode ex:a ; sh:xone ( ex:T ex:T ) . ex:T a sh:NodeShape ; sh:nodeKind sh:IRI .", {("a", None, "a", "Xone")}),
    "node": ("ex:S sh:targetNode ex:a ; sh:property [ sh:path ex:k ; sh:node ex:T ] . ex:T sh:property [ sh:path ex:m ; sh:minCount 1 ] . ex:a ex:k ex:b, ex:c . ex:b ex:m 1 .", {("a", "k", "c", "Node")}),
    "nested property": ("ex:S sh:targetNode ex:a ; sh:property [ sh:path ex:k ; sh:property [ sh:path ex:m ; sh:minCount 1 ] ] . ex:a ex:k ex:b, ex:c . ex:b ex:m 1 .", {("c", "m", None, "MinCount")}),
    "closed": ("ex:S sh:targetNode ex:a ; sh:closed true ; sh:ignoredProperties ( rdf:type ) ; sh:property [ sh:path ex:k ] . ex:a a ex:C ; ex:k 1 ; ex:z 2 .", {("a", "z", "2", "Closed")}),
    "pairs": ("ex:S sh:targetNode ex:a ; sh:property [ sh:path ex:k ; sh:equals ex:m ; sh:disjoint ex:d ; sh:lessThan ex:l ] . ex:a ex:k 1, 2 ; ex:m 2, 3 ; ex:d 1 ; ex:l 2, 3 .", {("a", "k", "1", "Equals"), ("a", "k", "3", "Equals"), ("a", "k", "1", "Disjoint"), ("a", "k", "2", "LessThan")}),
    "qualified": ("ex:S sh:targetNode ex:a ; sh:property [ sh:path ex:k ; sh:qualifiedValueShape [ sh:class ex:C ] ; sh:qualifiedMinCount 2 ; sh:qualifiedMaxCount 3 ] . ex:a ex:k ex:x, ex:y . ex:x a ex:C .", {("a", "k", None, "QualifiedMinCount")}),
    "qualified siblings": ("ex:S sh:targetNode ex:h ; sh:property ex:A, ex:B . ex:A sh:path ex:d ; sh:qualifiedValueShape [ sh:class ex:T ] ; sh:qualifiedValueShapesDisjoint true ; sh:qualifiedMinCount 1 . ex:B sh:path ex:d ; sh:qualifiedValueShape [ sh:class ex:F ] ; sh:qualifiedValueShapesDisjoint true ; sh:qualifiedMinCount 1 . ex:h ex:d ex:x . ex:x a ex:T, ex:F .", {("h", "d", None, "QualifiedMinCount")}),
    "paths": ("ex:S sh:targetNode ex:a ; sh:property [ sh:path ( [ sh:zeroOrMorePath ex:p ] [ sh:alternativePath ( ex:q [ sh:inversePath ex:r ] ) ] ) ; sh:in ( ex:ok ) ] . ex:a ex:p ex:b . ex:b ex:p ex:a ; ex:q ex:bad1 . ex:bad2 ex:r ex:a . ex:b ex:q ex:ok .", {("a", "*", "bad1", "In"), ("a", "*", "bad2", "In")}),
    "implicit class": ("ex:C a rdfs:Class, sh:NodeShape ; sh:property [ sh:path ex:k ; sh:minCount 1 ] . ex:D rdfs:subClassOf ex:C . ex:a a ex:D .", {("a", "k", None, "MinCount")}),
    "deactivated": ("ex:S sh:targetNode ex:a ; sh:deactivated true ; sh:nodeKind sh:Literal . ex:T sh:targetNode ex:a ; sh:property [ sh:path ex:k ; sh:minCount 1 ; sh:deactivated true ] .", set()),
    "recursive": ("ex:S sh:targetNode ex:a, ex:c ; sh:property [ sh:path ex:next ; sh:node ex:T ] . ex:T sh:property [ sh:path ex:next ; sh:node ex:T ] ; sh:nodeKind sh:IRI . ex:a ex:next ex:b . ex:b ex:next ex:a . ex:c ex:next ex:d . ex:d ex:next 'end' .", {("c", "next", "d", "Node")}),
}


def local(t):
    if t is None:
        return None
    if t.startswith("_:"):
        return "*"
    return re.split(r"[/#]", t.strip("<>"))[-1] if t.startswith("<") else re.match(r'"(.*?)"', t)[1]


@pytest.mark.parametrize("name", CASES)
def test_report(spark, name):
    text, want = CASES[name]
    result = validate(spark, PREFIX + text)
    got = {(local(r.focus), local(r.path), local(r.value), local(r.component).removesuffix("ConstraintComponent")) for r in result.rows.collect()}
    assert got == want and result.conforms == (not want) and not result.diagnostics


def test_modes_and_severity(spark):
    shapes = PREFIX + "ex:S sh:targetClass ex:C ; sh:severity sh:Warning ; sh:message 'need k' ; sh:property [ sh:path ex:k ; sh:minCount 1 ; sh:severity sh:Warning ] . ex:D rdfs:subClassOf ex:C . ex:own a ex:C ."
    data = PREFIX + "ex:a a ex:D ."
    v = Validator(spark, shapes)
    assert [local(r.focus) for r in v.validate(data).rows.collect()] == ["a"]
    assert v.validate(data, mode="data").rows.count() == 0
    assert sorted(local(r.focus) for r in v.validate(data, mode="union-all").rows.collect()) == ["a", "own"]
    assert not v.validate(data).conforms and v.validate(data, minimum="Violation").conforms
    assert v.validate(data).rows.first().message == "need k" and v.validate(data).rows.first().severity == f"<{SH}Warning>"


def test_delta_and_gate(spark):
    v = Validator(spark, PREFIX + "ex:S sh:targetSubjectsOf ex:k ; sh:property [ sh:path ex:k ; sh:maxCount 1 ] .")
    graph = TripleTable.of(spark, parse(PREFIX + "ex:a ex:k 1, 2 . ex:b ex:k 1 ."))
    delta = lambda t: TripleTable.of(spark, parse(PREFIX + t))
    after = apply_delta(graph, delta("ex:b ex:k 5 ."), delta("ex:a ex:k 2 ."))
    got = gate(v.validate(graph).rows, v.validate(after).rows).collect()
    assert {(local(r.focus), r.status) for r in got} == {("a", "fixed"), ("b", "introduced")}


def test_ntriples_files(spark, tmp_path):
    g = TripleTable.of(spark, parse(PREFIX + 'ex:a ex:k "x \\"q\\" \\n", "y"@en, 3 . _:b ex:k ex:a .'))
    write_ntriples(g, str(tmp_path / "out"))
    back = read_ntriples(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.all().collect())) == sorted(map(tuple, g.all().collect()))


def test_plans_grow_with_the_number_of_members(spark):
    from shapeloom.operators.shapes import Compiler
    from shapeloom.plans.paths import Pred
    from shapeloom.plans.shapes import And, Count, Or, Xone

    table = TripleTable(spark.createDataFrame([(f"<s{k % 7}>", f"<p{k % 5}>", f"<o{k}>") for k in range(60)], "s string, p string, o string"))
    nodes = table.nodes()

    def lines(kind, n):
        shape = kind(tuple(Count(Pred(f"<p{k}>"), 1 + k % 2, None if k % 3 else 9) for k in range(n)))
        return Compiler(table).sat(shape, nodes)._jdf.queryExecution().optimizedPlan().toString().count("\n")

    for kind in (And, Or, Xone):
        small, large = lines(kind, 5), lines(kind, 30)
        assert large < 7 * small, (kind, small, large)


def test_recursion_over_nodes_that_the_graph_lacks(spark):
    """What a recursive shape says of a node does not depend on who asked before."""
    shapes = "ex:A a sh:NodeShape ; sh:targetClass ex:P ; sh:node ex:Rec . ex:B a sh:NodeShape ; sh:targetNode ex:absent ; sh:node ex:Rec . ex:Rec a sh:NodeShape ; sh:property [ sh:path ex:next ; sh:node ex:Rec ; sh:maxCount 1 ] . "
    data = "ex:a a ex:P ; ex:next ex:b . ex:b ex:next ex:c, ex:d ."
    got = validate(spark, parse(PREFIX + data), parse(PREFIX + shapes), mode="data").rows.collect()
    assert {r.focus for r in got} == {"<http://ex/a>"}
