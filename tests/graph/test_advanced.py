from test_report import local
from test_turtle import PREFIX

from shapeloom.api import infer, validate

DECLARE = "ex: sh:declare [ sh:prefix 'ex' ; sh:namespace 'http://ex/'^^xsd:anyURI ] . "


def rows(spark, text):
    return {(local(r.focus), local(r.path), local(r.value), local(r.component)) for r in validate(spark, PREFIX + DECLARE + text).rows.collect()}


def test_sparql_constraints(spark):
    text = """ex:S sh:targetClass ex:C ; sh:sparql [ sh:prefixes ex: ; sh:message 'not German' ; sh:select "SELECT $this ?value { $this ex:l ?value FILTER (!isLiteral(?value) || !langMatches(lang(?value), 'de')) }" ] .
      ex:P sh:targetClass ex:C ; sh:property [ sh:path ex:l ; sh:sparql [ sh:prefixes ex: ; sh:select "SELECT $this ?value { $this $PATH ?value FILTER isIRI(?value) }" ] ] .
      ex:a a ex:C ; ex:l 'x'@de . ex:b a ex:C ; ex:l 'y'@en . ex:c a ex:C ; ex:l ex:z ."""
    text = text.replace("sh:property [ sh:path ex:l ; sh:sparql", "sh:property ex:Q . ex:Q sh:path ex:l ; sh:targetClass ex:C ; sh:sparql").replace("isIRI(?value) }\" ] ] .", "isIRI(?value) }\" ] .")
    assert rows(spark, text) >= {("b", None, "y", "SPARQLConstraintComponent"), ("c", None, "z", "SPARQLConstraintComponent"), ("c", "l", "z", "SPARQLConstraintComponent")}


def test_forbidden_queries_are_diagnosed(spark):
    result = validate(spark, PREFIX + "ex:S sh:targetNode ex:a ; sh:sparql [ sh:select 'SELECT $this { $this ?p ?o MINUS { $this ?p 1 } }' ] .")
    assert result.diagnostics and result.conforms


def test_sparql_target(spark):
    text = "ex:S sh:target [ sh:prefixes ex: ; sh:select 'SELECT ?this { ?this ex:born ex:y }' ] ; sh:property [ sh:path ex:n ; sh:minCount 1 ] . ex:a ex:born ex:y . ex:b ex:born ex:z ."
    assert rows(spark, text) == {("a", "n", None, "MinCountConstraintComponent")}


def test_rules(spark):
    text = """ex:K sh:targetSubjectsOf ex:w ;
      sh:rule [ a sh:SPARQLRule ; sh:prefixes ex: ; sh:construct "CONSTRUCT { $this ex:area ?a } { $this ex:w ?w ; ex:h ?h BIND (?w * ?h AS ?a) }" ; sh:order 0 ] ;
      sh:rule [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate rdf:type ; sh:object ex:Square ; sh:condition [ sh:property [ sh:path ex:w ; sh:equals ex:h ] ] ; sh:order 1 ] .
      ex:a ex:w 7 ; ex:h 8 . ex:b ex:w 3 ; ex:h 3 ."""
    got = {(local(r.s), local(r.p), local(r.o)) for r in infer(spark, PREFIX + DECLARE + text).all().collect()}
    assert got == {("a", "area", "56"), ("b", "area", "9"), ("b", "type", "Square")}


def test_closure_ways_agree(spark, monkeypatch):
    from shapeloom.operators import paths

    step = spark.createDataFrame([(f"n{i}", f"n{(i * 7 + 3) % 40}") for i in range(30)] + [("a", "b"), ("b", "a")], "v string, u string")
    small = set(map(tuple, paths.closure(step).collect()))
    monkeypatch.setattr(paths, "SMALL_EDGES", 3)
    assert set(map(tuple, paths.closure(step).collect())) == small and ("a", "a") in small
