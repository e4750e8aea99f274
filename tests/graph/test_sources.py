from test_sparql import DATA, E, N, P
from test_turtle import PREFIX

from shapeloom.operators import sparql
from shapeloom.sources.triples import Mapping, MappedTables, StoredTriples, TripleTable, node, read_nquads, value
from shapeloom.sources.turtle import parse

SF = "/root/testdata/sf0.001"


def test_patterns_of_a_stored_graph(spark, tmp_path):
    table = TripleTable.of(spark, parse(DATA))
    stored = StoredTriples.build(table, str(tmp_path / "graph"))
    rows = {tuple(r) for r in table.all().collect()}
    s, p, o = E("a"), E("p"), E("c")
    for mask in range(8):
        want = [x if mask >> k & 1 else None for k, x in enumerate((s, p, o))]
        expected = {r for r in rows if all(w is None or w == x for w, x in zip(want, r))}
        for source in (table, stored):
            assert {tuple(r) for r in source.match(*want).collect()} == expected
    assert "PartitionFilters: [isnotnull(predicate" in stored.scan(p)._jdf.queryExecution().executedPlan().toString()
    more = TripleTable.of(spark, parse(PREFIX + "ex:a ex:p ex:c, ex:new . ex:z ex:zz 1 ."))
    assert stored.append(more) == 2 and stored.append(more) == 0
    assert stored.df.count() == len(rows) + 2 and {r.s for r in stored.scan(E("zz")).collect()} == {E("z")}
    assert {(r.s, r.p) for r in stored.out_predicates().where(f"s = '{s}'").collect()} == {(s, E("p")), (s, E("n")), (s, E("l"))}


def test_constants_reach_the_keys_of_mapped_tables(spark):
    source = MappedTables(spark, SF, {E("nation"): [Mapping("customer", node("http://c/", "c_custkey"), node("http://n/", "c_nationkey"), True)], E("name"): [Mapping("customer", node("http://c/", "c_custkey"), value("c_name"), True)]})
    one = source.match("<http://c/7>", E("nation"))
    assert "EqualTo(c_custkey,7)" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1 and source.match("<http://c/x>", E("nation")).count() == 0 and source.match("<http://other/7>").count() == 0
    assert source.match("<http://c/7>").count() == 2
    nation = one.first().o
    assert source.match(o=nation).count() == source.match(None, E("nation"), nation).count() > 1
    assert sparql.select(source, "SELECT ?o { <http://c/7> ex:nation ?o }", P).collect()[0].o == nation


def test_named_graphs(spark, tmp_path):
    (tmp_path / "x.nq").write_text(f'{E("a")} {E("p")} "1" {E("g1")} .\n{E("a")} {E("p")} {E("b")} {E("g2")} .\n# note\n{E("b")} {E("q")} _:x .\n')
    quads = read_nquads(spark, str(tmp_path / "x.nq"))
    assert {r.g for r in quads.names().collect()} == {E("g1"), E("g2")} and quads.named().df.count() == 2 and quads.graph(None).df.count() == 1
    got = sparql.select(quads.graph(None), "SELECT ?g ?o { GRAPH ?g { ex:a ex:p ?o } }", P, graphs=quads.graphs()).collect()
    assert {tuple(r) for r in got} == {(E("g1"), '"1"'), (E("g2"), E("b"))}
    got = sparql.select(quads.graph(None), "SELECT ?o ?x { GRAPH <http://ex/g2> { ex:a ex:p ?o } ?o ex:q ?x }", P, graphs=quads.graphs()).collect()
    assert [tuple(r) for r in got] == [(E("b"), "_:x")]


CASES = {
    "exists in an expression": ("SELECT ?s ?e { ?s ex:n ?n BIND (IF(EXISTS { ?s ex:q ?q }, 1, 2) AS ?e) }", {(E("a"), N(2)), (E("b"), N(2)), (E("c"), N(1)), (E("d"), N(2))}),
    "exists or else": ("SELECT ?s { ?s ex:n ?n FILTER (?n = 2.5 || NOT EXISTS { ?s ex:p ?o }) }", {(E("b"),), (E("c"),), (E("d"),)}),
    "lateral": ("SELECT ?s ?o { ?s ex:n ?n LATERAL { SELECT ?s ?o { ?s ex:p ?o } ORDER BY ?o LIMIT 1 } }", {(E("a"), E("b")), (E("b"), E("c"))}),
    "pattern of a row": ("SELECT ?s { ?s ex:l ?l BIND ('^X' AS ?p) FILTER REGEX(STR(?l), ?p, 'i') }", {(E("a"),)}),
    "time zones": ("SELECT ?z ?d { BIND ('2020-01-01T00:00:00-03:30'^^xsd:dateTime AS ?x) BIND (TZ(?x) AS ?z) BIND (TIMEZONE(?x) AS ?d) }", {('"-03:30"', N("-PT3H30M", "dayTimeDuration"))}),
    "fresh terms": ("SELECT ?a ?b { BIND (isIRI(UUID()) && STRLEN(STRUUID()) = 36 AS ?a) BIND (isBlank(BNODE()) && RAND() < 1 && YEAR(NOW()) > 2000 AS ?b) }", {(N("true", "boolean"), N("true", "boolean"))}),
}


def test_more_of_sparql(spark):
    table = TripleTable.of(spark, parse(DATA))
    for name, (text, want) in CASES.items():
        assert {tuple(r) for r in sparql.select(table, text, P).collect()} == want, name
    got = sparql.query(table, "DESCRIBE ?s ex:b WHERE { ?s ex:q ?o }", P)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in table.all().collect() if r.s in (E("b"), E("c"))}
    assert sparql.query(table, "ASK { ex:a ex:p ex:b }", P) is True
