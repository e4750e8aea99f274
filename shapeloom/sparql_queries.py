"""SPARQL over the sample tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shapeloom.functions.terms import exact, lex
from shapeloom.operators import sparql
from shapeloom.queries import CATALOGUE, EX, _int, query, tables
from shapeloom.sources.terms import XSD

PREFIXES = {"": EX, "ex": EX, "xsd": XSD}


def _sparql(name: str, text: str, columns: dict[str, str], sql: str) -> None:
    """``columns``: for each variable how it is shown: text, key (of an IRI) or number."""

    def f(spark, sf):
        rows = sparql.select(tables(spark, sf), text, PREFIXES)
        shown = {"text": lambda v: lex(F.col(v)).alias(v), "key": lambda v: _int(v, v), "number": lambda v: exact(F.col(v)).cast("bigint").alias(v)}
        return rows.select(*[shown[kind](v) for v, kind in columns.items()])

    CATALOGUE[name] = (f, sql)


_sparql("sparql_select", "SELECT ?n ?name WHERE { ?n :nname ?name ; :region <http://example.org/region/1> }", {"n": "key", "name": "text"}, "SELECT n_nationkey AS n, n_name AS name FROM nation WHERE n_regionkey = 1")
_sparql("sparql_join", "SELECT ?o ?r WHERE { ?o :custkey ?c . ?c :cnation/:region/:rname ?r . ?o :status 'F' }", {"o": "key", "r": "text"}, "SELECT o_orderkey AS o, r_name AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F'")
_sparql("sparql_optional", "SELECT ?c ?o WHERE { ?c :segment 'BUILDING' OPTIONAL { ?o :custkey ?c ; :status 'P' } }", {"c": "key", "o": "key"}, "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
_sparql("sparql_minus", "SELECT ?c WHERE { ?c :segment ?s MINUS { ?o :custkey ?c ; :status 'F' } }", {"c": "key"}, "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
_sparql("sparql_union", "SELECT ?x ?n WHERE { { ?x :cnation ?n } UNION { ?x :snation ?n } }", {"x": "text", "n": "key"}, f"SELECT '{EX}customer/' || c_custkey AS x, c_nationkey AS n FROM customer UNION ALL SELECT '{EX}supplier/' || s_suppkey, s_nationkey FROM supplier")
_sparql("sparql_exists", "SELECT ?c WHERE { ?c :acctbal ?b FILTER EXISTS { ?o :custkey ?c ; :priority '1-URGENT' } }", {"c": "key"}, "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
_sparql("sparql_not_exists", "SELECT ?o WHERE { ?o :custkey ?c FILTER NOT EXISTS { ?l :order ?o ; :returnflag 'R' } }", {"o": "key"}, "SELECT o_orderkey AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
_sparql("sparql_filter", "SELECT ?p WHERE { ?p :size ?s ; :brand ?b FILTER (?s > 10 && (?s <= 20 || ?b = 'Brand#11')) }", {"p": "key"}, "SELECT p_partkey AS p FROM part WHERE p_size > 10 AND (p_size <= 20 OR p_brand = 'Brand#11')")
_sparql("sparql_filter_in", "SELECT ?p WHERE { ?p :size ?s FILTER (?s IN (1, 2.0, 3e0) || ?s NOT IN (4, 5, 6, 7)) }", {"p": "key"}, "SELECT p_partkey AS p FROM part WHERE p_size IN (1, 2, 3) OR p_size NOT IN (4, 5, 6, 7)")
_sparql("sparql_bind", "SELECT ?p ?x WHERE { ?p :size ?s BIND (?s * 3 - 1 AS ?x) FILTER (?x > 50) }", {"p": "key", "x": "number"}, "SELECT p_partkey AS p, (p_size * 3 - 1)::BIGINT AS x FROM part WHERE p_size * 3 - 1 > 50")
_sparql("sparql_values", "SELECT ?c ?k WHERE { VALUES (?s ?k) { ('BUILDING' 'b') ('MACHINERY' 'm') } ?c :segment ?s }", {"c": "key", "k": "text"}, "SELECT c_custkey AS c, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' ELSE 'm' END AS k FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_sparql("sparql_order_limit", "SELECT ?p ?s WHERE { ?p :size ?s ; :pname ?n } ORDER BY DESC(?s) ?p LIMIT 10 OFFSET 5", {"p": "key", "s": "number"}, f"SELECT p_partkey AS p, p_size::BIGINT AS s FROM part ORDER BY p_size DESC, '<{EX}part/' || p_partkey || '>' LIMIT 10 OFFSET 5")
_sparql("sparql_distinct", "SELECT DISTINCT ?n WHERE { ?c :cnation ?n }", {"n": "key"}, "SELECT DISTINCT c_nationkey AS n FROM customer")
_sparql("sparql_group_count", "SELECT ?s (COUNT(?c) AS ?n) (COUNT(DISTINCT ?k) AS ?m) WHERE { ?c :segment ?s ; :cnation ?k } GROUP BY ?s HAVING (COUNT(?c) > 5)", {"s": "text", "n": "number", "m": "number"}, "SELECT c_mktsegment AS s, count(*) AS n, count(DISTINCT c_nationkey) AS m FROM customer GROUP BY 1 HAVING count(*) > 5")
_sparql("sparql_aggregates", "SELECT ?b (SUM(?s) AS ?sum) (MIN(?s) AS ?min) (MAX(?s) AS ?max) WHERE { ?p :brand ?b ; :size ?s } GROUP BY ?b", {"b": "text", "sum": "number", "min": "number", "max": "number"}, "SELECT p_brand AS b, sum(p_size)::BIGINT AS sum, min(p_size)::BIGINT AS min, max(p_size)::BIGINT AS max FROM part GROUP BY 1")
_sparql("sparql_subquery", "SELECT ?c ?n WHERE { ?c :segment 'BUILDING' . { SELECT ?c (COUNT(*) AS ?n) WHERE { ?o :custkey ?c } GROUP BY ?c } }", {"c": "key", "n": "number"}, "SELECT c_custkey AS c, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
_sparql("sparql_string_functions", "SELECT ?p ?a ?b ?c ?l WHERE { ?p :pname ?n BIND (UCASE(SUBSTR(?n, 2, 4)) AS ?a) BIND (STRBEFORE(?n, ' ') AS ?b) BIND (REPLACE(CONCAT(?n, '!'), '[aeiou]', '_') AS ?c) BIND (STRLEN(?n) AS ?l) }", {"p": "key", "a": "text", "b": "text", "c": "text", "l": "number"}, "SELECT p_partkey AS p, upper(substr(p_name, 2, 4)) AS a, CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, 1, instr(p_name, ' ') - 1) ELSE '' END AS b, regexp_replace(p_name || '!', '[aeiou]', '_', 'g') AS c, length(p_name) AS l FROM part")
_sparql("sparql_math_functions", "SELECT ?p ?a ?d WHERE { ?p :size ?s BIND (ABS(?s - 25) AS ?a) BIND (FLOOR(?s / 4) AS ?d) }", {"p": "key", "a": "number", "d": "number"}, "SELECT p_partkey AS p, abs(p_size - 25)::BIGINT AS a, floor(p_size / 4)::BIGINT AS d FROM part")
_sparql("sparql_date_functions", "SELECT ?o ?y ?m WHERE { ?o :orderdate ?d BIND (YEAR(?d) AS ?y) BIND (MONTH(?d) AS ?m) FILTER (?d >= '1996-01-01T00:00:00'^^xsd:dateTime) }", {"o": "key", "y": "number", "m": "number"}, "SELECT o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
_sparql("sparql_if_coalesce", "SELECT ?c ?x WHERE { ?c :segment ?s OPTIONAL { ?c :nothing ?z } BIND (COALESCE(?z, IF(?s = 'BUILDING', 'b', ?s)) AS ?x) }", {"c": "key", "x": "text"}, "SELECT c_custkey AS c, CASE WHEN c_mktsegment = 'BUILDING' THEN 'b' ELSE c_mktsegment END AS x FROM customer")
_sparql("sparql_lang", "SELECT ?d ?l WHERE { ?d :text ?t BIND (LANG(?t) AS ?l) FILTER (langMatches(LANG(?t), 'en') || regex(LANG(?t), '^F', 'i')) }", {"d": "key", "l": "text"}, "SELECT doc_id AS d, lang AS l FROM documents WHERE lang IN ('en', 'fr')")
_sparql("sparql_path", "SELECT ?x ?r WHERE { ?x (:cnation|:snation)/:region ?r }", {"x": "text", "r": "key"}, f"SELECT '{EX}customer/' || c_custkey AS x, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT '{EX}supplier/' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
_sparql("sparql_path_plus", "SELECT ?u WHERE { <http://example.org/turn/0/0> :next+ ?u }", {"u": "text"}, f"SELECT '{EX}turn/0/' || (turn + 1) AS u FROM conversations WHERE conv_id = 0")


@query("SELECT count(*) > 0 AS answer FROM part WHERE p_size > 49")
def sparql_ask(spark, sf):
    return spark.createDataFrame([(sparql.ask(tables(spark, sf), "ASK { ?p :size ?s FILTER (?s > 49) }", PREFIXES),)], "answer boolean")


@query("SELECT o_custkey AS s, o_orderkey AS o FROM orders WHERE o_orderstatus = 'P'")
def sparql_construct(spark, sf):
    made = sparql.construct(tables(spark, sf), "CONSTRUCT { ?c :open ?o . ?c :note ?missing } WHERE { ?o :custkey ?c ; :status 'P' }", PREFIXES)
    return made.select(_int("s", "s"), _int("o", "o"))


@query("SELECT c_custkey AS this, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY 1")
def sparql_prebound(spark, sf):
    """One run for all foci: ?this is a column, and an aggregate is per focus."""
    g = tables(spark, sf)
    foci = sparql.select(g, "SELECT ?c WHERE { ?c :acctbal ?b FILTER (?b < 0) }", PREFIXES)
    rows = sparql.select(g, "SELECT ?this (COUNT(?o) AS ?n) WHERE { ?o :custkey ?this } GROUP BY ?this", PREFIXES, this=foci)
    return rows.select(_int("this", "this"), exact(F.col("n")).cast("bigint").alias("n"))
