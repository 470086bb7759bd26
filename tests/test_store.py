"""Updates and catalogues of a store."""

import json

from trellis.ir import TYPE, XSD, Lit
from trellis.operators import graphinfo
from trellis.parsers.update import update
from trellis.sources import flakes as fl

EX = "http://ex/"
P = {"ex": EX}


def state(df):
    return {((r.g or "").replace(EX, ""), r.s.replace(EX, ""), r.p.replace(EX, ""), r.o.replace(EX, "")) for r in fl.current(df).collect()}


def start(spark):
    return fl.facts(spark, [(EX + "a", EX + "p", 1), (EX + "a", EX + "q", EX + "b"), (EX + "b", TYPE, EX + "C"), (EX + "b", EX + "p", Lit("x", XSD + "string"))])


def test_updates(spark):
    f = start(spark)
    base = state(f)
    got = state(update(spark, f, "INSERT DATA { ex:c ex:p 5 . GRAPH ex:g { ex:c ex:p 6 } } ; DELETE DATA { ex:a ex:p 1 }", 2, P))
    assert got == base - {("", "a", "p", "1")} | {("", "c", "p", "5"), ("g", "c", "p", "6")}
    got = state(update(spark, f, "DELETE { ?x ex:p ?v } INSERT { ?x ex:old ?v } WHERE { ?x ex:q ?y ; ex:p ?v }", 2, P))
    assert got == base - {("", "a", "p", "1")} | {("", "a", "old", "1")}
    assert state(update(spark, f, "DELETE WHERE { ?x ex:q ?y }", 2, P)) == base - {("", "a", "q", "b")}
    got = state(update(spark, f, "COPY DEFAULT TO ex:g ; DROP DEFAULT ; MOVE ex:g TO ex:h", 2, P))
    assert got == {("h", *x[1:]) for x in base}
    assert state(update(spark, f, "CLEAR ALL", 2, P)) == set()


def test_catalogues(spark):
    f = fl.current(start(spark))
    assert [r.label for r in graphinfo.labels(f).collect()] == [EX + "C"]
    assert [r.type for r in graphinfo.relationship_types(f).collect()] == [EX + "q"]
    assert [r.key for r in graphinfo.property_keys(f).collect()] == [EX + "p"]
    assert {r.p: r.facts for r in graphinfo.statistics(f, exact=True).collect()}[EX + "p"] == 2
    node = graphinfo.hydrated(f, spark.createDataFrame([(EX + "a",)], "s string"), depth=1).first().node
    assert json.loads(node[EX + "p"][0])["@value"] == "1" and "C" in node[EX + "q"][0]


def test_annotations(spark):
    f = start(spark)
    notes = graphinfo.annotate(spark, [(EX + "a", EX + "q", EX + "b")])
    got = graphinfo.annotated(fl.current(f.union(notes)))
    assert [(r.s, r.o) for r in got.collect()] == [(EX + "a", EX + "b")]


def test_dedup_and_upsert(spark):
    f = start(spark)
    assert fl.insert(f, start(spark), 2).count() == 0
    u = fl.upsert(f, fl.facts(spark, [(EX + "a", EX + "p", 1)]), 2)
    assert u.count() == 0
    commits = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "t long, ts long")
    assert [fl.resolve_time(commits, x) for x in (5, 10, 25, 99)] == [0, 1, 2, 3]


def test_cypher_writes(spark):
    from trellis.engine import cypher
    from trellis.parsers.cypher_write import write
    from trellis.plans.compile import Dataset

    f = fl.facts(spark, [(EX + "a", TYPE, EX + "User"), (EX + "a", EX + "age", 3)])

    def ask(df, text):
        return sorted(tuple(map(str, r)) for r in cypher(spark, Dataset(fl.FlakeGraph(df)), text, EX).collect())

    g = write(spark, f, "MATCH (a:User) CREATE (a)-[:owns]->(d:Dog {name: 'Rex', age: a.age + 1})", EX, 2)
    assert ask(g, "MATCH (a:User)-[:owns]->(d:Dog) RETURN d.name AS n, d.age AS g") == [("Rex", "4")]
    g = write(spark, f, "MATCH (a:User) SET a.age = 9", EX, 2)
    assert ask(g, "MATCH (a:User) RETURN a.age AS n") == [("9",)]
    g = write(spark, f, "MERGE (c:City {name: 'Rome'})", EX, 2)
    g = write(spark, g, "MERGE (c:City {name: 'Rome'})", EX, 3)
    assert ask(g, "MATCH (c:City) RETURN count(c) AS n") == [("1",)]
    g = write(spark, f, "MATCH (a:User) REMOVE a.age", EX, 2)
    assert ask(g, "MATCH (a:User) RETURN a.age AS n") == [("None",)]
    g = write(spark, f, "MATCH (a:User) DETACH DELETE a", EX, 2)
    assert fl.current(g).count() == 0


def test_r2rml(spark, sf):
    from trellis.engine import sparql
    from trellis.plans.compile import Dataset
    from trellis.sources import r2rml

    text = """
    @prefix rr: <http://www.w3.org/ns/r2rml#> .
    @prefix ex: <http://ex/> .
    ex:N a rr:TriplesMap ; rr:logicalTable [ rr:tableName "nation" ] ;
      rr:subjectMap [ rr:template "http://ex/nation/{n_nationkey}" ; rr:class ex:Nation ] ;
      rr:predicateObjectMap [ rr:predicate ex:name ; rr:objectMap [ rr:column "n_name" ] ] ;
      rr:predicateObjectMap [ rr:predicate ex:region ; rr:objectMap [ rr:parentTriplesMap ex:R ; rr:joinCondition [ rr:child "n_regionkey" ; rr:parent "r_regionkey" ] ] ] ;
      rr:predicateObjectMap [ rr:predicate ex:kind ; rr:object "state" ] .
    ex:R rr:logicalTable [ rr:tableName "region" ] ; rr:subjectMap [ rr:template "http://ex/region/{r_regionkey}" ] ;
      rr:predicateObjectMap [ rr:predicate ex:name ; rr:objectMap [ rr:column "r_name" ] ] .
    """
    g = r2rml.load(text, lambda t: spark.read.parquet(f"{sf}/{t}.parquet"))
    got = sparql(spark, Dataset(g), 'SELECT ?r (COUNT(?n) AS ?k) WHERE { ?n a ex:Nation ; ex:kind "state" ; ex:region ?x . ?x ex:name ?r } GROUP BY ?r', P).collect()
    assert len(got) == 5 and sum(r.k for r in got) == 25
