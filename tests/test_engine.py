"""Small graphs with known answers."""

import json

import pytest

from trellis.engine import cypher, jsonld, sparql
from trellis.ir import OWL, RDF, RDFS, TYPE, XSD, Group, Iri, Lit, Triple, Var
from trellis.operators import policy, reasoning, search, shacl
from trellis.plans.compile import Dataset
from trellis.sources import flakes as fl
from trellis.sources import readers, writers

EX = "http://ex/"
P = {"ex": EX, "xsd": XSD, "rdfs": RDFS}


#: Huts of a made-up valley: beds, prices, trails to others, the day of opening.
HUTS = {
    "larch": (24, [18, 31], [], "1961-05-02"),
    "fern": (8, [12], ["larch"], None),
    "cairn": (40, [22, 35, 47], ["larch", "fern"], "1988-07-30"),
    "scree": (8, [9, 12], ["cairn", "fern", "larch"], None),
    "tarn": (15, [20], ["scree"], "2003-06-11"),
}


def huts(spark):
    rows = []
    for hut, (beds, prices, trails, opened) in HUTS.items():
        s = EX + hut
        rows += [(s, TYPE, EX + "Hut"), (s, EX + "name", Lit(hut.title(), XSD + "string")), (s, EX + "beds", beds)]
        rows += [(s, EX + "price", n) for n in prices] + [(s, EX + "trail", EX + f) for f in trails]
        if opened:
            rows.append((s, EX + "opened", Lit(opened, XSD + "date")))
    rows += [(EX + "larch", EX + "greeting", Lit("servus", None, "de")), (EX + "larch", EX + "greeting", Lit("welcome", None, "en"))]
    return fl.facts(spark, rows)


@pytest.fixture(scope="module")
def data(spark):
    return Dataset(fl.FlakeGraph(huts(spark).cache()))


def rows(df):
    return sorted((tuple(str(v) if v is not None else None for v in r) for r in df.collect()), key=str)


def ask(spark, data, text):
    return rows(sparql(spark, data, text, P))


def test_multivalued(spark, data):
    assert ask(spark, data, "SELECT ?n (SUM(?f) AS ?s) WHERE { ?x ex:name ?n ; ex:price ?f } GROUP BY ?n") == [("Cairn", "104"), ("Fern", "12"), ("Larch", "49"), ("Scree", "21"), ("Tarn", "20")]


def test_max_date(spark, data):
    assert ask(spark, data, "SELECT (MAX(?b) AS ?m) WHERE { ?x ex:opened ?b }") == [("2003-06-11",)]


def test_empty_sum_is_zero(spark, data):
    assert ask(spark, data, "SELECT (SUM(?a) AS ?s) WHERE { ?x ex:beds ?a FILTER(?a > 99) }") == [("0",)]


def test_optional_all_or_nothing(spark, data):
    got = ask(spark, data, "SELECT ?n ?b ?f WHERE { ?x ex:name ?n OPTIONAL { ?x ex:opened ?b ; ex:trail ?f } }")
    assert ("Larch", None, None) in got and ("Fern", None, None) in got and len(got) == 6


def test_triple_after_optional_drops_unbound(spark, data):
    got = ask(spark, data, "SELECT ?n ?m WHERE { ?x ex:name ?n OPTIONAL { ?x ex:trail ?f } ?f ex:name ?m }")
    assert len(got) == 7


def test_values_matches_unbound(spark, data):
    text = 'SELECT ?n ?b WHERE { ?x ex:name ?n OPTIONAL { ?x ex:opened ?b } VALUES ?b { "1988-07-30"^^xsd:date } }'
    assert [r[0] for r in ask(spark, data, text)] == ["Cairn", "Fern", "Scree"]
    text = 'SELECT ?n ?k WHERE { ?x ex:name ?n OPTIONAL { ?x ex:opened ?b } VALUES (?b ?k) { ("1988-07-30"^^xsd:date 1) (UNDEF 2) } }'
    assert ask(spark, data, text) == [("Cairn", "1"), ("Cairn", "2"), ("Fern", "1"), ("Fern", "2"), ("Larch", "2"), ("Scree", "1"), ("Scree", "2"), ("Tarn", "2")]


def test_joins_of_unbound_are_no_nested_loops(spark, data):
    for text in (
        'SELECT ?n ?b WHERE { ?x ex:name ?n OPTIONAL { ?x ex:opened ?b } VALUES ?b { "1988-07-30"^^xsd:date } }',
        "SELECT ?n WHERE { ?x ex:name ?n OPTIONAL { ?x ex:opened ?b } MINUS { ?x ex:beds ?a . ?x ex:opened ?b } }",
        "SELECT ?n WHERE { ?x ex:name ?n OPTIONAL { ?x ex:trail ?f } OPTIONAL { { SELECT ?f ?c WHERE { ?f ex:beds ?c } } } }",
    ):
        plan = sparql(spark, data, text, P)._jdf.queryExecution().executedPlan().toString()
        # only rows whose variable is unbound meet all others, which is what they mean
        assert "HashJoin" in plan and "Cartesian" not in plan and plan.count("NestedLoop") <= (0 if "MINUS" in text else 2)


def test_minus_and_not_exists(spark, data):
    assert [r[0] for r in ask(spark, data, "SELECT ?n WHERE { ?x ex:name ?n MINUS { ?x ex:trail ?y } }")] == ["Larch"]
    assert [r[0] for r in ask(spark, data, "SELECT ?n WHERE { ?x ex:name ?n ; ex:beds ?a FILTER NOT EXISTS { ?y ex:beds ?b FILTER(?b < ?a) } }")] == ["Fern", "Scree"]
    assert [r[0] for r in ask(spark, data, "SELECT ?n WHERE { ?x ex:name ?n OPTIONAL { ?x ex:opened ?b } MINUS { ?x ex:beds 8 OPTIONAL { ?x ex:opened ?b } } }")] == ["Cairn", "Larch", "Tarn"]


def test_lang_and_datatype(spark, data):
    assert ask(spark, data, 'SELECT ?m WHERE { ?x ex:greeting ?m FILTER(LANG(?m) = "de") }') == [("servus",)]
    assert ask(spark, data, "SELECT ?x WHERE { ?x ex:greeting \"welcome\"@en }") == [(EX + "larch",)]
    assert ask(spark, data, "SELECT DISTINCT (DATATYPE(?a) AS ?d) WHERE { ?x ex:beds ?a }") == [(XSD + "integer",)]
    assert ask(spark, data, 'SELECT ?m WHERE { ?x ex:greeting ?m FILTER(?m = "servus") }') == []


def test_terms_of_several_kinds(spark):
    facts = [(EX + f"i{k}", EX + "v", v) for k, v in enumerate((9, 10, 25, 100, 2.5, "http://ex/z", Lit("10", XSD + "string"), Lit("b", None, "de"), True, Lit("2020-05-01", XSD + "date"), Lit("2019-01-01T10:00:00", XSD + "dateTime")))]
    g = Dataset(fl.FlakeGraph(fl.facts(spark, facts)))
    got = [r.v for r in sparql(spark, g, "SELECT ?v WHERE { ?x ex:v ?v } ORDER BY ?v", P).collect()]
    assert got == ["http://ex/z", "true", "2.5", "9", "10", "25", "100", "2019-01-01T10:00:00", "2020-05-01", "10", "b"]
    assert ask(spark, g, "SELECT (MIN(?v) AS ?a) (MAX(?v) AS ?b) WHERE { ?x ex:v ?v FILTER(isNumeric(?v)) }") == [("2.5", "100")]
    assert len(ask(spark, g, "SELECT ?v ?w WHERE { ?x ex:v ?v . ?y ex:v ?w FILTER(isNumeric(?v) && ?v < ?w) }")) == 10
    assert ask(spark, g, "SELECT ?x WHERE { ?x ex:v ?v FILTER(?v = 10) }") == [(EX + "i1",)]
    assert ask(spark, g, 'SELECT ?x WHERE { ?x ex:v ?v FILTER(?v = "10") }') == [(EX + "i6",)]
    assert len(ask(spark, g, "SELECT DISTINCT ?v WHERE { ?x ex:v ?v }")) == 11
    assert ask(spark, g, "SELECT (COUNT(DISTINCT ?v) AS ?n) (SUM(?v) AS ?s) WHERE { ?x ex:v ?v }") == [("11", "146.5")]


def test_integer_division_is_exact(spark, data):
    got = ask(spark, data, "SELECT ?q WHERE { ex:tarn ex:beds ?a BIND(?a / 4 AS ?q) }")
    assert float(got[0][0]) == 3.75


def test_round_half_up_and_errors(spark, data):
    got = ask(spark, data, "SELECT (ROUND(-2.5) AS ?a) (1/0 AS ?b) (COALESCE(1/0, 7) AS ?c) WHERE {}")
    assert (float(got[0][0]), got[0][1], float(got[0][2])) == (-2, None, 7)


def test_in_with_unbound(spark, data):
    got = ask(spark, data, "SELECT ?n WHERE { ?x ex:name ?n OPTIONAL { ?x ex:opened ?b } FILTER(?b NOT IN (1)) }")
    assert len(got) == 5


def test_paths(spark, data):
    assert len(ask(spark, data, "SELECT ?y WHERE { ex:tarn ex:trail+ ?y }")) == 4
    assert len(ask(spark, data, "SELECT ?x ?y WHERE { ?x ex:trail/ex:trail ?y }")) == 7
    assert len(ask(spark, data, "SELECT ?y WHERE { ex:scree ex:trail* ?y }")) == 4
    assert ask(spark, data, "SELECT ?x WHERE { ?x (^ex:trail)+ ex:scree }") == [(EX + "cairn",), (EX + "fern",), (EX + "larch",)]
    assert len(ask(spark, data, "SELECT ?x ?y WHERE { ?x ex:trail+ ?y }")) == 10


def test_paths_start_from_bound_ends(spark, data, monkeypatch):
    from trellis.plans import paths

    starts = []
    real = paths.closure
    monkeypatch.setattr(paths, "closure", lambda c, p, start=None: starts.append(None if start is None else start.distinct().count()) or real(c, p, start))
    assert ask(spark, data, "SELECT ?n ?y WHERE { ?x ex:beds 15 ; ex:name ?n . ?x ex:trail+ ?y }") == [("Tarn", EX + x) for x in ("cairn", "fern", "larch", "scree")]
    assert ask(spark, data, "SELECT ?x WHERE { ?y ex:beds 40 . ?x ex:trail+ ?y }") == [(EX + "scree",), (EX + "tarn",)]
    assert starts == [1, 1]


def test_cycle_closure(spark):
    g = Dataset(fl.FlakeGraph(fl.facts(spark, [(EX + a, EX + "p", EX + b) for a, b in ("ab", "bc", "ca", "cd")])))
    assert len(ask(spark, g, "SELECT ?x ?y WHERE { ?x ex:p+ ?y }")) == 12
    assert len(ask(spark, g, "SELECT ?x WHERE { ?x ex:p+ ?x }")) == 3
    assert len(ask(spark, g, "SELECT ?y WHERE { ex:a ex:p{2,3} ?y }")) == 3


def test_bind_in_scope_is_rejected():
    from trellis.parsers.sparql import parse

    with pytest.raises(ValueError):
        parse("SELECT * WHERE { ?s ?p ?o BIND(1 AS ?o) }")


def test_unknown_function_is_an_error(spark, data):
    with pytest.raises(ValueError):
        ask(spark, data, "SELECT (NOSUCH(?x) AS ?y) WHERE { ?x ex:beds ?a }")


def test_time_travel(spark):
    f = fl.facts(spark, [(EX + "a", EX + "v", 1)], t=1)
    f = f.union(fl.upsert(f, fl.facts(spark, [(EX + "a", EX + "v", 2)]), 2))
    f = f.union(fl.delete(f, fl.facts(spark, [(EX + "a", EX + "v", 2)]), 3).select(f.columns))
    for t, want in ((1, [("1",)]), (2, [("2",)]), (3, [])):
        assert ask(spark, Dataset(fl.FlakeGraph(f, t)), "SELECT ?v WHERE { ex:a ex:v ?v }") == want
    assert fl.FlakeGraph(f, history=(1, 3)).facts().count() == 4


def test_update_and_construct(spark, data):
    beds = lambda n: Triple(Var("x"), Iri(EX + "beds"), Lit(n, XSD + "integer"))
    new = fl.update(spark, data.default.flakes, Group((beds(15),)), [beds(15)], [beds(16)], 2)
    g = Dataset(fl.FlakeGraph(data.default.flakes.union(new.select(data.default.flakes.columns))))
    assert ask(spark, g, "SELECT ?a WHERE { ex:tarn ex:beds ?a }") == [("16",)]
    assert ask(spark, g, "CONSTRUCT { ?y ex:reachedFrom ?x } WHERE { ?x ex:trail ?y . ?y ex:beds 40 }") == [(EX + "cairn", EX + "reachedFrom", EX + "scree")]


def test_cypher(spark, data):
    got = rows(cypher(spark, data, "MATCH (a:Hut)-[r:trail]->(b) WHERE b.beds >= 24 RETURN b.name AS n, count(*) AS k, type(r) AS t", EX))
    assert got == [("Cairn", "1", "trail"), ("Larch", "3", "trail")]
    got = rows(cypher(spark, data, "MATCH (a:Hut {name: $which}) OPTIONAL MATCH (a)-[:trail]->(b) RETURN a.name AS n, collect(b.name) AS l", EX, {"which": "Larch"}))
    assert got == [("Larch", "[]")]
    path = "MATCH p = shortestPath((a:Hut{})-[:trail*]->(b:Hut{})) RETURN length(p) AS n, [x IN nodes(p) | x] AS l"
    got = rows(cypher(spark, data, path.replace("{}", " {name: 'Tarn'}", 1).replace("{}", " {name: 'Larch'}", 1), EX))
    assert got == [("2", str([EX + "tarn", EX + "scree", EX + "larch"]))]
    one = cypher(spark, data, "MATCH (a:Hut) WHERE a.beds = 24 RETURN labels(a) AS l, keys(a) AS k, properties(a).beds AS b", EX).collect()
    assert [tuple(r) for r in one] == [(["Hut"], ["beds", "greeting", "name", "opened", "price"], "24")]


def test_shortest_between_constants(spark, data):
    from trellis.ir import Shortest
    from trellis.plans.compile import Compiler

    def found(s, o, **more):
        f = Compiler(spark, data).group(Group((Shortest(s, o, (EX + "trail",), "p", more.get("mode", "all"), more.get("way", "out"), 1, None),)))
        return sorted([x.replace(EX, "") for x in r.p.nodes] for r in f.df.collect())

    assert found(Iri(EX + "tarn"), Iri(EX + "fern")) == [["tarn", "scree", "fern"]]
    assert found(Var("x"), Iri(EX + "fern")) == [["cairn", "fern"], ["scree", "fern"], ["tarn", "scree", "fern"]]
    assert found(Iri(EX + "larch"), Var("y"), way="in", mode="single") == [["larch", "cairn"], ["larch", "fern"], ["larch", "scree"], ["larch", "scree", "tarn"]]


def test_jsonld(spark, data):
    q = {"@context": {"ex": EX}, "select": ["?n", "?f"], "where": [{"@id": "?x", "ex:name": "?n", "ex:price": "?f"}, ["filter", "(> ?f 30)"]], "orderBy": ["(desc ?f)", "?n"], "limit": 2}
    assert [tuple(r) for r in jsonld(spark, data, q).collect()] == [("Cairn", 47), ("Cairn", 35)]
    q = {"@context": {"ex": EX}, "select": ["?n", "?f"], "where": {"@id": "?x", "ex:name": "?n", "ex:price": "?f"}, "groupBy": "?n"}
    assert {r.n: sorted(r.f) for r in jsonld(spark, data, q).collect()}["Cairn"] == [22, 35, 47]


def test_readers_and_writers(spark, tmp_path):
    text = f'<{EX}a> <{EX}p> "x\\ty"@en .\n<{EX}a> <{EX}q> <{EX}b> <{EX}g> .\n# none\n<{EX}a> <{EX}r> "3"^^<{XSD}integer> .\n'
    (tmp_path / "f.nq").write_text(text)
    f = readers.nquads(spark, str(tmp_path / "f.nq"))
    assert sorted(r.value for r in writers.nquads(f).collect()) == sorted(x for x in text.split("\n") if x and not x.startswith("#"))
    t = readers.turtle(spark, f"@prefix ex: <{EX}> .\nex:a a ex:C ; ex:p 1, 2.5, true ; ex:q [ ex:r \"z\" ] .")
    assert t.count() == 6
    j = readers.jsonld(spark, {"@context": {"ex": EX}, "@id": "ex:a", "@type": "ex:C", "ex:p": [1, {"@id": "ex:b", "ex:n": "q"}]})
    assert j.count() == 4
    for line in writers.nodes(j).collect():
        assert json.loads(line.value)["@id"].startswith(EX)
    lines = list(writers.stream(spark.range(3)))
    assert len(lines) == 5 and json.loads(lines[-1]) == {"type": "end", "rows": 3}
    assert [r.value for r in writers.delimited(spark.createDataFrame([('a,"b', 1)], "x string, y int")).collect()] == ['"a,""b",1']


def test_reasoning_rules(spark):
    def run(extra, rules=None):
        f = spark.createDataFrame([(EX + a if not a.startswith("http") else a, p if p.startswith("http") else EX + p, o if o.startswith("http") or o.isdigit() else EX + o) for a, p, o in extra], "s string, p string, o string")
        return {(r.s.replace(EX, ""), r.p.replace(EX, ""), r.o.replace(EX, "")) for r in reasoning.materialised(f, rules).collect()}

    got = run([("p", TYPE, OWL + "FunctionalProperty"), ("a", "p", "x"), ("a", "p", "y"), ("y", "q", "z")])
    assert ("x", "q", "z") in got
    got = run([("p", OWL + "propertyChainAxiom", "l1"), ("l1", RDF + "first", "q"), ("l1", RDF + "rest", "l2"), ("l2", RDF + "first", "r"), ("l2", RDF + "rest", RDF + "nil"), ("a", "q", "b"), ("b", "r", "c")], [reasoning.prp_spo2])
    assert ("a", "p", "c") in got
    got = run([("R", OWL + "onProperty", "p"), ("R", OWL + "someValuesFrom", "C"), ("a", "p", "b"), ("b", TYPE, "C"), ("I", OWL + "intersectionOf", "l1"), ("l1", RDF + "first", "R"), ("l1", RDF + "rest", "l2"), ("l2", RDF + "first", "D"), ("l2", RDF + "rest", RDF + "nil"), ("a", TYPE, "D")])
    assert ("a", TYPE, "R") in got and ("a", TYPE, "I") in got


def test_shacl_and_policy(spark, data):
    f = data.default.facts()
    s = shacl.Shape(target_class=EX + "Hut", properties=[shacl.Property(EX + "beds", min_inclusive=10), shacl.Property(EX + "trail", max_count=2, cls=EX + "Hut"), shacl.Property(EX + "greeting", unique_lang=True, language_in=["de"])])
    got = {(r.focus.replace(EX, ""), r.constraint) for r in shacl.validate(f, [s]).collect()}
    assert got == {("fern", "minInclusive"), ("scree", "minInclusive"), ("scree", "maxCount"), ("larch", "languageIn")}
    large = shacl.Shape(properties=[shacl.Property(EX + "beds", min_inclusive=24)])
    q = shacl.Shape(target_class=EX + "Hut", properties=[shacl.Property(EX + "trail", qualified=(large, 2, None))])
    assert {r.focus.replace(EX, "") for r in shacl.validate(f, [q]).collect()} == {"larch", "fern", "cairn", "tarn"}
    q = shacl.Shape(target_class=EX + "Hut", properties=[shacl.Property(EX + "trail", node=large)])
    assert {(r.focus.replace(EX, ""), r.value.replace(EX, "")) for r in shacl.validate(f, [q]).collect()} == {("cairn", "fern"), ("scree", "fern"), ("tarn", "scree")}
    seen = policy.visible(spark, f, [policy.Policy(classes=[EX + "Hut"]), policy.Policy(allow=False, properties=[EX + "beds"])])
    assert seen.where(f"p = '{EX}beds'").isEmpty() and not seen.where(f"p = '{EX}name'").isEmpty()


def test_search(spark):
    docs = spark.createDataFrame([(1, "the red fox"), (2, "red red wine"), (3, "blue sky"), (4, None)], "id long, text string")
    index = search.TextIndex(docs, "id", "text")
    assert [r.id for r in index.top("the red").collect()] == [2, 1] and index.top("the").count() == 0
    # of postings, which know no text without terms: other totals, the same order
    again = search.TextIndex.of_postings(search.TextIndex(docs.where("text is not null"), "id", "text").kept())
    want = {r.id: round(r.score, 9) for r in search.TextIndex(docs.where("text is not null"), "id", "text").scores("red wine sky").collect()}
    assert {r.id: round(r.score, 9) for r in again.scores("red wine sky").collect()} == want


def test_search_by_stems(spark):
    docs = spark.createDataFrame([(1, "He runs daily"), (2, "running shoes"), (3, "a stone"), (4, "Runner's knee")], "id long, text string")
    assert [r.id for r in search.TextIndex(docs, "id", "text", "en-GB", stem=True).top("run").collect()] == [2, 1]
    assert search.TextIndex(docs, "id", "text").top("run").count() == 0
    assert [r.id for r in search.TextIndex(docs, "id", "text", "xx", stop=["he"]).top("he runs").collect()] == [1]


def test_stems():
    """Words and stems of the algorithm's published sample."""
    from trellis.functions.stem import english

    pairs = """consign consign consignment consign consistency consist consistently consist consolation consol consolatory consolatori consolingly consol consonant conson conspicuously conspicu
        conspiracy conspiraci conspirators conspir conspiring conspir constables constabl constancy constanc knackeries knackeri knave knave knavish knavish kneaded knead knees knee knelt knelt
        knightly knight knitting knit knocker knocker knopp knopp skies sky dying die early earli news news succeed succeed""".split()
    assert [english(w) for w in pairs[::2]] == pairs[1::2]


def test_types_beyond_the_bound(spark, monkeypatch):
    from trellis.sources import flakes

    monkeypatch.setattr(flakes, "MOST_TYPES", 3)
    g = Dataset(fl.FlakeGraph(huts(spark)))
    assert ask(spark, g, "SELECT (SUM(?b) AS ?s) WHERE { ?x ex:beds ?b FILTER(?b > 9) }") == [("79",)]


def test_commit_times_dont_go_back(spark):
    commits = spark.createDataFrame([(1, "2024-01-02")], "t long, day string").selectExpr("t", "cast(day as timestamp) ts")
    fl.checked(commits, "2024-01-03")
    with pytest.raises(ValueError):
        fl.checked(commits, "2024-01-01")


def test_plans(spark, sf):
    """A star over a table is one scan of the columns it needs; joins are on keys."""
    from trellis.queries import catalogue

    plan = catalogue.QUERIES["tpch_q1"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "l_partkey" not in plan
    plan = catalogue.QUERIES["rollup_2hop_region"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "concat" not in plan and "CartesianProduct" not in plan


def test_reasoning_bounds_raise(spark, monkeypatch):
    chain = lambda p: spark.createDataFrame([(f"n{i}", p, f"n{i + 1}") for i in range(6)], "s string, p string, o string")
    assert len(reasoning.hierarchy(chain("sub"), "sub")["n6"]) == 6
    with pytest.raises(RuntimeError):
        reasoning.hierarchy(chain("sub"), "sub", most=5)
    ends = reasoning.same(chain(reasoning.OWL + "sameAs")).where("s <> o").collect()
    assert len(ends) == 6 and {r.o for r in ends} == {"n0"}
    monkeypatch.setattr(reasoning, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        reasoning.same(chain(reasoning.OWL + "sameAs")).count()


def test_polygons_that_meet(spark):
    """Rectangles that touch, triangles and holes against the rule in plain Python; pairs aren't
    sifted afterwards, as a pair is tried in one cell."""
    import random

    r, shapes = random.Random(4), {}
    for n in range(60):
        x, y, w, h = r.randint(-6, 6), r.randint(-6, 6), r.randint(1, 4), r.randint(1, 4)
        ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
        shapes[n] = [ring[::-1] if n % 3 == 1 else ring] if n % 4 else [[(x, y), (x + w, y + 1), (x, y + h), (x, y)]]
    shapes[60] = [[(-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5)], [(-2, -2), (2, -2), (2, 2), (-2, 2), (-2, -2)]]

    def inside(p, rings):
        odd = lambda g: sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in zip(g, g[1:])) % 2
        return sum(odd(g) for g in rings) % 2 == 1

    def cut(a, b):
        side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        edges = lambda rs: [e for g in rs for e in zip(g, g[1:])]
        return any(side(p, q, u) * side(p, q, v) < 0 and side(u, v, p) * side(u, v, q) < 0 for p, q in edges(a) for u, v in edges(b))

    def fits(a, b, how):
        if how == "within":
            return all(inside(p, b) for p in a[0]) and not cut(a, b) and not any(inside(p, a[:1]) for g in b[1:] for p in g)
        return any(inside(p, b) for g in a for p in g) or any(inside(p, a) for g in b for p in g) or cut(a, b)

    wkt = lambda rs: "POLYGON(" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in g) + ")" for g in rs) + ")"
    df = spark.createDataFrame([(n, wkt(rs)) for n, rs in shapes.items()], "id int, wkt string")
    for how in ("intersects", "within"):
        got = search.meeting(df, df, how, 2.0)
        found = [tuple(x) for x in got.collect()]
        assert sorted(found) == [(m, n) for m, a in shapes.items() for n, b in shapes.items() if fits(a, b, how)]
        assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    # parts of one id are one shape
    parts = spark.createDataFrame([(1, wkt(shapes[1])), (1, wkt(shapes[2])), (1, wkt([[(70, 70), (71, 70), (71, 71), (70, 70)]]))], "id int, wkt string")
    want = {(1, n) for n, b in shapes.items() if fits(shapes[1], b, "intersects") or fits(shapes[2], b, "intersects")}
    found = [tuple(x) for x in search.meeting(parts, df, "intersects", 2.0).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_shortest_ends_with_its_ends(spark, monkeypatch):
    """Walks stop once each first node has met the ends of its component, not at the last node."""
    from trellis.plans import paths

    def chain(name, n, marks):
        out = [(f"{EX}{name}{i}", EX + "next", f"{EX}{name}{i + 1}") for i in range(n)]
        return out + [x for i in range(n + 1) for x in ((f"{EX}{name}{i}", EX + "number", i), (f"{EX}{name}{i}", EX + "mark", 1 if i in marks else 0))]

    def found(facts, pattern):
        path = f"MATCH p = {pattern} RETURN a, b, length(p) AS n, size(nodes(p)) AS k"
        return [(x.replace(EX, ""), y.replace(EX, ""), n, k) for x, y, n, k in rows(cypher(spark, Dataset(fl.FlakeGraph(facts)), path, EX))]

    count, keep = [], paths.kept
    monkeypatch.setattr(paths, "kept", lambda df: count.append(1) or keep(df))
    long = fl.facts(spark, chain("l", 60, ()) + chain("s", 2, ())).cache()
    assert found(long, "allShortestPaths((a {number: 0})-[:next*]-(b {number: 2}))") == [("l0", "l2", "2", "3"), ("s0", "s2", "2", "3")]
    assert len(count) < 30
    # ends far away, behind the first node, and the first node itself
    short = fl.facts(spark, chain("c", 9, (2, 5, 8)) + chain("d", 6, ())).cache()
    assert found(short, "shortestPath((a {number: 5})-[:next*]->(b {mark: 1}))") == [("c5", "c8", "3", "4")]
    assert found(short, "shortestPath((a {number: 0})-[:next*]->(b {mark: 1}))") == [("c0", "c2", "2", "3"), ("c0", "c5", "5", "6"), ("c0", "c8", "8", "9")]
    assert found(short, "allShortestPaths((a {mark: 1})-[:next*2..]-(b {mark: 1}))") == [(f"c{x}", f"c{y}", str(abs(x - y)), str(abs(x - y) + 1)) for x in (2, 5, 8) for y in (2, 5, 8) if x != y]
