"""Named queries over the fact store: time travel, writes, graphs, inference, validation,
policies; with their twins in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import sparql
from ..ir import OWL, RDF, RDFS, TYPE, XSD, Bind, Call, Filter, Group, Iri, Lit, Triple, Var  # noqa: F401
from ..operators import policy, reasoning, shacl
from ..plans.compile import Dataset
from ..sources import flakes as fl
from . import tables
from .catalogue import node
from .tables import PREFIXES, D, V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def Q(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


TYPES = ("click", "view", "purchase", "signup", "logout")


# ---- states of a user's values, event by event

LAST = "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events {where} GROUP BY 1, 2"


def _events(spark: SparkSession, d: str) -> fl.FlakeGraph:
    return fl.FlakeGraph(tables.event_flakes(spark, d))


def _last_id(spark: SparkSession, d: str) -> int:
    return spark.read.parquet(f"{d}/events.parquet").agg(F.max("event_id")).first()[0]


@Q(f"SELECT '{D}user/' || user_id s, '{V}' || event_type p, value o FROM ({LAST.format(where='')})")
def tt_current(spark: SparkSession, d: str) -> DataFrame:
    return sparql(spark, Dataset(_events(spark, d)), "SELECT ?s ?p ?o WHERE { ?s ?p ?o }", PREFIXES).select("s", "p", F.col("o").cast("double").alias("o"))


@Q(f"SELECT '{D}user/' || user_id s, '{V}' || event_type p, value o FROM ({LAST.format(where='WHERE event_id <= (SELECT max(event_id) // 2 FROM events)')})")
def tt_at_t(spark: SparkSession, d: str) -> DataFrame:
    g = _events(spark, d).at(_last_id(spark, d) // 2)
    return sparql(spark, Dataset(g), "SELECT ?s ?p ?o WHERE { ?s ?p ?o }", PREFIXES).select("s", "p", F.col("o").cast("double").alias("o"))


@Q(f"""WITH e AS (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id) old FROM events), m AS (SELECT max(event_id) m FROM events)
SELECT '{D}user/' || user_id s, event_id t, true op, value v FROM e, m WHERE event_type = 'click' AND event_id BETWEEN m // 4 AND m // 2
UNION ALL SELECT '{D}user/' || user_id, event_id, false, old FROM e, m WHERE event_type = 'click' AND event_id BETWEEN m // 4 AND m // 2 AND old IS NOT NULL AND old <> value""")  # fmt: skip
def tt_history(spark: SparkSession, d: str) -> DataFrame:
    m = _last_id(spark, d)
    g = fl.FlakeGraph(tables.event_flakes(spark, d), history=(m // 4, m // 2))
    f = g.scan(Triple(Var("s"), Iri(V + "click"), Var("v"), "t", "op"))
    return f.df.select("s", "t", "op", "v")


@Q(f"""SELECT '{D}user/' || user_id s, count(*) n FROM ({LAST.format(where='')}) WHERE value > 50 GROUP BY user_id""")
def tt_filter_agg(spark: SparkSession, d: str) -> DataFrame:
    text = "SELECT ?s (COUNT(?o) AS ?n) WHERE { ?s ?p ?o FILTER(xsd:double(?o) > 50) } GROUP BY ?s"
    return sparql(spark, Dataset(_events(spark, d)), text, PREFIXES)


@Q(f"SELECT '{D}user/' || user_id s, '{V}' || event_type p, value o FROM ({LAST.format(where='')}) WHERE NOT (event_type = 'click' AND value < 50)")
def tt_retract(spark: SparkSession, d: str) -> DataFrame:
    flakes = tables.event_flakes(spark, d)
    where = Group((Triple(Var("s"), Iri(V + "click"), Var("x")), Filter(Call("<", (Var("x"), Lit(50, XSD + "integer"))))))
    gone = fl.update(spark, flakes, where, [Triple(Var("s"), Iri(V + "click"), Var("x"))], [], _last_id(spark, d) + 1)
    state = fl.current(flakes.union(gone.select(flakes.columns)))
    return state.select("s", "p", F.col("o").cast("double").alias("o"))


@Q(f"""SELECT '{D}user/' || user_id s, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END o FROM ({LAST.format(where='')}) WHERE event_type = 'click'""")
def update_insert_where(spark: SparkSession, d: str) -> DataFrame:
    flakes = tables.event_flakes(spark, d)
    where = Group((Triple(Var("s"), Iri(V + "click"), Var("x")), Bind(Call("if", (Call(">=", (Var("x"), Lit(50, XSD + "integer"))), Lit("high", XSD + "string"), Lit("low", XSD + "string"))), "y")))
    new = fl.update(spark, flakes, where, [], [Triple(Var("s"), Iri(V + "level"), Var("y"))], _last_id(spark, d) + 1)
    return fl.current(flakes.union(new.select(flakes.columns))).where(F.col("p") == V + "level").select("s", "o")


@Q(f"""SELECT '{D}user/' || user_id s, CASE WHEN user_id % 2 = 0 THEN 1.0::DOUBLE ELSE value END o FROM ({LAST.format(where='')}) WHERE event_type = 'click'""")
def upsert_replaces(spark: SparkSession, d: str) -> DataFrame:
    flakes = tables.event_flakes(spark, d)
    clicked = fl.current(flakes).where(F.col("p") == V + "click").where(F.substring_index("s", "/", -1).cast("long") % 2 == 0)
    new = clicked.select("g", "s", "p", F.lit("1.0").alias("o"), "dt", "lang", "i")
    out = fl.upsert(flakes, new, _last_id(spark, d) + 1)
    return fl.current(flakes.union(out.select(flakes.columns))).where(F.col("p") == V + "click").select("s", F.col("o").cast("double").alias("o"))


# ---- graphs and datasets: customers and suppliers' nations as graphs of one store


def _nations(spark: SparkSession, d: str) -> Dataset:
    parts = []
    for g, table, c in (("customers", "customer", "c_nationkey"), ("suppliers", "supplier", "s_nationkey")):
        t = spark.read.parquet(f"{d}/{table}.parquet").select(F.col(c).alias("k")).distinct()
        parts.append(t.select(F.lit(D + g).alias("g"), F.concat(F.lit(D + "nation/"), F.col("k").cast("string")).alias("s"), F.lit(V + "has").alias("p"), F.lit("member").alias("o")))
    flakes = parts[0].union(parts[1]).selectExpr("g", "s", "p", "o", f"'{XSD}string' dt", "cast(null as string) lang", "cast(null as int) i", "1L t", "true op")
    named = {D + g: fl.FlakeGraph(flakes, graph=D + g) for g in ("customers", "suppliers")}
    return Dataset(fl.FlakeGraph(flakes), named, services={D + "elsewhere": Dataset(named[D + "suppliers"])})


@Q(f"SELECT DISTINCT '{D}nation/' || s_nationkey s FROM supplier")
def graph_named(spark: SparkSession, d: str) -> DataFrame:
    return sparql(spark, _nations(spark, d), f"SELECT ?s WHERE {{ GRAPH <{D}suppliers> {{ ?s v:has ?x }} }}", PREFIXES)


@Q(f"SELECT '{D}customers' g, count(DISTINCT c_nationkey) n FROM customer UNION ALL SELECT '{D}suppliers', count(DISTINCT s_nationkey) FROM supplier")
def graph_var(spark: SparkSession, d: str) -> DataFrame:
    return sparql(spark, _nations(spark, d), "SELECT ?g (COUNT(?s) AS ?n) WHERE { GRAPH ?g { ?s v:has ?x } } GROUP BY ?g", PREFIXES)


@Q(f"SELECT '{D}nation/' || k s FROM (SELECT c_nationkey k FROM customer UNION SELECT s_nationkey FROM supplier)")
def dataset_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    return sparql(spark, _nations(spark, d), f"SELECT ?s FROM <{D}customers> FROM <{D}suppliers> WHERE {{ ?s v:has ?x }}", PREFIXES)


@Q(f"SELECT '{D}nation/' || k s FROM (SELECT c_nationkey k FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def graph_join(spark: SparkSession, d: str) -> DataFrame:
    return sparql(spark, _nations(spark, d), f"SELECT ?s WHERE {{ GRAPH <{D}customers> {{ ?s v:has ?x }} GRAPH <{D}suppliers> {{ ?s v:has ?y }} }}", PREFIXES)


@Q(f"SELECT DISTINCT '{D}nation/' || s_nationkey s FROM supplier")
def service_local(spark: SparkSession, d: str) -> DataFrame:
    return sparql(spark, _nations(spark, d), f"SELECT ?s WHERE {{ SERVICE <{D}elsewhere> {{ ?s v:has ?x }} }}", PREFIXES)


@Q("SELECT '' s WHERE false")
def graph_missing(spark: SparkSession, d: str) -> DataFrame:
    return sparql(spark, _nations(spark, d), f"SELECT ?s WHERE {{ GRAPH <{D}nowhere> {{ ?s v:has ?x }} }}", PREFIXES)


# ---- inference over the reply graph


def _facts(spark: SparkSession, d: str, schema: list[tuple] = ()) -> DataFrame:
    f = tables.conversations(spark, d).select("s", "p", "o", "dt")
    if schema:
        f = f.union(spark.createDataFrame([(s, p, o, "@id") for s, p, o in schema], "s string, p string, o string, dt string"))
    return f


def _links(f: DataFrame) -> DataFrame:
    return f.where(F.col("dt") == "@id").select("s", "p", "o")


@Q(f"SELECT {node('conv_id', 'turn')} s FROM conversations")
def rdfs_subclass(spark: SparkSession, d: str) -> DataFrame:
    f = _links(_facts(spark, d, [(V + "Turn", RDFS + "subClassOf", V + "Utterance"), (V + "Utterance", RDFS + "subClassOf", V + "Act")]))
    out = reasoning.materialised(f, reasoning.RDFS_RULES)
    return out.where((F.col("p") == TYPE) & (F.col("o") == V + "Act")).select("s")


@Q(f"SELECT {node('conv_id', 'turn - 1')} s, {node('conv_id', 'turn')} o FROM conversations WHERE turn > 0 UNION SELECT {node('conv_id', 'turn')}, {node('conv_id', '0')} FROM conversations WHERE turn > 0 AND turn % 3 = 0")
def rdfs_subproperty(spark: SparkSession, d: str) -> DataFrame:
    """By rewriting the query instead of making facts."""
    from ..plans.compile import Compiler

    schema = spark.createDataFrame([(V + "next", RDFS + "subPropertyOf", V + "leads"), (V + "back", RDFS + "subPropertyOf", V + "leads")], "s string, p string, o string")
    g = reasoning.expand(Group((Triple(Var("s"), Iri(V + "leads"), Var("o")),)), {}, reasoning.hierarchy(schema, RDFS + "subPropertyOf"))
    return Compiler(spark, tables.replies(spark, d)).group(g).df.select("s", "o").distinct()


@Q(f"SELECT {node('conv_id', 'turn')} s, {node('conv_id', 'turn - 1')} o FROM conversations WHERE turn > 0")
def ql_inverse(spark: SparkSession, d: str) -> DataFrame:
    from ..plans.compile import Compiler

    g = reasoning.expand(Group((Triple(Var("s"), Iri(V + "after"), Var("o")),)), {}, {}, {V + "after": V + "next"})
    return Compiler(spark, tables.replies(spark, d)).group(g).df.select("s", "o")


@Q(f"SELECT {node('x.conv_id', 'x.turn')} s, {node('y.conv_id', 'y.turn')} o FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn < y.turn")
def rl_transitive(spark: SparkSession, d: str) -> DataFrame:
    f = _links(_facts(spark, d, [(V + "next", TYPE, OWL + "TransitiveProperty")]))
    return reasoning.materialised(f, [reasoning.prp_trp]).where(F.col("p") == V + "next").select("s", "o")


@Q(f"SELECT {node('conv_id', 'turn')} s, {node('conv_id', 'turn - 1')} o FROM conversations WHERE turn > 0 UNION ALL SELECT {node('conv_id', 'turn - 1')}, {node('conv_id', 'turn')} FROM conversations WHERE turn > 0")
def rl_symmetric(spark: SparkSession, d: str) -> DataFrame:
    f = _links(_facts(spark, d, [(V + "next", TYPE, OWL + "SymmetricProperty")]))
    return reasoning.materialised(f, [reasoning.prp_symp]).where(F.col("p") == V + "next").select("s", "o")


@Q(f"""SELECT DISTINCT {node('conv_id', 'turn')} s FROM conversations WHERE turn > 0""")
def rl_domain_range(spark: SparkSession, d: str) -> DataFrame:
    f = _links(_facts(spark, d, [(V + "next", RDFS + "range", V + "Reply"), (V + "next", OWL + "inverseOf", V + "follows"), (V + "follows", RDFS + "domain", V + "Answer")]))
    out = reasoning.materialised(f, [reasoning.prp_rng, reasoning.prp_dom, reasoning.prp_inv])
    a, b = (out.where((F.col("p") == TYPE) & (F.col("o") == V + c)).select("s") for c in ("Reply", "Answer"))
    return a.intersect(b)


@Q(f"SELECT {node('x.conv_id', 'x.turn')} s, {node('y.conv_id', 'y.turn')} o FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 2")
def datalog_rule(spark: SparkSession, d: str) -> DataFrame:
    rule = reasoning.Rule(Group((Triple(Var("a"), Iri(V + "next"), Var("b")), Triple(Var("b"), Iri(V + "next"), Var("c")))), [Triple(Var("a"), Iri(V + "skips"), Var("c"))])
    return reasoning.datalog(spark, _facts(spark, d), [rule]).where(F.col("p") == V + "skips").select("s", "o")


@Q(f"SELECT {node('x.conv_id', 'x.turn')} s, {node('y.conv_id', 'y.turn')} o FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn < y.turn")
def datalog_recursive(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = Var("a"), Var("b"), Var("c")
    rules = [reasoning.Rule(Group((Triple(a, Iri(V + "next"), b),)), [Triple(a, Iri(V + "before"), b)]), reasoning.Rule(Group((Triple(a, Iri(V + "before"), b), Triple(b, Iri(V + "next"), c))), [Triple(a, Iri(V + "before"), c)])]
    return reasoning.datalog(spark, _facts(spark, d), rules).where(F.col("p") == V + "before").select("s", "o")


# ---- validation and policies over the reply graph


def _shape(*p: shacl.Property, **more) -> shacl.Shape:
    return shacl.Shape(target_class=V + "Turn", properties=list(p), **more)


def _report(spark: SparkSession, d: str, s: shacl.Shape) -> DataFrame:
    return shacl.validate(tables.conversations(spark, d), [s])


@Q(f"SELECT {node('conv_id', 'turn')} focus, '{V}prev' path, 'minCount' \"constraint\", NULL::VARCHAR \"value\" FROM conversations WHERE turn = 0")
def shacl_mincount(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d, _shape(shacl.Property(V + "prev", min_count=1)))


@Q(f"SELECT {node('conv_id', 'turn')} focus, '{V}role' path, 'datatype' \"constraint\", role \"value\" FROM conversations")
def shacl_datatype(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d, _shape(shacl.Property(V + "role", datatype=XSD + "integer"), shacl.Property(V + "number", datatype=XSD + "integer")))


@Q(f"SELECT {node('conv_id', 'turn')} focus, '{V}role' path, 'pattern' \"constraint\", role \"value\" FROM conversations WHERE NOT regexp_matches(role, '^u') UNION ALL SELECT {node('conv_id', 'turn')}, '{V}number', 'maxInclusive', turn::VARCHAR FROM conversations WHERE turn > 4")
def shacl_pattern(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d, _shape(shacl.Property(V + "role", pattern="^u"), shacl.Property(V + "number", max_inclusive=4)))


@Q(f"SELECT {node('conv_id', 'turn')} focus, '{V}back' path, 'closed' \"constraint\", {node('conv_id', '0')} \"value\" FROM conversations WHERE turn > 0 AND turn % 3 = 0")
def shacl_closed(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d, _shape(shacl.Property(V + "role"), closed=True, ignored=[TYPE, V + "number", V + "next", V + "prev"]))


@Q(f"SELECT {node('conv_id', 'turn')} focus, NULL::VARCHAR path, 'xone' \"constraint\", {node('conv_id', 'turn')} \"value\" FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) m FROM conversations) WHERE (turn > 0) = (turn < m)")
def shacl_xone(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d, _shape(one=[_shape(shacl.Property(V + "prev", min_count=1)), _shape(shacl.Property(V + "next", min_count=1))]))


@Q(f"SELECT '{V}number' p, count(*) n FROM conversations UNION ALL SELECT '{TYPE}', count(*) FROM conversations UNION ALL SELECT '{V}prev', count(*) FROM conversations WHERE turn > 0 UNION ALL SELECT '{V}next', count(*) FROM conversations WHERE turn > 0 UNION ALL SELECT '{V}back', count(*) FROM conversations WHERE turn > 0 AND turn % 3 = 0")
def policy_property_deny(spark: SparkSession, d: str) -> DataFrame:
    seen = policy.visible(spark, tables.conversations(spark, d), [policy.Policy(allow=False, properties=[V + "role"])], default_allow=True)
    return seen.groupBy("p").agg(F.count("*").alias("n"))


@Q("SELECT count(*) n FROM conversations WHERE role = 'user'")
def policy_query(spark: SparkSession, d: str) -> DataFrame:
    own = Group((Triple(Var("this"), Iri(V + "role"), Lit("user", XSD + "string")),))
    seen = policy.visible(spark, tables.conversations(spark, d), [policy.Policy(query=own)])
    return seen.where(F.col("p") == V + "number").agg(F.count("*").alias("n"))
