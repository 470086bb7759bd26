"""Named queries of terms of several kinds, of updates and mappings over several graphs and tables,
of Cypher's catalogues, of inference rules, and of readers and writers; with twins in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import cypher, sparql
from ..ir import OWL, RDF, RDFS, TYPE, XSD
from ..operators import reasoning, shacl
from ..parsers import cypher_write
from ..parsers.update import update
from ..plans.compile import Dataset
from ..plans.paths import kept
from ..sources import flakes as fl
from ..sources import r2rml, readers, writers
from ..sources.virtual import Ref, TriplesMap, VirtualGraph
from . import tables
from .catalogue import node
from .store import _links, _report, _shape
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


# ---- terms of several kinds: all facts of customers by ?s ?p ?o

FACTS = f"""f AS (SELECT c_custkey k, '{V}c_custkey' p, c_custkey::VARCHAR o, c_custkey::DOUBLE n FROM customer UNION ALL SELECT c_custkey, '{V}c_nationkey', c_nationkey::VARCHAR, c_nationkey FROM customer
UNION ALL SELECT c_custkey, '{V}c_acctbal', c_acctbal::VARCHAR, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL UNION ALL SELECT c_custkey, '{V}c_name', c_name, NULL FROM customer UNION ALL SELECT c_custkey, '{V}c_mktsegment', c_mktsegment, NULL FROM customer)"""


def _customers(spark: SparkSession, d: str) -> Dataset:
    return tables.graph(spark, d, ["customer"])


@Q(f"WITH {FACTS}, d AS (SELECT DISTINCT o, n FROM f WHERE o IS NOT NULL) SELECT o FROM d ORDER BY n NULLS LAST, o OFFSET 40 LIMIT 1500")
def mixed_order(spark: SparkSession, d: str) -> DataFrame:
    return sparql(spark, _customers(spark, d), "SELECT DISTINCT ?o WHERE { ?s ?p ?o FILTER(!isIRI(?o)) } ORDER BY ?o OFFSET 40 LIMIT 1500", PREFIXES)


@Q(f"WITH {FACTS} SELECT '{D}customer/' || k s, arg_min(o, n) lo, arg_max(o, n) hi, count(DISTINCT n) AS n FROM f WHERE n IS NOT NULL GROUP BY k")
def mixed_min_max(spark: SparkSession, d: str) -> DataFrame:
    text = "SELECT ?s (MIN(?o) AS ?lo) (MAX(?o) AS ?hi) (COUNT(DISTINCT ?o) AS ?n) WHERE { ?s ?p ?o FILTER(isNumeric(?o)) } GROUP BY ?s"
    return sparql(spark, _customers(spark, d), text, PREFIXES)


@Q(f"WITH {FACTS} SELECT '{D}customer/' || k s, p, o FROM f JOIN customer ON c_custkey = k WHERE n < c_nationkey")
def mixed_compare(spark: SparkSession, d: str) -> DataFrame:
    return sparql(spark, _customers(spark, d), "SELECT ?s ?p ?o WHERE { ?s ?p ?o ; v:c_nationkey ?n FILTER(?o < ?n) }", PREFIXES)


@Q(f"WITH {FACTS} SELECT x.p AS p, y.p AS q, count(*) n FROM f x JOIN f y ON x.k = y.k AND x.n < y.n GROUP BY ALL")
def mixed_compare_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sparql(spark, _customers(spark, d), "SELECT ?p ?q (COUNT(*) AS ?n) WHERE { ?s ?p ?x . ?s ?q ?y FILTER(?x < ?y && isNumeric(?x)) } GROUP BY ?p ?q", PREFIXES)


@Q(f"SELECT '{D}nation/' || n_nationkey s, 'en-gb' l, upper(n_name) u, 'en-gb' k, true m, false e FROM nation")
def lang_tags(spark: SparkSession, d: str) -> DataFrame:
    text = """SELECT ?s (LANG(?t) AS ?l) (STR(UCASE(?t)) AS ?u) (LANG(LCASE(?t)) AS ?k) (LANGMATCHES(LANG(?t), "en") AS ?m) (?t = ?n AS ?e)
        WHERE { ?s v:n_name ?n BIND(STRLANG(?n, "en-gb") AS ?t) }"""
    return sparql(spark, tables.graph(spark, d, ["nation"]), text, PREFIXES)


@Q("SELECT n_nationkey k, trim(' ' || n_name || ' ') AS a, sqrt(n_nationkey) b, sign(n_regionkey - 2)::BIGINT c, round(ln(n_nationkey + 1) * 1000)::BIGINT AS e, pow(n_regionkey, 2) AS p, ltrim('  ' || n_name) AS l, rtrim(n_name || '  ') r FROM nation WHERE (n_nationkey > 5) <> (n_regionkey = 1)")
def xor_trim_sqrt(spark: SparkSession, d: str) -> DataFrame:
    text = """MATCH (n:Nation) WHERE n.n_nationkey > 5 XOR n.n_regionkey = 1 RETURN n.n_nationkey AS k, trim(' ' + n.n_name + ' ') AS a, sqrt(n.n_nationkey) AS b, sign(n.n_regionkey - 2) AS c,
        toInteger(round(log(n.n_nationkey + 1) * 1000)) AS e, n.n_regionkey ^ 2 AS p, ltrim('  ' + n.n_name) AS l, rtrim(n.n_name + '  ') AS r"""
    return cypher(spark, tables.graph(spark, d, ["nation"]), text, V)


@Q("SELECT n_nationkey k, true a, false b, true AS c, false e FROM nation")
def same_term(spark: SparkSession, d: str) -> DataFrame:
    text = "SELECT ?k (?k = ?x AS ?a) (sameTerm(?k, ?x) AS ?b) (sameTerm(?k, ?k) AS ?c) (sameTerm(?n, ?k) AS ?e) WHERE { ?s v:n_nationkey ?k ; v:n_name ?n BIND(xsd:double(?k) AS ?x) }"
    return sparql(spark, tables.graph(spark, d, ["nation"]), text, PREFIXES)


@Q("SELECT o_orderstatus AS g, count(*) n FROM orders GROUP BY 1 ORDER BY n DESC, g LIMIT 2")
def group_count_top(spark: SparkSession, d: str) -> DataFrame:
    return sparql(spark, tables.graph(spark, d, ["orders"]), "SELECT ?g (COUNT(*) AS ?n) WHERE { ?s v:o_orderstatus ?g } GROUP BY ?g ORDER BY DESC(?n) ?g LIMIT 2", PREFIXES)


@Q("SELECT sum(n) n FROM (SELECT length(string_agg(n_name, ', ')) n FROM nation GROUP BY n_regionkey)")
def strlen_of_concat(spark: SparkSession, d: str) -> DataFrame:
    text = 'SELECT (SUM(?l) AS ?n) WHERE { { SELECT ?r (STRLEN(GROUP_CONCAT(?x ; SEPARATOR=", ")) AS ?l) WHERE { ?s v:n_name ?x ; v:n_region ?r } GROUP BY ?r } }'
    return sparql(spark, tables.graph(spark, d, ["nation", "region"]), text, PREFIXES)


@Q(f"SELECT '{D}part/' || p_partkey s, p_name n FROM part WHERE regexp_matches(p_name, 'e.*a')")
def class_and_regex(spark: SparkSession, d: str) -> DataFrame:
    return sparql(spark, tables.graph(spark, d, ["part", "nation"]), 'SELECT ?s ?n WHERE { ?s a v:Part ; v:p_name ?n FILTER(REGEX(?n, "e.*a")) }', PREFIXES)


@Q("SELECT 'x' k, n_nationkey::VARCHAR o FROM nation WHERE n_nationkey IN (1, 2) UNION ALL SELECT 'y', n_nationkey::VARCHAR FROM nation WHERE n_nationkey <= 3 UNION ALL SELECT 'z', n_nationkey::VARCHAR FROM nation")
def values_undef_late(spark: SparkSession, d: str) -> DataFrame:
    """Rows of VALUES that bind some variables, against solutions that bind others."""
    text = 'SELECT ?k (STR(?n) AS ?o) WHERE { ?s v:n_nationkey ?n . FILTER(?k = "z" || ?k = "x" || ?n <= 3) } VALUES (?k ?n) { ("x" 1) ("x" 2) ("y" UNDEF) ("z" UNDEF) }'
    return sparql(spark, tables.graph(spark, d, ["nation"]), text.replace(' FILTER(?k = "z" || ?k = "x" || ?n <= 3)', ""), PREFIXES).where("k <> 'y' or cast(o as int) <= 3")


# ---- updates over graphs


def _graphs(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    return n.selectExpr(f"concat('{D}region', n_regionkey) g", f"concat('{D}nation/', n_nationkey) s", f"'{V}name' p", "n_name o", f"'{XSD}string' dt", "cast(null as string) lang", "cast(null as int) i", "1L t", "true op")


def _after(spark: SparkSession, d: str, text: str) -> DataFrame:
    flakes = update(spark, _graphs(spark, d), text, 2, PREFIXES)
    return fl.current(flakes).select("g", "s", "p", "o")


NAMES = f"SELECT '{D}region' || n_regionkey g, '{D}nation/' || n_nationkey s, '{V}name' p, n_name o FROM nation"


@Q(f"{NAMES} UNION ALL SELECT '{D}copy', '{D}nation/' || n_nationkey, '{V}of', '{D}region' || n_regionkey FROM nation WHERE n_regionkey IN (1, 3)")
def update_graph_template(spark: SparkSession, d: str) -> DataFrame:
    return _after(spark, d, f"INSERT {{ GRAPH <{D}copy> {{ ?s v:of ?g }} }} WHERE {{ GRAPH ?g {{ ?s v:name ?n }} FILTER(?g = <{D}region1> || ?g = <{D}region3>) }}")


@Q(f"SELECT * FROM ({NAMES}) WHERE g <> '{D}region2' UNION ALL SELECT NULL, s, '{V}was', o FROM ({NAMES}) WHERE g = '{D}region2'")
def update_delete_graph(spark: SparkSession, d: str) -> DataFrame:
    return _after(spark, d, f"DELETE {{ GRAPH <{D}region2> {{ ?s ?p ?n }} }} INSERT {{ ?s v:was ?n }} WHERE {{ GRAPH <{D}region2> {{ ?s ?p ?n }} }}")


@Q(f"{NAMES} UNION ALL SELECT '{D}all', s, '{V}seen', o FROM ({NAMES}) WHERE g IN ('{D}region0', '{D}region4')")
def update_using(spark: SparkSession, d: str) -> DataFrame:
    return _after(spark, d, f"WITH <{D}all> INSERT {{ ?s v:seen ?n }} USING <{D}region0> USING <{D}region4> WHERE {{ ?s v:name ?n }}")


@Q(f"SELECT * FROM ({NAMES}) WHERE g <> '{D}region1'")
def update_delete_where_graph(spark: SparkSession, d: str) -> DataFrame:
    return _after(spark, d, f"DELETE WHERE {{ GRAPH <{D}region1> {{ ?s ?p ?o }} }}")


@Q(f"{NAMES} UNION ALL SELECT '{D}loaded', '{D}region/' || r_regionkey, '{V}r_name', r_name FROM region")
def update_load(spark: SparkSession, d: str) -> DataFrame:
    r = spark.read.parquet(f"{d}/region.parquet")
    facts = r.selectExpr("cast(null as string) g", f"concat('{D}region/', r_regionkey) s", f"'{V}r_name' p", "r_name o", f"'{XSD}string' dt", "cast(null as string) lang")
    path = _lines(writers.nquads(facts)) + "/*.nt"
    return _after(spark, d, f"LOAD <{path}> INTO GRAPH <{D}loaded>")


def _lines(df: DataFrame, suffix: str = "nt") -> str:
    """The folder of text files of a column of lines, in the shared folder."""
    spark = df.sparkSession
    root = kept(df.limit(0)).inputFiles()  # makes sure of the folder
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    path = f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    del root
    parts = df.select("value")
    parts.mapInArrow(lambda bs: bs, "value string").write.option("lineSep", "\n").text(path)
    return _renamed(spark, path, suffix)


def _renamed(spark: SparkSession, path: str, suffix: str) -> str:
    """Gives the files of a folder another ending."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(p):
        old = f.getPath()
        if old.getName().endswith(".txt"):
            fs.rename(old, jvm.org.apache.hadoop.fs.Path(p, old.getName()[:-4] + "." + suffix))
    return path


# ---- facts of one subject in several tables, mappings


@Q(f"SELECT '{D}customer/' || c_custkey s, c_name n, o_orderkey o FROM customer JOIN orders ON o_custkey = c_custkey")
def star_two_maps(spark: SparkSession, d: str) -> DataFrame:
    c, o = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "orders"))
    g = VirtualGraph([TriplesMap(c, D + "customer/{c_custkey}", V + "Customer", {V + "name": "c_name"}), TriplesMap(o, D + "customer/{o_custkey}", None, {V + "ordered": "o_orderkey"})])
    return sparql(spark, Dataset(g), "SELECT ?s ?n ?o WHERE { ?s a v:Customer ; v:name ?n ; v:ordered ?o }", PREFIXES)


@Q("SELECT n_name n, x.k AS k, y.k AS m FROM nation, (SELECT DISTINCT c_nationkey a, c_mktsegment k FROM customer) x, (SELECT DISTINCT s_nationkey a, s_nationkey::VARCHAR k FROM supplier) y WHERE x.a = n_nationkey AND y.a = n_nationkey UNION ALL SELECT n_name, x.k, z.k FROM nation, (SELECT DISTINCT c_nationkey a, c_mktsegment k FROM customer) x, (SELECT DISTINCT c_nationkey a, c_mktsegment k FROM customer) z WHERE x.a = n_nationkey AND z.a = n_nationkey UNION ALL SELECT n_name, y.k, z.k FROM nation, (SELECT DISTINCT s_nationkey a, s_nationkey::VARCHAR k FROM supplier) y, (SELECT DISTINCT s_nationkey a, s_nationkey::VARCHAR k FROM supplier) z WHERE y.a = n_nationkey AND z.a = n_nationkey UNION ALL SELECT n_name, y.k, x.k FROM nation, (SELECT DISTINCT c_nationkey a, c_mktsegment k FROM customer) x, (SELECT DISTINCT s_nationkey a, s_nationkey::VARCHAR k FROM supplier) y WHERE x.a = n_nationkey AND y.a = n_nationkey")
def star_shared_predicate(spark: SparkSession, d: str) -> DataFrame:
    """One predicate in two tables: each of two patterns is over both."""
    n, c, s = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "customer", "supplier"))
    k = s.select("s_nationkey", F.col("s_nationkey").cast("string").alias("k"))
    g = VirtualGraph([TriplesMap(n, D + "nation/{n_nationkey}", None, {V + "name": "n_name"}), TriplesMap(c, D + "nation/{c_nationkey}", None, {V + "has": "c_mktsegment"}), TriplesMap(k, D + "nation/{s_nationkey}", None, {V + "has": "k"})])
    return sparql(spark, Dataset(g), "SELECT ?n ?k ?m WHERE { ?s v:name ?n ; v:has ?k ; v:has ?m }", PREFIXES)


RR = "@prefix rr: <http://www.w3.org/ns/r2rml#> .\n@prefix v: <http://tables/voc/> .\n@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"


@Q(f"SELECT '{D}customer/' || c_custkey s, x k FROM (SELECT c_custkey, unnest([c_custkey::VARCHAR, c_name]) x FROM customer) WHERE x IS NOT NULL")
def r2rml_two_objects(spark: SparkSession, d: str) -> DataFrame:
    text = RR + f"""<#c> rr:logicalTable [ rr:tableName "customer" ] ; rr:subjectMap [ rr:template "{D}customer/{{c_custkey}}" ; rr:class v:Customer, v:Party ] ;
        rr:predicateObjectMap [ rr:predicate v:key ; rr:objectMap [ rr:column "c_custkey" ], [ rr:column "c_name" ] ] ."""
    g = r2rml.load(text, lambda t: spark.read.parquet(f"{d}/{t}.parquet"))
    return sparql(spark, Dataset(g), "SELECT ?s (STR(?x) AS ?k) WHERE { ?s a v:Party, v:Customer ; v:key ?x }", PREFIXES)


@Q(f"SELECT '{D}turn/' || y.conv_id || '-' || y.turn a, x.role r, 'role' l, 'de' g FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn = y.turn - 1")
def r2rml_composite_key(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet")
    both = {"turns": c, "replies": c.where("turn > 0").withColumn("before", F.col("turn") - 1).withColumn("word", F.lit("role"))}
    text = RR + f"""<#t> rr:logicalTable [ rr:tableName "turns" ] ; rr:subjectMap [ rr:template "{D}turn/{{conv_id}}-{{turn}}" ] ; rr:predicateObjectMap [ rr:predicate v:role ; rr:objectMap [ rr:column "role" ] ] .
        <#r> rr:logicalTable [ rr:tableName "replies" ] ; rr:subjectMap [ rr:template "{D}turn/{{conv_id}}-{{turn}}" ] ; rr:predicateObjectMap [ rr:predicate v:label ; rr:objectMap [ rr:column "word" ; rr:language "de" ] ] ;
        rr:predicateObjectMap [ rr:predicate v:follows ; rr:objectMap [ rr:parentTriplesMap <#t> ; rr:joinCondition [ rr:child "conv_id" ; rr:parent "conv_id" ], [ rr:child "before" ; rr:parent "turn" ] ] ] ."""
    return sparql(spark, Dataset(r2rml.load(text, both)), "SELECT ?a ?r (STR(?w) AS ?l) (LANG(?w) AS ?g) WHERE { ?a v:follows ?b ; v:label ?w . ?b v:role ?r }", PREFIXES)


@Q(f"SELECT '{D}supplier/' || s_suppkey s, '{D}customer/' || c_custkey c FROM supplier JOIN customer ON s_nationkey = c_nationkey AND c_mktsegment = 'BUILDING'")
def r2rml_join_condition(spark: SparkSession, d: str) -> DataFrame:
    """Parents found by a column that isn't their key."""
    got = {"supplier": spark.read.parquet(f"{d}/supplier.parquet"), "customer": spark.read.parquet(f"{d}/customer.parquet").where("c_mktsegment = 'BUILDING'")}
    text = RR + f"""<#c> rr:logicalTable [ rr:tableName "customer" ] ; rr:subjectMap [ rr:template "{D}customer/{{c_custkey}}" ; rr:class v:Customer ] .
        <#s> rr:logicalTable [ rr:tableName "supplier" ] ; rr:subjectMap [ rr:template "{D}supplier/{{s_suppkey}}" ] ;
        rr:predicateObjectMap [ rr:predicate v:near ; rr:objectMap [ rr:parentTriplesMap <#c> ; rr:joinCondition [ rr:child "s_nationkey" ; rr:parent "c_nationkey" ] ] ] ."""
    return sparql(spark, Dataset(r2rml.load(text, got)), "SELECT ?s ?c WHERE { ?s v:near ?c }", PREFIXES)


# ---- Cypher's catalogues, and full text in expressions


@Q("SELECT n_name AS name, 'Nation' AS label, 3 AS keys, n_regionkey::VARCHAR r FROM nation")
def cypher_labels(spark: SparkSession, d: str) -> DataFrame:
    text = "MATCH (n:Nation) RETURN n.n_name AS name, labels(n)[0] AS label, size(keys(n)) AS keys, properties(n).n_regionkey AS r"
    return cypher(spark, tables.graph(spark, d, ["nation"]), text, V)


@Q("SELECT 'label' AS kind, 'Turn' AS name UNION ALL SELECT 'relation', unnest(['prev', 'next', 'back']) UNION ALL SELECT 'key', unnest(['role', 'number'])")
def cypher_call_db(spark: SparkSession, d: str) -> DataFrame:
    text = """CALL db.labels() YIELD label RETURN 'label' AS kind, label AS name UNION ALL CALL db.relationshipTypes() YIELD relationshipType AS name RETURN 'relation' AS kind, name AS name
        UNION ALL CALL db.propertyKeys() YIELD propertyKey RETURN 'key' AS kind, propertyKey AS name"""
    return cypher(spark, tables.replies(spark, d), text, V)


@Q("SELECT k, turn AS n, count(*) c FROM conversations, (SELECT unnest([1, 2, 3]) k) WHERE turn < 3 GROUP BY ALL")
def cypher_foreach(spark: SparkSession, d: str) -> DataFrame:
    flakes = tables.conversations(spark, d)
    after = cypher_write.write(spark, flakes, "MATCH (a:Turn) WHERE a.number < 3 FOREACH (k IN [1, 2, 3] | CREATE (m:Mark {k: k, n: a.number})-[:of]->(a))", V, 2)
    return cypher(spark, Dataset(fl.FlakeGraph(after)), "MATCH (m:Mark)-[:of]->(a:Turn) WHERE a.number = m.n RETURN m.k AS k, m.n AS n, count(*) AS c", V)


@Q(f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND NOT list_contains(['a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with'], w)) w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) n, avg(len(w)) mean, count(*) FILTER (list_contains(w, 'tionble')) a, count(*) FILTER (list_contains(w, 'ouer')) b FROM t),
x AS (SELECT doc_id, len(w) len, len(list_filter(w, lambda y: y = 'tionble')) ta, len(list_filter(w, lambda y: y = 'ouer')) tb FROM t)
SELECT '{D}document/' || doc_id s, CAST(floor(1000 * (ln(1 + (n - a + 0.5) / (a + 0.5)) * ta * 2.2 / (ta + 1.2 * (0.25 + 0.75 * len / mean)) + ln(1 + (n - b + 0.5) / (b + 0.5)) * tb * 2.2 / (tb + 1.2 * (0.25 + 0.75 * len / mean))) + 0.5) AS BIGINT) score
FROM x, s WHERE ta + tb > 0""")  # fmt: skip
def fulltext_expr(spark: SparkSession, d: str) -> DataFrame:
    text = 'SELECT ?s (xsd:integer(FLOOR(?f * 1000 + 0.5)) AS ?score) WHERE { ?s v:text ?t BIND(fulltext(?t, "tionble the ouer") AS ?f) FILTER(?f > 0) }'
    return sparql(spark, tables.graph(spark, d, ["documents"]), text, PREFIXES)


# ---- inference rules over the reply graph: schema facts, rules, what is asked, and its twin

R1, R2, L1, L2 = V + "R1", V + "R2", "_:l1", "_:l2"
HERE, NEXT, LAST = node("conv_id", "turn"), node("conv_id", "turn + 1"), "(SELECT *, max(turn) OVER (PARTITION BY conv_id) m FROM conversations)"
SOME = [(R1, OWL + "onProperty", V + "next"), (R1, OWL + "someValuesFrom", V + "Turn"), (R2, OWL + "onProperty", V + "prev"), (R2, OWL + "someValuesFrom", OWL + "Thing")]
PAIR = [(L1, RDF + "first", R1), (L1, RDF + "rest", L2), (L2, RDF + "first", R2), (L2, RDF + "rest", RDF + "nil")]
r = reasoning
RULES = {
    "rl_chain": ([(V + "two", OWL + "propertyChainAxiom", L1), (L1, RDF + "first", V + "next"), (L1, RDF + "rest", L2), (L2, RDF + "first", V + "next")], [r.prp_spo2], ("p", V + "two", "s", "o"), f"SELECT {HERE} s, {node('conv_id', 'turn + 2')} o FROM {LAST} WHERE turn + 2 <= m"),
    "rl_equivalent_property": ([(V + "next", OWL + "equivalentProperty", V + "leads")], [r.prp_eqp], ("p", V + "leads", "s", "o"), f"SELECT {HERE} s, {NEXT} o FROM {LAST} WHERE turn < m"),
    "rl_inverse": ([(V + "next", OWL + "inverseOf", V + "after")], [r.prp_inv], ("p", V + "after", "s", "o"), f"SELECT {NEXT} s, {HERE} o FROM {LAST} WHERE turn < m"),
    "rl_equivalent_class": ([(V + "Turn", OWL + "equivalentClass", V + "Post")], [r.cax_eqc], ("o", V + "Post", "s"), f"SELECT {HERE} s FROM conversations"),
    "rl_has_value_1": ([(V + "Turn", RDFS + "subClassOf", R1), (R1, OWL + "onProperty", V + "kind"), (R1, OWL + "hasValue", V + "Spoken")], [r.cax_sco, r.cls_hv1], ("p", V + "kind", "s", "o"), f"SELECT {HERE} s, '{V}Spoken' o FROM conversations"),
    "rl_has_value_2": ([(R1, OWL + "onProperty", V + "prev"), (R1, OWL + "hasValue", D + "turn/1-0")], [r.cls_hv2], ("o", R1, "s"), f"SELECT {HERE} s FROM conversations WHERE conv_id = 1 AND turn = 1"),
    "rl_some_values": (SOME, [r.cls_svf1], ("o", R1, "s"), f"SELECT {HERE} s FROM {LAST} WHERE turn < m"),
    "rl_all_values": ([(V + "Turn", RDFS + "subClassOf", R1), (R1, OWL + "onProperty", V + "next"), (R1, OWL + "allValuesFrom", V + "Reply")], [r.cax_sco, r.cls_avf], ("o", V + "Reply", "s"), f"SELECT {HERE} s FROM conversations WHERE turn > 0"),
    "rl_intersection_1": ([*SOME, *PAIR, (V + "Middle", OWL + "intersectionOf", L1)], [r.cls_svf1, r.cls_int1], ("o", V + "Middle", "s"), f"SELECT {HERE} s FROM {LAST} WHERE turn > 0 AND turn < m"),
    "rl_intersection_2": ([*PAIR, (V + "Turn", OWL + "intersectionOf", L1)], [r.cls_int2], ("o", R2, "s"), f"SELECT {HERE} s FROM conversations"),
    "rl_union": ([*SOME, *PAIR, (V + "Linked", OWL + "unionOf", L1)], [r.cls_svf1, r.cls_uni], ("o", V + "Linked", "s"), f"SELECT {HERE} s FROM {LAST} WHERE turn > 0 OR turn < m"),
    "rl_one_of": ([(V + "First", OWL + "oneOf", L1), (L1, RDF + "first", D + "turn/0-0"), (L1, RDF + "rest", L2), (L2, RDF + "first", D + "turn/1-0"), (L2, RDF + "rest", RDF + "nil")], [r.cls_oo], ("o", V + "First", "s"), f"SELECT unnest(['{D}turn/0-0', '{D}turn/1-0']) s"),
    "rl_inverse_functional": ([(V + "back", TYPE, OWL + "InverseFunctionalProperty")], [r.prp_ifp, r.prp_fp], ("p", OWL + "sameAs", "s", "o"), f"SELECT {HERE} s, {node('conv_id', '3')} o FROM conversations WHERE turn > 3 AND turn % 3 = 0"),
    "rl_functional": ([(V + "holds", RDFS + "subPropertyOf", V + "any"), (V + "after", OWL + "inverseOf", V + "back"), (V + "after", TYPE, OWL + "FunctionalProperty")], [r.prp_inv, r.prp_fp], ("p", OWL + "sameAs", "s", "o"), f"SELECT {HERE} s, {node('conv_id', '3')} o FROM conversations WHERE turn > 3 AND turn % 3 = 0"),
    "rl_key": ([(V + "Turn", OWL + "hasKey", L1), (L1, RDF + "first", V + "back")], [r.prp_key, r.prp_fp], ("p", OWL + "sameAs", "s", "o"), f"SELECT {HERE} s, {node('conv_id', '3')} o FROM conversations WHERE turn > 3 AND turn % 3 = 0"),
    "rl_max_cardinality": ([(V + "Turn", RDFS + "subClassOf", R1), (R1, OWL + "onProperty", V + "after"), (R1, OWL + "maxCardinality", "1"), (V + "after", OWL + "inverseOf", V + "back")], [r.cax_sco, r.prp_inv, r.cls_maxc2, r.prp_fp], ("p", OWL + "sameAs", "s", "o"), f"SELECT {HERE} s, {node('conv_id', '3')} o FROM conversations WHERE turn > 3 AND turn % 3 = 0"),
    "rl_max_qualified": ([(V + "Turn", RDFS + "subClassOf", R1), (R1, OWL + "onProperty", V + "after"), (R1, OWL + "maxQualifiedCardinality", "1"), (R1, OWL + "onClass", V + "Turn"), (V + "after", OWL + "inverseOf", V + "back")], [r.cax_sco, r.prp_inv, r.cls_maxqc3, r.prp_fp], ("p", OWL + "sameAs", "s", "o"), f"SELECT {HERE} s, {node('conv_id', '3')} o FROM conversations WHERE turn > 3 AND turn % 3 = 0"),
}


def _rule(name: str):
    schema, rules, (column, value, *names), sql = RULES[name]

    def query(spark: SparkSession, d: str) -> DataFrame:
        f = _links(tables.conversations(spark, d)).union(spark.createDataFrame(schema, "s string, p string, o string"))
        return reasoning.materialised(f, rules).where((F.col(column) == value) & (F.col("p") == (TYPE if column == "o" else value))).select(*names)

    query.__name__ = name
    Q(sql)(query)


for _name in RULES:
    _rule(_name)


@Q(f"SELECT {HERE} s FROM conversations WHERE turn > 0")
def ql_domain_range(spark: SparkSession, d: str) -> DataFrame:
    """A class by what its members are the subjects and objects of, by rewriting the query."""
    from ..ir import Group, Iri, Triple, Var
    from ..plans.compile import Compiler

    g = reasoning.expand(Group((Triple(Var("s"), Iri(TYPE), Iri(V + "Reply")),)), {}, {}, domains={V + "Reply": [V + "prev"]}, ranges={V + "Reply": [V + "next"]})
    return Compiler(spark, tables.replies(spark, d)).group(g).df


@Q(f"SELECT {HERE} s FROM conversations")
def rdfs_many_classes(spark: SparkSession, d: str) -> DataFrame:
    """More subclasses than a union would take."""
    from ..ir import Group, Iri, Triple, Var
    from ..plans.compile import Compiler

    g = reasoning.expand(Group((Triple(Var("s"), Iri(TYPE), Iri(V + "Act")),)), {V + "Act": [V + "Turn", *(f"{V}C{i}" for i in range(200))]}, {})
    return Compiler(spark, tables.replies(spark, d)).group(g).df.select("s")


SCHEMA = [(V + "Turn", RDFS + "subClassOf", V + "Act"), (V + "next", RDFS + "subPropertyOf", V + "leads"), (V + "back", RDFS + "subPropertyOf", V + "leads"), (V + "next", OWL + "inverseOf", V + "follows"), (V + "prev", RDFS + "range", V + "Answered")]


def _store(spark: SparkSession, d: str) -> Dataset:
    flakes = tables.conversations(spark, d)
    return Dataset(fl.FlakeGraph(flakes.union(fl.facts(spark, SCHEMA).select(flakes.columns))))


@Q(f"SELECT {HERE} a, {NEXT} b FROM {LAST} WHERE turn < m UNION ALL SELECT {HERE}, {node('conv_id', '0')} FROM conversations WHERE turn > 0 AND turn % 3 = 0")
def mode_rdfs(spark: SparkSession, d: str) -> DataFrame:
    return sparql(spark, _store(spark, d), "SELECT ?a ?b WHERE { ?a a v:Act ; v:leads ?b }", PREFIXES, ["rdfs"])


@Q(f"SELECT {NEXT} a, {HERE} b FROM {LAST} WHERE turn < m")
def mode_owl2ql(spark: SparkSession, d: str) -> DataFrame:
    return sparql(spark, _store(spark, d), "SELECT ?a ?b WHERE { ?a v:follows ?b . ?b a v:Answered }", PREFIXES, ["rdfs", "owl2ql"])


@Q(f"SELECT {NEXT} a, {HERE} b, role r FROM {LAST} WHERE turn < m")
def mode_owl2rl(spark: SparkSession, d: str) -> DataFrame:
    """Facts are made, and the query isn't rewritten as well."""
    return sparql(spark, _store(spark, d), "SELECT ?a ?b ?r WHERE { ?a v:follows ?b . ?b a v:Answered ; v:role ?r }", PREFIXES, ["rdfs", "owl2rl"])


@Q(f"SELECT {node('conv_id', 'turn')} a, turn AS n FROM {LAST} WHERE turn + 2 <= m")
def mode_datalog(spark: SparkSession, d: str) -> DataFrame:
    from ..ir import Group, Iri, Triple, Var

    a, b, c = Var("a"), Var("b"), Var("c")
    rule = reasoning.Rule(Group((Triple(a, Iri(V + "next"), b), Triple(b, Iri(V + "next"), c))), [Triple(a, Iri(V + "skips"), c)])
    return sparql(spark, _store(spark, d), "SELECT ?a ?n WHERE { ?a v:skips ?c ; v:number ?n }", PREFIXES, ["datalog"], [rule])


@Q(f"SELECT {node('x.conv_id', 'x.turn')} a, {node('y.conv_id', 'y.turn')} b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn < y.turn AND y.turn < 3")
def policy_under_path(spark: SparkSession, d: str) -> DataFrame:
    """A path walks only what the reader may see: turns with a number under 3."""
    from ..ir import Call, Filter, Group, Iri, Lit, Triple, Var
    from ..operators import policy

    low = Group((Triple(Var("this"), Iri(V + "number"), Var("n")), Filter(Call("<", (Var("n"), Lit(2, XSD + "integer"))))))
    seen = policy.secured(spark, tables.replies(spark, d), [policy.Policy(properties=[V + "next"], query=low)])
    return sparql(spark, seen, "SELECT ?a ?b WHERE { ?a v:next+ ?b }", PREFIXES)


@Q(f"SELECT {HERE} a, {NEXT} b, turn AS n FROM {LAST} WHERE turn < m")
def annotated_edges(spark: SparkSession, d: str) -> DataFrame:
    """What is said of edges, by << >> and {| |}."""
    flakes = tables.conversations(spark, d)
    about = flakes.where(F.col("p") == V + "next").select("s", F.col("p").alias("q"), "o")
    note = F.concat(F.lit("_:n"), F.md5(F.concat_ws("|", "s", "o")))
    from ..ir import ABOUT

    cells = F.array(*[F.struct(F.lit(a).alias("p"), F.col(c).alias("o")) for a, c in zip(ABOUT, ("s", "q", "o"))], F.struct(F.lit(V + "kind").alias("p"), F.lit(V + "Reply").alias("o")))
    notes = about.select(note.alias("note"), F.explode(cells).alias("x")).selectExpr("cast(null as string) g", "note s", "x.p p", "x.o o", "'@id' dt", "cast(null as string) lang", "cast(null as int) i", "1L t", "true op")
    data = Dataset(fl.FlakeGraph(flakes.union(notes)))
    return sparql(spark, data, "SELECT ?a ?b ?n WHERE { ?a v:next ?b {| v:kind v:Reply |} ; v:number ?n . << ?a v:next ?b >> v:kind ?k }", PREFIXES)


@Q(f"SELECT '{D}user/' || user_id s, count(*) n FROM (SELECT user_id, event_type FROM events, (SELECT max(event_id) m FROM events) WHERE event_id <= m // 2 GROUP BY ALL) GROUP BY 1")
def tt_from_moment(spark: SparkSession, d: str) -> DataFrame:
    """A graph at a time by the suffix of its name: by number, by moment and by commit."""
    flakes = tables.event_flakes(spark, d)
    e = spark.read.parquet(f"{d}/events.parquet")
    m = e.agg(F.max("event_id")).first()[0] // 2
    commits = e.select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("id"), F.col("event_id").alias("t"), F.timestamp_seconds(F.col("event_id")).alias("ts"))
    data = Dataset(fl.FlakeGraph(flakes.limit(0)), {D + "events": fl.FlakeGraph(flakes)}, commits=commits)
    text = "SELECT ?s (COUNT(?o) AS ?n) FROM <" + D + "events@{}> WHERE {{ ?s ?p ?o }} GROUP BY ?s"
    moment = spark.range(1).select(F.date_format(F.timestamp_seconds(F.lit(m)), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    one, two, three = (sparql(spark, data, text.format(x), PREFIXES) for x in (f"t:{m}", f"iso:{moment}", f"commit:c{m}"))
    return one.intersect(two).intersect(three)


@Q(f"SELECT {node('x.conv_id', 'x.turn')} s, {node('y.conv_id', 'y.turn')} o FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn < y.turn")
def datalog_in_sparql(spark: SparkSession, d: str) -> DataFrame:
    from .store import _facts

    rules = [reasoning.rule("CONSTRUCT { ?a v:before ?b } WHERE { ?a v:next ?b }", PREFIXES), reasoning.rule("CONSTRUCT { ?a v:before ?c } WHERE { ?a v:before ?b . ?b v:before ?c }", PREFIXES)]
    return reasoning.datalog(spark, _facts(spark, d), rules).where(F.col("p") == V + "before").select("s", "o")


@Q("SELECT 'assert' AS kind, count(*) AS n FROM conversations WHERE role <> 'user' UNION ALL SELECT 'retract', count(*) FROM conversations WHERE role <> 'user'")
def policy_of_writes(spark: SparkSession, d: str) -> DataFrame:
    """A writer who may change numbers of users' turns alone."""
    from ..ir import Group, Iri, Lit, Triple, Var
    from ..operators import policy

    flakes = tables.conversations(spark, d)
    number = flakes.where(F.col("p") == V + "number")
    new = fl.upsert(flakes, number.withColumn("o", F.concat("o", F.lit("0"))).withColumn("o", F.concat(F.lit("1"), "o")).select(*fl.FACT), 2)
    own = Group((Triple(Var("this"), Iri(V + "role"), Lit("user", XSD + "string")),))
    bad = policy.forbidden(spark, flakes, new, [policy.Policy(properties=[V + "number"], query=own)])
    return bad.groupBy(F.when(F.col("op"), "assert").otherwise("retract").alias("kind")).agg(F.count("*").alias("n"))


@Q(f"SELECT {HERE} s FROM conversations")
def schema_imports(spark: SparkSession, d: str) -> DataFrame:
    """Hierarchies over a schema's graph and what it imports."""
    flakes = tables.conversations(spark, d)
    parts = [(D + "a", [(D + "a", OWL + "imports", D + "b"), (V + "Turn", RDFS + "subClassOf", V + "Utterance")]), (D + "b", [(D + "b", OWL + "imports", D + "a"), (V + "Utterance", RDFS + "subClassOf", V + "Act")])]
    named = {g: fl.FlakeGraph(fl.facts(spark, rows, graph=g), graph=g) for g, rows in parts}
    schema = reasoning.bundle(Dataset(fl.FlakeGraph(flakes), named), D + "a").select("s", "p", "o")
    facts = _links(flakes).union(schema)
    return reasoning.materialised(facts, reasoning.RDFS_RULES).where((F.col("p") == TYPE) & (F.col("o") == V + "Act")).select("s")


@Q("SELECT n_nationkey k, '+02:00' AS z, 'PT2H' AS t, 'Z' AS u, 'PT0S' AS w, '' AS e, TIMESTAMP '2024-03-01 10:30:00' AS d, DATE '2024-03-01' AS f, 1.5::DOUBLE x FROM nation")
def fn_times(spark: SparkSession, d: str) -> DataFrame:
    text = """SELECT ?k (TZ("2024-03-01T10:30:00+02:00") AS ?z) (STR(TIMEZONE("2024-03-01T10:30:00+02:00")) AS ?t) (TZ("2024-03-01T10:30:00Z") AS ?u) (STR(TIMEZONE("2024-03-01T10:30:00Z")) AS ?w)
        (TZ("2024-03-01T10:30:00") AS ?e) (xsd:dateTime("2024-03-01T10:30:00") AS ?d) (xsd:date("2024-03-01") AS ?f) (xsd:double("1.5") AS ?x) WHERE { ?s v:n_nationkey ?k }"""
    return sparql(spark, tables.graph(spark, d, ["nation"]), text, PREFIXES)


@Q("SELECT n_name AS n, true b, true s, false i, 'abc' AS c, sha256('x') h FROM nation")
def fn_bnode(spark: SparkSession, d: str) -> DataFrame:
    text = 'SELECT ?n (isBlank(?x) AS ?b) (?x = ?y AS ?s) (isIRI(?x) AS ?i) (CONCAT("a", "b", "c") AS ?c) (SHA256("x") AS ?h) WHERE { ?a v:n_name ?n BIND(BNODE(?n) AS ?x) BIND(BNODE(?n) AS ?y) }'
    return sparql(spark, tables.graph(spark, d, ["nation"]), text, PREFIXES)


@Q(f"SELECT 'n_region' t, '{D}nation/' || n_nationkey a, '{D}region/' || n_regionkey b FROM nation")
def cypher_relation(spark: SparkSession, d: str) -> DataFrame:
    text = "MATCH (x:Nation)-[r:n_region]->(y:Region) RETURN type(r) AS t, startNode(r) AS a, endNode(r) AS b"
    return cypher(spark, tables.graph(spark, d, ["nation", "region"]), text, V)


@Q(f"SELECT '{D}nation/' || n_nationkey s, n_nationkey::VARCHAR k, n_name n, CASE WHEN n_regionkey > 1 THEN n_regionkey::VARCHAR END x FROM nation")
def io_results_json(spark: SparkSession, d: str) -> DataFrame:
    df = _nation_rows(spark, d)
    lines = [r[0] for r in writers.bindings(df).collect()]  # one small document
    import json

    return readers.results_json(spark, json.dumps({"head": {"vars": df.columns}, "results": {"bindings": [json.loads(x) for x in lines]}}))


# ---- constraints on turns: a property's parameters and the twin's rows (focus, path, value)

P = shacl.Property
NUMBER, ROLE, PREV, BEFORE = f"'{V}number'", f"'{V}role'", f"'{V}prev'", node("conv_id", "turn - 1")


def _rows(constraint: str, path: str, where: str, value: str = "NULL::VARCHAR") -> str:
    return f"SELECT {HERE} focus, {path} path, '{constraint}' \"constraint\", {value} \"value\" FROM {LAST} WHERE {where}"


SHAPES = {
    "shacl_max_count": (P(V + "number", max_count=0), _rows("maxCount", NUMBER, "true")),
    "shacl_min_exclusive": (P(V + "number", min_exclusive=2), _rows("minExclusive", NUMBER, "turn <= 2", "turn::VARCHAR")),
    "shacl_max_exclusive": (P(V + "number", max_exclusive=2), _rows("maxExclusive", NUMBER, "turn >= 2", "turn::VARCHAR")),
    "shacl_min_inclusive": (P(V + "number", min_inclusive=2), _rows("minInclusive", NUMBER, "turn < 2", "turn::VARCHAR")),
    "shacl_min_length": (P(V + "role", min_length=5), _rows("minLength", ROLE, "length(role) < 5", "role")),
    "shacl_max_length": (P(V + "role", max_length=5), _rows("maxLength", ROLE, "length(role) > 5", "role")),
    "shacl_node_kind": (P(V + "prev", node_kind="Literal"), _rows("nodeKind", PREV, "turn > 0", BEFORE)),
    "shacl_class": (P(V + "prev", cls=V + "Answer"), _rows("class", PREV, "turn > 0", BEFORE)),
    "shacl_has_value": (P(V + "role", has_value="user"), _rows("hasValue", ROLE, "role <> 'user'")),
    "shacl_in": (P(V + "role", among=["user"]), _rows("in", ROLE, "role <> 'user'", "role")),
    "shacl_equals": (P(V + "prev", equals=V + "next"), _rows("equals", PREV, "turn > 0", BEFORE) + " UNION ALL " + _rows("equals", PREV, "turn < m", NEXT)),
    "shacl_disjoint": (P(V + "prev", disjoint=V + "prev"), _rows("disjoint", PREV, "turn > 0", BEFORE)),
    "shacl_less_than": (P(V + "number", less_than=V + "number"), _rows("lessThan", NUMBER, "true", "turn::VARCHAR")),
    "shacl_less_or_equal": (P(V + "number", less_than_or_equals=V + "role"), _rows("lessThanOrEquals", NUMBER, "true", "turn::VARCHAR")),
    "shacl_language_in": (P(V + "role", language_in=["en"]), _rows("languageIn", ROLE, "true", "role")),
    "shacl_qualified": (P(V + "next", qualified=(_shape(P(V + "back", min_count=1)), 1, None)), _rows("qualifiedMinCount", f"'{V}next'", "turn = m OR (turn + 1) % 3 <> 0")),
    "shacl_not": ({"no": _shape(P(V + "prev", min_count=1))}, _rows("not", "NULL::VARCHAR", "turn > 0", HERE)),
    "shacl_and": ({"every": [_shape(P(V + "prev", min_count=1)), _shape(P(V + "next", min_count=1))]}, _rows("and", "NULL::VARCHAR", "turn = 0 OR turn = m", HERE)),
    "shacl_or": ({"some": [_shape(P(V + "back", min_count=1)), _shape(P(V + "next", min_count=1))]}, _rows("or", "NULL::VARCHAR", "turn = m AND NOT (turn % 3 = 0 AND turn > 0)", HERE)),
    "shacl_inverse_path": (P("^" + V + "next", min_count=1), _rows("minCount", f"'^{V}next'", "turn = 0")),
    "shacl_sequence_path": (P(f"{V}next/{V}next", min_count=1), _rows("minCount", f"'{V}next/{V}next'", "turn + 2 > m")),
    "shacl_alternative_path": (P(f"{V}prev|{V}next", min_count=2), _rows("minCount", f"'{V}prev|{V}next'", "turn = 0 OR turn = m")),
}


def _constraint(name: str):
    prop, sql = SHAPES[name]

    def query(spark: SparkSession, d: str) -> DataFrame:
        return _report(spark, d, _shape(**prop) if isinstance(prop, dict) else _shape(prop))

    query.__name__ = name
    Q(sql)(query)


for _name in SHAPES:
    _constraint(_name)


@Q(" UNION ALL ".join([_rows("minCount", f"'{V}next/{V}next'", "turn + 2 > m"), _rows("in", ROLE, "role <> 'user'", "role"), _rows("not", "NULL::VARCHAR", "turn > 0", HERE)]))
def shacl_shapes_graph(spark: SparkSession, d: str) -> DataFrame:
    """Shapes read from a graph."""
    text = """@prefix sh: <http://www.w3.org/ns/shacl#> .
        @prefix v: <http://tables/voc/> .
        v:S sh:targetClass v:Turn ; sh:property [ sh:path ( v:next v:next ) ; sh:minCount 1 ], [ sh:path v:role ; sh:in ( "user" ) ] ; sh:not [ sh:property [ sh:path v:prev ; sh:minCount 1 ] ] ."""
    return shacl.validate(tables.conversations(spark, d), shacl.shapes_of(readers.turtle(spark, text)))


# ---- readers and writers: what is written and read again, and lines of each format


def _nation_facts(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    cells = "array(struct('name' p, n_name o, 'string' dt), struct('key' p, cast(n_nationkey as string) o, 'integer' dt), struct('in' p, concat('%sregion/', n_regionkey) o, '@id' dt))" % D
    x = n.selectExpr(f"concat('{D}nation/', n_nationkey) s", f"explode({cells}) x")
    return x.selectExpr("cast(null as string) g", "s", f"concat('{V}', x.p) p", "x.o o", f"if(x.dt = '@id', x.dt, concat('{XSD}', x.dt)) dt", "cast(null as string) lang", "cast(null as int) i", "1L t", "true op")


NATIONS = f"SELECT '{D}nation/' || n_nationkey s, '{V}name' p, n_name o, '{XSD}string' dt FROM nation UNION ALL SELECT '{D}nation/' || n_nationkey, '{V}key', n_nationkey::VARCHAR, '{XSD}integer' FROM nation UNION ALL SELECT '{D}nation/' || n_nationkey, '{V}in', '{D}region/' || n_regionkey, '@id' FROM nation"


@Q(NATIONS)
def io_nquads(spark: SparkSession, d: str) -> DataFrame:
    return readers.read(spark, _lines(writers.nquads(_nation_facts(spark, d)), "nq") + "/*.nq").select("s", "p", "o", "dt")


@Q(NATIONS)
def io_turtle(spark: SparkSession, d: str) -> DataFrame:
    """N-Triples are Turtle."""
    lines = [r[0] for r in writers.nquads(_nation_facts(spark, d)).collect()]  # one small document
    return readers.turtle(spark, "\n".join(lines)).select("s", "p", "o", "dt")


@Q(NATIONS)
def io_jsonld(spark: SparkSession, d: str) -> DataFrame:
    lines = [r[0] for r in writers.nodes(_nation_facts(spark, d)).collect()]
    return readers.jsonld(spark, "[" + ",".join(lines) + "]").select("s", "p", "o", "dt")


@Q(f"SELECT n_nationkey::VARCHAR s, '{V}' || x.k p, x.v o FROM (SELECT n_nationkey, unnest([{{'k': 'n_name', 'v': n_name}}, {{'k': 'n_regionkey', 'v': n_regionkey::VARCHAR}}]) x FROM nation)")
def io_ndjson(spark: SparkSession, d: str) -> DataFrame:
    path = _lines(writers.compact(spark.read.parquet(f"{d}/nation.parquet")), "json")
    return readers.ndjson(spark, path + "/*.json", "n_nationkey", V).select("s", "p", "o")


@Q(f"SELECT n_nationkey::VARCHAR s, '{V}' || x.k p, x.v o FROM (SELECT n_nationkey, unnest([{{'k': 'n_name', 'v': n_name}}, {{'k': 'n_regionkey', 'v': n_regionkey::VARCHAR}}]) x FROM nation)")
def io_csv(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    head = spark.createDataFrame([(",".join(n.columns),)], "value string")
    path = _lines(head.union(writers.delimited(n)).coalesce(1), "csv")
    return readers.csv(spark, path + "/*.csv", "n_nationkey", V).select("s", "p", "o")


@Q(f"SELECT '{V}Nation/' || n_nationkey s, '{V}name' p, n_name o FROM nation UNION ALL SELECT '{V}Nation/' || n_nationkey, '{V}id', n_nationkey::VARCHAR FROM nation UNION ALL SELECT '{V}Nation/' || n_nationkey, '{TYPE}', '{V}Nation' FROM nation UNION ALL SELECT '{V}Nation/' || n_nationkey, '{V}NEXT', '{V}Nation/' || (n_nationkey + 1) FROM nation WHERE n_nationkey < 24")
def io_cypher_dump(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    make = n.select(F.concat(F.lit("CREATE (:Nation {id: "), F.col("n_nationkey").cast("string"), F.lit(", name: '"), F.replace("n_name", F.lit("'"), F.lit("\\'")), F.lit("'});")).alias("value"))
    link = n.where("n_nationkey < 24").select(F.concat(F.lit("MATCH (a:Nation {id: "), F.col("n_nationkey").cast("string"), F.lit("}), (b:Nation {id: "), (F.col("n_nationkey") + 1).cast("string"), F.lit("}) CREATE (a)-[:NEXT]->(b);")).alias("value"))
    return readers.cypher_dump(spark, _lines(make.union(link), "cypher") + "/*.cypher", V).select("s", "p", "o")


def _nation_rows(spark: SparkSession, d: str) -> DataFrame:
    return sparql(spark, tables.graph(spark, d, ["nation"]), "SELECT ?s ?k ?n ?x WHERE { ?s v:n_nationkey ?k ; v:n_name ?n OPTIONAL { ?s v:n_regionkey ?x FILTER(?x > 1) } }", PREFIXES)


_S, _X = f"'{D}nation/' || n_nationkey", "CASE WHEN n_regionkey > 1 THEN {} ELSE '' END"
_INT = f"{XSD}integer"


@Q(f"""SELECT '{{"s":{{"type":"uri","value":"' || {_S} || '"}},"k":{{"type":"literal","value":"' || n_nationkey || '","datatype":"{_INT}"}},"n":{{"type":"literal","value":"' || n_name || '"}}' || {_X.format(f"',\"x\":{{\"type\":\"literal\",\"value\":\"' || n_regionkey || '\",\"datatype\":\"{_INT}\"}}'")} || '}}' "value" FROM nation""")
def out_json(spark: SparkSession, d: str) -> DataFrame:
    return writers.bindings(_nation_rows(spark, d))


@Q(f"""SELECT '<result><binding name="s"><uri>' || {_S} || '</uri></binding><binding name="k"><literal datatype="{_INT}">' || n_nationkey || '</literal></binding><binding name="n"><literal>' || n_name || '</literal></binding>' || {_X.format(f"'<binding name=\"x\"><literal datatype=\"{_INT}\">' || n_regionkey || '</literal></binding>'")} || '</result>' "value" FROM nation""")
def out_xml(spark: SparkSession, d: str) -> DataFrame:
    return writers.results_xml(_nation_rows(spark, d))


@Q(f"""SELECT '{{"s":{{"@id":"' || {_S} || '"}},"k":{{"@value":"' || n_nationkey || '","@type":"{_INT}"}},"n":{{"@value":"' || n_name || '","@type":"{XSD}string"}}' || {_X.format(f"',\"x\":{{\"@value\":\"' || n_regionkey || '\",\"@type\":\"{_INT}\"}}'")} || '}}' "value" FROM nation""")
def out_typed_json(spark: SparkSession, d: str) -> DataFrame:
    return writers.typed(_nation_rows(spark, d))


@Q(f"""SELECT '{{"s":"d:nation/' || n_nationkey || '","k":' || n_nationkey || ',"n":"' || n_name || '"' || {_X.format("',\"x\":' || n_regionkey")} || '}}' "value" FROM nation""")
def out_compact_json(spark: SparkSession, d: str) -> DataFrame:
    return writers.compact(_nation_rows(spark, d), PREFIXES)


@Q(f"""SELECT '{{"row":["' || {_S} || '",' || n_nationkey || ',"' || n_name || '",' || CASE WHEN n_regionkey > 1 THEN n_regionkey::VARCHAR ELSE 'null' END || ']}}' "value" FROM nation""")
def out_cypher_json(spark: SparkSession, d: str) -> DataFrame:
    return writers.cypher_json(_nation_rows(spark, d))


@Q(f"""SELECT {_S} || chr(9) || n_nationkey || chr(9) || n_name || chr(9) || {_X.format("n_regionkey::VARCHAR")} "value" FROM nation""")
def out_tsv(spark: SparkSession, d: str) -> DataFrame:
    return writers.delimited(_nation_rows(spark, d), "\t")


__all__ = ["QUERIES", "SQL", "Ref"]
