"""Named queries with their twins in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..engine import cypher, jsonld, sparql
from . import tables
from .tables import PREFIXES, V, D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def S(name: str, text: str, sql: str | None, tables_: str = "", then=None) -> None:
    """A SPARQL query over the virtual graph of some tables. then: casts of its result."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = sparql(spark, tables.graph(spark, sf_dir, tables_.split() or None), text, PREFIXES)
        return then(df) if then else df

    _add(name, f, sql)


def R(name: str, text: str, sql: str | None) -> None:
    """A SPARQL query over the reply graph."""
    _add(name, lambda spark, d: sparql(spark, tables.replies(spark, d), text, PREFIXES), sql)


def C(name: str, text: str, sql: str | None, tables_: str = "", replies: bool = False) -> None:
    _add(name, lambda spark, d: cypher(spark, tables.replies(spark, d) if replies else tables.graph(spark, d, tables_.split() or None), text, V), sql)


def J(name: str, query: dict, sql: str | None, tables_: str = "") -> None:
    _add(name, lambda spark, d: jsonld(spark, tables.graph(spark, d, tables_.split() or None), {"@context": {"v": V, "d": D}, **query}), sql)


# ---- scans, joins, aggregates

S(
    "tpch_q1",
    """SELECT ?f ?s (ROUND(SUM(?q)) AS ?sum_qty) (ROUND(SUM(?p)) AS ?sum_base) (ROUND(SUM(?p * (1 - ?d))) AS ?sum_disc) (ROUND(SUM(?p * (1 - ?d) * (1 + ?t))) AS ?sum_charge) (ROUND(AVG(?q) * 1000) AS ?avg_qty) (COUNT(?l) AS ?n)
    WHERE { ?l v:l_returnflag ?f ; v:l_linestatus ?s ; v:l_quantity ?q ; v:l_extendedprice ?p ; v:l_discount ?d ; v:l_tax ?t ; v:l_shipdate ?sd FILTER(?sd <= "1998-09-02"^^xsd:date) }
    GROUP BY ?f ?s ORDER BY ?f ?s""",
    """SELECT l_returnflag f, l_linestatus s, floor(sum(l_quantity) + 0.5) sum_qty, floor(sum(l_extendedprice) + 0.5) sum_base, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) sum_disc,
    floor(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) + 0.5) sum_charge, floor(avg(l_quantity) * 1000 + 0.5) avg_qty, count(*) n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2 ORDER BY 1, 2""",
    "lineitem",
)
S(
    "tpch_q6",
    """SELECT (ROUND(SUM(?p * ?d)) AS ?revenue) WHERE { ?l v:l_shipdate ?sd ; v:l_discount ?d ; v:l_quantity ?q ; v:l_extendedprice ?p
    FILTER(?sd >= "1994-01-01"^^xsd:date && ?sd < "1995-01-01"^^xsd:date && ?d >= 0.05 && ?d <= 0.07 && ?q < 24) }""",
    "SELECT floor(coalesce(sum(l_extendedprice * l_discount), 0) + 0.5) revenue FROM lineitem WHERE l_shipdate >= DATE '1994-01-01' AND l_shipdate < DATE '1995-01-01' AND l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24",
    "lineitem",
)
S(
    "tpch_q3",
    """SELECT ?o ?od (ROUND(SUM(?p * (1 - ?d))) AS ?revenue) WHERE { ?c v:c_mktsegment "BUILDING" . ?o v:o_customer ?c ; v:o_orderdate ?od . ?l v:l_order ?o ; v:l_extendedprice ?p ; v:l_discount ?d ; v:l_shipdate ?sd
    FILTER(?od < "1995-03-15"^^xsd:date && ?sd > "1995-03-15"^^xsd:date) } GROUP BY ?o ?od ORDER BY DESC(?revenue) ?o LIMIT 10""",
    f"""SELECT '{D}order/' || o_orderkey o, o_orderdate od, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1995-03-15' AND l_shipdate > DATE '1995-03-15' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o LIMIT 10""",
    "customer orders lineitem",
)
S(
    "rollup_2hop_region",
    "SELECT ?name (ROUND(SUM(?t)) AS ?total) (COUNT(?o) AS ?n) WHERE { ?o v:o_customer ?c ; v:o_totalprice ?t . ?c v:c_nation ?na . ?na v:n_region ?r . ?r v:r_name ?name } GROUP BY ?name",
    "SELECT r_name AS name, floor(sum(o_totalprice) + 0.5) total, count(*) n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "orders customer nation region",
)
S("bgp_star", 'SELECT ?c ?n ?b WHERE { ?c a v:Customer ; v:c_name ?n ; v:c_acctbal ?b ; v:c_mktsegment "MACHINERY" }', f"SELECT '{D}customer/' || c_custkey c, c_name n, c_acctbal b FROM customer WHERE c_mktsegment = 'MACHINERY'", "customer")
S("bgp_chain", "SELECT ?cn ?rn WHERE { ?c v:c_name ?cn ; v:c_nation ?n . ?n v:n_region ?r . ?r v:r_name ?rn }", "SELECT c_name cn, r_name rn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "customer nation region")
S(
    "bgp_cycle",
    "SELECT (COUNT(*) AS ?n) WHERE { ?l v:l_order ?o ; v:l_supplier ?s . ?o v:o_customer ?c . ?c v:c_nation ?x . ?s v:s_nation ?x }",
    "SELECT count(*) n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey",
    "lineitem orders customer supplier",
)
S("constant_subject", f"SELECT ?n ?b WHERE {{ <{D}customer/7> v:c_name ?n ; v:c_acctbal ?b }}", "SELECT c_name n, c_acctbal b FROM customer WHERE c_custkey = 7", "customer")
S("repeated_var", "SELECT ?l WHERE { ?l v:l_quantity ?x ; v:l_linenumber ?x }", None, "lineitem", lambda df: df.selectExpr("count(*) n", "count(distinct l) d"))
SQL["repeated_var"] = "SELECT count(*) n, count(*) d FROM lineitem WHERE l_quantity = l_linenumber"
S("wildcard_predicate", "SELECT ?p (COUNT(?o) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p", f"""SELECT '{V}' || p p, n FROM (SELECT 'r_regionkey' p, count(r_regionkey) n FROM region UNION ALL SELECT 'r_name', count(r_name) FROM region UNION ALL
    SELECT 'n_nationkey', count(n_nationkey) FROM nation UNION ALL SELECT 'n_name', count(n_name) FROM nation UNION ALL SELECT 'n_regionkey', count(n_regionkey) FROM nation UNION ALL SELECT 'n_region', count(n_regionkey) FROM nation)
    UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation)""", "region nation")  # fmt: skip
S("class_census", "SELECT ?c (COUNT(?s) AS ?n) WHERE { ?s a ?c } GROUP BY ?c", f"""SELECT '{V}Region' c, count(*) n FROM region UNION ALL SELECT '{V}Nation', count(*) FROM nation UNION ALL SELECT '{V}Customer', count(*) FROM customer
    UNION ALL SELECT '{V}Supplier', count(*) FROM supplier UNION ALL SELECT '{V}Part', count(*) FROM part UNION ALL SELECT '{V}Order', count(*) FROM orders UNION ALL SELECT '{V}Lineitem', count(*) FROM lineitem""", "region nation customer supplier part orders lineitem")  # fmt: skip
R("predicate_histogram", "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p", f"""SELECT '{V}role' p, count(*) n FROM conversations UNION ALL SELECT '{V}number', count(*) FROM conversations UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', count(*) FROM conversations
    UNION ALL SELECT '{V}prev', count(*) FROM conversations WHERE turn > 0 UNION ALL SELECT '{V}next', count(*) FROM conversations WHERE turn > 0 UNION ALL SELECT '{V}back', count(*) FROM conversations WHERE turn > 0 AND turn % 3 = 0""")  # fmt: skip

# ---- optional, negation

S("optional_single", 'SELECT ?n ?o WHERE { ?c v:c_name ?n ; v:c_acctbal ?b FILTER(?b < 0) OPTIONAL { ?o v:o_customer ?c ; v:o_orderstatus "P" } }', f"SELECT c_name n, '{D}order/' || o_orderkey o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_acctbal < 0", "customer orders")
S("optional_filter_in_on", "SELECT ?n (COUNT(?o) AS ?k) WHERE { ?c v:c_name ?n ; v:c_acctbal ?b OPTIONAL { ?o v:o_customer ?c ; v:o_totalprice ?t FILTER(?t > 300000 || ?b < 0) } } GROUP BY ?n", "SELECT c_name n, count(o_orderkey) k FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND (o_totalprice > 300000 OR c_acctbal < 0) GROUP BY 1", "customer orders")
S("optional_nested", """SELECT ?o (COUNT(?q) AS ?k) WHERE { ?o v:o_orderpriority "1-URGENT" OPTIONAL { ?l v:l_order ?o ; v:l_quantity ?q FILTER(?q > 45) OPTIONAL { ?l v:l_part ?p . ?p v:p_size 1 } } } GROUP BY ?o""",
    f"SELECT '{D}order/' || o_orderkey o, count(l_quantity) k FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderkey", "orders lineitem part")
S("optional_grouped", "SELECT ?o (COUNT(?pn) AS ?k) WHERE { ?o a v:Order OPTIONAL { ?l v:l_order ?o ; v:l_part ?p . ?p v:p_name ?pn ; v:p_size ?z FILTER(?z > 40) } } GROUP BY ?o", f"SELECT '{D}order/' || o_orderkey o, count(p_name) k FROM orders LEFT JOIN (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 40) ON l_orderkey = o_orderkey GROUP BY o_orderkey", "orders lineitem part")
S("coalesce_unbound_join", "SELECT ?c ?v WHERE { ?c a v:Customer OPTIONAL { ?o v:o_customer ?c ; v:o_orderpriority ?pr ; v:o_totalprice ?t FILTER(?t > 400000) } BIND(COALESCE(?pr, \"none\") AS ?v) }", f"SELECT '{D}customer/' || c_custkey c, coalesce(o_orderpriority, 'none') v FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000", "customer orders")
S("not_exists", "SELECT ?o WHERE { ?o a v:Order FILTER NOT EXISTS { ?l v:l_order ?o } }", f"SELECT '{D}order/' || o_orderkey o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", "orders lineitem")
S("exists", "SELECT (COUNT(?o) AS ?n) WHERE { ?o a v:Order FILTER EXISTS { ?l v:l_order ?o ; v:l_returnflag \"R\" } }", "SELECT count(*) n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')", "orders lineitem")
S("not_exists_inner_filter", "SELECT (COUNT(?o) AS ?n) WHERE { ?o v:o_totalprice ?t FILTER NOT EXISTS { ?l v:l_order ?o ; v:l_extendedprice ?p FILTER(?p > ?t / 4) } }", "SELECT count(*) n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice > o_totalprice / 4)", "orders lineitem")
S("exists_in_or", "SELECT (COUNT(?o) AS ?n) WHERE { ?o v:o_totalprice ?t FILTER(?t < 5000 || EXISTS { ?l v:l_order ?o ; v:l_quantity 50 }) }", "SELECT count(*) n FROM orders WHERE o_totalprice < 5000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50)", "orders lineitem")
S("minus_shared", "SELECT ?o WHERE { ?o a v:Order MINUS { ?l v:l_order ?o ; v:l_linestatus ?x } }", f"SELECT '{D}order/' || o_orderkey o FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", "orders lineitem")
S("minus_disjoint_vars", "SELECT (COUNT(?r) AS ?n) WHERE { ?r a v:Region MINUS { ?x v:n_name ?y } }", "SELECT count(*) n FROM region", "region nation")
S("semi_join_distinct", "SELECT (COUNT(DISTINCT ?c) AS ?n) WHERE { ?o v:o_customer ?c . ?l v:l_order ?o ; v:l_returnflag \"A\" }", "SELECT count(DISTINCT o_custkey) n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'", "orders lineitem")

# ---- values, union, subqueries

S("values_one", 'SELECT ?n ?s WHERE { VALUES ?s { "BUILDING" "FURNITURE" } ?c v:c_mktsegment ?s ; v:c_name ?n }', "SELECT c_name n, c_mktsegment s FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')", "customer")
S("values_undef", 'SELECT ?f ?s (COUNT(*) AS ?n) WHERE { ?l v:l_returnflag ?f ; v:l_linestatus ?s VALUES (?f ?s) { ("A" UNDEF) (UNDEF "O") } } GROUP BY ?f ?s', "SELECT l_returnflag f, l_linestatus s, count(*) n FROM lineitem JOIN (VALUES ('A', NULL), (NULL, 'O')) v(a, b) ON (a IS NULL OR a = l_returnflag) AND (b IS NULL OR b = l_linestatus) GROUP BY 1, 2", "lineitem")
S("values_iri", f"SELECT ?n WHERE {{ ?x v:n_name ?n VALUES ?x {{ <{D}nation/3> <{D}nation/9> <http://other/1> }} }}", "SELECT n_name n FROM nation WHERE n_nationkey IN (3, 9)", "nation")
S("union_pad", "SELECT ?a ?b WHERE { { ?x v:r_name ?a } UNION { ?y v:n_name ?b } }", "SELECT r_name a, NULL::VARCHAR b FROM region UNION ALL SELECT NULL, n_name FROM nation", "region nation")
S("union_distinct", "SELECT DISTINCT ?k WHERE { { ?x v:c_nation ?k } UNION { ?y v:s_nation ?k } }", f"SELECT DISTINCT '{D}nation/' || k k FROM (SELECT c_nationkey k FROM customer UNION ALL SELECT s_nationkey FROM supplier)", "customer supplier")
S("union_star_count", "SELECT (COUNT(*) AS ?n) WHERE { { ?c v:c_nation ?k } UNION { ?c v:s_nation ?k } ?k v:n_name ?m }", "SELECT count(*) n FROM (SELECT c_nationkey k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey", "customer supplier nation")
S("subselect_agg", "SELECT ?n ?k WHERE { ?c v:c_name ?n { SELECT ?c (COUNT(?o) AS ?k) WHERE { ?o v:o_customer ?c } GROUP BY ?c HAVING(COUNT(?o) > 12) } }", "SELECT c_name n, k FROM customer JOIN (SELECT o_custkey, count(*) k FROM orders GROUP BY 1 HAVING count(*) > 12) ON o_custkey = c_custkey", "customer orders")
S("subselect_limit", "SELECT ?n ?t WHERE { { SELECT ?o ?t WHERE { ?o v:o_totalprice ?t } ORDER BY DESC(?t) LIMIT 5 } ?o v:o_customer ?c . ?c v:c_name ?n }", "SELECT c_name n, o_totalprice t FROM (SELECT * FROM orders ORDER BY o_totalprice DESC LIMIT 5) JOIN customer ON o_custkey = c_custkey", "customer orders")
S("above_average", "SELECT ?o ?t WHERE { { SELECT (AVG(?x) AS ?m) WHERE { ?y v:o_totalprice ?x } } ?o v:o_totalprice ?t FILTER(?t > 1.5 * ?m) }", f"SELECT '{D}order/' || o_orderkey o, o_totalprice t FROM orders WHERE o_totalprice > 1.5 * (SELECT avg(o_totalprice) FROM orders)", "orders")
C("lateral_top1", "MATCH (n:Nation) CALL (n) { MATCH (c:Customer)-[:c_nation]->(n) RETURN c.c_name AS who, c.c_acctbal AS b ORDER BY b DESC, who LIMIT 1 } RETURN n.n_name AS name, who, b", "SELECT n_name AS name, c_name who, c_acctbal b FROM nation JOIN customer ON c_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_name) = 1", "nation customer")
S("cartesian_filter", "SELECT (COUNT(*) AS ?n) WHERE { ?a v:n_nationkey ?x . ?b v:r_regionkey ?y FILTER(?x < ?y * 5) }", "SELECT count(*) n FROM nation, region WHERE n_nationkey < r_regionkey * 5", "nation region")
S("equality_filter_join", "SELECT (COUNT(*) AS ?n) WHERE { ?c v:c_nation ?x . ?s v:s_nation ?y FILTER(?x = ?y) }", "SELECT count(*) n FROM customer JOIN supplier ON c_nationkey = s_nationkey", "customer supplier")
S("bind_constraint", "SELECT ?p ?u WHERE { ?p v:p_retailprice ?r ; v:p_size ?z BIND(?r / ?z AS ?q) BIND(FLOOR(?q) AS ?u) FILTER(?u > 500) }", f"SELECT '{D}part/' || p_partkey p, floor(p_retailprice / p_size) u FROM part WHERE floor(p_retailprice / p_size) > 500", "part")

# ---- aggregates

S("agg_count_variants", "SELECT (COUNT(*) AS ?a) (COUNT(?p) AS ?b) (COUNT(DISTINCT ?p) AS ?c) (COUNT(DISTINCT *) AS ?d) WHERE { ?o v:o_orderpriority ?p ; v:o_orderstatus ?s }", "SELECT count(*) a, count(o_orderpriority) b, count(DISTINCT o_orderpriority) c, count(DISTINCT o_orderkey) d FROM orders", "orders")
S("agg_distinct", "SELECT ?s (SUM(DISTINCT ?z) AS ?t) (COUNT(DISTINCT ?z) AS ?n) WHERE { ?p v:p_brand ?s ; v:p_size ?z } GROUP BY ?s", "SELECT p_brand s, CAST(sum(DISTINCT p_size) AS BIGINT) t, count(DISTINCT p_size) n FROM part GROUP BY 1", "part")
S("agg_stats", "SELECT ?s (ROUND(MEDIAN(?b) * 100) AS ?med) (ROUND(VARIANCE(?b)) AS ?var) (ROUND(STDDEV(?b) * 100) AS ?dev) WHERE { ?c v:c_mktsegment ?s ; v:c_acctbal ?b } GROUP BY ?s", "SELECT c_mktsegment s, floor(median(c_acctbal) * 100 + 0.5) med, floor(var_pop(c_acctbal) + 0.5) \"var\", floor(stddev_pop(c_acctbal) * 100 + 0.5) dev FROM customer GROUP BY 1", "customer")
S("agg_stats_distinct", "SELECT ?b (MEDIAN(DISTINCT ?z) * 2 AS ?m) (ROUND(VARIANCE(DISTINCT ?z) * 100) AS ?v) (ROUND(AVG(DISTINCT ?z) * 100) AS ?a) WHERE { ?p v:p_brand ?b ; v:p_size ?z } GROUP BY ?b", None, "part", lambda df: df.selectExpr("b", "cast(m as double) m", "cast(v as bigint) v", "cast(a as bigint) a"))
SQL["agg_stats_distinct"] = "SELECT p_brand b, median(p_size) * 2.0::DOUBLE m, CAST(floor(var_pop(p_size) * 100 + 0.5) AS BIGINT) v, CAST(floor(avg(p_size) * 100 + 0.5) AS BIGINT) a FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY 1"
S("fn_seconds", "SELECT ?e (SECONDS(?t) AS ?s) WHERE { ?e v:ts ?t ; v:event_type \"purchase\" }", None, "events", lambda df: df.selectExpr("e", "cast(floor(s) as bigint) s"))
SQL["fn_seconds"] = f"SELECT '{D}event/' || event_id e, CAST(second(ts) AS BIGINT) s FROM events WHERE event_type = 'purchase'"
S("agg_group_concat", 'SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=", ") AS ?names) WHERE { ?x v:n_region ?y ; v:n_name ?n . ?y v:r_name ?r } GROUP BY ?r', "SELECT r_name r, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1", "nation region")
S("agg_min_max", "SELECT ?s (MIN(?d) AS ?lo) (MAX(?d) AS ?hi) (SAMPLE(?s) AS ?any) WHERE { ?o v:o_orderstatus ?s ; v:o_orderdate ?d } GROUP BY ?s", 'SELECT o_orderstatus s, min(o_orderdate) lo, max(o_orderdate) hi, o_orderstatus "any" FROM orders GROUP BY 1', "orders")
S("agg_empty_zero", "SELECT (SUM(?q) AS ?s) (AVG(?q) AS ?a) (COUNT(?q) AS ?n) WHERE { ?l v:l_quantity ?q FILTER(?q > 1000000) }", "SELECT 0.0::DOUBLE s, 0.0::DOUBLE a, 0::BIGINT n", "lineitem")
S("agg_avg_integer", "SELECT ?b (AVG(?z) * 1000 AS ?m) WHERE { ?p v:p_brand ?b ; v:p_size ?z } GROUP BY ?b", None, "part", lambda df: df.selectExpr("b", "cast(floor(m) as bigint) m"))
SQL["agg_avg_integer"] = "SELECT p_brand b, CAST(floor(sum(p_size)::DECIMAL(30,10) / count(*) * 1000) AS BIGINT) m FROM part GROUP BY 1"
S("group_by_expr", "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o v:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT CAST(year(o_orderdate) AS INTEGER) y, count(*) n FROM orders GROUP BY 1", "orders")
S("having", "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o v:o_customer ?c } GROUP BY ?c HAVING(COUNT(?o) > 10 && MAX(?o) != <http://none>)", f"SELECT '{D}customer/' || o_custkey c, count(*) n FROM orders GROUP BY o_custkey HAVING count(*) > 10", "orders")
S("group_no_agg", "SELECT ?a ?b WHERE { ?o v:o_orderstatus ?a ; v:o_orderpriority ?b } GROUP BY ?a ?b", "SELECT DISTINCT o_orderstatus a, o_orderpriority b FROM orders", "orders")
J("agg_collect", {"select": ["?r", "(as (collect ?n) ?names)"], "where": [{"@id": "?x", "v:n_region": {"@id": "?y", "v:r_name": "?r"}, "v:n_name": "?n"}], "groupBy": "?r"}, None, "nation region")
QUERIES["agg_collect"] = lambda spark, d, f=QUERIES["agg_collect"]: f(spark, d).selectExpr("r", "array_join(sort_array(names), '|') names")
SQL["agg_collect"] = "SELECT r_name r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"

# ---- order

S("topk", "SELECT ?o ?t WHERE { ?o v:o_totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 25", f"SELECT '{D}order/' || o_orderkey o, o_totalprice t FROM orders ORDER BY t DESC, o LIMIT 25", "orders")
S("offset_limit", "SELECT ?n WHERE { ?c v:c_name ?n } ORDER BY ?n OFFSET 40 LIMIT 20", "SELECT c_name n FROM customer ORDER BY 1 LIMIT 20 OFFSET 40", "customer")
S("distinct_order_limit", "SELECT DISTINCT ?b ?z WHERE { ?p v:p_brand ?b ; v:p_size ?z } ORDER BY DESC(?z) ?b LIMIT 30", "SELECT DISTINCT p_brand b, p_size z FROM part ORDER BY z DESC, b LIMIT 30", "part")
S("sort_desc_multi", "SELECT ?s ?b ?n WHERE { ?c v:c_mktsegment ?s ; v:c_acctbal ?b ; v:c_name ?n } ORDER BY ?s DESC(?b)", "SELECT c_mktsegment s, c_acctbal b, c_name n FROM customer", "customer")
S("sort_nulls", "SELECT ?c ?t WHERE { ?c a v:Customer OPTIONAL { ?o v:o_customer ?c ; v:o_totalprice ?t FILTER(?t > 450000) } } ORDER BY ?t ?c", f"SELECT '{D}customer/' || c_custkey c, o_totalprice t FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000 ORDER BY t NULLS FIRST, c", "customer orders")

# ---- functions

S("fn_string", """SELECT ?n (STRLEN(?n) AS ?a) (UCASE(?n) AS ?b) (LCASE(?n) AS ?c) (SUBSTR(?n, 3, 4) AS ?d) (CONCAT(?n, "-", ?n) AS ?e) (STRBEFORE(?n, "_") AS ?f) (STRAFTER(?n, "_") AS ?g) (STRBEFORE(?n, "?") AS ?h)
    (CONTAINS(?n, "ON_1") AS ?i) (STRSTARTS(?n, "NAT") AS ?j) (STRENDS(?n, "3") AS ?k) (REPLACE(?n, "A.I", "x") AS ?m) WHERE { ?x v:n_name ?n }""",
    """SELECT n_name n, length(n_name) a, upper(n_name) b, lower(n_name) c, substr(n_name, 3, 4) d, n_name || '-' || n_name e, split_part(n_name, '_', 1) f, substr(n_name, strpos(n_name, '_') + 1) g, '' h,
    contains(n_name, 'ON_1') i, starts_with(n_name, 'NAT') j, suffix(n_name, '3') k, regexp_replace(n_name, 'A.I', 'x', 'g') m FROM nation""", "nation")  # fmt: skip
S("fn_regex", 'SELECT (COUNT(*) AS ?n) WHERE { ?p v:p_name ?x FILTER(REGEX(?x, "(1|2)5$", "i")) }', "SELECT count(*) n FROM part WHERE regexp_matches(p_name, '(?i)(1|2)5$')", "part")
S("fn_regex_prefix", 'SELECT (COUNT(*) AS ?n) WHERE { ?p v:c_name ?x FILTER(REGEX(?x, "^Customer")) }', "SELECT count(*) n FROM customer WHERE starts_with(c_name, 'Customer')", "customer")
S("fn_string_fold", "SELECT (SUM(STRLEN(?t)) AS ?n) WHERE { ?d v:text ?t }", "SELECT CAST(sum(length(text)) AS BIGINT) n FROM documents", "documents")
S("fn_uri", "SELECT ?d (ENCODE_FOR_URI(CONCAT(?s, \" a~*+\")) AS ?u) (IRI(CONCAT(\"http://x/\", ?s)) AS ?i) (isIRI(?d) AS ?j) (isLiteral(?s) AS ?k) WHERE { ?d v:source ?s }", f"SELECT '{D}document/' || doc_id d, source || '%20a~%2A%2B' u, 'http://x/' || source i, true j, true k FROM documents WHERE source IS NOT NULL", "documents")
S("fn_num", "SELECT ?c (ABS(?b) AS ?x) (CEIL(?b) AS ?y) (FLOOR(?b) AS ?z) (ROUND(?b) AS ?r) (-?b AS ?m) (?b * 2 + 1 AS ?w) (ROUND(?k / 7 * 1000) AS ?q) WHERE { ?c v:c_acctbal ?b ; v:c_custkey ?k FILTER(?b < 1000) }", None, "customer", lambda df: df.selectExpr("c", "x", "y", "z", "r", "m", "w", "cast(q as bigint) q"))
SQL["fn_num"] = f"SELECT '{D}customer/' || c_custkey c, abs(c_acctbal) x, ceil(c_acctbal) y, floor(c_acctbal) z, floor(c_acctbal + 0.5) r, -c_acctbal m, c_acctbal * 2 + 1 w, CAST(floor(c_custkey::DECIMAL(20,0) / 7 * 1000 + 0.5) AS BIGINT) q FROM customer WHERE c_acctbal < 1000"
S("fn_date", "SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?a) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?i) WHERE { ?o v:o_orderdate ?d FILTER(?d >= \"1997-06-01T00:00:00\"^^xsd:dateTime) }", f"SELECT '{D}order/' || o_orderkey o, year(o_orderdate)::INT y, month(o_orderdate)::INT m, day(o_orderdate)::INT a, hour(o_orderdate)::INT h, minute(o_orderdate)::INT i FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'", "orders")
S("fn_hash", "SELECT ?n (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) WHERE { ?x v:n_name ?n }", "SELECT n_name n, md5(n_name) a, sha1(n_name) b, sha256(n_name) c FROM nation", "nation")
S("fn_cast", "SELECT ?k (xsd:string(?k) AS ?a) (xsd:double(?n) AS ?b) (xsd:integer(SUBSTR(?n, 10)) AS ?c) (xsd:boolean(\"true\") AS ?d) (xsd:integer(\"3.7\") AS ?e) WHERE { ?c v:c_custkey ?k ; v:c_name ?n }", "SELECT c_custkey k, c_custkey::VARCHAR a, NULL::DOUBLE b, try_cast(substr(c_name, 10) AS BIGINT) c, true d, NULL::BIGINT e FROM customer", "customer")
S("fn_cond", "SELECT ?c (IF(?b > 5000, \"rich\", IF(?b < 0, \"owing\", \"other\")) AS ?k) (COALESCE(?none, ?b) AS ?v) (BOUND(?none) AS ?u) WHERE { ?c v:c_acctbal ?b }", f"SELECT '{D}customer/' || c_custkey c, CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_acctbal < 0 THEN 'owing' ELSE 'other' END k, c_acctbal v, false u FROM customer", "customer")
S("fn_in", "SELECT (COUNT(*) AS ?n) WHERE { ?p v:p_size ?z ; v:p_brand ?b FILTER(?z IN (1, 5, 9) && ?b NOT IN (\"Brand#11\", \"Brand#22\")) }", "SELECT count(*) n FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11', 'Brand#22')", "part")
S("fn_division_by_zero", "SELECT (COUNT(?q) AS ?n) (COUNT(*) AS ?m) WHERE { ?p v:p_size ?z BIND(10 / (?z - 1) AS ?q) }", "SELECT count(CASE WHEN p_size <> 1 THEN 1 END) n, count(*) m FROM part", "part")
S("fn_types", "SELECT DISTINCT (DATATYPE(?k) AS ?a) (DATATYPE(?b) AS ?c) (isNumeric(?b) AS ?d) (LANG(?n) AS ?e) (sameTerm(?n, ?n) AS ?f) WHERE { ?x v:c_custkey ?k ; v:c_acctbal ?b ; v:c_name ?n }", "SELECT 'http://www.w3.org/2001/XMLSchema#integer' a, 'http://www.w3.org/2001/XMLSchema#double' c, true d, '' e, true f", "customer")
S("fn_random_shapes", "SELECT (COUNT(*) AS ?n) WHERE { ?x v:n_name ?m BIND(STRUUID() AS ?u) BIND(RAND() AS ?r) FILTER(STRLEN(?u) = 36 && ?r >= 0 && ?r < 1 && YEAR(NOW()) > 2000) }", "SELECT count(*) n FROM nation", "nation")
C("fn_list", "MATCH (n:Nation) WITH n.n_nationkey AS k RETURN k, size(range(1, k)) AS a, head(range(k, k + 3)) AS b, last(range(k, k + 3)) AS c, reduce(s = 0, x IN range(1, k) | s + x) AS d, all(x IN range(1, 3) WHERE x < k) AS e, any(x IN range(1, 3) WHERE x = k) AS f, single(x IN range(1, 5) WHERE x = k) AS g, size([x IN range(0, k) WHERE x % 2 = 0 | x * x]) AS h, range(0, 9)[2] AS i, range(0, 9)[-1] AS j", """SELECT n_nationkey k, greatest(n_nationkey, 0)::BIGINT a, n_nationkey::BIGINT b, n_nationkey::BIGINT + 3 c, (n_nationkey::BIGINT * (n_nationkey + 1)) // 2 d, n_nationkey > 3 e, n_nationkey BETWEEN 1 AND 3 f, n_nationkey BETWEEN 1 AND 5 g, (n_nationkey // 2 + 1)::BIGINT h, 2::BIGINT i, 9::BIGINT j FROM nation""", "nation")
C("fn_cypher_string", "MATCH (n:Nation) RETURN n.n_name AS n, toLower(n.n_name) AS a, substring(n.n_name, 2, 3) AS b, replace(n.n_name, 'A', 'b') AS c, split(n.n_name, '_')[1] AS d, left(n.n_name, 2) AS e, right(n.n_name, 2) AS f, reverse(n.n_name) AS g, size(n.n_name) AS h, n.n_name =~ 'NATION_1.' AS i", "SELECT n_name n, lower(n_name) a, substr(n_name, 3, 3) b, replace(n_name, 'A', 'b') c, split_part(n_name, '_', 2) d, left(n_name, 2) e, right(n_name, 2) f, reverse(n_name) g, length(n_name) h, regexp_full_match(n_name, 'NATION_1.') i FROM nation", "nation")

# ---- other languages over tables

C("cypher_match_agg", "MATCH (o:Order)-[:o_customer]->(c:Customer) WHERE c.c_acctbal > 5000 RETURN c.c_mktsegment AS s, count(*) AS n, max(o.o_totalprice) AS m ORDER BY s", "SELECT c_mktsegment s, count(*) n, max(o_totalprice) m FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000 GROUP BY 1", "orders customer")
C("cypher_optional_with", "MATCH (c:Customer) OPTIONAL MATCH (o:Order)-[:o_customer]->(c) WHERE o.o_totalprice > 200000 WITH c, count(o) AS n WHERE n > 2 RETURN n, count(*) AS k", "SELECT n, count(*) k FROM (SELECT c_custkey, count(o_orderkey) n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY 1) WHERE n > 2 GROUP BY 1", "customer orders")
C("cypher_unwind", "UNWIND [1, 2, 3, 4] AS x WITH x WHERE x > 1 UNWIND range(1, x) AS y RETURN x, y", "SELECT x::BIGINT x, y::BIGINT y FROM range(2, 5) a(x), LATERAL (SELECT unnest(range(1, x + 1)) y)", "region")
C("cypher_unwind_empty", "MATCH (r:Region) UNWIND range(1, r.r_regionkey) AS y RETURN r.r_name AS r, y", "SELECT r_name r, unnest(range(1, r_regionkey + 1)) y FROM region", "region")
C("cypher_union", "MATCH (r:Region) RETURN r.r_name AS n UNION MATCH (x:Nation) WHERE x.n_nationkey < 3 RETURN x.n_name AS n", "SELECT r_name n FROM region UNION SELECT n_name FROM nation WHERE n_nationkey < 3", "region nation")
C("cypher_union_all", "MATCH (r:Region) RETURN r.r_name AS n UNION ALL MATCH (r:Region) RETURN r.r_name AS n", "SELECT r_name n FROM region UNION ALL SELECT r_name FROM region", "region")
C("cypher_case", "MATCH (p:Part) RETURN CASE WHEN p.p_size > 30 THEN 'large' WHEN p.p_size > 10 THEN 'middle' ELSE 'small' END AS k, count(*) AS n", "SELECT CASE WHEN p_size > 30 THEN 'large' WHEN p_size > 10 THEN 'middle' ELSE 'small' END k, count(*) n FROM part GROUP BY 1", "part")
C("cypher_exists", "MATCH (o:Order) WHERE NOT EXISTS { MATCH (l:Lineitem)-[:l_order]->(o) } RETURN count(*) AS n", "SELECT count(*) n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", "orders lineitem")
C("cypher_collect", "MATCH (n:Nation)-[:n_region]->(r:Region) WITH r.r_name AS name, collect(n.n_nationkey) AS ks RETURN name, size(ks) AS n, reduce(s = 0, x IN ks | s + x) AS t", "SELECT r_name AS name, count(*) n, CAST(sum(n_nationkey) AS BIGINT) t FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1", "nation region")
J("jsonld_filter", {"select": ["?c", "?b"], "where": [{"@id": "?c", "@type": "v:Customer", "v:c_acctbal": "?b", "v:c_mktsegment": "BUILDING"}, ["filter", "(and (> ?b 1000) (< ?b 2000))"]]}, f"SELECT '{D}customer/' || c_custkey c, c_acctbal b FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000 AND c_acctbal < 2000", "customer")
J("jsonld_optional_union", {"select": ["?n", "?k"], "where": [["union", {"@id": "?x", "v:r_name": "?n"}, {"@id": "?x", "v:n_name": "?n"}], ["optional", {"@id": "?x", "v:n_nationkey": "?k"}]]}, "SELECT r_name n, NULL::INTEGER k FROM region UNION ALL SELECT n_name, n_nationkey FROM nation", "region nation")
J("jsonld_exists_values", {"select": ["?n"], "where": [{"@id": "?x", "v:n_name": "?n", "v:n_region": "?r"}, {"@id": "?r", "v:r_name": "?rn"}, ["values", ["?rn", ["ASIA", "EUROPE"]]], ["not-exists", {"@id": "?s", "v:s_nation": "?x", "v:s_suppkey": "?k"}, ["filter", "(< ?k 20)"]]]}, "SELECT n_name n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 20)", "nation region supplier")
J("jsonld_group_order", {"select": ["?s", "(as (count ?c) ?n)", "(as (avg ?b) ?m)"], "where": [{"@id": "?c", "v:c_mktsegment": "?s", "v:c_acctbal": "?b"}], "groupBy": "?s", "having": "(> (count ?c) 10)", "orderBy": "(desc ?n)"}, None, "customer")
QUERIES["jsonld_group_order"] = lambda spark, d, f=QUERIES["jsonld_group_order"]: f(spark, d).selectExpr("s", "n", "floor(m) m")
SQL["jsonld_group_order"] = "SELECT c_mktsegment s, count(*) n, CAST(floor(avg(c_acctbal)) AS BIGINT) m FROM customer GROUP BY 1 HAVING count(*) > 10"
S("ask", "ASK { ?o v:o_totalprice ?t FILTER(?t > 100000) }", "SELECT count(*) > 0 ask FROM orders WHERE o_totalprice > 100000", "orders")
S("construct", "CONSTRUCT { ?n v:inRegionNamed ?r . ?n a v:Place } WHERE { ?n v:n_region ?x . ?x v:r_name ?r }", f"SELECT '{D}nation/' || n_nationkey s, '{V}inRegionNamed' p, r_name o FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT '{D}nation/' || n_nationkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{V}Place' FROM nation", "nation region")
S("describe", f"DESCRIBE <{D}region/2>", f"SELECT '{D}region/2' s, '{V}r_regionkey' p, '2' o UNION ALL SELECT '{D}region/2', '{V}r_name', r_name FROM region WHERE r_regionkey = 2 UNION ALL SELECT '{D}region/2', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{V}Region'", "region")
S("describe_where", "DESCRIBE ?n WHERE { ?n v:n_name \"NATION_3\" }", f"SELECT '{D}nation/' || n_nationkey s, '{V}' || p p, o FROM (SELECT *, unnest(['n_nationkey', 'n_name', 'n_regionkey']) p, unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]) o FROM nation) WHERE n_name = 'NATION_3' UNION ALL SELECT '{D}nation/' || n_nationkey, '{V}n_region', '{D}region/' || n_regionkey FROM nation WHERE n_name = 'NATION_3' UNION ALL SELECT '{D}nation/' || n_nationkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{V}Nation' FROM nation WHERE n_name = 'NATION_3'", "nation")

# ---- paths over the reply graph

NODE = f"'{D}turn/' || {{0}} || '-' || {{1}}"


def node(conv: str, turn: str) -> str:
    return NODE.format(conv, f"({turn})")


EDGES = f"""nx AS (SELECT {node('conv_id', 'turn - 1')} a, {node('conv_id', 'turn')} b FROM conversations WHERE turn > 0),
bk AS (SELECT {node('conv_id', 'turn')} a, {node('conv_id', '0')} b FROM conversations WHERE turn > 0 AND turn % 3 = 0)"""
REACH = "WITH RECURSIVE {edges}, e AS ({step}), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"
R("path_seq", "SELECT ?a ?b WHERE { ?a v:next/v:next ?b }", f"WITH {EDGES} SELECT x.a, y.b FROM nx x JOIN nx y ON x.b = y.a")
R("path_alt", "SELECT ?a ?b WHERE { ?a v:next|v:back ?b }", f"WITH {EDGES} SELECT a, b FROM nx UNION ALL SELECT a, b FROM bk")
R("path_inv", "SELECT ?a ?b WHERE { ?a ^v:next ?b }", f"WITH {EDGES} SELECT b a, a b FROM nx")
R("path_opt", "SELECT ?a ?b WHERE { ?a v:next? ?b }", f"WITH {EDGES} SELECT a, b FROM nx UNION SELECT a, a FROM nx UNION SELECT b, b FROM nx")
R("path_plus", "SELECT ?a ?b WHERE { ?a v:next+ ?b }", REACH.format(edges=EDGES, step="SELECT a, b FROM nx") + " SELECT a, b FROM r")
R("path_star", "SELECT ?a ?b WHERE { ?a v:next* ?b }", REACH.format(edges=EDGES, step="SELECT a, b FROM nx") + " SELECT a, b FROM r UNION SELECT a, a FROM nx UNION SELECT b, b FROM nx")
R("path_cycle", "SELECT ?a ?b WHERE { ?a (v:next|v:back)+ ?b }", REACH.format(edges=EDGES, step="SELECT a, b FROM nx UNION SELECT a, b FROM bk") + " SELECT a, b FROM r")
R("path_plus_count", "SELECT (COUNT(*) AS ?n) WHERE { ?a (v:next|v:back)+ ?a }", REACH.format(edges=EDGES, step="SELECT a, b FROM nx UNION SELECT a, b FROM bk") + " SELECT count(*) n FROM r WHERE a = b")
R("path_bound_start", f"SELECT ?b WHERE {{ <{D}turn/5-0> v:next+ ?b }}", f"SELECT {node('conv_id', 'turn')} b FROM conversations WHERE conv_id = 5 AND turn > 0")
R("path_bound_end", f"SELECT ?a WHERE {{ ?a v:next+ <{D}turn/5-2> }}", f"SELECT {node('conv_id', 'turn')} a FROM conversations WHERE conv_id = 5 AND turn < 2")
R("path_hops_1_3", "SELECT ?a ?b WHERE { ?a v:next{1,3} ?b }", f"SELECT {node('x.conv_id', 'x.turn')} a, {node('y.conv_id', 'y.turn')} b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn - x.turn BETWEEN 1 AND 3")
R("path_negset", "SELECT ?a ?b WHERE { ?a !(v:next|v:role|v:number|rdf:type|v:prev) ?b }", f"WITH {EDGES} SELECT a, b FROM bk")
R("path_nested", "SELECT ?a ?b WHERE { ?a (v:next/v:next)+ ?b }", f"SELECT {node('x.conv_id', 'x.turn')} a, {node('y.conv_id', 'y.turn')} b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn > x.turn AND (y.turn - x.turn) % 2 = 0")
R("triangle_cycle_safe", "SELECT (COUNT(*) AS ?n) WHERE { ?a v:next ?b . ?b v:next ?c . ?c v:next ?d . ?d v:back ?a }", f"WITH {EDGES} SELECT count(*) n FROM nx x JOIN nx y ON x.b = y.a JOIN nx z ON y.b = z.a JOIN bk ON bk.a = z.b AND bk.b = x.a")
C("shortest_single", "MATCH p = shortestPath((a:Turn {number: 0})-[:next*]->(b:Turn {number: 3})) RETURN a, b, length(p) AS n", f"SELECT {node('conv_id', '0')} a, {node('conv_id', '3')} b, 3::BIGINT n FROM conversations WHERE turn = 3", replies=True)
C("shortest_back", "MATCH p = shortestPath((a:Turn {number: 3})-[:next|back*]->(b:Turn {number: 1})) RETURN a, b, length(p) AS n", f"SELECT {node('conv_id', '3')} a, {node('conv_id', '1')} b, 2::BIGINT n FROM conversations WHERE turn = 3", replies=True)
C("shortest_all", "MATCH p = allShortestPaths((a:Turn {number: 0})-[:next*]-(b:Turn {number: 2})) RETURN a, b, length(p) AS n, size(nodes(p)) AS k", f"SELECT {node('conv_id', '0')} a, {node('conv_id', '2')} b, 2::BIGINT n, 3::BIGINT k FROM conversations WHERE turn = 2", replies=True)
C("path_enumerate", "MATCH p = (a:Turn {number: 0})-[:next|back*1..4]->(b) RETURN length(p) AS n, count(*) AS k", f"""WITH RECURSIVE {EDGES}, e AS (SELECT a, b, 1 kind FROM nx UNION ALL SELECT a, b, 2 FROM bk),
    t(last, used, n) AS (SELECT {node('conv_id', '0')}, []::VARCHAR[], 0 FROM conversations WHERE turn = 0 UNION ALL SELECT e.b, list_append(used, e.a || e.b || kind), n + 1 FROM t JOIN e ON e.a = t.last WHERE n < 4 AND NOT list_contains(used, e.a || e.b || kind))
    SELECT n::BIGINT n, count(*) k FROM t WHERE n > 0 GROUP BY 1""", replies=True)  # fmt: skip
C("var_length", "MATCH (a:Turn {number: 0})-[:next*2..3]->(b) RETURN a, count(DISTINCT b) AS n", f"SELECT {node('conv_id', '0')} a, count(*) n FROM conversations WHERE turn IN (2, 3) GROUP BY conv_id", replies=True)
C("undirected", "MATCH (a:Turn {number: 1})-[:next]-(b) RETURN a, count(b) AS n", f"WITH m AS (SELECT conv_id, max(turn) t FROM conversations GROUP BY 1) SELECT {node('conv_id', '1')} a, CASE WHEN t >= 2 THEN 2 ELSE 1 END::BIGINT n FROM m WHERE t >= 1", replies=True)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["tpch_q1"](spark, sf_dir)
