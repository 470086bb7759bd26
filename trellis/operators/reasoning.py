"""Inference: RDFS and OWL rules to a fixpoint, rewriting of queries, and Datalog rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from inspect import signature

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ir import OWL, RDF, RDFS, TYPE, Bind, Call, Filter, Group, InGraph, Iri, Query, Sub, Triple, Union, Var, variables
from ..plans.paths import components, kept, reached

MOST_ROUNDS = 100


def closure(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of the transitive closure."""
    return reached(kept(pairs.toDF("a", "b").distinct()))


def _of(facts: DataFrame, p: str, s: str = "s", o: str = "o") -> DataFrame:
    return facts.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))


def _list_members(facts: DataFrame) -> DataFrame:
    """(head, item) of RDF lists."""
    first, rest = _of(facts, RDF + "first", "cell", "item"), _of(facts, RDF + "rest", "head", "cell")
    reach = closure(rest)
    every = reach.toDF("head", "cell").union(first.select("cell", "cell")).distinct()
    return every.join(first, "cell").select("head", "item").distinct()


# Each rule makes facts (s, p, o) of all facts f; names are those of the OWL 2 RL profile. A rule
# with a second parameter joins the schema in f with single facts, those of d: in later rounds,
# the new ones.


def prp_dom(f, d):
    return d.alias("t").join(_of(f, RDFS + "domain", "p", "c"), "p").select("s", F.lit(TYPE).alias("p"), F.col("c").alias("o"))


def prp_rng(f, d):
    return d.alias("t").join(_of(f, RDFS + "range", "p", "c"), "p").select(F.col("o").alias("s"), F.lit(TYPE).alias("p"), F.col("c").alias("o"))


def prp_spo1(f, d):
    return d.join(_of(f, RDFS + "subPropertyOf", "p", "q"), "p").select("s", F.col("q").alias("p"), "o")


def prp_spo2(f):
    """Property chains of two."""
    chain = _of(f, OWL + "propertyChainAxiom", "q", "l")
    first, rest = _of(f, RDF + "first", "l", "p1"), _of(f, RDF + "rest", "l", "l2")
    second = _of(f, RDF + "first", "l2", "p2")
    pairs = chain.join(first, "l").join(rest, "l").join(second, "l2").select("q", "p1", "p2")
    a = f.select(F.col("s"), F.col("p").alias("p1"), F.col("o").alias("m"))
    b = f.select(F.col("s").alias("m"), F.col("p").alias("p2"), F.col("o"))
    return a.join(pairs, "p1").join(b, ["m", "p2"]).select("s", F.col("q").alias("p"), "o")


def prp_symp(f, d):
    sym = _of(f, TYPE, "p", "c").where(F.col("c") == OWL + "SymmetricProperty").select("p")
    return d.join(sym, "p").select(F.col("o").alias("s"), "p", F.col("s").alias("o"))


def prp_trp(f):
    """The whole closure of each transitive property, pairs of one property by themselves."""
    tr = _of(f, TYPE, "p", "c").where(F.col("c") == OWL + "TransitiveProperty").select("p")
    t = f.join(tr, "p")
    every = closure(t.select(F.struct("p", F.col("s").alias("x")).alias("a"), F.struct("p", F.col("o").alias("x")).alias("b")))
    return every.select(F.col("a.x").alias("s"), F.col("a.p").alias("p"), F.col("b.x").alias("o"))


def prp_inv(f, d):
    inv = _of(f, OWL + "inverseOf", "p", "q")
    inv = inv.union(inv.select("q", "p")).distinct()
    return d.join(inv, "p").select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o"))


def prp_fp(f):
    fp = _of(f, TYPE, "p", "c").where(F.col("c") == OWL + "FunctionalProperty").select("p")
    t = f.join(fp, "p")
    least = t.groupBy("p", "s").agg(F.min("o").alias("m"))
    return t.join(least, ["p", "s"]).where("o <> m").select(F.col("o").alias("s"), F.lit(OWL + "sameAs").alias("p"), F.col("m").alias("o"))


def prp_ifp(f):
    fp = _of(f, TYPE, "p", "c").where(F.col("c") == OWL + "InverseFunctionalProperty").select("p")
    t = f.join(fp, "p")
    least = t.groupBy("p", "o").agg(F.min("s").alias("m"))
    return t.join(least, ["p", "o"]).where("s <> m").select("s", F.lit(OWL + "sameAs").alias("p"), F.col("m").alias("o"))


def prp_eqp(f, d):
    eq = _of(f, OWL + "equivalentProperty", "p", "q")
    eq = eq.union(eq.select("q", "p")).distinct()
    return d.join(eq, "p").select("s", F.col("q").alias("p"), "o")


def prp_key(f):
    """Subjects of a class that agree on its (first) key property are the same."""
    key = _of(f, OWL + "hasKey", "c", "l").join(_of(f, RDF + "first", "l", "p"), "l").select("c", "p")
    t = _of(f, TYPE, "s", "c").join(key, "c").join(f, ["s", "p"]).select("c", "p", "s", "o")
    least = t.groupBy("c", "p", "o").agg(F.min("s").alias("m"))
    return t.join(least, ["c", "p", "o"]).where("s <> m").select("s", F.lit(OWL + "sameAs").alias("p"), F.col("m").alias("o"))


def cax_sco(f, d):
    return _of(d, TYPE, "s", "c").join(_of(f, RDFS + "subClassOf", "c", "d"), "c").select("s", F.lit(TYPE).alias("p"), F.col("d").alias("o"))


def cax_eqc(f, d):
    eq = _of(f, OWL + "equivalentClass", "c", "d")
    eq = eq.union(eq.select("d", "c")).distinct()
    return _of(d, TYPE, "s", "c").join(eq, "c").select("s", F.lit(TYPE).alias("p"), F.col("d").alias("o"))


def scm_sco(f):
    a, b = _of(f, RDFS + "subClassOf", "s", "m"), _of(f, RDFS + "subClassOf", "m", "o")
    return a.join(b, "m").select("s", F.lit(RDFS + "subClassOf").alias("p"), "o")


def scm_spo(f):
    a, b = _of(f, RDFS + "subPropertyOf", "s", "m"), _of(f, RDFS + "subPropertyOf", "m", "o")
    return a.join(b, "m").select("s", F.lit(RDFS + "subPropertyOf").alias("p"), "o")


def _restrictions(f, what: str):
    return _of(f, OWL + what, "r", "v").join(_of(f, OWL + "onProperty", "r", "p"), "r")


def cls_hv1(f, d):
    return _of(d, TYPE, "s", "r").join(_restrictions(f, "hasValue"), "r").select("s", "p", F.col("v").alias("o"))


def cls_hv2(f, d):
    r = _restrictions(f, "hasValue").select("r", "p", F.col("v").alias("o"))
    return d.join(r, ["p", "o"]).select("s", F.lit(TYPE).alias("p"), F.col("r").alias("o"))


def cls_svf1(f):
    r = _restrictions(f, "someValuesFrom")
    kinds = _of(f, TYPE, "o", "v")
    plain = f.join(r.where(F.col("v") == OWL + "Thing"), "p").select("s", F.col("r").alias("o"))
    typed = f.join(r, "p").join(kinds, ["o", "v"]).select("s", F.col("r").alias("o"))
    return plain.union(typed).select("s", F.lit(TYPE).alias("p"), "o")


def cls_avf(f):
    r = _restrictions(f, "allValuesFrom")
    return _of(f, TYPE, "s", "r").join(r, "r").join(f, ["s", "p"]).select(F.col("o").alias("s"), F.lit(TYPE).alias("p"), F.col("v").alias("o"))


def cls_int1(f):
    parts = _of(f, OWL + "intersectionOf", "c", "head").join(_list_members(f), "head").select("c", "item")
    need = parts.groupBy("c").agg(F.count("*").alias("n"))
    have = _of(f, TYPE, "s", "item").distinct().join(parts, "item").groupBy("s", "c").agg(F.count("*").alias("k"))
    return have.join(need, "c").where("n = k").select("s", F.lit(TYPE).alias("p"), F.col("c").alias("o"))


def cls_int2(f, d):
    parts = _of(f, OWL + "intersectionOf", "c", "head").join(_list_members(f), "head").select("c", "item")
    return _of(d, TYPE, "s", "c").join(parts, "c").select("s", F.lit(TYPE).alias("p"), F.col("item").alias("o"))


def cls_uni(f, d):
    parts = _of(f, OWL + "unionOf", "c", "head").join(_list_members(f), "head").select("c", "item")
    return _of(d, TYPE, "s", "item").join(parts, "item").select("s", F.lit(TYPE).alias("p"), F.col("c").alias("o"))


def cls_oo(f):
    parts = _of(f, OWL + "oneOf", "c", "head").join(_list_members(f), "head")
    return parts.select(F.col("item").alias("s"), F.lit(TYPE).alias("p"), F.col("c").alias("o"))


def cls_maxc2(f):
    r = _restrictions(f, "maxCardinality").where(F.col("v") == "1").select("r", "p")
    t = _of(f, TYPE, "s", "r").join(r, "r").join(f, ["s", "p"]).select("s", "p", "o").distinct()
    least = t.groupBy("s", "p").agg(F.min("o").alias("m"))
    return t.join(least, ["s", "p"]).where("o <> m").select(F.col("o").alias("s"), F.lit(OWL + "sameAs").alias("p"), F.col("m").alias("o"))


def cls_maxqc3(f):
    """Of a class with at most one value of a property in a class, such values are the same."""
    r = _of(f, OWL + "maxQualifiedCardinality", "r", "v").where(F.col("v") == "1").join(_of(f, OWL + "onProperty", "r", "p"), "r").join(_of(f, OWL + "onClass", "r", "k"), "r").select("r", "p", "k")
    t = _of(f, TYPE, "s", "r").join(r, "r").join(f, ["s", "p"]).select("s", "p", "k", "o").distinct()
    thing = t.where(F.col("k") == OWL + "Thing")
    t = thing.union(t.join(_of(f, TYPE, "o", "k"), ["o", "k"]).select("s", "p", "k", "o")).distinct()
    least = t.groupBy("s", "p", "k").agg(F.min("o").alias("m"))
    return t.join(least, ["s", "p", "k"]).where("o <> m").select(F.col("o").alias("s"), F.lit(OWL + "sameAs").alias("p"), F.col("m").alias("o"))


RDFS_RULES = [prp_dom, prp_rng, prp_spo1, cax_sco, scm_sco, scm_spo]
RL_RULES = RDFS_RULES + [prp_spo2, prp_symp, prp_trp, prp_inv, prp_fp, prp_ifp, prp_eqp, prp_key, cax_eqc, cls_hv1, cls_hv2, cls_svf1, cls_avf, cls_int1, cls_int2, cls_uni, cls_oo, cls_maxc2, cls_maxqc3]


def same(facts: DataFrame) -> DataFrame:
    """Facts with each of a class of the same subjects written as its least member; sameAs
    facts remain between each member and that one."""
    links = _of(facts, OWL + "sameAs", "a", "b")
    both = links.union(links.select("b", "a")).distinct()
    labels = components(kept(both), MOST_ROUNDS)
    out = facts.where(F.col("p") != OWL + "sameAs")
    for c in ("s", "o"):
        out = out.join(labels.select(F.col("a").alias(c), F.col("label").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    links = labels.where("a <> label").select(F.col("a").alias("s"), F.lit(OWL + "sameAs").alias("p"), F.col("label").alias("o"))
    return out.select("s", "p", "o").union(links).distinct()


def _schema(facts: DataFrame) -> DataFrame:
    """Facts of the vocabularies that rules read."""
    own = lambda c: F.col(c).startswith(OWL) | F.col(c).startswith(RDFS)
    return facts.where(own("p") & (F.col("p") != OWL + "sameAs") | F.col("p").isin(RDF + "first", RDF + "rest") | (F.col("p") == TYPE) & own("o"))


def materialised(facts: DataFrame, rules: list | None = None) -> DataFrame:
    """facts (s, p, o) with all that the rules make of them. After the first round, rules that
    join the schema with single facts see the new facts alone, unless the schema grew. What
    is known stays where it was written; equal subjects are written as one in each round."""
    rules = RL_RULES if rules is None else rules
    single = {r: len(signature(r).parameters) == 2 for r in rules}
    known = [kept(facts.select("s", "p", "o").distinct())]
    new = known[0]
    for _ in range(MOST_ROUNDS):
        every = reduce(DataFrame.union, known)
        made = reduce(DataFrame.union, [(r(every, new) if single[r] else r(every)).select("s", "p", "o") for r in rules]).distinct()
        new = kept(made.join(every, ["s", "p", "o"], "left_anti"))
        if new.isEmpty():
            return every
        known.append(new)
        if prp_fp in rules and not new.where(F.col("p") == OWL + "sameAs").isEmpty():
            new = kept(same(reduce(DataFrame.union, known)))
            known = [new]
        elif not _schema(new).isEmpty():
            new = reduce(DataFrame.union, known)
    raise RuntimeError("inference did not end")


@dataclass(frozen=True)
class Taken(Triple):
    """A pattern that is one of the ways of another."""


def expand(group: Group, subclasses: dict[str, list[str]], subproperties: dict[str, list[str]], inverses: dict[str, str] | None = None, most: int = 50, domains: dict[str, list[str]] | None = None, ranges: dict[str, list[str]] | None = None) -> Group:
    """A group's patterns over all subclasses, subproperties and inverse properties, as unions.
    The dicts hold closures; of more than `most` classes or properties a pattern takes those
    in a list. domains, ranges: properties by the class that their subjects and objects are
    of; for a pattern of a class these count as well."""
    out = []
    for t in group.parts:
        if not isinstance(t, Triple) or isinstance(t, Taken) or not isinstance(t.p, Iri):
            out.append(t)
            continue
        ways: list = [(t,)]
        if t.p.value == TYPE and isinstance(t.o, Iri):
            classes = [t.o.value, *subclasses.get(t.o.value, [])]
            if len(classes) > most:
                c = Var(f"_c{len(out)}")
                ways = [(Taken(t.s, t.p, c), Filter(Call("in", (c, *map(Iri, classes)))))]
            else:
                ways = [(Taken(t.s, t.p, Iri(c)),) for c in classes]
            for by, forth in ((domains or {}, True), (ranges or {}, False)):
                names = dict.fromkeys(q for c in classes for p in by.get(c, []) for q in (p, *subproperties.get(p, [])))
                other = Var(f"_d{len(out)}")
                ways += [(Taken(t.s, Iri(p), other) if forth else Taken(other, Iri(p), t.s),) for p in names]
        else:
            names = [t.p.value, *subproperties.get(t.p.value, [])]
            turned = [(n, inverses[n]) for n in names if inverses and n in inverses]
            if len(names) > most:
                p = Var(f"_p{len(out)}")
                ways = [(Taken(t.s, p, t.o), Filter(Call("in", (p, *map(Iri, names)))))]
            else:
                ways = [(Taken(t.s, Iri(p), t.o),) for p in names]
            ways += [(Taken(t.o, Iri(q), t.s),) for _, q in turned]
        if len(ways) == 1:
            out += ways[0]
        elif domains or ranges:  # a subject of a class counts once, by however many facts
            names = variables([t])
            out.append(Sub(Query(Group((Union(tuple(Group(w) for w in ways)),)), [(Var(v), v) for v in names], distinct=True)))
        else:
            out.append(Union(tuple(Group(w) for w in ways)))
    return Group(tuple(out))


def hierarchy(facts: DataFrame, predicate: str, most: int = 200_000) -> dict[str, list[str]]:
    """Above: all below, of a schema's hierarchy (small by nature; an error beyond `most` pairs)."""
    out: dict[str, list[str]] = {}
    rows = closure(_of(facts, predicate, "a", "b")).limit(most + 1).collect()
    if len(rows) > most:
        raise RuntimeError(f"the hierarchy has more than {most} pairs")
    for r in rows:
        if r.a != r.b:
            out.setdefault(r.b, []).append(r.a)
    return {k: sorted(v) for k, v in out.items()}


def rewriter(facts: DataFrame, ql: bool = False):
    """A function from groups to groups that take in a schema's hierarchies (RDFS), and with `ql`
    inverse properties, domains and ranges; for Compiler.rewrite."""
    facts = facts.select("s", "p", "o")
    classes, properties = hierarchy(facts, RDFS + "subClassOf"), hierarchy(facts, RDFS + "subPropertyOf")

    def pairs(p: str, most: int = 200_000) -> list:
        rows = _of(facts, p, "a", "b").distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise RuntimeError(f"more than {most} facts of {p}")
        return [(r.a, r.b) for r in rows]

    inverses, domains, ranges = {}, {}, {}
    if ql:
        inverses = dict(sorted(x for a, b in pairs(OWL + "inverseOf") for x in ((a, b), (b, a))))
        for p, by in ((RDFS + "domain", domains), (RDFS + "range", ranges)):
            for a, c in sorted(pairs(p)):
                by.setdefault(c, []).append(a)
    return lambda g: expand(g, classes, properties, inverses, domains=domains or None, ranges=ranges or None)


MODES = ("rdfs", "owl2ql", "owl2rl", "datalog")


def reasoned(spark: SparkSession, data, modes: list[str], rules: list[Rule] | None = None):
    """(dataset, rewrite) for a query under these modes: rdfs and owl2ql rewrite the query,
    owl2rl and datalog make facts of the default graph. Where owl2rl has made its facts the
    query isn't rewritten as well, for then answers would come twice."""
    from ..plans.compile import Dataset
    from ..sources.flakes import FlakeGraph

    if unknown := set(modes) - set(MODES):
        raise ValueError(f"unknown modes {sorted(unknown)}")
    g = data.default
    facts = g.facts().select("s", "p", "o", "dt", "lang")
    if "owl2rl" in modes:
        links = facts.where("dt = '@id'")
        known = materialised(links.select("s", "p", "o"))
        # literals are written of the same least subjects
        labels = known.where(F.col("p") == OWL + "sameAs").select(F.col("s").alias("_s"), F.col("o").alias("_o"))
        texts = facts.where("dt <> '@id'").join(labels, F.col("s") == F.col("_s"), "left").withColumn("s", F.coalesce("_o", "s")).drop("_s", "_o")
        facts = kept(texts.unionByName(known.withColumn("dt", F.lit("@id")).withColumn("lang", F.lit(None).cast("string"))).distinct())
    if "datalog" in modes:
        made = datalog(spark, facts.select("s", "p", "o", "dt"), rules or [])
        facts = made.join(facts.where("lang is not null"), ["s", "p", "o", "dt"], "left").select("s", "p", "o", "dt", "lang")
    if facts is not None and {"owl2rl", "datalog"} & set(modes):
        flakes = facts.selectExpr("cast(null as string) g", "s", "p", "o", "dt", "lang", "cast(null as int) i", "1L t", "true op")
        g = FlakeGraph(flakes, facts=flakes)
    plain = {"rdfs", "owl2ql"} & set(modes) and "owl2rl" not in modes
    rewrite = rewriter(g.facts(), "owl2ql" in modes) if plain else None
    return Dataset(g, data.named, data.services, data.indexes), rewrite


@dataclass
class Rule:
    """A Datalog rule: for each solution of `where`, the facts of `insert`."""

    where: Group
    insert: list[Triple]


def rule(text: str, prefixes: dict[str, str] | None = None) -> Rule:
    """A rule written as a SPARQL CONSTRUCT query."""
    from ..parsers.sparql import parse

    q = parse(text, prefixes)
    if q.form != "construct":
        raise ValueError("a rule is a CONSTRUCT query")
    return Rule(q.where, q.template)


def bundle(data, iri: str, most: int = 1000) -> DataFrame:
    """The facts of a schema's graph and of those that it imports, directly or not."""
    todo, done = [iri], {}
    while todo:
        name = todo.pop()
        g = data.graph(name)
        if g is None:
            raise ValueError(f"no graph {name}")
        done[name] = g.facts()
        if len(done) > most:
            raise RuntimeError(f"more than {most} imported graphs")
        found = [r.o for r in done[name].where(F.col("p") == OWL + "imports").select("o").distinct().limit(most + 1).collect()]
        todo += [x for x in sorted(found) if x not in done and x not in todo]
    return reduce(DataFrame.union, done.values())


def datalog(spark: SparkSession, facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """facts (s, p, o, dt) with all that the rules insert, to a fixpoint."""
    from ..plans.compile import Compiler, Dataset
    from ..plans.expr import Expressions
    from ..plans.frame import lexical
    from ..sources.flakes import FlakeGraph

    known = [kept(facts.select("s", "p", "o", "dt").distinct())]
    new, fresh = known[0], "urn:new"
    as_flakes = lambda df: df.selectExpr("cast(null as string) g", "s", "p", "o", "dt", "cast(null as string) lang", "cast(null as int) i", "1L t", "true op")

    def ways(r: Rule, first: bool) -> list[Group]:
        """After the first round, a rule of plain patterns sees one of them among the new facts
        at a time, and the others among all."""
        if first or not all(isinstance(x, (Triple, Filter, Bind)) for x in r.where.parts):
            return [r.where]
        parts = r.where.parts
        return [Group(tuple(InGraph(Iri(fresh), Group((x,))) if k == i else x for k, x in enumerate(parts))) for i, y in enumerate(parts) if isinstance(y, Triple)]

    for n in range(MOST_ROUNDS):
        every = as_flakes(reduce(DataFrame.union, known))
        g, delta = FlakeGraph(every, facts=every), as_flakes(new)
        # objects are carried alike in both
        delta = FlakeGraph(every, facts=delta)
        delta._types, delta._whole = g.types(), g._whole
        c = Compiler(spark, Dataset(g, {fresh: delta}))
        made = []
        for r in rules:
            for where in ways(r, n == 0):
                f = c.group(where)
                e = Expressions(f)
                for t in r.insert:
                    part = lambda x: e.col(x).cast("string") if isinstance(x, Var) else F.lit(x.value if isinstance(x, Iri) else lexical(x))  # noqa: E731, B023
                    dt = e.datatype(e.value(t.o)) if isinstance(t.o, Var) else F.lit("@id" if isinstance(t.o, Iri) else t.o.dt)
                    made.append(f.df.select(part(t.s).alias("s"), part(t.p).alias("p"), part(t.o).alias("o"), dt.alias("dt")))
        made = reduce(DataFrame.union, made).where("s is not null and p is not null and o is not null").distinct()
        every = reduce(DataFrame.union, known)
        new = kept(made.join(every, ["s", "p", "o", "dt"], "left_anti"))
        if new.isEmpty():
            return every
        known.append(new)
    raise RuntimeError("the rules did not end")
