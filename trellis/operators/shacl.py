"""Validation of a graph by shapes: each constraint is a query for what violates it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ir import RDF, TYPE, XSD
from ..plans.frame import spark_type

REPORT = "focus string, path string, constraint string, value string"


@dataclass
class Property:
    """Constraints on the values of a path: a predicate, ^predicate backwards, several parted by /
    one after the other, or by | either."""

    path: str
    min_count: int | None = None
    max_count: int | None = None
    datatype: str | None = None
    node_kind: str | None = None  # IRI, Literal, BlankNode and their unions
    cls: str | None = None
    min_inclusive: float | None = None
    max_inclusive: float | None = None
    min_exclusive: float | None = None
    max_exclusive: float | None = None
    pattern: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    has_value: str | None = None
    among: list[str] | None = None
    equals: str | None = None
    disjoint: str | None = None
    less_than: str | None = None
    less_than_or_equals: str | None = None
    unique_lang: bool = False
    language_in: list[str] | None = None
    qualified: tuple[Shape, int | None, int | None] | None = None  # shape, least and most
    node: Shape | None = None  # a shape that the values must have


@dataclass
class Shape:
    """target_class, target_nodes, subjects_of or objects_of say which nodes are tested."""

    target_class: str | None = None
    target_nodes: list[str] | None = None
    subjects_of: str | None = None
    objects_of: str | None = None
    properties: list[Property] = field(default_factory=list)
    closed: bool = False
    ignored: list[str] = field(default_factory=list)
    no: Shape | None = None
    every: list[Shape] | None = None
    some: list[Shape] | None = None
    one: list[Shape] | None = None
    node: Shape | None = None  # a shape that the nodes must have as well


def focus(facts: DataFrame, s: Shape) -> DataFrame:
    """The nodes (focus) that a shape is about."""
    parts = []
    if s.target_class:
        parts.append(facts.where((F.col("p") == TYPE) & (F.col("o") == s.target_class)).select(F.col("s").alias("focus")))
    if s.target_nodes:
        parts.append(facts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in s.target_nodes])).alias("focus")))
    if s.subjects_of:
        parts.append(facts.where(F.col("p") == s.subjects_of).select(F.col("s").alias("focus")))
    if s.objects_of:
        parts.append(facts.where(F.col("p") == s.objects_of).select(F.col("o").alias("focus")))
    return reduce(DataFrame.union, parts).distinct()


def values(facts: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """(focus, value, dt, lang) of each focus node's values of a path: ways parted by |, each of
    steps parted by / where they follow an IRI, each forwards or, with ^, backwards. The
    values of a path of several steps or ways are a set."""

    def step(p: str) -> DataFrame:
        if p.startswith("^"):
            return facts.where((F.col("p") == p[1:]) & (F.col("dt") == "@id")).select(F.col("o").alias("focus"), F.col("s").alias("value"), F.lit("@id").alias("dt"), F.lit(None).cast("string").alias("lang"))
        return facts.where(F.col("p") == p).select(F.col("s").alias("focus"), F.col("o").alias("value"), "dt", "lang")

    def way(p: str) -> DataFrame:
        steps = re.split(r"/(?=\^?[A-Za-z][A-Za-z0-9+.-]*:)", p)
        x = step(steps[0]).join(nodes, "focus", "left_semi")
        for q in steps[1:]:
            y = step(q).withColumnRenamed("focus", "m")
            x = x.where("dt = '@id'").select("focus", F.col("value").alias("m")).join(y, "m").select("focus", "value", "dt", "lang").distinct()
        return x

    ways = path.split("|")
    return way(path) if len(ways) == 1 else reduce(DataFrame.union, map(way, ways)).distinct()


def _violations(facts: DataFrame, nodes: DataFrame, c: Property) -> list[DataFrame]:
    v = values(facts, nodes, c.path)
    out = []

    def report(df: DataFrame, name: str, value="value") -> None:
        out.append(df.select("focus", F.lit(c.path).alias("path"), F.lit(name).alias("constraint"), (F.col(value) if value else F.lit(None)).cast("string").alias("value")))

    def wrong(cond, name: str) -> None:
        """Values of which the condition isn't true, errors too."""
        report(v.where(~F.coalesce(cond, F.lit(False))), name)

    if c.min_count is not None or c.max_count is not None or c.has_value is not None:
        n = nodes.join(v, "focus", "left").groupBy("focus").agg(F.count("value").alias("n"), F.max(F.coalesce(F.col("value") == F.lit(c.has_value), F.lit(False))).alias("has"))
        if c.min_count is not None:
            report(n.where(F.col("n") < c.min_count), "minCount", None)
        if c.max_count is not None:
            report(n.where(F.col("n") > c.max_count), "maxCount", None)
        if c.has_value is not None:
            report(n.where(~F.col("has")), "hasValue", None)
    if c.datatype is not None:
        kind = spark_type(c.datatype)
        well = F.col("value").try_cast(kind).isNotNull() if kind else F.lit(True)
        wrong((F.col("dt") == c.datatype) & well, "datatype")
    if c.node_kind is not None:
        blank, iri = F.col("value").startswith("_:") & (F.col("dt") == "@id"), (F.col("dt") == "@id") & ~F.col("value").startswith("_:")
        kinds = {"IRI": iri, "Literal": F.col("dt") != "@id", "BlankNode": blank}
        wrong(reduce(lambda a, b: a | b, [k for n, k in kinds.items() if n in c.node_kind]), "nodeKind")
    if c.cls is not None:
        types = facts.where((F.col("p") == TYPE) & (F.col("o") == c.cls)).select(F.col("s").alias("value"))
        report(v.join(types, "value", "left_anti"), "class")
    number = F.col("value").try_cast("double")
    for name, x, test in (("minInclusive", c.min_inclusive, number.__ge__), ("maxInclusive", c.max_inclusive, number.__le__), ("minExclusive", c.min_exclusive, number.__gt__), ("maxExclusive", c.max_exclusive, number.__lt__)):
        if x is not None:
            wrong(test(x), name)
    if c.pattern is not None:
        wrong(F.col("value").rlike(c.pattern), "pattern")
    if c.min_length is not None:
        wrong(F.char_length("value") >= c.min_length, "minLength")
    if c.max_length is not None:
        wrong(F.char_length("value") <= c.max_length, "maxLength")
    if c.among is not None:
        wrong(F.col("value").isin(c.among), "in")
    for name, other, kept in (("equals", c.equals, "both"), ("disjoint", c.disjoint, "semi")):
        if other is not None:
            w = values(facts, nodes, other).select("focus", "value", "dt")
            if kept == "semi":
                report(v.join(w, ["focus", "value", "dt"], "left_semi"), name)
            else:
                report(v.join(w, ["focus", "value", "dt"], "left_anti"), name)
                report(w.join(v, ["focus", "value", "dt"], "left_anti"), name)
    for name, other, strict in (("lessThan", c.less_than, True), ("lessThanOrEquals", c.less_than_or_equals, False)):
        if other is not None:
            w = values(facts, nodes, other).select("focus", F.col("value").alias("w"))
            a, b = F.coalesce(number, F.col("value").try_cast("timestamp").cast("double")), F.coalesce(F.col("w").try_cast("double"), F.col("w").try_cast("timestamp").cast("double"))
            report(v.join(w, "focus").where(~F.coalesce(a < b if strict else a <= b, F.lit(False))), name)
    if c.unique_lang:
        report(v.where("lang is not null").groupBy("focus", F.lower("lang").alias("value")).count().where("count > 1"), "uniqueLang")
    if c.language_in is not None:
        wrong(reduce(lambda a, b: a | b, [(F.lower("lang") == x.lower()) | F.lower("lang").startswith(x.lower() + "-") for x in c.language_in]), "languageIn")
    if c.node is not None:
        bad = invalid(facts, v.select(F.col("value").alias("focus")).distinct(), c.node).select(F.col("focus").alias("value"))
        report(v.join(bad, "value", "left_semi"), "node")
    if c.qualified is not None:
        shape, least, most = c.qualified
        good = v.join(invalid(facts, v.select(F.col("value").alias("focus")).distinct(), shape).select(F.col("focus").alias("value")), "value", "left_anti")
        n = nodes.join(good, "focus", "left").groupBy("focus").agg(F.count("value").alias("n"))
        if least is not None:
            report(n.where(F.col("n") < least), "qualifiedMinCount", None)
        if most is not None:
            report(n.where(F.col("n") > most), "qualifiedMaxCount", None)
    return out


def _report(facts: DataFrame, nodes: DataFrame, s: Shape) -> DataFrame:
    out = [x for c in s.properties for x in _violations(facts, nodes, c)]

    def whole(df: DataFrame, name: str) -> None:
        out.append(df.select("focus", F.lit(None).cast("string").alias("path"), F.lit(name).alias("constraint"), F.col("focus").alias("value")))

    if s.closed:
        allowed = [c.path for c in s.properties] + s.ignored
        x = facts.where(~F.col("p").isin(allowed)).select(F.col("s").alias("focus"), F.col("p").alias("path"), F.lit("closed").alias("constraint"), F.col("o").alias("value"))
        out.append(x.join(nodes, "focus", "left_semi"))
    if s.node is not None:
        whole(nodes.join(invalid(facts, nodes, s.node), "focus", "left_semi"), "node")
    if s.no is not None:
        whole(nodes.join(invalid(facts, nodes, s.no), "focus", "left_anti"), "not")
    for name, shapes, wrong in (("and", s.every, lambda k, n: k < n), ("or", s.some, lambda k, n: k < 1), ("xone", s.one, lambda k, n: k != 1)):
        if shapes:
            bad = reduce(DataFrame.union, [invalid(facts, nodes, x).select("focus", F.lit(i).alias("i")) for i, x in enumerate(shapes)])
            n = nodes.join(bad.groupBy("focus").agg(F.count("*").alias("bad")), "focus", "left").withColumn("k", F.lit(len(shapes)) - F.coalesce("bad", F.lit(0)))
            whole(n.where(wrong(F.col("k"), len(shapes))), name)
    return reduce(DataFrame.union, out) if out else facts.sparkSession.createDataFrame([], REPORT)


SH = "http://www.w3.org/ns/shacl#"


def shapes_of(facts: DataFrame, most: int = 100_000) -> list[Shape]:
    """The shapes that a shapes graph (s, p, o) describes; it is small by nature, an error
    beyond `most` facts."""
    rows = facts.select("s", "p", "o").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a shapes graph of more than {most} facts")
    known: dict[str, dict[str, list[str]]] = {}
    for r in rows:
        known.setdefault(r.s, {}).setdefault(r.p, []).append(r.o)

    def got(s: str, name: str) -> list[str]:
        return known.get(s, {}).get(name if ":" in name else SH + name, [])

    def one(s: str, name: str, kind=str):
        x = got(s, name)
        return kind(x[0]) if x else None

    def items(head: str) -> list[str]:
        out = []
        while head and head != RDF + "nil":
            out += got(head, RDF + "first")
            head = one(head, RDF + "rest")
        return out

    def path(p: str) -> str:
        if inverse := one(p, "inversePath"):
            return "^" + path(inverse)
        if ways := one(p, "alternativePath"):
            return "|".join(map(path, items(ways)))
        return "/".join(map(path, items(p))) if got(p, RDF + "first") else p

    def prop(p: str) -> Property:
        kind = one(p, "nodeKind")
        least, most_ = one(p, "qualifiedMinCount", int), one(p, "qualifiedMaxCount", int)
        inner = one(p, "qualifiedValueShape")
        return Property(
            path(one(p, "path")), one(p, "minCount", int), one(p, "maxCount", int), one(p, "datatype"), kind and kind[len(SH) :], one(p, "class"),
            one(p, "minInclusive", float), one(p, "maxInclusive", float), one(p, "minExclusive", float), one(p, "maxExclusive", float),
            one(p, "pattern"), one(p, "minLength", int), one(p, "maxLength", int), one(p, "hasValue"), items(one(p, "in")) if got(p, "in") else None,
            one(p, "equals"), one(p, "disjoint"), one(p, "lessThan"), one(p, "lessThanOrEquals"), one(p, "uniqueLang") == "true",
            items(one(p, "languageIn")) if got(p, "languageIn") else None, (shape(inner), least, most_) if inner else None, shape(n) if (n := one(p, "node")) else None,
        )

    def shape(s: str) -> Shape:
        lists = {k: [shape(x) for x in items(one(s, n))] if got(s, n) else None for k, n in (("every", "and"), ("some", "or"), ("one", "xone"))}
        no, node = one(s, "not"), one(s, "node")
        return Shape(
            one(s, "targetClass"), got(s, "targetNode") or None, one(s, "targetSubjectsOf"), one(s, "targetObjectsOf"), [prop(p) for p in got(s, "property")],
            one(s, "closed") == "true", items(one(s, "ignoredProperties")) if got(s, "ignoredProperties") else [], shape(no) if no else None, **lists, node=shape(node) if node else None,
        )

    targets = [SH + x for x in ("targetClass", "targetNode", "targetSubjectsOf", "targetObjectsOf")]
    return [shape(s) for s in sorted(known) if any(t in known[s] for t in targets)]


def invalid(facts: DataFrame, nodes: DataFrame, s: Shape) -> DataFrame:
    """The nodes that violate a shape."""
    return _report(facts, nodes, s).select("focus").distinct()


def validate(facts: DataFrame, shapes: list[Shape]) -> DataFrame:
    """The report (focus, path, constraint, value) on facts (s, p, o, dt, lang)."""
    return reduce(DataFrame.union, [_report(facts, focus(facts, s), s) for s in shapes]).distinct()


__all__ = ["Property", "Shape", "XSD", "focus", "invalid", "validate"]
