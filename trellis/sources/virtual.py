"""Tables as a virtual graph, by mappings from columns to predicates."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ir import RDF, TYPE, XSD, Iri, Lit, Triple, Var
from ..plans.frame import Frame, Info, is_term, joined, key_of, literal, shown, spark_type, united, xsd_of


@dataclass(frozen=True)
class Ref:
    """Objects are the subjects that another map makes by this template, of a column here."""

    template: str


@dataclass(frozen=True)
class Const:
    term: Iri | Lit


@dataclass(frozen=True)
class Typed:
    """Literals of a column, of a stated datatype or language."""

    column: str
    dt: str | None = None
    lang: str | None = None


Spec = str | Ref | Const | Typed | Column


@dataclass
class TriplesMap:
    """Facts of a table's rows. subject: a template with {columns}, which rows don't share
    unless they say the same, or None, where each row is an anonymous subject of its own (rows
    alike in the columns `row`, all if none are stated, are one). cls: a class or several.
    predicates: IRI to what the objects are made of, or a list of that: a column's name, Typed,
    Ref, Const, or a Column (a computed literal)."""

    table: DataFrame
    subject: str | None
    cls: str | list[str] | None = None
    predicates: dict[str, Spec | list[Spec]] = field(default_factory=dict)
    row: list[str] | None = None

    def classes(self) -> list[str]:
        return [self.cls] if isinstance(self.cls, str) else list(self.cls or [])

    def specs(self, p: str) -> list[Spec]:
        got = self.predicates.get(p, [])
        return (got if isinstance(got, list) else [got]) + ([Const(Iri(c)) for c in self.classes()] if p == TYPE else [])


def columns(template: str) -> list[str]:
    """The columns that a template names."""
    return [x.partition("}")[0] for x in template.split("{")[1:]]


def _head(template: str) -> str:
    """The template without its column's name: maps that make the same IRIs share it."""
    head, _, rest = template.partition("{")
    return head + "{}" + rest.partition("}")[2]


def made(template: str) -> tuple[Column, Info]:
    """What a template makes: the raw key where it names one column, else whole IRIs."""
    names = columns(template)
    if len(names) == 1:
        return F.col(names[0]), Info("iri", _head(template))
    parts = template.replace("}", "{").split("{")
    return F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)]), Info("iri")


class VirtualGraph:
    """Maps of tables. Patterns on one subject that one map alone has are one scan; an IRI is
    carried as its raw key (the template makes it when it is shown), so that joins are on keys."""

    def __init__(self, maps: list[TriplesMap]):
        self.maps = maps

    def families(self) -> list[list[TriplesMap]]:
        """Maps that may make the same subjects."""
        out: list[list[TriplesMap]] = []
        for m in self.maps:
            like = [f for f in out if m.subject is not None and any(x.subject is not None and _meet(x.subject, m.subject) for x in f)]
            out = [f for f in out if f not in like] + [[x for f in like for x in f] + [m]]
        return out

    def _subject(self, m: TriplesMap) -> tuple[Column, Info]:
        if m.subject is None:
            return F.xxhash64(*[F.col(c) for c in m.row or m.table.columns]), Info("iri", row=True)
        return made(m.subject)

    def _object(self, m: TriplesMap, o: Spec) -> tuple[Column, Info]:
        if isinstance(o, Ref):
            return made(o.template)
        if isinstance(o, Const):
            return (F.lit(o.term.value), Info("iri")) if isinstance(o.term, Iri) else (literal(o.term), Info("lit", dt=o.term.dt))
        if isinstance(o, Column):
            return o, Info("lit")
        if isinstance(o, Typed):
            kind = spark_type(o.dt)
            return F.col(o.column).cast(kind or "string"), Info("lit", dt=o.dt or (RDF + "langString" if o.lang else None))
        return F.col(o), Info("lit", dt=xsd_of(m.table.schema[o].dataType.simpleString()))

    def star(self, triples: list[Triple]) -> Frame:
        """Solutions of patterns with one subject. The facts of a subject may stand in several
        maps: a pattern is one of all of them, and only those of one map are taken together."""
        if any(isinstance(t.p, Var) for t in triples):
            return reduce(joined, [self.scan(t) for t in triples])
        frames = []
        for family in self.families():
            have = [[m for m in family if m.specs(t.p.value)] for t in triples]
            if not all(have):
                continue
            alone: dict[int, list[Triple]] = {}
            parts: list[Frame | None] = []
            for t, ms in zip(triples, have):
                if len(ms) == 1:
                    alone.setdefault(self.maps.index(ms[0]), []).append(t)
                else:
                    some = [f for m in ms if (f := self._star(m, [t])) is not None]
                    every = united(some) if some else None
                    parts.append(every and Frame(every.df.distinct(), every.info))  # a fact of two maps is one
            parts += [self._star(self.maps[i], ts) for i, ts in alone.items()]
            if all(parts):
                frames.append(reduce(joined, parts))
        if not frames:
            return self._none(triples)
        return frames[0] if len(frames) == 1 else united(frames)

    def _none(self, triples: list[Triple]) -> Frame:
        from ..ir import variables

        names = variables(triples)
        return Frame(self.maps[0].table.limit(0).select(*[F.lit(None).cast("string").alias(n) for n in names]), {n: Info("iri") for n in names})

    def _star(self, m: TriplesMap, triples: list[Triple]) -> Frame | None:
        """One scan, or one for each choice among several objects of a predicate."""
        some = [f for specs in product(*[m.specs(t.p.value) for t in triples]) if (f := self._one(m, triples, specs)) is not None]
        return (some[0] if len(some) == 1 else united(some)) if some else None

    def _one(self, m: TriplesMap, triples: list[Triple], specs: tuple[Spec, ...]) -> Frame | None:
        kind = {f.name: f.dataType.simpleString() for f in m.table.schema}
        out: dict[str, tuple[Column, Info]] = {}
        tests: list[Column] = []
        told: dict[str, str] = {}

        def meet(term, col: Column, info: Info, template: str | None) -> bool:
            if isinstance(term, Var):
                if term.name in out:
                    other, oi = out[term.name]
                    tests.append(shown(other, oi) == shown(col, info) if oi.template != info.template else other == col)
                else:
                    out[term.name] = (col, info)
                return True
            if isinstance(term, Iri) and info.template and key_of(info.template, term.value) is None:
                return False
            tests.append(is_term(col, info, term, kind.get(columns(template)[0]) if template and info.template else None))
            return True

        s, si = self._subject(m)
        if not meet(triples[0].s, s, si, m.subject):
            return None
        if m.subject:
            tests.append(s.isNotNull())
        for t, spec in zip(triples, specs):
            if isinstance(spec, Const) and not isinstance(t.o, Var):
                if spec.term != t.o:
                    return None
                continue
            o, oi = self._object(m, spec)
            if isinstance(t.o, Lit) and t.o.lang != (spec.lang if isinstance(spec, Typed) else None):
                return None
            if isinstance(spec, Typed) and spec.lang and isinstance(t.o, Var):
                told[t.o.name] = spec.lang
            if not meet(t.o, o, oi, spec.template if isinstance(spec, Ref) else None):
                return None
            if not isinstance(spec, Const):
                tests.append(o.isNotNull())
        df = m.table
        for c in tests:
            df = df.where(c)
        more = [F.lit(x).alias(f"__{k}_{n}") for n, tag in told.items() for k, x in (("dt", RDF + "langString"), ("lang", tag))]
        return Frame(df.select(*[c.alias(n) for n, (c, _) in out.items()], *more), {n: i for n, (_, i) in out.items()})

    def scan(self, t: Triple) -> Frame:
        """Solutions of one pattern, whose predicate may be a variable: then a table's row is
        read once and gives a row for each of its facts, as strings."""
        if isinstance(t.p, Iri):
            return self.star([t])
        frames = []
        for m in self.maps:
            s, si = self._subject(m)
            rows = [F.struct(F.lit(p).alias("p"), shown(o, i).cast("string").alias("o"), F.lit("@id" if i.kind == "iri" else i.dt or XSD + "string").alias("dt")) for p in m.predicates for o, i in (self._object(m, x) for x in m.specs(p))]
            if TYPE not in m.predicates:
                rows += [F.struct(F.lit(TYPE).alias("p"), F.lit(c).alias("o"), F.lit("@id").alias("dt")) for c in m.classes()]
            df = m.table.select(shown(s, si).cast("string").alias("s"), F.explode(F.array(*rows)).alias("x")).select("s", "x.p", "x.o", "x.dt").where("s is not null and o is not null")
            frames.append(df)
        df = frames[0]
        for x in frames[1:]:
            df = df.union(x)
        return pattern(df, t)


def _meet(a: str, b: str) -> bool:
    """Whether two templates may make the same IRI."""
    x, y = a.partition("{")[0], b.partition("{")[0]
    return x.startswith(y) or y.startswith(x)


def pattern(df: DataFrame, t: Triple) -> Frame:
    """A pattern over facts (s, p, o, dt) of strings."""
    out, info = {}, {}
    for c, x in zip("spo", (t.s, t.p, t.o)):
        if isinstance(x, Var):
            if x.name in out:
                df = df.where((F.col(out[x.name]) == F.col(c)) & (F.col("dt") == "@id" if c == "o" else F.lit(True)))
            else:
                out[x.name], info[x.name] = c, Info("mixed" if c == "o" else "iri")
                if c == "o":
                    out |= {f"__dt_{x.name}": "dt"}
        else:
            from ..plans.frame import lexical

            df = df.where((F.col(c) == (x.value if isinstance(x, Iri) else lexical(x))) & ((F.col("dt") == "@id") == F.lit(isinstance(x, Iri)) if c == "o" else F.lit(True)))
    return Frame(df.select(*[F.col(c).alias(n) for n, c in out.items()]), info)  # dt goes along with o
