"""Cypher's writing clauses on a fact store: CREATE, MERGE, SET, REMOVE, DELETE and FOREACH after
any MATCH or UNWIND; each makes flakes to append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ir import TYPE, XSD, Group, Iri, Lit, Optional, Triple, Unwind, Var, variables
from ..plans.compile import Compiler, Dataset
from ..plans.expr import Expressions
from ..plans.frame import Frame, Info, xsd_of
from ..sources import flakes as fl
from .cypher import Parser


class _Writer(Parser):
    """A parser that can read the pattern of a CREATE into templates."""

    def template(self) -> tuple[list[Triple], list[tuple[str, str, object]], list[str]]:
        """Facts of constants and nodes, properties by expression, and nodes in order."""
        keep, self.parts = self.parts, []
        props, nodes = [], []
        while True:
            a = self._node(props, nodes)
            while self.peek()[1] in ("-", "<"):
                _, types, direction, *_ = self.relationship()
                b = self._node(props, nodes)
                s, o = (b, a) if direction == "in" else (a, b)
                self.parts.append(Triple(Var(s), self.iri(types[0]), Var(o)))
                a = b
            if not self.op(","):
                break
        got, self.parts = self.parts, keep
        # properties that expressions read are patterns of the statement
        self.parts += [x for x in got if not isinstance(x, Triple)]
        return [x for x in got if isinstance(x, Triple)], props, nodes

    def _node(self, props: list, nodes: list) -> str:
        self.need("(")
        n = self.name() if self.peek()[0] == "word" else self.new("_n")
        if n not in nodes:
            nodes.append(n)
        while self.op(":"):
            self.parts.append(Triple(Var(n), Iri(TYPE), self.iri(self.name())))
        if self.op("{"):
            while not self.op("}"):
                k = self.name()
                self.need(":")
                props.append((n, k, self.expr()))
                self.op(",")
        self.need(")")
        return n


def _flakes(f: Frame, rows: list[tuple]) -> DataFrame:
    """Facts (s column, p IRI, o column, dt) of each solution; null parts are left out."""
    cells = [F.struct(s.cast("string").alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(dt).alias("dt")) for s, p, o, dt in rows]
    x = f.df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("s is not null and o is not null")
    return x.selectExpr("cast(null as string) g", "s", "p", "o", "dt", "cast(null as string) lang", "cast(null as int) i").distinct()


def write(spark: SparkSession, flakes: DataFrame, text: str, vocab: str, t: int, params: dict | None = None) -> DataFrame:
    """The store after the clauses, each of which sees what the ones before did. New nodes
    are named by a hash of the statement, the time and the row that makes them, so that a
    run that is repeated names them alike."""
    p = _Writer(text, vocab, params)
    columns = flakes.columns

    def solutions() -> Frame:
        f = Compiler(spark, Dataset(fl.FlakeGraph(flakes))).group(Group(tuple(p.parts)))
        return f

    def fresh(f: Frame, nodes: list[str]) -> Frame:
        for n in nodes:
            if n not in f.info:
                have = [F.coalesce(F.col(v).cast("string"), F.lit("")) for v in f.info]
                f = Frame(f.df.withColumn(n, F.concat(F.lit(f"_:n{t}-{n}-"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(text), *have), 256), 1, 16))), f.info | {n: Info("iri")})
        return f

    def created(f: Frame, triples: list[Triple], props: list) -> DataFrame:
        e = Expressions(f)
        rows = [(F.col(x.s.name), x.p.value, F.lit(x.o.value) if isinstance(x.o, Iri) else F.col(x.o.name), "@id") for x in triples]
        for n, k, v in props:
            c = e.value(v)
            rows.append((F.col(n), vocab + k, c.col, v.dt if isinstance(v, Lit) else xsd_of(e.type(c)) or XSD + "string"))
        return _flakes(f, rows)

    def append(new: DataFrame) -> None:
        nonlocal flakes
        flakes = flakes.union(new.select(columns))

    def clause() -> None:
        nonlocal t
        if p.word("MATCH"):
            p.match()
        elif p.word("OPTIONAL"):
            p.word("MATCH")
            outside, p.parts = p.parts, []
            p.match()
            inner, p.parts = p.parts, outside
            p.parts.append(Optional(Group(tuple(inner))))
        elif p.word("UNWIND"):
            e = p.expr()
            p.word("AS")
            p.parts.append(Unwind(e, p.name()))
        elif p.word("FOREACH"):
            p.need("(")
            v = p.name()
            p.word("IN")
            outside, e = p.parts, p.expr()
            p.need("|")
            p.parts = [*p.parts, Unwind(e, v)]
            while not p.op(")"):
                clause()
            p.parts = outside
        elif p.word("CREATE"):
            triples, props, nodes = p.template()
            append(fl.insert(flakes, created(fresh(solutions(), nodes), triples, props), t))
        elif p.word("MERGE"):
            triples, props, nodes = p.template()
            f = solutions()
            wanted = [*triples, *[Triple(Var(n), Iri(vocab + k), v) for n, k, v in props]]
            there = Compiler(spark, Dataset(fl.FlakeGraph(flakes))).group(Group(tuple(wanted)))
            shared = [v for v in f.info if v in variables(wanted)]
            if shared:
                missing = Frame(f.df.join(there.df.select(*shared).distinct(), shared, "left_anti"), f.info)
            else:
                missing = f if there.df.isEmpty() else Frame(f.df.limit(0), f.info)
            append(fl.insert(flakes, created(fresh(missing, nodes), triples, props), t))
        elif p.word("SET"):
            sets, labels = [], []
            while True:
                n = p.name()
                if p.op(":"):
                    labels.append(Triple(Var(n), Iri(TYPE), p.iri(p.name())))
                else:
                    p.need(".")
                    k = p.name()
                    p.need("=")
                    sets.append((n, k, p.expr()))
                if not p.op(","):
                    break
            f = solutions()
            if sets:
                append(fl.upsert(flakes, created(f, [], sets), t))
            if labels:
                append(fl.insert(flakes, created(f, labels, []), t))
        elif p.word("REMOVE"):
            f, rows = solutions(), None
            while True:
                n = p.name()
                pred = TYPE if p.op(":") else p.need(".") and None
                name = p.name()
                hit = fl.current(flakes).where((F.col("p") == (pred or vocab + name)) & (F.lit(pred is None) | (F.col("o") == vocab + name)))
                x = hit.join(f.df.select(F.col(n).alias("s")).distinct(), "s", "left_semi").select(*fl.FACT)
                rows = x if rows is None else rows.union(x)
                if not p.op(","):
                    break
            append(fl.delete(flakes, rows, t))
        elif p.is_word("DELETE", "DETACH"):
            p.word("DETACH")
            p.word("DELETE")
            f, names = solutions(), [p.name()]
            while p.op(","):
                names.append(p.name())
            held = fl.current(flakes)
            for n in names:
                ids = f.df.select(F.col(n).alias("id")).distinct()
                gone = held.join(ids, F.col("s") == F.col("id"), "left_semi").union(held.where("dt = '@id'").join(ids, F.col("o") == F.col("id"), "left_semi"))
                append(fl.delete(flakes, gone.select(*fl.FACT), t))
        else:
            raise ValueError(f"unexpected {p.peek()[1]!r}")
        p.op(";")
        t += 1

    while p.peek()[0] != "end":
        clause()
    return flakes
