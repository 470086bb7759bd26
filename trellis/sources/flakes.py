"""An append-only, time-travelling store of facts, as one DataFrame of flakes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ir import RDF, XSD, Iri, Lit, Triple, Var
from ..plans.frame import Frame, Info, lexical, spark_type

#: g null: the default graph. o is lexical; dt is '@id' for references.
SCHEMA = "g string, s string, p string, o string, dt string, lang string, i int, t long, op boolean"
FACT = ["g", "s", "p", "o", "dt", "lang", "i"]
#: Predicates whose datatypes are looked up together.
MOST_TYPES = 100_000


def current(flakes: DataFrame, t: int | None = None) -> DataFrame:
    """The facts that hold at `t` (now): the newest flake of each fact, if it asserts."""
    if t is not None:
        flakes = flakes.where(F.col("t") <= t)
    last = flakes.groupBy(*FACT).agg(F.max(F.struct("t", "op")).alias("x"))
    return last.where("x.op").select(*FACT, F.col("x.t").alias("t"), F.lit(True).alias("op"))


def facts(spark: SparkSession, rows: list[tuple], t: int = 1, graph: str | None = None) -> DataFrame:
    """Flakes of triples of terms: strings are IRIs, Lit literals, other values literals of
    their own type."""
    from decimal import Decimal

    kinds = {bool: "boolean", int: "integer", float: "double", Decimal: "decimal"}
    out = []
    for s, p, o in rows:
        if isinstance(o, Lit):
            dt = o.dt or (RDF + "langString" if o.lang else XSD + "string")
            out.append((graph, s, p, lexical(o), dt, o.lang, None, t, True))
        elif isinstance(o, str):
            out.append((graph, s, p, o, "@id", None, None, t, True))
        else:
            out.append((graph, s, p, lexical(Lit(o)), XSD + kinds[type(o)], None, None, t, True))
    return spark.createDataFrame(out, SCHEMA)


class FlakeGraph:
    """Facts of one graph of a store. graph: None is the default graph, '*' all of them.
    history: (from, to) gives all asserts and retracts of that time instead of a state."""

    def __init__(self, flakes: DataFrame, t: int | None = None, graph: str | None = None, history: tuple[int, int] | None = None, facts: DataFrame | None = None):
        self.flakes, self.t, self.graph, self.history = flakes, t, graph, history
        self._facts, self._types = facts, None

    def facts(self) -> DataFrame:
        if self._facts is None:
            df = self.flakes
            if self.graph != "*":
                df = df.where(F.col("g").isNull() if self.graph is None else F.col("g") == self.graph)
            self._facts = df.where(F.col("t").between(*self.history)) if self.history else current(df, self.t)
        return self._facts

    def at(self, t: int) -> FlakeGraph:
        return FlakeGraph(self.flakes, t, self.graph)

    def types(self) -> dict[str, set[str]]:
        """Datatypes of each predicate's objects: the store's schema, one row a predicate."""
        if self._types is None:
            rows = self.flakes.select("p", "dt").distinct().limit(MOST_TYPES + 1).collect()
            self._types, self._whole = {}, len(rows) <= MOST_TYPES
            for r in rows if self._whole else ():
                self._types.setdefault(r.p, set()).add(r.dt)
        return self._types

    def types_of(self, p: str) -> set[str]:
        """Those of one predicate; asked for by itself where the schema is too large to hold."""
        known = self.types()
        if not self._whole and p not in known:
            known[p] = {r.dt for r in self.flakes.where(F.col("p") == p).select("dt").distinct().limit(3).collect()}
        return known.get(p, set())

    def scan(self, t: Triple) -> Frame:
        df, info, cols, seen = self.facts(), {}, [], {}
        for c, x in zip("sp", (t.s, t.p)):
            if isinstance(x, Var):
                if x.name in seen:
                    df = df.where(F.col(seen[x.name]) == F.col(c))
                else:
                    seen[x.name] = c
                    cols.append(F.col(c).alias(x.name))
                    info[x.name] = Info("iri")
            else:
                df = df.where(F.col(c) == x.value)
        o = t.o
        if isinstance(o, Var):
            if o.name in seen:
                df = df.where((F.col(seen[o.name]) == F.col("o")) & (F.col("dt") == "@id"))
            else:
                value, i, more = self._value(t.p, o.name)
                cols += [value.alias(o.name), *more]
                info[o.name] = i
        elif isinstance(o, Iri):
            df = df.where((F.col("o") == o.value) & (F.col("dt") == "@id"))
        else:
            df = df.where(self._equals(o))
        if t.t:
            cols.append(F.col("t").alias(t.t))
            info[t.t] = Info("lit", dt=XSD + "integer")
        if t.op:
            cols.append(F.col("op").alias(t.op))
            info[t.op] = Info("lit", dt=XSD + "boolean")
        return Frame(df.select(*cols), info)

    def _value(self, p, name: str) -> tuple[Column, Info, list[Column]]:
        kinds = self.types_of(p.value) if isinstance(p, Iri) else {"?", "!"}
        hidden = [F.col("dt").alias(f"__dt_{name}"), F.col("lang").alias(f"__lang_{name}")]
        if kinds == {"@id"}:
            return F.col("o"), Info("iri"), []
        if kinds and len({spark_type(k) or k for k in kinds}) == 1:
            kind = spark_type(next(iter(kinds)))
            dt = next(iter(kinds)) if len(kinds) == 1 else None
            if kind and kind != "string":
                return F.col("o").try_cast(kind), Info("lit", dt=dt), hidden
            if "@id" not in kinds:
                return F.col("o"), Info("lit", dt=dt), hidden
        return F.col("o"), Info("mixed"), hidden

    def _equals(self, o: Lit) -> Column:
        if o.lang:
            return (F.col("o") == o.value) & (F.lower("lang") == o.lang)
        if isinstance(o.value, str) and (o.dt in (None, XSD + "string")):
            return (F.col("o") == o.value) & (F.col("dt") == XSD + "string")
        if isinstance(o.value, (int, float)) and not isinstance(o.value, bool) or hasattr(o.value, "as_tuple"):
            numeric = [XSD + k for k in ("integer", "long", "int", "short", "byte", "decimal", "double", "float")]
            return F.col("dt").isin(numeric) & (F.col("o").try_cast("double") == float(o.value))
        return (F.col("o") == lexical(o)) & (F.col("dt") == o.dt)


def merged(graphs: list[FlakeGraph]) -> FlakeGraph:
    """The default graph of several: the union as a set."""
    df = graphs[0].facts().drop("g", "t", "op")
    flakes = graphs[0].flakes
    for g in graphs[1:]:
        df = df.union(g.facts().drop("g", "t", "op"))
        flakes = flakes.union(g.flakes)
    df = df.distinct().select(F.lit(None).cast("string").alias("g"), "*", F.lit(0).cast("long").alias("t"), F.lit(True).alias("op"))
    return FlakeGraph(flakes, facts=df)


# ---- writing: each makes the flakes to append at time t


def insert(flakes: DataFrame, new: DataFrame, t: int) -> DataFrame:
    """Asserts of what doesn't hold yet."""
    held = current(flakes).select(*FACT)
    cond = [F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}")) for c in FACT]
    return new.select(*FACT).distinct().alias("n").join(held.alias("h"), cond, "left_anti").select("*", F.lit(t).cast("long").alias("t"), F.lit(True).alias("op"))


def delete(flakes: DataFrame, gone: DataFrame, t: int) -> DataFrame:
    """Retracts of what holds."""
    held = current(flakes).select(*FACT)
    cond = [F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}")) for c in FACT]
    return held.alias("h").join(gone.select(*FACT).distinct().alias("n"), cond, "left_semi").select("*", F.lit(t).cast("long").alias("t"), F.lit(False).alias("op"))


def upsert(flakes: DataFrame, new: DataFrame, t: int) -> DataFrame:
    """Asserts of new values, and retracts of the other values of their subject and predicate."""
    held, new = current(flakes).select(*FACT), new.select(*FACT).distinct()
    keys = new.select("g", "s", "p").distinct()
    old = held.alias("h").join(keys.alias("k"), [F.col(f"h.{c}").eqNullSafe(F.col(f"k.{c}")) for c in "gsp"], "left_semi")
    stale = old.alias("h").join(new.alias("n"), [F.col(f"h.{c}").eqNullSafe(F.col(f"n.{c}")) for c in FACT], "left_anti")
    gone = stale.select(*FACT, F.lit(t).cast("long").alias("t"), F.lit(False).alias("op"))
    return gone.union(insert(flakes, new, t))


def graphs(flakes: DataFrame, using: list[str] | None = None, using_named: list[str] | None = None, home: str | None = None):
    """The dataset of a store's present state: the default graph (or `home`) and the named ones;
    `using` and `using_named` choose others."""
    from ..plans.compile import Dataset

    # the names of a store's graphs, as many as there are graphs
    names = using_named if using_named is not None else [r.g for r in flakes.where("g is not null").select("g").distinct().orderBy("g").collect()]
    default = merged([FlakeGraph(flakes, graph=g) for g in using]) if using else FlakeGraph(flakes, graph=home)
    return Dataset(default, {g: FlakeGraph(flakes, graph=g) for g in names})


def update(spark: SparkSession, flakes: DataFrame, where, deletes: list, inserts: list, t: int, graph: str | None = None, data=None) -> DataFrame:
    """Flakes of DELETE and INSERT templates for the solutions of `where` over `data` (the
    store's graphs). A template is a triple, of `graph`, or a pair of a graph (a name, a
    variable or None) and a triple; with an unbound part it is left out for that solution."""
    from ..plans.compile import Compiler
    from ..plans.expr import Expressions

    f = Compiler(spark, data or graphs(flakes, home=graph)).group(where)
    e = Expressions(f)

    def part(y) -> Column:
        return e.col(y).cast("string") if isinstance(y, Var) else F.lit(y.value if isinstance(y, Iri) else y).cast("string")

    def made(templates: list) -> DataFrame | None:
        rows = []
        for x in templates:
            g, x = x if isinstance(x, tuple) else (graph, x)
            if isinstance(x.o, Var):
                v = e.value(x.o)
                dt, lang = e.datatype(v), v.lang if v.lang is not None else F.lit(None)
            else:
                iri = isinstance(x.o, Iri)
                dt, lang = F.lit("@id" if iri else x.o.dt or (RDF + "langString" if x.o.lang else XSD + "string")), F.lit(None if iri else x.o.lang)
            o = part(x.o) if isinstance(x.o, (Var, Iri)) else F.lit(lexical(x.o))
            named = F.lit(isinstance(g, Var))  # a graph that isn't bound makes nothing
            rows.append(F.struct(part(g).alias("g"), part(x.s).alias("s"), part(x.p).alias("p"), o.alias("o"), dt.alias("dt"), lang.cast("string").alias("lang"), F.lit(None).cast("int").alias("i"), named.alias("named")))
        if not rows:
            return None
        df = f.df.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("s is not null and p is not null and o is not null and (g is not null or not named)")
        return df.drop("named")

    gone, new = made(deletes), made(inserts)
    out = delete(flakes, gone, t) if gone is not None else flakes.limit(0)
    if new is not None:
        after = flakes.union(out.select(flakes.columns))
        out = out.union(insert(after, new, t)) if gone is not None else insert(flakes, new, t)
    return out


def checked(commits: DataFrame, moment) -> None:
    """An error if a commit at this moment would stand before one that is there."""
    last = commits.agg(F.max("ts")).first()[0]
    if last is not None and commits.sparkSession.range(1).select(F.lit(moment).cast("timestamp") < F.lit(last)).first()[0]:
        raise ValueError(f"commit time {moment} is before the last one, {last}")


def resolve_time(commits: DataFrame, moment) -> int:
    """The last t of commits (t, ts) at or before a moment."""
    got = commits.where(F.col("ts") <= F.lit(moment)).agg(F.max("t")).first()[0]
    return got if got is not None else 0
