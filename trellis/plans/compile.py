"""Queries to one lazy DataFrame."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ir import XSD, Agg, Bind, Call, Choice, Each, Exists, Filter, Group, InGraph, Inverse, Iri, Lit, Minus, NotIn, Optional, Query, Repeat, Search, Sequence, Service, Shortest, Sub, Triple, Union, Unwind, Values, Var, variables
from . import paths
from .expr import Expressions, Value, assigned
from .frame import Frame, Info, is_term, joined, lexical, number_of, order_key, shown, united


class Dataset:
    """Sources of facts by graph. default: facts that patterns outside GRAPH see, the union
    of several as a set; named: graphs by IRI; services: other datasets by name; indexes: for
    searches, name to function(query, limit) -> (id, score); commits: (id, t, ts), for graphs
    at a moment or commit."""

    def __init__(self, default, named: dict | None = None, services: dict | None = None, indexes: dict | None = None, commits: DataFrame | None = None):
        self.default, self.named, self.services, self.indexes, self.commits = default, named or {}, services or {}, indexes or {}, commits

    def graph(self, iri: str):
        """A named graph, or None; with @t:5, @iso:2024-05-01T00:00:00 or @commit:id behind its
        name (of none, the default graph's) as it was then."""
        m = re.fullmatch(r"(.*?)@(t|iso|commit):(.+)", iri)
        if not m or iri in self.named:
            return self.named.get(iri)
        base = self.named.get(m[1]) if m[1] else self.default
        if base is None:
            return None
        if m[2] == "t":
            return base.at(int(m[3]))
        if self.commits is None:
            raise ValueError("a dataset without commits knows no moments")
        if m[2] == "iso":
            from ..sources.flakes import resolve_time

            return base.at(resolve_time(self.commits, F.lit(m[3]).cast("timestamp")))
        row = self.commits.where(F.col("id") == m[3]).agg(F.max("t").alias("t")).first()
        if row.t is None:
            raise ValueError(f"no commit {m[3]}")
        return base.at(row.t)


class Compiler:
    def __init__(self, spark: SparkSession, data: Dataset, correlated: bool = False):
        self.spark, self.data, self.correlated = spark, data, correlated
        self.source, self.fresh = data.default, 0
        self.rewrite = None  # of groups, by a schema's hierarchies
        self.predicates: dict[str, str] = {}  # of the patterns that bind variables as objects

    def name(self) -> str:
        self.fresh += 1
        return f"__x{self.fresh}"

    def unit(self) -> Frame:
        return Frame(self.spark.range(1).select(), {})

    def resolved(self, e):
        """An expression with the statistics that fulltext(?text, "query") needs: those of all
        texts of the predicate that binds ?text, a row for the driver."""
        if isinstance(e, Call) and e.name == "fulltext":
            from ..operators.search import TextIndex

            text, query = e.args
            if not isinstance(text, Var) or not isinstance(query, Lit) or text.name not in self.predicates:
                raise ValueError("fulltext() takes an object of a pattern and a constant")
            f = self.source.scan(Triple(Var("s"), Iri(self.predicates[text.name]), Var("o")))
            return Call("bm25", (text, *map(Lit, TextIndex(f.df, "s", "o").statistics(query.value))))
        if isinstance(e, Call):
            return replace(e, args=tuple(self.resolved(a) for a in e.args))
        return e

    # -- groups of patterns

    def group(self, g: Group, start: Frame | None = None) -> Frame:
        f, filters = self.parts(g, start)
        return self.filtered(f, filters)

    def parts(self, g: Group, start: Frame | None = None) -> tuple[Frame, list]:
        """The frame of a group's patterns, and its filters, which are not yet applied."""
        f, filters, triples = start, [], []
        g = self.rewrite(g) if self.rewrite else g

        def flush() -> None:
            nonlocal f, triples
            if triples:
                f = self.bgp(triples, f)
                triples = []

        # filters apply to their whole group, so triples on either side of one are together
        for p in g.parts:
            if isinstance(p, Triple):
                triples.append(p)
                continue
            if isinstance(p, Filter):
                filters.append(p.expr)
                continue
            if isinstance(p, Shortest):
                f, triples = self.walked(p, triples, f), []
                continue
            flush()
            base = f if f is not None else self.unit()
            if isinstance(p, Optional):
                right, conditions = self.parts(p.group)
                right = self.filtered(right, [c for c in conditions if _has_exists(c)])
                conditions = [c for c in conditions if not _has_exists(c)]
                f = joined(base, right, "left", self.condition(conditions), merge=not _triples_first(p.group))
            elif isinstance(p, Union):
                u = united([self.group(x) for x in p.groups])
                f = u if f is None else joined(f, u, merge=True)
            elif isinstance(p, Minus):
                f = self.minus(base, self.group(p.group))
            elif isinstance(p, Bind):
                f = self.bind(base, p)
            elif isinstance(p, Unwind):
                v = Expressions(base).value(p.expr)
                f = Frame(base.df.select("*", F.explode(v.col).alias(p.var)), base.info | {p.var: Info(v.info.kind if v.info.kind == "iri" else "lit")})
            elif isinstance(p, Values):
                v = self.values(p)
                f = v if f is None else joined(f, v, merge=True)
            elif isinstance(p, Group):
                x = self.group(p)
                f = x if f is None else joined(f, x, merge=True)
            elif isinstance(p, InGraph):
                x = self.in_graph(p)
                f = x if f is None else joined(f, x, merge=True)
            elif isinstance(p, Service):
                x = self.service(p)
                f = x if f is None else joined(f, x, merge=True)
            elif isinstance(p, Sub):
                f = self.sub(base if f is not None else None, p)
            elif isinstance(p, Search):
                x = Frame(self.data.indexes[p.target](p.query, p.limit).toDF(p.subject, p.score), {p.subject: Info("iri"), p.score: Info()})
                f = x if f is None else joined(f, x)
            else:
                raise ValueError(f"unknown pattern {p!r}")
        flush()
        return f if f is not None else self.unit(), filters

    def condition(self, conditions: list):
        """on= of joined() from filters that see both sides."""
        if not conditions:
            return None

        def make(both: Frame, columns: dict[str, Column]) -> Column:
            e = Expressions(both, columns)
            out = F.lit(True)
            for c in conditions:
                out = out & e.condition(c)
            return out

        return make

    def filtered(self, f: Frame, filters: list) -> Frame:
        for c in filters:
            for part in _conjuncts(self.resolved(c)):
                if isinstance(part, Exists):
                    f = self.exists(f, part.group, part.negated)
                elif isinstance(part, Call) and part.name == "not" and isinstance(part.args[0], Exists):
                    f = self.exists(f, part.args[0].group, not part.args[0].negated)
                elif _has_exists(part):
                    f = self.exists_inside(f, part)
                else:
                    if (box := _box(part)) is not None:  # reaches the scan's statistics
                        f = Frame(f.df.where(Expressions(f).condition(box)), f.info)
                    f = Frame(f.df.where(Expressions(f).condition(part)), f.info)
        return f

    def exists(self, f: Frame, g: Group, negated: bool) -> Frame:
        right, conditions = self.parts(g)
        right = self.filtered(right, [c for c in conditions if _has_exists(c)])
        on = self.condition([c for c in conditions if not _has_exists(c)])
        return joined(f, right, "left_anti" if negated else "left_semi", on, merge=True)

    def exists_inside(self, f: Frame, e) -> Frame:
        """EXISTS under OR and the like: a flag from an outer join with the distinct keys."""
        flags: dict = {}

        def replaced(x):
            if isinstance(x, Exists):
                flag = self.name()
                flags[flag] = x
                return Call("=", (Var(flag), Lit(True, "http://www.w3.org/2001/XMLSchema#boolean")))
            if isinstance(x, Call):
                return Call(x.name, tuple(replaced(a) for a in x.args))
            return x

        e, names = replaced(e), list(f.info)
        for flag, x in flags.items():
            ids = self.name()
            if self.parts(x.group)[1]:  # inner filters may see outer variables
                # numbered once, in a written table: a lost task would number otherwise
                numbered = Frame(paths.kept(f.df.withColumn(ids, F.monotonically_increasing_id())), f.info)
                hit = self.exists(numbered, x.group, False).df.select(F.col(ids).alias("__hit"))
                df = numbered.df.join(hit, numbered.df[ids] == F.col("__hit"), "left").withColumn(flag, F.col("__hit").isNotNull() != F.lit(x.negated)).drop(ids, "__hit")
            else:
                right = self.group(x.group)
                keys = [v for v in right.info if v in f.info]
                right = Frame(right.df.select(*keys).distinct().withColumn("__hit", F.lit(True)), {k: right.info[k] for k in keys})
                df = joined(f, right, "left").df.withColumn(flag, F.coalesce("__hit", F.lit(False)) != F.lit(x.negated)).drop("__hit")
            f = Frame(df, f.info | {flag: Info()})
        df = f.df.where(Expressions(f).condition(e)).drop(*flags)
        return Frame(df, {k: f.info[k] for k in names})

    def minus(self, f: Frame, right: Frame) -> Frame:
        shared = [v for v in f.info if v in right.info]
        if not shared:
            return f
        right = Frame(right.df.select(*shared).distinct(), {v: right.info[v] for v in shared})
        if all(f.info[v].bound and right.info[v].bound for v in shared):
            return joined(f, right, "left_anti")

        def overlap(_, cols):  # at least one variable bound on both sides
            out = F.lit(False)
            for v in shared:
                if f"__r_{v}" in cols:
                    out = out | (F.col(v).isNotNull() & cols[f"__r_{v}"].isNotNull())
            return out

        return joined(f, right, "left_anti", overlap, merge=True)

    def bind(self, f: Frame, b: Bind) -> Frame:
        v = Expressions(f).value(self.resolved(b.expr))
        if b.var in f.info:  # a constraint
            old = F.col(b.var)
            df = f.df.where(old.isNull() | v.col.isNull() | (shown(old, f.info[b.var]) == shown(v.col, v.info)))
            return Frame(df.withColumn(b.var, F.coalesce(old, v.col)), f.info)
        out = assigned(f, b.var, v)
        return Frame(out.df, out.info | {b.var: replace(v.info, bound=False if not isinstance(b.expr, (Lit, Iri)) else True)})

    def values(self, v: Values) -> Frame:
        info, columns = {}, []
        for k, n in enumerate(v.names):
            terms = [r[k] for r in v.rows]
            known = [t for t in terms if t is not None]
            iri = known and all(isinstance(t, Iri) for t in known)
            mixed = not iri and (any(isinstance(t, Iri) for t in known) or len({type(t.value) for t in known}) > 1)
            kind = "iri" if iri else "mixed" if mixed else "lit"
            info[n] = Info(kind, bound=len(known) == len(terms), dt=None if iri or mixed or not known else known[0].dt)
            columns.append([None if t is None else t.value if isinstance(t, Iri) else lexical(t) if mixed else t for t in terms])
        if not v.rows:
            return Frame(self.spark.range(0).select(*[F.lit(None).cast("string").alias(n) for n in v.names]), {n: Info("iri") for n in v.names})
        from .frame import literal

        from ..ir import RDF

        kinds = {bool: "boolean", int: "integer", float: "double", str: "string"}

        def told(i: int) -> list[Column]:
            """Datatypes and tags of a row's terms, where terms of several kinds meet or are tagged."""
            out = []
            for k, n in enumerate(v.names):
                known = [r[k] for r in v.rows if isinstance(r[k], Lit)]
                if info[n].kind != "mixed" and not any(t.lang for t in known):
                    continue
                t = v.rows[i][k]
                dt = None if t is None else "@id" if isinstance(t, Iri) else RDF + "langString" if t.lang else t.dt or XSD + kinds.get(type(t.value), "decimal")
                out += [F.lit(dt).cast("string").alias(f"__dt_{n}"), F.lit(getattr(t, "lang", None)).cast("string").alias(f"__lang_{n}")]
            return out

        cells = [F.struct(*[(literal(c[i]) if isinstance(c[i], Lit) else F.lit(c[i])).alias(n) for n, c in zip(v.names, columns)], *told(i)) for i in range(len(v.rows))]
        df = self.spark.range(1).select(F.inline(F.array(*cells)))
        return Frame(df, info)

    def in_graph(self, p: InGraph) -> Frame:
        old = self.source
        try:
            if isinstance(p.graph, Iri):
                if p.graph.value not in self.data.named:
                    return Frame(self.spark.range(0).select(*[F.lit(None).cast("string").alias(v) for v in variables(p.group)]), {v: Info("iri") for v in variables(p.group)})
                self.source = self.data.named[p.graph.value]
                return self.group(p.group)
            frames = []
            for iri, source in self.data.named.items():
                self.source = source
                f = self.group(p.group)
                frames.append(Frame(f.df.withColumn(p.graph.name, F.lit(iri)), f.info | {p.graph.name: Info("iri")}))
            return united(frames) if frames else Frame(self.spark.range(0).select(F.lit(None).cast("string").alias(p.graph.name)), {p.graph.name: Info("iri")})
        finally:
            self.source = old

    def service(self, p: Service) -> Frame:
        if p.name not in self.data.services:
            if p.silent:
                return self.unit()
            raise ValueError(f"no such service {p.name}")
        return Compiler(self.spark, self.data.services[p.name]).group(p.group)

    def sub(self, f: Frame | None, p: Sub) -> Frame:
        if p.lateral is None or f is None:
            x = self.query_frame(p.query)
            return x if f is None else joined(f, x, merge=True)
        # each row's own run: keyed by the variables it sees
        keys = [v for v in p.lateral if v in f.info]
        seeds = Frame(f.df.select(*keys).distinct(), {k: f.info[k] for k in keys})
        x = self.query_frame(p.query, seeds, keys)
        return joined(f, x)

    def walked(self, p: Shortest, triples: list[Triple], f: Frame | None) -> Frame:
        """A search for paths, joined with what stands before it. Patterns that only the paths
        connect are solved apart, so that their ends aren't paired with all others."""
        groups: list[tuple[set[str], list[Triple], Frame | None]] = [] if f is None else [(set(f.info), [], f)]
        for t in triples:
            names = set(variables([t]))
            like = [g for g in groups if g[0] & names]
            groups = [g for g in groups if not g[0] & names]
            groups.append((names.union(*[g[0] for g in like]), [x for g in like for x in g[1]] + [t], next((g[2] for g in like if g[2] is not None), None)))
        frames = [self.bgp(sorted(ts, key=triples.index), base) if ts else base for _, ts, base in groups]
        x = paths.shortest(self, p, frames)
        for y in sorted(frames, key=lambda y: not set(y.info) & set(x.info)):
            x = joined(x, y)
        return x

    # -- basic graph patterns

    def bgp(self, triples: list[Triple], f: Frame | None) -> Frame:
        triples = list(dict.fromkeys(triples))
        stars: dict = {}
        self.predicates |= {t.o.name: t.p.value for t in triples if isinstance(t.o, Var) and isinstance(t.p, Iri)}
        for t in triples:
            if not isinstance(t.p, (Iri, Var)):
                stars[len(stars), "path"] = [t]
            else:
                stars.setdefault(t.s if hasattr(self.source, "star") else (len(stars), "t"), []).append(t)
        todo = list(stars.values())
        frames: list[Frame | None] = [None] * len(todo)
        # constants first, then whatever is connected to what is there
        rank = lambda ts: -sum(not isinstance(x, Var) for t in ts for x in (t.s, t.o))
        order = sorted(range(len(todo)), key=lambda i: (rank(todo[i]), i))
        while order:
            pick = next((i for i in order if f is not None and set(variables(todo[i])) & set(f.info)), order[0])
            order.remove(pick)
            if any(not isinstance(t.p, (Iri, Var)) for t in todo[pick]):
                x = paths.frame(self, todo[pick][0], f)
            elif hasattr(self.source, "star"):
                x = self.source.star(todo[pick])
            else:
                x = self.source.scan(todo[pick][0])
            f = x if f is None else joined(f, x)
        return f

    # -- queries

    def query_frame(self, q: Query, seeds: Frame | None = None, keys: list[str] | None = None) -> Frame:
        f = self.group(q.where, seeds)
        if q.values:
            f = joined(f, self.values(q.values), merge=True)
        out = self.solved(q, f, keys or [])
        if q.union:
            other, every = q.union
            x = self.query_frame(other)
            out = united([out, x])
            if not every:
                out = Frame(out.df.distinct(), out.info)
        return out

    def solved(self, q: Query, f: Frame, keys: list[str]) -> Frame:
        """Grouping, HAVING, ORDER, projection, DISTINCT, OFFSET and LIMIT of solutions; per
        value of `keys` where these are given."""
        select = q.select if q.select is not None else [(Var(v), v) for v in f.info if not v.startswith("_")]
        aggs: dict[Agg, str] = {}

        def lifted(e):
            if isinstance(e, Agg):
                return Var(aggs.setdefault(e, self.name()))
            if isinstance(e, Call):
                e = self.resolved(e)
                return Call(e.name, tuple(lifted(a) for a in e.args))
            if isinstance(e, Each):
                return Each(e.kind, e.var, lifted(e.items), lifted(e.where) if e.where is not None else None, lifted(e.value) if e.value is not None else None, e.acc, lifted(e.start) if e.start is not None else None)
            return e

        select = [(lifted(e), n) for e, n in select]
        having = lifted(q.having) if q.having is not None else None
        order = [(lifted(e), d) for e, d in q.order]
        if aggs or q.group is not None:
            f = self.grouped(q, f, aggs, keys)
            if having is not None:
                f = self.filtered(f, [having])
        # computed columns, in order: a later one may use an earlier one
        for e, n in select:
            if not (isinstance(e, Var) and e.name == n):
                v = Expressions(f).value(e)
                f = assigned(f, n, v)
            elif n not in f.info:
                f = Frame(f.df.withColumn(n, F.lit(None).cast("string")), f.info | {n: Info(bound=False)})
        names = [n for _, n in select]
        sort = []
        for e, desc in order:
            n = self.name()
            f = Frame(f.df.withColumn(n, Expressions(f).order(e)), f.info)
            sort.append((n, desc))
        kept = list(dict.fromkeys(keys + names))
        told = [h for n in kept for h in f.hidden(n)]
        by = [F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_first() for n, d in sort]
        df = f.df.select(*kept, *[n for n, _ in sort], *told)
        if q.distinct:
            hidden = [n for n, _ in sort]
            df = df.groupBy(*kept, *told).agg(*[F.min(n).alias(n) for n in hidden]) if hidden else df.select(*kept, *told).distinct()
        if keys and (q.limit is not None or q.offset):
            from pyspark.sql import Window

            df = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*(by or [F.lit(1)]))))
            df = df.where((F.col("__n") > q.offset) & (F.col("__n") <= q.offset + (q.limit if q.limit is not None else 2**31 - 1 - q.offset))).drop("__n")
        else:
            if by:
                df = df.orderBy(*by)
            if q.offset:
                df = df.offset(q.offset)
            if q.limit is not None:
                df = df.limit(q.limit)
        return Frame(df.drop(*[n for n, _ in sort]), {n: f.info[n] for n in kept})

    def grouped(self, q: Query, f: Frame, aggs: dict[Agg, str], keys: list[str]) -> Frame:
        names = list(keys)
        for e, n in q.group or []:
            if not (isinstance(e, Var) and e.name == n):
                f = assigned(f, n, Expressions(f).value(e))
            elif n not in f.info:
                f = Frame(f.df.withColumn(n, F.lit(None).cast("string")), f.info | {n: Info(bound=False)})
            names.append(n)
        info = {n: f.info[n] for n in names}
        names += [h for n in names for h in f.hidden(n)]
        visible = [v for v in f.info if not v.startswith("_")]
        cols = []
        for a, n in aggs.items():
            v, c, *told = self.aggregate(a, f, visible)
            cols += [c.alias(n), *[t.alias(f"__{k}_{n}") for t, k in zip(told, ("dt", "lang"))]]
            info[n] = v
        if not cols:
            return Frame(f.df.select(*names).distinct(), info)
        df = f.df.groupBy(*names).agg(*cols) if names else f.df.agg(*cols)
        return Frame(df, info)

    def aggregate(self, a: Agg, f: Frame, visible: list[str]) -> tuple[Info, Column] | tuple[Info, Column, Column, Column]:
        """What is known of an aggregate, its column, and those of its datatype and language
        where these differ by group."""
        if a.arg is None:
            return Info(), F.count_distinct(F.struct(*[F.col(v) for v in visible])) if a.distinct else F.count("*")
        e = Expressions(f)
        v: Value = e.value(a.arg)
        if a.name == "count":
            if isinstance(a.arg, Var) and v.info.bound and v.info.row and not a.distinct:
                return Info(), F.count("*")
            if a.distinct and v.info.kind == "mixed" and v.dt is not None:
                return Info(), F.count_distinct(order_key(v.col, v.dt, v.lang))
            return Info(), F.count_distinct(v.col) if a.distinct else F.count(v.col)
        if a.name in ("min", "max", "sample") and v.info.kind == "mixed" and v.dt is not None:
            by, key = F.max_by if a.name == "max" else F.min_by, order_key(v.col, v.dt, v.lang)
            return replace(v.info, bound=False), by(v.col, key), by(v.dt, key), by(v.lang if v.lang is not None else F.lit(None).cast("string"), key)
        if a.name in ("min", "max", "sample"):
            c = {"min": F.min, "max": F.max, "sample": F.min}[a.name](v.col)
            return replace(v.info, bound=False), c
        if a.name == "group_concat":
            c = shown(v.col, v.info).cast("string")
            return Info(), F.array_join(F.array_sort(F.collect_set(c) if a.distinct else F.collect_list(c)), a.sep)
        if a.name == "collect":
            return Info("list"), (F.collect_set if a.distinct else F.collect_list)(shown(v.col, v.info))
        kind = e.type(v)
        c = v.col
        if v.info.kind == "mixed" and v.dt is not None:
            c, kind = number_of(c, v.dt), "double"
        elif kind == "string":
            c, kind = c.try_cast("double"), "double"
        if a.name == "sum":
            return Info(), F.coalesce(F.sum_distinct(c) if a.distinct else F.sum(c), F.lit(0))
        if a.name == "avg":
            if kind in ("bigint", "int", "smallint", "tinyint"):
                c = c.cast("decimal(38,16)")  # exact
            return Info(), F.coalesce(F.try_divide(F.sum_distinct(c), F.count_distinct(c)) if a.distinct else F.avg(c), F.lit(0))
        if a.distinct:
            return Info(), _of_distinct(a.name, c)
        return Info(), {"median": F.median, "variance": F.var_pop, "stddev": F.stddev_pop, "stdev": F.stddev_pop}[a.name](c)

    # -- results

    def run(self, q: Query) -> DataFrame:
        if q.frm or q.frm_named:
            from ..sources.flakes import merged

            graphs = [g for i in q.frm if (g := self.data.graph(i)) is not None]
            named = {i: g for i in q.frm_named if (g := self.data.graph(i)) is not None} if q.frm_named else self.data.named
            data = Dataset(merged(graphs) if graphs else self.data.default, named, self.data.services, self.data.indexes, self.data.commits)
            c = Compiler(self.spark, data, self.correlated)
            c.rewrite = self.rewrite
            return c.run(replace(q, frm=[], frm_named=[]))
        if q.form == "ask":
            f = self.group(q.where)
            return f.df.limit(1).agg((F.count("*") > 0).alias("ask"))
        if q.form == "construct":
            return self.constructed(q, self.query_frame(replace(q, select=None, form="select")))
        if q.form == "describe":
            return self.described(q)
        f = self.query_frame(q)
        names = [n for _, n in q.select] if q.select is not None else list(f.info)
        return f.df.select(*[shown(F.col(n), f.info[n]).alias(n) for n in names])

    def constructed(self, q: Query, f: Frame) -> DataFrame:
        """A triple for each template and solution; those with an unbound part are left out."""
        rows = []
        for t in q.template:
            cells = []
            for x in (t.s, t.p, t.o):
                if isinstance(x, Var):
                    cells.append(shown(F.col(x.name), f.info[x.name]).cast("string") if x.name in f.info else F.lit(None).cast("string"))
                else:
                    cells.append(F.lit(x.value if isinstance(x, Iri) else lexical(x)))
            rows.append(F.struct(*[c.alias(n) for c, n in zip(cells, "spo")]))
        df = f.df.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
        return df.where("s is not null and p is not null and o is not null").distinct()

    def described(self, q: Query) -> DataFrame:
        """All facts of the described subjects, and of the blank nodes they lead to."""
        facts = self.source.scan(Triple(Var("s"), Var("p"), Var("o")))
        facts = facts.df.select(*[shown(F.col(c), facts.info[c]).cast("string").alias(c) for c in "spo"])
        ids = None
        for x in q.described:
            if isinstance(x, Iri):
                d = self.spark.range(1).select(F.lit(x.value).alias("id"))
            else:
                f = self.group(q.where)
                d = f.df.select(shown(F.col(x.name), f.info[x.name]).cast("string").alias("id"))
            ids = d if ids is None else ids.union(d)
        ids = ids.where("id is not null").distinct()
        out = facts.join(ids, facts["s"] == ids["id"], "left_semi")
        blank = out.where(F.col("o").startswith("_:")).select(F.col("o").alias("id")).distinct()
        return out.union(facts.join(blank, facts["s"] == blank["id"], "left_semi")).distinct()


def _of_distinct(name: str, c: Column) -> Column:
    """MEDIAN, VARIANCE and STDDEV of a group's distinct values."""
    x = F.array_sort(F.collect_set(c.cast("double")))
    n = F.size(x)
    if name == "median":
        low, high = F.get(x, F.floor((n - 1) / 2).cast("int")), F.get(x, F.floor(n / 2).cast("int"))
        return (low + high) / 2
    mean = F.try_divide(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), n)
    var = F.try_divide(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)), n)
    return var if name == "variance" else F.sqrt(var)


def _conjuncts(e) -> list:
    if isinstance(e, Call) and e.name == "and":
        return [y for a in e.args for y in _conjuncts(a)]
    return [e]


def _box(e):
    """The box around geodistance(?lat, ?lon, y, x) < metres, for plain columns; None for
    another condition, and where a box would meet a pole or the date line."""
    from ..operators.search import around

    if not isinstance(e, Call) or e.name not in ("<", "<=") or not isinstance(e.args[1], Lit):
        return None
    d, r = e.args
    if not isinstance(d, Call) or d.name != "geodistance" or not (isinstance(d.args[0], Var) and isinstance(d.args[1], Var)):
        return None
    y, x = (a.value if isinstance(a, Lit) else -a.args[0].value if isinstance(a, Call) and a.name == "neg" and isinstance(a.args[0], Lit) else None for a in d.args[2:])
    if y is None or x is None:
        return None
    low, high, left, right = around(float(y), float(x), float(r.value))
    sides = [Call(">=", (d.args[0], Lit(low, XSD + "double"))), Call("<=", (d.args[0], Lit(high, XSD + "double")))]
    if left is not None:
        sides += [Call(">=", (d.args[1], Lit(left, XSD + "double"))), Call("<=", (d.args[1], Lit(right, XSD + "double")))]
    out = sides[0]
    for s in sides[1:]:
        out = Call("and", (out, s))
    return out


def _has_exists(e) -> bool:
    if isinstance(e, Exists):
        return True
    return isinstance(e, Call) and any(_has_exists(a) for a in e.args)


def _triples_first(g: Group) -> bool:
    return all(isinstance(p, (Triple, Filter, Optional, Bind)) for p in g.parts)


__all__ = ["Compiler", "Dataset", "Choice", "Inverse", "NotIn", "Repeat", "Sequence", "is_term"]
