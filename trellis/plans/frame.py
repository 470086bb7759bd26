"""Solutions as a DataFrame: a column for each variable, and what is known of each."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ir import XSD, Iri, Lit


@dataclass(frozen=True)
class Info:
    """kind: iri, lit, mixed (lexical string with companions), list, map, path, rel.
    template: an IRI is carried as its raw key; the template makes it when it is shown.
    bound: whether every solution has a value."""

    kind: str = "lit"
    template: str | None = None
    bound: bool = True
    dt: str | None = None
    row: bool = False  # an anonymous row of a table, carried as a hash


@dataclass
class Frame:
    df: DataFrame
    info: dict[str, Info] = field(default_factory=dict)

    def hidden(self, name: str) -> list[str]:
        """Companion columns of a variable: its datatype (@id for IRIs) and its language."""
        return [c for c in (f"__dt_{name}", f"__lang_{name}") if c in self.df.columns]

    def maybe(self) -> Frame:
        return Frame(self.df, {k: replace(v, bound=False) for k, v in self.info.items()})


SPARK_TYPES = {
    "integer": "bigint", "long": "bigint", "int": "int", "short": "smallint", "byte": "tinyint", "nonNegativeInteger": "bigint", "positiveInteger": "bigint",
    "decimal": "decimal(38,16)", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "dateTime": "timestamp", "string": "string", "gYear": "int",
}


def spark_type(dt: str | None) -> str | None:
    return SPARK_TYPES.get(dt[len(XSD) :]) if dt and dt.startswith(XSD) else None


def xsd_of(kind: str) -> str | None:
    """The datatype of a Spark type's simple name."""
    names = {"bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "timestamp": "dateTime", "string": "string"}
    return XSD + ("decimal" if kind.startswith("decimal") else names[kind]) if kind in names or kind.startswith("decimal") else None


def literal(x: Lit) -> Column:
    kind = spark_type(x.dt)
    c = F.lit(x.value)
    return c.cast(kind) if kind and kind != "string" else c


def key_of(template: str, iri: str) -> str | None:
    """The key that makes this IRI by the template, if any."""
    head, _, rest = template.partition("{")
    tail = rest.partition("}")[2]
    if iri.startswith(head) and iri.endswith(tail) and len(iri) > len(head) + len(tail):
        return iri[len(head) : len(iri) - len(tail)]
    return None


def shown(c: Column, info: Info) -> Column:
    """The term itself: an IRI made by its template."""
    if info.row:
        return F.concat(F.lit("_:r"), F.hex(c))
    if not info.template:
        return c
    head, _, rest = info.template.partition("{")
    return F.concat(F.lit(head), c.cast("string"), F.lit(rest.partition("}")[2]))


def is_term(c: Column, info: Info, term: Iri | Lit, kind: str | None = None) -> Column:
    """Whether a column holds a constant term."""
    if isinstance(term, Iri):
        if info.kind == "lit":
            return F.lit(False)
        if info.template:
            key = key_of(info.template, term.value)
            return F.lit(False) if key is None else c == F.lit(key).cast(kind or "string")
        return c == F.lit(term.value)
    if info.kind == "iri":
        return F.lit(False)
    if info.kind == "mixed":
        return c == F.lit(lexical(term))
    return c == literal(term)


def lexical(x: Lit) -> str:
    if isinstance(x.value, bool):
        return str(x.value).lower()
    return str(x.value)


def same(a: Column, ia: Info, b: Column, ib: Info) -> Column:
    """Whether two columns hold the same term."""
    if ia.row or ib.row:
        return a == b if ia.row == ib.row else F.lit(False)
    if ia.template != ib.template:
        if ia.template and ib.template and not _compatible(ia.template, ib.template):
            return F.lit(False)
        return shown(a, ia) == shown(b, ib)
    if {ia.kind, ib.kind} == {"iri", "lit"}:
        return F.lit(False)
    if "mixed" in (ia.kind, ib.kind) and ia.kind != ib.kind:
        return a.cast("string") == b.cast("string")
    return a == b


#: Datatypes by how their values compare.
NUMBERS = [XSD + k for k in "integer decimal double float long int short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte".split()]
TIMES = [XSD + k for k in ("dateTime", "date", "dateTimeStamp")]


def number_of(c: Column, dt: Column) -> Column:
    return F.when(dt.isin(NUMBERS), c.cast("string").try_cast("double"))


def time_of(c: Column, dt: Column) -> Column:
    return F.when(dt.isin(TIMES), c.cast("string").try_cast("timestamp"))


def order_key(c: Column, dt: Column, lang: Column | None = None) -> Column:
    """A total order of terms of several kinds: blank nodes, IRIs, booleans, numbers by value,
    times, strings, others by datatype; null for what is unbound."""
    rank = F.when(dt == "@id", F.when(c.startswith("_:"), 0).otherwise(1)).when(dt == XSD + "boolean", 2).when(number_of(c, dt).isNotNull(), 3).when(time_of(c, dt).isNotNull(), 4).when(dt == XSD + "string", 5).otherwise(6)
    other = F.when(rank == 6, dt)
    return F.when(c.isNotNull(), F.struct(rank.alias("rank"), number_of(c, dt).alias("number"), time_of(c, dt).alias("time"), other.alias("dt"), c.cast("string").alias("text"), (lang if lang is not None else F.lit(None).cast("string")).alias("lang")))


def _compatible(a: str, b: str) -> bool:
    x, y = a.partition("{")[0], b.partition("{")[0]
    return x.startswith(y) or y.startswith(x)


def joined(l: Frame, r: Frame, how: str = "inner", on=None, merge: bool = False, only: list[str] | None = None) -> Frame:  # noqa: E741
    """Joins on the shared variables (or `only` these). merge: an unbound variable matches
    anything, as in VALUES and subqueries; else it matches nothing. on(frame, columns): a
    further condition; columns has a shared variable's right side by __r_ and its name."""
    shared = [v for v in l.info if v in r.info and (only is None or v in only)]
    names = {c: f"__r_{c}" for c in r.df.columns}
    right = r.df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    cond = None
    for v in shared:
        a, b = F.col(v), F.col(names[v])
        c = same(a, l.info[v], b, r.info[v])
        if "mixed" in (l.info[v].kind, r.info[v].kind):  # terms of the same spelling differ by datatype and language
            for h in set(l.hidden(v)) & set(r.hidden(v)):
                c = c & F.col(h).eqNullSafe(F.col(f"__r_{h}"))
        if merge and not l.info[v].bound:
            c = c | a.isNull()
        if merge and not r.info[v].bound:
            c = c | b.isNull()
        cond = c if cond is None else cond & c
    if merge and cond is not None and (loose := [v for v in shared if not (l.info[v].bound and r.info[v].bound)]) and len(loose) <= MOST_LOOSE and _joins(l.df) + _joins(r.df) <= MOST_JOINS:
        return _by_bound(l, r, how, on, loose)
    info = dict(l.info)
    both = Frame(None, l.info | {v: i for v, i in r.info.items() if v not in l.info})
    if on is not None:
        seen = {v: F.col(v) if v in l.info else F.col(names[v]) for v in both.info}
        for f, place in ((r, names.get), (l, lambda c: c)):
            seen |= {h: F.col(place(h)) for v in f.info for h in f.hidden(v) if f is l or v not in l.info}
        more = on(both, seen | {f"__r_{v}": F.col(names[v]) for v in shared})
        cond = more if cond is None else (more if cond is None else cond & more)
    if cond is None:
        # disconnected patterns: all pairs are the answer itself
        df = l.df.join(right, F.lit(True), how) if how != "inner" else l.df.crossJoin(right)
    else:
        df = l.df.join(right, cond, how)
    if how in ("left_semi", "left_anti"):
        return Frame(df, info)
    cols = []
    for c in l.df.columns:
        v = c if c in shared else None
        if v and merge and not (l.info[v].bound or how == "left"):
            if l.info[v].template != r.info[v].template:
                cols.append(F.coalesce(shown(F.col(v), l.info[v]), shown(F.col(names[v]), r.info[v])).alias(v))
                info[v] = Info("iri", bound=r.info[v].bound)
            else:
                cols.append(F.coalesce(F.col(v), F.col(names[v])).alias(v))
                info[v] = replace(l.info[v], bound=r.info[v].bound)
        else:
            cols.append(F.col(f"`{c}`"))
            if v and how == "inner" and not merge:
                info[v] = replace(info[v], bound=True)
    for c, n in names.items():
        if c not in l.df.columns:
            cols.append(F.col(f"`{n}`").alias(c))
    for v, i in r.info.items():
        if v not in l.info:
            info[v] = replace(i, bound=i.bound and how != "left")
    return Frame(df.select(*cols), info)


#: Variables that may be unbound by which a join is split into equi-joins, and joins in the plans
#: of its sides up to which it is, as these are repeated for each way.
MOST_LOOSE, MOST_JOINS = 2, 60


def _joins(df: DataFrame) -> int:
    return df._jdf.queryExecution().analyzed().toString().count("Join ")


def _by_bound(l: Frame, r: Frame, how: str, on, loose: list[str]) -> Frame:  # noqa: E741
    """joined() where variables may be unbound on either side: an equi-join for each way in
    which they are bound, instead of pairs of all rows. A right side's ways are united, or for
    semi and anti joins taken one after the other."""

    def ways(f: Frame) -> list[tuple[tuple[str, ...], Frame]]:
        """(unbound ones, solutions) by which of the loose variables are bound."""
        out = [((), f)]
        for v in loose:
            if not f.info[v].bound:
                out = [(u + more, Frame(x.df.where(F.col(v).isNull() if more else F.col(v).isNotNull()), x.info | {v: replace(x.info[v], bound=True)})) for u, x in out for more in ((), (v,))]
        return out

    def without(f: Frame, gone: tuple[str, ...]) -> Frame:
        return Frame(f.df.drop(*gone, *[h for v in gone for h in f.hidden(v)]), {v: i for v, i in f.info.items() if v not in gone})

    rights, out = ways(r), []
    for empty, x in ways(l):
        pairs = [(without(y, tuple(set(gone) | set(empty))) if how.startswith("left_") else without(y, gone)) for gone, y in rights]
        if how == "left_anti":
            for y in pairs:
                x = joined(x, y, how, on)
            out.append(x)
        elif how == "left_semi":
            rest = x
            for y in pairs:
                out.append(joined(rest, y, "left_semi", on))
                rest = joined(rest, y, "left_anti", on)
        else:
            for y in pairs:
                out.append(joined(without(x, empty), y, "inner", on))
            if how == "left":
                for y in pairs:
                    x = joined(x, without(y, empty), "left_anti", on)
                out.append(x)
    info = {}
    for v in dict.fromkeys([*l.info, *r.info]):
        mine, other = l.info.get(v), r.info.get(v)
        if mine and other:
            bound = mine.bound or other.bound and how == "inner"
            info[v] = replace(mine if mine.template == other.template or mine.bound else Info("iri"), bound=bound)
        elif mine or not how.startswith("left_"):
            info[v] = replace(mine or other, bound=(mine or other).bound and (bool(mine) or how != "left"))
    frames = [Frame(f.df, {v: f.info.get(v, info[v]) for v in f.info if v in info}) for f in out]
    made = united(frames)
    return Frame(made.df, {v: replace(made.info[v], bound=info[v].bound) for v in info})


def united(frames: list[Frame]) -> Frame:
    """All solutions of all frames; what a frame lacks is unbound there."""
    names = list(dict.fromkeys(v for f in frames for v in f.info))
    out = []
    info: dict[str, Info] = {}
    for v in names:
        have = [f.info[v] for f in frames if v in f.info]
        one = have[0]
        alike = all((i.template, i.kind, i.row) == (one.template, one.kind, one.row) for i in have)
        kinds = {str(f.df.schema[v].dataType) for f in frames if v in f.info}
        bound = len(have) == len(frames) and all(i.bound for i in have)
        if alike and (len(kinds) == 1 or one.kind == "lit" and all("String" not in k and "Timestamp" not in k and "Bool" not in k for k in kinds)):
            info[v] = replace(one, bound=bound)
        else:
            info[v] = Info("iri" if all(i.kind == "iri" for i in have) else "mixed", bound=bound)
    # where terms of several kinds meet, or one frame knows them, datatypes and languages go along
    told = [v for v in names if info[v].kind == "mixed" or any(v in f.info and f.hidden(v) for f in frames)]
    for f in frames:
        cols = []
        for v in told:
            have = v in f.info
            kind = f.df.schema[v].dataType.simpleString() if have else ""
            own = f.info[v].dt or xsd_of(kind) if have and f.info[v].kind != "iri" else "@id"
            dt = F.col(f"__dt_{v}") if have and f"__dt_{v}" in f.df.columns else F.when(F.col(v).isNotNull(), F.lit(own)) if have and kind != "void" else F.lit(None)
            lang = F.col(f"__lang_{v}") if have and f"__lang_{v}" in f.df.columns else F.lit(None)
            cols += [dt.cast("string").alias(f"__dt_{v}"), lang.cast("string").alias(f"__lang_{v}")]
        for v in names:
            if v not in f.info:
                cols.append(F.lit(None).alias(v))
            elif (info[v].template, info[v].kind, info[v].row) == (f.info[v].template, f.info[v].kind, f.info[v].row):
                cols.append(F.col(v))
            else:
                cols.append(shown(F.col(v), f.info[v]).cast("string").alias(v))
        out.append(f.df.select(*cols))
    df = out[0]
    for x in out[1:]:
        df = df.unionByName(x)
    return Frame(df, info)
