"""Expressions to columns. An error is null: in a filter that is false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..ir import RDF, XSD, Agg, Call, Each, Exists, Iri, Lit, Var
from .frame import NUMBERS, Frame, Info, is_term, key_of, lexical, literal, number_of, order_key, same, shown, time_of, xsd_of  # noqa: F401

NUMERIC = ("bigint", "int", "smallint", "tinyint", "double", "float", "decimal")
CASTS = {"boolean": "boolean", "integer": "bigint", "long": "bigint", "int": "int", "float": "float", "double": "double", "decimal": "decimal(38,16)", "string": "string", "dateTime": "timestamp", "date": "date", "time": "string"}


class Value:
    """A column with what is known of it. dt, lang: columns of its terms' datatypes (@id for
    IRIs) and languages, where these differ by row."""

    def __init__(self, col: Column, info: Info | None = None, dt: Column | None = None, lang: Column | None = None):
        self.col, self.info, self.dt, self.lang = col, info or Info(), dt, lang


def assigned(f: Frame, name: str, v: Value) -> Frame:
    """A frame with a computed variable, and what goes along with it."""
    more = {f"__{k}_{name}": c for k, c in (("dt", v.dt), ("lang", v.lang)) if c is not None}
    gone = [h for h in f.hidden(name) if h not in more]
    return Frame(f.df.withColumns({name: v.col} | more).drop(*gone), f.info | {name: v.info})


class Expressions:
    """Compiles expressions over a frame. columns: where the variables are, if not under
    their own names. exists(group, negated): makes the column of an EXISTS."""

    def __init__(self, frame: Frame, columns: dict[str, Column] | None = None, strict: bool = True):
        self.frame, self.columns, self.strict = frame, columns, strict
        self.local: dict[str, Value] = {}

    def type(self, v: Value) -> str:
        """Simple name of a column's Spark type, or '' where it can't be told."""
        if self.frame.df is None or self.local:
            return ""
        try:
            return self.frame.df.select(v.col).schema[0].dataType.simpleString()
        except Exception:
            return ""

    def var(self, name: str) -> Value:
        if name in self.local:
            return self.local[name]
        if name not in self.frame.info:
            return Value(F.lit(None), Info(bound=False))
        dt, lang = (self.companion(k, name) for k in ("dt", "lang"))
        return Value(self.columns[name] if self.columns else F.col(name), self.frame.info[name], dt, lang)

    def companion(self, kind: str, name: str) -> Column | None:
        h = f"__{kind}_{name}"
        if self.columns is not None:
            return self.columns.get(h)
        return F.col(h) if self.frame.df is not None and h in self.frame.df.columns else None

    def datatype(self, v: Value) -> Column:
        """The datatype of each term; null where it can't be told."""
        if v.dt is not None:
            return v.dt
        if v.info.kind == "iri":
            return F.when(v.col.isNotNull(), F.lit("@id"))
        return F.when(v.col.isNotNull(), F.lit(v.info.dt or xsd_of(self.type(v))))

    def col(self, e) -> Column:
        """The value as shown: IRIs in full."""
        v = self.value(e)
        return shown(v.col, v.info)

    def condition(self, e) -> Column:
        """The effective boolean value."""
        v = self.value(e)
        if isinstance(e, (Var, Lit, Agg)) or isinstance(e, Call) and e.name in ("coalesce", "if"):
            kind = self.type(v)
            if kind == "string":
                return F.char_length(v.col) > 0
            if kind.startswith(NUMERIC):
                return (v.col != 0) & ~F.isnan(v.col.cast("double"))
        return v.col

    def value(self, e) -> Value:
        if isinstance(e, Var):
            return self.var(e.name)
        if isinstance(e, Iri):
            return Value(F.lit(e.value), Info("iri"))
        if isinstance(e, Lit):
            return Value(literal(e), Info("lit", dt=e.dt), F.lit(RDF + "langString") if e.lang else None, F.lit(e.lang) if e.lang else None)
        if isinstance(e, Each):
            return self.each(e)
        if isinstance(e, Agg):
            raise ValueError("an aggregate must stand in SELECT, HAVING or ORDER BY")
        if isinstance(e, Exists):
            raise ValueError("EXISTS is resolved before")
        f = getattr(self, "f_" + e.name, None)
        if f:
            return f(*e.args)
        if e.name in ("=", "!=", "<", ">", "<=", ">="):
            return Value(self.compare(e.name, *e.args))
        if e.name in ("+", "-", "*", "/", "%"):
            return self.arithmetic(e.name, *e.args)
        if e.name in SIMPLE:
            return Value(SIMPLE[e.name](*[self.col(a) for a in e.args]))
        if e.name.startswith(XSD) and e.name[len(XSD) :] in CASTS:
            return self.cast(e.args[0], e.name[len(XSD) :])
        raise ValueError(f"unknown function {e.name}")

    # -- comparison and logic

    def compare(self, op: str, a, b) -> Column:
        x, y = self.value(a), self.value(b)
        for (p, v), other in (((a, x), y), ((b, y), x)):
            if isinstance(p, Iri) and op in ("=", "!="):
                c = is_term(other.col, other.info, p, self.type(other) if other.info.template else None)
                return c if op == "=" else ~c
        if "mixed" in (x.info.kind, y.info.kind) and x.info.kind in ("mixed", "lit", "iri") and y.info.kind in ("mixed", "lit", "iri") and all(v.dt is not None for v in (x, y) if v.info.kind == "mixed"):
            return self.terms(op, x, y)
        if op in ("=", "!=") and (x.lang is not None or y.lang is not None):  # tags are part of terms
            tag = lambda v: F.lower(v.lang) if v.lang is not None else F.lit(None).cast("string")
            c = (x.col.cast("string") == y.col.cast("string")) & tag(x).eqNullSafe(tag(y))
            return c if op == "=" else ~c
        if isinstance(b, Lit) and x.info.kind == "mixed":
            x = Value(x.col.try_cast(_plain(b)), Info())
        elif isinstance(a, Lit) and y.info.kind == "mixed":
            y = Value(y.col.try_cast(_plain(a)), Info())
        if op in ("=", "!="):
            c = same(x.col, x.info, y.col, y.info)
            kinds = (self.type(x), self.type(y))
            if all(kinds) and not _comparable(*kinds):
                c = F.when(x.col.isNotNull() & y.col.isNotNull(), F.lit(False))
            return c if op == "=" else ~c
        kinds = (self.type(x), self.type(y))
        if all(kinds) and not _comparable(*kinds):
            return F.lit(None).cast("boolean")
        p, q = shown(x.col, x.info), shown(y.col, y.info)
        return {"<": p < q, ">": p > q, "<=": p <= q, ">=": p >= q}[op]

    def terms(self, op: str, x: Value, y: Value) -> Column:
        """Terms of any kind: numbers and times by value, other terms by spelling, datatype and
        tag; in an order only numbers, times, strings and booleans stand, each among themselves."""
        p, q, s, t = shown(x.col, x.info).cast("string"), shown(y.col, y.info).cast("string"), self.datatype(x), self.datatype(y)
        m, n, u, v = number_of(p, s), number_of(q, t), time_of(p, s), time_of(q, t)
        tag = lambda z: F.lower(z.lang) if z.lang is not None else F.lit(None).cast("string")
        if op in ("=", "!="):
            c = F.when(m.isNotNull() & n.isNotNull(), m == n).when(u.isNotNull() & v.isNotNull(), u == v).otherwise((p == q) & s.eqNullSafe(t) & tag(x).eqNullSafe(tag(y)))
            c = F.when(p.isNotNull() & q.isNotNull(), c)
            return c if op == "=" else ~c
        by = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}[op]
        plain = (s == t) & s.isin(XSD + "string", XSD + "boolean")
        return F.when(m.isNotNull() & n.isNotNull(), by(m, n)).when(u.isNotNull() & v.isNotNull(), by(u, v)).when(plain, by(p, q))

    def order(self, e) -> Column:
        """What an expression is sorted by."""
        v = self.value(e)
        if v.info.kind == "mixed" and v.dt is not None:
            return order_key(v.col, v.dt, v.lang)
        return shown(v.col, v.info)

    def f_and(self, a, b) -> Value:
        return Value(self.condition(a) & self.condition(b))

    def f_or(self, a, b) -> Value:
        return Value(self.condition(a) | self.condition(b))

    def f_xor(self, a, b) -> Value:
        p, q = (F.coalesce(self.condition(x), F.lit(False)) for x in (a, b))
        return Value(p != q)

    def f_not(self, a) -> Value:
        return Value(~self.condition(a))

    def f_in(self, a, *items) -> Value:
        x = self.value(a)
        if items and x.info.kind == "iri" and not x.info.template and not x.info.row and all(isinstance(i, Iri) for i in items):
            return Value(x.col.isin([i.value for i in items]))
        out = F.lit(False)
        for i in items:
            out = out | F.coalesce(self.compare("=", a, i), F.lit(False))
        return Value(out)

    def f_notin(self, a, *items) -> Value:
        return Value(~self.f_in(a, *items).col)

    def f_inlist(self, a, items) -> Value:
        return Value(F.array_contains(self.value(items).col, self.col(a)))

    def f_if(self, c, a, b) -> Value:
        x, y = self.value(a), self.value(b)
        if "mixed" in (x.info.kind, y.info.kind) or x.lang is not None or y.lang is not None or {x.info.kind, y.info.kind} == {"iri", "lit"} and self.frame.df is not None:
            cond, (p, q) = self.condition(c), (shown(v.col, v.info).cast("string") for v in (x, y))
            tag = lambda v: v.lang if v.lang is not None else F.lit(None).cast("string")
            pick = lambda m, n: F.when(cond, m).when(~cond, n)
            return Value(pick(p, q), Info("mixed"), pick(self.datatype(x), self.datatype(y)), pick(tag(x), tag(y)))
        keep = x.info if (x.info.template, x.info.kind) == (y.info.template, y.info.kind) else None
        p, q = (x.col, y.col) if keep else (shown(x.col, x.info), shown(y.col, y.info))
        cond = self.condition(c)
        return Value(F.when(cond, p).when(~cond, q), keep)

    def f_coalesce(self, *args) -> Value:
        vs = [self.value(a) for a in args]
        alike = len({(v.info.template, v.info.kind) for v in vs}) == 1
        return Value(F.coalesce(*[v.col if alike else shown(v.col, v.info) for v in vs]), vs[0].info if alike else None)

    def f_bound(self, a) -> Value:
        return Value(self.value(a).col.isNotNull())

    # -- arithmetic

    def arithmetic(self, op: str, a, b) -> Value:
        x, y = (Value(number_of(v.col, v.dt)) if v.info.kind == "mixed" and v.dt is not None else v for v in (self.value(a), self.value(b)))
        p, q = x.col, y.col
        if op == "/":
            kinds = (self.type(x), self.type(y))
            if not any(k in ("double", "float") for k in kinds):  # exact: never truncates
                p, q = p.try_cast("decimal(20,0)" if _whole(kinds[0]) else "decimal(28,8)"), q.try_cast("decimal(20,0)" if _whole(kinds[1]) else "decimal(28,8)")
            return Value(F.try_divide(p, q))
        if op == "+" and "string" in (self.type(x), self.type(y)):
            return Value(F.concat(p.cast("string"), q.cast("string")))
        if op == "+" and self.type(x).startswith("array"):
            return Value(F.concat(p, q), Info("list"))
        return Value({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": F.try_mod}[op](p, q))

    def f_neg(self, a) -> Value:
        return Value(-self.value(a).col)

    def f_round(self, a) -> Value:
        return self._like(a, S.round_half_up)

    def f_ceil(self, a) -> Value:
        return self._like(a, F.ceil)

    def f_floor(self, a) -> Value:
        return self._like(a, F.floor)

    def _like(self, a, f) -> Value:
        v = self.value(a)
        kind = self.type(v)
        return Value(f(v.col).cast(kind) if kind else f(v.col))

    # -- strings

    def f_str(self, a) -> Value:
        return Value(self.col(a).cast("string"))

    def _constant(self, e) -> str:
        if not isinstance(e, Lit):
            raise ValueError("patterns and flags must be constants")
        return e.value

    def f_regex(self, s, pattern, flags=Lit("")) -> Value:
        p, fl = self._constant(pattern), self._constant(flags)
        col = self.col(s).cast("string")
        if not fl and p.startswith("^") and p[1:].replace(" ", "").isalnum():
            return Value(col.startswith(p[1:]))  # reaches the scan's statistics
        return Value(col.rlike(S.regex_pattern(p, fl)))

    def f_replace(self, s, pattern, by, flags=Lit("")) -> Value:
        import re

        to = re.sub(r"\$(\d)", r"$\1", self._constant(by))
        return Value(F.regexp_replace(self.col(s), S.regex_pattern(self._constant(pattern), self._constant(flags)), to))

    def f_substr(self, s, start, size=None) -> Value:
        c = self.col(s)
        return Value(F.substring(c, self.col(start).cast("int"), self.col(size).cast("int") if size is not None else F.char_length(c)))

    def f_split(self, s, by) -> Value:
        return Value(F.split(self.col(s), F.concat(F.lit("\\Q"), self.col(by), F.lit("\\E")), F.lit(-1)), Info("list"))

    def f_lang(self, a) -> Value:
        v = self.value(a)
        if v.info.kind == "iri":
            return Value(F.lit(None).cast("string"))
        literal_ = v.dt != "@id" if v.info.kind == "mixed" and v.dt is not None else F.lit(True)
        return Value(F.when(v.col.isNotNull() & literal_, F.coalesce(v.lang, F.lit("")) if v.lang is not None else F.lit("")))

    def f_langmatches(self, tag, rng) -> Value:
        t, r = F.lower(self.col(tag)), F.lower(self.col(rng))
        return Value(F.when(r == "*", t != "").otherwise((t == r) | t.startswith(F.concat(r, F.lit("-")))))

    def f_datatype(self, a) -> Value:
        x = self.value(a)
        if x.dt is not None:
            return Value(F.when(x.col.isNotNull() & (x.dt != "@id"), x.dt), Info("iri"))
        if x.info.kind == "iri":
            return Value(F.lit(None).cast("string"), Info("iri"))
        return Value(F.when(x.col.isNotNull(), F.lit(x.info.dt or xsd_of(self.type(x)))), Info("iri"))

    def f_strdt(self, a, dt) -> Value:
        kind = dt.value[len(XSD) :] if isinstance(dt, Iri) and dt.value.startswith(XSD) else "string"
        return self.cast(a, kind)

    def f_strlang(self, a, tag) -> Value:
        return Value(self.col(a).cast("string"), Info("lit", dt=RDF + "langString"), F.lit(RDF + "langString"), self.col(tag))

    def _tagged(self, a, f) -> Value:
        """A string made of another, whose tag it keeps."""
        v = self.value(a)
        return Value(f(shown(v.col, v.info).cast("string")), Info("lit", dt=v.info.dt if v.lang is not None else None), v.dt if v.lang is not None else None, v.lang)

    def f_ucase(self, a) -> Value:
        return self._tagged(a, F.upper)

    def f_lcase(self, a) -> Value:
        return self._tagged(a, F.lower)

    def f_isiri(self, a) -> Value:
        return self._kind(a, "iri")

    f_isuri = f_isiri

    def f_isliteral(self, a) -> Value:
        return self._kind(a, "lit")

    def f_isblank(self, a) -> Value:
        v = self.value(a)
        blank = v.col.startswith("_:") & (v.dt == "@id" if v.dt is not None else F.lit(True)) if v.info.kind == "mixed" or v.info.kind == "iri" and not v.info.template and not v.info.row else F.lit(v.info.row)
        return Value(F.when(v.col.isNotNull(), blank))

    def f_isnumeric(self, a) -> Value:
        v = self.value(a)
        if v.info.kind == "mixed" and v.dt is not None:
            return Value(F.when(v.col.isNotNull(), number_of(v.col, v.dt).isNotNull()))
        return Value(F.when(v.col.isNotNull(), F.lit(v.info.kind == "lit" and self.type(v).startswith(NUMERIC))))

    def _kind(self, a, kind: str) -> Value:
        v = self.value(a)
        if v.info.kind == "mixed" and v.dt is not None:
            iri = v.dt == "@id"
            return Value(F.when(v.col.isNotNull(), iri & ~v.col.startswith("_:") if kind == "iri" else ~iri))
        if v.info.kind == kind == "iri" and not v.info.template and not v.info.row:  # of names, or blank
            return Value(F.when(v.col.isNotNull(), ~v.col.startswith("_:")))
        return Value(F.when(v.col.isNotNull(), F.lit((v.info.kind == kind or kind == "lit" and v.info.kind == "mixed") and not v.info.row)))

    def f_sameterm(self, a, b) -> Value:
        """Alike in spelling, datatype and tag: 1 and 1.0 are equal, not the same term."""
        x, y = self.value(a), self.value(b)
        tag = lambda v: F.lower(v.lang) if v.lang is not None else F.lit(None).cast("string")
        p, q = shown(x.col, x.info).cast("string"), shown(y.col, y.info).cast("string")
        c = (p == q) & self.datatype(x).eqNullSafe(self.datatype(y)) & tag(x).eqNullSafe(tag(y))
        return Value(F.when(p.isNotNull() & q.isNotNull(), c))

    def f_iri(self, a) -> Value:
        return Value(self.col(a).cast("string"), Info("iri"))

    f_uri = f_iri

    def f_bnode(self, a=None) -> Value:
        return Value(F.concat(F.lit("_:"), F.uuid() if a is None else F.md5(self.col(a).cast("string"))), Info("iri"))

    def cast(self, a, kind: str) -> Value:
        v = self.value(a)
        c, was = shown(v.col, v.info), self.type(v)
        if kind in ("integer", "long", "int") and was == "string":  # "3.7" is no integer
            c = F.when(F.trim(c).rlike(r"^[+-]?\d+$"), c)
        if kind == "decimal" and was == "string":  # nor has a decimal an exponent
            c = F.when(~F.lower(c).contains("e"), c)
        if kind == "boolean" and was == "string":
            c = F.when(c.isin("true", "1"), F.lit(True)).when(c.isin("false", "0"), F.lit(False))
        if kind == "time":
            return Value(F.when(c.cast("string").rlike(r"^\d\d:\d\d:\d\d"), c.cast("string")), Info("lit", dt=XSD + "time"))
        return Value(c.try_cast(CASTS[kind]), Info("lit", dt=XSD + kind))

    def f_seconds(self, a) -> Value:
        return Value(F.date_part(F.lit("SECOND"), self.col(a).cast("timestamp")))

    def f_tz(self, a) -> Value:
        c = self.col(a)
        return Value(F.coalesce(F.when(c.cast("string").rlike("Z$"), F.lit("Z")).otherwise(F.regexp_extract(c.cast("string"), r"([+-]\d\d:\d\d)$", 1)), F.lit("")))

    def f_timezone(self, a) -> Value:
        z = self.f_tz(a).col
        part = lambda i: F.regexp_extract(z, r"([+-])0?(\d+):(\d\d)", i)
        made = F.concat(F.when(part(1) == "-", F.lit("-")).otherwise(F.lit("")), F.lit("PT"), part(2), F.lit("H"), F.when(part(3) != "00", F.concat(part(3), F.lit("M"))).otherwise(F.lit("")))
        return Value(F.when(z == "Z", F.lit("PT0S")).when(z != "", made))

    # -- lists and maps

    def f_list(self, *items) -> Value:
        return Value(F.array(*[self.col(i) for i in items]), Info("list"))

    def f_map(self, *items) -> Value:
        return Value(F.struct(*[self.col(v).alias(k.value) for k, v in zip(items[::2], items[1::2])]), Info("map"))

    def f_member(self, a, name) -> Value:
        return Value(self.value(a).col[name.value])

    def f_sorted(self, a) -> Value:
        c = self.value(a).col
        return Value(F.coalesce(F.array_sort(c), F.array().cast("array<string>")), Info("list"))

    def f_mapof(self, a) -> Value:
        """A map of a list of structs (key, value)."""
        c = self.value(a).col
        return Value(F.coalesce(F.map_from_entries(F.array_sort(c)), F.create_map().cast("map<string,string>")), Info("map"))

    def f_bm25(self, text, words, idf, mean) -> Value:
        """The score of a text by statistics of its corpus; null of what is no string."""
        from ..operators.search import B, K1, terms, times

        v = self.value(text)
        string = v.dt.isin(XSD + "string", RDF + "langString") if v.dt is not None else F.lit(v.info.kind != "iri")
        t = terms(shown(v.col, v.info).cast("string"))
        norm = K1 * (1 - B + B * F.size(t) / F.lit(mean.value))
        tf = [times(t, w) for w in words.value]
        score = F.lit(0.0)
        for n, w in zip(tf, idf.value):
            score = score + F.lit(w) * n * (K1 + 1) / (n + norm)
        return Value(F.when(v.col.isNotNull() & string, score), Info("lit", dt=XSD + "double"))

    def f_size(self, a) -> Value:
        v = self.value(a)
        return Value((F.char_length(v.col) if self.type(v) == "string" else F.when(v.col.isNotNull(), F.size(v.col))).cast("bigint"))

    def f_reverse(self, a) -> Value:
        v = self.value(a)
        return Value(F.reverse(v.col), v.info)

    def f_head(self, a) -> Value:
        return Value(F.try_element_at(self.value(a).col, F.lit(1)))

    def f_last(self, a) -> Value:
        return Value(F.try_element_at(self.value(a).col, F.lit(-1)))

    def f_tail(self, a) -> Value:
        c = self.value(a).col
        return Value(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), Info("list"))

    def f_index(self, a, i) -> Value:
        c, at = self.value(a).col, self.col(i).cast("int")
        return Value(F.get(c, F.when(at < 0, F.size(c) + at).otherwise(at)))

    def f_slice(self, a, low, high) -> Value:
        c = self.value(a).col
        lo = self.col(low).cast("int") if low is not None else F.lit(0)
        hi = self.col(high).cast("int") if high is not None else F.size(c)
        return Value(F.slice(c, lo + 1, F.greatest(hi - lo, F.lit(0))), Info("list"))

    def f_range(self, a, b, step=Lit(1)) -> Value:
        return Value(S.sequence(*[self.col(x).cast("bigint") for x in (a, b, step)]), Info("list"))

    def each(self, e: Each) -> Value:
        items = self.value(e.items).col

        def with_(**names):
            old = dict(self.local)
            self.local.update({k: Value(v) for k, v in names.items()})
            return old

        def pred(x):
            old = with_(**{e.var: x})
            c = F.coalesce(self.value(e.where).col, F.lit(False))
            self.local = old
            return c

        def out(x):
            old = with_(**{e.var: x})
            c = self.value(e.value).col
            self.local = old
            return c

        if e.kind == "map":
            c = F.filter(items, pred) if e.where is not None else items
            return Value(F.transform(c, out) if e.value is not None else c, Info("list"))
        if e.kind == "reduce":

            def step(acc, x):
                old = with_(**{e.acc: acc, e.var: x})
                c = self.value(e.value).col
                self.local = old
                return c

            return Value(F.aggregate(items, self.value(e.start).col, step))
        if e.kind == "all":
            return Value(F.forall(items, pred))
        if e.kind == "any":
            return Value(F.exists(items, pred))
        n = F.size(F.filter(items, pred))
        return Value(F.when(items.isNotNull(), n == (0 if e.kind == "none" else 1)))

    # -- paths

    def f_rel(self, a, kind, b) -> Value:
        return Value(F.struct(self.col(a).cast("string").alias("start"), self.col(kind).alias("type"), self.col(b).cast("string").alias("end")), Info("rel"))

    def f_nodes(self, a) -> Value:
        return Value(self.value(a).col["nodes"], Info("list"))

    def f_relationships(self, a) -> Value:
        return Value(self.value(a).col["edges"], Info("list"))

    def f_length(self, a) -> Value:
        v = self.value(a)
        if v.info.kind == "path":
            return Value((F.size(v.col["nodes"]) - 1).cast("bigint"))
        return self.f_size(a)

    def f_type(self, a) -> Value:
        return Value(self.value(a).col["type"])

    def f_startnode(self, a) -> Value:
        return Value(self.value(a).col["start"], Info("iri"))

    def f_endnode(self, a) -> Value:
        return Value(self.value(a).col["end"], Info("iri"))


def _whole(kind: str) -> bool:
    return kind in ("bigint", "int", "smallint", "tinyint")


def _plain(x: Lit) -> str:
    if isinstance(x.value, bool):
        return "boolean"
    if isinstance(x.value, str):
        return CASTS.get((x.dt or "").rpartition("#")[2], "string")
    return "double"


def _class(kind: str) -> str:
    if kind.startswith(NUMERIC):
        return "number"
    return "time" if kind in ("date", "timestamp", "timestamp_ntz") else kind


def _comparable(a: str, b: str) -> bool:
    return _class(a) == _class(b) or "void" in (a, b)


SIMPLE = {
    "strlen": lambda s: F.char_length(s).cast("bigint"), "upper": F.upper, "lower": F.lower, "toupper": F.upper, "tolower": F.lower,
    "contains": lambda a, b: a.contains(b), "strstarts": lambda a, b: a.startswith(b), "strends": lambda a, b: a.endswith(b), "startswith": lambda a, b: a.startswith(b), "endswith": lambda a, b: a.endswith(b),
    "concat": lambda *a: F.concat(*[x.cast("string") for x in a]), "strbefore": S.before, "strafter": S.after, "encode_for_uri": S.encode_for_uri, "encodeforuri": S.encode_for_uri,
    "replaceall": lambda s, a, b: F.replace(s, a, b), "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "left": F.left, "right": F.right,
    "substring0": lambda s, a, n=None: F.substring(s, a.cast("int") + 1, n.cast("int") if n is not None else F.char_length(s)),
    "abs": F.abs, "rand": lambda: F.rand(), "sqrt": F.sqrt, "sign": lambda x: F.signum(x).cast("bigint"), "ln": F.ln, "log": F.ln, "pow": F.pow, "power": F.pow,
    "now": F.current_timestamp, "today": F.current_date, "year": F.year, "month": F.month, "day": F.day, "hours": F.hour, "minutes": F.minute,
    "md5": lambda s: F.md5(s.cast("binary")), "sha1": lambda s: F.sha1(s.cast("binary")), "sha256": lambda s: F.sha2(s.cast("binary"), 256), "sha384": lambda s: F.sha2(s.cast("binary"), 384), "sha512": lambda s: F.sha2(s.cast("binary"), 512),
    "uuid": lambda: F.concat(F.lit("urn:uuid:"), F.uuid()), "struuid": F.uuid,
    "dotproduct": S.dot, "cosinesimilarity": S.cosine, "euclideandistance": S.euclidean, "geodistance": S.haversine,
    "tointeger": lambda x: x.try_cast("double").cast("bigint"), "tofloat": lambda x: x.try_cast("double"), "tostring": lambda x: x.cast("string"), "toboolean": lambda x: x.try_cast("boolean"),
    "keys": lambda m: F.map_keys(m), "isnull": lambda x: x.isNull(), "isnotnull": lambda x: x.isNotNull(),
}
