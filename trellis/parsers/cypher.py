"""openCypher reading clauses to the common representation.

Labels are classes, relationship types and properties are predicates of one vocabulary.
Property access becomes an optional pattern; WITH a subquery.
"""

from __future__ import annotations

import re
from decimal import Decimal

from ..ir import TYPE, XSD, Agg, Bind, Call, Choice, Each, Exists, Filter, Group, Inverse, Iri, Lit, Optional, Query, Repeat, Shortest, Sub, Triple, Union, Unwind, Var

TOKEN = re.compile(
    r"\s+|//[^\n]*|/\*.*?\*/|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<param>\$\w+)"
    r"|(?P<word>[A-Za-z_]\w*|`[^`]+`)|(?P<op><>|<=|>=|=~|\.\.|\+=|[-+*/%^=<>(){}\[\],.:|;])",
    re.S,
)
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "stdevp", "variance", "median"}
NAMES = {
    "tolower": "lcase", "toupper": "ucase", "lower": "lcase", "upper": "ucase", "substring": "substring0", "replace": "replaceall", "split": "split", "trim": "trim", "ltrim": "ltrim", "rtrim": "rtrim",
    "left": "left", "right": "right", "abs": "abs", "ceil": "ceil", "floor": "floor", "round": "round", "rand": "rand", "sqrt": "sqrt", "sign": "sign", "log": "ln", "head": "head", "last": "last", "tail": "tail",
    "reverse": "reverse", "range": "range", "size": "size", "length": "length", "nodes": "nodes", "relationships": "relationships", "coalesce": "coalesce", "tointeger": "tointeger", "tofloat": "tofloat",
    "tostring": "tostring", "toboolean": "toboolean", "date": "date", "datetime": "datetime", "type": "type", "startnode": "startnode", "endnode": "endnode", "id": "str", "char_length": "strlen",
}


class Parser:
    def __init__(self, text: str, vocab: str, params: dict | None = None):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.vocab, self.params, self.fresh = 0, vocab, params or {}, 0
        self.parts: list = []
        self.nodes: set[str] = set()
        self.rels: dict[str, tuple] = {}
        self.props: dict[tuple[str, str], str] = {}
        self.local: list[str] = []
        self.needed = False  # whether a property access must have a value

    # -- tokens

    def peek(self, n: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + n] if self.at + n < len(self.tokens) else ("end", "")

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def is_word(self, *words: str) -> bool:
        kind, t = self.peek()
        return kind == "word" and t.upper() in words

    def word(self, *words: str) -> str | None:
        return self.next().upper() if self.is_word(*words) else None

    def op(self, *ops: str) -> str | None:
        return self.next() if self.peek()[0] == "op" and self.peek()[1] in ops else None

    def need(self, *ops: str) -> str:
        got = self.op(*ops)
        if not got:
            raise ValueError(f"expected {ops}, got {self.peek()[1]!r}")
        return got

    def name(self) -> str:
        return self.next().strip("`")

    def new(self, p: str = "_c") -> str:
        self.fresh += 1
        return f"{p}{self.fresh}"

    def iri(self, name: str) -> Iri:
        return Iri(self.vocab + name)

    # -- clauses

    def query(self) -> Query:
        q = self.single()
        while self.word("UNION"):
            every = bool(self.word("ALL"))
            other = self.single()
            last = q
            while last.union:
                last = last.union[0]
            last.union = (other, every)
        self.op(";")
        if self.peek()[0] != "end":
            raise ValueError(f"unexpected {self.peek()[1]!r}")
        return q

    def single(self, outer: list[str] | None = None) -> Query:
        keep = (self.parts, self.nodes, self.rels, self.props)
        self.parts, self.nodes, self.rels, self.props = [], set(outer or ()), {}, {}
        try:
            while True:
                if self.word("MATCH"):
                    self.match()
                elif self.is_word("OPTIONAL"):
                    self.next()
                    self.word("MATCH")
                    outside, self.parts = self.parts, []
                    self.match()
                    inner, self.parts = self.parts, outside
                    self.parts.append(Optional(Group(tuple(inner))))
                elif self.word("UNWIND"):
                    e = self.expr()
                    self.word("AS")
                    self.parts.append(Unwind(e, self.name()))
                elif self.word("CALL"):
                    self.call()
                elif self.word("WITH"):
                    q = self.projection()
                    if self.word("WHERE"):
                        names = [n for _, n in q.select]
                        self._pass(q, names)
                        self.where()
                    else:
                        self._pass(q, [n for _, n in q.select])
                elif self.word("RETURN"):
                    return self.projection()
                else:
                    raise ValueError(f"unexpected {self.peek()[1]!r}")
        finally:
            self.parts, self.nodes, self.rels, self.props = keep

    def _pass(self, q: Query, names: list[str]) -> None:
        self.parts = [Sub(q)]
        self.nodes &= {n for e, n in q.select if isinstance(e, Var)} | {n for e, n in q.select}
        self.props = {}

    def call(self) -> None:
        """CALL (vars) { subquery }: run for each row's values of vars; or CALL of a procedure."""
        seen: list[str] = []
        if self.peek()[0] == "word":
            self.procedure()
            return
        if self.op("("):
            while not self.op(")"):
                seen.append(self.name())
                self.op(",")
        self.need("{")
        q = self.single(seen)
        if self.word("UNION"):
            every = bool(self.word("ALL"))
            q.union = (self.single(seen), every)
        self.need("}")
        self.parts.append(Sub(q, tuple(seen) if seen else None))

    def procedure(self) -> None:
        """db.labels(), db.relationshipTypes(), db.propertyKeys(), with YIELD column AS name."""
        name = self.name()
        while self.op("."):
            name += "." + self.name()
        if self.op("("):
            self.need(")")
        s, p, o, x = (Var(self.new("_q")) for _ in range(4))
        relation = [Triple(s, p, o), Filter(Call("isiri", (o,))), Filter(Call("!=", (p, Iri(TYPE))))]
        known = {
            "db.labels": ("label", o, [Triple(s, Iri(TYPE), o)]),
            "db.relationshiptypes": ("relationshipType", p, relation),
            "db.propertykeys": ("propertyKey", p, [Triple(s, p, o), Filter(Call("isliteral", (o,)))]),
        }
        if name.lower() not in known:
            raise ValueError(f"unknown procedure {name}")
        column, term, parts = known[name.lower()]
        if self.word("YIELD"):
            if self.name() != column:
                raise ValueError(f"{name} yields {column}")
            column = self.name() if self.word("AS") else column
        inner = Query(Group((*parts, Bind(self._local(term), x.name))), [(x, column)], distinct=True)
        self.parts.append(Sub(inner))

    def _local(self, term: Var) -> Call:
        """The name of an IRI in the vocabulary."""
        return Call("replaceall", (Call("str", (term,)), Lit(self.vocab, XSD + "string"), Lit("", XSD + "string"))) if self.vocab else Call("str", (term,))

    def catalogue(self, what: str, n: Var) -> Call:
        """labels(n), keys(n) and properties(n): an optional subquery for each node."""
        p, o, k, v, x = (Var(self.new("_q")) for _ in range(5))
        by = [(n, n.name)]
        if what == "labels":
            inner = Query(Group((Triple(n, Iri(TYPE), o), Bind(self._local(o), k.name))), [(n, n.name), (Agg("collect", k, True), x.name)], group=by)
            empty: Call = Call("list", ())
        else:
            one = Query(Group((Triple(n, p, o), Filter(Call("isliteral", (o,))), Bind(self._local(p), k.name))), [(n, n.name), (k, k.name), (Agg("min", o), v.name)], group=[*by, (k, k.name)])
            item = k if what == "keys" else Call("map", (Lit("key"), k, Lit("value"), Call("str", (v,))))
            inner = Query(Group((Sub(one),)), [(n, n.name), (Agg("collect", item, True), x.name)], group=by)
            empty = Call("list", ())
        self.parts.append(Optional(Group((Sub(inner),))))
        return Call("mapof", (x,)) if what == "properties" else Call("sorted", (x,))

    def match(self) -> None:
        while True:
            self.pattern()
            if not self.op(","):
                break
        if self.word("WHERE"):
            self.where()

    def where(self) -> None:
        # accesses in a conjunct that is a comparison must have a value: plain patterns
        start = self.at
        e = self.expr()
        if all(_rejects_null(c) for c in _conjuncts(e)):
            end = self.at
            self.at, self.needed = start, True
            self._forget(start, end)
            e = self.expr()
            self.needed = False
        self.parts.append(Filter(e))

    def _forget(self, start: int, end: int) -> None:
        """Takes back the optional patterns that the first reading of a condition added."""
        while self.parts and isinstance(self.parts[-1], Optional) and getattr(self, "_added", None) and self.parts[-1] in self._added:
            gone = self.parts.pop()
            t = gone.group.parts[0]
            self.props = {k: v for k, v in self.props.items() if v != t.o.name}

    def projection(self) -> Query:
        distinct = bool(self.word("DISTINCT"))
        items: list = []
        if self.op("*"):
            items = None
        else:
            while True:
                start = self.at
                e = self.expr()
                text = "".join(t for _, t in self.tokens[start : self.at])
                items.append((e, self.name() if self.word("AS") else text if isinstance(e, Var) and e.name == text else text.replace(".", "_") if re.fullmatch(r"[\w.]+", text) else text))
                if not self.op(","):
                    break
        if items is None:
            from ..ir import variables

            items = [(Var(v), v) for v in variables(self.parts) if not v.startswith("_")]
        q = Query(Group(()), items, distinct=distinct)
        if any(_has_agg(e) for e, _ in items):
            q.group = [(e, n) for e, n in items if not _has_agg(e)]
            q.select = [(e if _has_agg(e) else Var(n), n) for e, n in items]
            if not q.group:
                q.group = None
        if self.word("ORDER"):
            self.word("BY")
            while True:
                e = self.expr()
                names = {x: n for x, n in items if not isinstance(x, Var)}
                e = Var(names[e]) if e in names else e
                q.order.append((e, bool(self.word("DESC", "DESCENDING"))))
                self.word("ASC", "ASCENDING")
                if not self.op(","):
                    break
        if self.word("SKIP"):
            q.offset = int(self.next())
        if self.word("LIMIT"):
            q.limit = int(self.next())
        q.where = Group(tuple(self.parts))
        return q

    # -- patterns

    def pattern(self) -> None:
        path = None
        if self.peek()[0] == "word" and self.peek(1) == ("op", "="):
            path = self.name()
            self.next()
        if self.is_word("SHORTESTPATH", "ALLSHORTESTPATHS"):
            mode = "single" if self.next().lower() == "shortestpath" else "all"
            self.need("(")
            s = self.node()
            rel, types, direction, low, high, _ = self.relationship()
            o = self.node()
            self.need(")")
            self.parts.append(Shortest(Var(s), Var(o), tuple(self.vocab + t for t in types), path or self.new(), mode, direction, low if low is not None else 1, high))
            return
        a = self.node()
        steps, first = 0, a
        while self.peek()[1] in ("-", "<") and self.peek()[0] == "op":
            rel, types, direction, low, high, props = self.relationship()
            b = self.node()
            steps += 1
            if path and (low, high) != (None, None):
                self.parts.append(Shortest(Var(a), Var(b), tuple(self.vocab + t for t in types), path, "trails", direction, low, high))
            elif (low, high) != (None, None):
                p = _choice([self.iri(t) for t in types])
                if direction == "either":
                    p = Choice((p, Inverse(p)))
                s, o = (b, a) if direction == "in" else (a, b)
                self.parts.append(Triple(Var(s), Repeat(p, low, high), Var(o)))
            else:
                self._edge(a, b, rel, types, direction)
            a = b
        if steps == 0 and first not in self.nodes_bound():
            self.parts.append(Sub(Query(Group((Triple(Var(first), Var("_p"), Var("_o")),)), [(Var(first), first)], distinct=True)))

    def nodes_bound(self) -> set[str]:
        from ..ir import variables

        return set(variables(self.parts)) | self.nodes_outer()

    def nodes_outer(self) -> set[str]:
        return set()

    def _edge(self, a: str, b: str, rel: str | None, types: list[str], direction: str) -> None:
        ends = [(a, b)] if direction == "out" else [(b, a)] if direction == "in" else [(a, b), (b, a)]
        if types and len(types) == 1 and len(ends) == 1:
            s, o = ends[0]
            self.parts.append(Triple(Var(s), self.iri(types[0]), Var(o)))
            if rel:
                self.parts.append(Bind(Call("rel", (Var(s), Lit(types[0]), Var(o))), rel))
            return
        groups = []
        for s, o in ends:
            for t in types or [None]:
                if t is None:
                    g = [Triple(Var(s), Var(f"_p_{rel or b}"), Var(o)), Filter(Call("isiri", (Var(o),)))]
                else:
                    g = [Triple(Var(s), self.iri(t), Var(o))]
                if rel:
                    g.append(Bind(Call("rel", (Var(s), Lit(t or ""), Var(o))), rel))
                groups.append(Group(tuple(g)))
        self.parts.append(Union(tuple(groups)) if len(groups) > 1 else groups[0])

    def node(self) -> str:
        self.need("(")
        n = self.name() if self.peek()[0] == "word" else self.new("_n")
        self.nodes.add(n)
        while self.op(":"):
            self.parts.append(Triple(Var(n), Iri(TYPE), self.iri(self.name())))
        if self.op("{"):
            while not self.op("}"):
                k = self.name()
                self.need(":")
                v = self.expr()
                if isinstance(v, (Lit, Iri)):
                    self.parts.append(Triple(Var(n), self.iri(k), v))
                else:
                    x = self.new()
                    self.parts += [Triple(Var(n), self.iri(k), Var(x)), Filter(Call("=", (Var(x), v)))]
                self.op(",")
        self.need(")")
        return n

    def relationship(self):
        back = bool(self.op("<"))
        self.need("-")
        rel, types, low, high = None, [], None, None
        if self.op("["):
            if self.peek()[0] == "word":
                rel = self.name()
            if self.op(":"):
                while True:
                    types.append(self.name())
                    if not self.op("|"):
                        break
                    self.op(":")
            if self.op("*"):
                low, high = 1, None
                if self.peek()[0] == "num":
                    n = self.next()
                    low = high = int(n)
                if self.op(".."):
                    high = int(self.next()) if self.peek()[0] == "num" else None
            self.need("]")
        self.need("-")
        forth = bool(self.op(">"))
        direction = "in" if back and not forth else "out" if forth and not back else "either"
        return rel, types, direction, low, high, None

    # -- expressions

    def expr(self):
        e = self.xor()
        while self.word("OR"):
            e = Call("or", (e, self.xor()))
        return e

    def xor(self):
        e = self.conjunction()
        while self.word("XOR"):
            e = Call("xor", (e, self.conjunction()))
        return e

    def conjunction(self):
        e = self.negation()
        while self.word("AND"):
            e = Call("and", (e, self.negation()))
        return e

    def negation(self):
        if self.word("NOT"):
            return Call("not", (self.negation(),))
        return self.relation()

    def relation(self):
        e = self.sum()
        while True:
            if o := self.op("=", "<>", "<=", ">=", "<", ">"):
                e = Call("!=" if o == "<>" else o, (e, self.sum()))
            elif self.op("=~"):
                p = self.sum()
                e = Call("regex", (e, Lit(f"^(?:{p.value})$")))
            elif self.word("IN"):
                r = self.sum()
                e = Call("in", (e, *r.args)) if isinstance(r, Call) and r.name == "list" else Call("inlist", (e, r))
            elif self.word("STARTS"):
                self.word("WITH")
                e = Call("strstarts", (e, self.sum()))
            elif self.word("ENDS"):
                self.word("WITH")
                e = Call("strends", (e, self.sum()))
            elif self.word("CONTAINS"):
                e = Call("contains", (e, self.sum()))
            elif self.word("IS"):
                no = bool(self.word("NOT"))
                self.word("NULL")
                e = Call("isnotnull" if no else "isnull", (e,))
            else:
                return e

    def sum(self):
        e = self.product()
        while o := self.op("+", "-"):
            e = Call(o, (e, self.product()))
        return e

    def product(self):
        e = self.power()
        while o := self.op("*", "/", "%"):
            e = Call(o, (e, self.power()))
        return e

    def power(self):
        e = self.unary()
        while self.op("^"):
            e = Call("pow", (e, self.unary()))
        return e

    def unary(self):
        if self.op("-"):
            return Call("neg", (self.unary(),))
        self.op("+")
        return self.postfix()

    def postfix(self):
        e = self.atom()
        while True:
            if self.peek() == ("op", ".") and self.peek(1)[0] == "word":
                self.next()
                e = self.access(e, self.name())
            elif self.op("["):
                low = None if self.peek() == ("op", "..") else self.expr()
                if self.op(".."):
                    high = None if self.peek() == ("op", "]") else self.expr()
                    e = Call("slice", (e, low, high))
                else:
                    e = Call("index", (e, low))
                self.need("]")
            else:
                return e

    def access(self, e, prop: str):
        if isinstance(e, Var) and e.name in self.nodes and e.name not in self.local:
            v = self.props.get((e.name, prop))
            if not v:
                v = self.props[e.name, prop] = f"_{e.name}_{prop}"
                t = Triple(Var(e.name), self.iri(prop), Var(v))
                if self.needed:
                    self.parts.append(t)
                else:
                    o = Optional(Group((t,)))
                    self._added = [*getattr(self, "_added", []), o]
                    self.parts.append(o)
            return Var(v)
        return Call("member", (e, Lit(prop)))

    def atom(self):
        kind, text = self.peek()
        if kind == "num":
            self.next()
            if re.fullmatch(r"\d+", text):
                return Lit(int(text), XSD + "integer")
            return Lit(float(text), XSD + "double") if "." in text or "e" in text.lower() else Lit(Decimal(text), XSD + "decimal")
        if kind == "str":
            self.next()
            return Lit(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]), XSD + "string")
        if kind == "param":
            self.next()
            return _param(self.params[text[1:]])
        if self.op("("):
            e = self.expr()
            self.need(")")
            return e
        if self.op("["):
            return self.list_()
        if self.op("{"):
            items = []
            while not self.op("}"):
                items.append(Lit(self.name()))
                self.need(":")
                items.append(self.expr())
                self.op(",")
            return Call("map", tuple(items))
        if kind != "word":
            raise ValueError(f"unexpected {text!r}")
        if self.word("TRUE"):
            return Lit(True, XSD + "boolean")
        if self.word("FALSE"):
            return Lit(False, XSD + "boolean")
        if self.word("NULL"):
            return Var("_null")
        if self.word("CASE"):
            return self.case()
        if self.is_word("EXISTS") and self.peek(1) == ("op", "{"):
            self.next()
            self.next()
            outside, self.parts = self.parts, []
            self.word("MATCH")
            self.match()
            inner, self.parts = self.parts, outside
            self.need("}")
            return Exists(Group(tuple(inner)))
        if self.is_word("ALL", "ANY", "NONE", "SINGLE") and self.peek(1) == ("op", "("):
            kind = self.next().lower()
            self.need("(")
            v = self.name()
            self.word("IN")
            items = self.expr()
            self.word("WHERE")
            self.local.append(v)
            cond = self.expr()
            self.local.pop()
            self.need(")")
            return Each(kind, v, items, cond)
        if self.is_word("REDUCE") and self.peek(1) == ("op", "("):
            self.next()
            self.need("(")
            acc = self.name()
            self.need("=")
            start = self.expr()
            self.need(",")
            v = self.name()
            self.word("IN")
            items = self.expr()
            self.need("|")
            self.local += [acc, v]
            value = self.expr()
            del self.local[-2:]
            self.need(")")
            return Each("reduce", v, items, None, value, acc, start)
        name = self.name()
        if self.op("("):
            low = name.lower()
            if low in AGGREGATES:
                distinct = bool(self.word("DISTINCT"))
                arg = None if self.op("*") else self.expr()
                self.need(")")
                return Agg({"stdevp": "stddev"}.get(low, low), arg, distinct)
            args = []
            while not self.op(")"):
                args.append(self.expr())
                self.op(",")
            if low in ("labels", "keys", "properties") and len(args) == 1 and isinstance(args[0], Var) and args[0].name in self.nodes:
                return self.catalogue(low, args[0])
            if low == "keys":
                return Call("keys", tuple(args))
            if low == "exists":
                return Call("isnotnull", tuple(args))
            if low in ("date", "datetime"):
                return Call(XSD + ("date" if low == "date" else "dateTime"), tuple(args))
            if low not in NAMES:
                raise ValueError(f"unknown function {name}")
            return Call(NAMES[low], tuple(args))
        return Var(name)

    def list_(self):
        if self.peek()[0] == "word" and self.peek(1)[1].upper() == "IN" and self.peek(1)[0] == "word":
            v = self.name()
            self.next()
            items = self.expr()
            self.local.append(v)
            cond = self.expr() if self.word("WHERE") else None
            value = self.expr() if self.op("|") else None
            self.local.pop()
            self.need("]")
            return Each("map", v, items, cond, value)
        items = []
        while not self.op("]"):
            items.append(self.expr())
            self.op(",")
        return Call("list", tuple(items))

    def case(self):
        subject = None if self.is_word("WHEN") else self.expr()
        ways = []
        while self.word("WHEN"):
            c = self.expr()
            self.word("THEN")
            ways.append((Call("=", (subject, c)) if subject is not None else c, self.expr()))
        other = self.expr() if self.word("ELSE") else Var("_null")
        self.word("END")
        for c, v in reversed(ways):
            other = Call("if", (Call("coalesce", (c, Lit(False, XSD + "boolean"))), v, other))
        return other


def _param(x):
    kinds = {bool: "boolean", int: "integer", float: "double", str: "string"}
    if isinstance(x, list):
        return Call("list", tuple(_param(y) for y in x))
    return Lit(x, XSD + kinds[type(x)])


def _choice(parts: list):
    return parts[0] if len(parts) == 1 else Choice(tuple(parts))


def _has_agg(e) -> bool:
    if isinstance(e, Agg):
        return True
    if isinstance(e, Call):
        return any(_has_agg(a) for a in e.args)
    return isinstance(e, Each) and any(_has_agg(x) for x in (e.items, e.where, e.value, e.start) if x is not None)


def _conjuncts(e) -> list:
    return [y for a in e.args for y in _conjuncts(a)] if isinstance(e, Call) and e.name == "and" else [e]


def _rejects_null(e) -> bool:
    return isinstance(e, Call) and e.name in ("=", "!=", "<", ">", "<=", ">=", "contains", "strstarts", "strends", "regex") and all(isinstance(a, (Var, Lit)) or isinstance(a, Call) and a.name in ("+", "-", "*", "/", "%") for a in e.args)


def parse(text: str, vocab: str = "", params: dict | None = None) -> Query:
    return Parser(text, vocab, params).query()
