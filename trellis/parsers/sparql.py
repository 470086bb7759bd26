"""SPARQL 1.1 text to the common representation, by recursive descent."""

from __future__ import annotations

import re
from decimal import Decimal

from ..ir import ABOUT, TYPE, XSD, Agg, Bind, Call, Choice, Exists, Filter, Group, InGraph, Inverse, Iri, Lit, Minus, NotIn, Optional, Query, Repeat, Search, Sequence, Service, Sub, Triple, Union, Values, Var  # noqa: F401

TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<str>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<var>[?$]\w+)|(?P<num>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)|(?P<bnode>_:[\w.-]*\w)"""
    r"""|(?P<pname>(?:[A-Za-z][\w-]*(?:\.[\w-]+)*)?:(?:(?:[\w:-]|%[0-9a-fA-F]{2}|\\[_~.!$&'()*+,;=/?\#@%-])(?:(?:[\w:.-]|%[0-9a-fA-F]{2}|\\[_~.!$&'()*+,;=/?\#@%-])*(?:[\w:-]|%[0-9a-fA-F]{2}))?)?)"""
    r"""|(?P<word>[A-Za-z_]\w*)|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].,;=<>!+\-*/|^?:])""",
    re.S,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT", "MEDIAN", "VARIANCE", "STDDEV", "COLLECT"}


class SyntaxError_(ValueError):
    pass


def unquote(s: str) -> str:
    body = s[3:-3] if s[:3] in ('"""', "'''") and len(s) >= 6 else s[1:-1]
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES.get(m[3], m[3]), body, flags=re.S)


def number(s: str) -> Lit:
    if "e" in s.lower():
        return Lit(float(s), XSD + "double")
    if "." in s:
        return Lit(Decimal(s), XSD + "decimal")
    return Lit(int(s), XSD + "integer")


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise SyntaxError_(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes, self.base, self.fresh = 0, dict(prefixes or {}), "", 0
        self.data = False  # whether what is read is data, not a pattern

    # -- tokens

    def peek(self, n: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + n] if self.at + n < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        got = self.peek()
        self.at += 1
        return got

    def is_word(self, *words: str) -> bool:
        kind, text = self.peek()
        return kind == "word" and text.upper() in words

    def word(self, *words: str) -> str | None:
        return self.next()[1].upper() if self.is_word(*words) else None

    def op(self, *ops: str) -> str | None:
        kind, text = self.peek()
        return self.next()[1] if kind == "op" and text in ops else None

    def need(self, op: str) -> None:
        if not self.op(op):
            raise SyntaxError_(f"expected {op!r}, got {self.peek()[1]!r}")

    def new(self) -> Var:
        self.fresh += 1
        return Var(f"_b{self.fresh}")

    # -- terms

    def iri(self) -> Iri:
        kind, text = self.next()
        if kind == "iri":
            v = text[1:-1]
            return Iri(v if ":" in v else self.base + v)
        if kind == "pname":
            p, _, local = text.partition(":")
            if p not in self.prefixes:
                raise SyntaxError_(f"unknown prefix {p!r}")
            return Iri(self.prefixes[p] + re.sub(r"\\(.)", r"\1", local))
        raise SyntaxError_(f"expected an IRI, got {text!r}")

    def literal(self) -> Lit:
        kind, text = self.next()
        if kind == "str":
            v = unquote(text)
            if self.peek()[0] == "lang":
                return Lit(v, None, self.next()[1][1:].lower())
            if self.op("^^"):
                return Lit(v, self.iri().value)
            return Lit(v, XSD + "string")
        if kind == "num":
            return number(text)
        if kind == "word" and text.lower() in ("true", "false"):
            return Lit(text.lower() == "true", XSD + "boolean")
        if kind == "op" and text in "+-" and self.peek()[0] == "num":
            n = number(self.next()[1])
            return Lit(-n.value if text == "-" else n.value, n.dt)
        raise SyntaxError_(f"expected a literal, got {text!r}")

    def term(self):
        kind, text = self.peek()
        if kind == "var":
            self.next()
            return Var(text[1:])
        if kind in ("iri", "pname"):
            return self.iri()
        if kind == "bnode":
            self.next()
            return Var("_n" + re.sub(r"\W", "_", text[2:]))
        return self.literal()

    # -- query

    def prologue(self) -> None:
        while True:
            if self.word("PREFIX"):
                name = self.next()[1]
                self.prefixes[name[:-1]] = self.next()[1][1:-1]
            elif self.word("BASE"):
                self.base = self.next()[1][1:-1]
            else:
                return

    def query(self) -> Query:
        self.prologue()
        if self.is_word("SELECT"):
            q = self.select()
        elif self.word("ASK"):
            q = Query(self._datasets_where([], []), form="ask")
        elif self.word("CONSTRUCT"):
            if self.op("{"):
                template = self.triples("}")
                q = self._tail(lambda w: Query(w, form="construct", template=template))
            else:
                q = self._tail(lambda w: Query(w, form="construct", template=[t for t in w.parts if isinstance(t, Triple)]))
        elif self.word("DESCRIBE"):
            what = []
            while self.peek()[0] in ("var", "iri", "pname"):
                what.append(self.term())
            self.op("*")
            q = self._tail(lambda w: Query(w, form="describe", described=what), optional=True)
        else:
            raise SyntaxError_(f"unknown query form {self.peek()[1]!r}")
        if self.peek()[0] != "end":
            raise SyntaxError_(f"unexpected {self.peek()[1]!r}")
        return q

    def _datasets_where(self, frm: list, named: list, optional: bool = False) -> Group:
        while self.word("FROM"):
            (named if self.word("NAMED") else frm).append(self.iri().value)
        self.word("WHERE")
        if optional and self.peek() != ("op", "{"):
            return Group(())
        return self.group()

    def _tail(self, make, optional: bool = False) -> Query:
        frm, named = [], []
        q = make(self._datasets_where(frm, named, optional))
        q.frm, q.frm_named = frm, named
        self.modifiers(q)
        return q

    def select(self) -> Query:
        self.word("SELECT")
        distinct = bool(self.word("DISTINCT", "REDUCED"))
        items: list | None = []
        if self.op("*"):
            items = None
        else:
            while True:
                if self.peek()[0] == "var":
                    v = self.next()[1][1:]
                    items.append((Var(v), v))
                elif self.op("("):
                    e = self.expr()
                    if not self.word("AS"):
                        raise SyntaxError_("expected AS")
                    items.append((e, self.next()[1][1:]))
                    self.need(")")
                else:
                    break
        q = self._tail(lambda w: Query(w, items, distinct=distinct))
        return q

    def modifiers(self, q: Query) -> None:
        if self.word("GROUP"):
            self.word("BY")
            q.group = []
            while True:
                if self.peek()[0] == "var":
                    v = self.next()[1][1:]
                    q.group.append((Var(v), v))
                elif self.op("("):
                    e = self.expr()
                    name = self.next()[1][1:] if self.word("AS") else self.new().name
                    q.group.append((e, name))
                    self.need(")")
                elif self.peek()[0] in ("word", "iri", "pname") and not self.is_word("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES"):
                    q.group.append((self.primary(), self.new().name))
                else:
                    break
        if self.word("HAVING"):
            e = self.primary()
            while self.peek() == ("op", "("):
                e = Call("and", (e, self.primary()))
            q.having = e
        if self.word("ORDER"):
            self.word("BY")
            while True:
                if way := self.word("ASC", "DESC"):
                    q.order.append((self.primary(), way == "DESC"))
                elif self.peek()[0] == "var" or self.peek() == ("op", "(") or self.peek()[0] == "word" and not self.is_word("LIMIT", "OFFSET", "VALUES"):
                    q.order.append((self.primary(), False))
                else:
                    break
        while w := self.word("LIMIT", "OFFSET"):
            n = int(self.next()[1])
            if w == "LIMIT":
                q.limit = n
            else:
                q.offset = n
        if self.is_word("VALUES"):
            q.values = self.values()

    # -- patterns

    def group(self) -> Group:
        self.need("{")
        if self.is_word("SELECT"):
            q = self.select()
            self.need("}")
            return Group((Sub(q),))
        parts: list = []
        while not self.op("}"):
            if self.op("."):
                continue
            if self.word("OPTIONAL"):
                parts.append(Optional(self.group()))
            elif self.word("MINUS"):
                parts.append(Minus(self.group()))
            elif self.word("GRAPH"):
                g = self.term()
                parts.append(InGraph(g, self.group()))
            elif self.word("SERVICE"):
                silent = bool(self.word("SILENT"))
                parts.append(Service(self.iri().value, self.group(), silent))
            elif self.word("FILTER"):
                parts.append(Filter(self.primary()))
            elif self.word("BIND"):
                self.need("(")
                e = self.expr()
                self.word("AS")
                v = self.next()[1][1:]
                self.need(")")
                if v in {n for p in parts for n in _bound(p)}:
                    raise SyntaxError_(f"BIND to ?{v}, which is in scope")
                parts.append(Bind(e, v))
            elif self.is_word("VALUES"):
                parts.append(self.values())
            elif self.peek() == ("op", "{"):
                groups = [self.group()]
                while self.word("UNION"):
                    groups.append(self.group())
                if len(groups) > 1:
                    parts.append(Union(tuple(groups)))
                elif len(groups[0].parts) == 1 and isinstance(groups[0].parts[0], Sub):
                    parts.append(groups[0].parts[0])
                else:
                    parts.append(groups[0])
            else:
                parts += self.same_subject()
        return Group(tuple(parts))

    def values(self) -> Values:
        self.word("VALUES")
        names, rows = [], []
        single = self.peek()[0] == "var"
        if single:
            names.append(self.next()[1][1:])
        else:
            self.need("(")
            while not self.op(")"):
                names.append(self.next()[1][1:])
        self.need("{")
        while not self.op("}"):
            if single:
                rows.append((None if self.word("UNDEF") else self.term(),))
            else:
                self.need("(")
                row = []
                while not self.op(")"):
                    row.append(None if self.word("UNDEF") else self.term())
                rows.append(tuple(row))
        return Values(tuple(names), tuple(rows))

    def triples(self, end: str) -> list[Triple]:
        out: list[Triple] = []
        while not self.op(end):
            if not self.op("."):
                out += self.same_subject()
        return out

    def node(self, out: list) -> object:
        if self.op("["):
            v = self.new()
            if not self.op("]"):
                self.properties(v, out)
                self.need("]")
            return v
        if self.op("("):
            items = []
            while not self.op(")"):
                items.append(self.node(out))
            rdf = TYPE[: -len("type")]
            last = Iri(rdf + "nil")
            for x in reversed(items):
                v = self.new()
                out += [Triple(v, Iri(rdf + "first"), x), Triple(v, Iri(rdf + "rest"), last)]
                last = v
            return last
        if self.peek() == ("op", "<") and self.peek(1) == ("op", "<"):
            return self.reified(out)
        return self.term()

    def reified(self, out: list) -> object:
        """<< s p o >>: the node that says something of this edge."""
        self.next(), self.next()
        many = self.op("(")
        s = self.node(out)
        p = Var(self.next()[1][1:]) if self.peek()[0] == "var" else self.predicate()
        o = self.node(out)
        if many:
            self.need(")")
        self.need(">"), self.need(">")
        return self.note(s, p, o, out)

    def note(self, s, p, o, out: list) -> object:
        """The node of an edge: any that is about it, or in data its own."""
        parts = (s, p, o)
        if self.data and not any(isinstance(x, Var) for x in parts):
            import hashlib

            n: object = Iri("_:note" + hashlib.sha1("\0".join(str(x.value) for x in parts).encode()).hexdigest()[:16])
        else:
            n = self.new()
        out += [Triple(n, Iri(a), x) for a, x in zip(ABOUT, parts)]
        return n

    def annotated(self, s, p, o, out: list) -> None:
        """{| ... |} behind an object: what is said of that edge."""
        while self.peek() == ("op", "{") and self.peek(1) == ("op", "|"):
            self.next(), self.next()
            self.properties(self.note(s, p, o, out), out)
            self.need("|"), self.need("}")

    def same_subject(self) -> list[Triple]:
        out: list[Triple] = []
        s = self.node(out)
        if not (out and self.peek()[1] in (".", "}")):
            self.properties(s, out)
        return out

    def properties(self, s, out: list) -> None:
        while True:
            p = Var(self.next()[1][1:]) if self.peek()[0] == "var" else self.path()
            while True:
                o = self.node(out)
                out.append(Triple(s, p, o))
                self.annotated(s, p, o, out)
                if not self.op(","):
                    break
            if not self.op(";"):
                return
            while self.op(";"):
                pass
            if self.peek()[1] in (".", "}", "]", "|") and self.peek()[0] == "op":
                return

    # -- paths

    def path(self):
        parts = [self.path_sequence()]
        while self.op("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else Choice(tuple(parts))

    def path_sequence(self):
        parts = [self.path_element()]
        while self.op("/"):
            parts.append(self.path_element())
        return parts[0] if len(parts) == 1 else Sequence(tuple(parts))

    def path_element(self):
        if self.op("^"):
            return Inverse(self.path_element())
        if self.op("!"):
            forward, backward = [], []
            many = self.op("(")
            while True:
                (backward if self.op("^") else forward).append(self.predicate().value)
                if not many or not self.op("|"):
                    break
            if many:
                self.need(")")
            p = NotIn(tuple(forward), tuple(backward))
        elif self.op("("):
            p = self.path()
            self.need(")")
        else:
            p = self.predicate()
        if m := self.op("*", "+", "?"):
            return Repeat(p, 0 if m != "+" else 1, 1 if m == "?" else None)
        if self.peek() == ("op", "{") and self.peek(1)[0] == "num":
            self.next()
            low = int(self.next()[1])
            high = low
            if self.op(","):
                high = int(self.next()[1]) if self.peek()[0] == "num" else None
            self.need("}")
            return Repeat(p, low, high)
        return p

    def predicate(self) -> Iri:
        if self.peek() == ("word", "a"):
            self.next()
            return Iri(TYPE)
        return self.iri()

    # -- expressions

    def expr(self):
        e = self.conjunction()
        while self.op("||"):
            e = Call("or", (e, self.conjunction()))
        return e

    def conjunction(self):
        e = self.relation()
        while self.op("&&"):
            e = Call("and", (e, self.relation()))
        return e

    def relation(self):
        e = self.sum()
        if o := self.op("=", "!=", "<", ">", "<=", ">="):
            return Call(o, (e, self.sum()))
        if self.is_word("IN") or self.is_word("NOT") and self.peek(1)[1].upper() == "IN":
            name = "notin" if self.word("NOT") else "in"
            self.word("IN")
            return Call(name, (e, *self.arguments()))
        return e

    def sum(self):
        e = self.product()
        while True:
            if o := self.op("+", "-"):
                e = Call(o, (e, self.product()))
            else:
                return e

    def product(self):
        e = self.unary()
        while o := self.op("*", "/"):
            e = Call(o, (e, self.unary()))
        return e

    def unary(self):
        if self.op("!"):
            return Call("not", (self.unary(),))
        if self.op("-"):
            return Call("neg", (self.unary(),))
        self.op("+")
        return self.primary()

    def arguments(self) -> tuple:
        self.need("(")
        out = []
        while not self.op(")"):
            out.append(self.expr())
            self.op(",")
        return tuple(out)

    def primary(self):
        kind, text = self.peek()
        if self.op("("):
            e = self.expr()
            self.need(")")
            return e
        if kind == "word" and text.lower() not in ("true", "false"):
            name = self.next()[1].upper()
            if name == "NOT" and self.word("EXISTS"):
                return Exists(self.group(), True)
            if name == "EXISTS":
                return Exists(self.group())
            if name in AGGREGATES:
                self.need("(")
                distinct = bool(self.word("DISTINCT"))
                arg = None if self.op("*") else self.expr()
                sep = " "
                if self.op(";"):
                    self.word("SEPARATOR")
                    self.need("=")
                    sep = unquote(self.next()[1])
                self.need(")")
                return Agg(name.lower(), arg, distinct, sep)
            return Call(name.lower(), self.arguments())
        if kind in ("iri", "pname"):
            i = self.iri()
            return Call(i.value, self.arguments()) if self.peek() == ("op", "(") else i
        return self.term()


def _bound(p) -> list[str]:
    from ..ir import variables

    return variables(p)


def parse(text: str, prefixes: dict[str, str] | None = None) -> Query:
    return Parser(text, prefixes).query()
