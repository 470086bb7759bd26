"""A query language of JSON objects to the common representation.

{"@context": {...}, "select": ["?s", "?n", "(sum ?x)"], "where": [{"@id": "?s", "ex:name":
"?n"}, ["filter", "(> ?x 3)"], ["optional", {...}]], "groupBy": ..., "orderBy": ...}
"""

from __future__ import annotations

import re
from typing import Any

from ..ir import TYPE, XSD, Agg, Bind, Call, Each, Exists, Filter, Group, InGraph, Iri, Lit, Minus, Optional, Query, Sub, Triple, Union, Unwind, Values, Var

AGGREGATES = {"count", "count-distinct", "sum", "avg", "min", "max", "median", "variance", "stddev", "groupconcat", "sample", "collect", "collect-distinct"}
# names that differ from the common ones
ALIASES = {
    "==": "=", "not=": "!=", "strLen": "strlen", "subStr": "substr", "ucase": "ucase", "lcase": "lcase", "strStarts": "strstarts", "strEnds": "strends", "strBefore": "strbefore", "strAfter": "strafter",
    "quot": "/", "mod": "%", "&&": "and", "||": "or", "nil?": "isnull", "isIRI": "isiri", "isURI": "isiri", "isBlank": "isblank", "isLiteral": "isliteral", "isNumeric": "isnumeric", "langMatches": "langmatches",
}


class Parser:
    def __init__(self, context: dict[str, Any]):
        self.context, self.fresh = context, 0

    def iri(self, name: str) -> str:
        if name in ("@type", "a"):
            return TYPE
        if name in self.context:
            x = self.context[name]
            return self.iri(x["@id"]) if isinstance(x, dict) else x
        p, colon, local = name.partition(":")
        if colon and p in self.context and not local.startswith("//"):
            return self.context[p] + local
        return name if colon else self.context.get("@vocab", "") + name

    def new(self) -> str:
        self.fresh += 1
        return f"_j{self.fresh}"

    # -- patterns

    def group(self, where) -> Group:
        out: list = []
        for x in where if isinstance(where, list) and not (where and isinstance(where[0], str)) else [where]:
            out += self.pattern(x)
        return Group(tuple(out))

    def pattern(self, x) -> list:
        if isinstance(x, dict):
            return self.node(x)
        kind, *rest = x
        rest_group = rest[0] if len(rest) == 1 and isinstance(rest[0], list) else rest
        if kind == "filter":
            return [Filter(self.expr(e)) for e in rest]
        if kind == "bind":
            return [Bind(self.expr(e), v[1:]) for v, e in zip(rest[::2], rest[1::2])]
        if kind == "unwind":
            return [Unwind(self.expr(rest[1]), rest[0][1:])]
        if kind == "optional":
            return [Optional(self.group(r)) for r in rest]
        if kind == "union":
            return [Union(tuple(self.group(r) for r in rest))]
        if kind == "minus":
            return [Minus(self.group(rest_group))]
        if kind in ("exists", "not-exists"):
            return [Filter(Exists(self.group(rest_group), kind == "not-exists"))]
        if kind == "values":
            names, rows = rest[0]
            names = [names] if isinstance(names, str) else names
            return [Values(tuple(n[1:] for n in names), tuple(tuple(self.term(v) if v is not None else None for v in (r if isinstance(r, list) else [r])) for r in rows))]
        if kind == "query":
            return [Sub(self.query(rest[0]))]
        if kind == "graph":
            g = Var(rest[0][1:]) if rest[0].startswith("?") else Iri(self.iri(rest[0]))
            return [InGraph(g, self.group(rest[1]))]
        if kind == "and":
            return [y for r in rest for y in self.pattern(r)]
        raise ValueError(f"unknown pattern {kind!r}")

    def term(self, v):
        if isinstance(v, str):
            return Var(v[1:]) if v.startswith("?") else Lit(v, XSD + "string")
        if isinstance(v, bool):
            return Lit(v, XSD + "boolean")
        if isinstance(v, int):
            return Lit(v, XSD + "integer")
        if isinstance(v, float):
            return Lit(v, XSD + "double")
        if "@id" in v:
            return Var(v["@id"][1:]) if v["@id"].startswith("?") else Iri(self.iri(v["@id"]))
        dt = v.get("@type")
        return Lit(v["@value"], self.iri(dt) if dt else XSD + "string" if "@language" not in v else None, v.get("@language"))

    def node(self, x: dict) -> list:
        out: list = []
        s = x.get("@id", "?" + self.new())
        subject = Var(s[1:]) if s.startswith("?") else Iri(self.iri(s))
        for k, v in x.items():
            if k == "@id":
                continue
            p = Var(k[1:]) if k.startswith("?") else Iri(self.iri(k))
            for y in v if isinstance(v, list) else [v]:
                ref = k in ("@type", "a") or isinstance(self.context.get(k), dict) and self.context[k].get("@type") == "@id"
                if isinstance(y, dict) and "@value" not in y and set(y) != {"@id"}:
                    child = y.get("@id", "?" + self.new())
                    out.append(Triple(subject, p, Var(child[1:]) if child.startswith("?") else Iri(self.iri(child))))
                    out += self.node({**y, "@id": child})
                elif ref and isinstance(y, str) and not y.startswith("?"):
                    out.append(Triple(subject, p, Iri(self.iri(y))))
                else:
                    out.append(Triple(subject, p, self.term(y)))
        return out

    # -- expressions: data lists, or s-expressions in strings

    def expr(self, e):
        if isinstance(e, str) and e.startswith("("):
            tokens = re.findall(r"\"(?:[^\"\\]|\\.)*\"|[()\[\]]|[^\s()\[\]]+", e)
            out, at = self.sexp(tokens, 0)
            return out
        if isinstance(e, list):
            return self.call(e[0], [self.expr(x) for x in e[1:]])
        return self.term(e)

    def sexp(self, tokens: list[str], at: int):
        t = tokens[at]
        if t in "([":
            out, at = [], at + 1
            name = None
            if t == "(":
                name, at = tokens[at], at + 1
            while tokens[at] not in ")]":
                x, at = self.sexp(tokens, at)
                out.append(x)
            return self.call(name or "list", out), at + 1
        if t.startswith("?"):
            return Var(t[1:]), at + 1
        if t == "*":
            return None, at + 1
        if t.startswith('"'):
            return Lit(t[1:-1].replace('\\"', '"'), XSD + "string"), at + 1
        if t in ("true", "false"):
            return Lit(t == "true", XSD + "boolean"), at + 1
        try:
            return self.term(int(t)), at + 1
        except ValueError:
            pass
        try:
            return self.term(float(t)), at + 1
        except ValueError:
            return Iri(self.iri(t)), at + 1

    def call(self, name: str, args: list):
        if name == "as":
            return ("as", args[0], args[1].name)
        if name in AGGREGATES:
            distinct = name.endswith("-distinct")
            base = {"groupconcat": "group_concat"}.get(name.removesuffix("-distinct"), name.removesuffix("-distinct"))
            return Agg(base, args[0], distinct, args[1].value if len(args) > 1 else " ")
        name = ALIASES.get(name, name)
        if name == "in" and isinstance(args[1], Call):
            return Call("in", (args[0], *args[1].args))
        if name in ("and", "or", "+", "*", "-") and len(args) > 2:
            out = args[0]
            for a in args[1:]:
                out = Call(name, (out, a))
            return out
        if name in ("all", "any") and len(args) == 3:
            return Each(name, args[0].name, args[1], args[2])
        return Call(name.lower() if not name.startswith("http") else name, tuple(args))

    # -- query

    def query(self, q: dict) -> Query:
        form = "ask" if "ask" in q else "construct" if "construct" in q else "select"
        where = q.get("where") or q.get("ask") or []
        out = Query(self.group(where), form=form)
        if form == "construct":
            c = q["construct"]
            out.template = [t for x in (c if isinstance(c, list) else [c]) for t in self.node(x)]
            return out
        chosen = q.get("select") or q.get("selectDistinct") or q.get("selectOne")
        if chosen and chosen != "*":
            out.select = []
            for x in chosen if isinstance(chosen, list) else [chosen]:
                e = self.expr(x)
                if isinstance(e, tuple):
                    out.select.append((e[1], e[2]))
                else:
                    out.select.append((e, e.name if isinstance(e, Var) else x))
        out.distinct = "selectDistinct" in q
        if "groupBy" in q:
            g = q["groupBy"]
            out.group = [(Var(v[1:]), v[1:]) for v in ([g] if isinstance(g, str) else g)]
            names = {n for _, n in out.group}
            # other variables become lists of their group
            out.select = [(e if not isinstance(e, Var) or e.name in names else Agg("collect", e), n) for e, n in out.select or []]
        if "having" in q:
            out.having = self.expr(q["having"])
        for o in (lambda x: x if isinstance(x, list) and not (x and isinstance(x[0], str) and x[0] in ("asc", "desc")) else [x])(q.get("orderBy", [])):
            if isinstance(o, list):
                out.order.append((self.expr(o[1]), o[0] == "desc"))
            else:
                m = re.fullmatch(r"\((asc|desc) (.*)\)", o)
                out.order.append((self.expr(m[2] if m else o), bool(m) and m[1] == "desc"))
        out.limit = 1 if "selectOne" in q else q.get("limit")
        out.offset = q.get("offset", 0)
        return out


def parse(q: dict) -> Query:
    return Parser(q.get("@context", {})).query(q)
