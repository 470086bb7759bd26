"""The one representation that all query languages are parsed into."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
TYPE = RDF + "type"
#: What a note is about: the subject, predicate and object of an edge.
ABOUT = ("http://trellis/reifiesSubject", "http://trellis/reifiesPredicate", "http://trellis/reifiesObject")


# ---- terms


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Lit:
    value: Any
    dt: str | None = None
    lang: str | None = None


# ---- property paths; a plain predicate is an Iri or a Var


@dataclass(frozen=True)
class Inverse:
    path: Any


@dataclass(frozen=True)
class Sequence:
    parts: tuple


@dataclass(frozen=True)
class Choice:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    """At least `low` (0 or more) and at most `high` (None: any number of) steps."""

    path: Any
    low: int
    high: int | None


@dataclass(frozen=True)
class NotIn:
    """Any predicate but these; inverse ones are walked backwards."""

    forward: tuple
    backward: tuple = ()


# ---- expressions


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Agg:
    name: str
    arg: Any = None  # None: count(*)
    distinct: bool = False
    sep: str = " "


@dataclass(frozen=True)
class Exists:
    group: Group
    negated: bool = False


@dataclass(frozen=True)
class Each:
    """List operations over `var`: kind is map, all, any, none, single or reduce."""

    kind: str
    var: str
    items: Any
    where: Any = None
    value: Any = None
    acc: str | None = None
    start: Any = None


# ---- patterns


@dataclass(frozen=True)
class Triple:
    s: Any
    p: Any
    o: Any
    t: str | None = None  # variables for transaction time and operation
    op: str | None = None


@dataclass(frozen=True)
class Group:
    parts: tuple


@dataclass(frozen=True)
class Optional:
    group: Group


@dataclass(frozen=True)
class Union:
    groups: tuple


@dataclass(frozen=True)
class Minus:
    group: Group


@dataclass(frozen=True)
class Filter:
    expr: Any


@dataclass(frozen=True)
class Bind:
    expr: Any
    var: str


@dataclass(frozen=True)
class Unwind:
    expr: Any
    var: str


@dataclass(frozen=True)
class Values:
    names: tuple
    rows: tuple  # None: UNDEF


@dataclass(frozen=True)
class InGraph:
    graph: Any
    group: Group


@dataclass(frozen=True)
class Service:
    name: str
    group: Group
    silent: bool = False


@dataclass(frozen=True)
class Sub:
    """A subquery. lateral: variables of the outer query that each row's run sees."""

    query: Query
    lateral: tuple | None = None


@dataclass(frozen=True)
class Shortest:
    """Paths from s to o over `predicates`; mode is single, all or trails."""

    s: Any
    o: Any
    predicates: tuple
    path: str
    mode: str = "single"
    direction: str = "out"
    low: int = 1
    high: int | None = None


@dataclass(frozen=True)
class Search:
    """A named index: kind is text, vector or geo."""

    kind: str
    target: str
    query: Any
    subject: str
    score: str
    limit: int = 10


@dataclass
class Query:
    where: Group
    select: list[tuple[Any, str]] | None = None  # None: all variables
    form: str = "select"
    distinct: bool = False
    group: list[tuple[Any, str]] | None = None
    having: Any = None
    order: list[tuple[Any, bool]] = field(default_factory=list)  # expression, descending
    limit: int | None = None
    offset: int = 0
    values: Values | None = None
    template: list[Triple] = field(default_factory=list)
    described: list[Any] = field(default_factory=list)
    union: tuple[Query, bool] | None = None  # another query, all rows
    frm: list[str] = field(default_factory=list)
    frm_named: list[str] = field(default_factory=list)


def variables(x: Any) -> list[str]:
    """Variables that a pattern, term or query can bind, or an expression names, in order."""
    out: dict[str, None] = {}

    def walk(x: Any) -> None:
        if isinstance(x, Var):
            out[x.name] = None
        elif isinstance(x, Query):
            if x.select is None:
                walk(x.where)
            else:
                out.update(dict.fromkeys(n for _, n in x.select))
        elif isinstance(x, (Filter, Minus)):
            return
        elif isinstance(x, (Bind, Unwind)):
            out[x.var] = None
        elif isinstance(x, Values):
            out.update(dict.fromkeys(x.names))
        elif isinstance(x, Sub):
            walk(x.query)
        elif isinstance(x, Each):
            walk(x.items)
            inner = dict.fromkeys(n for y in (x.where, x.value, x.start) if y is not None for n in variables(y) if n not in (x.var, x.acc))
            out.update(inner)
        elif isinstance(x, Shortest):
            walk(x.s), walk(x.o)
            out[x.path] = None
        elif isinstance(x, Search):
            out[x.subject] = None
            out[x.score] = None
        elif isinstance(x, Exists):
            walk(x.group)
        elif isinstance(x, (tuple, list)):
            for y in x:
                walk(y)
        elif hasattr(x, "__dataclass_fields__"):
            for f in x.__dataclass_fields__:
                v = getattr(x, f)
                if isinstance(x, Triple) and f in ("t", "op") and v:
                    out[v] = None
                else:
                    walk(v)

    walk(x)
    return list(out)
