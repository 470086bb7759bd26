"""SPARQL Update requests on a fact store: each operation makes flakes to append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ir import Group, InGraph, Iri, Lit, Triple, Var
from ..sources import flakes as fl
from .sparql import Parser


def _quads(p: Parser, graph: str | None) -> list[tuple]:
    """Templates in braces, of which some are in GRAPH: pairs of a graph and a triple."""
    p.need("{")
    out: list[tuple] = []
    while not p.op("}"):
        if p.word("GRAPH"):
            g = p.term()
            p.need("{")
            out += [(g if isinstance(g, Var) else g.value, t) for t in p.triples("}")]
        elif not p.op("."):
            out += [(graph, t) for t in p.same_subject()]
    return out


def _pattern(quads: list[tuple], home: str | None) -> Group:
    """Quads as a pattern over the graphs."""
    out: list = []
    for g in dict.fromkeys(g for g, _ in quads):
        inner = tuple(t for h, t in quads if h == g)
        out += inner if g == home else (InGraph(g if isinstance(g, Var) else Iri(g), Group(inner)),)
    return Group(tuple(out))


def _rows(spark: SparkSession, quads: list[tuple[str | None, Triple]]) -> DataFrame:
    name = lambda x: "_:" + x.name.lstrip("_") if isinstance(x, Var) else x.value
    df = None
    for g in dict.fromkeys(g for g, _ in quads):
        rows = [(name(t.s), name(t.p), t.o if isinstance(t.o, Lit) else name(t.o)) for h, t in quads if h == g]
        x = fl.facts(spark, rows, graph=g)
        df = x if df is None else df.union(x)
    return df


def _loaded(spark: SparkSession, path: str, graph: str | None, silent: bool) -> DataFrame:
    """The facts of a file, in a graph; with `silent` none if it can't be read."""
    from ..sources import readers

    try:
        rows = readers.read(spark, path.removeprefix("file://"))
        rows = rows.withColumn("g", F.lit(graph).cast("string")) if graph is not None else rows
        rows.limit(1).collect()
        return rows
    except Exception:
        if silent:
            return spark.createDataFrame([], fl.SCHEMA)
        raise


def update(spark: SparkSession, flakes: DataFrame, text: str, t: int, prefixes: dict[str, str] | None = None) -> DataFrame:
    """The store after a request: INSERT DATA, DELETE DATA, DELETE WHERE, DELETE / INSERT ...
    WHERE (with WITH, USING and GRAPH), LOAD of files, CLEAR and DROP (alike), CREATE, ADD,
    COPY, MOVE; operations are parted by semicolons and each sees what the ones before did, at
    times from t on. Without SILENT, a graph that isn't there can't be cleared, dropped or
    copied, nor one that is there created."""
    p = Parser(text, prefixes)
    columns = flakes.columns

    def graph() -> str | None:
        if p.word("DEFAULT"):
            return None
        p.word("GRAPH")
        return p.iri().value

    def of(g: str | None) -> DataFrame:
        return fl.current(flakes).where(F.col("g").isNull() if g is None else F.col("g") == g)

    def there(g: str | None, silent: bool) -> DataFrame:
        rows = of(g)
        if g is not None and not silent and rows.isEmpty():
            raise ValueError(f"no such graph {g}")
        return rows

    while p.peek()[0] != "end":
        p.prologue()
        new = None
        home = p.iri().value if p.word("WITH") else None
        if p.is_word("INSERT", "DELETE") and p.peek(1)[1].upper() == "DATA":
            kind = p.word("INSERT", "DELETE")
            p.next()
            p.data = True
            rows = _rows(spark, _quads(p, None))
            p.data = False
            new = (fl.insert if kind == "INSERT" else fl.delete)(flakes, rows, t)
        elif p.is_word("DELETE") and p.peek(1)[1].upper() == "WHERE":
            p.next(), p.next()
            quads = _quads(p, home)
            new = fl.update(spark, flakes, _pattern(quads, home), quads, [], t, home)
        elif p.is_word("DELETE", "INSERT"):
            gone = _quads(p, home) if p.word("DELETE") else []
            made = _quads(p, home) if p.word("INSERT") else []
            using: list[str] = []
            using_named: list[str] = []
            while p.word("USING"):
                (using_named if p.word("NAMED") else using).append(p.iri().value)
            p.word("WHERE")
            data = fl.graphs(flakes, using or None, using_named or ([] if using else None), home)
            new = fl.update(spark, flakes, p.group(), gone, made, t, home, data)
        elif p.word("LOAD"):
            silent = bool(p.word("SILENT"))
            path = p.iri().value
            target = graph() if p.word("INTO") else None
            new = fl.insert(flakes, _loaded(spark, path, target, silent), t)
        elif p.word("CLEAR", "DROP"):
            silent = bool(p.word("SILENT"))
            if p.word("ALL"):
                gone = fl.current(flakes)
            elif p.word("NAMED"):
                gone = fl.current(flakes).where(F.col("g").isNotNull())
            else:
                gone = there(graph(), silent)
            new = fl.delete(flakes, gone, t)
        elif p.word("CREATE"):
            silent = bool(p.word("SILENT"))
            name = graph()
            if not silent and not of(name).isEmpty():
                raise ValueError(f"graph {name} is there")
        elif kind := p.word("ADD", "COPY", "MOVE"):
            silent = bool(p.word("SILENT"))
            source = graph()
            there(source, silent)
            p.word("TO")
            target = graph()
            if source != target:
                rows = of(source).withColumn("g", F.lit(target).cast("string"))
                new = fl.insert(flakes, rows, t).select(columns)
                if kind != "ADD":  # what the target alone has goes
                    keep = rows.select(*fl.FACT)
                    stale = of(target).select(*fl.FACT).exceptAll(keep)
                    new = new.union(fl.delete(flakes, stale, t).select(columns))
                if kind == "MOVE":
                    new = new.union(fl.delete(flakes, of(source), t).select(columns))
        else:
            raise ValueError(f"unknown operation {p.peek()[1]!r}")
        if new is not None:
            flakes = flakes.union(new.select(columns))
        t += 1
        if not p.op(";"):
            break
    if p.peek()[0] != "end":
        raise ValueError(f"unexpected {p.peek()[1]!r}")
    return flakes


__all__ = ["Iri", "update"]
