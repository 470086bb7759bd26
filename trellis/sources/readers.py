"""Readers of facts: N-Triples and N-Quads, Turtle and TriG, JSON-LD, CSV, results JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ir import RDF, TYPE, XSD, Iri, Lit, Var
from .flakes import SCHEMA

LINE = re.compile(
    r"""\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:(<[^>]*>|_:[^\s.]+(?:\.[^\s.]+)*)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:\#.*)?$"""
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def unescape(s: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES.get(m[3], m[3]), s) if "\\" in s else s


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files; Spark itself opens .gz ones, .zst ones are opened as streams."""
    if not path.endswith(".zst"):
        return spark.read.text(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import zstandard

        for b in batches:
            for raw in b.column(0):
                text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw.as_py()), read_across_frames=True), "utf-8", newline="\n")
                while rows := [x.rstrip("\r\n") for x in text.readlines(1 << 22)]:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")


def nquads(spark: SparkSession, path: str, t: int = 1, strict: bool = True) -> DataFrame:
    """Flakes of N-Triples or N-Quads, .gz and .zst too; read and parsed in parallel by line.
    A line that is neither is an error, or left out if not strict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for line in b.column(0).to_pylist():
                if not line.strip() or line.lstrip().startswith("#"):
                    continue
                m = LINE.match(line)
                if not m:
                    if strict:
                        raise ValueError(f"not a statement: {line[:200]!r}")
                    continue
                s, p, ref, text, lang, dt, g = m.groups()
                name = lambda x: x[1:-1] if x.startswith("<") else x
                o = unescape(name(ref)) if ref else unescape(text)
                kind = "@id" if ref else dt or (RDF + "langString" if lang else XSD + "string")
                rows.append((name(g) if g else None, unescape(name(s)), unescape(p), o, kind, lang.lower() if lang else None, None, t, True))
            kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.bool_()]
            columns = list(zip(*rows)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return _lines(spark, path).mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str, t: int = 1) -> DataFrame:
    """Flakes of a file by its name: .nt and .nq (.gz, .zst), .ttl and .trig, .jsonld."""
    kind = path.removesuffix(".gz").removesuffix(".zst").rpartition(".")[2].lower()
    if kind in ("nt", "nq", "ntriples", "nquads"):
        return nquads(spark, path, t)
    whole = "\n".join(r[0] for r in _lines(spark, path).collect()) if kind in ("ttl", "trig", "jsonld") else ""
    if kind in ("ttl", "trig"):
        return turtle(spark, whole, t)
    if kind == "jsonld":
        return jsonld(spark, whole, t)
    raise ValueError(f"unknown kind of file: {path}")


def cypher_dump(spark: SparkSession, path: str, vocab: str, t: int = 1) -> DataFrame:
    """Flakes of a dump of CREATE statements, one a line: (:Label {id: ..., key: value}) makes
    the node `vocab + label/id`; lines that match two nodes by label and id and create a
    relationship link them. Parsed in parallel by line."""
    node = re.compile(r"\(\s*\w*\s*:\s*`?(\w+)`?\s*\{(.*?)\}\s*\)", re.S)
    cell = re.compile(r"`?(\w+)`?\s*:\s*(?:'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|(true|false)|(-?\d+\.\d+(?:[eE][+-]?\d+)?)|(-?\d+))")
    link = re.compile(r"CREATE\s*\(\s*(\w+)\s*\)\s*-\s*\[\s*\w*\s*:\s*`?(\w+)`?[^\]]*\]\s*->\s*\(\s*(\w+)\s*\)", re.I)
    named = re.compile(r"\(\s*(\w+)\s*:\s*`?(\w+)`?\s*\{\s*id\s*:\s*(?:'([^']*)'|\"([^\"]*)\"|(-?\d+))\s*\}\s*\)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for line in b.column(0).to_pylist():
                if m := link.search(line):
                    ids = {n: f"{vocab}{label}/{a or b_ or c}" for n, label, a, b_, c in named.findall(line)}
                    if m[1] not in ids or m[3] not in ids:
                        raise ValueError(f"unknown ends: {line[:200]!r}")
                    rows.append((ids[m[1]], vocab + m[2], ids[m[3]], "@id"))
                    continue
                for label, body in node.findall(line) if re.match(r"\s*CREATE\b", line, re.I) else ():
                    cells = []
                    for k, one, two, flag, real, whole in cell.findall(body):
                        text = re.sub(r"\\(.)", r"\1", one or two)
                        cells.append((k, flag or real or whole or text, XSD + ("boolean" if flag else "double" if real else "integer" if whole else "string")))
                    keys = {k: v for k, v, _ in cells}
                    if "id" not in keys:
                        raise ValueError(f"a node without id: {line[:200]!r}")
                    s = f"{vocab}{label}/{keys['id']}"
                    rows += [(s, TYPE, vocab + label, "@id"), *[(s, vocab + k, v, dt) for k, v, dt in cells]]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["s", "p", "o", "dt"])

    x = _lines(spark, path).mapInArrow(run, "s string, p string, o string, dt string")
    return x.selectExpr("cast(null as string) g", "s", "p", "o", "dt", "cast(null as string) lang", "cast(null as int) i", f"cast({t} as bigint) t", "true op")


def turtle(spark: SparkSession, text: str, t: int = 1) -> DataFrame:
    """Flakes of Turtle or TriG text, parsed on the driver (ontologies, small data)."""
    from ..parsers.sparql import Parser

    head = []
    body = re.sub(r"(?im)^\s*@?(prefix|base)\s+((?:[\w-]*:)?\s*<[^>]*>)\s*\.?", lambda m: head.append(f"{m[1].upper()} {m[2]}") or "", text)
    p = Parser("\n".join(head) + "\n" + body)
    p.prologue()
    rows: list[tuple] = []

    def blank(x):
        return "_:" + x.name.lstrip("_") if isinstance(x, Var) else x.value

    def keep(triples, graph: str | None) -> None:
        for x in triples:
            if isinstance(x.o, Lit):
                dt = x.o.dt or (RDF + "langString" if x.o.lang else XSD + "string")
                value = str(x.o.value).lower() if isinstance(x.o.value, bool) else str(x.o.value)
                rows.append((graph, blank(x.s), blank(x.p), value, dt, x.o.lang, None, t, True))
            else:
                rows.append((graph, blank(x.s), blank(x.p), blank(x.o), "@id", None, None, t, True))

    while p.peek()[0] != "end":
        if p.op("."):
            continue
        p.word("GRAPH")
        if p.peek(1) == ("op", "{") or p.peek() == ("op", "{"):
            graph = None if p.peek() == ("op", "{") else blank(p.term())
            p.need("{")
            keep(p.triples("}"), graph)
        else:
            keep(p.same_subject(), None)
    return spark.createDataFrame(rows, SCHEMA)


def jsonld(spark: SparkSession, data, t: int = 1, graph: str | None = None) -> DataFrame:
    """Flakes of JSON-LD nodes: an object, a list, or text of either."""
    from ..parsers.jsonld import Parser

    data = json.loads(data) if isinstance(data, str) else data
    context = data.get("@context", {}) if isinstance(data, dict) else {}
    nodes = data.get("@graph", [data]) if isinstance(data, dict) else data
    p, rows, fresh = Parser(context), [], iter(range(10**9))

    def add(node: dict) -> str:
        s = p.iri(node["@id"]) if "@id" in node else f"_:n{next(fresh)}"
        for k, v in node.items():
            if k in ("@id", "@context", "@graph"):
                continue
            pred = p.iri(k)
            ref = k in ("@type", "a") or isinstance(context.get(k), dict) and context[k].get("@type") == "@id"
            items, ordered = (v["@list"], True) if isinstance(v, dict) and "@list" in v else (v if isinstance(v, list) else [v], False)
            for n, x in enumerate(items):
                i = n if ordered else None
                if isinstance(x, dict) and "@value" not in x:
                    rows.append((graph, s, pred, add(x), "@id", None, i, t, True))
                elif ref and isinstance(x, str):
                    rows.append((graph, s, pred, p.iri(x), "@id", None, i, t, True))
                else:
                    lit = Lit(x, XSD + "string") if isinstance(x, str) else p.term(x)
                    value = str(lit.value).lower() if isinstance(lit.value, bool) else str(lit.value)
                    rows.append((graph, s, pred, value, lit.dt or RDF + "langString", lit.lang, i, t, True))
        return s

    for n in nodes:
        if set(n) - {"@id", "@context"}:
            add(n)
    return spark.createDataFrame(rows, SCHEMA)


def ndjson(spark: SparkSession, path: str, id: str, vocab: str, t: int = 1) -> DataFrame:
    """Flakes of lines of flat JSON objects: a fact for each key."""
    df = spark.read.json(path)
    return _flat(df, id, vocab, t)


def csv(spark: SparkSession, path: str, id: str, vocab: str, t: int = 1, **options) -> DataFrame:
    """Flakes of a CSV file with a header: a fact for each filled cell."""
    return _flat(spark.read.options(header=True, inferSchema=True, **options).csv(path), id, vocab, t)


def _flat(df: DataFrame, id: str, vocab: str, t: int) -> DataFrame:
    from ..plans.frame import xsd_of

    kinds = dict(df.dtypes)
    cells = [F.struct(F.lit(vocab + c).alias("p"), F.col(c).cast("string").alias("o"), F.lit(xsd_of(kinds[c]) or XSD + "string").alias("dt")) for c in df.columns if c != id]
    x = df.select(F.col(id).cast("string").alias("s"), F.explode(F.array(*cells)).alias("x")).where("x.o is not null")
    return x.selectExpr("cast(null as string) g", "s", "x.p p", "x.o o", "x.dt dt", "cast(null as string) lang", "cast(null as int) i", f"cast({t} as bigint) t", "true op")


def results_json(spark: SparkSession, text: str) -> DataFrame:
    """Rows of a SPARQL results document, as strings."""
    d = json.loads(text)
    names = d["head"]["vars"]
    rows = [tuple(b[v]["value"] if v in b else None for v in names) for b in d["results"]["bindings"]]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


__all__ = ["TYPE", "Iri", "csv", "cypher_dump", "jsonld", "ndjson", "nquads", "read", "results_json", "turtle"]
