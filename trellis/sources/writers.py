"""Output formats of results and facts. Each makes a DataFrame of lines to write in parallel,
or iterates over rows; none gathers a result on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ir import TYPE, XSD


#: What a string column holds where it holds an IRI.
IRI = r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"


def _escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def nquads(flakes: DataFrame) -> DataFrame:
    """A line for each fact (g, s, p, o, dt, lang)."""
    name = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    o = F.col("o")
    text = F.concat(F.lit('"'), _escaped(o), F.lit('"'))
    obj = F.when(F.col("dt") == "@id", name(o)).when(F.col("lang").isNotNull(), F.concat(text, F.lit("@"), F.col("lang"))).when(F.col("dt") == XSD + "string", text).otherwise(F.concat(text, F.lit("^^"), name(F.col("dt"))))
    g = F.when(F.col("g").isNotNull(), F.concat(F.lit(" "), name(F.col("g")))).otherwise(F.lit(""))
    return flakes.select(F.concat(name(F.col("s")), F.lit(" "), name(F.col("p")), F.lit(" "), obj, g, F.lit(" .")).alias("value"))


def bindings(df: DataFrame) -> DataFrame:
    """A line of a SPARQL results JSON binding for each row; unbound variables are left out."""
    kinds = dict(df.dtypes)
    from ..plans.frame import xsd_of

    def one(c: str) -> Column:
        v = F.col(c).cast("string")
        if kinds[c] == "string":
            return F.when(v.rlike(IRI), F.struct(F.lit("uri").alias("type"), v.alias("value"), F.lit(None).cast("string").alias("datatype"))).when(v.isNotNull(), F.struct(F.lit("literal").alias("type"), v.alias("value"), F.lit(None).cast("string").alias("datatype")))
        return F.when(v.isNotNull(), F.struct(F.lit("literal").alias("type"), v.alias("value"), F.lit(xsd_of(kinds[c])).alias("datatype")))

    return df.select(F.to_json(F.struct(*[one(c).alias(c) for c in df.columns])).alias("value"))


def results_xml(df: DataFrame) -> DataFrame:
    """A line of SPARQL results XML, <result>...</result>, for each row; unbound variables are
    left out. xml_head() and "</results></sparql>" go around them."""
    from ..plans.frame import xsd_of

    kinds = dict(df.dtypes)
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def one(c: str) -> Column:
        v = F.col(c).cast("string")
        literal = F.concat(F.lit(f'<literal datatype="{xsd_of(kinds[c])}">' if kinds[c] != "string" else "<literal>"), escaped(v), F.lit("</literal>"))
        term = F.when(v.startswith("_:"), F.concat(F.lit("<bnode>"), escaped(v.substr(3, 1 << 30)), F.lit("</bnode>"))).when(v.rlike(IRI), F.concat(F.lit("<uri>"), escaped(v), F.lit("</uri>"))).otherwise(literal) if kinds[c] == "string" else literal
        return F.when(v.isNotNull(), F.concat(F.lit(f'<binding name="{c}">'), term, F.lit("</binding>"))).otherwise(F.lit(""))

    return df.select(F.concat(F.lit("<result>"), *[one(c) for c in df.columns], F.lit("</result>")).alias("value"))


def xml_head(names: list[str]) -> str:
    return '<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>' + "".join(f'<variable name="{n}"/>' for n in names) + "</head><results>"


def typed(df: DataFrame) -> DataFrame:
    """A line of JSON for each row, every value with its type: {"x": {"@value": .., "@type": ..}}
    or {"@id": ..}; what is unbound is left out."""
    from ..plans.frame import xsd_of

    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        v = F.col(c).cast("string")
        value = F.struct(F.lit(None).cast("string").alias("@id"), v.alias("@value"), F.lit(xsd_of(kinds[c]) or XSD + "string").alias("@type"))
        iri = F.struct(v.alias("@id"), F.lit(None).cast("string").alias("@value"), F.lit(None).cast("string").alias("@type"))
        return F.when(v.isNull(), None).when(v.rlike(IRI), iri).otherwise(value) if kinds[c] == "string" else F.when(v.isNotNull(), value)

    return df.select(F.to_json(F.struct(*[one(c).alias(c) for c in df.columns])).alias("value"))


def compact(df: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """A line of short JSON for readers with little room: values as they are, IRIs by prefixes,
    what is unbound left out."""

    def one(c: str, kind: str) -> Column:
        v = F.col(c)
        for k, iri in sorted((prefixes or {}).items(), key=lambda x: len(x[1])) if kind == "string" else ():
            v = F.when(F.col(c).startswith(iri), F.concat(F.lit(k + ":"), F.substring(F.col(c), len(iri) + 1, 1 << 30))).otherwise(v)
        return v.alias(c)

    return df.select(F.to_json(F.struct(*[one(c, k) for c, k in df.dtypes])).alias("value"))


def cypher_json(df: DataFrame) -> DataFrame:
    """A line of a Cypher result, {"row":[..]}, for each row, nulls among its values."""
    cells = [F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1) for c in df.columns]
    row = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit("null")).otherwise(x) for c, x in zip(df.columns, cells)])
    return df.select(F.concat(F.lit('{"row":['), row, F.lit("]}")).alias("value"))


def delimited(df: DataFrame, sep: str = ",") -> DataFrame:
    """CSV (or TSV with a tab) lines; the header isn't among them."""
    def cell(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        if sep == "\t":
            return F.replace(F.replace(v, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
        return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return df.select(F.concat_ws(sep, *[cell(c) for c in df.columns]).alias("value"))


def nodes(flakes: DataFrame) -> DataFrame:
    """A line of JSON-LD for each subject: its properties with lists of values."""
    value = F.when(F.col("dt") == "@id", F.to_json(F.struct(F.col("o").alias("@id")))).otherwise(F.to_json(F.struct(F.col("o").alias("@value"), F.col("dt").alias("@type"), F.col("lang").alias("@language"))))
    per = flakes.groupBy("s", "p").agg(F.array_sort(F.collect_list(F.when(F.col("p") == TYPE, F.to_json(F.array("o"))).otherwise(value))).alias("v"))
    pair = F.concat(F.lit('"'), _escaped(F.when(F.col("p") == TYPE, F.lit("@type")).otherwise(F.col("p"))), F.lit('": ['), F.array_join(F.transform("v", lambda x: F.regexp_replace(x, r'^\["(.*)"\]$', '"$1"')), ", "), F.lit("]"))
    one = per.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(pair)), ", ").alias("body"))
    return one.select(F.concat(F.lit('{"@id": "'), _escaped(F.col("s")), F.lit('", '), F.col("body"), F.lit("}")).alias("value"))


def rdf_xml(flakes: DataFrame) -> DataFrame:
    """A line of RDF/XML for each fact, in elements of its own namespace."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    ns, local = F.regexp_extract("p", r"^(.*[/#:])([^/#:]+)$", 1), F.regexp_extract("p", r"^(.*[/#:])([^/#:]+)$", 2)
    body = F.when(F.col("dt") == "@id", F.concat(F.lit(' rdf:resource="'), escaped(F.col("o")), F.lit('"/>'))).when(F.col("lang").isNotNull(), F.concat(F.lit(' xml:lang="'), F.col("lang"), F.lit('">'), escaped(F.col("o")), F.lit("</n:"), local, F.lit(">"))).otherwise(F.concat(F.lit(' rdf:datatype="'), F.col("dt"), F.lit('">'), escaped(F.col("o")), F.lit("</n:"), local, F.lit(">")))
    return flakes.select(F.concat(F.lit('<rdf:Description rdf:about="'), escaped(F.col("s")), F.lit('"><n:'), local, F.lit(' xmlns:n="'), escaped(ns), F.lit('"'), body, F.lit("</rdf:Description>")).alias("value"))


def stream(df: DataFrame, every: int = 10_000) -> Iterator[str]:
    """Lines of a streamed result: a head, rows as they come (a few partitions at a time), a
    heartbeat now and then, an end with the count, or an error."""
    yield json.dumps({"type": "head", "vars": df.columns})
    n = 0
    try:
        for row in df.toLocalIterator(prefetchPartitions=True):
            n += 1
            yield json.dumps({"type": "row", "row": row.asDict(recursive=True)}, default=str)
            if n % every == 0:
                yield json.dumps({"type": "heartbeat", "rows": n})
    except Exception as e:  # the reader learns of it in the stream itself
        yield json.dumps({"type": "error", "message": str(e)[:500]})
        return
    yield json.dumps({"type": "end", "rows": n})
