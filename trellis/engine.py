"""The engine's front: queries in any of the languages over a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans.compile import Compiler, Dataset


def _run(spark: SparkSession, data: Dataset, query, reasoning: list[str] | None, rules) -> DataFrame:
    rewrite = None
    if reasoning:
        from .operators.reasoning import reasoned

        data, rewrite = reasoned(spark, data, reasoning, rules)
    c = Compiler(spark, data)
    c.rewrite = rewrite
    return c.run(query)


def sparql(spark: SparkSession, data: Dataset, text: str, prefixes: dict[str, str] | None = None, reasoning: list[str] | None = None, rules=None) -> DataFrame:
    """reasoning: modes of inference over a fact store (rdfs, owl2ql, owl2rl, datalog); rules:
    those of datalog."""
    from .parsers.sparql import parse

    return _run(spark, data, parse(text, prefixes), reasoning, rules)


def cypher(spark: SparkSession, data: Dataset, text: str, vocab: str = "", params: dict | None = None, reasoning: list[str] | None = None, rules=None) -> DataFrame:
    from .parsers.cypher import parse

    return _run(spark, data, parse(text, vocab, params), reasoning, rules)


def jsonld(spark: SparkSession, data: Dataset, query: dict, reasoning: list[str] | None = None, rules=None) -> DataFrame:
    from .parsers.jsonld import parse

    return _run(spark, data, parse(query), reasoning, rules)


def many(spark: SparkSession, data: Dataset, queries: dict[str, str], prefixes: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Several SPARQL queries by name, each lazy. One that can't be compiled is an error that
    names it; nothing has run by then."""
    out = {}
    for name, text in queries.items():
        try:
            out[name] = sparql(spark, data, text, prefixes)
        except Exception as e:
            raise ValueError(f"query {name}: {e}") from e
    return out


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """A query's physical plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
