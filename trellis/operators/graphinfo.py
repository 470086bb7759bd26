"""What a store holds: catalogues, statistics, whole nodes, and annotated edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ir import ABOUT, TYPE


def labels(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("p") == TYPE).select(F.col("o").alias("label")).distinct()


def relationship_types(facts: DataFrame) -> DataFrame:
    return facts.where((F.col("dt") == "@id") & (F.col("p") != TYPE)).select(F.col("p").alias("type")).distinct()


def property_keys(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("dt") != "@id").select(F.col("p").alias("key")).distinct()


def statistics(facts: DataFrame, exact: bool = False) -> DataFrame:
    """Facts, and (about) how many subjects and objects, of each predicate."""
    n = F.count_distinct if exact else F.approx_count_distinct
    return facts.groupBy("p").agg(F.count("*").alias("facts"), n("s").alias("subjects"), n("o").alias("objects"))


def hydrated(facts: DataFrame, subjects: DataFrame, depth: int = 0, reverse: bool = False) -> DataFrame:
    """(s, node) of subjects (column s): a map from predicate to its values as JSON. With
    depth, values that are nodes are JSON objects themselves; reverse follows edges back."""
    f = facts.where(F.col("dt") == "@id").select(F.col("o").alias("s"), F.concat(F.lit("^"), "p").alias("p"), F.col("s").alias("o"), "dt") if reverse else facts.select("s", "p", "o", "dt")
    value = F.to_json(F.struct(F.col("o").alias("@id"))) if depth == 0 else None
    if depth:
        inner = hydrated(facts, f.where(F.col("dt") == "@id").select(F.col("o").alias("s")).distinct(), depth - 1)
        inner = inner.select(F.col("s").alias("o"), F.to_json("node").alias("child"))
        f = f.join(inner, "o", "left")
        value = F.coalesce("child", F.to_json(F.struct(F.col("o").alias("@id"))))
    value = F.when(F.col("dt") == "@id", value).otherwise(F.to_json(F.struct(F.col("o").alias("@value"), F.col("dt").alias("@type"))))
    lists = f.join(subjects.select("s").distinct(), "s", "left_semi").groupBy("s", "p").agg(F.array_sort(F.collect_list(value)).alias("v"))
    return lists.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "v")))).alias("node"))


def annotated(facts: DataFrame) -> DataFrame:
    """Edges (s, p, o) with the node (note) that annotates each: a three-column join of edges
    with the facts that say what a note is about."""
    s, p, o = (facts.where(F.col("p") == a).select(F.col("s").alias("note"), F.col("o").alias(c)) for a, c in zip(ABOUT, ("s", "p", "o")))
    about = s.join(p, "note").join(o, "note")
    return facts.select("s", "p", "o").join(about, ["s", "p", "o"])


def annotate(spark, edges: list[tuple[str, str, str]], t: int = 1) -> DataFrame:
    """Flakes of a note on each of these edges, named by the edge's hash."""
    from ..sources.flakes import facts

    import hashlib

    rows = []
    for e in edges:
        note = "_:note" + hashlib.sha1("\0".join(e).encode()).hexdigest()[:16]
        rows += [(note, a, x) for a, x in zip(ABOUT, e)]
    return facts(spark, rows, t)
