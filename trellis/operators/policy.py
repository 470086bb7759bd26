"""View policies: which facts a reader may see."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ir import TYPE, Group

if TYPE_CHECKING:
    from ..plans.compile import Dataset


@dataclass
class Policy:
    """Allows or denies facts it targets: by subject, property, the subject's class, or all.
    query: a group of patterns; only subjects that it binds to `var` are allowed by it.
    required: no fact it targets is seen unless it allows it."""

    allow: bool = True
    subjects: list[str] | None = None
    properties: list[str] | None = None
    classes: list[str] | None = None
    query: Group | None = None
    var: str = "this"
    required: bool = False


def visible(spark: SparkSession, facts: DataFrame, policies: list[Policy], default_allow: bool = False) -> DataFrame:
    """The facts (g, s, p, o, dt, lang, i, t, op) that the policies show. A fact that no
    policy targets follows default_allow. Of others: a denial that applies wins, required
    policies must all allow, and one allowance must be given. Put below every scan."""
    from ..plans.compile import Compiler, Dataset
    from ..sources.flakes import FlakeGraph

    columns = facts.columns
    df = facts
    targeted: list[tuple[Policy, Column, Column]] = []
    for n, p in enumerate(policies):
        hit = F.lit(True)
        if p.subjects is not None:
            hit = hit & F.col("s").isin(p.subjects)
        if p.properties is not None:
            hit = hit & F.col("p").isin(p.properties)
        if p.classes is not None:
            of = facts.where((F.col("p") == TYPE) & F.col("o").isin(p.classes)).select(F.col("s").alias(f"__s{n}")).distinct()
            df = df.join(of, F.col("s") == F.col(f"__s{n}"), "left")
            hit = hit & F.col(f"__s{n}").isNotNull()
        says = F.lit(p.allow)
        if p.query is not None:
            f = Compiler(spark, Dataset(FlakeGraph(facts, facts=facts))).group(p.query)
            df = df.join(f.df.select(F.col(p.var).alias(f"__q{n}")).distinct(), F.col("s") == F.col(f"__q{n}"), "left")
            says = F.col(f"__q{n}").isNotNull() if p.allow else F.col(f"__q{n}").isNull()
        targeted.append((p, hit, says))
    any_hit, allowed, denied = F.lit(False), F.lit(False), F.lit(False)
    for p, hit, says in targeted:
        any_hit = any_hit | hit
        allowed = allowed | (hit & says)
        if not p.allow or p.required:
            denied = denied | (hit & ~says)
    return df.where(F.when(any_hit, allowed & ~denied).otherwise(F.lit(default_allow))).select(*columns)


def secured(spark: SparkSession, data: Dataset, policies: list[Policy], default_allow: bool = False) -> Dataset:
    """The dataset as a reader may see it: each graph's facts are those that the policies show,
    below every scan, path, rule and index that is made of them."""
    from ..plans.compile import Dataset
    from ..sources.flakes import FlakeGraph

    def seen(g: FlakeGraph) -> FlakeGraph:
        return FlakeGraph(g.flakes, facts=visible(spark, g.facts(), policies, default_allow))

    return Dataset(seen(data.default), {k: seen(g) for k, g in data.named.items()}, data.services, data.indexes)


def forbidden(spark: SparkSession, flakes: DataFrame, new: DataFrame, policies: list[Policy], default_allow: bool = False) -> DataFrame:
    """Of flakes to be appended, those that the policies of a writer don't allow: asserts are
    judged by the state after them, retractions by the state before. An update goes through
    only if there are none."""
    from ..sources.flakes import FACT, current

    new = new.select(flakes.columns)
    states = ((True, current(flakes.union(new))), (False, current(flakes)))
    out = []
    for op, state in states:
        seen = visible(spark, state, policies, default_allow).select(*FACT)
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"v.{c}")) for c in FACT]
        out.append(new.where(F.col("op") == op).alias("n").join(seen.alias("v"), same, "left_anti"))
    return out[0].union(out[1])
