"""Property paths and shortest paths."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ir import Choice, Inverse, Iri, NotIn, Repeat, Sequence, Shortest, Triple, Var
from .frame import Frame, Info, is_term, joined, key_of, shown, united

#: Rounds of a fixpoint after which it is taken to be wrong.
MOST_ROUNDS = 10_000
#: Layers that a search for shortest paths makes before it counts the ends that are within reach.
FREE_LAYERS = 4


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written under the folder in spark.checkpoint.dir, which driver
    and executors share; lineage ends there. (A checkpoint() would compute it twice.) Only a
    local session without such a folder gets one of its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = os.path.join(tempfile.gettempdir(), f"trellis-{sc.applicationId}")
        spark.conf.set("spark.checkpoint.dir", known)
    path = f"{known.rstrip('/')}/tables-{sc.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def edges(c, path) -> Frame:
    """Bag of (a, b) that one walk of a path makes."""
    if isinstance(path, Iri):
        return c.source.scan(Triple(Var("a"), path, Var("b")))
    if isinstance(path, Inverse):
        f = edges(c, path.path)
        return Frame(f.df.select(F.col("b").alias("a"), F.col("a").alias("b")), {"a": f.info["b"], "b": f.info["a"]})
    if isinstance(path, Choice):
        return united([_only(edges(c, p)) for p in path.parts])
    if isinstance(path, Sequence):
        f = _only(edges(c, path.parts[0]))
        for p in path.parts[1:]:
            x = _only(edges(c, p))
            l = Frame(f.df.select("a", F.col("b").alias("m")), {"a": f.info["a"], "m": f.info["b"]})  # noqa: E741
            r = Frame(x.df.select(F.col("a").alias("m"), "b"), {"m": x.info["a"], "b": x.info["b"]})
            f = _only(joined(l, r))
        return f
    if isinstance(path, NotIn):
        every = c.source.scan(Triple(Var("a"), Var("p"), Var("b")))
        p = shown(F.col("p"), every.info["p"])
        info = {v: every.info[v] for v in "ab"}
        out = []
        if path.forward or not path.backward:
            out.append(Frame(every.df.where(~p.isin(*path.forward) if path.forward else F.lit(True)).select("a", "b"), info))
        if path.backward:
            out.append(Frame(every.df.where(~p.isin(*path.backward)).select(F.col("b").alias("a"), F.col("a").alias("b")), {"a": info["b"], "b": info["a"]}))
        return united(out)
    if isinstance(path, Repeat):
        return closure(c, path)
    raise ValueError(f"unknown path {path!r}")


def _only(f: Frame) -> Frame:
    return Frame(f.df.select("a", "b"), {v: f.info[v] for v in "ab"})


def _uniform(f: Frame) -> Frame:
    """Both ends as one kind of value, so that they can meet."""
    i, j = f.info["a"], f.info["b"]
    if (i.template, i.row) == (j.template, j.row):
        return _only(f)
    return Frame(f.df.select(shown(F.col("a"), i).cast("string").alias("a"), shown(F.col("b"), j).cast("string").alias("b")), {"a": Info("iri"), "b": Info("iri" if j.kind == "iri" else "mixed")})


def reached(step: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of the transitive closure of distinct pairs, by squaring: after k
    rounds all of less than 2^k steps are known, and those of exactly 2^k steps take them
    further. What is known stays where it was written."""
    known, power = [step], step
    for _ in range(MOST_ROUNDS):
        every = reduce(DataFrame.union, known)
        hop = power.select(F.col("a").alias("m"), F.col("b").alias("c"))
        new = every.join(hop, every["b"] == hop["m"]).select("a", F.col("c").alias("b")).distinct()
        new = kept(new.join(every, ["a", "b"], "left_anti"))
        if new.isEmpty():
            return every
        known.append(new)
        power = kept(power.join(hop, power["b"] == hop["m"]).select("a", F.col("c").alias("b")).distinct())
    raise RuntimeError("a closure did not end")


def closure(c, path: Repeat, start: DataFrame | None = None) -> Frame:
    """Distinct pairs that low to high steps connect; with low 0 each node of the edges with
    itself. start: one column of the first ends that matter; from these it goes frontier by
    frontier, without them by squaring. Pairs that are known aren't walked again, so cycles
    end."""
    f = _uniform(edges(c, path.path))
    step = kept(f.df.distinct())
    nodes = step.select("a").union(step.select("b")).distinct().toDF("a")
    low, high = path.low, path.high
    if start is not None:
        start = start.toDF("a").distinct()
    first = step if start is None else step.join(start, "a", "left_semi")
    identity = (nodes if start is None else start).select("a", F.col("a").alias("b"))
    hop = step.select(F.col("a").alias("m"), F.col("b").alias("c"))
    if low > 1 or high is not None and high > 0 and low > 0:  # counted steps: layers may return
        layer, out = first, None
        for n in range(1, (high if high is not None else low) + 1):
            if n > 1:
                layer = layer.join(hop, layer["b"] == hop["m"]).select("a", F.col("c").alias("b")).distinct()
            if n >= low:
                out = layer if out is None else out.union(layer)
        if high is None:  # low or more: walk on from the last layer
            out = _walk(kept(out.distinct()), hop)
        return Frame(out.distinct(), f.info)
    if high == 1:
        return Frame(identity.union(first).distinct(), f.info)
    if high is not None:
        layer, out = first, identity.union(first)
        for _ in range(high - 1):
            layer = layer.join(hop, layer["b"] == hop["m"]).select("a", F.col("c").alias("b")).distinct()
            out = out.union(layer)
        return Frame(out.distinct(), f.info)
    out = reached(step) if start is None else _walk(kept(first), hop)
    return Frame(out.union(identity).distinct() if low == 0 else out, f.info)


def _walk(frontier: DataFrame, hop: DataFrame) -> DataFrame:
    """The pairs of a frontier and all that they lead to; each round is written once."""
    known = [frontier]
    for _ in range(MOST_ROUNDS):
        new = frontier.join(hop, frontier["b"] == hop["m"]).select("a", F.col("c").alias("b")).distinct()
        frontier = kept(new.join(reduce(DataFrame.union, known), ["a", "b"], "left_anti"))
        if frontier.isEmpty():
            return reduce(DataFrame.union, known)
        known.append(frontier)
    raise RuntimeError("a path did not end")


def _bound_ends(so_far: Frame | None, x, info: Info, kind) -> DataFrame | None:
    """The distinct values that a frame has for an end of a path, as the path's edges carry
    them; None where it has none for all rows, or carries them otherwise."""
    if so_far is None or not isinstance(x, Var) or x.name not in so_far.info:
        return None
    i = so_far.info[x.name]
    if not i.bound or i.row != info.row or info.template is not None and i.template != info.template:
        return None
    return so_far.df.select((F.col(x.name) if i.template == info.template else shown(F.col(x.name), i)).cast(kind).alias("a"))


def frame(c, t: Triple, so_far: Frame | None) -> Frame:
    """Solutions of a triple whose predicate is a path. A closure starts from a constant end,
    else from the values that the patterns before have for one."""
    if isinstance(t.p, Repeat):
        e = _uniform(edges(c, t.p.path))
        kind, start, backwards = e.df.schema["a"].dataType, None, False
        for end, x in (("a", t.s), ("b", t.o)):
            i = e.info[end]
            if isinstance(x, Iri):
                value = key_of(i.template, x.value) if i.template else x.value
                start = c.spark.range(1).select(F.lit(value).cast(kind).alias("a"))
            elif not isinstance(t.s, Iri) and not isinstance(t.o, Iri):
                start = _bound_ends(so_far, x, i, kind)
            if start is not None:
                backwards = end == "b"
                break
        f = closure(c, Repeat(Inverse(t.p.path), t.p.low, t.p.high) if backwards else t.p, start)
        if backwards:
            f = Frame(f.df.select(F.col("b").alias("a"), F.col("a").alias("b")), {"a": f.info["b"], "b": f.info["a"]})
    else:
        f = _only(edges(c, t.p))
    df, info = f.df, {}
    for end, x in (("a", t.s), ("b", t.o)):
        if not isinstance(x, Var):
            df = df.where(is_term(F.col(end), f.info[end], x, df.schema[end].dataType.simpleString()))
    if isinstance(t.s, Var) and t.s == t.o:
        df = df.where(F.col("a") == F.col("b"))
        return Frame(df.select(F.col("a").alias(t.s.name)), {t.s.name: f.info["a"]})
    cols = []
    for end, x in (("a", t.s), ("b", t.o)):
        if isinstance(x, Var):
            cols.append(F.col(end).alias(x.name))
            info[x.name] = f.info[end]
    return Frame(df.select(*cols), info)


def components(both: DataFrame, rounds: int = MOST_ROUNDS) -> DataFrame:
    """(a, label): the least node of each node's component. both: distinct pairs (a, b), each in
    both directions, that were kept()."""
    labels = kept(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("label")))
    for _ in range(rounds):  # a label's own label halves the way
        near = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        new = labels.join(near, "a").select("a", F.least("label", "l").alias("next"), F.col("label").alias("old"))
        up = new.select(F.col("a").alias("next"), F.col("next").alias("over"))
        new = kept(new.join(up, "next").select("a", F.least("next", "over").alias("label"), (F.least("next", "over") != F.col("old")).alias("moved")))
        labels = new.select("a", "label")
        if new.where("moved").isEmpty():
            return labels
    raise RuntimeError("components did not end")


def _owed(e: DataFrame, firsts: DataFrame, ends: DataFrame) -> DataFrame:
    """(first, owed): how many of the ends asked for are in the component of a first node, itself
    aside. It can't meet more than these."""
    pairs = e.select("a", "b")
    labels = components(kept(pairs.union(pairs.select("b", "a")).distinct()))
    counts = ends.join(labels, "a").groupBy("label").agg(F.count("*").alias("n"))
    own = ends.select(F.col("a").alias("first"), F.lit(1).alias("own"))
    f = firsts.distinct().join(labels.withColumnRenamed("a", "first"), "first").join(counts, "label", "left").join(own, "first", "left")
    return kept(f.select("first", (F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("owed")))


def shortest(c, p: Shortest, frames: list[Frame] = ()) -> Frame:
    """Paths by breadth: layers of partial paths carry their nodes. single keeps one path to
    each pair of ends (the least list of nodes), all every path of that length; trails all
    paths that use no edge twice. A search goes from a constant end, or from the values that
    `frames`, which its paths will be joined with, have for one. It ends once all ends that are
    asked for are met; a first node goes no further once it has met those of its component."""
    if not isinstance(p.o, Var) and isinstance(p.s, Var):  # against the edges, and turned round
        way = {"out": "in", "in": "out"}.get(p.direction, p.direction)
        f = shortest(c, replace(p, s=p.o, o=p.s, direction=way), frames)
        back = F.struct(F.reverse(F.col(p.path)["nodes"]).alias("nodes"), F.reverse(F.col(p.path)["edges"]).alias("edges"))
        return Frame(f.df.withColumn(p.path, back), f.info)
    parts = [_uniform(edges(c, Iri(i))) for i in p.predicates]
    parts = [Frame(f.df.withColumn("p", F.lit(i)), f.info) for f, i in zip(parts, p.predicates)]
    info = parts[0].info
    e = parts[0].df
    for x in parts[1:]:
        e = e.union(x.df)
    e = e.distinct()
    if p.direction == "in":
        e = e.select(F.col("b").alias("a"), F.col("a").alias("b"), "p")
    elif p.direction == "either":
        e = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "p")).distinct()
    e = kept(e)
    kind = e.schema["a"].dataType

    def asked(x):
        got = next((d for f in frames if (d := _bound_ends(f, x, info["a"], kind)) is not None), None)
        return got if got is None else kept(got.where("a is not null").distinct())

    starts, ends = asked(p.s), asked(p.o)

    def held(df, col, x):
        among = starts if col == "a" else ends
        if among is not None:
            df = df.join(among.toDF(col), col, "left_semi").select(df.columns)
        return df if isinstance(x, Var) else df.where(is_term(F.col(col), info["a"], x, kind.simpleString()))

    hop = e.select(F.col("a").alias("m"), F.col("b").alias("to"), F.col("p").alias("via"))
    edge = F.struct(F.least("last", "to").alias("x"), F.greatest("last", "to").alias("y"), F.col("via").alias("via")) if p.direction == "either" else F.struct(F.col("last").alias("x"), F.col("to").alias("y"), F.col("via").alias("via"))
    begin = held(e.select("a").distinct() if isinstance(p.s, Var) else e.select("a").union(e.select("b")).distinct().toDF("a"), "a", p.s)
    layer = begin.select(F.col("a").alias("first"), F.col("a").alias("last"), F.array("a").alias("nodes"), F.array().cast(f"array<struct<x:{kind.simpleString()},y:{kind.simpleString()},via:string>>").alias("edges"))
    out = seen = owed = None
    n = 0
    while p.high is None or n < p.high:
        n += 1
        layer = layer.join(hop, layer["last"] == hop["m"])
        if p.mode == "trails":
            layer = layer.where(~F.array_contains("edges", edge))
        else:
            layer = layer.where(~F.array_contains("nodes", F.col("to")))
        layer = layer.select("first", F.col("to").alias("last"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("edges", F.array(edge)).alias("edges"))
        if p.mode != "trails":
            if seen is not None:
                layer = layer.join(seen, ["first", "last"], "left_anti")
            if p.mode == "single":  # one way to each end is enough to go on
                layer = layer.groupBy("first", "last").agg(F.min(F.struct("nodes", "edges")).alias("x")).select("first", "last", "x.nodes", "x.edges")
        layer = kept(layer)
        if layer.isEmpty():
            break
        met = p.mode != "trails" and not isinstance(p.o, Var) and n >= p.low and not held(layer, "last", p.o).isEmpty()
        if p.mode != "trails":
            pairs = layer.select("first", "last").distinct()  # of a written layer
            seen = pairs if seen is None else seen.union(pairs)
        if n >= p.low:
            hit = held(layer, "last", p.o)
            out = hit if out is None else out.union(hit)
        if met and not isinstance(p.s, Var):  # one pair of ends, and this was its layer
            break
        if p.mode != "trails" and ends is not None and n >= FREE_LAYERS and (p.high is None or n < p.high):
            if owed is None:
                owed = _owed(e, layer.select("first"), ends)
            met_of = held(seen, "last", p.o).groupBy("first").agg(F.count("*").alias("met"))
            open_ = owed.join(met_of, "first", "left").where("owed > coalesce(met, 0)")
            layer = layer.join(open_, "first", "left_semi")
            if layer.isEmpty():
                break
        if n > MOST_ROUNDS:
            raise RuntimeError("a path search did not end")
    if out is None:
        out = layer.limit(0)
    path = F.struct(F.transform("nodes", lambda x: shown(x, info["a"]).cast("string")).alias("nodes"), F.transform("edges", lambda x: x["via"]).alias("edges"))
    cols, names = [path.alias(p.path)], {p.path: Info("path")}
    for col, x in (("first", p.s), ("last", p.o)):
        if isinstance(x, Var):
            cols.append(F.col(col).alias(x.name))
            names[x.name] = info["a"]
    return Frame(out.select(*cols), names)
