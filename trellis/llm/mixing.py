"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

#: Bits of the three nested histogram levels; the hash has their sum.
LEVELS = (10, 9, 9)


def source_targets(totals: DataFrame, weights: Sequence[float], budget: float, max_repeat: float) -> DataFrame:
    """Targets of sources (skey, source_size): shares of `budget` times all sizes by weight,
    each at most `max_repeat` times its source's size, the excess going to the others by
    weight. Sorting the sources by the level at which each meets its limit gives the fixed
    point in one pass. The table has one row a source."""
    every = Window.partitionBy()
    fill = Window.orderBy("level", "skey")
    n = len(weights)
    by_rank = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(Window.orderBy("skey")) - 1) % n + 1).cast("int"))
    t = totals.withColumn("w", by_rank).withColumn("top", F.col("source_size") * F.lit(float(max_repeat)))
    t = t.withColumn("level", F.col("top") / F.col("w")).withColumn("pool", F.sum("source_size").over(every) * F.lit(float(budget)))
    t = t.withColumn("before", F.sum("top").over(fill) - F.col("top")).withColumn("weight_left", F.sum("w").over(every) - F.sum("w").over(fill) + F.col("w"))
    t = t.withColumn("full", F.col("level") <= (F.col("pool") - F.col("before")) / F.col("weight_left"))
    t = t.withColumn("rate", (F.col("pool") - F.coalesce(F.sum(F.when(F.col("full"), F.col("top"))).over(every), F.lit(0.0))) / F.sum(F.when(~F.col("full"), F.col("w"))).over(every))
    return t.select("skey", "source_size", F.when(F.col("full"), F.col("top")).otherwise(F.col("w") * F.col("rate")).alias("target"))


def keyed(docs: DataFrame, *keep) -> DataFrame:
    """skey, size and the levels of the hash of each row, beside the columns `keep`."""
    bits = sum(LEVELS)
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, bits // 4), 16, 10).cast("long")
    skey = F.when(F.col("source").isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    left, cuts = bits, []
    for i, b in enumerate(LEVELS):
        left -= b
        cuts.append((F.shiftright(h, left) % (1 << b)).cast("int").alias(f"b{i}"))
    return docs.select(*keep, skey.alias("skey"), word_count(F.col("text")).alias("size"), *cuts)


def thresholds(narrow: DataFrame, weights: Sequence[float], budget: float, max_repeat: float) -> DataFrame:
    """A row for each source: its target, the copies that all its documents get, the place
    t0, t1, t2 of its threshold (null: no document gets one more), what is needed of the
    rows there (need_left) and their size (edge)."""
    hist = written(narrow.groupBy("skey", "b0").agg(F.sum("size").alias("s")))
    goal = source_targets(hist.groupBy("skey").agg(F.sum("s").alias("source_size")), weights, budget, max_repeat)
    goal = goal.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = written(goal.withColumn("need", F.col("target") - F.col("copies") * F.col("source_size")))
    cut, rows = goal.select("skey", "need"), narrow
    for i in range(len(LEVELS)):
        if i:  # only the boundary bucket again
            at = cut.select("skey", f"t{i - 1}")
            rows = rows.join(at, "skey").where(F.col(f"b{i - 1}") == F.col(f"t{i - 1}")).select("skey", "size", *[f"b{j}" for j in range(i, len(LEVELS))])
            hist = rows.groupBy("skey", f"b{i}").agg(F.sum("size").alias("s"))
        upto = F.sum("s").over(Window.partitionBy("skey").orderBy(f"b{i}"))
        edge = hist.withColumn("below", upto - F.col("s")).join(cut, "skey").where((F.col("below") <= F.col("need")) & (F.col("need") < F.col("below") + F.col("s")))
        cut = written(edge.select("skey", *[f"t{j}" for j in range(i)], F.col(f"b{i}").alias(f"t{i}"), (F.col("need") - F.col("below")).alias("need"), F.col("s").alias("edge")))
    return goal.drop("need").join(cut.withColumnRenamed("need", "need_left"), "skey", "left")


def _side() -> tuple[Column, Column]:
    """Whether a row lies under its source's threshold, or at it."""
    here = F.struct(*[F.col(f"b{i}").alias(f"x{i}") for i in range(len(LEVELS))])
    there = F.struct(*[F.col(f"t{i}").alias(f"x{i}") for i in range(len(LEVELS))])
    return F.col("t0").isNotNull() & (here < there), F.col("t0").isNotNull() & (here == there)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """How many words of each document the mix takes.

    Every document of a source is taken `floor(target / size of source)` times; what is then
    missing comes from the documents whose hash of doc_id lies under the source's threshold.
    The threshold is found by nested histograms: sums by source and the hash's first bits,
    then only the boundary bucket again by the next bits. No document is sorted, and a hot
    source is summed before it is shuffled. Rows at the threshold itself (one document, or
    repeated rows of one doc_id) share what is left by size, rounded down to words.

    docs: doc_id, text, source; other columns are ignored. Null or empty texts have size 0
    and nothing is taken of them; a null source is a source of its own, ordered last; a null
    doc_id hashes as the empty string. No rows give no rows. Reruns agree.

    Returns doc_id, source, size long, source_size long, target double, taken long.
    """
    narrow = written(keyed(docs, "doc_id", "source"))
    under, at = _side()
    share = F.floor(F.col("size") * F.col("need_left") / F.col("edge"))
    extra = F.when(under, F.col("size")).when(at, share).otherwise(F.lit(0))
    out = narrow.join(thresholds(narrow, weights, budget, max_repeat), "skey")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size") + extra).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """The documents of the mix themselves, with all columns of `docs`, each as often as it
    is taken. As mix(), but of whole documents: rows at a threshold are taken if at least
    half of their words are needed."""
    narrow = written(keyed(docs))
    under, at = _side()
    extra = F.when(under | (at & (F.col("need_left") * 2 >= F.col("edge"))), F.lit(1)).otherwise(F.lit(0))
    rows = keyed(docs, F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    out = rows.join(thresholds(narrow, weights, budget, max_repeat), "skey")
    out = out.select("row", (F.col("copies") + extra).cast("int").alias("n")).where("n > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


#: The rows of mix() in DuckDB, by sorting.
ORACLE = """
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS skey,
    CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 7) AS BIGINT) AS h FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS top FROM s),
l AS (SELECT *, top / w AS level, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS pool FROM w),
f AS (SELECT *, level <= (pool - (sum(top) OVER o - top)) / (sum(w) OVER () - sum(w) OVER o + w) AS isfull FROM l WINDOW o AS (ORDER BY level, skey)),
r AS (SELECT *, (pool - COALESCE(sum(CASE WHEN isfull THEN top END) OVER (), 0.0::DOUBLE)) / sum(CASE WHEN NOT isfull THEN w END) OVER () AS rate FROM f),
t AS (SELECT skey, source_size, CASE WHEN isfull THEN top ELSE w * rate END AS target FROM r),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
b AS (SELECT skey, h, CAST(sum(size) AS BIGINT) AS edge FROM d GROUP BY skey, h),
c AS (SELECT *, CAST(sum(edge) OVER (PARTITION BY skey ORDER BY h) AS BIGINT) - edge AS below FROM b),
e AS (SELECT c.skey, c.h AS th, c.edge, g.target - g.copies * g.source_size - c.below AS need_left FROM c JOIN g USING (skey)
    WHERE c.below <= g.target - g.copies * g.source_size AND g.target - g.copies * g.source_size < c.below + c.edge)
SELECT d.doc_id, d.size, g.source_size, g.target,
    CAST(copies * size + CASE WHEN th IS NULL OR h > th THEN 0 WHEN h < th THEN size ELSE floor(size * need_left / edge) END AS BIGINT) AS taken
FROM d JOIN g USING (skey) LEFT JOIN e USING (skey)"""
