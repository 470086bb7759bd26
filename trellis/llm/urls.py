"""URL filters: fixed rules of hosts, and association rules mined from the URLs they label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, written

#: (rule, verdict): host and the start of the path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(c: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(c, UPPER, LOWER)


def host(url: Column) -> Column:
    return F.coalesce(lower(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits the host or a domain above it and the path's start."""
    out = F.lit(None).cast("string")
    for rule in sorted((r for r, _ in rules), key=len):
        domain, cut, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(cut + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: words of the host by label, domains, parts of the path
    and keys of the query. Numbers are one token."""
    labels = F.split(host, r"\.")
    tail = F.when(F.size(labels) > 1, F.concat(F.lit("d:"), F.element_at(labels, -2), F.lit("."), F.element_at(labels, -1)))
    names = F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.filter(F.split(host, r"[.\-]"), lambda x: x != ""), lambda x: F.concat(F.lit("w:"), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(lower(x))))
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    every = F.concat(names, words, parts, F.coalesce(keys, F.array().cast("array<string>")), F.array(tail))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull()))


def standing(items: Column, same: dict[str, str]) -> Column:
    """Tokens with those of `same` by the one that stands for them."""
    if not same:
        return items
    ones = F.create_map(*[F.lit(x) for r in sorted(same.items()) for x in r])
    return F.array_distinct(F.transform(items, lambda x: F.coalesce(F.try_element_at(ones, x), x)))


def mine(labelled: DataFrame, rows: int = 50_000, support: float = 0.01, confidence: float = 0.9) -> tuple[DataFrame, dict[str, str]]:
    """Association rules (rule long, items array<string>, verdict, confidence, support) from
    `labelled` (id, items, verdict), of which the `rows` rows of the least hashes are used, and
    the tokens for which others stand in them. FP-growth mines
    frequent sets of tokens and a verdict; rules of any length with a verdict as consequent remain if
    their support and confidence are high enough, for pruned() to choose from. Sets whose rules
    it would drop for a shorter one aren't mined: a token with one verdict only is a rule by
    itself, and of tokens on the same rows one stands for all."""
    mark = F.concat(F.lit("="), F.col("verdict"))
    bounded = written(labelled.select("items", mark.alias("mark"), F.xxhash64("id").alias("h")).orderBy("h").limit(rows).repartition(16, "h"))
    n = bounded.count()
    h = [F.sum(x.cast("decimal(38)")) for x in (F.col("h"), F.xxhash64("h", F.lit(1)))]
    by = bounded.select(F.explode("items").alias("item"), "mark", "h").groupBy("item").agg(F.count("*").alias("n"), F.min("mark").alias("low"), F.max("mark").alias("high"), F.struct(*h).alias("on"))
    frequent = by.where(F.col("n") >= n * support).collect()  # as many as a row's tokens by 1 / support at most
    pure = [(r.item, r.low[1:], r.n / n) for r in frequent if r.low == r.high]
    alone = labelled.sparkSession.createDataFrame(pure, "item string, verdict string, support double").select(F.array("item").alias("items"), "verdict", F.lit(1.0).alias("confidence"), "support")
    first: dict[tuple, str] = {}
    mixed = sorted((r for r in frequent if r.low != r.high), key=lambda r: r.item)
    same = {r.item: one for r in mixed if (one := first.setdefault((r.n, *r.on), r.item)) != r.item}
    known = F.array(*[F.lit(r.item) for r in mixed]) if mixed else F.array().cast("array<string>")
    sets = bounded.select(F.concat(standing(F.array_intersect("items", known), same), F.array("mark")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(sets).associationRules
    verdict = F.element_at("consequent", 1)
    clean = found.where(verdict.startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("=")))
    return clean.select(F.array_sort("antecedent").alias("items"), F.substring(verdict, 2, 20).alias("verdict"), "confidence", "support").unionByName(alone), same


def pruned(rules: DataFrame) -> DataFrame:
    """Without the rules that a shorter rule of their tokens says at least as surely, numbered."""
    r = written(rules.withColumn("rule", F.xxhash64("items", "verdict")))
    items = r.select("rule", "verdict", "confidence", F.size("items").alias("n"), F.explode("items").alias("item"))
    both = items.alias("a").join(items.alias("b"), (F.col("a.item") == F.col("b.item")) & (F.col("a.verdict") == F.col("b.verdict")) & (F.col("a.n") < F.col("b.n")) & (F.col("a.confidence") >= F.col("b.confidence")))
    worse = both.groupBy(F.col("a.rule"), F.col("b.rule").alias("worse"), F.col("a.n")).count().where(F.col("count") == F.col("n")).select(F.col("worse").alias("rule")).distinct()
    return r.join(worse, "rule", "left_anti")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, default: str = "allow") -> DataFrame:
    """A verdict on each URL: of the longest fixed rule that fits, else of the mined rules.

    URLs that a fixed rule fits are the labels. Mined rules are looked up by an inverted
    index from tokens to rules: a rule applies where all its tokens are; of those the surest,
    then best supported, then the one with more tokens, then the blocking one decides, and
    without any `default`.

    pages: page_id, url; other columns, of whatever names, are ignored. Very long URLs are
    taken whole. A null URL, and one without ://, has an
    empty host and path, no rule and the verdict `default`. Repeated rows are judged each; no
    rows give no rows.

    Returns page_id, host, path, rule string (of the fixed ones, else null), verdict string.
    """
    seen = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    seen = seen.withColumn("rule", ruled(F.col("host"), F.col("path"), rules))
    verdict = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in r]), F.col("rule"))
    own = tokens(F.col("host"), F.col("path"), F.col("url"))
    mined, same = mine(seen.where(F.col("rule").isNotNull()).select(F.col("url").alias("id"), own.alias("items"), verdict.alias("verdict")))
    learnt, own = pruned(mined), F.array_sort(standing(own, same))
    # equal token lists are judged once, which also takes hot hosts together
    asked = seen.where(F.col("rule").isNull() & (F.col("host") != "")).select(own.alias("items")).distinct()
    index = written(learnt.select("rule", "verdict", "confidence", "support", F.size("items").alias("n"), F.explode("items").alias("item")))
    hit = joined(asked.select("items", F.explode("items").alias("item")), index, "item", index.count()).groupBy("items", "rule").agg(F.count("*").alias("got"), F.first("n").alias("n"), F.first("verdict").alias("verdict"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    best = written(hit.where("got = n").groupBy("items").agg(F.max_by("verdict", F.struct("confidence", "support", "n", "verdict")).alias("mined")))
    # rows that the mined rules don't judge aren't joined: their items would all be null
    mined = joined(seen.where(F.col("rule").isNull() & (F.col("host") != "")).select("page_id", "host", "path", "rule", own.alias("items")), best, "items", best.count(), "left")
    others = seen.where(F.col("rule").isNotNull() | (F.col("host") == "")).select("page_id", "host", "path", "rule", F.lit(None).cast("string").alias("mined"))
    out = mined.select("page_id", "host", "path", "rule", "mined").union(others)
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict, F.col("mined"), F.lit(default)).alias("verdict"))
