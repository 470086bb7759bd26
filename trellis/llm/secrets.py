"""Secret scans: fixed patterns, and Markov models of random strings against identifiers."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

# The base patterns, in the order of their kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # as AKIA[A-Z0-9]+ of 16 or more, whose shorter matches hide no other
HEX = r"[0-9a-f]{32,}"  # likewise of [0-9a-f]+
KINDS = ("assign", "access", "hex", "random")

#: Runs that the models judge, and the symbols they know; all else is one more symbol.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Whether a text has such a run (each hex span is in one); looked for at the starts of runs only.
LONG_RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20}"
#: Words that ordinary identifiers are made of.
PARTS = """get set user name value list index count file path time data type key error config parse string number object default response
    request handler manager controller identifier very long case create update delete find filter map reduce buffer stream reader writer
    server client session message event queue table column row query result field module package version build test""".split()
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def let(value: Column, body) -> Column:
    """`body` of a value that is made once; within the lambdas of a higher-order function an
    expression is made again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, total, combine, chunk: int = 64) -> Column:
    """`total` (of an array) over the first 1, 2, ... values: over chunks, then within them, so
    that long arrays take little more than proportional time."""
    upto = lambda last: F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    parts = lambda v: F.transform(upto(F.floor((F.size(v) - 1) / chunk).cast("int")), lambda i: F.slice(v, i * chunk + 1, F.lit(chunk)))
    within = lambda p, before: F.transform(F.sequence(F.lit(1), F.size(p)), lambda j: combine(before, total(F.slice(p, F.lit(1), j))))
    before = lambda tops: F.transform(tops, lambda _, k: F.when(k > 0, total(F.slice(tops, F.lit(1), k))).otherwise(F.lit(0)))
    return let(values, lambda v: let(parts(v), lambda ps: F.flatten(F.zip_with(ps, let(F.transform(ps, total), before), lambda p, b: let(b, lambda b_: within(p, b_))))))


def added(c: Column) -> Column:
    return F.aggregate(c, F.lit(0), lambda a, x: a + x)


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, tok>>: leftmost non-overlapping matches by code points, with
    group `group` of each. The text between the matches gives their places."""
    between, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    got = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    ends = running(F.zip_with(F.slice(between, F.lit(1), F.size(whole)), whole, lambda x, y: F.char_length(x) + F.char_length(y)), added, lambda a, b: a + b)
    rows = F.arrays_zip(ends.alias("end"), F.transform(whole, F.char_length).alias("size"), got.alias("tok"))
    return F.transform(rows, lambda x: F.struct((x["end"] - x["size"]).alias("start"), x["end"].alias("end"), x["tok"].alias("tok")))


def found(text: Column, pattern: str, least: int, quick: Column, group: int = 0) -> Column:
    """spans() whose group has `least` characters or more. Most texts fail the cheaper test
    `quick`, and have none."""
    none = F.array().cast("array<struct<start:int,end:int,tok:string>>")
    return F.when(quick, F.filter(spans(text, pattern, group), lambda x: F.char_length(x["tok"]) >= least)).otherwise(none)


#: Symbols by code of character; 0 is any other.
PLACES = [SYMBOLS.find(chr(i)) + 1 for i in range(128)]
#: Characters of a text or token that are worked on together.
PIECE = 1024


def pairs(tok: Column) -> Column:
    """Numbers of the pairs of neighbouring characters of an ASCII string."""
    at = F.array(*[F.lit(x) for x in PLACES])
    codes = F.transform(F.split(tok, ""), lambda c: F.coalesce(F.get(at, F.ascii(c)), F.lit(0)))
    n = F.char_length(tok) - 1
    return F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * (len(SYMBOLS) + 1) + b)


def hashes(spark: SparkSession) -> DataFrame:
    """tok string: random strings, hashes in hexadecimal of both cases and in base 64."""
    ids = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("x"))
    return ids.select(F.explode(F.array(F.col("x"), F.upper("x"), F.regexp_replace(F.base64(F.unhex("x")), "=", ""), F.substring(F.base64(F.unhex(F.reverse("x"))), 1, 40))).alias("tok"))


def common_names() -> list[str]:
    """Identifiers of two PARTS each."""
    forms = lambda a, b: (a + b.capitalize(), f"{a.capitalize()}{b.capitalize()}2", f"{a}_{b}", f"{a}-{b}", f"{a}_{b}".upper(), f"{a}/{b}")
    return [x for a in PARTS for b in PARTS for x in forms(a, b)]


def words_of(docs: DataFrame, rows: int) -> DataFrame:
    """w array<string>: the words of letters of `rows` documents with more than three, those of
    the least hashes of doc_id (of equal ones, of the text)."""
    h = F.xxhash64(F.col("doc_id").cast("string"))
    cut = docs.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]  # ids alone are sorted
    some = docs.where((h <= F.lit(cut)) & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), h.alias("h"))
    some = some.orderBy("h", F.xxhash64("text"), "text").limit(rows).repartition(32, "h", "text")
    return written(some.select(F.regexp_extract_all("text", F.lit(r"(?<![\w+/=-])[A-Za-z]{3,}(?![\w+/=-])"), F.lit(0)).alias("w")).where(F.size("w") > 3))


def identifier_pairs(words: DataFrame) -> Counter:
    """How often two characters stand side by side in the words, and in each two neighbouring
    words joined as a_b, aB2 and A-B. Words are counted first; forms are made of the counts."""
    spread = words.select(F.posexplode("w").alias("i", "x"), F.size("w").alias("n"), "w")
    spread = spread.select("x", (F.col("i") < F.col("n") - 1).cast("int").alias("first"), (F.col("i") > 0).cast("int").alias("second"), F.when(F.col("i") > 0, F.concat(F.substring(F.lower(F.get("w", F.col("i") - 1)), -1, 1), F.upper(F.substring("x", 1, 1)))).alias("seam"))
    counted = spread.groupBy("x").agg(F.count("*").alias("any"), F.sum("first").alias("first"), F.sum("second").alias("second"))
    chars = F.split("x", "")
    inner = F.zip_with(F.slice(chars, F.lit(1), F.char_length("x") - 1), F.slice(chars, F.lit(2), F.char_length("x") - 1), lambda a, b: F.concat(a, b))
    sums = [F.sum(c).alias(c) for c in ("any", "first", "second")]
    seen = counted.select(F.posexplode(inner).alias("i", "pair"), "any", "first", "second").groupBy("pair", (F.col("i") == 0).alias("head")).agg(*sums).collect()
    ends = counted.groupBy(F.substring("x", 1, 1).alias("a"), F.substring("x", -1, 1).alias("z")).agg(*sums).collect()
    seams = spread.where("seam is not null").groupBy("seam").count().collect()  # at most 52 * 52 rows, as the others
    out: Counter = Counter({r.seam: r["count"] for r in seams})
    for r in seen:
        p = r.pair
        out[p] += r.any + r.first + r.second  # the word itself, a_, _b
        out[p.lower()] += r.first  # aB2
        out[p.capitalize() if r.head else p.lower()] += r.second
        out[p.upper()] += r.first + r.second  # A-B
    for r in ends:
        out[r.z + "_"] += r.first
        out[r.z.upper() + "-"] += r.first
        out["_" + r.a] += r.second
        out["-" + r.a.upper()] += r.second
        out[r.z.lower() + "2"] += r.second
    return out


def train(docs: DataFrame, rows: int = 2000) -> list[float]:
    """Log-likelihood ratios of a random string against an identifier by pair of characters,
    from the conditional frequencies of the samples' pairs, each with two counts spread as
    the characters by themselves are. Random strings are hashes(). Ordinary identifiers are
    taken to be the words of at most `rows` documents, alone and joined, and common_names();
    the few secrets among them are a small part of their pairs."""
    n, number = len(SYMBOLS) + 1, lambda p: PLACES[ord(p[0])] * (len(SYMBOLS) + 1) + PLACES[ord(p[1])]
    count = {True: [0] * n * n, False: [0] * n * n}
    for r in hashes(docs.sparkSession).select(F.explode(pairs(F.col("tok"))).alias("pair")).groupBy("pair").count().collect():
        count[True][r.pair] += r["count"]
    for p, c in identifier_pairs(words_of(docs, rows)).items():
        count[False][number(p)] += c
    for x in common_names():
        for p in zip(x, x[1:]):
            count[False][number(p)] += 1
    given = {}
    for k, c in count.items():
        alone = [sum(c[j::n]) + 0.5 for j in range(n)]
        given[k] = [(c[p] + 2 * alone[p % n] / sum(alone)) / (sum(c[p // n * n : p // n * n + n]) + 2) for p in range(n * n)]
    return [math.log(given[True][p] / given[False][p]) for p in range(n * n)]


def merged(found: Column) -> Column:
    """array<struct<start, end>>: the union of spans that are sorted by start."""

    def union(far: Column) -> Column:
        """far: the greatest end so far. A span begins a stretch where all before it have
        ended; the stretch ends where the next begins."""
        rows = F.transform(found, lambda x, i: F.struct(x["start"].alias("start"), i.alias("i")))
        begins = F.filter(rows, lambda x: (x["i"] == 0) | (x["start"] >= F.get(far, x["i"] - 1)))
        last = lambda bs, k: F.get(far, F.coalesce(F.get(bs, k + 1)["i"], F.size(far)) - 1)
        return let(begins, lambda bs: F.transform(bs, lambda x, k: F.struct(x["start"].alias("start"), last(bs, k).alias("end"))))

    return let(running(F.transform(found, lambda x: x["end"]), F.array_max, F.greatest), union)


def pieced(text: Column) -> Column:
    """A text in pieces of PIECE characters, for cut()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(whole: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text in pieces, without a walk from its start."""
    first = F.floor(start / PIECE).cast("int")
    some = F.array_join(F.slice(whole, first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(some, start - first * PIECE + 1, end - start)).otherwise(F.lit(""))


def around(whole: Column, stretches: Column, length: Column) -> Column:
    """array<string>: what stands before, between and behind the stretches of a text."""
    edge = lambda i: F.struct(F.coalesce(F.get(stretches, i - 1)["end"], F.lit(0)).alias("a"), F.coalesce(F.get(stretches, i)["start"], length).alias("b"))
    return F.transform(F.sequence(F.lit(0), F.size(stretches)), lambda i: cut(whole, edge(i)["a"], edge(i)["b"]))


def scan(docs: DataFrame, ratios: list[float], least: float = 1.5) -> DataFrame:
    """The columns of docs in a struct `row`, the text `t`, and `spans`: array<struct<start,
    end, kind>> of all spans, by start and then kind; `base` has those of the first kinds. Runs
    are sought where base spans are blanked out: one is random if its mean log-likelihood
    ratio by pair is `least` or more."""
    ratio = F.split(F.lit(",".join(f"{x:.5g}" for x in ratios)), ",").cast("array<double>")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    rows = rows.withColumn("long_run", t.rlike(LONG_RUN))
    rows = rows.select("row", "t", "long_run", found(t, ASSIGN, 8, F.when(t.contains("=") | t.contains(":"), t.rlike(ASSIGN)).otherwise(F.lit(False)), 1).alias("k0"), found(t, ACCESS, 16, t.contains("AKIA")).alias("k1"), found(t, HEX, 32, F.col("long_run")).alias("k2"))
    tag = lambda c, kind: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    rows = rows.select("row", "t", "long_run", F.array_sort(F.concat(*[tag(F.col(f"k{i}"), i) for i in range(3)])).alias("base"))
    blank = F.col("long_run") & (F.size("base") > 0)
    rows = rows.select("row", "t", "long_run", "base", F.when(blank, merged(F.col("base"))).alias("gone"), F.when(blank, pieced(t)).alias("whole"))
    blanks = F.transform("gone", lambda x: F.repeat(F.lit(" "), x["end"] - x["start"]))
    left = F.array_join(F.zip_with(around(F.col("whole"), F.col("gone"), F.char_length(t)), blanks, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
    rows = rows.select("row", "t", "long_run", "base", F.when(blank, left).otherwise(t).alias("rest"))
    rows = rows.select("row", "t", "base", found(F.col("rest"), CANDIDATE, 20, F.col("long_run")).alias("runs"))

    def total(tok: Column) -> Column:
        return F.aggregate(pairs(tok), F.lit(0.0), lambda a, p: a + F.get(ratio, p))

    def odd(x: Column) -> Column:
        part = lambda ps: F.transform(ps, lambda p, i: total(F.concat(p, F.coalesce(F.substring(F.get(ps, i + 1), 1, 1), F.lit("")))))
        long = F.aggregate(let(pieced(x["tok"]), part), F.lit(0.0), lambda a, y: a + y)
        return F.when(F.char_length(x["tok"]) > PIECE, long).otherwise(total(x["tok"])) >= least * (F.char_length(x["tok"]) - 1)

    more = F.when(F.size("runs") > 0, tag(F.filter("runs", odd), 3)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return rows.select("row", "t", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def _joined(c: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """The secrets in each whole text.

    Base spans are the leftmost non-overlapping matches of ASSIGN (whose value has 8
    characters or more), ACCESS and HEX. Beside them, runs of CANDIDATE, or pieces of
    20 characters or more that base spans leave of them, that look
    more like random strings than like identifiers are spans of kind `random`.

    docs: doc_id, text; other columns, of whatever names, are ignored. Null and empty texts
    have no spans (and the hash of the empty string); repeated rows are scanned each; very
    long texts, runs and many spans take time about proportional to their length; no rows
    give no rows.

    Returns doc_id, n_assign, n_access, n_hex, n_random long, base_sha256 string (of
    kind:start:end of base spans, by start, then kind), spans string (of all, likewise).
    """
    rows = scan(docs, train(docs))
    of = lambda i: F.filter("spans", lambda x: x["kind"] == i)
    count = [F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("row.doc_id", *count, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The rows of docs with `mark` in place of secrets, overlapping ones taken together, and
    n_chars, if there, as the text then is. Rows without secrets stay as they are."""
    rows = scan(docs, train(docs))
    rows = rows.withColumn("gone", F.when(F.size("spans") > 0, merged(F.col("spans")))).withColumn("whole", F.when(F.size("spans") > 0, pieced(F.col("t"))))
    left = F.array_join(around(F.col("whole"), F.col("gone"), F.char_length("t")), mark)
    text = F.when(F.size("spans") > 0, left).otherwise(F.col("row.text"))
    rows = rows.select("row", text.alias("t"), (F.size("spans") > 0).alias("hit"))
    new = {"text": F.col("t"), "n_chars": F.when(F.col("hit"), F.char_length("t")).otherwise(F.col("row.n_chars")).cast("long")} if "n_chars" in docs.columns else {"text": F.col("t")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"row.{c}").alias(c) for c in docs.columns])
