"""Full-text, vector and geographic search."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans.paths import kept

#: BM25's constants.
K1, B = 1.2, 0.75
STOPWORDS = {
    "en": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split(),
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die du ein eine einer es für hat ich im in ist mit nicht oder sie sind so und von war was wie wir zu zum zur".split(),
    "fr": "à au aux avec ce ces dans de des du elle en et il je la le les leur lui ma mais me on ou par pas pour qu que qui sa se ses son sur ta te un une vous".split(),
    "es": "a al como con de del el en es ese la las lo los mi no o para pero por que se si sin su sus un una y".split(),
}


def stems(words: Column) -> Column:
    """English stems of an array of words, made once for each distinct word of a batch."""

    @F.pandas_udf("array<string>")
    def of(rows: pd.Series) -> pd.Series:
        from ..functions.stem import english

        known: dict[str, str] = {}
        get = lambda w: known[w] if w in known else known.setdefault(w, english(w))
        return rows.map(lambda ws: None if ws is None else [get(w) for w in ws])

    return of(words)


def terms(text: Column, language: str | None = "en", stem: bool = False, stop: list[str] | None = None) -> Column:
    """Terms of a text: runs of letters and digits in lower case, without the stop words of the
    language (a tag such as en-GB; a list of one's own for others), as stems if asked for
    (English alone; of other languages words stay whole)."""
    kind = (language or "").lower().partition("-")[0]
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    stop = STOPWORDS.get(kind) if stop is None else stop
    words = F.filter(words, lambda w: ~w.isin(stop)) if stop else words
    return stems(words) if stem and kind == "en" else words


def times(of: Column, word: str) -> Column:
    """How often a term is in an array."""
    return F.size(F.filter(of, lambda x: x == word))


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


class TextIndex:
    """BM25 over texts, or over postings that are kept (term, id, tf, length). A query counts
    its own terms in each text, where they are: nothing is exploded or shuffled but what has
    one of them."""

    def __init__(self, docs: DataFrame, id: str, text: str, language: str | None = "en", stem: bool = False, stop: list[str] | None = None):
        self.analyse, self.postings = (lambda c: terms(c, language, stem, stop)), None
        self.texts = docs.select(F.col(id).alias("id"), self.analyse(F.coalesce(F.col(text), F.lit(""))).alias("terms"))

    @classmethod
    def of_postings(cls, postings: DataFrame, language: str | None = "en", stem: bool = False, stop: list[str] | None = None) -> TextIndex:
        """The index that postings() made, or streaming.feeds.keep_postings() keeps: with t and op,
        only what holds at last counts. A text without terms has no postings, and isn't counted."""
        self = cls.__new__(cls)
        self.analyse, self.texts = (lambda c: terms(c, language, stem, stop)), None
        if "op" in postings.columns:
            last = postings.groupBy("id", "length", "term", "tf").agg(F.max_by("op", "t").alias("op"))
            postings = last.where("op").drop("op")
        self.postings = postings.select("term", "id", "tf", "length")
        return self

    def kept(self) -> DataFrame:
        """The postings of the texts, to be written sorted by term and read by of_postings()."""
        t = self.texts.select("id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
        return t.groupBy("term", "id", "length").agg(F.count("*").alias("tf")).select("term", "id", "tf", "length")

    def wanted(self, spark, query: str) -> list[str]:
        return [r[0] for r in spark.range(1).select(F.explode(F.array_distinct(self.analyse(F.lit(query))))).collect()]

    def statistics(self, query: str) -> tuple[list[str], list[float], float]:
        """The query's terms, their idf, and the mean length of the texts."""
        words = self.wanted(self.texts.sparkSession, query)
        has = [F.count_if(F.array_contains("terms", w)) for w in words]
        got = self.texts.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean"), F.array(*has).alias("df")).first()
        return words, [idf(got.n, d) for d in got.df], float(got.mean or 1)

    def scores(self, query: str) -> DataFrame:
        """(id, score) of all texts with a term of the query, by
        idf = ln(1 + (N - n + 0.5) / (n + 0.5))."""
        df = self.texts if self.texts is not None else self.postings
        words = self.wanted(df.sparkSession, query)
        if not words:
            return df.select("id", F.lit(0.0).alias("score")).limit(0)
        if self.texts is not None:
            tf = [times(F.col("terms"), w) for w in words]
            rows = df.select("id", F.size("terms").alias("length"), F.array(*tf).alias("tf"))
            stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(words))]).alias("df")).first()
        else:
            totals = df.groupBy("id").agg(F.first("length").alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
            hit = df.where(F.col("term").isin(words))
            rows = hit.groupBy("id").agg(F.first("length").alias("length"), F.array(*[F.coalesce(F.sum(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)) for w in words]).alias("tf"))
            found = dict(hit.groupBy("term").count().collect())
            stats = {"n": totals.n, "mean": totals.mean, "df": [found.get(w, 0) for w in words]}
        norm = K1 * (1 - B + B * F.col("length") / F.lit(float(stats["mean"] or 1)))
        parts = [F.lit(w) * F.col("tf")[i] * (K1 + 1) / (F.col("tf")[i] + norm) for i, w in enumerate(idf(stats["n"], d) for d in stats["df"])]
        score = parts[0]
        for x in parts[1:]:
            score = score + x
        return rows.where(F.exists("tf", lambda x: x > 0)).select("id", score.alias("score"))

    def top(self, query: str, k: int = 10) -> DataFrame:
        return self.scores(query).orderBy(F.desc("score"), "id").limit(k)


def vector_top(vectors: DataFrame, id: str, vector: str, query: list[float], k: int = 10, metric: str = "cosine") -> DataFrame:
    """(id, score) of the k best: by cosine or dot product from above, by Euclidean distance
    from below. Exact, by a top-k of each partition."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = {"cosine": S.cosine, "dot": S.dot, "euclidean": S.euclidean}[metric](F.col(vector), q)
    order = F.asc("score") if metric == "euclidean" else F.desc("score")
    return vectors.select(F.col(id).alias("id"), score.alias("score")).where("score is not null").orderBy(order, "id").limit(k)


def around(y: float, x: float, metres: float) -> tuple[float, float, float | None, float | None]:
    """South, north, west and east of the box that holds all within `metres` of a point; west and
    east are None where it would hold a pole or cross the date line."""
    dy = math.degrees(metres / S.EARTH_METRES) * (1 + 1e-9)
    if abs(y) + dy < 90:
        dx = math.degrees(math.asin(min(1.0, math.sin(min(math.pi / 2, metres / S.EARTH_METRES)) / math.cos(math.radians(y))))) * (1 + 1e-9)
        if x - dx >= -180 and x + dx <= 180:
            return y - dy, y + dy, x - dx, x + dx
    return y - dy, y + dy, None, None


def within(points: DataFrame, id: str, lat: str, lon: str, at: tuple[float, float], metres: float, limit: int | None = None) -> DataFrame:
    """(id, distance) of points at most `metres` away, nearest first. A box on the columns
    reaches the scan; the great-circle distance decides."""
    y, x = at
    low, high, left, right = around(y, x, metres)
    box = F.col(lat).between(low, high)
    if left is not None:
        box = box & F.col(lon).between(left, right)
    d = S.haversine(F.col(lat), F.col(lon), F.lit(y), F.lit(x))
    out = points.where(box).select(F.col(id).alias("id"), d.alias("distance")).where(F.col("distance") <= metres).orderBy("distance", "id")
    return out.limit(limit) if limit is not None else out


def cells(lat: Column, lon: Column, degrees: float) -> Column:
    """The grid cell of a point."""
    return F.struct(F.floor(lat / degrees).alias("y"), F.floor(lon / degrees).alias("x"))


def point_in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a point lies in a closed ring, array<struct<lat, lon>>, by crossings."""
    n = F.size(ring) - 1

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        between = (a["lat"] > lat) != (b["lat"] > lat)
        at = a["lon"] + (lat - a["lat"]) / (b["lat"] - a["lat"]) * (b["lon"] - a["lon"])
        return F.when(between & (lon < at), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + crosses(i)) % 2 == 1


def rings(wkt: Column) -> Column:
    """The rings of a WKT polygon, holes among them: array<array<struct<lat, lon>>>."""
    bodies = F.regexp_extract_all(F.regexp_replace(wkt, r"(?i)^\s*polygon\s*\(|\)\s*$", ""), F.lit(r"\(([^()]*)\)"), F.lit(1))
    point = lambda p: F.struct(F.element_at(F.split(F.trim(p), r"\s+"), 2).cast("double").alias("lat"), F.element_at(F.split(F.trim(p), r"\s+"), 1).cast("double").alias("lon"))
    return F.transform(bodies, lambda b: F.transform(F.split(b, ","), point))


def inside(lat: Column, lon: Column, rings_: Column) -> Column:
    """Whether a point lies in a polygon and in none of its holes: an odd number of rings."""
    return F.size(F.filter(rings_, lambda r: point_in_ring(lat, lon, r))) % 2 == 1


def _cut(a: Column, b: Column) -> Column:
    """Whether an edge of the rings of a crosses one of b."""

    def edges(rs: Column) -> Column:
        return F.flatten(F.transform(rs, lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: F.struct(F.get(r, i - 1).alias("p"), F.get(r, i).alias("q")))))

    def side(p, q, r) -> Column:
        return (q["lon"] - p["lon"]) * (r["lat"] - p["lat"]) - (q["lat"] - p["lat"]) * (r["lon"] - p["lon"])

    def cross(x, y) -> Column:
        return (side(x["p"], x["q"], y["p"]) * side(x["p"], x["q"], y["q"]) < 0) & (side(y["p"], y["q"], x["p"]) * side(y["p"], y["q"], x["q"]) < 0)

    other = edges(b)
    return F.exists(F.transform(edges(a), lambda x: F.exists(other, lambda y: cross(x, y))), lambda x: x)


def _celled(shapes: DataFrame, name: str, degrees: float) -> DataFrame:
    """Polygons (id, wkt), a row for each grid cell that their boxes meet."""
    p = shapes.select(F.col("id").alias(name), rings(F.col("wkt")).alias(f"{name}_rings"))
    flat = F.flatten(f"{name}_rings")
    low, high = (lambda c, f=f: F.floor(f(F.transform(flat, lambda q: q[c])) / degrees) for f in (F.array_min, F.array_max))
    return p.withColumn("y", F.explode(F.sequence(low("lat"), high("lat")))).withColumn("x", F.explode(F.sequence(low("lon"), high("lon"))))


def containing(points: DataFrame, polygons: DataFrame, degrees: float = 1.0) -> DataFrame:
    """(point, polygon) of points (id, lat, lon) in polygons (id, wkt) and not in their holes:
    polygons are dealt to the grid cells that their boxes meet, points to theirs, and cells
    are joined on."""
    p = _celled(polygons, "polygon", degrees)
    q = points.select(F.col("id").alias("point"), "lat", "lon", F.floor(F.col("lat") / degrees).alias("y"), F.floor(F.col("lon") / degrees).alias("x"))
    return q.join(p, ["y", "x"]).where(inside(F.col("lat"), F.col("lon"), F.col("polygon_rings"))).select("point", "polygon")


def _boxed(shapes: DataFrame, name: str, degrees: float, outer: bool) -> DataFrame:
    """Polygons (id, wkt) with their boxes and the ranges of grid cells these meet. fit is the box
    of all rings, or of the outer one; upright says that the polygon is its box."""
    once = lambda **cols: F.inline(F.array(F.struct(*[v.alias(k) for k, v in cols.items()])))
    p = shapes.select(F.col("id").alias(name), "wkt").repartition(name)  # a small file is many pairs
    p = p.select(name, once(rings=rings(F.col("wkt"))))  # not parsed anew for each use
    values = lambda points, c: F.transform(points, lambda q: q[c])
    bounds = lambda points: F.struct(*[f(values(points, c)).alias(f"{k}_{c}") for c in ("lat", "lon") for k, f in (("low", F.array_min), ("high", F.array_max))])
    ring = F.get("rings", F.lit(0))
    at = lambda i, c: F.get(ring, F.lit(i))[c]
    turns = [(at(i, c) == at(i + 1, c)) & (at(i, d) != at(i + 1, d)) for c, d in (("lat", "lon"), ("lon", "lat")) for i in range(4)]
    upright = (F.size("rings") == 1) & (F.size(ring) == 5) & (at(0, "lat") == at(4, "lat")) & (at(0, "lon") == at(4, "lon"))
    upright = upright & ((turns[0] & turns[5] & turns[2] & turns[7]) | (turns[4] & turns[1] & turns[6] & turns[3]))
    p = p.select(name, "rings", once(box=bounds(F.flatten("rings")), first=bounds(ring), upright=F.coalesce(upright, F.lit(False))))
    cell = {f"{k}_{c}": F.floor(F.col("box")[f"{b}_{d}"] / degrees) for k, b in (("from", "low"), ("to", "high")) for c, d in (("y", "lat"), ("x", "lon"))}
    fit = "first" if outer else "box"
    return p.select(name, "rings", "upright", *[F.col(fit)[f"{b}_{d}"].alias(f"{b}_{d}") for b in ("low", "high") for d in ("lat", "lon")], *[v.alias(k) for k, v in cell.items()])


def meeting(left: DataFrame, right: DataFrame, how: str = "intersects", degrees: float = 1.0) -> DataFrame:
    """(a, b) of polygons (id, wkt) that intersect, or of which a is `within` b: they meet in a
    grid cell, and their edges and corners decide. Edges that only touch don't cross. A pair is
    tried in one cell alone (the first that both have; that of a's low corner), and only where its
    boxes leave it open; of two upright rectangles these decide by themselves. Polygons are parsed
    once and written; those of one id are one shape."""
    if how not in ("intersects", "within"):
        raise ValueError(f"unknown relation {how}")
    within = how == "within"

    repeated = False

    def dealt(shapes: DataFrame, name: str) -> DataFrame:
        nonlocal repeated
        p = kept(_boxed(shapes, name, degrees, within and name == "a"))
        repeated = repeated or not p.groupBy(name).count().where("count > 1").isEmpty()
        if within and name == "a":  # its low corner is in b
            p = p.withColumns({"from_y": F.floor(F.col("low_lat") / degrees), "from_x": F.floor(F.col("low_lon") / degrees)}).withColumns({"to_y": F.col("from_y"), "to_x": F.col("from_x")})
        p = p.withColumn("y", F.explode(F.sequence("from_y", "to_y"))).withColumn("x", F.explode(F.sequence("from_x", "to_x")))
        return p.drop("to_y", "to_x").withColumnsRenamed({c: f"{name}_{c}" for c in ("rings", "upright", "low_lat", "low_lon", "high_lat", "high_lon", "from_y", "from_x")})

    a, b = dealt(left, "a"), dealt(right, "b")
    c = F.col

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        """Pairs whose boxes don't exclude it, once each."""
        first = [] if within else [c(k) == F.greatest(f"a_from_{k}", f"b_from_{k}") for k in "yx"]
        if within:
            near = [(c(f"b_low_{d}") <= c(f"a_low_{d}")) & (c(f"a_high_{d}") <= c(f"b_high_{d}")) for d in ("lat", "lon")]
        else:
            near = [(c(f"a_low_{d}") <= c(f"b_high_{d}")) & (c(f"b_low_{d}") <= c(f"a_high_{d}")) for d in ("lat", "lon")]
        return a.join(b, ["y", "x"]).where(reduce(Column.__and__, first + near))

    # an upright rectangle holds its low edges and not its high ones, as inside() has it
    held = lambda v, name, d: (c(v) >= c(f"{name}_low_{d}")) & (c(v) < c(f"{name}_high_{d}"))
    corner = lambda x, y: reduce(Column.__and__, [held(f"{x}_low_{d}", y, d) | held(f"{x}_high_{d}", y, d) for d in ("lat", "lon")])
    if within:
        sure = reduce(Column.__and__, [held(f"a_{k}_{d}", "b", d) for k in ("low", "high") for d in ("lat", "lon")])
    else:
        over = reduce(Column.__and__, [(c(f"a_low_{d}") < c(f"b_high_{d}")) & (c(f"b_low_{d}") < c(f"a_high_{d}")) for d in ("lat", "lon")])
        sure = over | corner("a", "b") | corner("b", "a")
    of_a, of_b = c("a_rings"), c("b_rings")
    corners = lambda x, y: F.transform(F.flatten(x), lambda p: inside(p["lat"], p["lon"], y))
    if within:
        hole = F.exists(corners(F.slice(of_b, F.lit(2), F.size(of_b)), F.slice(of_a, F.lit(1), F.lit(1))), lambda x: x)  # a hole of b within a
        fits = F.forall(corners(F.slice(of_a, F.lit(1), F.lit(1)), of_b), lambda x: x) & ~_cut(of_a, of_b) & ~hole
    else:
        fits = F.exists(corners(of_a, of_b), lambda x: x) | F.exists(corners(of_b, of_a), lambda x: x) | _cut(of_a, of_b)
    plain = pairs(a.where("a_upright").drop("a_rings"), b.where("b_upright").drop("b_rings")).where(sure)
    other = pairs(a.where("not a_upright"), b).unionByName(pairs(a.where("a_upright"), b.where("not b_upright"))).where(fits)
    out = plain.select("a", "b").union(other.select("a", "b"))
    return out.distinct() if repeated else out


def nearby(points: DataFrame, at: DataFrame, metres: float) -> DataFrame:
    """(point, place, distance) of points (id, lat, lon) at most `metres` from places of the same
    columns: both are dealt to grid cells of that height, places to those around them too."""
    degrees = max(math.degrees(metres / S.EARTH_METRES) * (1 + 1e-9), 1e-6)
    # a band of latitude is cut into as many cells as the one next to it, nearer to the pole, has
    # room for; around a pole it is one cell
    band = lambda lat: F.when(lat < 89.9, F.greatest(F.floor(360 * F.cos(F.radians(lat)) / degrees) - 1, F.lit(1))).otherwise(F.lit(1))
    edge = lambda y: F.greatest(F.abs(y * degrees), F.abs((y + 1) * degrees)) + degrees
    row = lambda lat: F.floor(lat / degrees)
    cell = lambda lon, y: F.floor((lon + 180) / 360 * band(edge(y)))
    p = points.select(F.col("id").alias("point"), "lat", "lon", row(F.col("lat")).alias("y"))
    p = p.withColumn("x", F.pmod(cell(F.col("lon"), F.col("y")), band(edge(F.col("y")))))
    q = at.select(F.col("id").alias("place"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), row(F.col("lat")).alias("y0"))
    q = q.withColumn("y", F.explode(F.array(*[F.col("y0") + i for i in (-1, 0, 1)])))
    q = q.withColumn("x", F.explode(F.array_distinct(F.array(*[F.pmod(cell(F.col("lon2"), F.col("y")) + i, band(edge(F.col("y")))) for i in (-1, 0, 1)]))))
    d = S.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return p.join(q.select("place", "lat2", "lon2", "y", "x"), ["y", "x"]).select("point", "place", d.alias("distance")).where(F.col("distance") <= metres)
