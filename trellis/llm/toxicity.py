"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pieces, small_batches, trim

#: Insults to start with; training adds the words that its labels show.
INSULTS = """idiot moron stupid dumb loser scum trash garbage pathetic worthless disgusting clown fool jerk creep pig
    bastard bitch asshole shit fuck fucking cunt whore slut retard vermin filth coward liar hate kill die
    idiota imbecil estúpido basura asqueroso puta mierda cabrón dummkopf arschloch scheiße trottel abschaum
    hure wichser connard salope merde imbécile ordure pute crétin abruti""".split()
SECOND_PERSON = set("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti usted ustedes tú vosotros".split())
#: Signs put in the place of letters.
DISGUISE = str.maketrans("013457@$!", "oleastasi", "*._-")
WORD = re.compile(r"[^\W\d_]+")
#: From the start of a run of letters, which is tried once however long it is.
MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0-9@$*!][\w@$*!]*[^\W_]")
LONG = re.compile(r"([^\W\d_])\1\1")
NAMES = """log_words seed_rate seed_hits own_rate own_hits own_weight own_top own_kinds near_you you_rate capitals capital_words
    exclaims questions marks digits non_ascii masked masked_hits stretched distinct word_length line_length""".split()


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The features NAMES of a whole text. An empty text has zeros."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = max(1, len(raw))
    words = WORD.findall(text.lower())
    n = max(1, len(words))
    kinds = set(words)
    own, seeds = kinds & lexicon.keys(), kinds & SEEDS
    hits, near = Counter(), 0
    you = kinds & SECOND_PERSON
    if own or seeds or you:
        hit = own | seeds
        at = [i for i, w in enumerate(words) if w in hit]
        hits.update(words[i] for i in at)
        if you:
            near = sum(any(w in SECOND_PERSON for w in words[max(0, i - 5) : i + 6]) for i in at)
            hits["you"] = sum(w in SECOND_PERSON for w in words)
    masked = MASKED.findall(text) if by[48:58].sum() + by[33] + by[36] + by[42] + by[64] else []
    plain = [m.lower().translate(DISGUISE) for m in masked]
    own_n, seed_n = sum(hits[w] for w in own), sum(hits[w] for w in seeds)
    return [
        math.log1p(len(words)), seed_n / n, seed_n, own_n / n, own_n, sum(hits[w] * lexicon[w] for w in own) / n, max((lexicon[w] for w in own), default=0.0), len(own | seeds),
        near, hits["you"] / n, by[65:91].sum() / chars, len(re.findall(r"\b[A-Z]{2,}\b", text)) / n if by[65:91].sum() else 0.0,
        by[33] / chars, by[63] / chars, (by[35:48].sum() + by[58:65].sum()) / chars, by[48:58].sum() / chars, by[128:].sum() / chars,
        len(masked) / n, sum(p in SEEDS or p in lexicon for p in plain), len(LONG.findall(text)) / n, len(kinds) / n, sum(map(len, kinds)) / max(1, len(kinds)), chars / (1 + by[10]),
    ]


SEEDS = frozenset(INSULTS)


class Trees:
    """Gradient boosting of the logistic loss with histograms of at most 48 bins a feature."""

    BINS = 48

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.15, least: int = 12, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.least, self.ridge = rounds, depth, rate, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.BINS)))[1:] for j in range(m)]
        binned = self.bins(x)
        offset = binned + np.arange(m) * (self.BINS + 1)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start, self.trees = math.log(share / (1 - share)), []
        score = np.full(n, self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            tree = np.zeros((2 ** (self.depth + 1) - 1, 3))  # feature or -1, last bin of the left, value
            tree[:, 0] = -1
            todo = [(0, np.arange(n))]
            for _level in range(self.depth + 1):
                later = []
                for k, rows in todo:
                    tree[k, 2] = -g[rows].sum() / (h[rows].sum() + self.ridge)
                    node[rows] = k
                    if _level == self.depth or len(rows) < 2 * self.least:
                        continue
                    flat, size = offset[rows].ravel(), m * (self.BINS + 1)
                    gs, hs, cs = (np.cumsum(np.bincount(flat, np.repeat(v, m), size).reshape(m, -1), axis=1) for v in (g[rows], h[rows], np.ones(len(rows))))
                    gain = gs**2 / (hs + self.ridge) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + self.ridge)
                    gain[(cs < self.least) | (cs[:, -1:] - cs < self.least)] = -1
                    j, b = divmod(int(gain.argmax()), self.BINS + 1)
                    if gain[j, b] <= gs[0, -1] ** 2 / (hs[0, -1] + self.ridge) + 1e-6:
                        continue
                    tree[k, :2] = j, b
                    left = binned[rows, j] <= b
                    later += [(2 * k + 1, rows[left]), (2 * k + 2, rows[~left])]
                todo = later
            score += self.rate * tree[node, 2]
            self.trees.append(tree)
        return self

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, score, rows = self.bins(x), np.full(len(x), self.start), np.arange(len(x))
        for tree in self.trees:
            k = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = tree[k, 0].astype(np.int64)
                k = np.where(j < 0, k, 2 * k + 1 + (binned[rows, np.maximum(j, 0)] > tree[k, 1]))
            score += self.rate * tree[k, 2]
        return score


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function nearest to y (pool adjacent violators),
    to be joined by lines."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of margins
    for v, m in zip(y[order].astype(float), margin[order]):
        blocks.append([v, 1, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([m / n for _, n, m in blocks]), np.array([v / n for v, n, _ in blocks])


class Model:
    """A lexicon, trees over features and a calibration by folds that the trees didn't see."""

    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, folds: int = 3):
        self.lexicon, self.trees = lexicon, None
        self.share = float(y.mean()) if len(y) else 0.0
        if len(y) >= 50 and 0 < y.sum() < len(y):
            fold, out = np.arange(len(y)) % folds, np.zeros(len(y))
            for f in range(folds):
                out[fold == f] = Trees().fit(x[fold != f], y[fold != f]).margin(x[fold == f])
            self.knots = isotonic(out, y)
            self.trees = Trees().fit(x, y)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:  # too few labels, or of one kind
            return np.full(len(x), self.share)
        m = self.trees.margin(x)
        # a thousandth of the uncalibrated probability keeps the order inside a step
        return np.clip(0.999 * np.interp(m, *self.knots) + 0.001 / (1 + np.exp(-m)), 0, 1)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _arrow(f, kind: str):
    """mapInArrow of f over (text, toxic) rows in one go a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(b for b in pieces(batches, 1) if b.num_rows)
        trim()

    return run, kind


def train(docs: DataFrame, labels: DataFrame, rows: int = 20_000, words: int = 256) -> Model:
    """A model from the labels of documents that aren't held out, at most `rows` of them
    (those of the least hashes of doc_id). Its lexicon is the at most `words` words that
    toxic documents of these rows have most more often than others, by log-odds of at
    least 3 and in at least 8 and two percent of the toxic ones. Features of the sample,
    `rows` short lists of numbers, are what the driver gets."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounds what is broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")

    def count(batches):
        seen = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column(1), b.column(2)):
                seen[toxic.as_py() > 0].update(set(WORD.findall((text.as_py() or "").lower())))
        seen[0][""] = 0
        names = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([seen[1][w] for w in names], pa.int64()), pa.array([seen[0][w] for w in names], pa.int64())], names=["word", "bad", "good"])

    bad, good = sample_sizes = chosen.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    lexicon: dict[str, float] = {}
    if min(sample_sizes) > 0:
        run, kind = _arrow(count, "word string, bad long, good long")
        sums = sample.mapInArrow(run, kind).groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
        top = sums.where((F.col("bad") >= max(8, 0.02 * bad)) & (odds >= 3)).select("word", odds.alias("odds"))
        lexicon = {r.word: r.odds for r in top.orderBy(F.desc("odds"), "word").limit(words).collect()}

    def measure(batches):
        for b in batches:
            x = np.array([features(t, lexicon) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64())), b.column(2)], names=["doc_id", "x", "toxic"])

    run, kind = _arrow(measure, "doc_id long, x array<double>, toxic int")
    got = sample.mapInArrow(run, kind).dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    # folds follow a hash of the id, not its order
    got = got.iloc[np.argsort((got["doc_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11))] if len(got) else got
    x = np.array(got["x"].tolist()) if len(got) else np.empty((0, len(NAMES)))
    return Model(lexicon, x, (got["toxic"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id long and score double of every row."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([features(t, model.lexicon) for t in b.column(1).to_pylist()])
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x), pa.float64())], names=["doc_id", "score"])

        return f

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Each document's probability to be labelled toxic, from its whole text alone.

    docs: doc_id, text; labels: doc_id, toxic; other columns, of whatever names, are ignored.
    Null and empty texts are scored by what their features (zeros) say; very long texts are
    scored whole, in time proportional to their length; repeated rows are scored each, and
    the labels of a repeated doc_id count as toxic if one is; null labels don't count.
    Without labels of both kinds each score is the share of toxic labels, or 0. No rows give
    no rows.

    Returns doc_id long, held_out boolean, score double, predicted int (score >= threshold).
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def tolerable(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, with all its columns, whose score is under the threshold."""
    model, at = train(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, at):
            if b.num_rows:
                x = np.array([features(t, model.lexicon) for t in b.column("text").cast(pa.string()).to_pylist()])
                yield b.filter(pa.array(model.scores(x) < threshold))
        trim()

    return docs.mapInArrow(run, docs.schema)
