"""Similarity join of documents by their word n-grams, with count-vector R-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined, pieces, small_batches, trim, written

#: Groups that n-grams are hashed into: the dimensions of a count vector.
GROUPS = 64
#: Members of one R-tree, entries of its nodes, and bytes of sets in a block of a family.
TREE, NODE, UNIT_BYTES = 4096, 16, 4 << 20
#: A sixteenth of the documents is looked at for frequent n-grams, which are ordered last.
SAMPLE, OFTEN, MOST_FREQUENT = 16, 6, 200_000
#: Pairs of vectors that are held against each other at once.
SEARCHES = 1 << 14
#: Anchors that are sorted together.
BUCKET = 1_000_000
#: Members of a group that others are tried with before its tree.
PIVOTS = 8
#: Pivots by which nodes are families.
FAMILIES = 4
#: Document ids that may be broadcast, and nodes up to which a round isn't written in two.
BROADCAST_IDS, BROADCAST_NODES = 1_000_000, 1_000_000


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of murmur3, so that all bits are good."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ngram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct n-grams of words: A-Z in lower
    case, words apart at space, tab, line feed, vertical tab, form feed and carriage return.
    With fewer words the whole sequence is one; without words there is none."""
    import xxhash

    t = pc.ascii_lower(pc.fill_null(texts, ""))
    for c in "\t\n\x0b\x0c\r":
        t = pc.replace_substring(t, c, " ")
    lists = pc.split_pattern(t, " ")
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    value = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    codes = coded.indices.to_numpy()
    full = np.fromiter(map(bool, words), bool, len(words))[codes] if len(words) else np.empty(0, bool)
    cuts = np.concatenate(([0], np.cumsum(full)))[lists.offsets.to_numpy()]
    h = value[codes[full]]
    odd = mixed(np.arange(1, n + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        grams += h[j : j + len(grams)] * odd[j]
    grams = mixed(grams)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(mixed((h[a:b] * odd[: b - a]).sum(keepdims=True) + odd[n] * np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts, by the bytes of a column of texts, which bounds what a task holds."""
    yield from pieces(batches, column)
    trim()


def signature(grams: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes())).astype(np.int64))


def anchors(grams: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The first n-grams of a set of s in a fixed order (frequent ones last, then by hash),
    one more than the most that a partner may lack, and how many of them aren't frequent. Two
    sets that link have one in common."""
    size = len(grams)
    most = size - -(-percent * size // 100) + 1
    often = np.zeros(size, bool)
    if len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams
        grams = np.concatenate((grams[~often], grams[often]))
    return grams[:most], min(most, size - int(often.sum()))


def counts(grams: np.ndarray) -> bytes:
    """The count vector of a set: of GROUPS dimensions, or so many times two that at most
    eight n-grams fall into each on average. A finer vector folds to a coarser one. Bytes,
    the first of which is the size of a count."""
    size = GROUPS
    while size * 8 < len(grams):
        size *= 2
    v = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size)
    wide = 1 if v.max(initial=0) < 256 else 4
    return bytes([wide]) + v.astype(f"<u{wide}").tobytes()


def vector(points: bytes) -> np.ndarray:
    return np.frombuffer(points, f"<u{points[0]}", offset=1).astype(np.int32)


def folded(points: np.ndarray, size: int) -> np.ndarray:
    """Count vectors (rows) by `size` dimensions."""
    return points if points.shape[1] == size else points.reshape(len(points), -1, size).sum(axis=1, dtype=np.int32)


def overlap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most that the sets of count vectors (rows of x and y) may share, row by row."""
    size = min(x.shape[1], y.shape[1])
    return np.minimum(folded(x, size), folded(y, size)).sum(axis=1, dtype=np.int32).astype(np.int64)


def links(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """Whether `common` n-grams of sets of a and b are `percent` of all of theirs."""
    return 100 * common >= percent * (a + b - common)


class RTrees:
    """R-trees over count vectors, one for each group, packed by size: each node bounds the
    counts of its entries from above and their sizes from both sides. What two sets have in
    common is at most the sum of the lesser counts, so a node is entered only if that sum with
    its upper bounds would suffice for a link with its smallest entry. The trees have the
    vectors by GROUPS dimensions; entries that they leave are held against each other's finer
    vectors. Many searches in many trees go down level by level together.

    vectors: distinct ones; which: of each member, its vector; group: of each, ascending."""

    def __init__(self, vectors: list[np.ndarray], which: np.ndarray, group: np.ndarray, percent: int, label: np.ndarray):
        group = np.unique(group, return_inverse=True)[1]
        self.which, self.group, self.percent, self.label = which, group, percent, label
        # those of the label that most of a group have need no search of their own
        by = np.lexsort((label, group))
        new = np.flatnonzero(np.concatenate(([True], (group[by][1:] != group[by][:-1]) | (label[by][1:] != label[by][:-1]))))
        many = np.diff(np.append(new, len(by)))
        first = np.lexsort((-many, group[by][new]))
        first = first[np.unique(group[by][new][first], return_index=True)[1]]
        self.main = label == label[by][new][first][group]
        self.points = np.concatenate([folded(v[None], GROUPS) for v in vectors])
        self.size = self.points.sum(axis=1, dtype=np.int64)
        self.width = np.array([len(v) for v in vectors])
        self.fine, self.row = {}, np.empty(len(vectors), int)
        for w in np.unique(self.width[self.width > GROUPS]):
            at = np.flatnonzero(self.width == w)
            self.fine[w], self.row[at] = np.stack([vectors[i] for i in at]), np.arange(len(at))
        # by size, then within runs of sizes by where the mass lies
        size, run = self.size[which], np.empty(len(which), int)
        by = np.lexsort((size, group))
        run[by] = self._place(group[by]) // (NODE * NODE)
        mass = (self.points * np.arange(GROUPS)).sum(axis=1) / np.maximum(1, self.size)
        self.order = np.lexsort((mass[which], run, group))
        top, low, high, group = self.points[which[self.order]], size[self.order], size[self.order], group[self.order]
        self.levels = []
        while not self.levels or (group[1:] == group[:-1]).any():
            cut = np.flatnonzero(self._place(group) % NODE == 0)
            end = np.append(cut[1:], len(group))
            top, low, high, group = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), group[cut]
            self.levels.append((top, low, high, cut, end))

    @staticmethod
    def _place(group: np.ndarray) -> np.ndarray:
        """Of each row of ascending groups, its place in its group."""
        return np.arange(len(group)) - np.searchsorted(group, group)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of members of a group, of different labels, whose vectors may link; in
        parts, by members that are searched with."""
        seek = np.flatnonzero(~self.main)
        todo = [(len(self.levels) - 1, seek, self.group[seek])]  # level, members, nodes of it
        while todo:
            depth, i, node = todo.pop()
            if len(i) > SEARCHES:
                todo += [(depth, i[k : k + SEARCHES], node[k : k + SEARCHES]) for k in range(0, len(i), SEARCHES)][::-1]
                continue
            if depth < 0:
                yield self._near(i, self.order[node])
                continue
            top, low, high, begin, end = self.levels[depth]
            size, low, high = self.size[self.which[i]], low[node], high[node]
            least = np.maximum(low, -(-self.percent * size // 100))  # sizes that can link
            fit = np.flatnonzero((100 * size >= self.percent * low) & (100 * high >= self.percent * size))
            common = np.minimum(top[node[fit]], self.points[self.which[i[fit]]]).sum(axis=1, dtype=np.int32).astype(np.int64)
            fit = fit[links(common, size[fit], least[fit], self.percent)]
            if len(fit):
                begin, n = begin[node[fit]], (end - begin)[node[fit]]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                todo.append((depth - 1, np.repeat(i[fit], n), np.repeat(begin, n) + inner))

    def _near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of pairs of entries of which a link is possible, each once."""
        use = ((j > i) | self.main[j]) & (self.label[i] != self.label[j])
        i, j = i[use], j[use]
        x, y = self.which[i], self.which[j]
        use = links(np.minimum(self.size[x], self.size[y]), self.size[x], self.size[y], self.percent)
        i, j, x, y = i[use], j[use], x[use], y[use]
        use = links(overlap(self.points[x], self.points[y]), self.size[x], self.size[y], self.percent)
        i, j, x, y = i[use], j[use], x[use], y[use]
        use = np.ones(len(i), bool)
        finer = np.flatnonzero(np.minimum(self.width[x], self.width[y]) > GROUPS)
        for w, v in np.unique(np.stack((self.width[x[finer]], self.width[y[finer]])), axis=1).T.tolist():
            at = finer[(self.width[x[finer]] == w) & (self.width[y[finer]] == v)]
            for k in range(0, len(at), some := max(1, SEARCHES * GROUPS // max(w, v))):
                a = at[k : k + some]
                use[a] = links(overlap(self.fine[w][self.row[x[a]]], self.fine[v][self.row[y[a]]]), self.size[x[a]], self.size[y[a]], self.percent)
        return i[use], j[use]


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that is reachable by `edges` (a, b long), for each node in
    them. In each round a node takes the least label of its neighbours and then that label's
    own label, so that paths halve; rounds are written to the shared folder."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    n = labels.count()
    while True:  # hubs and the labels of large classes are hot keys
        near = joined(both, labels.withColumnRenamed("node", "b"), "b", n).groupBy("a").agg(F.min("label").alias("m"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "m").alias("next"), F.col("label").alias("old"))
        new = written(new) if n > BROADCAST_NODES else new
        up = new.select(F.col("node").alias("next"), F.col("next").alias("over"))
        new = written(joined(new, up, "next", n).select("node", F.least("next", "over").alias("label"), (F.col("old") != F.least("next", "over")).alias("moved")))
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of signatures whose sets link."""
    left = sets.select(F.col("sig").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("sig").alias("b"), F.col("grams").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            fine = np.zeros(t.num_rows, bool)
            for i in range(t.num_rows):
                x, y = (np.frombuffer(t.column(c)[i].as_buffer(), np.uint64) for c in ("x", "y"))
                fine[i] = links(shared(x, y), len(x), len(y), percent)
            yield t.select(["a", "b"]).filter(pa.array(fine))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose count vectors leave a link possible."""
    left, right = points.toDF("a", "x"), points.toDF("b", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            fine = []
            for x, y in zip(t.column("x").to_pylist(), t.column("y").to_pylist()):
                x, y = vector(x), vector(y)
                fine.append(bool(links(overlap(x[None], y[None])[0], x.sum(), y.sum(), percent)))
            yield t.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many n-grams two sorted sets have in common."""
    if len(y) < len(x):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def blocks_of(size: Column, most: int) -> Column:
    """Blocks of a group, in as many units each of them is: one if all of it isn't more than two
    blocks of `most`."""
    return F.when(size <= 2 * most, 1).otherwise(F.ceil(size / most)).cast("int")


def _in_units(members: DataFrame, buckets: int, search, columns: list[str]) -> DataFrame:
    """Distinct (a, b) of what search(sig, label, unit, other columns) finds in the groups of
    members (key, blocks of the group, sig, label, ...). Every two blocks of a group meet in a
    unit of their own. Units are dealt to `buckets`: many small ones share a task's table, and
    are searched together."""
    m = members.withColumn("own", F.pmod(F.xxhash64("sig", F.lit(7)), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sig", "label", *columns)

    def run(t: pa.Table) -> pa.Table:
        keys = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
        sig, label = t.column("sig").to_numpy(), t.column("label").to_numpy()
        order = np.lexsort(keys[::-1])
        new = np.concatenate(([True], (np.diff(keys[:, order], axis=1) != 0).any(axis=0)))
        unit = np.cumsum(new) - 1
        several = np.bincount(unit, label[order] != label[order[new]][unit]) > 0
        order, unit = order[several[unit]], unit[several[unit]]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(order):
            found += search(sig[order], label[order], unit, *[t.column(c).take(pa.array(order)) for c in columns])
        a, b = (np.concatenate([np.atleast_1d(x[k]) for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        pair = np.unique(np.sort(np.stack((a, b)), axis=0), axis=1)
        trim()
        return pa.table({"a": pair[0].astype(np.int64), "b": pair[1].astype(np.int64)})

    bucket = F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, buckets))).cast("int")
    return m.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(run, "a long, b long").distinct()


def _tree_pairs(members: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Pairs of members of a group, of different labels and of no common family, whose bound
    in the group's R-tree leaves a link possible."""

    def search(sig, label, unit, family, points):
        one, which = np.unique(sig, return_index=True, return_inverse=True)[1:]
        family = [set(x) for x in family.take(pa.array(one)).to_pylist()]
        for i, j in RTrees([vector(x) for x in points.take(pa.array(one)).to_pylist()], which, unit, percent, label).pairs():
            apart = np.fromiter((family[x].isdisjoint(family[y]) for x, y in zip(which[i].tolist(), which[j].tolist())), bool, len(i))
            if apart.any():
                yield sig[i[apart]], sig[j[apart]]

    return _in_units(members, buckets, search, ["family", "points"])


def _family_links(members: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Links within families: the sets verify what the R-tree leaves, but for pairs that the
    links found so far connect."""

    def search(sig, label, unit, points, grams):
        one, which = np.unique(sig, return_index=True, return_inverse=True)[1:]
        sets = [np.frombuffer(x, np.uint64) for x in grams.take(pa.array(one)).to_pylist()]
        first: dict[int, int] = {}
        parent = [first.setdefault(x, i) for i, x in enumerate(label.tolist())]

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for some in RTrees([vector(x) for x in points.take(pa.array(one)).to_pylist()], which, unit, percent, label).pairs():
            for i, j in zip(*[x.tolist() for x in some]):
                x, y = find(i), find(j)
                if x != y and links(shared(sets[which[i]], sets[which[j]]), len(sets[which[i]]), len(sets[which[j]]), percent):
                    parent[max(x, y)] = min(x, y)
                    yield sig[i], sig[j]

    return _in_units(members, buckets, search, ["points", "grams"])


def _grouped(described: DataFrame) -> DataFrame:
    """Distinct (key, sig): anchors that several sets share.

    Anchors travel packed: each task deals its anchors by their upper bits into buckets of
    about BUCKET anchors, in one row of bytes for each bucket. Anchors known to be frequent
    aren't in there; they go as rows, summed by Spark before they are dealt."""
    total = described.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    buckets = max(1, total // (6 * BUCKET))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.divide(pc.binary_length(b.column(1)), 6).to_numpy()
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, 6)
            low, high = np.ascontiguousarray(raw[:, :4]).view(np.uint32).ravel(), np.ascontiguousarray(raw[:, 4:]).view(np.uint16).ravel()
            bucket = (high.astype(np.int64) * buckets) >> 16
            owner = np.repeat(np.arange(b.num_rows, dtype=np.uint32), sizes)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            sig, rows = b.column(0).to_numpy(), []
            for k in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[k] : cuts[k + 1]]
                own, place = np.unique(owner[at], return_inverse=True)
                rows.append((int(k), low[at].tobytes(), place.astype(np.uint16 if len(own) < 65536 else np.uint32).tobytes(), sig[own].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["bucket", "low", "place", "sigs"])

    def meet(t: pa.Table) -> pa.Table:
        low = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("low").to_pylist()])
        sig = np.concatenate([np.frombuffer(s, np.int64)[np.frombuffer(x, np.uint16 if len(s) < 8 * 65536 else np.uint32)] for x, s in zip(t.column("place").to_pylist(), t.column("sigs").to_pylist())])
        order = np.lexsort((sig, low))
        low, sig = low[order], sig[order]
        new = np.concatenate(([True], (low[1:] != low[:-1]) | (sig[1:] != sig[:-1])))
        low, sig = low[new], sig[new]  # distinct
        first = np.concatenate(([True], low[1:] != low[:-1]))
        many = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1] > 1
        return pa.table({"key": (int(t.column("bucket")[0].as_py()) << 32) + low[many].astype(np.int64), "sig": sig[many]})

    packed = described.where("octet_length(keys) > 0").select("sig", "keys").mapInArrow(deal, "bucket long, low binary, place binary, sigs binary")
    cold = packed.groupBy("bucket").applyInArrow(meet, "key long, sig long")
    hot = described.where("size(often) > 0").select(F.explode("often").alias("key"), "sig").distinct()
    shared = hot.groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select(F.col("key").alias("k"))
    hot = hot.join(shared, hot["key"] == shared["k"]).select((-F.abs("key") - 1).alias("key"), "sig")
    return cold.union(hot)


def ngram_jaccard(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """Classes of documents under links of `percent` % Jaccard similarity of n-gram sets.

    1. Each text gives its set's size, signature, count vector and anchors (see anchors()).
       Equal sets have one signature and are one node from here on.
    2. Anchors that nodes of different sets share make groups; of groups with the same
       members one is kept. Groups are the shards of the R-trees.
    3. Each node's vector is held against that of one member of its groups; where the bound
       suffices for a link the sets verify it. What such links connect needs no further link
       between its own nodes.
    4. In groups that are still apart, R-trees over count vectors give all pairs of nodes
       whose bound suffices, and the sets verify them. So classes are exact.

    Nothing is capped: large groups are cut into blocks that meet pairwise. Sets are made
    again from the texts for the nodes of such pairs only.

    docs: doc_id, text; other columns, of whatever names, are ignored. Very long texts are
    taken whole, in time proportional to their length. Null texts and texts without words have
    n_shingles 0 and are linked with nothing; rows with one doc_id are one document whose
    sets all count; a null doc_id is linked with nothing and is its own, null, component. No
    rows give no rows.

    Returns a row for each row: doc_id long, n_shingles long, component_id long (smallest
    doc_id reachable by links).
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 0):  # anchors come from the lower hashes
            got = [x[x < np.uint64(int(0.4 * 2**64))] for x in ngram_sets(b.column(0), n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got or [np.empty(0, np.uint64)]).view(np.int64))], names=["gram"])

    some = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SAMPLE)) == 0).select("text").mapInArrow(sample, "gram long")
    often = some.groupBy("gram").agg(F.count("*").alias("c")).where(F.col("c") >= OFTEN).orderBy(F.desc("c"), "gram").limit(MOST_FREQUENT).select("gram").toPandas()["gram"]
    frequent = docs.sparkSession.sparkContext.broadcast(np.sort(often.to_numpy(np.int64).view(np.uint64)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            sets = ngram_sets(b.column(1), n)
            cold, hot = [], []
            for x in sets:
                keys, plain = anchors(x, frequent.value, percent) if len(x) > 1 else (x[:0], 0)  # a set of one only equals others
                cold.append((keys[:plain] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                hot.append(keys[plain:].view(np.int64))
            points = [counts(x) for x in sets]
            columns = [b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([signature(x) for x in sets], pa.int64()), pa.array(points, pa.binary()), pa.array(cold, pa.binary()), pa.array(hot, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "sig", "points", "keys", "often"])

    described = written(texts.mapInArrow(describe, "doc_id long, size long, sig long, points binary, keys binary, often array<long>"))
    named = described.where("size > 1 and doc_id is not null")
    entries = written(_grouped(named))
    pivots = F.array(*[F.min_by("sig", F.xxhash64("sig", F.lit(k))) for k in range(PIVOTS)])
    groups = entries.groupBy("key").agg(F.count("*").alias("members"), F.sum(F.xxhash64("sig").cast("decimal(20,0)")).alias("sum"), pivots.alias("pivots"))
    groups = written(groups.groupBy("members", "sum").agg(F.min(F.struct("key", "pivots")).alias("g"), F.count("*").alias("weight")).select("g.key", "g.pivots", "members", "weight"))
    entries = written(entries.join(groups.select("key", "members"), "key").select("key", "sig", F.col("members").alias("size")))

    def least_of(sigs: DataFrame) -> DataFrame:
        """One doc_id of each of these nodes, and its vectors."""
        first = named.join(sigs, "sig", "left_semi").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
        return named.select("doc_id", "sig", "size", "points").join(first, ["doc_id", "sig"])

    nodes = written(least_of(entries.select("sig").distinct()))
    points = nodes.select("sig", "points")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            sets = ngram_sets(b.column(1), n)
            keep = np.array([signature(x) == s for x, s in zip(sets, b.column(0).to_pylist())], bool)  # a doc_id may repeat
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], names=["sig", "grams"]).filter(pa.array(keep))

    def sets_of(sigs: DataFrame) -> DataFrame:
        """sig and grams of these nodes, from their texts again."""
        ids = written(nodes.select("sig", "doc_id").join(sigs.distinct(), "sig", "left_semi"))
        wanted = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id").select("sig", "text")
        return written(wanted.mapInArrow(expand, "sig long, grams binary"))

    ends = lambda pairs: pairs.select(F.col("a").alias("sig")).union(pairs.select("b"))
    # nodes that share anchors with a pivot as linked ones do: the more the better, by draw
    drawn = entries.join(groups.select("key", "weight", F.posexplode("pivots").alias("draw", "pivot")), "key")
    drawn = drawn.groupBy("sig", "draw", "pivot").agg(F.sum("weight").alias("w")).groupBy("sig", "draw").agg(F.max(F.struct("w", "pivot")).alias("x"))
    drawn = written(drawn.join(nodes.select("sig", "size"), "sig").where("x.w * 20 >= size").select("sig", "draw", "x.pivot"))
    stars = drawn.where("sig <> pivot").select(F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b")).distinct()
    stars = written(_bounded(stars, points, percent))
    family = drawn.where(F.col("draw") < FAMILIES).select("sig", F.xxhash64("draw", "pivot").alias("family")).distinct()
    held = family.join(nodes.select("sig", (8 * F.col("size")).alias("bytes")), "sig")
    several = held.groupBy("family").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes")).where("size > 1")
    several = written(several.withColumn("blocks", blocks_of(F.col("bytes"), UNIT_BYTES)))
    sets = sets_of(ends(stars).union(family.join(several, "family", "left_semi").select("sig")))
    first = written(_verified(stars, sets, percent))
    label = connected(first)
    own = lambda df: df.join(label.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    members = own(family.join(several, "family")).select(F.col("family").alias("key"), "blocks", "sig", "label")
    apart = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    members = members.join(apart, "key").join(points, "sig").join(sets, "sig")
    rows, size = several.agg(*[F.coalesce(F.sum(F.col(c) * F.col("blocks")), F.lit(0)) for c in ("size", "bytes")]).first()
    first = written(first.union(_family_links(members, max(rows // 4000, size // UNIT_BYTES), percent)))
    # what isn't of one family, in the groups of shared anchors
    label = connected(first)
    of = family.join(several, "family", "left_semi").groupBy("sig").agg(F.array_sort(F.collect_set("family")).alias("family"))
    members = own(entries).join(of, "sig", "left").withColumn("family", F.coalesce("family", F.array().cast("array<bigint>")))
    apart = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    blocks = blocks_of(F.col("size"), TREE // 2)
    members = members.join(apart, "key").join(points, "sig").select("key", blocks.alias("blocks"), "sig", "label", "family", "points")
    rows = groups.agg(F.coalesce(F.sum(F.col("members") * blocks_of(F.col("members"), TREE // 2)), F.lit(0))).first()[0]
    pairs = written(_tree_pairs(members, rows // 4000, percent))
    more = written(_verified(pairs, sets_of(ends(pairs)), percent))
    label = connected(first.union(more))

    # rows of one doc_id are one document, whatever their sets
    ids = described.where("size > 0 and doc_id is not null").select("doc_id", "sig")
    rows = ids.join(label, ids["sig"] == label["node"], "left").select("doc_id", F.coalesce("label", "sig").alias("label"))
    rows = written(rows)
    least = written(rows.groupBy("label").agg(F.min("doc_id").alias("least")))
    of_class = joined(rows, least, "label", least.count())
    out = written(of_class.groupBy("doc_id").agg(F.min("least").alias("component_id"), F.count_distinct("label").alias("several")))
    if not out.where("several > 1").isEmpty():
        whole = connected(of_class.select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
        out = whole.select(F.col("node").alias("doc_id"), F.col("label").alias("component_id"))
    result = described.select("doc_id", F.col("size").alias("n_shingles")).join(out.select("doc_id", "component_id"), "doc_id", "left")
    return result.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs, with all its columns, less those that ngram_jaccard() links with a
    row of a smaller doc_id. Of repeated rows of one doc_id, the one of the least hash of its
    text stays; rows with a null doc_id stay."""
    classes = ngram_jaccard(docs, n, percent)
    gone = classes.where("doc_id > component_id").select(F.col("doc_id").alias("_gone")).distinct()
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_again")).agg(F.count("*").alias("c")).where("c > 1").select("_again")
    kept = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    if again.isEmpty():
        return kept
    rows = kept.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    one = F.row_number().over(Window.partitionBy("row.doc_id").orderBy(F.xxhash64("row.text")))
    return rows.withColumn("r", F.when(F.col("row.doc_id").isNull(), 1).otherwise(one)).where("r = 1").select("row.*")
