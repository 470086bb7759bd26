"""Packing documents into sequences by lexical retrieval."""

from __future__ import annotations

import functools
import itertools
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches, trim, written

#: BM25's usual constants.
K1, B = 1.2, 0.75
#: A shard ends with this many parts or this many of their tokens, which bounds a task's memory.
SHARD_DOCS, SHARD_TOKENS = 1024, 1 << 21
#: Terms in the signature by which documents are dealt to shards.
SIGNATURE = 8
#: Rows of statistics that count parts and their tokens, beside those of terms.
PARTS, TOKENS = -1, -2


class Words:
    """Token ids of texts by way of their words: the words of many texts are coded at once
    and each distinct word is looked up once, or tokenized when it is new. The tokenizer
    drops white space before it splits, so no token crosses a word; it puts letters into
    lower case, and splits them from the marks behind them, which are words of their own
    here. Words are kept from the second time on that they come, while there are fewer than
    `most`, which bounds the memory."""

    #: A letter and a mark that begins another token whatever follows; an apostrophe may not.
    MARK = r"([\p{Ll}\p{Lo}])([!-&(-/:-@\[-`{-~])"
    #: What is one word to the model, which knows these characters by themselves.
    PLAIN = r"^(?:[a-z]+|[!-/:-@\[-`{-~]+)$"
    #: The characters that stand for bytes in the model: printable ones for themselves, the
    #: others for those from 256 on.
    _PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
    BYTES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}

    def __init__(self, path: str, most: int = 100_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known = pa.array([], pa.string())  # words by their row of bounds
        self.flat, self.used = np.empty(1 << 18, np.uint32), 0
        self.bounds, self.rows = np.empty((1 << 17, 2), np.int64), 0
        self.seen = np.zeros(1 << 22, bool)  # by hash

    def _add(self, lists: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ends = self.used + np.cumsum(sizes)
        last = int(ends[-1]) if len(ends) else self.used
        while last > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while self.rows + len(lists) > len(self.bounds):
            self.bounds = np.concatenate((self.bounds, np.empty_like(self.bounds)))
        self.flat[self.used : last] = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, last - self.used)
        self.bounds[self.rows : self.rows + len(lists)] = np.stack((ends - sizes, ends), 1)
        self.used, self.rows = last, self.rows + len(lists)

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows one after the other, and how many each has."""
        begin, size = self.bounds[rows, 0], self.bounds[rows, 1] - self.bounds[rows, 0]
        return self.flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())], size

    def _tokenize(self, words: pa.Array) -> np.ndarray:
        """Rows for words, added at the end."""
        plain = pc.match_substring_regex(words, self.PLAIN).to_numpy(zero_copy_only=False)
        coded, others, wide, at = words.filter(pa.array(plain)).to_pylist(), [], [], np.flatnonzero(~plain)
        for i, p in zip(at.tolist(), words.filter(pa.array(~plain)).to_pylist()):
            low = p.lower()
            if p.isalpha() and low.isalpha() and "Σ" not in p and unicodedata.is_normalized("NFC", p):
                coded.append("".join(map(self.BYTES.__getitem__, low.encode())))
                wide.append(i)
            else:
                others.append((i, p))
        cut, rows = self.tokenizer.model.tokenize, np.empty(len(words), np.int64)
        order = np.concatenate((np.flatnonzero(plain), np.array(wide, np.int64), np.array([i for i, _ in others], np.int64)))
        rows[order] = np.arange(self.rows, self.rows + len(words))
        self._add([[x.id for x in cut(p)] for p in coded] + [e.ids for e in self.tokenizer.encode_batch_fast([p for _, p in others], add_special_tokens=False)])
        return rows

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Rows for new words: kept ones, then those that are to be forgotten after use."""
        keep = np.zeros(len(words), bool)
        if len(self.known) < self.most:
            at = np.fromiter(map(hash, words.to_pylist()), np.int64, len(words)) & (len(self.seen) - 1)
            keep = self.seen[at]
            self.seen[at] = True
        rows, kept = np.empty(len(words), np.int64), words.filter(pa.array(keep))
        order = self._tokenize(kept)
        self.mark = self.used, self.rows
        # the known words stand by their rows
        self.known = pa.concat_arrays([self.known, kept.take(pa.array(np.argsort(order)))])
        rows[keep], rows[~keep] = order, self._tokenize(words.filter(pa.array(~keep)))
        return rows

    def ids(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """The ids of each text, then `end`."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)  # special tokens keep their case
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        plain = pc.replace_substring_regex(pc.replace_substring(pc.ascii_lower(plain), "\n", " "), self.MARK, r"\1 \2")
        lists = pc.split_pattern(plain, " ")
        coded = lists.flatten().dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.known)
        new, rows = found.is_null().to_numpy(zero_copy_only=False), found.fill_null(0).to_numpy().astype(np.int64)
        self.mark = self.used, self.rows
        if new.any():
            rows[new] = self._learn(coded.dictionary.filter(pa.array(new)))
        flat, size = self._gather(rows[coded.indices.to_numpy()])
        self.used, self.rows = self.mark
        cuts = np.concatenate(([0], np.cumsum(size)))[lists.offsets.to_numpy()]
        last, out = np.array([end], np.uint32), []
        for i in range(len(texts)):
            own = self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids if odd[i] else flat[cuts[i] : cuts[i + 1]]
            out.append(np.concatenate((np.asarray(own, np.uint32), last)))
        return out


@functools.lru_cache(1)
def _words(path: str) -> Words:
    """One for each Python worker, which runs many tasks."""
    return Words(path)


def signature(terms: np.ndarray, order: np.ndarray) -> bytes:
    """The SIGNATURE least of the places that `order` gives to distinct terms, ascending:
    sets that share much agree in the first of them, as min-hashes do, and sort together."""
    at = order[terms]
    if len(at) > SIGNATURE:
        at = np.partition(at, SIGNATURE)[:SIGNATURE]
    return np.sort(at).astype(">u4").tobytes()


class Shard:
    """Parts of documents (what their full windows leave), their BM25 index over token ids,
    and the packing of them. `corpus` has the number of all parts, the number that has each
    term, and the mean length; without it the shard is the corpus."""

    def __init__(self, length: int, corpus: tuple[int, np.ndarray, float] | None = None):
        self.length, self.corpus, self.docs, self.parts, self.tokens = length, corpus, [], [], 0

    def add(self, doc, part: np.ndarray) -> bool:
        """Takes a part, shorter than a window, and says whether the shard is full."""
        self.docs.append(doc)
        self.parts.append(part)
        self.tokens += len(part)
        return len(self.docs) >= SHARD_DOCS or self.tokens >= SHARD_TOKENS

    def index(self) -> None:
        """Postings: by term, the parts and their weights."""
        terms = [np.unique(x, return_counts=True) for x in self.parts]
        sizes = np.array([len(x) for x in self.parts], float)
        part = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t, _ in terms])
        vocabulary, term = np.unique(np.concatenate([t for t, _ in terms]), return_inverse=True)
        tf = np.concatenate([c for _, c in terms]).astype(float)
        order = np.argsort(term, kind="stable")
        self.start = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
        every, df, mean = (self.corpus[0], self.corpus[1][vocabulary], self.corpus[2]) if self.corpus else (len(terms), np.diff(self.start), sizes.mean())
        idf = np.log1p((every - df + 0.5) / (df + 0.5))
        self.part, self.weight = part[order], (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[part] / mean)))[order]
        ends = np.cumsum([len(t) for t, _ in terms])
        self.of = [term[e - len(t) : e] for e, (t, _) in zip(ends, terms)]

    def scores(self, seed: int) -> np.ndarray:
        a, b = self.start[self.of[seed]], self.start[self.of[seed] + 1]
        n = b - a
        at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.part[at], self.weight[at], minlength=len(self.of))

    def forget(self, free: np.ndarray) -> None:
        """Drops the postings of parts that aren't free."""
        keep = free[self.part]
        self.start = np.concatenate(([0], np.cumsum(keep)))[self.start]
        self.part, self.weight = self.part[keep], self.weight[keep]

    def pack(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(number of the part, start in it, length, sequence, offset) of each piece. Each
        seed in turn opens a window and its unused neighbours fill it, best score first:
        those that fit whole, then one cut to fit. The last window, if not full, is cut into
        sequences of powers of two, which need no padding."""
        w, s = self.length, 0
        size = np.array([len(x) for x in self.parts], np.int64)
        start, free = np.zeros(len(size), np.int64), size > 0
        indexed = len(size)
        if size.sum() > w:
            self.index()
        for seed in range(len(size)):
            if not free[seed]:
                continue
            free[seed] = False
            if size.sum() > w and 4 * free.sum() < 3 * indexed:
                self.forget(free)
                indexed = free.sum()
            window, room = [(seed, size[seed])], w - size[seed]
            open_ = np.flatnonzero(free)
            if room and len(open_):
                if size[open_].sum() <= room:  # all that is left
                    window += [(j, size[j]) for j in open_]
                    room -= size[open_].sum()
                    free[open_] = False
                else:
                    ranked = open_[np.argsort(-self.scores(seed)[open_], kind="stable")]
                    fits = ranked[size[ranked] <= room]
                    while len(fits):
                        j = fits[0]
                        window.append((j, size[j]))
                        free[j] = False
                        room -= size[j]
                        fits = fits[1:][size[fits[1:]] <= room]
                    if room:
                        window.append((ranked[free[ranked]][0], room))
                        room = 0
            found = []
            for j, n in window:
                found.append((j, start[j], n))
                start[j] += n
                size[j] -= n
            rest, at = sum(n for _, _, n in found), 0
            while rest:
                n = w if rest >= w else 1 << int(rest).bit_length() - 1
                rest -= n
                at = 0
                while at < n:
                    i, a, m = found.pop(0)
                    take = min(m, n - at)
                    yield i, int(a), int(take), s, int(at)
                    at += take
                    if take < m:
                        found.insert(0, (i, a + take, m - take))
                s += 1


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end: int = 2) -> DataFrame:
    """Pieces of documents, packed into sequences of `length` tokens.

    A document is its text's ids by the tokenizers file `tokenizer`, then the id `end`. Its
    full windows are sequences by themselves; what they leave is its part. Parts are sorted
    by signatures of their terms over all the input, and cut into shards (at most SHARD_DOCS
    parts or about SHARD_TOKENS tokens), indexed by BM25 over token ids with the statistics
    of all parts; each seed's unused neighbours in its shard fill its window. Every id lies
    in exactly one piece, and sequences are full but for the last ones of a shard, whose
    lengths are powers of two: nothing is padded.

    docs: doc_id, text; other columns, of whatever names, are ignored. A null or empty text
    is the one id `end`. Very long texts are tokenized whole, in time proportional to their
    length. Repeated rows are documents of their own. No rows give no rows. Equal scores keep
    the order of the rows.

    Returns doc_id long, start long, length long, ids binary (unsigned 32 bit, little
    endian), doc_tokens long, sequence_id long (by task and shard), offset long.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = [x.split()[0] for x in schema.split(", ")]
    coded_schema = "row long, doc_id long, ids binary, sig binary, term int, n long"
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1)
    kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")  # of ids on their way

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents by their ids; then statistics of the task's parts, in rows with a term."""
        from pyspark import TaskContext

        words, row = _words(tokenizer), TaskContext.get().partitionId() << 36
        order, df, count, total = np.random.default_rng(0).permutation(size), np.zeros(size, np.int64), 0, 0
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
        fields = [x.split()[0] for x in coded_schema.split(", ")]
        for b in pieces(batches, 1):
            lists, sigs = words.ids(b.column(1), end), []
            for x in lists:
                rest = x[len(x) // length * length :]
                terms = np.unique(rest)
                df[terms] += 1
                count += len(rest) > 0
                total += len(rest)
                sigs.append(signature(terms, order))
            n = len(lists)
            columns = [range(row, row + n), b.column(0), [x.astype(kind).tobytes() for x in lists], sigs, [None] * n, [None] * n]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names=fields)
            row += n
        if count:
            term = np.flatnonzero(df)
            none = [None] * (len(term) + 2)
            columns = [none, none, none, none, [PARTS, TOKENS, *term.tolist()], [count, total, *df[term].tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=fields)
        trim()

    coded = written(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(code, coded_schema))
    # as many rows as the vocabulary has terms
    stats = dict(coded.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect())
    parts, tokens = stats.pop(PARTS, 0), stats.pop(TOKENS, 0)
    df = np.zeros(max(stats, default=0) + 1, np.int32)
    df[list(stats)] = list(stats.values())
    corpus = (parts, df, tokens / parts) if parts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        _words.cache_clear()  # a worker that made ids holds its words no longer
        base, rows = TaskContext.get().partitionId() << 36, []
        shard = Shard(length, corpus)

        def sequence(doc, start: int, ids: np.ndarray, every: int, offset: int, number: int) -> None:
            rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), every, number, offset))

        def made() -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            rows.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            most = -1
            for i, a, n, s, at in shard.pack():
                doc, full = shard.docs[i]
                sequence(doc, full + a, shard.parts[i][a : a + n], full + len(shard.parts[i]), at, base + s)
                most = max(most, s)
            base += most + 1
            yield from made()

        for b in pieces(batches, 1):
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.frombuffer(raw.as_py(), kind)
                full = len(ids) // length * length
                for k in range(0, full, length):
                    sequence(doc, k, ids[k : k + length], len(ids), 0, base)
                    base += 1
                    if len(rows) >= SHARD_DOCS:
                        yield from made()
                if full < len(ids) and shard.add((doc, full), ids[full:].copy()):
                    yield from flush()
                    shard = Shard(length, corpus)
        yield from flush()
        shard = None
        trim()

    # ranges split equal signatures by row
    dealt = coded.where("term is null").repartitionByRange("sig", "row").sortWithinPartitions("sig", "row")
    return dealt.select("doc_id", "ids").mapInArrow(run, schema)
