"""HTML extraction: blocks of a page, less boilerplate that a host's pages share."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches, trim, written
from .urls import host

# Elements and names by what they hold.
HIDDEN = "script style noscript template head title svg math iframe object canvas audio video map".split()
ASIDE = "nav header footer aside form button select option textarea input label menu dialog fieldset".split()
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Whole class names and ids, with clear forms of them: site-header, nav-bar, ad-slot-2.
#: Those that say something of what is around or about an element (has-sidebar, tag-x) aren't.
BAD_NAME = re.compile(
    r"(?:(?:site|page|main|global|top|bottom|primary|secondary|post|entry|article|block|cookie)[_-]+)?"
    r"(?:ads?|advert|advertisements?|advertising|adsense|banner|sponsor|sponsored|sponsors|promo|promos|promotion|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"nav|navbar|navigation|menu|breadcrumbs?|topbar|toolbar|masthead|header|footer|foot|copyright|sidebar|side|aside|widget|related|recommended|share|sharing|social|"
    r"comments?|commentlist|respond|replies|reply|disqus|pagination|pager|tags?|search|skip)"
    r"(?:[_-]+(?:bar|box|area|container|wrapper|wrap|inner|list|links?|menu|section|widgets?|slot|unit|banner|block|items?|nav|navigation|form|posts|buttons?|icons?|notice|consent|\d+))*",
    re.I,
)
BAD_ROLE = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|alert|dialog|menu|form)\b|\saria-hidden\s*=\s*[\"']?true|\shidden(?=[\s>=/])|display\s*:\s*none", re.I)
NAMED = re.compile(r"(?<![\w-])(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Attributes end where another tag begins, so that tags left open are scanned once.
ATTRIBUTES = r"(?:[^<>\"']|<(?![a-zA-Z/!?])|\"[^\"]*\"|'[^']*')*+"
PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg)\b" + ATTRIBUTES + r">.*?(?:</\1\s*>|\Z)|"
    r"<(/?)([a-zA-Z][\w:-]*)(" + ATTRIBUTES + r")>|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
SPACE = re.compile(r"[\s\x00\u200b\ufeff]+")
#: What a block is: outside articles, in one, or in an element that holds no main text.
OUTSIDE, ARTICLE, ASIDE_BLOCK = 0, 1, 2
#: States of an element: its text counts, stands aside, or isn't seen.
SEEN, BESIDE, UNSEEN = 0, 1, 2


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of a page's blocks, in order; text that readers don't see is left out. An
    element left open ends with its parent, or where an article or main begins. White space
    within a block is one space. Takes time proportional to the page."""
    page, out, parts = page or "", [], []
    stack: list[tuple[str, int, bool]] = []  # name, state, in an article
    depth: dict[str, int] = {}  # open elements by name
    state, article = SEEN, False

    def close() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text and state != UNSEEN:
                out.append((text, ASIDE_BLOCK if state else ARTICLE if article else OUTSIDE))
            parts.clear()

    def pop() -> str:
        name = stack.pop()[0]
        depth[name] -= 1
        return name

    last = 0
    for m in PIECE.finditer(page):
        if m.start() > last and state != UNSEEN:
            parts.append(page[last : m.start()])
        last = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            if depth.get(name):
                if name not in INLINE:
                    close()
                while pop() != name:
                    pass
                state, article = stack[-1][1:] if stack else (SEEN, False)
            elif name not in INLINE:
                close()
            continue
        if name == "br":
            if state != UNSEEN:
                parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                close()
            continue
        attributes = m[4]
        if name not in INLINE:
            close()
            if name == "p":  # a paragraph ends the one before
                while stack and (stack[-1][0] in INLINE or stack[-1][0] == "p"):
                    if pop() == "p":
                        break
        main = name in ("article", "main") and not bad(name, attributes)
        if main and state and not any(n in ("article", "main") for n, s, _ in stack if not s):
            stack[:] = [(n, SEEN, a) for n, _, a in stack]  # what holds an article is no boilerplate
        state, article = stack[-1][1:] if stack else (SEEN, False)
        if not state and bad(name, attributes, article):
            # words aside within a line are no block of their own
            state = UNSEEN if name in HIDDEN or name in INLINE else BESIDE
        elif name in HIDDEN:
            state = UNSEEN
        article = article or (main and not state)
        if not m[4].rstrip().endswith("/") or name in ("article", "main", "div", "p"):
            stack.append((name, state, article))
            depth[name] = depth.get(name, 0) + 1
        if state == UNSEEN and name not in INLINE:
            parts.clear()
    if last < len(page) and state != UNSEEN:
        tail = page[last:]
        cut = tail.find("<", tail.rfind(">") + 1)  # a tag that the page's end cuts
        parts.append(tail if cut < 0 else tail[:cut])
    close()
    return out


def bad(name: str, attributes: str, article: bool = False) -> bool:
    """Whether an element holds no main text. An article's own header does."""
    if name in HIDDEN or name in ASIDE and not (article and name == "header") or name in ("article", "main", "section", "div", "ul", "ol", "p", "span", "table", "dl", "details", "figure", "td", "li", "h1", "h2", "h3", "h4", "a") and attributes and _bad_marks(name, attributes):
        return True
    return False


def _bad_marks(name: str, attributes: str) -> bool:
    if BAD_ROLE.search(attributes):
        return True
    if name in ("article", "main"):
        return False
    return any(BAD_NAME.fullmatch(x) for m in NAMED.finditer(attributes) for x in next(filter(None, m.groups()), "").split())


def suffix_array(stream: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a stream of tokens (numbers from 0), all of whose suffixes must
    differ, and for each place in it the longest common prefix with the one before. Ranks are
    made by prefix doubling, from `least` tokens on of those suffixes only that are still
    equal. Common prefixes shorter than `least` may be given as 0."""
    n = len(stream)
    rank, step = np.unique(stream, return_inverse=True)[1].astype(np.int64), 1
    levels = [(1, rank)]
    while step < least:
        more = min(step, least - step)
        second = np.zeros(n, np.int64)
        second[: max(0, n - more)] = rank[more:] + 1
        rank = np.unique(rank * (n + 2) + second, return_inverse=True)[1].astype(np.int64)
        step += more
        levels.append((step, rank.astype(np.int32)))
    order = np.argsort(rank, kind="stable")
    size = np.bincount(rank, minlength=1) if n else np.empty(0, np.int64)
    rank = (np.cumsum(size) - size)[rank] if n else rank  # by the first place of those that are equal
    levels[-1] = (step, rank.astype(np.int32))
    tied = order[np.repeat(size, size) > 1]
    shared = tied
    while len(tied):
        after = tied + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[tied]))
        tied, second = tied[by], second[by]
        first = rank[tied]
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        group = np.cumsum(new) - 1
        head = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        begin = np.repeat(head, np.diff(np.append(head, len(tied))))  # place of the old class in tied
        at = np.flatnonzero(new)
        rank = rank.copy()
        rank[tied] = first + at[group] - begin
        order[first + np.arange(len(tied)) - begin] = tied
        step *= 2
        levels.append((step, rank.astype(np.int32)))
        tied = tied[np.bincount(group)[group] > 1]
    lcp = np.zeros(n, np.int64)
    if len(shared):
        place = np.zeros(n, bool)
        place[rank[shared]] = True
        place[0] = False
        at = np.flatnonzero(place)
        a, b, long = order[at - 1], order[at], np.zeros(len(at), np.int64)
        for depth, r in reversed(levels):
            x, y = a + long, b + long
            same = (x < n) & (y < n) & (r[np.minimum(x, n - 1)] == r[np.minimum(y, n - 1)])
            long[same] += depth
        lcp[at] = long
    return order, lcp


def repeated(tokens: np.ndarray, segment: np.ndarray, page: np.ndarray, length: int) -> np.ndarray:
    """For each token, on how many distinct pages the run of `length` tokens that starts
    there occurs (0 if it would leave its segment). segment: of each token, ascending; page:
    of each segment. The stream has a token of its own behind each segment, and runs are the
    intervals of its suffix array whose common prefixes are `length` or longer; as longer
    repeats repeat their runs too, these cover all substrings of at least that length."""
    n, count = len(tokens), np.zeros(len(tokens), np.int64)
    if n < length:
        return count
    ends = np.append(np.flatnonzero(np.diff(segment)) + 1, n)
    stream = np.insert(tokens, ends, tokens.max() + 1 + np.arange(len(ends)))
    order, lcp = suffix_array(stream, length)
    inside = np.ones(len(stream), bool)
    inside[ends + np.arange(len(ends))] = False
    token = np.cumsum(inside) - 1
    whole = np.zeros(n, bool)
    whole[: n - length + 1] = segment[: n - length + 1] == segment[length - 1 :]
    count[whole] = 1
    interval = np.cumsum(lcp < length) - 1
    shared = np.flatnonzero((lcp >= length) | np.append(lcp[1:] >= length, False))
    at, interval = token[order[shared]], interval[shared]
    several = page.max(initial=0) + 1
    pairs = np.unique(interval * several + page[segment[at]])
    pages = np.bincount(pairs // several, minlength=interval.max(initial=-1) + 1)
    count[at] = pages[interval]
    return count


def kept(kinds: list[int]) -> list[bool]:
    """Which blocks of a page may be text: where it has an article, only the article's."""
    least = ARTICLE if ARTICLE in kinds else OUTSIDE
    return [k == least for k in kinds]


class Pages:
    """The pages of a host, or of a part of one, by their blocks: a text of lines, the first
    character of which is the block's kind. Pages are distinct by the blocks that may be text
    (`content` numbers them, there are `distinct`); in the stream those of a page come first
    and the others are a segment of their own."""

    def __init__(self, packed: list[str]):
        lines = [x.split("\n") if x else [] for x in packed]
        may = [kept([int(y[0]) for y in x]) for x in lines]
        known: dict[str, int] = {}
        self.content = np.array([known.setdefault("\n".join(y for y, k in zip(x, m) if k), len(known)) for x, m in zip(lines, may)], np.int64)
        self.distinct, self.pages = len(known), len(packed)
        flat = [(y, p, k) for p, (x, m) in enumerate(zip(lines, may)) for k in (True, False) for y, k_ in zip(x, m) if k_ == k]
        self.texts = [y[1:] for y, _, _ in flat]
        self.owner = np.array([p for _, p, _ in flat], np.int64)  # of blocks
        self.may = np.array([k for _, _, k in flat], bool)
        self.article = self.may & np.array([int(y[0]) == ARTICLE for y, _, _ in flat], bool)
        words = pc.split_pattern(pa.array(self.texts, pa.string()), " ")
        coded = words.flatten().dictionary_encode()
        self.words, self.tokens = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.offsets = words.offsets.to_numpy().astype(np.int64)
        self.size = np.diff(self.offsets)
        self.segment = np.repeat(2 * self.owner + ~self.may, self.size)  # of tokens
        self.in_article, self.open = np.repeat(self.article, self.size), np.repeat(self.may & ~self.article, self.size)

    def on(self, length: int) -> np.ndarray:
        return repeated(self.tokens, self.segment, np.repeat(self.content, 2), length)

    def short(self, length: int) -> np.ndarray:
        """Blocks outside articles that are shorter than a run, and may be text."""
        return np.flatnonzero(self.may & ~self.article & (self.size < length))

    def hashes(self, host: str, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of 64 bits of the runs, by the token where they start (0 where there is none),
        and of short(), the same in each task."""
        import xxhash

        seed = xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"))
        value = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words.to_pylist()), np.uint64, len(self.words))[self.tokens]
        n = max(len(value) - length + 1, 0)
        out, key = np.zeros(len(value), np.int64), np.full(n, seed, np.uint64)
        for i in range(length):
            key = key * np.uint64(0x9E3779B97F4A7C15) + value[i : n + i]
            key ^= key >> np.uint64(29)
        if n:
            out[:n] = np.where(self.segment[:n] == self.segment[length - 1 :], key.view(np.int64), 0)
        short = [xxhash.xxh64_intdigest(self.texts[i], seed) for i in self.short(length)]
        return out, np.array(short, np.uint64).view(np.int64)

    def text(self, on: np.ndarray, several: np.ndarray, length: int, least: float) -> list[str]:
        """The text of each page: without the tokens in runs on two pages (in articles on
        `least`), then without what the markup says is no text and without the short blocks
        that are on `several` pages. `on` has for each token the pages of the run that starts
        there."""
        covered = np.zeros(len(on) + length + 1, np.int64)
        at = np.flatnonzero(on >= np.where(self.in_article, least, 2))
        covered[: len(on)] += np.bincount(at, minlength=len(on))
        covered[length : len(on) + length] -= np.bincount(at, minlength=len(on))
        drop = np.cumsum(covered)[: len(on)] > 0
        gone = np.add.reduceat(np.append(drop, False), self.offsets[:-1]) * (self.size > 0) if len(self.texts) else self.size
        keep, out = self.may.copy(), [[] for _ in range(self.pages)]
        short = self.short(length)
        keep[short[several > 1]] = False
        for i in np.flatnonzero(keep & (gone < self.size)).tolist():
            text = self.texts[i]
            if gone[i]:
                a = self.offsets[i]
                text = " ".join(w for w, d in zip(text.split(" "), drop[a : a + self.size[i]]) if not d)
            out[self.owner[i]].append(text)
        return [" ".join(x) for x in out]


def boilerplate(packed: list[str], length: int, inside: float) -> list[str]:
    """The text of each of one host's pages, without the runs of `length` tokens or more, and
    whole short blocks, that distinct pages share. In an article a run must be on the share
    `inside` of the distinct pages, and at least 5: an article may well quote another."""
    p = Pages(packed)
    short, texts = p.short(length), {}
    for i in short:
        texts.setdefault(p.texts[i], set()).add(int(p.content[p.owner[i]]))
    several = np.array([len(texts[p.texts[i]]) for i in short], np.int64)
    return p.text(p.on(length), several, length, max(5, inside * p.distinct))


#: Bytes of html in a part of a host, parts of hosts that may be broadcast, and keys that may.
PART_BYTES, BROADCAST_HOSTS, BROADCAST_KEYS = 8_000_000, 500_000, 200_000
#: Ways in which the rows of a host are dealt where its number of parts is joined to them.
SALTS = 64


#: What a key is: a run outside articles, one on the share of a part's pages, one in an
#: article, a short block.
OPEN, SHARE, INSIDE, SHORT = 1, 2, 4, 8
#: Whether a page's runs are looked for: not if its blocks are those of another, by themselves,
#: or with those of pages of the same content, as one page.
REPEATED, ALONE, TOGETHER = 0, 1, 2


def across(parted: DataFrame, kinds: str, length: int, inside: float) -> DataFrame:
    """boilerplate() of hosts in several parts, with the same texts. parted: page_id, url,
    host, part, packed, content; pages with the same content are in one part.

    1. Each part gives the keys of its runs outside articles with the pages that have them
       there, and from its suffix array those of any runs on the share `inside` of its pages,
       for a run on that share of all the pages is so in one part at least.
    2. Of the keys on such a share, and of those that one page alone has outside articles, the
       pages that have them elsewhere, in articles, menus and the like, are counted in all
       parts. No page is counted in both steps.
    3. Keys on enough pages, few or joined page by page, cover the tokens."""
    spark = parted.sparkSession
    schema = f"{kinds}, host string, packed binary, content long, first boolean, looked int, key long, n long, kind int, pages long"
    names = ["page_id", "url", "host", "packed", "content", "first", "looked", "key", "n", "kind", "pages"]

    def index(t: pa.Table) -> pa.Table:
        host, blobs = t.column("host")[0].as_py(), t.column("packed").to_pylist()
        p = Pages([unpacked(x) for x in blobs])
        first = np.zeros(len(blobs), bool)
        first[np.unique(p.content, return_index=True)[1]] = True
        known: dict[bytes, int] = {}
        new = np.array([known.setdefault(x, i) == i for i, x in enumerate(blobs)])
        together = np.bincount(p.content[new], minlength=p.distinct)[p.content] > 1
        looked = np.where(new, np.where(together, TOGETHER, ALONE), REPEATED)
        on, (keys, short) = p.on(length), p.hashes(host, length)
        share = np.unique(keys[(keys != 0) & (on >= inside * p.distinct - 1e-6)])
        open_ = np.flatnonzero(p.open & (keys != 0))
        made = [(share, np.zeros(len(share), np.int64), SHARE)]
        for some, owner, kind in ((keys[open_], p.segment[open_] // 2, OPEN), (short, p.owner[p.short(length)], SHORT)):
            pairs = np.unique(np.stack((some, p.content[owner])), axis=1)
            made.append((*np.unique(pairs[0], return_counts=True), kind))
        key, n = (np.concatenate([x[i] for x in made]) for i in (0, 1))
        kind = np.repeat([k for _, _, k in made], [len(x) for x, _, _ in made])
        rows, more = len(blobs), len(key)
        none = lambda kind, k: pa.nulls(k, kind)
        columns = [
            pa.concat_arrays([t.column("page_id").combine_chunks(), none(t.column("page_id").type, more + 1)]),
            pa.concat_arrays([t.column("url").combine_chunks(), none(t.column("url").type, more + 1)]),
            pa.array([host] * (rows + more + 1)),
            pa.array(blobs + [None] * (more + 1), pa.binary()),
            pa.concat_arrays([t.column("content").combine_chunks(), none(pa.int64(), more + 1)]),
            pa.array(first.tolist() + [None] * (more + 1), pa.bool_()),
            pa.array(looked.tolist() + [None] * (more + 1), pa.int32()),
            pa.array([None] * rows + key.tolist() + [None], pa.int64()),
            pa.array([None] * rows + n.tolist() + [None], pa.int64()),
            pa.array([None] * rows + kind.tolist() + [None], pa.int32()),
            pa.array([None] * (rows + more) + [p.distinct], pa.int64()),
        ]
        trim()
        return pa.table(columns, names=names)

    made = written(parted.groupBy("host", "part").applyInArrow(index, schema))
    pages = made.where("packed is not null").select("page_id", "url", "host", "packed", "content", "first", "looked")
    totals = written(made.where("pages is not null").groupBy("host").agg(F.sum("pages").alias("pages")))
    counted = made.where("key is not null").groupBy("key").agg(F.sum("n").alias("n"), F.bit_or("kind").alias("kind"))
    has = lambda kind: F.col("kind").bitwiseAND(kind) != 0
    counted = written(counted.where(has(SHARE) | (has(OPEN) & (F.col("n") == 1)) | (F.col("n") > 1)))
    asked = counted.where(has(SHARE) | (has(OPEN) & (F.col("n") == 1))).select("key")
    n_asked = asked.count()

    def known(keys: DataFrame, n: int):
        """A broadcast of few keys with their values, or None."""
        return spark.sparkContext.broadcast({r[0]: r[1] for r in keys.collect()}) if n <= BROADCAST_KEYS else None

    def runs(batches: Iterator[pa.RecordBatch], few) -> Iterator[pa.RecordBatch]:
        """Distinct keys of each page's runs that it hasn't outside articles too, those of
        `few` if there are few, with the content of pages that are one together."""
        wanted = np.sort(np.fromiter(few.value, np.int64, len(few.value))) if few else None
        for b in pieces(batches, 1):
            hosts, looked = np.array(b.column(0).to_pylist(), object), b.column(3).to_numpy()
            content, blobs, found = b.column(2).to_numpy(), b.column(1).to_pylist(), [np.empty((3, 0), np.int64)]
            for at in np.split(np.arange(b.num_rows), np.flatnonzero(hosts[1:] != hosts[:-1]) + 1):
                p = Pages([unpacked(blobs[i]) for i in at])
                keys = p.hashes(hosts[at[0]], length)[0]
                use = np.flatnonzero((keys != 0) & (np.isin(keys, wanted) if few else True))
                # by page and key, the places in articles first
                use = use[np.lexsort((~p.in_article[use], keys[use], p.segment[use] // 2))]
                own, key = p.segment[use] // 2, keys[use]
                new = np.concatenate(([True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])))[: len(use)]
                bare = np.bincount(np.cumsum(new) - 1, p.open[use])[: new.sum()] == 0 if len(use) else new
                found.append(np.stack((key[new], at[own[new]], np.where(p.in_article[use[new]], INSIDE, 0)))[:, bare])
            key, own, kind = np.concatenate(found, axis=1)
            of = pa.array(content[own], pa.int64(), mask=looked[own] == ALONE)
            yield pa.RecordBatch.from_arrays([pa.array(key), of, pa.array(kind, pa.int32())], names=["key", "content", "kind"])
        trim()

    if n_asked:
        few = known(asked.withColumn("v", F.lit(0)), n_asked)
        found = pages.where(F.col("looked") != REPEATED).select("host", "packed", "content", "looked").mapInArrow(lambda batches: runs(batches, few), "key long, content long, kind int")
        found = found if few else found.join(asked, "key", "left_semi")
        alone, together = found.where("content is null"), found.where("content is not null").groupBy("key", "content").agg(F.bit_or("kind").alias("kind"))
        more = [x.groupBy("key").agg(F.count("*").alias("n"), F.bit_or("kind").alias("kind")) for x in (alone, together)]
        counted = counted.union(more[0]).union(more[1]).groupBy("key").agg(F.sum("n").alias("n"), F.bit_or("kind").alias("kind"))
    on_two, on_share = (has(OPEN) | has(SHORT)) & (F.col("n") > 1), has(SHARE) & has(INSIDE) & (F.col("n") >= 5)
    counted = written(counted.where(on_two | on_share).select("key", "n"))
    n_counted = counted.count()
    few = known(counted, n_counted)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for h, x, n, found in zip(*(b.column(c).to_pylist() for c in ("host", "packed", "pages", "found"))):
                many = few.value if few else {y["key"]: y["n"] for y in found or ()}
                p = Pages([unpacked(x)])
                keys, short = p.hashes(h, length) if many else (np.zeros(len(p.tokens), np.int64), np.zeros(len(p.short(length)), np.int64))
                on = [many.get(k, 0) for k in keys.tolist()] if many else keys
                several = np.array([many.get(k, 0) for k in short.tolist()], np.int64)
                texts += p.text(np.array(on, np.int64), several, length, max(5, inside * n))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
        trim()

    pages = pages.join(F.broadcast(totals) if totals.count() <= BROADCAST_HOSTS else totals, "host")
    if few:
        pages = pages.withColumn("found", F.lit(None).cast("array<struct<key:long,n:long>>"))
    else:
        pages = _with_keys(pages, counted, length)
    return pages.select("page_id", "url", "host", "packed", "pages", "found").mapInArrow(clean, f"{kinds}, text string, n_chars long")


def _with_keys(pages: DataFrame, counted: DataFrame, length: int) -> DataFrame:
    """The pages with those of the counted keys that are in them, joined by the key."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            got = []
            for h, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                p = Pages([unpacked(x)])
                keys, short = p.hashes(h, length)
                got.append(np.unique(np.concatenate((keys[(p.open | p.in_article) & (keys != 0)], short))))
            of = pa.array(np.repeat(np.arange(len(got)), [len(x) for x in got]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(np.concatenate(got), pa.int64())], names=["content", "host", "key"])

    pairs = pages.where("first").select("content", "host", "packed").mapInArrow(keys, "content long, host string, key long")
    found = pairs.join(counted, "key").groupBy("content", "host").agg(F.collect_list(F.struct("key", "n")).alias("found"))
    return pages.join(found, ["content", "host"], "left")


CODEC = "zstd"


def packed(found: list[tuple[str, int]]) -> bytes:
    """A page's blocks as lines of kind and text, compressed: its size, then the rest."""
    raw = "\n".join(f"{k}{t}" for t, k in found).encode("utf-8", "surrogatepass")
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=CODEC, asbytes=True)


def hashed(found: list[tuple[str, int]]) -> int:
    """Of the blocks that may be text and their kind, by which pages are distinct."""
    import xxhash

    return xxhash.xxh64_intdigest("\n".join(f"{kind}{t}" for (t, kind), k in zip(found, kept([k for _, k in found])) if k).encode("utf-8", "surrogatepass"))


def unpacked(x: bytes) -> str:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec=CODEC, asbytes=True).decode("utf-8", "surrogatepass")


def extract(pages: DataFrame, length: int = 8, inside: float = 0.5, part_bytes: int = PART_BYTES) -> DataFrame:
    """The main text of each page.

    A page is cut into blocks. The blocks of a host's pages, menus and footers too, are one
    stream of tokens, whose suffix array shows the substrings that distinct pages share: they
    are boilerplate and go, the unique runs stay. Of those, the blocks of menus, headers,
    footers, sidebars, notices, adverts, forms and comments that only one page has are known
    by their elements and names, and go too. See boilerplate() for articles.

    A host of more than `part_bytes` bytes of html is cut into parts with an array each, and
    across() counts over all of them; the texts don't depend on it.

    pages: page_id, url, html; other columns, of whatever names, are ignored. Null and empty
    pages have no text; null URLs are one host. Repeated pages are extracted each, and count
    as one page where runs are counted. Very long pages take time proportional to their
    length, tags left open too. No rows give no rows.

    Returns page_id, url, text string, n_chars long (code points).
    """
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn("_host", host(F.col("url")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            found = [blocks(x) for x in b.column(2).to_pylist()]
            content = np.array([hashed(x) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), pa.array([packed(x) for x in found], pa.binary()), pa.array(content)], names=["page_id", "url", "host", "parts", "packed", "content"])
        trim()

    types = dict(pages.dtypes)
    kinds = f"page_id {types['page_id']}, url {types['url']}"

    def cutted(some: DataFrame) -> DataFrame:
        return some.select("page_id", "url", "html", "_host", "parts").mapInArrow(cut, f"{kinds}, host string, parts long, packed binary, content long")

    size = F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long"))
    large = written(rows.groupBy("_host").agg(F.ceil(size / part_bytes).cast("long").alias("parts")).where("parts > 1"))
    n = large.count()

    def clean(t: pa.Table) -> pa.Table:
        blobs = t.column("packed").to_pylist()
        first: dict[bytes, int] = {}
        own = [first.setdefault(x, len(first)) for x in blobs]  # repeated pages once
        made = boilerplate([unpacked(x) for x in first], length, inside)
        texts = [made[i] for i in own]
        trim()
        return pa.table({"page_id": t.column("page_id"), "url": t.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    if not n:
        small = rows.withColumn("parts", F.lit(1).cast("long"))
    elif n <= BROADCAST_HOSTS:
        rows = rows.join(F.broadcast(large), "_host", "left")
        small = rows.where("parts is null")
    else:  # the rows of a hot host are dealt over several tasks
        salted = large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], "left")
        small = rows.where("parts is null")
    out = cutted(small).groupBy("host").applyInArrow(clean, f"{kinds}, text string, n_chars long")
    if not n:
        return out
    parted = cutted(rows.where("parts is not null")).withColumn("part", F.pmod("content", "parts"))
    return out.unionByName(across(parted.select("page_id", "url", "host", "part", "packed", "content"), kinds, length, inside))
