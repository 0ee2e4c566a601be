"""HTML extraction with a suffix array for each host.

A page becomes a stream of blocks, each with the words it shows and what its
elements say about it: inside the article, inside furniture (menus, headers,
footers, adverts, forms, comments and so on), or neither. Pages are
concatenated as token streams, markup included; suffixes sorted by prefix
doubling bring equal substrings together, and those of ``LONG`` tokens or more
that occur on several distinct pages of a host are boilerplate: every longer
repeat is covered by its own pieces of that length, so ranks are doubled up to
it and no further. A page keeps its article, without furniture and without what
a large share of the host's pages repeats; where no element marks an article,
it keeps the unique runs that boilerplate doesn't cover. A run that reaches into
a block from markup or from other blocks takes the block whole or leaves it
whole; only a run inside a block cuts words out of it.

Tasks make a suffix array of ``PART`` pages at a time and send each other the
distinct substrings with how many pages hold them; the sums are those of whole
hosts. Those on several pages become sorted arrays in the shared folder, which
workers map when they cut the pages. Pages stay where they are, so a host's
size bounds no task.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .lm import BUFFER, MAX_PART_BITS
from .lm import _dealt as dealt
from .lm import _gathered as gathered
from .lm import _sent as sent
from .runtime import arrow_map, few, shared_path, small_batches, spare, written
from .tokens import gram_hash, pieces
from .urlfilter import host_of

#: Tokens of the shortest substring that counts as boilerplate, and pages that must show it.
LONG = 8
PAGES = 3
#: Share of the host's pages, and pages at least, that must show it inside an article: copies and quotes stay.
SHARE = 0.5
ARTICLE_PAGES = 6
#: Pages of a suffix array.
PART = 200
#: A page's weight in sums; copies share it.
ONE = 1 << 32

# Element names of HTML.
DROPPED = frozenset("script style noscript template svg iframe object canvas textarea select option button head math audio video".split())
RAW = frozenset("script style textarea noscript iframe title".split())
FURNITURE = frozenset("nav footer aside form dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset("article main".split())
#: Words in class and id that mark furniture.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar footer header masthead cookie cookies consent notice notices popup modal newsletter subscribe subscription signup share sharing social "
    "related recommended comment comments commentlist discussion respond reply replies disqus pagination pager toolbar widget widgets skip login search".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_MARKS = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

ARTICLE_TEXT, PLAIN, GONE = 0, 1, 2


def _is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    if name in FURNITURE or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body", "article", "main") and "comment" not in attributes.lower():
        return False
    for m in _MARKS.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id"):
            words = set(re.split(r"[^a-z]+", value))
            # An article's own header holds its title.
            if not WORDS.isdisjoint(words - {"header", "masthead"} if in_article else words):
                return True
    return False


def blocks(page: str) -> list[tuple[int, str, str]]:
    """(kind, markup before it, text) of every block of a page, in order."""
    out: list[tuple[int, str, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, drops what is inside, is the article
    wrapped = False  # whether an article has begun
    text: list[str] = []
    marks: list[str] = []
    kind_now = PLAIN

    def kind() -> int:
        if any(s[1] for s in stack):
            return GONE
        return ARTICLE_TEXT if any(s[2] for s in stack) else PLAIN

    def flush() -> None:
        said = " ".join("".join(text).split())
        if said:
            out.append((kind_now, "".join(marks), said))
            marks.clear()
        text.clear()

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            text.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        if name in INLINE:
            if not m[1] and name not in VOID and name != "a" and m[3] and kind_now != GONE and _is_furniture(name, m[3], True):
                flush()
                stack.append((name, True, False))
                kind_now = kind()
            elif m[1] and stack and any(s[0] == name and s[1] for s in stack):
                flush()
                _close(stack, name)
                kind_now = kind()
            continue
        if not m[1] and name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            if name in ("script", "style"):  # not seen, so they part no words
                continue
        flush()
        marks.append(f"<{m[1]}{name}>")
        if m[1]:
            _close(stack, name)
        elif name in RAW:
            pass
        elif name not in VOID and not m[3].endswith("/"):
            inside = any(s[2] for s in stack)
            drops = name in DROPPED or _is_furniture(name, m[3], inside)
            if name in ARTICLE and not drops and not wrapped:
                # What holds the first article is a wrapper, whatever its class says.
                wrapped = True
                stack = [(n, d and (n in DROPPED or n in FURNITURE), a) for n, d, a in stack]
            stack.append((name, drops, name in ARTICLE))
        kind_now = kind()
    flush()
    return out


def _close(stack: list[tuple[str, bool, bool]], name: str) -> None:
    """Ends the innermost element of that name and what is open in it; an article or furniture isn't ended by an outer paragraph's end."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == name:
            del stack[i:]
            return


def _windows(tokens: np.ndarray, page: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a substring of ``length`` tokens of one page starts, and its rank: equal ranks are equal substrings.

    ``page`` numbers the page of each token; no substring crosses pages. The
    suffixes are ranked by prefix doubling up to ``length`` tokens.
    """
    n = len(tokens)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < length:
        step = min(width, length - width)
        ahead = np.zeros(n, np.int64)
        ahead[:-step] = rank[step:] + 1
        ahead[:-step][page[step:] != page[:-step]] = 0
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1]
        width += step
    starts = np.flatnonzero(page[length - 1 :] == page[: n - length + 1])
    return starts, rank[starts]


def _covered(n: int, hit: np.ndarray, length: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _pages(rank: np.ndarray, page: np.ndarray) -> np.ndarray:
    """How many distinct pages hold each window; ``page`` has the page of each."""
    if not len(rank):
        return rank
    n = int(page.max()) + 1
    both = np.unique(rank * n + page)
    return np.bincount(both // n, minlength=int(rank.max()) + 1)[rank]


def repeated(tokens: np.ndarray, page: np.ndarray, length: int, pages: int) -> np.ndarray:
    """Tokens covered by a substring of ``length`` or more that ``pages`` distinct pages hold."""
    starts, rank = _windows(tokens, page, length)
    return _covered(len(tokens), starts[_pages(rank, page[starts]) >= pages], length)


@dataclass
class Stream:
    """Blocks and token hashes of some pages. ``open`` tells the tokens that repeats may drop, ``block`` the block of each word (-1: markup), ``marked`` the pages with an article."""

    blocks: list[list[tuple[int, str, str]]]
    tokens: np.ndarray
    page: np.ndarray
    open: np.ndarray
    block: np.ndarray
    marked: np.ndarray

    @classmethod
    def of(cls, pages: list[str]) -> Stream:
        found = [blocks(p) for p in pages]
        marked = np.array([any(k == ARTICLE_TEXT for k, _, _ in page) for page in found], bool)
        runs, drops, own = [], [], []
        for page, has in zip(found, marked.tolist(), strict=True):
            stake = ARTICLE_TEXT if has else PLAIN
            for kind, marks, text in page:
                runs += (marks.count(">"), text.count(" ") + 1)
                drops += (False, kind == stake)
                own += (-1, len(own) // 2)
        # Neither names of elements nor words hold white space.
        said = [" ".join([x for _, marks, text in page for x in (marks.replace("><", "> <"), text)]) for page in found]
        tokens, sizes = [np.empty(0, np.uint64)], []
        for piece in pieces(pa.array(said, pa.string())):
            tokens.append(piece.hashes(lower=False))
            sizes += np.diff(piece.first).tolist()
        return cls(found, np.concatenate(tokens), np.repeat(np.arange(len(found)), sizes), np.repeat(np.array(drops, bool), runs), np.repeat(np.array(own, np.int64), runs), marked)

    def least(self, of_host: np.ndarray) -> np.ndarray:
        """Pages that must show a run for it to go from each page; ``of_host`` has how many distinct pages the host of each has."""
        return np.where(self.marked, np.maximum(ARTICLE_PAGES, np.ceil(SHARE * of_host)), PAGES)

    def at_stake(self, starts: np.ndarray) -> np.ndarray:
        """Which of the windows that start there hold a token that repeats may drop."""
        upto = np.concatenate([[0], np.cumsum(self.open)])
        return upto[starts + LONG] > upto[starts]

    def keys(self, starts: np.ndarray, host: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each window with its host; ``host`` has a number for each page."""
        return gram_hash([host[self.page[starts]], *(self.tokens[starts + k] for k in range(LONG))])

    def texts(self, hit: np.ndarray) -> list[str]:
        """Main text of each page; repeated windows start at ``hit``."""
        n = len(self.tokens)
        gone = _covered(n, hit, LONG) & self.open
        inside = hit[(self.block[hit] >= 0) & (self.block[hit] == self.block[hit + LONG - 1])]
        within = _covered(n, inside, LONG) & self.open
        out, at = [], 0
        for page in self.blocks:
            marked = any(k == ARTICLE_TEXT for k, _, _ in page)
            kept = []
            for kind, marks, text in page:
                at += marks.count(">")
                said = text.split(" ")
                hidden = gone[at : at + len(said)]
                if not hidden.all():
                    hidden = within[at : at + len(said)]
                at += len(said)
                if kind == GONE or kind == PLAIN and marked:
                    continue
                if hidden.any():
                    kept += [w for w, g in zip(said, hidden, strict=True) if not g]
                else:
                    kept.append(text)
            out.append(" ".join(kept))
        return out


def extract(pages: list[str]) -> list[str]:
    """Main text of each of the pages of a host. Equal pages count as one."""
    kinds = {p: i for i, p in enumerate(dict.fromkeys(pages))}
    stream = Stream.of(list(kinds))
    starts, rank = _windows(stream.tokens, stream.page, LONG)
    least = stream.least(np.full(len(kinds), len(kinds)))
    hit = _pages(rank, stream.page[starts]) >= least[stream.page[starts]]
    texts = stream.texts(starts[hit])
    return [texts[kinds[p]] for p in pages]


def _counts(pages: list[str], host: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Keys of hosts and of the windows at stake in some pages, and the weight of the pages of each; from one suffix array."""
    stream = Stream.of(pages)
    starts, rank = _windows(stream.tokens, stream.page, LONG)
    stake = stream.at_stake(starts)
    starts, rank = starts[stake], rank[stake]
    # A window counts once a page.
    _, first = np.unique(rank * len(pages) + stream.page[starts], return_index=True)
    starts = starts[first]
    return store.summed([[gram_hash([host]), weight], [stream.keys(starts, host), weight[stream.page[starts]]]])


@dataclass
class Repeats:
    """Windows that several distinct pages of a host hold, and hosts of several, as sorted arrays in the shared folder."""

    folder: str
    parts: int
    present: frozenset[int] = frozenset()

    def part_of(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.parts.bit_length() + 1)).astype(np.int64)

    def pages(self, keys: np.ndarray) -> np.ndarray:
        """How many distinct pages of its host hold each window, or how many a host has; 0 if fewer than PAGES."""
        kinds, at = np.unique(keys, return_inverse=True)
        out = np.zeros(len(kinds), np.int64)
        edges = np.searchsorted(self.part_of(kinds), np.arange(self.parts + 1))
        for p in self.present:
            a, b = edges[p], edges[p + 1]
            if a < b:
                known = store.mapped(self.folder, f"repeats-{p}", "<u8")
                i = np.minimum(np.searchsorted(known, kinds[a:b]), len(known) - 1)
                out[a:b] = np.where(known[i] == kinds[a:b], store.mapped(self.folder, f"repeat_pages-{p}", "<u8")[i].astype(np.int64), 0)
        return out[at]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, PART):
        yield batch.slice(i, PART)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _repeats(rows: DataFrame) -> Repeats:
    """Counts the windows of all hosts. ``rows``: html, number of the host, how many rows show the same page of it."""
    folder = shared_path(rows.sparkSession, "repeats")
    parts = 1 << min(MAX_PART_BITS, max(2, (2 * rows.rdd.getNumPartitions() - 1).bit_length()))
    found = Repeats(folder, parts)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                keys, weights = store.summed(held)
                held.clear()
                if len(keys):
                    yield sent(keys, found.part_of(keys), weights)

        for batch in batches:
            for piece in _slices(batch):
                # Copies share the weight of one page, to within half a unit each.
                weight = np.rint(ONE / _numbers(piece.column(2)).astype(np.float64)).astype(np.uint64)
                held.append(_counts(piece.column(0).to_pylist(), _numbers(piece.column(1)), weight))
                n += len(held[-1][0])
                if n > BUFFER:
                    yield from flush()
                    n = 0
        yield from flush()

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (keys, weights) in gathered(batches):
            pages = (weights + np.uint64(ONE // 2)) // np.uint64(ONE)
            often = pages >= PAGES
            if often.any():
                store.put(folder, f"repeats-{part}", keys[often].astype("<u8"))
                store.put(folder, f"repeat_pages-{part}", pages[often].astype("<u8"))
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32())})

    saved = arrow_map(dealt(arrow_map(rows, count, "part int, packed binary")), save, "part int").collect()
    found.present = frozenset(r["part"] for r in saved)
    return found


def main_text(pages: DataFrame, out: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` without ``html`` and with the main text of each, and its code points.

    ``pages``: url, html and any other columns, which stay. Added columns get
    underscores in front if ``pages`` has their names. White space inside a
    block becomes one space; blocks are joined by one space in page order.

    A null html is empty and gives an empty text. Null urls form a host of
    their own. Repeated rows stay, and count as one page. An empty table gives an
    empty one.
    """
    small_batches(pages.sparkSession)
    host, digest, copies = spare(pages, "_host"), spare(pages, "_digest"), spare(pages, "_copies")
    rest = [c for c in pages.columns if c.lower() != "html"]
    html = F.coalesce("html", F.lit(""))
    rows = pages.withColumn(host, F.xxhash64(host_of(F.col("url")))).withColumn(digest, F.xxhash64(html, F.length(html)))
    same = written(rows.groupBy(host, digest).agg(F.count(F.lit(1)).alias(copies)).where(F.col(copies) > 1), "copies")
    rows = rows.join(few(same), [host, digest], "left").select(html.alias("html"), F.col(host), F.coalesce(copies, F.lit(1)).cast("long").alias(copies), *rest)
    repeats = _repeats(rows.select("html", host, copies))
    text, chars = spare(pages, out), spare(pages, n_chars)
    schema = rows.select(*rest, F.lit("").alias(text), F.lit(0).cast("long").alias(chars)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        for batch in batches:
            for piece in _slices(batch):
                stream = Stream.of(piece.column(0).to_pylist())
                starts = np.flatnonzero(stream.page[LONG - 1 :] == stream.page[: max(0, len(stream.page) - LONG + 1)])
                starts = starts[stream.at_stake(starts)]
                host = _numbers(piece.column(1))
                least = stream.least(repeats.pages(gram_hash([host])))
                often = repeats.pages(stream.keys(starts, host)) >= least[stream.page[starts]]
                texts = stream.texts(starts[often])
                yield pa.RecordBatch.from_arrays([*piece.columns[3:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return arrow_map(rows, run, schema)
