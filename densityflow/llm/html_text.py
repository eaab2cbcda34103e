"""Operator 3: main text of web pages, by a host's repeated text and by markup.

Pages are read by the tokenizer's rules of HTML into blocks: markup tells what is script, style, form,
menu, footer, comment and the like, and what stands inside an article. The token streams of all pages,
articles and furniture included, are then compared across each host for long repeated substrings.

A host's suffixes are ordered by their first RUN tokens, as in a suffix array of that depth: suffixes
of one beginning are one interval, and its size in distinct pages is what counts. A substring repeats on
MIN_PAGES pages exactly if each of its RUN-token beginnings does, so that the union of these intervals
covers what the maximal repeated substrings cover. Of suffixes that begin outside articles every one
is sent to be ordered, so that repeats of RUN tokens are found there. Inside articles, of each SPAN
neighbouring ones that of the smallest key is, which the tokens alone decide, so that every substring
of LONG = RUN + SPAN - 1 tokens has one that is the same on all pages. Around these seeds that
repeat, all suffixes are ordered. Seeds are counted with partial aggregation: a host's footer on
a third of all pages is one counter, not one task's list.

What goes: furniture; outside articles, all that long repeats cover, while the unique runs between them
stay; inside articles, blocks that are covered whole by text of at least SITE_SHARE of the host's pages
(a sign-up line, say), as long as they are the smaller part of the article: an article that
repeats as such, a copy, stays, and so does prose that quotes other pages.

Defined results: a null or empty html, or a page with nothing left, gives an empty text; a null url
belongs to the host of no name; repeated rows of a page_id each give their row, and count as one page;
other columns are ignored. An attribute's quote that is never closed ends at the next ``>``; an element
that is never closed ends with its parent; ``p``, ``li``, ``dt``, ``dd`` and parts of tables end where
HTML lets them; an unclosed comment, script or style ends with the page.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densityflow.llm.common import cut, if_small
from densityflow.llm.shingles import mix

RUN, SPAN = 6, 7
LONG = RUN + SPAN - 1
MIN_PAGES = 3
#: A host of fewer pages has no text of the whole site.
SITE_PAGES, SITE_SHARE = 5, 0.5
#: Kinds of blocks.
INSIDE, PLAIN, MARKED = 0, 1, 2

#: Names of HTML.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "head", "label", "fieldset", "datalist"} | {"noscript", "template", "svg", "math", "object", "canvas", "audio", "video"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form", "toolbar", "status"}
BLOCKS = set("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Names of classes outside articles; inside an article only those of adverts, comments and sharing count.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|newsletter|subscri\w*|signup|login|paywall|sidebar|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|foot|footer|header|masthead|comments?|comment-?list|disqus|respond|replies|reply|share|sharing|social|related|recommend\w*|widget|popup|modal|overlay|pagination|pager|toolbar|copyright|legal|skip-?link)(?:$|[\s_-]|\d)",
    re.I,
)
INNER_NAMES = {"ad", "ads", "advert", "advertisement", "adsense", "adsbygoogle", "sponsored", "comments", "comment-list", "commentlist", "disqus_thread", "newsletter", "newsletter-signup", "share", "share-buttons", "social-share", "sidebar", "cookie-notice", "cookie-banner"}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: What an element ends when it begins, if that stands open nearest of its kind.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "thead", "tbody", "tfoot"), "tfoot": ("td", "th", "tr", "thead", "tbody")}
NESTS = {"li", "ul", "ol", "menu", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th"}

# possessive, so that no text is read more than a few times
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+|[\"'][^>]*+|(?=>))))?+")


def _tag(page: str, at: int) -> tuple[list[tuple[str, str]], int, bool]:
    """Attributes of a tag from behind its name, where it ends, and whether it closes itself."""
    found = []
    while m := ATTRIBUTE.match(page, at):
        found.append((m[1].lower(), html.unescape(m[2] or m[3] or (m[4] or "").lstrip("\"'"))))
        at = m.end()
    end = page.find(">", at)
    return found, (len(page) if end < 0 else end + 1), end > 0 and page[end - 1] == "/"


def _furniture(name: str, attributes: list[tuple[str, str]], inside: bool) -> bool:
    for key, value in attributes:
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "role" and value.strip().lower() in ROLES:
            return True
        if key in ("class", "id") and (not INNER_NAMES.isdisjoint(value.lower().split()) if inside else NAMES.search(value)):
            return True
        if key == "style" and HIDDEN.search(value):
            return True
    return name in FURNITURE or (name == "header" and not inside)


class _Reader:
    """Open elements of a page while it is read, and its blocks (text, where, is furniture)."""

    def __init__(self) -> None:
        self.out: list[tuple[str, str, bool]] = []
        self.piece: list[str] = []
        self.open: list[tuple[str, str, bool]] = []  # element, and what held around it
        self.count: Counter[str] = Counter()
        self.nests: list[tuple[int, str]] = []  # depth and name of the open elements in NESTS
        self.where, self.gone = "", False

    def close_block(self) -> None:
        text = " ".join("".join(self.piece).split())
        self.piece.clear()
        if text:
            self.out.append((text, self.where, self.gone))

    def turn(self, where: str, gone: bool) -> None:
        if (where, gone) != (self.where, self.gone):
            self.close_block()
            self.where, self.gone = where, gone

    def pop(self, name: str) -> None:
        """Ends the innermost open element of the name and all in it."""
        while True:
            top, where, gone = self.open.pop()
            self.turn(where, gone)
            self.count[top] -= 1
            if self.nests and self.nests[-1][0] == len(self.open):
                self.nests.pop()
            if top == name:
                return

    def start(self, name: str, attributes: list[tuple[str, str]]) -> None:
        if name in BLOCKS and name not in ("br", "body", "html") and self.count["p"]:
            self.pop("p")
        for ended in ENDS.get(name, ()):
            if self.nests and self.nests[-1][1] == ended:
                self.pop(ended)
        if name in VOID:
            return
        gone = _furniture(name, attributes, bool(self.where))
        self.open.append((name, self.where, self.gone))
        self.count[name] += 1
        if name in NESTS:
            self.nests.append((len(self.open) - 1, name))
        where, around = self.where, self.gone
        if name == "article" and where == "article":
            gone = True  # an article in an article is a comment or a teaser
        elif name in ("article", "main") and not gone:
            # it ends furniture that was left open before it, but not menus, asides and such around it
            around = around and any(self.count[x] for x in FURNITURE)
            where = "article" if name == "article" or where == "article" else "main"
        self.turn(where, around or gone)


def blocks(page: str) -> list[tuple[str, int]]:
    """Texts of the blocks in order, with INSIDE for those of articles (or of the main element of a
    page that has no article), MARKED for furniture and PLAIN for others."""
    r = _Reader()
    at, end = 0, len(page)
    while at < end:
        stop = page.find("<", at)
        stop = end if stop < 0 else stop
        if stop > at:
            raw = page[at:stop]
            r.piece.append(html.unescape(raw) if "&" in raw else raw)
        if stop == end:
            break
        m = TAG.match(page, stop)
        if not m:
            if page.startswith("<!--", stop):
                close = re.compile(r"--!?>").search(page, stop + 2)
                at = close.end() if close else end
            elif page.startswith(("<!", "<?", "</"), stop):
                close = page.find(">", stop)
                at = end if close < 0 else close + 1
            else:
                r.piece.append("<")
                at = stop + 1
            continue
        name = m[2].lower()
        attributes, at, alone = _tag(page, m.end())
        if name in BLOCKS or name in RAW or name in FURNITURE:
            r.close_block()
        if m[1]:
            if r.count[name]:
                r.pop(name)
        elif name in RAW:
            if not alone:
                shut = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                close = page.find(">", shut.end()) if shut else -1
                at = end if close < 0 else close + 1
        else:
            r.start(name, attributes)
            if alone and name in ("svg", "math", "path"):
                r.pop(name)
    r.close_block()
    top = "article" if any(w == "article" for _, w, _ in r.out) else "main"
    return [(t, MARKED if gone else INSIDE if w == top else PLAIN) for t, w, gone in r.out]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def host_key(url: str | None) -> int:
    return int.from_bytes(hashlib.blake2b(host_of(url).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def suffix_keys(tokens: list[str]) -> np.ndarray:
    """A key for the first RUN tokens of each suffix that has so many."""
    n = len(tokens) - RUN + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    h = pd.util.hash_array(np.array(tokens, dtype=object), categorize=False)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(RUN):
        key = mix(key + h[k : k + n])
    return key.view(np.int64)


def seeds(keys: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """Places of the smallest key of each SPAN neighbours (of fewer, the smallest of all), and of all
    that begin outside articles; outside says so for each token."""
    if not len(keys):
        return np.empty(0, dtype=np.int64)
    own = outside[: len(keys)].copy()
    if len(keys) <= SPAN:
        own[np.argmin(keys)] = True
    else:
        near = np.lib.stride_tricks.sliding_window_view(keys, SPAN)
        own[near.argmin(axis=1) + np.arange(len(near))] = True
    return np.flatnonzero(own)


def _tokens(page: str | None) -> tuple[list[tuple[str, int]], list[str], np.ndarray]:
    """Blocks, their tokens, and which of these stand outside articles."""
    found = blocks(page or "")
    words = [t.split() for t, _ in found]
    outside = np.repeat(np.array([k != INSIDE for _, k in found], dtype=bool), [len(w) for w in words])
    return found, [t for w in words for t in w], outside


def _is_open(found: list[tuple[str, int]]) -> bool:
    """Whether a page has text that only repeats can judge."""
    return any(k == PLAIN for _, k in found)


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, key) of each page's distinct seeds; a null key counts the page, and open pages are marked."""
    for batch in batches:
        hosts, keys, marks = [], [], []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found, tokens, outside = _tokens(page.as_py())
            every = suffix_keys(tokens)
            own = np.unique(every[seeds(every, outside)])
            host = host_key(url)
            hosts.append(np.full(len(own) + 1, host, dtype=np.int64))
            keys += [pa.nulls(1, pa.int64()), pa.array(own)]
            marks.append(np.r_[_is_open(found), np.zeros(len(own), dtype=bool)])
        if hosts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hosts)), pa.concat_arrays(keys), pa.array(np.concatenate(marks))], names=["host", "key", "open"])


def _by_markup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page in batch.column(2):
            found = blocks(page.as_py() or "")
            texts.append(" ".join(t for t, k in found if k != MARKED))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page_id, url, page in zip(*(batch.column(k) for k in range(3)), strict=True):
            found, tokens, outside = _tokens(page.as_py())
            every = suffix_keys(tokens)
            at = seeds(every, outside)
            out.append((page_id.as_py(), url.as_py(), host_key(url.as_py()), " ".join(tokens), [3 * len(t.split()) + k for t, k in found], at, every[at]))
        cols = list(zip(*out, strict=True)) or [[]] * 7
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "url", "host", "words", "marks", "places", "keys"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, host, start, key) of all suffixes within SPAN of a page's repeated seeds."""
    for batch in batches:
        for row, host, words, hits in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            every = suffix_keys(words.split())
            wide = np.zeros(len(every) + 1, dtype=np.int64)
            for s in hits:
                wide[max(0, s - SPAN)] += 1
                wide[min(len(every), s + SPAN + 1)] -= 1
            at = np.flatnonzero(np.cumsum(wide)[:-1] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row)), pa.array(np.full(len(at), host)), pa.array(at), pa.array(every[at])], names=["row", "host", "start", "key"])


def covered(n: int, starts: list[int]) -> np.ndarray:
    edges = np.zeros(n + 1, dtype=np.int64)
    for s in starts:
        edges[s] += 1
        edges[s + RUN] -= 1
    return np.cumsum(edges)[:-1] > 0


def unique_runs(tokens: list[str], marks: list[int], starts: list[int], site: list[int]) -> str:
    """What stays of a page's tokens. marks: three times a block's tokens, plus its kind."""
    sizes, kinds = np.array(marks, dtype=np.int64) // 3, np.array(marks, dtype=np.int64) % 3
    of_block = np.repeat(np.arange(len(marks)), sizes)
    gone = (kinds[of_block] == MARKED) | ((kinds[of_block] == PLAIN) & covered(len(tokens), starts))
    wide = covered(len(tokens), site)
    whole = (np.bincount(of_block, weights=~wide, minlength=len(marks)) == 0) & (kinds == INSIDE)
    if 2 * sizes[whole].sum() < sizes[kinds == INSIDE].sum():
        gone |= whole[of_block]
    return " ".join(t for t, g in zip(tokens, gone, strict=True) if not g)


def _without_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        texts = [unique_runs(w.split(), m, s or [], t or []) for w, m, s, t in zip(rows["words"], rows["marks"], rows["starts"], rows["site"], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _counted_once(pages: DataFrame) -> DataFrame:
    """pages with one row of each page_id."""
    again = pages.groupBy("page_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("page_id").alias("_again"))
    again = cut(again)
    if not again.limit(1).count():
        return pages
    again = if_small(again)
    others = pages.join(again, pages["page_id"].eqNullSafe(again["_again"]), "left_anti")
    return others.unionByName(pages.join(again, pages["page_id"].eqNullSafe(again["_again"]), "left_semi").dropDuplicates(["page_id"]))


def main_texts(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each of pages (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html")
    once = _counted_once(pages)
    rows = once.select("url", "html").mapInArrow(_seed_rows, "host long, key long, open boolean")
    counts = rows.groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages"), F.max("open").alias("open"))
    counts = cut(counts.where((F.col("pages") >= min_pages) | F.col("key").isNull()))
    hosts = if_small(cut(counts.where("key IS NULL").select(F.col("host").alias("_host"), F.col("pages").alias("_all"), F.col("open").alias("_open"))))
    repeated = counts.where("key IS NOT NULL").select("host", "key", "pages").join(hosts, F.col("host") == F.col("_host"))
    site = (F.col("_all") >= SITE_PAGES) & (F.col("pages") >= SITE_SHARE * F.col("_all"))
    # what can change a row: repeats on hosts that have open pages, and those of whole sites
    wanted = cut(repeated.where(F.col("_open") | site).select("host", "key"))
    schema = "page_id long, url string, text string"
    if not wanted.limit(1).count():
        out = pages.mapInArrow(_by_markup, schema)
    else:
        of_hosts = if_small(cut(wanted.select(F.col("host").alias("_host")).distinct()))
        streams = cut(pages.mapInArrow(_streams, "page_id long, url string, host long, words string, marks array<int>, places array<bigint>, keys array<bigint>").withColumn("row", F.monotonically_increasing_id()))
        at = streams.join(of_hosts, F.col("host") == F.col("_host"), "left_semi").select("row", "host", F.explode(F.arrays_zip("places", "keys")).alias("s"))
        hits = at.select("row", "host", F.col("s.places").alias("start"), F.col("s.keys").alias("key")).join(if_small(wanted), ["host", "key"])
        hits = hits.groupBy("row").agg(F.collect_list("start").alias("hits"))  # no more than the page's own
        near = cut(streams.join(hits, "row").select("row", "host", "words", "hits").mapInArrow(_near, "row long, host long, start long, key long"))
        # repeated rows of a page stand for one
        pages_of = near.join(if_small(_first_rows(streams)), F.col("row") == F.col("_row"), "left_anti") if once is not pages else near
        again = pages_of.select("row", "host", "key").distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
        again = cut(again.join(hosts, F.col("host") == F.col("_host")).select("host", "key", site.alias("site")))
        starts = near.join(if_small(again), ["host", "key"]).groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list(F.when(F.col("site"), F.col("start"))).alias("site"))
        out = streams.join(starts, "row", "left").select("page_id", "url", "words", "marks", "starts", "site").mapInArrow(_without_repeats, schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def _first_rows(streams: DataFrame) -> DataFrame:
    """(_row): rows that repeat the page_id of an earlier one."""
    first = streams.groupBy("page_id").agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("page_id").alias("_page"), "_first")
    rows = streams.select("page_id", "row")
    return cut(rows.join(first, rows["page_id"].eqNullSafe(first["_page"])).where("row != _first").select(F.col("row").alias("_row")))
