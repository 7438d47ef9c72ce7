"""HTML extraction: the main text of pages, by markup and by host-wide repeated runs.

Markup cuts a page into blocks, each of them *named* (it stands in a menu, header,
footer, sidebar, notice, advert, form or reader comments), *main* (in an ``article`` or
``main`` element) or *other*. The blocks of a page, one after another, are its token stream.

Suffixes of all streams of a host are compared across pages: what two suffixes have in
common at their beginning is a repeated run. Sorting them to the end would bring a hot
host, or a hot run, together in one task. Only equality of beginnings matters, so
suffixes are grouped by a hash of their first ``GRAM`` tokens instead, with counts of
pages that are summed up before the shuffle. Nor is every suffix needed: of each
``SPACING`` suffixes in a row the one of least hash is an anchor, which makes anchors the
same wherever the text is, and each repeated run of ``RUN`` tokens holds one. Whole
blocks are counted in the same way, for the edges of runs.

A run is boilerplate if it stands on a share of the host's pages, and on pages of
different content (told apart by six bits of a hash): the ``Rule`` is strict for main
blocks and loose for other ones. A block goes if runs cover half of it, or if it is
repeated as a whole next to a run. Copies of an article on many pages are repeated too;
they cover most of the page, so main blocks stay if more than half of their words
would go, and other blocks if all would. Named blocks always go, and other blocks go
where main ones are (unless these are a teaser, ``TEASER`` of the words at most).

Defined results: null pages are empty; empty or unparsable markup gives the text that
is left (possibly none); unclosed elements end with their parents; pages of equal
content count once among the pages of a run; pages without a URL are one host;
repeated rows are extracted each; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import _arrow_schema, forget, text_or_empty, written

GRAM, SPACING = 6, 11
RUN = GRAM + SPACING - 1
TEASER = 0.2
MOST_KEYS, MOST_HOSTS = 1 << 21, 1 << 20
PAGES_AT_ONCE = 100


class Rule(NamedTuple):
    pages: int
    share: float


MAIN_RULE, OTHER_RULE = Rule(5, 0.5), Rule(2, 0.05)
NAMED_BLOCK, OTHER_BLOCK, MAIN_BLOCK = range(3)

# Element names of the HTML standard by their role.
RAW = frozenset("script style template iframe textarea title noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
EXCLUDED = frozenset("head nav footer aside form menu button select dialog datalist annotation annotation-xml desc metadata".split())
EXCLUDED_OUTSIDE = frozenset("header noscript".split())  # of an article they are its own
MAIN = frozenset("article main".split())
NEVER_EXCLUDED = frozenset("html body article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table"
    " tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCKS - frozenset("br caption dd dt legend li optgroup option tbody td tfoot th thead tr body head html".split())
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
# Words of class, id and role that name page parts outside the main text.
PARTS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices sidebar nav navbar"
    " navigation menu breadcrumb breadcrumbs comment comments disqus respond reply replies newsletter subscribe signup login popup modal overlay"
    " share sharing social related recommended links widget footer masthead topbar toolbar pagination pager complementary contentinfo search alert dialog".split()
)

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S
)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I).findall
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I).search
WORDS = re.compile(r"[a-z]+").findall
SPLIT_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])").sub  # commentList is comment-list
# Elements that hold text of their own, whose ids are anchors and whose classes are styles.
TEXTS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li dt dd td th caption figure figcaption".split())
READERS = frozenset("comment comments disqus respond reply replies".split())
ADVERTS = frozenset("ad ads advert adverts advertisement adsense sponsored".split())
# Words that say where or what kind a part is, not what it holds.
PLACES = frozenset(
    "list lists section area slot container box bar wrap wrapper block unit item items body inner outer panel holder zone region row column col grid"
    " group thread form field button buttons link icon icons top bottom left right site page global primary secondary main mobile desktop sticky"
    " fixed user users reader readers google dfp gpt leaderboard rectangle skyscraper inline wp id js".split()
)
FLAGS = frozenset("no not non has have with without is are hide hides hidden show free less".split())  # of a page, not names of a part
LAYOUT, CONTENT = frozenset("wrap wrapper container layout grid row column col".split()), frozenset("content article post entry story".split())
BY_WORDS, FOR_GOOD = 1, 2  # an article or main element lifts the first


def named_part(token: str, within_main: bool) -> str:
    """The word of ``PARTS`` that a class or id names a part by, or an empty string.

    It is the head: the last word that isn't one of ``PLACES``, so comment-list, ad-slot and site-footer name
    a part, while comment-free, search-engines and content-sidebar-wrap (a layout) don't, nor do
    no-sidebar and has-menu. Within main, words before the head must be parts or places as well.
    """
    words = WORDS(token)
    if not words or FLAGS.intersection(words) or (words[-1] in LAYOUT and CONTENT.intersection(words)):
        return ""
    parts = PARTS if within_main else PARTS | {"header"}
    head = next((w for w in reversed(words) if w not in PLACES or w in parts), "")
    if head not in parts or within_main and not all(w in parts or w in PLACES for w in words):
        return ""
    return head


def exclusion(name: str, attributes: str, within_main: bool) -> int:
    """0, ``BY_WORDS`` of class, id or role, or ``FOR_GOOD``. Elements that hold text of their own go if a class names
    reader comments or adverts; their ids, and those of sections within main, are anchors and never count."""
    if name in EXCLUDED or name in EXCLUDED_OUTSIDE and not within_main:
        return FOR_GOOD
    if name in NEVER_EXCLUDED and (name != "article" or not attributes):
        return 0
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return 0
    if HIDDEN(attributes):
        return FOR_GOOD
    found = 0
    for kind, a, b, c in ATTRIBUTE(attributes):
        kind = kind.lower()
        for token in (a or b or c).split():
            head = named_part(SPLIT_CASE("-", token).lower(), within_main or name == "article")
            if not head:
                continue
            if name == "article":
                if kind == "class" and head in READERS:
                    return FOR_GOOD
                continue
            if name in TEXTS:
                if kind == "class" and head in READERS | ADVERTS:
                    return FOR_GOOD
                continue
            if kind == "id" and name == "section" and within_main:
                continue
            if kind == "role" or head in READERS:
                return FOR_GOOD
            found = BY_WORDS
    return found


def blocks(page: str) -> list[tuple[str, int]]:
    """The text blocks of a page in order, and what each of them is."""
    found, text, named = [], [], []
    stack: list[tuple[str, int, bool]] = []  # name, excluded, within main
    excluded, main = 0, False

    def flush() -> None:
        for pieces, kind in ((named, NAMED_BLOCK), (text, MAIN_BLOCK if main else OTHER_BLOCK)):
            if block := " ".join("".join(pieces).split()):
                found.append((block, kind))
            pieces.clear()

    at, find = 0, MARKUP.search
    while True:
        m = find(page, at)
        if between := page[at : m.start() if m else len(page)]:
            (named if excluded else text).append(html.unescape(between))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] if m[2] else m[6]
        if closing:
            if name in BLOCKS:
                flush()
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
                _, excluded, main = stack[-1] if stack else ("", 0, False)
            continue
        if name in BLOCKS:
            flush()
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "body":
            stack.clear()
            excluded, main = 0, False
        if name in ENDS_PARAGRAPH and any(s[0] == "p" for s in stack):
            while stack.pop()[0] != "p":
                pass
            _, excluded, main = stack[-1] if stack else ("", 0, False)
        if name in ENDS_SAME and stack and stack[-1][0] in ENDS_SAME[name]:
            while stack and stack[-1][0] in ENDS_SAME[name]:
                stack.pop()
            _, excluded, main = stack[-1] if stack else ("", 0, False)
        if name in MAIN and excluded == BY_WORDS and not main:
            excluded = 0
        excluded = excluded or exclusion(name, attributes or "", main)
        main = main or (name in MAIN and not excluded)
        stack.append((name, excluded, main))
    flush()
    words = [0, 0, 0]
    for block, kind in found:
        words[kind] += block.count(" ") + 1
    if words[MAIN_BLOCK] <= TEASER * words[OTHER_BLOCK]:
        found = [(block, min(kind, OTHER_BLOCK)) for block, kind in found]
    return found


_rng = np.random.default_rng(31)
_MIX = _rng.integers(1, 1 << 63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TOP = np.uint64(np.iinfo(np.uint64).max)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of the base and of its inverse, as long as the longest page so far


def token_hashes(words: str) -> np.ndarray:
    """Hashes of the tokens of a text with one space between two of them: polynomials of their bytes."""
    data = np.frombuffer(words.encode(), np.uint8)
    if len(_powers[0]) <= len(data):
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * len(data), b)])) for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64)))]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[0][: len(data)], out=sums[1:])
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]])
    return _mixed((sums[ends] - sums[starts]) * _powers[1][starts])


class Stream:
    """Blocks of a page with their keys, of anchors by place and of blocks; a key holds the host's whole hash."""

    def __init__(self, host: int, page: str):
        self.blocks = blocks(page)
        self.ends = np.cumsum([0, *(b.count(" ") + 1 for b, _ in self.blocks)])
        h = token_hashes(" ".join(b for b, _ in self.blocks)) if self.blocks else np.zeros(0, np.uint64)
        n = len(h) - GRAM + 1
        self.places = np.zeros(0, np.int64)
        if n > 0:
            grams = np.zeros(n, np.uint64)
            for k in range(GRAM):
                grams += h[k : k + n] * _MIX[k]
            grams = _mixed(grams)
            padded = np.concatenate([grams, np.full(SPACING - 1, _TOP)])
            self.places = np.unique(np.lib.stride_tricks.sliding_window_view(padded, SPACING).argmin(axis=1) + np.arange(n))
            anchors = grams[self.places]
        else:
            anchors = np.zeros(0, np.uint64)
        whole = np.fromiter((xxhash.xxh64_intdigest(b, 1) for b, _ in self.blocks), np.uint64, len(self.blocks))
        content = xxhash.xxh64_intdigest(h.tobytes())
        self.bit = np.int64(1 << (content & 63)) if content & 63 < 63 else np.iinfo(np.int64).min
        self.host = host
        self.keys = _mixed(np.concatenate([anchors, whole]) ^ np.uint64(host & (1 << 64) - 1)).view(np.int64)

    def text(self, weak: np.ndarray, strong: np.ndarray) -> str:
        """``weak``, ``strong``: which of the keys are boilerplate among other and among main blocks."""
        kinds = np.array([k for _, k in self.blocks], np.int64)
        kind = MAIN_BLOCK if MAIN_BLOCK in kinds else OTHER_BLOCK
        frequent, n = (strong if kind == MAIN_BLOCK else weak), len(self.places)
        kept = kinds == kind
        if frequent[:n].any():
            covered = self._covered(self.places[frequent[:n]])
            sizes, sums = np.diff(self.ends), np.r_[0, np.cumsum(covered)]
            share = (sums[self.ends[1:]] - sums[self.ends[:-1]]) / sizes
            edged = np.r_[False, covered, False]
            beside = edged[self.ends[:-1]] | edged[self.ends[1:] + 1] | (share > 0)
            gone = kept & ((share >= 0.5) | frequent[n : n + len(kinds)] & beside)
            most = sizes[kept].sum() / 2 if kind == MAIN_BLOCK else sizes[kept].sum() - 1
            if sizes[gone].sum() <= most:
                kept &= ~gone
        return " ".join(b for (b, _), k in zip(self.blocks, kept) if k)

    def _covered(self, places: np.ndarray) -> np.ndarray:
        """Tokens within a boilerplate anchor, or between two of them that are neighbours."""
        change = np.zeros(self.ends[-1] + 1, np.int64)
        far = np.r_[True, np.diff(places) > SPACING]
        np.add.at(change, places[far], 1)
        np.add.at(change, places[np.r_[far[1:], True]] + GRAM, -1)
        return np.cumsum(change[:-1]) > 0


def _streams(batches: Iterator[pa.RecordBatch], host: int, page: int) -> Iterator[tuple[pa.RecordBatch, list[Stream]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, PAGES_AT_ONCE):
            batch = whole.slice(at, PAGES_AT_ONCE)
            yield batch, [Stream(h, p) for h, p in zip(batch.column(host).to_pylist(), batch.column(page).to_pylist())]


def counted_keys(pages: DataFrame, with_page: bool = False) -> DataFrame:
    """(key, host, bit[, page]) of the different keys of every page. ``pages``: host, page (its hash), html."""
    schema = "key long, host long, bit long" + ", page long" * with_page
    out = _arrow_schema(pages.sparkSession, schema)

    def run(batches):
        for batch, streams in _streams(batches, 0, 2):
            keys = [np.unique(s.keys) for s in streams]
            sizes = [len(k) for k in keys]
            columns = [np.concatenate(keys), np.repeat(np.array([s.host for s in streams], np.int64), sizes), np.repeat([s.bit for s in streams], sizes)]
            if with_page:
                columns.append(np.repeat(batch.column(1).to_numpy(), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=out)

    return pages.select("host", "page", "html").mapInArrow(run, schema)


def boilerplate(counted: DataFrame, hosts: DataFrame, main: Rule = MAIN_RULE, other: Rule = OTHER_RULE) -> DataFrame:
    """(key, strong, weak) of the keys that one of the rules names; ``strong`` is the rule of main blocks.
    ``hosts``: host, host_pages. They are broadcast up to ``MOST_HOSTS``, and joined by a shuffle beyond."""
    sums = counted.groupBy("key").agg(F.count("*").alias("n"), F.bit_or("bit").alias("bits"), F.min("host").alias("host"))
    repeated = written(sums.filter("n > 1").select("key", "host", "n", F.bit_count("bits").alias("contents")), "repeated")
    hosts = written(hosts, "hosts")
    shared = repeated.join(F.broadcast(hosts) if hosts.count() <= MOST_HOSTS else hosts.hint("merge"), "host")
    holds = lambda r: (F.col("contents") >= r.pages) & (F.col("n") >= r.share * F.col("host_pages"))
    found = written(shared.filter(holds(other) | holds(main)).select("key", holds(main).alias("strong"), holds(other).alias("weak")), "boilerplate")
    forget(repeated, hosts)
    return found


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", main: Rule = MAIN_RULE, other: Rule = OTHER_RULE) -> DataFrame:
    """(page_id, url, text) of every row."""
    spark = pages.sparkSession
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col).cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"), F.xxhash64(host).alias("host"))
    rows = rows.withColumn("page", F.xxhash64("host", "html"))
    found = boilerplate(counted_keys(rows), rows.groupBy("host").agg(F.count("*").alias("host_pages")), main, other)
    n_keys = found.count()
    schema = "page_id long, url string, text string"
    out = _arrow_schema(spark, schema)
    if n_keys <= MOST_KEYS:
        known = found.orderBy("key").toPandas()
        known = spark.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("key", "weak", "strong")))
    else:  # each page gets its own keys by a shuffle
        own = counted_keys(rows, with_page=True).join(found.hint("merge"), "key").groupBy("page").agg(F.sort_array(F.collect_set(F.struct("key", "weak", "strong"))).alias("own"))
        rows, known = rows.join(own, "page", "left"), None
    rows = rows.select("page_id", "url", "html", "host", *([] if known else ["own"]))

    def flags(stream: Stream, own) -> tuple[np.ndarray, np.ndarray]:
        keys, weak, strong = known.value if known else (np.array([o[c] for o in own or ()], t) for c, t in (("key", np.int64), ("weak", bool), ("strong", bool)))
        if not len(keys):
            return (np.zeros(len(stream.keys), bool),) * 2
        at = np.minimum(np.searchsorted(keys, stream.keys), len(keys) - 1)
        hit = keys[at] == stream.keys
        return hit & weak[at], hit & strong[at]

    def run(batches):
        for batch, streams in _streams(batches, 3, 2):
            own = [None] * batch.num_rows if known else batch.column(4).to_pylist()
            texts = [s.text(*flags(s, o)) for s, o in zip(streams, own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=out)

    return rows.mapInArrow(run, schema)


def op3_html_text(pages: DataFrame) -> DataFrame:
    return extracted(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
