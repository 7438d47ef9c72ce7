"""HTML extraction and WARC archives."""

import hashlib
import random
import struct

import numpy as np
import pytest
import zstandard

from chainloom.llm import html_text, warc
from chainloom.llm.common import new_folder

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="no-sidebar">
<header>site</header><nav><ul><li><a href="/x">menu</a></ul></nav><!-- <p>no</p> --><div class="ad box">buy</div>
<article class="post"><h1>Head &amp; tail</h1><p><b>one <i>t</i>wo<br>three<p>four&nbsp;&#233;
 five<aside>side</aside><div id="comments"><p>reader</div><form><input value="a>b">f</form><p>six</article><footer>&copy; foot</footer></body></html>"""


def main_text(page):
    """By markup alone."""
    stream = html_text.Stream(0, page)
    none = np.zeros(len(stream.keys), bool)
    return stream.text(none, none)


@pytest.mark.parametrize(
    "page, want",
    [
        (PAGE, "Head & tail one two three four é five six"),
        ("", ""),
        ("plain text &lt; more", "plain text < more"),
        ("<p>a<p>b", "a b"),
        ("<div class='cookie-notice'>x<div>y</div></div>z", "z"),
        ("<p hidden>x</p><p style='display:none'>y</p>z", "z"),
        ("<article>a</article><p>out</p><main>b</main>", "a b"),
        ("<script>unclosed", ""),
        ("<b>in</b>line<span>d</span> w", "inlined w"),
        ("<p>1 < 2 <3</p>", "1 < 2 <3"),
        ("<a title='x>y'>t</a><textarea>no</textarea>", "t"),
        ("<td>a</td><td>b", "a b"),
        ("<article><header><h1>t</h1></header>x</article>", "t x"),
        ("<nav>a<p>b</nav>c", "c"),
    ],
)
def test_blocks(page, want):
    assert main_text(page) == want


IN_ARTICLE = ["<ol class='comment-list'><li>x</ol>", "<section class='comments-area'>x</section>", "<div id='comment-section'>x</div>", "<div class='user-comments'>x</div>", "<div class='ad-slot'>x</div>", "<div class='ad-container'>x</div>",
    "<div class='google-ad'>x</div>", "<div class='cookie-bar'>x</div>", "<div class='newsletter-box'>x</div>", "<ul><li class='comment'>x</ul>", "<p class='comment'>x</p>", "<p class='ad'>x</p>", "<div class='commentList'>x</div>", "<div class='share-buttons'>x</div>"]


@pytest.mark.parametrize("part", IN_ARTICLE)
def test_parts_of_compound_names_go(part):
    assert main_text(f"<article><p>a</p>{part}<p>b</p></article>") == "a b"
    assert main_text(f"<p>a</p>{part}<p>b</p>") == "a b"


@pytest.mark.parametrize("name", ["site-header", "site-footer", "main-menu", "page-header", "top-nav", "global-navigation", "left-sidebar"])
def test_parts_around_an_article_go(name):
    assert main_text(f"<div class='{name}'>x</div><p>a</p>") == "a"


@pytest.mark.parametrize("name", ["no-sidebar", "has-menu", "comment-free", "content-sidebar-wrap", "with-comments", "search-engines", "related-work", "main-content", "post-body", "entry-content", "advice", "header-note"])
def test_names_that_are_no_parts_stay(name):
    assert main_text(f"<article><div class='{name}'>a</div></article>") == "a"
    assert main_text(f"<div class='{name}'>a</div>") == "a"


def test_hosts_are_told_apart(spark):
    """Forty hosts with one bar each: the bar goes on all of them, whatever their hashes share."""
    r = random.Random(2)
    text = lambda n: " ".join("".join(r.choice("bcdfglmn") + r.choice("aeiou") for _ in range(4)) for _ in range(n))
    rows = []
    for h in range(40):
        bar = text(20)
        rows += [(100 * h + k, f"http://host{h}.org/{k}", f"<p>{bar}</p><p>{text(60)}</p>") for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (html_text.MOST_HOSTS, 0):
        html_text.MOST_HOSTS, kept = most, html_text.MOST_HOSTS
        try:
            assert sum(len(t.text.split()) for t in html_text.extracted(pages).collect()) == 40 * 8 * 60
        finally:
            html_text.MOST_HOSTS = kept


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div class='no-sidebar'><article>a</article></div>", "a"),
        ("<div class='content-sidebar-wrap has-menu'><main>a</main></div>", "a"),
        ("<div class='widget'><article>a</article>w</div>", "a"),
        ("<article><h2 id='search'>a</h2><h3 id='related-work'>b</h3><p class='alert'>c</p><section id='notice'>d</section></article>", "a b c d"),
        ("<article>a<div class='related'>x</div><div id='comments'><article>y</article></div></article>", "a"),
        ("<main>a</main><div id='comments'><article>y</article></div>", "a"),
        ("<nav><article>x</article></nav><div hidden><main>y</main></div>z", "z"),
        ("<div class='layout has-sidebar'><article>a</article></div>", "a"),
        ("<div id='post-search-engines'><article>a</article></div>", "a"),
        ("<article>a</article><article class='comment'>x</article><article class='user comment'>y</article>", "a"),
        ("<article class='comment-free post'>a</article>", "a"),
        ("<article><math><mi>x</mi><mo>=</mo><annotation>x=</annotation></math> <svg><title>t</title><text>drawn</text></svg> <noscript>n</noscript></article><noscript>o</noscript>", "x= drawn n"),
        ("<article>small teaser</article><div><p>the long text of the page stands outside of it and goes on</p></div>", "small teaser the long text of the page stands outside of it and goes on"),
    ],
)
def test_parts_are_named_by_whole_classes(page, want):
    assert main_text(page) == want


def test_long_broken_markup_ends():
    assert all(kind == html_text.OTHER_BLOCK for _, kind in html_text.blocks("<a '" * 2000 + "x" * 1000))


def test_extraction_of_a_table(spark):
    boiler = "this is the same notice on every page of this site for all readers of it"
    rows = [(k, f"http://h/{k}", f"<div>{boiler}</div><p>{k} own words number {k} here</p>") for k in range(5)]
    rows += [(10, "http://other/1", f"<div>{boiler}</div>"), (11, None, None), (12, "http://h/x", PAGE), (12, "http://h/x", PAGE), (None, "http://h/9", "<article>a</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.op3_html_text(pages).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[3] == "3 own words number 3 here"
    assert text[10] == boiler and text[11] == "" and text[None] == "a"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.op3_html_text(pages.limit(0)).count() == 0


def suffix_runs(streams, rule):
    """Tokens that a suffix array of a host's concatenated streams finds in runs of RUN tokens: all suffixes sorted
    whole, neighbours with RUN tokens in common are of one group, and a group counts pages and contents."""
    suffixes = sorted((s[k:], i, k) for i, s in enumerate(streams) for k in range(len(s) - html_text.RUN + 1))
    covered, group = [[False] * len(s) for s in streams], []

    def close():
        pages = {i for _, i, _ in group}
        if len(pages) >= rule.share * len(streams) and len({tuple(streams[i]) for i in pages}) >= rule.pages:
            for _, i, k in group:
                covered[i][k : k + html_text.RUN] = [True] * html_text.RUN

    for x in suffixes:
        if group and x[0][: html_text.RUN] != group[-1][0][: html_text.RUN]:
            close()
            group = []
        group.append(x)
    close()
    return covered


def plain_pages(pages):
    """By host: whole pages, covered tokens and the module's statement of which blocks go."""
    out, hosts = {}, {}
    for i, url, page in pages:
        hosts.setdefault(url.split("/")[2], []).append((i, html_text.blocks(page or "")))
    for rows in hosts.values():
        streams = [" ".join(b for b, _ in blocks).split(" ") if blocks else [] for _, blocks in rows]
        by_rule = {r: suffix_runs(streams, r) for r in (html_text.MAIN_RULE, html_text.OTHER_RULE)}
        for n, (i, blocks) in enumerate(rows):
            kind = html_text.MAIN_BLOCK if any(k == html_text.MAIN_BLOCK for _, k in blocks) else html_text.OTHER_BLOCK
            covered, at, mine, gone = by_rule[html_text.MAIN_RULE if kind == html_text.MAIN_BLOCK else html_text.OTHER_RULE][n], 0, [], []
            for b, k in blocks:
                size = b.count(" ") + 1
                if k == kind:
                    mine.append((b, size))
                    if 2 * sum(covered[at : at + size]) >= size:
                        gone.append((b, size))
                at += size
            lost, total = sum(z for _, z in gone), sum(z for _, z in mine)
            if lost > (total / 2 if kind == html_text.MAIN_BLOCK else total - 1):
                gone = []
            out[i] = " ".join(b for b, z in mine if (b, z) not in gone)
    return out


def site_pages(r):
    """Hosts with notices in articles, boilerplate without a name, copies and near copies of articles, and shared passages."""
    word = lambda: "".join(r.choice("bcdfglmn") + r.choice("aeiou") for _ in range(4))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for h in range(3):
        notice, bar, foot, passage, copy = text(30), text(40), text(24), text(50), text(120)
        for k in range(24):
            body = f"<p>{text(60)}</p><p>{text(45)}</p>"
            if k % 12 == 3:
                body += f"<p>{passage}</p>"
            if k in (5, 6, 7):  # one article, with a word changed
                body = f"<p>{copy.replace(copy.split()[k], word())}</p>"
            body += f"<p>{notice}</p>" if h else ""
            page = f"<p>{bar}</p><article>{body}</article><div>{foot}</div>" if h < 2 else f"<p>{bar}</p>{body}<div>{foot}</div>"
            rows.append((100 * h + k, f"http://host{h}.org/{k}", page))
        rows.append((100 * h + 50, f"http://host{h}.org/copy", rows[-1][2]))
    return rows + [(900, "http://alone.org/", f"<p>{text(40)}</p>"), (901, "http://host0.org/none", None)]


@pytest.mark.parametrize("most_keys", [html_text.MOST_KEYS, 0])
def test_pages_against_a_suffix_array(spark, monkeypatch, most_keys):
    monkeypatch.setattr(html_text, "MOST_KEYS", most_keys)
    rows = site_pages(random.Random(9))
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = plain_pages(rows)
    assert got == want
    words = {i: len(t.split()) for i, t in got.items()}
    assert words[0] == 105 and words[3] == 155 and words[100] == 105 and words[103] == 155 and words[5] == 120  # passages and copies stay
    assert words[200] == 105 and words[203] == 105 + 50 * (2 < 0.05 * 25)  # without an article the loose rule takes shared passages
    assert words[900] == 40 and words[901] == 0


def test_extra_columns_and_very_long_pages(spark):
    long = "<article>" + "<p>" + " ".join(f"word{k}" for k in range(200_000)) + "</p></article>"
    pages = spark.createDataFrame([(1, "http://h/1", long, "a", 5, "k"), (1, "http://h/1", long, "b", 6, "l"), (2, None, "<p>x</p>", None, None, None)], "page_id long, url string, html string, text string, host long, page string")
    got = sorted((r.page_id, r.n_chars) for r in html_text.op3_html_text(pages).collect())
    n = sum(len(f"word{k}") + 1 for k in range(200_000)) - 1
    assert got == [(1, n), (1, n), (2, 1)]


@pytest.mark.parametrize("broadcast", [warc.BROADCAST_DIGESTS, -1])
def test_archives_round_trip(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", broadcast)
    long = "<p>" + "same é payload " * 20
    rows = [(5, "http://a/5", long), (2, "http://a/2\r\nX: y", long), (9, None, long), (3, "http://a/3", "short"), (4, "http://a/4", "short"), (6, "http://a/6", None), (7, "u", ""), (None, "n", long), (2, "again", long), (8, "u8", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, digest string, payload string, first_id long")
    folder = warc.write_archives(pages, new_folder(spark, "warc-test"))
    got = warc.read_archives(spark, folder, with_payload=True).collect()
    assert len(got) == len(rows)
    for r in got:
        payload = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        if payload == long.encode() and r.page_id != 2:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", 2, None)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, payload)
    assert warc.op8_warc(pages.limit(0)).count() == 0


def test_archives_of_two_attempts_have_names_of_their_own(spark):
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"<p>page {k}") for k in range(6)], "page_id long, url string, html string").coalesce(1)
    folder = new_folder(spark, "warc-twice")
    first = warc.write_archives(pages, folder)
    names = {r.path for r in spark.read.parquet(f"{first}/shards").collect()}
    warc.write_archives(pages.orderBy(-pages.page_id), folder)  # as a late attempt would, with its rows in another order
    again = {r.path for r in spark.read.parquet(f"{folder}/shards").collect()}
    assert not names & again and sorted(r.page_id for r in warc.read_archives(spark, folder).collect()) == list(range(6))


def archive(records, dictionary=b""):
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True).compress
    return struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary + b"".join(map(pack, records))


def test_broken_archives_are_refused():
    digest = hashlib.sha256(b"abc").hexdigest()
    good = warc.record(1, "u", b"abc", digest, None)
    assert [r[0] for r in warc.read_archive(archive([good, good]))] == [1, 1]
    for bad in (good[:-2], good.replace(b"abc\r\n", b"abd\r\n"), good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"Content-Length: 3", b"Content-Length: 2"), good.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            list(warc.read_archive(archive([bad])))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_archive(archive([good])[:-6]))


def test_a_dictionary_in_the_leading_frame_is_used():
    records = [warc.record(k, f"http://h/{k}", f"<p>page {k} of the archive".encode(), hashlib.sha256(f"<p>page {k} of the archive".encode()).hexdigest(), None) for k in range(400)]
    dictionary = zstandard.train_dictionary(4096, records).as_bytes()
    data = archive(records, dictionary)
    assert [r[0] for r in warc.read_archive(data)] == list(range(400))
    packed = zstandard.compress(dictionary)
    again = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + data[8 + len(dictionary) :]
    assert [r[0] for r in warc.read_archive(again)] == list(range(400))
