"""Main text and WARC archives against brute force."""

import base64
import hashlib
import html as H
import re

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from listenlens.llm import html_text, warc
from listenlens.llm.common import table
from listenlens.session import scratch_path
from tests.conftest import SF_SMALL
from tests.llm import frames


def article_text(html):
    """The one article of a synthetic page, by plain string work."""
    inner = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", html or "", re.S)
    if not inner:
        return ""
    return " ".join(H.unescape(re.sub(r"</?(?:p|h1|br|b)>", lambda m: "" if "b>" in m[0] and "br" not in m[0] else " ",
                                      inner[1])).split())


@pytest.mark.parametrize("sf", [SF_SMALL, "/root/testdata/sf0.01"])
def test_main_text_is_the_article(spark, sf):
    rows = table(spark, sf, "pages").collect()
    got = {r.page_id: r for r in html_text.extract(table(spark, sf, "pages")).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == article_text(r.html), r.page_id
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><script>if (a < b) '</p>'</script></head><body>{body}</body></html>"


def texts(spark, rows, **settings):
    return {r.page_id: r.text for r in html_text.extract(frames.pages(spark, rows), **settings).collect()}


def test_template_without_a_name_is_removed_by_recurrence(spark):
    box = "<div class='x1'><ul><li>Home</li><li>Shop &amp; more</li></ul></div>"
    tail = "<section><p>All rights, all wrongs</p></section>"
    rows = [(i, f"http://h.example/{i}", page(f"{box}<div><h1>Story {i}</h1><p>Only page {i} says this.</p><p>Shared quote.</p></div>{tail}"))
            for i in range(8)]
    rows += [(100, "http://one.example/a", page(f"{box}<div><p>Lone page.</p></div>"))]
    got = texts(spark, rows)
    for i in range(8):
        assert "Home" not in got[i] and "wrongs" not in got[i] and f"Only page {i} says this." in got[i]
    # no other page of that host shows what is template
    assert got[100] == "Home Shop & more Lone page."


def test_template_of_one_section_of_a_large_host_is_removed(spark):
    # each of 40 sections has its own box, on a fortieth of the host's pages
    rows = [(i, f"http://big.example/{i}", page(f"<div><ul><li>Section {i % 40} menu</li></ul></div><div><p>Only page {i}.</p></div>"))
            for i in range(400)]
    got = html_text.extract(frames.pages(spark, rows)).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Only page {i}." for i in range(400)}
    assert {r.n_templates for r in got} == {120}


def test_article_passages_stay(spark):
    rows = [(i, f"http://h.example/{i}", page(f"<article><h1>T{i}</h1><p>Quoted by all.</p><p>Own {i}.</p>"
                                              f"<div><p>Get our letter</p></div></article>")) for i in range(6)]
    # copies of one page are one content, so their text is no template
    rows += [(10 + i, f"http://copy.example/{i}", page("<div><p>Same page</p></div>")) for i in range(9)]
    got = texts(spark, rows)
    assert {got[i] for i in range(6)} == {f"T{i} Quoted by all. Own {i}." for i in range(6)}
    assert {got[10 + i] for i in range(9)} == {"Same page"}


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("just text", "just text"), ("a<b>b</b>c<br>d<p>e", "abc d e"),
    ("<p>x &lt;tag&gt; &amp;amp; &#233;&nbsp;y", "x <tag> &amp; é y"), ("<article><p>cut off in <b>mid", "cut off in mid"),
    ("<article><p>end<footer>no</footer></article>", "end"), ("<nav>n</nav><main>m<aside>s</aside></main><footer>f</footer>", "m"),
    ("<article>t<section class='user comments'><article>c</article></section></article>", "t"),
    ("<p>one<p>two<ul><li>x<li>y</ul>z", "one two x y z"), ("<div id=cookie-notice>c</div><p>t</p>", "t"),
    ("<form><p>f</p></form><p title='a > b'>t</p>", "t"), ("<style>p{}</style><p>t</p><script>x</script", "t"),
    ("<p>t</p><!-- c <p>no</p> -->", "t"), ("<header><h1>Site</h1></header><article><header><h1>T</h1></header>b</article>", "T b"),
    ("</div></p>t", "t"), ("<div " * 5 + "x", ""), ("<div>" * 3000 + "deep", "deep"), ("<article></article><p>rest</p>", "rest"),
])
def test_awkward_markup(html, text):
    assert html_text.Page(html or "").text(frozenset()) == text


@pytest.mark.parametrize("html, text", [
    ('<div class="layout has-sidebar"><p>Main article text here.</p><div class="sidebar"><p>side</p></div></div>', "Main article text here."),
    ('<div class="post comments-open"><p>The post.</p></div>', "The post."), ('<body class="no-ads"><div class="no-ads"><p>t</p></div>', "t"),
    ('<div class="search-result"><p>Found this.</p></div>', "Found this."), ('<div class="search"><a href="/">a</a> <a>b</a></div><p>t</p>', "t"),
    ('<article><p>One.</p><section class="related-work"><h2>Related work</h2><p>Two.</p></section></article>', "One. Related work Two."),
    ('<article><p>One.</p><div class="related"><a>Other page</a></div></article>', "One."),
    ('<form id="aspnetForm"><div><p>The whole page is here.</p></div></form><p>x</p>', "The whole page is here. x"),
    ('<form><input><p>Your name</p></form><p>The article is longer.</p>', "The article is longer."),
    ('<div class="widget"><h1>Head</h1><p>t</p></div>', "Head t"), ('<div class="banner"><article><p>a</p></article></div>', "a"),
    ('<article><p>short</p><div class="comments"><p>a reader goes on and on and on</p></div></article>', "short"),
    ('<p class="x>Hello</p>', "Hello"), ("<p>a</p><p class='x>Hello</p>", "a Hello"), ('<p class = "a" title="b > c">t</p>', "t"),
    ('<p data-x=">">t</p>', "t"), ("1 < 2 <p>3 <4</p>", "1 < 2 3 <4"), ("<p hidden>no</p><p aria-label=hidden>t</p>", "t"), ("</ x>t", "t"),
])
def test_names_are_only_a_prior_and_broken_tags_end(html, text):
    assert html_text.Page(html).text(frozenset()) == text


@pytest.mark.parametrize("html", [
    "<div>" * 50_000 + "</b>" * 50_000, '<a "' * 100_000, "<b>" * 50_000 + "<p>" * 50_000, "<x-y>" * 50_000 + "<li>" * 50_000, '<p class="' * 100_000,
    "<p " + "a" * 500_000, "<p " + "a=b " * 100_000 + ">x", "<p class='x>" * 100_000, "<" * 200_000, "</" * 100_000, "<!--" * 100_000,
    "<div class=sidebar>" * 50_000, "<script>" * 100_000, "<td>" * 100_000, "&" * 200_000])
def test_any_markup_is_read_in_linear_time(html):
    import time
    took = []
    for n in (len(html) // 4, len(html)):
        began = time.process_time()
        html_text.Page(html[:n]).text(frozenset())
        took.append(time.process_time() - began)
    # four times the markup takes about four times as long, on any machine
    assert took[1] < 10 * took[0] + 0.5 and took[1] < 10


def test_subtrees_are_not_sent_to_the_driver(spark):
    """Their files are far smaller than their rows, so a size by the files would have them broadcast."""
    plan = html_text.extract(table(spark, SF_SMALL, "pages"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[host#\d+(, h#\d+L)?\]", plan)
    assert re.search(r"SortMergeJoin \[host#\d+\]", plan) and re.search(r"SortMergeJoin \[host#\d+, h#\d+L\]", plan)


def test_pages_with_nulls_and_no_rows(spark):
    rows = [(None, None, page("<p>a</p>")), (1, "not a url", page("<p>b</p>")), (1, "http://x.example", None), (1, "http://x.example", None)]
    got = sorted((r.page_id or 0, r.text) for r in html_text.extract(frames.pages(spark, rows)).collect())
    assert got == [(0, "a"), (1, ""), (1, ""), (1, "b")]
    assert html_text.extract(frames.pages(spark, [])).count() == 0


# ---- archives --------------------------------------------------------------------

def expected(rows):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    return sorted(((i, len((h or "").encode()), digest(h), *(("response", None) if first[h or ""] == i else ("revisit", first[h or ""])))
                   for i, _, h in rows), key=str)


def read_back(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_archives_read_back(spark):
    pages = table(spark, SF_SMALL, "pages")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert read_back(warc.round_trip(pages)) == expected(rows)


AWKWARD = [(5, "http://a.example/x", "<p>one</p>"), (2, "http://a.example/x", "<p>one</p>"), (9, None, None), (3, "", ""),
           (None, "http://b.example", "<p>two é</p>"), (7, "http://[bad", "<p>two é</p>"), (8, "https://A.example:443/x?q=1#f", "z" * 300_000),
           (8, "https://A.example:443/x?q=1#f", "z" * 300_000), (11, "http://c.example/\r\nX: y", "<p>3</p>")]


def test_archives_on_awkward_rows(spark):
    assert read_back(warc.round_trip(frames.pages(spark, AWKWARD))) == expected(AWKWARD)
    assert warc.round_trip(frames.pages(spark, [])).count() == 0


def test_lookup_over_blocks_and_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    # one url holds most captures, so its key runs over blocks and files
    rows = [(i, "http://hot.example/a" if i % 3 else f"http://h{i}.example/{i}", f"<p>{i}</p>") for i in range(200)]
    archives, files = scratch_path(spark, "t-warc"), scratch_path(spark, "t-index")
    captures = warc.write(frames.pages(spark, rows).repartition(3), archives)
    index = warc.build_index(captures, files)
    assert index.agg(F.sum("captures")).first()[0] == 200
    urls = spark.createDataFrame([("http://hot.example/a",), ("https://HOT.example:443/a#x",), ("http://h3.example/3",), ("http://none.example",)], "url string")
    got = warc.lookup(urls, index, files, archives).collect()
    assert sorted(r.page for r in got) == sorted(f"={i}" for i in range(200) if i % 3 or i == 3)
    assert all(r.payload.decode() == f"<p>{r.page[1:]}</p>" for r in got)


def test_a_hot_url_is_read_by_blocks_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 16)
    rows = [(i, "http://hot.example/a", f"<p>{i}</p>" + "z" * 50_000) for i in range(400)]
    archives, files = scratch_path(spark, "t-warc"), scratch_path(spark, "t-index")
    index = warc.build_index(warc.write(frames.pages(spark, rows), archives).coalesce(1), files)
    urls = spark.createDataFrame([("http://hot.example/a",)], "url string")
    found = warc.lookup(urls, index, files, archives)
    tasks = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    # no more tasks than files found the captures before
    assert sum(r["count"] for r in tasks) == 400 and len(tasks) > index.count()
    places = [(warc.surt("http://hot.example/a"), r.file, i) for r in index.collect() for i in range(r.blocks)]
    sizes = [(b.num_rows, b.nbytes) for b in warc.read_records([warc._batch(places, warc._PLACE)], files, archives)]
    assert sum(n for n, _ in sizes) == 400 and max(size for _, size in sizes) < warc.BATCH_BYTES + 200_000


def test_archive_files_are_plain_warc(spark):
    folder = scratch_path(spark, "t-plain")
    captures = warc.write(frames.pages(spark, AWKWARD), folder).collect()
    filesystem, path = warc._folder(folder)
    import zlib
    seen = []
    for name in {c.file for c in captures}:
        data = filesystem.open_input_file(f"{path}/{name}").read()
        while data:
            z = zlib.decompressobj(31)
            raw = z.decompress(data) + z.flush()
            data = z.unused_data
            assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")
            seen.append(raw)
    assert len(seen) == len(AWKWARD)
    assert isinstance(filesystem, fs.FileSystem)


@pytest.mark.parametrize("url, key", [
    ("http://www.B.example.com/p/q?x=1#f", "com,example,b,www)/p/q?x=1"), ("https://b.example:443", "example,b)/"),
    ("http://b.example:8080/", "example,b:8080)/"), (None, "-"), ("", "-"), ("mailto:x", "mailto:x")])
def test_reversed_host_keys(url, key):
    assert warc.surt(url) == key
