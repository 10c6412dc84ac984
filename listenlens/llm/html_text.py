"""Main text of web pages by site template removal.

Every element gets a hash of its subtree (tag names and text, not attributes).
Spark counts, for each host, on how many pages with different content a subtree
stands; subtrees on many pages of the host are its template and are cut out,
together with elements whose tag is boilerplate (nav, footer and so on).  What is
left of the article, or of the body where a page has no article or main element, is
the text.

A class, id or role that names boilerplate (ad, sidebar) is only a prior: such an
element, or a form, goes unless it holds an article, a first heading or more than half
of the prose; names that articles use themselves (related, search) count only where
most of the text is links; names of a state (has-sidebar, comments-open) say nothing.

Paragraphs and headings inside an article are never template: a passage that
many articles quote stays.  Pages are counted by the hash of their content, so
copies of one page do not make its text a template.

Defined cases: null or empty html and pages without text give an empty text; a
null or hostless url has no template; repeated rows are each extracted; empty
tables give no rows; other columns are ignored; unclosed and truncated markup is
read as far as it goes, and a quote that is never closed ends with its tag.  Reading
takes time in proportion to the page, whatever its markup.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listenlens.llm.common import store

MIN_PAGES = 3
# pages that are looked up together: one entry a template, however many of them show it
BUCKET_PAGES = 256

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_BETWEEN = re.compile(r"[\s/]*")
_NAME = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_NAME_PART = re.compile(r"[a-z0-9]+")

# fixed values: element names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span "
                   "strike strong sub sup time tt u var".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th tr tbody figcaption".split())
ROOT = frozenset(["article", "main"])
BOILERPLATE = frozenset("head nav footer aside script style noscript template iframe svg canvas button select "
                        "textarea menu dialog object audio video title".split())
# a start tag closes an open element of these names, up to the nearest holder
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol dl table body html article section div main td".split())
# fixed values: parts of class, id and role names that mark boilerplate
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs complementary consent "
                  "contentinfo cookie cookies footer login menu modal nav navbar navigation newsletter notice notices "
                  "notification pagination popup promo promotion share sharing sidebar signup social sponsor sponsored "
                  "subscribe toolbar widget".split())
# reader comments may be longer than the article
COMMENT_MARKS = frozenset("comment comments disqus".split())
# names that content has too
WEAK_MARKS = frozenset("related search dialog".split())
# first and last parts of names of a state, which say what a page has or may do
STATE_FIRST = frozenset("has no with without is not hide show".split())
STATE_LAST = frozenset("open opened closed enabled disabled on off active inactive visible loaded ready allowed".split())

# why an element may go
STAYS, GOES, MARKED, COMMENT, WEAK = range(5)


def _prior(tag: str, attributes: dict[str, str], in_root: bool) -> int:
    if tag in BOILERPLATE or "hidden" in attributes:
        return GOES
    if tag == "header":
        return STAYS if in_root else GOES
    if tag in ROOT or tag in ("html", "body"):
        return STAYS
    found = MARKED if tag == "form" else STAYS
    for value in attributes.values():
        for token in value.lower().split():
            parts = _NAME_PART.findall(token)
            if not parts or len(parts) > 1 and (parts[0] in STATE_FIRST or parts[-1] in STATE_LAST):
                continue
            names = set(parts)
            if names & COMMENT_MARKS:
                return COMMENT
            if names & MARKS or (not in_root and "header" in names):
                found = MARKED
            elif found == STAYS and names & WEAK_MARKS:
                found = WEAK
    return found


class Page:
    """Events of a page in order, and its elements.

    An event is a text, the number of an element that opens (n) or closes (~n).
    """

    __slots__ = ("events", "tags", "prior", "in_root", "hashes", "roots", "size", "links", "holds", "_stack", "_parts",
                 "_open", "_bars", "_link", "_out", "_unclosed", "prose", "root_prose")

    def __init__(self, html: str):
        self.events: list = []
        self.tags: list[str] = []
        self.prior: list[int] = []
        self.in_root: list[bool] = []
        self.hashes: list[int] = []
        self.roots: list[int] = []
        #: characters in each element outside boilerplate tags, those in links, and whether it holds a root or first heading
        self.size: list[int] = []
        self.links: list[int] = []
        self.holds: list[bool] = []
        self._stack: list[int] = []
        self._parts: list[list[str]] = [[]]
        #: places in the stack of the open elements of a tag, and of those that no end is looked for beyond
        self._open: dict[str, list[int]] = {}
        self._bars: list[int] = []
        self._link, self._out = 0, 0
        #: characters outside links and boilerplate tags, of the page and of its roots
        self.prose, self.root_prose = 0, 0
        self._unclosed: set[str] = set()
        at, size = 0, len(html)
        while at < size:
            start = html.find("<", at)
            if start < 0 or start == size - 1:
                self._text(html[at:])
                break
            m = _TAG.match(html, start)
            if not m and html[start + 1] not in "!?/":
                self._text(html[at:start + 1])
                at = start + 1
                continue
            if start > at:
                self._text(html[at:start])
            if not m:
                close = "-->" if html.startswith("<!--", start) else ">"
                end = html.find(close, start + 2)
                at = size if end < 0 else end + len(close)
                continue
            at, attributes = self._attributes(html, m.end())
            self._tag(m[2].lower(), bool(m[1]), attributes)
            if not m[1] and m[2].lower() in RAW:
                close = re.compile(f"</{m[2]}(?![^\\s/>])", re.I).search(html, at)
                end = html.find(">", close.end()) if close else -1
                at = size if end < 0 else end + 1
        while self._stack:
            self._close()
        self.root_prose = sum(self.size[k] - self.links[k] for k in self.roots)

    def _attributes(self, html: str, at: int) -> tuple[int, dict[str, str]]:
        """(end of the tag, its class, id, role and hidden attributes)."""
        found: dict[str, str] = {}
        while True:
            at = _BETWEEN.match(html, at).end()
            if at >= len(html) or html[at] == ">":
                return at + 1, found
            m = _NAME.match(html, at)
            name, at, value = m[0].lower(), m.end(), ""
            m = _EQUALS.match(html, at)
            if m:
                at = m.end()
                quote = html[at:at + 1]
                if quote and quote in "\"'":
                    end = -1 if quote in self._unclosed else html.find(quote, at + 1)
                    if end < 0:
                        self._unclosed.add(quote)
                        end = html.find(">", at)
                        return (len(html) if end < 0 else end + 1), found
                    value, at = html[at + 1:end], end + 1
                else:
                    m = _BARE.match(html, at)
                    value, at = m[0], m.end()
            if name in ("class", "id", "role", "hidden"):
                found.setdefault(name, value)

    def _tag(self, tag: str, closes: bool, attributes: dict[str, str]) -> None:
        if closes:
            if self._open.get(tag):
                depth = self._open[tag][-1]
                while len(self._stack) > depth:
                    self._close()
            elif tag not in INLINE:
                self.events.append(" ")
            return
        if tag in VOID:
            self.events.append(" ")
            return
        if tag in RAW:
            return
        if tag not in INLINE:
            self._end_open(tag)
        n, stack = len(self.tags), self._stack
        in_root = bool(stack) and (self.in_root[stack[-1]] or self.tags[stack[-1]] in ROOT)
        self.tags.append(tag)
        self.prior.append(_prior(tag, attributes, in_root))
        self.in_root.append(in_root)
        self.hashes.append(0)
        self.size.append(0)
        self.links.append(0)
        self.holds.append(tag == "h1")
        if tag in ROOT and not in_root:
            self.roots.append(n)
            self.holds[n] = True
        self._link += tag == "a"
        self._out += self.prior[n] == GOES
        self.events.append(n)
        self._open.setdefault(tag, []).append(len(stack))
        if tag in HOLDERS or tag in BOILERPLATE or tag == "form":
            self._bars.append(len(stack))
        stack.append(n)
        self._parts.append([])

    def _text(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.events.append(text)
        if text and not text.isspace():
            words = " ".join(text.split())
            self._parts[-1].append(words)
            if not self._out:
                self.prose += 0 if self._link else len(words)
                if self._stack:
                    self.size[self._stack[-1]] += len(words)
                    self.links[self._stack[-1]] += len(words) if self._link else 0

    def _close(self) -> None:
        i = self._stack.pop()
        tag, own = self.tags[i], self._parts.pop()
        self._open[tag].pop()
        if self._bars and self._bars[-1] == len(self._stack):
            self._bars.pop()
        self._link -= tag == "a"
        self._out -= self.prior[i] == GOES
        h = xxhash.xxh3_64_intdigest("\0".join([tag, *own]).encode("utf-8", "surrogatepass"))
        self.hashes[i] = h - (1 << 64) if h >> 63 else h
        self._parts[-1].append(f"\1{h:x}")
        if self._stack:
            above = self._stack[-1]
            self.size[above] += self.size[i]
            self.links[above] += self.links[i]
            self.holds[above] |= self.holds[i]
        self.events.append(~i)

    def _end_open(self, tag: str) -> None:
        """Close what a block start tag ends: an open paragraph, or its own kind."""
        names = CLOSES.get(tag, ()) + ("p",)
        depth = max((self._open[t][-1] for t in names if self._open.get(t)), default=-1)
        if depth >= 0 and depth >= (self._bars[-1] if self._bars else 0):
            while len(self._stack) > depth:
                self._close()

    def named(self, i: int) -> bool:
        """Does the element go by what it names itself, held against what it holds?"""
        prior = self.prior[i]
        if prior in (STAYS, GOES):
            return prior == GOES
        if self.holds[i]:
            return False
        if prior == COMMENT:
            return True
        if prior == WEAK:
            return 2 * self.links[i] > self.size[i]
        return 2 * (self.size[i] - self.links[i]) <= (self.root_prose if self.in_root[i] else self.prose)

    def candidate(self, i: int) -> bool:
        """May this element be template?  Prose and roots of the content may not."""
        tag = self.tags[i]
        if self.in_root[i]:
            return tag not in PROSE and tag not in INLINE
        return tag not in ("html", "body") and tag not in ROOT and tag not in INLINE

    def content_hash(self) -> int:
        """Stands for the page's content: its article, else all of it."""
        own = [self.hashes[i] for i in self.roots] or [h for h, t in zip(self.hashes, self.tags) if t == "body"] or self.hashes[:1]
        h = xxhash.xxh3_64_intdigest(",".join(map(str, own)))
        return h - (1 << 64) if h >> 63 else h

    def text(self, templates: frozenset[int]) -> str:
        gone = [self.named(i) or (self.hashes[i] in templates and self.candidate(i)) for i in range(len(self.tags))]
        for only_roots in (True, False) if self.roots else (False,):
            roots = set(self.roots)
            out: list[str] = []
            skip, inside = 0, 0
            for e in self.events:
                if isinstance(e, str):
                    if not skip and (inside or not only_roots):
                        out.append(e)
                    continue
                opens = e >= 0
                i = e if opens else ~e
                if gone[i]:
                    skip += 1 if opens else -1
                if i in roots:
                    inside += 1 if opens else -1
                if self.tags[i] not in INLINE:
                    out.append(" ")
            text = " ".join("".join(out).split())
            if text:
                return text
        return ""


def host(column: str = "url"):
    """Lower-case host of a url; empty for none."""
    return F.lower(F.coalesce(F.regexp_extract(column, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _subtrees(batches):
    for batch in batches:
        roots, found = [], []
        for html in batch.column("html").to_pylist():
            page = Page(html or "")
            roots.append(page.content_hash())
            found.append(list({page.hashes[i] for i in range(len(page.tags)) if page.candidate(i) and page.prior[i] == STAYS}))
        yield pa.RecordBatch.from_arrays(
            [batch.column("bucket"), batch.column("host"), pa.array(roots, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
            names=["bucket", "host", "content", "subtrees"])


def least_pages(pages, min_pages: int = MIN_PAGES):
    """Pages a template of a host of so many pages stands on: it grows with their logarithm only,
    as a box of one section of a large host is template too."""
    return F.greatest(F.lit(min_pages), F.floor(F.log2(pages)))


def _found(pages: DataFrame) -> DataFrame:
    """bucket, host, content, subtrees of every page that has a host; stored."""
    return store(pages.filter("host <> ''").select("bucket", "host", "html")
                 .mapInArrow(_subtrees, "bucket long, host string, content long, subtrees array<long>"), "page-subtrees", "zstd")


def templates(found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, h: subtree hashes on many pages of the host, a row each."""
    # 0 stands for the page itself
    seen = store(found.select("host", "content", F.explode(F.concat(F.col("subtrees"), F.array(F.lit(0).cast("long")))).alias("h"))
                 .distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(f"h = 0 or n >= {min_pages}"), "host-subtrees")
    pages_of = seen.filter("h = 0").select("host", F.col("n").alias("pages"))
    # the files pack many rows into few bytes: by their size a join would send all rows to the driver
    return (seen.filter("h <> 0").join(pages_of.hint("merge"), "host").filter(F.col("n") >= least_pages(F.col("pages"), min_pages))
            .select("host", "h"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars, n_templates (of the host): one row per page row."""
    def run(batches):
        for batch in batches:
            # a page at a time: the pages of a bucket share long lists
            texts = [Page(h.as_py() or "").text(frozenset(t.as_py() or ()))
                     for h, t in zip(batch.column("html"), batch.column("templates"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), batch.column("n_templates")],
                names=["page_id", "url", "text", "n_chars", "n_templates"])

    # a host may hold a third of all pages, so they are dealt out by url and id to buckets of
    # some pages; a bucket gets only those of the host's templates that its pages show
    buckets = pages.select("page_id").count() // BUCKET_PAGES + 1
    p = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host().alias("host"),
                     F.pmod(F.xxhash64("url", "page_id"), F.lit(buckets)).alias("bucket"))
    schema = T.StructType([p.schema["page_id"], p.schema["url"], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType()), T.StructField("n_templates", T.LongType())])
    found = _found(p)
    known = templates(found, min_pages)
    # 0 goes to every bucket with the number of the host's templates
    known = (known.select("host", "h", F.lit(None).cast("long").alias("size"))
             .unionByName(known.groupBy("host").agg(F.count(F.lit(1)).alias("size")).select("host", F.lit(0).cast("long").alias("h"), "size")))
    shown = found.select("bucket", "host", F.explode(F.concat(F.col("subtrees"), F.array(F.lit(0).cast("long")))).alias("h")).distinct()
    cut = (shown.join(known.hint("merge"), ["host", "h"]).groupBy("bucket", "host")
           .agg(F.collect_list(F.when(F.col("h") != 0, F.col("h"))).alias("templates"), F.max("size").alias("n_templates")))
    return (p.join(cut, ["bucket", "host"], "left")
            .select("page_id", "url", "html", "templates", F.coalesce("n_templates", F.lit(0).cast("long")).alias("n_templates"))
            .mapInArrow(run, schema))
