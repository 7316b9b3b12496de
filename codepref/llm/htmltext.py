"""Main text of web pages: site template removal.

Every block element's subtree (tag, text and child subtrees) is hashed, and Spark counts
per host on how many different pages each hash stands. Subtrees that stand on many of a
host's pages are the site's template and are deleted. What HTML itself marks as no part
of an article (menus, headers, footers, asides, forms, scripts, comments, and elements
named so by role, class or id) goes too; the text of the page's articles (else of its
main element, else of its body) is what is left.

Pages count as different by the text that the markup alone leaves, so copies of an
article under other adverts are one page. Outside articles a subtree is template on at
least ``OUTSIDE`` of a host's different pages; inside an article, where passages may
rightly be shared, on at least ``INSIDE`` of them.

Defined cases: null html is empty; rows are decided by their own url and html, so repeated
rows and ids get equal results; pages without a host are counted as one host; unclosed
and stray tags are tolerated; a page without tags is all text; only page_id, url and
html are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codepref.llm.common import materialize

#: (different pages at least, share of the host's different pages at least)
OUTSIDE = (3, 0.5)
INSIDE = (8, 0.8)
#: Deletions of at most so many hashes in all are broadcast to the pages, else joined.
BROADCAST_HASHES = 500_000

# Element kinds of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
BLOCK = set("""html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr
td th caption pre blockquote figure figcaption address details summary hgroup fieldset legend center
nav header footer aside form dialog menu search""".split())
#: A start tag that ends open elements of these kinds, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
# What is no part of an article, by tag, role, and word of a class or id.
TAGS = set("""nav footer aside form script style noscript template button select textarea label dialog menu search head
title iframe object svg canvas audio video datalist""".split())
ROLES = set("""navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar
status""".split())
NAMES = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies
consent gdpr notice notices popup modal newsletter subscribe signup sidebar nav navbar navigation menu breadcrumb
breadcrumbs header masthead topbar footer comment comments commentlist replies respond disqus related share sharing
social widget widgets overlay pagination pager""".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)
    |<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""", re.S | re.X)
ATTR = re.compile(r"""\b(role|class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _marked(name: str, attrs: str, in_article: bool) -> bool:
    """Whether an element is named as no part of an article. An article's own header
    holds its headline, so headers only count outside."""
    if name in TAGS or (name == "header" and not in_article):
        return True
    if "=" not in attrs or name in ("html", "body", "main"):
        return False
    for key, *value in ATTR.findall(attrs):
        value = unescape("".join(value))
        if key.lower() == "role":
            if value.strip().lower() in ROLES:
                return True
        else:
            # adBox, ad-box and sideBar: the words of a name, and the name
            words = {w.lower() for w in WORDS.findall(value) + re.findall("[A-Za-z]+", value)}
            if (words - {"header"} if in_article else words) & NAMES:
                return True
    return False


class Page:
    """The block elements of one page and its pieces of text."""

    def __init__(self, html: str):
        self.tag, self.up, self.mark, self.parts = ["#page"], [0], [False], [[]]
        self.pieces: list[tuple[int, int, str]] = []  # (node, block, text)
        self.links: list[bool] = []
        self._read(html)
        self._unmark_wrappers()
        self._unmark_links()

    def _read(self, html: str) -> None:
        stack, block, at, end = [0], 0, 0, len(html)
        articles = links = 0

        def text(a: int, b: int) -> None:
            if b > a:
                raw = html[a:b]
                self.pieces.append((stack[-1], block, unescape(raw) if "&" in raw else raw))
                self.links.append(links > 0)
                self.parts[stack[-1]].append(len(self.pieces) - 1)

        def shut(depth: int) -> None:
            nonlocal articles, links
            for node in stack[depth:]:
                articles -= self.tag[node] in ("article", "main")
                links -= self.tag[node] == "a"
            del stack[depth:]

        while at < end:
            m = TAG.search(html, at)
            if not m:
                break
            text(at, m.start())
            at = m.end()
            name = (m["name"] or m["name2"] or "").lower()
            if not name:
                continue
            kind = name in BLOCK
            block += kind or name == "br" or name == "hr"
            if m["end"] or m["end2"]:
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] == name:
                        shut(i)
                        break
                    if not kind and self.tag[stack[i]] in BLOCK:
                        break  # an inline end tag does not reach out of its block
                continue
            attrs = m["attrs"] or m["attrs2"] or ""
            if name in VOID or (attrs.endswith("/") and not kind):
                continue
            over, scope = CLOSES.get(name, (set(), set()))
            if kind or over:
                for i in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[i]]
                    if tag in over or (kind and tag == "p"):
                        shut(i)
                    elif tag in scope or (tag in BLOCK and not over):
                        break
            self.tag.append(name)
            self.up.append(stack[-1])
            self.mark.append(_marked(name, attrs, articles > 0))
            self.parts.append([])
            node = len(self.tag) - 1
            self.parts[stack[-1]].append(-node)
            stack.append(node)
            articles += name in ("article", "main")
            links += name == "a"
            if name in RAW:
                close = re.compile(f"</{re.escape(name)}", re.I).search(html, at)
                at = close.start() if close else end
        text(at, end)

    def _unmark_wrappers(self) -> None:
        """Marked elements that hold the only articles are layout, not template."""
        hidden = self.hidden()
        roots = [i for i, t in enumerate(self.tag) if t in ("article", "main")]
        if roots and all(hidden[i] for i in roots):
            for i in roots:
                if not self.mark[i]:
                    i = self.up[i]
                    while i:
                        self.mark[i] = False
                        i = self.up[i]

    def _unmark_links(self) -> None:
        """Outside articles, a list whose text is all links (three or more) is a menu."""
        if any(t in ("article", "main") for t in self.tag):
            return
        plain, linked = [0] * len(self.tag), [0] * len(self.tag)
        for (node, _, s), link in zip(self.pieces, self.links):
            if s and not s.isspace():
                (linked if link else plain)[node] += 1
        for i in range(len(self.tag) - 1, 0, -1):
            plain[self.up[i]] += plain[i]
            linked[self.up[i]] += linked[i]
            if self.tag[i] in ("ul", "ol", "dl") and not plain[i] and linked[i] >= 3:
                self.mark[i] = True

    def hidden(self, deleted: frozenset[int] = frozenset(), hashes: list[int] | None = None) -> list[bool]:
        """Whether each element is marked or deleted, or stands in one that is."""
        out = [False] * len(self.tag)
        for i in range(1, len(self.tag)):  # parents come first
            out[i] = out[self.up[i]] or self.mark[i] or (hashes is not None and hashes[i] in deleted)
        return out

    def inside(self, hidden: list[bool]) -> list[bool]:
        """Whether each element is (in) an article, else main, else anything."""
        for kinds in ({"article"}, {"main"}):
            out = [False] * len(self.tag)
            for i in range(1, len(self.tag)):
                out[i] = out[self.up[i]] or (self.tag[i] in kinds and not hidden[i])
            if any(out[n] and not hidden[n] and s and not s.isspace() for n, _, s in self.pieces):
                return out
        return [True] * len(self.tag)

    def text(self, hidden: list[bool], inside: list[bool]) -> str:
        blocks: dict[int, list[str]] = {}
        for node, block, s in self.pieces:
            if inside[node] and not hidden[node]:
                blocks.setdefault(block, []).append(s)
        return " ".join(filter(None, (" ".join("".join(b).split()) for b in blocks.values())))

    def hashes(self) -> list[int]:
        """The hash of each block element's subtree (0: inline, or without text)."""
        out, texts = [0] * len(self.tag), [""] * len(self.tag)
        for i in range(len(self.tag) - 1, 0, -1):
            if self.tag[i] in RAW:
                continue
            own = []
            for part in self.parts[i]:
                if part >= 0:
                    own.append(self.pieces[part][2])
                else:
                    own.append(f"\x01{out[-part]}\x01" if out[-part] else texts[-part])
            content = " ".join("".join(own).split())
            if self.tag[i] not in BLOCK:
                texts[i] = content and f" {content} "
            elif content:
                out[i] = xxhash.xxh64_intdigest(f"{self.tag[i]}\x02{content}".encode("utf-8", "replace"), 7) - (1 << 63) or 1
        return out


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        host, content, subtrees = [], [], []
        for h, html in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
            page = Page(html or "")
            hidden = page.hidden()
            inside = page.inside(hidden)
            article = any(t in ("article", "main") for t in page.tag)
            found = {x: article and inside[i] for i, x in enumerate(page.hashes())
                     if x and page.tag[i] not in ("html", "body", "article", "main")}
            host.append(h)
            content.append(xxhash.xxh64_intdigest(page.text(hidden, inside).encode("utf-8", "replace")) - (1 << 63))
            subtrees.append([{"hash": x, "inside": y} for x, y in found.items()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(host, pa.string()), batch["key"], batch["key2"], pa.array(content, pa.int64()),
             pa.array(subtrees, pa.list_(pa.struct([("hash", pa.int64()), ("inside", pa.bool_())])))],
            ["host", "key", "key2", "content", "subtrees"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for html, deleted in zip(batch["html"].to_pylist(), batch["deleted"].to_pylist()):
            page = Page(html or "")
            hidden = page.hidden(frozenset(deleted), page.hashes()) if deleted else page.hidden()
            out.append(page.text(hidden, page.inside(hidden)))
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def host_of(url: Column) -> Column:
    """The host of an absolute URL, in lower case; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), F.xxhash64("url", "html").alias("key"),
                        F.xxhash64("html", F.lit(1), "url").alias("key2"))


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, key, key2, content, subtrees) of each page: the hashes of its block subtrees."""
    return _keyed(pages).select("host", "html", "key", "key2").mapInArrow(
        _subtrees, "host string, key bigint, key2 bigint, content bigint, subtrees array<struct<hash bigint, inside boolean>>")


def site_templates(found: DataFrame) -> DataFrame:
    """(host, hash, n_pages, of_pages) of the subtrees that recur across a host's pages."""
    sizes = (found.select("host", "content").distinct().groupBy("host")
             .agg(F.count(F.lit(1)).alias("of_pages")).where(F.col("of_pages") >= min(OUTSIDE[0], INSIDE[0])))
    seen = found.select("host", "content", F.explode("subtrees").alias("s")).select("host", "content", "s.hash", "s.inside")
    counted = (seen.groupBy("host", "hash", "content").agg(F.max("inside").alias("inside"))
               .groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n_pages"), F.max("inside").alias("inside")))
    least, share = (F.when(F.col("inside"), F.lit(i)).otherwise(F.lit(o)) for i, o in zip(INSIDE, OUTSIDE))
    frequent = counted.where(F.col("n_pages") >= least)
    return frequent.join(sizes, "host").where(F.col("n_pages") >= share * F.col("of_pages")).select(
        "host", "hash", "n_pages", "of_pages")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    found = materialize(subtrees(pages))
    templates = materialize(site_templates(found))
    on_page = found.select("host", "key", "key2", F.explode("subtrees.hash").alias("hash")).distinct()
    hits = materialize(on_page.join(templates.select("host", "hash"), ["host", "hash"])
                       .groupBy("key", "key2").agg(F.collect_set("hash").alias("deleted")))
    n = hits.agg(F.sum(F.size("deleted") + 2)).first()[0] or 0
    if n <= BROADCAST_HASHES:
        hits = F.broadcast(hits)
    return _keyed(pages).join(hits, ["key", "key2"], "left").select("page_id", "url", "html", "deleted").mapInArrow(
        _texts, "page_id bigint, url string, text string, n_chars bigint")
