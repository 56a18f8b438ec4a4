"""Main text of web pages by consensus host paths.

1. Every page is parsed once; its containers (elements that may hold an article)
   are scored by the text of their own paragraphs, less the text of links and
   of boilerplate subtrees.
2. A container is named by its generalised path: tags from the root, each with
   its first class or id without digits (in Spark, by a 64-bit hash of it).  A page
   votes for its best container; votes are summed per host and path in Spark.
3. Every page is extracted again with the path that has most votes of its host
   among its own containers' (its best container's has one at least).

Boilerplate subtrees (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, comments of readers) are left out by tag, role, class
and id.  A name that only has a boilerplate word among its parts (has-sidebar) does
not hide a subtree with most of the page's text; words that are common in prose
(side, social) hide nothing beside other words of prose (side-effects).  Character references are decoded, white space inside a block becomes
one space, blocks are joined in page order by one space.

Defined results: null html counts as empty; equal pages vote once; a page without an article has an
empty text; a null or malformed url has the empty host; repeated rows are
extracted one by one.  Only page_id, url and html are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import hot_join, rows_of, table, written

#: HTML elements by role (void, raw text, inline, never content).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIP = frozenset("nav header footer aside form script style noscript template svg iframe button select option textarea dialog menu head title object canvas math audio video input fieldset".split())
SKIP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words in class and id names of boilerplate.
SKIP_NAME = frozenset("ad ads advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer foot gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted promotion related recommended respond share sharing sidebar side sidenav signup social sponsor sponsored subscribe subscription topbar toolbar widget widgets".split())
#: Of these, the ones whose subtrees go in compound names too, whatever their text.
READERS = frozenset("comment comments commentlist disqus respond".split())
#: Of these, the ones that prose has too, and words of layout that may stand beside them.
PROSE = frozenset("banner foot header navigation notice notices notification promotion related recommended respond share sharing side social sponsor subscription".split())
LAYOUT = frozenset("alert area articles bar block body bottom box btn button buttons card col column content container cta error fixed float group holder icon icons info inner item items left link links list main media menu message mobile nav outer page panel post posts reading region right row section site slot small sticky stories success text this title top topics unit view warning widget wrap wrapper zone".split())
#: Elements whose id is an anchor made of their text.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div body td blockquote center".split())
#: Elements whose start ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
_GENERAL = re.compile(r"[^a-zA-Z_-]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    __slots__ = ("tag", "step", "up", "key", "skip", "link", "score", "parts", "doubt")

    def __init__(self, tag: str, step: str, up: Node | None, skip: bool, link: bool):
        self.tag, self.step, self.up, self.skip, self.link = tag, step, up, skip, link
        #: hash of the path from the root
        self.key = xxhash.xxh64_intdigest(step, up.key) if up else 0
        self.score = 0.0
        self.parts: list[int] = []  # first and last + 1 index into the page's pieces
        self.doubt = 0  # number of the tag whose compound name alone hides this node

    def path(self) -> str:
        steps, node = [], self
        while node.up:
            steps.append(node.step)
            node = node.up
        return ">".join(["", *reversed(steps)])


def _boilerplate(name: str) -> frozenset[str]:
    """Words of boilerplate in a class or id that count."""
    words = [w.lower() for w in _NAME.findall(name)]
    found = SKIP_NAME.intersection(words)
    if found <= PROSE and any(len(w) > 2 and w not in LAYOUT and w not in SKIP_NAME for w in words):
        return frozenset()
    return found


def _opened(tag: str, attributes: str, parent: Node, number: int, shown: frozenset[int]) -> Node:
    skip = (parent.skip and not parent.doubt) or tag in SKIP
    name, doubt = "", parent.doubt
    if attributes and not skip:
        for key, a, b, c in _ATTR.findall(attributes):
            value = a or b or c
            key = key.lower()
            if key == "role":
                skip = skip or value.lower() in SKIP_ROLE
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
                skip = True
            elif key in ("class", "id"):
                if tag not in ("body", "html", "article", "main"):
                    names = value.lower().split()
                    words = frozenset() if key == "id" and tag in HEADINGS else frozenset().union(*map(_boilerplate, value.split()))
                    if words & READERS or (words and any(w in SKIP_NAME for w in names)):
                        skip = True
                    elif words and not doubt and number not in shown:
                        doubt = number
                if not name and value:
                    name = _GENERAL.sub("", value.split()[0]) if value.split() else ""
    node = Node(tag, f"{tag}.{name}" if name else tag, parent, skip or doubt > 0, parent.link or tag == "a")
    node.doubt = 0 if skip else doubt
    return node


class Page:
    """Pieces of content in page order, and containers.

    One pass over the html, and one more for each compound name that hides most text.
    """

    def __init__(self, html: str):
        shown: frozenset[int] = frozenset()
        while True:
            self._parse(html, shown)
            tag = max(self.hidden, key=self.hidden.get, default=0)
            if not tag or 2 * self.hidden[tag] <= self.plain + sum(self.hidden.values()):
                return
            shown |= {tag}

    def _parse(self, html: str, shown: frozenset[int]) -> None:
        #: characters outside links: in view, and by the tag whose compound name hides them
        self.plain, self.hidden = 0, {}
        #: text pieces; None is a border between blocks
        self.pieces: list[str | None] = []
        self.containers: list[Node] = []
        root = Node("", "", None, False, False)
        root.parts = [0, 0]
        stack = [root]
        self.containers.append(root)
        at = 0
        # searched anew from `at`: a tag that seems to start in a script is none
        while m := _TOKEN.search(html, at):
            if m.start() > at:
                self._text(html[at : m.start()], stack)
            at = m.end()
            tag = m.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            if m.group(1):
                self._close(tag, stack)
                continue
            if tag in VOID:
                if tag == "br" or tag == "hr":
                    self.pieces.append(" " if tag == "br" else None)
                continue
            if tag in ENDS_P:
                self._implied(stack, ("p",), ("div", "section", "article", "body", "td", "li", "main", "blockquote"))
            elif tag == "li":
                self._implied(stack, ("li",), ("ul", "ol", "menu"))
            elif tag in ("td", "th", "tr"):
                self._implied(stack, ("td", "th") if tag != "tr" else ("td", "th", "tr"), ("table",))
            elif tag in ("dt", "dd"):
                self._implied(stack, ("dt", "dd"), ("dl",))
            node = _opened(tag, m.group(3), stack[-1], m.start() + 1, shown)
            if tag not in INLINE:
                self.pieces.append(None)
            if m.group(3).endswith("/") and tag not in INLINE | CONTAINERS | {"p", "li", "ul", "ol", "table"}:
                continue
            node.parts = [len(self.pieces), len(self.pieces)]
            stack.append(node)
            if tag in CONTAINERS and not node.skip:
                self.containers.append(node)
            if tag in RAW:
                raw_end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                stop = raw_end.start() if raw_end else len(html)
                at = stop
                if raw_end is None:
                    break
        if at < len(html):
            self._text(html[at:], stack)
        while len(stack) > 1:
            self._pop(stack)
        root.parts[1] = len(self.pieces)

    def _text(self, text: str, stack: list[Node]) -> None:
        node = stack[-1]
        if node.doubt and not node.link and node.tag not in RAW:
            self.hidden[node.doubt] = self.hidden.get(node.doubt, 0) + len(text.strip())
        if node.skip or node.tag in RAW:
            return
        if "&" in text:
            text = unescape(text)
        self.pieces.append(text)
        size = len(text.strip())
        if not size:
            return
        weight = -0.5 * size if node.link else size
        self.plain += 0 if node.link else size
        # text counts for the nearest container; half of it for the next one up
        share = 1.0
        for up in reversed(stack):
            if up.tag in CONTAINERS or up is stack[0]:
                up.score += weight * share
                if share < 1.0:
                    break
                share = 0.4

    def _pop(self, stack: list[Node]) -> None:
        node = stack.pop()
        node.parts[1] = len(self.pieces)
        if node.tag not in INLINE:
            self.pieces.append(None)

    def _close(self, tag: str, stack: list[Node]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                while len(stack) > i:
                    self._pop(stack)
                return
            # an inline end tag never closes the block around it
            if tag in INLINE and stack[i].tag not in INLINE:
                return

    def _implied(self, stack: list[Node], tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                while len(stack) > i:
                    self._pop(stack)
                return
            if stack[i].tag in stop:
                return

    def best(self) -> Node | None:
        """The container with the best score; article and main count double."""
        best, most = None, 0.0
        for c in self.containers:
            score = c.score * (2.0 if c.tag in ("article", "main") else 1.0)
            if score > most:
                best, most = c, score
        return best

    def at_path(self, key: int) -> list[Node]:
        return [c for c in self.containers if c.key == key and c.score > 0]

    def text(self, nodes: list[Node]) -> str:
        """Blocks of the containers, outermost only, in page order."""
        blocks: list[str] = []
        done = 0
        for node in sorted(nodes, key=lambda x: (x.parts[0], -x.parts[1])):
            if node.parts[1] <= done:
                continue
            run: list[str] = []
            for piece in [*self.pieces[max(node.parts[0], done) : node.parts[1]], None]:
                if piece is not None:
                    run.append(piece)
                elif run:
                    block = " ".join("".join(run).split())
                    if block:
                        blocks.append(block)
                    run = []
            done = node.parts[1]
        return " ".join(blocks)


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def candidates(pages: DataFrame) -> DataFrame:
    """k1, k2, host, path and best: the hashes of the paths of each page's containers.

    pages: k1, k2, host, html.  A page has a row for each path, with best for one at most.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 4 << 20, "html"):
            row, path, is_best = [], [], []
            for i, html in enumerate(batch.column("html").to_pylist()):
                page = Page(html or "")
                best = page.best()
                for key in {c.key for c in page.containers if c.score > 0}:
                    row.append(i)
                    path.append(_signed(key))
                    is_best.append(best is not None and key == best.key)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("k1", "k2", "host")], pa.array(path, pa.int64()), pa.array(is_best, pa.bool_())], names=["k1", "k2", "host", "path", "best"])

    return pages.mapInArrow(work, "k1 long, k2 long, host long, path long, best boolean")


def chosen_paths(pages: DataFrame) -> DataFrame:
    """k1, k2 and path: of each page, the path of its own with most votes of its host.

    A host, and a path of it, may have a third of the pages.
    """
    found = written(candidates(pages).distinct(), "paths")
    host_path = F.struct("host", "path")
    votes = found.filter("best").groupBy(host_path.alias("hp")).agg(F.count(F.lit(1)).alias("votes"))
    ranked = hot_join(found.select("k1", "k2", host_path.alias("hp")), votes, "hp", "k1")
    return ranked.groupBy("k1", "k2").agg(F.max_by("hp.path", F.struct("votes", "hp.path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and path of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.xxhash64(F.coalesce(F.lower(F.regexp_extract("url", _HOST.pattern, 1)), F.lit("")))
    # equal pages have equal keys, whatever the order in which they are read
    keyed = rows.select("*", F.xxhash64("url", "html").alias("k1"), F.xxhash64(F.lit("page"), "html", "url").alias("k2"), host.alias("host"))
    joined = keyed.drop("host").join(chosen_paths(keyed.select("k1", "k2", "host", "html")), ["k1", "k2"], "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 4 << 20, "html"):
            texts, used = [], []
            for html, key in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True):
                page = Page(html or "")
                nodes = page.at_path(key % (1 << 64)) if key is not None else []
                texts.append(page.text(nodes))
                used.append(nodes[0].path() if nodes else None)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(used, pa.string())], names=["page_id", "url", "text", "path"])

    return joined.select("page_id", "url", "html", "path").mapInArrow(work, "page_id long, url string, text string, path string")


def op3_extract_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
