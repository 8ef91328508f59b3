"""HTML extraction with a site style tree.

The pages of a host are merged into one tree: elements with the same path of tags and classes are one
style node. Over the pages of the host a node has a presentation entropy (how varied are the sequences
of elements below it) and a content entropy (how varied is its text), both scaled to 0..1; its
importance is the larger one. What looks and reads alike on every page is template. Branches whose
importance is below LOW are removed from each page of the host.

Entropy needs several pages, and varied menus or adverts look like content to it, so markup shifts the
importance: class words, page headers and forms lower that of their branches, as does standing outside
``article`` and ``main`` on a page whose plain text is mostly inside these; standing inside them makes up
for it. It does not for containers that name themselves adverts, notices or comments (NAMES). Markup weighs by what
it holds: a form or a container with a class word that holds prose and most of the page's text, or its first heading or article, few of
it in links, is the page's body and not shifted; a page with prose outside the names never comes out empty for
its markup. Nodes on fewer than MIN_PAGES different pages have importance PLAIN before the shift. ``article``
and ``main`` are never removed themselves. Only elements that are never content (NOISE tags and roles, hidden
ones) are dropped unseen; formulas are text of their line.

Edge cases: null html counts as empty and gives an empty text; null url: the host is empty, like any
url without one; truncated pages are read as far as they go; very long pages and deeply nested or unclosed
tags cost time in proportion to the page; pages that repeat count once in the tree and all get a row; pages that tie
in everything get the same text; other columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewise.llm.common import join_checked, store

LOW, MIN_PAGES = 0.2, 8
# Importance of a node on few pages, and shifts by class word, by form or doubtful role, outside and inside content elements.
PLAIN, BY_WORD, BY_FORM, OUTSIDE, INSIDE = 0.4, -0.5, -0.75, -0.5, 0.5
# Shift of a container that names itself an advert, a notice or readers' comments: standing inside an article does not make up for it.
BY_NAME = -1.5
# A form or a container with a class word that holds more of the page's text than this, few of it in links, is the page's body.
BODY_SHARE, LINK_SHARE = 0.5, 0.5
# A block of so many words is prose.
PROSE_WORDS = 8

# Fixed values of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu",
    "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
# Elements that never hold content of a page.
NOISE = {
    "head", "title", "nav", "footer", "aside", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas",
    "button", "select", "textarea", "input", "menu", "dialog", "audio", "video", "map", "annotation", "annotation-xml",
}
# Those of them that end a line of text; the others stand inside one.
APART = {"head", "title", "nav", "footer", "aside", "menu", "dialog"}
NOISE_ROLES = {"navigation", "contentinfo", "search", "dialog", "alertdialog", "menu", "menubar"}
FORMS, FORM_ROLES = {"form", "label"}, {"form", "banner", "complementary", "alert"}
NOISE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pagination", "pager", "popup", "promo", "promoted", "promotion", "related",
    "replies", "reply", "respond", "share", "sharing", "sidebar", "sidebars", "signup", "skyscraper", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
# Words that no container of main text bears, whatever it holds.
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "advertising", "comment", "comments", "commentlist", "consent", "cookie",
    "cookies", "disqus", "gdpr", "newsletter", "popup", "promo", "promoted", "replies", "respond", "sidebar", "sidebars", "skyscraper", "sponsor", "sponsored",
}
CONTAINER = {"div", "section", "ul", "ol", "dl", "table", "details", "figure", "fieldset", "center", "article"}
MAIN = {"article", "main"}
# Elements that are never removed themselves.
FIXED = MAIN | {"html", "body"}


def _noise(tag: str, attrs: list) -> bool:
    if tag in NOISE:
        return True
    a = dict(attrs)
    if "hidden" in a or (a.get("role") or "").lower() in NOISE_ROLES or (a.get("aria-hidden") or "").lower() == "true":
        return True
    return False


def _shift(tag: str, attrs: list) -> float:
    """What the markup of one element takes from its importance."""
    a = dict(attrs)
    words = {w for k in ("class", "id") for w in re.split(r"[^a-z]+", (a.get(k) or "").lower())}
    if tag in CONTAINER and words & NAMES:
        return BY_NAME
    if tag in FIXED:
        return 0.0
    if tag in FORMS or (a.get("role") or "").lower() in FORM_ROLES:
        return BY_FORM
    return BY_WORD if words & NOISE_WORDS or tag == "header" else 0.0


class Node:
    """An open element: where it hangs, its style node, its markup, and the text below it."""

    __slots__ = ("above", "at", "body", "linked", "main", "noise", "path", "shift", "tag", "chars", "heads", "open_links", "prose")

    def __init__(self, above, at: int, tag: str, path: int, noise: bool, main: bool, shift: float):
        self.above, self.at, self.tag, self.path, self.noise, self.main, self.shift = above, at, tag, path, noise, main, shift
        self.open_links = (above.open_links if above else 0) + (tag == "a")
        self.chars = self.linked = self.prose = 0
        self.heads = int(tag == "h1" or (tag in MAIN and shift == 0.0))
        self.body = False


class Page(HTMLParser):
    """One pass over a page: its blocks of text, each with the node it stands in. Work is linear in the page, however deep its tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[Node] = []
        self.nodes: list[Node] = []  # in order of their start tags: parents first
        self.open: dict[str, int] = {}
        self.blocks: list[tuple] = []  # (text, node or None, what joins it to the block before)
        self.marked = False
        self.inline, self.spaced = False, True
        self.buffer: list[str] = []
        self.below: dict[int, list[str]] = {}

    def flush(self, inline: bool = False):
        raw = "".join(self.buffer)
        text = " ".join(raw.split())
        self.buffer.clear()
        top = self.stack[-1] if self.stack else None
        if text and not (top and top.noise):
            join = "\n" if not self.inline else " " if self.spaced or raw[0].isspace() else ""
            self.blocks.append((text, top, join))
            self.inline, self.spaced = True, raw[-1].isspace()
            if top:
                top.chars += len(text)
                top.linked += len(text) if top.open_links else 0
                top.prose += text.count(" ") + 1 >= PROSE_WORDS
        elif raw:
            self.spaced = True
        self.inline = self.inline and inline

    def _pop(self, at: int):
        for node in self.stack[at:]:
            self.open[node.tag] -= 1
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        noise, shift = _noise(tag, attrs), _shift(tag, attrs)
        hidden = bool(self.stack) and self.stack[-1].noise
        if tag in BLOCK or (noise and not hidden):
            self.flush(inline=tag not in BLOCK and tag not in APART)
        elif (shift or tag == "a") and tag not in VOID:
            self.flush(inline=True)
        if tag in CLOSES_P:
            self._close_p()
        if tag == "li":
            self._close_open(("li",), ("ul", "ol", "menu"))
        elif tag in ("dd", "dt"):
            self._close_open(("dd", "dt"), ("dl",))
        elif tag in ("td", "th"):
            self._close_open(("td", "th"), ("tr", "table"))
        elif tag == "tr":
            self._close_open(("tr",), ("table",))
        if tag == "br":
            self.buffer.append(" ")
        if tag in VOID:
            return
        top = self.stack[-1] if self.stack else None
        style = dict(attrs).get("class") or ""
        above = top.path if top else 0
        path = xxhash.xxh64_intdigest(f"{tag}.{style}", above)
        self.below.setdefault(above, []).append(tag)
        main = bool(top and top.main) or (tag in MAIN and shift == 0.0 and not (top and top.noise))
        self.marked |= main
        node = Node(top, len(self.nodes), tag, path, noise or bool(top and top.noise), main, shift)
        self.nodes.append(node)
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _close_p(self):
        if not self.open.get("p"):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag == "p":
                self.flush()
                # formatting left open inside the paragraph goes on in the next one; it has no effect on text
                self._pop(at)
                return
            if self.stack[at].tag in BLOCK:
                return

    def _close_open(self, tags, until):
        if not any(self.open.get(t) for t in tags):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag in until:
                return
            if self.stack[at].tag in tags:
                self.flush()
                self._pop(at)
                return

    def handle_endtag(self, tag):
        if self.open.get(tag):
            for at in range(len(self.stack) - 1, -1, -1):
                node = self.stack[at]
                if node.tag == tag:
                    ends_noise = node.noise and not (at > 0 and self.stack[at - 1].noise)
                    if tag in BLOCK or ends_noise:
                        self.flush(inline=tag not in BLOCK and tag not in APART)
                    elif any(n.shift or n.tag == "a" for n in self.stack[at:]):
                        self.flush(inline=True)
                    self._pop(at)
                    return
                if node.tag in BLOCK and tag not in BLOCK:
                    return  # a stray end tag of an inline element closes nothing outside its block
        if tag == "br":
            self.buffer.append(" ")

    def handle_data(self, data):
        if not (self.stack and self.stack[-1].noise):
            self.buffer.append(data)

    def finish(self):
        """Totals of text below every node, and which forms and named containers are the body of the page."""
        inside = sum(len(t) for t, n, _ in self.blocks if n and n.main)
        whole = sum(len(t) for t, _, _ in self.blocks)
        for node in reversed(self.nodes):
            if node.above:
                node.above.chars += node.chars
                node.above.linked += node.linked
                node.above.heads += node.heads
                node.above.prose += node.prose
            if node.shift and node.linked <= LINK_SHARE * node.chars:
                share = node.shift > BY_NAME and node.prose > 0 and node.chars > BODY_SHARE * whole
                node.body = share or (node.heads > 0 and node.tag != "header")
        clear = [True] * len(self.nodes)  # no shift on the way down
        for node in self.nodes:
            clear[node.at] = (clear[node.above.at] if node.above else True) and (not node.shift or node.body)
        plain = sum(len(t) for t, n, _ in self.blocks if not (n and n.main) and (n is None or clear[n.at]))
        # a teaser marked as an article does not make the rest of its page noise
        self.marked = self.marked and inside >= plain


def parse(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    page.close()
    page.flush()
    page.finish()
    return page


def kept(page: Page, importance: dict[int, float]) -> str:
    """The blocks no node of which is below LOW.

    If markup alone would leave nothing of a page that has prose, only names count against its blocks.
    """
    out = _survivors(page, importance, True)
    if not out and page.blocks:
        out = _survivors(page, importance, False)
        if not any(len(text.split()) >= PROSE_WORDS for text in out[1::2]):
            out = []
    return "".join(out[1:])


def _survivors(page: Page, importance: dict[int, float], marks: bool) -> list[str]:
    out = []
    for (text, _, join), least in zip(page.blocks, _least(page, importance, marks)):
        if least >= LOW:
            out += [join, text]
    return out


def _least(page: Page, importance: dict[int, float], marks: bool) -> list[float]:
    """Least importance on the way to each block; one step a node for each of the places a block can stand in."""
    ways: dict[float, list] = {}

    def way(place: float) -> list:
        if place not in ways:
            total: list[tuple] = []  # least with the node, least above it, shift of the branch
            for n in page.nodes:
                upper = total[n.above.at] if n.above else (None, None, 0.0)
                # the element around a content element is not judged by what lies in that
                above = upper[1] if n.tag in MAIN else upper[0]
                shift = min(upper[2], 0.0 if n.body or (n.shift > BY_NAME and not marks) else n.shift)
                least = above
                if n.tag not in FIXED or n.shift:
                    own = importance.get(_signed(n.path), PLAIN) + min(0.0, shift + place)
                    least = own if above is None else min(own, above)
                total.append((least, above, shift))
            ways[place] = total
        return ways[place]

    out = []
    for _, n, _ in page.blocks:
        place = INSIDE if n and n.main else OUTSIDE if page.marked and marks else 0.0
        least = way(place)[n.at][0] if n else None
        out.append(PLAIN + min(0.0, place) if least is None else least)
    return out


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _said(page: Page) -> dict[int, int]:
    """Sum of the hashes of all blocks below each style node that may be judged."""
    own, past = [0] * len(page.nodes), [0] * len(page.nodes)  # past: text below a content element, which its parent is not judged by
    for text, n, _ in page.blocks:
        if n:
            own[n.at] += xxhash.xxh64_intdigest(text)
    said: dict[int, int] = {}
    for n in reversed(page.nodes):
        if own[n.at] and (n.tag not in FIXED or n.shift):
            said[n.path] = said.get(n.path, 0) + own[n.at]
        if n.above:
            up = past if n.tag in MAIN else own
            up[n.above.at] += own[n.at]
            past[n.above.at] += past[n.at]
    return said


def _nodes_task(batches):
    """A row for each style node of each page: what it says and what it looks like."""
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = parse(html)
            whole = _signed(xxhash.xxh64_intdigest("\n".join(b[0] for b in page.blocks)))
            for path, words in _said(page).items():
                look = _signed(xxhash.xxh64_intdigest(",".join(page.below.get(path, []))))
                for column, v in zip(out, (host, whole, _signed(path), look, _signed(words % (1 << 64)))):
                    column.append(v)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["host", "page", "node", "look", "words"])


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, pages, importance) over the different pages of every host."""
    rows = pages.select(host_of("url").alias("host"), F.col("html").cast("string").alias("html"))
    nodes = rows.mapInArrow(_nodes_task, "host string, page bigint, node bigint, look bigint, words bigint")
    nodes = store(nodes.groupBy("host", "node", "page", "look", "words").count().drop("count"), "nodes")

    def entropy(kind: str) -> DataFrame:
        counts = nodes.groupBy("host", "node", kind).agg(F.count("*").alias("c"))
        sums = counts.groupBy("host", "node").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
        # -sum(p log p) / log(m), with p = c / m
        value = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0)
        return sums.select("host", "node", F.col("m").alias("pages"), value.alias(kind))

    both = entropy("look").join(entropy("words").drop("pages"), ["host", "node"])
    return both.select("host", "node", "pages", F.greatest("look", "words").alias("importance"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    tree = style_tree(pages).where(f"pages >= {MIN_PAGES}")
    tree = tree.groupBy(F.col("host").alias("_host")).agg(F.collect_list("node").alias("nodes"), F.collect_list(F.col("importance").cast("float")).alias("importance"))
    tree = store(tree, "tree")
    # the tree's size is known: 12 bytes a style node, and its hosts
    nodes = tree.agg(F.sum(F.size("nodes") * 12 + F.length("_host") + 64)).first()[0] or 0
    width = -(-nodes // max(1, tree.count()))
    rows = pages.select(
        F.col("page_id").alias("page_id"), F.col("url").alias("url"), F.col("html").cast("string").alias("html"), host_of("url").alias("_host_of")
    )
    rows = join_checked(rows, tree, F.expr("_host_of = _host"), "left", width).select("page_id", "url", "html", "nodes", "importance")

    def run(batches):
        for batch in batches:
            texts = []
            for html, nodes, importance in zip(batch.column(2), batch.column(3), batch.column(4)):
                texts.append(kept(parse(html.as_py()), dict(zip(nodes.as_py() or (), importance.as_py() or ()))))
            text = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), text, pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
