"""Main text of web pages by removing the template that a site's pages share.

Spark parses every page into its element tree, hashes each block's subtree, and counts in how many
different articles of a host it occurs: pages of which the article (or the body, without one) has the
same text count once. Subtrees that recur are the host's template; every page is told which of its own subtrees
they are and leaves them out, together with elements that are no article by their tag, or by a class or
role that says nothing else. What is left of the article (or of the body, without one) is the text.

Text blocks (paragraphs, headings, lists, tables) recur for two reasons: as a site's notice, then on most
of its pages, or because articles quote the same words. They are template only on most pages of a host.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, table, text_batches

#: Articles of a host in which a subtree is template; for text blocks, and the share of the articles.
LEAST_PAGES, TEXT_PAGES, TEXT_SHARE = 4, 8, 0.8

#: Fixed values of HTML: elements without content, with raw text, and those that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br body caption html legend option select tbody td tfoot th thead title tr".split())
#: What an opening tag ends if it is open, and the elements that such a search does not leave.
SCOPES = {
    "p": ({"p"}, {"article", "section", "div", "table", "td", "th", "li", "blockquote", "button"}), "li": ({"li"}, {"ul", "ol", "menu"}),
    "term": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "row": ({"tr"}, {"table"}), "cell": ({"td", "th"}, {"tr", "table"}),
    "rows": ({"thead", "tbody", "tfoot"}, {"table"}),
}
ENDS = {**dict.fromkeys(CLOSES_P, ("p",)), "dt": ("p", "term"), "dd": ("p", "term"), "li": ("p", "li"), "option": ("option",), "tr": ("row",), "td": ("cell",), "th": ("cell",), "tbody": ("rows",), "tfoot": ("rows",)}
_MARKED = {tag: tuple(k for k, (own, stops) in SCOPES.items() if tag in own | stops) for own, stops in SCOPES.values() for tag in own | stops}
#: Elements that are never part of an article, and words in a class, id or role that say so.
DROPPED = frozenset("nav footer aside form script style noscript iframe noembed noframes textarea select button template svg canvas object embed audio video map dialog menu head title input label datalist xmp".split())
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay sidebar sidebars aside nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer footers header masthead topbar toolbar comment comments "
    "commentlist reply replies respond disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login widget widgets skip search complementary contentinfo".split()
)
#: Words that may stand beside those in a class name without telling of content: "comment-list", "site-header".
FURNITURE = frozenset(
    "area bar block bottom box btn button buttons col column container content form global group holder icon icons inner item items left link links list main outer page panel "
    "post posts region right row section site slot stories top unit wrap wrapper zone".split()
)
#: Blocks of text, which recur in articles that quote the same words.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol dl dt dd table caption thead tbody tfoot tr td th figure figcaption".split())
UNCOUNTED = frozenset("#root html head body main article title br hr".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARK = re.compile(r"[>=]")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORDS = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "hash")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.children, self.hash = tag, attrs, [], 0

    def attributes(self) -> dict[str, str]:
        return {k.lower(): html.unescape(v.strip("\"'")).lower() for k, v in _ATTR.findall(self.attrs)} if self.attrs.strip(" /") else {}


class _Open:
    """The stack of open elements, with what searches of it need: counts of tags, places of each scope's tags."""

    def __init__(self, root: Node):
        self.stack, self.count, self.places = [root], {}, {k: [] for k in SCOPES}

    def push(self, node: Node) -> None:
        for k in _MARKED.get(node.tag, ()):
            self.places[k].append(len(self.stack))
        self.count[node.tag] = self.count.get(node.tag, 0) + 1
        self.stack.append(node)

    def cut(self, at: int) -> None:
        for node in self.stack[at:]:
            self.count[node.tag] -= 1
        del self.stack[at:]
        for own in self.places.values():
            while own and own[-1] >= at:
                own.pop()

    def close(self, tag: str) -> None:
        """An end tag: closes the innermost open element of its name and what is open in it, if there is one."""
        if self.count.get(tag):
            at = len(self.stack) - 1
            while self.stack[at].tag != tag:
                at -= 1
            self.cut(at)

    def end(self, scope: str) -> None:
        """Closes the scope's open element, unless one that the search does not leave is nearer."""
        if (own := self.places[scope]) and self.stack[own[-1]].tag in SCOPES[scope][0]:
            self.cut(own[-1])


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the ">" of the tag stands that is open at ``at``; -1 if the page ends before it.

    last: the last place of each quote in the page; a value whose quote does not close is not quoted.
    """
    while m := _MARK.search(page, at):
        at = m.end()
        if m[0] == ">":
            return m.start()
        while at < len(page) and page[at] in " \t\n\f\r":
            at += 1
        if at < len(page) and (quote := page[at]) in last and at < last[quote]:
            at = page.find(quote, at + 1) + 1
    return -1


def parse(page: str) -> Node:
    """The element tree of a page in time linear in it; unclosed and misnested tags are closed as browsers do."""
    root = Node("#root", "")
    opened, at, size = _Open(root), 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    text: list[str] = []

    def flush() -> None:
        if text:
            opened.stack[-1].children.append(html.unescape("".join(text)))
            text.clear()

    while at < size:
        start = page.find("<", at)
        if start < 0:
            text.append(page[at:])
            break
        if start > at:
            text.append(page[at:start])
        after = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else size
            continue
        if after in ("!", "?"):
            stop = page.find(">", start)
            at = stop + 1 if stop >= 0 else size
            continue
        closing = after == "/"
        name = _NAME.match(page, start + 1 + closing)
        if not name:
            text.append("<")
            at = start + 1
            continue
        stop = page.find(">", name.end()) if closing else _tag_end(page, name.end(), last)
        at, tag = stop + 1 if stop >= 0 else size, name[0].lower()
        if stop < 0:
            break
        flush()
        if closing:
            opened.close(tag)
            continue
        for scope in ENDS.get(tag, ()):
            opened.end(scope)
        attrs = page[name.end() : stop]
        node = Node(tag, attrs)
        opened.stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            node.children.append(page[at : close.start() if close else size])
            at = close.end() if close else size
            continue
        if not attrs.endswith("/") or tag in BLOCK:
            opened.push(node)
    flush()
    return root


def hash_subtrees(root: Node) -> list[Node]:
    """Hash every element by its tag, attributes, text and children; gives the elements, children first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    order.reverse()
    for node in order:
        parts = [node.tag, node.attrs.strip()] + [" ".join(c.split()) if isinstance(c, str) else f"\0{c.hash}" for c in node.children]
        node.hash = xxhash.xxh64_intdigest("\1".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
    return order


def _tells(token: str, in_article: bool) -> bool:
    """Whether a class name says that its element is none of an article, and nothing of its content."""
    words = set(_WORDS.findall(token))
    telling = words & (NOT_ARTICLE - {"header"} if in_article else NOT_ARTICLE)
    return bool(telling) and (not in_article or words <= NOT_ARTICLE | FURNITURE)


def is_template_element(node: Node, in_article: bool) -> bool:
    """Whether an element is none of an article by its tag, class, id or role, or is hidden.

    Inside an article a class name has to consist of words that tell so and of furniture; "share-price"
    is no share button there.
    """
    if node.tag in DROPPED or node.tag == "header" and not in_article:
        return True
    if node.tag in ("html", "body", "main", "#root") or not (attrs := node.attributes()):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        return True
    return any(_tells(token, in_article) for name in ("class", "id", "role") for token in attrs.get(name, "").split())


def _tops(root: Node) -> tuple[list[Node], bool]:
    """The articles of a page, or its root, and whether there are articles."""
    articles, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main") and not is_template_element(node, True):
            articles.append(node)
            continue
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and not is_template_element(c, False)]
    return articles or [root], bool(articles)


def _key(node: Node) -> int:
    """What a subtree is counted under: its hash, the lowest bit of which tells text blocks from others."""
    return node.hash & ~1 | (node.tag in TEXT)


def subtrees(page: str | None) -> tuple[set[int], int]:
    """Keys of the block subtrees that recurrence is to judge, and the hash of the page's article."""
    root = parse(page or "")
    hash_subtrees(root)
    tops, inside = _tops(root)
    keys, words, todo, own_tops = set(), [], list(reversed(tops)), set(map(id, tops))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            words += node.split()
            continue
        if id(node) not in own_tops and is_template_element(node, inside):
            continue
        if node.tag in BLOCK and node.tag not in UNCOUNTED:
            keys.add(_key(node))
        todo += reversed(node.children)
    return keys, xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - (1 << 63)


def main_text(page: str | None, template: set[int]) -> str:
    """The article's text: blocks in page order, white space as one space; ``template``: keys to leave out."""
    root = parse(page or "")
    if template:
        hash_subtrees(root)
    tops, inside = _tops(root)
    parts: list[str] = []
    for top in tops:
        todo: list = [top]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                parts.append(node)
                continue
            block = node.tag in BLOCK
            if node is not top and (is_template_element(node, inside) or block and template and node.tag not in UNCOUNTED and _key(node) in template):
                parts.append(" ")
                continue
            todo += [" ", *reversed(node.children), " "] if block else reversed(node.children)
    return " ".join("".join(parts).split())


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_subtrees(pages: DataFrame) -> DataFrame:
    """(page, host, text) -> (page, host, key, article) of every block subtree; key 0 stands for the page."""

    def run(batches: Iterator) -> Iterator:
        for batch in text_batches(batches):
            at, keys, articles = [], [], []
            for i, page in enumerate(batch.column("text").to_pylist()):
                own, article = subtrees(page)
                own.discard(0)
                at += [i] * (len(own) + 1)
                keys += [0, *own]
                articles += [article] * (len(own) + 1)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page").take(take), batch.column("host").take(take), pa.array(keys, pa.int64()), pa.array(articles, pa.int64())], names=["page", "host", "key", "article"])

    return table(pages.select("page", "host", "text").mapInArrow(run, "page long, host string, key long, article long"))


def site_templates(found: DataFrame, least_pages: int = LEAST_PAGES, text_pages: int = TEXT_PAGES, text_share: float = TEXT_SHARE) -> DataFrame:
    """(page, host, key, article) -> (host, key) of the subtrees that recur in articles of the host."""
    articles = found.select("host", "key", "article").distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("articles"))
    counts = table(articles.where((F.col("articles") >= min(least_pages, text_pages)) | (F.col("key") == 0)))
    is_text = F.col("key").bitwiseAND(F.lit(1)) == 1
    texts = counts.where(is_text & (F.col("articles") >= text_pages))
    totals = counts.where("key = 0").join(texts.select("host").distinct(), "host").select("host", F.col("articles").alias("of"))
    most = texts.join(totals, "host").where(F.col("articles") >= text_share * F.col("of"))
    return table(counts.where(~is_text & (F.col("key") != 0) & (F.col("articles") >= least_pages)).select("host", "key").unionByName(most.select("host", "key")))


def extract_main_text(pages: DataFrame, *keep: Column, url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, text_pages: int = TEXT_PAGES, text_share: float = TEXT_SHARE) -> DataFrame:
    """The ``keep`` columns and text of each row of ``pages``.

    Character references are decoded; white space in a block is one space; blocks are joined by one
    space; nothing else is dropped or capped. A null or empty page has the text "". Pages with a null or
    unreadable url share the host "". Repeated rows count as one article. An empty table gives no rows.
    A tag that the page's end cuts off is left out, as browsers do. least_pages: articles of a host from
    which on a recurring block is template; text_pages, text_share: the same for blocks of text, and the
    share of the host's articles that it takes.
    """
    cut = pages.select(*keep, F.xxhash64(url_col, html_col).alias("page"), _host(F.col(url_col)).alias("host"), F.col(html_col).alias("text"))
    names = cut.columns[:-3]
    found = page_subtrees(cut)
    templates = site_templates(found, least_pages, text_pages, text_share)
    marks = found.join(lookup(templates, templates.count()), ["host", "key"]).groupBy("page").agg(F.collect_set("key").alias("template"))
    marks = table(marks)
    entries = marks.agg(F.sum(F.size("template"))).first()[0] or 0
    rows = cut.join(lookup(marks, entries), "page", "left").select(*[cut[n] for n in names], "template", "text")

    def run(batches: Iterator) -> Iterator:
        for batch in text_batches(batches):
            own = batch.column(len(names)).to_pylist()
            out = [main_text(page, set(keys or ())) for keys, page in zip(own, batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(out, pa.string())], names=[*names, "text"])

    schema = "".join(f"`{n}` {t}, " for n, t in rows.dtypes[:-2])
    return rows.mapInArrow(run, schema + "text string")
