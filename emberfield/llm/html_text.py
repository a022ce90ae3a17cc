"""Main text of web pages by tree scoring.

A page is read into a small element tree. Navigation, notices, adverts, forms, comments
and the like are taken out. Every paragraph then passes points, for its length and its
commas, to its ancestors, less with distance; a container's points are discounted by the share of
its text that stands in links. The best container, or the article or main element around it, is kept, with those
siblings whose points come near or that are plain prose, and what stands between these. Of containers with equal
points the one that got its first points first is the best.
"""

from __future__ import annotations

import bisect
import functools
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .textnum import release

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)([^>]*+)>")
NAME = re.compile("</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
SENTENCE = re.compile("[.!?…。！？؟।։,،、，]")
COMMAS = re.compile("[,،、，﹐︑︐]")

RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROP = RAW | {"head", "nav", "footer", "aside", "form", "noscript", "template", "object", "canvas", "desc", "metadata", "defs", "symbol", "annotation", "annotation-xml", "button", "select", "option", "dialog", "menu", "audio", "video", "map", "fieldset", "label", "progress", "meter", "output", "datalist"}
BLOCK = {"html", "body", "address", "article", "blockquote", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "header", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "nav", "aside", "footer", "form"}
#: An open element of the first kind ends where one of the second begins.
ENDS = {"p": BLOCK - {"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "head": {"body"}}
#: Blocks that hold sentences themselves.
SENTENCES = {"p", "li", "td", "th", "dd", "dt", "blockquote", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WALLS = {"ul": {"li"}, "ol": {"li"}, "dl": {"dt", "dd"}, "table": {"tr", "td", "th", "p", "li", "dt", "dd"}, "td": {"p", "li"}, "th": {"p", "li"}, "article": {"p"}, "section": {"p"}, "div": {"p", "li", "dt", "dd"}, "body": {"p"}, "html": set()}
UNLIKELY = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner sidebar aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist disqus reply replies respond discussion pagination pager paging skip hidden copyright legal disclaimer alert teaser teasers trending outbrain taboola".split()
)
UNLIKELY |= {"notification", "notifications", "adsbygoogle"}
#: Words of UNLIKELY that an author may use for a part of the text as well.
WEAK = {"legal", "disclaimer", "copyright", "discussion", "hidden", "header", "masthead", "teaser", "teasers", "promotion", "skip", "respond"}
#: Words that say nothing about what a part is; with these a name is still that of furniture, with others it may be that of a topic.
HELPERS = set(
    "area article articles author avatar bar block body bottom box button buttons by cell col column container content count count facebook featured feed follow form google global group icon icons "
    "id inline inner item items label latest left link links list main media meta middle module more news outer page panel popular policy post posts primary products reading recent right row secondary section "
    "site slot stories story text the thread title toggle tools top topics twitter unit videos wrap wrapper zone entry you your us our all js".split()
)
#: Headings of lists that belong to a text though they are links, in the languages of the pages.
SOURCES = set("sources source references reference citations bibliography notes footnotes quellen quelle literatur einzelnachweise fuentes fuente referencias notas bibliografía références référence bibliographie".split())
#: Words that an article's own parts may bear too, beside one of the following words.
EITHER = {"header", "masthead", "teaser", "teasers"}
LIKELY = {"article", "main", "content", "body", "post", "entry", "story", "text"}
#: A name with one of these speaks of the page around, as has-sidebar.
ABOUT = {"has", "with", "no", "without", "layout"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form", "status"}


class Node:
    __slots__ = ("children", "doubt", "drop", "link", "parent", "score", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, drop: bool, doubt: str = ""):
        self.tag, self.parent, self.drop, self.doubt = tag, parent, drop, doubt
        self.children: list[Node | str] = []
        self.score, self.size, self.link = 0.0, 0, 0

    @classmethod
    def of_text(cls, text: str) -> Node:
        node = cls("p", None, False)
        node.children.append(text)
        return node


@functools.cache
def _words(name: str) -> tuple[str, ...]:
    """The words of a name, in lower case: parted at capitals and signs, and where a word of UNLIKELY stands beside one of HELPERS."""
    out = []
    for word in map(str.lower, WORD.findall(name)):
        cut = next((k for k in range(2, len(word) - 1) if {word[:k], word[k:]} & UNLIKELY and {word[:k], word[k:]} & HELPERS), 0) if word not in UNLIKELY else 0
        out += [word[:cut], word[cut:]] if cut else [word]
    return tuple(out)


def _judge_name(name: str, inside: bool) -> str:
    """What a class or id says: "drop", "weak" (if the element's text agrees), "about" (unless the page around bears it) or nothing."""
    words = _words(name[:200])
    about = next((k for k, w in enumerate(words) if w in ABOUT), None)
    if about is not None:
        if set(words[about:]) & UNLIKELY and not set(words[:about]) & UNLIKELY:
            return "about"
        words = words[:about]
    unlikely = set(words) & UNLIKELY
    if not unlikely or set(words) & LIKELY and unlikely <= EITHER:
        return ""
    topic = set(words) - UNLIKELY - HELPERS - LIKELY
    return "weak" if unlikely <= WEAK or inside and topic else "drop"


def _unlikely(tag: str, attributes: str, inside: bool) -> str:
    """Whether an element, by its tag or attributes, is not part of the text, as _judge_name() says it. inside: of an article or main."""
    if tag in DROP or tag == "header" and not inside:
        return "drop"
    if not attributes or tag in ("html", "body", "article", "main"):
        return ""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    style = found.get("style", "").replace(" ", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" and tag != "math" or "display:none" in style or "visibility:hidden" in style:
        return "drop"
    if found.get("role", "").lower() in ROLES:
        return "drop"
    said = {_judge_name(name, inside) for name in (found.get("class", "") + " " + found.get("id", "")).split()}
    return next((x for x in ("drop", "weak", "about") if x in said), "")


class _Ends:
    """Where tags end, for a page on which one has no end by its quotes: made once, then asked by position."""

    def __init__(self, page: str):
        self.at = [m.start() for m in re.finditer("[>\"']", page)]
        end, after = [-1] * (len(self.at) + 1), {}
        for k in range(len(self.at) - 1, -1, -1):  # from outside quotes: at > itself, else as after the closing quote
            mark = page[self.at[k]]
            end[k] = self.at[k] if mark == ">" else end[after[mark] + 1] if mark in after else -1
            after[mark] = k
        self.end = end

    def __call__(self, start: int) -> int:
        return self.end[bisect.bisect_left(self.at, start)]


def parse(page: str) -> Node:
    """The element tree, tolerant of unclosed and stray tags. Linear in the page's length."""
    root = Node("html", None, False)
    at, now, end, depth, last = 0, root, len(page), 0, page.rfind(">")
    open_tags: list[Node] = [root]
    ends: _Ends | None = None
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            now.children.append(page[at:lt])
        if lt == end:
            break
        if lt > last and not page.startswith("<!--", lt):
            now.children.append(page[lt:])
            break
        if not ends or not NAME.match(page, lt):
            m = TOKEN.match(page, lt)
        elif (stop := ends(lt)) >= 0:
            m = TOKEN.match(page, lt, stop + 1)
        else:
            m = None
        if not m and (m := LOOSE.match(page, lt)):
            ends = ends or _Ends(page)
        if not m:
            now.children.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(open_tags) - 1, 0, -1):
                if open_tags[k].tag == tag:
                    depth -= sum(n.tag in ("article", "main") for n in open_tags[k:])
                    del open_tags[k:]
                    break
                if tag not in BLOCK and open_tags[k].tag in BLOCK:
                    break  # a stray inline end tag does not close a block
            now = open_tags[-1]
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in open_tags[:2]):
            continue
        for kind, starts in ENDS.items():
            if tag not in starts:
                continue
            for k in range(len(open_tags) - 1, 0, -1):
                if open_tags[k].tag == kind:
                    depth -= sum(n.tag in ("article", "main") for n in open_tags[k:])
                    del open_tags[k:]
                    break
                if kind in WALLS.get(open_tags[k].tag, ()):
                    break
        now = open_tags[-1]
        said = _unlikely(tag, m[3] or "", depth > 0)
        if tag == "svg" and next((n.tag for n in reversed(open_tags) if n.tag in BLOCK), "") not in SENTENCES:
            said = "drop"  # a drawing, not a sign in a sentence
        node = Node(tag, now, now.drop or said == "drop", said)
        now.children.append(node)
        if tag in RAW:
            close = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID and not (m[3] or "").rstrip().endswith("/") or tag in ("div", "p", "span", "a"):
            open_tags.append(node)
            now = node
            depth += tag in ("article", "main")
    return root


def _walk(root: Node) -> Iterator[tuple[Node | str, bool]]:
    """Kept nodes and strings in page order; (node, False) when it begins, (node, True) when it ends."""
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        item, done = stack.pop()
        yield item, done
        if not done and isinstance(item, Node):
            stack.append((item, True))
            stack.extend((c, False) for c in reversed(item.children) if isinstance(c, str) or not c.drop)


def blocks(roots: list[Node]) -> list[str]:
    """Texts of the blocks, character references decoded, white space joined."""
    out, part = [], []

    def close() -> None:
        if text := " ".join("".join(part).split()):
            out.append(text)
        part.clear()

    for root in roots:
        for item, _ in _walk(root):
            if isinstance(item, str):
                part.append(html.unescape(item))
            elif item.tag in BLOCK:
                close()
            elif item.tag == "br":
                part.append(" ")
        close()
    return out


def _score(root: Node) -> list[Node]:
    """Points of all containers, in page order. A block's own text outside links is a paragraph."""
    scored: dict[int, Node] = {}
    holders: list[Node] = [root]
    texts: list[list[str]] = [[]]
    links = 0

    def give(holder: Node, pieces: list[str]) -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if len(text) < 25:
            return
        points = 1 + len(COMMAS.findall(text)) + min(len(text) / 100, 3)
        target = holder.parent if holder.tag in ("p", "pre", "td", "li", "blockquote", "dd", "dt") and holder.parent else holder
        level = 0
        while target is not None and level < 5:
            target.score += points / (1, 2, 6, 9, 12)[level]
            scored.setdefault(id(target), target)
            target, level = target.parent, level + 1

    for item, done in _walk(root):
        if isinstance(item, str):
            text = html.unescape(item)
            if not links:
                texts[-1].append(text)
            n = len(text) - text.count(" ")
            holders[-1].size += n
            if links:
                holders[-1].link += n
        elif item.tag == "a":
            links += -1 if done else 1
        elif item.tag in BLOCK:
            if not done:
                give(holders[-1], texts[-1])
                holders.append(item)
                texts.append([])
            elif len(holders) > 1:
                give(holders[-1], texts.pop())
                child = holders.pop()
                holders[-1].size += child.size
                holders[-1].link += child.link
        elif item.tag == "br":
            texts[-1].append(" ")
    return list(scored.values())


def _settle(root: Node) -> None:
    """Decide about elements whose names leave a doubt.

    A weak name drops an element with many links, or with bare text alone. The name of a page around drops an element that holds
    neither an article, main or h1 nor half of the page's text: then it is the part that the name speaks of.
    """
    if not any(isinstance(n, Node) and n.doubt in ("weak", "about") for n, done in _walk(root) if done):
        return
    sizes, links, held = {}, {}, {}
    stack: list[tuple[Node, int, int, set]] = []
    size = link = inside = 0
    tags: list[tuple[str, int]] = []
    for item, done in _walk(root):
        if isinstance(item, str):
            n = len(item) - item.count(" ") if not item.isspace() else 0
            size += n
            link += n if inside else 0
        elif not done:
            inside += item.tag == "a"
            stack.append((item, size, link, len(tags)))
        else:
            inside -= item.tag == "a"
            node, a, b, first = stack.pop()
            if node.doubt:
                sizes[id(node)], links[id(node)] = size - a, link - b
                held[id(node)] = {tag for tag, n in tags[first:] if n}
            tags.append((node.tag, size - a))
    for node, done in list(_walk(root)):
        if not done or not isinstance(node, Node) or id(node) not in sizes:
            continue
        n, within = sizes[id(node)], held[id(node)]
        if node.doubt == "weak":
            node.drop = links[id(node)] >= 0.25 * n or not within & (SENTENCES | {"pre", "section"}) and node.tag not in SENTENCES
        elif node.doubt == "about":
            node.drop = not within & {"article", "main", "h1"} and n < 0.5 * size


def _lists_sources(node: Node) -> bool:
    """Whether a list stands after a heading of sources, inside an article or main."""
    up = node.parent
    around = [c for c in (up.children if up else ()) if not (isinstance(c, str) and not c.strip())]
    at = next((k for k, c in enumerate(around) if c is node), 0)
    if not at or not isinstance(around[at - 1], Node) or around[at - 1].tag not in HEADINGS:
        return False
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    return up is not None and bool(set(re.findall(r"\w+", " ".join(blocks([around[at - 1]])).lower())) & SOURCES)


def main_text(page: str | None) -> str:
    """The page's main text: blocks in page order, joined by two line ends; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    _settle(root)
    density = lambda n: n.link / n.size if n.size else 0.0
    scored = _score(root)
    if not scored:
        tags = {}
        for item, done in _walk(root):
            if isinstance(item, Node) and not done:
                tags.setdefault(item.tag, item)
        whole = tags.get("article") or tags.get("main") or tags.get("body") or root
        return "\n\n".join(blocks([whole])) if density(whole) < 0.5 else ""
    sources = set()
    for item, done in _walk(root):
        if done and isinstance(item, Node) and item.tag in ("div", "section", "ul", "ol", "table", "dl", "p") and not item.score and density(item) > 0.6:
            if item.tag in ("ul", "ol", "dl", "table") and _lists_sources(item):
                sources |= {id(n) for n in _above(item)}
            elif id(item) not in sources:
                item.drop = True  # a menu: links and little else
    best = max(scored, key=lambda n: n.score * (1 - density(n)))
    points = best.score * (1 - density(best))
    up = best
    while up is not None:
        if up.tag in ("article", "main") and density(up) < 0.5:
            best = up
            break
        up = up.parent
    return "\n\n".join(blocks(_with_siblings(best, points)))


def _above(node: Node) -> Iterator[Node]:
    while node.parent is not None:
        node = node.parent
        yield node


def _with_siblings(best: Node, points: float) -> list[Node]:
    """The best container and those siblings that belong to it, in page order."""
    if best.parent is None or best.tag == "main":
        return [best]
    around = [s for s in best.parent.children if not (isinstance(s, str) and not s.strip()) and not (isinstance(s, Node) and s.drop)]

    def belongs(s: Node | str) -> bool:
        if s is best:
            return True
        if isinstance(s, str) or not s.size:
            return False
        density = s.link / s.size
        if s.tag in ("p", "pre", "blockquote"):
            return density < 0.25 and bool(SENTENCE.search(" ".join(blocks([s]))))
        return s.score * (1 - density) >= 0.2 * points or s.tag == best.tag and s.tag in ("article", "section") and s.score > 0 and density < 0.25

    def joins(s: Node | str) -> bool:
        """Whether it belongs if its neighbours do: bare text, headings, lists and the like with few links."""
        return isinstance(s, str) or s.tag in HEADINGS and not s.link or s.tag not in ("p", "div") and s.link < 0.25 * s.size

    kept = [k for k, s in enumerate(around) if belongs(s)]
    first = kept[0]
    while first and isinstance(around[first - 1], Node) and around[first - 1].tag in HEADINGS and not around[first - 1].link:
        first -= 1
    return [Node.of_text(s) if isinstance(s, str) else s for k, s in enumerate(around) if first <= k <= kept[-1] and (k in kept or joins(s))]


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of every page.

    pages: page_id, url, html; other columns are ignored. A null or empty html gives an empty text; repeated rows give equal texts;
    an empty table gives an empty table. Returns one row for each row: page_id, url, text, n_chars (code points). A page is handled
    alone, in time and memory linear in its length.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(h).encode("utf-8", "replace").decode() for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})
            release()

    return pages.selectExpr("cast(page_id as long) AS page_id", "url", "html").mapInPandas(task, "page_id long, url string, text string, n_chars long")
