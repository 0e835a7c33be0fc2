"""Web pages into metadata and blocks: a tolerant tree, the best container, its blocks, furniture trimmed."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import groupby, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.passages import Block, _Outline

# Weights, signals and phrases of the extraction.
TAG_WEIGHT = {"article": 1.4, "main": 1.25, "section": 1.05, "div": 1.0, "body": 0.9, "html": 0.9} | dict.fromkeys(("aside", "nav", "footer", "header", "form", "ul", "ol", "select", "figure"), 0.2)
CHROME = (
    "nav menu sidebar side-bar footer header masthead breadcrumb cookie consent gdpr advert ads- -ads promo sponsor subscribe newsletter paywall share social related recommend comment disqus pagination pager toolbar skip-link popup modal"
).split()
CONTENT = "article post entry content story body main prose markdown transcript".split()
SKIPPED = frozenset("script style noscript svg canvas iframe form button select input template footer nav".split())
RAW = ("script", "style", "textarea", "noscript", "template", "svg", "math")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("p div section article main li ul ol dl blockquote pre table figure hr details summary img h1 h2 h3 h4 h5 h6 td th dd dt figcaption caption".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
INTERFACE = (
    "jump to content", "move to sidebar", "move to top", "toggle the table of contents", "toggle sidebar", "skip to content", "skip to main content", "main menu",
    "toggle navigation", "appearance", "from wikipedia, the free encyclopedia", "edit links", "personal tools", "create account", "log in", "search",
)
LANGUAGES = (
    "العربية", "Čeština", "Deutsch", "Ελληνικά", "Español", "Eesti", "Euskara", "فارسی", "Suomi", "Français", "עברית", "Magyar", "Italiano", "日本語", "한국어", "Nederlands", "Norsk", "Polski",
    "Português", "Русский", "Shqip", "Svenska", "Türkçe", "Українська", "Tiếng Việt", "吴语", "粵語", "中文", "Bahasa", "Dansk", "हिन्दी", "Bahasa Indonesia", "Norsk bokmål", "Simple English", "srpski",
)
FOOTERS = (
    "all rights reserved", "©", "(c) 20", "share this article", "related articles", "read more", "subscribe to", "sign up for", "follow us on", "privacy policy",
    "terms of service", "cookie policy", "advertisement", "originally published", "this article was updated", "photo credit", "getty images",
)
TITLE_SEPARATORS = (" | ", " — ", " – ", " - ", " · ", " :: ", " » ")
META = {
    "title": ("og:title", "twitter:title", "headline"),
    "author": ("author", "article:author", "byl", "dc.creator", "citation_author"),
    "site_name": ("og:site_name", "application-name", "publisher"),
    "description": ("description", "og:description", "twitter:description"),
    "published": ("article:published_time", "og:published_time", "date", "datepublished", "dc.date", "dc.date.issued", "pubdate", "citation_publication_date"),
    "language": ("og:locale", "language"),
}
#: Elements nested deeper stand side by side.
DEEPEST = 200
PUNCTUATION = ".!?,;。！？，、"


def clean(text: str) -> str:
    return re.sub(r" {2,}", " ", re.sub(r"[\t\r\n]+", " ", re.sub("[\u00a0\u200b\ufeff]", " ", text))).strip()


@dataclass
class Node:
    """An element, or a text where ``tag`` is empty. Measures are added up as elements close."""

    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    text: str = ""
    children: list[Node] = field(default_factory=list)
    length: int = 0
    link: int = 0
    marks: int = 0
    paragraphs: int = 0
    depth: int = 0

    @property
    def classes(self) -> str:
        return f"{self.attributes.get('class', '')} {self.attributes.get('id', '')}".lower()

    def walk(self) -> Iterator[Node]:
        """This element and those below it, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if c.tag]

    def flat(self) -> str:
        todo, out = [self], []
        while todo:
            node = todo.pop()
            out.append(node.text)
            if node.tag in BLOCKS or node.tag == "br":
                out.append(" ")
            todo += reversed(node.children)
        return "".join(out)

    def measure(self) -> None:
        """Sums over the tree, deepest elements first."""
        order, level = [], {id(self): 0}
        for node in self.walk():
            order.append(node)
            level.update((id(c), level[id(node)] + 1) for c in node.children)
        for node in reversed(order):
            node.depth = level[id(node)]
            for c in node.children:
                if not c.tag:
                    node.length += len(c.text)
                    node.marks += sum(map(c.text.count, PUNCTUATION))
                else:
                    node.length, node.marks, node.paragraphs = node.length + c.length, node.marks + c.marks, node.paragraphs + c.paragraphs
                    node.depth = max(node.depth, c.depth)
                    node.link += c.length if c.tag == "a" else c.link
            node.length += len(node.attributes.get("alt", "")) if node.tag == "img" else 0
            node.paragraphs = max(1, node.paragraphs + (node.tag in ("p", "li", "blockquote", "pre")))


class _Tree(HTMLParser):
    """Builds nodes; stray end tags are ignored and open elements closed with their parents."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("document")
        self.open = [self.root]
        self.raw: str | None = None
        self.title, self.in_title = "", False
        self.meta: dict[str, str] = {}
        self.canonical = self.language = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if self.raw:
            return
        if tag == "title":
            self.in_title = True
        elif tag == "html" and self.language is None:
            self.language = a.get("lang")
        elif tag == "link" and a.get("rel", "").lower() == "canonical" and a.get("href"):
            self.canonical = a["href"]
        elif tag == "meta" and a.get("content"):
            key = (a.get("name") or a.get("property") or a.get("itemprop") or "").lower()
            if key:
                self.meta.setdefault(key, a["content"])
        if tag in RAW:
            self.raw = tag
            return
        node = Node(tag, a)
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.raw:
            self.raw = None if tag == self.raw else self.raw
            return
        self.in_title = self.in_title and tag != "title"
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        if at:
            del self.open[at:]

    def parse_marked_section(self, i, report=1):
        """A marked section of no known kind, which the base class raises on, is a comment that ends at the next bracket."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else len(self.rawdata)

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.raw and data:
            self.open[-1].children.append(Node("", text=data))


def _beside_site(parts: list[str], site: str | None) -> str | None:
    """The longest part beside one that names the site."""
    others = [p for p in parts if p.lower() != site.lower()] if site else parts
    longest = max(others, key=len, default="")
    return longest if len(others) == len(parts) - 1 and len(longest) >= 12 else None


def _before_short_end(parts: list[str], site: str | None) -> str | None:
    """The first part where it is long and the last is as short as a name."""
    return parts[0] if len(parts[0]) > 12 and len(parts[-1]) < 30 else None


def headline(title: str, site: str | None) -> str:
    """The headline of "Headline — Site Name": the first separator and rule that give one."""
    splits = (title.split(s) for s in TITLE_SEPARATORS)
    found = (rule(parts, site) for parts in splits if 2 <= len(parts) <= 4 for rule in (_beside_site, _before_short_end))
    return next(filter(None, found), title).strip()


def _metadata(tree: _Tree) -> dict[str, str | None]:
    first = lambda name: next((tree.meta[k] for k in META[name] if tree.meta.get(k)), None)
    site, title = first("site_name"), first("title") or " ".join(tree.title.split()) or None
    language = first("language")
    return {
        "title": headline(title, site) if title else None, "author": first("author"), "site_name": site, "description": first("description"),
        "canonical": tree.canonical, "published": first("published"), "language": language.split("_")[0] if language else tree.language,
    }


def _has(text: str, signals) -> bool:
    return any(s in text for s in signals)


def scores(nodes: list[Node]) -> np.ndarray:
    """How much each element looks like the page's content; all have text."""
    column = lambda of: np.array([of(n) for n in nodes], float)
    length = column(lambda n: n.length)
    share = np.minimum(1.0, column(lambda n: n.link) / length)
    factors = (
        np.select([share > 0.5, share > 0.3], [0.15, 0.45], 1.0),
        0.55 + 0.45 * np.minimum(1.0, column(lambda n: n.marks) / column(lambda n: n.paragraphs)),
        column(lambda n: TAG_WEIGHT.get(n.tag, 0.6)),
        np.where([_has(n.classes, CHROME) for n in nodes], 0.12, 1.0),
        np.where([_has(n.classes, CONTENT) for n in nodes], 1.45, 1.0),
        1.0 + np.minimum(0.15, 0.01 * column(lambda n: n.depth)),
    )
    return length * np.prod(factors, axis=0)


def select(root: Node) -> Node:
    """The first of the best containers; an article or main element that comes within a fifth of it is preferred."""
    nodes = [n for n in root.walk() if n.length]
    if not nodes:
        return root
    score = scores(nodes)
    named = np.where([n.tag in ("article", "main") for n in nodes], score, 0.0)
    return nodes[int((named if named.max() >= 0.8 * score.max() else score).argmax())]


#: What an attribute's value has to be for its element to stay unseen.
UNSEEN = {
    "hidden": lambda v: True,
    "aria-hidden": {"true"}.__contains__,
    "role": {"navigation", "banner", "complementary"}.__contains__,
    "style": lambda v: "display:none" in v.lower(),
}


def seen(n: Node) -> bool:
    """Whether an element is read at all: chrome is passed over where it is short, but never a paragraph."""
    furniture = n.tag != "p" and n.length < 1500 and _has(n.classes, CHROME)
    return not (furniture or n.tag in SKIPPED or any(UNSEEN[k](v) for k, v in n.attributes.items() if k in UNSEEN))


def _plain(n: Node) -> str:
    return clean(n.flat())


def _described(n: Node) -> str:
    alt = n.attributes.get("alt", "")
    return "" if len(alt) <= 12 or alt.lower().startswith("logo") else clean(alt)


def _cells(n: Node) -> str:
    rows = ([clean(c.flat()) for c in r.children if c.tag in ("td", "th")] for r in n.walk() if r.tag == "tr")
    return "\n".join(" | ".join(filter(None, r)) for r in rows if any(r))


def _own_words(n: Node) -> str:
    """What an item says outside the elements in it, unless nearly all of it is links."""
    mostly_links = n.length and n.link >= 0.9 * n.length
    return "" if mostly_links else clean(" ".join(c.text or c.attributes.get("alt", "") for c in n.children if c.tag in ("", "img")))


@dataclass(frozen=True)
class Form:
    """What an element is written as: the kind of its block, where the text comes from, how long it has to be, and
    whether the elements inside are written after it."""

    kind: str
    text: Callable[[Node], str]
    least: int = 2
    inside: bool = False


FORMS = {
    **{h: Form("heading", _plain, 1) for h in HEADINGS},
    "pre": Form("code", lambda n: n.flat().strip(), 9),
    "blockquote": Form("quote", _plain),
    "img": Form("caption", _described, 12),
    "table": Form("table", _cells, 1),
    "li": Form("list_item", _own_words, 3, inside=True),
    "dt": Form("paragraph", _plain),
    "dd": Form("paragraph", _plain),
}
LEAF, THROUGH = Form("paragraph", _plain), Form("", lambda n: "", 1, inside=True)
#: Least lengths of text that stands by itself, and of a run of inline text beside blocks.
LOOSE, RUN = 60, 20


def form_of(n: Node) -> Form | None:
    """An element's form; none for a block that holds blocks beside inline text."""
    if n.tag in FORMS or n.tag not in BLOCKS:
        return FORMS.get(n.tag, THROUGH)
    return None if any(c.tag in BLOCKS for c in n.children) else LEAF


def pieces(n: Node) -> Iterator[tuple[str, str, int]]:
    """(kind, text, heading level) of all that is written of a node, in the page's order."""
    if not n.tag:
        if len(text := clean(n.text)) >= LOOSE:
            yield "paragraph", text, 0
        return
    if not seen(n):
        return
    form = form_of(n)
    if form is None:
        for block, some in groupby(n.children, lambda c: c.tag in BLOCKS):
            if block:
                for c in some:
                    yield from pieces(c)
            elif len(text := clean(" ".join(filter(None, (clean(c.flat() if c.tag else c.text) for c in some))))) >= RUN:
                yield "paragraph", text, 0
        return
    if len(text := form.text(n)) >= form.least:
        yield form.kind, text, int(n.tag[1]) if form.kind == "heading" else 0
    for c in n.children if form.inside else ():
        yield from pieces(c)


def blocks_of(nodes: list[Node]) -> list[Block]:
    """The pieces under the headings that they stand below."""
    outline, out = _Outline(), []
    for kind, text, level in (x for n in nodes for x in pieces(n)):
        out.append(Block(kind, text, level, outline.enter(level, text) if level else outline.path))
    return out


def _first_of_each(blocks: list[Block]) -> list[Block]:
    return list({b.text.lower()[:160]: b for b in reversed(blocks) if b.text}.values())[::-1]


#: What marks a block at the head of a page as furniture: the kinds that a mark holds for, and the mark.
PROSE = ("paragraph", "quote")
FURNITURE = (
    (("list_item",), lambda t: len(t) < 200),
    (PROSE, lambda t: _has(t.lower(), INTERFACE)),
    (PROSE, lambda t: len(t) < 120 and not re.search(r"\. |[.?!]\Z", t)),
    (PROSE, lambda t: t.count(" ") >= 7 and sum(map(t.__contains__, LANGUAGES)) >= 3),
    (PROSE, lambda t: t.count(" ") >= 24 and not re.search(r"\. |\.\Z", t)),
)


def trim_head(blocks: list[Block]) -> list[Block]:
    """Without up to six blocks of furniture in front, where enough remains."""
    if len(blocks) <= 3:
        return blocks
    head = blocks[: min(len(blocks) - 2, 6)]
    lead = sum(1 for _ in takewhile(lambda b: any(b.kind in kinds and mark(b.text) for kinds, mark in FURNITURE), head))
    length = np.array([len(b.text) for b in blocks])
    return blocks[lead:] if length[lead:].sum() >= max(200, 0.3 * length.sum()) else blocks


def trim_tail(blocks: list[Block]) -> list[Block]:
    """Without the run of footers and neighbouring tiny blocks that ends a page; the first four stay, the fifth unless a footer."""
    flags = lambda of: np.array([of(b) for b in blocks], bool)
    footer = flags(lambda b: _has(b.text.lower(), FOOTERS))
    tiny = flags(lambda b: len(b.text) < 90 and b.kind in ("paragraph", "list_item"))
    after_either = np.append(False, (footer | tiny)[:-1])[: len(blocks)]
    place = np.arange(len(blocks))
    ends = (place >= 4) & (footer | (tiny & after_either & (place >= 5)))
    return blocks[: int(np.flatnonzero(~ends)[-1]) + 1] if blocks else blocks


@dataclass
class Page:
    meta: dict[str, str | None]
    blocks: list[Block]
    problem: str | None


def extract(html: str, least: int = 80) -> Page:
    """Metadata and blocks of a page. With less than ``least`` characters of text in the chosen container
    the whole body is tried; still less is a problem, not an error."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    tree.root.measure()

    def written(node: Node) -> list[Block]:
        return trim_tail(trim_head(_first_of_each(blocks_of([node] if node.tag != "document" else node.children))))

    size = lambda bs: sum(len(b.text) for b in bs)
    blocks = written(select(tree.root))
    if size(blocks) < least:
        blocks = max(blocks, written(tree.root), key=size)
    return Page(_metadata(tree), blocks, None if size(blocks) >= least else "too little text")


def extract_or_say(html: str | None) -> Page:
    """``extract``, but a page that can't be read is a problem of its own row."""
    try:
        return extract(html or "")
    except Exception as e:  # noqa: BLE001 - whatever a page does to the parser, other pages go on
        return Page(dict.fromkeys(META_FIELDS), [], f"unreadable page: {type(e).__name__}")


META_FIELDS = ("title", "author", "site_name", "description", "canonical", "published", "language")
SCHEMA = "page_id long, " + ", ".join(f"{m} string" for m in META_FIELDS) + ", problem string, blocks array<struct<kind:string,text:string,level:int,heading_path:string>>"


def with_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each page: its metadata, problem and blocks. Null html counts as empty."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("heading_path", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                found = [extract_or_say(h) for h in some.column(1).to_pylist()]
                meta = [pa.array([p.meta[m] for p in found], pa.string()) for m in META_FIELDS]
                blocks = pa.array([[vars(b) for b in p.blocks] for p in found], kind)
                yield pa.RecordBatch.from_arrays([some.column(0), *meta, pa.array([p.problem for p in found], pa.string()), blocks], names=["page_id", *META_FIELDS, "problem", "blocks"])

    return pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(run, SCHEMA)
