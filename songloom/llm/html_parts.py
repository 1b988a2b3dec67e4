"""An HTML page as a list of text blocks in a tree of elements."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

# Elements of HTML by how they take part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br button cite code data del dfn em font i img input ins kbd label "
    "mark q rp rt ruby s samp select small span strike strong sub sup time tt u var wbr".split()
)
IN_HEAD = frozenset("base link meta script style title noscript template".split())
CONTAINERS = frozenset("body div section article main td center".split())
DROPPED = frozenset(
    "head nav footer aside form script style title noscript template button select textarea iframe "
    "svg canvas object dialog menu audio video datalist noembed noframes xmp".split()
)
#: Words in classes, ids and roles of what isn't the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar toolbar cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended trending comment comments reply replies "
    "respond disqus discussion widget search pagination pager copyright contentinfo complementary "
    "header".split()
)
COMMENTS = frozenset("comment comments reply replies respond disqus discussion".split())
#: A class like ``has-sidebar`` says something else about its element.
_NOT_ABOUT = frozenset("no with without has is".split())
#: What an opening tag closes, up to the element that bounds it.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_BOUNDS = frozenset("article aside body div html main section table td th".split())

_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<bad_end>/)?(?P<bad>[a-zA-Z][^\s/>]*+)(?P<bad_rest>[^>]*+)>?|(?P<text>[^<]++|<)",
    re.DOTALL,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_OTHER = re.compile(r"[^a-z]+")
_NUMBER = re.compile(r"[0-9]{3,}")


def digest(text: str) -> int:
    """A signed 64-bit number of a text, the same in every process."""
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


@lru_cache(maxsize=4096)
def _path(parent: int, step: str) -> int:
    return digest(f"{parent}/{step}")


@lru_cache(maxsize=4096)
def _names(attributes: str) -> tuple[str, frozenset[str]]:
    """The attributes' part of a path, without long numbers, and the words that name its element."""
    signature, words = [], set()
    for key, *values in _NAMED.findall(attributes):
        for item in html.unescape("".join(values)).split():
            parts = [x for x in _OTHER.split(_CAMEL.sub("-", item).lower()) if x]
            signature.append(f"{key.lower()}={_NUMBER.sub('#', item)}")
            if parts and parts[0] not in _NOT_ABOUT:
                words.update(parts)
    return ",".join(sorted(signature)), frozenset(words)


@dataclass
class Block:
    """Text between two block boundaries, the element it lies in, and its characters in links."""

    text: str
    element: int
    linked: int


@dataclass
class Page:
    """Elements in page order (tag, parent, path, words that name it) and blocks of text.

    ``events`` has, in page order, (kind, number): 0 an element opens, 1 it closes, 2 a block.
    """

    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    paths: list[int] = field(default_factory=lambda: [0])
    names: list[frozenset[str]] = field(default_factory=lambda: [frozenset()])
    blocks: list[Block] = field(default_factory=list)
    events: list[tuple[int, int]] = field(default_factory=list)

    def block_token(self, block: Block) -> int:
        """A number for the text at its place in the tree, equal on pages that share it."""
        return digest(f"{self.paths[block.element]}/#{block.text}")


class _Builder:
    def __init__(self) -> None:
        self.page = Page()
        self.open = [0]  # elements from the root to the current one
        self.links = 0
        self.hidden = 0  # open inline elements that aren't text
        self.pieces: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                holder = self.holder()
                self.page.events.append((2, len(self.page.blocks)))
                self.page.blocks.append(Block(text, holder, self.linked))
            self.pieces, self.linked = [], 0

    def holder(self) -> int:
        tags = self.page.tags
        return next(e for e in reversed(self.open) if tags[e] not in INLINE)

    def text(self, chunk: str) -> None:
        if not self.hidden:
            self.pieces.append(html.unescape(chunk))
            if self.links:
                self.linked += len("".join(self.pieces[-1].split()))

    def pop_to(self, depth: int) -> None:
        """Close elements until ``depth`` are left open."""
        page = self.page
        while len(self.open) > depth:
            element = self.open[-1]
            tag = page.tags[element]
            if tag in INLINE:
                self.links -= tag == "a"
                self.hidden -= _hides(tag, page.names[element])
            else:
                self.flush()
                page.events.append((1, element))
            self.open.pop()

    def close_open(self, tags: set[str] | frozenset[str], bounds: frozenset[str] | set[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.page.tags[self.open[depth]]
            if tag in tags:
                self.pop_to(depth)
                return
            if tag in bounds:
                return

    def start(self, tag: str, attributes: str, closed: bool) -> None:
        page = self.page
        inline = tag in INLINE
        if not inline:
            self.flush()
            if tag not in IN_HEAD:
                self.close_open({"head"}, frozenset())
            self.close_open({"p"}, _BOUNDS)
            if tag in _CLOSES:
                self.close_open(*_CLOSES[tag])
            if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                self.close_open({"h1", "h2", "h3", "h4", "h5", "h6"}, _BOUNDS)
        elif tag == "br":
            self.text(" ")
        elif tag == "a":
            self.close_open({"a"}, _BOUNDS)
        if tag in VOID:
            return
        signature, names = _names(attributes) if attributes.strip() else ("", frozenset())
        parent = self.open[-1]
        path = page.paths[parent] if inline else _path(page.paths[self.holder()], f"{tag}[{signature}]")
        page.tags.append(tag)
        page.parents.append(parent)
        page.paths.append(path)
        page.names.append(names)
        element = len(page.tags) - 1
        self.open.append(element)
        if inline:
            self.links += tag == "a"
            self.hidden += _hides(tag, names)
        else:
            page.events.append((0, element))
        if closed and tag in ("svg", "canvas", "object"):
            self.pop_to(len(self.open) - 1)

    def end(self, tag: str) -> None:
        tags = self.page.tags
        for depth in range(len(self.open) - 1, 0, -1):
            here = tags[self.open[depth]]
            if here == tag:
                self.pop_to(depth)
                return
            if tag in INLINE and here not in INLINE:
                return  # a block begins inside the inline element, which goes on there


@lru_cache(maxsize=4096)
def _hides(tag: str, names: frozenset[str]) -> bool:
    return tag in DROPPED or bool(names & NAMES)


def parse(source: str | None) -> Page:
    """Elements and text blocks of a page. Comments, scripts, styles and the like leave no text.

    Unclosed paragraphs, list items and cells end where HTML ends them; unknown end tags and broken
    markup are passed over. A page cut off in the middle has what came before.
    """
    builder = _Builder()
    at, source = 0, source or ""
    while at < len(source):
        part = _PART.match(source, at)
        at = part.end()
        chunk = part["text"]
        if chunk is not None:
            builder.text(chunk)
            continue
        tag = part["tag"] or part["bad"]
        if tag is None:
            continue
        tag = tag.lower()
        if part["end"] or part["bad_end"]:
            builder.end(tag)
            continue
        rest = part["rest"] or part["bad_rest"] or ""
        if tag in RAW:
            ended = re.compile(f"</{re.escape(tag)}[\\s/>]", re.IGNORECASE).search(source, at)
            at = len(source) if ended is None else ended.start()
            builder.start(tag, rest, False)
            builder.end(tag)
        else:
            builder.start(tag, rest, rest.rstrip().endswith("/"))
    builder.pop_to(1)
    builder.flush()
    return builder.page


@dataclass
class Roles:
    """Of every element: whether it, or one around it, isn't the article; the outermost article or
    main part around it (or -1); and its characters of text."""

    dropped: list[bool]
    article: list[int]
    chars: list[int]


def roles(page: Page) -> Roles:
    n = len(page.tags)
    own = [0] * n
    for block in page.blocks:
        own[block.element] += len(block.text)
    chars = own[:]
    wraps = [0] * n  # articles and main parts inside
    is_article = [
        tag in ("article", "main") and not names & COMMENTS
        for tag, names in zip(page.tags, page.names)
    ]
    for element in range(n - 1, 0, -1):
        parent = page.parents[element]
        chars[parent] += chars[element]
        wraps[parent] += wraps[element] + is_article[element]
    dropped, article = [False] * n, [-1] * n
    for element in range(1, n):
        parent, tag, names = page.parents[element], page.tags[element], page.names[element]
        article[element] = article[parent]
        if article[parent] < 0 and is_article[element] and not dropped[parent]:
            article[element] = element
        if dropped[parent]:
            dropped[element] = True
        elif tag in ("html", "body"):
            continue
        elif names & COMMENTS and (article[element] >= 0 or wraps[element] < wraps[0] or not wraps[0]):
            dropped[element] = True
        elif wraps[element]:
            continue
        elif tag in DROPPED:
            dropped[element] = True
        elif is_article[element]:
            continue
        elif tag == "header" or "header" in names and not names - {"header"} & NAMES:
            # an article's own header holds its title
            dropped[element] = article[element] < 0 and not names & {"article", "entry", "post", "story"}
        elif names & NAMES:
            dropped[element] = 5 * chars[element] < 3 * chars[0]
    return Roles(dropped, article, chars)
