"""A page as a tree of elements, as far as extraction needs it, and its blocks of text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z-]+)")

#: Fixed values of HTML: elements without content, with raw text, and those that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: A start tag that ends an open element of the same kind, searched up to the container named.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_ROOT = 0
#: Numeric references that may be too long for a number.
_LONG = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9a-fA-F]{8,}));?")


@dataclass(slots=True)
class Node:
    tag: str
    path: int  # digest of the tags and classes from the root to here
    parent: Node | None
    attributes: dict[str, str]
    depth: int
    style: int = 0  # digest of the children's tags in order
    block: Node = field(init=False)  # the nearest block element, itself included; the root if none

    def __post_init__(self) -> None:
        self.block = self if self.parent is None or self.tag in BLOCK else self.parent.block


@dataclass(slots=True)
class Block:
    node: Node  # the nearest block element
    parts: list[str] = field(default_factory=list)
    chars: int = 0
    link_chars: int = 0

    def text(self) -> str:
        return " ".join(unescaped("".join(self.parts)).split())


def unescaped(text: str) -> str:
    """Character references resolved; a number beyond all code points, however long, is U+FFFD."""

    def shorter(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0") or "0"
        return "\ufffd" if len(digits) > 7 else f"&#{'' if m[1] else 'x'}{digits};"

    return html.unescape(_LONG.sub(shorter, text))


def _attributes(source: str) -> dict[str, str]:
    return {
        (m[1] or m[5]).lower(): unescaped(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)
    } if source.strip(" /\n\t") else {}


def _digest(text: str, before: int) -> int:
    return xxhash.xxh64_intdigest(text, before)


def parse(source: str) -> list[Block]:
    """The blocks of text of a page in its order; elements with raw text are left out.

    End tags close what is open inside their element; those without a start are ignored.
    """
    node = Node("", _ROOT, None, {}, 0)
    open_tags: dict[str, list[Node]] = {}  # open elements of each kind, the innermost last
    blocks: list[Block] = []
    block: Block | None = None
    links = at = 0

    def leave(until: Node) -> None:
        nonlocal node, links
        while node is not until:
            open_tags[node.tag].pop()
            links -= node.tag == "a"
            node = node.parent

    def innermost(tags: tuple[str, ...]) -> Node | None:
        return max((open_tags[t][-1] for t in tags if open_tags.get(t)), key=lambda n: n.depth, default=None)

    def text(part: str) -> None:
        nonlocal block
        if not part:
            return
        if block is None:
            if part.isspace():
                return
            block = Block(node.block)
            blocks.append(block)
        block.parts.append(part)
        size = len(part.strip())
        block.chars += size
        if links:
            block.link_chars += size

    for m in iter(lambda: _TOKEN.search(source, at), None):
        text(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag in BLOCK:
                block = None
            if open_tags.get(tag):
                leave(open_tags[tag][-1].parent)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag == "br" or tag == "wbr":
            text(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            block = None
            if open_tags.get("p"):
                leave(open_tags["p"][-1].parent)
            closes, container = IMPLIED_END.get(tag, ((), ()))
            ended, around = innermost(closes), innermost(container)
            if ended is not None and (around is None or ended.depth > around.depth):
                leave(ended.parent)
        node.style = _digest(tag, node.style)
        if tag in VOID:
            continue
        attributes = _attributes(m["attributes"])
        name = f"{tag}.{'.'.join(attributes.get('class', '').lower().split())}"
        node = Node(tag, _digest(name, node.path), node, attributes, node.depth + 1)
        open_tags.setdefault(tag, []).append(node)
        links += tag == "a"
    text(source[at:])
    return blocks
