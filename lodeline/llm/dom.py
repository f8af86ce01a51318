"""A small tree of an HTML page: elements, their attributes, and their text in page order.

Tags that were left open are closed as a browser would for blocks: an opening
block ends an open paragraph, an item ends the item before, and so on. An end tag
without its element is passed over, a quote without its partner is an ordinary
character, and a tag that never ends is text. The work grows with the length of
the page, whatever is left open: each stretch is searched once for the end of a
tag, and what a tag would close is known without a walk up the tree. Scripts, styles, templates, frames and
comments are no text; formulas are text of the element they stand in, and
graphics and players are elements like others.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

_OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_TAG_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_TAG_STOP = re.compile(r"[>\"']")
_LONG_NUMBER = re.compile(r"&#0*+[1-9][0-9]{9,};?")
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

# Fixed values of the HTML standard: elements without content, with raw content,
# those that stand inside a line, and which open elements a start tag ends.
# MathML inside ``math`` and shapes of SVG make no elements; some part texts.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe".split())
MATH_PARTS = set("annotation annotation-xml mlabeledtr mtable mtd mtr".split())
PASSED = MATH_PARTS | set(
    "maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics"
    " circle clippath defs ellipse filter g line lineargradient marker mask path pattern polygon polyline radialgradient rect stop symbol use".split()
)
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tspan tt u var wbr".split()
)
PARAGRAPH_ENDS = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
# What a start tag ends: the nearest open element of the first, unless one of the second is nearer.
_GROUPS = [({"p"}, {"button", "table", "td", "th"}), *((ENDS[t], SCOPES[t]) for t in ("li", "dt", "tr", "td", "option"))]
_GROUP_OF = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
_GROUP_TAGS = set().union(*(tags | scope for tags, scope in _GROUPS))
# Attribute that marks content in pages made for training; no feature.
MARK = "data-c"
# Standing attributes whose words describe an element.
DESCRIBING = ("class", "id", "role", "itemprop", "aria-label")


@dataclass
class Node:
    """An element; its tokens are the words of its describing attributes.

    ``marked`` tells of the attribute that pages made for training carry.
    """

    tag: str
    parent: int
    depth: int
    tokens: set[str] = field(default_factory=set)
    link: bool = False
    marked: bool = False


@dataclass
class Tree:
    """Nodes in page order, and pieces of text as (node, text); a null text is a line break."""

    nodes: list[Node]
    pieces: list[tuple[int, str | None]]


def attribute_words(text: str) -> tuple[set[str], bool, bool]:
    """Words of the describing attributes, lower case, whether there is a link, and whether it is marked."""
    words: set[str] = set()
    link = marked = False
    for name, a, b, c in _ATTRIBUTE.findall(text):
        name = name.lower()
        if name in DESCRIBING:
            words.update(w.lower() for w in _NAME_PART.findall(unescape(a or b or c)))
        elif name == "href":
            link = True
        elif name == MARK:
            marked = True
        elif name in ("hidden", "aria-hidden") and (a or b or c).lower() != "false":
            words.add("hidden")
    return words, link, marked


def decoded(text: str) -> str:
    """Text with its character references decoded; a number beyond all characters is the replacement character."""
    if "&#" in text:
        text = _LONG_NUMBER.sub("\ufffd", text)
    return unescape(text)


class TagEnds:
    """Finds the ``>`` of tags, outside paired quotes, in one page.

    A search that reaches the end of the page marks the stretches outside quotes
    that it went through, and a later search that enters one of them ends there.
    """

    def __init__(self, html: str) -> None:
        self.html = html
        self.last = html.rfind(">")
        self.paired = True  # until a tag does not end by the pattern
        self.dead: bytearray | None = None

    def after(self, at: int) -> int:
        """Place of the ``>`` of a tag whose name ends at ``at``, or -1."""
        html, stretches = self.html, []
        if self.paired:
            whole = _TAG_REST.match(html, at) if at <= self.last else None
            if whole:
                return whole.end() - 1
            self.paired = False
        while at <= self.last and not (self.dead and self.dead[at]):
            end = _TAG_STOP.search(html, at).start()
            met = self.dead is not None and self.dead.find(1, at, end + 1) >= 0
            if html[end] == ">" and not met:
                return end
            stretches.append((at, end + 1))
            if met:
                break
            partner = html.find(html[end], end + 1)
            at = (partner if partner >= 0 else end) + 1
        if self.dead is None:
            self.dead = bytearray(len(html) + 1)
        for start, end in stretches:
            self.dead[start:end] = b"\1" * (end - start)
        return -1


class OpenElements:
    """The open elements, innermost last, and for each what a tag inside it would close."""

    def __init__(self) -> None:
        self.nodes = [0]
        self.tags = ["#page"]
        self.places: dict[str, list[int]] = {}
        self.targets = [(0,) * len(_GROUPS)]
        self.block = [0]

    def push(self, node: int, tag: str) -> None:
        place, targets = len(self.nodes), self.targets[-1]
        if tag in _GROUP_TAGS:
            targets = tuple(place if tag in tags else 0 if tag in scope else old for old, (tags, scope) in zip(targets, _GROUPS))
        self.nodes.append(node)
        self.tags.append(tag)
        self.targets.append(targets)
        self.block.append(self.block[-1] if tag in INLINE else place)
        self.places.setdefault(tag, []).append(place)

    def cut(self, place: int) -> None:
        for tag in self.tags[place:]:
            self.places[tag].pop()
        for row in (self.nodes, self.tags, self.targets, self.block):
            del row[place:]

    def end_group(self, group: int) -> None:
        place = self.targets[-1][group]
        if place:
            self.cut(place)

    def end_tag(self, tag: str) -> None:
        """Close the nearest element of that name; one inside a line does not close a block."""
        places = self.places.get(tag)
        if places and (tag not in INLINE or places[-1] > self.block[-1]):
            self.cut(places[-1])


def parse(html: str) -> Tree:
    """The tree of a page; node 0 stands for the page itself."""
    nodes = [Node("#page", -1, 0)]
    pieces: list[tuple[int, str | None]] = []
    opened, ends = OpenElements(), TagEnds(html)
    at = told = 0  # text before ``told`` is in the pieces

    def tell(upto: int) -> None:
        if upto > told:
            pieces.append((opened.nodes[-1], html[told:upto]))

    while True:
        found = _OPENING.search(html, at)
        if not found:
            break
        start, at = found.span()
        if found[2] is None:
            if html.startswith("<!--", start):
                end = html.find("-->", at) + 2
                end = len(html) - 1 if end == 1 else end
            else:
                end = html.find(">", at) if at <= ends.last else -1
            if end < 0:
                continue
            tell(start)
            at = told = end + 1
            continue
        end = ends.after(at)
        if end < 0:
            continue
        tell(start)
        tag, inner = found[2].lower(), html[at:end]
        at = told = end + 1
        empty = inner.endswith("/")
        if tag in PASSED:
            if tag in MATH_PARTS:
                pieces.append((opened.nodes[-1], None))
            continue
        if found[1]:
            if tag == "br":
                pieces.append((opened.nodes[-1], None))
            opened.end_tag(tag)
            continue
        if tag in RAW and not empty:
            at = told = re.compile(rf"</{re.escape(tag)}\s*+>|\Z", re.I).search(html, at).end()
            continue
        if tag == "br":
            pieces.append((opened.nodes[-1], None))
            continue
        if tag in PARAGRAPH_ENDS:
            opened.end_group(0)
        if tag in _GROUP_OF:
            opened.end_group(_GROUP_OF[tag])
        if tag not in INLINE:
            pieces.append((opened.nodes[-1], None))
        words, link, marked = attribute_words(inner) if inner else (set(), False, False)
        nodes.append(Node(tag, opened.nodes[-1], len(opened.nodes), words, link, marked))
        if tag in ("title", "textarea") and not (empty and opened.places.get("svg")):
            end = re.compile(rf"</{tag}\s*+>|\Z", re.I).search(html, at)
            pieces.append((len(nodes) - 1, html[at : end.start()]))
            at = told = end.end()
        elif tag not in VOID and not empty:
            opened.push(len(nodes) - 1, tag)
    tell(len(html))
    return Tree(nodes, pieces)


def blocks_of(tree: Tree) -> list[int]:
    """For every node the nearest node that is no inline element, itself included."""
    own = [0] * len(tree.nodes)
    for i, node in enumerate(tree.nodes):
        own[i] = own[node.parent] if i and node.tag in INLINE else i
    return own


def block_text(tree: Tree, kept: list[bool]) -> str:
    """Text of the kept nodes: one space for white space inside a block, and between blocks."""
    blocks: list[str] = []
    line: list[str] = []
    block_of, owner = blocks_of(tree), -1

    def flush() -> None:
        joined = " ".join("".join(line).split())
        if joined:
            blocks.append(joined)
        line.clear()

    for node, text in tree.pieces:
        if text is None or block_of[node] != owner:
            flush()
            owner = block_of[node]
        if text is not None and kept[node]:
            line.append(decoded(text))
    flush()
    return " ".join(blocks)
