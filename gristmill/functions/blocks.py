"""Structured documents (TEI XML, HTML) as rows of categorised text blocks."""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import CONTAINER_REASONS, EXCLUDED_ATTRS, EXCLUDED_TITLES, SIDEBAR, SUPPLEMENTARY_ATTRS, SUPPLEMENTARY_TITLES, TEXT_REASONS

BLOCKS = "ordinal long, kind string, text string, category string, reason string, level int, section_path array<string>, source_tag string, source_type string, coords string, warnings array<string>, body_chars long, error string"

# ---- fixed values ------------------------------------------------------------------------

INLINE_SKIPPED = frozenset({"figure", "table", "graphic", "figDesc", "fw", "note", "listBibl", "biblStruct"})
LEAF_EXCLUDED = frozenset({"table", "graphic", "figDesc", "fw", "listBibl", "biblStruct"})
VOID_TAGS = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
CLOSES_P = frozenset({"p", "ul", "ol", "table", "div", "section", "article", "blockquote", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "form", "nav", "header", "footer", "aside", "main", "hr"})
#: What HTML elements stand for among the TEI roles.
HTML_ROLES = {
    **{f"h{i}": "head" for i in range(1, 7)},
    **dict.fromkeys(("section", "article", "main", "div"), "div"),
    **dict.fromkeys(("p", "pre"), "p"),
    **dict.fromkeys(("ul", "ol"), "list"),
    **dict.fromkeys(("nav", "header", "footer", "script", "style", "noscript", "form"), "fw"),
    "li": "item",
    "blockquote": "quote",
    "aside": "note",
    "img": "graphic",
    "br": "lb",
}

_ZERO = re.compile("[­​‌‍﻿]")
_BEFORE = re.compile(r"\s+([,.;:!?%)\]}])")
_AFTER = re.compile(r"([(\[{])\s+")
_PUBLISHER = (re.compile(r"Contents lists available at.*?journal homepage:\s*(?:https?://)?\S+", re.I), re.compile(r"©\s*\d{4}.*?all rights reserved\.?", re.I))
_WORDS = re.compile(r"\w+")
_CAPTION = re.compile(r"(?:figure|fig\.?|table|scheme|chart|plate)\s+(?:\d+|[ivxlcdm]+)[\s.:)-]", re.I)
_CREDITS = ("photo credit", "image credit", "figure credit", "data from")
_NOISE = ("all rights reserved", "journal homepage", "available online", "contents lists available")
_FOOTER = re.compile(r".{0,100}\b(?:vol\.?|volume)\s*\d+.*\b(?:no\.?|issue)\s*\d+.*\b\d{1,4}", re.I)
_DOI = re.compile(r"(?:https?://)?doi\.org/\S+")
_DEFINITION = re.compile(r"(?:^|[.;]\s+)[A-Z][A-Za-z0-9 ()/\-]{1,70}:")
_YEAR = re.compile(r"\b(?:19|20)\d{2}\b")
_SIDEBAR = re.compile(SIDEBAR)
#: The attributes of a container that tell its kind.
KIND_ATTRS = ("type", "subtype", "place", "rend")


@dataclass(slots=True, eq=False)
class Node:
    """An element by its role; `parts` has strings and nodes in document order."""

    role: str
    attrs: dict[str, str] = field(default_factory=dict)
    parts: list[str | Node] = field(default_factory=list)

    @property
    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]

    def find(self, *path: str) -> Node | None:
        """The element at the end of a path of roles, at any depth; an element's children go before those below them."""
        todo = [self]
        while todo:
            below = []
            for child in todo.pop().children:
                if child.role != path[0]:
                    below.append(child)
                elif found := child.find(*path[1:]) if len(path) > 1 else child:
                    return found
            todo += reversed(below)
        return None


# ------------------------------------------------------------------------------- parsing
# A document is a run of events, start(role, attrs), data(text) and end(), however deep it is: nothing
# here calls itself for an element inside an element.


class Builder:
    """Events to a tree."""

    def __init__(self):
        self.top = Node("")
        self.open = [self.top]

    def start(self, role: str, attrs: dict[str, str]) -> None:
        node = Node(role, attrs)
        self.open[-1].parts.append(node)
        self.open.append(node)

    def data(self, text: str) -> None:
        self.open[-1].parts.append(text)

    def end(self) -> None:
        self.open.pop()


class _Local:
    """Events of an XML parser by local names, a text node at a time."""

    def __init__(self, *targets):
        self.targets, self.names, self.text = targets, {}, []

    def _local(self, name: str) -> str:
        found = self.names.get(name)
        if found is None:
            found = self.names[name] = name.rpartition("}")[2]
        return found

    def _flush(self) -> None:
        if self.text:
            text = "".join(self.text)
            self.text = []
            for t in self.targets:
                t.data(text)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        self._flush()
        role, own = self._local(tag), {self._local(k): v for k, v in attrs.items()}
        for t in self.targets:
            t.start(role, own)

    def data(self, text: str) -> None:
        self.text.append(text)

    def end(self, tag: str) -> None:
        self._flush()
        for t in self.targets:
            t.end()

    def close(self) -> None:
        return None


#: Characters that are given to the parser at a time.
PIECE = 1 << 16


def xml_events(source: str, *targets) -> Iterator[None]:
    """Give an XML document's events to targets, a piece of it each step; a syntax error is a ValueError."""
    parser = ET.XMLParser(target=_Local(*targets))
    try:
        for at in range(0, max(len(source), 1), PIECE):
            parser.feed(source[at : at + PIECE])
            yield
        parser.close()
        yield
    except ET.ParseError as error:
        raise ValueError(f"invalid XML: {error}") from None


def tree_events(root: Node, *targets) -> Iterator[None]:
    """The same for a tree."""
    todo: list[Node | str | None] = [root]
    while todo:
        part = todo.pop()
        for t in targets:
            if part is None:
                t.end()
            elif isinstance(part, str):
                t.data(part)
            else:
                t.start(part.role, part.attrs)
        if isinstance(part, Node):
            todo.append(None)
            todo += reversed(part.parts)
        yield


def parse_xml(source: str) -> Node:
    """The tree of an XML document, by local names; a syntax error is a ValueError."""
    made = Builder()
    for _ in xml_events(source, made):
        pass
    return made.top.parts[0]


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open: list[tuple[str, Node]] = [("", self.root)]

    def handle_starttag(self, tag, attrs):
        if self.open[-1][0] == "p" and tag in CLOSES_P or tag == "li" and self.open[-1][0] == "li":
            self.open.pop()
        node = Node(HTML_ROLES.get(tag, tag), {k: v or "" for k, v in attrs})
        if tag == "ol":
            node.attrs["type"] = "ordered"
        node.attrs.setdefault("rend", " ".join(filter(None, (node.attrs.get("class"), node.attrs.get("id")))))
        self.open[-1][1].parts.append(node)
        if tag not in VOID_TAGS:
            self.open.append((tag, node))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1][1].parts.append(data)


def parse_html(source: str) -> Node:
    """The tree of an HTML page; elements left open end with their parents."""
    parser = _Html()
    parser.feed(source)
    parser.close()
    return parser.root


# ---------------------------------------------------------------------------------- text


def normalize(text: str) -> str:
    text = " ".join(_ZERO.sub("", unicodedata.normalize("NFKC", text)).split())
    for pattern in _PUBLISHER:
        text = pattern.sub(" ", text)
    return " ".join(_AFTER.sub(r"\1", _BEFORE.sub(r"\1", text)).split())


def fold(text: str) -> str:
    return " ".join(_WORDS.findall(unicodedata.normalize("NFKC", text).casefold()))


class Text:
    """The text of an element from its events, without what is set apart; each level is normalised by itself.

    Levels are a stack. A level that has nothing but the one inside it has its text, which is not
    normalised again once that leaves it as it is.
    """

    def __init__(self):
        self.levels: list[tuple[str, list[str]]] = [("", [])]
        self.skipped, self.stable = 0, ""

    def start(self, role: str, attrs: dict[str, str]) -> None:
        if self.skipped or role in INLINE_SKIPPED or role == "ref" and attrs.get("type", "").lower() == "bibr":
            self.skipped += 1
        elif role == "lb":
            self.levels[-1][1].append(" ")
            self.skipped = 1
        else:
            self.levels.append((role, []))

    def data(self, text: str) -> None:
        if not self.skipped:
            self.levels[-1][1].append(text)

    def _normal(self, parts: list[str]) -> str:
        text = "".join(parts)
        if text == self.stable:
            return text
        found = normalize(text)
        if found == text:
            self.stable = text
        return found

    def end(self) -> None:
        if self.skipped:
            self.skipped -= 1
            return
        role, parts = self.levels.pop()
        inner = self._normal(parts)
        if inner:
            self.levels[-1][1].append(inner + " " if role == "s" else inner)

    def text(self) -> str:
        return self._normal(self.levels[0][1])


def node_text(node: Node) -> str:
    """The text of a tree's root, as `Text` has it."""
    found = Text()
    for part in node.parts:
        if isinstance(part, str):
            found.data(part)
        else:
            for _ in tree_events(part, found):
                pass
    return found.text()


def numeric_share(text: str) -> float:
    tokens = text.split()
    return sum(any(c.isdigit() for c in t) for t in tokens) / len(tokens) if tokens else 0.0


def warnings_of(text: str) -> list[str]:
    """What should be looked at in a block of text."""
    n, sidebar = len(_WORDS.findall(text)), _SIDEBAR.search(text)
    found = {
        "very_long_block": n >= 1200,
        "missing_terminal_punctuation": n >= 80 and not text.endswith((".", "!", "?", ";", ":")),
        "high_numeric_density": numeric_share(text) >= 0.25,
        "possible_embedded_sidebar": sidebar is not None and sidebar.start() > 30,
    }
    return [w for w, holds in found.items() if holds]


def is_noise(text: str, n: int, low: str) -> bool:
    return bool(not text or text.isdigit() and len(text) <= 4 or _FOOTER.fullmatch(text) or _DOI.fullmatch(text) or n <= 45 and any(m in low for m in _NOISE))


def classify(text: str, parent: str) -> tuple[str, str]:
    """Category and reason of a block's text under its parent's category; the first rule that holds."""
    n, low, colons = len(_WORDS.findall(text)), text.casefold(), text.count(":")
    rules = (
        ("discard", lambda: parent == "discard"),
        ("discard", lambda: is_noise(text, n, low)),
        ("discard", lambda: _CAPTION.match(text) or n <= 160 and any(m in low for m in _CREDITS)),
        ("discard", lambda: n <= 140 and len(_YEAR.findall(text)) >= 4 and numeric_share(text) >= 0.30),
        ("supplementary", lambda: parent == "supplementary"),
        ("supplementary", lambda: len(_DEFINITION.findall(text)) >= 3 or colons >= 4 and colons / max(n, 1) >= 0.02),
        ("supplementary", lambda: text.count("?") >= 3 and n <= 700),
        ("main", lambda: True),
    )
    return next((category, reason) for (category, holds), reason in zip(rules, TEXT_REASONS, strict=True) if holds())


def excluded_title(heading: str) -> bool:
    h = fold(heading)
    return any(h == t or h.startswith(t + " ") for t in EXCLUDED_TITLES)


def supplementary_title(heading: str) -> bool:
    h = fold(heading)
    return h.startswith(("box ", "case study ")) or h in SUPPLEMENTARY_TITLES


def kind_attrs(attrs: dict[str, str]) -> str:
    return fold(" ".join(attrs.get(k, "") for k in KIND_ATTRS))


def container_class(heading: str, attrs: str, parent: str) -> tuple[str, str]:
    """Category and reason of a container by its first heading, then its attributes (both folded), else its parent's."""
    rules = (
        ("discard", any(heading == t or heading.startswith(t + " ") for t in EXCLUDED_TITLES)),
        ("discard", any(m in attrs for m in EXCLUDED_ATTRS)),
        ("supplementary", heading.startswith(("box ", "case study "))),
        ("supplementary", heading in SUPPLEMENTARY_TITLES),
        ("supplementary", any(m in attrs for m in SUPPLEMENTARY_ATTRS)),
        (parent, True),
    )
    return next((category, reason) for (category, holds), reason in zip(rules, CONTAINER_REASONS, strict=True) if holds)


# ---------------------------------------------------------------------------------- walk


class Outline:
    """What has to be known before a document is walked; elements are numbered as they begin.

    inner: which elements have elements inside; headings: each one's first heading, folded; bodies: the size of
    the text of each outermost body; shape: the text and body elements and what holds them; front: the header and
    front matter, as trees.
    """

    def __init__(self, html: bool = False):
        self.html, self.inner, self.headings, self.bodies = html, bytearray(), {}, {}
        self.shape, self.front = Node("", {"at": -1}), Node("")
        self.open: list[Node] = [self.shape]
        self.heading: tuple[int, int, Text] | None = None  # of which element, at which depth
        self.body: tuple[int, int, list[str]] | None = None
        self.tree: tuple[int, Builder] | None = None

    def start(self, role: str, attrs: dict[str, str]) -> None:
        at, depth, above = len(self.inner), len(self.open), self.open[-1]
        self.inner.append(0)
        if depth > 1:
            self.inner[above.attrs["at"]] = 1
        if self.heading:
            self.heading[2].start(role, attrs)
        elif role == "head" and above.attrs["at"] not in self.headings:
            self.heading = above.attrs["at"], depth, Text()
        if role == "body" and not self.body:
            self.body = at, depth, []
        if self.tree:
            self.tree[1].start(role, attrs)
        elif not self.html and (role == "teiHeader" or role == "front" and above.role == "text" and depth > 2):
            self.tree = depth, Builder()
            if role == "front":
                self.tree[1].start("text", {})
            self.tree[1].start(role, attrs)
        self.open.append(Node(role, {"at": at}))

    def data(self, text: str) -> None:
        if self.heading:
            self.heading[2].data(text)
        if self.body:
            self.body[2].append(text)
        if self.tree:
            self.tree[1].data(text)

    def end(self) -> None:
        node, depth = self.open.pop(), len(self.open)
        if self.heading and self.heading[1] == depth:
            self.headings[self.heading[0]] = fold(self.heading[2].text())
            self.heading = None
        elif self.heading:
            self.heading[2].end()
        if self.body and self.body[1] == depth:
            self.bodies[self.body[0]] = len(normalize(" ".join(self.body[2])))
            self.body = None
        if self.tree:
            self.tree[1].end()
            if self.tree[0] == depth:
                self.front.parts += self.tree[1].top.parts
                self.tree = None
        if node.role in ("text", "body") or node.parts:  # all others are of no use to `body_at`
            self.open[-1].parts.append(node)

    def body_at(self) -> int | None:
        root = self.shape.children
        found = root[0].find(*(("body",) if self.html else ("text", "body"))) if root else None
        return found.attrs["at"] if found else None


@dataclass(slots=True)
class Place:
    """Where a walk stands: category, heading level, headings above."""

    category: str
    level: int
    path: tuple[str, ...]

    def deeper(self, category: str | None = None) -> Place:
        return Place(category or self.category, min(self.level + 1, 6), self.path)


@dataclass(slots=True)
class Container:
    """An element whose children are walked, where it stands, and where its next child does."""

    number: int
    attrs: str
    at: Place
    here: Place
    items: int | None = None  # of a list, so far
    ordered: bool = False


#: Blocks of running text by role, and roles that are set apart.
FLOWS = {"p": "paragraph", "ab": "paragraph", "quote": "quote", "formula": "formula"}


def _block(role: str, attrs: dict[str, str], kind: str, text: str, category: str, reason: str, at: Place) -> dict:
    return {"kind": kind, "text": text, "category": category, "reason": reason, "level": at.level, "section_path": list(at.path), "source_tag": role, "source_type": attrs.get("type", ""), "coords": attrs.get("coords", ""), "warnings": []}


class Walk:
    """A body's events to its blocks, in document order; `out` has those that are complete.

    Open containers are a stack, and the text of one block is collected at a time.
    """

    def __init__(self, outline: Outline, body: int):
        self.outline, self.body, self.number = outline, body, -1
        self.open: list[Container] = []
        self.text: Text | None = None
        self.inside, self.ignored, self.finish = 0, 0, None
        self.out: list[dict] = []

    def _class(self, number: int, attrs: str, parent: str) -> tuple[str, str]:
        return container_class(self.outline.headings.get(number, ""), attrs, parent)

    def _collect(self, finish) -> None:
        """Gather the text of the element that has begun; `finish` gets it."""
        self.text, self.inside, self.finish = Text(), 0, finish

    def _enter(self, role: str, attrs: dict[str, str], at: Place) -> None:
        folded = kind_attrs(attrs)
        category, reason = self._class(self.number, folded, at.category)
        if category == "discard":
            self._set_apart(role, attrs, "container", reason, at)
        else:
            self.open.append(Container(self.number, folded, at, Place(category, at.level, at.path)))

    def _set_apart(self, role: str, attrs: dict[str, str], kind: str, reason: str, at: Place) -> None:
        self._collect(lambda text: self.out.append(_block(role, attrs, kind, text, "discard", reason, at)))

    def _flow(self, role: str, attrs: dict[str, str], kind: str, at: Place, prefix: str = "") -> None:
        def finish(text: str) -> None:
            whole = prefix + text
            self.out.append(_block(role, attrs, kind, whole, *classify(whole, at.category), at) | {"warnings": warnings_of(whole)})

        self._collect(finish)

    def _head(self, role: str, attrs: dict[str, str], of: Container) -> None:
        def finish(text: str) -> None:
            if excluded_title(text):
                of.here = Place("discard", of.at.level, of.here.path)
                return
            kind, why = ("supplementary", "supplementary_heading") if supplementary_title(text) else self._class(of.number, of.attrs, of.here.category)
            of.here = Place(kind, of.at.level, (*of.at.path, text))
            self.out.append(_block(role, attrs, "heading", text, kind, why, Place(kind, min(max(of.at.level, 2), 6), of.here.path)))

        self._collect(finish)

    def start(self, role: str, attrs: dict[str, str]) -> None:
        self.number += 1
        if self.ignored:
            self.ignored += 1
        elif self.text:
            self.inside += 1
            self.text.start(role, attrs)
        elif self.open:
            self._child(role, attrs, self.open[-1])
        elif self.number == self.body:
            self._enter(role, attrs, Place("main", 2, ()))

    def _child(self, role: str, attrs: dict[str, str], of: Container) -> None:
        here = of.here
        if of.items is not None:
            if role != "item":
                self.ignored = 1
                return
            of.items += 1
            self._flow(role, attrs, "list_item", here, f"{of.items}. " if of.ordered else "- ")
        elif role == "head":
            self._head(role, attrs, of)
        elif role in FLOWS:
            self._flow(role, attrs, FLOWS[role], here)
        elif role == "list":
            ordered = attrs.get("type", "").casefold() in ("ordered", "numbered")
            self.open.append(Container(self.number, "", here, here, 0, ordered))
        elif role == "div":
            self._enter(role, attrs, here.deeper())
        elif role == "note":
            self._enter(role, attrs, here.deeper("supplementary"))
        elif role == "figure":
            if self._class(self.number, kind_attrs(attrs), here.category)[0] == "supplementary":
                self._enter(role, attrs, here.deeper("supplementary"))
            else:
                self._set_apart(role, attrs, "figure", "figure_content", here)
        elif role in LEAF_EXCLUDED:
            self._set_apart(role, attrs, role, f"excluded_{role}", here)
        elif self.outline.inner[self.number]:
            self._enter(role, attrs, here)
        else:
            self.ignored = 1

    def data(self, text: str) -> None:
        if self.text and not self.ignored:
            self.text.data(text)

    def end(self) -> None:
        if self.ignored:
            self.ignored -= 1
        elif self.text and self.inside:
            self.inside -= 1
            self.text.end()
        elif self.text:
            text, self.text = self.text.text(), None
            if text:
                self.finish(text)
        elif self.open:
            self.open.pop()

    def taken(self) -> list[dict]:
        out, self.out = self.out, []
        return out


def descend(node: Node, *roles: str) -> Iterator[Node]:
    """All elements below that have one of the roles, or any, in document order."""
    todo = node.children[::-1]
    while todo:
        child = todo.pop()
        if not roles or child.role in roles:
            yield child
        todo += reversed(child.children)


def title_of(root: Node, html: bool) -> str:
    """The first of three titles that has text: the header's main title, its first title, the source's."""
    if html:
        found = [root.find("title")]
    else:
        headers = [root] if root.role == "teiHeader" else list(descend(root, "teiHeader"))

        def titles(parent: str) -> list[Node]:
            return [t for h in headers for s in descend(h, parent) for t in s.children if t.role == "title"]

        stated = titles("titleStmt")
        found = [next(iter(x), None) for x in ([t for t in stated if t.attrs.get("type") == "main"], stated, titles("analytic"))]
    return next((text for t in found if t and (text := node_text(t))), "")


def abstracts_of(root: Node) -> Iterator[tuple[Node, str]]:
    """Abstract candidates: the header's abstracts and front divisions whose attributes name one, each once."""
    headed = [a for h in descend(root, "teiHeader") for a in descend(h, "abstract")]
    named = [d for t in descend(root, "text") for f in t.children if f.role == "front" for d in descend(f, "div") if "abstract" in kind_attrs(d.attrs)]
    for node in {id(n): n for n in (*headed, *named)}.values():
        paragraphs = list(descend(node, "p"))
        texts = [node_text(p) for p in paragraphs] if paragraphs else [node_text(node)]
        if paragraphs:
            texts = [t for t in texts if not is_noise(t, len(_WORDS.findall(t)), t.casefold())]
        if text := "\n\n".join(filter(None, texts)):
            yield node, text


def all_text(node: Node) -> Iterator[str]:
    todo = node.parts[::-1]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            yield part
        else:
            todo += reversed(part.parts)


class _Size:
    """The text of one element, by its number."""

    def __init__(self, number: int):
        self.left, self.depth, self.texts = number, 0, []

    def start(self, role: str, attrs: dict[str, str]) -> None:
        self.depth += self.depth > 0 or self.left == 0
        self.left -= 1

    def data(self, text: str) -> None:
        if self.depth:
            self.texts.append(text)

    def end(self) -> None:
        self.depth -= self.depth > 0


def document_blocks(source: str | None, html: bool = False) -> Iterator[dict]:
    """Title, abstract candidates and body blocks of a document; without a body it is a ValueError.

    An abstract candidate has its language as source_type. Every block has the length of the whole
    body's text as body_chars. An XML document is parsed twice, for its outline and for its blocks, and no
    tree is made of its body; depth is bounded by memory alone.
    """
    if source is None:
        raise ValueError("no document")
    tree = parse_html(source) if html else None

    def events(*targets) -> Iterator[None]:
        return tree_events(tree, *targets) if html else xml_events(source, *targets)

    outline = Outline(html)
    for _ in events(outline):
        pass
    body = outline.body_at()
    if body is None:
        raise ValueError("no body element")
    size = outline.bodies.get(body)
    if size is None:  # a body inside another
        own = _Size(body)
        for _ in events(own):
            pass
        size = len(normalize(" ".join(own.texts)))
    front = outline.front.children
    front = tree if html else front[0] if front and outline.shape.children[0].role == "teiHeader" else outline.front
    top, n, held = Place("main", 1, ()), 0, []
    if text := title_of(front, html):
        held.append(_block("title", {}, "title", text, "main", "title", top))
    for node, text in () if html else abstracts_of(front):
        held.append(_block(node.role, node.attrs, "abstract_candidate", text, "main", "abstract", top) | {"source_type": node.attrs.get("lang", "")})
    walk, seen = Walk(outline, body), _Body(body)
    for _ in events(walk, seen):
        for block in held + walk.taken() if held or walk.out else ():
            n += 1
            yield block | {"body_chars": size}
        held = []
    if not n:
        yield _block(seen.role, seen.attrs, "empty", "", "discard", "empty_body", top) | {"body_chars": size}


class _Body:
    """The role and attributes of one element, by its number."""

    def __init__(self, number: int):
        self.left, self.role, self.attrs = number, "", {}

    def start(self, role: str, attrs: dict[str, str]) -> None:
        if self.left == 0:
            self.role, self.attrs = role, attrs
        self.left -= 1

    def data(self, text: str) -> None: ...

    def end(self) -> None: ...


class _Counts:
    """How many elements of each counted name there are, and how many have coordinates."""

    def __init__(self):
        self.names, self.coords = Counter(), 0

    def start(self, role: str, attrs: dict[str, str]) -> None:
        self.names[role] += 1
        self.coords += "coords" in attrs

    def data(self, text: str) -> None: ...

    def end(self) -> None: ...


COUNTED = ("p", "s", "note", "figure")


def element_counts(docs: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """id, n_p, n_s, n_note, n_figure, n_coords, error: how many elements of each name an XML document
    has, and how many have coordinates; a document that cannot be read is a row with its error."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"n_{n}" for n in (*COUNTED, "coords")]

    def run(batches):
        for batch in batches:
            out = []
            for source in batch.column(1).to_pylist():
                try:
                    found = _Counts()
                    for _ in xml_events(source or "", found):
                        pass
                    out.append((*(found.names[n] for n in COUNTED), found.coords, None))
                except ValueError as error:
                    out.append((*[None] * len(names), str(error)))
            kinds = (*[pa.int64()] * len(names), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=[id_col, *names, "error"])

    return docs.select(id_col, F.col(source_col).cast("string").alias("_source")).mapInArrow(run, f"{id_col} {kind}, " + ", ".join(f"{n} long" for n in names) + ", error string")


def blocks_of(docs: DataFrame, id_col: str, source_col: str, html: bool = False) -> DataFrame:
    """A row per block; a document that cannot be read is one row with its error."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in BLOCKS.split(", "))]
    types = (pa.int64(), *[pa.string()] * 4, pa.int32(), pa.list_(pa.string()), *[pa.string()] * 3, pa.list_(pa.string()), pa.int64(), pa.string())

    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for at, source in enumerate(batch.column(1).to_pylist()):
                for row in numbered_blocks(source, html):
                    rows.append(row)
                    ids.append(at)
                    if len(rows) >= 4096:
                        yield _rows(batch, ids, rows, names, types)
                        ids, rows = [], []
            if rows:
                yield _rows(batch, ids, rows, names, types)

    return docs.select(id_col, F.col(source_col).cast("string").alias("_source")).mapInArrow(run, f"{id_col} {kind}, {BLOCKS}")


def numbered_blocks(source: str | None, html: bool = False) -> Iterator[dict]:
    """The blocks with their ordinals; for a document that cannot be read one row with its error."""
    try:
        for n, block in enumerate(document_blocks(source, html)):
            yield block | {"ordinal": n, "error": None}
    except ValueError as error:
        yield {"ordinal": 0, "error": str(error)}


class DocumentBlocks:
    """The table function document_blocks(source, html): a document's blocks, one at a time."""

    def eval(self, source: str | None, html: bool = False) -> Iterator[tuple]:
        for row in numbered_blocks(source, bool(html)):
            yield tuple(row.get(x.split()[0]) for x in BLOCKS.split(", "))


def register(spark: SparkSession) -> None:
    """Make document_blocks known to SQL: select d.id, b.* from docs d, lateral document_blocks(d.source) b."""
    spark.udtf.register("document_blocks", F.udtf(DocumentBlocks, returnType=BLOCKS))


def _rows(batch, ids, rows, names, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), *(pa.array([r.get(n) for r in rows], t) for n, t in zip(names[1:], types, strict=True))], names=names)
