"""A small element tree for one page: parents, attributes and visible text."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

# Fixed values of HTML: elements without content, elements without visible text, and the open
# element that a new one of the same family ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
HIDDEN = {"script", "style", "template"}
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "a": {"a"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
STOPS = {"ul", "ol", "dl", "table", "select", "div", "article", "section", "body"}
ENDS_PARAGRAPH = {"p", "div", "ul", "ol", "dl", "table", "article", "section", "main", "header",
                  "footer", "nav", "aside", "form", "h1", "h2", "h3", "h4", "h5", "h6", "hr",
                  "pre", "blockquote"}


class Element:
    """One element; ``Tree`` gives its text and what is below it, as ranges of its two lists."""

    __slots__ = ("tag", "attrs", "parent", "number", "first", "depth", "stop", "last", "_text")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Element | None", number: int, first: int,
                 depth: int):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.number, self.first, self.depth = number, first, depth
        # Without an end, the element reaches to the end of the page.
        self.stop: int | None = None
        self.last: int | None = None
        self._text: str | None = None

    def above(self, tag: str) -> "Element | None":
        node = self.parent
        while node is not None and node.tag != tag:
            node = node.parent
        return node


class Tree:
    """All elements and stripped visible strings of a page in page order.

    Elements know their parents only, so that a page's memory is free as soon as it is dropped.
    """

    def __init__(self) -> None:
        self.nodes: list[Element] = []
        self._texts: list[str] = []
        # Elements around a string that hide it, for strings below a hidden one; an element shows those
        # that nothing between the two hides.
        self._depths: dict[int, int] = {}
        self._open: list[Element] = []
        self._hidden = 0
        self._paragraphs = 0
        self._data: str | None = None

    def text(self, node: Element | None = None) -> str:
        """Stripped visible strings of an element or the page, joined by one blank."""
        if node is None:
            return self._joined(0, None, 0)
        if node._text is None:
            node._text = "" if node.tag in HIDDEN else self._joined(node.first, node.last, node.depth)
        return node._text

    def _joined(self, first: int, last: int | None, depth: int) -> str:
        texts = self._texts[first:last]
        if self._depths:
            texts = [t for i, t in enumerate(texts, first) if self._depths.get(i, 0) == depth]
        return " ".join(texts)

    def descendants(self, node: Element | None = None) -> list[Element]:
        return self.nodes if node is None else self.nodes[node.number + 1:node.stop]

    def _flush(self) -> None:
        data = self._data.strip()
        self._data = None
        if data and not (self._open and self._open[-1].tag in HIDDEN):
            if self._hidden:
                self._depths[len(self._texts)] = self._hidden
            self._texts.append(data)

    def _leave(self, count: int) -> None:
        """End the innermost open elements until ``count`` are left."""
        if self._data is not None:
            self._flush()
        stop, last = len(self.nodes), len(self._texts)
        for node in self._open[count:]:
            node.stop, node.last = stop, last
            if node.tag == "p":
                self._paragraphs -= 1
            elif node.tag in HIDDEN:
                self._hidden -= 1
        del self._open[count:]

    def _close(self, tags: set[str], stops: set[str]) -> None:
        opened = self._open
        for i in range(len(opened) - 1, -1, -1):
            tag = opened[i].tag
            if tag in stops:
                return
            if tag in tags:
                self._leave(i)
                return

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ENDS:
            self._close(ENDS[tag], STOPS)
        if self._paragraphs and tag in ENDS_PARAGRAPH:
            self._close({"p"}, STOPS)
        if self._data is not None:
            self._flush()
        opened, nodes = self._open, self.nodes
        node = Element(tag, attrs, opened[-1] if opened else None, len(nodes), len(self._texts), self._hidden)
        nodes.append(node)
        if tag in VOID or tag == "!":
            node.stop, node.last = len(nodes), node.first
            return
        opened.append(node)
        if tag == "p":
            self._paragraphs += 1
        elif tag in HIDDEN:
            self._hidden += 1

    def end(self, tag: str) -> None:
        if self._open and self._open[-1].tag == tag:
            self._leave(len(self._open) - 1)
        else:
            self._close({tag}, set())

    def data(self, data: str) -> None:
        self._data = data if self._data is None else self._data + data

    def comment(self) -> None:
        # Keeps the texts on its two sides apart.
        self.start("!", {})

    def done(self) -> None:
        if self._data is not None:
            self._flush()


class _Builder(HTMLParser):
    """Any page, by the parser of the standard library."""

    def __init__(self, tree: Tree) -> None:
        super().__init__(convert_charrefs=True)
        self.tree = tree

    def handle_starttag(self, tag, attrs):
        self.tree.start(tag, {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tree.end(tag)

    def handle_data(self, data):
        self.tree.data(data)

    def handle_comment(self, data):
        self.tree.comment()


# Well-formed markup, which every HTML parser reads alike: a text, then an end tag, a start tag with its
# attributes, a comment without double hyphens inside, a document type, or the end of the page.
_BLANK = r"[ \t\n\r\f]"
_NAME = r"[a-zA-Z_:@][a-zA-Z0-9_:.@-]*+"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`][^\s"'<>`]*+)"""
_TOKEN = re.compile(
    r"([^<]*+)(?:"
    rf"</([a-zA-Z][a-zA-Z0-9:_-]*+){_BLANK}*+>"
    rf"|<([a-zA-Z][a-zA-Z0-9:_-]*+)((?:{_BLANK}++{_NAME}(?:{_BLANK}*+={_BLANK}*+{_VALUE})?+)*+){_BLANK}*+(/?)>"
    r"|(<!--(?!-?>)[^-]*+(?:-[^-]++)*+-->)"
    r"|<![dD][oO][cC][tT][yY][pP][eE][^>]*+>"
    r"|(\Z))")
_ATTRIBUTES = re.compile(rf"({_NAME})(?:{_BLANK}*+={_BLANK}*+({_VALUE}))?")
_RAW_ENDS = {tag: (re.compile(rf"</\s*{tag}", re.I), re.compile(rf"</{tag}{_BLANK}*+>", re.I))
             for tag in ("script", "style")}


def _attributes(source: str) -> dict[str, str]:
    found = {}
    for name, value in _ATTRIBUTES.findall(source):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        found[name.lower()] = unescape(value) if "&" in value else value
    return found


def _read(tree: Tree, html: str) -> bool:
    """Read a page of well-formed markup; false at the first construct that is not."""
    token, at = _TOKEN.match, 0
    while True:
        found = token(html, at)
        if found is None:
            return False
        text, ended, tag, attributes, empty, comment, finish = found.groups()
        if text:
            tree.data(unescape(text) if "&" in text else text)
        at = found.end()
        if ended is not None:
            tree.end(ended.lower())
        elif tag is not None:
            tag = tag.lower()
            tree.start(tag, _attributes(attributes) if attributes else {})
            if empty:
                if tag not in VOID:
                    tree.end(tag)
            elif tag in _RAW_ENDS:
                some, plain = _RAW_ENDS[tag]
                near = some.search(html, at)
                whole = plain.match(html, near.start()) if near else None
                # Comments in scripts are where parsers differ.
                if whole is None or html.find("<!--", at, whole.start()) >= 0:
                    return False
                tree.end(tag)
                at = whole.end()
        elif comment is not None:
            tree.comment()
        elif finish is not None:
            return True


def parse(html: str) -> Tree:
    """The tree of a page. Well-formed pages take a short way, all others the library's parser."""
    tree = Tree()
    if not _read(tree, html):
        tree = Tree()
        builder = _Builder(tree)
        builder.feed(html)
        builder.close()
    tree.done()
    return tree
