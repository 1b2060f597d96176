"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with the path of block elements from the root to it. Per
path the text length and the punctuation are summed over its blocks and divided by their number;
both ratios are fused, smoothed along the page and held against their spread. Paths that rise
above it carry the content; that a path runs through an article element is one factor among the
others. The smallest element around nearly all of their text is taken as the article, so that headings
and short paragraphs in it are kept; other low paths, menus and the like are not. Forms and
elements whose class or id sounds like an advert or a sidebar go only if the winning text is not theirs.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from wageband.llm.common import with_arrow_columns

# Kinds of elements (fixed values of the HTML standard).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr", "param"}
RAW = {"script", "style", "title", "textarea", "template", "noscript", "iframe", "svg", "math",
       "object", "noframes", "xmp", "canvas", "audio", "video"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn",
          "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
          "br", "input", "picture", "source", "map", "area", "nobr", "center"}
# An opening tag that ends open elements of these names, up to the given borders.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
        "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
        "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}
# Elements that never belong to the article; elements, and words in class or id, that often do not.
ASIDE = {"nav", "footer", "aside", "button", "select", "menu", "head", "legend", "datalist"}
FORMS = {"form", "fieldset", "dialog"}
HINTS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo",
         "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert",
         "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside",
         "footer", "comment", "comments", "disqus", "respond", "reply", "replies", "share",
         "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription",
         "popup", "modal", "overlay", "widget", "pagination", "pager", "toolbar", "skip", "login"}
HEADS = {"header", "masthead", "topbar"}
ARTICLES = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Elements that are parts of a text, not the whole of one.
PARTS = HEADINGS | {"p", "li", "ul", "ol", "blockquote", "pre", "td", "th", "tr", "tbody", "dd", "dt", "dl",
                    "figure", "figcaption", "address", "hgroup"}
PUNCTUATION = ".,;:!?…。，、；：！？।؟،"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SMOOTHING = (0.25, 0.5, 0.25)
WIDTH_OF_SPREAD = 0.5
CORE_SHARE = 0.9
CLIMB_SHARE = 0.5
LINK_SHARE = 0.6
NAMED_FACTOR = 1.5
# Share of the text that a doubtful element holds if it stays: by a word among others or its tag, by its whole name.
HELD_BY_WORD = 0.5
HELD_BY_NAME = 0.9


@dataclass
class Node:
    """An open or closed block element."""
    tag: str
    parent: Node | None
    path: str
    outside: bool
    in_article: bool
    doubt: float = 0.0


@dataclass
class Block:
    """A run of text inside one block element."""
    node: Node
    pieces: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""


def _attributes(raw: str) -> dict[str, str]:
    return {m.group(1).lower(): next((g for g in m.groups()[1:] if g is not None), "")
            for m in ATTRIBUTE.finditer(raw)}


def _opened(tag: str, raw: str, parent: Node | None) -> Node:
    """A new element, with whether it or one around it stands outside, and the doubt its name casts."""
    step, outside = tag, parent is not None and parent.outside
    inside = parent is not None and parent.in_article
    words: set[str] = set()
    names: set[str] = set()
    if raw.strip():
        found = _attributes(raw)
        kind = found.get("class", "")
        if kind:
            step = f"{tag}.{kind.split()[0].lower()}" if kind.split() else tag
        named = f"{kind} {found.get('id', '')} {found.get('role', '')}".lower()
        names, words = set(named.split()), set(re.split(r"[^a-z0-9]+", named))
        style = found.get("style", "").replace(" ", "").lower()
        outside = outside or "hidden" in found or found.get("aria-hidden") == "true" \
            or "display:none" in style or "visibility:hidden" in style
    whole = tag in ("html", "body")
    if tag in ASIDE or (tag == "header" and not inside):
        outside = True
    hints, doubt = HINTS if inside else HINTS | HEADS, 0.0
    if not whole and tag not in ARTICLES:
        if names & hints:
            doubt = HELD_BY_NAME
        elif words & hints or tag in FORMS:
            doubt = HELD_BY_WORD
    inside = inside or (tag in ARTICLES and not outside)
    return Node(tag, parent, f"{parent.path if parent else ''}/{step}", outside, inside, doubt)


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order; raw elements, comments and markup are left out."""
    root = Node("", None, "", False, False)
    stack, blocks = [root], []
    block, links, labels, at = Block(root), 0, 0, 0

    def flush() -> None:
        nonlocal block
        if block.pieces:
            block.text = " ".join("".join(block.pieces).split())
            if block.text:
                blocks.append(block)
        block = Block(stack[-1])

    def add(piece: str) -> None:
        if piece and not labels:
            text = html.unescape(piece) if "&" in piece else piece
            block.pieces.append(text)
            if links:
                block.link_chars += len(text.strip())

    for token in TOKEN.finditer(page):
        if token.start() < at:
            continue
        add(page[at:token.start()])
        at = token.end()
        tag = token.group(2)
        if tag is None:
            if token.group().startswith("<![CDATA["):
                add(token.group()[9:].removesuffix("]]>"))
            continue
        tag, closing = tag.lower(), token.group(1) == "/"
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "label":
                labels = max(0, labels - 1)
            elif tag == "br":
                add(" ")
            elif tag not in INLINE:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
                if depth or tag == "p":
                    flush()
                    del stack[depth or len(stack):]
                    block = Block(stack[-1])
            continue
        if tag in RAW:
            if not token.group().endswith("/>"):
                # Raw content ends at its own closing tag only, whatever it holds.
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            add(" ")
            continue
        if tag == "br":
            add(" ")
        elif tag == "a":
            links += 1
        elif tag == "label":
            # The caption of a form control goes with it.
            labels += any(n.tag == "form" for n in stack)
        elif tag not in INLINE:
            flush()
            links = labels = 0
            if tag not in VOID:
                if len(stack) > 1 and any(n.tag == "p" for n in stack) and tag not in ("html", "body"):
                    depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p")
                    del stack[depth:]
                names, borders = ENDS.get(tag, ((), ()))
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in borders or not names:
                        break
                    if stack[i].tag in names:
                        del stack[i:]
                        break
                if not (tag in ("html", "body") and any(n.tag == tag for n in stack)):
                    stack.append(_opened(tag, token.group(3), stack[-1]))
            block = Block(stack[-1])
    add(page[at:])
    flush()
    return blocks


def path_scores(blocks: list[Block]) -> dict[str, float]:
    """Fused and smoothed ratio of every tag path."""
    text: dict[str, float] = {}
    marks: dict[str, float] = {}
    count: dict[str, int] = {}
    named: dict[str, int] = {}
    for b in blocks:
        path = b.node.path
        text[path] = text.get(path, 0.0) + max(0, len(b.text) - b.link_chars)
        marks[path] = marks.get(path, 0.0) + sum(map(b.text.count, PUNCTUATION))
        count[path] = count.get(path, 0) + 1
        named[path] = named.get(path, 0) + b.node.in_article
    fused = [math.sqrt((text[b.node.path] / count[b.node.path])
                       * (1.0 + marks[b.node.path] / count[b.node.path]))
             * (1.0 + (NAMED_FACTOR - 1.0) * named[b.node.path] / count[b.node.path]) for b in blocks]
    scores: dict[str, float] = {}
    for i, b in enumerate(blocks):
        around = [fused[max(0, i - 1)], fused[i], fused[min(len(fused) - 1, i + 1)]]
        smooth = sum(w * v for w, v in zip(SMOOTHING, around))
        scores[b.node.path] = scores.get(b.node.path, 0.0) + smooth / count[b.node.path]
    return scores


def _spread_threshold(scores: dict[str, float], blocks: list[Block]) -> float:
    values = [scores[b.node.path] for b in blocks]
    mean = sum(values) / len(values)
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    return min(mean, WIDTH_OF_SPREAD * spread if spread else mean)


def _unlinked(block: Block) -> int:
    return max(0, len(block.text) - block.link_chars)


def _without_doubtful(blocks: list[Block], need: float) -> list[Block]:
    """Blocks outside the elements of one degree of doubt that do not hold the winning paths' text.

    The least goes first, and the others are held against what is left, so the last one stays. An
    element named as a whole stays only if it has several blocks.
    """
    own: dict[int, list] = {}  # per doubtful element: core text, all text, blocks
    nodes: dict[int, Node] = {}
    around: list[list[int]] = []
    for b in blocks:
        chain, node = [], b.node
        while node is not None:
            if node.doubt == need:
                chain.append(id(node))
                nodes[id(node)] = node
            node = node.parent
        around.append(chain)
    if not nodes:
        return blocks
    scores = path_scores(blocks)
    least = _spread_threshold(scores, blocks)
    total = [0, 0]
    for b, chain in zip(blocks, around):
        size = _unlinked(b)
        core = size if scores[b.node.path] >= least else 0
        total[0], total[1] = total[0] + core, total[1] + size
        for i in chain:
            held = own.setdefault(i, [0, 0, 0])
            held[0], held[1], held[2] = held[0] + core, held[1] + size, held[2] + 1
    gone: set[int] = set()
    for i in sorted(own, key=lambda i: (own[i][0], own[i][1])):
        core, size, number = own[i]
        holds = (total[0] > 0 and core >= need * total[0]) or (total[1] > 0 and size >= need * total[1])
        if holds and (need < HELD_BY_NAME or number > 1):
            continue
        gone.add(i)
        total[0], total[1] = total[0] - core, total[1] - size
        node = nodes[i].parent
        while node is not None:
            if id(node) in own:
                held = own[id(node)]
                held[0], held[1], held[2] = held[0] - core, held[1] - size, held[2] - number
            node = node.parent
    return [b for b, chain in zip(blocks, around) if not gone.intersection(chain)]


def _article_around(core: list[Block], blocks: list[Block]) -> Node:
    """The smallest element, but no single paragraph, around most of the core's text.

    An element around it takes its place if it mostly adds headings and text of the same core paths.
    """
    weight: dict[int, int] = {}
    nodes: dict[int, Node] = {}
    depth: dict[int, int] = {}
    total = 0
    for b in core:
        total += len(b.text)
        chain, node = [], b.node
        while node is not None:
            chain.append(node)
            node = node.parent
        for level, node in enumerate(reversed(chain)):
            weight[id(node)] = weight.get(id(node), 0) + len(b.text)
            nodes[id(node)], depth[id(node)] = node, level
    heavy = [i for i, w in weight.items() if w >= CORE_SHARE * total]
    best = nodes[max(heavy, key=lambda i: (depth[i], weight[i]))]
    while best.parent is not None and best.parent.tag and best.tag in PARTS:
        best = best.parent
    won = {b.node.path for b in core if _inside(b.node, best)}
    above, node = {}, best
    while node is not None:
        above[id(node)] = len(above)
        node = node.parent
    # Per element above, the text it adds to the one below it, and how much of that is like the core.
    added: dict[int, list[int]] = {}
    for b in blocks:
        node = b.node
        while id(node) not in above:
            node = node.parent
        sums = added.setdefault(above[id(node)], [0, 0])
        sums[0] += len(b.text)
        sums[1] += _unlinked(b) if b.node.path in won or b.node.tag in HEADINGS else 0
    size = alike = 0
    outer, level = best.parent, 1
    while outer is not None and outer.tag and outer.tag not in ("html", "body"):
        if level in added:
            size, alike = size + added[level][0], alike + added[level][1]
            if alike < CLIMB_SHARE * size:
                break
            best, size, alike = outer, 0, 0
        outer, level = outer.parent, level + 1
    return best


def _inside(node: Node | None, article: Node) -> bool:
    while node is not None:
        if node is article:
            return True
        node = node.parent
    return False


def main_blocks(page: str | None) -> list[str]:
    """Blocks of the article in page order; none if the page has no article text."""
    if not page:
        return []
    blocks = [b for b in blocks_of(page) if not b.node.outside]
    for need in (HELD_BY_NAME, HELD_BY_WORD):
        blocks = _without_doubtful(blocks, need)
    if not blocks:
        return []
    scores = path_scores(blocks)
    least = _spread_threshold(scores, blocks)
    core = [b for b in blocks if scores[b.node.path] >= least] or blocks
    article = _article_around(core, blocks)
    kept = []
    for b in blocks:
        if _inside(b.node, article):
            linky = b.link_chars > LINK_SHARE * len(b.text)
            if scores[b.node.path] >= least or (b.node.tag in PARTS and not linky):
                kept.append(b.text)
    return kept


def main_text(page: str | None) -> str:
    return "\n\n".join(main_blocks(page))


def with_main_text(df: DataFrame, html_column: str = "html") -> DataFrame:
    """``df`` with ``text``, the article of each page, and ``n_chars``, its code points.

    Character references are decoded, white space inside a block becomes one blank, blocks are
    joined by an empty line. A null, empty or broken page, or one without an article, gives the
    empty text. Pages are worked on one by one and whole, so repeated rows give equal texts and no
    row is dropped. Result columns replace input columns of the same name.
    """
    def start():
        def extract(pages):
            texts = [main_text(p) for p in pages]
            return texts, [len(t) for t in texts]

        return extract

    return with_arrow_columns(df, html_column, {"text": "STRING", "n_chars": "BIGINT"}, start)
