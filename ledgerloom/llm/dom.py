"""HTML as trees of blocks: a lenient parser, and order-preserving alignment of two trees by simple tree matching."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import numpy as np

#: Pairs of nodes whose scores are in memory at a time.
CELLS = 1 << 22

# Elements of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
LEFT_OUT = frozenset("noscript template svg math object audio video canvas select datalist".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main "
    "menu nav ol p pre search section summary table caption thead tbody tfoot tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html body dd dt legend li caption thead tbody tfoot tr".split())
#: What a start tag closes, and the elements beyond which it doesn't look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Elements, roles and words of classes and ids that mark what isn't the article; headers are so outside of it only.
NOT_ARTICLE = frozenset("nav footer aside dialog menu search button".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar status".split())
COMMENTS = frozenset("comment comments disqus respond reply replies commentlist".split())
WORDS = COMMENTS | frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo "
    "promotion popup modal overlay cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup share sharing social "
    "related recommended recommendations pagination pager login search toolbar skip widget".split()
)
HEADER = frozenset("header masthead topbar".split())

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?(?=[\s/>]|\Z)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements within each other; deeper ones lie beside each other.
DEPTH = 150


class Node:
    """A block element, or (label '#') a run of text in one."""

    __slots__ = ("label", "tag", "off", "kids", "text", "link", "run", "shape")

    def __init__(self, tag: str, label: str, off: int = 0):
        self.tag, self.label, self.off = tag, label, off
        self.kids: list[Node] = []
        self.run: list[tuple[str, bool]] = []
        self.text, self.link, self.shape = "", 0, 0

    def flush(self) -> None:
        """The text gathered so far becomes a leaf, with its white space turned into single spaces."""
        if self.run:
            text = " ".join("".join(t for t, _ in self.run).split())
            if text:
                leaf = Node("#", "#")
                leaf.text = text
                leaf.link = sum(len(t) for t, linked in self.run if linked)
                self.kids.append(leaf)
            self.run = []


#: Why an element is off: not at all; a word or a form, unless an article or main part lies within; comments, unless a main part does; for certain.
ON, SOFT, COMMENT, HARD = range(4)


def _marks(tag: str, attributes: str) -> tuple[str, int, bool]:
    """The label (element and words of its class), why it is off, and whether it is named as the main part."""
    off, main, words = (HARD if tag in NOT_ARTICLE else SOFT if tag == "form" else ON), tag == "main", ()
    if attributes and not attributes.isspace():
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next(filter(None, values), "")
            if name in ("class", "id"):
                found = {w.lower() for w in _WORD.findall(value)}
                words = (*words, *sorted(found))
                if found & COMMENTS:
                    off = max(off, COMMENT)
                elif found & WORDS and tag not in ("html", "body", "main", "article"):
                    off = max(off, SOFT)
                elif found & HEADER and tag not in ("html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6"):
                    tag = "header"
            elif name == "role":
                off, main = (max(off, HARD) if value.lower() in ROLES else off), main or value.lower() == "main"
            elif name == "itemprop":
                main = main or value.lower() == "articlebody"
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
                off = HARD
    return ".".join((tag, *words)), off, main


def parse(page: str) -> Node:
    """The tree of blocks; `off` holds what an element's own mark says. Scripts, styles and other raw text aren't in it.

    White space, line breaks and tags within a block separate or join words as they do on the page; end tags left out are implied.
    """
    body = Node("body", "body")
    stack: list[tuple[str, Node, bool, bool]] = [("", body, False, False)]  # element, block, in a link, text is left out
    at, endless = 0, set()

    def text(to: int) -> None:
        _, node, linked, mute = stack[-1]
        if to > at and not mute:
            some = page[at:to]
            node.run.append((html.unescape(some) if "&" in some else some, linked))

    def close(k: int) -> None:
        """Ends the element at place k of the stack and all within."""
        while len(stack) > k:
            node = stack.pop()[1]
            if node is not stack[-1][1]:  # inline elements share their block's node
                node.flush()

    def near(tags: set[str] | frozenset[str], within: set[str] | frozenset[str]) -> int:
        """The outermost place of such an element above the next of the others; 0 for none."""
        found = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in within:
                break
            if stack[k][0] in tags:
                found = k
        return found

    while m := _TOKEN.search(page, at):
        text(m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag, ends = m[2].lower(), bool(m[1])
        if ends and tag != "br":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break
            continue
        if tag in VOID:
            node = stack[-1][1]
            node.flush() if tag == "hr" else node.run.append((" ", False)) if tag == "br" else None
            continue
        if tag in RAW or tag in LEFT_OUT:
            if tag not in endless and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
                if end is None:
                    endless.add(tag)  # browsers read a script to the end of the page then
                at = end.end() if end else len(page) if tag in RAW else at
            continue
        if tag in CLOSES:
            k = near(*CLOSES[tag])
            close(k or len(stack))
        elif tag in CLOSES_P:
            k = near({"p"}, {"td", "th", "table", "button", "li", "div", "article", "section", "body"})
            close(k or len(stack))
        if tag in ("html", "head", "body"):
            continue
        _, node, linked, mute = stack[-1]
        label, off, main = _marks(tag, m[3])
        if tag in BLOCK or main:
            node.flush()
            name = "header" if label.startswith("header") else "main" if main else tag
            made = Node(name, label, off)
            if len(stack) < DEPTH:
                node.kids.append(made)
                stack.append((tag, made, linked, False))
        elif len(stack) < 4 * DEPTH:
            if tag in ("td", "th"):
                node.run.append((" ", False))
            stack.append((tag, node, linked or tag == "a", mute or off > ON))
    text(len(page))
    close(1)
    body.flush()
    return body


def content(root: Node) -> list[Node]:
    """The leaves of the articles in page order; of the main parts if there are none; of the page if there are neither."""
    _settle(root)
    for tag, most in (("article", ON), ("main", ON), ("body", ON), ("body", SOFT)):
        found = [leaf for part in _parts(root, tag, most) for leaf in _leaves(part, most, tag != "body")]
        if found:
            return found
    return []


def _settle(root: Node) -> None:
    """Takes marks back from forms and containers that hold the main part, so that a word in a wrapper's name hides no page."""
    walk: list[tuple[Node, tuple[Node, ...]]] = [(root, ())]
    while walk:
        node, above = walk.pop()
        if not node.off and node.tag in ("article", "main"):
            for outer in above:
                if outer.off == SOFT or outer.off == COMMENT and node.tag == "main":
                    outer.off = ON
        if node.off != HARD:
            held = (*above, node) if node.off else above
            walk += [(kid, held) for kid in node.kids if kid.label != "#"]


def _parts(node: Node, tag: str, most: int) -> Iterator[Node]:
    """The outermost elements of a kind that aren't off."""
    if node.off > most:
        return
    if node.tag == tag:
        yield node
        return
    for kid in node.kids:
        if kid.label != "#":
            yield from _parts(kid, tag, most)


def _leaves(node: Node, most: int, headers: bool) -> Iterator[Node]:
    for kid in node.kids:
        if kid.label == "#":
            yield kid
        elif kid.off <= most and (headers or kid.tag != "header"):
            yield from _leaves(kid, most, headers)


def groups(kids: Sequence[Node]) -> list[list[Node]]:
    """Neighbours of one label together."""
    out: list[list[Node]] = []
    for kid in kids:
        if out and out[-1][0].label == kid.label:
            out[-1].append(kid)
        else:
            out.append([kid])
    return out


def match(weight: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (i, j), growing in both, with the largest sum of weight[rows[i], columns[j]]; none of weight 0.

    One side is halved where the table of sums would be too large, so memory stays bounded.
    """
    n, m = len(rows), len(columns)

    def step(best: np.ndarray, i: int, cols: np.ndarray) -> np.ndarray:
        out = best.copy()
        out[1:] = np.maximum(best[1:], best[:-1] + weight[rows[i], cols])
        return np.maximum.accumulate(out)

    if n > 1 and n * m > CELLS:
        half, ahead, back = n // 2, np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
        for i in range(half):
            ahead = step(ahead, i, columns)
        for i in range(n - 1, half - 1, -1):
            back = step(back, i, columns[::-1])
        cut = int(np.argmax(ahead + back[::-1]))
        return match(weight, rows[:half], columns[:cut]) + [(i + half, j + cut) for i, j in match(weight, rows[half:], columns[cut:])]
    sums = [np.zeros(m + 1, np.int64)]
    for i in range(n):
        sums.append(step(sums[-1], i, columns))
    pairs, i, j = [], n, m
    while i and j:
        if sums[i][j] == sums[i][j - 1]:
            j -= 1
        elif sums[i][j] == sums[i - 1][j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


class Slot:
    """A node of a wrapper: neighbours of one label are one slot. `texts`: the texts of a leaf, each with a number of its own."""

    __slots__ = ("label", "kids", "texts", "number")

    def __init__(self, label: str):
        self.label, self.number = label, 0
        self.kids: list[Slot] = []
        self.texts: dict[str, int] = {}


class Wrapper:
    """The tree that pages of a host are aligned with, made of some of them, merged as they align; neighbours of one label are merged likewise."""

    def __init__(self, pages: Sequence[str]):
        self.owner: list[int] = []  # of each text the number of its leaf
        self.slots = 0
        self.root = Slot("body")
        self._fill(self.root, [parse(page) for page in pages])

    def _fill(self, slot: Slot, nodes: Sequence[Node]) -> None:
        slot.number = self.slots
        self.slots += 1
        for node in nodes if slot.label == "#" else ():
            if node.text not in slot.texts:
                slot.texts[node.text] = len(self.owner)
                self.owner.append(slot.number)
        merged: list[tuple[str, list[Node]]] = []
        for node in nodes:
            own = groups(node.kids)
            labels = [label for label, _ in merged]
            if [g[0].label for g in own] == labels:
                pairs = [(k, k) for k in range(len(own))]
            else:
                names = sorted({*labels, *(g[0].label for g in own)})
                code = {name: k for k, name in enumerate(names)}
                pairs = match(np.eye(len(names), dtype=np.int64), np.array([code[g[0].label] for g in own], int), np.array([code[x] for x in labels], int))
            joined, i, j = [], 0, 0
            for a, b in [*pairs, (len(own), len(merged))]:
                joined += merged[j:b] + [(g[0].label, list(g)) for g in own[i:a]]
                if a < len(own):
                    merged[b][1].extend(own[a])
                    joined.append(merged[b])
                i, j = a + 1, b + 1
            merged = joined
        for label, some in merged:
            kid = Slot(label)
            slot.kids.append(kid)
            self._fill(kid, some)

    def align(self, root: Node) -> dict[int, Slot]:
        """The slots of the page's leaves, by the leaves' id(), as simple tree matching aligns them; leaves without a slot are left out."""
        found: dict[int, Slot] = {}
        scores: dict[tuple[int, int], int] = {}
        shapes: dict[tuple, int] = {}

        def shape(node: Node) -> int:
            if not node.shape:
                node.shape = shapes.setdefault((node.label, *(shape(g[0]) for g in groups(node.kids))), len(shapes) + 1)
            return node.shape

        def pair(own: list[list[Node]], kids: list[Slot]) -> list[tuple[int, int]]:
            if [g[0].label for g in own] == [k.label for k in kids]:
                return [(k, k) for k in range(len(kids))]
            codes, rows = np.unique([shape(g[0]) for g in own], return_inverse=True) if own else ([], np.zeros(0, int))
            example = {shape(g[0]): g[0] for g in own}
            weight = np.array([[score(example[c], k) for k in kids] for c in codes], np.int64).reshape(len(codes), len(kids))
            return match(weight, rows, np.arange(len(kids)))

        def score(node: Node, slot: Slot) -> int:
            """The number of nodes that the best alignment of both trees has in common."""
            if node.label != slot.label:
                return 0
            key = (shape(node), slot.number)
            if key not in scores:
                own = groups(node.kids)
                scores[key] = 1 + sum(score(own[i][0], slot.kids[j]) for i, j in pair(own, slot.kids))
            return scores[key]

        def walk(node: Node, slot: Slot) -> None:
            own = groups(node.kids)
            for i, j in pair(own, slot.kids):
                for kid in own[i]:
                    if kid.label == "#":
                        found[id(kid)] = slot.kids[j]
                    else:
                        walk(kid, slot.kids[j])

        walk(root, self.root)
        return found
