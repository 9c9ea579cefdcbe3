"""A small tolerant DOM: tags, labels and text in page order, simple tree matching, and text blocks."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

# Fixed values of the HTML vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_PARAGRAPH = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "summary"}
LIMITS = frozenset("html body table td th ul ol dl article section div main aside nav header footer form select blockquote".split())

# Elements and names that hold no article text.
NO_CONTENT_TAGS = frozenset(
    "head script style noscript template iframe svg nav header footer aside form button select input textarea label dialog menu object embed canvas video audio map".split()
)
NO_CONTENT_NAMES = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion cookie cookies consent notice notices gdpr popup modal newsletter subscribe "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead comment comments disqus discussion replies reply respond share sharing social related".split()
)
# Words that say where a box is or what shape it has; they may stand beside the names above ("ad-box", "site-footer").
PLACE_WORDS = frozenset(
    "area bar block blocks body bottom box button buttons col column container content fixed floating global group header inner item items js layer left link links list "
    "main module mobile outer overlay page panel pane post posts primary right row secondary section slot site sticky sub text title top unit widget wrap wrapper zone".split()
)
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass(slots=True)
class Node:
    """An element; ``parts`` are its texts and child elements in page order."""

    tag: str
    label: str
    dropped: bool = False
    parts: list = field(default_factory=list)
    children: list = field(default_factory=list)

    @property
    def text(self) -> str:
        return " ".join(p for p in self.parts if isinstance(p, str))


def _names_no_content(name: str) -> bool:
    """Whether a class or id names what holds no article text, and nothing else: "ad-box" does, "shadow", "share-price" and "with-sidebar" do not."""
    words = [w.lower() for w in _NAME.findall(name)]
    return not NO_CONTENT_NAMES.isdisjoint(words) and all(w in NO_CONTENT_NAMES or w in PLACE_WORDS for w in words)


@lru_cache(10_000)
def _describe(tag: str, attributes: str) -> tuple[str, bool]:
    """Label (tag and first class) and whether the element holds no article text."""
    dropped = tag in NO_CONTENT_TAGS
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag, dropped
    label = tag
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape("".join(values)).strip()
        if name == "class" and value:
            label = f"{tag}.{value.split()[0]}"
        if name in ("class", "id"):
            dropped = dropped or tag not in ("html", "body", "article", "main") and any(map(_names_no_content, value.split()))
        elif name == "role":
            dropped = dropped or value.lower() in NO_CONTENT_ROLES
        else:
            dropped = dropped or name == "hidden" or value.lower() == "true"
    return label, dropped


def parse(source: str | None) -> Node:
    """The tree of a page; unclosed and crossed elements are closed as browsers do in common cases."""
    root = Node("#root", "#root")
    open_nodes = [root]
    source = source or ""
    at = 0
    while True:
        token = _TOKEN.search(source, at)
        piece = source[at : token.start() if token else len(source)]
        if piece:
            text = html.unescape(piece) if "&" in piece else piece
            if not text.isspace() or len(open_nodes[-1].parts):
                open_nodes[-1].parts.append(text)
        if token is None:
            return root
        at = token.end()
        tag = token.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if token.group(1):
            for k in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[k].tag == tag:
                    del open_nodes[k:]
                    break
                if open_nodes[k].tag in LIMITS and tag not in LIMITS:
                    break
            continue
        closes = CLOSED_BY_SAME.get(tag, ())
        for k in range(len(open_nodes) - 1, 0, -1):
            other = open_nodes[k].tag
            if other in closes or other == "p" and tag in CLOSES_PARAGRAPH:
                del open_nodes[k:]
                if tag not in CLOSED_BY_SAME or tag == "li":
                    break
            elif other in LIMITS and not (tag in ("td", "th", "tr") and other in ("td", "th")):
                break
        attributes = token.group(3)
        label, dropped = _describe(tag, attributes)
        if tag == "header" and any(n.tag == "article" for n in open_nodes):
            dropped = label != tag and _describe("div", attributes)[1]  # the heading of an article is part of it
        node = Node(tag, label, dropped)
        open_nodes[-1].parts.append(node)
        open_nodes[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            stop = end.start() if end else len(source)
            if tag in ("title", "textarea"):
                node.parts.append(html.unescape(source[at:stop]))
            at = end.end() if end else len(source)
        elif tag not in VOID and not attributes.endswith("/"):
            open_nodes.append(node)


CELLS = 4_000_000


def _paired(xs: list[Node], ys: list[Node], kinds: list[int], weight) -> tuple[int, list[tuple[int, int]]]:
    """Weight and places of a heaviest order-preserving pairing of two lists of children.

    ``weight`` of a child of ``xs`` and one of ``ys`` with its label depends on the latter's kind only. The table of all
    pairs has a row per child of ``xs``. Where it would have over ``CELLS`` cells, only some rows are kept, evenly
    spaced, and those between two of them are computed again on the way back: the result is the same.
    """
    rows_kept = len(xs) if len(xs) * len(ys) <= CELLS else math.isqrt(len(xs)) + 1
    by_label: dict[str, list[int]] = {}
    for j, q in enumerate(ys):
        by_label.setdefault(q.label, []).append(j)
    of_kind: dict[str, tuple] = {}

    def weights(p: Node) -> np.ndarray:
        own = np.zeros(len(ys), dtype=np.int64)
        js = by_label.get(p.label)
        if js and p.children:
            if p.label not in of_kind:
                of_kind[p.label] = np.unique([kinds[j] for j in js], return_index=True, return_inverse=True)
            _, firsts, places = of_kind[p.label]
            own[js] = np.array([weight(p, ys[js[k]]) for k in firsts])[places]
        elif js:
            own[js] = 1
        return own

    def next_row(before: np.ndarray, own: np.ndarray) -> np.ndarray:
        row = np.zeros(len(ys) + 1, dtype=np.int64)
        np.maximum.accumulate(np.maximum(before[1:], before[:-1] + own), out=row[1:])
        return row

    def few_weights(p: Node) -> list[int]:
        return [(weight(p, q) if p.children else 1) if q.label == p.label else 0 for q in ys]

    def next_few(before: list[int], own: list[int]) -> list[int]:
        row, left = [0], 0
        for j, w in enumerate(own):
            left = max(before[j] + w, before[j + 1], left)
            row.append(left)
        return row

    if len(ys) < 64:  # the same in plain Python, which is quicker on short rows
        weights, next_row = few_weights, next_few
    row, starts = [0] * (len(ys) + 1) if len(ys) < 64 else np.zeros(len(ys) + 1, dtype=np.int64), {}
    for i in range(0, len(xs) if rows_kept < len(xs) else 0):
        if i % rows_kept == 0:
            starts[i] = row
        row = next_row(row, weights(xs[i]))
    total, pairs, j = None, [], len(ys)
    for start in sorted(starts or {0: row}, reverse=True):
        table, own = [starts.get(start, row)], []
        for p in xs[start : start + rows_kept]:
            own.append(weights(p))
            table.append(next_row(table[-1], own[-1]))
        total = int(table[-1][-1]) if total is None else total
        i = len(own)
        while i and j:
            w = own[i - 1][j - 1]
            if w and table[i][j] == table[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                pairs.append((start + i, j))
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return total, pairs


def _shapes(root: Node, known: dict) -> dict[int, int]:
    """The number of each node's shape, its labels all the way down; ``known`` numbers the shapes."""
    shapes: dict[int, int] = {}
    todo = [(root, False)]
    while todo:
        x, entered = todo.pop()
        if entered or not x.children:
            shapes[id(x)] = known.setdefault((x.label, *[shapes[id(c)] for c in x.children]), len(known))
        else:
            todo.append((x, True))
            todo += [(c, False) for c in x.children]
    return shapes


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: pairs of a largest order-preserving mapping of equal labels, parent to parent.

    Pairs of subtrees are weighed from the leaves up with a stack of their own: pages nest deeper than
    Python's calls. Subtrees of one shape are weighed once, so long lists of alike entries cost little.
    """
    if a.label != b.label:
        return []
    known: dict = {}
    left, right = _shapes(a, known), _shapes(b, known)
    sizes: dict[tuple[int, int], int] = {}
    memo: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def weight(p: Node, q: Node) -> int:
        return sizes[left[id(p)], right[id(q)]] if p.children and q.children else 1

    todo = [(a, b, False)]
    while todo:
        x, y, weighed = todo.pop()
        key = (left[id(x)], right[id(y)])
        if key in sizes:
            continue
        xs, ys = x.children, y.children
        if not weighed:
            todo.append((x, y, True))
            by_label: dict[str, dict[int, Node]] = {}
            for q in ys:
                if q.children:
                    by_label.setdefault(q.label, {}).setdefault(right[id(q)], q)
            inner = {left[id(p)]: p for p in xs if p.children}
            todo += [(p, q, False) for s, p in inner.items() for o, q in by_label.get(p.label, {}).items() if (s, o) not in sizes]
        else:
            total, memo[key] = _paired(xs, ys, [right[id(q)] for q in ys], weight) if xs and ys else (0, [])
            sizes[key] = total + 1
    found, open_pairs = [], [(a, b)]
    while open_pairs:
        x, y = open_pairs.pop()
        found.append((x, y))
        if x.children and y.children:
            open_pairs.extend((x.children[i], y.children[j]) for i, j in memo[left[id(x)], right[id(y)]])
    return found


def blocks(slots: list[Node], without: set[int] = frozenset()) -> list[str]:
    """Texts of the blocks below ``slots`` in page order, white space made one space, without what holds no article text.

    ``without`` has the ids of nodes whose own texts are left out.
    """
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    for slot in slots:
        # Explicit stack: pages nest deeper than Python's calls.
        todo: list = [slot]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif x.tag == "br":
                line.append(" ")
            elif not x.dropped or x is slot:
                block = x.tag in BLOCKS
                if block:
                    flush()
                    todo.append(None)
                todo.extend(reversed(x.children if id(x) in without else x.parts))
        flush()
    return out
