"""A small tolerant document tree, and the alignment of trees by simple tree matching."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
#: A quoted string without a name, or a whole name and its value: names are read one after another, never inside a value.
_ATTRIBUTE = re.compile(r""""[^"]*"|'[^']*'|([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
_ATTRIBUTES = frozenset("class id role hidden aria-hidden style".split())
#: Elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset((
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead tr ul").split())
#: An opening tag closes an open element of these names first.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "p": {"p"}}
SCOPE = frozenset("html body ul ol dl table article section div nav aside main footer header form td th blockquote".split())
_SPACE = re.compile(r"\s+")


@dataclass(eq=False, slots=True)
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings
    _blocks: list | None = None

    @property
    def key(self) -> tuple[str, str]:
        return self.tag, self.attributes.get("class", "")

    def nodes(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def blocks(self) -> list[Node]:
        """Block children, also those inside inline elements. Asked of whole trees only; the answer is kept."""
        if self._blocks is not None:
            return self._blocks
        out = self._blocks = []
        stack = self.children[::-1]
        while stack:
            child = stack.pop()
            if isinstance(child, Node):
                if child.tag in BLOCK:
                    out.append(child)
                else:
                    stack += child.children[::-1]
        return out


def parse(source: str) -> Node:
    """The tree of a page; unclosed, misnested and cut tags are repaired, nothing is lost."""
    root = Node("#root")
    stack, at = [root], 0
    while at < len(source):
        match = _TOKEN.search(source, at)
        if not match:
            stack[-1].children.append(html.unescape(source[at:]))
            break
        if match.start() > at:
            stack[-1].children.append(html.unescape(source[at:match.start()]))
        at = match.end()
        if not match[2]:
            continue
        tag = match[2].lower()
        if match[1]:
            names = [n.tag for n in stack]
            if tag in names:
                place = len(names) - 1 - names[::-1].index(tag)
                if tag in BLOCK or not any(n in BLOCK for n in names[place + 1:]):
                    del stack[place:]
            continue
        if tag in BLOCK:
            closes = CLOSED_BY.get(tag, {"p"}) | {"p"}
            for place in range(len(stack) - 1, 0, -1):
                if stack[place].tag in closes:
                    del stack[place:]
                    break
                if stack[place].tag in SCOPE:
                    break
        attributes = {}
        for name, value in _ATTRIBUTE.findall(match[3]) if match[3] else ():
            if name.lower() in _ATTRIBUTES:
                attributes[name.lower()] = html.unescape(value.strip("\"'")).lower()
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
            node.children.append(source[at:end.start() if end else len(source)])
            at = end.end() if end else len(source)
        elif tag not in VOID and not match[3].rstrip().endswith("/"):
            stack.append(node)
    return root


def squeeze(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def text_of(node: Node) -> str:
    """All text below a node, in one line; raw elements have none."""
    out: list[str] = []
    stack: list = node.children[::-1]
    while stack:
        child = stack.pop()
        if isinstance(child, str):
            out.append(child)
        elif child.tag not in RAW:
            stack += [" ", *child.children[::-1], " "]
    return squeeze("".join(out))


def block_texts(root: Node) -> Iterator[tuple[Node, str]]:
    """Each block below a root and the root itself with its ``text_of``, in one walk."""
    pieces: list[str] = []
    line: list[str] = []
    stack = [(root, iter(root.children), 0)]

    def flush() -> None:
        text = squeeze("".join(line))
        line.clear()
        if text:
            pieces.append(text)

    while stack:
        node, rest, start = stack[-1]
        for child in rest:
            if isinstance(child, str):
                line.append(child)
            elif child.tag not in RAW:
                flush()
                stack.append((child, iter(child.children), len(pieces)))
                break
        else:
            flush()
            stack.pop()
            if node.tag in BLOCK or node is root:
                yield node, " ".join(pieces[start:])


def _board(left: list[dict], right: list[Node], weight: dict) -> list[list[int]]:
    """Most pairs of the first i template children and the first j blocks."""
    best = [[0] * (len(right) + 1)]
    for t in left:
        above, row, repeat = best[-1], [0], t["repeat"]
        for j, n in enumerate(right, 1):
            most = above[j] if above[j] > row[-1] else row[-1]
            w = weight.get((id(t), id(n)), 0)
            if w:
                most = max(most, above[j - 1] + w, row[-1] + w if repeat else 0)
            row.append(most)
        best.append(row)
    return best


def match(template: dict, node: Node, into: list | None = None) -> int:
    """Simple tree matching: the most pairs of an order-keeping alignment that respects parents.

    Template nodes are dicts with ``key``, ``children`` and ``repeat``; a repeating one takes any
    number of neighbours. With ``into``, the aligned pairs are appended to it. Trees may be of any depth.
    """
    if tuple(template["key"]) != node.key:
        return 0
    pairs = [(template, node, node.blocks())]
    for t, _, right in pairs:  # grows by the pairs of children with equal keys
        keys = [n.key for n in right]
        for child in t["children"]:
            key = tuple(child["key"])
            pairs += [(child, n, n.blocks()) for n, k in zip(right, keys, strict=True) if k == key]
    weight: dict[tuple[int, int], int] = {}
    for t, n, right in reversed(pairs):
        weight[id(t), id(n)] = 1 + (_board(t["children"], right, weight)[-1][-1] if right and t["children"] else 0)
    todo = [(template, node)] if into is not None else []
    while todo:
        t, n = todo.pop()
        into.append((t, n))
        left, right = t["children"], n.blocks()
        best = _board(left, right, weight)
        i, j = len(left), len(right)
        inner = []
        while i and j:
            w = weight.get((id(left[i - 1]), id(right[j - 1])), 0)
            if w and left[i - 1]["repeat"] and best[i][j] == best[i][j - 1] + w:
                inner.append((left[i - 1], right[j - 1]))
                j -= 1
            elif w and best[i][j] == best[i - 1][j - 1] + w:
                inner.append((left[i - 1], right[j - 1]))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i -= 1
        todo += inner[::-1]
    return weight[id(template), id(node)]
