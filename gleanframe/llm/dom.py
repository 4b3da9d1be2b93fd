"""Small HTML reader: the block elements of a page as a tree, and its text block by block."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z][^>]*+\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

# Elements that stand in a line of text; all others are blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr img".split()
)
# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no mark-up.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
# Elements that a new one of the second set closes.
CLOSES = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
        "header hr main menu nav ol p pre section table ul li dt dd tr td th".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
#: Deeper elements count as part of their ancestor at this depth; their text is kept.
MOST_DEPTH = 60
# Attributes that make part of a label, with the mark before their tokens.
PREFIXES = {"class": ".", "id": ".", "role": "@", "itemprop": "$"}


class Node(NamedTuple):
    parent: int
    label: str


class Block(NamedTuple):
    node: int
    text: str
    link_chars: int


def label_of(tag: str, attributes: str) -> str:
    """The tag with the tokens of its class, id, role and itemprop, their words joined by ``-``; digits do not count."""
    if not attributes or not attributes.strip(" /"):
        return tag
    words = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
            words.add("hidden")
        elif name in PREFIXES:
            tokens = ["-".join(re.findall(r"[^\W\d_]+", token)) for token in value.split()]
            words |= {PREFIXES[name] + token for token in tokens if token}
    return " ".join([tag, *sorted(words)])


def parse(page: str | None) -> tuple[list[Node], list[Block]]:
    """Tree and blocks of a page. Elements of one label below one node are one node.

    Character references are decoded, white space in a block is one blank, empty blocks do not count.
    """
    page = page or ""
    nodes, known = [Node(-1, "page")], {}
    stack: list[tuple[str, int]] = []
    blocks: list[Block] = []
    pieces: list[tuple[str, bool]] = []
    links, at = 0, 0

    def close_block() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
            if text:
                linked = sum(len(p) for p, in_link in pieces if in_link)
                blocks.append(Block(stack[-1][1] if stack else 0, text, min(linked, len(text))))
            pieces.clear()

    while at < len(page):
        found = TOKEN.search(page, at)
        if found is None:
            pieces.append((page[at:], links > 0))
            break
        if found.start() > at:
            pieces.append((page[at : found.start()], links > 0))
        at = found.end()
        tag = (found["tag"] or found["tag2"] or "").lower()
        if not tag:
            continue
        if found["end"] or found["end2"]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                continue
            close_block()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    links = 0
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "a":
            links += 1
        if tag in INLINE:
            continue
        if tag == "br":
            pieces.append((" ", False))
            continue
        close_block()
        if tag in VOID:
            continue
        while stack and tag in CLOSES.get(stack[-1][0], ()):
            stack.pop()
            links = 0
        parent = stack[-1][1] if stack else 0
        if len(stack) < MOST_DEPTH:
            key = (parent, label_of(tag, found["attributes"] or found["attributes2"] or ""))
            if key not in known:
                known[key] = len(nodes)
                nodes.append(Node(*key))
            parent = known[key]
        stack.append((tag, parent))
    close_block()
    return nodes, blocks


def children_of(nodes: list[Node]) -> list[list[int]]:
    below: list[list[int]] = [[] for _ in nodes]
    for i, node in enumerate(nodes):
        if node.parent >= 0:
            below[node.parent].append(i)
    return below


def align(a: list[Node], b: list[Node]) -> dict[int, int]:
    """Simple tree matching: nodes of ``a`` with their partners in ``b``.

    Two nodes match if their labels do; their children are matched in order so that the number of
    matched nodes below is largest.
    """
    below_a, below_b = children_of(a), children_of(b)
    sizes: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def match(x: int, y: int) -> int:
        """Matched nodes of the subtrees; the matched pairs of children are kept in ``sizes``."""
        if a[x].label != b[y].label:
            return 0
        if (x, y) in sizes:
            return sizes[x, y][0]
        left, right = below_a[x], below_b[y]
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        weight = [[match(i, j) for j in right] for i in left]
        for i in range(len(left)):
            for j in range(len(right)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight[i][j])
        i, j, pairs = len(left), len(right), []
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((left[i], right[j]))
        sizes[x, y] = (best[-1][-1] + 1, pairs)
        return sizes[x, y][0]

    match(0, 0)
    partners, waiting = {}, [(0, 0)]
    while waiting:
        x, y = waiting.pop()
        partners[x] = y
        waiting += sizes[x, y][1]
    return partners
