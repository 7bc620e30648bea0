"""Selector probes over HTML: the one step of page extraction that column expressions cannot express.

A probe is a list of selectors; it gives the texts (or an attribute) of what they match. All rules about what the texts
mean stay in column expressions (``catalith.operators.extract``), so this helper only looks up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose texts make up a description (a fixed value).
TEXT_TAGS = frozenset("p span div li h1 h2 h3 h4 h5 td th".split())
SAME_CLOSES = frozenset("li tr td th option p".split())
STEP = re.compile(r"(\s*>\s*|\s+)?([a-z][a-z0-9]*|\*)?((?:#[\w-]+|\.[\w-]+|\[[^\]]+\])*)", re.I)
PART = re.compile(r"#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:=\"?([^\]\"]*)\"?)?\]")


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None
    children: list[Node | str] = field(default_factory=list)

    def nodes(self) -> Iterator[Node]:
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self, between: str = "") -> str:
        """Stripped texts below the node, one after another."""
        parts, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                if s := n.strip():
                    parts.append(s)
            else:
                todo += reversed(n.children)
        return between.join(parts)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root
        self.open: Counter[str] = Counter()  # so that no end tag without a start walks up the page

    def handle_starttag(self, tag, attrs):
        if tag in SAME_CLOSES and self.at.tag == tag:
            self.open[tag] -= 1
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.open[tag] += 1
            self.at = node

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        while self.at.tag != tag:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.open[tag] -= 1
        self.at = self.at.parent

    def handle_data(self, data):
        self.at.children.append(data)


class _Verbatim(_Builder):
    """Character references stay as they are written: while the page is read a character that it lacks stands for ``&``."""

    def __init__(self, stand_in: str):
        super().__init__()
        self.stand_in = stand_in

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, [(k, v and v.replace(self.stand_in, "&")) for k, v in attrs])

    def handle_data(self, data):
        super().handle_data(data.replace(self.stand_in, "&"))


def parse(html: str, references: bool = True) -> Node:
    """The page's tree; without ``references`` no character reference is decoded."""
    if references or "&" not in html:
        b = _Builder()
    else:
        used = set(html)
        b = _Verbatim(next(c for c in map(chr, range(0xF0000, 0x10FFFE)) if c not in used))
        html = html.replace("&", b.stand_in)
    b.feed(html)
    b.close()
    return b.root


class Index:
    """Nodes of a page by what a selector's last step may ask for, each list in page order."""

    def __init__(self, root: Node, source: str | None = None):
        """With the page's ``source``, probes whose phrases it cannot hold are passed over."""
        self.root, self.nodes = root, list(root.nodes())
        self.low = source.lower() if source is not None and "&#" not in source else None
        self.of: dict[str, list[Node]] = {}
        for n in self.nodes:
            for key in {n.tag, *(f".{c}" for c in n.attrs.get("class", "").split()), *(f"[{a}" for a in n.attrs), f"#{n.attrs.get('id', '')}"}:
                self.of.setdefault(key, []).append(n)

    def candidates(self, tag: str, parts: list[tuple[str, str, str, str]]) -> list[Node]:
        for id_, cls, attr, _ in parts:
            return self.of.get(f"#{id_}" if id_ else f".{cls}" if cls else f"[{attr}", [])
        return self.nodes if tag in ("", "*") else self.of.get(tag, [])


def _fits(node: Node, tag: str, parts: list[tuple[str, str, str, str]]) -> bool:
    if tag not in ("", "*") and node.tag != tag:
        return False
    for id_, cls, attr, value in parts:
        if id_ and node.attrs.get("id") != id_ or cls and cls not in node.attrs.get("class", "").split():
            return False
        if attr and (attr not in node.attrs or value and node.attrs[attr] != value):
            return False
    return True


@lru_cache(maxsize=1024)
def _steps(selector: str) -> list[tuple[bool, str, list]]:
    """(direct child of the step before?, tag, conditions) of each step."""
    return [(m[1] is not None and ">" in m[1], m[2] or "", PART.findall(m[3])) for m in STEP.finditer(selector.strip()) if m[2] or m[3]]


def _matches(node: Node | None, steps: list, k: int) -> bool:
    if k < 0:
        return True
    direct = steps[k + 1][0]
    while node is not None and node.parent is not None:
        if _fits(node, *steps[k][1:]) and _matches(node.parent, steps, k - 1):
            return True
        if direct:
            return False
        node = node.parent
    return False


def select(within: Node | Index, selector: str) -> list[Node]:
    steps = _steps(selector)
    nodes = within.candidates(*steps[-1][1:]) if isinstance(within, Index) else within.nodes()
    return [n for n in nodes if _fits(n, *steps[-1][1:]) and _matches(n.parent, steps, len(steps) - 2)]


def leaf_texts(node: Node) -> list[str]:
    """Texts over five characters of the elements without text elements among their children, and images, in page order."""
    out = []
    for n in (node, *node.nodes()):
        if n.tag == "img":
            source = (n.attrs.get("src") or n.attrs.get("data-src", "")).strip()
            if source and "pixel" not in source and "transparent" not in source:
                out.append(f"\n[Image: {source}]\n")
        elif n.tag in TEXT_TAGS and not any(isinstance(c, Node) and c.tag in TEXT_TAGS for c in n.children) and len(text := n.text()) > 5:
            out.append(text)
    return out


@dataclass(frozen=True)
class Probe:
    """``attr`` instead of the text; ``every`` match instead of the first selector's with a text; texts joined ``between``;
    ``leaves``: the texts and images inside the first match, in page order; ``phrases``: only texts that hold one of these
    (lower case) are of interest, so pages without them need no look."""

    selectors: tuple[str, ...]
    attr: str | None = None
    every: bool = False
    between: str = ""
    leaves: bool = False
    phrases: tuple[str, ...] = ()

    def run(self, root: Node | Index) -> list[str]:
        if self.phrases and isinstance(root, Index) and root.low is not None and not any(p in root.low for p in self.phrases):
            return []
        if self.leaves:
            found = next((n for s in self.selectors for n in select(root, s)[:1]), None)
            return leaf_texts(found) if found else []
        for s in self.selectors:
            texts = [(n.attrs.get(self.attr, "") if self.attr else n.text(self.between)).strip() for n in select(root, s)]
            texts = [t for t in texts if t]
            if texts:
                return texts if self.every else texts[:1]
        return []


def pairs(root: Node | Index) -> list[dict[str, str]]:
    """Label and value of every table row with a head cell, then of list items with a bold label."""
    out = []
    for row in select(root, "tr"):
        head, cell = select(row, "th"), select(row, "td")
        if head and cell:
            out.append({"k": head[0].text(), "v": cell[0].text()})
    for bold in select(root, "li > span > span.a-text-bold"):
        spans = select(bold.parent, "span")
        after = spans[spans.index(bold) + 1 :]
        if after:
            out.append({"k": bold.text().replace(":", ""), "v": after[0].text()})
    return [p for p in out if p["k"] and p["v"]]


def probed(html: Column, probes: dict[str, Probe], references: bool = True) -> Column:
    """struct(found map<name, texts>, details array<struct<k, v>>) of each page; NULL for a NULL page. Without ``references``
    character references are left to the caller."""

    @F.pandas_udf("found map<string, array<string>>, details array<struct<k: string, v: string>>")
    def look(pages: pd.Series) -> pd.DataFrame:
        found, details = [], []
        for page in pages:
            root = Index(parse(page or "", references), page or "")
            found.append({name: p.run(root) for name, p in probes.items()})
            details.append(pairs(root))
        return pd.DataFrame({"found": found, "details": details})

    return look(html)
