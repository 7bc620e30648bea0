"""Operator 4: main text of web pages by composite text density.

For every DOM node: characters per tag, adjusted by how much of it is link text (the composite density). A node's
density sum adds the densities of its children; the node of the greatest sum leads to the article. The body's own density
is the threshold on the path from there to the body: the article is raised to each node on the path that reaches it, unless
links are a third or more of the text that comes in thereby. Siblings at least half as dense are further sections, and so are
those without links that come later or have elements of their own, unless an article element lies in the found part. On an ``article`` or ``main`` half the threshold is enough, and
its further sections are such elements too. A heading of the first rank that stands before it belongs to it.

Page furniture that markup names (navigation, forms, adverts, notices, reader comments, hidden parts) is taken off before,
unless it wraps the page: a form or a part so named that holds an article, the heading or most of the page's text stays.
A name of which furniture is only a part ("share-price", "alert-story"), or of a quote, takes nothing off by itself: a part
full of links goes, or one with links below the threshold, and any other stays. A button or label outside of forms whose
parent has words of its own is part of that sentence.

Text: character references decoded, white space inside a block one space, trimmed, blocks in page order joined by one
line feed. ``br`` is white space.

Defined results: a null or empty html gives an empty text; broken markup is repaired as far as unclosed and stray tags
go, in time that grows with the page's length only; page_id and url are carried, nulls and repeats included; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .markup import BLOCK, RAW, VOID, attributes, decoded, tags

# Element classes of HTML, and the words by which markup names page furniture.
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "legend"}
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIST_SCOPE = frozenset("ul ol dl table menu select article section main body".split())
OFF_TAGS = RAW | frozenset("nav footer aside form button menu dialog input label fieldset select object audio video canvas template svg".split())
OFF_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
COMMENT_WORDS = frozenset("comment comments respond reply replies disqus discussion".split())
#: Words that name furniture whatever stands beside them.
SURE_WORDS = COMMENT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsored cookie cookies consent gdpr newsletter navbar navigation breadcrumb breadcrumbs"
    " sidebar pagination pager paywall masthead".split()
)
#: Words that name furniture alone or beside words of layout.
OFF_WORDS = SURE_WORDS | frozenset(
    "sponsor promo promotion banner notice notices subscribe subscription signup login popup modal overlay nav menu menus aside widget widgets"
    " related recommended recommendations share sharing social footer header toolbar skip hidden copyright disclaimer alert".split()
)
LAYOUT_WORDS = frozenset(
    "area article articles bar block body bottom box button buttons center col column container content entry fixed form global group head icon icons inner item"
    " items left link links list main message module more news outer page panel post posts reader right row section site slot sticky stories story text title"
    " top unit user view wrap wrapper".split()
)
#: Words by which a wrapper tells what the page has, not what it is itself.
STATE_WORDS = frozenset("no not has with without open opened closed active enabled disabled toggled".split())
LANDMARKS = ("article", "main")
#: Furniture by tag that may wrap a whole page; the controls inside stay off.
WRAPPERS = frozenset(("form", "fieldset"))
#: Elements that hold running text: part of a name says nothing about them unless links fill them.
TEXT_TAGS = frozenset("p li dd dt td th pre blockquote figcaption caption span em strong b i u mark small cite q code time abbr sub sup".split())
#: What somebody says: a word of the name alone takes nothing of it off.
QUOTES = frozenset(("blockquote", "q"))
#: Controls whose label may be a word of the sentence around them.
SPOKEN = frozenset(("button", "label"))
#: Kept text under so many characters beside a part (a site's name, a skip link) is no article of its own.
FEW = 100

WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NOT_SHOWN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)


class Page:
    """A flat DOM: nodes in page order, so a parent's number is below its children's."""

    def __init__(self, source: str):
        self.tag, self.parent, self.off = ["html"], [-1], [False]
        self.talk: set[int] = set()  # nodes named as reader comments
        self.doubtful: list[int] = []  # nodes of whose name furniture is only a part
        self.spoken: list[int] = []  # controls outside of forms that may be words of a sentence
        self.texts: list[tuple[int, str]] = []  # node, text
        self.stack = [0]  # open nodes
        # Depths on the stack: by tag, of blocks, of blocks other than p, and of list scopes; so no search walks the stack.
        self.depths: dict[str, list[int]] = defaultdict(list)
        self.blocks, self.walls, self.scopes = [0], [0], [0]
        at = 0
        for start, _, close, name, rest, stop in tags(source):
            if start > at:
                self._text(source[at:start])
            at = stop
            if not name:
                continue
            if close and name in ("body", "html"):  # what follows still belongs to the body
                self.texts.append((self.stack[-1], ""))
            elif close:
                self._close(name)
            elif name != "html" and not (name == "body" and self.depths["body"]):
                self._open(name, rest)
        if at < len(source):
            self._text(source[at:])

    def _text(self, text: str) -> None:
        self.texts.append((self.stack[-1], decoded(text) if text.strip() else " "))

    def _push(self, node: int, name: str) -> None:
        depth = len(self.stack)
        self.stack.append(node)
        self.depths[name].append(depth)
        if name in BLOCK:
            self.blocks.append(depth)
            if name != "p":
                self.walls.append(depth)
        if name in LIST_SCOPE:
            self.scopes.append(depth)

    def _pop(self, depth: int) -> None:
        """Close all nodes from ``depth`` up."""
        while len(self.stack) > depth:
            last = len(self.stack) - 1
            self.depths[self.tag[self.stack.pop()]].pop()
            for some in (self.blocks, self.walls, self.scopes):
                if some[-1] == last:
                    some.pop()

    def _open(self, name: str, rest: str) -> None:
        tag, stack = self.tag, self.stack
        if name in CLOSES_P and tag[stack[self.blocks[-1]]] == "p":
            self._pop(self.blocks[-1])
        if ends := CLOSED_BY.get(name):
            found = [d[-1] for e in ends if (d := self.depths[e]) and d[-1] > self.scopes[-1]]
            if found:
                self._pop(min(found) if name == "tr" else max(found))
        node = len(tag)
        tag.append(name)
        self.parent.append(stack[-1])
        self.off.append(name in OFF_TAGS or name == "header" and not self._in_landmark() or bool(rest.strip()) and self._named_off(node, name, rest))
        if name in SPOKEN and tag[stack[-1]] in TEXT_TAGS and not (self.depths["form"] or self.depths["fieldset"]):
            self.spoken.append(node)
        if name in BLOCK or name == "br":
            self.texts.append((node, "" if name in BLOCK else " "))
        if not (name in VOID or name in RAW or name == "svg" and rest.endswith("/")):
            self._push(node, name)

    def _in_landmark(self) -> bool:
        return any(self.depths[t] for t in LANDMARKS)

    def _named_off(self, node: int, name: str, rest: str) -> bool:
        if name in ("body", "main", "h1", "h2", "h3", "h4", "h5", "h6"):
            return False
        sure = doubtful = False
        for key, value in attributes(rest):
            if key in ("class", "id"):
                for one in value.split():
                    words = {w.lower() for w in WORD.findall(one)}
                    hit = words & OFF_WORDS
                    if not hit or words & STATE_WORDS or hit == {"header"} and self._in_landmark():
                        continue
                    if name == "article":
                        sure = sure or bool(hit & COMMENT_WORDS)
                    elif name not in QUOTES and hit & SURE_WORDS or not words - OFF_WORDS - LAYOUT_WORDS - {w for w in words if len(w) == 1}:
                        sure = True
                    else:
                        doubtful = True
                    if hit & COMMENT_WORDS:
                        self.talk.add(node)
            elif key == "role" and value.lower() in OFF_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True
            elif key == "style" and NOT_SHOWN.search(value):
                return True
        if doubtful and not sure:
            self.doubtful.append(node)
        return sure

    def _close(self, name: str) -> None:
        if not self.depths[name]:
            if name == "p":
                self.texts.append((self.stack[-1], ""))
            return
        depth = self.depths[name][-1]
        if name not in BLOCK and self.walls[-1] > depth:
            return
        if name in BLOCK:
            self.texts.append((self.parent[self.stack[depth]], ""))
        self._pop(depth)

    # --- density ---

    def _children_first(self):
        return range(len(self.tag) - 1, 0, -1)

    def settle(self) -> None:
        """Carry what is taken off down; a named part or a form that holds an article or heading, or most of the page, stays.

        Most of the page: more than half of its text outside what is always furniture (navigation, footers, controls). Next to
        a kept article or heading, and for parts named as comments, size alone keeps a part only if little else is kept, and never next to a headed article.
        """
        n = len(self.tag)
        saying = {node for node, text in self.texts if text.strip()}
        for k in self.spoken:
            self.off[k] = self.off[k] and self.parent[k] not in saying
        marks = [t in LANDMARKS or t == "h1" for t in self.tag]
        may_stay = [self.off[k] and (t in WRAPPERS or t not in OFF_TAGS and t != "header") for k, t in enumerate(self.tag)]
        gone = [False] * n
        above = [-1] * n  # the nearest part, the node itself included, that is taken off
        for k in range(1, n):
            gone[k] = gone[self.parent[k]] or self.off[k] and not may_stay[k]
            above[k] = k if self.off[k] else above[self.parent[k]]
        size, heads, headings = [0] * n, [0] * n, [0] * n
        own, own_marks, own_landmarks = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)  # by ``above``; the last: kept anyway
        for node, text in self.texts:
            if not gone[node]:
                size[node] += len(text.strip())
                own[above[node]] += len(text.strip())
        for k in self._children_first():
            p = self.parent[k]
            size[p] += size[k]
            heads[p] += heads[k] + (marks[k] and not (self.off[k] and self.tag[k] == "article"))
            headings[p] += headings[k] + (self.tag[k] == "h1")
            if marks[k] and size[k] and not gone[k] and not (k in self.talk and self.tag[k] == "article"):
                own_marks[above[k]] += 1
                own_landmarks[above[k]] += self.tag[k] in LANDMARKS
        kept, kept_marks, kept_landmarks = own[-1], own_marks[-1], own_landmarks[-1]
        for k in range(1, n):
            if may_stay[k] and not self.off[self.parent[k]]:
                if headings[k] if self.tag[k] == "article" else heads[k]:
                    stays = True
                else:
                    titled = kept_landmarks and (k in self.talk or kept_marks > kept_landmarks)  # the article is elsewhere
                    guarded = kept_marks or k in self.talk
                    stays = 2 * size[k] > size[0] and not titled and (not guarded or kept < FEW and size[k] > 10 * kept)
                if stays:
                    self.off[k] = False
                    kept, kept_marks, kept_landmarks = kept + own[k], kept_marks + own_marks[k], kept_landmarks + own_landmarks[k]
            self.off[k] = self.off[k] or self.off[self.parent[k]]

    def densities(self) -> tuple[list[float], list[float], list[int], list[int]]:
        """Composite density, density sum, characters and characters of links of each node."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for k in range(1, n):
            in_link[k] = self.tag[k] == "a" or in_link[self.parent[k]]
        for node, text in self.texts:
            if not self.off[node]:
                size = len(text.strip())
                chars[node] += size
                link_chars[node] += size * in_link[node]
        for k in self._children_first():
            if self.off[k]:
                continue
            p = self.parent[k]
            chars[p] += chars[k]
            tags[p] += tags[k] + 1
            link_chars[p] += link_chars[k]
            link_tags[p] += link_tags[k] + (self.tag[k] == "a")
        body_share = link_chars[0] / max(1, chars[0])
        density, sums = [0.0] * n, [0.0] * n
        for k in (*self._children_first(), 0):
            if self.off[k] or not chars[k]:
                continue
            c, t, lc, lt = chars[k], max(1, tags[k]), link_chars[k], link_tags[k]
            base = math.log(c / max(1, c - lc) * lc + body_share * c + math.e)
            density[k] = c / t * math.log(c / max(1, lc) * t / max(1, lt) + 1) / max(1e-9, math.log(base + 1))
            if k:
                sums[self.parent[k]] += density[k]
        return density, sums, chars, link_chars

    def judge(self) -> tuple[list[float], list[float], list[int], list[int]]:
        """Take off the parts of doubtful names that links fill, or that hold links and are less dense than the body; the
        densities then."""
        found = self.densities()
        density, _, chars, links = found
        body = self.body
        gone = [
            k for k in self.doubtful
            if not self.off[k] and (2 * links[k] > chars[k] or self.tag[k] not in TEXT_TAGS and links[k] and (3 * links[k] > chars[k] or density[k] < density[body]))
        ]
        if gone:
            for k in gone:
                self.off[k] = True
            for k in range(1, len(self.tag)):
                self.off[k] = self.off[k] or self.off[self.parent[k]]
            found = self.densities()
        return found

    @property
    def body(self) -> int:
        return self.tag.index("body") if "body" in self.tag else 0

    def article(self) -> list[int]:
        """Roots of the main text."""
        self.settle()
        density, sums, chars, links = self.judge()
        n, body = len(self.tag), self.body
        best = max((k for k in range(n) if not self.off[k]), key=lambda k: (sums[k], density[k]))
        raised = k = best
        while k > body:
            dense = density[k] >= density[body] * (0.5 if self.tag[k] in LANDMARKS else 1)
            if dense and 3 * (links[k] - links[raised]) <= chars[k] - chars[raised]:
                raised = k
            k = self.parent[k]
        if k != body or raised <= body:  # outside of the body, or all of it
            return [raised]
        kind = (*LANDMARKS, "section") if self.tag[raised] in LANDMARKS else BLOCK
        of, parents = self.parent[raised], set(self.parent)
        marked = any(inside and tag in LANDMARKS for inside, tag in zip(self._below([raised]), self.tag, strict=True))  # the page says what its article is
        roots = [k for k in range(body + 1, n) if self.parent[k] == of and not self.off[k] and (k == raised or self.tag[k] in kind and (2 * density[k] >= density[raised] or not (links[k] or marked) and (k > raised or k in parents)))]
        inside = self._below(roots)
        headings = [k for k in range(body + 1, n) if self.tag[k] == "h1" and not self.off[k] and chars[k]]
        before = [k for k in headings if k < raised and 2 * links[k] <= chars[k]]
        if before and not any(inside[k] for k in headings):
            roots.append(before[-1])
        return roots

    def _below(self, roots: list[int]) -> list[bool]:
        """Whether each node is one of the roots or below one."""
        inside = [False] * len(self.tag)
        for k in roots:
            inside[k] = True
        for k in range(1, len(self.tag)):
            inside[k] = inside[k] or inside[self.parent[k]]
        return inside

    def text(self) -> str:
        if len(self.tag) == 1 and not self.texts:
            return ""
        inside = self._below(self.article())
        blocks, run = [], []
        for node, text in self.texts:
            if text == "":  # a block begins or ends
                if run:
                    blocks.append(" ".join("".join(run).split()))
                    run = []
            elif inside[node] and not self.off[node]:
                run.append(text)
        if run:
            blocks.append(" ".join("".join(run).split()))
        return "\n".join(b for b in blocks if b)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "html"):
                texts = [main_text(h) for h in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
