"""Operator 5: token counts that follow edits.

A document's text is cut at white space, which no pre-token of the vocabulary crosses, into leaves of about
``LEAF_CHARS`` characters. A binary tree over the leaves holds the sums of characters and tokens. An edit is resolved
to leaves by descending the tree; the touched leaves, with a neighbour where the edit reaches a leaf's rim, are encoded
anew as one region, cut into leaves again, and the sums on the way to the root follow; where regions have more leaves
than before, the leaf list is spliced and the tree over it made anew once for all edits, without encoding. Everything
else keeps its count.

A vocabulary whose pre-tokens cross white space is an error, since leaves would then change its counts.

Defined results: a null text has no tokens and takes no edits; edits are (start, end, replacement) on the text as it was,
in any order; overlapping ones raise an error; an empty table gives no rows; equal rows are counted separately; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import encoder, tokenizer_path

LEAF_CHARS = 512
SPACE = re.compile(r"[ \t\n\r]")
#: Personal data that the registered query edits out: e-mail and IPv4 addresses.
PRIVATE = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\b\d{1,3}(?:\.\d{1,3}){3}\b")
PLACEHOLDER = "<removed>"


def leaves(text: str, size: int = LEAF_CHARS) -> list[str]:
    """Pieces of the text, each but the last ending in front of white space, ``size`` characters long or a little more."""
    out, start = [], 0
    while start < len(text):
        m = SPACE.search(text, start + size)
        end = m.start() if m else len(text)
        out.append(text[start:end])
        start = end
    return out


class Tree:
    """Sums of characters and tokens over the leaves of one text."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.n = max(1, len(chars))
        self.width = 1 << (self.n - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        if chars:
            self.sums[self.width : self.width + len(chars)] = np.stack([chars, tokens], axis=1)
        k = self.width // 2
        while k:
            self.sums[k : 2 * k] = self.sums[2 * k : 4 * k : 2] + self.sums[2 * k + 1 : 4 * k : 2]
            k //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at ``at`` (the last one for the end of the text), and where it starts."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if at >= start + self.sums[k, 0] and self.sums[k + 1, 0]:
                start += int(self.sums[k, 0])
                k += 1
        return k - self.width, start

    def replace(self, regions: list[tuple[int, int, list[tuple[int, int]]]]) -> None:
        """Put leaves of (characters, tokens) in the place of the leaves first to last, for ascending (first, last, leaves).

        Where all have room the sums on their ways to the root follow; else the leaf list is spliced once for all and the
        tree made anew once.
        """
        if all(len(new) <= last + 1 - first for first, last, new in regions):
            for first, last, new in regions:
                for k in range(first, last + 1):
                    self.put(k, *(new[k - first] if k - first < len(new) else (0, 0)))
            return
        old, parts, at = self.sums[self.width : self.width + self.n], [], 0
        for first, last, new in regions:
            parts += [old[at:first], np.array(new, np.int64).reshape(-1, 2)]
            at = last + 1
        spliced = np.concatenate([*parts, old[at:]])
        self.__init__(*[spliced[:, k].tolist() for k in (0, 1)])

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = self.width + leaf
        change = np.array([chars, tokens]) - self.sums[k]
        while k:
            self.sums[k] += change
            k //= 2


def apply_edits(text: str, tree: Tree, edits: list[tuple[int, int, str]], count, size: int = LEAF_CHARS) -> tuple[str, int]:
    """The edited text and how many characters were encoded anew; ``count`` maps texts to token counts.

    Edits become regions of whole leaves, joined where they share leaves; all regions are put into the tree together.
    """
    edits = sorted(edits)
    if any(a[1] > b[0] for a, b in zip(edits, edits[1:], strict=False)) or any(not 0 <= s <= e <= len(text) for s, e, _ in edits):
        raise ValueError("edits overlap or leave the text")
    regions: list[list] = []  # first leaf, last leaf, edits
    for e in edits:
        (first, at), (last, at_last) = tree.leaf_at(e[0]), tree.leaf_at(max(e[0], e[1] - 1))
        if e[0] <= at:
            first = max(0, first - 1)
        if e[1] >= at_last + tree.sums[tree.width + last, 0]:
            last = min(tree.n - 1, last + 1)
        if regions and first <= regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], last)
            regions[-1][2].append(e)
        else:
            regions.append([first, last, [e]])
    starts = np.concatenate([[0], np.cumsum(tree.sums[tree.width : tree.width + tree.n, 0])])
    new = []
    for first, last, own in regions:
        at, end, parts = int(starts[first]), int(starts[last + 1]), []
        for s, e, r in own:
            parts += [text[at:s], r]
            at = e
        new.append("".join(parts) + text[at:end])
    cut = [leaves(s, size) for s in new]
    counts = iter(count([leaf for some in cut for leaf in some]))
    counted = [[(len(leaf), next(counts)) for leaf in some] for some in cut]
    out, at = [], 0
    for (first, last, _), s in zip(regions, new, strict=True):
        out += [text[at : int(starts[first])], s]
        at = int(starts[last + 1])
    tree.replace([(first, last, some) for (first, last, _), some in zip(regions, counted, strict=True)])
    return "".join(out) + text[at:], sum(map(len, new))


def private_spans(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), PLACEHOLDER) for m in PRIVATE.finditer(text)]


TREES = "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>"
COUNTS = "doc_id long, n_tokens long, n_edits long, n_tokens_after long, chars_after long, chars_encoded_again long"


def _encoder(path: str):
    found = encoder(path)
    if not found.by_word:
        raise ValueError(f"{path}: pre-tokens may cross white space")
    return found


def build(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Each document with the leaves of its tree (the state to keep)."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                cut = [leaves(t or "") for t in some.column(1).to_pylist()]
                counts = _encoder(path).encode([leaf for c in cut for leaf in c])[1].astype(np.int32)
                stops = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int32)
                chars = np.array([len(leaf) for c in cut for leaf in c], np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.ListArray.from_arrays(stops, chars), pa.ListArray.from_arrays(stops, counts)], names=["doc_id", "text", "leaf_chars", "leaf_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TREES)


def recount(trees: DataFrame, spans=private_spans, path: str | None = None) -> DataFrame:
    """Counts before and after the edits that ``spans`` gives for each text."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                out = []
                for doc, text, chars, tokens in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    edits = spans(text) if text else []
                    before = sum(tokens)
                    if not edits:
                        out.append((doc, before, 0, before, len(text or ""), 0))
                        continue
                    tree = Tree(chars, tokens)
                    after, again = apply_edits(text, tree, edits, lambda new: _encoder(path).encode(new)[1].tolist())
                    out.append((doc, before, len(edits), tree.tokens, len(after), again))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[f.split()[0] for f in COUNTS.split(", ")])

    return trees.mapInArrow(run, COUNTS)


def edited(trees: DataFrame, spans=private_spans, path: str | None = None) -> DataFrame:
    """The trees of the edited texts, from which later edits go on."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                texts, leaf_chars, leaf_tokens = [], [], []
                for text, chars, tokens in zip(*(c.to_pylist() for c in some.columns[1:]), strict=True):
                    if edits := spans(text) if text else []:
                        tree = Tree(chars, tokens)
                        text, _ = apply_edits(text, tree, edits, lambda new: _encoder(path).encode(new)[1].tolist())
                        kept = [(c, t) for c, t in tree.sums[tree.width : tree.width + tree.n].tolist() if c]
                        chars, tokens = [c for c, _ in kept], [t for _, t in kept]
                    texts.append(text)
                    leaf_chars.append(chars)
                    leaf_tokens.append(tokens)
                numbers = [pa.array(x, pa.list_(pa.int32())) for x in (leaf_chars, leaf_tokens)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.string()), *numbers], names=some.schema.names)

    return trees.mapInArrow(run, TREES)


def edit_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    return recount(build(docs, path), path=path)
