"""Batch encoding with a public tokenizer through a bounded per-process word table.

A vocabulary whose pre-tokenizer never crosses white space gives a text the concatenated ids of its white-space
words. Each distinct word is therefore encoded once by the ``tokenizers`` library and looked up afterwards. For any
other tokenizer file the whole text goes to the library.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from .common import KEPT

WORD_FILE = "word_bpe_49k.json"
END_ID = 2
TABLE_WORDS = 1_000_000
LONGEST_WORD = 64
#: Closing marks that form a pre-token of their own after a letter.
TAIL = ".,!?;:*&%$#"
#: str.split() takes these for white space; the vocabulary does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"


def tokenizer_path(name: str = WORD_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def breaks_at_space(spec: dict) -> bool:
    """Whether the file drops white space between pre-tokens, so that words can be encoded one by one."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return (
        [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1].get("pattern", {}).get("Regex") == "\\s+"
        and split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and "\\s" in split.get("pattern", {}).get("Regex", "")
    )


class _Index(dict):
    """Word to row number; a new word gets the next number and joins ``fresh``."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = breaks_at_space(json.load(f))
        self.closing: dict[str, bool] = {}  # by the last character of a word
        self.reset()

    def _closes(self, letter: str) -> bool:
        """Whether closing marks behind this letter are a pre-token of their own, as the library itself cuts them. Not
        so where the normaliser ends it in a combining mark ("İ" becomes "i" and U+0307), nor where the library's
        tables do not know it as a letter."""
        if letter not in self.closing:
            text = self.library.normalizer.normalize_str(letter + ".")
            self.closing[letter] = letter.isalpha() and self.library.pre_tokenizer.pre_tokenize_str(text)[-1][0] == "."
        return self.closing[letter]

    def reset(self) -> None:
        self.index = _Index()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.counts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.known = 0

    def _library(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids one after another, and the number of each word's. A lower-case ASCII word of letters is one pre-token
        that no normaliser changes, so the library's BPE model takes it without the steps before."""
        flat: list[int] = []
        counts: list[int] = []
        plain, tokenize = self.by_word, self.library.model.tokenize
        rest = [w for w in words if not (plain and w.isascii() and w.isalpha() and w.islower())]
        others = iter(self.library.encode_batch_fast(rest, add_special_tokens=False))
        for w in words:
            if plain and w.isascii() and w.isalpha() and w.islower():
                ids = [t.id for t in tokenize(w)]
            else:
                ids = next(others).ids
            flat += ids
            counts.append(len(ids))
        return flat, counts

    def _append(self, rows: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[rows], self.counts[rows] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(ids)

    def _gather(self, starts: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> np.ndarray:
        stops = np.cumsum(counts)
        total = int(stops[-1]) if len(stops) else 0
        return flat[np.arange(total, dtype=np.int64) + np.repeat(starts - (stops - counts), counts)]

    def _resolve(self) -> None:
        """Fill the rows of fresh words. A word that ends in closing marks behind a letter is its core followed by the marks; a
        capitalised Latin core has the ids of its lower-case form, as the normaliser lower-cases."""
        index = self.index
        fresh, index.fresh = index.fresh, []
        if not fresh:
            return
        direct_rows: list[int] = []
        direct: list[str] = []
        pairs: list[tuple[int, int, int]] = []  # row, row of its core, row of its marks (or -1)
        while fresh:
            for w in fresh:
                row = index[w]
                core = w.rstrip(TAIL)
                low = core
                if core and not core.islower() and core.isalpha() and (core.isascii() or (max(core) < "ɐ" and "İ" not in core)):
                    low = core.lower()
                if len(core) < len(w) and core and self._closes(core[-1]):
                    pairs.append((row, index[low], index[w[len(core) :]]))
                elif low != w and core == w:
                    pairs.append((row, index[low], -1))
                else:
                    direct_rows.append(row)
                    direct.append(w)
            fresh, index.fresh = index.fresh, []
        while len(index) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        ids, counts = self._library(direct)
        self._append(np.array(direct_rows, np.int64), np.array(ids, np.uint32), np.array(counts, np.int64))
        if pairs:
            p = np.array(pairs, np.int64)
            bare = p[:, 2] < 0  # a core that is a pair itself is a bare one
            for some in (p[bare], p[~bare]):
                two = some[:, 1:].copy()
                starts, counts = self.starts[two], self.counts[two].astype(np.int64)
                counts[two < 0] = 0
                self._append(some[:, 0], self._gather(starts.ravel(), counts.ravel(), self.flat), counts.sum(1))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another (uint32) and the number of ids of each text."""
        if not self.by_word:
            ids, counts = self._library(texts)
            return np.array(ids, np.uint32), np.array(counts, np.int64)
        if len(self.index) > TABLE_WORDS:
            self.reset()
        words: list[str] = []
        ends = np.zeros(len(texts), np.int64)
        whole: dict[int, str] = {}  # places of what is encoded without entering the table
        for i, t in enumerate(texts):
            if any(c in t for c in NOT_SPACE):  # str.split() breaks there and the vocabulary does not
                whole[len(words)] = t
                words.append("")
            else:
                words += t.split()
            ends[i] = len(words)
        if words and max(map(len, words)) > LONGEST_WORD:
            for i, w in enumerate(words):
                if len(w) > LONGEST_WORD:
                    whole[i], words[i] = w, ""
        rows = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        self._resolve()
        starts, counts, flat = self.starts[rows], self.counts[rows].astype(np.int64), self.flat
        if whole:
            ids, size = self._library(list(whole.values()))
            at, size = np.fromiter(whole, np.int64, len(whole)), np.array(size, np.int64)
            starts[at], counts[at] = self.used + np.cumsum(size) - size, size
            flat = np.concatenate([flat[: self.used], np.array(ids, np.uint32)])
        upto = np.concatenate([[0], np.cumsum(counts)])[ends]
        return self._gather(starts, counts, flat), np.diff(np.concatenate([[0], upto]))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder in each Python worker, kept until another operator's tasks come."""
    return Encoder(path)


KEPT.append(encoder.cache_clear)


def encode_with_end(path: str, texts: list[str], end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """As :meth:`Encoder.encode`, with ``end_id`` after each text."""
    ids, counts = encoder(path).encode(texts)
    ends = np.cumsum(counts)
    return np.insert(ids, ends, np.uint32(end_id)), counts + 1
