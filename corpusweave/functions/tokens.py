"""Token counters: word pieces by greedy longest match over a vocabulary file or set.

Texts are cleaned and split as such vocabularies expect: control characters dropped, lower case
without accents, and every punctuation mark and CJK letter a word of its own. A word with no
division into pieces, or of over ``LONGEST`` characters, is one unknown token. Words never span white
space, so counts add up over white-space words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Collection

import pandas as pd
from pyspark.sql import functions as F

LONGEST, KEPT = 100, 1 << 18
#: CJK blocks whose letters stand alone. Fixed values.
CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


def _alone(c: str) -> bool:
    return not c.isalnum() and (c.isascii() or unicodedata.category(c)[0] == "P") or any(lo <= ord(c) <= hi for lo, hi in CJK)


class _Table(dict):
    """A translation table whose entries are worked out as characters come up."""

    def __init__(self, of: Callable[[str], str | None]):
        super().__init__()
        self.of = of

    def __missing__(self, code: int) -> str | None:
        self[code] = out = self.of(chr(code))
        return out


_KEPT = _Table(lambda c: " " if c.isspace() else None if unicodedata.category(c)[0] == "C" or c == "�" else c)
_BARE = _Table(lambda c: None if unicodedata.category(c) == "Mn" else f" {c} " if c != " " and _alone(c) else c)


def split_words(text: str) -> list[str]:
    """The words that are cut into pieces."""
    return unicodedata.normalize("NFD", text.translate(_KEPT).lower()).translate(_BARE).split()


def read_vocabulary(path: str) -> frozenset[str]:
    """One piece a line; pieces within words begin with ``##``."""
    with open(path, encoding="utf-8") as lines:
        return frozenset(line.rstrip("\n") for line in lines)


def letter_vocabulary() -> frozenset[str]:
    """The least vocabulary that divides ASCII words: each letter, digit and mark, at a word's start and within."""
    signs = [chr(c) for c in range(33, 127)]
    return frozenset(signs + [f"##{c}" for c in signs])


class WordPieces:
    """A counter of a text's pieces, without special tokens; counts of white-space words are kept."""

    def __init__(self, vocabulary: Collection[str]):
        self.known, self.counts = frozenset(vocabulary), {}
        self.within = frozenset(p[2:] for p in self.known if p.startswith("##"))
        self.longest = [max(map(len, pieces), default=0) for pieces in (self.known, self.within)]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": {}}

    def pieces(self, word: str) -> int:
        size, n, at, known, longest = len(word), 0, 0, self.known, self.longest[0]
        while at < size <= LONGEST:
            for end in range(min(size, at + longest), at, -1):
                if word[at:end] in known:
                    break
            else:
                return 1
            n, at, known, longest = n + 1, end, self.within, self.longest[1]
        return n or 1

    def __call__(self, text: str) -> int:
        total, counts = 0, self.counts
        for word in text.split():
            if (n := counts.get(word)) is None:
                if len(counts) >= KEPT:
                    counts.clear()
                n = counts[word] = sum(map(self.pieces, split_words(word)))
            total += n
        return total


def counted(count: Callable[[str], int]):
    """A column function: a text's number of tokens."""

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count(t or "")).astype("int64")

    return tokens
