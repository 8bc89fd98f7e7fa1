"""String similarity for entity names, 0 to 100.

``ratio`` is the normalised indel similarity: twice the longest common subsequence over both
lengths. The composite is the best of a weighted ratio, a word-order-free ratio, a best-window
ratio without case, and the ratio of metaphone keys.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@lru_cache(65536)
def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = " ".join(filter(None, (both, " ".join(sorted(x - y))))), " ".join(filter(None, (both, " ".join(sorted(y - x)))))
    if both and (x <= y or y <= x):
        return 100.0
    return max(ratio(one, two), *((ratio(both, one), ratio(both, two)) if both else (0.0,)))


@lru_cache(65536)
def partial(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of its length of the longer one, or a shorter one at either end; of equal lengths, both ways."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    ways = [(short, long), (long, short)] if len(short) == len(long) else [(short, long)]
    n = len(short)
    return max(ratio(x, w) for x, y in ways for w in {y[max(0, i) : i + n] for i in range(1 - n, len(y))} if w)


def partial_tokens(a: str, b: str) -> float:
    """100 with a word in common, else the partial ratio of the sorted words, repeated words once or as often as they come."""
    x, y = a.split(), b.split()
    if not x or not y:
        return 0.0
    if set(x) & set(y):
        return 100.0
    return max(partial(" ".join(sorted(u)), " ".join(sorted(v))) for u, v in ((x, y), (set(x), set(y))))


def weighted(a: str, b: str) -> float:
    """Whole, token and partial ratios, partial ones weighed by how unlike the lengths are."""
    if not a or not b:
        return 0.0
    by = max(len(a), len(b)) / min(len(a), len(b))
    if by < 1.5:
        return max(ratio(a, b), 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if by <= 8 else 0.6
    return max(ratio(a, b), scale * partial(a, b), 0.95 * scale * partial_tokens(a, b))


VOWELS, SOFT = "aeiou", "iey"
#: Letters that sound alone as the key has them. Fixed values.
PLAIN = {"f": "F", "j": "J", "l": "L", "m": "M", "n": "N", "r": "R", "q": "K", "v": "F", "z": "S"}


def _sound(before: str, c: str, after: str, start: bool) -> tuple[str, int]:
    """The sound of letter ``c`` between what comes before and after it, and how many letters it takes."""
    nxt, two = after[:1], after[:2]
    io = len(two) == 2 and two[0] == "i" and two[1] in "oa"
    match c:
        case "b":
            return ("" if before == "m" and not nxt else "B"), 1
        case "c":
            if two == "ia" or nxt == "h":
                return "X", 2
            return ("S", 2) if nxt and nxt in SOFT else ("K", 1)
        case "d":
            return ("J", 3) if nxt == "g" and two[1:] and two[1:] in SOFT else ("T", 1)
        case "g":
            if nxt and nxt in SOFT:
                return "J", 1
            if nxt == "h" and two[1:] and two[1:] not in VOWELS or two == "n":
                return "", 2
            return "K", 1
        case "h":
            return ("H" if start or nxt and nxt in VOWELS or before not in VOWELS else ""), 1
        case "k":
            return ("" if before == "c" else "K"), 1
        case "p":
            return ("F", 2) if nxt == "h" else ("P", 1)
        case "s":
            return ("X", 2) if nxt == "h" else ("X", 3) if io else ("S", 1)
        case "t":
            if nxt == "h":
                return "0", 2
            return ("X" if io else "" if two == "ch" else "T"), 1
        case "w":
            at = 1 if start and nxt == "h" else 0
            return ("W" if after[at : at + 1] and after[at : at + 1] in VOWELS else ""), 1 + at
        case "x":
            return ("KS" if not start else "X" if nxt == "h" or io else "S"), 1
        case "y":
            return ("Y" if nxt and nxt in VOWELS else ""), 1
    return PLAIN.get(c, ""), 1


@lru_cache(65536)
def metaphone(s: str) -> str:
    """The key of how words sound: consonant classes, vowels only where a word begins."""
    out = []
    for word in s.lower().split():
        word = word[1:] if word[:2] in ("kn", "gn", "pn", "wr", "ae") else word
        key, i = "", 0
        while i < len(word):
            c, before = word[i], word[i - 1] if i else " "
            if c == before and c != "c":
                i += 1
            elif c in VOWELS:
                key += "" if i else c.upper()
                i += 1
            else:
                sound, taken = _sound(before, c, word[i + 1 :], i == 0)
                key += sound
                i += taken
        out.append(key)
    return " ".join(filter(None, out))


def skeleton(s: str) -> str:
    low = s.lower()
    return re.sub(r"(.)\1+", r"\1", low[:1] + re.sub("[aeiou]", "", low[1:]))


def composite(mention: str, name: str) -> float:
    sound = metaphone(mention)
    return max(weighted(mention, name), token_sort(mention, name), partial(mention.lower(), name.lower()), ratio(sound, metaphone(name)) if sound else 0.0)


@F.pandas_udf(DoubleType())
def composite_score(mention: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([composite(a or "", b or "") for a, b in zip(mention, name, strict=True)], dtype="float64")


@F.pandas_udf(StringType())
def metaphone_key(names: pd.Series) -> pd.Series:
    return names.map(lambda x: metaphone(x or ""))
