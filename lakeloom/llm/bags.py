"""Bags of words: what problems 4 and 5 share.

Two texts are similar if the words in common, repeats included, are at least ``share`` of the words of
the longer one. The k-th repeat of a word in a text is a token of its own, so bags become sets of 63-bit
hashes. Nothing here depends on how often a word occurs or how large the corpus is.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import xxhash

SHARE = 0.85
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


def common(n: int, share: float = SHARE) -> int:
    """The least number of common words for texts of which the longer one has ``n``."""
    return math.ceil(share * n - 1e-9)


class Hasher:
    """63-bit hashes of the tokens of a bag; hashes of words already met are kept, up to a bound."""

    def __init__(self, bound: int = 500_000) -> None:
        self.known: dict[str, int] = {}
        self.bound = bound

    def __call__(self, found: list[str]) -> list[int]:
        if len(self.known) > self.bound:
            self.known.clear()
        out, seen = [], {}
        known = self.known
        for w in found:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w) >> 1
            k = seen.get(w, 0)
            seen[w] = k + 1
            out.append(h if not k else (h * (2 * k + 1) + k * 0x9E3779B97F4A7C15) & 0x7FFFFFFFFFFFFFFF)
        return out


def overlap(a: list[str], b: list[str]) -> int:
    """Words in common, repeats included."""
    return (Counter(a) & Counter(b)).total()


def bag_name(tokens: list[int]) -> bytes:
    """Name of the class of all texts with the same bag."""
    return xxhash.xxh3_128_digest(np.sort(np.array(tokens, np.int64)).tobytes())
