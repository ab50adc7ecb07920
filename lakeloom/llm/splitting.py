"""Problem 7: cut oversized texts at natural boundaries, with overlap.

Recursive bisection: a stretch that is too long is cut at the strongest boundary near its midpoint, and
its halves likewise until each fits into the limit less the overlap; then every piece but the first is
extended to the left by the overlap.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 1600, 160
#: Share of an overlap that may be given up for a word boundary.
SLACK = 0.5
#: Strength of a boundary, by what stands before it.
PARAGRAPH, SENTENCE, BLOCK, CLAUSE, WORD = 5, 4, 3, 2, 1
# fixed values: sentence ends, closing marks that may follow them, clause ends, line starts of list items, rows and headings
_ENDS, _CLOSERS, _CLAUSES, _STARTS = ".!?…。", "\"'»”’)]", ",;:—–", "|#-—–*•"
_TABLE = 0x3100
_CLASS = {"space": 1, "newline": 2, "end": 3, "closer": 4, "clause": 5, "start": 6}


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.zeros((2, _TABLE), np.uint8)  # by what a character ends, by what it starts
    for c in range(_TABLE):
        ch = chr(c)
        out[0, c] = _CLASS["newline"] if ch in "\n\r\x0b\x0c\x85  " else _CLASS["space"] if ch.isspace() else _CLASS["end"] if ch in _ENDS else _CLASS["closer"] if ch in _CLOSERS else _CLASS["clause"] if ch in _CLAUSES else 0
        out[1, c] = _CLASS["start"] if ch in _STARTS else 0
    return out


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a piece may end, in order, and the strength of each. White space belongs to the left."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = np.minimum(cp, _TABLE - 1)
    kind = np.where(cp < _TABLE, _classes()[0][low], 0)
    white = (kind == 1) | (kind == 2)
    at = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    if not len(at):
        return at, at
    begin = np.flatnonzero(np.diff(np.concatenate([[False], white]).astype(np.int8)) == 1)
    first = begin[np.searchsorted(begin, at, "left") - 1]
    feeds = np.cumsum(np.concatenate([[0], (cp == 10) | ((cp == 13) & (np.append(cp[1:], 0) != 10))]))
    lines = feeds[at] - feeds[first]
    before = kind[np.maximum(first - 1, 0)]
    before2 = kind[np.maximum(first - 2, 0)]
    ends = (before == 3) | ((before == 4) & (before2 == 3))
    next_start = np.where(cp[at] < _TABLE, _classes()[1][low[at]], 0) == 6
    strength = np.select([lines >= 2, ends, (lines >= 1) & next_start, before == 5], [PARAGRAPH, SENTENCE, BLOCK, CLAUSE], WORD)
    return at, strength


def _plain_cut(text: str, at: int) -> int:
    """A cut without any boundary, moved off combining marks and out of CR LF."""
    while at > 1 and (unicodedata.combining(text[at]) or text[at - 1 : at + 1] == "\r\n" or text[at] in "‍️"):
        at -= 1
    return at


def piece_spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Half-open spans of the pieces of ``text``, in order; together they cover it."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    room = limit - overlap
    at, strength = boundaries(text)
    leaves, todo = [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= room:
            leaves.append((lo, hi))
            continue
        mid, quarter = (lo + hi) // 2, max(1, (hi - lo) // 4)
        i, j = np.searchsorted(at, lo + quarter), np.searchsorted(at, hi - quarter, "right")
        if i == j:  # no boundary in the middle half: any other one, so that it lies inside
            i, j = np.searchsorted(at, lo, "right"), np.searchsorted(at, hi)
        if i < j:
            near = np.abs(at[i:j] - mid)
            cut = int(at[i + int(np.lexsort((near, -strength[i:j]))[0])])
        else:
            cut = max(lo + 1, _plain_cut(text, mid))
        todo += [(cut, hi), (lo, cut)]  # the left half is popped first
    out = [leaves[0]]
    for lo, hi in leaves[1:]:
        want = max(lo - overlap, 0)
        k = np.searchsorted(at, want)
        start = int(at[k]) if k < len(at) and at[k] <= want + overlap * SLACK and at[k] < lo else want
        out.append((start, hi))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))


def split_items(df: DataFrame, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """All columns of ``df`` but the text, and ``piece_no`` (from 0), ``n_pieces, char_start, char_end, piece``.

    A piece has at most ``limit`` characters; a text within the limit is one piece, as is the empty text;
    a null text gives no piece. Repeated rows are each cut. Columns of the input by these names are replaced.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    @F.pandas_udf(_SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"s": s, "e": e} for s, e in piece_spans(t, limit, overlap)])

    spans = spans.asNondeterministic()  # else the optimizer evaluates it once for each use of its result
    col = F.col(f"`{text}`")
    new = ["piece_no", "n_pieces", "char_start", "char_end", "piece"]
    keep = [c for c in df.columns if c != text and c not in new]
    # only long texts travel to Python; a text that fits is its own piece
    cut = df.where(col.isNotNull()).select(*[F.col(f"`{c}`") for c in keep], col.alias("_text"), spans(F.when(F.length(col) > limit, col)).alias("_far"))
    one = cut.select(*[F.col(f"`{c}`") for c in keep], "_text", F.coalesce("_far", F.transform(F.array(F.length("_text")), lambda n: F.struct(F.lit(0).alias("s"), n.alias("e")))).alias("_spans"))
    wide = one.select(*[F.col(f"`{c}`") for c in keep], "_text", F.size("_spans").alias("n_pieces"), F.posexplode("_spans").alias("piece_no", "_span"))
    return wide.select(
        *[F.col(f"`{c}`") for c in keep], "piece_no", "n_pieces", F.col("_span.s").alias("char_start"), F.col("_span.e").alias("char_end"),
        F.substring("_text", F.col("_span.s") + 1, F.col("_span.e") - F.col("_span.s")).alias("piece"),
    )


def corpus_items(pages: DataFrame, cases: DataFrame) -> DataFrame:
    """``item_kind, item_id, text`` of PDF pages and of documents to summarize; repeats stay."""
    a = pages.select(F.lit("pdf_page").alias("item_kind"), F.col("page_id").cast("string").alias("item_id"), "text")
    return a.unionByName(cases.select(F.lit("summarization_case").alias("item_kind"), F.col("id").alias("item_id"), F.col("document").alias("text")))
