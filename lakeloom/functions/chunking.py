"""Chunk strategies as spans of a text; ``size`` is a hard cap for each of them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int]
_SENTENCE = re.compile(r"[.!?…]+[\"'»”’)]*(?=\s|$)")
_HEADING = re.compile(r"(?m)^(#{1,6})[ \t]+\S.*$")
_ROW = re.compile(r"(?m)^[ \t]*\|.*$")
#: separators of the recursive strategy, the coarsest first
SEPARATORS = ("\n\n", "\n", " ")


def windows(start: int, end: int, size: int, overlap: int) -> list[Span]:
    """Sliding windows over [start, end); the last one is the first to reach the end."""
    step = size - overlap
    return [(start + i * step, min(start + i * step + size, end)) for i in range(max(0, -(-(end - start - size) // step)) + 1)] if end > start else []


def pack(spans: list[Span], size: int, overlap: int = 0) -> list[Span]:
    """Join neighbouring spans while they fit; a span that alone is too long is cut into windows."""
    out: list[Span] = []
    for s, e in spans:
        if out and e - out[-1][0] <= size:
            out[-1] = (out[-1][0], e)
        elif e - s > size:
            out += windows(s, e, size, overlap)
        else:
            out.append((s, e))
    return out


def sentences(text: str) -> list[Span]:
    cuts = [m.end() for m in _SENTENCE.finditer(text)] + [len(text)]
    out, at = [], 0
    for c in cuts:
        if text[at:c].strip():
            out.append((at, c))
        at = max(at, c)
    return out


def recursive(text: str, start: int, end: int, size: int, overlap: int, level: int = 0) -> list[Span]:
    """Cut at the coarsest separator, go on with finer ones where a part is still too long, then pack."""
    if end - start <= size:
        return [(start, end)] if text[start:end].strip() else []
    if level == len(SEPARATORS):
        return windows(start, end, size, overlap)
    parts, at = [], start
    for m in re.finditer(re.escape(SEPARATORS[level]), text[start:end]):
        parts.append((at, start + m.end()))
        at = start + m.end()
    parts.append((at, end))
    out: list[Span] = []
    for s, e in parts:
        out += [(s, e)] if e - s <= size else recursive(text, s, e, size, overlap, level + 1)
    return [x for x in pack([p for p in out if p[0] < p[1]], size, overlap) if text[x[0] : x[1]].strip()]


def sections(text: str) -> list[tuple[int, int, str]]:
    """(start, end, breadcrumb of headings) of the text before the first heading and of every section."""
    found = list(_HEADING.finditer(text))
    out, path = [], []
    if not found or text[: found[0].start()].strip():
        out.append((0, found[0].start() if found else len(text), ""))
    for m, after in zip(found, [*found[1:], None]):
        level = len(m[1])
        path = [p for p in path if p[0] < level] + [(level, m[0].lstrip("#").strip())]
        out.append((m.start(), after.start() if after else len(text), " > ".join(t for _, t in path)))
    return out


def tables(text: str) -> list[Span]:
    """Stretches of table rows of which the second is a delimiter row."""
    out, rows = [], [m.span() for m in _ROW.finditer(text)]
    i = 0
    while i < len(rows):
        j = i
        while j + 1 < len(rows) and rows[j + 1][0] == rows[j][1] + 1:
            j += 1
        if j > i and re.fullmatch(r"[\s|:\-]+", text[slice(*rows[i + 1])]) and "-" in text[slice(*rows[i + 1])]:
            out.append((rows[i][0], rows[j][1]))
        i = j + 1
    return out


def chunk_spans(text: str, strategy: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, breadcrumb) by ``sentence``, ``recursive``, ``markdown`` or ``table``."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    if not text.strip():
        return []
    if strategy == "sentence":
        return [(s, e, "") for s, e in pack(sentences(text), size, overlap)]
    if strategy == "recursive":
        return [(s, e, "") for s, e in recursive(text, 0, len(text), size, overlap)]
    if strategy == "markdown":
        return [(a, b, crumb) for s, e, crumb in sections(text) for a, b in recursive(text, s, e, size, overlap)]
    if strategy == "table":
        out, at = [], 0
        for s, e in [*tables(text), (len(text), len(text))]:
            out += [(a, b, "") for a, b in recursive(text, at, s, size, overlap)]
            rows = [(s + m.start(), s + m.end()) for m in re.finditer(r".+", text[s:e])]
            out += [(a, b, "table") for a, b in pack(rows, size, overlap)]
            at = e
        return out
    raise ValueError(f"unknown strategy {strategy}")


def chunked(df: DataFrame, key: str, text: str, strategy: str, size: int = 800, overlap: int = 120) -> DataFrame:
    """``key, chunk_id, char_start, char_end, headers, text`` of every chunk. Null and blank texts have none."""

    @F.pandas_udf("array<struct<s:int,e:int,h:string>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"s": s, "e": e, "h": h} for s, e, h in chunk_spans(t or "", strategy, size, overlap)])

    rows = df.select(F.col(key), F.col(text).alias("_t"), spans(F.col(text)).alias("_s")).select(key, "_t", F.posexplode("_s").alias("_n", "_c"))
    return rows.select(key, F.format_string(f"%s#{strategy}#%04d", F.col(key).cast("string"), "_n").alias("chunk_id"), F.col("_c.s").alias("char_start"), F.col("_c.e").alias("char_end"), F.col("_c.h").alias("headers"), F.substring("_t", F.col("_c.s") + 1, F.col("_c.e") - F.col("_c.s")).alias("text"))
