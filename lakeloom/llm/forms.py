"""Problem 6: one consistent form for texts that look the same but differ in characters.

A batch of Arrow texts becomes one numpy array of code points. Lookup tables, indexed by code point, map
full-width forms and spaces and mark invisible characters; the few characters that stand for two are
spread by expansion offsets; look-alike letters take the script of their word; base letters and combining
marks are composed by a search in a sorted key table. No step calls a string method per row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Kinds of difference, as bits.
FULLWIDTH, ACCENT, INVISIBLE, SPACE, LOOKALIKE = 1, 2, 4, 8, 16
_SIZE = 0x110000

# fixed values: Latin letters and the Cyrillic letters that look like them
_LATIN, _CYRILLIC = "aceiopxyjsABCEHIKMOPTXJSYïëÏË", "асеіорхујѕАВСЕНІКМОРТХЈЅУїёЇЁ"
# fixed values: Greek letters that look like a Cyrillic and a Latin letter
_GREEK, _GREEK_C, _GREEK_L = "οικρχυανΑΒΕΗΙΚΜΝΟΡΤΥΧ", "оікрхуаѵАВЕНІКМNОРТУХ", "oikpxyavABEHIKMNOPTYX"
# fixed values: invisible characters, as ranges
_INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0x1BCA0, 0x1BCA3), (0xE0000, 0xE0FFF))
_ROMAN = "IVXLCDM"

# letter classes
_CYR, _LAT, _GRE, _CYR_SHARED, _LAT_SHARED, _GRE_SHARED, _MARK = 1, 2, 3, 4, 5, 6, 7


@lru_cache(1)
def _tables() -> dict[str, np.ndarray]:
    to = np.arange(_SIZE, dtype=np.uint32)
    second = np.zeros(_SIZE, np.uint32)
    kind = np.zeros(_SIZE, np.uint8)
    for c in range(0xFF01, 0xFFE7):  # by rule: the compatibility form of a full-width or half-width one
        form = unicodedata.normalize("NFKC", chr(c))
        if unicodedata.east_asian_width(chr(c)) in "FH" and len(form) == 1 and form != chr(c):
            to[c], kind[c] = ord(form), FULLWIDTH
    for c in range(0x80, 0x3001):
        if unicodedata.category(chr(c)) == "Zs":
            to[c], kind[c] = 0x20, SPACE
    for lo, hi in _INVISIBLE:
        kind[lo : hi + 1] = INVISIBLE
    for c in (*range(9), 0xB, 0xC, *range(0xE, 0x20), 0x7F):
        kind[c] = INVISIBLE
    for c in range(0xFB00, 0xFB07):  # typographic ligatures
        form = unicodedata.normalize("NFKC", chr(c))[:2]
        to[c], second[c] = ord(form[0]), ord(form[1])
    letters = np.zeros(_SIZE, np.uint8)
    upper = np.zeros(_SIZE, bool)
    base, marks, composed = [], [], []
    for c in range(0x41, 0x3000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            name = unicodedata.name(ch, "")
            letters[c] = _LAT if name.startswith("LATIN") else _CYR if name.startswith("CYRILLIC") else _GRE if name.startswith("GREEK") else 0
            upper[c] = ch.isupper()
        elif unicodedata.category(ch) == "Mn":
            letters[c] = _MARK
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            base.append(int(parts[0], 16)), marks.append(int(parts[1], 16)), composed.append(c)
    cyr, lat = np.arange(_SIZE, dtype=np.uint32), np.arange(_SIZE, dtype=np.uint32)
    for a, b in zip(_LATIN, _CYRILLIC):
        letters[ord(a)], letters[ord(b)], cyr[ord(a)], lat[ord(b)] = _LAT_SHARED, _CYR_SHARED, ord(b), ord(a)
    for g, c, a in zip(_GREEK, _GREEK_C, _GREEK_L):
        letters[ord(g)], cyr[ord(g)], lat[ord(g)] = _GRE_SHARED, ord(c), ord(a)
    roman = np.zeros(_SIZE, bool)
    roman[[ord(c) for c in _ROMAN]] = True
    roman[[ord(b) for a, b in zip(_LATIN, _CYRILLIC) if a in _ROMAN]] = True
    keys = np.array(base, np.uint64) << np.uint64(21) | np.array(marks, np.uint64)
    order = np.argsort(keys)
    combining = np.zeros(_SIZE, bool)
    combining[np.unique(marks)] = True
    return {"to": to, "second": second, "kind": kind, "letters": letters, "upper": upper, "cyr": cyr, "lat": lat, "roman": roman, "keys": keys[order], "composed": np.array(composed, np.uint32)[order], "combining": combining}


def _unify_scripts(cp: np.ndarray, row: np.ndarray, flags: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Give every look-alike letter the script of its word, or of its text where the word doesn't tell."""
    cls = t["letters"][cp]
    inside = cls > 0
    if not inside.any():
        return cp
    edge = np.concatenate([[True], (row[1:] != row[:-1])])
    start = inside & (edge | ~np.concatenate([[False], inside[:-1]]))
    at = np.flatnonzero(inside)
    word = np.cumsum(start)[at] - 1
    n = int(start.sum())
    kinds, codes, rows = cls[at], cp[at], row[at]
    count = np.bincount(word * 8 + kinds, minlength=n * 8).reshape(n, 8)
    total = count[:, 1:7].sum(1)
    caps = np.bincount(word, t["upper"][codes], n) == total
    roman = np.bincount(word, t["roman"][codes], n) == total
    owner = np.zeros(n, row.dtype)
    owner[word] = rows
    text = np.bincount(rows[kinds < 7] * 8 + kinds[kinds < 7], minlength=len(flags) * 8).reshape(-1, 8)
    weigh = lambda own, shared: 2 * text[:, own] + text[:, shared]  # noqa: E731  (a shared letter tells less)
    cyr_text = (weigh(_CYR, _CYR_SHARED) > weigh(_LAT, _LAT_SHARED))[owner]
    lat_text = ~cyr_text & (weigh(_LAT, _LAT_SHARED) > 0)[owner]
    own_cyr, own_lat, own_gre = count[:, _CYR] > 0, count[:, _LAT] > 0, count[:, _GRE] > 0
    shared = (count[:, _CYR_SHARED] > 0).astype(int) + (count[:, _LAT_SHARED] > 0) + (count[:, _GRE_SHARED] > 0)
    none = ~own_cyr & ~own_lat & ~own_gre
    numeral = none & caps & roman & (total > 1) & (count[:, _LAT_SHARED] > 0)
    # capitals of one script stay: abbreviations, numerals, names of classes
    free = none & ~numeral & ((shared > 1) | ~caps | ((count[:, _GRE_SHARED] > 0) & ~((text[:, _GRE] > 0)[owner])))
    to_cyr = (own_cyr & ~own_lat & ~own_gre) | (free & cyr_text)
    to_lat = (own_lat & ~own_cyr & ~own_gre) | (free & ~cyr_text & lat_text) | numeral
    new = np.where(to_cyr[word], t["cyr"][codes], np.where(to_lat[word], t["lat"][codes], codes))
    changed = new != codes
    flags[rows[changed]] |= LOOKALIKE
    out = cp.copy()
    out[at] = new
    return out


def unify(cp: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points and their rows in the consistent form, and the kinds of difference of each row."""
    t = _tables()
    flags = np.zeros(n_rows, np.uint8)
    kind = t["kind"][cp]
    odd = np.flatnonzero(kind)
    np.bitwise_or.at(flags, row[odd], kind[odd])
    keep = kind != INVISIBLE
    cp, row = cp[keep], row[keep]
    more = t["second"][cp]
    cp = t["to"][cp]
    if more.any():  # expansion offsets: every character moves by the number of expansions before it
        wide = more > 0
        place = np.arange(len(cp)) + np.cumsum(wide) - wide
        spread, rows = np.zeros(len(cp) + int(wide.sum()), cp.dtype), np.zeros(len(cp) + int(wide.sum()), row.dtype)
        spread[place], rows[place] = cp, row
        spread[place[wide] + 1], rows[place[wide] + 1] = more[wide], row[wide]
        cp, row = spread, rows
    cp = _unify_scripts(cp, row, flags, t)
    while len(cp) > 1:
        mark = np.flatnonzero(t["combining"][cp[1:]] & (row[1:] == row[:-1])) + 1
        if not len(mark):
            break
        key = cp[mark - 1].astype(np.uint64) << np.uint64(21) | cp[mark].astype(np.uint64)
        found = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        hit = t["keys"][found] == key
        mark, found = mark[hit], found[hit]
        if not len(mark):
            break
        cp = cp.copy()
        cp[mark - 1] = t["composed"][found]
        flags[row[mark]] |= ACCENT
        keep = np.ones(len(cp), bool)
        keep[mark] = False
        cp, row = cp[keep], row[keep]
    return cp, row, flags


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a batch of strings, and the row of each."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if data is not None and offsets[-1] > offsets[0] else b""
    octets = np.frombuffer(raw, np.uint8)
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
    starts = np.concatenate([[0], np.cumsum((octets & 0xC0) != 0x80)])[offsets - offsets[0]]
    return cp, np.repeat(np.arange(len(texts)), np.diff(starts))


def to_strings(cp: np.ndarray, row: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Strings of the rows; rows that aren't valid are null."""
    raw = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    sizes = np.zeros(len(valid), np.int64)
    np.add.at(sizes, row, width)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    bits = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(valid), [bits, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)]).cast(pa.string())


def unify_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts in one form, and the kinds of difference of each; a null text stays null."""
    cp, row = code_points(texts)
    valid = np.asarray(texts.is_valid())
    cp, row, flags = unify(cp, row, len(texts))
    return to_strings(cp, row, valid), flags


def consistent(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with each of the columns in one form, and a column ``<name>_kinds`` with the bits of what differed.

    Null stays null with kinds 0, the empty text stays empty. Repeated rows and all other columns are kept;
    a column of the input named like an added one is replaced.
    """
    kinds = [f"{c}_kinds" for c in columns]
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in kinds])
    schema = StructType([StructField(f.name, f.dataType, True) for f in df.schema] + [StructField(k, IntegerType()) for k in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = dict(zip(b.schema.names, b.columns))
            for c in columns:
                arrays[c], flags = unify_texts(arrays[c])
                arrays[f"{c}_kinds"] = pa.array(flags.astype(np.int32))
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    return df.mapInArrow(run, schema)
