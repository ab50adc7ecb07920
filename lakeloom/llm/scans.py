"""Problem 1: repair text read from scanned pages.

1. Words of the whole corpus are counted; the frequent ones, at least a fixed share of all words and so a
   bounded number, are the dictionary.
2. Skip-gram vectors of the dictionary are learned by negative sampling: every partition makes gradient steps
   on its own pairs from a common start, and the vectors are averaged over partitions by the words' counts.
3. A word outside the dictionary is linked to the dictionary words that plausible glyph edits lead to, a rare one of the
   dictionary only to those that are its neighbours by the vectors too; of several the one that fits the context best corrects it.
4. Running lines are edge lines whose letters recur at the edges of other pages of the document, or of nearby pages;
   page numbers are numbers at the edges that run with the pages of the document or of a stretch of it. They are removed, cut words are joined, lines are reflowed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

#: Least share of all words that a dictionary word has: at most 50,000 words, about 7 MB with their vectors.
MIN_SHARE, MIN_COUNT = 2e-5, 4
#: A word so many times rarer than a glyph neighbour is taken for its misreading.
RARER = 20
#: Cosine of the vectors of two dictionary words from which they are neighbours.
NEAR = 0.25
DIM, SPAN, NEGATIVE, EPOCHS, STEPS, RATE = 16, 2, 3, 2, 40, 0.2
#: Pages that a task holds as Python objects at a time.
SLICE = 2000
#: Lines looked at on either edge of a page.
EDGE = 2
#: Stretches of two blocks of so many pages, each begun a block after the last; least pages of one on which a line or shift recurs.
BLOCK_PAGES, LOCAL = 8, 3
KINDS = ("hyphenation", "misread", "header", "page_number")

# fixed values: misread forms of letters, as printed letter and what is read
_EDITS = (("и", "н"), ("н", "ы"), ("в", "з"), ("т", "г"), ("й", "и"), ("ь", "ъ"), ("п", "н"), ("є", "е"), ("ц", "п"), ("х", "и"), ("и", "ы"), ("о", "0"), ("л", "/i"), ("і", "1"), ("і", "!"), ("з", "3"), ("ч", "4"), ("ж", ">к"), ("ш", "|||"), ("б", "6"), ("ю", "lо"), ("и", "i"), ("е", "c"), ("в", "8"), ("і", "l"), ("і", "|"))
# fixed values: characters that end a line in which a word is cut
_CUT = "-‐‑¬\xad"
_ENDS = tuple(_CUT)
_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ][^\W\d_]+)*")
_LISTED = re.compile(r"\s*(?:\||#{1,6}\s|[—–•]\s|[-*]\s)")
_BEGINS = re.compile(r"\s{2,}\S|" + _LISTED.pattern)
_HYPHEN = re.compile(r"[-‐‑](?<=[^\W\d_].)(?=[^\W\d_])")
_BEFORE, _AFTER = re.compile(r"[^\W\d_]{2,}$"), re.compile(r"[^\W\d_]{2,}")
_BROKEN = re.compile(r"(?<![\w'’ʼ])([^\W\d_]+(?:['’ʼ][^\W\d_]+)*)([-‐‑¬\xad])[ \t]*$")
_HEADWORD = re.compile(r"^[ \t]*([^\W\d_]+(?:['’ʼ][^\W\d_]+)*)")
#: A Cyrillic word with a sign or digit inside that is no letter.
_ODD = re.compile(r"(?<![\w/])(?=[\w'’|/!>]*[а-яіїєґ])[а-яіїєґА-ЯІЇЄҐ'’]*(?:(?:[0134680il!]|/i|>к|\|{1,3}|l[оo])[а-яіїєґ'’]*)+(?![\w/])")
_LATIN = {ord(a): b for a, b in zip("aceiopxyABCEHIKMOPTX", "асеіорхуАВСЕНІКМОРТХ")}
_NUMBER = re.compile(r"\d+")
_ALONE = re.compile(r"^[\W_]*(?:(?:стор|сторінка|с|page|p|арк|ст)\b)?[\W_]*\d{1,5}(?:\s*(?:/|з|із|of)\s*\d{1,5})?[\W_]*$", re.IGNORECASE)
_ROMAN = re.compile(r"^[\W_]*([ivxlc]{1,8})[\W_]*$", re.IGNORECASE)
_DIGITS = str.maketrans("ОоOoЗзlІіI!|бчЧВ", "0000331111116448")
_OTHER = frozenset("0123456789>|/l")
_SPLIT = re.compile(r"[^\W_]+")
#: Letters that misreading confuses count as one when running lines are compared.
_CLASSES = str.maketrans({"и": "н", "ы": "н", "й": "н", "п": "н", "ц": "н", "х": "н", "з": "в", "3": "в", "8": "в", "г": "т", "ъ": "ь", "є": "е", "0": "о", "1": "і", "!": "і", "i": "і", "l": "і", "|": "і", "4": "ч", "6": "б", "c": "с", "o": "о", "e": "е", "a": "а", "p": "р", "x": "н", "y": "у"})


#: The same for bytes of one code page, and its bytes that are no letter or digit, even as what they count as.
_PAGE = [bytes([b]).decode("cp1251", "ignore") or "\0" for b in range(256)]
_CLASS_BYTES = bytes((c.translate(_CLASSES).encode("cp1251") if c != "\0" else bytes([b]))[0] for b, c in enumerate(_PAGE))
_NO_LETTERS = bytes(b for b, c in enumerate(_PAGE) if not _SPLIT.fullmatch(c.translate(_CLASSES)))


def body_lines(text: str) -> list[str]:
    return (text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text).split("\n")


_OWN_NUMBER = re.compile(r"(?<![^\W\d_])\d+(?![^\W\d_])")


@lru_cache(1 << 15)
def line_key(line: str) -> str:
    """Letters of a running line, without case, numbers and what misreading confuses."""
    low = line.lower()
    if not low.islower() or not _OTHER.isdisjoint(low):
        low = _OWN_NUMBER.sub(" ", low.replace(">к", "ж").replace("|||", "ш").replace("/i", "л").replace("lо", "ю"))
    try:  # by a table of bytes where the line has only characters of that code page
        return low.encode("cp1251").translate(_CLASS_BYTES, _NO_LETTERS).decode("cp1251")
    except UnicodeEncodeError:
        return "".join(_SPLIT.findall(low.translate(_CLASSES)))


def _classes(text: str) -> str:
    """The text with letters that misreading confuses as one."""
    try:
        return text.encode("cp1251").translate(_CLASS_BYTES).decode("cp1251")
    except UnicodeEncodeError:
        return text.translate(_CLASSES)


@lru_cache(1 << 15)
def is_alone(line: str) -> bool:
    """Whether the line is a page number, possibly misread or in Roman numerals, and nothing else."""
    if len(line.strip()) > 24:
        return False
    return bool(_ALONE.match(line) or _ALONE.match(line.translate(_DIGITS)) or _ROMAN.match(line))


def _roman(text: str) -> int:
    """Value of a Roman numeral."""
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in text.lower()]
    return sum(-v if v < max(values[i:]) else v for i, v in enumerate(values))


def _filled(lines: list[str], order: range, most: int) -> list[int]:
    """The first lines in an order that aren't blank."""
    out: list[int] = []
    for i in order:
        if len(out) == most:
            break
        if lines[i].strip():
            out.append(i)
    return out


def edges(lines: list[str]) -> list[tuple[int, int]]:
    """(line index, side) of the lines at the top (0) and bottom (1) that may be running lines."""
    first = _filled(lines, range(len(lines)), EDGE)
    out = [(i, 0) for i in first] + [(i, 1) for i in reversed(_filled(lines, range(len(lines) - 1, -1, -1), EDGE)) if i not in first]
    return [(i, s) for i, s in out if is_alone(lines[i]) or not _LISTED.match(lines[i])]


def _numbers(line: str) -> list[int]:
    roman = _ROMAN.match(line)
    if roman:
        return [_roman(roman[1])]
    text = line if _ALONE.match(line) or not is_alone(line) else line.translate(_DIGITS)
    return [int(x) for x in _NUMBER.findall(text) if len(x) < 6][:6]


_STRANGE = re.compile(r"^.*[ыъэёa-z].*$", re.MULTILINE)
_RUSSIAN, _ASCII = frozenset("ыъэё"), frozenset("abcdefghijklmnopqrstuvwxyz")
_ALLOWED = set(_EDITS)
_LONG = {read: letter for letter, read in _EDITS if len(read) > 1}
_SIGNS: dict[str, str] = {}
for _letter, _read in _EDITS:
    if len(_read) == 1 and not (_read.isalpha() and _read > "z"):
        _SIGNS.setdefault(_read, _letter)
_HAS_SIGN = re.compile(r"[0-9!|/>il](?:(?=[а-яіїєґ])|(?<=[а-яіїєґ].))")


def plain_form(word: str) -> str:
    """The word with forms that are no letters undone."""
    if word.isalpha() and _ASCII.isdisjoint(word):
        return word
    for read, letter in _LONG.items():
        if read in word:
            word = word.replace(read, letter)
    return "".join(_SIGNS.get(c, c) for c in word)


def is_reading(read: str, word: str, most: int = 2) -> bool:
    """Whether at most ``most`` plausible misreadings turn ``word`` into ``read``, of equal length."""
    if len(read) != len(word):
        return False
    differ = [(w, r) for w, r in zip(word, read) if w != r]
    return 0 < len(differ) <= most and all(d in _ALLOWED or (d[0], _SIGNS.get(d[1])) == (d[0], d[0]) for d in differ)


class Words:
    """The dictionary: counts, hyphenated compounds and skip-gram vectors of its words."""

    def __init__(self, counts: dict[str, int], compounds: set[str], inner: np.ndarray, outer: np.ndarray) -> None:
        self.counts, self.compounds, self.inner, self.outer = counts, compounds, inner, outer
        self.index = {w: i for i, w in enumerate(counts)}
        self.most = max(counts.values(), default=0)
        size = np.linalg.norm(inner, axis=1, keepdims=True) if len(inner) else inner
        self.unit = np.divide(inner, size, out=np.zeros_like(inner), where=size > 0)
        self.seconds: dict[str, list[str]] = {}  # of compounds, by their first words
        for c in compounds:
            a, _, b = c.partition("-")
            self.seconds.setdefault(a, []).append(b)
        self.known: dict[str, list[str]] = {}
        self.state: dict[str, int] = {}
        self.fine: set[str] = set()
        self.alike: dict[str, list[str]] = {}  # dictionary words by what misreading confuses
        for w in counts:
            self.alike.setdefault(w.translate(_CLASSES), []).append(w)

    def neighbours(self, rare: str, word: str) -> bool:
        """Whether the words stand in like contexts; of a word outside the dictionary none is known, and its place decides."""
        return rare not in self.index or float(self.unit[self.index[rare]] @ self.unit[self.index[word]]) >= NEAR

    def links(self, word: str) -> list[str]:
        """Dictionary words that ``word`` (in lower case) may be a misreading of."""
        found = self.known.get(word)
        if found is None:
            have = RARER * max(self.counts.get(word, 0), 0.2)
            bare = plain_form(word)
            near = self.alike.get(bare.translate(_CLASSES), ()) if have <= self.most and (len(word) > 4 or bare != word) else ()
            found = sorted(w for w in near if w != word and self.counts[w] >= have and (w == bare or is_reading(bare, w)) and self.neighbours(word, w))
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = found
        return found

    def doubt(self, surface: str) -> int:
        """0: a good word or a name, 1: to be corrected unless it stands as a name, 2: to be corrected anywhere."""
        found = self.state.get(surface)
        if found is None:
            low = surface.lower()
            strange = not _RUSSIAN.isdisjoint(low) or not _ASCII.isdisjoint(low) and bool(re.search(r"[а-яіїєґ]", low))
            found = 2 if strange else (1 if len(surface) > 2 and self.links(low) else 0)
            if len(self.state) > 400_000:
                self.state.clear()
            self.state[surface] = found
        return found

    def doubtful(self, surfaces: set[str]) -> list[str]:
        """Those of the words that may have to be corrected."""
        rest = list(surfaces - self.fine)
        if not rest:
            return []
        # all at once: a word of plain letters that is like no dictionary word needs no closer look
        low = "\n".join(rest).lower()
        odd = set(_STRANGE.findall(low))
        out = [w for w, x, like in zip(rest, low.split("\n"), _classes(low).split("\n")) if (like in self.alike or x in odd) and self.doubt(w)]
        if len(self.fine) > 400_000:
            self.fine.clear()
        self.fine |= set(rest).difference(out)
        return out

    def fit(self, word: str, context: list[str]) -> float:
        """How well a dictionary word fits the words around it."""
        at = [self.index[c] for c in context if c in self.index]
        return float((self.outer[at] @ self.inner[self.index[word]]).mean()) if at else 0.0

    def correct(self, word: str, context: list[str]) -> str | None:
        """The word that ``word`` is a misreading of, or None."""
        found = self.links(word)
        if not found:
            return None
        best = max(found, key=lambda w: (self.fit(w, context), self.counts[w], w))
        # much against the context is no correction
        return best if self.fit(best, context) > -4.0 else None


def compounds_of(low: str) -> Iterator[str]:
    """Words with a hyphen of their own, within a line."""
    for m in _HYPHEN.finditer(low):
        i = m.start()
        a, b = _BEFORE.search(low, max(0, i - 30), i), _AFTER.match(low, i + 1, i + 31)
        if a and b:
            yield f"{a[0]}-{b[0]}"


_FIRST = "kind string, word string, n bigint, doc string, block bigint, page int, page_id bigint, keys array<string>, numbers array<int>, cut boolean, top array<struct<h:bigint,w:string>>"


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def first_pass(pages: DataFrame) -> DataFrame:
    """What is read off the texts at first, in one table: words (kind w) and compounds (c) with counts ``n``, summed over batches
    only, and a row a page (e): ``doc, block, page, page_id``, ``keys`` and ``numbers`` of its edge lines, whether a word may
    be ``cut`` at its end, and ``top``: of its first lines that aren't page numbers, name and first word.
    """
    top_type = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.string())]))
    kinds = {"kind": pa.string(), "word": pa.string(), "n": pa.int64(), "doc": pa.string(), "block": pa.int64(), "page": pa.int32(), "page_id": pa.int64(), "keys": pa.list_(pa.string()), "numbers": pa.list_(pa.int32()), "cut": pa.bool_(), "top": top_type}

    def batch(rows: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(rows, t)) for k, t in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            words: Counter = Counter()
            compounds: Counter = Counter()
            keys, numbers, cuts, tops = [], [], [], []
            for t in b.column(4).to_pylist():
                t = t or ""
                low = t.lower()
                words.update(_WORD.findall(low))
                compounds.update(compounds_of(low))
                lines = body_lines(t)
                at = edges(lines)
                first, last = (_filled(lines, r, k) for r, k in ((range(len(lines)), EDGE + 2), (range(len(lines) - 1, -1, -1), EDGE + 1)))
                keys.append(sorted({k for i, _ in at if len(k := line_key(lines[i])) >= 5}))
                numbers.append(sorted({n for i, _ in at for n in _numbers(lines[i])}))
                cuts.append(any(lines[i].rstrip().endswith(_ENDS) for i in last))
                tops.append([{"h": _line_name(line_key(x)), "w": m[1] if (m := _HEADWORD.match(x)) else ""} for x in (lines[i] for i in first) if not is_alone(x)])
            n = len(words) + len(compounds)
            yield batch(n, kind=pa.array(["w"] * len(words) + ["c"] * len(compounds), pa.string()), word=pa.array([*words, *compounds], pa.string()), n=pa.array([*words.values(), *compounds.values()], pa.int64()))
            of_page = dict(zip(("doc", "block", "page", "page_id"), b.columns[:4]))
            yield batch(b.num_rows, kind=pa.array(["e"] * b.num_rows, pa.string()), **of_page, keys=pa.array(keys, kinds["keys"]), numbers=pa.array(numbers, kinds["numbers"]), cut=pa.array(cuts, pa.bool_()), top=pa.array(tops, top_type))

    return stage(pages.select("doc", "block", "page", "page_id", "text").mapInArrow(run, _FIRST), "first-pass")


def context_pairs(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words within ``SPAN`` of each other in a stretch of word ids (-1: not in the dictionary), word * size + context, with their counts."""
    pairs = []
    for o in range(1, SPAN + 1):
        a, b = ids[:-o], ids[o:]
        ok = (a >= 0) & (b >= 0)
        pairs += [a[ok] * size + b[ok], b[ok] * size + a[ok]]
    return np.unique(np.concatenate(pairs) if pairs else np.zeros(0, np.int64), return_counts=True)


def added_pairs(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of both with their counts added."""
    key, at = np.unique(np.concatenate([x[0], y[0]]), return_inverse=True)
    n = np.zeros(len(key), np.int64)
    np.add.at(n, at, np.concatenate([x[1], y[1]]))
    return key, n


def local_skip_grams(pairs: tuple[np.ndarray, np.ndarray], counts: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Skip-gram vectors by negative sampling from counted pairs of words.

    Equal pairs are one weighted example. The start depends on the word alone, so that vectors from different
    stretches can be averaged.
    """
    size = len(counts)
    start = np.random.default_rng(seed)
    inner = (start.random((size, DIM), np.float32) - 0.5) / DIM
    outer = (start.random((size, DIM), np.float32) - 0.5) / DIM
    key, n = pairs
    if not len(key):
        return inner, outer
    words, context = key // size, key % size
    weight = np.log1p(n).astype(np.float32)[:, None]
    chance = np.cumsum(counts**0.75)
    draw = np.random.default_rng(seed + 1)
    seen = [np.full((size, 1), 1e-3, np.float32) for _ in range(2)]

    def places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(at, kind="stable")
        ranked = at[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        return order, ranked[first], first

    def move(table: np.ndarray, sums: np.ndarray, place: tuple[np.ndarray, np.ndarray, np.ndarray], grad: np.ndarray) -> None:
        order, rows, first = place
        g = np.add.reduceat(grad[order], first)
        sums[rows] += (g * g).mean(1, keepdims=True)
        table[rows] -= RATE * g / np.sqrt(sums[rows])  # adaptive step

    size_of = min(8192, max(16, len(words) // 8))
    for _ in range(max(EPOCHS, STEPS * size_of // len(words))):  # a short stretch is gone over more often
        order = draw.permutation(len(words))
        for lo in range(0, len(order), size_of):
            k = order[lo : lo + size_of]
            w = words[k]
            of_words = places(w)  # the same for the true contexts and the drawn ones
            for positive in (True, *[False] * NEGATIVE):
                c = context[k] if positive else np.minimum(np.searchsorted(chance, draw.random(len(k)) * chance[-1]), size - 1)
                p = 1 / (1 + np.exp(-np.clip((inner[w] * outer[c]).sum(1, keepdims=True), -20, 20)))
                g = (p - float(positive)) * weight[k]
                gi, go = g * outer[c], g * inner[w]
                move(inner, seen[0], of_words, gi)
                move(outer, seen[1], places(c), go)
    return inner, outer


def learn(pages: DataFrame, first: DataFrame) -> Words:
    """The dictionary of all pages, from what the first pass counted, and vectors of its words."""
    spark, text = pages.sparkSession, "text"
    counted = stage(first.where("kind <> 'e'").groupBy("kind", "word").agg(F.sum("n").alias("n")), "page-words")
    total = counted.where("kind = 'w'").agg(F.sum("n")).first()[0] or 0
    least = max(MIN_COUNT, int(MIN_SHARE * total))
    rows = counted.where((F.col("kind") == "w") & (F.col("n") >= least)).orderBy(F.desc("n"), "word").collect()  # at most 1 / MIN_SHARE rows
    counts = {r["word"]: r["n"] for r in rows}
    # a compound ends with a word of its own, so that at most total / max(2, least // 10) < 800,000 rows are left
    compounds = {r["word"] for r in counted.where((F.col("kind") == "c") & (F.col("n") >= max(2, least // 10))).select("word").collect()}
    index = spark.sparkContext.broadcast({w: i for i, w in enumerate(counts)})
    sizes = np.array(list(counts.values()), np.float64)
    names = [f"v{i}" for i in range(2 * DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # only counts are kept of what was read: of words, and of pairs of them
        known, size = index.value, len(sizes)
        n, pairs = np.zeros(size), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for b in _sliced(batches):
            ids = []
            for t in b.column(0).to_pylist():
                ids += [known.get(w, -1) for w in _WORD.findall(t.lower())]
                ids.append(-1)
            seq = np.array(ids, np.int64)
            n += np.bincount(seq[seq >= 0], minlength=size)
            pairs = added_pairs(pairs, context_pairs(seq, size))
        if not n.any():
            return
        inner, outer = local_skip_grams(pairs, sizes)
        at = np.flatnonzero(n)
        both = np.concatenate([inner, outer], 1)[at] * n[at, None]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), *[pa.array(both[:, i].astype(np.float64)) for i in range(2 * DIM)]], names=["i", "n", *names])

    inner, outer = np.zeros((len(counts), DIM), np.float32), np.zeros((len(counts), DIM), np.float32)
    if counts:
        parts = pages.select(text).where(F.col(text) != "").mapInArrow(run, "i bigint, n double, " + ", ".join(f"{v} double" for v in names))
        mean = parts.groupBy("i").agg(*[(F.sum(v) / F.sum("n")).alias(v) for v in names]).toPandas()  # one row per dictionary word
        at = mean["i"].to_numpy()
        inner[at], outer[at] = mean[names[:DIM]].to_numpy(), mean[names[DIM:]].to_numpy()
    return Words(counts, compounds, inner, outer)


@lru_cache(1 << 15)
def _line_name(key: str) -> int:
    return xxhash.xxh64_intdigest(key) >> 1


def _document(page: str = "page") -> list[Column]:
    """``doc`` and ``block`` of a page: pages of a null document are documents of their own, pages without a number blocks of their own."""
    own = F.coalesce(F.col("page_id"), F.lit(0))
    doc = F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.concat(F.lit("p"), F.col("page_id").cast("string")), F.lit(""))
    return [doc.alias("doc"), F.coalesce(F.floor(F.col(page) / BLOCK_PAGES).cast("bigint"), -10 - F.abs(own)).alias("block")]  # no neighbour of a block of numbered pages


def _page_context(first: DataFrame) -> DataFrame:
    """``doc, block, heads, shifts, nexts``: running lines and page number shifts of the document and of the stretches that
    hold the block, and for its pages that may end in a cut word the top of the next page.

    Counts are taken by block; those of documents and of stretches of two blocks are sums of them.
    """
    rows = stage(first.where("kind = 'e'").drop("kind", "word", "n").dropDuplicates(["doc", "page", "page_id"]), "edges")
    of = rows.groupBy("doc", "block").agg(F.count("*").alias("pages"))
    whole_of = of.groupBy("doc").agg(F.sum("pages").alias("pages"))
    # a stretch begins at block ``at`` and ends with the next one
    at = F.explode(F.array(F.col("block") - 1, F.col("block"))).alias("at")
    stretch_of = of.select("doc", at, "pages").groupBy("doc", "at").agg(F.sum("pages").alias("pages"))

    # a mark is a line's key or a page number shift
    mark = lambda key, shift: F.struct(key.alias("key"), shift.cast("int").alias("shift"))
    none = F.lit(None)
    shifts = F.array_distinct(F.transform("numbers", lambda x: x - F.col("page")))
    marks = F.concat(F.transform("keys", lambda k: mark(k, none)), F.transform(F.filter(shifts, lambda x: x.isNotNull()), lambda x: mark(none.cast("string"), x)))
    share = F.when(F.col("key").isNotNull(), 0.12).otherwise(0.3)
    counted = rows.select("doc", "block", F.explode(marks).alias("m")).select("doc", "block", "m.key", "m.shift").groupBy("doc", "block", "key", "shift").agg(F.count("*").alias("n"))
    # few lines recur on a fifth of the pages: a list has at most 2 * EDGE * 5 of them, or those of short documents; of a stretch, 2 * EDGE * 2 * BLOCK_PAGES / LOCAL
    whole = counted.groupBy("doc", "key", "shift").agg(F.sum("n").alias("n")).where("n >= 2").join(whole_of, "doc").where(F.col("n") >= F.col("pages") * share)
    # no filter on blocks here, so that both sums share one exchange; two pages without a number never make LOCAL
    local = counted.select("doc", "key", "shift", "n", at).groupBy("doc", "at", "key", "shift").agg(F.sum("n").alias("n")).where(F.col("n") >= LOCAL)
    local = local.join(stretch_of, ["doc", "at"]).where(F.col("n") >= F.col("pages") * share).select("doc", F.explode(F.array("at", F.col("at") + 1)).alias("block"), "key", "shift", "n")
    head = F.when(F.col("key").isNotNull(), F.struct("key", "n"))
    whole = whole.groupBy("doc").agg(F.collect_list(head).alias("heads"), F.max_by("shift", F.when(F.col("shift").isNotNull(), F.struct("n", -F.abs("shift")))).alias("shift"))
    local = local.groupBy("doc", "block").agg(F.collect_list(head).alias("near"), F.collect_set("shift").alias("shifts"))
    order = Window.partitionBy("doc").orderBy("page", "page_id")
    nexts = rows.select("doc", "block", "page_id", "cut", F.lead("top").over(order).alias("top")).where("cut and top is not null")
    nexts = nexts.groupBy("doc", "block").agg(F.collect_list(F.struct("page_id", "top")).alias("nexts"))  # of BLOCK_PAGES pages
    full = of.select("doc", "block").join(whole, "doc", "left").join(local, ["doc", "block"], "left").join(nexts, ["doc", "block"], "left")
    empty = lambda c: F.coalesce(c, F.array())
    all_heads = F.concat(empty(F.col("near")), empty(F.col("heads")))  # of a line in both the count of the document is the later one, and holds
    all_shifts = F.array_compact(F.array_distinct(F.concat(F.array(F.col("shift").cast("int")), empty(F.col("shifts")))))
    return full.select("doc", "block", all_heads.alias("heads"), all_shifts.alias("shifts"), "nexts")


def _resembles(key: str, heads: dict[str, int]) -> bool:
    """Whether a line differs from a running line by little."""
    match = None
    for h in heads:
        if abs(len(h) - len(key)) <= 2:
            if match is None:
                match = SequenceMatcher(None, "", key, False)  # what is prepared for the second sequence is kept
            match.set_seq1(h)
            if match.quick_ratio() >= 0.85 and match.ratio() >= 0.85:
                return True
    return False


def furniture(lines: list[str], page: int, heads: dict[str, int], shifts: list[int]) -> dict[int, set[str]]:
    """Lines of the page that are running lines or hold its number: line index -> kinds."""
    out: dict[int, set[str]] = {}
    for i, _ in edges(lines):
        text, key = lines[i].strip(), line_key(lines[i])
        here = _numbers(lines[i])
        number = any(page + x in here for x in shifts)
        if is_alone(text):
            if number or (not shifts and re.search(r"[^\d\s.,\w]|стор|^\s{8,}", lines[i])):
                out[i] = {"page_number"}
            continue
        if len(key) < 5:
            continue
        head = key in heads or _resembles(key, heads)
        if head and (not re.search(r"[.,;]$", text) or heads.get(key, 0) >= 5):
            out[i] = {"header", "page_number"} if number else {"header"}
    return out


def _is_cut(words: Words, left: str, mark: str, right: str) -> bool:
    """Whether a line end cut one word, rather than a compound at its own hyphen."""
    a, b = left.lower(), right.lower()
    if not right[:1].islower():
        return left.isupper() and right.isupper() and len(right) > 1
    if mark in "¬\xad":
        return True
    if f"{a}-{b}" in words.compounds:
        return False
    if a + b in words.counts:
        return True
    return not (len(a) > 3 and any(c.startswith(b[:4]) for c in words.seconds.get(a, ())))


class Repaired:
    """A page repaired: its kinds of noise and its paragraphs."""

    def __init__(self, words: Words, text: str, page: int, heads: dict[str, int], shifts: list[int], next_top: list[dict]) -> None:
        lines = body_lines(text)
        gone = furniture(lines, page, heads, shifts)
        self.noise = set().union(*gone.values()) if gone else set()
        body = [x.replace("﻿", "") for i, x in enumerate(lines) if i not in gone]
        while body and not body[-1].strip():
            body.pop()
        russian = sum(map(text.count, "ыэъё")) * 50 > sum(map(text.count, "іїєґ"))  # a page in Russian has these letters by right
        self.words, self.russian, self.signs = words, russian, bool(_HAS_SIGN.search(text))
        joined: list[str] = []
        carried = ""
        for i, line in enumerate(body):
            line = carried + line.strip() if carried else line.rstrip()  # without spaces at its end
            carried = ""
            m = _BROKEN.search(line) if line.endswith(_ENDS) else None
            rest = None  # the word that begins the next line
            if m and i + 1 == len(body):
                names = {_line_name(h) for h in heads} if next_top else ()
                rest = next((x["w"] for x in next_top if x["h"] not in names), None)
            elif m:
                n = _HEADWORD.match(next((x for x in body[i + 1 :] if x.strip()), ""))
                rest = n[1] if n else None
            if m and rest and not line.lstrip().startswith("|"):
                if _is_cut(words, m[1], m[2], rest):
                    self.noise.add("hyphenation")
                    if i + 1 < len(body):
                        carried = line[: m.start(2)]
                        continue
                    joined.append(line[: m.start(2)] + rest)  # the next page begins with the rest
                    continue
                if i + 1 < len(body):
                    carried = line[: m.end(2)]
                    continue
            joined.append(line)
        if carried:
            joined.append(carried)
        doubtful = frozenset(words.doubtful(set(_WORD.findall("\n".join(joined)))))
        if doubtful or self.signs:
            joined = [self._corrected(x, doubtful) if self.signs and _HAS_SIGN.search(x) or any(w in x for w in doubtful) else x for x in joined]
        self.paragraphs = self._reflow(joined)

    def _corrected(self, line: str, doubtful: frozenset[str]) -> str:
        """The line with misread words put right; of its plain words only doubtful ones are looked at."""
        words = self.words
        signs = self.signs and _HAS_SIGN.search(line)
        fixed: list[tuple[int, int, str]] = []
        found = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(line)]
        covered: set[int] = set()
        for m in _ODD.finditer(line) if signs else ():
            s, e, w = m.start(), m.end(), m[0]
            if not re.search(r"[а-яіїєґ]{2}", w) or re.fullmatch(r"\d+[-–]?[а-яіїєґ]+|[А-ЯІЇЄҐ]\d+", w):
                continue
            near = [x.lower() for a, b, x in found if s - 40 < a < e + 40 and not (a >= s and b <= e)]
            low = w.lower()
            new = words.correct(low, near) or plain_form(low)
            self.noise.add("misread")
            covered.update(range(s, e))
            fixed.append((s, e, new.capitalize() if w[:1].isupper() else new))
        for k, (s, e, w) in enumerate(found):
            if w not in doubtful or s in covered or len(w) < 3:
                continue
            state = words.doubt(w)
            if state == 1 and (w[0].isupper() and k and line[s - 2 : s - 1] not in ".!?" or w.isupper()):
                continue  # names aren't corrected
            low = w.lower()
            if state == 2 and self.russian and not re.search(r"[a-z]", low):
                continue
            new = words.correct(low, [x.lower() for _, _, x in found[max(0, k - SPAN) : k] + found[k + 1 : k + 1 + SPAN]])
            if new or state == 2:
                self.noise.add("misread")
                new = new or low.translate(_LATIN)
                fixed.append((s, e, new.capitalize() if w[:1].isupper() else new))
        for s, e, new in sorted(fixed, reverse=True):
            line = line[:s] + new + line[e:]
        return line

    @staticmethod
    def _reflow(lines: list[str]) -> list[str]:
        """Paragraphs: blank lines, indents, headings, list items and table rows begin anew."""
        out: list[list[str]] = []
        fresh = True
        for line in lines:
            bare = line.strip()
            if not bare:
                fresh = True
                continue
            begins = not line[0].isalnum() and bool(_BEGINS.match(line))
            if fresh or begins or not out or out[-1][0][0] in "|#":
                out.append([bare])
            else:
                out[-1].append(bare)
            fresh = bare[0] in "#|"
        return [" ".join(x) for x in out]


def repair(pages: DataFrame, words: Words | None = None) -> DataFrame:
    """``doc_id, page, page_id, noise, text``: the kinds of noise of each page (sorted) and its running text.

    ``pages`` has page_id, doc_id, page, text. Paragraphs are parted by a blank line; a word cut by the end of
    the page stands whole on the page of its first part, and its rest is taken from the next one. Null and
    empty texts give an empty text without noise, and stand between their neighbours. Repeated rows give
    repeated rows. Pages of a null document are each a document of one page. Other columns are dropped.
    """
    typed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), "text")
    base = typed.select("*", *_document())
    first = first_pass(base)
    words = words or learn(base, first)
    shipped = pages.sparkSession.sparkContext.broadcast((words.counts, words.compounds, words.inner, words.outer))  # bounded by MIN_SHARE
    mine = F.get(F.filter("nexts", lambda x: x["page_id"] == F.col("page_id")), F.lit(0))["top"]
    full = base.join(_page_context(first), ["doc", "block"], "left").select("page_id", "doc_id", "page", "text", F.col("heads.key").alias("hk"), F.col("heads.n").alias("hn"), "shifts", mine.alias("next_top"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(*shipped.value)
        for b in _sliced(batches):
            noise, texts = [], []
            for page, t, hk, hn, shifts, top in zip(*(c.to_pylist() for c in b.columns[2:])):
                r = Repaired(known, t or "", page or 0, dict(zip(hk or [], hn or [])), shifts or [], top or [])
                noise.append(sorted(r.noise)), texts.append("\n\n".join(r.paragraphs))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(0), pa.array(noise, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["doc_id", "page", "page_id", "noise", "text"])

    return full.mapInArrow(run, "doc_id string, page int, page_id bigint, noise array<string>, text string")
