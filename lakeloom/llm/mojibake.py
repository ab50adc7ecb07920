"""Problem 10: find and repair text that was decoded with the wrong character encoding.

Adjacent characters are scored by their mutual information in the corpus: how much more or less often than by
chance they stand together. Shares of characters count as ``FLOOR`` at least, since of rare characters, which
garbled text is full of, any meeting would look like an association. Maximum-scoring segments of minus that
information, less a level that ordinary text stays below, are the improbable runs. So that a large
garbled group doesn't make itself ordinary, words that an inverse mapping makes far more probable, by the
statistics of all texts, are taken out of the statistics first. Inverse
mappings (encode with the wrong encoding, decode with the right one) are tested inside those runs only, and
one is accepted if it makes the run much more probable. Pairs with a replacement character are no text and don't
count in the statistics; runs that hold one can't be restored but are found all the same.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forms import code_points

#: Characters with statistics of their own, the most frequent ones; all others share one entry. Bounds the table.
ALPHABET = 1024
#: Least share of a character, share that an unseen pair counts as, minus mutual information above which a pair counts for a run; least score of a run.
FLOOR, UNSEEN, LEVEL, LEAST_RUN = 1 / 64, 1e-8, 2.5, 3.0
#: Gain in nats that an inverse mapping must bring, if the bytes form UTF-8 (which is evidence in itself) or not.
GAIN_UTF8, GAIN_BYTES = 3.0, 12.0
#: The same for single words of a text in which the mapping has been accepted already.
GAIN_AGAIN = 1.0
#: Mean information of a pair that a restored run may have at most, by the same distinction; ordinary text has about 6.
ORDINARY, ORDINARY_UTF8 = 9.5, 10.8
#: Information added to pairs with a C1 control.
C1 = 3.0
ROUNDS = 3
#: A word leaves the statistics if a single-byte mapping changes so many characters, gains so much a pair and leaves at most so much a pair.
CHANGED, GAIN_PAIR, PLAIN = 4, 0.3, 7.5
#: Share of the characters beyond ASCII that must be UTF-8 sequences for a word to leave the statistics.
DECODED = 0.7
# fixed values: encodings that texts were wrongly decoded with, and right ones
_WRONG = ("cp1252", "cp1251", "cp866", "koi8_u", "mac_roman", "cp1250", "cp437")
_RIGHT = ("utf_8", "cp1251", "koi8_u", "cp866", "cp1250", "cp1252")
LOST = "�"
_SPACE = re.compile(r"([ \n\t\r]+)")
#: Words whose verdict a task keeps.
KNOWN = 500_000


@lru_cache(1)
def _codecs() -> tuple[dict[str, dict[str, int]], dict[tuple[str, str], dict[int, str]]]:
    """Characters to bytes by wrong encoding (bytes it doesn't define stand for C1 controls), and character maps
    of wrong to right single-byte encoding."""
    tables = {}
    for name in {*_WRONG, *_RIGHT} - {"utf_8"}:
        tables[name] = [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]
    to_byte = {name: {c: b for b, c in reversed(list(enumerate(tables[name])))} for name in _WRONG}
    for name in _WRONG:  # C1 controls pass where the encoding leaves room
        for b in range(0x80, 0xA0):
            to_byte[name].setdefault(chr(b), b)
    maps = {}
    for w in _WRONG:
        for r in _RIGHT:
            if r not in (w, "utf_8"):
                maps[w, r] = {ord(c): tables[r][b] for c, b in to_byte[w].items() if b >= 0x80}
    return to_byte, maps


@lru_cache(1)
def _sequences() -> list[tuple[str, re.Pattern[str]]]:
    """By wrong encoding, what UTF-8 sequences look like in it; a lost byte may stand among those that continue."""

    def one_of(to_byte: dict[str, int], lo: int, hi: int, more: str = "") -> str:
        return "[" + re.escape("".join(c for c, b in to_byte.items() if lo <= b < hi) + more) + "]"

    out = []
    for name, to_byte in _codecs()[0].items():
        go_on = one_of(to_byte, 0x80, 0xC0, LOST)
        leads = (one_of(to_byte, 0xC2, 0xE0), one_of(to_byte, 0xE0, 0xF0), one_of(to_byte, 0xF0, 0xF5))
        out.append((name, re.compile("|".join(f"{x}{go_on}{{{k}}}" for k, x in enumerate(leads, 1)))))
    return out


@lru_cache(1)
def _any_sequence() -> re.Pattern[str]:
    return re.compile("|".join(sequence.pattern for _, sequence in _sequences()))


class Model:
    """Information of adjacent characters."""

    def __init__(self, chars: np.ndarray, counts: np.ndarray) -> None:
        self.index = np.zeros(0x110000, np.uint16)
        self.index[chars] = np.arange(1, len(chars) + 1)
        self.chars, self.size = chars, len(chars) + 1
        total = max(counts.sum(), 1.0)
        self.info = -np.log((counts + 0.1) / total).astype(np.float32)
        control = np.flatnonzero((chars >= 0x80) & (chars < 0xA0)) + 1  # no text has C1 controls, however many garbled ones do
        self.info[control, :] += C1
        self.info[:, control] += C1
        lost = np.flatnonzero(chars == ord(LOST)) + 1
        sound = counts.copy()
        sound[lost, :] = sound[:, lost] = 0
        share = sound / max(sound.sum(), 1.0)
        left, right = (np.maximum(share.sum(k), FLOOR) for k in (1, 0))
        self.apart = (np.log(left[:, None] * right[None, :]) - np.log(share + UNSEEN)).astype(np.float32)  # minus mutual information
        self.apart[control, :] += C1
        self.apart[:, control] += C1

    def pairs(self, cp: np.ndarray) -> np.ndarray:
        i = self.index[cp]
        return self.info[i[:-1], i[1:]]

    def scores(self, cp: np.ndarray) -> np.ndarray:
        """Minus the mutual information of every two adjacent characters."""
        i = self.index[cp]
        return self.apart[i[:-1], i[1:]]

    def text(self, s: str) -> float:
        if len(s) < 2:
            return 0.0
        return float(self.pairs(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")).sum())


def _decodes(model: Model, word: str) -> bool:
    """Whether a word is UTF-8 wrongly decoded, once or twice: one sequence is shorter and so more probable than its characters, however common these are."""
    if not _any_sequence().search(word):
        return False
    high, now = sum(c > "\x7f" for c in word), None
    for name, sequence in _sequences():
        if sum(map(len, sequence.findall(word))) < DECODED * high:
            continue
        now = model.text(f" {word} ") if now is None else now
        once = _mapped(word, name, "utf_8")
        for new in (once, *(_mapped(once, w, "utf_8") for w in ("cp1252", "cp1251"))):
            if len(new) < len(word) and now - model.text(f" {new} ") > GAIN_UTF8:
                return True
    return False


def decoded_wrongly(model: Model, words: list[str]) -> np.ndarray:
    """Which of the words an inverse mapping makes far more probable. The words hold no space."""
    if not words:
        return np.zeros(0, bool)
    cp = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.array([len(w) + 1 for w in words])  # pairs of a word, with the spaces around it
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    i, high = model.index[cp], np.add.reduceat(cp[:-1] > 0x7F, start, dtype=np.int64)
    now = np.add.reduceat(model.info[i[:-1], i[1:]], start)
    out = np.zeros(len(words), bool)
    for table in _codecs()[1].values():
        to = np.arange(model.size)
        for k, c in enumerate(model.chars.tolist(), 1):
            if c in table:
                to[k] = model.index[ord(table[c])]
        j = to[i]
        changed = np.add.reduceat(j[:-1] != i[:-1], start, dtype=np.int64)
        left = np.add.reduceat(model.info[j[:-1], j[1:]], start)
        out |= (changed >= CHANGED) & (changed >= 0.7 * high) & (left <= PLAIN * size) & (now - left >= GAIN_PAIR * size)
    for k in np.flatnonzero(~out).tolist():
        out[k] = _decodes(model, words[k])
    return out


def pair_counts(df: DataFrame, text: str, alphabet: int = ALPHABET) -> tuple[np.ndarray, np.ndarray]:
    """The ``alphabet`` most frequent characters of all texts, and the counts of pairs of them (entry 0: any other)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cp, row = code_points(b.column(0))
            if len(cp) < 2:
                continue
            chars = np.flatnonzero(np.bincount(cp, minlength=1))
            local = np.zeros(int(chars[-1]) + 1, np.int64)
            local[chars] = np.arange(len(chars))
            i, same = local[cp], row[1:] == row[:-1]
            at, n = np.unique((i[:-1] * len(chars) + i[1:])[same], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(chars[at // len(chars)].astype(np.int32)), pa.array(chars[at % len(chars)].astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

    pairs = df.select(F.col(f"`{text}`")).mapInArrow(count, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = pairs.persist()
    try:
        top = pairs.groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(alphabet)
        chars = top.select("a").toPandas()["a"].to_numpy(np.int64)  # at most alphabet rows
        known = df.sparkSession.createDataFrame([(int(c), k + 1) for k, c in enumerate(chars)], "c int, k int")
        a, b = (F.broadcast(known).select(F.col("c").alias(x), F.col("k").alias(f"k{x}")) for x in "ab")
        ranked = pairs.join(a, "a", "left").join(b, "b", "left").groupBy(F.coalesce("ka", F.lit(0)).alias("x"), F.coalesce("kb", F.lit(0)).alias("y")).agg(F.sum("n").alias("n"))
        rows = ranked.toPandas()  # at most (alphabet + 1) squared rows
    finally:
        pairs.unpersist()
    counts = np.zeros((len(chars) + 1,) * 2)
    counts[rows["x"].to_numpy(np.int64), rows["y"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return chars, counts


def sound_counts(df: DataFrame, text: str, chars: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts without the pairs of wrongly decoded words, so that these can't make themselves ordinary by their number."""
    shipped = df.sparkSession.sparkContext.broadcast((chars, counts))  # as large as the counts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = Model(*shipped.value), {}
        gone = np.zeros(model.size**2, np.int64)
        for b in batches:
            found: Counter[str] = Counter()
            for t in b.column(0).to_pylist():
                if t and not t.isascii():
                    found.update(f"\0{t}\0".split(" "))  # no pair is taken out at the ends of a text, where none is counted
            words = {w: w.strip("\0") for w in found if not w.isascii()}
            if len(known) > KNOWN:
                known.clear()
            new = list({w for w in words.values() if w not in known})
            known.update(zip(new, decoded_wrongly(model, new).tolist()))
            wrong = [w for w, plain in words.items() if known[plain]]
            if wrong:
                cp = np.frombuffer(f" {' '.join(wrong)} ".encode("utf-32-le", "surrogatepass"), "<u4")
                i, times = model.index[cp].astype(np.int64), np.repeat([found[w] for w in wrong], [len(w) + 1 for w in wrong])
                inside = (cp[:-1] > 0) & (cp[1:] > 0)
                gone += np.bincount((i[:-1] * model.size + i[1:])[inside], times[inside], minlength=model.size**2).astype(np.int64)
        at = np.flatnonzero(gone)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(gone[at])], names=["pair", "n"])

    rows = df.select(F.col(f"`{text}`")).mapInArrow(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most (alphabet + 1) squared rows
    out = counts.ravel().copy()
    out[rows["pair"].to_numpy(np.int64)] -= rows["n"].to_numpy()
    return out.reshape(counts.shape)


def improbable_runs(model: Model, cp: np.ndarray, row: np.ndarray, level: float = LEVEL, least: float = LEAST_RUN) -> list[tuple[int, int]]:
    """Maximum-scoring segments, as half-open spans of code points of a batch. A run stays within its row."""
    if len(cp) < 2:
        return []
    score = model.scores(cp).astype(np.float64) - level
    score[row[1:] != row[:-1]] = -1e5
    score = np.maximum(score, -1e5)
    total = np.concatenate([[0.0], np.cumsum(score)])
    low = np.minimum.accumulate(total)
    height = (total - low)[1:]  # score of the best segment that ends here
    up = height > 1e-7
    start = np.flatnonzero(up & ~np.concatenate([[False], up[:-1]]))
    if not len(start):
        return []
    end = np.flatnonzero(up & ~np.concatenate([up[1:], [False]])) + 1
    peaks = np.maximum.reduceat(np.append(height, 0), np.stack([start, end], 1).ravel())[::2]
    out = []
    for s, e in zip(start[peaks >= least].tolist(), end[peaks >= least].tolist()):
        out.append((s, s + int(np.argmax(height[s:e])) + 2))
    return out


def _decode_utf8(octets: list[int], chars: str) -> tuple[str, int]:
    """Decode the UTF-8 sequences among the bytes of ``chars``; what is none stays. Also the number decoded."""
    out, i, done = [], 0, 0
    n = len(octets)
    while i < n:
        b = octets[i]
        size = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 1
        if size > 1 and i + size <= n and all(0x80 <= x < 0xC0 for x in octets[i + 1 : i + size]):
            try:
                out.append(bytes(octets[i : i + size]).decode())
                i, done = i + size, done + 1
                continue
            except UnicodeDecodeError:
                pass
        out.append(chars[i])
        i += 1
    return "".join(out), done


def _trim(run: str) -> tuple[int, int]:
    high = [i for i, c in enumerate(run) if c > "\x7f"]
    return (high[0], high[-1] + 1) if high else (0, 0)


def _mapped(run: str, wrong: str, right: str) -> str:
    """The run under one inverse mapping; characters that the wrong encoding lacks stay."""
    to_byte, maps = _codecs()
    if right == "utf_8":
        table = to_byte[wrong]
        return _decode_utf8([table.get(c, 0) for c in run], run)[0]
    return run.translate(maps[wrong, right])


def restore_run(model: Model, run: str, before: str = "", after: str = "") -> tuple[str, list[tuple[str, str]]]:
    """The run under the best chain of inverse mappings, and that chain; it is empty if none is accepted."""
    to_byte, maps = _codecs()
    chain: list[tuple[str, str]] = []
    for _ in range(ROUNDS):
        high = {c for c in run if c > "\x7f" and c != LOST}
        if not high:
            break
        now = model.text(before + run + after)
        best, text, by = 0.0, run, None
        for w in _WRONG:
            if sum(c in to_byte[w] for c in high) < 0.7 * len(high):
                continue
            for r in _RIGHT:
                if r == w:
                    continue
                new = _mapped(run, w, r)
                if new == run:
                    continue
                left = model.text(before + new + after)
                gain = now - left - (GAIN_UTF8 if r == "utf_8" else GAIN_BYTES)
                if gain > best and left <= (ORDINARY_UTF8 if r == "utf_8" else ORDINARY) * (len(new) + len(before) + len(after) - 1):
                    best, text, by = gain, new, (w, r)
        if by is None:
            # a chain may pass through text that is no better yet: two decodings at once
            for w in ("cp1252", "cp1251"):
                once = _mapped(run, w, "utf_8")
                if len(once) < len(run):
                    for w2 in ("cp1252", "cp1251"):
                        new = _mapped(once, w2, "utf_8")
                        left = model.text(before + new + after)
                        if len(new) < len(once) and now - left > GAIN_UTF8 and left <= ORDINARY_UTF8 * (len(new) + len(before) + len(after) - 1):
                            return new, [*chain, (w, "utf_8"), (w2, "utf_8")]
            break
        run = text
        chain.append(by)
    return run, chain


def _again(model: Model, text: str, chains: set[tuple[tuple[str, str], ...]]) -> tuple[str, int]:
    """Accepted mappings tested on the other words of the text, which may be too short for a run of their own."""
    words, done = _SPACE.split(text), 0
    for k, word in enumerate(words):
        if word.isascii() or LOST in word and len(word) == word.count(LOST):
            continue
        now = best = model.text(f" {word} ")
        pick = word
        for chain in chains:
            if now < (ORDINARY - 1) * (len(word) + 1) and chain[0][1] != "utf_8":
                continue  # ordinary as it is
            new = word
            for w, r in chain:
                new = _mapped(new, w, r)
            left = model.text(f" {new} ")
            if new != word and left < best - GAIN_AGAIN and left < now - GAIN_AGAIN and left <= (ORDINARY + 2) * (len(new) + 1):
                best, pick = left, new
        done += pick is not word
        words[k] = pick
    return "".join(words), done


def restore_text(model: Model, text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text restored inside its improbable runs, the number of runs restored, and of lost characters."""
    spans: list[list[int]] = []
    for s, e in runs:  # whole words, so that every byte of a sequence is inside
        while s < e and text[s] in " \n\t\r":
            s += 1
        while s < e and text[e - 1] in " \n\t\r":
            e -= 1
        while s > 0 and text[s - 1] not in " \n\t\r":
            s -= 1
        while e < len(text) and text[e] not in " \n\t\r":
            e += 1
        if spans and s <= spans[-1][1] + 2:
            spans[-1][1] = max(e, spans[-1][1])
        else:
            spans.append([s, e])
    out, at, restored, chains = [], 0, 0, set()
    for s, e in spans:
        a, b = _trim(text[s:e])
        if b - a < 2:
            continue
        new, chain = restore_run(model, text[s + a : s + b], text[max(0, s + a - 1) : s + a], text[s + b : s + b + 1])
        if chain:
            restored += 1
            chains.add(tuple(chain))
            out += [text[at : s + a], new]
            at = s + b
    lost = sum(text.count(LOST, s, e) for s, e in spans)
    if chains:
        out.append(text[at:])
        more, again = _again(model, "".join(out), chains)
        return more, restored + again, lost
    return text, 0, lost


def garbled(df: DataFrame, key: str, text: str, alphabet: int = ALPHABET) -> DataFrame:
    """``key, restored, n_runs, n_lost`` of every row whose text holds garbled characters.

    ``restored`` is the text with ``n_runs`` runs decoded anew; ``n_lost`` characters can't be restored, since
    the wrong decoding replaced them. Null and empty texts are never garbled. Repeated rows come out repeatedly;
    other columns are dropped. An empty table gives an empty one.
    """
    base = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    chars, counts = pair_counts(base, "t", alphabet)
    shipped = df.sparkSession.sparkContext.broadcast((chars, sound_counts(base, "t", chars, counts)))  # (alphabet + 1) squared numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shipped.value)
        for b in batches:
            cp, row = code_points(b.column(1))
            first = np.searchsorted(row, np.arange(b.num_rows))
            by_row: dict[int, list[tuple[int, int]]] = {}
            for s, e in improbable_runs(model, cp, row):
                r = int(row[s])
                by_row.setdefault(r, []).append((s - int(first[r]), e - int(first[r])))
            at = sorted(by_row)
            texts = b.column(1).take(pa.array(at, pa.int64())).to_pylist()
            found = [restore_text(model, t, by_row[r]) for r, t in zip(at, texts)]
            keep = [i for i, (_, n, lost) in enumerate(found) if n or lost]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([at[i] for i in keep], pa.int64())), pa.array([found[i][0] for i in keep], pa.string()), pa.array([found[i][1] for i in keep], pa.int32()), pa.array([found[i][2] for i in keep], pa.int32())],
                names=["k", "restored", "n_runs", "n_lost"],
            )

    kind = base.schema["k"].dataType.simpleString()
    return base.where("t is not null").mapInArrow(run, f"k {kind}, restored string, n_runs int, n_lost int").withColumnRenamed("k", key)
