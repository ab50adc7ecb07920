"""Problem 5: items of evaluation splits that occur, exactly or almost, in the training split.

The words of an item, sorted by their hashes, are a string over words; as that order is the same for all items,
the longest common subsequence of two strings is what their bags have in common, and a + b - 2 * common is
their edit distance by insertions and deletions. An evaluation string that may be k edits away from its partner
is cut into k + 1 segments of equal length, one of which no edit touches. Training strings are cut into the
substrings that such a segment may be, at the positions that the deletions and insertions before it allow;
equal ones are matched, and the pairs are verified with a dynamic program within the band.

Sorted by hash, not by frequency, a segment holds words of every kind, so that few segments are
made of common words alone. The order needs no statistics of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from . import bags, forms

#: fixed values: the names of the splits
EVALUATION, TRAINING = ("final", "calibration"), "tuning"


def banded_common(a: list[int], b: list[int], need: int) -> int:
    """Longest common subsequence of ``a`` and ``b`` if it has at least ``need`` elements, else less than ``need``.

    Only cells are computed whose distance from the diagonal the allowed deletions and insertions permit.
    """
    drop, add = len(a) - need, len(b) - need
    if drop < 0 or add < 0:
        return 0
    width = drop + add + 1  # column j of row i is held at j - i + drop
    row = [0] * (width + 1)
    for i, x in enumerate(a, 1):
        new = [0] * (width + 1)
        for k in range(max(0, drop - i + 1), min(width, len(b) - i + drop + 1)):
            j = i + k - drop
            best = row[k] + 1 if x == b[j - 1] else max(row[k + 1] if k + 1 < width else 0, new[k - 1] if k else 0)
            new[k] = max(best, row[k])
        if max(new) < need - (len(a) - i):
            return 0
        row = new
    return max(row)


def partner_sizes(n: int, share: float = bags.SHARE) -> range:
    """Sizes that a string similar to one of ``n`` words may have."""
    most = n
    while bags.common(most + 1, share) <= n:
        most += 1
    return range(bags.common(n, share), most + 1)


@lru_cache(4096)
def segments(n: int, share: float = bags.SHARE) -> tuple[tuple[int, int], ...]:
    """(start, length) of the k + 1 segments of an evaluation string of ``n`` words; k is the most edits any partner is away."""
    k = max(n + m - 2 * bags.common(max(n, m), share) for m in partner_sizes(n, share))
    if k >= n:
        raise ValueError("a share so low leaves no segment untouched")
    cuts = [i * n // (k + 1) for i in range(k + 2)]
    return tuple((a, b - a) for a, b in zip(cuts, cuts[1:]))


@lru_cache(4096)
def substrings(m: int, share: float = bags.SHARE) -> tuple[tuple[int, int], ...]:
    """(start, length) of every substring of a training string of ``m`` words that a segment of a partner may be."""
    out = set()
    for n in partner_sizes(m, share):
        need = bags.common(max(n, m), share)
        for start, length in segments(n, share):
            out.update((p, length) for p in range(max(0, start - (n - need)), min(m - length, start + (m - need)) + 1))
    return tuple(sorted(out))


def _keys(flat: np.ndarray, first: np.ndarray, cut: list[tuple[tuple[int, int], ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and key of the substrings ``cut`` of every row; a key tells the words of a substring and their number."""
    row = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
    spans = np.array([x for c in cut for x in c], np.int64).reshape(-1, 2)
    power = np.uint64(0x9E3779B97F4A7C15)
    key = np.zeros(len(row), np.uint64)
    at, left = first[row] + spans[:, 0], spans[:, 1].copy()
    while True:  # one word further in all substrings that have one
        more = np.flatnonzero(left > 0)
        if not len(more):
            break
        key[more] = (key[more] ^ flat[at[more]]) * power
        key[more] ^= key[more] >> np.uint64(29)
        at[more] += 1
        left[more] -= 1
    return row, spans[:, 0], ((key + spans[:, 1].astype(np.uint64)) * power >> np.uint64(1)).astype(np.int64)


def _texts(columns: dict) -> list[str]:
    q, _ = forms.unify_texts(columns["question"])
    a, _ = forms.unify_texts(columns["answer"])
    return pc.binary_join_element_wise(q.fill_null(""), a.fill_null(""), "\n").to_pylist()


def _strings(items: DataFrame) -> DataFrame:
    """``id, split, string`` of every item with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = bags.Hasher()
        for b in batches:
            columns = dict(zip(b.schema.names, b.columns))
            at, strings = [], []
            for i, t in enumerate(_texts(columns)):
                found = bags.words(t)
                if found:
                    at.append(i), strings.append(sorted(hashed(found)))
            kept = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([columns["id"].take(kept), columns["split"].take(kept), pa.array(strings, pa.list_(pa.int64()))], names=["id", "split", "string"])

    return items.mapInArrow(run, "id string, split string, string array<bigint>")


def _cut(classes: DataFrame, side: str, share: float) -> DataFrame:
    """``key, start, bag, n, bits`` of the segments of evaluation strings (side e) or the substrings of training strings (t).

    ``bits`` has a bit for every word, so two strings differ in at least as many words as their bits do.
    """
    spans = segments if side == "e" else substrings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            first = lists.offsets.to_numpy().astype(np.int64)
            flat, first = lists.values.to_numpy().astype(np.uint64)[first[0] : first[-1]], first - first[0]
            n = np.diff(first)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (flat * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(58)), first[:-1]).view(np.int64)
            row, start, key = _keys(flat, first[:-1], [spans(x, share) for x in n.tolist()])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(start.astype(np.int32)), b.column(0).take(pa.array(row)), pa.array(n[row].astype(np.int32)), pa.array(bits[row])], names=["key", "start", "bag", "n", "bits"])

    mine = classes.where(F.col("side") == side).select("bag", "string").mapInArrow(run, "key bigint, start int, bag bigint, n int, bits bigint")
    return mine.select("key", F.col("start").alias(f"p{side}"), F.col("bag").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"b{side}"))


def _allowed(share: float) -> Column:
    """Whether a segment may have moved from its place to that of the substring, and whether the strings differ in few enough words."""
    need = F.ceil(share * F.greatest("ne", "nt") - 1e-9)
    moved = F.col("pt") - F.col("pe")
    edits = F.col("ne") + F.col("nt") - 2 * need
    return (F.least("ne", "nt") >= need) & moved.between(need - F.col("ne"), F.col("nt") - need) & (F.bit_count(F.col("be").bitwiseXOR(F.col("bt"))) <= edits)


def _verify(pairs: DataFrame, share: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [i for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())) if banded_common(x, y, need := bags.common(max(len(x), len(y)), share)) >= need]
            yield b.select(["e", "t"]).take(pa.array(keep, pa.int64()))

    return pairs.mapInArrow(run, "e bigint, t bigint")


def split_overlaps(items: DataFrame, share: float = bags.SHARE) -> DataFrame:
    """``eval_id, eval_split, train_id``: every pair of an evaluation and a training item similar in question and answer.

    ``items`` has id, split, question, reference_answer; letter case and outer spaces of ``split`` don't
    matter, rows with another split or none, or a null id, are left out; a null text counts as empty; an item without any word
    overlaps nothing. A row repeated under its id counts once. Items with equal words are compared once, then
    expanded to all their pairs, as each pair is a case. Other columns are ignored.
    """
    split = F.lower(F.trim("split"))
    base = items.where(F.col("id").isNotNull() & split.isin(*EVALUATION, TRAINING)).select(F.col("id").cast("string").alias("id"), split.alias("split"), "question", F.col("reference_answer").alias("answer"))
    rows = _strings(base).withColumn("side", F.when(F.col("split") == TRAINING, "t").otherwise("e")).withColumn("bag", F.xxhash64("string"))
    rows = stage(rows, "strings")
    classes = stage(rows.groupBy("side", "bag").agg(F.first("string").alias("string")), "classes")
    pairs = _cut(classes, "e", share).join(_cut(classes, "t", share), "key").where(_allowed(share)).select("e", "t").distinct()
    strings = lambda x, name: classes.where(F.col("side") == x).select(F.col("bag").alias(x), F.col("string").alias(name))
    found = _verify(pairs.join(strings("e", "se"), "e").join(strings("t", "st"), "t").select("e", "t", "se", "st"), share)
    ids = lambda x: rows.where(F.col("side") == x).select(F.col("bag").alias(x), F.col("id").alias(f"{x}_id"), F.col("split").alias(f"{x}_split")).distinct()
    return found.join(ids("e"), "e").join(ids("t"), "t").select(F.col("e_id").alias("eval_id"), F.col("e_split").alias("eval_split"), F.col("t_id").alias("train_id")).distinct()


def overlap_counts(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """``eval_split, provenance, n_items, n_pairs``: overlapping evaluation items and pairs, by split and source of the evaluation item."""
    source = items.groupBy(F.col("id").cast("string").alias("eval_id")).agg(F.min("provenance").alias("provenance"))
    return pairs.join(source, "eval_id").groupBy("eval_split", "provenance").agg(F.countDistinct("eval_id").alias("n_items"), F.count("*").alias("n_pairs"))
