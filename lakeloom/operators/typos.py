"""Correction of words by the nearest of a vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage

#: Letters from which a word may be two edits away, and least letters of a word to correct.
LONG, LEAST = 8, 3
#: Reductions that meet in one group on average, and that are hashed at a time.
BUCKET, BLOCK = 1 << 20, 1 << 20


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; no stretch is edited twice."""
    above, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, above[j - 2] + 1)
            row.append(best)
        above, last = last, row
    return last[-1]


def edit_distances(a: pd.Series, b: pd.Series) -> np.ndarray:
    """``edit_distance`` of every pair, all pairs of equal lengths at once."""
    out = np.zeros(len(a), np.int32)
    sizes = pd.DataFrame({"a": a.str.len().to_numpy(), "b": b.str.len().to_numpy()})
    for (n, m), at in sizes.groupby(["a", "b"]).indices.items():
        x, y = _letters(a.iloc[at], n).T, _letters(b.iloc[at], m).T  # a row for every place of a letter
        above, last = [], [np.full(len(at), j, np.int32) for j in range(m + 1)]
        for i in range(1, n + 1):
            row = [np.full(len(at), i, np.int32)]
            for j in range(1, m + 1):
                best = np.minimum(np.minimum(last[j], row[-1]) + 1, last[j - 1] + (x[i - 1] != y[j - 1]))
                if i > 1 and j > 1:
                    swapped = (x[i - 1] == y[j - 2]) & (x[i - 2] == y[j - 1])
                    best = np.where(swapped, np.minimum(best, above[j - 2] + 1), best)
                row.append(best)
            above, last = last, row
        out[at] = last[-1]
    return out


def _letters(words: pd.Series, size: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), size)


# fixed values: an odd base, its inverse modulo 2^64, and a multiplier to mix with
_BASE = 0x9E3779B97F4A7C15
_BACK, _MIX = pow(_BASE, -1, 1 << 64), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return (h ^ (h >> np.uint64(27))) * _MIX


def reductions_of(letters: np.ndarray, edits: int) -> Iterator[np.ndarray]:
    """Hashes of words of one length, and of what is left of them after up to ``edits`` (2) deletions, a row a word.

    Words within that distance share one. A hash is a sum of powers of the base, so that of a shortened word comes from sums of stretches.
    """
    n, size = letters.shape
    powers = np.array([pow(_BASE, k, 1 << 64) for k in range(size)], np.uint64)
    sums = np.zeros((n, size + 1), np.uint64)
    np.cumsum(_mixed(letters.astype(np.uint64) + np.uint64(1)) * powers, axis=1, out=sums[:, 1:])
    end, once, twice = sums[:, -1:], np.uint64(_BACK), np.uint64(_BACK * _BACK % (1 << 64))
    yield end
    if edits and size:
        yield sums[:, :-1] + (end - sums[:, 1:]) * once
    if edits > 1 and size > 1:
        for i in range(size - 1):  # without letters i and j > i
            yield sums[:, i : i + 1] + (sums[:, i + 1 : -1] - sums[:, i + 1 : i + 2]) * once + (end - sums[:, i + 2 :]) * twice


def _reduced(words: DataFrame, buckets: int) -> DataFrame:
    """``bucket, hashes, ids``: reductions of ``id, word, edits, plain``, packed by a bucket of their hash."""

    def packed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, ids = (np.concatenate(x) for x in zip(*parts))
        place = (h % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(place, kind="stable")
        h, ids, place = h[order], ids[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        ends = [*first[1:], len(place)]
        cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(first, ends)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(place[first]), cut(h), cut(ids)], names=["bucket", "hashes", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            rows = b.to_pandas()
            for (size, edits, plain), w in rows.groupby([rows["word"].str.len(), "edits", "plain"]):
                step = max(1, BLOCK // (1 + size * edits * (size if edits > 1 else 1)))
                for lo in range(0, len(w), step):
                    some = w.iloc[lo : lo + step]
                    ids = some["id"].to_numpy(np.int64)
                    for h in reductions_of(_letters(some["word"], size), edits):
                        parts.append((_mixed(h + np.uint64(2 * edits + plain)).ravel(), np.repeat(ids, h.shape[1])))
                        held += h.size
                    if held >= BLOCK:
                        yield packed(parts)
                        parts, held = [], 0
        if parts:
            yield packed(parts)

    return words.select("id", "word", "edits", "plain").mapInArrow(run, "bucket int, hashes binary, ids binary")


def _meeting(tokens: pa.Table, words: pa.Table) -> pa.Table:
    """Pairs of ids that share a reduction, in one bucket."""

    def sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        h, ids = (np.frombuffer(b"".join(t[c].to_pylist()), k) for c, k in (("hashes", np.uint64), ("ids", np.int64)))
        order = np.argsort(h, kind="stable")
        return h[order], ids[order]

    (a, x), (b, y) = sides(tokens), sides(words)
    lo, hi = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
    n = hi - lo
    left = np.repeat(x, n)
    right = y[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
    return pa.table({"t": left, "w": right}).group_by(["t", "w"]).aggregate([])


def nearest_words(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``token, nearest, distance``: the vocabulary's word with the least edit distance, ties by the word; none if too far.

    A token of more than ``LONG`` letters may be two edits away, a shorter one (of at least ``LEAST``) one. Numbers aren't
    corrected, nor letters by digits. Both sides meet by their reductions, so that no token is compared with the whole vocabulary.
    """
    plain = lambda c: F.replace(F.col(c), F.lit("'"), F.lit("")).rlike(r"^\p{L}+$").alias("plain")
    t = tokens.where((F.length(F.replace(F.col("token"), F.lit("'"), F.lit(""))) >= LEAST) & ~F.col("token").rlike(r"^\d+$")).distinct()
    t = stage(t.select(F.monotonically_increasing_id().alias("id"), F.col("token").alias("word"), F.when(F.length("token") > LONG, 2).otherwise(1).alias("edits"), plain("token")), "typo-tokens")
    v = stage(vocabulary.where("token is not null").select("token").distinct().select(F.monotonically_increasing_id().alias("id"), F.col("token").alias("word"), plain("token")), "typo-words")
    # a row for each length of a word: which lengths may meet, and how many reductions there are
    sizes = lambda df, *by: df.groupBy(F.length("word").alias("size"), *by).agg(F.count("*").alias("n")).collect()
    of_tokens, of_words = sizes(t, "edits"), sizes(v)
    wanted = {e: {r["size"] + k for r in of_tokens if r["edits"] == e for k in range(-e, e + 1)} for e in (1, 2)}
    many = lambda size, e: 1 + size + (size * (size - 1) // 2 if e > 1 else 0)
    total = sum(r["n"] * many(r["size"], r["edits"]) for r in of_tokens) + sum(r["n"] * many(r["size"], e) for r in of_words for e in wanted if r["size"] in wanted[e])
    near = F.array_compact(F.array(*[F.when(F.length("word").isin(sorted(wanted[e])), e) for e in wanted]))
    by_edits = v.select("id", "word", "plain", F.explode(near).alias("edits"))
    buckets = -(-total // BUCKET) or 1
    # what is joined here outgrows the tables it comes from, so no side is told small from them
    met = _reduced(t, buckets).groupBy("bucket").cogroup(_reduced(by_edits, buckets).groupBy("bucket")).applyInArrow(_meeting, "t long, w long").distinct()

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(edit_distances(a, b))

    named = met.join(t.select(F.col("id").alias("t"), F.col("word").alias("token"), "edits").hint("merge"), "t").join(v.select(F.col("id").alias("w"), "word").hint("merge"), "w")
    found = named.withColumn("d", distance("token", "word")).where("d <= edits")
    return found.groupBy("token").agg(F.min_by(F.struct("word", "d"), F.struct("d", "word")).alias("b")).select("token", F.col("b.word").alias("nearest"), F.col("b.d").alias("distance"))
