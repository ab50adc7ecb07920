"""Problem 4: groups of texts that restate one another with small edits.

Copies (equal bags of words) become one class first. A class has a signature of minwise hashes, one byte each;
bands of that signature are its keys, and classes that share a key are candidates. A candidate pair is verified
sequentially: signatures are compared batch by batch, and the pair is dropped as soon as the posterior
probability that its similarity reaches the threshold falls below the miss probability; the survivors are
verified exactly. Verified pairs are consolidated into groups.

Bands depend on nothing but the text itself, so the chance to find a pair is the same in a corpus of any size and
whatever its words: see ``band_recall``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from . import bags
from .components import connected_groups

MIN_WORDS = 8
MISS = 1e-5
#: Signature: batches of minwise hashes, one byte each.
BATCH, BATCHES = 16, 8
#: Bands and hashes in a band. Bands share hashes, so they miss more than independent ones would: a pair of agreement
#: 0.739 (overlap 0.85 at equal size, the least there is) is missed with probability 0.04, one of overlap 0.88 with 0.006; see ``band_recall``.
BANDS, BAND = 44, 8
#: Keys are shuffled in so many rounds, each with its share of the bands, so that those of one round lie on disk at a time.
ROUNDS = 2
#: Texts under one key that are paired directly; larger groups are compared block by block.
DIRECT, BLOCK = 128, 1024
_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 62, BATCH * BATCHES, dtype=np.uint64) | np.uint64(1)


def _band_design(hashes: int, bands: int, size: int, seed: int = 100) -> np.ndarray:
    """The hashes of every band: the signature is shuffled and cut into bands, again and again, so that each hash serves equally often."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < bands:
        order = rng.permutation(hashes)
        out += [order[i : i + size] for i in range(0, hashes - size + 1, size)]
    return np.stack(out[:bands])


_PICKS = _band_design(BATCH * BATCHES, BANDS, BAND)


def signatures(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Minwise signatures of bags, one row each. ``tokens`` holds the bags one after the other, none of them empty."""
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    out = np.empty((len(sizes), BATCH * BATCHES), np.uint8)
    flat = tokens.astype(np.uint64)
    for k, m in enumerate(_MULTIPLIERS):
        least = np.minimum.reduceat((flat * m) >> np.uint64(32), start)
        out[:, k] = (least * np.uint64(0x9E3779B1) >> np.uint64(24)).astype(np.uint8)
    return out


def signature(tokens: list[int]) -> np.ndarray:
    """Minwise signature of one bag."""
    return signatures(np.array(tokens, np.int64), np.array([len(tokens)]))[0]


def band_keys(sigs: np.ndarray, bands: range = range(BANDS)) -> np.ndarray:
    """Keys of these bands of signatures: one row for each signature, one column for each band."""
    out = np.empty((len(sigs), len(bands)), np.int64)
    for at, k in enumerate(bands):
        packed = np.ascontiguousarray(sigs[:, _PICKS[k]]).view("<u8")[:, 0]
        mixed = (packed ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        out[:, at] = ((mixed ^ (mixed >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)
    return out


def band_recall(agreement: float, draws: int = 20_000) -> float:
    """Probability that two bags of this Jaccard similarity share a band, by simulation with the hashes that the bands really share."""
    equal = np.random.default_rng(5).random((draws, BATCH * BATCHES)) < agreement
    return float(np.any([equal[:, pick].all(1) for pick in _PICKS], 0).mean())


@lru_cache(64)
def least_matches(share: float = bags.SHARE, miss: float = MISS) -> np.ndarray:
    """Matches a pair needs after each batch to stay: fewer leave a posterior below ``miss``.

    Similar bags of equal size have the least Jaccard similarity, share / (2 - share); bytes that agree by chance only
    make more pairs pass. With a uniform prior
    the similarity after m of n matches is Beta(m + 1, n - m + 1); its upper tail is a binomial sum.
    """
    t = share / (2 - share)
    out = []
    for n in range(BATCH, BATCH * BATCHES + 1, BATCH):
        p = [math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(n + 2)]
        tail = np.cumsum(p)  # tail[m] = P(similarity > t | m matches)
        out.append(int(np.argmax(tail[: n + 1] >= miss)))
    return np.array(out)


def survives(a: np.ndarray, b: np.ndarray, share: float = bags.SHARE, miss: float = MISS) -> np.ndarray:
    """Sequential verification of pairs of signatures (rows of ``a`` and ``b``): which pairs reach the exact test."""
    alive, need = np.arange(len(a)), least_matches(share, miss)
    matches = np.zeros(len(a), np.int32)
    for k in range(BATCHES):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1)
        alive = alive[matches[alive] >= need[k]]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def similar(a: Counter[str], b: Counter[str], share: float = bags.SHARE) -> bool:
    """Whether two bags of words are similar."""
    sizes = a.total(), b.total()
    need = bags.common(max(sizes), share)
    return min(sizes) >= need and sum(min(n, b[w]) for w, n in a.items() if w in b) >= need


def _bags(df: DataFrame, min_words: int) -> DataFrame:
    """``id, bag, n, sig`` of every row with enough words."""
    kind = df.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = bags.Hasher()
        for b in batches:
            at, names, sizes, flat = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = bags.words(t) if t else []
                if len(found) >= min_words:
                    tokens = hashed(found)
                    at.append(i), names.append(bags.bag_name(tokens)), sizes.append(len(tokens))
                    flat += tokens
            if at:
                sigs = signatures(np.array(flat, np.int64), np.array(sizes))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), _binary(sigs)], names=["id", "bag", "n", "sig"])

    return df.where("id is not null").mapInArrow(run, f"id {kind.simpleString()}, bag binary, n int, sig binary")


def _binary(sigs: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow column."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(sigs.shape[1]), len(sigs), [None, pa.py_buffer(np.ascontiguousarray(sigs).tobytes())]).cast(pa.binary())


def _keyed(classes: DataFrame, bands: range = range(BANDS)) -> DataFrame:
    """``key, rep, n``: every class under each of its keys of these bands."""
    kind = classes.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = band_keys(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1), bands)
                each = pa.array(np.repeat(np.arange(b.num_rows), len(bands)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), b.column(0).take(each), b.column(1).take(each)], names=["key", "rep", "n"])

    return classes.select("rep", "n", "sig").mapInArrow(run, f"key bigint, rep {kind}, n int")


def _pairs(keyed: DataFrame, share: float) -> DataFrame:
    """``key, a, b``: pairs under a key, for keys of at most DIRECT texts; the texts of other keys come out one by one, with ``b`` null.

    The rows are sorted by key and read as a stream, so that no group is ever held as a whole.
    """
    kind = keyed.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "a", "b"]
        held: pa.Table | None = None  # rows of the last key, which may go on
        crowded = None  # a key known to have more than DIRECT rows

        def out(keys, a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), a, b], names=names)

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal crowded
            key, n, rep = t["key"].to_numpy(), t["n"].to_numpy(), t["rep"].combine_chunks()
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            big = (size > DIRECT) | (key[start] == crowded if crowded is not None else False)
            each = np.repeat(big, size)
            if each.any():
                at = np.flatnonzero(each)
                crowded = int(key[at[-1]])
                members = rep.take(pa.array(at))
                yield out(key[at], members, pa.nulls(len(at), members.type))
            left = np.flatnonzero(~each)
            for o in range(1, DIRECT):
                left = left[left + o < len(key)]
                left = left[key[left + o] == key[left]]
                if not len(left):
                    break
                near = np.minimum(n[left], n[left + o]) >= share * np.maximum(n[left], n[left + o]) - 1e-9
                x = left[near]
                if len(x):
                    yield out(np.zeros(len(x), np.int64), rep.take(pa.array(x)), rep.take(pa.array(x + o)))

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            key = t["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if len(key) - cut > DIRECT:  # the last key is crowded already: its rows needn't wait
                cut = len(key)
            held = t.slice(cut) if cut < len(key) else None
            if cut:
                yield from work(t.slice(0, cut))
        if held is not None:
            yield from work(held)

    rows = keyed.repartition("key").sortWithinPartitions("key", "rep")
    return rows.select("key", "n", "rep").mapInArrow(run, f"key bigint, a {kind}, b {kind}")


def _likely(pairs: DataFrame, share: float, miss: float) -> DataFrame:
    """The pairs ``a, b`` that survive the sequential comparison of their signatures ``sa, sb``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sa, sb = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, -1) for k in (2, 3))
                yield b.select(["a", "b"]).filter(pa.array(survives(sa, sb, share, miss)))

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.mapInArrow(run, f"a {kind}, b {kind}")


def _exact(pairs: DataFrame, share: float) -> DataFrame:
    """The pairs ``a, b`` whose texts ``ta, tb`` are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[str, Counter[str]] = {}  # a text is in many pairs of a batch

            def bag(t: str) -> Counter[str]:
                if t not in known:
                    known[t] = Counter(bags.words(t))
                return known[t]

            keep = [similar(bag(x), bag(y), share) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.mapInArrow(run, f"a {kind}, b {kind}")


def _within_blocks(crowded: DataFrame, texts: DataFrame, share: float, miss: float) -> DataFrame:
    """Links that connect the similar texts of every crowded key. All pairs of blocks are compared, but what
    is connected already isn't compared again, and only connecting links come out."""
    kind = texts.schema["id"].dataType.simpleString()
    blocks = crowded.withColumn("_of", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("_i", F.pmod(F.xxhash64("rep"), F.col("_of")).cast("int"))
    spread = blocks.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_of") - 1))).select("key", F.least("_i", "_j").alias("x"), F.greatest("_i", "_j").alias("y"), "rep")
    full = spread.join(texts.withColumnRenamed("id", "rep"), "rep")

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        hashed, found = bags.Hasher(), [bags.words(t) for t in pdf["text"]]
        whole = [Counter(x) for x in found]
        sigs, ids = signatures(np.concatenate([hashed(x) for x in found]), np.array([len(x) for x in found])), pdf["rep"].to_numpy()
        part = np.arange(len(ids))
        links = []
        for i in range(len(ids)):
            others = np.flatnonzero(part != part[i])
            others = others[survives(np.broadcast_to(sigs[i], (len(others), sigs.shape[1])), sigs[others], share, miss)]
            for j in others:
                if part[j] != part[i] and similar(whole[i], whole[j], share):
                    links.append((ids[i], ids[j]))
                    part[part == part[j]] = part[i]
        return pd.DataFrame(links, columns=["a", "b"])

    return full.groupBy("key", "x", "y").applyInPandas(unite, f"a {kind}, b {kind}")


def near_duplicate_groups(df: DataFrame, id_column: str, text: str, share: float = bags.SHARE, min_words: int = MIN_WORDS, miss: float = MISS) -> DataFrame:
    """``id_column, group_id, n_links`` of every text similar to another one.

    ``group_id`` is the least id of the group; ``n_links`` counts the links found by which the text (or the
    copies it stands with) was connected. Null and empty texts and texts of fewer than ``min_words`` words
    are in no group, as are rows with a null id. A row repeated under its id counts once; equal texts under
    different ids are similar. Other columns are ignored. An empty table gives an empty one.
    """
    base = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = stage(_bags(base, min_words), "bags", release=True)
    firsts = rows.groupBy("bag").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = stage(firsts, "classes", release=True)
    rounds = [stage(_pairs(_keyed(classes, range(BANDS)[k::ROUNDS]), share).distinct(), "pairs", release=True) for k in range(ROUNDS)]
    found = reduce(DataFrame.union, rounds)
    pairs = found.where("b is not null").select("a", "b").distinct()
    sig = lambda x: classes.select(F.col("rep").alias(x), F.col("sig").alias(f"s{x}"))
    likely = stage(_likely(pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sa", "sb"), share, miss), "likely", release=True)
    # keys of many texts, as of a large family of restatements
    full = found.where("b is null").select("key", F.col("a").alias("rep"))
    crowded = full.join(full.groupBy("key").agg(F.count("*").alias("c")), "key")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("id")).union(full.select("rep")).distinct()
    texts = stage(base.join(wanted, "id", "left_semi").dropDuplicates(["id"]), "texts", release=True)
    text_of = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}"))
    sure = _exact(likely.join(text_of("a"), "a").join(text_of("b"), "b").select("a", "b", "ta", "tb"), share)
    links = stage(sure.union(_within_blocks(crowded, texts, share, miss)), "links", release=True)
    groups = connected_groups(links, "a", "b").select(F.col("id").alias("rep"), "group_id")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    reps = classes.select("bag", "rep", "last").join(groups, "rep", "left").join(degree, "rep", "left").where("rep <> last or group_id is not null")
    return rows.select("id", "bag").join(reps, "bag").select(F.col("id").alias(id_column), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")).distinct()
