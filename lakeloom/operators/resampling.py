"""Resampling and tests over rows: bootstrap of items, intervals, correlations, permutation and selection adjustment.

Draws come from md5 of seed, replicate and draw, so that they are equal in every engine and don't depend on how
rows are partitioned. A bootstrap draws items by their position in the order of their ids. Its work is resamples
times items; for large groups ``poisson_means`` needs one pass and no order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .running import running_sums


def hashed_number(*parts: Column) -> Column:
    """A number below 2^32 that depends on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 8), 16, 10).cast("long")


#: fixed values: distribution function of Poisson(1)
_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def poisson_times(number: Column) -> Column:
    """A Poisson(1) count told from a hashed number."""
    u = (number + 0.5) / float(1 << 32)
    return sum([(u > s).cast("int") for s in _POISSON[1:]], (u > _POISSON[0]).cast("int"))


#: fixed values: shifts and constants of md5
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
#: Draws hashed at a time, items a row holds, draws a task should make.
CHUNK, PACK, SHARE = 1 << 14, 1 << 16, 1 << 24
#: Most tasks that the draws of a large group are shared by; each is sent the group's values.
MOST_PARTS = 32


def _first_word(words: dict[int, np.ndarray | int], size: int) -> np.ndarray:
    """First 32 bits of the md5 of messages of one block each, all of ``size`` bytes, given as words (absent ones are 0)."""
    m, n = words | {14: size * 8}, next(len(w) for w in words.values() if isinstance(w, np.ndarray))
    start, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    a = start
    for i in range(64):
        if i < 16:
            f, g = ((c ^ d) & b) ^ d, i
        elif i < 32:
            f, g = ((b ^ c) & d) ^ c, (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = (b | ~d) ^ c, 7 * i % 16
        w, s = m.get(g, 0), np.uint32(_SHIFTS[i // 16][i % 4])
        f += a
        if isinstance(w, np.ndarray):
            f += w
            w = 0
        f += np.uint32((_SINES[i] + w) & 0xFFFFFFFF)
        high = f << s
        f >>= np.uint32(32) - s
        high |= f
        high += b
        a, d, c, b = d, c, b, high
    return (a + start).byteswap()


def drawn_numbers(seed: int, replicates: list[int], lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
    """``hashed_number`` of seed, replicate and every draw from ``lo`` to below ``hi``, in stretches: (place in ``replicates``, numbers)."""
    while lo < hi:
        digits = len(str(lo))
        end = min(hi, lo + CHUNK, 10**digits)
        # the digits and the end mark as bytes, and as words for each place within a word at which they may begin
        x, text = np.arange(lo, end), np.full((end - lo, digits + 1), 0x80, np.uint8)
        for k in range(digits):
            text[:, digits - 1 - k] = 48 + x // 10**k % 10
        placed: dict[int, list[np.ndarray]] = {}
        for at, r in enumerate(replicates):
            prefix = f"{seed}-{r}-".encode()
            whole, begun = divmod(len(prefix), 4)
            assert len(prefix) + digits < 56
            if begun not in placed:
                room = np.zeros((end - lo, -(-(begun + digits + 1) // 4) * 4), np.uint8)
                room[:, begun : begun + digits + 1] = text
                placed[begun] = [w.copy() for w in room.view("<u4").T]
            words: dict[int, np.ndarray | int] = {i: int.from_bytes(prefix[4 * i : 4 * i + 4], "little") for i in range(whole)}
            words |= {whole + i: w for i, w in enumerate(placed[begun])}
            if begun:
                words[whole] = words[whole] | np.uint32(int.from_bytes(prefix[4 * whole :], "little"))
            yield at, _first_word(words, len(prefix) + digits)
        lo = end


def bootstrap_items(df: DataFrame, group: str, key: str, value: str, resamples: int, seed: int = 13) -> DataFrame:
    """``group, replicate, mean``: each replicate draws as many items of the group as it has, with replacement.

    Null values are no items; every group has all its replicates. Keys must be distinct within a group. The draws are
    never rows: a task has the values of a group and makes some of its replicates, so values are all that is shuffled.
    """
    w = Window.partitionBy(group).orderBy(key)
    items = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"), (F.row_number().over(w) - 1).alias("i"))
    packs = items.groupBy("g", F.floor(F.col("i") / PACK).alias("pack")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vs"))
    sized = packs.withColumn("n", F.sum(F.size("vs")).over(Window.partitionBy("g")))
    parts = F.least(F.lit(MOST_PARTS), F.lit(resamples), F.ceil(F.col("n") * resamples / SHARE)).cast("int")
    rows = sized.select("g", "pack", "vs", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    kind = items.schema["g"].dataType

    def means(packed: pa.Table) -> pa.Table:
        packed = packed.sort_by("pack")
        v = np.concatenate([c.flatten().to_numpy() for c in packed["vs"].chunks])
        replicates = list(range(packed["part"][0].as_py(), resamples, packed["parts"][0].as_py()))
        sums, n = np.zeros(len(replicates)), np.uint32(len(v))
        for at, h in drawn_numbers(seed, replicates, 0, len(v)):
            sums[at] += v[h - h // n * n].sum()
        g = pa.concat_arrays([packed["g"].chunk(0).slice(0, 1)] * len(replicates))
        return pa.table({"g": g, "replicate": pa.array(replicates, pa.int64()), "mean": pa.array(sums / len(v))})

    drawn = rows.groupBy("g", "part").applyInArrow(means, StructType([StructField("g", kind), StructField("replicate", LongType()), StructField("mean", DoubleType())]))
    return drawn.select(F.col("g").alias(group), "replicate", F.round("mean", 6).alias("mean"))


def poisson_means(df: DataFrame, group: str, key: str, value: str, resamples: int, seed: int = 13) -> DataFrame:
    """``group, replicate, mean``: an item counts Poisson(1) times in each replicate, told from a hash of its key.

    One pass with partial sums: nothing is ordered, joined or held, so it fits groups of any size. A replicate that
    drew nothing has a null mean.
    """
    times = poisson_times(hashed_number(F.lit(str(seed)), F.col("replicate"), F.col(key)))
    rows = df.where(F.col(value).isNotNull()).select(F.col(group), F.col(key), F.col(value).cast("double").alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("replicate"))
    drawn = rows.withColumn("_t", times)
    total = F.sum("_t")
    return drawn.groupBy(group, "replicate").agg(F.when(total > 0, F.round(F.sum(F.col("_t") * F.col("_v")) / total, 6)).alias("mean")).withColumn("replicate", F.col("replicate").cast("long"))


def percentile_interval(samples: DataFrame, group: str, value: str, confidence: float = 0.95, truncated: bool = False) -> DataFrame:
    """``group, low, high``: the samples at the tails of the sorted list, at the nearest rank or the truncated index."""
    tail = (1 - confidence) / 2
    listed = samples.where(F.col(value).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("s"))  # as long as there are replicates

    def at(q: float) -> Column:
        n = F.size("s")
        index = F.floor(F.lit(q) * n) if truncated else F.bround(F.lit(q) * (n - 1))
        return F.get("s", F.least(index.cast("int"), n - 1))

    return listed.select(group, at(tail).alias("low"), at(1 - tail).alias("high"))


def exceedance(samples: DataFrame, group: str, value: str, level: float = 0.0) -> DataFrame:
    """``group, share``: share of the samples above a level."""
    return samples.groupBy(group).agg(F.round(F.avg((F.col(value) > level).cast("double")), 9).alias("share"))


def average_ranks(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """``df`` with the rank of ``value`` in its group; ties share the mean of their ranks."""
    order, tie = Window.partitionBy(group).orderBy(value), Window.partitionBy(group, value)
    return df.withColumn(out, F.rank().over(order) + (F.count("*").over(tie) - 1) / 2)


def correlations(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """``group, n, pearson, spearman`` over rows with both values; null without variance (spearman 0)."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(group), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    ranked = average_ranks(average_ranks(both, group, "a", "ra"), group, "b", "rb")

    def corr(x: str, y: str) -> Column:
        return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y))

    return ranked.groupBy(group).agg(F.count("*").alias("n"), F.round(corr("a", "b"), 6).alias("pearson"), F.coalesce(F.round(corr("ra", "rb"), 6), F.lit(0.0)).alias("spearman"))


def fleiss_kappa(df: DataFrame, item: str, label: str) -> DataFrame:
    """``items, raters, kappa`` of labels given to items by equally many raters; 1 where all labels are one, null without items."""
    cells = df.where(F.col(item).isNotNull() & F.col(label).isNotNull()).groupBy(item, label).agg(F.count("*").alias("n"))
    per = cells.groupBy(item).agg(F.sum("n").alias("r"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agreeing")).where("r > 1")
    rated = cells.join(per.select(item, "r"), item)
    mean = per.agg(F.count("*").alias("items"), F.max("r").alias("raters"), F.avg(F.col("agreeing") / (F.col("r") * (F.col("r") - 1))).alias("p"))
    share = rated.groupBy(label).agg(F.sum("n").alias("n"))
    chance = share.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("e"))  # one row
    return mean.join(F.broadcast(chance)).select("items", "raters", F.round(F.when(F.col("e") == 1, 1.0).otherwise((F.col("p") - F.col("e")) / (1 - F.col("e"))), 9).alias("kappa"))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; the whole range for no trials."""
    p, zz = successes / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z / (1 + zz / n) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.when(n == 0, 0.0).otherwise(F.greatest(mid - half, F.lit(0.0))), F.when(n == 0, 1.0).otherwise(F.least(mid + half, F.lit(1.0)))


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact sign test as a column; the tail is a sum of binomial terms in logarithms. 1 without differing pairs."""
    n, k = wins + losses, F.least(wins, losses)

    def term(acc: Column, i: Column) -> Column:
        # log of C(n, i) from that of C(n, i - 1), and the sum of the terms in units of 2^-n
        log = acc["log"] + F.when(i > 0, F.log((n - i + 1) / i)).otherwise(0.0)
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log - n * F.log(F.lit(2.0)))).alias("sum"))

    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")), start, term, lambda x: x["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def sign_flips(deltas: DataFrame, group: str, value: str, key: str, resamples: int = 2000, seed: int = 13) -> DataFrame:
    """``group, n, p``: one-sided test of a mean above zero by flipping signs; (x + 1) / (resamples + 1).

    A sign is the parity of a hash of seed, replicate and key. Zero differences take no part.
    """
    d = deltas.where(F.col(value).isNotNull() & (F.col(value) != 0)).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    signed = d.select("g", "v", "k", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    flip = F.when(hashed_number(F.lit(str(seed)), F.col("r"), F.col("k")) % 2 == 0, F.abs("v")).otherwise(-F.abs("v"))
    sums = signed.groupBy("g", "r").agg(F.sum(flip).alias("s"))
    seen = d.groupBy("g").agg(F.sum("v").alias("seen"), F.count("*").alias("n"))
    both = sums.alias("x").join(seen.alias("y"), F.col("x.g").eqNullSafe(F.col("y.g"))).select("y.g", "n", "s", "seen")
    return both.groupBy("g", "n").agg(F.round((F.count_if(F.col("s") >= F.col("seen") - 1e-9) + 1) / F.lit(resamples + 1), 9).alias("p")).withColumnRenamed("g", group)


def step_down(tests: DataFrame, name: str, p: str) -> DataFrame:
    """``name, p, adjusted``: family-wise p-values of few tests, step down (the running maximum of (m - i) p), at most 1."""
    order = Window.orderBy(p, name)  # a family of tests is small
    ranked = tests.select(name, p).withColumn("_i", F.row_number().over(order)).withColumn("_m", F.count("*").over(Window.partitionBy()))
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * F.col(p))
    return ranked.select(name, p, F.round(F.max(step).over(order.rowsBetween(Window.unboundedPreceding, 0)), 9).alias("adjusted"))


def rank_auc(df: DataFrame, label: Column, value: str, weight: Column) -> DataFrame:
    """``auc``: chance that a positive outranks a negative drawn by weight, ties count half.

    Sums by distinct value first, then running sums over those values.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.sum(label.cast("double")).alias("pos"), F.sum(F.when(~label, weight).otherwise(0.0)).alias("neg"))
    ranked = running_sums(cells, "v", ["neg"])
    total = F.sum("pos") * F.sum("neg")
    return ranked.agg(F.when(total > 0, F.round(F.sum(F.col("pos") * (F.col("neg_run") - F.col("neg") / 2)) / total, 9)).alias("auc"))


def best_threshold(df: DataFrame, label: Column, value: str) -> DataFrame:
    """``threshold, precision, recall, f1``: the cut (value at or above) of the best F1; ties by precision, then the stricter cut."""
    cells = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.sum(label.cast("long")).alias("pos"), F.count("*").alias("n"))
    run = running_sums(cells, "v", ["pos", "n"], descending=True).crossJoin(F.broadcast(cells.agg(F.sum("pos").alias("true"))))  # one row
    run = run.select("v", F.col("pos_run").alias("tp"), F.col("n_run").alias("all"), "true")
    pr, rc = F.col("tp") / F.col("all"), F.when(F.col("true") > 0, F.col("tp") / F.col("true")).otherwise(0.0)
    scored = run.select("v", F.round(pr, 9).alias("pr"), F.round(rc, 9).alias("rc"), F.round(F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0), 9).alias("f"))
    best = scored.agg(F.max_by(F.struct("v", "pr", "rc", "f"), F.struct("f", "pr", "v")).alias("b"))
    return best.select(F.col("b.v").alias("threshold"), F.col("b.pr").alias("precision"), F.col("b.rc").alias("recall"), F.col("b.f").alias("f1"))


def two_way_shares(df: DataFrame, left: str, right: str, flag: str, resamples: int) -> DataFrame:
    """``replicate, share``: a share over pairs, resampled by their left and right sides at once with Poisson counts.

    A pair counts the product of its sides' counts; pairs of one side thus move together. Sums only, nothing is joined.
    """
    rows = df.select(left, right, flag, F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("replicate"))
    t = poisson_times(hashed_number(F.lit("l"), F.col("replicate"), F.col(left))) * poisson_times(hashed_number(F.lit("r"), F.col("replicate"), F.col(right)))
    g = rows.withColumn("_t", t).groupBy(F.col("replicate").cast("long").alias("replicate")).agg(F.sum("_t").alias("_n"), F.sum(F.when(F.col(flag), F.col("_t")).otherwise(0)).alias("_y"))
    return g.where("_n > 0").select("replicate", F.round(F.col("_y") / F.col("_n"), 6).alias("share"))
