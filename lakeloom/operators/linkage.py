"""Record linkage: blocked comparison, agreement weights, as-of matching."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running_sums


def linked_pairs(df: DataFrame, key: str, block: list[Column], compare: dict[str, tuple[Column, float, float]], threshold: float, prior: float = 0.01) -> DataFrame:
    """``left_id, right_id, match_weight, match_probability``: pairs within a block, weighed by agreement of fields.

    A field with rates (m, u) adds log2(m / u) if equal and log2((1 - m) / (1 - u)) if not; a null on either
    side adds nothing. Null blocks pair nothing.
    """
    fields = list(compare)
    base = df.select(F.col(key).alias("id"), F.concat_ws("\u0001", *block).alias("b"), F.greatest(*[c.isNull().cast("int") for c in block], F.lit(0)).alias("hole"), *[c.alias(f"f_{n}") for n, (c, _, _) in compare.items()]).where("hole = 0").drop("hole")
    a, b = (base.select(F.col("id").alias(f"id_{x}"), "b", *[F.col(f"f_{n}").alias(f"{n}_{x}") for n in fields]) for x in "lr")
    pairs = a.join(b, "b").where("id_l < id_r")
    weight = F.lit(math.log2(prior / (1 - prior)))
    for n, (_, m, u) in compare.items():
        x, y = F.col(f"{n}_l"), F.col(f"{n}_r")
        weight = weight + F.when(x.isNull() | y.isNull(), 0.0).when(x == y, math.log2(m / u)).otherwise(math.log2((1 - m) / (1 - u)))
    odds = F.pow(F.lit(2.0), F.col("match_weight"))
    return pairs.select(F.col("id_l").alias("left_id"), F.col("id_r").alias("right_id"), F.round(weight, 6).alias("match_weight")).withColumn("match_probability", F.round(odds / (1 + odds), 9)).where(F.col("match_probability") >= threshold)


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, key: str, order: str) -> DataFrame:
    """``key, order``: for each left row the last right row (by ``at``, then ``order``) at or before it, or null.

    One pass over both sides sorted together; nothing is paired.
    """
    both = left.select(by, F.col(at).alias("at"), F.lit(1).alias("side"), F.col(key).alias("k"), F.lit(None).cast("long").alias("o")).union(right.select(by, at, F.lit(0), F.lit(None).cast("long"), F.col(order)))
    w = Window.partitionBy(by).orderBy("at", "side", "o", "k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("last", F.last("o", ignorenulls=True).over(w)).where("side = 1").select(F.col("k").alias(key), F.col("last").alias(order))


def levels(left: Column, right: Column, tests: list[Column]) -> Column:
    """Agreement of two values as a level: the first test that holds counts most, 0 if none does, -1 if a value is missing."""
    n, out = len(tests), F.when(left.isNull() | right.isNull(), -1)
    for i, t in enumerate(tests):
        out = out.when(t, n - i)
    return out.otherwise(0)


def edit_levels(left: Column, right: Column, distances: list[int]) -> Column:
    return levels(left, right, [left == right, *[F.levenshtein(left, right) <= d for d in distances]])


def date_levels(left: Column, right: Column, days: list[int]) -> Column:
    """Dates as ISO text."""
    return levels(left, right, [F.abs(F.datediff(F.to_date(left), F.to_date(right))) <= d for d in days])


def set_levels(left: Column, right: Column, jaccard: list[float], containment: list[float]) -> Column:
    """Sets: first what they share of both, then of the smaller one."""
    both = F.size(F.array_intersect(left, right))
    union, small = F.size(left) + F.size(right) - both, F.least(F.size(left), F.size(right))
    return levels(left, right, [(union > 0) & (both >= t * union) for t in jaccard] + [(small > 0) & (both >= t * small) for t in containment])


def patterns(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """Histogram of agreement patterns: what training needs of the pairs, however many there are."""
    return pairs.groupBy(*fields).agg(F.count("*").alias("n"))


#: Tasks at most that count a group, each sent all of it; pairs of rows that one should have.
MOST_PARTS, PAIRS = 16, 1 << 24


class _Equal:
    """Levels of one value against all: 1 if equal, -1 if either is missing. Values are numbered, missing is -1."""

    levels = 3

    def __init__(self, values: pd.Series) -> None:
        self.at, self.values = pd.factorize(values)

    def row(self, k: int) -> np.ndarray:
        """Level + 1 of the value numbered ``k`` against every distinct value, then against a missing one."""
        out = np.zeros(len(self.values) + 1, np.int64)
        if k >= 0:
            out[:-1] = 1
            self.fill(k, out)
        return out

    def fill(self, k: int, out: np.ndarray) -> None:
        out[k] = 2


class _Edited(_Equal):
    """Texts: 2 if equal, 1 within one insertion, deletion or substitution."""

    levels = 4

    def __init__(self, values: pd.Series) -> None:
        super().__init__(values)
        self.exact, self.holes = {v: i for i, v in enumerate(self.values)}, defaultdict(list)
        for i, v in enumerate(self.values):
            for j in range(len(v)):
                self.holes[v[:j], v[j + 1 :]].append(i)  # without the letter at this place

    def fill(self, k: int, out: np.ndarray) -> None:
        v = self.values[k]
        for j in range(len(v) + 1):
            out[self.holes.get((v[:j], v[j:]), [])] = 2  # one letter more here
            if j < len(v):
                out[self.holes[v[:j], v[j + 1 :]]] = 2  # another letter here
                if v[:j] + v[j + 1 :] in self.exact:
                    out[self.exact[v[:j] + v[j + 1 :]]] = 2
        out[k] = 3


class _Sets(_Equal):
    """Sets, as sorted words with spaces between: 2 if they share ``jaccard`` of both, 1 if ``containment`` of the smaller."""

    levels = 4

    def __init__(self, values: pd.Series, jaccard: float, containment: float) -> None:
        super().__init__(values)
        self.least, self.sets = (jaccard, containment), [v.split() for v in self.values]
        self.sizes, self.having = np.array([len(s) for s in self.sets], np.int64), defaultdict(list)
        for i, s in enumerate(self.sets):
            for w in s:
                self.having[w].append(i)

    def fill(self, k: int, out: np.ndarray) -> None:
        both = np.zeros(len(self.sets), np.int64)
        for w in self.sets[k]:
            both[self.having[w]] += 1
        union, small = self.sizes + len(self.sets[k]) - both, np.minimum(self.sizes, len(self.sets[k]))
        out[:-1][(small > 0) & (both >= self.least[1] * small)] = 2
        out[:-1][(union > 0) & (both >= self.least[0] * union)] = 3


def _ordered_counts(rows: pd.DataFrame, jaccard: float, containment: float, days: list[int], part: int, parts: int) -> dict[tuple[int, ...], int]:
    """Ordered pairs of rows, without those of a row and itself, by levels of language, version, day and name: those whose
    first row's profile (all but the day) is one of this part. ``rows`` has a count ``n``.
    """
    fields = [_Equal(rows["language"]), _Edited(rows["version"]), _Sets(rows["name"], jaccard, containment)]
    codes, first = np.unique(np.stack([f.at for f in fields]), axis=1, return_inverse=True)
    first, n = first.ravel(), rows["n"].to_numpy(np.int64)
    day = rows["day"].to_numpy(np.float64)
    has = ~np.isnan(day)
    sums = lambda at, w, k: np.bincount(at, w, k).astype(np.int64)  # noqa: E731  (exact below 2^53)
    every, dated = sums(first, n, codes.shape[1]), sums(first[has], n[has], codes.shape[1])
    order = np.flatnonzero(has)[np.argsort(day[has], kind="stable")]
    day, of, n = day[order], first[order], n[order]
    by_profile = np.argsort(of, kind="stable")
    begins = np.searchsorted(of[by_profile], np.arange(codes.shape[1] + 1))
    edges = [(np.searchsorted(day, day - w, "left"), np.searchsorted(day, day + w, "right")) for w in days]
    kinds = fields[0].levels * fields[1].levels * fields[2].levels
    out: dict[tuple[int, ...], int] = defaultdict(int)
    for p in range(part, codes.shape[1], parts):
        code = np.zeros(codes.shape[1], np.int64)
        for f, k, at in zip(fields, codes[:, p], codes):
            code = code * f.levels + f.row(k)[at]
        both = sums(code, dated, kinds) * dated[p]
        within = []
        for lo, hi in edges:
            w = np.zeros(kinds, np.int64)
            for c in by_profile[begins[p] : begins[p + 1]]:
                w += n[c] * sums(code[of[lo[c] : hi[c]]], n[lo[c] : hi[c]], kinds)
            w[code[p]] -= dated[p]
            within.append(w)
        either = sums(code, every, kinds) * every[p] - both
        either[code[p]] -= every[p] - dated[p]
        both[code[p]] -= dated[p]
        # levels of the day from the nearest: what a window has more than the one within it
        nested = [within[0], *[b - a for a, b in zip(within, within[1:])], both - within[-1]]
        for level, counts in [(-1, either), *((len(days) - i, c) for i, c in enumerate(nested))]:
            for k in np.flatnonzero(counts):
                a, bc = divmod(int(k), fields[1].levels * fields[2].levels)
                b, c = divmod(bc, fields[2].levels)
                out[a - 1, b - 1, level, c - 1] += int(counts[k])
    return out


def counted_patterns(df: DataFrame, key: str, block: str, language: str, version: str, day: str, words: str, jaccard: float, containment: float, days: list[int]) -> DataFrame:
    """``language, version, dated, name, n``: ``patterns`` of all pairs of rows of a block whose keys differ, without making the pairs.

    Rows of equal values are one with a count. Every distinct language, version and set of words (a profile) is compared
    with every other; dates only with those within the largest of ``days`` (ascending), for the rest follow from sums.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(block).isNotNull()).select(
        F.col(key).alias("key"), F.col(block).alias("block"), F.col(language).alias("language"), F.col(version).alias("version"), F.unix_date(F.to_date(day)).alias("day"), F.when(F.col(words).isNotNull(), F.array_join(F.array_sort(words), " ")).alias("name")
    )
    cells = rows.groupBy("block", "language", "version", "day", "name").agg(F.count("*").alias("n")).withColumn("sign", F.lit(1)).withColumn("key", F.lit(None).cast(rows.schema["key"].dataType))
    again = rows.groupBy("block", "key").agg(F.count("*").alias("k")).where("k > 1").select("block", "key")
    # pairs of one key don't count
    same = rows.join(again, ["block", "key"]).groupBy("block", "language", "version", "day", "name", "key").agg(F.count("*").alias("n")).withColumn("sign", F.lit(-1))
    whole = cells.select(*same.columns).union(same)
    size = whole.groupBy("block", "key").agg(F.least(F.lit(MOST_PARTS), F.ceil(F.count("*") * F.count("*") / PAIRS)).cast("int").alias("parts"))
    sized = whole.alias("x").join(size.alias("y"), (F.col("x.block") == F.col("y.block")) & F.col("x.key").eqNullSafe(F.col("y.key"))).select("x.*", "parts")
    shared = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _ordered_counts(pdf, jaccard, containment, days, int(pdf["part"].iat[0]), int(pdf["parts"].iat[0]))
        return pd.DataFrame([(*k, n * int(pdf["sign"].iat[0])) for k, n in found.items()], columns=["language", "version", "dated", "name", "n"])

    counted = shared.groupBy("block", "key", "part").applyInPandas(run, "language int, version int, dated int, name int, n long")
    return counted.groupBy("language", "version", "dated", "name").agg(F.expr("sum(n) div 2").alias("n")).where("n > 0")


#: Rows on either side of a tile, which is what a task pairs at a time; pairs in a batch.
SIDE, BATCH = 2048, 1 << 15


def _tiles(df: DataFrame, key: str, block: str) -> DataFrame:
    """``left, right``: arrays of at most SIDE rows in order of the key. Any two rows of a block meet in one tile, the later one on the right."""
    rows = df.where(F.col(key).isNotNull() & F.col(block).isNotNull())
    rest = [c for c in rows.columns if c not in (key, block)]
    w = Window.partitionBy(block).orderBy(key, *rest)
    cut = rows.withColumn("g", F.floor((F.row_number().over(w) - 1) / SIDE)).groupBy(block, "g").agg(F.sort_array(F.collect_list(F.struct(key, *rest))).alias("rows"))
    a, b = (cut.select(F.col(block).alias("b"), F.col("g").alias(f"g_{x}"), F.col("rows").alias(x)) for x in ("left", "right"))
    k = F.ceil(F.col("n") / SIDE)
    n = rows.groupBy(block).agg(F.count("*").alias("n")).agg(F.sum(k * (k + 1) / 2)).first()[0]
    return a.join(b, "b").where("g_left <= g_right").select("left", "right").repartition(int(min(max(n or 1, 1), MOST_TASKS)))


#: Tasks that tiles are dealt to; with more tiles a task has several.
MOST_TASKS = 20_000


def _compared(left: pa.StructArray, right: pa.StructArray, jaccard: float, containment: float, days: list[int]) -> Iterator[tuple[pa.Array, pa.Array, list[np.ndarray]]]:
    """Batches of a tile's pairs: both keys, and the levels + 1 of language, version, day and name."""
    (a, *fa), (b, *fb) = left.flatten(), right.flatten()
    language, version, day, name = (pa.concat_arrays(x).to_pandas() for x in zip(fa, fb))
    m, n, tables = len(a), len(b), []
    for f in (_Equal(language), _Edited(version), _Sets(name, jaccard, containment)):
        kinds, at = np.unique(f.at[:m], return_inverse=True)
        tables.append((np.stack([f.row(k)[f.at[m:]].astype(np.int8) for k in kinds]), at.ravel()))
    day, keys = day.to_numpy(np.float64), b.to_pylist()
    begins = np.array([bisect_right(keys, k) for k in a.to_pylist()])  # ascending, as are the keys
    i = 0
    while i < m and begins[i] < n:
        lo = begins[i]
        j = min(m, i + max(1, BATCH // (n - lo)))
        apart = np.abs(day[i:j, None] - day[None, m + lo :])
        dated = (apart == apart).astype(np.int8)  # 0 if either is missing
        for d in days:
            dated += apart <= d
        first, second, third = (t[at[i:j], lo:] for t, at in tables)
        levels = [x.ravel() for x in (first, second, dated, third)]
        if begins[j - 1] > lo:
            later = (np.arange(lo, n) >= begins[i:j, None]).ravel()
            levels = [x[later] for x in levels]
        yield a.take(pa.array(np.repeat(np.arange(i, j), n - begins[i:j]))), pa.concat_arrays([b.slice(k) for k in begins[i:j]]), levels
        i = j


def compared_pairs(df: DataFrame, key: str, block: str, language: str, version: str, day: str, words: str, jaccard: float, containment: float, days: list[int], weights: np.ndarray | None = None) -> DataFrame:
    """``left_id, right_id, language, version, dated, name``: all pairs of rows of a block, the lesser key on the left, and their levels.

    With ``weights`` of every pattern (``pattern_weights``) these, as ``match_weight``, stand in place of the levels. Values are
    compared once for each two distinct ones of a tile, so a pair costs a look-up; tiles are alike in size, however large a block is.
    """
    rows = df.select(
        key, block, F.col(language).alias("language"), F.col(version).alias("version"), F.unix_date(F.to_date(day)).alias("day"), F.when(F.col(words).isNotNull(), F.array_join(F.array_sort(words), " ")).alias("name")
    )
    flat = None if weights is None else weights.ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(*batch.columns):
                for a, b, levels in _compared(left.values, right.values, jaccard, containment, days):
                    if flat is None:
                        out = dict(zip(("language", "version", "dated", "name"), (np.subtract(x, 1, dtype=np.int32) for x in levels)))
                    else:
                        out = {"match_weight": flat[np.ravel_multi_index(levels, weights.shape)]}
                    yield pa.RecordBatch.from_pydict({"left_id": a, "right_id": b, **out})

    kind = rows.schema[key].dataType.simpleString()
    return _tiles(rows, key, block).mapInArrow(run, f"left_id {kind}, right_id {kind}, " + ("language int, version int, dated int, name int" if weights is None else "match_weight double"))


#: Patterns that may reach the driver: levels of the fields multiplied.
MOST_PATTERNS = 1_000_000


def fit_rates(histogram: DataFrame, fields: list[str], prior: float = 0.1, rounds: int = 50, floor: float = 1e-6) -> dict[str, dict[int, tuple[float, float]]]:
    """Rates (m, u) of every level of every field, by expectation maximisation over the pattern histogram.

    Missing values (-1) tell nothing. Fields are taken as independent given whether a pair matches. Rates stay within [floor, 1 - floor].
    """
    rows = histogram.limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError("too many agreement patterns")
    weight = [r["n"] for r in rows]
    seen = {f: sorted({r[f] for r in rows if r[f] >= 0}) for f in fields}
    # start: matches agree on high levels, others follow the overall shares
    rates = {}
    for f in fields:
        total = sum(w for r, w in zip(rows, weight) if r[f] >= 0) or 1
        up = sum(2.0**k for k in seen[f]) or 1.0
        rates[f] = {k: (2.0**k / up, sum(w for r, w in zip(rows, weight) if r[f] == k) / total) for k in seen[f]}
    share = prior
    for _ in range(rounds):
        match = []
        for r in rows:
            m, u = share, 1 - share
            for f in fields:
                if r[f] >= 0:
                    a, b = rates[f][r[f]]
                    m, u = m * a, u * b
            match.append(m / (m + u) if m + u else 0.0)
        all_pairs = sum(weight) or 1
        share = min(max(sum(p * w for p, w in zip(match, weight)) / all_pairs, floor), 1 - floor)
        for f in fields:
            hit = {k: [0.0, 0.0] for k in seen[f]}
            for r, p, w in zip(rows, match, weight):
                if r[f] >= 0:
                    hit[r[f]][0] += p * w
                    hit[r[f]][1] += (1 - p) * w
            a, b = (sum(x[i] for x in hit.values()) or 1.0 for i in (0, 1))
            rates[f] = {k: tuple(min(max(x / t, floor), 1 - floor) for x, t in zip(v, (a, b))) for k, v in hit.items()}
    return rates


def match_weight(model: dict[str, dict[int, tuple[float, float]]], prior: float) -> Column:
    """Weight in bits of a pair by a saved model: prior odds and log2(m / u) of every level; a level the model lacks tells nothing."""
    out = F.lit(math.log2(prior / (1 - prior)))
    for f, rates in model.items():
        part = F
        for k, (m, u) in rates.items():
            part = part.when(F.col(f) == k, math.log2(m / u))
        out = out + (part.otherwise(0.0) if rates else F.lit(0.0))
    return out


def pattern_weights(model: dict[str, dict[int, tuple[float, float]]], highest: list[int], prior: float) -> np.ndarray:
    """``match_weight`` of every pattern, rounded to 6 digits as Spark rounds. ``highest``: levels of the model's fields; an axis begins at level -1."""
    out = np.empty([k + 2 for k in highest])
    for levels in product(*[range(-1, k + 1) for k in highest]):
        w = math.log2(prior / (1 - prior))
        for k, rates in zip(levels, model.values()):
            w += math.log2(rates[k][0] / rates[k][1]) if k in rates else 0.0
        out[tuple(k + 1 for k in levels)] = Decimal(repr(w)).quantize(Decimal("1e-6"), ROUND_HALF_UP)
    return out


def accuracy_curve(df: DataFrame, label: Column, score: str) -> DataFrame:
    """``threshold, tp, fp, tn, fn, precision, recall, f1`` at every distinct score, pairs at or above it taken as matches."""
    cells = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.sum(label.cast("long")).alias("p"), F.count("*").alias("n"))
    total = cells.agg(F.sum("p").alias("ap"), F.sum("n").alias("an"))  # one row
    run = running_sums(cells, "threshold", ["p", "n"], descending=True).crossJoin(F.broadcast(total))
    tp, fp, fn = F.col("p_run"), F.col("n_run") - F.col("p_run"), F.col("ap") - F.col("p_run")
    pr, rc = tp / F.col("n_run"), F.when(F.col("ap") > 0, tp / F.col("ap")).otherwise(0.0)
    f1 = F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0)
    return run.select("threshold", tp.alias("tp"), fp.alias("fp"), (F.col("an") - F.col("ap") - fp).alias("tn"), fn.alias("fn"), F.round(pr, 9).alias("precision"), F.round(rc, 9).alias("recall"), F.round(f1, 9).alias("f1"))
