"""Problem 9: mix sources to target shares of tokens.

Entropy balancing: the rates at which documents are used stay as close as possible, in relative entropy, to
one common rate, under the constraint that the tokens of each source add up to its target. The solution is an
exponentially tilted rate, common rate * exp(multiplier of the source * document size), capped at the
repeats allowed. The convex dual is solved by Newton steps, safeguarded by bisection; a step needs two sums
per source, which Spark computes over the distribution of document sizes. Rates are then rounded to whole
copies so that each source meets its target to within about one document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .encoding import BYTE_BPE, read_ranks

#: fixed value: how byte_bpe_50k cuts a text into words
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STEPS, PRECISION = 60, 1e-9
#: Parts into which rounding divides the documents of a source, level by level.
PARTS, LEVELS = 512, 3
#: Targets (mix and source) there may be; they are held on the driver and broadcast, 100 bytes each.
MOST_TARGETS = 200_000


def token_counts(df: DataFrame, key: str, source: str, text: str, path: str = BYTE_BPE) -> DataFrame:
    """``key, source, tokens`` of every row; null and empty texts have 0 tokens. The ranks are shipped (1 MB)."""
    packed = df.sparkSession.sparkContext.broadcast([(base64.b64encode(t), r) for t, r in read_ranks(path).items()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken  # noqa: PLC0415  (only executors need it)

        coder = tiktoken.Encoding("mix", pat_str=_PATTERN, mergeable_ranks={base64.b64decode(t): r for t, r in packed.value}, special_tokens={})
        for b in batches:
            sizes = [len(coder.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], names=["k", "source", "tokens"])

    base = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("t"))
    kind = base.schema["k"].dataType.simpleString()
    return base.mapInArrow(count, f"k {kind}, source string, tokens bigint")


def _rates(goals: dict[tuple[str, str], dict], sums) -> None:
    """Solve the dual: sets ``slope`` of every goal; ``sums`` gives tokens and their derivative at given slopes."""
    todo = {}
    for at, g in goals.items():
        g["slope"] = np.inf if g["target"] >= g["have"] * g["repeats"] else -np.inf if g["target"] <= 0 else 0.0
        if np.isfinite(g["slope"]):
            todo[at] = (-np.inf, np.inf)
    for _ in range(STEPS):
        if not todo:
            return
        now = sums({at: goals[at]["slope"] for at in todo})
        for at in list(todo):
            g, (lo, hi) = goals[at], todo[at]
            value, slope = now[at]
            miss = g["target"] - value
            if abs(miss) <= PRECISION * g["target"]:
                del todo[at]
                continue
            lo, hi = (g["slope"], hi) if miss > 0 else (lo, g["slope"])
            step = g["slope"] + (miss / slope if slope > 0 else np.sign(miss))
            if not lo < step < hi:  # outside of what is known: bisect, or widen
                step = (lo + hi) / 2 if np.isfinite(lo) and np.isfinite(hi) else g["slope"] + np.sign(miss) * max(1.0, abs(g["slope"]))
            g["slope"] = float(step)
            if np.isfinite(lo) and np.isfinite(hi) and hi - lo < 1e-12 * max(1.0, abs(lo)):
                del todo[at]
            else:
                todo[at] = (lo, hi)


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", path: str = BYTE_BPE) -> tuple[DataFrame, DataFrame]:
    """``(mix_id, key, source, copies)`` of the documents used, and per mix and source the actual shares.

    ``targets`` has mix_id, source, target_share, max_repeats, total_ratio. The size wanted of a mix is
    total_ratio times the tokens of all documents; a source should hold target_share of it. A source that
    lacks text is used in full, max_repeats times, its ``met`` is false and the mix stays smaller by what lacks.
    Documents of other sources, of a null source, with a null key or without tokens are not used. Equal rows
    are documents of their own. Null targets count as 0. Without targets or documents the results are empty.
    """
    spark = documents.sparkSession
    if targets.limit(MOST_TARGETS + 1).count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets: mix them in parts, as the sources of a mix don't depend on one another")
    sized = stage(token_counts(documents, key, source, text, path), "sizes")
    all_tokens = sized.agg(F.sum("tokens")).first()[0] or 0
    used = sized.where("k is not null and source is not null and tokens > 0")
    have = {r["source"]: (r["n"], r["m"]) for r in used.groupBy("source").agg(F.sum("tokens").alias("n"), F.avg("tokens").alias("m")).join(F.broadcast(targets.select("source").distinct()), "source").collect()}
    goals: dict[tuple[str, str], dict] = {}
    for r in targets.where("mix_id is not null and source is not null").collect():  # one row per mix and source, however large the corpus
        n, mean = have.get(r["source"], (0, 1.0))
        goals[r["mix_id"], r["source"]] = {"share": r["target_share"] or 0.0, "target": (r["target_share"] or 0.0) * (r["total_ratio"] or 0.0) * all_tokens, "repeats": r["max_repeats"] or 0, "have": n, "mean": mean}
    for m in {m for m, _ in goals}:
        mine = [g for (x, _), g in goals.items() if x == m]
        common = sum(g["target"] for g in mine) / max(sum(g["have"] for g in mine), 1)
        for g in mine:  # the common rate every rate starts from
            g["rate"] = float(min(max(common, 1e-6), max(g["repeats"], 1e-6)))
    histogram = stage(used.groupBy("source", "tokens").agg(F.count("*").alias("n")), "histogram")

    def params(slopes: dict[tuple[str, str], float]) -> DataFrame:
        rows = [(m, s, float(v), goals[m, s]["rate"], float(goals[m, s]["repeats"]), goals[m, s]["mean"]) for (m, s), v in slopes.items()]
        return F.broadcast(spark.createDataFrame(rows, "mix_id string, source string, slope double, rate double, cap double, mean double"))

    # exponent bounded, so that nothing overflows; infinite slopes stand for the cap and for nothing
    tilt = F.when(F.col("slope") == float("inf"), F.col("cap")).when(F.col("slope") == float("-inf"), 0.0).otherwise(F.least("cap", F.col("rate") * F.exp(F.least(F.lit(60.0), F.col("slope") * F.col("tokens") / F.col("mean")))))

    def sums(slopes: dict[tuple[str, str], float]) -> dict[tuple[str, str], tuple[float, float]]:
        r = histogram.join(params(slopes), "source").withColumn("r", tilt)
        free = F.when(F.col("r") < F.col("cap"), F.col("r") * F.col("tokens") ** 2 * F.col("n") / F.col("mean")).otherwise(0.0)
        return {(x["mix_id"], x["source"]): (x["v"], x["d"]) for x in r.groupBy("mix_id", "source").agg(F.sum(F.col("r") * F.col("tokens") * F.col("n")).alias("v"), F.sum(free).alias("d")).collect()}

    live = {at: g for at, g in goals.items() if g["have"]}
    _rates(live, sums)
    if not live:
        chosen = spark.createDataFrame([], f"mix_id string, {key} {used.schema['k'].dataType.simpleString()}, source string, copies int, tokens bigint")
    else:
        rated = used.join(params({at: g["slope"] for at, g in live.items()}), "source").withColumn("r", tilt)
        chosen = _rounded(stage(rated.select("mix_id", "source", "k", "tokens", "r"), "rates"), live).withColumnRenamed("k", key)
    chosen = stage(chosen, "chosen")
    actual = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("actual_tokens"), F.count("*").alias("n_documents"), F.max("copies").alias("most_copies"))
    rows = [(m, s, g["share"], int(round(g["target"])), int(g["have"]), int(g["repeats"])) for (m, s), g in goals.items()]
    wanted = spark.createDataFrame(rows, "mix_id string, source string, target_share double, target_tokens bigint, available_tokens bigint, max_repeats int")
    shares = wanted.join(actual, ["mix_id", "source"], "left").na.fill(0, ["actual_tokens", "n_documents", "most_copies"])
    total = F.sum("actual_tokens").over(Window.partitionBy("mix_id"))
    shares = shares.withColumn("actual_share", F.when(total > 0, F.col("actual_tokens") / total).otherwise(0.0)).withColumn("met", F.col("target_tokens") <= F.col("available_tokens") * F.col("max_repeats"))
    return chosen.select("mix_id", key, "source", "copies"), shares


def _rounded(rated: DataFrame, goals: dict[tuple[str, str], dict]) -> DataFrame:
    """Whole copies: the integer part of a rate, and one more for the documents first in an order.

    The order is by a hash of the key over the fractional part, so that a document gets its extra copy with that
    probability. Where in the order the target is reached is found level by level, in the sums of PARTS parts
    of the stretch the level before has left, so no source is ever sorted in one task.
    """
    u = (F.pmod(F.xxhash64("mix_id", "k"), F.lit(1 << 40)) + 1) / float(1 << 40)
    part = rated.withColumn("floor", F.floor("r").cast("int")).withColumn("frac", F.col("r") - F.floor("r"))
    # z in (0, 1]: monotone in hash / fraction; 2 where there is no fraction
    part = part.withColumn("z", F.when(F.col("frac") > 1e-9, 1 - 1 / (1 + u / F.col("frac"))).otherwise(2.0))
    base = {(x["mix_id"], x["source"]): x["n"] for x in part.groupBy("mix_id", "source").agg(F.sum(F.col("floor") * F.col("tokens")).alias("n")).collect()}
    # stretch, tokens still wanted in it, and tokens it holds
    bounds = {at: [0.0, 1.0, g["target"] - base.get(at, 0), 0] for at, g in goals.items()}
    spark = rated.sparkSession
    for _ in range(LEVELS):
        rows = [(m, s, lo, hi) for (m, s), (lo, hi, *_) in bounds.items()]
        now = F.broadcast(spark.createDataFrame(rows, "mix_id string, source string, lo double, hi double"))
        inside = part.join(now, ["mix_id", "source"]).where("z > lo and z <= hi")
        at = F.least(F.floor((F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1))
        sums: dict[tuple[str, str], dict[int, int]] = {}
        for x in inside.groupBy("mix_id", "source", at.cast("int").alias("p")).agg(F.sum("tokens").alias("n")).collect():  # PARTS rows a source at most
            sums.setdefault((x["mix_id"], x["source"]), {})[x["p"]] = x["n"]
        for where, (lo, hi, want, _) in bounds.items():
            left, width = want, (hi - lo) / PARTS
            mine = sums.get(where, {})
            for p in range(PARTS):
                if mine.get(p, 0) > left:
                    break
                left -= mine.get(p, 0)
            else:
                bounds[where] = [hi, hi + 1e-12, left, 0]
                continue
            bounds[where] = [lo + p * width, lo + (p + 1) * width, left, mine[p]]
    # what the last stretch holds is taken if that is nearer to the target than leaving it
    rest = {where: hi if want > held / 2 > 0 else lo for where, (lo, hi, want, held) in bounds.items()}
    rows = [(m, s, v) for (m, s), v in rest.items()]
    cut = F.broadcast(spark.createDataFrame(rows, "mix_id string, source string, cut double"))
    out = part.join(cut, ["mix_id", "source"]).withColumn("copies", F.col("floor") + F.when(F.col("z") <= F.col("cut"), 1).otherwise(0))
    return out.where("copies > 0").select("mix_id", "k", "source", "copies", "tokens")
