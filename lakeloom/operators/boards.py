"""Boards: ranking, halving, Pareto fronts, picks and margins over few candidates (models, sources, lanes)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pareto(df: DataFrame, objectives: dict[str, bool]) -> DataFrame:
    """The rows that no other dominates; an objective is to be maximal (True) or minimal. A null is worse than any value.

    Equal rows don't dominate each other. Rows are first reduced to the distinct values of the objectives.
    """
    names = list(objectives)
    distinct = df.select(*names).distinct()
    keyed = [F.coalesce(F.col(n) * (1 if up else -1), F.lit(float("-inf"))) for n, up in objectives.items()]
    a = distinct.select(*names, *[k.alias(f"_a{i}") for i, k in enumerate(keyed)])
    b = distinct.select(*[k.alias(f"_b{i}") for i, k in enumerate(keyed)])
    pairs = [(F.col(f"_b{i}"), F.col(f"_a{i}")) for i in range(len(names))]
    dominated = reduce(lambda x, y: x & y, [p >= q for p, q in pairs]) & reduce(lambda x, y: x | y, [p > q for p, q in pairs])
    front = a.join(b, dominated, "left_anti").select(*[F.col(n).alias(f"_f{i}") for i, n in enumerate(names)])
    return df.join(front, reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"_f{i}")) for i, n in enumerate(names)]), "left_semi")


def ranked(df: DataFrame, feasible: Column, order: list[Column]) -> DataFrame:
    """``rank`` from 1 among the feasible rows in a total order, null for the others."""
    n = F.row_number().over(Window.partitionBy(feasible).orderBy(*order))
    return df.withColumn("rank", F.when(feasible, n))


def survivors(df: DataFrame, order: list[Column], eta: int, least: int) -> DataFrame:
    """``kept``: the first max(least, n // eta) rows of a board."""
    n = df.select(F.count("*").over(Window.partitionBy()).alias("_n"), "*").withColumn("_r", F.row_number().over(Window.orderBy(*order)))
    return n.withColumn("kept", F.col("_r") <= F.greatest(F.lit(least), F.floor(F.col("_n") / eta))).drop("_n", "_r")


def goal_picks(df: DataFrame, name: str, quality: str, rate: Column, cost: str, floor: float) -> DataFrame:
    """``goal, <name>``: the best by quality, by rate, and the cheapest with at least ``floor`` of the best quality; ties by name."""
    best = df.agg(F.max(quality).alias("_q"))  # one row
    rows = df.withColumn("_r", rate).join(F.broadcast(best)).withColumn("_ok", F.col(quality) >= floor * F.col("_q"))
    goals = [("quality", [F.desc(quality)], F.lit(True)), ("rate", [F.desc("_r")], F.lit(True)), ("cost", [F.asc(cost)], F.col("_ok"))]
    return reduce(DataFrame.union, [rows.where(ok).orderBy(*order, name).limit(1).select(F.lit(g).alias("goal"), name) for g, order, ok in goals])


def margin(df: DataFrame, name: str, value: str, floor: float) -> DataFrame:
    """``first, second, gap, separated``: the two best and whether their gap exceeds a floor; empty with less than two rows."""
    top = df.orderBy(F.desc(value), name).limit(2).agg(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(name).alias("n")))).alias("t"))
    gap = F.get("t", F.lit(1))["v"] - F.get("t", F.lit(0))["v"]
    return top.where(F.size("t") == 2).select(F.get("t", F.lit(0))["n"].alias("first"), F.get("t", F.lit(1))["n"].alias("second"), F.round(gap, 6).alias("gap"), (gap > floor).alias("separated"))


def rank_changes(df: DataFrame, name: str, a: Column, b: Column) -> DataFrame:
    """``name, rank_a, rank_b`` of those that two policies rank differently."""
    r = df.select(name, *[F.rank().over(Window.orderBy(c.desc())).cast("long").alias(n) for n, c in (("rank_a", a), ("rank_b", b))])
    return r.where("rank_a <> rank_b")


def precision_curve(df: DataFrame, order: list[Column], flag: str, budgets: list[int]) -> DataFrame:
    """``budget, n, precision`` of the first rows in a total order, at each budget."""
    top = df.orderBy(*order).limit(max(budgets)).withColumn("_r", F.row_number().over(Window.orderBy(*order)))
    at = top.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets]))).where("_r <= budget")
    return at.groupBy("budget").agg(F.count("*").alias("n"), F.round(F.avg(F.col(flag).cast("double")), 9).alias("precision"))
