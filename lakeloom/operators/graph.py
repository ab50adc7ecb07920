"""Graphs in edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def undirected(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct edges in both directions, without loops and null ends, as ``src, dst``."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null and src <> dst")
    return e.union(e.select("dst", "src")).distinct()


def k_hop(both: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``node, depth``: nodes within ``depth`` steps of a seed, with the least number of steps.

    A step joins only the frontier, the nodes first reached in the step before.
    """
    reached = seeds.select(F.col("node"), F.lit(0).alias("depth")).distinct()
    frontier = reached
    for d in range(1, depth + 1):
        step = frontier.join(both, frontier["node"] == both["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = step.join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        reached = reached.union(frontier)
    return reached


def two_hop_counts(both: DataFrame) -> DataFrame:
    """``node, degree, paths``: paths of two steps over each middle node, from degrees alone."""
    d = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return d.withColumn("paths", (F.col("degree") * (F.col("degree") - 1) / 2).cast("long"))


def blocking_counts(df: DataFrame, rules: dict[str, list]) -> DataFrame:
    """``rule, comparisons``: pairs that each equality rule would compare, from group sizes."""
    out = None
    for name, keys in rules.items():
        named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
        known = " and ".join(f"_k{i} is not null" for i in range(len(keys)))
        sizes = df.select(*named).where(known).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.count("*").alias("n"))
        one = sizes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("comparisons")).select(F.lit(name).alias("rule"), "comparisons")
        out = one if out is None else out.union(one)
    return out


def link_scores(questions: DataFrame, key: str, text: str, nodes: DataFrame, node: str, name: str, least: int = 3, half: float = 0.5) -> DataFrame:
    """``key, node, score``: words that a question and a node's name share; words that share a stem only count half.

    Both sides meet by stems, so that no question is compared with a node it has nothing in common with.
    """
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) >= least))
    stems = lambda a: F.array_distinct(F.transform(a, lambda w: F.substring(w, 1, 4)))
    q = questions.select(key, words(F.col(text)).alias("w"))
    n = nodes.select(F.col(node).alias("node"), words(F.col(name)).alias("w"))
    exact = q.select(key, F.explode("w").alias("t")).join(n.select("node", F.explode("w").alias("t")), "t").groupBy(key, "node").agg(F.count("*").alias("e"))
    loose = q.select(key, F.explode(stems(F.col("w"))).alias("t")).join(n.select("node", F.explode(stems(F.col("w"))).alias("t")), "t").groupBy(key, "node").agg(F.count("*").alias("s"))
    have = F.coalesce("e", F.lit(0))
    return loose.join(exact, [key, "node"], "left").select(key, "node", (have + half * F.greatest(F.col("s") - have, F.lit(0))).alias("score"))


def remapped(edges: DataFrame, src: str, dst: str, names: DataFrame, old: str, new: str) -> DataFrame:
    """Distinct edges with both ends renamed by a table; an edge with an unknown end is dropped, a loop stays."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    a, b = names.select(F.col(old).alias(src), F.col(new).alias("_a")), names.select(F.col(old).alias(dst), F.col(new).alias("_b"))
    return edges.join(a, src).join(b, dst).select(F.col("_a").alias(src), F.col("_b").alias(dst), *rest).distinct()
