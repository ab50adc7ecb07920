"""Connected components and communities of edge tables, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .graph import undirected


def components(pairs: DataFrame, src: str, dst: str) -> DataFrame:
    """``node, cluster_id`` of every node of a pair; the id is the least node of the component.

    Stars alternate: every node links its larger neighbours to the least of its neighbourhood, then its smaller ones. The
    number of rounds grows with the logarithm of the longest chain. A node's neighbourhood is only ever aggregated, never held.
    """
    e = stage(pairs.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).distinct(), "edges")
    last = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m", "u")
        e = stage(small.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    return e.select(F.col("u").alias("node"), F.col("v").alias("cluster_id")).union(e.select("v", "v").distinct())


def clusters(ids: DataFrame, key: str, pairs: DataFrame, src: str, dst: str) -> DataFrame:
    """``key, cluster_id`` of every id; one that no pair reaches is a cluster of its own."""
    found = components(pairs, src, dst).withColumnRenamed("node", key)
    return ids.select(key).distinct().join(found, key, "left").select(key, F.coalesce("cluster_id", key).alias("cluster_id"))


def propagate_labels(edges: DataFrame, src: str, dst: str, rounds: int) -> DataFrame:
    """``node, label`` after some rounds in which every node takes the most frequent label of its neighbours, the smaller of equals.

    All nodes move at once, from labels of their own.
    """
    both = stage(undirected(edges, src, dst), "both")
    labels = both.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct()
    for _ in range(rounds):
        votes = both.join(labels, both["dst"] == labels["node"]).groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.max("n").alias("most"))
        labels = stage(votes.join(best, "src").where("n = most").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("label")), "labels")
    return labels


#: Nodes up to which labels may be propagated one after the other, on the driver.
MOST_NODES = 200_000


def communities_in_order(edges: DataFrame, src: str, dst: str, passes: int = 20) -> DataFrame:
    """``node, community``: labels propagated node after node in ascending order, until nothing changes.

    The result depends on that order, so it can't be distributed; a graph of more than ``MOST_NODES`` nodes is refused.
    """
    both = undirected(edges, src, dst)
    spark = edges.sparkSession
    if both.select("src").distinct().count() > MOST_NODES:
        raise ValueError("too many nodes: use propagate_labels")
    near: dict = {}
    for r in both.toLocalIterator():
        near.setdefault(r["src"], []).append(r["dst"])
    label = {n: n for n in near}
    for _ in range(passes):
        moved = False
        for node in sorted(near):
            votes: dict = {}
            for x in near[node]:
                votes[label[x]] = votes.get(label[x], 0) + 1
            best = min(votes, key=lambda k: (-votes[k], k))
            moved, label[node] = moved or best != label[node], best
        if not moved:
            break
    number: dict = {}
    rows = [(n, number.setdefault(label[n], len(number))) for n in sorted(near)]
    return spark.createDataFrame(rows, f"node {both.schema['src'].dataType.simpleString()}, community int")


def in_date_order(members: DataFrame, cluster: str, key: str, date: str) -> DataFrame:
    """``cluster, n, oldest, newest``: size of groups of at least two, and their first and last member by date, those without one first."""
    order = F.struct(F.coalesce(F.col(date), F.lit("")), F.col(key))
    g = members.groupBy(cluster).agg(F.count("*").alias("n"), F.min_by(key, order).alias("oldest"), F.max_by(key, order).alias("newest"), F.max(date).alias("_d"))
    return g.where("n > 1").select(cluster, "n", "oldest", F.when(F.col("_d").isNotNull(), F.col("newest")).alias("newest"))


def shared_units(members: DataFrame, unit: str, row: str) -> DataFrame:
    """``unit, n``: units that more than one row has; of units with the same rows only the least. Sets are compared by two sums of hashes."""
    h = lambda seed: F.sum(F.xxhash64(row, F.lit(seed)).cast("decimal(38,0)"))
    sets = members.select(unit, row).distinct().groupBy(unit).agg(F.count("*").alias("n"), h(1).alias("h"), h(2).alias("k")).where("n > 1")
    return sets.groupBy("n", "h", "k").agg(F.min(unit).alias(unit)).select(unit, "n")


def first_of_ranked(df: DataFrame, group: str, parent: str, rank: str) -> DataFrame:
    """``group, parent, rank``: parents of ranked children in the order of their best child, ranked anew from 1."""
    best = df.groupBy(group, parent).agg(F.min(rank).alias("_b"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("_b"))).drop("_b")
