"""Problem 3: one group identifier for all records linked directly or through others.

Two-dimensional grid: vertices are hashed into B blocks, the edge (u, v) lies in grid cell
(block of u, block of v), a local union-find runs on every cell, and the representatives a vertex got
in the cells of its row and column are exchanged. The links between differing representatives are the
edges of the next round; rounds end when all representatives agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage

#: Edges one grid cell should hold; the number of blocks follows from it.
EDGES_PER_CELL = 500_000
MIN_BLOCKS = 3


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over one cell: (member, representative) of every member that isn't one itself.

    The representative is the least identifier of the local component.
    """
    names, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    root = np.arange(len(names))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _cells(edges: DataFrame, blocks: int, edges_per_cell: int) -> DataFrame:
    """Stars of every grid cell; crowded cells are divided by edge hash, as any subset of edges may be united."""
    placed = edges.select(
        "u", "v",
        F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int").alias("_r"),
        F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("_c"),
    )
    # at most blocks * blocks rows, each of three numbers
    parts = placed.groupBy("_r", "_c").agg(F.ceil(F.count("*") / F.lit(edges_per_cell)).alias("_n"))
    salted = placed.join(F.broadcast(parts), ["_r", "_c"]).withColumn("_s", F.pmod(F.xxhash64("v", "u"), F.col("_n")))
    kind = edges.schema["u"].dataType.simpleString()

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        v, rep = local_stars(pdf["u"].to_numpy(), pdf["v"].to_numpy())
        return pd.DataFrame({"v": v, "rep": rep})

    return salted.select("u", "v", "_r", "_c", "_s").groupBy("_r", "_c", "_s").applyInPandas(unite, f"v {kind}, rep {kind}")


def _shortcut(parents: DataFrame) -> DataFrame:
    """Let every vertex point to the root of its tree, by pointer doubling. A parent is always the smaller one."""
    while True:
        up = parents.select(F.col("v").alias("p"), F.col("p").alias("_pp"))
        parents = stage(parents.join(up, "p", "left").select("v", F.coalesce("_pp", "p").alias("p"), F.col("_pp").isNotNull().alias("_moved")), "parents")
        moved = not parents.where("_moved").isEmpty()
        parents = parents.select("v", "p")
        if not moved:
            return parents


def connected_groups(edges: DataFrame, src: str, dst: str, edges_per_cell: int = EDGES_PER_CELL) -> DataFrame:
    """``id, group_id`` of every record that has at least one link; ``group_id`` is the least id of the group.

    Pairs with a null side and loops link nothing; direction and repeats don't matter. Ids may be of any
    type with an order (strings order by code point). An empty input gives an empty result. Other columns
    of ``edges``, whatever their names, are ignored.
    """
    a, b = F.col(f"`{src}`") if "." not in src else F.col(src), F.col(f"`{dst}`") if "." not in dst else F.col(dst)
    e = stage(edges.select(a.alias("_a"), b.alias("_b")).where("_a is not null and _b is not null and _a <> _b").select(F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v")).distinct(), "edges")
    labels = e.select("u").union(e.select("v")).distinct().select(F.col("u").alias("id"), F.col("u").alias("group_id"))
    count, least_blocks = e.count(), MIN_BLOCKS
    while count:
        blocks = max(least_blocks, math.ceil(math.sqrt(count / edges_per_cell)))
        least_blocks = 1  # what is left after a round may fit one cell, which ends the rounds
        stars = stage(_cells(e, blocks, edges_per_cell), "stars")
        # exchange: the least representative of a vertex over its row and column becomes its parent
        least = stars.groupBy("v").agg(F.min("rep").alias("p"))
        if blocks == 1 and count <= edges_per_cell:  # a single cell has one star per component
            labels = labels.join(least.toDF("group_id", "_p"), "group_id", "left").select("id", F.coalesce("_p", "group_id").alias("group_id"))
            break
        parents = _shortcut(least)
        left = stars.join(least, "v").where("rep <> p").select(F.col("p").alias("u"), F.col("rep").alias("v")).distinct()
        to_u, to_v = parents.toDF("u", "_pu"), parents.toDF("v", "_pv")
        linked = left.join(to_u, "u", "left").join(to_v, "v", "left").select(F.coalesce("_pu", "u").alias("x"), F.coalesce("_pv", "v").alias("y"))
        e = stage(linked.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        labels = labels.join(parents.toDF("group_id", "_p"), "group_id", "left").select("id", F.coalesce("_p", "group_id").alias("group_id"))
        count = e.count()
    return labels


def duplicate_files(findings: DataFrame) -> DataFrame:
    """``doc_id, group_id`` of files linked by a finding ``duplicate`` (letter case and outer spaces aside)."""
    is_duplicate = F.lower(F.trim("relation")) == "duplicate"
    return connected_groups(findings.where(is_duplicate).select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y")), "x", "y").withColumnRenamed("id", "doc_id")
