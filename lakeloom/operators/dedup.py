"""Duplicates: hash tiers, collapse and its inverse, first-wins selection, shingle pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..staging import stage


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key, in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def renamed_ids(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Collisions of ``key`` become ``key-r2``, ``key-r3`` in order, in a column ``unique_id``."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", n).withColumn("unique_id", F.when(F.col("_n") > 1, F.concat(F.col(key), F.lit("-r"), F.col("_n"))).otherwise(F.col(key))).drop("_n")


def collapse(df: DataFrame, text: str, tier: str, order: Column, place: Column) -> DataFrame:
    """One row per duplicate key: ``first`` place, ``copies``, ``doc_count`` and the sorted ``places``. Null texts are left out."""
    keyed = df.where(F.col(text).isNotNull()).select(F.sha2(T.duplicate_key(F.col(text), tier), 256).alias("key"), order.alias("o"), place.alias("p"), "doc_id")
    return keyed.groupBy("key").agg(F.min_by("p", "o").alias("first"), F.count("*").alias("copies"), F.countDistinct("doc_id").alias("doc_count"), F.array_sort(F.collect_list("p")).alias("places"))


def collapse_stats(df: DataFrame, text: str, tier: str) -> DataFrame:
    """Chunks, unique ones, collapsed ones, groups, the largest, and groups within and across documents."""
    groups = df.where(F.col(text).isNotNull()).groupBy(F.sha2(T.duplicate_key(F.col(text), tier), 256).alias("key")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))
    many = F.col("n") > 1
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("*").alias("unique_chunks"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("collapsed"), F.count_if(many).alias("duplicate_groups"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.count_if(many & (F.col("docs") == 1)).alias("within"), F.count_if(many & (F.col("docs") > 1)).alias("across"),
    ).withColumn("tier", F.lit(tier))


def hash_findings(df: DataFrame, key: str, text: str) -> DataFrame:
    """Raw duplicates, and normalized ones among the first of every raw group: each copy with the least key of its group."""
    raw = df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.sha2(F.col(text), 256).alias("raw"), F.sha2(T.collapsed(F.col(text)), 256).alias("norm"))
    g = Window.partitionBy("raw")
    firsts = raw.withColumn("anchor", F.min("id").over(g)).withColumn("norm_anchor", F.when(F.col("id") == F.col("anchor"), F.min(F.when(F.col("id") == F.col("anchor"), F.col("id"))).over(Window.partitionBy("norm"))))
    one = firsts.where("id <> anchor").select("id", "anchor", F.lit("raw").alias("tier"))
    return one.union(firsts.where("id = anchor and id <> norm_anchor").select("id", F.col("norm_anchor").alias("anchor"), F.lit("normalized").alias("tier")))


def shingle_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """Pairs of distinct texts whose shingle sets have at least ``threshold`` Jaccard similarity, by class representative.

    Equal shingle sets are one class (its least key). Shingles are ordered rarest first and pairs are found by
    prefixes that must meet, so a frequent shingle makes no pairs; sizes bound the candidates.
    """
    sets = df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.array_sort(T.shingles(F.col(text), width)).alias("s")).where(F.size("s") > 0)
    named = sets.select("id", "s", F.xxhash64("s").alias("h"), F.xxhash64("s", F.lit(1)).alias("k"))
    reps = named.groupBy("h", "k").agg(F.min("id").alias("id"), F.first("s").alias("s")).select("id", "s", F.size("s").alias("n"))
    flat = reps.select("id", "n", F.explode("s").alias("x")).select("id", "n", F.xxhash64("x").alias("h"))
    df_of = flat.groupBy("h").agg(F.count("*").alias("df"))
    # the list of a text is as long as the text, so no group grows with the corpus
    ranked = flat.join(df_of, "h").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("o"))
    prefix = F.slice("o", 1, F.greatest(F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1, F.lit(1)))
    keyed = ranked.select("id", "n", F.explode(prefix).alias("x")).where("x.df > 1").select("id", "n", "x.h")
    a, b = keyed.toDF("a", "na", "h"), keyed.toDF("b", "nb", "h")
    cand = a.join(b, "h").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))).select("a", "b", "na", "nb").distinct()
    full = cand.join(reps.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(reps.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return full.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def expand(collapsed: DataFrame, places: str = "places") -> DataFrame:
    """The inverse of ``collapse``: one row per place, with the key it was collapsed under."""
    return collapsed.select("key", F.explode(places).alias("_p")).select("key", "_p.*")


def last_arrivals(df: DataFrame, key: list[str], at: list[str]) -> DataFrame:
    """The last row of every key, by ``at``. Rows of one key and time must be equal."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), F.struct(*at)).alias("_r")).select(*key, "_r.*")


def greedy_keep(ids: DataFrame, key: str, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The ids that stay if, in ascending order, each is dropped that is too near to one kept before.

    ``pairs`` are the near ones. Rounds decide every id whose earlier neighbours are decided: it is dropped if one of them is kept,
    and kept if all are dropped. Rounds end when all are decided; there are as many as the longest chain of neighbours.
    """
    near = stage(pairs.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x <> y").distinct(), "near")
    state = stage(near.select(F.col("y").alias("id")).distinct().withColumn("kept", F.lit(None).cast("boolean")), "state")  # others have no earlier neighbour
    while True:
        # an id that isn't in the state has no earlier neighbour, and is kept
        of = near.join(state.select(F.col("id").alias("x"), F.col("kept").alias("k"), F.lit(True).alias("known")), "x", "left").withColumn("k", F.when(F.col("known").isNull(), True).otherwise(F.col("k")))
        verdict = of.groupBy(F.col("y").alias("id")).agg(F.when(F.max("k"), False).when(F.count("k") == F.count("*"), True).alias("kept"))
        new = stage(verdict, "state")
        left, before = new.where("kept is null").count(), state.where("kept is null").count()
        state = new
        if not left or left == before:
            break
    return ids.select(key).distinct().join(state.where("not kept").select(F.col("id").alias(key)), key, "left_anti")
