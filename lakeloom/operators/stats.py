"""Agreement, percentiles, paired comparison, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cohen_kappa(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """``n, agreement, kappa`` of two raters over rows both rated; 1 where both always give one label, null without rows."""
    cells = df.select(a.alias("a"), b.alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    by_a, by_b = (cells.groupBy(F.col(x).alias("l")).agg(F.sum("n").alias(f"n{x}")) for x in "ab")
    chance = by_a.join(by_b, "l").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("c"))
    po, pe = F.col("same") / F.col("t"), F.col("c") / (F.col("t") * F.col("t"))
    return total.join(F.broadcast(chance)).select(F.coalesce("t", F.lit(0)).alias("n"), F.round(po, 9).alias("agreement"), F.round(F.when(pe == 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe)), 9).alias("kappa"))


def percentiles(df: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """The three percentile definitions in use: nearest rank, truncated index, linear interpolation."""
    w = Window.partitionBy(group).orderBy(value)
    ranked = df.where(F.col(value).isNotNull()).select(group, value).withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(group)))
    near, cut = F.bround(F.lit(q) * (F.col("n") - 1)).cast("int"), F.floor(F.lit(q) * F.col("n")).cast("int")
    at = lambda index: F.max(F.when(F.col("i") == F.least(index, F.col("n") - 1), F.col(value)))
    return ranked.groupBy(group).agg(F.count("*").alias("n"), at(near).alias("nearest"), at(cut).alias("truncated"), F.percentile(value, q).alias("linear"))


def paired(df: DataFrame, group: str, candidate: Column, baseline: Column) -> DataFrame:
    """Wins, losses, ties and mean difference per group, over rows where both are known."""
    d = df.select(group, (candidate - baseline).alias("d")).where("d is not null")
    return d.groupBy(group).agg(F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"), F.round(F.avg("d"), 6).alias("mean_delta"))
