"""Sampling by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evenly_spread(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """``n`` rows at positions floor(i * rows / n) of the sorted table.

    The rows are sorted by ranges; a row's position is its place in its partition plus the sizes of the
    partitions before, of which there are few, so no task sees all rows.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted((r["_p"], r["c"]) for r in parts.groupBy("_p").agg(F.count("*").alias("c")).collect())  # one row a partition
    before, total = {}, 0
    for p, c in sizes:
        before[p], total = total, total + c
    if not total:
        return df
    spark = df.sparkSession
    offsets = F.broadcast(spark.createDataFrame(list(before.items()), "_p int, _o long"))
    wanted = F.broadcast(spark.createDataFrame(sorted({(i * total // n,) for i in range(n)}), "_at long"))
    placed = parts.join(offsets, "_p").withColumn("_at", F.col("_o") + F.col("_i"))
    return placed.join(wanted, "_at", "left_semi").select(*df.columns)


def quotas(strata: DataFrame, name: str, size: str, n: int) -> DataFrame:
    """``name, size, quota``: a sample of ``n`` shared out in proportion, by largest remainder, none above its stratum. Strata are few."""
    total = F.sum(size).over(Window.partitionBy())
    x = strata.select(name, size, (F.lit(n) * F.col(size) / total).alias("_x")).withColumn("_f", F.floor("_x"))
    left = F.lit(n) - F.sum("_f").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("_x") - F.col("_f")), name))
    return x.withColumn("_l", left).withColumn("_r", rank).select(name, size, F.least(F.col(size), F.col("_f") + (F.col("_r") <= F.col("_l")).cast("long")).alias("quota"))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """Rows drawn from every stratum up to its quota, in the order of a hash of seed and key."""
    share = quotas(df.groupBy(stratum).agg(F.count("*").alias("_size")), stratum, "_size", n)
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), key)
    return df.withColumn("_r", F.row_number().over(order)).join(F.broadcast(share.select(stratum, "quota")), stratum).where("_r <= quota").drop("_r", "quota")
