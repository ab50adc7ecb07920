"""Running sums over a whole table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stretches that the values are cut into.
PARTS = 64


def running_sums(df: DataFrame, value: str, sums: list[str], descending: bool = False, parts: int = PARTS) -> DataFrame:
    """``df`` with ``<name>_run``: for each of ``sums``, its total over all rows up to and with this one, in the order of ``value``.

    ``value`` must be distinct and numeric. Values are cut into stretches at approximate percentiles; totals of earlier
    stretches (a table of ``parts`` rows) are added to the running sums within each.
    """
    cuts = df.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 1000).alias("c")).first()["c"] or []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    placed = df.withColumn("_p", F.size(F.filter(bounds, lambda c: c < F.col(value))))
    order = F.desc if descending else F.asc
    within = Window.partitionBy("_p").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(order("_p")).rowsBetween(Window.unboundedPreceding, -1)  # parts rows
    offsets = placed.groupBy("_p").agg(*[F.sum(s).alias(f"_o_{s}") for s in sums]).select("_p", *[F.coalesce(F.sum(f"_o_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums])
    run = placed.join(F.broadcast(offsets), "_p")
    return run.select(*df.columns, *[(F.sum(s).over(within) + F.col(f"_b_{s}")).alias(f"{s}_run") for s in sums])
