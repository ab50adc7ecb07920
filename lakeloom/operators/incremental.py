"""Maintenance of an index as its corpus changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(indexed: DataFrame, current: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """``key, change``: added, removed, modified or unchanged."""
    a, b = indexed.select(key, F.col(fingerprint).alias("_a")), current.select(key, F.col(fingerprint).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("modified")
    return a.join(b, key, "full").select(key, kind.alias("change"))


def remaining(todo: DataFrame, journal: DataFrame, key: str) -> DataFrame:
    """Rows that a journal of completed keys doesn't have, for a run that goes on after a stop."""
    return todo.join(journal.select(key).distinct(), key, "left_anti")
