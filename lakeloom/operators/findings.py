"""What to do about findings: supersession by date, a safe action by policy, reviews by policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("prefer_newer", "report_only")


def superseded(findings: DataFrame, relation: str, a: str, b: str, newer: Column) -> DataFrame:
    """A contradiction of which one side is newer becomes ``superseded_by``, with the older side as ``a``; all else stays."""
    hit = (F.col(relation) == "contradicts") & newer.isNotNull()
    flip = hit & (newer == "a")
    rest = [c for c in findings.columns if c not in (relation, a, b)]
    return findings.select(*rest, F.when(hit, "superseded_by").otherwise(F.col(relation)).alias(relation), F.when(flip, F.col(b)).otherwise(F.col(a)).alias(a), F.when(flip, F.col(a)).otherwise(F.col(b)).alias(b))


def resolution(relation: Column, tier: Column, newer: Column, a: Column, b: Column, policy: str) -> Column:
    """Struct ``action, review, target``: the side to drop or suppress. A duplicate loses its older side, else the later name."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    older = F.when(newer == "a", "b").when(newer == "b", "a")
    to = lambda action, review, target: F.struct(F.lit(action).alias("action"), F.lit(review).alias("review"), target.cast("string").alias("target"))
    none = F.lit(None)
    copy = F.coalesce(older, F.when(a > b, "a").otherwise("b"))
    newest = to("prefer_newer", False, older) if policy == "prefer_newer" else to("escalate", True, older)
    return (
        F.when((relation == "duplicate") & F.coalesce(tier == "semantic", F.lit(False)), to("escalate", True, none))
        .when(relation == "duplicate", to("drop_duplicate", False, copy))
        .when((relation == "superseded_by") & older.isNotNull(), newest)
        .when(relation.isin("superseded_by", "contradicts"), to("escalate", True, none))
        .when(relation.isin("subsumes", "subsumed_by", "complementary"), to("retain", False, none))
        .otherwise(to("escalate", True, none))
    )
