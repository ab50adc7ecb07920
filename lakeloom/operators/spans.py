"""Half-open spans in documents: overlap, union, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_length(df: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """Length of the union of spans per group, and the number of islands. Empty and null spans are left out."""
    w = Window.partitionBy(*group).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    good = df.where(F.col(end) > F.col(start)).select(*group, start, end).withColumn("_b", before)
    fresh = F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce("_b", F.col(start))), F.lit(0))
    island = F.when(F.col("_b").isNull() | (F.col(start) > F.col("_b")), 1).otherwise(0)
    return good.groupBy(*group).agg(F.sum(fresh).alias("covered"), F.sum(island).alias("islands"))


def overlap_count(spans: DataFrame, others: DataFrame) -> DataFrame:
    """``span_id, n_overlaps``: spans of ``others`` that overlap each span of the same document, without making the pairs.

    Both have doc_id, char_start, char_end, and spans a span_id. Overlaps are the others that start before the
    span's end less those that end by its start; both are running counts over the sorted edges of a document.
    """
    good = others.where("char_end > char_start")
    edges = (
        good.select("doc_id", F.col("char_start").alias("at"), F.lit(1).alias("s"), F.lit(0).alias("e"), F.lit(None).cast("long").alias("span_id"), F.lit(None).cast("int").alias("sign"))
        .union(good.select("doc_id", "char_end", F.lit(0), F.lit(1), F.lit(None).cast("long"), F.lit(None).cast("int")))
        .union(spans.select("doc_id", "char_end", F.lit(0), F.lit(0), "span_id", F.lit(1)))
        .union(spans.select("doc_id", "char_start", F.lit(0), F.lit(0), "span_id", F.lit(-1)))
    )
    upto = Window.partitionBy("doc_id").orderBy("at")
    before = upto.rangeBetween(Window.unboundedPreceding, -1)
    counted = edges.withColumn("started", F.coalesce(F.sum("s").over(before), F.lit(0))).withColumn("ended", F.sum("e").over(upto.rangeBetween(Window.unboundedPreceding, 0)))
    part = F.when(F.col("sign") == 1, F.col("started")).otherwise(-F.col("ended"))
    return counted.where("sign is not null").groupBy("span_id").agg(F.sum(part).alias("n_overlaps"))


def coverage_at_k(gold: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    """``item, n_spans, covered, coverage, all_covered, char_coverage, intact``: how the first ``k`` places retrieved for an item hold its spans.

    ``gold`` has item, span_id, doc_id, char_start, char_end; ``retrieved`` has item, rank, doc_id, char_start, char_end.
    """
    g = gold.where("char_end > char_start").select("item", "span_id", "doc_id", F.col("char_start").alias("gs"), F.col("char_end").alias("ge")).distinct()
    r = retrieved.where((F.col("rank") <= k) & (F.col("char_end") > F.col("char_start"))).select("item", "doc_id", "char_start", "char_end")
    hits = g.join(r, ["item", "doc_id"]).where("char_start < ge and gs < char_end")
    hits = hits.select("item", "span_id", F.greatest("char_start", "gs").alias("s"), F.least("char_end", "ge").alias("e"), ((F.col("char_start") <= F.col("gs")) & (F.col("char_end") >= F.col("ge"))).alias("whole"))
    length = union_length(hits.select("item", "span_id", "s", "e").distinct(), ["item", "span_id"], "s", "e").select("item", "span_id", F.col("covered").alias("chars"))
    whole = hits.groupBy("item", "span_id").agg(F.max("whole").alias("whole"))
    per = g.join(length, ["item", "span_id"], "left").join(whole, ["item", "span_id"], "left")
    hit = F.col("chars").isNotNull()
    return per.groupBy("item").agg(
        F.count("*").alias("n_spans"), F.count_if(hit).alias("covered"), F.round(F.avg(hit.cast("double")), 9).alias("coverage"), F.min(hit).alias("all_covered"),
        F.round(F.avg(F.coalesce(F.col("chars"), F.lit(0)) / (F.col("ge") - F.col("gs"))), 9).alias("char_coverage"), F.round(F.avg(F.coalesce("whole", F.lit(False)).cast("double")), 9).alias("intact"),
    )


def regions(inner: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """``key, start, end``: a text parted into its inner spans and the gaps around them, in order and without overlap.

    ``inner`` has key, start, end; ``whole`` has key, length. What an inner span shares with an earlier one is the earlier one's.
    """
    w = Window.partitionBy(key).orderBy("start", "end")
    cut = inner.join(whole, key).select(key, F.greatest("start", F.lit(0)).alias("start"), F.least("end", "length").alias("end"), "length")
    upto = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cut.withColumn("_c", upto).withColumn("_s", F.greatest("start", "_c"))
    own = placed.where("end > _s").select(key, F.col("_s").alias("start"), "end")
    gaps = placed.where("end > _s and _s > _c").select(key, F.col("_c").alias("start"), F.col("_s").alias("end"))
    last = whole.join(placed.groupBy(key).agg(F.max("end").alias("_m")), key, "left").select(key, F.coalesce("_m", F.lit(0)).alias("start"), F.col("length").alias("end")).where("end > start")
    return own.union(gaps).union(last)


def overlap_ratio(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """What two spans share, of the shorter one; 0 for an empty span."""
    shorter = F.least(end - start, other_end - other_start)
    return F.when(shorter > 0, F.greatest(F.least(end, other_end) - F.greatest(start, other_start), F.lit(0)) / shorter).otherwise(0.0)


#: Length of the grid cells by which overlapping spans meet.
CELL = 512


def pooled(tokens: DataFrame, wanted: DataFrame, group: list[str], key: str, vector: str) -> DataFrame:
    """``group, key, dimension (from 1), value``: mean vector of the tokens that a span overlaps, of length one.

    Both have the columns of ``group``, start and end. They meet by grid cells, so that no span is compared with all tokens of its group.
    """
    cells = lambda s, e: F.explode(F.sequence(F.floor(s / CELL), F.floor((e - 1) / CELL)))
    t = tokens.where("end > start").select(*group, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col(vector).alias("_v"), cells(F.col("start"), F.col("end")).alias("_c"))
    w = wanted.where("end > start").select(*group, key, "start", "end", cells(F.col("start"), F.col("end")).alias("_c"))
    # a pair that shares several cells meets in the first of them
    met = w.join(t, [*group, "_c"]).where((F.col("_s") < F.col("end")) & (F.col("start") < F.col("_e")) & (F.col("_c") == F.floor(F.greatest("_s", "start") / CELL)))
    mean = met.select(*group, key, F.posexplode("_v").alias("_p", "_x")).groupBy(*group, key, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    size = F.sqrt(F.sum(F.col("_m") * F.col("_m")).over(Window.partitionBy(*group, key)))
    return mean.withColumn("_n", size).select(*group, key, (F.col("_p") + 1).alias("dimension"), F.when(F.col("_n") > 0, F.col("_m") / F.col("_n")).otherwise(0.0).alias("value"))
