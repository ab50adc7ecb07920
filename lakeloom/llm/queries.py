"""Queries of the ten problems, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import components, encoding, forms, mixing, mojibake, near_duplicates, overlaps, pairs, scans, splitting


def p1_pages(spark: SparkSession, d: str) -> DataFrame:
    """The running text of every page and what was wrong with it."""
    return scans.repair(table(spark, d, "pdf_pages")).distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(table(spark, d, "pdf_pages")).select("page_id", F.explode("noise").alias("noise")).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, d, "grounded_drafts")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return components.duplicate_files(table(spark, d, "findings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, d, "claim_refs"), "claim_id", "text").select("claim_id", "group_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = overlaps.split_overlaps(table(spark, d, "rag_items_uk"))
    return found.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "rag_items_uk")
    return overlaps.overlap_counts(overlaps.split_overlaps(items), items)


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every item with its two texts in one form and the kinds of difference each had."""
    items = table(spark, d, "rag_items_uk").select("id", "question", "answer_span")
    return forms.consistent(items, ["question", "answer_span"]).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_kinds").alias("k")) for f in ("question", "answer_span")])
    return p6_texts(spark, d).select("id", F.explode(kinds).alias("x")).where("x.k > 0").select("id", "x.field").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_pieces(spark, d).where("n_pieces > 1").select("item_kind", "item_id").distinct()


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    items = splitting.corpus_items(table(spark, d, "pdf_pages"), table(spark, d, "summarization_cases_uk"))
    return splitting.split_items(items, "text").distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts as their ids decode."""
    return p8_ids(spark, d).select("doc_id", encoding.decode(F.col("ids")).alias("text"))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_restored(spark, d).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_pages, p2_found, p3_found, p4_found, p5_found, p5_counts, p6_found, p6_texts, p7_found, p7_pieces, p8_ids, p8_decoded, p9_selection, p9_shares, p10_found, p10_restored)}

SQL = {
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p3_found": """
WITH RECURSIVE e AS (
  SELECT DISTINCT a.doc_id u, b.doc_id v FROM findings
  WHERE lower(trim(relation)) = 'duplicate' AND a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.doc_id <> b.doc_id),
both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach(u, v) AS (SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u)
SELECT u AS doc_id, least(u, min(v)) AS group_id FROM reach GROUP BY u""",
    # brute force over all pairs of claims that share a word, repeats numbered
    "p4_found": """
WITH RECURSIVE w AS (SELECT claim_id, any_value(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: x <> '')) w FROM claim_refs WHERE text IS NOT NULL GROUP BY claim_id),
b AS (SELECT claim_id i, len(w) n, w FROM w WHERE len(w) >= 8), t AS (SELECT i, n, x, row_number() OVER (PARTITION BY i, x) k FROM (SELECT i, n, unnest(w) x FROM b)),
p AS (SELECT a.i u, b.i v FROM t a JOIN t b ON a.x = b.x AND a.k = b.k AND a.i < b.i AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) - 1e-9 GROUP BY a.i, b.i, a.n, b.n HAVING count(*) >= ceil(0.85 * greatest(a.n, b.n) - 1e-9)),
e AS (SELECT u, v FROM p UNION SELECT v, u FROM p), r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT u AS claim_id, least(u, min(v)) AS group_id FROM r GROUP BY u""",
    "p7_found": """
SELECT DISTINCT 'pdf_page' AS item_kind, CAST(page_id AS VARCHAR) AS item_id FROM pdf_pages WHERE length(text) > 1600
UNION SELECT DISTINCT 'summarization_case', id FROM summarization_cases_uk WHERE length(document) > 1600""",
}
