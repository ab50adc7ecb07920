"""Small hand-made rows for the core operators."""

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.operators import dedup, graph, incremental, ranking, spans, stats


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="Об’єкт 'ДНК' — №5, об`єкт") == ["об'єкт", "днк", "5", "об'єкт"]
    assert one(spark, T.tokens(F.col("t")), t=None) == []


def test_fixed_spans_end_at_the_first_window_that_reaches_the_end(spark):
    f = lambda n: [(r["start"], r["end"]) for r in one(spark, T.fixed_spans(F.col("t"), 10, 4), t="x" * n)]
    assert f(0) == [] and f(10) == [(0, 10)] and f(11) == [(0, 10), (6, 11)] and f(16) == [(0, 10), (6, 16)]
    with pytest.raises(ValueError):
        T.fixed_spans(F.col("t"), 4, 4)


def test_shingles(spark):
    assert one(spark, T.shingles(F.col("t")), t="a b c") == ["a b c"]
    assert one(spark, T.shingles(F.col("t")), t="a b c d e f") == ["a b c d e", "b c d e f"]
    assert one(spark, T.shingles(F.col("t")), t="—") == []


def test_duplicate_key_without_tokens_is_the_text(spark):
    assert one(spark, T.duplicate_key(F.col("t"), "masked"), t="№ 12-а") == "## а"
    assert one(spark, T.duplicate_key(F.col("t"), "normalized"), t="—!") == "—!"


def test_overlaps_are_half_open(spark):
    s = spark.createDataFrame([(1, "d", 5, 9), (2, "d", 0, 4), (3, "e", 5, 9)], "span_id long, doc_id string, char_start int, char_end int")
    o = spark.createDataFrame([("d", 0, 5), ("d", 4, 9), ("d", 3, 3)], "doc_id string, char_start int, char_end int")
    assert {r.span_id: r.n_overlaps for r in spans.overlap_count(s, o).collect()} == {1: 1, 2: 1, 3: 0}


def test_union_counts_shared_characters_once(spark):
    df = spark.createDataFrame([("d", 0, 6), ("d", 4, 10), ("d", 12, 13), ("d", 5, 5)], "doc_id string, s int, e int")
    assert [(r.covered, r.islands) for r in spans.union_length(df, ["doc_id"], "s", "e").collect()] == [(11, 2)]


def test_bm25_counts_repeated_query_terms_and_breaks_ties_by_id(spark):
    c = spark.createDataFrame([(1, "кіт пес"), (2, "кіт пес"), (3, "слон"), (4, None)], "chunk_id long, text string")
    q = spark.createDataFrame([("a", "кіт"), ("b", "кіт кіт"), ("c", "немає")], "query_id string, text string")
    r = {(x.query_id, x["rank"]): (x.chunk_id, x.score) for x in ranking.bm25(c, q, 2).collect()}
    assert r["a", 1][0] == 1 and r["a", 2][0] == 2 and ("c", 1) not in r
    assert r["b", 1][1] == pytest.approx(2 * r["a", 1][1], abs=2e-6)


def test_rrf_with_weight_zero_is_the_other_lane(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, chunk_id long, rank int")
    b = spark.createDataFrame([("q", 9, 1)], "query_id string, chunk_id long, rank int")
    assert [x.chunk_id for x in ranking.rrf([(a, 1.0), (b, 0.0)], 5).orderBy("rank").collect()] == [1, 2]


def test_shingle_pairs_use_classes(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base), (3, base + " more"), (4, "other words altogether here now"), (5, None)]
    found = dedup.shingle_pairs(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    assert [(r.a, r.b) for r in found] == [(1, 3)]


def test_k_hop_gives_least_depth(spark):
    both = graph.undirected(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "x"), (None, "a")], "s string, t string"), "s", "t")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in graph.k_hop(both, seeds, 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_kappa_of_one_label_is_one(spark):
    df = spark.createDataFrame([("x", "x"), ("x", "x"), (None, "x")], "a string, b string")
    assert stats.cohen_kappa(df, F.col("a"), F.col("b")).first().kappa == 1.0
    mixed = spark.createDataFrame([("x", "y"), ("y", "x")], "a string, b string")
    assert stats.cohen_kappa(mixed, F.col("a"), F.col("b")).first().kappa == -1.0


def test_changes_and_journal(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "k long, h string")
    b = spark.createDataFrame([(2, "x"), (3, "y"), (4, "x")], "k long, h string")
    assert {r.k: r.change for r in incremental.changes(a, b, "k", "h").collect()} == {1: "removed", 2: "unchanged", 3: "modified", 4: "added"}
    assert [r.k for r in incremental.remaining(a, b, "k").collect()] == [1]


def test_empty_tables(spark):
    c = spark.createDataFrame([], "chunk_id long, text string")
    q = spark.createDataFrame([], "query_id string, text string")
    assert ranking.bm25(c, q, 3).count() == 0
    v = spark.createDataFrame([], "id long, x array<float>")
    assert ranking.nearest(v, v, "id", "x", 3).count() == 0
