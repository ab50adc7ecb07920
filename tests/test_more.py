"""Chunking, inference, linkage, sources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import chunking, inference
from lakeloom.operators import linkage, sampling
from lakeloom.plans import catalog
from lakeloom.sources import readers


@pytest.mark.parametrize("strategy", ["sentence", "recursive", "markdown", "table"])
def test_chunks_are_slices_within_the_cap_and_lose_no_text(strategy):
    rng = random.Random(strategy)
    for _ in range(40):
        text = "".join(rng.choice(["слово ", "кінець. ", "\n\n", "\n", "# Назва\n", "| а | б |\n|---|---|\n| 1 | 2 |\n", "дуже" * 60]) for _ in range(rng.randrange(0, 80)))
        spans = chunking.chunk_spans(text, strategy, 100, 20)
        assert all(0 <= s < e <= len(text) and e - s <= 100 for s, e, _ in spans)
        held = set().union(*(range(s, e) for s, e, _ in spans)) if spans else set()
        assert all(i in held for i, c in enumerate(text) if not c.isspace())


def test_headings_and_tables():
    text = "вступ\n# А\nтекст\n## Б\nще\n# В\nкінець"
    assert [h for _, _, h in chunking.chunk_spans(text, "markdown", 50, 0)] == ["", "А", "А > Б", "В"]
    t = "до\n| a | b |\n|---|---|\n| 1 | 2 |\nпісля"
    assert [t[s:e] for s, e in chunking.tables(t)] == ["| a | b |\n|---|---|\n| 1 | 2 |"]
    assert chunking.tables("| a |\n| b |") == []
    with pytest.raises(ValueError):
        chunking.chunk_spans("x", "sentence", 10, 10)


def test_chunked_rows(spark):
    df = spark.createDataFrame([(1, "Перше речення. Друге речення."), (2, None), (3, "  ")], "doc_id long, text string")
    rows = chunking.chunked(df, "doc_id", "text", "sentence", 16, 0).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.text) for r in rows] == [("1#sentence#0000", "Перше речення."), ("1#sentence#0001", " Друге речення.")]


def test_inference():
    assert inference.minimum_discordant_pairs(0.95) == 6
    assert inference.sign_test_p(0, 0) == 1.0 and inference.sign_test_p(6, 0) == pytest.approx(2 / 64)
    assert inference.wilson(0, 0) == (0.0, 1.0) and inference.wilson(5, 10)[0] < 0.5 < inference.wilson(5, 10)[1]
    assert inference.randomization_p([1, 1, 1, 0]) == 1 / 8 and inference.randomization_p([]) == 1.0
    assert inference.required_sample_size(1.0, 100.0) == 2
    assert inference.resolvable_delta(1.0, inference.required_sample_size(1.0, 0.1)) <= 0.1


def test_linkage(spark):
    df = spark.createDataFrame([("a", "x", "1"), ("b", "x", "1"), ("c", "x", "2"), ("d", None, "1"), ("e", "x", None)], "id string, b string, v string")
    got = linkage.linked_pairs(df, "id", [F.col("b")], {"v": (F.col("v"), 0.9, 0.1)}, 0.5, 0.5).collect()
    assert {(r.left_id, r.right_id): round(r.match_probability, 6) for r in got} == {("a", "b"): 0.9, ("a", "e"): 0.5, ("b", "e"): 0.5, ("c", "e"): 0.5}


def test_as_of(spark):
    left = spark.createDataFrame([("d", 5, 1), ("d", 1, 2), ("e", 9, 3)], "doc string, t int, k long")
    right = spark.createDataFrame([("d", 2, 10), ("d", 5, 11), ("d", 5, 12)], "doc string, t int, o long")
    assert {r.k: r.o for r in linkage.as_of(left, right, "doc", "t", "k", "o").collect()} == {1: 12, 2: None, 3: None}


def test_even_positions(spark):
    df = spark.range(0, 1000).withColumn("x", 999 - F.col("id"))
    assert sorted(r.x for r in sampling.evenly_spread(df, ["x"], 4).collect()) == [0, 250, 500, 750]
    assert sampling.evenly_spread(df.limit(0), ["x"], 4).count() == 0


def test_sources(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "a").mkdir(parents=True)
    (root / "a" / "x.md").write_text("рядок\nще")
    (root / "y.txt").write_text("y")
    (root / "z.bin").write_text("z")
    manifest = spark.createDataFrame([("y.txt", "uk")], "doc_id string, language string")
    assert {r.doc_id: (r.text, r.language) for r in readers.read_corpus(spark, str(root), manifest).collect()} == {"a/x.md": ("рядок\nще", None), "y.txt": ("y", "uk")}
    good = tmp_path / "g.jsonl"
    good.write_text('{"id": "1", "n": 2}\nnot json\n')
    loose = readers.read_records(spark, str(good), "id string, n int", strict=False).collect()
    assert [(r.id, r.n, r._corrupt_record) for r in loose] == [("1", 2, None), (None, None, "not json")]
    with pytest.raises(Exception):
        readers.read_records(spark, str(good), "id string, n int").collect()
    fenced = tmp_path / "f.txt"
    fenced.write_text("Ось:\n```json\n[{\"id\": \"1\"}, {\"id\": \"2\"}]\n```\n")
    assert [r.id for r in readers.read_fenced(spark, str(fenced), "id string").collect()] == ["1", "2"]
    readers.write_records(spark.createDataFrame([(1, None)], "a int, b string").coalesce(1), str(tmp_path / "o"))
    assert json.loads(next((tmp_path / "o").glob("*.json")).read_text()) == {"a": 1, "b": None}
    readers.write_sheet(spark.createDataFrame([('x "y"', "1\n2")], "a string, b string").coalesce(1), str(tmp_path / "c"))
    assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / "c")).collect()] == [('x "y"', "1\n2")]


def test_editions_with_every_kind_of_change(spark, tmp_path):
    rows = [(1, "old", "2023-05-01"), (1, "new", "2024-05-01"), (2, "same", "2023-05-01"), (2, "same", "2024-05-01"), (7, "late", "2024-02-01"), (14, "kept", "2023-02-01"), (5, "gone", "2023-02-01"), (5, None, "2024-02-01"), (6, None, "2023-02-01")]
    df = spark.createDataFrame(rows, "claim_id long, text string, t string").selectExpr("claim_id", "text", "cast(t as timestamp) ingested_at")
    df.write.parquet(f"{tmp_path}/claim_refs.parquet")
    got = {r.claim_id: r.change for r in catalog.QUERIES["edition_changes"](spark, str(tmp_path)).collect()}
    assert got == {1: "modified", 2: "unchanged", 5: "removed", 7: "added", 14: "unchanged"}


def test_running_lines_of_up_to_90_characters(spark, tmp_path):
    lines = {60: "а" * 60, 61: "б" * 61, 90: "в" * 90, 91: "г" * 91}
    text = "\n".join(lines.values())
    spark.createDataFrame([(i, "d", text) for i in range(4)], "page_id long, doc_id string, text string").write.parquet(f"{tmp_path}/pdf_pages.parquet")
    got = {r.line: r.n_pages for r in catalog.QUERIES["repeated_page_lines"](spark, str(tmp_path)).collect()}
    assert got == {lines[n]: 4 for n in (60, 61, 90)}
