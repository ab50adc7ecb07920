"""Results against plain counting, by plans that don't grow with what they pair or draw."""

import hashlib

from pyspark.sql import functions as F

from lakeloom.operators import linkage, ranking, resampling, typos
from lakeloom.plans import graph_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_draws_are_never_rows(spark):
    values = {"a": [float(i * i % 97) for i in range(1203)], None: [1.5, 2.5], "c": [7.0]}
    df = spark.createDataFrame([(g, i, v) for g, vs in values.items() for i, v in enumerate(vs)], "g string, k int, v double")
    found = resampling.bootstrap_items(df, "g", "k", "v", 12, seed=5)
    assert "Join" not in plan(found)
    number = lambda r, x: int(hashlib.md5(f"5-{r}-{x}".encode()).hexdigest()[:8], 16)
    want = {(g, r): sum(vs[number(r, x) % len(vs)] for x in range(len(vs))) / len(vs) for g, vs in values.items() for r in range(12)}
    got = {(x.g, x.replicate): x.mean for x in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_bootstrap_of_packed_and_parted_groups(spark, monkeypatch):
    monkeypatch.setattr(resampling, "PACK", 7)
    monkeypatch.setattr(resampling, "SHARE", 100)
    df = spark.range(50).select(F.lit("a").alias("g"), "id", (F.col("id") * 3).alias("v"))
    got = {x.replicate: x.mean for x in resampling.bootstrap_items(df, "g", "id", "v", 20).collect()}
    number = lambda r, x: int(hashlib.md5(f"13-{r}-{x}".encode()).hexdigest()[:8], 16)
    assert got == {r: round(sum(3.0 * (number(r, x) % 50) for x in range(50)) / 50, 6) for r in range(20)}


def test_corrections_equal_all_pairs_and_long_words_cost_nothing(spark):
    import random  # noqa: PLC0415

    draw = random.Random(3)
    letters = "абвг'7"
    word = lambda n: "".join(draw.choice(letters) for _ in range(n))
    words = {word(n) for n in range(1, 14) for _ in range(60)} | {"а" * 9000}  # 40 million reductions of that one
    tokens = {word(n) for n in range(2, 13) for _ in range(30)} | {w[1:] for w in sorted(words)[::9] if len(w) < 20} | {w[1:4] + w[5:] for w in sorted(words)[::5] if 10 < len(w) < 20} | {w[:3] + w[4:5] + w[3:4] + w[5:] for w in sorted(words)[::7] if 5 < len(w) < 20}
    got = {r.token: (r.distance, r.nearest) for r in typos.nearest_words(*(spark.createDataFrame([(w,) for w in sorted(x)], "token string") for x in (tokens, words))).collect()}
    plain = lambda w: w.replace("'", "").isalpha()
    want = {}
    for t in tokens:
        if len(t.replace("'", "")) >= typos.LEAST and not t.isdigit():
            most = 2 if len(t) > typos.LONG else 1
            near = [(d, w) for w in words if abs(len(w) - len(t)) <= most and plain(w) == plain(t) and (d := typos.edit_distance(t, w)) <= most]
            if near:
                want[t] = min(near)
    assert got == want and len(want) > 100 and {d for d, _ in got.values()} == {0, 1, 2}


def test_patterns_without_pairs(spark, tmp_path):
    import random  # noqa: PLC0415

    draw = random.Random(5)
    pick = lambda *x: draw.choice(x)
    names = [pick("a/b-", "a/c-", "a/b/c/d-", "7-") + str(draw.randrange(150)) for _ in range(300)] + [None]  # some occur twice
    rows = [(n, pick("x", "y", None), pick("uk", "en", None), pick("1.0", "1.1", "11.0", "2", "01.1", "", None), pick(f"20{draw.randrange(10, 13)}-{draw.randrange(1, 13):02}-{draw.randrange(1, 29):02}", "2011", None)) for n in names]
    spark.createDataFrame(rows, "doc_id string, source_system string, language string, version string, effective_date string").write.parquet(str(tmp_path / "corpus_manifest.parquet"))
    found = graph_queries.agreement_patterns(spark, str(tmp_path))
    fields = graph_queries._FIELDS
    want = linkage.patterns(graph_queries.agreement_levels(spark, str(tmp_path)), fields)
    plainly = lambda df: {tuple(r[f] for f in fields): r["n"] for r in df.collect()}
    assert "doc_id_l" not in plan(found) and plainly(found) == plainly(want) and len(plainly(want)) > 40


def test_lexical_search_sums_in_blocks(spark, monkeypatch):
    import math  # noqa: PLC0415
    import random  # noqa: PLC0415
    from collections import Counter  # noqa: PLC0415

    monkeypatch.setattr(ranking, "BLOCKS", 3)
    monkeypatch.setattr(ranking, "QUERIES", 4)
    draw = random.Random(7)
    text = lambda n: " ".join(draw.choice("abcdefghijkl") * draw.choice((1, 1, 1, 2)) for _ in range(n))
    chunks = [(i, text(draw.randrange(1, 9))) for i in range(900)] + [(i, "a b") for i in range(900, 990)] + [(990, "!")]
    asked = [(f"q{i}", text(draw.randrange(1, 6))) for i in range(9)] + [("qa", "a b"), ("none", "zzz")]
    found = ranking.bm25(spark.createDataFrame(chunks, "chunk_id long, text string"), spark.createDataFrame(asked, "query_id string, text string"), 10)
    docs = {i: Counter(t.split()) if t != "!" else Counter() for i, t in chunks}
    mean, df = sum(d.total() for d in docs.values()) / len(docs), Counter(w for d in docs.values() for w in d)
    want = {}
    for q, t in asked:
        scores = {}
        for i, d in docs.items():
            if common := set(t.split()) & set(d):
                scores[i] = round(sum(t.split().count(w) * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * d[w] * 2.5 / (d[w] + 1.5 * (0.25 + 0.75 * d.total() / mean)) for w in common), 6)
        want |= {(q, r): x for r, x in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10], 1)}
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in found.collect()}
    assert "FlatMapCoGroupsInArrow" in plan(found)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def manifest(spark, path):
    """Files of few source systems, some ids twice; its frame, and its pairs with their levels by Spark's own functions."""
    import random  # noqa: PLC0415

    draw = random.Random(7)
    pick = lambda *x: draw.choice(x)
    names = [pick("a/b-", "a/c-", "a/b/c/d-", "7-", "є/b-") + str(draw.randrange(200)) for _ in range(260)] + [None]
    names += names[:9]
    rows = [(n, pick("x", "x", "y", None), pick("uk", "en", None), pick("1.0", "1.1", "11.0", "2", "01.1", "", None), pick(f"20{draw.randrange(10, 13)}-{draw.randrange(1, 13):02}-{draw.randrange(1, 29):02}", "2011", None)) for n in names]
    spark.createDataFrame([*rows, ("alone", "z", "uk", "1", None)], "doc_id string, source_system string, language string, version string, effective_date string").write.parquet(str(path / "corpus_manifest.parquet"))
    m = graph_queries._editions(spark, str(path))
    a, b = (m.select("source_system", *[F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "language", "version", "dt", "w")]) for x in "lr")
    c = lambda n: (F.col(f"{n}_l"), F.col(f"{n}_r"))
    same = [F.col("language_l") == F.col("language_r")]
    return a.join(b, "source_system").where("doc_id_l < doc_id_r").select(
        F.col("doc_id_l").alias("left_id"), F.col("doc_id_r").alias("right_id"), linkage.levels(*c("language"), same).alias("language"), linkage.edit_levels(*c("version"), [1]).alias("version"),
        linkage.date_levels(*c("dt"), [30, 365]).alias("dated"), linkage.set_levels(*c("w"), [0.9], [0.7]).alias("name"),
    )


def test_replayed_weights_are_looked_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(linkage, "SIDE", 16, raising=False)
    want = manifest(spark, tmp_path).select("left_id", "right_id", F.round(linkage.match_weight(graph_queries._MODEL, 0.01), 6).alias("match_weight"))
    found = graph_queries.replayed_linkage(spark, str(tmp_path))
    assert "levenshtein" not in plan(found) and "array_intersect" not in plan(found)
    assert found.rdd.getNumPartitions() > 20  # two source systems have nearly all
    assert sorted(found.collect()) == sorted(want.collect()) and found.columns == want.columns
    empty = tmp_path / "empty"
    spark.read.parquet(str(tmp_path / "corpus_manifest.parquet")).limit(0).write.parquet(str(empty / "corpus_manifest.parquet"))
    assert graph_queries.replayed_linkage(spark, str(empty)).collect() == []


def test_levels_of_a_large_block_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(linkage, "SIDE", 16, raising=False)
    monkeypatch.setattr(linkage, "BATCH", 50, raising=False)  # fewer pairs than a tile has, and no multiple of its side
    want = manifest(spark, tmp_path)
    found = graph_queries.agreement_levels(spark, str(tmp_path))
    assert "levenshtein" not in plan(found) and found.rdd.getNumPartitions() > 20
    per_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) > 10 and max(per_task) < sum(per_task) / 4
    assert sorted(found.collect()) == sorted(want.collect()) and found.dtypes == want.dtypes
