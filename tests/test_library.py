"""Operators of the library against brute force and hand-made rows."""

import json
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.functions import scoring
from lakeloom.functions.chunking import windows
from lakeloom.operators import boards, clustering, dedup, findings, linkage, ranking, resampling, running, sampling, spans, typos


def one(spark, **columns):
    """The value of an expression."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(("a", "b", "d"), [("", "", 0), ("abc", "acb", 1), ("ca", "abc", 3), ("київ", "киів", 1), ("", "ab", 2), ("kitten", "sitting", 3)])
def test_edit_distance(a, b, d):
    assert typos.edit_distance(a, b) == typos.edit_distance(b, a) == d


def test_nearest_words_match_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("абвг'") for _ in range(rng.randrange(1, 13)))
    vocabulary, tokens = sorted({word() for _ in range(150)} | {"12345"}), sorted({word() for _ in range(120)} | {"12346", "7"})
    got = {r.token: (r.distance, r.nearest) for r in typos.nearest_words(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(v,) for v in vocabulary], "token string")).collect()}
    want = {}
    for t in tokens:
        if len(t.replace("'", "")) >= 3 and not t.isdigit():
            most = 2 if len(t) > 8 else 1
            near = [(d, v) for v in vocabulary if v.replace("'", "").isalpha() == t.replace("'", "").isalpha() and (d := typos.edit_distance(t, v)) <= most]
            if near:
                want[t] = min(near)
    assert got == want


def test_components_and_clusters(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(None, 1), (5, 5)]
    parent = {i: i for i in range(400)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.cluster_id for r in clustering.clusters(spark.range(400), "id", spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: find(i) for i in range(400)}
    assert clustering.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_communities_in_order(spark):
    """Two cliques apart are two communities; a random graph gives what a plain loop over the rule gives."""
    cliques = list(combinations(range(4), 2)) + list(combinations(range(4, 8), 2))
    rng = random.Random(8)
    for edges in (cliques, [tuple(rng.sample(range(40), 2)) for _ in range(60)]):
        got = {r.node: r.community for r in clustering.communities_in_order(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
        label = {x: x for e in edges for x in e}
        for _ in range(20):
            before = dict(label)
            for x in sorted(label):
                votes = [label[b] for b in label if (x, b) in edges or (b, x) in edges]
                label[x] = max(sorted(set(votes)), key=votes.count)
            if label == before:
                break
        assert all((got[x] == got[y]) == (label[x] == label[y]) for x, y in combinations(label, 2))
        assert edges is not cliques or len(set(got.values())) == 2


def test_greedy_keep_matches_a_loop(spark):
    rng = random.Random(3)
    pairs = [tuple(sorted(rng.sample(range(80), 2))) for _ in range(110)] + [(i, i + 1) for i in range(80, 99)]
    near = {}
    for a, b in pairs:
        near.setdefault(b, set()).add(a)
    kept = []
    for i in range(100):
        if not near.get(i, set()) & set(kept):
            kept.append(i)
    got = dedup.greedy_keep(spark.range(100), "id", spark.createDataFrame(pairs, "a long, b long"), "a", "b")
    assert sorted(r.id for r in got.collect()) == kept
    assert dedup.greedy_keep(spark.range(5), "id", spark.createDataFrame([], "a long, b long"), "a", "b").count() == 5


@pytest.mark.parametrize("block", [7, 2048])
def test_pairs_above(spark, block):
    m = np.random.default_rng(4).normal(size=(40, 5))
    m[7] = 0
    unit = np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    want = {(i, j) for i, j in combinations(range(40), 2) if round(float(unit[i] @ unit[j]), 6) >= 0.4}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    assert {(r.a, r.b) for r in ranking.pairs_above(df, "id", "v", 0.4, block).collect()} == want


def test_rates_are_learned(spark):
    rng = random.Random(5)
    true = {"x": (0.9, 0.1), "y": (0.8, 0.2), "z": (0.95, 0.05)}
    rows = []
    for _ in range(6000):
        match = rng.random() < 0.2
        rows.append([int(rng.random() < (m if match else u)) if rng.random() > 0.05 else -1 for m, u in true.values()])
    fields = list(true)
    model = linkage.fit_rates(linkage.patterns(spark.createDataFrame(rows, "x int, y int, z int"), fields), fields)
    for f, (m, u) in true.items():
        assert abs(model[f][1][0] - m) < 0.07 and abs(model[f][1][1] - u) < 0.05


def test_running_sums(spark):
    rng = random.Random(6)
    values = rng.sample(range(10_000), 300)
    df = spark.createDataFrame([(float(v), v % 7) for v in values], "v double, n long")
    for down in (False, True):
        total, want = 0, {}
        for v in sorted(values, reverse=down):
            total += v % 7
            want[v] = total
        assert {int(r.v): r.n_run for r in running.running_sums(df, "v", ["n"], down, 8).collect()} == want


def test_bootstrap_covers_the_mean_and_is_repeatable(spark):
    df = spark.createDataFrame([("a", i, float(i % 10)) for i in range(60)] + [(None, 1, 2.0), ("a", 99, None)], "g string, k long, v double")
    first, again = (sorted(map(tuple, resampling.bootstrap_items(df, "g", "k", "v", 200).collect()), key=str) for _ in range(2))
    assert first == again and len(first) == 400
    low = resampling.percentile_interval(resampling.bootstrap_items(df, "g", "k", "v", 200), "g", "mean").where("g = 'a'").first()
    assert low.low < 4.5 < low.high
    assert {r["mean"] for r in resampling.bootstrap_items(df, "g", "k", "v", 5).where("g is null").collect()} == {2.0}


@pytest.mark.parametrize(("w", "l", "p"), [(0, 0, 1.0), (6, 0, 0.03125), (5, 5, 1.0), (8, 2, 0.109375), (300, 200, 0.0000088)])
def test_sign_test(spark, w, l, p):
    assert one(spark, p=resampling.sign_test(F.lit(w), F.lit(l))).p == pytest.approx(p, rel=0.05)


def test_step_down(spark):
    got = {r.t: r.adjusted for r in resampling.step_down(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "t string, p double"), "t", "p").collect()}
    assert got == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_boards(spark):
    df = spark.createDataFrame([("a", 3.0, 1.0), ("b", 2.0, 2.0), ("c", 1.0, 1.0), ("d", 3.0, 1.0), ("e", None, 9.0)], "n string, q double, s double")
    assert {r.n for r in boards.pareto(df, {"q": True, "s": True}).collect()} == {"a", "b", "d", "e"}
    assert boards.margin(df.where("n = 'a'"), "n", "q", 0.1).count() == 0
    assert {r.n: r.quota for r in sampling.quotas(spark.createDataFrame([("x", 1), ("y", 99)], "n string, c long"), "n", "c", 10).collect()} == {"x": 0, "y": 10}


def test_regions(spark):
    inner = spark.createDataFrame([(1, 5, 8), (1, 7, 12), (1, -3, 2), (1, 18, 40)], "k long, start long, end long")
    got = sorted((r.start, r.end) for r in spans.regions(inner, spark.createDataFrame([(1, 20)], "k long, length long"), "k").collect())
    assert got == [(0, 2), (2, 5), (5, 8), (8, 12), (12, 18), (18, 20)]
    assert windows(3, 3, 5, 1) == [] and windows(0, 4, 5, 1) == [(0, 4)] and windows(0, 12, 5, 1) == [(0, 5), (4, 9), (8, 12)]


@pytest.mark.parametrize(
    ("text", "want"),
    [('x ```json\n{"name": "f", "arguments": {"a": 1}}\n``` y', ("f", '{"a":1}')), ('{"tool": "g"}', ("g", "{}")), ('{"function": {"name": "h", "arguments": {"b": "c"}}}', ("h", '{"b":"c"}')), ("just prose", None), ('{"a": 1}', None), (None, None)],
)
def test_tool_call(spark, text, want):
    got = one(spark, c=scoring.tool_call(F.lit(text).cast("string"))).c
    assert (got and (got["name"], json.dumps(json.loads(got["arguments"]), separators=(",", ":")))) == want


def test_arguments_and_values(spark):
    errors = lambda x: one(spark, e=scoring.argument_errors(F.lit(x), ["a"], {"a": "integer", "b": "boolean"})).e
    assert errors('{"a": 1, "b": true}') == [] and errors('{"c": 1}') == ["missing a", "unknown c"] and errors('{"a": "x", "b": 2}') == ["type a", "type b"]
    m = lambda e, a, *rest: one(spark, m=scoring.value_matches(F.lit(e), F.lit(a), *rest)).m
    assert m(" A ", "a") and m("b", "abc", "contains") and m("10", "10.4", "numeric", 0.5) and not m("10", "x", "numeric", 0.5) and m("100", "104", "relative", 0.05)


def test_text_functions(spark):
    lit = F.lit
    r = one(
        spark, cyr=scoring.to_cyrillic(lit("Shchastya")), lat=scoring.to_latin(lit("Їжак")), up=scoring.cased_like(lit("NATO"), lit("нато")), cap=scoring.cased_like(lit("Kyiv"), lit("київ")), own=scoring.cased_like(lit("Kyiv"), lit("КИЇВ")),
        sub=scoring.subqueries(lit('```json\n["a", "A", "b"]\n```')), obj=scoring.subqueries(lit('{"subqueries": ["x"]}')), lines=scoring.subqueries(lit("1. one\n- two\n\n* ONE")),
        n=scoring.occurrences(lit("aaaa"), lit("aa")), zero=scoring.occurrences(lit("aa"), lit("")), at=scoring.grounded(lit("Один Два"), lit("два")), none=scoring.grounded(lit("a"), lit("b")),
        fit=scoring.fitted(F.array(*map(lit, (4, 7, 3, 2))), 10), far=scoring.cosine(F.array(lit(1.0)), F.array(lit(-1.0))), q=scoring.question_type(lit("Скільки днів?"), lit("")), d=scoring.direction(lit("стрімке зростання")),
    )
    assert (r.cyr, r.lat, r.up, r.cap, r.own) == ("щастя", "yizhak", "НАТО", "Київ", "КИЇВ")
    assert r["sub"] == ["a", "b"] and r.obj == ["x"] and r.lines == ["one", "two"]
    assert (r.n, r.zero, tuple(r["at"]), r["none"], r.fit, r.far, r.q, r.d) == (2, 0, (5, 8), None, [True, False, True, True], 0.0, "numeric", "up")


def test_edits_and_spans(spark):
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("xyz").alias("new")), F.struct(F.lit(4).alias("start"), F.lit(4).alias("end"), F.lit("!").alias("new")))
    r = one(spark, t=scoring.edited(F.lit("abcdefg"), edits), after=scoring.remapped(edits, F.lit(5), F.lit(7)), hit=scoring.remapped(edits, F.lit(1), F.lit(3)))
    assert r["t"] == "xyzcd!efg" and tuple(r["after"]) == (7, 9) and r["hit"] is None


def test_findings(spark):
    rows = [(1, "contradicts", "a", "x", "y"), (2, "contradicts", None, "x", "y"), (3, "duplicate", None, "x", "y")]
    df = spark.createDataFrame(rows, "id long, rel string, newer string, x string, y string")
    got = {r.id: (r.rel, r.x, r.y) for r in findings.superseded(df, "rel", "x", "y", F.col("newer")).collect()}
    assert got == {1: ("superseded_by", "y", "x"), 2: ("contradicts", "x", "y"), 3: ("duplicate", "x", "y")}
    r = df.select("id", findings.resolution(F.col("rel"), F.lit("hash"), F.col("newer"), F.col("x"), F.col("y"), "prefer_newer").alias("r"))
    assert {x.id: (x.r.action, x.r.target) for x in r.collect()} == {1: ("escalate", None), 2: ("escalate", None), 3: ("drop_duplicate", "b")}
    with pytest.raises(ValueError):
        findings.resolution(*[F.lit("")] * 5, "other")


def test_a_span_just_behind_an_edit_keeps_its_end(spark, tmp_path):
    """The new start of a span must not stand in for the old one when its end is computed."""
    from lakeloom.plans import catalog

    rows = [(1, "0123456789abcdef", 9, 12), (2, "0123456789abcdef", 6, 12), (3, "short", 9, 12), (4, None, 9, 12)]
    spark.createDataFrame(rows, "claim_id long, text string, char_start int, char_end int").write.parquet(f"{tmp_path}/claim_refs.parquet")
    got = {tuple(r) for r in catalog.QUERIES["edited_claims"](spark, str(tmp_path)).collect()}
    assert got == {(1, "X123489abcdef", 6, 9), (2, "X123489abcdef", None, None)}


def test_bundles_publish_whole_generations(spark, tmp_path):
    from lakeloom.sources import bundles

    base = f"file://{tmp_path}/store"
    bundles.publish({"a": spark.range(3)}, base, {"v": 1})
    bundles.publish({"a": spark.range(5), "b": spark.range(1)}, base, {"v": 2})
    got = bundles.load(spark, base, {"v": 2})
    assert got["a"].count() == 5 and sorted(got) == ["a", "b"]
    with pytest.raises(ValueError):
        bundles.load(spark, base, {"v": 1})


def test_queries_are_prepared(spark):
    from lakeloom.functions import queryprep

    p = queryprep.prepared(F.lit("Який нaказ діє?").cast("string"), {"наказ": ["розпорядження"]})
    r = one(spark, p=p, none=queryprep.prepared(F.lit(None).cast("string"), {"наказ": []}))
    assert r.p.text == "який наказ діє розпорядження" and [(x.step, x.original, x.replacement) for x in r.p.log] == [("repair", "нaказ", "наказ"), ("glossary", "", "розпорядження")]
    assert r.none.text == "" and r.none.log == []


def test_imported_squad_records(spark):
    from lakeloom.sources import bundles

    qa = "struct<id:string,question:string,answers:array<struct<text:string,answer_start:int>>>"
    rows = [("d", [("один два один", [("q1", "?", [("один", 9)]), ("q2", "?", [("", 0), ("два", 0)]), ("q3", "?", [("три", 0)]), ("q4", "?", [])])])]
    df = spark.createDataFrame(rows, f"title string, paragraphs array<struct<context:string,qas:array<{qa}>>>")
    assert {(r.id, r.char_start, r.char_end) for r in bundles.squad_items(df).collect()} == {("q1", 9, 13), ("q2", 5, 8)}
