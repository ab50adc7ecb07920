"""Queries of query preparation, lanes, guards and reports, with the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import queryprep
from ..functions import scoring as S
from ..functions import text as T
from ..operators import dedup, ranking, resampling, spans
from ..tables import table
from .corpus_queries import SQL, _tok, query
from .scoring_queries import _latin, _nested
from .statistics_queries import _HASH

#: fixed values: a small glossary
GLOSSARY = {"наказ": ["розпорядження"], "перелік": ["список", "реєстр"], "index": ["catalogue"]}


def _glossary_sql() -> str:
    parts = []
    for c, aliases in GLOSSARY.items():
        forms = [c, *aliases]
        has = " OR ".join(f"contains(t, ' {f} ')" for f in forms)
        lacking = ", ".join(f"CASE WHEN NOT contains(t, ' {f} ') THEN '{f}' END" for f in forms)
        parts.append(f"CASE WHEN {has} THEN list_filter([{lacking}], lambda x: x IS NOT NULL) ELSE [] END")
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


@query(f"""
WITH w AS (SELECT DISTINCT id, {_tok("question")} b FROM rag_items_uk), r AS (SELECT id, b, list_transform(b, lambda x: CASE WHEN regexp_matches(x, '\\p{{Cyrillic}}') AND regexp_matches(x, '[a-z]') THEN translate(x, '{queryprep.LOOKALIKE[0]}', '{queryprep.LOOKALIKE[1]}') ELSE x END) a FROM w),
t AS (SELECT *, ' ' || array_to_string(a, ' ') || ' ' t FROM r), m AS (SELECT *, {_glossary_sql()} m FROM t)
SELECT id, array_to_string(list_concat(a, m), ' ') AS text, CAST(len(list_filter(generate_series(1, len(b)), lambda i: a[i] <> b[i])) AS BIGINT) AS repairs, CAST(len(m) AS BIGINT) AS added FROM m""")
def prepared_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions repaired and expanded, with the number of changes by step."""
    p = table(spark, d, "rag_items_uk").select("id", queryprep.prepared(F.col("question"), GLOSSARY).alias("p"))
    n = lambda step: F.size(F.filter("p.log", lambda x: x["step"] == step)).cast("long")
    return p.select("id", "p.text", n("repair").alias("repairs"), n("glossary").alias("added")).distinct()


@query(f"""
WITH v AS (SELECT DISTINCT unnest({_tok("text")}) t FROM documents), q AS (SELECT DISTINCT id, {_latin("question")} l FROM rag_items_uk),
w AS (SELECT id, unnest(list_filter({_tok("l")}, lambda x: regexp_matches(x, '^[a-z'']+$'))) w FROM q), c AS (SELECT id, {_nested("w")} c FROM w)
SELECT id, count(*) AS words, round(avg(CASE WHEN v.t IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS plausible, avg(CASE WHEN v.t IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.5 AS is_ukrainian FROM c LEFT JOIN v ON v.t = c.c GROUP BY id""")
def language_gates(spark: SparkSession, d: str) -> DataFrame:
    """Whether romanized questions read as Ukrainian: the share of their words that the corpus knows once spelled back."""
    v = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("c")).distinct().withColumn("known", F.lit(1.0))
    w = table(spark, d, "rag_items_uk").select("id", S.to_latin(F.col("question")).alias("l")).distinct().select("id", F.explode(F.filter(T.tokens(F.col("l")), lambda x: x.rlike("^[a-z']+$"))).alias("w"))
    share = F.avg(F.coalesce("known", F.lit(0.0)))
    return w.select("id", S.to_cyrillic(F.col("w")).alias("c")).join(v, "c", "left").groupBy("id").agg(F.count("*").alias("words"), F.round(share, 9).alias("plausible"), (share >= 0.5).alias("is_ukrainian"))


_LANES = "WITH f AS (SELECT DISTINCT finding_id, tier, score, length(evidence) s, lower(trim(relation)) = 'duplicate' y FROM findings WHERE score IS NOT NULL AND tier IS NOT NULL AND relation IS NOT NULL)"


def _lanes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "findings").where("score is not null and tier is not null and relation is not null").select("finding_id", "tier", "score", F.length("evidence").alias("s"), (F.lower(F.trim("relation")) == "duplicate").alias("y")).distinct()


@query(f"""
{_LANES}, j AS (SELECT tier, finding_id, y, r.range replicate, score + 0.01 * ({_HASH.format("r.range || '-' || finding_id")} / 4294967296.0 - 0.5) s FROM f, range(32) r),
k AS (SELECT tier, replicate, y, row_number() OVER (PARTITION BY tier, replicate ORDER BY s DESC, finding_id) r FROM j), m AS (SELECT tier, replicate, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) p FROM k WHERE r <= 10 GROUP BY ALL)
SELECT tier, round(min(p), 9) AS low, round(max(p), 9) AS high, round(avg(p), 9) AS mean, round((max(p) - min(p)) / 2, 9) AS half_width FROM m GROUP BY tier""")
def noise_floor(spark: SparkSession, d: str) -> DataFrame:
    """How far the precision of the first ten moves when scores are jittered, over replicates."""
    j = _lanes(spark, d).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(31))))
    j = j.withColumn("j", F.col("score") + 0.01 * (resampling.hashed_number(F.col("replicate"), F.col("finding_id")) / float(1 << 32) - 0.5))
    m = ranking.top_k(j, ["tier", "replicate"], [F.desc("j"), F.asc("finding_id")], 10).groupBy("tier", "replicate").agg(F.avg(F.col("y").cast("double")).alias("p"))
    return m.groupBy("tier").agg(F.round(F.min("p"), 9).alias("low"), F.round(F.max("p"), 9).alias("high"), F.round(F.avg("p"), 9).alias("mean"), F.round((F.max("p") - F.min("p")) / 2, 9).alias("half_width"))


@query(f"""
{_LANES}, a AS (SELECT tier, finding_id, row_number() OVER (PARTITION BY tier ORDER BY score DESC, finding_id) r FROM f), b AS (SELECT tier, finding_id, row_number() OVER (PARTITION BY tier ORDER BY coalesce(s, -1) DESC, finding_id) r FROM f),
u AS (SELECT w.w, tier, finding_id, sum(x) x FROM (SELECT unnest([0.0, 0.3, 0.5, 1.0]) w) w, LATERAL (SELECT tier, finding_id, w.w / (60 + r) x FROM a WHERE r <= 50 AND w.w > 0 UNION ALL SELECT tier, finding_id, (1 - w.w) / (60 + r) FROM b WHERE r <= 50 AND w.w < 1) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY w, tier ORDER BY round(x, 9) DESC, finding_id) r FROM u)
SELECT CAST(w AS DOUBLE) AS weight, tier, finding_id, r AS rank FROM k WHERE r <= 3""")
def fusion_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Two lanes fused at several weights; a lane of weight 0 adds nothing."""
    f = _lanes(spark, d).select(F.col("tier").alias("query_id"), F.col("finding_id").alias("chunk_id"), "score", F.coalesce("s", F.lit(-1)).alias("s"))
    a, b = (ranking.top_k(f, ["query_id"], [F.desc(c), F.asc("chunk_id")], 50) for c in ("score", "s"))
    out = None
    for w in (0.0, 0.3, 0.5, 1.0):
        one = ranking.rrf([(a, w), (b, 1 - w)], 3).select(F.lit(w).alias("weight"), F.col("query_id").alias("tier"), F.col("chunk_id").alias("finding_id"), F.col("rank").cast("long").alias("rank"))
        out = one if out is None else out.union(one)
    return out


@query(f"""
{_LANES}, a AS (SELECT tier, finding_id FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, finding_id) r FROM f) WHERE r <= 20), b AS (SELECT tier, finding_id FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY coalesce(s, -1) DESC, finding_id) r FROM f) WHERE r <= 20)
SELECT t.tier, count(b.finding_id) AS shared FROM a t LEFT JOIN b ON b.tier = t.tier AND b.finding_id = t.finding_id GROUP BY t.tier""")
def lane_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that both lanes have."""
    f = _lanes(spark, d)
    a, b = (ranking.top_k(f, ["tier"], [F.desc(c), F.asc("finding_id")], 20).select("tier", "finding_id") for c in (F.col("score"), F.coalesce("s", F.lit(-1))))
    return a.join(b.withColumn("hit", F.lit(1)), ["tier", "finding_id"], "left").groupBy("tier").agg(F.count("hit").alias("shared"))


@query("""
WITH p AS (SELECT DISTINCT question_type, source_doc_id x FROM grounded_drafts WHERE lang = 'uk'), l AS (SELECT DISTINCT question_type, source_doc_id x FROM grounded_drafts WHERE lang = 'en'),
j AS (SELECT coalesce(p.question_type, l.question_type) q, count(p.x) np, count(l.x) nl, count(CASE WHEN p.x IS NOT NULL AND l.x IS NOT NULL THEN 1 END) k FROM p FULL JOIN l ON p.question_type IS NOT DISTINCT FROM l.question_type AND p.x = l.x GROUP BY 1)
SELECT q AS question_type, round(CASE WHEN np > 0 THEN k / np ELSE 0 END, 9) AS precision, round(CASE WHEN nl > 0 THEN k / nl ELSE 0 END, 9) AS recall, round(CASE WHEN k > 0 THEN 2 * (k / np) * (k / nl) / (k / np + k / nl) ELSE 0 END, 9) AS f1 FROM j""")
def label_set_scores(spark: SparkSession, d: str) -> DataFrame:
    """Sets of predicted against true labels."""
    rows = table(spark, d, "grounded_drafts").select("question_type", "source_doc_id", "lang").where("lang in ('uk', 'en')").distinct()
    both = rows.groupBy("question_type", "source_doc_id").agg(F.max((F.col("lang") == "uk").cast("int")).alias("p"), F.max((F.col("lang") == "en").cast("int")).alias("l")).where("source_doc_id is not null")
    np_, nl, k = F.sum("p"), F.sum("l"), F.sum(F.col("p") * F.col("l"))
    pr, rc = F.when(np_ > 0, k / np_).otherwise(0.0), F.when(nl > 0, k / nl).otherwise(0.0)
    return both.groupBy("question_type").agg(F.round(pr, 9).alias("precision"), F.round(rc, 9).alias("recall"), F.round(T.f1(pr, rc), 9).alias("f1"))


@query("""
WITH f AS (SELECT DISTINCT a.doc_id doc_id, a.char_start s, a.char_end e FROM findings WHERE a.char_end > a.char_start), c AS (SELECT DISTINCT claim_id, doc_id, char_start, char_end FROM claim_refs WHERE char_end > char_start)
SELECT claim_id FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = c.doc_id AND f.s < c.char_end AND c.char_start < f.e)""")
def claims_off_gold(spark: SparkSession, d: str) -> DataFrame:
    """Claims that overlap no span a finding points at."""
    c = table(spark, d, "claim_refs").where("char_end > char_start and doc_id is not null").select(F.col("claim_id").alias("span_id"), "doc_id", "char_start", "char_end").distinct()
    f = table(spark, d, "findings").select("a.doc_id", "a.char_start", "a.char_end").distinct()
    return spans.overlap_count(c, f).where("n_overlaps = 0").select(F.col("span_id").alias("claim_id"))


@query("""
SELECT doc, count(DISTINCT id) AS items FROM rag_items_uk WHERE doc IN (SELECT doc FROM rag_items_uk WHERE lower(trim(split)) = 'tuning') AND lower(trim(split)) IN ('final', 'calibration') GROUP BY doc""")
def split_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Files of protected splits that training items come from too."""
    rows = table(spark, d, "rag_items_uk").select("id", "doc", F.lower(F.trim("split")).alias("s"))
    return rows.where("s in ('final', 'calibration')").join(rows.where("s = 'tuning'").select("doc").distinct(), "doc", "left_semi").groupBy("doc").agg(F.countDistinct("id").alias("items"))


@query(f"SELECT count(*) AS n, count(*) FILTER (contaminated) AS flagged, round(avg(CASE WHEN contaminated THEN 1.0 ELSE 0.0 END), 9) AS rate FROM ({SQL['item_checks']})")
def contamination(spark: SparkSession, d: str) -> DataFrame:
    from .scoring_queries import item_checks  # noqa: PLC0415

    return item_checks(spark, d).agg(F.count("*").alias("n"), F.count_if("contaminated").alias("flagged"), F.round(F.avg(F.col("contaminated").cast("double")), 9).alias("rate"))


@query("""
SELECT question_type, difficulty, count(DISTINCT id) AS drafted, count(DISTINCT source_doc_id) AS files FROM grounded_drafts WHERE question_type IS NOT NULL AND difficulty IS NOT NULL GROUP BY GROUPING SETS ((question_type, difficulty), (question_type), (difficulty), ())""")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """Drafts and files by kind, by difficulty, by both and in all."""
    rows = table(spark, d, "grounded_drafts").where("question_type is not null and difficulty is not null")
    return rows.groupingSets([["question_type", "difficulty"], ["question_type"], ["difficulty"], []], "question_type", "difficulty").agg(F.countDistinct("id").alias("drafted"), F.countDistinct("source_doc_id").alias("files"))


@query("""
WITH d AS (SELECT DISTINCT id, quote, reference_answer FROM grounded_drafts WHERE quote IS NOT NULL AND reference_answer <> '' AND contains(quote, reference_answer))
SELECT min(id) AS id, sha256(quote) AS context FROM d GROUP BY quote""")
def diverse_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The first draft grounded in each quote."""
    rows = table(spark, d, "grounded_drafts").where("quote is not null and reference_answer <> '' and contains(quote, reference_answer)").select("id", F.sha2("quote", 256).alias("context")).distinct()
    return dedup.first_wins(rows, ["context"], [F.col("id")]).select("id", "context")


@query("""
WITH c AS (SELECT claim_id, max(CASE WHEN governance.effective_date IS NOT NULL THEN 1 ELSE 0 END) d, max(CASE WHEN governance.version IS NOT NULL THEN 1 ELSE 0 END) v, any_value(doc_id) doc_id FROM claim_refs GROUP BY claim_id)
SELECT m.source_system, count(*) AS n, round(avg(CAST(d AS DOUBLE)), 9) AS dated, round(avg(CAST(v AS DOUBLE)), 9) AS versioned FROM c LEFT JOIN corpus_manifest m USING (doc_id) GROUP BY m.source_system""")
def governance_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of claims with a date and with a version."""
    c = table(spark, d, "claim_refs").groupBy("claim_id").agg(F.max(F.col("governance.effective_date").isNotNull().cast("int")).alias("d"), F.max(F.col("governance.version").isNotNull().cast("int")).alias("v"), F.first("doc_id").alias("doc_id"))
    m = table(spark, d, "corpus_manifest").select("doc_id", "source_system")
    return c.join(m, "doc_id", "left").groupBy("source_system").agg(F.count("*").alias("n"), F.round(F.avg(F.col("d").cast("double")), 9).alias("dated"), F.round(F.avg(F.col("v").cast("double")), 9).alias("versioned"))


@query("""
SELECT event_type, n, round(n / sum(n) OVER (), 9) AS share, ok FROM (SELECT event_type, count(*) n, event_type <> 'error' ok FROM events GROUP BY event_type)""")
def reliability(spark: SparkSession, d: str) -> DataFrame:
    """Share of each status, and whether it counts as success."""
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.select("event_type", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("share"), (F.col("event_type") != "error").alias("ok"))


@query(f"SELECT n, spearman, spearman >= 0.6 AS trusted FROM ({SQL['length_correlations']})")
def judge_trust(spark: SparkSession, d: str) -> DataFrame:
    """Whether a judge's ranks follow the reference enough to be trusted."""
    from .statistics_queries import length_correlations  # noqa: PLC0415

    return length_correlations(spark, d).select("n", "spearman", (F.col("spearman") >= 0.6).alias("trusted"))


@query(f"""
SELECT round(1 - 100 / cross_document_pairs, 12) AS quantile, CAST(ceil(ln(1 - 0.95) / ln(1 - 0.01)) AS BIGINT) AS certifiable_units FROM ({SQL['cross_document_pairs']})""")
def operating_point(spark: SparkSession, d: str) -> DataFrame:
    """The quantile of similarities that leaves a hundred pairs, and units that certify a rate of one percent."""
    from .statistics_queries import cross_document_pairs  # noqa: PLC0415

    return cross_document_pairs(spark, d).select(F.round(1 - 100 / F.col("cross_document_pairs"), 12).alias("quantile"), F.ceil(F.log(F.lit(1 - 0.95)) / F.log(F.lit(1 - 0.01))).alias("certifiable_units"))


@query("""
SELECT 'minimum_discordant_pairs' AS name, ceil(1 - log2(1 - 0.95)) AS value UNION ALL SELECT 'required_sample_size', ceil(pow((1.959963984540054 + 0.8416212335729143) * 0.4 / 0.05, 2))
UNION ALL SELECT 'resolvable_delta', round((1.959963984540054 + 0.8416212335729143) * 0.4 / sqrt(200), 9) UNION ALL SELECT 'kv_mib', 4096.0 * (4 * 32768 + 20 * 4096) / 1048576.0 UNION ALL SELECT 'kv_mib_full', 4096.0 * 24 * 32768 / 1048576.0""")
def planning_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Figures of planning: pairs that must differ, rows for a difference, the difference rows can show, memory of keys and values."""
    from ..functions import inference as I  # noqa: N812, PLC0415

    rows = [
        ("minimum_discordant_pairs", float(I.minimum_discordant_pairs())), ("required_sample_size", float(I.required_sample_size(0.4, 0.05))), ("resolvable_delta", round(I.resolvable_delta(0.4, 200), 9)),
        ("kv_mib", I.kv_cache_mib(24, 1024, 32768, 4096, 6)), ("kv_mib_full", I.kv_cache_mib(24, 1024, 32768)),
    ]
    return spark.createDataFrame(rows, "name string, value double")


def trained_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of agreement among matches and others, learned from the pattern histogram of file pairs."""
    from ..operators import linkage  # noqa: PLC0415
    from .graph_queries import _FIELDS, agreement_patterns  # noqa: PLC0415

    model = linkage.fit_rates(agreement_patterns(spark, d), _FIELDS)
    rows = [(f, k, round(m, 6), round(u, 6)) for f, levels in model.items() for k, (m, u) in levels.items()]
    return spark.createDataFrame(rows, "field string, level int, m double, u double")


def ordered_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of files by labels propagated in ascending order."""
    from ..operators.clustering import communities_in_order  # noqa: PLC0415

    e = table(spark, d, "findings").where("lower(trim(relation)) = 'duplicate'").select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"))
    return communities_in_order(e, "x", "y")


from .corpus_queries import QUERIES  # noqa: E402

QUERIES.update({f.__name__: f for f in (trained_rates, ordered_communities)})
