"""Queries of resampling, tests, intervals and boards, with the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import boards, resampling
from ..staging import stage
from ..tables import table
from .corpus_queries import query

_CASES = "(SELECT DISTINCT id, CAST(length(document) AS DOUBLE) a, CAST(length(reference) AS DOUBLE) b FROM summarization_cases_uk)"
_HASH = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "summarization_cases_uk").select("id", F.length("document").cast("double").alias("a"), F.length("reference").cast("double").alias("b"), F.lit("all").alias("g")).distinct()


_BOOT = f"""
WITH i AS (SELECT id, b v, row_number() OVER (ORDER BY id) - 1 i, count(*) OVER () n FROM {_CASES} WHERE b IS NOT NULL),
w AS (SELECT r.range replicate, {_HASH.format("'13-' || r.range || '-' || x.range")} % (SELECT max(n) FROM i) i FROM range(2000) r, range((SELECT max(n) FROM i)) x)
SELECT replicate, round(avg(v), 6) AS mean FROM w JOIN i USING (i) GROUP BY replicate"""


@query(_BOOT)
def bootstrap_references(spark: SparkSession, d: str) -> DataFrame:
    """Means of 2,000 bootstrap replicates of the items."""
    return resampling.bootstrap_items(_cases(spark, d), "g", "id", "b", 2000).drop("g")


@query(f"""
WITH s AS (SELECT list_sort(list(mean)) s, len(list(mean)) n FROM ({_BOOT}))
SELECT 'nearest' AS kind, s[CAST(round_even(0.025 * (n - 1), 0) AS BIGINT) + 1] AS low, s[least(CAST(round_even(0.975 * (n - 1), 0) AS BIGINT), n - 1) + 1] AS high FROM s
UNION ALL SELECT 'truncated', s[CAST(floor(0.025 * n) AS BIGINT) + 1], s[least(CAST(floor(0.975 * n) AS BIGINT), n - 1) + 1] FROM s""")
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    samples = stage(bootstrap_references(spark, d).withColumn("g", F.lit("all")), "replicates")  # read by both kinds
    parts = [resampling.percentile_interval(samples, "g", "mean", truncated=t).select(F.lit(k).alias("kind"), "low", "high") for k, t in (("nearest", False), ("truncated", True))]
    return parts[0].union(parts[1])


@query(f"SELECT round(avg(CASE WHEN mean > 120 THEN 1.0 ELSE 0.0 END), 9) AS share FROM ({_BOOT})")
def bootstrap_exceedance(spark: SparkSession, d: str) -> DataFrame:
    return resampling.exceedance(bootstrap_references(spark, d).withColumn("g", F.lit("all")), "g", "mean", 120.0).drop("g")


_POISSON = "[0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]"


@query(f"""
WITH r AS (SELECT DISTINCT lang, id, CAST(length(reference_answer) AS DOUBLE) v FROM grounded_drafts WHERE reference_answer IS NOT NULL),
w AS (SELECT lang, v, x.range replicate, len(list_filter({_POISSON}, lambda s: ({_HASH.format("'13-' || x.range || '-' || id")} + 0.5) / 4294967296.0 > s)) t FROM r, range(200) x)
SELECT lang, replicate, CASE WHEN sum(t) > 0 THEN round(sum(t * v) / sum(t), 6) END AS mean FROM w GROUP BY lang, replicate""")
def poisson_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "grounded_drafts").select("lang", "id", F.length("reference_answer").alias("v")).distinct()
    return resampling.poisson_means(rows, "lang", "id", "v", 200)


@query(f"""
WITH d AS (SELECT a, b FROM {_CASES} WHERE a IS NOT NULL AND b IS NOT NULL),
r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 rb FROM d)
SELECT count(*) AS n, round(corr(a, b), 6) AS pearson, coalesce(round(corr(ra, rb), 6), 0) AS spearman FROM r""")
def length_correlations(spark: SparkSession, d: str) -> DataFrame:
    return resampling.correlations(_cases(spark, d), "g", "a", "b").drop("g")


@query("""
WITH l AS (SELECT DISTINCT finding_id item, 'a' rater, CAST(score > 0.5 AS VARCHAR) label FROM findings WHERE score IS NOT NULL UNION SELECT DISTINCT finding_id, 'b', CAST(lower(trim(relation)) = 'duplicate' AS VARCHAR) FROM findings WHERE score IS NOT NULL AND relation IS NOT NULL
 UNION SELECT DISTINCT finding_id, 'c', CAST(evidence IS NOT NULL AS VARCHAR) FROM findings WHERE score IS NOT NULL AND relation IS NOT NULL),
g AS (SELECT * FROM l WHERE item IN (SELECT item FROM l GROUP BY item HAVING count(*) = 3)),
c AS (SELECT item, label, count(*) n FROM g GROUP BY ALL),
p AS (SELECT item, sum(n * (n - 1)) / 6.0 p FROM c GROUP BY item),
e AS (SELECT sum(n * n) / (sum(n) * sum(n)) e FROM (SELECT label, CAST(sum(n) AS DOUBLE) n FROM c GROUP BY label))
SELECT count(*) AS items, 3 AS raters, round((avg(p) - any_value(e)) / (1 - any_value(e)), 9) AS kappa FROM p, e""")
def three_raters(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings").where("score is not null and relation is not null").select("finding_id", (F.col("score") > 0.5).alias("a"), (F.lower(F.trim("relation")) == "duplicate").alias("b"), F.col("evidence").isNotNull().alias("c")).distinct()
    one = f.groupBy("finding_id").agg(F.count("*").alias("k"), *[F.first(x).alias(x) for x in "abc"]).where("k = 1")
    return resampling.fleiss_kappa(one.select(F.col("finding_id").alias("item"), F.explode(F.array("a", "b", "c")).alias("label")), "item", "label")


@query("""
WITH f AS (SELECT tier, count(*) n, count(*) FILTER (lower(trim(relation)) = 'duplicate') k FROM (SELECT DISTINCT finding_id, tier, relation FROM findings) GROUP BY tier),
c AS (SELECT *, k / n p, 1.959963984540054 z FROM f)
SELECT tier, n, k AS successes, round(greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)), 0), 9) AS low,
 round(least((p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)), 1), 9) AS high FROM c""")
def tier_precision(spark: SparkSession, d: str) -> DataFrame:
    """Share of duplicates by tier with its Wilson interval."""
    f = table(spark, d, "findings").select("finding_id", "tier", "relation").distinct()
    g = f.groupBy("tier").agg(F.count("*").alias("n"), F.count_if(F.lower(F.trim("relation")) == "duplicate").alias("successes"))
    low, high = resampling.wilson(F.col("successes"), F.col("n"))
    return g.select("tier", "n", "successes", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


_PAIRED = "SELECT DISTINCT id, question_type g, CAST(length(reference_answer) AS DOUBLE) - length(quote) / 2.0 d FROM grounded_drafts WHERE reference_answer IS NOT NULL AND quote IS NOT NULL"


def _paired(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "grounded_drafts").where("reference_answer is not null and quote is not null").select("id", F.col("question_type").alias("g"), (F.length("reference_answer").cast("double") - F.length("quote") / 2.0).alias("d")).distinct()


@query(f"""
WITH c AS (SELECT g, count(*) FILTER (d > 0) w, count(*) FILTER (d < 0) l FROM ({_PAIRED}) GROUP BY g)
SELECT g AS question_type, w AS wins, l AS losses, round(CASE WHEN w + l = 0 THEN 1 ELSE least(1.0, 2 * list_sum(list_transform(generate_series(0, least(w, l)), lambda i: exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2.0))))) END, 6) AS p FROM c""")
def sign_tests(spark: SparkSession, d: str) -> DataFrame:
    g = _paired(spark, d).groupBy("g").agg(F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"))
    return g.select(F.col("g").alias("question_type"), "wins", "losses", F.round(resampling.sign_test(F.col("wins"), F.col("losses")), 6).alias("p"))


_FLIPS = f"""
WITH d AS (SELECT * FROM ({_PAIRED}) WHERE d <> 0), s AS (SELECT g, sum(d) seen, count(*) n FROM d GROUP BY g),
f AS (SELECT g, r.range r, sum(CASE WHEN {_HASH.format("'13-' || r.range || '-' || id")} % 2 = 0 THEN abs(d) ELSE -abs(d) END) s FROM d, range(500) r GROUP BY ALL)
SELECT s.g AS question_type, any_value(n) AS n, round((count(*) FILTER (f.s >= seen - 1e-9) + 1) / 501.0, 9) AS p FROM f JOIN s ON f.g IS NOT DISTINCT FROM s.g GROUP BY s.g"""


@query(_FLIPS)
def sign_flip_tests(spark: SparkSession, d: str) -> DataFrame:
    return resampling.sign_flips(_paired(spark, d), "g", "d", "id", 500).withColumnRenamed("g", "question_type")


@query(f"""
WITH t AS (SELECT coalesce(question_type, '') name, p, row_number() OVER (ORDER BY p, coalesce(question_type, '')) i, count(*) OVER () m FROM ({_FLIPS}))
SELECT name, p, round(max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM t""")
def selection_adjusted(spark: SparkSession, d: str) -> DataFrame:
    return resampling.step_down(sign_flip_tests(spark, d).select(F.coalesce("question_type", F.lit("")).alias("name"), "p"), "name", "p")


_SCORED = "SELECT score v, lower(trim(relation)) = 'duplicate' pos FROM findings WHERE score IS NOT NULL AND relation IS NOT NULL"


@query(f"""
WITH c AS (SELECT v, CAST(count(*) FILTER (pos) AS DOUBLE) p, CAST(count(*) FILTER (NOT pos) AS DOUBLE) * 0.5 n FROM ({_SCORED}) GROUP BY v),
r AS (SELECT p, n, sum(n) OVER (ORDER BY v) run FROM c)
SELECT round(sum(p * (run - n / 2)) / (sum(p) * sum(n)), 9) AS auc FROM r""")
def score_auc(spark: SparkSession, d: str) -> DataFrame:
    return resampling.rank_auc(table(spark, d, "findings").where("relation is not null"), F.lower(F.trim("relation")) == "duplicate", "score", F.lit(0.5))


@query(f"""
WITH c AS (SELECT v, count(*) FILTER (pos) p, count(*) n FROM ({_SCORED}) GROUP BY v),
r AS (SELECT v, sum(p) OVER (ORDER BY v DESC) tp, sum(n) OVER (ORDER BY v DESC) al, sum(p) OVER () t FROM c),
s AS (SELECT v threshold, round(tp / al, 9) "precision", round(tp / t, 9) recall, round(2 * (tp / al) * (tp / t) / (tp / al + tp / t), 9) f1 FROM r WHERE tp > 0)
SELECT * FROM s ORDER BY f1 DESC, "precision" DESC, threshold DESC LIMIT 1""")
def duplicate_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The score cut of the best F1 for duplicates."""
    return resampling.best_threshold(table(spark, d, "findings").where("relation is not null"), F.lower(F.trim("relation")) == "duplicate", "score")


# ---- boards over sources

_SIGNALS = "SELECT source, count(*) n, round(avg(n_chars), 6) quality, round(CAST(count(*) FILTER (lang = 'uk') AS DOUBLE) / count(*), 6) speed, max(n_chars) cost FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL GROUP BY source"


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source is not null and n_chars is not null").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("quality"), F.round(F.coalesce(F.count_if(F.col("lang") == "uk"), F.lit(0)) / F.count("*"), 6).alias("speed"), F.max("n_chars").alias("cost"))


@query(f"""
WITH s AS ({_SIGNALS})
SELECT source FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.quality >= a.quality AND b.speed >= a.speed AND b.cost <= a.cost AND (b.quality > a.quality OR b.speed > a.speed OR b.cost < a.cost))""")
def pareto_sources(spark: SparkSession, d: str) -> DataFrame:
    return boards.pareto(_signals(spark, d), {"quality": True, "speed": True, "cost": False}).select("source")


@query(f"""
WITH s AS ({_SIGNALS}), r AS (SELECT *, row_number() OVER (ORDER BY quality DESC, speed DESC, cost, source) r FROM s WHERE n >= 3)
SELECT source, CAST(r AS BIGINT) AS rank FROM r UNION ALL SELECT source, NULL FROM s WHERE n < 3""")
def ranked_results(spark: SparkSession, d: str) -> DataFrame:
    return boards.ranked(_signals(spark, d), F.col("n") >= 3, [F.desc("quality"), F.desc("speed"), F.asc("cost"), F.asc("source")]).select("source", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH s AS ({_SIGNALS}), r AS (SELECT source, row_number() OVER (ORDER BY quality DESC, source) r, count(*) OVER () n FROM s)
SELECT source, r <= greatest(3, n // 3) AS kept FROM r""")
def halving_survivors(spark: SparkSession, d: str) -> DataFrame:
    return boards.survivors(_signals(spark, d), [F.desc("quality"), F.asc("source")], 3, 3).select("source", "kept")


@query(f"""
WITH s AS ({_SIGNALS}), f AS (SELECT * FROM s WHERE quality >= 0.8 * (SELECT max(quality) FROM s))
SELECT 'quality' AS goal, (SELECT source FROM s ORDER BY quality DESC, source LIMIT 1) AS source
UNION ALL SELECT 'rate', (SELECT source FROM s ORDER BY quality * speed DESC, source LIMIT 1)
UNION ALL SELECT 'cost', (SELECT source FROM f ORDER BY cost, source LIMIT 1)""")
def goal_picks(spark: SparkSession, d: str) -> DataFrame:
    return boards.goal_picks(_signals(spark, d), "source", "quality", F.col("quality") * F.col("speed"), "cost", 0.8)


@query(f"""
WITH s AS ({_SIGNALS}), o AS (SELECT source, quality, row_number() OVER (ORDER BY quality DESC, source) r FROM s)
SELECT a.source AS first, b.source AS second, round(a.quality - b.quality, 6) AS gap, a.quality - b.quality > 50 AS separated FROM o a JOIN o b ON a.r = 1 AND b.r = 2""")
def floor_margin(spark: SparkSession, d: str) -> DataFrame:
    """The gap of the first two against a noise floor."""
    return boards.margin(_signals(spark, d), "source", "quality", 50.0)


@query(f"""
WITH s AS ({_SIGNALS}), p AS (SELECT source, rank() OVER (ORDER BY quality DESC) a, rank() OVER (ORDER BY quality * speed DESC) b FROM s)
SELECT source, a AS rank_a, b AS rank_b FROM p WHERE a <> b""")
def policy_rank_changes(spark: SparkSession, d: str) -> DataFrame:
    return boards.rank_changes(_signals(spark, d), "source", F.col("quality"), F.col("quality") * F.col("speed"))


@query("""
WITH p AS (SELECT DISTINCT question_type, id FROM grounded_drafts), s AS (SELECT question_type, count(*) n FROM p WHERE question_type IS NOT NULL GROUP BY 1),
q AS (SELECT *, 40 * n / (SELECT sum(n) FROM s) x FROM s), b AS (SELECT *, floor(x) f, row_number() OVER (ORDER BY x - floor(x) DESC, question_type) r FROM q)
SELECT question_type, n, CAST(least(n, f + CASE WHEN r <= 40 - (SELECT sum(f) FROM b) THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM b""")
def stratum_quotas(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 40 by largest remainder."""
    from ..operators.sampling import quotas  # noqa: PLC0415

    items = table(spark, d, "grounded_drafts").where("question_type is not null").select("question_type", "id").distinct()
    return quotas(items.groupBy("question_type").agg(F.count("*").alias("n")), "question_type", "n", 40)


@query("""
WITH p AS (SELECT DISTINCT question_type, id FROM grounded_drafts WHERE question_type IS NOT NULL), s AS (SELECT question_type, count(*) n FROM p GROUP BY 1),
q AS (SELECT *, 40 * n / (SELECT sum(n) FROM s) x FROM s), b AS (SELECT *, floor(x) f, row_number() OVER (ORDER BY x - floor(x) DESC, question_type) r FROM q),
t AS (SELECT question_type, least(n, f + CASE WHEN r <= 40 - (SELECT sum(f) FROM b) THEN 1 ELSE 0 END) quota FROM b)
SELECT id, question_type FROM (SELECT p.*, t.quota, row_number() OVER (PARTITION BY p.question_type ORDER BY md5('13-' || id), id) r FROM p JOIN t USING (question_type)) WHERE r <= quota""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.sampling import stratified  # noqa: PLC0415

    items = table(spark, d, "grounded_drafts").where("question_type is not null").select("question_type", "id").distinct()
    return stratified(items, "question_type", "id", 40, 13).select("id", "question_type")


@query("""
WITH m AS (SELECT year(ts) * 12 + month(ts) - 1 o, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) a, count(*) n FROM events GROUP BY 1),
s AS (SELECT o, a, n, max(a) OVER (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) later FROM m)
SELECT o AS month_no, lpad(CAST(o // 12 AS VARCHAR), 4, '0') || '-' || lpad(CAST(o % 12 + 1 AS VARCHAR), 2, '0') AS month, n, round(a, 9) AS accuracy, round((a - 0.25) / 0.75, 9) AS adjusted, later < 0.5 AS below_from_here FROM s""")
def monthly_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by month, adjusted for chance, and whether it stays below the threshold from there on."""
    o = (F.year("ts") * 12 + F.month("ts") - 1).alias("month_no")
    m = table(spark, d, "events").groupBy(o).agg(F.count("*").alias("n"), F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("a"))
    suffix = Window.orderBy("month_no").rowsBetween(0, Window.unboundedFollowing)  # one row a month
    month = F.format_string("%04d-%02d", F.floor(F.col("month_no") / 12).cast("int"), (F.col("month_no") % 12 + 1).cast("int"))
    return m.select(F.col("month_no").cast("long").alias("month_no"), month.alias("month"), "n", F.round("a", 9).alias("accuracy"), F.round((F.col("a") - 0.25) / 0.75, 9).alias("adjusted"), (F.max("a").over(suffix) < 0.5).alias("below_from_here"))


@query("""
WITH c AS (SELECT DISTINCT claim_id, doc_id FROM claim_refs), g AS (SELECT doc_id, count(*) n FROM c GROUP BY 1)
SELECT CAST(sum(n) * (sum(n) - 1) / 2 - sum(n * (n - 1) / 2) AS BIGINT) AS cross_document_pairs FROM g""")
def cross_document_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of claims of different files, from group sizes."""
    g = table(spark, d, "claim_refs").select("claim_id", "doc_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n"))
    return g.agg((F.sum("n") * (F.sum("n") - 1) / 2 - F.sum(F.col("n") * (F.col("n") - 1) / 2)).cast("long").alias("cross_document_pairs"))


@query("""
WITH f AS (SELECT DISTINCT finding_id, score, lower(trim(relation)) = 'duplicate' ok FROM findings WHERE score IS NOT NULL AND relation IS NOT NULL),
o AS (SELECT ok, row_number() OVER (ORDER BY score DESC, finding_id) r FROM f)
SELECT b.b AS budget, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 9) AS "precision" FROM o JOIN (SELECT unnest([10, 25, 50, 100, 200]) b) b ON o.r <= b.b GROUP BY 1""")
def precision_at_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Precision of the first rows by score, at each budget."""
    f = table(spark, d, "findings").where("score is not null and relation is not null").select("finding_id", "score", (F.lower(F.trim("relation")) == "duplicate").alias("ok")).distinct()
    return boards.precision_curve(f, [F.desc("score"), F.asc("finding_id")], "ok", [10, 25, 50, 100, 200])


@query("""
WITH r AS (SELECT tier, lower(trim(relation)) rel, count(*) n FROM (SELECT DISTINCT finding_id, tier, relation FROM findings) WHERE relation IS NOT NULL GROUP BY GROUPING SETS ((tier, lower(trim(relation))), (lower(trim(relation))), ()))
SELECT * FROM r""")
def relation_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts by tier and relation, by relation, and overall."""
    f = table(spark, d, "findings").where("relation is not null").select("finding_id", "tier", "relation").distinct().select("tier", F.lower(F.trim("relation")).alias("rel"))
    return f.groupingSets([["tier", "rel"], ["rel"], []], "tier", "rel").agg(F.count("*").alias("n"))
