"""Queries of clusters, linkage, findings, coverage and duplicates, with the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clustering, dedup, findings, linkage, ranking, spans
from ..tables import table
from .corpus_queries import _DATE, _tok, query

_FILES = "SELECT DISTINCT a.doc_id x, b.doc_id y FROM findings WHERE score >= 0.8 AND a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.doc_id <> b.doc_id"
_CLUSTERS = f"""
WITH RECURSIVE e AS ({_FILES}), w AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(u, v) AS (SELECT x, y FROM w UNION SELECT r.u, w.y FROM r JOIN w ON r.v = w.x)
SELECT m.doc_id, coalesce(least(m.doc_id, min(r.v)), m.doc_id) AS cluster_id FROM corpus_manifest m LEFT JOIN r ON r.u = m.doc_id GROUP BY m.doc_id"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "findings").where("score >= 0.8").select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"))


@query(_CLUSTERS)
def file_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Files linked by findings above a score, directly or through others; all other files alone."""
    return clustering.clusters(table(spark, d, "corpus_manifest"), "doc_id", _links(spark, d), "x", "y")


@query(f"""
WITH c AS ({_CLUSTERS}), m AS (SELECT c.cluster_id, c.doc_id, {_DATE.format("effective_date")} dt FROM c JOIN corpus_manifest USING (doc_id))
SELECT cluster_id, count(*) AS n, arg_min(doc_id, (coalesce(dt, ''), doc_id)) AS oldest, CASE WHEN max(dt) IS NOT NULL THEN arg_max(doc_id, (coalesce(dt, ''), doc_id)) END AS newest FROM m GROUP BY cluster_id HAVING count(*) > 1""")
def edition_groups(spark: SparkSession, d: str) -> DataFrame:
    dates = table(spark, d, "corpus_manifest").select("doc_id", T.iso_date(F.col("effective_date")).alias("dt"))
    return clustering.in_date_order(file_clusters(spark, d).join(dates, "doc_id"), "cluster_id", "doc_id", "dt")


_VOTE = "SELECT x AS node, label FROM (SELECT w.x, l.label, row_number() OVER (PARTITION BY w.x ORDER BY count(*) DESC, l.label) r FROM w JOIN {0} l ON l.node = w.y GROUP BY w.x, l.label) WHERE r = 1"
_LABELS = f"""
WITH e AS (SELECT DISTINCT a.doc_id x, b.doc_id y FROM findings WHERE lower(trim(relation)) = 'duplicate' AND a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.doc_id <> b.doc_id),
w AS (SELECT x, y FROM e UNION SELECT y, x FROM e), l0 AS (SELECT DISTINCT x node, x label FROM w), l1 AS ({_VOTE.format("l0")}), l2 AS ({_VOTE.format("l1")}), l3 AS ({_VOTE.format("l2")})
SELECT node, label FROM l3"""


@query(_LABELS)
def file_communities(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds of label propagation over duplicates."""
    e = table(spark, d, "findings").where("lower(trim(relation)) = 'duplicate'").select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"))
    return clustering.propagate_labels(e, "x", "y", 3)


@query(f"SELECT label, count(*) AS members, max(node) AS last_member FROM ({_LABELS}) GROUP BY label HAVING count(*) > 1")
def community_sizes(spark: SparkSession, d: str) -> DataFrame:
    return file_communities(spark, d).groupBy("label").agg(F.count("*").alias("members"), F.max("node").alias("last_member")).where("members > 1")


@query("""
WITH u AS (SELECT DISTINCT a.claim_id unit, finding_id r FROM findings WHERE a.claim_id IS NOT NULL UNION SELECT DISTINCT b.claim_id, finding_id FROM findings WHERE b.claim_id IS NOT NULL),
s AS (SELECT unit, list_sort(list(r)) m FROM u GROUP BY unit HAVING count(*) > 1)
SELECT min(unit) AS unit, CAST(len(m) AS BIGINT) AS n FROM s GROUP BY m""")
def shared_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims that several findings share, one for each set of findings."""
    f = table(spark, d, "findings")
    u = f.select(F.col("a.claim_id").alias("unit"), "finding_id").union(f.select("b.claim_id", "finding_id")).where("unit is not null")
    return clustering.shared_units(u, "unit", "finding_id")


_F = "(SELECT DISTINCT finding_id, lower(trim(relation)) rel, tier, a.doc_id x, b.doc_id y, staleness.newer_side newer FROM findings WHERE b IS NOT NULL AND relation IS NOT NULL)"


def _sides(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "findings").where("b is not null and relation is not null").select("finding_id", F.lower(F.trim("relation")).alias("rel"), "tier", F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"), F.col("staleness.newer_side").alias("newer")).distinct()


@query(f"""
SELECT finding_id, CASE WHEN rel = 'contradicts' AND newer IS NOT NULL THEN 'superseded_by' ELSE rel END AS rel, CASE WHEN rel = 'contradicts' AND newer = 'a' THEN y ELSE x END AS x, CASE WHEN rel = 'contradicts' AND newer = 'a' THEN x ELSE y END AS y FROM {_F}""")
def superseded_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings.superseded(_sides(spark, d), "rel", "x", "y", F.col("newer")).select("finding_id", "rel", "x", "y")


_RESOLVED = f"""
SELECT finding_id, p.policy, CASE WHEN rel = 'duplicate' AND coalesce(tier = 'semantic', false) THEN 'escalate' WHEN rel = 'duplicate' THEN 'drop_duplicate' WHEN rel = 'superseded_by' AND newer IN ('a', 'b') AND p.policy = 'prefer_newer' THEN 'prefer_newer'
  WHEN rel IN ('subsumes', 'subsumed_by', 'complementary') THEN 'retain' ELSE 'escalate' END AS action,
 CASE WHEN rel = 'duplicate' AND coalesce(tier = 'semantic', false) THEN NULL WHEN rel = 'duplicate' THEN CASE WHEN newer = 'a' THEN 'b' WHEN newer = 'b' THEN 'a' WHEN x > y THEN 'a' ELSE 'b' END
  WHEN rel = 'superseded_by' AND newer = 'a' THEN 'b' WHEN rel = 'superseded_by' AND newer = 'b' THEN 'a' END AS target FROM {_F}, (SELECT unnest(['prefer_newer', 'report_only']) policy) p"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    rows = _sides(spark, d)
    cols = [F.col(c) for c in ("rel", "tier", "newer", "x", "y")]
    parts = [rows.select("finding_id", F.lit(p).alias("policy"), findings.resolution(*cols, p).alias("r")) for p in findings.POLICIES]
    return parts[0].union(parts[1]).select("finding_id", "policy", "r.action", "r.target", "r.review")


@query(_RESOLVED)
def finding_actions(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).drop("review")


@query(f"SELECT policy, count(*) AS n, count(*) FILTER (action = 'escalate') AS reviews, count(*) FILTER (action = 'drop_duplicate') AS drops FROM ({_RESOLVED}) GROUP BY policy")
def policy_projection(spark: SparkSession, d: str) -> DataFrame:
    """Reviews that each policy leaves."""
    return _resolved(spark, d).groupBy("policy").agg(F.count("*").alias("n"), F.count_if("review").alias("reviews"), F.count_if(F.col("action") == "drop_duplicate").alias("drops"))


@query("""
WITH g AS (SELECT DISTINCT a.claim_id item, finding_id span_id, b.doc_id doc_id, b.char_start gs, b.char_end ge FROM findings WHERE b.char_end > b.char_start AND a.claim_id IS NOT NULL),
c AS (SELECT doc_id, char_start s, char_end e FROM (SELECT DISTINCT claim_id, doc_id, char_start, char_end, dense_rank() OVER (PARTITION BY doc_id ORDER BY claim_id) r FROM claim_refs) WHERE r <= 10 AND char_end > char_start),
h AS (SELECT DISTINCT g.item, g.span_id, greatest(s, gs) s, least(e, ge) e, s <= gs AND e >= ge whole FROM g JOIN c USING (doc_id) WHERE s < ge AND gs < e),
u AS (SELECT item, span_id, s, e, max(e) OVER (PARTITION BY item, span_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) b FROM (SELECT DISTINCT item, span_id, s, e FROM h)),
l AS (SELECT item, span_id, sum(greatest(e - greatest(s, coalesce(b, s)), 0)) chars FROM u GROUP BY ALL), wh AS (SELECT item, span_id, max(whole) whole FROM h GROUP BY ALL),
p AS (SELECT g.*, l.chars, wh.whole FROM g LEFT JOIN l USING (item, span_id) LEFT JOIN wh USING (item, span_id))
SELECT item, count(*) AS n_spans, count(*) FILTER (chars IS NOT NULL) AS covered, round(avg(CASE WHEN chars IS NOT NULL THEN 1.0 ELSE 0 END), 9) AS coverage, bool_and(chars IS NOT NULL) AS all_covered,
 round(avg(coalesce(chars, 0) / (ge - gs)), 9) AS char_coverage, round(avg(CASE WHEN whole THEN 1.0 ELSE 0 END), 9) AS intact FROM p GROUP BY item""")
def span_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How the first ten claims of a file hold the spans that findings point at."""
    gold = table(spark, d, "findings").where("a.claim_id is not null").select(F.col("a.claim_id").alias("item"), F.col("finding_id").alias("span_id"), "b.doc_id", "b.char_start", "b.char_end").distinct()
    claims = table(spark, d, "claim_refs").select("claim_id", "doc_id", "char_start", "char_end").distinct()
    first = ranking.top_k(claims, ["doc_id"], [F.asc("claim_id")], 10).drop("claim_id")
    return spans.coverage_at_k(gold, gold.select("item", "doc_id").distinct().join(first, "doc_id"), 10)


@query("""
WITH r AS (SELECT DISTINCT finding_id, tier, a.doc_id parent, score FROM findings WHERE score IS NOT NULL AND a.doc_id IS NOT NULL AND tier IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, finding_id) r FROM r), b AS (SELECT tier, parent, min(r) r FROM k GROUP BY ALL)
SELECT tier, parent, row_number() OVER (PARTITION BY tier ORDER BY r) AS rank FROM b""")
def parents_of_hits(spark: SparkSession, d: str) -> DataFrame:
    """Files in the order of their best finding."""
    f = table(spark, d, "findings").where("score is not null and a.doc_id is not null and tier is not null").select("finding_id", "tier", F.col("a.doc_id").alias("parent"), "score").distinct()
    ranked = ranking.top_k(f, ["tier"], [F.desc("score"), F.asc("finding_id")], 1 << 30)
    return clustering.first_of_ranked(ranked.withColumnRenamed("rank", "r"), "tier", "parent", "r").select("tier", "parent", F.col("rank").cast("long").alias("rank"))


@query("""
WITH p AS (SELECT page_id, any_value(length(text)) n, any_value(blocks) b FROM pdf_pages WHERE length(text) > 0 GROUP BY page_id),
i AS (SELECT page_id, n, greatest(x.char_start, 0) s, least(x.char_end, n) e FROM (SELECT page_id, n, unnest(b) x FROM p)),
c AS (SELECT *, coalesce(max(e) OVER (PARTITION BY page_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) c FROM i), k AS (SELECT *, greatest(s, c) s2 FROM c),
r AS (SELECT page_id, s2 s, e FROM k WHERE e > s2 UNION ALL SELECT page_id, c, s2 FROM k WHERE e > s2 AND s2 > c UNION ALL SELECT p.page_id, coalesce(m, 0), n FROM p LEFT JOIN (SELECT page_id, max(e) m FROM k GROUP BY 1) USING (page_id) WHERE n > coalesce(m, 0)),
w AS (SELECT page_id, s, e, unnest(generate_series(0, greatest(CAST(ceil((e - s - 800) / 680.0) AS BIGINT), 0))) i FROM r)
SELECT page_id, s + i * 680 AS char_start, least(s + i * 680 + 800, e) AS char_end FROM w""")
def page_aligned_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows that never cross the edge of a block of the page."""
    pages = table(spark, d, "pdf_pages").where("length(text) > 0").groupBy("page_id").agg(F.first(F.length("text")).alias("length"), F.first("blocks").alias("blocks"))
    inner = pages.select("page_id", F.explode("blocks").alias("b")).select("page_id", F.col("b.char_start").alias("start"), F.col("b.char_end").alias("end"))
    r = spans.regions(inner, pages.select("page_id", "length"), "page_id")
    w = r.select("page_id", "start", F.explode(T.window_spans(F.col("end") - F.col("start"), 800, 120)).alias("w"))
    return w.select("page_id", (F.col("start") + F.col("w.start")).cast("long").alias("char_start"), (F.col("start") + F.col("w.end")).cast("long").alias("char_end"))


@query("""
WITH p AS (SELECT page_id, any_value(length(text)) n, any_value(blocks) b FROM pdf_pages WHERE length(text) > 0 GROUP BY page_id),
w AS (SELECT page_id, b, n, unnest(generate_series(0, greatest(CAST(ceil((n - 400) / 400.0) AS BIGINT), 0))) i FROM p)
SELECT page_id, i AS chunk_no, list_sort(list_distinct(list_transform(list_filter(b, lambda x: x.char_start < least(i * 400 + 400, n) AND i * 400 < x.char_end), lambda x: x.kind))) AS kinds FROM w""")
def chunk_block_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of the blocks that a chunk of a page overlaps."""
    pages = table(spark, d, "pdf_pages").where("length(text) > 0").groupBy("page_id").agg(F.first(F.length("text")).alias("n"), F.first("blocks").alias("b"))
    w = pages.select("page_id", "b", F.posexplode(T.window_spans(F.col("n"), 400, 0)).alias("chunk_no", "w"))
    kinds = F.transform(F.filter("b", lambda x: (x["char_start"] < F.col("w.end")) & (F.col("w.start") < x["char_end"])), lambda x: x["kind"])
    return w.select("page_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.array_sort(F.array_distinct(kinds)).alias("kinds"))


def _editions(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("doc_id"), F.lit("[a-z]+"), F.lit(0)))
    return table(spark, d, "corpus_manifest").select("doc_id", "source_system", "language", "version", F.when(F.col("effective_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("effective_date")).alias("dt"), words.alias("w"))


#: Columns and thresholds of a comparison.
_COMPARED = ("doc_id", "source_system", "language", "version", "dt", "w", 0.9, 0.7, [30, 365])


@query("""
WITH m AS (SELECT doc_id, source_system, language, version, effective_date dt, regexp_extract_all(lower(doc_id), '[a-z]+') w FROM corpus_manifest),
p AS (SELECT a.doc_id l, b.doc_id r, a.language la, b.language lb, a.version va, b.version vb, a.w wa, b.w wb,
 CASE WHEN regexp_matches(a.dt, '^\\d{4}-\\d{2}-\\d{2}$') THEN a.dt END da, CASE WHEN regexp_matches(b.dt, '^\\d{4}-\\d{2}-\\d{2}$') THEN b.dt END db FROM m a JOIN m b ON a.source_system = b.source_system AND a.doc_id < b.doc_id),
q AS (SELECT *, len(list_intersect(list_distinct(wa), list_distinct(wb))) i, len(list_distinct(wa)) x, len(list_distinct(wb)) y FROM p)
SELECT l AS left_id, r AS right_id, CASE WHEN la IS NULL OR lb IS NULL THEN -1 WHEN la = lb THEN 1 ELSE 0 END AS language,
 CASE WHEN va IS NULL OR vb IS NULL THEN -1 WHEN va = vb THEN 2 WHEN levenshtein(va, vb) <= 1 THEN 1 ELSE 0 END AS version,
 CASE WHEN da IS NULL OR db IS NULL THEN -1 WHEN abs(date_diff('day', CAST(da AS DATE), CAST(db AS DATE))) <= 30 THEN 2 WHEN abs(date_diff('day', CAST(da AS DATE), CAST(db AS DATE))) <= 365 THEN 1 ELSE 0 END AS dated,
 CASE WHEN i >= 0.9 * (x + y - i) THEN 2 WHEN i >= 0.7 * least(x, y) THEN 1 ELSE 0 END AS name FROM q""")
def agreement_levels(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of files of one source system, and how well their fields agree."""
    return linkage.compared_pairs(_editions(spark, d), *_COMPARED)


_FIELDS = ["language", "version", "dated", "name"]


def agreement_patterns(spark: SparkSession, d: str) -> DataFrame:
    """What ``linkage.patterns`` has of ``agreement_levels``, without its pairs."""
    return linkage.counted_patterns(_editions(spark, d), *_COMPARED)


_MODEL = {"language": {0: (0.1, 0.5), 1: (0.9, 0.5)}, "version": {0: (0.2, 0.9), 1: (0.1, 0.05), 2: (0.7, 0.05)}, "dated": {0: (0.3, 0.8), 1: (0.3, 0.15), 2: (0.4, 0.05)}, "name": {0: (0.2, 0.7), 1: (0.3, 0.2), 2: (0.5, 0.1)}}


def _weights() -> str:
    return " + ".join("CASE " + " ".join(f"WHEN {f} = {k} THEN log2({m} / {u})" for k, (m, u) in r.items()) + " ELSE 0 END" for f, r in _MODEL.items())


def _levels_sql() -> str:
    from .corpus_queries import SQL  # noqa: PLC0415

    return SQL["agreement_levels"]


@query(f"SELECT language, version, dated, name, count(*) AS n FROM ({_levels_sql()}) GROUP BY ALL")
def agreement_histogram(spark: SparkSession, d: str) -> DataFrame:
    return agreement_patterns(spark, d)


@query(f"SELECT left_id, right_id, round(log2(0.01 / 0.99) + {_weights()}, 6) AS match_weight FROM ({_levels_sql()})")
def replayed_linkage(spark: SparkSession, d: str) -> DataFrame:
    """Pairs weighed anew by a saved model."""
    return linkage.compared_pairs(_editions(spark, d), *_COMPARED, linkage.pattern_weights(_MODEL, [1, 2, 2, 2], 0.01))


@query("""
WITH f AS (SELECT DISTINCT finding_id, round(score, 1) t, lower(trim(relation)) = 'duplicate' ok FROM findings WHERE score IS NOT NULL AND relation IS NOT NULL),
c AS (SELECT t, CAST(count(*) FILTER (ok) AS DOUBLE) p, count(*) n FROM f GROUP BY t),
r AS (SELECT t, sum(p) OVER (ORDER BY t DESC) tp, sum(n) OVER (ORDER BY t DESC) al, sum(p) OVER () ap, sum(n) OVER () an FROM c)
SELECT t AS threshold, CAST(tp AS BIGINT) AS tp, CAST(al - tp AS BIGINT) AS fp, CAST(an - ap - (al - tp) AS BIGINT) AS tn, CAST(ap - tp AS BIGINT) AS fn, round(tp / al, 9) AS precision, round(tp / ap, 9) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / al) * (tp / ap) / (tp / al + tp / ap) ELSE 0 END, 9) AS f1 FROM r""")
def label_accuracy(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings").where("score is not null and relation is not null").select("finding_id", F.round("score", 1).alias("t"), (F.lower(F.trim("relation")) == "duplicate").alias("ok")).distinct()
    return linkage.accuracy_curve(f, F.col("ok"), "t")


@query("SELECT DISTINCT claim_id, doc_id, char_start, sha256(text) AS key FROM claim_refs WHERE text IS NOT NULL")
def expanded_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims collapsed by text and expanded again: what went in comes out."""
    claims = table(spark, d, "claim_refs").select("claim_id", "doc_id", "char_start", "text").distinct()
    c = dedup.collapse(claims, "text", "exact", F.col("claim_id"), F.struct("claim_id", "doc_id", "char_start"))
    return dedup.expand(c).select("claim_id", "doc_id", "char_start", "key")


@query("SELECT claim_id, epoch_us(max(ingested_at)) AS arrived, arg_max(chunk_id, (ingested_at)) AS chunk_id FROM (SELECT DISTINCT claim_id, ingested_at, coalesce(chunk_id, '') chunk_id FROM claim_refs) GROUP BY claim_id")
def last_claims(spark: SparkSession, d: str) -> DataFrame:
    """The last arrival of every claim."""
    rows = table(spark, d, "claim_refs").select("claim_id", "ingested_at", F.coalesce("chunk_id", F.lit("")).alias("chunk_id")).distinct()
    return dedup.last_arrivals(rows, ["claim_id"], ["ingested_at"]).select("claim_id", F.unix_micros("ingested_at").alias("arrived"), "chunk_id")


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) e FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.e, b.e), 6) >= 0.5""")
def near_vectors(spark: SparkSession, d: str) -> DataFrame:
    return ranking.pairs_above(table(spark, d, "embeddings"), "vec_id", "embedding", 0.5)


def kept_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that are near to none kept before."""
    v = table(spark, d, "embeddings")
    return dedup.greedy_keep(v, "vec_id", ranking.pairs_above(v, "vec_id", "embedding", 0.5), "a", "b")


@query(f"""
WITH v AS (SELECT DISTINCT unnest({_tok("text")}) t FROM documents), q AS (SELECT t, count(DISTINCT id) n FROM (SELECT DISTINCT id, unnest({_tok("question")}) t FROM rag_items_uk) GROUP BY t)
SELECT t AS token, n FROM q WHERE t NOT IN (SELECT t FROM v)""")
def unknown_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of questions that the corpus lacks."""
    vocabulary = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    q = table(spark, d, "rag_items_uk").select("id", F.explode(T.tokens(F.col("question"))).alias("token")).distinct().groupBy("token").agg(F.count("*").alias("n"))
    return q.join(vocabulary, "token", "left_anti")


def corrected_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The nearest word of the corpus for each unknown one."""
    from ..operators.typos import nearest_words  # noqa: PLC0415

    vocabulary = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    return nearest_words(unknown_tokens(spark, d).select("token"), vocabulary)


from .corpus_queries import QUERIES  # noqa: E402

QUERIES.update({f.__name__: f for f in (kept_vectors, corrected_tokens)})


@query("""
WITH e AS (SELECT DISTINCT user_id, ts, event_id, event_type || ': ' || CAST(CAST(round(value) AS BIGINT) AS VARCHAR) l FROM events)
SELECT user_id, string_agg(l, chr(10) ORDER BY ts, event_id) AS log FROM e GROUP BY user_id""")
def chat_logs(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a conversation in order, as one document of lines."""
    line = F.concat_ws(": ", "event_type", F.round("value").cast("long").cast("string"))
    rows = table(spark, d, "events").select("user_id", F.struct("ts", "event_id", line.alias("l")).alias("m")).distinct()
    return rows.groupBy("user_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("m")), lambda m: m["l"])).alias("log"))
