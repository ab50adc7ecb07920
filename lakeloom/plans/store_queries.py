"""Queries of stores, imports, chunk hierarchies, retrieval lanes and planning figures, with the SQL each must agree with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, ranking, resampling, spans
from ..sources import bundles
from ..staging import shared_dir
from ..tables import table
from .corpus_queries import SQL, _COLLAPSED, _tok, fixed_chunks, query
from .graph_queries import _CLUSTERS, file_clusters
from .statistics_queries import _HASH, _POISSON, sign_tests


def _base(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"


@query(SQL["fixed_chunks"])
def stored_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks published as a store and read again from its newest generation."""
    base, chunks = _base(spark), fixed_chunks(spark, d)
    bundles.publish({"chunks": chunks.limit(0)}, base, {"tokenizer": 1})
    bundles.publish({"chunks": chunks}, base, {"tokenizer": 2})
    return bundles.load(spark, base, {"tokenizer": 2})["chunks"]


@query("""
WITH e AS (SELECT DISTINCT a.doc_id u, b.doc_id v, lower(trim(relation)) relation FROM findings WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL), n AS (SELECT u node FROM e UNION SELECT v FROM e)
SELECT node, count(*) FILTER (e.u = node) AS outgoing, count(*) FILTER (e.v = node) AS incoming FROM n JOIN e ON e.u = node OR e.v = node GROUP BY node""")
def stored_graph(spark: SparkSession, d: str) -> DataFrame:
    """Degrees in a graph saved and loaded."""
    e = table(spark, d, "findings").select(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v"), F.lower(F.trim("relation")).alias("relation")).where("u is not null and v is not null").distinct()
    base = _base(spark)
    bundles.publish({"edges": e, "nodes": e.select(F.col("u").alias("node")).union(e.select("v")).distinct()}, base)
    g = bundles.load(spark, base)
    ends = g["edges"].select(F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(g["edges"].select("v", F.lit(0), F.lit(1)))
    return g["nodes"].join(ends, "node").groupBy("node").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""")
def folded_events(spark: SparkSession, d: str) -> DataFrame:
    """The last state of every key of an event log written and read again."""
    path = f"{_base(spark)}/log"
    rows = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "event_id", "event_type")
    bundles.append_events(rows.where("event_type <> 'error'"), path)
    bundles.append_events(rows.where("event_type = 'error'"), path)
    log = spark.read.schema("user_id long, at string, event_id long, event_type string").json(path)
    return bundles.fold_events(log, "user_id", ["at", "event_id"]).select("user_id", "event_type", "event_id")


@query("""
WITH d AS (SELECT DISTINCT id, question, reference_answer a, quote c, source_doc_id doc FROM grounded_drafts WHERE quote IS NOT NULL)
SELECT id, 'uk' AS lang, question, a AS reference_answer, doc AS source_doc_id, instr(c, a) - 1 AS char_start, instr(c, a) - 1 + length(a) AS char_end, 'public-reused' AS provenance FROM d WHERE length(a) > 0 AND instr(c, a) > 0""")
def imported_items(spark: SparkSession, d: str) -> DataFrame:
    """Drafts as SQuAD records and back as gold items; places are found where the record's are wrong."""
    rows = table(spark, d, "grounded_drafts").where("quote is not null").select("id", "question", "reference_answer", "quote", "source_doc_id").distinct()
    qa = F.struct("id", "question", F.array(F.struct(F.lit("").alias("text"), F.lit(0).alias("answer_start")), F.struct(F.col("reference_answer").alias("text"), F.lit(100000).alias("answer_start"))).alias("answers"))
    records = rows.select(F.col("source_doc_id").alias("title"), F.array(F.struct(F.col("quote").alias("context"), F.array(qa).alias("qas"))).alias("paragraphs"))
    return bundles.squad_items(records).withColumn("char_start", F.col("char_start").cast("long")).withColumn("char_end", F.col("char_end").cast("long"))


@query("""
WITH m AS (SELECT doc_id, regexp_extract(doc_id, '[^/]+$', 0) base FROM corpus_manifest), b AS (SELECT base, min(doc_id) doc FROM m GROUP BY 1),
q AS (SELECT DISTINCT id, CASE WHEN length(question) % 2 = 0 THEN source_doc_id ELSE 'gone' END k, regexp_extract(source_doc_id, '[^/]+$', 0) u FROM grounded_drafts)
SELECT id, coalesce(m.doc_id, b.doc) AS doc FROM q LEFT JOIN m ON m.doc_id = k LEFT JOIN b ON b.base = u""")
def mapped_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources found by their id, else by the last part of their path."""
    base = lambda c: F.regexp_extract(c, "[^/]+$", 0)
    m = table(spark, d, "corpus_manifest").select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("id_key"), base("doc_id").alias("path_key"))
    rows = table(spark, d, "grounded_drafts").select("id", F.when(F.length("question") % 2 == 0, F.col("source_doc_id")).otherwise("gone").alias("k"), base("source_doc_id").alias("u")).distinct()
    return bundles.map_sources(rows, ["k", "u"], m, ["id_key", "path_key"], "doc").select("id", "doc")


@query("""
WITH p AS (SELECT doc_id, n, i * 800 ps, least(i * 800 + 800, n) pe, i pn FROM (SELECT doc_id, length(text) n, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 800) / 800.0) AS BIGINT), 0))) i FROM documents WHERE length(text) > 0)),
c AS (SELECT *, unnest(generate_series(0, greatest(CAST(ceil((pe - ps - 200) / 160.0) AS BIGINT), 0))) j FROM p)
SELECT doc_id, pn AS parent_no, j AS child_no, ps + j * 160 AS char_start, least(ps + j * 160 + 200, pe) AS char_end FROM c""")
def child_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Parents cut again into children, in places of the document."""
    p = table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.posexplode(T.fixed_spans(F.col("text"), 800, 0)).alias("parent_no", "p"))
    c = p.select("doc_id", "parent_no", "p", F.posexplode(T.window_spans(F.col("p.end") - F.col("p.start"), 200, 40)).alias("child_no", "c"))
    return c.select("doc_id", F.col("parent_no").cast("long").alias("parent_no"), F.col("child_no").cast("long").alias("child_no"), (F.col("p.start") + F.col("c.start")).cast("long").alias("char_start"), (F.col("p.start") + F.col("c.end")).cast("long").alias("char_end"))


@query("""
WITH t AS (SELECT label doc, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 i, embedding e FROM embeddings), k AS (SELECT doc, i * 10 s, i * 10 + 10 x, e, vec_id FROM t),
w AS (SELECT doc, unnest(generate_series(0, (max(x) - 1) // 35)) w FROM k GROUP BY doc), j AS (SELECT w.doc, w.w, k.e FROM w JOIN k ON k.doc = w.doc AND k.s < w.w * 35 + 35 AND w.w * 35 < k.x),
a AS (SELECT doc, w, p, avg(CAST(v AS DOUBLE)) v FROM (SELECT doc, w, unnest(e) v, generate_subscripts(e, 1) p FROM j) GROUP BY ALL), n AS (SELECT doc, w, sqrt(sum(v * v)) n FROM a GROUP BY ALL)
SELECT doc, w AS span_no, p AS dimension, round(v / n, 4) AS value FROM a JOIN n USING (doc, w) WHERE p <= 3""")
def pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of spans as the mean of those of the tokens they overlap, of length one; the first three dimensions."""
    i = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    k = table(spark, d, "embeddings").select(F.col("label").alias("doc"), (i * 10).alias("start"), (i * 10 + 10).alias("end"), F.col("embedding").alias("v"))
    w = k.groupBy("doc").agg(F.max("end").alias("n")).select("doc", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / 35).cast("int"))).alias("span_no"))
    s = w.select("doc", "span_no", (F.col("span_no") * 35).alias("start"), (F.col("span_no") * 35 + 35).alias("end"))
    out = spans.pooled(k, s, ["doc"], "span_no", "v").where("dimension <= 3")
    return out.select("doc", F.col("span_no").cast("long").alias("span_no"), F.col("dimension").cast("long").alias("dimension"), F.round("value", 4).alias("value"))


@query("""
WITH f AS (SELECT DISTINCT finding_id, tier, score, length(evidence) s FROM findings WHERE score IS NOT NULL AND tier IS NOT NULL), p AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, finding_id) pool FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY coalesce(s, -1) DESC, pool) r FROM p WHERE pool <= 20)
SELECT tier, finding_id, pool AS pre_rank, r AS rank FROM r WHERE r <= 5""")
def reranked_hits(spark: SparkSession, d: str) -> DataFrame:
    """The best five of a pool of twenty by another score; equals keep their order."""
    f = table(spark, d, "findings").where("score is not null and tier is not null").select("finding_id", "tier", "score", F.length("evidence").alias("s")).distinct()
    pool = ranking.top_k(f, ["tier"], [F.desc("score"), F.asc("finding_id")], 20)
    return ranking.rerank(pool, ["tier"], F.coalesce("s", F.lit(-1)), 5).select("tier", "finding_id", F.col("pre_rank").cast("long").alias("pre_rank"), F.col("rank").cast("long").alias("rank"))


@query("""
WITH f AS (SELECT DISTINCT finding_id, a.char_start s, a.char_end e, b.char_start t, b.char_end g FROM findings WHERE a.doc_id = b.doc_id AND a.char_end > a.char_start AND b.char_end > b.char_start)
SELECT finding_id, round(greatest(least(e, g) - greatest(s, t), 0) / least(e - s, g - t), 9) AS ratio FROM f""")
def overlap_ratios(spark: SparkSession, d: str) -> DataFrame:
    """What two spans of one file share, of the shorter one."""
    f = table(spark, d, "findings").where("a.doc_id = b.doc_id and a.char_end > a.char_start and b.char_end > b.char_start").select("finding_id", F.col("a.char_start").alias("s"), F.col("a.char_end").alias("e"), F.col("b.char_start").alias("t"), F.col("b.char_end").alias("g")).distinct()
    return f.select("finding_id", F.round(spans.overlap_ratio(F.col("s"), F.col("e"), F.col("t"), F.col("g")), 9).alias("ratio"))


@query(f"""
WITH c AS ({_CLUSTERS}), e AS (SELECT DISTINCT a.doc_id x, b.doc_id y, lower(trim(relation)) rel FROM findings WHERE relation IS NOT NULL)
SELECT DISTINCT p.cluster_id AS x, q.cluster_id AS y, rel FROM e JOIN c p ON p.doc_id = x JOIN c q ON q.doc_id = y""")
def merged_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between clusters in place of files; loops stay, repeats go."""
    e = table(spark, d, "findings").where("relation is not null").select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"), F.lower(F.trim("relation")).alias("rel")).distinct()
    return graph.remapped(e, "x", "y", file_clusters(spark, d), "doc_id", "cluster_id")


@query(f"""
WITH d AS (SELECT DISTINCT id, question, reference_answer a, {_COLLAPSED.format("question")} q, {_COLLAPSED.format("coalesce(reference_answer, '')")} r, len({_tok("question")}) w FROM grounded_drafts),
k AS (SELECT *, CASE WHEN q = '' THEN 'no_question' WHEN r = '' THEN 'no_answer' WHEN length(question) < 20 OR w < 4 THEN 'vague' WHEN contains(q, r) THEN 'circular' END bad FROM d),
n AS (SELECT *, CASE WHEN bad IS NULL THEN row_number() OVER (PARTITION BY bad IS NULL, q ORDER BY id) END n FROM k)
SELECT coalesce(bad, CASE WHEN n > 1 THEN 'repeated' ELSE 'kept' END) AS reason, count(*) AS n FROM n GROUP BY 1""")
def curation_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why rows are kept or not: the first reason that applies; a row with another fault doesn't stand for its question."""
    rows = table(spark, d, "grounded_drafts").select("id", "question", "reference_answer").distinct()
    rows = rows.withColumn("q", T.collapsed(F.col("question"))).withColumn("r", T.collapsed(F.coalesce("reference_answer", F.lit("")))).withColumn("w", F.size(T.tokens(F.col("question"))))
    bad = F.when(F.col("q") == "", "no_question").when(F.col("r") == "", "no_answer").when((F.length("question") < 20) | (F.col("w") < 4), "vague").when(F.col("q").contains(F.col("r")), "circular")
    marked = rows.withColumn("bad", bad)
    n = F.row_number().over(Window.partitionBy(F.col("bad").isNull(), "q").orderBy("id"))
    return marked.withColumn("n", n).select(F.coalesce("bad", F.when(F.col("n") > 1, "repeated").otherwise("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""
WITH t AS (SELECT claim_id, unnest({_tok("text")}) t FROM (SELECT DISTINCT claim_id, text FROM claim_refs WHERE text IS NOT NULL)), n AS (SELECT claim_id, t, count(*) n FROM t GROUP BY ALL)
SELECT claim_id, count(*) AS terms, string_agg(t || ':' || n, ' ' ORDER BY t) AS postings FROM n GROUP BY claim_id""")
def inverted_postings(spark: SparkSession, d: str) -> DataFrame:
    """Terms of a chunk with their counts."""
    t = table(spark, d, "claim_refs").where("text is not null").select("claim_id", "text").distinct().select("claim_id", F.explode(T.tokens(F.col("text"))).alias("t"))
    n = t.groupBy("claim_id", "t").agg(F.count("*").alias("n"))
    return n.groupBy("claim_id").agg(F.count("*").alias("terms"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("t", "n"))), lambda x: F.concat(x["t"], F.lit(":"), x["n"].cast("string")))).alias("postings"))


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) l FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(l) t, generate_subscripts(l, 1) i FROM l),
o AS (SELECT doc_id, t, i, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(t) - 1 place FROM e), h AS (SELECT doc_id, i - 1 n, place FROM o WHERE regexp_matches(t, '^#{1,6} ')),
c AS (SELECT doc_id, length(text) n, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 800) / 800.0) AS BIGINT), 0))) i FROM documents WHERE length(text) > 0)
SELECT c.doc_id, c.i AS chunk_no, max(h.n) AS heading_line FROM c LEFT JOIN h ON h.doc_id = c.doc_id AND h.place <= c.i * 800 GROUP BY ALL""")
def chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    """The heading that each chunk stands under, or null before the first."""
    docs = table(spark, d, "documents").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(T.line_starts(F.col("text"))).alias("n", "l")).where(F.col("l.line").rlike("^#{1,6} "))
    heads = lines.select("doc_id", F.col("l.start").cast("long").alias("at"), F.col("n").cast("long").alias("heading_line"))
    chunks = docs.select("doc_id", F.posexplode(T.fixed_spans(F.col("text"), 800, 0)).alias("chunk_no", "c")).select("doc_id", F.col("c.start").cast("long").alias("at"), F.col("chunk_no").cast("long").alias("chunk_no"))
    both = chunks.select("doc_id", "at", F.lit(1).alias("side"), "chunk_no", F.lit(None).cast("long").alias("heading_line")).union(heads.select("doc_id", "at", F.lit(0), F.lit(None).cast("long"), "heading_line"))
    last = F.last("heading_line", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("heading_line", last).where("side = 1").select("doc_id", "chunk_no", "heading_line")


@query(f"""
WITH s AS ({SQL["sign_tests"]})
SELECT question_type, CASE WHEN wins + losses < 6 THEN 'insufficient_evidence' WHEN p <= 0.05 AND wins > losses THEN 'better' WHEN p <= 0.05 THEN 'worse' ELSE 'flat' END AS reading FROM s""")
def gated_readings(spark: SparkSession, d: str) -> DataFrame:
    """What a comparison says, if enough pairs differ for it to say anything."""
    few = F.col("wins") + F.col("losses") < 6
    return sign_tests(spark, d).select("question_type", F.when(few, "insufficient_evidence").when((F.col("p") <= 0.05) & (F.col("wins") > F.col("losses")), "better").when(F.col("p") <= 0.05, "worse").otherwise("flat").alias("reading"))


@query("""
WITH s AS (SELECT source, count(*) n FROM documents WHERE source IS NOT NULL GROUP BY 1), k AS (SELECT *, 1.959963984540054 * 1.959963984540054 * 0.25 / (0.05 * 0.05) n0 FROM s)
SELECT source, n, CAST(ceil(n0 / (1 + (n0 - 1) / n) - 1e-9) AS BIGINT) AS sample, round(1.959963984540054 * 0.5 / sqrt(n), 9) AS resolvable FROM k""")
def sample_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows to check for a share within five points, with the finite population counted in."""
    n0 = 1.959963984540054**2 * 0.25 / 0.05**2
    s = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    return s.select("source", "n", F.ceil(F.lit(n0) / (1 + (n0 - 1) / F.col("n")) - 1e-9).alias("sample"), F.round(1.959963984540054 * 0.5 / F.sqrt("n"), 9).alias("resolvable"))


@query("""
WITH m AS (SELECT (year(ts) * 12 + month(ts) - 1) - min(year(ts) * 12 + month(ts) - 1) OVER () o, value > 50 y FROM events), s AS (SELECT o, count(*) n, count(*) FILTER (y) k FROM m GROUP BY o),
g AS (SELECT c.c, p.p, w.w FROM (SELECT unnest([0.6, 0.7, 0.8, 0.9]) c) c, (SELECT unnest([0, 3, 6, 12, 24]) p) p, (SELECT unnest([1.0, 3.0, 6.0]) w) w),
l AS (SELECT c, p, w, -sum(k * ln(greatest(0.25 + (c - 0.25) / (1 + exp((o - p) / w)), 1e-9)) + (n - k) * ln(greatest(1 - (0.25 + (c - 0.25) / (1 + exp((o - p) / w))), 1e-9))) loss FROM s, g GROUP BY ALL)
SELECT CAST(c AS DOUBLE) AS ceiling, p AS midpoint, CAST(w AS DOUBLE) AS scale, round(loss, 6) AS loss FROM l ORDER BY round(loss, 6), c, p, w LIMIT 1""")
def fitted_decay(spark: SparkSession, d: str) -> DataFrame:
    """The logistic decay over months that fits best on a grid, by log loss of grouped counts."""
    m = table(spark, d, "events").groupBy((F.year("ts") * 12 + F.month("ts") - 1).alias("o")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("k"))
    s = m.withColumn("o", F.col("o") - F.min("o").over(Window.partitionBy()))  # one row a month
    grid = [(c, p, w) for c in (0.6, 0.7, 0.8, 0.9) for p in (0, 3, 6, 12, 24) for w in (1.0, 3.0, 6.0)]
    g = F.broadcast(spark.createDataFrame(grid, "ceiling double, midpoint int, scale double"))
    y = 0.25 + (F.col("ceiling") - 0.25) / (1 + F.exp((F.col("o") - F.col("midpoint")) / F.col("scale")))
    loss = -F.sum(F.col("k") * F.log(F.greatest(y, F.lit(1e-9))) + (F.col("n") - F.col("k")) * F.log(F.greatest(1 - y, F.lit(1e-9))))
    return s.join(g).groupBy("ceiling", "midpoint", "scale").agg(F.round(loss, 6).alias("loss")).orderBy("loss", "ceiling", "midpoint", "scale").limit(1)


def _times(key: str, side: str) -> str:
    return f"len(list_filter({_POISSON}, lambda s: ({_HASH.format(f"'{side}-' || x.range || '-' || {key}")} + 0.5) / 4294967296.0 > s))"


@query(f"""
WITH f AS (SELECT DISTINCT finding_id, a.doc_id l, b.doc_id r, lower(trim(relation)) = 'duplicate' y FROM findings WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND relation IS NOT NULL),
w AS (SELECT x.range replicate, y, {_times("l", "l")} * {_times("r", "r")} t FROM f, range(50) x)
SELECT replicate, round(sum(CASE WHEN y THEN t ELSE 0 END) / sum(t), 6) AS share FROM w GROUP BY replicate HAVING sum(t) > 0""")
def two_way_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """A share resampled by both sides of its pairs at once: a pair counts the product of its sides' counts."""
    f = table(spark, d, "findings").where("a.doc_id is not null and b.doc_id is not null and relation is not null").select("finding_id", F.col("a.doc_id").alias("l"), F.col("b.doc_id").alias("r"), (F.lower(F.trim("relation")) == "duplicate").alias("y")).distinct()
    return resampling.two_way_shares(f, "l", "r", "y", 50)


@query("""
SELECT tier, count(*) AS n, round(sum(CASE WHEN lower(trim(relation)) <> 'duplicate' THEN score ELSE 0 END) / sum(score), 9) AS reject_rate FROM (SELECT DISTINCT finding_id, tier, score, relation FROM findings WHERE score IS NOT NULL AND relation IS NOT NULL) GROUP BY tier""")
def weighted_rejects(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings").where("score is not null and relation is not null").select("finding_id", "tier", "score", "relation").distinct()
    return f.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.lower(F.trim("relation")) != "duplicate", F.col("score")).otherwise(0.0)) / F.sum("score"), 9).alias("reject_rate"))


@query("""
SELECT DISTINCT claim_id, substr(text, greatest(11 - 5, 1), least(length(text), 20 + 5) - greatest(11 - 5, 1) + 1) AS near FROM claim_refs WHERE length(text) >= 20""")
def context_windows(spark: SparkSession, d: str) -> DataFrame:
    """The text around a span, clamped to the text."""
    return table(spark, d, "claim_refs").where("length(text) >= 20").select("claim_id", T.around(F.col("text"), F.lit(10), F.lit(20), 5).alias("near")).distinct()


@query("""
WITH p AS (SELECT page_id, any_value(replace(text, chr(13), '')) t FROM pdf_pages WHERE text IS NOT NULL GROUP BY page_id), s AS (SELECT page_id, list_filter(string_split_regex(t, '\\n[ \\t]*\\n[\\s]*'), lambda x: trim(x, ' ' || chr(9) || chr(10)) <> '') s FROM p)
SELECT page_id, generate_subscripts(s, 1) - 1 AS paragraph_no, length(trim(unnest(s), ' ' || chr(9) || chr(10))) AS n_chars FROM s""")
def page_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pdf_pages").where("text is not null").groupBy("page_id").agg(F.first(F.replace("text", F.lit("\r"), F.lit(""))).alias("t"))
    return p.select("page_id", F.posexplode(T.paragraphs(F.col("t"))).alias("n", "p")).select("page_id", F.col("n").cast("long").alias("paragraph_no"), F.length("p").cast("long").alias("n_chars"))
