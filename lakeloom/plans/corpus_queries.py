"""Queries over the corpus tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.chunking import chunked
from ..operators import dedup, graph, linkage, ranking, spans, stats
from ..staging import stage
from ..tables import table

QUERIES: dict = {}
SQL: dict = {}

# pieces of SQL that several oracles share
_TOK = "list_filter(list_transform(regexp_extract_all(lower(translate(coalesce({0}, ''), '’ʼ`ʹ', '''''''''')), '[\\p{{L}}\\p{{N}}_'']+'), lambda t: regexp_replace(t, '^''+|''+$', '', 'g')), lambda t: t <> '')"
_COLLAPSED = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _tok(c: str) -> str:
    return _TOK.format(c)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- chunking


@query("""
WITH c AS (SELECT doc_id, length(text) n, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 800) / 680.0) AS BIGINT), 0))) i FROM documents WHERE length(text) > 0)
SELECT doc_id, i AS chunk_no, i * 680 AS char_start, least(i * 680 + 800, n) AS char_end FROM c""")
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(T.fixed_spans(F.col("text"), 800, 120)).alias("chunk_no", "s"))
    return docs.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("s.start").cast("long").alias("char_start"), F.col("s.end").cast("long").alias("char_end"))


@query(f"""
SELECT count(*) AS n, CAST(floor(avg(char_end - char_start)) AS BIGINT) AS avg_chars, min(char_end - char_start) AS min_chars, max(char_end - char_start) AS max_chars,
  round(sum(CASE WHEN char_end - char_start > 700 THEN 1 ELSE 0 END) / count(*), 9) AS oversize_share FROM ({SQL["fixed_chunks"]})""")
def chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("char_end") - F.col("char_start")
    return fixed_chunks(spark, d).agg(F.count("*").alias("n"), F.floor(F.avg(size)).alias("avg_chars"), F.min(size).alias("min_chars"), F.max(size).alias("max_chars"), F.round(F.avg((size > 700).cast("double")), 9).alias("oversize_share"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) t, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) i FROM documents WHERE text IS NOT NULL)
SELECT doc_id, i - 1 AS line_no, length(regexp_extract(t, '^(#{1,6}) ', 1)) AS level, regexp_replace(regexp_replace(t, '^#+ ', ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS title FROM l WHERE regexp_matches(t, '^#{1,6} ')""")
def headings(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("line_no", "t"))
    return lines.where(F.col("t").rlike("^#{1,6} ")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length(F.regexp_extract("t", "^(#{1,6}) ", 1)).cast("long").alias("level"), T.bare(F.regexp_replace("t", "^#+ ", "")).alias("title"))


@query("""
SELECT doc_id, length(regexp_extract(text, '^---\\n(?:[^\\n]*\\n)*?---\\n', 0)) AS body_start FROM documents WHERE text IS NOT NULL""")
def front_matter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(F.regexp_extract("text", r"^---\n(?:[^\n]*\n)*?---\n", 0)).cast("long").alias("body_start"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) t, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) i FROM documents WHERE source = 'helpdesk_chat' AND text IS NOT NULL)
SELECT doc_id, i - 1 AS turn, regexp_extract(t, '^([^:]{1,20}): ', 1) AS speaker, length(t) - length(regexp_extract(t, '^([^:]{1,20}): ', 0)) AS n_chars FROM l WHERE regexp_matches(t, '^[^:]{1,20}: ')""")
def chat_turns(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").where("source = 'helpdesk_chat'").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("turn", "t"))
    return lines.where(F.col("t").rlike("^[^:]{1,20}: ")).select("doc_id", F.col("turn").cast("long").alias("turn"), F.regexp_extract("t", "^([^:]{1,20}): ", 1).alias("speaker"), (F.length("t") - F.length(F.regexp_extract("t", "^([^:]{1,20}): ", 0))).cast("long").alias("n_chars"))


# ---- scalar scoring


@query(f"""
WITH d AS (SELECT DISTINCT id, reference_answer, quote FROM grounded_drafts WHERE reference_answer IS NOT NULL AND quote IS NOT NULL),
a AS (SELECT id, t, count(*) n FROM (SELECT id, unnest({_tok("reference_answer")}) t FROM d) GROUP BY ALL),
q AS (SELECT id, t, count(*) n FROM (SELECT id, unnest({_tok("quote")}) t FROM d) GROUP BY ALL),
s AS (SELECT a.id, sum(least(a.n, coalesce(q.n, 0))) c, count(*) FILTER (q.n IS NULL) lacking FROM a LEFT JOIN q USING (id, t) GROUP BY a.id),
r AS (SELECT d.id, len({_tok("reference_answer")}) na, len({_tok("quote")}) nq, coalesce(c, 0) c, coalesce(lacking, 0) lacking, d.reference_answer x, d.quote y FROM d LEFT JOIN s USING (id)),
p AS (SELECT *, CASE WHEN na > 0 THEN c / na ELSE 0 END p, CASE WHEN nq > 0 THEN c / nq ELSE 0 END r FROM r)
SELECT id, round(p, 9) AS token_precision, round(r, 9) AS token_recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS token_f1,
  na > 0 AND lacking = 0 AS contained, {_COLLAPSED.format("x")} <> '' AND {_COLLAPSED.format("x")} = {_COLLAPSED.format("y")} AS exact FROM p""")
def answer_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "grounded_drafts").where("reference_answer is not null and quote is not null").select("id", "reference_answer", "quote").distinct()
    t = rows.withColumn("a", T.tokens(F.col("reference_answer"))).withColumn("q", T.tokens(F.col("quote"))).withColumn("c", T.overlap_counts(F.col("a"), F.col("q")))
    p, r = F.when(F.size("a") > 0, F.col("c") / F.size("a")).otherwise(0.0), F.when(F.size("q") > 0, F.col("c") / F.size("q")).otherwise(0.0)
    same = (T.collapsed(F.col("reference_answer")) != "") & (T.collapsed(F.col("reference_answer")) == T.collapsed(F.col("quote")))
    contained = (F.size("a") > 0) & (F.size(F.array_except("a", "q")) == 0)
    return t.select("id", F.round(p, 9).alias("token_precision"), F.round(r, 9).alias("token_recall"), F.round(T.f1(p, r), 9).alias("token_f1"), contained.alias("contained"), same.alias("exact"))


@query(f"""
SELECT DISTINCT id, regexp_matches(lower(translate(coalesce(reference_answer, ''), '’ʼ`ʹ', '''''''''')), '{T.REFUSAL.replace("'", "''")}') AS refusal,
  {_COLLAPSED.format("coalesce(reference_answer, '')")} <> '' AND contains({_COLLAPSED.format("question")}, {_COLLAPSED.format("coalesce(reference_answer, '')")}) AS circular,
  length(question) < 20 OR len({_tok("question")}) < 4 AS vague FROM grounded_drafts""")
def question_flags(spark: SparkSession, d: str) -> DataFrame:
    a = T.collapsed(F.coalesce("reference_answer", F.lit("")))
    return table(spark, d, "grounded_drafts").select(
        "id", T.is_refusal(F.col("reference_answer")).alias("refusal"), ((a != "") & T.collapsed(F.col("question")).contains(a)).alias("circular"),
        ((F.length("question") < 20) | (F.size(T.tokens(F.col("question"))) < 4)).alias("vague"),
    ).distinct()


@query("""
SELECT doc_id, CASE WHEN regexp_matches(text, '[іїєґІЇЄҐ]') THEN 'uk' WHEN regexp_matches(text, '[А-Яа-яЁё]') THEN 'uk' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' END AS detected FROM documents""")
def detected_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.language(F.col("text")).alias("detected"))


# ---- duplicates


@query(f"""
WITH r AS (SELECT doc_id, sha256(text) raw, sha256({_COLLAPSED.format("text")}) norm FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY raw) anchor FROM r),
g AS (SELECT *, min(CASE WHEN doc_id = anchor THEN doc_id END) OVER (PARTITION BY norm) norm_anchor FROM f)
SELECT doc_id AS id, anchor, 'raw' AS tier FROM g WHERE doc_id <> anchor
UNION ALL SELECT doc_id, norm_anchor, 'normalized' FROM g WHERE doc_id = anchor AND doc_id <> norm_anchor""")
def hash_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.hash_findings(table(spark, d, "documents"), "doc_id", "text")


@query(f"""
WITH s AS (SELECT DISTINCT claim_id, len({_tok("text")}) n, {_tok("text")} w FROM claim_refs WHERE text IS NOT NULL),
x AS (SELECT claim_id, list_sort(list_distinct(list_transform(generate_series(1, greatest(n - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' ')))) s FROM s WHERE n > 0),
c AS (SELECT min(claim_id) id, s FROM x GROUP BY s),
e AS (SELECT id, len(s) n, unnest(s) h FROM c),
p AS (SELECT a.id a, b.id b, a.n na, b.n nb, count(*) k FROM e a JOIN e b ON a.h = b.h AND a.id < b.id GROUP BY ALL)
SELECT a, b, round(k / (na + nb - k), 9) AS similarity FROM p WHERE k / (na + nb - k) >= 0.8""")
def shingle_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.shingle_pairs(table(spark, d, "claim_refs"), "claim_id", "text").withColumn("similarity", F.round("similarity", 9))


@query(f"""
WITH k AS (SELECT claim_id, doc_id, CASE WHEN array_to_string({_tok("text")}, ' ') = '' THEN text ELSE regexp_replace(array_to_string({_tok("text")}, ' '), '[0-9]', '#', 'g') END key FROM (SELECT DISTINCT claim_id, doc_id, text FROM claim_refs) WHERE text IS NOT NULL)
SELECT min(claim_id) AS first, count(*) AS copies, count(DISTINCT doc_id) AS doc_count, array_to_string(list_sort(list(claim_id)), ',') AS places FROM k GROUP BY key""")
def collapsed_claims(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "claim_refs").select("claim_id", "doc_id", "text").distinct()
    return dedup.collapse(claims, "text", "masked", F.col("claim_id"), F.col("claim_id")).select("first", "copies", "doc_count", F.concat_ws(",", F.transform("places", lambda p: p.cast("string"))).alias("places"))


def _tier_sql(key: str, tier: str) -> str:
    return f"""SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks, count(*) AS unique_chunks, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS collapsed, count(*) FILTER (n > 1) AS duplicate_groups,
 coalesce(max(n), 0) AS largest, count(*) FILTER (n > 1 AND docs = 1) AS within, count(*) FILTER (n > 1 AND docs > 1) AS across, '{tier}' AS tier
 FROM (SELECT {key} k, count(*) n, count(DISTINCT doc_id) docs FROM claim_refs WHERE text IS NOT NULL GROUP BY 1)"""


_JOINED = f"array_to_string({_tok('text')}, ' ')"


@query(" UNION ALL ".join([_tier_sql("text", "exact"), _tier_sql(f"CASE WHEN {_JOINED} = '' THEN text ELSE {_JOINED} END", "normalized"), _tier_sql(f"CASE WHEN {_JOINED} = '' THEN text ELSE regexp_replace({_JOINED}, '[0-9]', '#', 'g') END", "masked")]))
def duplicate_tiers(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "claim_refs")
    a, b, c = (dedup.collapse_stats(claims, "text", t) for t in ("exact", "normalized", "masked"))
    return a.union(b).union(c)


@query("""
SELECT id, question, epoch_us(created_at) AS created_us FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(question)) ORDER BY created_at, ingested_at, id) n FROM grounded_drafts) WHERE n = 1""")
def first_questions(spark: SparkSession, d: str) -> DataFrame:
    drafts = table(spark, d, "grounded_drafts").withColumn("k", F.lower(F.trim("question")))
    return dedup.first_wins(drafts, ["k"], [F.col("created_at"), F.col("ingested_at"), F.col("id")]).select("id", "question", F.unix_micros("created_at").alias("created_us"))


@query("""
SELECT CASE WHEN n > 1 THEN id || '-r' || n ELSE id END AS unique_id, epoch_us(ingested_at) AS ingested_us FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) n FROM rag_items_uk)""")
def unique_ids(spark: SparkSession, d: str) -> DataFrame:
    return dedup.renamed_ids(table(spark, d, "rag_items_uk").select("id", "ingested_at"), "id", [F.col("ingested_at")]).select("unique_id", F.unix_micros("ingested_at").alias("ingested_us"))


@query("""
WITH l AS (SELECT doc_id, page_id, trim(unnest(string_split(replace(text, chr(13), ''), chr(10)))) t FROM (SELECT DISTINCT doc_id, page_id, text FROM pdf_pages) WHERE text IS NOT NULL),
p AS (SELECT doc_id, count(DISTINCT page_id) pages FROM pdf_pages GROUP BY 1)
SELECT doc_id, regexp_replace(t, '[0-9]+', '#', 'g') AS line, count(DISTINCT page_id) AS n_pages FROM l JOIN p USING (doc_id) WHERE t <> '' AND length(t) <= 90
GROUP BY doc_id, pages, 2 HAVING count(DISTINCT page_id) >= greatest(3, 0.3 * pages)""")
def repeated_page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of up to the 90 characters that a running line may have."""
    return _repeated_lines(table(spark, d, "pdf_pages"), 90)


def _repeated_lines(pages: DataFrame, longest: int) -> DataFrame:
    lines = pages.select("doc_id", "page_id", F.explode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("t")).withColumn("t", F.trim("t"))
    sizes = pages.groupBy("doc_id").agg(F.countDistinct("page_id").alias("pages"))
    keyed = lines.where(f"t <> '' and length(t) <= {longest}").select("doc_id", "page_id", F.regexp_replace("t", "[0-9]+", "#").alias("line")).distinct()
    return keyed.groupBy("doc_id", "line").agg(F.count("*").alias("n_pages")).join(sizes, "doc_id").where("n_pages >= greatest(3, 0.3 * pages)").select("doc_id", "line", "n_pages")


@query("""
WITH b AS (SELECT doc_id, regexp_replace(unnest(string_split(replace(text, chr(13), ''), chr(10) || chr(10))), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS blocks, count(*) - count(DISTINCT t) AS repeated, CAST(sum(length(t)) AS BIGINT) AS chars FROM b WHERE t <> '' GROUP BY doc_id""")
def block_repeats(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.regexp_replace("text", "\r", ""), "\n\n")).alias("t")).withColumn("t", T.bare(F.col("t"))).where("t <> ''")
    return blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), (F.count("*") - F.countDistinct("t")).alias("repeated"), F.sum(F.length("t")).alias("chars"))


# ---- retrieval


_BM25 = f"""
c AS (SELECT DISTINCT claim_id, doc_id, text FROM claim_refs WHERE text IS NOT NULL),
w AS (SELECT claim_id, {_tok("text")} t FROM c),
st AS (SELECT count(*) n, avg(len(t)) a FROM w),
po AS (SELECT claim_id, dl, term, count(*) tf FROM (SELECT claim_id, len(t) dl, unnest(t) term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) df FROM po GROUP BY 1),
qs AS (SELECT id, term, count(*) qf FROM (SELECT id, unnest({_tok("question")}) term FROM (SELECT DISTINCT id, question FROM rag_items_uk)) GROUP BY ALL),
sc AS (SELECT id, claim_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) score FROM qs JOIN po USING (term) JOIN df USING (term), st GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, claim_id) AS rank FROM sc)"""
_BM25_20TH = _BM25.replace("rag_items_uk", "rag_items_uk WHERE CAST(right(id, 7) AS INT) % 20 = 0")


def _20th(items: DataFrame) -> DataFrame:
    return items.where(F.right("id", F.lit(7)).cast("int") % 20 == 0)


def _searches(spark: SparkSession, d: str, part: Callable[[DataFrame], DataFrame] = lambda items: items) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    items = part(table(spark, d, "rag_items_uk"))
    claims = table(spark, d, "claim_refs").select("claim_id", "doc_id", "text").distinct()
    chunks = claims.select(F.col("claim_id").alias("chunk_id"), "text")
    postings = ranking.term_postings(chunks)
    return items, claims, ranking.bm25(chunks, items.select(F.col("id").alias("query_id"), F.col("question").alias("text")).distinct(), 10, postings), postings


@query(f"WITH {_BM25} SELECT id AS query_id, claim_id AS chunk_id, score, rank FROM rk WHERE rank <= 10")
def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return _searches(spark, d)[2].select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_BM25_20TH}, g AS (SELECT DISTINCT id, doc, lower(trim(split)) split FROM rag_items_uk WHERE CAST(right(id, 7) AS INT) % 20 = 0),
h AS (SELECT g.id, g.split, min(rk.rank) f FROM g LEFT JOIN (rk JOIN c USING (claim_id)) ON rk.id = g.id AND rk.rank <= 10 AND c.doc_id = g.doc GROUP BY ALL)
SELECT split, count(*) AS n, round(avg(CASE WHEN f <= 10 THEN 1.0 ELSE 0 END), 9) AS recall, round(avg(coalesce(1.0 / f, 0)), 9) AS mrr FROM h GROUP BY GROUPING SETS ((split), ())""")
def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    items, claims, found, _ = _searches(spark, d, _20th)
    gold = items.select(F.col("id").alias("query_id"), F.col("doc").alias("doc_id"), F.lower(F.trim("split")).alias("split")).distinct()
    ranked = found.join(claims.select(F.col("claim_id").alias("chunk_id"), "doc_id"), "chunk_id")
    return ranking.retrieval_metrics(ranked, gold, 10, "split")


@query("""
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id query_id, e.vec_id id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) similarity FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s)
SELECT query_id, id, similarity, rank FROM r WHERE rank <= 5""")
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return ranking.nearest(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_BM25}, l AS (SELECT id, claim_id, 0.5 / (60 + rank) s FROM rk WHERE rank <= 10),
q2 AS (SELECT id, term, count(*) qf FROM (SELECT id, unnest({_tok("answer_span")}) term FROM (SELECT DISTINCT id, answer_span FROM rag_items_uk)) GROUP BY ALL),
s2 AS (SELECT id, claim_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) score FROM q2 JOIN po USING (term) JOIN df USING (term), st GROUP BY ALL),
r2 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, claim_id) AS rank FROM s2),
u AS (SELECT * FROM l UNION ALL SELECT id, claim_id, 0.5 / (60 + rank) FROM r2 WHERE rank <= 10),
f AS (SELECT id, claim_id, round(sum(s), 9) score FROM u GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, claim_id) AS rank FROM f)
SELECT id AS query_id, claim_id AS chunk_id, score, rank FROM o WHERE rank <= 10""")
def fused_search(spark: SparkSession, d: str) -> DataFrame:
    items, claims, by_question, postings = _searches(spark, d)
    by_question = stage(by_question, "by-question", release=True)
    by_answer = ranking.bm25(claims.select(F.col("claim_id").alias("chunk_id"), "text"), items.select(F.col("id").alias("query_id"), F.col("answer_span").alias("text")).distinct(), 10, postings)
    by_answer = stage(by_answer, "by-answer", release=True)
    return ranking.rrf([(by_question, 0.5), (by_answer, 0.5)], 10).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""SELECT term, n, docs FROM (SELECT *, row_number() OVER (ORDER BY n DESC, term) r FROM (
  SELECT term, count(*) n, count(DISTINCT doc_id) docs FROM (SELECT doc_id, unnest({_tok("text")}) term FROM documents) WHERE length(term) > 3 GROUP BY 1)) WHERE r <= 100""")
def salient_terms(spark: SparkSession, d: str) -> DataFrame:
    """The 100 most frequent terms; the limit is the feature."""
    per = table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).where("length(term) > 3").groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).orderBy(F.desc("n"), "term").limit(100)


# ---- spans and joins


@query("""
WITH f AS (SELECT DISTINCT finding_id, a.doc_id doc_id, a.char_start s, a.char_end e FROM findings WHERE a.char_end > a.char_start),
c AS (SELECT DISTINCT claim_id, doc_id, char_start, char_end FROM claim_refs WHERE char_end > char_start)
SELECT finding_id AS span_id, count(claim_id) AS n_overlaps FROM f LEFT JOIN c ON c.doc_id = f.doc_id AND c.char_start < f.e AND f.s < c.char_end GROUP BY 1""")
def span_overlaps(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "findings").select(F.col("finding_id").alias("span_id"), "a.doc_id", "a.char_start", "a.char_end").where("char_end > char_start").distinct()
    claims = table(spark, d, "claim_refs").select("claim_id", "doc_id", "char_start", "char_end").distinct()
    return spans.overlap_count(found, claims)


@query("""
WITH c AS (SELECT DISTINCT doc_id, char_start s, char_end e FROM claim_refs WHERE char_end > char_start),
w AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) b FROM c)
SELECT doc_id, CAST(sum(greatest(e - greatest(s, coalesce(b, s)), 0)) AS BIGINT) AS covered, CAST(sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) AS BIGINT) AS islands FROM w GROUP BY doc_id""")
def claim_coverage(spark: SparkSession, d: str) -> DataFrame:
    return spans.union_length(table(spark, d, "claim_refs").select("doc_id", "char_start", "char_end").distinct(), ["doc_id"], "char_start", "char_end")


@query("""
SELECT DISTINCT c.claim_id, m.source_system, m.acl_label FROM claim_refs c JOIN corpus_manifest m USING (doc_id) WHERE m.acl_label IS NOT NULL""")
def governed_claims(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "claim_refs").select("claim_id", "doc_id")
    manifest = table(spark, d, "corpus_manifest").where("acl_label is not null").select("doc_id", "source_system", "acl_label")
    return claims.join(manifest, "doc_id").select("claim_id", "source_system", "acl_label").distinct()


_DATE = "CASE WHEN regexp_extract({0}, '(\\d{{4}})-(\\d{{2}})-(\\d{{2}})', 0) <> '' THEN regexp_extract({0}, '(\\d{{4}})-(\\d{{2}})-(\\d{{2}})', 0) WHEN regexp_extract({0}, '(\\d{{2}})\\.(\\d{{2}})\\.(\\d{{4}})', 0) <> '' THEN regexp_extract({0}, '(\\d{{2}})\\.(\\d{{2}})\\.(\\d{{4}})', 3) || '-' || regexp_extract({0}, '(\\d{{2}})\\.(\\d{{2}})\\.(\\d{{4}})', 2) || '-' || regexp_extract({0}, '(\\d{{2}})\\.(\\d{{2}})\\.(\\d{{4}})', 1) END"


@query(f"""
WITH m AS (SELECT doc_id, {_DATE.format("effective_date")} dt FROM corpus_manifest),
f AS (SELECT DISTINCT finding_id, a.doc_id x, b.doc_id y FROM findings WHERE b IS NOT NULL)
SELECT finding_id, CASE WHEN p.dt > q.dt THEN 'a' WHEN q.dt > p.dt THEN 'b' END AS newer_side FROM f LEFT JOIN m p ON p.doc_id = f.x LEFT JOIN m q ON q.doc_id = f.y""")
def edition_order(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "corpus_manifest").select("doc_id", T.iso_date(F.col("effective_date")).alias("dt"))
    f = table(spark, d, "findings").where("b is not null").select("finding_id", F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y")).distinct()
    both = f.join(m.toDF("x", "dx"), "x", "left").join(m.toDF("y", "dy"), "y", "left")
    return both.select("finding_id", F.when(F.col("dx") > F.col("dy"), "a").when(F.col("dy") > F.col("dx"), "b").alias("newer_side"))


@query(f"""
WITH g AS (SELECT {_DATE.format("effective_date")} dt, count(*) n FROM corpus_manifest GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS documents, CAST(sum(n) FILTER (dt IS NOT NULL) AS BIGINT) AS dated,
 CAST(sum(n) FILTER (dt IS NOT NULL) * (sum(n) FILTER (dt IS NOT NULL) - 1) / 2 - sum(n * (n - 1) / 2) FILTER (dt IS NOT NULL) AS BIGINT) AS orderable_pairs FROM g""")
def orderable_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that their dates put in order, counted from group sizes."""
    g = table(spark, d, "corpus_manifest").groupBy(T.iso_date(F.col("effective_date")).alias("dt")).agg(F.count("*").alias("n"))
    known = F.when(F.col("dt").isNotNull(), F.col("n"))
    return g.agg(F.sum("n").alias("documents"), F.sum(known).alias("dated"), (F.sum(known) * (F.sum(known) - 1) / 2 - F.sum(known * (known - 1) / 2)).cast("long").alias("orderable_pairs"))


@query("""
WITH o AS (SELECT doc_id, sha256(coalesce(max(governance.version), '')) h FROM claim_refs WHERE doc_id IS NOT NULL GROUP BY 1), n AS (SELECT doc_id, sha256(coalesce(version, '')) h FROM corpus_manifest)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.h = n.h THEN 'unchanged' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def fingerprint_changes(spark: SparkSession, d: str) -> DataFrame:
    """What changes between the versions that the claims were taken from and those of the manifest."""
    from ..operators.incremental import changes  # noqa: PLC0415

    taken = table(spark, d, "claim_refs").where("doc_id is not null").groupBy("doc_id").agg(F.sha2(F.coalesce(F.max("governance.version"), F.lit("")), 256).alias("hash"))
    return changes(taken, table(spark, d, "corpus_manifest").select("doc_id", F.sha2(F.coalesce("version", F.lit("")), 256).alias("hash")), "doc_id", "hash")


@query("""
WITH o AS (SELECT claim_id, arg_max(struct_pack(t := text), struct_pack(a := ingested_at, t := text)).t t FROM claim_refs WHERE ingested_at < TIMESTAMPTZ '2024-01-01 00:00:00+00' GROUP BY 1),
n AS (SELECT claim_id, arg_max(struct_pack(t := text), struct_pack(a := ingested_at, t := text)).t t FROM claim_refs GROUP BY 1)
SELECT claim_id, CASE WHEN o.t IS NULL THEN 'added' WHEN n.t IS NULL THEN 'removed' WHEN o.t = n.t THEN 'unchanged' ELSE 'modified' END AS change
FROM n LEFT JOIN o USING (claim_id) WHERE o.t IS NOT NULL OR n.t IS NOT NULL""")
def edition_changes(spark: SparkSession, d: str) -> DataFrame:
    """What changes between the claims as they stood at a date and as they arrived last. A claim without a text is not indexed."""
    from ..operators.incremental import changes  # noqa: PLC0415

    claims = table(spark, d, "claim_refs").select("claim_id", "text", "ingested_at")
    last = F.max(F.struct("ingested_at", "text"))["text"]
    edition = lambda rows: rows.groupBy("claim_id").agg(last.alias("text")).where("text is not null").select("claim_id", F.sha2("text", 256).alias("hash"))
    return changes(edition(claims.where("ingested_at < timestamp '2024-01-01 00:00:00'")), edition(claims), "claim_id", "hash")


# ---- aggregation, boards, statistics


@query("""
SELECT relation, tier, count(*) AS n, count(DISTINCT a.doc_id) AS docs, round(avg(score), 9) AS mean_score FROM (SELECT DISTINCT finding_id, lower(trim(relation)) relation, tier, score, a FROM findings) GROUP BY GROUPING SETS ((relation, tier), (relation), ())""")
def finding_census(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings").select("finding_id", F.lower(F.trim("relation")).alias("relation"), "tier", "score", "a").distinct().withColumn("doc", F.col("a.doc_id"))
    return f.groupingSets([["relation", "tier"], ["relation"], []], "relation", "tier").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("docs"), F.round(F.avg("score"), 9).alias("mean_score"))


@query("""
WITH s AS (SELECT source, count(*) n, avg(n_chars) c FROM documents WHERE source IS NOT NULL GROUP BY 1),
r AS (SELECT source, n, round(c, 6) c, rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2 a, rank() OVER (ORDER BY round(c, 6) DESC) + (count(*) OVER (PARTITION BY round(c, 6)) - 1) / 2 b FROM s)
SELECT source, n, c AS mean_chars, (a + b) / 2 AS avg_rank FROM r""")
def source_board(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))
    return ranking.average_rank(s, ["n", "mean_chars"])


@query("""
SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) r FROM documents WHERE source IS NOT NULL) WHERE r = 1""")
def longest_per_source(spark: SparkSession, d: str) -> DataFrame:
    best = F.max_by(F.struct("doc_id", "n_chars"), F.struct(F.coalesce("n_chars", F.lit(-1)), -F.col("doc_id"))).alias("b")
    return table(spark, d, "documents").where("source is not null").groupBy("source").agg(best).select("source", "b.doc_id", "b.n_chars")


@query("""
WITH r AS (SELECT source, n_chars v, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 i, count(*) OVER (PARTITION BY source) n FROM documents WHERE n_chars IS NOT NULL AND source IS NOT NULL)
SELECT source, count(*) AS n, max(v) FILTER (i = least(CAST(round_even(0.9 * (n - 1), 0) AS BIGINT), n - 1)) AS nearest, max(v) FILTER (i = least(CAST(floor(0.9 * n) AS BIGINT), n - 1)) AS truncated, round(quantile_cont(v, 0.9), 6) AS linear FROM r GROUP BY source""")
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return stats.percentiles(table(spark, d, "documents").where("source is not null"), "source", "n_chars", 0.9).withColumn("linear", F.round("linear", 6))


@query("""
WITH f AS (SELECT DISTINCT finding_id, lower(trim(relation)) = 'duplicate' a, score > 0.5 b FROM findings), k AS (SELECT a, b, count(*) n FROM f WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
t AS (SELECT sum(n) t, sum(n) FILTER (a = b) s FROM k), c AS (SELECT sum(x.n * y.n) c FROM (SELECT a l, sum(n) n FROM k GROUP BY 1) x JOIN (SELECT b l, sum(n) n FROM k GROUP BY 1) y USING (l))
SELECT CAST(t AS BIGINT) AS n, round(s / t, 9) AS agreement, round((s / t - c / (t * t)) / (1 - c / (t * t)), 9) AS kappa FROM t, c""")
def rater_agreement(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings").select("finding_id", (F.lower(F.trim("relation")) == "duplicate").alias("x"), (F.col("score") > 0.5).alias("y")).distinct()
    return stats.cohen_kappa(f, F.col("x"), F.col("y"))


@query("""
WITH d AS (SELECT question_type g, CAST(length(reference_answer) AS DOUBLE) - length(quote) / 2.0 d FROM (SELECT DISTINCT id, question_type, reference_answer, quote FROM grounded_drafts) WHERE reference_answer IS NOT NULL AND quote IS NOT NULL)
SELECT g AS question_type, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties, round(avg(d), 6) AS mean_delta FROM d GROUP BY g""")
def paired_lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "grounded_drafts").select("id", "question_type", "reference_answer", "quote").distinct()
    return stats.paired(rows, "question_type", F.length("reference_answer").cast("double"), F.length("quote") / 2.0)


@query("""
WITH m AS (SELECT year(ts) * 12 + month(ts) - 1 AS month_no, event_type, count(*) n, sum(value) v FROM events GROUP BY ALL)
SELECT month_no, event_type, n, round(v, 4) AS total, round(sum(v) OVER (PARTITION BY event_type ORDER BY month_no), 4) AS running FROM m""")
def monthly_events(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").groupBy(T.month_ordinal(F.col("ts")).alias("month_no"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    running = F.sum("v").over(Window.partitionBy("event_type").orderBy("month_no").rowsBetween(Window.unboundedPreceding, 0))
    return m.select(F.col("month_no").cast("long").alias("month_no"), "event_type", "n", F.round("v", 4).alias("total"), F.round(running, 4).alias("running"))


@query("""
SELECT 'duplicate_id' AS problem, id FROM (SELECT id FROM rag_items_uk GROUP BY id HAVING count(DISTINCT question || coalesce(reference_answer, '')) > 1 OR count(*) > 1)
UNION ALL SELECT 'unknown_document', id FROM (SELECT DISTINCT id, doc FROM rag_items_uk) WHERE doc NOT IN (SELECT doc_id FROM corpus_manifest)
UNION ALL SELECT 'unknown_split', id FROM (SELECT DISTINCT id, split FROM rag_items_uk) WHERE split IS NULL OR lower(trim(split)) NOT IN ('final', 'calibration', 'tuning')""")
def gold_problems(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "rag_items_uk")
    repeated = items.groupBy("id").count().where("count > 1").select(F.lit("duplicate_id").alias("problem"), "id")
    lost = items.select("id", "doc").distinct().join(table(spark, d, "corpus_manifest").select(F.col("doc_id").alias("doc")), "doc", "left_anti").where("doc is not null").select(F.lit("unknown_document"), "id")
    split = items.select("id", F.lower(F.trim("split")).alias("s"), "split").distinct().where("split is null or s not in ('final', 'calibration', 'tuning')").select(F.lit("unknown_split"), "id")
    return repeated.union(lost).union(split)


# ---- graph and linkage


_BOTH = "e AS (SELECT DISTINCT a.doc_id u, b.doc_id v FROM findings WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.doc_id <> b.doc_id), bo AS (SELECT u, v FROM e UNION SELECT v, u FROM e)"


@query(f"""
WITH RECURSIVE {_BOTH}, s AS (SELECT DISTINCT a.doc_id node FROM findings WHERE tier = 'hash' AND a.doc_id IS NOT NULL),
w(node, depth) AS (SELECT node, 0 FROM s UNION SELECT bo.v, w.depth + 1 FROM w JOIN bo ON bo.u = w.node WHERE w.depth < 2)
SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def two_hop_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    both = graph.undirected(table(spark, d, "findings"), "a.doc_id", "b.doc_id")
    seeds = table(spark, d, "findings").where("tier = 'hash' and a.doc_id is not null").select(F.col("a.doc_id").alias("node"))
    return graph.k_hop(both, seeds, 2)


@query(f"WITH {_BOTH} SELECT u AS node, count(*) AS degree, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS paths FROM bo GROUP BY u")
def two_hop_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.two_hop_counts(graph.undirected(table(spark, d, "findings"), "a.doc_id", "b.doc_id"))


@query("""
SELECT 'same_source' AS rule, CAST(coalesce(sum(n * (n - 1) / 2), 0) AS BIGINT) AS comparisons FROM (SELECT count(*) n FROM corpus_manifest WHERE source_system IS NOT NULL GROUP BY source_system)
UNION ALL SELECT 'same_version_language', CAST(coalesce(sum(n * (n - 1) / 2), 0) AS BIGINT) FROM (SELECT count(*) n FROM corpus_manifest WHERE version IS NOT NULL AND language IS NOT NULL GROUP BY version, language)""")
def blocking_comparisons(spark: SparkSession, d: str) -> DataFrame:
    return graph.blocking_counts(table(spark, d, "corpus_manifest"), {"same_source": [F.col("source_system")], "same_version_language": [F.col("version"), F.col("language")]})


# ---- streaming


@query("""
SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def hourly_stream(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.windows import windowed_counts  # noqa: PLC0415

    return windowed_counts(spark, f"{d}/events.parquet", "ts", "1 hour", "event_type", "value")


# ---- further operators


@query("""
WITH f AS (SELECT DISTINCT finding_id, a.doc_id AS doc_id, a.char_start AS at FROM findings), c AS (SELECT DISTINCT claim_id, doc_id, char_start FROM claim_refs),
m AS (SELECT f.finding_id, c.claim_id, row_number() OVER (PARTITION BY f.finding_id ORDER BY c.char_start DESC, c.claim_id DESC) r FROM f LEFT JOIN c ON c.doc_id = f.doc_id AND c.char_start <= f.at)
SELECT finding_id, claim_id FROM m WHERE r = 1""")
def preceding_claims(spark: SparkSession, d: str) -> DataFrame:
    """As-of match: the claim that begins last at or before each finding's span."""
    f = table(spark, d, "findings").select("finding_id", "a.doc_id", F.col("a.char_start").alias("at")).distinct()
    c = table(spark, d, "claim_refs").select("claim_id", "doc_id", F.col("char_start").alias("at")).distinct()
    return linkage.as_of(f, c, "doc_id", "at", "finding_id", "claim_id")


@query("""
WITH m AS (SELECT doc_id, source_system s, version v, acl_label a, language l, effective_date e FROM corpus_manifest WHERE language IS NOT NULL AND effective_date IS NOT NULL),
p AS (SELECT x.doc_id left_id, y.doc_id right_id, log2(0.2 / 0.8)
 + CASE WHEN x.v IS NULL OR y.v IS NULL THEN 0 WHEN x.v = y.v THEN log2(0.9 / 0.1) ELSE log2(0.1 / 0.9) END
 + CASE WHEN x.s IS NULL OR y.s IS NULL THEN 0 WHEN x.s = y.s THEN log2(0.8 / 0.2) ELSE log2(0.2 / 0.8) END
 + CASE WHEN x.a IS NULL OR y.a IS NULL THEN 0 WHEN x.a = y.a THEN log2(0.7 / 0.3) ELSE log2(0.3 / 0.7) END w FROM m x JOIN m y ON x.l = y.l AND x.e = y.e AND x.doc_id < y.doc_id)
SELECT left_id, right_id, round(w, 6) AS match_weight, round(pow(2, round(w, 6)) / (1 + pow(2, round(w, 6))), 9) AS match_probability FROM p WHERE round(pow(2, round(w, 6)) / (1 + pow(2, round(w, 6))), 9) >= 0.02""")
def linked_manifests(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "corpus_manifest")
    fields = {"version": (F.col("version"), 0.9, 0.1), "source": (F.col("source_system"), 0.8, 0.2), "acl": (F.col("acl_label"), 0.7, 0.3)}
    return linkage.linked_pairs(m, "doc_id", [F.col("language"), F.col("effective_date")], fields, 0.02, 0.2)


@query(f"""
WITH d AS (SELECT DISTINCT id, reference_answer a, {_tok("quote")} q FROM grounded_drafts WHERE reference_answer IS NOT NULL),
c AS (SELECT id, q, unnest(regexp_split_to_array(a, '[.!?;…\n]+')) c FROM d), t AS (SELECT id, q, {_tok("c")} t FROM c),
s AS (SELECT id, len(list_filter(t, lambda x: list_contains(q, x))) >= 0.6 * len(t) ok FROM t WHERE len(t) >= 2)
SELECT id, count(*) AS claims, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 9) AS grounded FROM s GROUP BY id""")
def groundedness(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "grounded_drafts").where("reference_answer is not null").select("id", "reference_answer", "quote").distinct()
    t = rows.select("id", T.tokens(F.col("quote")).alias("q"), F.explode(F.split("reference_answer", "[.!?;…\n]+")).alias("c")).select("id", "q", T.tokens(F.col("c")).alias("t")).where("size(t) >= 2")
    ok = F.size(F.filter("t", lambda x: F.array_contains("q", x))) >= 0.6 * F.size("t")
    return t.groupBy("id").agg(F.count("*").alias("claims"), F.round(F.avg(ok.cast("double")), 9).alias("grounded"))


@query("""
WITH r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 i, count(*) OVER () n FROM events),
p AS (SELECT CAST(floor(k.range * (SELECT count(*) FROM events) / 100.0) AS BIGINT) i FROM range(100) k)
SELECT event_id FROM r WHERE i IN (SELECT i FROM p)""")
def spread_events(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: 100 events at even distances in order of time. Positions come from a sort by ranges, not one task."""
    from ..operators.sampling import evenly_spread  # noqa: PLC0415

    return evenly_spread(table(spark, d, "events"), ["ts", "event_id"], 100).select("event_id")


@query("""
SELECT doc_id, CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'calibration' ELSE 'final' END AS split FROM (SELECT doc_id, CAST('0x' || substr(md5('7:' || doc_id), 1, 8) AS BIGINT) % 100 h FROM documents)""")
def hashed_split(spark: SparkSession, d: str) -> DataFrame:
    h = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(100))
    return table(spark, d, "documents").select("doc_id", F.when(h < 80, "train").when(h < 90, "calibration").otherwise("final").alias("split"))


@query("""
SELECT source, round(0.5 * sum(CASE WHEN lang = 'uk' THEN 1 ELSE 0 END) / count(*) + 0.3 * sum(CASE WHEN n_chars > 500 THEN 1 ELSE 0 END) / count(*) + 0.2 * count(path) / count(*), 9) AS composite
FROM documents WHERE source IS NOT NULL GROUP BY source HAVING count(*) >= 3""")
def source_composite(spark: SparkSession, d: str) -> DataFrame:
    """A weighted mean of shares per source; sources with fewer than three documents don't qualify."""
    n = F.count("*")
    score = 0.5 * F.count_if(F.col("lang") == "uk") / n + 0.3 * F.count_if(F.col("n_chars") > 500) / n + 0.2 * F.count("path") / n
    return table(spark, d, "documents").where("source is not null").groupBy("source").agg(n.alias("n"), F.round(score, 9).alias("composite")).where("n >= 3").drop("n")


@query(f"""
WITH s AS (SELECT id, token_recall, token_f1, contained FROM ({SQL["answer_scores"]})), f AS (SELECT id, max(CASE WHEN refusal THEN 1 ELSE 0 END) r FROM ({SQL["question_flags"]}) GROUP BY 1)
SELECT id, CASE WHEN r = 1 THEN 'refusal' WHEN contained THEN 'grounded' WHEN token_f1 > 0.3 THEN 'partial' ELSE 'generation' END AS outcome FROM s JOIN f USING (id)""")
def case_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """One outcome per answer, by precedence."""
    flags = question_flags(spark, d).groupBy("id").agg(F.max("refusal").alias("r"))
    return answer_scores(spark, d).join(flags, "id").select("id", F.when(F.col("r"), "refusal").when(F.col("contained"), "grounded").when(F.col("token_f1") > 0.3, "partial").otherwise("generation").alias("outcome"))


def _chunks(strategy: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return chunked(table(spark, d, "documents"), "doc_id", "text", strategy).drop("text")

    run.__name__ = f"{strategy}_chunks"
    return run


for _s in ("sentence", "recursive", "markdown", "table"):
    QUERIES[f"{_s}_chunks"] = _chunks(_s)
