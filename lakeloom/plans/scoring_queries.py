"""Queries of scoring and text functions, with the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..tables import table
from .corpus_queries import SQL, _COLLAPSED, query

_DRAFTS = "(SELECT DISTINCT id, question, reference_answer answer, quote, question_type, lang, source_doc_id FROM grounded_drafts)"


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "grounded_drafts").select("id", "question", F.col("reference_answer").alias("answer"), "quote", "question_type", "lang", "source_doc_id").distinct()


_WORDS = "list_filter(string_split(trim(regexp_replace(lower(regexp_replace({0}, '\\[\\d+\\]', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(f"""
WITH d AS (SELECT id, coalesce(answer, '') || ' [1]. ' || question || ' [3]; [2]' a, [coalesce(quote, ''), question] ch FROM {_DRAFTS}),
c AS (SELECT id, ch, unnest(list_filter(list_transform(string_split_regex(a, '[.!?;\\n…]+'), lambda x: trim(x)), lambda x: x <> '')) c FROM d),
k AS (SELECT *, len({_WORDS.format("c")}) >= 2 counted, list_transform(regexp_extract_all(c, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS INT)) cited FROM c),
w AS (SELECT *, {_WORDS.format("c")} w FROM k),
v AS (SELECT id, counted, len(cited) n, len(list_filter(cited, lambda i: i < 1 OR i > 2)) bad,
 len(list_filter(cited, lambda i: i BETWEEN 1 AND 2 AND len(w) > 0 AND len(list_filter(w, lambda x: list_contains(string_split({_COLLAPSED.format("ch[i]")}, ' '), x))) >= 0.6 * len(w))) good FROM w)
SELECT id, CAST(sum(n) AS BIGINT) AS citations, CAST(sum(good) AS BIGINT) AS valid, CAST(sum(bad) AS BIGINT) AS hallucinated, CAST(sum(CASE WHEN counted THEN 1 ELSE 0 END) AS BIGINT) AS claims, CAST(sum(CASE WHEN counted AND n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS covered FROM v GROUP BY id""")
def citation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Citations of an answer that cites its quote, its question and a chunk that isn't there."""
    a = F.concat(F.coalesce("answer", F.lit("")), F.lit(" [1]. "), F.col("question"), F.lit(" [3]; [2]"))
    r = _drafts(spark, d).select("id", S.citation_report(a, F.array(F.coalesce("quote", F.lit("")), "question")).alias("r"))
    return r.select("id", *[F.col(f"r.{k}").cast("long").alias(k) for k in ("citations", "valid", "hallucinated", "claims", "covered")])


@query(f"SELECT id, round(0.75 * token_recall + 0.25 * token_precision, 6) AS score FROM ({SQL['answer_scores']})")
def ranking_scores(spark: SparkSession, d: str) -> DataFrame:
    from .corpus_queries import answer_scores  # noqa: PLC0415

    return answer_scores(spark, d).select("id", F.round(S.ranking_score(F.col("token_precision"), F.col("token_recall")), 6).alias("score"))


_EDGE = "[\\s.,;:!?\"''`«»“”()\\[\\]{}\\-–—]+"


@query(f"""
SELECT DISTINCT claim_id, regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '^{_EDGE}|{_EDGE}$', '', 'g') AS surface,
 CASE {" ".join(f"WHEN regexp_matches(lower(text), '{v}') THEN '{k}'" for k, v in S.DIRECTIONS.items())} END AS direction FROM claim_refs WHERE text IS NOT NULL""")
def claim_labels(spark: SparkSession, d: str) -> DataFrame:
    """Normal form of a label and the direction it tells."""
    return table(spark, d, "claim_refs").where("text is not null").select("claim_id", S.surface(F.col("text")).alias("surface"), S.direction(F.col("text")).alias("direction")).distinct()


_Q = "lower(trim(regexp_replace(coalesce(question, ''), '\\s+', ' ', 'g')))"


@query(f"""
WITH q AS (SELECT DISTINCT id, {_Q} q, trim(coalesce(reference_answer, '')) a FROM rag_items_uk)
SELECT id, CASE WHEN q = '' THEN 'factoid' WHEN regexp_matches(q, '{S.DEFINITION}') THEN 'definition' WHEN regexp_matches(q, '{S.COMPARATIVE}') THEN 'comparative'
 WHEN (a <> '' AND (regexp_matches(a, '^[\\d\\s.,:%/x×°-]+$') OR (length(a) <= 24 AND length(regexp_replace(a, '\\D', '', 'g')) >= 2))) OR regexp_matches(q, '{S.NUMERIC}') THEN 'numeric'
 WHEN regexp_matches(q, '{S.PROCEDURAL}') THEN 'procedural' ELSE 'factoid' END AS question_type FROM q""")
def question_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rag_items_uk").select("id", S.question_type(F.col("question"), F.col("reference_answer")).alias("question_type")).distinct()


@query("""
WITH e AS (SELECT event_id, event_type, 'call: ```json\n{"name": "' || event_type || '", "arguments": ' || props || '}\n``` done' t FROM events),
j AS (SELECT event_id, event_type, regexp_extract(t, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1) b FROM e)
SELECT event_id, b ->> '$.name' AS name, b ->> '$.arguments.k' AS k, (b ->> '$.arguments.k') IS NOT NULL AND CAST(b ->> '$.arguments.k' AS BIGINT) > 50 AS matches FROM j""")
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls in fenced JSON within prose, and whether an argument is as expected."""
    t = F.concat(F.lit('call: ```json\n{"name": "'), "event_type", F.lit('", "arguments": '), "props", F.lit("}\n``` done"))
    c = table(spark, d, "events").select("event_id", S.tool_call(t).alias("c"))
    k = F.get_json_object("c.arguments", "$.k")
    return c.select("event_id", "c.name", k.alias("k"), F.coalesce(k.cast("long") > 50, F.lit(False)).alias("matches"))


@query("""
SELECT event_id, list_concat(CASE WHEN event_type = 'error' THEN [] ELSE ['missing code'] END, CASE WHEN event_type = 'error' THEN [] ELSE ['unknown k'] END, CASE WHEN event_type = 'error' AND NOT regexp_matches(props ->> '$.k', '^-?\\d+$') THEN ['type code'] ELSE [] END) AS errors FROM events""")
def argument_problems(spark: SparkSession, d: str) -> DataFrame:
    """Arguments against a schema with one required whole number ``code``; only errors carry it."""
    args = F.when(F.col("event_type") == "error", F.replace("props", F.lit('"k"'), F.lit('"code"'))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", S.argument_errors(args, ["code"], {"code": "integer"}).alias("errors"))


@query(f"""
WITH d AS (SELECT id, answer, quote FROM {_DRAFTS} WHERE answer IS NOT NULL AND quote IS NOT NULL)
SELECT id, lower(trim(answer)) = lower(trim(quote)) AS exact, contains(lower(trim(quote)), lower(trim(answer))) AS contained, coalesce(abs(TRY_CAST(lower(trim(answer)) AS DOUBLE) - length(quote)) <= 5, false) AS near FROM d""")
def field_matches(spark: SparkSession, d: str) -> DataFrame:
    rows = _drafts(spark, d).where("answer is not null and quote is not null")
    a, q = F.col("answer"), F.col("quote")
    return rows.select("id", S.value_matches(q, a).alias("exact"), S.value_matches(a, q, "contains").alias("contained"), S.value_matches(F.length(q).cast("string"), a, "numeric", 5.0).alias("near"))


_ATTACK = f"""
SELECT id, lang, source_doc_id, kind, NOT regexp_matches(lower(translate(coalesce(answer, ''), '’ʼ`ʹ', '''''''''')), '{T.REFUSAL.replace("'", "''")}')
 AND CASE WHEN kind = 'leak' THEN coalesce(contains({_COLLAPSED.format("answer")}, {_COLLAPSED.format("question_type")}), false) ELSE coalesce(trim(answer) <> '', false) END AS succeeded
FROM (SELECT *, CASE WHEN length(question) % 2 = 0 THEN 'leak' ELSE 'harm' END kind FROM {_DRAFTS} WHERE question_type IS NOT NULL)"""


def _attacks(spark: SparkSession, d: str) -> DataFrame:
    rows = _drafts(spark, d).where("question_type is not null").withColumn("kind", F.when(F.length("question") % 2 == 0, "leak").otherwise("harm"))
    return rows.select("id", "lang", "source_doc_id", "kind", S.attack_succeeded(F.col("kind"), F.col("question_type"), F.col("answer")).alias("succeeded"))


@query(f"SELECT kind, count(*) AS n, round(avg(CASE WHEN succeeded THEN 1.0 ELSE 0.0 END), 9) AS attack_rate FROM ({_ATTACK}) GROUP BY GROUPING SETS ((kind), ())")
def security_scores(spark: SparkSession, d: str) -> DataFrame:
    return _attacks(spark, d).groupingSets([["kind"], []], "kind").agg(F.count("*").alias("n"), F.round(F.avg(F.col("succeeded").cast("double")), 9).alias("attack_rate"))


@query(f"""
WITH g AS (SELECT source_doc_id, count(DISTINCT succeeded) k FROM ({_ATTACK}) WHERE lang IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lang) > 1)
SELECT count(*) AS groups, count(*) FILTER (k = 1) AS consistent FROM g""")
def language_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Groups with cases in several languages, and those decided alike in all."""
    g = _attacks(spark, d).where("lang is not null").groupBy("source_doc_id").agg(F.countDistinct("lang").alias("l"), F.countDistinct("succeeded").alias("k")).where("l > 1")
    return g.agg(F.count("*").alias("groups"), F.count_if(F.col("k") == 1).alias("consistent"))


@query("""
WITH v AS (SELECT a.vec_id, a.embedding x, b.embedding y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(greatest(0, least(1, list_cosine_similarity(list_transform(x, lambda v: CAST(v AS DOUBLE)), list_transform(y, lambda v: CAST(v AS DOUBLE))))), 6) AS similarity FROM v""")
def neighbour_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Clamped cosine of each vector and the next one."""
    v = table(spark, d, "embeddings")
    pairs = v.select("vec_id", F.col("embedding").alias("x")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return pairs.select("vec_id", F.round(S.cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("""
WITH d AS (SELECT DISTINCT id, answer_span s, reference_answer a FROM rag_items_uk WHERE answer_span IS NOT NULL AND reference_answer IS NOT NULL)
SELECT id, CASE WHEN length(s) > 0 THEN CAST((length(a) - length(replace(a, s, ''))) / length(s) AS INT) ELSE 0 END AS n,
 CASE WHEN length(s) = 0 THEN NULL WHEN instr(a, s) > 0 THEN instr(a, s) - 1 WHEN instr(lower(a), lower(s)) > 0 THEN instr(lower(a), lower(s)) - 1 END AS char_start FROM d""")
def span_grounding(spark: SparkSession, d: str) -> DataFrame:
    """How often an answer's span stands in it, and where first."""
    rows = table(spark, d, "rag_items_uk").where("answer_span is not null and reference_answer is not null").select("id", "answer_span", "reference_answer").distinct()
    return rows.select("id", S.occurrences(F.col("reference_answer"), F.col("answer_span")).alias("n"), S.grounded(F.col("reference_answer"), F.col("answer_span"))["start"].cast("long").alias("char_start"))


def _nested(column: str) -> str:
    out = f"replace(lower({column}), '''', '')"
    for k in sorted(S.LATIN, key=lambda k: (-len(k), k)):
        out = f"replace({out}, '{k}', '{S.LATIN[k]}')"
    return out


@query(f"SELECT p_partkey, {_nested('p_name')} AS cyrillic FROM part")
def transliterated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.to_cyrillic(F.col("p_name")).alias("cyrillic"))


def _latin(column: str) -> str:
    out = f"translate(lower({column}), 'ь''’ʼ', '')"
    for k, v in S.LATIN.items():
        out = f"replace({out}, '{v}', '{k}')"
    return out


@query(f"SELECT DISTINCT id, {_latin('question')} AS latin FROM rag_items_uk")
def romanized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rag_items_uk").select("id", S.to_latin(F.col("question")).alias("latin")).distinct()


@query("""
SELECT p_partkey, CASE WHEN p_name = lower(p_name) THEN lower(p_brand) WHEN p_name = upper(p_name) THEN upper(p_brand) ELSE upper(substr(lower(p_brand), 1, 1)) || substr(lower(p_brand), 2) END AS cased FROM part""")
def restored_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.cased_like(F.col("p_name"), F.lower("p_brand")).alias("cased"))


@query(f"""
WITH d AS (SELECT id, '1) ' || question || chr(10) || '- ' || upper(question) || chr(10) || chr(10) || '* "' || coalesce(answer, '') || '"' t FROM {_DRAFTS}),
l AS (SELECT id, trim(trim(trim(regexp_replace(x, '^\\s*(?:[-*]|\\d+[.)])\\s*', '')), '"')) q, i FROM (SELECT id, unnest(string_split_regex(t, '\\r?\\n')) x, generate_subscripts(string_split_regex(t, '\\r?\\n'), 1) i FROM d)),
f AS (SELECT *, row_number() OVER (PARTITION BY id, lower(q) ORDER BY i) r FROM l WHERE q <> '')
SELECT id, list(q ORDER BY i)[1:5] AS subqueries FROM f WHERE r = 1 GROUP BY id""")
def parsed_subqueries(spark: SparkSession, d: str) -> DataFrame:
    """Queries out of a numbered list with a repeat and a blank line."""
    t = F.concat(F.lit("1) "), "question", F.lit("\n- "), F.upper("question"), F.lit('\n\n* "'), F.coalesce("answer", F.lit("")), F.lit('"'))
    return _drafts(spark, d).select("id", S.subqueries(t).alias("subqueries"))


@query("""
SELECT DISTINCT claim_id, 'X' || substr(text, 2, 4) || '' || substr(text, 9) AS edited, CASE WHEN c.char_start >= 8 THEN c.char_start - 3 END AS char_start, CASE WHEN c.char_start >= 8 THEN c.char_end - 3 END AS char_end FROM claim_refs c WHERE length(text) >= 10 AND char_end > 8""")
def edited_claims(spark: SparkSession, d: str) -> DataFrame:
    """Two edits of a text, and where a span of it lies after them; null if an edit touches it."""
    edits = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(n).alias("new")) for a, b, n in ((0, 1, "X"), (5, 8, ""))])
    rows = table(spark, d, "claim_refs").where("length(text) >= 10 and char_end > 8").select("claim_id", "text", "char_start", "char_end").distinct()
    span = S.remapped(edits, F.col("char_start"), F.col("char_end"))
    # the span is taken first: within a lambda the name of an output column would hide the input's
    placed = rows.select("claim_id", S.edited(F.col("text"), edits).alias("edited"), span.alias("span"))
    return placed.select("claim_id", "edited", F.col("span.start").alias("char_start"), F.col("span.end").alias("char_end")).distinct()


@query("""
WITH p AS (SELECT page_id, any_value(list_transform(blocks, lambda b: b.char_end - b.char_start)) s FROM pdf_pages WHERE len(blocks) > 0 GROUP BY page_id)
SELECT page_id, list_transform(list_reduce(list_prepend([0], list_transform(s, lambda n: [n])), lambda a, x: CASE WHEN a[1] + x[1] <= 900 THEN list_append([a[1] + x[1]] || a[2:], 1) ELSE list_append(a, 0) END)[2:], lambda k: k = 1) AS kept FROM p""")
def fitted_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a page that fit 900 characters, taken in order."""
    rows = table(spark, d, "pdf_pages").where(F.size("blocks") > 0).groupBy("page_id").agg(F.first("blocks").alias("b"))
    return rows.select("page_id", S.fitted(F.transform("b", lambda x: x["char_end"] - x["char_start"]), 900).alias("kept"))


@query("""
WITH t AS (SELECT doc_id, sha256(text) h FROM documents WHERE text IS NOT NULL)
SELECT source, sha256(string_agg(h, '|' ORDER BY h)) AS fingerprint, count(*) AS n FROM (SELECT d.source, t.h FROM t JOIN documents d USING (doc_id) WHERE d.lang = 'pl') GROUP BY source""")
def source_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """One fingerprint for a source's documents in one language, whatever their order."""
    rows = table(spark, d, "documents").where("text is not null and lang = 'pl'").select("source", F.sha2("text", 256).alias("h"))
    return rows.groupBy("source").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("h"))), 256).alias("fingerprint"), F.count("*").alias("n"))


@query("""
SELECT doc_id, lower(regexp_replace(regexp_extract(text, '(?m)^#{1,6}[ \\t]+(.+)$', 1), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS title, round(length(text) / greatest(len(regexp_extract_all(text, '\\S+')), 1), 6) AS chars_per_word FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '(?m)^#{1,6}[ \\t]+\\S')""")
def document_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where(F.col("text").rlike(r"(?m)^#{1,6}[ \t]+\S"))
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\t\n\f\r ]+"), F.lit(0)))
    return rows.select("doc_id", F.lower(T.bare(F.regexp_extract("text", r"(?md)^#{1,6}[ \t]+(.+)$", 1))).alias("title"), F.round(F.length("text") / F.greatest(words, F.lit(1)), 6).alias("chars_per_word"))


@query("""
WITH q AS (SELECT DISTINCT id, question q FROM rag_items_uk)
SELECT id, len(regexp_extract_all(q, '[\\p{L}\\p{N}_]+')) >= 16 AS long, len(list_filter(regexp_extract_all(q, '[\\p{L}\\p{N}_]+')[2:], lambda w: regexp_matches(w, '^\\p{Lu}'))) >= 2 AS named, regexp_matches(lower(q), 'який|яка|яке|які|котр|which|whose') AS bridge FROM q""")
def routing_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signs that a question needs the graph: length, names, a relative pronoun."""
    w = F.regexp_extract_all("question", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    names = F.filter(F.slice(w, 2, 1 << 20), lambda x: x.rlike(r"^\p{Lu}"))
    return table(spark, d, "rag_items_uk").select("id", (F.size(w) >= 16).alias("long"), (F.size(names) >= 2).alias("named"), F.lower("question").rlike("який|яка|яке|які|котр|which|whose").alias("bridge")).distinct()


@query(f"""
WITH d AS (SELECT id, {_COLLAPSED.format("question")} q, {_COLLAPSED.format("coalesce(answer, '')")} a, {_COLLAPSED.format("coalesce(quote, '')")} s FROM {_DRAFTS})
SELECT id, q <> '' AND a <> '' AND NOT contains(q, a) AS non_circular, a <> '' AND contains(s, a) AS grounded, a <> '' AND a = s AS contaminated FROM d""")
def item_checks(spark: SparkSession, d: str) -> DataFrame:
    q, a, s = (T.collapsed(F.coalesce(c, F.lit(""))) for c in ("question", "answer", "quote"))
    rows = _drafts(spark, d).select("id", q.alias("q"), a.alias("a"), s.alias("s"))
    return rows.select("id", ((F.col("q") != "") & (F.col("a") != "") & ~F.col("q").contains(F.col("a"))).alias("non_circular"), ((F.col("a") != "") & F.col("s").contains(F.col("a"))).alias("grounded"), ((F.col("a") != "") & (F.col("a") == F.col("s"))).alias("contaminated"))


@query("""
WITH n AS (SELECT doc_id, lower(trim(regexp_replace(t, '^#+ ', ''))) title, i FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) t, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) i FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(t, '^#{1,6} ')),
k AS (SELECT DISTINCT title FROM n WHERE title <> ''), nt AS (SELECT DISTINCT title, unnest(list_distinct(list_filter(regexp_extract_all(title, '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 3))) t FROM k),
q AS (SELECT DISTINCT id, unnest(list_distinct(list_filter(regexp_extract_all(lower(question), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 3))) t FROM rag_items_uk),
e AS (SELECT id, title, count(*) n FROM q JOIN nt USING (t) GROUP BY ALL),
s AS (SELECT id, title, count(*) n FROM (SELECT DISTINCT id, substr(t, 1, 4) t FROM q) JOIN (SELECT DISTINCT title, substr(t, 1, 4) t FROM nt) USING (t) GROUP BY ALL),
r AS (SELECT s.id, s.title, coalesce(e.n, 0) + 0.5 * greatest(s.n - coalesce(e.n, 0), 0) score FROM s LEFT JOIN e USING (id, title))
SELECT id, title, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, title) r FROM r) WHERE r <= 3""")
def linked_titles(spark: SparkSession, d: str) -> DataFrame:
    """The three headings that share most words with a question; words of one stem count half."""
    from ..operators.graph import link_scores  # noqa: PLC0415
    from ..operators.ranking import top_k  # noqa: PLC0415
    from .corpus_queries import headings  # noqa: PLC0415

    names = headings(spark, d).select(F.lower("title").alias("node")).where("node <> ''").distinct()
    questions = table(spark, d, "rag_items_uk").select("id", "question").distinct()
    scored = link_scores(questions, "id", "question", names, "node", "node")
    return top_k(scored, ["id"], [F.desc("score"), F.asc("node")], 3).select("id", F.col("node").alias("title"), "score", F.col("rank").cast("long").alias("rank"))
