"""Column functions on text. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: apostrophe forms that count as one
APOSTROPHES = "'’ʼ`ʹ"
#: fixed values: stems by which a refusal is told, in Ukrainian, Russian and English
REFUSAL = r"(не можу (відповісти|допомогти)|недостатньо даних|немає інформації|відмовитися від відповіді|не могу ответить|недостаточно данных|cannot answer|can't help|unable to answer)"


def tokens(text: Column) -> Column:
    """Matching tokens: runs of letters, digits, underscores and apostrophes in lower case, one apostrophe form, edges stripped. Null gives none."""
    low = F.lower(F.translate(F.coalesce(text, F.lit("")), APOSTROPHES, "'" * len(APOSTROPHES)))
    bare = F.transform(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_']+"), F.lit(0)), lambda t: F.regexp_replace(t, "^'+|'+$", ""))
    return F.filter(bare, lambda t: t != "")


def collapsed(text: Column) -> Column:
    """Lower case, punctuation and symbols as spaces, runs of spaces as one, no outer spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bare(text: Column) -> Column:
    """Without spaces of any kind at its ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def duplicate_key(text: Column, tier: str) -> Column:
    """Key of the tier ``exact``, ``normalized`` (tokens) or ``masked`` (tokens, digits masked). A text without tokens is its own key."""
    if tier == "exact":
        return text
    words = F.concat_ws(" ", tokens(text))
    if tier == "masked":
        words = F.regexp_replace(words, "[0-9]", "#")
    elif tier != "normalized":
        raise ValueError(f"unknown tier {tier}")
    return F.when(words == "", text).otherwise(words)


def shingles(text: Column, width: int = 5) -> Column:
    """Distinct runs of ``width`` tokens; a shorter text is one shingle, a text without tokens has none."""

    def runs(words: Column) -> Column:
        n = F.size(words)
        every = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, width)))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(every))

    # the tokens are bound to a variable, so that they are computed once and not for every run
    return F.element_at(F.transform(F.array(tokens(text)), runs), 1)


def fixed_spans(text: Column, size: int, overlap: int) -> Column:
    """Sliding windows (start, end) of ``size`` characters; the last one is the first to reach the end."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    return window_spans(F.coalesce(F.length(text), F.lit(0)), size, overlap)


def window_spans(n: Column, size: int, overlap: int) -> Column:
    """The windows over ``n`` characters; none for none."""
    step = size - overlap
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    spans = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, n).alias("end")))
    return F.when(n > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def language(text: Column) -> Column:
    """uk by its own letters, else uk for any Cyrillic, en for any Latin letter, else null."""
    return F.when(text.rlike("[іїєґІЇЄҐ]"), "uk").when(text.rlike("[А-Яа-яЁё]"), "uk").when(text.rlike("[A-Za-z]"), "en")


def is_refusal(text: Column) -> Column:
    return F.coalesce(F.lower(F.translate(text, APOSTROPHES, "'" * len(APOSTROPHES))).rlike(REFUSAL), F.lit(False))


def overlap_counts(a: Column, b: Column) -> Column:
    """Tokens in common of two arrays, repeats included."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, t: n + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def iso_date(text: Column) -> Column:
    """The first date of a text as YYYY-MM-DD or DD.MM.YYYY, else null."""
    iso = F.regexp_extract(text, r"(\d{4})-(\d{2})-(\d{2})", 0)
    day = F.regexp_extract(text, r"(\d{2})\.(\d{2})\.(\d{4})", 0)
    turned = F.concat_ws("-", F.substring(day, 7, 4), F.substring(day, 4, 2), F.substring(day, 1, 2))
    return F.when(iso != "", iso).when(day != "", turned)


def month_ordinal(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts) - 1


def line_starts(text: Column) -> Column:
    """Lines of a text with the places where they start: ``array<struct<start, line>>``."""
    lines = F.split(text, "\n")

    def step(acc: Column, line: Column) -> Column:
        here = F.struct(acc["at"].alias("start"), line.alias("line"))
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), F.concat(acc["out"], F.array(here)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,line:string>>").alias("out"))
    return F.aggregate(lines, zero, step, lambda acc: acc["out"])


def around(text: Column, start: Column, end: Column, radius: int) -> Column:
    """The text from ``radius`` before a span to ``radius`` behind it, as far as there is any."""
    low = F.greatest(start - radius, F.lit(0))
    return F.substring(text, low + 1, F.least(end + radius, F.length(text)) - low)


def paragraphs(text: Column) -> Column:
    """Trimmed stretches between blank lines."""
    bare = F.transform(F.split(text, r"\n[ \t]*\n\s*"), lambda x: F.regexp_replace(x, r"^[ \t\n]+|[ \t\n]+$", ""))
    return F.filter(bare, lambda x: x != "")
