"""Preparation of search queries as column functions, each step with a log of what it changed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: fixed values: Latin letters that look like Ukrainian ones
LOOKALIKE = ("abeikmhopctyx", "авеікмнорстух")
#: Entries that a glossary may have; it becomes part of the plan.
MOST_ENTRIES = 2_000
LOG = "array<struct<step:string,original:string,replacement:string>>"


def repaired(words: Column) -> Column:
    """Words that mix scripts in Cyrillic letters only; other words stay."""
    mixed = lambda w: w.rlike(r"\p{IsCyrillic}") & w.rlike("[a-z]")
    return F.transform(words, lambda w: F.when(mixed(w), F.translate(w, *LOOKALIKE)).otherwise(w))


def changes(step: str, before: Column, after: Column) -> Column:
    """Log of the words that a step changed, one entry each."""
    both = F.zip_with(before, after, lambda a, b: F.struct(F.lit(step).alias("step"), a.alias("original"), b.alias("replacement")))
    return F.filter(both, lambda x: x["original"] != x["replacement"])


def expanded(words: Column, glossary: dict[str, list[str]]) -> Column:
    """The forms to append: for every entry with a form in the words, those of its forms (canonical and aliases) that aren't."""
    if len(glossary) > MOST_ENTRIES:
        raise ValueError("too many entries: join the glossary instead")
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    out = F.array().cast("array<string>")
    for canonical, aliases in glossary.items():
        forms = list(dict.fromkeys([canonical, *aliases]))
        has = [text.contains(f" {f} ") for f in forms]
        hit = has[0]
        for h in has[1:]:
            hit = hit | h
        lacking = F.array_compact(F.array(*[F.when(~h, F.lit(f)) for h, f in zip(has, forms)]))
        out = F.concat(out, F.when(hit, lacking).otherwise(F.array().cast("array<string>")))
    return out


def prepared(query: Column, glossary: dict[str, list[str]]) -> Column:
    """Struct ``text, log`` of a query repaired and then expanded. Null and blank queries give an empty text."""
    words = T.tokens(query)
    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def steps(before: Column) -> Column:
        def then(after: Column) -> Column:
            def last(more: Column) -> Column:
                added = F.transform(more, lambda m: F.struct(F.lit("glossary").alias("step"), F.lit("").alias("original"), m.alias("replacement")))
                return F.struct(F.array_join(F.concat(after, more), " ").alias("text"), F.concat(changes("repair", before, after), added).cast(LOG).alias("log"))

            return bind(expanded(after, glossary), last)

        return bind(repaired(before), then)

    return bind(words, steps)
