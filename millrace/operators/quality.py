"""Gates that decide whether a text is worth keeping.

Defined results: null texts count as empty; an empty text has a chrome ratio of 1 and is
unusable; reasons are reported in the order in which the gates are asked.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed, text


def error_marker(body: Column) -> Column:
    """The first marker of an error page at the beginning of the text, or null."""
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, fixed.ERROR_SCAN_CHARS))
    return F.get(F.filter(F.array(*map(F.lit, fixed.ERROR_MARKERS)), lambda m: F.contains(head, m)), F.lit(0))


def chrome_ratio(body: Column) -> Column:
    """Share of the non-blank lines that are short and hold a phrase of page furniture."""
    chrome = lambda lines: F.filter(lines, lambda x: (text.word_count(x) <= 6) & text.contains_any(x, fixed.CHROME_PHRASES))
    lines = F.filter(F.transform(text.lines(body), lambda x: F.lower(text.stripped(x))), lambda x: x != "")
    return text.let(lines, lambda own: F.when(F.size(own) == 0, 1.0).otherwise(F.size(chrome(own)) / F.size(own)))


def usability(body: Column) -> Column:
    """Why the text is unusable, or null."""
    marker, n, ratio = error_marker(body), text.word_count(body), chrome_ratio(body)
    return (
        F.when(text.stripped(F.coalesce(body, F.lit(""))) == "", F.lit("empty"))
        .when(marker.isNotNull(), F.concat(F.lit("error page: "), marker))
        .when(n < fixed.MIN_USABLE_WORDS, F.concat(F.lit("only "), n.cast("string"), F.lit(" words")))
        .when(ratio > fixed.MAX_CHROME_RATIO, F.lit("mostly navigation"))
    )


def answerable(body: Column) -> Column:
    """Whether a prose passage could answer a question."""
    return text.let(text.stripped(F.coalesce(body, F.lit(""))), lambda bare: text.let(text.words(bare), lambda tokens: _answerable(bare, tokens)))


def _answerable(bare: Column, tokens: Column) -> Column:
    n, marks = F.size(tokens), F.regexp_count(bare, F.lit(fixed.CITATION))
    non_prose = F.length(bare) - F.length(F.regexp_replace(bare, r"[0-9%.,:;|/()\[\]-]", ""))
    real = F.size(F.filter(tokens, lambda w: (F.length(w) >= 4) & w.rlike(r"^\p{L}+$")))
    return (
        F.when(bare == "", False)
        .when(F.regexp_count(bare, F.lit(fixed.DOT_LEADERS)) >= fixed.MAX_DOT_LEADERS, False)
        .when((marks >= fixed.MIN_CITATIONS) & (marks / F.greatest(n, F.lit(1)) > fixed.MAX_CITATION_DENSITY), False)
        .when(n >= fixed.ANSWERABLE_WORDS, True)
        .when(non_prose / F.length(bare) > fixed.MAX_NON_PROSE, False)
        .otherwise(real >= 3)
    )
