"""Normal forms of headings, terms, dates and amounts, JVM-side.

Defined results: null stays null; dates are checked for range, not for the calendar; an
impossible date is left as it is; lakh and crore keep their spoken form in brackets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed, text


def headings(body: Column) -> Column:
    return F.regexp_replace(body, r"(?m)^(#{1,6})[ \t]*(\S(?:.*?\S)?)[ \t]*:?[ \t]*$", "$1 $2")


def _forms(variant: str) -> str:
    escaped = "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in variant)
    return rf"(?<![\w-])(?i:{escaped})(?![\w-])"


def terms(body: Column, table: dict[str, tuple[str, ...]] = fixed.TERMS) -> Column:
    """Variants replaced by their term, longest first; the letter case of what stood there is kept."""
    for term, variants in table.items():
        for variant in sorted(variants, key=len, reverse=True):
            like = lambda m, term=term: (
                F.when((F.upper(m) == m) & (F.lower(m) != m) & (F.length(m) > 3), term.upper()).when(F.substring(m, 1, 1).rlike(r"\p{Lu}"), term[0].upper() + term[1:]).otherwise(term)
            )
            body = text.replace_matches(body, _forms(variant), like)  # a literal pattern is compiled once
    return body


def term_counts(body: Column, table: dict[str, tuple[str, ...]] = fixed.TERMS) -> Column:
    """Map of "variant -> term" to how often it stood in the text."""
    entries = [
        F.struct(F.lit(f"{variant} -> {term}").alias("key"), F.regexp_count(body, F.lit(_forms(variant))).alias("value"))
        for term, variants in table.items()
        for variant in sorted(variants, key=len, reverse=True)
    ]
    return F.map_filter(F.map_from_entries(F.array(*entries)), lambda _, n: n > 0)


_NUMERIC = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
_MONTH_FIRST = r"\b[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}\b"
_DAY_FIRST = r"\b\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}\b"


def _iso(match: Column, year: Column, month: Column, day: Column) -> Column:
    good = month.between(1, 12) & day.between(1, 31) & year.between(1900, 2100)
    return F.when(good, F.format_string("%04d-%02d-%02d", year, month, day)).otherwise(match)


def dates(body: Column, months: dict[str, int] = fixed.MONTHS) -> Column:
    """Day-first numeric dates and dates with a month name as yyyy-mm-dd."""
    number = F.create_map(*[F.lit(x) for pair in months.items() for x in pair])

    def numeric(m: Column) -> Column:
        part = F.split(m, "[/-]")
        year = F.get(part, F.lit(2)).cast("int")
        return _iso(m, F.when(year < 100, year + 2000).otherwise(year), F.get(part, F.lit(1)).cast("int"), F.get(part, F.lit(0)).cast("int"))

    def named(m: Column) -> Column:
        month = number[F.lower(F.regexp_extract(m, "([A-Za-z]+)", 1))]
        day = F.regexp_extract(m, r"(?:^|\D)(\d{1,2})(?:\D|$)", 1).cast("int")
        return _iso(m, F.regexp_extract(m, r"(\d{4})$", 1).cast("int"), month, day)

    for pattern, to in ((_NUMERIC, numeric), (_MONTH_FIRST, named), (_DAY_FIRST, named)):
        body = text.replace_matches(body, pattern, to)
    return body


_LARGE = r"(?i)(?:Rs\.?|INR|₹)?\s*\d+(?:\.\d+)?\s*(?:lakhs?|lacs?|crores?|cr)\b"


def currency(body: Column) -> Column:
    """Amounts as "Rs <digits>"; lakh and crore are written out, with the spoken form behind."""

    def large(m: Column) -> Column:
        amount, unit = F.regexp_extract(m, r"(\d+(?:\.\d+)?)", 1), F.lower(F.regexp_extract(m, r"(?i)([a-z]+)$", 1))
        value = (amount.cast("double") * F.when(unit.startswith("cr"), 10_000_000).otherwise(100_000)).cast("bigint")
        return F.concat(F.lit("Rs "), F.format_number(value, 0), F.lit(" ("), amount, F.lit(" "), unit, F.lit(")"))

    body = text.replace_matches(body, _LARGE, large)
    for pattern in (r"₹\s*(\d)", r"\bINR\s*(\d)", r"\bRs\.\s*(\d)"):
        body = F.regexp_replace(body, pattern, "Rs $1")
    return body


def normalize(body: Column) -> Column:
    return currency(dates(terms(headings(body))))
