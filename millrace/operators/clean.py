"""Cleaning of extracted text, line by line inside one row; only the lines repeated across
documents need a shuffle.

Defined results: null and empty texts clean to empty text; table rows (|...) are never
dropped; the order of lines is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import runtime
from millrace.functions import fixed, text


def is_chrome(line: Column, patterns: Sequence[str] = fixed.DROP_LINES, phrases: Sequence[str] = fixed.CHROME_PHRASES) -> Column:
    """A line that any pattern matches, or a short line with a phrase of page furniture."""

    def judged(bare: Column) -> Column:
        matched = bare.rlike("|".join(f"(?:{p})" for p in patterns))
        short = (text.word_count(bare) <= fixed.CHROME_LINE_WORDS) & text.contains_any(F.lower(bare), phrases)
        return ~bare.startswith("|") & (matched | short)

    return text.let(text.stripped(line), judged)


def is_navish(line: Column) -> Column:
    """Short, unpunctuated, no table row."""
    judged = lambda bare: (bare != "") & ~bare.startswith("|") & (text.word_count(bare) <= fixed.NAV_LINE_WORDS) & ~bare.rlike("[.!?:;]$")
    return text.let(text.stripped(line), judged)


def collapse_repeats(lines: Column) -> Column:
    """Without lines equal to the one before, letter case and outer blanks aside."""
    same = lambda line: F.lower(text.stripped(line))
    return text.let(lines, lambda own: F.filter(own, lambda line, i: (i == 0) | (same(line) != same(F.get(own, i - 1)))))


def drop_nav_runs(lines: Column, run: int = fixed.NAV_RUN) -> Column:
    """Without runs of `run` or more navigation-like lines. Runs are looked for in a string of one sign
    per line, so the cost grows with the number of lines only."""
    in_run = "|".join(f"(?<=n{{{k}}})n(?=n{{{run - 1 - k}}})" for k in range(run))

    def kept(own: Column) -> Column:
        signs = F.array_join(F.transform(own, lambda line: F.when(is_navish(line), "n").otherwise("x")), "")
        return text.let(F.split(F.regexp_replace(signs, in_run, "d"), ""), lambda marks: F.filter(own, lambda _, k: F.get(marks, k) != "d"))

    return text.let(lines, kept)


def clean_documents(df: DataFrame, body: str = "text", source_type: str = "source_type") -> DataFrame:
    """Adds clean_text, lines_in and lines_out. Runs of navigation lines go from web pages only."""
    staged = df.withColumn("_raw", text.lines(F.col(body)))
    staged = staged.withColumn("_kept", collapse_repeats(F.filter("_raw", lambda line: ~is_chrome(line))))
    staged = staged.withColumn("_kept", F.when(F.col(source_type) == "web_page", drop_nav_runs(F.col("_kept"))).otherwise(F.col("_kept")))
    tidy = F.transform("_kept", lambda line: text.stripped(F.regexp_replace(line, "[ \t ]+", " ")))
    joined = text.stripped(F.regexp_replace(F.array_join(tidy, "\n"), "\n{3,}", "\n\n"))
    return staged.select(*[df[c] for c in df.columns], joined.alias("clean_text"), F.size("_raw").alias("lines_in"), F.size("_kept").alias("lines_out"))


def repeated_lines(df: DataFrame, key: str, body: str, most_words: int = fixed.REPEATED_LINE_WORDS, documents: int = fixed.REPEATED_LINE_DOCUMENTS) -> DataFrame:
    """line and docs: short lines that stand in several documents. Each document sends a line
    once and counts are combined before the shuffle, so that a hot line costs a row per task."""
    own = F.array_distinct(F.filter(F.transform(text.lines(F.col(body)), text.stripped), lambda line: (line != "") & (text.word_count(line) <= most_words)))
    once = df.select(F.explode(own).alias("line"))
    return once.groupBy("line").agg(F.count("*").alias("docs")).where(F.col("docs") >= documents)


def trim_repeated(df: DataFrame, key: str, body: str, repeated: DataFrame, small: int = 200_000) -> DataFrame:
    """key and text without repeated lines. The list of lines is broadcast up to `small` lines;
    beyond, the lines are joined by a shuffle."""
    numbered = df.select(F.col(key).alias("_key"), F.posexplode(text.lines(F.col(body))).alias("_n", "_line"))
    listed = runtime.small(repeated.select(F.col("line").alias("_listed")), small)
    kept = numbered.join(listed, text.stripped(F.col("_line")) == F.col("_listed"), "left_anti")
    merged = kept.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_n", "_line"))).alias("_lines"))
    body_of = F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n")
    out = df.select(F.col(key).alias("_key")).join(merged, "_key", "left")
    return out.select(F.col("_key").alias(key), F.coalesce(body_of, F.lit("")).alias("text"))
