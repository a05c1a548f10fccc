"""Records of a knowledge base: category, version, id, checksum, and the statistics of a build.

Defined results: a record without any category word takes its hint, or the first category;
ties go to the hint if it is among the best, else to the order of the table; null sections,
contents and hints count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed, text
from millrace.operators import chunk, dedupe, quality


def category(section: Column, content: Column, hint: Column, table: dict[str, tuple[str, ...]] = fixed.CATEGORIES) -> Column:
    facts = F.struct(
        F.lower(F.coalesce(section, F.lit(""))).alias("heading"), F.lower(F.substring(F.coalesce(content, F.lit("")), 1, fixed.BODY_SCAN_CHARS)).alias("body"), F.coalesce(hint, F.lit("")).alias("hint")
    )
    return text.let(facts, lambda x: _category(x["heading"], x["body"], x["hint"], table))


def _category(heading: Column, body: Column, hint: Column, table: dict[str, tuple[str, ...]]) -> Column:
    hits = lambda words, where: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(where, w)))
    scores = {
        name: hits(words, heading) * fixed.HEADING_WEIGHT + hits(words, body) * fixed.BODY_WEIGHT + F.when(hint == name, fixed.HINT_WEIGHT).otherwise(0)
        for name, words in table.items()
    }
    listed = F.array(*[F.struct(score.alias("score"), F.lit(name).alias("name")) for name, score in scores.items()])

    def winner(scored: Column) -> Column:
        best = F.array_max(scored)["score"]
        winners = F.transform(F.filter(scored, lambda s: s["score"] == best), lambda s: s["name"])
        first = F.when(F.array_contains(winners, hint), hint).otherwise(F.get(winners, F.lit(0)))
        return F.when(best > 0, first).when(hint.isin(*table), hint).otherwise(F.lit(next(iter(table))))

    return text.let(listed, winner)


def version(body: Column) -> Column:
    found = F.regexp_extract(F.coalesce(body, F.lit("")), r"(?i)\bVersion\s+(\d+(?:\.\d+)?)", 1)
    return F.when(found == "", "1.0").otherwise(found)


def effective_date(body: Column) -> Column:
    found = F.regexp_extract(F.coalesce(body, F.lit("")), r"(?i)\b(?:Effective|Last updated)\b[^\n]{0,20}?(\d{4}-\d{2}-\d{2})", 1)
    return F.when(found != "", found)


def build_records(documents: DataFrame) -> DataFrame:
    """Records of collected documents (doc_id, text, title, source_type, url, category_hint, lang, pii_types):
    chunked, the unanswerable left out, classified, duplicates dropped. Every record of a document carries
    the kinds that were masked in it; a null list counts as none. `tables`, if there, is chunked as well."""
    facts = documents.select("doc_id", F.coalesce("pii_types", F.array().cast("array<string>")).alias("pii_types"), F.col("title").alias("doc_title"), F.col("url").alias("source_url"), "source_type", "category_hint", "lang", version(F.col("text")).alias("version"), effective_date(F.col("text")).alias("effective_date"))
    apart = "tables" if "tables" in documents.columns else None
    parts = chunk.chunk_documents(documents, tables=apart).where((F.col("kind") == "table") | quality.answerable(F.col("content")))
    joined = parts.join(facts, "doc_id")
    named = joined.withColumn("category", category(F.col("section_path"), F.col("content"), F.col("category_hint")))
    last = F.substring(F.element_at(F.split("section_path", " > "), -1), 1, 120)
    records = named.select(
        F.format_string("kb_%s_%s_%03d", "category", F.col("doc_id").cast("string"), "ordinal").alias("record_id"),
        F.when(last == "", F.substring("doc_title", 1, 120)).otherwise(last).alias("title"), "content", "category", "source_url", "source_type", "section_path", "version", "effective_date",
        text.checksum(F.col("content")).alias("checksum"), (F.size("pii_types") > 0).alias("pii"), F.array_sort("pii_types").alias("pii_types"), "lang", "kind", "doc_id", "ordinal", text.word_count(F.col("content")).alias("word_count"),
    )
    return dedupe.survivors(records, "record_id", "content")


def build_stats(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count("*").alias("records"), F.countDistinct("doc_id").alias("documents"), F.count_if(F.col("kind") == "table").alias("tables"),
        F.count_if("pii").alias("pii_records"), F.sum(text.word_count(F.col("content"))).alias("words"),
    )


def repeated_titles(records: DataFrame) -> DataFrame:
    """title (trimmed, in small letters), records and documents of titles that stand on several records."""
    named = records.withColumn("title", F.lower(F.trim("title"))).where("title <> ''")
    return named.groupBy("title").agg(F.count("*").alias("records"), F.count_distinct("doc_id").alias("documents")).where("records > 1")


def superseded(records: DataFrame, previous: DataFrame) -> DataFrame:
    """Records of a previous build whose place (doc_id, ordinal) now has other content: record_id, superseded_by."""
    old = previous.select("doc_id", "ordinal", F.col("record_id"), F.col("checksum").alias("was"))
    new = records.select("doc_id", "ordinal", F.col("record_id").alias("superseded_by"), "checksum")
    return old.join(new, ["doc_id", "ordinal"]).where("was <> checksum").select("record_id", "superseded_by")
