"""The two stages of a corpus build. Between them the documents are a table, so that records
can be built again without collecting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import clean, dedupe, normalize, privacy, quality, records
from millrace.runtime import materialize
from millrace.sources import files


def collect(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that stay (text cleaned, masked, normalised; pii_types), and ref, stage, reason of the others.

    Web pages are judged, cleaned and freed of lines repeated across documents; every text is
    masked, exports of personal data are set aside, and duplicates go last."""
    judged = documents.withColumn("reason", F.when(F.col("source_type") == "web_page", quality.usability(F.col("text"))))
    rejected = judged.where("reason IS NOT NULL").select(F.col("doc_id").alias("ref"), "reason")
    usable = clean.clean_documents(judged.where("reason IS NULL").drop("reason"))
    usable = materialize(usable.drop("text").withColumnRenamed("clean_text", "text"))
    web = usable.where("source_type = 'web_page'")
    trimmed = clean.trim_repeated(web, "doc_id", "text", materialize(clean.repeated_lines(web, "doc_id", "text")))
    joined = usable.join(trimmed.withColumnRenamed("text", "trimmed"), "doc_id", "left")
    whole = joined.withColumn("text", F.coalesce("trimmed", "text")).drop("trimmed")
    scanned = materialize(privacy.scan(whole))
    set_aside = scanned.where("quarantined").select(F.col("doc_id").alias("ref"), F.lit("personal data export").alias("reason"))
    kept = scanned.where("NOT quarantined").withColumn("text", normalize.normalize(F.col("masked"))).withColumn("pii_types", F.array_sort(F.map_keys("findings")))
    kept = materialize(kept.drop("masked", "findings", "found", "quarantined"))
    pairs = materialize(dedupe.near_duplicates(kept, "doc_id", "text"))
    copies = pairs.select(F.col("dropped").alias("ref"), F.concat(F.col("kind"), F.lit(" duplicate of "), F.col("kept").cast("string")).alias("reason"))
    stay = kept.join(pairs.select(F.col("dropped").alias("doc_id")), "doc_id", "left_anti")
    return stay, files.excluded((rejected, "extract"), (set_aside, "pii"), (copies, "duplicate"))


def build(documents: DataFrame) -> DataFrame:
    """Records of collected documents."""
    return records.build_records(documents)


def ingestion_summary(before: DataFrame, after: DataFrame, left_out: DataFrame) -> DataFrame:
    """One row: documents read and kept, rows left out by stage, words, documents with personal data."""
    kept = after.agg(F.count("*").alias("kept"), F.sum("lines_in").alias("lines_in"), F.sum("lines_out").alias("lines_out"), F.count_if(F.size("pii_types") > 0).alias("with_pii"))
    out = left_out.agg(*[F.count_if(F.col("stage") == s).alias(f"left_out_{s}") for s in ("extract", "pii", "duplicate")])
    return before.agg(F.count("*").alias("read")).crossJoin(kept).crossJoin(out)  # three rows of one row each
