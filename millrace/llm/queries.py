"""Queries pN_... over the test tables, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import body, language, lines, neardup, packing, pii, quantiles, sentences, split, tokens
from millrace.runtime import materialize, ship, table

_DOCUMENT, _CHUNK = (2000, 16_000), (400, 3200)
_SHARES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(table(spark, d, "documents"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return lines.without_repeated_lines(table(spark, d, "documents")).select("doc_id", "text", "lines_removed")


def _split_items(spark: SparkSession, d: str) -> DataFrame:
    documents, chunks = table(spark, d, "documents"), table(spark, d, "chunks")
    items = documents.select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_id"), F.lit(None).cast("string").alias("section_path"), F.col("text").alias("content"))
    return items.unionByName(chunks.select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("row_id"), "section_path", "content"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.pieces(_split_items(spark, d), ["tbl", "row_id", "section_path"], "content")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that the splitter cut, seen from their second piece, and that exceed the limit of their table."""
    words, chars = F.col("item_words"), F.col("item_chars")
    over = lambda most: (words > most[0]) | (chars > most[1])
    second = p2_pieces(spark, d).where(F.col("piece_no") == 1)
    return second.where(F.when(F.col("tbl") == "chunks", over(_CHUNK)).otherwise(over(_DOCUMENT))).select("tbl", "row_id")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    traces = table(spark, d, "traces").select("trace_id", "logged_at", "asr_provider", F.to_date("started_wall").alias("day"), "total_ms", F.col("stages")["asr"].alias("asr"))
    # of a trace logged more than once the first log counts, ties by its values; rows without trace id count each
    first = F.min(F.struct("logged_at", "asr_provider", "day", "total_ms", "asr")).alias("t")
    once = traces.where("trace_id IS NOT NULL").groupBy("trace_id").agg(first).select("t.asr_provider", "t.day", "t.total_ms", "t.asr")
    once = once.unionByName(traces.where("trace_id IS NULL").drop("trace_id", "logged_at"))
    daily = materialize(quantiles.summarize(once, {"asr_provider": F.col("asr_provider"), "day": F.col("day")}, {"total_ms": F.col("total_ms"), "asr": F.col("asr")}))
    monthly = quantiles.merge(daily.withColumn("month", F.trunc("day", "month")), ["asr_provider", "metric", "month"], 0.00625)
    whole = quantiles.merge(monthly, ["asr_provider", "metric"], 0.0075).withColumn("day", F.lit(None).cast("date"))
    both = daily.withColumn("period", F.lit("day")).unionByName(whole.withColumn("period", F.lit("all")))
    return quantiles.read_off(both, _SHARES)


def _personal(spark: SparkSession, d: str) -> DataFrame:
    """tbl, row_id, masked and items of every text that may hold personal data."""
    rows = None
    for name, key, text, field in (("records", "record_id", "content", False), ("call_turns", "turn_id", "caller", False), ("sample_leads", "lead_id", "phone", True)):
        part = table(spark, d, name).select(F.struct(F.lit(name).alias("tbl"), F.col(key).alias("row_id")).alias("key"), F.col(text).alias("text"), F.lit(field).alias("field"))
        rows = part if rows is None else rows.unionByName(part)
    return pii.personal_data(rows, "key", "text", "field").select("key.*", "masked", "items")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    items = _personal(spark, d).select("tbl", "row_id", F.explode("items").alias("i"))
    return items.select("tbl", "row_id", "i.kind", "i.value").distinct()


def p4_masked(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("tbl", "row_id", F.col("masked").alias("text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    links = neardup.near_duplicates(table(spark, d, "records"), "record_id", "content")
    return neardup.record_pairs(links, expand_copies=None).withColumnsRenamed({"a": "record_a", "b": "record_b"})


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.record_groups(neardup.near_duplicates(table(spark, d, "records"), "record_id", "content"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return body.main_bodies(table(spark, d, "documents").where("source_type = 'web_page'"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", F.explode("hidden").alias("line_no"))


def p6_bodies(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", "page_title", "body")


def _languages(spark: SparkSession, d: str, prose: str | None = None) -> DataFrame:
    """tbl, row_id, lang as given, and what was detected, for every row of the three tables; `prose`
    narrows the records."""
    scorer = language.fit(table(spark, d, "lang_samples"))
    rows = None
    for name, key, text in (("documents", "doc_id", "text"), ("records", "record_id", "content"), ("call_turns", "turn_id", "caller")):
        part = table(spark, d, name).where(prose) if name == "records" and prose else table(spark, d, name)
        part = part.select(F.lit(name).alias("tbl"), F.col(key).cast("string").alias("row_id"), F.col("lang"), F.col(text).alias("text"))
        rows = part if rows is None else rows.unionByName(part)
    keyed = rows.select(F.struct("tbl", "row_id", "lang").alias("key"), "text")
    return language.languages(keyed, "key", "text", scorer).select("key.*", "detected", "confidence", "n_words", "present", "segments")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _languages(spark, d, "kind = 'prose'").where("detected IS NOT NULL AND (tbl <> 'call_turns' OR n_words >= 4)")
    label = F.lower(F.trim(F.split("lang", "-")[0]))
    wrong = F.col("lang").isNull() | label.isin("", "und") | (label != F.col("detected"))
    shown = F.when(F.size("present") > 0, F.col("present")).otherwise(F.array("detected"))
    return rows.where(wrong | (F.size("present") > 1)).select("tbl", "row_id", F.explode(shown).alias("lang")).distinct()


def p7_languages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).drop("n_words", "present").withColumnRenamed("lang", "given")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    counted = materialize(tokens.token_counts(table(spark, d, "documents")))
    return packing.pack(counted, "doc_id", "n_tokens", 2048)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"), content=False).select("doc_id", "start_pos")


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


_ALL = [p1_found, p1_clean, p2_found, p2_pieces, p3_percentiles, p4_found, p4_masked, p5_found, p5_groups, p6_found, p6_bodies, p7_found, p7_languages, p8_ids, p9_containers, p10_found, p10_sentences]


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: _shipped(query) for query in _ALL}


_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def oracle_sql() -> dict[str, str]:
    words = f"len(list_filter(regexp_split_to_array(t, '{_BLANK}'), lambda x: x <> ''))"
    return {
        "p1_found": f"""
            WITH d AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                              generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
            n AS (SELECT doc_id, source, line_no, trim(regexp_replace(regexp_replace(lower(line), '{_BLANK}', ' ', 'g'), '[0-9]+', '0', 'g')) AS k FROM d),
            c AS (SELECT * FROM n WHERE k <> '' AND k[1] NOT IN ('#', '|'))
            SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM c
            JOIN (SELECT source, k FROM c GROUP BY source, k HAVING count(DISTINCT doc_id) >= 5) r
              ON c.k = r.k AND c.source IS NOT DISTINCT FROM r.source""",
        "p2_found": f"""
            SELECT 'documents' AS tbl, doc_id AS row_id FROM (SELECT doc_id, text AS t FROM documents) WHERE {words} > 2000 OR length(t) > 16000
            UNION ALL
            SELECT 'chunks', chunk_id FROM (SELECT chunk_id, content AS t FROM chunks) WHERE {words} > 400 OR length(t) > 3200""",
        "p5_found": """
            WITH w AS (SELECT record_id, regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM records),
            s AS (SELECT DISTINCT record_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w),
            n AS (SELECT record_id, count(*) AS n FROM s GROUP BY record_id),
            p AS (SELECT a.record_id AS a, b.record_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.record_id < b.record_id GROUP BY 1, 2)
            SELECT a AS record_a, b AS record_b FROM p JOIN n x ON x.record_id = a JOIN n y ON y.record_id = b
            WHERE 4 * m >= 3 * (x.n + y.n - m)""",
    }
