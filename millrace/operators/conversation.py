"""Turns of conversations: history windows, first-seen values, merged slots, unsupported figures.

Defined results: a turn delivered twice counts once (turn_id); turns are ordered by turn
index, then turn id; null and placeholder values are no slot values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import fixed, text


def once(turns: DataFrame, key: str = "turn_id", at: str = "said_at") -> DataFrame:
    """One row per key: of rows that differ the earliest, then the one of the smaller hash."""
    rest = [F.col(c).alias(c) for c in turns.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(F.col(at), F.xxhash64(*[c for c in turns.columns if c != key])))
    return turns.groupBy(key).agg(first.alias("_row")).select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in turns.columns])


def history(turns: DataFrame, size: int = fixed.HISTORY_TURNS) -> DataFrame:
    """turn_id and the up to `size` turns before it, as role and content."""
    before = W.partitionBy("call_id").orderBy("turn_index", "turn_id").rowsBetween(-size, -1)
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("caller").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("agent").alias("content")))
    kept = F.filter(said, lambda m: (m["content"].isNotNull()) & (m["content"] != ""))
    return turns.select("turn_id", F.flatten(F.collect_list(kept).over(before)).alias("history"))


def first_seen(turns: DataFrame, value: str) -> DataFrame:
    """Each value of a call with the turn it first stands in, and its position among the call's values."""
    each = turns.where(F.col(value).isNotNull()).groupBy("call_id", F.col(value).alias("value")).agg(F.min(F.struct("turn_index", "turn_id")).alias("f"))
    order = W.partitionBy("call_id").orderBy("f.turn_index", "f.turn_id", "value")
    return each.select("call_id", "value", F.col("f.turn_index").alias("turn_index"), F.row_number().over(order).alias("position"))


def merge_slots(statements: DataFrame) -> DataFrame:
    """From call_id, turn_index, slot and value: the first value of each slot, and the later values that
    differ from it in more than letter case, in order."""
    real = statements.where(F.col("value").isNotNull() & ~F.lower(F.trim("value")).isin("", "null", "unknown")).withColumn("value", F.trim("value"))
    first = real.groupBy("call_id", "slot").agg(F.min_by("value", F.struct("turn_index", "value")).alias("first"), F.array_sort(F.collect_set(F.struct("turn_index", "value"))).alias("all"))
    others = F.filter("all", lambda x: F.lower(x["value"]) != F.lower(F.col("first")))
    return first.select("call_id", "slot", F.col("first").alias("value"), F.transform(others, lambda x: x["value"]).alias("conflicts"))


def conflict_list(turns: DataFrame) -> DataFrame:
    """call_id and its conflicts, each once, in the order of the turns."""
    ordered = F.array_sort(F.collect_list(F.struct("turn_index", "turn_id", "conflicts")))
    grouped = turns.where(F.size("conflicts") > 0).groupBy("call_id").agg(ordered.alias("o"))
    return grouped.select("call_id", F.array_distinct(F.flatten(F.transform("o", lambda x: x["conflicts"]))).alias("conflicts"))


def unsupported_figures(reply: Column, context: Column, known: Column) -> Column:
    """Figures with a unit or currency in the reply that neither the context nor the known values have."""
    return text.let(F.regexp_replace(F.lower(F.coalesce(context, F.lit(""))), r"[,\s]+", " "), lambda hay: _stray(reply, hay, known))


def _stray(reply: Column, hay: Column, known: Column) -> Column:
    numbers = F.transform(F.filter(F.coalesce(known, F.array().cast("array<string>")), lambda v: v.rlike(r"\d")), lambda v: F.regexp_replace(v, r"[^\d.]", ""))
    reply = F.coalesce(reply, F.lit(""))
    found = F.concat(*[
        F.arrays_zip(F.regexp_extract_all(reply, F.lit(p), F.lit(0)).alias("whole"), F.regexp_extract_all(reply, F.lit(p), F.lit(1)).alias("number"))
        for p in (fixed.FIGURE, fixed.CURRENCY_FIGURE)
    ])

    def stray(m: Column) -> Column:
        bare = F.rtrim(F.replace(m["number"], F.lit(",")), F.lit("."))
        grouped = F.when(bare.rlike(r"^\d{1,18}$"), F.replace(F.format_number(bare.cast("bigint"), 0), F.lit(","), F.lit(" "))).otherwise(bare)
        spaced = F.replace(F.lower(m["number"]), F.lit(","), F.lit(" "))
        return ~F.array_contains(numbers, bare) & ~(F.contains(hay, bare) | F.contains(hay, spaced) | F.contains(hay, grouped))

    return F.transform(F.filter(found, stray), lambda m: F.trim(m["whole"]))


def call_report(turns: DataFrame) -> DataFrame:
    """Counts of every call."""
    return turns.groupBy("call_id").agg(
        F.count("*").alias("turns"), F.count_if("abstained").alias("abstained"), F.count_if(F.size("conflicts") > 0).alias("with_conflicts"),
        F.countDistinct("intent").alias("intents"), F.count_if(F.col("answer_source") == "insufficient_context").alias("insufficient"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    )
