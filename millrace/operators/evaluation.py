"""Comparison of what was said with what was recognised.

The alignment is the matching-block alignment of the standard library (difflib), which no
Column function has; it runs in Arrow batches. Defined results: an empty reference has an
error rate of 0; nulls count as empty.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import telemetry

_TOKEN = re.compile(r"[\w']+")


def _tokens(said: str | None) -> list[str]:
    return _TOKEN.findall((said or "").lower())


_RESULT = T.StructType([T.StructField("wer", T.DoubleType()), T.StructField("differences", T.ArrayType(T.StringType()))])


def _aligned(spoken: pd.Series, heard: pd.Series) -> pd.DataFrame:
    rates, changes = [], []
    for a, b in zip(map(_tokens, spoken), map(_tokens, heard)):
        steps = difflib.SequenceMatcher(None, a, b).get_opcodes()
        matched = sum(i2 - i1 for tag, i1, i2, _, _ in steps if tag == "equal")
        rates.append((max(len(a), len(b)) - matched) / len(a) if a else 0.0)
        changes.append([f"{' '.join(a[i1:i2]) or '—'} → {' '.join(b[j1:j2]) or '—'}" for tag, i1, i2, j1, j2 in steps if tag != "equal"])
    return pd.DataFrame({"wer": rates, "differences": changes})


def compare(spoken: Column, heard: Column) -> Column:
    """Word error rate (wer), and each differing stretch as "was → now" (differences)."""
    return F.pandas_udf(_aligned, _RESULT)(spoken, heard)


def distribution(scores: DataFrame, group: str, value: str) -> DataFrame:
    """min, p10, median, p90, max and samples of each group, by the floor-index percentile."""
    return telemetry.percentiles(scores, [group], value, {"p10": 0.1, "median": 0.5, "p90": 0.9}, floor=True)


def expectations(report: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, measure, least, found and met: expected has key, measure and the least value; report has a
    column for each measure. A missing call meets nothing."""
    measures = [c for c in report.columns if c != key]
    long = report.select(F.col(key), F.explode(F.map_from_arrays(F.array(*map(F.lit, measures)), F.array(*[F.col(c).cast("double") for c in measures]))).alias("measure", "found"))
    joined = expected.join(long, [key, "measure"], "left")
    return joined.select(key, "measure", "least", "found", F.coalesce(F.col("found") >= F.col("least"), F.lit(False)).alias("met"))


def terms_preserved(heard: Column, terms: Column) -> Column:
    return F.filter(terms, lambda t: F.contains(F.lower(heard), F.lower(t)))


def exact_match(spoken: Column, heard: Column) -> Column:
    plain = lambda c: F.rtrim(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("."))
    return plain(spoken) == plain(heard)
