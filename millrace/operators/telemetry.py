"""Stage durations and exact nearest-rank percentiles without collecting a group.

Defined results: nulls are no samples; a stage marked twice keeps its last duration; the
rank is round(f * (n - 1)) with halves to even, or its floor, or the floor of f * n, where asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import fixed, text
from millrace.runtime import materialize, small


def stage_durations(df: DataFrame, key: str, marks: str) -> DataFrame:
    """key, stage and ms from cumulative marks (map of stage to ms): the distance to the mark before."""
    ordered = F.array_sort(F.transform(F.map_entries(marks), lambda e: F.struct(e["value"].alias("ms"), e["key"].alias("stage"))))
    spans = text.let(ordered, lambda own: F.transform(own, lambda e, i: F.struct(e["stage"].alias("stage"), F.round(e["ms"] - F.when(i > 0, F.get(own, i - 1)["ms"]).otherwise(0.0), 2).alias("ms"))))
    return df.select(F.col(key), F.explode(spans).alias("s")).select(key, "s.stage", "s.ms")


#: Buckets between the smallest and the largest value of a group.
BUCKETS = 4096


def percentiles(df: DataFrame, group: Sequence[str], value: str, shares: dict[str, float], floor: bool = False, upper: bool = False) -> DataFrame:
    """Exact percentiles per group. Values are counted in BUCKETS buckets over the range of their group
    first; only the buckets that hold a wanted rank are ranked, in windows per bucket, so no group is
    sorted in one task. Ranges are cut on a logarithmic scale around the median's order of magnitude, so
    that a few extreme values don't push all others into one bucket."""
    scale = F.signum("v") * F.log1p(F.abs("v") * 1000)
    plain = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("v")).withColumn("u", scale)
    ends_ = plain.groupBy(*[F.col(c).alias(f"_{c}") for c in group]).agg(F.min("u").alias("_low"), F.max("u").alias("_high"))
    matched = _same(plain, list(group), [f"_{c}" for c in group])
    ranged = plain.join(small(materialize(ends_)), matched) if group else plain.crossJoin(F.broadcast(ends_))  # one row
    place_ = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("u") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BUCKETS)).otherwise(F.lit(0))
    rows = ranged.select(*group, "v", place_.cast("bigint").alias("bucket"))
    counted = rows.groupBy(*group, "bucket").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    by = W.partitionBy(*group)
    counted = counted.withColumns({"total": F.sum("n").over(by), "before": F.coalesce(F.sum("n").over(by.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    place = lambda f: F.floor(f * F.col("total")) if upper else F.floor(f * (F.col("total") - 1)) if floor else F.bround(f * (F.col("total") - 1), 0)
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(f).cast("bigint").alias("at")) for name, f in shares.items()]))
    asked = counted.select(*group, "bucket", "before", "n", wanted.alias("w")).where("w.at >= before AND w.at < before + n")
    asked = materialize(asked.select(*group, "bucket", F.col("w.name").alias("name"), (F.col("w.at") - F.col("before") + 1).alias("place")))
    inside = rows.join(small(asked.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("bucket").alias("_b")).distinct()), _same(rows, [*group, "bucket"], [*(f"_{c}" for c in group), "_b"]), "left_semi")
    numbered = inside.withColumn("place", F.row_number().over(W.partitionBy(*group, "bucket").orderBy("v")))
    renamed = asked.withColumnsRenamed({c: f"_{c}" for c in [*group, "bucket", "place"]})
    answers = numbered.join(small(renamed), _same(numbered, [*group, "bucket", "place"], [f"_{c}" for c in [*group, "bucket", "place"]]))
    named = answers.groupBy(*group).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])
    ends = counted.groupBy(*group).agg(F.min("low").alias("min"), F.max("high").alias("max"), F.sum("n").alias("samples"))
    other = ends.withColumnsRenamed({c: f"_{c}" for c in group})
    return named.join(other, _same(named, list(group), [f"_{c}" for c in group])).select(*group, *shares, "min", "max", "samples") if group else named.crossJoin(ends)


def _same(left: DataFrame, own: Sequence[str], other: Sequence[str]):
    condition = F.lit(True)
    for a, b in zip(own, other):
        condition = condition & left[a].eqNullSafe(F.col(b))
    return condition


def live(traces: DataFrame, stages: Sequence[str] = fixed.LIVE_STAGES) -> DataFrame:
    """trace_id, asr_provider and ms, the sum of the live stages; traces without any are left out."""
    own = F.map_filter("stages", lambda k, v: k.isin(*stages) & v.isNotNull())
    total = F.round(F.aggregate(F.map_values(own), F.lit(0.0), lambda a, b: a + b), 6)
    return traces.where(F.size(own) > 0).select("trace_id", "asr_provider", total.alias("ms"))


def latency_summary(traces: DataFrame, stages: str = "stages", group: Sequence[str] = ()) -> DataFrame:
    """p50, p95, min, max and samples of every stage."""
    each = traces.select(*group, F.explode(stages).alias("stage", "ms"))
    return percentiles(each, [*group, "stage"], "ms", {"p50": 0.5, "p95": 0.95})
