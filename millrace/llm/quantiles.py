"""Percentiles of very large numeric columns from mergeable summaries.

A summary holds sorted values, each with the interval of ranks it may have. A task makes
one summary per group, keeps only the values that the permitted uncertainty needs, and
ships it. Summaries of a group are merged in levels of FAN tasks each (rank bounds add up)
and compressed again at every level, so that no task holds a list of all summaries of a
group, however many tasks there were; the permitted uncertainty grows from level to level.
The days are merged to the whole period from their daily summaries. The rank intervals are
carried along, so that each result states the error it may have.

Defined results: nulls and NaN are no values (infinities are); a null group is a group;
groups without a value have no row; ties are kept as equal values; a trace delivered
twice counts once, rows without trace id count each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks whose summaries of a group are merged in one list.
FAN = 64


class Summary:
    """Sorted values with the lowest and highest rank (from 1) each may have among n."""

    def __init__(self, values: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> None:
        self.values, self.low, self.high, self.n = values, low, high, int(n)

    @classmethod
    def of(cls, values: np.ndarray) -> Summary:
        values = np.sort(np.asarray(values, np.float64))
        ranks = np.arange(1, len(values) + 1, dtype=np.int64)
        return cls(values, ranks, ranks.copy(), len(values))

    @classmethod
    def merged(cls, parts: Sequence[Summary]) -> Summary:
        parts = [p for p in parts if p.n]
        if len(parts) < 2:
            return parts[0] if parts else cls.of(np.empty(0))
        # passing a value of a part changes what that part adds to both bounds of every later place
        values = np.concatenate([p.values for p in parts])
        low_steps = np.concatenate([np.diff(p.low, prepend=0) for p in parts])
        high_steps = np.concatenate([np.diff(p.high, append=p.n + 1) for p in parts])
        order = np.argsort(values, kind="stable")
        low = np.cumsum(low_steps[order])
        high = sum(int(p.high[0]) - 1 for p in parts) + np.cumsum(high_steps[order])
        high += 1 - high_steps[order]  # its own part bounds a value by its rank, not by that of the value behind it
        return cls(values[order], low, high, sum(p.n for p in parts))

    def at(self, share: float) -> tuple[float, int]:
        """The value for a percentile, and by how many ranks it may be wrong at most."""
        want = min(max(int(np.ceil(share * self.n)), 1), self.n)
        off = np.maximum(want - self.low, self.high - want)
        best = int(np.argmin(off))
        return float(self.values[best]), int(off[best])

    def compressed(self, share: float) -> Summary:
        """Drops values as long as neighbours stay within 2 * share * n ranks of each other."""
        room, n = int(2 * share * self.n), len(self.values)
        if n <= 2 or room < 2:
            return self
        keep, at = [0], 0
        while at < n - 1:
            to = int(np.searchsorted(self.high, self.low[at] + room, "right")) - 1
            at = max(at + 1, min(to, n - 1))
            keep.append(at)
        return Summary(self.values[keep], self.low[keep], self.high[keep], self.n)

    def pack(self) -> bytes:
        return np.int64(self.n).tobytes() + self.values.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> Summary:
        n, body = int(np.frombuffer(raw, np.int64, 1)[0]), np.frombuffer(raw, np.uint8)[8:]
        k = len(body) // 24
        return cls(body[: 8 * k].view(np.float64), body[8 * k : 16 * k].view(np.int64), body[16 * k :].view(np.int64), n)


def summarize(df: DataFrame, groups: dict[str, Column], values: dict[str, Column], error: float = 0.01) -> DataFrame:
    """One summary row per group and value column: the groups, metric, summary. An eighth of
    the error is spent in the tasks and three eighths in the levels of the merge."""
    names, metrics = list(groups), list(values)
    picked = df.select(*[c.alias(f"g{k}") for k, c in enumerate(groups.values())], *[c.cast("double").alias(f"v{k}") for k, c in enumerate(values.values())])
    kinds = {name: picked.schema[f"g{k}"].dataType.simpleString() for k, name in enumerate(names)}
    keys = [f"g{k}" for k in range(len(names))]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(*group, metrics[m], Summary.of(np.concatenate(parts)).compressed(error / 8).pack()) for (m, *group), parts in held.items()]
            held.clear()
            fields = [pa.field(k, t) for k, t in zip(keys, types)] + [pa.field("metric", pa.string()), pa.field("summary", pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [()] * len(fields), fields)], schema=pa.schema(fields))

        for batch in batches:
            types = [batch.schema.field(k).type for k in range(len(keys))]
            codes, labels = np.zeros(batch.num_rows, np.int64), [()]
            for k in range(len(keys)):
                coded = batch.column(k).dictionary_encode(null_encoding="encode")
                own = coded.dictionary.to_pylist()
                codes = codes * len(own) + coded.indices.to_numpy(zero_copy_only=False)
                labels = [(*a, b) for a in labels for b in own]
            for m in range(len(metrics)):
                column = batch.column(len(keys) + m).to_numpy(zero_copy_only=False)
                real = ~np.isnan(column)
                code, column = codes[real], column[real]
                order = np.argsort(code, kind="stable")
                code, column = code[order], column[order]
                edges = np.flatnonzero(np.diff(code)) + 1
                for part, value in zip(np.split(code, edges), np.split(column, edges)):
                    if len(part):
                        held.setdefault((m, *labels[part[0]]), []).append(value)
                size += len(column)
            if size > 4_000_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    schema = ", ".join([*(f"{k} {t}" for k, t in zip(keys, kinds.values())), "metric string", "summary binary"])
    out = picked.mapInArrow(local, schema).withColumn("_part", F.spark_partition_id())
    # the shuffle's partitions stand for the number of tasks; should a scan have more, the lists of the first level are longer
    levels = max(1, math.ceil(math.log(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2), FAN)))
    for level in range(1, levels + 1):
        by = [*keys, "metric"] if level == levels else [*keys, "metric", "_part"]
        dealt = out.withColumn("_part", F.pmod("_part", F.lit(FAN ** (levels - level)))) if level < levels else out
        out = merge(dealt, by, error / 8 + 3 * error / 8 * level / levels)
    for k, name in zip(keys, names):
        out = out.withColumnRenamed(k, name)
    return out


def merge(summaries: DataFrame, by: Sequence[str], share: float) -> DataFrame:
    """Merge the summaries of each group of `by`; `share` of n is the error after the compression."""
    fields = {c: summaries.schema[c].dataType.simpleString() for c in by}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, parts = None, None, []
        for batch in batches:
            schema, done = batch.schema, []
            columns = [batch.column(k).to_pylist() for k in range(len(by) + 1)]
            for *group, raw in zip(*columns):
                if parts and group != held:
                    done.append((*held, Summary.merged(parts).compressed(share).pack()))
                    parts = []
                held = group
                parts.append(Summary.unpack(raw))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done) if done else [()] * len(schema), schema)], schema=schema)
        if parts:
            last = (*held, Summary.merged(parts).compressed(share).pack())
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(last, schema)], schema=schema)

    # the summaries of a group are neighbours in one task, and each is of bounded size
    together = summaries.select(*by, "summary").repartition(*by).sortWithinPartitions(*by)
    return together.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in fields.items()), "summary binary"]))


def read_off(summaries: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Adds n, a column per wanted percentile, and rank_error, the largest rank error (as a share of n)
    that any of these answers can have."""
    kept = [c for c in summaries.columns if c != "summary"]

    @F.pandas_udf(", ".join(["n bigint", *(f"{c} double" for c in shares), "rank_error double"]))
    def answers(raw: pd.Series) -> pd.DataFrame:
        rows = []
        for s in map(Summary.unpack, raw):
            found = [s.at(q) for q in shares.values()]
            rows.append((s.n, *(v for v, _ in found), max(off for _, off in found) / s.n))
        return pd.DataFrame(rows, columns=["n", *shares, "rank_error"])

    return summaries.select(*kept, answers("summary").alias("a")).select(*kept, "a.*")
