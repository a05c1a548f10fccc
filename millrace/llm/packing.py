"""Filling fixed-capacity containers with items.

Only lengths matter, so the plan is made on the histogram of lengths, which has at most
capacity + 1 bins whatever the number of items: for the longest length left, the gap is
looked up among the single, pair and triple sums of the lengths still available, and as
many containers as the availability counts allow are filled exactly at once; where no
sum fits exactly, the longest fitting lengths follow (best fit). The items then take
their places by their rank among the items of their length, which is a distributed
window over (length, salt) plus the offsets of the salts.

Defined results: an item longer than the capacity is cut into full containers and one
remainder, every other item stays whole; items of length 0 (null and empty texts) take a
position of length 0 behind the others; without items there is no container; a repeated
row is an item again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.runtime import materialize


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Contents of the containers and how many containers have them; `counts[n]` items have
    length n, the last index is the capacity."""
    left, capacity = counts.astype(np.int64).copy(), len(counts) - 1
    out: list[tuple[tuple[int, ...], int]] = []

    def take(content: tuple[int, ...]) -> None:
        need: dict[int, int] = {}
        for n in content:
            need[n] = need.get(n, 0) + 1
        times = min(int(left[n]) // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * times
        out.append((content, times))

    def pair(total: int, most: int) -> tuple[int, int] | None:
        """The pair of available lengths with this sum whose longer one is longest."""
        a = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        if not len(a):
            return None
        fits = np.flatnonzero((left[a] > 0) & (left[total - a] > (a == total - a)))
        return (int(a[fits[0]]), int(total - a[fits[0]])) if len(fits) else None

    def exact(gap: int, most: int) -> tuple[int, ...] | None:
        if gap <= most and left[gap] > 0:
            return (gap,)
        if two := pair(gap, most):
            return two
        for a in range(min(most, gap - 2), (gap - 1) // 3, -1):
            if left[a] > 0:
                left[a] -= 1
                two = pair(gap - a, a)
                left[a] += 1
                if two:
                    return (a, *two)
        return None

    for longest in range(capacity, 0, -1):
        while left[longest] > 0:
            gap = capacity - longest
            if not gap:
                take((longest,))
                continue
            left[longest] -= 1
            rest = exact(gap, longest)
            if rest is None:
                rest = ()
                while gap:
                    fitting = np.flatnonzero(left[1 : min(gap, longest) + 1])
                    if not len(fitting):
                        break
                    n = int(fitting[-1]) + 1
                    left[n] -= 1
                    rest, gap = (*rest, n), gap - n
                    if gap and (tail := exact(gap, n)):
                        for m in rest:
                            left[m] += 1
                        rest = (*rest, *tail)
                        break
                else:
                    for m in rest:
                        left[m] += 1
                    left[longest] += 1
                    take((longest, *rest))
                    continue
                if gap and sum(rest) + longest < capacity:
                    for m in rest:
                        left[m] += 1
            left[longest] += 1
            take((longest, *rest))
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """container, position, key, piece_no, start and length of every piece of every item."""
    salts = max(64, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    base = items.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"))
    full = F.when(F.col("size") > capacity, F.ceil(F.col("size") / capacity)).otherwise(F.lit(1))
    pieces = base.select("key", "size", F.explode(F.sequence(F.lit(0), (full - 1).cast("int"))).alias("piece_no"))
    start = F.col("piece_no").cast("bigint") * capacity
    pieces = pieces.select(
        "key", "piece_no", start.alias("start"), F.least(F.lit(capacity), F.col("size") - start).cast("int").alias("length"),
        F.pmod(F.xxhash64("key", "piece_no"), F.lit(salts)).cast("int").alias("salt"),
    )
    cells = materialize(pieces.groupBy("length", "salt").count())
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cells.groupBy("length").agg(F.sum("count")).collect():  # capacity + 1 rows at most
        counts[length] = n
    contents = plan(counts)
    # slots: for each length the runs of ranks that a content's place takes
    used, slots, first = np.zeros(capacity + 1, np.int64), [], 0
    firsts, widths = [], []
    for content, times in contents:
        for position, n in enumerate(content):
            slots.append((n, used[n], first, position))
            used[n] += times
        firsts.append(first)
        widths.append(len(content))
        first += times
    slots.sort()
    lengths, ranks, containers, positions = (np.array(x, np.int64) for x in (zip(*slots) if slots else ([], [], [], [])))
    code, total = (lengths << 44) + ranks, max(first, 1)
    starts_of, widths_of = np.array(firsts, np.int64), np.array(widths, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))
            if len(code):
                at = np.maximum(np.searchsorted(code, (length << 44) + rank, "right") - 1, 0)
                container, position = containers[at] + rank - ranks[at], positions[at].copy()
            else:
                container, position = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            empty = length == 0
            container[empty] = rank[empty] % total
            behind = widths_of[np.searchsorted(starts_of, container[empty], "right") - 1] if len(starts_of) else 0
            position[empty] = behind + rank[empty] // total
            columns = [pa.array(container), pa.array(position.astype(np.int32)), batch.column(0), batch.column(1), batch.column(2), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["container", "position", "key", "piece_no", "start", "length"])

    offsets = cells.select("length", "salt", (F.sum("count").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))).alias("offset"))
    local = F.row_number().over(W.partitionBy("length", "salt").orderBy("key", "piece_no")) - 1
    ranked = pieces.withColumn("local", local).join(offsets, ["length", "salt"])
    ranked = ranked.select("key", "piece_no", "start", "length", (F.col("local") + F.coalesce("offset", F.lit(0))).alias("rank"))
    kind = base.schema["key"].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"container bigint, position int, key {kind}, piece_no int, start bigint, length int")
    return placed.withColumnRenamed("key", key)
