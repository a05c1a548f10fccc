"""Duplicates by fingerprint, near duplicates by shingle similarity, contradicting statements.

Near duplicates are found exactly: shingles are ordered from rare to frequent, two texts
at the threshold share one of their first ones, candidates meet on those only and are then
compared in full. Which text stays is decided in rounds: longer before shorter, then by
id; a text goes if a kept earlier text is similar to it, and is kept once all similar
earlier texts are gone.

Defined results: null texts count as empty; empty texts are exact copies of each other but
near to nothing; equal lengths are ordered by id; equal similarities take the longer, then
the smaller id as keeper.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed, text
from millrace.runtime import materialize, small


def exact_duplicates(df: DataFrame, key: str, body: str) -> DataFrame:
    """kept and dropped of every copy but the first of its fingerprint. The keeper of a group is a
    minimum, combined before the shuffle, so a group of any size is no single task's burden."""
    # a table, as the fingerprint would else be computed for the grouping, the join and its null check
    marked = materialize(df.select(F.col(key).alias("id"), text.fingerprint(F.col(body)).alias("print"), F.length(F.coalesce(F.col(body), F.lit(""))).alias("size")))
    first = marked.groupBy("print").agg(F.min(F.struct(-F.col("size"), F.col("id"))).alias("first"), F.count("*").alias("copies"))
    several = first.where("copies > 1").select("print", F.col("first.id").alias("kept"))
    return marked.join(several, "print").where("id <> kept").select("kept", F.col("id").alias("dropped"))


_WORD = re.compile("[a-z0-9]+")
#: Counters of the sketch that orders shingles from rare to frequent; their number bounds what the driver sees.
SKETCH_BITS = 20
#: A shingle that more texts post than this is met in several cells.
HOT = 2_000


def shingle_sets(df: DataFrame, key: str, body: str, size: int = fixed.SHINGLE_WORDS) -> DataFrame:
    """id, n and set (sorted 64-bit codes of the word windows of the canonical text) of every text that has
    any: words are hashed once, windows are mixed from their codes without building a string."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, sets = [], []
            for k, low in enumerate(batch.column(1).to_pylist()):
                words = _WORD.findall(low)
                if words:
                    coded = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                    width = min(size, len(words))
                    mixed = np.full(len(words) - width + 1, len(words) if len(words) < size else 0, np.uint64)
                    with np.errstate(over="ignore"):
                        for j in range(width):
                            mixed = (mixed ^ coded[j : len(words) - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                            mixed ^= mixed >> np.uint64(32)
                    row.append(k)
                    sets.append(np.unique(mixed).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets), values)], ["id", "n", "set"])

    return df.select(F.col(key), F.lower(F.coalesce(F.col(body), F.lit("")))).mapInArrow(run, f"id {kind}, n int, set array<bigint>")


def similar_pairs(df: DataFrame, key: str, body: str, threshold: tuple[int, int] = fixed.NEAR_DUPLICATE, size: int = fixed.SHINGLE_WORDS) -> DataFrame:
    """a, b (a before b), shared, either of the pairs of different texts at the threshold. `df` should
    be free of exact copies (see near_duplicates).

    Each text posts its rarest shingles. Texts meet on shingle and band: sizes are cut into bands as wide
    as the threshold allows, a text asks its own band and the next, so texts of unlike size never meet.
    A shingle that many texts of a band post is dealt into cells of pairs of salts, so that no task has
    more than about HOT * HOT pairs of it."""
    num, den = threshold
    sets = materialize(shingle_sets(df, key, body, size))
    buckets = sets.select(F.explode("set").alias("s")).groupBy(F.expr(f"CAST(s & {(1 << SKETCH_BITS) - 1} AS INT)").alias("at")).agg(F.count("*").alias("df")).toArrow()
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    counts[buckets.column("at").to_numpy()] = buckets.column("df").to_numpy()
    held = df.sparkSession.sparkContext.broadcast(counts)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rarest shingles of each set, as many as two sets at the threshold must share one of; those
        of one text only can match nothing, but they do take the first places."""
        often = held.value
        for batch in batches:
            row, kept = [], []
            for k, (n, codes) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                own = codes.values.to_numpy()
                df_ = often[own & (len(often) - 1)]
                first = np.lexsort((own, df_))[: n - -(-num * n // den) + 1]
                first = first[df_[first] > 1]
                row.append(np.full(len(first), k))
                kept.append(own[first])
            taken = pa.array(np.concatenate(row) if row else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(np.concatenate(kept) if kept else np.empty(0, np.int64))], ["id", "n", "s"])

    band = F.floor(F.log(F.col("n")) / F.log(F.lit(den / num)) + 1e-9).cast("int")
    posted = materialize(sets.select("id", "n", "set").mapInArrow(post, f"id {sets.schema['id'].dataType.simpleString()}, n int, s bigint").withColumn("band", band))
    hot = posted.groupBy("s", "band").agg(F.count("*").alias("m")).where(F.col("m") > HOT).groupBy("s").agg((F.sum("m") / HOT).cast("int").alias("m"))
    dealt = posted.join(small(materialize(hot.withColumn("ways", F.col("m") + 1).drop("m"))), "s", "left").withColumn("ways", F.coalesce("ways", F.lit(1)))
    salt = F.pmod(F.xxhash64("id"), F.col("ways")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("ways") - 1), lambda w: F.struct(F.least(salt, w).alias("i"), F.greatest(salt, w).alias("j")))
    spread = dealt.select("id", "n", "s", "band", "ways", salt.alias("salt"), F.explode(cells).alias("cell"))
    left = spread.select("s", "cell", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), "id", "n", "salt", F.col("band").alias("own"))
    right = spread.select("s", "cell", "band", F.col("id").alias("b"), F.col("n").alias("m"), F.col("salt").alias("salt_b"))
    near = f"(own < band OR id < b) AND least(n, m) * {den} >= greatest(n, m) * {num} AND (cell.i = cell.j OR salt <> salt_b)"
    met = left.join(right, ["s", "cell", "band"]).where(near).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    full = met.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    counted = full.select("a", "b", shared.alias("shared"), (F.size("set_a") + F.size("set_b") - shared).alias("either"))
    return counted.where(f"shared * {den} >= either * {num}")


def near_duplicates(df: DataFrame, key: str, body: str, threshold: tuple[int, int] = fixed.NEAR_DUPLICATE, rounds: int = 50) -> DataFrame:
    """kept, dropped, similarity, kind (exact or near) of every text that goes."""
    exact = materialize(exact_duplicates(df, key, body))
    rest = df.join(exact.select(F.col("dropped").alias(key)), key, "left_anti")
    order = rest.select(F.col(key).alias("id"), F.length(F.coalesce(F.col(body), F.lit(""))).alias("len"))
    pairs = similar_pairs(rest, key, body, threshold)
    ends = pairs.join(order.withColumnsRenamed({"id": "a", "len": "la"}), "a").join(order.withColumnsRenamed({"id": "b", "len": "lb"}), "b")
    a_first = (F.col("la") > F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("a") < F.col("b")))
    edges = materialize(
        ends.select(
            F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("late"),
            F.greatest("la", "lb").alias("len"), (F.col("shared") / F.col("either")).alias("similarity"),
        )
    )
    state = edges.select(F.col("early").alias("id")).union(edges.select("late")).distinct().withColumn("state", F.lit("open"))
    for _ in range(rounds):
        known = edges.join(state.select(F.col("id").alias("early"), F.col("state").alias("s")), "early")
        seen = known.groupBy("late").agg(F.max((F.col("s") == "kept").cast("int")).alias("kept"), F.max((F.col("s") == "open").cast("int")).alias("open"))
        told = state.join(seen, F.col("id") == F.col("late"), "left")
        decided = F.when(F.col("state") != "open", F.col("state")).when(F.col("kept") == 1, "gone").when(F.coalesce("open", F.lit(0)) == 0, "kept").otherwise("open")
        state = materialize(told.select("id", decided.alias("state")))
        if state.where("state = 'open'").isEmpty():
            break
    else:
        raise RuntimeError(f"undecided after {rounds} rounds")
    kept, gone = state.where("state = 'kept'").select(F.col("id").alias("early")), state.where("state = 'gone'").select(F.col("id").alias("late"))
    links = edges.join(kept, "early").join(gone, "late")
    best = links.groupBy("late").agg(F.max_by(F.struct("early", "similarity"), F.struct("similarity", "len")).alias("b"))
    near = best.select(F.col("b.early").alias("kept"), F.col("late").alias("dropped"), F.col("b.similarity").alias("similarity"), F.lit("near").alias("kind"))
    return exact.select("kept", "dropped", F.lit(1.0).alias("similarity"), F.lit("exact").alias("kind")).unionByName(near)


def survivors(df: DataFrame, key: str, body: str) -> DataFrame:
    gone = near_duplicates(df, key, body).select(F.col("dropped").alias(key))
    return df.join(gone, key, "left_anti")


def statements(df: DataFrame, key: str, body: str, topics: dict[str, str] = fixed.TOPICS) -> DataFrame:
    """topic, value and id of every number stated on a topic."""
    def stated(topic: str, pattern: str) -> Column:
        number, unit = (F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(k)) for k in (1, 2))
        value = lambda n, u: F.trim(F.concat(F.replace(n, F.lit(",")), F.lit(" "), F.when(u != "", F.concat(F.lower(u), F.lit("s"))).otherwise("")))
        return F.zip_with(number, unit, lambda n, u: F.struct(F.lit(topic).alias("topic"), value(n, u).alias("value")))

    found = [stated(topic, pattern) for topic, pattern in topics.items()]
    return df.select(F.col(key).alias("id"), F.explode(F.array_distinct(F.concat(*found))).alias("x")).select("x.topic", "x.value", "id")


def contradictions(df: DataFrame, key: str, body: str, topics: dict[str, str] = fixed.TOPICS) -> DataFrame:
    """topic, value, documents of the topics on which different numbers are stated."""
    counted = statements(df, key, body, topics).groupBy("topic", "value").agg(F.count("*").alias("documents"))
    several = counted.groupBy("topic").agg(F.count("*").alias("values")).where("values > 1")
    return counted.join(F.broadcast(several.select("topic")), "topic")  # one row per topic of the table
