"""Near-duplicate records with small edits: exact set-similarity join without all pairs.

A record is the set of its word sequences, a set its 64-bit key, so that exact copies
are one set from the start. A fixed-size count sketch over all sets orders sequences
from rare to frequent; two sets above the threshold share a sequence within the first
few of both, so only those are posted. Postings go to tiles by sequence; inside a tile
the sets of one sequence are banded by size, only sets whose sizes allow the threshold
meet, and the bit counts of their hashed bitmaps bound the overlap from above. What is
left is compared exactly by intersecting sorted arrays (of 50-bit codes; sets are named by 64-bit keys).

Defined results: texts with fewer words than a sequence (null, empty and blank ones
among them) are similar to nothing and are groups of one; a record id delivered twice
counts once; ties in size are met once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import materialize

_WORD = re.compile("[a-z0-9]+")
_POSTING = np.dtype([("h", "<u4"), ("set", "<u8"), ("n", "<u4"), ("bits", "<u8", 2)])
_INDEX = np.uint32(1 << 31)  # flag in n: the posting may be the smaller side of a pair
_BLOCK_BITS = 14
#: A sequence estimated to stand in more sets than this is spread over several tiles.
HOT = 20_000
#: Up to so many candidate sets (their record ids) are broadcast; beyond, the join shuffles.
BROADCAST_SETS = 500_000
#: Records of a set that are paired at once, and tasks at most for writing the pairs.
BLOCK, MOST_PARTS = 1000, 10_000


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_CODES = _Words()


def sequences(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 50-bit code of every different sequence of each text, sorted by row and code; at
    most 16,384 texts."""
    words: list[int] = []
    ends = np.zeros(len(texts), np.int64)
    code = _CODES.__getitem__
    for k, text in enumerate(texts):
        if text:
            words += map(code, _WORD.findall(text.lower()))
        ends[k] = len(words)
    coded = np.array(words, np.uint64)
    row = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    last = len(coded) - width + 1
    if last <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        mixed = np.zeros(last, np.uint64)
        for j in range(width):
            mixed = (mixed ^ coded[j : last + j]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    inside = row[:last] == row[width - 1 :]
    keys = np.sort((row[:last][inside].astype(np.uint64) << np.uint64(50)) | (mixed[inside] >> np.uint64(14)))
    keys = keys[np.diff(keys, prepend=np.uint64(0xFFFFFFFFFFFFFFFF)) != 0] if len(keys) else keys
    return (keys >> np.uint64(50)).astype(np.int64), keys & np.uint64((1 << 50) - 1)


def _set_keys(row: np.ndarray, codes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Key and size of the set of each row."""
    sizes = np.bincount(row, minlength=rows)
    with np.errstate(over="ignore"):
        mixed = (codes + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        keys = np.zeros(rows, np.uint64)
        some = sizes > 0
        if some.any():
            keys[some] = np.add.reduceat(mixed, starts[some])
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return keys, sizes


def _slices(column: pa.Array, chars: int = 3_000_000, rows: int = 8000) -> Iterator[tuple[int, list]]:
    at, texts, size = 0, [], 0
    for k, text in enumerate(column.to_pylist()):
        texts.append(text)
        size += len(text or "")
        if size > chars or len(texts) >= rows:
            yield at, texts
            at, texts, size = k + 1, [], 0
    if texts:
        yield at, texts


def membership(df: DataFrame, key: str, text: str, width: int, sketch_bits: int) -> tuple[DataFrame, np.ndarray]:
    """key, set_key, size and content (hash of the text) of every record, and the merged count
    sketch of the sequences."""
    kind = df.schema[key].dataType.simpleString()
    blocks, block = 1 << max(0, sketch_bits - _BLOCK_BITS), 1 << min(sketch_bits, _BLOCK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(blocks * block, np.int32)
        names = ["key", "set_key", "size", "content", "block", "counts"]
        for batch in batches:
            for at, texts in _slices(batch.column(1)):
                row, codes = sequences(texts, width)
                np.add.at(sketch, (codes & np.uint64(len(sketch) - 1)).astype(np.int64), 1)
                keys, sizes = _set_keys(row, codes, len(texts))
                ids, none = batch.column(0).slice(at, len(texts)), len(texts)
                content = np.array([xxhash.xxh3_64_intdigest(text or "") for text in texts], np.uint64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys.view(np.int64)), pa.array(sizes.astype(np.int32)), pa.array(content.view(np.int64)), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names)
                kinds = ids.type
        if sketch.any():
            counts = [sketch[k * block : (k + 1) * block].tobytes() for k in range(blocks)]
            yield pa.RecordBatch.from_arrays([pa.nulls(blocks, kinds), pa.nulls(blocks, pa.int64()), pa.nulls(blocks, pa.int32()), pa.nulls(blocks, pa.int64()), pa.array(range(blocks), pa.int32()), pa.array(counts, pa.binary())], names)

    picked = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    both = materialize(picked.mapInArrow(run, f"key {kind}, set_key bigint, size int, content bigint, block int, counts binary"))

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(block, np.int64)
        for raw in group.column("counts").to_pylist():
            total += np.frombuffer(raw, np.int32)
        return pa.table({"block": group.column("block").slice(0, 1), "counts": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    merged = np.zeros(blocks * block, np.int32)
    sums = both.where("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts binary")
    for number, raw in sums.collect():  # 2 ** sketch_bits counters, whatever the input
        merged[number * block : (number + 1) * block] = np.frombuffer(raw, np.int32)
    return both.where("block IS NULL").select("key", "set_key", "size", "content"), merged


def _postings(df: DataFrame, text: str, width: int, sketch: np.ndarray, tiles: int, num: int, den: int) -> DataFrame:
    """tile and packed postings of every set."""
    held = df.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = held.value, set()
        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                row, codes = sequences(texts, width)
                if not len(row):
                    continue
                keys, sizes = _set_keys(row, codes, len(texts))
                fresh = np.zeros(len(texts), bool)  # a task posts a set once
                for k, (s, n) in enumerate(zip(keys.tolist(), sizes.tolist())):
                    if n and s not in seen:
                        seen.add(s)
                        fresh[k] = True
                if len(seen) > 2_000_000:
                    seen.clear()
                mine = fresh[row]
                row, codes = row[mine], codes[mine]
                if not len(row):
                    continue
                bits = np.bincount(row * 128 + (codes >> np.uint64(43)).astype(np.int64), minlength=len(texts) * 128) & 1
                bits = np.packbits(bits.astype(np.uint8).reshape(len(texts), 128), axis=1).view("<u8")
                often = counts[(codes & np.uint64(len(counts) - 1)).astype(np.int64)]
                rank = (row.astype(np.uint64) << np.uint64(50)) | (np.minimum(often, (1 << 22) - 1).astype(np.uint64) << np.uint64(28)) | (codes & np.uint64((1 << 28) - 1))
                order = np.argsort(rank, kind="stable")  # codes come sorted: equal ranks stand in one order in every set
                row, codes, often = row[order], codes[order], often[order]
                first = np.concatenate([[True], row[1:] != row[:-1]])
                place = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
                n = sizes[row]
                keep = place < n - (num * n + den - 1) // den + 1
                row, codes, often, place, n = row[keep], codes[keep], often[keep], place[keep], n[keep]
                index = place < n - (2 * num * n + den + num - 1) // (den + num) + 1
                out = np.zeros(len(row), _POSTING)
                out["h"], out["set"], out["bits"] = (codes >> np.uint64(10)).astype(np.uint32), keys[row], bits[row]
                out["n"] = np.minimum(n, (1 << 31) - 1).astype(np.uint32) | np.where(index, _INDEX, np.uint32(0))
                base = (codes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(20)
                tile = (base % np.uint64(tiles)).astype(np.int64)
                hot = np.flatnonzero(often > HOT)
                if len(hot):  # the smaller sides are spread, every larger side visits all of them
                    spread = often[hot] // HOT + 1
                    sub = (keys[row[hot]] >> np.uint64(7)).astype(np.int64) & 0x7FFFFFFF
                    again, way = np.repeat(hot, spread), np.concatenate([np.arange(s) for s in spread])
                    index_at = np.repeat(sub % spread, spread) == way
                    extra = out[again].copy()
                    extra["n"] = np.where(index_at, extra["n"], extra["n"] & ~_INDEX)
                    rest = np.ones(len(out), bool)
                    rest[hot] = False
                    out = np.concatenate([out[rest], extra])
                    tile = np.concatenate([tile[rest], ((base[again] + way.astype(np.uint64) * np.uint64(0x9E3779B1)) % np.uint64(tiles)).astype(np.int64)])
                order = np.argsort(tile, kind="stable")
                out, tile = out[order], tile[order]
                at, cuts = np.unique(tile, return_index=True)
                blocks = [part.tobytes() for part in np.split(out, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(blocks, pa.binary())], ["tile", "block"])

    return df.select(text).mapInArrow(run, "tile int, block binary")


def _meet(blocks: list[bytes], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of one tile whose bounds allow the threshold."""
    all_ = np.frombuffer(b"".join(blocks), _POSTING)
    order = np.argsort(all_["h"], kind="stable")
    sorted_h = all_["h"][order]
    same = sorted_h[1:] == sorted_h[:-1]
    part = all_[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
    size = (part["n"] & ~_INDEX).astype(np.int64)
    part, size = (x[np.lexsort((part["n"] < _INDEX, part["set"], size, part["h"]))] for x in (part, size))
    # of a set posted more than once only one posting stays, one that may be the smaller side first
    new = np.ones(len(part), bool)
    new[1:] = (part["h"][1:] != part["h"][:-1]) | (part["set"][1:] != part["set"][:-1])
    part, size = part[new], size[new]
    h, sets, index, bits = part["h"], part["set"], part["n"] >= _INDEX, part["bits"]
    left, right = [], []
    low, step = np.flatnonzero(index[:-1] & (h[1:] == h[:-1])), 1
    while len(low):
        high = low + step
        near = size[low] * den >= size[high] * num  # sizes only grow from here on
        low, high = low[near], high[near]
        total = size[low] + size[high]
        differ = np.bitwise_count(bits[low] ^ bits[high]).sum(1, dtype=np.int64)
        shared = (num * total + den + num - 1) // (den + num)
        ok = (total - differ) // 2 >= shared
        left.append(sets[low[ok]])
        right.append(sets[high[ok]])
        step += 1
        low = low[low + step < len(h)]
        low = low[h[low + step] == h[low]] if len(low) else low
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.concatenate(left), np.concatenate(right)
    a, b = np.minimum(a, b), np.maximum(a, b)
    unique = np.unique(np.stack([a, b], 1), axis=0)
    return unique[:, 0], unique[:, 1]


class Links:
    """Result of `near_duplicates`: pairs of different sets, and the set of each record."""

    def __init__(self, pairs: DataFrame, members: DataFrame, key: str) -> None:
        self.pairs, self.members, self.key = pairs, members, key


def near_duplicates(df: DataFrame, key: str, text: str, width: int = 3, threshold: tuple[int, int] = (3, 4), sketch_bits: int = 20) -> Links:
    """Pairs (set_a, set_b, shared, either) of different sets with shared / either at or above the
    threshold, and members (key, set_key, size, content) of every record."""
    num, den = threshold
    spark = df.sparkSession
    members, sketch = membership(df, key, text, width, sketch_bits)
    posted = int(sketch.sum(dtype=np.int64)) * (den - num) // den
    tiles = max(int(spark.conf.get("spark.sql.shuffle.partitions")), posted * _POSTING.itemsize // 16_000_000 + 1)

    def meet(group: pa.Table) -> pa.Table:
        a, b = _meet(group.column("block").to_pylist(), num, den)
        return pa.table({"set_a": pa.array(a.view(np.int64)), "set_b": pa.array(b.view(np.int64))})

    posted_to = _postings(df, text, width, sketch, tiles, num, den).repartition(tiles, "tile")
    met = posted_to.groupBy("tile").applyInArrow(meet, "set_a bigint, set_b bigint")
    candidates = materialize(met.distinct())
    wanted = candidates.select(F.col("set_a").alias("set_key")).union(candidates.select("set_b")).distinct()
    one = materialize(members.join(wanted, "set_key", "left_semi").groupBy("set_key").agg(F.min("key").alias("key")))
    chosen = F.broadcast(one) if one.count() <= BROADCAST_SETS else one
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, "key")
    texts = materialize(texts.groupBy("set_key").agg(F.min("text").alias("text")))
    joined = candidates.join(texts.withColumnsRenamed({"set_key": "set_a", "text": "text_a"}), "set_a")
    joined = joined.join(texts.withColumnsRenamed({"set_key": "set_b", "text": "text_b"}), "set_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, both, either = [], [], []
            sets: dict[str, np.ndarray] = {}
            for k, sides in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                for side in sides:
                    if side not in sets:
                        sets[side] = sequences([side], width)[1]
                a, b = (sets[side] for side in sides)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                union = len(a) + len(b) - shared
                if shared * den >= union * num:
                    keep.append(k)
                    both.append(shared)
                    either.append(union)
            taken = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(both, pa.int32()), pa.array(either, pa.int32())], ["set_a", "set_b", "shared", "either"])

    pairs = joined.select("set_a", "set_b", "text_a", "text_b").mapInArrow(verify, "set_a bigint, set_b bigint, shared int, either int")
    return Links(materialize(pairs), members, key)


def record_pairs(links: Links, expand_copies: int | None = 100) -> DataFrame:
    """a and b (a < b): the linked pairs of records. With `expand_copies` None these are all of them.
    Else more than `expand_copies` records of one and the same text are each paired with the first
    of them only, and their pairs with other texts start at that first; records of different texts
    are all paired, also if their sets of sequences are equal."""
    some = links.members.where("size > 0").groupBy("key", "set_key").agg(F.min("content").alias("content"))
    star = None
    if expand_copies is not None:
        some = materialize(some)
        many = some.groupBy("set_key", "content").agg(F.count("*").alias("copies"), F.min("key").alias("first")).where(F.col("copies") > expand_copies)
        many = materialize(many.drop("copies"))
        some = some.join(many, ["set_key", "content"], "left")
        star = some.where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
        some = some.where("first IS NULL OR key = first")
    some = some.select("set_key", "key")
    ends = links.pairs.select(F.col("set_a").alias("set_key")).union(links.pairs.select("set_b")).distinct().withColumn("linked", F.lit(True))
    groups = some.groupBy("set_key").agg(F.count("*").alias("copies")).join(ends, "set_key", "left")
    groups = materialize(groups.where("copies > 1 OR linked").select("set_key", "copies"))
    # the records of a set are dealt into blocks; two blocks meet in one cell of up to about BLOCK * BLOCK pairs
    block = F.pmod(F.xxhash64("key"), F.ceil(F.col("copies") / BLOCK)).alias("block")
    blocks = materialize(some.join(groups, "set_key").groupBy("set_key", block).agg(F.collect_list("key").alias("keys")))
    edges = links.pairs.select("set_a", "set_b").unionByName(groups.where("copies > 1").select(F.col("set_key").alias("set_a"), F.col("set_key").alias("set_b")))
    cells = edges.join(blocks.withColumnsRenamed({"set_key": "set_a", "block": "block_a", "keys": "keys_a"}), "set_a")
    cells = cells.join(blocks.withColumnsRenamed({"set_key": "set_b", "block": "block_b", "keys": "keys_b"}), "set_b")
    cells = materialize(cells.where("set_a <> set_b OR block_a <= block_b"))
    due = cells.agg(F.sum(F.size("keys_a").cast("long") * F.size("keys_b"))).first()[0] or 0
    cells = cells.repartition(min(due // (BLOCK * BLOCK) + 1, MOST_PARTS), "set_a", "block_a", "set_b", "block_b")
    once = (F.col("set_a") == F.col("set_b")) & (F.col("block_a") == F.col("block_b"))
    pairs = cells.select(once.alias("once"), F.explode("keys_a").alias("x"), "keys_b").select("once", "x", F.explode("keys_b").alias("y"))
    pairs = pairs.where("x < y OR (NOT once AND x > y)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs if star is None else pairs.unionByName(star)


def record_groups(links: Links, rounds: int = 60) -> DataFrame:
    """key, group_id (the smallest set key that its links reach) and links (the number of records
    paired with it: the others of its set and all of the linked sets) of every record."""
    edges = links.pairs.select(F.col("set_a").alias("u"), F.col("set_b").alias("v"))
    edges = materialize(edges.union(edges.select("v", "u")))
    labels = materialize(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("label")))
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, "u").select("u", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = step.select(F.col("u").alias("label"), F.col("label").alias("further"))
        step = materialize(step.join(jump, "label", "left").select("u", F.coalesce("further", "label").alias("label"), "was"))
        labels = step.select("u", "label")
        if step.where("label <> was").isEmpty():
            break
    else:
        raise RuntimeError(f"groups are not complete after {rounds} rounds")
    records = links.members.select("key", "set_key", "size").distinct()
    held = records.where("size > 0").groupBy(F.col("set_key").alias("u")).agg(F.count("*").alias("held"))
    linked = edges.select("u").distinct()
    held = materialize(held.join(linked.withColumn("linked", F.lit(True)), "u", "left").where("held > 1 OR linked"))
    across = edges.join(held.select(F.col("u").alias("v"), F.col("held").alias("there")), "v").groupBy("u").agg(F.sum("there").alias("across"))
    degree = held.join(across, "u", "left").select("u", (F.col("held") - 1 + F.coalesce("across", F.lit(0))).alias("links"))
    placed = records.join(degree.join(labels, "u", "left"), F.col("set_key") == F.col("u"), "left")
    alone = F.xxhash64(F.lit("single"), "key")
    group = F.when(F.col("size") > 0, F.coalesce("label", "set_key")).otherwise(alone)
    return placed.select(F.col("key").alias(links.key), group.alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
