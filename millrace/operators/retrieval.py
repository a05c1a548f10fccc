"""Exact vector search, BM25, rank fusion with reserved places, abstention and its evaluation.

Queries are a stated set and meet all rows (BM25: all postings of their terms) in blocks; each
pair of blocks keeps its best k per query, so that only k rows per query and block are shuffled. What is broadcast is
counted before (small); beyond the bound the same join shuffles.

Defined results: equal similarities are ordered by id; rows with a null vector or another
length than the query's have no similarity; an empty query abstains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import fixed, text
from millrace.runtime import materialize, small

#: Rows of one block of vectors, or queries of one block of them.
BLOCK = 4096
#: Postings of one block of documents; a block ends between two ids and may hold some more.
POSTINGS = 1 << 20
#: Scores that are rounded to 9 places can only be equal if they differ by less than this.
SLACK = 2e-9


def _blocks(df: DataFrame, prefix: str) -> DataFrame:
    """Rows (id, vector) packed into blocks of at most BLOCK: their ids, and their matrix as float32."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                by_width: dict[int, list[int]] = {}
                vectors = part.column(1).to_pylist()
                for n, v in enumerate(vectors):
                    if v and None not in v:
                        by_width.setdefault(len(v), []).append(n)
                for width, rows in by_width.items():
                    ids = pa.array([part.column(0).take(pa.array(rows)).to_pylist()], pa.list_(part.column(0).type))
                    matrix = np.array([vectors[n] for n in rows], np.float32)
                    yield pa.RecordBatch.from_arrays([ids, pa.array([width], pa.int32()), pa.array([matrix.tobytes()], pa.binary())], [f"{prefix}ids", f"{prefix}width", f"{prefix}matrix"])

    return df.mapInArrow(run, f"{prefix}ids array<{kind}>, {prefix}width int, {prefix}matrix binary")


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, id, similarity and rank of the k rows with the largest inner product. The stated
    queries (query_id, vector) meet all rows block by block; of each pair of blocks only the best k per
    query go on."""
    kind, query_kind = vectors.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    asked = materialize(_blocks(queries.select(F.col("query_id").alias("id"), "vector"), "q"))
    rows = _blocks(vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector")), "v")
    pairs = rows.crossJoin(small(asked, 64)).where("qwidth = vwidth")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best k of the task for each query: blocks are merged as they come, so that a task sends
        k rows per query (and ties at the cut, which ids decide afterwards), not k per block."""
        held: dict[tuple, tuple] = {}  # per block of queries: their ids, and ids, scores and queries of the rows kept
        for batch in batches:
            query_type, id_type = batch.schema.field("qids").type.value_type, batch.schema.field("vids").type.value_type
            for pair in batch.to_pylist():
                own, wanted = (np.frombuffer(pair[f"{p}matrix"], np.float32).reshape(-1, pair[f"{p}width"]).astype(np.float64) for p in "vq")
                scores = own @ wanted.T
                keep = min(k, len(own))
                floor = np.partition(scores, len(own) - keep, axis=0)[len(own) - keep]
                row, query = np.nonzero(scores >= floor)
                block = (pair["qwidth"], pair["qids"][0], len(pair["qids"]))
                ids = pa.array(pair["vids"], id_type).take(pa.array(row))
                _, old_ids, old_scores, old_query = held.get(block, (None, None, np.empty(0), np.empty(0, np.int64)))
                ids = pa.concat_arrays([old_ids, ids]) if old_ids is not None else ids
                found, query = np.concatenate([old_scores, scores[row, query]]), np.concatenate([old_query, query])
                order = np.lexsort((-found, query))
                begin = np.searchsorted(query[order], np.arange(len(pair["qids"])))
                cut = np.minimum(begin + k, np.append(begin[1:], len(order))) - 1  # the k-th best of each query, or its last
                good = order[found[order] >= np.where(cut >= begin, found[order][np.minimum(cut, len(order) - 1)], -np.inf)[query[order]]]
                held[block] = (pair["qids"], ids.take(pa.array(good)), found[good], query[good])
        for qids, ids, found, query in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(qids, query_type).take(pa.array(query)), ids, pa.array(found)], ["query_id", "id", "similarity"])

    out = pairs.mapInArrow(search, f"query_id {query_kind}, id {kind}, similarity double")
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _counted(rows: DataFrame) -> DataFrame:
    """Rows (id, size, code), one per token, as rows (id, size, codes, tfs) of what each batch holds of a
    document. A document may come in several rows; _postings adds them up."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            ids = batch.column(0).dictionary_encode(null_encoding="encode")
            doc, size, code = ids.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            order = np.lexsort((code, size, doc))
            doc, size, code = doc[order], size[order], code[order]
            fresh = np.r_[True, (doc[1:] != doc[:-1]) | (size[1:] != size[:-1])]
            first = np.flatnonzero(fresh | np.r_[True, code[1:] != code[:-1]])
            begin = np.flatnonzero(fresh[first])
            ends, tf = pa.array(np.append(begin, len(first)), pa.int32()), np.diff(np.append(first, len(doc))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (code[first], tf)]
            yield pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(doc[first[begin]])), pa.array(size[first[begin]]), *lists], ["id", "size", "codes", "tfs"])

    return rows.mapInArrow(run, f"id {kind}, size int, codes array<bigint>, tfs array<int>")


def _postings(rows: DataFrame, k1: float, b: float) -> DataFrame:
    """Rows (id, size, codes, tfs, mean), those of an id together and in order of id, packed into blocks of
    some POSTINGS: the ids, and by code the number of documents, and row and gain (without idf) of each posting."""
    kind = rows.schema["id"].dataType.simpleString()

    def block(part: pa.Table) -> pa.RecordBatch:
        ids = part.column("id").combine_chunks().dictionary_encode(null_encoding="encode")
        codes, tfs = (part.column(x).combine_chunks() for x in ("codes", "tfs"))
        row = np.repeat(np.arange(part.num_rows), codes.value_lengths().to_numpy())
        doc, size = ids.indices.to_numpy()[row], part.column("size").to_numpy()[row]
        code, tf = codes.flatten().to_numpy(), tfs.flatten().to_numpy()
        order = np.lexsort((size, doc, code))
        doc, size, code, tf = doc[order], size[order], code[order], tf[order]
        fresh = np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]
        first = np.flatnonzero(fresh | np.r_[True, size[1:] != size[:-1]])
        tf, doc, size, code, fresh = np.add.reduceat(tf.astype(np.int64), first), doc[first], size[first], code[first], fresh[first]
        gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / part.column("mean")[0].as_py()))
        df = np.diff(np.append(np.flatnonzero(np.r_[True, code[1:] != code[:-1]]), len(code)))
        first = np.flatnonzero(fresh)  # documents of one id are one row of it
        gain, doc, code = np.add.reduceat(gain, first), doc[first], code[first]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        lists = [pa.array([ids.dictionary.to_pylist()], pa.list_(ids.dictionary.type)), pa.array([code[starts]], pa.list_(pa.int64())), pa.array([df], pa.list_(pa.int64()))]
        raw = [pa.array([x.tobytes()], pa.binary()) for x in (np.append(starts, len(code)).astype(np.int64), doc.astype(np.int32), gain)]
        return pa.RecordBatch.from_arrays([*lists, *raw], ["ids", "codes", "dfs", "starts", "docs", "gains"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in (b for b in batches if b.num_rows):
            held.append(batch)
            count += len(batch.column("codes").flatten())
            if count >= POSTINGS:
                part = pa.Table.from_batches(held)
                last = part.column("id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                cut = int(np.searchsorted(last, last[-1]))  # the last id may go on in the next batch
                if cut:
                    yield block(part.slice(0, cut))
                    held = part.slice(cut).to_batches()
                    count = sum(len(x.column("codes").flatten()) for x in held)
        if held:
            yield block(pa.Table.from_batches(held))

    return rows.mapInArrow(run, f"ids array<{kind}>, codes array<bigint>, dfs array<bigint>, starts binary, docs binary, gains binary")


def _best_gains(blocks: DataFrame, k: int) -> DataFrame:
    """code and gain of the k best postings of each code in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                codes, starts, gains = batch.column(0)[n].values.to_numpy(), _raw(batch.column(1)[n], np.int64), _raw(batch.column(2)[n], np.float64)
                owner = np.repeat(np.arange(len(codes)), np.diff(starts))
                order = np.lexsort((-gains, owner))
                order = order[np.arange(len(order)) - starts[owner] < k]
                yield pa.RecordBatch.from_arrays([pa.array(codes[owner[order]]), pa.array(gains[order])], ["code", "gain"])

    return blocks.select("codes", "starts", "gains").mapInArrow(run, "code bigint, gain double")


def _raw(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _asked(queries: DataFrame) -> DataFrame:
    """Rows (query_id, terms of code and idf, floor) packed into blocks of at most BLOCK."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                terms = part.column("terms").flatten()
                ends = np.append(0, np.cumsum(part.column("terms").value_lengths().to_numpy(), dtype=np.int64))
                raw = (ends, terms.field("code").to_numpy(), terms.field("idf").to_numpy(), part.column("floor").to_numpy())
                ids = pa.array([part.column("query_id").to_pylist()], pa.list_(part.column("query_id").type))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x.tobytes()], pa.binary()) for x in raw)], ["qids", "ends", "qcodes", "idfs", "floors"])

    return queries.mapInArrow(run, f"qids array<{kind}>, ends binary, qcodes binary, idfs binary, floors binary")


def _best_rows(terms: list[tuple], most: np.ndarray, sums: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of a block that can be among the k best of a query. terms: rows, gains and idf of each term;
    most: its largest gain here. Terms that cannot reach the floor together are only looked up in rows of the others."""
    limit = floor - SLACK
    order = np.argsort(most, kind="stable")
    reach = np.cumsum(most[order])
    free = int(np.searchsorted(reach, limit))
    rest, leading = (reach[free - 1] if free else 0.0), [terms[n] for n in order[free:]]
    if not leading:
        return np.empty(0, np.int32), np.empty(0)
    if len(leading) == 1:
        rows, gains, idf = leading[0]
        rows = rows[gains * idf + rest >= limit]
    else:
        for rows, gains, idf in leading:
            sums[rows] += gains * idf  # a term has a row once
        met = np.concatenate([rows for rows, _, _ in leading])
        rows = np.unique(met[sums[met] + rest >= limit])
        sums[met] = 0
    scores = np.zeros(len(rows))
    for own, gains, idf in terms:  # always in this order, so that equal documents score the same in every block
        at = np.minimum(np.searchsorted(own, rows), len(own) - 1)
        scores += np.where(own[at] == rows, gains[at] * idf, 0.0)
    if len(rows) > k:
        limit = max(limit, np.partition(scores, len(rows) - k)[len(rows) - k] - SLACK)
    rows, scores = rows[scores >= limit], scores[scores >= limit]
    if len(rows) > k:  # of equal scores the first k by id
        order = np.lexsort((rows, -scores))
        rows, scores = rows[order], scores[order]
        begin = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
        good = np.arange(len(rows)) - np.repeat(begin, np.diff(np.append(begin, len(rows)))) < k
        rows, scores = rows[good], scores[good]
    return rows, scores


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int = fixed.LEXICAL_CANDIDATES, key: str = "id", body: str = "body", k1: float = fixed.BM25_K1, b: float = fixed.BM25_B) -> DataFrame:
    """query_id, id, score and rank by BM25 over tokens of letters and digits, any token matching.
    Only postings of query terms are built; lengths and frequencies come from all documents.

    Blocks of postings meet blocks of queries, and each pair sends its best k per query only. The k-th
    best gain of any term of a query over all documents is a floor of its k-th score: what cannot reach
    it, or the k-th score that the task has seen, is not scored. The result is that of scoring all."""
    terms = queries.select("query_id", F.explode(F.array_distinct(text.query_tokens(F.col("query")))).alias("term"))
    tokens = docs.select(F.col(key).alias("id"), F.regexp_extract_all(F.lower(F.coalesce(F.col(body), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)).alias("tokens"))
    corpus = tokens.agg(F.count("*").alias("docs"), F.avg(F.size("tokens")).alias("mean"))
    wanted = materialize(terms.select("term").distinct().withColumn("code", F.monotonically_increasing_id()))
    # documents are tokenised twice only: for lengths, and for the postings of query terms, which are a table
    matched = tokens.select("id", F.size("tokens").alias("size"), F.explode("tokens").alias("term")).join(small(wanted), "term").select("id", "size", "code")
    rows = _counted(matched).crossJoin(F.broadcast(corpus.select("mean"))).repartition("id").sortWithinPartitions("id")  # corpus is one row
    blocks = materialize(_postings(rows, k1, b))
    frequency = blocks.select(F.explode(F.arrays_zip("codes", "dfs")).alias("c")).groupBy(F.col("c.codes").alias("code")).agg(F.sum("c.dfs").alias("df"))
    best = _best_gains(blocks, k).withColumn("n", F.row_number().over(W.partitionBy("code").orderBy(F.desc("gain")))).where(F.col("n") == k).select("code", "gain")
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weighed = frequency.join(best, "code", "left").crossJoin(F.broadcast(corpus.select("docs"))).select("code", idf.alias("idf"), F.coalesce(idf * F.col("gain"), F.lit(0.0)).alias("floor"))
    known = terms.join(small(wanted), "term").join(weighed, "code").groupBy("query_id")
    asked = materialize(_asked(known.agg(F.array_sort(F.collect_list(F.struct("code", "idf"))).alias("terms"), F.max("floor").alias("floor"))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}  # per block of queries: their floors, and the best k scores of each that this task has seen
        for batch in batches:
            query_type, id_type = batch.schema.field("qids").type.value_type, batch.schema.field("ids").type.value_type
            for n in range(batch.num_rows):
                pair = {name: batch.column(name)[n] for name in batch.schema.names}
                ids, qids, codes = pair["ids"].values, pair["qids"].values, pair["codes"].values.to_numpy()
                starts, rows, gains = _raw(pair["starts"], np.int64), _raw(pair["docs"], np.int32), _raw(pair["gains"], np.float64)
                ends, qcodes, idfs = _raw(pair["ends"], np.int64), _raw(pair["qcodes"], np.int64), _raw(pair["idfs"], np.float64)
                floors, seen = held.setdefault((qids[0].as_py(), len(qids), pair["qcodes"].as_py()), (_raw(pair["floors"], np.float64).copy(), {}))
                at = np.minimum(np.searchsorted(codes, qcodes), len(codes) - 1)
                most = np.where(codes[at] == qcodes, np.maximum.reduceat(gains, starts[:-1])[at] * idfs, 0.0)
                reach, sums, out = np.add.reduceat(most, ends[:-1]), np.zeros(len(ids)), []
                for q in np.flatnonzero((reach > 0) & (reach >= floors - SLACK)):
                    own = [t for t in range(ends[q], ends[q + 1]) if most[t] > 0]
                    parts = [(rows[starts[at[t]] : starts[at[t] + 1]], gains[starts[at[t]] : starts[at[t] + 1]], idfs[t]) for t in own]
                    found, scores = _best_rows(parts, most[own], sums, floors[q], k)
                    if len(found):
                        out.append((np.full(len(found), q), found, scores))
                        top = np.concatenate([seen.get(q, scores[:0]), scores])
                        seen[q] = top = np.partition(top, len(top) - k)[len(top) - k :] if len(top) > k else top
                        floors[q] = max(floors[q], top.min()) if len(top) == k else floors[q]
                if out:
                    query, found, scores = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([qids.cast(query_type).take(pa.array(query)), ids.cast(id_type).take(pa.array(found)), pa.array(scores)], ["query_id", "id", "score"])

    kind, query_kind = docs.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    scored = blocks.select("ids", "codes", "starts", "docs", "gains").crossJoin(small(asked, 64)).mapInArrow(search, f"query_id {query_kind}, id {kind}, score double")
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(*rankings: DataFrame, k: int = fixed.RRF_K) -> DataFrame:
    """query_id, id and the sum of 1 / (k + rank) over the rankings."""
    both = None
    for ranking in rankings:
        part = ranking.select("query_id", "id", (1.0 / (k + F.col("rank"))).alias("part"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy("query_id", "id").agg(F.sum("part").alias("fused"))


def hybrid(
    dense: DataFrame, lexical: DataFrame, facts: DataFrame, queries: DataFrame, threshold: float = fixed.MIN_SIMILARITY, k: int = fixed.TOP_K,
    slots: int = fixed.RESERVED_SLOTS, margin: float = fixed.AUTHORITY_MARGIN, abstained: bool = False,
) -> DataFrame:
    """Hits of each query: query_id, id, similarity, fused, reserved, position, confidence. A query whose
    best similarity is under the threshold has none; with `abstained` its hits are kept and marked.

    dense and lexical are rankings over all rows (limits apply before the category filter);
    facts has id, authoritative and category; queries has query_id and category (null: any).
    Authoritative rows are ranked among themselves by similarity for the reserved places, and
    those beyond them are left out; the others follow by fused rank."""
    wanted = queries.select("query_id", F.col("category").alias("wanted"))
    eligible = lambda ranking: (
        ranking.join(facts.select("id", "authoritative", "category"), "id").join(wanted, "query_id").where("wanted IS NULL OR category = wanted")
        .withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    )
    own, words = eligible(dense), eligible(lexical)
    pool = own.where(f"authoritative OR rank <= {fixed.LEXICAL_CANDIDATES}")
    within = W.partitionBy("query_id", "authoritative").orderBy("rank")
    ranked = [x.select("query_id", "id", "authoritative", F.row_number().over(within).alias("rank")) for x in (pool, words)]
    fused = ranked[0].unionByName(ranked[1]).groupBy("query_id", "id", "authoritative").agg(F.sum(1.0 / (fixed.RRF_K + F.col("rank"))).alias("fused"))
    hits = fused.join(own.select("query_id", "id", "similarity"), ["query_id", "id"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    first = W.partitionBy("query_id", "authoritative").orderBy(F.desc("similarity"), "id")
    hits = hits.withColumn("place", F.row_number().over(first))
    hits = hits.where(f"NOT authoritative OR (similarity >= {max(0.0, threshold - margin)} AND place <= {slots})")
    score = F.when(F.col("authoritative"), F.col("similarity")).otherwise(F.round("fused", 12))
    hits = hits.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("authoritative"), F.desc(score), "id"))).where(F.col("position") <= k)
    hits = hits.withColumn("confidence", F.max("similarity").over(W.partitionBy("query_id")))
    out = hits.select("query_id", "id", "similarity", "fused", F.col("authoritative").alias("reserved"), "position", "confidence")
    return out.withColumn("abstained", F.col("confidence") < threshold) if abstained else out.where(F.col("confidence") >= threshold)


def abstention(hits: DataFrame, queries: DataFrame, threshold: float = fixed.MIN_SIMILARITY) -> DataFrame:
    """query_id, confidence, abstained and reason of every query, those without hits included."""
    best = hits.groupBy("query_id").agg(F.max("similarity").alias("confidence"))
    joined = queries.select("query_id", "query").join(best, "query_id", "left")
    reason = F.when(F.trim(F.coalesce("query", F.lit(""))) == "", "empty query").when(F.col("confidence").isNull(), "no candidates").when(F.col("confidence") < threshold, "below threshold")
    return joined.select("query_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), reason.isNotNull().alias("abstained"), reason.alias("reason"))


def citations(hits: DataFrame, facts: DataFrame, most: int = 4) -> DataFrame:
    """query_id and its best `most` hits as citations (record_id, title, source_url, similarity), in order.
    facts has id, title and source_url. A query has at most `most` of them, so the list is small."""
    cited = hits.where(F.col("position") <= most).join(facts.select("id", "title", "source_url"), "id")
    item = F.struct("position", F.struct(F.col("id").alias("record_id"), "title", "source_url", F.round("similarity", 3).alias("similarity")).alias("c"))
    return cited.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]).alias("citations"))


def context(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id and the text of its hits in order, each under its id; docs has id, section_path and content."""
    joined = hits.join(docs.select("id", "section_path", "content"), "id")
    shown = F.concat_ws("\n", F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.coalesce("section_path", F.lit(""))), "content")
    return joined.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", shown.alias("s")))), lambda x: x["s"]), "\n\n").alias("context"))


def used_citations(cited: Column, retrieved: Column, fallback: int = 2) -> Column:
    """The retrieved citations whose record id was cited, else the first `fallback` of them."""
    kept = F.filter(retrieved, lambda c: F.array_contains(F.coalesce(cited, F.array().cast("array<string>")), c["record_id"].cast("string")))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(retrieved, 1, fallback))


def verdict(expect_abstain: Column, abstained: Column, hits: Column, needles: Column) -> Column:
    """Verdict of one case from the texts of its hits in order."""
    has_all = lambda body: F.forall(needles, lambda n: F.contains(F.lower(body), F.lower(n)))
    return (
        F.when(expect_abstain, F.when(abstained, "correct").otherwise("incorrect"))
        .when(abstained, "incorrect")
        .when(has_all(F.get(hits, F.lit(0))), "correct")
        .when(has_all(F.array_join(hits, " ")), "partially correct")
        .otherwise("incorrect")
    )


def threshold_sweep(scores: DataFrame, first: int = 40, last: int = 84, step: int = 2) -> DataFrame:
    """threshold, false_refusals, false_answers and errors, from score and in_scope of every query.
    The thresholds are a fixed list, so each row is expanded to as many rows and combined at once."""
    each = scores.select("in_scope", "score", F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))).alias("percent"))
    refused, answered = F.col("in_scope") & (F.col("score") < F.col("percent") / 100), ~F.col("in_scope") & (F.col("score") >= F.col("percent") / 100)
    out = each.groupBy((F.col("percent") / 100).alias("threshold")).agg(F.count_if(refused).alias("false_refusals"), F.count_if(answered).alias("false_answers"))
    return out.withColumn("errors", F.col("false_refusals") + F.col("false_answers"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the fewest errors; of equal ones the smallest threshold."""
    return sweep.agg(F.min_by(F.struct(*sweep.columns), F.struct("errors", "threshold")).alias("b")).select("b.*")


def separability(scores: DataFrame) -> DataFrame:
    """Least score in scope, greatest out of scope, and whether a threshold parts them, from score and in_scope."""
    ends = scores.agg(F.min(F.when(F.col("in_scope"), F.col("score"))).alias("in_least"), F.max(F.when(~F.col("in_scope"), F.col("score"))).alias("out_most"))
    return ends.withColumn("separable", F.col("in_least") > F.col("out_most"))
