"""Encoding a corpus with a public byte-level tokenizer (see bpe.py).

Defined results: null and empty texts have an empty list of ids, blank texts the ids of
their white space; strings of special tokens are ordinary text; rows are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import encoder


def _slices(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """key and ids (array<int>) of every row; `tokenizer` is the path of a rank file."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            for part in _slices(batch):
                raw = bpe.encode(part.column(1).to_pylist())
                offsets = np.zeros(len(raw) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in raw], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["key", "ids"])

    picked = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return picked.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """key and n_tokens of every row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            for part in _slices(batch):
                counts = [len(x) // 4 for x in bpe.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["key", "n_tokens"])

    picked = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return picked.mapInArrow(run, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)
