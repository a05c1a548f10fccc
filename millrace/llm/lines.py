"""Lines repeated across the documents of one source.

Every line is parsed into a template by a fixed-depth token tree: the root branches on
the source and the number of tokens, the next levels on the leading tokens, and the
leaves hold the whole token sequence; a run of digits is a wildcard slot. Each task
grows its own tree, whose leaves remember up to `min_docs` different documents; the
trees are merged across partitions by leaf, and a leaf that covers `min_docs` documents
is a repeated template. A hot template thus costs each task a handful of rows.

Defined results: null, empty and blank texts have no line; a null source is a source of
its own; a document delivered twice counts once for the count and keeps both rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import materialize

_DIGITS = re.compile("[0-9]+")
_SLOT = "0"
#: Up to so many repeated templates (8 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_TEMPLATES = 2_000_000


class TemplateTree:
    """Token tree of one task; `add` returns the leaf's key and whether this document is
    one of its first `min_docs`."""

    def __init__(self, min_docs: int, depth: int = 2, capacity: int = 400_000) -> None:
        self.min_docs, self.depth, self.capacity = min_docs, depth, capacity
        self.root: dict = {}
        self.leaves = 0

    def add(self, source: str | None, tokens: list[str], doc: object) -> tuple[int, bool]:
        node = self.root
        for branch in (source, len(tokens), *tokens[: self.depth]):
            below = node.get(branch)
            if below is None:
                below = node[branch] = {}
            node = below
        template = " ".join(tokens)
        leaf = node.get(template)
        if leaf is None:
            if self.leaves >= self.capacity:  # the merge across tasks also joins a task's own trees
                self.root.clear()
                self.leaves = 0
                return self.add(source, tokens, doc)
            self.leaves += 1
            digest = xxhash.xxh3_64_intdigest(f"{source is None}\x00{source}\x00{template}".encode("utf-8", "surrogatepass"))
            node[template] = leaf = [digest - (1 << 64) if digest >> 63 else digest, doc]
            return leaf[0], True
        if len(leaf) <= self.min_docs and leaf[-1] != doc and doc not in leaf[1:]:
            leaf.append(doc)
            return leaf[0], True
        return leaf[0], False


def parse_line(line: str) -> list[str]:
    """Tokens of a lower-cased line with its digit runs as slots; none for blank lines and
    for lines whose first visible character is # or |."""
    tokens = _DIGITS.sub(_SLOT, line).split()
    return [] if not tokens or tokens[0][0] in "#|" else tokens


def line_templates(df: DataFrame, key: str, text: str, source: str, min_docs: int) -> DataFrame:
    """key, line_no, template and `counted` of every line that can be a case."""
    kind = df.schema[key].dataType.simpleString()

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TemplateTree(min_docs)
        add, sub = tree.add, _DIGITS.sub
        for batch in batches:
            ids = batch.column(0)
            row, number, template, counted = [], [], [], []
            for k, (doc, where, body) in enumerate(zip(ids.to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if not body:
                    continue
                for n, line in enumerate(sub(_SLOT, body.lower()).split("\n")):
                    tokens = line.split()
                    if tokens and tokens[0][0] not in "#|":
                        leaf, new = add(where, tokens, doc)
                        row.append(k)
                        number.append(n)
                        template.append(leaf)
                        counted.append(new)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row, pa.int32())), pa.array(number, pa.int32()), pa.array(template, pa.int64()), pa.array(counted, pa.bool_())],
                ["key", "line_no", "template", "counted"],
            )

    picked = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"))
    return picked.mapInArrow(grow, f"key {kind}, line_no int, template bigint, counted boolean")


def repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", min_docs: int = 5) -> DataFrame:
    """key and line_no of every line whose template stands in at least `min_docs` different
    documents of its source."""
    lines = materialize(line_templates(df, key, text, source, min_docs))
    covering = (
        lines.where("counted").groupBy("template").agg(F.count_distinct("key").alias("docs")).where(F.col("docs") >= min_docs).select("template")
    )
    covering = materialize(covering)
    small = covering.count() <= BROADCAST_TEMPLATES
    found = lines.join(F.broadcast(covering) if small else covering, "template", "left_semi")
    return found.select(F.col("key").alias(key), "line_no")


def without_repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", min_docs: int = 5) -> DataFrame:
    """The rows of `df` with `text` free of repeated lines, and `lines_removed`. Each row
    keeps its other columns, whatever their names; a null text stays null."""
    found = repeated_lines(df, key, text, source, min_docs)
    gone = found.distinct().groupBy(F.col(key).alias("_lines_key")).agg(F.collect_list("line_no").alias("_lines_gone"))
    joined = df.join(gone, df[key].eqNullSafe(F.col("_lines_key")), "left")
    kept = F.filter(F.split(df[text], "\n", -1), lambda line, n: ~F.array_contains(F.col("_lines_gone"), n))
    cleaned = F.when(F.col("_lines_gone").isNull(), df[text]).otherwise(F.array_join(kept, "\n"))
    columns = [cleaned.alias(text) if c == text else df[c] for c in df.columns]
    return joined.select(*columns, F.coalesce(F.size("_lines_gone"), F.lit(0)).alias("lines_removed"))
