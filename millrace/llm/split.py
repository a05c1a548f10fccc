"""Splitting oversized items at natural boundaries.

The text is cut into atomic segments (paragraphs, lines, sentences; a sentence over the
limit into clauses and word groups), every boundary having a strength. Adjacent pairs
wait in a heap and the weakest boundary is merged first, the smaller pair before the
larger, as long as the merged segment plus its overlap fits. A piece is a slice of the
text: it begins with the last `overlap_words` words of the piece before (with the last
`overlap_chars` characters where the text before is in a script without blanks).

Defined results: null, empty and blank texts give one empty piece 0; an item within the
limits is one piece, unchanged; a repeated row is split again. Should forty words be
longer than half a piece, the overlap is `overlap_chars` characters.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.sentences import sentence_starts

_WORDS = re.compile(r"\S+")
_CLAUSE = re.compile(r"[,;:、，；：]\s*(?=\S)|\s[-–—]\s+(?=\S)")
_SPACELESS = re.compile("[ก-๛぀-ヿ一-鿿]")
BLANK_LINE, LINE, SENTENCE, CLAUSE, WORD = 4, 3, 2, 1, 0


class Limits(NamedTuple):
    words: int = 400
    chars: int = 3200
    overlap_words: int = 40
    overlap_chars: int = 200


class Piece(NamedTuple):
    start: int  # of the slice, overlap included
    body: int  # where the new text begins
    stop: int


class _Text:
    def __init__(self, text: str, limits: Limits) -> None:
        self.text, self.limits = text, limits
        self.words = [m.start() for m in _WORDS.finditer(text)]
        self.begins: dict[int, int] = {}
        # running counts of letters, and of those of scripts without blanks, where there are any
        self.letters = self.spaceless = None
        if not text.isascii() and _SPACELESS.search(text):
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            own = ((codes >= 0xE01) & (codes <= 0xE5B)) | ((codes >= 0x3040) & (codes <= 0x30FF)) | ((codes >= 0x4E00) & (codes <= 0x9FFF))
            self.spaceless = np.concatenate([[0], np.cumsum(own)])
            self.letters = np.concatenate([[0], np.cumsum(np.fromiter(map(str.isalpha, text), bool, len(text)))])

    def count(self, a: int, b: int) -> int:
        """Words of the slice; a cut inside a word makes two."""
        n = bisect_left(self.words, b) - bisect_left(self.words, a)
        inside = 0 < a < len(self.text) and not self.text[a].isspace() and not self.text[a - 1].isspace()
        return n + inside

    def overlap(self, at: int) -> int:
        """Where a piece whose new text begins at `at` has to begin."""
        begin = self.begins.get(at)
        if begin is None:
            begin = self.begins[at] = self._overlap(at)
        return begin

    def _overlap(self, at: int) -> int:
        if at == 0:
            return 0
        end = at
        while end and self.text[end - 1].isspace():
            end -= 1
        if self.spaceless is not None:
            low = max(0, end - self.limits.overlap_chars)
            if (self.spaceless[end] - self.spaceless[low]) * 3 > self.letters[end] - self.letters[low]:
                return low
        k = bisect_left(self.words, end)
        start = self.words[max(0, k - self.limits.overlap_words)]
        return start if at - start <= self.limits.chars // 2 else max(0, end - self.limits.overlap_chars)

    def fits(self, a: int, b: int) -> bool:
        while b > a and self.text[b - 1].isspace():
            b -= 1
        return b - a <= self.limits.chars and self.count(a, b) <= self.limits.words


def _segments(doc: _Text) -> tuple[list[int], list[int]]:
    """Starts of the atomic segments and the strength of the boundary before each."""
    text, limits = doc.text, doc.limits
    starts, strength = [], []
    units = sentence_starts(text)
    for a, b in zip(units, [*units[1:], len(text)]):
        gap, at = 0, a - 1
        while at >= 0 and text[at].isspace():
            gap += text[at] == "\n"
            at -= 1
        starts.append(a)
        strength.append(BLANK_LINE if gap > 1 else LINE if gap else SENTENCE)
        if doc.fits(doc.overlap(a), b) and b - a <= limits.chars // 2 and doc.count(a, b) <= limits.words // 2:
            continue
        # too long to be packed well: clauses, then groups of words or characters
        cuts = [m.end() for m in _CLAUSE.finditer(text, a, b)]
        last = a
        for cut in [*cuts, b]:
            while cut - last > limits.chars // 8 or doc.count(last, cut) > limits.words // 8:
                k = bisect_left(doc.words, last + 1)
                k = min(k + limits.words // 8 - 1, bisect_left(doc.words, last + limits.chars // 8 + 1) - 1)
                step = doc.words[k] if 0 <= k < len(doc.words) and last < doc.words[k] < cut else min(last + limits.chars // 8, cut)
                if step >= cut:
                    break
                starts.append(step)
                strength.append(WORD)
                last = step
            if cut < b and cut > last:
                starts.append(cut)
                strength.append(CLAUSE)
                last = cut
    starts[0] = 0
    return starts, strength


def split_text(text: str | None, limits: Limits = Limits()) -> list[Piece]:
    """The pieces of one item, in order."""
    if not text or not text.strip():
        return [Piece(0, 0, 0)]
    if len(text) <= limits.chars and len(text.split()) <= limits.words:
        return [Piece(0, 0, len(text))]
    doc = _Text(text, limits)
    starts, strength = _segments(doc)
    n = len(starts)
    stops, begin = [*starts[1:], len(text)], [doc.overlap(a) for a in starts]
    right, left, version = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and doc.fits(begin[i], stops[j]):
            heapq.heappush(heap, (strength[j], stops[j] - begin[i], i, version[i], version[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, _, i, vi, vj = heapq.heappop(heap)
        j = right[i] if i < n else n
        if version[i] != vi or j >= n or version[j] != vj:
            continue
        stops[i], right[i] = stops[j], right[j]
        if right[j] < n:
            left[right[j]] = i
        version[i] += 1
        version[j] = -1
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out, i = [], 0
    while i < n:
        stop = stops[i]
        while stop > starts[i] and text[stop - 1].isspace():
            stop -= 1
        out.append(Piece(begin[i], starts[i], stop))
        i = right[i]
    return out


def pieces(df: DataFrame, keys: Sequence[str], text: str, limits: Limits = Limits()) -> DataFrame:
    """Ordered pieces of every row: the columns of `keys`, then piece_no, content, body_pos (where
    the content stops repeating the piece before), start_pos, end_pos, words, chars, item_words, item_chars."""
    names = [f"k{n}" for n in range(len(keys))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cells = [], []
            for k, body in enumerate(batch.column(len(names)).to_pylist()):
                body = body or ""
                size, length = len(body.split()), len(body)
                for number, (start, fresh, stop) in enumerate(split_text(body, limits)):
                    content = body[start:stop]
                    row.append(k)
                    cells.append((number, content, fresh - start, start, stop, len(content.split()), len(content), size, length))
            taken = pa.array(row, pa.int32())
            columns = [batch.column(k).take(taken) for k in range(len(names))]
            parts = list(zip(*cells)) if cells else [()] * 9
            columns += [pa.array(x, pa.string() if k == 1 else pa.int32()) for k, x in enumerate(parts)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "piece_no", "content", "body_pos", "start_pos", "end_pos", "words", "chars", "item_words", "item_chars"])

    picked = df.select(*[F.col(c).alias(n) for c, n in zip(keys, names)], F.col(text).alias("_text"))
    schema = "".join(f"{n} {df.schema[c].dataType.simpleString()}, " for c, n in zip(keys, names))
    schema += "piece_no int, content string, body_pos int, start_pos int, end_pos int, words int, chars int, item_words int, item_chars int"
    out = picked.mapInArrow(cut, schema)
    for c, n in zip(keys, names):
        out = out.withColumnRenamed(n, c)
    return out
