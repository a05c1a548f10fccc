"""Title, text and tables of HTML pages, parsed once per page in Arrow batches.

Defined results: null and empty pages have an empty text and the URL as title; what stands
in scripts, styles, navigation, forms, footers and comments is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HIDDEN = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "template", "svg", "iframe"}
_BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "br", "hr", "table", "dl", "dt", "dd", "figure"}
_SPACE = re.compile(r"\s+")


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title, self.meta = "", ""
        self.hidden: list[str] = []
        self.in_title = False
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        if tag == "meta" and (given.get("property") or given.get("name")) in ("og:title", "title") and given.get("content"):
            self.meta = self.meta or given["content"]
        elif tag == "title":
            self.in_title = True
        elif tag in _HIDDEN:
            self.hidden.append(tag)
        elif not self.hidden:
            if tag in _BLOCK:
                self.parts.append("\n")
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self.parts.append("#" * int(tag[1]) + " ")
            elif tag == "li":
                self.parts.append("- ")
            elif tag == "table":
                self.tables.append([])
            elif tag == "tr" and self.tables:
                self.tables[-1].append([])
            elif tag in ("td", "th") and self.tables and self.tables[-1]:
                self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        elif self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
        elif not self.hidden:
            if tag in ("td", "th") and self.cell is not None:
                self.tables[-1][-1].append(_SPACE.sub(" ", "".join(self.cell)).strip())
                self.cell = None
            elif tag == "tr" and self.tables and self.tables[-1]:
                row = self.tables[-1][-1]
                if any(row):
                    self.parts.append("\n| " + " | ".join(row) + " |")
                else:
                    self.tables[-1].pop()
            elif tag in _BLOCK:
                self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.hidden:
            if self.cell is not None:
                self.cell.append(data)
            else:
                self.parts.append(data)


def parse(page: str | None, url: str | None) -> tuple[str, str, list[list[list[str]]]]:
    """Title, text and tables of one page."""
    parser = _Page()
    parser.feed(page or "")
    parser.close()
    lines = [_SPACE.sub(" ", line).strip() for line in "".join(parser.parts).split("\n")]
    body = re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip()
    title = _SPACE.sub(" ", parser.meta or parser.title).strip()
    return title or url or "", body, [t for t in parser.tables if len(t) > 1]


def extract(df: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """key, title, text and tables (array of rows of cells) of every page."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(page, at) for page, at in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            nested = pa.list_(pa.list_(pa.list_(pa.string())))
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], nested)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "title", "text", "tables"])

    picked = df.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    return picked.mapInArrow(run, f"key {kind}, title string, text string, tables array<array<array<string>>>").withColumnRenamed("key", key)
