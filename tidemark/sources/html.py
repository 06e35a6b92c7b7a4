"""Text of web pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content is no text of the page.
DROPPED = frozenset(["script", "style", "noscript", "svg", "nav", "footer"])
_BLOCKS = frozenset(["p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "table", "ul", "ol", "pre", "blockquote", "title"])


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip: list[str] = []
        self.in_title = False
        self.title: list[str] = []
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.skip.append(tag)
        self.in_title = tag == "title" and not self.title
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.skip:
            del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]
        if tag == "title":
            self.in_title = False
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.skip:
            (self.title if self.in_title else self.parts).append(data)


def page_text(html: str) -> tuple[str, str]:
    """(title, text): non-empty lines of the body, white space run together. Broken markup gives what can be read."""
    r = _Reader()
    r.feed(html)
    r.close()
    lines = (" ".join(x.split()) for x in "".join(r.parts).split("\n"))
    return " ".join("".join(r.title).split()), "\n".join(x for x in lines if x)


def html_text(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, title, text) of each page; '' for null or empty ones. Parsed in Arrow batches, a page at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [page_text(x.as_py() or "") for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.string())], [id_col, "title", "text"])

    slim = pages.select(F.col(id_col), F.col(html_col).alias("html"))
    return slim.mapInArrow(run, T.StructType([slim.schema[id_col], T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
