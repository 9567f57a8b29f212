"""HTML pages as heading-marked lines, and their links as an edge table."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Elements that are skipped, and those that are kept with their heading depth (0: text).
SKIP = frozenset("script style nav footer noscript iframe form header select option".split())
KEEP = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "p": 0, "li": 0}
LEAST, LINKED = 3, 0.9


class _Lines(HTMLParser):
    """Lines of kept elements; a new one closes the one before, as browsers do with paragraphs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.skip, self.tag, self.text, self.linked, self.anchor = 0, None, [], 0, 0

    def close_line(self) -> None:
        if self.tag:
            t = " ".join("".join(self.text).split())
            if len(t) >= LEAST and self.linked < LINKED * len(t):
                self.lines.append("#" * KEEP[self.tag] + " " * bool(KEEP[self.tag]) + t)
        self.tag, self.text, self.linked = None, [], 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIP:
            self.skip += 1
        elif tag in KEEP:
            self.close_line()
            self.tag = tag
        self.anchor += tag == "a"
        if tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == self.tag:
            self.close_line()
        self.anchor = max(0, self.anchor - (tag == "a"))

    def handle_data(self, data):
        if self.tag and not self.skip:
            self.text.append(data)
            self.linked += len(data.strip()) if self.anchor else 0


def lines_of(html: str | None) -> list[str]:
    p = _Lines()
    p.feed(html or "")
    p.close_line()
    return [x for x, before in zip(p.lines, [None, *p.lines]) if x != before]  # W1


def extract(pages: DataFrame, key: str) -> DataFrame:
    """(key, lines): text of a page as an array of heading-marked lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([lines_of(h) for h in b.column("html").to_pylist()], pa.list_(pa.string()))], names=[key, "lines"])

    return pages.select(key, "html").mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, lines array<string>")


def links(pages: DataFrame, key: str) -> DataFrame:
    """(key, href), each once."""
    return pages.select(key, F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("href"))


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop) reached from seeds (node) over edges (a, b), with the least hop. Each hop joins the frontier alone."""
    seen = seeds.select("node", F.lit(0).alias("hop")).distinct()
    frontier = seen
    for h in range(1, hops + 1):
        new = edges.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        frontier = new.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(frontier)
    return seen
