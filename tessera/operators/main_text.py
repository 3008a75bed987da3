"""Main text of web pages by the density of text and links in their block tree.

A page is read into its text blocks, each with the path of elements it lies in. Blocks of
running text score by their length and commas; an element gets the scores of the blocks
right under it, and half of those one level deeper. The element of the best score, less the share
of its text that is links, is the page's main element, and its blocks that are not mostly
links are the main text. Scoring, the choice and the joining are aggregates over blocks.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import Scratch

#: Elements whose text never counts, elements without an end tag, and elements that end a block of text.
SILENT = frozenset("script style noscript template iframe svg nav header footer aside form button select option label textarea title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var".split())

LEAST_CHARS = 25  # of a block that scores
CHARS_A_POINT, MOST_POINTS = 100, 3  # a point for so many characters, up to so many
LINKY = 0.5  # share of link characters from which a block is a list of links

BLOCKS = "place int, path array<int>, text string, links int"


class _Blocks(HTMLParser):
    """Text blocks in page order: (path of open block elements by number, text, characters inside links)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[list[int], str, int]] = []
        self.stack: list[tuple[str, int]] = []
        self.made, self.silent, self.links, self.linked, self.parts = 0, 0, 0, 0, []

    def _flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append(([n for tag, n in self.stack if tag not in INLINE], text, self.linked))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self._flush()
            if tag == "p" and any(t == "p" for t, _ in self.stack):
                self.handle_endtag("p")
        self.made += 1
        self.stack.append((tag, self.made))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        if tag not in INLINE:
            self._flush()
        while True:
            name, _ = self.stack.pop()
            self.silent -= name in SILENT
            self.links -= name == "a"
            if name == tag:
                return

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len("".join(data.split()))


def read_blocks(html: str | None) -> list[tuple[int, list[int], str, int]]:
    reader = _Blocks()
    reader.feed(html or "")
    reader.close()
    reader._flush()
    return [(place, path, text, links) for place, (path, text, links) in enumerate(reader.out)]


def page_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, path, text, links): the text blocks of each page; the last of ``path`` is the nearest element."""
    kind = pages.schema[key].dataType.simpleString()

    def read(batches):
        for pdf in batches:
            rows = [(k, *block) for k, page in zip(pdf[key], pdf[html]) for block in read_blocks(page)]
            yield pd.DataFrame(rows, columns=[key, "place", "path", "text", "links"])

    return pages.select(key, html).mapInPandas(read, f"{key} {kind}, {BLOCKS}")


def main_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text) for each page of ``pages``, whose ``key`` is unique: the blocks of its main element, joined by blank lines.

    A page without a block that scores has an empty text, as have null and empty pages.
    Of elements with equal scores the one that opens first is taken.
    """
    blocks = Scratch(pages.sparkSession, "main-text").table(page_blocks(pages, key, html), "blocks")
    chars = F.length(F.regexp_replace("text", r"\s", ""))
    linky = F.col("links") > LINKY * chars
    commas = F.size(F.split("text", "[,;]")) - 1
    score = F.when((F.length("text") >= LEAST_CHARS) & ~linky, 1 + commas + F.least(F.floor(F.length("text") / CHARS_A_POINT), F.lit(MOST_POINTS))).otherwise(0)
    scored = blocks.select(key, "path", score.alias("score"), chars.alias("chars"), "links")
    # a block's nearest element is the block itself (p, li, td); the element around it takes the score, the next one half
    above = lambda n: F.get("path", F.size("path") - F.lit(n))
    given = scored.where("score > 0").select(key, F.explode(F.array(F.struct(above(2).alias("element"), F.col("score").cast("double").alias("score")), F.struct(above(3).alias("element"), (F.col("score") / 2).alias("score")))).alias("g")).select(key, "g.*")
    points = given.where("element IS NOT NULL").groupBy(key, "element").agg(F.sum("score").alias("score"))
    inside = scored.select(key, F.explode("path").alias("element"), "chars", "links").groupBy(key, "element").agg((F.sum("links") / F.sum("chars")).alias("link_share"))
    best = points.join(inside, [key, "element"]).groupBy(key).agg(F.max_by("element", F.struct(F.col("score") * (1 - F.col("link_share")), -F.col("element"))).alias("main"))
    kept = blocks.where(~linky).join(best, key).where(F.array_contains("path", F.col("main")))
    texts = kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda b: b["text"]), "\n\n").alias("text"))  # of one page
    return pages.select(key).join(texts, key, "left").withColumn("text", F.coalesce("text", F.lit("")))
