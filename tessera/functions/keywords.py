"""Keyword gate by each site's own words: one pass over a text finds all words of its site."""

from __future__ import annotations

from collections import Counter, OrderedDict

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MACHINES = 64  # automata that a task keeps
BROADCAST_CHARS = 1 << 22  # of all sites and their words: up to here they travel to the documents
SALTS = 32


class WordCounter:
    """Non-overlapping occurrences of each of a list of words; a word listed twice counts twice, blank words don't."""

    def __init__(self, words: list[str]):
        self.times = Counter(w for w in words if w and w.strip())
        self.machine = ahocorasick.Automaton()
        for word in self.times:
            self.machine.add_word(word, word)
        if self.times:
            self.machine.make_automaton()

    def count(self, text: str) -> int:
        if not self.times or not text:
            return 0
        hits, free = 0, {}
        for end, word in self.machine.iter(text):
            if end - len(word) + 1 >= free.get(word, 0):  # starts where the last one that counted has ended
                hits += self.times[word]
                free[word] = end + 1
        return hits


def site_keyword_hits(docs: DataFrame, sites: DataFrame, site: str, text: str, words: str) -> DataFrame:
    """``docs`` with ``hits``: occurrences of the words of each document's own site, case ignored.

    ``sites`` has one row a site with its words as an array of strings. Occurrences of one word don't
    overlap; those of different words may. Documents of unknown or null sites, and null
    texts, have none. Sites of few words in all are broadcast, so documents stay where they are;
    else documents are dealt over SALTS lanes of their site, to which its words are copied, as one
    site may have most of them. A task builds an automaton for each list it meets and keeps the last 64.
    """
    if "hits" in (c.lower() for c in docs.columns):
        raise ValueError("docs has a column hits")
    listed = sites.select(F.col(site).alias("__site"), F.transform(F.col(words), lambda w: F.lower(w)).alias("__words"))
    chars = F.coalesce(F.length(F.col("__site").cast("string")), F.lit(0)) + F.coalesce(F.length(F.array_join("__words", " ")), F.lit(0)) + 1
    if (listed.agg(F.sum(chars)).first()[0] or 0) <= BROADCAST_CHARS:
        joined = docs.join(F.broadcast(listed), docs[site] == listed["__site"], "left").drop("__site")
    else:
        copied = listed.withColumn("__to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn("__lane", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
        joined = dealt.join(copied, (dealt[site] == copied["__site"]) & (dealt["__lane"] == copied["__to"]), "left").drop("__site", "__lane", "__to")

    @F.pandas_udf("int")
    def count(texts: pd.Series, lists: pd.Series) -> pd.Series:
        known: OrderedDict[tuple, WordCounter] = OrderedDict()
        out = []
        for one, of_site in zip(texts, lists):
            if of_site is None:
                out.append(0)
                continue
            key = tuple(w for w in of_site if w is not None)
            machine = known.pop(key, None) or WordCounter(list(key))
            known[key] = machine
            if len(known) > MACHINES:
                known.popitem(last=False)
            out.append(machine.count(one or ""))
        return pd.Series(out, dtype="int32")

    return joined.withColumn("hits", count(F.lower(F.col(text)), F.col("__words"))).drop("__words")


def density_verdict(text: Column, hits: Column, least: int = 3, least_chars: int = 200) -> Column:
    """Why a text is kept out of its site; null if it passes."""
    size = F.length(F.coalesce(text, F.lit("")))
    return F.when(size == 0, "empty").when(size < least_chars, "short").when(hits < least, "low density")
