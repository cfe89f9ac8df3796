"""Boolean, phrase and prefix queries over the lasting index.

A query is words, "phrases" and prefix* joined by AND, OR, NOT and parentheses; words side by side are joined by AND, and that binds tighter than NOT, NOT tighter than
AND, AND tighter than OR. A word with marks in it (well-known) is a phrase of its parts. A query that is no such expression (a quote or parenthesis left
open, an operator without a side) and one without words match nothing.

Each word, phrase or prefix of a query is one of its leaves. All leaves of all queries are looked up together: words by the term, prefixes by as many
first letters of the terms, phrases by joining the places of their words, each less its number in the phrase. What a memory matches is a set of leaves, and the
query's tree says whether that set will do. The score is BM25 with leaves in place of words, as many as the memory matches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators import inverted
from tidepool.operators.inverted import Index, gain, holds, weights
from tidepool.operators.search import top
from tidepool.sources.folder import written

_PART = re.compile(r'"([^"]*)"(\*?)|([()])|([^\s()"]+)')
_WORD = re.compile("[a-z0-9]+")
LEAVES = "query_id long, leaf int, kind string, words array<string>"
TREES = "query_id long, tree string"


class Reader:
    """One query's leaves and its tree: a leaf's number, or [operator, left, right]."""

    def __init__(self, query: str):
        if query.count('"') % 2:
            raise ValueError("a quote is left open")
        self.parts = [(("leaf", m[1], bool(m[2])) if m[1] is not None else (m[3], "", False) if m[3] else (m[4], m[4], m[4].endswith("*"))) for m in _PART.finditer(query)]
        self.at, self.leaves = 0, []
        self.tree = self.joined(["OR", "AND", "NOT"])
        if self.at < len(self.parts):
            raise ValueError("a parenthesis too many")

    def next(self) -> str:
        return self.parts[self.at][0] if self.at < len(self.parts) else ")"

    def joined(self, operators: list[str]):
        if not operators:
            return self.side_by_side()
        tree = self.joined(operators[1:])
        while self.next() == operators[0]:
            self.at += 1
            tree = [operators[0], tree, self.joined(operators[1:])]
        return tree

    def side_by_side(self):
        tree = None
        while self.next() not in (")", "AND", "OR", "NOT"):
            one = self.one()
            tree = one if tree is None else ["AND", tree, one]
        if tree is None:
            raise ValueError("an operator without a side")
        return tree

    def one(self):
        kind, text, prefix = self.parts[self.at]
        self.at += 1
        if kind == "(":
            tree = self.joined(["OR", "AND", "NOT"])
            if self.at == len(self.parts):
                raise ValueError("a parenthesis is left open")
            self.at += 1
            return tree
        words = _WORD.findall(text.lower())
        if not words or prefix and len(words) > 1:
            raise ValueError("no word")
        self.leaves.append(("prefix" if prefix else "word" if len(words) == 1 else "phrase", words))
        return len(self.leaves) - 1


def read(query: str | None) -> Reader | None:
    try:
        return Reader(query or "")
    except ValueError:
        return None


def leaves_of(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """query_id, leaf, kind, words; and query_id, tree. A query has 63 leaves at most; one with more matches nothing."""

    def run(batches: Iterator[pd.DataFrame], trees: bool) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(i, r) for i, r in ((i, read(q)) for i, q in zip(b["query_id"], b["query"], strict=True)) if r and len(r.leaves) < 64]
            if trees:
                yield pd.DataFrame([(i, json.dumps(r.tree)) for i, r in found], columns=["query_id", "tree"])
            else:
                yield pd.DataFrame([(i, n, kind, words) for i, r in found for n, (kind, words) in enumerate(r.leaves)], columns=["query_id", "leaf", "kind", "words"])

    own = queries.select("query_id", "query")
    return own.mapInPandas(lambda b: run(b, False), LEAVES), own.mapInPandas(lambda b: run(b, True), TREES)


def words_in(index: Index, leaves: DataFrame) -> DataFrame:
    """query_id, leaf, term, m, at: the index's terms that leaves name; of a phrase (of m words) with their numbers in it."""
    key = ["query_id", "leaf"]
    single = leaves.where("kind = 'word'").select(*key, F.col("words")[0].alias("term"))
    starts = leaves.where("kind = 'prefix'").select(*key, F.col("words")[0].alias("start"))
    lengths = [r[0] for r in starts.select(F.length("start")).distinct().collect()]  # no more than the longest word's letters
    vocabulary = index.table("blocks").select("term").distinct()
    if lengths:
        cut = vocabulary.select("term", F.explode(F.lit(lengths)).alias("n")).where(F.length("term") >= F.col("n")).select("term", F.substring(F.col("term"), F.lit(1), F.col("n")).alias("start"))
        single = single.unionByName(starts.join(cut, "start").select(*key, "term"))
    phrase = leaves.where("kind = 'phrase'").select(*key, F.size("words").alias("m"), F.posexplode("words").alias("at", "term"))
    return single.select(*key, "term", F.lit(None).cast("int").alias("m"), F.lit(0).alias("at")).unionByName(phrase.select(*key, "term", "m", "at"))


def places(index: Index, leaves: DataFrame) -> DataFrame:
    """query_id, leaf, block, memory_id, size, count: how often each leaf occurs in each live memory."""
    key = ["query_id", "leaf"]
    asked = written(words_in(index, leaves), "leaves")
    rows = index.live(index.table("postings").join(asked.select("term").distinct(), "term", "left_semi"))
    hits = rows.join(asked, "term")
    own = ["block", "memory_id", "size"]
    plain = hits.where("m IS NULL").groupBy(*key, *own).agg(F.sum("count").cast("long").alias("count"))
    # a phrase begins where all of its words, each at its number in it, lead back to
    # (places are read of the memories that have all of its words)
    near = hits.where("m IS NOT NULL").select(*key, *own, "m", "term", "at")
    whole = near.groupBy(*key, *own).agg(F.count_distinct("at").alias("n"), F.first("m").alias("m")).where("n = m").select(*key, *own)
    spots = index.table("forward").join(whole.select("block", "memory_id").distinct(), ["block", "memory_id"], "left_semi").select("block", "memory_id", F.posexplode(F.transform("line", lambda n: F.get(F.col("words.term"), n))).alias("p", "term"))
    begins = near.join(whole, [*key, *own], "left_semi").join(spots, ["block", "memory_id", "term"]).select(*key, *own, "m", "p", "at").groupBy(*key, *own, "m", (F.col("p") - F.col("at")).alias("begin")).agg(F.count(F.lit(1)).alias("n"))
    phrases = begins.where("n = m").groupBy(*key, *own).agg(F.count(F.lit(1)).alias("count"))
    return plain.unionByName(phrases)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, memory_id, score, rank. queries: query_id, query; one row a query_id."""
    n_docs, average = index.stats()
    leaves, trees = leaves_of(queries)
    leaves = written(leaves, "asked")
    if inverted.hits_of(index, words_in(index, leaves)) > inverted.SCANNED:
        return top(inverted.scan(index, leaves.join(trees, "query_id"), k, n_docs, average), k)
    found = written(places(index, leaves), "places")
    idf = found.groupBy("query_id", "leaf").agg(weights(F.count(F.lit(1)), n_docs).alias("idf"))
    hits = found.join(idf, ["query_id", "leaf"])
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), leaf)")
    sums = hits.groupBy("query_id", "memory_id").agg(F.round(F.sum(F.col("idf") * gain(F.col("count"), F.col("size"), average)), 6).alias("score"), F.bit_or(bit).alias("mask"))

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, int], bool] = {}
        for b in batches:
            pairs = list(zip(b["tree"], b["mask"].tolist(), strict=True))
            for tree, mask in set(pairs) - known.keys():
                known[tree, mask] = holds(json.loads(tree), mask)
            yield b.loc[[known[x] for x in pairs], ["query_id", "memory_id", "score"]]
            if len(known) > 1 << 16:
                known.clear()

    return top(sums.join(trees, "query_id").mapInPandas(fits, "query_id long, memory_id long, score double"), k)
