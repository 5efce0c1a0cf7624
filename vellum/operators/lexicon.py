"""Which keywords of a large lexicon occur in which texts, as substrings.

Short lexicons are literal arrays (``functions.text``). A lexicon that is a table of its own goes to every task, where a
text meets it word by word: a keyword without a space lies within one word, so that each word is looked up once a task,
by all its pieces of a keyword's length, and a text takes what its distinct words have. A keyword with spaces is looked
for in texts that have the longest of its parts.

A lexicon too large for that is joined by anchors of three characters: each keyword goes under the one of its pieces that
the fewest texts have, texts meet it by equality on their distinct pieces, and the whole keyword is then looked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.functions import text as T
from vellum.sources.shared import bounded_batches

GRAM = 3
#: Keywords that are sent to every task; more meet the texts by a shuffle of pieces.
BROADCAST_KEYWORDS = 500_000
#: Characters of words whose keywords a task remembers, and texts that it gives out at once.
KNOWN_CHARS, TEXTS = 8 << 20, 256


def grams(text: Column, n: int = GRAM) -> Column:
    """The distinct runs of ``n`` characters of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _pieces(text: Column, lengths: list[int]) -> Column:
    return F.flatten(F.array(*(grams(text, n) for n in lengths)))


def anchored(keywords: DataFrame, texts: DataFrame, lengths: list[int]) -> DataFrame:
    """(keyword, anchor): each keyword with its rarest piece, by the number of texts that have it; the first of equals."""
    pieces = keywords.select("keyword", F.explode(grams(F.col("keyword")) if lengths == [GRAM] else F.when(F.length("keyword") < GRAM, F.array("keyword")).otherwise(grams(F.col("keyword")))).alias("anchor"))
    wanted = pieces.select("anchor").distinct()
    count = texts.select(F.explode(_pieces(F.col("low"), lengths)).alias("anchor")).join(wanted, "anchor", "left_semi").groupBy("anchor").agg(F.count("*").alias("n"))
    first = Window.partitionBy("keyword").orderBy("n", "anchor")
    return pieces.join(count, "anchor").withColumn("r", F.row_number().over(first)).where("r = 1").select("keyword", "anchor")


class Pieces:
    """The keywords of a lexicon by what a word must hold, for one task."""

    def __init__(self, keywords: list[str]):
        self.spaced: dict[int, list[int]] = {}  # by the number of a part, the keywords with spaces that have it
        self.everywhere: list[int] = []  # keywords of spaces alone
        self.keywords, self.number = keywords, {}
        for i, k in enumerate(keywords):
            if " " not in k:
                self.number[k] = i
        more = len(keywords)
        for i, k in enumerate(keywords):
            if " " in k and (part := max(k.split(" "), key=len)):
                if part not in self.number:
                    self.number[part], more = more, more + 1
                self.spaced.setdefault(self.number[part], []).append(i)
            elif " " in k:
                self.everywhere.append(i)
        self.lengths = sorted({len(k) for k in self.number})
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def of_word(self, word: str) -> tuple[int, ...]:
        """The numbers of all keywords and parts within a word."""
        if (found := self.known.get(word)) is None:
            pieces = {word[i : i + n] for n in self.lengths if n <= len(word) for i in range(len(word) - n + 1)}
            found = tuple(self.number[p] for p in pieces & self.number.keys())
            if self.held + len(word) > KNOWN_CHARS:
                self.known, self.held = {}, 0
            if len(word) <= KNOWN_CHARS:
                self.known[word] = found
                self.held += len(word)
        return found

    def of_text(self, text: str) -> list[int]:
        """The numbers of all keywords within a text, in their order."""
        found = set().union(*map(self.of_word, set(text.split(" "))))
        parts = [i for i in found if i in self.spaced] if self.spaced else []
        said = [k for k in (*self.everywhere, *(k for i in parts for k in self.spaced[i])) if self.keywords[k] in text]
        return sorted({i for i in found if i < len(self.keywords)}.union(said))


def _looked_up(shared: Broadcast) -> Callable:
    """(keys, low) to (keys, keywords), texts without a keyword left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        words = pa.array(pieces.keywords, pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                found = [pieces.of_text(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(f) for f in found])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array([i for f in found for i in f], pa.int64())))
                on = pa.array(np.diff(ends) > 0)
                yield pa.RecordBatch.from_arrays([*(c.filter(on) for c in batch.columns[:-1]), lists.filter(on)], [*batch.schema.names[:-1], "keywords"])

    return run


def keyword_lists(docs: DataFrame, lexicon: DataFrame, *keys: str, text: str = "text", keyword: str = "keyword", limit: int = BROADCAST_KEYWORDS) -> DataFrame:
    """(keys, keywords): the keywords of a lexicon that occur in each text, sorted, case aside, white space as one space.

    Null and empty keywords occur nowhere, repeated ones count once; texts without a keyword have no row. ``keys`` name the
    rows of ``docs``. Nothing is shuffled, unless the lexicon has more than ``limit`` keywords: rows of equal keys are then one text."""
    words = lexicon.select(F.lower(F.col(keyword).cast("string")).alias("keyword")).where("keyword <> ''").distinct()
    texts = docs.select(*keys, F.lower(T.collapse(F.col(text))).alias("low"))
    listed = texts.select(*keys, F.array("low").alias("keywords"))
    held = [r["keyword"] for r in words.limit(limit + 1).collect()]
    if not held:
        return listed.limit(0)
    if len(held) > limit:
        return anchor_joined(texts, words, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list("keyword")).alias("keywords"))
    bounded_batches(docs.sparkSession)
    return texts.mapInArrow(_looked_up(docs.sparkSession.sparkContext.broadcast(sorted(held))), listed.schema)


def anchor_joined(texts: DataFrame, words: DataFrame, *keys: str) -> DataFrame:
    """(keys, keyword) of collapsed lower-case texts and keywords by a shuffled join. A keyword with a piece that no text has
    is left out before texts are read for it."""
    lengths = sorted(r["n"] for r in words.select(F.least(F.length("keyword"), F.lit(GRAM)).alias("n")).distinct().collect())
    met = texts.select(*keys, "low", F.explode(_pieces(F.col("low"), lengths)).alias("anchor")).join(anchored(words, texts, lengths).hint("merge"), "anchor")
    return met.where(F.contains("low", F.col("keyword"))).select(*keys, "keyword")


def found_keywords(docs: DataFrame, lexicon: DataFrame, *keys: str, text: str = "text", keyword: str = "keyword", limit: int = BROADCAST_KEYWORDS) -> DataFrame:
    """(keys, keyword), one row for each keyword that occurs in a text, as ``keyword_lists`` has them."""
    return keyword_lists(docs, lexicon, *keys, text=text, keyword=keyword, limit=limit).select(*keys, F.explode("keywords").alias("keyword"))
