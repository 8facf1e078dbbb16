"""Text windows that show a query's words.

A body is cut into windows of WINDOW characters that don't overlap; the last, shorter or just full one is never
used. A window's score is the number of its words that the query has, repeated query words counting again. A
word cut by the window's start counts as what is left of it; a word that touches the window's end doesn't count.
Windows are in characters, so bodies with other than ASCII characters are cut elsewhere than by bytes.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumdex.functions.text import ascii_lower, query_words, terms
from vellumdex.operators.index import SearchIndex
from vellumdex.operators.search import fetch_regions, fetched, of_documents

WINDOW = 512


def _score(found: Column, typed: Counter) -> Column:
    if not typed:
        return F.lit(0)
    weights = F.create_map(*(F.lit(x) for w, n in sorted(typed.items()) for x in (w, n)))
    return F.aggregate(found, F.lit(0), lambda total, t: total + F.coalesce(F.try_element_at(weights, t), F.lit(0)))


def windows(corpus: DataFrame, text: str) -> DataFrame:
    """(doc_id, start, score, window): every window of every body.

    A body is cut in one pass, whatever its length, and only its windows go on.
    """
    every = F.regexp_extract_all("body", F.lit(f"(?s).{{{WINDOW}}}(?=.)"), F.lit(0))
    cut = corpus.where("body IS NOT NULL").select("doc_id", F.posexplode(every).alias("nth", "window"))
    words = cut.select("doc_id", (F.col("nth") * WINDOW).alias("start"), "window", terms(F.col("window"), keep_tail=False).alias("found"))
    return words.select("doc_id", "start", _score(F.col("found"), Counter(query_words(text))).alias("score"), "window")


def snippets(ranked: DataFrame, corpus: DataFrame, text: str, last_positive: bool = False) -> DataFrame:
    """(rank, doc_id, start, snippet): the window of the highest score, the earliest of equals; null if none has a word.

    With `last_positive`, the last window that has any of the words. The text is in lower case (ASCII letters
    only) and one character shorter than the window. Runs the ranking when called; `corpus` is a table.
    """
    few, ids = fetched(ranked.select("rank", "doc_id"))
    return _best(few, of_documents(corpus.select("doc_id", "body"), few, ids), text, last_positive)


def region_snippets(index: SearchIndex, ranked: DataFrame, text: str, last_positive: bool = False, file: str | None = None, characters: int | None = None) -> DataFrame:
    """`snippets` from the tagged files the index was built from: only the ranked documents' regions are read.

    `characters` looks at so many first characters of a document only, `file` is as in `fetch_regions`.
    """
    few, _ = fetched(ranked.select("rank", "doc_id"))
    return _best(few, fetch_regions(index, few, characters, file), text, last_positive)


def _best(few: DataFrame, bodies: DataFrame, text: str, last_positive: bool) -> DataFrame:
    scored = windows(bodies, text).where("score > 0")
    key = F.struct("start") if last_positive else F.struct("score", (-F.col("start")).alias("early"))
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct("start", "window"), key).alias("best"))
    shown = ascii_lower(F.substring(F.col("best.window"), 1, WINDOW - 1))
    return few.join(best, "doc_id", "left").select("rank", "doc_id", F.col("best.start").alias("start"), shown.alias("snippet"))
