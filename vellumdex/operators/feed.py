"""Cleaning of delivered index tables: one row a key, the latest delivery wins.

Every function selects its columns by name first, so further columns of the inputs, whatever they are
called, neither clash nor reach the result. A null time of delivery is older than any other. Rows that tie
on time are ordered by their values (largest wins), which makes the result the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable_posting() -> Column:
    """Both ids there and a frequency of 1 or more; null counts as not usable."""
    return F.col("term_id").isNotNull() & F.col("doc_id").isNotNull() & F.coalesce(F.col("freq") >= 1, F.lit(False))


def clean_postings(term_chunk: DataFrame) -> DataFrame:
    """(term_id, doc_id, run_id, freq): the latest usable row of each (term_id, doc_id).

    The key is (term_id, doc_id), so neither a hot term nor a hot document gathers in one task, and copies
    of one posting shrink before the shuffle. An empty input gives an empty result.
    """
    latest = F.max(F.struct("loaded_at", "freq", "run_id")).alias("latest")
    return (
        term_chunk.select("run_id", "term_id", "doc_id", "freq", "loaded_at")
        .where(usable_posting())
        .groupBy("term_id", "doc_id")
        .agg(latest)
        .select("term_id", "doc_id", F.col("latest.run_id").alias("run_id"), F.col("latest.freq").alias("freq"))
    )


def document_sizes(doc_entry: DataFrame) -> DataFrame:
    """(doc_id, size): the size of the latest row; null where that row's value is null or below 1.

    An older known size doesn't stand in for a later unknown one. Rows without doc_id are left out.
    """
    return (
        doc_entry.select("doc_id", "size_of_doc", "loaded_at")
        .where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max(F.struct("loaded_at", "size_of_doc")).alias("latest"))
        .select("doc_id", F.expr("CASE WHEN latest.size_of_doc >= 1 THEN latest.size_of_doc END").alias("size"))
    )


def list_words(lexicon: DataFrame) -> DataFrame:
    """(run_id, term_id, word): spelling of the latest row, lower case, blanks (U+0020) at the ends removed.

    A null spelling in the latest row gives a null word. An empty spelling is the empty word.
    """
    return (
        lexicon.select("run_id", "term_id", "term", "written_at")
        .groupBy("run_id", "term_id")
        .agg(F.max(F.struct("written_at", "term")).alias("latest"))
        .select("run_id", "term_id", F.lower(F.trim("latest.term")).alias("word"))
    )


def stated_lengths(term_entry: DataFrame) -> DataFrame:
    """(term_id, stated): sum over runs of the list length in the latest row of each (run_id, term_id).

    Null and negative lengths count as unknown; a term all of whose lengths are unknown has null.
    """
    return (
        term_entry.select("run_id", "term_id", "tc_length", "written_at")
        .where("term_id IS NOT NULL")
        .groupBy("run_id", "term_id")
        .agg(F.max(F.struct("written_at", "tc_length")).alias("latest"))
        .groupBy("term_id")
        .agg(F.sum(F.expr("CASE WHEN latest.tc_length >= 0 THEN latest.tc_length END")).cast("bigint").alias("stated"))
    )
